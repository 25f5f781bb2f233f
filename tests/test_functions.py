import pytest
from pyspark.sql import functions as F

from provlake.functions import text as T


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_licences(spark):
    raw = ["CC0", " cc0 1.0 ", "Creative Commons Zero", "Public domain", "PD-US", "PD-Art (PD-old-100)", "No known copyright restrictions", "CC BY-SA 4.0", "All rights reserved", "", None]
    assert each(spark, raw, T.normalise_licence) == ["CC0"] * 3 + ["PD"] * 4 + [None] * 4


def test_licences_match_within_words_unless_strict(spark):
    raw = ["CC BY 4.0, updated 2020", "GNU GPL (pdf)", "Not public domain", "PD-US", "CC0 1.0"]
    assert each(spark, raw, T.normalise_licence) == ["PD", "PD", "PD", "PD", "CC0"]
    assert each(spark, raw, lambda c: T.normalise_licence(c, strict=True)) == [None, None, None, "PD", "CC0"]


def test_categories(spark):
    assert each(spark, ["", None, "  ", " WardRobe\u00a0", "new"], T.normalise_category) == ["identity"] * 3 + ["wardrobe", "new"]


def test_slugs(spark):
    assert each(spark, [" Red  dress! ", "Zürich", "___", "", None, "a_b"], T.slugify) == ["Red_dress", "Z_rich", "unknown", "unknown", "unknown", "a_b"]


def test_html(spark):
    assert each(spark, ["<b>A</b>\u00a0 <i>b</i>", "<br>", "", None, "a &amp; b"], T.clean_html) == ["A b", None, None, None, "a &amp; b"]


def test_years(spark):
    assert each(spark, ["in 1921", "Einstein_1921.jpg", "2150", "0999", "12345", None], lambda c: T.extract_year(c, F.lit("x 1850"))) == [1921] + [1850] * 5


def test_extensions(spark):
    urls = ["https://a/b.JPG?x=.png", "https://a/b.webp", "https://a.b/c", "https://a/.png", "https://a/b.jpeg", "https://a/b.png#c"]
    assert each(spark, urls, T.extension) == [".jpg", ".jpg", ".jpg", ".jpg", ".jpeg", ".jpg"]


def test_csv(spark):
    assert each(spark, [" a, ,b ,", ",", "", None], T.split_csv) == [["a", "b"], [], None, None]


def test_titles_and_queries(spark):
    assert each(spark, ["File:a", "a File:", "File:", None], T.without_file_prefix) == ["a", "a File:", None, None]
    assert each(spark, ["", None, "q"], lambda c: T.search_query(c, F.lit("n"))) == ["n", "n", "q"]


def test_now(spark):
    import re

    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", spark.range(1).select(T.now_text()).first()[0])


@pytest.mark.parametrize(("size", "cap", "want"), [((4000, 4000), 12.0, (3464, 3464)), ((100, 100), 12.0, (100, 100)), ((4000, 4000), 0.0, (4000, 4000)), ((100_000_000, 1), 1.0, (10_000_000, 1))])
def test_megapixels(spark, size, cap, want):
    assert tuple(spark.range(1).select(*T.capped_size(F.lit(size[0]), F.lit(size[1]), cap)).first()) == want


def test_filenames(spark):
    make = lambda y: spark.range(1).select(T.pool_filename(F.lit("Ann_B"), F.lit(y).cast("int"), F.lit("loc"), F.lit("0123456789"), F.lit(".png"))).first()[0]
    assert make(1900) == "ann_b_1900_loc_01234567.png"
    assert make(0) == make(None) == "ann_b_ny_loc_01234567.png"
