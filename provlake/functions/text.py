"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_CATEGORY

# Labels that count as free to use.
CC0_MARKS = ("cc0", "creative commons zero")
PD_MARKS = ("cc0", "pd", "public domain", "publicdomain", "pdm", "pd-us", "pd-art", "no known copyright", "no copyright")
EXTENSIONS = (".jpg", ".jpeg", ".png")
IMAGE_MIMES = ("image/jpeg", "image/png")
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"


def stripped(c: Column) -> Column:
    """White space, Unicode's included, off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """Null for the empty string, so that coalesce() skips it."""
    return F.when(c != "", c)


def normalise_licence(raw: Column, strict: bool = False) -> Column:
    """CC0, PD or null. Marks count anywhere in the label; with `strict`, only as whole words and not after "not"."""
    text = F.lower(raw)
    if strict:
        word = lambda m: rf"(?<![a-z])(?<!not ){m.replace(' ', r'\s+')}(?![a-z])"
        found = lambda marks: text.rlike("|".join(map(word, marks)))
    else:
        found = lambda marks: F.greatest(*(F.contains(text, F.lit(m)) for m in marks))
    return F.when(found(CC0_MARKS), "CC0").when(found(PD_MARKS), "PD")


def accepted(raw: Column, strict: bool = False) -> Column:
    return normalise_licence(raw, strict).isNotNull()


def normalise_category(raw: Column) -> Column:
    text = F.lower(stripped(F.coalesce(raw, F.lit(""))))
    return F.when(text == "", DEFAULT_CATEGORY).otherwise(text)


def slugify(name: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "unknown").otherwise(text)


def search_query(search: Column, name: Column) -> Column:
    return F.coalesce(truthy(search), name)


def clean_html(value: Column) -> Column:
    """Tags to spaces, white space collapsed and stripped, empty to null; entities stay."""
    return truthy(stripped(F.regexp_replace(F.regexp_replace(value, "<[^>]+>", " "), r"(?U)\s+", " ")))


def extract_year(*values: Column) -> Column:
    """The first four-digit year from 1000 to 2099 in the first value that has one."""
    return F.coalesce(*(truthy(F.regexp_extract(v, YEAR, 1)).try_cast("int") for v in values))


def without_file_prefix(title: Column) -> Column:
    return truthy(F.regexp_replace(title, "^File:", ""))


def extension(url: Column) -> Column:
    """The suffix of the part before `?`, if it is a known one, else .jpg."""
    ext = F.lower(F.regexp_extract(F.split_part(url, F.lit("?"), F.lit(1)), r"[^/](\.[^./]+)$", 1))
    return F.when(ext.isin(*EXTENSIONS), ext).otherwise(".jpg")


def content_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def cache_key(source: Column, url: Column) -> Column:
    return F.concat(source, F.lit("-"), F.sha1(url.cast("binary")), extension(url))


def pool_filename(subject: Column, year: Column, source: Column, sha256: Column, ext: Column) -> Column:
    when = F.when(F.coalesce(year, F.lit(0)) == 0, "ny").otherwise(year.cast("string"))
    return F.concat(F.concat_ws("_", F.lower(subject), when, source, F.substring(sha256, 1, 8)), ext)


def capped_size(width: Column, height: Column, megapixels: float) -> tuple[Column, Column]:
    """Width and height as they land: scaled down if the picture has more than `megapixels` (0: no limit)."""
    area = width.cast("double") * height / 1e6
    scale = F.sqrt(F.lit(megapixels) / area)
    over = (area > megapixels) & F.lit(megapixels > 0)
    side = lambda c: F.when(over, F.greatest(F.lit(1), F.floor(c * scale).cast("int"))).otherwise(c.cast("int"))
    return side(width), side(height)


def split_csv(c: Column) -> Column:
    """Items of a comma list, trimmed, blanks dropped; null for null and empty."""
    items = F.filter(F.transform(F.split(c, ","), stripped), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) != "", items)


def group_label(c: Column) -> Column:
    """The key as shown: `?` for null and empty."""
    return F.coalesce(truthy(c), F.lit("?"))


def gib(c: Column) -> Column:
    return c / F.lit(1024.0**3)


def now_text() -> Column:
    """The current time in UTC as ISO 8601 text, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
