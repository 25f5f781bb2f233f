"""URL filters: rules by longest match, and a path-template tree per host for the rest.

The tree is grown level by level with groupings only, and what all paths of a branch share is
one level, so the rounds are as many as paths part ways and don't follow the longest path. Under each (host, template so far) the
segments at the next level are counted; segments that look like identifiers become the wildcard
`*`, and so do siblings whose share of bad labels does not differ significantly from that of the
rest of the branch (a two-proportion test at `z`). Where the branch has many kinds, a segment rarer
than `rare` of it needs `few` labels at least for that test, else it merges. A template's purity is its smoothed
share of good labels, the host's own share being the prior with weight `prior`, the corpus's
share the prior of the host; templates under `purity` are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path start) as the contract gives them.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equals, the one first in `rules`."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, empty ones left out; identifiers already generalised to `*`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    code = r"^(?=.*[0-9])[0-9A-Za-z_.-]*$|^.{40,}$"
    return F.transform(parts, lambda s: F.when(s.rlike(code), "*").otherwise(s))


def grown(pages: DataFrame, labels: DataFrame, rare: float = 0.01, many: int = 20, z: float = 1.96, few: int = 10) -> tuple[DataFrame, DataFrame]:
    """(page_id, host, path, s): each page with its path shape; and (host, s, t, good, bad): the template of each shape with its label counts (null labels: 0).

    `pages` has page_id, host, path; `labels` has page_id and bad (0/1), a row for each labelled
    page. Level by level, only counts by (host, template, segment) are gathered, each bounded by
    what its tasks hold after partial sums. A page's template does not depend on other hosts.
    """
    marks = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    flag = pages.join(marks, "page_id", "left").select("page_id", "host", "path", segments(F.col("path")).alias("s"), F.coalesce((1 - F.col("bad")).cast("long"), F.lit(0)).alias("good"), F.coalesce(F.col("bad").cast("long"), F.lit(0)).alias("bad"))
    # pages with one path shape travel as one row; a hot host is as many rows as it has shapes
    shapes = flag.groupBy("host", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    active, done = written(shapes.withColumn("t", F.lit("")).withColumn("at", F.lit(0)), "shapes"), None
    columns = [*shapes.columns, "t", "at"]
    rest = F.slice("s", F.col("at") + 2, F.greatest(F.size("s") - F.col("at") - 1, F.lit(1)))
    while True:
        ended = active.where("at >= size(s)").select(*shapes.columns, "t")
        done = ended if done is None else done.union(ended)
        here = active.where("at < size(s)").withColumn("x", F.get("s", F.col("at"))).withColumn("rest", rest)
        if here.isEmpty():
            break
        by = here.groupBy("host", "t", "x").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")), F.min("rest").alias("low"), F.max("rest").alias("high"))
        branch = by.groupBy("host", "t").agg(F.count(F.lit(1)).alias("kinds"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "good", "bad")))
        one, all_ = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
        others = all_ - one
        pooled = F.try_divide("all_bad", all_)
        gap = F.abs(F.try_divide("bad", one) - F.try_divide(F.col("all_bad") - F.col("bad"), others))
        differs = gap > z * F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), one) + F.try_divide(F.lit(1), others)))  # null without labels on both sides
        untold = (F.col("kinds") >= many) & (F.col("n") < rare * F.col("all_n")) & (one < few)  # rare, with too few labels for the test
        wild = (F.col("x") == "*") | untold | ((F.col("kinds") > 1) & ~F.coalesce(differs, F.lit(False)))
        # below a segment that merges with no other, what all paths share has one kind at each level: it is taken at once
        alone = ~wild | (F.col("kinds") == 1)
        same = F.array_position(F.transform(F.arrays_zip("low", "high"), lambda p: F.coalesce(p.low == p.high, F.lit(False))), False) - 1
        shared = F.when(alone, F.when(same < 0, F.size("low")).otherwise(same).cast("int")).otherwise(0)
        step = by.join(branch, ["host", "t"]).withColumn("shared", shared)
        tail = F.when(F.col("shared") > 0, F.concat(F.lit("/"), F.array_join(F.slice("low", F.lit(1), F.col("shared")), "/"))).otherwise("")
        step = step.select("host", "t", "x", F.concat(F.lit("/"), F.when(wild, "*").otherwise(F.col("x")), tail).alias("g"), "shared")
        active = here.join(step, ["host", "t", "x"]).withColumn("t", F.concat("t", "g")).withColumn("at", F.col("at") + 1 + F.col("shared"))
        active = written(active.select(*columns), "shapes")
    shapes = written(done, "templates")
    counts = shapes.groupBy("host", "t").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return flag.select("page_id", "host", "path", "s"), shapes.select("host", "s", "t").join(counts, ["host", "t"])


def templates(pages: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(page_id, host, path, template, good, bad): each page with its final template; arguments as for grown()."""
    flag, known = grown(pages, labels, **how)
    return flag.join(known, ["host", "s"]).select("page_id", "host", "path", F.col("t").alias("template"), "good", "bad")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, purity: float = 0.5, prior: float = 20.0, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of `pages` (page_id, url; others ignored).

    `labels` (page_id, bad). Null page ids match no label; repeated pages count as often as they
    stand; pages without a path have the empty template. Without any labels everything the rules
    leave is allowed. An empty table gives no rows.
    """
    host, path = split(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    flag, known = grown(parts, labels, **how)
    sums = lambda df: df.agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    each = known.select("host", "t", "good", "bad").distinct()
    total = sums(each).select(((F.coalesce("g", F.lit(0)) + 1) / (F.coalesce("g", F.lit(0)) + F.coalesce("b", F.lit(0)) + 1)).alias("corpus"))
    total = float((total.first() or [1.0])[0])
    hosts = sums(each.groupBy("host")).select("host", ((F.col("g") + prior * total) / (F.col("g") + F.col("b") + prior)).alias("host_purity"))
    # purity is settled by shape, so pages meet it by host and shape, never by host alone
    known = known.join(hosts, "host").select("host", "s", F.col("t").alias("template"), ((F.col("good") + prior * F.col("host_purity")) / (F.col("good") + F.col("bad") + prior)).alias("purity"))
    out = flag.join(known, ["host", "s"])
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")


def query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages carry the labels of the documents of the same number: bad if toxic or of low quality."""
    bad = labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return judge(pages, bad).select("page_id", "host", "path", "rule", "verdict", "template")
