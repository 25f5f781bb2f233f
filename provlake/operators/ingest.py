"""Ingest of candidates as relational steps: gate, resume, fetch result, exact dedup, budget.

Candidates have seq (a total order), remote_url, licence, sha256 and size of the fetched bytes,
and failure (null if the fetch went well). What is known before is (remote_url, status, sha256).
Licence, bytes and failure are taken to depend on the url alone within a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import accepted, normalise_licence
from ..schema import TERMINAL
from .ordered import with_prefix


def licence_gate(candidates: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates free to use, with their canonical licence."""
    return candidates.withColumn("canonical", normalise_licence(F.col("licence"), strict)).where("canonical is not null")


def quarantined(candidates: DataFrame, strict: bool = False) -> DataFrame:
    return candidates.where(~accepted(F.col("licence"), strict))


def resumed(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with the status under which their url is known, and whether that ends the matter."""
    prior = known.select("remote_url", F.col("status").alias("prior_status"))
    return candidates.join(prior, "remote_url", "left").withColumn("skip", F.coalesce(F.col("prior_status").isin(*TERMINAL), F.lit(False)))


def classified(candidates: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """Each candidate's outcome but for the budget: skipped, quarantined, failed, duplicate or complete.

    A candidate without `seq` has no place in the order and is an error.
    """
    kind = candidates.schema["seq"].dataType
    candidates = candidates.withColumn("seq", F.coalesce("seq", F.raise_error(F.lit("a candidate without seq")).cast(kind)))
    rows = resumed(candidates, known).withColumn("turn", F.row_number().over(Window.partitionBy("remote_url").orderBy("seq")))
    kind = (
        F.when(F.col("skip"), "skipped")
        .when(~accepted(F.col("licence"), strict), F.when(F.col("turn") == 1, "quarantined").otherwise("skipped"))
        .when(F.col("failure").isNotNull(), "failed")
        .when(F.col("turn") > 1, "skipped")
        .otherwise("live")
    )
    rows = rows.withColumn("kind", kind)
    # a hash is a duplicate's if a row of another url has it, whatever that row's status
    held = known.where("sha256 is not null").groupBy("sha256").agg(F.min("remote_url").alias("low"), F.max("remote_url").alias("high"))
    rows = rows.join(held, "sha256", "left").withColumn("held", F.coalesce((F.col("low") != F.col("remote_url")) | (F.col("high") != F.col("remote_url")), F.lit(False)))
    # the first live row of a hash, found by aggregation: one hash may have any number of rows
    live = (F.col("kind") == "live") & ~F.col("held")
    firsts = rows.where(live).groupBy("sha256").agg(F.min("seq").alias("first_seq"))
    rows = rows.join(firsts, "sha256", "left")
    status = F.when(F.col("kind") != "live", F.col("kind")).when(F.col("held") | (F.col("seq") > F.col("first_seq")), "duplicate").otherwise("complete")
    return rows.withColumn("outcome", status).select(*candidates.columns, "prior_status", "outcome")


def outcomes(candidates: DataFrame, known: DataFrame, pool_bytes: int = 0, cap: int = 0, strict: bool = False) -> DataFrame:
    """What one run does: candidates up to where the budget stops it, with outcome and pool size after each.

    With `cap` 0 nothing stops the run. A pool already above the cap stops it at the first
    candidate it would fetch, of which nothing is told; else the first that would push the pool
    above the cap becomes pending and is the last.
    """
    return budgeted(classified(candidates, known, strict), pool_bytes, cap, strict)


def budgeted(rows: DataFrame, pool_bytes: int = 0, cap: int = 0, strict: bool = False) -> DataFrame:
    """Classified candidates up to where the budget stops the run, with the pool's size after each; see `outcomes`."""
    if 0 < cap < pool_bytes:
        fetches = (accepted(F.col("licence"), strict) & (F.col("outcome") != "skipped")).cast("long")
        return with_prefix(rows, "seq", fetches, "_fetches").where("_fetches = 0").drop("_fetches").withColumn("pool", F.lit(pool_bytes).cast("long"))
    taken = F.coalesce(F.when(F.col("outcome") == "complete", F.col("size")), F.lit(0))
    rows = with_prefix(rows, "seq", taken, "pool").withColumn("pool", F.col("pool") + pool_bytes)
    if cap <= 0:
        return rows
    # the pool never shrinks, so the run has stopped before a row if the pool was above the cap before it
    prior, over = F.col("pool") - taken, F.col("pool") > cap
    rows = rows.where(prior <= cap).withColumn("_prior", prior)
    return rows.withColumn("outcome", F.when(over, "pending").otherwise(F.col("outcome"))).withColumn("pool", F.when(over, F.col("_prior")).otherwise(F.col("pool"))).drop("_prior")


def summary(done: DataFrame) -> DataFrame:
    """One row: a count for each outcome, and whether the budget stopped the run."""
    names = ("complete", "skipped", "duplicate", "quarantined", "failed")
    return done.agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in names), (F.count_if(F.col("outcome") == "pending") > 0).alias("budget_reached"))


def upsert_subjects(subjects: DataFrame, incoming: DataFrame, changed: bool = False, top: int | None = None) -> DataFrame:
    """Subjects with the incoming ones (seq, name, category, ...) merged by name and category; with `changed`, only those that came in.

    Of several incoming rows for a key the later non-null value wins, and any such value wins
    over the old one; new keys are numbered after the largest id (`top`, if it is known) in the order of their first row.
    """
    from .ordered import with_ids

    details = ["wikidata_id", "birth_year", "death_year", "occupation"]
    late = incoming.groupBy("name", "category").agg(F.min("seq").alias("seq"), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in details))
    merged = subjects.join(late, ["name", "category"], "inner" if changed else "left").select("id", "name", "category", *(F.coalesce(f"new_{c}", c).alias(c) for c in details))
    top = subjects.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top is None else top
    added = with_ids(late.join(subjects, ["name", "category"], "left_anti"), "seq", top).select("id", "name", "category", *(F.col(f"new_{c}").alias(c) for c in details))
    return merged.unionByName(added)


def latest_status(log: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The last status of each key in a log of changes."""
    return log.groupBy(key).agg(F.max_by(F.col(status), F.struct(*order)).alias(status))


def migrate_legacy(people: DataFrame, photographs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the older layout (people; photographs by person_id, no categories) in the present one."""
    from ..schema import DEFAULT_CATEGORY, PHOTOGRAPHS, SUBJECTS

    def shaped(df: DataFrame, schema) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    subjects = people if "category" in people.columns else people.withColumn("category", F.lit(DEFAULT_CATEGORY))
    photos = photographs.withColumnRenamed("person_id", "subject_id")
    photos = photos if "category" in photos.columns else photos.withColumn("category", F.lit(DEFAULT_CATEGORY))
    return shaped(subjects, SUBJECTS), shaped(photos, PHOTOGRAPHS)
