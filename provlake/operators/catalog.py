"""Reads of the catalogue: scans, lookups, filtered lists and pages, counts and statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_label, normalise_category
from ..schema import DEFAULT_CATEGORY, GROUP_COLUMNS, PAGE_MAX, WIRE


def photo_scan(photos: DataFrame, subjects: DataFrame) -> DataFrame:
    """Photographs with their subject's name; rows without a subject are left out."""
    named = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    return photos.join(named, "subject_id").select(*photos.columns, "subject")


def predicate(status: str | None = None, source: str | None = None, licences: Iterable[str] | None = None, subject: str | None = None, category: str | None = None) -> Column:
    """All given conditions at once; an empty argument sets none. Only the category is normalised."""
    parts = []
    if status:
        parts.append(F.col("status") == status)
    if source:
        parts.append(F.col("source") == source)
    if licences:
        parts.append(F.col("licence").isin(list(licences)))
    if category:
        parts.append(F.col("category") == (category.strip().lower() or DEFAULT_CATEGORY))
    if subject:
        parts.append(F.col("subject") == subject)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def list_photographs(photos: DataFrame, subjects: DataFrame, status: str | None = "complete", limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """The matching photographs by category, subject and id; the offset counts only with a limit."""
    found = photo_scan(photos, subjects).where(predicate(status=status, **filters)).orderBy("category", "subject", "id")
    return found if limit is None else found.offset(offset).limit(limit)


def count_photographs(photos: DataFrame, subjects: DataFrame, status: str | None = "complete", **filters) -> DataFrame:
    return photo_scan(photos, subjects).where(predicate(status=status, **filters)).agg(F.count(F.lit(1)).alias("n"))


def page(photos: DataFrame, subjects: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    """One page as clients see it."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MAX}, offset 0 or more")
    return list_photographs(photos, subjects, limit=limit, offset=offset, **filters).select(*WIRE)


def by_key(photos: DataFrame, subjects: DataFrame, column: str, value) -> DataFrame:
    """Lookup by id, remote_url or sha256, whatever the status."""
    return photo_scan(photos, subjects).where(F.col(column) == value).limit(1)


def subject_name(subjects: DataFrame, subject_id: int) -> DataFrame:
    return subjects.where(F.col("id") == subject_id).select("name")


def subjects_with_counts(photos: DataFrame, subjects: DataFrame, category: str | None = None) -> DataFrame:
    """Each subject with its number of complete photographs, none included.

    Photographs are counted by subject before the join, so that a subject with most of them
    meets the subjects as one row.
    """
    if category:
        subjects = subjects.where(F.col("category") == (category.strip().lower() or DEFAULT_CATEGORY))
    done = photos.where("status = 'complete'").groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = subjects.join(done, "id", "left")
    return out.select(F.col("name").alias("folder"), "category", F.coalesce("n", F.lit(0)).alias("photo_count")).orderBy("category", "folder")


def total_bytes(photos: DataFrame, only_complete: bool = True) -> DataFrame:
    return (photos.where("status = 'complete'") if only_complete else photos).agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"))


def counts_by(photos: DataFrame, column: str, only_complete: bool = True) -> DataFrame:
    """(k, n); null and empty keys count together as `?`."""
    if column not in GROUP_COLUMNS:
        raise ValueError(f"unsupported group column: {column}")
    found = photos.where("status = 'complete'") if only_complete else photos
    return found.groupBy(group_label(F.col(column)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def stats(photos: DataFrame, subjects: DataFrame) -> DataFrame:
    """(section, k, n): all statistics from one scan of the photographs. Status counts take all rows, other groups the complete ones."""
    done = F.col("status") == "complete"
    keys = [group_label(F.col(c)).alias(c) for c in GROUP_COLUMNS]
    # the few combinations first, so that grouping sets multiply these and not the rows
    cells = photos.select(*keys, done.alias("done"), "file_size").groupBy(*GROUP_COLUMNS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("done").alias("n_done"), F.sum(F.when(F.col("done"), F.col("file_size"))).alias("bytes"))
    sets = cells.groupingSets([[F.col(c)] for c in GROUP_COLUMNS], *(F.col(c) for c in GROUP_COLUMNS)).agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("n_done").alias("n_done"), F.sum("bytes").alias("bytes"))
    bit = {c: (1 << len(GROUP_COLUMNS)) - 1 - (1 << (len(GROUP_COLUMNS) - 1 - i)) for i, c in enumerate(GROUP_COLUMNS)}
    section, value = F.lit(None).cast("string"), F.col("n_done")
    for c, g in bit.items():
        section = F.when(F.col("g") == g, f"by_{c}").otherwise(section)
    value = F.when(F.col("g") == bit["status"], F.col("n")).otherwise(value)
    groups = sets.select(section.alias("section"), F.coalesce(*GROUP_COLUMNS).alias("k"), value.alias("n")).where("n > 0")
    sums = sets.where(F.col("g") == bit["status"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    whole = sums.select(F.explode(F.array(
        F.struct(F.lit("photographs").alias("section"), F.lit("").alias("k"), F.col("n").alias("n")),
        F.struct(F.lit("total_bytes").alias("section"), F.lit("").alias("k"), F.col("bytes").alias("n")))).alias("r")).select("r.*")
    known = subjects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("subjects").alias("section"), F.lit("").alias("k"), "n")
    return groups.union(whole).union(known)


def orphans(photos: DataFrame, subjects: DataFrame) -> DataFrame:
    """Photographs without a subject, which lists leave out but statistics count."""
    return photos.join(subjects.select(F.col("id").alias("subject_id")), "subject_id", "left_anti")


def wire_json(photos: DataFrame) -> DataFrame:
    return photos.select("id", F.to_json(F.struct(*WIRE), {"ignoreNullFields": "false"}).alias("json"))


def normalised(subjects: DataFrame) -> DataFrame:
    return subjects.withColumn("category", normalise_category(F.col("category")))
