"""Command line over a snapshot store: ingest, list, stats, subjects, verify, export."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .acquire import acquire
from .operators import catalog, pool, publication
from .operators.digests import Digests, stamps
from .schema import PHOTOGRAPHS, SUBJECTS
from .sources import archive, seeds
from .state import Store
from .streaming.ingest import ingest_batch


def split_csv(value: str | None) -> list[str] | None:
    return [v.strip() for v in value.split(",") if v.strip()] if value else None


def max_total_bytes(env: dict[str, str]) -> int:
    """The pool's ceiling: 40 GiB, or PROVLAKE_MAX_GB; 0 is no ceiling."""
    given = env.get("PROVLAKE_MAX_GB", "").strip()
    return int(float(given or 40) * 1024**3)


def _show(df: DataFrame, limit: int, out) -> None:
    for row in df.limit(limit).collect():
        print("\t".join("-" if x is None else str(x) for x in row), file=out)


def _reader(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    store = Store(spark, root)
    if store.version() is None:
        return spark.createDataFrame([], PHOTOGRAPHS), spark.createDataFrame([], SUBJECTS)
    version = store.version()
    return store.read("photographs", version), store.read("subjects", version)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provlake")
    p.add_argument("--home", default=os.environ.get("PROVLAKE_HOME", "./provlake-home"))
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("fetch", help="ingest candidates, with their fetch results, from Parquet")
    run.add_argument("candidates")
    live = sub.add_parser("run", help="search, fetch, ingest and land")
    live.add_argument("--search-url", required=True)
    live.add_argument("--source", default="commons")
    live.add_argument("--category")
    live.add_argument("--limit", type=int, default=archive.SEARCH_MAX)
    plan = sub.add_parser("plan", help="show what would be searched")
    plan.add_argument("--sources", default=",".join(archive.SOURCES))
    plan.add_argument("--category")
    for name in ("list", "export"):
        c = sub.add_parser(name)
        c.add_argument("--licence")
        c.add_argument("--subject")
        c.add_argument("--category")
        if name == "list":
            c.add_argument("--status", default="complete")
            c.add_argument("--source")
            c.add_argument("--limit", type=int, default=50)
        else:
            c.add_argument("--dest", default=os.environ.get("DATASET_DIR", "./data"))
            c.add_argument("--mode", choices=["symlink", "copy"], default="symlink")
    sub.add_parser("stats")
    check = sub.add_parser("verify")
    check.add_argument("--repair", action="store_true")
    check.add_argument("--max-age", type=float, default=30 * 24 * 3600.0, help="seconds after which a file is read again though it looks unchanged")
    sub.add_parser("subjects").add_argument("--category")
    sub.add_parser("curated", help="the seed subjects with what is known of them").add_argument("--category")
    old = sub.add_parser("migrate", help="take over tables and files of the older layout")
    old.add_argument("people")
    old.add_argument("photographs")
    gone = sub.add_parser("expire", help="remove old versions")
    gone.add_argument("--age", type=float, default=7 * 24 * 3600.0, help="seconds")
    gone.add_argument("--keep", type=int, default=1)
    sub.add_parser("people", help=argparse.SUPPRESS)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args = parser().parse_args(argv)
    out = out or sys.stdout
    spark = spark or SparkSession.builder.appName("provlake").getOrCreate()
    root, images = f"{args.home}/metadata", f"{args.home}/images"
    photos, subjects = _reader(spark, root)
    if args.command == "fetch":
        done = ingest_batch(Store(spark, root), spark.read.parquet(args.candidates), max_total_bytes(dict(os.environ)))
        _show(done.groupBy("outcome").count().orderBy("outcome"), 10, out)
    elif args.command == "run":
        done = acquire(spark, args.home, args.search_url, args.source, args.category, args.limit, max_total_bytes(dict(os.environ)))
        _show(done.groupBy("outcome").count().orderBy("outcome"), 10, out)
    elif args.command == "plan":
        found = seeds.load_subjects(spark, category=args.category).select("seq", F.col("folder").alias("name"), "category")
        _show(archive.harvest_plan(split_csv(args.sources) or [], found).orderBy("seq"), 1000, out)
    elif args.command == "list":
        filters = {"status": args.status, "source": args.source, "licences": split_csv(args.licence), "subject": args.subject, "category": args.category}
        print(f"{catalog.count_photographs(photos, subjects, **filters).first().n} photographs", file=out)
        _show(catalog.list_photographs(photos, subjects, limit=args.limit, **filters).select("id", "category", "subject", F.coalesce(F.col("year").cast("string"), F.lit("----")), "licence", "status", "filename"), args.limit, out)
    elif args.command == "export":
        scan = catalog.photo_scan(photos, subjects).where(catalog.predicate(licences=split_csv(args.licence), subject=args.subject, category=args.category))
        result = publication.published(pool.manifest(scan, stamps(spark, images), args.dest), images, args.dest, args.mode)
        print(" ".join(f"{k}={v}" for k, v in result.items()), file=out)
    elif args.command == "stats":
        _show(catalog.stats(photos, subjects).orderBy("section", F.desc("n"), "k"), 1000, out)
    elif args.command == "verify":
        verdicts = pool.verified(catalog.photo_scan(photos, subjects), Digests(spark, f"{root}/digests").refresh(images, args.max_age))
        print(" ".join(f"{k}={v}" for k, v in pool.verify_summary(verdicts).first().asDict().items()), file=out)
        if args.repair:
            Store(spark, root).commit(subjects, pool.repaired(photos, verdicts))
    elif args.command == "curated":
        found = seeds.load_subjects(spark, category=args.category)
        known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
        years = F.when(F.coalesce("birth_year", "death_year").isNull(), "?").otherwise(F.concat(known("birth_year"), F.lit("-"), known("death_year")))
        _show(found.orderBy("seq").select("folder", "category", years, known("occupation"), "query"), 100_000, out)
    elif args.command == "migrate":
        moved = pool.migrated(Store(spark, root), spark.read.parquet(args.people), spark.read.parquet(args.photographs), images)
        print(f"moved={moved.where('moved').count()}", file=out)
    elif args.command == "expire":
        print(f"removed={len(Store(spark, root).expire(args.age, args.keep))}", file=out)
    else:
        category = "identity" if args.command == "people" else args.category
        _show(catalog.subjects_with_counts(photos, subjects, category=category), 100_000, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
