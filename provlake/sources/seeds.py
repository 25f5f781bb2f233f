"""Curated subjects, packaged or from a file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_category, search_query, slugify
from ..schema import CATEGORIES

_FIELDS = "seq int, name string, category string, search string, aliases array<string>, wikidata_id string, birth_year int, death_year int, occupation string"


def _parsed(path: Path, argument: str) -> list[dict]:
    import yaml

    raw = yaml.safe_load(path.read_text()) or {}
    whole = raw.get("category") if isinstance(raw, dict) else None
    entries = raw.get("subjects", []) if isinstance(raw, dict) else raw
    return [e | {"category": e.get("category") or whole or argument} for e in entries]


def load_subjects(spark: SparkSession, category: str | None = None, from_wikidata: bool = False, seed_path: str | None = None, limit: int | None = None) -> DataFrame:
    """Seed subjects in their fixed order (seq), with their folder name and search query.

    An entry's own category comes before its file's, that before the argument.
    """
    if from_wikidata:
        raise NotImplementedError("only curated seeds can be loaded")
    here = Path(__file__).parent / "seeds"
    if seed_path is not None:
        entries = _parsed(Path(seed_path), category or CATEGORIES[0])
    else:
        wanted = [category.strip().lower() or CATEGORIES[0]] if category is not None else CATEGORIES
        entries = [e for c in wanted for e in _parsed(here / f"{c}.yaml", c)]
    names = [f.split()[0] for f in _FIELDS.split(", ")][1:]
    rows = [(i, *(e.get(n) for n in names)) for i, e in enumerate(entries)]
    return prepared(spark.createDataFrame(rows, _FIELDS), limit)


def prepared(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Seed entries (seq, name, category, search, ...) from any table, with their folder name and search query; the first `limit` by seq."""
    out = entries.withColumn("category", normalise_category(F.col("category")))
    out = out.withColumn("folder", slugify(F.col("name"))).withColumn("query", search_query(F.col("search"), F.col("name")))
    return out if limit is None else out.orderBy("seq").limit(limit)
