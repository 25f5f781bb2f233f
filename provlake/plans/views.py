"""The catalogue's shapes over the test tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import accepted, normalise_licence, pool_filename

# Ten raw labels, picked by number modulo ten.
LABELS = ["CC0", "CC0 1.0", "Public domain", "PD-US", "PD-Art (PD-old-100)", "No known copyright restrictions", "CC BY-SA 4.0", "All rights reserved", "", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), (number % 10).cast("int"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    category = F.when(segment == "HOUSEHOLD", "identity").when(segment == "FURNITURE", "wardrobe").when(segment == "BUILDING", "setting").otherwise("concept")
    none = [F.lit(None).cast(t).alias(n) for n, t in [("wikidata_id", "string"), ("birth_year", "int"), ("death_year", "int"), ("occupation", "string")]]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"), category.alias("category"), *none)


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = subjects(spark, sf_dir).select(F.col("id").alias("subject_id"), "category", F.col("name").alias("_subject"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "subject_id").join(who, "subject_id")
    key = F.col("o_orderkey")
    raw, third = label(key), key % 3
    status = (
        F.when(~F.coalesce(accepted(raw), F.lit(False)), "quarantined").when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending")
        .when(third == 0, "downloading").when(third == 1, "failed").otherwise("duplicate")
    )
    o = o.withColumn("status", status).withColumn("source", F.when(third == 0, "commons").when(third == 1, "loc").otherwise("smithsonian")).withColumn("year", F.year("o_orderdate"))
    done = F.col("status") == "complete"
    o = o.withColumn("sha256", F.when(done, F.sha2(key.cast("string").cast("binary"), 256)))
    url = F.concat(F.lit("https://archive.example/"), key, F.lit(".jpg"))
    null = lambda t: F.lit(None).cast(t)
    return o.select(
        key.alias("id"), "subject_id", "category", F.concat(F.lit("Photo "), "year").alias("title"), null("string").alias("photographer"), "year", "source", url.alias("source_url"),
        F.coalesce(normalise_licence(raw), raw).alias("licence"), null("string").alias("attribution"), null("int").alias("width"), null("int").alias("height"),
        F.when(done, F.floor("o_totalprice").cast("long")).alias("file_size"), F.when(done, pool_filename(F.col("_subject"), F.col("year"), F.col("source"), F.col("sha256"), F.lit(".jpg"))).alias("filename"),
        "sha256", null("string").alias("phash"), url.alias("remote_url"), "status", null("string").alias("downloaded_at"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates; every eleventh is met a second time, later on."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    ext = F.get(F.array(*map(F.lit, [".jpg", ".PNG", ".webp", ".jpeg?w=1"])), (key % 4).cast("int"))
    category = F.when(F.col("lang") == "en", "identity").when(F.col("lang") == "fr", "wardrobe").when(F.col("lang") == "de", "setting").otherwise("concept")
    rows = d.select(
        key.alias("seq"), F.concat(F.lit("https://archive.example/"), "source", F.lit("/"), key, ext).alias("remote_url"), "source", category.alias("category"),
        F.coalesce(label(key), F.lit("unknown")).alias("licence"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").alias("size"),
        F.when(key % 13 == 5, "timeout").alias("failure"))
    return rows.union(rows.where("seq % 11 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run left of every seventh candidate."""
    key = F.col("seq")
    status = F.get(F.array(*map(F.lit, ["complete", "duplicate", "quarantined", "failed", "pending"])), (key % 5).cast("int"))
    rows = candidates(spark, sf_dir).where("seq % 7 = 0 and seq < 1000000000").select("remote_url", status.alias("status"), "sha256")
    return rows.withColumn("sha256", F.when(F.col("status").isin("complete", "failed"), F.col("sha256")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool listing: every fifth file is missing, some are corrupt, some hold other bytes."""
    from ..operators.catalog import photo_scan
    from ..operators.pool import pool_path

    p = pool_path(photo_scan(photographs(spark, sf_dir), subjects(spark, sf_dir))).where("id % 5 <> 0")
    return p.select("path", F.when(F.col("id") % 7 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), (F.col("id") % 11 == 0).alias("corrupt"))


def _accepted(raw: str) -> str:
    marks = ["cc0", "pd", "public domain", "publicdomain", "no known copyright", "no copyright", "creative commons zero"]
    return "(" + " OR ".join(f"contains(lower(coalesce({raw}, '')), '{m}')" for m in marks) + ")"


def norm_sql(raw: str) -> str:
    return f"CASE WHEN contains(lower({raw}), 'cc0') OR contains(lower({raw}), 'creative commons zero') THEN 'CC0' WHEN {_accepted(raw)} THEN 'PD' END"


def _label_sql(key: str) -> str:
    items = ", ".join("NULL" if x is None else f"'{x}'" for x in LABELS)
    return f"([{items}])[CAST({key} % 10 AS INT) + 1]"


SQL = f"""
WITH v_subjects AS (
  SELECT c_custkey AS id, replace(c_name, '#', '_') AS name,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'identity' WHEN 'FURNITURE' THEN 'wardrobe' WHEN 'BUILDING' THEN 'setting' ELSE 'concept' END AS category
  FROM customer),
_orders AS (
  SELECT o_orderkey AS id, o_custkey AS subject_id, s.category, s.name AS subject, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INT) AS year,
    {_label_sql('o_orderkey')} AS raw, ['commons', 'loc', 'smithsonian'][CAST(o_orderkey % 3 AS INT) + 1] AS source
  FROM orders JOIN v_subjects s ON s.id = o_custkey),
_judged AS (
  SELECT *, CASE WHEN NOT {_accepted('raw')} THEN 'quarantined' WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'pending'
    WHEN id % 3 = 0 THEN 'downloading' WHEN id % 3 = 1 THEN 'failed' ELSE 'duplicate' END AS status FROM _orders),
v_photographs AS (
  SELECT id, subject_id, category, subject, 'Photo ' || year AS title, CAST(NULL AS VARCHAR) AS photographer, year, source, 'https://archive.example/' || id || '.jpg' AS source_url,
    coalesce({norm_sql('raw')}, raw) AS licence, CAST(NULL AS VARCHAR) AS attribution, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height,
    CASE WHEN status = 'complete' THEN CAST(floor(o_totalprice) AS BIGINT) END AS file_size,
    CASE WHEN status = 'complete' THEN lower(subject) || '_' || year || '_' || source || '_' || substr(sha256(CAST(id AS VARCHAR)), 1, 8) || '.jpg' END AS filename,
    CASE WHEN status = 'complete' THEN sha256(CAST(id AS VARCHAR)) END AS sha256, CAST(NULL AS VARCHAR) AS phash,
    'https://archive.example/' || id || '.jpg' AS remote_url, status, CAST(NULL AS VARCHAR) AS downloaded_at
  FROM _judged),
_first AS (
  SELECT doc_id AS seq, 'https://archive.example/' || source || '/' || doc_id || ['.jpg', '.PNG', '.webp', '.jpeg?w=1'][CAST(doc_id % 4 AS INT) + 1] AS remote_url, source,
    CASE lang WHEN 'en' THEN 'identity' WHEN 'fr' THEN 'wardrobe' WHEN 'de' THEN 'setting' ELSE 'concept' END AS category,
    coalesce({_label_sql('doc_id')}, 'unknown') AS licence, sha256(text) AS sha256, n_chars AS size, CASE WHEN doc_id % 13 = 5 THEN 'timeout' END AS failure
  FROM documents),
v_candidates AS (
  SELECT * FROM _first UNION ALL SELECT seq + 1000000000, remote_url, source, category, licence, sha256, size, failure FROM _first WHERE seq % 11 = 0),
v_known AS (
  SELECT remote_url, status, CASE WHEN status IN ('complete', 'failed') THEN sha256 END AS sha256
  FROM (SELECT *, ['complete', 'duplicate', 'quarantined', 'failed', 'pending'][CAST(seq % 5 AS INT) + 1] AS status FROM _first WHERE seq % 7 = 0)),
_paths AS (SELECT *, category || '/' || subject || '/' || filename AS path FROM v_photographs WHERE status = 'complete' AND coalesce(filename, '') <> ''),
v_files AS (SELECT path, CASE WHEN id % 7 = 0 THEN '0' ELSE sha256 END AS sha256, id % 11 = 0 AS corrupt FROM _paths WHERE id % 5 <> 0)
"""


def outcomes_sql(pool: int, cap: int) -> str:
    """Common table expressions ending in `outcomes` (all columns of v_candidates, outcome, pool)."""
    return f"""{SQL},
_seen AS (SELECT c.*, k.status AS prior_status, row_number() OVER (PARTITION BY c.remote_url ORDER BY seq) AS turn,
    EXISTS (SELECT 1 FROM v_known o WHERE o.sha256 = c.sha256 AND o.remote_url <> c.remote_url) AS held
  FROM v_candidates c LEFT JOIN v_known k USING (remote_url)),
_kinds AS (SELECT *, CASE WHEN prior_status IN ('complete', 'duplicate', 'quarantined') THEN 'skipped'
    WHEN NOT {_accepted('licence')} THEN CASE WHEN turn = 1 THEN 'quarantined' ELSE 'skipped' END
    WHEN failure IS NOT NULL THEN 'failed' WHEN turn > 1 THEN 'skipped' ELSE 'live' END AS kind FROM _seen),
_ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, held, sha256 ORDER BY seq) AS rn FROM _kinds),
_status AS (SELECT *, CASE WHEN kind <> 'live' THEN kind WHEN held OR rn > 1 THEN 'duplicate' ELSE 'complete' END AS outcome0 FROM _ranked),
_sums AS (SELECT *, {pool} + sum(CASE WHEN outcome0 = 'complete' THEN size ELSE 0 END) OVER (ORDER BY seq) AS pool0 FROM _status),
_stop AS (SELECT min(seq) AS stop FROM _sums WHERE {cap} > 0 AND CASE WHEN {pool} > {cap} THEN {_accepted('licence')} AND outcome0 <> 'skipped' ELSE outcome0 = 'complete' AND pool0 > {cap} END),
outcomes AS (SELECT s.*, CASE WHEN seq = stop THEN 'pending' ELSE outcome0 END AS outcome, CAST(CASE WHEN seq = stop THEN pool0 - size ELSE pool0 END AS BIGINT) AS pool
  FROM _sums s, _stop WHERE stop IS NULL OR seq < stop OR (seq = stop AND NOT {pool} > {cap}))
"""
