"""The registered queries of the catalogue, each with the SQL that DuckDB holds it against."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, digests, ingest, ordered, pool
from ..operators.pages import Listing
from ..sources import archive, seeds
from ..state import Store
from ..streaming.ingest import ingest_batch
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Budgets that stop a run on any of the test tables.
CAP, POOL = 600_000, 700_000


def _query(name: str, sql: str | None = None, prelude: str = v.SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"{prelude} {sql}"
        return f

    return add


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return v.photographs(spark, d), v.subjects(spark, d)


_ALL = "SELECT id, subject_id, category, title, photographer, year, source, source_url, licence, attribution, width, height, file_size, filename, sha256, phash, remote_url, status, downloaded_at, subject FROM v_photographs"
_BRIEF = "SELECT id, category, subject, source, licence, status, file_size FROM v_photographs"


def _brief(df: DataFrame) -> DataFrame:
    return df.select("id", "category", "subject", "source", "licence", "status", "file_size")


_query("photo_scan", _ALL)(lambda s, d: catalog.photo_scan(*_both(s, d)))
_query("ready_probe", f"{_ALL} ORDER BY id LIMIT 1")(lambda s, d: catalog.photo_scan(*_both(s, d)).orderBy("id").limit(1))
_query("lookup_remote_url", f"{_ALL} WHERE remote_url = 'https://archive.example/5.jpg'")(lambda s, d: catalog.by_key(*_both(s, d), "remote_url", "https://archive.example/5.jpg"))
_query("lookup_sha256", f"{_ALL} WHERE sha256 = sha256('1')")(lambda s, d: catalog.by_key(*_both(s, d), "sha256", "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"))
_query("photo_by_id", f"{_ALL} WHERE id = 3")(lambda s, d: catalog.by_key(*_both(s, d), "id", 3))
_query("subject_name", "SELECT name FROM v_subjects WHERE id = 7")(lambda s, d: catalog.subject_name(v.subjects(s, d), 7))

_query("photos_by_status", f"{_BRIEF} WHERE status = 'failed'")(lambda s, d: _brief(catalog.list_photographs(*_both(s, d), status="failed")))
_query("photos_all_status", _BRIEF)(lambda s, d: _brief(catalog.list_photographs(*_both(s, d), status=None)))
_query("photos_ordered", f"{_BRIEF} WHERE status = 'complete' ORDER BY category, subject, id")(lambda s, d: _brief(catalog.list_photographs(*_both(s, d))))
_query("photos_by_source", f"{_BRIEF} WHERE status = 'complete' AND source = 'loc'")(lambda s, d: _brief(catalog.list_photographs(*_both(s, d), source="loc")))
_query("photos_by_licence", f"{_BRIEF} WHERE status = 'complete' AND licence IN ('CC0')")(lambda s, d: _brief(catalog.list_photographs(*_both(s, d), licences=["CC0"])))
_query("photos_by_category", f"{_BRIEF} WHERE status = 'complete' AND category = 'setting'")(lambda s, d: _brief(catalog.list_photographs(*_both(s, d), category=" Setting")))
_query("photos_by_subject", f"{_BRIEF} WHERE subject = (SELECT name FROM v_subjects WHERE id = 7) AND status = 'complete'")(
    lambda s, d: _brief(catalog.list_photographs(*_both(s, d), subject="Customer_000000007")))
_query("photos_filter_all", f"{_BRIEF} WHERE status = 'complete' AND source = 'commons' AND licence IN ('CC0', 'PD') AND category = 'identity'")(
    lambda s, d: _brief(catalog.list_photographs(*_both(s, d), source="commons", licences=["CC0", "PD"], category="IDENTITY")))
_PAGE = "SELECT id, subject, category, title, photographer, year, source, source_url, licence, attribution, width, height, file_size, filename, sha256, remote_url, status, downloaded_at FROM v_photographs"
_query("photos_page", f"{_PAGE} WHERE status = 'complete' ORDER BY category, subject, id LIMIT 100")(lambda s, d: catalog.page(*_both(s, d), limit=100))
_query("photos_page_2", f"{_PAGE} WHERE status = 'complete' AND category = 'setting' ORDER BY category, subject, id LIMIT 25 OFFSET 50")(lambda s, d: catalog.page(*_both(s, d), limit=25, offset=50, category="setting"))
_query("photo_wire", _PAGE)(lambda s, d: catalog.photo_scan(*_both(s, d)).select(*catalog.WIRE))
_query("photos_count", "SELECT count(*) AS n FROM v_photographs WHERE status = 'complete' AND source = 'loc'")(lambda s, d: catalog.count_photographs(*_both(s, d), source="loc"))
_query("list_top", f"{_BRIEF} WHERE status = 'complete' ORDER BY category, subject, id LIMIT 20")(lambda s, d: _brief(catalog.list_photographs(*_both(s, d), limit=20)))

_COUNTS = "SELECT s.name AS folder, s.category, count(CASE WHEN p.status = 'complete' THEN 1 END) AS photo_count FROM v_subjects s LEFT JOIN v_photographs p ON p.subject_id = s.id"
_query("subjects_counts", f"{_COUNTS} GROUP BY s.id, s.name, s.category")(lambda s, d: catalog.subjects_with_counts(*_both(s, d)))
_query("subjects_counts_category", f"{_COUNTS} WHERE s.category = 'wardrobe' GROUP BY s.id, s.name, s.category")(lambda s, d: catalog.subjects_with_counts(*_both(s, d), category="Wardrobe"))
_query("total_bytes", "SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes FROM v_photographs WHERE status = 'complete'")(lambda s, d: catalog.total_bytes(v.photographs(s, d)))
_query("total_bytes_all", "SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes FROM v_photographs")(lambda s, d: catalog.total_bytes(v.photographs(s, d), only_complete=False))
_query("total_gb", "SELECT CAST(sum(file_size) AS DOUBLE) / (1024.0 * 1024 * 1024) AS total_gb FROM v_photographs WHERE status = 'complete'")(
    lambda s, d: catalog.total_bytes(v.photographs(s, d)).select(T.gib(F.col("total_bytes").cast("double")).alias("total_gb")))
for _c in catalog.GROUP_COLUMNS:
    _where = "" if _c == "status" else "WHERE status = 'complete'"
    _query(f"counts_by_{_c}", f"SELECT coalesce(nullif({_c}, ''), '?') AS k, count(*) AS n FROM v_photographs {_where} GROUP BY 1")(
        lambda s, d, c=_c: catalog.counts_by(v.photographs(s, d), c, only_complete=c != "status"))
_STATS = " UNION ALL ".join(
    ["SELECT 'subjects' AS section, '' AS k, count(*) AS n FROM v_subjects", "SELECT 'photographs', '', count(*) FROM v_photographs",
     "SELECT 'total_bytes', '', CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM v_photographs WHERE status = 'complete'"]
    + [f"SELECT 'by_{c}', coalesce(nullif({c}, ''), '?'), count(*) FROM v_photographs {'' if c == 'status' else 'WHERE status = ' + chr(39) + 'complete' + chr(39)} GROUP BY 2" for c in catalog.GROUP_COLUMNS])
_query("stats_report", _STATS)(lambda s, d: catalog.stats(*_both(s, d)))
_query("stats_sorted", "SELECT coalesce(nullif(licence, ''), '?') AS k, count(*) AS n FROM v_photographs WHERE status = 'complete' GROUP BY 1 ORDER BY n DESC, k")(
    lambda s, d: catalog.counts_by(v.photographs(s, d), "licence").orderBy(F.desc("n"), "k"))

_query("licence_norm", f"SELECT seq, {v.norm_sql('licence')} AS licence FROM v_candidates")(lambda s, d: v.candidates(s, d).select("seq", T.normalise_licence(F.col("licence")).alias("licence")))
_query("licence_gate", f"SELECT seq, remote_url, {v.norm_sql('licence')} AS canonical FROM v_candidates WHERE {v._accepted('licence')}")(
    lambda s, d: ingest.licence_gate(v.candidates(s, d)).select("seq", "remote_url", "canonical"))
_query("quarantine", f"SELECT seq, remote_url, licence FROM v_candidates WHERE NOT {v._accepted('licence')}")(lambda s, d: ingest.quarantined(v.candidates(s, d)).select("seq", "remote_url", "licence"))
_query("category_norm", "SELECT c_custkey, CASE WHEN trim(s) = '' THEN 'identity' ELSE lower(trim(s)) END AS category FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END AS s FROM customer)")(
    lambda s, d: v.table(s, d, "customer").select("c_custkey", T.normalise_category(F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))).alias("category")))
_query("slugify", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM part")(
    lambda s, d: v.table(s, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug")))
_query("html_clean", "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS cleaned FROM pages")(
    lambda s, d: v.table(s, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("cleaned")))
_query("year_extract", "SELECT id, CAST(nullif(regexp_extract(title, '\\b(1[0-9]{3}|20[0-9]{2})\\b', 1), '') AS INT) AS year FROM v_photographs")(
    lambda s, d: v.photographs(s, d).select("id", T.extract_year(F.lit(None).cast("string"), F.col("title")).alias("year")))
_query("title_strip", "SELECT id, nullif(regexp_replace('File:' || title, '^File:', ''), '') AS title FROM v_photographs")(
    lambda s, d: v.photographs(s, d).select("id", T.without_file_prefix(F.concat(F.lit("File:"), "title")).alias("title")))
_EXT = "CASE WHEN lower(regexp_extract(split_part(remote_url, '?', 1), '[^/](\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png') THEN lower(regexp_extract(split_part(remote_url, '?', 1), '[^/](\\.[^./]+)$', 1)) ELSE '.jpg' END"
_query("ext_for", f"SELECT seq, {_EXT} AS ext FROM v_candidates")(lambda s, d: v.candidates(s, d).select("seq", T.extension(F.col("remote_url")).alias("ext")))
_query("cache_key", f"SELECT seq, source || '-' || sha1(remote_url) || {_EXT} AS key FROM v_candidates")(lambda s, d: v.candidates(s, d).select("seq", T.cache_key(F.col("source"), F.col("remote_url")).alias("key")))
_query("content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(lambda s, d: v.table(s, d, "documents").select("doc_id", T.content_sha256(F.col("text")).alias("sha256")))
_query("pool_filename", "SELECT id, filename FROM v_photographs WHERE status = 'complete'")(lambda s, d: v.photographs(s, d).where("status = 'complete'").select("id", "filename"))
_W, _H = "(o_orderkey % 9000 + 1)", "(o_orderkey % 7000 + 1)"
_OVER = f"CAST({_W} AS DOUBLE) * {_H} / 1e6"
_query("megapixel_cap", f"SELECT o_orderkey, CASE WHEN {_OVER} > 12.0 THEN greatest(1, CAST(floor({_W} * sqrt(12.0 / ({_OVER}))) AS INT)) ELSE CAST({_W} AS INT) END AS width, "
       f"CASE WHEN {_OVER} > 12.0 THEN greatest(1, CAST(floor({_H} * sqrt(12.0 / ({_OVER}))) AS INT)) ELSE CAST({_H} AS INT) END AS height FROM orders")(
    lambda s, d: v.table(s, d, "orders").select("o_orderkey", *(c.alias(n) for c, n in zip(T.capped_size(F.col("o_orderkey") % 9000 + 1, F.col("o_orderkey") % 7000 + 1, 12.0), ("width", "height")))))
_query("csv_split", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_brand || ' , ' || p_type || ',, ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")(
    lambda s, d: v.table(s, d, "part").select("p_partkey", F.array_join(T.split_csv(F.concat("p_brand", F.lit(" , "), "p_type", F.lit(",, "))), "|").alias("items")))

_SEEDS = "SELECT p_partkey AS seq, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 4 = 1 THEN 'Setting ' ELSE p_brand END AS raw, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN '' END AS search FROM part"
_SEEDS = f"SELECT *, CASE WHEN trim(raw) = '' THEN 'identity' ELSE lower(trim(raw)) END AS category, coalesce(nullif(trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS folder FROM ({_SEEDS})"


def _seeds(s: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    """Parts as seed entries: some without a category, some with a search of their own."""
    key = F.col("p_partkey")
    raw = F.when(key % 4 == 0, " ").when(key % 4 == 1, "Setting ").otherwise(F.col("p_brand"))
    search = F.when(key % 3 == 0, F.col("p_type")).when(key % 3 == 1, "")
    return seeds.prepared(v.table(s, d, "part").select(key.alias("seq"), F.col("p_name").alias("name"), raw.alias("category"), search.alias("search")), limit)


_query("seed_subjects", f"SELECT seq, name, category, folder FROM ({_SEEDS})", "")(lambda s, d: _seeds(s, d).select("seq", "name", "category", "folder"))
_query("seed_category", f"SELECT seq, name, category FROM ({_SEEDS}) WHERE category = 'setting'", "")(lambda s, d: _seeds(s, d).where("category = 'setting'").select("seq", "name", "category"))
_query("seed_union_limit", f"SELECT seq, name, category FROM ({_SEEDS}) ORDER BY seq LIMIT 5", "")(lambda s, d: _seeds(s, d, 5).select("seq", "name", "category"))
_query("seed_query", f"SELECT name, coalesce(nullif(search, ''), name) AS query FROM ({_SEEDS})", "")(lambda s, d: _seeds(s, d).select("name", "query"))

_query("harvest_plan", "SELECT r.i * (SELECT count(*) FROM v_subjects) + s.id AS seq, r.source, s.name AS subject, s.category FROM v_subjects s, (VALUES (0, 'commons'), (1, 'loc')) AS r(i, source)")(
    lambda s, d: archive.harvest_plan(["commons", "loc"], v.subjects(s, d).withColumn("seq", F.col("id"))))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Search responses made of the pages: two results for each, one of them no picture for every third."""
    p = v.table(spark, d, "pages")
    key = F.col("page_id")
    value = lambda c: F.struct(c.alias("value"))
    meta = F.create_map(F.lit("LicenseShortName"), value(F.when(key % 4 == 0, "").otherwise("CC0")), F.lit("UsageTerms"), value(F.lit(" Public domain ")),
                        F.lit("Artist"), value(F.when(key % 5 == 0, "<i></i>").otherwise(F.concat(F.lit("<b>Page</b> "), key))), F.lit("Credit"), value(F.lit("<a>Archive</a>")),
                        F.lit("DateTimeOriginal"), value(F.concat(F.lit("c. "), 1900 + key % 100)))

    def result(n: int, mime):
        info = F.struct(F.concat("url", F.lit(f"&n={n}")).alias("url"), F.when(key % 2 == 0, "").otherwise(F.col("url")).alias("descriptionurl"), mime.alias("mime"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit(100).alias("size"), meta.alias("extmetadata"))
        return F.struct(F.concat(F.lit(f"File:{n} of "), key).alias("title"), F.array(info).alias("imageinfo"))

    pages = F.create_map(F.concat(F.lit("a"), key), result(0, F.lit("image/jpeg")), F.concat(F.lit("b"), key), result(1, F.when(key % 3 == 0, "application/pdf").otherwise("image/png")))
    body = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    return p.select(F.lit("commons").alias("source"), F.concat(F.lit("Page_"), key).alias("subject"), F.lit("concept").alias("category"), body.alias("response"))


_HARVEST = """SELECT 'commons' AS source, 'Page_' || page_id AS subject, 'concept' AS category, pos, CAST(pos AS VARCHAR) || ' of ' || page_id AS title,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'Page ' || page_id END AS photographer, CAST(1900 + page_id % 100 AS INT) AS year, url || '&n=' || pos AS remote_url,
  CASE WHEN page_id % 2 = 0 THEN url || '&n=' || pos ELSE url END AS source_url, CASE WHEN page_id % 4 = 0 THEN 'Public domain' ELSE 'CC0' END AS licence,
  CASE WHEN page_id % 5 = 0 THEN 'Archive' ELSE 'Page ' || page_id END AS attribution, CAST(10 AS INT) AS width, CAST(10 AS INT) AS height
  FROM pages, (VALUES (0), (1)) AS t(pos) WHERE pos = 0 OR page_id % 3 <> 0"""
_query("harvest_parse", _HARVEST, "")(lambda s, d: archive.candidates(_responses(s, d)))
_query("harvest_topk", f"{_HARVEST} AND pos = 0", "")(lambda s, d: archive.candidates(_responses(s, d), limit=1))

_query("resume_skip", "SELECT seq, c.remote_url, k.status AS prior_status, coalesce(k.status IN ('complete', 'duplicate', 'quarantined'), false) AS skip FROM v_candidates c LEFT JOIN v_known k USING (remote_url)")(
    lambda s, d: ingest.resumed(v.candidates(s, d), v.known(s, d)).select("seq", "remote_url", "prior_status", "skip"))
_query("dedup_exact", "SELECT seq, remote_url, outcome FROM outcomes WHERE outcome IN ('duplicate', 'complete')", v.outcomes_sql(0, 0))(
    lambda s, d: ingest.classified(v.candidates(s, d), v.known(s, d)).where("outcome in ('duplicate', 'complete')").select("seq", "remote_url", "outcome"))
_query("ingest_outcomes", "SELECT seq, remote_url, outcome, pool FROM outcomes", v.outcomes_sql(0, 0))(lambda s, d: ingest.outcomes(v.candidates(s, d), v.known(s, d)).select("seq", "remote_url", "outcome", "pool"))
_query("budget_prefix", "SELECT seq, outcome, pool FROM outcomes", v.outcomes_sql(0, CAP))(lambda s, d: ingest.outcomes(v.candidates(s, d), v.known(s, d), cap=CAP).select("seq", "outcome", "pool"))
_query("budget_early_stop", "SELECT seq, outcome FROM outcomes", v.outcomes_sql(POOL, CAP))(lambda s, d: ingest.outcomes(v.candidates(s, d), v.known(s, d), POOL, CAP).select("seq", "outcome"))
_SUMMARY = ", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("complete", "skipped", "duplicate", "quarantined", "failed"))
_query("fetch_summary", f"SELECT {_SUMMARY}, count(*) FILTER (outcome = 'pending') > 0 AS budget_reached FROM outcomes", v.outcomes_sql(0, CAP))(
    lambda s, d: ingest.summary(ingest.outcomes(v.candidates(s, d), v.known(s, d), cap=CAP)))
_query("ingest_ids", "SELECT remote_url, 1000 + row_number() OVER (ORDER BY seq) AS id FROM v_candidates")(lambda s, d: ordered.with_ids(v.candidates(s, d), "seq", 1000).select("remote_url", "id"))
_query("status_latest", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", "")(
    lambda s, d: ingest.latest_status(v.table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type"))


def _incoming(s: SparkSession, d: str) -> DataFrame:
    """Subjects that come in: half of them known, with new details in some."""
    c = v.subjects(s, d).where("id % 2 = 0")
    return c.select(F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, F.col("name")).otherwise(F.concat("name", F.lit("_new"))).alias("name"), "category", F.when(F.col("id") % 8 == 0, F.concat(F.lit("Q"), "id")).alias("wikidata_id"),
                    F.when(F.col("id") % 3 == 0, 1900).alias("birth_year"), F.lit(None).cast("int").alias("death_year"), F.lit("painter").alias("occupation"))


_query("subject_upsert", """, incoming AS (SELECT id AS seq, CASE WHEN id % 4 = 0 THEN name ELSE name || '_new' END AS name, category, CASE WHEN id % 8 = 0 THEN 'Q' || id END AS wikidata_id,
    CASE WHEN id % 3 = 0 THEN 1900 END AS birth_year, 'painter' AS occupation FROM v_subjects WHERE id % 2 = 0)
  SELECT s.id, s.name, s.category, i.wikidata_id, i.birth_year, CAST(NULL AS INT) AS death_year, i.occupation FROM v_subjects s LEFT JOIN incoming i USING (name, category)
  UNION ALL SELECT (SELECT max(id) FROM v_subjects) + row_number() OVER (ORDER BY seq), name, category, wikidata_id, birth_year, NULL, occupation FROM incoming i
  WHERE NOT EXISTS (SELECT 1 FROM v_subjects s WHERE s.name = i.name AND s.category = i.category)""")(lambda s, d: ingest.upsert_subjects(v.subjects(s, d), _incoming(s, d)))


def _migrated(s: SparkSession, d: str) -> DataFrame:
    photos, subjects = _both(s, d)
    people = subjects.select("id", "name", "wikidata_id", "birth_year", "death_year", "occupation")
    old = photos.select("id", F.col("subject_id").alias("person_id"), "source", "source_url", "licence", "remote_url", "file_size", "filename", "sha256", "status")
    subjects, photos = ingest.migrate_legacy(people, old)
    return catalog.photo_scan(photos, subjects).select("id", "subject", "category", "source", "file_size", "status", "title")


_query("migrate_legacy", "SELECT id, subject, 'identity' AS category, source, file_size, status, CAST(NULL AS VARCHAR) AS title FROM v_photographs")(_migrated)

_query("export_manifest", "SELECT id, p.category, subject, path, '/data/' || path AS dst, f.path IS NOT NULL AS present FROM _paths p LEFT JOIN v_files f USING (path)")(
    lambda s, d: pool.manifest(catalog.photo_scan(*_both(s, d)), v.files(s, d), "/data"))
_query("export_summary", "SELECT count(*) FILTER (f.path IS NOT NULL) AS published, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (f.path IS NULL) AS missing, count(DISTINCT CASE WHEN f.path IS NOT NULL THEN p.category || '/' || subject END) AS subjects FROM _paths p LEFT JOIN v_files f USING (path)")(
    lambda s, d: pool.export_summary(pool.manifest(catalog.photo_scan(*_both(s, d)), v.files(s, d), "/data").select("category", "subject", F.when(F.col("present"), "published").otherwise("missing").alias("result"))))
_VERDICT = "SELECT id, p.path, CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN corrupt THEN 'corrupt' WHEN p.sha256 <> f.sha256 THEN 'mismatch' ELSE 'ok' END AS verdict FROM _paths p LEFT JOIN v_files f ON f.path = p.path"


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    return pool.verified(catalog.photo_scan(*_both(s, d)), v.files(s, d))


_query("verify_pool", _VERDICT)(_verdicts)
_query("verify_missing", f"SELECT id, path FROM ({_VERDICT}) WHERE verdict = 'missing'")(lambda s, d: _verdicts(s, d).where("verdict = 'missing'").select("id", "path"))
_VERDICTS = ", ".join(f"count(*) FILTER (verdict = '{n}') AS {n}" for n in ("ok", "missing", "corrupt", "mismatch"))
_query("verify_summary", f"SELECT {_VERDICTS} FROM ({_VERDICT})")(lambda s, d: pool.verify_summary(_verdicts(s, d)))
_query("verify_repair", f"SELECT p.id, CASE WHEN verdict IN ('missing', 'corrupt') THEN 'failed' ELSE status END AS status FROM v_photographs p LEFT JOIN ({_VERDICT}) v ON v.id = p.id")(
    lambda s, d: pool.repaired(v.photographs(s, d), _verdicts(s, d)).select("id", "status"))
_query("orphans", "SELECT p.id FROM v_photographs p WHERE NOT EXISTS (SELECT 1 FROM v_subjects s WHERE s.id = p.subject_id AND s.id % 10 <> 0)")(
    lambda s, d: catalog.orphans(v.photographs(s, d), v.subjects(s, d).where("id % 10 <> 0")).select("id"))


def _files(s: SparkSession, d: str) -> DataFrame:
    return v.files(s, d).withColumn("length", F.octet_length("path").cast("long"))


def _folders_sql(files: str) -> str:
    """The digests of folders over a listing (path, sha256), lengths being those of the paths."""
    part = lambda at: f"lower(lpad(to_hex(CAST(sum(CAST(CAST('0x' || substr(one, {at}, 15) AS BIGINT) AS HUGEINT)) % 1152921504606846976 AS BIGINT)), 15, '0'))"
    return f"""SELECT folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, {part(1)} || {part(16)} AS digest FROM (
      SELECT length, sha256(concat_ws(chr(10), path, CAST(length AS VARCHAR), sha256)) AS one, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS folder
      FROM (SELECT path, sha256, CAST(strlen(path) AS BIGINT) AS length FROM ({files}))) GROUP BY folder"""


_query("pool_folders", _folders_sql("SELECT path, sha256 FROM v_files"))(lambda s, d: digests.folders(_files(s, d)))
_LATER = "SELECT path, CASE WHEN strlen(path) % 5 = 0 AND corrupt THEN '1' ELSE sha256 END AS sha256 FROM v_files WHERE strlen(path) % 7 > 0"
_query("pool_changed", f"SELECT folder, CASE WHEN a.digest IS NULL THEN 'new' WHEN b.digest IS NULL THEN 'gone' ELSE 'other' END AS change FROM ({_folders_sql('SELECT path, sha256 FROM v_files')}) a FULL JOIN ({_folders_sql(_LATER)}) b USING (folder) WHERE a.digest IS DISTINCT FROM b.digest")(
    lambda s, d: digests.changed(_files(s, d), _files(s, d).where("length % 7 > 0").withColumn("sha256", F.expr("CASE WHEN length % 5 = 0 AND corrupt THEN '1' ELSE sha256 END"))))


def _store(s: SparkSession, d: str) -> Store:
    """A store with all photographs; a later version has every seventh as failed, and some new ones."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/provlake"
        os.makedirs(base, exist_ok=True)
    out = Store(s, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")
    out._fs.deleteOnExit(out._path(out.root))
    photos, subjects = _both(s, d)
    out.commit(subjects, photos)
    old = out.read("photographs").where("id % 7 = 0")
    new = {"id": F.col("id") + 1_000_000_000, "remote_url": F.concat("remote_url", F.lit("?new")), "status": F.lit("pending"), "sha256": F.lit(None), "filename": F.lit(None), "file_size": F.lit(None)}
    rows = old.withColumn("new", F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))  # both from one read
    out.commit_changes(subjects.limit(0), rows.withColumns({n: F.when(F.col("new"), c).otherwise(F.lit("failed") if n == "status" else F.col(n)) for n, c in new.items()}))
    return out


_STORED = """, stored AS (SELECT id, subject_id, category, subject, source, licence, CASE WHEN id % 7 = 0 THEN 'failed' ELSE status END AS status, file_size, remote_url, sha256 FROM v_photographs
  UNION ALL SELECT id + 1000000000, subject_id, category, subject, source, licence, 'pending', NULL, remote_url || '?new', NULL FROM v_photographs WHERE id % 7 = 0 AND id % 5 = 0)"""


def _stored(s: SparkSession, d: str) -> DataFrame:
    return _store(s, d).read("photographs").select("id", "remote_url", "status", "file_size", "sha256")


def _looked_up(s: SparkSession, d: str) -> DataFrame:
    """The photographs with the hashes and urls of every fiftieth order."""
    store = _store(s, d)
    wanted = v.table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("sha256"))
    return store.lookup("photographs", "sha256", wanted).select("id", "remote_url", "status")


def _cursor_page(s: SparkSession, d: str) -> DataFrame:
    """The page after the first one, and what the filter matches in all."""
    listing = Listing.of(_store(s, d), rows=5000)
    first = listing.page(50, category="setting")
    second = listing.page(50, first.cursor, category="setting")
    return second.rows.select("id", "category", "subject", "status").withColumn("total", second.total.select("n").scalar())


_query("store_changes", f"{_STORED} SELECT id, remote_url, status, file_size, sha256 FROM stored")(_stored)
_query("store_lookup", f"{_STORED} SELECT id, remote_url, status FROM stored WHERE sha256 IN (SELECT sha256(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 50 = 0)")(_looked_up)
_query("store_cursor_page", f"{_STORED} SELECT id, category, subject, status, count(*) OVER () AS total FROM stored WHERE status = 'complete' AND category = 'setting' ORDER BY category, subject, id LIMIT 50 OFFSET 50")(_cursor_page)


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """Candidates ingested into a store in two batches, the second with the failed ones tried again with success."""
    store = _store(s, d)
    rows = v.candidates(s, d).where("seq < 1000000000").withColumns({"subject": F.concat(F.lit("S "), F.col("seq") % 10), "source_url": F.col("remote_url"), "year": F.lit(None).cast("int"), "title": F.lit(None).cast("string"), "width": F.lit(None).cast("int")})
    ingest_batch(store, rows)
    ingest_batch(store, rows.withColumns({"failure": F.lit(None).cast("string"), "width": F.lit(800), "sha256": F.concat(F.lit("again"), F.col("seq").cast("string"))}).where("seq % 13 = 5"))
    other = F.expr("locate('archive.example/', remote_url) = 0")
    rest = F.expr("substr(remote_url, locate('archive.example/', remote_url) + 16)")  # as LIKE patterns these would be regular expressions
    return store.read("photographs").where(other | ~rest.contains(".jpg") | rest.contains("/")).select("remote_url", "status", "sha256", "width", F.col("file_size"))


_query("ingest_store", """, _seen AS (SELECT *, """ + v._accepted("licence") + """ AS free, row_number() OVER (PARTITION BY sha256, """ + v._accepted("licence") + """ AND failure IS NULL ORDER BY seq) AS turn FROM v_candidates WHERE seq < 1000000000)
  SELECT remote_url, CASE WHEN NOT free THEN 'quarantined' WHEN failure IS NOT NULL OR turn = 1 THEN 'complete' ELSE 'duplicate' END AS status,
    CASE WHEN free AND failure IS NOT NULL THEN 'again' || seq WHEN free AND turn = 1 THEN sha256 END AS sha256, CAST(CASE WHEN free AND failure IS NOT NULL THEN 800 END AS INT) AS width,
    CASE WHEN free AND (failure IS NOT NULL OR turn = 1) THEN size END AS file_size FROM _seen""")(_ingested)
