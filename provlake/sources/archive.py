"""The archive source: search responses to candidate records, and a Spark data source over them."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

from ..functions.text import IMAGE_MIMES, clean_html, extract_year, stripped, truthy, without_file_prefix

LANES = 4  # partitions of a search, which share its rate
SEARCH_MAX = 50  # candidates a search returns at most
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)

_VALUE = "map<string,struct<value:string>>"
_INFO = f"array<struct<url:string,descriptionurl:string,mime:string,width:int,height:int,size:bigint,extmetadata:{_VALUE}>>"
RESPONSE = f"query struct<pages:map<string,struct<title:string,imageinfo:{_INFO}>>>"


def candidates(responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidate records from `responses` (source, subject, category, response: JSON text).

    Pages without an image, of another kind or without a url yield nothing. `limit` holds for
    each subject of each source and counts what is yielded, in the order of the pages. Of a search by
    pages (turn, page) these stay, too.
    """
    where = [c for c in ("turn", "page") if c in responses.columns]
    pages = F.map_entries(F.from_json("response", RESPONSE).getField("query").getField("pages"))
    rows = responses.select("source", "subject", "category", *where, F.posexplode(pages).alias("pos", "result"))
    info = F.get(F.col("result.value.imageinfo"), F.lit(0))
    rows = rows.select("source", "subject", "category", *where, "pos", F.col("result.value.title").alias("raw_title"), info.alias("i"))
    meta = lambda key: truthy(F.col("i.extmetadata")[key]["value"])
    rows = rows.where(F.coalesce("i.mime", F.lit("")).isin(*IMAGE_MIMES) & (F.coalesce("i.url", F.lit("")) != ""))
    title = without_file_prefix(F.col("raw_title"))
    artist, credit = clean_html(meta("Artist")), clean_html(meta("Credit"))
    licence = stripped(F.coalesce(meta("LicenseShortName"), meta("License"), meta("UsageTerms"), F.lit("unknown")))
    out = rows.select(
        "source", "subject", "category", *where, "pos", title.alias("title"), artist.alias("photographer"), extract_year(meta("DateTimeOriginal"), title).alias("year"),
        F.col("i.url").alias("remote_url"), F.coalesce(truthy(F.col("i.descriptionurl")), F.col("i.url")).alias("source_url"), licence.alias("licence"), F.coalesce(artist, credit).alias("attribution"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
    return out if limit is None else top_per_subject(out, limit)


def top_per_subject(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows by pos of each subject of each source."""
    order = Window.partitionBy("source", "subject").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def harvest_plan(sources: list[str], subjects: DataFrame) -> DataFrame:
    """(seq, source, subject, category): every subject with every source, source by source; `subjects` has seq, name, category."""
    n = subjects.count()
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("source")) for i, s in enumerate(sources)))).alias("s")
    return subjects.select("seq", F.col("name").alias("subject"), "category", named).select((F.col("s.i") * n + F.col("seq")).cast("long").alias("seq"), "s.source", "subject", "category")


class Bucket:
    """A token bucket: `rate` a second, `burst` at once."""

    def __init__(self, rate: float = 2.0, burst: int = 4, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.room = max(rate, 0.01), max(1.0, float(burst))
        self.clock, self.sleep, self.tokens, self.at = clock, sleep, self.room, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.room, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def fetched(open_: Callable[[], bytes], retries: int = 4, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The result of `open_`, tried again after transport errors and passing HTTP errors; others are final."""
    for turn in range(retries):
        try:
            return open_()
        except HTTPError as e:
            if e.code not in TRANSIENT or turn == retries - 1:
                raise
        except URLError:
            if turn == retries - 1:
                raise
        sleep(base * 2**turn + random.uniform(0, base))
    raise ValueError("retries must be positive")


class ArchiveSource(DataSource):
    """spark.read.format("archive"): search responses, in LANES partitions at most, each with its share of the rate.

    Options: url (the search service), subjects (JSON list of {subject, category, query}),
    limit, rate (requests a second over all partitions).
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "source string, subject string, category string, response string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.subjects = json.loads(self.options["subjects"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(min(LANES, len(self.subjects)))]

    def read(self, partition: InputPartition, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
        mine = self.subjects[partition.value :: LANES]
        bucket = Bucket(float(self.options.get("rate", 2.0)) / min(LANES, len(self.subjects)), 1, sleep=sleep)
        limit = max(1, min(int(self.options.get("limit", SEARCH_MAX)), SEARCH_MAX))
        for subject in mine:
            bucket.take()
            yield self.options.get("source", "commons"), subject["subject"], subject["category"], searched(self.options["url"], subject["query"], limit)


def searched(url: str, query: str, limit: int, more: dict[str, str] | None = None) -> str:
    """The response to a search; `more` is what the response before it gave to go on with."""
    asked = {"action": "query", "format": "json", "generator": "search", "gsrsearch": query, "gsrnamespace": 6, "gsrlimit": limit, "prop": "imageinfo", "iiprop": "url|size|mime|extmetadata"}
    request = Request(f"{url}?{urlencode(asked | (more or {}))}", headers={"User-Agent": "provlake"})
    return fetched(lambda: urlopen(request, timeout=60).read()).decode()


class ArchivePages(DataSource):
    """spark.readStream.format("archive_pages"): the responses to all searches, page after page.

    The offset is the place in the list of subjects, the number of the page there and what the last response
    gave to go on with, so a search that was stopped goes on with the page after the last one that was
    committed. The rate holds for the whole search, and so one process asks, at the driver: a page is one
    request and has SEARCH_MAX results at most. Options: those of ArchiveSource; limit counts the results
    of a subject over its pages; pages: how many a micro-batch takes at most.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_pages"

    def schema(self) -> str:
        return "source string, subject string, category string, turn int, page int, response string"

    def simpleStreamReader(self, schema) -> PagesReader:
        return PagesReader(self.options)


class PagesReader(SimpleDataSourceStreamReader):
    def __init__(self, options, sleep: Callable[[float], None] = time.sleep):
        self.options, self.subjects = dict(options), json.loads(options["subjects"])
        self.bucket = Bucket(float(self.options.get("rate", 2.0)), 1, sleep=sleep)
        self.limit = max(1, int(self.options.get("limit", SEARCH_MAX)))

    def initialOffset(self) -> dict:
        return {"turn": 0, "page": 0, "more": {}}

    def _next(self, at: dict) -> tuple[tuple, dict]:
        """The row of the page at that offset, and the offset after it."""
        subject, left = self.subjects[at["turn"]], self.limit - at["page"] * SEARCH_MAX
        self.bucket.take()
        body = searched(self.options["url"], subject["query"], min(left, SEARCH_MAX), at["more"])
        row = self.options.get("source", "commons"), subject["subject"], subject["category"], at["turn"], at["page"], body
        more = json.loads(body).get("continue") if left > SEARCH_MAX else None
        return row, at | {"page": at["page"] + 1, "more": more} if more else {"turn": at["turn"] + 1, "page": 0, "more": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        while len(rows) < int(self.options.get("pages", 8)) and at["turn"] < len(self.subjects):
            row, at = self._next(at)
            rows.append(row)
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            row, start = self._next(start)
            yield row

    def commit(self, end: dict) -> None:
        pass


SOURCES: dict[str, type[DataSource]] = {"commons": ArchiveSource}


def register(spark: SparkSession, name: str) -> str:
    """Register a source by its name and return the format to read."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; available: {', '.join(sorted(SOURCES))}")
    spark.dataSource.register(SOURCES[name])
    return SOURCES[name].name()
