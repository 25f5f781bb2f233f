"""Record layouts and the fixed value sets of the catalogue."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_L, _I, _S = LongType(), IntegerType(), StringType()

SUBJECTS = StructType([StructField(n, t) for n, t in [("id", _L), ("name", _S), ("category", _S), ("wikidata_id", _S), ("birth_year", _I), ("death_year", _I), ("occupation", _S)]])

PHOTOGRAPHS = StructType([StructField(n, t) for n, t in [
    ("id", _L), ("subject_id", _L), ("category", _S), ("title", _S), ("photographer", _S), ("year", _I), ("source", _S), ("source_url", _S),
    ("licence", _S), ("attribution", _S), ("width", _I), ("height", _I), ("file_size", _L), ("filename", _S), ("sha256", _S), ("phash", _S),
    ("remote_url", _S), ("status", _S), ("downloaded_at", _S)]])

# Fixed values.
CATEGORIES = ("identity", "wardrobe", "setting", "concept")
DEFAULT_CATEGORY = "identity"
STATUSES = ("pending", "downloading", "complete", "failed", "duplicate", "quarantined")
TERMINAL = ("complete", "duplicate", "quarantined")
GROUP_COLUMNS = ("source", "licence", "status", "category")
#: What a client sees of a photograph.
WIRE = ("id", "subject", "category", "title", "photographer", "year", "source", "source_url", "licence", "attribution", "width", "height", "file_size", "filename", "sha256", "remote_url", "status", "downloaded_at")
PAGE_DEFAULT, PAGE_MAX = 100, 500
THUMB_DEFAULT, THUMB_MAX = 384, 1024
