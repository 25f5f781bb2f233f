"""Token counts: batches of texts encoded in Arrow functions that return lengths only.

A batch holds about `batch` bytes of text, however many rows that is, so that tasks need the same
memory on short and on long texts. Texts, long ones above all, are split where the tokenizer splits
them anyway; the distinct pieces of a batch are encoded together, and a text's count is the sum
over its pieces. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct_spans, utf8
from .tokens import Recent, piece_starts, tokenizer

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SPACE = "▁"  # how sentencepiece writes a space


@cache
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _at_spaces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of pieces: of each row, and after single spaces between ASCII letters or digits."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        cut[2:-1] = (data[1:-1] == 32) & _ALNUM[data[:-2]] & _ALNUM[data[2:]]
    cut[np.minimum(off[:-1] + 1, len(data))] = False  # a space that begins its row follows no letter of it
    cut[off[:-1]] = True
    return np.flatnonzero(cut[:-1])


@cache
def _splitter(path: str) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], int]:
    """Where pieces start, and how many bytes before a start go since the next piece implies them.

    Byte-level BPE: where its own pattern always splits. Sentencepiece: at a single space between letters
    or digits, if each text is begun with a space, spaces are left as they are and no piece has one
    inside or at its end; the space that goes is the one that begins the next piece. Texts of any
    other tokenizer are pieces as they are.
    """
    if path.endswith(".model"):
        model = _sentencepiece(path)
        own = not any(_SPACE in model.id_to_piece(i).lstrip(_SPACE) for i in range(model.get_piece_size()))
        # as the model treats texts, which its own settings decide
        plain = model.encode("a  b") != model.encode("a b") and all(model.encode(f"{a} {b}") == model.encode(a) + model.encode(b) for a, b in [("ab", "cd"), ("x1", "The"), ("B", "9")])
        if own and plain:
            return _at_spaces, 1
    else:
        how = json.loads(tokenizer(path).to_str())
        kind = how["pre_tokenizer"] or {}
        if how["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space"):
            return piece_starts, 0
    return (lambda data, off: np.unique(off[:-1][np.diff(off) > 0])), 0


def _lengths(path: str, texts: list[bytes]) -> Iterator[int]:
    """The number of ids of each text, some MB of them at a time."""
    size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) >> 20
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        some = [x.decode() for x in texts[a:b]]
        yield from map(len, _sentencepiece(path).encode(some, num_threads=1) if path.endswith(".model") else tokenizer(path).encode_batch_fast(some, add_special_tokens=False))


_KNOWN: dict[str, Recent] = {}


def _counted(path: str, data: np.ndarray, off: np.ndarray, keep: int) -> np.ndarray:
    """The number of ids of each row. Short pieces that this worker has met of late are looked up."""
    places, gone = _splitter(path)
    starts = places(data, off)
    ends = np.r_[starts[1:], len(data)][: len(starts)]
    inner = np.r_[~np.isin(starts[1:], off), False][: len(starts)]  # pieces whose end is within their row
    ends = ends - gone * inner
    _, first, which = distinct_spans(data, starts, ends)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    got = _KNOWN.setdefault(path, Recent(keep)).of(words, lambda new: _lengths(path, new))
    n = np.fromiter(got, np.int64, len(got))
    total = np.r_[0, np.cumsum(n[which])]
    return np.diff(total[np.searchsorted(starts, off)])


def counts(docs: DataFrame, path: str, most: int = 1024, batch: int = 1 << 22, keep: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of `docs` (doc_id, text; others ignored).

    `path` is a tokenizers file (.json) or a sentencepiece model (.model); no special tokens are added.
    over_limit is n_tokens > `most`. A null or empty text has no bytes and no tokens; null and
    repeated ids are kept as they are; an empty table gives no rows. A text without a safe place to
    split it, and any text of a tokenizer for which none is known, is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, "text", batch):
            data, off = utf8(rows.column("text"))
            n = _counted(path, data, off, keep)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > most)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def summary(counted: DataFrame) -> DataFrame:
    """One row: documents, n_bytes, n_tokens, documents over the limit, and the longest in tokens (null for an empty table)."""
    return counted.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.count_if("over_limit").alias("over"), F.max("n_tokens").alias("longest"))


def query(docs: DataFrame, path: str) -> DataFrame:
    return counts(docs, path)
