"""Benchmark decontamination: a prefix-filtered set join of benchmark windows against all documents.

An item's windows are its runs of `size` consecutive words (fewer words: the whole item). A
window counts as a set of word shingles that must be contained in full, so for the join one
prefix token, its rarest shingle by document count, is necessary; a document position that
carries it is a candidate for the start that the shingle's offset implies. Candidates that
would begin or end outside the document fall to the positional and length bounds; the rest are
verified word by word and byte by byte.

The benchmark is a stated query set: it is taken in blocks, one after the other. Items are cut
into pieces of _STEP windows, so a block has at most `block` pieces, _WORDS words and _TEXTS
bytes, and its index takes some 60 bytes a word. A block is sent to the tasks, every document is
held against it, and it is released before the next. With one block documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, LOWER, blocks, distinct_spans, eights, mixed, span_hashes, utf8, word_spans, written

_LOWER = np.frombuffer(LOWER, np.uint8)
#: The bytes of `[\x00-\x2F\x3A-\x60\x7B-\x7F]`.
_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_BYTES = 1 << 21
#: Windows of a piece of an item; words and bytes of a block of pieces.
_STEP = 1 << 15
_WORDS = 1 << 20
_TEXTS = 1 << 23
#: Candidates that a task holds at a time.
_AT_ONCE = 1 << 18


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start, end and row of each word; hash of each word."""
    data, off = utf8(column)
    data = _LOWER[data]
    starts, ends, row = word_spans(data, off, _GAP)
    return data, starts, ends, row, span_hashes(data, starts, ends)


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, by its first word; runs may cross rows."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mixed(out)


def _numbers(ids: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` words, by its first word, a number that runs of the same words share and no others.

    Numbers of short runs make those of runs twice as long, so nothing is left to hashes.
    """
    pair = lambda a, b: np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]
    out, have, power, span = None, 0, ids, 1
    while True:
        if width & span:
            n = max(0, len(ids) - have - span + 1)
            out = power[:n] if out is None else pair(out[:n], power[have : have + n])
            have += span
        if span << 1 > width:
            return out
        n = max(0, len(power) - span)
        power, span = pair(power[:n], power[span : span + n]), span << 1


class _Index:
    """The windows of one block of pieces, by shingle; all its parts are flat arrays.

    text, at, end, h: the words of the pieces. start, length: each distinct window's first word and number of words.
    cut, items: the names of a window's items are names[items[cut[w] : cut[w + 1]]].
    """

    def __init__(self, names: list[str], texts: pa.Array, size: int, shingle: int):
        data, at, end, row, h = _words(texts)
        self.names = sorted(set(names))
        place = {x: i for i, x in enumerate(self.names)}
        item = np.array([place[x] for x in names], np.int64)
        ids = distinct_spans(data, at, end)[2].astype(np.int64)
        first = np.searchsorted(row, np.arange(len(names) + 1))
        words = np.diff(first)
        lengths = np.minimum(words, size)
        start, length, cut, items = [], [], [0], []
        for n in np.unique(lengths[lengths > 0]).tolist():
            mine = np.flatnonzero(lengths == n)
            times = words[mine] - n + 1
            begin = np.repeat(first[mine] - np.cumsum(times) + times, times) + np.arange(times.sum())
            kinds, one, which = np.unique(_numbers(ids, n)[begin], return_index=True, return_inverse=True)
            pairs = np.unique(which * len(self.names) + np.repeat(item[mine], times))
            start.append(begin[one])
            length.append(np.full(len(kinds), n))
            cut.extend((cut[-1] + np.cumsum(np.bincount(pairs // len(self.names), minlength=len(kinds)))).tolist())
            items.append(pairs % len(self.names))
        flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.start, self.length, self.cut, self.items = flat(start, np.int32), flat(length, np.int32), np.array(cut, np.int64), flat(items, np.int32)
        self.text, self.at, self.end, self.h = data, at.astype(np.int32), end.astype(np.int32), h
        self.width = np.minimum(self.length, shingle)
        self.shingles = {int(k): _runs(h, int(k)) for k in np.unique(self.width)}
        self.tokens = {}
        for k in self.shingles:
            of = np.flatnonzero(self.width == k)
            most = int((self.length[of] - k).max())
            self.tokens[k] = np.unique(np.concatenate([self.shingles[k][self.start[of[self.length[of] - k >= j]] + j] for j in range(most + 1)]))

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Keep of each window its rarest shingle, by the counts of `tokens`: {width: (hashes, ends by hash, windows, offsets)}."""
        self.prefix = {}
        for k, keys in self.tokens.items():
            of = np.flatnonzero(self.width == k)
            best, best_n, offset = np.full(len(of), len(keys)), np.full(len(of), np.iinfo(np.int64).max), np.zeros(len(of), np.int64)
            for j in range(int((self.length[of] - k).max()) + 1):
                on = np.flatnonzero(self.length[of] - k >= j)
                token = np.searchsorted(keys, self.shingles[k][self.start[of[on]] + j])
                n = counts[k][token]
                less = (n < best_n[on]) | ((n == best_n[on]) & (token < best[on]))
                best[on[less]], best_n[on[less]], offset[on[less]] = token[less], n[less], j
            by = np.argsort(best, kind="stable")
            used, many = np.unique(best[by], return_counts=True)
            self.prefix[k] = keys[used], np.r_[0, np.cumsum(many)], of[by].astype(np.int32), offset[by].astype(np.int32)
        self.shingles = self.tokens = self.width = None


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `h` has one of the sorted `keys`, and which."""
    if not len(keys) or not len(h):
        return (np.zeros(0, np.int64),) * 2
    seen = np.zeros(1 << 20, bool)
    seen[keys >> np.uint64(44)] = True
    at = np.flatnonzero(seen[h >> np.uint64(44)])
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[k] == h[at]
    return at[ok], k[ok]


def _pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, text, words): the items' texts in pieces that share size - 1 words, so that each window is in one; those without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", _TEXTS):
            data, starts, ends, row, _ = _words(batch.column("text"))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                for p in range(a, max(b - size + 1, a + 1) if b > a else a, _STEP):
                    q = min(b, p + _STEP + size - 1)
                    yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, 1), pa.array([data[starts[p] : ends[q - 1]].tobytes().decode()]), pa.array([q - p])], ["item", "text", "words"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    return items.mapInArrow(run, "item string, text string, words long")


def _dealt(pieces: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of the column `bucket`, each a block of at most `block` pieces, _WORDS words and _TEXTS bytes, but for a bucket that alone has more."""
    out, held = [], np.zeros(3, np.int64)
    limit = np.array([block, _WORDS, _TEXTS])
    for r in pieces.groupBy("bucket").agg(F.count(F.lit(1)), F.sum("words"), F.sum(F.octet_length("text"))).orderBy("bucket").collect():
        held += np.array(r[1:])
        if not out or (held > limit).any():
            out.append((r[0], r[0] + 1))
            held = np.array(r[1:])
        out[-1] = out[-1][0], r[0] + 1
    return out


def _indexes(docs: DataFrame, benchmark: DataFrame, size: int, shingle: int, block: int) -> Iterator:
    """The blocks' indexes as broadcast variables, one at a time, each with its windows' shingles ordered by rarity; the first may be empty."""
    sc = docs.sparkSession.sparkContext
    pieces = written(_pieces(benchmark, size), "items")
    many = pieces.agg(F.count(F.lit(1)), F.sum("words"), F.sum(F.octet_length("text"))).first()
    full = max(-(-(n or 0) // most) for n, most in zip(many, (block, _WORDS, _TEXTS)))
    # 64 buckets to a block, so that blocks fill up to their bounds whatever the hashes do
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(64 * full)) if full > 1 else F.lit(0).cast("long"))
    for a, b in _dealt(pieces, block) or [(0, 1)]:
        rows = pieces.where(F.col("bucket").between(a, b - 1)).select("item", "text").orderBy("item", "text").toArrow().combine_chunks()
        index = _Index(rows.column("item").to_pylist(), rows.column("text").combine_chunks(), size, shingle)
        totals = {k: np.zeros(len(x), np.int64) for k, x in index.tokens.items()}
        sent = sc.broadcast(index.tokens)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {k: np.zeros(len(x), np.int64) for k, x in sent.value.items()}
            for batch in blocks(batches, "text", _BYTES):
                _, _, _, row, h = _words(batch.column("text"))
                for k, keys in sent.value.items():
                    at, hit = _found(keys, _runs(h, k))
                    at, hit = (x[row[at] == row[at + k - 1]] for x in (at, hit))
                    pair = np.unique(row[at] * len(keys) + hit)  # a document counts once
                    total[k] += np.bincount(pair % len(keys), minlength=len(keys))
            for k, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(n[some])], ["k", "token", "n"])

        if totals:
            counts = docs.select("text").mapInArrow(count, "k long, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n")).toArrow()
            k, token, n = (counts.column(c).to_numpy() for c in ("k", "token", "n"))
            for width, total in totals.items():
                total[token[k == width]] = n[k == width]
        index.order(totals)
        sent.destroy()
        yield sc.broadcast(index)


def _same_words(data: np.ndarray, at: np.ndarray, end: np.ndarray, index: _Index, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words `a` of a batch and words `b` of the index, whose hashes agree, have the same bytes. Words of one length up to 8 never share a hash."""
    n = end[a] - at[a]
    ok = n == index.end[b] - index.at[b]
    on, done = np.flatnonzero(ok & (n > 8)), 0
    if len(on):
        mine, other = eights(data), eights(index.text)
    while len(on):
        last = FIRST[np.minimum(n[on] - done, 8)]
        ok[on] &= (mine[at[a[on]] + done] & last) == (other[index.at[b[on]] + done] & last)
        done += 8
        on = on[ok[on] & (n[on] > done)]
    return ok


def _candidates(h: np.ndarray, index: _Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word of a possible window in the batch, window), some _AT_ONCE at a time."""
    for k, (keys, cut, windows, offsets) in index.prefix.items():
        pos, hit = _found(keys, _runs(h, k))
        times = cut[hit + 1] - cut[hit]
        upto = np.r_[0, np.cumsum(times)]
        low = 0
        while low < upto[-1]:
            high = min(low + _AT_ONCE, upto[-1])
            nth = np.arange(low, high)
            p = np.searchsorted(upto, nth, "right") - 1
            at = cut[hit[p]] + nth - upto[p]
            yield pos[p] - offsets[at], windows[at]
            low = high


def _scan(batch: pa.RecordBatch, index: _Index) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """For each row: words, runs of hit words, ids of the items whose windows occur."""
    data, at, end, row, h = _words(batch.column("text"))
    n = batch.num_rows
    first = np.searchsorted(row, np.arange(n + 1))
    cover = np.zeros(len(h) + 1, np.int64)
    seen = [np.zeros(0, np.int64)]
    for s, w in _candidates(h, index):
        fits = (s >= 0) & (s + index.length[w] <= len(h))
        s, w = s[fits].astype(np.int64), w[fits]
        fits = s + index.length[w] <= first[row[s] + 1]
        s, w = s[fits], w[fits]
        j = 0
        while True:  # word by word; what differs is out
            on = np.flatnonzero(index.length[w] > j)
            if not len(on):
                break
            a, b = s[on] + j, index.start[w[on]] + j
            ok = np.ones(len(s), bool)
            ok[on] = h[a] == index.h[b]
            ok[on[ok[on]]] = _same_words(data, at, end, index, a[ok[on]], b[ok[on]])
            s, w, j = s[ok], w[ok], j + 1
        np.add.at(cover, s, 1)
        np.add.at(cover, s + index.length[w], -1)
        seen.append(np.unique(row[s] * len(index.start) + w))
    covered = np.r_[False, np.cumsum(cover[:-1]) > 0, False]
    covered = np.flatnonzero(covered[1:] != covered[:-1])
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b in zip(covered[::2].tolist(), covered[1::2].tolist()):
        for r in range(row[a], row[b - 1] + 1):  # windows of neighbouring rows may touch
            if first[r] < first[r + 1]:
                runs[r].append((max(a, int(first[r])) - int(first[r]), min(b, int(first[r + 1])) - int(first[r])))
    items: list[set[str]] = [set() for _ in range(n)]
    for pair in np.unique(np.concatenate(seen)).tolist():
        r, w = divmod(pair, len(index.start))
        items[r].update(index.names[i] for i in index.items[index.cut[w] : index.cut[w + 1]].tolist())
    return np.diff(first), runs, [sorted(x) for x in items]


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def measure(docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 5, block: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_hit, items): one row for each row of `docs`; items are the item ids found.

    A null or empty text has no words and no hits; an item without words has no windows, and
    its id, if null, is the empty string. Repeated items count once. Other columns of both
    tables are ignored. Empty tables give no rows, or rows without hits. `docs` is read once for
    each block and has to give the same partitions, as files do, if there are several.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = None
    for sent in _indexes(docs, benchmark, size, shingle, block):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, all_=found is None) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, "text", _BYTES):
                words, runs, items = _scan(batch, sent.value)
                out = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(words), pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], _RUNS), pa.array(items, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "runs", "items"])
                yield out if all_ else out.filter(pa.array([bool(x) for x in runs]))

        here = written(numbered.mapInArrow(run, f"row long, doc_id {kind}, n_words long, runs array<struct<a:bigint,b:bigint>>, items array<string>"), "hits")
        sent.destroy()
        found = here if found is None else found.union(here)
        many = found is not here
    if many:
        found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.first("doc_id").alias("doc_id"))
    # the words under all runs: in ascending order, each counts from where the ones before ended
    under = F.aggregate(F.sort_array("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")), lambda z, x: F.struct((z.n + F.greatest(x.b - F.greatest(x.a, z.e), F.lit(0))).alias("n"), F.greatest(z.e, x.b).alias("e")), lambda z: z.n)
    return found.select("doc_id", "n_words", under.alias("n_hit"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 5, block: int = 20_000) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of any item occurs.

    Null and empty texts have no words and stay; repeated rows stay or go together; null ids are ids like any other.
    With several blocks of items each notes the rows that it hits, and all go at once; as `measure`, it needs the same
    partitions of `docs` each time then.
    """
    own = "_row" + "_" * max(map(len, docs.columns))
    numbered = docs.withColumn(own, F.monotonically_increasing_id())

    def scanned(docs: DataFrame, sent, hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, "text", _BYTES):
                yield batch.filter(pa.array([bool(x) == hit for x in _scan(batch, sent.value)[1]], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    hits = last = None
    for sent in _indexes(docs, benchmark, size, shingle, block):
        if last is not None:
            here = written(scanned(numbered.select(own, "text"), last, True).select(own), "hits")
            last.destroy()
            hits = here if hits is None else hits.union(here)
        last = sent
    if hits is None:
        return scanned(docs, last, False)
    return scanned(numbered, last, False).join(hits.distinct(), own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = measure(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same in DuckDB: all windows of the lengths that items have, joined as texts.
ORACLE_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
items AS (SELECT id AS item_id, w, least(10, len(w)) AS n FROM words WHERE kind = 'i' AND len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM items)),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT id AS doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, lengths WHERE kind = 'd')),
found AS (SELECT doc_id, item_id, p, n FROM spots JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON id = covered.doc_id LEFT JOIN named ON id = named.doc_id WHERE kind = 'd'
"""
