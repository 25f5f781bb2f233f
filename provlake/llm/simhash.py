"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made per document; from then on only distinct fingerprints travel. Each is
filed under the small Hamming ball of each of its segments, a bucket joins those that share an
entry, and full distances are verified within buckets. With 64 bits in two segments, a pair
within 4 bits differs by at most 2 in some segment, so both sides meet when each files its ball
of radius 1. Tasks report a spanning forest of the links they verify, never all pairs; buckets
beyond `tile` fingerprints are dealt to pairs of tiles, so no task holds a whole large bucket.

Where a word-set similarity is asked for, these links are only candidates: the components they
make are taken up once more with the shingle sets of their texts, and the links that count are
those whose exact Jaccard similarity reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, mixed, written
from .components import connected_components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _shingles(text: bytes | None, width: int) -> list[bytes]:
    """The `width`-word shingles of a text, repeats included; of fewer words, all of them as one."""
    words = (text or b"").translate(LOWER).split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def simhash(text: bytes | None, width: int = 4, seed: int = 42, bits: int = 64, distinct: bool = False) -> tuple[int, int]:
    """High and low word of the fingerprint of a text's `width`-word shingles; no words give 0.

    64 bits come from XXH64, 128 from the 128-bit XXH3. A shingle counts as often as it stands,
    or once if `distinct`: then the fingerprint is that of the set.
    """
    parts = _shingles(text, width)
    if distinct:
        parts = set(parts)
    if not parts:
        return 0, 0
    n, lanes = len(parts), bits // 8
    if bits == 64:
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n).view(np.uint8)
    else:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts, repeat(seed))), np.uint8)
    h = h.reshape(n, lanes)
    ones = np.zeros(256 * lanes, np.int64)
    for i in range(0, n, 1 << 17):
        ones += np.bincount((h[i : i + (1 << 17)] + np.arange(lanes, dtype=np.int64) * 256).ravel(), minlength=256 * lanes)
    flags = np.einsum("lb,bi->li", ones.reshape(lanes, 256), _BITS).ravel() * 2 > n
    low, *high = np.packbits(flags, bitorder="little").view(np.uint64).tolist()
    return high[0] if high else 0, low


def _node(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A fingerprint as one 64-bit number: itself if it has 64 bits, else a hash."""
    return np.where(high == 0, low, mixed(mixed(high) + low))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, bits: int = 64, distinct: bool = False) -> DataFrame:
    """(doc_id, digest, fp, high, low): one row for each row of `docs`; fp names the fingerprint high:low, digest is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column("text"), pa.binary())
            words = np.array([simhash(x.as_py(), width, seed, bits, distinct) for x in texts], np.uint64).reshape(-1, 2)
            high, low = words[:, 0].copy(), words[:, 1].copy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *(pa.array(x.view(np.int64)) for x in (_node(high, low), high, low))], ["doc_id", "digest", "fp", "high", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, f"doc_id {kind}, digest long, fp long, high long, low long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b between values."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        old = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == old).all():
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[moved], nodes[root[moved]]


def _near(high: np.ndarray, low: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, within consecutive groups of `sizes` fingerprints; stars for the larger groups."""
    apart = lambda i, j: np.bitwise_count(high[i] ^ high[j]) + np.bitwise_count(low[i] ^ low[j])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = np.cumsum(sizes) - sizes
    end = np.repeat(first + sizes, sizes)
    small = np.repeat(sizes <= 64, sizes)
    at = np.arange(len(low))
    for lag in range(1, int(min(65, sizes.max(initial=0)))):
        i = at[small & (at + lag < end)]
        if not len(i):
            break
        i = i[apart(i, i + lag) <= most]
        left.append(i), right.append(i + lag)
    for s, n in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        group = np.arange(s, s + n)
        for k in range(0, n, 256):
            i, j = np.nonzero(apart(group[k : k + 256, None], group[None, :]) <= most)
            i, j = _forest(group[k + i], group[j])
            left.append(i), right.append(j)
    return np.concatenate(left), np.concatenate(right)


def links(prints: DataFrame, most: int = 4, segments: int = 2, radius: int | None = None, wide: int | None = None, tile: int = 2048, bits: int = 64) -> DataFrame:
    """(a, b): links between distinct `fp` of `prints` (fp, high, low).

    Without `radius`, balls are as large as it takes for every pair within `most` bits to meet, so
    the links connect just what those pairs connect. A given `radius` is that of the balls on
    either side: pairs within `most` bits meet if some segment differs by at most twice that.
    Segments share a word's bits without overlap, or are `wide` bits each, evenly spaced, and may overlap.
    """
    radius = -(-(most // segments) // 2) if radius is None else radius
    words = ["low", "high"][: bits // 64]
    per = segments // len(words)
    width = wide or 64 // per
    cuts = [(w, i * (64 - width) // (per - 1) if per > 1 else 0) for w in words for i in range(per)]
    keys = F.explode(F.array(*(F.shiftrightunsigned(w, low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(s << 48)) for s, (w, low) in enumerate(cuts))))
    flips = F.explode(F.array(*(F.lit(sum(1 << i for i in c)).cast("long") for r in range(radius + 1) for c in combinations(range(width), r))))
    filed = prints.select("high", "low", keys.alias("key")).select("high", "low", "key", flips.alias("flip")).select(F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "high", "low")
    filed = filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")

    # a bucket of up to `tile` fingerprints stays where it is; larger ones are dealt to pairs of tiles
    small = filed.where(F.col("n") <= tile).select("key", "high", "low").sortWithinPartitions("key")
    large = _tiled(filed.where(F.col("n") > tile), "key", F.ceil(F.col("n") / tile), ["high", "low"])

    def verified(by: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got, sizes in _groups(batches, by):
                high, low = (got.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
                i, j = _near(high, low, sizes, most)
                node = _node(high, low)
                yield _links(*_forest(node[i], node[j]))

        return run

    return small.mapInArrow(verified(["key"]), _LINK).union(large.mapInArrow(verified(["key", "i", "j"]), _LINK)).where("a <> b")


_LINK = "a long, b long"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _tiled(rows: DataFrame, group: str, tiles: Column, columns: list[str]) -> DataFrame:
    """`rows` (`group`, high, low, `columns`) dealt to pairs (i, j) of the tiles of their group, sorted by these; every two rows of a group meet."""
    own = F.pmod(F.xxhash64("high", "low"), tiles).cast("int")
    met = F.explode(F.transform(F.sequence(F.lit(0), (tiles - 1).cast("int")), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))))
    dealt = rows.withColumn("t", met).select(group, F.col("t.i").alias("i"), F.col("t.j").alias("j"), *columns)
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by `by`, some at a time, and the groups' sizes."""
    rest: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        held = [*rest, batch] if batch is not None else rest
        if not sum(x.num_rows for x in held):
            continue
        got = pa.Table.from_batches(held).combine_chunks()
        cols = [got.column(c).to_numpy() for c in by]
        starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        cut = int(starts[-1]) if batch is not None else got.num_rows  # the last group may go on
        rest = got.slice(cut).to_batches()
        if cut:
            yield got.slice(0, cut), np.diff(np.r_[starts[starts < cut], cut])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _alike(sets: list[np.ndarray], high: np.ndarray, low: np.ndarray, most: int, similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest, as positions, of the pairs within `most` bits whose sets have that Jaccard similarity."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(size) - size
    kinds, rank = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(kinds), bool)
    label = np.arange(len(sets))
    a: list[int] = []
    b: list[int] = []
    for i in range(1, len(sets)):
        apart = np.bitwise_count(high[:i] ^ high[i]) + np.bitwise_count(low[:i] ^ low[i])
        near = np.flatnonzero((apart <= most) & (label[:i] != label[i]))
        if not len(near):
            continue
        own = rank[first[i] : first[i] + size[i]]
        mine[own] = True
        n = size[near]
        at = np.arange(n.sum()) + np.repeat(first[near] - (np.cumsum(n) - n), n)
        shared = np.bincount(np.repeat(np.arange(len(near)), n), mine[rank[at]], minlength=len(near))
        mine[own] = False
        for j in near[shared / np.maximum(size[i] + n - shared, 1) >= similarity].tolist():
            if label[j] != label[i]:
                a.append(i), b.append(j)
                label[label == label[j]] = label[i]
    return a, b


def similar(docs: DataFrame, ids: DataFrame, found: DataFrame, similarity: float, width: int, most: int, words: int = 1 << 20, texts: int = 1024) -> DataFrame:
    """(a, b): links of `found` between fingerprints `ids` (fp, high, low, rep) whose texts have that Jaccard similarity.

    rep (doc_id, digest) is a row of `docs` with the fingerprint; its distinct shingles, by a
    64-bit hash, stand for all texts of that fingerprint. Only members of the components of
    `found` are fetched. In a component every pair within `most` bits is verified, but for
    those already connected; one of more than `words` shingles or `texts` texts is dealt to pairs of tiles.
    """
    roots = connected_components(found)
    member = ids.join(roots, ids.fp == roots.node).select("root", "fp", "high", "low", F.col("rep.doc_id").alias("of"), F.col("rep.digest").alias("is"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    there = keyed.join(member, keyed.doc_id.eqNullSafe(F.col("of")) & (keyed.digest == F.col("is"))).select("root", "fp", "high", "low", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _shingles(x.as_py(), width)), np.uint64)) for x in pc.cast(batch.column("text"), pa.binary())]
            n = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "fp", "high", "low")), n, pa.array([x.tobytes() for x in sets], pa.binary())], ["root", "fp", "high", "low", "n", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, sizes in _groups(batches, ["root", "i", "j"]):
            high, low = (got.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            node, sets = _node(high, low), got.column("shingles")
            for s, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                a, b = _alike([np.frombuffer(x.as_py(), np.uint64) for x in sets.slice(s, n)], high[s : s + n], low[s : s + n], most, similarity)
                yield _links(node[s : s + n][a], node[s : s + n][b])

    sets = written(there.mapInArrow(shingled, "root long, fp long, high long, low long, n long, shingles binary").dropDuplicates(["fp"]), "sets")
    tiles = F.ceil(F.greatest(F.sum("n") / words, F.count(F.lit(1)) / texts))
    sets = sets.join(sets.groupBy("root").agg(tiles.alias("tiles")), "root")
    return _tiled(sets, "root", F.col("tiles"), ["high", "low", "shingles"]).mapInArrow(verified, _LINK)


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, bits: int = 64, similarity: float | None = None, firsts: bool = False, **how) -> DataFrame:
    """(doc_id, fp, high, low, component_id) for each row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of at most `most` differing bits;
    with `similarity`, over those of them whose shingle sets have that Jaccard similarity or more
    (fingerprints are then of the sets too, since repeats would move them and not the similarity).
    With `firsts`, also digest and first: whether the row has the component's id and, of the texts
    with that id in the component, the one of the least digest.
    A null or wordless text has fingerprint 0, linked like any other. Null ids are never the
    smallest unless a component has no other. Repeated rows stay, each with its own row; an
    empty table gives no rows.
    """
    prints = written(fingerprints(docs, width, seed, bits, distinct=similarity is not None), "fingerprints")
    rep = [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("rep")] if firsts or similarity is not None else []
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("high").alias("high"), F.first("low").alias("low"), *rep)
    found = links(ids, bits=bits, **how)
    if similarity is not None:
        found = similar(docs, ids, found, similarity, width, how.get("most", 4))
    roots = connected_components(found)
    lead = ["rep"] if firsts else []
    named = ids.join(roots, ids.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), *lead)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"), *(F.min(c).alias("lead") for c in lead))
    named = named.join(smallest, "root").select("fp", "component_id", *("lead" for _ in lead))
    first = (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("lead.digest"))).alias("first") if firsts else None
    return prints.join(named, "fp").select("doc_id", "fp", "high", "low", "component_id", *(["digest", first] if firsts else []))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each component: its first, as near_duplicates() has it. `how`: as there.

    Documents are told apart by id and text, so different texts with one id stay or go each with
    their own component. Of rows alike in both, one stays: the least by a hash of all columns.
    Documents without an id are kept.
    """
    found = near_duplicates(docs, firsts=True, **how)
    gone = found.where(F.col("doc_id").isNotNull() & ~F.col("first")).select("doc_id", F.col("digest").alias("_digest")).distinct()
    keyed = docs.withColumn("_digest", F.xxhash64("text"))
    order = Window.partitionBy("doc_id", "_digest").orderBy(F.xxhash64(*docs.columns))
    kept = keyed.where(F.col("doc_id").isNotNull()).join(gone, ["doc_id", "_digest"], "left_anti")
    kept = kept.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


#: Texts of a 5-word Jaccard similarity s differ in arccos(2 s / (1 + s)) / pi of their bits on
#: average: 19 of 128 at 0.8 with a deviation of 4, 16 at 0.85, 13 at 0.9. At 0.8 some of the six 21-bit
#: segments differs by at most 2 with probability 0.93. Unrelated texts differ in 64 bits, deviation 6.
#: Texts less similar than 0.8 that come within `most` bits fall to the exact comparison.
SIMILAR = {"width": 5, "bits": 128, "most": 27, "segments": 10, "wide": 21, "radius": 1, "similarity": 0.8}


def query(docs: DataFrame) -> DataFrame:
    """The digest: fingerprints as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("low"), 16, "0")).alias("fingerprint"), "component_id")
