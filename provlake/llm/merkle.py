"""A Merkle manifest of a dataset: a tree over the documents of each group, and one over the groups' roots.

Nodes have up to eight children; a node's digest is the sha256 of its children's in hexadecimal. The
leaves of a group are numbered in order, and aligned blocks of 8^`levels` of them are dealt over
the machines. A block's root is all that goes up; blocks of roots are dealt again until each group
has one, so no task sees more than a block, however large a group is.

Authentication paths come down the same way. Within a block they are made by traversal: for each
level there is the run of nodes that the present leaf's path has siblings in, and a treehash stack
that builds the next run, one leaf at each step, so that it is ready when the path moves on. What is
held beside the block's leaves grows with the number of levels only. The path of the block's root,
which all its leaves share, is appended to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .packed import batch_of, with_batch

ARITY = 8
_STEP = "struct<own:int,siblings:binary>"


def joined(nodes: list[bytes]) -> bytes:
    """The digest of the node above `nodes`."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def height(n: int, most: int) -> int:
    """Levels of nodes above `n` leaves, `most` at the most."""
    out = 0
    while out < most and ARITY**out < n:
        out += 1
    return out


class Treehash:
    """The nodes at a level above leaves that come one at a time; it holds less than a run for each level below."""

    def __init__(self, level: int):
        self.level, self.nodes = level, []
        self.stack: list[list[bytes]] = [[] for _ in range(level)]

    def update(self, leaf: bytes) -> None:
        node = leaf
        for run in self.stack:
            run.append(node)
            if len(run) < ARITY:
                return
            node = joined(run)
            run.clear()
        self.nodes.append(node)

    def end(self) -> list[bytes]:
        """The nodes, when no more leaves come: short runs have their node too."""
        for h, run in enumerate(self.stack):
            if run:
                node = joined(run)
                run.clear()
                (self.stack[h + 1] if h + 1 < self.level else self.nodes).append(node)
        return self.nodes


def block_root(leaves: list[bytes], levels: int) -> bytes:
    tree = Treehash(levels)
    for leaf in leaves:
        tree.update(leaf)
    return tree.end()[0]


def traversal(leaves: list[bytes], levels: int) -> Iterator[list[list[bytes]]]:
    """For each leaf in order the runs that its path passes, from its own up; a run is the same list until the path leaves it."""
    sizes = [ARITY ** (h + 1) for h in range(levels)]
    runs, ahead = [], []
    for h, size in enumerate(sizes):
        first, following = Treehash(h), Treehash(h)
        for leaf in leaves[:size]:
            first.update(leaf)
        runs.append(first.end())
        ahead.append(following)
    for i in range(len(leaves)):
        for h, size in enumerate(sizes):
            if i and i % size == 0:
                runs[h] = ahead[h].end()
                ahead[h] = Treehash(h)
            if i + size < len(leaves):
                ahead[h].update(leaves[i + size])
        yield runs


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` (tree, digest, ...) with pos, their number within the tree in that order, and n, the tree's size.

    Partitions are ranges of the order and count their own rows; only counts for each partition and tree are summed.
    """
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "leaves").withColumn("_part", F.shiftright("_at", 33))
    each = rows.groupBy("_part", "tree").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_part", "tree", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_base"), F.sum("_n").over(tree).alias("n"))
    return rows.join(each, ["_part", "tree"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, n, rows, root): the aligned blocks of `nodes` (tree, pos, n, digest, ...), their rows packed."""
    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            n = rows.column("n")[0].as_py()
            root = block_root(rows.column("digest").to_pylist(), height(n, levels))
            packed = with_batch(rows.drop_columns(["tree", "block", "n"]), b"")
            return pa.RecordBatch.from_arrays([rows.column("tree").slice(0, 1), rows.column("block").slice(0, 1), pa.array([n]), pa.array([packed], pa.binary()), pa.array([root], pa.binary())], ["tree", "block", "n", "rows", "root"])

        for batch in batches:
            tree, at = batch.column("tree"), batch.column("block").to_numpy()
            names = tree.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and (held[0].column("block")[0] != batch.column("block")[a] or held[0].column("tree")[0] != tree[a]):
                    yield block()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield block()

    rows = nodes.withColumn("block", F.expr(f"pos div {size}"))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, "tree string, block long, n long, rows binary, root binary")


def _raised(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, from the leaves up, and (tree, digest), the roots."""
    rounds = []
    while True:
        rounds.append(written(_dealt(nodes, levels), "blocks"))
        nodes = rounds[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**levels).alias("n"), F.col("root").alias("digest"))
        if not nodes.where("n > 1").take(1):
            return rounds, nodes.select("tree", "digest")


def _lowered(blocks: DataFrame, paths: DataFrame, levels: int, fields: str) -> DataFrame:
    """What is packed in `blocks` (`fields`), each row with its path to the top, from the paths of the blocks (tree, pos, path, and what the tree's nodes share)."""
    shared = [c for c in paths.columns if c not in ("tree", "pos", "path")]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows, _ = batch_of(one.column("rows")[0].as_py())
                above = [(x["own"], x["siblings"]) for x in one.column("path")[0].as_py()]
                leaves, depth = rows.column("digest").to_pylist(), height(one.column("n")[0].as_py(), levels)
                own, siblings = [], []
                for j, runs in enumerate(traversal(leaves, depth)):
                    for h, nodes in enumerate(runs):
                        k = j // ARITY**h % ARITY
                        own.append(k)
                        siblings.append(b"".join(nodes[:k] + nodes[k + 1 :]))
                    for k, others in above:
                        own.append(k)
                        siblings.append(others)
                steps = pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(siblings, pa.binary())], ["own", "siblings"])
                path = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * (depth + len(above)), pa.int32()), steps)
                again = pa.array(np.zeros(len(leaves), np.int32))
                yield pa.RecordBatch.from_arrays([one.column("tree").take(again), *(rows.column(c) for c in names), *(one.column(c).take(again) for c in shared), path], ["tree", *names, *shared, "path"])

    kinds = "".join(f", {c} {paths.schema[c].dataType.simpleString()}" for c in shared)
    known = blocks.drop("root").join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])
    return known.mapInArrow(run, f"tree string, {fields}{kinds}, path array<{_STEP}>")


def proofs(leaves: DataFrame, order: str, levels: int = 4) -> DataFrame:
    """`leaves` (tree: text, digest: 32 bytes, `order`, ...) with subroot, root and path.

    Leaves of a tree ascend by `order`, null first, equal ones by digest; trees ascend bytewise. A path is
    (own, siblings) for each run from the leaf's own up to the root's children: the leaf's place in the
    run, and the digests of the others from left to right. A tree of one leaf has it as its subroot, a
    single tree's subroot is the root. An empty table gives no rows. `levels` is the height of the
    blocks that are dealt; results don't depend on it.
    """
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema if f.name != "tree").replace("`", "")
    below, subroots = _raised(_numbered(leaves, [order, "digest"]), levels)
    over = _numbered(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("of")), ["of"])
    above, root = _raised(over, levels)
    none = F.array().cast(f"array<{_STEP}>")
    paths = root.select("tree", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("root"), none.alias("path"))
    for blocks in reversed(above[1:]):
        paths = _lowered(blocks, paths, levels, "pos long, digest binary").drop("digest")
    tops = _lowered(above[0], paths, levels, "digest binary, of string")
    paths = tops.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "path")
    for blocks in reversed(below[1:]):
        paths = _lowered(blocks, paths, levels, "pos long, digest binary").drop("digest")
    return _lowered(below[0], paths, levels, carried)


def folded(proved: DataFrame, leaf: str, name: str = "folded") -> DataFrame:
    """`proved` with `name`, the root that its path gives for the digest in column `leaf`; null for a null digest."""
    place = proved.columns.index(leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, path in zip(batch.column(place).to_pylist(), batch.column("path").to_pylist()):
                for step in path if node is not None else ():
                    k, others = 32 * step["own"], step["siblings"]
                    node = hashlib.sha256((others[:k] + node + others[k:]).hex().encode()).digest()
                out.append(node)
            yield batch.append_column(name, pa.array(out, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proved.schema)
    return proved.mapInArrow(run, f"{fields}, `{name}` binary")


def leaf(*values: Column) -> Column:
    """The digest of the values: each as its UTF-8 byte count, a colon and itself, or `-` for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def manifest(docs: DataFrame, levels: int = 4) -> DataFrame:
    """(doc_id, digest, tampered, subroot, root, path, ...): the proofs of `documents` rows, by lang; tampered is what their digest becomes where the contract tampers with them.

    Rows with null ids come first and are left as they are; rows alike in all columns have each a leaf of
    their own. A null lang is a group of its own, the first. Any value may be null; columns besides
    doc_id, source, lang, n_chars and text are ignored.
    """
    of = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.col("text")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", of(text).alias("digest"),
        F.when(due & text.rlike("[A-Z]"), of(F.translate(text, _UPPER, _UPPER.lower()))).alias("tampered"))
    return proofs(leaves, "doc_id", levels)


def query(docs: DataFrame) -> DataFrame:
    shown = lambda c: F.lower(F.hex(c))
    found = folded(manifest(docs).withColumn("now", F.coalesce("tampered", "digest")), "now")
    return found.select(
        "doc_id", shown("digest").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda x: shown(x["siblings"])), "").cast("binary"), 256).alias("proof_sha256"),
        shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """The query in DuckDB's SQL, for groups of up to 8^`levels` documents and as many groups."""
    step = "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(t) + 1), lambda i: ord(t[i])::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda c, _: " + step + ")), 4294967295)"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    out = [f"""WITH rows_ AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {hashed('text')} AS leaf, {hashed(lowered)} AS low, {crc} % 3 = 0 AS due FROM (SELECT *, doc_id::VARCHAR AS t FROM documents)),
a0 AS (SELECT *, CASE WHEN due THEN low ELSE leaf END AS node_, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows_),
n0 AS (SELECT tree, i, leaf AS h FROM a0)"""]

    def tree(name: str, key: str) -> None:
        """`name`0 to `name`L: nodes of each level; a level of one node is the last and is carried on."""
        for k in range(levels):
            out.append(f"{name}{k + 1} AS (SELECT {key}, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS m FROM {name}{k}) GROUP BY {key}, i // 8)")

    tree("n", "tree")
    out.append(f"s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS j FROM n{levels})")
    out.append("g0 AS (SELECT 0 AS z, j AS i, subroot AS h FROM s)")
    tree("g", "z")
    # up the path: at each level with more than one node the run's others, and the node made with what is being proved
    state, now = "SELECT a.*, s.subroot, s.j, '' AS proof, a.node_ AS f FROM a0 a JOIN s USING (tree)", "p0"
    out.append(f"p0 AS ({state})")
    for name, key, at in (("n", "tree", "i"), ("g", "z", "j")):
        for k in range(levels):
            span = 8**k
            on = f"r.{key} = {'p.tree' if key == 'tree' else '0'} AND r.run = p.{at} // {8 * span}"
            runs = f"(SELECT {key}, i // 8 AS run, array_agg(h ORDER BY i) AS hs, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS m FROM {name}{k}) GROUP BY {key}, i // 8)"
            own = f"(p.{at} // {span} % 8 + 1)"
            new = f"p{int(now[1:]) + 1}"
            out.append(f"""{new} AS (SELECT p.doc_id, p.tree, p.leaf, p.i, p.subroot, p.j,
  CASE WHEN r.m = 1 THEN p.proof ELSE p.proof || array_to_string(list_concat(r.hs[:{own} - 1], r.hs[{own} + 1:]), '') END AS proof,
  CASE WHEN r.m = 1 THEN p.f ELSE sha256(array_to_string(list_concat(list_append(r.hs[:{own} - 1], p.f), r.hs[{own} + 1:]), '')) END AS f
  FROM {now} p JOIN {runs} r ON {on})""")
            now = new
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, g.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = g.h AS verified FROM {now}, g{levels} g"


ORACLE_SQL = _sql(5)
