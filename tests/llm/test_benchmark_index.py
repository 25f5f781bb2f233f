"""The index of a block of the benchmark: its size, its bounds and its exactness; and repeated rows in resharding."""

import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from provlake.llm import decontaminate, reshard


def test_numbers_are_those_of_equal_runs():
    r = np.random.default_rng(1)
    ids = r.integers(0, 3, 500)
    for width in range(1, 12):
        got = decontaminate._numbers(ids, width)
        runs = [tuple(ids[i : i + width].tolist()) for i in range(len(ids) - width + 1)]
        assert len(got) == len(runs) and len(set(zip(runs, got.tolist()))) == len(set(runs)) == len(set(got.tolist()))
    assert len(decontaminate._numbers(ids[:4], 9)) == 0


def test_an_index_stays_small():
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(30_000)]
    items = [" ".join(r.choice(vocabulary) for _ in range(100)) for _ in range(2000)]
    index = decontaminate._Index([str(i) for i in range(2000)], pa.array(items), 10, 5)
    index.order({k: np.zeros(len(x), np.int64) for k, x in index.tokens.items()})
    assert len(index.start) == 2000 * 91
    assert len(pickle.dumps(index)) < 80 * 200_000  # bytes a word


def test_long_items_are_cut_and_blocks_bounded(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    vocabulary = [*(f"w{i}" for i in range(60)), "é" * 9, "x" * 70, "x" * 71]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [("long", text(900)), ("tall", text(333)), ("short", "W1 w2 W3"), (None, "w5"), ("none", " ... "), ("long", text(40)), ("tie", "w1 w2 w3")]
    items.append(items[1])
    rows = []
    for i in range(60):
        words, (_, t) = text(80).split(), items[i % 2]
        at = r.randrange(len(t.split()) - 30)
        words[30:30] = t.split()[at : at + 8 + i % 5]
        rows.append((i, " ".join(words).upper()))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs, bench = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id string, text string")
    want = {}
    wins = [(i or "", tuple(t.lower().split()[k : k + 10])) for i, t in items if t != " ... " for k in range(max(1, len(t.split()) - 9))]
    for i, t in rows:
        w, hit, found = re.sub("[A-Z]", lambda m: m[0].lower(), t).split(), set(), set()  # an accented letter stays as it is
        for name, q in wins:
            for k in range(len(w) - len(q) + 1):
                if tuple(w[k : k + len(q)]) == q:
                    hit.update(range(k, k + len(q)))
                    found.add(name)
        want[i] = len(w), len(hit), sorted(found)
    assert sum("long" in x[2] for x in want.values()) > 5
    for step, words in ((1 << 15, 1 << 20), (50, 1 << 20), (50, 120)):
        monkeypatch.setattr(decontaminate, "_STEP", step)
        monkeypatch.setattr(decontaminate, "_WORDS", words)
        monkeypatch.setattr(decontaminate, "_AT_ONCE", 7)
        got = {x.doc_id: (x.n_words, x.n_hit, sorted(x["items"])) for x in decontaminate.measure(docs, bench).collect()}
        assert got == want
    pieces = decontaminate._pieces(bench, 10).withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(512)))
    cuts = decontaminate._dealt(pieces, 100)
    held = [pieces.where(F.col("bucket").between(a, b - 1)).agg(F.sum("words")).first()[0] for a, b in cuts]
    assert len(cuts) > 5 and max(held) <= 120 and sum(held) == pieces.agg(F.sum("words")).first()[0]


def test_rows_alike_are_dealt_over_buckets(spark, tmp_path):
    spark.createDataFrame([(None, "same")] * 3000, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    placed, _ = reshard.place(docs, F.lit(0), 2, 3)
    got = placed.collect()
    assert len({x.row for x in got}) == 3000
    for s in range(3):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(1000))
    # slots of a bucket follow each other: neighbours by number in one bucket alone would be in order
    order = [x.row for x in sorted(got, key=lambda x: x.slot) if x.shard == 0]
    assert order != sorted(order)
