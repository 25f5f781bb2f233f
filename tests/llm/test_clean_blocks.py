"""Decontamination with a benchmark of several blocks."""

import random

import pytest

from provlake.llm import decontaminate


@pytest.mark.parametrize("block", [1, 3, 100])
def test_clean_with_blocks(spark, tmp_path, block):
    r = random.Random(3)
    names = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(r.choice(names) for _ in range(30))) for k in range(8)]
    rows = []
    for i in range(120):
        words = [r.choice(names) for _ in range(60)]
        if i % 5 == 0:
            words[20:20] = items[i % 8][1].split()[5:17]
        rows.append((i if i != 7 else None, " ".join(words) if i % 11 else None, "en"))
    rows += [rows[5], rows[6], (1, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs, benchmark = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([*items, (None, None), ("e", "")], "item_id string, text string")
    dirty = {x[1] for x in rows if x[1] and any(" ".join(t.split()[k : k + 10]) in x[1] for _, t in items for k in range(21))}
    got = decontaminate.clean(docs, benchmark, block=block)
    assert got.columns == docs.columns and len(dirty) > 15
    assert sorted(map(tuple, got.collect()), key=str) == sorted((x for x in rows if x[1] not in dirty), key=str)
