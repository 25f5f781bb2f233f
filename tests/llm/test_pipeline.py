"""The pipeline's stages, each held against a plain version on what its predecessor kept."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from provlake.llm import decontaminate, quality, simhash, suffixes
from provlake.llm.queries import TOKENIZER
from tests.llm.test_operators import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    body = [prose(r, 90) + " " + " ".join(str(r.random()) for _ in range(70)) for _ in range(12)]
    passage = " ".join(str(r.random()) for _ in range(60))
    item = " ".join(str(r.random()) for _ in range(12))
    body[1] += " " + passage
    body[2] = passage + " " + body[2]
    body[3] += " " + item
    rows = [(i, t) for i, t in enumerate(body)] + [(50, body[0]), (51, body[4] + " tail"), (60, "too short"), (61, None), (62, ""), (63, "a b c " * 90)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, ids = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.schema.names == docs.schema.names
        rows = out.collect()
        kept[name], ids[name] = {r.doc_id: r for r in rows}, sorted(r.doc_id for r in rows)
        docs = spark.createDataFrame(rows, out.schema).coalesce(1) if rows else out
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    assert ids["quality_rules"] == [*range(12), 50, 51]
    assert ids["near_dedup"] == list(range(12))
    assert ids["substring_dedup"] == list(range(12))
    before, after = kept["near_dedup"], kept["substring_dedup"]
    for i in range(12):
        if i in (1, 2):
            assert len(after[i].text) < len(before[i].text) - 900 and after[i].n_chars == len(after[i].text)
        else:
            assert after[i].text == before[i].text
    assert ids["decontamination"] == [i for i in range(12) if i != 3]
    tok = Tokenizer.from_file(TOKENIZER)
    for i, r in kept["bpe"].items():
        assert r.n_tokens == len(tok.encode(kept["decontamination"][i].text, add_special_tokens=False).ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == ids["bpe"]


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert all(callable(x) for x in (quality.filtered, simhash.keep_first, suffixes.cleaned, decontaminate.clean))


def test_scratch_tables_go(spark):
    import os

    from provlake.llm.common import scratch, written

    with scratch(spark):
        gone, kept = (written(spark.range(3), "x", keep=k) for k in (False, True))
        assert gone.count() == 3
    assert kept.count() == 3 and os.path.exists(kept.inputFiles()[0].removeprefix("file://"))
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
