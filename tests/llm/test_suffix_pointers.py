"""Texts made so that running sums over them agree: nothing of them may be taken for repeated."""

import numpy as np
import pytest

from provlake.llm import suffixes
from provlake.llm.common import eights, mixed


def letters(r, n):
    return bytes(r.integers(97, 123, n, dtype=np.uint8))


def twin_blocks(r, base, bits):
    """Two 16-byte blocks with equal first 7 bytes whose own sums, followed by such a block, agree in the low `bits`."""
    head, n = letters(r, 7), 1 << 19
    rows = np.empty((n, 23), np.uint8)
    rows[:, :7] = rows[:, 16:] = np.frombuffer(head, np.uint8)
    rows[:, 7:16] = r.integers(97, 123, (n, 9), dtype=np.uint8)
    flat = eights(rows.ravel()).reshape(n, 23)[:, :16].astype(np.uint64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(15, base, np.uint64)], dtype=np.uint64)
    low = (mixed(flat) * up).sum(1, dtype=np.uint64) & np.uint64((1 << bits) - 1)
    order = np.argsort(low, kind="stable")
    (at, *_) = np.flatnonzero(low[order][1:] == low[order][:-1])
    return head, bytes(rows[order[at], :16]), bytes(rows[order[at + 1], :16])


@pytest.mark.parametrize("base", [0xD6E8FEB86659FD93, suffixes._GRAM])
def test_texts_with_equal_sums(spark, tmp_path, base):
    r = np.random.default_rng(8)
    head, x, y = twin_blocks(r, base, 36)
    middle = min((head + letters(r, 57) for _ in range(20_000)), key=sums)
    signs = [bin(i).count("1") % 2 for i in range(16)]  # the Thue-Morse order
    texts = [b"".join(t[s] for s in signs[:8]) + middle + b"".join(t[s] for s in signs[8:]) + head for t in ((x, y), (y, x))]
    data = [np.frombuffer(t, np.uint8) for t in texts]
    whole = [int(suffixes.pointers(d, np.array([0]), np.array([len(d)]), base)[0]) for d in data]
    assert whole[0] == whole[1] and texts[0] != texts[1]
    shared = {texts[0][i : i + 200] for i in range(128)} & {texts[1][i : i + 200] for i in range(128)}
    row, first, n, pos, _ = suffixes._designated(data[0], np.array([0, 327]), 200, 64)
    assert not shared and (first[0], n[0], pos[0]) == (0, 128, 128)  # all windows stand with the string in the middle
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(2, texts[0].decode()[:250] + "!" * 300), (3, "?" * 199 + "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {d.doc_id: (d.n_removed, d.n_spans) for d in suffixes.dedup(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {0: (250, 1), 1: (0, 0), 2: (550, 1), 3: (0, 0)}


def sums(gram):
    """The bucket of 64 bytes."""
    return suffixes._designated(np.frombuffer(gram, np.uint8), np.array([0, 64]), 64, 64)[4][0]
