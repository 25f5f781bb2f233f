"""Merkle manifests, periodic runs and token counts against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provlake.llm import merkle, periodic, tokencounts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, n int, pos int, runs int, key string, low int, path string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, n, "d", "t", 1, 2, 3, "k", 4, "p") for i, t, lang, src, n in rows], SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# merkle


def tree_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(levels, i):
    """The other nodes of each run on the way up, and where the own one stands in it."""
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        yield i % 8, run[: i % 8] + run[i % 8 + 1 :]
        i //= 8


def manifest_brute(rows):
    def leaf(i, t, lang, src, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, src, lang, n, t)))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_levels([y[2] for y in sorted(groups[x], key=lambda y: y[:3])]) for x in langs}
    top = tree_levels([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(groups[x], key=lambda y: y[:3])):
            steps = [*proof(trees[x], i), *proof(top, j)]
            due = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:]) if due else own
            for k, others in steps:
                now = sha("".join(others[:k] + [now] + others[k:]))
            out.append((r[0], own, trees[x][-1][0], top[-1][0], sha("".join(y for _, o in steps for y in o)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels, monkeypatch):
    r = random.Random(levels)
    rows = [(i, r.choice(["Abc dé", "x Y", "", None, "plain"]), r.choice(["en"] * 5 + ["de", None]), r.choice(["s", None]), i) for i in range(190)]
    rows += [(500 + i, "T", f"l{i:02}", "s", None) for i in range(11)] + [(7, "a", "en", None, 1)] * 3 + [(None, "A", "en", "s", 2), (None, "A", None, "s", 2), (1, "q", "é", "s", 2)]
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda docs: whole(docs, levels))
    got = merkle.query(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == manifest_brute(rows)


def test_manifest_of_few(spark):
    one = merkle.query(table(spark, [(3, "Ab", "en", "s", 2)])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    assert merkle.query(table(spark, [(1, "x", "en", "s", 1)]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512, 700])
def test_traversal_is_ready_in_time(n):
    leaves = [bytes([i % 256, i // 256]) * 16 for i in range(n)]
    levels = tree_levels([x.hex() for x in leaves])
    depth = merkle.height(n, 9)
    assert depth == len(levels) - 1 and merkle.block_root(leaves, depth).hex() == levels[-1][0]
    for i, runs in enumerate(merkle.traversal(leaves, depth)):
        assert [[x.hex() for x in run[: i // 8**h % 8] + run[i // 8**h % 8 + 1 :]] for h, run in enumerate(runs)] == [o for _, o in proof(levels, i)]


def test_treehash_holds_little():
    tree = merkle.Treehash(4)
    for i in range(8**4 - 1):
        tree.update(i.to_bytes(32))
        assert sum(map(len, tree.stack)) <= 7 * 4


# periodic


def runs_brute(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda x: (x[0], x[2]))


def collapsed_brute(w, runs):
    return " ".join(x for j, x in enumerate(w) if not any(a + q <= j < a + n for a, n, q in runs))


def repetitive(r):
    out = []
    for _ in range(r.randrange(1, 6)):
        names = [str(i) for i in range(r.choice([1, 2, 3, 30]))]
        out += [r.choice(names) for _ in range(r.randrange(1, 40))] * r.randrange(1, 8)
        out = out[: len(out) - r.randrange(3)]
    return out


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(12)
    out = [(i, r.choice([" ", "\n", " \t "]).join(repetitive(r))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " \n"), (203, "x"), (204, "a " * 3000), (205, "é b " * 500 + "c"), (None, "z " * 30), (7, "z " * 30), (7, "z " * 30), (206, " ".join(map(str, range(900))) + " y" * 24)]
    out += [(300 + i, " ".join(r.choice("abcde") for _ in range(r.randrange(1, 300)))) for i in range(60)]
    return out


@pytest.mark.parametrize("share", [4, 1 << 14])
def test_periodic_runs(spark, repeats, share, monkeypatch):
    """With shares of 4 lags most texts are dealt out."""
    monkeypatch.setattr(periodic, "_LONG", 64)
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in repeats])
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic(docs, share=share, limit=5000).collect()), key=str)
    want = []
    for i, t in repeats:
        w = re.findall(r"[^ \t-\r]+", t or "")
        want.append((i, runs_brute(w), collapsed_brute(w, runs_brute(w))))
    assert got == sorted(want, key=str)


def test_periodic_query(spark, repeats):
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in repeats])
    want = []
    for i, t in repeats:
        w = re.findall(r"[^ \t-\r]+", t or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = runs_brute(w)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed_brute(w, runs))))
    assert sum(x[1] for x in want) > 50
    assert sorted(map(tuple, periodic.query(docs).collect()), key=str) == sorted(want, key=str)
    assert periodic.query(docs.limit(0)).count() == 0


def test_shares_find_what_one_scan_finds(repeats):
    words = periodic.Words(pa.array([t for _, t in repeats]))
    whole = {tuple(x) for x in words.runs(6, 4).tolist()}
    dealt = {tuple(x) for low in range(1, 1400, 9) for x in words.runs(6, 4, low, low + 9).tolist()}
    assert whole == dealt and len(whole) > 100


# token counts

MIXED = ["a", "b ", " c", "  ", "9", "▁", "é", ".", "\n", "日", "<s>", "<|endoftext|>", "'s", "The quick", "\U0001f600"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("batch", [64, 1 << 22])
def test_token_counts(spark, name, batch):
    r = random.Random(13)
    texts = ["".join(r.choice(MIXED) for _ in range(r.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 5000, "words of a long text, which goes on. " * 3000, "a b", " b"]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        tok.no_truncation(), tok.no_padding()
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 1024) for i, t in rows]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = tokencounts.counts(docs, path, batch=batch, keep=50)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    one = tokencounts.summary(got).first()
    assert (one.documents, one.n_tokens, one.over, one.longest) == (len(rows), sum(x[2] for x in want), sum(x[3] for x in want), max(x[2] for x in want))
    assert tokencounts.query(docs.limit(0), path).count() == 0


def test_pieces_are_cut_at_safe_places_only():
    for name, safe in (("byte_bpe_50k.json", True), ("piece_bpe_32k.model", True), ("word_bpe_49k.json", False)):
        places, _ = tokencounts._splitter(public_tokenizers.path(name))
        data = np.frombuffer("one two, three".encode(), np.uint8)
        assert (len(places(data, np.array([0, len(data)]))) > 1) == safe
