"""Each operator against a plain, brute-force version, with odd rows among the ordinary ones."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provlake.llm import bpe, decontaminate, katz, quality, reshard, simhash, suffixes, tokenfile, transcripts, urls
from provlake.llm.components import connected_components
from provlake.llm.packed import unpack64

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, n int, bucket int, _row int"


def prose(r, n):
    return " ".join(r.choice(["the", "a", "Cat", "sat", "été", "mat,", "on", "x1", "dog.\nThe", "über"]) + r.choice(["", "s", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = [prose(r, r.randrange(1, 120)) for _ in range(25)]
    near = [b.replace("the", "a", 1) for b in base[:6]]
    long = prose(r, 30_000)
    out = base + near + base[:4] + [base[5]] * 5 + ["", "  \n\t ", None, None, "!!! ...", "a" * 3000, "ab" * 700, long, "日本 語 \U0001f600 \u3000 x", "w" + "\x00" + " <|endoftext|> z"]
    return [(i if i != 30 else None, t) for i, t in enumerate(out)] + [(7, out[7]), (7, out[7])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None, 1, "d", 2, 3, 4) for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def files(docs, tmp_path_factory):
    """The documents as files, which give the same partitions each time."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [bpe.query(none, PATH), reshard.query(none), decontaminate.query(none, bench), katz.query(none), quality.query(none), simhash.query(none), suffixes.query(none), tokenfile.query(none, PATH),
              urls.query(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")),
              transcripts.query(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))]
    for df in frames:
        assert df.collect() == []


def test_bpe_and_token_files(files, texts):
    tok = Tokenizer.from_file(PATH)
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in texts]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = bag((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tok.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(texts, ids))
    assert bag(bpe.query(files, PATH).collect()) == want
    small = bpe.decode(bpe.encode(files, PATH, parts=3, limit=500), PATH)  # blocks of a few rows each
    assert bag((r.doc_id, len(r.ids) // 4, sha(r.ids), sha(r.text.encode())) for r in small.collect()) == want

    order = sorted(zip(texts, ids), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, (x[0][1] or "").encode()))
    at, want = 0, []
    for (i, _), x in order:
        full = np.array([*x, 2], "<u4")
        want.append((i, at, len(full), zlib.crc32(full.tobytes())))
        at += len(full)
    assert bag(tokenfile.query(files, PATH).collect()) == bag(want)
    assert bag(tokenfile.read_back(tokenfile.write(files, PATH, size=100)).collect()) == bag(want)


def test_words_with_one_polynomial_hash(spark, tmp_path):
    """Thue-Morse words and their complements, which every polynomial hash modulo 2^64 takes for one."""
    w = "a"
    while len(w) < 2048:
        w += w.translate(str.maketrans("ab", "ba"))
    rows = [(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, w[:1024]), (4, w[1024:2048])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    tok = Tokenizer.from_file(PATH)
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4") for i, t in rows}
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe.query(docs, PATH).collect()} == {i: (hashlib.sha256(ids[i].tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in tokenfile.query(docs, PATH).collect()} == {i: zlib.crc32(np.r_[ids[i], 2].astype("<u4").tobytes()) for i in ids}
    got = {r.doc_id: r.n_known for r in katz.score(docs, F.col("doc_id") == 1).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 1}


def test_hashes_that_collide(monkeypatch):
    from provlake.llm import common

    real = common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda *x: real(*x) % np.uint64(3))
    data = b"one two three two one " * 3 + b"x" * 100 + b" " + b"x" * 99 + b"y"
    starts, ends, _ = common.word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    _, first, which = common.distinct_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert [data[starts[first[w]] : ends[first[w]]] for w in which] == data.split() and len(first) == 5


def test_two_tokenizers_in_one_session(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string").coalesce(1)
    for path in (PATH, public_tokenizers.path("word_bpe_49k.json"), PATH):
        want = np.array([*Tokenizer.from_file(path).encode("the cat sat on the mat", add_special_tokens=False).ids, 2], "<u4")
        assert tokenfile.query(docs, path).first().ids_crc32 == zlib.crc32(want.tobytes())


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in [(0, 0), (1, 0), (5, 3), (200, 50), (1000, 10**6)]:
        v = np.sort(r.integers(0, top + 1, n))
        for v in (v, v + 70_000 * (np.arange(n) > n // 2)):  # also with a wide gap
            code = tokenfile.EliasFano.of(v)
            assert code.select(np.arange(n)).tolist() == v.tolist()
            some = r.permutation(n)[: n // 3]
            assert code.select(some).tolist() == v[some].tolist()


def test_min_cost_flow():
    moves = reshard.min_cost_flow([10, 4, 7], [6, 6, 6, 3])
    assert sum(b for *_, b in moves) == 21 and sum(b for i, j, b in moves if i != j) == 5
    assert all(sum(b for _, k, b in moves if k == j) <= c for j, c in enumerate([6, 6, 6, 3]))
    assert reshard.min_cost_flow([0, 0], [0]) == []
    with pytest.raises(ValueError, match="capacities"):
        reshard.min_cost_flow([5], [4])


def test_reshard(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(200)) for i in range(600)] + [(5, "same")] * 20 + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed, moves = reshard.place(df, F.pmod(F.xxhash64("doc_id"), F.lit(4)), 4, 6)
    got = placed.collect()
    assert bag((x.doc_id, x.size, x.text_crc32) for x in got) == bag((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(6):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    sizes = [sum(x.size for x in got if x.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 6
    moved = sum(x.size for x in got if x.shard != x.old_shard)
    assert abs(moved - sum(b for i, j, b in moves if i != j)) < 500
    with pytest.raises(RuntimeError, match="changed"):
        reshard.rewrite(df.limit(10), placed, moves, str(tmp_path / "less"))
    odd = spark.createDataFrame([(i % 3, "same", i, {"k": i}) for i in range(50)] + [(None, None, 7, None)], "doc_id long, text string, slot int, shard map<string,int>")
    for name, df_, of in (("out", df, (4, 6)), ("odd", odd, (2, 3))):  # rows alike but in other columns, and columns with names of ours
        placed, moves = reshard.place(df_, F.pmod(F.xxhash64("doc_id"), F.lit(of[0])), *of)
        touched = reshard.rewrite(df_, placed, moves, str(tmp_path / name))
        files = spark.read.parquet(str(tmp_path / name)).collect()
        assert touched == list(range(of[1])) and sorted(map(str, (x.row for x in files))) == sorted(map(str, df_.collect()))
        assert {(x.shard, x.slot) for x in files} == {(x.shard, x.slot) for x in placed.collect()}
    assert bag(x[:3] for x in reshard.query(df).collect()) == bag((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)


def test_min_cost_flow_equals_brute_force():
    r = random.Random(3)

    def least(sizes, room):
        """Every way to spread the first shard's bytes, then the others'."""
        if not sizes:
            return 0
        shard, size, best = sizes[0][0], sizes[0][1], math.inf
        for split in itertools.product(*(range(min(size, x) + 1) for x in room)):
            if sum(split) == size:
                best = min(best, size - (split[shard] if shard < len(room) else 0) + least(sizes[1:], [a - b for a, b in zip(room, split)]))
        return best

    for _ in range(40):
        sizes = [r.randrange(5) for _ in range(r.randrange(1, 4))]
        room = [r.randrange(6) for _ in range(r.randrange(1, 4))]
        if sum(room) >= sum(sizes):
            moves = reshard.min_cost_flow(sizes, room)
            assert sum(b for i, j, b in moves if i != j) == least(list(enumerate(sizes)), room)
            assert all(sum(b for i, _, b in moves if i == k) == s for k, s in enumerate(sizes)) and all(sum(b for _, j, b in moves if j == k) <= c for k, c in enumerate(room))


def test_decontamination(spark, files, texts):
    r = random.Random(2)
    pool = [t for _, t in texts if t and len(words(t)) > 30]
    items = [(i, " ".join(words(r.choice(pool))[3:17])) for i in range(6)] + [(90, "cat"), (91, "Cats sat!"), (92, ""), (93, None), (None, "mat on the"), (3, "zz yy xx ww vv"), (94, " ".join(words(pool[0])[-9:]))]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    want = []
    for i, t in texts:
        w, hit, found = find(t), set(), set()
        for name, x in items:
            q = find(x)
            n = min(10, len(q))
            wins = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add("" if name is None else str(name))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert bag(decontaminate.query(files, bench).collect()) == bag(want)
    many = decontaminate.measure(files, bench, block=3)  # several blocks of items
    assert bag((x.doc_id, x.n_words, x.n_hit, len(x["items"])) for x in many.collect()) == bag(x[:4] for x in want)
    kept = decontaminate.clean(files, bench)
    assert kept.schema.names == files.schema.names and kept.count() == sum(not x[-1] for x in want)


def katz_brute(rows, order, k=5):
    tokens = [[*words(low(t)), "</s>\n"] for _, t in rows]
    trains = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    grams = [collections.Counter() for _ in range(order + 1)]  # by length; longer contexts than the text has are none
    for use, w in zip(trains, tokens):
        full = ["<s>\n", *w]
        for n in range(1, order + 1):
            if use:
                grams[n].update(tuple(full[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(full)))

    def discount(counts):
        n = [0, *(sum(v == r for v in counts.values()) for r in range(1, k + 2))]
        d = dict.fromkeys(range(1, k + 1), 1.0)
        if n[1] and n[1] != (k + 1) * n[k + 1]:
            a = (k + 1) * n[k + 1] / n[1]
            for r in d:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] else 1
                d[r] = x if 0 < x < 1 else 1.0
        return lambda r: d.get(r, 1.0)

    uni, total = grams[1], sum(grams[1].values())
    d = [None, *map(discount, grams[1:])]
    lost = sum((1 - d[1](v)) * v for v in uni.values())
    scale, unknown = (total, lost / total) if lost else (total + 1, 1 / (total + 1))
    after = collections.defaultdict(dict)
    for n in range(2, order + 1):
        for g, v in grams[n].items():
            after[g[:-1]][g[-1]] = v

    def p(h, w):
        if not h:
            return d[1](uni[w,]) * uni[w,] / scale if uni[w,] else unknown
        if h not in after:
            return p(h[1:], w)
        return d[len(h) + 1](after[h][w]) * after[h][w] / size[h] if w in after[h] else alpha[h] * p(h[1:], w)

    size, alpha = {}, {}
    for h in sorted(after, key=len):
        seen = after[h]
        n, left = sum(seen.values()), sum((1 - d[len(h) + 1](v)) * v for v in seen.values())
        n, left = (n, left) if left > 0 else (n + 1, 1)
        size[h], alpha[h] = n, left / n / (1 - sum(p(h[1:], x) for x in seen))
    for h in sorted(after)[:: max(1, len(after) // 30)]:  # all words and the unknown one
        assert math.isclose(sum(p(h, w) for w, in uni) + p(h, "never\n"), 1)
    score = lambda w: sum(math.log10(p(tuple(["<s>\n", *w][max(0, i - order + 2) : i + 1]), x)) for i, x in enumerate(w))
    return [(i, not use, len(w), sum(uni[x,] > 0 for x in w), total, sum(math.log10((uni[x,] + 1) / (total + len(uni) + 1)) for x in w), score(w)) for (i, _), use, w in zip(rows, trains, tokens)], grams


@pytest.mark.parametrize(("order", "limit"), [(2, 1 << 23), (3, 1 << 23), (3, 800), (4, 3000)])
def test_katz(files, texts, order, limit, tmp_path):
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    got = sorted(katz.score(files, F.crc32(name) % 7 != 2, order, parts=3, limit=limit, model=str(tmp_path / "model")).collect(), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    want, grams = katz_brute(texts, order)
    want.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    tables = files.sparkSession.read.parquet(str(tmp_path / "model")).collect()
    for n in range(1, order + 1):  # the stored counts are those of the texts
        counts = np.concatenate([unpack64(x.payload)[-1] for x in tables if x.order == n])
        assert sorted(counts[counts > 0].tolist()) == sorted(grams[n].values())


def test_katz_without_training(spark, files):
    got = katz.score(files, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_quality_base(files, texts):
    want = []
    for i, t in texts:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        spots = {q for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for q in range(k, k + 3)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(spots), len(w) < 50 or 100 * len(spots) > 50 * len(w)))
    assert bag(x[:7] for x in quality.query(files).collect()) == bag(want)


def test_quality_lines(spark):
    r = random.Random(5)
    body = lambda: " ".join(str(r.random()) for _ in range(60))
    rows = [(i, f"Share  this page NOW\n{body()}", "a") for i in range(40)] + [(100 + i, ("share this page now\n" * 60) + f"tail {i} {body()[:40]}", "a") for i in range(5)]
    rows += [(200 + i, "exact copy\n" + "x y z q w " * 1 + " ".join(map(str, range(60))), "b") for i in range(60)] + [(300, "Share this page now\n" + body(), None), (301, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {x.doc_id: x.kept for x in quality.query(df).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(5))
    assert all(kept[200 + i] for i in range(60))  # copies alone are no boilerplate
    assert kept[300] and not kept[301]
    nulls = spark.createDataFrame([(i, f"same line here\n{body()}" if i < 20 else body(), "a") for i in range(399)] + [(900 + i, None, "a") for i in range(5)], "doc_id long, text string, source string")
    assert quality.boilerplate(quality.line_table(nulls)).count() == 1  # 20 of 399 documents; null texts are none
    assert quality.boilerplate(quality.line_table(df.where("source = 'b'")), copies=True).count() == 2  # rows count, if asked for
    out = {x.doc_id: x.text for x in quality.filtered(df).collect()}
    assert "NOW" not in out[3] and out[300].startswith("Share") and len(out) == sum(kept.values())


def test_simhash(spark, files, texts):
    def fp(t):
        w = words(low(t))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    def components(prints, most):
        up = list(range(len(prints)))
        def top(a):
            while up[a] != a:
                a = up[a]
            return a
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= most:
                    up[top(i)] = top(j)
        return [top(i) for i in range(len(prints))]

    prints = [fp(t) for _, t in texts]
    for most, segments, tile in [(4, 2, 2048), (12, 2, 2), (7, 3, 5)]:
        root = components(prints, most)
        least = {q: min((i for (i, _), x in zip(texts, root) if x == q and i is not None), default=None) for q in set(root)}
        want = bag((i, p - (1 << 64) if p >> 63 else p, least[q]) for (i, _), p, q in zip(texts, prints, root))
        got = simhash.near_duplicates(files, most=most, segments=segments, tile=tile).select("doc_id", "low", "component_id")
        assert bag(got.collect()) == want
    kept = simhash.keep_first(files)
    assert kept.schema.names == files.schema.names
    assert bag([x.doc_id] for x in kept.collect() if x.doc_id is not None) == bag([[q] for q in {least_ for least_ in (x.component_id for x in simhash.near_duplicates(files).collect()) if least_ is not None}])


def test_similar_texts(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows, near = [], []
    for g in range(60):
        w = [word() for _ in range(200)]
        rows.append((2 * g, " ".join(w)))
        for k in r.sample(range(20, 180), 3):
            w[k] = word()
        near.append(2 * g + 1)
        rows.append((2 * g + 1, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(r.randrange(5, 200)))) for i in range(300)]
    kept = {x.doc_id for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR).collect()}
    assert all(2 * g in kept for g in range(60)) and all(1000 + i in kept for i in range(300))
    assert sum(i in kept for i in near) <= 6  # similarity 0.86 and more: nine tenths are found at least


def test_similar_sets_with_repeats(spark):
    """Copies in which a line or passage is repeated have nearly the set of their original; brute force says which must go."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for g in range(60):
        w = [word() for _ in range(200)]
        a, n, times = r.randrange(150), r.choice([20, 40]), r.choice([3, 5, 8, 20])
        rows += [(2 * g, " ".join(w)), (2 * g + 1, "\n".join([" ".join(w[: a + n]), *[" ".join(w[a : a + n])] * times, " ".join(w[a + n :])]))]
    rows += [(1000 + i, " ".join(word() for _ in range(r.randrange(5, 200)))) for i in range(100)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    alike = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])}
    assert alike == {(2 * g, 2 * g + 1) for g in range(60)}
    kept = {x.doc_id for x in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR).collect()}
    assert kept >= sets.keys() - {j for _, j in alike}
    assert sum(j in kept for _, j in alike) <= 2  # a similarity of 0.9 and more: 13 bits apart on average


def test_similar_is_exact(spark, texts):
    """All fingerprints as one candidate component, dealt to tiles of a few texts: the links are those of the Jaccard similarity."""
    r = random.Random(3)
    rows = list(texts)
    for i in range(40):
        w = prose(r, 150).split(" ")
        rows.append((100 + 2 * i, " ".join(w)))
        for k in r.sample(range(150), 1 + i % 4):
            w[k] = "new"
        rows.append((101 + 2 * i if i else None, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {}
    for _, t in rows:
        w = words(low(t))
        sets.setdefault(simhash.simhash((t or "").encode(), 5, bits=128), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    prints = simhash.fingerprints(docs, 5, bits=128)
    ids = prints.groupBy("fp").agg(F.first("high").alias("high"), F.first("low").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("rep"))
    node = {(x.high % (1 << 64), x.low % (1 << 64)): x.fp for x in ids.collect()}
    assert len(node) == len(sets)
    hub = min(node.values())
    found = ids.select("fp", F.lit(hub).alias("hub")).toDF("a", "b")
    alike = [(node[p], node[q]) for p, a in sets.items() for q, b in sets.items() if p < q and a | b and len(a & b) / len(a | b) >= 0.8]
    assert len(alike) > 20

    def groups(links):
        up = {x: x for x in node.values()}
        for a, b in links:
            old, new = up[a], up[b]
            up = {k: new if v == old else v for k, v in up.items()}
        return {frozenset(k for k, v in up.items() if v == g) for g in set(up.values())}

    for size in ({}, {"texts": 7}, {"words": 400}):
        got = simhash.similar(docs, ids, found, 0.8, 5, 128, **size).collect()
        assert groups((x.a, x.b) for x in got) == groups(alike)


def test_keep_first_with_repeated_ids(spark):
    """Different texts under one id stay or go each with its own component; of rows alike in id and text the same one stays."""
    r = random.Random(5)
    a, b, c, d = (prose(r, 90) for _ in range(4))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (6, c, "x"), (6, d, "x"), (7, c, "x"), (7, b, "x"), (8, d, "x"), (None, a, "x"), (None, a, "x")] + [(6, c, s) for s in "pqrst"]
    got = [simhash.keep_first(spark.createDataFrame(given, "doc_id long, text string, source string").repartition(3)).collect() for given in (rows, rows[::-1])]
    assert bag(got[0]) == bag(got[1])  # the order of the rows does not matter
    assert bag((x.doc_id, x.text) for x in got[0]) == bag([(1, a), (5, b), (6, c), (6, d), (None, a), (None, a)])
    alike = simhash.keep_first(spark.createDataFrame([(3, "", "x"), (3, None, "x"), (3, " ", "y")], "doc_id long, text string, source string")).collect()
    assert len(alike) == 1  # one component, one id: one text


def test_components(spark):
    r = random.Random(6)
    path = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (201, 200), (200, 201)]
    r.shuffle(path)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[100 + i] for i in range(30)}) == 1 and got[200] == got[201] and len(set(got.values())) == 3


@pytest.mark.parametrize("limit", [1 << 22, 700])
def test_suffixes(files, texts, limit):
    size = 30
    raw = [(t or "").encode() for _, t in texts]
    count = collections.Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    want = []
    for (i, _), t in zip(texts, raw):
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if count[t[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        want.append((i, len(t), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), bytes(b for b, g in zip(t, gone) if not g)))
    got = suffixes.dedup(files, size=size, gram=12, limit=limit)
    assert bag((*x[:4], bytes(x[4])) for x in got.collect()) == bag(want)
    clean = suffixes.cleaned(files, size=size, gram=12, limit=limit)
    assert clean.schema.names == files.schema.names and bag([x.text] for x in clean.collect() if x.text) == bag([t.decode(errors="ignore")] for *_, t in want if t.decode(errors="ignore"))


def test_urls(spark):
    given = ["http://a.net/", "HTTP://X.Example.NET/en/a?b", "foo", None, "http://ORG/fr/1", "a://b.example.com/de/x#y", "a://xexample.com/de/", "x://y.org?fr/", "http://a.net", "http://e.org#/x"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(given)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.query(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {0: ("a.net", "/", "net/", "block"), 1: ("x.example.net", "/en/a", "example.net/en/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("org", "/fr/1", "org/fr/", "allow"),
                   5: ("b.example.com", "/de/x", "example.com/de/", "block"), 6: ("xexample.com", "/de/", None, "allow"), 7: ("y.org", "", None, "allow"), 8: ("a.net", "", None, "allow"), 9: ("e.org", "", None, "allow")}


def test_url_templates(spark):
    rows = [(i, f"http://h.info/{'bad' if i % 2 else 'good'}/{i}/page.html") for i in range(400)] + [(1000 + i, f"http://k.info/u/name{i}x/z") for i in range(50)] + [(None, "http://h.info/good/9/page.html"), (1, "http://h.info/bad/1/page.html")]
    labels = [(i, i % 2) for i in range(200)] + [(5, None)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[301].template == "/bad/*/page.html" and by[301].verdict == "block" and by[300].verdict == "allow"  # unlabelled pages follow their template
    assert by[1003].template == "/u/*/z"


def test_long_paths(spark):
    """A url of a thousand segments, alone or shared up to its end, takes few rounds and keeps its template."""
    deep = "/" + "/".join("abcdefgh"[i % 8] for i in range(1000))
    rows = [(0, f"http://h.io{deep}/left"), (1, f"http://h.io{deep}/right"), (2, "http://h.io/x/y"), (3, f"http://k.io{deep}"), (4, "http://h.io/x")]
    got = {r.page_id: r.template for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(0, 0), (1, 1)], "page_id long, bad int"), rules=[]).collect()}
    assert got[3] == deep and got[0] == got[1] == f"/*/*{deep[4:]}/*" and got[2] == "/*/*" and got[4] == "/*"


def test_rare_directory_with_bad_labels(spark):
    """Of 30 kinds of one host, one with 0.5 % of the pages and bad labels only stays literal and is blocked; one with a few labels merges."""
    names = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(28)]
    paths = [f"/{names[i % 28]}/p" for i in range(9_930)] + ["/spam/p"] * 50 + ["/tiny/p"] * 20
    labels = [(i, int(i % 50 == 0 or i >= 9_930)) for i in range(9_983)]
    pages = spark.createDataFrame([(i, f"http://h.info{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge(pages, spark.createDataFrame(labels, "page_id long, bad int"), rules=[]).collect()}
    assert {got[i] for i in range(9_930, 9_980)} == {("/spam/p", "block")}
    assert {got[i] for i in range(9_980, 10_000)} == {("/*/p", "allow")}


def test_transcripts(spark):
    r = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(r.randrange(2, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", prose(r, r.randrange(3, 12 if t % 2 == 0 else 60))))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", prose(r, 9)) for t in range(400)] + [(2000, 0, None, None), (None, 0, "user", "Hi"), (3000, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    true = {(c, t): role for c, t, role, _ in rows}
    got = transcripts.query(df).collect()
    right = sum(x.role == true[(x.conv_id, x.block)] for x in got if zlib.crc32(str(x.conv_id).encode()) % 5 == 0 and x.conv_id is not None)
    held = sum(zlib.crc32(str(x.conv_id).encode()) % 5 == 0 for x in got if x.conv_id is not None)
    assert held > 20 and right >= 0.9 * held
    assert all(x.text.startswith(f"<|{x.role}|>\n") for x in got)
    raw = transcripts.render(df)
    model = transcripts.fit(transcripts.lines_of(raw).join(raw.select("conv_id", "block", "role"), ["conv_id", "block"]))
    whole, cut = ({(x.conv_id, x.block, x.pos): x.role for x in transcripts.parse(raw, model, chunk=n).collect()} for n in (4096, 7))
    assert whole == cut and len(whole) > 500  # cutting a transcript into chunks changes nothing


def test_transcript_as_one_text(spark):
    """Turn boundaries are found within one text; blank lines and later markers stay; empty turns have rows."""
    r = random.Random(9)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "\n\n".join(prose(r, 9).replace("\n", " ") for _ in range(1 + t % 2 * 2))) for c in range(60) for t in range(6)]
    model = transcripts._fitted(transcripts.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    text = "User: one\nAssistant: two\n\nthree\nUser: \nAssistant: four"
    parts = [(1, 0, text), (2, 0, "User: one\nAssistant: two\n"), (2, 1, "three\nUser: \nAssistant: four")]
    parsed = transcripts.parse(spark.createDataFrame(parts, "conv_id long, block long, text string"), model)
    want = ["<|user|>\none", "<|assistant|>\ntwo\n\nthree", "<|user|>\n", "<|assistant|>\nfour"]
    for size in (4096, 2):
        got = sorted((x.conv_id, x.turn, x.text) for x in transcripts.turns(parsed, size).collect())
        assert got == [(c, i + 1, t) for c in (1, 2) for i, t in enumerate(want)]
    odd = transcripts.query(spark.createDataFrame([*rows, (900, 0, "user", None), (900, 1, "assistant", ""), (901, 0, None, None)], "conv_id long, turn long, role string, text string")).collect()
    assert {(x.block, x.text) for x in odd if x.conv_id == 900} == {(0, "<|user|>\n"), (1, "<|assistant|>\n")}
    assert sum(x.conv_id == 901 for x in odd) == 1


def url_brute(pages, labels, rare, many, z, purity, prior):
    """Templates and verdicts without rules, one page at a time."""
    code = re.compile(r"^(?=.*[0-9])[0-9A-Za-z_.-]*$|^.{40,}$")
    bad = {}
    for p, b in labels:
        bad[p] = max(b, bad.get(p, 0))
    rows = [[h, ["*" if code.search(s) else s for s in path.split("/") if s], "", 1 - bad[p] if p in bad else 0, bad.get(p, 0)] for p, h, path in pages]
    for level in range(max((len(r[1]) for r in rows), default=0)):
        by = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0]))
        for h, s, t, g, b in rows:
            if level < len(s):
                c = by[h, t][s[level]]
                c[0], c[1], c[2] = c[0] + 1, c[1] + g, c[2] + b
        step = {}
        for key, kinds in by.items():
            n, good, ill = (sum(c[i] for c in kinds.values()) for i in range(3))
            for x, (k, g, b) in kinds.items():
                one, rest = g + b, good + ill - g - b
                differs = False
                if one and rest:
                    p = ill / (one + rest)
                    differs = abs(b / one - (ill - b) / rest) > z * math.sqrt(p * (1 - p) * (1 / one + 1 / rest))
                step[key, x] = "*" if x == "*" or (len(kinds) >= many and k < rare * n) or (len(kinds) > 1 and not differs) else x
        for r in rows:
            if level < len(r[1]):
                r[2] += "/" + step[(r[0], r[2]), r[1][level]]
    sums = collections.defaultdict(lambda: [0, 0])
    for h, _, t, g, b in rows:
        for key in ((h, t), h, None):
            sums[key][0] += g
            sums[key][1] += b
    corpus = (sums[None][0] + 1) / (sum(sums[None]) + 1)
    out = []
    for (p, h, path), (_, _, t, _, _) in zip(pages, rows):
        host = (sums[h][0] + prior * corpus) / (sum(sums[h]) + prior)
        own = (sums[h, t][0] + prior * host) / (sum(sums[h, t]) + prior)
        out.append((p, h, path, t, "block" if own < purity else "allow"))
    return out


def test_url_tree_equals_brute_force(spark):
    r = random.Random(11)
    pages, labels = [], []
    for i in range(900):
        h = r.choice(["a.io", "a.io", "a.io", "b.io", "c.d.io"])
        path = "/" + "/".join(r.choice([["news", "spam", "en", f"n{i}", "x" * 45], ["a", "b", f"{i}"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"]][k % 3]) for k in range(r.randrange(0, 5)))
        pages.append((i if i % 50 else None, h, path))
        if i % 3:
            labels.append((i, int(("spam" in path) if r.random() < 0.9 else r.random() < 0.3)))
    labels += labels[:20] + [(9999, 1)]
    how = {"rare": 0.03, "many": 10, "z": 1.96, "purity": 0.5, "prior": 5.0}
    df = spark.createDataFrame([(p, f"http://{h}{path}") for p, h, path in pages], "page_id long, url string")
    got = urls.judge(df, spark.createDataFrame(labels, "page_id long, bad int"), rules=[], **how)
    assert bag((x.page_id, x.host, x.path, x.template, x.verdict) for x in got.collect()) == bag(url_brute(pages, labels, **how))
