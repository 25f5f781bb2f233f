"""LM scoring: a Katz backoff model with Good-Turing discounts and exactly normalised backoff weights.

P(w | h) = d(c) c / c(h) for an n-gram h w seen c times (d: Good-Turing for c up to K, else 1), and
alpha(h) P(w | h') for others, where h' is h without its first word. Below all is the discounted
unigram probability, in which all unknown words together are one type that holds the mass the
discounts left. alpha(h) makes the probabilities after h sum to one. A context whose n-grams are
all too frequent to be discounted has one added to its count, and so always has something left.
At the start of a text contexts are as long as it allows, its start being a word of them.

The counts are tables partitioned by the hash of the context (by context and word for the at most
HOT contexts that hold over 1/HOT of all tokens, whose partial sums meet later). Blocks of
documents send each part their distinct n-grams once, packed in one row, with their training
counts; the part adds up its table, one part at a time, and answers each block with totals, and
with what is left for others where a context is asked for a word it was not seen with. Orders
follow one another: only contexts that were seen are asked about in the next. Each token is then
evaluated recursively, from the unigram up to the longest context seen. Only a few sums and the
hot contexts reach the driver.

Words are told apart by 64-bit hashes; contexts of two words by their words' numbers, the older
words of longer ones by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, distinct_spans, dropped, freeing, mixed, utf8, word_spans, written, written_apart
from .packed import ROW, by_block, by_part, column_of, joined, numbered, one_by_one, pack, pack64, rows, split, spread_over, together, unpack, unpack64, with_column

K = 5
HOT = 256
#: Numbers of the start of a text, its end, and unknown words; words follow.
START, END, UNKNOWN, FIRST = 0, 1, 2, 3
#: So many parts of the counts travel together and are added up one after the other.
_TOGETHER = 4
_END_KEY = np.uint64(1)
_LOWER = np.frombuffer(LOWER, np.uint8)
_ANSWER = f"{ROW}, kind string, h long, sums array<double>, often array<struct<h:bigint,n:double>>"


def discounts(counts: list[float]) -> np.ndarray:
    """d_1 to d_K from n_1 to n_(K+1) (Katz 1987); 1 where the counts give none between 0 and 1."""
    n = [0.0, *counts]
    out = np.ones(K + 1)
    if n[1] and n[1] != (K + 1) * n[K + 1]:
        rest = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r]:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                out[r] = d if 0 < d < 1 else 1.0
    return out


def _kept(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the discounts leave of each count."""
    return np.where(c > K, 1.0, d[np.minimum(c, K).astype(np.int64)]) * c


class Unigrams:
    """The discounted unigram probabilities, as a function of the count."""

    def __init__(self, total: float, types: float, counts: list[float]):
        self.total, self.types, self.d = total, types, discounts(counts)
        left = sum((1 - self.d[r]) * r * counts[r - 1] for r in range(1, K + 1))
        self.scale = total if left > 0 or not total else total + 1
        self.unknown = left / total if left > 0 else 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _kept(self.d, c) / max(self.scale, 1.0), self.unknown)


@dataclass
class Order:
    """What is known of the n-grams of one order: discounts, hot contexts, and of these the types seen 1 to K times and the mass that shorter contexts give to all seen."""

    hot: np.ndarray
    d: np.ndarray | None = None
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, K + 1)))


def _context(older: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(mixed(older) + last + np.uint64(7))


def _before(x: np.ndarray, first: np.ndarray, start=0) -> np.ndarray:
    """The value of the token before; `start` for the first of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def _left(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    r = np.arange(1, K + 1)
    return sums[:, :K] @ (r * (1 - d[1:]))


class _Block:
    """A block's tokens with the numbers and counts of their words."""

    def __init__(self, head: bytes, ids: np.ndarray, c: np.ndarray, texts: int):
        self.doc_id, rest = column_of(head)
        self.n, self.train, rank = (x.astype(np.int64) for x in unpack(rest))
        self.c = c[rank] if len(rank) else rank
        self.word = np.where(c > 0, np.arange(len(c)), len(c))[rank]  # within the block; unknown words are one
        self.id = np.where(c > 0, ids, np.uint64(UNKNOWN))[rank]
        self.first = np.zeros(len(rank), bool)
        self.first[(np.cumsum(self.n) - self.n)[self.n > 0]] = True
        self.trains = np.repeat(self.train, self.n)
        # of each token's context at order 2: whether it was seen, its place in the block, its words, its count
        self.ok = _before(self.c, self.first, texts) > 0
        self.place = _before(self.word + 1, self.first)
        self.older, self.last = np.zeros(len(rank), np.uint64), _before(self.id, self.first, START)
        self.total = _before(self.c, self.first, texts)
        self.low, self.low_total = self.c, np.zeros(len(rank), np.int64)
        self.k = 2

    def ask(self, order: Order, parts: int) -> None:
        """The distinct n-grams of the current order, by part and context."""
        self.at = np.flatnonzero(self.ok)
        distinct, self.which = np.unique(self.place[self.at] << 32 | self.word[self.at], return_inverse=True)
        some = np.empty(len(distinct), np.int64)
        some[self.which] = self.at
        key = _context(self.older[some], self.last[some])
        heat = np.isin(key, order.hot)
        where = distinct >> 32
        begin = np.flatnonzero(np.r_[True, where[1:] != where[:-1]] | heat) if len(some) else some
        part = spread_over(np.where(heat[begin], mixed(key[begin] ^ mixed(self.id[some[begin]])), mixed(key[begin])), parts)
        n = np.diff(np.r_[begin, len(some)])
        by = np.argsort(part, kind="stable")
        begin, n, part = begin[by], n[by], part[by]
        self.entry = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)  # of `distinct`, in the order asked
        self.run, self.n_run = np.cumsum(n) - n, n
        self.some, self.key = some[self.entry], key[begin]
        self.cuts = np.searchsorted(part, np.arange(parts + 1))

    def asks(self, block: int) -> list[tuple[int, int, bytes]]:
        count = np.bincount(self.which, self.trains[self.at], minlength=len(self.entry)).astype(np.int64)[self.entry]
        out = []
        for p in np.flatnonzero(np.diff(self.cuts)).tolist():
            runs = slice(self.cuts[p], self.cuts[p + 1])
            a = self.run[runs]
            e = slice(a[0], a[-1] + self.n_run[runs][-1])
            lead = self.some[a]
            last, total = self.last[lead], self.low_total[lead]
            new = np.flatnonzero(np.r_[True, (last[1:] != last[:-1]) | (total[1:] != total[:-1])])
            out.append((block, p, pack64(self.older[lead], self.n_run[runs], last[new], total[new], np.diff(np.r_[new, len(lead)]), self.id[self.some[e]], count[e], self.low[self.some[e]])))
        return together(out, _TOGETHER)

    def answered(self, c: np.ndarray, mask: np.ndarray, sums: np.ndarray, mass: np.ndarray, order: Order, p: np.ndarray | None) -> None:
        """Take the answers in and go on to the next order; `p` becomes the probabilities."""
        c = c.astype(np.int64)
        if len(c) != len(self.entry) or len(mask) != len(self.run):
            raise RuntimeError("an answer of the counts is missing")
        bits = np.array([sum(1 << r for r in range(K) if order.d[r + 1] < 1)], np.uint64)
        left = (mask & bits) > 0
        need = np.minimum.reduceat(c, self.run) == 0 if len(c) else np.zeros(0, bool)
        rest = np.ones(len(self.run))
        given = np.zeros(len(self.run))
        rest[need], given[need] = _left(sums.reshape(-1, K).astype(np.float64), order.d), mass
        if len(order.hot):
            k = np.minimum(np.searchsorted(order.hot, self.key), len(order.hot) - 1)
            heat = order.hot[k] == self.key
            k = k[heat]
            rest[heat], given[heat] = _left(order.sums, order.d)[k], order.sums[k, K]
            left[heat] = rest[heat] > 0
        total = self.total[self.some[self.run]] + ~left
        alpha = np.where(left, rest, 1.0) / total / (1 - given)
        back = np.empty(len(self.entry), np.int64)
        back[self.entry] = np.arange(len(self.entry))
        mine = back[self.which]
        run = np.repeat(np.arange(len(self.run)), self.n_run)[mine]
        seen, size = c[mine], total[run]
        if p is not None:
            p[self.at] = np.where(seen > 0, _kept(order.d, seen) / size, alpha[run] * p[self.at])
        # numbered by their last word first, so that the contexts of the next order that share it stand together
        by = np.argsort(self.word[self.some][back] << 32 | self.place[self.some][back])
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        place, count, sizes = (np.zeros(len(self.id), np.int64) for _ in range(3))
        place[self.at], count[self.at], sizes[self.at] = number[self.which], seen, size
        older = self.last if self.k == 2 else mixed(mixed(self.older) + self.last)
        self.place, self.total = _before(place, self.first), _before(count, self.first)
        self.ok = self.total > 0
        self.older, self.last = _before(older, self.first), _before(self.id, self.first)
        self.low, self.low_total = count, sizes
        self.k += 1


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the block's distinct tokens, the end among them; the tokens by position (texts end to end); tokens in each text; whether it trains."""
    data, off = utf8(batch.column("text"))
    data = _LOWER[data]
    starts, ends, text = word_spans(data, off)
    n = np.bincount(text, minlength=batch.num_rows) + 1
    keys, _, at = distinct_spans(data, starts, ends)
    which = np.full(n.sum(), len(keys))
    inner = np.ones(len(which), bool)
    inner[np.cumsum(n) - 1] = False
    which[inner] = at
    order = np.argsort(np.r_[keys, _END_KEY], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.r_[keys, _END_KEY][order], rank[which], n, batch.column("train").to_numpy(zero_copy_only=False)


def _answers(blocks: list[tuple[int, int, bytes]], sums: list[tuple], table: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Answers to blocks; sums by context, and frequent contexts of the next order (hashes, counts); the part's own table."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = [(b, p, x, "answer", None, None, None) for b, p, x in blocks] + [(-1, p, x, "table", None, None, None) for p, x in table]
    out += [(-1, -1, None, kind, signed(h), s, None) if kind != "hot" else (-1, -1, None, kind, None, None, [{"h": signed(int(k)), "n": float(n)} for k, n in zip(h, s)]) for kind, h, s in sums]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.float64())]))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["block", "part", "payload", "kind", "h", "sums", "often"])


def _parts(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """`count` of one part after the other: (answers to blocks, sums, table)."""
    for many, all_ in by_part(batches):
        back: dict[int, list[bytes]] = {}
        for i, got in one_by_one(all_, _TOGETHER):
            answers, sums, table = count(many * _TOGETHER + i, got)
            for (block, _), x in zip(got, answers):
                back.setdefault(block, [b""] * _TOGETHER)[i] = x
            yield _answers([], sums, [(many * _TOGETHER + i, x) for x in table])
        yield _answers([(block, many, joined(x)) for block, x in back.items()], [], [])


def _count_words(parts: int, keep: bool):
    def run(part: int, got: list[tuple[int, bytes]]):
        asked = [unpack64(x) for _, x in got]
        keys, which = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked]), return_inverse=True)
        c = np.bincount(which, np.concatenate([x[1] for x in asked]), minlength=len(keys)).astype(np.int64)
        order = np.argsort(-c, kind="stable")
        ids = np.empty(len(keys), np.uint64)
        ids[order] = np.arange(len(keys), dtype=np.uint64) * np.uint64(parts) + np.uint64(part + FIRST)
        ends = keys == _END_KEY
        ids[ends] = END
        sums = [("all", 0, [float(c.sum()), float((c > 0).sum()), *(float((c == r).sum()) for r in range(1, K + 2))]), *(("texts", 0, [float(x)]) for x in c[ends])]
        top = order[:HOT][c[order[:HOT]] * HOT > c.sum()]  # who has so much of all tokens has it of the part's
        sums.append(("hot", _context(np.zeros(len(top), np.uint64), ids[top]), c[top]))
        cuts = np.cumsum([0, *(len(x[0]) for x in asked)])
        place = np.empty(len(keys), np.uint64)  # the number without what all words of the part share
        place[order] = np.arange(1, len(keys) + 1, dtype=np.uint64)
        place[ends] = 0
        return [pack64(np.array([part], np.uint64), place[which[i:j]], c[which[i:j]]) for i, j in zip(cuts, cuts[1:])], sums, [pack64(keys, ids, c)] if keep else []

    return run


def _count(k: int, uni: Unigrams, low: np.ndarray | None, order: Order, keep: bool):
    """Adds up the n-grams of order k; `low` are the discounts of the order below."""

    def run(_: int, got: list[tuple[int, bytes]]):
        asked = [unpack64(x) for _, x in got]
        older, n, last, size, same, word, count, below = (np.concatenate([x[i] for x in asked]) for i in range(8))
        runs, entries = np.cumsum([0, *(len(x[0]) for x in asked)]), np.cumsum([0, *(len(x[5]) for x in asked)])
        n, same = n.astype(np.int64), same.astype(np.int64)
        last, size = np.repeat(last, same), np.repeat(size, same)
        begin = np.cumsum(n) - n
        older, last, size = (np.repeat(x, n) for x in (older, last, size))
        by = np.lexsort((word, last, older))
        older, last, word = older[by], last[by], word[by]
        new = np.r_[True, (older[1:] != older[:-1]) | (last[1:] != last[:-1])]
        gram = np.flatnonzero(new | np.r_[True, word[1:] != word[:-1]])
        c = np.add.reduceat(count[by].astype(np.int64), gram)
        below, size = below[by[gram]].astype(np.int64), size[by[gram]].astype(np.float64)
        p = uni.p(below) if k == 2 else _kept(low, below) / np.maximum(size, 1.0)
        contexts = np.flatnonzero(new[gram])
        sums = np.array([*(np.add.reduceat((c == r).astype(np.float64), contexts) for r in range(1, K + 1)), np.add.reduceat(np.where(c > 0, p, 0.0), contexts)]).T
        mask = ((sums[:, :K] > 0) @ (1 << np.arange(K))).astype(np.uint64)
        keys = _context(older[gram[contexts]], last[gram[contexts]])
        said = [("all", 0, [float((c == r).sum()) for r in range(1, K + 2)])]
        said += [("context", int(keys[i]), sums[i].tolist()) for i in np.flatnonzero(np.isin(keys, order.hot))]
        hot = gram[c * HOT > uni.total]
        said.append(("hot", _context(last[hot] if k == 2 else mixed(mixed(older[hot]) + last[hot]), word[hot]), c[c * HOT > uni.total]))
        # back to the blocks: counts by entry, and contexts by run
        of = np.empty(len(by), np.int64)
        of[by] = np.repeat(np.arange(len(gram)), np.diff(np.r_[gram, len(by)]))
        back, context = c[of], (np.searchsorted(contexts, of[begin], "right") - 1)
        need = np.minimum.reduceat(back, begin) == 0
        out = []
        for i in range(len(got)):
            r, e = slice(runs[i], runs[i + 1]), slice(entries[i], entries[i + 1])
            own = sums[context[r][need[r]]]
            out.append(pack64(back[e], mask[context[r]], own[:, :K].astype(np.uint64).ravel(), own[:, K].copy()))
        return out, said, [pack64(older[gram], last[gram], word[gram], c)] if keep else []

    return run


def score(docs: DataFrame, train, order: int = 3, parts: int | None = None, limit: int = 5 << 20, model: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs` (doc_id, text; others ignored).

    `train` is a boolean column; the model, of n-grams up to `order`, learns from those rows. A null
    or wordless text is its end token. Repeated rows count as often as they stand; without any
    training rows all is unknown and every score is 0. An empty table gives no rows. `docs` is
    read once. With `model`, the count tables are left there, partitioned by order: (part, payload)
    with the packed 64-bit columns hash, number, count of words, or older, last, word, count of n-grams.
    """
    if order < 2:
        raise ValueError("a backoff model has order 2 at least")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"), F.spark_partition_id().alias("_part"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = _TOGETHER * (parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    keep = model is not None

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in numbered(batches, limit):
            keys, which, n, trains = _words(batch)
            count = np.bincount(which, np.repeat(trains, n), minlength=len(keys)).astype(np.int64)
            often = np.argsort(-np.bincount(which, minlength=len(keys)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(keys), np.int64)
            rank[often] = np.arange(len(keys))
            cuts = np.searchsorted(spread_over(keys, parts), np.arange(parts + 1))
            sent = [(block, p, pack64(np.r_[keys[i : i + 1], np.diff(keys[i:j])], count[i:j])) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            yield rows([(block, -1, joined([with_column(batch.column("doc_id"), pack(n, trains.astype(np.int64), rank[which])), pack(often)])), *together(sent, _TOGETHER)])

    def sums(table: DataFrame, name: str) -> dict[int, np.ndarray]:
        """The sums of one kind, by context; a few rows."""
        width = {"all": K + 3, "context": K + 1}.get(name, 1)
        by = table.where(F.col("kind") == name).groupBy("h").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
        return {r[0] % (1 << 64): np.array([x or 0.0 for x in r[1:]]) for r in by.collect()}

    def frequent(table: DataFrame) -> set[int]:
        """The at most HOT n-grams with over 1/HOT of all tokens."""
        found = table.where("kind = 'hot'").select(F.explode(F.filter("often", lambda x: x.n * HOT > uni.total)).alias("x")).select("x.h").collect()
        return {r.h % (1 << 64) for r in found}

    def counted(asks: DataFrame, run, k: int) -> DataFrame:
        with freeing(spark):
            out = written(asks.repartition(parts // _TOGETHER, "part").sortWithinPartitions("part", "block").mapInArrow(lambda batches: _parts(batches, run), _ANSWER), f"order{k}")
        if keep:
            out.where("kind = 'table'").select("part", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{model}/order={k}")
        return out

    def met(heads: DataFrame, answers: list[DataFrame]) -> DataFrame:
        both = heads
        for k, found in enumerate(answers):
            both = both.union(found.where("kind = 'answer'").select("block", (F.col("part") + k * parts).alias("part"), "payload"))
        return both.repartition("block").sortWithinPartitions("block", "part")

    def opened(head: bytes, got: list[tuple[int, bytes]], texts: int, known: list[Order], p: bool) -> tuple[_Block, np.ndarray | None]:
        """A block with the answers so far, ready for the next order."""
        answers = [[unpack64(x) for part, all_ in got if part // parts == k for x in split(all_) if x] for k in range(len(known) + 1)]
        numbers = [np.where(x[1] == 0, np.uint64(END), (x[1] - np.uint64(1)) * np.uint64(parts) + x[0] + np.uint64(FIRST)) for x in answers[0]]
        answers[0] = [[n, x[2]] for n, x in zip(numbers, answers[0])]
        put = lambda k, i: np.concatenate([x[i] for x in answers[k]] or [np.zeros(0, np.uint64)])
        often = unpack(split(head)[1])[0]
        if len(put(0, 0)) != len(often):
            raise RuntimeError("an answer of the counts is missing")
        b = _Block(split(head)[0], put(0, 0)[often], put(0, 1)[often].astype(np.int64), texts)
        prob = uni.p(b.c) if p else None
        for k, order_ in enumerate(known, 1):
            b.ask(order_, parts)
            b.answered(put(k, 0), put(k, 1), put(k, 2), put(k, 3).view(np.float64), order_, prob)
        return b, prob

    heads, asks = written_apart(docs.mapInArrow(begin, ROW), "words", "part = -1")
    answers = counted(asks, _count_words(parts, keep), 1)
    dropped(spark, asks)
    whole = sums(answers, "all").get(0, np.zeros(K + 3))
    uni = Unigrams(whole[0], whole[1], whole[2:].tolist())
    texts = int(sums(answers, "texts").get(0, [0])[0])
    start = int(_context(np.zeros(1, np.uint64), np.array([START], np.uint64))[0])
    hot = {start} | frequent(answers)
    known: list[Order] = []
    answers = [answers]
    for k in range(2, order + 1):
        here = Order(np.array(sorted(hot), np.uint64))
        before = list(known)

        def ask(batches: Iterator[pa.RecordBatch], before=before, here=here) -> Iterator[pa.RecordBatch]:
            for block, head, got in by_block(batches):
                b, _ = opened(head, got, texts, before, False)
                b.ask(here, parts)
                yield rows(b.asks(block))

        answers.append(counted(met(heads, answers).mapInArrow(ask, ROW), _count(k, uni, known[-1].d if known else None, here, keep), k))
        dropped(spark)  # the n-grams asked about are shuffled, never stored
        here = Order(here.hot, discounts(sums(answers[-1], "all").get(0, np.zeros(K + 1))[: K + 1].tolist()))
        found = sums(answers[-1], "context")
        here.sums = np.array([found.get(int(h), np.zeros(K + 1)) for h in here.hot]).reshape(-1, K + 1)
        hot = frequent(answers[-1])
        known.append(here)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, head, got in by_block(batches):
            b, p = opened(head, got, texts, known, True)
            text = np.repeat(np.arange(len(b.n)), b.n)
            base = np.log10((b.c + 1) / (uni.total + uni.types + 1))
            add = lambda x: np.bincount(text, x, minlength=len(b.n))
            yield pa.RecordBatch.from_arrays(
                [b.doc_id, pa.array(b.train == 0), pa.array(b.n), pa.array(add(b.c > 0).astype(np.int64)), pa.array(np.full(len(b.n), int(uni.total))), pa.array(add(base)), pa.array(add(np.log10(p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met(heads, answers).mapInArrow(evaluate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(docs: DataFrame, order: int = 3) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return score(docs, F.crc32(name) % 7 != 2, order)
