"""Transcript parsing: a hidden Markov model over line features recovers who speaks and where turns begin.

The hidden states are the roles, each as a turn's first line or as a line that goes on. Each line of a transcript emits one symbol made of its
speaker marker (or none) and coarse features of the line. Start, transition and emission tables
are counted, with add-one smoothing, on labelled lines; a line can go on only with the turn before
it. Viterbi then finds the likeliest states, and each begin state opens a turn in a canonical
rendering. A line's features are its own, so nothing tells the model where its text was joined.

A transcript may be of any length, so no task holds one whole. It is cut into chunks of `chunk`
lines; each chunk is first reduced to its matrix of best scores from entry to exit state
(max-plus products, one small row), the chunks' matrices fix the states at all cuts, and each
chunk is then decoded between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

ROLES = ["system", "user", "assistant"]
#: State 2 * r begins a turn of role r, 2 * r + 1 goes on with it.
STATES = 2 * len(ROLES)
#: Markers at a line's start and the symbol each stands for.
MARKERS = {"user": r"(?i)^\s*(?:user|human|q)\s*[:>]", "assistant": r"(?i)^\s*(?:assistant|bot|ai|a)\s*[:>]", "system": r"(?i)^\s*(?:system|instructions?)\s*[:>]", "other": r"^\s*(?:[-*]|\[[^\]]*\])\s"}
_N = len(MARKERS) + 1
SYMBOLS = _N * 4 * 2
_MOVES = np.array([[r % 2 == 0 or p // 2 == r // 2 for r in range(STATES)] for p in range(STATES)])


def symbol(line: Column) -> Column:
    """The emission symbol: marker, length class (blank lines are one), whether it asks."""
    marker = F.lit(len(MARKERS))
    for i, pattern in reversed(list(enumerate(MARKERS.values()))):
        marker = F.when(line.rlike(pattern), i).otherwise(marker)
    n = F.length(line)
    size = F.when(F.trim(line) == "", 3).when(n < 80, 0).when(n < 240, 1).otherwise(2)
    asks = line.rlike(r"\?\s*$").cast("int")
    return ((marker * 4 + size) * 2 + asks).cast("int")


def stripped(line: Column) -> Column:
    """The line without its speaker marker and the blank after it."""
    spoken = "|".join(f"(?:{p})" for name, p in MARKERS.items() if name != "other")
    return F.regexp_replace(line, rf"^(?:{spoken})[ \t]?", "")


def lines_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, block, pos, line, sym): the lines of `transcripts` (conv_id, block, text), in order, blank ones too.

    A transcript may come as several rows in the order of `block`; a null or empty text is one blank line.
    """
    cut = transcripts.select("conv_id", "block", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return cut.select("conv_id", "block", "pos", "line", symbol(F.col("line")).alias("sym"))


def fit(lines: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log start, transition and emission tables from `lines` (conv_id, block, pos, sym, role); only small counts reach the driver.

    A block is a turn here: its first line begins it.
    """
    k = STATES
    code = lines.where(F.col("role").isin(ROLES)).select("conv_id", "block", "pos", "sym", (2 * (F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1) + (F.col("pos") > 0).cast("int")).cast("int").alias("r"))
    emit = np.ones((k, SYMBOLS))
    for row in code.groupBy("r", "sym").count().collect():
        emit[row.r, row.sym] += row["count"]
    move, start = np.ones((k, k)), np.ones(k)
    ends = code.groupBy("conv_id", "block").agg(F.min(F.struct("pos", "r")).alias("a"), F.max(F.struct("pos", "r")).alias("b"), F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy("conv_id", "block").orderBy("pos")
    outer = Window.partitionBy("conv_id").orderBy("block")
    within = code.select(F.lag("r").over(inner).alias("p"), "r")
    across = ends.select(F.lag(F.col("b.r")).over(outer).alias("p"), F.col("a.r").alias("r"))
    for row in within.where("p is not null").union(across).groupBy("p", "r").count().collect():
        if row.p is None:
            start[row.r] += row["count"]
        else:
            move[row.p, row.r] += row["count"]
    start, move = np.where(np.arange(k) % 2 == 0, start, 0), np.where(_MOVES, move, 0)
    with np.errstate(divide="ignore"):
        return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True))


def _product(syms: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best scores from the state before the first line to the state at the last."""
    best = None
    for s in syms.tolist():
        step = move + emit[:, s][None, :]
        best = step if best is None else (best[:, :, None] + step[None]).max(1)
    return best


def _decode(syms: np.ndarray, before: int | None, end: int, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The states of a chunk, given the state before it (None: it begins the transcript) and its last."""
    score = (start if before is None else move[before]) + emit[:, syms[0]]
    back = np.zeros((len(syms), len(start)), np.int64)
    for i in range(1, len(syms)):
        step = score[:, None] + move
        back[i] = step.argmax(0)
        score = step.max(0) + emit[:, syms[i]]
    out = np.empty(len(syms), np.int64)
    out[-1] = end
    for i in range(len(syms) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def parse(transcripts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: int = 4096) -> DataFrame:
    """(conv_id, block, pos, at, line, role, begins): each line of `transcripts` (conv_id, block, text) with its likeliest role, and whether it begins a turn.

    at is the line's place in the transcript, pos that in its row.

    `block` orders the rows of a transcript; rows that share one are interleaved line by line, so
    repeated rows give repeated lines. Null ids are one transcript; an empty table gives no
    rows. Ties fall to the role that stands first in ROLES. Of a transcript, one task sees a
    chunk, or one small matrix for each chunk.
    """
    start, move, emit = model
    lines = lines_of(transcripts)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    # lines are numbered by running sums over blocks, so a chunk may hold several blocks or part of one
    sizes = lines.groupBy("conv_id", "block").agg((F.max("pos") + 1).cast("long").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({"conv_id": "c", "block": "b"})
    placed = lines.join(sizes, lines.conv_id.eqNullSafe(F.col("c")) & lines.block.eqNullSafe(F.col("b")))
    at = F.col("base") + F.col("pos")
    placed = placed.select("conv_id", F.floor(at / chunk).alias("chunk"), at.alias("at"), "block", "pos", "line", "sym")
    packed = placed.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", "sym", "block", "pos", "line"))).alias("rows"))
    packed = written(packed, "chunks")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("syms")
            flat, off = rows.flatten().to_numpy(), rows.offsets.to_numpy() - rows.offsets[0].as_py()
            best = [_product(flat[a:b], move, emit).ravel().tolist() for a, b in zip(off, off[1:])]
            head = [(start + emit[:, flat[a]] if b - a == 1 else (start + emit[:, flat[a]])[:, None].__add__(_product(flat[a + 1 : b], move, emit)).max(0)).tolist() for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(best), pa.array(head)], ["conv_id", "chunk", "best", "head"])

    kind = kinds["conv_id"]
    small = packed.select("conv_id", "chunk", F.transform("rows", lambda x: x.sym).alias("syms")).mapInArrow(reduce, f"conv_id {kind}, chunk long, best array<double>, head array<double>")

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("all").to_pylist():
                score, back = np.array(rows[0]["head"]), []
                for r in rows[1:]:
                    step = score[:, None] + np.array(r["best"]).reshape(STATES, -1)
                    back.append(step.argmax(0))
                    score = step.max(0)
                ends = [int(score.argmax())]
                for b in reversed(back):
                    ends.append(int(b[ends[-1]]))
                ends.reverse()
                out.append([{"chunk": r["chunk"], "before": ends[i - 1] if i else None, "last": ends[i]} for i, r in enumerate(rows)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.list_(pa.struct([("chunk", pa.int64()), ("before", pa.int32()), ("last", pa.int32())])))], ["conv_id", "cuts"])

    grouped = small.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "best", "head"))).alias("all"))
    known = grouped.mapInArrow(cuts, f"conv_id {kind}, cuts array<struct<chunk:bigint,before:int,last:int>>").select(F.col("conv_id").alias("c"), F.explode("cuts").alias("cut"))
    joined = packed.join(known, packed.conv_id.eqNullSafe(F.col("c")) & (packed.chunk == F.col("cut.chunk"))).select("conv_id", "rows", F.col("cut.before").alias("before"), F.col("cut.last").alias("last"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            flat, off = rows.flatten(), rows.offsets.to_numpy() - rows.offsets[0].as_py()
            syms = flat.field("sym").to_numpy()
            states = [_decode(syms[a:b], p, e, start, move, emit) for a, b, p, e in zip(off, off[1:], batch.column("before").to_pylist(), batch.column("last").to_pylist())]
            which = np.concatenate(states) if states else np.zeros(0, np.int64)
            owner = batch.column("conv_id").take(pa.array(np.repeat(np.arange(len(rows)), np.diff(off))))
            yield pa.RecordBatch.from_arrays([owner, flat.field("block"), flat.field("pos"), flat.field("at"), flat.field("line"), pa.array(np.array(ROLES, object)[which // 2], pa.string()), pa.array(which % 2 == 0)], ["conv_id", "block", "pos", "at", "line", "role", "begins"])

    return joined.mapInArrow(decode, f"conv_id {kind}, block {kinds['block']}, pos int, at long, line string, role string, begins boolean")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, text, role) from `conversations` (conv_id, turn, role, text): turns as they stand in raw transcripts.

    A turn's marker varies, and by a hash of its place a third of the turns have none. A null text
    is an empty turn; an empty turn always has its marker, as nothing else of it would be left.
    """
    body = F.coalesce("text", F.lit(""))
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.when(body == "", 6).otherwise(9))
    marks = {"system": ["System: ", "Instructions: ", "SYSTEM> "], "user": ["User: ", "Human: ", "Q: "], "assistant": ["Assistant: ", "Bot> ", "A: "]}
    mark = F.lit("")
    for role, forms in marks.items():
        mark = F.when(F.col("role") == role, F.when(h < 2, forms[0]).when(h < 4, forms[1]).when(h < 6, forms[2]).otherwise("")).otherwise(mark)
    return conversations.select("conv_id", F.col("turn").alias("block"), F.concat(mark, body).alias("text"), "role")


def joined(raw: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(conv_id, block, text, own): the turns `raw` (conv_id, block, text, role) of each conversation as one text.

    A long one is cut between turns into rows of about `most` characters, numbered by block. own has, for
    each line, the turn it came from (of), who said it and whether it opens its turn; parse() doesn't see it.
    """
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = raw.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(F.sum(F.length("text") + 1).alias("n"))
    sizes = sizes.select("c", "b", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most).alias("piece"))
    placed = raw.join(sizes, raw.conv_id.eqNullSafe(F.col("c")) & raw.block.eqNullSafe(F.col("b")))
    rows = placed.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("block", "role", "text"))).alias("l"))
    own = lambda x: F.transform(F.split(x.text, "\n"), lambda _, i: F.struct(x.block.alias("of"), x.role.alias("said"), (i == 0).alias("opens")))
    return rows.select("conv_id", F.col("piece").alias("block"), F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"), F.flatten(F.transform("l", own)).alias("own"))


def turns(parsed: DataFrame, piece: int = 4096) -> DataFrame:
    """(conv_id, block, pos, turn, role, text): canonical turns, each from a line that begins one to the next; the marker of that line is removed.

    block and pos are those of the first line. Turns are numbered within `piece` lines, then over the pieces' totals.
    """
    cut = written(parsed.withColumn("piece", F.floor(F.col("at") / piece)), "parsed")
    inner = Window.partitionBy("conv_id", "piece").orderBy("at", "block", "pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(F.col("conv_id").alias("c"), F.col("piece").alias("p")).agg(F.count_if("begins").alias("n"))
    base = base.select("c", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = cut.withColumn("seen", F.sum(F.col("begins").cast("long")).over(inner))
    numbered = local.join(base, local.conv_id.eqNullSafe(F.col("c")) & (local.piece == F.col("p"))).withColumn("turn", F.col("base") + F.col("seen"))
    by = numbered.groupBy("conv_id", "turn", "role").agg(F.sort_array(F.collect_list(F.struct("at", "block", "pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: F.when(i == 0, stripped(x.line)).otherwise(x.line)), "\n")
    return by.select("conv_id", F.col("l")[0].block.alias("block"), F.col("l")[0].pos.alias("pos"), "turn", "role", F.concat(F.lit("<|"), "role", F.lit("|>\n"), body).alias("text"))


def _held_out() -> Column:
    return F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(5)) == 0


def _fitted(raw: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of four fifths of the conversations; their turns, line by line, are the lines of joined()."""
    known = lines_of(raw.select("conv_id", "block", "text")).join(raw.select("conv_id", "block", "role").distinct(), ["conv_id", "block"])
    return fit(known.where(~_held_out()))


def _with_own(df: DataFrame, whole: DataFrame) -> DataFrame:
    """`df` (conv_id, block, pos, ...) with own of joined() for its lines."""
    own = whole.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.posexplode("own").alias("p", "own"))
    return df.join(own, df.conv_id.eqNullSafe(F.col("c")) & (df.block == F.col("b")) & (df.pos == F.col("p"))).drop("c", "b", "p")


def accuracy(conversations: DataFrame) -> dict[str, float]:
    """On the conversations held out: the share of lines with the right role, and precision and recall of the turns' first lines."""
    raw = render(conversations)
    whole = joined(raw.where(_held_out()))
    got = _with_own(parse(whole.select("conv_id", "block", "text"), _fitted(raw)), whole)
    n = got.agg(F.avg((F.col("role") == F.col("own.said")).cast("int")).alias("roles"), *(F.count_if(c).alias(a) for a, c in {"hit": F.col("begins") & F.col("own.opens"), "said": F.col("begins"), "true": F.col("own.opens")}.items())).first()
    return {"roles": n.roles, "precision": n.hit / n.said, "recall": n.hit / n.true}


def query(conversations: DataFrame) -> DataFrame:
    """Transcripts of all conversations, each one text, parsed by a model fitted on four fifths of them, and rendered.

    block is the given turn in which the turn found begins.
    """
    raw = render(conversations)
    whole = written(joined(raw), "transcripts")
    found = turns(parse(whole.select("conv_id", "block", "text"), _fitted(raw)))
    return _with_own(found, whole).select("conv_id", F.col("own.of").alias("block"), "turn", "role", "text")
