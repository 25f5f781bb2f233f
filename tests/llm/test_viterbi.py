"""Parsing in chunks against a plain Viterbi over whole transcripts."""

import random

import numpy as np
import pytest

from provlake.llm import transcripts


def viterbi(syms, start, move, emit):
    """The best score of any sequence of states, and one that has it."""
    score, back = start + emit[:, syms[0]], []
    for s in syms[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + emit[:, s]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return float(score.max()), path[::-1]


def score_of(path, syms, start, move, emit):
    return float(start[path[0]] + sum(move[a, b] for a, b in zip(path, path[1:])) + sum(emit[p, s] for p, s in zip(path, syms)))


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_parse_is_the_likeliest(spark, chunk):
    r = random.Random(chunk)
    marks = ["User: ", "Human: ", "Bot> ", "A: ", "System: ", "- ", "", "", ""]
    line = lambda: r.choice(marks) + r.choice(["", "what is it?", "a word " * r.randrange(1, 40), " "])
    texts = {c: "\n".join(line() for _ in range(r.choice([1, 2, 9, 60]))) for c in range(40)}
    model = tuple(np.log(x / x.sum(-1, keepdims=True)) for x in (np.random.default_rng(1).random(s) + 0.1 for s in (transcripts.STATES, (transcripts.STATES,) * 2, (transcripts.STATES, transcripts.SYMBOLS))))
    start, move, emit = model
    with np.errstate(divide="ignore"):
        model = np.where(np.arange(transcripts.STATES) % 2 == 0, start, -np.inf), np.where(transcripts._MOVES, move, -np.inf), emit
    df = spark.createDataFrame([(c, 0, t) for c, t in texts.items()], "conv_id long, block long, text string")
    syms, found = {}, {}
    for x in sorted(transcripts.lines_of(df).collect(), key=lambda x: (x.conv_id, x.pos)):
        syms.setdefault(x.conv_id, []).append(x.sym)
    for x in sorted(transcripts.parse(df, model, chunk).collect(), key=lambda x: (x.conv_id, x.at)):
        found.setdefault(x.conv_id, []).append(2 * transcripts.ROLES.index(x.role) + (not x.begins))
    assert found.keys() == syms.keys() == texts.keys()
    for c, s in syms.items():
        best, path = viterbi(s, *model)
        assert len(found[c]) == len(s) and abs(score_of(found[c], s, *model) - best) < 1e-9
        assert found[c] == path or abs(score_of(path, s, *model) - best) < 1e-9
