"""Cutting texts into pieces that a byte-level BPE encodes independently of each other.

The tokenizer's own pattern never lets a token run from a character that is not white space
into white space, nor from an ASCII letter into punctuation. So a text is cut before ASCII
white space that follows a character that is surely not white space, and before common
punctuation that follows an ASCII letter; the ids of a text are those of its pieces in order.
This also holds around special tokens, which only cut further: `<|endoftext|>` has no white
space and none of the punctuation, so no cut falls inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

import numpy as np

from .common import SPACES, distinct_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending starts of the pieces of all rows; each ends where the next starts."""
    if not len(data):
        return np.zeros(0, np.int64)
    sure = _PRINT[data]  # the last byte of a character that is not white space
    sure[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    sure[2:] |= (data[:-2] >= 0xE4) & (data[:-2] <= 0xEE)
    sure[3:] |= data[:-3] >= 0xF0
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (SPACES[data[1:]] & sure[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
    cut[off[:-1]] = True
    return np.flatnonzero(cut[:-1])


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    got = tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [np.array(x.ids, "<u4").tobytes() for x in got]


def spread(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `flat`, `counts` long each, taken in the order `which`; and the ends of the runs taken."""
    first = np.cumsum(counts) - counts
    n = counts[which]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(first[which] - (ends - n), n)
    return flat[at], ends


class Recent:
    """Values of byte strings, of which those asked for of late are kept: `keep` at most, half of them at least. Long strings are made anew each time."""

    def __init__(self, keep: int, longest: int = 64):
        self.half, self.longest = max(1, keep // 2), longest
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def of(self, keys: list[bytes], make: Callable[[list[bytes]], Iterable]) -> list:
        """The values of distinct keys; `make` gives those of the keys that are not there."""
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young and k not in old]
        new = dict(zip(missing, make(missing) if missing else ()))
        out = []
        for k in keys:
            value = young.get(k)
            if value is None:
                value = new[k] if k in new else old[k]
                if len(k) <= self.longest:
                    young[k] = value
            out.append(value)
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out


_KNOWN: dict[str, Recent] = {}


def encode_rows(path: str, data: np.ndarray, off: np.ndarray, keep: int = 600_000) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and where each row's begin (one more at the end).

    Pieces this worker has met of late with the same tokenizer are looked up by their bytes.
    """
    starts = piece_starts(data, off)
    ends = np.r_[starts[1:], len(data)][: len(starts)]
    _, first, which = distinct_spans(data, starts, ends)
    text = data.tobytes()
    words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    got = _KNOWN.setdefault(path, Recent(keep)).of(words, lambda new: encode_words(path, new))
    counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
    ids, at = spread(np.frombuffer(b"".join(got), "<u4"), counts, which)
    return ids, np.r_[0, at][np.searchsorted(starts, off)]


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: the bytes of all pieces end to end, and the length of each."""
    tok = tokenizer(path)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {i for i, t in tok.get_added_tokens_decoder().items()}
    vocab = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
    raw = [vocab[i].encode() if i in special else bytes(map(byte.__getitem__, vocab[i])) if i in vocab else b"" for i in range(max(vocab) + 1)]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    """The text of the ids in UTF-8: their pieces joined; byte sequences that are not UTF-8 become U+FFFD."""
    flat, counts = pieces(path)
    return b"".join(spread(flat, counts, ids[i : i + (1 << 18)])[0].tobytes() for i in range(0, len(ids), 1 << 18)).decode(errors="replace").encode()
