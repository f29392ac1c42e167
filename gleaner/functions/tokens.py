"""The tokens of ``text.tokens``, cut with numpy from many texts at once: as hashes, or abstracted in one fingerprint."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gleaner.functions.text import KEYWORDS, MIN_FINGERPRINT_TOKENS

#: Characters that are worked on at once.
AT_ONCE = 1 << 14
_OTHER, _NAME, _DIGIT, _OTHER_DIGIT, _BLANK, _QUOTE, _DOT, _LETTER = range(8)
#: Unicode's property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _kinds() -> np.ndarray:
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    of = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    kinds[[i for i, c in enumerate(of) if c[0] == "L"]] = _LETTER
    kinds[[i for i, c in enumerate(of) if c == "Nd"]] = _OTHER_DIGIT
    kinds[list(b"0123456789")] = _DIGIT
    kinds[[*range(65, 91), *range(97, 123), ord("_"), ord("$")]] = _NAME
    kinds[WHITE] = _BLANK
    kinds[ord('"')], kinds[ord(".")] = _QUOTE, _DOT
    return kinds


def _after(x: np.ndarray) -> np.ndarray:
    """Each place's predecessor; the first has none."""
    return np.concatenate(([False], x[:-1]))


def _starts(kind: np.ndarray) -> np.ndarray:
    """Where tokens start, in order; characters that are neither white space nor a start belong to the token before."""
    place = np.arange(len(kind))
    run = (kind == _NAME) | (kind == _DIGIT)
    begun = np.maximum.accumulate(np.where(run & ~_after(run), place, 0))
    named = run & (np.maximum.accumulate(np.where(kind == _NAME, place, -1)) >= begun)
    digit = ((kind == _DIGIT) | (kind == _OTHER_DIGIT)) & ~named
    start = (kind != _BLANK) & ~(named & _after(named)) & ~(digit & _after(digit))
    # In 1.2.3 the first point belongs to a number, the second to none, and so on.
    points = np.flatnonzero((kind == _DOT) & _after(digit) & np.concatenate((digit[1:], [False])))
    if len(points):
        upto = np.cumsum(digit)
        fresh = np.concatenate(([True], np.diff(upto[points]) != np.diff(points) - 1))
        order = np.arange(len(points))
        points = points[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
        start[points] = start[points + 1] = False
    quote = kind == _QUOTE
    if quote.any():
        begun = np.maximum.accumulate(np.where(quote & ~_after(quote), place, 0))
        start &= ~(quote & ((place - begun) % 2 == 1))
    return np.flatnonzero(start)


def _hashes(x: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each token: a sum of its characters, each mixed with its place."""
    if not len(starts):
        return np.zeros(0, np.int64)
    x, kind = x[starts[0] :], kind[starts[0] :]
    starts = starts - starts[0]
    h = x.astype(np.uint64) << np.uint64(32)
    h += (np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))).astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h[kind == _BLANK] = 0
    return np.add.reduceat(h, starts).view(np.int64)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: the characters, their kinds, where tokens start, and how many each text has; a null text has none."""
    held, used = [], 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer("\n".join(held).encode("utf-32-le"), np.uint32)
        kind = _kinds()[x]
        starts = _starts(kind)
        ends = np.cumsum([len(t) + 1 for t in held])
        return x, kind, starts, np.diff(np.searchsorted(starts, ends), prepend=0)

    for t in texts.to_pylist():
        held.append(t or "")
        used += len(held[-1])
        if used >= AT_ONCE:
            yield cut()
            held.clear()
            used = 0
    if held:
        yield cut()


def hashed_tokens(texts: pa.Array) -> pa.ListArray:
    """The hashes of each text's tokens; a null text has none."""
    values, counts = [], []
    for x, kind, starts, n in _pieces(texts):
        counts.append(n)
        values.append(_hashes(x, kind, starts))
    offsets = np.concatenate(([0], *counts)).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


@lru_cache(1)
def _words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five bits for each character of a word, 0 for others; which three begin keywords; keywords by the bits of their letters."""
    bits = np.zeros(129, np.uint8)
    bits[[i for i in range(128) if _kinds()[i] in (_NAME, _DIGIT)]] = 31
    bits[[*range(65, 91), *range(97, 123)]] = [*range(1, 27)] * 2
    known = np.array([sum((ord(c) & 31) << 5 * j for j, c in enumerate(w)) for w in KEYWORDS])
    begun = np.zeros(1 << 15, bool)
    begun[known & 0x7FFF] = True
    return bits, begun, np.sort(known)


def _keywords(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the tokens are keywords, in any case, and how long these are."""
    bits, begun, known = _words()
    most = max(map(len, KEYWORDS))  # 12, so that a word has 60 bits
    x = np.concatenate((bits[np.minimum(x, 128)], np.zeros(most + 1, np.uint8)))
    first = x.astype(np.int16)
    first[:-2] |= (first[1:-1] << 5) | (first[2:] << 10)
    of = np.flatnonzero(begun[first[starts]])
    at, word, size, goes_on = starts[of], np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.ones(len(of), bool)
    for j in range(most):
        goes_on = goes_on & (x[at + j] > 0)
        word |= np.where(goes_on, x[at + j], 0).astype(np.int64) << 5 * j
        size += goes_on
    keep = (known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word) & ~(goes_on & (x[at + most] > 0))
    return of[keep], size[keep]


def _abstracted(x: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all abstracted tokens, each followed by a space, and where each begins and the last one ends."""
    own, size = kind[starts], np.ones(len(starts), np.int64)
    keywords, many = _keywords(x, starts)
    named = (own == _NAME) | (own == _LETTER)
    named[keywords] = False
    number = (own == _DIGIT) | (own == _OTHER_DIGIT)
    pair = (own == _QUOTE) & (np.concatenate((kind, [_OTHER]))[starts + 1] == _QUOTE)
    size[named | pair], size[number], size[keywords] = 2, 3, many
    places = np.concatenate(([0], np.cumsum(size + 1)))
    at, out = places[:-1], np.full(places[-1], ord(" "), np.uint32)
    out[at] = x[starts]
    out[at[pair] + 1] = ord('"')
    for of, letters in ((named, "ID"), (number, "NUM")):
        for j, c in enumerate(letters):
            out[at[of] + j] = ord(c)
    for j in range(1, many.max(initial=0)):
        of = keywords[many > j]
        out[at[of] + j] = x[starts[of] + j]
    return out, places


def fingerprints(texts: pa.Array) -> pa.Array:
    """``text.fingerprint`` of each text's abstracted tokens: their SHA-256, empty where they are few. Beyond ASCII only letters are names, as in SQL; not all that is alphabetic."""
    out = []
    for x, kind, starts, n in _pieces(texts):
        chars, places = _abstracted(x, kind, starts)
        ends = places[np.concatenate(([0], np.cumsum(n)))].tolist()
        for many, a, b in zip(n.tolist(), ends, ends[1:], strict=False):
            out.append(hashlib.sha256(chars[a : b - 1].tobytes().decode("utf-32-le").encode()).hexdigest() if many >= MIN_FINGERPRINT_TOKENS else "")
    return pa.array(out, pa.string())
