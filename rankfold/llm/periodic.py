"""Periodic run detection (operator 13) on the words of a text, by string synchronising sets.

A *run* is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words that no neighbouring
word extends.

For every dyadic scale t = 1, 2, 4, ... the words of a batch of texts get

* the *highly periodic* places: windows of t words with a period of at most t / 3.  They
  are found on their own: a window of t - t // 3 words that comes again within t // 3 words
  gives the period, which is then checked over the whole window;
* a *synchronising set*: place i belongs to it if the smallest hash among the windows of t
  words that start in i..i+t (highly periodic ones left out) is that of the first or the
  last.  Membership depends on 2t words only, so equal stretches hold the same places, and
  every stretch of 3t - 1 words that is not highly periodic has one among its first t.

Places of the set with equal contexts (2t words) whose distance lies in t+1..2t (1..2 at
t = 1) propose that distance as a period.  A run of period p belongs to the scale with
t < p <= 2t: it is longer than 4t, so its first synchronising place and the same place a
period later lie inside it, and their distance is p.  Highly periodic stretches, which the
set leaves out, propose their own (small) periods.

Proposals are only candidates: each is extended word by word in both directions, so the
runs are exact.  Of several periods of one stretch the smallest is kept (the others are
its multiples and have the same ends).  All texts of a batch lie in one array, parted by
symbols that occur once; texts too short for a scale leave it.  Memory grows with the
longest text, time with its words times the number of scales.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import slices, with_fields
from .near_dup import mix64

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLICE_ROWS = 250
# Extension compares this many words for all candidates at once, then block by block.
TOGETHER = 64
_G = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2 ** 64 - 1)


def words(text: str | None) -> list[bytes]:
    """The runs of characters other than space and the controls 9 to 13, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


# -- hashes of windows ------------------------------------------------------------------------
def _after(x: np.ndarray, n: int) -> np.ndarray:
    """x[i + n], going round at the end (such windows hold a symbol that occurs once)."""
    n %= len(x)
    return np.concatenate([x[n:], x[:n]]) if n else x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * _G + b)


def _next_equal(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distance to the next place with an equal key), places being ``at``."""
    if len(at) < 2:
        return at[:0], at[:0]
    bits = int(at[-1]).bit_length()
    mixed = (key >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    mixed.sort()
    low = np.uint64((1 << bits) - 1)
    same = (mixed[1:] ^ mixed[:-1]) <= low
    place = (mixed & low).astype(np.int64)
    return place[:-1][same], (place[1:] - place[:-1])[same]


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of x[i : i + size] (cut off at the end), from the running minima of blocks
    of ``size``."""
    n = len(x)
    padded = np.full(-(-n // size) * size + size, _NONE, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[size - 1:size - 1 + n])


def highly_periodic(half: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) of windows of t words with a period of at most t // 3; ``half``:
    hashes of windows of t // 2 words."""
    most = t // 3
    if not most:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = t - most
    n = len(half)
    at, d = _next_equal(_joined(half, _after(half, m - t // 2)), np.arange(n))
    near = d <= most
    at, d = at[near], d[near]
    # words [at, at + t - d) equal the words d later
    end = at + t - t // 2
    whole = (half[at] == half[(at + d) % n]) & (half[(end - d) % n] == half[end % n])
    return at[whole], d[whole]


def synchronising(ids: np.ndarray, t: int, left_out: np.ndarray) -> np.ndarray:
    """Places of the synchronising set of scale t; ``ids``: hashes of windows of t words."""
    ids = ids.copy()
    ids[left_out] = _NONE
    last = _after(ids, t)
    low = _window_min(ids, t + 1)
    return np.flatnonzero(((low == ids) | (low == last)) & (low != _NONE))


# -- candidates to runs -------------------------------------------------------------------------
def _chains(at: np.ndarray, d: np.ndarray, known: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The first of every chain of candidates of one period whose known stretches touch."""
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    known = np.broadcast_to(known, order.shape)[order] if np.ndim(known) else known
    first = np.ones(len(at), dtype=bool)
    reach = (at + known)[:-1]
    first[1:] = (d[1:] != d[:-1]) | (at[1:] > reach)
    return at[first], d[first]


def _first_difference(codes: np.ndarray, at: np.ndarray, d: np.ndarray, step: int) -> np.ndarray:
    """For each candidate the first place at, at + step, ... whose word differs from the one
    d places on.  The symbols at both ends of ``codes`` occur once, so there is one."""
    at = at.copy()
    open_ = np.arange(len(at))
    for _ in range(TOGETHER):
        open_ = open_[codes[at[open_]] == codes[at[open_] + d[open_]]]
        if not len(open_):
            return at
        at[open_] += step
    for i in open_:
        size, p, q = TOGETHER, int(at[i]), int(d[i])
        while True:
            lo, hi = (p, min(p + size, len(codes) - q)) if step > 0 else (max(p - size + 1, 0), p + 1)
            unlike = np.flatnonzero(codes[lo:hi] != codes[lo + q:hi + q])
            if len(unlike):
                at[i] = lo + unlike[0 if step > 0 else -1]
                break
            p, size = (hi if step > 0 else lo - 1), 2 * size
    return at


def runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period, as places in ``codes``.

    ``codes``: one symbol that occurs once, then for each text its words (equal numbers
    for equal words) and one more such symbol; ``sizes``: the texts' numbers of words."""
    none = np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = mix64(codes.astype(np.uint64) + _G)
    half, at_of, owner = h, np.arange(len(codes)), np.repeat(np.arange(len(sizes) + 1), np.append([1], sizes + 1))
    found_at, found_d, t = [none], [none], 1
    size_of = np.append([0], sizes)
    while True:
        # only texts that can hold a run of this scale's periods
        least = max(MIN_LENGTH, MIN_EXPONENT * (t + 1 if t > 1 else 1))
        stay = size_of[owner] >= least
        if not stay.any():
            break
        if not stay.all():
            h, half, at_of, owner = h[stay], half[stay], at_of[stay], owner[stay]
        q_at, q_d = highly_periodic(half, t)
        if len(q_at):
            a, d = _chains(q_at, q_d, t - q_d)
            found_at.append(at_of[a])
            found_d.append(d)
        both = _joined(h, _after(h, t))
        s = synchronising(h, t, q_at)
        a, d = _next_equal(both[s], s)
        mine = (d <= 2 * t) & (d > (t if t > 1 else 0))
        if mine.any():
            a, d = _chains(a[mine], d[mine], 2 * t)
            found_at.append(at_of[a])
            found_d.append(d)
        half, h, t = h, both, 2 * t
    at, d = np.concatenate(found_at), np.concatenate(found_d)
    if not len(at):
        return none, none, none
    right = _first_difference(codes, at, d, 1)
    ok = right > at
    at, d, right = at[ok], d[ok], right[ok]
    start = _first_difference(codes, at, d, -1) + 1
    end = right + d
    ok = end - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * d)
    start, end, d = start[ok], end[ok], d[ok]
    order = np.lexsort((d, end, start))
    start, end, d = start[order], end[order], d[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, d = start[smallest], end[smallest], d[smallest]
    order = np.lexsort((d, start))
    return start[order], end[order], d[order]


def scan_texts(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """For every text its runs as (start, length, period), by start, then period, and its
    words without those that a run holds after its first period, joined by one space."""
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    total = int(sizes.sum())
    number: dict[bytes, int] = {}
    fresh = count()
    codes = np.empty(total + len(split) + 1, dtype=np.int64)
    codes[0] = total
    ends = np.cumsum(sizes + 1) + 1
    starts = ends - sizes - 1
    for k, (w, s) in enumerate(zip(split, starts)):
        # a word's number: how many words came before its first occurrence
        codes[s:s + len(w)] = np.fromiter(map(number.setdefault, w, fresh), np.int64, len(w))
        next(fresh)
        codes[s + len(w)] = total + len(split) + 1 + k
    codes[0] = total + 2 * len(split) + 2
    s, e, q = runs(codes, sizes)
    dropped = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(dropped, s + q, 1)
    np.add.at(dropped, e, -1)
    stays = np.cumsum(dropped) == 0
    of = np.searchsorted(ends, s, side="right")
    cut = np.searchsorted(of, np.arange(len(split) + 1))
    out = []
    for k, w in enumerate(split):
        lo, hi, base = cut[k], cut[k + 1], starts[k]
        if lo == hi:
            out.append(([], b" ".join(w).decode()))
            continue
        mine = stays[base:base + len(w)]
        out.append((list(zip((s[lo:hi] - base).tolist(), (e[lo:hi] - s[lo:hi]).tolist(), q[lo:hi].tolist())),
                    b" ".join([x for x, keep in zip(w, mine) if keep]).decode()))
    return out


# -- Spark side -----------------------------------------------------------------------------------
def find(df: DataFrame, text_col: str = "text", out: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add ``out``: array<struct<start, length, period>> of every whole text's runs (word
    numbers from 0), by start, then period, and ``collapsed``: its words joined by one
    space, without the repeats.

    Null and empty texts, and texts without words, have no runs and an empty ``collapsed``.
    Every text is scanned by itself: no shuffle, and nothing grows with the table.  Other
    columns pass through, repeated rows too; a column already named ``out`` or
    ``collapsed`` is replaced; an empty table gives an empty one.
    """
    fields = ("start", "length", "period")
    one = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    df, schema = with_fields(df, text_col, **{out: T.ArrayType(one), collapsed: T.StringType()})
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_ROWS):
            got = scan_texts(b.column(b.schema.get_field_index(text_col)).to_pylist())
            found = pa.array([[dict(zip(fields, r)) for r in g[0]] for g in got], type=kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found, pa.array([g[1] for g in got], type=pa.string())],
                                             names=[*b.schema.names, out, collapsed])

    return df.mapInArrow(run, schema)
