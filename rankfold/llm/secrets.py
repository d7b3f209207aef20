"""Secret scans (operator 5).

Base patterns find assigned values, access keys and hex strings.  The method adds other
random strings: two character Markov models, one of random strings and one of ordinary
identifiers, score every token outside the base spans (of a token that a base span
overlaps, the parts beside it), whatever its length; one is reported when the
log-likelihood ratio exceeds a threshold.

The models and the threshold are trained from labelled samples out of about
``SAMPLE_DOCS`` documents: the base spans' values are random strings, the other tokens are
ordinary, each distinct one once per document.  The threshold is the log odds of an
ordinary token against a random one in the sample, and the odds of ``FALSE_SHARE`` on top:
a token is reported when it is that much likelier random.  Only counts leave the
executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices, with_fields
from .sample import about

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "random")
SAMPLE_DOCS = 20_000
# Share of reported tokens that may be ordinary, by the models.
FALSE_SHARE = 0.01
# Weight of the single characters in the ordinary model, in transitions; and how many sights
# of a transition may be those of one odd string.
FALLBACK = 5.0
DISCOUNT = 2.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET)

_ASSIGN = re.compile(ASSIGN, re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_CODE = np.full(128, -1, dtype=np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_N)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted.

    The short forms are equal to matching with ``+`` and dropping what is too short: a
    run of hex digits, or what follows AKIA, is taken whole or not at all.  Assignments
    that are too short are consumed, then dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The secret strings of base spans: an assignment's value, else the span."""
    return [_ASSIGN.match(text[s:e])[2] if k == 0 else text[s:e] for s, k, e in spans]


def transitions(token: str) -> np.ndarray:
    """Codes prev * n + next of neighbouring characters; others than the alphabet part runs."""
    code = _CODE[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8) & 127].astype(np.int64)
    pairs = code[:-1] * _N + code[1:]
    return pairs[(code[:-1] >= 0) & (code[1:] >= 0)]


def ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition from counts (n x n).

    The random model is half the sample, half uniform (samples hold few alphabets); the
    ordinary one does not believe its first ``DISCOUNT`` sights of a transition and falls
    back to its single characters, so what ordinary tokens hardly hold speaks for random."""
    r, o = random.reshape(_N, _N).astype(float), np.maximum(ordinary.reshape(_N, _N) - DISCOUNT, 0.0)
    uniform = 1.0 / _N
    seen = r.sum(1, keepdims=True)
    p = np.where(seen > 0, 0.5 * r / np.maximum(seen, 1) + 0.5 * uniform, uniform)
    single = (o.sum(0) + 0.5) / (o.sum() + 0.5 * _N)
    q = (o + FALLBACK * single) / (o.sum(1, keepdims=True) + FALLBACK)
    return np.log(p / q).reshape(-1)


class Model(NamedTuple):
    """Ratio of each transition (n * n) and the threshold of their sum."""

    ratio: np.ndarray
    least: float


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens' parts outside the spans (sorted by start)."""
    at = 0
    for s, _, e in [*spans, (len(text), 0, len(text))]:
        if s > at:
            for m in _TOKEN.finditer(text, at, s):
                yield m.span()
        at = max(at, e)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The models and their threshold from the bounded sample; an empty table gives equal
    models, which report nothing.

    Fitted twice: the strings that the first models would report are no ordinary tokens to
    the second ones, so unlabelled secrets do not pass for ordinary."""
    sample = about(df, id_col, sample_docs).select(text_col)
    return _fit_once(sample, _fit_once(sample, None))


def _fit_once(sample: DataFrame, before: Model | None) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, _N * _N + 1), dtype=np.int64)  # the last place counts tokens
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                rest = [text[s:e] for s, e in outside(text, spans)]
                if before is not None:
                    rest = [w for w, r in zip(rest, token_ratios(text, spans, before.ratio)[2]) if r < before.least]
                for k, words in enumerate((set(values(text, spans)), set(rest))):
                    n[k, :-1] += np.bincount(transitions(" ".join(words)), minlength=_N * _N)
                n[:, -1] += len(spans), len(rest)
        model, code = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(code), pa.array(n[model, code])],
                                         names=["model", "code", "n"])

    rows = (sample.mapInArrow(count, "model long, code long, n long")
            .groupBy("model", "code").agg(F.sum("n").alias("n")).collect())
    n = np.zeros((2, _N * _N + 1))
    for r in rows:
        n[r.model, r.code] = r.n
    if not n[:, :-1].any():
        return Model(np.zeros(_N * _N), np.inf)
    odds = max(1.0, n[1, -1]) / max(1.0, n[0, -1])
    return Model(ratios(n[0, :-1], n[1, :-1]), float(np.log(max(1.0, odds / FALSE_SHARE))))


def token_ratios(text: str, spans: list[tuple[int, int, int]], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sum of ratios) of the tokens' parts outside the spans, all at once."""
    # one byte for each code point; those beyond the alphabet are no part of a token
    code = _CODE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)].astype(np.int64)
    inside = code >= 0
    for s, _, e in spans:
        inside[s:e] = False
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.empty(0)
    both = inside[:-1] & inside[1:]
    step = np.zeros(len(code))
    step[:-1][both] = ratio[(code[:-1] * _N + code[1:])[both]]
    return start, end, np.add.reduceat(step, start)


def scan_text(text: str | None, model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a whole text, sorted."""
    if not text:
        return []
    out = base_spans(text)
    start, end, total = token_ratios(text, out, model.ratio)
    over = total >= model.least
    return sorted(out + [(s, 3, e) for s, e in zip(start[over].tolist(), end[over].tolist())])


def scan(df: DataFrame, model: Model, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: the spans (code points, end exclusive) of every whole text, by start,
    then kind.

    Null and empty texts have none.  Other columns pass through, repeated rows too; a
    column already named ``out`` is replaced; an empty table gives an empty one.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("kind", T.StringType())])
    df, schema = with_fields(df, text_col, **{out: T.ArrayType(span)})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in scan_text(t, model)]
                     for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, type=kind)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
