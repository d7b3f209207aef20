"""Language identification (operator 7): a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over a window, the largest answer of
each filter is kept, and a softmax over these gives the language.  A text is cut into
fixed-length windows without gaps, all of them are scored, and the text's probabilities
are the means over its windows weighted by their bytes.

The network is trained on the driver from a bounded sample: at most ``DOCS_PER_LANG``
labelled documents of each language (smallest hash of the id first), ``PIECES`` pieces
of ``WINDOW`` characters spread over each, at most ``MAX_LANGS`` languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices, with_fields
from .sample import unit_hash

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
DOCS_PER_LANG = 1_500
PIECES = 4
MAX_LANGS = 256
EPOCHS = 6
BATCH = 64
SEED = 42
UNDETERMINED = "und"
# A language's cut, as a share of the least score of its held-out documents, and how many of
# them it takes to set one.
CUT_SHARE = 0.8
CUT_DOCS = 100
_LETTER = regex.compile(r"\p{L}")


class ByteCnn:
    """Weights: ``e`` (256 x d), ``w`` (span*d x filters, all widths side by side, zero
    beyond a filter's width), ``b``, ``v`` (filters x languages), ``c``."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs, self.span = langs, max(WIDTHS)
        n = len(WIDTHS) * FILTERS
        self.e = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.mask = np.zeros((self.span * EMBEDDING, n), dtype=np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
        self.w = rng.normal(0, 0.3, self.mask.shape).astype(np.float32) * self.mask
        self.b = np.zeros(n, dtype=np.float32)
        self.v = rng.normal(0, 0.3, (n, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), dtype=np.float32)

    def _slides(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, span*d): the embedded bytes under the filters."""
        n, length = windows.shape
        x = np.zeros((n, length + self.span - 1, EMBEDDING), dtype=np.float32)
        x[:, :length] = self.e[windows]
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length, self.span * EMBEDDING), (s[0], s[1], s[2])).reshape(
            n * length, -1)

    def _pool(self, windows: np.ndarray, want_place: bool = False):
        n, length = windows.shape
        slides = self._slides(windows)
        y = (slides @ self.w).reshape(n, length, -1)
        if not want_place:
            return np.maximum(y.max(axis=1) + self.b, 0)
        at = y.argmax(axis=1)
        top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
        return np.maximum(top + self.b, 0), at, slides.reshape(n, length, -1)

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.v + self.c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each window (rows of bytes, zero beyond the end)."""
        return np.concatenate([self._softmax(self._pool(windows[i:i + BATCH])) for i in range(0, len(windows), BATCH)])

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        params = ["e", "w", "b", "v", "c"]
        m = {p: np.zeros_like(getattr(self, p)) for p in params}
        s = {p: np.zeros_like(getattr(self, p)) for p in params}
        step = 0
        share = np.bincount(labels, minlength=len(self.langs))
        weight = (len(labels) / (len(self.langs) * np.maximum(share, 1)))[labels].astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                x, y = windows[pick].copy(), labels[pick]
                # short windows are learned too: half of them lose their end
                for r in np.flatnonzero(rng.random(len(pick)) < 0.5):
                    x[r, rng.integers(12, WINDOW):] = 0
                h, at, slides = self._pool(x, True)
                p = self._softmax(h)
                d = p
                d[np.arange(len(y)), y] -= 1
                d *= weight[pick][:, None] / len(y)
                dh = (d @ self.v.T) * (h > 0)
                under = np.take_along_axis(slides, at[:, :, None], axis=1)  # windows x filters x span*d
                grads = {"v": h.T @ d, "c": d.sum(0), "b": dh.sum(0),
                         "w": np.einsum("nf,nfk->kf", dh, under) * self.mask}
                dx = (dh[:, :, None] * self.w.T[None]).reshape(len(y), -1, self.span, EMBEDDING)
                place = at[:, :, None] + np.arange(self.span)
                inside = place < x.shape[1]
                byte = np.where(inside, np.take_along_axis(x, np.minimum(place, x.shape[1] - 1).reshape(len(y), -1), 1)
                                .reshape(place.shape), 0)
                de = np.zeros_like(self.e)
                np.add.at(de, byte[inside], dx[inside])
                grads["e"] = de
                step += 1
                for q in params:
                    g = grads[q]
                    m[q] += 0.1 * (g - m[q])
                    s[q] += 0.01 * (g * g - s[q])
                    rate = 0.01 * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
                    setattr(self, q, (getattr(self, q) - rate * m[q] / (np.sqrt(s[q]) + 1e-7)).astype(np.float32))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Probabilities of whole texts (none empty)."""
        raw = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
        count = np.array([-(-len(r) // WINDOW) for r in raw])
        ends = np.cumsum(count)
        block = np.zeros((ends[-1], WINDOW), dtype=np.uint8)
        size = np.full(ends[-1], WINDOW, dtype=np.float64)
        flat = block.reshape(-1)
        for r, e, n in zip(raw, ends, count):
            flat[(e - n) * WINDOW:(e - n) * WINDOW + len(r)] = r
            size[e - 1] = len(r) - (n - 1) * WINDOW
        p = self.windows(block) * size[:, None]
        return np.add.reduceat(p, ends - count, axis=0) / np.add.reduceat(size, ends - count)[:, None]


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = DOCS_PER_LANG) -> ByteCnn | None:
    """Train on the bounded sample (see above); None if no document has text and label."""
    text = F.col(text_col)
    labelled = df.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    # each language is thinned by a hash to about twice the sample, then cut exactly
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 2.0 * docs_per_lang / r["count"]))])
    start = lambda i: F.floor(i * F.greatest(F.length(text) - WINDOW, F.lit(0)) / (PIECES - 1)).cast("int") + 1
    rows = (labelled.filter((unit_hash(id_col, seed=SEED) < rate[F.col(lang_col)]) & text.rlike(r"\p{L}"))
            .select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"),
                    unit_hash(id_col, seed=SEED).alias("h"),
                    F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)),
                                                 lambda i: F.substring(text, start(i), F.lit(WINDOW)))).alias("pieces"))
            .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "pieces")))
            .filter(F.col("n") <= docs_per_lang))
    got = sorted((r.lang, r.n, r.pieces) for r in rows.select("lang", "n", "pieces").collect())
    if not got:
        return None
    langs = sorted({g[0] for g in got})
    pieces = [(p.encode()[:WINDOW], langs.index(lang)) for lang, _, ps in got for p in ps if p]
    x = np.zeros((len(pieces), WINDOW), dtype=np.uint8)
    for i, (p, _) in enumerate(pieces):
        x[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
    model = ByteCnn(langs)
    model.train(x, np.array([y for _, y in pieces]))
    return model


def predict(df: DataFrame, model: ByteCnn | None, text_col: str = "text", pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """Add the predicted language of every whole text and its probability.

    Texts that are null or hold no letter get ``und`` and 0, as does everything when the
    model is None.  Other columns pass through, repeated rows too; a column already named
    ``pred`` or ``score`` is replaced; an empty table gives an empty one.
    """
    df, schema = with_fields(df, text_col, **{pred: T.StringType(), score: T.DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            lang, prob = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            ok = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model is not None else []
            if ok:
                p = model.texts([texts[i] for i in ok])
                for i, k, q in zip(ok, p.argmax(axis=1), p.max(axis=1)):
                    lang[i], prob[i] = model.langs[k], min(1.0, float(q))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, type=pa.string()),
                                              pa.array(prob, type=pa.float64())], names=[*b.schema.names, pred, score])

    return df.mapInArrow(run, schema)


def cutoffs(df: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang") -> dict[str, float]:
    """For each language ``CUT_SHARE`` of the least score of its held-out documents, among
    those that the model calls by their label: what lies below is like none of them.

    All held-out documents are scored whole; only a language's least score and count come to
    the driver.  A language with fewer than ``CUT_DOCS`` of them gets no cut."""
    mine = df.filter(F.col(lang_col).isin(model.langs) & held_out(F.col(id_col)))
    scored = predict(mine.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")), model, "_text", "_pred", "_score")
    least = (scored.filter("_pred = _lang").groupBy("_lang")
             .agg(F.min("_score").alias("least"), F.count(F.lit(1)).alias("n")).collect())
    return {r._lang: CUT_SHARE * r.least for r in least if r.n >= CUT_DOCS}
