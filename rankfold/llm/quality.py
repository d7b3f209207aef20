"""Quality classifier (operator 12): a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - STRIDE`` and cover
all of it.  In every chunk bytes are embedded, learned filters of several widths slide
over it and each keeps its largest answer; a hidden layer turns these into a few numbers.
Their mean over the chunks, weighted by the bytes a chunk adds, goes through a logistic
unit: one probability that the label is 1.

The network is trained on the driver, whole (filters, hidden layer and combination
together), from a bounded sample: at most ``DOCS_PER_LABEL`` labelled documents of each
label, ``PIECES`` chunks spread over each.  A document weighs as many as it stands for, so
the probability is that of the labelled rows, not of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices, with_fields
from .sample import unit_hash

CHUNK = 256
STRIDE = 224
WIDTHS = (2, 4, 6)
FILTERS = 8
EMBEDDING = 8
HIDDEN = 16
DOCS_PER_LABEL = 3_000
PIECES = 6
EPOCHS = 6
BATCH_DOCS = 16
BATCH_CHUNKS = 64
RATE = 0.01
SEED = 12
PARAMETERS = ("emb", "conv", "bias", "hid", "hid_bias", "out", "out_bias")


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks as rows of bytes, zero beyond the end; the text of each; bytes it adds).

    Every text has at least one chunk, an empty one that of zeros."""
    raw = [np.frombuffer((t or "").encode("utf-8", "replace"), dtype=np.uint8) for t in texts]
    n = np.array([len(r) for r in raw], dtype=np.int64)
    count = 1 + np.maximum(0, -(-(n - CHUNK) // STRIDE))
    owner = np.repeat(np.arange(len(raw)), count)
    first = np.cumsum(count) - count
    start = (np.arange(len(owner)) - first[owner]) * STRIDE
    adds = np.minimum(n[owner] - start, CHUNK) - np.where(start > 0, CHUNK - STRIDE, 0)
    out = np.zeros((len(owner), CHUNK), dtype=np.uint8)
    for r, c, f in zip(raw, count, first):
        # all whole chunks at once, then the last one
        if c > 1:
            out[f:f + c - 1] = np.lib.stride_tricks.sliding_window_view(r, CHUNK)[::STRIDE][:c - 1]
        rest = r[(c - 1) * STRIDE:]
        out[f + c - 1, :len(rest)] = rest
    return out, owner, np.maximum(adds, 1).astype(np.float64)


class ByteNet:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.span = max(WIDTHS)
        n = len(WIDTHS) * FILTERS
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        # a filter is zero beyond its width
        self.inside = np.repeat(np.arange(self.span)[:, None] < np.repeat(WIDTHS, FILTERS)[None], EMBEDDING, axis=0)
        self.emb = draw(0.5, 256, EMBEDDING)
        self.conv = draw(0.3, self.span * EMBEDDING, n) * self.inside
        self.bias = np.zeros(n, np.float32)
        self.hid = draw(0.3, n, HIDDEN)
        self.hid_bias = np.zeros(HIDDEN, np.float32)
        self.out = draw(0.3, HIDDEN)
        self.out_bias = np.zeros((), np.float32)

    def _under(self, x: np.ndarray) -> np.ndarray:
        """(chunks * places, span * embedding): the embedded bytes under the filters."""
        n, length = x.shape
        e = np.zeros((n, length + self.span - 1, EMBEDDING), np.float32)
        e[:, :length] = self.emb[x]
        view = np.lib.stride_tricks.sliding_window_view(e, self.span, axis=1)  # chunks, places, embedding, span
        return view.transpose(0, 1, 3, 2).reshape(n * length, -1)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """Hidden numbers of chunks."""
        y = (self._under(x) @ self.conv).reshape(*x.shape, -1).max(axis=1)
        return np.tanh(np.maximum(y + self.bias, 0) @ self.hid + self.hid_bias)

    def probability(self, texts: list[str | None]) -> np.ndarray:
        """One probability for each whole text, to 6 digits (the last bits of single precision
        depend on what else is in the batch)."""
        x, owner, adds = chunks(texts)
        a = np.concatenate([self.hidden(x[i:i + BATCH_CHUNKS]) for i in range(0, len(x), BATCH_CHUNKS)])
        logit = a.astype(np.float64) @ self.out + self.out_bias
        first = np.searchsorted(owner, np.arange(len(texts)))
        mean = np.add.reduceat(logit * adds, first) / np.add.reduceat(adds, first)
        return np.round(1 / (1 + np.exp(-np.clip(mean, -500, 500))), 6)

    def gradients(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss of documents; a document's chunks weigh alike."""
        n, length = x.shape
        under = self._under(x)
        y = (under @ self.conv).reshape(n, length, -1)
        at = y.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(y, at[:, None], axis=1)[:, 0] + self.bias, 0)
        a = np.tanh(pooled @ self.hid + self.hid_bias)
        share = 1 / np.bincount(owner, minlength=len(label)).astype(np.float32)
        mean = np.zeros((len(label), HIDDEN), np.float32)
        np.add.at(mean, owner, a * share[owner][:, None])
        d = weight * (1 / (1 + np.exp(-(mean @ self.out + self.out_bias))) - label) / len(label)
        d_pre = (d * share)[owner][:, None] * self.out * (1 - a * a)
        d_pool = (d_pre @ self.hid.T) * (pooled > 0)
        # only the place of a filter's largest answer learns
        rows = np.take_along_axis(under.reshape(n, length, -1), at[:, :, None], axis=1)  # chunks, filters, span * embedding
        d_emb = np.zeros_like(self.emb)
        place = at[:, :, None] + np.arange(self.span)
        real = place < length
        byte = np.take_along_axis(x, np.minimum(place, length - 1).reshape(n, -1), axis=1).reshape(place.shape)
        back = (d_pool[:, :, None] * self.conv.T).reshape(n, -1, self.span, EMBEDDING)
        np.add.at(d_emb, byte[real], back[real])
        return {"out": mean.T @ d, "out_bias": d.sum(), "hid": pooled.T @ d_pre, "hid_bias": d_pre.sum(0),
                "bias": d_pool.sum(0), "conv": np.einsum("nf,nfk->kf", d_pool, rows) * self.inside, "emb": d_emb}

    def train(self, docs: list[list[bytes]], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS,
              seed: int = SEED) -> None:
        """``docs``: the chunks of each document.  Adam, the rate falling to zero."""
        rng = np.random.default_rng(seed)
        mean = {p: np.zeros_like(getattr(self, p)) for p in PARAMETERS}
        square = {p: np.zeros_like(getattr(self, p)) for p in PARAMETERS}
        steps, step = epochs * -(-len(docs) // BATCH_DOCS), 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), BATCH_DOCS):
                pick = order[i:i + BATCH_DOCS]
                pieces = [p for k in pick for p in docs[k]]
                owner = np.repeat(np.arange(len(pick)), [len(docs[k]) for k in pick])
                x = np.zeros((len(pieces), CHUNK), np.uint8)
                for r, p in enumerate(pieces):
                    x[r, :len(p)] = np.frombuffer(p, np.uint8)
                g = self.gradients(x, owner, label[pick].astype(np.float32), weight[pick].astype(np.float32))
                step += 1
                rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
                for p in PARAMETERS:
                    mean[p] += 0.1 * (g[p] - mean[p])
                    square[p] += 0.01 * (g[p] * g[p] - square[p])
                    setattr(self, p, (getattr(self, p) - rate * mean[p] / (np.sqrt(square[p]) + 1e-7)).astype(np.float32))


# -- Spark side -----------------------------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _at_most(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About twice ``n`` rows of each label at most, by a hash of the keys, and ``stands``:
    the label's rows before."""
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}  # two rows
    rate = F.lit(1.0)
    for label, c in counts.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, 2.0 * n / c))).otherwise(rate)
    return df.filter(unit_hash(*keys, seed=SEED) < rate)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        docs_per_label: int = DOCS_PER_LABEL) -> ByteNet | None:
    """Train on the bounded sample of the documents in ``df`` that ``labels`` (id_col,
    label_col: 0 or 1) marks; None if there is no such document.

    Held-out ids, null ids, other and null labels, and ids whose labels disagree are not
    learned from.  Of repeated ids in ``df`` each row is a document; a sample is taken
    before and after the join, so an id that holds most rows stays bounded."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
             .filter("label = high").select("id", "label"))
    all_of = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = _at_most(known, docs_per_label, "id")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = _at_most(docs.join(F.broadcast(picked), "id"), docs_per_label, "id", "text")  # picked: about 4 * docs_per_label rows
    start = lambda i: F.floor(i * F.greatest(F.length("text") - CHUNK, F.lit(0)) / (PIECES - 1)).cast("int") + 1
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)),
                                          lambda i: F.substring(F.col("text"), start(i), F.lit(CHUNK))))
    rows = joined.select("label", unit_hash("id", "text", seed=SEED + 1).alias("h"), "id", pieces.alias("pieces"))
    # (about 4 * docs_per_label rows of at most PIECES chunks come to the driver)
    drawn = sorted((r.label, r.h, r.id, r.pieces) for r in rows.collect())
    got = [g for k in (0, 1) for g in [d for d in drawn if d[0] == k][:docs_per_label]]
    if not got:
        return None
    label = np.array([g[0] for g in got])
    sampled = np.bincount(label, minlength=2)
    stands = np.array([all_of.get(k, 0) / max(1, sampled[k]) for k in range(2)])[label]
    model = ByteNet()
    model.train([[p.encode("utf-8", "replace")[:CHUNK] for p in g[3]] for g in got], label, stands / stands.mean())
    return model


def score(df: DataFrame, model: ByteNet | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a whole text has label 1.

    Null and empty texts are one chunk of zeros; without a model everything gets 0.5.
    Other columns pass through, repeated rows too; a column already named ``out`` is
    replaced; an empty table gives an empty one.  No shuffle.
    """
    df, schema = with_fields(df, text_col, **{out: T.DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 250):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            p = model.probability(texts) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, type=pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
