"""Spelling variant grouping (operator 11) by PartEnum signatures.

Words are counted over all texts; two words are *near* if they differ by exactly one
inserted, deleted or replaced character.  A word's *form* is its near word with the
largest count, if that is at least ``MIN_RATIO`` times its own; following forms to the end
gives its root.

A word's letter multiset is a binary vector over (letter, how many-th of it).  Near words
differ in one place of it (insertion, deletion) or in two (replacement).  The places are
dealt into ``PARTS`` parts; with at most k differing places at least ``PARTS`` - k parts
agree, so words that agree in no choice of that many parts cannot be near (partition and
enumerate).  A signature is such a choice, a digest of its parts, and, since a letter
multiset alone parts words of few letters badly, one half of the word: an edit lies in one
half, so the first or the last half of the shorter word's length is equal.

* Replacements: words of equal length join on 2 of 4 parts (six choices) and a half.
* Insertions: a word joins with words one longer on 3 or 4 parts; two choices of two parts
  that cover all four are enough (one part differs).

Signatures are joined by equality and every candidate pair is verified inside the join by
its edit distance, so only near pairs leave it.  A pair that agrees in several signatures
is kept in the first one only, which both rows tell from the parts' digests they carry.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .bpe import slices
from .near_dup import mix64

# Fixed values of the word rule: runs of these letters; of about every 31st run a letter goes.
RUN = rb"[A-Za-z\xC0-\xFF]+"
DROP_EVERY = 31
MIN_LETTERS = 7
MIN_COUNT = 2
MIN_RATIO = 10
PARTS = 4
PART_BITS = 16
PAIRS = list(combinations(range(PARTS), 2))
# Choices of parts: any two (two parts may differ), or two that leave each part out once.
CHOICES = {"replace": PAIRS, "insert": [(0, 2), (1, 3)]}
# Words counted in one task before they go to the shuffle.
FLUSH_WORDS = 200_000
SLICE_WORDS = 20_000
_G = np.uint64(0x9E3779B97F4A7C15)


# -- words ------------------------------------------------------------------------------------
def as_letters(text: str) -> bytes:
    """Code points up to FF as one byte each (others, of no run, as ?), A-Z lower-cased."""
    return text.encode("latin-1", "replace").lower()


def text_words(doc_id: int | None, text: str, least: int) -> Counter:
    """Counts of one text's words of at least ``least`` letters.

    Without an id no letter is deleted."""
    got = Counter(re.findall(rb"[A-Za-z\xC0-\xFF]{%d,}" % least, as_letters(text)))
    if doc_id is None:
        return got
    start = zlib.crc32(b"%d:" % doc_id)
    out = Counter()
    for w, n in got.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % DROP_EVERY == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1:]
            if len(w) < least:
                continue
        out[w] += n
    return out


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all whole texts.  Counted inside each task first, so a word
    that is everywhere is one row of each task."""
    least = max(1, min_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], type=pa.string()),
                                               pa.array(list(seen.values()), type=pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    seen.update(text_words(doc, text, least))
                    if len(seen) > FLUSH_WORDS:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


# -- signatures ---------------------------------------------------------------------------------
def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums (modulo 2^64) of the stretches of x that end at ``ends``, the first from 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[ends]
    return np.diff(total, prepend=np.uint64(0))


def signatures(words: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Keys of each word and the digests of its parts, 16 bits each.

    The keys: ``replace`` (words x 12), ``shorter`` and ``longer`` (words x 4: as the
    shorter or the longer word of an insertion).  The last four bits of a key number the
    half and the choice of parts."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(length)
    first = ends - length
    owner = np.repeat(np.arange(len(words)), length)
    with np.errstate(over="ignore"):
        # letters of a word in order, and how many-th of its kind each is
        letters = np.sort((owner.astype(np.uint64) << np.uint64(21)) | flat)
        new = np.concatenate([[True], letters[1:] != letters[:-1]])
        nth = np.arange(len(flat)) - np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
        element = mix64((letters & np.uint64(2 ** 21 - 1)) * _G + nth.astype(np.uint64))
        part = (element >> np.uint64(8)) % np.uint64(PARTS)
        low = np.uint64(2 ** PART_BITS - 1)
        digest = [mix64(_sums(np.where(part == p, element, np.uint64(0)), ends)) & low for p in range(PARTS)]
        packed = digest[0].copy()
        for p in range(1, PARTS):
            packed |= digest[p] << np.uint64(PART_BITS * p)
        place = np.arange(len(flat)) - first[owner]
        from_end = length[owner] - 1 - place

        def half(m: np.ndarray, last: bool) -> np.ndarray:
            """Hash of the first or last m // 2 letters."""
            at = from_end if last else place
            h = mix64(flat * _G + at.astype(np.uint64))
            return mix64(_sums(np.where(at < (m // 2)[owner], h, np.uint64(0)), ends) + m.astype(np.uint64))

        def keys(kind: int, m: np.ndarray, choices: list[tuple[int, int]]) -> np.ndarray:
            out = []
            for last in (False, True):
                h = half(m, last)
                for c, (i, j) in enumerate(choices):
                    k = mix64((h * _G + np.uint64(kind)) * _G + (digest[i] << np.uint64(PART_BITS) | digest[j]))
                    out.append(k >> np.uint64(4) << np.uint64(4) | np.uint64(8 * last + c))
            return np.stack(out, axis=1).view(np.int64)

        got = {"replace": keys(1, length, CHOICES["replace"]), "shorter": keys(2, length, CHOICES["insert"]),
               "longer": keys(2, length - 1, CHOICES["insert"])}
    return got, packed.view(np.int64)


def _sign(kinds: tuple[str, ...]):
    """word, n -> key, parts, word, n for the keys of the given kinds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_WORDS):
            if not b.num_rows:
                continue
            keys, parts = signatures(b.column(0).to_pylist())
            for kind in kinds:
                for c in range(keys[kind].shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[kind][:, c]), pa.array(parts), *b.columns],
                                                     names=["key", "parts", "word", "n"])
    return run


def _first_choice(differ: Column, choices: list[tuple[int, int]]) -> Column:
    """Number of the first choice whose parts agree (``differ``: exclusive or of the digests)."""
    out = F.lit(-1)
    for c in reversed(range(len(choices))):
        mask = sum((2 ** PART_BITS - 1) << (PART_BITS * p) for p in choices[c])
        mask -= 2 ** 64 if mask >= 2 ** 63 else 0
        out = F.when(differ.bitwiseAND(F.lit(mask)) == 0, c).otherwise(out)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of near words once; ``words``: (word, n), no repeats."""
    schema = "key long, parts long, word string, n long"

    def joined(a: DataFrame, b: DataFrame, choices: list[tuple[int, int]], once: Column | None = None) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        choice = F.col("a.key").bitwiseAND(7)
        half = (F.least(F.length("a.word"), F.length("b.word")) / 2).cast("int")
        # in the first signature that holds: the first half's before the last half's
        first = (choice == _first_choice(F.col("a.parts").bitwiseXOR(F.col("b.parts")), choices)) & (
            (F.col("a.key").bitwiseAND(8) == 0) | (F.left(F.col("a.word"), half) != F.left(F.col("b.word"), half)))
        on = (F.col("a.key") == F.col("b.key")) & first & (F.levenshtein("a.word", "b.word", 1) == 1)
        return a.join(b.hint("merge"), on if once is None else on & once).select(
            F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))

    same = words.mapInArrow(_sign(("replace",)), schema)
    shorter, longer = (words.mapInArrow(_sign((k,)), schema) for k in ("shorter", "longer"))
    return (joined(same, same, CHOICES["replace"], F.col("a.word") < F.col("b.word"))
            .union(joined(shorter, longer, CHOICES["insert"])))


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of the words with a form: forms are followed by doubling.

    Counts grow at least by a factor from a word to its form, so there are no circles and
    the number of rounds is about the logarithm of the longest path."""
    spark = forms.sparkSession
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{folder}/roots0")
    now, k = spark.read.parquet(f"{folder}/roots0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        k += 1
        now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                            F.col("next").isNotNull().alias("moved")).write.parquet(f"{folder}/roots{k}")
        step = spark.read.parquet(f"{folder}/roots{k}")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def group(words: DataFrame, min_ratio: int = MIN_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``words`` (word, n).

    form: the near word of the largest count (ties: smallest in code-point order) if that
    is at least ``min_ratio`` times n, else null; root: the last word that forms lead to,
    the word itself without one; n_near: its number of near words.  Words are distinct;
    an empty table gives an empty result.  ``min_ratio`` is above 1, so forms never turn
    in circles.
    """
    if min_ratio <= 1:
        raise ValueError("min_ratio must be above 1")
    spark = words.sparkSession
    folder = scratch_dir(spark, "spelling")
    words.select("word", "n").write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    # each side's best near word: largest count, then smallest word
    near = lambda word, other, n: F.struct(F.col(word).alias("word"), F.struct((-F.col(n)).alias("minus"),
                                                                              F.col(other).alias("word")).alias("other"))
    both = near_pairs(words).select(F.explode(F.array(near("a", "b", "n_b"), near("b", "a", "n_a"))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    form = -F.col("best.minus") >= min_ratio * F.col("n")
    (words.join(best, "word", "left")
     .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
             F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.minus")).alias("form_n"))
     .write.parquet(f"{folder}/forms"))
    rows = spark.read.parquet(f"{folder}/forms")
    roots = _roots(rows.filter("form is not null"), folder)
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
             min_count: int = MIN_COUNT, min_ratio: int = MIN_RATIO) -> DataFrame:
    """``group`` of the words of all whole texts of ``df``.

    Null and empty texts have no words; a null id deletes no letter; repeated rows count
    again.  Only the two named columns are read."""
    return group(vocabulary(df, id_col, text_col, min_letters, min_count), min_ratio)
