"""Personal data (operator 6), with DataFrame functions only.

Base patterns find e-mail and IP addresses, card and phone numbers.  The method adds
more: two high-recall generators propose spans (anything number-like, anything
address-like, also spelled out), boosted trees score each by its format and context, and
those above a calibrated threshold that overlap no base span are reported, best first.

The trees are fitted by ``pyspark.ml`` on the candidates of all documents, labelled by
whether a candidate is a base span, and are then written out as one SQL expression, so that
scoring is part of the scan: no shuffle and no Python.

Positions: a text split at its matches has one more gap than matches, so the running sum
of gap and match lengths is the place of each match, in code points.  The patterns equal
the plain ones but try no start inside a run that has already failed (look-behind, or the
end of the last match) and never give back what they took, so long runs stay linear.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

# The base patterns, in the order of the kinds.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The generators.
NUMBER_LIKE = r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,30}+"
ADDRESS_LIKE = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++"
                r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++")
LABEL_WORDS = r"(?i)(tel|phone|call|fax|mobile|mail|contact|card|visa|account|address|host|\bip)\W{0,3}$"
CONTEXT = 24
TREES = 12
DEPTH = 3
MIN_PRECISION = 0.98
BINS = 50
_SPANS = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str, worth: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches; ``worth`` (a cheap test)
    tells texts that cannot match."""
    none = F.expr(f"cast(array() as {_SPANS})")

    def place(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        both = F.arrays_zip(gaps.alias("gap"), found.alias("value"))

        def add(acc: Column, m: Column) -> Column:
            start = acc.at + F.length(m.gap)
            end = start + F.length(m.value)
            one = F.struct(start.alias("start"), end.alias("end"), m.value.alias("value"))
            return F.struct(end.alias("at"), F.concat(acc.spans, F.array(one)).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        matched = F.filter(both, lambda m: m.value.isNotNull())
        return F.when(F.size(gaps) > 1, F.aggregate(matched, zero, add, lambda acc: acc.spans)).otherwise(none)

    # the split is bound to a variable: it is used twice but done once
    gaps = F.split(text, pattern, -1)
    got = F.element_at(F.transform(F.array(gaps), place), 1)
    return got if worth is None else F.when(worth, got).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn test of a string of digits."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + d

    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add)
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def _small_parts(v: Column) -> Column:
    """All parts between dots are at most 255 (leading zeros do not count)."""
    def small(p: Column) -> Column:
        short = F.regexp_replace(p, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (F.coalesce(F.try_to_number(short, F.lit("999")), F.lit(0)) <= 255)

    return F.forall(F.split(v, r"\."), small)


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, failing matches dropped."""
    digits = lambda s: F.length(_digits(s.value))
    return {
        "email": spans(text, PATTERNS["email"], F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, PATTERNS["ip"]), lambda s: _small_parts(s.value)),
        "card": F.filter(spans(text, PATTERNS["card"]),
                         lambda s: F.when(digits(s).between(16, 19), luhn(_digits(s.value))).otherwise(F.lit(False))),
        "phone": F.filter(spans(text, PATTERNS["phone"], F.contains(text, F.lit("+"))), lambda s: digits(s).between(8, 15)),
    }


def _count(v: Column, pattern: str) -> Column:
    return F.regexp_count(v, F.lit(pattern))


def features(text: Column, s: Column) -> list[Column]:
    """Format and context of a candidate, as named numbers."""
    v = s.value
    before = F.substring(text, F.greatest(s.start - CONTEXT + 1, F.lit(1)), F.least(s.start, F.lit(CONTEXT)))
    after = F.substring(text, s.end + 1, F.lit(CONTEXT))
    digits = _digits(v)
    f = {
        "chars": F.length(v), "digits": F.length(digits), "letters": _count(v, "[A-Za-z]"), "dots": _count(v, r"\."),
        "dashes": _count(v, "-"), "spaces": _count(v, " "), "parens": _count(v, "[()]"), "plus": _count(v, r"\+"),
        "at": _count(v, "@"), "groups": _count(v, "[0-9]+"),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"), "small_parts": _small_parts(F.regexp_replace(v, "[^0-9.]", "")).cast("int"),
        "word_before": before.rlike("[A-Za-z0-9]$").cast("int"), "word_after": after.rlike("^[A-Za-z0-9]").cast("int"),
        "label_before": before.rlike(LABEL_WORDS).cast("int"), "sign_before": before.rlike(r"[:=]\s?$").cast("int"),
        "digits_near": _count(F.concat(before, after), "[0-9]"),
    }
    return [c.cast("double").alias(k) for k, c in f.items()]


FEATURES = ("chars digits letters dots dashes spaces parens plus at groups luhn small_parts word_before word_after "
            "label_before sign_before digits_near").split()


def with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Add _text, _base (array of kind_no, start, end) and _cand (spans of the generators
    and the base, with features and the label ``base``)."""
    text = F.col("_text")
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({f"_{k}": c for k, c in base_spans(text).items()})

    def numbered(i: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(F.lit(i).alias("kind_no"), s.start.alias("start"), s.end.alias("end")))

    base = F.concat(*[numbered(i, k) for i, k in enumerate(KINDS)])
    address = spans(text, ADDRESS_LIKE, F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)"))
                    | F.contains(text, F.lit("at]")))
    df = df.withColumn("_base", base).withColumn(
        "_raw", F.array_distinct(F.concat(*[F.col(f"_{k}") for k in KINDS], spans(text, NUMBER_LIKE), address)))
    same = lambda s: F.exists("_base", lambda b: (b.start == s.start) & (b.end == s.end))
    touch = lambda s: F.exists("_base", lambda b: (b.start < s.end) & (s.start < b.end))
    cand = F.transform("_raw", lambda s: F.struct(
        s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), same(s).alias("base"),
        touch(s).alias("touches"), *features(text, s)))
    return df.withColumn("_cand", cand).drop("_raw", *[f"_{k}" for k in KINDS])


class Model(NamedTuple):
    """Boosted trees as nested (feature, split, below, above) or a leaf's value, their
    weights, and the threshold on the probability."""

    trees: list
    weights: list[float]
    threshold: float

    def probability(self, c: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, split, below, above = node
            return F.when(c.getField(FEATURES[feature]) <= split, walk(below)).otherwise(walk(above))

        margin = sum((walk(t) * w for t, w in zip(self.trees, self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _tree(lines: list[str]):
    """One tree from the lines of Spark's description of it (consumed from the front)."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return float(m[1])
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    below = _tree(lines)
    lines.pop(0)  # Else
    return int(m[1]), float(m[2]), below, _tree(lines)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit and calibrate the trees on the candidates of all documents; None (the method adds
    nothing) if there is only one class of them.

    A candidate that overlaps a base span but is not one is left out.  The threshold is
    the lowest one, in steps of 1 / ``BINS``, whose precision on the odd ids
    reaches ``MIN_PRECISION``; the trees are fitted on the even ids."""
    path = scratch_dir(df.sparkSession, "pii-candidates")
    (with_candidates(df.select(F.col(id_col).alias("_id"), text_col), text_col)
     # (explode would infer a filter on the array's size and copy all its expressions into it)
     .select("_id", F.explode_outer("_cand").alias("c")).filter("c.base or not c.touches")
     .select((F.pmod(F.xxhash64("_id"), F.lit(2)) == 1).alias("odd"), F.col("c.base").cast("double").alias("label"),
             *[F.col(f"c.{f}").alias(f) for f in FEATURES])
     .write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    both = {(r.odd, r.label) for r in rows.select("odd", "label").distinct().collect()}
    if {(False, 0.0), (False, 1.0)} - both:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.filter("not odd"))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=42).fit(vectors)
    trees = [_tree(t.toDebugString.splitlines()[1:]) for t in fitted.trees]
    model = Model(trees, list(fitted.treeWeights), 1.0)
    row = F.struct(*FEATURES)
    bins = (rows.filter("odd").select("label", F.floor(model.probability(row) * BINS).alias("bin"))
            .groupBy("bin").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")).collect())
    threshold = 1.0
    for lowest in sorted((r.bin for r in bins), reverse=True):
        above = [r for r in bins if r.bin >= lowest]
        if sum(r.right for r in above) < MIN_PRECISION * sum(r.n for r in above):
            break
        threshold = lowest / BINS
    return model._replace(threshold=max(threshold, 0.5))


def find(df: DataFrame, model: Model | None, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array<struct<kind_no, start, end, kind, base>> of every whole text, by
    kind as listed, then start.  Base spans are always there.

    Null and empty texts have none.  Other columns pass through, repeated rows too; a
    column already named ``out`` is replaced; an empty table gives an empty one.
    """
    names = F.array(*map(F.lit, KINDS))
    span = lambda kind, s, base: F.struct(kind.alias("kind_no"), s.start.alias("start"), s.end.alias("end"),
                                          F.element_at(names, kind + 1).alias("kind"), F.lit(base).alias("base"))
    # the row goes along as one column, so that no working column clashes with its names
    work = with_candidates(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), "text")
    found = F.transform("_base", lambda s: span(s.kind_no, s, True))
    if model is not None:
        kind = lambda c: (F.when((c.at > 0) | (c.letters > 0), F.lit(0))
                          .when((c.dots == 3) & (c.groups == 4), F.lit(1)).when(c.digits >= 13, F.lit(2)).otherwise(F.lit(3)))
        good = F.transform(F.filter("_cand", lambda c: ~c.touches), lambda c: F.struct(
            (-model.probability(c)).alias("order"), (c.start - c.end).alias("length"), c.start.alias("start"),
            c.end.alias("end"), kind(c).alias("kind_no")))
        good = F.array_sort(F.filter(good, lambda c: -c.order >= model.threshold))
        empty = F.expr("cast(array() as array<struct<kind_no:int,start:int,end:int,kind:string,base:boolean>>)")
        taken = F.aggregate(good, empty, lambda acc, c: F.when(
            F.exists(acc, lambda a: (a.start < c.end) & (c.start < a.end)), acc).otherwise(
                F.concat(acc, F.array(span(c.kind_no, c, False)))))
        found = F.concat(found, taken)
    rest = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != out.lower()]
    return work.withColumn("found", F.array_sort(found)).select(*rest, F.col("found").alias(out))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii", out: str = "redacted") -> DataFrame:
    """Add ``out``: the text with every span replaced by its kind in brackets; of
    overlapping spans the first is replaced, and the rest of the others with it.  Null
    texts stay null."""
    text = F.col(text_col)
    by_start = F.array_sort(F.transform(spans_col, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"),
                                                                     s.kind.alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc.at + 1, s.start - acc.at)
        return F.when(s.start < acc.at, F.struct(F.greatest(acc.at, s.end).alias("at"), acc.done.alias("done"))).otherwise(
            F.struct(s.end.alias("at"), F.concat(acc.done, gap, F.lit("["), s.kind, F.lit("]")).alias("done")))

    return df.withColumn(out, F.aggregate(by_start, zero, add, lambda acc: F.concat(
        acc.done, F.substring(text, acc.at + 1, F.length(text)))))
