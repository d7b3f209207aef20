"""Text preparation as Column -> Column expressions.

All of these compile to JVM expressions (regexp_replace, split, higher-order
array functions), so they stay inside whole-stage codegen and run wherever the
rows are; no Python runs per row.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for equal results across engines)
# ---------------------------------------------------------------------------
# Blocks removed first, each up to its own closing tag (or the end, if it is never
# closed): comments, scripts, styles, embedded objects; then meta, embed and link tags.
HTML_BLOCKS_RE = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style|object|applet|iframe)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
    r"|<(?:meta|embed|link)\b[^>]*+>"
)
# Any remaining tag: a name, "/", "!" or "?" must follow "<"; a ">" inside a quoted
# attribute does not end it (unless the quote is never closed).
HTML_TAG_RE = r"""(?s)<[A-Za-z/!?](?:(?:"[^"]*+"|'[^']*+'|[^'">])*+>|[^>]*+>)"""
# A character reference, up to its semicolon.
ENTITY_RE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Whitespace class spelled out so that the JVM and other engines agree
# (tab, newline, vertical tab, form feed, carriage return, space, no-break space).
WS_RE = r"[\t\n\x{0B}\f\r \x{00A0}]+"
# Token separator: anything that is not a letter or a digit.
TOKEN_SPLIT_RE = r"[^\p{L}\p{N}]+"
# Structural tags of a trec-web record, matched case-insensitively.
MARKER_RE = r"</?doc(no|hdr)?>"
# Separator marks added by a paired (query, passage) model input.
PAIR_SPECIAL_TOKENS = 3


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squash_ws(col) -> Column:
    """Collapse every whitespace run to one space and trim the ends."""
    return F.trim(F.regexp_replace(_c(col), WS_RE, " "))


def _named_entities() -> Column:
    """Map of the named character references (the public HTML table of the standard library)."""
    names = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))


def _entity_value(name: Column) -> Column:
    """The character of a reference's name (``#8217``, ``#x2019``, ``rsquo``), null if unknown."""
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(
        F.substring(name, 2, 8)).try_cast("long")
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(F.startswith(name, F.lit("#")), F.when(real, char)).otherwise(F.try_element_at(_named_entities(), name))


def decode_entities(col) -> Column:
    """Numeric and named character references, each decoded once (``&amp;lt;`` gives
    ``&lt;``); what is no known reference stays."""
    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, ENTITY_RE, 1)
        known = F.concat(F.coalesce(_entity_value(name), F.concat(F.lit("&"), name, F.lit(";"))),
                         F.substring(part, F.length(name) + 2, F.length(part)))
        return F.when(i == 0, part).when(name == "", F.concat(F.lit("&"), part)).otherwise(known)

    c = _c(col)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&", -1), one), "")).otherwise(c)


def html_to_text(col) -> Column:
    """Drop comments, scripts, styles, embedded objects and meta tags, then all tags;
    decode character references and squash whitespace.  Other text stays."""
    c = F.regexp_replace(_c(col), HTML_BLOCKS_RE, " ")
    c = F.regexp_replace(c, HTML_TAG_RE, " ")
    return squash_ws(decode_entities(c))


def has_marker(col) -> Column:
    """T4: does the line hold a structural record tag (case-insensitive)."""
    return F.lower(_c(col)).rlike(MARKER_RE)


def split_docid(col) -> Column:
    """T5: ``GX000-10-0000000`` -> struct(dir, file, record, shard)."""
    parts = F.split(_c(col), "-")
    return F.struct(
        F.get(parts, 0).alias("dir"),
        F.get(parts, 1).alias("file"),
        F.get(parts, 2).alias("record"),
        F.concat(F.get(parts, 0), F.lit("/"), F.get(parts, 1), F.lit(".gz")).alias("shard"),
    )


def tokenize(col) -> Column:
    """Lower-case, split on non letter/digit runs, drop empty strings.

    Works on the whole text; no length cap.
    """
    return F.array_remove(F.split(F.lower(_c(col)), TOKEN_SPLIT_RE), "")


def token_line(col) -> Column:
    """The tokens of ``tokenize``, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), TOKEN_SPLIT_RE, " "))


def explode_terms(df, *keep, tokens="tokens", out: str = "term"):
    """One row per token (kept columns repeated), rows of empty texts dropped.

    Written with ``explode_outer`` + a null filter: a plain ``explode`` makes the
    optimizer infer ``size(tokens) > 0`` and push it below a repartition, which
    would tokenize the corpus a second time in the scan task.
    """
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select(*keep, F.explode_outer(t).alias(out)).filter(F.col(out).isNotNull())


def fit_budget(q_tokens, p_tokens, max_len: int = 256) -> Column:
    """Passage tokens that fit next to the query in a ``max_len`` model input."""
    room = F.greatest(F.lit(0), F.lit(max_len - PAIR_SPECIAL_TOKENS) - F.size(_c(q_tokens)))
    return F.slice(_c(p_tokens), F.lit(1), room)


def parse_trecweb(record) -> tuple[Column, Column, Column]:
    """(docid, html, parse_error) of one ``<DOC>...</DOC>`` record.

    The record must start (after the ``<DOC>`` tag) with ``<DOCNO>``; the id is
    between the DOCNO tags; the body is everything after the first ``</DOCHDR>``, without
    later ``</DOCHDR>`` and ``</DOC>`` tags.  Errors are reported in a column instead of
    failing the job.
    """
    body = F.trim(F.regexp_replace(_c(record), r"(?s)^\s*<DOC>\s*|\s*</DOC>\s*$", ""))
    docno_e = F.locate("</DOCNO>", body)
    hdr_s = F.locate("<DOCHDR>", body)
    hdr_e = F.locate("</DOCHDR>", body)
    docid = F.trim(F.replace(F.substring_index(body, "</DOCNO>", 1), F.lit("<DOCNO>"), F.lit("")))
    err = (
        F.when(~body.startswith("<DOCNO>"), F.lit("record does not start with <DOCNO>"))
        .when(docno_e == 0, F.lit("missing </DOCNO>"))
        .when(hdr_s == 0, F.lit("missing <DOCHDR>"))
        .when(hdr_e == 0, F.lit("missing </DOCHDR>"))
        .when(hdr_e < hdr_s, F.lit("</DOCHDR> before <DOCHDR>"))
    )
    rest = F.substring(body, hdr_e + len("</DOCHDR>"), F.length(body))
    for tag in ("</DOCHDR>", "</DOC>"):
        rest = F.replace(rest, F.lit(tag), F.lit(""))
    page = F.regexp_replace(rest, r"^\s+|\s+$", "")
    return (
        F.when(body.startswith("<DOCNO>") & (docno_e > 0), docid),
        F.when(err.isNull(), page),
        err,
    )


def uniform(seed, *keys) -> Column:
    """Deterministic number in [0, 1) from md5(seed|key...): first 8 hex digits / 2^32.

    Same value in any engine that has md5, so samples are reproducible and
    survive task retries.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_order(seed, *keys) -> Column:
    """Deterministic shuffle key: md5 hex of (seed|key...)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
