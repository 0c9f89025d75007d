"""Secret scans in DataFrame functions only: patterns, then sliding-window entropy over candidate strings.

Positions come from splitting the text at a pattern: the pieces between the matches and the matches themselves
alternate, so their lengths add up to code point offsets.

Entropy: a candidate string belongs to one character class. A window slides over it; the counts of its characters are
kept up to date by adding the character that enters and removing the one that leaves, and with them the sum of
c*log2(c), in whole millionths so that every engine gets the same figure. A window's entropy is
log2(n) - sum / n; a candidate is reported if its best window reaches the threshold of its class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

#: Kinds in the order in which spans that start together are listed. Group counts of each pattern; group 2 of ``assign`` is the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Strings that may hold a random value.
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class of a candidate: pattern, and the bits a window must reach.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("base64", r"^[A-Za-z0-9+/_=-]+$", 4.0))
#: Candidates that match one of these are no secrets: words, words joined by hyphens or underscores, numbers, paths of words.
ALLOWED = (r"^[A-Za-z_/-]+$", r"^[0-9_/=+-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[-=_+/]*[A-Za-z]+[-=_+/]{4,}.*$")
#: Parts of candidates (between slashes and equals signs) that hold one of these are made up; what stands beside them is looked at.
MADE_UP = "abcdefgh|0123456789|example|placeholder|xxxxxxxx"
PART = "[A-Za-z0-9+_-]"
SCALE = 1_000_000


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gaps(text: str, p: str) -> str:
    """SQL: what stands before each match of a pattern, from the match before."""
    return f"slice(split({text}, {p}, -1), 1, size(split({text}, {p}, -1)) - 1)"


def _matches(text: str, pattern: str, kind: int, least: int = 0) -> str:
    """SQL: array of (start, kind, end) of a pattern's matches; ``least`` is the length its group 2 must have."""
    p = _lit(pattern)
    keep = f"filter(%s, m -> m.size >= {least})" if least else "%s"
    found = f"regexp_extract_all({text}, {p}, 0)"
    if least:
        found = f"zip_with({found}, regexp_extract_all({text}, {p}, 2), (m, v) -> struct(length(m) AS len, length(v) AS size))"
    else:
        found = f"transform({found}, m -> struct(length(m) AS len, 0 AS size))"
    parts = f"zip_with({found}, {_gaps(text, p)}, (m, g) -> struct(length(g) AS gap, m.len AS len, m.size AS size))"
    empty = "cast(array() AS array<struct<start:int,kind:int,stop:int,size:int>>)"
    folded = f"aggregate({parts}, struct(0 AS at, {empty} AS found), (a, x) -> struct(a.at + x.gap + x.len AS at, concat(a.found, array(struct(a.at + x.gap AS start, {kind} AS kind, a.at + x.gap + x.len AS stop, x.size AS size))) AS found), a -> a.found)"
    return f"CASE WHEN {text} RLIKE {p} THEN transform({keep % folded}, m -> struct(m.start, m.kind, m.stop)) ELSE {_NONE} END"


_NONE = "cast(array() AS array<struct<start:int,kind:int,stop:int>>)"


def table(window: int) -> list[int]:
    """round(c * log2(c) * SCALE) for the counts a window can hold."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 2)]


def _least_sum(value: str, window: int) -> str:
    """SQL: the least sum of c*log2(c) over the windows of a string, from counts kept incrementally."""
    costs = "array(" + ",".join(f"{x}L" for x in table(window)) + ")"
    at = lambda i: f"instr({_lit(ALPHABET)}, substr({value}, {i}, 1))"
    enter = f"struct(transform(a.counts, (q, j) -> q + cast(j + 1 = {at('i')} AS int)) AS counts, a.total + {costs}[a.counts[{at('i')} - 1] + 1] - {costs}[a.counts[{at('i')} - 1]] AS total, a.best AS best)"
    out = at(f"i - {window}")
    leave = f"transform(array({enter}), e -> CASE WHEN i > {window} THEN struct(transform(e.counts, (q, j) -> q - cast(j + 1 = {out} AS int)) AS counts, e.total + {costs}[e.counts[{out} - 1] - 1] - {costs}[e.counts[{out} - 1]] AS total, e.best AS best) ELSE e END)[0]"
    step = f"transform(array({leave}), e -> struct(e.counts AS counts, e.total AS total, CASE WHEN i >= {window} THEN least(e.best, e.total) ELSE e.best END AS best))[0]"
    return f"aggregate(sequence(1, length({value})), struct(array_repeat(0, {len(ALPHABET)}) AS counts, 0L AS total, {1 << 62}L AS best), (a, i) -> {step}, a -> a.best)"


def limit(bits: float, window: int) -> int:
    """The sum of c*log2(c) at which a window has ``bits`` of entropy."""
    return round((math.log2(window) - bits) * window * SCALE)


def _masked(text: str, spans: str) -> str:
    """SQL: a text with blanks in place of its spans."""
    start = "greatest(m.start, a.at)"
    step = f"CASE WHEN m.stop <= a.at THEN a ELSE struct(m.stop AS at, concat(a.out, substr({text}, a.at + 1, {start} - a.at), repeat(' ', m.stop - {start})) AS out) END"
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate(array_sort({spans}), struct(0 AS at, '' AS out), (a, m) -> {step}, a -> concat(a.out, substr({text}, a.at + 1))) END"


def _entropy(text: str, window: int) -> str:
    """SQL: (start, kind, end) of the candidates that one of their windows gives away."""
    p, made_up = _lit(CANDIDATE), _lit(f"(?<!{PART}){PART}*?(?i:{MADE_UP}){PART}*+")
    empty = "cast(array() AS array<struct<start:int,stop:int,value:string>>)"
    pieces = f"zip_with(regexp_extract_all({text}, {p}, 0), {_gaps(text, p)}, (m, g) -> struct(m, g))"
    placed = f"aggregate({pieces}, struct(0 AS at, {empty} AS found), (a, x) -> struct(a.at + length(x.g) + length(x.m) AS at, concat(a.found, array(struct(a.at + length(x.g) AS start, a.at + length(x.g) + length(x.m) AS stop, x.m AS value))) AS found), a -> a.found)"
    # what a candidate has beside its made-up parts
    beside = f"zip_with(split(c.value, {made_up}, -1), regexp_extract_all(c.value, {made_up}, 0), (g, m) -> struct(g AS g, coalesce(length(m), 0) AS skip))"
    kept = f"aggregate({beside}, struct(c.start AS at, {empty} AS found), (a, x) -> struct(a.at + length(x.g) + x.skip AS at, concat(a.found, array(struct(a.at AS start, a.at + length(x.g) AS stop, x.g AS value))) AS found), a -> a.found)"
    split = f"flatten(transform({placed}, c -> CASE WHEN c.value RLIKE {_lit(f'(?i:{MADE_UP})')} THEN {kept} ELSE array(c) END))"
    allowed = " OR ".join([f"length(c.value) < {window}", *(f"c.value RLIKE {_lit(a)}" for a in ALLOWED)])
    bound = "CASE " + " ".join(f"WHEN c.value RLIKE {_lit(pattern)} THEN {limit(bits, window)}L" for _, pattern, bits in CLASSES) + " END"
    hit = f"CASE WHEN {allowed} THEN false ELSE {_least_sum('c.value', window)} <= {bound} END"
    return f"CASE WHEN {text} RLIKE {p} THEN transform(filter({split}, c -> {hit}), c -> struct(c.start, 3 AS kind, c.stop)) ELSE {_NONE} END"


def _listed(spans: str) -> str:
    return f"array_join(transform(array_sort({spans}), m -> concat(element_at(array('assign', 'access', 'hex', 'entropy'), m.kind + 1), ':', m.start, ':', m.stop)), ',')"


def scan(docs: DataFrame, text_col: str = "text", window: int = 24) -> DataFrame:
    """``docs`` with ``_sec_base`` and ``_sec_added``: arrays of (start, kind, end), code points, end exclusive.

    Kinds 0 to 2 are the patterns ``assign``, ``access`` and ``hex``, leftmost and without overlap within a kind;
    kind 3 are strings of high entropy in what the others leave: a candidate is cut at their spans and at its made-up
    parts. A null or empty text has none. Texts are scanned whole; every row by itself, so repeated rows and further
    columns, of any name, make no difference.
    """
    text, rest = free(docs, "_sec_text", "_sec_rest")
    docs = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    base = f"concat({_matches(text, ASSIGN, 0, 8)}, {_matches(text, ACCESS, 1)}, {_matches(text, HEX, 2)})"
    docs = docs.withColumn("_sec_base", F.expr(base)).withColumn(rest, F.expr(_masked(text, "_sec_base")))
    return docs.withColumn("_sec_added", F.expr(_entropy(rest, window))).drop(text, rest)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 24) -> DataFrame:
    """Per document: counts by kind, the base spans' SHA-256 and all spans as text (see ``scan``)."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", window)
    kind = lambda k: F.expr(f"cast(size(filter(_sec_base, m -> m.kind = {k})) AS long)")
    return found.select("doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.expr("cast(size(_sec_added) AS long)").alias("n_entropy"), F.sha2(F.expr(_listed("_sec_base")), 256).alias("base_sha256"), F.expr(_listed("concat(_sec_base, _sec_added)")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", window: int = 24) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; a null text stays null. Columns of any name pass through."""
    inner = docs.select(F.struct("*").alias("_sec_row"), F.col(text_col).alias("_sec_in"))
    found = scan(inner, "_sec_in", window).withColumn("_sec_all", F.expr("array_sort(concat(_sec_base, _sec_added))"))
    cut = f"aggregate(_sec_all, struct(0 AS at, '' AS out), (a, m) -> CASE WHEN m.stop <= a.at THEN a ELSE struct(m.stop AS at, CASE WHEN m.start < a.at THEN a.out ELSE concat(a.out, substr(_sec_in, a.at + 1, m.start - a.at), {_lit(mark)}) END AS out) END, a -> concat(a.out, substr(_sec_in, a.at + 1)))"
    return found.select(*(F.expr(cut).alias(c) if c == text_col else F.col("_sec_row")[c].alias(c) for c in docs.columns))
