"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go.

A line fails if it is navigation (short items joined by bars, arrows or bullets), boilerplate (a phrase of a stated
list), or if its punctuation is not that of prose (mostly symbols, or a long line without any stop that is not a
heading or list item). The document fails if the lines removed hold more than a stated share of its word characters.
Every document is judged by itself in one pass, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
SYMBOLS = re.compile(rb"[#*$%&|<>]")
BOILERPLATE = (b"all rights reserved", b"terms of service", b"terms of use", b"privacy policy", b"cookie policy", b"accept cookies", b"javascript is disabled", b"enable javascript", b"sign up for our newsletter", b"subscribe to our newsletter", b"click here to", b"licensed under the", b"lorem ipsum")
NAVIGATION = frozenset((b"|", b">", b">>", "»".encode(), "›".encode(), "•".encode(), "·".encode(), b"/"))
STOPS = tuple(x.encode() for x in (".", "!", "?", "…", "。", "！", "？", ":", ";", "»", '"', "”", "'", ")", "]"))

#: A line with this share of symbols among its word characters, or of bars among its words, fails.
SYMBOL_SHARE, BAR_SHARE = 0.2, 0.2
#: A line of this many words or more without any word that ends in a stop fails.
UNSTOPPED_WORDS = 60
#: A document is rejected if more than this share of its word characters went.
LOST_SHARE = 0.4


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """The verdict of the line rules."""
    n, chars = len(words), sum(map(len, words))
    if sum(w in NAVIGATION for w in words) > BAR_SHARE * n and n >= 3:
        return True
    if len(SYMBOLS.findall(line)) > SYMBOL_SHARE * chars:
        return True
    low = line.lower()
    if any(b in low for b in BOILERPLATE):
        return True
    return n >= UNSTOPPED_WORDS and not any(w.endswith(STOPS) for w in words)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of three that is found twice or more."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total = end = 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str]:
    """Words, word characters, symbols, repeated lines, repeated words, base verdict, kept, cleaned text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, repeats = len(words), repeated_words(words)
    base_failed = n < 50 or 100 * repeats > 50 * n
    symbols = len(SYMBOLS.findall(raw))
    seen: set[bytes] = set()
    again = bytes_all = bytes_kept = 0
    kept_lines = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        again += line in seen
        seen.add(line)
        size = sum(map(len, own))
        bytes_all += size
        if not line_fails(line, own):
            bytes_kept += size
            kept_lines.append(line)
    chars = len(raw.decode("utf-8", "surrogatepass")) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    kept = not base_failed and bytes_kept >= (1 - LOST_SHARE) * bytes_all
    return n, chars, symbols, again, repeats, base_failed, kept, b"\n".join(kept_lines).decode("utf-8", "surrogatepass")


KINDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and the figures and verdicts of ``judge``.

    A null text has no words; it and texts under 50 words fail the base rules. Texts are read whole. Repeated rows
    are judged alike, each for itself. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t)[:7] for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.bool_() if k == "boolean" else pa.int64()) for c, (_, k) in zip(columns, KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(n for n, _ in KINDS)])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} {k}" for n, k in KINDS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their failing lines removed; the columns of ``docs``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t)[6:] for t in batch.column(at).to_pylist()]
            texts = pa.array([t for _, t in rows], pa.string())
            whole = batch.set_column(at, text_col, texts)
            yield whole.filter(pa.array([k for k, _ in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _sql() -> str:
    """The digest of ``judged`` in SQL, the line rules written out."""
    stops = ", ".join("'" + s.decode().replace("'", "''") + "'" for s in STOPS)
    bars = ", ".join(f"'{b.decode()}'" for b in sorted(NAVIGATION))
    phrases = " OR ".join(f"contains(lower(line), '{b.decode()}')" for b in BOILERPLATE)
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {word}) AS words FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS times FROM g),
r AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM c, (VALUES (0), (1), (2)) AS offsets(o) WHERE times > 1 GROUP BY rid),
l AS (SELECT rid, pos, line, regexp_extract_all(line, {word}) AS own FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
f AS (SELECT *, len(own) AS n, coalesce(list_sum(list_transform(own, lambda x: strlen(x))), 0)::BIGINT AS chars, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth FROM l WHERE len(own) > 0),
v AS (SELECT *, (n >= 3 AND len(list_filter(own, lambda x: x IN ({bars}))) > {BAR_SHARE}::DOUBLE * n)
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) > {SYMBOL_SHARE}::DOUBLE * chars OR {phrases}
    OR (n >= {UNSTOPPED_WORDS} AND len(list_filter(own, lambda x: len(list_filter([{stops}], lambda s: suffix(x, s))) > 0)) = 0) AS fails FROM f),
a AS (SELECT rid, sum(chars) AS every, sum(CASE WHEN fails THEN 0 ELSE chars END) AS stay, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS again FROM v GROUP BY rid),
t AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(again, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(stay, 0) >= {1 - LOST_SHARE}::DOUBLE * coalesce(every, 0) AS enough FROM w LEFT JOIN r USING (rid) LEFT JOIN a USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND enough AS kept FROM t
"""


SQL = _sql()
