"""Removal of long word sequences that an earlier document holds, by recompression.

1. Every document is parsed by recompression (``recompress``); each window of 50 words is filed under a high-level
   symbol that its words determine. Symbols found in one document only cannot be part of a repeat.
2. In the documents with shared symbols, the windows under a shared symbol form segments. Every window is told by the
   symbols it consists of: those that its edges leave over by level, and its core. A segment whose symbols an earlier
   document holds is settled as a whole.
3. The windows of the other segments are verified one by one: equal windows meet under a 96-bit fingerprint of their
   symbols, aggregated to the smallest document; windows of later documents are repeats.

Rounds name runs and pairs by fingerprints of their content, so names are global without a table and no round needs a
shuffle. What rests on them is the names' width: words and symbols have 64 bits, two unequal windows meet if their
symbols' 96 bits agree. Counts are pre-aggregated before each shuffle, and what is joined back is joined by keys whose
hot values Spark may split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FACTOR, Fingerprints, stored
from .recompress import Parse

#: Words of one block of documents that are parsed together; a longer document is a block of its own.
BLOCK_WORDS = 1 << 16
LAST = (1 << 63) - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(rows: list[tuple], known: Fingerprints) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows (the text last) and their words' fingerprints, in blocks."""
    block, words, n = [], [], 0
    for row in rows:
        own = known.of(row[-1])
        block.append(row)
        words.append(own)
        n += len(own)
        if n >= BLOCK_WORDS:
            yield block, words
            block, words, n = [], [], 0
    if block:
        yield block, words


def _placed(words: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another; of each window its place there, its document and its place in it."""
    length = np.array([len(w) for w in words], np.int64)
    base = np.cumsum(length) - length
    count = np.maximum(length - size + 1, 0)
    doc = np.repeat(np.arange(len(words)), count)
    own = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), base[doc] + own, doc, own


def _anchor_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Fingerprints()
        for batch in batches:
            for block, words in _blocks(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), known):
                flat, at, doc, _ = _placed(words, size)
                if not len(at):
                    continue
                found = Parse(flat, at, size).anchors()
                fresh = np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])])
                found, doc = found[fresh], doc[fresh]
                ids, tids = (np.array([r[k] for r in block], np.int64)[doc] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([_signed(found), pa.array(ids), pa.array(tids)], names=["anchor", "doc", "tid"])

    return run


def _segment_rows(size: int):
    """Per segment: its fingerprint, document, first window and number of windows, and the windows' fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Fingerprints()
        for batch in batches:
            for block, words in _blocks(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), known):
                flat, at, doc, own = _placed(words, size)
                if not len(at):
                    continue
                parse = Parse(flat, at, size)
                found = parse.anchors()
                shared = np.zeros(len(found), bool)
                edge = np.searchsorted(doc, np.arange(len(block) + 1))
                for k, row in enumerate(block):
                    here = slice(edge[k], edge[k + 1])
                    shared[here] = np.isin(found[here], np.array(row[2], np.int64).view(np.uint64))
                cut = np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])])
                first = np.flatnonzero(cut)
                first, stop = first[shared[first]], np.append(first[1:], len(found))[shared[first]]
                chosen = np.flatnonzero(shared)
                one, two = parse.signatures(chosen, FACTOR), parse.signatures(chosen, 0xD1342543DE82EF95).astype(np.uint32)
                place = np.cumsum(shared) - shared
                rows = [(one[a : a + n].tobytes(), two[a : a + n].tobytes()) for a, n in zip(place[first], stop - first, strict=True)]
                if not rows:
                    continue
                prints = [hashlib.blake2b(a + b, digest_size=16).digest() for a, b in rows]
                ids = [block[d] for d in doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array([r[0] for r in ids], pa.int64()), pa.array([r[1] for r in ids], pa.int64()), pa.array(own[first]), pa.array(stop - first), pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], names=["segment", "doc", "tid", "at", "n", "one", "two"])

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 4000):
            part = batch.slice(low, 4000)
            doc, tid, at, n, one, two = (part.column(k) for k in range(6))
            n = n.to_numpy()
            total = np.cumsum(n) - n
            place = np.repeat(at.to_numpy(), n) + np.arange(int(n.sum())) - np.repeat(total, n)
            left = np.frombuffer(b"".join(one.to_pylist()), np.int64)
            right = np.frombuffer(b"".join(two.to_pylist()), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(np.repeat(doc.to_numpy(), n)), pa.array(np.repeat(tid.to_numpy(), n)), pa.array(place.astype(np.int32))], names=["one", "two", "doc", "tid", "at"])


def removals(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with possible repeats (``doc``, ``tid``, ``text``) and their repeated windows (``doc``, ``tid``, ``spans``)."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).cast("string").alias("text"))
    filed = stored(base.mapInArrow(_anchor_rows(size), "anchor long, doc long, tid long"), "substrings-anchors")
    shared = filed.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    shared = stored(shared, "substrings-shared")
    # by id and text: rows that share an id, null ids among them, are never gathered, and of repeated rows one goes on
    hits = filed.join(shared, "anchor").groupBy("doc", "tid").agg(F.collect_set("anchor").alias("anchors"))
    held = base.join(hits, ["doc", "tid"]).dropDuplicates(["doc", "tid"])
    held = stored(held.select("doc", "tid", "anchors", "text"), "substrings-documents", (filed, shared))
    segments = stored(held.mapInArrow(_segment_rows(size), "segment binary, doc long, tid long, at long, n long, one binary, two binary"), "substrings-segments")
    earliest = stored(segments.groupBy("segment").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high"), "substrings-equal")
    told = segments.join(earliest, "segment", "left")
    told = told.select("doc", "tid", "at", "n", "one", "two", F.coalesce(F.col("low") < F.col("doc"), F.lit(False)).alias("settled"))
    told = stored(told, "substrings-told", (segments, earliest))
    single = told.filter("not settled").select("doc", "tid", "at", "n", "one", "two").mapInArrow(_window_rows, "one long, two int, doc long, tid long, at int")
    first = single.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("one", "two", "low")
    first = stored(first, "substrings-windows")
    repeated = single.join(first, ["one", "two"]).filter("doc > low").select("doc", "tid", F.col("at").cast("long").alias("at"), F.lit(1).cast("long").alias("n"))
    every = repeated.unionByName(told.filter("settled").select("doc", "tid", "at", "n"))
    spans = every.groupBy("doc", "tid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return held.select("doc", "tid", "text"), stored(spans, "substrings-spans", (told, first))


def _kept(text: str, spans: list[dict], size: int) -> tuple[list[bytes], int]:
    words = text.encode("utf-8", "surrogatepass").split()
    step = np.zeros(len(words) + 1, np.int64)
    at, n = np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans])
    np.add.at(step, at, 1)
    np.add.at(step, at + n + size - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g], int(gone.sum())


def deduplicated(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of its words without the repeats.

    A word goes if a window of ``size`` words around it also starts in a document with a smaller id; what goes is
    judged on the input. Null ids count as the largest. Rows that share an id are no repeats of each other. A null
    or empty text, and one of fewer words than a window, loses nothing. An empty table gives an empty result. Only
    id and text are read, so other columns cannot clash.
    """
    held, spans = removals(docs, size, id_col, text_col)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t, s, size) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g for _, g in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in rows], pa.string())], names=["doc", "tid", "gone", "sha"])

    cut = held.join(spans, ["doc", "tid"]).mapInArrow(changed, "doc long, tid long, gone long, sha string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())], names=["doc_id", "tid", "n_words", "all_sha"])

    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).cast("string").alias("text")).mapInArrow(whole, "doc_id long, tid long, n_words long, all_sha string")
    joined = every.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).join(cut, ["doc", "tid"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "all_sha").alias("kept_sha256"))
