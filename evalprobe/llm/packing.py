"""Packing by concatenating and cutting: token ids of all documents in one row, cut at fixed windows.

Pass one tokenises every text once and stores its ids with the offset inside its partition. The partition totals
(one row a task) give each partition its global offset. Pass two cuts every document at the multiples of the
sequence length, so a document that crosses a window becomes several pieces. Nothing is sorted or shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Chunks whose ids a worker remembers before it starts anew; bounds memory, never results.
REMEMBERED = 300_000
#: Ids in one Arrow batch of pieces, about.
BATCH_IDS = 1 << 20


class _Ids(dict):
    """Chunk to its ids as little-endian bytes."""

    def __init__(self, encode, kind: str):
        super().__init__()
        self.encode, self.kind = encode, kind

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[chunk] = np.array(self.encode(chunk), self.kind).tobytes()
        return found


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, found chunk by chunk.

    A byte-level BPE never merges across the blank before a word, so a text cut before its blanks has the ids of
    its chunks, one after another, as long as no blank is followed by white space. Other texts, and texts that
    spell a special token, go to the library whole. ``ranks`` names the same vocabulary as a rank file, whose
    encoder is several times faster on the chunks; without it the library encodes them too.
    """

    odd = re.compile(r" (?:\s|\Z)")

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer)
        self.kind = "<u2" if whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.whole = lambda text: whole.encode(text, add_special_tokens=False).ids
        encode = self.whole
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.chunks = _Ids(encode, self.kind)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self.odd.search(text):
            return np.array(self.whole(text), self.kind).tobytes()
        first, *rest = text.split(" ")
        known = self.chunks
        return known[first] + b"".join([known[" " + x] for x in rest]) if rest else known[first]


def default_tokenizer() -> dict[str, str]:
    """The public byte-level BPE vocabulary, as a file of either library."""
    import public_tokenizers as public

    return {"tokenizer": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def tokenised(docs: DataFrame, tokenizer: dict[str, str], end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, ``part`` (its task), ``at`` (ids before it in its task), ``n``, ``width``, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part = Encoder(**tokenizer), 0, TaskContext.get().partitionId()
        tail, width = np.array([end_id], encode.kind).tobytes(), int(encode.kind[-1])
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                piece = batch.slice(low, 500)
                ids = [(encode(t) if t else b"") + tail for t in piece.column(1).to_pylist()]
                n = np.array([len(x) // width for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([part] * len(n), pa.int32()), pa.array(start), pa.array(n), pa.array([width] * len(n), pa.int32()), pa.array(ids, pa.binary())], names=["id", "part", "at", "n", "width", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, part int, at long, n long, width int, ids binary")


def pack(docs: DataFrame, seq_len: int = 2048, end_id: int = 1, tokenizer: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``seq_len`` ids; only the last sequence of all is short.

    Returns a row per piece: ``doc_id`` (of the document, null stays null), ``start`` (ids of its document before
    it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.
    A null or empty text is the end id alone. Repeated rows and ties are packed as separate documents. An empty
    table gives no pieces. Columns besides the two named are ignored.
    """
    table = stored(tokenised(docs, tokenizer or default_tokenizer(), end_id, id_col, text_col), "packing-ids")
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each task of pass one, so the window and the broadcast hold as many rows as there were tasks
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = table.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("at")).alias("first"), "n", "width", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, first, n, width, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                edges = [0, *range(seq_len - first % seq_len, n, seq_len), n]
                for a, b in zip(edges, edges[1:], strict=False):
                    rows.append((doc, a, b - a, wide[a:b].tobytes(), n, (first + a) // seq_len, (first + a) % seq_len))
                held += n
                if held >= BATCH_IDS:
                    yield to_batch(rows)
                    rows, held = [], 0
        if rows:
            yield to_batch(rows)

    id_type = dict(docs.dtypes)[id_col]
    arrow_id = pa.int64() if id_type == "bigint" else None
    kinds = [arrow_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return placed.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
