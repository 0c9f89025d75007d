"""Files that hold one JSON array of objects, of any size, read in parallel.

The file is read as text cut at every closing brace, which Spark's reader does from any byte range on. Whether a range
begins inside a string, how deep, and in which object, follows from the ranges before it. So a first pass tells for
every range what it does to either state (a table with a row a range), a scan over that table gives each range the state
it begins in, and a second pass takes out the objects. An object that lies across ranges is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING, _REST = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL), re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_GAP, _BLANK = re.compile(r"[ \t\r\n]*,?[ \t\r\n]*"), re.compile(r"[ \t\r\n]*")


def _effect(piece: str, inside: bool, closed: bool) -> tuple[bool, int]:
    """Whether a string is open after a piece (and the brace that cuts it off, if ``closed``), and by how much deeper the nesting is."""
    if inside:
        end = _REST.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end() :]
    bare = _STRING.sub("", piece)
    quote = bare.find('"')
    if quote >= 0:
        bare = bare[:quote]
    depth = bare.count("{") + bare.count("[") - bare.count("]") - bare.count("}")
    return quote >= 0, depth - (closed and quote < 0)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``at``: first byte of the range, ``value``), in the order of the file within a range."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple[str, bool]]]]:
    """The ranges of a task one after another, each with its pieces and whether another piece of it follows."""
    held: list = []

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

    stream = rows()
    held.extend(x for x in [next(stream, None)] if x)

    def of(key: tuple[str, int]):
        while held and (held[0][0], held[0][1]) == key:
            value = held.pop()[2]
            held.extend(x for x in [next(stream, None)] if x)
            yield value, bool(held) and (held[0][0], held[0][1]) == key

    while held:
        key = (held[0][0], held[0][1])
        yield key, of(key)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every range, for both states it may begin in: the state after it, the change of depth, and the least depth after a piece.

    The brace that ends the last piece is left out: whether there is one depends on whether the file goes on.
    """
    for (file, at), pieces in _ranges(batches):
        state, depth, low = [False, True], [0, 0], [0, 0]
        for piece, closed in pieces:
            for k in (0, 1):
                state[k], more = _effect(piece, state[k], closed)
                depth[k] += more
                low[k] = min(low[k], depth[k])
        yield pa.RecordBatch.from_pydict({"file": [file], "at": [at], "states": [state], "depths": [depth], "lows": [low]}, pa.schema([("file", pa.string()), ("at", pa.int64()), ("states", pa.list_(pa.bool_())), ("depths", pa.list_(pa.int32())), ("lows", pa.list_(pa.int32()))]))


def _entries(own):
    """The state in which each range of a file begins, and the range in which the object that is open then began."""
    own = own.sort_values("at")
    out, inside, depth, opened = [], False, 0, -1
    end = own["at"].iloc[-1]
    for at, states, depths, lows in zip(own["at"], own["states"], own["depths"], own["lows"], strict=True):
        out.append((inside, depth, opened, at == end))
        k = int(inside)
        change = int(depths[k]) - (at != end and not states[k])
        low = min(int(lows[k]), change)
        if opened < 0 or depth + low <= 1:
            opened = at if depth + change > 1 else -1
        inside, depth = bool(states[k]), depth + change
    if inside or depth:
        raise ValueError(f"{own['file'].iloc[0]}: the array does not end")
    found = own[["file", "at"]].copy()
    found["inside"], found["depth"], found["opened"], found["final"] = zip(*out, strict=True)
    return found


class _Reader:
    """Takes the objects of one range out of its pieces; what lies across the borders of the range comes as parts."""

    def __init__(self, file: str, at: int, inside: bool, depth: int, opened: int):
        self.file, self.at, self.inside, self.depth, self.opened = file, at, inside, depth, opened
        self.parts: list[str] = []
        self.ended = False

    def between(self, text: str) -> str:
        """What follows the gap between two objects, from the brace that opens one on; empty where none begins."""
        if self.depth == 0:
            text = text[_BLANK.match(text).end() :]
            if text and (self.ended or text[0] != "["):
                raise ValueError(f"{self.file}: not an array of objects: {text[:40]!r}")
            if not text:
                return ""
            self.depth, text = 1, text[1:]
        text = text[_GAP.match(text).end() :]
        if text.startswith("]"):
            self.depth, self.ended = 0, True
            if text[_BLANK.match(text[1:]).end() + 1 :]:
                raise ValueError(f"{self.file}: text after the array: {text[:40]!r}")
            return ""
        if text and text[0] != "{":
            raise ValueError(f"{self.file}: an element is not an object: {text[:40]!r}")
        return text

    def put(self, piece: str, closed: bool) -> str | None:
        """The object that ends with this piece, if one that began in the range does."""
        if self.depth <= 1:
            piece = self.between(piece)
            if not piece:
                if closed:
                    raise ValueError(f"{self.file}: a brace closes nothing")
                return None
            self.opened = self.at
        self.inside, more = _effect(piece, self.inside, closed)
        self.depth += more
        self.parts.append(piece + "}" * closed)
        return self.taken() if self.depth == 1 else None

    def taken(self) -> str:
        text = "".join(self.parts)
        self.parts.clear()
        return text


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects (``opened`` null) and parts of objects, with the range in which they began, and their places in the range."""
    names = ["file", "opened", "at", "k", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    entry: dict[tuple[str, int], tuple] = {}

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                if row[2] is None:
                    raise ValueError(f"{row[0]}: the ranges of this file have changed while it was read")
                entry.setdefault(row[:2], row[2:])
            yield batch

    for (file, at), pieces in _ranges(noted()):
        *state, final = entry.pop((file, at))
        reader = _Reader(file, at, *state)
        rows, size, k = [], 0, 0
        for piece, more in pieces:
            found = reader.put(piece, more or not final)
            if found is not None:
                rows.append((file, None if reader.opened == at else reader.opened, at, k, found))
                size, k, reader.opened = size + len(found), k + 1, at
            if size > 1 << 22:
                yield out(rows)
                rows, size = [], 0
        if reader.parts:
            rows.append((file, reader.opened, at, k, reader.taken()))
        if rows:
            yield out(rows)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the files at ``path``, each one JSON array, as rows of ``schema``, with no order of their own.

    A file is read by byte ranges of ``spark.sql.files.maxPartitionBytes``, twice. One that is no array, an element that
    is no object, and malformed JSON raise when the rows are read; an empty array gives no rows. Nesting, strings with
    brackets and escapes, and objects longer than a range are allowed.
    """
    pieces = _pieces(spark, path)
    told = pieces.mapInArrow(_summaries, "file string, at long, states array<boolean>, depths array<int>, lows array<int>")
    entries = told.groupBy("file").applyInPandas(_entries, "file string, at long, inside boolean, depth int, opened long, final boolean")
    # a row a range, so a few bytes for every ``maxPartitionBytes``; a broadcast keeps the pieces in their order
    placed = pieces.join(F.broadcast(entries), ["file", "at"], "left").select("file", "at", "value", "inside", "depth", "opened", "final")
    found = placed.mapInArrow(_objects, "file string, opened long, at long, k long, text string")
    whole = found.filter("opened IS NULL").select("text")
    across = found.filter("opened IS NOT NULL").groupBy("file", "opened").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    joined = across.select(F.array_join(F.transform("x", lambda p: p["text"]), "").alias("text"))
    row = F.from_json("text", schema, {"mode": "FAILFAST"})
    return whole.unionByName(joined).select(row.alias("r")).select("r.*")
