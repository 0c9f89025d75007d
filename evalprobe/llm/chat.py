"""Chat formatting over a prefix tree: turns that conversations share at their beginning are tokenised and emitted once.

A node of the tree is a turn under all turns before it, named by a chained fingerprint, so equal beginnings meet under
equal names. Every node belongs to the first of the conversations that pass through it; what a conversation owns is the
end of it, a branch, hung below a node of another branch. A tree is emitted depth first: a branch from top to end, then
the branches below it, the deepest first, each with all that hangs below. So a branch is one run of tokens, and what
its tokens may attend to is the branch itself, up to them, and of each branch above it one interval, from its beginning
to the node where the path leaves it. Position ids count along the path, not along the emitted sequence.

The template is ``<turn>role``, line feed, text, ``</turn>``, line feed. Inside roles and texts a backslash becomes two
and the first character of a template mark becomes ``\\l``; in roles a line feed becomes ``\\n``. So marks stand only
where the template puts them, and all is read back unchanged. Strings of special tokens are ordinary text. The loss mask
covers the tokens of assistants' texts, which are encoded apart from the marks around them.

Conversations of any length are handled in blocks of at most ``BLOCK`` turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running
from .common import stored

BLOCK = 1024
OPEN, CLOSE = "<turn>", "</turn>\n"
_MARKS, _ESCAPED = re.compile(r"\\|<(?=/?turn>)"), re.compile(r"\\(.)", re.DOTALL)
_OUT, _IN = {"\\": "\\\\", "<": "\\l"}, {"\\": "\\", "l": "<", "n": "\n"}


def escaped(text: str) -> str:
    """``text`` without anything that reads as a mark of the template."""
    return _MARKS.sub(lambda m: _OUT[m[0]], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _IN[m[1]], text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """A turn in the template: what stands before the text, the text, what stands after it."""
    return OPEN + escaped(role).replace("\n", "\\n") + "\n", escaped(text), CLOSE


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for turn in text.split(CLOSE)[:-1]:
        role, _, own = turn.removeprefix(OPEN).partition("\n")
        out.append((unescaped(role), unescaped(own)))
    return out


def default_tokenizer() -> dict[str, str]:
    """The public byte-level BPE vocabulary as a rank file, with its pattern."""
    import public_tokenizers as public

    return {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


class Tokens:
    """Ids of texts under a rank file, without special tokens, and back."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, list[int]] = {}

    def of(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text) if text else []

    def mark(self, text: str) -> list[int]:
        """Ids of a template mark; roles are few, so they are remembered."""
        if text not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[text] = self.of(text)
        return self.known[text]

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")


def _name(before: bytes, role: str, text: str) -> bytes:
    own = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(before + len(own).to_bytes(8, "little") + own + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprint of each block on its own."""
    for batch in batches:
        for k in range(batch.num_rows):
            name = b""
            for x in batch.column(2)[k].as_py():
                name = _name(name, x["role"], x["text"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([name], pa.binary())], names=["key", "block", "end"])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a turn with the name of its node: the chain of fingerprints from the beginning of the conversation."""
    for batch in batches:
        for low in range(0, batch.num_rows, 128):
            part, rows = batch.slice(low, 128), []
            for key, block, before, own in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                name = before
                for k, x in enumerate(own):
                    name = _name(name, x["role"], x["text"])
                    rows.append((key, block * BLOCK + k, name, x["role"], x["text"]))
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "at", "node", "role", "text"])


def _keyed(rows: DataFrame) -> DataFrame:
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text")).withColumn("m", F.md5(F.col("text").cast("binary")))


def _nodes(rows: DataFrame) -> DataFrame:
    """(``key``, ``at``, ``node``, ``role``, ``text``) for every turn, stored."""
    own = _keyed(rows)
    long = stored(own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key"), "chat-long")
    fold = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "m", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("own")
    blocks = own.join(long, "key", "left_anti").groupBy("key").agg(fold).select("key", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("before"), "own")
    if not long.isEmpty():
        placed = running(own.join(long, "key", "left_semi"), ["key"], ["turn", "role", "m"], "at")
        parts = stored(placed.withColumn("block", F.floor((F.col("at") - 1) / BLOCK)).groupBy("key", "block").agg(fold), "chat-blocks")
        ends = parts.mapInArrow(_ends, "key string, block long, end binary")

        def chained(own):
            """A block's beginning is named after all blocks before it; 16 bytes for every ``BLOCK`` turns meet here."""
            own, name, out = own.sort_values("block"), b"", []
            for end in own["end"]:
                out.append(name)
                name = hashlib.blake2b(name + end, digest_size=16).digest()
            return own.assign(before=out)[["key", "block", "before"]]

        before = ends.groupBy("key").applyInPandas(chained, "key string, block long, before binary")
        blocks = blocks.unionByName(parts.join(before, ["key", "block"]).select("key", "block", "before", "own"))
    return stored(blocks.mapInArrow(_turns, "key string, at long, node binary, role string, text string"), "chat-turns")


def _encoded(tokenizer: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(**tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(low, 1000), []
                for key, at, role, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    head, own, tail = formatted(role, text)
                    a, b, c = tokens.mark(head), tokens.of(own), tokens.mark(tail)
                    rows.append((key, at, np.array(a + b + c, "<u4").tobytes(), len(a) + len(b) + len(c), len(a) if role == "assistant" else 0, len(a) + len(b) if role == "assistant" else 0))
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["branch", "at", "ids", "n", "low", "high"])

    return run


def _prefix(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` of branches with ``name``: what ``value`` sums up to before the row; summed block by block."""
    rows = rows.withColumn("_b", F.floor(F.col("at") / BLOCK))
    sums = rows.groupBy("branch", "_b").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("branch").orderBy("_b")) - F.col("_s")).drop("_s")
    inside = F.sum(value).over(Window.partitionBy("branch", "_b").orderBy("at")) - F.col(value)
    return rows.withColumn("_in", inside).join(sums, ["branch", "_b"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_b")


def packed(rows: DataFrame, tokenizer: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The prefix trees of all conversations (conv_id, turn, role, text) as token sequences: ``pieces`` and ``paths``.

    ``pieces``: a row for at most ``BLOCK`` turns of a branch. ``tree`` and ``branch`` are names, ``offset`` is the place
    of the first id in the tree's sequence, ``position`` its position id (those of the others follow), ``ids`` the
    little-endian unsigned 32-bit ids, ``loss`` the intervals of ids that count for the loss, ``attends`` the intervals
    of the sequence above the branch, beside the branch itself from ``start`` on; intervals are (``low``, ``high``), the
    end exclusive.
    ``paths``: ``conv_id``, ``tree`` and ``runs`` (branch, low, high): the intervals that make up the conversation.

    Turns come by number, nulls first, ties by role and the text's MD5. A null text or role is empty, null ids are one
    conversation, repeated rows are turns of their own. Other columns are ignored; an empty table gives empty results.
    """
    turns = _nodes(rows)
    owners = turns.groupBy("node").agg(F.min("key").alias("owner"))
    owned = turns.select("key", "at", "node").join(owners, "node")
    runs = stored(owned.groupBy("key", "owner").agg(F.min("at").alias("first"), F.max("at").alias("last")), "chat-runs")
    begins = runs.filter("key = owner").select("key", "first")
    new = turns.join(begins, "key").filter("at >= first").select("key", "at", "role", "text")
    tokens = stored(new.mapInArrow(_encoded(tokenizer or default_tokenizer()), "branch string, at long, ids binary, n long, low long, high long"), "chat-tokens")
    places = stored(_prefix(tokens.select("branch", "at", "n"), "n", "inside").withColumn("upto", F.col("inside") + F.col("n")), "chat-places")
    upto = places.select(F.col("branch").alias("owner"), F.col("at").alias("last"), "upto")
    sized = runs.join(upto, ["owner", "last"]).select("key", F.struct("first", "owner", "last", "upto").alias("run"))
    paths = stored(sized.groupBy("key").agg(F.sort_array(F.collect_list("run")).alias("runs")), "chat-paths")
    # the path of a branch: where it leaves the branch above, deepest first, and which branch follows
    own = paths.filter(F.element_at("runs", -1)["owner"] == F.col("key"))
    way = F.transform(F.sequence(F.lit(0), F.size("runs") - 2), lambda i: F.struct((-F.get("runs", i)["last"]).alias("deep"), F.get("runs", i + 1)["owner"].alias("next")))
    above = F.slice("runs", 1, F.size("runs") - 1)
    branches = own.select(F.col("key").alias("branch"), F.get("runs", F.lit(0))["owner"].alias("tree"), F.when(F.size("runs") > 1, way).otherwise(F.array().cast("array<struct<deep: bigint, next: string>>")).alias("way"), F.element_at("runs", -1)["upto"].alias("length"), F.aggregate(above, F.lit(0).cast("long"), lambda s, x: s + x["upto"]).alias("position"), above.alias("above"))
    branches = stored(running(branches, ["tree"], ["way"], "end", F.col("length")).withColumn("start", F.col("end") - F.col("length")).drop("end", "way"), "chat-branches")
    starts = branches.select(F.col("branch").alias("owner"), F.col("start").alias("low"))
    each = branches.select("branch", F.explode("above").alias("x")).select("branch", "x.owner", "x.first", "x.upto").join(starts, "owner")
    attends = each.groupBy("branch").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "low", (F.col("low") + F.col("upto")).alias("high")))), lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("attends"))
    none = F.array().cast("array<struct<low: bigint, high: bigint>>")
    told = branches.join(attends, "branch", "left").select("branch", "tree", "start", "position", F.coalesce("attends", none).alias("attends"))
    placed = tokens.join(places.select("branch", "at", "inside"), ["branch", "at"]).withColumn("block", F.floor(F.col("at") / BLOCK))
    folded = placed.groupBy("branch", "block").agg(F.sort_array(F.collect_list(F.struct("at", "inside", "ids", "low", "high"))).alias("x"))
    inside = F.get("x", F.lit(0))["inside"]
    loss = F.filter(F.transform("x", lambda t: F.struct((t["inside"] + t["low"]).alias("low"), (t["inside"] + t["high"]).alias("high"))), lambda t: t["low"] < t["high"])
    ids = F.array_join(F.transform("x", lambda t: F.hex(t["ids"])), "")
    pieces = folded.join(told, "branch").select("tree", "branch", "block", "start", (F.col("start") + inside).alias("offset"), (F.col("position") + inside).alias("position"), F.unhex(ids).alias("ids"), F.transform(loss, lambda t: F.struct((F.col("start") + t["low"]).alias("low"), (F.col("start") + t["high"]).alias("high"))).alias("loss"), "attends")
    spans = paths.select("key", F.posexplode("runs").alias("k", "x")).select("key", "k", "x.owner", "x.upto").join(branches.select(F.col("branch").alias("owner"), "tree", "start"), "owner")
    whole = spans.groupBy("key", "tree").agg(F.sort_array(F.collect_list(F.struct("k", F.col("owner").alias("branch"), F.col("start").alias("low"), (F.col("start") + F.col("upto")).alias("high")))).alias("runs"))
    kind = dict(rows.dtypes)["conv_id"]
    conv = F.when(F.col("key") != "", F.substring("key", F.lit(2), F.char_length("key"))).cast(kind)
    return pieces, whole.select(conv.alias("conv_id"), "tree", F.transform("runs", lambda x: F.struct(x["branch"].alias("branch"), x["low"].alias("low"), x["high"].alias("high"))).alias("runs"))


def read_back(pieces: DataFrame, paths: DataFrame, tokenizer: dict[str, str] | None = None) -> DataFrame:
    """Every conversation, from its runs of the sequences: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Turns are hashed as role, line feed, text, line feed; under the loss mask stand the texts of assistants.
    """
    kind = dict(paths.dtypes)["conv_id"]
    runs = paths.select("conv_id", F.posexplode("runs").alias("k", "x")).select("conv_id", "k", "x.*")
    met = runs.join(pieces.select("branch", "offset", "ids", "loss"), "branch").filter("offset < high")
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = Tokens(**tokenizer), None

        def done():
            conv, n, turns, chars, loss, all_chars = held
            columns = [conv, *(pa.array([x]) for x in (n, turns.hexdigest(), chars, loss.hexdigest(), all_chars))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for i, (conv, high, offset, ids, loss) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "high", "offset", "ids", "loss")), strict=True)):
                if held is None or held[0][0].as_py() != conv:
                    if held is not None:
                        yield done()
                    held = [batch.column("conv_id").slice(i, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own = np.frombuffer(ids, "<u4")[: high - offset]
                text = tokens.text(own)
                held[5] += len(text)
                for role, said in parsed(text):
                    held[1] += 1
                    held[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for x in loss:
                    if x["high"] <= high:
                        said = unescaped(tokens.text(own[x["low"] - offset : x["high"] - offset]))
                        held[3] += len(said)
                        held[4].update(said.encode("utf-8", "surrogatepass"))
        if held is not None:
            yield done()

    # runs of a conversation come one after another; what is held is the state of the hashes
    ordered = met.repartition("conv_id").sortWithinPartitions("conv_id", "k", "offset").select("conv_id", "high", "offset", "ids", "loss")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
