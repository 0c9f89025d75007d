"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the bag of its five-word shingles, weighted by count times inverse document frequency. The frequency
weight goes by octaves of the shingle's true document frequency df among N documents:
1 + min(10, floor(log2(N / df))) / 10. So a shingle that every document holds weighs 1, one in half of them 1.1, and
one in fewer than N / 1024 documents 2. At most 1024 * (mean shingles of a document) shingles lie above that last
octave, at any N; they are found and counted exactly over all documents (``frequent_shingles``).

Each document draws 64 samples whose chance to agree between two documents is their weighted Jaccard similarity.
Sixteen bands of four samples file documents into buckets. A pair of similarity 0.8 shares no bucket with probability
(1 - 0.8**4)**16 = 0.0002. All buckets go the same way:

1. Equal texts are one node. Every bucket elects one member as leader, by a hash of bucket and member, and its members
   are paired with it: at most 16 pairs a document, whatever the size of a group. Each document's likeliest pair is
   verified first, then those pairs that still lie in two components.
2. Where a bucket still holds several components, its documents draw 64 new samples and file again; every new bucket
   elects a leader from two of its components, and the members of other components are paired with them.
3. What still lies in a first bucket beside other components is compared with all of that bucket that it is not yet
   connected to: as pairs in buckets of up to ``PAIRED`` members, in blocks in larger ones. Which of the two is a matter
   of cost; either compares everything, so the size of a bucket does not decide which links count.

Before a pair's texts are fetched, fewer than 32 agreeing samples of 64 rule it out; at similarity 0.8 that happens
with probability 3e-8. The others are verified by weighted Jaccard similarity on the whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Fingerprints, discard, free, mix, stored, windows
from .components import components

SHINGLE, BANDS, ROWS = 5, 16, 4
SAMPLES = BANDS * ROWS
#: Octaves of document frequency that weigh differently; shingles in fewer than N / 2**OCTAVES documents weigh alike.
OCTAVES = 10
#: Counters of the sketch that finds the frequent shingles, and counters of one of its rows.
COUNTERS, ROW_COUNTERS = 1 << 22, 1 << 16
#: Entries of one block of the sampling and of the counting; bound memory, never results.
BLOCK_ENTRIES, COUNT_ENTRIES = 1 << 15, 1 << 20
#: Names of documents up to which a filter of texts takes them along (8 MB); beyond, both sides are shuffled.
CARRIED_NODES = 1_000_000
#: Unresolved buckets up to this size compare their members as pairs, larger ones in blocks. Chooses the way, never results.
PAIRED = 16
#: Rows of a block in which members of several components are held against all members.
BLOCK_ROWS = 512
#: Samples that must agree before the texts of a pair are fetched; at similarity 0.8 a pair has fewer with probability 3e-8.
AGREEING = 32
#: Times that documents of unresolved buckets draw new samples.
REDRAWN = 2


def shingles(words: np.ndarray) -> np.ndarray:
    """Fingerprints of the shingles of a document; a document of fewer than five words is one shingle."""
    return windows(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, np.uint64)


class Weights:
    """Count times inverse document frequency, from the table of frequent shingles and their octaves."""

    def __init__(self, names: np.ndarray, octaves: np.ndarray):
        order = np.argsort(names)
        self.names, self.weights = names[order], (1 + octaves[order] / OCTAVES).astype(np.float32)

    def __call__(self, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = np.full(len(names), 2.0, np.float32)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hit = self.names[at] == names
            w[hit] = self.weights[at[hit]]
        return w * counts.astype(np.float32)


def weighed(text: str | None, known: Fingerprints, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, ascending, and their weights."""
    names, counts = np.unique(shingles(known.of(text)), return_counts=True)
    return names, weights(names, counts)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighed texts."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][at], b[1][bt]).astype(np.float64).sum())
    return low / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low) if low else 0.0


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 0.5) / n, by bisection of 1 - (1 + x) * exp(-x)."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return high


class Sampler:
    """Samples of weighed shingles; equal on every worker.

    Of the 64 random bits of a (shingle, sample) the upper 16 pick c, the next 12 and 6 pick r and beta, as quantiles.
    A draw is ranked by log c - r * (t - beta + 1), in whole units, with t = floor(log w / r + beta); for the weight
    that nearly all shingles have, both terms come from tables.
    """

    usual, unit = 2.0, float(1 << 24)

    def __init__(self, samples: int = SAMPLES, draw: int = 0):
        self.log_c = ((np.log(_gamma_quantiles(1 << 16)) + 96) * self.unit).astype(np.int64) << 32
        self.r, self.beta = np.repeat(_gamma_quantiles(1 << 12), 64), np.tile((np.arange(64) + 0.5) / 64, 1 << 12)
        self.table = self._term(np.full(1 << 18, self.usual), np.arange(1 << 18))
        self.factors = mix(np.arange(1, samples + 1, dtype=np.uint64) + np.uint64(draw << 32)) | np.uint64(1)

    def _term(self, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What is taken off log c, in the upper half, and t in the lowest byte."""
        t = np.floor(np.log(weights) / self.r[at] + self.beta[at])
        return ((self.r[at] * (t - self.beta[at] + 1) * self.unit).astype(np.int64) << 32) - (t.astype(np.int64) & 0xFF)

    def __call__(self, names: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For documents that begin at ``starts``, a row each of 32-bit samples (shingle and quantised weight)."""
        out = np.empty((len(starts), len(self.factors)), np.uint32)
        odd = np.flatnonzero(weights != self.usual)
        odd_weights = weights[odd].astype(np.float64)
        for k, factor in enumerate(self.factors):
            with np.errstate(over="ignore"):
                z = names * factor
            z ^= z >> np.uint64(32)
            at = ((z >> np.uint64(30)) & np.uint64(0x3FFFF)).view(np.int64)
            term = self.table[at]
            if len(odd):
                term[odd] = self._term(odd_weights, at[odd])
            key = self.log_c[(z >> np.uint64(48)).view(np.int64)]
            key -= term
            z &= np.uint64(0xFFFFFF)
            z <<= np.uint64(8)
            key += z.view(np.int64)
            out[:, k] = np.minimum.reduceat(key, starts) & 0xFFFFFFFF
        return out


def _node(id_col: str, text: Column) -> Column:
    """Name of a document: a fingerprint of its id and text, so that rows that share an id but not the text stay apart."""
    return F.xxhash64(F.col(id_col).cast("long"), text)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), _node(id_col, text).alias("node"), text.alias("text"))


def frequent_shingles(texts: DataFrame) -> Weights:
    """The octave of every shingle that N / 1024 documents or more hold, from exact counts over all N documents.

    First every shingle is counted in one of ``COUNTERS`` counters, which tasks fill by themselves and sum by rows; a
    counter is never below the document frequency of its shingles, so only shingles of counters that reach N / 1024
    need a count of their own. As N / 1024 grows with N, the share of such counters does not. Both the bitmap of the
    counters (512 KB) and the counted table (1024 times the mean number of shingles) are bounded at any N.
    """
    rows_of = COUNTERS // ROW_COUNTERS
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def packed(at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Filled counters as rows: places and counts, compressed."""
        edges = np.searchsorted(at, np.arange(rows_of + 1) * ROW_COUNTERS)
        own = [(k, b - a, zlib.compress((at[a:b] % ROW_COUNTERS).astype("<u2").tobytes() + counts[a:b].astype("<u8").tobytes(), 1)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        k, n, data = zip(*own, strict=True) if own else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["row", "n", "counts"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, held, docs, entries = Fingerprints(), np.zeros(0, np.int64), [], 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingles(known.of(text))
                docs += 1
                held.append(own)
                entries += len(own)
                if entries >= COUNT_ENTRIES:
                    filled = np.bincount((np.concatenate(held) >> shift).view(np.int64), minlength=COUNTERS)
                    table = table + filled if len(table) else filled
                    held, entries = [], 0
        left, counts = np.unique((np.concatenate(held) >> shift).view(np.int64), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        if len(table):
            table[left] += counts
            left = np.flatnonzero(table)
            counts = table[left]
        yield packed(left, counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([docs], pa.int32()), pa.array([b""], pa.binary())], names=["row", "n", "counts"])

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROW_COUNTERS if key[0].as_py() >= 0 else 1, np.int64)
        for batch in batches:
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if len(total) == 1:
                    total += n
                else:
                    raw = zlib.decompress(data)
                    total[np.frombuffer(raw[: 2 * n], "<u2")] += np.frombuffer(raw[2 * n :], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["row", "counts"])

    sketch = stored(texts.select("text").mapInArrow(sketched, "row int, n int, counts binary").groupBy("row").applyInArrow(summed, "row int, counts binary"), "minhash-sketch")
    found = {r["row"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in sketch.collect()}  # 64 rows, compressed
    discard(sketch)
    total = int(found.pop(-1, np.zeros(1))[0])
    least = max(2, total / 2**OCTAVES)
    full = np.zeros(COUNTERS, bool)
    for k, counts in found.items():
        full[k * ROW_COUNTERS : (k + 1) * ROW_COUNTERS] = counts >= least
    bits = np.packbits(full)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, held, entries = Fingerprints(), np.unpackbits(bits).astype(bool), [], 0

        def told() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["name", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingles(known.of(text))
                own = np.unique(own[wanted[(own >> shift).view(np.int64)]])
                if len(own):
                    held.append(own)
                    entries += len(own)
                    if entries >= COUNT_ENTRIES:
                        yield told()
                        held, entries = [], 0
        if held:
            yield told()

    counts = texts.select("text").mapInArrow(counted, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= least).collect()
    names = np.array([r["name"] for r in rows], np.int64).view(np.uint64)
    df = np.array([r["n"] for r in rows], np.float64)
    return Weights(names, np.clip(np.floor(np.log2(total / df)), 0, OCTAVES) if len(df) else np.zeros(0))


def signatures(texts: DataFrame, weights: Weights, draw_no: int = 0) -> DataFrame:
    """Per document with words: ``node``, ``print`` (of its text), ``samples`` (64 times 32 bits), ``bands`` (16 names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, draw = Fingerprints(), Sampler(draw=draw_no)
        for batch in batches:
            nodes, prints, texts_ = (c.to_pylist() for c in batch.columns)
            low = 0
            while low < len(nodes):
                names, found, keep, entries = [], [], [], 0
                while low < len(nodes) and entries < BLOCK_ENTRIES:
                    own = weighed(texts_[low], known, weights)
                    if len(own[0]):
                        names.append(own[0])
                        found.append(own[1])
                        keep.append(low)
                        entries += len(own[0])
                    low += 1
                if not keep:
                    continue
                sizes = np.array([len(x) for x in names])
                samples = draw(np.concatenate(names), np.concatenate(found), np.cumsum(sizes) - sizes)
                bands = _band_names(samples)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.int64()), pa.array([prints[i] for i in keep], pa.string()), pa.array([x.tobytes() for x in samples], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))], names=["node", "print", "samples", "bands"])

    return texts.select("node", F.md5("text").alias("print"), "text").mapInArrow(run, "node long, print string, samples binary, bands array<long>")


def _band_names(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        name = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), BANDS)).copy()
        for k in range(ROWS):
            name = mix(name * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::ROWS].astype(np.uint64))
    return np.ascontiguousarray(name)


def _leaders(rows: DataFrame) -> DataFrame:
    """``rows`` (name, node): the members of each bucket paired with its leader."""
    elected = rows.groupBy("name").agg(F.min(F.struct(F.xxhash64("name", "node"), "node")).alias("l"), F.count("*").alias("n"))
    elected = elected.filter("n > 1").select("name", F.col("l.node").alias("leader"))
    return _ordered(rows.join(elected, "name").select(F.col("node").alias("a"), F.col("leader").alias("b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _leaders_of_two(rows: DataFrame) -> DataFrame:
    """``rows`` (name, node, root): the members of each bucket of several roots paired with leaders of other roots than theirs."""
    own = rows.groupBy("name", "root").agg(F.min(F.struct(F.xxhash64("name", "node"), "node")).alias("l"))
    two = own.select("name", F.struct("root", F.col("l.node").alias("node")).alias("l")).groupBy("name").agg(F.min("l").alias("low"), F.max("l").alias("high")).filter("low.root < high.root")
    met = rows.join(two, "name").select("node", "root", F.explode(F.array("low", "high")).alias("l")).filter("root <> l.root")
    return _ordered(met.select(F.col("node").alias("a"), F.col("l.node").alias("b")))


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) of which enough samples agree, with their number as ``agree``."""
    own = signed.select("node", "samples")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("samples").alias("one")), "a").join(own.select(F.col("node").alias("b"), F.col("samples").alias("two")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, SAMPLES) for k in (2, 3))
            agree = (one == two).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"]).filter(pa.array(agree >= AGREEING))

    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long, agree int")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of some documents. Up to a million names are taken to the texts, so that the others are never shuffled."""
    nodes = stored(nodes, "minhash-nodes")
    held = texts.join(F.broadcast(nodes) if nodes.count() <= CARRIED_NODES else nodes, "node")
    return stored(held.select("node", "text").dropDuplicates(["node"]), "minhash-texts")


def _blockwise(some: DataFrame, every: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Of ``some`` against ``every`` member with the same ``main``: links to other roots that reach the similarity.

    Both sides are cut to blocks of bounded size, each by its own number, so that the large side is copied once for
    every 512 rows of the small one. In a block, every document of one side is laid out over the shingles of
    the other side once, and its overlap with all of these is one pass; so no pair becomes a row unless it is a link,
    and of a document's links to one root, whose nodes are connected already, a block reports one.
    """
    nodes = every.select("node").distinct()
    held = _texts_of(texts, nodes)
    count = lambda df, name: df.groupBy("main").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    sizes = stored(count(some, "ps").join(count(every, "qs"), "main"), "minhash-blocks")

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(sizes, "main").join(held, "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(own)), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left = cut(some, "ps", "qs").select("main", F.col("own").alias("p"), F.col("other").alias("q"), "node", "root", "text")
    right = cut(every, "qs", "ps").select("main", F.col("other").alias("p"), F.col("own").alias("q"), "node", "root", "text").toDF("main_", "p_", "q_", "node_", "root_", "text_")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if a.num_rows and b.num_rows:
            known = Fingerprints()
            own = [weighed(t, known, weights) for t in b.column(5).to_pylist()]
            flat, weight = np.concatenate([n for n, _ in own]), np.concatenate([w for _, w in own]).astype(np.float64)
            length = np.array([len(n) for n, _ in own])
            starts = np.cumsum(length) - length
            total = np.add.reduceat(weight, starts)
            names, at = np.unique(flat, return_inverse=True)
            nb, rb = b.column(3).to_numpy(), b.column(4).to_numpy()
            dense = np.zeros(len(names))
            for node, root, text in zip(*(a.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                mine, w = weighed(text, known, weights)
                place = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                hit = names[place] == mine
                dense[place[hit]] = w[hit]
                low = np.add.reduceat(np.minimum(dense[at], weight), starts)
                dense[place[hit]] = 0
                good = np.flatnonzero((low >= threshold * (float(w.sum(dtype=np.float64)) + total - low)) & (rb != root))
                found += [(node, int(x)) for x in nb[good[np.unique(rb[good], return_index=True)[1]]]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return left.groupBy("main", "p", "q").cogroup(right.groupBy("main_", "p_", "q_")).applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs whose whole texts reach the similarity, with it as ``score``."""
    pairs = stored(pairs, "minhash-pairs")
    if not pairs.limit(1).count():
        return pairs.select("a", "b", F.lit(1.0).alias("score"))
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = _texts_of(texts, ids)
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Fingerprints = Fingerprints()
        last: tuple = (None, None)
        for batch in batches:
            scores = []
            for a, one, two in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if last[0] != a:
                    last = (a, weighed(one, known, weights))
                scores.append(similarity(last[1], weighed(two, known, weights)))
            scores = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["a", "b", "score"]).filter(pa.array(scores >= threshold))

    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long, score double")


def classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``class_id``, the least id of its class of near-duplicates.

    Two documents are linked if their weighted Jaccard similarity is ``threshold`` or more; classes are what links
    connect, and equal texts share a class. A null text counts as empty; texts without words are equal only to equal
    texts. Texts of one to four words are a single shingle. Rows that agree in id and text count as one document, rows
    that share an id alone do not; a null id stays null (``class_id`` is null if every id of the class is). An empty table
    gives an empty result. Other columns are not read.
    """
    named = _named(_texts(docs, id_col, text_col), threshold)
    ids = stored(named.groupBy("root").agg(F.min("doc").alias("class_id")), "minhash-ids")
    return named.join(ids, "root").select(F.col("doc").alias("doc_id"), "class_id")


def _crossing(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in two components, with these as ``a_root`` and ``b_root``."""
    one, two = (root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").filter("a_root <> b_root").select("a", "b", "a_root", "b_root")


def _merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` (node, root) after further links: only the components that they touch are looked at."""
    between = stored(_crossing(links, root).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "minhash-links")
    if not between.limit(1).count():
        return root
    new = components(between).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return stored(root.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "minhash-roots", (root, between))


def _unresolved(rows: DataFrame, root: DataFrame) -> DataFrame:
    """Of ``rows`` (name, node) the buckets with several components, with ``root`` and the bucket's size ``n``."""
    placed = rows.join(root, "node")
    open_ = placed.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("name", "n")
    return placed.join(open_, "name").select("name", "node", "root", "n")


def _named(texts: DataFrame, threshold: float) -> DataFrame:
    """Per row of ``texts``: ``doc``, ``node`` and the ``root`` of its class."""
    weights = frequent_shingles(texts)
    signed = stored(signatures(texts, weights), "minhash-signatures")
    least = signed.groupBy("print").agg(F.min("node").alias("node"))
    reps = stored(signed.select("print", "node", "samples", "bands").join(least, ["print", "node"]).dropDuplicates(["node"]), "minhash-representatives", (signed,))
    filed = reps.select(F.explode("bands").alias("name"), "node")
    # buckets with one member are done
    shared = stored(filed.join(filed.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "name"), "minhash-filed")
    root = stored(shared.select("node", F.col("node").alias("root")).distinct(), "minhash-roots")
    linked = lambda pairs: _verified(pairs, texts, weights, threshold)

    pairs = stored(_agreeing(_leaders(shared), reps), "minhash-agreeing")
    ends = pairs.select(F.col("a").alias("node"), "a", "b", "agree").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "agree"))
    likeliest = ends.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    root = _merged(root, linked(likeliest))
    root = _merged(root, linked(_crossing(pairs, root).select("a", "b")))
    for draw in range(1, REDRAWN + 1):
        nodes = stored(_unresolved(shared, root).filter(F.col("n") > PAIRED).select("node").distinct(), "minhash-open")
        if not nodes.limit(1).count():
            break
        again = stored(signatures(_texts_of(texts, nodes), weights, draw), "minhash-redrawn", (nodes,))
        refiled = again.select("node", F.explode("bands").alias("name")).join(root, "node")
        root = _merged(root, linked(_agreeing(_leaders_of_two(refiled), again).select("a", "b")))
    # what is left of the first buckets: everything against everything of another component
    open_ = stored(_unresolved(shared, root), "minhash-unresolved", (shared, pairs))
    few = open_.filter(F.col("n") <= PAIRED).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("all"))
    few = few.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y")).filter("x.root <> y.root")
    root = _merged(root, linked(_agreeing(_ordered(few.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))), reps).select("a", "b")))
    large = stored(open_.filter(F.col("n") > PAIRED).select("name", "node"), "minhash-open", (open_,))
    if large.limit(1).count():
        placed = stored(large.join(root, "node").select("name", "node", "root"), "minhash-placed", (large,))
        mains = placed.groupBy("name", "root").agg(F.count("*").alias("n")).groupBy("name").agg(F.max(F.struct("n", "root")).alias("m")).select("name", F.col("m.root").alias("main"))
        members = stored(placed.join(mains, "name").select("main", "node", "root").distinct(), "minhash-members", (placed,))
        root = _merged(root, stored(_blockwise(members.filter("root <> main"), members, texts, weights, threshold), "minhash-further"))
    own = texts.select("doc", "node", F.md5("text").alias("print"))
    equal = stored(own.groupBy("print").agg(F.min("node").alias("rep")), "minhash-equal")
    return stored(own.join(equal, "print").join(root.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "node", F.coalesce("root", "rep").alias("root")), "minhash-named", (reps, equal))


def representatives(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of the least id.

    A null id comes before all ids; among equal ids a fingerprint of id and text decides, and of rows that agree in
    both one stays. All columns are kept.
    """
    names, (own,) = docs.columns, free(docs, "_mh_node")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    least = _named(_texts(docs, id_col, text_col), threshold).groupBy("root").agg(F.min(F.struct("doc", "node")).alias("least"))
    stay = stored(least.select(F.col("least.node").alias(own)), "minhash-stay")
    return docs.withColumn(own, _node(id_col, text)).join(stay, own).dropDuplicates([own]).select(*names)
