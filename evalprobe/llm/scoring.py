"""LM scoring: a log-bilinear neural model, trained with noise-contrastive estimation in numpy.

Classes are the most frequent tokens of the training documents and, for all other words, buckets by their last two
bytes. The model gives a class its log-bilinear score from the two classes before it: each context position has a
diagonal matrix, so score(w | u, v) = (C1 * R[u] + C2 * R[v]) . Q[w] + b[w]; the products of all u with all w (and v
with w) are two matrix products, and a softmax over the classes normalises them. A word of a bucket then gets its
share of the bucket by add-one counts, with room for one unseen word. So every token of every text has a probability.

Training covers every training document. Documents are dealt to replicas by a fingerprint of id and text, one replica
for ``REPLICA_TOKENS`` training tokens, and ordered by it inside; so what a replica learns depends on the rows alone,
not on how they are split over files or tasks. Replicas start from common parameters and are averaged by tokens, in
groups, so that no step holds more than a fixed number of them. This is done twice, first on a seventh of the
documents. Counts of all training tokens are aggregated by word; the driver sees the most frequent words alone, and the
rare words of each document meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

HEAD, BUCKETS, DIMS = 1024, 128, 24
#: Words whose counts go along to every task; the counts of rarer words are joined.
CARRIED = 100_000
#: Noise samples of a batch, positions of a batch, step size.
NOISE, BATCH, STEP = 32, 2048, 0.1
#: Documents held out: crc32 of the id modulo FOLDS equal to HELD; those equal to FIRST start the training.
FOLDS, HELD, FIRST = 7, 2, 3
#: Training tokens of a replica, about; with the rows it decides which documents a replica learns from.
REPLICA_TOKENS = 2_000_000
#: Replicas that are averaged in one place, and distinct words a task counts before it reports them.
TOGETHER, COUNTED = 32, 200_000
#: Words whose class a worker keeps.
KEPT = 150_000
END = b"\n"


def fold(doc_id) -> int:
    """The fold of a document, by its id as text (null: "null")."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-2:], 7) % BUCKETS


def counted(rows: DataFrame) -> DataFrame:
    """Counts of the training tokens: ``word``, ``bucket``, ``n``; ``rows`` has ``doc_id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([bucket(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "bucket", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fold(doc) != HELD:
                    counts.update(tokens(text))
                    if len(counts) >= COUNTED:
                        yield told()
                        counts = Counter()
        yield told()

    return stored(rows.mapInArrow(run, "word binary, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n")), "scoring-counts")


@dataclass
class Vocabulary:
    """Totals of the training tokens, the frequent words with their counts, and the class shares."""

    total: int
    distinct: int
    carried: dict[bytes, int]
    classes: dict[bytes, int]
    #: Per class: tokens; per bucket: tokens and distinct words outside the head.
    tokens: np.ndarray
    rest: np.ndarray
    words: np.ndarray

    @property
    def size(self) -> int:
        return HEAD + BUCKETS

    def class_of(self, word: bytes) -> int:
        found = self.classes.get(word)
        return HEAD + bucket(word) if found is None else found

    @property
    def end(self) -> int:
        return self.class_of(END)


def vocabulary(counts: DataFrame) -> Vocabulary:
    # words by steps of their count, so that no more than CARRIED words reach the driver, whatever the number of tasks
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least = CARRIED, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("w")).collect(), reverse=True):
        if r["w"] > room:
            break
        room, least = room - r["w"], r["step"]
    top = [] if least is None else counts.filter(step >= least).select("word", "n").collect()
    carried = {bytes(r["word"]): r["n"] for r in top}
    head = sorted(carried, key=lambda w: (-carried[w], w))[:HEAD]
    sums = {r["bucket"]: (r["n"], r["w"]) for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("w")).collect()}
    rest, words = (np.array([sums.get(b, (0, 0))[k] for b in range(BUCKETS)], np.int64) for k in range(2))
    total, distinct = int(rest.sum()), int(words.sum())
    for word in head:
        rest[bucket(word)] -= carried[word]
        words[bucket(word)] -= 1
    inside = np.zeros(HEAD, np.int64)
    inside[: len(head)] = [carried[w] for w in head]
    return Vocabulary(total, distinct, carried, {w: i for i, w in enumerate(head)}, np.concatenate([inside, rest]), rest, words)


def _scattered(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by class."""
    flat = (at[:, None] * DIMS + np.arange(DIMS)).ravel()
    return np.bincount(flat, rows.ravel(), (HEAD + BUCKETS) * DIMS).reshape(-1, DIMS)


class Classes(dict):
    """Word to class, kept for the words met; bounded, without bearing on results."""

    def __init__(self, head: dict[bytes, int]):
        super().__init__(head)
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
            self.update(self.head)
        found = self[word] = HEAD + bucket(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Model:
    """Parameters: context vectors ``r``, position weights ``c1`` and ``c2``, target vectors ``q``, biases ``b``."""

    shapes = (("r", (HEAD + BUCKETS, DIMS)), ("q", (HEAD + BUCKETS, DIMS)), ("b", (HEAD + BUCKETS,)), ("c1", (DIMS,)), ("c2", (DIMS,)))

    def __init__(self, flat: np.ndarray):
        at = 0
        for name, shape in self.shapes:
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size
        self.flat = flat

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 11) -> Model:
        """Small random vectors and the unigram distribution as biases."""
        draw = np.random.default_rng(seed)
        model = cls((draw.standard_normal(sum(math.prod(s) for _, s in cls.shapes)) * 0.1).astype(np.float32))
        model.b[:] = np.log(share)
        model.c1[:] = model.c2[:] = 1
        return model

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores that the word before (first) and the one before it (second) give every class; biases are in the first."""
        return (self.r * self.c1) @ self.q.T + self.b, (self.r * self.c2) @ self.q.T

    def train(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, share: np.ndarray, draw: np.random.Generator, seen: np.ndarray) -> None:
        """One pass over positions in batches: noise-contrastive estimation with common noise samples, Adagrad."""
        log_share, up = np.log(NOISE * share), np.cumsum(share)
        grads = Model(np.zeros_like(self.flat))
        for low in range(0, len(target), BATCH):
            u, v, w = near[low : low + BATCH], far[low : low + BATCH], target[low : low + BATCH]
            noise = np.minimum(np.searchsorted(up, draw.random(NOISE)), len(share) - 1)
            ru, rv, qw, qn = self.r[u], self.r[v], self.q[w], self.q[noise]
            h = ru * self.c1 + rv * self.c2
            right = 1 / (1 + np.exp((h * qw).sum(1) + self.b[w] - log_share[w]))
            wrong = -1 / (1 + np.exp(-(h @ qn.T + self.b[noise] - log_share[noise])))
            dh = right[:, None] * qw + wrong @ qn
            grads.q[:] = _scattered(w, right[:, None] * h)
            np.add.at(grads.q, noise, wrong.T @ h)
            grads.b[:] = np.bincount(w, right, len(share)) + np.bincount(noise, wrong.sum(0), len(share))
            grads.r[:] = _scattered(u, dh * self.c1) + _scattered(v, dh * self.c2)
            grads.c1[:] = (dh * ru).sum(0)
            grads.c2[:] = (dh * rv).sum(0)
            g = grads.flat / np.float32(len(w))
            seen += g * g
            self.flat += np.float32(STEP) * g / (np.sqrt(seen) + np.float32(1e-6))


def _contexts(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before, class before that, and class, of every token; ends stand before a text."""
    target = np.concatenate(ids)
    near = np.concatenate([[end], target[:-1]])
    far = np.concatenate([[end, end], target[:-2]])[: len(target)]
    first = np.cumsum([0, *map(len, ids[:-1])])
    near[first] = end
    far[first] = end
    second = first + 1
    far[second[second < len(target)]] = end
    return near, far, target


def dealt(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """Per training document: ``first`` (it starts the training), ``replica``, ``place`` in it, ``ids`` (classes, 16 bits each)."""
    classes, held = words.classes, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classes(classes)
        for batch in batches:
            folds = [fold(doc) for doc in batch.column(0).to_pylist()]
            part = batch.filter(pa.array([f != held for f in folds], pa.bool_()))
            ids = [known.of(tokens(text)).astype("<u2").tobytes() for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f == FIRST for f in folds if f != held], pa.bool_()), part.column(2), pa.array(ids, pa.binary())], names=["first", "place", "ids"])

    placed = rows.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("place")).mapInArrow(run, "first boolean, place long, ids binary")
    replicas = max(1, round(words.total / REPLICA_TOKENS))
    return placed.withColumn("replica", F.pmod(F.xxhash64("place"), F.when(F.col("first"), max(1, replicas // (FOLDS - 1))).otherwise(replicas)).cast("int"))


def _trained(placed: DataFrame, words: Vocabulary, share: np.ndarray, flat: np.ndarray, first: bool) -> np.ndarray:
    """The average of the replicas, each trained on the documents dealt to it, in the order of their places."""
    end = words.end

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("place", "ascending")])
        replica = key[0].as_py()
        model, seen, n = Model(flat.copy()), np.full_like(flat, 1e-4), 0
        draw = np.random.default_rng([int(first), replica])
        ids: list[np.ndarray] = []
        held = 0
        for own in table.column("ids").to_pylist():
            ids.append(np.frombuffer(own, "<u2").astype(np.int32))
            held += len(ids[-1])
            if held >= 256 * BATCH:
                model.train(*_contexts(ids, end), share, draw, seen)
                n, held, ids = n + held, 0, []
        if ids:
            model.train(*_contexts(ids, end), share, draw, seen)
        n += held
        yield pa.RecordBatch.from_arrays([pa.array([replica], pa.int32()), pa.array([float(n)]), pa.array([(model.flat.astype(np.float64) * n).tobytes()], pa.binary())], names=["part", "weight", "params"])

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending")])
        total = np.sum([np.frombuffer(p, np.float64) for p in table.column("params").to_pylist()], 0)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "weight": [float(sum(table.column("weight").to_pylist()))], "params": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, weight double, params binary"
    replicas = stored(placed.filter(F.col("first") == first).select("replica", "place", "ids").groupBy("replica").applyInArrow(run, schema), "scoring-replicas")
    while replicas.count() > TOGETHER:
        grouped = replicas.withColumn("own", F.col("part")).withColumn("part", F.floor(F.col("part") / TOGETHER).cast("int"))
        replicas = stored(grouped.groupBy("part").applyInArrow(summed, schema), "scoring-replicas", (replicas,))
    found = sorted(replicas.collect())
    discard(replicas)
    if not found:
        return flat
    return (np.sum([np.frombuffer(r["params"], np.float64) for r in found], 0) / sum(r["weight"] for r in found)).astype(np.float32)


class Scorer:
    """Log10 probabilities of tokens under a model; softmax totals are kept for the contexts met."""

    def __init__(self, flat: np.ndarray, words: Vocabulary):
        near, far = Model(flat).products()
        self.near, self.far, self.words = near.astype(np.float32), far.astype(np.float32), words
        self.totals = np.full(words.size**2, np.nan)

    def __call__(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> np.ndarray:
        k = self.words.size
        context = near.astype(np.int64) * k + far
        fresh = np.unique(context[np.isnan(self.totals[context])])
        for low in range(0, len(fresh), 1024):
            own = fresh[low : low + 1024]
            scores = self.near[own // k] + self.far[own % k]
            top = scores.max(1)
            self.totals[own] = top + np.log(np.exp(scores - top[:, None]).sum(1, dtype=np.float64))
        return (self.near[near, target].astype(np.float64) + self.far[far, target] - self.totals[context]) / math.log(10)


def fitted(rows: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts of the training tokens of ``rows`` (``doc_id``, ``text``), what the driver keeps of them, and the model's parameters."""
    counts = counted(rows)
    words = vocabulary(counts)
    share = (words.tokens + 1.0) / (words.tokens.sum() + words.size)
    flat = Model.start(share).flat
    placed = stored(dealt(rows, words), "scoring-dealt")
    for first in (True, False):
        flat = _trained(placed, words, share.astype(np.float32), flat, first)
    discard(placed)
    return counts, words, flat


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    A null text is empty and has the end alone. A null id counts as the text "null" where it decides the fold.
    Repeated rows train and score as often as they stand. Scores do not depend on how the rows are split. Without
    training documents every token is unknown and the model is that of its start. An empty table gives an empty result.
    Texts are scored whole; only id and text are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts, words, flat = fitted(rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, flat))
    whole = math.log10(words.total + words.distinct + 1)
    room = np.log10(words.rest + words.words + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, params = shared.value
        score = Scorer(params, known)
        classes, carried = Classes(known.classes), known.carried
        row = TaskContext.get().partitionId() << 40  # a name for this run of the table alone
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids, out, rare = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = tokens(text)
                    cls = classes.of(own)
                    n = np.fromiter(map(carried.get, own, repeat(0)), np.int64, len(own))
                    left = Counter([own[i] for i in np.flatnonzero(n == 0)])
                    logs = np.log10(n + 1.0)
                    outside = cls >= HEAD
                    ids.append(cls)
                    # rare words still lack log10(count + 1), in the base and in their bucket
                    out.append((row, fold(doc) == HELD, len(own), int((n > 0).sum()), float(logs.sum()) - whole * len(own), float(logs[outside].sum() - room[cls[outside] - HEAD].sum())))
                    rare.append(left)
                    row += 1
                values = score(*_contexts(ids, known.end)) if ids else np.zeros(0)
                sums = np.add.reduceat(values, np.cumsum([0, *map(len, ids[:-1])])) if ids else np.zeros(0)
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()), pa.array(np.array(columns[5], np.float64) + sums), pa.array([list(x) for x in rare], pa.list_(pa.binary())), pa.array([list(x.values()) for x in rare], pa.list_(pa.int32()))], names=["doc_id", "row", "held_out", "n_tokens", "known", "base", "model", "rare", "times"])

    kind = dict(docs.dtypes)[id_col]
    partial = stored(rows.mapInArrow(run, f"doc_id {kind}, row long, held_out boolean, n_tokens long, known long, base double, model double, rare array<binary>, times array<int>"), "scoring-partial")
    few = partial.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = few.join(counts.select("word", "n"), "word")
    more = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    joined = partial.drop("rare", "times").join(more, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
