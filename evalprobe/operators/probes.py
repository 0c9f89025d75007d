"""Probes: many small models side by side, spread over executors; and token-level models on Spark ML.

A sweep has two steps. All runs of a (feature, split seed) are fitted side by side on all of its training and validation
rows: in one task up to ``FIT_ROWS`` rows of a part, above that by a pass over stored blocks of rows for each step, in
which every block gives its share of the gradient and of the validation loss. Then the parameters go to all rows, and
every row of every part is scored where it stands; only counts are shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .ordering import matched, small
from .storage import discard, folder

#: The grid of penalties, number of starts and training settings.
C_GRID, INITS, EPOCHS, RATE, PATIENCE, MIN_DELTA = (0.0, 0.01, 0.1, 1.0), 3, 800, 0.03, 200, 1e-4
#: Rows of a part up to which a fit is one task; larger ones go over blocks of about ``FIT_VALUES`` components (1 MB).
FIT_ROWS, FIT_VALUES = 20_000, 1 << 17
HIDDEN = 512
#: Partitions over which the fits are dealt, at least.
FIT_TASKS = 200


def init_seed(split_seed: int, c: float, init: int) -> int:
    """The seed of a start follows from split and penalty."""
    return split_seed + 100003 * init + round(10000 * c)


def grid(spark: SparkSession, features: DataFrame, seeds: list[int], cs: tuple[float, ...] = C_GRID, inits: int = INITS) -> DataFrame:
    """Features by split seeds by penalties by starts; the seed of a start follows from split and penalty."""
    runs = spark.createDataFrame([(s, c, i, init_seed(s, c, i)) for s in seeds for c in cs for i in range(inits)], "split_seed long, c_value double, init_index int, init_seed long")
    return features.crossJoin(F.broadcast(runs))  # the run table is a setting, not data


#: Cells (run, unit, row) worked on at a time: every step on them stays in a core's cache.
BLOCK = 32_768


def _phi(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 7.1.26), and exp(-z * z / 2)."""
    x = np.abs(z)
    x /= np.sqrt(2)
    t = 0.3275911 * x
    t += 1
    np.reciprocal(t, out=t)
    x *= x
    bell = np.exp(np.negative(x, out=x), out=x)
    tail = 1.061405429 * t
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        tail += c
        tail *= t
    tail *= bell
    tail *= 0.5
    return np.where(z >= 0, 1 - tail, tail), bell


class Probes:
    """Logistic (``hidden`` 0) or one-hidden-layer GELU classifiers side by side; starts are uniform within 1 / sqrt(inputs)."""

    def __init__(self, params: list[np.ndarray]):
        self.params = params

    @classmethod
    def start(cls, dims: int, hidden: int, seeds: list[int]) -> Probes:
        draws = [np.random.default_rng(s) for s in seeds]
        drawn = lambda shape, inputs: np.stack([d.uniform(-1, 1, shape) / np.sqrt(inputs) for d in draws])
        if not hidden:
            return cls([drawn((dims,), dims), drawn((), dims)])
        return cls([drawn((hidden, dims), dims), drawn((hidden,), dims), drawn((hidden,), hidden), drawn((), hidden)])

    def blocks(self, rows: np.ndarray) -> Iterator[slice]:
        size = max(16, BLOCK // max(1, self.params[1].size))
        return (slice(k, k + size) for k in range(0, len(rows), size))

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        """What goes into the units of the hidden layer: (run, unit, row)."""
        w, b = self.params[:2]
        z = (w.reshape(-1, w.shape[2]) @ rows.T).reshape(*b.shape, len(rows))
        z += b[:, :, None]
        return z

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray]:
        """Scores (run, row)."""
        p = self.params
        if len(p) == 2:
            return (p[0] @ rows.T + p[1][:, None],)
        out = np.empty((len(p[1]), len(rows)))
        for own in self.blocks(rows):
            z = self.inputs(rows[own])
            z *= _phi(z)[0]
            out[:, own] = (p[2][:, None, :] @ z)[:, 0]
        return (out + p[3][:, None],)

    def losses(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The log loss of each run, summed over the rows."""
        z = self.forward(rows)[0]
        return (np.logaddexp(0, z) - labels * z).sum(1)

    def gradients(self, rows: np.ndarray, labels: np.ndarray, n: int | None = None) -> list[np.ndarray]:
        """Of the loss over ``n`` rows (default: the given ones) the share of the given rows."""
        p, n = self.params, max(1, len(labels) if n is None else n)
        error = lambda out, y: (1 / (1 + np.exp(-np.clip(out, -50, 50))) - y) / n
        if len(p) == 2:
            err = error(self.forward(rows)[0], labels)
            return [err @ rows, err.sum(1)]
        found = [np.zeros_like(v) for v in p]
        for own in self.blocks(rows):
            z = self.inputs(rows[own])
            gate, bell = _phi(z)
            active = z * gate
            err = error((p[2][:, None, :] @ active)[:, 0] + p[3][:, None], labels[own])
            z *= bell
            z /= np.sqrt(2 * np.pi)
            z += gate
            z *= p[2][:, :, None]
            z *= err[:, None, :]
            found[0] += (z.reshape(-1, z.shape[2]) @ rows[own]).reshape(p[0].shape)
            found[1] += z.sum(2)
            found[2] += (active @ err[:, :, None])[:, :, 0]
            found[3] += err.sum(1)
        return found


class Descent:
    """All runs (a penalty and a seed each): full batch, Adam with decoupled decay 1 / C of every parameter (none for C = 0), early stopping on validation loss.

    Decay is applied as it stands, param * (1 - rate / C): for C below rate / 2 it overshoots, and the parameters of the
    least validation loss come from the first epochs. A run that has stopped takes no further part.
    """

    def __init__(self, dims: int, hidden: int, cs: list[float], seeds: list[int]):
        self.probes, self.steps = Probes.start(dims, hidden, seeds), 0
        self.first, self.second = ([np.zeros_like(p) for p in self.probes.params] for _ in range(2))
        self.shrink = np.array([1 - RATE / c if c > 0 else 1.0 for c in cs])
        self.best, self.runs = [p.copy() for p in self.probes.params], np.arange(len(cs))
        self.least, self.waited = np.full(len(cs), np.inf), np.zeros(len(cs), int)

    def step(self, gradients: list[np.ndarray]) -> None:
        self.steps += 1
        each = lambda v, p: v.reshape(-1, *[1] * (p.ndim - 1))
        for k, g in enumerate(gradients):
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            p = self.probes.params[k]
            self.probes.params[k] = p * each(self.shrink, p) - RATE * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)

    def judge(self, loss: np.ndarray) -> np.ndarray:
        """Take the validation losses of the runs as they stand; which of them go on."""
        better = loss < self.least - MIN_DELTA
        self.waited = np.where(better, 0, self.waited + 1)
        self.least = np.where(better, loss, self.least)
        for k, p in enumerate(self.probes.params):
            self.best[k][self.runs[better]] = p[better]
        on = (self.waited < PATIENCE) & np.isfinite(loss)
        if not on.all():
            self.runs, self.least, self.waited, self.shrink = self.runs[on], self.least[on], self.waited[on], self.shrink[on]
            self.probes.params, self.first, self.second = ([v[on] for v in held] for held in (self.probes.params, self.first, self.second))
        return on


def fit(x: np.ndarray, y: np.ndarray, train: np.ndarray, val: np.ndarray, cs: list[float], seeds: list[int], hidden: int = 0, epochs: int = EPOCHS) -> Probes:
    """All runs (``Descent``) on rows that one task holds."""
    xt, yt, xv, yv = x[train], y[train], x[val], y[val]
    own = Descent(x.shape[1], hidden, cs, seeds)
    with np.errstate(all="ignore"):
        for _ in range(epochs):
            own.step(own.probes.gradients(xt, yt))
            own.judge(own.probes.losses(xv, yv) / max(1, len(yv)))
            if not len(own.runs):
                break
    return Probes(own.best)


_KEYS = ["feature", "split_seed"]


def _blocks(rows: DataFrame, path: str) -> RDD[Row]:
    """The rows of large fits, stored in ``path`` as matrices of about ``FIT_VALUES`` components, training rows first.

    A hash of the key deals rows to blocks, and a block is sorted, so that its sums are the same in every run. Blocks are
    stored as Python reads them: decoding Parquet in every pass takes as long as the sums.
    """
    count = F.ceil((F.col("_train") + F.col("_val")) * F.size("vec") / FIT_VALUES)
    told = rows.select(*_KEYS, "key", "part", "label", "vec", F.pmod(F.xxhash64(F.col("key"), F.lit(29)), count).alias("block"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_x=[np.asarray(v, np.float64).tobytes() for v in rows["vec"]]).sort_values(["part", "key", "label", "_x"])
        own = {"dims": len(rows["vec"].iloc[0]), "n_train": int((rows["part"] == "train").sum()), "x": b"".join(rows["_x"]), "y": rows["label"].to_numpy(np.float64).tobytes()}
        return pd.DataFrame([{"feature": rows["feature"].iloc[0], "split_seed": int(rows["split_seed"].iloc[0]), **own}])

    packed = told.groupBy(*_KEYS, "block").applyInPandas(pack, "feature string, split_seed long, dims int, n_train int, x binary, y binary")
    context = rows.sparkSession.sparkContext
    # dealt evenly to as many files as there are cores: a pass is as long as its longest task
    packed.repartition(context.defaultParallelism).rdd.saveAsPickleFile(path, 1)
    return context.pickleFile(path)


#: A sum, and what was lost in rounding.
Sum = tuple[np.ndarray, np.ndarray]


def _plus(a: Sum, b: Sum) -> Sum:
    """With the rounding error of every addition kept, totals do not depend on how blocks are dealt to tasks."""
    total = a[0] + b[0]
    more = total - a[0]
    return total, a[1] + b[1] + ((a[0] - (total - more)) + (b[0] - more))


def _merged(a: dict[tuple, list[Sum]], b: dict[tuple, list[Sum]]) -> dict[tuple, list[Sum]]:
    return a | {key: [_plus(p, q) for p, q in zip(a[key], v, strict=True)] if key in a else v for key, v in b.items()}


def _summed(blocks: RDD[Row], settings: dict[tuple, tuple], share: Callable[..., list[np.ndarray]]) -> dict[tuple, list[np.ndarray]]:
    """For each fit in ``settings`` the sums over its blocks of ``share`` (settings of the fit, rows, labels, training rows)."""
    sent = blocks.context.broadcast(settings)

    def add(rows: Iterator[Row]) -> Iterator[dict[tuple, list[Sum]]]:
        held: dict[tuple, list[Sum]] = {}
        with np.errstate(all="ignore"):
            for r in rows:
                if own := sent.value.get((r.feature, r.split_seed)):
                    x, y = np.frombuffer(r.x, np.float64).reshape(-1, r.dims), np.frombuffer(r.y, np.float64)
                    held = _merged(held, {(r.feature, r.split_seed): [(v, np.zeros_like(v)) for v in share(own, x, y, r.n_train)]})
        yield held

    with np.errstate(all="ignore"):
        found = blocks.mapPartitions(add).treeReduce(_merged)
        sent.destroy()
        return {key: [total + rest for total, rest in v] for key, v in found.items()}


def _step(own: tuple, x: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """The share of a block, whose first ``k`` rows train: gradients, and the loss on the others."""
    mean, std, n, params = own
    x, probes = (x - mean) / std, Probes(params)
    return [*probes.gradients(x[:k], y[:k], n), probes.losses(x[k:], y[k:])]


def _fit_apart(rows: DataFrame, sizes: dict[tuple, tuple[int, int]], cs: list[float], inits: list[int], hidden: int, epochs: int) -> list[tuple]:
    """The models of large fits, all of them side by side: (feature, split seed, model). The driver holds parameters, never rows.

    One pass gives the gradients and the validation losses at the same parameters, so a fit takes a pass an epoch and
    one more. ``sizes``: training and validation rows of each fit.
    """
    path = folder(rows.sparkSession, "probe-blocks")
    blocks = _blocks(rows, path)
    count = {key: max(1, n) for key, (n, _) in sizes.items()}
    sums = _summed(blocks, {key: (True,) for key in sizes}, lambda own, x, y, k: [x[:k].sum(0)])
    mean = {key: v[0] / count[key] for key, v in sums.items()}
    sums = _summed(blocks, {key: (m,) for key, m in mean.items()}, lambda own, x, y, k: [((x[:k] - own[0]) ** 2).sum(0)])
    std = {key: np.sqrt(v[0] / count[key]) if sizes[key][0] else np.ones_like(v[0]) for key, v in sums.items()}
    std = {key: np.where(v < 1e-6, 1, v) for key, v in std.items()}
    runs = {key: Descent(len(m), hidden, cs, [init_seed(key[1], c, i) for c, i in zip(cs, inits, strict=True)]) for key, m in mean.items()}
    with np.errstate(all="ignore"):
        for epoch in range(epochs + 1):
            on = {key: (mean[key], std[key], count[key], own.probes.params) for key, own in runs.items() if len(own.runs)}
            if not on:
                break
            for key, (*gradients, losses) in _summed(blocks, on, _step).items():
                if epoch:
                    stay = runs[key].judge(losses / max(1, sizes[key][1]))
                    gradients = [g[stay] for g in gradients]
                if epoch < epochs:
                    runs[key].step(gradients)
    discard(rows.sparkSession, path)
    return [(*key, pickle.dumps((mean[key], std[key], list(zip(cs, inits, strict=True)), own.best))) for key, own in runs.items()]


def fitted(samples: DataFrame, cs: tuple[float, ...] = C_GRID, inits: int = INITS, hidden: int = 0, epochs: int = EPOCHS) -> DataFrame:
    """Per (feature, split_seed) the models of all runs, fitted on all training and validation rows: ``models``, pickled (mean, deviation, runs, parameters)."""
    spark, runs = samples.sparkSession, [(c, i) for c in cs for i in range(inits)]
    rows = samples.filter(F.col("part").isin("train", "val"))
    sizes = small(rows.groupBy(*_KEYS).agg(*(F.count_if(F.col("part") == p).alias(f"_{p}") for p in ("train", "val"))))
    many = F.greatest("_train", "_val") > FIT_ROWS
    told, large = matched(rows, sizes, _KEYS), {(r.feature, r.split_seed): (r["_train"], r["_val"]) for r in sizes.filter(many).collect()}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        x, y, part = np.array(rows["vec"].tolist(), np.float64), rows["label"].to_numpy(), rows["part"].to_numpy()
        train = part == "train"
        mean, std = (x[train].mean(0), x[train].std(0)) if train.any() else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        std = np.where(std < 1e-6, 1, std)
        x, seed = (x - mean) / std, int(rows["split_seed"].iloc[0])
        params = fit(x, y, train, part == "val", [c for c, _ in runs], [init_seed(seed, c, i) for c, i in runs], hidden, epochs).params
        return pd.DataFrame({"feature": [rows["feature"].iloc[0]], "split_seed": [seed], "models": [pickle.dumps((mean, std, runs, params))]})

    # a stated number of partitions is not merged: else the planner puts small inputs, whose fits take long, into one task
    apart = told.filter(~many).select(*_KEYS, "key", "part", "label", "vec").repartition(max(FIT_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))), *_KEYS)
    schema = "feature string, split_seed long, models binary"
    found = apart.groupBy(*_KEYS).applyInPandas(run, schema)
    if not large:
        return found
    return found.unionByName(spark.createDataFrame(_fit_apart(told.filter(many), large, [c for c, _ in runs], [i for _, i in runs], hidden, epochs), schema))


def sweep(samples: DataFrame, cs: tuple[float, ...] = C_GRID, inits: int = INITS, hidden: int = 0, epochs: int = EPOCHS, tested: list[Column] | None = None) -> DataFrame:
    """Accuracies of one model per feature, split seed, penalty and start, on all rows of each part.

    ``samples``: feature, split_seed, key, part (train, val, test), label, vec. ``tested``: further columns by which the
    test rows are told apart (with it, a row per run and value of them).
    """
    keys, more = ["feature", "split_seed"], [c.alias(f"_t{i}") for i, c in enumerate(tested or [])]
    extra = [f"_t{i}" for i in range(len(more))]
    joined = samples.select(*keys, "part", "label", "vec", *more).join(small(fitted(samples, cs, inits, hidden, epochs)), keys)
    kinds = dict(joined.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, rows in frame.groupby([*keys, "part", *extra], sort=False, dropna=False):
                mean, std, runs, params = pickle.loads(rows["models"].iloc[0])
                x, y = (np.array(rows["vec"].tolist(), np.float64) - mean) / std, rows["label"].to_numpy() == 1
                hits = ((Probes(params).forward(x)[0] >= 0) == y).sum(1)
                own = tuple(None if v is pd.NA or v != v else v for v in own)
                yield pd.DataFrame([(*own, c, i, len(y), int(h)) for (c, i), h in zip(runs, hits, strict=True)], columns=[*keys, "part", *extra, "c_value", "init_index", "n", "hits"])

    counts = joined.mapInPandas(run, ", ".join(["feature string, split_seed long, part string", *(f"{e} {kinds[e]}" for e in extra), "c_value double, init_index int, n long, hits long"]))
    by = [*keys, "c_value", "init_index"]
    rate = lambda p: F.try_divide(F.sum(F.when(F.col("part") == p, F.col("hits"))).cast("double"), F.sum(F.when(F.col("part") == p, F.col("n"))))
    found = counts.groupBy(*by).agg(rate("train").alias("train_accuracy"), rate("val").alias("validation_accuracy"), rate("test").alias("test_accuracy"))
    if not extra:
        return found
    apart = counts.filter("part = 'test'").groupBy(*by, *extra).agg(rate("test").alias("test_accuracy"), F.sum("n").alias("n_test"))
    return found.drop("test_accuracy").join(apart, by)


def selected(runs: DataFrame) -> DataFrame:
    """Best start per penalty (validation, training accuracy, lower index), then best penalty (validation accuracy, lower C)."""
    return selected_with(runs, [])


def selected_with(runs: DataFrame, more: list[str]) -> DataFrame:
    """As ``selected``, for each value of further columns."""
    from .metrics import best

    starts = best(runs, ["feature", "split_seed", "c_value", *more], F.desc("validation_accuracy"), F.desc("train_accuracy"), F.asc("init_index"))
    return best(starts, ["feature", "split_seed", *more], F.desc("validation_accuracy"), F.asc("c_value"))


def token_probe(tokens: DataFrame, epochs: int = EPOCHS, cs: tuple[float, ...] = (1.0,), inits: int = 1) -> DataFrame:
    """A model per layer over token rows (layer, key, label, part, vec): every token has its sample's label. All layers are one job."""
    samples = tokens.select(F.col("layer").alias("feature"), F.lit(0).cast("long").alias("split_seed"), "key", "part", "label", "vec")
    counts = samples.filter("part = 'test'").groupBy("feature").agg(F.count("*").alias("n_test"))
    found = selected(sweep(samples, cs, inits, epochs=epochs)).join(counts, "feature")
    return found.select(F.col("feature").alias("layer"), "n_test", F.round("test_accuracy", 6).alias("accuracy"))


def principal(rows: DataFrame, k: int, train: str = "is_train", vec: str = "vec") -> DataFrame:
    """``rows`` with the first ``k`` principal components, of vectors centred on the training mean."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = rows.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(own.filter(train)).transform(own)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred.filter(train))
    return model.transform(centred).withColumn("components", vector_to_array("_p")).drop("_v", "_c", "_p")
