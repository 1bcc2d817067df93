"""Gradient-boosted regression trees on quantised features, grown leaf by leaf or level by level from summed histograms.

Rows are binned once and written in runs: one record has the gradients, keys and bins of some ten thousand rows as bytes, each
feature's bins side by side, so that no step of a pass is taken row by row. A pass over them gives the sums of gradients and the
row counts per (node, feature, bin), summed within tasks and then by cell; the driver sees features x bins x open nodes, whatever
the rows. Splits, penalties and missing values are decided from these sums alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col
from kinecohort.sources.shared import delete, fresh_path

#: Bins of a feature, the last one for missing values.
BINS = 256
MISSING = BINS - 1
#: Trees after which the rows are written with their gradients so far, and with the draws of as many (a byte has bits for 8).
KEEP = 4
#: Bytes of a run of rows, about, and its least and most rows; bytes of runs that Spark reads at once.
RUN_BYTES, RUN_ROWS, GROUP_BYTES = 1 << 19, (1024, 32_768), 32 << 20
_RUN = "key binary, g binary, bins binary, taken binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Learning parameters. growth: "leaf" (best leaf first, up to `leaves`), "level" (all to `depth`), or "symmetric" (one
    split for a whole level). l1 and l2 act on leaf values and gains; rows are drawn anew every `bagging_freq` trees."""

    trees: int = 100
    rate: float = 0.1
    growth: str = "leaf"
    leaves: int | None = 31
    depth: int | None = None
    min_rows: int = 20
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    bagging: float = 1.0
    bagging_freq: int = 0
    columns: float = 1.0
    seed: int = 0
    bins: int = BINS - 1

    def __post_init__(self) -> None:
        if self.growth not in ("leaf", "level", "symmetric"):
            raise ValueError(f"unknown growth: {self.growth}")
        if self.growth != "leaf" and not self.depth:
            raise ValueError("trees grown by levels need a depth")
        if not 2 <= self.bins < BINS or not 0 < self.bagging <= 1 or not 0 < self.columns <= 1:
            raise ValueError(f"out of range: bins {self.bins}, bagging {self.bagging}, columns {self.columns}")

    @property
    def most_leaves(self) -> int:
        by_depth = 1 << self.depth if self.depth else 1 << 31
        return min(by_depth, self.leaves or 1 << 31) if self.growth == "leaf" else by_depth


@dataclass
class Tree:
    """Nodes in the order of their making. A row goes left if its bin is up to `bin`, or missing and `missing_left`."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, s: Split) -> int:
        """Make two children; the right one is the number after the left."""
        first = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node] = s.feature, s.bin, s.missing_left
        self.left[node], self.gain[node] = first, s.gain
        for value, rows in ((s.left_value, s.left_rows), (s.right_value, s.right_rows)):
            self.feature.append(-1)
            self.bin.append(0)
            self.missing_left.append(False)
            self.left.append(-1)
            self.value.append(value)
            self.gain.append(0.0)
            self.rows.append(rows)
        return first

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row, of bins by (feature, row)."""
        width, rows = bins.shape
        node = np.zeros(rows, np.int64)
        if self.feature[0] < 0:
            return node
        # Leaves look at some feature and lead to themselves, so that all rows take the same steps.
        nodes, places = np.arange(len(self.feature)), np.arange(BINS)
        feature, left = np.array(self.feature), np.array(self.left)
        goes_left = np.where(places == MISSING, np.array(self.missing_left)[:, None], places <= np.array(self.bin)[:, None])
        to = np.where(feature[:, None] < 0, nodes[:, None], left[:, None] + ~goes_left).ravel()
        start, flat, row = np.maximum(feature, 0) * rows, bins.ravel(), np.arange(rows)
        level = [0]
        while level := [c for i in level if self.feature[i] >= 0 for c in (self.left[i], self.left[i] + 1)]:
            at = start.take(node)
            at += row
            node *= BINS
            node += flat.take(at)
            node = to.take(node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass(frozen=True)
class Split:
    feature: int
    bin: int
    missing_left: bool
    gain: float
    left_value: float
    right_value: float
    left_rows: int
    right_rows: int


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, _shrunk(g, s.l1) ** 2 / (n + s.l2), 0.0)


def leaf_value(g: float, n: float, s: Settings) -> float:
    """What a leaf adds: the minimum of the penalised squares around its rows' gradients, times the learning rate."""
    return float(-s.rate * _shrunk(np.float64(g), s.l1) / (n + s.l2)) if n else 0.0


def _sides(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums left and right of each cut: (node, feature, bin, missing to the right or left)."""
    gl, nl = np.cumsum(g[..., :MISSING], axis=-1), np.cumsum(n[..., :MISSING], axis=-1)
    gl = np.stack([gl, gl + g[..., MISSING:]], axis=-1)
    nl = np.stack([nl, nl + n[..., MISSING:]], axis=-1)
    g_all, n_all = g.sum(axis=-1)[..., None, None], n.sum(axis=-1)[..., None, None]
    return gl, nl, g_all - gl, n_all - nl


def best_splits(g: np.ndarray, n: np.ndarray, s: Settings) -> list[Split | None]:
    """The split of the greatest gain of each node (the first feature, bin and side among equals), or None.

    g and n: sums of gradients and rows per (node, feature, bin); columns that were not drawn have no rows. With symmetric
    growth, one split for all nodes, by the sum of their gains; nodes without rows on a side then have an empty leaf.
    """
    gl, nl, gr, nr = _sides(g, n)
    gains = _score(gl, nl, s) + _score(gr, nr, s) - _score(gl + gr, nl + nr, s)
    enough = (nl >= s.min_rows) & (nr >= s.min_rows)
    if s.growth == "symmetric":
        # A level's cut must part some rows; its gain is what all nodes gain together.
        usable = (nl.sum(axis=0) >= s.min_rows) & (nr.sum(axis=0) >= s.min_rows)
        gains = np.broadcast_to(np.where(usable, gains.sum(axis=0), -np.inf), gains.shape)
    else:
        gains = np.where(enough, gains, -np.inf)
    out: list[Split | None] = []
    for k in range(len(g)):
        at = np.unravel_index(int(np.argmax(gains[k])), gains[k].shape)
        gain = float(gains[k][at])
        if not np.isfinite(gain) or gain <= max(s.min_gain, 1e-12):
            out.append(None)
            continue
        f, b, side = (int(x) for x in at)
        left, right = (gl[k][at], nl[k][at]), (gr[k][at], nr[k][at])
        values = leaf_value(*left, s), leaf_value(*right, s)
        out.append(Split(f, b, bool(side), gain, *values, int(left[1]), int(right[1])))
    return out


# --- rows ----------------------------------------------------------------------------------


def _opened(vector: Column) -> Column:
    """A vector's values. Those of a dense one are its own array, which no function has to copy."""
    plain = F.unwrap_udt(vector)
    return F.when(plain["type"] == 1, plain["values"]).otherwise(vector_to_array(vector))


def _known(i: int) -> Column:
    return F.when(~F.isnan(F.col(f"x{i}")), F.col(f"x{i}"))


def _edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Upper ends of the bins of each feature: its values if they are few, else values at even ranks."""
    few = rows.agg(*[F.approx_count_distinct(_known(i)).alias(str(i)) for i in range(width)]).first()
    ranks = [(k + 1) / bins for k in range(bins - 1)]
    # An estimate of distinct values has an error of some percent; a set of so few is bounded all the same.
    own = [F.collect_set(_known(i)) if few[i] <= 0.8 * bins else F.percentile_approx(_known(i), ranks, 10_000) for i in range(width)]
    row = rows.agg(*[c.alias(str(i)) for i, c in enumerate(own)]).first()
    return [sorted(set(row[i] or []))[:-1] if few[i] <= 0.8 * bins else sorted(set(row[i] or [])) for i in range(width)]


def _to_bins(x: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins by (feature, row) of values by feature."""
    out = np.empty((len(edges), len(x[0]) if edges else 0), np.uint8)
    for i, (v, own) in enumerate(zip(x, edges)):
        out[i] = np.searchsorted(np.array(own, float), v, side="left")
        out[i][np.isnan(v)] = MISSING
    return out


def _values(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _run_rows(width: int) -> int:
    return min(max(RUN_BYTES // (width + 16), RUN_ROWS[0]), RUN_ROWS[1])


def _in_runs(rows: DataFrame, edges: list[list[float]], start: float, s: Settings) -> DataFrame:
    """Runs of rows whose values are columns x0, x1, ..."""
    width, keep = len(edges), KEEP
    most = _run_rows(width)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, g, bins = (np.concatenate(p, axis=-1) for p in zip(*parts))
        cells = [key, g, bins, _taken(key, 0, keep, s)]
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in cells], ["key", "g", "bins", "taken"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            key, g = _values(batch.column("key")), start - _values(batch.column("y"))
            bins = _to_bins([_values(batch.column(f"x{i}")) for i in range(width)], edges)
            at = 0
            while at < len(key):
                part = slice(at, min(len(key), at + most - size))
                waiting.append((key[part], g[part], bins[:, part]))
                size, at = size + part.stop - at, part.stop
                if size == most:
                    yield packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    return rows.mapInArrow(run, _RUN)


def _of_run(record: Mapping[str, pa.BinaryScalar], width: int, trees: Sequence[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Bins by (feature, row) and gradients, with what the trees add."""
    bins = np.frombuffer(record["bins"].as_buffer(), np.uint8).reshape(width, -1)
    g = np.frombuffer(record["g"].as_buffer(), np.float64)
    for tree in trees:
        g = g + tree.predict(bins)
    return bins, g


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[dict[str, pa.BinaryScalar]]:
    columns = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield {n: c[i] for n, c in zip(names, columns)}


def _advanced(rows: DataFrame, width: int, trees: Sequence[Tree], number: int, s: Settings) -> DataFrame:
    """The rows with what the trees add, and with the draws of the trees from number on."""
    keep = KEEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in (r for batch in batches for r in _runs(batch, ["key", "g", "bins"])):
            g = _of_run(record, width, trees)[1].tobytes()
            taken = _taken(np.frombuffer(record["key"].as_buffer(), np.int64), number, keep, s).tobytes()
            cells = [record["key"].as_py(), g, record["bins"].as_py(), taken]
            yield pa.record_batch([pa.array([x], pa.binary()) for x in cells], ["key", "g", "bins", "taken"])

    return rows.mapInArrow(run, _RUN)


def _kept(df: DataFrame, label: str, before: str | None = None, compression: str = "none") -> tuple[DataFrame, str]:
    """Rows as written, and where; what they were made of goes. Spark reads a group of records at once, so groups are small."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("parquet.block.size", GROUP_BYTES).option("compression", compression).parquet(path)
    if before is not None:
        delete(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def drawn(key: np.ndarray, seed: int, draw: int, share: float) -> np.ndarray:
    """Which rows a draw takes: by a hash of the row's key, so alike in every pass and after a lost executor."""
    h = (key.view(np.uint64) ^ np.uint64((seed * 1_000_003 + draw) % (1 << 63))) * _MIX
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _drawing(s: Settings) -> bool:
    return s.bagging < 1 and s.bagging_freq > 0


def _taken(key: np.ndarray, number: int, keep: int, s: Settings) -> np.ndarray:
    """A bit for each of the next trees from number on: whether its draw takes the row."""
    out = np.zeros(len(key) if _drawing(s) else 0, np.uint8)
    if _drawing(s):
        draws = {d: drawn(key, s.seed, d, s.bagging) for d in {(number + k) // s.bagging_freq for k in range(keep)}}
        for k in range(keep):
            out |= draws[(number + k) // s.bagging_freq].astype(np.uint8) << np.uint8(k)
    return out


@dataclass(frozen=True)
class _Pass:
    """One look at the rows: sums for the open nodes of a growing tree."""

    rows: DataFrame
    width: int
    pending: tuple[Tree, ...]
    settings: Settings
    bit: int

    def sums(self, tree: Tree, nodes: Sequence[int], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, pending, bit, drawing = self.width, self.pending, np.uint8(1 << self.bit), _drawing(self.settings)
        # Rows of no open node, or not drawn, are counted beside the others.
        beside = len(nodes)
        place = np.full(len(tree.feature), beside, np.int64)
        place[list(nodes)] = np.arange(len(nodes))
        cells_of = (len(nodes) + 1) * BINS
        names = ["g", "bins", "taken"] if drawing else ["g", "bins"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, n = np.zeros((width, cells_of)), np.zeros((width, cells_of), np.int64)
            for record in (r for batch in batches for r in _runs(batch, names)):
                bins, gradient = _of_run(record, width, pending)
                own = place.take(tree.leaf_of(bins))
                if drawing:
                    own[np.frombuffer(record["taken"].as_buffer(), np.uint8) & bit == 0] = beside
                take = np.flatnonzero(own != beside)
                if 2 * len(take) < len(own):
                    own, gradient, bins = own[take], gradient[take], bins[:, take]
                own *= BINS
                for f in features:
                    at = own + bins[f]
                    g[f] += np.bincount(at, gradient, cells_of)
                    n[f] += np.bincount(at, minlength=cells_of)
            # As (node, feature, bin), without those beside.
            g, n = (x.reshape(width, -1, BINS)[:, :beside].swapaxes(0, 1).ravel() for x in (g, n))
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(some), pa.array(g[some]), pa.array(n[some])], ["cell", "g", "n"])

        size = len(nodes) * width * BINS
        cells = self.rows.select(*names).mapInArrow(run, "cell long, g double, n long")
        # Sorted, so that a cell's sum does not depend on the order of the tasks.
        cells = cells.repartition("cell").sortWithinPartitions("cell", "g").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
        found = cells.toArrow()
        g, n = np.zeros(size), np.zeros(size)
        at = found.column("cell").to_numpy()
        g[at], n[at] = found.column("g").to_numpy(), found.column("n").to_numpy()
        shape = len(nodes), width, BINS
        return g.reshape(shape), n.reshape(shape)


def _grow_by_level(look: _Pass, features: np.ndarray) -> Tree:
    tree, level = Tree(), [0]
    for _ in range(look.settings.depth):
        found = best_splits(*look.sums(tree, level, features), look.settings)
        if found[0] is None:
            break
        # Also nodes without rows are split, so that a leaf's number is its row of bits.
        level = [child for node, s in zip(level, found) for first in [tree.split(node, s)] for child in (first, first + 1)]
    return tree


def _grow_best_first(look: _Pass, features: np.ndarray) -> Tree:
    """A tree whose best leaf is split first. All leaves that may be split are looked at ahead, in one pass for each depth."""
    s = look.settings
    ahead, depth, known = Tree(), {0: 0}, {}
    while True:
        fresh = [i for i in depth if i not in known and ahead.feature[i] < 0]
        # Leaves of the greatest depth stay as they are; no sums are needed to know.
        known.update((i, None) for i in fresh if s.depth is not None and depth[i] >= s.depth)
        if fresh := [i for i in fresh if i not in known]:
            known.update(zip(fresh, best_splits(*look.sums(ahead, fresh, features), s)))
        tree, at, complete = Tree(), {0: 0}, True
        open_ = {0}
        while len(at) < s.most_leaves:
            best = max((i for i in at if known[at[i]]), key=lambda i: (known[at[i]].gain, -i), default=None)
            if best is None:
                break
            source = at.pop(best)
            first = tree.split(best, known[source])
            if ahead.feature[source] < 0 and len(at) + 2 < s.most_leaves:
                complete = False
                open_ = {source}
                break
            for k in (0, 1):
                at[first + k] = ahead.left[source] + k if ahead.feature[source] >= 0 else source
        if complete:
            return tree
        waiting = sorted((i for i in depth if ahead.feature[i] < 0 and known[i]), key=lambda i: -known[i].gain)
        for node in {*waiting[: s.most_leaves], *open_}:
            first = ahead.split(node, known[node])
            depth[first] = depth[first + 1] = depth[node] + 1


# --- models --------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostedModel:
    """Trees over binned features; rows are scored from a vector or an array of doubles, NaN for missing."""

    edges: tuple[tuple[float, ...], ...]
    start: float
    trees: tuple[Tree, ...]
    settings: Settings
    predictionCol: str = "prediction"
    featuresCol: str = "features"

    def copy(self, extra: Mapping[Any, Any]) -> BoostedModel:
        """The same model with another name of the prediction, as MLlib models take it."""
        return replace(self, predictionCol=next(iter(extra.values()), self.predictionCol))

    def predict(self, x: Column) -> Column:
        """Prediction for a column of arrays, in Arrow batches."""
        edges, start, trees = self.edges, self.start, self.trees

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            out = np.full(len(values), start)
            if trees and len(values):
                if values.null_count:
                    raise ValueError("no features to predict from: null")
                flat = _values(values.flatten()).astype(float, copy=False).reshape(len(values), -1)
                bins = _to_bins(flat.T, edges)
                for tree in trees:
                    out += tree.predict(bins)
            return pa.array(out)

        return score(x)

    def plain(self, x: Column) -> Column:
        """Prediction of symmetric trees in plain columns: a level's answers are the bits of a place in a table."""
        if self.settings.growth != "symmetric":
            raise ValueError("only symmetric trees are tables")
        total = F.lit(self.start)
        for tree in self.trees:
            place, node, level = F.lit(0), 0, []
            while tree.feature[node] >= 0:
                level.append(node)
                node = tree.left[node]
            for node in level:
                f, b = tree.feature[node], tree.bin[node]
                own = self.edges[f]
                above = x[f] > F.lit(float(own[b])) if b < len(own) else F.lit(False)
                right = F.when(F.isnan(x[f]), F.lit(not tree.missing_left[node])).otherwise(above)
                place = place * 2 + right.cast("int")
            leaves = [0]
            for _ in level:
                leaves = [c for i in leaves for c in (tree.left[i], tree.left[i] + 1)]
            total = total + F.array(*[F.lit(tree.value[i]) for i in leaves])[place]
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.predictionCol, self.predict(_opened(col(self.featuresCol))))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name MLlib models have it under
        """Gain per feature, of the sum."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            # A symmetric level has one gain for all its nodes; it is counted once.
            counted = set()
            for f, b, gain in zip(tree.feature, tree.bin, tree.gain):
                if f >= 0 and (self.settings.growth != "symmetric" or (f, b, gain) not in counted):
                    total[f] += gain
                    counted.add((f, b, gain))
        return DenseVector(total / total.sum() if total.sum() else total)

    def to_json(self) -> str:
        return json.dumps(
            {"edges": self.edges, "start": self.start, "trees": [asdict(t) for t in self.trees], "settings": asdict(self.settings)}
        )

    @staticmethod
    def from_json(text: str) -> BoostedModel:
        d = json.loads(text)
        edges = tuple(tuple(e) for e in d["edges"])
        return BoostedModel(edges, d["start"], tuple(Tree(**t) for t in d["trees"]), Settings(**d["settings"]))


@dataclass(frozen=True)
class BoostedRegressor:
    """Least-squares boosting. ``fit`` reads a vector of features (NaN for missing) and a label."""

    settings: Settings
    featuresCol: str = "features"
    labelCol: str = "y"
    predictionCol: str = "prediction"
    key: str | None = None

    def fit(self, df: DataFrame) -> BoostedModel:
        """Rows without a label are left out; without any, the model predicts zero. ``key`` names a column that tells rows
        apart for bagging (by default their features and label do, and equal rows are drawn together)."""
        s = self.settings
        x = _opened(col(self.featuresCol))
        own = df.select(x.alias("x"), col(self.labelCol).cast("double").alias("y"), *([col(self.key).alias("k")] if self.key else []))
        own = own.filter("y IS NOT NULL AND NOT isnan(y)")
        start = own.agg(F.avg("y")).first()[0]
        some = own.select(F.size("x")).first()
        width = some and (some[0] or own.agg(F.max(F.size("x"))).first()[0])
        if not width:
            return BoostedModel((), 0.0, (), s, self.predictionCol, self.featuresCol)
        # Vectors are opened once; all later steps read plain columns.
        alike = F.when(F.size("x") == width, F.col("x")).otherwise(F.raise_error(F.lit("rows have different numbers of features")))
        hashed = F.xxhash64("k" if self.key else F.struct("x", "y")).alias("key")
        flat = own.select(alike.alias("x"), "y", hashed).select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)], "y", "key")
        flat, path = _kept(flat, "features", compression="snappy")
        edges = _edges(flat, width, s.bins)
        rows, path = _kept(_in_runs(flat, edges, start, s), "binned", path)
        rng = np.random.default_rng(s.seed)
        trees: list[Tree] = []
        pending: list[Tree] = []
        since = 0
        for number in range(s.trees):
            if number - since == KEEP:
                rows, path = _kept(_advanced(rows, width, pending, number, s), "boosted", path)
                pending, since = [], number
            count = max(1, int(np.ceil(s.columns * width)))
            features = np.sort(rng.choice(width, count, replace=False)) if count < width else np.arange(width)
            look = _Pass(rows, width, tuple(pending), s, number - since)
            tree = _grow_by_level(look, features) if s.growth == "symmetric" else _grow_best_first(look, features)
            if tree.feature[0] < 0:
                if s.bagging == 1 and s.columns == 1:
                    break  # every further tree would find the same
                continue
            trees.append(tree)
            pending.append(tree)
        delete(df.sparkSession, path)
        return BoostedModel(tuple(tuple(e) for e in edges), float(start), tuple(trees), s, self.predictionCol, self.featuresCol)


# The parameter names of the boosting libraries per setting.
NAMES = {
    "trees": ("n_estimators", "iterations"),
    "rate": ("learning_rate",),
    "depth": ("max_depth", "depth"),
    "leaves": ("num_leaves",),
    "min_rows": ("min_data_in_leaf", "min_child_weight"),
    "min_gain": ("min_gain_to_split",),
    "l1": ("lambda_l1", "reg_alpha"),
    "l2": ("lambda_l2", "reg_lambda"),
    "bagging": ("subsample", "bagging_fraction"),
    "bagging_freq": ("bagging_freq",),
    "columns": ("colsample_bytree", "feature_fraction", "colsample_bylevel"),
    "seed": ("random_state", "random_seed"),
}
# Growth and defaults of the three libraries' regressors.
LIBRARIES = {
    "LGBMRegressor": Settings(100, 0.1, "leaf", 31, None, 20),
    "XGBRegressor": Settings(100, 0.3, "level", None, 6, 1, l2=1.0),
    "CatBoostRegressor": Settings(1000, 0.03, "symmetric", None, 6, 1, l2=3.0),
}


def settings_of(model_class: str, params: Mapping[str, Any]) -> Settings:
    """Settings for a library's parameters over its defaults. Unknown names are an error; none is without effect."""
    if model_class not in LIBRARIES:
        raise ValueError(f"not a boosted regressor: {model_class}")
    of = {n: setting for setting, names in NAMES.items() for n in names}
    unknown = sorted(set(params) - set(of))
    if unknown:
        raise ValueError(f"unknown parameters of {model_class}: {unknown}")
    given = {of[n]: v for n, v in params.items()}
    for name in ("trees", "min_rows", "seed", "bagging_freq"):
        if given.get(name) is not None:
            given[name] = max(0 if name != "trees" else 1, round(given[name]))
    if "depth" in given and (given["depth"] is None or given["depth"] <= 0):
        given["depth"] = None if LIBRARIES[model_class].growth == "leaf" else LIBRARIES[model_class].depth
    if given.get("bagging", 1) < 1 and "bagging_freq" not in given and model_class != "LGBMRegressor":
        given["bagging_freq"] = 1  # the other two draw for every tree
    if model_class != "LGBMRegressor":
        given.pop("leaves", None) if given.get("leaves") is None else None
    return replace(LIBRARIES[model_class], **given)
