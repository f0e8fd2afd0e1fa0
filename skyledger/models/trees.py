"""Forests and boosted trees over packed vectors: the growing of MLlib's trees, whose models come out.

A value of a feature only matters by its bin, so a vector becomes one byte a feature, and rows travel in blocks. A level of
all trees of a forest, or of the trees of all classes, is one pass over the blocks; a task sends sums per bin and the
driver gets splits. Poisson draws, features tried per node, impurities, losses and steps are those of MLlib.
"""

from __future__ import annotations

import json
import pickle
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import materialize, scratch_path

# What the tasks run travels with them: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 16_384
POINTS = 256  # values of a feature that a task names for the cuts
BATCH_BYTES = 8 << 20
# Sums of one pass in a task; more trees than that take another pass.
PASS_BYTES = 96 << 20
# Sums of all tasks that the driver adds up itself; more are added up by tree in the cluster.
DRIVER_BYTES = 64 << 20
RENEW = 2  # boosting steps after which the margins of the rows are stored again
NEVER = 255  # a cut that no bin is beyond
_DRAWS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Packed:
    """Blocks of rows: ``bins`` holds one byte a value, feature after feature, ``numbers`` the ``columns`` as doubles."""

    blocks: DataFrame
    cuts: list[np.ndarray]  # a value belongs to the bin of the number of cuts below it
    columns: list[str]
    tasks: int


# --- packing ---------------------------------------------------------------------------------------


def _summary(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights, or, beyond ``most`` distinct ones, ``POINTS`` of them of about the same weight."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if len(first) <= most:
        return values[first], np.add.reduceat(weights, first)
    sums = np.cumsum(weights)
    at = np.searchsorted(sums, (np.arange(POINTS) + 0.5) / POINTS * sums[-1])
    # The ends are kept, for the largest value is never a cut.
    return np.concatenate([values[:1], values[at], values[-1:]]), np.concatenate([[0.0], np.full(POINTS, sums[-1] / POINTS), [0.0]])


def _cuts_of(parts: list[tuple[np.ndarray, np.ndarray]], bins: int) -> np.ndarray:
    values, weights = (np.concatenate(x) for x in zip(*parts))
    known = np.unique(values)
    if len(known) <= bins:
        return (known[1:] + known[:-1]) / 2
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weights[order])
    at = np.searchsorted(sums, np.arange(1, bins) / bins * sums[-1])
    cuts = np.unique(values[order][np.minimum(at, len(values) - 1)])
    return cuts[cuts < known[-1]]


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, rows)
            held, n = whole.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table) -> np.ndarray:
    """One line a feature."""
    vectors = table.column("x").combine_chunks()
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.ascontiguousarray(vectors.flatten().to_numpy().reshape(len(table), -1).T)


def packed(rows: DataFrame, columns: Sequence[str], bins: int = 32, vector: str = "__features") -> Packed:
    """Pack stored vectors. Cuts are quantiles of all rows, or lie between all values of a feature with few of them."""
    spark = rows.sparkSession
    # A block is some MB, so a batch ends by its bytes.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    given = rows.select(vector_to_array(vector).alias("x"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def summarise(batches):
        parts: list[list] = []
        for table in _matrices(batches, 4 * BLOCK_ROWS):
            found = [_summary(v, np.ones(len(v)), bins) for v in _matrix(table)]
            parts = [[*a, b] for a, b in zip(parts, found)] if parts else [[b] for b in found]
            if len(parts[0]) >= 16:
                parts = [[_summary(*(np.concatenate(x) for x in zip(*p)), POINTS)] for p in parts]
        for i, p in enumerate(parts):
            values, weights = _summary(*(np.concatenate(x) for x in zip(*p)), POINTS)
            yield pa.RecordBatch.from_pydict({"f": pa.array([i], pa.int32()), "v": [values.tobytes()], "w": [weights.tobytes()]})

    by_feature: dict[int, list] = {}
    for r in given.select("x").mapInArrow(summarise, "f int, v binary, w binary").toArrow().to_pylist():
        by_feature.setdefault(r["f"], []).append((np.frombuffer(r["v"]), np.frombuffer(r["w"])))
    cuts = [_cuts_of(by_feature[i], bins) for i in sorted(by_feature)]

    def pack(batches):
        for k, table in enumerate(_matrices(batches, BLOCK_ROWS)):
            coded = np.array([np.searchsorted(c, v) for c, v in zip(cuts, _matrix(table))], np.uint8)
            numbers = np.array([table.column(f"c{i}").to_numpy() for i in range(len(columns))], float)
            if not np.isfinite(numbers).all():
                raise ValueError(f"a label or weight is missing or not finite: {list(columns)}")
            block = (TaskContext.get().partitionId() << 32) + k
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([len(table)], pa.int32()), "bins": [coded.tobytes()], "numbers": [numbers.tobytes()]})

    blocks = given.mapInArrow(pack, "block bigint, n int, bins binary, numbers binary")
    blocks = materialize(blocks.repartition(spark.sparkContext.defaultParallelism), "packed")
    return Packed(blocks, cuts, list(columns), blocks.rdd.getNumPartitions())


# --- growing ---------------------------------------------------------------------------------------


class Tree:
    """Nodes numbered as in a heap; what is no split sends all rows left, into copies of itself."""

    def __init__(self, depth: int, width: int):
        nodes = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.cut = np.zeros(nodes, np.intp), np.full(nodes, NEVER, np.intp)
        self.gain, self.sums, self.value = np.full(nodes, -1.0), np.zeros((nodes, width)), np.zeros(nodes)

    def settle(self) -> None:
        """Values of regression nodes; those of a leaf also at the nodes that its rows end in."""
        self.value = self.sums[:, 1] / np.maximum(self.sums[:, 0], 1e-300)
        for i in range(2**self.depth - 1):
            if self.cut[i] == NEVER:
                self.value[2 * i + 1] = self.value[2 * i + 2] = self.value[i]


def _walk(flat: np.ndarray, n: int, rows: np.ndarray, tree: Tree, steps: int) -> np.ndarray:
    node = np.zeros(len(rows), np.intp)
    offset = tree.feature * n
    for _ in range(steps):
        beyond = flat.take(offset.take(node) + rows) > tree.cut.take(node)
        node *= 2
        node += 1
        node += beyond
    return node


def _histogram(flat, n, rows, slot, slots, subset, n_features, bins, target, weight, classes) -> np.ndarray:
    """Sums per (tried feature, node, bin): weights per class, or weights and weighted targets."""
    tried = n_features if subset is None else subset.shape[1]
    width = classes or 2
    out = np.empty((tried, slots * bins, width))
    base = slot * bins
    weighted = None if classes else weight * target
    for j in range(tried):
        if subset is None:
            b = flat[j * n : (j + 1) * n]
            b = b if len(rows) == n else b.take(rows)
        else:
            b = flat.take((subset[:, j] * n).take(slot) + rows)
        at = base + b
        if classes:
            at *= classes
            at += target
            out[j] = np.bincount(at, weight, slots * bins * classes).reshape(-1, classes)
        else:
            out[j, :, 0] = np.bincount(at, weight, slots * bins)
            out[j, :, 1] = np.bincount(at, weighted, slots * bins)
    return out.reshape(tried, slots, bins, width)


def _score(sums: np.ndarray, classes: int) -> np.ndarray:
    """What a split raises: weight less impurity times weight, up to a part that is the same on both sides."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (sums**2).sum(-1) / sums.sum(-1) if classes else sums[..., 1] ** 2 / sums[..., 0]


def best_splits(total: np.ndarray, subset: np.ndarray | None, n_cuts: np.ndarray, classes: int) -> tuple:
    """Feature, cut and gain of every node (no gain: no split), and the sums of the node and of both sides."""
    tried, slots, bins, _ = total.shape
    features = np.broadcast_to(np.arange(tried), (slots, tried)) if subset is None else subset
    whole = total[0].sum(1)
    left = total.cumsum(2)[:, :, :-1]
    right = whole[None, :, None] - left
    # What rounding leaves of a class, or of all weight, is nothing; MLlib's models refuse a negative share.
    counted = right if classes else right[..., :1]
    counted[counted < 1e-12 * (whole if classes else whole[:, :1])[None, :, None]] = 0.0
    weight = (lambda s: s.sum(-1)) if classes else (lambda s: s[..., 0])
    least = 1e-9 * weight(whole)[None, :, None]
    fits = (weight(left) > least) & (weight(right) > least) & (np.arange(bins - 1) < n_cuts[features.T][:, :, None])
    node = _score(whole, classes)
    gains = np.where(fits, _score(left, classes) + _score(right, classes) - node[None, :, None], -np.inf)
    gains = gains.transpose(1, 0, 2).reshape(slots, -1)
    at = gains.argmax(1)
    k, cut, s = at // (bins - 1), at % (bins - 1), np.arange(slots)
    gain = gains[s, at]
    gain = np.where(gain > 1e-12 * np.abs(node), gain / np.maximum(weight(whole), 1e-300), -1.0)
    return features[s, k], cut, gain, whole, left[k, s, cut], right[k, s, cut]


def _grow(data: Packed, trees: list[Tree], targets: Callable, classes: int, subset_size: int, seed: int) -> None:
    """Grow ``trees`` level by level; ``targets(row of a block, flat, n, which)`` yields (tree, rows, target, weight)."""
    n_features, depth = len(data.cuts), trees[0].depth
    n_cuts = np.array([len(c) for c in data.cuts])
    bins, width = int(n_cuts.max(initial=0)) + 1, classes or 2
    if bins < 2:
        bins = 2
    draw = np.random.default_rng(seed)
    active = [[0] for _ in trees]
    before: dict[int, np.ndarray] = {}  # sums of the level above, where nodes try all features
    for level in range(depth):
        going = [t for t in range(len(trees)) if active[t]]
        subsets = {t: None if subset_size >= n_features else np.array([draw.choice(n_features, subset_size, replace=False) for _ in active[t]], np.intp) for t in going}
        size = {t: min(subset_size, n_features) * len(active[t]) * bins * width * 8 for t in going}
        while going:
            part = [going.pop(0)]
            while going and sum(size[t] for t in part) + size[going[0]] <= PASS_BYTES:
                part.append(going.pop(0))
            # A level added up in the cluster leaves no sums behind for the next one.
            by_driver = data.tasks * sum(size[t] for t in part) <= DRIVER_BYTES
            found = _pass(data, trees, targets, classes, level, part, active, subsets, bins, by_driver, n_cuts, before)
            for t, (feature, cut, gain, whole, left, right) in found.items():
                tree, ahead = trees[t], []
                for i, node in enumerate(active[t]):
                    tree.sums[node] = whole[i]
                    if gain[i] > 0:
                        tree.feature[node], tree.cut[node], tree.gain[node] = feature[i], cut[i], gain[i]
                        tree.sums[2 * node + 1], tree.sums[2 * node + 2] = left[i], right[i]
                        ahead += [2 * node + 1, 2 * node + 2]
                active[t] = ahead
            for t in set(part) - set(found):
                active[t] = []


def _pass(data, trees, targets, classes, level, part, active, subsets, bins, by_driver, n_cuts, before) -> dict[int, tuple]:
    """Best splits of the active nodes. Where ``before`` holds the sums of their parents, only the lighter one of two siblings is read."""
    n_features, size = len(data.cuts), len(trees[0].feature)
    slots = {t: np.full(size, -1, np.intp) for t in part}
    lighter = {}
    for t in part:
        read = np.array(active[t])
        if by_driver and t in before:
            weights = trees[t].sums[read].sum(1) if classes else trees[t].sums[read, 0]
            lighter[t] = (weights[1::2] < weights[::2]).astype(np.intp)
            read = read[2 * np.arange(len(lighter[t])) + lighter[t]]
        slots[t][read] = np.arange(len(read))
    counts = {t: int(slots[t].max()) + 1 for t in part}
    grown = {t: trees[t] for t in part}

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                n, flat = row["n"], np.frombuffer(row["bins"], np.uint8)
                for t, rows, target, weight in targets(row, flat, n, part):
                    slot = slots[t].take(_walk(flat, n, rows, grown[t], level))
                    there = slot >= 0
                    if not there.all():
                        rows, slot, target, weight = rows[there], slot[there], target[there], weight[there]
                    found = _histogram(flat, n, rows, slot, counts[t], subsets[t], n_features, bins, target, weight, classes)
                    if t in total:
                        total[t] += found
                    else:
                        total[t] = found
        for t, found in total.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "sums": pa.array([found.tobytes()], pa.binary())})

    def added(t: int, sums: Sequence[bytes]) -> np.ndarray:
        return sum(np.frombuffer(s) for s in sums).reshape(-1, counts[t], bins, classes or 2)

    def merge(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        found = pickle.dumps(best_splits(added(t, [s.as_py() for s in table.column("sums")]), subsets[t], n_cuts, classes))
        return pa.table({"tree": pa.array([t], pa.int32()), "found": pa.array([found], pa.binary())})

    sums = data.blocks.mapInArrow(run, "tree int, sums binary")
    if not by_driver:
        for t in part:
            before.pop(t, None)
        merged = sums.groupBy("tree").applyInArrow(merge, "tree int, found binary").toArrow()
        return {r["tree"]: pickle.loads(r["found"]) for r in merged.to_pylist()}
    got: dict[int, list] = {}
    for r in sums.toArrow().to_pylist():
        got.setdefault(r["tree"], []).append(r["sums"])
    found = {}
    for t in part:
        # Rows may be in the heavier nodes only; then nothing came of the tree.
        total = added(t, got[t]) if t in got else np.zeros((n_features if subsets[t] is None else subsets[t].shape[1], counts[t], bins, classes or 2))
        if t in lighter:
            both = np.empty((len(total), 2 * counts[t], *total.shape[2:]))
            pair = 2 * np.arange(counts[t])
            both[:, pair + lighter[t]] = total
            both[:, pair + 1 - lighter[t]] = before[t] - total
            total = both
        found[t] = best_splits(total, subsets[t], n_cuts, classes)
        if subsets[t] is None:
            # Of this level only the nodes with a split have children.
            before[t] = total[:, found[t][2] > 0]
    return found


def grow_forest(data: Packed, label: str, weight: str | None, trees: int, depth: int, classes: int, seed: int, bootstrap: bool = True) -> list[Tree]:
    """A forest; ``classes`` is 0 for a number as target. With ``bootstrap`` rows count by Poisson draws, anew for every tree."""
    y, w, n_columns = data.columns.index(label), data.columns.index(weight) if weight else None, len(data.columns)
    n_features = len(data.cuts)
    tried = n_features if trees == 1 else int(np.ceil(n_features**0.5 if classes else n_features / 3))
    grown = [Tree(depth, classes or 2) for _ in range(trees)]

    def targets(row, flat, n, part):
        numbers = np.frombuffer(row["numbers"]).reshape(n_columns, n)
        target = numbers[y].astype(np.intp) if classes else numbers[y]
        for t in part:
            times = _DRAWS[np.random.Generator(np.random.SFC64([seed, t, row["block"]])).integers(0, 1 << 16, n, np.uint16)] if bootstrap else np.ones(n, np.uint8)
            rows = np.flatnonzero(times)
            drawn = times[rows].astype(float)
            yield t, rows, target[rows], drawn if w is None else drawn * numbers[w][rows]

    _grow(data, grown, targets, classes, tried, seed)
    return grown


def boost(data: Packed, label: str, weight: str | None, of_class: Sequence[int | None], steps: int, depth: int, rate: float, seed: int) -> list[list[Tree]]:
    """Boosted trees, for each entry of ``of_class`` a chain that tells that class from the rest, or follows the number (None).

    The chains take their steps together, so a pass serves all of them.
    """
    spark = data.blocks.sparkSession
    y, w, n_columns = data.columns.index(label), data.columns.index(weight) if weight else None, len(data.columns)
    chains: list[list[Tree]] = [[] for _ in of_class]
    held = Packed(data.blocks.select("*", F.lit(None).cast("binary").alias("margins")), data.cuts, data.columns, data.tasks)
    stored = 0  # steps that the stored margins contain
    path = None

    def margins(row, flat, n, since: int, until: int) -> np.ndarray:
        out = np.zeros((len(of_class), n)) if row["margins"] is None else np.frombuffer(row["margins"]).reshape(-1, n).copy()
        rows = np.arange(n)
        for k, chain in enumerate(chains):
            for s in range(since, until):
                out[k] += (rate if s else 1.0) * chain[s].value.take(_walk(flat, n, rows, chain[s], depth))
        return out

    for step in range(steps):
        if step - stored == RENEW:
            since = stored

            def renew(batches, since=since, step=step):
                for batch in batches:
                    for i, row in enumerate(batch.to_pylist()):
                        now = margins(row, np.frombuffer(row["bins"], np.uint8), row["n"], since, step)
                        yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:-1]], pa.array([now.tobytes()], pa.binary())], names=batch.schema.names)

            old, path = path, scratch_path(spark, "margins")
            held.blocks.mapInArrow(renew, held.blocks.schema).write.mode("error").parquet(path)
            held.blocks, stored = spark.read.schema(held.blocks.schema).parquet(path), step
            _discard(spark, old)
        trees = [Tree(depth, 2) for _ in of_class]

        def targets(row, flat, n, part, since=stored, step=step):
            numbers = np.frombuffer(row["numbers"]).reshape(n_columns, n)
            all_weights = np.ones(n) if w is None else numbers[w]
            now = margins(row, flat, n, since, step)
            for k in part:
                one = of_class[k]
                if one is None:
                    target = numbers[y] if step == 0 else 2.0 * (numbers[y] - now[k])
                else:
                    sign = np.where(numbers[y] == one, 1.0, -1.0)
                    target = sign if step == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * now[k]))
                yield k, np.arange(n), target, all_weights

        _grow(held, trees, targets, 0, len(data.cuts), seed + step)
        for chain, tree in zip(chains, trees):
            tree.settle()
            chain.append(tree)
    _discard(spark, path)
    return chains


def _discard(spark: SparkSession, path: str | None) -> None:
    """Delete a table of margins that nothing reads any more."""
    if path:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


# --- models ----------------------------------------------------------------------------------------

_NODE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
    "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def _nodes(tree: Tree, cuts: list[np.ndarray], classes: int) -> list[tuple]:
    """Nodes in the order of MLlib's files; two leaves with one prediction become one, as MLlib prunes them."""
    out: list = []

    def leaf(at: int) -> bool:
        return tree.cut[at] == NEVER

    def prediction(at: int) -> float:
        return float(tree.sums[at].argmax()) if classes else float(tree.sums[at, 1] / max(tree.sums[at, 0], 1e-300))

    def prune(at: int) -> None:
        if not leaf(at):
            a, b = 2 * at + 1, 2 * at + 2
            prune(a)
            prune(b)
            if leaf(a) and leaf(b) and prediction(a) == prediction(b):
                tree.cut[at], tree.feature[at], tree.gain[at] = NEVER, 0, -1.0

    def add(at: int) -> int:
        me = len(out)
        out.append(None)
        sums = tree.sums[at]
        # A regression node keeps weight and sum; nothing reads its sum of squares and impurity.
        total = sums.sum() if classes else sums[0]
        stats = sums.tolist() if classes else [*sums.tolist(), 0.0]
        impurity = float(1 - (sums**2).sum() / max(total, 1e-300) ** 2) if classes else 0.0
        split, children = (-1, [], -1), (-1, -1)
        if not leaf(at):
            f = int(tree.feature[at])
            split = (f, [float(cuts[f][tree.cut[at]])], -1)
            children = add(2 * at + 1), add(2 * at + 2)
        out[me] = (me, prediction(at), impurity, stats, int(round(total)), float(tree.gain[at]), *children, split)
        return me

    prune(0)
    add(0)
    return out


def to_model(spark: SparkSession, kind: type, estimator: Estimator, trees: list[Tree], weights: Sequence[float], data: Packed, classes: int = 0) -> Model:
    """MLlib's model of the trees, by way of its file format."""
    path = scratch_path(spark, "model")
    names = [n for n in ("featuresCol", "labelCol", "maxDepth", "numTrees", "maxIter") if estimator.hasParam(n)]
    common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {"impurity": "gini" if classes else "variance"}}
    of_class = kind is RandomForestClassificationModel
    single = "classification.DecisionTreeClassificationModel" if of_class else "regression.DecisionTreeRegressionModel"
    package = "classification" if "Classification" in kind.__name__ else "regression"
    head = common | {
        "class": f"org.apache.spark.ml.{package}.{kind.__name__}", "uid": estimator.uid, "paramMap": {n: estimator.getOrDefault(n) for n in names},
        "numFeatures": len(data.cuts), "numTrees": len(trees), **({"numClasses": classes} if of_class else {}),
    }
    one = common | {"class": f"org.apache.spark.ml.{single}", "paramMap": {"maxDepth": estimator.getOrDefault("maxDepth")}}
    nodes = [(t, node) for t, tree in enumerate(trees) for node in _nodes(tree, data.cuts, classes)]
    heads = [(t, json.dumps(one | {"uid": f"{estimator.uid}_tree_{t}"}), float(w)) for t, w in enumerate(weights)]
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)


_PLAIN = {"subsamplingRate": 1.0, "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}
_KINDS = {
    RandomForestClassifier: {"featureSubsetStrategy": "auto", "impurity": "gini"},
    RandomForestRegressor: {"featureSubsetStrategy": "auto", "impurity": "variance"},
    GBTClassifier: {"featureSubsetStrategy": "all", "lossType": "logistic"},
    GBTRegressor: {"featureSubsetStrategy": "all", "lossType": "squared"},
}


def grows(estimator: Estimator) -> bool:
    """Whether :func:`fit` can stand for the estimator's own fit: trees with these settings, and one-vs-rest over them."""
    if type(estimator) is OneVsRest:
        return type(estimator.getClassifier()) is GBTClassifier and grows(estimator.getClassifier())
    asked = _KINDS.get(type(estimator))
    if asked is None or (estimator.hasParam("validationIndicatorCol") and estimator.isDefined("validationIndicatorCol")):
        return False
    same = all(estimator.getOrDefault(n) == v for n, v in (_PLAIN | asked).items())
    return same and estimator.getOrDefault("maxBins") == 32 and 1 <= estimator.getOrDefault("maxDepth") <= 12


def fit(estimator: Estimator, data: Packed) -> Model:
    """The model that ``estimator`` asks for, grown over packed rows that hold its label and weight."""
    spark = data.blocks.sparkSession
    get = estimator.getOrDefault
    weight = get("weightCol") if estimator.isDefined("weightCol") else None
    label, y, n_columns = get("labelCol"), data.columns.index(get("labelCol")), len(data.columns)

    def largest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"m": [float(np.frombuffer(row["numbers"]).reshape(n_columns, -1)[y].max())]})

    def n_classes() -> int:
        return int(data.blocks.mapInArrow(largest, "m double").agg(F.max("m")).head()[0]) + 1

    kind = type(estimator)
    if kind is OneVsRest:
        one = estimator.getClassifier()
        chains = boost(data, label, weight, range(n_classes()), one.getOrDefault("maxIter"), one.getOrDefault("maxDepth"), one.getOrDefault("stepSize"), one.getOrDefault("seed") & 0x7FFFFFFF)
        one = one.copy({one.featuresCol: get("featuresCol")})
        models = [_boosted(spark, GBTClassificationModel, one, c, data) for c in chains]
        return estimator._copyValues(OneVsRestModel(models=models))
    depth, seed = get("maxDepth"), get("seed") & 0x7FFFFFFF
    if kind in (GBTClassifier, GBTRegressor):
        of_class, model = (1, GBTClassificationModel) if kind is GBTClassifier else (None, GBTRegressionModel)
        return _boosted(spark, model, estimator, boost(data, label, weight, [of_class], get("maxIter"), depth, get("stepSize"), seed)[0], data)
    classes = max(2, n_classes()) if kind is RandomForestClassifier else 0
    trees = grow_forest(data, label, weight, get("numTrees"), depth, classes, seed, get("bootstrap"))
    return to_model(spark, RandomForestClassificationModel if classes else RandomForestRegressionModel, estimator, trees, [1.0] * len(trees), data, classes)


def _boosted(spark: SparkSession, kind: type, estimator: Estimator, chain: list[Tree], data: Packed) -> Model:
    return to_model(spark, kind, estimator, chain, [1.0] + [estimator.getOrDefault("stepSize")] * (len(chain) - 1), data)
