"""Boosted regression trees grown best leaf first, from histograms that Spark adds up.

Features are binned once: numbers into at most ``bins`` ranges, categories into a bin each. Rows
then carry small integers. Of a node a tree needs no more than the number of rows and the sum of
gradients in each (feature, bin), so one aggregation over all rows yields the histograms of many
nodes: (node, feature, bin) is the key, every task sums up its own rows first.

A tree always splits the leaf of the largest gain next, until it has ``leaves`` of them. Growing
strictly one by one would be one job a split. But while ``k`` splits are left, none outside the
``k`` best leaves at hand can ever be next: so these are all taken up in one job, and the splits
are then chosen among what is known. Towards the end ``k`` is small, and a job for every few nodes
would make more jobs than the tree has levels: a job therefore takes up ``AHEAD`` nodes at least,
the others by their gain, below nodes not chosen yet as well. The tree is the one that splitting
one by one gives. Only the smaller child of a node is counted, the other is the difference to
its parent.

Rows of equal bins are never told apart by a tree, so they are one row with their number and the
sum of their targets: the passes are over the different rows only, of which features and bins
allow so many and no more.

Histograms on the driver are bounded by the settings (``leaves`` * features * bins), whatever the
number of rows. Rows keep their score in a table of the shared folder; it is written anew every
``cut_every`` trees. In between the few trees since are walked once a tree, and the gradients kept
for the passes of that tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from hodos.session import scratch, shuffle_tasks

#: Nodes taken up in a job at least, if there are as many.
AHEAD = 64
#: Rows a task walks through a tree at once.
GATHERED = 1 << 16


@dataclass(frozen=True)
class BoostSettings:
    trees: int = 500
    leaves: int = 255
    depth: int = 15
    rate: float = 0.05
    least_rows: int = 500
    bins: int = 255
    cut_every: int = 10


@dataclass
class Tree:
    """Nodes by number, 0 the root; ``feature`` is -1 in leaves. Rows go left whose bin is at most
    ``threshold`` or, where ``category`` is a place in ``sides``, is marked there."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    category: np.ndarray
    sides: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int32)
        for node, rows in self.parts(np.ascontiguousarray(bins.T)):
            at[rows] = node
        return at

    def parts(self, columns: np.ndarray, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of its rows) of rows given by their ``columns`` [features, rows]; only the
        leaves ``wanted``, if given: rows that cannot come to one are not walked on."""
        leads = np.full(len(self.feature), wanted is None)
        if wanted is not None:
            leads[list(wanted)] = True
            for i in range(len(leads) - 1, -1, -1):  # children have larger numbers
                if self.feature[i] >= 0:
                    leads[i] |= leads[self.left[i]] | leads[self.right[i]]
        todo = [(0, np.arange(columns.shape[1]))] if leads[0] else []
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                yield node, rows
                continue
            own = columns[self.feature[node]][rows]
            left = self.sides[self.category[node]][own] if self.category[node] >= 0 else own <= self.threshold[node]
            for child, side in ((self.left[node], left), (self.right[node], ~left)):
                if leads[child] and len(there := rows[side]):
                    todo.append((int(child), there))


@dataclass
class Binning:
    """The bins of each feature: upper bounds of numbers, or the number of categories."""

    names: list[str]
    edges: list[np.ndarray | None]  # None: a category, its code is its bin
    width: int

    @property
    def starts(self) -> np.ndarray:
        """Where the bins of each feature begin if all are laid end to end, and their number."""
        return np.cumsum([0] + [self.width if e is None else len(e) + 1 for e in self.edges])

    def matrix(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(self.names)), np.int32)
        for j, (values, edges) in enumerate(zip(columns, self.edges)):
            if edges is None:
                code = np.nan_to_num(values.astype(np.float64), nan=0.0)
                out[:, j] = np.where((code >= 0) & (code < self.width), code, 0).astype(np.int32)
            else:  # what is missing goes with the smallest
                out[:, j] = np.searchsorted(edges, np.nan_to_num(values.astype(np.float64), nan=-np.inf), "left")
        return out


@dataclass
class Boosted:
    binning: Binning
    base: float
    trees: list[Tree] = field(default_factory=list)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Of each row of ``bins``; equal rows are walked once."""
        back = slice(None)
        widths = [int(w) for w in np.diff(self.binning.starts)]
        if prod(widths) < 1 << 62:
            name = np.zeros(len(bins), np.int64)
            for j, width in enumerate(widths):
                name = name * width + bins[:, j]
            _, first, back = np.unique(name, return_index=True, return_inverse=True)
            bins = bins[first]
        columns, score = np.ascontiguousarray(bins.T), np.full(len(bins), self.base)
        for tree in self.trees:
            for node, rows in tree.parts(columns):
                score[rows] += tree.value[node]
        return score[back]

    def predict(self, rows: DataFrame, output: str = "prediction", keep: list[str] | None = None) -> DataFrame:
        """``rows``, or their columns ``keep``, with one column more. Tasks hold the trees, whose
        size the settings bound."""
        names = self.binning.names
        kept = F.struct(*[F.col(f"`{c}`") for c in (rows.columns if keep is None else keep)]).alias("_row")
        inputs = rows.select(kept, *[F.col(f"`{c}`").cast("double").alias(f"_{j}") for j, c in enumerate(names)])
        row_type = inputs.schema["_row"].dataType.simpleString()

        def run(batches):
            for group in _gathered(batches):
                columns = [np.concatenate([b[f"_{j}"].to_numpy(zero_copy_only=False) for b in group]) for j in range(len(names))]
                score, at = self.scores(self.binning.matrix(columns)), 0
                for batch in group:
                    yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(score[at : at + batch.num_rows])], names=["_row", "_score"])
                    at += batch.num_rows

        scored = inputs.mapInArrow(run, f"_row {row_type}, _score double")
        return scored.select("_row.*", F.col("_score").alias(output))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of together about ``GATHERED`` rows."""
    group: list[pa.RecordBatch] = []
    for batch in batches:
        group.append(batch)
        if sum(b.num_rows for b in group) >= GATHERED:
            yield group
            group = []
    if group:
        yield group


def fit_bins(rows: DataFrame, numbers: list[str], categories: dict[str, int], most: int) -> Binning:
    """Bins of ``numbers`` (every value, or quantiles if there are more than ``most``) and of
    ``categories``, columns of codes below the given number."""
    value = {name: F.col(name).cast("double") for name in numbers}
    share = [i / most for i in range(1, most)]
    kinds = rows.agg(*[F.approx_count_distinct(v) for v in value.values()]).first()
    few = {name for name, n in zip(numbers, kinds) if n <= most}  # their sets are small
    looked_up = [F.collect_set(v) if name in few else F.percentile_approx(v, share, 10_000) for name, v in value.items()]
    found = dict(zip(numbers, rows.agg(*looked_up).first()))
    more = [name for name in few if len(found[name]) > most]
    if more:
        found |= dict(zip(more, rows.agg(*[F.percentile_approx(value[name], share, 10_000) for name in more]).first()))
    # what lies above all bounds is in the last bin
    bounds = {name: np.unique(np.array(found[name] or [], np.float64)) for name in numbers}
    edges: list[np.ndarray | None] = [b[:-1] if name in few and name not in more else b for name, b in bounds.items()]
    width = max([len(e) + 1 for e in edges] + list(categories.values()) + [2])
    return Binning([*numbers, *categories], edges + [None] * len(categories), width)


# --- one tree ----------------------------------------------------------------------------


@dataclass
class _Node:
    histogram: np.ndarray  # (features, bins, 2): rows, sum of gradients
    depth: int
    split: tuple | None = None  # (gain, feature, threshold, sides)
    children: tuple[int, int] | None = None

    @property
    def rows(self) -> int:
        return round(self.histogram[0, :, 0].sum())

    @property
    def slope(self) -> float:
        return float(self.histogram[0, :, 1].sum())


def best_split(histogram: np.ndarray, is_category: list[bool], least_rows: int) -> tuple | None:
    """(gain, feature, last bin to the left, mask of bins to the left or None); None if no split
    leaves ``least_rows`` on both sides and gains. The first of equal ones in order of features."""
    best = None
    for j, category in enumerate(is_category):
        rows, slope = histogram[j, :, 0], histogram[j, :, 1]
        order = np.arange(len(rows))
        if category:  # sorted by mean gradient the best set of categories is a prefix
            there = np.flatnonzero(rows > 0)
            order = there[np.argsort(slope[there] / rows[there], kind="stable")]
        if len(order) < 2:
            continue
        left_rows, left_slope = np.cumsum(rows[order])[:-1], np.cumsum(slope[order])[:-1]
        n, total = rows.sum(), slope.sum()
        right_rows, right_slope = n - left_rows, total - left_slope
        fits = (left_rows >= max(least_rows, 1)) & (right_rows >= max(least_rows, 1))
        if not fits.any():
            continue
        gain = np.where(fits, left_slope**2 / np.maximum(left_rows, 1) + right_slope**2 / np.maximum(right_rows, 1) - total**2 / n, -1.0)
        at = int(gain.argmax())
        if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
            sides = None
            if category:
                sides = np.zeros(len(rows), bool)
                sides[order[: at + 1]] = True
            best = (float(gain[at]), j, -1 if category else int(order[at]), sides)
    return best


class _Growth:
    """A tree while it grows: every node taken up so far, chosen or not."""

    def __init__(self, binning: Binning, settings: BoostSettings):
        self.binning, self.settings = binning, settings
        self.is_category = [e is None for e in binning.edges]
        self.nodes: list[_Node] = []

    def add(self, histogram: np.ndarray, depth: int) -> int:
        node = _Node(histogram, depth)
        if depth < self.settings.depth:
            node.split = best_split(histogram, self.is_category, self.settings.least_rows)
        self.nodes.append(node)
        return len(self.nodes) - 1

    def tree(self, inner: set[int], rate: float = 0.0) -> Tree:
        """The nodes as a tree in which ``inner`` are split."""
        n, width = len(self.nodes), self.binning.width
        feature, threshold, category = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        left, right, gain = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
        value, rows, sides = np.zeros(n), np.zeros(n, np.int64), []
        for i, node in enumerate(self.nodes):
            rows[i] = node.rows
            value[i] = -rate * node.slope / max(node.rows, 1)
            if i in inner:
                gain[i], feature[i], threshold[i], mask = node.split
                left[i], right[i] = node.children
                if mask is not None:
                    category[i] = len(sides)
                    sides.append(mask)
        return Tree(feature, threshold, left, right, category, np.array(sides, bool).reshape(-1, width), value, rows, gain)

    def grow(self, count) -> set[int]:
        """Splits best first; ``count(taken, wanted)`` gives the histograms of the nodes ``wanted``
        of the tree in which ``taken`` are split. Returns the chosen inner nodes."""
        chosen: set[int] = set()
        heap = [(-self.nodes[0].split[0], 0)] if self.nodes[0].split else []
        left = self.settings.leaves - 1
        while heap and left:
            if self.nodes[heap[0][1]].children is None:
                ahead = [i for _, i in heapq.nsmallest(left, heap) if self.nodes[i].children is None]
                if len(ahead) < AHEAD:
                    more = {i for i, n in enumerate(self.nodes) if n.split and n.children is None} - set(ahead)
                    ahead += heapq.nsmallest(AHEAD - len(ahead), more, key=lambda i: (-self.nodes[i].split[0], i))
                self._take_up(ahead, count)
            _, i = heapq.heappop(heap)
            chosen.add(i)
            left -= 1
            for child in self.nodes[i].children:
                if self.nodes[child].split:
                    heapq.heappush(heap, (-self.nodes[child].split[0], child))
        return chosen

    def _take_up(self, which: list[int], count) -> None:
        small: dict[int, int] = {}
        for i in which:
            node = self.nodes[i]
            _, j, at, sides = node.split
            left_rows = node.histogram[j, sides, 0].sum() if sides is not None else node.histogram[j, : at + 1, 0].sum()
            node.children = (len(self.nodes), len(self.nodes) + 1)
            small[i] = node.children[0] if 2 * left_rows <= node.rows else node.children[1]
            self.nodes += [_Node(node.histogram, node.depth + 1), _Node(node.histogram, node.depth + 1)]
        found = count({i for i, n in enumerate(self.nodes) if n.children}, list(small.values()))
        for i in which:
            node = self.nodes[i]
            for child in node.children:
                histogram = found[small[i]] if child == small[i] else node.histogram - found[small[i]]
                self.nodes[child].histogram = histogram
                if self.nodes[child].depth < self.settings.depth:
                    self.nodes[child].split = best_split(histogram, self.is_category, self.settings.least_rows)


def _columns(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """[features, rows]: the packed bins of a batch, all of one length."""
    packed = batch["bins"].cast(pa.binary(2 * features))
    flat = np.frombuffer(packed.buffers()[1], np.uint16, batch.num_rows * features, packed.offset * 2 * features)
    return np.ascontiguousarray(flat.reshape(batch.num_rows, features).T)


def _histograms(table: DataFrame, binning: Binning, tree: Tree | None, wanted: list[int]) -> dict[int, np.ndarray]:
    """Of each node ``wanted`` of ``tree`` the rows and gradients by (feature, bin), added up by Spark."""
    features, starts = len(binning.names), binning.starts
    widths, first = np.diff(starts), starts * len(wanted)  # the cells of a feature: (node, bin)
    place = {node: i for i, node in enumerate(wanted)}

    def count(batches):
        rows, slopes = np.zeros(first[-1]), np.zeros(first[-1])
        for group in _gathered(batches):
            columns = np.concatenate([_columns(b, features) for b in group], axis=1)
            n = np.concatenate([b["n"].to_numpy() for b in group]).astype(np.float64)
            slope = np.concatenate([b["slope"].to_numpy() for b in group])
            if tree is None:
                node = np.zeros(len(n), np.int64)
            else:
                found = [(place[i], there) for i, there in tree.parts(columns, wanted)]
                if not found:
                    continue
                inside = np.concatenate([there for _, there in found])
                node = np.repeat([i for i, _ in found], [len(there) for _, there in found])
                columns, n, slope = columns[:, inside], n[inside], slope[inside]
            for j in range(features):
                cell, a, b = node * widths[j] + columns[j], first[j], first[j + 1]
                rows[a:b] += np.bincount(cell, n, b - a)
                slopes[a:b] += np.bincount(cell, slope, b - a)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.rint(rows[some]).astype(np.int64)), pa.array(slopes[some])], names=["cell", "n", "slope"])

    sums = table.mapInArrow(count, "cell long, n long, slope double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("slope").alias("slope")).toArrow()
    out = np.zeros((len(wanted), features, binning.width, 2))
    cell = sums["cell"].to_numpy()
    feature = np.searchsorted(first, cell, "right") - 1
    node, own = np.divmod(cell - first[feature], widths[feature])
    at = node, feature, own
    out[(*at, 0)], out[(*at, 1)] = sums["n"].to_numpy(), sums["slope"].to_numpy()
    return {node: out[i] for i, node in enumerate(wanted)}


def fit(rows: DataFrame, target: str, numbers: list[str], categories: dict[str, int], settings: BoostSettings = BoostSettings()) -> Boosted:
    """Trees for ``target`` (squared error). Rows without a target are not learned from; without
    any row the model is the number 0."""
    spark = rows.sparkSession
    folder = scratch(spark, "boosting")
    rows = rows.where(F.col(target).isNotNull())
    binning = fit_bins(rows, numbers, categories, settings.bins)
    mean = rows.agg(F.avg(target)).first()[0]
    model = Boosted(binning, float(mean or 0.0))
    if mean is None:
        return model
    _binned(rows, target, binning).withColumn("score", F.lit(model.base)).write.parquet(f"{folder}/rows-0")
    table = spark.read.parquet(f"{folder}/rows-0")
    since: list[Tree] = []
    for number in range(settings.trees):
        sloped = _scored(table, since, len(binning.names)).select("bins", "n", (F.col("n") * F.col("score") - F.col("total")).alias("slope"))
        sloped = sloped.persist(StorageLevel.MEMORY_AND_DISK)
        growth = _Growth(binning, settings)
        growth.add(_histograms(sloped, binning, None, [0])[0], 0)
        chosen = growth.grow(lambda taken, wanted: _histograms(sloped, binning, growth.tree(taken), wanted))
        sloped.unpersist()
        tree = growth.tree(chosen, settings.rate)
        model.trees.append(tree)
        since = [*since, tree]
        if len(since) == settings.cut_every and number + 1 < settings.trees:
            to = f"{folder}/rows-{number + 1}"
            _scored(table, since, len(binning.names)).write.parquet(to)
            table, since = spark.read.parquet(to), []
    return model


def _binned(rows: DataFrame, target: str, binning: Binning) -> DataFrame:
    """bins (packed), n, total: the different rows, how often each comes and the sum of its targets."""
    names = binning.names

    def bin_rows(batches):
        for batch in batches:
            bins = binning.matrix([batch[f"_{j}"].to_numpy(zero_copy_only=False) for j in range(len(names))]).astype(np.uint16)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(names)), len(bins), [None, pa.py_buffer(np.ascontiguousarray(bins))])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch["_y"]], names=["bins", "y"])

    inputs = rows.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(names)])
    same = inputs.mapInArrow(bin_rows, "bins binary, y double").groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    # Few bytes are passed over many times: a fixed number of files keeps all cores at work.
    return same.repartition(shuffle_tasks(rows.sparkSession), "bins")


def _scored(table: DataFrame, since: list[Tree], features: int) -> DataFrame:
    """The rows with the trees ``since`` in their score."""
    if not since:
        return table

    def score(batches):
        for group in _gathered(batches):
            columns = np.concatenate([_columns(b, features) for b in group], axis=1)
            total, at = np.concatenate([b["score"].to_numpy() for b in group]), 0
            for tree in since:
                for node, rows in tree.parts(columns):
                    total[rows] += tree.value[node]
            for batch in group:
                yield pa.RecordBatch.from_arrays([batch["bins"], batch["n"], batch["total"], pa.array(total[at : at + batch.num_rows])], names=["bins", "n", "total", "score"])
                at += batch.num_rows

    return table.mapInArrow(score, "bins binary, n long, total double, score double")


# --- on disk -----------------------------------------------------------------------------

_NODES = "tree int, node int, feature int, threshold int, left int, right int, sides array<int>, value double, rows long, gain double"


def nodes(model: Boosted, spark: SparkSession) -> DataFrame:
    """One row a node that can be reached from its root; ``sides`` are the bins that go left, null but for categories."""
    rows = []
    for t, tree in enumerate(model.trees):
        reach = [0]
        while reach:
            i = reach.pop()
            sides = np.flatnonzero(tree.sides[tree.category[i]]).tolist() if tree.category[i] >= 0 else None
            rows.append((t, i, int(tree.feature[i]), int(tree.threshold[i]), int(tree.left[i]), int(tree.right[i]), sides, float(tree.value[i]), int(tree.rows[i]), float(tree.gain[i])))
            if tree.feature[i] >= 0:
                reach += [int(tree.left[i]), int(tree.right[i])]
    return spark.createDataFrame(rows, _NODES)


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    nodes(model, spark).write.mode("overwrite").parquet(f"{path}/nodes")
    bins = [(j, name, None if e is None else e.tolist(), model.binning.width, model.base) for j, (name, e) in enumerate(zip(model.binning.names, model.binning.edges))]
    spark.createDataFrame(bins, "place int, name string, edges array<double>, width int, base double").coalesce(1).write.mode("overwrite").parquet(f"{path}/bins")


def load(spark: SparkSession, path: str) -> Boosted:
    """A saved model; its rows are as many as its settings allowed nodes."""
    bins = sorted(spark.read.parquet(f"{path}/bins").collect())
    width = bins[0].width
    binning = Binning([b.name for b in bins], [None if b.edges is None else np.array(b.edges, np.float64) for b in bins], width)
    by_tree: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/nodes").collect():
        by_tree.setdefault(row.tree, []).append(row)
    trees = []
    for _, rows in sorted(by_tree.items()):
        n = max(r.node for r in rows) + 1
        tree = Tree(*(np.zeros(n, np.int32) for _ in range(4)), np.full(n, -1, np.int32), np.zeros((0, width), bool), np.zeros(n), np.zeros(n, np.int64), np.zeros(n))
        tree.feature[:] = -1
        sides = []
        for r in rows:
            tree.feature[r.node], tree.threshold[r.node], tree.left[r.node], tree.right[r.node] = r.feature, r.threshold, r.left, r.right
            tree.value[r.node], tree.rows[r.node], tree.gain[r.node] = r.value, r.rows, r.gain
            if r.sides is not None:
                tree.category[r.node] = len(sides)
                sides.append(np.isin(np.arange(width), r.sides))
        tree.sides = np.array(sides, bool).reshape(-1, width)
        trees.append(tree)
    return Boosted(binning, bins[0].base, trees)
