"""Self-organising maps. Online training is sequential and runs in numpy on one machine; scoring and the batch variant are Spark plans.

A map is a small table of nodes, bounded by its grid; it is broadcast, and data only ever meet it row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from labelsift.operators.sampling import sample

ADJACENT = 1.42
DISTANCES = ("euclidean", "cosine", "manhattan", "chebyshev")
#: Rows that meet a node table at once.
CHUNK = 4096
NEIGHBOURHOODS = ("gaussian", "mexican_hat", "bubble", "triangle")


def grid_positions(rows: int, columns: int, topology: str = "rectangular") -> np.ndarray:
    """Plane coordinates of the nodes, (rows, columns, 2); hexagonal maps shift every second line, the last first, half a step left."""
    if topology not in ("rectangular", "hexagonal"):
        raise ValueError(f"unknown topology {topology}")
    place = np.stack(np.meshgrid(np.arange(rows, dtype=float), np.arange(columns, dtype=float), indexing="ij"), -1)
    if topology == "hexagonal":
        place[:, ::-2, 0] -= 0.5
    return place


def distances(x: np.ndarray, weights: np.ndarray, kind: str, compat: bool = False) -> np.ndarray:
    """From x to every node. ``compat`` keeps the known quirk of chebyshev, the greatest signed difference."""
    gap = x - weights
    if kind == "euclidean":
        return np.sqrt((gap**2).sum(-1))
    if kind == "manhattan":
        return np.abs(gap).sum(-1)
    if kind == "chebyshev":
        return (gap if compat else np.abs(gap)).max(-1)
    if kind == "cosine":
        return 1 - (weights * x).sum(-1) / (np.linalg.norm(weights, axis=-1) * np.linalg.norm(x) + 1e-8)
    raise ValueError(f"unknown distance {kind}")


@dataclass
class Som:
    """A map of rows x columns nodes over n_features. Rates fall linearly: the radius to 1, the learning rate to 0."""

    rows: int
    columns: int
    n_features: int
    sigma: float = 1.0
    rate: float = 0.5
    neighbourhood: str = "gaussian"
    distance: str = "euclidean"
    topology: str = "rectangular"
    seed: int | None = None
    compat: bool = False
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        if self.neighbourhood not in NEIGHBOURHOODS:
            raise ValueError(f"neighbourhood must be one of {NEIGHBOURHOODS}")
        if self.distance not in DISTANCES:
            raise ValueError(f"distance must be one of {DISTANCES}")
        self.place = grid_positions(self.rows, self.columns, self.topology)
        self.away = ((self.place - self.place[:, :, None, None]) ** 2).sum(-1)
        self.rng = np.random.RandomState(self.seed)
        w = self.rng.rand(self.rows, self.columns, self.n_features) * 2 - 1
        self.weights = w / np.linalg.norm(w, axis=-1, keepdims=True)

    def _data(self, data) -> np.ndarray:
        data = np.asarray(data, float)
        if data.ndim != 2 or data.shape[1] != self.n_features:
            raise ValueError(f"expected rows of {self.n_features} features")
        return data

    def start_from_samples(self, data) -> None:
        data = self._data(data)
        self.weights = data[self.rng.randint(len(data), size=(self.rows, self.columns))].copy()

    def start_from_axes(self, data) -> None:
        """Spread the nodes over the plane of the two principal axes. With ``compat`` the rows of the eigenvector matrix are
        taken in place of its columns, as published maps were."""
        data = self._data(data)
        if self.n_features == 1:
            raise ValueError("two features or more are needed")
        self._spread(np.cov(data.T))

    def start_from_covariance(self, covariance: np.ndarray) -> None:
        """As start_from_axes, of data whose covariance is known."""
        self._spread(covariance)

    def _spread(self, covariance: np.ndarray) -> None:
        values, vectors = np.linalg.eig(covariance)
        order = np.argsort(-values)
        first, second = (vectors[order[k]] if self.compat else vectors[:, order[k]] for k in (0, 1))
        a, b = np.linspace(-1, 1, self.rows), np.linspace(-1, 1, self.columns)
        self.weights = a[:, None, None] * first + b[None, :, None] * second

    def influence(self, node: tuple[int, int], sigma: float) -> np.ndarray:
        if self.neighbourhood in ("gaussian", "mexican_hat"):
            square = self.away[node] / (2 * sigma * sigma)
            return np.exp(-square) * (1 - 2 * square if self.neighbourhood == "mexican_hat" else 1)
        away = [np.abs(np.arange(n) - c) for n, c in zip((self.rows, self.columns), node, strict=True)]
        if self.neighbourhood == "bubble":
            return np.outer(*[(d < sigma).astype(float) for d in away])
        return np.outer(*[np.maximum(sigma - d, 0) for d in away])

    def winner(self, x) -> tuple[int, int]:
        near = distances(np.asarray(x, float), self.weights, self.distance, self.compat)
        return divmod(int(near.argmin()), self.columns)

    def train(self, data, steps: int, shuffled: bool = False) -> None:
        """One sample a step, in order or in one shuffle of all steps."""
        data = self._data(data)
        if steps < 1:
            raise ValueError("at least one step is needed")
        order = np.arange(steps) % len(data)
        if shuffled:
            self.rng.shuffle(order)
        for t, j in enumerate(order):
            x, left = data[j], (steps - t) / steps
            pull = self.influence(self.winner(x), 1 + (self.sigma - 1) * left) * self.rate * left
            self.weights += pull[..., None] * (x - self.weights)

    def node_distances(self, data) -> np.ndarray:
        """Euclidean distance of each row to each node; the expansion is kept from going below 0."""
        data, flat = self._data(data), self.weights.reshape(-1, self.n_features)
        square = (data**2).sum(1)[:, None] + (flat**2).sum(1) - 2 * data @ flat.T
        return np.sqrt(np.maximum(square, 0))

    def quantization(self, data) -> np.ndarray:
        return self.weights.reshape(-1, self.n_features)[self.node_distances(data).argmin(1)]

    def quantization_error(self, data) -> float:
        data = self._data(data)
        return float(np.linalg.norm(data - np.array([self.weights[self.winner(x)] for x in data]), axis=1).mean())

    def topographic_error(self, data) -> float:
        """Share of rows whose two nearest nodes aren't neighbours."""
        if self.topology == "hexagonal":
            raise NotImplementedError("defined for rectangular maps")
        if self.rows * self.columns == 1:
            return float("nan")
        two = np.argsort(self.node_distances(data), axis=1, kind="stable")[:, :2]
        x, y = np.divmod(two, self.columns)
        return float((np.hypot(np.diff(x), np.diff(y)) > ADJACENT).mean())

    def hits(self, data) -> np.ndarray:
        out = np.zeros((self.rows, self.columns))
        for x in self._data(data):
            out[self.winner(x)] += 1
        return out

    def won(self, data, labels=None) -> dict[tuple[int, int], list]:
        """Row numbers, or labels, by winning node."""
        data = self._data(data)
        if labels is not None and len(labels) != len(data):
            raise ValueError("as many labels as rows are needed")
        out: dict[tuple[int, int], list] = {}
        for k, x in enumerate(data):
            out.setdefault(self.winner(x), []).append(k if labels is None else labels[k])
        return out

    def u_matrix(self, scaling: str = "sum") -> np.ndarray:
        """Sum or mean of the distances to neighbouring nodes, over the greatest."""
        if scaling not in ("sum", "mean"):
            raise ValueError("scaling is sum or mean")
        out = np.zeros((self.rows, self.columns))
        for x in range(self.rows):
            for y in range(self.columns):
                near = [(x + i, y + j) for i, j in neighbour_steps(y, self.topology) if 0 <= x + i < self.rows and 0 <= y + j < self.columns]
                gaps = [np.linalg.norm(self.weights[x, y] - self.weights[n]) for n in near]
                out[x, y] = (np.mean if scaling == "mean" else np.sum)(gaps)
        return out / out.max()

    def frame(self, spark: SparkSession) -> DataFrame:
        """The node table (node, x, y, w)."""
        rows = [(i * self.columns + j, i, j, self.weights[i, j].tolist()) for i in range(self.rows) for j in range(self.columns)]
        return spark.createDataFrame(rows, "node int, x int, y int, w array<double>")


def neighbour_steps(y: int, topology: str) -> list[tuple[int, int]]:
    if topology == "rectangular":
        return [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    # the shifted lines' diagonal neighbours lie on one side, the others' on the other
    side = 0 if y % 2 == 0 else 1
    return [(1, 0), (-1, 0), (side, 1), (side - 1, 1), (side, -1), (side - 1, -1)]


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def _rows(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.flatten()
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _gaps(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to nodes, each by its differences."""
    out = np.empty((len(x), len(weights)))
    for k, w in enumerate(weights):
        gap = x - w
        np.einsum("ij,ij->i", gap, gap, out=out[:, k])
    return np.sqrt(out, out=out)


def _nearest(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the node table, which is bounded by its grid, by number."""
    rows = nodes.select("node", "w").orderBy("node").collect()
    return np.array([r.node for r in rows]), np.array([r.w for r in rows], float)


def assign(df: DataFrame, key: str, vector: str, nodes: DataFrame, best: int = 1) -> DataFrame:
    """(key, rank, node, distance) of each row's ``best`` nearest nodes; ties to the lower node. Each batch of rows meets the node table in numpy; nothing
    is shuffled. A row without vector has the first nodes at null."""
    number, weights = _nearest(nodes)
    take = min(best, len(number))
    kinds = {f.name: f.dataType for f in df.schema} | {f.name: f.dataType for f in nodes.schema}
    schema = StructType([StructField(key, kinds[key]), StructField("rank", IntegerType()), StructField("node", kinds["node"]), StructField("distance", DoubleType())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, CHUNK) for s in range(0, batch.num_rows, CHUNK)):
                k, v = part.column(0), part.column(1)
                known = v.is_valid().to_numpy(zero_copy_only=False)
                gaps = np.full((len(k), len(number)), np.nan)
                gaps[known] = _gaps(_rows(v.drop_null()), weights) if known.any() else 0
                first = gaps.argmin(1)[:, None] if take == 1 else np.argsort(gaps, axis=1, kind="stable")[:, :take]
                far = np.take_along_axis(gaps, first, 1).ravel()
                n = np.repeat(np.arange(len(k)), take)
                columns = [k.take(pa.array(n)), pa.array(np.tile(np.arange(take, dtype=np.int32), len(k))), pa.array(number[first.ravel()]), pa.array(far, mask=~known[n])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if i else c for i, (c, f) in enumerate(zip(columns, made, strict=True))], schema=made)

    made = to_arrow_schema(schema)
    return df.select(key, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(near, schema)


def map_quality(df: DataFrame, key: str, vector: str, nodes: DataFrame) -> DataFrame:
    """(quantization_error, topographic_error) over all rows, as one aggregate of a row a batch."""
    grid = nodes.select("node", "x", "y", "w").orderBy("node").collect()
    place, weights = np.array([(r.x, r.y) for r in grid], float), np.array([r.w for r in grid], float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, apart, n = 0.0, 0, 0
            for part in (batch.slice(s, CHUNK) for s in range(0, batch.num_rows, CHUNK)):
                if not len(v := part.column(0).drop_null()):
                    continue
                gaps = _gaps(_rows(v), weights)
                two = np.argsort(gaps, axis=1, kind="stable")[:, :2]
                total, n = total + float(np.take_along_axis(gaps, two[:, :1], 1).sum()), n + len(v)
                apart += int((np.hypot(*(place[two[:, 0]] - place[two[:, -1]]).T) > ADJACENT).sum())
            yield pa.RecordBatch.from_pydict({"d": [total], "a": [float(apart)], "n": [n]})

    per = df.select(F.col(vector).cast("array<double>").alias("_v")).mapInArrow(sums, "d double, a double, n long")
    return per.agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("quantization_error"), (F.sum("a") / F.nullif(F.sum("n"), F.lit(0))).alias("topographic_error"))


def covariance(df: DataFrame, vector: str) -> np.ndarray:
    """The covariance of all rows' vectors: a table of dimensions by dimensions, in two passes, a row a dimension and batch."""
    rows = df.select(F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    width = len(rows.first()[0])
    means = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("_v")[i]) for i in range(width)]).first()
    n, middle = means[0], np.array(means[1:], float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _rows(batch.column(0)) - middle
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width), pa.int32()), "s": total.tolist()})

    per = rows.mapInArrow(sums, "i int, s array<double>").groupBy("i").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)])
    out = np.zeros((width, width))
    for r in per.collect():
        out[r.i] = r[1:]
    return out / max(1, n - 1)


def train_batch(df: DataFrame, vector: str, start: Som, epochs: int = 10) -> Som:
    """The batch rule, for data beyond one machine: in each epoch, nodes become the mean of all rows weighted by the neighbourhood of their
    winners. Each epoch is one aggregation to a row a node; results differ from online training."""
    k = start.n_features
    som = start
    rows = df.select(F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    for t in range(epochs):
        sigma = 1 + (som.sigma - 1) * (epochs - t) / epochs
        weights = som.weights.reshape(-1, k).copy()

        def won(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(weights), int), np.zeros_like(weights)
            for batch in batches:
                for part in (batch.slice(s, CHUNK) for s in range(0, batch.num_rows, CHUNK)):
                    x = _rows(part.column(0))
                    hot = np.eye(len(weights))[_gaps(x, weights).argmin(1)]
                    n, total = n + hot.sum(0).astype(int), total + hot.T @ x
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.arange(len(weights)), pa.int32()), "n": pa.array(n), "s": total.tolist()})

        sums = rows.mapInArrow(won, "node int, n long, s array<double>").groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)])
        total, weight = np.zeros((som.rows * som.columns, k)), np.zeros(som.rows * som.columns)
        for r in sums.collect():  # at most one row a node
            weight[r.node] = r.n
            total[r.node] = [r[f"s{i}"] for i in range(k)]
        pull = np.array([som.influence(divmod(n, som.columns), sigma).ravel() for n in range(len(weight))])
        mass = pull.T @ weight
        fresh = (pull.T @ total) / np.maximum(mass, 1e-12)[:, None]
        flat = som.weights.reshape(-1, k).copy()
        flat[mass > 1e-12] = fresh[mass > 1e-12]
        som.weights = flat.reshape(som.rows, som.columns, k)
    return som


def node_table(assigned: DataFrame, labels: DataFrame, key: str, nodes: DataFrame, label: str, trusted: str) -> DataFrame:
    """(node, x, y, hits, n_labelled, minority_share): nodes without rows have 0 hits and a null share."""
    joined = assigned.where("rank = 0").join(labels, key, "left")
    counted = F.col(trusted) & F.col(label).isNotNull()
    per = joined.groupBy("node").agg(F.count(F.lit(1)).alias("hits"), F.count_if(counted).alias("n_labelled"), F.avg(F.when(counted, F.col(label).cast("double"))).alias("minority_share"))
    return nodes.select("node", "x", "y").join(per, "node", "left").select("node", "x", "y", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), "minority_share")


def drivers(nodes: DataFrame, features: list[str], share: str, base: float) -> DataFrame:
    """(feature, gap): mean over nodes that lean to the minority less mean over the others, in deviations over the nodes; greatest first."""
    lean = F.col(share) >= base
    aggs = [((F.avg(F.when(lean, F.col(c))) - F.avg(F.when(~lean, F.col(c)))) / F.stddev_pop(c)).alias(c) for c in features]
    return nodes.where(F.col(share).isNotNull()).agg(*aggs).unpivot([], features, "feature", "gap").orderBy(F.abs("gap").desc(), "feature")


def sweep(df: DataFrame, key: str, vector: str, sides: tuple[int, ...], steps: int, seed: int = 42, rows: int = 100_000) -> DataFrame:
    """(side, quantization_error, topographic_error, empty_pct, median_hits) of square maps, trained on ``rows`` rows at most, those of least
    hash, and measured on all."""
    spark = df.sparkSession
    train = np.array([r[0] for r in sample(df, key, rows, seed).select(vector).collect()])
    out = None
    for side in sides:
        m = Som(side, side, train.shape[1], sigma=side / 2, seed=seed)
        m.start_from_axes(train)
        m.train(train, steps, shuffled=True)
        nodes = m.frame(spark)
        hits = nodes.select("node").join(assign(df, key, vector, nodes).groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "left").fillna(0, ["n"])
        spread = hits.agg((100.0 * F.avg((F.col("n") == 0).cast("double"))).alias("empty_pct"), F.median("n").alias("median_hits"))
        one = map_quality(df, key, vector, nodes).crossJoin(spread).select(F.lit(side).alias("side"), "quantization_error", "topographic_error", "empty_pct", "median_hits")
        out = one if out is None else out.unionAll(one)
    return out
