"""k-means with restarts and diagnostics, Euclidean silhouettes, agglomerative linkage, cluster profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from labelsift.operators.som import assign, euclidean
from labelsift.operators.stats import adjusted_rand

RESTARTS = 10
#: Rows of a linkage, which is quadratic in them.
LINKAGE_ROWS = 3000
#: Rows of a silhouette's group; up to how many rows there is one group, and how many groups beyond at least.
GROUP_ROWS, SMALL_ROWS, LEAST_GROUPS = 32_768, 4096, 5
#: Small rows of a part in k-means; up to so many stay in the parts they are read in.
KMEANS_PART_ROWS = 65_536
#: Share of two squared lengths under which a squared distance is taken for 0.
ROUNDING = 2e-14


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, restarts: int = RESTARTS, most_iterations: int = 100) -> tuple[DataFrame, float, list]:
    """(``df`` with cluster, within sum of squares, centres) of the best of ``restarts`` runs."""
    ready = df.select(array_to_vector(vector).alias("_features")).cache()
    best = None
    try:
        for r in range(restarts):
            model = KMeans(k=k, seed=seed * 1000 + r, featuresCol="_features", predictionCol="cluster", maxIter=most_iterations, tol=1e-6).fit(ready)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        out = best.transform(df.withColumn("_features", array_to_vector(vector))).drop("_features")
        return out, float(best.summary.trainingCost), [c.tolist() for c in best.clusterCenters()]
    finally:
        ready.unpersist()


def lloyd_step(df: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(node, dim, value): centres (node, w) after one step."""
    won = df.join(assign(df, key, vector, centres), key)
    return won.select("node", F.posexplode(vector).alias("dim", "v")).groupBy("node", "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))


def renumber(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """Clusters numbered from 1 by ascending mean score, ties by the old number."""
    order = df.groupBy(cluster).agg(F.avg(score).alias("_s")).withColumn("_n", F.row_number().over(Window.orderBy("_s", cluster)))
    return df.join(F.broadcast(order.drop("_s")), cluster).drop(cluster).withColumnRenamed("_n", cluster)


def sweep(df: DataFrame, vector: str, ks: range, label: str | None = None, restarts: int = RESTARTS, key: str | None = None) -> list[dict]:
    """One row of diagnostics for each k: within sum, share between, drop, smallest cluster, least centre distance, agreement with a label, and
    with a key the silhouette."""
    centre = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col(vector)[i]) for i in range(len(df.first()[vector]))]).alias("c"))
    n, c = centre.first()
    total = df.crossJoin(F.broadcast(centre.select("c"))).agg(F.sum(euclidean(F.col(vector), F.col("c")) ** 2.0)).first()[0]
    out: list[dict] = []
    for k in ks:
        done, wss, centres = kmeans(df, vector, k, restarts=restarts)
        sizes = [r["count"] for r in done.groupBy("cluster").count().collect()]
        gaps = [float(np.linalg.norm(np.subtract(a, b))) for i, a in enumerate(centres) for b in centres[i + 1 :]]
        out.append({
            "k": k, "wss": wss, "bss_over_tss": 1 - wss / total, "smallest_cluster_pct": 100.0 * min(sizes) / n, "min_centroid_distance": min(gaps),
            "ari_vs_label": adjusted_rand(done.where(F.col(label).isNotNull()), "cluster", label).first()[0] if label else None,
            "wss_drop_pct": 100.0 * (out[-1]["wss"] - wss) / out[-1]["wss"] if out else None,
            "silhouette": silhouette(done, key, vector, "cluster").first()[0] if key else None,
        })
    return out


def stability(df: DataFrame, key: str, vector: str, k: int, seeds: list[int], base_seed: int = 42, restarts: int = RESTARTS) -> list[float]:
    """Adjusted Rand index of each seed's clusters against the base seed's."""
    base = kmeans(df, vector, k, base_seed, restarts)[0].select(key, F.col("cluster").alias("base"))
    return [adjusted_rand(kmeans(df, vector, k, s, restarts)[0].select(key, "cluster").join(base, key), "cluster", "base").first()[0] for s in seeds]


def silhouette(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(silhouette): the mean over all rows, each measured against every row of another key. Distances of all pairs are worked out, but none is kept:
    rows are dealt into groups by a hash of the key, a task gets two groups (each pair of groups once) and sends on a sum a row and cluster. So memory
    is bounded by GROUP_ROWS, and only the time is quadratic. Rows without cluster count as 0; a table of clusters is held, not of rows."""
    spark = df.sparkSession
    named = {f.name: f.dataType for f in df.schema}
    rows = df.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL")
    sizes = rows.where("c IS NOT NULL AND v IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()
    n, many = sum(r.n for r in sizes), len(sizes)
    place = spark.createDataFrame([(r.c, i) for i, r in enumerate(sizes)], StructType([StructField("c", named[cluster]), StructField("i", IntegerType())]))
    groups = max(-(-n // GROUP_ROWS), 1 if n <= SMALL_ROWS else LEAST_GROUPS)
    own = F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int")
    dealt = rows.where("v IS NOT NULL").join(F.broadcast(place), "c").select("k", "i", "v", own.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"))
    # a row that meets a later group is the first side, one that meets an earlier group the second
    dealt = dealt.select("k", "i", "v", (F.least("g", "h") * groups + F.greatest("g", "h")).alias("task"), (F.col("g") == F.col("h")).alias("same"), (F.col("g") > F.col("h")).alias("second"))
    schema = StructType([StructField("k", named[key]), StructField("i", IntegerType()), StructField("d", ArrayType(DoubleType())), StructField("n", ArrayType(LongType()))])

    def meet(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy(zero_copy_only=False)
        sides = [table] if table["same"][0].as_py() else [table.filter(pa.array(x)) for x in (~second, second)]
        out = _met(table, table, many)[:1] if len(sides) == 1 else _met(*sides, many)
        made = [pa.table([s["k"], s["i"], _lists(d), _lists(m)], names=["k", "i", "d", "n"]) for s, (d, m) in zip(sides, out, strict=True)]
        return pa.concat_tables(made)

    met = dealt.repartition(groups * (groups + 1), "task").groupBy("task").applyInArrow(meet, schema)
    per = met.groupBy("k", "i").agg(*[F.sum(F.col(x)[j]).alias(f"{x}{j}") for x in "dn" for j in range(many)])
    mean = F.array(*[F.when(F.col(f"n{j}") > 0, F.col(f"d{j}") / F.col(f"n{j}")).cast("double") for j in range(many)]).cast("array<double>")
    per = per.select("k", "i", mean.alias("m")).select("k", F.get("m", F.col("i")).alias("a"), F.array_min(F.transform("m", lambda x, j: F.when(j != F.col("i"), x))).alias("b"))
    bare = rows.where("c IS NULL OR v IS NULL").select("k", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    both = per.unionAll(bare).groupBy("k").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    most = F.greatest("a", "b")
    width = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(most == 0, float("nan")).otherwise((F.col("b") - F.col("a")) / most)
    return both.select(width.alias("s")).agg(F.when(F.count(F.lit(1)) > 1, F.avg("s")).alias("silhouette"))


def _lists(values: np.ndarray) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k) if k else np.zeros(n + 1, int), pa.int32()), pa.array(values.ravel()))


def _met(a: pa.Table, b: pa.Table, many: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the rows of a, then for those of b: the sum of the distances to the rows of the other side by cluster, and how many they are. If both
    sides are one table, rows of the same key are left out; else no key is on both sides."""
    if not len(a) or not len(b):
        return [(np.zeros((len(t), many)), np.zeros((len(t), many), int)) for t in (a, b)]
    x, y = ((v := t["v"].combine_chunks()).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for t in (a, b))
    middle = x.mean(0)
    x, y = x - middle, y - middle
    hot = [np.eye(many)[t["i"].to_numpy()] for t in (a, b)]
    # one product gives the squares; what is left of a square of 0 by rounding goes below 0
    xx, yy = ((z * z).sum(1) * (1 - ROUNDING) for z in (x, y))
    right = np.ascontiguousarray(np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], 1).T)
    of_x, of_y = np.zeros((len(x), many)), np.zeros((len(y), many))
    for s in range(0, len(x), 256):
        left = np.concatenate([-2 * x[s : s + 256], xx[s : s + 256, None], np.ones((len(x[s : s + 256]), 1))], 1)
        for e in range(0, len(y), 2048):
            d = left @ right[:, e : e + 2048]
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            of_x[s : s + 256] += d @ hot[1][e : e + 2048]
            if a is not b:
                of_y[e : e + 2048] += d.T @ hot[0][s : s + 256]
    counts = [np.tile(h.sum(0).astype(int), (len(t), 1)) for h, t in ((hot[1], x), (hot[0], y))]
    if a is b:
        code = a["k"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(code, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            counts[0][same] -= hot[0][same].sum(0).astype(int)
            if len(same) > 1:
                for r in same:
                    of_x[r] -= np.sqrt(np.maximum(((x[same] - x[r]) ** 2).sum(1), 0)) @ hot[0][same]
    return [(of_x, counts[0]), (of_y, counts[1])]


def linkage(points: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows (a, b, height, size) of an agglomerative tree by Lance-Williams updates; new nodes are numbered from n. LINKAGE_ROWS points at most."""
    x = np.asarray(points, float)
    n = len(x)
    if n > LINKAGE_ROWS:
        raise ValueError(f"linkage takes {LINKAGE_ROWS} points at most; sample first")
    if method not in ("single", "complete", "average", "centroid"):
        raise ValueError(f"unknown linkage {method}")
    square = method == "centroid"
    d = ((x[:, None] - x[None]) ** 2).sum(-1) if n * n * x.shape[1] < 5e7 else np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    d = d if square else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), np.arange(n), np.zeros((max(n - 1, 0), 4))
    nearest = d.argmin(1) if n > 1 else None
    alive = np.ones(n, bool)
    for step in range(n - 1):
        live = np.flatnonzero(alive)
        i = live[np.argmin(d[live, nearest[live]])]
        j = nearest[i]
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b = sorted((name[i], name[j]))
        out[step] = a, b, np.sqrt(h) if square else h, size[i] + size[j]
        ni, nj = size[i], size[j]
        if method == "single":
            row = np.minimum(d[i], d[j])
        elif method == "complete":
            row = np.maximum(d[i], d[j])
        elif method == "average":
            row = (ni * d[i] + nj * d[j]) / (ni + nj)
        else:
            row = (ni * d[i] + nj * d[j]) / (ni + nj) - ni * nj * h / (ni + nj) ** 2
        row[~alive] = np.inf
        alive[j] = False
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i] = ni + nj, n + step
        # rows whose nearest was merged, or that the merged one is now nearest to
        live = np.flatnonzero(alive)
        again = (nearest[live] == i) | (nearest[live] == j) | (live == i)
        rest, again = live[~again], live[again]
        nearest[rest[d[rest, i] < d[rest, nearest[rest]]]] = i
        nearest[again] = d[again].argmin(1)
    return out


def inversions(tree: np.ndarray) -> int:
    """Merges lower than the one before."""
    return int((np.diff(tree[:, 2]) < 0).sum())


def cut(tree: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers 0 to k - 1, in order of first members, after the first n - k merges."""
    n = len(tree) + 1
    parent = np.arange(2 * n - 1)
    for step in range(n - k):
        parent[int(tree[step, 0])] = parent[int(tree[step, 1])] = n + step
    roots = []
    for leaf in range(n):
        at = leaf
        while parent[at] != at:
            at = parent[at]
        roots.append(at)
    number: dict[int, int] = {}
    return np.array([number.setdefault(r, len(number)) for r in roots])


def propagate(assigned: DataFrame, node_clusters: DataFrame) -> DataFrame:
    """Rows take their node's cluster; the node table is broadcast."""
    return assigned.join(F.broadcast(node_clusters.select("node", "cluster")), "node", "left")


def profile(df: DataFrame, cluster: str, medians: list[str], shares: list[str], label: str, trusted: str) -> DataFrame:
    """One row a cluster: size, share of all, medians, shares in percent, label shares over all labelled and over trusted rows."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(label).isNotNull()
    per = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.median(c).alias(f"median_{c}") for c in medians],
        *[(100.0 * F.avg(F.col(c).cast("double"))).alias(f"{c}_pct") for c in shares],
        F.count_if(known).alias("n_labelled"),
        F.avg(F.when(known, F.col(label).cast("double"))).alias("minority_share"),
        F.avg(F.when(known & F.col(trusted), F.col(label).cast("double"))).alias("minority_share_trusted"),
    )
    return per.crossJoin(F.broadcast(total)).withColumn("share_pct", 100.0 * F.col("n") / F.col("_n")).drop("_n")


def principal(df: DataFrame, vector: str, k: int) -> DataFrame:
    """(component, variance_share, dimension, loading): of the first k axes of the centred vectors, the dimensions by absolute loading. An axis
    is turned so that its greatest loading is positive."""
    spark = df.sparkSession
    # the covariance is a table of dimensions by dimensions, whatever the rows
    n = len(df.select(vector).first()[0])
    x = [F.col(vector)[i] for i in range(n)]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], F.count(F.lit(1)).alias("n")).first()
    centred = F.transform(vector, lambda v, i: v - F.get(F.array(*[F.lit(means[f"m{j}"]) for j in range(n)]), i))
    outer = df.select(centred.alias("v")).select(F.posexplode("v").alias("i", "a"), "v")
    sums = outer.groupBy("i").agg(*[F.sum(F.col("a") * F.col("v")[j]).alias(f"c{j}") for j in range(n)])
    cov = np.zeros((n, n))
    for r in sums.collect():
        cov[r.i] = [r[f"c{j}"] for j in range(n)]
    values, axes = np.linalg.eigh(cov / max(1, means["n"] - 1))
    out = []
    for rank in range(k):
        axis = axes[:, -1 - rank]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        out += [(rank + 1, float(values[-1 - rank] / values.sum()), int(d), float(axis[d])) for d in np.argsort(-np.abs(axis), kind="stable")]
    return spark.createDataFrame(out, "component int, variance_share double, dimension int, loading double")
