import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelsift.operators import classify, cluster, entity, rules, sampling, som, stats, vote
from labelsift.plans import analytics, models
from labelsift.sources import files
from labelsift.plans import profiles


def table_of(spark, counts):
    rows = [(i, j) for i, line in enumerate(counts) for j, n in enumerate(line) for _ in range(n // 10)]
    return spark.createDataFrame(rows, "a int, b int")


def test_adjusted_rand_of_published_table(spark):
    # fixed values: a published contingency of four clusters by brand, female, male, and the indices that belong to it
    cells = [(971, 2922, 2864), (831, 1558, 1091), (1556, 730, 661), (2053, 1143, 1298)]
    df = spark.createDataFrame([(i, j, n) for i, line in enumerate(cells) for j, n in enumerate(line)], "a int, b int, n int").select("a", "b", F.explode(F.sequence(F.lit(1), "n")))
    assert round(stats.adjusted_rand(df, "a", "b").first().ari, 4) == 0.0537
    assert round(stats.adjusted_rand(df.withColumn("b", (F.col("b") > 0).cast("int")), "a", "b").first().ari, 4) == 0.0817


@pytest.mark.parametrize("rows,chi2", [([(111, 83), (1259, 423), (2089, 368)], 255.1), ([(222, 33), (1413, 201), (6384, 657)], 21.4)])
def test_chi_square_of_published_votes(spark, rows, chi2):
    df = spark.createDataFrame([(i, side, float(n)) for i, (voted, no) in enumerate(rows) for side, n in (("no", no), ("yes", voted - no))], "bin int, side string, n double")
    got = stats.chi_square_of(df, "bin", "side").first()
    assert (round(got.chi2, 1), got.dof) == (chi2, 2)


METRICS = {
    "euclidean": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5,
    "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)),
    "chebyshev": lambda a, b: max(abs(x - y) for x, y in zip(a, b)),
    "cosine": lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5),
}


@pytest.mark.parametrize("distance", sorted(METRICS))
@pytest.mark.parametrize("rows,columns", [(4, 3), (1, 6), (3, 7)])
def test_map_measures_by_double_loops(rows, columns, distance):
    """Winners, hits and errors of random maps, each node looked at by itself."""
    rng = np.random.default_rng(rows * columns)
    m = som.Som(rows, columns, 3, distance=distance)
    m.weights = rng.normal(size=(rows, columns, 3)) + 2
    data = rng.normal(size=(40, 3)) + 2
    nodes = [(i, j) for i in range(rows) for j in range(columns)]
    far = METRICS[distance]
    best = [min(nodes, key=lambda n: far(x, m.weights[n])) for x in data]
    assert [m.winner(x) for x in data] == best
    assert {n: k for n in nodes if (k := m.hits(data)[n])} == {n: best.count(n) for n in set(best)}
    names = [f"r{k}" for k in range(len(data))]
    assert m.won(data, names) == {n: [names[k] for k, w in enumerate(best) if w == n] for n in set(best)}
    plain = METRICS["euclidean"]
    assert np.isclose(m.quantization_error(data), np.mean([plain(x, m.weights[n]) for x, n in zip(data, best)]))
    apart = 0
    for x in data:
        first, second = sorted(nodes, key=lambda n: plain(x, m.weights[n]))[:2]
        apart += max(abs(first[0] - second[0]), abs(first[1] - second[1])) > 1
        assert np.allclose(m.quantization([x])[0], m.weights[first])
    assert np.isclose(m.topographic_error(data), apart / len(data))


def test_map_neighbourhoods_by_definition():
    centre, sigma = (3, 2), 1.7
    for kind in som.NEIGHBOURHOODS:
        got = som.Som(6, 5, 2, neighbourhood=kind).influence(centre, sigma)
        for i in range(6):
            for j in range(5):
                a, b = abs(i - centre[0]), abs(j - centre[1])
                u = (a * a + b * b) / (2 * sigma**2)
                want = {"gaussian": np.exp(-u), "mexican_hat": np.exp(-u) * (1 - 2 * u), "bubble": float(a < sigma and b < sigma), "triangle": max(0, sigma - a) * max(0, sigma - b)}
                assert np.isclose(got[i, j], want[kind])


@pytest.mark.parametrize("topology", ["rectangular", "hexagonal"])
def test_map_borders_by_places(topology):
    """A node's neighbours are those one step away in the plane: eight on a square grid, six where every second line is shifted."""
    rng = np.random.default_rng(9)
    m = som.Som(4, 5, 2, topology=topology)
    m.weights = rng.normal(size=(4, 5, 2))
    nodes = [(i, j) for i in range(4) for j in range(5)]

    def near(n, o):
        gap = np.abs(m.place[n] - m.place[o])
        return n != o and (gap.max() <= 1 if topology == "rectangular" else gap[1] <= 1 and gap[0] <= (0.5 if gap[1] else 1))

    for scaling, merge in (("sum", sum), ("mean", np.mean)):
        want = np.array([[merge([METRICS["euclidean"](m.weights[i, j], m.weights[o]) for o in nodes if near((i, j), o)]) for j in range(5)] for i in range(4)])
        assert np.allclose(m.u_matrix(scaling), want / want.max())


def test_map_training_is_repeatable_and_gets_nearer():
    data = np.random.default_rng(4).uniform(size=(150, 3))
    maps = [som.Som(4, 6, 3, sigma=2.5, seed=8) for _ in range(2)]
    for m in maps:
        m.start_from_axes(data)
    before = maps[0].quantization_error(data)
    for m in maps:
        m.train(data, 900, shuffled=True)
    assert np.array_equal(maps[0].weights, maps[1].weights) and maps[0].quantization_error(data) < 0.7 * before
    # the start lies in the plane of the two widest axes, its corners at plus and minus their sum
    wide = np.random.default_rng(5).normal(size=(400, 3)) * [9, 3, 0.1]
    m = som.Som(3, 3, 3)
    m.start_from_axes(wide)
    axes = np.linalg.svd(wide - wide.mean(0))[2]
    assert np.allclose(np.abs(m.weights[0, 0] @ axes.T), [1, 1, 0], atol=1e-6) and np.allclose(m.weights[1, 1], 0)


def test_map_refuses_what_it_does_not_know():
    for bad in (dict(neighbourhood="square"), dict(distance="cubic"), dict(topology="round")):
        with pytest.raises(ValueError):
            som.Som(2, 2, 2, **bad)
    m = som.Som(2, 3, 4)
    for call in (lambda: m.train([[0.0] * 3], 5), lambda: m.train([[0.0] * 4], 0), lambda: m.won([[0.0] * 4], []), lambda: som.Som(2, 2, 1).start_from_axes([[1.0], [2.0]])):
        with pytest.raises(ValueError):
            call()


def test_som_plans_match_numpy(spark):
    m = som.Som(4, 4, 2, sigma=2, seed=3)
    data = np.random.RandomState(5).rand(60, 2)
    m.train(data, 300, shuffled=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id int, v array<double>")
    won = {r.id: r.node for r in som.assign(df, "id", "v", m.frame(spark)).collect()}
    assert won == {i: int(np.ravel_multi_index(m.winner(x), (4, 4))) for i, x in enumerate(data)}
    q = som.map_quality(df, "id", "v", m.frame(spark)).first()
    assert np.isclose(q.quantization_error, m.quantization_error(data)) and np.isclose(q.topographic_error, m.topographic_error(data))
    batch = som.train_batch(df, "v", som.Som(4, 4, 2, sigma=2, seed=3), 5)
    assert batch.quantization_error(data) < 0.3


def test_naive_bayes_takes_the_whole_vocabulary(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(f"t{k:04d}x" for k in range(600)), i % 2) for i in range(6)], "doc_id long, text string, quality int")
    monkeypatch.setattr(analytics, "profile_vectors", lambda *_: rows)
    seen, vectors = [], classify.vectors
    monkeypatch.setattr(classify, "vectors", lambda *a: (seen.append(vectors(*a)), seen[-1])[1])
    assert analytics.QUERIES["ml_nb"][0](spark, "").count() == 6 and len(seen[0][1]) == 600


def test_silhouette_takes_every_row(spark, monkeypatch):
    x, label = np.random.RandomState(1).rand(360, 3), np.arange(360) % 3
    rows = spark.createDataFrame([(i, int(label[i]), v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, v array<double>")
    monkeypatch.setattr(analytics, "vectors", lambda *_: rows)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    widths = []
    for i in range(360):
        mean = [gaps[i, (label == k) & (np.arange(360) != i)].mean() for k in range(3)]
        a, b = mean[label[i]], min(mean[k] for k in range(3) if k != label[i])
        widths.append((b - a) / max(a, b))
    assert analytics.QUERIES["ml_silhouette"][0](spark, "").first().silhouette == pytest.approx(np.mean(widths), abs=1e-6)


def test_registered_maps_take_all_rows_and_values(spark, monkeypatch):
    x = np.random.RandomState(0).rand(2100, 64)
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, v array<double>")
    monkeypatch.setattr(analytics, "vectors", lambda *_: rows)
    seen, train = [], som.Som.train
    monkeypatch.setattr(som.Som, "train", lambda self, data, steps, shuffled=False: (seen.append((data.copy(), steps)), train(self, data, steps, shuffled))[1])
    m, _ = analytics.small_map(spark, "")
    assert m.n_features == 64 and np.allclose(seen[0][0], x) and seen[0][1] == 10 * len(x)
    want = np.sqrt(((x[:, None] - m.weights.reshape(-1, 64)) ** 2).sum(-1)).min(1).mean()
    assert som.map_quality(rows, "vec_id", "v", m.frame(spark)).first().quantization_error == pytest.approx(want)
    monkeypatch.setattr(analytics, "TRAIN_ROWS", 100)
    batch, counted = som.train_batch, []
    monkeypatch.setattr(som, "train_batch", lambda df, *a: (counted.append(df.count()), batch(df, a[0], a[1], 1))[1])
    assert analytics.small_map(spark, "")[0].n_features == 64 and counted == [2100]
    monkeypatch.setattr(analytics, "TRAIN_ROWS", 5000)
    monkeypatch.setattr(cluster, "LINKAGE_ROWS", 90)
    got = analytics.QUERIES["ml_linkage"][0](spark, "")
    sizes = {(r.points, r.linkage): r["count"] for r in got.groupBy("points", "linkage").count().collect()}
    assert len(sizes) == 8 and all(n == 35 if p == "prototypes" else 80 <= n < 90 for (p, _), n in sizes.items())


@pytest.mark.parametrize("method", ["single", "complete", "average", "centroid"])
def test_linkage_against_brute_force(method):
    x = np.random.RandomState(2).rand(12, 2)
    tree = cluster.linkage(x, method)
    groups = {i: [i] for i in range(12)}
    for step, (a, b, h, n) in enumerate(tree):
        def gap(p, q):
            d = np.linalg.norm(x[groups[p]][:, None] - x[groups[q]][None], axis=-1)
            return {"single": d.min(), "complete": d.max(), "average": d.mean(), "centroid": np.linalg.norm(x[groups[p]].mean(0) - x[groups[q]].mean(0))}[method]
        names = sorted(groups)
        best = min(gap(p, q) for i, p in enumerate(names) for q in names[i + 1 :])
        assert np.isclose(h, best) and np.isclose(gap(int(a), int(b)), best)
        groups[12 + step] = groups.pop(int(a)) + groups.pop(int(b))
        assert n == len(groups[12 + step])
    labels = cluster.cut(tree, 3)
    assert sorted(set(labels)) == [0, 1, 2]


def test_logistic_against_newton(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.RandomState(0)
    x = rng.randn(200, 2)
    y = (x @ [1.5, -1] + rng.randn(200) > 0.4).astype(int)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y)], "a double, b double, y int"))
    model = classify.logistic(df, "y")
    w, weight, full = np.zeros(3), np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum()))), np.c_[x, np.ones(200)]
    ridge = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve((full.T * (weight * p * (1 - p))) @ full + ridge, full.T @ (weight * (p - y)) + ridge @ w)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-4)
    assert classify.eliminate(df.withColumn("noise", F.lit(0.0) + F.col("a") * 1e-6), "y", ["a", "b", "noise"], 2) == ["a", "b"]


def test_folds_and_splits(spark):
    df = spark.range(500).withColumn("s", (F.col("id") % 5 == 0).cast("int"))
    sizes = {(r.s, r.fold): r["count"] for r in sampling.folds(df, "id", 5, 42, ["s"]).groupBy("s", "fold").count().collect()}
    assert set(sizes.values()) == {80, 20}
    parts = {(r.s, r.part): r["count"] for r in sampling.split(df, "id", 0.3, 42, ["s"]).groupBy("s", "part").count().collect()}
    assert parts == {(0, "test"): 120, (0, "train"): 280, (1, "test"): 30, (1, "train"): 70}


def test_vote(spark):
    df = spark.createDataFrame([(i, "g" if i < 30 else "h", int(i < 25)) for i in range(90)] + [(90, "g", None)], "id int, grp string, y int")
    got = {r.id: r.vote for r in vote.lift_vote(df, "grp", F.col("y") == 1, F.col("y").isNotNull()).collect()}
    assert got[0] == 1 and got[29] == 1 and got[90] == 1 and got[60] == 0


def test_rules(spark):
    df = spark.createDataFrame([(i, ["a", "x"] if i % 4 else ["a", "b", "y"], i % 2) for i in range(40)], "id int, items array<string>, l int")
    _, model = rules.itemsets(df, "items", 0.05)
    got = {(r.lhs, r.label): r.confidence for r in rules.label_rules(model, ["x", "y"]).collect()}
    assert got[("b", "y")] == 1.0 and not any("x" in lhs.split(", ") or "y" in lhs.split(", ") for lhs, _ in got)


def raw_rows():
    base = dict(profile_yn="yes", fav_number=3, retweet_count=0, tweet_count=10, tweet_created="10/26/15 12:00", description="hi &amp;amp; see http://x.y", text="@me #now", link_color="0084B4", sidebar_color="9999")
    base |= {"gender:confidence": 1.0}
    people = [
        ("ann", "1/1/10 0:00", "female", 1.0, {}), ("ann", "1/1/10 0:00", "female", 0.6, {"fav_number": 9}), ("bo", "2/1/10 0:00", "brand", 0.7, {}), ("bo", "2/1/10 0:00", "male", 0.7, {}),
        ("cy", "3/1/10 0:00", "male", 0.5, {}), ("cy", "3/1/10 0:00", "female", 1.0, {}), ("di", "4/1/10 0:00", "unknown", 1.0, {}), ("ed", "bad date", "male", 1.0, {"profile_yn": "no", "gender": None}),
        (None, "5/1/10 0:00", "brand", 1.0, {"description": None, "link_color": "2.21E+09", "sidebar_color": "0"}), ("fi", "10/26/15 12:00", "male", 1.0, {"text": 'two\nlines "quoted"', "tweet_count": 0}), ("NA", "6/1/10 0:00", "male", 0.3, {"description": "null"}),
    ]
    return [{**base, "_unit_id": i, "name": n, "created": c, "gender": g, "gender:confidence": conf, **more} for i, (n, c, g, conf, more) in enumerate(people)]


def test_profile_pipeline(spark, tmp_path):
    import csv

    with open(tmp_path / "raw.csv", "w", encoding="latin-1", newline="") as f:
        w = csv.DictWriter(f, files.RAW_COLUMNS, restval="", quoting=csv.QUOTE_ALL)
        w.writeheader()
        w.writerows({k: "" if v is None else v for k, v in r.items()} for r in raw_rows())
    raw = files.read_raw(spark, str(tmp_path / "raw.csv"))
    prepared = profiles.prepare(raw).cache()
    rows = {r.unit_id: r for r in prepared.collect()}
    assert len(prepared.drop("_row_id").columns) == 55
    assert 7 not in rows and len(rows) == 10
    assert rows[8].account_id == "nan|5/1/10 0:00" and rows[10].account_id == "nan|6/1/10 0:00"
    assert rows[0].n_rows_for_account == 2 and rows[2].label_conflict_human_brand == 1 and rows[4].label_conflict_human_brand == 0 and rows[4].label_conflict_gender == 1
    assert rows[0].description_clean == "hi & see URLTOKEN" and rows[8].has_description == 0 and rows[8].link_color_hex == "221E07" and rows[8].sidebar_color_zero_suspect == 1
    assert rows[9].account_age_days == 0 and rows[9].tweets_per_day == 0 and rows[9].tweet_raw == 'two\nlines "quoted"'
    table = profiles.accounts(prepared)
    best = {r.account_id: r for r in table.collect()}
    assert best["ann|1/1/10 0:00"].unit_id == 0 and best["ann|1/1/10 0:00"].fav_number == 9 and best["bo|2/1/10 0:00"].unit_id == 2
    assert all(r.ok for r in profiles.assertions(prepared, table).collect())
    assert {r.account_id for r in profiles.label_conflicts(prepared).collect()} == {"bo|2/1/10 0:00", "cy|3/1/10 0:00"}
    files.export_csv(table.drop("_row_id"), str(tmp_path / "out"), single=True)
    files.write_table(table, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).count() == len(best)
    with pytest.raises(FileNotFoundError):
        files.read_raw(spark, str(tmp_path / "none.csv"))


def test_streams(spark, tmp_path):
    from labelsift.streaming import clean

    spark.createDataFrame([("a", "1/1/10 0:00", "see http://x", "2015-01-01 00:00:00"), ("a", "1/1/10 0:00", "again", "2015-01-01 00:01:00"), ("b", "1/1/10 0:00", "x", "2015-01-01 00:02:00")], "name string, created string, text string, at string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, created string, text string, at string").parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    for name, df in (("cleaned", clean.cleaned(stream)), ("firsts", clean.first_judgements(stream, "name", "created", "at"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("cleaned").where("message_clean = 'see URLTOKEN'").count() == 1
    assert spark.table("firsts").count() == 2


def test_chi_square_p(spark):
    """Against published critical values of 5 % and 1 %."""
    critical = [(1, 3.841459, 0.05), (2, 5.991465, 0.05), (3, 7.814728, 0.05), (8, 15.507313, 0.05), (15, 24.995790, 0.05), (1, 6.634897, 0.01), (10, 23.209251, 0.01)]
    rows = spark.createDataFrame([(x, d, p) for d, x, p in critical] + [(0.0, 3, 1.0)], "x double, dof long, p double")
    for r in rows.select("p", stats.chi_square_p(F.col("x"), F.col("dof")).alias("got")).collect():
        assert abs(r.p - r.got) < 1e-7


def test_principal_axes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [5, 1, 0.5, 0.1] + [9, 9, 9, 9]
    rows = cluster.principal(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", 2).collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    for rank in (1, 2):
        own = sorted((r for r in rows if r.component == rank), key=lambda r: r.dimension)
        assert np.isclose(own[0].variance_share, values[-rank] / values.sum())
        assert np.isclose(abs(np.dot([r.loading for r in own], axes[:, -rank])), 1)


def test_consensus_disagreement_and_strong_rules(spark):
    rows = [(i, float(i % 2), p) for i, p in enumerate([0.05, 0.1, 0.9, 0.02, 0.2, 0.95])]
    scored = spark.createDataFrame([(i, y, p, p) for i, y, p in rows], "id int, y double, p_a double, p_b double")
    flagged = {r.id for r in classify.consensus_flags(scored, "y", ["p_a", "p_b"]).where("flagged = 1").collect()}
    assert flagged == {i for i, y, p in rows if (p if y else 1 - p) <= 0.2}
    assert {r.id for r in classify.disagreement(scored, "y", "p_a").collect()} == {i for i, y, p in rows if abs(y - p) >= 0.85}
    held = spark.createDataFrame([("a", "x", 6.5, 0.9), ("b", "x", 6.5, 0.7), ("c", "brand", 1.6, 0.85), ("d", "human", 1.6, 0.85)], "lhs string, label string, lift double, confidence double")
    assert [r.lhs for r in rules.strong(held).collect()] == ["a"] and [r.lhs for r in rules.strong(held, "brand").collect()] == ["c"]
    assert rules.strong(held, "human").count() == 0


def test_ranks_scores_and_groups_against_plain_python(spark):
    """Ranks in ranges, sums over score ranges and leave-one-out, with null groups, ties and repeated rows."""
    rows = [(i if i % 11 else None, "ab"[i % 2] if i % 5 else None, float(i * 7 % 23), int(i * 5 % 3 == 0)) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "id long, g string, score double, y int").repartition(5)
    got = sampling.ranked(df, "id", 42, ["g"]).collect()
    for g in ("a", "b", None):
        own = sorted((hashlib.md5(f"{i}|42".encode()).hexdigest(), i) for i, x, *_ in rows if x == g and i is not None)
        nulls = sum(x == g and i is None for i, x, *_ in rows)
        ranks = sorted((r._rank, r.id) for r in got if r.g == g)
        assert [i for _, i in ranks] == [None] * nulls + [i for _, i in own] and [k for k, _ in ranks] == list(range(1, len(ranks) + 1))
        assert {r._size for r in got if r.g == g} == {len(ranks)}
    pos, neg = [s for _, _, s, y in rows if y], [s for _, _, s, y in rows if not y]
    wanted = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(stats.auc(df, "score", "y").first().auc - wanted) < 1e-12
    curve = {r.threshold: (r.fpr, r.tpr) for r in stats.roc(df, "score", "y").collect()}
    assert curve == {t: pytest.approx((sum(x >= t for x in neg) / len(neg), sum(x >= t for x in pos) / len(pos))) for t in {s for _, _, s, _ in rows}}
    for r in entity.leave_one_out(df, "g", F.col("y") == 1, F.col("score") > 5).collect():
        others = [(s, y) for _, x, s, y in rows if x == r.g]
        assert r.others_n == sum(s > 5 for s, _ in others) - (r.score > 5) and r.others_hits == sum(s > 5 and y for s, y in others) - (r.score > 5 and r.y)


def test_kmeans_and_its_diagnostics(spark):
    """Four far groups are found whole; every figure of the sweep is worked out again from the assignment."""
    rng = np.random.default_rng(11)
    middles = np.array([[0, 0], [50, 0], [0, 50], [60, 60]], float)
    x = np.concatenate([m + rng.normal(size=(n, 2)) for m, n in zip(middles, (30, 40, 50, 60))])
    own = np.repeat(range(4), (30, 40, 50, 60))
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, own))], "id int, v array<double>, g int")
    done, wss, centres = cluster.kmeans(df, "v", 4, restarts=3)
    got = np.array([r.cluster for r in done.orderBy("id").collect()])
    assert all(len(set(got[own == g])) == 1 for g in range(4)) and len(set(got)) == 4
    assert np.isclose(wss, sum(((x[own == g] - x[own == g].mean(0)) ** 2).sum() for g in range(4)))
    assert np.allclose(sorted(c[0] + 2 * c[1] for c in centres), sorted((x[own == g].mean(0) @ [1, 2]) for g in range(4)))
    rows = cluster.sweep(df, "v", range(3, 5), "g", restarts=3, key="id")
    total = ((x - x.mean(0)) ** 2).sum()
    assert np.isclose(rows[1]["bss_over_tss"], 1 - wss / total) and np.isclose(rows[1]["wss_drop_pct"], 100 * (1 - wss / rows[0]["wss"]))
    assert np.isclose(rows[1]["smallest_cluster_pct"], 100 * 30 / 180) and rows[1]["ari_vs_label"] == 1 and rows[0]["ari_vs_label"] < 1
    gaps = np.linalg.norm(x[:, None] - x[None], axis=-1)
    widths = []
    for i in range(len(x)):
        mean = [gaps[i, (own == g) & (np.arange(len(x)) != i)].mean() for g in range(4)]
        a, b = mean[own[i]], min(m for g, m in enumerate(mean) if g != own[i])
        widths.append((b - a) / max(a, b))
    assert np.isclose(rows[1]["silhouette"], np.mean(widths))
    assert cluster.stability(df, "id", "v", 4, seeds=[1, 2], restarts=3) == [1.0, 1.0]


def test_silhouette_has_no_sample_and_counts_keys_as_its_sql(spark, monkeypatch):
    """Against the SQL over more rows than a sample had and over groups; null and repeated keys, rows without label, copies, empty groups."""
    import duckdb

    rng = np.random.RandomState(7)

    def both(rows):
        monkeypatch.setattr(analytics, "vectors", lambda *_: spark.createDataFrame(rows, "vec_id long, label int, v array<double>"))
        con = duckdb.connect()
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INT, embedding DOUBLE[])")
        con.register("given", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "embedding": [r[2] for r in rows]}))
        con.execute("INSERT INTO embeddings FROM given")
        got, want = analytics.QUERIES["ml_silhouette"][0](spark, "").first()[0], con.execute(analytics.QUERIES["ml_silhouette"][1]).fetchone()[0]
        assert (got is None and want is None) or got == pytest.approx(want, abs=1e-6, nan_ok=True)

    plain = [(i, i % 3, (rng.rand(2) + i % 3 * (0.1 if i < 4000 else 0.9)).tolist()) for i in range(8600)]
    both(plain)
    odd = plain[:300] + [(None, 1, [1.0] * 2), (5, None, [2.0] * 2), (7, 1, [0.5] * 2), (8, 2, [0.1] * 2), (8, 2, [0.1] * 2), (901, 4, [0.3] * 2)]
    for rows in (odd, plain[:1], [(i, i % 2, [1.0, 2.0]) for i in range(6)]):
        both(rows)
    monkeypatch.setattr(cluster, "SMALL_ROWS", 2)
    monkeypatch.setattr(cluster, "GROUP_ROWS", 100)
    both(odd)
    both(plain[:3])


def test_large_maps_start_from_all_rows_and_learn_by_the_batch_rule(spark, monkeypatch):
    """Beyond TRAIN_ROWS the axes are those of every row, none of a sample, and each epoch is worked out again in numpy."""
    x = np.random.RandomState(3).rand(700, 5) * [9, 5, 1, 1, 1]
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, v array<double>").repartition(5)
    assert np.allclose(som.covariance(rows, "v"), np.cov(x.T))
    monkeypatch.setattr(analytics, "vectors", lambda *_: rows)
    monkeypatch.setattr(analytics, "TRAIN_ROWS", 100)
    monkeypatch.setattr(sampling, "sample", None)
    want = som.Som(6, 6, 5, sigma=3.0, seed=42)
    want.start_from_axes(x)
    for t in range(analytics.PASSES):
        pull = np.array([want.influence(want.winner(v), 1 + 2 * (analytics.PASSES - t) / analytics.PASSES) for v in x])
        want.weights = np.einsum("nij,nk->ijk", pull, x) / pull.sum(0)[..., None]
    got = analytics.small_map(spark, "")[0].weights
    assert np.allclose(got, want.weights) or np.allclose(np.sort(got, None), np.sort(want.weights, None))  # an axis may be turned
    nodes = want.frame(spark)
    near = som.assign(spark.createDataFrame([(1, x[0].tolist()), (2, None)], "id int, v array<double>"), "id", "v", nodes, 40).collect()
    gaps = np.linalg.norm(want.weights.reshape(-1, 5) - x[0], axis=1)
    assert [r.node for r in near if r.id == 1] == np.argsort(gaps, kind="stable").tolist() and [r.node for r in near if r.id == 2] == list(range(36))
    assert np.allclose([r.distance for r in near if r.id == 1], np.sort(gaps)) and {r.distance for r in near if r.id == 2} == {None}


def tfidf_by_hand(texts):
    """{(key, term): weight} of (key, words); rows of one key are one document, but each counts in n."""
    docs = {}
    for key, words in texts:
        docs.setdefault(key, []).extend(words or [])
    df = {t: sum(t in w for w in docs.values()) for w in docs.values() for t in w}
    raw = {k: {t: (1 + np.log(w.count(t))) * (np.log((1 + len(texts)) / (1 + df[t])) + 1) for t in w if df[t] >= 3} for k, w in docs.items()}
    return {(k, t): v / np.sqrt(sum(x * x for x in r.values())) for k, r in raw.items() for t, v in r.items()}


@pytest.mark.parametrize("odd", [False, True])
def test_tfidf_shuffles_no_terms_of_documents(spark, odd):
    rng = np.random.RandomState(5)
    texts = [(i, [f"w{k}" for k in rng.zipf(1.6, 30) if k < 40]) for i in range(60)] + [(60, []), (61, None), (None, ["w1", "w2", "w2"])]
    texts += [(3, ["w1", "w9"]), (None, ["w2"])] if odd else []
    df = spark.createDataFrame(texts, "id long, words array<string>").repartition(4)
    got = classify.tfidf(df, "id", F.col("words"))
    want = tfidf_by_hand(texts)
    assert {(r.id, r.term): pytest.approx(r.weight) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and ("Aggregate" in plan) == odd
    found = classify.sparse(df.withColumn("size", F.lit(2.5)).where("id IS NOT NULL"), "id", {"a": F.col("words"), "b": F.slice("words", 1, 2)}, [] if odd else ["size"])
    wanted = {f"{b}:{t}": w for b, cut in (("a", 30), ("b", 2)) for (k, t), w in tfidf_by_hand([(k, w and w[:cut]) for k, w in texts if k is not None]).items() if k == 3}
    row = next(r for r in found.rows.collect() if r.id == 3)
    assert found.names == sorted(found.names) and row._i == sorted(row._i)
    assert {found.names[i]: pytest.approx(w) for i, w in zip(row._i, row._w)} == wanted | ({} if odd else {"size": 2.5})


def test_training_reads_few_parts(spark, monkeypatch):
    """Short jobs over small parts took the time of out-of-fold scores; parts are of PART_ROWS rows."""
    rng = np.random.RandomState(2)
    x = rng.randn(240, 2)
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(i, v.tolist(), int(v[0] + 0.3 * rng.randn() > 0)) for i, v in enumerate(x)], "id long, v array<double>, y int").select("id", "y", array_to_vector("v").alias("features")).repartition(40)
    seen, logistic = [], classify.logistic
    monkeypatch.setattr(classify, "logistic", lambda train, *a, **k: (seen.append(train.select(F.spark_partition_id()).distinct().count()), logistic(train, *a, **k))[1])
    models = {"lr": lambda train: (lambda m: lambda df, name: classify.probability(m, df, name))(classify.logistic(train, "y")), "svm": lambda train: classify.CalibratedSvm(train, "y", "id", folds=2).probability}
    got = classify.out_of_fold(rows, "id", "y", F.lit(True), models, k=3).collect()
    assert seen == [1, 1, 1] and sorted(r.id for r in got) == list(range(240)) and all(0 <= r.p_svm <= 1 for r in got)
    assert np.mean([(r.p_lr > 0.5) == r.y for r in got]) > 0.8
    monkeypatch.setattr(classify, "PART_ROWS", 100)
    again = {r.id: r.p_lr for r in classify.out_of_fold(rows, "id", "y", F.lit(True), {"lr": models["lr"]}, k=3).collect()}
    assert max(seen[3:]) == 3 and all(again[r.id] == pytest.approx(r.p_lr, abs=1e-5) for r in got)


def test_sensitivity_deals_many_small_rows(spark, tmp_path, monkeypatch):
    """A table of many small rows in one part is dealt out before the steps, the same for all views; clusters side by side are compared by their counts."""
    rng = np.random.RandomState(6)
    rows = [(i, float(x), int(k)) for i, (x, k) in enumerate(zip(rng.rand(300) + np.arange(300) % 3 * 50, np.arange(300) % 3 * 7))]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    seen, fit = [], cluster.KMeans.fit
    monkeypatch.setattr(cluster.KMeans, "fit", lambda self, rows: (seen.append(rows.rdd.getNumPartitions()), fit(self, rows))[1])
    for most, parts in ((65_536, 1), (100, 3)):
        monkeypatch.setattr(cluster, "KMEANS_PART_ROWS", most)
        got = {(r.a, r.b): r.ari for r in models.QUERIES["ml_sensitivity"][0](spark, str(tmp_path)).collect()}
        assert got == {("k0", "k1"): 1.0, ("k0", "k2"): 1.0, ("k1", "k2"): 1.0} and set(seen) == {parts}
        seen.clear()
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in rng.randint(0, 3, (200, 2))], "a int, b int")
    counted = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    assert stats.rand_matrix(counted, ["a", "b"], "n").first().ari == pytest.approx(stats.rand_matrix(rows, ["a", "b"]).first().ari)
