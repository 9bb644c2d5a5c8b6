"""Queries of combined features, consensus, contrasts, map and cluster diagnostics, and chart frames. Each is (plan, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelsift.functions import text
from labelsift.functions.numeric import threshold_flag
from labelsift.operators import charts, classify, cluster, features, rules, sampling, som, stats
from labelsift.plans import profiles
from labelsift.plans.analytics import CLEAN, LABELLED, NUMERIC, RAW_COLOUR, VOTED, baskets, labelled, profile_vectors, raw_colour, ready, small_map, vectors, voted
from labelsift.sources.tables import table

c, lit = F.col, F.lit
QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


@query(
    "sf_threshold_flag",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_discount * 20 >= 1 THEN 1 WHEN l_discount * 20 <= 0 THEN 0 END AS flag FROM lineitem""",
)
def _(s, d):
    rows = table(s, d, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", threshold_flag(c("l_discount") * 20).alias("flag"))


# --- entry point A: judgements made of orders, an account a customer

JUDGED = f"""SELECT o_orderkey AS unit_id, 'u' || o_custkey AS name, strftime(TIMESTAMP '1990-01-01 03:20:00' + INTERVAL (o_custkey % 700) DAY, '%-m/%-d/%y %-H:%M') AS created,
  TIMESTAMP '1990-01-01 03:20:00' + INTERVAL (o_custkey % 700) DAY AS born, date_trunc('minute', o_orderdate) AS seen, ['female', 'male', 'brand', 'unknown', NULL][o_orderkey % 5 + 1] AS gender,
  (o_orderkey % 4) / 4.0::DOUBLE AS gender_confidence, o_orderkey % 1000 AS fav_number, o_orderkey % 3 AS retweet_count, (o_custkey * 7 + o_orderkey) % 5000 AS tweet_count,
  {RAW_COLOUR} AS link_color, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE 'likes @' || o_orderstatus || ' and #x ' || o_orderpriority END AS description,
  'see WEBhttp://x.y/' || o_orderkey AS tweet FROM orders WHERE o_orderkey % 20 <> 0"""

PREPARED = f"""SELECT *, name || '|' || created AS account_id, CASE gender WHEN 'female' THEN 1 WHEN 'male' THEN 1 WHEN 'brand' THEN 0 END AS is_human,
  floor((epoch(seen) - epoch(born)) / 86400)::BIGINT AS account_age_days FROM ({JUDGED})"""

COLOUR_STATUS = "(SELECT CASE WHEN s = '0' THEN 'zero_suspect' WHEN nullif(regexp_extract(s, '^([0-9])\\.([0-9]{2})E\\+([0-9]{2})$', 3), '')::INT >= 2 THEN 'sci_repaired' WHEN regexp_full_match(s, '[0-9A-F]{6}') THEN 'ok' WHEN regexp_full_match(s, '[0-9A-F]{1,5}') THEN 'padded' ELSE 'invalid' END FROM (SELECT upper(trim(coalesce(link_color, 'nan'))) AS s))"

#: Columns of the prepared tables that the queries show.
SHOWN = ["unit_id", "account_id", "gender", "is_human", "label_known", "account_age_days", "fav_number", "retweet_count", "tweet_count", "has_retweets", "link_color_status", "description_clean", "has_description", "description_len", "description_n_mentions", "tweet_n_urls"]
RATES = ["tweets_per_day", "favs_per_day", "log_tweet_count", "log_account_age_days"]

DERIVED_SQL = f"""unit_id, account_id, gender, is_human, (is_human IS NOT NULL)::INT AS label_known, account_age_days, fav_number, retweet_count, tweet_count, (retweet_count > 0)::INT AS has_retweets,
  {COLOUR_STATUS} AS link_color_status, (SELECT {CLEAN} FROM (SELECT coalesce(description, '') AS t)) AS description_clean, (trim(coalesce(description, '')) <> '')::INT AS has_description,
  length((SELECT {CLEAN} FROM (SELECT coalesce(description, '') AS t)))::BIGINT AS description_len, len(regexp_extract_all(coalesce(description, ''), '(?:^|[^0-9A-Za-z_])@[0-9A-Za-z_]+'))::BIGINT AS description_n_mentions,
  1::BIGINT AS tweet_n_urls, round(tweet_count / greatest(account_age_days, 1), 6) AS tweets_per_day, round(fav_number / greatest(account_age_days, 1), 6) AS favs_per_day,
  round(ln(1 + tweet_count), 6) AS log_tweet_count, round(ln(1 + greatest(account_age_days, 0)), 6) AS log_account_age_days"""


def judged(s, d) -> DataFrame:
    k, customer = c("o_orderkey"), c("o_custkey")
    form = "M/d/yy H:mm"
    born = F.date_add(lit("1990-01-01").cast("date"), (customer % 700).cast("int")).cast("timestamp_ntz") + F.expr("INTERVAL '3:20' HOUR TO MINUTE")
    genders = F.array(*[lit(x) for x in ("female", "male", "brand", "unknown")], lit(None).cast("string"))
    about = F.when(k % 6 == 1, "   ").when(k % 6 > 1, F.concat(lit("likes @"), "o_orderstatus", lit(" and #x "), "o_orderpriority"))
    return table(s, d, "orders").select(
        k.alias("_row_id"), k.alias("_unit_id"), F.concat(lit("u"), customer.cast("string")).alias("name"), F.date_format(born, form).alias("created"), F.date_format("o_orderdate", form).alias("tweet_created"),
        F.when(k % 20 == 0, "no").otherwise("yes").alias("profile_yn"), F.get(genders, (k % 5).cast("int")).alias("gender"), ((k % 4) / lit(4.0)).alias("gender:confidence"),
        (k % 1000).alias("fav_number"), (k % 3).alias("retweet_count"), ((customer * 7 + k) % 5000).alias("tweet_count"), raw_colour().alias("link_color"), lit("C0DEED").alias("sidebar_color"),
        about.alias("description"), F.concat(lit("see WEBhttp://x.y/"), k.cast("string")).alias("text"),
    )


@query(
    "prep_profiles",
    f"""WITH p AS ({PREPARED}) SELECT {DERIVED_SQL}, count(*) OVER w AS n_rows_for_account, coalesce((min(is_human) OVER w <> max(is_human) OVER w)::INT, 0) AS label_conflict_human_brand,
    coalesce((min(gender) OVER w <> max(gender) OVER w)::INT, 0) AS label_conflict_gender FROM p WINDOW w AS (PARTITION BY account_id)""",
)
def _(s, d):
    out = profiles.prepare(judged(s, d))
    return out.select(*SHOWN, *[F.round(x, 6).alias(x) for x in RATES], "n_rows_for_account", "label_conflict_human_brand", "label_conflict_gender")


@query(
    "prep_accounts",
    f"""WITH p AS ({PREPARED}), g AS (SELECT account_id, max(fav_number) AS fav_number, max(retweet_count) AS retweet_count, max(tweet_count) AS tweet_count FROM p GROUP BY 1),
    b AS (SELECT * EXCLUDE (fav_number, retweet_count, tweet_count) FROM p QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY gender_confidence DESC NULLS LAST, unit_id) = 1),
    a AS (SELECT * FROM b JOIN g USING (account_id)) SELECT {DERIVED_SQL} FROM a""",
)
def _(s, d):
    return profiles.accounts(profiles.prepare(judged(s, d))).select(*SHOWN, *[F.round(x, 6).alias(x) for x in RATES])


@query("prep_checks", "SELECT unnest(['unit_id unique', 'confidence within 0 and 1', 'age not negative', 'colour codes well formed', 'usable agrees with code', 'clean text has no link, no corrupted run', 'label known agrees with is_human', 'counts not negative', 'account_id unique']) AS check_name, true AS ok")
def _(s, d):
    prepared = profiles.prepare(judged(s, d))
    return profiles.assertions(prepared, profiles.accounts(prepared))


# --- agreement and contrasts

PAIRS = [("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "half"), ("o_orderpriority", "half")]
HALVES = "(SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN (o_totalprice > 150000)::INT END AS half FROM orders)"


def _ari_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round((x - r * k / p) / ((r + k) / 2 - r * k / p), 9) AS ari FROM (
    WITH t AS (SELECT {a} AS u, {b} AS v, count(*)::DOUBLE AS n FROM {HALVES} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
    SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS x, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS p,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY u)) AS r,
      (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY v)) AS k)"""


@query("ml_ari_matrix", " UNION ALL ".join(_ari_sql(a, b) for a, b in PAIRS))
def _(s, d):
    half = F.when(c("o_orderkey") % 7 > 0, (c("o_totalprice") > 150000).cast("int"))
    out = stats.rand_matrix(table(s, d, "orders").withColumn("half", half), ["o_orderstatus", "o_orderpriority", "half"])
    return out.select("a", "b", F.round("ari", 9).alias("ari"))


@query(
    "ml_chi2_p",
    """WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT a, sum(n) AS r FROM t GROUP BY 1), k AS (SELECT b, sum(n) AS k FROM t GROUP BY 1), g AS (SELECT sum(n) AS g FROM t),
    x AS (SELECT sum((coalesce(n, 0) - r * k / g) ^ 2 / (r * k / g)) / 2 AS h FROM r CROSS JOIN k CROSS JOIN g LEFT JOIN t USING (a, b))
    SELECT round(2 * h, 6) AS chi2, 8::BIGINT AS dof, round(exp(-h) * (1 + h + h ^ 2 / 2 + h ^ 3 / 6), 9) AS p FROM x""",
)
def _(s, d):
    out = stats.chi_square(table(s, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("p", stats.chi_square_p(c("chi2"), c("dof")))
    return out.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p", 9).alias("p"))


@query(
    "ev_flag_contrast",
    f"""SELECT count(*) FILTER (g) AS n_in, count(*) FILTER (NOT g) AS n_out, round(avg(x) FILTER (g), 9) AS mean_in, round(avg(x) FILTER (NOT g), 9) AS mean_out,
    round(avg(x) FILTER (g) - avg(x) FILTER (NOT g), 9) AS difference FROM (SELECT (guess <> quality)::INT AS x, lang = 'en' AS g FROM {LABELLED})""",
)
def _(s, d):
    out = stats.contrast(labelled(s, d), (c("guess") != c("quality")).cast("int"), c("lang") == "en")
    return out.select("n_in", "n_out", *[F.round(x, 9).alias(x) for x in ("mean_in", "mean_out", "difference")])


@query(
    "ev_confidence_contrast",
    f"""SELECT count(*) FILTER (g) AS n_in, count(*) FILTER (NOT g) AS n_out, round(avg(x) FILTER (g), 6) AS mean_in, round(avg(x) FILTER (NOT g), 6) AS mean_out,
    round(avg(x) FILTER (g) - avg(x) FILTER (NOT g), 6) AS difference FROM (SELECT n_chars AS x, guess <> quality AS g FROM {LABELLED})""",
)
def _(s, d):
    out = stats.contrast(labelled(s, d), c("n_chars"), c("guess") != c("quality"))
    return out.select("n_in", "n_out", *[F.round(x, 6).alias(x) for x in ("mean_in", "mean_out", "difference")])


@query(
    "ml_ols_residuals",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS k FROM lineitem)
    SELECT l_returnflag, round(avg(l_extendedprice - m * l_quantity - k), 4) AS mean_residual FROM lineitem, f GROUP BY 1""",
)
def _(s, d):
    rows = table(s, d, "lineitem")
    out = stats.group_residuals(rows, "l_extendedprice", "l_quantity", "l_returnflag")
    return out.select("l_returnflag", F.round("mean_residual", 4).alias("mean_residual"))


# --- combined features and models


def heads(s, d) -> DataFrame:
    """Labelled documents with their numbers, and with the first line as a second text."""
    return profile_vectors(s, d).withColumn("head", F.substring_index("text", "\n", 1))


def words(column: str):
    return F.regexp_extract_all(F.lower(column), lit("[0-9a-z_]{2,}"), lit(0))


def _tfidf_sql(column: str, block: str) -> str:
    return f"""SELECT doc_id, '{block}:' || term AS feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM (
    WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower({column}), '[0-9a-z_]{{2,}}')) AS term FROM x) GROUP BY 1, 2),
    v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM t GROUP BY 1 HAVING count(*) >= 3 ORDER BY cf DESC, term LIMIT 5000)
    SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM x)) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN v USING (term))"""


@query(
    "tx_union",
    f"""WITH x AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10))[1] AS head, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, 'size' AS feature, round((ln(1 + n_chars) - avg(ln(1 + n_chars)) OVER ()) / stddev_pop(ln(1 + n_chars)) OVER (), 6) AS value FROM x
    UNION ALL {_tfidf_sql("text", "text")} UNION ALL {_tfidf_sql("head", "head")}""",
)
def _(s, d):
    rows = heads(s, d)
    z = features.standardise(rows.select("doc_id", "size"), {"size": ["size"]}).select("doc_id", c("size_z").alias("size"))
    out = classify.union_features(rows, "doc_id", z, ["size"], {"text": words("text"), "head": words("head")})
    return out.select("doc_id", "feature", F.round("value", 6).alias("value"))


def combined(s, d) -> tuple[DataFrame, list[str]]:
    """Labelled documents with one vector of scaled numbers and two TF-IDF blocks, and the features' names."""
    rows = heads(s, d)
    z = features.standardise(rows, {x: [x] for x in NUMERIC})
    z = z.select("doc_id", "text", "head", *[c(f"{x}_z").alias(x) for x in NUMERIC])
    found = classify.sparse(z, "doc_id", {"text": words("text"), "head": words("head")}, NUMERIC)
    return classify.vectors(found, "doc_id", rows.select("doc_id", "quality"))


@query("tx_top_terms")
def _(s, d):
    rows, names = combined(s, d)
    rows = classify.in_parts(rows, table(s, d, "labels").count())
    least, most = classify.top_terms(classify.logistic(rows, "quality", tolerance=1e-4), names)
    found = [("least", i + 1, t, w) for i, (t, w) in enumerate(least)] + [("most", i + 1, t, w) for i, (t, w) in enumerate(most)]
    return s.createDataFrame(found, "side string, rank int, feature string, coefficient double")


def _probabilities(fit):
    return lambda train: (lambda m: lambda df, name: classify.probability(m, df, name))(fit(train))


#: Learners of the consensus: each makes, of training rows, what scores others.
THREE = {
    "lr": _probabilities(lambda train: classify.logistic(train, "quality")),
    "svm": lambda train: classify.CalibratedSvm(train, "quality", "doc_id", folds=2).probability,
    "nb": _probabilities(lambda train: classify.naive_bayes(train, "quality", "terms")),
}


@query("ml_consensus")
def _(s, d):
    """Three models, two of scaled numbers and one of terms, trained on trusted labels only (here those of documents in a known language), score
    every label out of fold."""
    rows = ready(s, d).select("doc_id", "quality", "features")
    terms, _ = classify.vectors(classify.sparse(heads(s, d).select("doc_id", "text"), "doc_id", {"": words("text")}), "doc_id", rows.select("doc_id"))
    rows = rows.join(terms.withColumnRenamed("features", "terms"), "doc_id").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    scored = classify.out_of_fold(rows, "doc_id", "quality", c("lang").isNotNull(), THREE, k=3)
    names = [f"p_{x}" for x in THREE]
    return classify.consensus_flags(scored, "quality", names).select("doc_id", "quality", "fold", *names, "p_label", "flagged")


@query("ml_disagreement")
def _(s, d):
    scored = classify.out_of_fold(ready(s, d), "doc_id", "quality", lit(True), {"lr": THREE["lr"]}, k=3)
    return classify.disagreement(scored, "quality", "p_lr").select("doc_id", "quality", "p_lr", "disagreement")


@query("ml_strong_rules")
def _(s, d):
    _, model = rules.itemsets(baskets(s, d), "items", 0.02)
    return rules.strong(rules.label_rules(model, ["good", "poor"]))


# --- clusters and maps


@query("ml_kmeans_stability")
def _(s, d):
    found = cluster.stability(vectors(s, d), "vec_id", "v", 4, seeds=[1, 2], restarts=2)
    return s.createDataFrame([(4, float(min(found)), float(sum(found) / len(found)))], "k int, min_ari double, mean_ari double")


@query("ml_sensitivity")
def _(s, d):
    """How far clusters change if the view's weights are left out: the Rand index of both, of customers by balance and region."""
    rows = table(s, d, "customer").select(c("c_acctbal").alias("a"), c("c_nationkey").cast("double").alias("b"))
    # a file has many of these small rows; they are dealt out once, so that the views' starts are of the same rows
    if (n := rows.count()) > cluster.KMEANS_PART_ROWS:
        rows = rows.repartition(-(-n // cluster.KMEANS_PART_ROWS))
    rows = rows.cache()
    done, marks = rows, []
    for views in ({"both": ["a", "b"]}, {"a": ["a"], "b": ["b"]}, {"a": ["a"]}):
        z = features.standardise(done, views, rows)
        names = [f"{x}_z" for v in views.values() for x in v]
        done, _, _ = cluster.kmeans(z.withColumn("v", F.array(*names)).drop(*names), "v", 3, restarts=2)
        marks.append(f"k{len(marks)}")
        done = done.drop("v").withColumnRenamed("cluster", marks[-1])
    # each row has its three clusters side by side; what is compared are the counts of the 27 combinations
    counts = done.groupBy(*marks).agg(F.count(lit(1)).alias("n")).cache()
    counts.count()
    return stats.rand_matrix(counts, marks, "n")


@query("ml_som_sweep")
def _(s, d):
    return som.sweep(vectors(s, d), "vec_id", "v", (3, 5), steps=2000)


@query("ml_pca_loadings")
def _(s, d):
    return cluster.principal(vectors(s, d), "v", 2)


# --- chart frames


@query("vz_vote_bars", VOTED.format(lift=1.2) + " SELECT lang, vote, count(*) AS n FROM v WHERE vote IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return voted(s, d).where("vote IS NOT NULL").groupBy("lang", "vote").agg(F.count(lit(1)).alias("n"))


@query(
    "vz_fit_line",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT i::INT AS step, round(lo + (hi - lo) * i / 49, 6) AS x, round(k + m * (lo + (hi - lo) * i / 49), 3) AS y FROM f, range(0, 50) r(i)""",
)
def _(s, d):
    line = charts.fit_line(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", 50)
    return line.select("step", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


@query("vz_dendrogram_tail")
def _(s, d):
    m, _ = small_map(s, d)
    tree = cluster.linkage(m.weights.reshape(-1, m.n_features), "complete")
    return s.createDataFrame([(int(left), float(h)) for left, h in charts.dendrogram_tail(tree, 20)], "clusters int, height double")


# --- quality


@query("dq_idempotent", "SELECT unnest(['cleaned again is the same', 'no address left', 'only ascii left', 'one space at most']) AS check_name, true AS ok")
def _(s, d):
    once = text.clean(c("html"))
    rows = table(s, d, "pages").select(once.alias("t")).withColumn("again", text.clean(c("t")))
    bad = {
        "cleaned again is the same": ~c("t").eqNullSafe(c("again")),
        "no address left": c("t").rlike(r"(?i)https?:|www\."),
        "only ascii left": c("t").rlike(r"[^\x00-\x7F]"),
        "one space at most": c("t").rlike(r"\s\s"),
    }
    one = rows.agg(*[(F.count_if(x) == 0).alias(k) for k, x in bad.items()])
    return one.unpivot([], list(bad), "check_name", "ok")
