"""Queries of the scalar, text, sampling, modelling and evaluation operators. Each is (plan, SQL or None)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from labelsift.functions import colour, text
from labelsift.functions.numeric import close, flag, half_even, left_open_bin, parse_minute, rate, whole_days
from labelsift.operators import charts, classify, cluster, features, rules, sampling, som, stats, vote
from labelsift.sources.tables import table

c, lit = F.col, F.lit
QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


# --- scalar functions

RAW_COLOUR = "CASE o_orderkey % 6 WHEN 0 THEN upper(substr(md5(o_orderkey::VARCHAR), 1, 6)) WHEN 1 THEN substr(md5(o_orderkey::VARCHAR), 1, 4) WHEN 2 THEN '0' WHEN 3 THEN '2.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || 'E+' || lpad((o_orderkey % 12)::VARCHAR, 2, '0') WHEN 4 THEN ' x-' || o_orderkey END"


def raw_colour():
    k, m = c("o_orderkey"), F.md5(c("o_orderkey").cast("string"))
    return (
        F.when(k % 6 == 0, F.upper(F.substring(m, 1, 6))).when(k % 6 == 1, F.substring(m, 1, 4)).when(k % 6 == 2, "0")
        .when(k % 6 == 3, F.concat(lit("2."), F.lpad((k % 100).cast("string"), 2, "0"), lit("E+"), F.lpad((k % 12).cast("string"), 2, "0")))
        .when(k % 6 == 4, F.concat(lit(" x-"), k.cast("string")))
    )


@query(
    "sf_colour_repair",
    f"""WITH r AS (SELECT o_orderkey, upper(trim(coalesce({RAW_COLOUR}, 'nan'))) AS s FROM orders),
p AS (SELECT *, nullif(regexp_extract(s, '^([0-9])\\.([0-9]{{2}})E\\+([0-9]{{2}})$', 3), '') AS e FROM r),
h AS (SELECT o_orderkey, CASE WHEN s = '0' THEN 'zero_suspect' WHEN e::INT >= 2 THEN 'sci_repaired' WHEN regexp_full_match(s, '[0-9A-F]{{6}}') THEN 'ok' WHEN regexp_full_match(s, '[0-9A-F]{{1,5}}') THEN 'padded' ELSE 'invalid' END AS status,
 CASE WHEN s = '0' THEN '000000' WHEN e::INT >= 2 THEN s[1] || s[3:4] || 'E' || lpad((e::INT - 2)::VARCHAR, 2, '0') WHEN regexp_full_match(s, '[0-9A-F]{{6}}') THEN s WHEN regexp_full_match(s, '[0-9A-F]{{1,5}}') THEN lpad(s, 6, '0') END AS hex FROM p)
SELECT o_orderkey, status, hex, ('0x' || hex[1:2])::INT AS r, ('0x' || hex[3:4])::INT AS g, ('0x' || hex[5:6])::INT AS b,
 round(0.299::DOUBLE * ('0x' || hex[1:2])::INT + 0.587::DOUBLE * ('0x' || hex[3:4])::INT + 0.114::DOUBLE * ('0x' || hex[5:6])::INT, 6) AS brightness, (status <> 'invalid')::INT AS usable FROM h""",
)
def _(s, d):
    f = colour.features(raw_colour(), "k")
    out = table(s, d, "orders").select("o_orderkey", *[v.alias(k[2:]) for k, v in f.items()])
    return out.select("o_orderkey", "status", "hex", "r", "g", "b", F.round("brightness", 6).alias("brightness"), "usable")


@query("sf_normalise", "SELECT o_orderkey, upper(regexp_replace(chr(9) || '  ' || o_orderpriority || chr(10), '^\\s+|\\s+$', '', 'g')) AS s FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", colour.normal(F.concat(lit("\t  "), "o_orderpriority", lit("\n"))).alias("s"))


@query("sf_pad_replace", "SELECT o_orderkey, lpad((o_orderkey % 1000)::VARCHAR, 6, '0') AS padded, replace(o_orderpriority, '-', '_') AS name, substr(o_orderpriority, 3) AS tail FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.lpad((c("o_orderkey") % 1000).cast("string"), 6, "0").alias("padded"), F.replace("o_orderpriority", lit("-"), lit("_")).alias("name"), F.substring("o_orderpriority", 3, 100).alias("tail"))


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(https?:?//|www\.)\S*', ' URLTOKEN ', 'gi'), '\bhttps?\b:?', ' URLTOKEN ', 'gi'), '(^|[^0-9A-Za-z_])@[0-9A-Za-z_]+', '\1 MENTIONTOKEN ', 'g'), '#[0-9A-Za-z_]+', ' HASHTAGTOKEN ', 'g'), '_*([^\x00-\x7F]_*)+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("sf_clean_text", f"WITH x AS (SELECT page_id, 'see WEB' || url || ' by @user_' || page_id || ' #tag' || (page_id % 5) || ' a@b _é_ http//x.y  end' AS t FROM pages) SELECT page_id, {CLEAN} AS cleaned FROM x")
def _(s, d):
    return table(s, d, "pages").select("page_id", text.clean(mixed(), entities=False).alias("cleaned"))


def mixed():
    i = c("page_id").cast("string")
    return F.concat(lit("see WEB"), "url", lit(" by @user_"), i, lit(" #tag"), (c("page_id") % 5).cast("string"), lit(" a@b _é_ http//x.y  end"))


@query(
    "sf_text_counts",
    r"""WITH x AS (SELECT page_id, 'see WEB' || url || ' by @user_' || page_id || ' #tag' || (page_id % 5) || ' a@b _é_ http//x.y  end' AS t FROM pages)
SELECT page_id, len(regexp_extract_all(t, '(?i)(?:https?:?//|www\.)\S*'))::BIGINT AS urls, len(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_])@[0-9A-Za-z_]+'))::BIGINT AS mentions, len(regexp_extract_all(t, '#[0-9A-Za-z_]+'))::BIGINT AS tags, len(regexp_extract_all(t, '_*(?:[^\x00-\x7F]_*)+'))::BIGINT AS runs, length(t)::BIGINT AS n FROM x""",
)
def _(s, d):
    t = mixed()
    return table(s, d, "pages").select("page_id", text.count_of(t, text.URL).alias("urls"), text.count_of(t, text.MENTION).alias("mentions"), text.count_of(t, text.HASHTAG).alias("tags"), text.count_of(t, text.CORRUPT).alias("runs"), F.char_length(t).cast("long").alias("n"))


@query("sf_document_words", r"SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END::BIGINT AS n_words, length(w)::BIGINT AS n FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '_*([^\x00-\x7F]_*)+', ' ', 'g'), '\s+', ' ', 'g')) AS w FROM documents)")
def _(s, d):
    w = F.trim(F.regexp_replace(F.regexp_replace("text", text.CORRUPT, " "), text.SPACE, " "))
    return table(s, d, "documents").select("doc_id", w.alias("w")).select("doc_id", text.word_count(c("w")).alias("n_words"), F.char_length("w").cast("long").alias("n"))


@query("sf_unescape")
def _(s, d):
    return table(s, d, "pages").select("page_id", text.unescape(c("html")).alias("plain"))


@query("sf_parse_date", "SELECT o_orderkey, try_strptime(CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%-m/%-d/%y %-H:%M') END, '%m/%d/%y %H:%M') AS at FROM orders")
def _(s, d):
    shown = F.when(c("o_orderkey") % 9 == 0, "unknown").otherwise(F.date_format(c("o_orderdate"), "M/d/yy H:mm"))
    return table(s, d, "orders").select("o_orderkey", parse_minute(shown).alias("at"))


@query("sf_age_days", "SELECT event_id, floor((epoch(TIMESTAMP '2030-01-01 07:30:00') - epoch(ts)) / 86400)::BIGINT AS days FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", whole_days(c("ts"), lit("2030-01-01 07:30:00").cast("timestamp_ntz")).alias("days"))


@query("sf_log_rates", "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS l, round(o_totalprice / CASE WHEN o_orderkey % 5 < 1 THEN 1 ELSE o_orderkey % 5 END, 6) AS r FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice"), 9).alias("l"), F.round(rate(c("o_totalprice"), c("o_orderkey") % 5), 6).alias("r"))


@query("sf_bins", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount BETWEEN 0 AND 0.03 THEN 'low' WHEN l_discount > 0.03 AND l_discount <= 0.07 THEN 'middle' WHEN l_discount > 0.07 AND l_discount <= 1 THEN 'high' END AS bin FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", left_open_bin(c("l_discount"), [0, 0.03, 0.07, 1], ["low", "middle", "high"]).alias("bin"))


@query("sf_round_even", "SELECT o_orderkey, round_even((o_orderkey % 16) / 8.0, 2) AS a FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", half_even((c("o_orderkey") % 16) / lit(8.0), 2).alias("a"))


@query("sf_close", "SELECT count(*) FILTER (abs(o_totalprice - round(o_totalprice, 1)) <= 1e-8 + 1e-7 * abs(round(o_totalprice, 1))) AS n FROM orders")
def _(s, d):
    return table(s, d, "orders").agg(F.count_if(close(c("o_totalprice"), F.round("o_totalprice", 1), 1e-7)).alias("n"))


# --- samples and splits


@query("sp_split", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id) <= round_even(count(*) OVER (PARTITION BY quality) * 0.3, 0) THEN 'test' ELSE 'train' END AS part FROM labels")
def _(s, d):
    return sampling.split(table(s, d, "labels"), "doc_id", 0.3, 42, ["quality"]).select("doc_id", "part")


@query("sp_plain_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || '|142'), o_orderkey) <= round_even(count(*) OVER () * 0.2, 0) THEN 'test' ELSE 'train' END AS part FROM orders")
def _(s, d):
    return sampling.split(table(s, d, "orders"), "o_orderkey", 0.2, 142).select("o_orderkey", "part")


@query("sp_folds", "SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id) - 1) % 5)::INT AS fold FROM labels")
def _(s, d):
    return sampling.folds(table(s, d, "labels"), "doc_id", 5, 42, ["quality"]).select("doc_id", "fold")


@query("sp_stratified", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= round_even(n * 0.05, 0)")
def _(s, d):
    return sampling.stratified_sample(table(s, d, "orders"), "o_orderkey", 0.05, 42, ["o_orderpriority"]).select("o_orderkey")


@query("sp_uniform", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 300")
def _(s, d):
    return sampling.sample(table(s, d, "orders"), "o_orderkey", 300, 42).select("o_orderkey")


@query("sp_group_split", "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_custkey || '|42'), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS part FROM orders")
def _(s, d):
    return sampling.group_split(table(s, d, "orders"), "o_custkey", 0.3, 42).select("o_orderkey", "part")


# --- statistics and evaluation

LABELLED = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, (d.n_chars < 1500)::INT AS guess FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(s, d) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "labels"), "doc_id").withColumn("guess", flag(c("n_chars") < 1500))


@query(
    "ml_ari",
    "WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM t GROUP BY b)), x AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM t) SELECT round((x - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 9) AS ari FROM r, k, x",
)
def _(s, d):
    return stats.adjusted_rand(table(s, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("ari", 9).alias("ari"))


@query(
    "ml_chi2",
    "WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM t GROUP BY 1), k AS (SELECT b, sum(n) AS k FROM t GROUP BY 1), g AS (SELECT sum(n) AS g FROM t) SELECT round(sum((coalesce(n, 0) - r * k / g) ^ 2 / (r * k / g)), 6) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::BIGINT AS dof FROM r CROSS JOIN k CROSS JOIN g LEFT JOIN t USING (a, b)",
)
def _(s, d):
    return stats.chi_square(table(s, d, "orders").select(c("o_orderstatus").alias("a"), c("o_orderpriority").alias("b")), "a", "b").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("ml_auc", f"WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM {LABELLED}), a AS (SELECT sum(k) FILTER (quality = 1) AS s, count(*) FILTER (quality = 1)::DOUBLE AS p, count(*)::DOUBLE AS n FROM r) SELECT round((s - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM a")
def _(s, d):
    return stats.auc(labelled(s, d), "n_chars", "quality").select(F.round("auc", 9).alias("auc"))


@query("ev_roc", f"WITH g AS (SELECT n_chars AS threshold, count(*) FILTER (quality = 1) AS p, count(*) AS n FROM {LABELLED} GROUP BY 1) SELECT threshold, round(sum(n - p) OVER w / sum(n - p) OVER (), 9) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 9) AS tpr FROM g WINDOW w AS (ORDER BY threshold DESC)")
def _(s, d):
    return stats.roc(labelled(s, d), "n_chars", "quality").select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("ml_confusion", f"SELECT count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality <> 1 AND guess = 1) AS fp, count(*) FILTER (quality <> 1 AND guess <> 1) AS tn, count(*) FILTER (quality = 1 AND guess <> 1) AS fn FROM {LABELLED}")
def _(s, d):
    return stats.confusion(labelled(s, d), "quality", "guess")


@query(
    "ml_macro_f1",
    f"WITH m AS (SELECT count(*) FILTER (quality = 1 AND guess = 1)::DOUBLE AS tp, count(*) FILTER (quality <> 1 AND guess = 1)::DOUBLE AS fp, count(*) FILTER (quality <> 1 AND guess <> 1)::DOUBLE AS tn, count(*) FILTER (quality = 1 AND guess <> 1)::DOUBLE AS fn FROM {LABELLED}) SELECT round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round((tp / (tp + fp) + tn / (tn + fn)) / 2, 9) AS macro_precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS macro_recall, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 9) AS macro_f1 FROM m",
)
def _(s, d):
    r = stats.binary_report(labelled(s, d), "quality", "guess")
    return r.select(*[F.round(x, 9).alias(x) for x in r.columns])


@query("ml_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, round((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ^ 2 / regr_sxx(l_extendedprice, l_quantity)) / regr_count(l_extendedprice, l_quantity) / 1e6, 4) AS mse FROM lineitem")
def _(s, d):
    return stats.ols(table(s, d, "lineitem"), "l_extendedprice", "l_quantity").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"), F.round(c("mse") / 1e6, 4).alias("mse"))


@query("ev_correlation", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 9) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 9) FROM lineitem")
def _(s, d):
    return stats.correlation(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", F.round("r", 9).alias("r"))


# --- votes

NEAR = "SELECT d.doc_id, d.lang, least(floor(ln(1 + d.n_chars) * 2), 18)::BIGINT AS band, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
VOTED = f"""WITH t AS ({NEAR}), b AS (SELECT avg((quality = 0)::INT) FILTER (quality IS NOT NULL) AS base FROM t),
o AS (SELECT *, sum((quality IS NOT NULL)::INT) OVER w - (quality IS NOT NULL)::INT AS others_n, sum(coalesce(quality = 0, false)::INT) OVER w - coalesce(quality = 0, false)::INT AS others_hits FROM t WINDOW w AS (PARTITION BY lang, band)),
v AS (SELECT o.*, base, others_hits / greatest(others_n, 1) AS share, CASE WHEN others_n >= 10 AND others_hits / greatest(others_n, 1) >= base * {{lift}} THEN 1 WHEN others_n >= 10 AND others_hits / greatest(others_n, 1) <= base / {{lift}} THEN 0 END AS vote, (quality = 0)::INT AS poor FROM o, b)"""


def near(s, d) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "lang", F.least(F.floor(F.log1p("n_chars") * 2), lit(18)).cast("long").alias("band"))
    return docs.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("poor", (c("quality") == 0).cast("int"))


def voted(s, d, lift: float = 1.2) -> DataFrame:
    return vote.lift_vote(near(s, d), ["lang", "band"], c("quality") == 0, c("quality").isNotNull(), lift=lift)


@query("ml_vote", VOTED.format(lift=1.2) + " SELECT doc_id, others_n::BIGINT AS others_n, others_hits::BIGINT AS others_hits, vote FROM v")
def _(s, d):
    return voted(s, d).select("doc_id", "others_n", "others_hits", "vote")


SUGGESTED = "CASE WHEN vote IS NULL THEN 'no vote' WHEN poor IS NULL THEN 'first label ' || CASE vote WHEN 1 THEN 'poor' ELSE 'good' END WHEN poor = vote THEN 'keep ' || CASE vote WHEN 1 THEN 'poor' ELSE 'good' END ELSE 'amend ' || CASE poor WHEN 1 THEN 'poor' ELSE 'good' END || ' to ' || CASE vote WHEN 1 THEN 'poor' ELSE 'good' END END"


@query("ml_suggestion", VOTED.format(lift=1.2) + f" SELECT {SUGGESTED} AS suggestion, count(*) AS n FROM v GROUP BY 1")
def _(s, d):
    return voted(s, d).groupBy(vote.suggestion(c("poor"), c("vote"), ("good", "poor")).alias("suggestion")).agg(F.count(lit(1)).alias("n"))


def _rule(name: str, lift: float) -> str:
    return f"SELECT * FROM ({VOTED.format(lift=lift)} SELECT '{name}' AS rule, round(avg((vote IS NOT NULL)::INT), 9) AS coverage, round(avg((vote = 0)::INT) FILTER (vote IS NOT NULL AND poor = 0), 9) AS agree_0, round(avg((vote = 1)::INT) FILTER (vote IS NOT NULL AND poor = 1), 9) AS agree_1 FROM v)"


@query("ml_vote_rules", _rule("a", 1.2) + " UNION ALL " + _rule("b", 1.5))
def _(s, d):
    out = vote.rule_comparison(near(s, d), "poor", [("a", 1.2, 10), ("b", 1.5, 10)], ["lang", "band"])
    return out.select("rule", *[F.round(x, 9).alias(x) for x in ("coverage", "agree_0", "agree_1")])


@query("ml_vote_validation", VOTED.format(lift=1.2) + " SELECT poor, lang, count(*) AS voted, count(*) FILTER (vote <> poor) AS disagree, round_even(100.0 * count(*) FILTER (vote <> poor) / count(*), 1)::DOUBLE AS disagree_pct FROM v WHERE poor IS NOT NULL AND vote IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return vote.validation(voted(s, d), "poor", "lang")


# --- features, clusters, maps


@query("ml_zscore_views", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () / sqrt(2), 6) AS q, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () / sqrt(2), 6) AS p, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS t FROM lineitem")
def _(s, d):
    z = features.standardise(table(s, d, "lineitem"), {"size": ["l_quantity", "l_extendedprice"], "tax": ["l_tax"]})
    return z.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity_z", 6).alias("q"), F.round("l_extendedprice_z", 6).alias("p"), F.round("l_tax_z", 6).alias("t"))


@query("ml_inverse_units", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 4) AS q FROM lineitem")
def _(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    z = features.standardise(t, {"both": ["l_quantity", "l_tax"]}).drop("l_quantity", "l_tax")
    w = {"l_quantity": 2**-0.5, "l_tax": 2**-0.5}
    return features.original_units(z, features.fit_stats(t, ["l_quantity", "l_tax"]), list(w), w).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity", 4).alias("q"))


def vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("v"))


#: The mean vector of each label.
CENTRES = "(SELECT label AS vec_id, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"


def seeds(s, d) -> DataFrame:
    """(node, w): the mean vector of each label, a row a label."""
    means = vectors(s, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy(c("label").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("w"))


@query("jn_nearest", f"SELECT e.vec_id, arg_min(k.vec_id, list_distance(e.embedding::DOUBLE[], k.embedding::DOUBLE[])) AS node FROM embeddings e CROSS JOIN {CENTRES} k GROUP BY 1")
def _(s, d):
    return som.assign(vectors(s, d), "vec_id", "v", seeds(s, d)).select("vec_id", "node")


@query("so_two_nearest", f"SELECT vec_id, (rank - 1)::INT AS rank, node FROM (SELECT e.vec_id, k.vec_id AS node, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], k.embedding::DOUBLE[]), k.vec_id) AS rank FROM embeddings e CROSS JOIN {CENTRES} k) WHERE rank <= 2")
def _(s, d):
    return som.assign(vectors(s, d), "vec_id", "v", seeds(s, d), 2).select("vec_id", "rank", "node")


@query("jn_all_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding, b.embedding), 6) AS d FROM {CENTRES} a JOIN {CENTRES} b ON a.vec_id < b.vec_id")
def _(s, d):
    k = seeds(s, d)  # a row a label
    return k.toDF("a", "wa").join(k.toDF("b", "wb"), c("a") < c("b")).select("a", "b", F.round(som.euclidean(c("wa"), c("wb")), 6).alias("d"))


@query(
    "ml_kmeans_step",
    f"WITH n AS (SELECT e.vec_id, any_value(e.embedding) AS v, arg_min(k.vec_id, list_distance(e.embedding::DOUBLE[], k.embedding::DOUBLE[])) AS node FROM embeddings e CROSS JOIN {CENTRES} k GROUP BY 1) SELECT node, (i - 1)::INT AS dim, round(avg(v[i]::DOUBLE), 6) AS value FROM n, range(1, 65) r(i) GROUP BY 1, 2",
)
def _(s, d):
    return cluster.lloyd_step(vectors(s, d), "vec_id", "v", seeds(s, d)).select("node", "dim", F.round("value", 6).alias("value"))


@query("ml_kmeans_full")
def _(s, d):
    done, _, _ = cluster.kmeans(vectors(s, d), "v", 4, restarts=3)
    return cluster.renumber(done, "cluster", "label").select("vec_id", "cluster")


@query("ml_kmeans_sweep")
def _(s, d):
    rows = cluster.sweep(vectors(s, d), "v", range(2, 5), "label", restarts=2, key="vec_id")
    measures = ["wss", "bss_over_tss", "silhouette", "smallest_cluster_pct", "min_centroid_distance", "ari_vs_label", "wss_drop_pct"]
    return s.createDataFrame([(r["k"], *[r[x] for x in measures]) for r in rows], "k int, " + ", ".join(f"{x} double" for x in measures))


@query(
    "ml_silhouette",
    "WITH e AS (SELECT vec_id, label AS c, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.c, b.c AS oc, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), w AS (SELECT vec_id, max(d) FILTER (c = oc) AS a, min(d) FILTER (c <> oc) AS b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM w",
)
def _(s, d):
    return cluster.silhouette(vectors(s, d), "vec_id", "v", "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("ml_profile", "SELECT c_nationkey, count(*) AS n, round(median(c_acctbal), 4) AS median_c_acctbal, round(100 * avg((c_acctbal < 0)::INT), 6) AS owing_pct, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS share_pct FROM customer GROUP BY 1")
def _(s, d):
    t = table(s, d, "customer").withColumn("owing", flag(c("c_acctbal") < 0)).withColumn("label", lit(1)).withColumn("trusted", lit(True))
    return cluster.profile(t, "c_nationkey", ["c_acctbal"], ["owing"], "label", "trusted").select("c_nationkey", "n", F.round("median_c_acctbal", 4).alias("median_c_acctbal"), F.round("owing_pct", 6).alias("owing_pct"), F.round("share_pct", 6).alias("share_pct"))


#: Rows that online training takes on the driver (51 MB of 64 values); tables beyond are trained on by the batch rule.
TRAIN_ROWS = 100_000
PASSES = 10


def small_map(s, d) -> tuple[som.Som, DataFrame]:
    """A map of the whole vectors, started from the axes of all rows and trained on all rows."""
    rows = vectors(s, d)
    width = len(rows.select("v").first().v)
    m = som.Som(6, 6, width, sigma=3.0, seed=42)
    if rows.limit(TRAIN_ROWS + 1).count() > TRAIN_ROWS:
        m.start_from_covariance(som.covariance(rows, "v"))
        return som.train_batch(rows, "v", m, PASSES), rows
    held = rows.orderBy("vec_id").select("v").toArrow()["v"].combine_chunks()
    train = held.flatten().to_numpy().reshape(len(held), width)
    m.start_from_axes(train)
    m.train(train, PASSES * len(train), shuffled=True)
    return m, rows


@query("ml_som")
def _(s, d):
    m, rows = small_map(s, d)
    won = som.assign(rows, "vec_id", "v", m.frame(s))
    labels = rows.select("vec_id", flag(c("label") < 3).alias("minority"), lit(True).alias("trusted"))
    return som.node_table(won, labels, "vec_id", m.frame(s), "minority", "trusted")


@query("ml_som_quality")
def _(s, d):
    m, rows = small_map(s, d)
    return som.map_quality(rows, "vec_id", "v", m.frame(s))


@query("ml_u_matrix")
def _(s, d):
    m, _ = small_map(s, d)
    return s.createDataFrame([(i, j, float(u)) for i, line in enumerate(m.u_matrix()) for j, u in enumerate(line)], "x int, y int, u double")


@query("ml_linkage")
def _(s, d):
    """Trees of the prototypes, and of a sample of LINKAGE_ROWS rows at most, stratified by label and in order of vec_id."""
    m, rows = small_map(s, d)
    n, strata = rows.agg(F.count(lit(1)), F.count_distinct("label")).first()
    # each stratum's size is rounded, so the share leaves one row for each
    share = 1.0 if n <= cluster.LINKAGE_ROWS else (cluster.LINKAGE_ROWS - strata - 1) / n
    held = sampling.stratified_sample(rows, "vec_id", share, 42, ["label"]).orderBy("vec_id").select("v").collect()
    out = []
    for part, points in (("prototypes", m.weights.reshape(-1, m.n_features)), ("sample", np.array([r.v for r in held]))):
        for method in ("single", "complete", "average", "centroid"):
            out += [(part, method, i, int(a), int(b), float(h), int(k)) for i, (a, b, h, k) in enumerate(cluster.linkage(points, method))]
    return s.createDataFrame(out, "points string, linkage string, step int, a int, b int, height double, size int")


@query("ml_som_clusters")
def _(s, d):
    m, rows = small_map(s, d)
    labels = cluster.cut(cluster.linkage(m.weights.reshape(-1, m.n_features), "complete"), 4)
    nodes = s.createDataFrame([(i, int(k)) for i, k in enumerate(labels)], "node int, cluster int")
    return cluster.propagate(som.assign(rows, "vec_id", "v", m.frame(s)), nodes).select("vec_id", "node", "cluster")


@query("ml_pca")
def _(s, d):
    v = vectors(s, d)
    means = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("_m"))
    centred = v.crossJoin(F.broadcast(means)).withColumn("x", array_to_vector(F.zip_with("v", "_m", lambda a, b: a - b)))
    return PCA(k=2, inputCol="x", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("p")).select("vec_id", c("p")[0].alias("pc1"), c("p")[1].alias("pc2"))


# --- text features and classifiers

ASCII_WORDS = r"\b[0-9A-Za-z_][0-9A-Za-z_]+\b"
TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_]{2,}')) AS term FROM documents"


@query(
    "ml_tfidf",
    f"WITH t AS (SELECT doc_id, term, count(*) AS tf FROM ({TOKENS}) GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM t GROUP BY 1 HAVING count(*) >= 3 ORDER BY cf DESC, term LIMIT 5000), w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN v USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
)
def _(s, d):
    words = F.regexp_extract_all(F.lower("text"), lit("[0-9a-z_]{2,}"), lit(0))
    return classify.tfidf(table(s, d, "documents"), "doc_id", words).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tx_bigrams", "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[0-9a-z_]{2,}') AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS term FROM w) SELECT term, count(*) AS n FROM g GROUP BY 1")
def _(s, d):
    words = F.regexp_extract_all(F.lower("text"), lit("[0-9a-z_]{2,}"), lit(0))
    return table(s, d, "conversations").select(F.explode(classify.grams(words)).alias("term")).groupBy("term").agg(F.count(lit(1)).alias("n"))


def profile_vectors(s, d) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", "text", F.log1p("n_chars").alias("size"), text.count_of(c("text"), r"[.,]").cast("double").alias("stops"), text.count_of(c("text"), "[A-Z]").cast("double").alias("capitals"), text.count_of(c("text"), "[0-9@$%&#*]").cast("double").alias("signs"))
    rows = rows.withColumns({x: F.log1p(x) for x in ("stops", "capitals", "signs")})
    return rows.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")


NUMERIC = ["size", "stops", "capitals", "signs"]


def ready(s, d) -> DataFrame:
    """Labelled documents with their numbers, scaled. The numbers are held, so that the texts are read once."""
    numbers = profile_vectors(s, d).select("doc_id", "quality", *NUMERIC)
    numbers = classify.in_parts(numbers, table(s, d, "labels").count()).cache()
    z = features.standardise(numbers, {x: [x] for x in NUMERIC})
    return VectorAssembler(inputCols=[f"{x}_z" for x in NUMERIC], outputCol="features").transform(z)


@query("ml_lr")
def _(s, d):
    rows = ready(s, d)
    return classify.probability(classify.logistic(rows, "quality"), rows, "p").select("doc_id", "quality", "p")


@query("ml_nb")
def _(s, d):
    rows = profile_vectors(s, d)
    terms = classify.sparse(rows.select("doc_id", "text"), "doc_id", {"": classify.tokens(c("text"))})
    with_terms, _ = classify.vectors(terms, "doc_id", rows.select("doc_id", "quality"))
    with_terms = with_terms.cache()
    return classify.probability(classify.naive_bayes(with_terms, "quality"), with_terms, "p").select("doc_id", "quality", "p")


@query("ml_svm")
def _(s, d):
    rows = ready(s, d)
    return classify.CalibratedSvm(rows, "quality", "doc_id").probability(rows, "p").select("doc_id", "quality", "p")


@query("ml_rfe")
def _(s, d):
    rows = ready(s, d)
    kept = classify.eliminate(rows, "quality", [f"{x}_z" for x in NUMERIC], 2)
    return s.createDataFrame([(x,) for x in kept], "feature string")


@query("ml_oof")
def _(s, d):
    models = {"lr": lambda train: (lambda m: lambda df, name: classify.probability(m, df, name))(classify.logistic(train, "quality")), "svm": lambda train: classify.CalibratedSvm(train, "quality", "doc_id", folds=2).probability}
    scored = classify.out_of_fold(ready(s, d), "doc_id", "quality", lit(True), models, k=3)
    return classify.consensus_flags(scored, "quality", ["p_lr", "p_svm"]).select("doc_id", "quality", "fold", "p_label", "flagged")


# --- rules

ITEMS = {"long": "n_chars > 3000", "short": "n_chars < 800", "english": "lang = 'en'", "marked": "regexp_matches(text, '[$%&#*]')", "lined": "contains(text, chr(10))", "good": "quality = 1", "poor": "quality = 0"}
BASKETS = "(SELECT d.doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in ITEMS.items()) + "], lambda x: x IS NOT NULL)) AS items FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def baskets(s, d) -> DataFrame:
    t = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    conditions = {"long": c("n_chars") > 3000, "short": c("n_chars") < 800, "english": c("lang") == "en", "marked": c("text").rlike("[$%&#*]"), "lined": c("text").contains("\n"), "good": c("quality") == 1, "poor": c("quality") == 0}
    return t.select("doc_id", "quality", rules.basket(conditions).alias("items"))


@query(
    "ml_itemsets",
    f"WITH b AS {BASKETS}, u AS (SELECT doc_id, unnest(items) AS i FROM b), one AS (SELECT i AS a, count(*) AS n FROM u GROUP BY 1), two AS (SELECT x.i || ', ' || y.i AS a, count(*) AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.i < y.i GROUP BY 1), three AS (SELECT x.i || ', ' || y.i || ', ' || z.i AS a, count(*) AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.i < y.i JOIN u z ON x.doc_id = z.doc_id AND y.i < z.i GROUP BY 1) SELECT a AS items, n AS freq FROM (FROM one UNION ALL FROM two UNION ALL FROM three) WHERE n >= 0.05 * (SELECT count(*) FROM b)",
)
def _(s, d):
    sets, _ = rules.itemsets(baskets(s, d), "items", 0.05, 3)
    return sets.select(F.array_join("items", ", ").alias("items"), "freq")


@query("ml_rules")
def _(s, d):
    _, model = rules.itemsets(baskets(s, d), "items", 0.02)
    return rules.label_rules(model, ["good", "poor"])


VIOLATED = "(VALUES ('english, lined', 'good'), ('long', 'good'), ('marked', 'poor')) r(lhs, label)"


@query("ml_rule_violators", f"WITH b AS {BASKETS} SELECT doc_id, count(*) AS n_rules_broken FROM b, {VIOLATED} WHERE list_has_all(items, string_split(lhs, ', ')) AND list_contains(items, CASE label WHEN 'good' THEN 'poor' ELSE 'good' END) GROUP BY 1")
def _(s, d):
    r = s.createDataFrame([("english, lined", "good"), ("long", "good"), ("marked", "poor")], "lhs string, label string")
    return rules.violators(baskets(s, d), "doc_id", "items", r, ["good", "poor"])


@query("ml_item_support", f"WITH b AS (SELECT x.*, quality FROM {BASKETS} x JOIN labels l ON x.doc_id = l.doc_id), u AS (SELECT quality, unnest(items) AS item FROM b), n AS (SELECT count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1 FROM b) SELECT item, round(count(*) FILTER (quality = 0) / any_value(n0), 9) AS support_0, round(count(*) FILTER (quality = 1) / any_value(n1), 9) AS support_1 FROM u, n GROUP BY 1")
def _(s, d):
    return rules.item_support(baskets(s, d), "items", "quality").select("item", F.round("support_0", 9).alias("support_0"), F.round("support_1", 9).alias("support_1"))


@query("vz_hexbin")
def _(s, d):
    return charts.hexbin(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 20, 8, "l_discount")
