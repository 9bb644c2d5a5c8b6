"""Queries over the star-schema tables: projections, filters, joins, aggregates, windows, sorts, sets, reshapes. Each is (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labelsift.functions.numeric import case, clip_low, flag, recode
from labelsift.operators import charts, entity, features, quality, stats
from labelsift.sources.tables import table

c, lit = F.col, F.lit
PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
QUERIES: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def nulled(t: DataFrame) -> DataFrame:
    """Orders with nulls for every 7th price and status 'P'."""
    return t.withColumn("price", F.when(c("o_orderkey") % 7 != 0, c("o_totalprice"))).withColumn("status", F.nullif("o_orderstatus", lit("P")))


NULLED = "(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, nullif(o_orderstatus, 'P') AS status FROM orders)"


# --- projections


@query("pr_select_rename_drop", "SELECT o_orderkey AS order_id, o_custkey AS who, o_orderstatus FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").drop("o_orderpriority").withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "who"})


@query("pr_recode", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS code FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", recode(c("o_orderpriority"), PRIORITY).alias("code"))


@query("pr_case", f"SELECT o_orderkey, CASE WHEN price > 250000 THEN 'high' WHEN price > 100000 THEN 'middle' WHEN price IS NULL THEN 'none' ELSE 'low' END AS band FROM {NULLED}")
def _(s, d):
    p = c("price")
    return nulled(table(s, d, "orders")).select("o_orderkey", case((p > 250000, "high"), (p > 100000, "middle"), (p.isNull(), "none"), otherwise="low").alias("band"))


@query("pr_null_mask", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_extendedprice END AS kept FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(c("l_discount") > 0.05, c("l_extendedprice")).alias("kept"))


@query("pr_bool_int", f"SELECT o_orderkey, coalesce(price > 150000, false)::INT AS high FROM {NULLED}")
def _(s, d):
    return nulled(table(s, d, "orders")).select("o_orderkey", flag(c("price") > 150000).alias("high"))


@query("pr_impute_constant", f"SELECT o_orderkey, coalesce(price, 0.0) AS price, coalesce(status, '') AS status FROM {NULLED}")
def _(s, d):
    return features.fill(nulled(table(s, d, "orders")).select("o_orderkey", "price", "status"), {"price": 0.0, "status": ""})


@query("pr_impute_median", f"SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {NULLED})) AS price FROM {NULLED}")
def _(s, d):
    return features.impute_median(nulled(table(s, d, "orders")).select("o_orderkey", "price"), ["price"])


@query("pr_clip_low", f"SELECT o_orderkey, CASE WHEN price < 100000 THEN 100000 ELSE price END AS price FROM {NULLED}")
def _(s, d):
    return nulled(table(s, d, "orders")).select("o_orderkey", clip_low(c("price"), 100000.0).alias("price"))


@query("pr_arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("charge"))


@query("pr_zip_strings", f"SELECT o_orderkey, 'amend ' || coalesce(status, '?') || ' to ' || o_orderpriority AS says FROM {NULLED}")
def _(s, d):
    return nulled(table(s, d, "orders")).select("o_orderkey", F.concat(lit("amend "), F.coalesce("status", lit("?")), lit(" to "), "o_orderpriority").alias("says"))


@query("pr_divmod", "SELECT s_suppkey, (s_suppkey // 7)::BIGINT AS x, s_suppkey % 7 AS y FROM supplier")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.floor(c("s_suppkey") / 7).alias("x"), (c("s_suppkey") % 7).alias("y"))


@query("pr_concat_columns", "SELECT c.c_custkey, c.c_acctbal, o.n FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey")
def _(s, d):
    n = table(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(lit(1)).alias("n"))
    return table(s, d, "customer").select("c_custkey", "c_acctbal").join(n, "c_custkey")


# --- filters


@query("fl_not_equal_keeps_null", f"SELECT o_orderkey FROM {NULLED} WHERE status IS DISTINCT FROM 'F'")
def _(s, d):
    return nulled(table(s, d, "orders")).where(~c("status").eqNullSafe("F")).select("o_orderkey")


@query("fl_equal_drops_null", f"SELECT o_orderkey FROM {NULLED} WHERE status = 'F'")
def _(s, d):
    return nulled(table(s, d, "orders")).where("status = 'F'").select("o_orderkey")


@query("fl_null_tests", f"SELECT o_orderkey FROM {NULLED} WHERE price IS NULL AND status IS NOT NULL")
def _(s, d):
    return nulled(table(s, d, "orders")).where(c("price").isNull() & c("status").isNotNull()).select("o_orderkey")


@query("fl_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def _(s, d):
    return table(s, d, "orders").where(c("o_totalprice").between(100000, 200000)).select("o_orderkey")


@query("fl_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')")
def _(s, d):
    return table(s, d, "orders").where(c("o_orderpriority").isin("1-URGENT", "5-LOW") & ~c("o_orderstatus").isin("P")).select("o_orderkey")


@query("fl_logic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 OR l_discount < 0.02) AND NOT (l_returnflag = 'R')")
def _(s, d):
    return table(s, d, "lineitem").where(((c("l_quantity") > 40) | (c("l_discount") < 0.02)) & ~(c("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("fl_strings", "SELECT p_partkey FROM part WHERE (starts_with(p_name, 'a') OR ends_with(p_type, 'L') OR contains(p_name, 'e')) AND regexp_matches(p_brand, '[13]$')")
def _(s, d):
    return table(s, d, "part").where((c("p_name").startswith("a") | c("p_type").endswith("L") | c("p_name").contains("e")) & c("p_brand").rlike("[13]$")).select("p_partkey")


@query("fl_all_of", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.01 AND l_tax > 0.01")
def _(s, d):
    tests = F.array(c("l_quantity") > 10, c("l_discount") > 0.01, c("l_tax") > 0.01)
    return table(s, d, "lineitem").where(F.forall(tests, lambda x: x)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("fl_any_all", f"SELECT bool_or(price IS NULL) AS some_missing, bool_and(o_totalprice > 0) AS all_positive, count(*) FILTER (status IS NULL) AS missing FROM {NULLED}")
def _(s, d):
    return nulled(table(s, d, "orders")).agg(F.bool_or(c("price").isNull()).alias("some_missing"), F.bool_and(c("o_totalprice") > 0).alias("all_positive"), F.count_if(c("status").isNull()).alias("missing"))


@query("fl_array_contains", "SELECT o_custkey FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS st FROM orders GROUP BY 1) WHERE list_contains(st, 'P')")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("st")).where(F.array_contains("st", "P")).select("o_custkey")


# --- joins


@query("jn_lookup", "SELECT c.c_custkey, m.most FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1) m ON m.o_custkey = c.c_custkey")
def _(s, d):
    most = table(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    return table(s, d, "customer").select("c_custkey").join(most, "c_custkey", "left")


@query("jn_inner", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("jn_semi", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)")
def _(s, d):
    poor = table(s, d, "customer").where("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(poor, "o_custkey", "left_semi").select("o_orderkey")


@query("jn_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def _(s, d):
    held = table(s, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(held, "c_custkey", "left_anti").select("c_custkey")


@query("jn_key_aligned", "SELECT k.n_nationkey, n.n_name FROM (SELECT unnest(range(0, 30))::INT AS n_nationkey) k LEFT JOIN nation n USING (n_nationkey)")
def _(s, d):
    return s.range(30).select(c("id").cast("int").alias("n_nationkey")).join(F.broadcast(table(s, d, "nation").select("n_nationkey", "n_name")), "n_nationkey", "left")  # 25 rows, fixed


@query("jn_gather", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def _(s, d):
    return table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")  # 25 rows, fixed


@query("jn_scalar", "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 4) AS above FROM part")
def _(s, d):
    part = table(s, d, "part")
    return part.crossJoin(F.broadcast(part.agg(F.avg("p_retailprice").alias("m")))).select("p_partkey", F.round(c("p_retailprice") - c("m"), 4).alias("above"))


@query("jn_set_equality", "SELECT count(*) FILTER (o.k IS NULL) AS only_left, count(*) FILTER (c.k IS NULL) AS only_right FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k")
def _(s, d):
    return quality.key_sets(table(s, d, "customer").select(c("c_custkey").alias("k")), table(s, d, "orders").select(c("o_custkey").alias("k")), "k")


# --- aggregates


@query("ag_counts", "SELECT count(*) AS n, count(*) FILTER (l_quantity > 25) AS many FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").agg(F.count(lit(1)).alias("n"), F.count_if(c("l_quantity") > 25).alias("many"))


@query("ag_group_size", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count(lit(1)).alias("n"))


@query("ag_distinct", f"SELECT count(DISTINCT status) AS states, count(DISTINCT o_custkey) AS customers, count(DISTINCT status) + max((status IS NULL)::INT) AS states_with_null FROM {NULLED}")
def _(s, d):
    return nulled(table(s, d, "orders")).agg(F.count_distinct("status").alias("states"), F.count_distinct("o_custkey").alias("customers"), entity.distinct_with_null("status").alias("states_with_null"))


@query("ag_conflict", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b")).where("a <> b").select("o_custkey")


@query(
    "ag_basic",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_discount) AS hi, round(stddev_pop(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("p"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.round(F.var_samp("l_quantity"), 6).alias("v"), F.count(lit(1)).alias("n")
    )


@query("ag_median_quantile", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.75), 4) AS q3 FROM customer GROUP BY 1")
def _(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.median("c_acctbal"), 4).alias("m"), F.round(F.percentile("c_acctbal", 0.25), 4).alias("q1"), F.round(F.percentile("c_acctbal", 0.75), 4).alias("q3"))


@query("ag_skew_g1", "SELECT c_nationkey, round(skewness(c_acctbal), 6) AS g1 FROM customer GROUP BY 1 HAVING count(*) > 2")
def _(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.round(stats.skew_g1("c_acctbal"), 6).alias("g1"), F.count(lit(1)).alias("n")).where("n > 2").drop("n")


@query("ag_share", "SELECT o_orderpriority, round(100 * avg((o_orderstatus = 'F')::INT), 6) AS pct FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.round(100 * stats.share(c("o_orderstatus") == "F"), 6).alias("pct"))


@query("ag_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand")
def _(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.count(lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand")


@query("ag_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(s, d):
    wide = table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(k, lit(0)).alias(k.lower()) for k in ("F", "O", "P")])


@query("ag_dense_bins", "SELECT b.bin, coalesce(sum(l_quantity), 0)::BIGINT AS w FROM (SELECT unnest(range(0, 60)) AS bin) b LEFT JOIN lineitem l ON floor(l.l_quantity)::BIGINT = b.bin GROUP BY 1")
def _(s, d):
    per = table(s, d, "lineitem").groupBy(F.floor("l_quantity").alias("bin")).agg(F.sum("l_quantity").alias("w"))
    return s.range(60).withColumnRenamed("id", "bin").join(per, "bin", "left").select("bin", F.coalesce("w", lit(0)).cast("long").alias("w"))


@query("ag_guarded_ratio", f"SELECT o_custkey, round(coalesce(sum(price), 0) / greatest(count(status), 1), 6) AS r FROM {NULLED} GROUP BY 1")
def _(s, d):
    return nulled(table(s, d, "orders")).groupBy("o_custkey").agg(F.round(F.coalesce(F.sum("price"), lit(0.0)) / F.greatest(F.count("status"), lit(1)), 6).alias("r"))


@query(
    "ag_summary",
    'SELECT count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS "min", round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS "max" FROM events',
)
def _(s, d):
    out = stats.summary(table(s, d, "events"), "value")
    return out.select("count", *[F.round(x, 6).alias(x) for x in ("mean", "std")], "min", *[F.round(x, 6).alias(x) for x in ("p25", "p50", "p75")], "max")


@query(
    "ag_missing",
    f"SELECT 'price' AS \"column\", round(100 * avg((price IS NULL)::INT), 6) AS missing_pct FROM {NULLED} UNION ALL SELECT 'status', round(100 * avg((status IS NULL)::INT), 6) FROM {NULLED}",
)
def _(s, d):
    return charts.missing_shares(nulled(table(s, d, "orders")).select("price", "status")).select("column", F.round("missing_pct", 6).alias("missing_pct"))


@query("ag_duplicates", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").agg(quality.duplicates("l_orderkey", "l_linenumber").alias("n"))


@query("ag_distinct_values", "SELECT DISTINCT p_type FROM part")
def _(s, d):
    return table(s, d, "part").select("p_type").distinct()


@query("ag_multi_key", "SELECT event_type, user_id % 3 AS g, count(*) AS n, round(avg(value), 6) AS m FROM events GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "events").groupBy("event_type", (c("user_id") % 3).alias("g")).agg(F.count(lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("m"))


@query("ag_size_buckets", "SELECT CASE WHEN n <= 3 THEN n::VARCHAR WHEN n <= 9 THEN '4-9' ELSE '10+' END AS bucket, count(*) AS groups FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def _(s, d):
    return charts.group_size_buckets(table(s, d, "orders"), "o_custkey")


@query("ag_label_map", "SELECT c_nationkey, list_aggregate(list(x ORDER BY x), 'string_agg', ',') AS counts FROM (SELECT c_nationkey, c_mktsegment || '=' || count(*) AS x FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY 1")
def _(s, d):
    cells = table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(lit(1)).alias("n"))
    m = cells.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    return m.select("c_nationkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias("counts"))


# --- windows


@query("wn_group_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(s, d):
    return entity.with_group_size(table(s, d, "orders"), "o_custkey", "n").select("o_orderkey", "n")


@query("wn_best_row", f"SELECT o_custkey, o_orderkey, price, status FROM {NULLED} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS LAST, o_orderkey) = 1")
def _(s, d):
    return entity.best_rows(nulled(table(s, d, "orders")), "o_custkey", "price", "o_orderkey").select("o_custkey", "o_orderkey", "price", "status")


@query("wn_best_row_with_maxima", f"SELECT o_custkey, o_orderkey, most FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most, row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS LAST, o_orderkey) AS rn FROM {NULLED}) WHERE rn = 1")
def _(s, d):
    return entity.best_with_maxima(nulled(table(s, d, "orders")), "o_custkey", "price", "o_orderkey", ["o_totalprice"]).select("o_custkey", "o_orderkey", c("o_totalprice").alias("most"))


@query("wn_group_max", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("most"))


@query(
    "wn_loo",
    f"SELECT o_orderkey, sum((price IS NOT NULL)::INT) OVER w - (price IS NOT NULL)::INT AS others_n, sum((price IS NOT NULL AND o_orderstatus = 'F')::INT) OVER w - (price IS NOT NULL AND o_orderstatus = 'F')::INT AS others_hits FROM {NULLED} WINDOW w AS (PARTITION BY o_custkey)",
)
def _(s, d):
    return entity.leave_one_out(nulled(table(s, d, "orders")), "o_custkey", c("o_orderstatus") == "F", c("price").isNotNull()).select("o_orderkey", "others_n", "others_hits")


@query("wn_lag", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS change FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(c("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), 4).alias("change"))


@query("wn_renumber", "SELECT c_nationkey, row_number() OVER (ORDER BY avg(c_acctbal), c_nationkey) AS k FROM customer GROUP BY 1")
def _(s, d):
    per = table(s, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return per.select("c_nationkey", F.row_number().over(Window.orderBy("m", "c_nationkey")).cast("long").alias("k"))


@query("wn_cumsum", "SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before FROM orders")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(s, d, "orders").select("o_orderkey", F.round(F.coalesce(F.sum("o_totalprice").over(w), lit(0.0)), 2).alias("before"))


@query("wn_quartile_flags", "SELECT c_custkey, (c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.25) FROM customer))::INT AS low, (c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.75) FROM customer))::INT AS high FROM customer")
def _(s, d):
    t = table(s, d, "customer")
    q = t.agg(F.percentile("c_acctbal", 0.25).alias("q1"), F.percentile("c_acctbal", 0.75).alias("q3"))
    return t.crossJoin(F.broadcast(q)).select("c_custkey", flag(c("c_acctbal") <= c("q1")).alias("low"), flag(c("c_acctbal") >= c("q3")).alias("high"))


@query("wn_share_of_total", "SELECT c_mktsegment, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def _(s, d):
    per = table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(lit(1)).alias("n"))
    return per.select("c_mktsegment", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


# --- sorts, sets, reshapes


@query("so_multi_key", f"SELECT o_orderkey, status, price FROM {NULLED} ORDER BY status ASC NULLS FIRST, price DESC NULLS LAST, o_orderkey")
def _(s, d):
    return nulled(table(s, d, "orders")).select("o_orderkey", "status", "price").orderBy(c("status").asc_nulls_first(), c("price").desc_nulls_last(), "o_orderkey")


@query("so_by_expression", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def _(s, d):
    return table(s, d, "customer").orderBy(F.abs("c_acctbal").desc(), "c_custkey").select("c_custkey")


@query("so_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def _(s, d):
    return table(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("so_extremes", "(SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 15) UNION ALL (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15)")
def _(s, d):
    t = table(s, d, "part")
    return t.orderBy("p_retailprice", "p_partkey").limit(15).union(t.orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)).select("p_partkey")


@query("se_union_by_name", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(s, d):
    a = table(s, d, "supplier").select(c("s_suppkey").alias("k"), c("s_name").alias("name"), c("s_acctbal").alias("bal"))
    b = table(s, d, "customer").select(c("c_mktsegment").alias("seg"), c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("se_bag_counts", "SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT l_suppkey FROM lineitem WHERE l_tax > 0.06) GROUP BY 1")
def _(s, d):
    t = table(s, d, "lineitem")
    return t.where("l_discount > 0.08").select(c("l_suppkey").alias("k")).union(t.where("l_tax > 0.06").select("l_suppkey")).groupBy("k").agg(F.count(lit(1)).alias("n"))


@query("rs_unpivot", "UNPIVOT (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME what VALUE x")
def _(s, d):
    k = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return table(s, d, "lineitem").select(*k, "l_discount", "l_tax").unpivot(k, ["l_discount", "l_tax"], "what", "x")


@query("rs_split_join", "SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ', ') AS words, len(string_split(p_name, ' '))::INT AS n FROM part")
def _(s, d):
    words = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(words), ", ").alias("words"), F.size(words).alias("n"))


@query("rs_grid_long", "SELECT (k // 10)::BIGINT AS x, k % 10 AS y, n FROM (SELECT l_suppkey % 100 AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def _(s, d):
    per = table(s, d, "lineitem").groupBy((c("l_suppkey") % 100).alias("k")).agg(F.count(lit(1)).alias("n"))
    return per.select(F.floor(c("k") / 10).alias("x"), (c("k") % 10).alias("y"), "n")


# --- quality and charts


@query("dq_fd_check", "SELECT 'o_orderstatus' AS attribute, count(*) FILTER (a > 1) AS keys FROM (SELECT count(DISTINCT o_orderstatus) AS a FROM orders GROUP BY o_custkey) UNION ALL SELECT 'o_custkey', count(*) FILTER (a > 1) FROM (SELECT count(DISTINCT o_custkey) AS a FROM orders GROUP BY o_custkey)")
def _(s, d):
    t = table(s, d, "orders").withColumn("key", c("o_custkey"))
    return entity.dependency_violations(t, "key", ["o_orderstatus", "o_custkey"])


@query("dq_conflicts", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1)")
def _(s, d):
    return entity.conflicts(table(s, d, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey")


@query(
    "dq_dictionary",
    f"SELECT 'o_orderkey' AS \"column\", count(*) FILTER (o_orderkey IS NULL) AS missing, count(DISTINCT o_orderkey) AS n_unique FROM {NULLED} UNION ALL SELECT 'price', count(*) FILTER (price IS NULL), count(DISTINCT price) FROM {NULLED} UNION ALL SELECT 'status', count(*) FILTER (status IS NULL), count(DISTINCT status) FROM {NULLED}",
)
def _(s, d):
    return quality.dictionary(nulled(table(s, d, "orders")).select("o_orderkey", "price", "status")).select("column", "missing", "n_unique")


@query("dq_checks", "SELECT 'keys unique' AS check_name, count(*) = count(DISTINCT o_orderkey) AS ok FROM orders UNION ALL SELECT 'prices positive', bool_and(o_totalprice > 0) FROM orders UNION ALL SELECT 'priorities known', bool_and(o_orderpriority LIKE '1%') FROM orders")
def _(s, d):
    return quality.checks(table(s, d, "orders"), {"keys unique": quality.duplicates("o_orderkey") == 0, "prices positive": quality.all_rows(c("o_totalprice") > 0), "priorities known": quality.all_rows(c("o_orderpriority").startswith("1"))})


@query(
    "vz_histogram",
    "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT unnest(range(0, 40))::INT AS bin), h AS (SELECT least(floor((value - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT b.bin, coalesce(n, 0)::BIGINT AS n FROM b LEFT JOIN h USING (bin)",
)
def _(s, d):
    return charts.histogram(table(s, d, "events"), "value", 40).select("bin", "n")


@query(
    "vz_stacked",
    "SELECT c_mktsegment, c_nationkey, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share, round(coalesce(sum(n) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS \"left\" FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)",
)
def _(s, d):
    return charts.stacked(table(s, d, "customer"), "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", F.round("share", 6).alias("share"), F.round("left", 6).alias("left"))
