"""Windows, orders, samples and splits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import ranks as R
from quern.operators.aggregates import r6
from quern.plans.registry import query
from quern.sources.relations import DIST, OBS, TAXA, distribution, observations, taxa
from quern.sources.tables import table


@query("SELECT l_orderkey, l_linenumber, (rank() OVER w + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2)::DOUBLE AS r FROM lineitem WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_quantity)")
def e01_average_rank(spark, d):
    return R.with_average_ranks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_linenumber"], {"r": "l_quantity"}).select("l_orderkey", "l_linenumber", F.col("r").cast("double").alias("r"))


@query("SELECT c_custkey, round(CASE WHEN stddev_pop(c_acctbal) OVER w > 1.5e-8 THEN (c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w ELSE 0 END, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def e02_zscore(spark, d):
    return R.with_zscore(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "z").select("c_custkey", r6("z").alias("z"))


@query("SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS centred FROM supplier")
def e03_group_centring(spark, d):
    return R.with_centred(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", "centred").select("s_suppkey", F.round("centred", 4).alias("centred"))


@query("SELECT s_suppkey, s_nationkey FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n >= 5")
def e04_group_size_filter(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(s.groupBy("s_nationkey").count().where("count >= 5"), "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM lineitem")
def e05_exclusive_prefix_sum(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("prefix"))


@query("SELECT c_nationkey, c_custkey, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def e06_top_k_per_group(spark, d):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").withColumn("r", r).where("r <= 3").select("c_nationkey", "c_custkey", "r")


@query(f"""WITH {DIST}, {TAXA}, n AS (SELECT family, resource, count(*) AS n FROM dist JOIN taxa USING (resource) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n, resource) AS r, count(*) OVER (PARTITION BY family) AS m FROM n)
SELECT family, CASE WHEN r <= floor(m / 3) THEN 'low' WHEN r <= floor(2 * m / 3) THEN 'middle' ELSE 'high' END AS tertile, count(*)::BIGINT AS resources, round(avg(n), 6) AS mean FROM t GROUP BY 1, 2""")
def e07_rank_tertiles(spark, d):
    n = distribution(spark, d).join(taxa(spark, d), "resource").groupBy("family", "resource").agg(F.count("*").alias("n"))
    return R.with_tertile(n, ["family"], "n", "resource", "tertile").groupBy("family", "tertile").agg(F.count("*").alias("resources"), r6(F.avg("n")).alias("mean"))


@query(f"WITH {OBS}, s AS (SELECT species, day, sum(value) AS x FROM obs GROUP BY 1, 2), l AS (SELECT species, x, lag(x) OVER (PARTITION BY species ORDER BY day) AS p FROM s) SELECT species, round(corr(x, p), 6) AS lag1 FROM l WHERE p IS NOT NULL GROUP BY 1")
def e08_lag1_autocorrelation(spark, d):
    s = observations(spark, d).groupBy("species", "day").agg(F.sum("value").alias("x"))
    lagged = s.withColumn("p", F.lag("x").over(Window.partitionBy("species").orderBy("day"))).where("p is not null")
    return lagged.groupBy("species").agg(r6(F.corr("x", "p")).alias("lag1"))


@query(f"""WITH {OBS}, s AS (SELECT species, row_number() OVER (PARTITION BY species ORDER BY day) AS i, sum(value) - avg(sum(value)) OVER (PARTITION BY species) AS x, count(*) OVER (PARTITION BY species) AS n FROM obs GROUP BY species, day),
c AS (SELECT a.species, b.i - a.i AS k, sum(a.x * b.x) AS c FROM s a JOIN s b ON a.species = b.species AND b.i BETWEEN a.i AND a.i + 9 GROUP BY 1, 2), r AS (SELECT species, k, c / first_value(c) OVER (PARTITION BY species ORDER BY k) AS rho FROM c),
p AS (SELECT a.species, a.k // 2 AS m, a.rho + b.rho AS pair FROM r a JOIN r b ON a.species = b.species AND b.k = a.k + 1 WHERE a.k % 2 = 0), stop AS (SELECT species, min(m) AS m FROM p WHERE pair <= 0 GROUP BY 1)
SELECT p.species, round(max(n) / greatest(1, -1 + 2 * coalesce(sum(pair) FILTER (stop.m IS NULL OR p.m < stop.m), 0)), 4) AS ess FROM p LEFT JOIN stop USING (species) JOIN (SELECT DISTINCT species, n FROM s) USING (species) GROUP BY 1""")
def e09_effective_sample_size(spark, d):
    w = Window.partitionBy("species")
    s = observations(spark, d).groupBy("species", "day").agg(F.sum("value").alias("v"))
    s = s.select("species", F.row_number().over(w.orderBy("day")).alias("i"), (F.col("v") - F.avg("v").over(w)).alias("x"), F.count("*").over(w).alias("n"))
    lags = s.select("species", F.explode(F.sequence(F.col("i"), F.col("i") + 9)).alias("i"), F.col("i").alias("at"), F.col("x").alias("y"))
    c = s.join(lags, ["species", "i"]).groupBy("species", (F.col("i") - F.col("at")).alias("k")).agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    rho = c.withColumn("rho", F.col("c") / F.first("c").over(w.orderBy("k")))
    pairs = rho.groupBy("species", F.floor(F.col("k") / 2).alias("m")).agg(F.sum("rho").alias("pair"))
    kept = pairs.withColumn("ok", F.min(F.when(F.col("pair") > 0, 1).otherwise(0)).over(w.orderBy("m")))
    n = s.groupBy("species").agg(F.max("n").alias("n"))
    total = kept.groupBy("species").agg(F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("pair"))), F.lit(0.0)).alias("t"))
    return total.join(n, "species").select("species", F.round(F.col("n") / F.greatest(F.lit(1.0), 2 * F.col("t") - 1), 4).alias("ess"))


@query("SELECT n_nationkey, CASE WHEN r <= 4 THEN 0 WHEN r <= 10 THEN 1 WHEN r <= 19 THEN 2 WHEN r <= 25 THEN 3 END::INTEGER AS block FROM (SELECT *, row_number() OVER (ORDER BY n_name, n_nationkey) AS r FROM nation)")
def e10_ordered_blocks(spark, d):
    one = table(spark, d, "nation").withColumn("all", F.lit(0))
    return R.with_ordered_block(one, ["all"], ["n_name", "n_nationkey"], [4, 6, 9, 6], "block").select("n_nationkey", "block")


@query("WITH q AS (SELECT s_nationkey, [quantile_cont(s_acctbal, 0.25), quantile_cont(s_acctbal, 0.5), quantile_cont(s_acctbal, 0.75)] AS cuts FROM supplier GROUP BY 1) SELECT s_suppkey, (SELECT count(*) FROM unnest(cuts) AS u(c) WHERE c <= s_acctbal)::INTEGER AS stratum FROM supplier JOIN q USING (s_nationkey)")
def e11_quantile_strata(spark, d):
    s = table(spark, d, "supplier")
    found = R.exact_quantiles(s, ["s_nationkey"], "s_acctbal", {"low": 0.25, "mid": 0.5, "high": 0.75})
    cuts = found.select("s_nationkey", F.array("low", "mid", "high").alias("cuts"))
    return s.join(cuts, "s_nationkey").select("s_suppkey", F.size(F.filter("cuts", lambda c: c <= F.col("s_acctbal"))).alias("stratum"))


@query(f"WITH {OBS}, c AS (SELECT dataset, (day - DATE '2024-01-01')::BIGINT AS t, count(*) AS n FROM obs GROUP BY 1, 2) SELECT dataset, t, min(t) OVER w AS first_before, max(t) OVER w AS last_before, (t - max(t) OVER w)::BIGINT AS recency FROM c WINDOW w AS (PARTITION BY dataset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def e12_seen_before(spark, d):
    c = observations(spark, d).select("dataset", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("t")).distinct()
    w = Window.partitionBy("dataset").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    return c.select("dataset", "t", F.min("t").over(w).alias("first_before"), F.max("t").over(w).alias("last_before"), (F.col("t") - F.max("t").over(w)).alias("recency"))


@query(f"WITH {OBS}, l AS (SELECT event_id, species, dataset, day, lead(day) OVER (PARTITION BY dataset, species ORDER BY ts, event_id) AS again FROM obs) SELECT event_id, again IS NOT NULL AND again - day <= 3 AS repeats FROM l")
def e13_repeat_before_next(spark, d):
    again = F.lead("day").over(Window.partitionBy("dataset", "species").orderBy("ts", "event_id"))
    return observations(spark, d).select("event_id", F.coalesce(F.datediff(again, "day") <= 3, F.lit(False)).alias("repeats"))


@query(f"WITH {OBS} SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY species) * (SELECT count(*) FROM obs) / (SELECT count(DISTINCT species) FROM obs), 6) AS w FROM obs")
def e14_inverse_frequency_weights(spark, d):
    o = observations(spark, d)
    per = o.groupBy("species").agg(F.count("*").alias("n"))
    scale = per.agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    w = per.crossJoin(F.broadcast(scale)).select("species", r6(F.col("rows") / F.col("kinds") / F.col("n")).alias("w"))
    return o.join(w, "species").select("event_id", "w")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def f01_multi_key_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY sha256('panel|v1|' || c_name), c_name LIMIT 100")
def f02_hash_order_sample(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy(F.sha2(F.concat(F.lit("panel|v1|"), "c_name"), 256), "c_name").limit(100)


@query("WITH s AS (SELECT c_name, row_number() OVER (ORDER BY sha256('panel|v1|' || c_name), c_name) AS r FROM customer QUALIFY r <= 101) SELECT c_name, CASE WHEN r <= 50 THEN 'discovery' ELSE 'holdout' END AS half FROM s")
def f03_half_split(spark, d):
    key = F.sha2(F.concat(F.lit("panel|v1|"), "c_name"), 256)
    panel = table(spark, d, "customer").select("c_name", key.alias("h")).orderBy("h", "c_name").limit(101)
    r = F.row_number().over(Window.orderBy("h", "c_name"))  # of the panel's rows
    return panel.select("c_name", F.when(r <= 50, "discovery").otherwise("holdout").alias("half"))


@query(f"""WITH {DIST}, r AS (SELECT resource, unit, row_number() OVER (PARTITION BY resource ORDER BY sha256(resource || '|' || unit), unit) AS r, count(*) OVER (PARTITION BY resource) AS n FROM dist)
SELECT resource, unit, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.7::DOUBLE, 0))) THEN 'train' ELSE 'eval' END AS part FROM r""")
def f04_hash_ranked_split(spark, d):
    return R.hash_split(distribution(spark, d).select("resource", "unit"), ["resource"], "unit", 0.7)


@query("SELECT c_custkey, (('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM customer")
def f05_hash_fold(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.hash_fold(F.col("c_name"), 5).alias("fold"))


@query("SELECT c_custkey, (('0x' || substr(sha256('tag:' || c_name), 1, 10))::BIGINT % 7)::INTEGER AS fold FROM customer")
def f06_tagged_fold(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.hash_fold(F.concat(F.lit("tag:"), "c_name"), 7, 10).alias("fold"))


@query("SELECT o_orderkey FROM orders ORDER BY sha256('sample:' || o_orderkey), o_orderkey LIMIT 500")
def f09_seeded_row_sample(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.sha2(F.concat(F.lit("sample:"), F.col("o_orderkey").cast("string")), 256), "o_orderkey").limit(500)


@query("SELECT c_custkey, ('0x' || substr(sha256('seed|' || c_name), 1, 15))::BIGINT AS seed FROM customer")
def f12_stable_seed(spark, d):
    seed = F.conv(F.substring(F.sha2(F.concat(F.lit("seed|"), "c_name"), 256), 1, 15), 16, 10).cast("long")
    return table(spark, d, "customer").select("c_custkey", seed.alias("seed"))


@query("SELECT i, round(list_sum(list_transform(range(0, 41), lambda k: floor(i / pow(2.0, k)) % 2 * pow(2.0, -(k + 1)))), 9) AS h2, round(list_sum(list_transform(range(0, 41), lambda k: floor(i / pow(3.0, k)) % 3 * pow(3.0, -(k + 1)))), 9) AS h3 FROM (SELECT c_custkey AS i FROM customer)")
def f13_halton_sequence(spark, d):
    """A point of the plane for each customer, by the key's place in the sequence."""
    i = F.col("c_custkey")
    return table(spark, d, "customer").select(i.alias("i"), F.round(R.radical_inverse(i, 2), 9).alias("h2"), F.round(R.radical_inverse(i, 3), 9).alias("h3"))


