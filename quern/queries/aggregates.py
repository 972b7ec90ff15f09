"""D10-D47 without the credit family."""

from pyspark.sql import functions as F

from quern.operators import aggregates as A
from quern.operators.aggregates import r6, ratio
from quern.operators.ranks import exact_quantiles
from quern.plans.registry import query
from quern.sources.relations import DIST, EDGES, GROUPS, OBS, POINTS, TAXA, distribution, edges, incidence, observations, points, taxa, unit_groups
from quern.sources.tables import table

ONE = "*"


@query(f"WITH {OBS} SELECT species, count(DISTINCT (dataset, day)) AS effort_days, count(DISTINCT dataset) AS datasets FROM obs GROUP BY 1")
def d10_distinct_effort(spark, d):
    return observations(spark, d).groupBy("species").agg(F.countDistinct("dataset", "day").alias("effort_days"), F.countDistinct("dataset").alias("datasets"))


@query(f"WITH {OBS} SELECT species, week, count(*)::BIGINT AS records, count(*) FILTER (value <= 50)::BIGINT AS precise FROM obs GROUP BY 1, 2")
def d11_conditional_counts(spark, d):
    return observations(spark, d).groupBy("species", "week").agg(F.count(ONE).alias("records"), F.count_if(F.col("value") <= 50).alias("precise"))


@query(f"""WITH {OBS} SELECT species, dataset, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) FILTER (week % 2 = 0)::BIGINT AS even_weeks, count(*) FILTER (week % 2 = 1)::BIGINT AS odd_weeks, round(sum(CASE WHEN week % 2 = 0 THEN value ELSE 0 END), 4) AS even_value FROM obs GROUP BY 1, 2""")
def d12_rollup_with_periods(spark, d):
    even = F.col("week") % 2 == 0
    return observations(spark, d).groupBy("species", "dataset").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count_if(even).alias("even_weeks"), F.count_if(~even).alias("odd_weeks"), F.round(F.sum(F.when(even, F.col("value")).otherwise(0.0)), 4).alias("even_value"))


@query(f"WITH {OBS}, c AS (SELECT species, dataset, week, count(*) AS n FROM obs GROUP BY ALL) SELECT dataset, week, sum(n)::BIGINT AS records, count(*)::BIGINT AS species FROM c GROUP BY 1, 2")
def d13_rollup_to_region_period(spark, d):
    cells = observations(spark, d).groupBy("species", "dataset", "week").agg(F.count(ONE).alias("n"))
    return cells.groupBy("dataset", "week").agg(F.sum("n").alias("records"), F.count(ONE).alias("species"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, count(*)::BIGINT AS n_rows, round(avg((o_totalprice - 150000) * (o_totalprice - 150000)) / 1e6, 4) AS mse FROM orders GROUP BY 1")
def d14_named_aggregates(spark, d):
    off = F.col("o_totalprice") - 150000
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count(ONE).alias("n_rows"), F.round(F.avg(off * off) / 1e6, 4).alias("mse"))


@query(f"WITH {OBS}, m AS (SELECT week, species, avg(value) AS m FROM obs GROUP BY 1, 2) SELECT week, round(avg(m), 6) AS mean_of_means FROM m GROUP BY 1")
def d15_mean_of_group_means(spark, d):
    return A.mean_of_means(observations(spark, d), ["species"], ["week"], "value")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AND min(l_returnflag) = 'N' AS only_n FROM lineitem GROUP BY 1")
def d16_set_valued_equality(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.collect_set("l_returnflag") == F.array(F.lit("N"))).alias("only_n"))


@query(f"WITH {OBS} SELECT species, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM obs GROUP BY 1")
def d17_quantiles(spark, d):
    found = exact_quantiles(observations(spark, d), ["species"], "value", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return found.select("species", *[r6(q).alias(q) for q in ("q25", "q50", "q90")])


@query(f"WITH {OBS}, r AS (SELECT species, value, row_number() OVER (PARTITION BY species ORDER BY value) AS r, count(*) OVER (PARTITION BY species) AS n FROM obs) SELECT species, value AS lower_quantile FROM r WHERE r = floor(0.9 * (n - 1)) + 1")
def d18_lower_quantile(spark, d):
    return A.lower_quantile(observations(spark, d), ["species"], "value", 0.9)


@query("SELECT l_shipmode_bucket AS bucket, round(min(x), 6) AS least, round(quantile_cont(x, 0.025), 6) AS q025, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.975), 6) AS q975, round(max(x), 6) AS largest, round(avg(x), 6) AS mean FROM (SELECT l_linenumber AS l_shipmode_bucket, l_extendedprice AS x FROM lineitem) GROUP BY 1")
def d19_describe(spark, d):
    return A.described(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("bucket"), "l_extendedprice"), ["bucket"], "l_extendedprice")


@query("SELECT l_linenumber, count(*) FILTER (l_discount > 0)::BIGINT AS positive, round(count(*) FILTER (l_discount > 0) / count(*), 6) AS positive_share, round(quantile_cont(CASE WHEN l_discount > 0 THEN l_discount END, 0.5), 6) AS median_positive, round(quantile_cont(l_discount, 0.25), 6) AS q25, round(quantile_cont(l_discount, 0.75), 6) AS q75 FROM lineitem GROUP BY 1")
def d20_zero_inflation(spark, d):
    up = F.col("l_discount") > 0
    li = table(spark, d, "lineitem").withColumn("positive_value", F.when(up, F.col("l_discount")))
    shares = [F.count_if(up).alias("positive"), r6(F.count_if(up) / F.count(ONE)).alias("positive_share")]
    return A.summarised(li, ["l_linenumber"], shares, {"positive_value": {"median_positive": 0.5}, "l_discount": {"q25": 0.25, "q75": 0.75}})


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"WITH {OBS} SELECT week, {', '.join(f'count(*) FILTER (species = {chr(39)}{s}{chr(39)})::BIGINT AS n_{s}' for s in ('click', 'view', 'purchase'))} FROM obs GROUP BY 1")
def d21_crosstab_filled(spark, d):
    wide = observations(spark, d).groupBy("week").pivot("species", ["click", "view", "purchase"]).count().fillna(0)
    return wide.select("week", *[F.col(s).alias(f"n_{s}") for s in ("click", "view", "purchase")])


@query("SELECT l_linenumber, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS qty_a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS qty_n, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS qty_r FROM lineitem GROUP BY 1")
def d22_pivot_long_to_wide(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2))
    return wide.select("l_linenumber", F.col("A").alias("qty_a"), F.col("N").alias("qty_n"), F.col("R").alias("qty_r"))


@query("WITH w AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, round(a / nullif(t, 0), 6) AS share_a, round(n / nullif(t, 0), 6) AS share_n FROM w")
def d23_row_normalise(spark, d):
    part = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    w = table(spark, d, "lineitem").groupBy("l_orderkey").agg(part("A").alias("a"), part("N").alias("n"), F.sum("l_quantity").alias("t"))
    return w.select("l_orderkey", r6(ratio(F.col("a"), F.col("t"))).alias("share_a"), r6(ratio(F.col("n"), F.col("t"))).alias("share_n"))


@query(f"WITH {OBS}, c AS (SELECT dataset, species, count(*) AS n FROM obs GROUP BY 1, 2) SELECT dataset, round(max(n) / sum(n), 6) AS dominance FROM c GROUP BY 1")
def d24_dominance(spark, d):
    c = observations(spark, d).groupBy("dataset", "species").agg(F.count(ONE).alias("n"))
    return c.groupBy("dataset").agg(r6(F.max("n") / F.sum("n")).alias("dominance"))


@query("SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey) - s_acctbal, 2) AS others FROM supplier")
def d26_others_in_group(spark, d):
    s = table(spark, d, "supplier")
    return A.with_others(s, ["s_nationkey"], "s_acctbal", "others").select("s_suppkey", F.round("others", 2).alias("others"))


@query(f"WITH {EDGES}, n AS (SELECT consumer, count(*) AS b FROM edges GROUP BY 1), s AS (SELECT o_orderpriority AS stratum, b FROM n JOIN orders ON o_orderkey = consumer) SELECT stratum, count(*)::BIGINT AS n, round(avg(b), 6) AS mean, round(quantile_cont(b, 0.5), 6) AS median FROM s GROUP BY 1")
def d27_stratified_summary(spark, d):
    b = edges(spark, d).groupBy("consumer").agg(F.count(ONE).alias("b"))
    s = b.join(table(spark, d, "orders"), F.col("consumer") == F.col("o_orderkey"))
    strata = s.where(F.col("o_orderpriority").isin(PRIORITIES) | F.col("o_orderpriority").isNotNull()).select(F.col("o_orderpriority").alias("stratum"), "b")
    return A.summarised(strata, ["stratum"], [F.count(ONE).alias("n"), r6(F.avg("b")).alias("mean")], {"b": {"median": 0.5}})


@query("SELECT coalesce(r_name, '__ALL__') AS region, n_name AS nation, count(*)::BIGINT AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (n_name))")
def d28_super_aggregate(spark, d):
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sets = joined.groupingSets([[F.col("r_name"), F.col("n_name")], [F.col("n_name")]], F.col("r_name"), F.col("n_name"))
    return sets.agg(F.count(ONE).alias("suppliers")).select(F.coalesce("r_name", F.lit("__ALL__")).alias("region"), F.col("n_name").alias("nation"), "suppliers")


@query("""WITH f AS (SELECT o_totalprice AS x, unnest(['all', o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END]) AS label FROM orders)
SELECT label, count(*)::BIGINT AS n, round(avg(x), 4) AS mean FROM f GROUP BY 1""")
def d29_label_fan_out(spark, d):
    labels = F.array(F.lit("all"), F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 150000, "dear").otherwise("cheap"))
    return table(spark, d, "orders").select(F.explode(labels).alias("label"), "o_totalprice").groupBy("label").agg(F.count(ONE).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("""WITH t AS (SELECT l_linenumber AS category, l_discount - l_tax AS delta FROM lineitem) SELECT category, count(*)::BIGINT AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median,
round(count(*) FILTER (delta > 1e-9) / count(*), 6) AS up, round(count(*) FILTER (delta < -1e-9) / count(*), 6) AS down, round(count(*) FILTER (abs(delta) <= 1e-9) / count(*), 6) AS level FROM t GROUP BY 1""")
def d30_delta_distribution(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("category"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))
    part = lambda c: r6(F.count_if(c) / F.count(ONE))
    x = F.col("delta")
    shares = [part(x > 1e-9).alias("up"), part(x < -1e-9).alias("down"), part(F.abs(x) <= 1e-9).alias("level")]
    return A.summarised(t, ["category"], [F.count(ONE).alias("n"), r6(F.avg(x)).alias("mean"), *shares], {"delta": {"median": 0.5}})


@query(f"WITH {DIST} SELECT 'unit' AS axis, unit::BIGINT AS key, count(*)::BIGINT AS margin FROM dist GROUP BY 2 UNION ALL SELECT 'resource', resource, count(*)::BIGINT FROM dist GROUP BY 2")
def d31_incidence_margins(spark, d):
    i = incidence(spark, d)
    side = lambda c: i.groupBy(F.col(c).cast("long").alias("key")).agg(F.count(ONE).alias("margin")).select(F.lit(c).alias("axis"), "key", "margin")
    return side("unit").union(side("resource"))


CONTRAST = """s AS (SELECT block, avg(CASE WHEN arm THEN x END) AS a, avg(CASE WHEN NOT arm THEN x END) AS b, count(*) FILTER (arm) AS na, count(*) FILTER (NOT arm) AS nb FROM t GROUP BY 1), b AS (SELECT a - b AS d, least(na, nb) AS w FROM s WHERE na > 0 AND nb > 0)
SELECT count(*)::BIGINT AS blocks, round(sum(d * w) / sum(w), 6) AS weighted, round(avg(d), 6) AS plain, count(*) FILTER (d > 0)::BIGINT AS up, count(*) FILTER (d < 0)::BIGINT AS down, count(*) FILTER (d = 0)::BIGINT AS level FROM b"""


@query(f"WITH t AS (SELECT c_nationkey AS block, c_mktsegment = 'BUILDING' AS arm, c_acctbal AS x FROM customer), {CONTRAST}")
def d32_matched_block_contrast(spark, d):
    return A.block_contrast(table(spark, d, "customer"), "c_nationkey", F.col("c_mktsegment") == "BUILDING", "c_acctbal")


@query("""SELECT l_linenumber, round(covar_pop(l_discount, l_tax) * 1e4, 6) AS xy, round(var_pop(l_discount) * 1e4, 6) AS xx, round(var_pop(l_tax) * 1e4, 6) AS yy, round(covar_pop(l_discount, l_quantity) * 1e2, 6) AS xz, round(var_pop(l_quantity), 6) AS zz FROM lineitem GROUP BY 1""")
def d33_centred_cross_products(spark, d):
    x, y, z = "l_discount", "l_tax", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(r6(F.covar_pop(x, y) * 1e4).alias("xy"), r6(F.var_pop(x) * 1e4).alias("xx"), r6(F.var_pop(y) * 1e4).alias("yy"), r6(F.covar_pop(x, z) * 1e2).alias("xz"), r6(F.var_pop(z)).alias("zz"))


@query("""WITH s AS (SELECT l_linenumber AS g, l_discount AS x, l_extendedprice / 1000 AS y, l_quantity AS w FROM lineitem), m AS (SELECT g, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) / sum(w) AS xy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy FROM s GROUP BY 1)
SELECT g, round(mx, 6) AS wmean, round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 6) AS wcorr FROM m""")
def d34_weighted_mean_and_corr(spark, d):
    x, y, w = F.col("l_discount"), F.col("l_extendedprice") / 1000, F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(r6(A.weighted_mean(x, w)).alias("wmean"), r6(A.weighted_corr(x, y, w)).alias("wcorr"))


@query(f"""WITH {POINTS}, v AS (SELECT label, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM points GROUP BY 1)
SELECT label, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM v""")
def d35_spherical_mean(spark, d):
    from quern.operators.space import unit_vector

    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    v = points(spark, d).groupBy("label").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))
    return v.select("label", F.round(F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))), 5).alias("lat"), F.round(F.degrees(F.atan2("y", "x")), 5).alias("lon"))


@query(f"""WITH {OBS}, c AS (SELECT species, dataset, week, avg(value) AS v FROM obs GROUP BY ALL), t AS (SELECT a.species, a.week, b.v - a.v AS delta FROM c a JOIN c b ON a.species = b.species AND a.dataset = b.dataset AND b.week = a.week + 1)
SELECT species, week, round(avg(delta), 6) AS mean_delta, count(*)::BIGINT AS cells FROM t GROUP BY 1, 2 HAVING count(*) >= 10""")
def d36_transition_deltas(spark, d):
    c = observations(spark, d).groupBy("species", "dataset", "week").agg(F.avg("value").alias("v"))
    after = c.select("species", "dataset", (F.col("week") - 1).alias("week"), F.col("v").alias("after"))
    return c.join(after, ["species", "dataset", "week"]).groupBy("species", "week").agg(r6(F.avg(F.col("after") - F.col("v"))).alias("mean_delta"), F.count(ONE).alias("cells")).where("cells >= 10")


@query(f"WITH {OBS} SELECT species, dataset, min(day)::VARCHAR AS first_day, min_by(event_id, (ts, event_id)) AS first_event FROM obs GROUP BY 1, 2")
def d37_first_per_group(spark, d):
    return observations(spark, d).groupBy("species", "dataset").agg(F.min("day").cast("string").alias("first_day"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query(f"""WITH {OBS}, e AS (SELECT species, dataset, count(DISTINCT day) AS days FROM obs GROUP BY 1, 2) SELECT species, floor_days::BIGINT AS floor_days, count(*) FILTER (days >= floor_days)::BIGINT AS cells, round(count(*) FILTER (days >= floor_days) / count(*), 6) AS share
FROM e, (SELECT unnest([1, 2, 5, 10]) AS floor_days) GROUP BY 1, 2""")
def d38_threshold_grid(spark, d):
    e = observations(spark, d).groupBy("species", "dataset").agg(F.countDistinct("day").alias("days"))
    grid = e.select("species", "days", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 5, 10)])).alias("floor_days"))
    enough = F.count_if(F.col("days") >= F.col("floor_days"))
    return grid.groupBy("species", "floor_days").agg(enough.alias("cells"), r6(enough / F.count(ONE)).alias("share"))


@query("""WITH t AS (SELECT o_orderpriority AS stratum, o_totalprice > 150000 AS exposed, o_orderstatus = 'F' AS event FROM orders), p AS (SELECT stratum, avg(event::INT) FILTER (exposed) AS a, avg(event::INT) FILTER (NOT exposed) AS b FROM t GROUP BY 1)
SELECT stratum, round(a, 6) AS exposed_rate, round(b, 6) AS other_rate, round(a - b, 6) AS difference FROM p""")
def d39_risk_rates(spark, d):
    exposed, event = F.col("o_totalprice") > 150000, (F.col("o_orderstatus") == "F").cast("int")
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.avg(F.when(exposed, event)).alias("a"), F.avg(F.when(~exposed, event)).alias("b"))
    return p.select("stratum", r6(F.col("a")).alias("exposed_rate"), r6(F.col("b")).alias("other_rate"), r6(F.col("a") - F.col("b")).alias("difference"))


@query("""WITH e AS (SELECT l_linenumber AS fold, l_discount - 0.05 AS e0, l_discount - 0.9 * l_tax - 0.014 AS e1 FROM lineitem), f AS (SELECT fold, avg(e0 * e0) AS m0, avg(e1 * e1) AS m1, avg(abs(e0)) AS a0 FROM e GROUP BY 1)
SELECT round(avg(m0) * 1e4, 6) AS fold_mse, round(avg(a0), 6) AS fold_mae, round((SELECT avg(e0 * e0) FROM e) * 1e4, 6) AS row_mse, round(100 * (1 - avg(m1) / avg(m0)), 4) AS gain FROM f""")
def d40_unit_and_row_losses(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("fold"), (F.col("l_discount") - 0.05).alias("e0"), (F.col("l_discount") - 0.9 * F.col("l_tax") - 0.014).alias("e1"))
    s0, s1 = F.col("e0") * F.col("e0"), F.col("e1") * F.col("e1")
    f = e.groupBy("fold").agg(F.avg(s0).alias("m0"), F.avg(s1).alias("m1"), F.avg(F.abs("e0")).alias("a0"), F.sum(s0).alias("s"), F.count(ONE).alias("n"))
    return f.agg(r6(F.avg("m0") * 1e4).alias("fold_mse"), r6(F.avg("a0")).alias("fold_mae"), r6(F.sum("s") / F.sum("n") * 1e4).alias("row_mse"), F.round(100 * (1 - F.avg("m1") / F.avg("m0")), 4).alias("gain"))


@query(f"WITH {OBS}, q AS (SELECT dataset, week, avg(value) AS v FROM obs GROUP BY 1, 2) SELECT dataset, round(avg(v), 6) AS mean, count(*)::BIGINT AS weeks FROM q GROUP BY 1 HAVING count(*) >= 5")
def d41_mean_with_support(spark, d):
    q = observations(spark, d).groupBy("dataset", "week").agg(F.avg("value").alias("v"))
    return q.groupBy("dataset").agg(r6(F.avg("v")).alias("mean"), F.count(ONE).alias("weeks")).where("weeks >= 5")


@query("""WITH t AS (SELECT c_nationkey AS g, c_custkey % 2 = 0 AS near, (c_mktsegment = 'MACHINERY')::INT AS hit FROM customer), p AS (SELECT g, avg(hit) FILTER (near) - avg(hit) FILTER (NOT near) AS d FROM t GROUP BY 1)
SELECT n_regionkey AS cluster, round(avg(d), 6) AS mean_difference FROM p JOIN nation ON n_nationkey = g GROUP BY 1""")
def d42_near_far_shares(spark, d):
    near, hit = F.col("c_custkey") % 2 == 0, (F.col("c_mktsegment") == "MACHINERY").cast("int")
    p = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg((F.avg(F.when(near, hit)) - F.avg(F.when(~near, hit))).alias("d"))
    return p.join(unit_groups(spark, d), "unit").groupBy(F.col("grp").alias("cluster")).agg(r6(F.avg("d")).alias("mean_difference"))


@query(f"""WITH {DIST}, {TAXA}, ref AS (SELECT family, avg(native::INT) AS rate FROM dist JOIN taxa USING (resource) GROUP BY 1) SELECT unit, round(avg(native::INT), 6) AS observed, round(avg(rate), 6) AS expected FROM dist JOIN taxa USING (resource) JOIN ref USING (family) GROUP BY 1""")
def d43_direct_standardisation(spark, d):
    x = distribution(spark, d).join(taxa(spark, d), "resource").withColumn("hit", F.col("native").cast("int"))
    ref = x.groupBy("family").agg(F.avg("hit").alias("rate"))
    return x.join(ref, "family").groupBy("unit").agg(r6(F.avg("hit")).alias("observed"), r6(F.avg("rate")).alias("expected"))


@query(f"WITH t AS (SELECT o_custkey AS block, o_orderpriority = '1-URGENT' AS arm, o_totalprice AS x FROM orders), {CONTRAST}")
def d44_within_group_contrasts(spark, d):
    return A.block_contrast(table(spark, d, "orders"), "o_custkey", F.col("o_orderpriority") == "1-URGENT", "o_totalprice")


@query(f"""WITH {DIST}, {GROUPS}, u AS (SELECT unit, grp, count(*) AS n, count(*) FILTER (native) AS a FROM dist JOIN groups USING (unit) GROUP BY 1, 2)
SELECT grp, sum(n)::BIGINT AS total, sum(a)::BIGINT AS native, round(100 * sum(a) / sum(n), 6) AS pooled, count(*) FILTER (a = 0)::BIGINT AS from_zero, round(avg(a / n), 6) AS mean_share, round(quantile_cont(a / n, 0.5), 6) AS median_share FROM u GROUP BY 1""")
def d45_region_bundle(spark, d):
    u = distribution(spark, d).join(unit_groups(spark, d), "unit").groupBy("unit", "grp").agg(F.count(ONE).alias("n"), F.count_if("native").alias("a")).withColumn("share", F.col("a") / F.col("n"))
    return u.groupBy("grp").agg(F.sum("n").alias("total"), F.sum("a").alias("native"), r6(100 * F.sum("a") / F.sum("n")).alias("pooled"), F.count_if(F.col("a") == 0).alias("from_zero"), r6(F.avg("share")).alias("mean_share"), *A.quantiles("share", {"median_share": 0.5}))


@query(f"""WITH {OBS}, c AS (SELECT dataset, species, count(*) AS n FROM obs GROUP BY 1, 2) SELECT species, least_n::BIGINT AS least_n, max(n)::BIGINT AS most, sum(n) FILTER (n >= least_n)::BIGINT AS records, count(*) FILTER (n >= least_n)::BIGINT AS pairs FROM c, (SELECT unnest([1, 5, 20]) AS least_n) GROUP BY 1, 2""")
def d46_staged_thresholds(spark, d):
    c = observations(spark, d).groupBy("dataset", "species").agg(F.count(ONE).alias("n"))
    grid = c.select("species", "n", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 5, 20)])).alias("least_n"))
    ok = F.col("n") >= F.col("least_n")
    return grid.groupBy("species", "least_n").agg(F.max("n").alias("most"), F.sum(F.when(ok, F.col("n"))).alias("records"), F.count_if(ok).alias("pairs"))


@query(f"WITH {DIST}, p AS (SELECT resource, count(*) AS n FROM dist GROUP BY 1) SELECT CASE WHEN n <= 5 THEN 'rare' WHEN n <= 15 THEN 'middling' ELSE 'common' END AS band, count(*)::BIGINT AS resources, sum(n)::BIGINT AS cells FROM p GROUP BY 1")
def d47_prevalence_bands(spark, d):
    p = incidence(spark, d).groupBy("resource").agg(F.count(ONE).alias("n"))
    band = F.when(F.col("n") <= 5, "rare").when(F.col("n") <= 15, "middling").otherwise("common")
    return p.groupBy(band.alias("band")).agg(F.count(ONE).alias("resources"), F.sum("n").alias("cells"))
