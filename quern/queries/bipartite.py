"""Footprints, credit and concentration."""

from pyspark.sql import functions as F

from quern.operators import bipartite as B
from quern.plans.registry import query
from quern.sources.relations import DIST, EDGES, FOOT, GROUPS, TAXA, distribution, edges, taxa, unit_groups

BASE = f"WITH {EDGES}, {DIST}, {FOOT}"
SOURCES = "src AS (SELECT DISTINCT e.consumer, d.unit, e.resource FROM edges e JOIN dist d USING (resource) JOIN foot f ON f.consumer = e.consumer AND f.unit = d.unit AND NOT f.native)"
CREDIT = "part_of AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY consumer, unit) AS share FROM src), credit AS (SELECT consumer, resource, sum(share::DOUBLE) AS credit FROM part_of GROUP BY 1, 2)"
TOTALS = "per AS (SELECT resource, sum(credit) AS credit FROM credit GROUP BY 1)"


def _foot(spark, d):
    return B.footprints(edges(spark, d), distribution(spark, d))


def _credit(spark, d):
    return B.fractional_credit(B.added_sources(edges(spark, d), distribution(spark, d)))


def _totals(spark, d):
    return _credit(spark, d).groupBy("resource").agg(F.sum("credit").alias("credit"))


@query(f"""{BASE} SELECT consumer, count(*) FILTER (native)::BIGINT AS native_units, count(*)::BIGINT AS units, count(*) FILTER (NOT native)::BIGINT AS added_units,
CASE WHEN count(*) FILTER (native) > 0 THEN round(ln(1 + count(*)) - ln(1 + count(*) FILTER (native)), 6) END AS log_growth FROM foot GROUP BY 1""")
def footprint_expansion(spark, d):
    return B.footprint_counts(_foot(spark, d))


@query(f"WITH {EDGES}, {DIST} SELECT DISTINCT consumer, unit FROM edges JOIN dist USING (resource)")
def c01_edge_distribution_join(spark, d):
    return edges(spark, d).join(distribution(spark, d), "resource").select("consumer", "unit").distinct()


@query(f"""WITH {EDGES}, {DIST} SELECT consumer, count(DISTINCT unit) AS units, count(DISTINCT resource) AS resources, count(DISTINCT CASE WHEN unit IS NOT NULL THEN resource END) AS mapped_resources
FROM edges LEFT JOIN dist USING (resource) GROUP BY 1""")
def d01_union_footprint_counts(spark, d):
    return B.union_footprints(edges(spark, d), distribution(spark, d))


@query(f"{BASE} SELECT grp, count(*) FILTER (native)::BIGINT AS native_cells, count(*)::BIGINT AS cells, count(*) FILTER (NOT native)::BIGINT AS added_cells FROM foot JOIN (SELECT n_nationkey AS unit, n_regionkey AS grp FROM nation) USING (unit) GROUP BY 1")
def d02_native_contemporary_added(spark, d):
    joined = _foot(spark, d).join(unit_groups(spark, d), "unit")
    return joined.groupBy("grp").agg(F.count_if("native").alias("native_cells"), F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("native")).alias("added_cells"))


@query(f"""{BASE}, m AS (SELECT consumer, count(*) FILTER (native) AS a, count(*) AS b FROM foot GROUP BY 1)
SELECT count(*)::BIGINT AS consumers, count(*) FILTER (b > a)::BIGINT AS expanded, round(avg(b - a), 6) AS mean_added, round(avg(CASE WHEN a > 0 THEN ln(b / a) END), 6) AS mean_log_ratio, count(*) FILTER (a = 0)::BIGINT AS without_native FROM m""")
def d03_portfolio_metrics(spark, d):
    m = B.footprint_counts(_foot(spark, d))
    ratio = F.when(F.col("native_units") > 0, F.log(F.col("units") / F.nullif(F.col("native_units"), F.lit(0))))
    return m.agg(F.count(F.lit(1)).alias("consumers"), F.count_if(F.col("added_units") > 0).alias("expanded"), F.round(F.avg("added_units"), 6).alias("mean_added"), F.round(F.avg(ratio), 6).alias("mean_log_ratio"), F.count_if(F.col("native_units") == 0).alias("without_native"))


@query(f"{BASE}, {SOURCES}, {CREDIT} SELECT consumer, resource, round(credit, 6) AS credit FROM credit")
def d04_fractional_attribution(spark, d):
    return _credit(spark, d).withColumn("credit", F.round("credit", 6))


@query(f"""{BASE}, {SOURCES}, {CREDIT}, r AS (SELECT *, row_number() OVER (PARTITION BY consumer ORDER BY credit DESC) AS k FROM credit)
SELECT consumer, round(sum(credit), 6) AS total, round(max(credit) / sum(credit), 6) AS max_share, round(sum(credit) FILTER (k <= 2) / sum(credit), 6) AS top2_share, round(sum(credit * credit) / (sum(credit) * sum(credit)), 6) AS hhi, round(sum(credit) * sum(credit) / sum(credit * credit), 6) AS effective_number FROM r GROUP BY 1""")
def d05_credit_shares(spark, d):
    return B.concentration(_credit(spark, d), ["consumer"])


@query(f"""{BASE}, {SOURCES}, {TAXA}, g AS (SELECT DISTINCT consumer, unit, genus FROM src JOIN taxa USING (resource)), p AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY consumer, unit) AS share FROM g)
SELECT genus, round(sum(share::DOUBLE), 6) AS credit FROM p GROUP BY 1""")
def d06_credit_by_group(spark, d):
    grouped = edges(spark, d).join(taxa(spark, d), "resource")
    credit = B.fractional_credit(B.added_sources(grouped, distribution(spark, d), "genus"), "genus")
    return credit.groupBy("genus").agg(F.round(F.sum("credit"), 6).alias("credit"))


@query(f"""{BASE}, {SOURCES}, {CREDIT}, {TOTALS}, {TAXA}, r AS (SELECT family, credit, row_number() OVER (PARTITION BY family ORDER BY credit) AS k FROM per JOIN taxa USING (resource) WHERE credit > 0)
SELECT family, round(2 * sum(k * credit) / (count(*) * sum(credit)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY 1""")
def d07_gini(spark, d):
    return B.gini(_totals(spark, d).join(taxa(spark, d), "resource"), ["family"], "credit")


@query(f"""{BASE}, {SOURCES}, {CREDIT}, {TOTALS}, r AS (SELECT credit, row_number() OVER (ORDER BY credit DESC, resource) AS n FROM per)
SELECT k::BIGINT AS k, round(sum(credit) FILTER (n <= k) / sum(credit), 6) AS share FROM r, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) GROUP BY k""")
def d08_top_k_shares(spark, d):
    return B.top_share(_totals(spark, d), "credit", "resource", [1, 5, 10, 20, 50, 100])


@query(f"""{BASE}, {SOURCES}, {CREDIT}, {TOTALS}, {TAXA}, r AS (SELECT family, sum(credit) OVER (PARTITION BY family ORDER BY credit DESC, resource ROWS UNBOUNDED PRECEDING) AS upto, sum(credit) OVER (PARTITION BY family) AS total, row_number() OVER (PARTITION BY family ORDER BY credit DESC, resource) AS k FROM per JOIN taxa USING (resource))
SELECT family, min(k)::BIGINT AS half_count FROM r WHERE upto >= 0.5 * total - 1e-9 GROUP BY 1""")
def d09_half_count(spark, d):
    return B.half_count(_totals(spark, d).join(taxa(spark, d), "resource"), ["family"], "credit")


@query(f"""WITH {EDGES}, {DIST}, {GROUPS}, n AS (SELECT resource, grp, count(*) AS n FROM dist JOIN groups USING (unit) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY n DESC, grp) AS k, round(n / sum(n) OVER (PARTITION BY resource), 6) AS share FROM n)
SELECT resource, grp, n::BIGINT AS n, share FROM r WHERE k = 1""")
def d25_mode_with_ties(spark, d):
    return B.mode(distribution(spark, d).join(unit_groups(spark, d), "unit"), ["resource"], "grp")


@query(f"WITH {EDGES}, n AS (SELECT consumer, count(*) AS b FROM edges GROUP BY 1) SELECT CASE WHEN b = 1 THEN '1' WHEN b = 2 THEN '2' WHEN b <= 5 THEN '3-5' ELSE '6+' END AS band, count(*)::BIGINT AS consumers FROM n GROUP BY 1")
def b01_breadth_bands(spark, d):
    breadth = edges(spark, d).groupBy("consumer").agg(F.count(F.lit(1)).alias("b"))
    return breadth.groupBy(B.banded(F.col("b")).alias("band")).agg(F.count(F.lit(1)).alias("consumers"))
