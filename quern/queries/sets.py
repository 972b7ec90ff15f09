"""G01-G12."""

from pyspark.sql import functions as F

from quern.operators import sets as S
from quern.operators.aggregates import r6, ratio
from quern.plans.registry import query
from quern.sources.relations import DIST, GROUPS, TAXA, distribution, incidence, taxa, unit_groups
from quern.sources.tables import table

PAIRS = f"""{DIST}, sizes AS (SELECT n_nationkey AS unit, count(resource) AS n FROM nation LEFT JOIN dist ON unit = n_nationkey GROUP BY 1),
sh AS (SELECT x.unit AS a, y.unit AS b, count(*) AS shared FROM dist x JOIN dist y ON x.resource = y.resource AND x.unit < y.unit GROUP BY 1, 2),
pairs AS (SELECT p.unit AS a, q.unit AS b, p.n AS na, q.n AS nb, coalesce(shared, 0) AS shared, p.n + q.n - coalesce(shared, 0) AS "union" FROM sizes p JOIN sizes q ON p.unit < q.unit LEFT JOIN sh ON a = p.unit AND b = q.unit)"""


def _pairs(spark, d):
    return S.listed_overlaps(incidence(spark, d), unit_groups(spark, d), "unit", "resource")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events), f AS (SELECT a.k IS NOT NULL AS ina, b.k IS NOT NULL AS inb FROM a FULL JOIN b USING (k))
SELECT count(*)::BIGINT AS n_union, count(*) FILTER (ina AND inb)::BIGINT AS n_both, count(*) FILTER (ina AND NOT inb)::BIGINT AS n_only_a, count(*) FILTER (inb AND NOT ina)::BIGINT AS n_only_b, bool_and(inb OR NOT ina) AS a_within_b FROM f""")
def g01_set_algebra(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    sizes = [x.agg(F.count("*").alias(n)) for x, n in ((a.union(b).distinct(), "n_union"), (a.intersect(b), "n_both"), (a.subtract(b), "n_only_a"), (b.subtract(a), "n_only_b"))]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.crossJoin(F.broadcast(s))  # of single rows
    return out.withColumn("a_within_b", F.col("n_only_a") == 0)


@query("SELECT s_suppkey AS id, s_nationkey AS unit, s_acctbal AS balance, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_acctbal, 'customer' FROM customer")
def g02_bag_union(spark, d):
    part = lambda t, p, kind: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(f"{p}_acctbal").alias("balance"), F.col(f"{p}_{'supp' if p == 's' else 'cust'}key").alias("id"), F.col(f"{p}_nationkey").alias("unit"))
    return part("supplier", "s", "supplier").select("id", "unit", "balance", "kind").unionByName(part("customer", "c", "customer"))


@query(f"WITH {PAIRS} SELECT a, b, round(shared / \"union\", 6) AS jaccard FROM pairs WHERE \"union\" > 0")
def g03_jaccard_strict(spark, d):
    """Of all pairs but those of two empty communities, which would fail the query."""
    return _pairs(spark, d).where("na > 0 or nb > 0").select("a", "b", S.jaccard(strict=True).alias("jaccard"))


@query(f"WITH {PAIRS} SELECT a, b, round(shared / nullif(\"union\", 0), 6) AS jaccard FROM pairs")
def g04_jaccard_null_on_empty(spark, d):
    return _pairs(spark, d).select("a", "b", S.jaccard().alias("jaccard"))


@query(f"WITH {PAIRS} SELECT a, b, coalesce(round(shared / nullif(\"union\", 0), 6), 0) AS jaccard, \"union\" = 0 AS missing, count(*) FILTER (\"union\" = 0) OVER ()::BIGINT AS undefined FROM pairs")
def g05_jaccard_zero_filled(spark, d):
    p = _pairs(spark, d).select("a", "b", S.jaccard().alias("j"))
    undefined = p.agg(F.count_if(F.col("j").isNull()).alias("undefined"))
    return p.crossJoin(F.broadcast(undefined)).select("a", "b", F.coalesce("j", F.lit(0.0)).alias("jaccard"), F.col("j").isNull().alias("missing"), "undefined")


@query(f"WITH {PAIRS} SELECT a, b, round(2 * shared / nullif(na + nb, 0), 6) AS sorensen, round(shared / nullif(least(na, nb), 0), 6) AS simpson FROM pairs")
def g06_sorensen_simpson(spark, d):
    return _pairs(spark, d).select("a", "b", r6(ratio(2 * F.col("shared"), F.col("na") + F.col("nb"))).alias("sorensen"), r6(ratio(F.col("shared"), F.least("na", "nb"))).alias("simpson"))


@query(f"WITH {DIST} SELECT x.unit AS a, y.unit AS b, count(*)::BIGINT AS cross_origin FROM dist x JOIN dist y USING (resource) WHERE x.native AND NOT y.native GROUP BY 1, 2")
def g07_incidence_product(spark, d):
    i = distribution(spark, d)
    x, y = i.where("native").select(F.col("unit").alias("a"), "resource"), i.where("not native").select(F.col("unit").alias("b"), "resource")
    return x.join(y, "resource").groupBy("a", "b").agg(F.count("*").alias("cross_origin"))


@query(f"""WITH {PAIRS}, {GROUPS}, j AS (SELECT x.grp = y.grp AS same, shared / nullif("union", 0) AS j FROM pairs JOIN groups x ON x.unit = a JOIN groups y ON y.unit = b)
SELECT same, round(avg(j), 6) AS defined, round(avg(coalesce(j, 0)), 6) AS zero_filled, count(*)::BIGINT AS n FROM j GROUP BY 1""")
def g08_within_between_similarity(spark, d):
    return S.mean_overlaps(incidence(spark, d), unit_groups(spark, d), "unit", "resource", "grp")


@query(f"""WITH {DIST}, h AS (SELECT p_partkey AS resource FROM part WHERE p_brand = 'Brand#11' OR p_size > 25), m AS (SELECT unit, resource, resource IN (SELECT resource FROM h) AS inside FROM dist)
SELECT x.unit AS a, y.unit AS b, count(*) FILTER (x.inside)::BIGINT AS inside, count(*) FILTER (NOT x.inside)::BIGINT AS outside FROM m x JOIN m y ON x.resource = y.resource AND x.unit < y.unit GROUP BY 1, 2""")
def g09_masked_overlap(spark, d):
    mask = table(spark, d, "part").select(F.col("p_partkey").alias("resource"), ((F.col("p_brand") == "Brand#11") | (F.col("p_size") > 25)).alias("inside"))
    m = incidence(spark, d).join(mask, "resource")
    x, y = m.select(F.col("unit").alias("a"), "resource", "inside"), m.select(F.col("unit").alias("b"), "resource")
    return x.join(y, "resource").where("a < b").groupBy("a", "b").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


@query("WITH ex AS (SELECT p_name AS name, NULL AS genus FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT NULL, p_type FROM part WHERE p_partkey = 3) SELECT p_partkey, p_name IN (SELECT name FROM ex WHERE name IS NOT NULL) AS exact, p_name IN (SELECT name FROM ex WHERE name IS NOT NULL) OR p_type IN (SELECT genus FROM ex WHERE genus IS NOT NULL) AS wide FROM part")
def g10_name_and_wildcard_exclusion(spark, d):
    p = table(spark, d, "part")
    names = p.where("p_partkey % 50 = 0").select("p_name", F.lit(True).alias("by_name")).distinct()
    wild = p.where("p_partkey = 3").select("p_type", F.lit(True).alias("by_genus")).distinct()
    hit = p.join(names, "p_name", "left").join(wild, "p_type", "left").fillna(False, ["by_name", "by_genus"])
    return hit.select("p_partkey", F.col("by_name").alias("exact"), (F.col("by_name") | F.col("by_genus")).alias("wide"))


@query(f"WITH {DIST}, {TAXA}, s AS (SELECT DISTINCT family, unit, native FROM dist JOIN taxa USING (resource)) SELECT family, unit, bool_and(native) AS native FROM s GROUP BY 1, 2 HAVING count(DISTINCT native) = 1")
def g11_mixed_status_exclusion(spark, d):
    s = distribution(spark, d).join(taxa(spark, d), "resource").select("family", "unit", "native").distinct()
    return S.single_status(s, ["family", "unit"], "native")


@query(f"WITH {DIST}, {GROUPS} SELECT resource, grp, CASE WHEN bool_and(native) THEN 'native' WHEN NOT bool_or(native) THEN 'introduced' ELSE 'mixed' END AS status FROM dist JOIN groups USING (unit) GROUP BY 1, 2")
def g12_concordant_status(spark, d):
    j = distribution(spark, d).join(unit_groups(spark, d), "unit")
    return j.groupBy("resource", "grp").agg(F.when(F.bool_and("native"), "native").when(~F.bool_or("native"), "introduced").otherwise("mixed").alias("status"))
