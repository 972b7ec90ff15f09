"""2.O: a table against an earlier version of itself."""

from pyspark.sql import functions as F

from quern.operators import compare
from quern.plans.registry import query
from quern.plans.staging import settle
from quern.sources.tables import table

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
EDITED = """picked AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR)) AS r FROM orders QUALIFY r <= 12),
old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
new AS (SELECT o_orderkey, o_custkey, CASE WHEN r = 4 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN r <= 4 THEN o_totalprice + 1 WHEN r > 10 THEN o_totalprice + 1e-7 ELSE o_totalprice END AS o_totalprice FROM old LEFT JOIN picked ON k = o_orderkey WHERE r IS NULL OR r NOT IN (5, 6, 7)
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM old JOIN picked ON k = o_orderkey WHERE r IN (8, 9, 10))"""


def _edited(spark, d):
    """Orders, and a version of them with four rows changed, three gone, three new and two within the tolerance."""
    old = table(spark, d, "orders").select(*ORDERS)
    hashed = old.select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.col("o_orderkey").alias("k"))
    keys = [r["k"] for r in hashed.orderBy("h").limit(12).collect()]
    listed = lambda a, b: F.col("o_orderkey").isin(keys[a:b])
    price = F.when(listed(0, 4), F.col("o_totalprice") + 1).when(listed(10, 12), F.col("o_totalprice") + 1e-7).otherwise(F.col("o_totalprice"))
    new = old.where(~listed(4, 7)).withColumn("o_totalprice", price).withColumn("o_orderstatus", F.when(listed(3, 4), "X").otherwise(F.col("o_orderstatus")))
    return old, settle(new.union(old.where(listed(7, 10)).withColumn("o_orderkey", -F.col("o_orderkey") - 1)))


@query(f"""WITH {EDITED} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status,
CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.o_custkey <> b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN abs(a.o_totalprice - b.o_totalprice) > 1e-6 THEN 'o_totalprice' END) END AS columns
FROM old a FULL JOIN new b USING (o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR columns <> ''""")
def o01_table_diff(spark, d):
    return compare.table_diff(*_edited(spark, d), "o_orderkey", 1e-6)


@query(f"""WITH {EDITED} SELECT (SELECT count(*) FROM old)::BIGINT AS old_rows, (SELECT count(*) FROM new)::BIGINT AS new_rows,
(SELECT count(*) FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new))::BIGINT AS only_old, (SELECT count(*) FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old))::BIGINT AS only_new""")
def o02_rows_of_one_version(spark, d):
    """How many rows either version has alone, bit by bit."""
    old, new = _edited(spark, d)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    ones = [count(old, "old_rows"), count(new, "new_rows"), count(old.exceptAll(new), "only_old"), count(new.exceptAll(old), "only_new")]
    out = ones[0]
    for one in ones[1:]:
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out
