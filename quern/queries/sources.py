"""Scans, sinks and streams. File formats are written from the tables first, then scanned."""

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.plans.staging import stage_path
from quern.sources import files
from quern.sources.tables import table
from quern.streaming import events as E

SUPPLIER = "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier"


def _suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")


@query(SUPPLIER)
def a01_csv_scan(spark, d):
    path = stage_path(spark)
    files.write_csv(_suppliers(spark, d), path, ["s_suppkey"])
    return files.read_csv(spark, path, ["s_suppkey", "s_name", "s_nationkey"])


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def a02_bom_tolerant_scan(spark, d):
    path = stage_path(spark)
    lines = _suppliers(spark, d).select(F.col("s_suppkey").alias("k"), F.concat_ws(",", "s_suppkey", "s_name").alias("value"))
    head = spark.createDataFrame([(-1, "﻿S_SUPPKEY , s_name")], "k long, value string")
    head.union(lines).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return files.read_csv(spark, path, ["s_suppkey", "s_name"])


@query(SUPPLIER)
def a03_gzip_csv_scan(spark, d):
    path = stage_path(spark)
    files.write_csv(_suppliers(spark, d), path, ["s_suppkey"], compression="gzip")
    return files.read_csv(spark, path, ["s_suppkey"])


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def a04_zip_member_discovery(spark, d):
    """Archives that hold a note and another table beside the one that is looked for; each task writes and reads its own."""
    path = stage_path(spark)
    other = {"readme.txt": "no table here\n", "other.csv": "a,b\n1,2\n"}
    named = _suppliers(spark, d).withColumnRenamed("s_name", "S_NAME").withColumn("s_suppkey", F.col("s_suppkey").cast("string"))
    files.write_archives(named, path, "suppliers.tsv", other)
    spark.dataSource.register(files.ZipTable)
    return spark.read.format("ziptable").option("path", path).option("required", "s_suppkey,s_name").load()


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def a05_pruned_scan(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp")).select("l_orderkey", "l_quantity")


@query("SELECT r_name AS key, n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey")
def a06_json_unit_lists(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = n.groupBy("r_name").agg(F.collect_list("n_name").alias("xs"))
    return files.unit_lists(per.select(F.to_json(F.map_from_arrays(F.array("r_name"), F.array("xs"))).alias("j")), "j")


@query("SELECT n_nationkey::VARCHAR AS code, n_name AS name, 'Polygon' AS kind, 5 AS corners FROM nation")
def a07_geojson_scan(spark, d):
    path = stage_path(spark)
    k = F.col("n_nationkey").cast("double")
    ring = F.array(*[F.array(k + x, F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    f = table(spark, d, "nation").select(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("code"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).alias("f"))
    f.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value")).write.text(path)
    got = files.read_features(spark, path, "code", "name")
    return got.select("code", "name", "kind", F.size(F.col("rings")[0]).alias("corners"))


@query("SELECT p_brand, count(*)::BIGINT AS parts, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1")
def a10_parquet_projection(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("price"))


RASTER = "raster AS (SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN (x * 7 + y) % 13 = 0 THEN NULL ELSE sin(x / 5.0::DOUBLE) + y END AS v FROM (SELECT unnest(range(72)) AS x), (SELECT unnest(range(36)) AS y))"


def _raster(spark):
    x, y = F.col("id") % 72, F.floor(F.col("id") / 72)
    return spark.range(72 * 36).select(x.alias("x"), y.alias("y"), F.when((x * 7 + y) % 13 != 0, F.sin(x / 5.0) + y).alias("v"))


@query(f"WITH {RASTER}, points AS (SELECT vec_id AS id, round(80.0 * sin(embedding[1]::DOUBLE * 3), 6) AS lat, round(170.0 * sin(embedding[2]::DOUBLE * 3), 6) AS lon FROM embeddings) SELECT id, round(v, 6) AS v FROM points LEFT JOIN raster ON x = floor((lon + 180) / 5) AND y = floor((lat + 90) / 5)")
def a14_raster_point_sampling(spark, d):
    from quern.sources.relations import points

    p = points(spark, d).select("id", F.floor((F.col("lon") + 180) / 5).alias("x"), F.floor((F.col("lat") + 90) / 5).alias("y"))
    return p.join(_raster(spark), ["x", "y"], "left").select("id", F.round("v", 6).alias("v"))


@query(f"WITH {RASTER}, w AS (SELECT n_nationkey AS k, 2.3 * n_nationkey AS x0, 2.3 * n_nationkey + 4.6 AS x1, 0.9 * n_nationkey AS y0, 0.9 * n_nationkey + 3.3 AS y1 FROM nation), o AS (SELECT k, v, (least(x + 1, x1) - greatest(x, x0)) * (least(y + 1, y1) - greatest(y, y0)) AS a FROM w JOIN raster ON x < x1 AND x + 1 > x0 AND y < y1 AND y + 1 > y0 WHERE v IS NOT NULL) SELECT k, round(sum(v * a) / sum(a), 6) AS mean FROM o GROUP BY 1")
def a15_area_weighted_raster_mean(spark, d):
    k = F.col("n_nationkey")
    w = table(spark, d, "nation").select(k.alias("k"), (2.3 * k).alias("x0"), (2.3 * k + 4.6).alias("x1"), (0.9 * k).alias("y0"), (0.9 * k + 3.3).alias("y1"))
    cells = w.withColumn("x", F.explode(F.sequence(F.floor("x0"), F.floor("x1")))).withColumn("y", F.explode(F.sequence(F.floor("y0"), F.floor("y1"))))
    o = cells.join(_raster(spark).where("v is not null"), ["x", "y"])
    a = (F.least(F.col("x") + 1, F.col("x1")) - F.greatest("x", "x0")) * (F.least(F.col("y") + 1, F.col("y1")) - F.greatest("y", "y0"))
    return o.withColumn("a", a).where("a > 0").groupBy("k").agg(F.round(F.sum(F.col("v") * F.col("a")) / F.sum("a"), 6).alias("mean"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def a16_sql_scan(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_of_a16")
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM orders_of_a16 WHERE o_totalprice > 100000 GROUP BY 1")


@query()
def a17_html_table_rows(spark, d):
    """Rows of tables and lists of each page, by a table function."""
    return table(spark, d, "pages").lateralJoin(files.HtmlRows(F.col("html").outer())).select("page_id", "row_no", F.array_join("cells", " | ").alias("cells"))


@query("""WITH t AS (SELECT c_custkey AS k, least(100000, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 37 % 5000 ELSE c_custkey * 9973 % 130000 END)::BIGINT AS total FROM customer),
p AS (SELECT k, total, ceil(total / 300)::BIGINT AS pages, greatest(0, total - 300) AS last FROM t WHERE total > 0),
few AS (SELECT k, i * 300 AS page_offset FROM p, (SELECT unnest(range(8)) AS i) WHERE pages <= 8 AND i < pages),
spread AS (SELECT DISTINCT k, last, least(last, (round_even(i * (last / 7::DOUBLE) / 300, 0) * 300)::BIGINT) AS page_offset FROM p, (SELECT unnest(range(8)) AS i) WHERE pages > 8),
free AS (SELECT k, n, page_offset, row_number() OVER (PARTITION BY k ORDER BY page_offset) AS r FROM (SELECT k, last, count(*) AS n FROM spread GROUP BY 1, 2), (SELECT unnest(range(334)) * 300 AS page_offset) WHERE page_offset <= last AND (k, page_offset) NOT IN (SELECT (k, page_offset) FROM spread))
SELECT k, page_offset::BIGINT AS page_offset FROM few UNION ALL SELECT k, page_offset FROM spread UNION ALL SELECT k, page_offset FROM free WHERE r <= 8 - n""")
def a19_page_plan(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("k"), F.when(k % 2 == 0, k * 37 % 5000).otherwise(k * 9973 % 130000).alias("total"))
    return t.select("k", F.explode(files.page_offsets(F.col("total"), 300, 8)).alias("page_offset"))


@query("SELECT o_orderkey AS k, (100 + s * 64)::BIGINT AS start, least(64, n - s * 64)::BIGINT AS n FROM (SELECT o_orderkey, o_orderkey % 500 AS n FROM orders), (SELECT unnest(range(8)) AS s) WHERE s * 64 < n")
def a20_window_chunks(spark, d):
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k.alias("k"), F.explode(files.window_chunks(F.lit(100).cast("long"), k % 500, 64)).alias("c"))
    return c.select("k", "c.start", "c.n")


@query("SELECT c_custkey AS page FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def a21_pending_pages(spark, d):
    done = table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("page"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("page")).join(done, "page", "left_anti")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def a22_last_write_wins(spark, d):
    return files.last_write_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT p_partkey, left(sha256('pilot|' || trim(p_name)), 16) || '-' || replace(trim(p_name), ' ', '_') AS state_key FROM part")
def a23_state_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", files.state_key(F.col("p_name"), "pilot").alias("state_key"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def a27_zstd_parquet_round_trip(spark, d):
    path = stage_path(spark)
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").write.parquet(path, compression="zstd")
    return spark.read.parquet(path)


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def a26_json_receipts(spark, d):
    path = stage_path(spark)
    files.write_receipt(table(spark, d, "nation"), path)
    return spark.read.schema("n_name string, n_nationkey int, n_regionkey int").json(path)


@query()
def a28_source_digests(spark, d):
    return files.file_digests(spark, f"{d}/region.parquet")


@query("SELECT event_type, user_id, count(*)::BIGINT AS records, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def m01_incremental_counts(spark, d):
    return E.drained(E.cell_counts(E.event_stream(spark, d)), "complete")


@query("SELECT event_id, user_id FROM events")
def m02_resumable_ingest(spark, d):
    return E.drained(E.event_stream(spark, d).select("event_id", "user_id"))


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def m03_duplicate_collapse(spark, d):
    """First event of each user, type and day, as a stream that forgets a key once the watermark has passed it."""
    keyed = lambda e: E.deduplicated(e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "event_type", "day"])
    return E.closed(E.event_stream(spark, d), keyed).select("user_id", "event_type", "day")


@query("SELECT strftime(epoch_ms((epoch_ms(ts) // 259200000) * 259200000), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(DISTINCT (user_id, CAST(ts AS DATE)))::BIGINT AS provider_days, count(*)::BIGINT AS records FROM events GROUP BY 1, 2")
def m04_provider_days(spark, d):
    """Distinct user-days in windows of three days, as a stream of two aggregates in a chain."""
    return E.closed(E.event_stream(spark, d), lambda e: E.provider_days(e, "3 days")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT time_bucket(INTERVAL '1 day', ts)::VARCHAR AS start, event_type, count(*)::BIGINT AS records, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def m04_daily_windows(spark, d):
    return E.closed(E.event_stream(spark, d), lambda e: E.tumbling(e, "1 day")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL '2 days', false) AS follows FROM events")
def m05_follow_up_state(spark, d):
    """As a stream with a state for each user and type, which has to be kept in RocksDB."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return E.closed(E.event_stream(spark, d), lambda e: E.follow_ups(e, 2))
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


@query("WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '6 hours', true)::INTEGER AS fresh FROM events), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*)::BIGINT AS records FROM n GROUP BY user_id, s")
def m06_user_sessions(spark, d):
    """Extension: sessions of each user with a gap of six hours."""
    return E.sessions(table(spark, d, "events"), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "records")


@query("WITH w AS (SELECT ts - INTERVAL '12 hours' * o AS moment, event_type, value FROM events, (SELECT unnest([0, 1]) AS o)) SELECT strftime(time_bucket(INTERVAL '12 hours', moment), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS records FROM w GROUP BY 1, 2")
def m07_sliding_windows(spark, d):
    """Extension: windows of a day that start every half."""
    return E.tumbling(table(spark, d, "events"), "1 day", "12 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "records")
