"""Projections, predicates and scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import space
from quern.operators.aggregates import r6, ratio
from quern.operators.ranks import whole_quantiles
from quern.plans.registry import query
from quern.plans.salting import spread_join
from quern.sources.relations import DIST, OBS, POINTS, distribution, observations, points
from quern.sources.tables import table


@query("WITH t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 5 = 0 THEN 'NA' ELSE p_size::VARCHAR END AS a, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice::VARCHAR END AS b FROM part), v AS (SELECT p_partkey, list_filter([try_cast(nullif(nullif(a, ''), 'NA') AS DOUBLE), try_cast(b AS DOUBLE)], lambda x: x IS NOT NULL) AS v FROM t) SELECT p_partkey, round(list_sum(v) / nullif(len(v), 0), 6) AS mean FROM v")
def b02_row_wise_mean(spark, d):
    p = table(spark, d, "part")
    a = F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 5 == 0, "NA").otherwise(F.col("p_size").cast("string"))
    b = F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice").cast("string"))
    return p.select("p_partkey", r6(S.row_mean([a, b])).alias("mean"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice) - ln(1 + o_orderkey), 6) AS log_ratio, round(o_totalprice / nullif(o_orderkey % 3, 0), 6) AS ratio FROM orders")
def b03_derived_ratios(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", r6(F.log1p("o_totalprice") - F.log1p("o_orderkey")).alias("log_ratio"), r6(ratio(F.col("o_totalprice"), F.col("o_orderkey") % 3)).alias("ratio"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 200000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def b04_eligibility_filter(spark, d):
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice between 50000 and 200000").join(poor, "o_custkey", "left_anti").select("o_orderkey")


@query("WITH f AS (SELECT c_custkey, list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT c_mktsegment <> 'BUILDING' THEN 'segment' END, CASE WHEN NOT c_nationkey < 20 THEN 'nation' END], lambda x: x IS NOT NULL) AS f FROM customer) SELECT c_custkey, list_aggregate(f, 'string_agg', ',') AS reasons, len(f) = 0 AS passed FROM f WHERE len(f) > 0 UNION ALL SELECT c_custkey, '', true FROM f WHERE len(f) = 0")
def b05_quality_gate(spark, d):
    why = S.failures({"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING", "nation": F.col("c_nationkey") < 20})
    return table(spark, d, "customer").select("c_custkey", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("passed"))


@query(f"WITH {POINTS}, s AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'x' ELSE lat::VARCHAR END AS lat, CASE WHEN id % 13 = 0 THEN '999' ELSE lon::VARCHAR END AS lon, CASE WHEN id % 17 = 0 THEN '2001.5' ELSE (1990 + id % 20)::VARCHAR END AS year FROM points) SELECT id, coalesce(try_cast(lat AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(lon AS DOUBLE) BETWEEN -180 AND 180 AND try_cast(year AS DOUBLE) = floor(try_cast(year AS DOUBLE)) AND try_cast(year AS DOUBLE) BETWEEN 1995 AND 2005, false) AS valid FROM s")
def b06_validity_masks(spark, d):
    p = points(spark, d)
    lat = F.when(F.col("id") % 11 == 0, "x").otherwise(F.col("lat").cast("string")).try_cast("double")
    lon = F.when(F.col("id") % 13 == 0, "999").otherwise(F.col("lon").cast("string")).try_cast("double")
    year = F.when(F.col("id") % 17 == 0, "2001.5").otherwise((F.col("id") % 20 + 1990).cast("string")).try_cast("double")
    ok = lat.between(-90, 90) & lon.between(-180, 180) & (year == F.floor(year)) & year.between(1995, 2005)
    return p.select("id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("SELECT p_partkey, ((p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT) AS left_closed, ((p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT) AS right_closed FROM part")
def b07_width_bins(spark, d):
    return table(spark, d, "part").select("p_partkey", S.width_bin(F.col("p_size"), [10, 20, 40]).alias("left_closed"), S.width_bin(F.col("p_size"), [10, 20, 40], right=True).alias("right_closed"))


@query("WITH c AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, ((q[1] <= p_retailprice)::INT + (q[2] <= p_retailprice)::INT + (q[3] <= p_retailprice)::INT) AS bin FROM part, c")
def b08_quantile_bins(spark, d):
    p = table(spark, d, "part")
    found = whole_quantiles(p, "p_retailprice", {"low": 0.25, "mid": 0.5, "high": 0.75})
    cuts = F.broadcast(found.select(F.array("low", "mid", "high").alias("q")))  # one row
    return p.crossJoin(cuts).select("p_partkey", F.size(F.filter("q", lambda c: c <= F.col("p_retailprice"))).alias("bin"))


@query(f"WITH {DIST}, n AS (SELECT resource, count(*) AS n FROM dist GROUP BY 1) SELECT resource, least(6, floor(log2(n)))::INTEGER AS bin FROM n")
def b09_degree_bins(spark, d):
    return distribution(spark, d).groupBy("resource").agg(F.count("*").alias("n")).select("resource", S.degree_bin(F.col("n")).alias("bin"))


@query("SELECT ((year(o_orderdate) - 1995) // 2)::INTEGER AS period, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def b10_period_buckets(spark, d):
    return table(spark, d, "orders").groupBy(F.floor((F.year("o_orderdate") - 1995) / 2).cast("int").alias("period")).agg(F.count("*").alias("n"))


@query("SELECT ((month(o_orderdate) - 1) // 3 + 1)::INTEGER AS quarter, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def b11_quarters(spark, d):
    return table(spark, d, "orders").groupBy(F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT id, floor(lat / 5)::INTEGER || '_' || floor(lon / 5)::INTEGER AS block FROM points")
def b12_spatial_block_ids(spark, d):
    cell = lambda c: F.floor(F.col(c) / 5).cast("int").cast("string")
    return points(spark, d).select("id", F.concat_ws("_", cell("lat"), cell("lon")).alias("block"))


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'tiny' WHEN p_brand LIKE '%1' THEN 'one' WHEN p_retailprice > 1200 THEN 'dear' ELSE 'rest' END AS kind FROM part")
def b13_multi_way_select(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 5, "tiny").when(F.col("p_brand").endswith("1"), "one").when(F.col("p_retailprice") > 1200, "dear").otherwise("rest").alias("kind"))


@query("WITH k AS (SELECT s_suppkey, s_nationkey AS by_key, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 10 = 0 THEN 0 ELSE s_nationkey END AS by_name FROM supplier) SELECT s_suppkey, coalesce(by_key, by_name) AS nation FROM k WHERE NOT coalesce(by_key <> by_name, false)")
def b14_coalesce_with_conflict(spark, d):
    k = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("by_key"), F.when(F.col("s_suppkey") % 3 == 0, None).when(F.col("s_suppkey") % 10 == 0, 0).otherwise(F.col("s_nationkey")).alias("by_name"))
    return k.where(~F.coalesce(F.col("by_key") != F.col("by_name"), F.lit(False))).select("s_suppkey", F.coalesce("by_key", "by_name").alias("nation"))


@query("WITH m AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part WHERE p_partkey % 4 <> 0) SELECT p_partkey, round(greatest(0, least(1, 0.5 + (p_retailprice - m) / s / 4)), 6) AS scaled FROM part, m")
def b15_train_only_scaling(spark, d):
    p = table(spark, d, "part")
    fit = F.broadcast(p.where("p_partkey % 4 <> 0").agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s")))  # one row
    return p.crossJoin(fit).select("p_partkey", r6(S.clip01(0.5 + (F.col("p_retailprice") - F.col("m")) / F.col("s") / 4)).alias("scaled"))


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT o_orderkey) = count(*) AS unique_key, bool_and(o_totalprice > 0) AS positive, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P'))::BIGINT AS strays FROM orders")
def b16_expectations(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), (F.count_distinct("o_orderkey") == F.count("*")).alias("unique_key"), F.bool_and(F.col("o_totalprice") > 0).alias("positive"), F.count_if(~F.col("o_orderstatus").isin("F", "O", "P")).alias("strays"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(ln(1 + abs(least(a.s_acctbal, b.s_acctbal))), 6) AS log_min, round(ln(1 + abs(greatest(a.s_acctbal, b.s_acctbal))), 6) AS log_max, round(a.s_acctbal + b.s_acctbal, 2) AS total, round(abs(a.s_acctbal - b.s_acctbal), 2) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def b17_pair_features(spark, d):
    s = table(spark, d, "supplier")
    side = lambda k: s.select("s_nationkey", F.col("s_suppkey").alias(k), F.col("s_acctbal").alias("x" + k))
    p = spread_join(side("a"), side("b"), ["s_nationkey"], "a", "b").where("a < b")
    return p.select("a", "b", r6(F.log1p(F.abs(F.least("xa", "xb")))).alias("log_min"), r6(F.log1p(F.abs(F.greatest("xa", "xb")))).alias("log_max"), F.round(F.col("xa") + F.col("xb"), 2).alias("total"), F.round(F.abs(F.col("xa") - F.col("xb")), 2).alias("gap"))


@query("SELECT c_nationkey, round(ln((count(*) FILTER (c_acctbal < 0) + 0.5) / (count(*) + 0.5)), 6) AS logit FROM customer GROUP BY 1")
def b18_empirical_logit(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(r6(S.empirical_logit(F.count_if(F.col("c_acctbal") < 0), F.count("*"))).alias("logit"))


@query("SELECT p_partkey, upper(trim(p_name)) AS up, lower(p_type) AS low, starts_with(p_brand, 'Brand#1') AS first, replace(p_brand, '#', '-') AS swapped, split_part(p_type, ' ', 1) AS word FROM part")
def h01_string_basics(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.lower("p_type").alias("low"), F.col("p_brand").startswith("Brand#1").alias("first"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("swapped"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word"))


@query("SELECT conv_id, turn, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM conversations")
def h02_whitespace_collapse(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(S.collapse(F.col("text")).cast("binary")).alias("digest"))


NAMES = "names AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Genus species' WHEN 2 THEN ' Genus  species-' || chr((97 + n_nationkey)::INTEGER) ELSE 'Genus species var' END AS x FROM nation)"


def _names(spark, d):
    k = F.col("n_nationkey")
    x = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, "Genus species").when(k % 4 == 2, F.concat(F.lit(" Genus  species-"), F.char((k + 97).cast("long")))).otherwise("Genus species var")
    return table(spark, d, "nation").select(k.alias("k"), x.alias("x"))


@query(f"WITH {NAMES}, c AS (SELECT k, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM names) SELECT k, CASE WHEN regexp_full_match(x, '[A-Za-z-]+ [a-z-]+') THEN x END AS name FROM c")
def h03_binomial_validation(spark, d):
    return _names(spark, d).select("k", S.binomial(F.col("x")).alias("name"))


@query(f"WITH {NAMES}, c AS (SELECT k, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM names) SELECT k, split_part(x, ' ', 1) AS genus, array_to_string(string_split(x, ' ')[1:2], ' ') AS base FROM c")
def h04_first_tokens(spark, d):
    c = S.collapse(F.col("x"))
    return _names(spark, d).select("k", F.substring_index(c, " ", 1).alias("genus"), F.substring_index(c, " ", 2).alias("base"))


@query("SELECT doc_id, upper(regexp_replace(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), '[^A-Za-z0-9]', '', 'g')) AS folded FROM documents")
def h05_accent_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", S.folded(F.col("text")).alias("folded"))


@query("SELECT n_nationkey, coalesce(c, 'XX') AS code FROM nation LEFT JOIN (VALUES (0, 'AF'), (1, 'AM'), (2, 'AS'), (3, 'EU')) AS v(r, c) ON r = n_regionkey")
def h06_label_lookup(spark, d):
    codes = spark.createDataFrame([(0, "AF"), (1, "AM"), (2, "AS"), (3, "EU")], "n_regionkey int, c string")
    return table(spark, d, "nation").join(codes, "n_regionkey", "left").select("n_nationkey", F.coalesce("c", F.lit("XX")).alias("code"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p[^>]*>'))::INTEGER AS paragraphs, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INTEGER AS links FROM pages")
def h07_multi_match_extraction(spark, d):
    n = lambda p, g: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(g)))
    return table(spark, d, "pages").select("page_id", n("<p[^>]*>", 0).alias("paragraphs"), n('href="([^"]*)"', 1).alias("links"))


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def h08_sorted_string_aggregate(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("names"))


@query("SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def h09_split_explode(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob FROM documents")
def h10_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), S.blob_sha1(F.col("text")).alias("blob"))


@query("SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS digest FROM nation GROUP BY 1")
def h11_list_digest(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("xs")).select("n_regionkey", S.list_digest(F.col("xs")).alias("digest"))


@query("WITH s AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN '1996-02-30' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT') ELSE '1997-01-01' END AS x FROM orders) SELECT k, CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}') AND year(try_cast(x AS DATE)) = y THEN x END AS day FROM s")
def h12_strict_iso_date(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    x = F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(day, "yyyy/MM/dd")).when(k % 5 == 2, "1996-02-30").when(k % 5 == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"))).otherwise("1997-01-01")
    return table(spark, d, "orders").select(k.alias("k"), S.iso_date(x, F.year(day)).cast("string").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders")
def h13_date_parts(spark, d):
    o = table(spark, d, "orders")
    parts = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"))
    return o.select("o_orderkey", F.try_to_date(parts, "y-M-d").cast("string").alias("day"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("shown"))


@query("WITH s AS (SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS y FROM orders), t AS (SELECT k, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN y || '-2003' WHEN 2 THEN substr(y, 1, 3) || '0s' ELSE 'c. ' || y END AS x FROM s) SELECT k, CASE k % 4 WHEN 0 THEN x::INT WHEN 1 THEN substr(x, 1, 4)::INT WHEN 2 THEN (substr(x, 1, 3) || '0')::INT END AS lower, CASE k % 4 WHEN 0 THEN x::INT WHEN 1 THEN 2003 WHEN 2 THEN (substr(x, 1, 3) || '9')::INT END AS upper FROM t")
def h14_year_intervals(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    x = F.when(k % 4 == 0, y).when(k % 4 == 1, F.concat(y, F.lit("-2003"))).when(k % 4 == 2, F.concat(F.substring(y, 1, 3), F.lit("0s"))).otherwise(F.concat(F.lit("c. "), y))
    return table(spark, d, "orders").select(k.alias("k"), S.year_interval(x).alias("i")).select("k", "i.lower", "i.upper")


@query("SELECT s_suppkey, round(ln(1 + abs(s_acctbal)), 6) AS a, round(exp(s_acctbal / 1e4) - 1, 6) AS b, round(sqrt(abs(s_acctbal)), 6) AS c, round(log2(1 + abs(s_acctbal)), 6) AS e, round(pow(abs(s_acctbal) / 1000, 1.5), 6) AS f, sign(s_acctbal)::INTEGER AS g FROM supplier")
def h15_elementary_functions(spark, d):
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", r6(F.log1p(F.abs(x))).alias("a"), r6(F.expm1(x / 1e4)).alias("b"), r6(F.sqrt(F.abs(x))).alias("c"), r6(F.log2(1 + F.abs(x))).alias("e"), r6(F.pow(F.abs(x) / 1000, 1.5)).alias("f"), F.signum(x).cast("int").alias("g"))


@query("WITH t AS (SELECT l_suppkey AS k, corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM t WHERE n > 3 AND abs(r) < 1")
def h16_fisher_interval(spark, d):
    """Interval of each supplier's correlation of quantity and discount."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.corr("l_quantity", "l_discount").alias("r"), F.count("*").alias("n"))
    low, high = S.fisher_interval(F.col("r"), F.col("n"))
    return t.where("n > 3 and abs(r) < 1").select("k", r6(low).alias("low"), r6(high).alias("high"))


@query("WITH t AS (SELECT l_suppkey AS s, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1) SELECT s, n, k, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 6) AS log_binomial FROM t")
def h17_log_binomial(spark, d):
    """In how many ways a supplier's returns could fall on its lines, as a logarithm."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return t.select("s", "n", "k", r6(S.log_binomial(F.col("n"), F.col("k"))).alias("log_binomial"))


@query(f"WITH {OBS}, c AS (SELECT species, dataset, count(*) AS n FROM obs GROUP BY 1, 2) SELECT species, dataset, round(1 - pow(1 - 0.05::DOUBLE, n), 6) AS keep FROM c")
def h18_rarefaction_probability(spark, d):
    c = observations(spark, d).groupBy("species", "dataset").agg(F.count("*").alias("n"))
    return c.select("species", "dataset", r6(S.keep_probability(F.col("n"), F.lit(0.05))).alias("keep"))


def _steps(spark, d):
    w = Window.partitionBy("label").orderBy("id")
    return points(spark, d).select("id", "lat", "lon", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0")).where("lat0 is not null")


STEPS = f"{POINTS}, steps AS (SELECT * FROM (SELECT id, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM points WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE lat0 IS NOT NULL)"


@query(f"WITH {STEPS} SELECT id, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon0)) / 2), 2)))), 4) AS km FROM steps")
def h19_haversine(spark, d):
    return _steps(spark, d).select("id", F.round(space.haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 4).alias("km"))


@query(f"WITH {STEPS} SELECT id, round(6371.0088 * acos(greatest(-1.0, least(1.0, cos(radians(lat0)) * cos(radians(lon0)) * cos(radians(lat)) * cos(radians(lon)) + cos(radians(lat0)) * sin(radians(lon0)) * cos(radians(lat)) * sin(radians(lon)) + sin(radians(lat0)) * sin(radians(lat))))), 3) AS km FROM steps")
def h20_great_circle_by_dot(spark, d):
    return _steps(spark, d).select("id", F.round(space.arc_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 3).alias("km"))


@query(f"WITH {POINTS}, k AS (SELECT *, cos(radians(30.0)) AS k FROM points) SELECT id, round(6371.0088 * radians(lon) * k, 4) AS x, round(6371.0088 * sin(radians(lat)) / k, 4) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM k")
def h22_equal_area_transform(spark, d):
    x, y = S.equal_area_xy(F.col("lat"), F.col("lon"))
    there = points(spark, d).select("id", x.alias("x"), y.alias("y"))
    lat, lon = S.equal_area_inverse(F.col("x"), F.col("y"))
    return there.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), r6(lat).alias("lat"), r6(lon).alias("lon"))


@query("SELECT p_partkey, (p_partkey & 255)::BIGINT AS a, (p_partkey | 5)::BIGINT AS o, xor(p_partkey, 12)::BIGINT AS x, bit_count(p_partkey)::INTEGER AS ones, (p_partkey & -p_partkey)::BIGINT AS lowest FROM part")
def h23_bit_operations(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", k.bitwiseAND(255).alias("a"), k.bitwiseOR(5).alias("o"), k.bitwiseXOR(12).alias("x"), F.bit_count(k).alias("ones"), k.bitwiseAND(-k).alias("lowest"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'none') AS page, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def h24_json_path_with_default(spark, d):
    get = lambda p: F.coalesce(F.get_json_object("props", p), F.lit("none"))
    return table(spark, d, "events").select("event_id", get("$.page").alias("page"), get("$.missing").alias("missing"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '<mail>', 'g'), '\\b\\d{1,3}(\\.\\d{1,3}){3}\\b', '<address>', 'g'), '\\b\\d{12,19}\\b', '<number>', 'g')) AS digest FROM documents""")
def h25_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.redacted(F.col("text")).cast("binary")).alias("digest"))


@query(f"WITH {POINTS} SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat)), 9) AS z FROM points")
def h26_unit_vectors(spark, d):
    return points(spark, d).select("id", *[F.round(c, 9).alias(n) for c, n in zip(space.unit_vector(F.col("lat"), F.col("lon")), "xyz", strict=True)])


@query("""WITH v AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 9)) AS i)), c AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY 1, 2)
SELECT vec_id, round(sqrt(avg(pow((x - m) / s, 2))), 5) AS mismatch FROM v JOIN c USING (label, i) WHERE s > 0 GROUP BY 1""")
def h27_rms_mismatch(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    stats = [f(F.col("v")[i]) for f in (F.avg, F.stddev_pop) for i in range(8)]
    c = e.groupBy("label").agg(F.array(*stats[:8]).alias("m"), F.array(*stats[8:]).alias("s"))
    return e.join(c, "label").select("vec_id", F.round(S.rms_mismatch(F.col("v"), F.col("m"), F.col("s")), 5).alias("mismatch"))


@query("WITH RECURSIVE g AS (SELECT s::BIGINT AS seed, 0 AS k, s::BIGINT AS x, s::BIGINT AS y FROM (SELECT c_custkey AS s FROM customer) UNION ALL SELECT seed, k + 1, (x * 1664525 + 1013904223) % 4294967296, (WITH a AS (SELECT xor(y, (y << 13) & 4294967295) AS a), b AS (SELECT xor(a, a >> 17) AS b FROM a) SELECT xor(b, (b << 5) & 4294967295) FROM b) FROM g WHERE k < 25) SELECT seed, x AS lcg, y AS xorshift FROM g WHERE k = 25")
def j20_portable_generators(spark, d):
    """Both generators after 25 steps from each customer's key."""
    seed = F.col("c_custkey")
    return table(spark, d, "customer").select(seed.alias("seed"), S.lcg32(seed, 25).alias("lcg"), S.xorshift32(seed, 25).alias("xorshift"))
