"""I01-I23, J01-J03, J19, K02-K09."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import models as M
from quern.operators import ranks as R
from quern.operators import stats as T
from quern.operators.aggregates import quantiles, r6, ratio
from quern.operators.ranks import with_places
from quern.plans.registry import query
from quern.sources.relations import DIST, GROUPS, OBS, TAXA, distribution, observations, taxa, unit_groups
from quern.sources.tables import table

LI = "li AS (SELECT l_linenumber AS g, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"
RANKED = ", ".join(f"rank() OVER (PARTITION BY g ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / 2 AS {c}" for c in "xyz")


def _li(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


@query(f"WITH {LI}, r AS (SELECT g, {RANKED} FROM li) SELECT g, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def i01_spearman(spark, d):
    return T.spearman(_li(spark, d), ["g"], "x", "y").select("g", r6(F.col("rho")).alias("rho"))


@query(f"WITH {LI}, r AS (SELECT g, {RANKED} FROM li), c AS (SELECT g, corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c FROM r GROUP BY 1) SELECT g, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS rho FROM c")
def i02_partial_spearman(spark, d):
    return T.partial_spearman(_li(spark, d), ["g"], "x", "y", "z").select("g", r6(F.col("rho")).alias("rho"))


@query(f"WITH {LI}, s AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM li GROUP BY 1), e AS (SELECT g, y - a - b * x AS e FROM li JOIN s USING (g)) SELECT g, round(stddev_pop(e), 3) AS residual_sd, round(max(e), 3) AS largest FROM e GROUP BY 1")
def i03_residuals(spark, d):
    li = _li(spark, d)
    s = li.groupBy("g").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    e = li.join(s, "g").select("g", (F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("e"))
    return e.groupBy("g").agg(F.round(F.stddev_pop("e"), 3).alias("residual_sd"), F.round(F.max("e"), 3).alias("largest"))


@query(f"WITH {LI} SELECT g, round((covar_pop(x, y) * var_pop(z) - covar_pop(z, y) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - covar_pop(x, z) * covar_pop(x, z)), 4) AS slope FROM li GROUP BY 1")
def i04_partial_coefficient(spark, d):
    return _li(spark, d).groupBy("g").agg(F.round(T.two_control_slope("y", "x", "z"), 4).alias("slope"))


@query(f"WITH {LI} SELECT g, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM li GROUP BY 1")
def i05_ols_descriptive(spark, d):
    return _li(spark, d).groupBy("g").agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 2).alias("intercept"), r6(F.regr_r2("y", "x")).alias("r2"))


@query(f"WITH {LI}, m AS (SELECT g, count(*) AS n, covar_pop(x, y) AS xy, var_pop(x) AS vx, avg(x) AS mx, avg(y) AS my FROM li GROUP BY 1) SELECT g, round(xy / (vx * (1 + 20.0 / n)), 4) AS slope, round(my - mx * xy / (vx * (1 + 20.0 / n)), 2) AS intercept FROM m")
def i06_ridge(spark, d):
    fit = M.ridge(_li(spark, d), ["g"], ["x"], "y", alpha=20.0)
    return fit.select("g", F.round(F.col("coefficients")[0], 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(f"WITH {LI}, m AS (SELECT g, sum(x) AS w, sum(x * z) / sum(x) AS mz, sum(x * y) / sum(x) AS my, sum(x * z * y) / sum(x) AS zy, sum(x * z * z) / sum(x) AS zz FROM li GROUP BY 1) SELECT g, round((zy - mz * my) / (zz - mz * mz), 2) AS slope FROM m")
def i07_weighted_least_squares(spark, d):
    return M.ridge(_li(spark, d), ["g"], ["z"], "y", weight=F.col("x")).select("g", F.round(F.col("coefficients")[0], 2).alias("slope"))


ARMS = "arms AS (SELECT c_nationkey AS g, c_mktsegment = 'BUILDING' AS arm, c_acctbal AS x FROM customer)"


def _arms(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_mktsegment") == "BUILDING").alias("arm"), F.col("c_acctbal").alias("x"))


@query(f"WITH {ARMS} SELECT a.g, round(avg(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END), 6) AS superiority FROM arms a JOIN arms b ON a.g = b.g AND a.arm AND NOT b.arm GROUP BY 1")
def i14_probability_of_superiority(spark, d):
    return T.superiority(_arms(spark, d), ["g"], "arm", "x").where("superiority is not null").select("g", r6(F.col("superiority")).alias("superiority"))


@query(f"WITH {ARMS} SELECT a.g, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END)::DOUBLE AS u, round(2 * avg(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) - 1, 6) AS rank_biserial FROM arms a JOIN arms b ON a.g = b.g AND a.arm AND NOT b.arm GROUP BY 1")
def i15_mann_whitney(spark, d):
    return T.superiority(_arms(spark, d), ["g"], "arm", "x").where("superiority is not null").select("g", F.col("u").cast("double").alias("u"), r6(F.col("rank_biserial")).alias("rank_biserial"))


@query("WITH t AS (SELECT s_nationkey AS g, count(*) FILTER (s_acctbal > 4500) AS w, count(*) FILTER (s_acctbal <= 4500) AS l FROM supplier GROUP BY 1), e AS (SELECT g, w, l, unnest(range(0, least(w, l) + 1)) AS i FROM t) SELECT g, w::BIGINT AS wins, l::BIGINT AS losses, round(least(1.0, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2)))), 6) AS p FROM e GROUP BY 1, 2, 3")
def i16_exact_sign_test(spark, d):
    t = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.count_if(F.col("s_acctbal") > 4500).alias("wins"), F.count_if(F.col("s_acctbal") <= 4500).alias("losses"))
    return t.select("g", "wins", "losses", r6(T.sign_test(F.col("wins").cast("int"), F.col("losses").cast("int"))).alias("p"))


CASES = "cases AS (SELECT n_nationkey AS id, 200 AS total, 40 + n_nationkey AS marked, 30 AS drawn, n_nationkey % 12 AS seen FROM nation)"


@query(f"WITH {CASES}, e AS (SELECT *, unnest(range(seen, least(marked, drawn) + 1)) AS i FROM cases) SELECT id, round(sum(exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1) - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1))), 6) AS p FROM e GROUP BY 1")
def i17_hypergeometric_tail(spark, d):
    k = F.col("n_nationkey").cast("long")
    cases = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(200).cast("long").alias("total"), (k + 40).alias("marked"), F.lit(30).cast("long").alias("drawn"), (k % 12).alias("seen"))
    return T.upper_tail(spark, cases, 200).select("id", r6(F.col("p")).alias("p"))


@query(f"WITH {OBS}, c AS (SELECT dataset, species, count(*) AS s FROM obs GROUP BY 1, 2), t AS (SELECT *, sum(s) OVER (PARTITION BY dataset) AS n FROM c) SELECT dataset, round(sum(1 - list_product(list_transform(range(0, 5), lambda i: greatest(0, n - s - i) / (n - i)))), 6) AS expected_species FROM t WHERE n >= 5 GROUP BY 1")
def i18_rarefied_richness(spark, d):
    c = observations(spark, d).groupBy("dataset", "species").agg(F.count("*").alias("s")).withColumn("n", F.sum("s").over(Window.partitionBy("dataset")))
    absent = F.lit(1.0)
    for i in range(5):
        absent = absent * F.greatest(F.lit(0), F.col("n") - F.col("s") - i) / (F.col("n") - i)
    return c.where("n >= 5").groupBy("dataset").agg(r6(F.sum(1 - absent)).alias("expected_species"))


@query(f"WITH {CASES} SELECT id, round(exp(lgamma(marked + 1) - lgamma(seen + 1) - lgamma(marked - seen + 1) + lgamma(total - marked + 1) - lgamma(drawn - seen + 1) - lgamma(total - marked - drawn + seen + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)), 6) AS p FROM cases")
def i19_fixed_margin_probability(spark, d):
    k = F.col("n_nationkey").cast("long")
    cases = table(spark, d, "nation").select(k.alias("id"), F.lit(200).cast("long").alias("total"), (k + 40).alias("marked"), F.lit(30).cast("long").alias("drawn"), (k % 12).alias("seen"))
    tails = T.upper_tail(spark, cases.withColumn("id", F.col("id") * 2).union(cases.withColumn("id", F.col("id") * 2 + 1).withColumn("seen", F.col("seen") + 1)), 200)
    return tails.groupBy(F.floor(F.col("id") / 2).cast("int").alias("id")).agg(r6(F.sum(F.when(F.col("id") % 2 == 0, F.col("p")).otherwise(-F.col("p")))).alias("p"))


@query()
def i20_fisher_tost(spark, d):
    """Equivalence of each group's rank correlation with 0 within 0.1: the larger of two one-sided p."""
    rho = T.spearman(_li(spark, d), ["g"], "x", "z").join(_li(spark, d).groupBy("g").agg(F.count("*").alias("n")), "g")
    z = lambda bound: (F.atanh("rho") - F.atanh(F.lit(bound))) * F.sqrt(F.col("n") - 3)
    return rho.select("g", r6(F.col("rho")).alias("rho"), r6(F.greatest(1 - S.normal_cdf(z(-0.1)), S.normal_cdf(z(0.1)))).alias("p"))


@query(f"WITH {DIST}, {GROUPS}, t AS (SELECT resource, count(*) AS n, count(*) FILTER (native) AS k FROM dist GROUP BY 1), s AS (SELECT resource, grp, count(*) AS n, count(*) FILTER (native) AS k FROM dist JOIN groups USING (unit) GROUP BY 1, 2) SELECT t.resource, round(t.k * t.n / 25, 6) AS expected, round(sum(s.k * s.n / 5), 6) AS stratified FROM t JOIN s USING (resource) GROUP BY t.resource, t.k, t.n")
def i21_expected_overlap(spark, d):
    s = distribution(spark, d).join(unit_groups(spark, d), "unit").groupBy("resource", "grp").agg(F.count("*").alias("n"), F.count_if("native").alias("k"))
    return s.groupBy("resource").agg(r6(F.sum("k") * F.sum("n") / 25).alias("expected"), r6(F.sum(F.col("k") * F.col("n") / 5)).alias("stratified"))


@query("""WITH v AS (SELECT n_nationkey AS k, n_regionkey AS g, avg(c_acctbal) AS x FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), z AS (SELECT *, x - avg(x) OVER () AS e FROM v), w AS (SELECT a.k, a.e, avg(b.e) AS near FROM z a JOIN z b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2) SELECT round(sum(e * near) / sum(e * e), 6) AS moran FROM w""")
def i22_moran_i(spark, d):
    v = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.avg("c_acctbal").alias("x")).join(unit_groups(spark, d), "unit")
    z = v.crossJoin(F.broadcast(v.agg(F.avg("x").alias("m")))).withColumn("e", F.col("x") - F.col("m"))  # one row
    per = Window.partitionBy("grp")
    near = z.withColumn("near", ratio(F.sum("e").over(per) - F.col("e"), F.count("*").over(per) - 1)).where("near is not null")
    return near.agg(r6(F.sum(F.col("e") * F.col("near")) / F.sum(F.col("e") * F.col("e"))).alias("moran"))


@query("WITH t AS (SELECT c_nationkey AS g, (c_acctbal > 4500)::INT AS a, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT AS b FROM customer) SELECT g, round(corr(a, b), 6) AS phi FROM t GROUP BY 1")
def i23_phi(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") > 4500).cast("int").alias("a"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("b"))
    return t.groupBy("g").agg(r6(T.pearson("a", "b")).alias("phi"))


def _permuted(df, by, key, value, draws, tag):
    """(by, key, value, draw, permuted): values dealt anew within ``by`` by the order of a hash of tag, draw and key."""
    grid = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    placed = with_places(grid, ["draw", *by], [key], "place")
    hashed = grid.select("draw", *by, key, F.col(value).alias("permuted"), F.sha2(F.concat_ws("|", F.lit(tag), "draw", key), 256).alias("_h"))
    donors = with_places(hashed, ["draw", *by], ["_h", key], "place").select("draw", *by, "place", "permuted")
    return placed.join(donors, ["draw", *by, "place"])


PERM = "g AS (SELECT * FROM nat, (SELECT unnest(range(20)) AS draw)), p AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY k) AS place, row_number() OVER (PARTITION BY draw ORDER BY sha256('perm|' || draw || '|' || k), k) AS t FROM g), q AS (SELECT a.draw, a.k, a.x, b.x AS permuted, a.y FROM p a JOIN p b ON a.draw = b.draw AND a.place = b.t)"
NAT = "nat AS (SELECT n_nationkey AS k, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"


def _nat(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"), F.count("*").cast("double").alias("y"))


@query(f"WITH {NAT}, {PERM} SELECT draw::INTEGER AS draw, k, round(permuted, 4) AS permuted FROM q")
def j01_hash_permutations(spark, d):
    return _permuted(_nat(spark, d), [], "k", "x", 20, "perm").select("draw", "k", F.round("permuted", 4).alias("permuted"))


@query(f"WITH {NAT}, {PERM}, c AS (SELECT draw, corr(permuted, y) AS r FROM q GROUP BY 1), o AS (SELECT corr(x, y) AS r FROM nat) SELECT round(o.r, 6) AS observed, round((1 + count(*) FILTER (c.r >= o.r)) / 21.0, 6) AS p FROM c, o GROUP BY o.r")
def j02_permutation_p(spark, d):
    nat = _nat(spark, d)
    c = _permuted(nat, [], "k", "x", 20, "perm").groupBy("draw").agg(T.pearson("permuted", "y").alias("r"))
    o = F.broadcast(nat.agg(T.pearson("x", "y").alias("o")))  # one row
    return c.crossJoin(o).groupBy("o").agg(r6((1 + F.count_if(F.col("r") >= F.col("o"))) / 21).alias("p")).select(r6(F.col("o")).alias("observed"), "p")


@query(f"WITH {NAT}, f AS (SELECT regr_slope(x, y) AS b, regr_intercept(x, y) AS a FROM nat), e AS (SELECT k, x - a - b * y AS x, y, a + b * y AS fit FROM nat, f), g AS (SELECT * FROM e, (SELECT unnest(range(20)) AS draw)), p AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY k) AS place, row_number() OVER (PARTITION BY draw ORDER BY sha256('fl|' || draw || '|' || k), k) AS t FROM g) SELECT a.draw::INTEGER AS draw, round(corr(a.fit + b.x, a.y), 6) AS r FROM p a JOIN p b ON a.draw = b.draw AND a.place = b.t GROUP BY 1")
def j03_freedman_lane(spark, d):
    nat = _nat(spark, d)
    fit = F.broadcast(nat.agg(F.regr_slope("x", "y").alias("b"), F.regr_intercept("x", "y").alias("a")))  # one row
    e = nat.crossJoin(fit).select("k", "y", (F.col("a") + F.col("b") * F.col("y")).alias("fit"), (F.col("x") - F.col("a") - F.col("b") * F.col("y")).alias("e"))
    dealt = _permuted(e, [], "k", "e", 20, "fl").withColumn("new", F.col("fit") + F.col("permuted"))
    return dealt.groupBy("draw").agg(r6(T.pearson("new", "y")).alias("r"))


@query("WITH t AS (SELECT c_nationkey AS g, c_custkey AS k, c_acctbal AS x FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS place, row_number() OVER (PARTITION BY g ORDER BY sha256('stratum|0|' || k), k) AS t FROM t) SELECT a.k, b.x AS permuted FROM p a JOIN p b ON a.g = b.g AND a.place = b.t")
def j04_within_stratum_permutation(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    return _permuted(t, ["g"], "k", "x", 1, "stratum").select("k", "permuted")


@query("WITH s AS (SELECT c_nationkey AS g, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1) SELECT g, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 4) AS without FROM s")
def j06_leave_one_out(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    total = F.broadcast(s.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn")))  # one row
    return s.crossJoin(total).select("g", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 4).alias("without"))


@query(f"WITH {NAT}, {PERM}, c AS (SELECT draw, corr(permuted, y) AS r FROM q GROUP BY 1), o AS (SELECT corr(x, y) AS o FROM nat) SELECT round((1 + count(*) FILTER (r >= o)) / (1 + count(*)), 6) AS upper, round((1 + count(*) FILTER (r <= o)) / (1 + count(*)), 6) AS lower, round((1 + count(*) FILTER (abs(r) >= abs(o))) / (1 + count(*)), 6) AS two_sided, round(quantile_cont(r, 0.5), 6) AS median FROM c, o")
def j19_tail_probabilities(spark, d):
    nat = _nat(spark, d)
    c = _permuted(nat, [], "k", "x", 20, "perm").groupBy("draw").agg(T.pearson("permuted", "y").alias("r")).crossJoin(F.broadcast(nat.agg(T.pearson("x", "y").alias("o"))))
    tail = lambda ok: r6((1 + F.count_if(ok)) / (1 + F.count("*")))
    r, o = F.col("r"), F.col("o")
    return c.agg(tail(r >= o).alias("upper"), tail(r <= o).alias("lower"), tail(F.abs(r) >= F.abs(o)).alias("two_sided"), *quantiles("r", {"median": 0.5}))


FOLDED = "folded AS (SELECT n_nationkey AS k, (('0x' || substr(sha256('fold:' || n_name), 1, 10))::BIGINT % 5)::INTEGER AS fold FROM nation)"


def _folded(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), R.hash_fold(F.concat(F.lit("fold:"), "n_name"), 5, 10).alias("fold"))


@query(f"WITH {FOLDED} SELECT f::INTEGER AS fold, count(*) FILTER (a.fold <> f AND b.fold <> f)::BIGINT AS train, count(*) FILTER (a.fold = f AND b.fold = f)::BIGINT AS test FROM folded a JOIN folded b ON a.k < b.k, (SELECT unnest(range(5)) AS f) GROUP BY 1")
def k02_double_unseen_folds(spark, d):
    f = _folded(spark, d)
    pairs = f.select(F.col("k").alias("a"), F.col("fold").alias("fa")).join(f.select(F.col("k").alias("b"), F.col("fold").alias("fb")), F.col("a") < F.col("b"))
    grid = pairs.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    held = lambda c: F.col(c) == F.col("fold")
    return grid.groupBy("fold").agg(F.count_if(~held("fa") & ~held("fb")).alias("train"), F.count_if(held("fa") & held("fb")).alias("test"))


@query(f"WITH {FOLDED}, p AS (SELECT least(a.fold, b.fold) AS k, greatest(a.fold, b.fold) AS h FROM folded a JOIN folded b ON a.k < b.k) SELECT k, h, count(*)::BIGINT AS test FROM p GROUP BY 1, 2")
def k03_block_pair_plan(spark, d):
    f = _folded(spark, d)
    pairs = f.select(F.col("k").alias("a"), F.col("fold").alias("fa")).join(f.select(F.col("k").alias("b"), F.col("fold").alias("fb")), F.col("a") < F.col("b"))
    return pairs.groupBy(F.least("fa", "fb").alias("k"), F.greatest("fa", "fb").alias("h")).agg(F.count("*").alias("test"))


@query(f"WITH {OBS}, c AS (SELECT species, dataset, week, sum(value) AS v FROM obs GROUP BY ALL) SELECT a.week AS train_week, count(*)::BIGINT AS pairs, round(avg(b.v - a.v), 6) AS mean_change FROM c a JOIN c b ON a.species = b.species AND a.dataset = b.dataset AND b.week = a.week + 1 GROUP BY 1")
def k05_temporal_transition(spark, d):
    c = observations(spark, d).groupBy("species", "dataset", "week").agg(F.sum("value").alias("v"))
    after = c.select("species", "dataset", (F.col("week") - 1).alias("week"), F.col("v").alias("after"))
    return c.join(after, ["species", "dataset", "week"]).groupBy(F.col("week").alias("train_week")).agg(F.count("*").alias("pairs"), r6(F.avg(F.col("after") - F.col("v"))).alias("mean_change"))


@query(f"WITH {OBS}, w AS (SELECT o::INTEGER AS origin FROM (SELECT unnest([2, 3, 4]) AS o)) SELECT origin, count(*) FILTER (week < origin)::BIGINT AS train, count(*) FILTER (week BETWEEN origin AND origin + 1)::BIGINT AS test FROM obs, w GROUP BY 1")
def k06_rolling_origin(spark, d):
    o = observations(spark, d).withColumn("origin", F.explode(F.array(*[F.lit(k) for k in (2, 3, 4)])))
    return o.groupBy("origin").agg(F.count_if(F.col("week") < F.col("origin")).alias("train"), F.count_if(F.col("week").between(F.col("origin"), F.col("origin") + 1)).alias("test"))


@query("WITH e AS (SELECT l_linenumber AS fold, avg(pow(l_discount - 0.05, 2)) AS base, avg(pow(l_discount - 0.049 - l_tax / 50, 2)) AS full FROM lineitem GROUP BY 1) SELECT count(*) FILTER (\"full\" < base - 1e-12)::BIGINT AS improved, count(*) FILTER (\"full\" > base + 1e-12)::BIGINT AS worse, count(*) FILTER (abs(\"full\" - base) <= 1e-12)::BIGINT AS tied, round(100 * (1 - sum(\"full\") / sum(base)), 4) AS gain FROM e".replace("AS full", 'AS "full"'))
def k07_nested_model_comparison(spark, d):
    sq = lambda e: F.avg(e * e)
    e = table(spark, d, "lineitem").groupBy("l_linenumber").agg(sq(F.col("l_discount") - 0.05).alias("base"), sq(F.col("l_discount") - 0.049 - F.col("l_tax") / 50).alias("full"))
    gap = F.col("full") - F.col("base")
    return e.agg(F.count_if(gap < -1e-12).alias("improved"), F.count_if(gap > 1e-12).alias("worse"), F.count_if(F.abs(gap) <= 1e-12).alias("tied"), F.round(100 * (1 - F.sum("full") / F.sum("base")), 4).alias("gain"))


@query(f"WITH {FOLDED} SELECT f::INTEGER AS fold, (SELECT count(*) FROM folded a JOIN folded b USING (k) WHERE a.fold = f AND b.fold <> f)::BIGINT AS overlap, (SELECT count(*) FROM folded WHERE fold = f)::BIGINT AS test FROM (SELECT unnest(range(5)) AS f)")
def k09_disjointness_proofs(spark, d):
    f = _folded(spark, d)
    folds = spark.range(5).select(F.col("id").cast("int").alias("fold"))
    both = f.join(f.select("k", F.col("fold").alias("other")), "k").groupBy("fold").agg(F.count_if(F.col("fold") != F.col("other")).alias("overlap"), F.count("*").alias("test"))
    return folds.join(both, "fold", "left").fillna(0)


@query(f"WITH {DIST}, {TAXA}, b AS (SELECT family, resource, count(*)::DOUBLE AS n, count(*) FILTER (native)::DOUBLE AS a FROM dist JOIN taxa USING (resource) GROUP BY 1, 2), m AS (SELECT f.family, count(*) AS n, covar_pop(b.n, b.a) / var_pop(b.n) AS s, avg(b.a) AS ma, avg(b.n) AS mn FROM b JOIN (SELECT DISTINCT family FROM b) f ON b.family <> f.family GROUP BY 1) SELECT b.family, round(avg(pow(a - (ma + s * (b.n - mn)), 2)), 5) AS mse FROM b JOIN m USING (family) GROUP BY 1")
def k04_leave_one_group_out(spark, d):
    b = distribution(spark, d).join(taxa(spark, d), "resource").groupBy("family", "resource").agg(F.count("*").cast("double").alias("n"), F.count_if("native").cast("double").alias("a"))
    p = M.leave_group_out(b, "family", ["n"], "a")
    e = F.col("a") - F.col("prediction")
    return p.groupBy("family").agg(F.round(F.avg(e * e), 5).alias("mse"))
