import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quern.llm.exact_dedup import exact_dedup, exact_groups
from tests.llm.helpers import DOCS, awkward_texts, documents, rows, with_clashes


def expected(pairs):
    def norm(t):
        return (t or "").encode().lower().decode()

    groups = defaultdict(list)
    for i, t in pairs:
        groups[norm(t)].append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return [{"doc_id": i, "keep_id": best[norm(t)], "group_size": len(groups[norm(t)]), "kept": i == best[norm(t)], "digest": hashlib.sha256(norm(t).encode()).hexdigest()} for i, t in pairs]


def test_groups_match_brute_force(spark):
    texts = awkward_texts()
    docs = documents(spark, texts)
    assert rows(exact_groups(with_clashes(docs)), "doc_id") == expected(list(enumerate(texts)))


def test_colliding_digests_are_told_apart_by_content(spark):
    texts = awkward_texts()
    docs = documents(spark, texts)
    got = rows(exact_groups(docs, digest=lambda t: F.lit("same")), "doc_id")
    assert [{**r, "digest": ""} for r in got] == [{**r, "digest": ""} for r in expected(list(enumerate(texts)))]


def test_null_and_repeated_ids_and_empty_tables(spark):
    pairs = [(None, "a"), (None, "A"), (3, "b"), (None, "b"), (3, "b"), (4, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_groups(docs), "doc_id", "keep_id")}
    assert got == {(None, None, 2, True), (3, 3, 3, True), (None, 3, 3, False), (4, 4, 1, True)}
    assert exact_groups(docs.limit(0)).count() == 0


def test_filter_keeps_all_columns_of_one_document_a_group(spark):
    texts = awkward_texts()
    docs = with_clashes(documents(spark, texts))
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r["doc_id"] for r in expected(list(enumerate(texts))) if r["kept"]}


def test_filter_keeps_one_row_of_null_and_repeated_ids(spark):
    pairs = [(None, "a"), (None, "A"), (3, "b"), (None, "b"), (3, "B"), (3, "c"), (2, "c"), (4, None), (4, ""), (None, "d")]
    kept = exact_dedup(spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)).collect()
    assert sorted(((r.text or "").lower(), r.doc_id or 0) for r in kept) == [("", 4), ("a", 0), ("b", 3), ("c", 3), ("d", 0)]


def test_filter_moves_neither_texts_nor_rows(spark):
    """Neither the groups of copies nor the choice of rows carry texts through a shuffle, nor does a table's size change the plan."""
    from quern.plans.rows import ROW, chosen, numbered

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # 3000 numbers are more
    try:
        plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    rows = numbered(spark.range(0, 1000, 1, 7))
    odd = rows.where("id % 3 = 1 or id > 900")
    assert sorted(r.id for r in chosen(rows, odd.select(ROW)).collect()) == [i for i in range(1000) if i % 3 == 1 or i > 900]
    assert chosen(rows, rows.select(ROW).limit(0)).count() == 0


def test_filter_compares_contents_where_all_hashes_agree(spark, monkeypatch):
    """Hashes only say what need not be compared: where they agree for all texts the same documents stay."""
    texts = [*awkward_texts(), "ab", "ba", "BA", "Ab", "c" * 64, "d" * 64]
    docs = with_clashes(documents(spark, texts))
    monkeypatch.setattr(F, "sha2", lambda text, bits: F.lit("00"))
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(0).cast("long"))
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r["doc_id"] for r in expected(list(enumerate(texts))) if r["kept"])


def test_others_are_the_rows_that_are_not_chosen(spark):
    from quern.plans.rows import ROW, numbered, others

    rows = numbered(spark.range(0, 1000, 1, 7))
    odd = rows.where("id % 3 = 1 or id > 900").select(ROW)
    left = others(rows, odd)
    assert left.columns == ["id", ROW] and sorted(r.id for r in left.collect()) == [i for i in range(901) if i % 3 != 1]
    assert others(rows, odd.limit(0)).count() == 1000 and others(rows, rows.select(ROW)).count() == 0
