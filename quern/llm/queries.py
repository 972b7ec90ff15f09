"""The queries of this folder, and their DuckDB equivalents where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import arc_to_warc, best_fit_packing, exact_dedup, exact_topk, importance_resampling, language_id, merkle_manifest, quality_classifier, quality_rules, secret_scan, simhash_dedup, source_mixing, suffix_dedup
from quern.sources.tables import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP1 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents),
g AS (SELECT doc_id, content, max(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed_sequences(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(table(spark, sf_dir, "documents"))


def _weights_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in source_mixing.WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE {source_mixing.OTHER} END"


def _level_sql(level: str, parents: list[str], before: str) -> str:
    """One level of the tree: the siblings' water level and the nodes' allowances."""
    path, family = ", ".join([*parents, level]), f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"{family} ORDER BY capacity / weight, {level}"
    above = f"JOIN {before} USING ({', '.join(parents)})" if parents else "CROSS JOIN total"
    return f"""
{level}_nodes AS (SELECT {path}, sum(tokens)::BIGINT * 2 AS capacity, {_weights_sql(level)} AS weight FROM supply GROUP BY {path}),
{level}_water AS (SELECT {path}, capacity, weight, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER ({family}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS water FROM {level}_nodes {above}),
{level}_line AS (SELECT *, max(CASE WHEN water <= capacity / weight THEN water END) OVER ({family}) AS line FROM {level}_water),
{level}_given AS (SELECT {path}, greatest(0, coalesce(least(capacity, floor(line * weight)::BIGINT), capacity)) AS budget FROM {level}_line)"""


OP5 = f"""
WITH counted AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER) AS n,
    CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'books' WHEN n >= 15 THEN 'code' ELSE 'unknown' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
supply AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
total AS (SELECT floor(sum(tokens)::BIGINT * 0.5::DOUBLE)::BIGINT AS budget FROM supply),
{_level_sql("domain", [], "")}, {_level_sql("lang", ["domain"], "domain_given")}, {_level_sql("source", ["domain", "lang"], "lang_given")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(budget / tokens)::BIGINT ELSE 0 END AS whole, budget - whole * tokens AS rest FROM supply JOIN source_given USING (domain, lang, source)),
placed AS (SELECT doc_id, domain, lang, source, tokens, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11:' || whole || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto FROM counted JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, unnest(range(copies)) AS epoch FROM taken WHERE copies > 0
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), with_text=True)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')), 'string_agg', '') AS bits, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(0, 5), lambda j: (16 >> j) * substr(bits, (5 * i + j + 1)::BIGINT, 1)::INTEGER))::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM b
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def _climb_sql(name: str, leaves: str, levels: int) -> str:
    """Levels of trees over ``leaves(tree, i, n, h)``, one CTE a level: each node with its run as a list; a root stays as it is."""
    out, last = [], leaves
    for k in range(levels):
        out.append(f"{name}_run{k} AS (SELECT tree, i // 3 AS p, any_value(n) AS n, list(h ORDER BY i) AS run FROM {last} GROUP BY tree, i // 3)")
        last = f"{name}{k}"
        out.append(f"{last} AS (SELECT tree, p AS i, CASE WHEN n = 1 THEN 1 ELSE (n + 2) // 3 END AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}_run{k})")
    return ",\n".join(out)


def _prove_sql(name: str, start: str, levels: int) -> str:
    """``start(doc_id, tree, i, h, proof)`` carried up the levels: h folded with the siblings, which are added to proof."""
    out, last = [], start
    for k in range(levels):
        at = f"{name}_way{k}"
        out.append(f"""{at} AS (SELECT doc_id, c.tree, c.i // 3 AS i,
  CASE WHEN r.n = 1 THEN c.h ELSE sha256(array_to_string(run[:c.i % 3], '') || c.h || array_to_string(run[c.i % 3 + 2:], '')) END AS h,
  CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(run[:c.i % 3], '') || array_to_string(run[c.i % 3 + 2:], '') END AS proof FROM {last} c JOIN {name}_run{k} r ON c.tree = r.tree AND c.i // 3 = r.p)""")
        last = at
    return ",\n".join(out)


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, j: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"
OP11 = f"""
WITH t AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql("text")} AS h, {_leaf_sql("replace(text, chr(10), '')")} AS bad, {_CRC32} % 2 = 0 AS hit FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM t),
{_climb_sql("low", "leaves", 12)},
sources AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, h FROM low11),
{_climb_sql("up", "sources", 6)},
begun AS (SELECT doc_id, tree, i, CASE WHEN hit THEN bad ELSE h END AS h, '' AS proof FROM leaves),
{_prove_sql("low", "begun", 12)},
halfway AS (SELECT w.doc_id, '' AS tree, s.i, w.h, w.proof FROM low_way11 w JOIN sources s ON s.source = w.tree),
{_prove_sql("up", "halfway", 6)}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, u.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = u.h AS verified
FROM leaves l JOIN sources s ON s.source = l.tree JOIN up5 u ON true JOIN up_way5 w USING (doc_id)
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.nearest(table(spark, sf_dir, "embeddings"))


OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality_classifier, op3_quality_rules, op4_best_fit_packing, op5_source_mixing, op6_secret_scan, op7_suffix_dedup, op8_arc_to_warc, op9_language_id, op10_simhash_dedup, op11_merkle_manifest, op12_importance_resampling, op13_exact_topk, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op5_source_mixing": OP5, "op8_arc_to_warc": OP8, "op11_merkle_manifest": OP11, "op13_exact_topk": OP13}
