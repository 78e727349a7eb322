"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_shard_tree")
def op4_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query(
    "op9_extendible_hash_dedup",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
""",
)
def op9_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.exactdedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket")


@query("op8_pack_bounded_space")
def op8_pack_bounded_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op1_mix_pfair")
def op1_mix_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.mixing import mix_schedule

    return mix_schedule(table(spark, sf_dir, "documents"))


@query("op5_langid_viterbi")
def op5_langid_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.langid import identify_documents

    return identify_documents(table(spark, sf_dir, "documents")).drop("spans")


@query("op10_brown_class_lm")
def op10_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.brown import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op2_hyperminhash_neardup")
def op2_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_site_templates")
def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.htmlmain import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query("op3_nn_descent")
def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_license_spans")
def op6_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query(
    "op13_byte_transducer_audit",
    r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM d),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY ALL),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 100 THEN 'A' ELSE '' END ||
  CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * capitals > 10 * length(text) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
  CASE WHEN min(w.doc_id) OVER (PARTITION BY text) < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT part, filter_order, fails, n, good, toxic, unnest([1, 2, 3, 4, 5]) AS step FROM cells, orders),
stepped AS (SELECT *, filter_order[step] AS letter, contains(fails, filter_order[step]) AS hit,
  CASE WHEN step = 1 THEN false ELSE len(list_intersect(string_split(filter_order[1:step - 1], ''), string_split(fails, ''))) > 0 END AS earlier
  FROM steps),
one AS (SELECT part, filter_order, step, letter,
  sum(n) FILTER (NOT earlier AND NOT hit) AS kept, sum(n) FILTER (NOT earlier AND hit) AS removed,
  sum(n) FILTER (earlier AND hit) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
  sum(good) FILTER (NOT earlier AND hit) AS good_lost, sum(toxic) FILTER (NOT earlier AND hit) AS toxic_lost
  FROM stepped GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM one
""",
)
def op13_byte_transducer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.filteraudit import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_iceberg_prefix_divergence",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN (SELECT lang, v FROM v) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS q FROM k JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
""",
)
def op12_iceberg_prefix_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


@query("op11_ownership_secrets")
def op11_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsluice.llm.credentials import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))
