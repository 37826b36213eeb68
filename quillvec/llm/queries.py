"""The queries of this subpackage by name, each over its whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licences, nearest, packing, passages, pii, quality, quotes, simhash, suffixes
from .common import durable, small_batches

#: The key of the surrogates in these queries; a deployment has its own secret.
KEY = "quillvec example key"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; dealt out anew if its files would keep half of the cores idle, as one small file does."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), vocabulary(), 2048)
    cut = durable(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(cut, ["doc_id", "piece", "ids_crc32"], 2048)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda p: p["kind"]))), ",")
    return made.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), kinds.alias("kinds"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.nearest(rows, F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", none.alias("page_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text")
    pages = table(spark, sf_dir, "pages").select(none.alias("doc_id"), "page_id", licences.page_path(F.col("url")).alias("path"), licences.page_text(F.col("html")).alias("text"))
    made = licences.scan(docs.unionByName(pages), keep=["doc_id", "page_id", "path"])
    return made.withColumn("score", F.round("score", 6))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 3)


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.thread(table(spark, sf_dir, "conversations"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return made.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"], decoded="decoded")
    return made.select("doc_id", *bpe.digests())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_pii_surrogates, op3_nearest, op4_licences, op5_simhash, op6_quotation_linking, op7_passages, op8_suffix_array, op9_bpe, op10_quality_rules,
    )
}

_LEVELS = ", ".join(f"('{name}', CAST({level.replace(' div ', ' // ')} AS INTEGER))" for name, level in quality.RULES.items())
_RATE = 0.05 / len(quality.RULES)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: DuckDB SQL for the queries that it can express.
SQL: dict[str, str] = {
    "op3_nearest": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id AS query_id, min(v) AS w FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
p AS (SELECT query_id, vec_id, sqrt(list_reduce(list_transform(v, lambda x, i: (x - w[i]) * (x - w[i])), lambda a, b: a + b)) AS score FROM q JOIN e ON e.vec_id <> query_id AND len(v) = len(w)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_suffix_array": """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM b)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM d)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y, z FROM r),
j AS (SELECT doc_id, count(*) AS n, sum(z - a) AS removed, max(z) AS last, string_agg(substr(h, CAST(2 * y + 1 AS BIGINT), CAST(2 * (a - y) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM b LEFT JOIN j USING (doc_id)""",
    "op10_quality_rules": f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
y AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS tri FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM y WHERE tri IS NOT NULL) WHERE n > 1),
v AS (SELECT doc_id, sum(least(3, coalesce(after - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM z) GROUP BY doc_id),
c AS (SELECT t.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines FROM t LEFT JOIN v USING (doc_id)),
f AS (SELECT *, ({quality.BASE}) AS base_failed FROM c),
l AS (SELECT stratum, rule, level, quality, (f.doc_id & 4) = 4 AS held FROM f JOIN labels USING (doc_id), LATERAL (VALUES {_LEVELS}) AS r(rule, level) WHERE NOT base_failed AND quality IN (0, 1)),
m AS (SELECT stratum, rule, level, sum(CASE WHEN held AND quality = 1 THEN 1 ELSE 0 END) AS held, sum(CASE WHEN NOT held AND quality = 0 THEN 1 ELSE 0 END) AS bad FROM l GROUP BY ALL),
n AS (SELECT stratum, rule, level - 1 AS cutoff, CAST(sum(held) OVER a AS BIGINT) AS k, CAST(sum(held) OVER (PARTITION BY stratum, rule) AS BIGINT) AS n, sum(bad) OVER a AS n_bad FROM m WINDOW a AS (PARTITION BY stratum, rule ORDER BY level DESC)),
o AS (SELECT *, CASE WHEN k >= n * {_RATE} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp((CASE WHEN n < 1 THEN 0 ELSE lgamma(n + 1.0) END) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) END AS bound FROM n),
p AS (SELECT *, min(CASE WHEN bound <= 0.05 / ({len(quality.RULES)} * (SELECT count(DISTINCT stratum) FROM n)) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS passed FROM o),
q AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY n_bad DESC, cutoff DESC) AS r FROM p WHERE passed = 1 AND n_bad > 0) WHERE r = 1),
s AS (SELECT DISTINCT f.doc_id FROM f, LATERAL (VALUES {_LEVELS}) AS r(rule, level) JOIN q ON q.rule = r.rule WHERE q.stratum = f.stratum AND level > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM s) AS kept FROM f""",
}
