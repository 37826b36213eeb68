"""Queries by name, each over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillvec.functions import text as texts
from quillvec.functions import vectors
from quillvec.operators import cluster, embed, search
from quillvec.operators.tokenizer import TokenizerModel
from quillvec.sources import binary, files, synthetic

# Pieces of a small vocabulary in the order of their ids.
PIECES = (
    "<unk> ▁ ▁the ▁of ▁and ▁in ▁de ▁la ▁le ▁der ▁die ▁und ▁el ▁en ▁que ▁th ▁er ▁an ▁on e t a o i n s r h l d u c m p g b f w y v k . , ! ? ' - "
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si "
    "ing ion the ent tion ment ung eau eux ich sch ein é è ç ä ö ü ß ó í ñ"
).split(" ")
#: One id beyond any weight matrix at hand: tokens without a weight drop out of means.
METASPACE = {p: i for i, p in enumerate(PIECES)} | {"▁zu": 1_000_000}
# Pieces that start words, and pieces inside them.
STARTS = "[PAD] [UNK] the of and in th er an on de la le e t a o i n s r h l d u c m p g b f w y v k T O E A I".split(" ")
INSIDE = "e t a o i n s r h l d u c m p g b f w y v k . , th he in er an re on at en nd ti es or te ed ing ion ment ung".split(" ")
WORDPIECE = {p: i for i, p in enumerate(STARTS)} | {"##" + p: len(STARTS) + i for i, p in enumerate(INSIDE)}


def metaspace() -> TokenizerModel:
    return TokenizerModel.from_vocab(METASPACE, "Metaspace", "▁", "<unk>")


def wordpiece() -> TokenizerModel:
    return TokenizerModel.from_vocab(WORDPIECE, "WordPiece", "##", "[UNK]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of long rows in one small file is dealt out anew, as one task would read it all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and 2 * df.rdd.getNumPartitions() <= cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_of(df: DataFrame, id_: int) -> list[float]:
    row = df.where(F.col("id") == id_).select("vector").first()
    return list(row[0]) if row else []


def flat(df: DataFrame, *by: str, vector: str = "vector", digits: int = 6) -> DataFrame:
    """One row per component: (by, dim from 0, value), rounded; a negative zero counts as zero."""
    return df.select(*by, F.posexplode(vector).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.round(F.col("value").cast("double"), digits) + F.lit(0.0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- SQL pieces

_UNIT = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT id, label, v, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS n FROM e)"""
_SEEDS = """s AS (SELECT n, min(id) AS id FROM u WHERE list_dot_product(v, v) > 0 GROUP BY n),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cid, n AS c FROM s ORDER BY id LIMIT 6)"""


def _assign(name: str, centroids: str) -> str:
    return f"{name} AS (SELECT id, n, cid FROM (SELECT u.id, u.n, cid, row_number() OVER (PARTITION BY u.id ORDER BY list_dot_product(u.n, c) DESC, cid) AS r FROM u, {centroids}) WHERE r = 1)"


def _update(name: str, assigned: str, before: str) -> str:
    return f"""{name}_m AS (SELECT cid, dim, avg(x) AS m FROM (SELECT cid, unnest(n) AS x, generate_subscripts(n, 1) AS dim FROM {assigned}) GROUP BY cid, dim),
{name}_n AS (SELECT cid, list(m ORDER BY dim) AS m FROM {name}_m GROUP BY cid),
{name} AS (SELECT b.cid, coalesce(list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))), b.c) AS c FROM {before} b LEFT JOIN {name}_n USING (cid))"""


_PAT = metaspace().pattern().replace("'", "''")
_WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
_KEYS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in METASPACE) + "]"
_TOKENS = f"""w AS (SELECT doc_id, {_WORD_SQL} AS ws FROM documents),
p AS (SELECT doc_id, flatten(list_transform(ws, lambda w: regexp_extract_all('▁' || w, '{_PAT}'))) AS ps FROM w),
vocab AS (SELECT * FROM (VALUES {", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {i})" for t, i in METASPACE.items())}) AS t(key, id))"""


# ---- top-k


@query(f"WITH {_UNIT} SELECT u.id, round(list_dot_product(u.n, q.n), 6) + 0.0 AS similarity FROM u, (SELECT n FROM u WHERE id = 0) q ORDER BY similarity DESC, u.id LIMIT 10")
def knn_exact_topk(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return search.knn_exact(rows, vector_of(rows, 0), 10, digits=6).select("id", (F.col("similarity") + 0.0).alias("similarity"))


@query(f"WITH {_UNIT} SELECT u.id, round(list_dot_product(u.n, q.n), 6) + 0.0 AS similarity FROM u, (SELECT n FROM u WHERE id = 0) q")
def knn_k_exceeds_n(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return search.knn_exact(rows, vector_of(rows, 0), 2_000_000_000, digits=6).select("id", (F.col("similarity") + 0.0).alias("similarity"))


@query(f"""WITH {_UNIT} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, similarity FROM (
SELECT q.id AS query_id, u.id, round(list_dot_product(u.n, q.n), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(u.n, q.n), 6) DESC, u.id) AS rank
FROM u, (SELECT * FROM u WHERE id % 100 = 0) q) WHERE rank <= 5""")
def knn_join_batch(spark, sf_dir):
    rows = entries(spark, sf_dir)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.knn_join(asked, rows, 5, digits=6).withColumn("similarity", F.col("similarity") + 0.0)


@query(f"""WITH {_UNIT}, {_SEEDS}, {_assign("a", "c0")}, q AS (SELECT n, (SELECT cid FROM a WHERE id = 0) AS home FROM u WHERE id = 0)
SELECT a.id, a.cid AS cluster_id, round(list_dot_product(a.n, q.n), 6) + 0.0 AS similarity FROM a, q WHERE a.cid = q.home ORDER BY similarity DESC, a.id LIMIT 10""")
def knn_clustered(spark, sf_dir):
    rows = entries(spark, sf_dir)
    centroids = cluster.seeds(rows)
    stored = search.with_cluster(rows, centroids)
    return search.knn_clustered(stored, centroids, vector_of(rows, 0), 10, digits=6).select("id", "cluster_id", (F.col("similarity") + 0.0).alias("similarity"))


@query(f"""WITH {_UNIT}, {_SEEDS}, {_assign("a", "c0")} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, similarity FROM (
SELECT q.id AS query_id, a.id, round(list_dot_product(a.n, q.n), 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(a.n, q.n), 6) DESC, a.id) AS rank
FROM (SELECT * FROM a WHERE id % 100 = 0) q JOIN a USING (cid)) WHERE rank <= 3""")
def knn_join_clustered(spark, sf_dir):
    rows = entries(spark, sf_dir)
    stored = search.with_cluster(rows, cluster.seeds(rows))
    asked = stored.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "cluster_id")
    return search.knn_join(asked, stored, 3, cluster="cluster_id", digits=6).withColumn("similarity", F.col("similarity") + 0.0)


# ---- clusters


@query(f"WITH {_UNIT}, {_SEEDS}, {_assign('a', 'c0')} SELECT id, cid AS cluster_id FROM a")
def cluster_assign(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return search.with_cluster(rows, cluster.seeds(rows)).select("id", "cluster_id")


@query(f"WITH {_UNIT}, {_SEEDS}, {_assign('a', 'c0')} SELECT cid AS cluster_id, count(*) AS n FROM a GROUP BY cid")
def cluster_sizes(spark, sf_dir):
    return cluster_assign(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_UNIT}, {_SEEDS}, {_assign("a", "c0")}, {_update("c1", "a", "c0")}
SELECT cid AS cluster_id, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS dim, round(unnest(c), 6) + 0.0 AS value FROM c1""")
def centroid_update(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return _centroids(spark, cluster.fit(rows, iterations=1))


def _centroids(spark: SparkSession, centroids: list[list[float]]) -> DataFrame:
    return flat(spark.createDataFrame(list(enumerate(centroids)), "cluster_id int, vector array<double>"), "cluster_id")


@query(f"""WITH {_UNIT}, {_SEEDS}, {_assign("a", "c0")}, {_update("c1", "a", "c0")}, {_assign("a1", "c1")}, {_update("c2", "a1", "c1")}, {_assign("a2", "c2")}
SELECT cid AS cluster_id, count(*) AS n FROM a2 GROUP BY cid""")
def kmeans_two_iters(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return search.with_cluster(rows, cluster.fit(rows, iterations=2)).groupBy("cluster_id").agg(F.count("*").alias("n"))


def _rounds(n: int) -> str:
    return ", ".join([_assign("a0", "c0"), *(x for i in range(1, n + 1) for x in (_update(f"c{i}", f"a{i - 1}", f"c{i - 1}"), _assign(f"a{i}", f"c{i}")))])


@query(f"WITH {_UNIT}, {_SEEDS}, {_rounds(6)} SELECT cid AS cluster_id, count(*) AS n FROM a6 GROUP BY cid")
def kmeans_six_iters(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return search.with_cluster(rows, cluster.fit(rows)).groupBy("cluster_id").agg(F.count("*").alias("n"))


# ---- vectors


@query(f"WITH {_UNIT} SELECT id, CAST(generate_subscripts(n, 1) - 1 AS BIGINT) AS dim, round(unnest(n), 6) + 0.0 AS value FROM u")
def normalize_components(spark, sf_dir):
    return flat(entries(spark, sf_dir).select("id", vectors.l2_normalize("vector").alias("vector")), "id")


@query("SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, 0.0::DOUBLE AS value FROM embeddings")
def zero_vector_normalize(spark, sf_dir):
    zeros = entries(spark, sf_dir).select("id", F.transform("vector", lambda x: F.lit(0.0)).alias("vector"))
    return flat(zeros.select("id", vectors.l2_normalize("vector").alias("vector")), "id")


@query(f"WITH {_UNIT} SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v), 6) + 0.0 AS dot FROM u a JOIN u b ON b.id = a.id + 1")
def dot_product_pairs(spark, sf_dir):
    rows = entries(spark, sf_dir)
    other = rows.select(F.col("id").alias("other"), F.col("vector").alias("w"))
    return rows.join(other, F.col("other") == F.col("id") + 1).select("id", "other", (F.round(vectors.dot("vector", "w"), 6) + 0.0).alias("dot"))


_MEANS = "SELECT {by} CAST(dim - 1 AS BIGINT) AS dim, round(avg(x), 6) + 0.0 AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY {by} dim"


@query(_MEANS.format(by="label,"))
def mean_vector_by_label(spark, sf_dir):
    return flat(embed.mean_vector(entries(spark, sf_dir), ["label"]), "label")


@query(_MEANS.format(by=""))
def mean_vector_global(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("all", F.lit(0))
    return flat(embed.mean_vector(rows, ["all"]))


@query("""SELECT vec_id AS id, CAST((dim - 1) // 4 AS BIGINT) AS dim, round(sum(x) / 4, 6) + 0.0 AS value
FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY vec_id, (dim - 1) // 4""")
def block_mean(spark, sf_dir):
    return flat(entries(spark, sf_dir).select("id", vectors.block_mean("vector", 4).alias("vector")), "id")


@query("SELECT CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings WHERE vec_id = 7")
def row_fetch(spark, sf_dir):
    return flat(entries(spark, sf_dir).where("id = 7").select("vector"))


@query("SELECT vec_id AS id, round(CAST(embedding[3] AS DOUBLE), 6) + 0.0 AS cell FROM embeddings")
def cell_fetch(spark, sf_dir):
    return entries(spark, sf_dir).select("id", (F.round(F.element_at("vector", 3).cast("double"), 6) + 0.0).alias("cell"))


@query('SELECT count(*) AS "rows", CAST(max(len(embedding)) AS BIGINT) AS cols, CAST(count(*) * max(len(embedding)) AS BIGINT) AS size FROM embeddings')
def matrix_shape(spark, sf_dir):
    return entries(spark, sf_dir).agg(F.count("*").alias("rows"), F.max(F.size("vector")).cast("long").alias("cols")).withColumn("size", F.col("rows") * F.col("cols"))


_SPELLED = "'[' || array_to_string(list_transform(embedding, lambda x: format('{:.6g}', CAST(x AS DOUBLE))), ', ') || ']'"


@query(f"SELECT vec_id AS id, {_SPELLED} AS text, '[' || {_SPELLED} || ', ' || {_SPELLED} || ']' AS twice FROM embeddings")
def vector_to_string(spark, sf_dir):
    return entries(spark, sf_dir).select("id", vectors.vector_to_string("vector").alias("text"), vectors.matrix_to_string(F.array("vector", "vector")).alias("twice"))


# ---- words and tokens


@query(f"SELECT doc_id, CAST(len({_WORD_SQL}) AS BIGINT) AS n_words, md5(array_to_string({_WORD_SQL}, ' ')) AS words_md5 FROM documents")
def whitespace_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", texts.words(F.coalesce("text", F.lit(""))).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def _digest(tokens: DataFrame, unk: str) -> DataFrame:
    keys = F.transform("t", lambda t: t["key"])
    unknown = F.size(F.filter("t", lambda t: t["key"] == unk)).cast("long")
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), unknown.alias("n_unk"), F.md5(F.array_join(keys, " ")).alias("keys_md5"))


@query(f"""WITH {_TOKENS}, k AS (SELECT doc_id, list_transform(ps, lambda x: CASE WHEN list_contains({_KEYS}, x) THEN x ELSE '<unk>' END) AS ks FROM p)
SELECT doc_id, CAST(len(ks) AS BIGINT) AS n_tokens, CAST(len(list_filter(ks, lambda x: x = '<unk>')) AS BIGINT) AS n_unk, md5(array_to_string(ks, ' ')) AS keys_md5 FROM k""")
def tokenize_metaspace(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents").select("doc_id", metaspace().tokenize("text").alias("t")), "<unk>")


@query(SQL["tokenize_metaspace"])
def tokenize_metaspace_trie(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents").select("doc_id", metaspace().tokenize("text", "trie").alias("t")), "<unk>")


_FIRST, _MORE = (
    "|".join(re.escape(t) for t in sorted(v, key=lambda p: (-len(p), p))).replace("'", "''") for v in (WORDPIECE, [t[2:] for t in WORDPIECE if t.startswith("##")])
)


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORD_SQL}) AS w, generate_subscripts({_WORD_SQL}, 1) AS i FROM documents),
f AS (SELECT doc_id, i, w, regexp_extract(w, '^({_FIRST})', 1) AS a FROM w),
g AS (SELECT doc_id, i, CASE WHEN a = '' THEN '[UNK]' ELSE a END AS a, regexp_extract_all(substr(w, CASE WHEN a = '' THEN 2 ELSE length(a) + 1 END), '{_MORE}|(?s:.)') AS ps FROM f),
k AS (SELECT doc_id, i, list_concat([a], list_transform(ps, lambda x: CASE WHEN list_contains([{", ".join("'" + t[2:].replace(chr(39), chr(39) * 2) + "'" for t in WORDPIECE if t.startswith("##"))}], x) THEN '##' || x ELSE '[UNK]' END)) AS ks FROM g),
d AS (SELECT doc_id, flatten(list(ks ORDER BY i)) AS ks FROM k GROUP BY doc_id)
SELECT documents.doc_id, CAST(len(coalesce(ks, [])) AS BIGINT) AS n_tokens, CAST(len(list_filter(coalesce(ks, []), lambda x: x = '[UNK]')) AS BIGINT) AS n_unk, md5(array_to_string(coalesce(ks, []), ' ')) AS keys_md5
FROM documents LEFT JOIN d USING (doc_id)""")
def tokenize_wordpiece(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents").select("doc_id", wordpiece().tokenize("text").alias("t")), "[UNK]")


@query(f"WITH {_TOKENS} SELECT coalesce(vocab.key, '<unk>') AS key, count(*) AS n FROM (SELECT unnest(ps) AS x FROM p) LEFT JOIN vocab ON key = x GROUP BY 1")
def token_counts(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(metaspace().tokenize("text")).alias("t"))
    return tokens.groupBy(F.col("t.key").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(list_filter(ps, lambda x: NOT list_contains({_KEYS}, x) OR x = '<unk>')) AS BIGINT) AS n_unk FROM p")
def unk_count(spark, sf_dir):
    return tokenize_metaspace(spark, sf_dir).select("doc_id", "n_unk")


@query(f"""WITH {_TOKENS}, t AS (SELECT doc_id, coalesce(vocab.id, 0) AS id FROM (SELECT doc_id, unnest(ps) AS x FROM p) LEFT JOIN vocab ON key = x)
SELECT count(*) AS n_tokens, count(vec_id) AS n_valid FROM t LEFT JOIN embeddings ON vec_id = id""")
def valid_token_filter(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(metaspace().tokenize("text")).alias("t"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    both = tokens.groupBy(F.col("t.id").alias("token_id")).agg(F.count("*").alias("n")).join(rows, F.col("token_id") == F.col("vec_id"), "left")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("vec_id").isNotNull(), F.col("n"))), F.lit(0)).alias("n_valid"))


_EMBEDDED = f"""{_TOKENS}, t AS (SELECT doc_id, coalesce(vocab.id, 0) AS id, count(*) AS n FROM (SELECT doc_id, unnest(ps) AS x FROM p) LEFT JOIN vocab ON key = x GROUP BY 1, 2),
j AS (SELECT doc_id, n, CAST(embedding AS DOUBLE[]) AS v FROM t JOIN embeddings ON vec_id = id),
m AS (SELECT doc_id, dim, sum(x * n) / sum(n) AS x FROM (SELECT doc_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM j) GROUP BY doc_id, dim)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed.embed(docs, metaspace(), _weights(spark, sf_dir))


@query(f"WITH {_EMBEDDED} SELECT doc_id, CAST(dim - 1 AS BIGINT) AS dim, round(x, 6) + 0.0 AS value FROM m")
def embed_mean(spark, sf_dir):
    return flat(embedded(spark, sf_dir), "doc_id")


_SEARCHED = f"""{_EMBEDDED}, d AS (SELECT doc_id, list(x ORDER BY dim) AS v FROM m GROUP BY doc_id),
n AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS n FROM d),
r AS (SELECT doc_id, round(list_dot_product(n, (SELECT n FROM n WHERE doc_id = 1)), 6) + 0.0 AS similarity FROM n)"""


@query(f"WITH {_SEARCHED} SELECT r.doc_id, similarity, split_part(text, chr(10), 1) AS line FROM r JOIN documents USING (doc_id) ORDER BY similarity DESC, r.doc_id LIMIT 1")
def text_search_top1(spark, sf_dir):
    return _searched(spark, sf_dir, 1).select("doc_id", "similarity", texts.first_line("text").alias("line"))


def _searched(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The texts nearest to document 1, itself among them."""
    docs, weights = table(spark, sf_dir, "documents").select("doc_id", "text"), _weights(spark, sf_dir)
    asked = embed.embed(docs.where("doc_id = 1"), metaspace(), weights).select("vector").first()
    docs = embed.embed(docs, metaspace(), weights)
    return search.knn_exact(docs, list(asked[0]) if asked and asked[0] else [], k, key="doc_id", digits=6).withColumn("similarity", F.col("similarity") + 0.0)


@query(f"""WITH {_SEARCHED}, b AS (SELECT r.doc_id, similarity, split_part(text, chr(10), 1) AS line FROM r JOIN documents USING (doc_id) ORDER BY similarity DESC, r.doc_id LIMIT 5)
SELECT string_agg(line, chr(10) ORDER BY similarity DESC, doc_id) || chr(10) AS result FROM b""")
def search_concat(spark, sf_dir):
    best = _searched(spark, sf_dir, 5)  # five rows
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "doc_id")))
    return search.search_concat(ranked)


@query("SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents")
def text_first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.first_line("text").alias("line"))


@query("SELECT doc_id, md5(replace(text, chr(10), '')) AS joined_md5 FROM documents")
def newline_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.without_newlines("text")).alias("joined_md5"))


@query("SELECT doc_id, upper(substr(hex(encode(text)), 1, 2046)) AS dump FROM documents")
def hex_dump(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.hex_dump("text").alias("dump"))


@query(r"SELECT p_partkey, regexp_replace(p_name || chr(13), '\r$', '') AS line, 'db/' || p_partkey || '.txt' AS path FROM part")
def return_strip_and_path(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", texts.without_return(F.concat("p_name", F.lit("\r"))).alias("line"), texts.entry_path("db", "p_partkey").alias("path"))


# ---- sources


def _csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quoted commas, doubled quotes, an open quote, two and four fields, unit separators, and carriage returns."""
    name, brand, key = F.col("p_name"), F.col("p_brand"), F.col("p_partkey").cast("string")
    turn = F.col("p_partkey") % 6
    made = (
        F.when(turn == 0, F.concat_ws(",", key, name, brand)).when(turn == 1, F.concat(key, F.lit(',"'), name, F.lit(', x",'), brand, F.lit("\r")))
        .when(turn == 2, F.concat(key, F.lit(',"a""b '), name, F.lit('",'), brand)).when(turn == 3, F.concat(key, F.lit(',"'), name, F.lit(","), brand))
        .when(turn == 4, F.concat_ws(",", key, name)).otherwise(F.concat(key, F.lit(",\x1f"), name, F.lit(",")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("line"))


_CSV = """l AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey || ',' || p_name || ',' || p_brand WHEN 1 THEN p_partkey || ',"' || p_name || ', x",' || p_brand || chr(13)
WHEN 2 THEN p_partkey || ',"a""b ' || p_name || '",' || p_brand WHEN 3 THEN p_partkey || ',"' || p_name || ',' || p_brand WHEN 4 THEN p_partkey || ',' || p_name ELSE p_partkey || ',' || chr(31) || p_name || ',' END AS line FROM part),
q AS (SELECT p_partkey, string_split(CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END, '"') AS s FROM l),
f AS (SELECT p_partkey, string_split(array_to_string(list_transform(s, lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, ',', chr(1)) ELSE x END), ''), chr(1)) AS f FROM q)"""


@query(f"WITH {_CSV} SELECT p_partkey, f[1] AS c1, f[2] AS c2, f[3] AS c3 FROM f WHERE len(f) = 3")
def csv3_parse(spark, sf_dir):
    return files.csv_rows(_csv_lines(spark, sf_dir)).select("p_partkey", "c1", "c2", "c3")


@query("""SELECT event_id, CASE WHEN json_type(j, '$.t') = 'VARCHAR' THEN json_extract_string(j, '$.t') ELSE 'N/A' END AS c1,
CASE WHEN json_type(j, '$.k') = 'VARCHAR' THEN json_extract_string(j, '$.k') ELSE 'N/A' END AS c2, CASE WHEN json_type(j, '$.p') = 'VARCHAR' THEN json_extract_string(j, '$.p') ELSE 'N/A' END AS c3
FROM (SELECT event_id, json_merge_patch(props, json_object('t', event_type)) AS j FROM events)""")
def jsonl_object_project(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"t": "'), "event_type", F.lit('", '), F.substring("props", 2, 1 << 30)).alias("line"))
    return files.json_rows(lines, "OBJECT", ["t", "k", "p"]).select("event_id", "c1", "c2", "c3")


@query("SELECT event_id, event_type AS c1, 'N/A' AS c2, event_type || '\"x' AS c3 FROM events")
def jsonl_array_project(spark, sf_dir):
    line = F.concat(F.lit('["'), "event_type", F.lit('", 2.5, "'), "event_type", F.lit('\\"x"]'))
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return files.json_rows(lines, "ARRAY", ["0", "1", "2"]).select("event_id", "c1", "c2", "c3")


def _scratch(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else tempfile.mkdtemp(prefix="quillvec-")


def _written(lines: DataFrame, path: str, order: str, head: str | None = None) -> str:
    """The ``line`` column as text files whose names follow the order; as one file below ``head`` if there is one."""
    ordered = lines.select(F.struct(F.lit(1).alias("p"), F.col(order).alias("o")).alias("_o"), "line")
    if head is not None:
        first = lines.sparkSession.range(1).select(F.struct(F.lit(0).alias("p"), F.lit(None).cast(lines.schema[order].dataType).alias("o")).alias("_o"), F.lit(head).alias("line"))
        ordered = first.unionByName(ordered)
    (ordered.orderBy("_o") if head is None else ordered.repartitionByRange(1, "_o").sortWithinPartitions("_o")).select("line").write.text(path)
    return path


@query("""SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS row_num, line AS c1, 'N/A' AS c2, 'N/A' AS c3 FROM
(SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE line <> ''""")
def txt_rows(spark, sf_dir):
    """All texts as text files, read in splits: lines and their numbers in file order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("line"))
    return files.read_txt3(spark, _written(docs, f"{_scratch(spark)}/txt", "doc_id")).rows


_FILES = f"""WITH {_CSV}, k AS (SELECT count(*) AS n FROM f WHERE len(f) = 3), j AS (SELECT count(*) AS n FROM events),
c AS (SELECT len(json_keys(props)) AS columns FROM events ORDER BY event_id LIMIT 1), t AS (SELECT count(*) AS n FROM part WHERE p_name <> '')
SELECT 'csv' AS format, n, n AS "end", 4 AS columns FROM k UNION ALL SELECT 'jsonl', n, n, CAST(columns AS INTEGER) FROM j, c UNION ALL SELECT 'txt', n, n, 1 FROM t"""


@query(_FILES)
def file_readers(spark, sf_dir):
    """CSV, JSON lines and text written and read back through the readers: rows and columns of each."""
    out = _scratch(spark)
    part, events = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    csv = _written(_csv_lines(spark, sf_dir), f"{out}/csv", "p_partkey", 'a,"b,c",d,e')
    jsonl = _written(events.select("event_id", F.col("props").alias("line")), f"{out}/jsonl", "event_id")
    txt = _written(part.select("p_partkey", F.col("p_name").alias("line")), f"{out}/txt", "p_partkey")
    made = [("csv", files.read_csv3(spark, csv)), ("jsonl", files.read_jsonl3(spark, jsonl)), ("txt", files.read_txt3(spark, txt))]
    frames = [m.rows.agg(F.count("*").alias("n"), (F.max("row_num") + 1).alias("end")).select(F.lit(n).alias("format"), "n", "end", F.lit(m.columns).alias("columns")) for n, m in made]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT count(*) AS n, 64 AS dim, true AS inside, count(*) AS different FROM embeddings")
def synthetic_vectors(spark, sf_dir):
    """As many random vectors as there are entries: all of one length, within bounds, and different."""
    rows = synthetic.random_vectors(spark, entries(spark, sf_dir).count(), 64, seed=1)
    inside = (F.min(F.array_min("vector")) >= -1) & (F.max(F.array_max("vector")) < 1)
    return rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), inside.alias("inside"), F.countDistinct("vector").alias("different"))


# ---- changes


def _store(spark: SparkSession, sf_dir: str):
    """A new store of all entries in order of their ids, which count from 0 as the store's do."""
    from quillvec.operators.store import VectorStore

    rows = entries(spark, sf_dir).withColumn("text", F.col("label").cast("string"))
    made = VectorStore(spark, f"{_scratch(spark)}/store", rows.agg(F.max(F.size("vector"))).first()[0])
    made.add(rows, text="text", order="id")
    return made, rows


def _stored(store) -> DataFrame:
    """All of a store's entries, a row for each component."""
    rows = store.entries().select("id", "vector", "file_path", F.col("text").cast("int").alias("label"))
    return flat(rows, "id", "file_path", "label")


_NUMBERED = f"{_UNIT}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, label, n FROM u)"
_COMPONENTS = "SELECT id, 'db/' || id || '.txt' AS file_path, label, CAST(generate_subscripts(n, 1) - 1 AS BIGINT) AS dim, round(CAST(CAST(unnest(n) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM"


@query(f"WITH {_NUMBERED} {_COMPONENTS} r WHERE id NOT IN (3, 5)")
def delete_by_id(spark, sf_dir):
    store, _ = _store(spark, sf_dir)
    assert store.delete(3) and store.delete(5) and not store.delete(3)
    return _stored(store)


@query(f"WITH {_NUMBERED}, t AS (SELECT count(*) AS n FROM r), x AS (SELECT id, label, n FROM r WHERE id <> 7 UNION ALL SELECT r.id + t.n, r.label, r.n FROM r, t) {_COMPONENTS} x")
def insert_ids(spark, sf_dir):
    """Ids go on after a delete; a store that is opened again goes on too."""
    from quillvec.operators.store import VectorStore

    store, rows = _store(spark, sf_dir)
    store.delete(7)
    again = VectorStore(spark, store.path, store.dim)
    again.add(rows, text="text", order="id")
    return _stored(VectorStore(spark, store.path, store.dim))


@query("SELECT CAST(count(*) AS BIGINT) AS next_id, CAST(count(*) - 1 AS BIGINT) AS n FROM embeddings")
def next_id(spark, sf_dir):
    store, _ = _store(spark, sf_dir)
    store.delete(store.current_id() - 1)
    return store.entries().agg(F.count("*").alias("n")).withColumn("next_id", F.lit(store.current_id()).cast("long"))


@query("""WITH l AS (SELECT p_partkey, p_name || ',' || p_brand || ',' || p_partkey AS line FROM part), n AS (SELECT count(*) AS n FROM part),
r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name AS c1, p_brand AS c2, CAST(p_partkey AS VARCHAR) AS c3 FROM part)
SELECT CAST(i AS BIGINT) AS row_num, c1, c2, c3 FROM r UNION ALL SELECT CAST(i + n AS BIGINT), c1, c2, c3 FROM r, n""")
def append_loads(spark, sf_dir):
    """One CSV file loaded twice; rows of the second load follow those of the first."""
    path = f"{_scratch(spark)}/csv"
    part = table(spark, sf_dir, "part")
    lines = part.select("p_partkey", F.concat_ws(",", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("line"))
    _written(lines, path, "p_partkey", "name,brand,key")
    first = files.read_csv3(spark, path)
    return first.append(files.read_csv3(spark, path)).rows


@query(f"WITH {_NUMBERED} {_COMPONENTS} r WHERE id <> 2")
def save_load_roundtrip(spark, sf_dir):
    from quillvec.operators.store import VectorStore

    store, _ = _store(spark, sf_dir)
    store.delete(2)
    path = _scratch(spark)
    store.save(f"{path}/b")
    other = VectorStore(spark, f"{path}/c", store.dim)
    other.load(f"{path}/b")
    assert other.current_id() == store.current_id()
    return _stored(other)


def _binary_roundtrip(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values, after being written and read: (id, dim, value)."""
    binary.register(spark)
    rows = entries(spark, sf_dir)
    path = os.path.join(binary.local(_scratch(spark)), kind)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    key = "token_id" if kind == "npy" else "id"
    made = rows.select(F.col("id").cast("int").alias(key), "vector", F.lit("db/x.txt").alias("file_path")).orderBy(key)
    made.write.format(kind).mode("overwrite").option("dtype", "<f4").save(path)
    back = spark.read.format(kind).load(path)
    return flat(back.select(F.col(key).cast("long").alias("id"), "vector"), "id")


QUERIES["npy_roundtrip"] = partial(_binary_roundtrip, "npy")
QUERIES["vecbin_roundtrip"] = partial(_binary_roundtrip, "vecbin")
_VALUES = "SELECT {id} AS id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings"
SQL["npy_roundtrip"] = _VALUES.format(id="(row_number() OVER (ORDER BY vec_id) - 1)")
SQL["vecbin_roundtrip"] = _VALUES.format(id="vec_id")
