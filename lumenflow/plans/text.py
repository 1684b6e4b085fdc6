"""Queries on documents as passages, and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import documents as do
from ..operators import frames as fr
from ..operators import merge as mg
from ..operators import metrics as me
from ..sources import adapters as ad
from .registry import query

TERMS = ["the", "and", "of"]
TOKENS = "list_filter(regexp_split_to_array(trim(text, ' \n\t'), '\\s+'), lambda t: t <> '')"
WINDOWED = f"""tk AS (SELECT doc_id, {TOKENS} AS t FROM documents),
    wn AS (SELECT doc_id, t, CAST(i AS INT) AS passage FROM tk, generate_series(0, 2000) AS g(i) WHERE len(t) > 0 AND i < greatest(1, ceil((len(t) - 20) / 80.0))),
    ps AS (SELECT doc_id, passage, array_to_string(t[passage * 80 + 1 : passage * 80 + 100], ' ') AS text FROM wn)"""
SCORE = "CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('the', 'and', 'of'))) / len(w) ELSE 0 END"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sc.token_windows("text", 100, 20)).alias("passage", "text"))


@query(f"WITH {WINDOWED} SELECT doc_id, passage, md5(text) AS digest FROM ps")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "passage", F.md5("text").alias("digest"))


@query(
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM p),
    g AS (SELECT *, sum(CASE WHEN i = 1 OR len(s) >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM u),
    j AS (SELECT doc_id, grp, string_agg(s, ' ' ORDER BY i) AS s FROM g GROUP BY ALL),
    w AS (SELECT doc_id, grp, s, lead(s) OVER (PARTITION BY doc_id ORDER BY grp) AS nxt, count(*) OVER (PARTITION BY doc_id) AS n FROM j)
    SELECT doc_id, CAST(grp - 1 AS INT) AS passage, md5(CASE WHEN nxt IS NULL THEN s ELSE s || ' ' || nxt END) AS digest FROM w WHERE nxt IS NOT NULL OR n = 1"""
)
def sentence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return do.passages(ad.table(spark, sf_dir, "documents"), 2, 1).select("doc_id", "passage", F.md5("text").alias("digest"))


@query(f"WITH {WINDOWED}, s AS (SELECT doc_id, passage, {SCORE} AS s FROM (SELECT doc_id, passage, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_]+'), lambda x: x <> '') AS w FROM ps)), v AS (SELECT doc_id, list(s ORDER BY s DESC) AS v FROM s GROUP BY doc_id) SELECT doc_id, round(list_avg(v[1:2]), 6) AS score FROM v")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _windows(spark, sf_dir).select(F.lit(0).alias("query_id"), "doc_id", do.lexical_score(F.col("text"), TERMS).alias("score"))
    return do.pooled(p, 2).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {WINDOWED}, c AS (SELECT doc_id, count(*) AS n FROM ps GROUP BY doc_id) SELECT count(*) AS n_docs, quantile_cont(n, 0.5) AS median_passages FROM c")
def passage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return do.counts(_windows(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN j THEN 1 ELSE 0 END AS is_judged FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS j FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id) ORDER BY j DESC, doc_id LIMIT 500")
def judged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is what it does."""
    return do.judged_first(ad.table(spark, sf_dir, "documents").select("doc_id"), ad.table(spark, sf_dir, "labels"), 500).select("doc_id", "is_judged")


@query(
    """WITH m AS (SELECT q.label AS query_label, q.vec_id AS token, d.label, max(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS s FROM embeddings d, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY ALL)
    SELECT query_label, label, round(sum(s), 6) AS score FROM m GROUP BY ALL"""
)
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as documents of token vectors; a query's tokens are a label's vectors whose ids are divisible by 20."""
    e = ad.table(spark, sf_dir, "embeddings")
    tokens = e.select("label", F.col("embedding").alias("emb"))
    queries = e.where(F.col("vec_id") % 20 == 0).select(F.struct("label", "vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = fr.similarity(tokens, queries).groupBy(F.col("query_id.label").alias("query_label"), "query_id.vec_id", "label").agg(F.max("sim").alias("s"))
    return best.groupBy("query_label", "label").agg(F.round(F.sum("s"), 6).alias("score"))


@query("SELECT conv_id, turn, rtrim(text) LIKE '%?' AS question, regexp_matches(lower(text), '\\b(how many|how often|count|number of|total|overall|summar|main topic|mainly|throughout|in general|average|most of|all of|order of|sequence|entire)') AS aggregate FROM conversations")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", sc.is_question("text").alias("question"), sc.is_aggregate_question("text").alias("aggregate"))


@query("SELECT p_partkey, CASE WHEN f <> '' THEN f ELSE regexp_extract(r, '\\b([ABCD])\\b', 1) END AS letter FROM (SELECT p_partkey, r, regexp_extract(r, '^([ABCD])(?:[^A-Z]|$)', 1) AS f FROM (SELECT p_partkey, upper(trim(p_brand)) || ' ' || substr('ABCDE', CAST(p_partkey % 5 + 1 AS INT), 1) AS r FROM part))")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.table(spark, sf_dir, "part")
    reply = F.concat_ws(" ", "p_brand", F.substr(F.lit("ABCDE"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1)))
    return p.select("p_partkey", sc.answer_letter(reply).alias("letter"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def url_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "pages").select("page_id", sc.stem("url").alias("stem"))


@query("SELECT event_id, CASE WHEN v % 7 = 0 THEN 0.0 ELSE round(v / (v % 7), 6) END AS rate FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events)")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("value").cast("long")
    e = ad.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(sc.rate(F.concat(v.cast("string"), F.lit("/"), (v % 7).cast("string"))), 6).alias("rate"))


@query("SELECT CASE lower(split_part(p_type, ' ', 1)) WHEN 'caption' THEN 'caption' ELSE 'other' END AS meta, count(*) AS n FROM part GROUP BY ALL")
def meta_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "part").groupBy(sc.meta_task(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("meta")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT o_custkey, list({'text': o_orderpriority, 'conf': o_totalprice} ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_transform(list_filter(l, lambda x: x.conf >= 100000 AND len(trim(x.text)) >= 6), lambda x: trim(x.text)), ' ') AS text FROM l")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("conf")))).alias("l"))
    return o.select("o_custkey", mg.lines_text("l", 100000, 6).alias("text"))


@query("SELECT p_partkey, CAST(greatest(4, least(1280, ceil(p_size * 40 / 28.0) * ceil(p_size * 30 / 28.0))) AS INT) AS tokens FROM part")
def visual_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "part").select("p_partkey", sc.visual_tokens(F.col("p_size") * 40, F.col("p_size") * 30).alias("tokens"))


@query("WITH v AS (SELECT l_orderkey, list(l_quantity / 10 ORDER BY l_linenumber, l_partkey) AS y, list(l_discount * 10 ORDER BY l_linenumber, l_partkey) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(ln(list_sum(list_transform(y, lambda x: exp(x)))) - ln(list_sum(list_transform(n, lambda x: exp(x)))), 6) AS log_odds FROM v")
def expert_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ad.table(spark, sf_dir, "lineitem")
    g = l.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") / 10).alias("y"), F.collect_list(F.col("l_discount") * 10).alias("n"))
    return g.select("l_orderkey", F.round(sc.log_odds("y", "n"), 6).alias("log_odds"))


@query("WITH r AS (SELECT d.lang, l.quality, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) AS rn FROM documents d JOIN labels l ON l.doc_id = d.doc_id), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY quality DESC) AS ideal FROM r) SELECT lang, round(sum(CASE WHEN rn <= 10 THEN quality / log2(rn + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN quality / log2(ideal + 1) ELSE 0 END), 6) AS ndcg FROM i GROUP BY lang")
def document_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(ad.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    r = d.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    return me.ndcg(r, ("lang",), 10, "quality").withColumn("ndcg", F.round("ndcg", 6))
