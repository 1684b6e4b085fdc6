"""Queries on events, recall and ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import chunks as chunk_list
from ..functions.vectors import iou
from ..operators import events as ev
from ..operators import metrics as me
from ..sources import adapters as ad
from .registry import query

GAP = 43200.0
SCORES = "sc AS (SELECT user_id AS video, event_type AS query_id, event_id AS frame_idx, epoch_us(ts) / 1e6 AS ts, value - 50 AS score FROM events)"
EVENTS = f"""{SCORES},
    pos AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video, query_id ORDER BY ts) <= {GAP} THEN 0 ELSE 1 END AS new FROM sc WHERE score > 0),
    run AS (SELECT *, sum(new) OVER (PARTITION BY video, query_id ORDER BY ts) AS event FROM pos),
    evt AS (SELECT video, query_id, event, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n_frames, max(score) AS peak FROM run GROUP BY ALL)"""
#: Hits of the recall queries: the ten best frames of each stream that are true.
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY video, query_id ORDER BY sin(frame_idx) DESC, frame_idx) AS rank FROM sc)"
HITS = f"{RANKED}, hit AS (SELECT * FROM rk WHERE rank <= 10 AND score > 0)"
FOUND = "fnd AS (SELECT evt.*, EXISTS (SELECT 1 FROM hit WHERE hit.video = evt.video AND hit.query_id = evt.query_id AND hit.ts BETWEEN t_start AND t_end) AS found FROM evt)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.events_from_scores(ad.scores(spark, sf_dir), 0.0, GAP)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("video", "query_id").orderBy(F.desc(F.sin("frame_idx")), "frame_idx")
    return ad.scores(spark, sf_dir).withColumn("rank", F.row_number().over(order))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("rank <= 10 and score > 0")


@query(f"WITH {EVENTS} SELECT video, query_id, t_start, t_end, n_frames, round(peak, 6) AS peak FROM evt")
def events_from_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("video", "query_id", "t_start", "t_end", "n_frames", F.round("peak", 6).alias("peak"))


@query(f"WITH {EVENTS}, {HITS}, {FOUND} SELECT video, query_id, round(avg(found::INT), 6) AS event_recall, count(*) AS n_events FROM fnd GROUP BY ALL")
def event_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.event_recall(_events(spark, sf_dir), _hits(spark, sf_dir)).withColumn("event_recall", F.round("event_recall", 6))


@query(f"WITH {SCORES}, {HITS} SELECT sc.video, sc.query_id, round(count(hit.frame_idx) / count(*), 6) AS frame_recall FROM sc LEFT JOIN hit ON hit.video = sc.video AND hit.query_id = sc.query_id AND hit.frame_idx = sc.frame_idx WHERE sc.score > 0 GROUP BY ALL")
def frame_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives = ad.scores(spark, sf_dir).where("score > 0")
    return ev.frame_recall(positives, _hits(spark, sf_dir)).withColumn("frame_recall", F.round("frame_recall", 6))


WANTED = "wanted AS (SELECT user_id AS video, event_id, epoch_us(ts) / 1e6 AS ts FROM events WHERE event_type = 'click'), tbl AS (SELECT user_id AS video, epoch_us(ts) / 1e6 AS ts FROM events WHERE event_type = 'view')"


def _wanted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return ad.scores(spark, sf_dir).where(F.col("query_id") == kind).select("video", F.col("frame_idx").alias("event_id"), "ts")


@query(f"WITH {WANTED}, c AS (SELECT wanted.video, event_id, tbl.ts AS near_ts, row_number() OVER (PARTITION BY wanted.video, event_id ORDER BY abs(tbl.ts - wanted.ts), tbl.ts DESC) AS rn FROM wanted JOIN tbl ON tbl.video = wanted.video) SELECT wanted.video, wanted.event_id, near_ts FROM wanted LEFT JOIN c ON c.video = wanted.video AND c.event_id = wanted.event_id AND rn = 1")
def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.nearest(_wanted(spark, sf_dir, "click"), _wanted(spark, sf_dir, "view").select("video", "ts"), ("video",)).select("video", "event_id", "near_ts")


@query(f"WITH {WANTED} SELECT wanted.video, wanted.event_id, CASE WHEN tbl.ts - wanted.ts <= 3600 THEN tbl.ts END AS near_ts FROM wanted ASOF LEFT JOIN tbl ON wanted.video = tbl.video AND wanted.ts <= tbl.ts")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next frame only, if it is within the tolerance."""
    return ev.nearest(_wanted(spark, sf_dir, "click"), _wanted(spark, sf_dir, "view").select("video", "ts"), ("video",), 3600.0, side="forward").select("video", "event_id", "near_ts")


@query(f"WITH {WANTED} SELECT wanted.video, wanted.event_id, tbl.ts AS at FROM wanted ASOF LEFT JOIN tbl ON wanted.video = tbl.video AND wanted.ts >= tbl.ts")
def backward_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _wanted(spark, sf_dir, "view").select("video", "ts", F.col("ts").alias("at"))
    return ev.backward(_wanted(spark, sf_dir, "click"), table, ("video",), "at").select("video", "event_id", "at")


@query(
    f"""WITH {EVENTS}, {RANKED}, sel AS (SELECT * FROM rk WHERE rank <= 10), hit AS (SELECT * FROM sel WHERE score > 0), {FOUND},
    er AS (SELECT video, query_id, avg(found::INT) AS event_recall FROM fnd GROUP BY ALL),
    fr AS (SELECT sc.video, sc.query_id, count(hit.frame_idx) / count(*) AS frame_recall FROM sc LEFT JOIN hit ON hit.video = sc.video AND hit.query_id = sc.query_id AND hit.frame_idx = sc.frame_idx WHERE sc.score > 0 GROUP BY ALL),
    ct AS (SELECT video, query_id, count(*) AS n_selected, count(*) FILTER (score > 0) AS n_confirmed FROM sel GROUP BY ALL)
    SELECT ct.video, ct.query_id, n_selected, n_confirmed, round(n_confirmed / n_selected, 6) AS precision, round(event_recall, 6) AS event_recall, round(frame_recall, 6) AS frame_recall
    FROM ct LEFT JOIN er ON er.video = ct.video AND er.query_id = ct.query_id LEFT JOIN fr ON fr.video = ct.video AND fr.query_id = ct.query_id"""
)
def evaluate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = _ranked(spark, sf_dir).where("rank <= 10").select("video", "query_id", "ts")
    out = ev.evaluate_selection(ad.scores(spark, sf_dir), selected, 0.0, GAP)
    return out.select("video", "query_id", "n_selected", "n_confirmed", *[F.round(c, 6).alias(c) for c in ("precision", "event_recall", "frame_recall")])


@query(f"WITH {EVENTS}, {RANKED}, grid AS (SELECT unnest([1, 2, 5, 10, 20]) AS budget), f AS (SELECT budget, evt.video, evt.query_id, EXISTS (SELECT 1 FROM rk WHERE rk.video = evt.video AND rk.query_id = evt.query_id AND rank <= budget AND score > 0 AND rk.ts BETWEEN t_start AND t_end) AS found FROM evt, grid), q AS (SELECT budget, video, query_id, avg(found::INT) AS r FROM f GROUP BY ALL) SELECT CAST(budget AS INT) AS budget, round(avg(r), 6) AS recall, count(*) AS n FROM q GROUP BY budget")
def recall_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ev.best_rank_per_event(_events(spark, sf_dir), _ranked(spark, sf_dir).where("score > 0"), 0.0)
    per = best.crossJoin(F.broadcast(spark.createDataFrame([(b,) for b in (1, 2, 5, 10, 20)], "budget int")))
    q = per.groupBy("budget", "video", "query_id").agg(F.avg((F.col("best_rank") <= F.col("budget")).cast("double")).alias("r"))
    return q.groupBy("budget").agg(F.round(F.avg("r"), 6).alias("recall"), F.count("*").alias("n"))


@query(f"WITH {SCORES}, {RANKED} SELECT video, query_id, CAST(min(rank) AS INT) AS depth FROM rk WHERE score > 0 GROUP BY ALL")
def depth_to_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.depth_to_first_hit(_ranked(spark, sf_dir))


@query(f"WITH {EVENTS}, {RANKED}, b AS (SELECT evt.video, evt.query_id, event, min(rank) AS best FROM evt JOIN rk ON rk.video = evt.video AND rk.query_id = evt.query_id AND rk.ts BETWEEN t_start - 1e-6 AND t_end + 1e-6 GROUP BY ALL), q AS (SELECT budget, video, query_id, avg((best <= budget)::INT) AS c FROM b, (SELECT unnest([1, 4, 16]) AS budget) GROUP BY ALL) SELECT CAST(budget AS INT) AS budget, round(avg(c), 6) AS ceiling FROM q GROUP BY budget")
def topk_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ev.best_rank_per_event(_events(spark, sf_dir), _ranked(spark, sf_dir))
    return ev.topk_ceiling(best, [1, 4, 16]).withColumn("ceiling", F.round("ceiling", 6))


@query(f"WITH {EVENTS}, {HITS}, {FOUND} SELECT floor, count(*) AS n_events, round(avg(found::INT), 6) AS recall FROM fnd, (SELECT unnest([0.0, 50.0, 150.0, 300.0])::DOUBLE AS floor) WHERE peak >= floor GROUP BY floor")
def recall_by_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.found_events(_events(spark, sf_dir), _hits(spark, sf_dir))
    return ev.recall_by_peak(found, [0, 50, 150, 300]).withColumn("recall", F.round("recall", 6))


@query(f"WITH {EVENTS}, n AS (SELECT video, query_id, count(*) AS n FROM sc GROUP BY ALL) SELECT evt.video, evt.query_id, t_start, round(least(1.0, 8.0 * n_frames / n), 6) AS p FROM evt JOIN n ON n.video = evt.video AND n.query_id = evt.query_id")
def uniform_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.scores(spark, sf_dir).groupBy("video", "query_id").agg(F.count("*").alias("n"))
    return ev.uniform_recall(_events(spark, sf_dir).join(n, ["video", "query_id"]), 8, "n").select("video", "query_id", "t_start", F.round("p", 6).alias("p"))


@query(f"WITH {SCORES}, g AS (SELECT video, ts - lag(ts) OVER (PARTITION BY video ORDER BY ts) AS step FROM sc) SELECT video, round(quantile_cont(step, 0.5), 3) AS median_step, round(max(step), 3) AS max_step FROM g GROUP BY video")
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.gap_audit(ad.scores(spark, sf_dir), ("video",)).select("video", F.round("median_step", 3).alias("median_step"), F.round("max_step", 3).alias("max_step"))


@query(f"WITH {SCORES}, u AS (SELECT video, ts FROM sc UNION ALL SELECT video, ts + 1e-7 FROM sc), l AS (SELECT *, lag(ts) OVER (PARTITION BY video ORDER BY ts) AS b FROM u) SELECT video, count(*) AS n FROM l WHERE b IS NULL OR ts - b > 1e-3 GROUP BY video")
def shard_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.scores(spark, sf_dir).select("video", "ts")
    union = s.unionByName(s.withColumn("ts", F.col("ts") + 1e-7))
    return ev.deduplicated_times(union, ("video",), 1e-3).groupBy("video").agg(F.count("*").alias("n"))


# ranked chunks: orders are queries, their lines ranked chunks, early lines the truth

CHUNKED = """ln AS (SELECT l_orderkey AS query_id, l_linenumber, l_extendedprice AS score, l_quantity, (l_linenumber - 1) * 10.0 AS t_start, l_linenumber * 10.0 AS t_end FROM lineitem),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l_linenumber, l_quantity) AS rn FROM ln),
    gt AS (SELECT o_orderkey AS query_id, 4.0 + o_orderkey % 17 AS a, 17.0 + o_orderkey % 17 AS b, 30.0 AS a2, 38.0 AS b2 FROM orders)"""
IOU = "greatest(0.0, least(t_end, {b}) - greatest(t_start, {a})) / (greatest(t_end, {b}) - least(t_start, {a}))"
IOU1, IOU2 = IOU.format(a="a", b="b"), IOU.format(a="a2", b="b2")
HULL = IOU.format(a="least(a, a2)", b="greatest(b, b2)")


def _chunk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rn, t_start, t_end, truths ARRAY<STRUCT<a, b>>, is_true, iou (with the hull of the truths)."""
    lines = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_linenumber", F.col("l_extendedprice").alias("score"), "l_quantity", ((F.col("l_linenumber") - 1) * 10.0).alias("t_start"), (F.col("l_linenumber") * 10.0).alias("t_end"))
    off = F.col("o_orderkey") % 17
    pair = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    truths = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.array(pair(off + 4.0, off + 17.0), pair(F.lit(30.0), F.lit(38.0))).alias("truths"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "l_linenumber", "l_quantity"))
    joined = lines.withColumn("rn", rn).join(truths, "query_id")
    low, high = F.array_min(F.transform("truths", lambda t: t["a"])), F.array_max(F.transform("truths", lambda t: t["b"]))
    return joined.withColumns({"is_true": me.overlaps(F.col("t_start"), F.col("t_end"), "truths"), "iou": iou(F.col("t_start"), F.col("t_end"), low, high)})


@query(f"WITH {CHUNKED} SELECT query_id, l_linenumber, {IOU1} >= 0.3 OR {IOU2} >= 0.3 AS is_true, round(greatest(greatest(0.0, least(t_end, b) - greatest(t_start, a)), greatest(0.0, least(t_end, b2) - greatest(t_start, a2))) / (t_end - t_start), 6) AS covered FROM rk JOIN gt USING (query_id)")
def iou_gt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _chunk_ranking(spark, sf_dir)
    return r.select("query_id", "l_linenumber", "is_true", F.round(me.coverage(F.col("t_start"), F.col("t_end"), "truths"), 6).alias("covered"))


@query(f"WITH {CHUNKED} SELECT query_id, max(CASE WHEN rn <= 1 AND ({IOU1} >= 0.3 OR {IOU2} >= 0.3) THEN 1.0 ELSE 0.0 END)::DOUBLE AS r1, max(CASE WHEN rn <= 5 AND ({IOU1} >= 0.3 OR {IOU2} >= 0.3) THEN 1.0 ELSE 0.0 END)::DOUBLE AS r5 FROM rk JOIN gt USING (query_id) GROUP BY query_id")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _chunk_ranking(spark, sf_dir)
    at = lambda k: F.max(F.when((F.col("rn") <= k) & F.col("is_true"), 1.0).otherwise(0.0))
    return r.groupBy("query_id").agg(at(1).alias("r1"), at(5).alias("r5"))


@query(f"WITH {CHUNKED}, v AS (SELECT query_id, rn, {HULL} AS v FROM rk JOIN gt USING (query_id) WHERE rn <= 5), c AS (SELECT *, sum(v) OVER (PARTITION BY query_id ORDER BY rn) AS cum FROM v) SELECT query_id, round(sum(cum / rn * v), 6) AS ap FROM c GROUP BY query_id")
def map5_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.graded_precision(_chunk_ranking(spark, sf_dir), ("query_id",)).withColumn("ap", F.round("ap", 6))


@query(
    f"""WITH RECURSIVE {CHUNKED}, v AS (SELECT query_id, rn, {IOU1} AS v1, {IOU2} AS v2 FROM rk JOIN gt USING (query_id) WHERE rn <= 5), n AS (SELECT query_id, max(rn) AS n FROM v GROUP BY ALL),
    walk AS (
        SELECT query_id, 0::BIGINT AS rn, false AS u1, false AS u2, 0 AS hits, 0.0::DOUBLE AS total FROM n
        UNION ALL
        SELECT query_id, rn, u1 OR pick = 1, u2 OR pick = 2, hits + (pick > 0)::INT, total + CASE WHEN pick > 0 THEN (hits + 1) / rn ELSE 0 END FROM (
            SELECT w.query_id, v.rn, u1, u2, hits, total, CASE WHEN NOT u2 AND v2 >= 0.3 AND (u1 OR v1 < 0.3 OR v2 >= v1) THEN 2 WHEN NOT u1 AND v1 >= 0.3 THEN 1 ELSE 0 END AS pick
            FROM walk w JOIN v ON v.query_id = w.query_id AND v.rn = w.rn + 1))
    SELECT walk.query_id, round(CASE WHEN hits > 0 THEN total / hits ELSE 0 END, 6) AS ap FROM walk JOIN n ON n.query_id = walk.query_id AND n.n = walk.rn"""
)
def map5_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.matched_precision(_chunk_ranking(spark, sf_dir), ("query_id",)).withColumn("ap", F.round("ap", 6))


@query("WITH rk AS (SELECT l_orderkey AS query_id, l_quantity AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_quantity) AS rn FROM lineitem), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS ideal FROM rk) SELECT query_id, round(sum(CASE WHEN rn <= 10 THEN rel / log2(rn + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END), 6) AS ndcg FROM i GROUP BY query_id")
def ndcg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_quantity"))
    r = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_quantity").alias("rel"), rn.alias("rn"))
    return me.ndcg(r, ("query_id",)).withColumn("ndcg", F.round("ndcg", 6))


POOLED = """pool AS (SELECT o_custkey AS grp, o_orderkey AS item, o_orderpriority = '1-URGENT' AS pos, max(l_extendedprice) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query(
    f"""WITH {POOLED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, item) AS rn FROM pool),
    h AS (SELECT *, sum(pos::INT) OVER (PARTITION BY grp ORDER BY rn) AS hits, row_number() OVER (PARTITION BY grp ORDER BY pos DESC, rn) AS ideal FROM r),
    g AS (SELECT grp, min(rn) FILTER (pos) AS f, sum(CASE WHEN pos AND rn <= 10 THEN 1 / log2(rn + 1) ELSE 0 END) AS dcg, sum(CASE WHEN pos AND ideal <= 10 THEN 1 / log2(ideal + 1) ELSE 0 END) AS best, avg(hits / rn) FILTER (pos) AS map, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b, sum(rn) FILTER (pos) AS s FROM h GROUP BY grp)
    SELECT grp AS "group", (f <= 1)::INT::DOUBLE AS r1, (f <= 5)::INT::DOUBLE AS r5, (f <= 20)::INT::DOUBLE AS r20, round(1 / f, 6) AS mrr, round(dcg / best, 6) AS ndcg10, round(map, 6) AS map, round(1 - (s - a * (a + 1) / 2) / (a * b), 6) AS auc FROM g WHERE a > 0 AND b > 0"""
)
def mrr_map_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.pools(spark, sf_dir).withColumn("s", F.array_max("scores"))
    r = p.withColumn("rn", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("s"), "item")))
    return me.all_metrics(r, ("group",)).select("group", "r1", "r5", "r20", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg10", "map", "auc")])


@query("WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey * 10 + l_linenumber, l_partkey) AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber, l_partkey) AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY l_returnflag")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ad.table(spark, sf_dir, "lineitem").withColumn("tie", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey"))
    return me.spearman(l, "l_quantity", "l_extendedprice", "tie", ("l_returnflag",)).withColumn("rho", F.round("rho", 6))


@query("SELECT d.lang, round(avg(CASE WHEN l.quality = 1 - l.toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang")
def accuracy_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ad.table(spark, sf_dir, "labels").withColumn("gold", 1 - F.col("toxic")).join(ad.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return me.accuracy(l, "quality", "gold", ("lang",)).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT round(avg(CASE WHEN sign(value - 50) = sign(value - 100) THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(CASE WHEN value - 50 > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM events")
def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select((F.col("value") - 50).alias("a"), (F.col("value") - 100).alias("b"))
    return me.sign_agreement(e, "a", "b").select(F.round("agreement", 6).alias("agreement"), F.round("positive_rate", 6).alias("positive_rate"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT round(corr(ln(n), ln(q)), 6) AS rho FROM n")
def log_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return me.log_correlation(n, "n", "q").select(F.round("rho", 6).alias("rho"))


@query("SELECT s_suppkey, CAST(i AS INT) AS chunk, i * 7.5 AS t_start, least((i + 1) * 7.5, abs(s_acctbal) / 100) AS t_end FROM supplier, generate_series(0, 2000) AS g(i) WHERE i < greatest(1, ceil(abs(s_acctbal) / 100 / 7.5))")
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(chunk_list(F.abs("s_acctbal") / 100, 7.5)).alias("c"))
    return s.select("s_suppkey", "c.chunk", "c.t_start", "c.t_end")


@query(
    """WITH s AS (SELECT user_id AS video, event_type AS query_id, epoch_us(ts) / 1e6 AS ts, value FROM events),
    e AS (SELECT video, query_id, quantile_cont(value, 0.75) AS edge FROM s GROUP BY ALL),
    h AS (SELECT s.video, s.query_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY s.video, s.query_id ORDER BY ts) <= 86400 THEN 0 ELSE 1 END AS new FROM s JOIN e ON e.video = s.video AND e.query_id = s.query_id WHERE value > edge),
    r AS (SELECT *, sum(new) OVER (PARTITION BY video, query_id ORDER BY ts) AS event FROM h)
    SELECT video, query_id, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n_frames FROM r GROUP BY video, query_id, event"""
)
def runs_above_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.scores(spark, sf_dir).withColumn("score", F.col("score") + 50)
    return ev.runs_above(s, 0.75, 86400.0).select("video", "query_id", "t_start", "t_end", "n_frames")


@query(
    """WITH c AS (SELECT 'v' || label AS video, CAST(vec_id AS DOUBLE) AS ts FROM embeddings), n AS (SELECT video, CAST(floor(max(ts) / 25) AS INT) AS last FROM c GROUP BY video),
    k AS (SELECT video, CAST(i AS INT) AS chunk FROM n, generate_series(0, 1000) AS g(i) WHERE i <= last)
    SELECT k.video, k.chunk, count(*) AS n_frames, min(ts) AS first_ts, max(ts) AS last_ts FROM k JOIN c ON c.video = k.video AND ts BETWEEN 25 * chunk AND 25 * (chunk + 1) GROUP BY ALL"""
)
def closed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each chunk with both its borders."""
    f = ad.collection(spark, sf_dir).select("video", F.col("ts").alias("hit"))
    chunks = f.groupBy("video").agg(F.floor(F.max("hit") / 25).cast("int").alias("last")).select("video", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("event"))
    spans = chunks.select("video", "event", (F.col("event") * 25.0).alias("t_start"), (F.col("event") * 25.0 + 25.0).alias("t_end"))
    return ev.closed_slice(spans, f).groupBy("video", F.col("event").alias("chunk")).agg(F.count("*").alias("n_frames"), F.min("hit").alias("first_ts"), F.max("hit").alias("last_ts"))
