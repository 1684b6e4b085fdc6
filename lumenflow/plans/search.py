"""Queries over frames: similarity, segmentation, selection, collections, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hit_json, timecode
from ..functions.vectors import norm
from ..operators import collection as co
from ..operators import frames as fr
from ..operators import merge as me
from ..operators import selection as se
from ..sources import adapters as ad
from .registry import query

ONE = "coll AS (SELECT 'v0' AS video, CAST(vec_id AS INT) AS frame_idx, CAST(vec_id AS DOUBLE) AS ts, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
COLL = "coll AS (SELECT 'v' || label AS video, CAST(vec_id AS INT) AS frame_idx, CAST(vec_id AS DOUBLE) AS ts, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
QS = "qs AS (SELECT CAST(vec_id AS INT) AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0)"
SC = "sc AS (SELECT query_id, video, frame_idx, ts, list_dot_product(e, q) AS sim FROM coll, qs)"
ADJ = "adj AS (SELECT *, list_dot_product(e, lag(e) OVER (PARTITION BY video ORDER BY frame_idx)) AS adj FROM coll)"


def cut_sql(n: int) -> str:
    return f"""{ADJ},
        cut0 AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY adj NULLS LAST, frame_idx) AS rn, count(*) OVER (PARTITION BY video) AS n FROM adj),
        cut AS (SELECT video, frame_idx, ts, e, CAST(sum(CASE WHEN adj IS NOT NULL AND rn <= least(greatest({n}, 1), n) - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame_idx) AS INT) AS seg_id FROM cut0)"""


def segment_sql(budget: int) -> str:
    """From cut and qs."""
    return f"""
        s AS (SELECT query_id, video, frame_idx, ts, seg_id, list_dot_product(e, q) AS sim FROM cut, qs),
        d AS (SELECT *, row_number() OVER (PARTITION BY query_id, video, seg_id ORDER BY sim DESC, frame_idx) AS depth, max(sim) OVER (PARTITION BY query_id, video, seg_id) AS best FROM s),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY depth, best DESC, seg_id) AS pick FROM d)
        SELECT query_id, video, frame_idx, seg_id, round(sim, 6) AS sim, CAST(pick AS INT) AS pick FROM p WHERE pick <= {budget}"""


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("sim", "adj", "score") else F.col(c) for c in columns])


@query(f"WITH {COLL}, {QS}, {SC} SELECT query_id, video, frame_idx, ts, round(sim, 6) AS sim FROM sc")
def similarity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fr.similarity(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir)), "query_id", "video", "frame_idx", "ts", "sim")


@query(f"WITH {COLL}, {QS} SELECT query_id, video, frame_idx, round(sqrt(list_dot_product(e, e)), 6) AS length, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS cosine FROM coll, qs")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ad.queries(spark, sf_dir)
    sized = q.select(F.struct("query_id", norm("q").alias("size")).alias("query_id"), "q")  # goes with the key, so that pairs meet no join
    s = fr.similarity(ad.collection(spark, sf_dir).withColumn("length", norm("emb")), sized)
    return s.select("query_id.query_id", "video", "frame_idx", F.round("length", 6).alias("length"), F.round(F.col("sim") / (F.col("length") * F.col("query_id.size")), 6).alias("cosine"))


@query(f"WITH {COLL}, {QS}, {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY sim DESC, frame_idx) AS pick FROM sc) SELECT query_id, video, frame_idx, round(sim, 6) AS sim, CAST(pick AS INT) AS pick FROM r WHERE pick <= 8")
def topk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(se.topk_of(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), 8), "query_id", "video", "frame_idx", "sim", "pick")


@query(
    f"""WITH RECURSIVE {COLL}, {QS}, {SC},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY sim DESC, frame_idx) AS rn FROM sc),
    g AS (SELECT query_id, video, (CASE WHEN count(*) > 1 THEN max(ts) - min(ts) ELSE 1.0 END) / 16.0 AS w, count(*) AS n FROM sc GROUP BY ALL),
    walk AS (
        SELECT query_id, video, 0::BIGINT AS rn, []::DOUBLE[] AS kept FROM g
        UNION ALL
        SELECT k.query_id, k.video, r.rn, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda t: abs(t - r.ts) <= g.w)) = 0 THEN list_append(kept, r.ts) ELSE kept END
        FROM walk k JOIN r ON r.query_id = k.query_id AND r.video = k.video AND r.rn = k.rn + 1 JOIN g ON g.query_id = k.query_id AND g.video = k.video),
    last AS (SELECT walk.query_id, walk.video, kept FROM walk JOIN g ON g.query_id = walk.query_id AND g.video = walk.video AND walk.rn = g.n),
    out AS (SELECT query_id, video, unnest(kept) AS ts, generate_subscripts(kept, 1) AS pick FROM last)
    SELECT out.query_id, out.video, sc.frame_idx, round(sc.sim, 6) AS sim, CAST(pick AS INT) AS pick FROM out JOIN sc ON sc.query_id = out.query_id AND sc.video = out.video AND sc.ts = out.ts"""
)
def nms_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(se.nms_of(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), 8), "query_id", "video", "frame_idx", "sim", "pick")


@query(f"WITH {COLL}, {QS}, {cut_sql(6)}, {segment_sql(8)}")
def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fr.cut_into(fr.adjacent_similarity(ad.collection(spark, sf_dir)), 6)
    return _shown(se.segment_of(cut.drop("adj"), ad.queries(spark, sf_dir), 8), "query_id", "video", "frame_idx", "seg_id", "sim", "pick")


@query(f"WITH {ONE}, {QS}, {cut_sql(256)}, {segment_sql(32)}")
def segment_adaptive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(se.segment_adaptive(ad.frames(spark, sf_dir), ad.queries(spark, sf_dir), 32), "query_id", "video", "frame_idx", "seg_id", "sim", "pick")


@query(
    f"""WITH {COLL}, {QS}, {SC},
    pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY frame_idx) - 1 AS place, count(*) OVER (PARTITION BY query_id, video) AS n FROM sc),
    strata AS (SELECT DISTINCT query_id, video, n, i, CAST(n AS DOUBLE) / least(8, n) AS width FROM pl, generate_series(0, 7) AS g(i) WHERE i < least(8, n)),
    chosen AS (SELECT DISTINCT query_id, video, CAST(floor(i * width + CAST('0x' || substr(md5('0:' || video || ':' || i), 1, 8) AS BIGINT) / 4294967296.0 * width) AS BIGINT) AS place FROM strata)
    SELECT pl.query_id, pl.video, frame_idx, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY pl.query_id, pl.video ORDER BY frame_idx) AS INT) AS pick
    FROM pl JOIN chosen ON pl.query_id = chosen.query_id AND pl.video = chosen.video AND pl.place = chosen.place"""
)
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(se.uniform_of(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), 8), "query_id", "video", "frame_idx", "sim", "pick")


@query(f"WITH {COLL}, {ADJ} SELECT video, frame_idx, round(adj, 6) AS adj FROM adj")
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fr.adjacent_similarity(ad.collection(spark, sf_dir)), "video", "frame_idx", "adj")


@query(f"WITH {COLL}, {cut_sql(10)} SELECT video, frame_idx, seg_id, coalesce(seg_id <> lag(seg_id) OVER (PARTITION BY video ORDER BY frame_idx), false) AS boundary FROM cut")
def cut_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.cut_where_changed(fr.cut_into(fr.adjacent_similarity(ad.collection(spark, sf_dir)), 10)).select("video", "frame_idx", "seg_id", "boundary")


@query(f"WITH {COLL}, {cut_sql(10)} SELECT video, seg_id, min(frame_idx) AS frame_start, max(frame_idx) + 1 AS frame_end, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n_frames FROM cut GROUP BY video, seg_id")
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.segments(fr.cut_into(fr.adjacent_similarity(ad.collection(spark, sf_dir)), 10))


@query(
    f"""WITH {COLL}, {cut_sql(10)},
    dims AS (SELECT video, seg_id, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS x FROM cut),
    m AS (SELECT video, seg_id, dim, avg(x) AS x FROM dims GROUP BY ALL),
    l AS (SELECT video, seg_id, sqrt(sum(x * x)) + 1e-8 AS length FROM m GROUP BY ALL)
    SELECT m.video, m.seg_id, CAST(dim AS INT) AS dim, round(x / length, 6) + 0 AS x FROM m JOIN l ON m.video = l.video AND m.seg_id = l.seg_id"""
)
def segment_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = fr.segment_representatives(fr.cut_into(fr.adjacent_similarity(ad.collection(spark, sf_dir)), 10))
    return reps.select("video", "seg_id", F.posexplode("rep").alias("dim", "x")).select("video", "seg_id", "dim", (F.round("x", 6) + 0).alias("x"))


@query(f"WITH {COLL}, {cut_sql(10)}, r AS (SELECT *, row_number() OVER (PARTITION BY video, seg_id ORDER BY ts) AS rn FROM cut) SELECT video, seg_id, frame_idx FROM r WHERE rn = 1")
def first_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.first_of_segments(fr.cut_into(fr.adjacent_similarity(ad.collection(spark, sf_dir)), 10)).select("video", "seg_id", "frame_idx")


@query(
    f"""WITH RECURSIVE {COLL}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_idx) AS rn FROM coll),
    walk AS (
        SELECT video, frame_idx, ts, rn, e AS total, 0 AS seg_id FROM n WHERE rn = 1
        UNION ALL
        SELECT video, frame_idx, ts, rn, CASE WHEN joins THEN list_transform(list_zip(total, e), lambda z: z[1] + z[2]) ELSE e END, CASE WHEN joins THEN seg_id ELSE seg_id + 1 END FROM (
            SELECT n.*, total, seg_id, list_dot_product(e, total) / (sqrt(list_dot_product(total, total)) + 1e-12) >= 0.2 AS joins FROM walk JOIN n ON n.video = walk.video AND n.rn = walk.rn + 1))
    SELECT video, frame_idx, ts, seg_id FROM walk"""
)
def greedy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.greedy_segments(ad.collection(spark, sf_dir), 0.2)


GATE = """RECURSIVE ev AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
        SELECT user_id, ts, event_id, value, rn, value AS last, true AS kept FROM ev WHERE rn = 1
        UNION ALL
        SELECT ev.user_id, ev.ts, ev.event_id, ev.value, ev.rn, CASE WHEN abs(ev.value - last) >= 20 THEN ev.value ELSE last END, abs(ev.value - last) >= 20
        FROM walk JOIN ev ON ev.user_id = walk.user_id AND ev.rn = walk.rn + 1)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("frame_idx"), "value")
    return fr.gated(e, "value", 20.0, ("user_id",))


@query(f"WITH {GATE} SELECT user_id, event_id, kept, last AS filled FROM walk")
def pixel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.filled(_gated(spark, sf_dir), "value", ("user_id",)).select("user_id", F.col("frame_idx").alias("event_id"), "kept", "filled")


@query(f"WITH {GATE} SELECT user_id, count(*) AS n_frames, round(avg(CASE WHEN kept THEN 0.0 ELSE 1.0 END), 6) AS skipped FROM walk GROUP BY user_id")
def gate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.statistics(_gated(spark, sf_dir).withColumnRenamed("user_id", "video"), 1.0).select(F.col("video").alias("user_id"), "n_frames", F.round("skipped", 6).alias("skipped"))


@query(
    """WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
        SELECT user_id, ts, event_id, rn, ts AS last, true AS kept FROM ev WHERE rn = 1
        UNION ALL
        SELECT ev.user_id, ev.ts, ev.event_id, ev.rn, CASE WHEN ev.ts - last >= 86400 THEN ev.ts ELSE last END, ev.ts - last >= 86400
        FROM walk JOIN ev ON ev.user_id = walk.user_id AND ev.rn = walk.rn + 1)
    SELECT user_id, event_id, ts FROM walk WHERE kept"""
)
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.scores(spark, sf_dir).select("video", "ts", "frame_idx")
    return fr.sampled(e, 1 / 86400).select(F.col("video").alias("user_id"), F.col("frame_idx").alias("event_id"), "ts")


@query(f"WITH {COLL}, {QS}, {SC} SELECT query_id, video, frame_idx, round(sum(sim) OVER (PARTITION BY query_id, video ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM sc")
def smoothed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.smoothed_of(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), 5, "box")
    return s.select("query_id", "video", "frame_idx", F.round("smooth", 6).alias("smooth"))


@query(
    f"""WITH {COLL}, {QS}, {SC}, w AS (SELECT *, lag(sim, 1, 0) OVER o AS a, lead(sim, 1, 0) OVER o AS b FROM sc WINDOW o AS (PARTITION BY query_id, video ORDER BY frame_idx))
    SELECT query_id, video, frame_idx, round((0.5 * a + sim + 0.5 * b) / 2, 6) AS smooth FROM w"""
)
def triangle_smoothed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.smoothed_of(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), 3, "triangle")
    return s.select("query_id", "video", "frame_idx", F.round("smooth", 6).alias("smooth"))


@query(
    f"""WITH {COLL}, {QS}, {ADJ}, m AS (SELECT query_id, video, frame_idx, list_dot_product(e, q) AS sim, coalesce(1 - adj, 0) AS d FROM adj, qs),
    z AS (SELECT *, (d - avg(d) OVER w) / (stddev_pop(d) OVER w + 1e-9) AS z, stddev_pop(sim) OVER w AS sd FROM m WINDOW w AS (PARTITION BY query_id, video))
    SELECT query_id, video, frame_idx, round(sim + 0.3 * z * sd, 6) AS sim FROM z"""
)
def motion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.motion_of(fr.adjacent_similarity(ad.collection(spark, sf_dir)), ad.queries(spark, sf_dir), 0.3)
    return _shown(s, "query_id", "video", "frame_idx", "sim")


@query(
    f"""WITH {COLL}, {QS}, {SC},
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, video, frame_idx) AS rn FROM sc) WHERE rn <= 5),
    dims AS (SELECT query_id, generate_subscripts(e, 1) AS dim, unnest(e) AS x FROM best JOIN coll USING (video, frame_idx)),
    m AS (SELECT query_id, dim, avg(x) AS x FROM dims GROUP BY ALL),
    moved AS (SELECT m.query_id, dim, q[dim] * 0.5 + x * 0.5 AS x FROM m JOIN qs ON m.query_id = qs.query_id),
    len AS (SELECT query_id, sqrt(sum(x * x)) AS l FROM moved GROUP BY ALL),
    nq AS (SELECT moved.query_id, list(x / l ORDER BY dim) AS q FROM moved JOIN len USING (query_id) GROUP BY ALL),
    s2 AS (SELECT query_id, video, frame_idx, list_dot_product(e, q) AS sim FROM coll, nq),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, video, frame_idx) AS rn FROM s2)
    SELECT query_id, video, frame_idx, round(sim, 6) AS sim, CAST(rn AS INT) AS rank FROM r WHERE rn <= 20"""
)
def feedback_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ad.collection(spark, sf_dir)
    return _shown(fr.best_of(f, fr.feedback(f, ad.queries(spark, sf_dir), 5, 0.5), 20), "query_id", "video", "frame_idx", "sim", "rank")


def collapse_sql(gap: float, per_video: int | None, k: int, source: str = "sc") -> str:
    cap = f"len(kept) < {per_video} AND " if per_video else ""
    near = f"len(list_filter(kept, lambda t: abs(t - r.ts) < {gap})) = 0" if gap > 0 else "true"
    return f"""
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY sim DESC, ts) AS rn FROM {source}),
    n AS (SELECT query_id, video, max(rn) AS n FROM r GROUP BY ALL),
    walk AS (
        SELECT query_id, video, 0::BIGINT AS rn, []::DOUBLE[] AS kept FROM n
        UNION ALL
        SELECT w.query_id, w.video, r.rn, CASE WHEN {cap}{near} THEN list_append(kept, r.ts) ELSE kept END FROM walk w JOIN r ON r.query_id = w.query_id AND r.video = w.video AND r.rn = w.rn + 1),
    kept AS (SELECT walk.query_id, walk.video, unnest(kept) AS ts FROM walk JOIN n ON n.query_id = walk.query_id AND n.video = walk.video AND walk.rn = n.n),
    ranked AS (SELECT kept.query_id, kept.video, kept.ts, s.sim, row_number() OVER (PARTITION BY kept.query_id ORDER BY s.sim DESC, kept.video, kept.ts) AS rank FROM kept JOIN {source} s ON s.query_id = kept.query_id AND s.video = kept.video AND s.ts = kept.ts)
    SELECT query_id, video, ts, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= {k}"""


@query(f"WITH RECURSIVE {COLL}, {QS}, {SC}, {collapse_sql(30, None, 20)}")
def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(co.search(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir)), "query_id", "video", "ts", "sim", "rank")


@query(f"WITH RECURSIVE {COLL}, {QS}, sc AS (SELECT query_id, video, frame_idx, ts, list_dot_product(e, q) AS sim FROM coll, qs WHERE video = 'v3'), {collapse_sql(30, None, 20)}")
def collection_search_one_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(co.search(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), video="v3"), "query_id", "video", "ts", "sim", "rank")


@query(f"WITH RECURSIVE {COLL}, {QS}, {SC}, {collapse_sql(0, 2, 15)}")
def per_video_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(co.search(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir), 15, min_gap_s=0, per_video=2), "query_id", "video", "ts", "sim", "rank")


@query(f"WITH {COLL} SELECT video, count(*) AS n_frames FROM coll GROUP BY video")
def collection_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ad.collection(spark, sf_dir)
    return co.videos(f).join(f.groupBy("video").agg(F.count("*").alias("n_frames")), "video")


@query(f"WITH {COLL}, {QS}, {SC}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY sim DESC, frame_idx) AS rn FROM sc) SELECT query_id, video, ts, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, video) AS INT) AS rank FROM b WHERE rn = 1")
def best_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(co.best_per_video(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir)), "query_id", "video", "ts", "sim", "rank")


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ad.collection(spark, sf_dir)
    c = co.centroids(f, co.n_lists(f.count()))
    return co.approximate_search(co.inverted_index(f, c), c, ad.queries(spark, sf_dir), 20, co.calibrated_probes(f, c))


@query()
def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained centres aren't SQL; tests hold its recall against `collection_search`."""
    return _shown(_approximate(spark, sf_dir), "query_id", "video", "ts", "sim", "rank")


@query()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.overlap(co.search(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir)), _approximate(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as hits of three sources: the query is the user, clicks are visual, views speech, purchases text."""
    kinds = F.create_map(*[F.lit(x) for x in ("click", "visual", "view", "speech", "purchase", "text")])
    e = ad.scores(spark, sf_dir).withColumn("source", F.element_at(kinds, F.col("query_id"))).where("source is not null")
    return e.select(F.col("video").cast("string").alias("query_id"), "source", F.col("ts").alias("time"), "score", F.when(F.col("source") != "visual", F.col("frame_idx").cast("string")).alias("text"), F.when(F.col("source") == "visual", F.col("score") / 10).alias("vlm_score"))


TEXT_HITS = """h AS (SELECT CAST(user_id AS VARCHAR) AS query_id, CASE event_type WHEN 'click' THEN 'visual' WHEN 'view' THEN 'speech' WHEN 'purchase' THEN 'text' END AS source, epoch_us(ts) / 1e6 AS time, value - 50 AS score FROM events)"""


@query(f"WITH {TEXT_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, time) - 1 AS rank FROM h WHERE source IN ('speech', 'text')) SELECT query_id, source, time, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank < 5")
def timed_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = me.resolve_sources(["speech", "text"], ["visual", "speech", "text"])
    return _shown(me.ranked_list(_hits(spark, sf_dir).where(F.col("source").isin(kinds)), 5), "query_id", "source", "time", "score", "rank")


@query()
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.merge(me.ranked_list(_hits(spark, sf_dir), 32), 32, 3600.0)


@query(f"WITH {TEXT_HITS} SELECT query_id, time, round(score, 6) AS score FROM h WHERE source IS NOT NULL AND coalesce(CASE WHEN source = 'visual' THEN score / 10 END, 0) > 2")
def confirmed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(me.above(_hits(spark, sf_dir), 2.0, True), "query_id", "time", "score")


@query(f"WITH {TEXT_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, time) AS rank FROM h WHERE source = 'visual'), x AS (SELECT *, CASE WHEN rank <= 10 THEN sin(score) END AS expert FROM r) SELECT query_id, time, CAST(rank AS INT) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, expert DESC NULLS LAST, rank) AS INT) AS new_rank FROM x")
def expert_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _hits(spark, sf_dir).where("source = 'visual'").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "time")))
    return me.reranked(r.withColumn("expert", F.sin("score")), 10, "expert").select("query_id", "time", "rank", "new_rank")


@query("SELECT conv_id, turn, turn * 10.0 AS t_start, coalesce(lead(turn * 10.0) OVER (PARTITION BY conv_id ORDER BY turn), turn * 10.0 + 1) AS t_end FROM conversations")
def span_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 10.0).alias("start"))
    return me.span_ends(c, ("conv_id",)).select("conv_id", "turn", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


@query("SELECT event_id, CAST(floor(value * 37) / 3600 AS BIGINT) || ':' || lpad(CAST(CAST(floor(value * 37) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value * 37) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS timecode FROM (SELECT event_id, value FROM events)".replace("CAST(floor(value * 37) / 3600 AS BIGINT)", "CAST(floor(value * 37) AS BIGINT) // 3600"))
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "events").select("event_id", timecode(F.col("value") * 37).alias("timecode"))


@query()
def hits_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = co.search(ad.collection(spark, sf_dir), ad.queries(spark, sf_dir)).withColumn("timecode", timecode("ts"))
    return hits.select("query_id", "rank", hit_json("video", "ts", "sim", "timecode").alias("hit"))


@query(f"WITH {ONE} SELECT video, frame_idx, ts FROM coll WHERE frame_idx % 4 = 0 AND ts BETWEEN 100 AND 300")
def thinned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import thinned

    return ad.frames(spark, sf_dir).where(thinned("frame_idx", 4) & F.col("ts").between(100, 300)).select("video", "frame_idx", "ts")
