"""Queries on score pooling and its analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import bottomk_mean, product, topk_mean
from ..operators import metrics as me
from ..operators import pooling as po
from ..operators.videos import Choice, per_video
from ..sources import adapters as ad
from .registry import query
from .search import COLL, QS, SC

WIDTH = 25.0
#: Chunks of a video reach to its last frame, one more has none.
GRID = f"""{COLL}, {QS}, {SC},
    ext AS (SELECT video, CAST(floor(max(ts) / {WIDTH}) AS INT) + 2 AS n FROM coll GROUP BY video),
    grid AS (SELECT query_id, video, CAST(i AS INT) AS chunk FROM qs, ext, generate_series(0, 1000) AS g(i) WHERE i < n),
    ch AS (SELECT sc.query_id, sc.video, CAST(greatest(0, least(floor(ts / {WIDTH}), n - 1)) AS INT) AS chunk, sim, min(sim) OVER (PARTITION BY sc.query_id, sc.video) AS vmin FROM sc JOIN ext ON ext.video = sc.video),
    pk AS (SELECT query_id, video, chunk, list(sim ORDER BY sim) AS v, min(vmin) AS vmin FROM ch GROUP BY ALL)"""


def chunk_sql(score: str) -> str:
    return f"WITH {GRID}, p AS (SELECT query_id, video, chunk, {score} AS score FROM pk) SELECT grid.query_id, grid.video, grid.chunk, round(coalesce(score, -1e9), 6) AS score FROM grid LEFT JOIN p ON p.query_id = grid.query_id AND p.video = grid.video AND p.chunk = grid.chunk"


def _chunks(spark: SparkSession, sf_dir: str, choose: Choice, columns: str) -> DataFrame:
    """What a task makes of the chunk scores of a query and video: they are all in it."""
    frames = ad.collection(spark, sf_dir)
    extent = frames.groupBy("video").agg((F.floor(F.max("ts") / WIDTH) + 2).cast("int").alias("n"))
    cut = po.chunked(frames.join(extent, "video"), WIDTH, "n").select("video", "frame_idx", "chunk", "n", "emb")
    return per_video(cut, ad.queries(spark, sf_dir), choose, columns, ("chunk", "frame_idx"))


def _chunk_scores(spark: SparkSession, sf_dir: str, mode: str, param: float = 0.0) -> DataFrame:
    return _chunks(spark, sf_dir, po.scored_chunks(mode, param), "chunk int, score double")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


TOP = "list_avg(list_reverse(list_sort(v))[1:{k}])"


@query(chunk_sql("list_max(v)"))
def chunk_scores_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "max"), "score")


@query(chunk_sql("list_avg(v)"))
def chunk_scores_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "mean"), "score")


@query(chunk_sql(TOP.format(k=4)))
def chunk_scores_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "topk", 4), "score")


@query(chunk_sql(TOP.format(k="CAST(greatest(1, round_even(len(v) / 2.5, 0)) AS INT)")))
def chunk_scores_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "adaptive", 2.5), "score")


@query(chunk_sql("list_sum(list_transform(v, lambda x: exp(12 * (x - list_max(v))) * x)) / list_sum(list_transform(v, lambda x: exp(12 * (x - list_max(v)))))"))
def chunk_scores_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "softmax", 12), "score")


@query(chunk_sql("pow(list_avg(list_transform(v, lambda x: pow(x - vmin + 1e-6, 4))), 0.25) - 1e-6 + vmin"))
def chunk_scores_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "power", 4), "score")


@query(chunk_sql("list_max(v) - 0.5 * list_stddev_pop(v)"))
def chunk_scores_varpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "varpen", 0.5), "score")


@query(chunk_sql("list_avg(v) + 0.5 * list_stddev_pop(v)"))
def chunk_scores_varbonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunk_scores(spark, sf_dir, "varbonus", 0.5), "score")


CHUNKS = chunk_sql(TOP.format(k=4)).replace("round(coalesce(score, -1e9), 6)", "coalesce(score, -1e9)")


@query(
    f"""WITH c AS ({CHUNKS}), z0 AS (SELECT *, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-9) AS z, row_number() OVER (PARTITION BY query_id, video ORDER BY score DESC, chunk) AS rn, max(score) OVER w AS top, min(score) OVER w AS low FROM c WHERE score > -1e8 WINDOW w AS (PARTITION BY query_id, video)),
    z1 AS (SELECT *, exp(z - max(z) OVER (PARTITION BY query_id, video)) AS e FROM z0), z2 AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id, video) AS p FROM z1),
    g AS (SELECT query_id, video, count(*) AS n, max(z) FILTER (rn = 1) AS z1, max(z) FILTER (rn = 2) AS z2, avg(z) FILTER (rn BETWEEN 2 AND 5) AS z5, -sum(p * ln(p + 1e-12)) AS h, avg(CASE WHEN score >= top - 0.1 * (top - low) THEN 1.0 ELSE 0.0 END) AS near FROM z2 GROUP BY ALL)
    SELECT query_id, video, n, round(CASE WHEN n >= 3 THEN z1 - z2 ELSE 0 END, 6) AS margin, round(CASE WHEN n >= 3 THEN z1 - z5 ELSE 0 END, 6) AS gap5, round(CASE WHEN n >= 3 THEN h / ln(n) ELSE 0 END, 6) AS entropy, round(CASE WHEN n >= 3 THEN near ELSE 1 END, 6) AS near_top FROM g"""
)
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, po.signals(), "n bigint, margin double, gap5 double, entropy double, near_top double")
    return _rounded(c, "margin", "gap5", "entropy", "near_top")


@query(f"WITH c AS ({CHUNKS}) SELECT query_id, video, round((max(score) - avg(score)) / (stddev_pop(score) + 1e-9), 6) AS peakedness FROM c WHERE score > -1e8 GROUP BY ALL")
def peakedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunks(spark, sf_dir, po.peaks(), "peakedness double"), "peakedness")


@query(f"WITH c AS ({CHUNKS}) SELECT query_id, video, chunk, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-9), 6) AS z FROM c WHERE score > -1e8 WINDOW w AS (PARTITION BY query_id, video)")
def zscore_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunks(spark, sf_dir, po.standardised_chunks(), "chunk int, z double"), "z")


@query(f"WITH c AS ({CHUNKS}), t AS (SELECT query_id, video, max(score) AS b FROM c WHERE chunk % 3 = 0 GROUP BY ALL) SELECT c.query_id, c.video, count(*) FILTER (chunk % 3 <> 0 AND score > b) AS rank FROM c JOIN t ON t.query_id = c.query_id AND t.video = c.video GROUP BY ALL")
def best_true_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, po.true_ranks(3), "rank bigint")


@query(f"WITH {COLL}, a AS (SELECT video, CAST(floor(ts / {WIDTH}) AS INT) AS chunk, list_dot_product(e, lag(e) OVER (PARTITION BY video, floor(ts / {WIDTH}) ORDER BY frame_idx)) AS adj FROM coll) SELECT video, chunk, round(avg(1 - adj), 6) AS churn FROM a GROUP BY ALL HAVING count(*) >= 3")
def chunk_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import dot

    f = ad.collection(spark, sf_dir).withColumn("chunk", F.floor(F.col("ts") / WIDTH).cast("int"))
    adj = dot("emb", F.lag("emb").over(Window.partitionBy("video", "chunk").orderBy("frame_idx")))
    g = f.withColumn("adj", adj).groupBy("video", "chunk").agg(F.round(F.avg(1 - F.col("adj")), 6).alias("churn"), F.count("*").alias("n"))
    return g.where("n >= 3").drop("n")


# ragged score lists: the line prices of orders

LISTS = "ls AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {LISTS} SELECT l_orderkey, round({TOP.format(k=1)}, 6) AS k1, round({TOP.format(k=2)}, 6) AS k2, round({TOP.format(k=99)}, 6) AS k99 FROM ls")
def topk_mean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ad.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("v"))
    return v.select("l_orderkey", *[F.round(topk_mean("v", k), 6).alias(f"k{k}") for k in (1, 2, 99)])


@query(f"WITH {LISTS} SELECT l_orderkey, round(list_avg(list_sort(v)[1:2]), 4) AS low FROM ls")
def bottomk_mean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ad.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("v"))
    return v.select("l_orderkey", F.round(bottomk_mean("v", 2), 4).alias("low"))


STEPS = """st AS (SELECT o_custkey AS problem, o_orderkey AS solution, o_orderstatus = 'F' AS correct, list(1 - l_discount - l_tax ORDER BY l_linenumber, l_partkey) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query(
    f"""WITH {STEPS}, s AS (SELECT problem, solution, correct, unnest(['min', 'mean', 'last', 'product']) AS mode, unnest([list_min(r), list_avg(r), r[-1], list_product(r)]) AS score FROM st),
    b AS (SELECT *, row_number() OVER (PARTITION BY mode, problem ORDER BY round(score, 9) DESC, solution) AS rn FROM s)
    SELECT mode, round(avg(correct::INT), 6) AS accuracy, count(*) AS n FROM b WHERE rn = 1 GROUP BY mode"""
)
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 - F.col("l_discount") - F.col("l_tax")).alias("x"))
    r = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "x"))).alias("s")).select("l_orderkey", F.col("s.x").alias("r"))
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("correct")).join(r, F.col("o_orderkey") == F.col("l_orderkey"))
    mean = F.aggregate("r", F.lit(0.0), lambda s, x: s + x) / F.size("r")
    modes = F.map_from_arrays(F.array(*[F.lit(m) for m in ("min", "mean", "last", "product")]), F.array(bottomk_mean("r", 1), mean, F.element_at("r", -1), product("r")))
    s = o.select("o_custkey", "o_orderkey", "correct", F.explode(modes).alias("mode", "score"))
    best = s.groupBy("mode", "o_custkey").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("o_orderkey")).alias("i"), "correct")).alias("b"))
    return best.groupBy("mode").agg(F.round(F.avg(F.col("b.correct").cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


RELEVANT = "rl AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS m FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {RELEVANT}, e AS (SELECT count(*) AS n, quantile_cont(m, 0.5) AS m FROM rl WHERE m > 0) SELECT n AS n_examples, m, CAST(greatest(1, round_even(m * 0.5, 0)) AS INT) AS k FROM e")
def estimate_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ad.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") > 25).alias("relevant"))
    return po.matching_units(g).withColumn("k", po.recommended_k("m"))


@query(
    """WITH s AS (SELECT s_suppkey, CAST(ceil(abs(s_acctbal) / 400) AS INT) AS m FROM supplier), k AS (SELECT s_suppkey, m, unnest([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, m, greatest(1, m // 2)]) AS k FROM s)
    SELECT s_suppkey, k FROM (SELECT DISTINCT s_suppkey, m, k FROM k) WHERE k <= greatest(2, m) AND k >= 1"""
)
def k_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.explode(po.k_range(F.abs("s_acctbal") / 400)).alias("k"))


POOL = """pl AS (SELECT o_custkey AS grp, o_orderkey AS item, o_orderpriority = '1-URGENT' AS pos, list(l_extendedprice ORDER BY l_extendedprice DESC) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    mx AS (SELECT * FROM (SELECT *, sum(pos::INT) OVER (PARTITION BY grp) AS p, count(*) OVER (PARTITION BY grp) AS n FROM pl) WHERE p > 0 AND p < n),
    sk AS (SELECT k, grp, item, pos, list_avg(v[1:k]) AS s FROM mx, (SELECT unnest([1, 2, 3, 4]) AS k))"""


@query(f"WITH {POOL}, b AS (SELECT k, grp, pos, row_number() OVER (PARTITION BY k, grp ORDER BY s DESC, item) AS rn FROM sk) SELECT CAST(k AS INT) AS k, round(avg(pos::INT), 6) AS score, count(*) AS n_groups FROM b WHERE rn = 1 GROUP BY k")
def sweep_k_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(po.sweep_k(ad.pools(spark, sf_dir), [1, 2, 3, 4]), "score")


AUC = "SELECT k, grp, (sum(rn) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc"


@query(f"WITH {POOL}, b AS (SELECT *, row_number() OVER (PARTITION BY k, grp ORDER BY s, item) AS rn FROM sk), a AS ({AUC} FROM b GROUP BY k, grp) SELECT CAST(k AS INT) AS k, round(avg(auc), 6) AS score, count(*) AS n_groups FROM a GROUP BY k")
def sweep_k_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(po.sweep_k(ad.pools(spark, sf_dir), [1, 2, 3, 4], "auc"), "score")


@query(f"WITH {POOL}, b AS (SELECT *, row_number() OVER (PARTITION BY k, grp ORDER BY s, item) AS rn FROM sk WHERE k = 1), a AS ({AUC} FROM b GROUP BY k, grp) SELECT grp AS \"group\", round(auc, 6) AS auc FROM a")
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.pools(spark, sf_dir).withColumn("score", F.array_max("scores"))
    return _rounded(po.auc(p, ("group",), "item").where("auc is not null"), "auc")


@query(f"WITH {POOL}, o AS (SELECT grp, item, s, pos, (SELECT count(*) FROM sk b WHERE b.k = 1 AND b.grp = sk.grp AND NOT b.pos AND b.s < sk.s) AS beaten, (SELECT count(*) FROM sk b WHERE b.k = 1 AND b.grp = sk.grp AND NOT b.pos) AS n FROM sk WHERE k = 1 AND pos) SELECT grp AS \"group\", item, round(CASE WHEN beaten < 3 THEN 0 ELSE exp(ln(beaten / n) + ln((beaten - 1) / (n - 1)) + ln((beaten - 2) / (n - 2))) END, 6) AS p FROM o WHERE n >= 3")
def win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.pools(spark, sf_dir).withColumn("s", F.array_max("scores"))
    rivals = F.count(F.when(~F.col("is_positive"), 1))
    below = rivals.over(Window.partitionBy("group").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - rivals.over(Window.partitionBy("group", "s"))
    n = F.count(F.when(~F.col("is_positive"), 1)).over(Window.partitionBy("group"))
    rows = p.withColumns({"beaten": below, "n": n}).where("is_positive and n >= 3")
    return rows.select("group", "item", F.round(po.win_probability(F.col("beaten"), F.col("n"), 3), 6).alias("p"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.pools(spark, sf_dir).withColumn("score", F.array_max("scores"))
    return po.bootstrap(po.auc(p, ("group",), "item"), "auc", 200)


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.pools(spark, sf_dir).select("item", topk_mean("scores", 1).alias("a"), topk_mean("scores", 2).alias("b"))
    return po.paired_bootstrap(p, "a", "b", n_boot=100)


@query("SELECT user_id, count(*) AS questions, round(1 / (1 / (809.0 * count(*)) + 1 / 507.625), 6) AS speedup FROM events GROUP BY user_id")
def cascade_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's questions share one index: 1 / (1 / (R Q) + 1 / F), R the cost ratio, F frames for each expert call."""
    q = ad.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("questions"))
    return q.select("user_id", "questions", F.round(1 / (1 / (F.lit(809.0) * F.col("questions")) + 1 / F.lit(507.625)), 6).alias("speedup"))


@query("WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events) SELECT event_id, (value >= e[1])::INT + (value >= e[2])::INT + (value >= e[3])::INT AS bin FROM events, q")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    edges = e.agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("e"))
    total = sum(((F.col("value") >= F.col("e")[i]).cast("int") for i in range(3)), F.lit(0))
    return e.crossJoin(F.broadcast(edges)).select("event_id", total.alias("bin"))  # one row


@query(
    """WITH c AS (SELECT user_id, floor(value / 100) AS cost, max(value) AS gain FROM events GROUP BY ALL), p AS (SELECT user_id, cost::DOUBLE AS x, gain AS y FROM c)
    SELECT user_id, x AS cost, y AS gain FROM p WHERE NOT EXISTS (SELECT 1 FROM p l, p r WHERE l.user_id = p.user_id AND r.user_id = p.user_id AND l.x < p.x AND r.x > p.x AND p.y < l.y + (r.y - l.y) * (p.x - l.x) / (r.x - l.x))"""
)
def concave_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("value") / 100).alias("cost")).agg(F.max("value").alias("gain"))
    return me.envelope(c, ("user_id",))
