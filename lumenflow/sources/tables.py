"""Tables on disk: frame indexes, timed text, evaluation sets. Parquet, partitioned by what searches filter on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import stem

FRAMES = T.StructType([T.StructField("video", T.StringType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("ts", T.DoubleType()), T.StructField("seg_id", T.IntegerType()), T.StructField("emb", T.ArrayType(T.FloatType()))])
STORE = T.StructType([*FRAMES.fields, T.StructField("jpeg", T.BinaryType())])
TIMED_TEXT = T.StructType([T.StructField("video", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("emb", T.ArrayType(T.FloatType())), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
HITS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("time", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("vlm_score", T.DoubleType())])
STATS = T.StructType([T.StructField(n, T.StringType()) for n in ("video", "encoder", "encoder_revision")] + [T.StructField(n, T.IntegerType()) for n in ("n_frames", "n_encoded", "n_segments", "embed_dim", "seed")] + [T.StructField(n, T.DoubleType()) for n in ("duration_s", "target_fps", "pixel_gate_tau", "segment_tau", "decode_encode_s", "frames_per_s", "realtime_factor")])


def checked_dimension(frames: DataFrame, dim: int) -> DataFrame:
    """Frames whose embeddings all have `dim` dimensions; reading one that hasn't is an error."""
    wrong = F.size("emb") != dim
    return frames.withColumn("emb", F.when(wrong, F.raise_error(F.concat(F.lit("an embedding has "), F.size("emb").cast("string"), F.lit(f" dimensions, not {dim}")))).otherwise(F.col("emb")))


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By video, in time order within files: a search of one video reads its folder, a time range its row groups."""
    frames.repartition("video").sortWithinPartitions("video", "frame_idx").write.mode(mode).partitionBy("video").parquet(path)


def append_frames(spark: SparkSession, frames: DataFrame, path: str) -> None:
    write_frames(frames, path, "append")


def read_frames(spark: SparkSession, path: str, video: str | None = None, start_s: float | None = None, end_s: float | None = None, columns: tuple[str, ...] = ("video", "frame_idx", "ts", "seg_id", "emb")) -> DataFrame:
    """Only the columns asked for, so pictures stay on disk; video prunes folders, times reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(*[c for c in columns if c in df.columns])
    if video is not None:
        df = df.where(F.col("video") == F.lit(video))
    if start_s is not None:
        df = df.where(F.col("ts") >= start_s)
    if end_s is not None:
        df = df.where(F.col("ts") <= end_s)
    return df


def has_pictures(spark: SparkSession, path: str) -> bool:
    try:
        return "jpeg" in spark.read.parquet(path).columns
    except Exception:  # not a table: no pictures
        return False


def read_indexes(spark: SparkSession, pattern: str) -> DataFrame:
    """All index files of a glob; the video is the column's, or else the file's name."""
    df = spark.read.parquet(pattern)
    if "video" not in df.columns:
        df = df.withColumn("video", stem(F.col("_metadata.file_path")))
    return df


def from_npz(spark: SparkSession, path: str, video: str) -> DataFrame:
    """A legacy index file, read on the driver: ts, emb, seg_id arrays."""
    import numpy as np

    with np.load(path, allow_pickle=False) as z:
        ts, emb = z["ts"], z["emb"].astype("float32")
        seg = z["seg_id"] if "seg_id" in z else np.zeros(len(ts), int)
        rows = [(video, i, float(t), int(s), e.tolist()) for i, (t, s, e) in enumerate(zip(ts, seg, emb))]
    return spark.createDataFrame(rows, FRAMES)


def missing_videos(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """Videos that have no index yet."""
    return wanted.join(indexed.select("video").distinct(), "video", "left_anti")


def write_timed_text(spans: DataFrame, path: str, mode: str = "overwrite") -> None:
    spans.write.mode(mode).partitionBy("kind").parquet(path)


def read_timed_text(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if kind is None else df.where(F.col("kind") == F.lit(kind))


def text_kinds(spark: SparkSession, path: str) -> list[str]:
    """Which passes a timed-text table holds."""
    try:
        return [r[0] for r in spark.read.parquet(path).select("kind").distinct().orderBy("kind").collect()]
    except Exception:  # no table
        return []


def moment_queries(spark: SparkSession, path: str, videos: DataFrame) -> DataFrame:
    """Moment queries from JSON: query_id, text, video, path (null if the video isn't there), truths, task."""
    raw = spark.read.schema("qry_text string, src_video_path string, task string, answering_time_interval array<array<double>>").json(path, multiLine=True)
    truths = F.transform("answering_time_interval", lambda g: F.struct(g[0].alias("a"), g[1].alias("b")))
    q = raw.select(F.col("qry_text").alias("text"), stem("src_video_path").alias("video"), truths.alias("truths"), "task").withColumn("query_id", F.md5(F.concat_ws("|", "video", "text", F.to_json("truths"))))
    return q.join(videos.select("video", "path"), "video", "left")


def qa_items(spark: SparkSession, path: str, durations: list[str] | None = None) -> DataFrame:
    """Multiple-choice items; the answer is the first letter, upper-case."""
    df = spark.read.parquet(path)
    if durations is not None:
        df = df.where(F.col("duration").isin(durations))
    return df.withColumn("answer", F.upper(F.substring(F.trim("answer"), 1, 1)))


def retrieval_set(spark: SparkSession, corpus: str, queries: str, judgements: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries that are judged, judgements with a positive score)."""
    docs = spark.read.parquet(corpus).select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("text"))
    rel = spark.read.csv(judgements, sep="\t", header=True).toDF("query_id", "doc_id", "score").withColumn("score", F.col("score").cast("double")).where("score > 0")
    asked = spark.read.parquet(queries).select(F.col("_id").alias("query_id"), "text").join(rel.select("query_id").distinct(), "query_id", "left_semi")
    return docs, asked, rel


def step_solutions(spark: SparkSession, path: str, min_solutions: int = 2) -> DataFrame:
    """Solutions with step marks from JSON lines (input, label): problem, steps, tags, correct, n_bad; problems with right and wrong ones."""
    raw = spark.read.schema("input string, label string").json(path)
    return group_solutions(parse_solutions(raw), min_solutions)


def parse_solutions(raw: DataFrame) -> DataFrame:
    """One row a solution: the steps of the input end in a mark; the label has '+' or '-' there."""
    marked = r"(?s)Step \d+:.*?(?=Step \d+:|$)"
    steps = F.transform(F.regexp_extract_all("input", F.lit(marked), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s*ки\s*$", "")))
    tags = F.transform(F.regexp_extract_all("label", F.lit(marked), F.lit(0)), lambda s: F.regexp_extract(s, r"([+-])\s*$", 1))
    problem = F.trim(F.regexp_extract("input", r"(?s)^(.*?)\s*Step 1:", 1))
    out = raw.select(problem.alias("problem"), steps.alias("steps"), tags.alias("tags"))
    good = out.where("size(steps) > 0 and size(steps) = size(tags) and not exists(tags, t -> t = '')")
    return good.select("*", (F.element_at("tags", -1) == "+").alias("correct"), F.size(F.filter("tags", lambda t: t == "-")).alias("n_bad"))


def group_solutions(solutions: DataFrame, min_solutions: int) -> DataFrame:
    kept = solutions.groupBy("problem").agg(F.count("*").alias("n"), F.bool_or("correct").alias("some_right"), F.bool_or(~F.col("correct")).alias("some_wrong")).where((F.col("n") >= min_solutions) & F.col("some_right") & F.col("some_wrong"))
    return solutions.join(kept.select("problem"), "problem", "left_semi")


def query_specs(spark: SparkSession, path: str) -> DataFrame:
    """id, question, caption, expect of a JSON file with `queries`."""
    raw = spark.read.schema("queries array<struct<id:string,question:string,caption:string,expect:string>>").json(path, multiLine=True)
    return raw.select(F.explode("queries").alias("q")).select("q.*")


def captions(questions: DataFrame, specs: DataFrame) -> DataFrame:
    """Questions with the caption that stands for each, or the question itself."""
    return questions.join(specs.select("question", "caption"), "question", "left").withColumn("caption", F.coalesce("caption", "question"))


def merge_shards(a: DataFrame, b: DataFrame, keys: tuple[str, ...], tolerance: float) -> DataFrame:
    """The union of two score shards; an error if they disagree where they overlap."""
    worst = a.select(*keys, F.col("score").alias("x")).join(b.select(*keys, F.col("score").alias("y")), list(keys)).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
    if worst is not None and worst > tolerance:
        raise ValueError(f"the shards differ by {worst} where they overlap")
    return a.unionByName(b).dropDuplicates(list(keys))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
