"""Sources and sinks: tables, crawl checkpoints, knowledge bases, outputs, progress."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists as L
from ..functions import text as T


@dataclass
class Config:
    """Parameters of a run."""

    url: str = ""
    output: str = "output"
    max_pages: int = 30
    max_pairs: int = 10
    checkpoint: str | None = None
    force: bool = False
    min_score: float = 0.5
    options: dict = field(default_factory=dict)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a
    local session may do without and gets one of its own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = sc._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, with its lineage cut."""
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_key(base_url: Column) -> Column:
    """The name that a site's files share."""
    return F.md5(base_url)


# --- crawl checkpoints ----------------------------------------------------------


def save_crawl(content: DataFrame, frontier: DataFrame, path: str) -> None:
    """content (url, text, quality) and frontier (url, status: visited or failed)."""
    content.select("url", "text", "quality").write.mode("overwrite").parquet(f"{path}/content")
    frontier.select("url", "status").write.mode("overwrite").parquet(f"{path}/frontier")


def load_crawl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("url string, text string, quality double").parquet(f"{path}/content"), spark.read.schema("url string, status string").parquet(f"{path}/frontier")


def valid_crawl(content: DataFrame) -> DataFrame:
    """Pages of a checkpoint that still count as valid."""
    return content.where(T.is_valid_content(F.col("text")))


def validate_crawl(spark: SparkSession, path: str, to: str) -> None:
    """Write a crawl checkpoint again without pages that don't count as valid any
    more; scores go with their pages, the frontier stays."""
    content, frontier = load_crawl(spark, path)
    save_crawl(valid_crawl(content), frontier, to)


def merged_crawl(first: DataFrame, other: DataFrame) -> DataFrame:
    """Pages of two crawls of one site; the second's win, if it found more."""
    more = other.agg(F.count("*").alias("m")).crossJoin(first.agg(F.count("*").alias("n"))).where("m > n").select(F.lit(1).alias("_more"))
    both = first.withColumn("_o", F.lit(1)).unionByName(other.crossJoin(F.broadcast(more)).drop("_more").withColumn("_o", F.lit(0)))
    r = F.row_number().over(Window.partitionBy("url").orderBy("_o"))
    return both.withColumn("_r", r).where("_r = 1").drop("_r", "_o")


# --- knowledge base ---------------------------------------------------------------


def save_kb(documents: DataFrame, chunks: DataFrame, postings: DataFrame, path: str) -> None:
    for name, df in (("documents", documents), ("chunks", chunks), ("postings", postings)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_kb(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("documents", "chunks", "postings")}


# --- outputs ------------------------------------------------------------------------

PAIR = "question string, answer string, source_url string, topic string, topic_type string, scores struct<relevance double, factuality double, completeness double, formatting double, overall double>"


def save_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines, a pair a line."""
    pairs.write.mode("overwrite").json(path)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).json(path)


def json_document(pairs: DataFrame) -> DataFrame:
    """One row ``value`` with all pairs in one JSON document, for small results;
    ``save_pairs`` writes results of any size."""
    item = F.to_json(F.struct(*pairs.columns), {"ignoreNullFields": "false"})
    return pairs.agg(F.concat(F.lit('{"qa_pairs": ['), F.array_join(F.sort_array(F.collect_list(item)), ", "), F.lit("]}")).alias("value"))


def csv_lines(pairs: DataFrame) -> DataFrame:
    """Lines of the CSV output: texts quoted, quotes doubled, the score bare."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cols = [q(F.col(c)) for c in ("question", "answer", "source_url", "topic", "topic_type")]
    return pairs.select(F.concat_ws(",", *cols, F.col("scores.overall").cast("string")).alias("value"))



def save_csv(pairs: DataFrame, path: str) -> None:
    """CSV files with a header each."""
    out = pairs.select(F.col("question").alias("Question"), F.col("answer").alias("Answer"), F.col("source_url").alias("Source URL"), F.col("topic").alias("Topic"), F.col("topic_type").alias("Topic Type"), F.col("scores.overall").alias("Overall Score"))
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown(pairs: DataFrame) -> DataFrame:
    """(group_pos, source_url, value): a Markdown section for each URL, in order of
    its first pair; items numbered by ``pos``."""
    n = F.row_number().over(Window.partitionBy("source_url").orderBy("pos"))
    item = F.format_string("### Q%d: %s\n\n%s\n\n*Topic: %s | Type: %s | Score: %.2f*\n\n---\n\n", n, F.col("question"), F.col("answer"), F.coalesce("topic", F.lit("N/A")), F.coalesce("topic_type", F.lit("N/A")), F.coalesce("scores.overall", F.lit(0.0)))
    told = pairs.select(F.coalesce("source_url", F.lit("Unknown")).alias("source_url"), "pos", item.alias("item"))
    per = told.groupBy("source_url").agg(F.min("pos").alias("group_pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "").alias("items"))
    return per.select("group_pos", "source_url", F.concat(F.lit("## "), F.col("source_url"), F.lit("\n\n"), F.col("items")).alias("value"))


def save_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


# --- progress -------------------------------------------------------------------------


def save_progress(spark: SparkSession, path: str, base_url: str, done: dict[str, bool]) -> None:
    """A small manifest through Spark's writer, so any store will do."""
    row = {"base_url": base_url, "progress": {s: bool(done.get(s)) for s in L.STAGES}, "timestamp": datetime.now(timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_progress(spark: SparkSession, path: str, base_url: str) -> dict[str, bool] | None:
    """The manifest, if it is of this site."""
    try:
        row = json.loads("".join(r.value for r in spark.read.text(path).collect()))
    except Exception as e:  # a path that doesn't exist yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row["progress"] if row["base_url"] == base_url else None
