"""Writing stores: elements, chunks, images, vectors, parsed batches, experiment logs. One frame is the source of all three index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.indexing import insert_ignore
from leafmill.runtime import latest_by_id


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_elements(rows: DataFrame, path: str) -> None:
    """The element store: one row per id, the last write wins; clustered by document and order, not one folder per document."""
    last = latest_by_id(rows, "id", ["created_at", "atomic_order"], [c for c in ("created_at", "atomic_order", *[x for x in rows.columns if x not in ("id", "created_at", "atomic_order")])])
    last.repartitionByRange("doc_id", "atomic_order").sortWithinPartitions("doc_id", "atomic_order").write.mode("overwrite").parquet(path)


def add_new(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Append the rows whose key the table does not hold; of repeated keys the first by ``order``."""
    spark = rows.sparkSession
    there = spark.read.parquet(path) if _exists(spark, path) else rows.limit(0)
    insert_ignore(there, rows, key, order).write.mode("append").parquet(path)


def write_index(index: DataFrame, folder: str, embed=None, images: DataFrame | None = None) -> None:
    """Chunks, vectors and images from one frame, which is written first and read again, so that the three agree.

    ``images`` (img_id, base64, description) is stored as it is; without it only the ids are. Vectors of new ids are added.
    """
    index.write.mode("overwrite").parquet(f"{folder}/source")
    src = index.sparkSession.read.parquet(f"{folder}/source")
    add_new(src.select(F.col("id").alias("document_id"), "search_content", "text_content", F.struct("document", "section", "token_count", "chunk_id", "images").alias("metadata")), f"{folder}/chunks", "document_id", ["search_content"])
    add_new(src.select(F.explode("images").alias("img_id")) if images is None else images.select("img_id", "base64", "description"), f"{folder}/images", "img_id", [] if images is None else ["base64", "description"])
    if embed:
        add_new(embed(src.select("id", "search_content"), "search_content").select("id", "embedding"), f"{folder}/vectors", "id", ["embedding"])


def write_parsed(df: DataFrame, folder: str) -> None:
    """Parsed batches as JSON, a folder per document."""
    df.write.mode("overwrite").partitionBy("doc").json(folder)


def append_experiment(rows: DataFrame, folder: str) -> None:
    """One more run of an experiment, as CSV with a header per file."""
    rows.write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def run_experiment(questions: DataFrame, retrieve, answer, folder: str) -> DataFrame:
    """One run of an experiment: contexts by ``retrieve(questions)`` (query_id, context), answers by ``answer`` (query_id, answer), and
    the seconds that each step took over all questions; appended as CSV and given back."""
    import time

    from leafmill.runtime import cut

    began = time.time()
    contexts = cut(retrieve(questions).select("query_id", "context"))
    middle = time.time()
    asked = questions.select("query_id", "question").join(contexts, "query_id", "left")
    answers = cut(answer(asked).select("query_id", "answer"))
    ended = time.time()
    rows = asked.join(answers, "query_id", "left").select("question", "context", "answer", F.lit(round(middle - began, 3)).alias("retrieve_time_sec"), F.lit(round(ended - middle, 3)).alias("generate_time_sec"))
    append_experiment(rows, folder)
    return rows
