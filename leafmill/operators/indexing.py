"""Index records, text parts and conflict-free writes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import chunking as C


def positions(chunks: DataFrame) -> DataFrame:
    """(p_id, p_doc, i): each chunk's position in its document."""
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("first_order", "chunk_id")) - 1
    return chunks.select("doc_id", "chunk_id", "first_order").withColumn("i", pos).select(F.col("chunk_id").alias("p_id"), F.col("doc_id").alias("p_doc"), "i")


def searched_text(stored: Column) -> Column:
    """The embedded text of a chunk with ``images`` that have no descriptions."""
    figures = F.transform("images", lambda x, k: F.concat(F.lit("["), k.cast("string"), F.lit("] \n")))
    return F.when(F.size("images") > 0, F.concat(stored, F.lit("\n[FIGURE_DESCRIPTIONS]\n"), F.array_join(figures, ""))).otherwise(stored)


def index_data(chunks: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """(id, document, section, token_count, chunk_id, text_content, search_content, images) of chunks.

    Image ids are made of place, chunk and the chunk's position in its document; descriptions (img_id, description) go into the
    searched text, missing ones as empty. Positions come from a window over small columns.
    """
    rows = chunks.join(positions(chunks), (F.col("chunk_id") == F.col("p_id")) & (F.col("doc_id") == F.col("p_doc")))
    section = X.section_cleanup(F.col("section"))
    ids = F.transform("images", lambda x, k: F.concat(F.lit("img"), k.cast("string"), F.lit("_"), F.col("chunk_id"), F.lit("_"), F.col("i").cast("string")))
    out = rows.select(F.concat("chunk_id", F.lit("_"), F.col("i").cast("string")).alias("id"), "doc_id", "document", section.alias("section"), "token_count", "chunk_id", F.col("text").alias("text_content"), X.store_text(section, F.col("text")).alias("stored"), ids.alias("images"))
    if descriptions is None:
        return out.withColumn("search_content", searched_text(F.col("stored"))).drop("stored")
    d = descriptions.groupBy(F.col("img_id").alias("d_id")).agg(F.max("description").alias("description"))
    each = out.select("id", F.posexplode("images").alias("k", "img")).join(d, F.col("img") == F.col("d_id"), "left")
    told = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("description", F.lit("")).alias("t")))).alias("f")).withColumnRenamed("id", "f_id")
    text = F.array_join(F.transform("f", lambda x: F.concat(F.lit("["), x["k"].cast("string"), F.lit("] "), x["t"], F.lit("\n"))), "")
    joined = out.join(told, F.col("id") == F.col("f_id"), "left")
    return joined.withColumn("search_content", F.when(F.size("images") > 0, F.concat("stored", F.lit("\n[FIGURE_DESCRIPTIONS]\n"), text)).otherwise(F.col("stored"))).drop("stored", "f", "f_id")


def insert_ignore(there: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of ``new`` that an insert would add: keys not there yet, of each the first by ``order``."""
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in new.columns if c not in (key, *order)])).alias("_r"))
    rows = first.select(key, *[F.col(f"_r.{c}").alias(c) for c in new.columns if c != key])
    return rows.join(there.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti").select(*new.columns)


def text_parts(rows: DataFrame) -> DataFrame:
    """(id, k, text, token_count): contents split into parts of bounded size, in Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, k, t, n) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (t, n) in enumerate(C.split_text(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32()))], names=["id", "k", "text", "token_count"])

    return rows.where(F.length("content") > 0).select("id", "content").mapInArrow(work, "id string, k int, text string, token_count int")
