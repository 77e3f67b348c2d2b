"""Search, fusion, re-scoring, token budgets and routing over batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from leafmill.config import DEFAULT, Compat, Settings
from leafmill.functions import text as X

BLOCK = 2048


def terms(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")


# ---- vectors --------------------------------------------------------------------------------------------------------------


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` greatest similarities and their ids; of equal ones the smaller ids. ``ids`` is a row or has the shape of ``sims``."""
    wide = np.broadcast_to(ids, sims.shape)
    if sims.shape[1] <= k:
        return sims, wide
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(sims, at, 1)
    least = top.min(axis=1)
    for r in np.flatnonzero((sims >= least[:, None]).sum(axis=1) > k):  # a tie over the border
        idx = np.flatnonzero(sims[r] >= least[r])
        at[r] = idx[np.lexsort((wide[r, idx], -sims[r, idx]))[:k]]
    return np.take_along_axis(sims, at, 1), np.take_along_axis(wide, at, 1)


def _near(shared, k: int, skip_self: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, block = shared.value
        best: list = [None] * -(-len(asked) // BLOCK)
        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            own = own.astype(np.int64 if pa.types.is_integer(kind) else np.str_)
            vecs = np.array(b.column(1).to_pylist(), np.float64)
            norm = np.linalg.norm(vecs, axis=1)
            vecs = (vecs / np.where(norm == 0, 1, norm)[:, None]).T
            for j in range(len(best)):
                part = slice(j * BLOCK, (j + 1) * BLOCK)
                sims = np.round(block[part] @ vecs, 6)
                if skip_self:
                    sims[asked[part, None] == own[None, :]] = -9
                found = _best(sims, own, k)
                if best[j] is not None:
                    found = _best(np.concatenate([best[j][0], found[0]], 1), np.concatenate([best[j][1], found[1]], 1), k)
                best[j] = found
        for j, found in enumerate(best):
            if found is not None:
                q = np.repeat(asked[j * BLOCK : (j + 1) * BLOCK], found[0].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found[1].ravel(), kind), pa.array(found[0].ravel(), pa.float64())], names=["query_id", "vec_id", "similarity"])

    return work


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT.vector_limit, threshold: float | None = DEFAULT.vector_threshold, skip_self: bool = False, most_bytes: int = 1 << 26) -> DataFrame:
    """(query_id, rank, vec_id, similarity): exact nearest vectors by cosine, similarities rounded to six places.

    The stated queries travel to the corpus, as many at once as ``most_bytes`` hold (more take further passes); each task multiplies
    blocks of BLOCK of them with its Arrow batches and keeps their k best, so a task gives k rows per query however much it
    reads, and the corpus is never moved. Ids of vectors are numbers or texts; ties go to the smaller id. Vectors that are
    null are left out; a vector of zeros is similar to nothing. The threshold is applied after the limit.
    """
    name = "string" if dict(corpus.dtypes)["vec_id"] == "string" else "bigint"
    rows = corpus.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast(name), F.col("embedding").cast("array<double>"))
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    out: DataFrame | None = None

    def add(part: list) -> None:
        nonlocal out
        vecs = np.array([r[1] for r in part], np.float64)
        norm = np.linalg.norm(vecs, axis=1)
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in part], np.int64), vecs / np.where(norm == 0, 1, norm)[:, None]))
        found = rows.mapInArrow(_near(shared, k, skip_self), f"query_id bigint, vec_id {name}, similarity double")
        out = found if out is None else out.unionByName(found)

    part: list = []
    for r in asked.toLocalIterator():
        part.append(r)
        if len(part) * 8 * max(len(r[1]), k) >= most_bytes:
            add(part)
            part = []
    if part:
        add(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id bigint, rank int, vec_id {name}, similarity double")
    best = out.where("similarity > -9").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)
    if threshold is not None:
        best = best.where(F.col("similarity") >= threshold)
    return best.select("query_id", "rank", "vec_id", "similarity")


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """A deterministic stand-in for an embedding model: signed feature hashing of terms, unit length; one pass over the terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(b.num_columns - 1)
            size, flat = h.value_lengths().to_numpy(zero_copy_only=False), h.flatten().to_numpy(zero_copy_only=False)
            v = np.zeros((b.num_rows, dim))
            np.add.at(v, (np.repeat(np.arange(b.num_rows), size), flat % dim), np.where(flat // dim % 2 == 0, 1.0, -1.0))
            norm = np.linalg.norm(v, axis=1)
            v /= np.where(norm == 0, 1, norm)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], out])

    h = F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda w: F.conv(F.left(F.md5(w.cast("binary")), F.lit(8)), 16, 10).cast("bigint"))
    rows = df.drop(out) if out in df.columns else df
    schema = StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))])
    return rows.withColumn("_h", h).mapInArrow(work, schema)


# ---- text -----------------------------------------------------------------------------------------------------------------


def postings(chunks: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len): the inverted index of chunks (doc_id, text), once per doc_id."""
    t = chunks.where("doc_id is not null and text is not null").select("doc_id", terms(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def text_search(queries: DataFrame, index: DataFrame, k: int = DEFAULT.text_limit, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): BM25 over the inverted index; scores rounded to six places, ties by id."""
    docs = index.groupBy("doc_id").agg(F.max("len").alias("len"))
    size = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    # hot terms: the query side is joined to document frequencies first, then to the postings, where AQE may split them
    met = asked.join(df, "term").join(index, "term").join(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = met.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def hybrid_retrieve(asked: DataFrame, chunks: DataFrame, weights: dict[str, float] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, rank, doc_id, rrf_score): vector and text search of questions (query_id, question) over chunks (doc_id, text), fused."""
    named = chunks.select("doc_id", F.col("doc_id").cast("string").alias("vec_id"), "text")
    near = vector_search(hashed_embedding(asked.select("query_id", "question"), "question"), hashed_embedding(named.select("vec_id", "text"), "text").select("vec_id", "embedding"), s.vector_limit, None)
    near = near.select("query_id", F.lit("vector").alias("list"), "rank", F.col("vec_id").alias("doc_id"))
    found = text_search(asked.select("query_id", F.col("question").alias("text")), postings(chunks), s.text_limit)
    found = found.select("query_id", F.lit("bm25").alias("list"), "rank", F.col("doc_id").cast("string").alias("doc_id"))
    return rrf_merge(near.unionByName(found), weights or {"vector": 0.75, "bm25": 0.25}, s)


# ---- fusion, re-scoring, budget --------------------------------------------------------------------------------------------


def rrf_merge(lists: DataFrame, weights: dict[str, float], s: Settings = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, doc_id, rrf_score, *keep): reciprocal ranks summed over lists (query_id, list, rank, doc_id).

    A document that a list has twice counts once, at its best rank. Ties: the list named first in ``weights``, then the
    rank there, then the id. ``keep`` names further columns, equal for all rows of a document and query.
    """
    kept = [F.max(c).alias(c) for c in keep]
    names = list(weights)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("list"))
    turn = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("list"))
    one = lists.where(F.col("list").isin(names) & F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).groupBy("query_id", "list", "doc_id").agg(F.min("rank").alias("rank"), *kept)
    merged = one.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (s.rrf_constant + F.col("rank"))), 9).alias("rrf_score"), F.min(F.struct(turn.alias("turn"), F.col("rank").alias("first"))).alias("seen"), *kept)
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen.turn", "seen.first", "doc_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.rrf_top_k).select("query_id", "rank", "doc_id", "rrf_score", *keep)


def overlap_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the question's terms that the text holds."""
    q = F.array_distinct(terms(F.coalesce(question, F.lit(""))))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, terms(F.coalesce(text, F.lit(""))))) / F.size(q), 6))


def rerank(ranked: DataFrame, score: Column) -> DataFrame:
    """The same rows in the order of a new score, stable with regard to the old rank."""
    scored = ranked.withColumn("rerank_score", score)
    return scored.withColumn("old", F.col("rank")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "old", "doc_id"))).drop("old")


def greedy_budget(ranked: DataFrame, s: Settings = DEFAULT, compat: Compat = Compat()) -> DataFrame:
    """Rows (query_id, rank, doc_id, text, n_images) that fit the token budget in rank order; what does not fit is passed over.
    Rows with ``tokens`` bring their cost along instead of the text.

    Lists of any length stream through sorted Arrow partitions; only the budget used so far is carried from row to row.
    """
    if "tokens" in ranked.columns:
        cost = F.col("tokens")
    else:
        images = F.lit(0) if compat.free_images else F.coalesce(F.col("n_images"), F.lit(0)) * s.image_token_estimate
        cost = X.token_count(F.coalesce(F.col("text"), F.lit(""))) + images
    rows = ranked.where("rank is not null").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"), cost.cast("int").alias("tokens"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, used = None, 0
        for b in batches:
            keep = []
            for q, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if q != query:
                    query, used = q, 0
                keep.append(used + n <= s.token_budget)
                used += n if keep[-1] else 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("query_id").sortWithinPartitions("query_id", "rank", "doc_id", "tokens").mapInArrow(work, rows.schema)


def intent_route(nearest: DataFrame, routes: DataFrame, s: Settings = DEFAULT, fallback: str = "need_retrieve") -> DataFrame:
    """(query_id, route): the route of the most similar utterance, or the fallback below the threshold or without any.

    ``nearest`` has (query_id, vec_id, similarity), ``routes`` (vec_id, route).
    """
    r = nearest.join(routes, "vec_id").groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("vec_id")).alias("v"), "route")).alias("m"))
    return r.select("query_id", F.when(F.col("m.similarity") >= s.intent_threshold, F.col("m.route").cast("string")).otherwise(F.lit(fallback)).alias("route"))
