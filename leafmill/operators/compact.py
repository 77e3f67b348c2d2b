"""Both searches over a large corpus for many questions: documents in compact form, no pair of question and document in a shuffle.

A document is kept as its hashed vector and its counts of the words that any question has. Tasks hold a shard of such documents and
answer a slice of the questions, so that only what the task may have as its best leaves it, with what re-scoring and the budget ask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from leafmill.config import DEFAULT, Settings
from leafmill.functions import text as X
from leafmill.operators.retrieval import terms

DIM = 64
#: Documents of a task, of these held at once, and questions whose candidates are held at once.
PART, SHARD, BLOCK = 65536, 16384, 512
#: More than what single precision can be off in a product of two unit vectors, and than what rounding to six places moves a score.
NEAR, ROUNDED = 1e-5, 2e-6


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return np.array([known[w] for w in words], np.int64)


def _vectors(row: np.ndarray, code: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Signed counts of hashed words by slot: word ``code`` with hash ``v[code]`` in ``row``."""
    sign = np.where(v // DIM % 2 == 0, 1.0, -1.0)
    return np.bincount(row * DIM + v[code] % DIM, weights=sign[code], minlength=n * DIM).reshape(n, DIM)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of lists of words: the row and the code of each word, the words a row has, and the words by code."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), size), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), size, words.dictionary.to_pylist()


def questions(asked: DataFrame) -> dict:
    """Of questions (query_id, question): ids, words, signed counts, and the different words of each as codes."""
    t = asked.where("query_id is not null").select(F.col("query_id").cast("bigint"), terms(F.coalesce("question", F.lit(""))).alias("w")).toArrow()
    row, code, size, words = _flat(t.column("w"))
    pairs = np.unique(row * max(1, len(words)) + code)
    own = pairs // max(1, len(words))
    return {"id": t.column("query_id").to_numpy(), "words": words, "vec": _vectors(row, code, _hashes(words, {}), len(size)).astype(np.float32), "term": pairs % max(1, len(words)), "from": _starts(np.bincount(own, minlength=len(size)))}


def compacted(docs: DataFrame, words: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Documents (..., text, n_images) as (..., tokens, len, vec, term, tf): cost, words, hashed vector, counts of ``words`` by code."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = pa.array(shared.value, pa.string()), {}
        wide = max(1, len(asked))
        for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):  # words take more room than the batch
            row, code, size, own = _flat(b.column(b.num_columns - 1))
            n = b.num_rows
            vec = _vectors(row, code, _hashes(own, known), n).astype("<i4")
            at = pc.fill_null(pc.index_in(pa.array(own, pa.string()), value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            pairs, tf = np.unique((row * wide + at)[at >= 0], return_counts=True)
            starts = pa.array(_starts(np.bincount(pairs // wide, minlength=n)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (pairs % wide, tf)]
            blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 4 * DIM).astype("<i4")), pa.py_buffer(np.ascontiguousarray(vec))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int32()), blobs, *lists], names=[*b.schema.names[:-1], "len", "vec", "term", "tf"])
        pa.default_memory_pool().release_unused()  # workers wait for further tasks beside those of the next stage

    tokens = (X.token_count(F.coalesce("text", F.lit(""))) + F.coalesce("n_images", F.lit(0)) * s.image_token_estimate).cast("int")
    rows = docs.withColumn("tokens", tokens).withColumn("_w", terms(F.coalesce("text", F.lit("")))).drop("text", "n_images")
    more = [StructField("len", IntegerType()), StructField("vec", BinaryType()), StructField("term", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))]
    return rows.mapInArrow(work, StructType([*rows.schema.fields[:-1], *more]))


def _kept(row: np.ndarray, value: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k`` greatest values, of equal ones the smaller documents, in that order."""
    by = np.lexsort((doc, -value, row))
    row, value, doc = row[by], value[by], doc[by]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    keep = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row))) < k
    return row[keep], value[keep], doc[keep]


def _nearest(q: np.ndarray, d: np.ndarray, unit: np.ndarray, norm: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact: what single precision leaves within NEAR of the k best so far is worked out from the counts; nothing below ``floor``."""
    length = np.sqrt((q * q).sum(axis=1))
    one = (q / np.where(length == 0, 1, length)[:, None]).astype(np.float32)
    none = np.flatnonzero(length == 0)  # similar to nothing: the first documents
    some = np.flatnonzero(length > 0)
    few = min(k, len(d))
    row, value, doc = np.repeat(none, few), np.zeros(len(none) * few), np.tile(np.arange(few), len(none))
    r, v, c = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    least = (floor[some] - NEAR).astype(np.float32)
    at, step = 0, 2048
    while at < len(d) and len(some):
        sims = one[some] @ unit[at : at + step].T
        if at == 0 and sims.shape[1] > k:
            least = np.maximum(least, np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k] - np.float32(NEAR))
        hit = np.flatnonzero((sims >= least[:, None]).ravel())
        r1, c1 = hit // sims.shape[1], hit % sims.shape[1] + at
        by = norm[c1] * length[some[r1]]
        v1 = np.round(np.einsum("ij,ij->i", q[some[r1]], d[c1].astype(np.float64)) / np.where(by == 0, 1, by), 6)
        r, v, c = _kept(np.concatenate([r, r1]), np.concatenate([v, v1]), np.concatenate([c, c1]), k)
        full = np.bincount(r, minlength=len(some)) >= k
        lows = np.full(len(some), np.inf)
        np.minimum.at(lows, r, v)
        least = (np.where(full, np.maximum(lows, floor[some]), floor[some]) - NEAR).astype(np.float32)
        at, step = at + step, 8192
    return np.concatenate([row, some[r]]), np.concatenate([value, v]), np.concatenate([doc, c])


class _Postings:
    """A shard's postings by word, with BM25 weights and the greatest weight of each word."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, n_docs: int) -> None:
        self.key = term.astype(np.int64) * n_docs + doc
        by = np.argsort(self.key, kind="stable")
        self.key, self.doc, self.weight, self.n = self.key[by], doc[by], weight[by], n_docs
        self.at = np.searchsorted(self.key, np.arange(n_terms + 1) * n_docs)
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, term, weight)
        self.sums = np.zeros(n_docs)

    def has(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = term * self.n + doc
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return (self.key[at] == key if len(self.key) else np.zeros(len(key), bool)), at

    def best(self, words: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Exact: words are added from the greatest weight on, until the rest cannot lift a document met in none of them."""
        words = words[self.most[words] > 0]
        words = words[np.argsort(-self.most[words], kind="stable")]
        rest = np.append(np.cumsum(self.most[words][::-1])[::-1], 0.0)
        met, j = [], 0
        while j < len(words) and rest[j] >= least - ROUNDED:
            own = slice(self.at[words[j]], self.at[words[j] + 1])
            docs = self.doc[own]
            self.sums[docs] += self.weight[own]
            met.append(docs)
            if len(docs) >= k:
                now = self.sums[docs]
                least = max(least, np.partition(now, len(now) - k)[len(now) - k])
            j += 1
        if not met:
            return np.zeros(0), np.zeros(0, np.int64)
        docs = np.concatenate(met)
        found = np.unique(docs[self.sums[docs] + rest[j] >= least - ROUNDED])
        score = self.sums[found]
        self.sums[docs] = 0
        for w in words[j:]:
            there, at = self.has(np.full(len(found), w), found)
            score = score + np.where(there, self.weight[at], 0)
        _, score, found = _kept(np.zeros(len(found), np.int64), np.round(score, 6), found, k)
        return score, found


def _raised(tops: np.ndarray, row: np.ndarray, value: np.ndarray) -> None:
    """Let ``tops``, the k greatest values of each row so far, take up further values, at most k a row."""
    by = np.argsort(row, kind="stable")
    row, value = row[by], value[by]
    more = np.full(tops.shape, -np.inf)
    more[row, np.arange(len(row)) - np.searchsorted(row, row)] = value
    tops[:] = np.partition(np.concatenate([tops, more], 1), tops.shape[1], axis=1)[:, tops.shape[1] :]


def _answers(shared, part: slice, s: Settings) -> Callable:
    def shard(held: list[pa.RecordBatch], near: np.ndarray, found_in: np.ndarray) -> Iterator[pa.RecordBatch]:
        q = shared.value
        t = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # places are in the order of the ids
        held.clear()
        n, n_terms = t.num_rows, len(q["idf"])
        ids, tokens, lists = t.column("doc_id").combine_chunks(), t.column("tokens").to_numpy(), t.column("term").combine_chunks()
        d = np.frombuffer(b"".join(x.as_buffer() for x in t.column("vec")), "<i4").reshape(n, DIM).astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", d, d, dtype=np.float64))
        unit = d / np.where(norm == 0, 1, norm)[:, None].astype(np.float32)
        doc = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy(), t.column("tf").combine_chunks().flatten().to_numpy()
        part_of = (1.2 * (0.25 + 0.75 * t.column("len").to_numpy() / q["average"]))[doc]
        p = _Postings(doc, term, q["idf"][term] * tf * 2.2 / (tf + part_of), n_terms, n)
        del t, lists, doc, term, tf, part_of
        for lo in range(part.start, part.stop, BLOCK):
            hi = min(lo + BLOCK, part.stop)
            row, value, place = _nearest(q["vec"][lo:hi].astype(np.float64), d, unit, norm, s.vector_limit, (tops := near[lo - part.start : hi - part.start]).min(axis=1))
            _raised(tops, row, value)
            lists = [(np.full(1, hi - lo), np.zeros(1), np.zeros(1, np.int64))]
            tops = found_in[lo - part.start : hi - part.start]
            for i, floor in zip(range(lo, hi), tops.min(axis=1), strict=True):
                score, docs = p.best(q["term"][q["from"][i] : q["from"][i + 1]], s.text_limit, floor)
                lists.append((np.full(len(docs), i - lo), score, docs))
            own = [np.concatenate(x)[1:] for x in zip(*lists, strict=True)]
            _raised(tops, own[0], own[1])
            turn = np.repeat(np.array([1, 2], np.int32), [len(row), len(own[0])])
            row, value, place = (np.concatenate(x) for x in zip((row, value, place), own, strict=True))
            words = np.diff(q["from"])[lo + row]
            at = np.repeat(np.arange(len(row)), words)
            word = q["term"][np.repeat(q["from"][lo + row] - _starts(words)[:-1], words) + np.arange(len(at))]
            common = np.bincount(at[p.has(word, place[at])[0]], minlength=len(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q["id"][lo + row], pa.int64()), pa.array(turn), ids.take(pa.array(place)), pa.array(value), pa.array(common, pa.int32()), pa.array(words, pa.int32()), pa.array(tokens[place], pa.int32())],
                names=["query_id", "turn", "doc_id", "value", "common", "words", "tokens"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tops = [np.full((part.stop - part.start, k), -np.inf) for k in (s.vector_limit, s.text_limit)]
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SHARD:
                yield from shard(held, *tops)
        if any(x.num_rows for x in held):
            yield from shard(held, *tops)
        pa.default_memory_pool().release_unused()

    return work


def both_searches(asked: dict, docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, list, rank, doc_id, common, words, tokens): the nearest and the best by BM25 of each question over compact documents.

    ``docs`` (doc_id, tokens, len, vec, term, tf) is read more than once and should be cut. ``common`` counts the question's different ``words``
    that a document has. Ties go to the smaller id, scores are rounded to six places.
    """
    spark = docs.sparkSession
    met, size, count = docs.agg(F.count(F.when(F.col("len") > 0, 1)), F.sum("len"), F.count("*")).first()
    df = np.zeros(len(asked["words"]))
    for r in docs.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():
        df[r[0]] = r[1]
    idf = np.log(1 + (met - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast({k: asked[k] for k in ("id", "vec", "term", "from")} | {"idf": idf, "average": (size or 0) / max(1, met)})
    n, shards = len(asked["id"]), max(1, -(-count // PART))
    each = max(1, -(-n // max(1, -(-2 * spark.sparkContext.defaultParallelism // shards))))
    rows = docs.select("doc_id", "tokens", "len", "vec", "term", "tf").coalesce(shards)
    kind = "query_id bigint, turn int, doc_id string, value double, common int, words int, tokens int"
    out = spark.createDataFrame([], kind)
    for lo in range(0, n, each):
        out = out.unionByName(rows.mapInArrow(_answers(shared, slice(lo, min(n, lo + each)), s), kind))
    line = W.partitionBy("query_id", "turn").orderBy(F.desc("value"), "doc_id")
    limit = F.when(F.col("turn") == 1, s.vector_limit).otherwise(s.text_limit)
    ranked = out.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= limit)
    return ranked.select("query_id", F.when(F.col("turn") == 1, "vector").otherwise("bm25").alias("list"), "rank", "doc_id", "common", "words", "tokens")
