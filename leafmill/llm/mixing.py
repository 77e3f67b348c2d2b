"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths.

Every document is counted once, by source and exact token length. The mixture's size is the largest for which every source can
deliver its share with at most ``max_repeats`` copies of a document (or ``total_tokens``, if given). A source's budget is met by
whole rounds over all its documents, then by a part of one more round: of the n documents of a length, the same
fraction of each length is taken, rounded down and short of a window, and what is left of the budget is fitted by a
bounded knapsack over the remaining counts (reachable sums as bit sets). Which documents of a length are taken is decided by a seeded hash.

The knapsack sees only (length, count) pairs of one source, never documents. Choosing the first m of the n documents of a
length is done over hash buckets of about ``BUCKET`` documents with running counts, so one length may hold any
share of all rows.

Defined results: documents without a source, of a source without a target, or of no tokens (null or empty text) are not taken;
a doc_id that occurs twice counts once; a source with a target but no tokens gets actual share 0 and the other shares are scaled
up; a source whose documents are too few or too long to meet its budget exactly is left short, and the report says by how many
tokens; targets that are null or not above 0 are left out; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET = 10_000


def _count_tokens(raw) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int32())], names=["doc_id", "source", "tokens"])

    return work


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), once per doc_id. The vocabulary file, of fixed size, is read on the driver and broadcast."""
    with open(vocabulary, "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).where("doc_id is not null and source is not null")
    sizes = rows.mapInArrow(_count_tokens(raw), "doc_id bigint, source string, tokens int").where("tokens > 0")
    return sizes.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.source", "s.tokens")


def fit(lengths: list[int], counts: list[int], budget: int, max_repeats: int, seed: int = 7) -> tuple[int, list[int], int]:
    """Whole rounds, extra copies per length (spread evenly over its documents), and tokens no choice can fill."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return 0, [0] * len(lengths), max(0, budget)
    rounds = min(max_repeats, budget // total)
    rest = budget - rounds * total
    if rounds == max_repeats or not rest:
        return rounds, [0] * len(lengths), rest
    window = min(2 * max(lengths), 1 << 16)
    extra = [c * max(0, rest - window) // total for c in counts]  # the window is left to the knapsack
    rest -= sum(n * x for n, x in zip(lengths, extra, strict=True))
    order = sorted(range(len(lengths)), key=lambda k: hashlib.md5(f"{seed}:{lengths[k]}".encode()).digest())
    for k in order:  # the rounding, undone for lengths in seeded order until the knapsack's window is reached
        if rest - lengths[k] >= window and extra[k] < counts[k]:
            extra[k] += 1
            rest -= lengths[k]
    for k in sorted(order, key=lambda k: -lengths[k]):
        if rest > window and (m := min(counts[k] - extra[k], (rest - window) // lengths[k])) > 0:
            extra[k] += m
            rest -= m * lengths[k]
    best = _knapsack(lengths, [c - x for c, x in zip(counts, extra, strict=True)], rest, order)
    if best[1] and max_repeats - rounds > 1:  # no exact fit with one more copy of each: allow as many as there may be
        more = _knapsack(lengths, [c * (max_repeats - rounds) - x for c, x in zip(counts, extra, strict=True)], rest, order)
        best = min(best, more, key=lambda x: x[1])
    return rounds, [x + y for x, y in zip(extra, best[0], strict=True)], best[1]


def _knapsack(lengths: list[int], counts: list[int], rest: int, order: list[int]) -> tuple[list[int], int]:
    """How many of each length come nearest to ``rest`` without passing it, and what is left."""
    reach, steps, mask, take = 1, [], (1 << (rest + 1)) - 1, [0] * len(lengths)
    for k in order:
        left, lot = min(counts[k], rest // lengths[k]), 1
        while left > 0 and not reach >> rest & 1:
            m = min(lot, left)
            steps.append((reach, k, m))
            reach |= reach << (m * lengths[k]) & mask
            left -= m
            lot *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    rest -= at
    for before, k, m in reversed(steps):
        if not before >> at & 1:
            take[k] += m
            at -= m * lengths[k]
    return take, rest


def _fit(budgets: dict[str, tuple[int, int]], seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(hist: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("tokens")
        budget, repeats = budgets[hist["source"].iloc[0]]
        rounds, extra, _ = fit(hist["tokens"].tolist(), hist["n"].tolist(), budget, repeats, seed)
        return pd.DataFrame({"p_source": hist["source"], "p_tokens": hist["tokens"], "n": hist["n"], "rounds": rounds, "extra": extra})

    return work


def _budgets(totals: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None) -> dict[str, tuple[int, int]]:
    there = [(s, w, r) for s, w, r in targets if totals.get(s)]
    weight = math.fsum(w for _, w, _ in there)
    if not there:
        return {}
    most = min(int(r * totals[s] * weight / w) for s, w, r in there)
    size = most if total_tokens is None else total_tokens
    return {s: (min(round(size * w / weight), r * totals[s]), r) for s, w, r in there}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and the report of shares per source."""
    spark: SparkSession = documents.sparkSession
    sizes = cut(token_sizes(documents, vocabulary))
    hist = sizes.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    rows = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").collect()
    wanted = [(r[0], r[1], r[2]) for r in rows]
    by_source = hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"))
    totals = {r[0]: r[1] for r in by_source.where(F.col("source").isin([s for s, _, _ in wanted])).collect()}
    budgets = _budgets(totals, wanted, total_tokens)
    chosen = hist.where(F.col("source").isin(list(budgets)))
    plan = chosen.groupBy("source").applyInPandas(_fit(budgets, seed), "p_source string, p_tokens int, n bigint, rounds bigint, extra bigint")
    planned = sizes.join(plan, (F.col("source") == F.col("p_source")) & (F.col("tokens") == F.col("p_tokens")))
    h = F.xxhash64("doc_id", F.lit(seed))
    placed = planned.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.ceil(F.col("n") / BUCKET)))
    group = ["source", "tokens", "bucket"]
    place = placed.withColumn("rn", F.row_number().over(W.partitionBy(*group).orderBy("h", "doc_id")))
    many = placed.where(F.col("n") > BUCKET).groupBy(*group).agg(F.count("*").alias("m"))
    before = many.withColumn("b4", F.coalesce(F.sum("m").over(W.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("source").alias("b_source"), F.col("tokens").alias("b_tokens"), F.col("bucket").alias("b_bucket"), "b4")
    at = place.join(before, (F.col("source") == F.col("b_source")) & (F.col("tokens") == F.col("b_tokens")) & (F.col("bucket") == F.col("b_bucket")), "left")
    copies = F.col("rounds") + F.floor(F.col("extra") / F.col("n")) + F.when(F.col("rn") + F.coalesce("b4", F.lit(0)) <= F.col("extra") % F.col("n"), 1).otherwise(0)
    mixture = at.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    goal = spark.createDataFrame([(s, float(w), int(r), int(totals.get(s, 0)), int(budgets.get(s, (0, 0))[0])) for s, w, r in wanted], "source string, target_share double, max_repeats int, available_tokens bigint, budget bigint")
    report = goal.join(F.broadcast(got) if len(wanted) < 10_000 else got, "source", "left")  # got has a row per target
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy(F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "budget", zero("tokens"), zero("documents"), zero("most_copies"))
    return mixture, report.withColumn("missing_tokens", F.col("budget") - F.col("tokens")).withColumn("actual_share", F.round(share, 9))
