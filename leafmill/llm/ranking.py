"""One ranking from scores on unlike scales: robust rank aggregation.

Every score is turned into its rank within its list, divided by the length of the list; ties share their mean rank. The
sorted normalised ranks r(1) <= ... <= r(n) of an item are judged against ranks drawn at random: the k-th smallest of n
uniform numbers is at most r(k) with the probability of a beta order statistic, P(Beta(k, n-k+1) <= r(k)), which is the
upper tail of a binomial distribution. The least of these, times n and at most 1, is the item's significance; items are
ranked by it, then by their mean rank, then by id. Only ranks enter, so no scale can dominate.

Lists of one question: ``score`` per retriever, and ``rrf_score`` and ``rerank_score`` once. A list in which an item has no
score says nothing about it: n is the number of lists that do.

A question may hold a large share of all rows, so ranks within lists come from ``distributed_rank`` and not from one
task's sort. A question's items are aggregated over at most as many lists as there are retrievers, plus two.

Defined results: null and NaN scores count as absent; an item without any score comes last with significance 1; repeated
rows count once and of unequal repeats the greatest score holds; rows with a null query_id or doc_id are left out; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.runtime import cut, distributed_rank, merged


def upper_tail(n: Column, k: Column, r: Column) -> Column:
    """P(at least k of n uniform numbers are <= r), the distribution function of the k-th order statistic at r."""

    def term(i: Column) -> Column:
        ways = F.aggregate(F.sequence(F.lit(1), i), F.lit(1.0), lambda acc, j: acc * (n - i + j).cast("double") / j.cast("double"))
        return ways * F.pow(r, i) * F.pow(1 - r, n - i)

    return F.aggregate(F.sequence(k, n), F.lit(0.0), lambda acc, i: acc + term(i))


def significance(ranks: Column) -> Column:
    """The corrected minimum over the order statistics of a sorted array of normalised ranks."""
    n = F.size(ranks)
    each = F.transform(ranks, lambda r, k: upper_tail(n, k + 1, r))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.array_min(each) * n))


def score_lists(hits: DataFrame) -> DataFrame:
    """(query_id, list, doc_id, value): each list of each question, an item at most once."""
    rows = hits.where("query_id is not null and doc_id is not null")
    named = F.array(
        F.struct(F.concat(F.lit("score:"), F.coalesce(F.col("retriever"), F.lit(""))).alias("list"), F.col("score").cast("double").alias("value")),
        F.struct(F.lit("rrf_score").alias("list"), F.col("rrf_score").cast("double").alias("value")),
        F.struct(F.lit("rerank_score").alias("list"), F.col("rerank_score").cast("double").alias("value")),
    )
    long = rows.select("query_id", "doc_id", F.explode(named).alias("s")).select("query_id", F.col("s.list").alias("list"), "doc_id", F.col("s.value").alias("value"))
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return long.groupBy("query_id", "list", "doc_id").agg(F.max("value").alias("value"))


def one_ranking(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, n_lists, significance, final_rank), one row per question and chunk."""
    lists = score_lists(hits)
    lists = cut(lists)
    # ties share the mean of their places, so only distinct values, counted on the map side, are put in order; no ids travel
    values = lists.where("value is not null").groupBy("query_id", "list", "value").agg(F.count("*").alias("n"))
    placed = distributed_rank(values, ["query_id", "list"], [F.col("value").desc()], "upto", "size", "n")
    mean = ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("size")).alias("r")
    at = placed.select(F.col("query_id").alias("t_query"), F.col("list").alias("t_list"), F.col("value").alias("t_value"), mean)
    ranks = merged(lists.where("value is not null"), at, (F.col("query_id") == F.col("t_query")) & (F.col("list") == F.col("t_list")) & (F.col("value") == F.col("t_value"))).select("query_id", "doc_id", "r")
    scored = ranks.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("r")).alias("ranks"))
    bare = lists.where("value is null").select("query_id", "doc_id").distinct().withColumn("ranks", F.array().cast("array<double>"))
    # an item may have a score in one list and none in another
    items = scored.unionByName(bare).groupBy("query_id", "doc_id").agg(F.max_by("ranks", F.size("ranks")).alias("ranks"))
    mean = F.coalesce(F.aggregate("ranks", F.lit(0.0), lambda a, x: a + x) / F.when(F.size("ranks") > 0, F.size("ranks")), F.lit(1.0))
    judged = items.select("query_id", "doc_id", F.size("ranks").alias("n_lists"), F.round(significance(F.col("ranks")), 9).alias("significance"), F.round(mean, 9).alias("mean_rank"))
    return distributed_rank(judged, ["query_id"], [F.col("significance"), F.col("mean_rank"), F.col("doc_id")], "final_rank")


SQL = """WITH long AS (
  SELECT query_id, 'score:' || coalesce(retriever, '') AS list, doc_id, score AS value FROM hits
  UNION ALL SELECT query_id, 'rrf_score', doc_id, rrf_score FROM hits
  UNION ALL SELECT query_id, 'rerank_score', doc_id, rerank_score FROM hits),
l AS (SELECT query_id, list, doc_id, max(CASE WHEN NOT isnan(value) THEN value END) AS value FROM long WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY value DESC, doc_id) AS place, count(*) OVER (PARTITION BY query_id, list) AS size FROM l WHERE value IS NOT NULL),
r AS (SELECT query_id, doc_id, avg(place) OVER (PARTITION BY query_id, list, value) / size AS r FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r) AS k, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM r),
t AS (SELECT query_id, doc_id, r, k, n, unnest(generate_series(k, n)) AS i FROM o),
b AS (SELECT query_id, doc_id, k, n, r, sum(round(factorial(n::INT) / factorial(i::INT) / factorial((n - i)::INT)) * pow(r, i) * pow(1 - r, n - i)) AS prob FROM t GROUP BY ALL),
s AS (SELECT query_id, doc_id, least(1.0, min(prob) * max(n)) AS s, avg(r) AS m, max(n) AS n FROM b GROUP BY ALL),
a AS (SELECT query_id, doc_id, coalesce(n, 0)::INT AS n_lists, round(coalesce(s, 1.0), 9) AS significance, round(coalesce(m, 1.0), 9) AS mean_rank FROM (SELECT DISTINCT query_id, doc_id FROM l) LEFT JOIN s USING (query_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY significance, mean_rank, doc_id) AS final_rank FROM a"""
