"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.runtime import ensure_shipped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_shipped(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold characters which look like others."""
    from leafmill.llm.forms import unlike_forms

    elements = unlike_forms(table(spark, sf_dir, "atomic_elements"), "atomic_elements", "id", "content")
    return elements.unionByName(unlike_forms(table(spark, sf_dir, "hits"), "hits", "doc_id", "text"))


@query
def p6_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of both tables, its text in one form."""
    from leafmill.llm.forms import one_form

    elements = one_form(table(spark, sf_dir, "atomic_elements"), "atomic_elements", "id", "content")
    return elements.unionByName(one_form(table(spark, sf_dir, "hits"), "hits", "doc_id", "text")).distinct()


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold text garbled by a wrong encoding."""
    from leafmill.llm.encoding import garbled

    return garbled(table(spark, sf_dir, "documents")).select("doc_id").distinct()


@query
def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their original text as far as it can be had."""
    from leafmill.llm.encoding import garbled

    return garbled(table(spark, sf_dir, "documents"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that hold a line repeated excessively within their source."""
    from leafmill.llm.lines import excessive

    return excessive(table(spark, sf_dir, "atomic_elements"), table(spark, sf_dir, "corpus"), single=True).select("id").distinct()


@query
def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element's content without the excessive lines."""
    from leafmill.llm.lines import cleaned

    return cleaned(table(spark, sf_dir, "atomic_elements"), table(spark, sf_dir, "corpus"))


@query
def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excessive lines of each source."""
    from leafmill.llm.lines import lines_report

    return lines_report(table(spark, sf_dir, "atomic_elements"), table(spark, sf_dir, "corpus"))


_LINES = r"""WITH src AS (SELECT DISTINCT doc_id, source FROM corpus WHERE doc_id IS NOT NULL AND source IS NOT NULL),
 l AS (SELECT id, doc_id, unnest(string_split(content, chr(10))) AS line FROM atomic_elements WHERE type IN ('text', 'list_item', 'footnote', 'caption')),
 n AS (SELECT id, l.doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[\s\x{0B}\x{85}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '\p{Nd}+', '0', 'g')) AS form FROM l JOIN src USING (doc_id)),
 k AS (SELECT * FROM n WHERE length(regexp_replace(form, '[^\p{L}]', '', 'g')) >= 30),
 x AS (SELECT source, form, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)
"""
SQL["p4_found"] = _LINES + "SELECT DISTINCT id FROM k JOIN x USING (source, form) WHERE id IS NOT NULL"
SQL["p4_lines"] = _LINES + "SELECT source, form AS line, n_docs FROM x"


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items with which they have at least 16 consecutive words in common."""
    from leafmill.llm.leaks import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edited=False)
    return found.where("longest_run >= 16").select("doc_id", "item_id")


@query
def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks with their alignment, edited copies included."""
    from leafmill.llm.leaks import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking of the chunks per question from all its score lists."""
    from leafmill.llm.ranking import one_ranking

    return one_ranking(table(spark, sf_dir, "hits"))


@query
def p7_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted gain at 10 of that ranking for every judged question, against the best order of its labels."""
    from leafmill.llm.ranking import one_ranking

    labels = table(spark, sf_dir, "judgments").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = one_ranking(table(spark, sf_dir, "hits")).where("final_rank <= 10").join(labels, ["query_id", "doc_id"])
    got = got.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("final_rank") + 1)).alias("dcg"))
    # of the labels only the ten greatest count; grades are few, so their counts per question say where each stands
    by_grade = labels.where("grade > 0").groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    best = by_grade.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("g"))
    flat = F.slice(F.flatten(F.transform("g", lambda x: F.array_repeat(x["grade"], F.least(x["n"], F.lit(10)).cast("int")))), 1, 10)
    best = best.select("query_id", F.aggregate(F.transform(flat, lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2(i + F.lit(2))), F.lit(0.0), lambda a, x: a + x).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg10"))


from leafmill.llm.ranking import SQL as _RANKING  # noqa: E402

SQL["p7_ranking"] = _RANKING


@query
def p1_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of every element in containers of every capacity of pack_limits."""
    from leafmill.llm.packing import pack

    return pack(table(spark, sf_dir, "atomic_elements"), table(spark, sf_dir, "pack_limits"))


@query
def p1_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    from leafmill.llm.packing import fill_report, pack

    limits = table(spark, sf_dir, "pack_limits")
    return fill_report(pack(table(spark, sf_dir, "atomic_elements"), limits).drop("content"), limits)


@query
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    from leafmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    from leafmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of citations and chunks with at least 100 consecutive characters in common."""
    from leafmill.llm.spans import shared_pairs

    return shared_pairs(table(spark, sf_dir, "citations"), table(spark, sf_dir, "hits"))


@query
def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each citation and chunk stands elsewhere too."""
    from leafmill.llm.spans import shared_shares

    return shared_shares(table(spark, sf_dir, "citations"), table(spark, sf_dir, "hits"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that show damage of a scanned page."""
    from leafmill.llm.scans import damaged

    return damaged(table(spark, sf_dir, "atomic_elements")).select("id")


@query
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged elements as continuous readable paragraphs."""
    from leafmill.llm.scans import repaired

    return repaired(table(spark, sf_dir, "atomic_elements"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that stop before their end."""
    from leafmill.llm.truncation import judged

    return judged(table(spark, sf_dir, "atomic_elements")).where("truncated").select("id")


@query
def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut elements per source."""
    from leafmill.llm.truncation import by_source

    return by_source(table(spark, sf_dir, "atomic_elements"), table(spark, sf_dir, "corpus"))
