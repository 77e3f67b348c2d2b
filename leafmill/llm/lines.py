"""Lines repeated across one source's documents, found as blocks of a suffix array over line identifiers.

Every line that holds a letter becomes an identifier of its normal form (lower case, trimmed, single spaces, digit runs
alike). Per source the identifiers of all elements, concatenated and with a break after each element, form the text of
a suffix array. A suffix can share a prefix with suffixes of ``min_docs`` documents only if its first line does, so suffixes
that start at any other line are left out before anything is sorted; this changes no interval that matters.

The array is built by range partitioning: suffixes are sorted by (source, identifiers) over all tasks, whatever a source's
share, each is compared with its neighbour, the first of a task with the last of the task before, and the length of
their common prefix is kept. An interval of depth d is a stretch of the array in which no common prefix is shorter than d;
its number is the count of shorter ones up to there. The documents of each interval are counted after a map-side
distinct. Intervals that span ``min_docs`` documents are blocks, and two rules say what goes:

* a block of at least two lines with ``letters`` letters together, the longest that starts at a place. Its lines may each be
  too short to say anything by themselves;
* a single line of ``letters`` letters (``excessive`` with ``single=True`` gives these alone, which is what p4_found asks for).

A block is followed for ``DEPTH`` lines; a longer one is covered by overlapping blocks, so nothing is lost by that.

Defined results: null contents hold no line; a null id, doc_id or a document without a source is never a case; repeated rows
count once; empty tables give no rows; long texts are read whole; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.runtime import cut, merged

TYPES = ("text", "list_item", "footnote", "caption")
DEPTH = 6


def normal_line(line: Column) -> Column:
    """The form in which lines are compared."""
    spaced = F.regexp_replace(line, r"(?U)[\s&&[^ ]]\s*| \s+", " ")
    return F.trim(F.regexp_replace(F.lower(spaced), r"(?U)\d+", "0"))


def sources(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("doc_id").alias("s_doc"), "source").where("s_doc is not null and source is not null").distinct()


def _lines(elements: DataFrame, letters: int, single: bool) -> DataFrame:
    """(id, doc_id, pos, line_id, n_letters) of the lines that can lie in a block; a line alone in its element must be long enough."""
    rows = elements.where(F.col("type").isin(*TYPES) & F.col("content").isNotNull() & F.col("id").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(F.length("content") >= letters)
    short = F.lit(False) if single else F.col("content").contains("\n")

    def ident(line: Column) -> Column:
        form = normal_line(line)
        n = F.length(F.regexp_replace(form, r"[^\p{L}]", ""))
        return F.when(short | (F.length(line) >= letters), F.struct(F.when(short | (n >= letters), F.xxhash64(form)).alias("line_id"), n.alias("n_letters")))

    found = rows.select("id", "doc_id", F.posexplode(F.transform(F.split("content", "\n"), ident)).alias("pos", "x"))
    return found.select("id", "doc_id", "pos", "x.line_id", "x.n_letters").where("n_letters > 0 and line_id is not null")


def suffix_array(elements: DataFrame, corpus: DataFrame, min_docs: int = 5, letters: int = 30, single: bool = False) -> DataFrame:
    """(source, doc_id, id, pos, key, n_letters, lcp, pid, at): the sorted suffixes with the common prefix of each and its neighbour before.

    With ``single`` only lines of ``letters`` letters are identifiers, and all else breaks the text.
    """
    lines = cut(_lines(elements, letters, single))
    src = sources(corpus)
    # lines of few documents go before their documents' sources are looked up
    held = lines.select("doc_id", "line_id").distinct().groupBy("line_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(F.col("line_id").alias("h_line"))
    kept = merged(lines, held, F.col("line_id") == F.col("h_line"), "left_semi").distinct()
    kept = cut(merged(kept, src, F.col("doc_id") == F.col("s_doc")).drop("s_doc"))
    often = kept.select("source", "doc_id", "line_id").distinct().groupBy(F.col("source").alias("o_source"), F.col("line_id").alias("o_line")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    kept = merged(kept, often, (F.col("source") == F.col("o_source")) & (F.col("line_id") == F.col("o_line")), "left_semi")
    runs = kept.groupBy("source", "doc_id", "id").agg(F.sort_array(F.collect_set(F.struct("pos", "line_id", "n_letters"))).alias("run"))
    at = runs.select("source", "doc_id", "id", "run", F.posexplode("run").alias("k", "here"))
    follow = F.expr(f"filter(slice(run, k + 1, {DEPTH}), (x, i) -> x.pos = here.pos + i)")
    suffixes = at.select("source", "doc_id", "id", F.col("here.pos").alias("pos"), F.transform(follow, lambda x: x["line_id"]).alias("key"), F.transform(follow, lambda x: x["n_letters"]).alias("n_letters"))
    order = ["source", "key", "doc_id", "id", "pos"]
    placed = cut(suffixes.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    line = W.partitionBy("pid").orderBy(*order)
    array = placed.withColumn("at", F.row_number().over(line)).withColumn("prev", F.lag(F.struct("source", "key")).over(line))
    # the last suffix of the nearest task before that has any: one row per task
    ends = placed.groupBy("pid").agg(F.max(F.struct(*order)).alias("e")).select("pid", F.struct("e.source", "e.key").alias("last"))
    ends = ends.select(F.col("pid").alias("e_pid"), F.lag("last").over(W.orderBy("pid")).alias("last"))
    array = array.join(F.broadcast(ends), F.col("pid") == F.col("e_pid"))  # a row per task
    prev = F.when(F.col("at") == 1, F.col("last")).otherwise(F.col("prev"))
    return array.withColumn("prev", prev).withColumn("lcp", _common_prefix()).drop("prev", "last", "e_pid")


def _common_prefix() -> Column:
    """Lines that a suffix and its neighbour have in common from their beginnings; none over the border of a source."""
    same = F.zip_with("key", "prev.key", lambda a, b: F.coalesce(a == b, F.lit(False)))
    off = F.array_position(same, F.lit(False))
    n = F.when(off > 0, off - 1).otherwise(F.size(same))
    return F.when(F.col("prev").isNull() | (F.col("prev.source") != F.col("source")), F.lit(0)).otherwise(n).cast("int")


def intervals(array: DataFrame) -> DataFrame:
    """Every suffix with its interval at each depth it reaches: (source, doc_id, id, pos, depth, interval, letters)."""
    inside = W.partitionBy("pid").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    depths = range(1, DEPTH + 1)
    counts = array.select("*", *[F.sum((F.col("lcp") < d).cast("int")).over(inside).alias(f"n{d}") for d in depths])
    sums = array.groupBy("pid").agg(*[F.sum((F.col("lcp") < d).cast("int")).alias(f"m{d}") for d in depths])
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # a row per task
    offs = sums.select(F.col("pid").alias("o_pid"), *[F.coalesce(F.sum(f"m{d}").over(before), F.lit(0)).alias(f"b{d}") for d in depths])
    rows = counts.join(F.broadcast(offs), F.col("pid") == F.col("o_pid"))  # a row per task
    part = lambda d: F.struct(F.lit(d).alias("depth"), (F.col(f"n{d}") + F.col(f"b{d}")).alias("interval"), F.aggregate(F.slice("n_letters", 1, d), F.lit(0), lambda a, x: a + x).alias("letters"))
    each = F.slice(F.array(*[part(d) for d in depths]), 1, F.size("key"))
    return rows.select("source", "doc_id", "id", "pos", F.explode(each).alias("x"), "key").select("source", "doc_id", "id", "pos", "x.*", F.element_at("key", 1).alias("line_id"))


def blocks(reached: DataFrame, min_docs: int = 5) -> DataFrame:
    """Intervals that span ``min_docs`` documents: (source, depth, interval, letters, n_docs, line_id)."""
    docs = reached.groupBy("source", "depth", "interval", "doc_id").agg(F.max("letters").alias("letters"), F.max("line_id").alias("line_id"))
    spans = docs.groupBy("source", "depth", "interval").agg(F.count("*").alias("n_docs"), F.max("letters").alias("letters"), F.max("line_id").alias("line_id"))
    return spans.where(F.col("n_docs") >= min_docs)


def excessive(elements: DataFrame, corpus: DataFrame, min_docs: int = 5, letters: int = 30, single: bool = False) -> DataFrame:
    """Lines to delete, (id, doc_id, source, pos): those that a block spanning many documents covers; with ``single`` blocks are one line."""
    reached = intervals(suffix_array(elements, corpus, min_docs, letters, single))
    if single:
        reached = reached.where("depth = 1")
    reached = cut(reached.where(F.col("letters") >= letters))
    wide = blocks(reached, min_docs).select(F.col("depth").alias("w_depth"), F.col("interval").alias("w_interval"))
    hit = merged(reached, wide, (F.col("depth") == F.col("w_depth")) & (F.col("interval") == F.col("w_interval")), "left_semi")
    if single:
        return hit.select("id", "doc_id", "source", "pos").distinct()
    longest = hit.groupBy("source", "doc_id", "id", "pos").agg(F.max("depth").alias("n"))
    return longest.select("id", "doc_id", "source", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()


def cleaned(elements: DataFrame, corpus: DataFrame, min_docs: int = 5, letters: int = 30) -> DataFrame:
    """Every element, once per id (of unequal rows the greatest), without excessive blocks, and the number of lines that went."""
    drop = excessive(elements, corpus, min_docs, letters).groupBy("id").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("id", "g_id")
    rows = elements.where("id is not null").groupBy("id").agg(F.max(F.struct("doc_id", "type", "content")).alias("r")).select("id", "r.*")
    kept = F.filter(F.split("content", "\n"), lambda line, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    out = merged(rows, drop, F.col("id") == F.col("g_id"), "left")
    return out.select("id", "doc_id", "type", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def lines_report(elements: DataFrame, corpus: DataFrame, min_docs: int = 5, letters: int = 30) -> DataFrame:
    """The excessive lines by source, as one readable form each, with the number of documents that hold them."""
    reached = intervals(suffix_array(elements, corpus, min_docs, letters, True)).where((F.col("depth") == 1) & (F.col("letters") >= letters))
    wide = cut(blocks(reached, min_docs))
    rows = merged(elements.where(F.col("type").isin(*TYPES)).select("doc_id", "content"), sources(corpus), F.col("doc_id") == F.col("s_doc"))
    text = rows.select(F.col("source").alias("t_source"), F.explode(F.split("content", "\n")).alias("line")).select("t_source", normal_line(F.col("line")).alias("form"))
    text = text.where(F.length("form") >= letters).distinct().withColumn("t_id", F.xxhash64("form"))
    out = merged(text, wide, (F.col("source") == F.col("t_source")) & (F.col("line_id") == F.col("t_id")))
    return out.select("source", F.col("form").alias("line"), "n_docs")
