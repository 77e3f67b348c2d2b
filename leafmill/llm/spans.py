"""Long exact spans shared between records, by compaction of a token De Bruijn graph.

A record's tokens are words of up to twelve letters with one following blank, and single characters for everything else, so
that a cut word changes only its own token. An edge is the k-mer of tokens from one token on, with k as large as it
takes to hold ``min_len - 40`` characters: whatever the text, two records with ``min_len`` characters in common share an
edge. Edges of one record only are dropped after a map-side count. A node between two edges does not branch if every
occurrence of the first is followed by the second and every occurrence of the second preceded by the first; joining the
edges' statistics along such nodes compacts repeated nonbranching paths into segments, which every record that enters
runs through from end to end. Only segments are paired between records, not k-mers. Source coordinates then verify:
segments on one diagonal whose places overlap form a span, and its ends are extended over the characters that
stand before and behind the segments.

Texts are never joined to pairs and nothing is broadcast: each record's segments meet its own text once, to take along the
``SLACK`` characters at either end. Records of equal text are one class and take part once; ``linked_classes`` gives pairs
of classes and membership, ``shared_pairs`` expands them. Pairs within a segment or class are formed block against
block, so none is too large for a task.

Defined results: null ids and null texts form no record; a record written repeatedly counts once (unequal texts: the latest,
then the greatest); empty and short texts share nothing; very long texts are worked off whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.runtime import cut, merged

TOKEN = regex.compile(r"[^\W_]{1,12}(?![^\W_]) ?|.", regex.DOTALL)
BLOCK = 1_000
SLACK = 40


def edges_of(text: str, least: int) -> list[tuple[int, int, int]]:
    """(hash, first character, end) of the k-mer from each token on that can hold ``least`` characters."""
    ends = [m.end() for m in TOKEN.finditer(text)]
    starts = [0, *ends[:-1]]
    out, j, n = [], 0, len(ends)
    for a in starts:
        while j < n and ends[j] - a < least:
            j += 1
        if j == n:
            break
        h = xxhash.xxh3_64_intdigest(text[a : ends[j]].encode("utf-8", "surrogatepass"))
        out.append((h - (1 << 64) if h >> 63 else h, a, ends[j]))
    return out


def _edges(least: int, places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges with their neighbours, for the graph, or with their places, for the records; texts are read anew for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5 if places else 4)]
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not (es := edges_of(text, least)):
                    continue
                hs = [e[0] for e in es]
                more = (range(len(es)), [e[1] for e in es], [e[2] for e in es]) if places else ([None, *hs[:-1]], [*hs[1:], None])
                for c, v in zip(cols, ([rid] * len(es), hs, *more), strict=True):
                    c.extend(v)
            kinds = (pa.int64(), pa.int64(), *([pa.int32()] * 3 if places else [pa.int64()] * 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["rid", "h", "k", "c0", "c1"] if places else ["rid", "h", "prv", "nxt"])

    return work


def _flanks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A record's segments one by one, each with the characters that cut tokens at its ends can hide."""
    for b in batches:
        rows = []
        for rid, text, runs in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            rows += [(r["seg"], rid, r["c0"], r["c1"], text[max(0, r["c0"] - SLACK) : r["c0"]], text[r["c1"] : r["c1"] + SLACK]) for r in runs]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["seg", "rid", "c0", "c1", "before", "behind"])


def pairs_within(df: DataFrame, key: str, item: str, left: list[Column], right: list[Column]) -> DataFrame:
    """Every unordered pair of rows with equal ``key`` and different ``item`` once; groups are paired block by block."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = merged(df, sizes, key).withColumn("_nb", F.ceil(F.col("_n") / BLOCK)).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_nb")))
    a = rows.withColumn("_j", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1))).select(F.col(key).alias("ka"), F.col("_b").alias("ia"), F.col("_j").alias("ja"), F.col(item).alias("item_a"), *left)
    b = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b")))).select(F.col(key).alias("kb"), F.col("_i").alias("ib"), F.col("_b").alias("jb"), F.col(item).alias("item_b"), *right)
    same = (F.col("ka") == F.col("kb")) & (F.col("ia") == F.col("ib")) & (F.col("ja") == F.col("jb"))
    return merged(a, b, same & ((F.col("ia") != F.col("ja")) & (F.col("item_a") != F.col("item_b")) | (F.col("ia") == F.col("ja")) & (F.col("item_a") < F.col("item_b")))).drop("ka", "kb", "ia", "ib", "ja", "jb")


def records(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """(rec, text): every citation and every retrieved chunk once."""
    c = citations.select(F.col("citation_id").alias("rec"), F.col("answered_at").cast("timestamp").alias("at"), F.col("content").alias("text"))
    h = hits.select(F.col("doc_id").alias("rec"), F.lit(None).cast("timestamp").alias("at"), "text")
    rows = c.unionByName(h).where("rec is not null and text is not null")
    return rows.groupBy("rec").agg(F.max(F.struct("at", "text")).alias("m")).select("rec", F.col("m.text").alias("text"))


def segments(reps: DataFrame, min_len: int) -> DataFrame:
    """Segment occurrences (seg, rid, c0, c1, before, behind): maximal repeated nonbranching paths, with their places in each record."""
    least = min_len - SLACK
    graph = reps.mapInArrow(_edges(least, False), "rid bigint, h bigint, prv bigint, nxt bigint")
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    stats = graph.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), one("nxt").alias("out1"), one("prv").alias("in1"), F.min("nxt").alias("to"), F.min("prv").alias("of")).where("lo < hi")
    stats = cut(stats.select("h", "out1", "in1", "to", "of"))
    into = stats.where("out1").select(F.col("h").alias("from_h"), F.col("to").alias("to_h"))
    linked = merged(stats, into, stats["in1"] & (stats["h"] == into["to_h"]) & (stats["of"] == into["from_h"]), "left")
    marked = linked.select(F.col("h").alias("s_h"), F.col("from_h").isNull().cast("int").alias("starts"))
    placed = reps.mapInArrow(_edges(least, True), "rid bigint, h bigint, k int, c0 int, c1 int")
    kept = merged(placed, marked, F.col("h") == F.col("s_h"))
    by_record = W.partitionBy("rid").orderBy("k")
    gap = F.when(F.col("k") - F.lag("k").over(by_record) == 1, F.col("starts")).otherwise(1)
    runs = kept.select("rid", "k", "h", "c0", "c1", "starts").withColumn("first", gap).withColumn("run", F.sum("first").over(by_record))
    runs = runs.groupBy("rid", "run").agg(F.min_by("h", "k").alias("seg"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    per_record = runs.groupBy(F.col("rid").alias("r_id")).agg(F.collect_list(F.struct("seg", "c0", "c1")).alias("runs"))  # no more than a text has tokens
    return merged(per_record, reps, F.col("r_id") == F.col("rid")).select("rid", "text", "runs").mapInArrow(_flanks, "seg bigint, rid bigint, c0 int, c1 int, before string, behind string")


def _common(a: Column, b: Column, from_end: bool) -> Column:
    """Length of the common prefix, or suffix, of two strings."""
    n = F.least(F.length(a), F.length(b))
    part = (lambda s, i: F.right(s, i)) if from_end else (lambda s, i: F.left(s, i))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), n), lambda i: part(a, i) == part(b, i))), F.lit(0)))


def shared_spans(reps: DataFrame, min_len: int, exact_ends: bool) -> DataFrame:
    """(rid_a, rid_b, a0, b0, n) spans of classes, rid_a < rid_b; ends are extended where needed, or all of them."""
    segs = cut(segments(reps, min_len))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("c0", "c1", "before", "behind")]
    met = pairs_within(segs, "seg", "rid", side("x"), side("y"))
    turn = F.col("item_a") > F.col("item_b")
    n = F.col("c1_x") - F.col("c0_x")
    ask = F.lit(exact_ends) | (n < min_len)
    more_l = F.when(ask, _common(F.col("before_x"), F.col("before_y"), True)).otherwise(0).alias("more_l")
    more_r = F.when(ask, _common(F.col("behind_x"), F.col("behind_y"), False)).otherwise(0).alias("more_r")
    a0, b0 = F.when(turn, F.col("c0_y")).otherwise(F.col("c0_x")), F.when(turn, F.col("c0_x")).otherwise(F.col("c0_y"))
    met = met.select(F.least("item_a", "item_b").alias("rid_a"), F.greatest("item_a", "item_b").alias("rid_b"), (a0 - b0).alias("diag"), a0.alias("a0"), (a0 + n).alias("a1"), more_l, more_r)
    line = W.partitionBy("rid_a", "rid_b", "diag").orderBy("a0", "a1")
    isle = F.when(F.col("a0") <= F.max("a1").over(line.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    isles = met.withColumn("new", isle).withColumn("isle", F.sum("new").over(line))
    spans = isles.groupBy("rid_a", "rid_b", "diag", "isle").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min_by("more_l", "a0").alias("l"), F.max_by("more_r", "a1").alias("r"))
    at = F.col("a0") - F.col("l")
    out = spans.select("rid_a", "rid_b", at.alias("a0"), (at - F.col("diag")).alias("b0"), (F.col("a1") + F.col("r") - at).alias("n"))
    return out.where(F.col("n") >= min_len)


def classes(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (rec, rid) and class texts (rid, text) with one row per distinct text."""
    marked = cut(recs.withColumn("sha", F.unhex(F.sha2("text", 256))))
    reps = cut(marked.groupBy("sha").agg(F.max("text").alias("text")).withColumn("rid", F.monotonically_increasing_id()))
    ids = reps.select(F.col("sha").alias("r_sha"), "rid")
    return cut(merged(marked.select("rec", "sha"), ids, F.col("sha") == F.col("r_sha")).select("rec", "rid")), reps.select("rid", "text")


def linked_classes(citations: DataFrame, hits: DataFrame, min_len: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The operator's own result, in which copies are not expanded: members (rec, rid), class texts (rid, text) and the pairs
    of different classes (rid_a, rid_b, longest) with a span of at least ``min_len`` characters in common."""
    members, reps = classes(records(citations, hits))
    spans = shared_spans(reps, min_len, False)
    return members, reps, spans.groupBy("rid_a", "rid_b").agg(F.max("n").alias("longest"))


def shared_pairs(citations: DataFrame, hits: DataFrame, min_len: int = 100) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: records with at least ``min_len`` consecutive characters in common, copies expanded."""
    members, reps, pairs = linked_classes(citations, hits, min_len)
    ma, mb = members.select(F.col("rec").alias("x"), F.col("rid").alias("m_a")), members.select(F.col("rec").alias("y"), F.col("rid").alias("m_b"))
    across = merged(merged(pairs.select("rid_a", "rid_b"), ma, F.col("rid_a") == F.col("m_a")), mb, F.col("rid_b") == F.col("m_b")).select("x", "y")
    long = reps.where(F.length("text") >= min_len).select(F.col("rid").alias("l_id"))
    inside = pairs_within(merged(members, long, F.col("rid") == F.col("l_id"), "left_semi"), "rid", "rec", [], []).select(F.col("item_a").alias("x"), F.col("item_b").alias("y"))
    return across.unionByName(inside).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def shared_shares(citations: DataFrame, hits: DataFrame, min_len: int = 100) -> DataFrame:
    """(rec, n_chars, shared_chars, share): how much of each record's text stands elsewhere too in spans of that length."""
    members, reps = classes(records(citations, hits))
    spans = shared_spans(reps, min_len, True)
    ends = F.explode(F.array(F.struct(F.col("rid_a").alias("rid"), F.col("a0").alias("s")), F.struct(F.col("rid_b").alias("rid"), F.col("b0").alias("s"))))
    # of the spans that begin at one place of a record the longest covers the others
    places = spans.select(ends.alias("p"), "n").groupBy("p.rid", "p.s").agg(F.max(F.col("p.s") + F.col("n")).alias("e"))
    line = W.partitionBy("rid").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(line), F.lit(0))))
    covered = places.select(F.col("rid").alias("c_id"), fresh.alias("f")).groupBy("c_id").agg(F.sum("f").alias("f"))
    many = members.groupBy(F.col("rid").alias("m_id")).agg(F.count("*").alias("m"))
    per = merged(merged(reps.select("rid", F.length("text").alias("n")), many, F.col("rid") == F.col("m_id")), covered, F.col("rid") == F.col("c_id"), "left")
    whole = (F.col("m") > 1) & (F.col("n") >= min_len)
    per = per.select(F.col("rid").alias("p_id"), F.col("n").alias("n_chars"), F.when(whole, F.col("n")).otherwise(F.coalesce("f", F.lit(0))).cast("bigint").alias("shared_chars"))
    share = F.round(F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0), 6)
    return merged(members, per, F.col("rid") == F.col("p_id")).select("rec", "n_chars", "shared_chars", share.alias("share"))
