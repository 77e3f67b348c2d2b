"""Tables of contents as trees: preorder intervals, ancestors, roll-ups and cuts, without recursion.

A table of contents lists its entries in preorder, so a node's subtree is a run of entries. Parents and ancestors come from
running "last entry of level l" columns, one per level that occurs (levels are few; more than ``MAX_LEVELS`` different ones are an
error, not clipped); ends of subtrees from the same reading backwards. Everything is keyed by document.
"""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.folds import in_groups

MAX_LEVELS = 64


def toc_to_tree(toc: DataFrame) -> DataFrame:
    """(doc_id, pre, post, level, parent, title, page, path): each entry with its interval, parent and titles from the root.

    Rows with a null document, order or level are left out; levels may be any numbers; repeated keys collapse.
    """
    rows = toc.where("doc_id is not null and toc_order is not null and level is not null")
    levels = [r[0] for r in rows.select("level").distinct().orderBy("level").limit(MAX_LEVELS + 1).collect()]
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} different levels")
    rows = rows.groupBy("doc_id", F.col("toc_order").alias("pre")).agg(F.max(F.struct("level", "title", "page")).alias("r"))
    rows = rows.select("doc_id", "pre", F.col("r.level").alias("level"), F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.page").alias("page"))
    before = W.partitionBy("doc_id").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("doc_id").orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, -1)
    at = lambda k: F.when(F.col("level") == k, F.struct("pre", "title"))
    last = [F.last(at(v), ignorenulls=True).over(before).alias(f"b{k}") for k, v in enumerate(levels)]
    first = [F.last(F.when(F.col("level") == v, F.col("pre")), ignorenulls=True).over(after).alias(f"a{k}") for k, v in enumerate(levels)]
    wide = rows.select("*", *last, *first, F.max("pre").over(W.partitionBy("doc_id")).alias("last_pre"))
    # an earlier entry of a lower level is an ancestor unless one of a still lower level came after it
    none = F.lit(None).cast("struct<level:int,pre:int,title:string>")
    chain = F.array(none, *[F.when((F.col("level") > v) & F.col(f"b{k}").isNotNull(), F.struct(F.lit(v).alias("level"), F.col(f"b{k}.pre").alias("pre"), F.col(f"b{k}.title").alias("title"))) for k, v in enumerate(levels)])
    chain = F.filter(chain, lambda x: x.isNotNull())
    up = F.filter(chain, lambda x: ~F.exists(chain, lambda y: (y["level"] < x["level"]) & (y["pre"] > x["pre"])))
    end = F.array_min(F.array(F.lit(None).cast("int"), *[F.when(F.col("level") >= v, F.col(f"a{k}")) for k, v in enumerate(levels)]))
    tree = wide.withColumn("up", up).withColumn("end", end)
    return tree.select("doc_id", "pre", F.coalesce(F.col("end") - 1, "last_pre").alias("post"), "level", F.when(F.size("up") > 0, F.element_at("up", -1)["pre"]).alias("parent"), F.transform("up", lambda x: x["pre"]).alias("ancestors"), "title", "page", F.array_join(F.concat(F.transform("up", lambda x: x["title"]), F.array("title")), " > ").alias("path"))


def match_ratio(a: str, b: str) -> float:
    """Similarity of two strings from 0 to 100: twice the longest common subsequence over the summed lengths."""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u) | (row - u)
    common = bin(~row & ((1 << len(a)) - 1)).count("1")
    return 200.0 * common / (len(a) + len(b))


def assign_nodes(headings: DataFrame, nodes: DataFrame, threshold: int = 90, strict: bool = False) -> DataFrame:
    """(doc_id, atomic_order, pre): which heading opens which entry, in order.

    ``headings`` has (doc_id, atomic_order, title[, page]), ``nodes`` (doc_id, pre, title[, page]). The next expected entry is
    the only one a heading may open; with ``strict`` an entry that never appears stalls all after it, otherwise a
    heading may also open a later entry, the first equal one or else the first similar one, which passes over those
    between. Entries for the cover are passed over. Pages must agree where both are known. Only headings and entries take part in this fold, one document at a time.
    """
    page = lambda df: F.col("page").cast("int") if "page" in df.columns else F.lit(None).cast("int")
    left = headings.select("doc_id", F.lit(0).alias("kind"), F.col("atomic_order").cast("int").alias("pos"), X.normalize_title(F.col("title")).alias("t"), page(headings).alias("page"))
    right = nodes.select("doc_id", F.lit(1).alias("kind"), F.col("pre").cast("int").alias("pos"), X.normalize_title(F.col("title")).alias("t"), page(nodes).alias("page"))

    def fold(rows: list[dict]) -> list[tuple]:
        heads, want = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        exact: dict[str, list[int]] = {}
        for k, w in enumerate(want):
            exact.setdefault(w["t"], []).append(k)
        out, nxt = [], 0
        for h in heads:
            if nxt >= len(want):
                break
            fits = lambda k, p=h["page"]: p is None or want[k]["page"] is None or p == want[k]["page"]
            hit = nxt if fits(nxt) and match_ratio(h["t"], want[nxt]["t"]) >= threshold else None
            if hit is None and not strict:
                hit = next((k for k in exact.get(h["t"], ()) if k >= nxt and fits(k)), None)
                if hit is None:  # lengths that differ too much cannot be similar enough
                    n = len(h["t"])
                    hit = next((k for k in range(nxt, len(want)) if 200 * min(n, len(want[k]["t"])) >= threshold * (n + len(want[k]["t"])) and fits(k) and match_ratio(h["t"], want[k]["t"]) >= threshold), None)
            if hit is not None:
                out.append((h["doc_id"], h["pos"], want[hit]["pos"]))
                nxt = hit + 1
        return out

    rows = left.unionByName(right.where("t <> 'cover'")).where("doc_id is not null and pos is not null")
    return in_groups(rows, ["doc_id"], ["kind", "pos", "t"], fold, "doc_id string, atomic_order int, pre int")


def running_last(df: DataFrame, group: str, order: str, value: str, out: str, stretch: int = 4096) -> DataFrame:
    """The last non-null ``value`` at or before each row's place in its group, carried over stretches of places.

    A window never spans more than a stretch, and one row per stretch carries the value on, so a group may be of any size.
    """
    s = F.floor(F.coalesce(F.col(order), F.lit(0)) / stretch)
    rows = df.withColumn("_s", s)
    inside = W.partitionBy(group, "_s").orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    ends = rows.groupBy(group, "_s").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_e"))
    across = W.partitionBy(group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col(group).alias("_g"), F.col("_s").alias("_t"), F.last(f"_e.{value}", ignorenulls=True).over(across).alias("_before"))
    joined = rows.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")), "left")
    return joined.select(*df.columns, F.coalesce("_in", "_before").alias(out))


def last_before(df: DataFrame, group: str, value: str, out: str, stretch: int = 4096) -> DataFrame:
    """The last non-null ``value`` strictly before each row in the order of (o, id), carried over stretches of places as above."""
    rows = df.withColumn("_s", F.floor(F.col("o") / stretch))
    inside = W.partitionBy(group, "_s").orderBy("o", "id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    ends = rows.groupBy(group, "_s").agg(F.max(F.when(F.col(value).isNotNull(), F.struct("o", "id", value))).alias("_e"))
    across = W.partitionBy(group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col(group).alias("_g"), F.col("_s").alias("_t"), F.last(f"_e.{value}", ignorenulls=True).over(across).alias("_before"))
    joined = rows.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")), "left")
    return joined.select(*df.columns, F.coalesce("_in", "_before").alias(out))


def subtree_tokens(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, pre, own_tokens, token_count): each node's tokens and those of its subtree, as a difference of running sums."""
    rows = nodes.join(own, ["doc_id", "pre"], "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("upto", F.sum("own_tokens").over(W.partitionBy("doc_id").orderBy("pre")))
    ends = rows.select(F.col("doc_id").alias("e_doc"), F.col("pre").alias("e_pre"), F.col("upto").alias("e_upto"))
    # a subtree ends at the greatest entry not after ``post``, which is an entry since orders may have gaps only between entries
    tops = rows.select("doc_id", F.explode(F.concat("ancestors", F.array("pre"))).alias("top"), F.col("pre").alias("p")).groupBy("doc_id", "top").agg(F.max("p").alias("last_in"))
    out = rows.join(tops.withColumnRenamed("doc_id", "t_doc"), (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") == F.col("top"))).join(ends, (F.col("doc_id") == F.col("e_doc")) & (F.col("last_in") == F.col("e_pre")))
    return out.select("doc_id", "pre", "own_tokens", (F.col("e_upto") - F.col("upto") + F.col("own_tokens")).alias("token_count"))


def subtree_units(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, pre, id): every unit under every node that has it in its subtree; a node has an ancestor per level at most."""
    above = nodes.select("doc_id", F.col("pre").alias("at"), F.explode(F.concat("ancestors", F.array("pre"))).alias("top"))
    return units.select("doc_id", F.col("pre").alias("at"), "id").join(above, ["doc_id", "at"]).select("doc_id", F.col("top").alias("pre"), "id").distinct()


def choose_cut(nodes: DataFrame, totals: DataFrame, most: int = 600, inner_text: bool = True) -> DataFrame:
    """(doc_id, pre, whole): where chunking stops on the way down.

    A node is emitted if its subtree fits ``most`` tokens or it is a leaf, and no proper ancestor fits. With ``inner_text`` an
    inner node that does not fit also emits its own units (``whole`` false). Empty nodes are never emitted.
    """
    n = nodes.join(totals, ["doc_id", "pre"])
    fits = n.where(F.col("token_count") <= most).select(F.col("doc_id").alias("f_doc"), F.col("pre").alias("f_pre"))
    asked = n.select("doc_id", "pre", F.explode("ancestors").alias("anc"))
    under = asked.join(fits, (F.col("doc_id") == F.col("f_doc")) & (F.col("anc") == F.col("f_pre")), "left_semi").select("doc_id", "pre").distinct()
    parents = n.where("parent is not null").select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("inner", F.lit(True))
    free = n.where("token_count > 0").join(under, ["doc_id", "pre"], "left_anti").join(parents, ["doc_id", "pre"], "left")
    whole = (F.col("token_count") <= most) | F.col("inner").isNull()
    out = free.select("doc_id", "pre", whole.alias("whole"), "own_tokens")
    return out.where("whole" if not inner_text else "whole or own_tokens > 0").select("doc_id", "pre", "whole")
