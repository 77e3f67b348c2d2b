"""Queries of the hierarchy operators over toc and atomic_elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import hierarchy as H
from leafmill.plans.base import WS, core, sql_strip
from leafmill.runtime import cut, cut_packed, latest_by_id, table

FIELDS = ["created_at", "atomic_order", "token_count", "doc_id", "type", "heading_type", "description", "content"]
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, atomic_order DESC NULLS LAST, token_count DESC NULLS LAST, doc_id DESC NULLS LAST, type DESC NULLS LAST, heading_type DESC NULLS LAST, description DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM atomic_elements WHERE id IS NOT NULL) WHERE rn = 1"
_SIZE = "CASE WHEN token_count > 0 THEN token_count WHEN trim(coalesce(content, '')) = '' THEN 0 ELSE greatest(1, trunc(length(content) / 3.56)::INT) END"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each element with its size."""
    return _sized(table(spark, sf_dir, "atomic_elements"))


def _sized(elements: DataFrame) -> DataFrame:
    rows = latest_by_id(elements, "id", ["created_at", "atomic_order", "token_count"], FIELDS)
    size = F.when(F.col("token_count") > 0, F.col("token_count")).when(F.trim(F.coalesce("content", F.lit(""))) == "", 0).otherwise(X.token_count(F.col("content")))
    return rows.withColumn("size", size)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(H.toc_to_tree(table(spark, sf_dir, "toc")))


def opened(rows: DataFrame, heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with ``pre``, the entry open at their place; ``heads`` (doc_id, atomic_order, title) are the main headings."""
    found = H.assign_nodes(heads, nodes.select("doc_id", "pre", "title"))
    found = found.groupBy(F.col("doc_id").alias("o_doc"), F.col("atomic_order").alias("o_at")).agg(F.max("pre").alias("opens"))  # headings at one place open the last
    opening = rows.join(found, (F.col("doc_id") == F.col("o_doc")) & (F.col("atomic_order") == F.col("o_at")) & (F.col("heading_type") == "main"), "left").drop("o_doc", "o_at")
    return H.running_last(opening, "doc_id", "atomic_order", "opens", "open").withColumn("pre", F.coalesce("open", F.lit(-1))).drop("opens", "open")


def places(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """(id, doc_id, atomic_order, size, begins, pre): as ``placed``, but no text is moved or kept except headings and texts without a count.

    Rows that tie up to their content have the same type and count, so all of them or none bring it along.
    """
    asked = (F.col("type") == "section_header") | ~F.coalesce(F.col("token_count") > 0, F.lit(False))
    rows = _sized(table(spark, sf_dir, "atomic_elements").withColumn("content", F.when(asked, F.col("content")))).where("doc_id is not null")
    head = F.col("type") == "section_header"
    small = cut_packed(rows.select("id", "doc_id", F.coalesce("atomic_order", F.lit(0)).alias("atomic_order"), "size", "heading_type", head.alias("head"), F.when(head & (F.col("heading_type") == "main"), F.col("content")).alias("title")))
    heads = small.where("head and heading_type = 'main'").select("doc_id", "atomic_order", "title")
    begins = F.coalesce(F.col("head") & (F.col("heading_type") == "nottoc"), F.lit(False)).alias("begins")
    return cut_packed(opened(small.select("id", "doc_id", "atomic_order", "size", "heading_type", begins), heads, nodes).drop("heading_type"))


def placed(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """Elements with the open entry of their document; those before the first heading, or without entries, lie in -1."""
    rows = cut(latest(spark, sf_dir).where("doc_id is not null").withColumn("atomic_order", F.coalesce("atomic_order", F.lit(0))))
    heads = rows.where("type = 'section_header' and heading_type = 'main'").select("doc_id", "atomic_order", F.col("content").alias("title"))
    return cut(opened(rows, heads, nodes or tree(spark, sf_dir)))


TREE = """n AS (SELECT doc_id, toc_order AS pre, level, coalesce(title, '') AS title, page FROM toc),
t AS (SELECT n.*, (SELECT max(p.pre) FROM n p WHERE p.doc_id = n.doc_id AND p.pre < n.pre AND p.level < n.level) AS parent,
  coalesce((SELECT min(p.pre) - 1 FROM n p WHERE p.doc_id = n.doc_id AND p.pre > n.pre AND p.level <= n.level), (SELECT max(p.pre) FROM n p WHERE p.doc_id = n.doc_id)) AS post FROM n)"""


@core(f"WITH {TREE} SELECT doc_id, pre, post, level, parent, title, page FROM t")
def toc_to_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).select("doc_id", "pre", "post", "level", "parent", "title", "page")


@core(f"WITH {TREE} SELECT d.doc_id, d.pre, string_agg(a.title, ' > ' ORDER BY a.pre) AS path FROM t d JOIN t a ON a.doc_id = d.doc_id AND d.pre BETWEEN a.pre AND a.post GROUP BY ALL")
def level_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).select("doc_id", "pre", "path")


@core(f"WITH l AS ({LATEST}) SELECT id, doc_id, atomic_order, last_value(CASE WHEN type = 'section_header' AND heading_type = 'main' THEN atomic_order END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY coalesce(atomic_order, 0) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l")
def open_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the place of the last main heading at or before each element."""
    rows = latest(spark, sf_dir).select("id", "doc_id", "atomic_order", F.coalesce("atomic_order", F.lit(0)).alias("o"), F.when((F.col("type") == "section_header") & (F.col("heading_type") == "main"), F.col("atomic_order")).alias("h"))
    return H.running_last(rows, "doc_id", "o", "h", "heading").select("id", "doc_id", "atomic_order", "heading")


def bare(x: str) -> str:
    """Titles in the form in which they are compared."""
    return rf"coalesce(regexp_replace(regexp_replace(regexp_replace(lower({sql_strip(x)}), '^\d+(\.\d+)*\.?{WS}*', ''), '[.,]', '', 'g'), '{WS}+', '', 'g'), '')"


#: Similar titles by their longest common subsequence, a bit per character of the heading; the fold takes entries in order.
PLACED = f"""l AS (SELECT * REPLACE (coalesce(atomic_order, 0) AS atomic_order), {_SIZE} AS size FROM ({LATEST}) WHERE doc_id IS NOT NULL),
 hd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY atomic_order, t) AS k FROM (SELECT doc_id, atomic_order, {bare('content')} AS t FROM l WHERE type = 'section_header' AND heading_type = 'main')),
 en AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre, t) AS i FROM (SELECT doc_id, pre, {bare('title')} AS t FROM n) WHERE t <> 'cover'),
 he AS (SELECT h.doc_id, h.k, h.atomic_order, en.i, h.t = en.t AS same, h.t AS a, en.t AS b FROM hd h JOIN en USING (doc_id) WHERE h.t = en.t OR 2.0 * least(length(h.t), length(en.t)) >= 0.9 * (length(h.t) + length(en.t))),
 lc AS (SELECT *, list_reduce(list_prepend((1::HUGEINT << length(a)) - 1, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(length(a)), lambda p: CASE WHEN substring(a, p + 1, 1) = c THEN 1::HUGEINT << p::INT ELSE 0::HUGEINT END))::HUGEINT)),
   lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::HUGEINT << length(a)) - 1)) AS r FROM he WHERE NOT same AND length(a) BETWEEN 1 AND 120 AND b <> ''),
 cl AS (SELECT doc_id, k, i, true AS same FROM he WHERE same UNION ALL SELECT doc_id, k, i, false FROM lc WHERE 200.0 * (length(a) - bit_count(r)) / (length(a) + length(b)) >= 90),
 op AS (SELECT hd.doc_id, hd.k, hd.atomic_order, coalesce(list(i ORDER BY i) FILTER (same), []) AS eq, coalesce(list(i ORDER BY i) FILTER (i IS NOT NULL), []) AS near FROM hd LEFT JOIN cl USING (doc_id, k) GROUP BY ALL),
 fo AS (SELECT doc_id, list_reduce(list_prepend({{'nxt': 1::BIGINT, 'out': []::BIGINT[], 'eq': []::BIGINT[], 'near': []::BIGINT[]}}, list({{'nxt': 1::BIGINT, 'out': []::BIGINT[], 'eq': eq, 'near': near}} ORDER BY k)),
   lambda s, x: {{'nxt': coalesce(CASE WHEN list_contains(x.near, s.nxt) THEN s.nxt ELSE coalesce(list_min(list_filter(x.eq, lambda i: i >= s.nxt)), list_min(list_filter(x.near, lambda i: i >= s.nxt))) END + 1, s.nxt),
     'out': list_append(s.out, CASE WHEN list_contains(x.near, s.nxt) THEN s.nxt ELSE coalesce(list_min(list_filter(x.eq, lambda i: i >= s.nxt)), list_min(list_filter(x.near, lambda i: i >= s.nxt))) END), 'eq': x.eq, 'near': x.near}}).out AS hits FROM op GROUP BY doc_id),
 hi AS (SELECT doc_id, generate_subscripts(hits, 1) AS k, unnest(hits) AS i FROM fo), ho AS (SELECT hd.doc_id, hd.atomic_order, max(en.pre) AS opens FROM hi JOIN hd USING (doc_id, k) JOIN en ON en.doc_id = hi.doc_id AND en.i = hi.i GROUP BY ALL),
 pl AS (SELECT l.*, coalesce(last_value(CASE WHEN heading_type = 'main' THEN opens END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.atomic_order RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::INT AS pre FROM l LEFT JOIN ho ON l.doc_id = ho.doc_id AND l.atomic_order = ho.atomic_order AND l.heading_type = 'main')"""
TOTALS = "ow AS (SELECT doc_id, pre, sum(size)::BIGINT AS own FROM pl GROUP BY ALL), tt AS (SELECT t.doc_id, t.pre, t.post, t.parent, coalesce(any_value(s.own), 0)::BIGINT AS own_tokens, coalesce(sum(o.own), 0)::BIGINT AS token_count FROM t LEFT JOIN ow s ON s.doc_id = t.doc_id AND s.pre = t.pre LEFT JOIN ow o ON o.doc_id = t.doc_id AND o.pre BETWEEN t.pre AND t.post GROUP BY ALL)"


@core(f"WITH {TREE}, {PLACED} SELECT id, doc_id, atomic_order, pre FROM pl")
def assign_open_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entry of its document's table of contents every element lies in."""
    return placed(spark, sf_dir).select("id", "doc_id", "atomic_order", "pre")


def _totals(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    return H.subtree_tokens(nodes, placed(spark, sf_dir, nodes).groupBy("doc_id", "pre").agg(F.sum("size").alias("own_tokens")))


@core(f"WITH {TREE}, {PLACED}, {TOTALS} SELECT doc_id, pre, token_count FROM tt")
def subtree_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of the elements' tokens over the subtrees."""
    return _totals(spark, sf_dir, tree(spark, sf_dir)).select("doc_id", "pre", "token_count")


@core(f"WITH {TREE}, {PLACED}, {TOTALS} SELECT a.doc_id, a.pre FROM tt a WHERE token_count > 0 AND (token_count <= 600 OR NOT EXISTS (SELECT 1 FROM tt c WHERE c.doc_id = a.doc_id AND c.parent = a.pre)) AND NOT EXISTS (SELECT 1 FROM tt b WHERE b.doc_id = a.doc_id AND b.pre < a.pre AND a.pre <= b.post AND b.token_count <= 600)")
def choose_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries at which the way down stops, for the elements' tokens and a chunk's greatest size."""
    t = tree(spark, sf_dir)
    return H.choose_cut(t, _totals(spark, sf_dir, t), inner_text=False).select("doc_id", "pre")


@core(f"WITH {TREE}, {PLACED} SELECT t.doc_id, t.pre, pl.id FROM t JOIN pl ON pl.doc_id = t.doc_id AND pl.pre BETWEEN t.pre AND t.post")
def subtree_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element under every entry whose subtree holds it."""
    nodes = tree(spark, sf_dir)
    return H.subtree_units(nodes, placed(spark, sf_dir, nodes).where("pre >= 0").select("doc_id", "pre", "id"))


@core(f"WITH {TREE}, {PLACED}, {TOTALS} SELECT doc_id, pre, own_tokens, token_count FROM tt")
def node_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own tokens of every entry and those of its subtree."""
    return _totals(spark, sf_dir, tree(spark, sf_dir))


@core(f"WITH l AS ({LATEST}) SELECT id, doc_id, atomic_order, type, {_SIZE} AS size FROM l")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element store after all writes: the last write of an id wins."""
    return latest(spark, sf_dir).select("id", "doc_id", "atomic_order", "type", F.col("size").cast("int").alias("size"))


@core(f"WITH l AS ({LATEST}) SELECT id, doc_id, atomic_order, sum(CASE WHEN type = 'section_header' AND heading_type = 'nottoc' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY coalesce(atomic_order, 0), id)::BIGINT AS block FROM l WHERE doc_id IS NOT NULL")
def split_by_nottoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a document's elements, a new one at each heading that is not in the table of contents."""
    from leafmill.operators.chunking import block_numbers

    return block_numbers(latest(spark, sf_dir).where("doc_id is not null"), ["doc_id"]).select("id", "doc_id", "atomic_order", "block")
