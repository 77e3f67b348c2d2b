"""Queries of context building and citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import answers as A
from leafmill.plans.base import core, sql_norm, sql_strip
from leafmill.plans.search import DOCS, question_docs
from leafmill.runtime import table


@core(f"WITH {DOCS} SELECT query_id, string_agg(chr(10) || '[' || (rank - 1) || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) AS context FROM docs GROUP BY query_id")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.build_context(question_docs(spark, sf_dir).select("query_id", "rank", "text"))


_STORED = "k AS (SELECT DISTINCT img_id FROM citations WHERE img_id IS NOT NULL)"


@core(f"WITH {DOCS}, {_STORED}, a AS (SELECT query_id, rank, (generate_subscripts(images, 1) - 1)::INT AS pos, unnest(images) AS img_id FROM docs), m AS (SELECT a.*, k.img_id IS NOT NULL AS found FROM a LEFT JOIN k USING (img_id)), u AS (SELECT *, coalesce(sum(found::INT) OVER (PARTITION BY query_id ORDER BY rank, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m) SELECT query_id, rank, pos, img_id, found FROM u WHERE used < 3")
def image_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images shown with each question's chunks; those that answers cite stand in for the image store."""
    return A.image_quota(question_docs(spark, sf_dir), table(spark, sf_dir, "citations").select("img_id"))


#: Images that answers cite stand in for the image store.
_IMG = "st AS (SELECT DISTINCT img_id, 'data:image/png;base64,' || md5(img_id) AS base64 FROM citations WHERE img_id IS NOT NULL)"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "citations").where("img_id is not null").select("img_id", F.concat(F.lit("data:image/png;base64,"), F.md5(F.col("img_id").cast("binary"))).alias("base64")).distinct()


@core(f"WITH {DOCS}, {_IMG} SELECT img_id, base64 FROM st WHERE img_id IN (SELECT unnest(images) FROM docs)")
def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored images of all retrieved chunks."""
    return A.image_lookup(question_docs(spark, sf_dir).select(F.explode("images").alias("img_id")), _store(spark, sf_dir))


@core(f"""WITH {DOCS}, {_IMG}, a AS (SELECT query_id, rank, (generate_subscripts(images, 1) - 1)::INT AS pos, unnest(images) AS img_id FROM docs), m AS (SELECT a.*, st.base64 FROM a LEFT JOIN st USING (img_id)),
 u AS (SELECT *, coalesce(sum((base64 IS NOT NULL)::INT) OVER (PARTITION BY query_id ORDER BY rank, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m), q AS (SELECT query_id, max(question) AS question FROM questions WHERE query_id IS NOT NULL GROUP BY query_id),
 p AS (SELECT query_id, -1 AS rank, 0 AS level, 0 AS pos, 0 AS turn, 'input_text' AS type, '### CONTEXT DOCUMENTS' || chr(10) AS text, NULL::VARCHAR AS image_url FROM q
  UNION ALL SELECT query_id, rank, 0, 0, 0, 'input_text', chr(10) || '[' || (rank - 1) || ']' || chr(10) || coalesce(text, '') || chr(10), NULL FROM docs
  UNION ALL SELECT query_id, rank, 1, pos, 0, 'input_text', chr(10) || chr(10) || 'Image: ' || img_id, NULL FROM u WHERE used < 3
  UNION ALL SELECT query_id, rank, 1, pos, 1, 'input_image', NULL, base64 FROM u WHERE used < 3 AND base64 IS NOT NULL
  UNION ALL SELECT query_id, 2147483647, 0, 0, 0, 'input_text', '### USER QUESTION' || chr(10) || coalesce(question, '') || chr(10) || '### ANSWER', NULL FROM q)
 SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank, level, pos, turn) - 1)::INT AS n, type, text, image_url FROM p""")
def content_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a model is given for each question: header, chunks, images, question."""
    return A.content_inputs(question_docs(spark, sf_dir), table(spark, sf_dir, "questions"), _store(spark, sf_dir))


@core("SELECT query_id AS conv_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn DESC) AS n FROM (SELECT DISTINCT query_id, seg_no * 100 + cite_no AS turn, role, segment AS content FROM citations)) WHERE n <= 10")
def trim_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten citations of each question as turns of a conversation."""
    turns = table(spark, sf_dir, "citations").select(F.col("query_id").alias("conv_id"), (F.col("seg_no") * 100 + F.col("cite_no")).alias("turn"), "role", F.col("segment").alias("content")).distinct()
    return A.trim_messages(turns)


_PARTS = f"""c AS (SELECT citation_id, query_id, content FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY answered_at DESC NULLS LAST, query_id DESC, content DESC) AS n FROM citations WHERE content IS NOT NULL AND citation_id IS NOT NULL) WHERE n = 1),
 s AS (SELECT citation_id, query_id, list_filter(list_transform(string_split(content, '...'), lambda p: {sql_strip('p')}), lambda p: p <> '') AS ps FROM c),
 p AS (SELECT citation_id, query_id, (generate_subscripts(ps, 1) - 1)::INT AS part_no, {sql_norm('unnest(ps)')} AS part FROM s)"""
_EXACT = f"{_PARTS}, {DOCS}, dn AS (SELECT query_id, rank, doc_id, {sql_norm('text')} AS norm FROM docs), x AS (SELECT p.citation_id, p.query_id, p.part_no, p.part, min_by(doc_id, rank) AS doc_id FROM p LEFT JOIN dn ON p.query_id = dn.query_id AND contains(norm, part) GROUP BY ALL)"


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cite_exact(A.citation_parts(table(spark, sf_dir, "citations")), question_docs(spark, sf_dir))


@core(f"WITH {_PARTS} SELECT citation_id, query_id, part_no, part FROM p")
def citation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.citation_parts(table(spark, sf_dir, "citations"))


@core(f"WITH {_EXACT} SELECT citation_id, query_id, part_no, part, doc_id FROM x")
def cite_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir)


@core()
def cite_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without an exact place that are similar enough to a passage."""
    return A.cite_fuzzy(_exact(spark, sf_dir), question_docs(spark, sf_dir))


_IMAGES = f"{DOCS}, di AS (SELECT query_id, rank, doc_id, unnest(images) AS img_id FROM docs), ci AS (SELECT DISTINCT citation_id, query_id, img_id FROM citations WHERE img_id IS NOT NULL AND citation_id IS NOT NULL), mi AS (SELECT ci.citation_id, ci.img_id, min_by(doc_id, rank) AS doc_id FROM ci LEFT JOIN di USING (query_id, img_id) GROUP BY ALL), gi AS (SELECT citation_id, img_id, CASE WHEN img_id <> 'query_evidence' THEN doc_id END AS doc_id FROM mi WHERE doc_id IS NOT NULL OR img_id = 'query_evidence')"


@core(f"WITH {_IMAGES} SELECT * FROM gi")
def cite_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cite_images(table(spark, sf_dir, "citations"), question_docs(spark, sf_dir))


def _good(spark: SparkSession, sf_dir: str, fuzzy: bool) -> DataFrame:
    """Valid citations: every part of a text has a place, or the image is known."""
    parts = _exact(spark, sf_dir)
    if fuzzy:
        near = A.cite_fuzzy(parts, question_docs(spark, sf_dir)).select(F.col("citation_id").alias("n_id"), F.col("part_no").alias("n_no"), F.col("doc_id").alias("near"))
        parts = parts.join(near, (F.col("citation_id") == F.col("n_id")) & (F.col("part_no") == F.col("n_no")), "left").withColumn("doc_id", F.coalesce("doc_id", "near"))
    whole = parts.groupBy("citation_id").agg(F.every(F.col("doc_id").isNotNull()).alias("ok")).where("ok").select("citation_id")
    return whole.unionByName(A.cite_images(table(spark, sf_dir, "citations"), question_docs(spark, sf_dir)).select("citation_id"))


_JUDGED = """gx AS (SELECT citation_id FROM x GROUP BY citation_id HAVING bool_and(doc_id IS NOT NULL) UNION SELECT citation_id FROM gi),
 v AS (SELECT citation_id, query_id, seg_no, role, type FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY answered_at DESC NULLS LAST, query_id DESC, seg_no DESC, role DESC, type DESC) AS n FROM citations) WHERE n = 1),
 j AS (SELECT query_id, seg_no, min(role) AS role, count(type) AS n_citations, count(gx.citation_id) AS n_valid FROM v LEFT JOIN gx USING (citation_id) GROUP BY query_id, seg_no),
 jj AS (SELECT *, CASE WHEN n_valid > 0 THEN 'cited' WHEN n_citations > 0 THEN 'dropped' WHEN role = 'bullet_intro' THEN 'intro' ELSE 'inferred' END AS verdict FROM j)"""


@core(f"WITH {_EXACT}, {_IMAGES.replace(DOCS + ', ', '')}, {_JUDGED} SELECT * FROM jj")
def validate_segments_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer segments judged by exact places of their citations."""
    return A.validate_segments(table(spark, sf_dir, "citations"), _good(spark, sf_dir, False))


@core()
def validate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer segments judged by exact or similar places of their citations."""
    return A.validate_segments(table(spark, sf_dir, "citations"), _good(spark, sf_dir, True))


_IMAGES_TOO = _IMAGES.replace(DOCS + ", ", "")
_ABSTAIN = "ab AS (SELECT query_id FROM citations GROUP BY query_id HAVING count(DISTINCT seg_no) = 1 AND max(seg_type) = 'abstained')"


@core(f"WITH {_EXACT}, {_IMAGES_TOO}, {_JUDGED}, {_ABSTAIN} SELECT * FROM jj a WHERE query_id IN (FROM ab) OR verdict <> 'dropped' AND EXISTS (SELECT 1 FROM jj b WHERE b.query_id = a.query_id AND b.verdict NOT IN ('dropped', 'intro'))")
def filter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "citations")
    abstained = c.groupBy("query_id").agg(F.countDistinct("seg_no").alias("n"), F.max("seg_type").alias("t")).where("n = 1 and t = 'abstained'")
    return A.filter_segments(A.validate_segments(c, _good(spark, sf_dir, False)), abstained)


@core(f"""WITH {_EXACT}, {_IMAGES_TOO}, cc AS (SELECT citation_id, query_id, seg_no, cite_no FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY answered_at DESC NULLS LAST, query_id DESC, seg_no DESC, cite_no DESC) AS n FROM citations WHERE citation_id IS NOT NULL) WHERE n = 1),
 ev AS (SELECT citation_id, 'texts' AS kind, doc_id, part_no AS no, part AS item FROM x WHERE citation_id NOT IN (SELECT citation_id FROM x WHERE doc_id IS NULL) UNION ALL SELECT citation_id, 'images', doc_id, 0, img_id FROM gi)
 SELECT cc.query_id, cc.seg_no, kind, doc_id, string_agg(item, chr(10) ORDER BY cite_no, ev.citation_id, no, item) AS items FROM ev JOIN cc USING (citation_id) GROUP BY ALL""")
def segment_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer segment cites of each chunk, one item a line."""
    c = table(spark, sf_dir, "citations")
    maps = A.segment_maps(c, _exact(spark, sf_dir), A.cite_images(c, question_docs(spark, sf_dir)))
    return maps.withColumn("items", F.array_join("items", "\n"))


@core("""WITH s AS (SELECT query_id, seg_no, min(role) AS role, min(segment) AS segment FROM citations GROUP BY ALL), t AS (SELECT query_id, seg_no, role, trim(segment) AS t, coalesce(role, '') NOT IN ('paragraph', 'bullet_intro', 'bullet') AS inl FROM s WHERE trim(segment) <> ''),
 p AS (SELECT *, lag(inl) OVER (PARTITION BY query_id ORDER BY seg_no, t) AS before FROM t)
 SELECT query_id, trim(string_agg(CASE WHEN before IS NULL THEN '' WHEN inl AND before THEN ' ' ELSE chr(10) END || CASE role WHEN 'bullet' THEN '- ' || t WHEN 'paragraph' THEN t || chr(10) ELSE t END, '' ORDER BY seg_no, t), chr(10) || ' ') AS text FROM p GROUP BY query_id""")
def render_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer as readable text."""
    s = table(spark, sf_dir, "citations").groupBy("query_id", "seg_no").agg(F.min("role").alias("role"), F.min("segment").alias("segment"))
    return A.render_segments(s)


@core("SELECT query_id, seg_no, CASE WHEN seg_no % 3 = 1 THEN NULL ELSE len(list(citation_id)) END AS n FROM (SELECT DISTINCT query_id, seg_no, cite_no, citation_id FROM citations) GROUP BY query_id, seg_no")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as JSON, every third one broken off, and parsed again; citations counted per segment, null if malformed."""
    c = table(spark, sf_dir, "citations").select("query_id", "seg_no", "cite_no", "citation_id", "role", "segment", "type", "content", "img_id")
    one = c.groupBy("query_id", "seg_no", "cite_no", "citation_id").agg(F.min(F.struct("role", "segment", "type", "content", "img_id")).alias("r"))
    seg = one.groupBy("query_id", "seg_no").agg(F.min("r.role").alias("role"), F.min("r.segment").alias("segment"), F.collect_list(F.struct("r.type", "r.content", "r.img_id")).alias("citations"))
    raw = seg.select("query_id", "seg_no", F.to_json(F.array(F.struct("role", "segment", "citations"))).alias("raw"))
    raw = raw.withColumn("raw", F.when(F.col("seg_no") % 3 == 1, F.expr("left(raw, length(raw) - 4)")).otherwise(F.col("raw")))
    cited = A.parse_json(F.col("raw"))[0]["citations"]
    return raw.select("query_id", "seg_no", F.when(cited.isNotNull(), F.size(cited)).cast("bigint").alias("n"))
