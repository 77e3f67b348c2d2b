"""From retrieved chunks to checked answers: context, image quota, parsing, history, citations, rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Settings
from leafmill.functions import text as X

#: Fixed value: the schema of a generated answer.
SEGMENTS = "array<struct<role:string,segment:string,citations:array<struct<type:string,content:string,img_id:string>>,type:string>>"
EVIDENCE = "query_evidence"


# ---- context --------------------------------------------------------------------------------------------------------------


def image_quota(docs: DataFrame, images: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, rank, pos, img_id, found): images shown to a model, in document order, until the quota of found ones is full.

    An image that is not stored keeps its label and takes nothing from the quota.
    """
    asked = docs.select("query_id", "rank", F.posexplode("images").alias("pos", "img_id"))
    known = images.select(F.col("img_id").alias("k_id")).where("k_id is not null").distinct().withColumn("found", F.lit(True))
    met = asked.join(known, F.col("img_id") == F.col("k_id"), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    before = F.coalesce(F.sum(F.col("found").cast("int")).over(W.partitionBy("query_id").orderBy("rank", "pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("used", before).where(F.col("used") < s.max_images_per_call).select("query_id", "rank", "pos", "img_id", "found")


def image_lookup(asked: DataFrame, store: DataFrame) -> DataFrame:
    """(img_id, base64): the stored images among those asked for, each once; nothing asked gives nothing."""
    ids = asked.select(F.col("img_id").alias("a_id")).where("a_id is not null").distinct()
    found = store.where("img_id is not null").groupBy("img_id").agg(F.min("base64").alias("base64"))
    return found.join(ids, F.col("img_id") == F.col("a_id"), "left_semi")


def content_inputs(docs: DataFrame, questions: DataFrame, store: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, n, type, text, image_url): what a model is given for a question, part by part.

    A header, every chunk (query_id, rank, text, images) under its number, after it the labels of its images and those that are
    stored, as long as the quota over all chunks lasts, and the question (query_id, question). A question without
    chunks still has header and question.
    """
    nothing = F.lit(None).cast("string")
    part = lambda df, rank, pos, kind, text, url=nothing: df.select("query_id", rank.cast("int").alias("rank"), F.lit(pos[0]).alias("level"), pos[1].cast("int").alias("pos"), F.lit(pos[2]).alias("turn"), F.lit(kind).alias("type"), text.alias("text"), url.alias("image_url"))
    zero = F.lit(0)
    at = F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1
    asked = questions.where("query_id is not null").groupBy("query_id").agg(F.max("question").alias("question"))
    shown = image_quota(docs, store, s)
    url = image_lookup(shown.where("found").select("img_id"), store).select(F.col("img_id").alias("u_id"), "base64")
    urls = shown.where("found").join(url, F.col("img_id") == F.col("u_id"))
    rows = part(asked, F.lit(-1), (0, zero, 0), "input_text", F.lit("### CONTEXT DOCUMENTS\n"))
    rows = rows.unionByName(part(docs.withColumn("at", at), F.col("rank"), (0, zero, 0), "input_text", F.concat(F.lit("\n["), F.col("at").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))))
    rows = rows.unionByName(part(shown, F.col("rank"), (1, F.col("pos"), 0), "input_text", F.concat(F.lit("\n\nImage: "), "img_id")))
    rows = rows.unionByName(part(urls, F.col("rank"), (1, F.col("pos"), 1), "input_image", nothing, F.col("base64")))
    rows = rows.unionByName(part(asked, F.lit(2**31 - 1), (0, zero, 0), "input_text", F.concat(F.lit("### USER QUESTION\n"), F.coalesce("question", F.lit("")), F.lit("\n### ANSWER"))))
    n = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "level", "pos", "turn")) - 1
    return rows.withColumn("n", n).select("query_id", "n", "type", "text", "image_url")


def chat_parts(parts: DataFrame) -> DataFrame:
    """The same parts under the names of chat interfaces."""
    return parts.withColumn("type", F.when(F.col("type") == "input_text", "text").when(F.col("type") == "input_image", "image_url").otherwise(F.col("type")))


def build_context(docs: DataFrame) -> DataFrame:
    """(query_id, context): the numbered texts of a question's chunks (query_id, rank, text), joined in rank order."""
    part = F.concat(F.lit("\n["), (F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1).cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return docs.withColumn("part", part).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n").alias("context"))


def trim_messages(messages: DataFrame, keep: int = DEFAULT.history) -> DataFrame:
    """The last ``keep`` turns of each conversation."""
    return messages.withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= keep).drop("_n")


def parse_json(raw: Column) -> Column:
    """Segments of a model's answer, or null if it is malformed."""
    return F.from_json(raw, SEGMENTS)


def two_pass(question: str, context: str, strict: Callable[[str, str], str], evidence: Callable[[str, str], str], repair: Callable[[str], str], parse: Callable[[str], list | None], retries: int = DEFAULT.json_retries) -> tuple[list, int]:
    """Answer segments and the pass that gave them: first strictly from the context; if that yields nothing, from evidence at large.

    A reply that does not parse is given back for repair up to ``retries`` times in each pass. Nothing in either: ([], 0).
    """
    for number, call in ((1, strict), (2, evidence)):
        raw = call(question, context)
        for attempt in range(retries + 1):
            got = parse(raw)
            if got is not None or attempt == retries:
                break
            raw = repair(raw)
        if got:
            return got, number
    return [], 0


def generate(questions: DataFrame, strict: Callable, evidence: Callable, repair: Callable, parse: Callable) -> DataFrame:
    """(query_id, answer, pass): the two passes for every row (query_id, question, context), in Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            got = [two_pass(q or "", c or "", strict, evidence, repair, parse) for q, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(g, ensure_ascii=False) for g, _ in got], pa.string()), pa.array([p for _, p in got], pa.int32())], names=["query_id", "answer", "pass"])

    return questions.select(F.col("query_id").cast("bigint"), "question", "context").mapInArrow(work, "query_id bigint, answer string, pass int")


def described(replies: DataFrame) -> DataFrame:
    """(img_id, description) from a model's replies (raw), JSON lists of such; malformed replies give nothing, of repeated ids the first in order of text holds."""
    rows = replies.select(F.explode(F.from_json("raw", "array<struct<img_id:string,description:string>>")).alias("d")).select("d.img_id", "d.description")
    return rows.where("img_id is not null").groupBy("img_id").agg(F.min("description").alias("description"))


def converse(routed: DataFrame, contexts: DataFrame, small_talk: Callable[[str], str], strict: Callable, evidence: Callable, repair: Callable, parse: Callable, retrieve: str = "need_retrieve") -> DataFrame:
    """(query_id, route, answer, pass): a conversation's turns (query_id, question, route), answered by their route.

    Turns that need retrieval get the two passes over their context (query_id, context); others are small talk, pass 0, or an
    abstention where the model fails. A turn without an answer has an empty list of segments, which renders as nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            out = []
            for q, route, context in zip(b.column("question").to_pylist(), b.column("route").to_pylist(), b.column("context").to_pylist(), strict=True):
                if route == retrieve:
                    out.append(two_pass(q or "", context or "", strict, evidence, repair, parse))
                    continue
                try:
                    out.append(([{"role": "paragraph", "segment": small_talk(q or ""), "type": "conversational"}], 0))
                except Exception:  # whatever a model's client raises
                    out.append(([{"role": "paragraph", "segment": "", "type": "abstained"}], 0))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("route"), pa.array([json.dumps(a, ensure_ascii=False) for a, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], names=["query_id", "route", "answer", "pass"])

    rows = routed.select(F.col("query_id").cast("bigint").alias("query_id"), "question", F.col("route").cast("string").alias("route")).join(contexts.select(F.col("query_id").alias("c_id"), "context"), F.col("query_id") == F.col("c_id"), "left")
    return rows.select("query_id", "question", "route", "context").mapInArrow(work, "query_id bigint, route string, answer string, pass int")


def vanilla(reply: Column, failed: Column) -> Column:
    """One conversational segment, or an abstention where the model failed."""
    return F.array(F.struct(F.lit("paragraph").alias("role"), F.when(failed, F.lit("")).otherwise(reply).alias("segment"), F.when(failed, F.lit("abstained")).otherwise(F.lit("conversational")).alias("type")))


# ---- citations ------------------------------------------------------------------------------------------------------------


def partial_match(needle: str, hay: str) -> tuple[float, int, int]:
    """Best similarity (0 to 100) of ``needle`` with a window of ``hay`` of at most its length, and the window.

    Windows are those aligned with a shared 4-gram, a superset of where the best alignment of similar strings can lie.
    """
    from leafmill.operators.hierarchy import match_ratio

    n = len(needle)
    if not n or not hay:
        return 0.0, 0, 0
    if n > len(hay):
        score, _, _ = partial_match(hay, needle)
        return score, 0, len(hay)
    q = min(4, n)
    where: dict[str, list[int]] = {}
    for k in range(n - q + 1):
        where.setdefault(needle[k : k + q], []).append(k)
    votes: dict[int, int] = {}
    for p in range(len(hay) - q + 1):
        for k in where.get(hay[p : p + q], ()):
            votes[p - k] = votes.get(p - k, 0) + 1
    best = (0.0, 0, 0)
    for at in sorted(votes, key=lambda d: -votes[d])[:32]:
        for a in {max(0, at), min(max(0, at), len(hay) - n)}:
            b = min(len(hay), a + n)
            score = match_ratio(needle, hay[a:b])
            if score > best[0]:
                best = (score, a, b)
    return best


def citation_parts(citations: DataFrame) -> DataFrame:
    """(citation_id, query_id, part_no, part): the parts of text citations between "...", in normal form."""
    t = citations.where("citation_id is not null and content is not null").groupBy("citation_id").agg(F.max(F.struct("answered_at", "query_id", "content")).alias("r"))
    parts = F.filter(F.transform(F.split("r.content", r"\.\.\."), lambda p: X.strip(p)), lambda p: p != "")
    return t.select("citation_id", F.col("r.query_id").alias("query_id"), F.posexplode(F.transform(parts, X.normalize_text)).alias("part_no", "part"))


def cite_exact(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(citation_id, part_no, doc_id): the first chunk of the question, by rank, whose normal form holds the part; null if none."""
    d = docs.select(F.col("query_id").alias("d_q"), "rank", "doc_id", X.normalize_text(F.col("text")).alias("norm"))
    met = parts.join(d, (F.col("query_id") == F.col("d_q")) & F.col("norm").contains(F.col("part")), "left")
    return met.groupBy("citation_id", "query_id", "part_no", "part").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("rank", "doc_id"))).alias("m")).select("citation_id", "query_id", "part_no", "part", F.col("m.doc_id").alias("doc_id"))


def cite_fuzzy(parts: DataFrame, docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(citation_id, part_no, doc_id, score, matched): for parts without an exact place, the most similar window above the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
                score, a, e = partial_match(part, text or "")
                while e < len(text or "") and text[e] not in " _\n\t":
                    e += 1
                while a > 0 and text[a - 1] not in " _\n\t":
                    a -= 1
                scores.append(round(score, 6))
                found.append((text or "")[a:e].strip())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("citation_id", "part_no", "rank", "doc_id")] + [pa.array(scores, pa.float64()), pa.array(found, pa.string())], names=["citation_id", "part_no", "rank", "doc_id", "score", "matched"])

    left = parts.where("doc_id is null").select("citation_id", "part_no", "part", F.col("query_id").alias("p_q"))
    d = docs.select("query_id", "rank", "doc_id", "text")
    pairs = left.join(d, F.col("p_q") == F.col("query_id")).select("citation_id", "part_no", "part", "rank", "doc_id", "text")
    scored = pairs.mapInArrow(work, "citation_id string, part_no int, rank int, doc_id string, score double, matched string")
    best = scored.groupBy("citation_id", "part_no").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "doc_id", "matched")).alias("m"))
    return best.where(F.col("m.score") > s.citation_threshold).select("citation_id", "part_no", "m.doc_id", "m.score", "m.matched")


def cite_images(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """(citation_id, img_id, doc_id): the first chunk, by rank, that has the image; evidence of the question needs none."""
    c = citations.where("citation_id is not null and img_id is not null").select("citation_id", F.col("query_id").alias("c_q"), "img_id").distinct()
    d = docs.select("query_id", "rank", "doc_id", F.explode("images").alias("d_img"))
    met = c.join(d, (F.col("c_q") == F.col("query_id")) & (F.col("img_id") == F.col("d_img")), "left")
    best = met.groupBy("citation_id", "img_id").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("rank", "doc_id"))).alias("m"))
    return best.where(F.col("m").isNotNull() | (F.col("img_id") == EVIDENCE)).select("citation_id", "img_id", F.when(F.col("img_id") != EVIDENCE, F.col("m.doc_id")).alias("doc_id"))


def validate_segments(citations: DataFrame, good: DataFrame) -> DataFrame:
    """(query_id, seg_no, role, n_citations, n_valid, verdict): each answer segment judged by its citations.

    A segment without citations is an introduction (bullet_intro) or inferred; with at least one valid citation it is cited;
    otherwise it is dropped. ``good`` lists valid citation ids.
    """
    c = citations.groupBy("citation_id").agg(F.max(F.struct("answered_at", "query_id", "seg_no", "role", "type")).alias("r")).select("citation_id", "r.query_id", "r.seg_no", "r.role", "r.type")
    ok = good.select(F.col("citation_id").alias("g")).distinct()
    s = c.join(ok, F.col("citation_id") == F.col("g"), "left").groupBy("query_id", "seg_no").agg(F.min("role").alias("role"), F.count("type").alias("n_citations"), F.count("g").alias("n_valid"))
    verdict = F.when(F.col("n_valid") > 0, "cited").when(F.col("n_citations") > 0, "dropped").when(F.col("role") == "bullet_intro", "intro").otherwise("inferred")
    return s.withColumn("verdict", verdict)


def segment_maps(citations: DataFrame, parts: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, seg_no, kind, doc_id, items): for each segment what it cites of each chunk, texts and images, in citation order.

    ``parts`` (citation_id, part_no, doc_id, part) with a place for every part, else the citation is invalid; ``images``
    (citation_id, img_id, doc_id), where evidence of the question has no chunk.
    """
    c = citations.where("citation_id is not null").groupBy(F.col("citation_id").alias("c_id")).agg(F.max(F.struct("answered_at", "query_id", "seg_no", "cite_no")).alias("r")).select("c_id", "r.query_id", "r.seg_no", "r.cite_no")
    bad = parts.where("doc_id is null").select(F.col("citation_id").alias("b_id")).distinct()
    texts = parts.join(bad, F.col("citation_id") == F.col("b_id"), "left_anti").select("citation_id", F.lit("texts").alias("kind"), "doc_id", F.col("part_no").alias("no"), F.col("part").alias("item"))
    every = texts.unionByName(images.select("citation_id", F.lit("images").alias("kind"), "doc_id", F.lit(0).alias("no"), F.col("img_id").alias("item")))
    met = every.join(c, F.col("citation_id") == F.col("c_id"))
    items = met.groupBy("query_id", "seg_no", "kind", "doc_id").agg(F.sort_array(F.collect_list(F.struct("cite_no", "citation_id", "no", "item"))).alias("m"))
    return items.select("query_id", "seg_no", "kind", "doc_id", F.transform("m", lambda x: x["item"]).alias("items"))


def filter_segments(judged: DataFrame, abstained: DataFrame | None = None) -> DataFrame:
    """Segments that stay: dropped ones go, and an answer of which only introductions are left goes as a whole.

    Answers whose only segment abstains (query_id in ``abstained``) pass as they are.
    """
    kept = judged.where("verdict <> 'dropped'")
    more = kept.where("verdict <> 'intro'").select("query_id").distinct()
    out = kept.join(more, "query_id", "left_semi")
    if abstained is None:
        return out
    as_is = abstained.select("query_id").distinct()
    return out.join(as_is, "query_id", "left_anti").unionByName(judged.join(as_is, "query_id", "left_semi"))


def render_segments(segments: DataFrame) -> DataFrame:
    """(query_id, text): an answer's segments (query_id, seg_no, role, segment) as readable text.

    Sentences run on in a line, paragraphs are set off by an empty line, introductions and bullets have lines of their own.
    """
    t = X.strip(F.col("segment"))
    rows = segments.withColumn("t", t).where(F.col("t").isNotNull() & (F.col("t") != ""))
    inline = ~F.coalesce(F.col("role"), F.lit("")).isin("paragraph", "bullet_intro", "bullet")
    before = F.lag(inline).over(W.partitionBy("query_id").orderBy("seg_no", "t"))
    body = F.when(F.col("role") == "bullet", F.concat(F.lit("- "), "t")).when(F.col("role") == "paragraph", F.concat("t", F.lit("\n"))).otherwise(F.col("t"))
    glue = F.when(before.isNull(), "").when(inline & before, " ").otherwise("\n")
    parts = rows.withColumn("piece", F.concat(glue, body))
    out = parts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "t", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return out.select("query_id", X.strip(F.col("text")).alias("text"))
