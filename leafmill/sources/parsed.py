"""Reading what a parser has written: page batches, element trees, tables of contents, questions and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Settings
from leafmill.functions import text as X
from leafmill.operators.folds import in_groups

_REF = "struct<`$ref`:string,cref:string>"
#: Fixed value: the fields of a parsed batch that are read.
PARSED = f"""body struct<children:array<{_REF}>>, groups array<struct<self_ref:string,label:string,children:array<{_REF}>>>,
 texts array<struct<self_ref:string,label:string,text:string,orig:string,children:array<{_REF}>,prov:array<struct<page_no:int>>>>,
 pictures array<struct<self_ref:string,label:string,children:array<{_REF}>,image:struct<uri:string>,prov:array<struct<page_no:int>>>>,
 tables array<struct<self_ref:string,label:string,text:string,children:array<{_REF}>,prov:array<struct<page_no:int>>>>"""


def page_batches(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(doc_id, pages, batch_start, batch_end): inclusive ranges of pages; documents without pages have none."""
    n = s.max_pages_per_batch
    at = docs.where("pages >= 1").select("doc_id", "pages", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(n))).alias("batch_start"))
    return at.withColumn("batch_end", F.least(F.col("batch_start") + n - 1, F.col("pages") - 1))


def scan_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed batches (JSON files, one document each) with the file they come from, whose name gives their order."""
    return spark.read.schema(PARSED).option("multiLine", True).option("recursiveFileLookup", True).json(folder).withColumn("file", F.input_file_name())


def flatten_elements(parsed: DataFrame) -> DataFrame:
    """(file, elem_order, ref, label, text, image_uri, page_no): a batch's elements in preorder.

    Groups give way to their children, pictures are followed by their first child, however deep they are nested; a reference to an
    element above itself is left out. A group without children stands for itself. A batch holds few pages and is one fold.
    """
    ref = lambda c: F.transform(F.coalesce(c, F.array().cast(f"array<{_REF}>")), lambda x: F.coalesce(x["cref"], x["$ref"]))
    kinds = []
    for name, label, text, uri in (("groups", "label", None, None), ("texts", "label", "text", None), ("pictures", "label", None, "image.uri"), ("tables", "label", "text", None)):
        page = F.lit(None).cast("int") if name == "groups" else F.element_at(F.col("e.prov"), 1)["page_no"]
        page = F.lit(None).cast("int") if name == "groups" else F.when(F.size("e.prov") > 0, page)
        e = parsed.select("file", F.explode(name).alias("e"))
        kinds.append(e.select("file", F.lit(name).alias("kind"), F.col("e.self_ref").alias("ref"), F.col(f"e.{label}").alias("label"), (F.col(f"e.{text}") if text else F.lit(None).cast("string")).alias("text"), (F.col(f"e.{uri}") if uri else F.lit(None).cast("string")).alias("image_uri"), page.alias("page_no"), ref(F.col("e.children")).alias("kids")))
    items = kinds[0]
    for k in kinds[1:]:
        items = items.unionByName(k)
    body = parsed.select("file", F.lit("body").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("ref", "label", "text", "image_uri")], F.lit(None).cast("int").alias("page_no"), ref(F.col("body.children")).alias("kids"))

    def fold(rows: list[dict]) -> list[tuple]:
        at = {r["ref"]: r for r in rows if r["kind"] != "body"}
        out: list[tuple] = []
        todo = [(r, frozenset()) for row in rows if row["kind"] == "body" for r in row["kids"]][::-1]
        while todo:
            name, above = todo.pop()
            r = at.get(name)
            if r is None or name in above:
                continue
            kids = r["kids"] if r["kind"] == "groups" else r["kids"][:1] if r["kind"] == "pictures" else []
            if r["kind"] != "groups" or not kids:
                out.append((r["file"], len(out), name, r["label"], r["text"], r["image_uri"], r["page_no"]))
            todo += [(k, above | {name}) for k in reversed(kids)]
        return out

    return in_groups(items.unionByName(body), ["file"], ["kind", "ref"], fold, "file string, elem_order int, ref string, label string, text string, image_uri string, page_no int")


def serialize(rows: DataFrame, form: bool = False) -> DataFrame:
    """(doc_id, text): a document's elements as one text, as they are or each in the form of its label."""
    t = X.format_element(F.col("type"), F.col("content")) if form else F.coalesce("content", F.lit(""))
    parts = rows.where("doc_id is not null").select("doc_id", F.coalesce("atomic_order", F.lit(0)).alias("o"), "id", t.alias("t"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "id", "t"))), lambda x: x["t"]), "\n").alias("text"))


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string").option("multiLine", True).json(path).select("question")


def questions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("Question").alias("question"))


def routes_json(spark: SparkSession, path: str) -> DataFrame:
    """(route, utterance)"""
    raw = spark.read.schema("routes array<struct<name:string,utterances:array<string>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("routes").alias("r")).select(F.col("r.name").alias("route"), F.explode("r.utterances").alias("utterance"))


def headings_by_font(spans: DataFrame, size: float = 14.0, length: int = 100) -> DataFrame:
    """A table of contents for documents that have none: short spans in large type (doc_id, span_order, size, text, page)."""
    from pyspark.sql import Window as W

    big = spans.where((F.col("size") > size) & (F.length(F.trim("text")) > 0) & (F.length("text") < length))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("span_order")) - 1
    return big.select("doc_id", order.alias("toc_order"), F.lit(1).alias("level"), F.trim("text").alias("title"), "page")
