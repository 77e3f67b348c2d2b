"""Operators against hand-derived expectations and plain brute force."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Compat, Settings, deep_merge
from leafmill.functions import text as X
from leafmill.operators import answers as A
from leafmill.operators import chunking as C
from leafmill.operators import hierarchy as H
from leafmill.operators import retrieval as R
from leafmill.operators.indexing import insert_ignore
from leafmill.runtime import distributed_rank, latest_by_id
from leafmill.sources.parsed import flatten_elements, page_batches, scan_parsed


def one(spark, column, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("t"))).collect()]


def test_token_count(spark):
    assert one(spark, X.token_count, "", "abc", "a" * 8, "a" * 2136, "a" * 2140) == [1, 1, 2, 600, 601]


def test_incomplete(spark):
    values = ("The cat", "The cat.", "see (fig.", "Hello,", "  ", "it went to", 'say "no', None)
    want = [True, False, True, False, False, True, True, False]
    assert one(spark, X.is_text_incomplete, *values) == want
    assert [C.incomplete(v) for v in values] == want


def test_names(spark):
    assert one(spark, X.normalize_title, "1.2. What is Software Engineering?", None) == ["whatissoftwareengineering?", ""]
    assert one(spark, X.normalize_filename, "My Doc (v1).pdf", "/a/b/Ünïcode  x.tar.gz") == ["my_doc_v1", "ünïcode_x_tar"]
    assert one(spark, X.normalize_docname, "se_theory_practice.pdf") == ["se_theory_practicepdf"]
    assert one(spark, X.safe_query, "What's  up?") == ["What s up"]
    assert one(spark, X.section_cleanup, " > ", " >  > A", " > A > B", None) == ["General", "A", "A > B", "General"]
    assert one(spark, X.heading_display, "SOFTWARE-ENGINEERING 3RD", "As is") == ["Software-Engineering 3Rd", "As is"]
    assert one(spark, X.first_sentence, "One two. Three", "no end") == ["One two.", "no end"]
    assert one(spark, X.first_list_item, "intro\n- a\n- b") == ["- a"]
    assert one(spark, X.overlap_tail, " ".join(map(str, range(70))), "a  b") == [" ".join(map(str, range(9, 70))), "a  b"]


def test_page_batches(spark):
    docs = spark.createDataFrame([(1, 15), (2, 31), (3, 0), (4, None)], "doc_id long, pages int")
    rows = sorted(tuple(r) for r in page_batches(docs).select("doc_id", "batch_start", "batch_end").collect())
    assert rows == [(1, 0, 14), (2, 0, 14), (2, 15, 29), (2, 30, 30)]


def test_windows(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, ""), (3, None), (4, "y" * 3799)], "doc_id long, text string")
    w = sorted((r.doc_id, r.start, len(r.text)) for r in C.fixed_windows(docs).where("doc_id = 1").collect())
    assert w == [(1, 0, 2136), (1, 1852, 2136), (1, 3704, 1296)]
    split = [r.text for r in C.fixed_document_split(docs).where("doc_id = 4").orderBy("k").collect()]
    assert len(split) == 2 and split == C.split_batches(["y" * 3799])


def test_compat_drops_the_sentence_that_flushes():
    s = Settings(chunk_max_token=20, chunk_min_token=5, overlap_tokens=4)
    text = " ".join(f"Sentence number {k} has some words." for k in range(8))
    kept = " ".join(p for p, _ in C.split_text(text, s))
    lost = " ".join(p for p, _ in C.split_text(text, s, Compat(drop_flushed_sentence=True)))
    assert all(f"number {k} " in kept for k in range(8)) and not all(f"number {k} " in lost for k in range(8))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc .!?", max_size=60), max_size=30), st.integers(5, 40))
def test_split_text_loses_nothing(parts, most):
    s = Settings(chunk_max_token=most, chunk_min_token=most // 3, overlap_tokens=3)
    text = " ".join(parts)
    out = C.split_text(text, s)
    words = " ".join(p for p, _ in out).split()
    assert set(text.split()) <= set(words)
    longest = max(map(len, text.split()), default=0)
    assert all(n <= most + C.tokens("x" * longest, s) + 1 or n <= 2 * most for _, n in out)


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n.", max_size=400), st.integers(5, 50))
def test_recursive_split_bounds(text, size):
    out = C.recursive_split(text, size, size // 4)
    assert all(len(x) <= size for x in out)
    assert set("".join(text.split())) == set("".join("".join(out).split()))


def unit(k, size, kind="text", content=None, head=None):
    return {"id": str(k), "type": kind, "heading_type": head, "description": None, "content": content or "w" * int(size * 3.56 + 1) + ".", "atomic_order": k, "size": size}


def test_packer():
    out = C.pack([unit(k, n) for k, n in enumerate((100, 250, 150, 300, 100))])
    assert [(c["first"], c["last"]) for c in out] == [(0, 2), (3, 4)]
    big = C.pack([unit(0, 100), unit(1, 1500, content=" ".join(["A word or two here."] * 280))])
    assert all(c["tokens"] <= 2 * DEFAULT.chunk_max_token for c in big) and len(big) > 2
    assert C.pack([]) == []


def test_assemble():
    text, images = C.assemble([unit(0, 1, content="The cat"), unit(1, 1, content="sat."), unit(2, 1, "picture", "uri"), unit(3, 1, "section_header", "### Sub", "nottoc"), unit(4, 1, "list_item", " - a")])
    assert text == "The cat sat.\n\n### Sub\n - a" and images == ["uri"]


def test_tree_against_brute_force(spark):
    r = random.Random(4)
    rows = [(d, k, r.randint(1, 4), f"T{k}", k) for d in ("a", "b") for k in range(40)]
    got = {(x.doc_id, x.pre): x for x in H.toc_to_tree(spark.createDataFrame(rows, "doc_id string, toc_order int, level int, title string, page int")).collect()}
    for d, k, level, _, _ in rows:
        doc = [x for x in rows if x[0] == d]
        parent = max((x[1] for x in doc if x[1] < k and x[2] < level), default=None)
        post = min((x[1] - 1 for x in doc if x[1] > k and x[2] <= level), default=39)
        assert (got[d, k].parent, got[d, k].post) == (parent, post)
    deep = H.toc_to_tree(spark.createDataFrame([("d", k, 10 * k, f"T{k}", k) for k in range(15)], "doc_id string, toc_order int, level int, title string, page int"))
    assert all(len(x.ancestors) == x.pre and x.post == 14 and x.level == 10 * x.pre for x in deep.collect())
    empty = spark.createDataFrame([], "doc_id string, toc_order int, level int, title string, page int")
    assert H.toc_to_tree(empty).count() == 0


def test_assign_strict_stalls(spark):
    heads = spark.createDataFrame([("d", 1, "Alpha"), ("d", 5, "Gamma")], "doc_id string, atomic_order int, title string")
    nodes = spark.createDataFrame([("d", 0, "1. Alpha"), ("d", 1, "Beta"), ("d", 2, "Gamma")], "doc_id string, pre int, title string")
    assert sorted(map(tuple, H.assign_nodes(heads, nodes).collect())) == [("d", 1, 0), ("d", 5, 2)]
    assert sorted(map(tuple, H.assign_nodes(heads, nodes, strict=True).collect())) == [("d", 1, 0)]


def test_rrf(spark):
    lists = spark.createDataFrame([(1, "vector", 1, "A"), (1, "vector", 2, "B"), (1, "bm25", 1, "B"), (1, "bm25", 2, "C"), (1, "bm25", None, "D")], "query_id long, list string, rank int, doc_id string")
    got = [(r.doc_id, round(r.rrf_score, 7)) for r in R.rrf_merge(lists, {"vector": 0.75, "bm25": 0.25}).orderBy("rank").collect()]
    assert got == [("B", 0.0161951), ("A", 0.0122951), ("C", 0.0040323)]


def test_budget(spark):
    sizes = (900, 1200, 800, 300)
    rows = spark.createDataFrame([(1, k + 1, f"d{k}", "x" * int(n * 3.56 + 1), 0) for k, n in enumerate(sizes)], "query_id long, rank int, doc_id string, text string, n_images int")
    assert [r.rank for r in R.greedy_budget(rows).orderBy("rank").collect()] == [1, 3, 4]
    assert R.greedy_budget(rows.limit(0)).count() == 0


def test_budget_of_long_lists(spark):
    rows = [(q, k, f"d{k}", "x" * int((1900 if k == 1 else 300) * 3.56 + 1) if k < 1500 else None, 0) for q in (1, 2) for k in range(1, 1700)]
    got = R.greedy_budget(spark.createDataFrame(rows, "query_id long, rank int, doc_id string, text string, n_images int"))
    assert sorted((r.query_id, r["rank"]) for r in got.collect()) == [(q, k) for q in (1, 2) for k in (1, *range(1500, 1600))]


def test_pipeline_charges_images(spark, tmp_path):
    from leafmill.plans.search import hybrid_pipeline

    spark.createDataFrame([(20, "what is alpha")], "query_id long, question string").write.parquet(str(tmp_path / "questions.parquet"))
    rows = [(20, "bm25", k + 1, f"d{k}", f"alpha is number {k}", (["i"] * 4,)) for k in range(3)]
    spark.createDataFrame(rows, "query_id long, retriever string, rank int, doc_id string, text string, metadata struct<images:array<string>>").write.parquet(str(tmp_path / "hits.parquet"))
    assert [r.tokens for r in hybrid_pipeline(spark, str(tmp_path)).collect()] == [1204]


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.4, 0.9165151]), (2, [0.39, 0.9208149]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.rank) for r in R.vector_search(v.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), v).collect()}
    assert got == {(0, 1), (1, 2)}
    assert R.vector_search(v.limit(0).withColumnRenamed("vec_id", "query_id"), v).count() == 0


def test_citations(spark):
    c = spark.createDataFrame([("c1", 1, 0, "sentence", "text", "Tthe Cat!", None, None), ("c2", 1, 1, "sentence", "text", "the cat ... far away", None, None), ("c3", 1, 2, "bullet", "image", None, "query_evidence", None), ("c4", 1, 3, "bullet", "text", "...", None, None)], "citation_id string, query_id long, seg_no int, role string, type string, content string, img_id string, answered_at timestamp")
    docs = spark.createDataFrame([(1, 1, "d1", "He saw: the cat, sitting.", ["i1"])], "query_id long, rank int, doc_id string, text string, images array<string>")
    parts = A.cite_exact(A.citation_parts(c), docs)
    assert {(r.citation_id, r.part_no): r.doc_id for r in parts.collect()} == {("c1", 0): None, ("c2", 0): "d1", ("c2", 1): None}
    assert [(r.citation_id, r.doc_id) for r in A.cite_fuzzy(parts, docs).collect()] == [("c1", "d1")]
    assert [tuple(r) for r in A.cite_images(c, docs).collect()] == [("c3", "query_evidence", None)]
    verdicts = {r.seg_no: r.verdict for r in A.validate_segments(c, c.where("citation_id in ('c1', 'c3')").select("citation_id")).collect()}
    assert verdicts == {0: "cited", 1: "dropped", 2: "cited", 3: "dropped"}


def test_render(spark):
    rows = [(1, 0, "paragraph", "P"), (1, 1, "sentence", "S1"), (1, 2, "sentence", "S2"), (1, 3, "bullet_intro", "I"), (1, 4, "bullet", "B"), (1, 5, "bullet", " ")]
    got = A.render_segments(spark.createDataFrame(rows, "query_id long, seg_no int, role string, segment string")).first().text
    assert got == "P\n\nS1 S2\nI\n- B"


def test_two_pass(spark):
    parse = lambda raw: json.loads(raw) if raw.startswith("[") else None
    assert A.two_pass("q", "c", lambda q, c: "bad", lambda q, c: '["e"]', lambda raw: raw, parse) == (["e"], 2)
    assert A.two_pass("q", "c", lambda q, c: "bad", lambda q, c: "[]", lambda raw: '["fixed"]', parse) == (["fixed"], 1)
    assert A.two_pass("q", "c", lambda q, c: "x", lambda q, c: "x", lambda raw: raw, parse) == ([], 0)
    q = spark.createDataFrame([(1, "q", "c")], "query_id long, question string, context string")
    assert A.generate(q, lambda q, c: "[]", lambda q, c: '["e"]', lambda r: r, lambda raw: json.loads(raw)).first()["pass"] == 2


def test_flatten(spark, tmp_path):
    ref = lambda x: {"cref": x}
    doc = {"body": {"children": [ref("#/texts/0"), ref("#/groups/0"), ref("#/pictures/0")]}, "groups": [{"self_ref": "#/groups/0", "label": "list", "children": [ref("#/texts/1"), ref("#/texts/2")]}],
           "texts": [{"self_ref": f"#/texts/{k}", "label": "text", "text": f"t{k}", "children": [], "prov": [{"page_no": 1}]} for k in range(4)], "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "children": [ref("#/texts/3")], "image": {"uri": "u"}, "prov": []}], "tables": []}
    (tmp_path / "pages_0000_0014.json").write_text(json.dumps(doc))
    rows = flatten_elements(scan_parsed(spark, str(tmp_path))).orderBy("elem_order").collect()
    assert [r.ref for r in rows] == ["#/texts/0", "#/texts/1", "#/texts/2", "#/pictures/0", "#/texts/3"]
    nest = [{"self_ref": f"#/groups/{k}", "label": "list", "children": [ref(f"#/groups/{k + 1}" if k < 11 else "#/texts/0")]} for k in range(12)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "pages_0000_0014.json").write_text(json.dumps({**doc, "body": {"children": [ref("#/groups/0")]}, "groups": nest}))
    assert [r.ref for r in flatten_elements(scan_parsed(spark, str(tmp_path / "deep"))).collect()] == ["#/texts/0"]


def test_writes(spark, tmp_path):
    from leafmill.sinks.stores import add_new

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", 1, "w")], "id string, k int, v string")
    assert sorted(map(tuple, latest_by_id(rows, "id", ["k"], ["k", "v"]).collect())) == [("a", 2, "y"), ("b", 1, "w")]
    assert sorted(map(tuple, insert_ignore(rows.where("id = 'b'"), rows, "id", ["k"]).collect())) == [("a", 1, "x")]
    for _ in range(2):
        add_new(rows, str(tmp_path / "t"), "id", ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_distributed_rank(spark):
    r = random.Random(1)
    rows = [(g, r.randint(0, 30), k) for g in ("hot", "b", None) for k in range(300 if g == "hot" else 5)]
    got = distributed_rank(spark.createDataFrame(rows, "g string, v int, k int"), ["g"], [F.col("v"), F.col("k")], "rank", "size").collect()
    for x in got:
        same = sorted((v, k) for g, v, k in rows if g == x.g)
        assert same.index((x.v, x.k)) + 1 == x["rank"] and x["size"] == len(same)


def test_stitch_batch_and_stream(spark, tmp_path):
    from leafmill.streaming.stitch import stitch, stitch_stream

    schema = "doc_id string, id string, atomic_order int, type string, content string"
    rows = [("d", "1", 1, "text", "The cat"), ("d", "2", 2, "picture", "uri"), ("d", "3", 3, "text", "sat."), ("d", "4", 4, "section_header", "H"), ("d", "5", 5, "text", "New (open"), ("d", "6", 6, "section_header", "H2"), ("d", "7", 7, "text", "End.")]
    want = {("1", "The cat sat."), ("2", "uri"), ("4", "H"), ("5", "New (open"), ("6", "H2"), ("7", "End.")}
    assert {(r.id, r.content) for r in stitch(spark.createDataFrame(rows, schema)).collect()} == want
    for k, part in enumerate((rows[:2], rows[2:], [("d", None, None, None, None)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stitch_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.id, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_settings():
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert (DEFAULT.window_chars, DEFAULT.step_chars, DEFAULT.overlap_words) == (2136, 1852, 61)


def test_extra_columns_do_no_harm(spark):
    rows = spark.createDataFrame([("a", "x", 1, 2)], "doc_id string, text string, rank int, source int")
    assert R.postings(rows).count() == 1
    with pytest.raises(Exception):
        R.postings(rows.drop("text")).count()


@pytest.mark.parametrize("shift", [0, 4093, 4096 * 3 - 2])
def test_chunks_do_not_depend_on_where_places_begin(spark, shift):
    from leafmill.streaming.stitch import Buffer, stitch

    r = random.Random(8)
    rows, o = [], 0
    for k in range(120):
        o += r.choice((1, 1, 2))
        kind = r.choice(("text", "text", "text", "list_item", "picture", "section_header"))
        text = {"picture": "uri", "section_header": "A title"}.get(kind) or " ".join(["some words here"] * r.choice((1, 3, 60))) + r.choice((".", "", " and", " (open", " "))
        rows.append((f"e{k:03d}", "d", o, kind, r.choice(("main", "nottoc")) if kind == "section_header" else None, None, text if r.random() > 0.05 else r.choice(("  ", None))))
    schema = "id string, doc_id string, atomic_order int, type string, heading_type string, description string, content string"
    df = spark.createDataFrame([(i, d, o + shift, *x) for i, d, o, *x in rows], schema)

    buf = Buffer()
    for i, _, o, kind, _, _, text in rows:
        buf.add({"id": i, "atomic_order": o, "type": kind, "content": text})
    want = [(e["id"], e["content"], e["n_joined"]) for e in buf.rest()]
    assert sorted((x.id, x.content, x.n_joined) for x in stitch(df).collect()) == want and any(n > 1 for _, _, n in want)

    one: list[str] = []  # the fold over the whole document at once
    for text in (t for s in _sections([(k, t) for *_, k, _, _, t in rows if t is not None]) for t in s):
        one.append(text)
    got = sorted((x.block, x.stretch, x.section, x.k, x.text) for x in C.title_chunks(df).collect())
    assert [x[4] for x in got] == one

    units = df.select("*", F.lit("doc").alias("document"), F.lit(0).alias("top"), F.lit("").alias("path"), F.lit(False).alias("fits"), F.coalesce(F.length("content"), F.lit(0)).alias("size"))
    pieces = [[]]
    for i, d, o, kind, head, desc, text in rows:
        if kind == "section_header" and head == "nottoc":
            pieces.append([])
        pieces[-1].append({"id": i, "doc_id": d, "document": "doc", "path": "", "fits": False, "type": kind, "heading_type": head, "description": desc, "content": text, "atomic_order": o, "size": len(text or "")})
    want = [c[5] for p in pieces if p for c in C._chunks_of(p, DEFAULT)]
    assert sorted(x.text for x in C.semantic_chunks(units).collect()) == sorted(want)


def _sections(rows):
    """By title: (type, content) in order to the texts of each section, as one fold."""
    sections = [[]]
    for kind, t in rows:
        if kind == "section_header" and sum(map(len, sections[-1])) >= 500:
            sections.append([])
        sections[-1].append(t)
    for texts in sections:
        out, now = [], ""
        for t in texts:
            for p in (t[a : a + 3000] for a in range(0, max(1, len(t)), 3000)):
                if now and (len(now) + 2 + len(p) > 3000 or len(now) >= 2400):
                    out.append(now)
                    now = ""
                now = f"{now}\n\n{p}" if now else p
        yield [*out, now] if now.strip() else out


def test_merged_chunks_and_later_similar_headings(spark):
    c = "struct<chunk_id:string,text:string,token_count:int,images:array<string>>"
    rows = spark.createDataFrame([(("d__chunk_1_3", "a", 2, ["i"]), ("d__chunk_4_6", "b", 3, [])), (("d__chunk_1_3", "a", 2, []), ("odd", "b", 3, ["j"]))], f"a {c}, b {c}")
    got = [r.m for r in rows.select(C.merge_chunks(F.col("a"), F.col("b")).alias("m")).collect()]
    assert [(m.chunk_id, m.text, m.token_count, m.images) for m in got] == [("d__chunk_1_6", "a\n\nb", 5, ["i"]), ("d__chunk_1_3__merged__odd", "a\n\nb", 5, ["j"])]
    heads = spark.createDataFrame([("d", 1, "Alpha"), ("d", 5, "The gamma of long rivers")], "doc_id string, atomic_order int, title string")
    nodes = spark.createDataFrame([("d", 0, "Cover"), ("d", 1, "1. Alpha"), ("d", 2, "Beta"), ("d", 3, "The gamma of long river")], "doc_id string, pre int, title string")
    assert sorted(map(tuple, H.assign_nodes(heads, nodes).collect())) == [("d", 1, 1), ("d", 5, 3)]
    assert sorted(map(tuple, H.assign_nodes(heads, nodes, strict=True).collect())) == [("d", 1, 1)]


def test_conversation_and_experiment(spark, tmp_path):
    from leafmill.sinks.stores import run_experiment, write_index

    def talk(q):
        if "?" in q:
            raise ValueError
        return "hello"

    routed = spark.createDataFrame([(1, "hi", "chat"), (2, "why?", "chat"), (3, "what", "need_retrieve"), (4, None, None)], "query_id long, question string, route string")
    contexts = spark.createDataFrame([(3, "ctx")], "query_id long, context string")
    parse = lambda raw: json.loads(raw) if raw.startswith("[") else None
    got = {r.query_id: (json.loads(r.answer), r["pass"]) for r in A.converse(routed, contexts, talk, lambda q, c: json.dumps([{"segment": c}]), lambda q, c: "[]", lambda r: r, parse).collect()}
    assert got[1][0][0]["segment"] == "hello" and got[2][0][0]["type"] == "abstained" and got[3] == ([{"segment": "ctx"}], 1) and len(got) == 4
    replies = spark.createDataFrame([('[{"img_id": "a", "description": "x"}, {"img_id": null}]',), ("broken [",), (None,)], "raw string")
    assert [tuple(r) for r in A.described(replies).collect()] == [("a", "x")]
    run = run_experiment(routed, lambda q: contexts, lambda q: q.select("query_id", F.lit("[]").alias("answer")), str(tmp_path / "log"))
    assert run.count() == 4 and spark.read.option("header", True).csv(str(tmp_path / "log")).columns == ["question", "context", "answer", "retrieve_time_sec", "generate_time_sec"]
    index = spark.createDataFrame([("c_0", "d", "S", 3, "c", ["img0_c_0"], "search", "text")], "id string, document string, section string, token_count int, chunk_id string, images array<string>, search_content string, text_content string")
    images = spark.createDataFrame([("img0_c_0", "data:,x", "a figure")], "img_id string, base64 string, description string")
    for _ in range(2):
        write_index(index, str(tmp_path / "ix"), lambda df, t: R.hashed_embedding(df, t), images)
    assert [spark.read.parquet(str(tmp_path / "ix" / n)).count() for n in ("chunks", "images", "vectors")] == [1, 1, 1]
    assert A.image_lookup(images.select("img_id"), spark.read.parquet(str(tmp_path / "ix" / "images"))).first().base64 == "data:,x"


def test_content_inputs(spark):
    docs = spark.createDataFrame([(1, 1, "A", ["i1", "gone", "i2"]), (1, 2, None, ["i3", "i4"])], "query_id long, rank int, text string, images array<string>")
    store = spark.createDataFrame([(f"i{k}", f"u{k}") for k in range(1, 5)], "img_id string, base64 string")
    asked = spark.createDataFrame([(1, "why"), (2, None)], "query_id long, question string")
    got = [(r.query_id, r.type, r.text or r.image_url) for r in A.content_inputs(docs, asked, store).orderBy("query_id", "n").collect()]
    label = lambda x: (1, "input_text", f"\n\nImage: {x}")
    assert got[:9] == [(1, "input_text", "### CONTEXT DOCUMENTS\n"), (1, "input_text", "\n[0]\nA\n"), label("i1"), (1, "input_image", "u1"), label("gone"), label("i2"), (1, "input_image", "u2"), (1, "input_text", "\n[1]\n\n"), label("i3")]
    assert got[9:] == [(1, "input_image", "u3"), (1, "input_text", "### USER QUESTION\nwhy\n### ANSWER"), (2, "input_text", "### CONTEXT DOCUMENTS\n"), (2, "input_text", "### USER QUESTION\n\n### ANSWER")]
    kinds = {r.type for r in A.chat_parts(A.content_inputs(docs, asked, store)).collect()}
    assert kinds == {"text", "image_url"}


def test_vectors_with_ties_and_text_ids(spark):
    v = spark.createDataFrame([(f"v{k:03d}", [1.0, float(k % 3)]) for k in range(200)], "vec_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, embedding array<float>")
    want = [f"v{k:03d}" for k in range(200) if k % 3 == 1][:10]
    assert [r.vec_id for r in R.vector_search(q, v, k=10).orderBy("rank").collect()] == want
    many = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "query_id long, embedding array<float>")
    assert R.vector_search(many, v, k=2, most_bytes=64).count() == R.vector_search(many, v, k=2).count() == 18
