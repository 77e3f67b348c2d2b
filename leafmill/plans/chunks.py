"""Queries of the chunk builders and index preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import Compat
from leafmill.functions import text as X
from leafmill.operators import chunking as C
from leafmill.operators import hierarchy as H
from leafmill.operators import indexing as I
from leafmill.plans.base import WS, core, sql_incomplete, sql_strip, sql_tail, sql_tokens, sql_words
from leafmill.plans.trees import LATEST, PLACED, TOTALS, TREE, latest, places, tree
from leafmill.runtime import cut, cut_packed, merged, table

_DOCS = "d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) > 0)"


@core(f"WITH {_DOCS}, w AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 1852)) AS start FROM d) SELECT doc_id, (start // 1852)::INT AS k, start::INT AS start, substring(text, start::BIGINT + 1, 2136) AS text FROM w")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_windows(table(spark, sf_dir, "documents"))


@core("""WITH d AS (SELECT doc_id, ' ' || text AS text FROM documents WHERE text IS NOT NULL), n AS (SELECT *, (length(text) - 1) // 1852 + 1 AS n, length(text) - ((length(text) - 1) // 1852) * 1852 AS rest FROM d),
 k AS (SELECT *, CASE WHEN n > 1 AND rest < 284 THEN n - 1 ELSE n END AS kept FROM n), w AS (SELECT *, unnest(generate_series(0, kept - 1)) AS k FROM k)
 SELECT doc_id, k::INT AS k, CASE WHEN k = kept - 1 AND kept < n THEN substring(text, k * 1852 + 1, 2136) || ' ' || substring(text, (n - 1) * 1852 + 1, 2136) ELSE substring(text, k * 1852 + 1, 2136) END AS text FROM w""")
def fixed_document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_document_split(table(spark, sf_dir, "documents"))


_BLANK = rf"regexp_replace(substring(text, start::BIGINT + 1, 2136), '^{WS}+|{WS}+$', '', 'g')"


@core(f"WITH {_DOCS}, w AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 1852)) AS start FROM d), s AS (SELECT doc_id, start, {_BLANK} AS t FROM w) SELECT doc_id || '_chunk_' || (start // 1852) AS chunk_id, t AS text, greatest(1, trunc(length(t) / 3.56)::INT) AS token_count FROM s WHERE t <> ''")
def fixed_index_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows stripped, blank ones left out but counted, with ids and tokens."""
    w = C.fixed_windows(table(spark, sf_dir, "documents")).withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    return w.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("k").cast("string")).alias("chunk_id"), "text", X.token_count(F.col("text")).alias("token_count"))


@core()
def recursive_char_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recursive_chunks(table(spark, sf_dir, "documents"))


_TITLES = """u AS (SELECT doc_id, id, coalesce(atomic_order, 0) AS o, coalesce(type = 'section_header', false) AS title, content, length(content) AS n FROM l WHERE doc_id IS NOT NULL AND content IS NOT NULL),
 b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
 c AS (SELECT *, title AND before - coalesce(last_value(CASE WHEN title THEN before END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 500 AS sure FROM b),
 d AS (SELECT *, sum(sure::INT) OVER (PARTITION BY doc_id ORDER BY o, id) AS block, o - coalesce(last_value(CASE WHEN sure THEN o END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o, id), min(o) OVER (PARTITION BY doc_id)) AS off FROM c),
 g AS (SELECT doc_id, block::BIGINT AS block, (off // 4096)::BIGINT AS stretch, list({'n': n, 'sec': title::INT, 'out': []::INT[]} ORDER BY o, id) AS xs, list(content ORDER BY o, id) AS texts FROM d GROUP BY ALL),
 s AS (SELECT *, list_reduce(list_prepend({'n': 0::BIGINT, 'sec': 0, 'out': []::INT[]}, xs), lambda a, x: CASE WHEN x.sec = 1 AND a.n >= 500 THEN {'n': x.n, 'sec': a.sec + 1, 'out': list_append(a.out, a.sec + 1)} ELSE {'n': a.n + x.n, 'sec': a.sec, 'out': list_append(a.out, a.sec)} END).out AS secs FROM g),
 t AS (SELECT doc_id, block, stretch, generate_subscripts(texts, 1) AS i, unnest(secs) AS section, unnest(texts) AS t FROM s),
 p AS (SELECT doc_id, block, stretch, section, flatten(list(CASE WHEN length(t) > 3000 THEN list_transform(range(0, length(t), 3000), lambda k: {'done': []::VARCHAR[], 'now': substring(t, k + 1, 3000)}) ELSE [{'done': []::VARCHAR[], 'now': t}] END ORDER BY i)) AS ps FROM t GROUP BY ALL),
 r AS (SELECT doc_id, block, stretch, section, list_reduce(list_prepend({'done': []::VARCHAR[], 'now': ''}, ps), lambda a, x: CASE WHEN a.now = '' THEN {'done': a.done, 'now': x.now}
   WHEN length(a.now) + 2 + length(x.now) > 3000 OR length(a.now) >= 2400 THEN {'done': list_append(a.done, a.now), 'now': x.now} ELSE {'done': a.done, 'now': a.now || chr(10) || chr(10) || x.now} END) AS z FROM p),
 e AS (SELECT *, CASE WHEN {strip} = '' THEN z.done ELSE list_append(z.done, z.now) END AS out FROM r)""".replace("{strip}", sql_strip("z.now"))


@core(f"WITH l AS ({LATEST}), {_TITLES} SELECT doc_id, block, stretch, section, (generate_subscripts(out, 1) - 1)::INT AS k, unnest(out) AS text FROM e")
def chunk_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.title_chunks(latest(spark, sf_dir).select("doc_id", "id", "atomic_order", "type", "content"))


def hsf(spark: SparkSession, sf_dir: str, compat: Compat = Compat()) -> DataFrame:
    """Hierarchical-semantic chunks of every document."""
    nodes = tree(spark, sf_dir)
    own = places(spark, sf_dir, nodes)
    totals = cut(H.subtree_tokens(nodes, own.groupBy("doc_id", "pre").agg(F.sum("size").alias("own_tokens"))))
    stops = H.choose_cut(nodes, totals, inner_text=not compat.drop_inner_text)
    joined = nodes.join(totals, ["doc_id", "pre"])
    tops = stops.select("doc_id", F.col("pre").alias("top"), "whole").join(joined.select("doc_id", F.col("pre").alias("top"), "path", "token_count", "own_tokens"), ["doc_id", "top"])
    # a unit belongs to the emitted node above its own; inner nodes that do not fit take only what is theirs alone
    above = nodes.select("doc_id", "pre", F.explode(F.concat("ancestors", F.array("pre"))).alias("top")).join(tops, ["doc_id", "top"]).where("pre >= 0 and (whole or pre = top)")
    above = above.select("doc_id", "pre", "top", "path", (F.when(F.col("whole"), F.col("token_count")).otherwise(F.col("own_tokens")) <= 600).alias("fits"))
    free = own.where("pre < 0").select("doc_id").distinct().select("doc_id", F.lit(-1).alias("pre"), F.lit(-1).alias("top"), F.lit("").alias("path"), F.lit(False).alias("fits"))
    corpus = table(spark, sf_dir, "corpus").groupBy(F.col("doc_id").alias("c_doc")).agg(F.max(F.struct("registered_at", "file_path")).alias("r"))
    above = above.unionByName(free).join(corpus, F.col("doc_id") == F.col("c_doc"), "left").withColumn("document", F.coalesce(X.sanitize_filename(F.col("r.file_path")), F.col("doc_id"))).drop("c_doc", "r")
    units = own.withColumn("pre", F.greatest("pre", F.lit(-1))).join(cut(above), ["doc_id", "pre"]).select("id", "doc_id", "top", "path", "document", "fits", "atomic_order", "begins")
    # only places have gone through joins and windows so far; texts are read now, and shuffled once to their ids and once to their blocks
    parts = C.blocks(units, F.col("begins")).select("id", "doc_id", "top", "path", "document", "fits", "atomic_order", "block", "stretch")
    texts = latest(spark, sf_dir).select("id", "type", "heading_type", "description", "content", "size")
    return C.chunks_of_blocks(cut_packed(merged(texts, parts, "id")), compat=compat)


@core("WITH c AS (SELECT doc_id, any_value(text) AS text FROM hits WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id), w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x <> '') AS w FROM c), t AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) SELECT term, doc_id, count(*) AS tf, max(len)::INT AS len FROM t GROUP BY term, doc_id")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index over all retrieved chunks."""
    from leafmill.operators.retrieval import postings
    from leafmill.plans.search import chunks

    return postings(chunks(spark, sf_dir))


@core("WITH e AS (SELECT DISTINCT doc_id AS id, text FROM hits WHERE doc_id IS NOT NULL AND rank <= 2), f AS (SELECT doc_id AS id, text, min(rank) AS r FROM hits WHERE doc_id IS NOT NULL GROUP BY ALL) SELECT id, text FROM e UNION ALL SELECT id, text FROM f WHERE id NOT IN (SELECT id FROM e)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table that holds the chunks of the first two ranks, after a conflict-free insert of all chunks."""
    rows = table(spark, sf_dir, "hits").where("doc_id is not null").select(F.col("doc_id").alias("id"), "text", "rank")
    there = rows.where("rank <= 2").select("id", "text").distinct()
    return there.unionByName(I.insert_ignore(there, rows, "id", ["rank", "text"]).select("id", "text"))


@core("SELECT doc_id, n AS pages, s AS batch_start, least(s + 14, n - 1)::INT AS batch_end FROM (SELECT doc_id, page_count AS n, unnest(generate_series(0, page_count - 1, 15))::INT AS s FROM documents WHERE page_count >= 1)")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.sources.parsed import page_batches as batches

    return batches(table(spark, sf_dir, "documents").select("doc_id", F.col("page_count").alias("pages")))


@core("SELECT doc_id, string_agg(coalesce(content, ''), chr(10) ORDER BY coalesce(atomic_order, 0), id) AS text FROM (" + LATEST + ") WHERE doc_id IS NOT NULL GROUP BY doc_id")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's elements as one text, in order."""
    from leafmill.sources.parsed import serialize

    return serialize(latest(spark, sf_dir))


_BEFORE = "OVER (PARTITION BY doc_id ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@core(f"""WITH l AS ({LATEST}), r AS (SELECT id, doc_id, coalesce(atomic_order, 0)::INT AS o, coalesce(type, '') AS type, content, {sql_incomplete('content', X.DANGLING)} AS inc, coalesce(type = 'text' AND {sql_strip('content')} <> '', false) AS filled FROM l WHERE doc_id IS NOT NULL),
 f AS (SELECT *, filled AND coalesce(last_value(CASE WHEN type = 'section_header' THEN false WHEN filled THEN inc END IGNORE NULLS) {_BEFORE}, false) AS joins FROM r),
 h AS (SELECT *, CASE WHEN joins THEN last_value(CASE WHEN filled AND NOT joins THEN id END IGNORE NULLS) {_BEFORE} ELSE id END AS head FROM f),
 g AS (SELECT head AS id, doc_id, first(o ORDER BY o, id) AS atomic_order, first(type ORDER BY o, id) AS type, string_agg(content, ' ' ORDER BY o, id) AS content, (count(*) - 1)::INT AS n_joined FROM h GROUP BY head, doc_id)
 SELECT id, doc_id, atomic_order, type, content, {sql_tokens("coalesce(content, '')")} AS token_count, n_joined FROM g""")
def stitch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were cut, joined with the texts that go on with them."""
    from leafmill.streaming.stitch import stitch

    return stitch(latest(spark, sf_dir))


def _split_sql() -> str:
    """Sentences packed one after another: each step turns what is done and the part at hand into the next state."""
    n, s = "a.now", "x.item"
    both, left = f"({n} || ' ' || {s})", f"({sql_tail(n)})"
    fits, big, more = f"{sql_tokens(both)} <= 600", f"{sql_tokens(n)} >= 200", f"{sql_tokens(f'({left} || chr(32) || {s})')} > 600"
    done = f"""CASE x.kind WHEN 's' THEN CASE WHEN {fits} THEN a.done WHEN {big} THEN list_append(a.done, {sql_strip(n)}) ELSE list_append(a.done, {sql_strip(both)}) END
      WHEN 'c' THEN CASE WHEN {big} THEN list_append(a.done, {sql_strip(n)}) ELSE a.done END ELSE CASE WHEN {n} <> '' AND NOT ({fits}) THEN list_append(a.done, {sql_strip(n)}) ELSE a.done END END"""
    now = f"""CASE x.kind WHEN 's' THEN CASE WHEN {fits} THEN {both} WHEN {big} THEN CASE WHEN {more} THEN {s} ELSE {left} || ' ' || {s} END ELSE {sql_tail(both)} END
      WHEN 'c' THEN CASE WHEN {big} THEN {left} ELSE {n} END ELSE CASE WHEN {n} = '' OR {fits} THEN {both} WHEN {more} THEN ' ' || {s} ELSE {left} || ' ' || {s} END END"""
    state = lambda kind, item: f"{{'done': []::VARCHAR[], 'now': '', 'kind': {kind}, 'item': {item}}}"
    grow = f"list_reduce({sql_words('x')}, lambda b, w: b || CASE WHEN {sql_tokens('(string_split(b, chr(1))[-1] || chr(32) || w)')} <= 600 THEN ' ' ELSE chr(1) END || w)"
    long = f"list_prepend({state(chr(39) + 'c' + chr(39), chr(39) * 2)}, list_transform(string_split({grow}, chr(1)), lambda p: {state(chr(39) + 'p' + chr(39), 'p')}))"
    items = f"flatten(list_transform(ss, lambda x: CASE WHEN {sql_tokens('x')} <= 600 THEN [{state(chr(39) + 's' + chr(39), 'x')}] ELSE {long} END))"
    return f"""s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ss FROM l WHERE length(content) > 0),
     r AS (SELECT id, list_reduce(list_prepend({state("''", "''")}, {items}), lambda a, x: {{'done': {done}, 'now': {now}, 'kind': '', 'item': ''}}) AS z FROM s),
     p AS (SELECT id, list_filter(list_append(z.done, {sql_strip('z.now')}), lambda t: t <> '') AS ps FROM r)"""


@core(f"WITH l AS ({LATEST}), {_split_sql()}, k AS (SELECT id, (generate_subscripts(ps, 1) - 1)::INT AS k, unnest(ps) AS text FROM p) SELECT id, k, text, {sql_tokens('text')} AS token_count FROM k")
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element's content in overlapping parts of bounded size."""
    return I.text_parts(latest(spark, sf_dir).select("id", "content"))


def _pack_sql() -> str:
    """Elements taken into a chunk one after another: the state is the chunk at hand and those closed before it."""
    stripped = lambda t: f"{sql_strip(t)} <> ''"

    def grown(text: str, tb: str, go: str, pend: str, imgs: str) -> str:
        """The text and images at hand with one element more; a main heading gives way to one that follows at once."""
        base = f"CASE WHEN {pend} THEN {tb} ELSE {text} END"
        new = f"""CASE WHEN x.type = 'text' THEN {text} || CASE WHEN {go} THEN ' ' WHEN {text} <> '' THEN chr(10) ELSE '' END || x.c
          WHEN x.type = 'section_header' THEN CASE WHEN x.head = 'nottoc' AND {stripped(text)} THEN {text} || chr(10) || chr(10) || x.c
            WHEN x.head = 'main' THEN {base} || CASE WHEN {stripped(f'({base})')} THEN chr(10) || chr(10) || '# ' || x.descr ELSE '' END ELSE {text} END
          WHEN x.type = 'picture' OR x.c = '' THEN {text} ELSE {text} || chr(10) || x.c END"""
        main = "x.type = 'section_header' AND x.head = 'main'"
        return f"{{'text': {new}, 'tb': CASE WHEN {main} THEN {base} ELSE '' END, 'go': x.type = 'text' AND x.inc, 'pend': {main}, 'imgs': CASE WHEN x.type = 'picture' THEN list_append({imgs}, x.c) ELSE {imgs} END}}"

    size = lambda text, imgs: f"(CASE WHEN {text} = '' THEN 0 ELSE {sql_tokens(text)} END + 300 * len({imgs}))::INT"
    chunk = lambda first, last, part, text, imgs: f"{{'first': {first}, 'last': {last}, 'part': {part}, 'text': {text}, 'images': {imgs}, 'tokens': {size(text, imgs)}}}"
    shut = f"CASE WHEN a.first IS NULL THEN a.out ELSE list_append(a.out, {chunk('a.first', 'a.last', '-1', 'a.text', 'a.imgs')}) END"
    lead = f"({sql_strip('(' + sql_strip('a.text') + ' || chr(10) || chr(10) || x.ps[1])')})"
    own = lambda ps: f"list_transform({ps}, lambda p, k: {chunk('x.o', 'x.o', 'k - 1', 'p', '[]::VARCHAR[]')})"
    led = "a.have < 200 AND a.first IS NOT NULL AND len(x.ps) > 0"
    big, long = "NOT x.whole AND a.have + x.size >= 600", "x.type = 'text' AND x.size >= 600"
    pick = lambda grow, fresh, gone: f"CASE WHEN NOT ({big}) THEN {grow} WHEN {long} THEN {gone} WHEN a.have >= 200 THEN {fresh} ELSE {gone} END"
    out = f"""CASE WHEN NOT ({big}) THEN a.out WHEN {long} THEN CASE WHEN {led} THEN list_concat(list_append(a.out, {chunk('a.first', 'x.o', '-1', lead, 'a.imgs')}), {own('x.ps[2:]')}) ELSE list_concat({shut}, {own('x.ps')}) END
      WHEN a.have >= 200 THEN {shut} ELSE list_append(a.out, {chunk('coalesce(a.first, x.o)', 'x.o', '-1', 'v.m.text', 'v.m.imgs')}) END"""
    keep = {"text": ("v.m.text", "v.s.text", "''"), "tb": ("v.m.tb", "v.s.tb", "''"), "go": ("v.m.go", "v.s.go", "false"), "pend": ("v.m.pend", "v.s.pend", "false"), "imgs": ("v.m.imgs", "v.s.imgs", "[]::VARCHAR[]"),
            "have": (size("v.m.text", "v.m.imgs"), size("v.s.text", "v.s.imgs"), "0"), "first": ("coalesce(a.first, x.o)", "x.o", "NULL::INT"), "last": ("x.o", "x.o", "NULL::INT")}
    still = ", ".join(f"'{k}': x.{k}" for k in ("type", "head", "c", "descr", "o", "size", "inc", "ps", "whole"))
    step = f"list_transform([{{'m': {grown('a.text', 'a.tb', 'a.go', 'a.pend', 'a.imgs')}, 's': {grown(chr(39) * 2, chr(39) * 2, 'false', 'false', '[]::VARCHAR[]')}}}], lambda v: {{{', '.join(f'{chr(39)}{k}{chr(39)}: {pick(*w)}' for k, w in keep.items())}, 'out': {out}, {still}}})[1]"
    none = "'text': '', 'tb': '', 'go': false, 'pend': false, 'imgs': []::VARCHAR[], 'have': 0::INT, 'first': NULL::INT, 'last': NULL::INT, 'out': []::STRUCT(first INT, last INT, part INT, text VARCHAR, images VARCHAR[], tokens INT)[]"
    unit = f"{{{none}, 'type': type, 'head': head, 'c': c, 'descr': descr, 'o': o, 'size': size, 'inc': inc, 'ps': ps, 'whole': whole}}"
    zero = f"{{{none}, 'type': '', 'head': '', 'c': '', 'descr': '', 'o': 0, 'size': 0, 'inc': false, 'ps': []::VARCHAR[], 'whole': false}}"
    step = step.replace("k - 1", "(k - 1)::INT").replace("-1,", "(-1)::INT,")
    last = shut.replace("a.", "z.").replace("-1,", "(-1)::INT,")
    label = sql_strip("regexp_replace(c, '^#+', '')")
    return f"""{TREE}, {PLACED}, {TOTALS}, {_split_sql()}, pa AS (SELECT d.doc_id, d.pre, string_agg(a.title, ' > ' ORDER BY a.pre) AS path FROM t d JOIN t a ON a.doc_id = d.doc_id AND d.pre BETWEEN a.pre AND a.post GROUP BY ALL),
     sto AS (SELECT a.*, token_count <= 600 OR NOT EXISTS (SELECT 1 FROM tt c WHERE c.doc_id = a.doc_id AND c.parent = a.pre) AS full_ FROM tt a WHERE token_count > 0 AND NOT EXISTS (SELECT 1 FROM tt b WHERE b.doc_id = a.doc_id AND b.pre < a.pre AND a.pre <= b.post AND b.token_count <= 600)),
     ab AS (SELECT d.doc_id, d.pre, s.pre AS top, pa.path, CASE WHEN full_ THEN s.token_count ELSE s.own_tokens END <= 600 AS fits FROM tt d JOIN sto s ON s.doc_id = d.doc_id AND d.pre BETWEEN s.pre AND s.post AND (full_ OR d.pre = s.pre) AND (full_ OR s.own_tokens > 0) JOIN pa ON pa.doc_id = s.doc_id AND pa.pre = s.pre),
     un AS (SELECT pl.* EXCLUDE (path), ab.top, ab.path, ab.fits FROM pl JOIN ab ON pl.doc_id = ab.doc_id AND pl.pre = ab.pre UNION ALL SELECT pl.* EXCLUDE (path), -1, '', false FROM pl WHERE pre < 0),
     co AS (SELECT doc_id, coalesce(regexp_replace(string_split(arg_max(file_path, (registered_at, file_path)), '/')[-1], '[^a-zA-Z0-9._-]', '_', 'g'), doc_id) AS document FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
     bl AS (SELECT un.*, coalesce(co.document, un.doc_id) AS document, CASE WHEN fits THEN 0 ELSE sum((type = 'section_header' AND heading_type = 'nottoc')::INT) OVER w END::BIGINT AS block,
       CASE WHEN fits THEN 0 ELSE atomic_order - coalesce(last_value(CASE WHEN type = 'section_header' AND heading_type = 'nottoc' THEN atomic_order END IGNORE NULLS) OVER w, min(atomic_order) OVER (PARTITION BY un.doc_id, top, fits)) END // 4096 AS stretch
       FROM un LEFT JOIN co USING (doc_id) WINDOW w AS (PARTITION BY un.doc_id, top, fits ORDER BY atomic_order, id)),
     ba AS (SELECT bl.*, coalesce(content, '') AS c, coalesce(heading_type, '') AS head, coalesce(description, '') AS descr, {sql_incomplete('content', X.DANGLING)} AS inc, coalesce(p.ps, []) AS ps, fits OR sum(size) OVER (PARTITION BY doc_id, top, fits, block, stretch) <= 600 AS whole, sum(size) OVER (PARTITION BY doc_id, top, fits, block, stretch) AS total, atomic_order::INT AS o FROM bl LEFT JOIN p USING (id)),
     gr AS (SELECT doc_id, top, fits, block, stretch, document, any_value(total)::INT AS total, any_value(whole) AS whole, first(CASE WHEN type = 'section_header' AND length({label}) <= 300 THEN {label} ELSE '' END ORDER BY o, id) AS label, any_value(path) AS path, list({unit.replace("'size': size", "'size': size::INT")} ORDER BY o, id) AS us FROM ba GROUP BY doc_id, top, fits, block, stretch, document),
     fd AS (SELECT *, list_reduce(list_prepend({zero}, us), lambda a, x: {step}) AS z FROM gr),
     ou AS (SELECT *, {last} AS cs FROM fd),
     ck AS (SELECT doc_id, top, block, stretch, document, CASE WHEN fits OR label = '' OR ends_with(path, label) THEN path WHEN path <> '' THEN path || ' > ' || label ELSE label END AS section, whole, total, unnest(list_transform(cs, lambda q, k: {{'q': q, 'k': k}})) AS e FROM ou),
     cu AS (SELECT *, document || '__chunk_' || e.q.first || '_' || e.q.last || CASE WHEN e.q.part >= 0 THEN '_part_' || e.q.part ELSE '' END AS cid FROM ck WHERE {sql_strip('e.q.text')} <> '' OR len(e.q.images) > 0),
     cn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, top, block, stretch, cid ORDER BY e.k) - 1 AS again FROM cu),
     chunk AS (SELECT CASE WHEN again > 0 THEN cid || '_' || again ELSE cid END AS chunk_id, doc_id, document, CASE WHEN section = '' THEN 'General' ELSE section END AS section, CASE WHEN whole THEN total ELSE e.q.tokens END AS token_count, e.q.text AS text, e.q.images AS images, e.q.first AS first_order, e.q.last AS last_order FROM cn)"""


CHUNKS = _pack_sql()


@core(f"WITH {CHUNKS} SELECT * REPLACE (array_to_string(images, chr(10)) AS images) FROM chunk")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical-semantic chunks, their images one a line."""
    return hsf(spark, sf_dir).withColumn("images", F.array_join("images", "\n"))


@core(f"""WITH {CHUNKS}, nx AS (SELECT *, lead(chunk_id) OVER w AS b, lead(text) OVER w AS tb, lead(token_count) OVER w AS nb, lead(images) OVER w AS ib FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY first_order, chunk_id)),
 mg AS (SELECT *, regexp_extract(chunk_id, '^(.*__chunk_)(\\d+)_(\\d+)$', 1) AS p, regexp_extract(chunk_id, '^(.*__chunk_)(\\d+)_(\\d+)$', 2) AS s, regexp_extract(b, '^(.*__chunk_)(\\d+)_(\\d+)$', 3) AS e FROM nx WHERE b IS NOT NULL)
 SELECT doc_id, CASE WHEN p <> '' AND e <> '' THEN p || s || '_' || e ELSE chunk_id || '__merged__' || b END AS chunk_id, text || chr(10) || chr(10) || tb AS text, (token_count + nb)::INT AS token_count, len(images) + len(ib) AS n_images FROM mg""")
def merge_chunk_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every semantic chunk merged with the one that follows it in its document."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("first_order", "chunk_id")
    c = hsf(spark, sf_dir)
    after = F.struct("chunk_id", "text", "token_count", "images")
    pairs = c.withColumn("b", F.lead(after).over(w)).where("b is not null")
    m = pairs.select("doc_id", C.merge_chunks(F.struct("chunk_id", "text", "token_count", "images"), F.col("b")).alias("m"))
    return m.select("doc_id", "m.chunk_id", "m.text", "m.token_count", F.size("m.images").cast("bigint").alias("n_images"))


_CLEAN = f"CASE WHEN section IN ('', ' > ') THEN 'General' ELSE {sql_strip("regexp_replace(section, '^( > )+', '')")} END"


INDEX = f"""WITH {CHUNKS}, po AS (SELECT *, {_CLEAN} AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY first_order, chunk_id) - 1 AS i FROM chunk), ix AS (SELECT *, '[SECTION]: ' || sec || chr(10) || '[CONTENT]: ' || text AS stored, list_transform(images, lambda g, k: 'img' || (k - 1) || '_' || chunk_id || '_' || i) AS ids FROM po)
 SELECT chunk_id || '_' || i AS id, doc_id, document, sec AS section, token_count, chunk_id, text AS text_content, array_to_string(ids, chr(10)) AS images, stored || CASE WHEN len(ids) > 0 THEN chr(10) || '[FIGURE_DESCRIPTIONS]' || chr(10) || array_to_string(list_transform(ids, lambda g, k: '[' || (k - 1) || '] ' || chr(10)), '') ELSE '' END AS search_content FROM ix"""


@core(INDEX)
def build_index_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records of the semantic chunks: section, stored text, image ids, embedded text."""
    return index(spark, sf_dir).withColumn("images", F.array_join("images", "\n"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.index_data(hsf(spark, sf_dir))


@core(f"WITH l AS ({LATEST}), {_split_sql()}, k AS (SELECT p.id, (generate_subscripts(ps, 1) - 1)::INT AS k, unnest(ps) AS text FROM p JOIN l ON l.id = p.id WHERE type = 'text' UNION ALL SELECT id, 0, content FROM l WHERE coalesce(type, '') <> 'text' AND length(content) > 0) SELECT id, k, text, {sql_tokens('text')} AS token_count FROM k")
def fixed_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in overlapping parts of bounded size, elements of other types as one part each."""
    rows = latest(spark, sf_dir).select("id", "type", "content")
    other = rows.where((F.coalesce("type", F.lit("")) != "text") & (F.length("content") > 0))
    return I.text_parts(rows.where("type = 'text'")).unionByName(other.select("id", F.lit(0).alias("k"), F.col("content").alias("text"), X.token_count(F.col("content")).alias("token_count")))
