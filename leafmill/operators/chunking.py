"""Chunk builders: blocks, assembled text, the semantic packer, fixed windows, recursive and by-title splitting.

Sequential folds run over sorted rows in Arrow groups. A group is one block of one node. A block that spans more than
``STRETCH`` places is cut there, counted from the block's own start, so a document or block of any size never comes into
one task as a whole, and the chunks of a document do not depend on where its places begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Compat, Settings
from leafmill.functions.text import DANGLING
from leafmill.operators.folds import in_groups
from leafmill.operators.hierarchy import last_before

STRETCH = 4096


# ---- plain-Python counterparts of the text functions, for use inside folds -----------------------------------------------


def tokens(text: str, s: Settings = DEFAULT) -> int:
    return max(1, int(len(text) / s.chars_per_token))


def incomplete(text: str | None) -> bool:
    t = (text or "").strip()
    if not t:
        return False
    if t[-1] not in ".!?”\"')]" and t[-1].isalnum():
        return True
    if t.split()[-1].lower() in DANGLING:
        return True
    return any(t.count(a) > t.count(b) for a, b in ("()", "[]", "{}")) or t.count('"') % 2 != 0 or t.count("“") != t.count("”")


def tail(text: str, s: Settings = DEFAULT) -> str:
    w = text.split()
    return " ".join(w[-s.overlap_words :]) if len(w) > s.overlap_words else text


def hard_split(sentence: str, s: Settings = DEFAULT) -> list[str]:
    """Words packed greedily up to the greatest size; a longer word stays whole."""
    out: list[str] = []
    for w in sentence.split():
        if out and tokens(f"{out[-1]} {w}", s) <= s.chunk_max_token:
            out[-1] += f" {w}"
        else:
            out.append(w)
    return out


def split_text(text: str, s: Settings = DEFAULT, compat: Compat = Compat()) -> list[tuple[str, int]]:
    """Sentences packed into parts of bounded size that overlap; by default no sentence is lost."""
    parts: list[str] = []
    now = ""

    def close() -> None:
        nonlocal now
        parts.append(now.strip())
        now = tail(now, s)

    for sentence in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", text))):
        if tokens(f"{now} {sentence}", s) <= s.chunk_max_token:
            now = f"{now} {sentence}"
            continue
        small = tokens(sentence, s) <= s.chunk_max_token
        if tokens(now, s) >= s.chunk_min_token:
            close()
            if small:
                if not compat.drop_flushed_sentence:
                    now = sentence if tokens(f"{now} {sentence}", s) > s.chunk_max_token else f"{now} {sentence}"
                continue
        elif small:
            now = f"{now} {sentence}"
            close()
            continue
        for piece in hard_split(sentence, s):
            if now and tokens(f"{now} {piece}", s) > s.chunk_max_token:
                close()
                if tokens(f"{now} {piece}", s) > s.chunk_max_token:
                    now = ""
            now = f"{now} {piece}"
    if now.strip():
        parts.append(now.strip())
    return [(p, tokens(p, s)) for p in parts if p]


# ---- hierarchical-semantic chunks -----------------------------------------------------------------------------------------


def block_numbers(rows: DataFrame, group: list[str], begins: Column | None = None) -> DataFrame:
    """Running number of headings outside the table of contents, or of the rows that ``begins`` marks, and the ``stretch`` of
    its block in which a row lies. Sums and starts are carried over stretches of places, so groups may be large."""
    if begins is None:
        begins = (F.col("type") == "section_header") & (F.col("heading_type") == "nottoc")
    r = rows.withColumn("_o", F.coalesce("atomic_order", F.lit(0))).withColumn("_s", F.floor(F.col("_o") / STRETCH)).withColumn("_new", F.coalesce(begins, F.lit(False)).cast("int"))
    at = F.when(F.col("_new") == 1, F.col("_o"))
    inside = W.partitionBy(*group, "_s").orderBy("_o", "id").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    sums = r.groupBy(*group, "_s").agg(F.sum("_new").alias("_n"), F.max(at).alias("_at"), F.min("_o").alias("_lo"))
    carried = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_from", F.last("_at", ignorenulls=True).over(before)).withColumn("_first", F.min("_lo").over(W.partitionBy(*group))).drop("_n", "_at", "_lo")
    out = r.withColumn("_in", F.sum("_new").over(inside)).withColumn("_start", F.last(at, ignorenulls=True).over(inside)).join(carried, [*group, "_s"])
    stretch = F.floor((F.col("_o") - F.coalesce("_start", "_from", "_first")) / STRETCH)
    return out.select(*rows.columns, (F.col("_in") + F.col("_before")).alias("block"), stretch.alias("stretch"))


def assemble(units: list[dict], compat: Compat = Compat()) -> tuple[str, list[str]]:
    """Text and images of consecutive elements: sentences that were cut go on, the rest stands on lines of its own."""
    text, images, going_on = "", [], False
    for k, u in enumerate(units):
        c, kind, head = u["content"] or "", u["type"], u["heading_type"]
        if kind == "text":
            text = text + (" " if going_on else "\n" if text else "") + c
            going_on = incomplete(c)
            continue
        if kind == "picture":
            images.append(c)
        elif kind == "section_header":
            last_of_heads = not (k + 1 < len(units) and units[k + 1]["type"] == "section_header" and units[k + 1]["heading_type"] == "main")
            if text.strip() and head == "nottoc":
                text += f"\n\n{c}"
            elif text.strip() and head == "main" and last_of_heads:
                text += ("" if compat.glue_main_heading else "\n\n") + f"# {u['description'] or ''}"
        elif c:
            text += f"\n{c}"
        going_on = False
    return text, images


def pack(units: list[dict], s: Settings = DEFAULT, compat: Compat = Compat()) -> list[dict]:
    """Chunks of a block too large for one: elements are added until the next would reach the greatest size."""
    out: list[dict] = []
    now: list[dict] = []

    def size(us: list[dict]) -> int:
        text, images = assemble(us, compat)
        return (tokens(text, s) if text else 0) + s.image_token_estimate * len(images)

    def close(us: list[dict], text: str | None = None, part: int | None = None) -> None:
        if us:
            t, images = assemble(us, compat)
            body = t if text is None else text
            out.append({"first": us[0]["atomic_order"], "last": us[-1]["atomic_order"], "part": part, "text": body, "images": images if not part else [], "tokens": (tokens(body, s) if body else 0) + s.image_token_estimate * (len(images) if not part else 0)})

    have = 0
    for u in units:
        if have + u["size"] >= s.chunk_max_token:
            if u["type"] == "text" and u["size"] >= s.chunk_max_token:
                parts = split_text(u["content"] or "", s, compat)
                lead = parts[0][0] if parts else ""
                if have < s.chunk_min_token and now and parts:
                    t, _ = assemble(now, compat)
                    close([*now, u], f"{t.strip()}\n\n{lead}".strip())
                    parts = parts[1:]
                else:
                    close(now)
                for k, (p, _) in enumerate(parts):
                    close([{**u, "type": "text"}], p, k)
                now, have = [], 0
                continue
            if have >= s.chunk_min_token:
                close(now)
                now = [u]
                have = size(now)
            else:
                now.append(u)
                close(now)
                now, have = [], 0
            continue
        now.append(u)
        have = size(now)
    close(now)
    return [c for c in out if c["text"].strip() or c["images"]]


_CHUNK = "chunk_id string, doc_id string, document string, section string, token_count int, text string, images array<string>, first_order int, last_order int"


def _chunks_of(units: list[dict], s: Settings, compat: Compat = Compat()) -> list[tuple]:
    first = units[0]
    label = re.sub(r"^#+", "", first["content"] or "").strip() if first["type"] == "section_header" else ""
    label = "" if len(label) > 300 else label
    base = first["path"] or ""
    section = base if first["fits"] or not label or base.endswith(label) else f"{base} > {label}" if base else label
    if first["fits"] or sum(u["size"] for u in units) <= s.chunk_max_token:
        text, images = assemble(units, compat)
        chunks = [{"first": first["atomic_order"], "last": units[-1]["atomic_order"], "part": None, "text": text, "images": images, "tokens": sum(u["size"] for u in units)}]
        chunks = [c for c in chunks if c["text"].strip() or c["images"]]
    else:
        chunks = pack(units, s, compat)
    rows, used = [], {}
    for c in chunks:
        cid = f"{first['document']}__chunk_{c['first']}_{c['last']}" + (f"_part_{c['part']}" if c["part"] is not None else "")
        used[cid] = used.get(cid, -1) + 1
        rows.append((cid if not used[cid] else f"{cid}_{used[cid]}", first["doc_id"], first["document"], section or "General", int(c["tokens"]), c["text"], c["images"], int(c["first"]), int(c["last"])))
    return rows


def semantic_chunks(units: DataFrame, s: Settings = DEFAULT, compat: Compat = Compat()) -> DataFrame:
    """Chunks of units (id, doc_id, document, top, path, fits, type, heading_type, description, content, atomic_order, size).

    ``top`` is the emitted node and ``fits`` says that it makes one chunk; otherwise its blocks are chunked one by one.
    """
    return chunks_of_blocks(blocks(units.withColumn("atomic_order", F.coalesce("atomic_order", F.lit(0)))), s, compat)


def blocks(units: DataFrame, begins: Column | None = None) -> DataFrame:
    """Units (id, doc_id, top, fits, atomic_order, ...) with the block and stretch they are chunked in; their texts are not asked for."""
    small = units.where("fits").withColumn("block", F.lit(0).cast("bigint")).withColumn("stretch", F.lit(0).cast("bigint"))
    return small.unionByName(block_numbers(units.where("not fits"), ["doc_id", "top"], begins))


def chunks_of_blocks(units: DataFrame, s: Settings = DEFAULT, compat: Compat = Compat()) -> DataFrame:
    return in_groups(units, ["doc_id", "top", "block", "stretch"], ["atomic_order", "id"], lambda rows: _chunks_of(rows, s, compat), _CHUNK)


def merge_chunks(a: Column, b: Column) -> Column:
    """Two chunks (chunk_id, text, token_count, images) as one: the range of ids from the first's beginning to the second's end."""
    shape = r"^(.*__chunk_)(\d+)_(\d+)$"
    spliced = F.concat(F.regexp_extract(a["chunk_id"], shape, 1), F.regexp_extract(a["chunk_id"], shape, 2), F.lit("_"), F.regexp_extract(b["chunk_id"], shape, 3))
    both = a["chunk_id"].rlike(shape) & b["chunk_id"].rlike(shape)
    name = F.when(both, spliced).otherwise(F.concat(a["chunk_id"], F.lit("__merged__"), b["chunk_id"]))
    return F.struct(name.alias("chunk_id"), F.concat(a["text"], F.lit("\n\n"), b["text"]).alias("text"), (a["token_count"] + b["token_count"]).alias("token_count"), F.concat(a["images"], b["images"]).alias("images"))


# ---- fixed windows --------------------------------------------------------------------------------------------------------


def fixed_windows(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(doc_id, k, start, text): overlapping character windows over each document."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(s.step_chars))
    at = docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("k", "start"))
    return at.select("doc_id", "k", "start", F.col("text").substr(F.col("start") + 1, F.lit(s.window_chars)).alias("text"))


def fixed_document_split(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(doc_id, k, text): windows of documents of one batch; a last window shorter than the overlap goes into the one before."""
    led = docs.where(F.col("text").isNotNull()).select("doc_id", F.concat(F.lit(" "), "text").alias("text"))
    n = F.floor((F.length("text") - 1) / s.step_chars) + 1
    rest = F.length("text") - (n - 1) * s.step_chars
    w = led.withColumn("n", n).withColumn("rest", rest).withColumn("kept", F.when((F.col("n") > 1) & (F.col("rest") < s.overlap_chars), F.col("n") - 1).otherwise(F.col("n")))
    at = w.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("kept") - 1)).alias("k"))
    piece = F.col("text").substr((F.col("k") * s.step_chars + 1).cast("int"), F.lit(s.window_chars))
    last = F.col("text").substr(((F.col("n") - 1) * s.step_chars + 1).cast("int"), F.lit(s.window_chars))
    joined = (F.col("k") == F.col("kept") - 1) & (F.col("kept") < F.col("n"))
    return at.select("doc_id", F.col("k").cast("int").alias("k"), F.when(joined, F.concat(piece, F.lit(" "), last)).otherwise(piece).alias("text"))


def split_batches(batches: list[str], s: Settings = DEFAULT) -> list[str]:
    """The same for a document that comes in batches: a short last window of one is carried into the next."""
    out: list[str] = []
    carry = ""
    for text in batches:
        full = f"{carry} {text}"
        windows = [full[a : a + s.window_chars] for a in range(0, len(full), s.step_chars)]
        carry = windows.pop() if windows and len(windows[-1]) < s.overlap_chars else ""
        out += windows
    if carry:
        if out and len(carry) < s.overlap_chars:
            out[-1] += f" {carry}"
        else:
            out.append(carry)
    return out


# ---- recursive and by-title splitting -------------------------------------------------------------------------------------


def recursive_split(text: str, size: int = 2136, overlap: int = 285, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Text split at the coarsest separator it holds, pieces too large at finer ones, neighbours merged up to ``size``."""
    sep, finer = next(((x, separators[k + 1 :]) for k, x in enumerate(separators) if not x or x in text), ("", ()))
    pieces = text.split(sep) if sep else list(text)
    out: list[str] = []
    fit: list[str] = []

    def merge() -> None:
        now: list[str] = []
        n = 0
        for p in fit:
            if now and n + len(p) + len(sep) > size:
                out.append(sep.join(now).strip())
                while now and (n > overlap or n + len(p) + len(sep) > size):
                    n -= len(now[0]) + (len(sep) if len(now) > 1 else 0)
                    now.pop(0)
            n += len(p) + (len(sep) if now else 0)
            now.append(p)
        if now:
            out.append(sep.join(now).strip())
        fit.clear()

    for p in pieces:
        if not p:
            continue
        if len(p) <= size:
            fit.append(p)
            continue
        merge()
        out += recursive_split(p, size, overlap, finer) if finer else [p]
    merge()
    return [x for x in out if x]


def recursive_chunks(docs: DataFrame, size: int = 2136, overlap: int = 285) -> DataFrame:
    """(doc_id, k, text, token_count): recursive splitting of every document, in Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ks, texts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, piece in enumerate(recursive_split(t, size, overlap)):
                    ids.append(i)
                    ks.append(k)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(texts, pa.string()), pa.array([tokens(t) for t in texts], pa.int32())], names=["doc_id", "k", "text", "token_count"])

    return docs.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, "doc_id bigint, k int, text string, token_count int")


def title_chunks(rows: DataFrame, most: int = 3000, soft: int = 2400, combine: int = 500) -> DataFrame:
    """(doc_id, block, stretch, section, k, text): elements between titles, joined to chunks of about ``soft`` and at most ``most`` characters.

    Sections shorter than ``combine`` are joined with the next. ``rows``: (doc_id, id, atomic_order, type, content). A block begins at a
    title that surely begins a section, since ``combine`` characters stand between it and the title before; blocks are folded
    by themselves, cut after STRETCH places.
    """
    r = rows.where(F.col("content").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "id", F.coalesce("atomic_order", F.lit(0)).alias("atomic_order"), (F.col("type") == "section_header").alias("title"), "content")
    r = r.withColumn("title", F.coalesce("title", F.lit(False)))
    # characters up to each row, carried over stretches of places; at a title, those since the title before
    flow = r.select("doc_id", "id", F.col("atomic_order").alias("o"), "title", F.length("content").cast("bigint").alias("n")).withColumn("s", F.floor(F.col("o") / STRETCH))
    inside = W.partitionBy("doc_id", "s").orderBy("o", "id").rowsBetween(W.unboundedPreceding, 0)
    sums = flow.groupBy(F.col("doc_id").alias("b_doc"), F.col("s").alias("b_s")).agg(F.sum("n").alias("m"))
    sums = sums.select("b_doc", "b_s", F.coalesce(F.sum("m").over(W.partitionBy("b_doc").orderBy("b_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b4"))
    upto = flow.withColumn("in", F.sum("n").over(inside)).join(sums, (F.col("doc_id") == F.col("b_doc")) & (F.col("s") == F.col("b_s"))).select("doc_id", "id", "o", "title", (F.col("in") + F.col("b4") - F.col("n")).alias("before"))
    titles = last_before(upto.where("title").withColumn("mine", F.col("before")), "doc_id", "mine", "last")
    sure = titles.where(F.col("before") - F.coalesce("last", F.lit(0)) >= combine).select(F.col("id").alias("t_id"), F.lit(True).alias("sure"))
    blocks = block_numbers(r.join(sure, F.col("id") == F.col("t_id"), "left").drop("t_id"), ["doc_id"], F.col("sure"))

    def work(units: list[dict]) -> list[tuple]:
        sections: list[list[str]] = [[]]
        for u in units:
            if u["title"] and sum(map(len, sections[-1])) >= combine:
                sections.append([])
            sections[-1].append(u["content"])
        out = []
        for sec, texts in enumerate(sections):
            k, now = 0, ""
            for t in texts:
                for p in (t[a : a + most] for a in range(0, len(t), most)) if len(t) > most else (t,):
                    if now and (len(now) + 2 + len(p) > most or len(now) >= soft):
                        out.append((sec, k, now))
                        k, now = k + 1, ""
                    now = f"{now}\n\n{p}" if now else p
            if now.strip():
                out.append((sec, k, now))
        return [(units[0]["doc_id"], units[0]["block"], units[0]["stretch"], *x) for x in out]

    return in_groups(blocks.drop("sure"), ["doc_id", "block", "stretch"], ["atomic_order", "id"], work, "doc_id string, block bigint, stretch bigint, section int, k int, text string")
