"""Joining texts that were cut, as a batch and over a stream of element batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.chunking import incomplete, tokens
from leafmill.operators.hierarchy import last_before

OUT = "id string, doc_id string, atomic_order int, type string, content string, token_count int, n_joined int"


class Buffer:
    """Elements of one document in order; a text goes into the nearest earlier text that is cut, never across a heading."""

    def __init__(self, held: list[dict] | None = None):
        self.held = held or []

    def add(self, e: dict) -> None:
        if e["type"] == "text" and (e["content"] or "").strip():
            for h in reversed(self.held):
                if h["type"] == "section_header":
                    break
                if h["type"] == "text" and h["open"]:
                    h["content"] = f"{h['content']} {e['content']}"
                    h["n_joined"] += 1
                    h["open"] = incomplete(e["content"])
                    return
        self.held.append({**e, "open": e["type"] == "text" and incomplete(e["content"]), "n_joined": 0})

    def flush(self, above: int = 0, most: int | None = None) -> list[dict]:
        """Take out elements once more than ``above`` are held and none of those held can still grow."""
        if len(self.held) <= above:
            return []
        last = max((k for k, h in enumerate(self.held) if h["type"] == "section_header"), default=-1)
        open_at = next((k for k, h in enumerate(self.held) if k > last and h["open"]), len(self.held))
        n = min(open_at, most if most is not None else open_at)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def rest(self) -> list[dict]:
        out, self.held = self.held, []
        return out


def _rows(done: list[dict], doc: str) -> pd.DataFrame:
    cols = ["id", "doc_id", "atomic_order", "type", "content", "token_count", "n_joined"]
    return pd.DataFrame([(e["id"], doc, e["atomic_order"], e["type"], e["content"], tokens(e["content"] or ""), e["n_joined"]) for e in done], columns=cols)


def stitch(elements: DataFrame) -> DataFrame:
    """The batch form, without a fold: a text goes on with the text before it, of the same heading, if that one is cut.

    A joined text is cut if its last part is, so whether a text joins depends on its predecessor alone; two running values
    per row, carried over stretches of places, find the text it joins, wherever that stands. Only texts that are
    joined are collected.
    """
    rows = elements.where("doc_id is not null and id is not null").select("id", "doc_id", F.coalesce("atomic_order", F.lit(0)).cast("int").alias("o"), F.coalesce("type", F.lit("")).alias("type"), "content")
    full = (F.col("type") == "text") & (X.strip(F.coalesce("content", F.lit(""))) != "")
    state = F.when(F.col("type") == "section_header", False).when(full, X.is_text_incomplete(F.col("content")))
    narrow = rows.select("id", "doc_id", "o", full.alias("full"), state.alias("cut"))
    flow = last_before(narrow, "doc_id", "cut", "open")
    joins = F.col("full") & F.coalesce("open", F.lit(False))
    heads = flow.withColumn("joins", joins).withColumn("head", F.when(F.col("full") & ~joins, F.col("id")))
    led = last_before(heads.select("id", "doc_id", "o", "joins", "head"), "doc_id", "head", "into").where("joins").select(F.col("id").alias("j_id"), "into")
    met = rows.join(led, F.col("id") == F.col("j_id"), "left").select("*", F.coalesce("into", "id").alias("to"))
    parts = met.where("into is not null").groupBy(F.col("to").alias("h_id")).agg(F.sort_array(F.collect_list(F.struct("o", "id", "content"))).alias("parts"))
    out = met.where("into is null").join(parts, F.col("id") == F.col("h_id"), "left")
    text = F.when(F.col("parts").isNotNull(), F.concat_ws(" ", "content", F.array_join(F.transform("parts", lambda x: x["content"]), " "))).otherwise(F.col("content"))
    done = out.select("id", "doc_id", F.col("o").alias("atomic_order"), "type", text.alias("content"), F.coalesce(F.size("parts"), F.lit(0)).alias("n_joined"))
    return done.select("id", "doc_id", "atomic_order", "type", "content", X.token_count(F.coalesce("content", F.lit(""))).alias("token_count"), "n_joined")


def stitch_stream(elements: DataFrame, above: int = 100, most: int = 200) -> DataFrame:
    """The same over a stream: per document the buffer is the state, flushed as it fills; a null id ends a document.

    Batches of a document must arrive in order, as a parser writes them.
    """
    fields = ("id", "atomic_order", "type", "content", "open", "n_joined")
    state = "held array<struct<id:string,atomic_order:int,type:string,content:string,open:boolean,n_joined:int>>"

    def work(key: tuple, pdfs: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        buf = Buffer([dict(zip(fields, h, strict=True)) for h in (st.get[0] if st.exists else [])])
        got = pd.concat(list(pdfs)).sort_values(["atomic_order", "id"], na_position="last")
        done = []
        for e in got.astype(object).where(got.notna(), None).to_dict("records"):
            if e["id"] is None:
                done += buf.rest()
            else:
                buf.add({k: e[k] for k in ("id", "atomic_order", "type", "content")})
                done += buf.flush(above, most)
        st.update(([tuple(h[f] for f in fields) for h in buf.held],))
        yield _rows(done, key[0])

    return elements.groupBy("doc_id").applyInPandasWithState(work, OUT, state, "append", "NoTimeout")


def insert_ignore_sink(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends only rows whose key is new; replays of a batch change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        from leafmill.sinks.stores import add_new

        add_new(batch, path, key, order)

    return write
