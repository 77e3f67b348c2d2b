"""Text cut off by field limits: a backward character n-gram model of how values end.

For the final context of every value, its last 1 to 6 characters read backwards, the model knows from all values of the
same column how often that context ends a value and how often text goes on after it. The log-odds of ending
against continuing, taken at the longest context seen often enough and without the value's own ending, is low where
a value stops in the middle of something. In tables every bar is read as the number of bars its row still lacks, so that
the model tells a complete row from one with missing cells. A mark of the stop (an ellipsis, a lost character) after an
open sentence is a feature that lowers the log-odds by ``MARK``. Every case has a log-odds below the threshold of its
language and column, which lies where the histogram of log-odds, in steps of ``STEP``, is emptiest.

What keeps a low log-odds from being a case: a line that is a title, a list item, page furniture, or a pointer whose
label (as "Read next:") hardly ever ends with a final mark, provided that its last word is whole; a next text element of the
document that goes on in the middle of a sentence; a final mark; a complete last row.

Contexts, labels and the words that begin sentences are hashed into tables of ``BUCKETS`` entries, so the model's size and
what reaches the driver do not depend on the corpus. Counts cover all rows. The next element is found over stretches of
``STRETCH`` places, so a document of any size is spread over tasks.

Defined results: null or blank contents and null ids are never cases; of a repeated id the latest row gives its place; texts are
read whole; empty tables give no rows; a document without a source counts under a null source in the report.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.scans import _HIDDEN, sample_lines, train_furniture, without_furniture
from leafmill.runtime import cut, merged

TYPES = ("text", "footnote", "table")
LANGS = ("en", "vi", "fr", "es", "de")
ORDERS = (1, 2, 3, 4, 6)
BUCKETS = 1 << 18
STRETCH = 256
ENOUGH = 20
MARK = 8.0
STEP = 0.25
_MARK = re.compile(r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|�+)\s*$")
_FINAL = set(".?!:;)]}”»\"'．？！：；）］。|")
_STOP = set(".?!．？！。")
_VI = re.compile("[ăđơưạ-ỹ]", re.I)
_LABEL = re.compile(r"(?:^|[.?!…:]\s+|\n)\s*([^\W\d_][^.:?!\n|]{1,30}):\s")
_UPPER = "".join(c for c in map(chr, range(0x41, 0x1F00)) if c.isupper() and (ord(c) < 0x250 or ord(c) >= 0x1E00))
_CAPITAL = re.compile(f"[{_UPPER}][^\\W\\d_]+")
_HEAD = re.compile(f"(?:^|[.?!:…]\\s+|\\n\\s*)[¿¡“„«\"(]*([{_UPPER}][^\\W\\d_]+)")
_SPLIT = re.compile(r"[-‐¬\u00ad][ \t]*\n[ \t]*")
_LIST = re.compile(r"^\s*(?:#{1,6}\s|[-*•]\s|\d+(?:\.\d+)*\.?\s+[^\W\d_])")
#: Frequent function words by which languages are told apart.
_FUNCTION = {"en": (" the ", " and ", " that ", " of "), "fr": (" les ", " et ", " des ", " la "), "es": (" los ", " y ", " que ", " el "), "de": (" die ", " und ", " der ", " den ")}
_BASE = np.uint64(1_000_003)


def language(text: str) -> int:
    if _VI.search(text):
        return LANGS.index("vi")
    t = f" {text.lower()} "
    best = max(_FUNCTION, key=lambda k: (sum(t.count(w) for w in _FUNCTION[k]), k == "en"))
    return LANGS.index(best)


_ALPHA: list[np.ndarray] = []


def shape(text: str) -> str:
    """What the model reads: lower case, single blanks, broken words whole."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "\n" in text:
        text = _SPLIT.sub("", text)
    return " ".join(text.lower().split())


def tail_shape(text: str) -> str:
    """The end of the shape, as much as contexts need."""
    return shape(text.rstrip()[-64:])[-max(ORDERS) - 1 :]


def table_shape(text: str, last: bool = False) -> str:
    """What the model reads of a table: its shape with every bar as a sign for the bars still due in its row; or the last rows' end."""
    rows = [r for r in text.strip().split("\n") if r.strip()]
    cells = rows[0].count("|")
    out = []
    for row in rows[-2:] if last else rows:
        parts = row.split("|")
        out.append(parts[0] + "".join(chr(0xE000 + max(0, cells - k)) + p for k, p in enumerate(parts[1:], 1)))
    done = shape("\n".join(out))
    return done[-max(ORDERS) - 1 :] if last else done


def is_grid(text: str) -> bool:
    return text.lstrip().startswith("|")


def slot(word: str) -> int:
    """The place of a label or word in the hashed tables."""
    return xxhash.xxh3_64_intdigest(word) & (BUCKETS - 1)


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _ALPHA[0]


def _codes(s: str) -> np.ndarray:
    """Characters as numbers, digits alike."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 49) & (c <= 57), 48, c).astype(np.uint64)


def last_contexts(s: str) -> list[int]:
    """The buckets of ``contexts`` at the last place, order by order, without arrays."""
    h, out = 0, []
    for n in range(1, max(ORDERS) + 1):
        c = ord(s[-n]) if n <= len(s) else 0
        h = (h * 1_000_003 + (48 if 49 <= c <= 57 else c)) & 0xFFFFFFFFFFFFFFFF
        if n in ORDERS:
            m = (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            out.append((m >> 40) & (BUCKETS - 1))
    return out


def contexts(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each order the bucket of the context that ends at each place; before the start stands 0."""
    out, h = {}, np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        back = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]]) if n > 1 else codes
        h = h * _BASE + back[: len(codes)]
        if n in ORDERS:
            m = h ^ (h >> np.uint64(31))
            m = m * np.uint64(0x9E3779B97F4A7C15)
            out[n] = ((m >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return out


def open_end(text: str) -> tuple[str, bool]:
    """The text without a mark of its stop, and whether one stood there."""
    text = text.rstrip()
    m = _MARK.search(text[-24:])
    return (text[: max(0, len(text) - 24) + m.start()].rstrip(), True) if m else (text, False)


def last_labels(text: str) -> set[str]:
    """The label of the last sentence, if it has one: after the last final mark, or on the last line."""
    text = text.rstrip()
    last = text[max(text.rfind(c) for c in ".?!…") + 1 :]
    out = set()
    for part in {" ".join(last.split()), last[last.rfind("\n") + 1 :]}:
        if ":" in part and (m := re.match(r"\s*([^\W\d_][^.:?!|]{1,30}):\s", part)):
            out.add(shape(m[1]))
    return out


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """(type, content) of rows with something in them."""
    for ty, t in zip(b.column("type").to_pylist(), b.column("content").to_pylist(), strict=True):
        if t and not t.isspace():
            yield TYPES.index(ty), t


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: Counter = Counter()
    labels: Counter = Counter()
    for b in batches:
        for ty, t in _pieces(b):
            body, marked = open_end(t)
            if marked or not body.strip():
                continue
            s = table_shape(body, True) if TYPES[ty] == "table" and is_grid(body) else tail_shape(body)
            if not s:
                continue
            for k, bucket in enumerate(last_contexts(s)):
                ends[ty * len(ORDERS) + k, bucket] += 1
            if s[-1] not in _FINAL:
                labels.update(map(slot, last_labels(body)))
    rows = [(k, b, v) for (k, b), v in ends.items()] + [(LABELS, k, v) for k, v in labels.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["tab", "bucket", "n"])


#: Numbers of the hashed tables behind those of the contexts: labels, and words that begin sentences.
LABELS = len(TYPES) * len(ORDERS)
WORDS = LABELS + 1


class Model:
    """End, continuation and word-break counts of the contexts that end values, in hashed tables of fixed size."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray):
        """``keys``: table times BUCKETS plus bucket, sorted."""
        self.keys, self.ends = keys, ends
        self.total, self.breaks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        self.labels, self.label_total = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        self.words, self.heads = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        self.furniture = None
        self._tables: dict[int, np.ndarray] = {}

    def table(self, t: int) -> np.ndarray:
        """Bucket to place in the counts, -1 where the context ends nothing."""
        if t not in self._tables:
            tab = np.full(BUCKETS, -1, np.int64)
            lo, hi = np.searchsorted(self.keys, [t * BUCKETS, (t + 1) * BUCKETS])
            tab[self.keys[lo:hi] - t * BUCKETS] = np.arange(lo, hi)
            self._tables[t] = tab
        return self._tables[t]

    def __getstate__(self):
        return self.__dict__ | {"_tables": {}}

    def pointer(self, label: str) -> bool:
        """Whether sentences of this label hardly ever end with a final mark."""
        k = slot(label)
        return self.labels[k] >= max(2, 0.5 * max(self.label_total[k], 1))

    def begins(self, word: str) -> float:
        """The share of a capitalised word's occurrences that begin a sentence; 1 if it is rare."""
        k = slot(word)
        return self.heads[k] / self.words[k] if self.words[k] >= 5 else 1.0

    def odds(self, s: str, ty: int, unseen: float = 0.5) -> tuple[float, bool]:
        """Log-odds of ending here without the value's own end, and whether the last word may be whole.

        ``unseen`` stands for continuations where even the shortest context was hardly met.
        """
        ctx = last_contexts(s)
        out, whole, found = 0.0, False, False
        for k in range(len(ORDERS) - 1, -1, -1):
            i = self.table(ty * len(ORDERS) + k)[ctx[k]]
            if i < 0:
                continue
            go_on = self.total[i] - self.ends[i]
            if not found and go_on >= 4:
                whole, found = self.breaks[i] >= 0.02 * go_on, True
            if self.total[i] >= ENOUGH or k == 0 or self.ends[i] > 5:
                out = float(np.log(max(self.ends[i] - 1, 0) + 0.1) - np.log(go_on + (unseen if self.total[i] < ENOUGH else 0.5)))
                break
        return out, whole or not s[-1:].isalpha() and s[-1:] not in "_-"


def _totals(shared) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total, breaks = np.zeros(len(model.keys), np.int64), np.zeros(len(model.keys), np.int64)
        labels: Counter = Counter()
        caps: Counter = Counter()
        heads: Counter = Counter()
        pad = "\0" * max(ORDERS)
        for b in batches:
            groups: dict[int, list[str]] = {}
            for ty, t in _pieces(b):
                body = open_end(t)[0]
                groups.setdefault(ty, []).append(table_shape(body) if TYPES[ty] == "table" and is_grid(body) else shape(body))
                if ":" in t:
                    labels.update(_LABEL.findall(t))
                if ty == 0:
                    caps.update(_CAPITAL.findall(t))
                    heads.update(_HEAD.findall(t))
            for g, texts in groups.items():
                codes = _codes(pad + pad.join(texts) + pad)
                letters, low = _letters(), np.minimum(codes, 0xFFFF).astype(np.int64)
                brk = np.concatenate([~letters[low[1:]], [True]]) & (np.concatenate([codes[1:], [0]]) > 0)
                ctx = contexts(codes)
                for k, n in enumerate(ORDERS):
                    at = model.table(g * len(ORDERS) + k)[ctx[n]]
                    ok = (at >= 0) & (codes > 0)
                    total += np.bincount(at[ok], minlength=len(total))
                    breaks += np.bincount(at[ok & brk], minlength=len(total))
        some = np.flatnonzero(total)
        known: Counter = Counter()
        for k, v in labels.items():
            known[slot(shape(k))] += v
        met, led = Counter(), Counter()
        for k, v in caps.items():
            met[slot(k)] += v
            led[slot(k)] += heads[k]
        rows = [(LABELS * BUCKETS + k, v, 0) for k, v in known.items() if model.labels[k]] + [(WORDS * BUCKETS + k, v, led[k]) for k, v in met.items()]
        cols = [np.concatenate([a, np.array([r[j] for r in rows], np.int64)]) for j, a in enumerate((model.keys[some], total[some], breaks[some]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "n", "m"])

    return work


def goes_on(head: str | None, begins: Callable[[str], float]) -> bool:
    """Whether a text begins in the middle of a sentence: in lower case, or with a word that hardly ever begins one."""
    m = re.search(r"[^\W_]+", head or "")
    if not m:
        return False
    w = m[0]
    if w[0].isdigit():
        nxt = re.search(r"[^\W\d_]+", head[m.end() :])
        return bool(nxt) and (nxt[0][0].islower() or begins(nxt[0]) < 0.05)
    return w[0].islower() or begins(w) < 0.05


def _score(shared) -> Callable:
    names = ["id", "doc_id", "type", "atomic_order", "created_at", "verdict", "log_odds", "grp", "whole", "on", "skip"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            out: list[list] = [[] for _ in names[5:]]
            texts, types = b.column("content").to_pylist(), b.column("type").to_pylist()
            clean = without_furniture([None if ty == "table" else t for t, ty in zip(texts, types, strict=True)], model.furniture)
            for ty, t, (bare, _) in zip(types, texts, clean, strict=True):
                for c, v in zip(out, judge(t, bare, TYPES.index(ty), model), strict=True):
                    c.append(v)
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names[:5]] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return work


WHOLE, ASK = 0, 1


def judge(text: str | None, clean: str | None, ty: int, model: Model) -> tuple[int, float | None, int | None, bool, bool, bool]:
    """A text and the same without furniture: (verdict, log-odds, group, last word whole, begins in mid-sentence, passed over)."""
    if not text or text.isspace():
        return WHOLE, None, None, True, False, True
    group = ty * len(LANGS)
    if TYPES[ty] == "table":
        body, marked = open_end(text)
        if is_grid(body):
            s = table_shape(body, True)
            odds = model.odds(s, ty, 4.0)[0] - MARK * marked  # a row that lacks cells goes on, were it the only table
            return WHOLE if s[-1:] == "\ue000" and not marked else ASK, odds, group + language(text), False, False, True
        clean = text
    if not clean.strip():
        return WHOLE, None, None, True, False, True
    on = goes_on(clean[:200], model.begins)
    body, marked = open_end(clean)
    s = tail_shape(body)
    if not s:
        return WHOLE, None, None, True, on, False
    if s[-1] in _FINAL and not (marked and s[-1] not in _STOP and text.rstrip()[-1:] == "�"):
        return WHOLE, None, None, True, on, False
    group += language(text)
    odds, whole = model.odds(s, ty)
    if marked:
        return ASK, odds - MARK, group, False, on, False
    if whole and any(map(model.pointer, last_labels(body))):
        return WHOLE, odds, None, whole, on, False
    if whole and "\n" not in body.strip() and _LIST.match(body):
        return WHOLE, odds, None, whole, on, False
    return ASK, odds, group, whole, on, odds > 1 and "\n" not in body.strip()


def _valley(hist: dict[int, int]) -> float:
    """Where the log-odds between the endings that are common and those that are not are fewest, over a window of one; of
    equally empty places that nearest to -2."""
    near = lambda k: sum(hist.get(k + j, 0) for j in range(-2, 2))
    return STEP * min(range(round(-4 / STEP), round(-1 / STEP) + 1), key=lambda k: (near(k), abs(k * STEP + 2)))


def fit(elements: DataFrame) -> Model:
    """The model; what comes to the driver are hashed tables, of BUCKETS entries at most each."""
    rows = _rows(elements)
    got = rows.mapInArrow(_ends, "tab int, bucket bigint, n bigint").groupBy("tab", "bucket").agg(F.sum("n").alias("n")).toArrow()
    tab, bucket, n = (got.column(c).to_numpy().astype(np.int64) for c in ("tab", "bucket", "n"))
    key, ctx = tab * BUCKETS + bucket, tab < LABELS
    order = np.argsort(key[ctx])
    model = Model(key[ctx][order], n[ctx][order])
    model.labels[bucket[~ctx]] = n[~ctx]
    sc = elements.sparkSession.sparkContext
    got = rows.mapInArrow(_totals(sc.broadcast(model)), "key bigint, n bigint, m bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    key, n, m = (got.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "m"))
    ctx = key < LABELS * BUCKETS
    at = np.searchsorted(model.keys, key[ctx])
    model.total[at], model.breaks[at] = n[ctx], m[ctx]
    model.label_total[key[key // BUCKETS == LABELS] % BUCKETS] = n[key // BUCKETS == LABELS]
    words = key // BUCKETS == WORDS
    model.words[key[words] % BUCKETS], model.heads[key[words] % BUCKETS] = n[words], m[words]
    model.furniture = train_furniture(sample_lines(elements))
    return model


def _rows(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("type").isin(*TYPES) & F.col("id").isNotNull()).select("id", "doc_id", "type", "atomic_order", "created_at", "content")


def judged(elements: DataFrame) -> DataFrame:
    """(id, doc_id, type, log_odds, threshold, truncated), one row per id."""
    model = fit(elements)
    shared = elements.sparkSession.sparkContext.broadcast(model)
    out = "id string, doc_id string, type string, atomic_order int, created_at timestamp, verdict int, log_odds double, grp int, whole boolean, on boolean, skip boolean"
    scored = cut(_rows(elements).mapInArrow(_score(shared), out))
    hist: dict[int, dict[int, int]] = {}
    step = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("log_odds"))) / STEP).cast("int")
    for g, v, n in scored.where(F.col("verdict") == ASK).groupBy("grp", step.alias("v")).count().toLocalIterator():
        hist.setdefault(g, {})[v] = n
    low = F.lit(-2.0)
    for g, h in sorted(hist.items()):
        low = F.when(F.col("grp") == g, F.lit(_valley(h))).otherwise(low)
    fields = ["created_at", "atomic_order", "verdict", "log_odds", "grp", "whole", "on", "skip", "doc_id", "type"]
    last = scored.groupBy("id").agg(F.max(F.struct(*fields)).alias("r")).select("id", *[F.col(f"r.{f}").alias(f) for f in fields if f != "created_at"])
    order = F.coalesce("atomic_order", F.lit(0))
    line = last.withColumn("o", order).withColumn("stretch", F.floor(order / STRETCH))
    counted = (F.col("type") == "text") & ~F.col("skip")
    # read backwards, the next text element is the last one met so far
    inside = W.partitionBy("doc_id", "stretch").orderBy(F.desc("o"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    ask = line.withColumn("near", F.last(F.when(counted, F.col("on")), ignorenulls=True).over(inside)).where("verdict <> 0")
    across = W.partitionBy("doc_id").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)
    firsts = line.groupBy("doc_id", "stretch").agg(F.min(F.when(counted, F.struct("o", "id", "on"))).alias("f"))
    firsts = firsts.select(F.col("doc_id").alias("n_doc"), F.col("stretch").alias("n_stretch"), F.last("f.on", ignorenulls=True).over(across).alias("far"))
    tail = ask.join(firsts, (F.col("doc_id") == F.col("n_doc")) & (F.col("stretch") == F.col("n_stretch")), "left")
    more = F.coalesce("near", "far", F.lit(False)) & F.col("whole") & (F.col("type") == "text")
    cut_off = (F.col("verdict") == ASK) & (F.col("log_odds") < low) & ~more
    found = tail.select("id", cut_off.alias("truncated")).where("truncated").select(F.col("id").alias("t_id"))
    out = merged(last, found, F.col("id") == F.col("t_id"), "left")
    return out.select("id", "doc_id", "type", "log_odds", F.when(F.col("verdict") == ASK, low).alias("threshold"), F.col("t_id").isNotNull().alias("truncated"))


def by_source(elements: DataFrame, corpus: DataFrame) -> DataFrame:
    """(source, n_elements, n_truncated, share): how often each source truncates."""
    src = corpus.where("doc_id is not null").groupBy(F.col("doc_id").alias("s_doc")).agg(F.max("source").alias("source"))
    per_doc = judged(elements).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("truncated").cast("bigint")).alias("c"))
    out = per_doc.join(src, F.col("doc_id") == F.col("s_doc"), "left").groupBy("source").agg(F.sum("n").alias("n_elements"), F.sum("c").alias("n_truncated"))
    return out.withColumn("share", F.round(F.col("n_truncated") / F.col("n_elements"), 6))
