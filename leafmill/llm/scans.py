"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

Three models, each fitted on the driver on bounded samples, decide; everything they are applied to and every count behind
them covers all rows.

* Furniture: a boosted classifier of lines within their pair of neighbours. Positives are the rows typed as page headers and
  footers, and such rows with other numbers and other titles of the corpus put in; negatives are lines of the other
  types, from which a first fit takes out the furniture among them. Hand-written shapes stand in only where a corpus has
  fewer than ``FEW`` such rows.
* Joins: a boosted classifier of line pairs, on how often the parts, their join and their hyphenated form occur.
* Misread words: every word form has a skeleton, which no confusion of characters changes (``m`` and ``rn`` both read r-r-i),
  so an equal-join of forms and frequent words by skeleton retrieves every word that confusions lead to, however many and
  wherever they are. Beside these, an inverted join over gapped q-grams (the word with one place left open) retrieves
  words that differ by one character outside the table. A boosted ranker judges (form, candidate) by the cost of the errors
  between them, q-grams in common, frequencies, and how often the corpus shows the same replacement; it is trained on
  frequent words damaged at random.

The words themselves stay in tables: nothing that grows with the vocabulary reaches the driver or is broadcast. Elements are
matched with misread forms through a bit table of fixed size first and exactly, by a join, after that.

Defined results: null contents are never cases and stay null; empty contents stay empty; null ids are left out; repeated rows
count once per id; image data and formulas, told by their content whatever the type, are no words and are left alone; texts
are read whole; empty tables give no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.gbt import Boosted
from leafmill.runtime import cut, merged

#: Readings that optical character recognition confuses, (true, read).
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("a", "o"), ("i", "!"), ("n", "ri"), ("o", "0"), ("s", "5"), ("l", "1"), ("d", "cl"), ("u", "ii"), ("m", "rn"),
    ("h", "li"), ("g", "9"), ("b", "6"), ("f", "t"), ("ti", "h"), ("li", "h"), ("w", "vv"), ("z", "2"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("i", "1"),
)
HYPHENS = "-‐¬­"
SAMPLE = 3_000
FEW = 60
BITS = 1 << 23
LEAST = 8
RATIO = 12
SHARE = 0.012
_WORD = re.compile(r"[^\W_]+(?:!+[^\W_]+)*|![^\W\d_]{2,}")
_JOINT = re.compile(rf"(?<=\w)[{HYPHENS}][ \t]*\n[ \t]*(?=[^\W\d_])")
_LATIN = re.compile(r"[a-z0-9!ß-öø-ɏḀ-ỿ]+")
_HIDDEN = re.compile("[​-‏⁠-⁤﻿]")
_BREAK = re.compile(rf"([^\W\d_!]+)[{HYPHENS}][ \t]*\n[ \t]*([^\W\d_]+)")
_FINAL = ".?!:;…)]”»|"


# ---- furniture ----------------------------------------------------------------------------------------------------------


def line_features(line: str, before: str | None, after: str | None) -> list[float]:
    s = line.strip()
    n = max(len(s), 1)
    tokens = s.split()
    letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    upper = sum(c.isupper() for c in s)
    return [
        len(s), len(tokens), letters / n, digits / n, upper / max(letters, 1),
        bool(re.match(r"\d{1,4}\s{2,}\S", s)), bool(re.search(r"\S\s{2,}\d{1,4}$", s)), bool(re.fullmatch(r"[^\w\s]?\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*[^\w\s]?", s)),
        bool(re.fullmatch(r"[^\W\d_]+\.?\s\d{1,4}(\s[^\W\d_]+\s\d{1,4})?", s)), bool(re.search(r"\S\s{2,}\|\s{2,}\S", s)), bool(re.search(r"\s·\s*\d{1,4}$", s)), bool(re.match(r"\d{1,4}\s{2,}\S+\s\d{1,3}\s{2,}", s)),
        len(re.findall(r"\s{2,}", s)), s[-1:] in _FINAL, s[:1].islower(), bool(s) and s[-1].isdigit(), s[:1].isdigit(), s[:1] in "|[(#-•*",
        -1 if before is None else before.rstrip()[-1:] in _FINAL, -1 if after is None else after.lstrip()[:1].islower(),
        before is not None and before.rstrip()[-1:] in HYPHENS,
    ]


def synthetic_furniture(titles: list[str], n: int, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    titles = titles or ["Introduction", "Methods and results", "A general overview"]
    out = []
    for _ in range(n):
        p, q, t, u = r.randint(1, 400), r.randint(1, 20), r.choice(titles), r.choice(titles)
        out.append(r.choice([f"{p}    {t}", f"{t}    {p}", f"{t.upper()}    {p}", f"{t} · {p}", f"{p}  CHAPTER {q}  {t}", f"{t}  |  {q}. {u}", f"{t}  |  {q}.{q} {u}", f"{t}  |  {u}", f"{p}", f"[{p}]", f"- {p} -", f"— {p} —", f"p. {p}", f"Page {p} of {p + q}"]))
    return out


def induced_furniture(typed: list[str], titles: list[str], n: int, seed: int = 11) -> list[str]:
    """Rows of furniture with other numbers and, for the longest wording, another title in the same case."""
    r = random.Random(seed)
    out = []
    for _ in range(n if typed else 0):
        line = r.choice(typed)
        words = max(re.findall(r"[^\W\d_][^\d|·]*[^\W\d_]", line), key=len, default="")
        if len(words) > 8 and titles:
            title = r.choice(titles)
            line = line.replace(words, title.upper() if words.isupper() else title)
        out.append(re.sub(r"\d+", lambda m: str(r.randint(1, 10 ** len(m[0]) - 1)), line))
    return out


def train_furniture(rows: list[tuple[str, str]], seed: int = 11) -> Boosted:
    """rows: (type, content) of a bounded sample."""
    r = random.Random(seed)
    bare = lambda t: re.sub(r"^(#+\s*|\d+(\.\d+)*\.?\s+)", "", t).strip()
    titles = sorted({bare(c) for t, c in rows if t == "section_header" and c.strip() and "\n" not in c and not re.search(r"\s{2,}", c)})
    typed = [c for t, c in rows if t in ("page_header", "page_footer") and c.strip()]
    bad = typed + (induced_furniture(typed, titles, 3 * SAMPLE, seed) if len(typed) >= FEW else synthetic_furniture(titles, 3 * SAMPLE, seed))
    good = [line for t, c in rows if t not in ("page_header", "page_footer", "unknown_type") for line in c.split("\n") if line.strip()]
    sides = good or [""]
    x, y = [], []

    def add(line: str, label: int, alone: bool | None = None) -> None:
        alone = r.random() < 0.5 if alone is None else alone
        x.append(line_features(line, None if alone else r.choice(sides), None if alone else r.choice(sides)))
        y.append(label)

    for line in bad:
        add(line, 1)
    first = len(x)
    for line in good:
        add(line, 0)
    # furniture inside running text would be a wrong label: what a first, cautious fit takes for it goes
    kept = [True] * first + (Boosted(rounds=20).fit(np.array(x, float), np.array(y)).score(np.array(x[first:], float)) < 0).tolist() if good else [True] * first
    x, y = [v for v, k in zip(x, kept, strict=True) if k], [v for v, k in zip(y, kept, strict=True) if k]
    for line in good[:SAMPLE]:  # a gap within a sentence is no furniture either
        if gaps := [m.start() for m in re.finditer(" ", line)]:
            k = r.choice(gaps)
            add(line[:k] + "  " * r.randint(1, 2) + line[k:], 0, True)
    for p in range(1, SAMPLE // 10):  # numbered titles are not furniture
        t = r.choice(titles) if titles else "Overview"
        add(r.choice([f"{p % 20}. {t}", f"{p % 20}.{p % 9} {t}", f"### {t}", t, f"{p % 20}.{p % 9}.{p % 7} {t}"]), 0, True)
    return Boosted(rounds=40).fit(np.array(x, float), np.array(y))


# ---- joins --------------------------------------------------------------------------------------------------------------


def pair_features(left: str, right: str, n: Callable[[str], int]) -> list[float]:
    """``n`` gives the occurrences of a word."""
    a, b = left.lower(), right.lower()
    f = lambda w: np.log1p(n(w))
    return [f(a + b), f(a), f(b), len(a), len(b), right[:1].isupper(), left[:1].isupper(), left.isupper() and right.isupper(), n(f"{a}-{b}") > 0]


def train_joins(cuts: list[tuple[str, int]], counts: dict[str, int], seed: int = 5) -> Boosted:
    """Positives: words cut in two, a third of them held to be unknown as a whole; negatives: two whole words."""
    r = random.Random(seed)
    x, y = [], []
    for w, k in cuts:
        whole = 0 if r.random() < 0.33 else counts.get(w, 0)
        x.append(pair_features(w[:k], w[k:], lambda v, w=w, n=whole: n if v == w else counts.get(v, 0)))
        y.append(1)
    for _ in cuts:
        a, b = r.choice(cuts)[0], r.choice(cuts)[0]
        x.append(pair_features(a, b, lambda v: counts.get(v, 0)))
        y.append(0)
    return Boosted(rounds=40).fit(np.array(x, float).reshape(-1, 9), np.array(y))


# ---- misread words ------------------------------------------------------------------------------------------------------


def reading_cost(true: str, read: str) -> tuple[float, int]:
    """Least cost of reading one word as the other (a confusion costs 0.4, any other edit 1), and edits that are no confusion."""
    n, m = len(true), len(read)
    d = [[(99.0, 99)] * (m + 1) for _ in range(n + 1)]
    d[0][0] = (0.0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            c, e = d[i][j]
            if c > 3:
                continue
            if i < n and j < m:
                same = true[i] == read[j]
                d[i + 1][j + 1] = min(d[i + 1][j + 1], (c + (not same), e + (not same)))
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], (c + 1, e + 1))
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], (c + 1, e + 1))
            for a, b in CONFUSIONS:
                if true.startswith(a, i) and read.startswith(b, j):
                    k, p = i + len(a), j + len(b)
                    d[k][p] = min(d[k][p], (c + 0.4, e))
    return d[n][m]


#: Multi-character readings are written out, then characters that are confused share a sign.
_SPELLED = (("m", "rn"), ("d", "cl"), ("w", "vv"), ("n", "ri"), ("u", "ii"), ("h", "ii"))
_SIGNS = ("ec" + "tfil!1" + "ao0" + "s5" + "g9" + "b6" + "z2", "cc" + "iiiiii" + "ooo" + "ss" + "gg" + "bb" + "zz")


def skeleton(word: Column) -> Column:
    """Equal for any two words that confusions turn into each other; ``ti`` and ``li`` for ``h`` agree by their signs."""
    for a, b in _SPELLED:
        word = F.replace(word, F.lit(a), F.lit(b))
    return F.translate(word, *_SIGNS)


def word_features(read: str, n_read: int, true: str, n_true: int, habit: float = 0.0) -> list[float]:
    """``habit``: how much more often than by chance the corpus shows a replacement outside the table."""
    cost, foreign = reading_cost(true, read)
    q = lambda w: Counter(f"^{w}$"[k : k + 2] for k in range(len(w) + 1))
    a, b = q(read), q(true)
    both = sum((a & b).values())
    return [cost, foreign, len(read), len(true), both / max(1, sum((a | b).values())), np.log(n_true / max(n_read, 1)), np.log1p(n_true), any(c.isdigit() or c == "!" for c in read), read in true or true in read, habit]


def train_words(lexicon: dict[str, int], seed: int = 3) -> Boosted:
    """Frequent words damaged by random confusions, some by a replacement outside the table that the corpus shows to be a habit,
    against fragments, inflections, unrelated neighbours and replacements that are no habit."""
    r = random.Random(seed)
    words = sorted(w for w in lexicon if w.isalpha() and len(w) >= 2)
    x, y = [], []
    for w in r.sample(words, min(SAMPLE, len(words))):
        read = w
        for _ in range(r.choice((1, 1, 1, 2))):
            if able := [(a, b) for a, b in CONFUSIONS if a in read]:
                a, b = r.choice(able)
                k = r.choice([m.start() for m in re.finditer(re.escape(a), read)])
                read = read[:k] + b + read[k + len(a) :]
        n = lexicon[w]
        few = max(1, int(n * 10 ** r.uniform(-3.5, -1.9)))
        if read != w:
            x.append(word_features(read, few, w, n))
            y.append(1)
        k = r.randint(1, max(1, len(w) // 2))
        swapped = w[: len(w) // 2] + r.choice("abcdefghiklmnoprstuvwxyz") + w[len(w) // 2 + 1 :]
        for other in {w[:-k], w[k:], w + "s", w + r.choice(words)[0], swapped, r.choice(words)[0] + w[1:]}:
            if other and other != w and not reading_cost(w, other)[1] == 0:
                x.append(word_features(other, few, w, n, r.uniform(-3, 0.7)))
                y.append(0)
        if len(w) > 4 and swapped != w and reading_cost(w, swapped)[1]:
            x.append(word_features(swapped, few, w, n, r.uniform(1.5, 5)))
            y.append(1)
        if len(w) <= 3 and read != w and read.isalpha():  # short forms without a digit are more likely a fragment
            x += [word_features(read, few, w, n)] * 2
            y += [0, 0]
    return Boosted(rounds=50).fit(np.array(x, float).reshape(-1, 10), np.array(y))


# ---- passes -------------------------------------------------------------------------------------------------------------


def _candidates(text: str) -> list[int]:
    """Lines that could be furniture at all: every shape of it has a number at an end, a gap, or no letters."""
    out = []
    for k, line in enumerate(text.split("\n")):
        s = line.strip()
        if s and len(s) <= 160 and (s[0].isdigit() or s[-1].isdigit() or "  " in s or s[-1] in "]-–—" or len(s) < 8 and not any(c.isalpha() for c in s)):
            out.append(k)
    return out


def without_furniture(texts: list[str | None], furniture: Boosted) -> list[tuple[str | None, int]]:
    """Each text without its lines of furniture, and their number; lines of the whole batch are scored at once."""
    places: list[tuple[int, int]] = []
    rows: list[list[float]] = []
    for i, t in enumerate(texts):
        if not t or t.isspace():
            continue
        lines = None
        for k in _candidates(t):
            lines = lines or t.split("\n")
            places.append((i, k))
            rows.append(line_features(lines[k], lines[k - 1] if k else None, lines[k + 1] if k + 1 < len(lines) else None))
    gone: dict[int, set[int]] = {}
    if rows:
        for (i, k), v in zip(places, furniture.score(np.array(rows, float)), strict=True):
            if v > 0:
                gone.setdefault(i, set()).add(k)
    return [("\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) if i in gone else (t, 0) for i, t in enumerate(texts)]


def words_in(text: str) -> list[str]:
    """Lower-case word forms of running text, words broken over lines joined."""
    t = text.lower() if text.isascii() else _HIDDEN.sub("", text).lower()
    if "\n" in t:
        t = _JOINT.sub("", t)
    return _WORD.findall(t)


def proper(word: str) -> bool:
    """A Latin word; forms of other scripts and bare numbers are no matter of reading errors."""
    return not word.isdigit() and _LATIN.fullmatch(word) is not None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            c.update(words_in(t))
        if len(c) > 500_000:
            yield _counted(c)
            c = Counter()
    yield _counted(c)


def _counted(c: Counter) -> pa.RecordBatch:
    kept = [w for w in c if proper(w)]
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([c[w] for w in kept], pa.int64())], names=["word", "n"])


def _rank(model: Boosted) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*[b.column(k).to_pylist() for k in range(5)], strict=True))
            feats = [word_features(*r) for r in rows]
            # a candidate must be explained by confusions alone, or by a habit
            keep = [k for k, (r, f) in enumerate(zip(rows, feats, strict=True)) if not f[1] or r[4] > 0]
            scores = model.score(np.array([feats[k] for k in keep], float)) if keep else []
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in keep], pa.string()), pa.array([rows[k][2] for k in keep], pa.string()), pa.array(np.asarray(scores, float), pa.float64())], names=["word", "correct", "score"])

    return work


class Reader:
    """What the passes over elements need: the model of furniture and the bit table of misread forms, both of fixed size."""

    def __init__(self, furniture: Boosted, bits: np.ndarray):
        self.furniture, self.bits = furniture, bits

    def maybe(self, words: set[str]) -> set[str]:
        """The words that may be misread forms; every misread form is among them."""
        if not words:
            return words
        ws = list(words)
        at = np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64)
        ok = np.ones(len(ws), bool)
        for k in (0, 21, 42):
            p = (at >> np.uint64(k)) % np.uint64(BITS)
            ok &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return {w for w, y in zip(ws, ok, strict=True) if y}


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS // 8, np.uint8)
    for b in batches:
        at = np.array([xxhash.xxh3_64_intdigest(w) for w in b.column(0).to_pylist()], np.uint64)
        for k in (0, 21, 42):
            p = (at >> np.uint64(k)) % np.uint64(BITS)
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def bit_table(misread: DataFrame) -> np.ndarray:
    """One table of BITS bits; a few tasks fill one each, so what comes to the driver is bounded too."""
    out = np.zeros(BITS // 8, np.uint8)
    for r in misread.select("word").coalesce(8).mapInArrow(_mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(r[0], np.uint8)
    return out


def breaks(text: str | None) -> list[re.Match]:
    return list(_BREAK.finditer(text)) if text and "\n" in text else []


def _suspects(text: str, ws: list[str], maybe: set[str]) -> list[str]:
    """Words that may be misread, leaving out those that the text's own beginning or end may have cut."""
    out = maybe.intersection(ws)
    if out:
        s = text.strip()
        if ws[-1] in out and s[-1:].isalpha() and ws.count(ws[-1]) == 1 and ws[-1].isalpha():
            out.discard(ws[-1])
        if ws[0] in out and s[:1].islower() and ws.count(ws[0]) == 1 and ws[0].isalpha():
            out.discard(ws[0])
    return sorted(out)


def _look(shared) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader = shared.value
        for b in batches:
            clean = without_furniture(b.column(1).to_pylist(), reader.furniture)
            words = [words_in(t) for t, _ in clean]
            maybe = reader.maybe({w for w in set().union(*words) if proper(w)})
            rows = []
            for i, (t, n), ws in zip(b.column(0).to_pylist(), clean, words, strict=True):
                pairs, odd = sorted({f"{m[1]}\n{m[2]}" for m in breaks(t)}), _suspects(t, ws, maybe)
                if n or pairs or odd:
                    rows.append((i, n, pairs, odd))
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "furniture", "pairs", "unknown"])

    return work


def _running(elements: DataFrame) -> DataFrame:
    other = F.col("content").startswith("[FORMULA]") | F.col("content").rlike(r"^data:[a-z]+/[^,]{0,80},")
    return elements.select("id", "type", "content").where(F.col("id").isNotNull() & F.col("content").isNotNull() & ~other)


def sample_lines(elements: DataFrame) -> list[tuple[str, str]]:
    """About SAMPLE rows (type, content) of each of three kinds, chosen by a hash of the id; what reaches the driver is bounded."""
    kinds = {"furniture": ("page_header", "page_footer"), "title": ("section_header",), "running": ("text", "list_item", "footnote", "caption", "table")}
    kind = F.coalesce(*[F.when(F.col("type").isin(*v), F.lit(k)) for k, v in kinds.items()])
    rows = elements.where("id is not null and content is not null and length(content) <= 20000").select("id", "type", "content", kind.alias("kind")).where("kind is not null")
    share = {r[0]: min(1.0, SAMPLE / r[1]) for r in rows.groupBy("kind").count().collect()}
    luck = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    picked = rows.where(F.coalesce(*[F.when(F.col("kind") == k, luck < v) for k, v in share.items()], F.lit(False)))
    return [(r[0], r[1]) for r in picked.select("type", "content").toLocalIterator()]


def word_counts(running: DataFrame) -> DataFrame:
    return cut(running.select("content").mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def candidates(counts: DataFrame) -> DataFrame:
    """(word, n, c_word, c_n, habit): forms with the frequent words that they may be a reading of."""
    true = counts.where((F.col("n") >= LEAST) & (F.length("word") > 1) & ~F.col("word").rlike("[0-9!]")).select(F.col("word").alias("c_word"), F.col("n").alias("c_n"))
    seldom = (F.col("c_n") >= F.col("n") * RATIO) & (F.col("n") <= 2 + F.col("c_n") * SHARE)
    by_bones = merged(counts.withColumn("bones", skeleton(F.col("word"))), true.withColumn("c_bones", skeleton(F.col("c_word"))), (F.col("bones") == F.col("c_bones")) & (F.col("word") != F.col("c_word")) & seldom)
    first = by_bones.select("word", "n", "c_word", "c_n", F.lit(0.0).alias("habit"))
    # one place left open: rows that meet differ by the letter there alone, so no block has more rows than letters
    gapped = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.struct(F.concat(F.substring(w, F.lit(1), k - 1), F.lit("\x00"), w.substr(k + 1, F.lit(1000))).alias("gram"), w.substr(k, F.lit(1)).alias("letter")))
    long = (F.length("word") > 4) & ~F.col("word").rlike("[0-9!]")
    read = counts.where(long).select("word", "n", F.explode(gapped(F.col("word"))).alias("g"))
    frequent = true.where(F.length("c_word") > 4).select("c_word", "c_n", F.explode(gapped(F.col("c_word"))).alias("c_g"))
    near = merged(read, frequent, (F.col("g.gram") == F.col("c_g.gram")) & (F.col("word") != F.col("c_word")) & seldom)
    near = cut(near.select("word", "n", "c_word", "c_n", F.col("g.letter").alias("is"), F.col("c_g.letter").alias("was")))
    # a habit: a letter read for another in many more words than its chance as a neighbour in either direction
    shown = near.groupBy("was", "is").agg(F.count("*").alias("m"))
    back = shown.select(F.col("is").alias("b_was"), F.col("was").alias("b_is"), F.col("m").alias("b"))
    mean = shown.agg(F.coalesce(F.avg("m"), F.lit(1.0))).first()[0]
    habit = shown.join(back, (F.col("was") == F.col("b_was")) & (F.col("is") == F.col("b_is")), "left")
    habit = habit.where("m >= 20").select(F.col("was").alias("h_was"), F.col("is").alias("h_is"), F.log((F.col("m") + 1) / (4 * F.greatest(F.coalesce("b", F.lit(0)) + 1, F.lit(mean)))).alias("habit"))
    second = merged(near, habit, (F.col("was") == F.col("h_was")) & (F.col("is") == F.col("h_is"))).where("habit > 0").select("word", "n", "c_word", "c_n", "habit")
    return first.unionByName(second)


def _samples(counts: DataFrame) -> tuple[dict[str, int], list[tuple[str, int]], dict[str, int]]:
    """Frequent words chosen by a hash (at most a few times SAMPLE), some of them with a place to cut, and the counts of the parts."""
    good = counts.where((F.col("n") >= 4 * LEAST) & ~F.col("word").rlike("[0-9!]"))
    if not (size := good.count()):
        good = counts.where(~F.col("word").rlike("[0-9!]"))
        size = good.count()
    luck = F.pmod(F.xxhash64("word"), F.lit(1_000_000)) / 1_000_000
    lexicon = {r[0]: r[1] for r in good.where(luck < 2 * SAMPLE / max(size, 1)).toLocalIterator()}
    r = random.Random(5)
    cuts = [(w, r.randint(2, len(w) - 2)) for w in sorted(lexicon) if w.isalpha() and len(w) > 4][:SAMPLE]
    parts = sorted({p for w, k in cuts for p in (w, w[:k], w[k:])})
    asked = counts.sparkSession.createDataFrame([(p,) for p in parts], "p string")
    return lexicon, cuts, {x[0]: x[1] for x in asked.join(counts, F.col("p") == F.col("word")).select("p", "n").toLocalIterator()}


def fit(elements: DataFrame) -> tuple[Reader, DataFrame, Boosted, DataFrame]:
    """The models, the table of misread forms (word, correct), and the words' counts without those."""
    running = _running(elements)
    counts = word_counts(running)
    lexicon, cuts, parts = _samples(counts)
    ranked = candidates(counts).mapInArrow(_rank(train_words(lexicon)), "word string, correct string, score double").where("score > 0.01")  # even evidence is none
    misread = cut(ranked.groupBy("word").agg(F.max(F.struct("score", "correct")).alias("m")).select("word", F.col("m.correct").alias("correct")))
    right = merged(counts, misread.select(F.col("word").alias("m_word")), F.col("word") == F.col("m_word"), "left_anti")
    return Reader(train_furniture(sample_lines(running)), bit_table(misread)), misread, train_joins(cuts, parts), right


def _score_pairs(joins: Boosted) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            pairs, seen = b.column(0).to_pylist(), b.column(1).to_pylist()
            if pairs:
                x = [pair_features(*p.split("\n"), lambda v, d=dict(n or []): d.get(v, 0)) for p, n in zip(pairs, seen, strict=True)]
                kept = [p for p, v in zip(pairs, joins.score(np.array(x, float)), strict=True) if v > 0]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["broken"])

    return work


def broken_pairs(seen: DataFrame, counts: DataFrame, joins: Boosted) -> DataFrame:
    """(broken): the distinct pairs of parts around a line break, of all elements, that are one word."""
    pairs = seen.select(F.explode("pairs").alias("pair")).distinct()
    a, b = F.lower(F.split_part("pair", F.lit("\n"), F.lit(1))), F.lower(F.split_part("pair", F.lit("\n"), F.lit(2)))
    asked = pairs.select("pair", F.explode(F.array_distinct(F.array(F.concat(a, b), a, b, F.concat(a, F.lit("-"), b)))).alias("w"))
    known = merged(asked, counts.select("word", "n"), F.col("w") == F.col("word"), "left").groupBy("pair").agg(F.collect_list(F.struct("w", F.coalesce("n", F.lit(0)).alias("n"))).alias("seen"))
    return known.select("pair", F.map_from_entries("seen").alias("seen")).mapInArrow(_score_pairs(joins), "broken string")


def _evidence(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, object]:
    reader, misread, joins, counts = fit(elements)
    shared = elements.sparkSession.sparkContext.broadcast(reader)
    seen = cut(_running(elements).select("id", "content").mapInArrow(_look(shared), "id string, furniture int, pairs array<string>, unknown array<string>"))
    words = merged(seen.select("id", F.explode("unknown").alias("w")).distinct(), misread, F.col("w") == F.col("word")).select("id", "word", "correct")
    broken = merged(seen.select("id", F.explode("pairs").alias("pair")).distinct(), broken_pairs(seen, counts, joins), F.col("pair") == F.col("broken")).select("id", "broken")
    return seen, words, broken, shared


def damaged(elements: DataFrame) -> DataFrame:
    """(id, furniture, broken, misread): elements with page damage and how much of each kind."""
    seen, words, broken, _ = _evidence(elements)
    one = lambda df, k: df.select("id", *[(F.lit(1) if c == k else F.lit(0)).alias(c) for c in ("broken", "misread")], F.lit(0).alias("furniture"))
    lines = seen.where("furniture > 0").select("id", F.lit(0).alias("broken"), F.lit(0).alias("misread"), "furniture")
    every = lines.unionByName(one(broken, "broken")).unionByName(one(words, "misread"))
    return every.groupBy("id").agg(F.max("furniture").cast("int").alias("furniture"), F.sum("broken").cast("int").alias("broken"), F.sum("misread").cast("int").alias("misread"))


def _mend(shared) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader = shared.value
        for b in batches:
            out = []
            texts = [t for t, _ in without_furniture(b.column("content").to_pylist(), reader.furniture)]
            for clean, joined, fixes in zip(texts, b.column("joined").to_pylist(), b.column("fixes").to_pylist(), strict=True):
                for m in reversed(breaks(clean)):
                    if f"{m[1]}\n{m[2]}" in (joined or ()):
                        clean = clean[: m.start()] + m[1] + m[2] + clean[m.end() :]
                for wrong, right in fixes or []:
                    put = lambda m, right=right: right.upper() if m[0].isupper() and len(m[0]) > 2 else right[:1].upper() + right[1:] if m[0][:1].isupper() else right
                    clean = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", put, clean, flags=re.IGNORECASE)
                if not re.search(r"^\s*([|#*•-]|\d+\.)", clean, re.MULTILINE):
                    clean = re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", clean)
                out.append(clean)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("content"), pa.array(out, pa.string())], names=["id", "content", "repaired"])

    return work


def repaired(elements: DataFrame) -> DataFrame:
    """(id, content, repaired): the damaged elements with continuous paragraphs, whole words and no furniture.

    Only damaged elements' contents are shuffled; of unequal contents of an id the greatest holds.
    """
    seen, words, broken, shared = _evidence(elements)
    none = F.lit(None)
    every = words.select("id", F.array("word", "correct").alias("fix"), none.cast("string").alias("broken"))
    every = every.unionByName(broken.select("id", none.cast("array<string>").alias("fix"), "broken")).unionByName(seen.where("furniture > 0").select("id", none.cast("array<string>").alias("fix"), none.cast("string").alias("broken")))
    todo = every.groupBy(F.col("id").alias("t_id")).agg(F.sort_array(F.collect_set("fix")).alias("fixes"), F.collect_set("broken").alias("joined"))
    rows = merged(_running(elements).select("id", "content"), todo.select("t_id"), F.col("id") == F.col("t_id"), "left_semi").groupBy("id").agg(F.max("content").alias("content"))
    return merged(rows, todo, F.col("id") == F.col("t_id")).select("id", "content", "fixes", "joined").mapInArrow(_mend(shared), "id string, content string, repaired string")
