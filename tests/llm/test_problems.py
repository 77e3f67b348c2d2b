"""The operators of the training-data problems against brute force and edge cases, on small inputs."""

import math
import random
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm.encoding import restore
from leafmill.llm.gbt import Boosted
from leafmill.llm.mixing import fit
from leafmill.llm.packing import sum_of_squares

ELEMENT = "id string, type string, content string, token_count int, atomic_order int, description string, level int, heading_type string, path string, created_at timestamp, doc_id string, source string"
T = datetime(2024, 1, 1)


def elements(spark, rows):
    """rows: (id, type, content, token_count, atomic_order, doc_id); every table has a clashing extra column ``source``."""
    return spark.createDataFrame([(i, t, c, n, o, None, None, None, None, T, d, "clash") for i, t, c, n, o, d in rows], ELEMENT)


# ---- 1 packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=120), st.integers(1, 120))
def test_packing_is_a_packing(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    placed, made = sum_of_squares(np.array(sizes, np.int64), capacity)
    load: dict[int, int] = {}
    for size, pieces in zip(sizes, placed, strict=True):
        assert sum(n for _, n in pieces) == size
        assert len(pieces) == max(1, -(-size // capacity))
        for box, n in pieces:
            load[box] = load.get(box, 0) + n
    assert all(v <= capacity for v in load.values()) and set(load) <= set(range(made))
    assert made <= 2 * -(-sum(sizes) // capacity) + 1


def test_packing_fills_well():
    r = np.random.default_rng(1)
    sizes = np.sort(r.integers(1, 900, 5000))[::-1]
    _, made = sum_of_squares(sizes, 2000)
    assert made * 2000 <= sizes.sum() * 1.01


def test_pack(spark):
    from leafmill.llm.packing import fill_report, pack

    rows = elements(spark, [("a", "text", "x" * 100, 50, 1, "d"), ("a", "text", "x" * 100, 40, 0, "d"), ("b", "text", "y" * 700, None, 2, "d"), ("c", "text", "", 0, 3, "d"), ("e", None, None, None, None, None), (None, "text", "z", 5, 5, "d"), ("f", "text", "w w", 0, 6, "d")])
    limits = spark.createDataFrame([("small", 60), ("none", None), (None, 5)], "limit_name string, capacity int")
    got = pack(rows, limits).collect()
    by: dict[str, list] = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {"a", "b", "c", "e", "f"} and [r.tokens for r in by["a"]] == [50] and sum(r.tokens for r in by["b"]) == 196
    assert "".join(r.content for r in sorted(by["b"], key=lambda r: r.part)) == "y" * 700 and len(by["b"]) == 4
    load: dict[int, int] = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert max(load.values()) <= 60
    assert fill_report(pack(rows, limits), limits).first().tokens == 247
    assert pack(rows.limit(0), limits).count() == 0 and pack(rows, limits.limit(0)).count() == 0


# ---- 2 scanned pages and 3 truncation, on a made-up corpus

WORDS = "engine method chapter window record little number student history science reading teacher library problem picture lesson system letter matter nature answer moment garden circle winter summer animal planet source measure".split()


def sentence(r):
    return f"The {r.choice(WORDS)} {r.choice(['shows', 'holds', 'meets', 'finds'])} a {r.choice(WORDS)} and the {r.choice(WORDS)} of every {r.choice(WORDS)}."


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    rows = [(f"t{k}", "text", " ".join(sentence(r) for _ in range(6)), 50, k % 50, f"doc{k // 50}") for k in range(600)]
    rows += [(f"h{k}", "section_header", f"{k}. The {r.choice(WORDS)} of {r.choice(WORDS)}", 5, 60 + k, "doc1") for k in range(40)]
    bad = {"hy": sentence(r)[:-1] + " with a mea-\nsure of it.", "pg": sentence(r) + "\n- 12 -\n" + sentence(r), "whole": "Page 3 of 90", "head": "17    The engine of nature", "ocr": "The wi1ndow".replace("wi1", "w!") + " shows a nurnber and the c!rcle of every lesson."}
    good = {"wrap": sentence(r)[:-1].replace(" and ", "\nand ") + ".", "num": "In 1999 the record held 12 systems.", "null": None, "empty": ""}
    rows += [(k, "text", v, 50, 100, "doc99") for k, v in {**bad, **good}.items()] + [("hy", "text", bad["hy"], 50, 100, "doc99"), (None, "text", "- 3 -", 1, 1, "d"), ("pic", "picture", "data:image/png;base64,AA", 1, 1, "d")]
    return rows, set(bad)


def test_damaged(spark, corpus):
    from leafmill.llm.scans import damaged, repaired

    rows, bad = corpus
    found = {r.id for r in damaged(elements(spark, rows)).collect()}
    assert found == bad
    fixed = {r.id: r.repaired for r in repaired(elements(spark, rows)).collect()}
    assert "measure of it." in fixed["hy"] and "12" not in fixed["pg"] and "\n" not in fixed["pg"] and "number" in fixed["ocr"] and "circle" in fixed["ocr"]
    assert damaged(elements(spark, rows).limit(0)).count() == 0


def test_every_single_misreading_meets_its_word(spark, corpus):
    from leafmill.llm.scans import CONFUSIONS, repaired, skeleton

    words = (*WORDS, "shows", "holds", "meets", "finds", "không", "index", "the", "of", "in")
    pairs = [(w, w[: m.start()] + b + w[m.end() :]) for w in words for a, b in CONFUSIONS for m in re.finditer(re.escape(a), w)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(skeleton(F.col("a")) != skeleton(F.col("b"))).count() == 0 and len(pairs) > 150
    rows = [*corpus[0], ("six", "text", "The window sliows a letter and the planet firids every circle.", 50, 100, "doc99")]
    fixed = {r.id: r.repaired for r in repaired(elements(spark, rows)).collect()}
    assert fixed["six"] == "The window shows a letter and the planet finds every circle."


def test_a_habit_outside_the_table_is_learned(spark):
    from leafmill.llm.scans import candidates

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgiklmoprstuvwxyz") for _ in range(7)) + "y" + r.choice("abe") for _ in range(60)]
    rows = [(w, 500) for w in words] + [(w.replace("y", "v"), 3) for w in words if w.count("y") == 1] + [(w[:3] + "q" + w[4:], 3) for w in words[:5]]
    got = {(x.word, x.c_word): x.habit for x in candidates(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert all(got.get((w.replace("y", "v"), w), 0) > 0 for w in words if w.count("y") == 1)
    assert not any(q in words and w[3] == "q" for w, q in got)


def test_truncated(spark, corpus):
    from leafmill.llm.truncation import by_source, judged

    r = random.Random(7)
    rows = [x for x in corpus[0] if x[5] not in ("doc99", "d")]
    cut = {"mid": sentence(r)[:-9], "mark": sentence(r) + " The engine sho…", "lost": sentence(r) + " The chap�", "tab": "| a | b |\n| --- | --- |\n| x | 1 |\n| y ", "cells": "| a | b |\n| --- | --- |\n| x |"}
    whole = {"ok": sentence(r), "goes": "The engine shows a picture and the", "tab2": "| a | b |\n| --- | --- |\n| x | 1 |", "blank": " ", "nul": None}
    kind = lambda k: "table" if k in ("tab", "cells", "tab2") else "text"
    extra = [(k, kind(k), v, 5, 10 * j, "cut") for j, (k, v) in enumerate(cut.items())] + [(k, kind(k), v, 5, 500 + 10 * j, "whole") for j, (k, v) in enumerate(whole.items())]
    extra += [("next", "text", "lesson of every garden. " + sentence(r), 5, 511, "whole"), (None, "text", "The eng", 1, 1, "x")]
    df = elements(spark, rows + extra)
    found = {x.id: x for x in judged(df).where("truncated").collect()}
    assert set(found) == set(cut) and all(x.log_odds < x.threshold for x in found.values())
    src = spark.createDataFrame([("cut", "S", T), ("cut", "S", T), ("whole", "W", T)], "doc_id string, source string, registered_at timestamp")
    assert {x.source: x.n_truncated for x in by_source(df, src).where("source is not null").collect()} == {"S": 5, "W": 0}
    assert judged(df.limit(0)).count() == 0


# ---- 4 lines


def test_lines(spark):
    from leafmill.llm.lines import cleaned, excessive

    notice, second = "Share this chapter with your study group on the board, page 7", "All rights are reserved in every edition of 2019 and later."
    rows = [(f"n{k}", "text", f"Body {WORDS[k]} has {WORDS[k + 9]} of its own and stays.\n{notice.upper() if k % 2 else notice.replace('7', str(k))}\n{second}", 5, k, f"d{k}") for k in range(5)]
    rows += [("other", "text", notice, 5, 1, "e0"), ("few", "text", "a short line", 5, 1, "d0"), ("t", "table", notice, 5, 2, "d0"), ("null", "text", None, 5, 1, "d1"), ("n0", *rows[0][1:]), (None, "text", notice, 5, 1, "d1")]
    src = spark.createDataFrame([(f"d{k}", "S") for k in range(6)] + [("e0", "E"), ("d0", "S"), (None, "S")], "doc_id string, source string")
    df = elements(spark, rows)
    assert {(r.id, r.pos) for r in excessive(df, src).collect()} == {(f"n{k}", p) for k in range(5) for p in (1, 2)}
    out = {r.id: (r.content, r.n_removed) for r in cleaned(df, src).where("id is not null").collect()}
    assert out["n3"] == (f"Body {WORDS[3]} has {WORDS[12]} of its own and stays.", 2) and out["other"] == (notice, 0) and out["null"] == (None, 0)
    assert excessive(df.limit(0), src).count() == 0 and excessive(df, src.limit(0)).count() == 0


def test_blocks_of_short_lines(spark):
    from leafmill.llm.lines import cleaned, excessive, intervals, suffix_array

    share = ["Share this page", "Print it out", "Send to a friend"]
    rows = [(f"b{k}", "text", "\n".join([f"Own {WORDS[k]} line", *share, f"Then {WORDS[k + 9]} ends"]), 5, k, f"d{k}") for k in range(5)]
    rows += [(f"s{k}", "text", f"{share[0]}\n{WORDS[k]} {WORDS[k + 1]} and {WORDS[k + 2]} of its own {k}", 5, 50 + k, f"d{k}") for k in range(5)]  # one line of it alone is no block
    rows += [(f"f{k}", "text", "\n".join(share[1:]), 5, 90 + k, f"d{k}") for k in range(4)]
    src = spark.createDataFrame([(f"d{k}", "S") for k in range(5)], "doc_id string, source string")
    df = elements(spark, rows)
    assert excessive(df, src, single=True).count() == 0
    gone = {(r.id, r.pos) for r in excessive(df, src).collect()}
    # blocks of letters enough are those of all three lines; the last two alone have too few
    assert gone == {(f"b{k}", p) for k in range(5) for p in (1, 2, 3)}
    assert {r.id: r.content for r in cleaned(df, src).collect()}["b2"] == f"Own {WORDS[2]} line\nThen {WORDS[11]} ends"
    array = sorted((r.source, r.key, r.doc_id, r.id, r.pos, r.lcp) for r in suffix_array(df, src).repartition(3).collect())
    for a, b in zip(array, array[1:], strict=False):
        n = next((k for k, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
        assert b[5] == n
    same = {}
    for r in intervals(suffix_array(df, src)).collect():
        same.setdefault((r.depth, r.interval), set()).add(tuple(next(x[1] for x in array if x[3:5] == (r.id, r.pos))[: r.depth]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set().union(*same.values()))


# ---- 5 spans


def test_spans(spark):
    from leafmill.llm.spans import shared_pairs, shared_shares

    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefgh  ,.é") for _ in range(n))
    base = [make(400) for _ in range(6)] + ["x" * 500, "supercalifragilistic" * 20]
    texts = {}
    for k in range(60):
        b = r.choice(base)
        a = r.randint(0, len(b) - 150)
        n = r.choice((98, 99, 100, 101, 120, 150))
        texts[f"c{k:02d}"] = make(r.randint(0, 30)) + b[a : a + n] + make(r.randint(0, 30))
    texts |= {f"b{k}": b for k, b in enumerate(base)} | {"b0copy": base[0], "tiny": "abc", "empty": ""}
    cits = spark.createDataFrame([(k, v, T, 1) for k, v in texts.items() if k < "c30"] + [("c00", texts["c00"], T, 1), ("c_null", None, T, 1), (None, base[0], T, 1)], "citation_id string, content string, answered_at timestamp, rec int")
    hits = spark.createDataFrame([(k, v, 1) for k, v in texts.items() if k >= "c30"] * 2 + [("h_null", None, 1)], "doc_id string, text string, rec int")
    grams: dict[str, set] = {}
    for k, v in texts.items():
        for a in range(len(v) - 99):
            grams.setdefault(v[a : a + 100], set()).add(k)
    want = {(a, b) for s in grams.values() for a in s for b in s if a < b}
    got = [tuple(x) for x in shared_pairs(cits, hits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    share = {x.rec: x.shared_chars for x in shared_shares(cits, hits).collect()}
    for k, v in texts.items():
        marks = bytearray(len(v))
        for a in range(len(v) - 99):
            if len(grams[v[a : a + 100]]) > 1:
                marks[a : a + 100] = b"\1" * 100
        assert share[k] == sum(marks)
    assert shared_pairs(cits.limit(0), hits.limit(0)).count() == 0


# ---- 6 forms


def test_forms(spark):
    from leafmill.llm.forms import one_form, unlike_forms

    cases = {"full": ("ｗｉｄｅ", "wide"), "split": ("café", "café"), "zero": ("a​b", "ab"), "space": ("a b　c", "a b c"), "look": ("pаge", "page"), "bidi": ("a\u202eb\u2066c", "abc")}
    fine = {"greek": "λ and Ωμέγα", "quote": "“x” – y… n²", "acc": "déjà", "plain": "abc", "cyr": "граф x", "empty": "", "nl": "a\nb"}
    other = {"kana": ("ｶﾞｱ", "ガア"), "math": ("𝐱", "x"), "roman": ("Ⅳ", "IV"), "soft": ("co\u00adop", "coop")}
    soft = one_form(spark.createDataFrame([(k, v[0]) for k, v in other.items()], "id string, content string"), "e", "id", "content")
    assert {r.rec_id: r.form for r in soft.collect()} == {k: v[1] for k, v in other.items()}
    rows = [(k, v[0], "t") for k, v in cases.items()] + [(k, v, "t") for k, v in fine.items()] + [("null", None, "t"), (None, "ａ", "t"), ("full", "ｗｉｄｅ", "t")]
    df = spark.createDataFrame(rows, "id string, content string, tbl string")
    assert sorted((r.tbl, r.rec_id) for r in unlike_forms(df, "e", "id", "content").collect()) == sorted(("e", k) for k in cases)
    form = {r.rec_id: r.form for r in one_form(df, "e", "id", "content").where("rec_id is not null").collect()}
    assert all(form[k] == v[1] for k, v in cases.items()) and all(form[k] == v for k, v in fine.items()) and form["null"] is None
    assert unlike_forms(df.limit(0), "e", "id", "content").count() == 0


# ---- 7 ranking


def test_ranking(spark):
    from leafmill.llm.ranking import one_ranking

    rows = [(1, "v", "a", 0.9, None, 5.0), (1, "v", "b", 0.5, None, -3.0), (1, "v", "c", 0.1, None, -9.0), (1, "m", "a", 400.0, 0.04, 5.0), (1, "m", "c", 3.0, float("nan"), -9.0), (1, "m", "a", 400.0, 0.04, 5.0), (2, "v", "z", None, None, None), (None, "v", "z", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, retriever string, doc_id string, score double, rrf_score double, rerank_score double")
    got = {(r.query_id, r.doc_id): r for r in one_ranking(df).collect()}
    ranks = {"a": [1 / 3, 1 / 2, 1 / 1, 1 / 3], "b": [2 / 3, 2 / 3], "c": [1.0, 1.0, 1.0]}
    for d, rs in ranks.items():
        rs, n = sorted(rs), len(rs)
        rho = min(sum(math.comb(n, i) * x**i * (1 - x) ** (n - i) for i in range(k, n + 1)) for k, x in enumerate(rs, 1))
        assert got[1, d].significance == pytest.approx(min(1, rho * n), abs=1e-8)
    assert [d for _, d in sorted((got[1, d].final_rank, d) for d in "abc")] == ["b", "a", "c"] and got[2, "z"].significance == 1 and len(got) == 4
    assert one_ranking(df.limit(0)).count() == 0


# ---- 8 leaks


def test_leaks(spark):
    from leafmill.llm.leaks import leaks

    r = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    items = {k: " ".join(r.choice(vocab) for _ in range(40)) for k in range(20)}
    docs = {}
    for k in range(80):
        item, n = r.randrange(20), r.choice((0, 10, 15, 16, 17, 40))
        ws = items[item].split()
        a = r.randint(0, len(ws) - n) if n else 0
        docs[k] = " ".join(r.choice(vocab) for _ in range(50)) + ". " + " - ".join(ws[a : a + n]).upper() + ". " + " ".join(r.choice(vocab) for _ in range(50))
    edited = items[0].split()
    edited[7] = edited[20] = edited[33] = "changed"
    docs[90] = " ".join(edited)
    runs = {}
    for k, v in items.items():
        ws = v.split()
        for a in range(len(ws) - 15):
            runs.setdefault(tuple(ws[a : a + 16]), set()).add(k)
    want = {(d, i) for d, t in docs.items() for ws in [re.findall(r"[^\W_]+", t.lower())] for a in range(len(ws) - 15) for i in runs.get(tuple(ws[a : a + 16]), ())}
    ddf = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(99, None, 1), (98, "", 1), (None, items[1], 1), (0, docs[0], 1)], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame([(k, v) for k, v in items.items()] + [(50, None), (51, "too short")], "item_id long, text string")
    got = leaks(ddf, idf).collect()
    assert {(x.doc_id, x.item_id) for x in got if x.longest_run >= 16} == want
    assert any((x.doc_id, x.item_id) == (90, 0) and x.share > 0.8 for x in got)
    assert {(x.doc_id, x.item_id) for x in leaks(ddf, idf, max_item_words=100).where("longest_run >= 16").collect()} == want
    assert leaks(ddf.limit(0), idf).count() == 0 and leaks(ddf, idf.limit(0)).count() == 0


def test_edited_copies_are_found_however_many_there_are(spark):
    from leafmill.llm.leaks import Items, align, leaks

    r = random.Random(5)
    item = [r.choice("abcdefghij") + str(r.randint(0, 30)) for _ in range(60)]
    edited = lambda step: " ".join(f"x{r.randint(0, 999)}" if k % step == step - 1 else w for k, w in enumerate(item))
    other = lambda n: " ".join(r.choice(item[:20] + ["y", "z"] * 10) for _ in range(n))
    docs = [(k, f"{other(200)} {edited(8)} {other(50)}") for k in range(40)] + [(100, f"{other(90)} {edited(4)}"), (101, other(400))]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    items = Items([(1, " ".join(item))], 5)
    want = {d for d, t in docs if align(items.seqs[1], items.numbers(t))[0] / 120 >= 0.5}
    got = leaks(ddf, idf).collect()
    assert {x.doc_id for x in got} == want == {*range(40), 100}
    assert all(x.score == align(items.seqs[1], items.numbers(dict(docs)[x.doc_id]))[0] for x in got)


# ---- 9 mixing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), max_size=12), st.integers(0, 3000), st.integers(1, 5))
def test_fit_stays_within_bounds(hist, budget, repeats):
    lengths, counts = list(hist), list(hist.values())
    rounds, extra, rest = fit(lengths, counts, budget, repeats)
    used = sum(n * (rounds * c + x) for n, c, x in zip(lengths, counts, extra, strict=True))
    assert used + rest == budget and rest >= 0
    assert all(rounds * c + x <= repeats * c and x >= 0 for c, x in zip(counts, extra, strict=True))


def test_fit_is_exact_where_one_can_be():
    assert fit([7, 11, 13], [50, 50, 50], 500, 3)[2] == 0
    assert fit([4, 6], [10, 10], 101 - 1, 1)[2] == 0 and fit([4, 6], [10, 10], 51, 1)[2] == 1


def test_mix(spark):
    from leafmill.llm.mixing import mix

    r = random.Random(6)
    docs = [(k, " ".join(r.choice(WORDS) for _ in range(r.randint(3, 60))), r.choice("AAAAB"), 1) for k in range(300)] + [(900, None, "A", 1), (901, "text", None, 1), (902, "", "B", 1), (0, "again and again", "A", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    goal = spark.createDataFrame([("A", 0.5, 1), ("B", 0.4, 3), ("C", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix(df, goal)
    rep = {x.source: x for x in report.collect()}
    assert abs(rep["A"].actual_share - 5 / 9) < 0.01 and abs(rep["B"].actual_share - 4 / 9) < 0.01 and rep["C"].tokens == 0
    rows = mixture.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and all(1 <= x.copies <= (1 if x.source == "A" else 3) for x in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(df, goal)[0].collect()))
    assert mix(df.limit(0), goal)[0].count() == 0


# ---- 10 encoding


@pytest.mark.parametrize("page", ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["déjà vu – “naïve” résumé’s café", "Die Größe für Schlüssel ändern", "áéíóú y ñandú"])
def test_round_trip(page, text):
    out = []
    for c in text:
        try:
            out.append(c.encode().decode(page) if ord(c) > 127 else c)
        except UnicodeDecodeError:
            out.append(c)
    got = restore("".join(out))[0]
    if page in ("latin-1", "cp1252", "mac_roman", "cp437"):
        assert got == text
    else:
        assert sum(a == b for a, b in zip(got, text, strict=False)) >= 0.9 * len(text)


def test_twice_and_decoys():
    s = "Người dùng – “kiến trúc”"
    once = s.encode().decode("latin-1")
    assert restore(once)[0] == s and restore(once.encode().decode("latin-1"))[0] == s
    for fine in ("Is the “Ã” column wide?", "Keys: Â, Ã, ð, ñ, Ÿ and ×", "SÃO and ÂNCORA", "Thành phần và tài liệu", "¿Qué?", "n² ± 5 §", "", None):
        assert restore(fine)[1:3] == (0, 0) and restore(fine)[0] == fine
    assert restore("f�r")[2] == 1


@pytest.mark.parametrize("text", ["数据库系统概论", "データベースの設計", "قاعدة البيانات", "מסד נתונים", "Сьогодні історія і наука їхня", "ok 😀 🍌 done", "βάση δεδομένων", "데이터 베이스", "café: the λ-based codec"])
def test_round_trip_of_any_script(text):
    from leafmill.llm.encoding import CODE_PAGES

    for page in CODE_PAGES:
        garbled = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode())
        assert restore(garbled)[0] == text, page
        assert restore(text)[:2] == (text, 0)


def test_right_text_of_any_script_stays():
    fine = ["Тільки дії історії Італії і Рік Січ її", "l’été et l’âge “état” –être —à la", "«étude» «à la carte» groß“ und weiß“ CAFÉ”", "├──┐ └──│ ├── src", "Привет, мир! Ёлка. ёж", "ĐÂY LÀ “Ê”, “Ơ”.", "PIÙ”", "ÎLE, Ï” ", "μm Δx λ→∞ ±5°C", "Thành phần “ưu” và “ơ”"]
    for text in fine:
        assert restore(text)[:3] == (text, 0, 0)


def test_garbled(spark):
    from leafmill.llm.encoding import garbled

    rows = [(1, "cafÃ© au lait", "x"), (2, "café", "x"), (3, None, "x"), (4, "", "x"), (5, "a�b", "x"), (6, "y" * 200_000 + "naÃ¯ve", "x")]
    got = {r.doc_id: r.restored for r in garbled(spark.createDataFrame(rows, "doc_id long, text string, restored string")).collect()}
    assert set(got) == {1, 5, 6} and got[1] == "café au lait" and got[6].endswith("naïve")


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = Boosted(rounds=60).fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0) == y[1500:]).mean() > 0.9
