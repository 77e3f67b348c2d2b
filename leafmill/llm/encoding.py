"""Garbled text from a wrong character encoding: back to legacy bytes, through a byte automaton, decoded span by span.

Characters are mapped back to the bytes of a legacy code page. An automaton over those bytes (the well-formedness table of
UTF-8) finds maximal spans of complete multibyte sequences, and only those spans are decoded; everything else is left
as it stands. Layers are undone one after another, so text garbled twice comes back too. Within one run of characters
the code page that explains most of it wins; ties go to the code page seen most in the document, then to the order below.

A well-formed sequence is decoded whatever the script of its character, provided that the character is assigned. What
right text can bring about by chance (a quotation mark before an accented letter, a short Cyrillic word, a rare two-byte
letter) is decoded only in company: next to a decoded character of its script, or in a document in which the
same code page explains others; and never where it would put a foreign letter next to a Latin one.

A document counts as affected if a span was decoded, or if it holds a replacement mark or a C1 control character. Lost
bytes (a replacement mark or a question mark inside a sequence) are restored where only one sensible character fits.

Defined results: null and empty texts are never affected; repeated rows give repeated rows; an empty table gives no
rows; very long texts are handled whole; only ``doc_id`` and ``text`` are read, so extra columns do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE_PAGES = ("cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "cp1258", "iso8859_15", "cp850")
LOST = -2
QUOTES = set("‘’“”–—„‚…«»‹›")
OPENING = set("“‘„«‹(\"'")
#: Characters by which a lost byte may be filled in; whole sequences may hold any character.
LIKELY = set(
    "".join(map(chr, range(0x80, 0x100)))
    + "œŒšŠžŽŸƒˆ˜ăĂđĐĩĨũŨơƠưƯąĄćĆęĘłŁńŃśŚźŹżŻčČďĎěĚňŇřŘťŤůŮőŐűŰğĞşŞıİ"
    + "".join(map(chr, range(0x1EA0, 0x1EFA)))
    + "‘’“”‚„–—…•†‡‰‹›€™"
    + "".join(map(chr, [*range(0x391, 0x3CA), *range(0x410, 0x450)]))
    + "≤≥≠≈∞√∑∫∂→←−×÷"
)
NEVER, IN_COMPANY, ALONE = 0, 1, 2


@cache
def to_byte(page: str) -> dict[str, int]:
    """Character to legacy byte; bytes the page leaves undefined stand for themselves, as lenient decoders have it."""
    out = {}
    for b in range(0x80, 0x100):
        out[chr(b) if page == "cp1252" else ""] = b
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    out.pop("", None)
    if page == "cp1252":  # both readings of 80 to 9F: the code page's and that of plain Latin-1
        for b in range(0x80, 0x100):
            try:
                out[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                pass
    return out


@cache
def undefined(page: str) -> tuple[int, ...]:
    gaps = []
    for b in range(0x80, 0xC0):
        try:
            bytes([b]).decode(page)
        except UnicodeDecodeError:
            gaps.append(b)
    return tuple(gaps) or tuple(range(0x80, 0xC0))


def _step(first: int) -> tuple[int, int, int] | None:
    """The automaton's first transition: sequence length and the range allowed for the second byte."""
    if 0xC2 <= first <= 0xDF:
        return 2, 0x80, 0xBF
    if 0xE0 <= first <= 0xEF:
        return 3, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
    if 0xF0 <= first <= 0xF4:
        return 4, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
    return None


@lru_cache(50_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0].split("-")[0]


def _complete(seq: list[int], page: str, lenient: bool) -> str | None:
    """Decode one sequence; with one lost byte, the only likely character, or a replacement mark if several fit."""
    if LOST not in seq:
        c = bytes(seq).decode("utf-8", "ignore")
        return c if c and (not lenient or c in LIKELY) else None
    if seq.count(LOST) > 1:
        return None
    k = seq.index(LOST)
    fits = {c for b in undefined(page) if (c := bytes([*seq[:k], b, *seq[k + 1 :]]).decode("utf-8", "ignore")) in LIKELY and ord(c) > 0x9F}
    return next(iter(fits)) if len(fits) == 1 else "�" if fits else None


def _within(run: str, i: int, n: int, lo: str, hi: str) -> str:
    """The stretch of characters from ``lo`` to ``hi`` around a sequence that consists of such; else an empty text."""
    if not all(lo <= x <= hi for x in run[i : i + n]):
        return ""
    a, b = i, i + n
    while a and lo <= run[a - 1] <= hi:
        a -= 1
    while b < len(run) and lo <= run[b] <= hi:
        b += 1
    return run[a:b]


def _grade(c: str, run: str, i: int, n: int, before: str) -> int:
    """How much a decoded character says by itself."""
    o = ord(c)
    if o < 0x100:
        return ALONE
    if unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc"):
        return NEVER
    if n == 2 and run[i] in QUOTES:
        return IN_COMPANY
    if _within(run, i, n, "\u0400", "\u04ff"):  # letters of one alphabet: right words are lower, upper or title case
        word = _within(run, i, n, "\u0400", "\u04ff")
        if word in (word.lower(), word.upper(), word[:1].upper() + word[1:].lower()):
            return IN_COMPANY
    if len(_within(run, i, n, "\u2500", "\u259f")) > n:  # a frame or a tree of lines
        return IN_COMPANY
    if o < 0x180 or c in "ơƠưƯ" or 0x391 <= o <= 0x3C9 or 0x400 <= o <= 0x45F or o >= 0x800:
        return ALONE
    return ALONE if unicodedata.category(c) == "Mn" and before.isalpha() and _script(c) == "COMBINING" else IN_COMPANY


@lru_cache(100_000)
def _decode_short(run: str, left: str, right: str, page: str, lenient: bool, trusted: bool) -> tuple[str, int, int, int]:
    return _decode(run, left, right, page, lenient, trusted)


def decode_run(run: str, left: str, right: str, page: str, lenient: bool, trusted: bool = False) -> tuple[str, int, int, int]:
    """A run with its well-formed spans decoded: (text, characters explained, sequences, lost characters)."""
    return (_decode_short if len(run) <= 64 else _decode)(run, left, right, page, lenient, trusted)


def _decode(run: str, left: str, right: str, page: str, lenient: bool, trusted: bool) -> tuple[str, int, int, int]:
    table = to_byte(page)
    codes = [LOST if lenient and c in "�?" else 0xA0 if lenient and c == " " else table.get(c, -1) for c in run]
    parts: list[tuple[str, int, int]] = []  # (character, place, length of its sequence or 0)
    doubtful = False
    i = 0
    while i < len(run):
        step = _step(codes[i]) if codes[i] > 0 and ord(run[i]) > 0x7F else None
        if step and i + step[0] <= len(run):
            seq = codes[i : i + step[0]]
            well = (seq[1] == LOST or step[1] <= seq[1] <= step[2]) and all(x == LOST or 0x80 <= x <= 0xBF for x in seq[2:])
            odd = LOST in seq or " " in run[i : i + step[0]]
            if lenient and (not odd or run[i] in QUOTES):  # this pass is for damaged sequences only; whole ones are done
                well = False
            if well and (c := _complete(seq, page, lenient)) is not None and _attached(run, i, step[0], left, right, c, trusted):
                grade = ALONE if lenient else _grade(c, run, i, step[0], parts[-1][0] if parts else left)
                if grade != NEVER:
                    parts.append((c, i, step[0] if grade == ALONE else -step[0]))
                    doubtful |= grade == IN_COMPANY
                    i += step[0]
                    continue
        parts.append((run[i], i, 0))
        i += 1
    if doubtful:
        parts = _in_company(parts, run, left, right, trusted)
    done = [p for p in parts if p[2]]
    return "".join(p[0] for p in parts), sum(p[2] for p in done), len(done), sum(p[0] == "�" for p in done)


def _in_company(parts: list[tuple[str, int, int]], run: str, left: str, right: str, trusted: bool) -> list[tuple[str, int, int]]:
    """Doubtful characters (negative lengths) stay with a decoded neighbour of their script or in trust, away from Latin letters."""
    out = []
    for k, (c, at, n) in enumerate(parts):
        if n < 0:
            near = [parts[j] for j in (k - 1, k + 1) if 0 <= j < len(parts)]
            beside = (parts[k - 1][0] if k else left, parts[k + 1][0] if k + 1 < len(parts) else right)
            foreign = c.isalpha() and _script(c) != "LATIN" and any(x.isalpha() and _script(x) == "LATIN" for x in beside)
            if foreign or not (trusted or any(m and _script(x) == _script(c) for x, _, m in near)):
                out += [(x, at + j, 0) for j, x in enumerate(run[at : at - n])]
                continue
        out.append((c, at, abs(n)))
    return out


def _attached(run: str, i: int, n: int, left: str, right: str, c: str, trusted: bool) -> bool:
    """A pair that ends in a quote or dash is a letter's sequence only next to a letter or in trust, and never between quotation marks."""
    if n > 2 or run[i + 1] not in QUOTES:
        return True
    before = run[i - 1] if i else left
    after = run[i + n] if i + n < len(run) else right
    if before in OPENING and not after.isalpha():
        return False
    return trusted or not c.isalpha() or before.isalpha() or after.isalpha() or ord(before) > 0x7F or ord(after) > 0x7F


#: What the JVM lets through: two neighbouring characters beyond ASCII, a replacement mark or a C1 control. Every span has one.
PLACES = r"[^\x00-\x7F][^\x00-\x7F]|[\x{0080}-\x{009F}\x{FFFD}]"


@cache
def suspicion() -> re.Pattern:
    """A first byte's character followed by a continuation's, in any one code page, or a mark that is damage by itself."""
    parts = ["[\x80-\x9f\ufffd]"]
    for page in CODE_PAGES:
        table = to_byte(page)
        one = lambda lo, hi, t=table: "".join(re.escape(c) for c, b in sorted(t.items()) if lo <= b <= hi)
        parts.append(f"[{one(0xC2, 0xF4)}][{one(0x80, 0xBF)}]")
    return re.compile("|".join(parts))


_RUN = regex.compile(r"[^\x00-\x7f](?:[^\x00-\x7f]|[ ?](?=[^\x00-\x7f])|(?<=[^\x00-\x7f])[ ?])*")


def _two_readings(run: str) -> bool:
    """Whether a run holds controls that cp1252 has signs for next to signs beyond Latin-1, as ISO 8859-15 gives them."""
    return max(run) > "\xff" and any("\x80" <= c <= "\x9f" and c not in "\x81\x8d\x8f\x90\x9d" for c in run)


def _layer(text: str, lenient: bool, votes: Counter) -> tuple[str, int, int, Counter]:
    total = lost = 0
    seen: Counter = Counter()

    def fix(m: regex.Match) -> str:
        nonlocal total, lost
        run, a, b = m.group(0), m.start(), m.end()
        left, right = text[a - 1 : a] or " ", text[b : b + 1] or " "
        best = None
        for k, page in enumerate(CODE_PAGES):
            if lenient and not votes[page]:
                continue
            got = decode_run(run, left, right, page, lenient, votes[page] > 0)
            rank = (got[1], page != "cp1252" or not _two_readings(run), votes[page], -k)
            if got[2] and (best is None or rank > best[0]):
                best = rank, page, got
        if best is None:
            return run
        total += best[2][2]
        lost += best[2][3]
        seen[best[1]] += best[2][2]
        return best[2][0]

    return _RUN.sub(fix, text), total, lost, seen


def restore(text: str | None) -> tuple[str | None, int, int, str | None]:
    """The restored text, decoded sequences, characters lost for good, and the code pages, most used first."""
    if not text:
        return text, 0, 0, None
    out, spans, pages = text, 0, Counter()
    while True:  # every layer that is undone leaves a shorter text
        _, n, _, votes = _layer(out, False, Counter())
        if not n:
            break
        out, n, _, seen = _layer(out, False, votes)
        out, more, _, _ = _layer(out, True, votes)
        spans += n + more
        pages += seen
    lost = out.count("�") + sum("\x80" <= c <= "\x9f" for c in out)
    return out, spans, lost, ",".join(p for p, _ in sorted(pages.items(), key=lambda x: (-x[1], x[0]))) or None


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    suspect = suspicion().search
    for b in batches:
        ids, got = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            r = restore(t) if suspect(t) else (t, 0, 0, None)
            if r[1] or r[2]:
                ids.append(i)
                got.append(r)
        cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["doc_id", "restored", "n_spans", "n_lost", "code_pages"])


def garbled(documents: DataFrame) -> DataFrame:
    """Affected documents with restored text, decoded sequences, lost characters and code pages."""
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where(F.col("text").rlike(PLACES))
    return rows.mapInArrow(_work, "doc_id bigint, restored string, n_spans int, n_lost int, code_pages string")
