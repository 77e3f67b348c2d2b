"""Text that looks the same but is written with other characters, brought to one form by DuckDB inside Arrow partitions.

Each Arrow batch is handed to an in-process DuckDB connection, where ``translate``, ``regexp_replace`` and
``nfc_normalize`` in embedded SQL map full-width and ligature forms, remove invisible characters, unify spaces,
compose accents and replace look-alike letters of other alphabets inside otherwise Latin words.

Defined results: a null text gives a null form and no flags; an empty text stays empty; very long texts are handled
whole; repeated rows give repeated rows; an empty table gives no rows; only the named columns are read, so extra columns
with any name do no harm. Soft hyphens are dropped from the form; by themselves they make no case. Words or symbols wholly of another script, typographic quotes, dashes, ellipses and
superscripts are left as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
FULL_WIDTH_TO = "".join(map(chr, range(0x21, 0x7F)))
FULL_SIGNS, FULL_SIGNS_TO = "￠￡￢￣￤￥￦", "¢£¬¯¦¥₩"
SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
#: Letters of other alphabets and the Latin letters they look like.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ϲ": "c", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ε": "e", "γ": "y", "ω": "w", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
}
OTHER = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Coptic}\p{Cherokee}\p{Georgian}"
INVISIBLE = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{034F}\x{061C}\x{FE00}-\x{FE0E}\x{FEFF}\x{180E}"
#: Half-width kana, mathematical letters and Roman numerals with their compatibility forms, by rule.
COMPATIBLE = {c: unicodedata.normalize("NFKC", c) for lo, hi in ((0xFF65, 0xFFA0), (0x1D400, 0x1D800), (0x2160, 0x2180)) for c in map(chr, range(lo, hi)) if unicodedata.normalize("NFKC", c) not in ("", c)}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}

_lit = lambda s: "'" + s.replace("'", "''") + "'"
_look_from, _look_to = "".join(LOOK_ALIKE), "".join(LOOK_ALIKE.values())


def _ligatures(x: str) -> str:
    for a, b in LIGATURES.items():
        x = f"replace({x}, {_lit(a)}, {_lit(b)})"
    return x


def _compatible(x: str) -> str:
    one = {a: b for a, b in COMPATIBLE.items() if len(b) == 1}
    out = f"translate({x}, {_lit(''.join(one))}, {_lit(''.join(one.values()))})"
    for a, b in COMPATIBLE.items():
        if len(b) > 1:
            out = f"replace({out}, {_lit(a)}, {_lit(b)})"
    return f"CASE WHEN regexp_matches({x}, '[\\x{{FF65}}-\\x{{FF9F}}\\x{{1D400}}-\\x{{1D7FF}}\\x{{2160}}-\\x{{217F}}]') THEN {out} ELSE {x} END"


_VISIBLE = f"regexp_replace(x, '[{INVISIBLE}\\x{{00AD}}]', '', 'g')"
FLAGS_SQL = f"""
  regexp_matches(x, '[\\x{{FF01}}-\\x{{FF5E}}\\x{{FFE0}}-\\x{{FFE6}}]') AS full_width,
  regexp_matches(x, '\\p{{L}}\\p{{M}}') AND len(list_filter(regexp_extract_all(x, '\\p{{L}}\\p{{M}}+'), lambda w: length(nfc_normalize(w)) < length(w))) > 0 AS split_accent,
  regexp_matches(x, '[{INVISIBLE}]') AS invisible,
  regexp_matches(x, '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]') AS odd_space,
  regexp_matches(x, '[{OTHER}]') AND regexp_matches({_VISIBLE}, '\\p{{Latin}}\\p{{M}}*[{OTHER}]|[{OTHER}]\\p{{M}}*\\p{{Latin}}') AS look_alike
"""
_MAPPED = f"translate(translate({_VISIBLE}, {_lit(FULL_WIDTH + FULL_SIGNS)}, {_lit(FULL_WIDTH_TO + FULL_SIGNS_TO)}), {_lit(SPACES)}, {_lit(' ' * len(SPACES))})"
_FORM_SQL = f"(CASE WHEN regexp_matches(x, '[ﬀ-ﬆĳǆǉǌ]') THEN {_ligatures(_MAPPED)} ELSE {_MAPPED} END)"
FORM_SQL = f"nfc_normalize({_compatible('mapped')})"
WORDS_SQL = f"""CASE WHEN look_alike THEN array_to_string(list_transform(
      regexp_extract_all(form, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'),
      lambda w: CASE WHEN regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '[{OTHER}]') THEN translate(w, {_lit(_look_from)}, {_lit(_look_to)}) ELSE w END), '')
    ELSE form END"""
NEEDS = r"[^\x{0000}-\x{007E}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}]"


def _run(want_form: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        flags = "full_width, split_accent, invisible, odd_space, look_alike"
        inner = f"SELECT tbl, rec_id, x, {FLAGS_SQL} FROM piece"
        if want_form:
            sql = f"SELECT tbl, rec_id, {WORDS_SQL} AS form, {flags} FROM (SELECT *, {FORM_SQL} AS form FROM (SELECT *, {_FORM_SQL} AS mapped FROM ({inner})))"
        else:
            sql = f"SELECT DISTINCT tbl, rec_id FROM ({inner}) WHERE full_width OR split_accent OR invisible OR odd_space OR look_alike"
        for piece in batches:
            con.register("piece", pa.Table.from_batches([piece]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("piece")

    return work


def _records(df: DataFrame, tbl: str, rec_id: str, field: str) -> DataFrame:
    return df.select(F.lit(tbl).alias("tbl"), F.col(rec_id).cast("string").alias("rec_id"), F.col(field).cast("string").alias("x"))


def one_form(df: DataFrame, tbl: str, rec_id: str, field: str) -> DataFrame:
    """Every record with its text in one form and five flags that say what was changed."""
    flags = ", ".join(f"{c} boolean" for c in ("full_width", "split_accent", "invisible", "odd_space", "look_alike"))
    return _records(df, tbl, rec_id, field).mapInArrow(_run(True), f"tbl string, rec_id string, form string, {flags}")


def unlike_forms(df: DataFrame, tbl: str, rec_id: str, field: str) -> DataFrame:
    """Distinct (tbl, rec_id) of the records whose text is not in that form.

    Texts of plain ASCII and precomposed Latin-1 letters cannot be cases; a JVM-side filter keeps them out of Python.
    """
    rows = _records(df, tbl, rec_id, field).where(F.col("rec_id").isNotNull() & F.col("x").rlike(NEEDS))
    return rows.mapInArrow(_run(False), "tbl string, rec_id string").distinct()
