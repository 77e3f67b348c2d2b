"""Text and token functions as Spark columns. All are null-safe: null in, null out, unless the docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Settings

#: Words after which a text is felt to go on.
DANGLING = ("and", "or", "but", "so", "because", "of", "in", "on", "at", "to", "for", "with", "by", "as", "that", "which")


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^(?U:\s+)|(?U:\s+)\z", "")


def collapse(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def token_count(t: Column, s: Settings = DEFAULT) -> Column:
    """Estimated tokens: characters over 3.56, rounded down, at least 1."""
    return F.greatest(F.lit(1), (F.length(t) / F.lit(s.chars_per_token)).cast("int"))


def split_sentences(t: Column) -> Column:
    return F.split(t, r"(?<=[.!?])(?U:\s+)")


def words(t: Column) -> Column:
    """Parts between white space; none of a blank text."""
    return F.filter(F.split(strip(t), r"(?U)\s+"), lambda w: w != "")


def overlap_tail(t: Column, s: Settings = DEFAULT) -> Column:
    """The last words that go into the next chunk; a text with no more words than that stays as it is."""
    n = s.overlap_words
    w = words(t)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, -n, n), " ")).otherwise(t)


def clean_text(t: Column) -> Column:
    """No-break spaces made plain, zero-width spaces dropped, stripped; null gives an empty text."""
    return F.coalesce(strip(F.regexp_replace(F.regexp_replace(t, "\u00a0", " "), "\u200b", "")), F.lit(""))


def heading_display(t: Column) -> Column:
    """Headings in capitals get a capital at the start of each run of letters, others stay."""
    capitals = (F.upper(t) == t) & t.rlike(r"\p{Lu}")
    runs = F.regexp_extract_all(t, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.when(capitals, F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")).otherwise(t)


def make_id(t: Column) -> Column:
    return F.md5(collapse(t).cast("binary"))


def is_text_incomplete(t: Column) -> Column:
    """Whether a text looks cut: no closing mark, a dangling last word, brackets or quotes left open. Blank: false."""
    s = strip(t)
    many = lambda p: F.regexp_count(s, F.lit(p))
    open_end = ~F.right(s, F.lit(1)).rlike(r"[.!?”\"')\]]") & F.right(s, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    last = F.lower(F.element_at(F.split(s, r"(?U)\s+"), -1))
    unbalanced = (many(r"\(") > many(r"\)")) | (many(r"\[") > many(r"\]")) | (many(r"\{") > many(r"\}"))
    return F.when(t.isNull() | (s == ""), F.lit(False)).otherwise(open_end | last.isin(*DANGLING) | unbalanced | (many('"') % 2 != 0) | (many("“") != many("”")))


def first_sentence(t: Column) -> Column:
    """The shortest beginning of a line that ends in a final mark before a blank or the end; else the stripped text."""
    s = strip(t)
    return F.coalesce(F.nullif(F.regexp_extract(s, r"(.+?[.!?])(?=(?U:\s)|\z)", 1), F.lit("")), s)


def first_list_item(t: Column) -> Column:
    """The first line that begins with a bullet, else the first line."""
    lines = F.transform(F.split(strip(t), r"\r\n|\n|\r"), strip)
    items = F.filter(lines, lambda x: x.rlike(r"^[-*•]"))
    return F.when(F.size(items) > 0, F.element_at(items, 1)).otherwise(F.element_at(lines, 1))


def id_unit(kind: Column, t: Column) -> Column:
    """The part of an element that its id is made of: a list's first item, else the first sentence."""
    return F.when(kind == "list_item", first_list_item(t)).otherwise(first_sentence(t))


def normalize_docname(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(t)), r"(?U)\s+", "_"), "[^a-z0-9_]", "")


def normalize_title(t: Column) -> Column:
    """Titles without numbering, periods, commas and white space, in lower case; null gives an empty text."""
    bare = F.regexp_replace(F.lower(strip(t)), r"^\d+(\.\d+)*\.?(?U:\s*)", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(bare, "[.,]", ""), r"(?U)\s+", ""), F.lit(""))


def normalize_filename(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    safe = F.regexp_replace(F.regexp_replace(F.lower(stem), " ", "_"), r"[^\p{L}\p{N}_\-]", "_")
    return F.regexp_replace(F.regexp_replace(safe, "_+", "_"), "^_+|_+$", "")


def sanitize_filename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^a-zA-Z0-9._-]", "_")


def normalize_text(t: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(t), r"(?U)[^\p{L}\p{M}\p{N}_\s]", ""))


def safe_query(t: Column) -> Column:
    return collapse(F.regexp_replace(t, r"(?U)[^\p{L}\p{M}\p{N}_\s]", " "))


def section_cleanup(s: Column) -> Column:
    """A section path for display; an empty one is General."""
    return F.when(s.isNull() | s.isin("", " > "), F.lit("General")).otherwise(strip(F.regexp_replace(s, "^( > )+", "")))


def store_text(section: Column, text: Column) -> Column:
    return F.concat(F.lit("[SECTION]: "), section, F.lit("\n[CONTENT]: "), F.coalesce(text, F.lit("")))


def data_uri_payload(t: Column) -> Column:
    """What stands behind the first comma of a data URI; a text without a comma stays."""
    return F.regexp_replace(t, r"(?s)^[^,]*,", "")


def truncate_display(t: Column, n: int = 120) -> Column:
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def subsection_label(t: Column) -> Column:
    """A block's heading without its marks; one above 300 characters is no heading."""
    label = strip(F.regexp_replace(t, "^#+", ""))
    return F.when(F.length(label) > 300, F.lit("")).otherwise(label)


def format_element(kind: Column, text: Column, s: Settings = DEFAULT) -> Column:
    """The stored form of a parsed element by its label; unknown labels give an empty text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(kind == "section_header", F.concat(F.lit("### "), t))
        .when(kind == "list_item", F.concat(F.lit(" - "), t))
        .when(kind == "caption", F.concat(F.lit("["), t, F.lit("] ")))
        .when(kind == "footnote", F.concat(F.lit("(footnote: "), t, F.lit(")")))
        .when(kind == "formula", F.when(t == "", F.lit("")).otherwise(F.concat(F.lit("[FORMULA]\n"), t)))
        .when(kind.isin("text", "table", "picture"), t)
        .otherwise(F.lit(""))
    )
