"""Queries of the text and token functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.config import DEFAULT
from leafmill.functions import text as X
from leafmill.plans.base import CONTENTS, SQL, WS, contents, core, sql_collapse, sql_incomplete, sql_norm, sql_strip
from leafmill.runtime import table


_E = f"WITH e AS ({CONTENTS}) "


def _scalar(name: str, column, sql: str) -> None:
    """A query id, out over every element's content."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return contents(spark, sf_dir).select("id", column(F.col("t")).alias("out"))

    run.__name__ = name
    core(_E + f"SELECT id, {sql} AS out FROM e")(run)


_n = DEFAULT.overlap_words
_scalar("token_count", X.token_count, "greatest(1, trunc(length(t) / 3.56)::INT)")
_scalar("overlap_tail", X.overlap_tail, rf"CASE WHEN len(list_filter(string_split_regex({sql_strip('t')}, '{WS}+'), lambda w: w <> '')) > {_n} THEN array_to_string(list_filter(string_split_regex({sql_strip('t')}, '{WS}+'), lambda w: w <> '')[-{_n}:], ' ') ELSE t END")
_scalar("clean_text", X.clean_text, sql_strip(r"replace(replace(t, chr(160), ' '), chr(8203), '')"))
_scalar("make_id", X.make_id, f"md5({sql_collapse('t')})")
_S = sql_strip("t")
_scalar("is_text_incomplete", X.is_text_incomplete, sql_incomplete("t", X.DANGLING))
_SENTENCE = rf"coalesce(nullif(regexp_extract({_S}, '(.+?[.!?])({WS}|$)', 1), ''), {_S})"
_ITEM = rf"coalesce(list_filter(list_transform(string_split_regex({_S}, '\r\n|\n|\r'), lambda x: {sql_strip('x')}), lambda x: regexp_matches(x, '^[-*•]'))[1], {sql_strip(rf"string_split_regex({_S}, '" + chr(92) + "r" + chr(92) + "n|" + chr(92) + "n|" + chr(92) + "r')[1]")})"
_scalar("first_sentence", X.first_sentence, _SENTENCE)
_scalar("first_list_item", X.first_list_item, _ITEM)
_scalar("normalize_text", X.normalize_text, sql_norm("t"))
_scalar("safe_query", X.safe_query, sql_collapse(r"regexp_replace(t, '[^\p{L}\p{M}\p{N}_\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', ' ', 'g')"))
_scalar("normalize_docname", X.normalize_docname, rf"regexp_replace(regexp_replace(lower({_S}), '{WS}+', '_', 'g'), '[^a-z0-9_]', '', 'g')")
_scalar("normalize_title", X.normalize_title, rf"regexp_replace(regexp_replace(regexp_replace(lower({_S}), '^\d+(\.\d+)*\.?{WS}*', ''), '[.,]', '', 'g'), '{WS}+', '', 'g')")
_scalar("truncate_display", X.truncate_display, "CASE WHEN length(t) > 120 THEN left(t, 120) || '...' ELSE t END")
_scalar("data_uri_payload", X.data_uri_payload, "regexp_replace(t, '^[^,]*,', '')")
_scalar("subsection_label", X.subsection_label, f"CASE WHEN length({sql_strip("regexp_replace(t, '^#+', '')")}) > 300 THEN '' ELSE {sql_strip("regexp_replace(t, '^#+', '')")} END")
_scalar("heading_display", X.heading_display, r"CASE WHEN upper(t) = t AND regexp_matches(t, '\p{Lu}') THEN array_to_string(list_transform(regexp_extract_all(t, '\p{L}+|[^\p{L}]+'), lambda r: upper(left(r, 1)) || lower(substring(r, 2))), '') ELSE t END")


@core(_E + rf"SELECT id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sentence FROM (SELECT id, string_split(regexp_replace(t, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)) AS s FROM e)")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every element."""
    return contents(spark, sf_dir).select("id", F.posexplode(X.split_sentences(F.col("t"))).alias("pos", "sentence"))


@core("SELECT DISTINCT doc_id, file_path, regexp_replace(regexp_replace(regexp_replace(replace(lower(CASE WHEN regexp_matches(b, '^.+\\.[^.]+$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END), ' ', '_'), '[^\\p{L}\\p{N}_\\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS normalized, regexp_replace(b, '[^a-zA-Z0-9._-]', '_', 'g') AS sanitized FROM (SELECT doc_id, file_path, string_split(file_path, '/')[-1] AS b FROM corpus)")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both safe forms of every registered file's name."""
    c = table(spark, sf_dir, "corpus")
    return c.select("doc_id", "file_path", X.normalize_filename(F.col("file_path")).alias("normalized"), X.sanitize_filename(F.col("file_path")).alias("sanitized")).distinct()


@core(f"SELECT DISTINCT doc_id, CASE WHEN prefix_path IS NULL OR prefix_path IN ('', ' > ') THEN 'General' ELSE {sql_strip("regexp_replace(prefix_path, '^( > )+', '')")} END AS section FROM corpus")
def section_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus").select("doc_id", X.section_cleanup(F.col("prefix_path")).alias("section")).distinct()


@core("SELECT DISTINCT id, type, CASE type WHEN 'section_header' THEN '### ' || t WHEN 'list_item' THEN ' - ' || t WHEN 'caption' THEN '[' || t || '] ' WHEN 'footnote' THEN '(footnote: ' || t || ')' WHEN 'formula' THEN CASE WHEN t = '' THEN '' ELSE '[FORMULA]' || chr(10) || t END WHEN 'text' THEN t WHEN 'table' THEN t WHEN 'picture' THEN t ELSE '' END AS out FROM (SELECT id, type, coalesce(content, '') AS t FROM atomic_elements)")
def format_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form of elements by type, applied to the contents as parsed texts."""
    return table(spark, sf_dir, "atomic_elements").select("id", "type", X.format_element(F.col("type"), F.col("content")).alias("out")).distinct()


@core("SELECT DISTINCT doc_id AS id, '[SECTION]: ' || metadata.section || chr(10) || '[CONTENT]: ' || coalesce(text, '') AS out FROM hits")
def store_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits").select(F.col("doc_id").alias("id"), X.store_text(F.col("metadata.section"), F.col("text")).alias("out")).distinct()


@core(f"WITH e AS (SELECT DISTINCT id, type, content AS t FROM atomic_elements WHERE id IS NOT NULL AND content IS NOT NULL) SELECT id, type, CASE WHEN type = 'list_item' THEN {_ITEM} ELSE {_SENTENCE} END AS out FROM e")
def id_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every element that its id is made of."""
    rows = table(spark, sf_dir, "atomic_elements").where("id is not null and content is not null")
    return rows.select("id", "type", X.id_unit(F.col("type"), F.col("content")).alias("out")).distinct()
