"""Registering queries, and what their SQL has in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.runtime import ensure_shipped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space as a class for RE2.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sql_norm(x: str) -> str:
    return sql_collapse(rf"regexp_replace(lower({x}), '{NOT_WORD}', '', 'g')")


def sql_tokens(x: str) -> str:
    return f"greatest(1, trunc(length({x}) / 3.56)::INT)"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({sql_strip(x)}, '{WS}+'), lambda w: w <> '')"


def sql_tail(x: str) -> str:
    """The overlap that goes into the next part."""
    return f"CASE WHEN len({sql_words(x)}) > 61 THEN array_to_string({sql_words(x)}[-61:], ' ') ELSE {x} END"


def sql_incomplete(t: str, dangling: tuple[str, ...]) -> str:
    """Whether a text looks cut."""
    s, many = sql_strip(t), lambda p: f"len(regexp_extract_all({t}, '{p}'))"
    over = " OR ".join(f"{many(chr(92) + a)} > {many(chr(92) + b)}" for a, b in ("()", "[]", "{}"))
    return f"""CASE WHEN {t} IS NULL OR {s} = '' THEN false ELSE
      (NOT regexp_matches(right({s}, 1), '[.!?”"'')\\]]') AND regexp_matches(right({s}, 1), '[\\p{{L}}\\p{{N}}]'))
      OR lower(string_split_regex({s}, '{WS}+')[-1]) IN ({", ".join(f"'{w}'" for w in dangling)})
      OR {over} OR {many('"')} % 2 <> 0 OR {many("“")} <> {many("”")} END"""


def core(sql: str | None = None) -> Callable:
    """Register a query under its function's name; the SQL gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_shipped(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


#: Each element's content once.
CONTENTS = "SELECT DISTINCT id, content AS t FROM atomic_elements WHERE id IS NOT NULL AND content IS NOT NULL"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are made distinct by id and a hash, combined before they are shuffled; a content travels once per id."""
    rows = table(spark, sf_dir, "atomic_elements").where("id is not null and content is not null")
    return rows.groupBy("id", F.xxhash64("content").alias("h")).agg(F.any_value("content").alias("t")).select("id", "t")
