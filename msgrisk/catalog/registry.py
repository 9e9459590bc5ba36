"""Registration of catalog queries and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from msgrisk.operators.scale import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# Tables whose rows are costly to process, with the columns that identify a row.
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A provided table; text tables delivered as one split are spread over the cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, *TEXT_TABLES[name]) if name in TEXT_TABLES else df


# --- SQL twins of column builders ----------------------------------------------------

SQL_WORD = r"\p{L}\p{N}_"
SQL_SPACE = r"\s\p{Z}\x1c-\x1f"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[{SQL_SPACE}]+', ' ', 'g'))"


def sql_family(x: str) -> str:
    c = rf"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13)))"
    c = rf"regexp_replace({c}, '[{SQL_WORD}][{SQL_WORD}.+-]*@[{SQL_WORD}.-]+\.[a-z]{{2,}}', ' <email> ', 'g')"
    c = rf"regexp_replace({c}, '(^|[^{SQL_WORD}])(https?://|www\.)[^{SQL_SPACE}]+', '\1 <url> ', 'g')"
    for _ in range(2):  # a delimiter is consumed by each match, so neighbors need a second pass
        c = rf"regexp_replace({c}, '(^|[^{SQL_WORD}])\p{{Nd}}+($|[^{SQL_WORD}])', '\1 <number> \2', 'g')"
    return sql_squeeze(c)


def sql_family_id(x: str) -> str:
    return f"'content:' || substr(sha256({sql_family(x)}), 1, 20)"


def sql_template(x: str) -> str:
    c = f"lower(upper({x}))"
    c = rf"regexp_replace({c}, 'https?://[^{SQL_SPACE}<>]+', '<url>', 'g')"
    c = rf"regexp_replace({c}, '[{SQL_WORD}][{SQL_WORD}.+-]*@[{SQL_WORD}.-]+\.[a-z]{{2,}}', '<email>', 'g')"
    c = rf"regexp_replace({c}, '\p{{Nd}}+', '<number>', 'g')"
    return sql_squeeze(c)


def sql_wilson(s: str, n: str, upper: bool) -> str:
    z = "1.959963984540054"
    rate = f"({s}::DOUBLE / {n})"
    center = f"({rate} + {z}*{z}/(2.0*{n}))"
    margin = f"({z} * sqrt({rate}*(1-{rate})/{n} + {z}*{z}/(4.0*{n}*{n})))"
    den = f"(1 + {z}*{z}/{n})"
    if upper:
        return f"CASE WHEN {n}=0 THEN NULL WHEN {s}={n} THEN 1.0 ELSE least(1.0, {center}/{den} + {margin}/{den}) END"
    return f"CASE WHEN {n}=0 THEN NULL WHEN {s}=0 THEN 0.0 ELSE greatest(0.0, {center}/{den} - {margin}/{den}) END"
