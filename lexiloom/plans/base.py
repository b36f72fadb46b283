"""Registry of queries, loading of tables, and the SQL shared by their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.functions import words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a `Tables` under a name, with the SQL that must give the same rows."""

    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


class Tables:
    """Tables of a folder by name, read when first asked for: t.documents, t.events, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its scan has fewer splits than there are cores; larger inputs are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Words of the corpus as the token table counts them.
WORD = "[a-zà-öø-ÿ]+"

#: CTEs lines(doc_id, lang, source, line_no, line, ws) and tokens(doc_id, lang, source, line_no, n_line, pos, seq, word).
TOK = rf"""
WITH raw_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
lines AS (SELECT *, regexp_extract_all(lower(line), '{WORD}') AS ws FROM raw_lines),
tok AS (SELECT doc_id, lang, source, line_no, len(ws) AS n_line, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lines),
tokens AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) - 1 AS seq FROM tok)
"""

#: CTEs ctok(conv_id, turn, role, n_line, pos, word) of the conversations.
CTOK = rf"""
WITH cl AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '{WORD}') AS ws FROM conversations),
ctok AS (SELECT conv_id, turn, role, len(ws) AS n_line, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM cl)
"""

#: A CASE takes the first hit, so the longest affixes come first.
_PREFIXES, _SUFFIXES = (sorted(x, key=lambda a: (-len(a), a)) for x in (words.PREFIXES, words.SUFFIXES))


def slots_sql(source: str, word: str = "word") -> str:
    """CTEs that add prefix, core and suffix to `source`, ending in a table `slots`."""
    pre = " ".join(f"WHEN starts_with({word}, '{p}') THEN '{p}'" for p in _PREFIXES)
    suf = " ".join(f"WHEN length(rem) > {len(s)} AND ends_with(rem, '{s}') THEN '{s}'" for s in _SUFFIXES)
    return f"""
pre_ AS (SELECT *, CASE {pre} ELSE '' END AS prefix FROM {source}),
rem_ AS (SELECT *, substr({word}, length(prefix) + 1) AS rem FROM pre_),
suf_ AS (SELECT *, CASE {suf} ELSE '' END AS suffix FROM rem_),
slots AS (SELECT *, substr(rem, 1, length(rem) - length(suffix)) AS core FROM suf_)
"""
