"""Input checks and provenance: what a query needs of its tables, and what it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that the queries read, by table.
COLUMNS = {
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}, "pages": {"page_id": "bigint", "url": "string", "html": "string"}, "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}, "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double"},
}


def faults(df: DataFrame, columns: dict[str, str], key: str | None = None) -> list[str]:
    """What is wrong with a table: columns that are missing or of another type, and null or repeated keys, counted in one pass."""
    have = dict(df.dtypes)
    out = [f"no column {c}" if c not in have else f"{c} is {have[c]}, not {kind}" for c, kind in columns.items() if have.get(c) != kind]
    if key in have:
        n = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col(key).isNull(), F.col("n"))).alias("null"), F.count(F.when((F.col("n") > 1) & F.col(key).isNotNull(), 1)).alias("again")).first()
        out += [f"{n['null']} rows without {key}"] if n["null"] else []
        out += [f"{n['again']} values of {key} come more than once"] if n["again"] else []
    return out


def provenance(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(name, rows, columns, checksum) of tables: the checksum does not depend on the order of rows or on files."""
    out = None
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        one = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
        one = one.select(F.lit(name).alias("name"), "rows", F.lit(", ".join(f"{c} {k}" for c, k in df.dtypes)).alias("columns"), "checksum")
        out = one if out is None else out.unionByName(one)
    return out
