"""Mixing sources to target weights by Pareto order sampling.

Shares are water-filled under a cap on repeats. A source that gets c whole copies and a fraction f of itself keeps
every document c times for certain; the fraction is a Pareto order sample: documents are ranked by the odds of a
random number over their own odds of being included, and the ranking is cut where the words reach the target. The
inclusion odds are f / (1 - f) times the square root of the document's size over the mean size of its source, so that a
document of four times the words is taken at twice the odds: a sample of as many words then keeps more whole long
documents, without leaving out the short ones. The random number is a hash of seed and doc_id, so reruns agree whatever
the partitions are.

The cut is found by counting words in 4096 buckets of the rank, then in 4096 parts of the bucket that holds the cut,
and ranking only what is left: no source's documents ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialize

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUCKETS = 4096
#: A table of as many sources may be broadcast (about 100 bytes each).
MOST_BROADCAST = 100_000


def _with(docs: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """docs joined to its source's row (columns source_ ...), null sources too."""
    right = F.broadcast(sources) if n <= MOST_BROADCAST else sources
    return docs.join(right, F.col("source").eqNullSafe(F.col("source_")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source_, source_size, n_docs, target, num, den) from (source, source_size, n_docs); target = num / den words.

    Sources by code point, null last, weigh `weights` in turn and share share[0] / share[1] of all sizes; a target stops
    at `most` times its source's size, and what is above goes to the others by weight. One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    rows = sizes.withColumn("k", F.row_number().over(by_name) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumns({"cap": F.col("source_size") * most, "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
    # ascending cap / w, compared exactly enough by the double and finally by name
    order = Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"c": F.coalesce(F.sum("cap").over(order), zero), "left": F.col("all_w") - F.coalesce(F.sum("w").over(order), zero)})
    up, down = share
    capped = F.col("w") * (F.col("total") * up - F.col("c") * down) >= F.col("cap") * F.col("left") * down
    rows = rows.withColumn("capped", capped)
    rows = rows.withColumns({"c_all": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every), "w_all": F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(every)})
    num = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * (F.col("total") * up - F.col("c_all") * down))
    den = F.when(F.col("capped"), F.lit(1).cast("long")).otherwise(F.col("w_all") * down)
    return rows.select(F.col("source").alias("source_"), "source_size", "n_docs", num.alias("num"), den.alias("den")).withColumn("target", F.col("num") / F.col("den"))


def plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> tuple[DataFrame, int]:
    """The table of sources with their targets, whole copies and cuts, and its number of rows; docs: doc_id, source, size, u."""
    rows = materialize(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sizes")
    given = materialize(targets(rows, weights, share, most), "mix-targets")
    n = given.count()
    full = F.col("den") * F.col("source_size")
    given = given.withColumn("copies", F.when(full > 0, (F.col("num") - F.col("num") % full) / full).otherwise(0).cast("int"))
    given = given.withColumns({"f": F.when(full > 0, (F.col("num") % full) / full).otherwise(0.0), "rest": F.col("target") - F.col("copies") * F.col("source_size")})
    ranked = _with(docs, given.where("f > 0").select("source_", "source_size", "n_docs", "f", "rest"), n).withColumn("v", rank_expr())
    levels = ranked.select("source", "doc_id", "size", "v", "rest", F.lit(0).cast("long").alias("before"))
    for level in range(2):
        scaled = F.col("v") * F.lit(float(BUCKETS ** (level + 1)))
        levels = levels.withColumn("b", F.floor(scaled).cast("long"))
        sums = levels.groupBy("source", "b").agg(F.sum("size").alias("words"), F.first("rest").alias("rest_"), F.first("before").alias("before_"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        held = sums.withColumn("c", F.col("before_") + F.coalesce(F.sum("words").over(run), F.lit(0).cast("long"))).where("c <= rest_ and rest_ < c + words")
        held = materialize(held.select(F.col("source").alias("source_"), F.col("b").alias("b_"), F.col("c").alias("c_")), "mix-cut")
        right = F.broadcast(held) if n <= MOST_BROADCAST else held
        levels = levels.join(right, F.col("source").eqNullSafe(F.col("source_")) & (F.col("b") == F.col("b_"))).select("source", "doc_id", "size", "v", "rest", F.col("c_").alias("before"))
    last = Window.partitionBy("source").orderBy("v", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("c", F.col("before") + F.coalesce(F.sum("size").over(last), F.lit(0).cast("long")))
    # the first one out: everything before it in rank order is in
    out = levels.where("2 * c + size > 2 * rest").groupBy("source").agg(F.min(F.struct("v", F.col("doc_id").alias("id"), "size")).alias("stop")).select(F.col("source").alias("s_"), "stop")
    # where all of the last part goes in, the cut is behind it
    held = held.withColumn("edge", (F.col("b_") + 1) / F.lit(float(BUCKETS**2))).select(F.col("source_").alias("h_"), "edge")
    cut = given.join(out, F.col("source_").eqNullSafe(F.col("s_")), "left").join(held, F.col("source_").eqNullSafe(F.col("h_")), "left").drop("s_", "h_")
    return materialize(cut, "mix-plan"), n


def rank_expr():
    """Pareto rank as odds / (1 + odds): random odds u / (1 - u) over the document's inclusion odds."""
    larger = F.sqrt(((F.col("size") + 1) * F.col("n_docs")).cast("double") / (F.col("source_size") + F.col("n_docs")).cast("double"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")) * larger)
    return odds / (1 + odds)


def taken(docs: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    """docs with source_size, target and `times`, how often the mix takes the document."""
    rows = _with(docs, cut, n)
    me = F.struct(F.col("v"), F.col("doc_id").alias("id"), F.col("size"))
    inside = F.when(F.col("f") <= 0, False).when(F.col("stop").isNotNull(), me < F.col("stop")).otherwise(F.col("v") < F.col("edge"))
    rows = rows.withColumn("v", F.when(F.col("f") > 0, rank_expr()))
    return rows.withColumn("times", F.col("copies") + F.coalesce(inside, F.lit(False)).cast("int"))


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col("text"), F.lit(""))))
    draw = F.md5(F.concat(F.lit(seed + "|"), own).cast("binary"))
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return docs.withColumns({"size": size, "u": u})


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    size is the number of words, 0 for a null text; taken is the number of words that the mix takes of the row. Null
    sources are one source, the last. Rows that share a doc_id share their random number and are ranked by size; rows
    without one draw theirs by text. Texts of any length are whole documents: one at the cut of its source is taken if
    that brings the words nearer to the target. Other columns are ignored; an empty table gives an empty result.
    """
    base = materialize(_measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")), seed).drop("text"), "mix-base")
    cut, n = plan(base, seed, weights, share, most)
    return taken(base, cut, n).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """The mix itself: the rows of docs as often as it takes them, columns as they are. Text never moves between executors.

    Nulls, empty and long texts, repeated rows and empty tables are as in `mix`; documents without words, whose taken
    words are none, come as often as their rank says.
    """
    names = docs.columns
    base = _measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source"), seed).drop("text")
    slim = materialize(base.select("doc_id", "source", "size", "u"), "mix-base")
    cut, n = plan(slim, seed, weights, share, most)
    rows = taken(base, cut, n).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM base GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM k),
a AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
        coalesce(sum(cap) OVER o, 0) AS c, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, w * (3 * total - 2 * c) >= 2 * cap * rest_w AS capped FROM a),
d AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS c_all, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_all FROM b),
e AS (SELECT source, source_size, n_docs, CAST(CASE WHEN capped THEN cap ELSE w * (3 * total - 2 * c_all) END AS BIGINT) AS num,
        CAST(CASE WHEN capped THEN 1 ELSE 2 * w_all END AS BIGINT) AS den FROM d),
t AS (SELECT *, num::DOUBLE / den::DOUBLE AS target,
        CASE WHEN source_size > 0 THEN num // (den * source_size) ELSE 0 END AS copies,
        CASE WHEN source_size > 0 THEN (num % (den * source_size))::DOUBLE / (den * source_size)::DOUBLE ELSE 0.0::DOUBLE END AS f FROM e),
q AS (SELECT base.doc_id, base.source, size, source_size, target, copies, f, target - copies * source_size AS rest,
        CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f) * sqrt(((size + 1) * n_docs)::DOUBLE / (source_size + n_docs)::DOUBLE)) END AS odds
      FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN f > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
