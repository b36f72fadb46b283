"""Sequence operators: gaps, lags, segments, ranks, recurrences, reading orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def burstiness(tokens: DataFrame, by: list[str], order: list[str], word: str = "word", least: int = 10) -> DataFrame:
    """(*by, word, n, burst): (sd - mean) / (sd + mean) of the gaps between a word's occurrences, for words with `least` or more; sd is the population's."""
    at = tokens.withColumn("i_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if len(order) > 1 else tokens.withColumn("i_", F.col(order[0]))
    gaps = at.withColumn("gap_", F.col("i_") - F.lag("i_").over(Window.partitionBy(*by, word).orderBy("i_")))
    g = gaps.groupBy(*by, word).agg(F.count("*").alias("n"), F.avg("gap_").alias("m_"), F.stddev_pop("gap_").alias("s_")).where(F.col("n") >= least)
    return g.select(*by, word, "n", F.when(F.col("s_") + F.col("m_") > 0, (F.col("s_") - F.col("m_")) / (F.col("s_") + F.col("m_"))).alias("burst"))


def autocorrelation(rows: DataFrame, by: list[str], order: str, value: Column, lags: int) -> DataFrame:
    """(lag, r): Pearson correlation of the value with itself `lag` rows later, pairs within a group of `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    v = rows.withColumn("v_", value.cast("double"))
    v = v.select("v_", *[F.lag("v_", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    return v.agg(*[F.corr("v_", f"l{k}").alias(f"r{k}") for k in range(1, lags + 1)]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, lags + 1)])).alias("x")).select("x.*")


def recurrence(rows: DataFrame, by: list[str], order: str, symbol: str) -> DataFrame:
    """Columns code (rank of the symbol's first occurrence in its group, from 0), prior (earlier occurrences) and gap (rows since the last one)."""
    own = Window.partitionBy(*by, symbol).orderBy(order)
    firsts = rows.withColumns({"first_": F.min(order).over(Window.partitionBy(*by, symbol)), "prior": F.row_number().over(own) - 1, "gap": F.col(order) - F.lag(order).over(own)})
    return firsts.withColumn("code", F.dense_rank().over(Window.partitionBy(*by).orderBy("first_")) - 1).drop("first_")


def copy_state(gap: Column) -> Column:
    """lag1, lag2-5, lag6-40 or new, from the distance to the last occurrence."""
    return F.when(gap == 1, "lag1").when(gap <= 5, "lag2-5").when(gap <= 40, "lag6-40").otherwise("new")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks of a number from 0, ties sharing their mean; nulls come first.

    From counts of distinct values, added up inside stretches of 4096 and over the stretches before: no group meets in one task.
    """
    c = rows.groupBy(*by, value).agg(F.count("*").alias("c_")).withColumn("b_", F.floor(F.col(value) / 4096))
    c = c.select(*[F.col(k).alias(f"{k}_k") for k in by], F.col(value).alias("value_k"), "c_", "b_")
    keys = [f"{k}_k" for k in by]
    earlier = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))
    blocks = c.groupBy(*keys, "b_").agg(F.sum("c_").alias("n_")).withColumn("o_", earlier(group.orderBy("b_"), "n_"))
    blocks = blocks.select(*[F.col(k).alias(f"{k}k") for k in keys], F.col("b_").alias("b_k"), "o_")
    same = F.col("b_").eqNullSafe(F.col("b_k"))
    back = F.col(value).eqNullSafe(F.col("value_k"))
    for k in by:
        same = same & F.col(f"{k}_k").eqNullSafe(F.col(f"{k}_kk"))
        back = back & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    ranked = c.join(blocks, same).withColumn("r_", F.col("o_") + earlier(Window.partitionBy(*keys, "b_").orderBy("value_k"), "c_") + (F.col("c_") - 1) / 2)
    return rows.join(ranked.select(*keys, "value_k", "r_"), back).select(*rows.columns, F.col("r_").alias(name))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    ranked = average_ranks(average_ranks(rows, by, x, "rx_"), by, y, "ry_")
    return ranked.groupBy(*by).agg(F.corr("rx_", "ry_").alias(name))


def equal_chunks(rows: DataFrame, by: list[str], order: str | list[str], chunks: int, block: Column, name: str = "chunk") -> DataFrame:
    """`chunks` stretches of n div chunks rows each in order; the rest at the end goes. `block` as in `ranks`."""
    order = [order] if isinstance(order, str) else order
    size = rows.groupBy(*[F.col(c).alias(f"{c}_k") for c in by]).agg(F.floor(F.count("*") / chunks).alias("k_"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    at = ranks(rows, by, block, order, "i_").join(size, same).where("k_ > 0")
    return at.withColumn(name, F.floor((F.col("i_") - 1) / F.col("k_")).cast("int")).where(F.col(name) < chunks).select(*rows.columns, name)


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two bags given as arrays of words."""
    both = F.array_distinct(F.concat(a, b))
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x)).cast("double")
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda acc, x: acc + f(x))
    norm = F.sqrt(total(lambda x: count(a, x) * count(a, x)) * total(lambda x: count(b, x) * count(b, x)))
    return F.when(norm > 0, total(lambda x: count(a, x) * count(b, x)) / norm).otherwise(0.0)


def stride(rows: DataFrame, order: str, k: int, offset: int) -> DataFrame:
    return rows.where(F.pmod(F.col(order), F.lit(k)) == offset)


def reading_order(line: Column, pos: Column, n_line: Column, mode: str) -> list[Column]:
    """Sort keys of another reading order of a page: reverse, boustrophedon, columns (ragged), even_odd."""
    if mode == "forward":
        return [line, pos]
    if mode == "reverse":
        return [-line, -pos]
    if mode == "boustrophedon":
        return [line, F.when(line % 2 == 1, n_line - 1 - pos).otherwise(pos)]
    if mode == "columns":
        return [pos, line]
    if mode == "even_odd":
        return [pos % 2, line, pos]
    raise ValueError(mode)


def reverse_interior(rows: DataFrame, by: list[str], pos: str = "pos", n: str = "n_line", name: str = "pos_new") -> DataFrame:
    """Places of a line with the order of its words reversed between the first two and the last two."""
    p, m = F.col(pos), F.col(n)
    return rows.withColumn(name, F.when((p >= 2) & (p < m - 2), m - 1 - p).otherwise(p))


def ranks(rows: DataFrame, by: list[str], block: Column, order: list, name: str = "rank") -> DataFrame:
    """Column `name`: row_number() of `order` within `by`, without a group meeting in one task.

    `block` cuts a group into stretches and must not fall along `order`, like doc_id // 4096 for an order by doc_id or
    the first digits of a hash for an order by it. Rows are numbered inside their stretch; the rows before it come from a
    table with one row for each group and stretch.
    """
    cut = rows.withColumn("block_", block)
    size = cut.groupBy(*by, "block_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = size.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("block_").alias("block__"), before.alias("before_"))
    same = F.col("block_").eqNullSafe(F.col("block__"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    inner = cut.withColumn(name, F.row_number().over(Window.partitionBy(*by, "block_").orderBy(*order)))
    return inner.join(start, same).withColumn(name, F.col(name) + F.col("before_")).select(*rows.columns, name)


def depth_boundaries(curve: DataFrame, by: list[str], order: str, value: str, reach: int = 6, eps: float = 1e-9) -> DataFrame:
    """Rows of a similarity curve that are section limits, with column depth: how far the value lies below the peaks within `reach` rows on either side.

    A limit is deeper than the mean plus one (population) deviation of its group's depths and no shallower than its
    neighbours; the first and the last row of a group are none.
    """
    w = Window.partitionBy(*by).orderBy(order)
    peak = lambda a, b: F.max(value).over(w.rowsBetween(a, b))
    d = curve.withColumn("depth", peak(-reach, 0) + peak(0, reach) - 2 * F.col(value))
    level = d.groupBy(*[F.col(c).alias(f"{c}__") for c in by]).agg((F.avg("depth") + F.stddev_pop("depth")).alias("level_"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    d = d.withColumns({"before_": F.lag("depth").over(w), "after_": F.lead("depth").over(w)}).join(level, same)
    return d.where((F.col("depth") > F.col("level_") + eps) & (F.col("depth") >= F.col("before_") - eps) & (F.col("depth") >= F.col("after_") - eps)).select(*curve.columns, "depth")


def offsets(sizes: DataFrame, by: list[str], key: str, size: str, block: Column, name: str = "offset") -> DataFrame:
    """Column `name`: the sum of `size` over rows of a smaller key within `by`, without a group meeting in one task; `block` as in `ranks`."""
    cut = sizes.withColumn("block_", block)
    total = cut.groupBy(*by, "block_").agg(F.sum(size).alias("n_"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n_").over(every.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = total.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("block_").alias("block__"), before.alias("before_"))
    same = F.col("block_").eqNullSafe(F.col("block__"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy(*by, "block_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("inner_", inner).join(start, same).withColumn(name, F.col("inner_") + F.col("before_")).select(*sizes.columns, name)


def neighbours(rows: DataFrame, by: list[str], stretch: Column, order: str, value: str, name: str = "before") -> DataFrame:
    """Column `name`: the value of the row before within `by`; stretches as in `ranks`, their edges met by a table with a row for each of them."""
    cut = rows.withColumn("block_", stretch)
    w = Window.partitionBy(*by, "block_").orderBy(order)
    cut = cut.withColumns({name: F.lag(value).over(w), "first_": F.row_number().over(w) == 1})
    last = cut.groupBy(*by, "block_").agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))["v"].alias("last_"))
    edge = last.withColumn("edge_", F.lag("last_").over(Window.partitionBy(*by).orderBy("block_") if by else Window.orderBy("block_")))
    edge = edge.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("block_").alias("block__"), "edge_")
    same = F.col("block_").eqNullSafe(F.col("block__"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return cut.join(edge, same).withColumn(name, F.when(F.col("first_"), F.col("edge_")).otherwise(F.col(name))).select(*rows.columns, name)
