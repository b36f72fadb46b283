"""Entropies, mutual information and divergences as aggregates, in bits. `by` columns give one result each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def r6(x):
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def counts(df: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, *keys).agg(F.count("*").alias("c"))


def _entropy_of(c: DataFrame, by: list[str], name: str, n: str = "c") -> DataFrame:
    """Entropy of counts: log2 N - sum c log2 c / N, one pass of partial aggregation."""
    c_ = F.col(n).cast("double")
    total = F.sum(c_)
    return c.groupBy(*by).agg((F.log2(total) - F.sum(c_ * F.log2(c_)) / total).alias(name))


def entropy(df: DataFrame, keys: list[str], by: list[str] = (), name: str = "h") -> DataFrame:
    return _entropy_of(counts(df, keys, by), list(by), name)


def conditional_entropy(df: DataFrame, x: list[str], given: list[str], by: list[str] = (), name: str = "h") -> DataFrame:
    """H(x | given) = sum over the given of c log2 c, less the same over both, by their number."""
    both = counts(df, [*given, *x], by)
    c = F.col("c").cast("double")
    inner = both.groupBy(*by, *given).agg(F.sum(c).alias("g__"), F.sum(c * F.log2(c)).alias("s__"))
    return inner.groupBy(*by).agg((F.sum(F.col("g__") * F.log2("g__") - F.col("s__")) / F.sum("g__")).alias(name))


def mutual_information(df: DataFrame, x: str, y: str, by: list[str] = (), name: str = "mi") -> DataFrame:
    """I(x; y) from one table of joint counts; nulls are a value like any other."""
    by = list(by)
    joint = counts(df, [x, y], by)
    c = F.col("c").cast("double")
    n = joint.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * F.log2(c)).alias("sxy"))
    part = lambda k, s: joint.groupBy(*by, k).agg(F.sum(c).alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.log2("m")).alias(s))
    if by:
        out = n.join(part(x, "sx"), by).join(part(y, "sy"), by)
    else:
        out = n.join(F.broadcast(part(x, "sx"))).join(F.broadcast(part(y, "sy")))  # one row each
    return out.select(*by, (F.log2("n") + (F.col("sxy") - F.col("sx") - F.col("sy")) / F.col("n")).alias(name))


def normalized_mi(df: DataFrame, x: str, y: str, by: list[str] = (), name: str = "nmi") -> DataFrame:
    """I(x; y) over the smaller of both entropies; 0 where that is 0."""
    by = list(by)
    parts = [mutual_information(df, x, y, by), entropy(df, [x], by, "hx"), entropy(df, [y], by, "hy")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.join(F.broadcast(p))
    low = F.least("hx", "hy")
    return out.select(*by, F.when(low > 1e-12, F.col("mi") / low).otherwise(0.0).alias(name))


def stratified_mi(df: DataFrame, x: str, y: str, stratum: list[str], name: str = "mi") -> DataFrame:
    """Mean of the strata's mutual information, weighted by their rows."""
    n = df.groupBy(*stratum).agg(F.count("*").alias("n"))
    return mutual_information(df, x, y, stratum, "mi_").join(n, stratum).agg((F.sum(F.col("mi_") * F.col("n")) / F.sum("n")).alias(name))


def information_gain(df: DataFrame, feature: str, column: str, by: list[str] = (), name: str = "ig") -> DataFrame:
    """H(feature) - H(feature | column), which is their mutual information."""
    return mutual_information(df, feature, column, by, name)


def shares(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): relative frequencies."""
    c = df.groupBy(key).agg(F.count("*").alias("c"))
    return c.join(F.broadcast(c.agg(F.sum("c").alias("t_")))).select(key, (F.col("c") / F.col("t_")).alias(name))  # one row is broadcast


def kl(p: DataFrame, q: DataFrame, key: str, rule: str = "floor", eps: float = 1e-9, name: str = "kl") -> DataFrame:
    """KL(p || q) of two tables of keys. floor: both floored at eps over all keys; support: log2(p / (q + eps)) over the keys of p."""
    both = shares(p, key, "p").join(shares(q, key, "q"), key, "full" if rule == "floor" else "left")
    if rule == "floor":
        a, b = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(eps))
        return both.agg(F.sum(a * F.log2(a / b)).alias(name))
    return both.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.coalesce("q", F.lit(0.0)) + eps))).alias(name))


def total_variation(p: DataFrame, q: DataFrame, context: list[str], symbol: str, name: str = "tv") -> DataFrame:
    """Total variation between two tables of conditional counts (context, symbol, c), weighted by the contexts' totals in both; contexts of one side alone count as 1."""
    share = lambda d, s: d.withColumn(s + "t", F.sum("c").over(Window.partitionBy(*context))).select(*context, symbol, (F.col("c") / F.col(s + "t")).alias(s), s + "t")
    both = share(p, "p").join(share(q, "q"), [*context, symbol], "full")
    per = both.groupBy(*context).agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("d"), (F.coalesce(F.max("pt"), F.lit(0)) + F.coalesce(F.max("qt"), F.lit(0))).alias("w"), F.max("pt").alias("a"), F.max("qt").alias("b"))
    d = F.when(F.col("a").isNull() | F.col("b").isNull(), 1.0).otherwise(F.col("d") / 2)
    return per.agg((F.sum(d * F.col("w")) / F.sum("w")).alias(name))
