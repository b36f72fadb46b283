"""Count-based models: smoothed n-grams, held-out scores by subtraction, naive Bayes, mixtures, linear fits.

Counts are aggregated before anything is joined to them, so that models meet distinct n-grams and not the stream, and
leaving a block out is a subtraction of its counts from the total, not a second fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.info import counts


def leave_out_transition_gain(pairs: DataFrame, block: str, cell: str, x: str, y: str, alpha: float = 0.5) -> DataFrame:
    """(block, n, gain): mean log2 of the smoothed p(y | cell, x) over p(y | cell), each block scored by the counts of all others."""
    c = counts(pairs, [cell, x, y], [block])
    part = lambda *k: F.sum("c").over(Window.partitionBy(*k)) - F.sum("c").over(Window.partitionBy(*k, block))
    values = c.select(y).distinct().agg(F.count("*").alias("v"))
    s = c.withColumns({"xy": part(cell, x, y), "x_": part(cell, x), "y_": part(cell, y), "t_": part(cell)}).join(F.broadcast(values))
    p = (F.col("xy") + alpha) / (F.col("x_") + alpha * F.col("v"))
    q = (F.col("y_") + alpha) / (F.col("t_") + alpha * F.col("v"))
    return s.groupBy(block).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.log2(p / q)) / F.sum("c")).alias("gain"))


def trigram_model(words: DataFrame, word: str = "word", alpha: float = 0.1) -> DataFrame:
    """(gram, logp): add-alpha letter trigrams of ^^word$, log2 p(third | first two)."""
    w = F.concat(F.lit("^^"), F.col(word), F.lit("$"))
    grams = words.groupBy(word).agg(F.count("*").alias("k")).select("k", F.explode(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))).alias("gram"))
    c = grams.groupBy("gram").agg(F.sum("k").alias("c"))
    v = c.select(F.substring("gram", 3, 1).alias("x")).distinct().agg(F.count("*").alias("v"))
    total = F.sum("c").over(Window.partitionBy(F.substring("gram", 1, 2)))
    return c.withColumn("t", total).join(F.broadcast(v)).select("gram", F.log2((F.col("c") + alpha) / (F.col("t") + alpha * F.col("v"))).alias("logp"))


def nested_backoff(pairs: DataFrame, block: str, levels: list[list[str]], y: str, mass: float = 8.0) -> DataFrame:
    """(block, n, bits0, bits1, ...): mean -log2 p(y) by nested contexts, each shrunk to the one before with `mass` pseudo-counts; blocks are scored by all others.

    Level 0 is the uniform distribution over the values of y; a context that the others lack gives pure backoff.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    c = counts(pairs, [*keys, y], [block])
    part = lambda *k: F.sum("c").over(Window.partitionBy(*k)) - F.sum("c").over(Window.partitionBy(*k, block))
    values = c.select(y).distinct().agg(F.count("*").alias("v"))
    s = c.join(F.broadcast(values)).withColumn("p0", 1 / F.col("v"))
    whole = c.agg(F.sum("c").alias("whole_"))
    rest = c.groupBy(F.col(block).alias("b__")).agg(F.sum("c").alias("own_")).join(F.broadcast(whole)).select("b__", (F.col("whole_") - F.col("own_")).alias("rest_"))
    s = s.join(F.broadcast(rest), F.col(block).eqNullSafe(F.col("b__"))).drop("b__")  # a row for each block
    for i, level in enumerate(levels, 1):
        s = s.withColumns({f"h{i}": part(*level, y), f"t{i}": part(*level) if level else F.col("rest_")})
        s = s.withColumn(f"p{i}", (F.col(f"h{i}") + mass * F.col(f"p{i - 1}")) / (F.col(f"t{i}") + mass))
    bits = [(F.sum(-F.col("c") * F.log2(f"p{i}")) / F.sum("c")).alias(f"bits{i}") for i in range(len(levels) + 1)]
    return s.groupBy(block).agg(F.sum("c").alias("n"), *bits)


def naive_bayes_leave_out(rows: DataFrame, doc: str, label: str, block: str, feature: str, alpha: float = 0.5, least_df: int = 2) -> DataFrame:
    """(doc, label, predicted): multinomial naive Bayes with a uniform prior, each document scored by the other blocks' counts; features of least_df documents or more.

    A feature that no other block has counts as unseen for all labels alike. Ties go to the smaller label.
    """
    c = rows.groupBy(doc, label, block, feature).agg(F.count("*").alias("c"))
    df = c.groupBy(feature).agg(F.count("*").alias("df")).where(F.col("df") >= least_df).select(feature)
    c = c.join(df, feature)
    per = c.groupBy(block, label, feature).agg(F.sum("c").alias("n"))
    labels = c.select(label).distinct().withColumnRenamed(label, "y_")
    size = df.agg(F.count("*").alias("v"))
    total = per.groupBy(feature, F.col(label).alias("y_")).agg(F.sum("n").alias("all_"))
    own = per.select(F.col(feature), F.col(block), F.col(label).alias("y_"), F.col("n").alias("own_"))
    mass_all = per.groupBy(F.col(label).alias("y_")).agg(F.sum("n").alias("m_all"))
    mass_own = per.groupBy(F.col(label).alias("y_"), block).agg(F.sum("n").alias("m_own"))
    s = c.join(F.broadcast(labels)).join(total, [feature, "y_"], "left").join(own, [feature, block, "y_"], "left").join(F.broadcast(mass_all), "y_", "left").join(mass_own, ["y_", block], "left").join(F.broadcast(size))
    zero = lambda x: F.coalesce(x, F.lit(0))
    p = (zero("all_") - zero("own_") + alpha) / (zero("m_all") - zero("m_own") + alpha * F.col("v"))
    score = s.groupBy(doc, label, "y_").agg(F.round(F.sum(F.col("c") * F.log(p)), 6).alias("s"))
    return score.groupBy(doc, label).agg(F.max(F.struct(F.col("s"), (-F.col("y_")).alias("k"))).alias("m")).select(doc, label, (-F.col("m.k")).alias("predicted"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def classification_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, balanced, macro_f1) of a labelled table."""
    c = confusion(rows, truth, predicted)
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    t = c.groupBy(F.col(truth).alias("y")).agg(F.sum("n").alias("t"), F.sum(hit).alias("h"))
    p = c.groupBy(F.col(predicted).alias("y")).agg(F.sum("n").alias("p"))
    s = t.join(p, "y", "left")
    recall, precision = F.col("h") / F.col("t"), F.when(F.coalesce("p", F.lit(0)) > 0, F.col("h") / F.col("p")).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return s.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(recall).alias("balanced"), F.avg(f1).alias("macro_f1"))


def average_precision(rows: DataFrame, by: list[str], score: Column, key: str, relevant: Column) -> DataFrame:
    """(by, ap): mean of the precision at each relevant row, ranked by falling score, ties by key."""
    w = Window.partitionBy(*by).orderBy(score.desc(), key)
    r = rows.withColumns({"k_": F.row_number().over(w), "rel_": relevant.cast("int")}).withColumn("hits_", F.sum("rel_").over(w))
    return r.groupBy(*by).agg(F.avg(F.when(F.col("rel_") == 1, F.col("hits_") / F.col("k_"))).alias("ap"))


def mixture_weights(rows: DataFrame, components: list[str], weight: str, rounds: int = 30) -> list[float]:
    """EM weights of fixed component probabilities (columns), rows counted `weight` times; one aggregate a round, a row each to the driver."""
    pi = [1 / len(components)] * len(components)
    held = rows.select(weight, *components).persist()
    try:
        for _ in range(rounds):
            joint = [p * F.col(c) for p, c in zip(pi, components, strict=True)]
            total = sum(joint[1:], joint[0])
            got = held.where(total > 0).agg(*[(F.sum(F.col(weight) * j / total) / F.sum(weight)).alias(f"p{i}") for i, j in enumerate(joint)]).first()
            pi = [float(got[f"p{i}"]) for i in range(len(components))]
    finally:
        held.unpersist()
    return pi


def ols_1d(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def nearest_centroid(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, predicted): the label whose mean vector is nearest, each row taken out of its own label's mean."""
    at = rows.select(key, label, F.posexplode(vector).alias("i", "x"))
    sums = at.groupBy(label, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    cents = sums.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "s", "n"))).alias("c")).select(F.col(label).alias("y_"), F.transform("c", lambda v: v["s"]).alias("s_"), F.element_at("c", 1)["n"].alias("n_"))
    both = rows.select(key, label, vector).join(F.broadcast(cents))  # one row for each label
    own = F.col(label) == F.col("y_")
    n = F.col("n_") - own.cast("int")
    d = F.aggregate(F.zip_with(vector, "s_", lambda v, s: F.pow(v - (s - F.when(own, v).otherwise(0.0)) / n, 2)), F.lit(0.0).cast("double"), lambda a, z: a + z)
    return both.where(n > 0).groupBy(key, label).agg(F.min(F.struct(F.round(d, 9).alias("d"), "y_")).alias("m")).select(key, label, F.col("m.y_").alias("predicted"))
