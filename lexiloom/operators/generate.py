"""Surrogate text. Independent draws are joins on hash uniforms; sources that copy from their own output run a replicate to a task."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.words import uniform
from lexiloom.operators.sequence import offsets, ranks


def cumulative(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """(by, value, lo, hi): the values of a context on the unit interval, in order of the value; summed in stretches of values that begin alike."""
    held = counts.select(*by, value, F.col(n).alias("n_"))
    total = held.groupBy(*[F.col(k).alias(f"{k}_t") for k in by]).agg(F.sum("n_").alias("t_"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_t"))
    at = offsets(held, by, value, "n_", F.substring(value, 1, 2), "o_")
    at = at.join(total, same) if by else at.join(F.broadcast(total))  # one row
    return at.select(*by, value, (F.col("o_") / F.col("t_")).alias("lo"), ((F.col("o_") + F.col("n_")) / F.col("t_")).alias("hi"))


#: Parts of the unit interval by which draws meet the values that lie in them, where there is no context to meet by.
PARTS = 4096


def draw(rows: DataFrame, table: DataFrame, by: list[str], value: str, u: Column) -> DataFrame:
    """rows with a value drawn from the table of their context: inverse distribution function, by an equi-join on the context, or else on the part of the unit interval."""
    parts = 1 if by else PARTS
    last = F.least(F.floor(F.col("hi") * parts), F.lit(parts - 1))
    t = table.select(*[F.col(k).alias(f"{k}_t") for k in by], F.col(value), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.explode(F.sequence(F.least(F.floor(F.col("lo") * parts), F.lit(parts - 1)), last)).alias("part_t"))
    hit = (F.col("part_") == F.col("part_t")) & (F.col("u_") >= F.col("lo_")) & (F.col("u_") < F.col("hi_"))
    for k in by:
        hit = hit & F.col(k).eqNullSafe(F.col(f"{k}_t"))
    return rows.withColumn("u_", u).withColumn("part_", F.floor(F.col("u_") * parts)).join(t, hit).drop("u_", "lo_", "hi_", "part_", "part_t", *[f"{k}_t" for k in by])


def schema_words(slots: DataFrame, n: int, seed: str) -> DataFrame:
    """(i, word): n words by P(core), P(prefix | core), P(suffix | core) of a table of slots, counted n_words times a row if it has that column."""
    weight = F.sum("n_words") if "n_words" in slots.columns else F.count("*")
    held = slots.groupBy("core", "prefix", "suffix").agg(weight.alias("n"))
    count = lambda *k: held.groupBy(*k).agg(F.sum("n").alias("n"))
    rows = slots.sparkSession.range(n).withColumnRenamed("id", "i")
    i = F.col("i").cast("string")
    rows = draw(rows, cumulative(count("core"), [], "core"), [], "core", uniform(seed, "core", i))
    for part in ("prefix", "suffix"):
        rows = draw(rows, cumulative(count("core", part), ["core"], part), ["core"], part, uniform(seed, part, i))
    return rows.select("i", F.concat("prefix", "core", "suffix").alias("word"))


def homophonic(letters: DataFrame, letter: str, key: list[Column], homophones: int, seed: str) -> DataFrame:
    """Column symbol: the letter and one of its homophones, by hash of the row's key."""
    pick = F.floor(uniform(seed, *[k.cast("string") for k in key]) * homophones).cast("int")
    return letters.withColumn("symbol", F.concat(letter, pick.cast("string")))


def reflow(template: DataFrame, stream: DataFrame, order: list[str], block: Column, index: str = "i", word: str = "word") -> DataFrame:
    """The lines of a template filled with the words of a stream, in order; positions beyond the stream go. `block` as in `sequence.ranks`."""
    at = ranks(template.drop(word), [], block, order, index).withColumn(index, F.col(index) - 1)
    return at.join(stream.select(index, word), index)


def _hash_unit(*parts: object) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def wheel(value: str, n: str = "n") -> Column:
    """An aggregate: values in order with the counts up to and with each, for draws by `turn`."""
    rows = F.array_sort(F.collect_list(F.struct(value, n)))
    sums = F.aggregate(rows, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x[n])))
    return F.struct(F.transform(rows, lambda x: x[value]).alias("values"), sums.alias("sums"))


def turn(drawn: Column, u: Column) -> Column:
    """The value of a wheel at u in [0, 1)."""
    at = F.floor(u * F.element_at(drawn["sums"], -1))
    return F.get(drawn["values"], F.size(F.filter(drawn["sums"], lambda s: s <= at)))


def letter_chains(words: DataFrame, by: list[str], order: int = 1, word: str = "word") -> DataFrame:
    """(by, chain): for each group one map from `order` letters (^ before a word) to the wheel of the letters that follow ($ ends a word), by tokens.

    A row holds an alphabet to the power order + 1 at most, whatever the corpus is.
    """
    counts = words.groupBy(*by, word).agg(F.count("*").alias("k"))
    w = F.concat(F.lit("^" * order), F.col(word), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(w) - order), lambda i: F.struct(F.substring(w, i, F.lit(order)).alias("ctx"), F.substring(w, i + order, F.lit(1)).alias("v")))
    n = counts.select(*by, "k", F.explode(grams).alias("g")).groupBy(*by, "g.ctx", "g.v").agg(F.sum("k").alias("n"))
    return n.groupBy(*by, "ctx").agg(wheel("v").alias("wheel")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ctx", "wheel"))).alias("chain"))


def chain_word(chain: Column, order: int, u, longest: int = 40) -> Column:
    """A word drawn from a chain of `letter_chains`; u gives the uniform number of the j-th letter, from 0. One expression, no UDF."""

    def step(acc: Column, j: Column) -> Column:
        drawn = F.when(acc["end"], F.lit("$")).otherwise(turn(F.element_at(chain, acc["ctx"]), u(j)))
        end = drawn == "$"
        return F.struct(F.when(end, acc["ctx"]).otherwise(F.concat(F.substring(acc["ctx"], 2, order), drawn)).alias("ctx"), end.alias("end"), F.when(end, acc["word"]).otherwise(F.concat(acc["word"], drawn)).alias("word"))

    start = F.struct(F.lit("^" * order).alias("ctx"), F.lit(False).alias("end"), F.lit("").alias("word"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(longest - 1)), start, step, lambda acc: acc["word"])


def markov_words(words: DataFrame, order: int, n: int, reps: int, seed: str, word: str = "word", longest: int = 40) -> DataFrame:
    """(rep, i, word): words of an order-k letter chain of the corpus, drawn independently of each other; the chain is one row."""
    chain = letter_chains(words, [], order, word)
    rows = words.sparkSession.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).join(F.broadcast(chain))
    drawn = chain_word(F.col("chain"), order, lambda j: uniform(seed, F.col("rep").cast("string"), F.col("i").cast("string"), j.cast("string")), longest)
    return rows.select("rep", "i", drawn.alias("word"))


def self_citation(seeds: list[str], n: int, reps: int, spark, seed: str, window: int = 40, verbatim: float = 0.12, mutate: float = 0.55, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """(rep, i, word): each word copies one of the last `window` words, as it is, with one letter changed, or with another word's ending; one task for each replicate."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rep = int(group["rep"].iloc[0])
        out = list(seeds)
        for i in range(n):
            u = [_hash_unit(seed, rep, i, k) for k in range(4)]
            recent = out[-window:]
            source = recent[int(u[0] * len(recent))]
            if u[1] < verbatim:
                new = source
            elif u[1] < verbatim + mutate and source:
                at = int(u[2] * len(source))
                new = source[:at] + alphabet[int(u[3] * len(alphabet))] + source[at + 1 :]
            else:
                other = recent[int(u[2] * len(recent))]
                new = source[: (len(source) + 1) // 2] + other[len(other) // 2 :]
            out.append(new)
        return pd.DataFrame({"rep": rep, "i": range(n), "word": out[len(seeds) :]})

    return spark.range(reps).select(F.col("id").cast("int").alias("rep")).groupBy("rep").applyInPandas(run, "rep int, i long, word string")


def deck_cipher(texts: DataFrame, table: dict[str, list[str]], seed: str) -> DataFrame:
    """(stream, symbols): each letter is dealt from its own shuffled deck of codes, refilled when empty; texts: (stream, text)."""

    def run(parts):
        for p in parts:
            out = []
            for stream, text in zip(p["stream"], p["text"], strict=True):
                decks: dict[str, list[str]] = {}
                fills: dict[str, int] = {}
                codes = []
                for c in text or "":
                    if c not in table:
                        continue
                    if not decks.get(c):
                        fills[c] = fills.get(c, 0) + 1
                        decks[c] = sorted(table[c], key=lambda x, c=c: (_hash_unit(seed, stream, c, fills[c], x), x))
                    codes.append(decks[c].pop())
                out.append(codes)
            yield pd.DataFrame({"stream": p["stream"], "symbols": out})

    return texts.select(F.col("stream").cast("string"), "text").mapInPandas(run, "stream string, symbols array<string>")


def copied_words(fresh: DataFrame, seed: str, odds: float = 0.18, window: int = 30, mutate: float = 0.4, alphabet: str = "abcdefghijklmnopqrstuvwxyz", most_rounds: int = 200) -> DataFrame:
    """(rep, i, word, source): a stream that copies itself. With `odds`, word i is that of one of the `window` places before, a letter changed with odds `mutate`; else it is fresh.

    fresh: (rep, i, word), numbered from 0. Who copies whom is a hash of the place alone, so the copies form trees whose
    roots are fresh words; each round gives the words of one more generation, and no replicate runs through one task.
    RuntimeError if a chain is longer than `most_rounds`.
    """
    at = [F.col("rep").cast("string"), F.col("i").cast("string")]
    back = 1 + F.floor(uniform(seed, "back", *at) * F.least(F.lit(window), F.col("i")))
    rows = fresh.select("rep", "i", "word", F.when((F.col("i") > 0) & (uniform(seed, "copy", *at) < odds), F.col("i") - back).cast("long").alias("source"))
    done = rows.where("source is null")
    left = rows.where("source is not null").drop("word")
    made, generation = [done], done
    for _ in range(most_rounds):
        parent = generation.select("rep", F.col("i").alias("source"), F.col("word").alias("w_"))
        place = F.floor(uniform(seed, "place", *at) * F.length("w_")).cast("int")
        letter = F.substring(F.lit(alphabet), F.floor(uniform(seed, "letter", *at) * len(alphabet)).cast("int") + 1, F.lit(1))
        changed = F.concat(F.substring("w_", F.lit(1), place), letter, F.substring(F.col("w_"), place + 2, F.length("w_")))
        word = F.when((uniform(seed, "mutate", *at) < mutate) & (F.length("w_") > 1), changed).otherwise(F.col("w_"))
        generation = left.join(parent, ["rep", "source"]).withColumn("word", word).select("rep", "i", "word", "source").checkpoint()
        if generation.isEmpty():
            break
        made.append(generation)
    else:
        raise RuntimeError(f"a chain of copies is longer than {most_rounds}")
    out = made[0]
    for g in made[1:]:
        out = out.unionByName(g)
    return out
