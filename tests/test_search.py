"""Edit scripts, merges, assignment, generators, folds and hierarchical caches against brute force or hand-made cases."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_edit_script(spark):
    from lexiloom.operators import edits

    assert edits.edit_script("daiin", "dain") == (1, [("M", 0, 0, "d", "d"), ("M", 1, 1, "a", "a"), ("D", 2, 2, "i", ""), ("M", 3, 2, "i", "i"), ("M", 4, 3, "n", "n")])
    assert edits.edit_script("", "ab")[0] == 2 and edits.edit_script("", "") == (0, [])
    pairs = spark.createDataFrame([("daiin", "dain"), ("a", "a"), ("a", "bc"), ("daiin", "dain"), (None, "x")], "source string, target string")
    got = edits.align(pairs).select("source", "distance", *[edits.render(F.col("ops"), F.col("source"), F.col("target"), h).alias(h) for h in ("operation", "full_delta")]).collect()
    assert sorted(map(tuple, got)) == [("a", 0, "=", "="), ("a", 2, "IS", "I:0:->b.S:4:a>c"), ("daiin", 1, "D", "D:2:i>-"), ("daiin", 1, "D", "D:2:i>-")]


def test_bpe_merges(spark):
    from lexiloom.operators.search import bpe_merges

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    units, want = {w: list(w) for w in words}, []
    count = Counter(words)
    for _ in range(4):
        pairs = Counter()
        for w, u in units.items():
            for p in itertools.pairwise(u):
                pairs[p] += count[w]
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        want.append((a, b))
        for w, u in units.items():
            out = []
            for x in u:
                if out and out[-1] == a and x == b:
                    out[-1] = a + b
                else:
                    out.append(x)
            units[w] = out
    done, table = bpe_merges(spark.createDataFrame([(w,) for w in words], "word string"), 4)
    assert done == want and {r["word"]: r["units"] for r in table.collect()} == units


def test_hungarian_and_folds():
    from lexiloom.operators.search import greedy_folds, hungarian

    rng = np.random.default_rng(1)
    for n in (1, 3, 6):
        cost = rng.random((n, n))
        got = hungarian(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sorted(got) == list(range(n)) and math.isclose(cost[np.arange(n), got].sum(), best)
    assert greedy_folds([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_generators_are_reproducible(spark):
    from lexiloom.operators import generate as G

    words = spark.createDataFrame([("abab",), ("abc",), ("cab",)], "word string")
    one = [tuple(r) for r in G.markov_words(words, 2, 30, 2, "s").collect()]
    assert sorted(one) == sorted(tuple(r) for r in G.markov_words(words.repartition(3), 2, 30, 2, "s").collect()) and len(one) == 60
    assert all(w[2][:1] in "ac" for w in one)
    cited = G.self_citation(["ab", "cd"], 50, 2, spark, "s").toPandas()
    assert len(cited) == 100 and cited.groupby("rep").size().tolist() == [50, 50]
    deck = G.deck_cipher(spark.createDataFrame([("x", "aaaa")], "stream string, text string"), {"a": ["1", "2"]}, "s").first()["symbols"]
    assert sorted(deck[:2]) == sorted(deck[2:]) == ["1", "2"]


def test_causal_caches(spark):
    """One page, the word aa twice, uniform base 1/2, mass 32: the first word sees the base alone, the second the counts of the first."""
    from lexiloom.operators import state

    words = spark.createDataFrame([(0, 0, "a"), (0, 1, "a")], "doc int, seq int, word string").withColumn("line", F.lit(0))
    letters = state.letter_rows(words, "doc", "line", "seq").withColumn("base", F.lit(0.5))
    flat = {(r["seq"], r["symbol"]): r["p"] for r in state.adaptive_cache(letters, ["doc"], "seq", "base").collect()}
    assert flat[0, "a"] == pytest.approx(0.5) and flat[1, "a"] == pytest.approx((1 + 16) / 34)
    deep = {(r["seq"], r["symbol"]): r["p"] for r in state.hierarchical_cache(letters, ["doc"], ["line"], "seq", "base").collect()}
    assert deep[0, "$"] == pytest.approx(0.5) and deep[1, "$"] == pytest.approx((1 + 32 * 17 / 34) / 34)


def test_tree_order(spark):
    from lexiloom.operators.search import breadth_first

    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c")], "parent string, child string")
    assert sorted(map(tuple, breadth_first(edges, "r").collect())) == [("a", 1), ("b", 1), ("c", 2), ("r", 0)]


def test_breadth_first_fails_on_trees_deeper_than_its_bound(spark):
    import pytest

    from lexiloom.operators.search import breadth_first

    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(4)], "parent string, child string")
    assert breadth_first(edges, "0", 5).count() == 5
    with pytest.raises(RuntimeError):
        breadth_first(edges, "0", 3)
