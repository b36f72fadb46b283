"""Queries that cut whole documents in one task: equal to their SQL on awkward tables, and no words are shuffled."""

from __future__ import annotations

import pytest

from lexiloom.catalog import ORACLE, QUERIES

NAMES = ["lag_similarity", "previous_row_components", "lag_similarity_slope"]
ODD = [
    (1, "en", "s1", "the cat sat\nthe cat\n\nthe the dog\nÀ ÉTÉ ß÷ß Ÿ x"), (2, "fr", "s1", "cat"), (3, None, "s2", None), (4, "en", None, ""), (5, "fr", "s2", "\n\n a b\r\na b c\n--\nb A c b"),
    (6, "en", "s1", "ends in été"), (7, "de", "s2", "étés follow\nétés again follow\n日本 a1b\n a b"), (8, "en", "s1", "\n".join("a b c d"[: 2 * (i % 4) + 1] for i in range(30))),
]


def differences(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLE[name])
    names, cols = [d[0] for d in cur.description], sorted(got.columns)
    assert sorted(names) == cols
    value = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    have = sorted((tuple(value(r[c]) for c in cols) for r in got.collect()), key=str)
    return [x for x in zip(want, have, strict=True) if x[0] != x[1]]


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(params=["once", "twice"])
def odd(spark, tmp_path, request):
    """Documents with and without numbers that two of them share."""
    rows = ODD + ([(5, "fr", "s2", "a b\nq a b\nc"), (None, "en", "s1", "a a\na a"), (None, "en", "s1", "b c\nd")] if request.param == "twice" else [])
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


def one_each(spark, folder):
    spark.createDataFrame(ODD, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(str(folder / "documents.parquet"))
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_equal_on_awkward_documents(spark, odd, name):
    assert differences(spark, odd, name) == []


@pytest.mark.parametrize("name", ["page_reading_orders", "markov_lines"])
def test_equal_where_numbers_are_used_once(spark, tmp_path, name):
    assert differences(spark, one_each(spark, tmp_path), name) == []


def test_reading_orders_are_those_of_the_columns(spark):
    from lexiloom.operators.bags import reading_orders
    from lexiloom.plans.channels import reading_texts

    pages = [[["ab", "c"], ["def"], ["g", "hé", "i"]], [["a"]], [["abc", "d", "e"], ["f", "g"], ["h"], ["ij", "k", "l", "m"]]]
    want = reading_texts(spark.createDataFrame([(p,) for p in pages], "lines array<array<string>>")).collect()
    for row in want:
        got = reading_orders([[w.encode("latin-1") for w in ws] for ws in row["lines"]])
        assert {k: x.decode("latin-1") for k, x in got.items()} == row["texts"]


def test_followers_are_counted_at_their_place(spark):
    """The lines of `markov_lines` count what follows their own last words, not every word's followers."""
    from lexiloom.operators.bags import followers

    docs = spark.createDataFrame([("A b a b\na b c a b",), ("b a",), (None,)], "text string")
    got = lambda *k: sorted(tuple(r) for r in followers(docs, *k).collect())
    assert got(0, 3, ["^"]) == [("^", "a", 2), ("^", "b", 1)]
    assert got(1, 3, ["a", "x"]) == [("a", "b", 2)]
    assert got(3, 3, ["a", "c"]) == [("a", "b", 2), ("c", "a", 1)]


@pytest.mark.parametrize("held", [1, 1 << 17])
def test_dealt_repeats_are_those_of_permuted_rows(spark, monkeypatch, held):
    """Against `permute_within`, user by user or many at a time; with null users, parts and values."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lexiloom.operators import nulls

    monkeypatch.setattr(nulls, "HELD_ROWS", held)
    rows = [(i * 7, None if i % 11 == 0 else i % 5, None if i % 13 == 0 else i % 2, None if i % 17 == 0 else "abc"[i * i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, u long, p long, v string")
    s = nulls.permute_within(df, "k", "v", ["u", "p"], 3, "x", "w").select("rep", "u", "k", F.col("w").alias("v")).unionByName(df.select(F.lit(-1).alias("rep"), "u", "k", "v"))
    s = s.withColumn("same", F.col("v") == F.lag("v").over(Window.partitionBy("rep", "u").orderBy("k")))
    want = {(r.rep, r.v): r.n for r in s.where("v is not null").groupBy("rep", "v").agg(F.count(F.when(F.col("same"), 1)).alias("n")).collect()}
    got = nulls.dealt_repeats(df, "k", "v", "u", "p", 3, "x")
    assert {(r.rep, r.v): r.n for r in got.collect()} == want
    assert "Window" not in plan(got) and "Join" not in plan(got)


@pytest.mark.parametrize("block", [1, 256])
def test_caches_by_unit_equal_their_sql(spark, tmp_path, monkeypatch, block):
    """Over several blocks of document numbers; no join of words, no window over letters."""
    from lexiloom.operators import bags, state

    monkeypatch.setattr(state, "BLOCK_LEAVES", block)
    monkeypatch.setattr(bags, "SLICE_BYTES", 100)
    rows = [(9, None, None, "a b\n \u00a0 \nc a\n\t\na a"), (None, "en", "s1", "no number"), (14, "en", "s1", "a:b"), (15, "de", None, "été\n\nété"), (-1, "en", "s1", "the cat"), (-2, "fr", "s2", "cat"), (-3, "fr", "s2", "a cat")]
    spark.createDataFrame(ODD + rows, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, "reset_unit_bits") == []
    shown = plan(QUERIES["reset_unit_bits"](spark, str(tmp_path)))
    assert "Generate posexplode" not in shown and "SortMergeJoin" not in shown and "ShuffledHashJoin" not in shown


def test_md5_of_many_texts():
    import hashlib

    import pyarrow as pa

    from lexiloom.operators import packed

    for texts in ([], ["", "a", "ab|1|é", "x" * 55, *map(str, range(9000))], ["a", "x" * 56]):
        hi, lo = packed.md5(pa.array(texts, pa.string()).slice(0))
        assert [f"{a:016x}{b:016x}" for a, b in zip(hi.tolist(), lo.tolist(), strict=True)] == [hashlib.md5(x.encode()).hexdigest() for x in texts]


@pytest.fixture(params=["once", "twice"])
def copied(spark, tmp_path, request, monkeypatch):
    """Documents in many small blocks; "twice": a whole document comes again under its number."""
    from lexiloom.operators import packed

    monkeypatch.setattr(packed, "PACKED_BYTES", 60)
    monkeypatch.setattr(packed, "BUCKET_BYTES", 100)
    monkeypatch.setattr(packed, "SHUFFLED_BYTES", 60)
    rows = ODD + (ODD[4:5] if request.param == "twice" else [])
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


@pytest.mark.parametrize("name", ["line_shuffle_gap", "shuffled_repeat_rate"])
def test_shuffles_in_blocks_equal_their_sql(spark, copied, name):
    assert differences(spark, copied, name) == []
    shown = plan(QUERIES[name](spark, str(copied)))
    assert "Generate" not in shown and ("Window" in shown) == (name == "shuffled_repeat_rate")  # over a row for each bucket


@pytest.mark.parametrize("held", [3, 1 << 22])
def test_residuals_dealt_in_buckets_equal_their_sql(spark, tmp_path, monkeypatch, held):
    """Strata whole and in parts, over many slices; a document without a number is never dealt."""
    from lexiloom.operators import dealt

    for name, most in (("WORDS_HELD", held), ("WORDS_TOGETHER", held), ("READ_BYTES", 60), ("HASHED", 5)):
        monkeypatch.setattr(dealt, name, most)
    rows = ODD + [(None, "en", "s1", "a b c\nthe cat")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, "stratified_residual_shuffle") == []
    shown = plan(QUERIES["stratified_residual_shuffle"](spark, str(tmp_path)))
    assert "Generate" not in shown and "Window" not in shown


def test_md5_of_hexadecimal_digits():
    import hashlib

    import pyarrow as pa

    from lexiloom.operators import packed

    key = packed.md5(pa.array(map(str, range(40000)), pa.string()))
    for lead in ("", "res|1|", "x" * 23, "x" * 24):
        got = packed.md5_of_hex(lead, *key)
        for i in (0, 1, 32767, 32768, 39999):
            assert f"{got[0][i]:016x}{got[1][i]:016x}" == hashlib.md5(f"{lead}{key[0][i]:016x}{key[1][i]:016x}".encode()).hexdigest()


@pytest.mark.parametrize("name", [*NAMES, "page_reading_orders"])
def test_words_stay_where_they_are_read(spark, data, name):
    assert not [x for x in ("Join", "Generate") if x in plan(QUERIES[name](spark, data))]
