"""Micro-fixtures, invariances and streaming parity of the corpus operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_cleaning_order(spark):
    from lexiloom.sources.markup import clean_words, page_headers, transcription

    assert one(spark, clean_words(F.lit("fa<!x>chys.[a:o]r,y*{c}l!"))) == ["fachys", "ar", "y?l"]
    lines = spark.createDataFrame([(0, "<f1r>  <! $I=T $Q=A $L=B>"), (1, "<f1r.1,@P0;H>  ab.cd"), (2, "<f1r.1,@P0;C>  xx"), (3, "<f1r.2,+P0;H> !%"), (4, "# note")], "line_no int, line string")
    assert [(r.folio, r.line, r.locus, r.words) for r in transcription(lines).collect()] == [("f1r", 1, "@P0", ["ab", "cd"])]
    assert page_headers(lines).first()["meta"] == {"I": "T", "Q": "A", "L": "B"}


def test_words(spark):
    from lexiloom.functions import words as W

    split = {w: tuple(one(spark, W.FULL.split(F.lit(w)))) for w in ("qokeedy", "daiin", "ol", "chol", "qo", "chedy")}
    assert split == {"qokeedy": ("qok", "e", "edy"), "daiin": ("d", "a", "iin"), "ol": ("o", "l", ""), "chol": ("ch", "ol", ""), "qo": ("qo", "", ""), "chedy": ("ch", "e", "dy")}
    assert [one(spark, W.locus_type(F.lit(x))) for x in ("@P0", "+Lx", "=Cc", "12")] == ["P", "L", "C", "?"]
    assert one(spark, W.position5(F.lit(1), F.lit(2))) == "last" and one(spark, W.position5(F.lit(1), F.lit(2), "second_first")) == "second"
    assert one(spark, W.roman_to_int(F.lit("xliv"))) == 44 and one(spark, W.period_meets(F.lit("XIII-XIV"))) and not one(spark, W.period_meets(F.lit("XVI")))
    assert one(spark, W.glyph_units(F.lit("cthoshy"))) == ["cth", "o", "sh", "y"]
    assert [one(spark, W.choose_letters(F.lit("abcde"), m)) for m in ("odd", "even", "middle", "last")] == ["ace", "bd", "c", "e"]
    assert tuple(one(spark, W.folio_key(F.lit("f85v2")))) == (85, 1, 2) and tuple(one(spark, W.folio_key(F.lit("x")))) == (10**9, 0, 0)
    assert one(spark, W.polynomial(F.lit("ab"))) == (3 * 1 + 2) % 23
    assert one(spark, W.mirror_alphabet(F.lit("abz"))) == "zya"
    assert one(spark, W.prefix_layers(F.lit("qochy"))) == 3
    assert abs(one(spark, W.logsum2(F.array(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double")))) - 1) < 1e-12


def test_information(spark):
    from lexiloom.operators import info

    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "x int, y int")
    free = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "x int, y int")
    assert info.entropy(df, ["x"]).first()["h"] == pytest.approx(1)
    assert info.mutual_information(df, "x", "y").first()["mi"] == pytest.approx(1) and info.mutual_information(free, "x", "y").first()["mi"] == pytest.approx(0)
    assert info.conditional_entropy(df, ["x"], ["y"]).first()["h"] == pytest.approx(0) and info.conditional_entropy(free, ["x"], ["y"]).first()["h"] == pytest.approx(1)
    assert info.kl(df.select("x"), df.select("x"), "x").first()["kl"] == pytest.approx(0)
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(5)) for _ in range(500)]
    r = spark.createDataFrame(rows, "x int, y int")
    assert info.mutual_information(r, "x", "y").first()["mi"] == pytest.approx(info.mutual_information(r, "y", "x").first()["mi"])
    renamed = r.select((9 - F.col("x")).alias("x"), "y")
    assert info.mutual_information(r, "x", "y").first()["mi"] == pytest.approx(info.mutual_information(renamed, "x", "y").first()["mi"])


def test_sequences(spark):
    from lexiloom.operators import sequence as S
    from lexiloom.operators.tokens import eligible, run_lengths, runs, tokens, transitions

    even = spark.createDataFrame([("a", i) for i in range(12)], "word string, seq int").withColumn("d", F.lit(1))
    assert S.burstiness(even, ["d"], ["seq"]).first()["burst"] == pytest.approx(-1)
    x = spark.createDataFrame([(0, "x"), (1, None), (2, "y"), (3, "z")], "pos int, word string").withColumn("d", F.lit(1))
    assert [(r.left, r.right) for r in transitions(x, ["d"], "pos").collect()] == [("y", "z")]
    assert [(r.word, r.run) for r in runs(x, ["d"], "pos").orderBy("pos").collect()] == [("x", 0), ("y", 1), ("z", 1)]
    r = spark.createDataFrame(list(enumerate("qrqs")), "pos int, word string").withColumn("d", F.lit(1))
    assert [v.code for v in S.recurrence(r, ["d"], "pos", "word").orderBy("pos").collect()] == [0, 1, 0, 2]
    ranks = spark.createDataFrame([(10,), (20,), (20,), (30,)], "v int").withColumn("d", F.lit(1))
    assert sorted(v["rank"] for v in S.average_ranks(ranks, ["d"], "v").collect()) == [0, 1.5, 1.5, 3]
    docs = spark.createDataFrame([(1, "Ab c\n\nd ab"), (2, None), (3, "")], "doc_id long, text string")
    assert [(t.line_no, t.pos, t.seq, t.word) for t in tokens(docs).orderBy("seq").collect()] == [(0, 0, 0, "ab"), (0, 1, 1, "c"), (2, 0, 2, "d"), (2, 1, 3, "ab")]
    words = spark.createDataFrame([(0, "ab"), (1, "?x"), (2, "cd"), (3, "e")], "pos int, word string").withColumn("d", F.lit(1))
    assert eligible(words, "E0", ["d"]).count() == 3 and eligible(words, "E1", ["d"]).count() == 2
    assert [v.word for v in eligible(words, "E3", ["d"]).orderBy("pos").collect()] == ["ab", None, "cd", None]
    islands = run_lengths(spark.createDataFrame(list(enumerate("aabba")), "pos int, v string").withColumn("d", F.lit(1)), ["d"], "pos", "v")
    assert sorted((v.first, v.length) for v in islands.select("first", "length").toPandas().itertuples()) == [(0, 2), (2, 2), (4, 1)]


def test_nulls(spark):
    from lexiloom.operators import nulls

    rows = spark.createDataFrame([Row(k=i, v=i * 7 % 5, s=i % 3) for i in range(60)])
    a = nulls.permute_within(rows.repartition(1), "k", "v", ["s"], 4, "seed").collect()
    b = nulls.permute_within(rows.repartition(8), "k", "v", ["s"], 4, "seed").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    for rep in range(4):
        for s in range(3):
            own = [r for r in a if r["rep"] == rep and r["s"] == s]
            assert sorted(r["permuted"] for r in own) == sorted(r["v"] for r in own)
    assert one(spark, nulls.exact_sign_flip_p(F.array(*[F.lit(1.0)] * 3))) == pytest.approx(1 / 8)
    p = spark.range(1, 10).agg(nulls.upper_p(F.lit(5.0), F.col("id").cast("double")).alias("p")).first()["p"]
    assert p == pytest.approx(0.6)


def test_programs_invert(spark):
    from lexiloom.operators.programs import affine, running, unaffine, unrun

    values = [5, 0, 22, 7, 7, 1]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x int").withColumn("d", F.lit(1))
    got = df.select("i", affine("x", ["d"], "i", 2, 3, 1, 23).alias("a"), running("x", ["d"], "i", -1, 23).alias("r")).orderBy("i").collect()
    assert one(spark, unaffine(F.array(*[F.lit(v.a) for v in got]), 2, 3, 1, 23)) == values
    assert one(spark, unrun(F.array(*[F.lit(v.r) for v in got]), -1, 23)) == values


def test_bits_and_pairs(spark):
    from lexiloom.operators.bits import decode_chunks, encode_bits
    from lexiloom.operators.pairs import best_alignment, lcs_length

    bits = spark.createDataFrame([(1, i, b) for i, b in enumerate([0] * 9 + [1])], "d int, pos int, bit int")
    assert decode_chunks(bits, ["d"], "pos", "bit", 5).first()["decoded"] == "ab"
    assert one(spark, encode_bits(F.lit("ab"))) == [0] * 9 + [1]
    arr = lambda s: F.array(*map(F.lit, s))
    assert one(spark, lcs_length(arr("abcbdab"), arr("bdcaba"))) == 4
    assert one(spark, best_alignment(arr("abcd"), arr("cdab"), lambda x, y: x == y)) == 1.0
    assert one(spark, best_alignment(arr("abcd"), arr("dcba"), lambda x, y: x == y)) == 1.0


def test_smoothed_models_sum_to_one(spark):
    from lexiloom.operators.models import trigram_model

    words = spark.createDataFrame([("abab",), ("ba",), ("aab",)], "word string")
    m = trigram_model(words).withColumn("c", F.substring("gram", 1, 2)).groupBy("c").agg(F.sum(F.pow(F.lit(2.0), "logp")).alias("p"), F.count("*").alias("n")).collect()
    v = 3
    for r in m:
        assert r.p <= 1 + 1e-9 and (r.n < v or math.isclose(r.p, 1))


def test_mixture_weights(spark):
    from lexiloom.operators.models import mixture_weights

    rows = spark.createDataFrame([(0.9, 0.1, 70), (0.1, 0.9, 30)], "a double, b double, w int")
    pi = mixture_weights(rows, ["a", "b"], "w", 200)
    assert sum(pi) == pytest.approx(1) and pi[0] == pytest.approx(0.75, abs=1e-3)


def test_streaming_equals_batch(spark, data, tmp_path):
    from pyspark.sql import Window

    from lexiloom.operators import sequence, state
    from lexiloom.streaming import caches

    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_id", "event_type").where("user_id % 5 = 0")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    clock = events.withColumn("i", F.row_number().over(w))
    batch = clock.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("at"), sequence.copy_state(F.col("i") - F.lag("i").over(Window.partitionBy("user_id", "event_type").orderBy("i"))).alias("state"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = caches.last_seen(stream, "user_id", "event_id", "event_type").writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("seen").select("key", "at", "state").collect())) == sorted(map(tuple, batch.collect()))
    words = clock.select("user_id", F.col("i").alias("seq"), F.col("event_type").alias("word"))
    k = 30
    scored = state.adaptive_cache(state.letter_rows(words, "user_id", "seq").withColumn("base", F.lit(1 / k)), ["user_id"], "seq", "base", 32.0, 4)
    want = {(str(r.user_id), r.seq): r.b for r in scored.groupBy("user_id", "seq").agg(F.sum(-F.log2("p")).alias("b")).collect()}
    words.coalesce(1).write.parquet(str(tmp_path / "words"))
    q = caches.adaptive_cache(spark.readStream.schema(words.schema).parquet(str(tmp_path / "words")), "user_id", "seq", "word", k, 32.0, 4).writeStream.format("memory").queryName("cache").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.at): r.bits for r in spark.table("cache").collect()}
    assert got.keys() == want.keys() and all(abs(got[k_] - want[k_]) < 1e-9 for k_ in want)


def test_sources(spark, tmp_path):
    from lexiloom.sources import markup as M

    (tmp_path / "c.json").write_text('{"meta": {"f1r": {"L": "A"}}, "folios": {"f1r": [{"line": 1, "locus": "@P0", "words": ["ab"]}], "f2r": [{"line": 1, "locus": "@P0", "words": ["cd", "e"]}]}}')
    assert [r.words for r in M.json_corpus(spark, str(tmp_path / "c.json"), "A").collect()] == [["ab"]]
    assert [r.folio for r in M.json_corpus(spark, str(tmp_path / "c.json"), "?").collect()] == ["f2r"]
    (tmp_path / "bad.txt").write_text("404: Not Found")
    assert M.text_lines(spark, str(tmp_path / "bad.txt")).count() == 0
    assert one(spark, M.plain_words(F.lit("It's: a DOG."))) == ["it", "s", "a", "dog"]
    assert one(spark, M.book_body(F.lit("x *** START OF THIS BOOK *** body *** END OF THIS"))).strip() == "body"
    assert one(spark, M.latin_letters(F.lit("Jvlivs Këw"))) == "iuliusceu"
    e = one(spark, M.expansions(F.lit("a <expan>p<ex>er</ex></expan> b")))
    assert [tuple(x) for x in e] == [("p", "er", "per")]
    (tmp_path / "p.json").write_text("[[0, 0.01, 0, 0, 0, 1], [1, 0.3, 0.06, 0.01, 0, 1]]")
    from lexiloom.functions.words import page_label

    got = M.page_features(spark, str(tmp_path / "p.json")).select(page_label(*[F.col(c) for c in ("ink", "green", "redbrown", "blue", "edge")]).alias("l")).collect()
    assert [r.l for r in got] == ["empty", "plant with roots"]
    assert one(spark, M.html_text(F.lit("<p>a&amp;b<script>x</script> <b>c</b></p>"))) == "a&b c"


def test_queries_equal_their_sql(spark, data):
    """A sample of the registry; all of it is compared by the driver at a larger scale."""
    import duckdb

    from lexiloom.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    value = lambda v: round(v, 5) if isinstance(v, float) else v
    names = (
        "token_count_by_lang", "char_entropy_by_lang", "mi_returnflag_linestatus", "burstiness", "event_run_lengths", "within_stratum_permutation_p", "knn_in_stratum", "tfidf_top_terms", "shuffled_repeat_rate",
        "parallel_lines", "skewed_words_topk", "trigram_bits_by_source", "zipf_slope_by_lang", "line_edge_kl", "tiling_boundaries", "event_shuffle_within", "free_recombination", "injected_copy", "tetragram_bits",
        "loo_trigram_classifier", "program_streams", "all_stride_channels", "folio_orders", "word_bit_streams", "letter_chain_words", "table_parse", "read_transcription", "read_json_corpus", "folio_columns",
        "recurrence_vectors", "raster_shares", "markov_lines", "hierarchical_letter_bits", "topic_words",
    )
    for name in names:
        got = QUERIES[name](spark, data)
        cols = sorted(got.columns)
        cur = con.execute(ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols, name
        want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
        assert sorted((tuple(value(r[c]) for c in cols) for r in got.collect()), key=str) == want, name


def test_entry_without_the_training_data_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'token_table' in e.queries() and 'pipeline' not in e.queries() and 'token_table' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
