"""Queries: windows, sequences, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import bags, info, sequence
from lexiloom.operators.info import r6
from lexiloom.operators.tokens import eligible, history, lines, run_lengths, sessions, tokens, transitions
from lexiloom.plans.base import TOK, WORD, query, slots_sql
from lexiloom.plans.lexical import bare, corpus, flow, lined, mi_sql, slots


def by_line():
    return Window.partitionBy("doc_id", "line_no").orderBy("pos")


def by_doc():
    return Window.partitionBy("doc_id").orderBy("seq")


@query("adjacent_repeat_rate", TOK + ", a AS (SELECT lang, word, lead(word) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM tokens) SELECT lang, count(nxt) AS pairs, round(sum(CASE WHEN word = nxt THEN 1 ELSE 0 END) / count(nxt)::DOUBLE, 6) + 0.0 AS rate FROM a GROUP BY lang")
def _(t):
    a = flow(t, "lang").withColumn("nxt", F.lead("word").over(by_doc()))
    return a.groupBy("lang").agg(F.count("nxt").alias("pairs"), r6(F.sum((F.col("word") == F.col("nxt")).cast("long")) / F.count("nxt")).alias("rate"))


@query("burstiness", TOK + """, g AS (SELECT doc_id, word, seq - lag(seq) OVER (PARTITION BY doc_id, word ORDER BY seq) AS gap FROM tokens),
b AS (SELECT doc_id, word, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM g GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT doc_id, word, n, round((s - m) / (s + m), 6) + 0.0 AS burst FROM b""")
def _(t):
    return sequence.burstiness(flow(t), ["doc_id"], ["seq"]).select("doc_id", "word", "n", r6("burst").alias("burst"))


@query("wordlen_autocorr", TOK + ", v AS (SELECT length(word)::DOUBLE AS x, " + ", ".join(f"lag(length(word), {k}) OVER w::DOUBLE AS l{k}" for k in range(1, 13)) + " FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(x, l{k}), 6) + 0.0 AS r FROM v" for k in range(1, 13)))
def _(t):
    return sequence.autocorrelation(flow(t), ["doc_id"], "seq", F.length("word"), 12).select("lag", r6("r").alias("r"))


@query("ngram_repetition", TOK + """, g AS (SELECT 2 AS n, list_slice(ws, i, i + 1) AS g FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM lines) UNION ALL SELECT 3, list_slice(ws, i, i + 2) FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM lines)),
c AS (SELECT n, g, count(*) AS c FROM g GROUP BY 1, 2) SELECT n, sum(c)::BIGINT AS total, round(sum(CASE WHEN c >= 2 THEN c ELSE 0 END) / sum(c)::DOUBLE, 6) + 0.0 AS repeated FROM c GROUP BY n""")
def _(t):
    ws = lines(t.documents).select(F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("ws"))
    grams = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("ws", i, n), " ").alias("g")))).otherwise(F.array().cast("array<struct<n:int,g:string>>"))
    c = ws.select(F.explode(F.concat(grams(2), grams(3))).alias("x")).groupBy("x.n", "x.g").agg(F.count("*").alias("c"))
    return c.groupBy("n").agg(F.sum("c").alias("total"), r6(F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeated"))


@query("novelty_curve", TOK + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY seq) = 1 AS new FROM tokens)
SELECT doc_id, line_no, count(*) AS n, round(avg(CASE WHEN new THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS novelty FROM f GROUP BY 1, 2""")
def _(t):
    f = corpus(t).withColumn("new", F.row_number().over(Window.partitionBy("doc_id", "word").orderBy("seq")) == 1)
    return f.groupBy("doc_id", F.col("line_no").cast("long").alias("line_no")).agg(F.count("*").alias("n"), r6(F.avg(F.col("new").cast("double"))).alias("novelty"))


@query("paragraph_segments", TOK + """, p AS (SELECT *, sum(CASE WHEN len(ws) < 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM lines)
SELECT doc_id, seg::BIGINT AS segment, count(*) AS lines, sum(len(ws))::BIGINT AS words FROM p GROUP BY 1, 2""")
def _(t):
    ls = lines(t.documents).withColumn("n", F.size(F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1))))
    return sessions(ls, ["doc_id"], "line_no", F.col("n") < 4, "segment").groupBy("doc_id", "segment").agg(F.count("*").alias("lines"), F.sum("n").alias("words"))


@query("change_points", TOK + """, p AS (SELECT lang, doc_id, avg(length(word)) AS x FROM tokens GROUP BY 1, 2), d AS (SELECT lang, doc_id, abs(x - lag(x) OVER (PARTITION BY lang ORDER BY doc_id)) AS d FROM p),
s AS (SELECT lang, avg(d) + 1.2::DOUBLE * stddev_pop(d) AS thr FROM d GROUP BY 1) SELECT lang, doc_id, round(d, 6) + 0.0 AS delta FROM d JOIN s USING (lang) WHERE d > thr""")
def _(t):
    p = bare(t, "lang").groupBy("lang", "doc_id").agg(F.avg(F.length("word")).alias("x"))
    r = sequence.ranks(p, ["lang"], F.floor(F.col("doc_id") / 4096), ["doc_id"], "i")
    d = r.join(r.select("lang", (F.col("i") + 1).alias("i"), F.col("x").alias("before")), ["lang", "i"]).withColumn("d", F.abs(F.col("x") - F.col("before")))
    thr = d.groupBy("lang").agg((F.avg("d") + 1.2 * F.stddev_pop("d")).alias("thr"))  # a row for each language
    return d.join(thr, "lang").where("d > thr").select("lang", "doc_id", r6("d").alias("delta"))


@query("equal_token_chunks", TOK + """, a AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) - 1 AS i, count(*) OVER (PARTITION BY source) // 10 AS k FROM tokens)
SELECT source, (i // k)::INT AS chunk, count(*) AS n, count(DISTINCT word) AS types FROM a WHERE i // k < 10 GROUP BY 1, 2""")
def _(t):
    return sequence.equal_chunks(flow(t, "source").select("source", "doc_id", "seq", "word"), ["source"], ["doc_id", "seq"], 10, F.floor(F.col("doc_id") / 64)).groupBy("source", "chunk").agg(F.count("*").alias("n"), F.count_distinct("word").alias("types"))


@query("event_run_lengths", """WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a) SELECT user_id, island::BIGINT AS island, event_type, min(event_id) AS "first", max(event_id) AS "last", count(*) AS length FROM b GROUP BY 1, 2, 3""")
def _(t):
    return run_lengths(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("relative_slot_histogram", TOK + ", s AS (SELECT lang, least(4, floor(pos * 5.0::DOUBLE / n_line))::INT AS slot, length(word) AS n FROM tokens) SELECT lang, slot, count(*) AS tokens, round(avg(n), 6) + 0.0 AS mean_length FROM s GROUP BY 1, 2")
def _(t):
    return lined(t, "lang").groupBy("lang", W.relative_bin("pos", "n_line").alias("slot")).agg(F.count("*").alias("tokens"), r6(F.avg(F.length("word"))).alias("mean_length"))


@query("openers", TOK + ", o AS (SELECT word, count(*) AS pages FROM tokens WHERE seq = 0 GROUP BY 1) SELECT word, pages, pages = 1 AS \"unique\" FROM o")
def _(t):
    return flow(t).where("seq = 0").groupBy("word").agg(F.count("*").alias("pages")).withColumn("unique", F.col("pages") == 1)


@query("recurrence_encoding", TOK + """, f AS (SELECT doc_id, seq, word, min(seq) OVER (PARTITION BY doc_id, word) AS f, row_number() OVER (PARTITION BY doc_id, word ORDER BY seq) - 1 AS prior, seq - lag(seq) OVER (PARTITION BY doc_id, word ORDER BY seq) AS gap FROM tokens)
SELECT doc_id, seq, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS code, prior, gap FROM f""")
def _(t):
    return sequence.recurrence(flow(t), ["doc_id"], "seq", "word").select("doc_id", "seq", "code", "prior", "gap")


@query("copy_state_bins", TOK + """, a AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) AS i FROM tokens), g AS (SELECT source, i - lag(i) OVER (PARTITION BY source, word ORDER BY i) AS gap FROM a)
SELECT source, CASE WHEN gap = 1 THEN 'lag1' WHEN gap <= 5 THEN 'lag2-5' WHEN gap <= 40 THEN 'lag6-40' ELSE 'new' END AS state, count(*) AS n FROM g GROUP BY 1, 2""")
def _(t):
    a = sequence.ranks(flow(t, "source").select("doc_id", "source", "seq", "word"), ["source"], F.floor(F.col("doc_id") / 64), ["doc_id", "seq"], "i")
    gap = F.col("i") - F.lag("i").over(Window.partitionBy("source", "word").orderBy("i"))
    return a.withColumn("state", sequence.copy_state(gap)).groupBy("source", "state").agg(F.count("*").alias("n"))


@query("history_arrays", TOK + """, h AS (SELECT doc_id, line_no, pos, list(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS h FROM tokens)
SELECT doc_id, line_no, pos, coalesce(array_to_string(list_reverse(h), ' '), '') AS history FROM h WHERE pos > 0""")
def _(t):
    return history(lined(t), ["doc_id", "line_no"], "pos").where("pos > 0").select("doc_id", "line_no", "pos", F.array_join("history", " ").alias("history"))


@query("transition_census", TOK + """, e AS (SELECT doc_id, line_no, lang, pos, CASE WHEN length(word) >= 2 THEN word END AS word, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM tokens),
tr AS (SELECT lang, pos, n, lag(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS l, word AS r FROM e)
SELECT lang, count(*) AS transitions, count(*) FILTER (WHERE pos >= 3 AND pos < n - 2) AS deep FROM tr WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY lang""")
def _(t):
    e = eligible(lined(t, "lang"), "E3", ["doc_id", "line_no"]).drop("i", "n")
    tr = transitions(e, ["doc_id", "line_no"], "pos")
    return tr.groupBy("lang").agg(F.count("*").alias("transitions"), F.count(F.when((F.col("i") >= 3) & (F.col("i") < F.col("n") - 2), 1)).alias("deep"))


@query("eligible_counts", TOK + """, s AS (SELECT count(*) FILTER (WHERE length(word) >= 2) OVER (PARTITION BY doc_id, line_no) AS n, word FROM tokens)
SELECT 'E0' AS profile, count(*) AS n FROM tokens UNION ALL SELECT 'E1', count(*) FROM tokens WHERE length(word) >= 2 UNION ALL SELECT 'E2', count(*) FROM s WHERE length(word) >= 2 AND n >= 3 UNION ALL SELECT 'E3', count(*) FROM tokens WHERE length(word) >= 2 UNION ALL SELECT 'E5', count(*) FROM s WHERE length(word) >= 2 AND n >= 5""")
def _(t):
    by = ["doc_id", "line_no"]
    c = lined(t)
    parts = [eligible(c, p, by).where("word is not null").agg(F.count("*").alias("n")).select(F.lit(p).alias("profile"), "n") for p in ("E0", "E1", "E2", "E3", "E5")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("interior_reversed_lines", TOK + """, r AS (SELECT doc_id, line_no, word, CASE WHEN pos >= 2 AND pos < n_line - 2 THEN n_line - 1 - pos ELSE pos END AS p FROM tokens)
SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY p) AS line FROM r GROUP BY 1, 2""")
def _(t):
    r = sequence.reverse_interior(lined(t), ["doc_id", "line_no"])
    return r.groupBy("doc_id", F.col("line_no").cast("long").alias("line_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos_new", "word"))), lambda x: x["word"]), " ").alias("line"))


@query("phase_coordinates", TOK + """SELECT doc_id, line_no, pos, pos % 7 AS word_in_line, seq % 11 AS word_in_page, line_no % 5 AS line_in_page, CASE WHEN line_no % 2 = 1 THEN n_line - 1 - pos ELSE pos END AS boustrophedon FROM tokens""")
def _(t):
    b = sequence.reading_order(F.col("line_no"), F.col("pos"), F.col("n_line"), "boustrophedon")[1]
    return corpus(t).select("doc_id", "line_no", "pos", (F.col("pos") % 7).alias("word_in_line"), (F.col("seq") % 11).alias("word_in_page"), (F.col("line_no") % 5).alias("line_in_page"), b.alias("boustrophedon"))


_NUM = TOK + """, v AS (SELECT doc_id, line_no, pos, length(word) % 23 AS x FROM tokens)"""


@query("modular_programs", _NUM + """, p AS (SELECT *, coalesce(lag(x) OVER w, 0) AS prev, first_value(x) OVER w AS seed, sum(x) OVER w AS run FROM v WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos))
SELECT doc_id, line_no, pos, ((x + 2 * prev + 3 * seed + pos) % 23)::INT AS affine, (run % 23)::INT AS running_plus, (((23 - run % 23) % 23))::INT AS running_minus FROM p""")
def _(t):
    from lexiloom.operators.programs import affine, running

    v = lined(t).withColumn("x", W.numeric_feature("word", "length"))
    by, m = ["doc_id", "line_no"], 23
    return v.select("doc_id", "line_no", "pos", affine("x", by, "pos", 2, 3, 1, m).alias("affine"), running("x", by, "pos", 1, m).alias("running_plus"), running("x", by, "pos", -1, m).alias("running_minus"))


@query("page_halves", TOK + """, n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1)
SELECT doc_id, count(*) FILTER (WHERE seq < n // 2) AS first_half, count(*) FILTER (WHERE seq >= n // 2) AS second_half, count(*) FILTER (WHERE seq < 64) AS prefix64, count(*) FILTER (WHERE seq >= 64 AND seq < 128) AS suffix64 FROM tokens JOIN n USING (doc_id) GROUP BY doc_id""")
def _(t):
    c = flow(t).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    has = lambda x, n: F.count(F.when(x, 1)).alias(n)
    s, half = F.col("seq"), F.floor(F.col("n") / 2)
    return c.groupBy("doc_id").agg(has(s < half, "first_half"), has(s >= half, "second_half"), has(s < 64, "prefix64"), has((s >= 64) & (s < 128), "suffix64"))


@query("cyclic_pairs", TOK + """, c AS (SELECT doc_id, line_no, word AS l, coalesce(lead(word) OVER w, first_value(word) OVER w) AS r FROM tokens WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT l, r, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    c = lined(t).select(F.col("word").alias("l"), F.coalesce(F.lead("word").over(by_line()), F.first("word").over(by_line())).alias("r"))
    return c.groupBy("l", "r").agg(F.count("*").alias("n")).where("n > 1")


@query("stride_channels", TOK + ", k AS (SELECT unnest([2, 3, 5]) AS k), o AS (SELECT k, unnest(range(k)) AS o FROM k) SELECT k AS stride, o AS \"offset\", count(*) AS n, count(DISTINCT word) AS types FROM tokens, o WHERE seq % k = o GROUP BY 1, 2")
def _(t):
    c = corpus(t).select("word", F.explode(F.array(*[F.struct(F.lit(k).alias("stride"), (F.col("seq") % k).cast("long").alias("offset")) for k in (2, 3, 5)])).alias("x"))
    return c.groupBy("x.stride", "x.offset").agg(F.count("*").alias("n"), F.count_distinct("word").alias("types"))


_ORDERS = {"reverse": "-line_no, -pos", "boustrophedon": "line_no, CASE WHEN line_no % 2 = 1 THEN n_line - 1 - pos ELSE pos END", "columns": "pos, line_no", "even_odd": "pos % 2, line_no, pos"}


@query("reading_orders", TOK + " " + " UNION ALL ".join(f"SELECT '{m}' AS mode, doc_id, md5(string_agg(word, ' ' ORDER BY {o})) AS digest FROM tokens GROUP BY doc_id" for m, o in _ORDERS.items()))
def _(t):
    c = lined(t)
    line, pos, n = F.col("line_no"), F.col("pos"), F.col("n_line")
    keyed = lambda m: F.struct(*[k.cast("long").alias(f"k{i}") for i, k in enumerate((*sequence.reading_order(line, pos, n, m), F.lit(0), F.lit(0)))][:3], "word")
    text = lambda m: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(keyed(m))), lambda x: x["word"]), " ").cast("binary"))
    wide = c.groupBy("doc_id").agg(*[text(m).alias(m) for m in _ORDERS])
    return wide.select("doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("digest")) for m in _ORDERS])).alias("x")).select("x.mode", "doc_id", "x.digest")


@query("frequency_bands", TOK + """, c AS (SELECT word, count(*) AS c FROM tokens GROUP BY 1) SELECT CASE WHEN c = 1 THEN 'hapax' WHEN c <= 3 THEN 'rare' WHEN c <= 10 THEN 'mid' WHEN c <= 50 THEN 'common' ELSE 'very_common' END AS band, count(*) AS types, sum(c)::BIGINT AS tokens FROM c GROUP BY 1""")
def _(t):
    c = bare(t).groupBy("word").agg(F.count("*").alias("c"))
    return c.groupBy(W.frequency_band("c").alias("band")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens"))


@query("average_ranks", "WITH r AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rank FROM part) SELECT p_partkey, rank FROM r")
def _(t):
    # ranks of a dimension table by counts of its distinct values: the global order is over the values, not over the rows
    sizes = t.part.groupBy("p_size").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.part.join(sizes.withColumn("rank", before + (F.col("c") - 1) / 2.0).select("p_size", "rank"), "p_size").select("p_partkey", "rank")


@query("spearman_trend", TOK + """, c AS (SELECT source, doc_id, count(*)::DOUBLE AS n, avg(length(word)) AS m FROM tokens GROUP BY 1, 2),
r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY n) + (count(*) OVER (PARTITION BY source, n) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY source ORDER BY doc_id)::DOUBLE AS y FROM c)
SELECT source, round(corr(x, y), 6) + 0.0 AS rho FROM r GROUP BY source""")
def _(t):
    c = bare(t, "source").groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    return sequence.spearman(c, ["source"], "n", "doc_id").select("source", r6("rho").alias("rho"))


@query("opener_mi", TOK + "," + slots_sql("tokens") + ", o AS (SELECT * FROM slots WHERE pos = 0)," + mi_sql("o", "prefix", "source"))
def _(t):
    o = lined(t, "source").where("pos = 0")
    return info.mutual_information(slots(o, "source"), "prefix", "source").select(r6("mi").alias("mi"))


@query("line_edge_contrast", TOK + """SELECT lang, CASE WHEN pos = 0 THEN 'first' WHEN pos = n_line - 1 THEN 'last' ELSE 'mid' END AS place, count(*) AS n, round(avg(length(word)), 6) + 0.0 AS mean_length,
round(avg(CASE WHEN regexp_matches(word, '[ktpf]') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS gallows FROM tokens GROUP BY 1, 2""")
def _(t):
    place = F.when(F.col("pos") == 0, "first").when(F.col("pos") == F.col("n_line") - 1, "last").otherwise("mid")
    return lined(t, "lang").groupBy("lang", place.alias("place")).agg(F.count("*").alias("n"), r6(F.avg(F.length("word"))).alias("mean_length"), r6(F.avg(W.has_gallows("word").cast("double"))).alias("gallows"))


@query("position_buckets", TOK + """SELECT CASE WHEN pos = 0 THEN 'first' WHEN pos = n_line - 1 THEN 'last' WHEN pos = 1 THEN 'second' WHEN pos = n_line - 2 THEN 'penult' ELSE 'interior' END AS a,
CASE WHEN pos = 0 THEN 'first' WHEN pos = 1 THEN 'second' WHEN pos = n_line - 2 THEN 'penult' WHEN pos = n_line - 1 THEN 'last' ELSE 'interior' END AS b, CASE WHEN pos = 0 THEN 'init' WHEN pos = n_line - 1 THEN 'final' ELSE 'mid' END AS c,
CASE WHEN pos < 10 THEN 'c' || pos ELSE 'c10+' END AS d, count(*) AS n FROM tokens GROUP BY 1, 2, 3, 4""")
def _(t):
    return lined(t).groupBy(W.position5("pos", "n_line").alias("a"), W.position5("pos", "n_line", "second_first").alias("b"), W.position3("pos", "n_line").alias("c"), W.column_label("pos").alias("d")).agg(F.count("*").alias("n"))


@query("exact_repeated_lines", TOK + ", k AS (SELECT array_to_string(ws, ' ') AS k, array_to_string(list_sort(ws), ' ') AS b FROM lines WHERE len(ws) >= 3), s AS (SELECT k, count(*) AS n FROM k GROUP BY 1), g AS (SELECT b, count(*) AS n, count(DISTINCT k) AS orders FROM k GROUP BY 1) SELECT 'line' AS kind, k AS \"key\", n, 1 AS orders FROM s WHERE n > 1 UNION ALL SELECT 'bag', b, n, orders FROM g WHERE orders > 1")
def _(t):
    ws = lines(t.documents).select(F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("ws")).where("size(ws) >= 3")
    k = ws.select(F.array_join("ws", " ").alias("k"), F.array_join(F.array_sort("ws"), " ").alias("b")).groupBy("k", "b").agg(F.count("*").alias("n"))
    same = k.where("n > 1").select(F.lit("line").alias("kind"), F.col("k").alias("key"), "n", F.lit(1).cast("long").alias("orders"))
    return same.unionAll(k.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("orders")).where("orders > 1").select(F.lit("bag"), "b", "n", "orders"))


@query("vocabulary_sets", TOK + """, v AS (SELECT DISTINCT lang, word FROM tokens WHERE lang IS NOT NULL), n AS (SELECT lang, count(*) AS n FROM v GROUP BY 1), s AS (SELECT a.lang AS a, b.lang AS b, count(*) AS s FROM v a JOIN v b ON a.word = b.word AND a.lang < b.lang GROUP BY 1, 2)
SELECT x.lang AS lang_a, y.lang AS lang_b, coalesce(s, 0) AS "both", x.n - coalesce(s, 0) AS only_a, y.n - coalesce(s, 0) AS only_b, x.n + y.n - coalesce(s, 0) AS either FROM n x JOIN n y ON x.lang < y.lang LEFT JOIN s ON s.a = x.lang AND s.b = y.lang""")
def _(t):
    """Intersection, differences and union of the vocabularies of all pairs of languages, from the set of languages of each word."""
    v = bare(t, "lang").where("lang is not null").select("lang", "word").distinct()
    n = v.groupBy("lang").agg(F.count("*").alias("n"))
    sets = v.groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("l"))  # an entry for each language
    pair = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y > x), lambda y: F.struct(x.alias("lang_a"), y.alias("lang_b")))))
    s = sets.where("size(l) > 1").select(F.explode(pair).alias("p")).groupBy("p.lang_a", "p.lang_b").agg(F.count("*").alias("s"))
    a, b = n.select(F.col("lang").alias("lang_a"), F.col("n").alias("a")), n.select(F.col("lang").alias("lang_b"), F.col("n").alias("b"))
    out = a.join(F.broadcast(b), F.col("lang_a") < F.col("lang_b")).join(s, ["lang_a", "lang_b"], "left").withColumn("both", F.coalesce("s", F.lit(0)))
    return out.select("lang_a", "lang_b", "both", (F.col("a") - F.col("both")).alias("only_a"), (F.col("b") - F.col("both")).alias("only_b"), (F.col("a") + F.col("b") - F.col("both")).alias("either"))


@query("top_words_by_lang", TOK + ", c AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM c) SELECT lang, word, n, k FROM r WHERE k <= 20")
def _(t):
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))).where("k <= 20")


@query("events_session_windows", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2""")
def _(t):
    e = t.events.select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours"))
    marked = e.withColumn("new", gap)
    return sessions(marked, ["user_id"], ["ts", "event_id"], F.col("new")).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("text_tiling", TOK + """, c AS (SELECT doc_id, line_no, word, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2, 3), gaps AS (SELECT doc_id, line_no AS gap FROM lines WHERE line_no > 0),
l AS (SELECT gaps.doc_id, gap, word, sum(c) AS c FROM gaps JOIN c ON c.doc_id = gaps.doc_id AND c.line_no BETWEEN gap - 3 AND gap - 1 GROUP BY 1, 2, 3), r AS (SELECT gaps.doc_id, gap, word, sum(c) AS c FROM gaps JOIN c ON c.doc_id = gaps.doc_id AND c.line_no BETWEEN gap AND gap + 2 GROUP BY 1, 2, 3),
nl AS (SELECT doc_id, gap, sqrt(sum(c * c)) AS n FROM l GROUP BY 1, 2), nr AS (SELECT doc_id, gap, sqrt(sum(c * c)) AS n FROM r GROUP BY 1, 2), d AS (SELECT l.doc_id, l.gap, sum(l.c * r.c) AS d FROM l JOIN r ON l.doc_id = r.doc_id AND l.gap = r.gap AND l.word = r.word GROUP BY 1, 2)
SELECT nl.doc_id, nl.gap, round(coalesce(d, 0) / (nl.n * nr.n), 6) + 0.0 AS coherence FROM nl JOIN nr ON nl.doc_id = nr.doc_id AND nl.gap = nr.gap LEFT JOIN d ON d.doc_id = nl.doc_id AND d.gap = nl.gap""")
def _(t):
    # a line goes to the three gaps after it and the three before it, so the range join is an explode
    last = t.documents.select("doc_id", (F.size(F.split("text", "\n", -1)) - 1).alias("last"))
    c = lined(t).groupBy("doc_id", "line_no", "word").agg(F.count("*").cast("double").alias("c")).join(last, "doc_id")
    side = F.array(*[F.struct((F.col("line_no") + k).alias("gap"), F.lit(1 if k > 0 else 0).alias("left")) for k in (1, 2, 3, 0, -1, -2)])
    g = c.select("doc_id", "word", "c", "last", F.explode(side).alias("x")).where("x.gap >= 1 and x.gap <= last")
    g = g.groupBy("doc_id", "x.gap", "word").agg(F.sum(F.col("c") * F.col("x.left")).alias("a"), F.sum(F.col("c") * (1 - F.col("x.left"))).alias("b"))
    s = g.groupBy("doc_id", "gap").agg(F.sum(F.col("a") * F.col("b")).alias("d"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    return s.where("na > 0 and nb > 0").select("doc_id", F.col("gap").cast("long").alias("gap"), r6(F.col("d") / (F.col("na") * F.col("nb"))).alias("coherence"))


@query("lag_similarity", TOK + """, c AS (SELECT doc_id, line_no, word, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2, 3), n AS (SELECT doc_id, line_no, sqrt(sum(c * c)) AS n FROM c GROUP BY 1, 2),
p AS (SELECT a.doc_id, a.line_no AS i, b.line_no AS j, a.n * b.n AS n FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.line_no - a.line_no BETWEEN 1 AND 8),
d AS (SELECT a.doc_id, a.line_no AS i, b.line_no AS j, sum(a.c * b.c) AS d FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.word = b.word AND b.line_no - a.line_no BETWEEN 1 AND 8 GROUP BY 1, 2, 3)
SELECT p.j - p.i AS lag, count(*) AS pairs, round(avg(coalesce(d, 0) / n), 6) + 0.0 AS similarity FROM p LEFT JOIN d USING (doc_id, i, j) GROUP BY 1""")
def _(t):
    """Likeness of lines by their distance: the lines of a document meet in the task that reads it, and only sums are shuffled. Documents that share a number are joined by it."""
    once, twice = bags.apart(t.documents)
    s = bags.lag_sums(once, 8)
    if twice is not None:
        c = tokens(twice, seq=False).groupBy("doc_id", "line_no", "word").agg(F.count("*").cast("double").alias("c"))
        n = c.groupBy("doc_id", "line_no").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
        ahead = lambda d: d.select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("lag")).withColumn("j", F.col("line_no") + F.col("lag"))
        p = ahead(n).join(n.select("doc_id", F.col("line_no").alias("j"), F.col("n").alias("m")), ["doc_id", "j"]).select("doc_id", "j", "lag", (F.col("n") * F.col("m")).alias("nn"))
        d = ahead(c).join(c.select("doc_id", F.col("line_no").alias("j"), "word", F.col("c").alias("e")), ["doc_id", "j", "word"]).groupBy("doc_id", "j", "lag").agg(F.sum(F.col("c") * F.col("e")).alias("d"))
        p = p.join(d, ["doc_id", "j", "lag"], "left").groupBy(F.col("lag").cast("long").alias("lag"))
        s = s.unionByName(p.agg(F.count("*").alias("pairs"), F.sum(F.coalesce("d", F.lit(0.0)) / F.col("nn")).alias("total")))
    return s.groupBy("lag").agg(F.sum("pairs").alias("pairs"), r6(F.sum("total") / F.sum("pairs")).alias("similarity")).where("pairs > 0")


@query("drift_thirds", TOK + """, m AS (SELECT doc_id, max(line_no) + 1 AS n FROM lines GROUP BY 1) SELECT lang, count(*) FILTER (WHERE line_no < greatest(n // 3, 1)) AS first_tokens, count(*) FILTER (WHERE line_no >= n - greatest(n // 3, 1)) AS last_tokens,
round(avg(length(word)) FILTER (WHERE line_no < greatest(n // 3, 1)), 6) + 0.0 AS first_length, round(avg(length(word)) FILTER (WHERE line_no >= n - greatest(n // 3, 1)), 6) + 0.0 AS last_length FROM tokens JOIN m USING (doc_id) GROUP BY lang""")
def _(t):
    n = t.documents.select("doc_id", "lang", "text", F.size(F.split("text", "\n", -1)).cast("string").alias("source"))
    c = tokens(n, "lang", "source").withColumn("n", F.col("source").cast("int"))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    a, b = F.col("line_no") < third, F.col("line_no") >= F.col("n") - third
    return c.groupBy("lang").agg(F.count(F.when(a, 1)).alias("first_tokens"), F.count(F.when(b, 1)).alias("last_tokens"), r6(F.avg(F.when(a, F.length("word")))).alias("first_length"), r6(F.avg(F.when(b, F.length("word")))).alias("last_length"))
