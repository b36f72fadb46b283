"""Queries: word features, edit scripts, segmentation, generators, folds, further statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import edits, generate, info, nulls, search, sequence, state
from lexiloom.operators.info import r6
from lexiloom.plans.base import CTOK, TOK, query, slots_sql
from lexiloom.plans.joins import _letters
from lexiloom.plans.lexical import bare, flow, lined, slots

_SLOTS = TOK + "," + slots_sql("tokens")
_BUCKET = "CASE WHEN length(word) <= 3 THEN 'short' WHEN length(word) <= 5 THEN 'medium' WHEN length(word) <= 7 THEN 'long' ELSE 'very_long' END"


@query("word_features", TOK + f""", v AS (SELECT DISTINCT word FROM tokens)
SELECT word, {_BUCKET} AS bucket, regexp_matches(word, '[ktpf]') AS gallows, len(regexp_extract_all(word, 'c[ktpf]h'))::INT AS benched, len(regexp_extract_all(word, '[cs]h'))::INT AS bench,
array_to_string(regexp_extract_all(word, 'c[fkpt]h|ch|sh|.'), ' ') AS units, len(list_distinct(string_split(word, '')))::INT AS letters,
array_to_string(list_filter(string_split(word, ''), lambda x, i: i % 2 = 1), '') AS odd, array_to_string(list_filter(string_split(word, ''), lambda x, i: i % 2 = 0), '') AS even, substr(word, 1, 1) AS first, right(word, 1) AS last,
substr(word, (length(word) - 1) // 2 + 1, 1) AS middle, translate(word, 'abcdefghijklmnopqrstuvwxyz', 'zyxwvutsrqponmlkjihgfedcba') AS mirror, (length(word) % 23)::INT AS length23,
floor(log2(length(word)))::INT AS length_bin, md5('k|' || word) AS hash FROM v""")
def _(t):
    v = bare(t).select("word").distinct()
    c = W.choose_letters
    return v.select(
        "word", W.length_bucket("word").alias("bucket"), W.has_gallows("word").alias("gallows"), W.benched_gallows("word").alias("benched"), W.plain_bench("word").alias("bench"), F.array_join(W.glyph_units("word"), " ").alias("units"),
        W.invariant_shape("word")["letters"].alias("letters"), c("word", "odd").alias("odd"), c("word", "even").alias("even"), c("word", "first").alias("first"), c("word", "last").alias("last"), c("word", "middle").alias("middle"),
        W.mirror_alphabet("word").alias("mirror"), W.numeric_feature("word", "length").alias("length23"), W.log2_bin(F.length("word")).alias("length_bin"), W.stable_hash("k", F.col("word")).alias("hash"),
    )


@query("slot_shapes", _SLOTS + """, v AS (SELECT DISTINCT word, prefix, core, suffix FROM slots)
SELECT word, CASE WHEN core = '' THEN '<empty>' ELSE core END AS core, CASE WHEN prefix = '' THEN 'none' ELSE prefix END || '|' || CASE WHEN suffix = '' THEN 'none' ELSE suffix END AS affixes,
prefix <> '' AS has_prefix, suffix <> '' AS has_suffix, least(length(word), 8)::INT AS length, array_to_string(list_filter([prefix, '#' || core, suffix], lambda x: x NOT IN ('', '#')), ' ') AS morphs,
CASE WHEN prefix = '' THEN '-' ELSE prefix END || ':' || CASE WHEN suffix = '' THEN '-' ELSE suffix END AS signature FROM v""")
def _(t):
    v = bare(t).select("word").distinct()
    s = W.affix_shape("word")
    return v.select("word", W.core_or_empty("word").alias("core"), W.affix_pair("word").alias("affixes"), s["prefix"].alias("has_prefix"), s["suffix"].alias("has_suffix"), s["length"].alias("length"), F.array_join(W.morphs("word"), " ").alias("morphs"), W.signature("word", "affixes").alias("signature"))


@query("letter_ngrams", TOK + """, g AS (SELECT k, substr('^' || word || '$', i, k) AS g FROM (SELECT word, k, unnest(range(1, length(word) + 4 - k)) AS i FROM tokens, (SELECT unnest([2, 3]) AS k))) SELECT k::INT AS k, g, count(*) AS n FROM g WHERE length(g) = k GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    c = bare(t).groupBy("word").agg(F.count("*").alias("n"))
    sized = lambda k: F.transform(W.ngrams("word", k, pad=True), lambda g: F.struct(F.lit(k).alias("k"), g.alias("g")))
    g = c.select("n", F.explode(F.concat(*map(sized, (2, 3)))).alias("x"))
    return g.groupBy("x.k", "x.g").agg(F.sum("n").alias("n")).where("n >= 20")


@query("line_edge_kl", TOK + """, f AS (SELECT substr(word, 1, 1) AS g, pos = 0 AS first, pos = n_line - 1 AS last FROM tokens), p AS (SELECT g, count(*) FILTER (WHERE first) AS a, count(*) FILTER (WHERE last) AS b, count(*) AS c FROM f GROUP BY 1), n AS (SELECT sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, sum(c)::DOUBLE AS nc FROM p)
SELECT round(sum(CASE WHEN a > 0 THEN a / na * log2((a / na) / (c / nc + 1e-9::DOUBLE)) ELSE 0 END), 6) + 0.0 AS kl_first, round(sum(CASE WHEN b > 0 THEN b / nb * log2((b / nb) / (c / nc + 1e-9::DOUBLE)) ELSE 0 END), 6) + 0.0 AS kl_last FROM p, n""")
def _(t):
    """Initials of the first and of the last words of lines against all initials: one count of initials by place."""
    pos, last = F.col("pos"), F.col("pos") == F.col("n_line") - 1
    f = lined(t).groupBy(F.substring("word", 1, 1).alias("g")).agg(F.count(F.when(pos == 0, 1)).alias("a"), F.count(F.when(last, 1)).alias("b"), F.count("*").alias("c"))
    f = f.join(F.broadcast(f.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum("c").alias("nc"))))  # one row
    kl = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) / F.col("n" + x) * F.log2(F.col(x) / F.col("n" + x) / (F.col("c") / F.col("nc") + 1e-9))).otherwise(0.0))
    return f.agg(r6(kl("a")).alias("kl_first"), r6(kl("b")).alias("kl_last"))


@query("state_distance_halves", TOK + """, h AS (SELECT doc_id % 2 AS side, substr(word, 1, 1) AS ctx, right(word, 1) AS s, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2, 3), p AS (SELECT ctx, s, c, sum(c) OVER (PARTITION BY ctx) AS t FROM h WHERE side = 0), q AS (SELECT ctx, s, c, sum(c) OVER (PARTITION BY ctx) AS t FROM h WHERE side = 1),
b AS (SELECT coalesce(p.ctx, q.ctx) AS ctx, coalesce(p.c / p.t, 0) AS x, coalesce(q.c / q.t, 0) AS y, p.t AS pt, q.t AS qt FROM p FULL JOIN q ON p.ctx = q.ctx AND p.s = q.s),
d AS (SELECT ctx, sum(abs(x - y)) / 2 AS d, coalesce(max(pt), 0) + coalesce(max(qt), 0) AS w, max(pt) IS NULL OR max(qt) IS NULL AS alone FROM b GROUP BY 1) SELECT round(sum((CASE WHEN alone THEN 1 ELSE d END) * w) / sum(w), 6) + 0.0 AS tv FROM d""")
def _(t):
    h = bare(t).groupBy((F.col("doc_id") % 2).alias("side"), F.substring("word", 1, 1).alias("ctx"), F.right("word", F.lit(1)).alias("s")).agg(F.count("*").alias("c"))
    return info.total_variation(h.where("side = 0").drop("side"), h.where("side = 1").drop("side"), ["ctx"], "s").select(r6("tv").alias("tv"))


@query("redundancy_by_source", TOK + """, u AS (SELECT source, list_concat(list_concat(['^'], string_split(word, '')), ['$']) AS u FROM tokens), b AS (SELECT source, u[i] AS x, u[i + 1] AS y FROM (SELECT source, u, unnest(range(1, len(u))) AS i FROM u)), c AS (SELECT source, x, y, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2, 3),
p AS (SELECT source, x, sum(c) AS m, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2), h AS (SELECT source, sum(m * log2(m) - s) / sum(m) AS h FROM p GROUP BY 1), a AS (SELECT source, log2(count(DISTINCT y)) AS a FROM c WHERE y <> '$' GROUP BY 1) SELECT source, round((a - h) / a, 6) + 0.0 AS redundancy FROM h JOIN a USING (source)""")
def _(t):
    u = bare(t, "source").select("source", F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    p = u.select("source", F.explode(W.ngrams("w", 2)).alias("g")).select("source", F.substring("g", 1, 1).alias("x"), F.substring("g", 2, 1).alias("y"))
    h = info.conditional_entropy(p, ["y"], ["x"], ["source"])
    a = p.where("y <> '$'").select("source", "y").distinct().groupBy("source").agg(F.log2(F.count("*").cast("double")).alias("a"))
    return h.join(a, "source").select("source", r6((F.col("a") - F.col("h")) / F.col("a")).alias("redundancy"))


@query("within_between_sections", TOK + """, p AS (SELECT source, lang, avg(length(word)) AS x FROM tokens GROUP BY 1, 2), d AS (SELECT a.lang = b.lang AS same, abs(a.x - b.x) AS d FROM p a JOIN p b ON (a.source, a.lang) < (b.source, b.lang)) SELECT round(avg(d) FILTER (WHERE same), 6) + 0.0 AS within, round(avg(d) FILTER (WHERE NOT same), 6) + 0.0 AS between, round(avg(d) FILTER (WHERE same) / avg(d) FILTER (WHERE NOT same), 6) + 0.0 AS ratio FROM d""")
def _(t):
    p = bare(t, "source", "lang").groupBy("source", "lang").agg(F.avg(F.length("word")).alias("x")).withColumn("k", F.struct("source", "lang"))
    # a row for each source and language: a dimension-sized pair table
    d = p.alias("a").join(p.alias("b"), F.col("a.k") < F.col("b.k")).select((F.col("a.lang") == F.col("b.lang")).alias("same"), F.abs(F.col("a.x") - F.col("b.x")).alias("d"))
    w, b = F.avg(F.when(F.col("same"), F.col("d"))), F.avg(F.when(~F.col("same"), F.col("d")))
    return d.agg(r6(w).alias("within"), r6(b).alias("between"), r6(w / b).alias("ratio"))


@query("micro_macro_bits", TOK + """, b AS (SELECT source, count(*) AS n, sum(length(word) * 1.0::DOUBLE) AS s FROM tokens GROUP BY 1) SELECT round(sum(s) / sum(n), 6) + 0.0 AS micro, round(avg(s / n), 6) + 0.0 AS macro FROM b""")
def _(t):
    b = bare(t, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("word").cast("double")).alias("s"))
    return b.agg(r6(F.sum("s") / F.sum("n")).alias("micro"), r6(F.avg(F.col("s") / F.col("n"))).alias("macro"))


@query("residual_autocorrelation", TOK + """, r AS (SELECT doc_id, line_no, pos, length(word) - avg(length(word)) OVER (PARTITION BY source, least(pos, 4)) AS r FROM tokens), l AS (SELECT r, lag(r) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS b FROM r) SELECT count(b) AS n, round(corr(r, b), 6) + 0.0 AS r FROM l""")
def _(t):
    c = lined(t, "source").select("doc_id", "line_no", "pos", F.coalesce("source", F.lit("\0")).alias("source"), F.length("word").alias("n"), F.least(F.col("pos"), F.lit(4)).alias("place"))
    mean = c.groupBy("source", "place").agg(F.avg("n").alias("mean"))  # five rows for each source
    r = c.join(mean, ["source", "place"]).withColumn("r", F.col("n") - F.col("mean"))
    b = r.withColumn("b", F.lag("r").over(Window.partitionBy("doc_id", "line_no").orderBy("pos")))
    return b.agg(F.count("b").alias("n"), r6(F.corr("r", "b")).alias("r"))


@query("drift_from_first_line", TOK + """, m AS (SELECT doc_id, line_no, avg(length(word)) AS x FROM tokens GROUP BY 1, 2), f AS (SELECT doc_id, arg_min(x, line_no) AS x0 FROM m GROUP BY 1), d AS (SELECT doc_id, line_no, abs(x - x0) AS d FROM m JOIN f USING (doc_id)) SELECT doc_id, round(regr_slope(d, line_no), 6) + 0.0 AS slope FROM d GROUP BY 1 HAVING count(*) >= 4""")
def _(t):
    m = lined(t).groupBy("doc_id", "line_no").agg(F.avg(F.length("word")).alias("x"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = m.withColumn("d", F.abs(F.col("x") - F.first("x").over(w)))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), r6(F.regr_slope("d", "line_no")).alias("slope")).where("n >= 4").select("doc_id", "slope")


@query("rank_parity_bits", TOK + """, c AS (SELECT source, substr(word, 1, 1) AS ctx, word, count(*) AS n FROM tokens GROUP BY 1, 2, 3), k AS (SELECT ctx, word, sum(n) AS n FROM c GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, word) AS r, count(*) OVER (PARTITION BY ctx) AS k, sum(n) OVER (PARTITION BY ctx) AS t FROM k)
SELECT ctx, word, ((r - 1) % 2)::INT AS bit FROM g WHERE t >= 50 AND k >= 2""")
def _(t):
    k = bare(t).groupBy(F.substring("word", 1, 1).alias("ctx"), "word").agg(F.count("*").alias("n"))
    size = k.groupBy("ctx").agg(F.count("*").alias("k"), F.sum("n").alias("t")).where("t >= 50 and k >= 2")  # a row for each letter
    r = sequence.ranks(k, ["ctx"], F.struct(-F.col("n"), F.substring("word", 1, 3)), [F.col("n").desc(), "word"], "r")
    return r.join(F.broadcast(size), "ctx").select("ctx", "word", ((F.col("r") - 1) % 2).cast("int").alias("bit"))


@query("frequency_rank_decode", TOK + """, a AS (SELECT lang, substr(w, i, 1) AS g, count(*) AS n FROM (SELECT lang, word AS w, unnest(range(1, length(word) + 1)) AS i FROM tokens WHERE lang IS NOT NULL) GROUP BY 1, 2),
x AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS r FROM a) SELECT x.lang AS cipher_lang, y.lang AS plain_lang, x.g AS cipher, y.g AS plain FROM x JOIN x y ON x.r = y.r AND x.lang <> y.lang""")
def _(t):
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n")).select("lang", "n", F.explode(F.split("word", "")).alias("g"))
    c = c.groupBy("lang", "g").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "g")))
    c = c.where("lang is not null")  # alphabets
    a, b = c.select(F.col("lang").alias("cipher_lang"), F.col("g").alias("cipher"), "r"), c.select(F.col("lang").alias("plain_lang"), F.col("g").alias("plain"), "r")
    return a.join(b, "r").where("cipher_lang <> plain_lang").select("cipher_lang", "plain_lang", "cipher", "plain")


@query("bpe_first_merges")
def _(t):
    """The merges in order; an iteration that SQL has no form of. tests/test_search.py compares it with brute force."""
    done, _ = search.bpe_merges(bare(t).select("word"), 6)
    return t.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(done)], "i int, a string, b string")


@query("edit_scripts", None)
def _(t):
    """Edit scripts from each word to the next one in its line: renderings by frequency. Alignments have no SQL form."""
    nxt = F.lead("word").over(Window.partitionBy("doc_id", "line_no").orderBy("pos"))
    p = lined(t).select(F.col("word").alias("source"), nxt.alias("target")).where("target is not null and levenshtein(source, target) <= 3").groupBy("source", "target").agg(F.count("*").alias("n"))
    a = edits.align(p)
    return a.select("n", edits.render(F.col("ops"), F.col("source"), F.col("target"), "operation_position").alias("symbol")).groupBy("symbol").agg(F.sum("n").alias("n"))


@query("schema_words", _SLOTS + """, s AS (SELECT core, prefix, suffix FROM slots), u AS (SELECT i, 'u' AS z FROM range(300) r(i)), h AS (SELECT i, p, ('0x' || substr(md5('gen|' || p || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM u, (SELECT unnest(['core', 'prefix', 'suffix']) AS p)),
c AS (SELECT core, sum(n) OVER (ORDER BY core) / (SELECT count(*) FROM s)::DOUBLE AS hi, n FROM (SELECT core, count(*) AS n FROM s GROUP BY 1)), cl AS (SELECT core, coalesce(lag(hi) OVER (ORDER BY core), 0) AS lo, hi FROM c),
p AS (SELECT core, prefix, sum(n) OVER (PARTITION BY core ORDER BY prefix) / (sum(n) OVER (PARTITION BY core))::DOUBLE AS hi FROM (SELECT core, prefix, count(*) AS n FROM s GROUP BY 1, 2)), pl AS (SELECT core, prefix, coalesce(lag(hi) OVER (PARTITION BY core ORDER BY prefix), 0) AS lo, hi FROM p),
q AS (SELECT core, suffix, sum(n) OVER (PARTITION BY core ORDER BY suffix) / (sum(n) OVER (PARTITION BY core))::DOUBLE AS hi FROM (SELECT core, suffix, count(*) AS n FROM s GROUP BY 1, 2)), ql AS (SELECT core, suffix, coalesce(lag(hi) OVER (PARTITION BY core ORDER BY suffix), 0) AS lo, hi FROM q)
SELECT a.i, pl.prefix || cl.core || ql.suffix AS word FROM h a JOIN cl ON a.p = 'core' AND a.u >= cl.lo AND a.u < cl.hi JOIN h b ON b.i = a.i AND b.p = 'prefix' JOIN pl ON pl.core = cl.core AND b.u >= pl.lo AND b.u < pl.hi JOIN h d ON d.i = a.i AND d.p = 'suffix' JOIN ql ON ql.core = cl.core AND d.u >= ql.lo AND d.u < ql.hi""")
def _(t):
    words = bare(t).groupBy("word").agg(F.count("*").alias("n_words"))
    return generate.schema_words(slots(words, "n_words"), 300, "gen")


@query("homophonic_symbols", TOK + """, l AS (SELECT doc_id, seq, i, substr(word, i, 1) AS g FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM tokens)) SELECT g || floor(('0x' || substr(md5('hom|' || doc_id || '|' || seq || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 3)::INT AS symbol, count(*) AS n FROM l GROUP BY 1""")
def _(t):
    l = flow(t).select("doc_id", "seq", F.posexplode(F.split("word", "")).alias("i", "g")).withColumn("i", F.col("i") + 1)
    return generate.homophonic(l, "g", [F.col("doc_id"), F.col("seq"), F.col("i")], 3, "hom").groupBy("symbol").agg(F.count("*").alias("n"))


@query("markov_words", TOK + """, w AS (SELECT word, count(*) AS k FROM tokens GROUP BY 1), b AS (SELECT k, substr('^^' || word || '$', i, 2) AS a, substr('^^' || word || '$', i + 2, 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM w)), n AS (SELECT a, v, sum(k)::BIGINT AS n FROM b GROUP BY 1, 2),
c AS (SELECT a, v, sum(n) OVER (PARTITION BY a ORDER BY v) AS hi, sum(n) OVER (PARTITION BY a ORDER BY v) - n AS lo, sum(n) OVER (PARTITION BY a) AS t FROM n),
g AS (WITH RECURSIVE g(rep, i, j, ctx, done, word) AS (SELECT rep, i, 0, '^^', false, '' FROM range(2) x(rep), range(500) r(i) UNION ALL SELECT g.rep, g.i, g.j + 1, substr(g.ctx, 2, 1) || c.v, c.v = '$', CASE WHEN c.v = '$' THEN g.word ELSE g.word || c.v END FROM g JOIN c ON c.a = g.ctx AND floor((('0x' || substr(md5('mk|' || g.rep || '|' || g.i || '|' || g.j), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * t) >= lo AND floor((('0x' || substr(md5('mk|' || g.rep || '|' || g.i || '|' || g.j), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * t) < hi WHERE NOT g.done AND g.j < 40) SELECT rep, i, arg_max(word, j) AS word FROM g GROUP BY 1, 2)
SELECT rep::INT AS rep, count(*) AS n, count(*) FILTER (WHERE word IN (SELECT word FROM w)) AS known FROM g GROUP BY 1""")
def _(t):
    """Words of an order-2 letter chain and whether the corpus has them: share by replicate."""
    c = bare(t)
    m = generate.markov_words(c, 2, 500, 2, "mk")
    seen = c.select("word").distinct().withColumn("known", F.lit(1))
    return m.join(seen, "word", "left").groupBy("rep").agg(F.count("*").alias("n"), F.count("known").alias("known"))


@query("fold_assignment", TOK + """, b AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS r FROM (SELECT DISTINCT source FROM tokens)) SELECT source, (r % 4)::INT AS fold, ((r + 1) % 4)::INT AS validates FROM b""")
def _(t):
    b = bare(t, "source").select("source").distinct()
    r = F.dense_rank().over(Window.orderBy("source")) - 1  # one row for each source
    return b.select("source", (r % 4).cast("int").alias("fold"), ((r + 1) % 4).cast("int").alias("validates"))


@query("stratified_folds", "WITH l AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('cv|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM l")
def _(t):
    l = t.labels.where("quality is not null").select("doc_id", "quality", W.stable_hash("cv", F.col("doc_id").cast("string")).alias("h"))  # noqa: E741
    r = sequence.ranks(l, ["quality"], F.substring("h", 1, 3), ["h", "doc_id"], "r")
    return r.select("doc_id", "quality", ((F.col("r") - 1) % 5).cast("int").alias("fold"))


@query("sign_test", TOK + """, h AS (SELECT source, avg(length(word)) FILTER (WHERE pos = 0) - avg(length(word)) FILTER (WHERE pos > 0) AS d FROM tokens GROUP BY 1), s AS (SELECT count(*) FILTER (WHERE d <> 0) AS n, count(*) FILTER (WHERE d > 0) AS k FROM h),
f AS (SELECT n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS p FROM s, range(0, 60) r(i) WHERE i >= k AND i <= n) SELECT any_value(n) AS n, any_value(k) AS positive, round(sum(p), 6) + 0.0 AS p FROM f""")
def _(t):
    h = lined(t, "source").groupBy("source").agg((F.avg(F.when(F.col("pos") == 0, F.length("word"))) - F.avg(F.when(F.col("pos") > 0, F.length("word")))).alias("d"))
    s = h.agg(F.count(F.when(F.col("d") != 0, 1)).alias("n"), F.count(F.when(F.col("d") > 0, 1)).alias("positive"))
    fact = lambda x: F.aggregate(F.when(x > 0, F.sequence(F.lit(1), x)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log(i))
    tail = F.aggregate(F.sequence("positive", "n"), F.lit(0.0), lambda a, i: a + F.exp(fact(F.col("n")) - fact(i) - fact(F.col("n") - i) - F.col("n") * F.log(F.lit(2.0))))
    return s.select("n", "positive", r6(tail).alias("p"))


@query("mantel_label_centroids", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
p AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS y FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2) SELECT count(*) AS pairs, round(corr(b - a, y), 5) + 0.0 AS r FROM p""")
def _(t):
    """Pairs of labels: distance of the labels against likeness of their mean vectors; a row for each label."""
    c = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    p = c.alias("a").join(c.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label"))).groupBy(F.col("a.label").alias("p"), F.col("b.label").alias("q")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("y"))
    return p.agg(F.count("*").alias("pairs"), (F.round(F.corr(F.col("q") - F.col("p"), "y"), 5) + F.lit(0.0)).alias("r"))


@query("hierarchical_state_bits", TOK + """, l AS (SELECT doc_id, line_no, seq, substr(word || '$', i, 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM tokens)), k AS (SELECT count(DISTINCT s) AS k FROM l), c AS (SELECT doc_id, line_no, seq, s, count(*) AS c FROM l GROUP BY ALL), n AS (SELECT doc_id, line_no, seq, sum(c) AS c FROM c GROUP BY ALL),
m AS (SELECT doc_id, seq, sum(c) OVER (PARTITION BY doc_id ORDER BY seq) - c AS m1, sum(c) OVER (PARTITION BY doc_id, line_no ORDER BY seq) - c AS m2 FROM n), h AS (SELECT doc_id, seq, c, sum(c) OVER (PARTITION BY doc_id, s ORDER BY seq) - c AS h1, sum(c) OVER (PARTITION BY doc_id, line_no, s ORDER BY seq) - c AS h2 FROM c),
p AS (SELECT h.doc_id, h.seq, c, (h2 + 32.0::DOUBLE * ((h1 + 32.0::DOUBLE / k) / (m1 + 32.0::DOUBLE))) / (m2 + 32.0::DOUBLE) AS p FROM h JOIN m ON m.doc_id = h.doc_id AND m.seq = h.seq, k), w AS (SELECT doc_id, seq, -sum(c * log2(p)) AS b FROM p GROUP BY 1, 2) SELECT doc_id, count(*) AS words, round(avg(b), 6) + 0.0 AS bits FROM w GROUP BY doc_id""")
def _(t):
    """Line caches that back off to page caches."""
    scored = state.hierarchical_cache(_letters(t), ["doc_id"], ["line_no"], "seq", "base")
    return state.bits_per_word(scored, ["doc_id"], ["seq"]).select("doc_id", "words", r6("bits").alias("bits"))


@query("conversation_novelty", CTOK + """, f AS (SELECT conv_id, turn, word, row_number() OVER (PARTITION BY conv_id, word ORDER BY turn, role, pos) = 1 AS new FROM ctok) SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE new) AS new_words FROM f GROUP BY 1, 2""")
def _(t):
    from lexiloom.operators.tokens import tokens

    c = tokens(t.conversations, "turn", "role", key="conv_id")
    first = F.min("turn").over(Window.partitionBy("conv_id", "word"))
    new = (F.row_number().over(Window.partitionBy("conv_id", "word").orderBy("turn", "role", "seq")) == 1).cast("int")
    return c.withColumns({"new": new, "f": first}).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum("new").alias("new_words"))


@query("page_plain_text", r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS n FROM pages""")
def _(t):
    from lexiloom.sources.markup import html_text

    return t.pages.select("page_id", F.length(html_text("html")).cast("long").alias("n"))


@query("bootstrap_draws", "WITH b AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS i, count(*) OVER () AS m FROM region), d AS (SELECT rep, draw, floor(('0x' || substr(md5('reg|' || rep || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 5)::INT AS i FROM range(20) r(rep), range(5) q(draw)) SELECT rep::INT AS rep, r_regionkey, count(*) AS n FROM d JOIN b USING (i) GROUP BY 1, 2")
def _(t):
    return nulls.bootstrap(t.region.select("r_regionkey"), "r_regionkey", 20, "reg").groupBy("rep", "r_regionkey").agg(F.count("*").alias("n"))
