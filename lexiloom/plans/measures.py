"""Queries: further measures of order and place, controls by exchange, rasters, drawn lines, searches over options."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import bags, bits, generate, info, nulls, raster, sequence
from lexiloom.operators.info import r6
from lexiloom.operators.tokens import tokens
import lexiloom.plans.sequences  # noqa: F401  (registers lag_similarity)
from lexiloom.plans.base import ORACLE, QUERIES, TOK, query
from lexiloom.plans.lexical import bare, corpus, flow, lined


def _u(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# Order and place -------------------------------------------------------------------------------------------------------


@query("lag_similarity_slope", f"WITH l AS ({ORACLE['lag_similarity']}) SELECT round(regr_slope(similarity, lag), 5) + 0.0 AS slope, round(corr(similarity, lag), 4) + 0.0 AS r FROM l")
def _(t):
    """Slope of the lines' likeness over their distance."""
    l = QUERIES["lag_similarity"](t.spark, t.sf_dir)  # noqa: E741
    return l.agg((F.round(F.regr_slope("similarity", "lag"), 5) + F.lit(0.0)).alias("slope"), (F.round(F.corr("similarity", "lag"), 4) + F.lit(0.0)).alias("r"))


@query("opener_baseline", TOK + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY md5('op|' || doc_id || '|' || line_no || '|' || pos), pos) AS k FROM tokens WHERE source IS NOT NULL), e AS (SELECT 'opener' AS kind, source AS x, substr(word, 1, 1) AS y FROM r WHERE pos = 0 UNION ALL SELECT 'random', source, substr(word, 1, 1) FROM r WHERE k = 1),
c AS (SELECT kind, x, y, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2, 3), m AS (SELECT *, sum(c) OVER (PARTITION BY kind, x) AS a, sum(c) OVER (PARTITION BY kind, y) AS b, sum(c) OVER (PARTITION BY kind) AS n FROM c) SELECT kind, round(sum(c / n * log2(c * n / (a * b))), 6) + 0.0 AS mi FROM m GROUP BY 1""")
def _(t):
    """What the first letter of a line's first word tells of the source, and what that of a random word of the line does."""
    c = lined(t, "source").where("source is not null")
    h = W.stable_hash("op", *[F.col(k).cast("string") for k in ("doc_id", "line_no", "pos")])
    pick = c.groupBy("doc_id", "line_no", "source").agg(F.min(F.when(F.col("pos") == 0, F.col("word"))).alias("opener"), F.min(F.struct(h.alias("h"), "pos", "word"))["word"].alias("random"))
    e = pick.select(F.col("source").alias("x"), F.explode(F.create_map(F.lit("opener"), F.col("opener"), F.lit("random"), F.col("random"))).alias("kind", "w")).withColumn("y", F.substring("w", 1, 1))
    return info.mutual_information(e, "x", "y", ["kind"]).select("kind", r6("mi").alias("mi"))


@query("ordinal_drift", TOK + "SELECT lang, round(corr(doc_id, CASE WHEN substr(word, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS r FROM tokens WHERE pos = 0 GROUP BY 1")
def _(t):
    """Drift of a feature of the lines' openers along the order of the documents."""
    return lined(t, "lang").where("pos = 0").groupBy("lang").agg((F.round(F.corr("doc_id", F.substring("word", 1, 1).isin(*"aeiou").cast("double")), 5) + F.lit(0.0)).alias("r"))


@query("locus_words", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS locus, split_part(split_part(split_part(url, '://', 2), '/', 1), '.', 1) AS first, len(string_split(split_part(split_part(url, '://', 2), '/', 1), '.')) AS parts, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    """Loci of several words: the words, how many they are, and the first one."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    p = t.pages.where("url is not null").select(host.alias("locus")).withColumn("w", F.split("locus", r"\."))
    return p.groupBy("locus", F.get("w", F.lit(0)).alias("first"), F.size("w").cast("long").alias("parts")).agg(F.count("*").alias("n"))


@query("glyph_phases", TOK + """, p AS (SELECT doc_id, line_no, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM lines), a AS (SELECT t.doc_id, t.line_no, pos, length(word) AS n, sum(length(word)) OVER (PARTITION BY t.doc_id, t.line_no ORDER BY pos) - length(word) AS g, row_number() OVER (PARTITION BY t.doc_id, paragraph ORDER BY t.line_no, pos) - 1 AS w FROM tokens t JOIN p ON p.doc_id = t.doc_id AND p.line_no = t.line_no)
SELECT g % 7 AS glyph_in_line, w % 5 AS word_in_paragraph, count(*) AS words, sum(n)::BIGINT AS letters FROM a GROUP BY 1, 2""")
def _(t):
    """Words by the place of their first letter in the line, and by their place in the paragraph."""
    blank = F.transform(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), (F.trim(x) == "").alias("b"))), lambda x: x["b"]), lambda x: x["i"])
    c = corpus(t).join(t.documents.select("doc_id", blank.alias("blank")).dropDuplicates(["doc_id"]), "doc_id")
    c = c.withColumn("paragraph", F.size(F.filter("blank", lambda i: i <= F.col("line_no"))))
    line, para = Window.partitionBy("doc_id", "line_no").orderBy("pos"), Window.partitionBy("doc_id", "paragraph").orderBy("seq")
    a = c.select(F.length("word").alias("n"), (F.sum(F.length("word")).over(line) - F.length("word")).alias("g"), (F.row_number().over(para) - 1).alias("w"))
    return a.groupBy((F.col("g") % 7).alias("glyph_in_line"), (F.col("w") % 5).cast("long").alias("word_in_paragraph")).agg(F.count("*").alias("words"), F.sum("n").alias("letters"))


@query("information_gain_null", TOK + """, d AS (SELECT md5('ig|' || doc_id || '|' || line_no || '|' || pos) AS k, least(pos, 6) AS x, substr(word, 1, 1) AS y FROM tokens WHERE line_no = 0), a AS (SELECT rep, k, x, y, row_number() OVER (PARTITION BY rep ORDER BY k) AS i, row_number() OVER (PARTITION BY rep ORDER BY md5('gain|' || rep || '|' || k), k) AS j FROM d, range(3) r(rep)),
e AS (SELECT -1 AS rep, x, y FROM d UNION ALL SELECT a.rep, a.x, b.y FROM a JOIN a b ON a.rep = b.rep AND a.i = b.j), c AS (SELECT rep, x, y, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2, 3), m AS (SELECT *, sum(c) OVER (PARTITION BY rep, x) AS a, sum(c) OVER (PARTITION BY rep, y) AS b, sum(c) OVER (PARTITION BY rep) AS n FROM c) SELECT rep::INT AS rep, round(sum(c / n * log2(c * n / (a * b))), 6) + 0.0 AS gain FROM m GROUP BY 1""")
def _(t):
    """What the column tells of a first line's initials: as it is (rep -1), and with the initials dealt anew."""
    k = W.stable_hash("ig", *[F.col(c).cast("string") for c in ("doc_id", "line_no", "pos")])
    d = lined(t).where("line_no = 0").select(k.alias("k"), F.least(F.col("pos"), F.lit(6)).alias("x"), F.substring("word", 1, 1).alias("y"))
    s = nulls.permute_within(d.select("k", "y"), "k", "y", [], 3, "gain", "z").select("rep", "k", F.col("z").alias("y")).join(d.select("k", "x"), "k").select("rep", "x", "y")
    return info.information_gain(s.unionByName(d.select(F.lit(-1).alias("rep"), "x", "y")), "y", "x", ["rep"], "gain").select("rep", r6("gain").alias("gain"))


@query("recall_at_k", """WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars, documents.doc_id) AS k FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE quality IS NOT NULL AND source IS NOT NULL)
SELECT k, round(avg(hit), 6) + 0.0 AS recall FROM (SELECT source, c.k, count(*) FILTER (WHERE quality = 0 AND r.k <= c.k) / nullif(count(*) FILTER (WHERE quality = 0), 0)::DOUBLE AS hit FROM r, (SELECT unnest([1, 3, 5, 10]) AS k) c GROUP BY 1, 2) WHERE hit IS NOT NULL GROUP BY 1""")
def _(t):
    """Share of a source's bad documents among its k shortest."""
    d = t.documents.where("source is not null").select("doc_id", "source", "n_chars").join(t.labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    r = sequence.ranks(d, ["source"], F.floor(F.col("n_chars") / 256), ["n_chars", "doc_id"], "r").where("quality = 0")
    hits = r.groupBy("source").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("r") <= k, 1)).alias(f"h{k}") for k in (1, 3, 5, 10)])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.col("n")).alias("hit")) for k in (1, 3, 5, 10)])).alias("x")).groupBy("x.k").agg(r6(F.avg("x.hit")).alias("recall"))


@query("tfidf_cosine", TOK + """, c AS (SELECT doc_id, word, count(*) AS tf FROM tokens GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM c), w AS (SELECT doc_id, word, tf * ln((n + 1) / (df + 1)::DOUBLE) AS w FROM c JOIN d USING (word), n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
p AS (SELECT a.doc_id, sum(a.w * b.w) AS p FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.word = b.word GROUP BY 1) SELECT x.doc_id, round(coalesce(p, 0) / (x.l * y.l), 5) + 0.0 AS cosine FROM l x JOIN l y ON y.doc_id = x.doc_id + 1 LEFT JOIN p ON p.doc_id = x.doc_id WHERE x.l > 0 AND y.l > 0""")
def _(t):
    """Cosine of the TF-IDF vectors of neighbouring documents."""
    c = bare(t).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    d = c.groupBy("word").agg(F.count("*").alias("df"))
    n = F.broadcast(c.agg(F.count_distinct("doc_id").alias("n")))
    w = c.join(d, "word").join(n).select("doc_id", "word", (F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("w"))
    l = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l")).where("l > 0")  # noqa: E741
    back = lambda df, *k: df.withColumn("doc_id", F.col("doc_id") - 1)
    p = w.join(back(w).withColumnRenamed("w", "v"), ["doc_id", "word"]).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("v")).alias("p"))
    j = l.join(back(l).withColumnRenamed("l", "m"), "doc_id").join(p, "doc_id", "left")
    return j.select("doc_id", (F.round(F.coalesce("p", F.lit(0.0)) / (F.col("l") * F.col("m")), 5) + F.lit(0.0)).alias("cosine"))


_FREQ = "least(7, floor(log2({x})))::INT"
_GAPB = "CASE WHEN {x} IS NULL THEN 0 WHEN {x} <= 1 THEN 1 WHEN {x} <= 4 THEN 2 WHEN {x} <= 16 THEN 3 ELSE 4 END"
_DEC = "least(9, ({x}) * 10 // {n})::INT"


@query("recurrence_vectors", TOK + f""", f AS (SELECT doc_id, seq, word, count(*) OVER w AS freq, min(seq) OVER w AS first, max(seq) OVER w AS last, row_number() OVER (PARTITION BY doc_id, word ORDER BY seq) - 1 AS prior, seq - lag(seq) OVER (PARTITION BY doc_id, word ORDER BY seq) AS gap, lead(seq) OVER (PARTITION BY doc_id, word ORDER BY seq) - seq AS ahead, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens WINDOW w AS (PARTITION BY doc_id, word)),
g AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS code FROM f), h AS (SELECT *, max(code) OVER (PARTITION BY doc_id) + 1 AS types, {", ".join(f"{fn}(code, {k}) OVER s AS c_{nm}, {fn}(freq, {k}) OVER s AS f_{nm}" for fn, k, nm in (("lag", 1, "l1"), ("lead", 1, "r1"), ("lag", 2, "l2"), ("lead", 2, "r2")))} FROM g WINDOW s AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, {_FREQ.format(x="freq")} AS frequency, {_DEC.format(x="code", n="types")} AS rank, {_DEC.format(x="first", n="n")} AS first, {_DEC.format(x="last", n="n")} AS last, least(6, prior)::INT AS prior, least(6, freq - 1 - prior)::INT AS future, {_GAPB.format(x="gap")} AS previous_gap, {_GAPB.format(x="ahead")} AS next_gap, {_DEC.format(x="seq", n="n")} AS place,
{", ".join(f"coalesce({_FREQ.format(x='f_' + k)}, 8) AS {k}_frequency, CASE WHEN c_{k} IS NULL THEN 2 WHEN c_{k} = code THEN 1 ELSE 0 END AS {k}_same" for k in ("l1", "r1", "l2", "r2"))} FROM h""")
def _(t):
    """All seventeen features of a position that depend on recurrences alone."""
    own, doc = Window.partitionBy("doc_id", "word"), Window.partitionBy("doc_id")
    at, s = own.orderBy("seq"), doc.orderBy("seq")
    f = flow(t).withColumns({
        "freq": F.count("*").over(own), "first_": F.min("seq").over(own), "last_": F.max("seq").over(own), "prior_": F.row_number().over(at) - 1,
        "gap": F.col("seq") - F.lag("seq").over(at), "ahead": F.lead("seq").over(at) - F.col("seq"), "n": F.count("*").over(doc),
    })
    f = f.withColumn("code", F.dense_rank().over(doc.orderBy("first_")) - 1).withColumn("types", F.max("code").over(doc) + 1)
    near = {"l1": (F.lag, 1), "r1": (F.lead, 1), "l2": (F.lag, 2), "r2": (F.lead, 2)}
    f = f.withColumns({f"{p}_{k}": fn(c, d).over(s) for k, (fn, d) in near.items() for p, c in (("c", "code"), ("f", "freq"))})
    freq = lambda x: F.least(F.lit(7), F.floor(F.log2(x))).cast("int")
    decile = lambda x, n: F.least(F.lit(9), F.floor(F.col(x) * 10 / F.col(n))).cast("int")
    gap = lambda x: F.when(F.col(x).isNull(), 0).when(F.col(x) <= 1, 1).when(F.col(x) <= 4, 2).when(F.col(x) <= 16, 3).otherwise(4)
    shown = [F.coalesce(freq(F.col(f"f_{k}")), F.lit(8)).alias(f"{k}_frequency") for k in near] + [F.when(F.col(f"c_{k}").isNull(), 2).when(F.col(f"c_{k}") == F.col("code"), 1).otherwise(0).alias(f"{k}_same") for k in near]
    return f.select(
        "doc_id", "seq", freq(F.col("freq")).alias("frequency"), decile("code", "types").alias("rank"), decile("first_", "n").alias("first"), decile("last_", "n").alias("last"), F.least(F.lit(6), F.col("prior_")).cast("int").alias("prior"),
        F.least(F.lit(6), F.col("freq") - 1 - F.col("prior_")).cast("int").alias("future"), gap("gap").alias("previous_gap"), gap("ahead").alias("next_gap"), decile("seq", "n").alias("place"), *shown,
    )


@query("word_shapes", TOK + """, w AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1) SELECT least(length(word), 8)::INT AS length, substr(word, 1, 1) = right(word, 1) AS round, list_contains(list_transform(range(1, length(word)), lambda i: substr(word, i::INT, 1) = substr(word, i::INT + 1, 1)), true) AS double, len(list_distinct(string_split(word, ''))) < length(word) AS repeats, count(*) AS types, sum(n)::BIGINT AS tokens FROM w GROUP BY 1, 2, 3, 4""")
def _(t):
    """Shapes of words that no substitution of letters changes."""
    w = bare(t).groupBy("word").agg(F.count("*").alias("n"))
    s = W.ring_shape("word")
    return w.groupBy(s["length"].alias("length"), s["round"].alias("round"), s["double"].alias("double"), s["repeats"].alias("repeats")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


@query("half_split_bits", TOK + """, n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), c AS (SELECT seq >= n // 2 AS test, substr(word, 1, 1) AS a, right(word, 1) AS b, count(*)::DOUBLE AS c FROM tokens JOIN n USING (doc_id) GROUP BY 1, 2, 3), f AS (SELECT a, b, c FROM c WHERE NOT test), m AS (SELECT a, sum(c) AS m FROM f GROUP BY 1), v AS (SELECT count(DISTINCT b) AS v FROM f)
SELECT sum(t.c)::BIGINT AS n, round(-sum(t.c * log2((coalesce(f.c, 0) + 0.5) / (coalesce(m, 0) + 0.5 * v))) / sum(t.c), 6) + 0.0 AS bits FROM c t LEFT JOIN f ON f.a = t.a AND f.b = t.b LEFT JOIN m ON m.a = t.a, v WHERE t.test""")
def _(t):
    """Last letters given first ones: counted in the first halves of the documents, scored on the second."""
    d = flow(t).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    c = d.groupBy((F.col("seq") >= F.floor(F.col("n") / 2)).alias("test"), F.substring("word", 1, 1).alias("a"), F.right("word", F.lit(1)).alias("b")).agg(F.count("*").cast("double").alias("c"))
    f = c.where("not test").select("a", "b", F.col("c").alias("f"))
    m = f.groupBy("a").agg(F.sum("f").alias("m"))
    s = c.where("test").join(f, ["a", "b"], "left").join(m, "a", "left").join(F.broadcast(f.agg(F.count_distinct("b").alias("v"))))
    p = (F.coalesce("f", F.lit(0.0)) + 0.5) / (F.coalesce("m", F.lit(0.0)) + 0.5 * F.col("v"))
    return s.agg(F.sum("c").cast("long").alias("n"), r6(-F.sum(F.col("c") * F.log2(p)) / F.sum("c")).alias("bits"))


# Controls by exchange --------------------------------------------------------------------------------------------------


@query("block_symbol_permutation", TOK + """, l AS (SELECT lang, substr(word, 1, 1) AS g, substr(word, 2, 1) AS h, count(*) AS n FROM tokens WHERE lang IS NOT NULL AND length(word) > 1 GROUP BY 1, 2, 3), a AS (SELECT DISTINCT lang, g FROM (SELECT lang, g FROM l UNION SELECT lang, h FROM l)),
p AS (SELECT x.lang, x.g, y.g AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY g) AS r FROM a) x JOIN (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('sym|' || lang || '|' || g), g) AS r FROM a) y ON x.lang = y.lang AND x.r = y.r)
SELECT l.lang, sum(n)::BIGINT AS n, sum(n) FILTER (WHERE l.g = p.q)::BIGINT AS fixed, sum(n) FILTER (WHERE p.q = q.q)::BIGINT AS doubles, sum(n) FILTER (WHERE l.g = l.h)::BIGINT AS doubles_before FROM l JOIN p ON p.lang = l.lang AND p.g = l.g JOIN p q ON q.lang = l.lang AND q.g = l.h GROUP BY 1""")
def _(t):
    """A letter permutation of its own for each language: fixed letters, and doubles, which it must keep."""
    l = bare(t, "lang").where("lang is not null and length(word) > 1").groupBy("lang", F.substring("word", 1, 1).alias("g"), F.substring("word", 2, 1).alias("h")).agg(F.count("*").alias("n"))  # noqa: E741
    a = l.select("lang", F.explode(F.array("g", "h")).alias("g")).distinct()
    key = Window.partitionBy("lang")
    x = a.withColumn("r", F.row_number().over(key.orderBy("g")))  # alphabets
    y = a.withColumn("r", F.row_number().over(key.orderBy(W.stable_hash("sym", F.col("lang"), F.col("g")), "g"))).withColumnRenamed("g", "q")
    p = x.join(y, ["lang", "r"]).select("lang", "g", "q")
    j = l.join(F.broadcast(p), ["lang", "g"]).join(F.broadcast(p.select("lang", F.col("g").alias("h"), F.col("q").alias("q2"))), ["lang", "h"])
    n = lambda c: F.sum(F.when(c, F.col("n")))
    return j.groupBy("lang").agg(F.sum("n").alias("n"), n(F.col("g") == F.col("q")).alias("fixed"), n(F.col("q") == F.col("q2")).alias("doubles"), n(F.col("g") == F.col("h")).alias("doubles_before"))


@query("split_key", TOK + """, l AS (SELECT doc_id % 2 AS half, substr(word, 1, 1) AS g, count(*) AS n FROM tokens GROUP BY 1, 2), k AS (SELECT half, g, row_number() OVER (PARTITION BY half ORDER BY n DESC, g) AS r FROM l) SELECT count(*) AS letters, count(*) FILTER (WHERE a.r = b.r) AS same_rank, max(abs(a.r - b.r)) AS widest FROM k a JOIN k b ON a.g = b.g AND a.half = 0 AND b.half = 1""")
def _(t):
    """Keys by frequency of two halves of the documents, and where they agree."""
    l = bare(t).groupBy((F.col("doc_id") % 2).alias("half"), F.substring("word", 1, 1).alias("g")).agg(F.count("*").alias("n"))  # noqa: E741
    k = l.withColumn("r", F.row_number().over(Window.partitionBy("half").orderBy(F.col("n").desc(), "g")))  # alphabets
    j = k.where("half = 0").select("g", F.col("r").alias("a")).join(k.where("half = 1").select("g", F.col("r").alias("b")), "g")
    return j.agg(F.count("*").alias("letters"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same_rank"), F.max(F.abs(F.col("a") - F.col("b"))).cast("long").alias("widest"))


@query("donor_relabelling", TOK + """, c AS (SELECT source, substr(word, 1, 1) AS g, count(*)::DOUBLE AS c FROM tokens WHERE source IS NOT NULL GROUP BY 1, 2), n AS (SELECT source, sum(c) AS n, sqrt(sum(c * c)) AS l FROM c GROUP BY 1), d AS (SELECT a.source AS a, b.source AS b, sum(a.c * b.c) / (max(x.l) * max(y.l)) AS s FROM c a JOIN c b ON a.g = b.g JOIN n x ON x.source = a.source JOIN n y ON y.source = b.source GROUP BY 1, 2),
r AS (SELECT rep, source, row_number() OVER (PARTITION BY rep ORDER BY source) AS i, row_number() OVER (PARTITION BY rep ORDER BY md5('don|' || rep || '|' || source), source) AS j FROM n, range(5) x(rep)), p AS (SELECT u.rep, u.source AS a, v.source AS b FROM r u JOIN r v ON u.rep = v.rep AND u.i = v.j)
SELECT p.rep::INT AS rep, round(avg(s), 6) + 0.0 AS likeness, count(*) FILTER (WHERE p.a = p.b) AS own FROM p JOIN d ON d.a = p.a AND d.b = p.b GROUP BY 1""")
def _(t):
    """Sources given the letters of donors: mean likeness over a matrix that is made once, for relabellings by hash."""
    c = bare(t, "source").where("source is not null").groupBy("source", F.substring("word", 1, 1).alias("g")).agg(F.count("*").cast("double").alias("c"))
    n = c.groupBy("source").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l"))
    two = lambda df, k: df.select(*[F.col(x).alias(k if x == "source" else x if x == "g" else f"{x}_{k}") for x in df.columns])
    d = two(c, "a").join(two(c, "b"), "g").groupBy("a", "b").agg(F.sum(F.col("c_a") * F.col("c_b")).alias("s"))  # a row for each pair of sources
    d = d.join(F.broadcast(two(n, "a")), "a").join(F.broadcast(two(n, "b")), "b").withColumn("s", F.col("s") / (F.col("l_a") * F.col("l_b")))
    p = nulls.permute_within(n.select("source", F.col("source").alias("v")), "source", "v", [], 5, "don", "b").select("rep", F.col("source").alias("a"), "b")
    return p.join(d, ["a", "b"]).groupBy("rep").agg(r6(F.avg("s")).alias("likeness"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("own"))


@query("planted_payload", TOK + """, w AS (SELECT doc_id, seq, word FROM tokens WHERE word ~ '^[a-z]+$' AND seq < 40), s AS (SELECT doc_id, string_agg(substr(word, 1, 1), '' ORDER BY seq) AS s FROM w GROUP BY 1) SELECT doc_id, s AS payload, length(s) * 5 AS bits FROM s""")
def _(t):
    """Letters hidden as bits, five to a letter, and read back."""
    w = flow(t).where(F.col("word").rlike("^[a-z]+$") & (F.col("seq") < 40))
    s = w.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.substring("word", 1, 1).alias("g")))), lambda x: x["g"]), "").alias("s"))
    b = s.select("doc_id", F.posexplode(bits.encode_bits(F.col("s"))).alias("pos", "bit"))
    size = b.groupBy("doc_id").agg(F.count("*").alias("bits"))
    return bits.decode_chunks(b, ["doc_id"], "pos", "bit", 5).join(size, "doc_id").select("doc_id", F.col("decoded").alias("payload"), "bits")


@query("planted_phase_table", TOK + f""", v AS (SELECT line_no, pos, CASE WHEN {_u("'ph|' || doc_id || '|' || line_no || '|' || pos")} < 0.4 THEN substr('abcde', (pos % 5)::INT + 1, 1) ELSE substr(word, 1, 1) END AS y, substr(word, 1, 1) AS z, pos % 5 AS x FROM tokens),
e AS (SELECT 'planted' AS kind, x, y FROM v UNION ALL SELECT 'plain', x, z FROM v), c AS (SELECT kind, x, y, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2, 3), m AS (SELECT *, sum(c) OVER (PARTITION BY kind, x) AS a, sum(c) OVER (PARTITION BY kind, y) AS b, sum(c) OVER (PARTITION BY kind) AS n FROM c) SELECT kind, round(sum(c / n * log2(c * n / (a * b))), 6) + 0.0 AS mi FROM m GROUP BY 1""")
def _(t):
    """Initials set by a table of the place modulo five with odds of 0.4: what the phase then tells, and what it tells of the text as it is."""
    hit = W.uniform("ph", *[F.col(k).cast("string") for k in ("doc_id", "line_no", "pos")]) < 0.4
    v = lined(t).select((F.col("pos") % 5).alias("x"), F.substring("word", 1, 1).alias("z"), F.when(hit, F.substring(F.lit("abcde"), (F.col("pos") % 5 + 1).cast("int"), F.lit(1))).otherwise(F.substring("word", 1, 1)).alias("y"))
    e = v.select("x", F.explode(F.create_map(F.lit("planted"), F.col("y"), F.lit("plain"), F.col("z"))).alias("kind", "y"))
    return info.mutual_information(e, "x", "y", ["kind"]).select("kind", r6("mi").alias("mi"))


# Drawn lines and options -----------------------------------------------------------------------------------------------


@query("markov_lines", TOK + f""", b AS (SELECT least(pos, 3) AS p, lag(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS prev, word FROM tokens), n AS (SELECT p, coalesce(prev, '^') AS prev, word, count(*)::BIGINT AS n FROM b GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER w AS hi, sum(n) OVER w - n AS lo, sum(n) OVER (PARTITION BY p, prev) AS t FROM n WINDOW w AS (PARTITION BY p, prev ORDER BY word)),
g AS (WITH RECURSIVE g(i, j, cur) AS (SELECT i, -1, '^' FROM range(100) r(i) UNION ALL SELECT g.i, g.j + 1, c.word FROM g JOIN c ON c.p = least(g.j + 1, 3) AND c.prev = g.cur AND floor({_u("'ml|' || g.i || '|' || (g.j + 1)")} * t) >= lo AND floor({_u("'ml|' || g.i || '|' || (g.j + 1)")} * t) < hi WHERE g.j < 5) SELECT * FROM g) SELECT i, string_agg(cur, ' ' ORDER BY j) AS line FROM g WHERE j >= 0 GROUP BY 1""")
def _(t):
    """Lines of up to six words by the words that follow each other at that place; a word that nothing follows there ends its line.

    Each word of the 100 lines takes a pass over the texts, which counts what follows the lines' last words and nothing
    else; the lines are kept by the driver, so building the query runs jobs.
    """
    once, twice = bags.apart(t.documents, nulls=True)
    last = None
    if twice is not None:
        w = Window.partitionBy("doc_id", "line_no").orderBy("pos")
        last = tokens(twice, seq=False).select(F.least(F.col("pos"), F.lit(3)).alias("p"), F.coalesce(F.lag("word").over(w), F.lit("^")).alias("prev"), "word")
    lines = {i: [] for i in range(100)}
    going = dict.fromkeys(lines, "^")
    for j in range(6):
        if not going:
            break
        heads = sorted(set(going.values()))
        n = bags.followers(once, min(j, 3), 3, heads)
        if last is not None:
            n = n.unionByName(last.where((F.col("p") == min(j, 3)) & F.col("prev").isin(heads)).groupBy("prev", "word").agg(F.count("*").alias("n")))
        n = n.groupBy("prev", "word").agg(F.sum("n").alias("n")).persist()
        total = n.groupBy(F.col("prev").alias("prev_t")).agg(F.sum("n").alias("t"))
        held = sequence.offsets(n, ["prev"], "word", "n", F.substring("word", 1, 2), "lo").join(F.broadcast(total), F.col("prev") == F.col("prev_t"))  # 100 rows
        g = t.spark.createDataFrame(list(going.items()), "i long, at string")
        turn = F.floor(W.uniform("ml", F.col("i").cast("string"), F.lit(str(j))) * F.col("t"))
        drawn = held.join(F.broadcast(g), F.col("prev") == F.col("at")).where((turn >= F.col("lo")) & (turn < F.col("lo") + F.col("n"))).select("i", "word").collect()  # 100 rows
        n.unpersist()
        going = {r["i"]: r["word"] for r in drawn}
        for i, word in going.items():
            lines[i].append(word)
    return t.spark.createDataFrame([(i, " ".join(x)) for i, x in lines.items()], "i long, line string")


@query("option_grid", TOK + """, w AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1), o AS (SELECT a.x AS cut, b.x AS least, c.x AS fold FROM (SELECT unnest([0, 1, 2]) AS x) a, (SELECT unnest([1, 3, 5]) AS x) b, (SELECT unnest([false, true]) AS x) c), m AS (SELECT cut, least, fold, n, substr(CASE WHEN fold THEN translate(word, 'eiou', 'aaaa') ELSE word END, cut + 1) AS x FROM w, o WHERE length(word) >= least), c AS (SELECT cut, least, fold, x, sum(n)::DOUBLE AS c FROM m WHERE x <> '' GROUP BY 1, 2, 3, 4),
s AS (SELECT cut, least, fold, count(*) AS types, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY 1, 2, 3) SELECT cut, least, fold, types, round(h, 6) + 0.0 AS h, row_number() OVER (ORDER BY round(h, 6), cut, least, fold) AS place FROM s""")
def _(t):
    """Every combination of three options of reading a word, ranked by the entropy that is left; the options are a literal table, words are counted first."""
    w = bare(t).groupBy("word").agg(F.count("*").alias("n"))
    grid = t.spark.createDataFrame([(a, b, c) for a in (0, 1, 2) for b in (1, 3, 5) for c in (False, True)], "cut int, least int, fold boolean")
    m = w.join(F.broadcast(grid), F.length("word") >= F.col("least"))  # 18 rows
    x = F.expr("substring(case when fold then translate(word, 'eiou', 'aaaa') else word end, cut + 1)")
    c = m.select("cut", "least", "fold", "n", x.alias("x")).where("x <> ''").groupBy("cut", "least", "fold", "x").agg(F.sum("n").cast("double").alias("c"))
    s = c.groupBy("cut", "least", "fold").agg(F.count("*").alias("types"), r6(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    return s.withColumn("place", F.row_number().over(Window.orderBy("h", "cut", "least", "fold")).cast("long"))  # 18 rows


@query("target_map", """WITH m AS (SELECT unnest(['Brand#1', 'Brand#2', 'Brand#2', 'Brand#3']) AS canvas, unnest(['left', 'left', 'right', 'whole']) AS target, unnest([0, 0, 25, 0]) AS lo, unnest([50, 25, 50, 50]) AS hi) SELECT canvas, target, count(*) AS n, round(avg(p_retailprice), 4) + 0.0 AS price FROM part JOIN m ON p_brand = canvas AND p_size > lo AND p_size <= hi GROUP BY 1, 2""")
def _(t):
    """One canvas opened into several targets, each with its crop."""
    m = t.spark.createDataFrame([("Brand#1", [("left", 0, 50)]), ("Brand#2", [("left", 0, 25), ("right", 25, 50)]), ("Brand#3", [("whole", 0, 50)])], "canvas string, targets array<struct<target:string,lo:int,hi:int>>")
    p = t.part.join(F.broadcast(m), F.col("p_brand") == F.col("canvas")).select("canvas", "p_size", "p_retailprice", F.explode("targets").alias("x")).where("p_size > x.lo and p_size <= x.hi")  # three rows
    return p.groupBy("canvas", "x.target").agg(F.count("*").alias("n"), (F.round(F.avg("p_retailprice"), 4) + F.lit(0.0)).alias("price"))


# Rasters ---------------------------------------------------------------------------------------------------------------

_PIXELS = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE len(embedding) = 64), p AS (SELECT vec_id, i, greatest(0, least(255, floor((x + 0.3) * 400)))::BIGINT AS r FROM e),
c AS (SELECT a.vec_id, a.i, a.r, g.r AS g, b.r AS b, (a.r + g.r + b.r) / 3.0::DOUBLE AS bright FROM p a JOIN p g ON g.vec_id = a.vec_id AND g.i = (a.i + 1) % 64 JOIN p b ON b.vec_id = a.vec_id AND b.i = (a.i + 2) % 64), q AS (SELECT vec_id, median(bright) AS ground FROM c GROUP BY 1), k AS (SELECT c.*, ground, (bright < ground - 35)::INT AS ink, i % 8 AS x, i // 8 AS y FROM c JOIN q USING (vec_id))"""


def pictures(t):
    """Vectors of 64 components as rasters of 8 x 8 pixels."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.3) * 400))).cast("long")
    e = t.embeddings.where("size(embedding) = 64").select("vec_id", "label", F.lit(8).alias("width"), F.transform(F.col("embedding").cast("array<double>"), level).alias("r"))
    turn = lambda k: F.concat(F.slice("r", k + 1, 64 - k), F.slice("r", 1, k))
    return raster.ink_mask(e.withColumns({"g": turn(1), "b": turn(2)}))


@query("raster_shares", _PIXELS + """, s AS (SELECT vec_id, avg(ink) AS ink, avg((g > r + 12 AND g > b + 4 AND bright < ground - 5)::INT) AS green, avg((r > g + 18 AND r > b + 18)::INT) AS red, avg((b > r + 12 AND b > g + 6)::INT) AS blue, sum(ink) AS n FROM k GROUP BY 1),
d AS (SELECT a.vec_id, sum(abs(a.ink - coalesce(b.ink, a.ink))) + sum(abs(a.ink - coalesce(c.ink, a.ink))) AS e FROM k a LEFT JOIN k b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x + 1 LEFT JOIN k c ON c.vec_id = a.vec_id AND c.x = a.x AND c.y = a.y + 1 GROUP BY 1)
SELECT vec_id, round(ink, 6) + 0.0 AS ink, round(green, 6) + 0.0 AS green, round(red, 6) + 0.0 AS red, round(blue, 6) + 0.0 AS blue, round(e / greatest(1, n), 6) + 0.0 AS edge FROM s JOIN d USING (vec_id)""")
def _(t):
    """Shares of ink and pigments, and edges to a pixel of ink."""
    s = raster.page_shares(pictures(t))
    return s.select("vec_id", *[r6(c).alias(n) for c, n in (("ink_share", "ink"), ("green_share", "green"), ("red_share", "red"), ("blue_share", "blue"), ("edge_per_ink", "edge"))])


@query("raster_families", _PIXELS + """, a AS (SELECT vec_id, 'grid' AS family, ((y // 2) * 4 + x // 2)::INT AS i, avg(ink) AS v FROM k GROUP BY 1, 3 UNION ALL SELECT vec_id, 'rows', y::INT, avg(ink) FROM k GROUP BY 1, 3 UNION ALL SELECT vec_id, 'columns', x::INT, avg(ink) FROM k GROUP BY 1, 3) SELECT family, i, round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS most FROM a GROUP BY 1, 2""")
def _(t):
    """Families of raster vectors, put together and looked up by name: grid of densities, shares of lines and of columns."""
    m = raster.projections(raster.grid_density(pictures(t), 4))
    family = F.explode(F.create_map(F.lit("grid"), F.col("grid"), F.lit("rows"), F.col("row_share"), F.lit("columns"), F.col("column_share")))
    v = m.select(family.alias("family", "v")).select("family", F.posexplode("v").alias("i", "v"))
    return v.groupBy("family", "i").agg(r6(F.avg("v")).alias("mean"), r6(F.max("v")).alias("most"))


@query("raster_components")
def _(t):
    """Connected parts of ink by size; a flood fill has no plain SQL, tests/test_raster.py has the brute force."""
    c = raster.components(pictures(t), "vec_id", 2)
    return c.groupBy(F.least("area", F.lit(12)).alias("area")).agg(F.count("*").alias("n"))


@query("raster_labels", _PIXELS + """, s AS (SELECT vec_id, avg(ink) AS ink, avg((g > r + 12 AND g > b + 4 AND bright < ground - 5)::INT) AS green, avg((r > g + 18 AND r > b + 18)::INT) AS red, avg((b > r + 12 AND b > g + 6)::INT) AS blue FROM k GROUP BY 1) SELECT CASE WHEN ink < 0.02 THEN 'empty' WHEN green > 0.05 AND red > 0.005 THEN 'plant with roots' WHEN green > 0.05 THEN 'plant' ELSE 'other' END AS kind, count(*) AS n FROM s GROUP BY 1""")
def _(t):
    """Kinds of rasters by rules."""
    s = raster.page_shares(pictures(t))
    kind = W.page_label(*[F.col(c) for c in ("ink_share", "green_share", "red_share", "blue_share", "edge_per_ink")])
    return s.groupBy(F.when(kind.isin("empty", "plant with roots", "plant"), kind).otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


# Letter models, keys and samples ---------------------------------------------------------------------------------------

_PLACE = "CASE WHEN pos = 0 THEN 'first' WHEN pos = n_line - 1 THEN 'last' WHEN pos = 1 THEN 'second' WHEN pos = n_line - 2 THEN 'penult' ELSE 'interior' END"


@query("hierarchical_letter_bits", TOK + f""", w AS (SELECT doc_id % 4 = 0 AS test, lang, {_PLACE} AS place, word, count(*) AS k FROM tokens WHERE lang IS NOT NULL GROUP BY ALL), a AS (SELECT DISTINCT unnest(string_split(word, '')) AS g FROM w WHERE NOT test), v AS (SELECT count(*) + 2 AS v, list(g) AS a FROM a),
x AS (SELECT test, lang, place, k, array_to_string(list_transform(string_split(word, ''), lambda g: CASE WHEN list_contains(a, g) THEN g ELSE '?' END), '') AS x FROM w, v), e AS (SELECT test, lang, place, substr('^^' || x, i::INT, 2) AS h, substr(x || '$', i::INT, 1) AS s, sum(k)::DOUBLE AS c FROM (SELECT *, unnest(range(1, length(x) + 2)) AS i FROM x) GROUP BY ALL), f AS (SELECT * FROM e WHERE NOT test),
n0 AS (SELECT s, sum(c) AS c FROM f GROUP BY 1), n1 AS (SELECT right(h, 1) AS h, s, sum(c) AS c FROM f GROUP BY 1, 2), t1 AS (SELECT h, sum(c) AS c FROM n1 GROUP BY 1), n2 AS (SELECT h, s, sum(c) AS c FROM f GROUP BY 1, 2), t2 AS (SELECT h, sum(c) AS c FROM n2 GROUP BY 1), tc AS (SELECT lang, place, h, sum(c) AS c FROM f GROUP BY 1, 2, 3),
p0 AS (SELECT e.*, (coalesce(n0.c, 0) + 0.1) / ((SELECT sum(c) FROM f) + 0.1 * v) AS p FROM e LEFT JOIN n0 ON n0.s = e.s, v WHERE e.test), p1 AS (SELECT p0.* REPLACE ((coalesce(n1.c, 0) + 24 * p) / (coalesce(t1.c, 0) + 24) AS p) FROM p0 LEFT JOIN n1 ON n1.h = right(p0.h, 1) AND n1.s = p0.s LEFT JOIN t1 ON t1.h = right(p0.h, 1)),
p2 AS (SELECT p1.* REPLACE ((coalesce(n2.c, 0) + 24 * p) / (coalesce(t2.c, 0) + 24) AS p) FROM p1 LEFT JOIN n2 ON n2.h = p1.h AND n2.s = p1.s LEFT JOIN t2 ON t2.h = p1.h), q AS (SELECT p2.*, (coalesce(f.c, 0) + 48 * p) / (coalesce(tc.c, 0) + 48) AS q FROM p2 LEFT JOIN f ON f.lang = p2.lang AND f.place = p2.place AND f.h = p2.h AND f.s = p2.s LEFT JOIN tc ON tc.lang = p2.lang AND tc.place = p2.place AND tc.h = p2.h)
SELECT lang, sum(c) FILTER (WHERE s = '$')::BIGINT AS words, round(-sum(c * log2(p)) / sum(c) FILTER (WHERE s = '$'), 6) + 0.0 AS bits, round(-sum(c * log2(q)) / sum(c) FILTER (WHERE s = '$'), 6) + 0.0 AS cell_bits FROM q GROUP BY 1""")
def _(t):
    """Bits of a held-out word by letters: order 0, one and two letters before, and the cell of language and place, each shrunk to the one before; unknown letters are one symbol."""
    w = lined(t, "lang").where("lang is not null").groupBy((F.col("doc_id") % 4 == 0).alias("test"), "lang", W.position5("pos", "n_line").alias("place"), "word").agg(F.count("*").alias("k"))
    a = w.where("not test").select(F.explode(F.split("word", "")).alias("g")).agg(F.collect_set("g").alias("a")).withColumn("v", F.size("a") + 2)
    known = F.array_join(F.transform(F.split("word", ""), lambda g: F.when(F.array_contains("a", g), g).otherwise("?")), "")
    x = w.join(F.broadcast(a.select("a"))).withColumn("x", known)  # one row: the alphabet
    pair = F.transform(F.sequence(F.lit(1), F.length("x") + 1), lambda i: F.struct(F.substring(F.concat(F.lit("^^"), "x"), i, F.lit(2)).alias("h"), F.substring(F.concat("x", F.lit("$")), i, F.lit(1)).alias("s")))
    e = x.select("test", "lang", "place", "k", F.explode(pair).alias("p")).groupBy("test", "lang", "place", "p.h", "p.s").agg(F.sum("k").cast("double").alias("c")).withColumn("h1", F.right("h", F.lit(1)))
    f, q = e.where("not test"), e.where("test")
    total = f.agg(F.sum("c").alias("total")).join(F.broadcast(a.select("v")))
    q = q.join(f.groupBy("s").agg(F.sum("c").alias("n0")), "s", "left").join(F.broadcast(total))
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    p = (zero("n0") + 0.1) / (F.col("total") + 0.1 * F.col("v"))
    for i, (context, mass) in enumerate(((["h1"], 24), (["h"], 24), (["lang", "place", "h"], 48)), 1):
        q = q.withColumn(f"p{i - 1}", p).join(f.groupBy(*context, "s").agg(F.sum("c").alias(f"n{i}")), [*context, "s"], "left").join(f.groupBy(*context).agg(F.sum("c").alias(f"t{i}")), context, "left")
        p = (zero(f"n{i}") + mass * F.col(f"p{i - 1}")) / (zero(f"t{i}") + mass)
    q = q.withColumn("p3", p)
    words = F.sum(F.when(F.col("s") == "$", F.col("c")))
    bits = lambda k: r6(-F.sum(F.col("c") * F.log2(k)) / words)
    return q.groupBy("lang").agg(words.cast("long").alias("words"), bits("p2").alias("bits"), bits("p3").alias("cell_bits"))


@query("key_votes", TOK + """, b AS (SELECT doc_id, seq // 50 AS win, substr(word, 1, 1) AS s, right(word, 1) AS y FROM tokens), c AS (SELECT doc_id, win, s, y, count(*) AS n FROM b GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, win, s ORDER BY n DESC, y) AS k FROM c), v AS (SELECT s, y, count(*) AS votes FROM r WHERE k = 1 GROUP BY 1, 2), o AS (SELECT *, sum(votes) OVER (PARTITION BY s) AS windows, row_number() OVER (PARTITION BY s ORDER BY votes DESC, y) AS k FROM v)
SELECT s AS symbol, y AS letter, votes, windows::BIGINT AS windows FROM o WHERE k = 1""")
def _(t):
    """For each first letter the last letter that most windows of fifty words vote for."""
    c = flow(t).groupBy("doc_id", F.floor(F.col("seq") / 50).alias("win"), F.substring("word", 1, 1).alias("s"), F.right("word", F.lit(1)).alias("y")).agg(F.count("*").alias("n"))
    v = c.groupBy("doc_id", "win", "s").agg(F.min(F.struct((-F.col("n")).alias("n"), "y"))["y"].alias("y")).groupBy("s", "y").agg(F.count("*").alias("votes"))
    top = v.groupBy("s").agg(F.min(F.struct((-F.col("votes")).alias("v"), "y")).alias("m"), F.sum("votes").alias("windows"))
    return top.select(F.col("s").alias("symbol"), F.col("m.y").alias("letter"), (-F.col("m.v")).alias("votes"), "windows")


@query("rendered_samples", TOK + """, l AS (SELECT lang, g, sum(k) AS n FROM (SELECT lang, k, unnest(string_split(word, '')) AS g FROM (SELECT lang, word, count(*) AS k FROM tokens WHERE lang IS NOT NULL GROUP BY 1, 2)) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS r FROM l), e AS (SELECT g, r FROM r WHERE lang = (SELECT min(lang) FROM l)),
d AS (SELECT lang, min(doc_id) AS doc_id FROM tokens WHERE lang IS NOT NULL GROUP BY 1), w AS (SELECT d.lang, seq, i, substr(word, i::INT, 1) AS g FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM tokens WHERE seq < 12) t JOIN d ON d.doc_id = t.doc_id AND d.lang = t.lang), x AS (SELECT w.lang, seq, string_agg(coalesce(e.g, '?'), '' ORDER BY i) AS word FROM w JOIN r ON r.lang = w.lang AND r.g = w.g LEFT JOIN e ON e.r = r.r GROUP BY 1, 2)
SELECT lang, string_agg(word, ' ' ORDER BY seq) AS sample FROM x GROUP BY 1""")
def _(t):
    """The first words of each language's first document, read by the key that matches letter ranks to those of the first language."""
    c = bare(t, "lang").where("lang is not null").groupBy("lang", "word").agg(F.count("*").alias("k"))
    l = c.select("lang", "k", F.explode(F.split("word", "")).alias("g")).groupBy("lang", "g").agg(F.sum("k").alias("n"))  # noqa: E741  alphabets
    ranked = l.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "g"))), lambda x: x["g"]).alias("letters"))
    plain = ranked.agg(F.min_by("letters", "lang").alias("plain"))
    key = ranked.join(F.broadcast(plain))  # an alphabet for each language
    first = t.documents.where(F.col("lang").isNotNull() & F.lower("text").rlike("[a-zà-öø-ÿ]")).groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    words = flow(t, "lang").where("seq < 12").join(F.broadcast(first), ["lang", "doc_id"]).join(F.broadcast(key), "lang")
    read = F.array_join(F.transform(F.split("word", ""), lambda g: F.coalesce(F.get("plain", (F.array_position("letters", g) - 1).cast("int")), F.lit("?"))), "")
    return words.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", read.alias("w")))), lambda x: x["w"]), " ").alias("sample"))


@query("pair_transfer", TOK + """, d AS (SELECT doc_id, doc_id % 2 AS half, avg(length(word)) AS f_length, avg(CASE WHEN substr(word, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 1.0 ELSE 0.0 END) AS f_vowel, max(line_no) + 1.0 AS f_lines, count(*) AS g_words, count(DISTINCT word) / count(*)::DOUBLE AS g_types FROM tokens GROUP BY 1, 2),
c AS (SELECT half, unnest(['length', 'length', 'vowel', 'vowel', 'lines', 'lines']) AS f, unnest(['words', 'types', 'words', 'types', 'words', 'types']) AS g, unnest([corr(f_length, g_words), corr(f_length, g_types), corr(f_vowel, g_words), corr(f_vowel, g_types), corr(f_lines, g_words), corr(f_lines, g_types)]) AS r FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY round(abs(r), 9) DESC, f, g) AS k FROM c) SELECT a.half, a.f AS feature, a.g AS outcome, round(a.r, 5) + 0.0 AS chosen, round(b.r, 5) + 0.0 AS transferred FROM o a JOIN o b ON b.half = 1 - a.half AND a.f = b.f AND a.g = b.g WHERE a.k = 1""")
def _(t):
    """The pair of a feature and an outcome that goes together most in one half of the documents, and how it does in the other; both ways."""
    vowel = F.substring("word", 1, 1).isin(*"aeiou").cast("double")
    c = lined(t).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.max("line_no").alias("line"), F.sum(vowel).alias("vowel"))
    d = c.groupBy("doc_id").agg(
        (F.sum(F.col("n") * F.length("word")) / F.sum("n")).alias("length"), (F.sum("vowel") / F.sum("n")).alias("vowel"), (F.max("line") + 1.0).alias("lines"), F.sum("n").alias("words"), (F.count("*") / F.sum("n")).alias("types")
    )
    pairs = [(f, g) for f in ("length", "vowel", "lines") for g in ("words", "types")]
    r = d.groupBy((F.col("doc_id") % 2).alias("half")).agg(*[F.corr(f, g).alias(f"{f}_{g}") for f, g in pairs])
    o = r.select("half", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(g).alias("g"), F.col(f"{f}_{g}").alias("r")) for f, g in pairs])).alias("x")).select("half", "x.*")
    best = o.groupBy("half").agg(F.min(F.struct((-F.round(F.abs("r"), 9)).alias("k"), "f", "g", "r")).alias("b")).select("half", "b.f", "b.g", F.col("b.r").alias("chosen"))
    other = o.select((1 - F.col("half")).alias("half"), "f", "g", F.col("r").alias("transferred"))
    r5 = lambda x: F.round(x, 5) + F.lit(0.0)
    return best.join(other, ["half", "f", "g"]).select("half", F.col("f").alias("feature"), F.col("g").alias("outcome"), r5("chosen").alias("chosen"), r5("transferred").alias("transferred"))


@query("topic_words", TOK + f""", n AS (SELECT source AS topic, word, count(*)::BIGINT AS n FROM tokens WHERE source IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w / sum(n) OVER (PARTITION BY topic) AS hi, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY topic) AS lo FROM n WINDOW w AS (PARTITION BY topic ORDER BY word)), s AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT topic FROM n)),
d AS (SELECT i, i = 0 OR {_u("'sw|' || i")} < 0.05 AS new FROM range(500) r(i)), u AS (SELECT i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY i) AS run FROM d), v AS (SELECT i, run, topic FROM u JOIN s ON k = floor({_u("'tp|' || run")} * m)) SELECT v.i, v.run::BIGINT AS run, v.topic, c.word FROM v JOIN c ON c.topic = v.topic AND {_u("'tw|' || v.i")} >= c.lo AND {_u("'tw|' || v.i")} < c.hi""")
def _(t):
    """Words of topics (sources) that hold for a while: a topic ends with odds of one in twenty, the next one is drawn."""
    n = bare(t, "source").where("source is not null").groupBy(F.col("source").alias("topic"), "word").agg(F.count("*").alias("n"))
    table = generate.cumulative(n, ["topic"], "word")
    topics = n.select("topic").distinct().agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    i = F.col("i").cast("string")
    d = t.spark.range(500).select(F.col("id").alias("i"))
    run = F.sum(((F.col("i") == 0) | (W.uniform("sw", i) < 0.05)).cast("int")).over(Window.orderBy("i"))  # as many rows as are drawn
    v = d.withColumn("run", run).join(F.broadcast(topics)).withColumn("topic", F.get("topics", F.floor(W.uniform("tp", F.col("run").cast("string")) * F.size("topics")).cast("int"))).drop("topics")
    return generate.draw(v, table, ["topic"], "word", W.uniform("tw", i)).select("i", "run", "topic", "word")
