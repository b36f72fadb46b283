"""Queries: shuffled controls, held-out selection and transfer, transplants, codecs, decodings, leaderboards, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import info, models, nulls, packed, programs, search, sequence, vectors
from lexiloom.operators.info import r6
from lexiloom.operators.tokens import runs
from lexiloom.plans.base import TOK, query, slots_sql
from lexiloom.plans.lexical import bare, flow, lined, slots

_SLOTS = TOK + "," + slots_sql("tokens")
#: Column x of the letters of words.
_LETTERS = "SELECT {k}, unnest(string_split(word, '')) AS g FROM tokens"


def _u(text: str) -> str:
    """SQL of the uniform number of a hash of the parts."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _letters(words, *by: str):
    """Letter counts c by `by`: words are counted before they are cut."""
    c = words.groupBy(*by, "word").agg(F.count("*").alias("n")).select(*by, "n", F.explode(F.split("word", "")).alias("g"))
    return c.groupBy(*by, "g").agg(F.sum("n").alias("c"))


@query("matched_attribute_rate", TOK + """, d AS (SELECT DISTINCT lang, source, word, doc_id FROM tokens), s AS (SELECT lang, word, source, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2, 3), w AS (SELECT lang, word, sum(n * (n - 1)) / 2 AS same, sum(n) * (sum(n) - 1) / 2 AS pairs FROM s GROUP BY 1, 2)
SELECT lang, sum(pairs) AS pairs, round(sum(same) / sum(pairs), 6) + 0.0 AS agree FROM w GROUP BY lang HAVING sum(pairs) > 0""")
def _(t):
    """Of all pairs of documents that share a word, the share with the same source; from counts, no pair is made."""
    d = bare(t, "lang", "source").select("lang", "source", "word", "doc_id").distinct()
    s = d.groupBy("lang", "word", "source").agg(F.count("*").cast("double").alias("n"))
    w = s.groupBy("lang", "word").agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("same"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("pairs"))
    return w.groupBy("lang").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same")).where("pairs > 0").select("lang", "pairs", r6(F.col("same") / F.col("pairs")).alias("agree"))


@query("donor_transplant_bits", TOK + """, c AS (SELECT lang, source, substr(word, 1, 1) AS g, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2, 3), n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2), v AS (SELECT lang, count(DISTINCT g) AS v FROM c GROUP BY 1),
p AS (SELECT a.lang, a.source AS donor, b.source AS target, a.n AS dn, b.n AS tn, v FROM n a JOIN n b ON a.lang = b.lang JOIN v ON v.lang = a.lang)
SELECT p.lang, donor, target, round(sum(-t.c * log2((coalesce(d.c, 0) * tn / dn + 0.5::DOUBLE) / (tn + 0.5::DOUBLE * v))) / max(tn), 6) + 0.0 AS bits FROM p JOIN c t ON t.lang = p.lang AND t.source = p.target LEFT JOIN c d ON d.lang = p.lang AND d.source = p.donor AND d.g = t.g GROUP BY 1, 2, 3""")
def _(t):
    """Initials of a source scored by the counts of each other source of its language, scaled to its size."""
    c = bare(t, "lang", "source").groupBy("lang", "source", F.substring("word", 1, 1).alias("g")).agg(F.count("*").cast("double").alias("c"))
    n = c.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    v = c.groupBy("lang").agg(F.count_distinct("g").alias("v"))
    # sources within a language: a dimension-sized pair table
    p = n.select("lang", F.col("source").alias("donor"), F.col("n").alias("dn")).join(n.select("lang", F.col("source").alias("target"), F.col("n").alias("tn")), "lang").join(v, "lang")
    s = p.join(c.withColumnRenamed("source", "target"), ["lang", "target"]).join(c.select("lang", F.col("source").alias("donor"), "g", F.col("c").alias("d")), ["lang", "donor", "g"], "left")
    q = (F.coalesce("d", F.lit(0.0)) * F.col("tn") / F.col("dn") + 0.5) / (F.col("tn") + 0.5 * F.col("v"))
    return s.groupBy("lang", "donor", "target").agg(r6(F.sum(-F.col("c") * F.log2(q)) / F.max("tn")).alias("bits"))


@query("symbol_recurrence", TOK + """, g AS (SELECT lang, word, doc_id, seq, seq - lag(seq) OVER (PARTITION BY doc_id, word ORDER BY seq) AS gap, lead(word) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM tokens), c AS (SELECT lang, word, nxt, count(*)::DOUBLE AS c FROM g WHERE nxt IS NOT NULL GROUP BY 1, 2, 3), h AS (SELECT lang, word, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, count(*) AS successors FROM c GROUP BY 1, 2)
SELECT lang, word, count(*) AS n, count(gap) AS gaps, round(avg(gap), 6) + 0.0 AS mean, round(stddev_pop(gap), 6) + 0.0 AS sigma, round(quantile_cont(gap, 0.5), 6) + 0.0 AS median, successors, round(h, 6) + 0.0 AS entropy FROM g JOIN h USING (lang, word) GROUP BY lang, word, successors, h HAVING count(*) >= 10 AND count(gap) > 0""")
def _(t):
    g = flow(t, "lang").select("lang", "word", "doc_id", "seq")
    g = g.withColumn("gap", F.col("seq") - F.lag("seq").over(Window.partitionBy("doc_id", "word").orderBy("seq"))).withColumn("nxt", F.lead("word").over(Window.partitionBy("doc_id").orderBy("seq")))
    c = g.where("nxt is not null")
    h = info.entropy(c, ["nxt"], ["lang", "word"]).join(c.groupBy("lang", "word").agg(F.count_distinct("nxt").alias("successors")), ["lang", "word"])
    s = g.groupBy("lang", "word").agg(F.count("*").alias("n"), F.count("gap").alias("gaps"), r6(F.avg("gap")).alias("mean"), r6(F.stddev_pop("gap")).alias("sigma"), r6(F.percentile("gap", 0.5)).alias("median")).where("n >= 10 and gaps > 0")
    return s.join(h, ["lang", "word"]).select("lang", "word", "n", "gaps", "mean", "sigma", "median", "successors", r6("h").alias("entropy"))


@query("stable_cells", TOK + """, c AS (SELECT source, substr(word, 1, 1) AS x, right(word, 1) AS y, count(*)::DOUBLE AS c FROM tokens WHERE source IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, sum(c) OVER (PARTITION BY source, x) AS cx, sum(c) OVER (PARTITION BY source, y) AS cy, sum(c) OVER (PARTITION BY source) AS n FROM c), k AS (SELECT x, y, c / n * log2(c * n / (cx * cy)) AS v FROM m)
SELECT x, y, count(*) AS sources, round(min(v), 6) + 0.0 AS least FROM k GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT source) FROM c) AND min(v) > 1e-5""")
def _(t):
    """Cells whose contribution to the mutual information of first and last letter is positive in every source."""
    c = bare(t, "source").where("source is not null").groupBy("source", F.substring("word", 1, 1).alias("x"), F.right("word", F.lit(1)).alias("y")).agg(F.count("*").cast("double").alias("c"))
    part = lambda *k: F.sum("c").over(Window.partitionBy(*k))
    m = c.withColumns({"cx": part("source", "x"), "cy": part("source", "y"), "n": part("source")})
    k = m.withColumn("v", F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))))
    total = c.agg(F.count_distinct("source").alias("all_"))
    return k.groupBy("x", "y").agg(F.count("*").alias("sources"), F.min("v").alias("v")).join(F.broadcast(total)).where("sources = all_ and v > 1e-5").select("x", "y", "sources", r6("v").alias("least"))


@query("letter_entropy_rollup", TOK + ", l AS (" + _LETTERS.format(k="lang, source") + """), c AS (SELECT lang, source, g, count(*) AS c FROM l GROUP BY 1, 2, 3), r AS (SELECT grouping(lang) AS gl, grouping(source) AS gs, lang, source, g, sum(c)::DOUBLE AS c FROM c GROUP BY GROUPING SETS ((g), (lang, g), (lang, source, g)))
SELECT CASE WHEN gl = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN gs = 1 THEN 'ALL' ELSE source END AS source, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS h FROM r GROUP BY gl, gs, r.lang, r.source""")
def _(t):
    c = _letters(bare(t, "lang", "source"), "lang", "source")
    r = c.groupingSets([["g"], ["lang", "g"], ["lang", "source", "g"]], "lang", "source", "g").agg(F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.sum("c").cast("double").alias("c"))
    h = r.groupBy("gl", "gs", "lang", "source").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    return h.select(F.when(F.col("gl") == 1, "ALL").otherwise(F.col("lang")).alias("lang"), F.when(F.col("gs") == 1, "ALL").otherwise(F.col("source")).alias("source"), r6("h").alias("h"))


@query("description_length", TOK + ", l AS (" + _LETTERS.format(k="lang") + """), c AS (SELECT lang, g, count(*)::DOUBLE AS c FROM l GROUP BY 1, 2), d AS (SELECT lang, sum(c) * log2(sum(c)) - sum(c * log2(c)) AS data, count(*) / 2.0::DOUBLE * log2(sum(c)) AS map, sum(c) * log2(count(*)) AS plain FROM c GROUP BY 1)
SELECT lang, round(data, 3) + 0.0 AS data, round(map, 3) + 0.0 AS map, round(plain, 3) + 0.0 AS plain, data + map < plain AS worth FROM d""")
def _(t):
    """Bits of the letters under their own table, the table's charge, and the bits without a table."""
    c = _letters(bare(t, "lang"), "lang").withColumn("c", F.col("c").cast("double"))
    n = F.sum("c")
    d = c.groupBy("lang").agg((n * F.log2(n) - F.sum(F.col("c") * F.log2("c"))).alias("data"), (F.count("*") / 2 * F.log2(n)).alias("map"), (n * F.log2(F.count("*").cast("double"))).alias("plain"))
    r3 = lambda x: F.round(x, 3) + F.lit(0.0)
    return d.select("lang", r3("data").alias("data"), r3("map").alias("map"), r3("plain").alias("plain"), (F.col("data") + F.col("map") < F.col("plain")).alias("worth"))


@query("decoded_letter_kl", TOK + ", l AS (" + _LETTERS.format(k="lang") + """ WHERE lang IN ('en', 'fr')), c AS (SELECT lang, g, count(*)::DOUBLE AS c FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) AS r, sum(c) OVER (PARTITION BY lang) AS n FROM c)
SELECT round(sum(a.c / a.n * log2(a.c / a.n / (b.c / b.n))), 6) + 0.0 AS kl, round(avg(CASE WHEN a.g = b.g THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS accuracy, round(sum(CASE WHEN a.g = b.g THEN a.c ELSE 0 END) / sum(a.c), 6) + 0.0 AS weighted FROM r a JOIN r b ON a.lang = 'fr' AND b.lang = 'en' AND a.r = b.r""")
def _(t):
    """Letters decoded by frequency rank: divergence from the target language, and accuracy of the key, plain and by weight."""
    c = _letters(bare(t, "lang").where("lang in ('en', 'fr')"), "lang").withColumn("c", F.col("c").cast("double"))
    w = Window.partitionBy("lang")
    r = c.withColumns({"r": F.row_number().over(w.orderBy(F.col("c").desc(), "g")), "p": F.col("c") / F.sum("c").over(w)})
    m = r.where("lang = 'fr'").select("r", F.col("g").alias("x"), F.col("c").alias("cx"), F.col("p").alias("px")).join(r.where("lang = 'en'").select("r", F.col("g").alias("y"), F.col("p").alias("py")), "r")
    same = F.col("x") == F.col("y")
    return m.agg(r6(F.sum(F.col("px") * F.log2(F.col("px") / F.col("py")))).alias("kl"), r6(F.avg(same.cast("double"))).alias("accuracy"), r6(F.sum(F.when(same, F.col("cx")).otherwise(0.0)) / F.sum("cx")).alias("weighted"))


@query("recurrence_features", TOK + """, f AS (SELECT doc_id, seq, word, seq - lag(seq) OVER w AS gap, row_number() OVER w AS nth, lead(seq) OVER w - seq AS ahead FROM tokens WINDOW w AS (PARTITION BY doc_id, word ORDER BY seq))
SELECT doc_id, seq, nth, gap, ahead, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER s AS known, lag(gap) OVER s AS gap_before, coalesce(lag(nth) OVER s = 1, false) AS after_new FROM f WINDOW s AS (PARTITION BY doc_id ORDER BY seq)""")
def _(t):
    w, s = Window.partitionBy("doc_id", "word").orderBy("seq"), Window.partitionBy("doc_id").orderBy("seq")
    f = flow(t).select("doc_id", "seq", "word").withColumns({"gap": F.col("seq") - F.lag("seq").over(w), "nth": F.row_number().over(w), "ahead": F.lead("seq").over(w) - F.col("seq")})
    return f.select("doc_id", "seq", "nth", "gap", "ahead", F.sum((F.col("nth") == 1).cast("int")).over(s).alias("known"), F.lag("gap").over(s).alias("gap_before"), F.coalesce(F.lag("nth").over(s) == 1, F.lit(False)).alias("after_new"))


@query("valid_runs", TOK + """, v AS (SELECT doc_id, line_no, pos, regexp_full_match(word, '[a-z]{3,}') AS ok FROM tokens), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS run FROM v), k AS (SELECT count(*) AS length FROM r WHERE ok GROUP BY doc_id, line_no, run) SELECT length, count(*) AS n FROM k GROUP BY 1""")
def _(t):
    v = lined(t).select("doc_id", "line_no", "pos", F.when(F.col("word").rlike("^[a-z]{3,}$"), F.col("word")).alias("word"))
    return runs(v, ["doc_id", "line_no"], "pos").groupBy("doc_id", "line_no", "run").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))


@query("inverse_programs", TOK + "SELECT doc_id, line_no, sum((length(word) % 23) * (pos + 1))::BIGINT AS x, sum((length(word) % 23) * (pos + 1))::BIGINT AS y FROM tokens GROUP BY 1, 2")
def _(t):
    """Lines run through a modular program and back; the sums must be those of the lines themselves."""
    v = lined(t).withColumn("x", W.numeric_feature("word", "length"))
    by, m = ["doc_id", "line_no"], 23
    v = v.select(*by, "pos", programs.affine("x", by, "pos", 2, 3, 1, m).alias("a"), programs.running("x", by, "pos", -1, m).alias("r"))
    g = v.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "r"))).alias("l"))
    total = lambda x: F.aggregate(F.transform(x, lambda y, i: y.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, y: s + y)
    return g.select(*by, total(programs.unaffine(F.col("l.a"), 2, 3, 1, m)).alias("x"), total(programs.unrun(F.col("l.r"), -1, m)).alias("y"))


@query("ring_gap", """WITH o AS (SELECT o_custkey AS k, round(o_totalprice * 100)::BIGINT AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), p AS (SELECT a.k, abs(a.x - b.x) AS near, abs(a.x - c.x) AS far FROM o a JOIN o b ON a.k = b.k AND b.i = (a.i + 1) % a.n JOIN o c ON a.k = c.k AND c.i = (a.i + a.n // 2) % a.n WHERE a.n >= 6)
SELECT k, count(*) AS n, sum(near)::BIGINT AS near, sum(far)::BIGINT AS far, sum(far - near)::BIGINT AS gap FROM p GROUP BY k""")
def _(t):
    """Orders of a customer on a ring: differences (in cents) to the next one and to the one across, summed."""
    o = t.orders.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "c")))["c"].alias("x")).where(F.size("x") >= 6)
    n = F.size("x")
    at = lambda d: F.aggregate(F.transform("x", lambda v, i: F.abs(v - F.element_at("x", F.pmod(i + d, n) + 1))), F.lit(0).cast("long"), lambda s, v: s + v)
    s = g.select(F.col("o_custkey").alias("k"), n.cast("long").alias("n"), at(F.lit(1)).alias("near"), at(F.floor(n / 2).cast("int")).alias("far"))
    return s.withColumn("gap", F.col("far") - F.col("near"))


@query("phase_offset_audit", TOK + """, m AS (SELECT lang, doc_id % 2 AS half, pos % 5 AS phase, avg(length(word)) AS x FROM tokens GROUP BY 1, 2, 3), b AS (SELECT lang, half, phase, row_number() OVER (PARTITION BY lang, half ORDER BY x DESC, phase) AS r FROM m) SELECT lang, max(CASE WHEN half = 0 THEN phase END)::INT AS even, max(CASE WHEN half = 1 THEN phase END)::INT AS odd, coalesce(max(CASE WHEN half = 0 THEN phase END) = max(CASE WHEN half = 1 THEN phase END), false) AS agree FROM b WHERE r = 1 GROUP BY 1""")
def _(t):
    m = lined(t, "lang").groupBy("lang", (F.col("doc_id") % 2).alias("half"), (F.col("pos") % 5).alias("phase")).agg(F.avg(F.length("word")).alias("x"))
    b = m.withColumn("r", F.row_number().over(Window.partitionBy("lang", "half").orderBy(F.col("x").desc(), "phase"))).where("r = 1")
    side = lambda h: F.max(F.when(F.col("half") == h, F.col("phase"))).cast("int")
    return b.groupBy("lang").agg(side(0).alias("even"), side(1).alias("odd")).withColumn("agree", F.coalesce(F.col("even") == F.col("odd"), F.lit(False)))


@query("operation_transition_mi", TOK + """, d AS (SELECT source, doc_id, line_no, pos, sign(length(word) - lag(length(word)) OVER (PARTITION BY doc_id, line_no ORDER BY pos)) AS op FROM tokens), p AS (SELECT source, op, lag(op) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS before FROM d), c AS (SELECT source, before, op, count(*)::DOUBLE AS c FROM p WHERE op IS NOT NULL AND before IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT *, sum(c) OVER (PARTITION BY source, before) AS a, sum(c) OVER (PARTITION BY source, op) AS b, sum(c) OVER (PARTITION BY source) AS n FROM c) SELECT source, round(sum(c / n * log2(c * n / (a * b))), 6) + 0.0 AS mi FROM m WHERE source IS NOT NULL GROUP BY 1""")
def _(t):
    """What the last step between words (shorter, same, longer) says about the next one."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("pos")
    d = lined(t, "source").where("source is not null").withColumn("op", F.signum(F.length("word") - F.lag(F.length("word")).over(w)))
    p = d.withColumn("before", F.lag("op").over(w)).where("op is not null and before is not null")
    return info.mutual_information(p, "before", "op", ["source"]).select("source", r6("mi").alias("mi"))


_FEATURES = {"length": "length(word) % 5", "initial": "ascii(word) % 5", "final": "ascii(right(word, 1)) % 5", "letters": "len(list_distinct(string_split(word, ''))) % 5"}


@query("best_feature_stream", TOK + ", f AS (" + " UNION ALL ".join(f"SELECT lang, '{k}' AS feature, {v} AS x FROM tokens" for k, v in _FEATURES.items()) + """), c AS (SELECT lang, feature, x, count(*)::DOUBLE AS c FROM f GROUP BY 1, 2, 3), h AS (SELECT lang, feature, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS h FROM c GROUP BY 1, 2)
SELECT lang, feature, h, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, feature) AS r FROM h) WHERE r <= 3""")
def _(t):
    """Leaderboard of number streams by entropy; ties by name."""
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    x = {"length": F.length("word") % 5, "initial": F.ascii("word") % 5, "final": F.ascii(F.right("word", F.lit(1))) % 5, "letters": F.size(F.array_distinct(F.split("word", ""))) % 5}
    f = c.select("lang", "n", F.explode(F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v)])).alias("feature", "x")).groupBy("lang", "feature", "x").agg(F.sum("n").cast("double").alias("c"))
    h = f.groupBy("lang", "feature").agg(r6(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "feature"))).where("place <= 3")


@query("quartile_contrast", """WITH m AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS m FROM customer GROUP BY 1), d AS (SELECT s, abs(c_acctbal - m) AS d, c_acctbal AS x FROM customer JOIN m ON s = c_mktsegment), q AS (SELECT s, quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.75) AS b FROM d GROUP BY 1)
SELECT d.s AS segment, round(avg(x) FILTER (WHERE d <= a), 4) + 0.0 AS nearest, round(avg(x) FILTER (WHERE d >= b), 4) + 0.0 AS farthest FROM d JOIN q ON d.s = q.s GROUP BY 1""")
def _(t):
    """Mean of the quarter nearest to a segment's mean, and of the farthest quarter."""
    c = t.customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("x"))
    d = c.join(F.broadcast(c.groupBy("segment").agg(F.avg("x").alias("m"))), "segment").withColumn("d", F.abs(F.col("x") - F.col("m")))
    q = d.groupBy("segment").agg(F.percentile("d", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    r4 = lambda x: F.round(x, 4) + F.lit(0.0)
    return d.join(F.broadcast(q), "segment").groupBy("segment").agg(r4(F.avg(F.when(F.col("d") <= F.col("q")[0], F.col("x")))).alias("nearest"), r4(F.avg(F.when(F.col("d") >= F.col("q")[1], F.col("x")))).alias("farthest"))


@query("counter_subtraction", TOK + """, c AS (SELECT source, word, count(*) AS n FROM tokens WHERE source IS NOT NULL GROUP BY 1, 2), r AS (SELECT source, sum(n) OVER (PARTITION BY word) - n AS rest, n FROM c) SELECT source, count(*) AS types, count(*) FILTER (WHERE rest = 0) AS own_types, sum(n) FILTER (WHERE rest = 0)::BIGINT AS own_tokens, sum(rest)::BIGINT AS rest_tokens FROM r GROUP BY 1""")
def _(t):
    """Counts of all sources less those of one: what remains of its words."""
    c = bare(t, "source").where("source is not null").groupBy("source", "word").agg(F.count("*").alias("n"))
    r = c.join(c.groupBy("word").agg(F.sum("n").alias("all_")), "word").withColumn("rest", F.col("all_") - F.col("n"))
    own = F.col("rest") == 0
    return r.groupBy("source").agg(F.count("*").alias("types"), F.count(F.when(own, 1)).alias("own_types"), F.sum(F.when(own, F.col("n"))).alias("own_tokens"), F.sum("rest").alias("rest_tokens"))


@query("shuffled_repeat_rate", TOK + """, h AS (SELECT lang, rep::INT AS rep, word, md5('mix|' || rep || '|' || doc_id || '|' || seq) AS h FROM tokens, range(3) r(rep)), a AS (SELECT lang, rep, word = lag(word) OVER (PARTITION BY lang, rep ORDER BY h) AS same FROM h) SELECT lang, rep, count(same) AS pairs, round(avg(CASE WHEN same THEN 1.0::DOUBLE WHEN NOT same THEN 0 END), 6) + 0.0 AS rate FROM a GROUP BY 1, 2""")
def _(t):
    """Rate of equal neighbours after a shuffle of all words of a language; words go to buckets of the hash in blocks, so that no task holds a language."""
    n = packed.shuffled_repeats(t.documents, "lang", 3, "mix")
    return n.select("lang", "rep", "pairs", r6(F.when(F.col("pairs") > 0, F.col("same") / F.col("pairs"))).alias("rate"))


@query("line_shuffle_gap", TOK + """, s AS (SELECT -1 AS rep, doc_id, line_no, pos, word FROM tokens UNION ALL SELECT rep, doc_id, line_no, row_number() OVER (PARTITION BY rep, doc_id, line_no ORDER BY md5('ln|' || rep || '|' || doc_id || '|' || line_no || '|' || pos)) - 1, word FROM tokens, range(2) r(rep)), p AS (SELECT rep, word, lag(word) OVER (PARTITION BY rep, doc_id, line_no ORDER BY pos) AS before FROM s), c AS (SELECT rep, before, word, count(*)::DOUBLE AS c FROM p WHERE before IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT rep, before, sum(c) AS g, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2)
SELECT rep::INT AS rep, round(sum(g * log2(g) - s) / sum(g), 6) + 0.0 AS h FROM g GROUP BY 1""")
def _(t):
    """Entropy of a word given the one before: the corpus (rep -1) and its lines shuffled."""
    return packed.line_shuffle_entropy(t.documents, 2, "ln").select("rep", r6("h").alias("h"))


@query("record_rematch", """WITH s AS (SELECT rep, p_brand, p_partkey, p_size, p_type, row_number() OVER (PARTITION BY rep, p_brand ORDER BY p_partkey) AS k, row_number() OVER (PARTITION BY rep, p_brand ORDER BY md5('rec|' || rep || '|' || p_partkey), p_partkey) AS j FROM part, range(3) r(rep)) SELECT a.rep::INT AS rep, a.p_brand, count(*) FILTER (WHERE a.p_type = b.p_type) AS same_type, sum(abs(a.p_size - b.p_size))::BIGINT AS moved FROM s a JOIN s b ON a.rep = b.rep AND a.p_brand = b.p_brand AND a.k = b.j GROUP BY 1, 2""")
def _(t):
    """Whole records (size and type together) dealt anew to the parts of a brand."""
    p = t.part.select("p_partkey", "p_brand", F.struct("p_size", "p_type").alias("r"))
    m = nulls.permute_within(p, "p_partkey", "r", ["p_brand"], 3, "rec", "q")
    return m.groupBy("rep", "p_brand").agg(F.count(F.when(F.col("r.p_type") == F.col("q.p_type"), 1)).alias("same_type"), F.sum(F.abs(F.col("r.p_size") - F.col("q.p_size"))).cast("long").alias("moved"))


@query("row_shuffle_similarity", TOK + """, l AS (SELECT doc_id, line_no, count(*) AS n FROM tokens GROUP BY 1, 2), s AS (SELECT -1 AS rep, doc_id, n, lpad(line_no::VARCHAR, 12, '0') AS k FROM l UNION ALL SELECT rep, doc_id, n, md5('row|' || rep || '|' || doc_id || '|' || line_no) FROM l, range(2) r(rep)), d AS (SELECT rep, abs(n - lag(n) OVER (PARTITION BY rep, doc_id ORDER BY k)) AS d FROM s) SELECT rep::INT AS rep, round(avg(d), 6) + 0.0 AS step FROM d GROUP BY 1""")
def _(t):
    """Mean step of the line length from line to line: as written (rep -1) and with the lines of a document shuffled."""
    l = lined(t).groupBy("doc_id", "line_no").agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("rep"))  # noqa: E741
    k = F.when(F.col("rep") < 0, F.lpad(F.col("line_no").cast("string"), 12, "0")).otherwise(W.stable_hash("row", *[F.col(c).cast("string") for c in ("rep", "doc_id", "line_no")]))
    d = l.withColumn("k", k).withColumn("d", F.abs(F.col("n") - F.lag("n").over(Window.partitionBy("rep", "doc_id").orderBy("k"))))
    return d.groupBy("rep").agg(r6(F.avg("d")).alias("step"))


@query("random_regrouping", """WITH s AS (SELECT rep, s_suppkey, s_nationkey AS g, s_acctbal AS x, row_number() OVER (PARTITION BY rep ORDER BY s_suppkey) AS k, row_number() OVER (PARTITION BY rep ORDER BY md5('grp|' || rep || '|' || s_suppkey), s_suppkey) AS j FROM supplier, range(5) r(rep)), m AS (SELECT a.rep, b.g, a.x FROM s a JOIN s b ON a.rep = b.rep AND a.k = b.j), v AS (SELECT rep, g, count(*) AS n, var_pop(x) AS v FROM m GROUP BY 1, 2) SELECT rep::INT AS rep, round(sum(n * v) / sum(n) / (SELECT var_pop(s_acctbal) FROM supplier), 6) + 0.0 AS ratio FROM v GROUP BY 1""")
def _(t):
    """Suppliers dealt to groups of the nations' sizes: share of the variance that stays within groups."""
    m = nulls.permute_within(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", [], 5, "grp", "g").join(t.supplier.select("s_suppkey", "s_acctbal"), "s_suppkey")
    v = m.groupBy("rep", "g").agg(F.count("*").alias("n"), F.var_pop("s_acctbal").alias("v"))
    total = t.supplier.agg(F.var_pop("s_acctbal").alias("t"))
    return v.groupBy("rep").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("w")).join(F.broadcast(total)).select("rep", r6(F.col("w") / F.col("t")).alias("ratio"))


@query("random_cuts", TOK + """, l AS (SELECT doc_id, line_no, count(*) AS n FROM tokens GROUP BY 1, 2), r AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY md5('cut|' || doc_id || '|' || line_no), line_no) AS r FROM l WHERE line_no > 0) SELECT doc_id, array_to_string(list(line_no ORDER BY line_no), ' ') AS cuts FROM r WHERE r <= 3 GROUP BY 1""")
def _(t):
    """Three line breaks of each document drawn as section limits."""
    l = lined(t).where("line_no > 0").select("doc_id", "line_no").distinct()  # noqa: E741
    cut = nulls.subsample(l.withColumn("k", F.concat_ws("|", "doc_id", "line_no")), "k", ["doc_id"], 3, "cut")
    return cut.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("line_no")).cast("array<string>"), " ").alias("cuts"))


@query("random_phase_origin", TOK + f""", p AS (SELECT rep, substr(word, 1, 1) AS g, (pos + floor({_u("'org|' || rep || '|' || doc_id || '|' || line_no")} * 5)::BIGINT) % 5 AS phase FROM tokens, range(4) r(rep)), c AS (SELECT rep, phase, g, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2, 3), m AS (SELECT *, sum(c) OVER (PARTITION BY rep, phase) AS a, sum(c) OVER (PARTITION BY rep, g) AS b, sum(c) OVER (PARTITION BY rep) AS n FROM c) SELECT rep::INT AS rep, round(sum(c / n * log2(c * n / (a * b))), 6) + 0.0 AS mi FROM m GROUP BY 1""")
def _(t):
    """Initials against the place modulo five, the origin of each line drawn at random."""
    r = nulls.replicate(lined(t).select("doc_id", "line_no", "pos", F.substring("word", 1, 1).alias("g")), 4)
    start = F.floor(W.uniform("org", *[F.col(k).cast("string") for k in ("rep", "doc_id", "line_no")]) * 5)
    return info.mutual_information(r.withColumn("phase", (F.col("pos") + start) % 5), "phase", "g", ["rep"]).select("rep", r6("mi").alias("mi"))


@query("symbol_permutation", TOK + ", l AS (" + _LETTERS.format(k="doc_id % 2 AS half") + """), c AS (SELECT half, g, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT half, g, n, row_number() OVER (PARTITION BY half ORDER BY g) AS a, row_number() OVER (PARTITION BY half ORDER BY md5('key|' || half || '|' || g)) AS b FROM c) SELECT x.half, x.g AS plain, y.g AS cipher, x.n FROM k x JOIN k y ON x.half = y.half AND x.a = y.b""")
def _(t):
    """A random key of the alphabet for each half of the documents."""
    c = _letters(bare(t).withColumn("half", F.col("doc_id") % 2), "half").withColumnRenamed("c", "n")
    w = Window.partitionBy("half")
    k = c.withColumns({"a": F.row_number().over(w.orderBy("g")), "b": F.row_number().over(w.orderBy(W.stable_hash("key", F.col("half").cast("string"), F.col("g"))))})
    return k.select("half", F.col("g").alias("plain"), "n", "a").join(k.select("half", F.col("g").alias("cipher"), F.col("b").alias("a")), ["half", "a"]).select("half", "plain", "cipher", "n")


@query("partner_pages", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('pal|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL) SELECT a.doc_id, b.doc_id AS partner, j::INT AS j FROM r a, range(1, 9) t(j), r b WHERE a.n > 8 AND b.lang = a.lang AND b.r = (a.r - 1 + j) % a.n + 1""")
def _(t):
    """Eight partners of its language for each document: those that follow it in the order of the hash."""
    d = t.documents.where("lang is not null").select("doc_id", "lang")
    h = d.withColumn("h", W.stable_hash("pal", F.col("doc_id").cast("string")))
    r = sequence.ranks(h, ["lang"], F.substring("h", 1, 4), ["h", "doc_id"], "r").join(F.broadcast(d.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where("n > 8")
    want = r.select("doc_id", "lang", "n", "r", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j")).withColumn("r", (F.col("r") - 1 + F.col("j")) % F.col("n") + 1)
    return want.join(r.select("lang", "r", F.col("doc_id").alias("partner")), ["lang", "r"]).select("doc_id", "partner", "j")


_SEG = """WITH s AS (SELECT rep, c_mktsegment AS g, c_acctbal AS x FROM (SELECT -1 AS rep, c_mktsegment, c_acctbal FROM customer) UNION ALL SELECT a.rep, b.c_mktsegment, a.c_acctbal FROM k a JOIN k b ON a.rep = b.rep AND a.i = b.j), v AS (SELECT rep, g, avg(x) AS v FROM s GROUP BY 1, 2)"""
_SEG = """WITH k AS (SELECT rep, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY rep ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY rep ORDER BY md5('seg|' || rep || '|' || c_custkey), c_custkey) AS j FROM customer, range(19) r(rep)),""" + _SEG[4:]


def _segment_means(t):
    """Mean balance of each segment: observed (rep -1) and with the segments dealt anew 19 times."""
    m = nulls.permute_within(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", [], 19, "seg", "g").join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey")
    m = m.select("rep", "g", "c_acctbal").unionByName(t.customer.select(F.lit(-1).alias("rep"), F.col("c_mktsegment").alias("g"), "c_acctbal"))
    return m.groupBy("rep", "g").agg(F.round(F.avg("c_acctbal"), 6).alias("v"))


@query("westfall_young_p", _SEG + """, w AS (SELECT rep, g, round(v, 6) AS v FROM v), p AS (SELECT rep, count(*) OVER (PARTITION BY g ORDER BY v DESC RANGE UNBOUNDED PRECEDING) / (count(*) OVER (PARTITION BY g))::DOUBLE AS p FROM w), m AS (SELECT rep, min(p) AS min_p FROM p GROUP BY 1) SELECT round(min(min_p) FILTER (WHERE rep = -1), 6) + 0.0 AS min_p, round((SELECT count(*) FROM m a WHERE a.min_p <= (SELECT min_p FROM m WHERE rep = -1) + 1e-12) / count(*)::DOUBLE, 6) + 0.0 AS adjusted FROM m""")
def _(t):
    """Smallest p of any segment and its adjusted p among the smallest ones of the replicates."""
    m = nulls.westfall_young(_segment_means(t), ["g"], "rep", "v")
    seen = m.where("rep = -1").select(F.col("min_p").alias("seen"))
    return m.join(F.broadcast(seen)).agg(r6(F.min(F.when(F.col("rep") == -1, F.col("min_p")))).alias("min_p"), r6(F.avg((F.col("min_p") <= F.col("seen") + 1e-12).cast("double"))).alias("adjusted"))


@query("null_interval", _SEG + """ SELECT g, round(max(v) FILTER (WHERE rep = -1), 4) + 0.0 AS observed, round(quantile_cont(round(v, 6), 0.025) FILTER (WHERE rep >= 0), 4) + 0.0 AS low, round(quantile_cont(round(v, 6), 0.975) FILTER (WHERE rep >= 0), 4) + 0.0 AS high, round((max(v) FILTER (WHERE rep = -1) - avg(v) FILTER (WHERE rep >= 0)) / stddev_pop(v) FILTER (WHERE rep >= 0), 4) + 0.0 AS z FROM v GROUP BY 1""")
def _(t):
    """The observation against the middle 95 % of its nulls, and its distance in their deviations."""
    r4 = lambda x: F.round(x, 4) + F.lit(0.0)
    null, seen = F.when(F.col("rep") >= 0, F.col("v")), F.max(F.when(F.col("rep") == -1, F.col("v")))
    return _segment_means(t).groupBy("g").agg(r4(seen).alias("observed"), r4(F.percentile(null, 0.025)).alias("low"), r4(F.percentile(null, 0.975)).alias("high"), r4((seen - F.avg(null)) / F.stddev_pop(null)).alias("z"))


@query("log_odds_model", TOK + """, d AS (SELECT DISTINCT doc_id, lang, source, word FROM tokens WHERE source IS NOT NULL), n AS (SELECT lang, source, count(DISTINCT doc_id)::DOUBLE AS n FROM d GROUP BY 1, 2), c AS (SELECT lang, source, word, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2, 3), p AS (SELECT lang, word, sum(c) AS all_c FROM c GROUP BY 1, 2), q AS (SELECT lang, sum(n) AS all_n FROM n GROUP BY 1)
SELECT lang, source, word, round(log2((c + 5 * all_c / all_n) / (n + 5)) - log2((all_c + 0.5::DOUBLE) / (all_n + 1)), 6) + 0.0 AS score FROM c JOIN n USING (lang, source) JOIN p USING (lang, word) JOIN q USING (lang) WHERE c >= 5""")
def _(t):
    """Words of a source by log odds of their incidence, shrunk to that of the language by five pseudo-documents."""
    d = bare(t, "lang", "source").where("source is not null").select("doc_id", "lang", "source", "word").distinct()
    n = d.select("doc_id", "lang", "source").distinct().groupBy("lang", "source").agg(F.count("*").alias("n"))
    c = d.groupBy("lang", "source", "word").agg(F.count("*").alias("c"))
    p = c.groupBy("lang", "word").agg(F.sum("c").alias("all_c"))
    q = n.groupBy("lang").agg(F.sum("n").alias("all_n"))
    score = F.log2((F.col("c") + 5 * F.col("all_c") / F.col("all_n")) / (F.col("n") + 5)) - F.log2((F.col("all_c") + 0.5) / (F.col("all_n") + 1))
    return c.where("c >= 5").join(n, ["lang", "source"]).join(p, ["lang", "word"]).join(q, "lang").select("lang", "source", "word", r6(score).alias("score"))


@query("phase_multipliers", TOK + """, c AS (SELECT pos % 5 AS phase, substr(word, 1, 1) AS g, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2), m AS (SELECT *, sum(c) OVER (PARTITION BY phase) * sum(c) OVER (PARTITION BY g) / sum(c) OVER () AS e FROM c) SELECT phase::INT AS phase, g, round((c + 24) / (e + 24), 6) + 0.0 AS multiplier FROM m""")
def _(t):
    """Observed over expected initials at each phase, shrunk by 24 expected counts."""
    c = lined(t).groupBy((F.col("pos") % 5).cast("int").alias("phase"), F.substring("word", 1, 1).alias("g")).agg(F.count("*").cast("double").alias("c"))
    m = c.join(c.groupBy("phase").agg(F.sum("c").alias("a")), "phase").join(c.groupBy("g").agg(F.sum("c").alias("b")), "g").join(F.broadcast(c.agg(F.sum("c").alias("n"))))
    return m.select("phase", "g", r6((F.col("c") + 24) / (F.col("a") * F.col("b") / F.col("n") + 24)).alias("multiplier"))


@query("nested_selection", TOK + ", l AS (" + _LETTERS.format(k="lang, doc_id % 3 AS fold") + """), c AS (SELECT lang, g, sum(CASE WHEN fold = 0 THEN 1 ELSE 0 END)::DOUBLE AS f, sum(CASE WHEN fold = 1 THEN 1 ELSE 0 END)::DOUBLE AS v, sum(CASE WHEN fold = 2 THEN 1 ELSE 0 END)::DOUBLE AS s FROM l GROUP BY 1, 2), w AS (SELECT *, sum(f) OVER (PARTITION BY lang) AS n, count(*) OVER (PARTITION BY lang) AS k FROM c), a AS (SELECT lang, alpha, sum(-v * log2((f + alpha) / (n + alpha * k))) / sum(v) AS valid, sum(-s * log2((f + alpha) / (n + alpha * k))) / sum(s) AS test FROM w, (SELECT unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS alpha) GROUP BY 1, 2)
SELECT lang, alpha, round(test, 6) + 0.0 AS test FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(valid, 9), alpha) AS r FROM a) WHERE r = 1""")
def _(t):
    """Smoothing chosen by the second fold of documents alone, reported on the third."""
    c = _letters(bare(t, "lang").withColumn("fold", F.col("doc_id") % 3), "lang", "fold")
    c = c.groupBy("lang", "g").pivot("fold", [0, 1, 2]).agg(F.sum("c").cast("double")).na.fill(0.0).toDF("lang", "g", "f", "v", "s")
    w = Window.partitionBy("lang")
    a = c.withColumns({"n": F.sum("f").over(w), "k": F.count("*").over(w)}).select("*", F.explode(F.array(*map(F.lit, (0.1, 1.0, 10.0, 100.0)))).alias("alpha"))
    bits = -F.log2((F.col("f") + F.col("alpha")) / (F.col("n") + F.col("alpha") * F.col("k")))
    s = a.groupBy("lang", "alpha").agg((F.sum(F.col("v") * bits) / F.sum("v")).alias("valid"), (F.sum(F.col("s") * bits) / F.sum("s")).alias("test"))
    return s.withColumn("r", F.row_number().over(w.orderBy(F.round("valid", 9), "alpha"))).where("r = 1").select("lang", "alpha", r6("test").alias("test"))


@query("transfer_bits", TOK + ", l AS (" + _LETTERS.format(k="lang") + """), c AS (SELECT lang, g, count(*)::DOUBLE AS c FROM l WHERE lang IS NOT NULL GROUP BY 1, 2), n AS (SELECT lang, sum(c) AS n FROM c GROUP BY 1), v AS (SELECT count(DISTINCT g) AS v FROM c)
SELECT a.lang AS fitted, t.lang AS target, round(sum(-t.c * log2((coalesce(f.c, 0) + 0.5::DOUBLE) / (a.n + 0.5::DOUBLE * v))) / sum(t.c), 6) + 0.0 AS bits FROM n a JOIN c t ON true LEFT JOIN c f ON f.lang = a.lang AND f.g = t.g, v GROUP BY 1, 2""")
def _(t):
    """Letters of each language by the model of each language."""
    c = _letters(bare(t, "lang").where("lang is not null"), "lang").withColumn("c", F.col("c").cast("double"))
    n = c.groupBy("lang").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("m"))  # a row and an alphabet for each language
    v = c.agg(F.count_distinct("g").alias("v"))
    s = c.withColumnRenamed("lang", "target").crossJoin(F.broadcast(n.withColumnRenamed("lang", "fitted"))).crossJoin(F.broadcast(v))
    q = (F.coalesce(F.col("m")[F.col("g")], F.lit(0.0)) + 0.5) / (F.col("n") + 0.5 * F.col("v"))
    return s.groupBy("fitted", "target").agg(r6(F.sum(-F.col("c") * F.log2(q)) / F.sum("c")).alias("bits"))


@query("modular_counter", TOK + "SELECT doc_id, line_no, pos, (sum(length(word)) OVER (PARTITION BY doc_id, line_no ORDER BY pos) % 7)::INT AS counter FROM tokens")
def _(t):
    """A counter of letters modulo seven that starts anew on each line; `streaming.caches.modular_counter` is its twin."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("pos")
    return lined(t).select("doc_id", "line_no", "pos", (F.sum(F.length("word")).over(w) % 7).cast("int").alias("counter"))


@query("feature_bits", TOK + """, b AS (SELECT lang, unnest(['even', 'vowel_first', 'vowel_last', 'repeats']) AS feature, unnest([length(word) % 2 = 0, substr(word, 1, 1) IN ('a','e','i','o','u'), right(word, 1) IN ('a','e','i','o','u'), len(list_distinct(string_split(word, ''))) < length(word)]) AS bit FROM tokens) SELECT lang, feature, count(*) AS n, count(*) FILTER (WHERE bit) AS ones FROM b GROUP BY 1, 2""")
def _(t):
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    vowel = lambda x: x.isin(*"aeiou")
    bits = {"even": F.length("word") % 2 == 0, "vowel_first": vowel(F.substring("word", 1, 1)), "vowel_last": vowel(F.right("word", F.lit(1))), "repeats": F.size(F.array_distinct(F.split("word", ""))) < F.length("word")}
    b = c.select("lang", "n", F.explode(F.create_map(*[y for k, v in bits.items() for y in (F.lit(k), v)])).alias("feature", "bit"))
    return b.groupBy("lang", "feature").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bit"), F.col("n")).otherwise(0)).alias("ones"))


@query("slot_streams", _SLOTS + """, s AS (SELECT lang, stream, x FROM (SELECT lang, unnest(['prefix', 'suffix', 'pair', 'mixed', 'mixed']) AS stream, unnest([prefix, suffix, prefix || '|' || suffix, prefix, suffix]) AS x FROM slots)), c AS (SELECT lang, stream, x, count(*)::DOUBLE AS c FROM s GROUP BY 1, 2, 3) SELECT lang, stream, sum(c)::BIGINT AS n, count(*) AS symbols, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS h FROM c GROUP BY 1, 2""")
def _(t):
    c = slots(bare(t, "lang"), "lang").groupBy("lang", "prefix", "suffix").agg(F.count("*").alias("n"))
    kinds = [("prefix", F.col("prefix")), ("suffix", F.col("suffix")), ("pair", F.concat("prefix", F.lit("|"), "suffix")), ("mixed", F.col("prefix")), ("mixed", F.col("suffix"))]
    s = c.select("lang", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("stream"), v.alias("x")) for k, v in kinds])).alias("s")).groupBy("lang", "s.stream", "s.x").agg(F.sum("n").cast("double").alias("c"))
    return s.groupBy("lang", "stream").agg(F.sum("c").cast("long").alias("n"), F.count("*").alias("symbols"), r6(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))


@query("vector_spread", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS j FROM embeddings), m AS (SELECT label, j, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT vec_id, e.label, sqrt(avg((x - m) ** 2)) AS d FROM e JOIN m ON e.label = m.label AND e.j = m.j GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(d), 6) + 0.0 AS spread, round(max(d), 6) + 0.0 AS widest FROM d GROUP BY 1""")
def _(t):
    """Root mean square distance of vectors from the mean of their label."""
    e = t.embeddings.where("embedding is not null and label is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = e.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "x")))["x"].alias("m"))
    square = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    d = e.join(F.broadcast(m), "label").select("label", F.sqrt(square / F.size("v")).alias("d"))  # a mean for each label
    return d.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("spread"), r6(F.max("d")).alias("widest"))


@query("kmeans_clusters")
def _(t):
    """Sizes of five clusters of the embeddings; Lloyd's rounds have no SQL form, tests/test_vectors.py has the brute force."""
    _, found = vectors.kmeans(t.embeddings, "vec_id", "embedding", 5)
    return found.groupBy("cluster").agg(F.count("*").alias("n"))


@query("principal_axes")
def _(t):
    """Shares of variance of the principal axes; an eigenvalue problem, compared with NumPy in the tests."""
    shares = vectors.variance_fractions(t.embeddings, "embedding")
    return t.spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(shares)], "axis int, share double")


@query("ridge_classifier")
def _(t):
    """Labels of the embeddings by ridge regression, fitted on even vec_id: rows and hits of both halves."""
    e = t.embeddings.where("embedding is not null")
    labels, weights = vectors.ridge_one_vs_rest(e.where("vec_id % 2 = 0"), "embedding", "label")
    hits = vectors.ridge_predict(e, "vec_id", "embedding", labels, weights).join(e.select("vec_id", "label"), "vec_id")
    return hits.groupBy((F.col("vec_id") % 2 == 1).alias("held_out")).agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("label")).cast("int")).alias("hits"))


@query("balanced_folds")
def _(t):
    """Sources dealt to four folds of about equal size, largest first; a greedy loop over one row for each source."""
    sizes = bare(t, "source").where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()
    folds = search.greedy_folds([(r["source"], r["n"]) for r in sizes], 4)
    return t.spark.createDataFrame([(r["source"], r["n"], folds[r["source"]]) for r in sizes], "source string, n long, fold int")


@query("mixture_bits")
def _(t):
    """Weights by expectation-maximisation of letter models of two neighbours in a line: by language, by initial, uniform."""
    p = bare(t, "lang").groupBy("lang", F.substring("word", 1, 1).alias("a"), F.right("word", F.lit(1)).alias("b")).agg(F.count("*").cast("double").alias("n"))
    w = Window
    share = lambda *k: F.sum("n").over(w.partitionBy(*k, "b")) / F.sum("n").over(w.partitionBy(*k))
    c = p.withColumns({"p_lang": share("lang"), "p_initial": share("a"), "p_flat": F.lit(1 / 64)})
    weights = models.mixture_weights(c, ["p_lang", "p_initial", "p_flat"], "n")
    return t.spark.createDataFrame([(k, round(x, 6)) for k, x in zip(("lang", "initial", "flat"), weights, strict=True)], "component string, weight double")
