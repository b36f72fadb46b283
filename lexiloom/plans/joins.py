"""Queries: joins, nulls, inference, models, held-out scores, causal state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import info, models, nulls, pairs, sequence, state
from lexiloom.operators.info import r6
from lexiloom.operators.tokens import tokens
from lexiloom.plans.base import CTOK, TOK, WORD, query, slots_sql
from lexiloom.plans.lexical import bare, corpus, flow, lined, slots

_SLOTS = TOK + "," + slots_sql("tokens")


@query("semi_twin_words", TOK + ", v AS (SELECT DISTINCT word FROM tokens) SELECT v.word FROM v SEMI JOIN v t ON t.word = substr(v.word, 2) WHERE length(v.word) > 2")
def _(t):
    v = bare(t).select("word").distinct()
    return v.where(F.length("word") > 2).join(v.select(F.col("word").alias("twin")), F.expr("substring(word, 2)") == F.col("twin"), "left_semi")


@query("anti_label_vocab", TOK + ", o AS (SELECT DISTINCT word FROM tokens WHERE seq = 0) SELECT word FROM o WHERE word NOT IN (SELECT word FROM tokens WHERE seq > 0)")
def _(t):
    c = flow(t)
    return c.groupBy("word").agg(F.max("seq").alias("m"), F.min("seq").alias("k")).where("k = 0 and m = 0").select("word")


@query("register_membership", CTOK + """, v AS (SELECT word, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS a, count(*) AS n FROM ctok GROUP BY 1)
SELECT u, a, count(*) AS types, sum(n)::BIGINT AS tokens FROM v GROUP BY 1, 2""")
def _(t):
    c = tokens(t.conversations, "role", key="conv_id")
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    v = c.groupBy("word").agg(has("user").alias("u"), has("assistant").alias("a"), F.count("*").alias("n"))
    return v.groupBy("u", "a").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


@query("parallel_lines", _SLOTS + """, k AS (SELECT DISTINCT lang, source, doc_id, line_no, core FROM slots WHERE length(core) >= 3), d AS (SELECT lang, core FROM k GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 60), h AS (SELECT k.* FROM k JOIN d USING (lang, core))
SELECT a.doc_id AS left_doc, a.line_no AS left_line, b.doc_id AS right_doc, b.line_no AS right_line, count(*) AS shared FROM h a JOIN h b ON a.lang = b.lang AND a.core = b.core AND (a.doc_id, a.line_no) < (b.doc_id, b.line_no) AND a.source <> b.source GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""")
def _(t):
    s = slots(lined(t, "lang", "source").withColumn("row", F.struct("doc_id", F.col("line_no").cast("long").alias("line_no"))), "lang", "source", "row").where(F.length("core") >= 3)
    p = pairs.rare_key_pairs(s, "row", "core", ["lang"], "source", 60).where("shared >= 3")
    return p.select(F.col("left.doc_id").alias("left_doc"), F.col("left.line_no").alias("left_line"), F.col("right.doc_id").alias("right_doc"), F.col("right.line_no").alias("right_line"), "shared")


@query("prev_row_same_column", TOK + """, p AS (SELECT s.shift, a.word = b.word AS hit FROM tokens a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS shift) s JOIN tokens b ON a.doc_id = b.doc_id AND b.line_no = a.line_no - 1 AND b.pos = a.pos + s.shift)
SELECT shift, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS rate FROM p GROUP BY shift""")
def _(t):
    p = pairs.previous_row(lined(t).select("doc_id", "line_no", "pos", "word"), ["doc_id"], "line_no", "pos", "word")
    return p.groupBy("shift").agg(F.count("*").alias("n"), r6(F.avg((F.col("word") == F.col("before")).cast("double"))).alias("rate"))


# Letters that carry no ASCII equivalent of their own are folded, since levenshtein() counts bytes in the oracle.
_FOLD = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "aaaaaaeceeeeiiiidnoooooouuuuyty")


@query("nearest_source_edit", TOK + f", folded AS (SELECT * REPLACE (translate(word, '{_FOLD[0]}', '{_FOLD[1]}') AS word) FROM tokens)" + """, h AS (SELECT doc_id, line_no, pos, word, unnest(range(1, 9)) AS lag FROM folded), s AS (SELECT h.doc_id, h.line_no, h.pos, h.lag, levenshtein(h.word, b.word) AS d, levenshtein(h.word, b.word) / greatest(length(h.word), length(b.word))::DOUBLE AS ratio FROM h JOIN folded b ON b.doc_id = h.doc_id AND b.line_no = h.line_no AND b.pos = h.pos - h.lag),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, pos ORDER BY ratio, d, lag) AS k FROM s) SELECT lag::INT AS lag, d::INT AS distance, count(*) AS n FROM r WHERE k = 1 GROUP BY 1, 2""")
def _(t):
    s = pairs.nearest_source(lined(t).withColumn("word", F.translate("word", *_FOLD)), ["doc_id", "line_no"], "pos")
    return s.where("lag is not null").groupBy("lag", "distance").agg(F.count("*").alias("n"))


@query("opener_in_previous_line", _SLOTS + """, l AS (SELECT doc_id, line_no, min(core) FILTER (WHERE pos = 0) AS opener, list(DISTINCT core) AS cores FROM slots GROUP BY 1, 2), p AS (SELECT opener, lag(cores) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l)
SELECT count(*) AS lines, count(*) FILTER (WHERE list_contains(before, opener)) AS hits FROM p WHERE before IS NOT NULL""")
def _(t):
    s = slots(lined(t), "doc_id", "line_no", "pos")
    ls = s.groupBy("doc_id", "line_no").agg(F.min(F.when(F.col("pos") == 0, F.col("core"))).alias("opener"), F.collect_set("core").alias("cores"))
    p = ls.withColumn("before", F.lag("cores").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("before is not null")
    return p.agg(F.count("*").alias("lines"), F.count(F.when(F.array_contains("before", F.col("opener")), 1)).alias("hits"))


@query("group_enrichment_matrix", _SLOTS + """, m AS (SELECT DISTINCT lang, core FROM slots), n AS (SELECT lang, count(*) AS n FROM m GROUP BY 1), tot AS (SELECT count(DISTINCT core) AS k FROM m),
o AS (SELECT a.lang AS a, b.lang AS b, count(*) AS o FROM m a JOIN m b ON a.core = b.core AND a.lang < b.lang GROUP BY 1, 2)
SELECT a AS group_a, b AS group_b, o AS observed, round(x.n * y.n / k::DOUBLE, 6) + 0.0 AS expected, round(o / (x.n * y.n / k::DOUBLE), 6) + 0.0 AS ratio FROM o JOIN n x ON x.lang = a JOIN n y ON y.lang = b, tot""")
def _(t):
    out = pairs.group_enrichment(slots(bare(t, "lang"), "lang"), "lang", "core")
    return out.select("group_a", "group_b", "observed", r6("expected").alias("expected"), r6("ratio").alias("ratio"))


@query("train_vocabulary_map", TOK + """, v AS (SELECT DISTINCT word FROM tokens WHERE doc_id % 4 <> 0) SELECT coalesce(v.word, '<UNK>') AS mapped, count(*) AS n FROM tokens LEFT JOIN v USING (word) WHERE doc_id % 4 = 0 GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    c = bare(t)
    w = c.groupBy("word").agg(F.count(F.when(F.col("doc_id") % 4 != 0, 1)).alias("a"), F.count(F.when(F.col("doc_id") % 4 == 0, 1)).alias("b")).where("b > 0")
    return w.groupBy(F.when(F.col("a") > 0, F.col("word")).otherwise("<UNK>").alias("mapped")).agg(F.sum("b").alias("n")).where("n >= 5")


@query("tfidf_top_terms", TOK + """, c AS (SELECT doc_id, word, count(*) AS tf FROM tokens GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM c),
w AS (SELECT doc_id, word, round(tf * ln((n + 1) / (df + 1)::DOUBLE), 6) + 0.0 AS w FROM c JOIN d USING (word), n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, word) AS k FROM w) SELECT doc_id, word, w, k FROM r WHERE k <= 5""")
def _(t):
    """A document's words are counted once; the number of documents comes from the texts alone, and a document keeps its five best in a bounded heap."""
    c = bare(t).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    d = c.groupBy("word").agg(F.count("*").alias("df"))
    n = F.broadcast(t.documents.where(F.lower("text").rlike(WORD)).agg(F.count_distinct("doc_id").alias("n")))
    w = c.join(d, "word").join(n).select("doc_id", "word", r6(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("w"))
    return w.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("w").desc(), "word"))).where("k <= 5")


@query("cyclic_alignment", """WITH c AS (SELECT user_id, hour(ts) // 4 AS bin, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), m AS (SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY n DESC, event_type) AS k FROM c), u AS (SELECT DISTINCT user_id FROM events),
v AS (SELECT u.user_id, list(coalesce(m.event_type, '-') ORDER BY b.bin) AS r FROM u CROSS JOIN range(6) b(bin) LEFT JOIN m ON m.user_id = u.user_id AND m.bin = b.bin AND m.k = 1 GROUP BY 1),
o AS (SELECT *, lead(user_id) OVER (ORDER BY user_id) AS nxt FROM v), p AS (SELECT a.user_id AS a, b.user_id AS b, a.r AS x, b.r AS y, list_reverse(b.r) AS z FROM o a JOIN v b ON b.user_id = a.nxt),
s AS (SELECT a, b, o, list_sum(list_transform(range(6), lambda i: CASE WHEN x[i + 1] = y[(i + o) % 6 + 1] THEN 1 ELSE 0 END)) AS f, list_sum(list_transform(range(6), lambda i: CASE WHEN x[i + 1] = z[(i + o) % 6 + 1] THEN 1 ELSE 0 END)) AS g FROM p, range(6) q(o))
SELECT a AS user_a, b AS user_b, round(max(greatest(f, g)) / 6.0::DOUBLE, 6) + 0.0 AS score FROM s GROUP BY 1, 2""")
def _(t):
    """Rings of a user's commonest event in each sixth of the day, aligned with the next user's over all turns and both directions."""
    c = t.events.groupBy("user_id", F.floor(F.hour("ts") / 4).alias("bin"), "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id", "bin").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("m"))
    at = F.map_from_entries(F.collect_list(F.struct("bin", "m.event_type")))
    v = m.groupBy("user_id").agg(at.alias("at")).select("user_id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.coalesce(F.element_at("at", i.cast("long")), F.lit("-"))).alias("r"))
    ids = sequence.ranks(v.select("user_id"), [], F.floor(F.col("user_id") / 4096), ["user_id"], "k")
    nxt = ids.join(ids.select(F.col("user_id").alias("user_b"), (F.col("k") - 1).alias("k")), "k").select("user_id", "user_b")
    b = nxt.join(v.select(F.col("user_id").alias("user_b"), F.col("r").alias("s")), "user_b")
    score = pairs.best_alignment(F.col("r"), F.col("s"), lambda x, y: x == y)
    return v.join(b, "user_id").select(F.col("user_id").alias("user_a"), "user_b", r6(score).alias("score"))


# Nulls and inference ---------------------------------------------------------------------------------------------

_PERM = """WITH base AS (SELECT p_partkey, p_brand, p_size FROM part), reps AS (SELECT unnest(range(9)) AS rep),
s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS slot FROM base),
d AS (SELECT rep, p_brand, p_size, row_number() OVER (PARTITION BY rep, p_brand ORDER BY md5('perm|' || rep || '|' || p_partkey), p_partkey) AS slot FROM base, reps),
m AS (SELECT d.rep, s.p_brand, s.p_partkey, s.p_size AS v, d.p_size AS permuted FROM s JOIN d ON s.p_brand = d.p_brand AND s.slot = d.slot)"""


@query("within_stratum_permutation", _PERM + " SELECT rep::INT AS rep, p_brand, p_partkey, v AS p_size, permuted FROM m")
def _(t):
    return nulls.permute_within(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey", "p_size", ["p_brand"], 9, "perm").select("rep", "p_brand", "p_partkey", "p_size", "permuted")


@query("within_stratum_permutation_p", _PERM + """, o AS (SELECT avg(CASE WHEN (p_partkey % 50) = p_size THEN 1.0 ELSE 0.0 END) AS x FROM base), n AS (SELECT rep, avg(CASE WHEN (p_partkey % 50) = permuted THEN 1.0 ELSE 0.0 END) AS x FROM m GROUP BY 1)
SELECT round((1 + sum(CASE WHEN n.x >= o.x - 1e-12::DOUBLE THEN 1 ELSE 0 END)) / (1 + count(*))::DOUBLE, 6) + 0.0 AS p FROM n, o""")
def _(t):
    m = nulls.permute_within(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey", "p_size", ["p_brand"], 9, "perm")
    rate = lambda c: F.avg(((F.col("p_partkey") % 50) == F.col(c)).cast("double"))
    n = m.groupBy("rep").agg(rate("permuted").alias("x"), rate("p_size").alias("o"))
    return n.agg(r6(nulls.upper_p(F.col("o"), F.col("x"))).alias("p"))


@query("size_matched_subsample", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('sub|' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, source FROM r WHERE k <= 5")
def _(t):
    return nulls.subsample(t.documents.select("doc_id", "source"), "doc_id", ["source"], 5, "sub")


@query("sign_flip_exact", """WITH u AS (SELECT l_returnflag, l_linestatus, l_linenumber AS i, round(avg(l_quantity) - 25.5, 9) AS x FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(x) AS t, min(i) AS base FROM u GROUP BY 1, 2),
f AS (SELECT n.l_returnflag, n.l_linestatus, m, max(n.t) AS t, sum(CASE WHEN (m // CAST(power(2, u.i - n.base) AS BIGINT)) % 2 = 1 THEN -x ELSE x END) AS s FROM n JOIN u ON n.l_returnflag = u.l_returnflag AND n.l_linestatus = u.l_linestatus CROSS JOIN (SELECT unnest(range(128)) AS m) q WHERE m < CAST(power(2, n.n) AS BIGINT) GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, round(avg(CASE WHEN s >= t - 1e-9::DOUBLE THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p FROM f GROUP BY 1, 2""")
def _(t):
    """Exact one-sided test of the mean quantity against 25.5 over the seven line numbers of each group."""
    v = t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.round(F.avg("l_quantity") - 25.5, 9).alias("x"))
    v = v.groupBy("l_returnflag", "l_linestatus").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "x"))), lambda s: s["x"]).alias("xs"))
    return v.select("l_returnflag", "l_linestatus", r6(nulls.exact_sign_flip_p(F.col("xs"), eps=1e-9)).alias("p"))


@query("block_bootstrap_ci", TOK + """, b AS (SELECT source, sum(length(word))::DOUBLE AS s, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY source) - 1 AS i FROM tokens GROUP BY 1), k AS (SELECT count(*) AS m FROM b),
d AS (SELECT rep, draw, floor(('0x' || substr(md5('boot|' || rep || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE * m)::INT AS i FROM k, range(50) r(rep), range(m) q(draw)), e AS (SELECT rep, sum(s) / sum(n) AS x FROM d JOIN b USING (i) GROUP BY 1)
SELECT round(quantile_cont(x, 0.025), 6) + 0.0 AS low, round(avg(x), 6) + 0.0 AS mean, round(quantile_cont(x, 0.975), 6) + 0.0 AS high FROM e""")
def _(t):
    b = bare(t, "source").groupBy("source").agg(F.sum(F.length("word")).alias("s"), F.count("*").alias("n"))
    e = nulls.bootstrap(b, "source", 50, "boot").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("x"))
    return e.agg(r6(F.percentile("x", 0.025)).alias("low"), r6(F.avg("x")).alias("mean"), r6(F.percentile("x", 0.975)).alias("high"))


@query("cyclic_rotation_null", TOK + """, l AS (SELECT doc_id, line_no, pos, n_line FROM tokens) SELECT doc_id, line_no, rep::INT AS rep, pos, (pos + floor(('0x' || substr(md5('rot|' || rep || '|' || doc_id || '|' || line_no), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n_line)::BIGINT) % n_line AS rotated FROM l, range(3) r(rep)""")
def _(t):
    ring = lined(t).select("doc_id", "line_no", "pos", "n_line")
    return nulls.rotate(ring, ["doc_id", "line_no"], "pos", "n_line", 3, "rot").select("doc_id", "line_no", "rep", "pos", "rotated")


@query("max_stat_omnibus", _PERM + """, c AS (SELECT rep, p_brand, avg(CASE WHEN (p_partkey % 5) = permuted % 5 THEN 1.0 ELSE 0.0 END) AS x FROM m GROUP BY 1, 2) SELECT rep::INT AS rep, round(max(x), 6) + 0.0 AS top FROM c GROUP BY rep""")
def _(t):
    m = nulls.permute_within(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey", "p_size", ["p_brand"], 9, "perm")
    c = m.groupBy("rep", "p_brand").agg(F.avg(((F.col("p_partkey") % 5) == (F.col("permuted") % 5)).cast("double")).alias("x"))
    return nulls.max_stat(c, "rep", "x").select("rep", r6("top").alias("top"))


@query("layout_exchange_mi", TOK + """, e AS (SELECT doc_id, source, lang, seq, substr(word, 1, 1) AS g, least(pos, 5) AS p FROM tokens), s AS (SELECT *, row_number() OVER (PARTITION BY source, lang, p ORDER BY doc_id, seq) AS k FROM e),
d AS (SELECT source, lang, p, g, row_number() OVER (PARTITION BY source, lang, p ORDER BY md5('swap|' || doc_id || '|' || seq), doc_id, seq) AS k FROM e), m AS (SELECT s.p, d.g FROM s JOIN d USING (source, lang, p, k))
SELECT p, g, count(*) AS n FROM m GROUP BY 1, 2""")
def _(t):
    e = corpus(t, "source", "lang").select("doc_id", "source", "lang", "seq", F.substring("word", 1, 1).alias("g"), F.least(F.col("pos"), F.lit(5)).cast("long").alias("p"))
    stratum = ["source", "lang", "p"]
    h = e.withColumn("h", W.stable_hash("swap", F.col("doc_id").cast("string"), F.col("seq").cast("string")))
    r = sequence.ranks(e, stratum, F.floor(F.col("doc_id") / 1024), ["doc_id", "seq"], "k")
    d = sequence.ranks(h, stratum, F.substring("h", 1, 3), ["h", "doc_id", "seq"], "k")
    m = r.select(*stratum, "k").join(d.select(*stratum, "k", "g"), [*stratum, "k"])
    return m.groupBy("p", "g").agg(F.count("*").alias("n"))


# Models ------------------------------------------------------------------------------------------------------------


@query("transition_gain_leave_one_source_out", _SLOTS + """, e AS (SELECT source, least(pos, 4) AS cell, lag(prefix) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS x, prefix AS y FROM slots), c AS (SELECT source, cell, x, y, count(*)::DOUBLE AS c FROM e WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4),
v AS (SELECT count(DISTINCT y) AS v FROM c),
s AS (SELECT source, c, v, sum(c) OVER (PARTITION BY cell, x, y) - sum(c) OVER (PARTITION BY cell, x, y, source) AS xy, sum(c) OVER (PARTITION BY cell, x) - sum(c) OVER (PARTITION BY cell, x, source) AS x_, sum(c) OVER (PARTITION BY cell, y) - sum(c) OVER (PARTITION BY cell, y, source) AS y_, sum(c) OVER (PARTITION BY cell) - sum(c) OVER (PARTITION BY cell, source) AS t_ FROM c, v)
SELECT source, sum(c)::BIGINT AS n, round(sum(c * log2(((xy + 0.5::DOUBLE) / (x_ + 0.5::DOUBLE * v)) / ((y_ + 0.5::DOUBLE) / (t_ + 0.5::DOUBLE * v)))) / sum(c), 6) + 0.0 AS gain FROM s GROUP BY source""")
def _(t):
    e = slots(lined(t, "source"), "source", "doc_id", "line_no", "pos")
    e = e.select("source", F.least(F.col("pos"), F.lit(4)).alias("cell"), F.lag("prefix").over(Window.partitionBy("doc_id", "line_no").orderBy("pos")).alias("x"), F.col("prefix").alias("y")).where("x is not null")
    return models.leave_out_transition_gain(e, "source", "cell", "x", "y").select("source", "n", r6("gain").alias("gain"))


_NEST = ["", "cell", "cell, x", "cell, x, z"]


@query("nested_backoff_bits", _SLOTS + """, e AS (SELECT source, least(pos, 3) AS cell, lag(suffix) OVER w AS x, lag(prefix) OVER w AS z, prefix AS y FROM slots WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)), c AS (SELECT source, cell, x, z, y, count(*)::DOUBLE AS c FROM e WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4, 5), v AS (SELECT count(DISTINCT y)::DOUBLE AS v FROM c),
s AS (SELECT source, c, v, """ + ", ".join(f"sum(c) OVER (PARTITION BY {k + ', ' if k else ''}y) - sum(c) OVER (PARTITION BY {k + ', ' if k else ''}y, source) AS h{i}, sum(c) OVER (PARTITION BY {k or '1'}) - sum(c) OVER (PARTITION BY {k + ', ' if k else ''}source) AS t{i}" for i, k in enumerate(_NEST, 1)) + """ FROM c, v),
p1 AS (SELECT *, (h1 + 8 / v) / (t1 + 8) AS p1 FROM s), p2 AS (SELECT *, (h2 + 8 * p1) / (t2 + 8) AS p2 FROM p1), p3 AS (SELECT *, (h3 + 8 * p2) / (t3 + 8) AS p3 FROM p2), p4 AS (SELECT *, (h4 + 8 * p3) / (t4 + 8) AS p4 FROM p3)
SELECT source, sum(c)::BIGINT AS n, round(sum(c * log2(v)) / sum(c), 6) + 0.0 AS bits0, """ + ", ".join(f"round(-sum(c * log2(p{i})) / sum(c), 6) + 0.0 AS bits{i}" for i in range(1, 5)) + " FROM p4 GROUP BY source")
def _(t):
    w = Window.partitionBy("doc_id", "line_no").orderBy("pos")
    e = slots(lined(t, "source"), "source", "doc_id", "line_no", "pos")
    e = e.select("source", F.least(F.col("pos"), F.lit(3)).alias("cell"), F.lag("suffix").over(w).alias("x"), F.lag("prefix").over(w).alias("z"), F.col("prefix").alias("y")).where("x is not null")
    out = models.nested_backoff(e, "source", [[], ["cell"], ["cell", "x"], ["cell", "x", "z"]], "y")
    return out.select("source", "n", *[r6(f"bits{i}").alias(f"bits{i}") for i in range(5)])


@query("nb_leave_one_source_out", TOK + """, f AS (SELECT tokens.doc_id, quality AS y, source, substr(word, 1, 2) AS f FROM tokens JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c0 AS (SELECT doc_id, y, source, f, count(*) AS c FROM f GROUP BY 1, 2, 3, 4), d AS (SELECT f FROM c0 GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT c0.* FROM c0 JOIN d USING (f)),
k AS (SELECT unnest([0, 1]) AS k), v AS (SELECT count(*) AS v FROM d), per AS (SELECT source, y, f, sum(c) AS n FROM c GROUP BY 1, 2, 3), tot AS (SELECT f, y, sum(n) AS n FROM per GROUP BY 1, 2), ma AS (SELECT y, sum(n) AS n FROM per GROUP BY 1), mo AS (SELECT y, source, sum(n) AS n FROM per GROUP BY 1, 2),
s AS (SELECT c.doc_id, c.y, k, round(sum(c.c * ln((coalesce(tot.n, 0) - coalesce(per.n, 0) + 0.5::DOUBLE) / (coalesce(ma.n, 0) - coalesce(mo.n, 0) + 0.5::DOUBLE * v))), 6) AS s FROM c CROSS JOIN k CROSS JOIN v LEFT JOIN tot ON tot.f = c.f AND tot.y = k LEFT JOIN per ON per.f = c.f AND per.source = c.source AND per.y = k LEFT JOIN ma ON ma.y = k LEFT JOIN mo ON mo.y = k AND mo.source = c.source GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) AS i FROM s) SELECT doc_id, y AS quality, k AS predicted FROM r WHERE i = 1""")
def _(t):
    f = bare(t, "source").join(t.labels.where("quality is not null").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "source", F.substring("word", 1, 2).alias("f"))
    return models.naive_bayes_leave_out(f, "doc_id", "quality", "source", "f").select("doc_id", "quality", "predicted")


@query("classification_metrics", "WITH p AS (SELECT doc_id, quality AS y, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS z FROM labels WHERE quality IS NOT NULL), c AS (SELECT y, count(*) AS t, count(*) FILTER (WHERE y = z) AS h FROM p GROUP BY 1), d AS (SELECT z AS y, count(*) AS p FROM p GROUP BY 1), s AS (SELECT h / t::DOUBLE AS r, h / p::DOUBLE AS q, h, t FROM c JOIN d USING (y)) SELECT round(sum(h) / sum(t)::DOUBLE, 6) + 0.0 AS accuracy, round(avg(r), 6) + 0.0 AS balanced, round(avg(CASE WHEN r + q > 0 THEN 2 * r * q / (r + q) ELSE 0 END), 6) + 0.0 AS macro_f1 FROM s")
def _(t):
    p = t.labels.where("quality is not null").select(F.col("quality").alias("y"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("z"))
    return models.classification_metrics(p, "y", "z").select(*[r6(c).alias(c) for c in ("accuracy", "balanced", "macro_f1")])


@query("average_precision_by_source", "WITH r AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), h AS (SELECT *, sum(1 - quality) OVER (PARTITION BY source ORDER BY k) AS hits FROM r) SELECT source, round(avg(CASE WHEN quality = 0 THEN hits / k::DOUBLE END), 6) + 0.0 AS ap FROM h GROUP BY source")
def _(t):
    d = t.documents.select("doc_id", "source", "n_chars").join(t.labels.where("quality is not null"), "doc_id")
    return models.average_precision(d, ["source"], F.col("n_chars"), "doc_id", F.col("quality") == 0).select("source", r6("ap").alias("ap"))


@query("trigram_bits_by_source", TOK + """, w AS (SELECT lang, source, '^^' || word || '$' AS x, count(*) AS k FROM tokens WHERE source IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT lang, source, g, sum(k)::DOUBLE AS c FROM (SELECT lang, source, k, substr(x, i, 3) AS g FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM w)) GROUP BY 1, 2, 3),
h AS (SELECT lang, source, substr(g, 1, 2) AS h, sum(c) AS m FROM c GROUP BY 1, 2, 3), ca AS (SELECT lang, g, sum(c) AS c FROM c GROUP BY 1, 2), ha AS (SELECT lang, h, sum(m) AS m FROM h GROUP BY 1, 2), v AS (SELECT lang, count(DISTINCT right(g, 1)) AS v FROM ca GROUP BY 1)
SELECT c.lang, c.source, sum(c.c)::BIGINT AS n, round(-sum(c.c * log2((ca.c - c.c + 0.1::DOUBLE) / (ha.m - h.m + 0.1::DOUBLE * v))) / sum(c.c), 6) + 0.0 AS bits FROM c JOIN ca ON ca.lang = c.lang AND ca.g = c.g JOIN h ON h.lang = c.lang AND h.source = c.source AND h.h = substr(c.g, 1, 2) JOIN ha ON ha.lang = c.lang AND ha.h = h.h JOIN v ON v.lang = c.lang GROUP BY 1, 2""")
def _(t):
    """Letters of each source by the trigrams of its language in all other sources: the source's own counts are taken off."""
    w = bare(t, "source", "lang").where("source is not null").groupBy("lang", "source", "word").agg(F.count("*").alias("k"))
    g = w.select("lang", "source", "k", F.explode(W.ngrams(F.concat(F.lit("^^"), "word", F.lit("$")), 3)).alias("g"))
    c = g.groupBy("lang", "source", "g").agg(F.sum("k").cast("double").alias("c")).withColumn("h", F.substring("g", 1, 2))
    h = c.groupBy("lang", "source", "h").agg(F.sum("c").alias("m"))
    ca, ha = c.groupBy("lang", "g").agg(F.sum("c").alias("ca")), h.groupBy("lang", "h").agg(F.sum("m").alias("ma"))
    v = ca.groupBy("lang").agg(F.count_distinct(F.right("g", F.lit(1))).alias("v"))
    s = c.join(ca, ["lang", "g"]).join(h, ["lang", "source", "h"]).join(ha, ["lang", "h"]).join(F.broadcast(v), "lang")  # a row for each language
    p = (F.col("ca") - F.col("c") + 0.1) / (F.col("ma") - F.col("m") + 0.1 * F.col("v"))
    return s.groupBy("lang", "source").agg(F.sum("c").cast("long").alias("n"), r6(-F.sum(F.col("c") * F.log2(p)) / F.sum("c")).alias("bits"))


@query("ols_price_by_status", "SELECT o_orderstatus, round(regr_slope(o_totalprice, o_custkey), 4) + 0.0 AS slope, round(regr_r2(o_totalprice, o_custkey), 6) + 0.0 AS r2 FROM orders GROUP BY 1")
def _(t):
    return models.ols_1d(t.orders, ["o_orderstatus"], "o_custkey", "o_totalprice").select("o_orderstatus", (F.round("slope", 4) + F.lit(0.0)).alias("slope"), r6("r2").alias("r2"))


@query("centroid_leave_one_out", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, e.label, s.label AS y, round(sum(power(e.x - (s.s - CASE WHEN e.label = s.label THEN e.x ELSE 0 END) / (s.n - CASE WHEN e.label = s.label THEN 1 ELSE 0 END), 2)), 9) AS d FROM e JOIN s USING (i) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, y) AS k FROM d) SELECT vec_id, label, y AS predicted FROM r WHERE k = 1""")
def _(t):
    return models.nearest_centroid(t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")), "vec_id", "label", "x")


@query("knn_in_stratum", """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))), 9) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p)
SELECT a AS vec_id, b AS neighbour, k AS rank FROM r WHERE k <= 3""")
def _(t):
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "label", F.col("x").alias("y"))
    d = F.round(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z), 9)
    p = e.join(q, "label").where("vec_id <> q").withColumn("d", d)
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where("rank <= 3").select(F.col("q").alias("vec_id"), F.col("vec_id").alias("neighbour"), "rank")


# Causal state --------------------------------------------------------------------------------------------------------

_LETTERS = TOK + """, l AS (SELECT doc_id, line_no, seq, substr(word || '$', i, 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM tokens)), k AS (SELECT count(DISTINCT s) AS k FROM l)"""


def _letters(t):
    base = state.letter_rows(corpus(t), "doc_id", "line_no", "seq")
    k = base.select("symbol").distinct().agg((1 / F.count("*")).alias("base"))
    return base.join(F.broadcast(k))


def _cache_sql(unit: str, horizon: int | None = None) -> str:
    back = f"AND b.seq >= a.seq - {horizon}" if horizon else ""
    cut = lambda c, keys: f"""coalesce((SELECT sum(c) FROM {c} b WHERE {" AND ".join(f"b.{k} = a.{k}" for k in keys)} AND b.seq < a.seq {back}), 0)"""
    keys = [k.strip() for k in unit.split(",")]
    if horizon:
        hits, seen = cut("c", [*keys, "s"]), cut("n", keys)
    else:
        hits = f"sum(c) OVER (PARTITION BY {unit}, s ORDER BY seq ROWS UNBOUNDED PRECEDING) - c"
        seen = f"(SELECT m FROM t b WHERE {' AND '.join(f'b.{k} = a.{k}' for k in keys)} AND b.seq = a.seq)"
    cols = ", ".join(dict.fromkeys(["doc_id", *keys]))
    return _LETTERS + f""", c AS (SELECT {cols}, seq, s, count(*) AS c FROM l GROUP BY ALL), n AS (SELECT {cols}, seq, sum(c) AS c FROM c GROUP BY ALL),
t AS (SELECT *, sum(c) OVER (PARTITION BY {unit} ORDER BY seq ROWS UNBOUNDED PRECEDING) - c AS m FROM n),
p AS (SELECT doc_id, seq, c, ({hits} + 32.0::DOUBLE / k) / ({seen} + 32.0::DOUBLE) AS p FROM c a, k),
w AS (SELECT doc_id, seq, -sum(c * log2(p)) AS b FROM p GROUP BY 1, 2) SELECT doc_id, count(*) AS words, round(avg(b), 6) + 0.0 AS bits FROM w GROUP BY doc_id"""


def _cache(t, unit, horizon=None):
    scored = state.adaptive_cache(_letters(t), unit, "seq", "base", 32.0, horizon)
    return state.bits_per_word(scored, ["doc_id"], ["seq"]).select("doc_id", "words", r6("bits").alias("bits"))


query("adaptive_cache_bits", _cache_sql("doc_id"))(lambda t: _cache(t, ["doc_id"]))
query("rolling_cache_bits", _cache_sql("doc_id", 8))(lambda t: _cache(t, ["doc_id"], 8))
query("boundary_state_bits", _cache_sql("doc_id, line_no"))(lambda t: _cache(t, ["doc_id", "line_no"]))


@query("last_seen_clock", "WITH g AS (SELECT user_id, event_id, event_type, event_id - lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS gap FROM events) SELECT event_type, count(*) AS n, count(gap) AS repeats, min(gap) AS nearest FROM g GROUP BY 1")
def _(t):
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return t.events.withColumn("gap", gap).groupBy("event_type").agg(F.count("*").alias("n"), F.count("gap").alias("repeats"), F.min("gap").alias("nearest"))


@query("events_transition_mi", "WITH e AS (SELECT event_type AS y, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events), f AS (SELECT * FROM e WHERE x IS NOT NULL), j AS (SELECT x, y, count(*)::DOUBLE AS c FROM f GROUP BY 1, 2), n AS (SELECT sum(c) AS n, sum(c * log2(c)) AS s FROM j), a AS (SELECT sum(m * log2(m)) AS s FROM (SELECT sum(c) AS m FROM j GROUP BY x)), b AS (SELECT sum(m * log2(m)) AS s FROM (SELECT sum(c) AS m FROM j GROUP BY y)) SELECT round(log2(n) + (n.s - a.s - b.s) / n, 6) + 0.0 AS mi FROM n, a, b")
def _(t):
    e = t.events.select(F.col("event_type").alias("y"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("x")).where("x is not null")
    return info.mutual_information(e, "x", "y").select(r6("mi").alias("mi"))


@query("bacon_codec", TOK + """, b AS (SELECT doc_id, seq // 5 AS chunk, sum(CASE WHEN length(word) % 2 = 1 THEN power(2, 4 - seq % 5)::BIGINT ELSE 0 END) AS v, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE WHEN v < 26 THEN chr((97 + v)::INT) ELSE '?' END, '' ORDER BY chunk) AS decoded FROM b WHERE n = 5 GROUP BY doc_id""")
def _(t):
    from lexiloom.operators.bits import decode_chunks

    bits = flow(t).select("doc_id", "seq", (F.length("word") % 2).alias("bit"))
    return decode_chunks(bits, ["doc_id"], "seq", "bit", 5)
