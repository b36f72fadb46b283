"""Queries: section limits, shuffled and drawn controls, planted structure, inference over many tests, panels and held-out models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import bags, dealt, info, nulls, sequence
from lexiloom.operators.info import r6
from lexiloom.operators.tokens import tokens
import lexiloom.plans.sequences  # noqa: F401  (registers text_tiling)
from lexiloom.plans.base import CTOK, ORACLE, QUERIES, TOK, query, slots_sql
from lexiloom.plans.lexical import bare, flow, lined, slots


def _u(text: str) -> str:
    """SQL of the uniform number of a hash of the parts."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _dealt(name: str, table: str, key: str, value: str, strata: list[str], reps: int, seed: str) -> str:
    """A CTE (rep, strata, key, value, permuted): values of a stratum dealt anew by hash, as `nulls.permute_within` does."""
    by = ", ".join(["rep", *strata])
    same = " AND ".join(["a.rep = b.rep", "a.at_ = b.at_", *[f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in strata]])
    rows = lambda order: f"(SELECT rep, t.*, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS at_ FROM {table} t, range({reps}) r(rep))"
    drawn = f"md5('{seed}|' || rep || '|' || {key}), {key}"
    cols = ", ".join(f"a.{c}" for c in ["rep", *strata, key, value])
    return f"{name} AS (SELECT {cols}, b.{value} AS permuted FROM {rows(key)} a JOIN {rows(drawn)} b ON {same})"


# Section limits ----------------------------------------------------------------------------------------------------


@query("tiling_boundaries", f"""WITH curve AS ({ORACLE["text_tiling"]}),
d AS (SELECT doc_id, gap, max(coherence) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) + max(coherence) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - 2 * coherence AS depth FROM curve WINDOW w AS (PARTITION BY doc_id ORDER BY gap)),
t AS (SELECT *, avg(depth) OVER (PARTITION BY doc_id) + stddev_pop(depth) OVER (PARTITION BY doc_id) AS level, lag(depth) OVER w AS l, lead(depth) OVER w AS r FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY gap))
SELECT doc_id, gap, round(depth, 6) + 0.0 AS depth FROM t WHERE depth > level + 1e-9 AND depth >= l - 1e-9 AND depth >= r - 1e-9""")
def _(t):
    """Limits of sections: local maxima of the depth of the coherence curve."""
    curve = QUERIES["text_tiling"](t.spark, t.sf_dir)
    return sequence.depth_boundaries(curve, ["doc_id"], "gap", "coherence", 3).select("doc_id", "gap", r6("depth").alias("depth"))


# Shuffles and draws ------------------------------------------------------------------------------------------------

_PARTS = "p AS (SELECT p_partkey, p_brand, p_type, (p_size % 5)::VARCHAR AS p_size FROM part)"
_PAIRS = (("p_brand", "p_type"), ("p_brand", "p_size"), ("p_type", "p_size"))


def _mi(table: str, x: str, y: str) -> str:
    return f"""(SELECT rep, sum(c / n * log2(c * n / (a * b))) AS mi FROM (SELECT rep, c, sum(c) OVER (PARTITION BY rep, x) AS a, sum(c) OVER (PARTITION BY rep, y) AS b, sum(c) OVER (PARTITION BY rep) AS n
FROM (SELECT rep, {x} AS x, {y} AS y, count(*)::DOUBLE AS c FROM {table} GROUP BY 1, 2, 3)) GROUP BY rep)"""


@query("column_shuffle_mi", "WITH " + _PARTS + ", " + ", ".join(_dealt(f"s_{c}", "p", "p_partkey", c, [], 9, f"cols-{c}") for c in ("p_brand", "p_type", "p_size")) + """,
s AS (SELECT a.rep, a.permuted AS p_brand, b.permuted AS p_type, c.permuted AS p_size FROM s_p_brand a JOIN s_p_type b ON a.rep = b.rep AND a.p_partkey = b.p_partkey JOIN s_p_size c ON a.rep = c.rep AND a.p_partkey = c.p_partkey UNION ALL SELECT -1, p_brand, p_type, p_size FROM p),
m AS (SELECT rep, sum(mi) AS mi FROM (""" + " UNION ALL ".join(f"SELECT * FROM {_mi('s', x, y)}" for x, y in _PAIRS) + """) GROUP BY rep)
SELECT round(max(mi) FILTER (WHERE rep < 0), 6) + 0.0 AS observed, round(avg(mi) FILTER (WHERE rep >= 0), 6) + 0.0 AS null_mean, (1 + count(*) FILTER (WHERE rep >= 0 AND mi >= (SELECT mi FROM m WHERE rep < 0) - 1e-9)) / 10.0::DOUBLE AS p FROM m""")
def _(t):
    """Information shared by all pairs of three slots of a part, against slots that are dealt anew each on its own."""
    p = t.part.select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 5).cast("string").alias("p_size"))
    s = nulls.shuffle_columns(p, "p_partkey", ["p_brand", "p_type", "p_size"], [], 9, "cols").unionByName(p.select(F.lit(-1).alias("rep"), "*"))
    each = None
    for x, y in _PAIRS:
        one = info.mutual_information(s, x, y, ["rep"])
        each = one if each is None else each.unionByName(one)
    m = each.groupBy("rep").agg(F.sum("mi").alias("mi"))
    seen = m.where("rep < 0").select(F.col("mi").alias("seen"))
    m = m.where("rep >= 0").join(F.broadcast(seen))  # one row
    return m.agg(r6(F.first("seen")).alias("observed"), r6(F.avg("mi")).alias("null_mean"), ((1 + F.sum((F.col("mi") >= F.col("seen") - 1e-9).cast("int"))) / (1 + F.count("*"))).alias("p"))


_EVENTS = "WITH e AS (SELECT event_id, user_id, hour(ts) // 6 AS part, event_type FROM events), "
_REPEATS = "SELECT rep, user_id, {value} = lag({value}) OVER (PARTITION BY rep, user_id ORDER BY event_id) AS same, {value} AS kind FROM {table}"


def _events(t):
    return t.events.select("event_id", "user_id", F.floor(F.hour("ts") / 6).cast("long").alias("part"), "event_type")


def _repeats(rows, value: str):
    return rows.withColumn("same", F.col(value) == F.lag(value).over(Window.partitionBy("rep", "user_id").orderBy("event_id"))).withColumnRenamed(value, "kind")


@query("event_shuffle_within", _EVENTS + _dealt("s", "e", "event_id", "event_type", ["user_id", "part"], 4, "ev") + f""", a AS ({_REPEATS.format(value="permuted", table="s")} UNION ALL {_REPEATS.format(value="event_type", table="(SELECT -1 AS rep, * FROM e)")})
SELECT rep::INT AS rep, count(same) AS pairs, count(*) FILTER (WHERE same) AS repeats FROM a GROUP BY 1""")
def _(t):
    """Repeats of the event before: as it was (rep -1) and with the events of a user and quarter of the day dealt anew."""
    e = _events(t)
    s = nulls.permute_within(e, "event_id", "event_type", ["user_id", "part"], 4, "ev", "kind").select("rep", "user_id", "event_id", "kind")
    s = s.unionByName(e.select(F.lit(-1).alias("rep"), "user_id", "event_id", F.col("event_type").alias("kind")))
    return _repeats(s, "kind").groupBy("rep").agg(F.count("same").alias("pairs"), F.count(F.when(F.col("same"), 1)).alias("repeats"))


@query("bonferroni_min_p", _EVENTS + _dealt("s", "e", "event_id", "event_type", ["user_id", "part"], 9, "bf") + f""", a AS ({_REPEATS.format(value="permuted", table="s")} UNION ALL {_REPEATS.format(value="event_type", table="(SELECT -1 AS rep, * FROM e)")}),
c AS (SELECT rep, kind, count(*) FILTER (WHERE same) AS n FROM a GROUP BY 1, 2), p AS (SELECT o.kind, (1 + count(*) FILTER (WHERE c.n >= o.n)) / 10.0::DOUBLE AS p FROM c JOIN c o ON o.rep < 0 AND o.kind = c.kind WHERE c.rep >= 0 GROUP BY 1)
SELECT count(*) AS tests, min(p) AS min_p, least(1.0::DOUBLE, min(p) * count(*)) AS bonferroni FROM p""")
def _(t):
    """Do repeats of any kind of event exceed those of dealt events: the smallest p of the kinds, times their number. Events are shuffled once, to their users."""
    c = nulls.dealt_repeats(_events(t), "event_id", "event_type", "user_id", "part", 9, "bf").withColumnRenamed("event_type", "kind")
    seen = c.where("rep < 0").select("kind", F.col("n").alias("seen"))
    p = c.where("rep >= 0").join(F.broadcast(seen), "kind").groupBy("kind").agg(((1 + F.sum((F.col("n") >= F.col("seen")).cast("int"))) / (1 + F.count("*"))).alias("p"))  # a row for each kind
    return p.agg(F.count("*").alias("tests"), F.min("p").alias("min_p"), nulls.bonferroni(F.col("p")).alias("bonferroni"))


_RESIDUAL = TOK + """, f AS (SELECT g, count(*)::DOUBLE AS c FROM (SELECT unnest(string_split(word, '')) AS g FROM tokens) GROUP BY 1), n AS (SELECT sum(c) AS n FROM f),
v AS (SELECT word, sum(log2(n / c)) / (length(word) + 1) AS x FROM (SELECT word, unnest(string_split(word, '')) AS g FROM (SELECT DISTINCT word FROM tokens)) JOIN f USING (g), n GROUP BY word),
e AS (SELECT md5('tok|' || doc_id || '|' || seq) AS k, doc_id, line_no, pos, coalesce(source, '') AS source, least(pos, 5) AS place, least(length(word), 12) AS len, x FROM tokens JOIN v USING (word)),
m AS (SELECT place, len, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT k, doc_id, line_no, pos, source, place, len, x - m AS x FROM e JOIN m USING (place, len))"""


@query("stratified_residual_shuffle", _RESIDUAL + ", " + _dealt("s", "d", "k", "x", ["source", "place", "len"], 2, "res") + """,
a AS (SELECT -1 AS rep, doc_id, line_no, pos, x FROM d UNION ALL SELECT s.rep, d.doc_id, d.line_no, d.pos, s.permuted FROM s JOIN d ON s.k = d.k), p AS (SELECT rep, x, lag(x) OVER (PARTITION BY rep, doc_id, line_no ORDER BY pos) AS y FROM a)
SELECT rep::INT AS rep, count(y) AS pairs, round(corr(x, y), 5) + 0.0 AS r FROM p WHERE y IS NOT NULL GROUP BY 1""")
def _(t):
    """Lag-one correlation of the letters' surprise, less its mean for place and length; as it was (rep -1) and with residuals of a source, place and length dealt anew. Words meet in packed buckets of their stratum."""
    p = dealt.neighbours(t.documents.select("doc_id", "text", "source"), 2, "res")
    n, of = F.col("n"), lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    r = F.try_divide(of("x", "y", "xy"), F.sqrt(of("x", "x", "xx") * of("y", "y", "yy")))
    return p.select("rep", n.cast("long").alias("pairs"), (F.round(r, 5) + F.lit(0.0)).alias("r"))


@query("free_recombination", "WITH " + _PARTS + ", i AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS at_ FROM p), n AS (SELECT count(*) AS n FROM p), d AS (SELECT rep, at_ AS draw FROM i, range(3) r(rep)), s AS (SELECT d.rep, a.p_brand, b.p_type, c.p_size FROM d, n"
    + "".join(f" JOIN i {a} ON {a}.at_ = floor({_u(f"'free-{c}|' || d.rep || '|' || d.draw")} * n)::BIGINT" for a, c in (("a", "p_brand"), ("b", "p_type"), ("c", "p_size")))
    + " UNION ALL SELECT -1, p_brand, p_type, p_size FROM p), g AS (SELECT rep, count(*) AS c FROM s GROUP BY rep, p_brand, p_type, p_size) SELECT rep::INT AS rep, sum(c)::BIGINT AS n, count(*) FILTER (WHERE c = 1) AS single FROM g GROUP BY rep")
def _(t):
    """How many parts have slots that no other part has: as they are (rep -1) and with every slot drawn freely."""
    p = t.part.select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 5).cast("string").alias("p_size"))
    names = ["p_brand", "p_type", "p_size"]
    s = nulls.draw_columns(p, "p_partkey", names, F.floor(F.col("p_partkey") / 4096), 3, "free").select("rep", *names).unionByName(p.select(F.lit(-1).alias("rep"), *names))
    return s.groupBy("rep", *names).agg(F.count("*").alias("c")).groupBy("rep").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") == 1, 1)).alias("single"))


@query("random_routes", "WITH r AS (SELECT rep, s_nationkey, s_suppkey, row_number() OVER (PARTITION BY rep, s_nationkey ORDER BY md5('route|' || rep || '|' || s_suppkey), s_suppkey) AS i, count(*) OVER (PARTITION BY rep, s_nationkey) AS n FROM supplier, range(2) x(rep)) SELECT rep::INT AS rep, s_nationkey, s_suppkey, i AS step, n + 1 - i AS step_back FROM r")
def _(t):
    """A random route through the suppliers of each nation, and the same route walked back."""
    s = nulls.replicate(t.supplier.select("s_nationkey", "s_suppkey"), 2).withColumn("h", W.stable_hash("route", F.col("rep").cast("string"), F.col("s_suppkey").cast("string")))
    n = s.groupBy("rep", "s_nationkey").agg(F.count("*").alias("n"))
    r = sequence.ranks(s, ["rep", "s_nationkey"], F.substring("h", 1, 3), ["h", "s_suppkey"], "step")
    return r.join(n, ["rep", "s_nationkey"]).select("rep", "s_nationkey", "s_suppkey", F.col("step").cast("long").alias("step"), (F.col("n") + 1 - F.col("step")).cast("long").alias("step_back"))


@query("ordinal_shuffle_p", "WITH b AS (SELECT n_nationkey AS k, avg(c_acctbal) AS y FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), " + _dealt("s", "b", "k", "y", [], 49, "ord") + """,
o AS (SELECT corr(k, y) AS r FROM b), q AS (SELECT rep, corr(k, permuted) AS r FROM s GROUP BY rep) SELECT round(o.r, 6) + 0.0 AS r, (1 + count(*) FILTER (WHERE abs(q.r) >= abs(o.r) - 1e-9)) / 50.0::DOUBLE AS p FROM q, o GROUP BY o.r""")
def _(t):
    """Drift of a mean along few ordered things, against their order shuffled; a row for each nation."""
    b = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("y"))
    o = b.agg(F.corr("k", "y").alias("r"))
    q = nulls.permute_within(b, "k", "y", [], 49, "ord", "z").groupBy("rep").agg(F.corr("k", "z").alias("q"))
    return q.join(F.broadcast(o)).agg(r6(F.first("r")).alias("r"), ((1 + F.sum((F.abs("q") >= F.abs("r") - 1e-9).cast("int"))) / (1 + F.count("*"))).alias("p"))


@query("mantel_permutation", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
p AS (SELECT a.label * 1000 + b.label AS k, b.label - a.label AS d, sum(a.x * b.x) AS y FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label), """ + _dealt("s", "p", "k", "y", [], 49, "mantel") + """,
o AS (SELECT corr(d, y) AS r FROM p), q AS (SELECT s.rep, corr(d, permuted) AS r FROM s JOIN p USING (k) GROUP BY s.rep) SELECT round(o.r, 5) + 0.0 AS r, (1 + count(*) FILTER (WHERE abs(q.r) >= abs(o.r) - 1e-9)) / 50.0::DOUBLE AS p FROM q, o GROUP BY o.r""")
def _(t):
    """Distance of labels against likeness of their mean vectors, with the likenesses of the pairs dealt anew; a row for each pair of labels."""
    c = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    p = c.alias("a").join(c.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label"))).groupBy(F.col("a.label").alias("p"), F.col("b.label").alias("q")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("y"))
    p = p.select((F.col("p") * 1000 + F.col("q")).alias("k"), (F.col("q") - F.col("p")).alias("d"), "y")
    o = p.agg(F.corr("d", "y").alias("r"))
    q = nulls.permute_within(p, "k", "y", [], 49, "mantel", "z").join(p.select("k", "d"), "k").groupBy("rep").agg(F.corr("d", "z").alias("q"))
    return q.join(F.broadcast(o)).agg((F.round(F.first("r"), 5) + F.lit(0.0)).alias("r"), ((1 + F.sum((F.abs("q") >= F.abs("r") - 1e-9).cast("int"))) / (1 + F.count("*"))).alias("p"))


@query("paired_corpus_contrast", TOK + f""", b AS (SELECT source, avg(length(word)) FILTER (WHERE lang = 'en') - avg(length(word)) FILTER (WHERE lang <> 'en') AS d FROM tokens WHERE source IS NOT NULL GROUP BY 1), k AS (SELECT * FROM b WHERE d IS NOT NULL),
o AS (SELECT count(*) AS blocks, avg(d) AS m FROM k), q AS (SELECT rep, avg(CASE WHEN {_u("'pair|' || rep || '|' || source")} < 0.5 THEN d ELSE -d END) AS m FROM k, range(199) r(rep) GROUP BY rep)
SELECT blocks, round(o.m, 6) + 0.0 AS mean, (1 + count(*) FILTER (WHERE q.m >= o.m - 1e-9)) / 200.0::DOUBLE AS p FROM q, o GROUP BY blocks, o.m""")
def _(t):
    """Mean word length of English less that of other languages, paired by source, with random signs of the differences: any number of blocks."""
    english = F.col("lang") == "en"
    n = F.length("word")
    b = bare(t, "lang", "source").where("source is not null").groupBy("source").agg((F.avg(F.when(english, n)) - F.avg(F.when(~english, n))).alias("d")).where("d is not null")
    o = b.agg(F.count("*").alias("blocks"), F.avg("d").alias("mean"))
    q = nulls.signs(b, "source", 199, "pair").groupBy("rep").agg(F.avg(F.col("sign") * F.col("d")).alias("m"))
    return q.join(F.broadcast(o)).groupBy("blocks", "mean").agg(((1 + F.sum((F.col("m") >= F.col("mean") - 1e-9).cast("int"))) / (1 + F.count("*"))).alias("p")).withColumn("mean", r6("mean"))


# Planted structure -------------------------------------------------------------------------------------------------


@query("injected_copy", TOK + f""", c AS (SELECT doc_id, lang, line_no, pos, word, line_no - 1 = lag(line_no) OVER (PARTITION BY doc_id, pos ORDER BY line_no) AND {_u("'inj|' || doc_id || '|' || line_no || '|' || pos")} < 0.25 AS copied FROM tokens),
g AS (SELECT *, sum(CASE WHEN copied THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pos ORDER BY line_no) AS run FROM c), v AS (SELECT *, first_value(word) OVER (PARTITION BY doc_id, pos, run ORDER BY line_no) AS planted FROM g),
a AS (SELECT lang, copied, line_no - 1 = lag(line_no) OVER w AS near, word = lag(word) OVER w AS before, planted = lag(planted) OVER w AS after FROM v WINDOW w AS (PARTITION BY doc_id, pos ORDER BY line_no))
SELECT lang, count(*) AS cells, count(*) FILTER (WHERE copied) AS copied, count(*) FILTER (WHERE near AND before) AS same_before, count(*) FILTER (WHERE near AND after) AS same_after FROM a GROUP BY lang""")
def _(t):
    """A word copied from the same column of the line before with odds of a quarter, as copied itself; chains are islands, so nothing is sequential."""
    w = Window.partitionBy("doc_id", "pos").orderBy("line_no")
    near = F.coalesce(F.col("line_no") - 1 == F.lag("line_no").over(w), F.lit(False))
    c = lined(t, "lang").withColumn("near", near)
    c = c.withColumn("copied", F.col("near") & (W.uniform("inj", *[F.col(k).cast("string") for k in ("doc_id", "line_no", "pos")]) < 0.25))
    g = c.withColumn("run", F.sum((~F.col("copied")).cast("int")).over(w))
    v = g.withColumn("planted", F.first("word").over(Window.partitionBy("doc_id", "pos", "run").orderBy("line_no")))
    a = v.withColumns({"before": F.col("word") == F.lag("word").over(w), "after": F.col("planted") == F.lag("planted").over(w)})
    has = lambda x, n: F.count(F.when(x, 1)).alias(n)
    return a.groupBy("lang").agg(F.count("*").alias("cells"), has(F.col("copied"), "copied"), has(F.col("near") & F.col("before"), "same_before"), has(F.col("near") & F.col("after"), "same_after"))


@query("planted_attribute", TOK + f""", v AS (SELECT DISTINCT lang, word FROM tokens), a AS (SELECT lang, word, share, (ascii(word) % 2 = 0) AS truth, {_u("'plant|' || share || '|' || word")} < share / 100.0 AS kept FROM v, (SELECT unnest([75, 100]) AS share)),
b AS (SELECT lang, share, truth, truth = kept AS attribute FROM a) SELECT lang, share, count(*) AS types, count(*) FILTER (WHERE truth) AS class_a, count(*) FILTER (WHERE attribute) AS tagged, count(*) FILTER (WHERE truth = attribute) AS agree FROM b GROUP BY 1, 2""")
def _(t):
    """An attribute carried by the first letter's code, flipped by hash for a quarter of the words or for none."""
    v = bare(t, "lang").select("lang", "word").distinct().withColumn("share", F.explode(F.array(F.lit(75), F.lit(100))))
    kept = W.uniform("plant", F.col("share").cast("string"), F.col("word")) < F.col("share") / 100.0
    v = v.withColumn("truth", F.ascii("word") % 2 == 0).withColumn("attribute", F.col("truth") == kept)
    has = lambda x, n: F.count(F.when(x, 1)).alias(n)
    return v.groupBy("lang", "share").agg(F.count("*").alias("types"), has(F.col("truth"), "class_a"), has(F.col("attribute"), "tagged"), has(F.col("truth") == F.col("attribute"), "agree"))


@query("synthetic_targets", TOK + "," + slots_sql("tokens") + """, d AS (SELECT DISTINCT doc_id, core FROM slots WHERE core <> ''), r AS (SELECT doc_id, core, row_number() OVER (PARTITION BY doc_id ORDER BY md5('tgt|' || doc_id || '|' || core), core) AS r FROM d)
SELECT doc_id, string_agg(core, ' ' ORDER BY r) AS targets FROM r WHERE r <= 5 GROUP BY 1""")
def _(t):
    """Five cores of each document drawn by hash: a planted local signal of known size."""
    d = slots(bare(t), "doc_id").where("core <> ''").select("doc_id", "core").distinct()
    top = d.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(W.stable_hash("tgt", F.col("doc_id").cast("string"), F.col("core")).alias("h"), "core"))), 1, 5).alias("x"))
    return top.select("doc_id", F.array_join(F.col("x.core"), " ").alias("targets"))


# Panels and summaries ----------------------------------------------------------------------------------------------


@query("corpora_panel", TOK.rstrip() + ", " + CTOK.strip().removeprefix("WITH ") + """, bt AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS word FROM benchmark),
u AS (SELECT 'documents ' || lang AS dataset, word FROM tokens WHERE lang IS NOT NULL UNION ALL SELECT 'talk ' || role, word FROM ctok WHERE role IS NOT NULL UNION ALL SELECT 'benchmark', word FROM bt), c AS (SELECT dataset, word, count(*) AS n FROM u GROUP BY 1, 2)
SELECT dataset, sum(n)::BIGINT AS tokens, count(*) AS types, count(*) FILTER (WHERE n = 1) AS hapax, round(sum(n * length(word)) / sum(n), 6) + 0.0 AS mean_length FROM c GROUP BY 1""")
def _(t):
    """All corpora as one panel: documents by language, conversations by role, test items."""
    from lexiloom.operators.tokens import tokens

    words = lambda df, key, name: tokens(df, key=key, line=False, seq=False).select(name.alias("dataset"), "word")
    talk = t.conversations.where("role is not null").withColumn("dataset", F.concat(F.lit("talk "), "role"))
    u = bare(t, "lang").where("lang is not null").select(F.concat(F.lit("documents "), "lang").alias("dataset"), "word")
    u = u.unionByName(words(talk, "dataset", F.col("dataset"))).unionByName(words(t.benchmark, "item_id", F.lit("benchmark")))
    c = u.groupBy("dataset", "word").agg(F.count("*").alias("n"))
    return c.groupBy("dataset").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count(F.when(F.col("n") == 1, 1)).alias("hapax"), r6(F.sum(F.col("n") * F.length("word")) / F.sum("n")).alias("mean_length"))


@query("information_budget", TOK + """, w AS (SELECT lang, word, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2), h AS (SELECT lang, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM w GROUP BY 1), d AS (SELECT lang, doc_id, count(*)::DOUBLE AS n FROM tokens GROUP BY 1, 2),
s AS (SELECT lang, avg(n) AS m, stddev_pop(n) / avg(n) AS cv FROM d GROUP BY 1), a AS (SELECT log2(count(DISTINCT p_brand) * count(DISTINCT p_type) * count(DISTINCT p_size)) AS b FROM part)
SELECT s.lang, round(m, 6) + 0.0 AS mean_words, round(cv, 6) + 0.0 AS cv, round(h, 6) + 0.0 AS word_bits, round(m * h, 4) + 0.0 AS text_bits, round(b, 6) + 0.0 AS attribute_bits, round(m * h / b, 4) + 0.0 AS ratio FROM s JOIN h ON s.lang = h.lang, a""")
def _(t):
    """Bits of a mean text against the bits of all combinations of a part's attributes."""
    d = bare(t, "lang").where("lang is not null")
    c = d.groupBy("lang", "word").agg(F.count("*").cast("double").alias("c"))
    h = c.groupBy("lang").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    s = d.groupBy("lang", "doc_id").agg(F.count("*").cast("double").alias("n")).groupBy("lang").agg(F.avg("n").alias("m"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    a = t.part.agg(F.log2((F.count_distinct("p_brand") * F.count_distinct("p_type") * F.count_distinct("p_size")).cast("double")).alias("b"))
    r4 = lambda x: F.round(x, 4) + F.lit(0.0)
    bits = F.col("m") * F.col("h")
    return s.join(h, "lang").join(F.broadcast(a)).select("lang", r6("m").alias("mean_words"), r6("cv").alias("cv"), r6("h").alias("word_bits"), r4(bits).alias("text_bits"), r6("b").alias("attribute_bits"), r4(bits / F.col("b")).alias("ratio"))


@query("robust_scores", TOK + """, s AS (SELECT source, avg(length(word)) AS x FROM tokens WHERE source IS NOT NULL GROUP BY 1), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s, median(x) AS q FROM s), d AS (SELECT median(abs(x - q)) AS mad FROM s, m)
SELECT source, round((x - m) / (s + 1e-12), 6) + 0.0 AS z, round((x - q) / (1.4826 * mad + 1e-12), 6) + 0.0 AS robust FROM s, m, d""")
def _(t):
    """Mean word lengths of the sources on the scale of their deviation, and of their median deviation."""
    s = bare(t, "source").where("source is not null").groupBy("source").agg(F.avg(F.length("word")).alias("x"))
    m = s.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.percentile("x", F.lit(0.5)).alias("q"))
    d = s.join(F.broadcast(m)).agg(F.percentile(F.abs(F.col("x") - F.col("q")), F.lit(0.5)).alias("mad"))
    return s.join(F.broadcast(m)).join(F.broadcast(d)).select("source", r6((F.col("x") - F.col("m")) / (F.col("s") + 1e-12)).alias("z"), r6((F.col("x") - F.col("q")) / (1.4826 * F.col("mad") + 1e-12)).alias("robust"))


@query("pair_leaderboard", """WITH l AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_quantity) AS longest, sum(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, n, round(longest, 4) + 0.0 AS longest, round(weight, 2) + 0.0 AS weight FROM l ORDER BY n DESC, longest DESC, round(weight, 2) DESC, l_partkey, l_suppkey LIMIT 25""")
def _(t):
    """The 25 strongest pairs by several keys in turn; a bounded heap in each task."""
    l = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("longest"), F.sum("l_extendedprice").alias("weight"))  # noqa: E741
    l = l.select("l_partkey", "l_suppkey", "n", (F.round("longest", 4) + F.lit(0.0)).alias("longest"), (F.round("weight", 2) + F.lit(0.0)).alias("weight"))  # noqa: E741
    return l.orderBy(F.desc("n"), F.desc("longest"), F.desc("weight"), "l_partkey", "l_suppkey").limit(25)


@query("eligible_classes", """WITH d AS (SELECT quality * 2 + toxic AS label, documents.doc_id, source, lang, n_chars FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT label, count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM d WHERE n_chars >= 200 GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT source) >= 2""")
def _(t):
    """Classes with enough documents in enough sources, of documents that are long enough."""
    l = t.labels.where("quality is not null and toxic is not null").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))  # noqa: E741
    d = t.documents.where("n_chars >= 200").select("doc_id", "source", "lang").join(l, "doc_id")
    return d.groupBy("label").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs")).where("docs >= 5 and sources >= 2")


@query("verdicts", TOK + """, c AS (SELECT lang, word, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2), s AS (SELECT lang, sum(c) / count(*) AS reuse, count(*) FILTER (WHERE c = 1)::DOUBLE / count(*) AS hapax FROM c GROUP BY 1)
SELECT lang, CASE WHEN reuse < 1.5 THEN 'sparse' WHEN hapax > 0.5 THEN 'open vocabulary' ELSE 'closed vocabulary' END AS verdict FROM s""")
def _(t):
    """A verdict in words by thresholds of two measures."""
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").cast("double").alias("c"))
    s = c.groupBy("lang").agg((F.sum("c") / F.count("*")).alias("reuse"), (F.count(F.when(F.col("c") == 1, 1)) / F.count("*")).alias("hapax"))
    return s.select("lang", F.when(F.col("reuse") < 1.5, "sparse").when(F.col("hapax") > 0.5, "open vocabulary").otherwise("closed vocabulary").alias("verdict"))


@query("page_vectors", "SELECT label, count(*) AS pages, round(avg(n_chars), 6) + 0.0 AS mean_chars FROM documents JOIN embeddings ON vec_id = doc_id // 2 WHERE n_chars >= 300 AND lang IS NOT NULL GROUP BY 1")
def _(t):
    """Documents joined to the vector of a computed key, if they are long enough."""
    d = t.documents.where("n_chars >= 300 and lang is not null").select(F.floor(F.col("doc_id") / 2).alias("k"), "n_chars")
    return d.join(t.embeddings.select("vec_id", "label"), F.col("k") == F.col("vec_id")).groupBy("label").agg(F.count("*").alias("pages"), r6(F.avg("n_chars")).alias("mean_chars"))


@query("coarse_tags", """WITH v AS (SELECT unnest(['ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO']) AS tag, unnest(['plain', 'plain', 'size', 'size', 'size', 'other']) AS coarse)
SELECT coalesce(coarse, 'unknown') AS coarse, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 ELSE 2 END AS size_class, count(*) AS n FROM part LEFT JOIN v ON p_type = tag GROUP BY 1, 2""")
def _(t):
    """Tags mapped to a smaller vocabulary by a literal table, numbers to classes."""
    v = t.spark.createDataFrame([("ECONOMY", "plain"), ("STANDARD", "plain"), ("SMALL", "size"), ("MEDIUM", "size"), ("LARGE", "size"), ("PROMO", "other")], "tag string, coarse string")
    p = t.part.join(F.broadcast(v), F.col("p_type") == F.col("tag"), "left")  # six rows
    return p.groupBy(F.coalesce("coarse", F.lit("unknown")).alias("coarse"), F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 25, 1).otherwise(2).alias("size_class")).agg(F.count("*").alias("n"))


# Held-out models ---------------------------------------------------------------------------------------------------


@query("heldout_column_entropy", TOK + """, d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 2 = 0 AS test FROM (SELECT DISTINCT doc_id FROM tokens)), c AS (SELECT test, least(pos, 10) AS col, substr(word, 1, 1) AS x, count(*)::DOUBLE AS c FROM tokens JOIN d USING (doc_id) GROUP BY 1, 2, 3),
g AS (SELECT x, sum(c) AS c FROM c WHERE NOT test GROUP BY 1), n AS (SELECT sum(c) AS n, count(*) AS v FROM g), k AS (SELECT col, sum(c) AS m FROM c WHERE NOT test GROUP BY 1),
p AS (SELECT t.c, (coalesce(g.c, 0) + 0.5) / (n + 0.5 * (v + 1)) AS pg, CASE WHEN m IS NULL THEN NULL ELSE (coalesce(b.c, 0) + 0.5) / (m + 0.5 * (v + 1)) END AS pc FROM c t LEFT JOIN g ON g.x = t.x LEFT JOIN k ON k.col = t.col LEFT JOIN c b ON NOT b.test AND b.col = t.col AND b.x = t.x, n WHERE t.test)
SELECT round(-sum(c * log2(pg)) / sum(c), 6) + 0.0 AS h_global, round(-sum(c * log2(coalesce(pc, pg))) / sum(c), 6) + 0.0 AS h_column, round(sum(c * log2(coalesce(pc, pg) / pg)) / sum(c), 6) + 0.0 AS gain FROM p""")
def _(t):
    """Initials of every other document, predicted by the rest: by their own shares, and by those of their column."""
    ids = lined(t).select("doc_id").distinct()
    fold = sequence.ranks(ids, [], F.floor(F.col("doc_id") / 4096), ["doc_id"], "r").select("doc_id", ((F.col("r") - 1) % 2 == 0).alias("test"))
    c = lined(t).join(fold, "doc_id").groupBy("test", F.least(F.col("pos"), F.lit(10)).alias("col"), F.substring("word", 1, 1).alias("x")).agg(F.count("*").cast("double").alias("c"))
    train, test = c.where("not test"), c.where("test")  # columns times letters
    g = train.groupBy("x").agg(F.sum("c").alias("g"))
    n = g.agg(F.sum("g").alias("n"), F.count("*").alias("v"))
    k = train.groupBy("col").agg(F.sum("c").alias("m"))
    p = test.join(g, "x", "left").join(k, "col", "left").join(train.select("col", "x", F.col("c").alias("b")), ["col", "x"], "left").join(F.broadcast(n))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    pg = (zero("g") + 0.5) / (F.col("n") + 0.5 * (F.col("v") + 1))
    pc = F.coalesce((zero("b") + 0.5) / (F.col("m") + 0.5 * (F.col("v") + 1)), pg)
    mean = lambda x: r6(F.sum(F.col("c") * x) / F.sum("c"))
    return p.agg(mean(-F.log2(pg)).alias("h_global"), mean(-F.log2(pc)).alias("h_column"), mean(F.log2(pc / pg)).alias("gain"))


def _grams(n: int) -> str:
    pad = "^" * (n - 1)
    return f"w AS (SELECT lang, doc_id % 3 = 0 AS test, '{pad}' || word || '$' AS w, count(*) AS k FROM tokens GROUP BY 1, 2, 3), g AS (SELECT lang, test, substr(w, i, {n}) AS g, sum(k)::DOUBLE AS c FROM (SELECT lang, test, w, k, unnest(range(1, length(w) - {n - 2})) AS i FROM w) GROUP BY 1, 2, 3)"


def _gram_counts(t, n: int):
    """(lang, test, g, c): letter n-grams of distinct words, a third of the documents held out."""
    w = F.concat(F.lit("^" * (n - 1)), "word", F.lit("$"))
    d = bare(t, "lang").groupBy("lang", (F.col("doc_id") % 3 == 0).alias("test"), w.alias("w")).agg(F.count("*").alias("k"))
    g = d.select("lang", "test", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - (n - 1)), lambda i: F.substring("w", i, F.lit(n)))).alias("g"))
    return g.groupBy("lang", "test", "g").agg(F.sum("k").cast("double").alias("c"))


@query("tetragram_bits", TOK + ", " + _grams(4) + """, v AS (SELECT lang, count(DISTINCT right(g, 1)) AS v FROM g WHERE NOT test GROUP BY 1), h AS (SELECT lang, substr(g, 1, 3) AS h, sum(c) AS m FROM g WHERE NOT test GROUP BY 1, 2)
SELECT t.lang, sum(t.c)::BIGINT AS letters, round(-sum(t.c * log2((coalesce(f.c, 0) + 0.1::DOUBLE) / (coalesce(m, 0) + 0.1::DOUBLE * v))) / sum(t.c), 6) + 0.0 AS bits
FROM g t JOIN v ON v.lang = t.lang LEFT JOIN g f ON NOT f.test AND f.lang = t.lang AND f.g = t.g LEFT JOIN h ON h.lang = t.lang AND h.h = substr(t.g, 1, 3) WHERE t.test GROUP BY 1""")
def _(t):
    """Letters of held-out documents by a smoothed tetragram model of their language; models and texts meet as counts."""
    g = _gram_counts(t, 4).where("lang is not null")
    train = g.where("not test").select("lang", "g", F.col("c").alias("f"))
    v = train.groupBy("lang").agg(F.count_distinct(F.right("g", F.lit(1))).alias("v"))
    h = train.groupBy("lang", F.substring("g", 1, 3).alias("h")).agg(F.sum("f").alias("m"))
    s = g.where("test").withColumn("h", F.substring("g", 1, 3)).join(train, ["lang", "g"], "left").join(h, ["lang", "h"], "left").join(F.broadcast(v), "lang")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    p = (zero("f") + 0.1) / (zero("m") + 0.1 * F.col("v"))
    return s.groupBy("lang").agg(F.sum("c").cast("long").alias("letters"), r6(-F.sum(F.col("c") * F.log2(p)) / F.sum("c")).alias("bits"))


@query("transition_cross_entropy", TOK + ", " + _grams(2) + """, l AS (SELECT DISTINCT lang FROM g WHERE NOT test AND lang IS NOT NULL), a AS (SELECT DISTINCT lang, x FROM (SELECT lang, substr(g, 1, 1) AS x FROM g WHERE NOT test UNION SELECT lang, substr(g, 2, 1) FROM g WHERE NOT test)), n AS (SELECT lang, count(*) FILTER (WHERE x NOT IN ('^')) AS v FROM a GROUP BY 1),
m AS (SELECT lang, substr(g, 1, 1) AS x, sum(c) AS m FROM g WHERE NOT test GROUP BY 1, 2), s AS (SELECT l.lang AS fitted, t.lang AS target, t.c, CASE WHEN ax.x IS NULL OR ay.x IS NULL THEN 20.0::DOUBLE ELSE -ln((coalesce(f.c, 0) + 0.5::DOUBLE) / (coalesce(m.m, 0) + 0.5::DOUBLE * v)) END AS b
FROM g t, l JOIN n ON n.lang = l.lang LEFT JOIN a ax ON ax.lang = l.lang AND ax.x = substr(t.g, 1, 1) LEFT JOIN a ay ON ay.lang = l.lang AND ay.x = substr(t.g, 2, 1) LEFT JOIN g f ON NOT f.test AND f.lang = l.lang AND f.g = t.g LEFT JOIN m ON m.lang = l.lang AND m.x = substr(t.g, 1, 1) WHERE t.test AND t.lang IS NOT NULL)
SELECT fitted, target, round(sum(c * b) / sum(c), 6) + 0.0 AS nats FROM s GROUP BY 1, 2""")
def _(t):
    """Letter pairs of each language's held-out documents by each language's model, both ways; 20 nats for a letter that the model lacks."""
    g = _gram_counts(t, 2).where("lang is not null")
    train = g.where("not test").select(F.col("lang").alias("fitted"), "g", F.col("c").alias("f"))
    x, y = F.substring("g", 1, 1), F.substring("g", 2, 1)
    letters = train.select("fitted", F.explode(F.array(x, y)).alias("x")).distinct()
    model = letters.groupBy("fitted").agg(F.collect_set("x").alias("alphabet"), F.count(F.when(F.col("x") != "^", 1)).alias("v"))  # a row for each language
    m = train.groupBy("fitted", x.alias("x")).agg(F.sum("f").alias("m"))
    s = g.where("test").select(F.col("lang").alias("target"), "g", "c", x.alias("x"), y.alias("y")).join(F.broadcast(model)).join(train, ["fitted", "g"], "left").join(m, ["fitted", "x"], "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    known = F.array_contains("alphabet", F.col("x")) & F.array_contains("alphabet", F.col("y"))
    nats = F.when(known, -F.log((zero("f") + 0.5) / (zero("m") + 0.5 * F.col("v")))).otherwise(20.0)
    return s.groupBy("fitted", "target").agg(r6(F.sum(F.col("c") * nats) / F.sum("c")).alias("nats"))


@query("loo_trigram_classifier", TOK + """, l AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY 1), w AS (SELECT doc_id, y, word, count(*) AS k FROM tokens JOIN l USING (doc_id) WHERE length(word) > 2 GROUP BY 1, 2, 3),
g AS (SELECT doc_id, y, g, sum(k)::DOUBLE AS c FROM (SELECT doc_id, y, k, substr(word, i, 3) AS g FROM (SELECT *, unnest(range(1, length(word) - 1)) AS i FROM w)) GROUP BY 1, 2, 3),
a AS (SELECT g, coalesce(sum(c) FILTER (WHERE y = 1), 0) AS a, coalesce(sum(c) FILTER (WHERE y = 0), 0) AS b FROM g GROUP BY 1), n AS (SELECT sum(a) AS ta, sum(b) AS tb FROM a), o AS (SELECT doc_id, sum(c) AS own FROM g GROUP BY 1),
s AS (SELECT g.doc_id, y, sum(c * ln(((a - y * c + 1) / (ta - y * own + 1)) / ((b - (1 - y) * c + 1) / (tb - (1 - y) * own + 1)))) AS s FROM g JOIN a USING (g) JOIN o ON o.doc_id = g.doc_id, n GROUP BY 1, 2)
SELECT y AS label, count(*) AS docs, count(*) FILTER (WHERE (round(s, 6) > 0) = (y = 1)) AS hits FROM s GROUP BY 1""")
def _(t):
    """Quality by the log ratio of letter trigrams, each document scored by the counts of all others."""
    l = t.labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))  # noqa: E741
    w = bare(t).where(F.length("word") > 2).join(l, "doc_id").groupBy("doc_id", "y", "word").agg(F.count("*").alias("k"))
    g = w.select("doc_id", "y", "k", F.explode(W.ngrams("word", 3)).alias("g")).groupBy("doc_id", "y", "g").agg(F.sum("k").cast("double").alias("c"))
    part = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("c"))), F.lit(0.0))
    a = g.groupBy("g").agg(part(1).alias("a"), part(0).alias("b"))
    n = a.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    o = g.groupBy("doc_id").agg(F.sum("c").alias("own"))
    y, c = F.col("y"), F.col("c")
    ratio = ((F.col("a") - y * c + 1) / (F.col("ta") - y * F.col("own") + 1)) / ((F.col("b") - (1 - y) * c + 1) / (F.col("tb") - (1 - y) * F.col("own") + 1))
    s = g.join(a, "g").join(o, "doc_id").join(F.broadcast(n)).groupBy("doc_id", "y").agg(F.sum(c * F.log(ratio)).alias("s"))
    return s.groupBy(y.alias("label")).agg(F.count("*").alias("docs"), F.count(F.when((F.round("s", 6) > 0) == (y == 1), 1)).alias("hits"))


@query("previous_row_components", TOK + """, n AS (SELECT DISTINCT doc_id, line_no, n_line FROM tokens), b AS (SELECT doc_id, line_no, word, count(*) AS c FROM tokens GROUP BY 1, 2, 3)
SELECT t.lang, count(*) AS cells, round(avg(coalesce(b.c, 0) / n.n_line), 6) + 0.0 AS bag, round(avg(CASE WHEN d.word = t.word THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS diagonal
FROM tokens t JOIN n ON n.doc_id = t.doc_id AND n.line_no = t.line_no - 1 LEFT JOIN b ON b.doc_id = t.doc_id AND b.line_no = t.line_no - 1 AND b.word = t.word LEFT JOIN tokens d ON d.doc_id = t.doc_id AND d.line_no = t.line_no - 1 AND d.pos = t.pos GROUP BY 1""")
def _(t):
    """Point masses of the line before: the share of its words that are the target, and whether the word above is it. As in `lag_similarity`, only sums are shuffled."""
    once, twice = bags.apart(t.documents)
    s = bags.row_above_sums(once, "lang")
    if twice is not None:
        c = tokens(twice, "lang", seq=False).select("doc_id", "lang", "line_no", "n_line", "pos", "word")
        up = lambda df: df.withColumn("line_no", F.col("line_no") + 1)
        n = up(c.select("doc_id", "line_no", F.col("n_line").alias("size")).distinct())
        b = up(c.groupBy("doc_id", "line_no", "word").agg(F.count("*").alias("c")))
        d = up(c.select("doc_id", "line_no", "pos", F.col("word").alias("above")))
        j = c.join(n, ["doc_id", "line_no"]).join(b, ["doc_id", "line_no", "word"], "left").join(d, ["doc_id", "line_no", "pos"], "left")
        share, same = F.coalesce("c", F.lit(0)) / F.col("size"), F.when(F.col("above") == F.col("word"), 1.0).otherwise(0.0)
        s = s.unionByName(j.groupBy("lang").agg(F.count("*").alias("cells"), F.sum(share).alias("bag"), F.sum(same).alias("diagonal")))
    mean = lambda k: r6(F.sum(k) / F.sum("cells")).alias(k)
    return s.groupBy("lang").agg(F.sum("cells").alias("cells"), mean("bag"), mean("diagonal"))


@query("position_residual", TOK + """, w AS (SELECT lang, doc_id % 3 = 0 AS test, word, count(*)::DOUBLE AS k FROM tokens WHERE lang IS NOT NULL AND length(word) > 2 GROUP BY 1, 2, 3), e AS (SELECT lang, test, least(i, 8) AS slot, substr(word, i - 2, 2) AS h, substr(word, i, 1) AS x, sum(k) AS c FROM (SELECT *, unnest(range(3, length(word) + 1)) AS i FROM w) GROUP BY ALL),
f AS (SELECT * FROM e WHERE NOT test), v AS (SELECT lang, count(DISTINCT x) AS v FROM f GROUP BY 1), a AS (SELECT lang, slot, x, sum(c) AS c FROM f GROUP BY 1, 2, 3), s AS (SELECT lang, slot, sum(c) AS c FROM f GROUP BY 1, 2), b AS (SELECT lang, h, x, sum(c) AS c FROM f GROUP BY 1, 2, 3), m AS (SELECT lang, h, sum(c) AS c FROM f GROUP BY 1, 2),
p AS (SELECT e.lang, e.c, (coalesce(a.c, 0) + 0.5) / (coalesce(s.c, 0) + 0.5 * v) AS base, (coalesce(b.c, 0) + 0.5) / (coalesce(m.c, 0) + 0.5 * v) AS lm FROM e JOIN v ON v.lang = e.lang LEFT JOIN a ON a.lang = e.lang AND a.slot = e.slot AND a.x = e.x LEFT JOIN s ON s.lang = e.lang AND s.slot = e.slot LEFT JOIN b ON b.lang = e.lang AND b.h = e.h AND b.x = e.x LEFT JOIN m ON m.lang = e.lang AND m.h = e.h WHERE e.test)
SELECT lang, sum(c)::BIGINT AS letters, round(sum(c * log2((0.5 * base + 0.5 * lm) / base)) / sum(c), 6) + 0.0 AS residual, round(sum(c * log2(lm)) / sum(c), 6) + 0.0 AS lm_score FROM p GROUP BY 1""")
def _(t):
    """What a trigram model adds, in equal mixture, to the letter's place in the word; models of two thirds of the documents, scored on the rest."""
    w = bare(t, "lang").where((F.length("word") > 2) & F.col("lang").isNotNull()).groupBy("lang", (F.col("doc_id") % 3 == 0).alias("test"), "word").agg(F.count("*").cast("double").alias("k"))
    at = w.select("lang", "test", "word", "k", F.explode(F.sequence(F.lit(3), F.length("word"))).alias("i"))
    e = at.groupBy("lang", "test", F.least("i", F.lit(8)).alias("slot"), F.substring("word", F.col("i") - 2, F.lit(2)).alias("h"), F.substring("word", F.col("i"), F.lit(1)).alias("x")).agg(F.sum("k").alias("c"))
    f = e.where("not test")
    count = lambda name, *k: f.groupBy("lang", *k).agg(F.sum("c").alias(name))
    v = f.groupBy("lang").agg(F.count_distinct("x").alias("v"))
    p = e.where("test").join(F.broadcast(v), "lang")
    for name, keys in (("a", ["slot", "x"]), ("s", ["slot"]), ("b", ["h", "x"]), ("m", ["h"])):
        p = p.join(count(name, *keys), ["lang", *keys], "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    base, lm = (zero("a") + 0.5) / (zero("s") + 0.5 * F.col("v")), (zero("b") + 0.5) / (zero("m") + 0.5 * F.col("v"))
    mean = lambda x: r6(F.sum(F.col("c") * x) / F.sum("c"))
    return p.groupBy("lang").agg(F.sum("c").cast("long").alias("letters"), mean(F.log2((0.5 * base + 0.5 * lm) / base)).alias("residual"), mean(F.log2(lm)).alias("lm_score"))


@query("categorical_gain", TOK + """, c AS (SELECT doc_id % 2 = 0 AS train, lang, source, length(word) % 5 AS y, count(*)::DOUBLE AS c FROM tokens WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2, 3, 4), b AS (SELECT lang, y, sum(c) AS c FROM c WHERE train GROUP BY 1, 2), n AS (SELECT lang, sum(c) AS n FROM b GROUP BY 1), m AS (SELECT lang, source, sum(c) AS m FROM c WHERE train GROUP BY 1, 2),
p AS (SELECT t.lang, t.c, (coalesce(b.c, 0) + 1) / (n + 5) AS base, coalesce(v.c, 0) AS v, coalesce(m, 0) AS m FROM c t JOIN n ON n.lang = t.lang LEFT JOIN b ON b.lang = t.lang AND b.y = t.y LEFT JOIN c v ON v.train AND v.lang = t.lang AND v.source = t.source AND v.y = t.y LEFT JOIN m ON m.lang = t.lang AND m.source = t.source WHERE NOT t.train)
SELECT lang, sum(c)::BIGINT AS n, round(sum(c * log2(((v + 4 * base) / (m + 4)) / base)) / sum(c), 6) + 0.0 AS gain FROM p GROUP BY 1""")
def _(t):
    """What a category (the source) adds to the shares of an outcome (length modulo five) of its tier (the language), on documents that were not counted."""
    c = bare(t, "lang", "source").where("source is not null and lang is not null").groupBy((F.col("doc_id") % 2 == 0).alias("train"), "lang", "source", (F.length("word") % 5).alias("y")).agg(F.count("*").cast("double").alias("c"))
    f = c.where("train")
    b = f.groupBy("lang", "y").agg(F.sum("c").alias("b"))
    n = f.groupBy("lang").agg(F.sum("c").alias("n"))
    m = f.groupBy("lang", "source").agg(F.sum("c").alias("m"))
    p = c.where("not train").join(F.broadcast(n), "lang").join(b, ["lang", "y"], "left").join(f.select("lang", "source", "y", F.col("c").alias("v")), ["lang", "source", "y"], "left").join(m, ["lang", "source"], "left")
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    base = (zero("b") + 1) / (F.col("n") + 5)
    gain = F.log2(((zero("v") + 4 * base) / (zero("m") + 4)) / base)
    return p.groupBy("lang").agg(F.sum("c").cast("long").alias("n"), r6(F.sum(F.col("c") * gain) / F.sum("c")).alias("gain"))


@query("train_scaler", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS j FROM embeddings), s AS (SELECT j, avg(x) AS m, greatest(stddev_pop(x), abs(avg(x)) * 0.1, 1e-4) AS s FROM e WHERE vec_id % 2 = 0 GROUP BY 1)
SELECT e.j::INT AS j, round(max(s), 6) + 0.0 AS scale, round(avg((x - m) / s), 5) + 0.0 AS shift, round(avg(abs((x - m) / s)), 5) + 0.0 AS size FROM e JOIN s ON e.j = s.j WHERE vec_id % 2 = 1 GROUP BY 1""")
def _(t):
    """Components of the odd vectors on the scale of the even ones, which has a floor."""
    e = t.embeddings.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
    s = e.where("vec_id % 2 = 0").groupBy("j").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.abs(F.avg("x")) * 0.1, F.lit(1e-4)).alias("s"))
    z = e.where("vec_id % 2 = 1").join(F.broadcast(s), "j").withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))  # a row for each component
    r5 = lambda x: F.round(x, 5) + F.lit(0.0)
    return z.groupBy("j").agg(r6(F.max("s")).alias("scale"), r5(F.avg("z")).alias("shift"), r5(F.avg(F.abs("z"))).alias("size"))


@query("tournament", TOK + ", " + _grams(3) + """, f AS (SELECT lang, g, c FROM g WHERE NOT test AND lang IS NOT NULL), v AS (SELECT lang, count(DISTINCT right(g, 1)) AS v FROM f GROUP BY 1), h AS (SELECT lang, substr(g, 1, 2) AS h, sum(c) AS m FROM f GROUP BY 1, 2),
s AS (SELECT t.lang, alpha, -sum(t.c * log2((coalesce(f.c, 0) + alpha) / (coalesce(m, 0) + alpha * v))) / sum(t.c) AS bits FROM g t JOIN v ON v.lang = t.lang LEFT JOIN f ON f.lang = t.lang AND f.g = t.g LEFT JOIN h ON h.lang = t.lang AND h.h = substr(t.g, 1, 2), (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS alpha) a WHERE t.test GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(bits, 9), alpha) AS r FROM s) SELECT alpha, count(*) AS langs, count(*) FILTER (WHERE r = 1) AS wins, round(avg(bits), 6) + 0.0 AS mean_bits, round(max(bits), 6) + 0.0 AS worst FROM r GROUP BY 1""")
def _(t):
    """Candidates (smoothing masses of a trigram model) over blocks (languages): wins, pooled and worst scores."""
    g = _gram_counts(t, 3).where("lang is not null")
    f = g.where("not test").select("lang", "g", F.col("c").alias("f"))
    v = f.groupBy("lang").agg(F.count_distinct(F.right("g", F.lit(1))).alias("v"))
    h = f.groupBy("lang", F.substring("g", 1, 2).alias("h")).agg(F.sum("f").alias("m"))
    s = g.where("test").withColumn("h", F.substring("g", 1, 2)).join(f, ["lang", "g"], "left").join(h, ["lang", "h"], "left").join(F.broadcast(v), "lang")
    s = s.withColumn("alpha", F.explode(F.array(F.lit(0.01), F.lit(0.1), F.lit(1.0))))
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    p = (zero("f") + F.col("alpha")) / (zero("m") + F.col("alpha") * F.col("v"))
    b = s.groupBy("lang", "alpha").agg((-F.sum(F.col("c") * F.log2(p)) / F.sum("c")).alias("bits"))
    r = b.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.round("bits", 9), "alpha")))  # a row for each candidate
    return r.groupBy("alpha").agg(F.count("*").alias("langs"), F.count(F.when(F.col("r") == 1, 1)).alias("wins"), r6(F.avg("bits")).alias("mean_bits"), r6(F.max("bits")).alias("worst"))
