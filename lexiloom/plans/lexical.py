"""Queries: lexical statistics and information measures of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import info, sequence
from lexiloom.operators.info import r6
from lexiloom.operators.tokens import lines, text_grams, tokens
from lexiloom.plans.base import CTOK, TOK, WORD, query, slots_sql


def corpus(t, *carry: str) -> DataFrame:
    """Words with their places in line and document."""
    return tokens(t.documents, *carry)


def lined(t, *carry: str) -> DataFrame:
    """Words with their places in the line."""
    return tokens(t.documents, *carry, seq=False)


def flow(t, *carry: str) -> DataFrame:
    """Words with their places in the document."""
    return tokens(t.documents, *carry, line=False)


def bare(t, *carry: str) -> DataFrame:
    """Words alone."""
    return tokens(t.documents, *carry, line=False, seq=False)


def slots(df: DataFrame, *carry: str) -> DataFrame:
    """prefix, core and suffix of each word, and the columns `carry`."""
    return df.select(*carry, "word", W.FULL.split("word").alias("s")).select(*carry, "word", "s.*")


@query("token_count_by_lang", TOK + "SELECT coalesce(lang, 'ALL') AS lang, count(*) AS tokens, count(DISTINCT word) AS types, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY GROUPING SETS ((), (lang))")
def _(t):
    """Words are counted once; what is common to all languages is rolled up from the counts."""
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    each = c.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))
    every = c.groupBy("word").agg(F.sum("n").alias("n")).agg(F.lit("ALL").alias("lang"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"))
    held = t.documents.where(F.lower("text").rlike(WORD)).select("lang", "doc_id").distinct()
    docs = held.groupBy("lang").agg(F.count("*").alias("docs")).unionByName(held.agg(F.lit("ALL").alias("lang"), F.count_distinct("doc_id").alias("docs")))
    out = each.unionByName(every).join(docs.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")))
    return out.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "tokens", "types", "docs")


@query("token_table", TOK + "SELECT doc_id, lang, source, line_no, n_line, pos, seq, word FROM tokens")
def _(t):
    return corpus(t, "lang", "source").select("doc_id", "lang", "source", "line_no", "n_line", "pos", "seq", "word")


@query("zipf_slope_by_lang", TOK + """, c AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY 1, 2),
r AS (SELECT lang, ln(n) AS y, ln(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)) AS x FROM c)
SELECT lang, round(regr_slope(y, x), 6) + 0.0 AS slope FROM r GROUP BY lang""")
def _(t):
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = sequence.ranks(c, ["lang"], F.struct(-F.col("n"), F.substring("word", 1, 2)), [F.col("n").desc(), "word"], "r")
    return ranked.groupBy("lang").agg(r6(F.regr_slope(F.log("n"), F.log("r"))).alias("slope"))


@query("hapax_fraction", TOK + """, c AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT lang, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hapax, count(*) AS types FROM c GROUP BY lang""")
def _(t):
    c = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(r6(F.avg((F.col("n") == 1).cast("double"))).alias("hapax"), F.count("*").alias("types"))


@query("word_length_dispersion", TOK + "SELECT lang, round(avg(length(word)), 6) + 0.0 AS mean, round(var_pop(length(word)), 6) + 0.0 AS variance, round(var_pop(length(word)) / avg(length(word)), 6) + 0.0 AS dispersion FROM tokens GROUP BY lang")
def _(t):
    n = F.length("word")
    return bare(t, "lang").groupBy("lang").agg(r6(F.avg(n)).alias("mean"), r6(F.var_pop(n)).alias("variance"), r6(F.var_pop(n) / F.avg(n)).alias("dispersion"))


@query("vocab_jaccard", TOK + """, v AS (SELECT DISTINCT lang, word FROM tokens), s AS (SELECT lang, count(*) AS n FROM v GROUP BY 1),
p AS (SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM v a JOIN v b ON a.word = b.word AND a.lang < b.lang GROUP BY 1, 2)
SELECT x.lang AS lang_a, y.lang AS lang_b, x.n AS types_a, y.n AS types_b, coalesce(shared, 0) AS shared,
  round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0))::DOUBLE, 6) + 0.0 AS jaccard
FROM s x JOIN s y ON x.lang < y.lang LEFT JOIN p ON p.a = x.lang AND p.b = y.lang""")
def _(t):
    v = bare(t, "lang").select("lang", "word").distinct()
    sets = v.groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("ls"))  # at most one entry for each language
    pair = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b > a), lambda b: F.struct(a.alias("lang_a"), b.alias("lang_b")))))
    shared = sets.where("size(ls) > 1").select(F.explode(pair).alias("p")).groupBy("p.lang_a", "p.lang_b").agg(F.count("*").alias("shared"))
    n = v.groupBy("lang").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("lang").alias("lang_a"), F.col("n").alias("types_a")), n.select(F.col("lang").alias("lang_b"), F.col("n").alias("types_b"))
    out = a.join(b, F.col("lang_a") < F.col("lang_b")).join(shared, ["lang_a", "lang_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumn("jaccard", r6(F.col("shared") / (F.col("types_a") + F.col("types_b") - F.col("shared"))))


@query("skewed_words_topk", TOK + """, c AS (SELECT lang, word, count(*) AS f FROM tokens WHERE lang IS NOT NULL GROUP BY 1, 2), n AS (SELECT lang, sum(f) AS n FROM c GROUP BY 1), a AS (SELECT word, sum(f) AS f FROM c GROUP BY 1), m AS (SELECT sum(f) AS m FROM a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC, word) AS k FROM c),
s AS (SELECT top.lang, top.word, top.f, a.f - top.f AS g, (top.f / n.n::DOUBLE) / ((a.f - top.f + 1) / (m - n.n)::DOUBLE) AS ratio FROM top JOIN n ON n.lang = top.lang JOIN a ON a.word = top.word, m WHERE k <= 200),
r AS (SELECT lang, word, f, g::BIGINT AS g, round(ratio, 6) + 0.0 AS ratio, row_number() OVER (PARTITION BY lang ORDER BY round(ratio, 6) DESC, word) AS k FROM s) SELECT lang, word, f, g, ratio FROM r WHERE k <= 12""")
def _(t):
    """The twelve words of each language's 200 commonest that all other languages have least."""
    c = bare(t, "lang").where("lang is not null").groupBy("lang", "word").agg(F.count("*").alias("f"))
    n = c.groupBy("lang").agg(F.sum("f").alias("n"))
    n = n.join(F.broadcast(n.agg(F.sum("n").alias("m"))))
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("f").desc(), "word"))).where("k <= 200").drop("k")
    a = c.join(F.broadcast(top.select("word").distinct()), "word").groupBy("word").agg(F.sum("f").alias("a"))  # 200 words for each language
    s = top.join(F.broadcast(a), "word").join(F.broadcast(n), "lang").withColumn("g", F.col("a") - F.col("f"))
    s = s.select("lang", "word", "f", "g", r6((F.col("f") / F.col("n")) / ((F.col("g") + 1) / (F.col("m") - F.col("n")))).alias("ratio"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("ratio").desc(), "word"))).where("k <= 12").drop("k")


_CHARS = TOK + """, s AS (SELECT doc_id, lang, string_agg(word, ' ' ORDER BY seq) AS x FROM tokens GROUP BY 1, 2),
ch AS (SELECT lang, substr(x, i, 1) AS a, substr(x, i, 2) AS ab FROM (SELECT lang, x, unnest(range(1, length(x) + 1)) AS i FROM s)),
bi AS (SELECT lang, ab, count(*)::DOUBLE AS c FROM ch WHERE length(ab) = 2 GROUP BY 1, 2),
u AS (SELECT lang, a, count(*)::DOUBLE AS c FROM ch GROUP BY 1, 2),
h2 AS (SELECT lang, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM bi GROUP BY 1),
f AS (SELECT lang, substr(ab, 1, 1) AS a, sum(c) AS c FROM bi GROUP BY 1, 2),
hf AS (SELECT lang, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM f GROUP BY 1),
h1 AS (SELECT lang, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, count(*) AS k FROM u GROUP BY 1)
SELECT h1.lang, round(log2(k), 6) + 0.0 AS h0, round(h1.h, 6) + 0.0 AS h1, round(h2.h - hf.h, 6) + 0.0 AS h2 FROM h1 JOIN h2 ON h1.lang = h2.lang JOIN hf ON h1.lang = hf.lang"""


@query("char_entropy_by_lang", _CHARS)
def _(t):
    g = text_grams(t.documents, ["lang"], 2)
    c = lambda x: F.sum(x) * F.log2(F.sum(x)) - F.sum(x * F.log2(x))
    n = F.col("c").cast("double")
    one = g.groupBy("lang", F.substring("g", 1, 1).alias("a")).agg(F.sum("c").cast("double").alias("c")).groupBy("lang").agg(F.log2(F.count("*").cast("double")).alias("h0"), (c(F.col("c")) / F.sum("c")).alias("h1"))
    two = _gram_entropy(g.where("length(g) = 2").withColumn("c", n), 1).withColumnRenamed("h", "h2")
    return one.join(two, "lang").select("lang", r6("h0").alias("h0"), r6("h1").alias("h1"), r6("h2").alias("h2"))


def _gram_entropy(grams: DataFrame, k: int) -> DataFrame:
    """(lang, h): entropy of the last letter given the first k, of counted grams."""
    c = F.col("c").cast("double")
    p = grams.groupBy("lang", F.substring("g", 1, k).alias("ctx")).agg(F.sum(c).alias("m"), F.sum(c * F.log2(c)).alias("s"))
    return p.groupBy("lang").agg((F.sum(F.col("m") * F.log2("m") - F.col("s")) / F.sum("m")).alias("h"))


def _k_sql(k: int) -> str:
    return TOK + f""", s AS (SELECT doc_id, lang, ' ' || string_agg(word, ' ' ORDER BY seq) || ' ' AS x FROM tokens GROUP BY 1, 2),
g AS (SELECT lang, substr(x, i, {k + 1}) AS g FROM (SELECT lang, x, unnest(range(1, length(x) - {k} + 1)) AS i FROM s)),
c AS (SELECT lang, substr(g, 1, {k}) AS ctx, g, count(*)::DOUBLE AS c FROM g GROUP BY 1, 2, 3),
p AS (SELECT lang, ctx, sum(c) AS m, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 6) + 0.0 AS h FROM p GROUP BY lang"""


def _k_entropy(k: int):
    def run(t):
        out = _gram_entropy(text_grams(t.documents, ["lang"], k + 1, padded=True).where(F.length("g") == k + 1), k)
        return out.select("lang", r6("h").alias("h"))

    return run


for _n in (1, 2, 3):
    query(f"cond_entropy_k{_n}", _k_sql(_n))(_k_entropy(_n))


@query("bigram_cond_entropy", TOK + """, b AS (SELECT lang, word AS x, lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS y FROM tokens),
c AS (SELECT lang, x, y, count(*)::DOUBLE AS c FROM b WHERE y IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT lang, x, sum(c) AS m, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 6) + 0.0 AS h FROM p GROUP BY lang""")
def _(t):
    ws = lines(t.documents, "lang").select("lang", F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("ws")).where("size(ws) > 1")
    pairs = ws.select("lang", F.explode(F.arrays_zip(F.slice("ws", F.lit(1), F.size("ws") - 1).alias("x"), F.slice("ws", F.lit(2), F.size("ws") - 1).alias("y"))).alias("p")).select("lang", "p.*")
    return info.conditional_entropy(pairs, ["y"], ["x"], ["lang"]).select("lang", r6("h").alias("h"))


_SLOTS = TOK + "," + slots_sql("tokens")


@query("slot_decomposition", _SLOTS + "SELECT DISTINCT word, prefix, core, suffix FROM slots")
def _(t):
    return bare(t).select("word").distinct().select("word", W.FULL.split("word").alias("s")).select("word", "s.*")


@query("slot_field_report", _SLOTS + """, f AS (SELECT 'prefix' AS field, prefix AS v FROM slots UNION ALL SELECT 'core', core FROM slots UNION ALL SELECT 'suffix', suffix FROM slots),
c AS (SELECT field, v, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, v) AS k FROM c)
SELECT field, count(*) AS n_values, round(sum(CASE WHEN k <= 10 THEN n ELSE 0 END) / sum(n), 6) + 0.0 AS top10, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy,
  string_agg(v, ',' ORDER BY k) FILTER (WHERE k <= 6) AS top6 FROM r GROUP BY field""")
def _(t):
    s = slots(bare(t))
    f = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("v")) for k in ("prefix", "core", "suffix")])).alias("f")).select("f.*")
    c = f.groupBy("field", "v").agg(F.count("*").cast("double").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "v")))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= 6, F.struct("k", "v")))), lambda x: x["v"])
    return r.groupBy("field").agg(
        F.count("*").alias("n_values"), r6(F.sum(F.when(F.col("k") <= 10, F.col("n")).otherwise(0)) / F.sum("n")).alias("top10"),
        r6(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"), F.array_join(top, ",").alias("top6"),
    )


def mi_sql(source: str, x: str, y: str, by: str | None = None, name: str = "mi") -> str:
    g, on = (f"{by}, ", "USING (" + by + ")") if by else ("", "ON true")
    grp = f"GROUP BY {by}" if by else ""
    return f"""j_ AS (SELECT {g}{x} AS x, {y} AS y, count(*)::DOUBLE AS c FROM {source} GROUP BY {g}{x}, {y}),
n_ AS (SELECT {g}sum(c) AS n, sum(c * log2(c)) AS sxy FROM j_ {grp}),
x_ AS (SELECT {g}sum(m * log2(m)) AS sx FROM (SELECT {g}x, sum(c) AS m FROM j_ GROUP BY {g}x) {grp}),
y_ AS (SELECT {g}sum(m * log2(m)) AS sy FROM (SELECT {g}y, sum(c) AS m FROM j_ GROUP BY {g}y) {grp})
SELECT {g}round(log2(n) + (sxy - sx - sy) / n, 6) + 0.0 AS {name} FROM n_ JOIN x_ {on} JOIN y_ {on}"""


for _x, _y in (("prefix", "suffix"), ("prefix", "core"), ("core", "suffix")):
    query(f"mi_{_x}_{_y}", _SLOTS + "," + mi_sql("slots", _x, _y, "lang"))(lambda t, x=_x, y=_y: info.mutual_information(slots(bare(t, "lang"), "lang"), x, y, ["lang"]).select("lang", r6("mi").alias("mi")))

query("mi_returnflag_linestatus", "WITH " + mi_sql("lineitem", "l_returnflag", "l_linestatus"))(lambda t: info.mutual_information(t.lineitem, "l_returnflag", "l_linestatus").select(r6("mi").alias("mi")))
query("mi_brand_type", "WITH " + mi_sql("part", "p_brand", "p_type"))(lambda t: info.mutual_information(t.part, "p_brand", "p_type").select(r6("mi").alias("mi")))
query("events_type_user_mi", "WITH " + mi_sql("events", "event_type", "user_id"))(lambda t: info.mutual_information(t.events, "event_type", "user_id").select(r6("mi").alias("mi")))


@query("cond_entropy_suffix_given_prefix", _SLOTS + """, c AS (SELECT lang, prefix, suffix, count(*)::DOUBLE AS c FROM slots GROUP BY 1, 2, 3), p AS (SELECT lang, prefix, sum(c) AS m, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 6) + 0.0 AS h FROM p GROUP BY lang""")
def _(t):
    return info.conditional_entropy(slots(bare(t, "lang"), "lang"), ["suffix"], ["prefix"], ["lang"]).select("lang", r6("h").alias("h"))


@query("kl_user_vs_assistant", CTOK + """, p AS (SELECT word, count(*) / (SELECT count(*) FROM ctok WHERE role = 'user')::DOUBLE AS p FROM ctok WHERE role = 'user' GROUP BY 1),
q AS (SELECT word, count(*) / (SELECT count(*) FROM ctok WHERE role = 'assistant')::DOUBLE AS q FROM ctok WHERE role = 'assistant' GROUP BY 1),
b AS (SELECT greatest(coalesce(p, 0), 1e-9::DOUBLE) AS a, greatest(coalesce(q, 0), 1e-9::DOUBLE) AS b FROM p FULL JOIN q USING (word)),
s AS (SELECT p, coalesce(q, 0) AS q FROM p LEFT JOIN q USING (word))
SELECT (SELECT round(sum(a * log2(a / b)), 6) + 0.0 FROM b) AS kl_floor, (SELECT round(sum(p * log2(p / (q + 1e-9::DOUBLE))), 6) + 0.0 FROM s) AS kl_support""")
def _(t):
    c = tokens(t.conversations, "role", key="conv_id")
    p, q = (c.where(F.col("role") == r).select("word") for r in ("user", "assistant"))
    return info.kl(p, q, "word", "floor", name="kl_floor").join(F.broadcast(info.kl(p, q, "word", "support", name="kl_support"))).select(r6("kl_floor").alias("kl_floor"), r6("kl_support").alias("kl_support"))


@query("grammar_coverage", _SLOTS + """SELECT lang, round(avg(CASE WHEN prefix <> '' AND suffix <> '' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS "full", round(avg(CASE WHEN prefix <> '' OR suffix <> '' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS "any",
round(avg(CASE WHEN prefix = '' AND suffix = '' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS "none" FROM slots GROUP BY lang""")
def _(t):
    p, s = F.col("prefix") != "", F.col("suffix") != ""
    share = lambda c, n: r6(F.avg(c.cast("double"))).alias(n)
    return slots(bare(t, "lang"), "lang").groupBy("lang").agg(share(p & s, "full"), share(p | s, "any"), share(~p & ~s, "none"))


@query("position_profile", TOK + """SELECT least(pos, 12) AS slot, count(*) AS n, round(avg(length(word)), 6) + 0.0 AS mean_length, round(avg(CASE WHEN regexp_matches(word, '[ktpf]') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS gallows,
round(avg(CASE WHEN ends_with(word, 'y') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS final_y FROM tokens GROUP BY 1""")
def _(t):
    return lined(t).groupBy(F.least(F.col("pos"), F.lit(12)).cast("long").alias("slot")).agg(
        F.count("*").alias("n"), r6(F.avg(F.length("word"))).alias("mean_length"), r6(F.avg(W.has_gallows("word").cast("double"))).alias("gallows"), r6(F.avg(F.col("word").endswith("y").cast("double"))).alias("final_y")
    )


@query("line_width_cv", TOK + """, w AS (SELECT lang, sum(length(word)) AS chars, count(*) AS words FROM tokens GROUP BY lang, doc_id, line_no)
SELECT lang, round(stddev_pop(chars) / avg(chars), 6) + 0.0 AS cv_chars, round(stddev_pop(words) / avg(words), 6) + 0.0 AS cv_words, round(corr(chars, words), 6) + 0.0 AS r FROM w GROUP BY lang""")
def _(t):
    w = lined(t, "lang").groupBy("lang", "doc_id", "line_no").agg(F.sum(F.length("word")).alias("chars"), F.count("*").alias("words"))
    cv = lambda x: r6(F.stddev_pop(x) / F.avg(x)).alias("cv_" + x)
    return w.groupBy("lang").agg(cv("chars"), cv("words"), r6(F.corr("chars", "words")).alias("r"))


@query("simpson_effective_types", TOK + """, c AS (SELECT source, word, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2), n AS (SELECT source, sum(c) AS n FROM c GROUP BY 1)
SELECT source, round(1 / sum((c / n) * (c / n)), 6) + 0.0 AS effective FROM c JOIN n USING (source) GROUP BY source""")
def _(t):
    c = bare(t, "source").groupBy("source", "word").agg(F.count("*").cast("double").alias("c"))
    n = F.sum("c")
    return c.groupBy("source").agg(r6(n * n / F.sum(F.col("c") * F.col("c"))).alias("effective"))


@query("birthday_keyspace", TOK + """, c AS (SELECT doc_id, word, count(*) AS c FROM tokens GROUP BY 1, 2)
SELECT doc_id, sum(c)::BIGINT AS n, sum(c * (c - 1) // 2)::BIGINT AS pairs, CASE WHEN sum(c * (c - 1) // 2) > 0 THEN round(sum(c) * sum(c) / (2.0::DOUBLE * sum(c * (c - 1) // 2)), 6) + 0.0 END AS keyspace FROM c GROUP BY doc_id""")
def _(t):
    c = bare(t).groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    pairs, n = F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")), F.sum("c")
    return c.groupBy("doc_id").agg(n.alias("n"), pairs.alias("pairs"), F.when(pairs > 0, r6(n * n / (2.0 * pairs))).alias("keyspace"))


@query("repeated_label_surprisal", TOK + """, f AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1), o AS (SELECT word, count(*) AS pages FROM tokens WHERE seq = 0 GROUP BY 1)
SELECT word, pages, round(-log2(n / (SELECT count(*) FROM tokens)::DOUBLE), 6) + 0.0 AS surprisal FROM o JOIN f USING (word) WHERE pages > 1""")
def _(t):
    c = flow(t)
    f = c.groupBy("word").agg(F.count("*").alias("n"), F.sum((F.col("seq") == 0).cast("long")).alias("pages"))
    total = F.broadcast(c.agg(F.count("*").alias("total")))
    return f.where("pages > 1").join(total).select("word", "pages", r6(-F.log2(F.col("n") / F.col("total"))).alias("surprisal"))


@query("unique_fraction", TOK + """, c AS (SELECT source, word, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT source, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS "unique", round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) + 0.0 AS recurring FROM c GROUP BY source""")
def _(t):
    c = bare(t, "source").groupBy("source", "word").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(r6(F.avg((F.col("n") == 1).cast("double"))).alias("unique"), r6(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("recurring"))


@query("ngram_enrichment", TOK + """, l AS (SELECT word, quality FROM tokens JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT quality, substr(w, i, 3) AS g FROM (SELECT quality, '^' || word || '$' AS w, unnest(range(1, length(word) + 1)) AS i FROM l)),
c AS (SELECT g, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM g GROUP BY 1), s AS (SELECT sum(a) AS sa, sum(b) AS sb FROM c)
SELECT g, a, b, round(log2(((a + 1) / (sa + 1)::DOUBLE) / ((b + 1) / (sb + 1)::DOUBLE)), 6) + 0.0 AS enrichment FROM c, s WHERE a + b >= 12""")
def _(t):
    words = bare(t).join(t.labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    g = words.select("quality", F.explode(W.ngrams("word", 3, pad=True)).alias("g"))
    c = g.groupBy("g").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("a"), F.count(F.when(F.col("quality") == 0, 1)).alias("b"))
    s = F.broadcast(c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")))
    return c.where("a + b >= 12").join(s).select("g", "a", "b", r6(F.log2(((F.col("a") + 1) / (F.col("sa") + 1)) / ((F.col("b") + 1) / (F.col("sb") + 1)))).alias("enrichment"))


_GLYPHS = TOK + ", gl AS (SELECT lang, word, length(word) AS n, i, substr(word, i + 1, 1) AS g FROM (SELECT lang, word, unnest(range(length(word))) AS i FROM tokens))"


def glyphs(t) -> DataFrame:
    return corpus(t, "lang").select("lang", "word", F.length("word").alias("n"), F.posexplode(F.split("word", "")).alias("i", "g"))


@query("positional_glyph_entropy", _GLYPHS + """, c AS (SELECT lang, g, least(4, floor(i * 5.0::DOUBLE / n))::INT AS b, count(*)::DOUBLE AS c FROM gl GROUP BY 1, 2, 3), p AS (SELECT lang, g, sum(c) AS m, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 6) + 0.0 AS h FROM p GROUP BY lang""")
def _(t):
    return info.conditional_entropy(glyphs(t).select("lang", "g", W.relative_bin("i", "n").alias("b")), ["b"], ["g"], ["lang"]).select("lang", r6("h").alias("h"))


@query("glyph_entropy_by_place", _GLYPHS + """, c AS (SELECT lang, i, g, count(*)::DOUBLE AS c FROM gl WHERE i < 8 GROUP BY 1, 2, 3)
SELECT lang, i, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS h FROM c GROUP BY 1, 2""")
def _(t):
    return info.entropy(glyphs(t).where("i < 8").select("lang", F.col("i").cast("long").alias("i"), "g"), ["g"], ["lang", "i"]).select("lang", "i", r6("h").alias("h"))


@query("unit_h2", TOK + """, u AS (SELECT lang, list_concat(list_concat(['^'], regexp_extract_all(word, 'c[fkpt]h|ch|sh|.')), ['$']) AS u FROM tokens),
b AS (SELECT lang, u[i] AS x, u[i + 1] AS y FROM (SELECT lang, u, unnest(range(1, len(u))) AS i FROM u)),
c AS (SELECT lang, x, y, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2, 3), p AS (SELECT lang, x, sum(c) AS m, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 6) + 0.0 AS h FROM p GROUP BY lang""")
def _(t):
    u = bare(t, "lang").select("lang", F.concat(F.array(F.lit("^")), W.glyph_units("word"), F.array(F.lit("$"))).alias("u"))
    pairs = u.select("lang", F.explode(F.arrays_zip(F.slice("u", F.lit(1), F.size("u") - 1).alias("x"), F.slice("u", F.lit(2), F.size("u") - 1).alias("y"))).alias("p")).select("lang", "p.*")
    return info.conditional_entropy(pairs, ["y"], ["x"], ["lang"]).select("lang", r6("h").alias("h"))


@query("branching_entropy_top", TOK + """, f AS (SELECT substr(word, 1, i) AS stem, substr(word, i + 1, 1) AS nxt FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM tokens)),
c AS (SELECT stem, CASE WHEN nxt = '' THEN '$' ELSE nxt END AS nxt, count(*)::DOUBLE AS c FROM f GROUP BY 1, 2)
SELECT stem, sum(c)::BIGINT AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS h FROM c GROUP BY 1 HAVING sum(c) >= 20""")
def _(t):
    w = bare(t).groupBy("word").agg(F.count("*").cast("double").alias("k"))
    f = w.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.substring("word", F.lit(1), i).alias("stem"), W.or_none(F.substring("word", i + 1, F.lit(1)), "$").alias("nxt")))).alias("x")).select("k", "x.*")
    c = f.groupBy("stem", "nxt").agg(F.sum("k").alias("c"))
    return info._entropy_of(c, ["stem"], "h").join(c.groupBy("stem").agg(F.sum("c").cast("long").alias("n")).where("n >= 20"), "stem").select("stem", "n", r6("h").alias("h"))


@query("role_battery", CTOK + """, a AS (SELECT *, lead(word) OVER (PARTITION BY conv_id, turn, role ORDER BY pos) AS nxt FROM ctok)
SELECT role, count(*) AS tokens, count(DISTINCT word) AS types, round(avg(length(word)), 6) + 0.0 AS mean_length, round(sum(CASE WHEN nxt = word THEN 1 ELSE 0 END) / count(nxt)::DOUBLE, 6) + 0.0 AS adjacent
FROM a GROUP BY role HAVING count(*) >= 60""")
def _(t):
    c = tokens(t.conversations, "turn", "role", key="conv_id")
    c = c.withColumn("nxt", F.lead("word").over(Window.partitionBy("conv_id", "turn", "role").orderBy("seq")))
    return c.groupBy("role").agg(
        F.count("*").alias("tokens"), F.count_distinct("word").alias("types"), r6(F.avg(F.length("word"))).alias("mean_length"), r6(F.sum((F.col("nxt") == F.col("word")).cast("long")) / F.count("nxt")).alias("adjacent")
    ).where("tokens >= 60")


@query("initial_lift", TOK + """, s AS (SELECT lang, substr(word, 1, 1) AS g, count(*) FILTER (WHERE pos = 0) AS a, count(*) FILTER (WHERE pos > 0) AS b FROM tokens GROUP BY 1, 2),
n AS (SELECT lang, sum(a) AS na, sum(b) AS nb FROM s GROUP BY 1)
SELECT lang, g, a, b, round((a / na::DOUBLE) / greatest(b / nb::DOUBLE, 0.001), 6) + 0.0 AS lift FROM s JOIN n USING (lang) WHERE a >= 5""")
def _(t):
    s = lined(t, "lang").groupBy("lang", F.substring("word", 1, 1).alias("g")).agg(F.count(F.when(F.col("pos") == 0, 1)).alias("a"), F.count(F.when(F.col("pos") > 0, 1)).alias("b"))
    w = Window.partitionBy("lang")
    s = s.withColumns({"na": F.sum("a").over(w), "nb": F.sum("b").over(w)}).where("a >= 5")
    return s.select("lang", "g", "a", "b", r6((F.col("a") / F.col("na")) / F.greatest(F.col("b") / F.col("nb"), F.lit(0.001))).alias("lift"))


@query("entity_pivot", _SLOTS + """, n AS (SELECT core, count(*) AS n, count(DISTINCT prefix) AS prefixes, count(DISTINCT suffix) AS suffixes FROM slots GROUP BY 1 HAVING count(*) >= 10), c AS (SELECT core, 'prefix' AS part, prefix AS value, count(*) AS c FROM slots GROUP BY 1, 2, 3 UNION ALL SELECT core, 'suffix', suffix, count(*) FROM slots GROUP BY 1, 2, 3 UNION ALL SELECT core, 'lang', coalesce(lang, '?'), count(*) FROM slots GROUP BY 1, 2, 3)
SELECT c.core, n, prefixes, suffixes, part, value, c FROM c JOIN n USING (core)""")
def _(t):
    """Counts of a core by prefix, by suffix and by language, as long vectors: any value of any of them."""
    s = slots(bare(t, "lang"), "lang").groupBy("core", "prefix", "suffix", F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("c"))
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(k).alias("value")) for k in ("prefix", "suffix", "lang")]))
    v = s.select("core", "c", part.alias("p")).groupBy("core", "p.part", "p.value").agg(F.sum("c").alias("c"))
    kinds = lambda k: F.count(F.when(F.col("part") == k, 1))
    n = v.groupBy("core").agg(F.sum(F.when(F.col("part") == "lang", F.col("c"))).alias("n"), kinds("prefix").alias("prefixes"), kinds("suffix").alias("suffixes")).where("n >= 10")
    return v.join(n, "core").select("core", "n", "prefixes", "suffixes", "part", "value", "c")


@query("core_concentration", _SLOTS + """, c AS (SELECT core, doc_id, count(*) AS c FROM slots GROUP BY 1, 2), v AS (SELECT core, count(DISTINCT (prefix, suffix)) AS variants FROM slots GROUP BY 1)
SELECT core, sum(c)::BIGINT AS n, variants, round(max(c) / sum(c)::DOUBLE, 6) + 0.0 AS concentration FROM c JOIN v USING (core) GROUP BY core, variants HAVING sum(c) >= 8""")
def _(t):
    s = slots(bare(t), "doc_id")
    c = s.groupBy("core", "doc_id").agg(F.count("*").alias("c"), F.collect_set(F.struct("prefix", "suffix")).alias("v"))
    c = c.groupBy("core").agg(F.sum("c").alias("n"), F.max("c").alias("m"), F.size(F.array_distinct(F.flatten(F.collect_set("v")))).cast("long").alias("variants"))
    return c.where("n >= 8").select("core", "n", "variants", r6(F.col("m") / F.col("n")).alias("concentration"))


@query("document_reach", TOK + """, r AS (SELECT word, count(DISTINCT doc_id) AS df FROM tokens GROUP BY 1)
SELECT count(*) AS types, count(*) FILTER (WHERE df >= 10) AS persistent, count(*) FILTER (WHERE df = 1) AS transient, max(df) AS widest FROM r""")
def _(t):
    r = bare(t).select("word", "doc_id").distinct().groupBy("word").agg(F.count("*").alias("df"))
    return r.agg(F.count("*").alias("types"), F.count(F.when(F.col("df") >= 10, 1)).alias("persistent"), F.count(F.when(F.col("df") == 1, 1)).alias("transient"), F.max("df").alias("widest"))


@query("source_cosine", TOK + """, c AS (SELECT source, word, count(*)::DOUBLE AS c FROM tokens GROUP BY 1, 2), n AS (SELECT source, sqrt(sum(c * c)) AS n FROM c GROUP BY 1),
d AS (SELECT a.source AS a, b.source AS b, sum(a.c * b.c) AS d FROM c a JOIN c b ON a.word = b.word AND a.source < b.source GROUP BY 1, 2)
SELECT a AS source_a, b AS source_b, round(d / (x.n * y.n), 6) + 0.0 AS cosine FROM d JOIN n x ON x.source = a JOIN n y ON y.source = b""")
def _(t):
    c = bare(t, "source").groupBy("source", "word").agg(F.count("*").cast("double").alias("c"))
    n = c.groupBy("source").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    bags = c.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("source", "c"))).alias("b"))  # an entry for each source
    pair = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.greatest(F.size("b") - i - 1, F.lit(0))), lambda y: F.struct(x["source"].alias("source_a"), y["source"].alias("source_b"), (x["c"] * y["c"]).alias("d")))))
    d = bags.where("size(b) > 1").select(F.explode(pair).alias("p")).groupBy("p.source_a", "p.source_b").agg(F.sum("p.d").alias("d"))
    x, y = (n.select(F.col("source").alias("source_" + k), F.col("n").alias("n_" + k)) for k in "ab")
    return d.join(F.broadcast(x), "source_a").join(F.broadcast(y), "source_b").select("source_a", "source_b", r6(F.col("d") / (F.col("n_a") * F.col("n_b"))).alias("cosine"))


@query("transition_support_jaccard", TOK + """, b AS (SELECT DISTINCT lang, word AS x, nxt AS y FROM (SELECT lang, word, lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS nxt FROM tokens) WHERE nxt IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM b),
i AS (SELECT count(*) AS k FROM b p JOIN b q ON p.x = q.x AND p.y = q.y WHERE p.lang = 'en' AND q.lang = 'fr')
SELECT a AS pairs_en, b AS pairs_fr, k AS shared, round(k / (a + b - k)::DOUBLE, 6) + 0.0 AS jaccard FROM s, i""")
def _(t):
    w = Window.partitionBy("doc_id", "line_no").orderBy("pos")
    b = lined(t, "lang").where("lang in ('en', 'fr')").withColumn("y", F.lead("word").over(w)).where("y is not null")
    b = b.groupBy("word", "y").agg(F.max((F.col("lang") == "en").cast("int")).alias("e"), F.max((F.col("lang") == "fr").cast("int")).alias("f"))
    s = b.agg(F.sum("e").alias("pairs_en"), F.sum("f").alias("pairs_fr"), F.sum(F.col("e") * F.col("f")).alias("shared"))
    return s.withColumn("jaccard", r6(F.col("shared") / (F.col("pairs_en") + F.col("pairs_fr") - F.col("shared"))))


@query("page_text_statistics", TOK + """, c AS (SELECT doc_id, word, count(*) AS c FROM tokens GROUP BY 1, 2), p AS (SELECT doc_id, count(*) AS types, count(*) FILTER (WHERE c = 1) AS once FROM c GROUP BY 1)
SELECT doc_id, count(*) AS tokens, types, round(types / count(*)::DOUBLE, 6) + 0.0 AS ttr, round(once / types::DOUBLE, 6) + 0.0 AS hapax, round(avg(length(word)), 6) + 0.0 AS mean_length, round(stddev_pop(length(word)), 6) + 0.0 AS sd_length,
count(DISTINCT line_no) AS lines, round(avg(CASE WHEN regexp_matches(word, '[ktpf]') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS gallows FROM tokens JOIN p USING (doc_id) GROUP BY doc_id, types, once""")
def _(t):
    c = lined(t).groupBy("doc_id", "word").agg(F.count("*").alias("c"), F.collect_set("line_no").alias("ls"))
    n, k = F.length("word").cast("double"), F.col("c").cast("double")
    out = c.groupBy("doc_id").agg(
        F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.sum(n * k).alias("s1"), F.sum(n * n * k).alias("s2"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ls")))).cast("long").alias("lines"), F.sum(F.when(W.has_gallows("word"), k).otherwise(0.0)).alias("g"),
    )
    m = F.col("s1") / F.col("tokens")
    return out.select("doc_id", "tokens", "types", r6(F.col("types") / F.col("tokens")).alias("ttr"), r6(F.col("once") / F.col("types")).alias("hapax"), r6(m).alias("mean_length"), r6(F.sqrt(F.greatest(F.col("s2") / F.col("tokens") - m * m, F.lit(0.0)))).alias("sd_length"), "lines", r6(F.col("g") / F.col("tokens")).alias("gallows"))


@query("word_split_counts", TOK + """, w AS (SELECT word, count(*) AS c FROM tokens GROUP BY 1), s AS (SELECT substr(word, 1, i) AS l, substr(word, i + 1) AS r, c FROM (SELECT word, c, unnest(range(1, length(word))) AS i FROM w))
SELECT 'left' AS side, l AS part, sum(c)::BIGINT AS tokens, count(DISTINCT r) AS types FROM s GROUP BY l HAVING sum(c) >= 50 UNION ALL SELECT 'right', r, sum(c)::BIGINT, count(DISTINCT l) FROM s GROUP BY r HAVING sum(c) >= 50""")
def _(t):
    w = bare(t).groupBy("word").agg(F.count("*").alias("c")).where(F.length("word") > 1)
    cut = lambda i: F.struct(F.substring("word", F.lit(1), i).alias("l"), F.substring("word", i + 1, F.length("word")).alias("r"))
    s = w.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), cut)).alias("x"))
    s = s.select("c", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("x.l").alias("part")), F.struct(F.lit("right").alias("side"), F.col("x.r").alias("part")))).alias("y"))
    return s.groupBy("y.side", "y.part").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).where("tokens >= 50")


@query("canonical_form", _SLOTS + """, c AS (SELECT core, word, count(*) AS c FROM slots GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY c DESC, word) AS k FROM c)
SELECT core, word, c FROM r WHERE k = 1""")
def _(t):
    c = slots(bare(t)).groupBy("core", "word").agg(F.count("*").alias("c"))
    return c.groupBy("core").agg(F.min(F.struct((-F.col("c")).alias("k"), "word")).alias("m")).select("core", "m.word", (-F.col("m.k")).alias("c"))


@query("length_percentiles", TOK + "SELECT lang, round(quantile_cont(length(word), 0.025), 6) + 0.0 AS p025, round(quantile_cont(length(word), 0.5), 6) + 0.0 AS p50, round(quantile_cont(length(word), 0.975), 6) + 0.0 AS p975 FROM tokens GROUP BY lang")
def _(t):
    q = lambda p, n: r6(F.percentile(F.length("word"), p)).alias(n)
    return bare(t, "lang").groupBy("lang").agg(q(0.025, "p025"), q(0.5, "p50"), q(0.975, "p975"))


@query("stratified_mi_prefix_suffix", _SLOTS + """, j AS (SELECT source, prefix AS x, suffix AS y, count(*)::DOUBLE AS c FROM slots GROUP BY 1, 2, 3), n AS (SELECT source, sum(c) AS n, sum(c * log2(c)) AS s FROM j GROUP BY 1),
a AS (SELECT source, sum(m * log2(m)) AS s FROM (SELECT source, x, sum(c) AS m FROM j GROUP BY 1, 2) GROUP BY 1), b AS (SELECT source, sum(m * log2(m)) AS s FROM (SELECT source, y, sum(c) AS m FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT round(sum((log2(n) + (n.s - a.s - b.s) / n) * n) / sum(n), 6) + 0.0 AS mi FROM n JOIN a USING (source) JOIN b USING (source)""")
def _(t):
    return info.stratified_mi(slots(bare(t, "source"), "source"), "prefix", "suffix", ["source"]).select(r6("mi").alias("mi"))


@query("interslot_nmi_parts", "WITH f AS (SELECT p_brand AS a, p_type AS b, p_size AS c FROM part), " + " ".join(f"""
{n}j AS (SELECT {x}::VARCHAR AS x, {y}::VARCHAR AS y, count(*)::DOUBLE AS c FROM f GROUP BY 1, 2), {n}x AS (SELECT sum(m * log2(m)) AS s, log2(sum(m)) - sum(m * log2(m)) / sum(m) AS h FROM (SELECT x, sum(c) AS m FROM {n}j GROUP BY 1)),
{n}y AS (SELECT sum(m * log2(m)) AS s, log2(sum(m)) - sum(m * log2(m)) / sum(m) AS h FROM (SELECT y, sum(c) AS m FROM {n}j GROUP BY 1)), {n}n AS (SELECT sum(c) AS n, sum(c * log2(c)) AS s FROM {n}j),""" for n, x, y in (("p", "a", "b"), ("q", "a", "c"), ("r", "b", "c"))) + """
u AS (SELECT 'brand-type' AS pair, log2(n) + (pn.s - px.s - py.s) / n AS mi, least(px.h, py.h) AS h FROM pn, px, py UNION ALL SELECT 'brand-size', log2(n) + (qn.s - qx.s - qy.s) / n, least(qx.h, qy.h) FROM qn, qx, qy UNION ALL SELECT 'type-size', log2(n) + (rn.s - rx.s - ry.s) / n, least(rx.h, ry.h) FROM rn, rx, ry)
SELECT pair, round(mi, 6) + 0.0 AS mi, round(mi / h, 6) + 0.0 AS nmi FROM u""")
def _(t):
    p = t.part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    pair = lambda a, b: F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y"))
    rows = p.select(F.explode(F.array(pair("brand", "type"), pair("brand", "size"), pair("type", "size"))).alias("r")).select("r.*")
    return info.mutual_information(rows, "x", "y", ["pair"]).join(info.normalized_mi(rows, "x", "y", ["pair"]), "pair").select("pair", r6("mi").alias("mi"), r6("nmi").alias("nmi"))
