"""Queries: the source functions on lines, documents and marks that are written from the tables, so that SQL can tell what they must read."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import words as W
from lexiloom.operators.info import r6
from lexiloom.plans.base import TOK, WORD, query
from lexiloom.plans.lexical import bare, lined
from lexiloom.sources import archives, markup

_PLAIN = "regexp_replace(lower(text), '[^a-z]', ' ', 'g')"


def _marked(word: Column, i: Column) -> Column:
    """A word with markup that the reader must take away, by its place."""
    return (
        F.when(i % 7 == 2, F.concat(F.lit("["), word, F.lit(":zz]"))).when(i % 7 == 3, F.concat(word, F.lit("{note}"))).when(i % 7 == 4, F.concat(F.lit("<!c>"), word, F.lit("!")))
        .when(i % 7 == 5, F.concat(word, F.lit("*"))).otherwise(word)
    )


def _transcribed(t):
    """(line_no, line): an interlinear transcription of the documents by two hands, with page headers and notes."""
    ws = F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1))
    folio = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("r"))
    lines = t.documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", "i", ws.alias("ws"))
    body = F.concat_ws(".", F.transform("ws", _marked))
    at = F.concat(F.lit("<"), folio, F.lit("."), (F.col("i") + 1).cast("string"), F.lit(",@P0;"))
    text = F.array(F.concat(at, F.lit("H>  "), body), F.concat(at, F.lit("C>  other.hand")), F.lit("# a note"))
    head = t.documents.select(F.lit(-1).alias("line_no"), F.concat(F.lit("<"), folio, F.lit(">  <! $I="), F.coalesce("lang", F.lit("?")), F.lit(" $Q="), F.coalesce("source", F.lit("?")), F.lit(">")).alias("line"))
    return lines.select(F.col("i").alias("line_no"), F.explode(text).alias("line")).unionByName(head)


@query("read_transcription", TOK + """, w AS (SELECT doc_id, line_no, string_agg(CASE WHEN pos % 7 = 5 THEN word || '?' ELSE word END, ' ' ORDER BY pos) AS words, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT 'f' || doc_id || 'r' AS folio, (line_no + 1)::INT AS line, '@P0' AS locus, n, md5(words) AS digest FROM w""")
def _(t):
    """Lines of one transcriber, cleaned of markup, comments and variants."""
    rows = markup.transcription(_transcribed(t))
    return rows.select("folio", "line", "locus", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest"))


@query("read_page_headers", "SELECT 'f' || doc_id || 'r' AS folio, coalesce(lang, '?') AS dialect, coalesce(source, '?') AS quire FROM documents")
def _(t):
    """Key-value pairs of page headers."""
    return markup.page_headers(_transcribed(t)).select("folio", F.col("meta")["I"].alias("dialect"), F.col("meta")["Q"].alias("quire"))


@query("read_tiers", "WITH e AS (SELECT user_id, event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS tier FROM events) SELECT tier, count(*) AS n FROM e GROUP BY 1")
def _(t):
    """The last comment carried to the rows behind it."""
    e = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("comment"))
    return markup.tiers(e, "user_id", "event_id").groupBy("tier").agg(F.count("*").alias("n"))


@query("read_json_corpus", TOK + "SELECT coalesce(lang, '?') AS dialect, count(DISTINCT (doc_id, line_no)) AS lines, count(*) AS words FROM tokens GROUP BY 1")
def _(t):
    """Corpus documents, JSON maps by folio, opened to lines."""
    ws = lambda x: F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1))
    lines = F.transform(F.split(F.lower("text"), "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.lit("@P0").alias("locus"), ws(x).alias("words")))
    folio = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    doc = F.to_json(F.struct(F.create_map(folio, F.create_map(F.lit("L"), F.coalesce("lang", F.lit("?")))).alias("meta"), F.create_map(folio, lines).alias("folios")))
    read = t.documents.where("text is not null").select(F.from_json(doc, markup.CORPUS).alias("d")).select("d.*")
    rows = markup.corpus_lines(read).where(F.size("words") > 0)
    return rows.groupBy(F.col("meta")["L"].alias("dialect")).agg(F.count("*").alias("lines"), F.sum(F.size("words")).alias("words"))


@query("read_token_document", TOK + "SELECT coalesce(source, '?') AS quire, count(*) AS tokens, count(*) FILTER (WHERE pos = 0) AS first_words FROM tokens WHERE length(word) > 1 AND coalesce(lang, '?') <> 'fr' GROUP BY 1")
def _(t):
    """Token documents with metadata, by role and certainty."""
    fields = [F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("folio"), F.col("line_no").cast("int").alias("line"), "pos", (F.length("word") < 2).alias("uncertain"), F.coalesce("lang", F.lit("?")).alias("role"), F.coalesce("source", F.lit("?")).alias("quire"), "word"]
    rows = lined(t, "lang", "source").select(*fields)
    doc = F.to_json(F.struct(F.array(F.struct("folio", "line", F.col("pos").alias("linepos"), "word", "uncertain", "role", "quire")).alias("tokens")))
    read = rows.select(F.from_json(doc, T.StructType([T.StructField("tokens", T.ArrayType(markup.TOKEN))])).alias("d")).select("d.tokens")
    return markup.certain_tokens(read).where("role <> 'fr'").groupBy("quire").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("linepos") == 0, 1)).alias("first_words"))


@query("read_plain_words", f"WITH w AS (SELECT item_id, list_filter(string_split_regex({_PLAIN}, ' +'), lambda x: x <> '') AS ws FROM benchmark) SELECT item_id, len(ws) AS n, array_to_string(ws[1:5], ' ') AS head FROM w")
def _(t):
    """Control texts as words of a to z."""
    ws = markup.plain_words("text")
    return t.benchmark.select("item_id", F.size(ws).cast("long").alias("n"), F.array_join(markup.plain_words("text", 5), " ").alias("head"))


@query("read_book_body", "SELECT item_id, length(text) + 2 AS n, md5(chr(10) || text || chr(10)) AS digest FROM benchmark")
def _(t):
    """The text between the marks of an e-book."""
    book = F.concat(F.lit("Title\n*** START OF THE BOOK ***\n"), "text", F.lit("\n*** END OF THE BOOK ***\nlicence"))
    body = markup.book_body(book)
    return t.benchmark.select("item_id", F.length(body).cast("long").alias("n"), F.md5(body.cast("binary")).alias("digest"))


@query("read_latin_letters", f"""WITH a AS (SELECT lang, translate(lower(text), '{markup.ACCENTS[0]}', '{markup.ACCENTS[1]}') AS x FROM documents WHERE text IS NOT NULL), b AS (SELECT lang, x, regexp_replace(replace(replace(translate(x, 'jvwk', 'iuuc'), 'æ', 'ae'), 'œ', 'oe'), '[^a-z]', '', 'g') AS y FROM a)
SELECT lang, count(*) AS docs, sum(length(y))::BIGINT AS letters, sum(length(y) - length(replace(y, 'u', '')))::BIGINT AS u, bit_xor(('0x' || substr(md5(y), 1, 15))::BIGINT) AS digest, bit_xor(('0x' || substr(md5(x), 1, 15))::BIGINT) AS plain FROM b GROUP BY 1""")
def _(t):
    """Letters without accents, and in Latin spelling."""
    d = t.documents.where("text is not null").select("lang", markup.strip_accents("text").alias("x"), markup.latin_letters("text").alias("y"))
    mark = lambda c: F.bit_xor(F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 15), 16, 10).cast("long"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("y")).alias("letters"), F.sum(F.length("y") - F.length(F.replace("y", F.lit("u"), F.lit("")))).alias("u"), mark("y").alias("digest"), mark("x").alias("plain"))


@query("read_unicode_words", r"SELECT lang, sum(len(regexp_extract_all(lower(text), '\p{L}+')))::BIGINT AS words FROM documents GROUP BY 1")
def _(t):
    """Words of letters of any alphabet."""
    n = F.when(F.col("text").isNotNull(), F.size(markup.unicode_words("text")))
    return t.documents.groupBy("lang").agg(F.sum(n).alias("words"))


@query("read_expansions", TOK + "SELECT substr(word, 1, 2) || right(word, 1) AS visible, substr(word, 3, length(word) - 3) AS omitted, word AS expanded, count(*) AS n FROM tokens WHERE length(word) > 4 AND pos = 0 GROUP BY ALL")
def _(t):
    """Marked expansions: what is written, what is left out, and the whole word."""
    w = F.col("word")
    mark = F.concat(F.lit("x <expan>"), F.substring(w, 1, 2), F.lit("<ex>"), F.substring(w, F.lit(3), F.length(w) - 3), F.lit("</ex>"), F.right(w, F.lit(1)), F.lit("</expan> y"))
    rows = lined(t).where("length(word) > 4 and pos = 0").select(F.explode(markup.expansions(mark)).alias("e")).select("e.*")
    return rows.groupBy("visible", "omitted", "expanded").agg(F.count("*").alias("n"))


@query("read_canvas_order", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 10 = 1")
def _(t):
    """Pages of a customer's orders as a list of views, covers left out."""
    label = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Front COVER")).otherwise(F.col("o_orderkey").cast("string"))
    row = F.array(F.when(F.col("o_orderkey") % 3 == 0, F.lit("Spine")).otherwise(label), F.lit("10"), F.lit("20"), F.lit("u"))
    d = t.orders.where("o_custkey % 10 = 1").groupBy("o_custkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"])).alias("doc"))
    return d.select("o_custkey", F.explode(markup.canvas_order("doc")).alias("p")).select("o_custkey", F.col("p.label").cast("long").alias("o_orderkey"), "p.page")


@query("read_first_by", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(t):
    """The first row of each key."""
    return markup.first_by(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("read_normalized", r"SELECT lang, count(*) AS docs, bit_xor(('0x' || substr(md5(trim(regexp_replace(nfc_normalize(text), '[ \t\n\r]+', ' ', 'g'))), 1, 15))::BIGINT) AS digest FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(t):
    """Texts in composed form with white space squeezed."""
    d = t.documents.where("text is not null").select("lang", archives.normalized("text").alias("x"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.bit_xor(F.conv(F.substring(F.md5(F.col("x").cast("binary")), 1, 15), 16, 10).cast("long")).alias("digest"))


# Labels of loci, folios and periods ------------------------------------------------------------------------------------


@query("folio_columns", """WITH f AS (SELECT doc_id, 'f' || (1 + doc_id % 116) || CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE 'v' END || CASE WHEN doc_id % 7 = 0 THEN '2' ELSE '' END AS folio, 1 + doc_id % 116 AS n, CASE doc_id % 4 WHEN 0 THEN '@P0' WHEN 1 THEN '+Lx' WHEN 2 THEN '=Cc' ELSE '12' END AS locus FROM documents)
SELECT doc_id, folio, CASE doc_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'L' WHEN 2 THEN 'C' ELSE '?' END AS locus_type, CASE WHEN n <= 66 THEN 'herbal' WHEN n <= 73 THEN 'astro' WHEN n <= 84 THEN 'bio' WHEN n <= 86 THEN 'cosmo' WHEN n <= 102 THEN 'pharma' ELSE 'recipes' END AS section,
n AS number, (doc_id % 2)::INT AS side, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS panel, (CASE WHEN n < 12 THEN 2 * n ELSE 2 * n - 2 END + doc_id % 2)::INT AS page FROM f""")
def _(t):
    """Section, order, leaf and facsimile page of a folio; type of a locus."""
    number = (1 + F.col("doc_id") % 116).cast("string")
    folio = F.concat(F.lit("f"), number, F.when(F.col("doc_id") % 2 == 0, "r").otherwise("v"), F.when(F.col("doc_id") % 7 == 0, "2").otherwise(""))
    locus = F.element_at(F.array(F.lit("@P0"), F.lit("+Lx"), F.lit("=Cc"), F.lit("12")), (F.col("doc_id") % 4 + 1).cast("int"))
    d = t.documents.select("doc_id", folio.alias("folio"), locus.alias("locus")).withColumn("k", W.folio_key("folio"))
    return d.select("doc_id", "folio", W.locus_type("locus").alias("locus_type"), W.section("folio").alias("section"), F.col("k.number").alias("number"), F.col("k.side").alias("side"), F.col("k.panel").cast("int").alias("panel"), W.facsimile_page("folio").cast("int").alias("page"))


@query("roman_periods", """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'XII' WHEN 1 THEN 'XIII-XIV' WHEN 2 THEN 'xv' WHEN 3 THEN 'XVI-XVII' ELSE 'IX-XVI' END AS period, CASE doc_id % 4 WHEN 0 THEN 'xliv' WHEN 1 THEN 'MCMXC' WHEN 2 THEN 'ix' ELSE 'no' END AS numeral FROM documents)
SELECT period, numeral, doc_id % 5 IN (1, 2, 4) AS meets, CASE doc_id % 4 WHEN 0 THEN 44 WHEN 1 THEN 1990 WHEN 2 THEN 9 END AS value, count(*) AS n FROM p GROUP BY ALL""")
def _(t):
    """Roman numerals and the centuries they name."""
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % n + 1).cast("int"))
    d = t.documents.select(pick(5, "XII", "XIII-XIV", "xv", "XVI-XVII", "IX-XVI").alias("period"), pick(4, "xliv", "MCMXC", "ix", "no").alias("numeral"))
    return d.groupBy("period", "numeral", W.period_meets("period").alias("meets"), W.roman_to_int("numeral").alias("value")).agg(F.count("*").alias("n"))


@query("tertiles_and_deltas", TOK + """, d AS (SELECT source, doc_id, avg(length(word)) AS x FROM tokens WHERE source IS NOT NULL GROUP BY 1, 2), q AS (SELECT quantile_cont(x, 1/3) AS a, quantile_cont(x, 2/3) AS b, stddev_pop(x) AS s FROM d), l AS (SELECT d.*, x - lag(x) OVER (PARTITION BY source ORDER BY doc_id) AS y FROM d)
SELECT CASE WHEN x <= a THEN 'low' WHEN x <= b THEN 'mid' ELSE 'high' END AS tertile, CASE WHEN y IS NULL THEN 'none' WHEN abs(y) <= 0.02 * s THEN 'same' WHEN y > 0 THEN 'up' ELSE 'down' END AS delta, count(*) AS n FROM l, q GROUP BY 1, 2""")
def _(t):
    """Thirds of the documents by mean word length, and whether it rises or falls from document to document of a source."""
    d = bare(t, "source").where("source is not null").groupBy("source", "doc_id").agg(F.avg(F.length("word")).alias("x"))
    q = d.agg(F.percentile("x", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.stddev_pop("x").alias("s"))
    l = d.withColumn("before", F.lag("x").over(Window.partitionBy("source").orderBy("doc_id"))).join(F.broadcast(q))  # noqa: E741  one row
    delta = F.when(F.col("before").isNull(), "none").otherwise(W.delta_sign(F.col("x"), F.col("before"), F.col("s")))
    return l.groupBy(W.tertile("x", F.col("q")[0], F.col("q")[1]).alias("tertile"), delta.alias("delta")).agg(F.count("*").alias("n"))


@query("gap_bins", "WITH g AS (SELECT event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap, value FROM events), d AS (SELECT CASE WHEN gap IS NULL THEN 'none' WHEN gap <= 1 THEN '1' WHEN gap <= 4 THEN '2-4' WHEN gap <= 16 THEN '5-16' ELSE '17+' END AS bin, value FROM g) SELECT bin, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM d GROUP BY 1")
def _(t):
    """Gaps between events in coarse bins."""
    g = t.events.withColumn("gap", F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    return g.groupBy(W.gap_bin("gap").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("line_slots", TOK + "SELECT CASE WHEN pos = n_line - 1 THEN 'last' WHEN pos < 5 THEN 'p' || pos ELSE 'mid' END AS slot, count(*) AS n, round(avg(length(word)), 6) + 0.0 AS mean FROM tokens GROUP BY 1")
def _(t):
    """Places of a line by name: the first five, the middle, the last."""
    return lined(t).groupBy(W.line_slot("pos", "n_line").alias("slot")).agg(F.count("*").alias("n"), r6(F.avg(F.length("word"))).alias("mean"))


@query("ring_jaccard", TOK + """, v AS (SELECT DISTINCT doc_id, word FROM tokens), n AS (SELECT doc_id, count(*) AS n FROM v GROUP BY 1), s AS (SELECT a.doc_id, count(*) AS s FROM v a JOIN v b ON b.doc_id = a.doc_id + 1 AND a.word = b.word GROUP BY 1)
SELECT x.doc_id, round(coalesce(s, 0) / (x.n + y.n - coalesce(s, 0))::DOUBLE, 6) + 0.0 AS jaccard, round(2 * pi() * (x.doc_id % 12) / 12, 6) + 0.0 AS angle FROM n x JOIN n y ON y.doc_id = x.doc_id + 1 LEFT JOIN s ON s.doc_id = x.doc_id""")
def _(t):
    """Likeness of the vocabularies of neighbouring documents, and their angle on a ring of twelve."""
    v = bare(t).groupBy("doc_id").agg(F.collect_set("word").alias("ws"))
    j = v.join(v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("vs")), "doc_id")
    return j.select("doc_id", r6(W.jaccard("ws", "vs")).alias("jaccard"), r6(W.ring_angle(F.col("doc_id") % 12, F.lit(12))).alias("angle"))
