"""Queries: text read in other ways. Programs over numbered words, strides, reading orders, bit and slot streams, caches by unit, surrogates, parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import words as W
from lexiloom.operators import bags, programs, sequence, state
from lexiloom.operators.generate import chain_word, letter_chains, turn, wheel
from lexiloom.operators.info import r6
from lexiloom.plans.base import TOK, WORD, query, slots_sql
from lexiloom.plans.lexical import bare, corpus, flow, lined, slots

_H = "round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS h"


def _h(c: str = "c") -> Column:
    n = F.col(c).cast("double")
    return r6(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n))


# Programs ------------------------------------------------------------------------------------------------------------

#: Programs modulo 23 over a line of numbers, x + a * previous + b * first + c * index; and whether the first word is left out.
AFFINE = {
    "direct": (0, 0, 0, False), "position_plus": (0, 0, 1, False), "position_minus": (0, 0, -1, False), "lag_minus": (-1, 0, 0, True), "lag_plus": (1, 0, 0, True), "seed_minus": (0, -1, 0, True),
    "seed_plus": (0, 1, 0, True), "lag_minus_seed_plus": (-1, 1, 0, True), "lag_minus_seed_minus": (-1, -1, 0, True), "lag_plus_seed_minus": (1, -1, 0, True),
    "lag_minus_position_plus": (-1, 0, 1, True), "lag_minus_position_minus": (-1, 0, -1, True),
}
_MOD = "(({0}) % 23 + 23) % 23"


def _program_sql() -> str:
    cols = [f"CASE WHEN i >= {int(skip)} THEN {_MOD.format(f'x + {a} * prev + {b} * seed + {c} * i')} END" for a, b, c, skip in AFFINE.values()]
    cols += [_MOD.format("run"), _MOD.format("-run"), f"CASE WHEN i >= 1 THEN {_MOD.format('run')} END"]
    names = [*AFFINE, "running_plus", "running_minus", "seeded_running_plus"]
    return TOK + f""", v AS (SELECT doc_id, line_no, pos AS i, length(word) % 23 AS x FROM tokens), p AS (SELECT *, coalesce(lag(x) OVER w, 0) AS prev, first_value(x) OVER w AS seed, sum(x) OVER w AS run FROM v WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
s AS (SELECT unnest([{", ".join(repr(n) for n in names)}]) AS program, unnest([{", ".join(f"({c})::INT" for c in cols)}]) AS symbol FROM p), c AS (SELECT program, symbol, count(*) AS c FROM s WHERE symbol IS NOT NULL GROUP BY 1, 2) SELECT program, sum(c)::BIGINT AS n, count(*) AS symbols, {_H} FROM c GROUP BY 1"""


@query("program_streams", _program_sql())
def _(t):
    """All fifteen modular programs over the word lengths of a line: symbols and their entropy."""
    v = lined(t).withColumn("x", W.numeric_feature("word", "length"))
    by, m = ["doc_id", "line_no"], 23
    made = {n: (programs.affine("x", by, "pos", a, b, c, m), skip) for n, (a, b, c, skip) in AFFINE.items()}
    made |= {"running_plus": (programs.running("x", by, "pos", 1, m), False), "running_minus": (programs.running("x", by, "pos", -1, m), False), "seeded_running_plus": (programs.running("x", by, "pos", 1, m), True)}
    v = v.select("pos", *[f.alias(n) for n, (f, _) in made.items()])
    each = F.array(*[F.struct(F.lit(n).alias("program"), (F.when(F.col("pos") >= 1, F.col(n)) if skip else F.col(n)).alias("symbol")) for n, (_, skip) in made.items()])
    c = v.select(F.explode(each).alias("s")).where("s.symbol is not null").groupBy("s.program", "s.symbol").agg(F.count("*").alias("c"))
    return c.groupBy("program").agg(F.sum("c").alias("n"), F.count("*").alias("symbols"), _h().alias("h"))


# Strides ---------------------------------------------------------------------------------------------------------------

MODES = ("all", "odd", "even", "first", "last", "middle")
_LETTERS_OF = {
    "all": "word", "odd": "array_to_string(list_filter(string_split(word, ''), lambda x, i: i % 2 = 1), '')", "even": "array_to_string(list_filter(string_split(word, ''), lambda x, i: i % 2 = 0), '')",
    "first": "substr(word, 1, 1)", "last": "right(word, 1)", "middle": "substr(word, (length(word) - 1) // 2 + 1, 1)",
}
#: The least common multiple of the strides 2 to 6: a word's place modulo it settles its channel in all of them.
CYCLE = 60


def _stride_sql() -> str:
    modes = f"unnest([{', '.join(repr(m) for m in MODES)}]) AS mode, unnest([{', '.join(_LETTERS_OF[m] for m in MODES)}]) AS x"
    return TOK + f""", g AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS at_, max(pos) OVER (PARTITION BY doc_id, line_no) AS top FROM tokens),
w AS (SELECT 'global_word/' || k || ':' || at_ % k AS channel, word FROM g, range(2, 7) r(k) UNION ALL SELECT 'line_word/' || k || ':' || pos % k, word FROM g, range(2, 7) r(k) UNION ALL SELECT 'line/firstword', word FROM g WHERE pos = 0 UNION ALL SELECT 'line/lastword', word FROM g WHERE pos = top UNION ALL SELECT 'all_words', word FROM g),
d AS (SELECT channel, word, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT channel, n, {modes} FROM d),
l AS (SELECT channel || '/' || mode AS channel, n, unnest(string_split(x, '')) AS s FROM m WHERE channel <> 'all_words' OR mode IN ('first', 'last', 'middle')),
b AS (SELECT at_, word, sum(length(word)) OVER (ORDER BY at_) - length(word) AS start FROM g), lg AS (SELECT start + i - 1 AS j, substr(word, i::INT, 1) AS s FROM (SELECT start, word, unnest(range(1, length(word) + 1)) AS i FROM b)),
u AS (SELECT channel, s, sum(n) AS c FROM l WHERE s <> '' GROUP BY 1, 2 UNION ALL SELECT 'global_glyph/' || k || ':' || j % k, s, count(*) FROM lg, range(2, 13) r(k) GROUP BY 1, 2)
SELECT channel, sum(c)::BIGINT AS n, count(*) AS letters, {_H} FROM u GROUP BY 1"""


@query("all_stride_channels", _stride_sql())
def _(t):
    """Letters of every k-th word or letter, through the corpus or anew on each line, and of the words at the lines' edges: all 332 channels and their entropy.

    Words are counted by their place modulo 60 before they are dealt to strides. Places in the corpus come from the
    words and letters of the documents before (`sequence.offsets`), so no task holds the whole order.
    """
    c = corpus(t)
    sizes = c.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))
    block = F.floor(F.col("doc_id") / 4096)
    at = sequence.offsets(sequence.offsets(sizes, [], "doc_id", "words", block, "before"), [], "doc_id", "chars", block, "chars_before").select("doc_id", "before", "chars_before")
    w = c.join(at, "doc_id")
    top = F.col("pos") == F.col("n_line") - 1
    kinds = F.array(
        F.struct(F.lit("global_word").alias("kind"), ((F.col("before") + F.col("seq")) % CYCLE).cast("int").alias("place")), F.struct(F.lit("line_word").alias("kind"), (F.col("pos") % CYCLE).cast("int").alias("place")),
        F.struct(F.when(F.col("pos") == 0, "line/firstword").alias("kind"), F.lit(0).alias("place")), F.struct(F.when(top, "line/lastword").alias("kind"), F.lit(0).alias("place")),
    )
    d = w.select("word", F.explode(kinds).alias("k")).where("k.kind is not null").groupBy("k.kind", "k.place", "word").agg(F.count("*").alias("n"))
    # every word has a place in the corpus, so that kind holds all words
    strides = F.transform(F.array(*map(F.lit, range(2, 7))), lambda k: F.concat(F.col("kind"), F.lit("/"), k.cast("string"), F.lit(":"), (F.col("place") % k).cast("string")))
    names = F.when(F.col("kind") == "global_word", F.concat(strides, F.array(F.lit("all_words")))).when(F.col("kind") == "line_word", strides).otherwise(F.array(F.col("kind")))
    d = d.select("word", "n", F.explode(names).alias("channel")).groupBy("channel", "word").agg(F.sum("n").alias("n"))
    shown = F.array(*[F.struct(F.lit(m).alias("mode"), W.choose_letters("word", m).alias("x")) for m in MODES])
    m = d.select("channel", "n", F.explode(shown).alias("m")).where("channel <> 'all_words' or m.mode in ('first', 'last', 'middle')")
    words = m.select(F.concat("channel", F.lit("/"), "m.mode").alias("channel"), "n", F.explode(F.split("m.x", "")).alias("s")).where("s <> ''").groupBy("channel", "s").agg(F.sum("n").alias("c"))
    inside = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    l = w.withColumn("start", F.col("chars_before") + F.coalesce(F.sum(F.length("word")).over(inside), F.lit(0))).select("start", F.posexplode(F.split("word", "")).alias("i", "s"))  # noqa: E741
    l = l.select("s", ((F.col("start") + F.col("i")) % 27720).cast("int").alias("j"), F.explode(F.sequence(F.lit(2), F.lit(12))).alias("k"))  # noqa: E741
    glyphs = l.groupBy(F.concat(F.lit("global_glyph/"), F.col("k").cast("string"), F.lit(":"), (F.col("j") % F.col("k")).cast("string")).alias("channel"), "s").agg(F.count("*").alias("c"))
    return words.unionByName(glyphs).groupBy("channel").agg(F.sum("c").alias("n"), F.count("*").alias("letters"), _h().alias("h"))


# Reading orders --------------------------------------------------------------------------------------------------------

LINE_MODES = ("forward", "reverse", "even_odd", "odd_even")
ROW_MODES = ("forward", "reverse_words", "reverse_word_chars", "reverse_all", "boustro_words", "boustro_words_chars", "boustro_chars")
COLUMN_MODES = ("left_right", "right_left", "boustro_left", "boustro_right")


def _reordered(items: Column, mode: str) -> Column:
    """An array in one of the LINE_MODES."""
    every = lambda odd: F.filter(items, lambda x, i: i % 2 == odd)
    return {"forward": items, "reverse": F.reverse(items), "even_odd": F.concat(every(0), every(1)), "odd_even": F.concat(every(1), every(0))}[mode]


def _row(words: Column, i: Column, mode: str) -> Column:
    """The text of a line of words, the i-th from 0, in one of the ROW_MODES."""
    joined = F.array_join(words, "")
    mirrored = F.array_join(F.transform(words, F.reverse), "")
    odd = lambda a, b: F.when(i % 2 == 1, a).otherwise(b)
    return {
        "forward": joined, "reverse_words": F.array_join(F.reverse(words), ""), "reverse_word_chars": mirrored, "reverse_all": F.reverse(joined), "boustro_words": odd(F.array_join(F.reverse(words), ""), joined),
        "boustro_words_chars": odd(F.array_join(F.reverse(F.transform(words, F.reverse)), ""), mirrored), "boustro_chars": odd(F.reverse(joined), joined),
    }[mode]


def _rows(mode: str):
    return lambda ws, i: _row(ws, i, mode)


def _columns(rows: str, mode: str) -> Column:
    """A ragged array (a column) of arrays of strings, read by columns in one of the COLUMN_MODES."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    order = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    order = F.reverse(order) if mode in ("right_left", "boustro_right") else order

    def column(at: Column, i: Column) -> Column:
        cells = F.transform(F.filter(rows, lambda r: F.size(r) > at), lambda r: F.get(r, at))
        return F.array_join(F.when(i % 2 == 1, F.reverse(cells)).otherwise(cells), "") if mode.startswith("boustro") else F.array_join(cells, "")

    return F.array_join(F.transform(order, column), "")


def reading_texts(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """pages with column texts: a map of the letters of a page (an array of lines, each an array of words) in 52 orders, by name.

    With the four orders of pages (`folio_orders`) these make 208 channels. What orders share is a column of its own, so
    that it is made once.
    """
    shown = {f"lines_{lm}": _reordered(F.col(lines), lm) for lm in LINE_MODES}
    words = {"chars": F.col(lines), "reverse_chars": F.transform(lines, lambda ws: F.transform(ws, F.reverse)), "glyphs": F.transform(lines, lambda ws: F.split(F.array_join(ws, ""), ""))}
    shown |= {f"top_bottom_{k}": v for k, v in words.items()} | {f"bottom_top_{k}": F.reverse(v) for k, v in words.items()}
    # a generator is a step of its own, so that what it holds is made once and not anew in each lambda
    ready = pages.select(*pages.columns, F.explode(F.array(F.struct(*[v.alias(k) for k, v in shown.items()]))).alias("w_"))
    out = {f"hier/{lm}/{rm}": F.array_join(F.transform(f"w_.lines_{lm}", _rows(rm)), "") for lm in LINE_MODES for rm in ROW_MODES}
    for cm in COLUMN_MODES:
        for side in ("top_bottom", "bottom_top"):
            out[f"glyph_columns/{cm}/{side}"] = _columns(f"w_.{side}_glyphs", cm)
            for k in ("chars", "reverse_chars"):
                out[f"word_columns/{cm}/{side}/{k}"] = _columns(f"w_.{side}_{k}", cm)
    return ready.select(*pages.columns, F.create_map(*[x for k, v in out.items() for x in (F.lit(k), v)]).alias("texts"))


def _orders_sql() -> str:
    base = TOK + """, ln AS (SELECT doc_id, line_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS r, pos, n_line, word, reverse(word) AS rev FROM tokens), lw AS (SELECT *, max(r) OVER (PARTITION BY doc_id) + 1 AS nl, max(n_line) OVER (PARTITION BY doc_id) AS width FROM ln),
gl AS (SELECT doc_id, r, nl, row_number() OVER (PARTITION BY doc_id, r ORDER BY pos, i) - 1 AS c, substr(word, i::INT, 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM lw)), gw AS (SELECT *, max(c) OVER (PARTITION BY doc_id) + 1 AS width FROM gl)"""
    line = {"forward": "r", "reverse": "nl - 1 - r", "even_odd": "CASE WHEN r % 2 = 0 THEN r // 2 ELSE (nl + 1) // 2 + r // 2 END", "odd_even": "CASE WHEN r % 2 = 1 THEN r // 2 ELSE nl // 2 + r // 2 END"}
    row = {
        "forward": ("pos", "word"), "reverse_words": ("-pos", "word"), "reverse_word_chars": ("pos", "rev"), "reverse_all": ("-pos", "rev"), "boustro_words": ("CASE WHEN ({l}) % 2 = 1 THEN -pos ELSE pos END", "word"),
        "boustro_words_chars": ("CASE WHEN ({l}) % 2 = 1 THEN -pos ELSE pos END", "rev"), "boustro_chars": ("CASE WHEN ({l}) % 2 = 1 THEN -pos ELSE pos END", "CASE WHEN ({l}) % 2 = 1 THEN rev ELSE word END"),
    }
    parts = []
    for lm, l in line.items():  # noqa: E741
        for rm, (key, text) in row.items():
            parts.append(f"SELECT 'hier/{lm}/{rm}' AS mode, doc_id, md5(string_agg({text.format(l=l)}, '' ORDER BY {l}, {key.format(l=l)})) AS digest FROM lw GROUP BY doc_id")
    for cm in COLUMN_MODES:
        for side in ("top_bottom", "bottom_top"):
            r = "r" if side == "top_bottom" else "nl - 1 - r"

            def keys(c: str, cm=cm, r=r) -> str:
                i = c if cm in ("left_right", "boustro_left") else f"width - 1 - {c}"
                return f"{i}, CASE WHEN ({i}) % 2 = 1 THEN -({r}) ELSE {r} END" if cm.startswith("boustro") else f"{i}, {r}"

            parts.append(f"SELECT 'glyph_columns/{cm}/{side}', doc_id, md5(string_agg(s, '' ORDER BY {keys('c')})) FROM gw GROUP BY doc_id")
            for name, text in (("chars", "word"), ("reverse_chars", "rev")):
                parts.append(f"SELECT 'word_columns/{cm}/{side}/{name}', doc_id, md5(string_agg({text}, '' ORDER BY {keys('pos')})) FROM lw GROUP BY doc_id")
    return base + ", d AS (" + " UNION ALL ".join(parts) + ") SELECT mode, count(*) AS docs, bit_xor(('0x' || substr(digest, 1, 15))::BIGINT) AS digest FROM d GROUP BY 1"


@query("page_reading_orders", _orders_sql())
def _(t):
    """The letters of each document in 52 orders: documents and a checksum for each order. Nothing is shuffled but the sums."""
    return bags.reading_digests(t.documents)


@query("folio_orders", TOK + """, d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM tokens))
SELECT doc_id, r AS forward, n - 1 - r AS reverse, CASE WHEN r % 2 = 0 THEN r // 2 ELSE (n + 1) // 2 + r // 2 END AS even_odd, CASE WHEN r % 2 = 1 THEN r // 2 ELSE n // 2 + r // 2 END AS odd_even FROM d""")
def _(t):
    """Places of the documents in the four orders of pages."""
    ids = t.documents.where(F.lower("text").rlike(WORD)).select("doc_id").distinct()
    d = sequence.ranks(ids, [], F.floor(F.col("doc_id") / 4096), ["doc_id"], "k").withColumn("r", F.col("k") - 1).join(F.broadcast(ids.agg(F.count("*").alias("n"))))
    r, n = F.col("r"), F.col("n")
    half = lambda x: F.floor(x / 2)
    return d.select(
        "doc_id", r.cast("long").alias("forward"), (n - 1 - r).cast("long").alias("reverse"), F.when(r % 2 == 0, half(r)).otherwise(half(n + 1) + half(r)).cast("long").alias("even_odd"), F.when(r % 2 == 1, half(r)).otherwise(half(n) + half(r)).cast("long").alias("odd_even")
    )


# Streams ---------------------------------------------------------------------------------------------------------------

#: Bits of a word, as SQL that Spark and the oracle share; of `a | b` only words count for which one alone holds, and b gives the bit.
BITS = {
    "length_parity": "length(word) % 2 = 1", "o_count_parity": "(length(word) - length(replace(word, 'o', ''))) % 2 = 1", "e_count_parity": "(length(word) - length(replace(word, 'e', ''))) % 2 = 1",
    "i_count_parity": "(length(word) - length(replace(word, 'i', ''))) % 2 = 1", "type_frequency_rank_parity": "r % 2 = 1", "starts_q": "substr(word, 1, 1) = 'q'", "starts_o": "substr(word, 1, 1) = 'o'",
    "ends_y": "right(word, 1) = 'y'", "has_gallows": "length(translate(word, 'ktpf', '')) < length(word)",
}
CHOICES = {
    "ch_vs_sh": ("contains(word, 'ch')", "contains(word, 'sh')"), "k_vs_t": ("contains(word, 'k')", "contains(word, 't')"), "p_vs_f": ("contains(word, 'p')", "contains(word, 'f')"),
    "final_y_vs_l": ("right(word, 1) = 'y'", "right(word, 1) = 'l'"), "final_r_vs_m": ("right(word, 1) = 'r'", "right(word, 1) = 'm'"), "initial_ch_vs_sh": ("substr(word, 1, 2) = 'ch'", "substr(word, 1, 2) = 'sh'"),
    "initial_k_vs_t": ("substr(word, 1, 1) = 'k'", "substr(word, 1, 1) = 't'"),
}
_ALL_BITS = BITS | {k: f"CASE WHEN ({a}) <> ({b}) THEN {b} END" for k, (a, b) in CHOICES.items()}


@query("word_bit_streams", TOK + f""", c AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM c),
b AS (SELECT n, unnest([{", ".join(repr(k) for k in _ALL_BITS)}]) AS stream, unnest([{", ".join(f"({x})" for x in _ALL_BITS.values())}]) AS bit FROM k) SELECT stream, sum(n)::BIGINT AS bits, coalesce(sum(n) FILTER (WHERE bit), 0)::BIGINT AS ones FROM b WHERE bit IS NOT NULL GROUP BY 1 HAVING sum(n) >= 200""")
def _(t):
    """The sixteen bit streams of words: their bits and ones, from counted words."""
    c = bare(t).groupBy("word").agg(F.count("*").alias("n"))
    r = sequence.ranks(c, [], F.struct(-F.col("n"), F.substring("word", 1, 2)), [F.col("n").desc(), "word"], "k").withColumn("r", F.col("k") - 1)
    b = r.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("stream"), F.expr(x).alias("bit")) for k, x in _ALL_BITS.items()])).alias("b")).where("b.bit is not null")
    return b.groupBy("b.stream").agg(F.sum("n").alias("bits"), F.sum(F.when(F.col("b.bit"), F.col("n")).otherwise(0)).alias("ones")).where("bits >= 200")


@query("all_slot_streams", TOK + "," + slots_sql("tokens") + f""", s AS (SELECT unnest(['prefix', 'suffix', 'pair', 'prefix_suffix', 'prefix_suffix', 'suffix_prefix', 'suffix_prefix']) AS stream, unnest(['P:' || prefix, 'S:' || suffix, 'X:' || prefix || '|' || suffix, 'P:' || prefix, 'S:' || suffix, 'S:' || suffix, 'P:' || prefix]) AS x FROM slots),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, line_no FROM tokens)), c AS (SELECT stream, x, count(*) AS c FROM s GROUP BY 1, 2), u AS (SELECT stream || '/continuous' AS stream, x, c FROM c UNION ALL SELECT stream || '/line_spaces', x, c FROM c UNION ALL SELECT DISTINCT stream || '/line_spaces', '<line>', n FROM c, n)
SELECT stream, sum(c)::BIGINT AS n, count(*) AS symbols, {_H} FROM u GROUP BY 1""")
def _(t):
    """The ten streams of slots, run on or with a mark at each line's end: symbols and their entropy."""
    s = slots(lined(t), "doc_id", "line_no", "pos")
    c = s.groupBy("prefix", "suffix").agg(F.count("*").alias("n"))
    p, q = F.concat(F.lit("P:"), "prefix"), F.concat(F.lit("S:"), "suffix")
    kinds = {"prefix": [p], "suffix": [q], "pair": [F.concat(F.lit("X:"), "prefix", F.lit("|"), "suffix")], "prefix_suffix": [p, q], "suffix_prefix": [q, p]}
    each = F.array(*[F.struct(F.lit(k).alias("stream"), x.alias("x")) for k, xs in kinds.items() for x in xs])
    c = c.select("n", F.explode(each).alias("s")).groupBy("s.stream", "s.x").agg(F.sum("n").alias("c"))
    lines = s.where("pos = 0").agg(F.count("*").alias("c"))
    marks = lines.select(F.explode(F.array(*map(F.lit, kinds))).alias("stream"), F.lit("<line>").alias("x"), "c")
    named = lambda d, k: d.withColumn("stream", F.concat("stream", F.lit(k)))
    u = named(c, "/continuous").unionByName(named(c.unionByName(marks), "/line_spaces"))
    return u.groupBy("stream").agg(F.sum("c").alias("n"), F.count("*").alias("symbols"), _h().alias("h"))


# Caches by unit --------------------------------------------------------------------------------------------------------

#: Units at whose limits a cache of letters starts anew, as SQL over the columns of a word.
UNITS = {"line": "doc_id || ':' || line_no", "paragraph": "doc_id || ':' || paragraph", "side": "doc_id || ''", "leaf": "(doc_id // 2) || ''", "block": "coalesce(source, '?')", "register": "coalesce(lang, '?') || ':' || coalesce(source, '?')", "language": "coalesce(lang, '?')", "global": "''"}


@query("reset_unit_bits", TOK + """, par AS (SELECT doc_id, line_no, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM lines), tk AS (SELECT tokens.*, paragraph FROM tokens JOIN par USING (doc_id, line_no)),
l AS (SELECT *, substr(word || '$', i, 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM tk)), k AS (SELECT count(DISTINCT s) AS k FROM l), """ + ", ".join(f"""c_{u} AS (SELECT {x} AS u, doc_id, seq, s, count(*) AS c FROM l GROUP BY ALL), n_{u} AS (SELECT u, doc_id, seq, sum(c) AS c FROM c_{u} GROUP BY ALL),
t_{u} AS (SELECT u, doc_id, seq, sum(c) OVER (PARTITION BY u ORDER BY doc_id, seq) - c AS m FROM n_{u}), p_{u} AS (SELECT u, doc_id, seq, c, sum(c) OVER (PARTITION BY u, s ORDER BY doc_id, seq) - c AS h FROM c_{u})""" for u, x in UNITS.items()) + " " + " UNION ALL ".join(
    f"SELECT '{u}' AS unit, alpha, round(-sum(c * log2((h + alpha / k) / (m + alpha))) / (SELECT count(*) FROM tokens), 5) + 0.0 AS bits FROM p_{u} JOIN t_{u} USING (u, doc_id, seq), k, (SELECT unnest([8.0, 32.0])::DOUBLE AS alpha) a GROUP BY alpha" for u in UNITS
))
def _(t):
    """Mean bits of a word by a cache of the letters of the words before it in its unit, for eight units and two masses.

    Texts are shuffled once, to stretches of their numbers; words and letters are not (`state.unit_cache_bits`).
    """
    outer = {u: F.expr(x) for u, x in UNITS.items() if u not in ("line", "paragraph", "side", "leaf")}
    return state.unit_cache_bits(t.documents, outer, [8.0, 32.0]).select("unit", "alpha", (F.round("bits", 5) + F.lit(0.0)).alias("bits"))


# Surrogates and parses -------------------------------------------------------------------------------------------------


def _u(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_TYPES = ", ty AS (SELECT DISTINCT word FROM tokens), ln AS (SELECT length(word) AS v, count(*) AS n FROM ty GROUP BY 1), lc AS (SELECT v, sum(n) OVER (ORDER BY v) AS hi, sum(n) OVER (ORDER BY v) - n AS lo FROM ln), ut AS (SELECT unnest(string_split(word, '')) AS v FROM ty), un AS (SELECT v, count(*) AS n FROM ut GROUP BY 1), uc AS (SELECT v, sum(n) OVER (ORDER BY v) AS hi, sum(n) OVER (ORDER BY v) - n AS lo FROM un)"


@query("zero_order_words", TOK + _TYPES + f""", d AS (SELECT i, floor({_u("'zl|' || i")} * (SELECT max(hi) FROM lc)) AS at_ FROM range(2000) r(i)), w AS (SELECT i, least(v, 40) AS n FROM d JOIN lc ON at_ >= lo AND at_ < hi),
g AS (SELECT i, j, floor({_u("'zg|' || i || '|' || j")} * (SELECT max(hi) FROM uc)) AS at_ FROM (SELECT i, unnest(range(1, n + 1)) AS j FROM w)), x AS (SELECT i, string_agg(v, '' ORDER BY j) AS word FROM g JOIN uc ON at_ >= lo AND at_ < hi GROUP BY 1)
SELECT count(*) AS n, count(DISTINCT x.word) AS types, count(ty.word) AS attested, count(DISTINCT ty.word) AS attested_types FROM x LEFT JOIN ty ON ty.word = x.word""")
def _(t):
    """Words of drawn lengths and letters, and how many of them the corpus has: the floor of what an automaton regenerates."""
    types = bare(t).select("word").distinct()
    lengths = types.groupBy(F.length("word").alias("v")).agg(F.count("*").alias("n")).agg(wheel("v").alias("lengths"))
    letters = types.select(F.explode(F.split("word", "")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).agg(wheel("v").alias("letters"))
    i = F.col("i").cast("string")
    d = t.spark.range(2000).withColumnRenamed("id", "i").join(F.broadcast(lengths)).join(F.broadcast(letters))  # an alphabet and a table of lengths
    d = d.withColumn("size", F.least(turn(F.col("lengths"), W.uniform("zl", i)), F.lit(40)))
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda j: turn(F.col("letters"), W.uniform("zg", i, j.cast("string")))), "")
    x = d.select(word.alias("word")).join(types.select(F.col("word").alias("known")), F.col("word") == F.col("known"), "left")
    return x.agg(F.count("*").alias("n"), F.count_distinct("word").alias("types"), F.count("known").alias("attested"), F.count_distinct("known").alias("attested_types"))


@query("letter_chain_words", TOK + f""", w AS (SELECT lang, word, count(*) AS k FROM tokens WHERE lang IS NOT NULL GROUP BY 1, 2), b AS (SELECT lang, k, substr('^' || word || '$', i, 1) AS a, substr('^' || word || '$', i + 1, 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM w)), n AS (SELECT lang, a, v, sum(k)::BIGINT AS n FROM b GROUP BY 1, 2, 3),
c AS (SELECT lang, a, v, sum(n) OVER (PARTITION BY lang, a ORDER BY v) AS hi, sum(n) OVER (PARTITION BY lang, a ORDER BY v) - n AS lo, sum(n) OVER (PARTITION BY lang, a) AS t FROM n),
g AS (WITH RECURSIVE g(lang, i, j, cur, word) AS (SELECT lang, i, 0, '^', '' FROM (SELECT DISTINCT lang FROM n) l, range(200) r(i) UNION ALL SELECT g.lang, g.i, g.j + 1, c.v, CASE WHEN c.v = '$' THEN g.word ELSE g.word || c.v END FROM g JOIN c ON c.lang = g.lang AND c.a = g.cur AND floor({_u("'lc|' || g.lang || '|' || g.i || '|' || g.j")} * t) >= lo AND floor({_u("'lc|' || g.lang || '|' || g.i || '|' || g.j")} * t) < hi WHERE g.cur <> '$' AND g.j < 40) SELECT lang, i, arg_max(word, j) AS word FROM g GROUP BY 1, 2)
SELECT lang, i, word FROM g WHERE word <> ''""")
def _(t):
    """Words of a first-order chain of the letters of each language's words, weighted by their tokens, 40 letters at most; drawn inside one expression."""
    chain = letter_chains(bare(t, "lang").where("lang is not null"), ["lang"])
    d = chain.select("lang", "chain", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i"))
    word = chain_word(F.col("chain"), 1, lambda j: W.uniform("lc", F.col("lang"), F.col("i").cast("string"), j.cast("string")))
    return d.select("lang", F.col("i").cast("long").alias("i"), word.alias("word")).where("word <> ''")


@query("cumulative_key", TOK + """, l AS (SELECT lang, g, sum(k) AS n FROM (SELECT lang, k, unnest(string_split(word, '')) AS g FROM (SELECT lang, word, count(*) AS k FROM tokens WHERE lang IS NOT NULL GROUP BY 1, 2)) GROUP BY 1, 2),
c AS (SELECT lang, g, n, sum(n) OVER w AS hi, sum(n) OVER (PARTITION BY lang) AS t, row_number() OVER w AS r, count(*) OVER (PARTITION BY lang) AS m FROM l WINDOW w AS (PARTITION BY lang ORDER BY n DESC, g)),
k AS (SELECT a.lang AS cipher_lang, b.lang AS plain_lang, a.g AS cipher, least(1 + count(*) FILTER (WHERE 2 * b.hi * a.t < (2 * a.hi - a.n) * b.t), max(b.m)) AS r FROM c a JOIN c b ON a.lang <> b.lang GROUP BY ALL)
SELECT cipher_lang, plain_lang, cipher, c.g AS plain FROM k JOIN c ON c.lang = plain_lang AND c.r = k.r""")
def _(t):
    """A first key between all pairs of languages: the letter whose cumulated share reaches the middle of the symbol's own."""
    w = bare(t, "lang").where("lang is not null").groupBy("lang", "word").agg(F.count("*").alias("k"))
    l = w.select("lang", "k", F.explode(F.split("word", "")).alias("g")).groupBy("lang", "g").agg(F.sum("k").alias("n"))  # noqa: E741  alphabets
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "g")
    c = l.withColumns({"hi": F.sum("n").over(order), "t": F.sum("n").over(Window.partitionBy("lang"))})
    key = c.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("hi", "g"))).alias("letters"), F.first("t").alias("total")).withColumnRenamed("lang", "plain_lang")
    k = c.join(F.broadcast(key), F.col("lang") != F.col("plain_lang"))  # a row for each language
    below = F.size(F.filter("letters", lambda x: 2 * x["hi"] * F.col("t") < (2 * F.col("hi") - F.col("n")) * F.col("total")))
    plain = F.get("letters", F.least(below, F.size("letters") - 1))["g"]
    return k.select(F.col("lang").alias("cipher_lang"), "plain_lang", F.col("g").alias("cipher"), plain.alias("plain"))


@query("table_parse", TOK + """, w AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS df FROM tokens GROUP BY 1), one AS (SELECT word FROM w WHERE df >= 20 AND length(word) <= 3), pre AS (SELECT substr(word, 1, k) AS p FROM w, range(1, 5) r(k) WHERE length(word) > k GROUP BY 1 HAVING count(*) >= 20), suf AS (SELECT right(word, k::INT) AS s FROM w, range(1, 5) r(k) WHERE length(word) > k GROUP BY 1 HAVING count(*) >= 20),
x AS (SELECT w.word, n, k FROM w, range(1, 40) r(k) WHERE k < length(word) AND word NOT IN (SELECT word FROM one) AND substr(word, 1, k) IN (SELECT p FROM pre) AND substr(word, k + 1) IN (SELECT s FROM suf)), b AS (SELECT word, max(k) AS k, count(*) AS c FROM x GROUP BY 1),
e AS (SELECT w.word, n, CASE WHEN o.word IS NOT NULL THEN 1 WHEN b.word IS NOT NULL THEN 2 ELSE 0 END AS emissions, coalesce(c, 0) AS c, CASE WHEN b.word IS NOT NULL THEN substr(w.word, 1, k) END AS prefix FROM w LEFT JOIN one o ON o.word = w.word LEFT JOIN b ON b.word = w.word)
SELECT emissions, count(*) AS types, sum(n)::BIGINT AS tokens, count(*) FILTER (WHERE c > 1) AS ambiguous, count(DISTINCT prefix) AS prefixes FROM e GROUP BY 1""")
def _(t):
    """Words read as one entry of a table, or else as a prefix and a suffix of two tables; of several splits that of the longest prefix counts."""
    w = bare(t).groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    one = w.where((F.col("df") >= 20) & (F.length("word") <= 3)).select("word", F.lit(1).alias("one"))
    ks = F.when(F.length("word") > 1, F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(4))))
    part = lambda f, name: w.select(F.explode(F.transform(ks, f)).alias(name)).groupBy(name).agg(F.count("*").alias("c")).where("c >= 20").select(name)
    pre, suf = part(lambda k: F.substring("word", F.lit(1), k), "p"), part(lambda k: F.right("word", k), "s")
    held = w.join(one, "word", "left")
    cut = held.where("one is null").select("word", F.explode(F.when(F.length("word") > 1, F.sequence(F.lit(1), F.length("word") - 1))).alias("k"))
    cut = cut.select("word", "k", F.substring("word", F.lit(1), F.col("k")).alias("p"), F.substring("word", F.col("k") + 1, F.length("word")).alias("s")).where("length(p) <= 4 and length(s) <= 4")
    b = cut.join(pre, "p", "left_semi").join(suf, "s", "left_semi").groupBy("word").agg(F.max("k").alias("k"), F.count("*").alias("c"))
    e = held.join(b, "word", "left").withColumn("emissions", F.when(F.col("one").isNotNull(), 1).when(F.col("c").isNotNull(), 2).otherwise(0))
    e = e.withColumn("prefix", F.when(F.col("c").isNotNull(), F.substring("word", F.lit(1), F.col("k"))))
    return e.groupBy("emissions").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.count(F.when(F.col("c") > 1, 1)).alias("ambiguous"), F.count_distinct("prefix").alias("prefixes"))


# Word functions --------------------------------------------------------------------------------------------------------

_VAL = "CASE WHEN g BETWEEN 'a' AND 'z' AND length(g) = 1 AND ascii(g) < 128 THEN ascii(g) - 96 ELSE ascii(g) END"


def _poly(x: str) -> str:
    """Base 3, modulo 23, of the letters of a part: a sum of powers, since 3^11 is 1 modulo 23."""
    return f"coalesce(list_sum(list_transform(string_split({x}, ''), lambda g, i: CASE WHEN g = '' THEN 0 ELSE ({_VAL}) * power(3, (length({x}) - i) % 11)::BIGINT END)), 0)::BIGINT"


@query("numeric_features", TOK + "," + slots_sql("(SELECT DISTINCT word FROM tokens)") + f""", v AS (SELECT *, list_transform(string_split(word, ''), lambda g: {_VAL}) AS a FROM slots)
SELECT word, (length(word) % 23)::INT AS length, (a[1] % 23)::INT AS first, (a[-1] % 23)::INT AS last, (list_sum(a) % 23)::INT AS glyph_sum, (list_sum(list_transform(a, lambda x, i: x * i)) % 23)::INT AS weighted_sum,
({_poly("word")} % 23)::INT AS polynomial, ({_poly("core")} % 23)::INT AS core_polynomial, ((({_poly("prefix")}) % 23 * 5 + ({_poly("suffix")}) % 23) % 23)::INT AS affix_polynomial FROM v""")
def _(t):
    """All eight numbers of each word."""
    return bare(t).select("word").distinct().select("word", *[W.numeric_feature("word", n).cast("int").alias(n) for n in W.NUMBERS])


@query("signatures", TOK + """, v AS (SELECT DISTINCT word FROM tokens), s AS (SELECT word, CASE WHEN length(word) <= 3 THEN 's' WHEN length(word) <= 5 THEN 'm' WHEN length(word) <= 7 THEN 'l' ELSE 'x' END AS z FROM v)
SELECT word, substr(word, 1, 1) || ':' || right(word, 1) || ':' || z AS edges, z || ':g' || least(length(word) - length(translate(word, 'ktpf', '')), 2) || ':b' || least(len(regexp_extract_all(word, '[cs]h')), 2) || ':r' || CASE WHEN list_contains(list_transform(range(1, length(word)), lambda i: substr(word, i::INT, 1) = substr(word, i::INT + 1, 1)), true) THEN 1 ELSE 0 END AS shape FROM s""")
def _(t):
    """Two of the signatures of each word; `slot_shapes` has the third."""
    return bare(t).select("word").distinct().select("word", W.signature("word", "edges").alias("edges"), W.signature("word", "shape").alias("shape"))


@query("letter_order_scores", TOK + """, p AS (SELECT lang, substr(word, i::INT, 1) AS a, substr(word, i::INT + 1, 1) AS b, k FROM (SELECT lang, word, k, unnest(range(1, length(word))) AS i FROM (SELECT lang, word, count(*) AS k FROM tokens GROUP BY 1, 2)))
SELECT lang, sum(k) FILTER (WHERE ascii(b) > ascii(a))::BIGINT AS forward, sum(k) FILTER (WHERE ascii(b) < ascii(a))::BIGINT AS back, round(sum(k) FILTER (WHERE ascii(b) > ascii(a)) / (sum(k) FILTER (WHERE a <> b))::DOUBLE, 6) + 0.0 AS score FROM p WHERE a BETWEEN 'a' AND 'z' AND b BETWEEN 'a' AND 'z' AND ascii(a) < 128 AND ascii(b) < 128 GROUP BY 1""")
def _(t):
    """Share of neighbouring letters that go forward in the alphabet."""
    w = bare(t, "lang").groupBy("lang", "word").agg(F.count("*").alias("k"))
    p = w.select("lang", "k", F.explode(W.ngrams("word", 2)).alias("g")).where(F.col("g").rlike("^[a-z]{2}$")).groupBy("lang", "g").agg(F.sum("k").alias("k"))
    d = F.ascii(F.substring("g", 2, 1)) - F.ascii("g")
    n = lambda x: F.sum(F.when(x, F.col("k")))
    return p.groupBy("lang").agg(n(d > 0).alias("forward"), n(d < 0).alias("back"), r6(n(d > 0) / n(d != 0)).alias("score"))


@query("word_units", TOK + """, w AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1), u AS (SELECT word, n, regexp_extract_all(word, 'c[fkpt]h|ch|sh|.') AS u FROM w), e AS (SELECT n, len(u) AS m, unnest(u) AS unit, unnest(range(len(u))) AS i FROM u)
SELECT unit, CASE WHEN m = 1 THEN 'single' WHEN i = 0 THEN 'initial' WHEN i = m - 1 THEN 'final' ELSE 'medial' END AS place, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2""")
def _(t):
    """Units of words by their place."""
    w = bare(t).groupBy("word").agg(F.count("*").alias("n"))
    return w.select("n", F.explode(W.unit_positions(W.glyph_units("word"))).alias("u")).groupBy("u.unit", "u.place").agg(F.sum("n").alias("n"))


@query("prefix_stacks", TOK + """, w AS (SELECT word, count(*) AS n FROM tokens GROUP BY 1), a AS (SELECT *, regexp_replace(word, '^(qok|qot|cth|ckh|cph|cfh|qo|ok|ot|ch|sh|o|y|d)', '') AS r FROM w), b AS (SELECT *, regexp_replace(r, '^(qok|qot|cth|ckh|cph|cfh|qo|ok|ot|ch|sh|o|y|d)', '') AS s FROM a), c AS (SELECT *, regexp_replace(s, '^(qok|qot|cth|ckh|cph|cfh|qo|ok|ot|ch|sh|o|y|d)', '') AS q FROM b)
SELECT ((r <> word)::INT + (s <> r)::INT + (q <> s)::INT)::INT AS depth, count(*) AS types, sum(n)::BIGINT AS tokens FROM c GROUP BY 1""")
def _(t):
    """How many prefixes lie one in front of the other, up to three."""
    w = bare(t).groupBy("word").agg(F.count("*").alias("n"))
    return w.groupBy(W.prefix_layers("word").alias("depth")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
