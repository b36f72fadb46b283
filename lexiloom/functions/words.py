"""Word-level column functions: slots, buckets, shapes, n-grams, numeric coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the word grammars (affix lists of the standard analyses).
PREFIXES = ("qok", "qot", "qo", "ok", "ot", "o", "y", "ch", "sh", "d", "cth", "ckh", "cph", "cfh")
SUFFIXES = ("eedy", "eody", "edy", "aiin", "aiir", "ain", "iin", "dy", "ol", "or", "ar", "al", "am", "dam", "ey", "eey", "y")
SHORT_PREFIXES = ("qok", "qot", "qo", "ok", "ot", "o", "y", "ch", "sh", "d", "cth", "ckh", "cph")
SHORT_SUFFIXES = ("eedy", "eody", "edy", "aiin", "ain", "iin", "dy", "ol", "or", "ar", "al", "am", "y")
WIDE_PREFIXES = (*PREFIXES, "s", "p", "t", "k", "f", "r", "l")
GALLOWS = "ktpf"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class AffixGrammar:
    """Affix lists; suffix_scope says whether a suffix is sought in what the prefix leaves or in the whole word."""

    prefixes: Sequence[str] = PREFIXES
    suffixes: Sequence[str] = SUFFIXES
    suffix_scope: str = "rest"

    def prefix(self, word: Column | str) -> Column:
        """Longest prefix of the word, or ''."""
        return F.regexp_extract(_c(word), f"^({'|'.join(sorted(self.prefixes, key=len, reverse=True))})", 1)

    def split(self, word: Column | str) -> Column:
        """struct(prefix, core, suffix): longest prefix, then longest suffix that leaves something; the core may be empty.

        The suffix pattern begins with a lazy stretch, so the first place from which a suffix reaches the end wins,
        which is that of the longest one.
        """
        w = _c(word)
        pre = self.prefix(w)
        rest = F.substring(w, F.length(pre) + 1, F.length(w))
        suf = F.regexp_extract(rest if self.suffix_scope == "rest" else w, rf"(?s)^.+?({'|'.join(self.suffixes)})\z", 1)
        core = F.substring(rest, F.lit(1), F.greatest(F.length(rest) - F.length(suf), F.lit(0)))
        return F.struct(pre.alias("prefix"), core.alias("core"), suf.alias("suffix"))


FULL = AffixGrammar()
SHORT = AffixGrammar(SHORT_PREFIXES, SHORT_SUFFIXES)
WIDE = AffixGrammar(WIDE_PREFIXES, SUFFIXES)
LEGACY = AffixGrammar(PREFIXES[:12], SUFFIXES, "word")


def or_none(x: Column | str, empty: str = "none") -> Column:
    """The value, or `empty` for '' and null."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(empty))


def core_or_empty(word: Column | str, grammar: AffixGrammar = FULL) -> Column:
    return or_none(grammar.split(word)["core"], "<empty>")


def morphs(word: Column | str, grammar: AffixGrammar = FULL) -> Column:
    """array(prefix, '#' + core, suffix) without empty parts."""
    s = grammar.split(word)
    return F.filter(F.array(s["prefix"], F.concat(F.lit("#"), s["core"]), s["suffix"]), lambda x: ~x.isin("", "#"))


def affix_pair(word: Column | str, grammar: AffixGrammar = FULL) -> Column:
    s = grammar.split(word)
    return F.concat_ws("|", or_none(s["prefix"]), or_none(s["suffix"]))


def locus_type(locus: Column | str) -> Column:
    """First letter of the locus in upper case, else '?'."""
    return or_none(F.upper(F.regexp_extract(_c(locus), "[A-Za-z]", 0)), "?")


def section(folio: Column | str) -> Column:
    n = F.regexp_extract(_c(folio), r"^f(\d+)", 1).cast("int")
    out = F.when(n <= 66, "herbal")
    for most, name in ((73, "astro"), (84, "bio"), (86, "cosmo"), (102, "pharma")):
        out = out.when(n <= most, name)
    return out.when(n > 102, "recipes")


def folio_key(folio: Column | str) -> Column:
    """struct(number, side, panel) in reading order; what cannot be parsed comes last."""
    f = _c(folio)
    ok = f.rlike(r"^f\d+[rv]\d*")
    number = F.regexp_extract(f, r"^f(\d+)[rv](\d*)", 1).cast("long")
    panel = F.coalesce(F.nullif(F.regexp_extract(f, r"^f(\d+)[rv](\d*)", 2), F.lit("")).cast("long"), F.lit(0))
    side = F.when(F.regexp_extract(f, r"^f\d+([rv])", 1) == "r", 0).otherwise(1)
    return F.struct(
        F.when(ok, number).otherwise(10**9).alias("number"), F.when(ok, side).otherwise(0).alias("side"), F.when(ok, panel).otherwise(0).alias("panel")
    )


def leaf(folio: Column | str) -> Column:
    return F.regexp_extract(_c(folio), r"^f(\d+)", 1).cast("int")


def facsimile_page(folio: Column | str, rule: str = "skip12") -> Column:
    """Page of a folio's recto: '2n' while n < 12 and '2n-2' after it (skip12), or '2n-2' always (plain); versos come next."""
    n = leaf(folio)
    recto = F.when(n < 12, 2 * n).otherwise(2 * n - 2) if rule == "skip12" else 2 * n - 2
    return recto + F.when(F.regexp_extract(_c(folio), r"^f\d+([rv])", 1) == "v", 1).otherwise(0)


def position3(i: Column | str, n: Column | str) -> Column:
    i, n = _c(i), _c(n)
    return F.when(i == 0, "init").when(i == n - 1, "final").otherwise("mid")


def position5(i: Column | str, n: Column | str, order: str = "last_first") -> Column:
    """first, second, interior, penult, last; in lines of two words the second word is `last` (last_first) or `second`."""
    i, n = _c(i), _c(n)
    if order == "last_first":
        return F.when(i == 0, "first").when(i == n - 1, "last").when(i == 1, "second").when(i == n - 2, "penult").otherwise("interior")
    return F.when(i == 0, "first").when(i == 1, "second").when(i == n - 2, "penult").when(i == n - 1, "last").otherwise("interior")


def column_label(i: Column | str) -> Column:
    i = _c(i)
    return F.when(i < 10, F.concat(F.lit("c"), i.cast("string"))).otherwise("c10+")


def line_slot(i: Column | str, n: Column | str) -> Column:
    """p0 .. p4, then mid, and last for the last word."""
    i, n = _c(i), _c(n)
    return F.when(i == n - 1, "last").when(i < 5, F.concat(F.lit("p"), i.cast("string"))).otherwise("mid")


def relative_bin(i: Column | str, n: Column | str, bins: int = 5) -> Column:
    return F.least(F.lit(bins - 1), F.floor(_c(i) * F.lit(float(bins)) / _c(n)).cast("int"))


def length_bucket(word: Column | str) -> Column:
    n = F.length(_c(word))
    return F.when(n <= 3, "short").when(n <= 5, "medium").when(n <= 7, "long").otherwise("very_long")


def frequency_band(count: Column | str) -> Column:
    c = _c(count)
    return F.when(c == 1, "hapax").when(c <= 3, "rare").when(c <= 10, "mid").when(c <= 50, "common").otherwise("very_common")


def edge_shape(word: Column | str) -> Column:
    """struct(first, last, length bucket)."""
    w = _c(word)
    return F.struct(F.substring(w, 1, 1).alias("first"), F.right(w, F.lit(1)).alias("last"), length_bucket(w).alias("length"))


def affix_shape(word: Column | str, grammar: AffixGrammar = FULL) -> Column:
    """struct(has prefix, has suffix, length up to 8, has gallows)."""
    s = grammar.split(word)
    return F.struct((s["prefix"] != "").alias("prefix"), (s["suffix"] != "").alias("suffix"), F.least(F.length(_c(word)), F.lit(8)).alias("length"), has_gallows(word).alias("gallows"))


def invariant_shape(word: Column | str) -> Column:
    """struct(length, distinct letters, adjacent double): the same for every letter-for-letter substitution."""
    w = _c(word)
    letters = F.split(w, "")
    return F.struct(F.length(w).alias("length"), F.size(F.array_distinct(letters)).alias("letters"), w.rlike(r"(.)\1").alias("double"))


def ring_shape(word: Column | str) -> Column:
    """struct(length up to 8, first letter is the last, adjacent double, any letter repeats): no substitution changes it."""
    w = _c(word)
    repeats = F.size(F.array_distinct(F.split(w, ""))) < F.length(w)
    return F.struct(F.least(F.length(w), F.lit(8)).alias("length"), (F.substring(w, 1, 1) == F.right(w, F.lit(1))).alias("round"), w.rlike(r"(.)\1").alias("double"), repeats.alias("repeats"))


def has_gallows(word: Column | str) -> Column:
    return _c(word).rlike(f"[{GALLOWS}]")


def benched_gallows(word: Column | str) -> Column:
    return F.regexp_count(_c(word), F.lit("c[ktpf]h"))


def plain_bench(word: Column | str) -> Column:
    """ch and sh that no gallows is set into."""
    return F.regexp_count(_c(word), F.lit("[cs]h"))


def minim_runs(word: Column | str) -> Column:
    return F.regexp_extract_all(_c(word), F.lit("(i+[nrlm]?)"), F.lit(1))


def glyph_units(word: Column | str) -> Column:
    """Greedy units: benched gallows, benches, single letters."""
    return F.regexp_extract_all(_c(word), F.lit("(c[fkpt]h|ch|sh|.)"), F.lit(1))


def unit_positions(units: Column | str) -> Column:
    """array of struct(unit, place): single, initial, medial or final."""
    u = _c(units)
    n = F.size(u)
    place = lambda i: F.when(n == 1, "single").when(i == 0, "initial").when(i == n - 1, "final").otherwise("medial")
    return F.transform(u, lambda x, i: F.struct(x.alias("unit"), place(i).alias("place")))


def strokes(word: Column | str, table: dict[str, Sequence[str]]) -> Column:
    """Strokes of all letters, by a table of letters; letters that it lacks have none."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(F.split(_c(word), ""), lambda g: F.coalesce(F.element_at(pairs, g), F.array().cast("array<string>"))))


def choose_letters(word: Column | str, mode: str) -> Column:
    w = _c(word)
    n = F.length(w)
    half = lambda odd: F.array_join(F.filter(F.split(w, ""), lambda x, i: i % 2 == odd), "")
    return {
        "all": w, "odd": half(0), "even": half(1), "first": F.substring(w, 1, 1), "last": F.right(w, F.lit(1)),
        "middle": F.substring(w, F.floor((n - 1) / 2).cast("int") + 1, F.lit(1)),
    }[mode]


def letter_value(letter: Column) -> Column:
    """a = 1 .. z = 26, others by code point."""
    return F.when(letter.rlike("^[a-z]$"), F.ascii(letter) - 96).otherwise(F.ascii(letter))


def polynomial(word: Column | str, base: int = 3, modulus: int = 23) -> Column:
    return F.aggregate(F.split(_c(word), ""), F.lit(0), lambda acc, x: F.pmod(acc * base + F.when(x == "", 0).otherwise(letter_value(x)), F.lit(modulus)))


def _numbers(w: Column, grammar: AffixGrammar, modulus: int) -> dict[str, Column]:
    """The numeric coordinates of a word before they are taken modulo `modulus`."""
    values = F.transform(F.filter(F.split(w, ""), lambda x: x != ""), letter_value)
    weighted = F.transform(values, lambda v, i: (i + 1) * v)
    total = lambda v: F.aggregate(v, F.lit(0), lambda acc, x: acc + x)
    hashed = lambda part: polynomial(part, modulus=modulus)
    parts = grammar.split(w)
    return {
        "length": F.size(values), "first": F.coalesce(F.get(values, F.lit(0)), F.lit(0)), "last": F.coalesce(F.get(values, F.size(values) - 1), F.lit(0)), "glyph_sum": total(values),
        "weighted_sum": total(weighted), "polynomial": hashed(w), "core_polynomial": hashed(parts["core"]), "affix_polynomial": 5 * hashed(parts["prefix"]) + hashed(parts["suffix"]),
    }


#: Names of the numeric coordinates.
NUMBERS = ("length", "first", "last", "glyph_sum", "weighted_sum", "polynomial", "core_polynomial", "affix_polynomial")


def numeric_feature(word: Column | str, name: str, modulus: int = 23, grammar: AffixGrammar = FULL) -> Column:
    """A number below `modulus` for a word, by one of the NUMBERS; KeyError for another name."""
    return F.pmod(_numbers(_c(word), grammar, modulus)[name], F.lit(modulus))


def _clipped(c: Column, most: int = 2) -> Column:
    return F.least(c, F.lit(most)).cast("string")


def signature(word: Column | str, channel: str, grammar: AffixGrammar = FULL) -> Column:
    """Shape of a word in one string: `edges` (first and last letter, size), `affixes`, or `shape` (size, gallows, benches, a double letter); '_' for the empty word."""
    w = _c(word)
    size = F.element_at(F.array(*map(F.lit, "sssmmllx")), F.least(F.greatest(F.length(w), F.lit(1)), F.lit(8)))
    parts = grammar.split(w)
    joined = {
        "edges": (F.substring(w, 1, 1), F.right(w, F.lit(1)), size),
        "affixes": (or_none(parts["prefix"], "-"), or_none(parts["suffix"], "-")),
        "shape": (size, F.concat(F.lit("g"), _clipped(F.regexp_count(w, F.lit(f"[{GALLOWS}]")))), F.concat(F.lit("b"), _clipped(plain_bench(w))), F.concat(F.lit("r"), w.rlike(r"(.)\1").cast("int").cast("string"))),
    }
    return F.when(F.length(w) == 0, "_").otherwise(F.concat_ws(":", *joined[channel]))


def ngrams(word: Column | str, k: int, pad: bool = False) -> Column:
    """Character k-grams in order; with pad, of ^word$. Linear in the length, so whole texts will do."""
    w = F.concat(F.lit("^"), _c(word), F.lit("$")) if pad else _c(word)
    letters = F.split(w, "")
    n = F.greatest(F.size(letters) - k + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(letters, F.lit(j + 1), n).alias(f"c{j}") for j in range(k)])
    return F.when(F.length(w) >= k, F.transform(shifted, lambda x: F.concat(*[x[f"c{j}"] for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def prefix_layers(word: Column | str, grammar: AffixGrammar = FULL, most: int = 3) -> Column:
    """How many prefixes can be taken off one after the other, up to `most`."""
    out, w = F.lit(0), _c(word)
    for _ in range(most):
        p = grammar.prefix(w)
        out = out + (p != "").cast("int")
        w = F.substring(w, F.length(p) + 1, F.length(w))
    return out


def mirror_alphabet(word: Column | str) -> Column:
    """a <-> z, b <-> y, ...: a bijective substitution."""
    a = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(_c(word), a, a[::-1])


def roman_to_int(x: Column | str) -> Column:
    letters = F.transform(F.split(F.upper(_c(x)), ""), lambda c: F.element_at(F.create_map(*[F.lit(v) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in p]), c))
    step = lambda acc, v: F.struct((acc["sum"] + v - F.when(acc["last"] < v, 2 * acc["last"]).otherwise(0)).alias("sum"), v.alias("last"))
    total = F.aggregate(letters, F.struct(F.lit(0).alias("sum"), F.lit(1000).alias("last")), step, lambda acc: acc["sum"])
    return F.when(_c(x).rlike("(?i)^[IVXLCDM]+$"), total)


def period_meets(period: Column | str, first: int = 14, last: int = 15) -> Column:
    """Whether a period such as `XIII-XIV` meets the centuries first to last."""
    parts = F.transform(F.regexp_extract_all(F.upper(_c(period)), F.lit("([IVXLCDM]+)"), F.lit(1)), roman_to_int)
    return F.coalesce((F.array_min(parts) <= last) & (F.array_max(parts) >= first), F.lit(False))


def stable_hash(*parts: Column | str) -> Column:
    """md5 of the parts joined by '|': the source of all randomness, equal on every engine and partitioning."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the stable hash."""
    return F.conv(F.substring(stable_hash(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def log2_bin(x: Column | str) -> Column:
    return F.floor(F.log2(_c(x))).cast("int")


def gap_bin(gap: Column | str) -> Column:
    g = _c(gap)
    return F.when(g.isNull(), "none").when(g <= 1, "1").when(g <= 4, "2-4").when(g <= 16, "5-16").otherwise("17+")


def tertile(value: Column | str, low: Column, high: Column) -> Column:
    v = _c(value)
    return F.when(v <= low, "low").when(v <= high, "mid").otherwise("high")


def delta_sign(value: Column, before: Column, sigma: Column, share: float = 0.02) -> Column:
    d = value - before
    return F.when(F.abs(d) <= share * sigma, "same").when(d > 0, "up").otherwise("down")


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def morph_similarity(a: Column | str, b: Column | str, grammar: AffixGrammar = FULL) -> Column:
    """How many of prefix, core and suffix agree, 0 to 3."""
    x, y = grammar.split(a), grammar.split(b)
    return sum(((x[k] == y[k]).cast("int") for k in ("core", "suffix")), (x["prefix"] == y["prefix"]).cast("int"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union > 0, F.size(F.array_intersect(_c(a), _c(b))) / union).otherwise(0.0)


def ring_angle(i: Column | str, n: Column | str) -> Column:
    return 2 * F.pi() * _c(i) / _c(n)


def logsum2(values: Column) -> Column:
    """log2 of the sum of 2^x over an array; null stands for minus infinity."""
    v = F.filter(values, lambda x: x.isNotNull())
    top = F.array_max(v)
    return F.when(F.size(v) > 0, top + F.log2(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), x - top))))


# Fixed values of the page kinds: thresholds of the shares (least, below), in the order in which they are tried.
PAGE_KINDS = (
    ("empty", {"ink": (None, 0.02)}),
    ("plant with roots", {"green": (0.05, None), "red": (0.005, None)}),
    ("plant", {"green": (0.05, None)}),
    ("text", {"ink": (0.06, None), "edge": (1.2, None), "pigment": (None, 0.03)}),
    ("rings", {"blue": (0.02, None), "edge": (None, 1.4)}),
    ("drawing", {"pigment": (0.06, None), "edge": (None, 1.2)}),
)


def page_label(ink: Column, green: Column, red: Column, blue: Column, edge: Column) -> Column:
    """Kind of a page by its pigment shares: the first of PAGE_KINDS whose bounds all hold, else `mixed`. Lower bounds are strict but for the edge's."""
    share = {"ink": ink, "green": green, "red": red, "blue": blue, "edge": edge, "pigment": green + red + blue}
    kinds = []
    for name, bounds in PAGE_KINDS:
        ok = F.lit(True)
        for key, (low, high) in bounds.items():
            if low is not None:
                ok = ok & (share[key] >= low if key == "edge" else share[key] > low)
            if high is not None:
                ok = ok & (share[key] < high)
        kinds.append(F.when(ok, name))
    return F.coalesce(*kinds, F.lit("mixed"))
