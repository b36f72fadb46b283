"""Lines and tokens of documents, eligibility profiles, runs and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[a-zà-öø-ÿ]+"


def lines(docs: DataFrame, *carry: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *carry, line_no, line): every line of every text, empty ones too."""
    return docs.select(key, *carry, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def tokens(docs: DataFrame, *carry: str, key: str = "doc_id", text: str = "text", pattern: str = WORD, line: bool = True, seq: bool = True) -> DataFrame:
    """(key, *carry, line_no, n_line, pos, seq, word): lower-cased words in reading order, without a shuffle.

    pos and n_line count words of the line from 0, seq words of the document. Null texts have no tokens. Without `line`
    there are no line_no, n_line and pos, without `seq` no seq: words are then cut out of the text, or of its exploded
    lines, by one generated expression each, and only both together need a lambda for each word.
    """
    words = lambda x: F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    if not line:
        held = docs.select(key, *carry, words(F.lower(text)).alias("ws_"))
        return held.select(key, *carry, F.posexplode("ws_").alias("seq", "word")) if seq else held.select(key, *carry, F.explode("ws_").alias("word"))
    if not seq:
        held = docs.select(key, *carry, F.posexplode(F.split(F.lower(text), "\n", -1)).alias("line_no", "line_")).select(key, *carry, "line_no", words("line_").alias("ws_"))
        return held.select(key, *carry, "line_no", F.size("ws_").alias("n_line"), F.posexplode("ws_").alias("pos", "word"))
    by_line = F.transform(F.split(F.lower(text), "\n", -1), words)
    placed = F.transform(by_line, lambda ws, i: F.transform(ws, lambda w, j: F.struct(i.alias("line_no"), F.size(ws).alias("n_line"), j.alias("pos"), w.alias("word"))))
    return docs.select(key, *carry, F.posexplode(F.flatten(placed)).alias("seq", "t")).select(key, *carry, "t.line_no", "t.n_line", "t.pos", "seq", "t.word")


#: Eligibility of a word by profile (the others build on these; see `eligible`).
PROFILES = ("E0", "E1", "E2", "E3", "E4", "E5", "E6", "E7")


def legible(word: Column | str, profile: str = "E1", alphabet: str = "a-z") -> Column:
    """Whether a word itself passes a profile: no '?', from E1 on two letters at least, from E4 on letters alone."""
    w = F.col(word) if isinstance(word, str) else word
    ok = w.isNotNull() & ~w.contains("?")
    if profile != "E0":
        ok = ok & (F.length(w) >= 2)
    if profile in ("E4", "E5"):
        ok = ok & w.rlike(r"^\p{L}+$")
    if profile == "E6":
        ok = ok & w.rlike(f"^[{alphabet}]+$")
    return ok


def eligible(words: DataFrame, profile: str, by: list[str], order: str = "pos", word: str = "word", least: int | None = None) -> DataFrame:
    """Words under a profile. by: columns of a line.

    E0, E1, E2, E5, E7 delete what fails, so that neighbours join, and drop lines with fewer than `least` words left
    (default 1; E2: 3, E5: 5). E3 and E4 keep the row with a null word, which breaks adjacency and leaves positions as
    they are. E6 splits a line at what fails into runs (column run) and keeps runs of 5 words or more. Positions are
    counted anew for the deleting profiles (columns i, n).
    """
    if profile not in PROFILES:
        raise ValueError(profile)
    ok = legible(word, profile)
    line = Window.partitionBy(*by)
    if profile in ("E3", "E4"):
        return words.withColumns({word: F.when(ok, F.col(word)), "i": F.row_number().over(line.orderBy(order)) - 1, "n": F.count("*").over(line)})
    if profile == "E6":
        marked = words.withColumn("run", F.sum((~ok).cast("int")).over(line.orderBy(order))).where(ok)
        by, least = [*by, "run"], least or 5
    else:
        marked, least = words.where(ok), least or {"E2": 3, "E5": 5}.get(profile, 1)
    line = Window.partitionBy(*by)
    out = marked.withColumns({"n": F.count("*").over(line), "i": F.row_number().over(line.orderBy(order)) - 1})
    return out.where(F.col("n") >= least)


def runs(words: DataFrame, by: list[str], order: str, word: str = "word") -> DataFrame:
    """Gaps and islands: column run numbers the stretches between null words, which go."""
    w = Window.partitionBy(*by).orderBy(order)
    return words.withColumn("run", F.sum(F.col(word).isNull().cast("int")).over(w)).where(F.col(word).isNotNull())


def transitions(words: DataFrame, by: list[str], order: str, word: str = "word", deep: bool = False) -> DataFrame:
    """Pairs (left, right) of neighbours of which neither is null, with i, the place of the right one; deep leaves out the first and last two words."""
    w = Window.partitionBy(*by).orderBy(order)
    line = Window.partitionBy(*by)
    out = words.withColumns({"left": F.lag(word).over(w), "right": F.col(word), "i": F.row_number().over(w) - 1, "n": F.count("*").over(line)})
    out = out.where("left is not null and right is not null")
    return out.where("i >= 3 and i < n - 2") if deep else out


def history(words: DataFrame, by: list[str], order: str, size: int = 8, word: str = "word") -> DataFrame:
    """Column history: up to `size` words before, the nearest first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-size, -1)
    return words.withColumn("history", F.reverse(F.collect_list(word).over(w)))


def sessions(rows: DataFrame, by: list[str], order: str | list[str], marker: Column, name: str = "session") -> DataFrame:
    """Column `name`: how many markers have come up to and with the row; a marker opens a session."""
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return rows.withColumn(name, F.sum(marker.cast("int")).over(w))


def run_lengths(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, island, value, first, last, length): stretches of equal values."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*by, "island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def carry_forward(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Column `name`: the last value that is not null, up to and with the row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))


def text_grams(docs: DataFrame, by: list[str], n: int, padded: bool = False, text: str = "text", pattern: str = WORD) -> DataFrame:
    """(by, g, c): letter n-grams (n <= 4) of the documents' words joined by one space, counted; padded puts a space at both ends.

    A gram that starts in a word, or at the space before it, ends in the next word's first n - 2 letters at the latest,
    or in the space behind a shorter one. So pieces of a word with that much of its surroundings are counted first, and
    only distinct pieces are cut into letters. At the end of a text that is not padded, shorter
    grams are counted too; the space that ends a padded text starts none.
    """
    if not 1 <= n <= 4:
        raise ValueError("pieces hold grams of one to four letters")
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))  # no word goes beyond a line
    held = docs.select(*by, words.alias("ws_")).where(F.size("ws_") > 0)
    size = F.size("ws_")

    def piece(w, i):
        space, none = F.lit(" "), F.lit("")
        lead = space if padded else F.when(i > 0, space).otherwise(none)
        if n == 1:
            tail = none
        else:
            end = space if padded else none
            after = F.concat(F.get("ws_", i + 1), space if padded else F.when(i + 2 < size, space).otherwise(none))
            tail = F.when(i + 1 < size, F.concat(space, F.substring(after, 1, n - 2) if n > 2 else none)).otherwise(end)
        own = F.concat(lead, w)
        return F.struct(F.concat(own, tail).alias("s"), F.length(own).alias("own"))

    pieces = held.select(*by, F.explode(F.transform("ws_", piece)).alias("p")).groupBy(*by, "p.s", "p.own").agg(F.count("*").alias("k"))
    grams = pieces.select(*by, "k", F.explode(F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.substring("s", i, F.lit(n)))).alias("g"))
    return grams.groupBy(*by, "g").agg(F.sum("k").alias("c"))
