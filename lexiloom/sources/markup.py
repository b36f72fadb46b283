"""Sources: interlinear transcriptions, JSON corpora, plain-text and XML controls, worklists, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.tokens import carry_forward

# Fixed patterns of the transcription format.
HEADER = r"^<(f[0-9]+[rv][0-9]*)>\s*<!\s*(.*?)>"
LOCUS = r"^<(f[0-9]+[rv][0-9]*)\.(\d+),([^;]*);([A-Z])>\s*(.*)$"


def clean_words(raw: Column | str) -> Column:
    """Words of a transcribed line: markup and comments go, [a:b] reads a, * is an unread glyph, commas part words. The order of the rules matters."""
    s = F.col(raw) if isinstance(raw, str) else raw
    # fixed rules of the format, in their order
    for pattern, to in ((r"<[^>]*>", ""), (r"\{[^}]*\}", ""), (r"\[([^:\]]*):[^\]]*\]", "$1"), ("[!%]", ""), (r"\*", "?"), (",", ".")):
        s = F.regexp_replace(s, pattern, to)
    return F.filter(F.split(F.trim(s), r"\."), lambda w: w != "")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files; a file is one row of the scan, so its lines keep their order. Saved error pages are left out."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.where(~F.trim("value").rlike(r"^\d{3}: ")).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def transcription(lines: DataFrame, transcriber: str = "H") -> DataFrame:
    """(folio, line, locus, words) of one transcriber, lines without words left out."""
    part = lambda k: F.regexp_extract("line", LOCUS, k)
    rows = lines.where(F.col("line").rlike(LOCUS)).select(
        part(1).alias("folio"), part(2).cast("int").alias("line"), part(3).alias("locus"), part(4).alias("who"), clean_words(part(5)).alias("words"), F.col("line_no").alias("file_line")
    )
    return rows.where((F.col("who") == transcriber) & (F.size("words") > 0)).drop("who")


def page_headers(lines: DataFrame) -> DataFrame:
    """(folio, meta map): the $key=value pairs of page headers."""
    body = F.regexp_extract("line", HEADER, 2)
    keys, values = (F.regexp_extract_all(body, F.lit(r"\$([A-Z])=(\S+)"), F.lit(k)) for k in (1, 2))
    return lines.where(F.col("line").rlike(HEADER)).select(F.regexp_extract("line", HEADER, 1).alias("folio"), F.map_from_arrays(keys, values).alias("meta"))


def tiers(lines: DataFrame, page: str = "folio", order: str = "line_no", comment: str = "comment") -> DataFrame:
    """Column tier: the last comment before a line of its page."""
    return carry_forward(lines, [page], order, comment, "tier")


CORPUS = T.StructType([
    T.StructField("meta", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
    T.StructField("folios", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("locus", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])))),
])


def json_corpus(spark: SparkSession, path: str, dialect: str | None = None) -> DataFrame:
    """(folio, line, locus, words, meta) of a corpus document keyed by folio; metadata that is missing counts as '?'."""
    return corpus_lines(spark.read.schema(CORPUS).option("multiLine", True).json(path), dialect)


def corpus_lines(docs: DataFrame, dialect: str | None = None) -> DataFrame:
    """The lines of corpus documents (meta, folios) that have been read."""
    rows = docs.select("meta", F.explode("folios").alias("folio", "ls")).select("folio", F.col("meta")[F.col("folio")].alias("meta"), F.explode("ls").alias("l")).select("folio", "meta", "l.*")
    return rows if dialect is None else rows.where(F.coalesce(F.col("meta").getItem("L"), F.lit("?")) == dialect)


TOKEN = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("folio",)], T.StructField("line", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("locus", "lprefix", "lcode", "role")],
    *[T.StructField(n, T.IntegerType()) for n in ("idx", "nline", "linepos")], T.StructField("word", T.StringType()), T.StructField("uncertain", T.BooleanType()),
    *[T.StructField(n, T.StringType()) for n in ("section", "currier", "quire", "hand")],
])


def token_table(spark: SparkSession, path: str, role: str | None = None, section: str | None = None, currier: str | None = None) -> DataFrame:
    """Tokens of a body document ({"tokens": [...]}), certain ones, by role, section and currier."""
    schema = T.StructType([T.StructField("tokens", T.ArrayType(TOKEN))])
    rows = certain_tokens(spark.read.schema(schema).option("multiLine", True).json(path))
    for name, value in (("role", role), ("section", section), ("currier", currier)):
        if value is not None:
            rows = rows.where(F.coalesce(name, F.lit("?")) == value)
    return rows


def certain_tokens(docs: DataFrame) -> DataFrame:
    """Tokens of body documents (tokens) that have been read, without uncertain ones."""
    return docs.select(F.explode("tokens").alias("t")).select("t.*").where(~F.coalesce("uncertain", F.lit(False)))


def plain_words(text: Column | str, keep: int | None = None) -> Column:
    """Words of a control text: lower case, everything but a-z a space; the first `keep` of them."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z]", " "), " +"), lambda w: w != "")
    return words if keep is None else F.slice(words, 1, keep)


def book_body(text: Column | str) -> Column:
    """Text between the start and end marks of a public-domain e-book."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(t, r"(?is)^.*?\*\*\* ?start of[^\n]*?\*\*\*", ""), r"(?is)\*\*\* ?end of.*$", "")


def unicode_words(text: Column | str, cap: int | None = None) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(t), F.lit(r"(\p{L}+)"), F.lit(1))
    return words if cap is None else F.slice(words, 1, cap)


# Letters with marks and what they read without them (fixed values for Western European texts).
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūăĕĭŏŭ", "aaaaaaceeeeiiiinooooouuuuyyaeiouaeiou")


def strip_accents(text: Column | str) -> Column:
    return F.translate(F.lower(F.col(text) if isinstance(text, str) else text), *ACCENTS)


def latin_letters(text: Column | str) -> Column:
    """Latin orthography folded: j as i, v and w as u, k as c; ae and oe ligatures opened; letters alone."""
    t = F.translate(strip_accents(text), "jvwk", "iuuc")
    t = F.regexp_replace(F.regexp_replace(t, "æ", "ae"), "œ", "oe")
    return F.regexp_replace(t, "[^a-z]", "")


def code_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def canvas_order(doc: Column | str) -> Column:
    """Pages in order from a list of [label, width, height, url], views of edges and covers left out."""
    rows = F.from_json(doc, "array<array<string>>")
    pages = F.filter(rows, lambda r: ~F.lower(r[0]).rlike("edge|spine|fore|head|tail"))
    return F.transform(pages, lambda r, i: F.struct(i.alias("page"), r[0].alias("label"), r[1].cast("int").alias("width"), r[2].cast("int").alias("height"), r[3].alias("url")))


def expansions(line: Column | str) -> Column:
    """array of struct(visible, omitted, expanded) from <expan>visible<ex>omitted</ex>...</expan>."""
    t = F.col(line) if isinstance(line, str) else line
    marks = F.regexp_extract_all(t, F.lit(r"(<expan>.*?</expan>)"), F.lit(1))
    strip = lambda x: F.regexp_replace(x, "<[^>]*>", "")
    return F.transform(marks, lambda m: F.struct(strip(F.regexp_replace(m, "<ex>.*?</ex>", "")).alias("visible"), F.array_join(F.regexp_extract_all(m, F.lit("<ex>(.*?)</ex>"), F.lit(1)), "").alias("omitted"), strip(m).alias("expanded")))


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by `order`, then by the whole row."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("m_")).select(*keys, "m_.*").select(*rows.columns)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, md5) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def page_features(spark: SparkSession, path: str) -> DataFrame:
    """(page, ink, green, redbrown, blue, edge) from an array of six-tuples."""
    names = ("page", "ink", "green", "redbrown", "blue", "edge")
    doc = spark.read.option("wholetext", True).text(path)
    rows = doc.select(F.explode(F.from_json("value", "array<array<double>>")).alias("r"))
    return rows.select(*[F.col("r")[i].alias(n) for i, n in enumerate(names)]).withColumn("page", F.col("page").cast("int"))


def write_results(df: DataFrame, path: str, kind: str = "json", top: tuple[int, list] | None = None) -> None:
    """Result sink: JSON lines, Parquet or CSV; top = (n, order) writes the first n rows alone."""
    out = df.orderBy(*top[1]).limit(top[0]) if top else df
    writer = out.write.mode("overwrite")
    {"json": writer.json, "parquet": writer.parquet, "csv": writer.option("header", True).csv}[kind](path)


def html_text(html: Column | str) -> Column:
    """Text of a page: scripts, styles, comments and tags go, common entities are read, white space is squeezed."""
    t = F.col(html) if isinstance(html, str) else html
    for pattern, to in ((r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"), (r"[ \t\n\r]+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)
