"""Sources that are containers: spreadsheets, zipped page XML, JSON files with a fallback; and sinks for reports and models.

A container is one row of a binary scan and is opened where it is read: files are dealt to tasks, the rows of one file
come from one task, a member at a time.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a spreadsheet container (fixed names of the format).
SHEET, STRINGS = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"


def squeezed(text: object) -> str:
    """Composed Unicode form with white space squeezed; null is the empty text."""
    return " ".join(unicodedata.normalize("NFC", "" if text is None else str(text)).split())


def normalized(text: Column | str) -> Column:
    """`squeezed` of a column, in Arrow batches: the JVM's SQL functions have no Unicode composition."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield x.map(squeezed)

    return F.pandas_udf(run, "string")(F.col(text) if isinstance(text, str) else text)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(reference: str) -> int:
    """Number of a column from 0, from a reference such as AB12."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook as texts; cells that are left out are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if STRINGS in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in ElementTree.fromstring(z.read(STRINGS)) if _local(item.tag) == "si"]
        with z.open(SHEET) as f:
            for _, row in ElementTree.iterparse(f):
                if _local(row.tag) != "row":
                    continue
                out: list[str | None] = []
                for cell in (c for c in row if _local(c.tag) == "c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(out)
                    value = "".join(x.text or "" for x in cell.iter() if _local(x.tag) in ("v", "t"))
                    out += [None] * (at + 1 - len(out))
                    out[at] = shared[int(value)] if cell.get("t") == "s" and value else value or None
                yield out
                row.clear()


def spreadsheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, row, *columns as strings) of the first sheets of workbooks, by the names in their first rows; ValueError if one is missing."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(data)
                head = next(rows, [])
                if missing := [c for c in columns if c not in head]:
                    raise ValueError(f"{where} has no columns {missing}")
                at, out = [head.index(c) for c in columns], []
                for i, row in enumerate(rows):
                    out.append((where, i, *[row[k] if k < len(row) else None for k in at]))
                yield pd.DataFrame(out, columns=["path", "row", *columns])

    kinds = ", ".join(["path string", "row long", *[f"`{c}` string" for c in columns]])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)


def merged_entries(rows: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """(keys, n, and sorted distinct ids of each kind): equal entries of a table become one."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.array_sort(F.collect_set(c)).alias(c) for c in ids])


def _without(node: ElementTree.Element, tag: str) -> str:
    """Text of a node without that of its parts named `tag`."""
    out = [node.text or ""]
    for child in node:
        out.append(("" if _local(child.tag) == tag else _without(child, tag)) + (child.tail or ""))
    return "".join(out)


def page_xml(spark: SparkSession, path: str, member: str = r"(?:.*/)?(\d+)[^/]*\.xml$") -> DataFrame:
    """(archive, member, book, writer, visible, omitted, expanded, fault) of every marked expansion in the text lines of zipped page XML.

    Members that do not match are passed over; the pattern's group is the book. fault is null, `unmarked` (nothing is
    marked as left out) or `empty`; such rows are kept, so that what a count leaves out can be told.
    """

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["archive", "member", "book", "writer", "visible", "omitted", "expanded", "fault"]
        for batch in files:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(z.namelist()):
                        if not (found := re.match(member, name)):
                            continue
                        out = []
                        for line in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "TextLine"):
                            text = next((x for x in line.iter() if _local(x.tag) == "Unicode"), None)
                            for mark in () if text is None else (x for x in text.iter() if _local(x.tag) == "expan"):
                                left = [x for x in mark.iter() if _local(x.tag) == "ex"]
                                parts = [squeezed(x).replace(" ", "") for x in (_without(mark, "ex"), "".join("".join(x.itertext()) for x in left), "".join(mark.itertext()))]
                                fault = "unmarked" if not left else None if parts[1] and parts[2] else "empty"
                                out.append((where, name, int(found[1]), squeezed(line.get("writerID")) or "unknown", *parts, fault))
                        yield pd.DataFrame(out, columns=names)

    kinds = "archive string, member string, book long, writer string, visible string, omitted string, expanded string, fault string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)


def expansion_pairs(marks: DataFrame) -> DataFrame:
    """(book, writer, visible, omitted, expanded, n) of faultless marks."""
    return marks.where("fault is null").groupBy("book", "writer", "visible", "omitted", "expanded").agg(F.count("*").alias("n"))


def json_files(spark: SparkSession, pattern: str, schema, fallback: str | None = None) -> DataFrame:
    """Documents of all files that match a pattern, or of `fallback` if none does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if (found is None or not len(found)) and fallback is None:
        raise FileNotFoundError(pattern)
    return spark.read.schema(schema).option("multiLine", True).json(pattern if found is not None and len(found) else fallback)


class Report:
    """Lines of a text report, kept until they are written; tables are told as aligned columns of their first rows."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def say(self, *parts: object) -> Report:
        self.lines += " ".join(map(str, parts)).split("\n")
        return self

    def table(self, df: DataFrame, most: int = 40) -> Report:
        rows = [df.columns, *[["" if x is None else str(x) for x in r] for r in df.limit(most).collect()]]
        width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
        self.lines += ["  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in rows]
        return self

    def write(self, spark: SparkSession, path: str) -> None:
        """One text file below path, replaced if it is there."""
        spark.createDataFrame([(x,) for x in self.lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model as Parquet tables below path, one for each name; the folder appears whole, replaced if it is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
