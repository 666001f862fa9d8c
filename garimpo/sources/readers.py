"""Readers of document files. Files are listed and read by Spark; parsers run on workers.

Formats that need an absent library (xlsx, pdf, docx, pptx) are asked from pluggable parsers; without one the
row carries the error instead of failing the job.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, MAX_BYTES = (".txt", ".md"), 2 << 30
KNOWN = (*TEXT, ".csv", ".xlsx", ".xls", ".pdf", ".docx", ".pptx")
Parser = Callable[[bytes], str]


def decode(data: bytes) -> str:
    """UTF-8 (with or without mark), else cp1252, else Latin-1."""
    for page in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(page)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def csv_markdown(text: str) -> tuple[str, int]:
    """(pipe table, rows) of delimited text; the delimiter is found in the first 4,096 characters."""
    # The sign that most lines of the sample hold, of these the most frequent.
    sample = [x for x in text[:4096].splitlines() if x.strip()]
    delimiter = max(",;\t|", key=lambda d: (sum(d in x for x in sample), sum(x.count(d) for x in sample)))
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=delimiter)]
    rows = [r for r in rows if any(r)]
    if not rows:
        return "", 0
    n = len(rows[0])
    fitted = [(r + [""] * n)[:n] for r in rows]
    lines = [" | ".join(r) for r in fitted]
    return "\n".join([f"| {lines[0]} |", "|" + " --- |" * n, *[f"| {x} |" for x in lines[1:]]]), len(rows) - 1


def xlsx_markdown(data: bytes) -> str:
    import openpyxl  # optional

    book = openpyxl.load_workbook(io.BytesIO(data), read_only=True, data_only=True)
    out = []
    for sheet in book.worksheets:
        rows = [["" if c is None else str(c).strip() for c in r] for r in sheet.iter_rows(values_only=True)]
        rows = [r for r in rows if any(r)]
        if rows:
            out.append(f"## {sheet.title}\n| {' | '.join(rows[0])} |\n|" + " --- |" * len(rows[0]) + "\n" + "\n".join(f"| {' | '.join(r)} |" for r in rows[1:]))
    return "\n\n".join(out)


def documents(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, suffix, size, text, rows, error of every file under path. Content is only read for allowed files."""
    extra = dict(parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, s, n, data in zip(pdf["path"], pdf["suffix"], pdf["length"], pdf["content"]):
                text, rows, error = None, None, None
                try:
                    if s in extra:
                        text = extra[s](bytes(data))
                    elif s in TEXT:
                        text = decode(bytes(data))
                    elif s == ".csv":
                        text, rows = csv_markdown(decode(bytes(data)))
                    elif s == ".xlsx":
                        text = xlsx_markdown(bytes(data))
                    else:
                        error = f"formato sem leitor: {s}"
                except ImportError as e:
                    error = f"biblioteca ausente: {e.name}"
                except Exception as e:  # a broken file must not stop the others
                    error = f"{type(e).__name__}: {e}"[:500]
                out.append((p, s, n, text, rows, error))
            yield pd.DataFrame(out, columns=["path", "suffix", "size", "text", "rows", "error"]).astype({"rows": "Int64"})

    allowed = files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*KNOWN) & (F.col("length") <= max_bytes))
    return allowed.select("path", "suffix", "length", "content").mapInPandas(parse, "path string, suffix string, size long, text string, rows long, error string")


def refused(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files that are not read, with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    why = F.when(~suffix.isin(*KNOWN), "extensao nao permitida").when(F.col("length") > max_bytes, "arquivo grande demais")
    return files.select("path", "length", why.alias("reason")).filter("reason is not null")


def first_filled(*frames: DataFrame) -> DataFrame:
    """The first of several extractions that has rows (a cascade of extractors)."""
    for df in frames[:-1]:
        if not df.limit(1).isEmpty():
            return df
    return frames[-1]


def gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, query_type, id, grade of a judged question set in JSON."""
    raw = spark.read.option("multiLine", True).schema("corpus array<struct<id string, text string>>, queries array<struct<question string, relevant array<string>, partially_relevant array<string>, query_type string>>").json(path)
    q = raw.select(F.posexplode("queries").alias("query_id", "q"))
    both = F.concat(F.transform("q.relevant", lambda i: F.struct(i.alias("id"), F.lit(2).alias("grade"))), F.transform(F.coalesce("q.partially_relevant", F.array()), lambda i: F.struct(i.cast("string").alias("id"), F.lit(1).alias("grade"))))
    return q.select(F.col("query_id").cast("long").alias("query_id"), "q.question", "q.query_type", F.explode_outer(both).alias("x")).select("query_id", "question", "query_type", "x.id", "x.grade")
