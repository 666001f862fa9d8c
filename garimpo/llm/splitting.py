"""Cutting oversized texts at natural boundaries, by ranges.

A text is cut into ranges of ``range_chars``; each range finds its own boundaries, with a halo of one character
before it (a blank is a boundary only after a sentence sign). What a range reports is small: the stretch before
its first boundary, the longest stretch inside, the stretch after its last one. These boundary tables are
stitched in range order, and give

* the cut class of the text (``cut_classes``, ``file_class``), and
* by the first boundary of every range, the regions in which pieces are packed independently
  (``pieces`` for columns, ``file_pieces`` for files that are read by byte range only); piece numbers are the
  prefix sum of the regions' counts.

Pieces hold at most ``limit`` characters (code points), the overlap with the piece before included; a cut
stands at the last sentence boundary that fits, else at the last blank, else inside the word.

Defined cases: null, empty and blank texts and those up to the limit have no cut class; ``pieces`` gives them
as one piece (null and empty: none). A text without any boundary is cut by length. Re-delivered rows count
once. Column names of the input do not matter, as only key and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.session import settle

LIMIT, OVERLAP, RANGE = 2000, 160, 4096
SENTENCE = r"\n|(?<=[.!?;:])[ \t\r]"
WORD = r"[ \t\r\n]"
SENTENCE_RE, WORD_RE = re.compile(SENTENCE), re.compile(WORD)


Reach = tuple[int, int, int, int]


def reach(part: str, halo: str, pattern: re.Pattern) -> Reach:
    """(first, longest inside, last, whole): stretch lengths of a range; first is -1 where it has no boundary."""
    lengths = [len(x) for x in pattern.split(halo + part)]
    if len(lengths) == 1:
        return -1, 0, 0, len(part)
    return lengths[0] - len(halo), max(lengths[1:-1], default=0), lengths[-1], len(part)


def stitched(tables: Iterable[Reach]) -> int:
    """The longest stretch of a text from the boundary tables of its ranges, in order."""
    most = carry = 0
    for first, inside, last, whole in tables:
        if first >= 0:
            most, carry = max(most, carry + first, inside), last
        else:
            carry += whole
    return max(most, carry)


def range_parts(text: str, range_chars: int) -> Iterator[tuple[str, str]]:
    """(range, its halo); the halo is one character that tells whether a sentence sign stands before the range."""
    for lo in range(0, len(text), range_chars):
        yield text[lo : lo + range_chars], ("." if lo and text[lo - 1] in ".!?;:" else "x")


def cut_class(text: str, limit: int = LIMIT, range_chars: int = RANGE) -> str:
    parts = list(range_parts(text, range_chars))
    for name, pattern in (("sentence", SENTENCE_RE), ("word", WORD_RE)):
        if stitched(reach(p, h, pattern) for p, h in parts) <= limit:
            return name
    return "char"


def cut_classes(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, range_chars: int = RANGE) -> DataFrame:
    """row_key, cut_class of each text over the limit.

    A text in a column lies with one worker anyway, which goes through its ranges once; see ``file_class`` for
    texts that no worker holds whole.
    """
    long = df.filter((F.length(text) > limit) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("t"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [cut_class(t, limit, range_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.string())], names=["row_key", "cut_class"])

    # Re-delivered rows give the same class again.
    return long.mapInArrow(judge, "row_key long, cut_class string").distinct()


def pack(body: str, behind: str, limit: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, cut) of the pieces of a region, relative to its start. behind: up to overlap characters before it."""
    at, end = 0, len(body)
    back = len(behind)
    while at < end:
        lead = min(overlap, at + back) if (at or back) else 0
        room = limit - lead
        if end - at <= room:
            yield at - lead, end, "end"
            return
        window = body[at : at + room + 1]
        stop, cut = 0, "char"
        for pattern, name in ((SENTENCE_RE, "sentence"), (WORD_RE, "word")):
            for m in pattern.finditer(window):
                if 0 < m.end() <= room:
                    stop = m.end()
            if stop:
                cut = name
                break
        stop = stop or room
        yield at - lead, at + stop, cut
        at += stop


def region_starts(text: str, range_chars: int) -> list[int]:
    """Where regions begin: after the first boundary of each range, else after its first blank, else at the range."""
    out = [0]
    for lo in range(range_chars, len(text), range_chars):
        part = ("." if text[lo - 1] in ".!?;:" else "x") + text[lo : lo + range_chars]
        m = SENTENCE_RE.search(part) or WORD_RE.search(part)
        at = lo + (m.end() - 1 if m else 0)
        if out[-1] < at < len(text):
            out.append(at)
    return out


def cut_pieces(text: str, limit: int, overlap: int, range_chars: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, cut) of the pieces of a text, region by region."""
    starts = region_starts(text, range_chars)
    for start, stop in zip(starts, [*starts[1:], len(text)]):
        for a, b, how in pack(text[start:stop], text[max(0, start - overlap) : start], limit, overlap):
            yield start + a, start + b, how


def pieces(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = 4 * LIMIT) -> DataFrame:
    """row_key, piece_no, start, end, cut, piece. Regions begin at the first boundary of each range after the first.

    One pass over each text: regions are packed in order, so that piece numbers are the running sum of what the
    regions before hold, and no piece is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = df.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("t")).filter((F.length("t") > 0) & F.col("row_key").isNotNull()).dropDuplicates(["row_key"])
    names = ["row_key", "piece_no", "start", "end", "cut", "piece"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            size = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, (a, b, how) in enumerate(cut_pieces(t, limit, overlap, range_chars)):
                    for column, v in zip(out, (k, no, a, b, how, t[a:b])):
                        column.append(v)
                    size += b - a
                    if size > 4_000_000:  # pieces of a giant text leave in bounded batches
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, PIECE_TYPES)], names=names)
                        out, size = ([], [], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, PIECE_TYPES)], names=names)

    return rows.mapInArrow(emit, "row_key long, piece_no long, start long, end long, cut string, piece string")


PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
BLOCK_OF_REGIONS = 1024


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _read(path: str, lo: int, hi: int) -> bytes:
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        return f.read_at(max(0, hi - lo), lo)


def file_ranges(spark: SparkSession, path: str | list[str], range_bytes: int) -> DataFrame:
    """path, size, n: the byte ranges of one or several giant files. Only names and sizes are read here."""
    files = [(p, _open(p)[0].get_file_info(_open(p)[1]).size) for p in ([path] if isinstance(path, str) else path)]
    made = spark.createDataFrame(files, "path string, size long").filter("size > 0")
    ranges = made.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.lit(range_bytes)))).alias("n"))
    total = sum(-(-size // range_bytes) for _, size in files)
    return ranges.repartition(max(1, min(total, 100_000)), "path", "n")


def file_class(spark: SparkSession, path: str | list[str], limit: int = LIMIT, range_bytes: int = 8 << 20) -> DataFrame:
    """path, cut_class of each file over the limit: workers report the boundary table of their range, tables are stitched.

    A range begins and ends at whole characters; its halo is the byte before it.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, size, n in pdf.itertuples(index=False):
                lo, hi = int(n) * range_bytes, min(size, (int(n) + 1) * range_bytes)
                raw = _read(p, max(0, lo - 1), min(size, hi + 3))
                head = raw[:1] if lo else b""
                raw = raw[len(head) :]
                begin = next((i for i in range(min(3, len(raw))) if raw[i] & 0xC0 != 0x80), 0) if lo else 0
                end = hi - lo
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                part, halo = raw[begin:end].decode("utf-8", "replace"), "." if head and head in b".!?;:" else "x"
                s, w = reach(part, halo, SENTENCE_RE), reach(part, halo, WORD_RE)
                out.append((p, int(n), list(s), list(w)))
            yield pd.DataFrame(out, columns=["path", "n", "s", "w"])

    tables = file_ranges(spark, path, range_bytes).mapInPandas(judge, "path string, n long, s array<long>, w array<long>")
    # A row of eight numbers for each range; 100,000 of them for a file of 800 GB.
    whole = tables.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", "s", "w"))).alias("t"))

    @F.pandas_udf("string")
    def stitch(rows: pd.Series) -> pd.Series:
        out = []
        for t in rows:
            s, w = [tuple(x["s"]) for x in t], [tuple(x["w"]) for x in t]
            out.append(None if sum(x[3] for x in s) <= limit else "sentence" if stitched(s) <= limit else "word" if stitched(w) <= limit else "char")
        return pd.Series(out, dtype=object)

    return whole.select("path", stitch("t").alias("cut_class")).filter("cut_class is not null")


def file_pieces(spark: SparkSession, path: str | list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """path, piece_no, start, end, cut, piece of giant UTF-8 files, which no worker ever loads whole.

    Workers read byte ranges with a halo and report the first boundary of each; the next range's closes a region.
    Regions are packed to learn how many pieces each holds, the counts are summed up in order (by blocks of
    regions, so that no task holds the whole table), and regions are packed again into numbered pieces. Pieces
    are never shuffled. Offsets are in bytes. path: local or any pyarrow file system's.
    """
    boundary = re.compile(rb"\n|(?<=[.!?;:])[ \t\r]")
    blank = re.compile(rb"[ \t\r\n]")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, size, i in pdf.itertuples(index=False):
                lo = int(i) * range_bytes
                at = 0
                if lo:
                    part = _read(p, lo - 1, min(size, lo + range_bytes))
                    m = boundary.search(part, 1) or blank.search(part, 1)
                    at = lo + (m.end() - 1 if m else next((k for k in range(len(part) - 1) if part[k + 1] & 0xC0 != 0x80), 0))
                out.append((p, size, i, at))
            yield pd.DataFrame(out, columns=["path", "size", "n", "start"])

    table = settle(file_ranges(spark, path, range_bytes).mapInPandas(starts, "path string, size long, n long, start long"))
    # One small row for each range; the next range's start closes a region.
    following = table.select("path", (F.col("n") - 1).alias("n"), F.col("start").alias("stop"))
    regions = table.join(following, ["path", "n"], "left").withColumn("stop", F.coalesce("stop", F.col("size"))).filter("stop > start").select("path", "n", "start", "stop")

    def packed(p: str, start: int, stop: int):
        lead = max(0, start - 4 * overlap)
        raw = _read(p, lead, stop)
        behind = raw[: start - lead].decode("utf-8", "ignore")[-overlap:] if overlap else ""
        body = raw[start - lead :].decode("utf-8", "replace")
        return behind, body, pack(body, behind, limit, overlap)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(c=[sum(1 for _ in packed(p, a, b)[2]) for p, a, b in zip(pdf["path"], pdf["start"], pdf["stop"])])

    counted = settle(regions.mapInPandas(count, "path string, n long, start long, stop long, c long").withColumn("block", F.floor(F.col("n") / BLOCK_OF_REGIONS)))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("path", "block").agg(F.sum("c").alias("c")).select("path", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("first_no", F.coalesce(F.sum("c").over(within), F.lit(0))).join(blocks, ["path", "block"]).select("path", "start", "stop", (F.col("first_no") + F.col("base")).alias("first_no"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, start, stop, no in pdf.itertuples(index=False):
                behind, body, made = packed(p, start, stop)
                whole, out, at, at_byte = behind + body, [], 0, start
                for k, (a, b, how) in enumerate(made):
                    text = whole[a + len(behind) : b + len(behind)]
                    if a >= at:  # bytes are counted on from the piece before
                        at_byte += len(body[at:a].encode())
                        at, lo = a, at_byte
                    else:
                        lo = start - len(behind[a:].encode())
                    out.append((p, no + k, lo, lo + len(text.encode()), how, text))
                yield pd.DataFrame(out, columns=["path", "piece_no", "start", "end", "cut", "piece"])

    # Regions are small rows: as many tasks as there are regions, up to a bound.
    return placed.repartition(max(1, min(100_000, table.count())), "path", "start").mapInPandas(emit, "path string, piece_no long, start long, end long, cut string, piece string")
