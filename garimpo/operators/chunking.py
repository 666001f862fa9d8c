"""Greedy packing of sentences, rows, paragraphs and articles into chunks.

Each text is one row and is packed where it lies; nothing is grouped or shuffled. Table rows are packed by
file, which their extraction holds in one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import text as X


def pack_sentences(found: list[str], size: int, overlap: int) -> list[str]:
    """Sentences joined up to size; each chunk begins with the last whole sentences of the one before, up to overlap. Longer sentences are cut with a stride."""
    chunks: list[str] = []
    now: list[str] = []
    for s in found:
        if len(s) > size:
            if now:
                chunks.append(" ".join(now))
                now = []
            chunks += [piece for i in range(0, len(s), size - overlap) if (piece := s[i : i + size].strip())]
            continue
        if now and len(" ".join(now)) + 1 + len(s) > size:
            chunks.append(" ".join(now))
            tail: list[str] = []
            while now and len(" ".join([now[-1], *tail])) <= overlap:
                tail.insert(0, now.pop())
            now = tail
        now.append(s)
    return chunks + ([" ".join(now)] if now else [])


def general(texts: DataFrame, key: str, text: str, size: int = 512, overlap: int = 160) -> DataFrame:
    """key, chunk_index, text."""
    rows = texts.filter(F.length(F.trim(text)) > 0).select(key, X.sentences(F.col(text)).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, c) for k, s in zip(pdf[key], pdf["s"]) for i, c in enumerate(pack_sentences(list(s), size, overlap))]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "text"])

    return rows.mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, chunk_index int, text string")


def pack_rows(rows: list[tuple[int, str]], group: int, size: int, whole: bool = False) -> list[tuple[int, int, int, str]]:
    """(first row, last row, number, text): up to group rows and size characters; a longer row alone, cut.

    whole: what a longer row has over goes into further chunks, else only its beginning is kept.
    """
    out: list[tuple[int, int, int, str]] = []
    now: list[tuple[int, str]] = []

    def flush() -> None:
        if now:
            out.append((now[0][0], now[-1][0], len(now), "\n".join(t for _, t in now)))
            now.clear()

    for i, t in rows:
        if len(t) > size:
            flush()
            out += [(i, i, 1, t[lo : lo + size]) for lo in range(0, len(t) if whole else 1, size)]
            continue
        if now and (len(now) >= group or sum(len(x) + 1 for _, x in now) + len(t) > size):
            flush()
        now.append((i, t))
    flush()
    return out


def tabular(extractions: DataFrame, group: int = 5, size: int = 512, single: bool = False, header: bool = False, whole: bool = False) -> DataFrame:
    """extraction_id, row_start, row_end, row_count, text. single: one row a chunk; header: the columns' names first; whole: see pack_rows.

    No chunk is larger than size, its header line included.
    """
    rows = extractions.dropDuplicates(["extraction_id"]).select("extraction_id", F.array_sort(F.transform("records", lambda r: F.struct(r["row_index"].alias("i"), F.coalesce(r["texto_canonico"], F.lit("")).alias("t")))).alias("r"), F.array_join("column_names", " | ").alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e, records, names in zip(pdf["extraction_id"], pdf["r"], pdf["names"]):
                lead = f"colunas: {names}\n" if header else ""
                lead = lead if len(lead) < size else ""
                made = pack_rows([(r["i"], r["t"]) for r in records if r["t"]], 1 if single else group, size - len(lead), whole)
                out += [(e, a, b, n, lead + t) for a, b, n, t in made]
            yield pd.DataFrame(out, columns=["extraction_id", "row_start", "row_end", "row_count", "text"])

    return rows.mapInPandas(run, "extraction_id long, row_start int, row_end int, row_count int, text string")


ARTICLE = re.compile(r"^[ \t]*art\.?\s*(\d+)", re.I | re.M)
PARAGRAPH = re.compile(r"^((?:§\s*\d+[°ºª]?\s*[-–—.:]?\s*)|(?:Par[áa]grafo\s+[ÚUúu]nico\s*[-–—.:]\s*))", re.I | re.M)
ITEM = re.compile(r"^((?:[IVXLCDM]+|\d+)\s*[-–—]\s+)", re.I | re.M)
HEADINGS = tuple((k, re.compile(rf"^[ \t]*({p}\s+(?:[IVXLCDM]+|\d+)\b[^\n]*)", re.I | re.M)) for k, p in (("titulo", "T[IÍ]TULO"), ("capitulo", "CAP[IÍ]TULO"), ("secao", "SE[CÇ][AÃ]O")))


def split_legal(text: str, threshold: int = 800) -> list[dict]:
    """Parents (whole articles), children (caput and paragraphs, else items) of long articles, general text before the first article."""
    marks = sorted((m.start(), level, kind, m[1].strip()) for level, (kind, p) in enumerate(HEADINGS) for m in p.finditer(text))
    articles = list(ARTICLE.finditer(text))
    if not articles:
        return [{"text": text, "chunk_type": "general", "artigo": "", "part": "", "path": ""}]
    out = []
    lead = text[: articles[0].start()].strip()
    if lead:
        out.append({"text": lead, "chunk_type": "general", "artigo": "", "part": "", "path": ""})
    for i, m in enumerate(articles):
        body = text[m.start() : articles[i + 1].start() if i + 1 < len(articles) else len(text)].strip()
        place: dict[str, str] = {}
        for at, level, kind, label in marks:
            if at <= m.start():
                place = {k: v for k, v in place.items() if [h[0] for h in HEADINGS].index(k) < level} | {kind: label}
        label = f"Art. {m[1]}"
        path = " > ".join([*place.values(), label])
        out.append({"text": body, "chunk_type": "parent", "artigo": label, "part": "", "path": path})
        if len(body) <= threshold:
            continue
        cuts = list(PARAGRAPH.finditer(body)) or list(ITEM.finditer(body))
        if not cuts:
            continue
        ends = [c.start() for c in cuts[1:]] + [len(body)]
        caput = body[: cuts[0].start()].strip()
        parts = ([("caput", caput)] if caput else []) + [(c[1].strip().rstrip("-–—.: "), body[c.start() : e].strip()) for c, e in zip(cuts, ends)]
        out += [{"text": t, "chunk_type": "child", "artigo": label, "part": p, "path": f"{path} > {p}"} for p, t in parts if t]
    return out


def legal(texts: DataFrame, key: str, text: str, threshold: int = 800) -> DataFrame:
    """key, chunk_index, chunk_type, artigo, part, path, parent_key, refs, text."""
    rows = texts.filter(F.length(F.trim(text)) > 0).select(key, F.col(text).alias("t"))
    names = ["chunk_type", "artigo", "part", "path", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, *[c[n] for n in names]) for k, t in zip(pdf[key], pdf["t"]) for i, c in enumerate(split_legal(t, threshold))]
            yield pd.DataFrame(out, columns=[key, "chunk_index", *names])

    made = rows.mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, chunk_index int, chunk_type string, artigo string, part string, path string, text string")
    parent = F.when(F.col("artigo") != "", F.concat_ws("::", F.col(key).cast("string"), "artigo"))
    return made.withColumn("parent_key", parent).withColumn("refs", F.array_join(X.article_refs(F.col("text"), F.col("artigo")), ", "))


def table_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, header, cells of pipe tables: rows under a header line, without separators, repeated headers and rows that do not look tabular."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.transform(F.split(F.trim(F.trim(x), F.lit("|")), r"\|"), lambda c: F.trim(c)).alias("cells"))), lambda x: F.size(x["cells"]) > 1)
    rows = texts.filter(F.contains(F.col(text), F.lit("|"))).select(key, lines.alias("l")).filter(F.size("l") > 1)
    head = F.get("l", F.lit(0))["cells"]
    each = rows.select(key, head.alias("header"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("x")).select(key, "header", F.col("x.line").alias("line"), F.col("x.cells").alias("cells"))
    filled = F.filter("cells", lambda c: c != "")
    same = F.lower(F.array_join("cells", "|")) == F.lower(F.array_join("header", "|"))
    ruler = F.forall("cells", lambda c: c.rlike(r"^:?-{2,}:?$"))
    looks = F.exists("cells", lambda c: c.rlike(r"^\d{5,}$")) | F.get("cells", F.lit(0)).rlike(r"^[A-Za-z]*\d+[A-Za-z0-9]*$") | (F.size(F.filter("cells", lambda c: c.rlike(r"\d"))) >= 2) | (F.size(filled) >= F.greatest(F.lit(3), F.least(F.size("header"), F.lit(4))))
    return each.filter(~same & ~ruler & (F.size(filled) >= F.greatest(F.lit(2), F.least(F.size("header"), F.lit(3)))) & looks)
