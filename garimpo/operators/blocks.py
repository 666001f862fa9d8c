"""Blocks of parsed pages: kinds, repetition, paragraphs, section hints, quality and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.text import compact, norm_match

PAGE_HEIGHT = 842.0
CONTENT = ("body", "table", "title", "section_header", "annex")


def kind(text: Column, y: Column, height: float = PAGE_HEIGHT) -> Column:
    """Kind of a block by its text and its distance from the top of the page. Marks on letters do not matter."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = norm_match(t)
    y = F.coalesce(y, F.lit(0.0))
    foot = n.rlike(r"pagina\s+\d+\s+de\s+\d+|classificacao da informacao|\(baixado por\s+")
    head = n.rlike(r"n[°º]/rev\.?:|este documento faz parte")
    return (
        F.when((F.length(t) < 3) | n.rlike(r"^<!--\s*image\s*-->$|^\*{3,}$|^[-_=]{10,}$|^\d{1,4}$"), "noise")
        .when((y < height * 0.12) & head, "header").when((y > height * 0.88) & foot, "footer")
        .when(n.rlike(r"^(titulo\s+[ivxlcdm\d]+|estatuto\s+social|regulamento|regimento)\b"), "title")
        .when(n.rlike(r"^(capitulo|secao|parte)\s+[ivxlcdm\d]+"), "section_header").when(n.rlike(r"^anexo\s+[ivxlcdm\d]+"), "annex")
        .when(n.rlike(r"\|[^\n]*\||\+[-=]+\+"), "table")
        .when((y == 0) & foot, "footer").when((y == 0) & head, "header").otherwise("body")
    )


def rows_of(blocks: DataFrame) -> DataFrame:
    """doc, page, seq, kind, text, norm, y: each block once."""
    b = blocks.select("block_key", F.col("pdf_doc_id").alias("doc"), F.col("page_number").alias("page"), F.col("block_seq").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.get("bbox", F.lit(1)).alias("y"), F.col("block_type").alias("given")).dropDuplicates(["block_key"])
    return b.withColumn("norm", F.lower(compact(F.col("text"))))


def repeated(rows: DataFrame, least_pages: int = 3) -> DataFrame:
    """doc, norm: texts of ten characters or more on min(least, max(2, pages / 3)) pages or more."""
    pages = rows.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("pages"))
    on = rows.filter(F.length("norm") >= 10).select("doc", "norm", "page").distinct().groupBy("doc", "norm").agg(F.count("*").alias("n"))
    need = F.least(F.lit(least_pages), F.greatest(F.lit(2), F.floor(F.col("pages") / 3)))
    return on.join(pages, "doc").filter(F.col("n") >= need).select("doc", "norm")


def relabelled(rows: DataFrame) -> DataFrame:
    """Repeated body text is page furniture."""
    mark = repeated(rows).withColumn("again", F.lit(True))
    return rows.join(mark, ["doc", "norm"], "left").withColumn("kind", F.when(F.col("again") & (F.col("kind") == "body"), "header").otherwise(F.col("kind"))).drop("again")


STRETCH = 512  # places of a document that one window task holds


def carried(rows: DataFrame, doc: str, place: str | Column, order: list, marks: dict[str, Column], strict: bool = False, size: float | None = None) -> DataFrame:
    """rows with, for each name, the last of its marks at or before each row in its document (null before the first); strict: before each.

    A document may hold a third of all rows, so it is cut into stretches of places: the last marks of each
    stretch are aggregated, carried on over the small table of stretches, and filled in within the stretch. All
    marks are carried at once. size: places of a stretch.
    """
    names = list(marks)
    cut = rows.select("*", F.floor(F.coalesce(F.col(place) if isinstance(place, str) else place, F.lit(0)) / (size or STRETCH)).alias("_s"), *[m.alias(f"_m_{n}") for n, m in marks.items()])
    last = cut.groupBy(doc, "_s").agg(*[F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.struct(*order))).alias(f"_c_{n}") for n in names])
    before = Window.partitionBy(doc).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(doc, "_s", *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in names])
    within = Window.partitionBy(doc, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    filled = cut.select(*rows.columns, "_s", *[F.last(f"_m_{n}", ignorenulls=True).over(within).alias(f"_l_{n}") for n in names])
    both = filled.join(carry, [doc, "_s"], "left")
    return both.select(*[F.col(c) for c in rows.columns if c not in names], *[F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in names])


def with_hints(rows: DataFrame) -> DataFrame:
    """Each body block gets the text of the last title or section header before it in its document."""
    head = F.when(F.col("kind").isin("title", "section_header"), F.trim("text"))
    filled = carried(rows, "doc", "seq", ["seq", "block_key"], {"hint": head})
    return filled.withColumn("hint", F.when(F.col("kind") == "body", F.col("hint")))


def paragraphs(rows: DataFrame) -> DataFrame:
    """Neighbouring body blocks of a page whose text runs on become one. Islands stay within a page, so no document is gathered."""
    w = Window.partitionBy("doc", "page").orderBy("seq", "block_key")
    left, right = F.lag("text").over(w), F.col("text")
    run_on = (F.lag("kind").over(w) == "body") & (F.col("kind") == "body") & F.rtrim(left).rlike(r"[a-zA-ZÀ-ÿ,]$") & F.ltrim(right).rlike(r"^[a-zA-ZÀ-ÿ]")
    marked = rows.withColumn("new", F.when(run_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_key", "text"))), lambda x: F.trim(x["text"], F.lit(" \t\r\n")))
    return marked.groupBy("doc", "page", "island").agg(F.min("seq").alias("seq"), F.min("block_key").alias("block_key"), F.first("kind").alias("kind"), F.array_join(ordered, " ").alias("text"), F.count("*").alias("parts"))


def quality(rows: DataFrame) -> DataFrame:
    """Score, flags and shares of each document: two steps, page and document, so that no page list is kept."""
    share = lambda c: F.sum(c.cast("int")) / F.count("*")
    t = F.length(F.trim("text"))
    body = F.col("kind") == "body"
    again = rows.join(repeated(rows, 2).withColumn("again", F.lit(1)), ["doc", "norm"], "left")
    by_page = again.groupBy("doc", "page").agg(
        F.count("*").alias("n"), F.sum((F.col("kind") == "noise").cast("int")).alias("noise"), F.sum((t < 5).cast("int")).alias("empty"), F.max(F.col("kind").isin("title", "section_header").cast("int")).alias("structure"),
        F.sum(body.cast("int")).alias("body"), F.sum((body & (t < 20)).cast("int")).alias("broken"), F.sum(F.coalesce("again", F.lit(0))).alias("again"),
    )
    s = by_page.groupBy("doc").agg(F.sum("n").alias("total"), *[F.sum(c).alias(c) for c in ("noise", "empty", "body", "broken", "again")], F.max("structure").alias("structure"), F.count("*").alias("pages"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("dev"))
    ratio = lambda c: F.col(c) / F.col("total")
    broken = F.when(F.col("body") > 0, F.col("broken") / F.col("body")).otherwise(F.lit(0.0))
    coherence = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("dev") / (F.col("mean") + 1))).otherwise(F.lit(1.0))
    s = s.select("doc", "total", ratio("noise").alias("noise_ratio"), ratio("again").alias("repetition_ratio"), (F.col("structure") == 1).alias("structured"), broken.alias("broken_ratio"), ratio("empty").alias("empty_ratio"), coherence.alias("coherence"))
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.filter(F.array(
        flag(F.col("noise_ratio") > 0.3, "high_noise"), flag(F.col("repetition_ratio") > 0.2, "high_repetition"), flag(~F.col("structured"), "no_structure"), flag(F.col("broken_ratio") > 0.4, "many_broken_lines"),
        flag(F.col("empty_ratio") > 0.3, "many_empty_blocks"), flag(F.col("coherence") < 0.5, "inconsistent_pages")), lambda x: x.isNotNull())
    score = (1 - F.col("noise_ratio")) * 0.25 + (1 - F.col("repetition_ratio")) * 0.15 + F.when(F.col("structured"), 1.0).otherwise(0.3) * 0.2 + (1 - F.col("broken_ratio")) * 0.15 + (1 - F.col("empty_ratio")) * 0.1 + F.col("coherence") * 0.15
    return s.withColumn("flags", flags).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def gate(score: Column, flags: Column, least: float = 0.4) -> Column:
    score = F.round(score, 3)
    return F.when(score < least, "failed_parse").when((score < least + 0.15) | (F.size(flags) > 0), "needs_review").otherwise("success")


def page_context(rows: DataFrame, kinds: int = 4) -> DataFrame:
    """doc, page, kinds: the most frequent kinds of blocks of each page."""
    counts = rows.groupBy("doc", "page", "kind").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("n"), "kind"))).filter(F.col("r") <= kinds)
    return top.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "kind"))), lambda x: x["kind"]), "|").alias("kinds"))
