"""Structural scope of questions: which title, chapter, section or article is asked for, and which hits lie in it.

References are compared by value, so that "capítulo 2" and "CAPÍTULO II" meet. Hits are rows with query_id, id,
doc, score and the structural columns of a chunk (PLACE); questions are rows with query_id and question. All
operators serve many questions at once: joins are on document ids, caps are row numbers within a query, so
nothing is gathered by query beyond them.

Defined cases: null columns hold no reference; a question without references changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import numbers as N
from garimpo.functions import text as X

PLACE = ("titulo", "capitulo", "secao", "artigo", "paragrafo", "inciso", "caminho_hierarquico")
UNITS = ("titulo", "capitulo", "secao", "subsecao")
# Words of a question that name no content.
FILLERS = "dos das para com sem que uma por art artigo secao capitulo titulo sobre quais qual sao sua".split()


def numeral_value(c: Column) -> Column:
    """Value of digits or of a Roman numeral; null for anything else."""
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when(N.roman_to_int(c) > 0, N.roman_to_int(c))


def both_forms(c: Column) -> Column:
    """Digits and Roman form of each numeral of an array, beside what it holds."""
    other = F.transform(c, lambda x: F.when(x.rlike(r"^\d+$"), F.lower(N.int_to_roman(x.try_cast("int")))).when(N.roman_to_int(x) > 0, N.roman_to_int(x).cast("string")))
    return F.array_distinct(F.filter(F.concat(c, other), lambda x: x.isNotNull()))


def same_numeral(a: Column, b: Column) -> Column:
    """Whether two numerals are the same number, in whatever form; else the same text."""
    a, b = F.upper(F.trim(a)), F.upper(F.trim(b))
    va, vb = numeral_value(a), numeral_value(b)
    return F.when(va.isNotNull() | vb.isNotNull(), F.coalesce(va == vb, F.lit(False))).otherwise(a == b)


def unit_values(text: Column, unit: str) -> Column:
    """Values of the references to a unit in a text."""
    found = F.regexp_extract_all(X.norm_match(F.coalesce(text, F.lit(""))), F.lit(rf"\b{unit}\s+([ivxlcdm]+|\d{{1,4}})\b"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, numeral_value), lambda x: x.isNotNull()))


def article_values(text: Column) -> Column:
    found = F.regexp_extract_all(X.norm_match(F.coalesce(text, F.lit(""))), F.lit(r"\bart(?:igo)?\.?\s*([0-9]{1,4})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.try_cast("int")))


def _numbers(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(X.norm_match(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, numeral_value), lambda x: x.isNotNull()))


def targets(question: Column) -> Column:
    """Struct of the values asked for by unit."""
    return F.struct(*[unit_values(question, u).alias(u) for u in UNITS], article_values(question).alias("artigo"))


def asked(questions: DataFrame) -> DataFrame:
    """query_id, question, t (targets), words (content words and numerals)."""
    words = F.filter(X.words(F.col("question")), lambda w: ~F.array_contains(F.array(*map(F.lit, FILLERS)), w) & (w.rlike(r"^\d+$|^[ivxlcdm]{1,8}$") | (F.length(w) >= 3)))
    return questions.select("query_id", "question", targets(F.col("question")).alias("t"), F.array_distinct(words).alias("words"))


def structural_text(columns: tuple[str, ...] = PLACE) -> Column:
    """The structural columns that a chunk fills, as one text."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in columns]), lambda x: x != ""), " | ")


def chapter_match(t: Column) -> Column:
    return F.arrays_overlap(unit_values(structural_text(), "capitulo"), t["capitulo"])


def target_match(t: Column) -> Column:
    """A hit lies in a unit asked for: by the unit's own column (its numerals, if its name is damaged), or by a chapter named anywhere."""
    tests = []
    anywhere = unit_values(structural_text(), "capitulo")
    for unit in ("titulo", "capitulo", "secao"):
        own = F.array_union(unit_values(F.col(unit), unit), _numbers(F.col(unit), r"\b(?:[ivxlcdm]+|\d{1,4})\b"))
        tests.append(F.arrays_overlap(own, t[unit]) | F.arrays_overlap(anywhere, t[unit]))
    tests.append(F.arrays_overlap(anywhere, t["subsecao"]))
    tests.append(F.arrays_overlap(_numbers(F.col("artigo"), r"\d{1,4}"), t["artigo"]) | F.arrays_overlap(anywhere, t["artigo"]))
    return reduce(lambda a, b: a | b, tests)


def any_target(t: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.size(t[u]) > 0 for u in (*UNITS, "artigo")])


def overlap(words: Column, text: Column) -> Column:
    """Number of words that a text holds: numerals as whole words, others anywhere."""
    n = X.norm_match(text)
    padded = F.concat(F.lit(" "), F.regexp_replace(n, "[^a-z0-9]+", " "), F.lit(" "))
    held = lambda w: F.when(w.rlike(r"^\d+$|^[ivxlcdm]{1,8}$"), F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))).otherwise(F.contains(n, w))
    return F.size(F.filter(words, held))


def with_question(hits: DataFrame, questions: DataFrame) -> DataFrame:
    return hits.join(asked(questions), "query_id")


def strength(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits with the number of the question's words in their structural text."""
    return with_question(hits, questions).withColumn("strength", overlap(F.col("words"), structural_text())).drop("question", "t", "words")


def in_scope(hits: DataFrame, questions: DataFrame, least: int = 1) -> DataFrame:
    """Only the hits in the units asked for, where a query has at least ``least`` of them; else all of its hits."""
    told = with_question(hits, questions).withColumn("_in", target_match(F.col("t")))
    n = F.sum(F.col("_in").cast("int")).over(Window.partitionBy("query_id"))
    return told.withColumn("_n", n).filter(F.col("_in") | (F.col("_n") < least)).drop("_in", "_n", "question", "t", "words")


def boost_hints(hits: DataFrame, questions: DataFrame, bonus: float = 0.14, columns: tuple[str, ...] = ("titulo", "capitulo", "secao", "caminho_hierarquico", "artigo")) -> DataFrame:
    """Structural questions: bonus for the chapter asked for and for words of the question in a hit's headings."""
    told = with_question(hits, questions)
    structural = X.norm_match(F.col("question")).rlike("capitulo|secao|artigo|titulo|inciso|paragrafo")
    hint = structural_text(columns)
    extra = F.when(chapter_match(F.col("t")), 2.0 * bonus).otherwise(0.0) + F.least(F.when(hint != "", overlap(F.col("words"), hint)).otherwise(0), F.lit(3)) * (bonus * 0.45)
    return told.withColumn("score", F.col("score") + F.when(structural, extra).otherwise(0.0)).drop("question", "t", "words")


def prioritise(hits: DataFrame, questions: DataFrame, bonus: float = 0.32, parent: float = 0.08) -> DataFrame:
    """Hits of the chapter asked for first, with a bonus. Adds rank."""
    told = with_question(hits, questions).withColumn("_in", chapter_match(F.col("t")))
    told = told.withColumn("score", F.col("score") + F.when(F.col("_in"), bonus + F.when(F.col("chunk_type") == "parent", parent).otherwise(0.0)).otherwise(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("_in"), F.desc("score"), "id")
    return told.withColumn("rank", F.row_number().over(w)).drop("_in", "question", "t", "words")


def _first_docs(hits: DataFrame, most: int) -> DataFrame:
    """query_id, doc, place_of_doc: the first documents of each query, in the order of their best hit."""
    best = hits.filter(F.coalesce("doc", F.lit("")) != "").groupBy("query_id", "doc").agg(F.max(F.struct("score", (-F.col("id")).alias("late"))).alias("b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("b.score"), F.desc("b.late"))
    return best.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("query_id", "doc", "nth", F.col("b.score").alias("doc_score"))


def _candidates(hits: DataFrame, docs: DataFrame, questions: DataFrame, chunks: DataFrame, test) -> DataFrame:
    """Chunks of the documents that pass the test and are no hits yet."""
    wanted = docs.join(asked(questions), "query_id").filter(any_target(F.col("t")))
    return chunks.join(wanted, "doc").filter(test(F.col("t"))).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")


def _capped(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("nth", "place", "id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def supplement(hits: DataFrame, questions: DataFrame, chunks: DataFrame, max_docs: int = 3, max_add: int = 8, above: float = 0.08) -> DataFrame:
    """Further chunks of the chapter asked for from the first documents: query_id, id, score over the best hit's."""
    rows = _capped(_candidates(hits, _first_docs(hits, max_docs), questions, chunks, chapter_match), max_add)
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return rows.join(best, "query_id").select("query_id", "id", (F.col("best") + above).alias("score"))


def expand_chapter(hits: DataFrame, questions: DataFrame, chunks: DataFrame, max_docs: int = 3, max_add: int = 24, decay: float = 0.97) -> DataFrame:
    """The rest of the chapter asked for in the documents of hits that lie in it: query_id, id, score under the best anchor's."""
    anchors = with_question(hits, questions).filter(chapter_match(F.col("t"))).drop("question", "t", "words")
    rows = _capped(_candidates(hits, _first_docs(anchors, max_docs), questions, chunks, chapter_match), max_add)
    best = anchors.groupBy("query_id").agg(F.max("score").alias("best"))
    return rows.join(best, "query_id").select("query_id", "id", (F.col("best") * decay).alias("score"))


def scope_of_seeds(hits: DataFrame, questions: DataFrame, chunks: DataFrame, max_docs: int = 3, max_items: int = 80, above: float = 0.4) -> DataFrame:
    """All chunks of the units asked for in the documents of the seeds, in reading order: query_id, id, score, place_no."""
    docs = _first_docs(hits, max_docs)
    wanted = docs.join(asked(questions), "query_id").filter(any_target(F.col("t")))
    rows = _capped(chunks.join(wanted, "doc").filter(target_match(F.col("t"))), max_items)
    w = Window.partitionBy("query_id").orderBy(F.coalesce("page_number", F.lit(10**9)), F.coalesce("place", F.lit(10**9)), "id")
    return rows.select("query_id", "id", (F.col("doc_score") + above).alias("score"), F.row_number().over(w).alias("place_no"))


# ---------------------------------------------------------------- measures of structural answers


def hit_at_1(kind: Column, numeral: Column, want_kind: Column, want_numeral: Column) -> Column:
    return F.when((F.lower(kind) == F.lower(want_kind)) & same_numeral(numeral, want_numeral), 1.0).otherwise(0.0)


def article_coverage(found: Column, expected: Column) -> Column:
    """Share of the expected articles that were found; 1 where none is expected."""
    clean = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    want = clean(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, clean(found))) / F.size(want))


def citation_faithfulness(answer: Column, label: Column) -> Column:
    """1 if an answer with citations [n] names the unit, or a longer word of its label."""
    low, name = F.lower(answer), F.lower(F.trim(label))
    words = F.filter(F.split(name, r"\s+"), lambda w: F.length(w) > 3)
    return F.when(~answer.rlike(r"\[\d+\]"), 0.0).when(F.contains(low, name) | F.exists(words, lambda w: F.contains(low, w)), 1.0).otherwise(0.0)


def boundary_precision(answer: Column, others: Column) -> Column:
    """One less the share of other units' labels that the answer names."""
    low = F.lower(answer)
    named = F.size(F.filter(others, lambda x: F.contains(low, F.lower(F.trim(x)))))
    return F.when(F.size(others) <= 0, 1.0).otherwise(1.0 - named / F.size(others))
