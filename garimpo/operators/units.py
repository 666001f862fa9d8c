"""Quantities recorded in different units, brought to one: minutes and the kind of day.

1. Amounts and the spelling of their unit are read from the text; ages, sessions, codes, norms, item numbers
   and years are taken out first.
2. The distinct spellings (of text and unit column) are mapped once: an inverted index of character n-grams
   proposes known aliases, a weighted edit distance verifies them. The result is an alias dictionary.
3. The dictionary is joined to all rows, which then choose: text over columns, the missing half from the
   columns.

Defined cases: null or blank text leaves the columns; an amount without any unit, or a unit without any
amount, gives no row; immediate is 0 and corridos; a range counts as its upper end; "2 dias e 6 horas" is
added up; re-delivered rows count once; null ids and empty tables give no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions.ptbr import DIGITS, WORDS, number, plain
from garimpo.session import settle

# Minutes and kind of day of each unit, and its known spellings.
UNITS = {
    "minuto": (1, "corridos", ("min", "mins", "minuto", "minutos")),
    "hora": (60, "corridos", ("h", "hs", "hr", "hrs", "hora", "horas", "horas corridas", "hora corrida")),
    "dia": (1440, "corridos", ("d", "dd", "dia", "dias", "dia corrido", "dias corridos", "dias calendario", "dia calendario", "d.c", "dc", "x24h", "x24hs", "x24 horas")),
    "dia_util": (1440, "uteis", ("du", "d.u", "d. uteis", "dia util", "dias uteis")),
    "semana": (7 * 1440, "corridos", ("sem", "semana", "semanas")),
    "quinzena": (15 * 1440, "corridos", ("quinzena", "quinzenas")),
    "mes": (30 * 1440, "corridos", ("mes", "meses")),
    "trimestre": (90 * 1440, "corridos", ("trim", "trimestre", "trimestres")),
    "semestre": (180 * 1440, "corridos", ("semestre", "semestres")),
    "ano": (365 * 1440, "corridos", ("ano", "anos")),
    "imediato": (0, "corridos", ("imediato", "imediata", "imediatamente")),
}
DICTIONARY_ROWS = 50_000  # broadcast up to here, salted join beyond

NUM = rf"(?:{DIGITS}|\b(?:{WORDS}|meio|meia)\b)"
_NOISE = re.compile(
    "|".join([
        r"\b(?:ite(?:m|ns)|clausulas?|codigos?|cod\.?|normas?|guias?|lei|resolucao|portaria|art(?:igo)?s?\.?|anexos?|tabelas?|processos?|protocolos?|versao|rn|cid|paragrafo|inciso|capitulo)\s*(?:n\s?[o.]*\s*)?\d+(?:[./-]\d+)*(?:\s*/\s*\d+)?",
        r"\bn\s?o?\.?\s?\d{3,}\b",
        rf"\b(?:maior(?:es)?|menor(?:es)?|idade|acima|abaixo|a partir|pacientes?|criancas?|idosos?)\s*:?\s*(?:de|ate|com|entre|a)?\s*(?:de\s+)?{NUM}(?:\s*(?:a|e|-)\s*{NUM})?\s*(?:anos?|meses|dias)(?:\s+de\s+idade)?(?:\s+ou\s+mais)?",
        rf"{NUM}\s*(?:anos?|meses)\s+de\s+idade",
        rf"{NUM}\s*(?:\(\s*{WORDS}\s*\))?\s*(?:sess(?:oes|ao)|consultas?|vezes|vez|anexos?|vias?|copias?|diarias?|procedimentos?|ite(?:m|ns)|guias?|exames?|documentos?)\b(?:\s+(?:por|ao|a cada|no)\s+[a-z]+(?:\s+civil)?)?",
        r"\b(?:revisad[oa]|revisao|vigente|vigencia|desde|publicad[oa]|atualizad[oa])\s*(?:em|de|desde)?\s*(?:19|20)\d\d\b",
        r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
        r"\bpor (?:ano|mes|semana|dia)(?: civil)?\b",
    ])
)
_WORD = r"[a-z]+(?:\.[a-z]+)*"
_QUANTITY = re.compile(
    rf"(?P<a>{NUM})\s*(?:\(\s*(?:{WORDS}|\d+)\s*\)\s*)?(?:(?:a|e|ate|ou|-|–|/)\s*(?P<b>{NUM})\s*(?:\(\s*{WORDS}\s*\)\s*)?)?(?P<x>x\s*24\s*h[a-z]*)?(?:[\s_]*(?P<w1>{_WORD})(?:\.?[\s_]+(?:de\s+)?(?P<w2>{_WORD}))?)?(?P<half>[\s.]+e\s+mei[oa]\b)?"
)
_HALF_AFTER = re.compile(rf"^{_WORD}\.?\s+e\s+mei[oa]\b")
_UNIT_ONLY = re.compile(rf"\bem\s+(?P<w1>{_WORD})(?:[\s_]+(?:de\s+)?(?P<w2>{_WORD}))?")
_STOP = {"a", "e", "ou", "de", "da", "do", "ate", "em", "o", "os", "as", "com", "contar", "conforme", "por", "para", "no", "na", "autorizacao", "necessita", "limite", "vale", "mediante", "apos", "antes"}

PARSED = T.ArrayType(T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("two", T.StringType()), T.StructField("one", T.StringType()), T.StructField("plus", T.BooleanType())]))


def _spelling(*words: str | None) -> str | None:
    return " ".join(words) if all(words) else None


def read_text(text: str | None) -> list[tuple]:
    """Candidates in order: (amount or None, spelling of two words, of one word, adds to the one before)."""
    if not text:
        return []
    t = _NOISE.sub(" ; ", plain(text))
    found, at, before = [], 0, None
    while m := _QUANTITY.search(t, at):
        value = number(m["b"] or m["a"])
        low = number(m["a"])
        w1, w2 = m["w1"], m["w2"]
        end = m.end()
        if m["b"] and low is not None and value is not None and re.match(r"\s*e\b", t[m.end("a") :]) and not re.search(r"\bentre\s*$", t[: m.start()]) and low < 1 <= value:
            value = low
        if m["x"]:
            one, two = "x24h", None
            end = m.end("x")
        else:
            one = w1 if w1 and w1 not in _STOP else None
            two = _spelling(one, w2 if w2 and w2 not in _STOP else None)
            if one and (two is None or w2 in ("e",)):
                end = m.end("w1")
        if one and value is not None and _HALF_AFTER.match(t[m.start("w1") :] if m["w1"] else ""):
            value += 0.5
        if value is not None:
            plus = bool(found) and before is not None and re.fullmatch(r"[\s.]*(?:uteis|util|corridos?|de calendario)?[\s.]*e\s*", t[before : m.start()]) is not None
            found.append((float(value), two, one, plus))
            before = m.end("w2") if two and w2 and re.match(r"util|uteis|corrid", w2) else (m.end("w1") if m["w1"] else m.end())
            end = before
        at = max(end, m.end("a"), m.start() + 1)
    if not found:
        if re.search(r"\bimediat[oa](?:mente)?\b", t) and not re.search(r"\bnao (?:e )?imediat", t):
            return [(0.0, None, "imediato", False)]
        for m in _UNIT_ONLY.finditer(t):
            found.append((None, _spelling(m["w1"], m["w2"]), m["w1"], False))
    return found


@F.pandas_udf(PARSED)
def read_udf(texts: pd.Series) -> pd.Series:
    names = ("amount", "two", "one", "plus")
    return pd.Series([[dict(zip(names, c)) for c in read_text(t)] for t in texts])


@F.pandas_udf(T.StringType())
def spelling_udf(units: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else re.sub(r"[\s_]+", " ", plain(u)).strip(" .") or None for u in units])


def distance(a: str, b: str) -> float:
    """Edit distance; doubled letters, swapped neighbours and vowels for vowels cost less."""
    prev2, prev = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [prev[0] + 1.0]
        for j, y in enumerate(b, 1):
            drop = 0.4 if i > 1 and a[i - 2] == x else 1.0
            add = 0.4 if j > 1 and b[j - 2] == y else 1.0
            swap = 0.0 if x == y else 0.6 if x in "aeiou" and y in "aeiou" else 1.0
            best = min(prev[j] + drop, row[j - 1] + add, prev[j - 1] + swap)
            if prev2 is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, prev2[j - 2] + 0.7)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


@F.pandas_udf(T.DoubleType())
def distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b)])


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of the padded text."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def alias_dictionary(spellings: DataFrame, share: float = 0.25) -> DataFrame:
    """spelling, unit, minutes, basis of each distinct spelling that is or resembles a known alias.

    Aliases of up to three letters must match exactly; longer ones within ``share`` of their length.
    """
    spark = spellings.sparkSession
    known = spark.createDataFrame([(a, u, float(m), b) for u, (m, b, names) in UNITS.items() for a in names], "alias string, unit string, minutes double, basis string")
    distinct = spellings.select("spelling").filter("spelling is not null").distinct()
    left = distinct.withColumn("g", F.explode(ngrams(F.col("spelling"))))
    right = known.withColumn("g", F.explode(ngrams(F.col("alias"))))
    hits = left.join(F.broadcast(right), "g").groupBy("spelling", "alias", "unit", "minutes", "basis").agg(F.count("*").alias("shared"))
    likely = hits.filter((F.col("spelling") == F.col("alias")) | ((F.length("alias") > 3) & (F.col("shared") * 2 >= F.greatest(F.length("alias") - 2, F.lit(2)))))
    near = likely.withColumn("far", distance_udf("spelling", "alias")).filter((F.col("far") == 0) | ((F.length("alias") > 3) & (F.col("far") <= share * F.length("alias"))))
    return near.groupBy("spelling").agg(F.min_by(F.struct("unit", "minutes", "basis"), F.struct("far", "alias")).alias("u")).select("spelling", "u.*")


def with_dictionary(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Left join on a spelling that many rows share: broadcast while the dictionary is small, else salted."""
    words = words.withColumnRenamed("spelling", key)
    if words.count() <= DICTIONARY_ROWS:
        return rows.join(F.broadcast(words), key, "left")
    salts = 32
    salted = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")


def to_minutes(df: DataFrame, key: str = "deadline_id", text: str = "raw_text", amount: str = "days", unit: str = "unit") -> DataFrame:
    """key, basis, minutes of each row with a determined amount."""
    rows = df.select(F.col(key).alias("row_id"), F.col(text).alias("text"), F.col(amount).cast("double").alias("amount"), spelling_udf(F.col(unit)).alias("column_unit")).filter(F.col("row_id").isNotNull()).dropDuplicates(["row_id"])
    parsed = settle(rows.withColumn("c", read_udf("text")).drop("text"))
    spelled = parsed.select(F.explode(F.concat(F.array("column_unit"), F.flatten(F.transform(F.coalesce("c", F.array()), lambda x: F.array(x["two"], x["one"]))))).alias("spelling"))
    words = settle(alias_dictionary(spelled))

    each = parsed.select("row_id", "amount", "column_unit", F.posexplode_outer("c").alias("i", "x"))
    each = each.select("row_id", "amount", "column_unit", "i", F.col("x.amount").alias("a"), F.col("x.two").alias("two"), F.col("x.one").alias("one"), F.col("x.plus").alias("plus"))
    for name in ("two", "one", "column_unit"):
        packed = words.select("spelling", F.struct("unit", "minutes", "basis").alias(f"{name}_u"))
        each = with_dictionary(each, packed, name)
    each = each.withColumn("u", F.coalesce("two_u", "one_u"))
    # One row for each key again; a candidate is at most a few words of one text.
    grouped = each.groupBy("row_id").agg(
        F.first("amount").alias("amount"), F.first("column_unit_u").alias("cu"),
        F.sort_array(F.collect_list(F.struct("i", "a", "u", "plus", "one"))).alias("c"),
    )
    full = F.filter("c", lambda x: x["a"].isNotNull() & x["u"].isNotNull())
    start = F.get(full, F.lit(0))["i"]
    added = F.filter(full, lambda x: (x["i"] > start) & x["plus"])
    chain = F.filter(added, lambda x: x["i"] - start == F.size(F.filter(added, lambda y: y["i"] <= x["i"])))
    text_minutes = F.get(full, F.lit(0))["a"] * F.get(full, F.lit(0))["u"]["minutes"] + F.aggregate(chain, F.lit(0.0), lambda a, x: a + x["a"] * x["u"]["minutes"])
    text_basis = F.get(full, F.lit(0))["u"]["basis"]
    bare = F.get(F.filter("c", lambda x: x["a"].isNotNull() & x["one"].isNull()), F.lit(0))["a"]
    only = F.get(F.filter("c", lambda x: x["a"].isNull() & x["u"].isNotNull()), F.lit(0))["u"]
    cu = F.col("cu")
    instant = cu["unit"] == "imediato"
    minutes = (
        F.when(F.size(full) > 0, text_minutes)
        .when(bare.isNotNull() & cu.isNotNull() & ~instant, bare * cu["minutes"])
        .when(bare.isNull() & only.isNotNull(), F.col("amount") * only["minutes"])
        .when(bare.isNull() & instant, F.lit(0.0))
        .when(bare.isNull(), F.col("amount") * cu["minutes"])
    )
    basis = F.when(F.size(full) > 0, text_basis).when(bare.isNull() & only.isNotNull(), only["basis"]).otherwise(cu["basis"])
    return grouped.select(F.col("row_id").alias(key), basis.alias("basis"), F.round(minutes).cast("long").alias("minutes")).filter("minutes is not null and basis is not null")
