"""Column expressions for numbers, numerals, deadlines, hashes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garimpo.functions.text import norm_match


def ptbr_double(c: Column) -> Column:
    """1.234,56 and 1234,56 and 1234.56; text that is no number gives null."""
    s = F.trim(c)
    dots = F.replace(s, F.lit("."), F.lit(""))
    return (
        F.when(s.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(dots, F.lit(","), F.lit(".")).try_cast("double"))
        .when(s.rlike(r"^-?\d+,\d+$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double"))
        .otherwise(s.try_cast("double"))
    )


def ptbr_text(c: Column, unit: str = "") -> Column:
    """1.234,56 with the unit's dress: brl, anos, pontos, percent, count."""
    if unit == "count":
        return F.round(c).cast("long").cast("string")
    s = F.translate(F.format_number(c.cast("decimal(38,2)"), 2), ",.", ".,")
    dress = {"brl": F.concat(F.lit("R$ "), s), "anos": F.concat(s, F.lit(" anos")), "pontos": F.concat(s, F.lit(" pontos")), "percent": F.concat(s, F.lit("%"))}
    return dress.get(unit, s)


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_to_int(c: Column) -> Column:
    """Subtractive value of a Roman numeral, 0 for anything else."""
    s = F.lower(c)
    value = F.create_map(*[F.lit(x) for k, v in ROMAN.items() for x in (k, v)])
    digits = F.transform(F.reverse(F.filter(F.split(s, ""), lambda x: x != "")), lambda x: F.element_at(value, x))
    step = lambda a, v: F.struct(F.when(v < a["prev"], a["total"] - v).otherwise(a["total"] + v).alias("total"), v.alias("prev"))
    total = F.aggregate(digits, F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev")), step, lambda a: a["total"])
    return F.when(s.rlike("^[ivxlcdm]+$"), total).otherwise(F.lit(0))


def int_to_roman(c: Column) -> Column:
    """1 to 3999 as a Roman numeral, other numbers as digits."""
    places = [["", *(s for s in row.split())] for row in ("I II III IV V VI VII VIII IX", "X XX XXX XL L LX LXX LXXX XC", "C CC CCC CD D DC DCC DCCC CM", "M MM MMM")]
    parts = [F.get(F.array(*[F.lit(x) for x in row]), (F.floor(c / 10**k) % 10).cast("int")) for k, row in enumerate(places)]
    return F.when((c >= 1) & (c <= 3999), F.concat(*reversed(parts))).otherwise(c.cast("string"))


# Number words of deadlines.
WORDS = {"um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10}


def deadline(c: Column) -> Column:
    """days, unit, urgency, faixa, requires_authorization of a deadline text."""
    n = F.trim(F.regexp_replace(norm_match(F.coalesce(c, F.lit(""))), r"\s+", " "))
    digits = r"ate\s+(\d{1,3})\s*(?:\([^)]+\))?\s*(dias uteis|dias|horas)"
    word = r"ate\s+\(?([a-z]+)\)?\s*(dias uteis|dias|horas)"
    now = n.contains("imediato")
    named = F.try_element_at(F.create_map(*[F.lit(x) for k, v in WORDS.items() for x in (k, v)]), F.regexp_extract(n, word, 1))
    has = F.regexp_extract(n, digits, 1) != ""
    days = F.when(now, F.lit(0)).when(has, F.regexp_extract(n, digits, 1).try_cast("int")).otherwise(named)
    unit = F.when(now, "imediato").when(has, F.replace(F.regexp_extract(n, digits, 2), F.lit(" "), F.lit("_"))).when(named.isNotNull(), F.replace(F.regexp_extract(n, word, 2), F.lit(" "), F.lit("_"))).otherwise("texto")
    none, refused = n.contains("sem cobertura"), n.contains("nao autoriza")
    urgency = F.when(none, "sem_cobertura").when(refused, "nao_autoriza").when(now, "imediato").when(days.isNull(), "desconhecido").when(days <= 5, "curto").when(days <= 10, "medio").otherwise("longo")
    band = F.when(none, "Sem Cobertura").when(refused, "Nao autoriza").when(now, "Imediato").when(days.isNull(), "Desconhecido").when(days <= 3, "Ate 3 dias").when(days <= 5, "Ate 5 dias").when(days <= 10, "Ate 10 dias").otherwise("Acima de 10 dias")
    needs = (n.contains("necessita autoriz") | n.contains("autorizacao obrigatoria")) & ~none & ~refused
    return F.struct(days.alias("days"), unit.alias("unit"), urgency.alias("urgency"), band.alias("faixa"), needs.alias("requires_authorization"))


def chunk_id(collection: Column, doc: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", collection, doc.cast("string"), index.cast("string")), 256)


def node_id(doc: Column, kind: Column, label: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("::", doc.cast("string"), kind, label), 256), F.lit(16))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
