"""Column expressions for text: all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they become. Single letters only; one table serves Spark and SQL.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
BARE = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

# Stop words of the tokenizer.
STOP_WORDS = (
    "a ao aos as ate com como da das de del dem des do dos e eh ela elas ele eles em entre era essa essas esse esses esta estas este estes eu foi for foram "
    "ha isso isto ja la lhe lhes lo los mais mas me meu meus minha minhas muito na nao nas nem no nos nossa nossas nosso nossos num numa o os ou para pela "
    "pelas pelo pelos por qual quais quando que quem sao se sem ser sera seu seus sim so sob sobre sua suas tal tambem te tem ter toda todas todo todos tu "
    "tua tuas tudo um uma umas uns vai vao voce voces"
).split()

# Patterns of personal data, applied in this order.
PII = (
    (r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}", "[CPF]"),
    (r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}", "[CNPJ]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}", "[TELEFONE]"),
)

# Texts that try to steer a model; for accent-stripped lower case.
INJECTION = (
    r"ignor[ea]\s+(as\s+)?instrucoes", r"ignore\s+(previous|above|all)\s+(instructions|prompts|rules)", r"disregard\s+(previous|above|all)",
    r"forget\s+(your|all|previous)\s+(instructions|rules|prompts)", r"you\s+are\s+now\s+a", r"agora\s+voce\s+e\s+um", r"novo\s+papel|new\s+role|act\s+as",
    r"system\s*:\s*", r"<\s*/?\s*system\s*>", r"\[inst\]|\[/inst\]|<\|im_start\|>", r"repita\s+o\s+prompt|repeat\s+the\s+(system\s+)?prompt",
    r"mostre\s+(seu|o)\s+prompt|show\s+(your|the)\s+prompt", r"qual\s+e\s+o\s+seu\s+prompt",
)
REMOVED = "[conteúdo removido]"
CONTEXT_MARKS = (
    r"(?i)ignor[ea]\s+(as\s+)?instru[çc][õo]es[^.]*", r"(?i)ignore\s+(previous|above|all)\s+instructions[^.]*", r"(?i)system\s*:\s*[^\n]*",
    r"(?is)<\s*system\s*>.*?<\s*/\s*system\s*>", r"(?is)\[INST\].*?\[/INST\]",
)
PAGE_MARKS = (
    r"^[^\n]{0,200}(?:Nº/Rev\.:|N°/Rev\.:)[^\n]*Este documento faz parte[^\n]*\n?", r"\(Baixado por [^\n)]+\)\s*", r"P[áa]gina\s+\d+\s+de\s+\d+\s*", r"Classifica[çc][ãa]o da Informa[çc][ãa]o:\s*\w+\s*", r"<!--\s*image\s*-->\s*",
)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, BARE)


def identifier(c: Column) -> Column:
    """Accents off, other characters to '_', lower case, 'c_' before a digit, 'coluna' for nothing."""
    s = F.lower(F.regexp_replace(F.regexp_replace(strip_accents(c), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", "coluna").when(s.rlike("^[0-9]"), F.concat(F.lit("c_"), s)).otherwise(s)


def norm_text(c: Column) -> Column:
    """Lower case words of plain letters and digits, single blanks."""
    return F.lower(F.trim(F.regexp_replace(strip_accents(c), "[^a-zA-Z0-9]+", " ")))


def norm_match(c: Column) -> Column:
    return F.lower(strip_accents(c))


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def words(c: Column) -> Column:
    """Words of plain letters and digits, in order."""
    return F.filter(F.split(norm_text(c), " "), lambda w: w != "")


def tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Words without stop words and single characters, in order."""
    words = F.split(norm_text(c), " ")
    off = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)])
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(off, w))


def keywords(c: Column) -> Column:
    """Distinct words of at least three letters, numbers and Roman numerals, in order."""
    words = F.split(norm_text(c), " ")
    off = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\d+$|^[ivxlcdm]{1,8}$") | ((F.length(w) >= 3) & ~F.array_contains(off, w))))


ABBREVIATIONS = r"(?i)(?<![\p{L}\p{N}_])(Art|Inc|Sr|Sra|Dr|Dra|Prof|Ltda|S\.A|Jr|n|p|fl|fls|vol|ed|etc|ex)\."


def sentences(c: Column) -> Column:
    """Split after . ! ? ; and blanks; a full stop after an abbreviation does not end a sentence."""
    safe = F.regexp_replace(c, ABBREVIATIONS, "$1\u0001")
    parts = F.split(safe, r"(?<=[.!?;])[ \t\r\n]+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def strip_page_marks(c: Column) -> Column:
    for p in PAGE_MARKS:
        c = F.regexp_replace(c, f"(?im){p}", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def merge_lines(c: Column) -> Column:
    """Words cut by a hyphen and lines that go on in lower case are joined."""
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-[ \t\r\n]*\n[ \t\r\n]*([\p{L}\p{N}_])", "$1$2")
    return F.regexp_replace(c, r"(?<=[a-zA-ZÀ-ÿ,;])[ \t\r]*\n[ \t\r\n]*(?=[a-zA-ZÀ-ÿ])", " ")


def drop_number_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(r"^\s*\d{1,4}\s*$")), "\n")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for all its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unique_blocks(c: Column, sep: str = "\n\n", least: int = 40) -> Column:
    """Blocks of at least ``least`` characters only at their first place; case and blanks do not matter."""
    # Sorted by key, a block repeats if it has the key of the one before; sorted by place, what is left is the text.
    keyed = F.array_sort(F.transform(F.split(c, sep), lambda b, i: F.struct(F.when(F.length(F.trim(b)) >= least, F.lower(compact(b))).alias("k"), i.alias("i"), b.alias("b"))))

    def kept(s: Column) -> Column:
        again = lambda x, j: x["k"].isNotNull() & (j > 0) & F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
        marked = F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), x["b"].alias("b"), again(x, j).alias("again")))
        return F.transform(F.array_sort(F.filter(marked, lambda x: ~x["again"])), lambda x: x["b"])

    return F.array_join(let(keyed, kept), sep)


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t\r\f]+", " "))


def deep_clean(c: Column) -> Column:
    return let(merge_lines(c), lambda m: tidy(unique_blocks(drop_number_lines(m))))


def strip_headings(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^#{1,6}[ \t]+", "")


def unwrap_headings(c: Column) -> Column:
    """[CAPÍTULO I] on a line of its own loses its brackets."""
    def line(x: Column) -> Column:
        s = F.trim(x)
        return F.when(s.rlike(r"^[\[(].*[\])]$") & F.upper(s).rlike("CAP|TIT|SE"), F.trim(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def mask_pii(c: Column) -> Column:
    for pattern, label in PII:
        c = F.regexp_replace(c, pattern, F.lit(label))
    return c


def has_injection(c: Column) -> Column:
    return norm_match(c).rlike("|".join(f"(?:{p})" for p in INJECTION))


def sanitize_context(c: Column) -> Column:
    for p in CONTEXT_MARKS:
        c = F.regexp_replace(c, p, F.lit(REMOVED))
    return c


def excerpt(c: Column, n: int = 240) -> Column:
    s = compact(c)
    return F.when(F.length(s) > n, F.concat(F.trim(F.left(s, F.lit(n))), F.lit("..."))).otherwise(s)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / F.lit(3.5)).cast("int")


def article_refs(c: Column, own: Column | None = None) -> Column:
    """Sorted distinct 'Art. n' of a text, without its own number."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"art(?:igo)?\.?\s*(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("Art. "), n)))
    return F.array_sort(found if own is None else F.array_remove(found, F.coalesce(own, F.lit(""))))


STRUCTURES = ("titulo", "capitulo", "secao", "subsecao", "artigo")


def structural_refs(c: Column) -> Column:
    """Distinct 'kind number' references of a text, in order of kind and place."""
    n = norm_match(c)
    named = lambda k: lambda v: F.concat(F.lit(f"{k} "), v)
    found = [F.transform(F.regexp_extract_all(n, F.lit(rf"\b{k}\s+([ivxlcdm]+|\d{{1,4}})\b"), F.lit(1)), named(k)) for k in STRUCTURES]
    return F.array_distinct(F.concat(*found))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(norm_match(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_of(c: Column) -> Column:
    """A short name: letters, digits and single '_' in lower case, accents kept out."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))


def map_first(fields: Column, *names: str) -> Column:
    """First non-empty of several keys of a map."""
    return F.coalesce(*[F.when(F.trim(F.try_element_at(fields, F.lit(k))) != "", F.trim(F.try_element_at(fields, F.lit(k)))) for k in names])
