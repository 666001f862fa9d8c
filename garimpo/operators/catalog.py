"""Catalogs of coded items: raw tables made regular, records, lookup, search and answers.

A raw table is rows of (source, row_no, cells array); a catalog is rows of (source, row_no, codigo, descricao,
fields map, searchable). Each source is handled by its own rows, over many sources at once.

Defined cases: null cells are blank; rows without code or description give no record; unknown filter keys match
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import text as X


@dataclass(frozen=True)
class Config:
    """What a catalog should look like."""

    columns: tuple[str, ...] = ("codigo", "descricao", "emergencia", "precisa_autorizacao")
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    code: str = "codigo"
    description: str = "descricao"
    searched: tuple[str, ...] = ("codigo", "descricao")
    filters: tuple[str, ...] = ("emergencia", "precisa_autorizacao")
    code_pattern: str = r"^\d{4,}$"
    start_after: str = ""
    stop_after: str = ""

    def known(self) -> dict[str, str]:
        """Every spelling of a column, as an identifier, with its canonical name."""
        from garimpo.functions.ptbr import plain

        key = lambda s: "_".join(w for w in "".join(c if c.isalnum() else " " for c in plain(s)).split())
        out = {key(c): c for c in self.columns}
        for c, names in self.aliases.items():
            out |= {key(c): c} | {key(n): c for n in names}
        return out


def normalised(raw: DataFrame, config: Config, header: DataFrame | None = None) -> DataFrame:
    """source, row_no, fields: cells under canonical names, every expected column present, blank rows dropped.

    raw: source, row_no, cells. header: source, names; where a source has none, its first filled row becomes the
    header if at least half of its cells (two or more) are known names, else its columns are numbers.
    """
    known = config.known()
    mapping = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    clean = raw.select("source", "row_no", F.transform("cells", lambda c: X.compact(F.coalesce(c, F.lit("")))).alias("cells")).filter(F.exists("cells", lambda c: c != ""))
    ident = lambda c: X.identifier(c)
    n_known = F.size(F.filter("cells", lambda c: F.try_element_at(mapping, ident(c)).isNotNull()))
    first = clean.groupBy("source").agg(F.min_by(F.struct("row_no", "cells", n_known.alias("n")), "row_no").alias("f"))
    promoted = (F.col("f.n") >= F.greatest(F.lit(2), F.floor(F.size("f.cells") / 2)))
    heads = first.select("source", F.when(promoted, F.col("f.cells")).alias("own"), F.when(promoted, F.col("f.row_no")).alias("head_row"))
    if header is not None:
        heads = heads.join(header.select("source", F.col("names").alias("given")), "source", "left").withColumn("head_row", F.when(F.col("given").isNull(), F.col("head_row"))).withColumn("own", F.coalesce("given", "own")).drop("given")
    rows = clean.join(heads, "source").filter(F.col("head_row").isNull() | (F.col("row_no") != F.col("head_row")))
    named = F.transform(F.coalesce("own", F.array().cast("array<string>")), lambda c: F.coalesce(F.try_element_at(mapping, ident(c)), ident(c)))
    pick = lambda name: F.coalesce(F.get("cells", F.nullif(F.array_position("names", name).cast("int"), F.lit(0)) - 1), F.lit(""))
    fields = F.map_from_arrays(F.array(*map(F.lit, config.columns)), F.array(*[pick(c) for c in config.columns]))
    return rows.withColumn("names", named).select("source", "row_no", fields.alias("fields")).filter(F.exists(F.map_values("fields"), lambda v: v != ""))


def records(fields: DataFrame, config: Config) -> DataFrame:
    """source, row_no, codigo, descricao, fields, searchable, excerpt of the rows with a code and a description."""
    get = lambda c: X.compact(F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")))
    parts = F.array(*[F.when(get(c) != "", F.concat(F.lit(f"{c} "), get(c))) for c in config.searched])
    text = F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ")
    rows = fields.select("source", "row_no", get(config.code).alias("codigo"), get(config.description).alias("descricao"), "fields", text.alias("searchable"))
    return rows.filter("codigo <> '' and descricao <> ''").withColumn("excerpt", F.left("searchable", F.lit(240)))


def unique(found: DataFrame) -> DataFrame:
    """Of each code the record with the longest searchable text, ties by the first."""
    rest = [c for c in found.columns if c != "codigo"]
    best = F.min_by(F.struct(*rest), F.struct(-F.length("searchable"), F.col("source"), F.col("row_no")))
    return found.groupBy("codigo").agg(best.alias("b")).select("codigo", *[F.col(f"b.{c}").alias(c) for c in rest])


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D+", "")


def lookup(found: DataFrame, code: str) -> DataFrame:
    return found.filter(digits(F.col("codigo")) == F.regexp_replace(F.lit(code), r"\D+", ""))


def filtered(found: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose fields equal all filters, in plain form."""
    for k, v in filters.items():
        found = found.filter(X.norm_text(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))) == X.norm_text(F.lit(v)))
    return found


def search(found: DataFrame, question: str, filters: dict[str, str] | None = None, limit: int = 5) -> DataFrame:
    """The best records by 3 for the whole question and 1 for each word that the plain searchable text holds."""
    rows = filtered(found, filters or {}).withColumn("_t", X.norm_text(F.col("searchable"))).filter("_t <> ''")
    q = X.norm_text(F.lit(question))
    hits = F.size(F.filter(X.words(F.lit(question)), lambda w: F.contains(F.col("_t"), w)))
    score = F.when((q != "") & F.contains("_t", q), 3.0).otherwise(0.0) + hits
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "codigo").limit(limit).drop("_t")


def asked_filters(question: str, config: Config) -> dict[str, str]:
    """Filters that a question implies."""
    from garimpo.functions.ptbr import plain

    q = plain(question)
    told = {"emergencia": "emergencia" in q, "precisa_autorizacao": "autoriz" in q}
    return {k: "sim" for k, yes in told.items() if yes and k in config.filters}


def ask(found: DataFrame, question: str, config: Config, filters: dict[str, str] | None = None, limit: int = 5) -> DataFrame:
    """Records of a question: by its code if it names one, else by search under its filters."""
    import re

    every = asked_filters(question, config) | (filters or {})
    code = re.search(r"\b\d{4,}\b", question or "")
    if code:
        return filtered(lookup(found, code[0]), every).withColumn("score", F.lit(None).cast("double")).orderBy("codigo").limit(limit)
    return search(found, question, every, limit)


NOTHING = "Não há no catálogo informação bastante para uma resposta segura."


def answer(rows: list, limit: int = 5) -> str:
    """A sentence from the few records found."""
    if not rows:
        return NOTHING
    if len(rows) == 1:
        r = rows[0]
        return f"Encontrado: {r['codigo']} - {r['descricao']}. Campos: {', '.join(f'{k}={v}' for k, v in r['fields'].items() if v)}."
    return f"Encontrados {len(rows)} registros. Exemplos: {'; '.join(f'{r['codigo']} - {r['descricao']}' for r in rows[:limit])}."


def code_match(text: Column, code: Column) -> Column:
    """100 if the text is the code, 80 if it begins with it, 50 if it holds it as a word, else 0."""
    t, q = X.compact(F.coalesce(text, F.lit(""))), F.concat(F.lit("\\Q"), code, F.lit("\\E"))
    test = lambda pattern: F.regexp_like(t, F.concat(*pattern))
    b = F.lit(r"\b")
    return F.when(t == "", 0).when(t == code, 100).when(test([F.lit("^"), q, F.lit(r"(?:\b|\s|[-/:|])")]), 80).when(test([b, q, b]), 50).otherwise(0)


def best_candidate(rows: DataFrame, by: list[str], text: str, code: str, description: str, place: str) -> DataFrame:
    """The row of each key with the best code match, then the longest description, then the earliest place."""
    scored = rows.withColumn("_s", code_match(F.col(text), F.col(code))).filter("_s > 0")
    rest = [c for c in rows.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct("_s", F.length(F.coalesce(description, F.lit(""))).alias("_l"), (-F.col(place)).alias("_p")))
    return scored.groupBy(*by).agg(best.alias("b")).select(*by, *[F.col(f"b.{c}").alias(c) for c in rest])


def trimmed_lines(lines: DataFrame, config: Config) -> DataFrame:
    """source, line_no, line between the markers and after the run of header lines.

    lines: source, line_no, line. The places of the markers are aggregates by source; nothing else is gathered.
    """
    n = X.norm_text(F.col("line"))
    marker = lambda m: F.contains(n, X.norm_text(F.lit(m)))
    rows = lines.withColumn("n", n)
    if config.start_after:
        start = rows.groupBy("source").agg(F.min(F.when(marker(config.start_after), F.col("line_no"))).alias("s"))
        rows = rows.join(start, "source").filter(F.col("s").isNull() | (F.col("line_no") > F.col("s"))).drop("s")
    if config.stop_after:
        stop = rows.groupBy("source").agg(F.min(F.when(marker(config.stop_after), F.col("line_no"))).alias("s"))
        rows = rows.join(stop, "source").filter(F.col("s").isNull() | (F.col("line_no") < F.col("s"))).drop("s")
    # The header names in their order, each after the one before.
    at = rows.select("source").distinct().withColumn("h", F.lit(-1).cast("long"))
    for c in config.columns:
        names = F.array(*[X.norm_text(F.lit(x)) for x in (c, *config.aliases.get(c, ()))])
        found = rows.filter(F.array_contains(names, F.col("n"))).join(at, "source").filter(F.col("line_no") > F.col("h")).groupBy("source").agg(F.min("line_no").alias("h2"))
        at = at.join(found, "source", "left").filter("h is not null").select("source", F.col("h2").cast("long").alias("h"))
    return rows.join(at, "source", "left").filter(F.col("h").isNull() | (F.col("line_no") > F.col("h"))).select("source", "line_no", "line")


def stitched_rows(lines: DataFrame, columns: int, code_pattern: str) -> DataFrame:
    """source, row_no, cells: lines from one code line to the next form a row; surplus middle lines join its second cell.

    Islands by a running count of code lines; a row is a few lines.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    isle = lines.withColumn("isle", F.sum(F.col("line").rlike(code_pattern).cast("int")).over(w))
    rows = isle.groupBy("source", "isle").agg(F.min("line_no").alias("row_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x")).withColumn("c", F.transform("x", lambda x: x["line"]))
    rows = rows.filter(F.size("c") >= columns)
    if columns < 3:
        return rows.select("source", "row_no", F.slice("c", 1, columns).alias("cells"))
    middle = F.size("c") - columns + 1
    folded = F.concat(F.slice("c", 1, 1), F.array(F.array_join(F.slice("c", F.lit(2), middle), " ")), F.slice("c", middle + 2, F.lit(columns)))
    return rows.select("source", "row_no", F.when(F.size("c") == columns, F.col("c")).otherwise(F.slice(folded, 1, columns)).alias("cells"))


def report(raw: DataFrame, made: DataFrame, kept: DataFrame) -> DataFrame:
    """source, rows, records, kept: what became of the rows of each source."""
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    out = count(raw, "rows").join(count(made, "records"), "source", "left").join(count(kept, "kept"), "source", "left")
    return out.fillna(0, ["records", "kept"])
