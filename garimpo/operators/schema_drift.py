"""Files of one table whose columns drift: every change told, all files read into one table.

Each file gets a schema fingerprint (normalised names with the narrowest type of each column). A file is
compared with the one of the preceding month of its series; the differences are its migration steps (rename,
add, remove, cast). Steps are chained by following every column back to the file where it first appeared, in
a number of joins that is logarithmic in the length of a series, so that no series is gathered in one task.
Over the series of a family, the names under which columns first appear are put together by the renames of all
series (never two that stand in one file), and each group takes its most frequent name. What results is a
table of versions: fingerprint, rename rules, cast rules (the narrowest type that fits all files of the family)
and defaults for missing columns. Files are routed through the rules of their version into one table a family.

Defined cases: re-delivered files (same extraction id) count once; files without series or month are left
out; two files of one month are both compared with the month before; a file without records has no types and
shares no values, so its new names count as added; null, '', '-' and 'n/d' are no values; an empty table
gives no rows; extra columns of the input do not matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.session import settle

# Fixed values.
MISSING = {"", "-", "n/d"}
TRUE, FALSE = {"sim", "s", "true"}, {"nao", "n", "false"}
TYPE_SHARE, RENAME_SHARE, LEAST_SHARED = 0.9, 0.85, 3

INTEGER = re.compile(r"[+-]?(?:\d+|\d{1,3}(?:\.\d{3})+)")
DECIMAL = re.compile(r"[+-]?(?:\d+|\d{1,3}(?:\.\d{3})+|\d{1,3}(?:,\d{3})+)(?:[.,]\d+)?")
DATE = re.compile(r"(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})|(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}))(?:[ T]\d{2}:\d{2}(?::\d{2})?)?")


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def column_name(name: str) -> str:
    """Accents dropped, other characters to a single '_', trimmed, lower case."""
    return re.sub(r"[^0-9A-Za-z]+", "_", _bare(name)).strip("_").lower()


def _date(v: str) -> str | None:
    if not (m := DATE.fullmatch(v)):
        return None
    y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[6], m[5], m[4])
    return f"{int(y):04}-{int(mo):02}-{int(d):02}" if 1 <= int(mo) <= 12 and 1 <= int(d) <= 31 else None


def _number(v: str) -> float:
    """Both styles: the last of '.' and ',' is the decimal sign unless it only groups thousands."""
    s = v.replace("R$", "").strip()
    if "," in s and "." in s:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    elif "," in s:
        s = s.replace(",", ".")
    elif re.fullmatch(r"[+-]?\d{1,3}(\.\d{3})+", s):
        s = s.replace(".", "")
    return float(s)


def value(v: str | None) -> str | None:
    """The cell without its dress; None if it is no value."""
    if v is None or (v := v.strip()).lower() in MISSING:
        return None
    return v


def canonical(v: str | None) -> str | None:
    """Numbers, dates and truth values in one form each, so that formats do not tell values apart."""
    if (v := value(v)) is None:
        return None
    if d := _date(v):
        return d
    if DECIMAL.fullmatch(v):
        n = _number(v)
        return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)
    low = _bare(v).lower()
    return "true" if low in TRUE else "false" if low in FALSE else v


def narrowest(values: list[str]) -> str | None:
    """The narrowest type that fits nine tenths of the values; None without values."""
    if not values:
        return None
    need = TYPE_SHARE * len(values) - 1e-9
    tests = (
        ("integer", lambda v: INTEGER.fullmatch(v) is not None), ("decimal", lambda v: DECIMAL.fullmatch(v) is not None),
        ("date", lambda v: _date(v) is not None), ("boolean", lambda v: _bare(v).lower() in TRUE | FALSE),
    )
    return next((name for name, fits in tests if sum(map(fits, values)) >= need), "text")


class File:
    """Columns of one file: raw and canonical cells by normalised name, in record order."""

    def __init__(self, names, records):
        self.raw: dict[str, list] = {}
        keys = list(names if names is not None else [])
        for r in records if records is not None else []:
            keys += [k for k in dict(r) if k not in keys] if r is not None else []
        self.n = 0 if records is None else len(records)
        for key in keys:
            if key is None or not (name := column_name(key)):
                continue
            cells = [value(dict(r).get(key)) if r is not None else None for r in (records if records is not None else [])]
            if name in self.raw:  # the same name twice: the first value counts
                cells = [a if a is not None else b for a, b in zip(self.raw[name], cells)]
            self.raw[name] = cells
        self.cells = {k: [canonical(v) for v in c] for k, c in self.raw.items()}
        self.types = {k: narrowest([v for v in c if v is not None]) for k, c in self.raw.items()}


def _links(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of records whose value occurs once in either column."""
    ca, cb = Counter(a), Counter(b)
    at = {v: i for i, v in enumerate(b) if v is not None and cb[v] == 1}
    return [(i, at[v]) for i, v in enumerate(a) if v is not None and ca[v] == 1 and v in at]


def changes(old: File, new: File) -> list[tuple[str, str, str]]:
    """(change_kind, old_name, new_name), sorted."""
    common = [c for c in old.cells if c in new.cells]
    removed = [c for c in old.cells if c not in new.cells]
    added = [c for c in new.cells if c not in old.cells]
    pairs: list[tuple[int, int]] = []
    if removed and added:
        candidates = [(c, c) for c in common] + [(a, b) for a in removed for b in added]
        best = [_links(old.cells[a], new.cells[b]) for a, b in candidates]
        # Columns that stay are asked first; a renamed key serves where it links more records.
        pairs = max(best, key=len, default=[])
    scored = []
    for a in removed:
        for b in added:
            both = [(old.cells[a][i], new.cells[b][j]) for i, j in pairs]
            both = [(x, y) for x, y in both if x is not None and y is not None]
            same = sum(x == y for x, y in both)
            if len(both) >= LEAST_SHARED and same >= RENAME_SHARE * len(both):
                scored.append((same / len(both), len(both), a, b))
    out, used = [], set()
    for _, _, a, b in sorted(scored, key=lambda s: (-s[0], -s[1], s[2], s[3])):
        if ("o", a) not in used and ("n", b) not in used:
            used |= {("o", a), ("n", b)}
            out.append(("renamed", a, b))
    out += [("removed", a, "") for a in removed if ("o", a) not in used]
    out += [("added", "", b) for b in added if ("n", b) not in used]
    out += [("type_changed", c, c) for c in common if old.types[c] and new.types[c] and old.types[c] != new.types[c]]
    return sorted(out)


STEP = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("change_kind", "old_name", "new_name")]))


def _files(df: DataFrame) -> DataFrame:
    keep = df.filter("extraction_id is not null and series_id is not null and reference_month is not null").dropDuplicates(["extraction_id"])
    return keep.select("extraction_id", "series_id", "family", "reference_month", F.col("column_names").alias("names"), F.transform("records", lambda r: r["fields"]).alias("fields"))


def _predecessors(df: DataFrame) -> DataFrame:
    """extraction_id, before: light rows only. Files of one month share the predecessor."""
    ids = df.filter("extraction_id is not null and series_id is not null and reference_month is not null").select("extraction_id", "series_id", "reference_month").distinct()
    months = ids.groupBy("series_id", "reference_month").agg(F.max("extraction_id").alias("last"))
    chain = months.withColumn("before", F.lag("last").over(Window.partitionBy("series_id").orderBy("reference_month")))
    return ids.join(chain.filter("before is not null"), ["series_id", "reference_month"]).select("extraction_id", "before")


def described(df: DataFrame) -> DataFrame:
    """extraction_id, before, steps, columns, types, fingerprint of each file; before is null for the first."""
    files = _files(df)
    cur = files.select("extraction_id", "series_id", "family", "reference_month", "names", "fields").join(_predecessors(df), "extraction_id", "left")
    prev = files.select(F.col("extraction_id").alias("before"), F.col("names").alias("names0"), F.col("fields").alias("fields0"))
    both = cur.join(prev, "before", "left")
    schema = T.StructType([
        T.StructField("extraction_id", T.LongType()), T.StructField("series_id", T.StringType()), T.StructField("family", T.StringType()), T.StructField("reference_month", T.StringType()),
        T.StructField("before", T.LongType()), T.StructField("steps", STEP),
        T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("types", T.ArrayType(T.StringType())),
    ])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                new = File(r.names, r.fields)
                has = r.before is not None and r.before == r.before
                steps = changes(File(r.names0, r.fields0), new) if has else []
                out.append((r.extraction_id, r.series_id, r.family, r.reference_month, int(r.before) if has else None, [dict(zip(("change_kind", "old_name", "new_name"), s)) for s in steps], list(new.types), [new.types[c] for c in new.types]))
            yield pd.DataFrame(out, columns=[f.name for f in schema]).astype({"before": "Int64"})

    told = both.select("extraction_id", "series_id", "family", "reference_month", F.col("before").cast("double").alias("before"), "names", "fields", "names0", "fields0").mapInPandas(compare, schema)
    named = F.array_sort(F.transform(F.arrays_zip("columns", "types"), lambda z: F.concat_ws(":", z["columns"], F.coalesce(z["types"], F.lit("?")))))
    return told.withColumn("fingerprint", F.sha2(F.concat_ws("|", named), 256))


def found_changes(df: DataFrame) -> DataFrame:
    """extraction_id, change_kind, old_name, new_name."""
    return described(df).select("extraction_id", F.explode("steps").alias("s")).select("extraction_id", "s.*")


def versions(df: DataFrame) -> DataFrame:
    """Schema history: a version begins wherever the fingerprint of a series changes."""
    files = described(df).select("family", "series_id", "reference_month", "extraction_id", "fingerprint", F.size("columns").alias("n_columns"), F.size("steps").alias("n_changes"))
    w = Window.partitionBy("series_id").orderBy("reference_month", "extraction_id")
    new = F.coalesce((F.lag("fingerprint").over(w) != F.col("fingerprint")).cast("int"), F.lit(1))
    return files.withColumn("new", new).withColumn("version", F.sum("new").over(w)).drop("new")


def lineage(files: DataFrame) -> DataFrame:
    """extraction_id, column, root: the name under which the column first appeared in its series.

    Pointer doubling: every round joins each column with the one it points to.
    """
    longest = files.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    cols = files.select("extraction_id", "before", "steps", F.explode("columns").alias("column"))
    renamed = F.filter("steps", lambda s: (s["change_kind"] == "renamed") & (s["new_name"] == F.col("column")))
    fresh = F.exists("steps", lambda s: (s["change_kind"] == "added") & (s["new_name"] == F.col("column")))
    origin = F.when(F.size(renamed) > 0, F.get(renamed, F.lit(0))["old_name"]).when(~fresh, F.col("column"))
    links = cols.select("extraction_id", "column", F.when(origin.isNotNull(), F.col("before")).alias("to_id"), F.when(F.col("before").isNotNull(), origin).alias("to_column"))
    links = settle(links.withColumn("to_column", F.when(F.col("to_id").isNotNull(), F.col("to_column"))))
    for _ in range(math.ceil(math.log2(max(2, longest)))):
        far = links.select(F.col("extraction_id").alias("to_id"), F.col("column").alias("to_column"), F.col("to_id").alias("far_id"), F.col("to_column").alias("far_column"))
        step = links.join(far, ["to_id", "to_column"], "left")
        links = settle(step.select("extraction_id", "column", F.coalesce("far_id", "to_id").alias("to_id"), F.coalesce("far_column", "to_column").alias("to_column")))
    return links.select("extraction_id", "column", F.coalesce("to_column", "column").alias("root"))


def canonical_names(files: DataFrame, roots: DataFrame) -> DataFrame:
    """family, root, canonical: one name for the columns of all series of a family.

    What is gathered for a family are its distinct names and pairs of names, not its files.
    """
    told = files.select("extraction_id", "family").join(roots, "extraction_id")
    own = told.groupBy("family", "root").agg(F.count("*").alias("n")).select("family", F.lit("name").alias("kind"), F.col("root").alias("a"), F.lit("").alias("b"), "n")
    also = told.filter("column <> root").groupBy("family", "root", "column").agg(F.count("*").alias("n")).select("family", F.lit("link").alias("kind"), F.col("root").alias("a"), F.col("column").alias("b"), "n")
    sets = told.groupBy("extraction_id", "family").agg(F.array_sort(F.collect_set("root")).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    apart = sets.select("family", F.explode(pairs).alias("p")).groupBy("family", "p.a", "p.b").agg(F.count("*").alias("n")).select("family", F.lit("apart").alias("kind"), "a", "b", "n")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        names = dict(pdf[pdf.kind == "name"][["a", "n"]].values)
        never = {frozenset(x) for x in pdf[pdf.kind == "apart"][["a", "b"]].values}
        groups = {x: {x} for x in names}
        for _, a, b in sorted((-n, a, b) for a, b, n in pdf[pdf.kind == "link"][["a", "b", "n"]].values):
            if b in groups and groups[a] is not groups[b] and not any(frozenset((x, y)) in never for x in groups[a] for y in groups[b]):
                groups[a] |= groups[b]
                for x in groups[a]:
                    groups[x] = groups[a]
        best = {x: min(g, key=lambda y: (-names[y], y)) for x, g in groups.items()}
        return pd.DataFrame({"family": pdf["family"].iloc[0], "root": list(best), "canonical": list(best.values())})

    return own.unionByName(also).unionByName(apart).groupBy("family").applyInPandas(group, "family string, root string, canonical string")


def family_type(types: set[str]) -> str:
    """The narrowest type that holds all of them."""
    return next(iter(types)) if len(types) == 1 else "decimal" if types and types <= {"integer", "decimal"} else "text"


@F.udf(T.StringType())
def family_type_udf(types):
    return family_type(set(types or []))


class Rules:
    """Versions of all families, settled: ``files`` (extraction_id, version_key) and ``table``.

    defaults: canonical name -> text for a column that a version lacks; null otherwise.
    """

    def __init__(self, df: DataFrame, defaults: dict[str, str] | None = None):
        described_files = settle(described(df))
        roots = lineage(described_files)
        names = canonical_names(described_files, roots)
        cells = described_files.select("extraction_id", "family", F.explode(F.arrays_zip("columns", "types")).alias("x")).select("extraction_id", "family", F.col("x.columns").alias("column"), F.col("x.types").alias("type"))
        placed = settle(cells.join(roots, ["extraction_id", "column"]).join(names, ["family", "root"]))
        kinds = placed.groupBy("family", "canonical").agg(F.collect_set("type").alias("t")).select("family", "canonical", family_type_udf("t").alias("type"))
        # A family's distinct columns, not its files.
        self.columns = settle(kinds)
        every = self.columns.groupBy("family").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("canonical", "type")))).alias("casts"))
        routes = placed.groupBy("extraction_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "canonical")))).alias("renames"))
        keyed = described_files.join(routes, "extraction_id", "left").withColumn("renames", F.coalesce("renames", F.expr("map()").cast("map<string,string>")))
        keyed = keyed.withColumn("version_key", F.sha2(F.concat_ws("|", F.coalesce("family", F.lit("")), "fingerprint", F.to_json("renames")), 256))
        self.files = settle(keyed.select("extraction_id", "family", "reference_month", "version_key", "fingerprint", "renames"))
        table = self.files.groupBy("family", "version_key").agg(F.min("reference_month").alias("first_month"), F.count("*").alias("files"), F.first("fingerprint").alias("fingerprint"), F.first("renames").alias("renames")).join(every, "family", "left")
        missing = F.filter(F.map_keys("casts"), lambda c: ~F.array_contains(F.map_values("renames"), c))
        given = F.create_map(*[F.lit(x) for kv in (defaults or {}).items() for x in kv]).cast("map<string,string>") if defaults else F.expr("map()").cast("map<string,string>")
        table = table.withColumn("defaults", F.map_from_arrays(missing, F.transform(missing, lambda c: F.element_at(given, c))))
        number = F.row_number().over(Window.partitionBy("family").orderBy("first_month", "version_key"))
        self.table = settle(table.withColumn("version", number))


def version_rules(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """The table of versions: family, version, first_month, files, fingerprint, renames, casts, defaults."""
    return Rules(df, defaults).table.select("family", "version", "first_month", "files", "fingerprint", "renames", "casts", "defaults")


def cast_value(v: str | None, kind: str) -> str | None:
    """The canonical form of a cell if it is of the type, else None."""
    c = canonical(v)
    if c is None or kind == "text":
        return c
    raw = value(v)
    fits = {"integer": INTEGER.fullmatch, "decimal": DECIMAL.fullmatch, "date": _date, "boolean": lambda x: _bare(x).lower() in TRUE | FALSE}[kind]
    return c if fits(raw) else None


def unified(df: DataFrame, defaults: dict[str, str] | None = None, rules: Rules | None = None) -> DataFrame:
    """One long table: family, series_id, reference_month, extraction_id, row_index, version, fields, misfits.

    fields: canonical names, with values in canonical form and of the family's type; columns that the file lacks
    have their default. misfits: values that are not of the type, so that none is lost.
    """
    rules = rules or Rules(df, defaults)
    routes = rules.files.select("extraction_id", "version_key").join(rules.table.select("version_key", "version", "renames", "casts", "defaults"), "version_key").drop("version_key")
    keep = df.filter("extraction_id is not null and series_id is not null and reference_month is not null").dropDuplicates(["extraction_id"])
    rows = keep.select("extraction_id", "series_id", "family", "reference_month", "records").join(routes, "extraction_id").withColumn("r", F.explode("records"))
    rows = rows.select("family", "series_id", "reference_month", "extraction_id", F.col("r.row_index").alias("row_index"), "version", F.col("r.fields").alias("fields"), "renames", "casts", "defaults")
    schema = T.StructType([*[f for f in rows.schema if f.name not in ("renames", "casts", "defaults")], T.StructField("misfits", T.MapType(T.StringType(), T.StringType()))])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, str] = {}
        for pdf in batches:
            out, odd = [], []
            for fields, renames, casts, missing in zip(pdf["fields"], pdf["renames"], pdf["casts"], pdf["defaults"]):
                made, left, renames, casts = {}, {}, dict(renames), dict(casts) if casts is not None else {}
                for k, v in dict(fields if fields is not None else {}).items():
                    if k not in names:
                        names[k] = column_name(k)
                    name = renames.get(names[k])
                    if not name or made.get(name) is not None:
                        continue
                    made[name] = cast_value(v, casts.get(name, "text"))
                    if made[name] is None and (c := canonical(v)) is not None:
                        left[name] = c
                for k, v in dict(missing if missing is not None else {}).items():
                    made.setdefault(k, v)
                out.append(made)
                odd.append(left)
            yield pdf.drop(columns=["renames", "casts", "defaults"]).assign(fields=out, row_index=pdf["row_index"].astype("Int32"), misfits=odd)

    return rows.mapInPandas(route, schema)


SPARK_TYPES = {"integer": "bigint", "decimal": "double", "date": "date", "boolean": "boolean", "text": "string"}


def family_table(df: DataFrame, family: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """All files of one family as one wide table with typed columns."""
    own = df.filter(F.col("family") == family)
    rules = Rules(own, defaults)
    # The family's distinct columns.
    columns = sorted((r["canonical"], SPARK_TYPES[r["type"]]) for r in rules.columns.collect())
    fixed = ("series_id", "reference_month", "extraction_id", "row_index", "version")
    named = [F.expr(f"try_cast(fields['{c}'] AS {t})").alias(c if c not in fixed else f"{c}_") for c, t in columns]
    return unified(own, rules=rules).select(*fixed, *named)
