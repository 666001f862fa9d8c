"""Summaries of structural nodes: extractive by rule, or by an injected model over parts that are merged again.

A summary is a struct of executive, legal (texts), points, articles, duties, limits, definitions (lists), with a
status: generated, invalid (the model's answer had no content, so the rule's summary stands) or fallback_only.

Defined cases: null and blank texts give an empty summary; texts of any length are read whole, in parts of at
most ``size`` characters (a longer paragraph is one part by itself).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, LISTS = 12_000, ("points", "articles", "duties", "limits", "definitions")
SCHEMA = "executive string, legal string, points array<string>, articles array<string>, duties array<string>, limits array<string>, definitions array<string>"
MARK = "\n\n[... texto cortado ...]"


def truncated(c: Column, n: int = SIZE) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(MARK))).otherwise(c)


def parts(text: str | None, size: int = SIZE) -> list[str]:
    """Paragraphs packed greedily into parts."""
    clean = (text or "").strip()
    if len(clean) <= size:
        return [clean]
    out: list[list[str]] = [[]]
    n = 0
    for p in filter(None, map(str.strip, clean.split("\n\n"))):
        if out[-1] and n + len(p) + 2 > size:
            out.append([])
            n = 0
        # The first block of a later part counts without its separator.
        n = len(p) if not out[-1] and len(out) > 1 else n + len(p) + 2
        out[-1].append(p)
    return ["\n\n".join(p) for p in out if p]


def read_json(answer: str | None) -> dict:
    """The JSON object in a model's answer, fenced or surrounded by words; {} if there is none."""
    t = "\n".join(x for x in (answer or "").strip().split("\n") if not x.strip().startswith("```"))
    for found in (t, t[t.find("{") : t.rfind("}") + 1]):
        try:
            v = json.loads(found)
            return v if isinstance(v, dict) else {}
        except ValueError:
            continue
    return {}


def checked(data: dict) -> tuple[dict, list[str]]:
    """(the summary's fields with clean lists, what was wrong)."""
    wrong, out = [], {}
    for k in LISTS:
        v = data.get(k, [])
        if not isinstance(v, list):
            wrong.append(f"{k}: list expected")
            v = []
        out[k] = [str(x).strip() for x in v if str(x).strip()]
    for k in ("executive", "legal"):
        out[k] = str(data.get(k) or "").strip()
    if not (out["executive"] or out["legal"] or out["points"]):
        wrong.append("no content")
    return out, wrong


def merged(found: list[dict], most: int = 20) -> dict:
    """One summary of several: texts joined, list entries once each (case does not matter)."""
    out: dict = {k: " ".join(p[k] for p in found if p[k]) for k in ("executive", "legal")}
    for k in LISTS:
        seen = {v.lower(): v for p in reversed(found) for v in reversed(p[k])}
        order = dict.fromkeys(v.lower() for p in found for v in p[k])
        out[k] = [seen[v] for v in order][:most]
    return out


def extractive(text: str | None, articles=None) -> dict:
    """The first sentences, and up to twenty articles."""
    one = " ".join(filter(None, map(str.strip, (text or "").splitlines())))
    lead = [s for s in map(str.strip, re.split(r"(?<=[.;:])\s+", one)) if s][:5]
    executive = " ".join(lead[:2]) or one[:320].strip()
    arts = [a if str(a).startswith("Art.") else f"Art. {a}" for a in (list(articles) if articles is not None else [])[:20]]
    return {"executive": executive, "legal": " ".join(lead[:4]) or executive, "points": [s[:220] for s in lead], "articles": arts, "duties": [], "limits": [], "definitions": []}


def summarise(nodes: DataFrame, key: str = "node_key", model: Callable[[str, str, str], str] | None = None, least: int = 0, size: int = SIZE) -> DataFrame:
    """key, status, parts and the summary of each node. nodes: key, label, path, articles, text.

    model: (label, path, text) to an answer in JSON, called for each part; None gives the rule's summary.
    least: shorter texts are left out (trees skip those under 50 characters).
    """
    kind = dict(nodes.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, label, path, arts, text in zip(pdf["_k"], pdf["label"], pdf["path"], pdf["articles"], pdf["text"]):
                plain, cut, status = extractive(text, arts), parts(text, size), "fallback_only"
                if model is not None and (text or "").strip():
                    good = [x for x, wrong in (checked(read_json(model(label, path, p))) for p in cut) if not wrong]
                    status, plain = ("generated", merged(good)) if good else ("invalid", plain)
                out.append({key: k, "status": status, "parts": len(cut), **plain})
            yield pd.DataFrame(out, columns=[key, "status", "parts", "executive", "legal", *LISTS])

    rows = nodes.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least).select(F.col(key).alias("_k"), "label", "path", "articles", "text")
    return rows.mapInPandas(run, f"{key} {kind}, status string, parts int, {SCHEMA}")


def usable(executive: Column, legal: Column, points: Column) -> Column:
    return (F.coalesce(F.trim(executive), F.lit("")) != "") | (F.coalesce(F.trim(legal), F.lit("")) != "") | F.coalesce(F.size(points) > 0, F.lit(False))


def context() -> Column:
    """The text that stands for a node in a model's context, from the columns label, path and the summary."""
    block = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n{title}:\n"), F.col(c)))
    bullets = lambda title, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    return F.concat_ws(
        "\n", F.concat(F.lit("=== "), "label", F.lit(" ===")), F.concat(F.lit("Caminho: "), F.coalesce("path", F.lit(""))), block("Resumo executivo", "executive"), block("Resumo juridico", "legal"), bullets("Pontos-chave", "points"),
        F.when(F.coalesce(F.size("articles"), F.lit(0)) > 0, F.concat(F.lit("\nArtigos cobertos: "), F.array_join("articles", ", "))), bullets("Obrigacoes", "duties"), bullets("Restricoes/vedacoes", "limits"), bullets("Definicoes", "definitions"),
    )


def on_demand(scoped: DataFrame, most: int = 24) -> DataFrame:
    """query_id, text, chunks: the scoped chunks of each query in reading order, up to ``most``."""
    w = Window.partitionBy("query_id").orderBy(F.coalesce("page_number", F.lit(10**9)), F.coalesce("place", F.lit(10**9)), "id")
    rows = scoped.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return rows.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("text"), F.count("*").alias("chunks"))
