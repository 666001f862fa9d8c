"""Hits and their algebra: vector search, merging, expansion, re-ranking, trimming.

A hit is a row with query_id, an item id, a score and what else is needed. Every operator works on many
queries at once, partitioned by query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import scope as S
from garimpo.session import settle

BROADCAST_QUERIES = 20_000


def where(meta: Column, condition: dict) -> Column:
    """The filter language of metadata: {k: v}, {k: {"$eq": v}}, {"$and": [...]}; an unknown operator matches nothing."""
    out = F.lit(True)
    for k, v in condition.items():
        if k == "$and":
            for part in v:
                out = out & where(meta, part)
        elif k.startswith("$"):
            out = out & F.lit(False)
        elif isinstance(v, dict):
            out = out & ((F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")) == str(v["$eq"])) if set(v) == {"$eq"} else F.lit(False))
        else:
            out = out & (F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")) == str(v))
    return out


VECTOR_BLOCK = 50_000


def _k_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, exclude_self: bool, block: int) -> pd.DataFrame:
    """The k best distinct ids of each query: the better score first, then the lower id."""
    ids, first = np.unique(ids, return_index=True)
    v = v[first]
    out = []
    for lo in range(0, len(q) if len(ids) else 0, block):
        own = q_ids[lo : lo + block]
        s = np.round(q[lo : lo + block] @ v.T, 9)
        if exclude_self:
            s[own[:, None] == ids[None, :]] = -9
        n = min(k, len(ids))
        edge = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
        r, c = np.nonzero((s >= edge[:, None]) & (s > -9))
        order = np.lexsort((ids[c], -s[r, c], r))
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < n
        out.append(pd.DataFrame({"query_id": own[r[keep]], "id": ids[c[keep]], "score": s[r[keep], c[keep]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, dim: int, exclude_self: bool = True, block: int = 2000) -> DataFrame:
    """query_id, id, score, rank: the exact k best cosines of each query.

    queries: query_id, q; vectors: id, v. Up to BROADCAST_QUERIES queries are broadcast and vectors stay where they
    lie: each task multiplies the queries with its vectors and keeps k a query. More queries are cut into blocks of
    that size and vectors into blocks of VECTOR_BLOCK, as many as the counts ask for, and each pair of blocks is one
    task. Copies of an id count once, which is seen to among the candidates. Non-finite, zero and wrongly sized
    vectors are left out.
    """
    spark = queries.sparkSession
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    usable = lambda c: (F.size(c) == dim) & (square(c) > 0) & (square(c) < float("inf"))
    qs = queries.filter(usable(F.col("q"))).select(F.col("query_id").cast("long").alias("query_id"), "q").dropDuplicates(["query_id"])
    vs = vectors.filter(usable(F.col("v")) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "v")

    def matrix(column) -> np.ndarray:
        m = np.array(list(column), np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m.reshape(0, dim)

    schema = "query_id long, id long, score double"
    n = qs.count()
    if n <= BROADCAST_QUERIES:
        rows = qs.collect()  # at most BROADCAST_QUERIES
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), matrix([r[1] for r in rows])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = held.value
            for pdf in batches:
                if len(q) and len(pdf):
                    yield _k_best(q_ids, q, pdf["id"].to_numpy(), matrix(pdf["v"]), k, exclude_self, block)

        part = vs.mapInPandas(scan, schema)
    else:
        q_blocks, v_blocks = -(-n // max(1, BROADCAST_QUERIES)), max(1, -(-vs.count() // VECTOR_BLOCK))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = qs.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("part", every(v_blocks))
        right = vs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int")).withColumn("b", every(q_blocks))

        def meet(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            return _k_best(a["query_id"].to_numpy(np.int64), matrix(a["q"]), c["id"].to_numpy(np.int64), matrix(c["v"]), k, exclude_self, block)

        part = left.groupBy("b", "part").cogroup(right.groupBy("b", "part")).applyInPandas(meet, schema)
    return top(best_of(part), k)


def best_of(hits: DataFrame, key: str = "id") -> DataFrame:
    """One row for each query and item, with its highest score."""
    return hits.groupBy("query_id", key).agg(F.max("score").alias("score"))


def top(hits: DataFrame, k: int, key: str = "id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def over_threshold(hits: DataFrame, least: float, key: str = "id") -> DataFrame:
    """Hits over a score; the best one stays if none is."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter((F.col("score") >= least) | (F.col("rank") == 1))


def rank_decay(rank: Column) -> Column:
    """Score of structured rows by their place, from 0."""
    return F.greatest(F.lit(0.5), 1 - rank * F.lit(0.03))


def continuity(hits: DataFrame, bonus: float) -> DataFrame:
    """Bonus for matching references (up to 3), for hits that share a parent, for parents. Needs strength, parent_key, chunk_type."""
    shared = F.count("*").over(Window.partitionBy("query_id", "parent_key"))
    extra = F.least(F.col("strength"), F.lit(3)) * bonus
    extra = extra + F.when((F.coalesce("parent_key", F.lit("")) != "") & (shared > 1), bonus * 0.6).otherwise(0.0)
    extra = extra + F.when(F.col("chunk_type") == "parent", bonus * 0.35).otherwise(0.0)
    return hits.withColumn("base_score", F.col("score")).withColumn("score", F.col("score") + extra)


def trim_to_budget(hits: DataFrame, budget: int, key: str = "id") -> DataFrame:
    """Drops the lowest scores, never the first hit, until the tokens fit. Needs rank (1 is first) and tokens."""
    total = F.sum("tokens").over(Window.partitionBy("query_id"))
    # Tokens of the droppable hits that go before this one.
    w = Window.partitionBy("query_id").orderBy((F.col("rank") == 1).cast("int"), "score", F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    return hits.withColumn("total", total).withColumn("gone", gone).filter((F.col("rank") == 1) | (F.col("total") - F.col("gone") <= budget)).drop("total", "gone")


def expand_parents(hits: DataFrame, chunks: DataFrame, most: int = 5, budget: int | None = None, chars_per_token: float = 3.5) -> DataFrame:
    """Parents of the child hits of each query with the best child's score, up to ``most`` and a budget of tokens; parents that are hits already stay out."""
    best = hits.filter((F.col("chunk_type") == "child") & F.col("parent_key").isNotNull()).groupBy("query_id", "parent_key").agg(F.max("score").alias("score"))
    size = F.floor(F.length(F.coalesce("text", F.lit(""))) / F.lit(chars_per_token)).cast("long")
    parents = chunks.filter(F.col("chunk_type") == "parent").select("parent_key", "id", (size if budget is not None else F.lit(0).cast("long")).alias("tokens"))
    found = top(best.join(parents, "parent_key").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti"), most)
    if budget is None:
        return found.drop("tokens")
    # At most ``most`` rows a query: those that fit are taken in order, a larger one is passed over.
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "parent_key", "score", "tokens"))).alias("p"))
    fit = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("ranks")), lambda a, x: F.when(a["sum"] + x["tokens"] <= budget, F.struct((a["sum"] + x["tokens"]).alias("sum"), F.array_append(a["ranks"], x["rank"]).alias("ranks"))).otherwise(a), lambda a: a["ranks"])
    return rows.select("query_id", F.explode(F.filter("p", lambda x: F.array_contains(fit, x["rank"]))).alias("x")).select("query_id", "x.parent_key", "x.id", "x.score", "x.rank")


def expand_neighbours(hits: DataFrame, chunks: DataFrame, width: int = 1, decay: float = 0.92) -> DataFrame:
    """Chunks within ``width`` places of a hit in its document, with a decayed score: an equi-join on exploded places."""
    near = hits.select("query_id", "doc", F.explode(F.sequence(F.col("place") - width, F.col("place") + width)).alias("place"), (F.col("score") * decay).alias("score"))
    best = near.groupBy("query_id", "doc", "place").agg(F.max("score").alias("score"))
    return best.join(chunks.select("doc", "place", "id"), ["doc", "place"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")


def token_overlap(queries: DataFrame, corpus: DataFrame, k: int = 5, block: int = 2000) -> DataFrame:
    """query_id, id, score, rank: shared tokens over the tokens of the text, the k best of each query.

    queries: query_id, tokens; corpus: id, tokens. The queries' tokens form an inverted index that is broadcast (by
    blocks of BROADCAST_QUERIES queries); texts stay where they lie, and each batch of them leaves at most k rows a
    query, so frequent tokens make no pairs beyond a batch.
    """
    spark = queries.sparkSession
    qs = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct("tokens").alias("t")).filter(F.size("t") > 0).dropDuplicates(["query_id"])
    texts = corpus.select(F.col("id").cast("long").alias("id"), F.array_distinct("tokens").alias("t")).filter(F.size("t") > 0)
    n_blocks = max(1, -(-qs.count() // max(1, BROADCAST_QUERIES)))
    parts = []
    for i in range(n_blocks):
        own = qs if n_blocks == 1 else qs.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
        rows = own.collect()  # about BROADCAST_QUERIES
        index: dict[str, list[int]] = {}
        for j, r in enumerate(rows):
            for t in r["t"]:
                index.setdefault(t, []).append(j)
        held = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), {t: np.array(js, np.int64) for t, js in index.items()}))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            q_ids, postings = held.value
            for pdf in batches:
                for lo in range(0, len(pdf), block):
                    ids, tokens = pdf["id"].to_numpy()[lo : lo + block], pdf["t"].iloc[lo : lo + block]
                    # One pair for each shared token of this block of texts, summed up at once.
                    met = [postings[w] * len(ids) + d for d, ts in enumerate(tokens) for w in ts if w in postings]
                    if not met:
                        continue
                    pair, shared = np.unique(np.concatenate(met), return_counts=True)
                    q, d = np.divmod(pair, len(ids))
                    score = shared / np.array([len(t) for t in tokens])[d]
                    order = np.lexsort((ids[d], -score, q))
                    q, d, score = q[order], d[order], score[order]
                    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                    yield pd.DataFrame({"query_id": q_ids[q[keep]], "id": ids[d[keep]], "score": score[keep]})

        parts.append(texts.mapInPandas(scan, "query_id long, id long, score double"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return top(best_of(hits), k)


def rerank(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int | None = None, base: float = 0.65) -> DataFrame:
    """Hits (with question and text) rescored by a model on pairs, blended with their score through a sigmoid.

    score: question and text series to raw scores; it runs as a pandas UDF on Arrow batches.
    """
    second = F.pandas_udf(score, "double")("question", "text")
    out = hits.withColumn("base_score", F.col("score")).withColumn("second", second).withColumn("score", base * F.col("score") + (1 - base) / (1 + F.exp(-F.col("second"))))
    return out if k is None else top(out, k)


def overlap_logit(question: pd.Series, text: pd.Series) -> pd.Series:
    """A pair scorer without a model: the share of the question's words that the text holds, from -4 to 4."""
    words = lambda x: set(re.findall(r"[^\W_]{3,}", (x or "").lower()))
    out = []
    for q, t in zip(question, text):
        a = words(q)
        out.append(8.0 * len(a & words(t)) / len(a) - 4.0 if a else -4.0)
    return pd.Series(out, dtype="float64")


def label(doc: str = "doc") -> Column:
    """Where a chunk comes from, for readers."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.concat(
        F.lit("Documento: "), F.coalesce(F.col(doc), F.lit("desconhecido")),
        F.when(F.col("page_number").isNotNull(), F.concat(F.lit(", p. "), F.col("page_number"))).otherwise(""),
        F.when(filled("artigo"), F.concat(F.lit(", "), "artigo")).otherwise(""),
        F.when(filled("paragrafo"), F.concat(F.lit(", "), "paragrafo")).otherwise(""),
        F.when(filled("inciso"), F.concat(F.lit(", inciso "), "inciso")).otherwise(""),
    )


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: numbered blocks in order of rank; parent and children of one unit form one block, parent first.

    hits: query_id, rank, text, chunk_type, parent_key and the columns of label. A query's hits are its trimmed top.
    """
    unit = F.when(F.col("chunk_type").isin("parent", "child") & (F.coalesce("parent_key", F.lit("")) != ""), F.col("parent_key"))
    rows = hits.select("query_id", "rank", F.coalesce("text", F.lit("")).alias("text"), label().alias("label"), F.coalesce("caminho_hierarquico", F.lit("")).alias("path"), (F.col("chunk_type") != "parent").cast("int").alias("late"), unit.alias("unit"), F.coalesce(unit, F.concat(F.lit("\u0000"), F.col("rank"))).alias("block"))
    blocks = rows.groupBy("query_id", "block").agg(F.min("rank").alias("rank"), F.max("unit").alias("unit"), F.array_sort(F.collect_list(F.struct("late", F.col("rank").alias("r"), "label", "path", "text"))).alias("x"))
    first = F.get("x", F.lit(0))
    head = F.concat(first["label"], F.when(F.col("unit").isNotNull() & (first["path"] != ""), F.concat(F.lit(" | "), first["path"])).otherwise(""))
    body = F.concat(F.lit("] ("), head, F.lit(")\nTrecho:\n"), F.array_join(F.transform("x", lambda x: x["text"]), "\n\n"))
    per = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", body.alias("b")))).alias("y"))
    return per.select("query_id", F.array_join(F.transform("y", lambda y, i: F.concat(F.lit("["), i + 1, y["b"])), "\n\n---\n\n").alias("context"))


def doubtful(answer: Column, strength: Column, place: Column) -> Column:
    """An answer that found nothing although a hit's headings match gets a note naming the place."""
    missed = X.norm_match(answer).rlike("nao encontrei|nao localizei")
    note = F.concat(F.lit("\n\nObs.: há um trecho possivelmente relevante ("), place, F.lit("); o contexto pode estar incompleto."))
    return F.when(missed & (strength > 0) & ~F.contains(answer, F.trim(note)), F.concat(answer, note)).otherwise(answer)


@dataclass(frozen=True)
class Settings:
    """Parameters of a retrieval run."""

    k: int = 15
    fetch: int = 45
    dim: int = 64
    continuity: float = 0.12
    hint_bonus: float = 0.14
    least: float = 0.0
    parents: int = 5
    parent_share: float = 0.4
    budget: int = 6000
    chars_per_token: float = 3.5


def retrieve(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, settings: Settings = Settings(), score: Callable | None = None) -> DataFrame:
    """Ranked chunks of each question, from search to the context budget.

    questions: query_id, question, q (several rows a query for rewritten questions; their hits are united);
    vectors: id, v, chunk; chunks: id, doc, place, text and structural columns. Search, union and best score by
    chunk, optional second score, structural continuity, the k best over the threshold, further chunks of the
    chapter asked for, heading boost, chapter first, parents within a share of the budget, trimming.
    """
    c = settings
    asked = questions.select("query_id", "question").dropDuplicates(["query_id"])
    rewritten = questions.select("query_id", F.xxhash64("query_id", "q").alias("form"), "q").dropDuplicates(["form"])
    near = vector_topk(rewritten.select(F.col("form").alias("query_id"), "q"), vectors.select("id", "v"), c.fetch, c.dim, exclude_self=False)
    near = near.withColumnRenamed("query_id", "form").join(rewritten.select("form", "query_id"), "form").join(vectors.select("id", "chunk").distinct(), "id")
    scores = best_of(near.select("query_id", F.col("chunk").alias("id"), F.greatest("score", F.lit(0.0)).alias("score")))
    own = lambda s: s.join(chunks, "id")
    hits = own(scores)
    if score is not None:
        hits = rerank(hits.join(asked, "query_id"), score).drop("question", "second", "base_score")
    hits = continuity(S.strength(hits, asked), c.continuity).drop("strength", "base_score")
    # Settled where several steps read the same rows (k a query, or somewhat more): else each would search again.
    hits = settle(over_threshold(top(hits, c.k).drop("rank"), c.least).drop("rank"))
    further = best_of(S.supplement(hits, asked, chunks).unionByName(S.expand_chapter(hits, asked, chunks)))
    hits = hits.unionByName(own(further), allowMissingColumns=True)
    hits = settle(S.prioritise(S.boost_hints(hits, asked, c.hint_bonus), asked))
    parents = expand_parents(hits, chunks, c.parents, int(c.budget * c.parent_share), c.chars_per_token)
    extra = own(parents.select("query_id", "id", "score", F.col("rank").alias("nth"))).withColumn("rank", F.lit(1_000_000) + F.col("nth")).drop("nth")
    hits = hits.unionByName(extra, allowMissingColumns=True).withColumn("tokens", F.floor(F.length(F.coalesce("text", F.lit(""))) / F.lit(c.chars_per_token)).cast("long"))
    kept = trim_to_budget(hits, c.budget)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))


def by_route(routed: DataFrame, structured: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Hits of each question by its route: rows, vectors or both; questions without rows fall back on vectors.

    routed: query_id, route; structured: query_id, id, place (from 0); vector: query_id, id, score.
    """
    rows = structured.join(routed.filter("route in ('structured', 'hybrid')"), "query_id").select("query_id", "id", rank_decay(F.col("place")).alias("score"))
    with_rows = rows.select("query_id").distinct().withColumn("has", F.lit(True))
    open_ = routed.join(with_rows, "query_id", "left").filter((F.col("route") != "structured") | F.col("has").isNull()).select("query_id")
    return top(best_of(rows.unionByName(vector.select("query_id", "id", "score").join(open_, "query_id", "left_semi"))), k)
