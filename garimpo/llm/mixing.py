"""Sources mixed to target weights, measured in tokens.

Spellings of a source are one (case, blanks, hyphens, accents). The size of the mix is the largest at which
every source that has documents meets its share with at most ``max_repeats`` uses of each document; the
shares of targets without documents are spread over the others in proportion. A source gives whole passes
over its documents plus a prefix of its permuted order that comes nearest to the rest.

Documents of a source are permuted by a hash and cut into BLOCKS blocks. Only block sums (sources x BLOCKS
rows) reach the driver. There a splitting tree shares the blocks out: at every node a multivariate
hypergeometric draw says how many blocks of each source go to the left half of the shards, down to exact
quotas of every shard; disjoint permuted blocks fill them. Within a shard rows are ordered by a hash.

Defined cases: documents without source, of a source without target, or without tokens (null and empty texts)
take no part; no document in any target source gives an empty mix; equal texts are different documents;
a repeated doc_id counts once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.llm import tokens
from garimpo.session import settle

BLOCKS, SHARDS, SEED = 1024, 64, 20
ACCENTED, BARE = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def source_name(source: Column) -> Column:
    """One spelling of a source; null for blank ones."""
    s = F.translate(F.lower(source), ACCENTED, BARE)
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)


def plan(sums: dict[str, np.ndarray], targets: dict[str, tuple[float, int]]) -> dict[str, dict]:
    """Per source: quota of tokens, full passes, and where the prefix of the last pass ends.

    sums: tokens of each block in permuted order.
    """
    total = {s: int(b.sum()) for s, b in sums.items() if s in targets and b.sum() > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    if not total:
        return {}
    scale = sum(targets[s][0] for s in total)
    share = {s: targets[s][0] / scale for s in total}
    size = min(total[s] * targets[s][1] / share[s] for s in total)
    out = {}
    for s, a in total.items():
        quota = share[s] * size
        full = min(targets[s][1], int(quota / a + 1e-9))
        rest = max(0.0, quota - full * a) if full < targets[s][1] else 0.0
        ends = np.cumsum(sums[s])
        edge = int(np.searchsorted(ends, rest, side="right"))
        before = int(ends[edge - 1]) if edge else 0
        out[s] = {"quota": quota, "share": share[s], "full": full, "edge": edge, "left": rest - before}
    return out


def shard_quotas(units: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): exact numbers of units, by recursive multivariate hypergeometric splits."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(units)), np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        n = int(round(counts.sum() * (mid - lo) / (hi - lo)))
        left = rng.multivariate_hypergeometric(counts, n, method="marginals") if counts.sum() else counts
        split(left, lo, mid)
        split(counts - left, mid, hi)

    split(np.asarray(units, np.int64), 0, shards)
    return out


def sized(documents: DataFrame, sources: list[str] | None = None, **kw) -> DataFrame:
    """doc_id, source, n_tokens, block, part, h of the documents that can take part (of the given sources)."""
    named = documents.filter("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text").filter(F.col("source").isNotNull() & F.col("text").isNotNull())
    if sources is not None:
        named = named.filter(F.col("source").isin(sources))
    rows = tokens.sizes(named, carry=("source",), **kw).filter("n_tokens > 0").dropDuplicates(["doc_id"])
    h = F.xxhash64("doc_id", F.lit(SEED))
    return rows.select("doc_id", "source", "n_tokens", F.pmod(h, F.lit(BLOCKS)).cast("int").alias("block"), F.pmod(F.shiftright(h, 10), F.lit(BLOCKS)).cast("int").alias("part"), F.shiftright(h, 20).alias("h"))


def mix(documents: DataFrame, targets: DataFrame, shards: int = SHARDS, **kw) -> DataFrame:
    """doc_id, source, copy, n_tokens, shard, order_key."""
    spark = documents.sparkSession
    # The target table is fixed and small; it is read whole.
    goals = {r[0]: (float(r[1]), int(r[2])) for r in targets.select(source_name(F.col("source")), "target_share", "max_repeats").collect() if r[0] and r[1] is not None and r[2] is not None}
    schema = "doc_id long, source string, copy int, n_tokens long, shard int, order_key long"
    rows = settle(sized(documents.withColumn("doc_id", F.col("doc_id").cast("long")), sorted(goals), **kw))
    sums: dict[str, np.ndarray] = {}
    for r in rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():
        sums.setdefault(r["source"], np.zeros(BLOCKS, np.int64))[r["block"]] = r["n"]
    made = plan(sums, goals)
    if not made:
        return spark.createDataFrame([], schema)
    names = sorted(made)
    # Units are blocks of one pass; the edge block of the last pass counts as one, too.
    units = {s: [(c, b) for c in range(made[s]["full"]) for b in range(BLOCKS)] + [(made[s]["full"], b) for b in range(min(BLOCKS, made[s]["edge"] + 1)) if made[s]["full"] < goals[s][1]] for s in names}
    quotas = shard_quotas(np.array([len(units[s]) for s in names]), shards)
    rng = np.random.default_rng(SEED + 1)
    placed = []
    for i, s in enumerate(names):
        order = rng.permutation(len(units[s]))
        where = np.repeat(np.arange(shards), quotas[:, i])
        placed += [(s, int(units[s][u][0]), int(units[s][u][1]), int(where[k])) for k, u in enumerate(order)]
    # At most sources x repeats x BLOCKS rows.
    unit_rows = spark.createDataFrame(placed, "source string, copy int, block int, shard int")
    edges = spark.createDataFrame([(s, m["full"], m["edge"]) for s, m in made.items()], "source string, edge_copy int, edge int")

    every = rows.join(F.broadcast(unit_rows), ["source", "block"]).join(F.broadcast(edges), "source")
    inside = every.filter((F.col("copy") < F.col("edge_copy")) | (F.col("block") < F.col("edge"))).drop("part")
    # The edge block of a source is cut nearest to the quota: its parts are summed (sources x BLOCKS rows), and
    # the documents of one part, a millionth of the source, are put in order.
    edge = every.filter((F.col("copy") == F.col("edge_copy")) & (F.col("block") == F.col("edge")))
    part_sums: dict[str, np.ndarray] = {}
    for r in edge.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).collect():
        part_sums.setdefault(r["source"], np.zeros(BLOCKS, np.int64))[r["part"]] = r["n"]
    cuts = []
    for s, sums_of in part_sums.items():
        ends = np.cumsum(sums_of)
        at = min(int(np.searchsorted(ends, made[s]["left"], side="right")), BLOCKS - 1)
        cuts.append((s, at, float(made[s]["left"] - (ends[at - 1] if at else 0))))
    cut = edge.join(F.broadcast(spark.createDataFrame(cuts, "source string, cut int, left double")), "source")
    w = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.filter("part = cut").withColumn("upto", F.sum("n_tokens").over(w))
    nearest = last.filter(F.abs(F.col("upto") - F.col("left")) <= F.abs(F.col("upto") - F.col("n_tokens") - F.col("left")))
    nearest = cut.filter("part < cut").drop("part", "cut", "left").unionByName(nearest.drop("part", "cut", "left", "upto"))
    key = F.xxhash64("doc_id", "copy", F.lit(SEED + 2))
    return inside.unionByName(nearest).select("doc_id", "source", "copy", "n_tokens", "shard", key.alias("order_key"))


def shares(documents: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, actual_share, most_copies of every target."""
    used = mix(documents, targets, **kw).groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"), (F.max("copy") + 1).alias("most_copies"))
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = goals.join(F.broadcast(used), "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("source", "target_share", "max_repeats", zero("documents").alias("documents"), zero("tokens").alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("most_copies").alias("most_copies"))
