"""The k most similar vectors (cosine) of every vector within its collection.

Balanced posting lists. Centroids are trained per collection on a bounded sample, overfull clusters are split
and near-empty ones dropped, so that lists have similar sizes. A graph over the centroids is held in memory
by every worker and searched by a beam to find the lists near a vector. A vector is written to every list
whose centroid is almost as near as its nearest (boundary vectors are replicated), and it searches the lists
within a wider distance ratio. All vectors are indexed and all are queries.

Bounds: the sample has at most ``max_train`` vectors a collection and is clustered in two levels beyond
``TWO_LEVELS`` lists; the broadcast holds the centroids of collections larger than one list, at most
``max_lists`` in all, with DEGREE links each (beyond ``max_lists * list_size`` vectors lists grow). The graph is
built and searched in blocks: no matrix of all centroids against all centroids or queries is made. A list
larger than ``block`` is searched in blocks of members by blocks of queries, so no task holds a large list or
all of its queries. Exact copies of a vector (by two hashes of 96 bits) enter the index at most k + 1 times
(the lowest ids); further copies get the lowest ones as neighbours, which ties allow, so that a vector
repeated without end makes no large list either. ``exact=True`` compares all vectors of a collection, in blocks.

Defined cases: null, zero, non-finite and wrongly sized embeddings take no part; null ids and collections
neither; re-delivered rows count once; a collection of one vector gives no rows; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, DIM = 5, 64
LIST, BLOCK, MAX_TRAIN, MAX_LISTS, TWO_LEVELS = 256, 2048, 1 << 20, 1 << 17, 1024
PER_LIST = 64  # sampled vectors for each list
MEMBER_RATIO, MEMBERS, PROBE_RATIO, PROBES, BEAM, DEGREE = 1.12, 3, 1.45, 12, 24, 16


def usable(df: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, collection, embedding of the vectors that take part."""
    e = F.col("embedding")
    square = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "collection", e).filter((F.size(e) == dim) & F.col("vec_id").isNotNull() & F.col("collection").isNotNull())
    # A null or NaN entry makes the sum null or NaN, so that one test serves all.
    return rows.filter((square > 0) & (square < float("inf")))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    return m / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.float32)
    width = m.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(m.tobytes())])


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, sample rows of each). Clusters over twice the mean are split, those under an eighth dropped."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)].copy()

    def assign(c):
        return np.concatenate([np.argmax(x[i : i + 8192] @ c.T, 1) for i in range(0, len(x), 8192)])

    for r in range(rounds):
        a = assign(c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        kept = np.flatnonzero(n)
        c = sums[kept]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        if r >= rounds // 2:
            mean = len(x) / lists
            n = n[kept]
            halves = [c[(n >= mean / 8) | (len(c) < 4)]]
            for i in np.flatnonzero(n > 2 * mean):
                own = x[a == kept[i]]
                halves.append(own[rng.choice(len(own), int(n[i] // mean), replace=False)])
            c = np.concatenate(halves).astype(np.float32)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    n = np.bincount(assign(c), minlength=len(c))
    return c[n > 0], n[n > 0]


def two_level_centroids(x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in time that grows with the root of the number of lists: regions first, then lists within each."""
    if lists <= TWO_LEVELS:
        return balanced_centroids(x, lists)
    top, _ = balanced_centroids(x[:: max(1, len(x) // 65_536)], int(np.sqrt(lists)))
    region = np.concatenate([np.argmax(x[i : i + 8192] @ top.T, 1) for i in range(0, len(x), 8192)])
    order = np.argsort(region, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(region[order])) + 1)
    made = [balanced_centroids(x[own], max(1, round(lists * len(own) / len(x)))) for own in parts if len(own)]
    return np.concatenate([c for c, _ in made]), np.concatenate([n for _, n in made])


class Lists:
    """The centroids of one collection with their neighbour graph."""

    def __init__(self, centroids: np.ndarray, first: int, salts: np.ndarray):
        self.c, self.first, self.salts = centroids, first, salts
        k = len(centroids)
        degree = min(DEGREE, k)
        self.graph = np.empty((k, degree), np.int32)
        for lo in range(0, k, 512):
            near = centroids[lo : lo + 512] @ centroids.T
            self.graph[lo : lo + 512] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        # Entries: a greedy spread, so that every region is within a few steps.
        entries, best = [0], centroids @ centroids[0]
        while len(entries) < min(k, max(4, int(np.sqrt(k)))):
            i = int(np.argmin(best))
            entries.append(i)
            best = np.maximum(best, centroids @ centroids[i])
        self.entries = np.array(entries)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, cosines) of the nearest centroids that the beam finds, best first; -1 where there are fewer."""
        n = len(q)
        beam = min(beam, len(self.c))
        rows = np.arange(n)[:, None]
        cos = q @ self.c[self.entries].T
        start = np.argsort(-cos, axis=1)[:, :beam]
        pad = beam - start.shape[1]
        ids = np.pad(self.entries[start], ((0, 0), (0, pad)), constant_values=-1)
        cos = np.pad(np.take_along_axis(cos, start, 1), ((0, 0), (0, pad)), constant_values=-3.0)
        done = ids < 0
        for _ in range(2 * beam):
            at = np.argmax(np.where(done, -4.0, cos), 1)
            if done[rows[:, 0], at].all():
                break
            hop = self.graph[ids[rows[:, 0], at]]
            done[rows[:, 0], at] = True
            new = np.einsum("qd,qjd->qj", q, self.c[hop])
            known = (hop[:, :, None] == ids[:, None, :]).any(2)
            every = np.concatenate([cos, np.where(known, -3.0, new)], 1)
            keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            cos = np.take_along_axis(every, keep, 1)
            ids = np.take_along_axis(np.concatenate([ids, np.where(known, -1, hop)], 1), keep, 1)
            done = np.take_along_axis(np.concatenate([done, known], 1), keep, 1) | (ids < 0)
        top = np.argsort(-cos, axis=1, kind="stable")
        return np.take_along_axis(ids, top, 1), np.take_along_axis(cos, top, 1)

    def select(self, q: np.ndarray, probes: int, members: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, lists, is member): the lists of each vector after pruning by distance ratio."""
        top, cos = self.search(q, max(BEAM, 2 * probes))
        top, cos = top[:, :probes], cos[:, :probes]
        dist = np.sqrt(np.maximum(2 - 2 * cos, 1e-12))
        ratio = dist / dist[:, :1]
        take = (ratio <= PROBE_RATIO) & (cos > -2)
        member = (ratio <= MEMBER_RATIO) & (np.arange(top.shape[1]) < members)
        r, j = np.nonzero(take)
        return r, top[r, j], member[r, j]


def train(vectors: DataFrame, list_size: int, max_train: int, max_lists: int, dim: int) -> dict[str, Lists]:
    """The lists of every collection that needs more than one. Collects only centroids (bounded by max_lists)."""
    counts = vectors.groupBy("collection").agg(F.count("*").alias("n"))
    big = counts.filter(F.col("n") > 2 * list_size)
    total = big.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    list_size = max(list_size, -(-total // max_lists))
    share = F.least(F.lit(float(max_train)) / F.col("n"), F.lit(PER_LIST / list_size))
    unit = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One row for each collection beyond one list: at most total / list_size of them.
    sample = vectors.join(big.withColumn("share", share), "collection").filter(unit < F.col("share")).select("collection", "n", "embedding")

    def fit(group: pa.Table) -> pa.Table:
        x = _matrix(group["embedding"], dim)
        n = group["n"][0].as_py()
        c, seen = two_level_centroids(x, max(2, round(n / list_size)))
        scale = n / max(1, len(x))
        return pa.table({"collection": pa.array([group["collection"][0].as_py()] * len(c)), "centroid": _binary(c), "size": pa.array((seen * scale).astype(np.float64))})

    rows = sample.groupBy("collection").applyInArrow(fit, "collection string, centroid binary, size double").collect()
    out, first = {}, 0
    for name in sorted({r["collection"] for r in rows}):
        own = [r for r in rows if r["collection"] == name]
        sizes = np.array([r["size"] for r in own])
        out[name] = Lists(np.frombuffer(b"".join(bytes(r["centroid"]) for r in own), np.float32).reshape(-1, dim), first, np.maximum(1, np.ceil(2 * sizes / BLOCK)).astype(int))
        first += len(own)
    return out


def whole_lists(vectors: DataFrame, dim: int) -> dict[str, Lists]:
    """One list for each collection over a block, for the exact search."""
    big = vectors.groupBy("collection").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK // 2).collect()
    return {r["collection"]: Lists(np.zeros((1, dim), np.float32), 0, np.array([-(-2 * r["n"] // BLOCK)])) for r in big}


def nearest(df: DataFrame, k: int = K, dim: int = DIM, list_size: int = LIST, max_train: int = MAX_TRAIN, max_lists: int = MAX_LISTS, probes: int = PROBES, members: int = MEMBERS, exact: bool = False) -> DataFrame:
    """vec_id, neighbour, similarity: up to k rows a vector."""
    spark = df.sparkSession
    rows = usable(df, dim).withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    # Copies: only the lowest ids of each vector pass, and that before the shuffle.
    same = Window.partitionBy("collection", "h", "h2").orderBy("vec_id")
    lowest = rows.withColumn("nth", F.dense_rank().over(same)).filter(F.col("nth") <= k + 2)
    groups = lowest.groupBy("collection", "h", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    vectors = groups.select("collection", F.explode(F.slice("ids", 1, k + 1)).alias("vec_id"), "embedding")
    held = spark.sparkContext.broadcast(whole_lists(vectors, dim) if exact else train(vectors, list_size, max_train, max_lists, dim))

    schema = "collection string, list int, salt int, vec_id long, member boolean, query boolean, v binary"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column("collection").to_pylist(), object)
            x = _matrix(batch.column("embedding"), dim)
            ids = batch.column("vec_id").to_numpy()
            for name in dict.fromkeys(names):
                at = np.flatnonzero(names == name)
                own = lists.get(name)
                for lo in range(0, len(at), 2048):
                    part = at[lo : lo + 2048]
                    if own is None:
                        r, l, m, salts = np.arange(len(part)), np.zeros(len(part), int), np.ones(len(part), bool), np.ones(1, int)
                    else:
                        r, l, m = own.select(x[part], probes, members)
                        salts = own.salts
                    # A list in b blocks is b x b groups: members of block i meet the queries of block j. A member
                    # goes to row i, a query to column j; where both meet the vector is sent once.
                    blocks = salts[l]
                    own_block = (ids[part][r] // 64) % blocks
                    copies = np.where(m, 2 * blocks - 1, blocks)
                    at2 = np.repeat(np.arange(len(r)), copies)
                    nth = np.arange(len(at2)) - np.repeat(np.cumsum(copies) - copies, copies)
                    b2, own2 = blocks[at2], own_block[at2]
                    as_query = nth < b2
                    i = np.where(as_query, nth, own2)
                    j = np.where(as_query, own2, (own2 + nth - b2 + 1) % b2)
                    member = m[at2] & (i == own2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at2), pa.string()), pa.array(l[at2].astype(np.int32)), pa.array((i * b2 + j).astype(np.int32)), pa.array(ids[part][r[at2]]), pa.array(member), pa.array(as_query), _binary(x[part][r[at2]])],
                        names=["collection", "list", "salt", "vec_id", "member", "query", "v"],
                    )

    def search(group: pa.Table) -> pa.Table:
        x = _matrix(group["v"], dim)
        ids = group["vec_id"].to_numpy()
        m = np.flatnonzero(group["member"].to_numpy(zero_copy_only=False))
        m = m[np.argsort(ids[m], kind="stable")]
        q = np.flatnonzero(group["query"].to_numpy(zero_copy_only=False))
        near, sims, who = [], [], []
        if len(m):
            for lo in range(0, len(q), 1024):
                own = q[lo : lo + 1024]
                s = x[own] @ x[m].T
                s[ids[own, None] == ids[m][None, :]] = -2.0
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if len(m) > k else np.tile(np.arange(len(m)), (len(s), 1))
                val = np.take_along_axis(s, top, 1)
                ok = val > -2.0
                near += [ids[m][t[o]] for t, o in zip(top, ok)]
                sims += [v[o] for v, o in zip(val, ok)]
                who.append(ids[own])
        who = np.concatenate(who) if who else np.array([], np.int64)
        n = np.array([len(a) for a in near], np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.array([], kind))
        return pa.table({"vec_id": pa.array(who), "ids": pa.ListArray.from_arrays(offsets, flat(near, np.int64)), "sims": pa.ListArray.from_arrays(offsets, flat(sims, np.float32))})

    routed = vectors.mapInArrow(route, schema)
    local = routed.groupBy("collection", "list", "salt").applyInArrow(search, "vec_id long, ids array<long>, sims array<float>")
    best = F.transform(F.arrays_zip("sims", "ids"), lambda z: F.struct((-z["sims"]).alias("far"), z["ids"].alias("id")))
    merged = local.groupBy("vec_id").agg(F.array_sort(F.flatten(F.collect_list(best))).alias("best"))
    # The same pair may come from several lists with rounding differences: the first of each id counts.
    merged = merged.withColumn("best", F.transform(F.slice(F.array_distinct(F.col("best.id")), 1, k), lambda i: F.get(F.filter("best", lambda b: b["id"] == i), F.lit(0))))
    found = merged.select("vec_id", F.explode("best").alias("b")).select("vec_id", F.col("b.id").alias("neighbour"), (-F.col("b.far")).cast("double").alias("similarity"))
    # One vector may be a third of all rows: the join is salted by the ids.
    crowded = groups.filter(F.size("ids") > k + 1).select("collection", "h", "h2", F.slice("ids", 1, k + 1).alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"))
    further = rows.select("vec_id", "collection", "h", "h2", F.pmod("vec_id", F.lit(8)).cast("int").alias("part")).join(crowded, ["collection", "h", "h2", "part"]).filter(~F.array_contains("ids", F.col("vec_id")))
    copies = further.dropDuplicates(["vec_id"]).select("vec_id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity"))
    return found.unionByName(copies)


def pairs(df: DataFrame, **kw) -> DataFrame:
    """vec_id_a < vec_id_b where at least one is among the nearest of the other."""
    found = nearest(df, **kw)
    return found.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()
