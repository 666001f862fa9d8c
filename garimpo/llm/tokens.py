"""Token ids of a whole corpus with a public tokenizer.

Texts up to ``leaf`` characters are encoded in Arrow batches. Longer ones are cut into leaves that are encoded
in parallel, in a given number of tasks, and joined in a tree; one task joins FAN neighbours, so that a text of up to
FAN leaves is shuffled once and finished texts are not shuffled with longer ones. At a join the tokenizer runs again over a window around it: from the last
split point of the left side that no later text can move, to the first split point that the window and the
right side have in common. The window grows until there is one, so the result equals encoding the text whole.

Defined cases: null and empty texts give an empty list; blanks are encoded as they are; ids of special tokens
never occur, as their strings are ordinary text here.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.session import settle

FOLDER, NAME, LEAF = "/opt/tokenizers", "byte_bpe_50k.json", 4096
FAN = 16  # neighbouring stretches joined (in a tree) by one task
#: The split pattern looks at most two characters past a split ('re, 've, 'll).
AHEAD = 3


@lru_cache(maxsize=4)
def tokenizer(folder: str = FOLDER, name: str = NAME):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, name))
    t.encode_special_tokens = True
    return t


class Piece:
    """A stretch of text with its ids and split points: ends[i] characters hold counts[i] ids."""

    __slots__ = ("text", "ids", "ends", "counts")

    def __init__(self, text, ids, ends, counts):
        self.text, self.ids, self.ends, self.counts = text, np.asarray(ids, np.int32), np.asarray(ends, np.int64), np.asarray(counts, np.int64)


def encode_piece(t, text: str) -> Piece:
    e = t.encode(text, add_special_tokens=False)
    words = np.fromiter((-1 if w is None else w for w in e.word_ids), np.int64, len(e.ids))
    splits = t.pre_tokenizer.pre_tokenize_str(text)
    return Piece(text, e.ids, [s[1][1] for s in splits], np.searchsorted(words, np.arange(len(splits)), side="right"))


def join_pieces(t, a: Piece, b: Piece, window: int = 64) -> Piece:
    if not len(a.text) or not len(b.text):
        return b if not len(a.text) else a
    at = len(a.text)
    k = int(np.searchsorted(a.ends, at - AHEAD, side="right"))
    begin = int(a.ends[k - 1]) if k else 0
    kept = int(a.counts[k - 1]) if k else 0
    right = np.concatenate([[0], b.ends]) + at
    while True:
        stop = min(len(b.text), window)
        mid = encode_piece(t, a.text[begin:] + b.text[:stop])
        ends = mid.ends + begin
        sure = ends if stop == len(b.text) else ends[ends <= at + stop - AHEAD]
        both = np.intersect1d(sure[sure >= at], right)
        if len(both):
            break
        window *= 4
    x = int(both[0])
    n = int(np.searchsorted(ends, x)) + 1
    m = int(np.searchsorted(right, x))
    skipped = int(b.counts[m - 1]) if m else 0
    used = int(mid.counts[n - 1])
    return Piece(
        a.text + b.text,
        np.concatenate([a.ids[:kept], mid.ids[:used], b.ids[skipped:]]),
        np.concatenate([a.ends[:k], ends[:n], b.ends[m:] + at]),
        np.concatenate([a.counts[:k], mid.counts[:n] + kept, b.counts[m:] - skipped + kept + used]),
    )


def joined(t, pieces: list[Piece]) -> Piece:
    """The pieces of a stretch as one, joined in a tree."""
    while len(pieces) > 1:
        pieces = [join_pieces(t, *pieces[i : i + 2]) if len(pieces[i : i + 2]) == 2 else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = NAME, leaf: int = LEAF, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to carry, ids of every row."""
    rows = df.select(F.col(key).alias("doc_id"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("with_it"), F.col(text).alias("text"))

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        t = tokenizer(folder, name)
        out = []
        for lo in range(0, len(texts), 256):
            out += [np.asarray(e.ids, np.int32) for e in t.encode_batch([x or "" for x in texts[lo : lo + 256]], add_special_tokens=False)]
        return pd.Series(out)

    def named(found: DataFrame) -> DataFrame:
        return found.select(F.col("doc_id").alias(key), *[F.col("with_it")[c].alias(c) for c in carry], "ids")

    # Else a later filter on the result would run the tokenizer a second time.
    ids_of = ids_of.asNondeterministic()
    short = rows.filter(F.col("text").isNull() | (F.length("text") <= leaf)).select("doc_id", "with_it", ids_of("text").alias("ids"))
    long = rows.filter(F.length("text") > leaf)
    leaves_of = F.ceil(F.length("text") / F.lit(leaf))
    most, every = long.agg(F.max(leaves_of), F.sum(leaves_of)).first()
    if not most:
        return named(short)
    cut = long.select("doc_id", "with_it", "text", F.xxhash64("doc_id", "text").alias("copy"), leaves_of.cast("int").alias("n"), F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(leaf))).alias("node", "start"))
    leaves = cut.select("doc_id", F.when(F.col("node") == 0, F.col("with_it")).alias("with_it"), "copy", "n", "node", F.substring("text", F.col("start") + 1, F.lit(leaf)).alias("text"))
    schema = T.StructType([*leaves.schema.fields, *[T.StructField(c, T.ArrayType(k)) for c, k in (("ids", T.IntegerType()), ("ends", T.LongType()), ("counts", T.LongType()))]])

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(folder, name)
        for pdf in batches:
            made = [encode_piece(t, x) for x in pdf["text"]]
            yield pdf.assign(ids=[p.ids for p in made], ends=[p.ends for p in made], counts=[p.counts for p in made])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").drop_duplicates("node")
        p = joined(tokenizer(folder, name), [Piece(*x) for x in zip(group["text"], group["ids"], group["ends"], group["counts"])])
        first = group.iloc[:1].copy()
        first["node"] //= FAN
        for c in ("text", "ids", "ends", "counts"):
            first[c] = [getattr(p, c)]
        return first

    # A fixed number of tasks: by their bytes adaptive execution would put all leaves into one.
    parts = int(min(max(df.sparkSession.sparkContext.defaultParallelism, every // 256), every, 100_000))
    nodes, out, left = leaves.repartition(parts, "doc_id", "node").mapInPandas(encode_leaves, schema), short, most
    while True:
        nodes = nodes.groupBy("doc_id", "copy", F.floor(F.col("node") / FAN)).applyInPandas(join, schema)
        nodes = nodes.withColumn("n", F.ceil(F.col("n") / F.lit(FAN)).cast("int"))
        left = -(-left // FAN)
        if left == 1:
            return named(out.unionByName(nodes.select("doc_id", "with_it", "ids")))
        # Finished texts leave; only those with further joins are shuffled again.
        nodes = settle(nodes)
        out = out.unionByName(nodes.filter("n = 1").select("doc_id", "with_it", "ids"))
        nodes = nodes.filter("n > 1")


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), **kw) -> DataFrame:
    return encode(df, key, text, carry=carry, **kw).select(key, *carry, F.size("ids").cast("long").alias("n_tokens"))
