"""Subject areas of each document.

One linear classifier for each subject (one versus rest) over hashed word n-grams of a sentence.

Training: the labelled examples give a first model. A bounded sample of documents gets weak labels: from the
words of address paths and section metadata (title, collection, source, url, path, section, as far as the
table has them) that name a subject or go with one subject alone, else from the subject that most sentences
point to; these weak labels teach the words that no example holds. Sentences of the sample are then labelled
by the next model: those it is sure of keep their subject, those that no subject claims (general office text)
become negatives of all subjects.

Use: every sentence of every document is scored once; the scores of all documents are summed up in a histogram
by subject, and each threshold is the middle of the emptiest stretch between claimed and unclaimed sentences.
A document has a subject if at least ``share`` of its sentences deal with it. Headings, question lines and
opening and closing formulas do not count as sentences.

Bounds: for fitting, features of at most ``max_docs`` sampled documents with MAX_SENTENCES sentences each and of
``max_examples`` examples reach the driver; the model is a fixed table of 2**BITS rows, the histogram has
subjects x GRID cells. Everything else runs over all documents.

Defined cases: null, empty and blank texts and texts of headings alone have no subject; a repeated document
counts once for its id; without examples nothing is found.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.session import settle

BITS, SHARE, MAX_DOCS, MAX_EXAMPLES, MAX_SENTENCES, GRID = 17, 0.2, 3000, 20_000, 64, 100
PLACES = ("title", "collection", "source", "url", "path", "section")
LEAST_SUPPORT, PURE = 20, 0.8  # of a metadata word among the sampled documents
MASK = (1 << BITS) - 1

_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
# Openings of numbered items, and formulas that carry no subject.
_ITEM = re.compile(r"^\W*(?:(?:cl[aá]usula|art(?:igo)?\.?|section|secci[oó]n|se[cç][aã]o|item|§)\s*\d+\s*[ºª°o]?\s*[.:)–—-]*|\d+(?:\.\d+)*\s*[.)–-]|[a-z]\)|[ivxlc]+\s*[.)–-]|(?:resposta|answer|respuesta|a|r)\s*:)\s*", re.I)
_FORMULA = re.compile(r"^\W*(?:pergunta\s*\d*|question\s*\d*|pregunta\s*\d*|boletim n|cap[ií]tulo\s+[ivxlc\d]+|anexo\s+[ivxlc\d]+|t[ií]tulo\s+[ivxlc\d]+|nada mais havendo|aos \d+ dias)", re.I)
_END = re.compile(r"(?<=[.!?])[\"”’)]*\s+(?=[^\sa-z])")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    """Sentences of the running text: with a full stop, not a formula, of at least three words."""
    out = []
    for line in _INVISIBLE.sub("", unicodedata.normalize("NFC", text or "")).splitlines():
        line = _ITEM.sub("", line.strip(), 1)
        for s in _END.split(line):
            s = _ITEM.sub("", s, 1).strip()
            if "|" in s or not re.search(r"[.!?;:][\"”’)]*$", s) or _FORMULA.match(s):
                continue
            if len(_WORD.findall(s)) >= 3:
                out.append(s)
    return out


_cache: dict[str, int] = {}


def features_of(lines: list[str]) -> list[np.ndarray]:
    """Hashed words, pairs and triples of each sentence, distinct; all sentences are hashed at once."""
    if not lines:
        return []
    if len(_cache) > 1_000_000:
        _cache.clear()
    words = [_WORD.findall(x.lower()) for x in lines]
    for w in {w for ws in words for w in ws if w not in _cache}:
        _cache[w] = zlib.crc32(w.encode())
    n = np.array([len(ws) for ws in words])
    a = np.array([_cache[w] for ws in words for w in ws], np.uint64)
    row = np.repeat(np.arange(len(lines)), n)
    parts, owners = [a], [row]
    if len(a) > 1:
        same = row[:-1] == row[1:]
        parts.append((a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77) + np.uint64(1))[same])
        owners.append(row[:-1][same])
    if len(a) > 2:
        same = row[:-2] == row[2:]
        parts.append((a[:-2] * np.uint64(0xC2B2AE3D) + a[1:-1] * np.uint64(0x27D4EB2F) + a[2:] * np.uint64(0x165667B1) + np.uint64(2))[same])
        owners.append(row[:-2][same])
    x = np.concatenate(parts)
    x ^= x >> np.uint64(29)
    h = (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(MASK)
    both = np.unique(np.concatenate(owners).astype(np.uint64) << np.uint64(BITS) | h)
    return np.split((both & np.uint64(MASK)).astype(np.int64), np.searchsorted(both >> np.uint64(BITS), np.arange(1, len(lines))))


def features(sentence: str) -> np.ndarray:
    return features_of([sentence])[0]


def plain_words(text: str | None) -> list[str]:
    """Words of an address, title or name: no accents, no digits, from three letters on."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return [w for w in re.findall(r"[a-z]+", bare) if len(w) > 2]


class Batch:
    """Sentences as one sparse matrix of normalised rows."""

    def __init__(self, feats: list[np.ndarray]):
        n = np.array([max(1, len(f)) for f in feats])
        self.idx = np.concatenate([f if len(f) else np.zeros(1, np.int64) for f in feats]) if feats else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if feats else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(len(feats)), n)
        self.val = (1 / np.sqrt(n)).astype(np.float32)

    def scores(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((0, w.shape[1]), np.float32)
        return np.add.reduceat(w[self.idx], self.starts, axis=0) * self.val[:, None] + b


def fit(feats: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 12, size: int = 256, rate: float = 0.5, decay: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every column of y, by Adagrad."""
    rng = np.random.default_rng(seed)
    k = y.shape[1]
    w, b = np.zeros((1 << BITS, k), np.float32), np.full(k, -2.0, np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    weight = np.ones(len(feats), np.float32) if weight is None else weight.astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(feats))
        for lo in range(0, len(order), size):
            at = order[lo : lo + size]
            batch = Batch([feats[i] for i in at])
            p = 1 / (1 + np.exp(-np.clip(batch.scores(w, b), -30, 30)))
            g = (p - y[at]) * weight[at][:, None]
            cols, where = np.unique(batch.idx, return_inverse=True)
            grad = np.zeros((len(cols), k), np.float32)
            np.add.at(grad, where, (g * batch.val[:, None])[batch.rows])
            grad += decay * w[cols]
            gw[cols] += grad**2
            w[cols] -= rate * grad / np.sqrt(gw[cols])
            sums = g.sum(0)
            gb += sums**2
            b -= rate * sums / np.sqrt(gb)
    return w, b


def _one_hot(labels: np.ndarray, k: int) -> np.ndarray:
    y = np.zeros((len(labels), k), np.float32)
    known = labels >= 0
    y[np.flatnonzero(known), labels[known]] = 1
    return y


class Model:
    """told: sampled documents whose weak label came from metadata."""

    def __init__(self, subjects: list[str], w: np.ndarray, b: np.ndarray, threshold: np.ndarray, told: int = 0):
        self.subjects, self.w, self.b, self.threshold, self.told = subjects, w, b, threshold, told

    def probabilities(self, feats: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(Batch(feats).scores(self.w, self.b), -30, 30)))


def metadata_labels(subjects: list[str], places: list[list[str]], doc_label: np.ndarray) -> np.ndarray:
    """The subject that the metadata words of each document tell, -1 for none.

    A word tells a subject if it is part of its name, or if nearly all labelled documents that hold it have it.
    """
    names: dict[str, set[int]] = {}
    for i, s in enumerate(subjects):
        for w in plain_words(s):
            names.setdefault(w, set()).add(i)
    counts: dict[str, np.ndarray] = {}
    for words, label in zip(places, doc_label):
        for w in set(words):
            c = counts.setdefault(w, np.zeros(len(subjects) + 1, np.int64))
            c[label] += 1  # the last cell counts documents without a label
    tells = {}
    for w, c in counts.items():
        own = names.get(w.split(":", 1)[1])
        if own is not None and len(own) == 1:
            tells[w] = next(iter(own))
        elif c.sum() >= LEAST_SUPPORT and c[:-1].max() >= PURE * c.sum():
            tells[w] = int(np.argmax(c[:-1]))
    out = np.full(len(places), -1)
    for i, words in enumerate(places):
        told = {tells[w] for w in words if w in tells}
        if len(told) == 1:
            out[i] = told.pop()
    return out


def train(examples: list[tuple[str, str]], docs: list[list[np.ndarray]], places: list[list[str]] | None = None, rounds: int = 2) -> Model | None:
    """examples: (subject, text). docs: sentence features of the sampled documents; places: their metadata words."""
    subjects = sorted({s for s, t in examples if s and t})
    if not subjects:
        return None
    k = len(subjects)
    ex = [(subjects.index(s), f) for s, t in examples if s and t for f in features_of(sentences(t) or [t])]
    ex_feats, ex_y = [f for _, f in ex], np.array([i for i, _ in ex])
    w, b = fit(ex_feats, _one_hot(ex_y, k))
    places = places if places is not None else [[] for _ in docs]
    kept = [i for i, d in enumerate(docs) if len(d)]
    docs, places = [docs[i] for i in kept], [places[i] for i in kept]
    feats = [f for d in docs for f in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    threshold = np.full(k, 0.5)
    if not feats:
        return Model(subjects, w, b, threshold)
    # Weak labels by document: general sentences get the labels of all subjects alike and so convince none.
    told = 0
    for r in range(rounds):
        s = Batch(feats).scores(w, b)
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        votes = np.zeros((len(docs), k))
        np.add.at(votes, owner, p)
        share = votes / np.maximum(votes.sum(1, keepdims=True), 1e-9)
        sure = share.max(1) >= 0.4
        doc_label = np.where(sure, np.argmax(votes, 1), -1)
        by_place = metadata_labels(subjects, places, doc_label)
        told = int((by_place >= 0).sum())
        doc_label = np.where(by_place >= 0, by_place, doc_label)
        use = np.flatnonzero(doc_label[owner] >= 0)
        y = np.concatenate([_one_hot(ex_y, k), _one_hot(doc_label[owner[use]], k)])
        w, b = fit(ex_feats + [feats[i] for i in use], y, epochs=4)
    # Then by sentence: what a subject claims clearly keeps it, what none claims is a negative of all.
    for r in range(rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(Batch(feats).scores(w, b), -30, 30)))
        best, top = np.argmax(p, 1), p.max(1)
        low, high = (0.45, 0.55) if r else (0.4, 0.6)
        label = np.where(top >= high, best, -1)
        use = np.flatnonzero((top >= high) | (top <= low))
        # The examples themselves hold general sentences, which by now score low.
        ex_top = 1 / (1 + np.exp(-np.clip(Batch(ex_feats).scores(w, b), -30, 30)))[np.arange(len(ex_y)), ex_y]
        ex_label = np.where(ex_top >= low, ex_y, -1)
        w, b = fit(ex_feats + [feats[i] for i in use], np.concatenate([_one_hot(ex_label, k), _one_hot(label[use], k)]), epochs=5)
    return Model(subjects, w, b, threshold, told)


def calibrated(counts: np.ndarray) -> float:
    """The middle of the emptiest stretch, from counts of sentences by probability (GRID cells)."""
    grid = np.linspace(0.2, 0.8, 25)
    cells = (np.arange(GRID) + 0.5) / GRID
    near = np.array([counts[(cells > g - 0.06) & (cells < g + 0.06)].sum() for g in grid])
    return float(np.mean(grid[np.flatnonzero(near == near.min())]))


def fitted(documents: DataFrame, examples: DataFrame, max_docs: int = MAX_DOCS, metadata: bool = True) -> Model | None:
    """Fits on all examples (up to MAX_EXAMPLES) and a sample of max_docs documents drawn by a hash of the id."""
    ex = [(r[0], r[1]) for r in examples.select("subject", "text").orderBy(F.xxhash64("text")).limit(MAX_EXAMPLES).collect()]
    h = F.xxhash64("doc_id", F.lit(3))
    cut = documents.select(h.alias("h")).orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    found = [c for c in PLACES if metadata and c in documents.columns]
    rows = documents.filter((h <= F.lit(cut)) & F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0)).select(h.alias("h"), "text", F.array(*[F.col(c).cast("string") for c in found]).cast("array<string>").alias("places"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            feats = []
            for t in pdf["text"]:
                own = sentences(t)
                if len(own) > MAX_SENTENCES:
                    own = sorted(own, key=lambda x: zlib.crc32(x.encode()))[:MAX_SENTENCES]
                feats.append([f.astype(np.int32) for f in features_of(own)])
            words = [[f"{c}:{w}" for c, v in zip(found, values) for w in plain_words(v)] for values in pdf["places"]]
            yield pd.DataFrame({"h": pdf["h"], "feats": feats, "words": words})

    picked = sorted(rows.mapInPandas(read, "h long, feats array<array<int>>, words array<string>").collect(), key=lambda r: r["h"])[:max_docs]
    return train(ex, [[np.array(f, np.int64) for f in r["feats"]] for r in picked], [r["words"] for r in picked])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, best (number of the likeliest subject), cell (its probability) of each sentence, as arrays."""
    held = documents.sparkSession.sparkContext.broadcast((model.w, model.b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = held.value
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                own = [sentences(t) for t in part["text"]]
                s = Batch(features_of([x for d in own for x in d])).scores(w, b)
                best = np.argmax(s, 1).astype(np.int16) if len(s) else np.zeros(0, np.int16)
                p = 1 / (1 + np.exp(-np.clip(s[np.arange(len(s)), best], -30, 30)))
                cell = np.minimum((p * GRID).astype(np.int16), GRID - 1)
                ends = np.cumsum([len(d) for d in own])[:-1]
                yield pd.DataFrame({"doc_id": part["doc_id"], "best": np.split(best, ends), "cell": np.split(cell, ends)})

    rows = documents.filter(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, best array<short>, cell array<short>").filter(F.size("best") > 0)


def classify(documents: DataFrame, model: Model | None, share: float = SHARE) -> DataFrame:
    """doc_id, subject, sentences, share of every subject at or over the share."""
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], "doc_id long, subject string, sentences int, share double")
    told = settle(scored(documents, model))
    counts = np.zeros((len(model.subjects), GRID), np.int64)
    pairs = told.select(F.explode(F.arrays_zip("best", "cell")).alias("x"))
    for r in pairs.groupBy("x.best", "x.cell").count().collect():
        counts[r[0], r[1]] = r[2]
    least = [int(round(calibrated(c) * GRID)) for c in counts]
    limits = F.array(*map(F.lit, least))
    sure = F.filter(F.arrays_zip("best", "cell"), lambda x: x["cell"] >= F.get(limits, x["best"].cast("int")))
    n = F.size("best")
    own = F.transform(F.array_distinct(F.transform(sure, lambda x: x["best"])), lambda c: F.struct(c.alias("c"), F.size(F.filter(sure, lambda x: x["best"] == c)).alias("n")))
    rows = told.select("doc_id", n.alias("sentences"), F.explode(own).alias("x")).filter(F.col("x.n") >= share * F.col("sentences") - 1e-9)
    names = F.array(*map(F.lit, model.subjects))
    return rows.select("doc_id", F.get(names, F.col("x.c").cast("int")).alias("subject"), "sentences", (F.col("x.n") / F.col("sentences")).alias("share"))


def subjects_of(documents: DataFrame, examples: DataFrame, **kw) -> DataFrame:
    return classify(documents, fitted(documents, examples, **kw)).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """subject, documents, sentences of the corpus; a document counts for each of its subjects."""
    found = classify(documents, fitted(documents, examples)).dropDuplicates(["doc_id", "subject"])
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("share") * F.col("sentences"))).cast("long").alias("sentences"))
