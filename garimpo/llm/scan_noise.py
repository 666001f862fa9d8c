"""Noise of scanned pages: found, told by kind, and repaired into continuous paragraphs.

* running_line: lines at page edges are reduced to a skeleton (plain letters only, so case, digits, spacing
  and wrong decodings do not matter). A skeleton that repeats over a document's page edges, and hardly inside
  its pages, is its heading or foot line; lines near it by edit distance, cut off or with an addition count
  too. A skeleton that is a running line of several documents also counts where a document is too short to
  repeat it. The title of the first page is none.
* page_number: a line at a page edge with nothing but a number in any dress, whose difference to the page is
  the same on several pages of the document (or that is plainly dressed as a page number).
* hyphen: a hyphen sign after a letter at a line's end, before a letter in the next line or at the end of the
  block.
* misread: word counts of the whole corpus are grouped by a key that maps characters of the same shape
  (e/c, m/rn, d/cl, o/0, ...) onto one another; a rare form beside a frequent plain word is a misreading of it.

Margins are learned from the lines that documents repeat in the same place; no line, word or number is left
out for its length (words from LEAST_WORD letters on, as shorter ones have no shape of their own).

Repair: noise lines go, misread words are mended, and lines are joined. Whether a word cut at a line end
keeps its hyphen is decided by the counts of all words of the corpus, joined to the cut words.

Scale: only edge lines and per-document counts are shuffled. Word counts are pre-aggregated by partition.
Rows are filtered against a broadcast of at most ``known_words`` frequent right words; what is left is
joined with all misread forms, so the bound never loses one. Joins on a document alone are salted.

Defined cases: null and blank texts have no noise; null bbox leaves position to the reading order; documents
of one page are judged by what other documents repeat; re-delivered rows count once; empty tables give no
rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.llm.garbled import examine
from garimpo.session import settle

KNOWN_WORDS = 100_000
ZONE = 3  # blocks from a page's edge
SAME_PLACE, SLACK = 6.0, 12.0  # a repeated line moves less than this; one line more is still its margin
LEAST_WORD, MARKED_TIMES, PLAIN_TIMES = 3, 2, 8
HYPHENS = "-¬­‐‑"

# ---------------------------------------------------------------- lines at page edges


def skeleton(line: Column) -> Column:
    """Plain letters of a line in lower case; letters with marks are left out, as they suffer most."""
    return F.regexp_replace(F.lower(F.regexp_replace(line, r"\p{L}\p{M}+", "")), "[^a-z]+", "")


PAGE = (
    r"^[^a-z0-9]*(?:(?:p[a-z0-9@]{0,2}[g9][il1|]n[a@]s?|p|pg|pag|page|fl|fls|f[o0][l1|]has?)[^a-z0-9]*(?:n[^a-z0-9]*)?)?"
    r"(?:0*(\d{1,5})|([ivxlc]{1,9}))(?:[^a-z0-9]*(?:de|of|/)?[^a-z0-9]*\d{1,5})?[^a-z0-9]*$"
)
#: Lines of at most five short words, whatever signs stand between them: no other can match PAGE.
FEW_WORDS = r"^[^\p{L}\p{N}@]*+(?:[\p{L}\p{M}\p{N}@]{1,12}+(?:[^\p{L}\p{N}@]++|$)){1,5}+$"
DRESS = r"[a-z]{1,8}[^a-z0-9]*\d|[\[\]()|/–—-]|^[^a-z0-9]*0\d|\d[^a-z0-9]+(?:de|of|/)"


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


def page_value(line: Column) -> Column:
    """The number of a line that holds nothing but a page number, else null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(line, r"(\p{L})\p{M}+", "")), r"[^\x00-\x7f]", "")
    digits, roman = F.regexp_extract(bare, PAGE, 1), F.regexp_extract(bare, PAGE, 2)
    romans = F.create_map(*[F.lit(x) for n in range(1, 400) for x in (_roman(n), n)])
    return F.when(digits != "", digits.try_cast("int")).when(roman != "", F.element_at(romans, roman))


def edge_lines(blocks: DataFrame) -> DataFrame:
    """Lines that can be running lines or page numbers: block_key, doc, page, side, line, key, number, single, inside, y, title, up.

    up: place of the block on its page, from above.
    """
    text = F.trim(F.col("text"), F.lit(" \t\r\n"))
    rows = blocks.select(
        "block_key", F.col("pdf_doc_id").alias("doc"), F.col("page_number").alias("page"), F.col("block_seq").alias("seq"),
        F.get("bbox", F.lit(1)).alias("y"), (F.col("block_type") == "title").alias("title"), text.alias("t"),
    ).filter(F.col("t").rlike(r"[\p{L}\p{N}]") & F.col("doc").isNotNull() & F.col("page").isNotNull())
    first, last = F.substring_index("t", "\n", 1), F.substring_index("t", "\n", -1)
    bare = lambda c: F.trim(c, F.lit(" \t\r"))
    # Rows of a table have as many bars as the line beside them.
    bars = lambda c: F.size(F.split(c, r"\|"))
    second, second_last = F.element_at(F.split(F.substring_index("t", "\n", 2), "\n"), -1), F.get(F.split(F.substring_index("t", "\n", -2), "\n"), F.lit(0))
    single = F.instr("t", "\n") == 0
    plain = lambda c, beside: F.when(single | (bars(c) == 1) | (bars(c) != bars(beside)), bare(c))
    slim = rows.select("block_key", "doc", "page", "seq", "y", "title", plain(first, second).alias("first"), F.when(~single, plain(last, second_last)).alias("last"), single.alias("single"))
    page = Window.partitionBy("doc", "page")
    # dense_rank: re-delivered rows share the rank.
    ranked = slim.withColumn("up", F.dense_rank().over(page.orderBy("seq"))).withColumn("down", F.dense_rank().over(page.orderBy(F.desc("seq"))))
    top, foot = F.col("up") <= ZONE, F.col("down") <= ZONE + 1
    each = F.filter(
        F.array(
            F.struct(F.lit("top").alias("side"), F.when(top & F.col("first").isNotNull(), F.col("first")).alias("line"), F.lit(False).alias("inside")),
            F.struct(F.lit("foot").alias("side"), F.when(foot & ~(F.col("single") & top), F.coalesce("last", F.when(F.col("single"), F.col("first")))).alias("line"), F.lit(False).alias("inside")),
            F.struct(F.lit("none").alias("side"), F.when(~top & ~foot, F.col("first")).alias("line"), F.lit(True).alias("inside")),
        ),
        lambda x: x["line"].isNotNull(),
    )
    lines = ranked.select("block_key", "doc", "page", "y", "title", "single", "up", F.explode(each).alias("e")).select("block_key", "doc", "page", "y", "title", "single", "up", "e.*").distinct()
    lines = lines.withColumn("key", skeleton(F.col("line"))).withColumn("number", page_value(F.col("line")))
    # The last line of a paragraph goes on in lower case; that is running text.
    return lines.filter(F.col("single") | (F.col("side") != "foot") | F.col("number").isNotNull() | ~F.col("line").rlike(r"^\p{Ll}"))


def plain_line(line: Column) -> Column:
    """A line without digits and blanks, by a plain character map."""
    return F.translate(line, "0123456789 \t", "")


class Margins:
    """The bands over and under the text, learned from what single lines at page edges repeat in the same place."""

    def __init__(self, lines: DataFrame):
        same = lines.filter("page > 1 and single and not inside and y is not null and number is null").filter(F.length("key") >= 6)
        keys = same.groupBy("doc", "side", "key").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).filter((F.col("n") >= 3) & (F.col("hi") - F.col("lo") <= SAME_PLACE))
        row = keys.agg(
            F.percentile_approx(F.when(F.col("side") == "top", F.col("hi")), 0.99).alias("top"), F.percentile_approx(F.when(F.col("side") == "foot", F.col("lo")), 0.01).alias("foot")
        ).first()
        self.top = float("-inf") if row["top"] is None else row["top"] + SLACK
        self.foot = float("inf") if row["foot"] is None else row["foot"] - SLACK

    def holds(self) -> Column:
        return F.coalesce(F.col("single") & ((F.col("y") <= self.top) | (F.col("y") >= self.foot)), F.lit(False))

    def title(self) -> Column:
        """The title of a document's first page, which is no running line."""
        return (F.col("page") == 1) & F.col("single") & (F.col("title") | F.coalesce((F.col("up") <= 2) & F.col("y").isNotNull(), F.lit(False))) & ~self.holds()


SALTS = 8  # parts of a document's lines in joins with its few running lines or offsets


def _salted(lines: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """lines joined with few on columns that a third of all lines may share; semi and anti joins are split by adaptive execution."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64("block_key"), F.lit(SALTS)).cast("int")).join(spread, [*on, "_salt"], how).drop("_salt")


def running_keys(lines: DataFrame, pages: DataFrame, margins: Margins) -> DataFrame:
    """doc, key of the running lines that a document repeats."""
    named = lines.filter((F.length("key") >= 6) & F.col("number").isNull() & ~margins.title())
    by_page = named.groupBy("doc", "key", "page").agg(
        F.max((~F.col("inside")).cast("int")).alias("edge"), F.max(margins.holds().cast("int")).alias("margin"),
        F.max((F.col("single") & F.col("y").isNotNull()).cast("int")).alias("placed"),
    )
    sums = by_page.groupBy("doc", "key").agg(F.sum("edge").alias("edge"), F.count("*").alias("all"), F.sum("margin").alias("margin"), F.sum("placed").alias("placed")).join(pages, "doc")
    repeated = (F.col("edge") >= 2) & (F.col("edge") >= 0.8 * F.col("all")) & (F.col("edge") >= 0.2 * F.col("pages"))
    placed = (F.col("placed") == 0) | (F.col("margin") >= 0.5 * F.col("placed"))
    return sums.filter(repeated & placed).select("doc", "key")


def running_lines(lines: DataFrame, own: DataFrame, margins: Margins, least_docs: int = 2) -> DataFrame:
    """block_key, doc, side, line of every running line."""
    cand = lines.filter(~F.col("inside") & (F.length("key") >= 5) & F.col("number").isNull() & ~margins.title())
    exact = cand.join(own, ["doc", "key"], "left_semi")
    rest = cand.join(own, ["doc", "key"], "left_anti")
    # Fuzzy: against the few running lines of the same document.
    refs = own.withColumnRenamed("key", "ref")
    n, m = F.length("key"), F.length("ref")
    near = _salted(rest, refs, ["doc"]).filter(
        (F.startswith("ref", "key") & (n >= 0.6 * m)) | (F.startswith("key", "ref") & (n <= 1.4 * m)) | ((n >= 0.75 * m) & (n <= 1.35 * m) & (F.levenshtein("key", "ref") <= F.greatest(F.floor(m * 0.2), F.lit(2))))
    )
    # Short documents: what several others repeat, in the margin.
    shared = own.groupBy("key").agg(F.countDistinct("doc").alias("n")).filter(F.col("n") >= least_docs).select("key")
    margin = rest.filter(margins.holds())
    known = margin.join(shared, "key", "left_semi")
    titles = lines.filter(margins.title() & (F.length("key") >= 6)).select("doc", F.col("key").alias("ref")).distinct()
    titled = margin.join(titles, "doc").filter(F.startswith("ref", "key") | F.startswith("key", "ref"))
    cols = ["block_key", "doc", "side", "line"]
    return exact.select(cols).unionByName(near.select(cols)).unionByName(known.select(cols)).unionByName(titled.select(cols)).distinct()


def page_offsets(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, offset between printed and real page number, where several pages agree."""
    cand = lines.filter(~F.col("inside") & F.col("number").isNotNull()).select("doc", "page", (F.col("number") - F.col("page")).alias("offset")).distinct()
    sums = cand.groupBy("doc", "offset").agg(F.count("*").alias("n")).join(pages, "doc")
    return sums.filter((F.col("n") >= 2) & (F.col("n") >= 0.2 * F.col("pages"))).select("doc", "offset")


def page_numbers(lines: DataFrame, offsets: DataFrame, margins: Margins) -> DataFrame:
    """block_key, doc, side, line of every line that holds only its page's number."""
    cand = lines.filter(~F.col("inside") & F.col("number").isNotNull()).withColumn("offset", F.col("number") - F.col("page"))
    agreed = cand.join(offsets, ["doc", "offset"], "left_semi")
    dressed = F.lower("line").rlike(DRESS) | margins.holds()
    alone = cand.join(offsets.select("doc").distinct(), "doc", "left_anti").filter(dressed & ((F.abs("offset") <= 2000) | margins.holds()))
    cols = ["block_key", "doc", "side", "line"]
    return agreed.select(cols).unionByName(alone.select(cols)).distinct()


# ---------------------------------------------------------------- words

SHAPES = str.maketrans({"m": "rri", "n": "ri", "d": "ci", "u": "ii", "e": "c", "l": "i", "1": "i", "|": "i", "f": "t", "@": "a", "0": "o", "5": "s", "9": "g", "6": "b", "8": "b", "2": "z"})
_TOKEN = re.compile(r"[\w@|]{%d,}" % LEAST_WORD)
_JOIN = re.compile(r"[%s](?<=[^\W\d_].)[ \t]*\n\s*(?=[^\W\d_])" % HYPHENS)
_LOST = re.compile(r"[\w@|]*\ufffd[\w@|\ufffd]*")
_HEAD = re.compile(r" [–|·] |\d/\d{4}")
_ODD = re.compile(r"[^\x00-\x7fáàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇºª°–—¬­‐‑]")


def clean_form(text: str) -> str:
    """Composed letters, wrong decodings undone."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", examine(text)[1]) if _ODD.search(text) else text


def _found(part: str) -> list[str]:
    """Words of one paragraph, without what may be half of a word cut between blocks."""
    part = part.strip()
    joined = _JOIN.sub("", part) if "\n" in part else part
    low = joined.lower()
    # Halves of words with a lost character are no words.
    found = _TOKEN.findall(_LOST.sub(" ", low) if "\ufffd" in low else low)
    if not found:
        return found
    if joined[0].islower() and low.startswith(found[0]):
        found = found[1:]
    if "\n" in joined:
        lines = joined.split("\n", 2)
        if lines[1][:1].islower() and (lines[0].isupper() or _HEAD.search(lines[0])):
            # A heading on top of the block: the line after it may begin with half a word.
            head = _TOKEN.match(lines[1].lower())
            if head and head.group() in found:
                found.remove(head.group())
    if found and joined[-1] in HYPHENS and low.rstrip(HYPHENS + " \t\n").endswith(found[-1]):
        found = found[:-1]
    return found


def _parts(text: str | None, mend: bool = True) -> Iterator[list[str]]:
    """Words by paragraph. mend: undo wrong decodings first."""
    if not text:
        return
    # Paragraph by paragraph: a whole document nearly always has some odd character somewhere.
    for part in text.split("\n\n") if "\n\n" in text else (text,):
        if mend:
            part = clean_form(part)
        elif not part.isascii():
            part = unicodedata.normalize("NFC", part)
        yield _found(part)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word, n over all texts, counted by partition first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush():
            keep = [(w, n) for w, n in c.items() if not w.isdigit()]
            c.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                # Garbled words only add rare forms here; they are mended where rows are judged.
                for found in _parts(t, mend=False):
                    c.update(found)
            if len(c) > 300_000:
                yield flush()
        yield flush()

    made = texts.select(F.col(text).alias("t")).filter(F.length("t") >= LEAST_WORD).mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def shape_key(word: Column) -> Column:
    """One key for words whose characters look alike: single shapes first, then wide letters spelled out."""
    one = {k: v for k, v in SHAPES.items() if len(v) == 1}
    key = F.translate(word, "".join(map(chr, one)), "".join(one.values()))
    for k, v in SHAPES.items():
        if len(v) > 1:
            key = F.replace(key, F.lit(chr(k)), F.lit(v))
    return key


def right_words(counts: DataFrame) -> DataFrame:
    """key, right, m: the most frequent plain word of each shape."""
    plain = counts.filter((F.length("word") >= LEAST_WORD) & F.col("word").rlike(r"^\p{L}+$"))
    best = plain.groupBy(shape_key(F.col("word")).alias("key")).agg(F.max(F.struct("n", "word")).alias("b"))
    return best.select("key", F.col("b.word").alias("right"), F.col("b.n").alias("m"))


def judged_words(words: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of words (word, n and more) that are misread forms, with the right word."""
    pairs = words.withColumn("key", shape_key(F.col("word"))).join(right, "key").filter(F.col("word") != F.col("right"))
    times = F.when(F.col("word").rlike(r"^\p{L}+$"), PLAIN_TIMES).otherwise(MARKED_TIMES)
    return pairs.filter((F.col("m") >= times * F.col("n")) & F.col("word").rlike(r"\p{L}.*\p{L}")).drop("key", "m", "n")


def misread_rows(texts: DataFrame, counts: DataFrame, right: DataFrame, known: list[str]) -> DataFrame:
    """src, row_key, word, right of each misread word of a text (columns src, row_key, t).

    A word that only occurs in wrongly decoded texts has no count of its own and counts as one.
    """
    held = texts.sparkSession.sparkContext.broadcast(frozenset(known))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = held.value
        for batch in batches:
            src, keys, out = batch.column("src").to_pylist(), batch.column("row_key").to_pylist(), ([], [], [])
            for s, k, t in zip(src, keys, batch.column("t").to_pylist()):
                left = set()
                for found in _parts(t):
                    left.update(found)
                for w in left - good:
                    if not w.isdigit():
                        out[0].append(s)
                        out[1].append(k)
                        out[2].append(w)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["src", "row_key", "word"])

    left = texts.mapInArrow(rare, "src string, row_key long, word string").join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return judged_words(left, right)


# ---------------------------------------------------------------- all kinds

BEFORE = r"[a-zA-Z@|\u00a1-\u00ab\u00ae-\u2009\u2020-\u2025\u2027-\uffff]"
AFTER = r"[a-zA-Z\u00a1-\u00ab\u00ae-\u2009\u2020-\u2025\u2027-\uffff]"


def hyphenated(text: Column) -> Column:
    return text.rlike(f"[{HYPHENS}](?<={BEFORE}.)[ \\t\\r]*(?:\\n\\s*{AFTER}|\\s*$)")


def line_end_hyphen(text: Column) -> Column:
    """A hyphen sign after a letter at the end of any line, whatever follows."""
    return text.rlike(f"[{HYPHENS}](?<={BEFORE}.)\\s*(?:\\n|$)")


class Noise:
    """The frames of one run, settled where several results need them."""

    def __init__(self, blocks: DataFrame, results: DataFrame, known_words: int = KNOWN_WORDS):
        self.blocks = blocks.filter("block_key is not null")
        self.results = results.filter("result_id is not null")
        self.lines = settle(edge_lines(self.blocks))
        self.pages = self.lines.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("pages"))
        self.margins = Margins(self.lines)
        self.own = settle(running_keys(self.lines, self.pages, self.margins))
        self.offsets = settle(page_offsets(self.lines, self.pages))
        self.running = settle(running_lines(self.lines, self.own, self.margins))
        self.numbers = settle(page_numbers(self.lines, self.offsets, self.margins))
        self.counts = settle(word_counts(self.blocks, "text"))
        self.right = settle(right_words(self.counts))
        wrong = judged_words(self.counts, self.right).select("word")
        frequent = self.counts.join(wrong, "word", "left_anti").orderBy(F.desc("n"), "word").limit(known_words)
        self.known = [r[0] for r in frequent.select("word").collect()]
        self.texts = self.blocks.select(F.lit("pdf_blocks").alias("src"), F.col("block_key").cast("long").alias("row_key"), F.col("text").alias("t")).unionByName(
            self.results.select(F.lit("pipeline_results").alias("src"), F.col("result_id").cast("long").alias("row_key"), F.col("clean_text").alias("t"))
        ).filter(F.col("t").rlike(r"\S"))

    def result_lines(self) -> DataFrame:
        """row_key, pos, line, kind of the running lines and page numbers left in joined texts.

        Joined texts hold the lines of the blocks, so lines are compared with those found there, but for
        digits and blanks. What a document's blocks showed (a few lines and offsets) is joined to its texts
        before they are cut, so that only lines of a fitting length are looked at.
        """
        refs = self.running.select("doc", plain_line(F.col("line")).alias("ref"), F.length("line").alias("n")).groupBy("doc").agg(F.collect_set("ref").alias("refs"), (F.min("n") * 0.5).alias("lo"), (F.max("n") * 1.6).alias("hi"))
        offsets = self.offsets.groupBy("doc").agg(F.collect_set("offset").alias("offsets"))
        rows = self.results.filter(F.length("clean_text") > 0).select(F.col("result_id").cast("long").alias("row_key"), F.col("pdf_doc_id").alias("doc"), F.col("page_from").alias("a"), F.col("page_to").alias("b"), "clean_text").dropDuplicates(["row_key"])
        rows = rows.join(refs, "doc", "left").join(offsets, "doc", "left")
        cut = F.transform(F.split("clean_text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(" \t\r")).alias("line")))
        fitting = F.filter(cut, lambda x: x["line"].rlike(FEW_WORDS) | F.coalesce((F.length(x["line"]) >= F.col("lo")) & (F.length(x["line"]) <= F.col("hi")), F.lit(False)))
        lines = rows.select("row_key", "a", "b", "refs", "offsets", F.explode(fitting).alias("x")).select("row_key", "a", "b", "refs", "offsets", "x.*").filter("line <> ''")
        lines = lines.withColumn("number", F.when(F.col("line").rlike(FEW_WORDS), page_value(F.col("line"))))
        # Title of the first page: among the first lines of the text that begins with page 1.
        title = (F.coalesce("a", F.lit(1)) == 1) & (F.col("pos") <= 3)
        running = ~title & F.array_contains("refs", plain_line(F.col("line")))
        real = F.transform("offsets", lambda o: F.col("number") - o)
        page = F.when(F.col("offsets").isNotNull(), F.exists(real, lambda p: (p >= F.col("a")) & (p <= F.col("b")))).otherwise(F.lower("line").rlike(DRESS))
        kind = F.when(F.col("number").isNotNull() & page, "page_number").when(F.col("number").isNull() & running, "running_line")
        return lines.select("row_key", "pos", "line", kind.alias("kind")).filter("kind is not null")

    def hyphen_rows(self, marked: DataFrame) -> DataFrame:
        """src, row_key of the texts with words cut at line ends; marked: what result_lines gives.

        Joined texts are judged without their marked lines, as page numbers and running lines may stand between the halves.
        """
        cand = self.texts.filter(line_end_hyphen(F.col("t")))
        gone = marked.groupBy("row_key").agg(F.collect_set("pos").alias("gone"))
        joined = cand.filter("src = 'pipeline_results'").join(gone, "row_key", "left")
        # Lines without a letter or digit ('~ ~ ~') are never marked and hold no half of a word.
        kept = F.filter(F.split("t", "\n"), lambda x, i: x.rlike(r"[\p{L}\p{N}]") & ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
        joined = joined.withColumn("t", F.array_join(kept, "\n"))
        both = cand.filter("src = 'pdf_blocks'").unionByName(joined.select("src", "row_key", "t"))
        return both.filter(hyphenated(F.col("t"))).select("src", "row_key")

    def found(self) -> DataFrame:
        """src, row_key, noise_kind."""
        blocks = lambda df, kind: df.select(F.lit("pdf_blocks").alias("src"), F.col("block_key").cast("long").alias("row_key"), F.lit(kind).alias("noise_kind"))
        marked = settle(self.result_lines())
        kinds = [
            self.hyphen_rows(marked).select("src", "row_key", F.lit("hyphen").alias("noise_kind")),
            misread_rows(self.texts, self.counts, self.right, self.known).select("src", "row_key", F.lit("misread").alias("noise_kind")),
            blocks(self.running, "running_line"), blocks(self.numbers, "page_number"),
            marked.select(F.lit("pipeline_results").alias("src"), "row_key", F.col("kind").alias("noise_kind")),
        ]
        out = kinds[0]
        for k in kinds[1:]:
            out = out.unionByName(k)
        return out.distinct()

    def repaired(self) -> DataFrame:
        """src, row_key, text, repaired: noise lines taken out, words mended, lines joined to paragraphs."""
        drop = self.running.unionByName(self.numbers).groupBy("block_key").agg(F.collect_set("line").alias("drop")).select(F.lit("pdf_blocks").alias("src"), F.col("block_key").cast("long").alias("row_key"), "drop")
        drop = drop.unionByName(self.result_lines().groupBy("row_key").agg(F.collect_set("line").alias("drop")).select(F.lit("pipeline_results").alias("src"), "row_key", "drop"))
        mend = misread_rows(self.texts, self.counts, self.right, self.known).groupBy("src", "row_key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("mend"))
        rows = self.texts.dropDuplicates(["src", "row_key"]).join(drop, ["src", "row_key"], "left").join(mend, ["src", "row_key"], "left")

        def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                clean = [without_lines(t, d) for t, d in zip(pdf["t"], pdf["drop"])]
                pairs = [[{"a": a, "b": b} for a, b in sorted(broken_words(t))] for t in clean]
                yield pd.DataFrame({"src": pdf["src"], "row_key": pdf["row_key"], "text": pdf["t"], "clean": clean, "mend": pdf["mend"], "pairs": pairs})

        clean = settle(rows.mapInPandas(clear, "src string, row_key long, text string, clean string, mend map<string,string>, pairs array<struct<a:string,b:string>>"))
        cut = clean.select("src", "row_key", F.explode("pairs").alias("p")).select("src", "row_key", "p.*")
        kept = hyphen_rules(cut, vocabulary(self.texts))
        hyphens = cut.join(kept, ["a", "b"]).groupBy("src", "row_key").agg(F.collect_set(F.concat_ws("-", "a", "b")).alias("keep"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                fixed = [repair(t, dict(m) if m is not None else {}, frozenset(k) if k is not None else frozenset()) for t, m, k in zip(pdf["clean"], pdf["mend"], pdf["keep"])]
                yield pd.DataFrame({"src": pdf["src"], "row_key": pdf["row_key"], "text": pdf["text"], "repaired": fixed})

        return clean.drop("pairs").join(hyphens, ["src", "row_key"], "left").mapInPandas(run, "src string, row_key long, text string, repaired string")


def vocabulary(texts: DataFrame) -> DataFrame:
    """word, n of all words of the column t, compounds beside their parts, but for words cut at line ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush():
            words = list(c.items())
            c.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                low = _SPLIT.sub(" ", clean_form(t)).lower()
                c.update(_WORDS.findall(low))
                if "-" in low:
                    c.update(_COMPOUND.findall(low))
            if len(c) > 300_000:
                yield flush()
        yield flush()

    return texts.select("t").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hyphen_rules(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """a, b of the words cut at line ends whose hyphen stays, by the whole corpus.

    The spelling that the corpus has more often is taken; where it has neither, two words of their own keep
    their hyphen.
    """
    rows = pairs.select("a", "b").distinct().withColumn("ab", F.concat("a", "b")).withColumn("h", F.concat_ws("-", "a", "b"))
    for key in ("a", "b", "ab", "h"):
        rows = rows.join(words.select(F.col("word").alias(key), F.col("n").alias(f"{key}_n")), key, "left").fillna(0, [f"{key}_n"])
    return rows.filter((F.col("h_n") > F.col("ab_n")) | ((F.col("ab_n") == 0) & (F.col("a_n") > 0) & (F.col("b_n") > 0))).select("a", "b")


_SPLIT = re.compile(r"([^\W\d_]+)[%s][ \t]*\n\s*([^\W\d_]+)" % HYPHENS)
_END = re.compile(r"[.!?:;|]$")
_WORDS = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")


def without_lines(text: str, drop) -> str:
    """The text in its clean form without the lines that are noise."""
    gone = set(drop) if drop is not None else set()
    return clean_form("\n".join(line for line in text.split("\n") if line.strip() not in gone))


def broken_words(text: str) -> set[tuple[str, str]]:
    """Both halves of the words cut at line ends, in lower case."""
    return {(m[1].lower(), m[2].lower()) for m in _SPLIT.finditer(text)}


def repair(t: str, mend: dict[str, str], keep: frozenset[str]) -> str:
    """A text without noise lines made continuous. keep: cut words, in lower case, whose hyphen stays."""

    def join(m: re.Match) -> str:
        a, b = m[1], m[2]
        return f"{a}-{b}" if f"{a}-{b}".lower() in keep else a + b

    t = _SPLIT.sub(join, t)
    if mend:
        def fix(m: re.Match) -> str:
            w = m.group()
            r = mend.get(w.lower())
            return w if r is None else r.upper() if w.isupper() else r.capitalize() if w[:1].isupper() else r

        t = _TOKEN.sub(fix, t)
    out: list[str] = []
    for part in re.split(r"\n\s*\n", t):
        body = ""
        for line in part.split("\n"):
            line = line.strip()
            if not line:
                continue
            keep = "|" in line or line.startswith(("- ", "• ", "* "))
            body += ("\n" if keep and body else " " if body else "") + line
        if body:
            out.append(re.sub(r"[ \t]+", " ", body))
    # A paragraph cut between blocks goes on where the next begins in lower case.
    merged: list[str] = []
    for p in out:
        if merged and p[:1].islower() and not _END.search(merged[-1]):
            merged[-1] = _SPLIT.sub(join, merged[-1] + "\n" + p) if merged[-1][-1:] in HYPHENS else merged[-1] + " " + p
        else:
            merged.append(p)
    return "\n\n".join(merged)
