"""Text that went through a wrong character decoding: find it and give the right text back.

Method: for every pair (true encoding, wrongly assumed encoding) the garbled sequence of each source
character is computed beforehand. One multi-pattern automaton finds all sequences in a single pass and
only matched spans are replaced, so right text beside them stays as it is.

* Several bytes per character (UTF-8 read as any of 14 code pages, the Western ones also twice): a sequence
  of a Latin, Greek or punctuation character is proof and is replaced wherever it stands. Sequences that may
  be right (``É”``, Cyrillic letters) count in runs. A run is left alone unless all of it decodes; where
  pages differ in what a sequence stood for, the page that explains most of the text decides.
* One byte per character (cp1252 read as cp850, Mac Roman read as cp1252, ...): a single character proves
  nothing (``Ž`` may be right), so the automaton's hits are judged by word: the word as it stands must break
  Portuguese spelling (a symbol or a capital inside a lower-case word, a letter foreign to the language)
  and must become regular when the pair is undone. Single letters between blanks that are no words, and signs
  where only an ordinal sign can stand, count likewise. The pair with most such marks in the text is undone.
* U+FFFD and C1 control characters are always marks; what U+FFFD replaced is lost and is left in place.

Defined cases: null, empty and blank texts give ``found = false`` and keep their value; texts of any length
are processed whole; repeated rows give one row in ``found_rows``; extra columns do not matter.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code pages by their public names, the likelier first.
PAGES = ("cp1252", "latin-1", "cp850", "mac_roman", "cp1250", "cp437", "cp1251", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "cp860", "cp866", "koi8_r")
HOLD_PORTUGUESE = ("cp1252", "mac_roman", "cp850", "cp860")
CYRILLIC_PAGES = ("cp1251", "cp866", "koi8_r")
#: Mix-ups of one-byte pages met most; any other pair needs LEAST_VOTES and a clear lead.
LIKELY = (
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp850", "latin-1"), ("mac_roman", "latin-1"),
)
LEAST_VOTES = 3
PT_LOW, PT_UP = "áàâãéêíóôõúüç", "ÁÀÂÃÉÊÍÓÔÕÚÜÇ"
PT = PT_LOW + PT_UP
OTHER_SOURCE = "ñÑ¿¡ªº°§£€–—“”‘’…•·±²³½¼µ×÷≥≤→™©®«»"
#: Source characters whose sequences are proof wherever they stand: Latin, Greek, marks, punctuation, some signs.
SURE = ((0xA0, 0x17F), (0x300, 0x33F), (0x391, 0x3C9), (0x2010, 0x2026), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265))
#: All other sources; their two-character sequences (``É”``) may be right and count in runs of two or more.
WIDE = ((0x180, 0x2FF), (0x370, 0x5FF), (0x1E00, 0x200F), (0x2027, 0x27BF), (0x3000, 0x30FF))
#: Sources of which only the reading as the two Western pages is laid out, to bound the automaton: ideographs, syllables, wide forms, pictures.
FAR = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))
QUOTES = "“”‘’–—…•‹›«»"


def _decode(data: bytes, page: str) -> str:
    """Bytes that a page leaves undefined come out as C1 controls, as lenient decoders do."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _chars(ranges) -> list[str]:
    return [chr(c) for lo, hi in ranges for c in range(lo, hi + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]


@lru_cache(maxsize=1)
def tables():
    """(sure sequences, their lower case, wide sequences, {pair: {garbled char: source char}}, {sequence: {source char: bits of the pages}}).

    The first three map to the likeliest source character.
    """
    maps = {p: [_decode(bytes([b]), p) for b in range(256)] for p in PAGES}
    read = lambda c, p: "".join(maps[p][b] for b in c.encode())
    many: dict[str, str] = {}
    lower: dict[str, str] = {}
    wide: dict[str, str] = {}
    told: dict[str, dict[str, int]] = {}

    def add(into: dict[str, str], g: str, c: str, page: int) -> None:
        if len(g) > 1 and g != c:
            into.setdefault(g, c)
            told.setdefault(g, {})
            told[g][c] = told[g].get(c, 0) | 1 << page

    sure = _chars(SURE)
    for i, p in enumerate(PAGES):
        for c in sure:
            # A Cyrillic letter before another may be right.
            add(wide if p in CYRILLIC_PAGES else many, read(c, p), c, i)
    for c in sure:
        for p in ("cp1252", "latin-1"):
            add(many, "".join(maps["cp1252"][b] for b in read(c, p).encode()), c, len(PAGES))
    for i, p in enumerate(PAGES):
        for c in _chars(WIDE):
            add(wide, read(c, p), c, i)
    for i, p in enumerate(PAGES[:2]):
        for c in _chars(FAR):
            add(wide, read(c, p), c, i)
    wide = {g: c for g, c in wide.items() if g not in many}
    for g, c in many.items():
        if (low := g.lower()) != g and low not in many:
            lower.setdefault(low, c.lower())
    single = {}
    for true, p in LIKELY + tuple((t, p) for t in HOLD_PORTUGUESE for p in PAGES if p != t):
        m = {}
        for c in PT + OTHER_SOURCE:
            try:
                b = c.encode(true)
            except UnicodeEncodeError:
                continue
            if len(b) == 1 and (g := maps[p][b[0]]) != c:
                m[g] = c
        if m and not any(m == x for x in single.values()):
            single[true, p] = m
    return many, lower, {g: c for g, c in wide.items() if g not in lower}, single, {g: m for g, m in told.items() if g in many or g not in lower}


SURE_KIND, LOW_KIND, WIDE_KIND, ONE_KIND = range(4)


@lru_cache(maxsize=1)
def machine():
    many, lower, wide, single, _ = tables()
    a = ahocorasick.Automaton()
    for kind, m in ((WIDE_KIND, wide), (LOW_KIND, lower), (SURE_KIND, many)):
        for g, c in m.items():
            a.add_word(g, (g, c, kind))
    for g in {g for m in single.values() for g in m} | {"\ufffd"} | {chr(c) for c in range(0x80, 0xA0)}:
        if g not in a:
            a.add_word(g, (g, None, ONE_KIND))
    a.make_automaton()
    return a


# A ¬ at the end of a line is a hyphen sign of scanned pages, whatever surrounds it.
PIECE = regex.compile(r"(?:¬(?![ \t]*(?:\n|$))|[\p{L}\p{M}[\p{S}--¬]\x80-\x9f‚„†‡ˆ‰‹›·¡¿«»…”’“‘–—§¶ªº\u00a0¼½¾¹²³])+", regex.V1)
MARKS = regex.compile(r"[\u0300-\u036f]")
BOX = regex.compile(r"[\u2500-\u259f]")
LOWER_OF_PT = set(PT_LOW) | set("abcdefghijklmnopqrstuvwxyz")
UPPER_OF_PT = set(PT_UP) | set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
# Signs that rightly stand at a word's end or beside it.
BESIDE = set("™®©°ºª²³¹…”’“‘—–»«¿¡§$€£±×÷≥≤→=+<>|~^`½¼µ ")
_BESIDE = "".join(BESIDE)


def _regular(word: str) -> bool:
    """Portuguese letters only, in one of the three usual forms of case."""
    return (all(c in LOWER_OF_PT for c in word[1:]) and (word[:1] in LOWER_OF_PT or word[:1] in UPPER_OF_PT)) or all(c in UPPER_OF_PT for c in word)


def _odd(word: str, g: set[str]) -> bool:
    """A strong mark: one of the pair's characters stands where Portuguese never has it."""
    core = word.strip(_BESIDE)
    if not core:
        return False
    if any(0x80 <= ord(c) < 0xA0 for c in core):
        return True
    letters = [c for c in core if c.isalpha()]
    lows = sum(c.islower() for c in letters if c not in g)
    ups = sum(c.isupper() for c in letters if c not in g)
    for i, c in enumerate(core):
        if c not in g:
            continue
        left, right = core[i - 1] if i else "", core[i + 1] if i + 1 < len(core) else ""
        if c.upper() == c.lower():
            inside = any(map(str.isalpha, core[:i])) and any(map(str.isalpha, core[i + 1 :]))
            if (inside and not (c in "’‘–" and left.isalpha() and right.isalpha() and not (i > 2 and left.isupper() and right.isupper()))) or (c not in BESIDE and (left.isalpha() or right.isalpha())):
                return True
        elif c.isupper() and i and (left.islower() or right.islower()):
            return True
        elif c.islower() and c not in LOWER_OF_PT and lows + ups >= 1 and (c in "þßıøðæœłžšýÿ" or unicodedata.name(c, "").startswith("CYRILLIC")):
            return True
        elif c.islower() and ups >= 2 and not lows:
            return True
        elif c.isupper() and c not in UPPER_OF_PT and lows + ups >= 1 and i and not lows:
            return True
    return False


@lru_cache(maxsize=1)
def pairs_of():
    """(inverse maps, {garbled character: numbers of the maps that hold it})."""
    maps = list(tables()[3].values())
    holders: dict[str, list[int]] = {}
    for i, m in enumerate(maps):
        for g in m:
            holders.setdefault(g, []).append(i)
    return maps, holders


@lru_cache(maxsize=200_000)
def _word_votes(piece: str) -> tuple[tuple[int, float], ...]:
    """The pairs under which the piece is odd as it stands and regular when undone, with their votes.

    A letter of other Latin alphabets is odd by half only: one such word may be a name.
    """
    maps, holders = pairs_of()
    out = []
    for i in sorted({i for c in piece for i in holders.get(c, ())}):
        m = maps[i]
        odd = _odd(piece, m.keys())
        if odd or any("\u0100" <= c <= "\u017f" and c in m for c in piece):
            back = "".join(m.get(c, c) for c in piece).strip(_BESIDE)
            if back and _regular(back):
                out.append((i, 1.0 if odd else 0.5))
    return tuple(out)


# A single letter between blanks that is no word, where a sign may stand; the signs that may.
LONE = regex.compile(r"(?<!\S)[^\W\d_a-zA-Z](?!\S)")
LONE_WORDS = {"à", "às", "é", "À", "É", "ó", "Ó", "è", "È", "ò", "ì", "ù", "í", "ê", "ô", "â", "ã", "õ", "ú"}
UNDONE_WORDS = {"à", "às", "é", "À", "É"}
LONE_SIGNS = set("–—·•→§")
# A sign glued to an abbreviation's stop or to a number, where an ordinal sign may stand.
GLUED = regex.compile(r"(?<=\p{L}\.)[^\w\s\x00-\x7f]|(?<=\d)[\p{Sm}\p{So}--©®°×÷±](?!\w)|(?<=\p{L}\.|§ ?\d{1,3})[¼½¾¹²³]", regex.V1)
ORDINALS = set("ºª°")


def _capital_inside(text: str, at: int) -> bool:
    """A capital between blanks that neither opens a sentence nor stands among capitals."""
    before, after = text[max(0, at - 40) : at].rstrip(" "), text[at + 1 : at + 40].lstrip(" ")
    if not before or not (after[:1].isupper() or after[:1].isdigit()) or before[-1] in "\n.:;!?-–—\"“”»)" or after[0] == "\n":
        return False
    near = [w for w in (before.split()[-1], after.split()[0]) if any(map(str.isalpha, w))]
    return not any(w.isupper() for w in near)


def _lone_marks(text: str):
    """(start, character) of letters and signs that stand where Portuguese has none of them."""
    for m in LONE.finditer(text):
        if (c := m.group()) not in LONE_WORDS or (c == "À" and _capital_inside(text, m.start())):
            yield m.start(), c, LONE_SIGNS
    for m in GLUED.finditer(text):
        if m.group() not in ORDINALS:
            yield m.start(), m.group(), ORDINALS


def _one_byte(text: str, likely_only: bool = False):
    """The inverse map that most words and lone marks of the text ask for, or None."""
    maps, holders = pairs_of()
    votes: dict[int, float] = {}
    for p in PIECE.findall(text):
        if not p.isascii():
            for i, n in _word_votes(p):
                votes[i] = votes.get(i, 0) + n
    for _, c, signs in _lone_marks(text):
        for i in holders.get(c, ()):
            if maps[i][c] in signs:
                votes[i] = votes.get(i, 0) + 1
    votes = {i: n for i, n in votes.items() if n >= (1 if i < len(LIKELY) else LEAST_VOTES)}
    likely = min((i for i in votes if i < len(LIKELY)), key=lambda i: (-votes[i], i), default=None)
    other = min((i for i in votes if i >= len(LIKELY)), key=lambda i: (-votes[i], i), default=None)
    if other is not None and not likely_only and votes[other] > 1.25 * votes.get(likely, 0):
        return maps[other]
    return None if likely is None else maps[likely]


def _undo_pair(text: str, m: dict[str, str]) -> str:
    g = m.keys()

    marks = {at: m[c] for at, c, signs in _lone_marks(text) if m.get(c) in signs}

    def fix(match) -> str:
        p = match.group()
        if g.isdisjoint(p):
            return p
        if marks and any(i in marks for i in range(*match.span())):
            return "".join(marks.get(i, c) for i, c in enumerate(p, match.start()))
        if p in ORDINALS and text[match.start() - 1 : match.start()].isdigit():
            return p
        back = "".join(m.get(c, c) for c in p)
        core, before = back.strip(_BESIDE), p.strip(_BESIDE)
        if before and (_odd(p, g) or (core and _regular(core) and not _regular(before))):
            return back
        return back if back in UNDONE_WORDS or back in ORDINALS or not any(map(str.isalpha, back)) else p

    return PIECE.sub(fix, text)


RUN = regex.compile(r"[^\x00-\x7f]+")
#: What may rightly stand beside a garbled sequence; U+FFFD is what was lost.
RIGHT_BESIDE = set(PT + OTHER_SOURCE) - set("¡¿") | {"\ufffd", "\u00ad"}


def _proof(text: str, start: int, end: int, g: str, kind: int) -> bool:
    """Whether a sure sequence or its lower case counts where it stands: letters before quotes may be right."""
    before, after = text[start - 1 : start], text[end : end + 1]
    low = kind == LOW_KIND
    if g[-1] in QUOTES and len(g) == 2 and ((low and not (after.isalpha() and (before.isalpha() or not before))) or before in ("“", "‘", "«", "'", '"') or (before.islower() and g[0].islower() and not after.isalpha())):
        return False
    return not (low and len(g) == 2 and g[-1].isspace() and not before.isspace())


def _sequences(text: str) -> tuple[bool, bool, bool, str]:
    """(found, has one-byte candidates, has characters that are always marks, text with whole runs decoded)."""
    hits, singles, lone = [], False, False
    for last, (g, c, kind) in machine().iter_long(text):
        if kind == ONE_KIND:
            singles = True
            lone = lone or g == "\ufffd" or 0x80 <= ord(g) < 0xA0
        elif kind == WIDE_KIND or _proof(text, last + 1 - len(g), last + 1, g, kind):
            hits.append((last + 1 - len(g), last + 1, c, kind, g))
        else:
            singles = True
    if not hits:
        return False, singles, lone, text
    told = tables()[4]
    if any(len(told.get(h[4], ())) > 1 for h in hits):
        # Pages differ in what a sequence stood for: the page that explains most of the text decides.
        explains = [0] * (len(PAGES) + 1)
        for h in hits:
            bits = 0
            for b in told.get(h[4], {}).values():
                bits |= b
            for i in range(len(explains)):
                explains[i] += bits >> i & 1
        page = max(range(len(explains)), key=lambda i: (explains[i], -i))
        hits = [(*h[:2], next((c for c, b in told.get(h[4], {}).items() if b >> page & 1), h[2]), *h[3:]) for h in hits]
    found, out, at, k = False, [], 0, 0
    for run in RUN.finditer(text):
        lo, hi = run.span()
        # A sequence may begin or end with an ASCII character in one-byte pages, never in these.
        own = []
        while k < len(hits) and hits[k][0] < hi:
            own.append(hits[k])
            k += 1
        if not own:
            continue
        left, pos = [], lo
        for a, b, *_ in own:
            left += text[pos:a]
            pos = max(pos, b)
        left += text[pos:hi]
        whole = not left
        wide = [h for h in own if h[3] == WIDE_KIND]
        sure = [h for h in own if h[3] != WIDE_KIND]
        if wide:
            beside = (text[lo - 1 : lo] + text[hi : hi + 1]).strip()
            strong = whole and (len(own) > 1 or wide[0][1] - wide[0][0] > 2 or (bool(beside) and beside.isalpha() and _latin(wide[0][2])))
            if not strong:
                singles = True
                own = sure if all(c in RIGHT_BESIDE for c in left) and sure else []
        if not own:
            found = found or bool(sure)
            continue
        found = True
        # Left alone unless all of it decodes; of a two-character sequence the second may be lost.
        halves = {h[4][0] for h in own if len(h[4]) == 2}
        if not all(c in RIGHT_BESIDE or c in halves for c in left):
            continue
        for a, b, c, *_ in own:
            out += [text[at:a], c]
            at = b
    return found, singles, lone, "".join(out) + text[at:] if out else text


def _latin(c: str) -> bool:
    return ord(c) < 0x180


def examine(text: str | None) -> tuple[bool, str | None]:
    """(has marks of a wrong decoding, text with the determined spans restored)."""
    if not text or text.isascii():
        return False, text
    found = lone = singles = False
    if MARKS.search(text):  # decomposed after the wrong decoding
        text = unicodedata.normalize("NFC", text)
    for _ in range(3):
        hit, one, always, made = _sequences(text)
        singles, lone, found = singles or one, lone or always, found or hit
        if made == text:
            break
        text = made
    if singles or lone:
        m = _one_byte(text, likely_only=found)  # what is left of sequences looks like rare pairs
        if m is not None:
            found, text = True, _undo_pair(text, m)
        elif not found and BOX.search(text) and regex.search(r"\w[\u2500-\u259f]|[\u2500-\u259f]\w", text):
            found = True
    return found or lone, text


COMMON = "\\x00-\\x7F" + "áàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ" + "ªº°–—“”"
TRIGGER = f"[^{COMMON}]|[a-záéíóúâêôãõç][ÁÀÂÃÉÊÍÓÔÕÚÇ]|[áàâãéêíóôõúç][A-Z]{{2}}|[A-Z]{{2}}[áàâãéêíóôõúç]|[a-zA-Z][–—“”°][a-zA-Z]|(?<!\\S)[áçÁÀÂÃÊÍÔÕÚÇ](?!\\S)|[áàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ][ªº°]|[ÃÂáàâãéêíóôõúç][ªº°–—“”]"


def triggered(text: Column) -> Column:
    """JVM-side test that every garbled text passes and most right texts do not."""
    return text.rlike(TRIGGER)


RESULT = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("text", T.StringType())])


@F.pandas_udf(RESULT)
def examine_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [examine(t) for t in texts]
    return pd.DataFrame({"found": [r[0] for r in rows], "text": [r[1] for r in rows]})


def garbled(df: DataFrame, key: str, text: str = "text", src: str = "") -> DataFrame:
    """src, row_key, text, restored of the rows that hold marks. Only triggered rows go to Python."""
    picked = df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("row_key"), F.col(text).alias("text")).filter(F.col("row_key").isNotNull() & triggered(F.col("text")))
    seen = picked.withColumn("x", examine_udf("text"))
    return seen.filter("x.found").select("src", "row_key", "text", F.col("x.text").alias("restored"))


def found_rows(df: DataFrame, key: str, text: str = "text", src: str = "") -> DataFrame:
    """One (src, row_key) for each affected key; re-delivered rows count once."""
    return garbled(df, key, text, src).select("src", "row_key").distinct()
