"""Message rows put together into ordered conversations; defective ones are told.

A conversation may hold a third of all rows, so none is gathered in one task: rows are range-partitioned and
sorted by (conversation, time, message id), every partition reduces its run of a conversation to one small
summary, and the summaries of a conversation (at most one a partition) are folded in order. The summary is a
monoid: it also tells what the run looks like without its first message, for the case that this message
repeats the last one of the run before.

Defined cases: null or blank roles name nobody (``broken``); null content counts as blank; blanks include
no-break and zero-width spaces; re-delivered rows (same message id) count once; rows without conversation id
are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.session import settle

# Spellings of the roles.
USER = ("user", "usuario", "usuário", "human", "humano", "cliente")
ASSISTANT = ("assistant", "assistente", "ai", "ia", "bot")
SYSTEM = ("system", "sistema")
BLANKS = r"[\s\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"
BINS = 128  # of the gap histogram, four to each doubling of milliseconds

SUMMARY = T.StructType([
    T.StructField("conversation_id", T.StringType()), T.StructField("pid", T.IntegerType()),
    T.StructField("rows", T.LongType()), T.StructField("content", T.BooleanType()), T.StructField("bad", T.BooleanType()),
    T.StructField("first_role", T.StringType()), T.StructField("first_text", T.StringType()),
    T.StructField("last_role", T.StringType()), T.StructField("last_text", T.StringType()),
    T.StructField("first_ms", T.LongType()), T.StructField("last_ms", T.LongType()),
    T.StructField("whole", T.ArrayType(T.BooleanType())), T.StructField("rest", T.ArrayType(T.BooleanType())),
    T.StructField("gaps", T.ArrayType(T.LongType())),
])


def speaker(role: Column) -> Column:
    """u, a or s; '?' for anything that names none of them."""
    name = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), BLANKS, ""))
    return F.when(name.isin(*USER), "u").when(name.isin(*ASSISTANT), "a").when(name.isin(*SYSTEM), "s").otherwise("?")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}|{BLANKS}$", "")


ORDER = ["conversation_id", "us", "message_id"]


def readable(messages: DataFrame) -> DataFrame:
    """conversation_id, message_id, who, said, us of the rows with a conversation."""
    return messages.filter(F.col("conversation_id").isNotNull()).select(
        "conversation_id", "message_id", speaker(F.col("role")).alias("who"), trimmed(F.col("content")).alias("said"),
        (F.unix_micros(F.col("created_at").cast("timestamp"))).alias("us"),
    )


def in_ranges(rows: DataFrame) -> DataFrame:
    """Rows in conversation order, cut into ranges of similar size whatever a conversation holds."""
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pid", F.spark_partition_id())


def ordered(messages: DataFrame) -> DataFrame:
    return in_ranges(readable(messages))


class Run:
    """The state of user messages and answers over a stretch: [answer before the first user message, has a user message, an earlier one stayed without reply, the last one is open]."""

    __slots__ = ("lead", "user", "lost", "open")

    def __init__(self, lead=False, user=False, lost=False, open=False):
        self.lead, self.user, self.lost, self.open = map(bool, (lead, user, lost, open))

    def take(self, who: str, blank: bool) -> None:
        if who == "u":
            self.lost |= self.open
            self.user = self.open = True
        elif who == "a" and not blank:
            self.lead |= not self.user
            self.open = False

    def then(self, other: Run) -> Run:
        open_ = self.open and not other.lead
        return Run(self.lead or (not self.user and other.lead), self.user or other.user, self.lost or other.lost or (open_ and other.user), other.open or (open_ and not other.user))

    def list(self) -> list[bool]:
        return [self.lead, self.user, self.lost, self.open]


class Part:
    """The growing summary of one conversation in one partition."""

    def __init__(self, cid, pid):
        self.cid, self.pid, self.n, self.content, self.bad = cid, pid, 0, False, False
        self.first = self.last = (None, None)
        self.t0 = self.t1 = None
        self.whole, self.rest = Run(), Run()
        self.gaps = np.zeros(BINS, dtype=np.int64)

    def take(self, who, said, us) -> None:
        if who == "s":
            return
        self.n += 1
        self.content |= bool(said)
        self.bad |= who == "?" or us is None
        if self.n == 1:
            self.first = (who, said)
        if us is not None:
            if self.t1 is not None:
                self.gaps[gap_bin(us - self.t1)] += 1
            self.t0 = us if self.t0 is None else self.t0
            self.t1 = us
        if (who, said) != self.last:
            self.whole.take(who, not said)
            if self.n > 1:
                self.rest.take(who, not said)
        self.last = (who, said)

    def row(self):
        return (self.cid, self.pid, self.n, self.content, self.bad, *self.first, *self.last, self.t0, self.t1, self.whole.list(), self.rest.list(), self.gaps.tolist() if self.gaps.any() else [])


def gap_bin(us: int) -> int:
    return min(BINS - 1, int(4 * np.log2(max(us, 0) / 1000 + 1)))


def gap_of_bin(b: int) -> int:
    """Upper end of the bin, in microseconds."""
    return int((2 ** ((b + 1) / 4) - 1) * 1000)


def summaries(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, names = None, None, [f.name for f in SUMMARY]
        for pdf in batches:
            out = []
            for cid, mid, who, said, us, pid in zip(pdf["conversation_id"], pdf["message_id"], pdf["who"], pdf["said"], pdf["us"], pdf["pid"]):
                us = None if us is None or us != us else int(us)
                if now is None or now.cid != cid:
                    if now is not None:
                        out.append(now.row())
                    now, seen = Part(cid, int(pid)), None
                if mid is not None and mid == mid and mid == seen:
                    continue
                seen = mid
                now.take(who, said, us)
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=names)

    return rows.select("conversation_id", "message_id", "who", "said", "us", "pid").mapInPandas(run, SUMMARY)


def verdict(parts) -> tuple[str | None, int]:
    """Folds the ordered summaries of one conversation. (defect or None, messages)"""
    n, content, bad, first, last, whole = 0, False, False, None, (None, None), Run()
    for p in parts:
        if not p["rows"]:
            continue
        again = n and (p["first_role"], p["first_text"]) == last
        whole = whole.then(Run(*(p["rest"] if again else p["whole"])))
        first = first or p["first_role"]
        n, content, bad, last = n + p["rows"], content or p["content"], bad or p["bad"], (p["last_role"], p["last_text"])
    if not content:
        return "empty", n
    if bad or first != "u":
        return "broken", n
    return ("no_reply" if whole.lost or whole.open else None), n


def judged(messages: DataFrame) -> DataFrame:
    """conversation_id, defect (null for good ones), messages."""
    return judge(summaries(ordered(messages)))


def judge(found: DataFrame) -> DataFrame:
    fields = [f.name for f in SUMMARY if f.name not in ("conversation_id", "gaps")]
    parts = found.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [verdict(p) for p in pdf["parts"]]
            yield pd.DataFrame({"conversation_id": pdf["conversation_id"], "defect": [x[0] for x in v], "messages": [x[1] for x in v]})

    return parts.mapInPandas(fold, "conversation_id string, defect string, messages long")


def defects(messages: DataFrame) -> DataFrame:
    return judged(messages).filter("defect is not null").select("conversation_id", "defect")


def calibrated_gap(found: DataFrame, share: float = 0.99, factor: float = 4.0) -> int:
    """Microseconds of silence that end a session: a multiple of the gap that a share of all gaps stays under."""
    sums = [F.sum(F.get("gaps", F.lit(i))).alias(str(i)) for i in range(BINS)]
    row = found.filter(F.size("gaps") > 0).agg(*sums).first()
    counts = np.array([row[i] or 0 for i in range(BINS)])
    if not counts.sum():
        return 0
    return int(factor * gap_of_bin(int(np.searchsorted(np.cumsum(counts), share * counts.sum()))))


def _mark(who, said) -> int:
    """A message's speaker and words as 64 bits."""
    return xxhash.xxh64_intdigest(f"{who}\0{said}") - (1 << 63)


def _starts(found: DataFrame) -> DataFrame:
    """pid, conversation_id, mark and time of the message before, for every partition that continues a conversation."""
    fields = ["pid", "rows", "last_role", "last_text", "last_ms"]
    parts = found.filter("rows > 0").select("conversation_id", F.struct(*fields).alias("p"))
    crossing = parts.groupBy("conversation_id").agg(F.sort_array(F.collect_list("p")).alias("p")).filter(F.size("p") > 1)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cid, ps in zip(pdf["conversation_id"], pdf["p"]):
                us = None
                for before, now in zip(ps, ps[1:]):
                    us = before["last_ms"] if before["last_ms"] is not None else us
                    out.append((int(now["pid"]), cid, _mark(before["last_role"], before["last_text"]), us))
            yield pd.DataFrame(out, columns=["pid", "conversation_id", "mark", "us"]).astype({"us": "Int64"})

    return crossing.mapInPandas(chain, "pid int, conversation_id string, mark long, us long")


def rebuild(messages: DataFrame, gap_us: int | None = None) -> DataFrame:
    """The good conversations: conversation_id, session_no, turn_no, role, content, message_id, created_us.

    Repeats are dropped first, also where the first copy ended the partition before; turn_no counts what is kept
    of a conversation. Silences over the gap cut it into sessions, and a session without a user message that is
    answered (by words, later in it) is dropped; its numbers stay free.

    What a partition needs to know of the one before (the last message's mark and time, the number of turns and
    sessions so far) is one row for each partition that continues a conversation. These rows are broadcast:
    there are fewer of them than partitions, all of which the driver tracks anyway.
    """
    spark = messages.sparkSession
    rows = settle(in_ranges(readable(messages).filter("who <> 's'").dropDuplicates(ORDER)))
    found = settle(summaries(rows))
    gap = calibrated_gap(found) if gap_us is None else gap_us
    before_of = {r["pid"]: (r["conversation_id"], r["mark"], r["us"]) for r in _starts(found).collect()}
    held = spark.sparkContext.broadcast(before_of)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cid = before = told = None
        n = s = 0
        fresh = True
        for pdf in batches:
            turns, sessions, keep = [], [], []
            for c, who, said, us, pid in zip(pdf["conversation_id"], pdf["who"], pdf["said"], pdf["us"], pdf["pid"]):
                if c != cid:
                    cid, n, s, before, told = c, 0, 0, None, None
                    if fresh and (start := held.value.get(int(pid))) is not None and start[0] == c:
                        told, before = start[1], start[2]
                    fresh = False
                us = None if us is None or us != us else int(us)
                if before is not None and us is not None and gap and us - before > gap:
                    s += 1
                mark = _mark(who, said)
                again = told == mark
                told, before = mark, us if us is not None else before
                turns.append(n)
                sessions.append(s)
                keep.append(not again)
                n += not again
            yield pdf.assign(turn=turns, session=sessions)[keep]

    schema = T.StructType([*rows.schema.fields, T.StructField("turn", T.LongType()), T.StructField("session", T.LongType())])
    good = judge(found).filter("defect is null").select("conversation_id")
    local = settle(rows.mapInPandas(number, schema).join(good, "conversation_id", "left_semi"))
    ends = local.groupBy("conversation_id", "pid").agg(F.count("*").alias("t"), F.max("session").alias("s"))
    parts = ends.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("pid", "t", "s"))).alias("p")).filter(F.size("p") > 1)
    earlier = F.slice("p", F.lit(1), F.col("i"))
    edges = parts.select("conversation_id", "p", F.posexplode("p").alias("i", "x")).select(
        "conversation_id", F.col("x.pid").alias("pid"),
        F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x["t"]).alias("turns"),
        F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("sessions"),
    ).filter("turns > 0")
    placed = local.join(F.broadcast(edges), ["conversation_id", "pid"], "left").select(
        "conversation_id", (F.col("session") + F.coalesce("sessions", F.lit(0))).alias("session_no"), (F.col("turn") + F.coalesce("turns", F.lit(0))).alias("turn_no"),
        F.when(F.col("who") == "u", "user").otherwise("assistant").alias("role"), F.col("said").alias("content"), "message_id", F.col("us").alias("created_us"),
    )
    # A session is answered if its first user message stands before its last answer.
    answer = (F.col("role") == "assistant") & (F.col("content") != "")
    sessions = placed.groupBy("conversation_id", "session_no").agg(F.min(F.when(F.col("role") == "user", F.col("turn_no"))).alias("asked"), F.max(F.when(answer, F.col("turn_no"))).alias("answered"))
    idle = sessions.filter(F.coalesce(F.col("answered") < F.col("asked"), F.lit(True))).select("conversation_id", "session_no")
    return placed.join(idle, ["conversation_id", "session_no"], "left_anti")
