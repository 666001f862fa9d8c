import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.llm import conversations as C
from garimpo.llm import garbled as G
from garimpo.llm import splitting as S
from garimpo.llm import tokens as K

RIGHT = "Não há exceção prevista: a coordenação poderá exigir avaliação clínica às unidades."


@pytest.mark.parametrize("true,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252")])
def test_garbled_round_trip(true, read):
    bad = G._decode(RIGHT.encode(true), read)
    assert G.examine(bad) == (True, RIGHT)
    mixed = RIGHT + " " + bad
    assert G.examine(mixed) == (True, RIGHT + " " + RIGHT)


def test_garbled_twice_and_lost():
    assert G.examine(G._decode(G._decode(RIGHT.encode(), "cp1252").encode(), "cp1252")) == (True, RIGHT)
    assert G.examine("n�o pode")[0]


@pytest.mark.parametrize("text", [None, "", " ", RIGHT, "Crème brûlée, façade e Müller.", "Marca Žilavka™ © item Øst – versão “β”.", "MAÇÃ, LÃ E IRMÃ constam do ÂMBITO", "Tarifa de £ 12 ou € 15", "Fórmula: x ≥ 3 × y ÷ 2 → µ", "ÍNDICE “Ã” e a “maçã”…"])
def test_right_texts_stay(text):
    assert G.examine(text) == (False, text)


def test_garbled_rows(spark):
    bad = G._decode(RIGHT.encode(), "cp1252")
    rows = [(1, bad, "x"), (1, bad, "y"), (2, None, "x"), (3, "", None), (4, RIGHT, "x"), (None, bad, "x"), (5, "a" * 100_000 + bad, "x")]
    df = spark.createDataFrame(rows, "block_key long, text string, found string")
    assert sorted(r.row_key for r in G.found_rows(df, "block_key", src="s").collect()) == [1, 5]
    assert G.found_rows(df.limit(0), "block_key").count() == 0


PAIRS = [("utf-8", p) for p in G.PAGES] + [(t, p) for t in G.HOLD_PORTUGUESE for p in G.PAGES if p != t]


@pytest.mark.parametrize("true,read", [x for x in PAIRS if G._decode(RIGHT.encode(x[0]), x[1]) != RIGHT])
def test_every_pair_of_pages(true, read):
    """All garbled texts pass the filter and are found, all but those that two pairs explain alike are restored."""
    import re

    bad = G._decode(RIGHT.encode(true), read)
    found, text = G.examine(bad)
    if (true, read) not in {("cp860", "cp850"), ("cp860", "cp437")}:  # ã comes out as ä, as in German names
        assert found and re.search(G.TRIGGER.replace("\\\\", "\\"), bad)
    if true == "utf-8" and read != "iso8859-2" or (true, read) in set(G.LIKELY) - {("cp1252", "cp437")}:
        assert text == RIGHT


@pytest.mark.parametrize("page", G.PAGES)
def test_run_that_does_not_decode_stays(page):
    text = "東京都は日本の首都である。"
    bad = G._decode(text.encode(), page)
    assert G.examine(bad)[1] in (bad, text)


@pytest.mark.parametrize("text", ["東京都は日本の首都である。", "Её ёж, Рёв, всё своё", "Україна її є ґрунт", "Ελληνικά κείμενα", "CAFÉ” e PÓ”, MÜ“x”", "vogal ã e letra ú", "Ver à página 3", "Dvořák e Brăila"])
def test_other_scripts_stay(text):
    assert G.examine(text) == (False, text)


def test_lone_marks():
    assert G.examine("Norma 12/2024 á Uso externo")[1] == "Norma 12/2024 · Uso externo"
    assert G.examine("Casa Clara Ð Central de dados")[1] == "Casa Clara – Central de dados"
    assert G.examine("Folha n.║ 10")[1] == "Folha n.º 10"


def _class(text, limit):
    import re

    fits = lambda p: max(map(len, re.split(p, text))) <= limit
    return "sentence" if fits(S.SENTENCE) else "word" if fits(S.WORD) else "char"


def test_cut_classes_and_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.é \n\t;x" + "cdef" * rng.randint(0, 40)) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += ["", None, " " * 300, "z" * 500, "a. " * 100, "ab\n" + "c" * 130, "😀" * 250]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "k long, text string")
    for range_chars in (7, 64, 4096):
        got = {r.row_key: r.cut_class for r in S.cut_classes(df, "k", limit=100, range_chars=range_chars).collect()}
        assert got == {k: _class(t, 100) for k, t in enumerate(texts) if t and len(t) > 100}
    made = {}
    for r in S.pieces(df, "k", limit=100, overlap=16, range_chars=150).orderBy("row_key", "piece_no").collect():
        made.setdefault(r.row_key, []).append(r)
    assert set(made) == {k for k, t in enumerate(texts) if t}
    for k, rows in made.items():
        t = texts[k]
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert rows[0].start == 0 and rows[-1].end == len(t)
        for r in rows:
            assert r.piece == t[r.start : r.end] and 0 < len(r.piece) <= 100
        for a, b in zip(rows, rows[1:]):
            assert a.end - b.start == min(16, a.end)
    with pytest.raises(ValueError):
        S.pieces(df, "k", limit=10, overlap=10)


def test_file_pieces(spark, tmp_path):
    rng = random.Random(5)
    text = "".join(rng.choice(["palavra ", "fim. ", "é\n", "ção", "longo" * 30]) for _ in range(3000))
    (tmp_path / "f.txt").write_text(text)
    (tmp_path / "g.txt").write_text("á" * 900)
    (tmp_path / "empty.txt").write_text("")
    paths = [str(tmp_path / f"{n}.txt") for n in ("f", "g", "empty")]
    got = S.file_pieces(spark, paths, limit=200, overlap=20, range_bytes=700).collect()
    for path in paths[:2]:
        raw = open(path, "rb").read()
        rows = sorted((r for r in got if r.path == path), key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert rows[0].start == 0 and max(r.end for r in rows) == len(raw)
        at = 0
        for r in rows:
            assert raw[r.start : r.end].decode() == r.piece and len(r.piece) <= 200 and r.start <= at
            at = r.end
    assert not [r for r in got if r.path == paths[2]]
    classes = {r.path: r.cut_class for r in S.file_class(spark, paths, limit=200, range_bytes=333).collect()}
    assert classes == {p: _class(open(p).read(), 200) for p in paths[:2]}


def _brute(rows):
    out = {}
    by = {}
    for cid, mid, role, content, at in {(r[0], r[1]): r for r in rows}.values():
        by.setdefault(cid, []).append((at is not None, at, mid, role, content))
    for cid, rs in by.items():
        names = {"user": "u", "USER ": "u", "assistant": "a", "bot": "a", "system": "s"}
        msgs = [(names.get(r, "?"), (c or "").replace(" ", " ").replace("​", " ").strip(), ok) for ok, _, _, r, c in sorted(rs, key=lambda x: (x[0], x[1] or 0, x[2]))]
        msgs = [m for m in msgs if m[0] != "s"]
        if not any(m[1] for m in msgs):
            out[cid] = "empty"
        elif any(m[0] == "?" or not m[2] for m in msgs) or msgs[0][0] != "u":
            out[cid] = "broken"
        else:
            kept = [m for i, m in enumerate(msgs) if not i or m[:2] != msgs[i - 1][:2]]
            waiting = False
            for who, said, _ in kept:
                if who == "u":
                    if waiting:
                        out[cid] = "no_reply"
                    waiting = True
                elif said:
                    waiting = False
            if waiting:
                out[cid] = "no_reply"
    return out


def test_conversations(spark):
    import datetime as dt

    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for mid in range(1500):
        cid = "hot" if rng.random() < 0.02 else f"c{rng.randint(0, 400)}"
        role = rng.choice(["user", "assistant", "USER ", "bot"] * 8 + ["system", None, "??"])
        rows.append((cid, mid, role, rng.choice(["a", "b", " a", " ", None, "c"]), None if rng.random() < 0.01 else t0 + dt.timedelta(minutes=rng.randint(0, 50))))
    for k in range(700):  # one large good conversation over many partitions
        rows.append(("good", 5000 + k, ["user", "assistant"][k % 2], f"m{k // 2}", t0 + dt.timedelta(seconds=k + (100_000 if k > 350 else 0))))
    rows += rng.sample(rows, 100)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conversation_id string, message_id long, role string, content string, created_at timestamp_ntz").withColumnsRenamed({}).repartition(6)
    assert {r.conversation_id: r.defect for r in C.defects(df).collect()} == _brute(rows)
    good = C.rebuild(df, gap_us=3_600_000_000).filter("conversation_id = 'good'").orderBy("turn_no").collect()
    assert [r.turn_no for r in good] == list(range(700)) and [r.message_id for r in good] == [5000 + k for k in range(700)]
    assert [r.session_no for r in good] == [int(k > 350) for k in range(700)]
    assert C.defects(df.limit(0)).count() == 0


def test_rebuild_repeats_and_sessions(spark):
    """Every message twice over many partitions, and sessions without an answer."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(400):
        for twice in range(2):
            rows.append(("big", 2 * k + twice, ["user", "assistant"][k % 2], f"m{k}", t0 + dt.timedelta(seconds=2 * k + twice)))
    day = dt.timedelta(days=1)
    for i, (role, said) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("assistant", "e"), ("user", "f"), ("assistant", "g")]):
        # The answer d comes a day after its question; e and g belong to their own sessions.
        rows.append(("cut", 9000 + i, role, said, t0 + day * (0, 0, 1, 2, 2, 3, 3)[i]))
    df = spark.createDataFrame(rows, "conversation_id string, message_id long, role string, content string, created_at timestamp_ntz").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.rebuild(df, gap_us=3_600_000_000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    big = sorted((r for r in got if r.conversation_id == "big"), key=lambda r: r.turn_no)
    assert [r.turn_no for r in big] == list(range(400)) and [r.content for r in big] == [f"m{k}" for k in range(400)]
    cut = [(r.session_no, r.turn_no, r.content) for r in got if r.conversation_id == "cut"]
    assert sorted(cut) == [(0, 0, "a"), (0, 1, "b"), (3, 5, "f"), (3, 6, "g")]


PIECES = ["é", " ", "  ", "\n", "'re", "'", "r", "e", "word", "123", "!!", "😀", "\t", "don't", "<|endoftext|>"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 30))
def test_joined_ids_equal_whole(parts, leaf):
    t = K.tokenizer()
    text = "".join(parts)
    nodes = [K.encode_piece(t, text[i : i + leaf]) for i in range(0, len(text), leaf)]
    while len(nodes) > 1:
        nodes = [K.join_pieces(t, *nodes[i : i + 2], window=4) if len(nodes[i : i + 2]) == 2 else nodes[i] for i in range(0, len(nodes), 2)]
    assert (nodes[0].ids.tolist() if nodes else []) == t.encode(text, add_special_tokens=False).ids


def test_encode_rows(spark):
    t = K.tokenizer()
    texts = [None, "", "  ", "abc", "Olá mundo " * 300, "x" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in K.encode(df, leaf=16).collect()}  # up to 313 leaves: several levels
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts)}
    assert K.encode(df.limit(0)).count() == 0
