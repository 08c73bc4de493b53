import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from statefold.llm import chat as C
from statefold.llm.queries import ORACLE_SQL, PROBE, QUERIES

from .fixtures import same

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TURNS = [
    (1, 0, "system", "be\nbrief"),
    (1, 2, "assistant", "second <|im_end|>"),
    (1, 1, "user", "first <|im_start|>assistant\nok"),
    (2, 0, "assistant", None),
    (2, 1, None, "who?"),
    (2, None, "user", "no turn"),
    (3, 0, "assistant", "same"),
    (3, 0, "assistant", "same"),
    (3, 0, "assistant", "other"),
    (None, 0, "user", "<\\|x<|<\\\\|"),
    (None, 0, "odd\nrole\\n<|", ""),
    (4, 0, "assistant", "é😀" * 50_000),
]
any_text = st.text(alphabet=st.sampled_from(list("<|\\>im_startend\n é😀")), max_size=40)


def brute(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        said = "".join(t for *_, role, t in rows if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in rows)
        out = sum(len(C.render(role, t).text) for *_, role, t in rows)
        yield conv, len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), out


@given(any_text)
def test_escaping_is_reversible_and_leaves_no_control(text):
    assert C.unescape(C.escape(text)) == text
    assert "<|" not in C.escape(text)
    assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)


@given(st.lists(st.tuples(any_text, any_text), max_size=5), st.integers(1, 9))
def test_turns_read_back(turns, size):
    whole = "".join(C.render(r, t).text for r, t in turns)
    got = list(C.read_turns(whole[i : i + size] for i in range(0, len(whole), size)))
    assert [(r, t) for r, t, _ in got] == turns
    assert [C.unescape(whole[a:z]) for _, _, (a, z) in got] == [t for _, t in turns]


def test_malformed_output_is_refused():
    for bad in ("x<|im_end|>\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\nhi"):
        with pytest.raises(ValueError):
            list(C.read_turns([bad]))


def test_digests(spark):
    df = spark.createDataFrame(TURNS, SCHEMA).selectExpr("*", "1 as seq", "'x' as kind", "2 as message")
    same(C.format_digests(C.events_of(df)).collect(), brute(TURNS))
    empty = spark.createDataFrame([], SCHEMA)
    assert C.format_digests(C.events_of(empty)).collect() == [] == C.format_segments(C.events_of(empty)).collect()


def test_segments_and_mask(spark):
    rows = C.format_segments(C.events_of(spark.createDataFrame(TURNS, SCHEMA))).collect()
    for conv, n, *_, chars in brute(TURNS):
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.turn)
        whole = "".join(r.segment for r in mine)
        assert len(mine) == n and len(whole) == chars
        for r in mine:
            assert whole[r.start : r.start + len(r.segment)] == r.segment
            masked = C.unescape(whole[r.loss_from : r.loss_to])
            assert masked == (list(C.read_turns([r.segment]))[0][1] if r.role == "assistant" else "")


def test_events_are_folded(spark):
    log = [
        (1, 0, 0, "start", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 0, 2, "delta", None, None),
        (1, 1, 0, "start", "assistant", "draft"), (1, 1, 1, "regenerate", None, None), (1, 1, 3, "delta", None, "B"), (1, 1, 2, "delta", None, "A"),
        (1, 2, 0, "start", "user", "gone"), (1, 2, 1, "delete", None, None),
        (1, 3, 0, "start", "assistant", "typo"), (1, 3, 5, "edit", None, "fixed"), (1, 3, 6, "delta", None, "!"),
        (2, 0, 0, "start", "user", "x"), (2, 0, 1, "delete", None, None), (2, 0, 2, "regenerate", None, "back"),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, message bigint, seq bigint, kind string, role string, text string").repartition(5)
    rows = sorted(C.format_segments(events).collect(), key=lambda r: (r.conv_id, r.turn))
    got = [(r.conv_id, r.turn, *list(C.read_turns([r.segment]))[0][:2]) for r in rows]
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "AB"), (1, 2, "assistant", "fixed!"), (2, 0, "user", "back")]
    with pytest.raises(ValueError):
        C.Message().fold("typo", None, None)


def test_query_adds_the_probe_and_sql_agrees(spark):
    got = QUERIES["op6_chat_formatting"](spark, "/root/testdata/sf0.001")
    (r,) = got.where("conv_id = -1").collect()
    assert (r.n_turns, r.loss_chars) == (2, len(PROBE))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    theirs = db.sql(ORACLE_SQL["op6_chat_formatting"])
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    same(theirs.project(", ".join(names)).fetchall(), [*brute(TURNS), *brute([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)])])


def test_logs_hold_drafts_edits_and_regenerations(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"message {i} <|im_end|>\n" * (i % 5)) for i in range(60)]
    events = C.events_of(spark.createDataFrame(turns, SCHEMA))
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert set(kinds) == set(C.EVENT_KINDS) and kinds["start"] == 60 and kinds["delta"] == 120
    same(C.format_digests(events).collect(), brute(turns))


def test_a_long_conversation_is_read_back_in_blocks(spark):
    turns = [(7, i, "assistant" if i % 3 else "user", f"{i} <|é\n" * (40_000 if i == 100 else 50)) for i in range(3_000)]
    same(C.format_digests(C.events_of(spark.createDataFrame(turns, SCHEMA).repartition(6))).collect(), brute(turns))


def test_the_mask_must_cover_texts_of_turns():
    d = C.Digest()
    s = C.render("assistant", "hello")
    d.add(C.Segment(s.text, s.loss_from, len(s.text)))
    with pytest.raises(ValueError):
        d.row()
