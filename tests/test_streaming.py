import random

import numpy as np
import pytest

from statefold.operators import telemetry
from statefold.plans import generate as G
from statefold.plans import lm
from statefold.plans.model import Model
from statefold.streaming.decay import decayed_stream
from statefold.streaming.session import session_stream
from statefold.streaming.telemetry import energy_stream
from statefold.streaming.text_sink import HeldBack, text_sink


def run(spark, tmp_path, batches, schema, stream, name):
    """Feed the batches one by one and give back all that came out."""
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(schema).json(str(folder))
    query = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{i}"))
            for f in (tmp_path / f"b{i}").glob("part*"):
                f.rename(folder / f"{i}.json")
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_decay_in_micro_batches_equals_one_pass(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, t, rng.uniform(-1, 0), rng.uniform(-1, 1), rng.random() < 0.2) for k in range(4) for t in range(30)]
    cut = [[r for r in rows if a <= r[1] < z] for a, z in ((0, 9), (9, 10), (10, 30))]
    for b in cut:
        rng.shuffle(b)
    cut[2].append((0, 3, -1.0, 99.0, False))  # a late row
    got = run(spark, tmp_path, cut, "key bigint, t bigint, la double, v double, is_end boolean", decayed_stream, "decay_out")
    assert len(got) == len(rows) and max(r.late for r in got) == 1
    want, last = {}, None
    for k, t, la, v, end in rows:
        doc, s, ended = (0, 0.0, False) if last != k else (doc, s, ended)
        doc, s = (doc + 1, 0.0) if ended else (doc, s)
        s = np.exp(la) * s + v
        want[k, t] = (doc, s)
        ended, last = end, k
    assert all(r.doc == want[r.key, r.t][0] and abs(r.y - want[r.key, r.t][1]) < 1e-12 for r in got)


def test_energy_in_micro_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, 1.5 * i + (20 if i > 25 else 0), None if rng.random() < 0.1 else rng.uniform(50, 150), rng.choice((0, 4, 64, None))) for d in ("x", "y") for i in range(50)]
    got = run(spark, tmp_path, [rows[:20] + rows[50:70], rows[20:50], rows[70:]], "device string, t double, watts double, reasons bigint", energy_stream, "energy_out")
    samples = spark.createDataFrame(rows, "device string, t double, watts double, reasons bigint").selectExpr("device", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "watts", "0.0D as celsius", "reasons")
    for r in telemetry.energy_summary(samples, ["device"]).collect():
        mine = [g for g in got if g.device == r.device]
        assert sum(g.samples for g in mine) == r.samples and sum(g.joules for g in mine) == pytest.approx(r.kwh * 3.6e6)
        assert sum(g.gap_s for g in mine) == pytest.approx(r.hours_gap * 3600)
        assert sum(g.thermal_s for g in mine) / sum(g.covered_s for g in mine) == pytest.approx(r.share_thermal_throttled)


def test_sessions_equal_one_pass(spark, tmp_path):
    rng = np.random.default_rng(0)
    turns = [(c, t, [*rng.integers(2, 97, 3 + t).tolist(), *([0] if t == 1 else [])]) for c in (1, 2) for t in range(4)]
    weights = lm.tiny_weights()
    got = run(spark, tmp_path, [[r for r in turns if r[1] < 2], [r for r in turns if r[1] >= 2]], "conv_id bigint, turn bigint, ids array<bigint>", lambda s: session_stream(s, weights, answer=3, chunk=8), "session_out")
    assert len(got) == len(turns)
    model = Model(weights, chunk=8)
    for c in (1, 2):
        session = G.Session(model)
        for r in sorted((g for g in got if g.conv_id == c), key=lambda g: g.turn):
            ids = next(t[2] for t in turns if t[:2] == (c, r.turn))
            assert r.best == int(session.feed(ids).argmax()) and list(r.reply) == session.generate(3) and r.n_seen == len(session.seen)


def test_state_round_trip():
    model = Model(lm.tiny_weights(), chunk=8)
    session = G.Session(model)
    with pytest.raises(RuntimeError):
        session.snapshot()
    session.feed([5, 6, model.shape.end])
    back = G.Session.restore(model, session.snapshot())
    assert back.last == session.last and np.abs(back.feed([8]) - session.feed([8])).max() == 0


def test_a_batch_state_seeds_a_stream(spark, tmp_path):
    weights = lm.tiny_weights()
    model = Model(weights, chunk=8)
    whole, half = G.Session(model), G.Session(model)
    half.feed([5, 6, 7, 9])
    whole.feed([5, 6, 7, 9])
    rows = [[(1, 0, [11, 12], bytearray(half.snapshot()))], [(1, 1, [13], None), (1, 0, [14], None)]]
    got = run(spark, tmp_path, rows, "conv_id bigint, turn bigint, ids array<bigint>, session binary", lambda s: session_stream(s, weights, chunk=8), "seeded_out")
    want = [int(whole.feed(ids).argmax()) for ids in ([11, 12], [13])]
    assert [r.best for r in sorted(got, key=lambda r: r.turn)] == want


def test_characters_wait_until_they_are_whole(spark):
    raw = "né😀ಕ".encode()
    held = HeldBack()
    out = [held(raw[i : i + 1]) for i in range(len(raw))]
    assert "".join(out) == "né😀ಕ" and all("�" not in x for x in out) and held.waiting == 0
    seen = []
    sink = text_sink(lambda k, t: seen.append((k, t)))
    pieces = spark.createDataFrame([(1, i, bytearray(raw[i : i + 2])) for i in range(0, len(raw), 2)], "conv_id int, t int, piece binary")
    sink(pieces.where("t < 4"), 0)
    sink(pieces.where("t >= 4"), 1)
    assert "".join(t for _, t in seen) == "né😀ಕ"
