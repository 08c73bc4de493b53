import datetime

import pytest
from pyspark.sql import functions as F

from statefold.operators import telemetry as T
from statefold.sources.results import report
from statefold.sources.telemetry_csv import read_log

HEADER = "timestamp, power.draw [W], temperature.gpu, utilization.gpu [%], memory.used [MiB], clocks.current.sm [MHz], clocks_event_reasons.active\n"
START = datetime.datetime(2026, 11, 18, 16)


def line(second, watts="100.00", celsius="70", reasons="0x0000000000000000", digits=3):
    at = START + datetime.timedelta(seconds=second)
    return f"{at:%Y/%m/%d %H:%M:%S}.{'0' * digits}, {watts}, {celsius}, 99, 7000, 2500, {reasons}\n"


def summary(spark, tmp_path, *files, **how):
    paths = []
    for i, content in enumerate(files):
        p = tmp_path / f"log{i}.csv"
        p.write_text(content)
        paths.append(str(p))
    return T.energy_summary(read_log(spark, paths), **how).collect()


def test_an_hour_at_a_hundred_watts(spark, tmp_path):
    (r,) = summary(spark, tmp_path, HEADER + "".join(line(s) for s in range(3601)))
    assert (r.samples, round(r.kwh, 9), round(r.hours_logged, 9), r.hours_gap, r.mean_watts, r.mean_celsius, r.peak_celsius) == (3601, 0.1, 1.0, 0.0, 100.0, 70.0, 70.0)


def test_gaps_are_not_bridged(spark, tmp_path):
    (r,) = summary(spark, tmp_path, HEADER + "".join(line(s) for s in range(3601) if not 1201 <= s <= 1799))
    assert r.hours_gap == pytest.approx(600 / 3600) and r.kwh == pytest.approx(0.1 * 3000 / 3600)


def test_unreadable_values_and_cut_lines(spark, tmp_path):
    body = line(0, watts="[N/A]") + "".join(line(s, digits=1 + s % 6) for s in range(1, 11)) + "2026/11/18 16:00:11.000, 100\n" + "bad time, 1, 2, 3, 4, 5, 0x0\n"
    (r,) = summary(spark, tmp_path, HEADER + body)
    assert r.samples == 11 and r.kwh == pytest.approx(100 * 9 / 3.6e6) and r.hours_gap == pytest.approx(1 / 3600)


def test_throttling_by_the_left_sample(spark, tmp_path):
    (r,) = summary(spark, tmp_path, HEADER + "".join(line(s, reasons="0x0000000000000040") for s in range(101)))
    assert (r.share_thermal_throttled, r.share_power_capped) == (1.0, 0.0)
    old = HEADER.replace("clocks_event_reasons", "clocks_throttle_reasons") + line(0, reasons="0x4") + line(1, reasons="0x20") + line(3)
    (r,) = summary(spark, tmp_path, old)
    assert r.share_power_capped == pytest.approx(1 / 3) and r.share_thermal_throttled == pytest.approx(2 / 3)


def test_files_make_one_timeline(spark, tmp_path):
    a, b = "".join(line(s) for s in range(11)), "".join(line(s) for s in range(5010, 5021))
    (r,) = summary(spark, tmp_path, HEADER + b, HEADER + a, "")
    assert r.samples == 22 and r.hours_gap * 3600 == pytest.approx(5000) and r.hours_logged * 3600 == pytest.approx(20)
    rows = summary(spark, tmp_path, HEADER + b, HEADER + a, by=["device"])
    assert len(rows) == 2 and all(x.hours_gap == 0 for x in rows)


def test_one_timeline_over_hours_equals_a_single_window(spark):
    df = spark.range(3000).selectExpr("id as event_id", "timestamp_micros(cast(pmod(id * 7919, 3001) * 17000000 as bigint)) as ts", "if(id % 7 = 0, null, cast(id % 90 as double)) as watts", "1.0D as celsius", "id % 128 as reasons")
    one = T.energy_summary(df, None, 60.0).first()
    two = T.energy_summary(df.withColumn("k", F.lit(1)), ["k"], 60.0).first()
    assert all(one[c] == pytest.approx(two[c]) for c in one.asDict())


def test_empty_logs(spark, tmp_path):
    (r,) = summary(spark, tmp_path, HEADER)
    assert r.samples == 0 and r.kwh == 0.0 and r.mean_watts == 0.0 and r.peak_celsius == 0.0
    text, code = report(T.energy_summary(read_log(spark, str(tmp_path / "log0.csv"))))
    assert code == 1 and "samples: 0" in text


def test_footprint(spark, tmp_path):
    (tmp_path / "l.csv").write_text(HEADER + "".join(line(s) for s in range(3601)))
    s = T.energy_summary(read_log(spark, str(tmp_path / "l.csv")))
    r = T.with_footprint(s, tokens=2_000_000, grid_kg_per_kwh=0.7, grid_source="table 3").first()
    assert r.wh_per_million_tokens == pytest.approx(50) and r.kg_co2 == pytest.approx(0.07) and r.co2_basis == "gpu board only"
    assert T.with_footprint(s, grid_kg_per_kwh=0.7, grid_source="t", wall_kwh=0.5).first().kg_co2 == pytest.approx(0.35)
    with pytest.raises(ValueError):
        T.with_footprint(s, grid_kg_per_kwh=0.7)
    text, code = report(s, as_json=True)
    assert code == 0 and '"samples": 3601' in text


def test_quoted_commas_and_second_headers(spark, tmp_path):
    body = 'timestamp, name, power.draw [W]\n2026/11/18 16:00:00.000, "card, ""two""", 50\n2026/11/18 16:00:01.000, x, 50\npower.draw [W], timestamp, name\n2026/11/18 16:00:02.000, x, 50\n'
    (tmp_path / "q.csv").write_text(body)
    rows = sorted(read_log(spark, str(tmp_path / "q.csv")).collect(), key=lambda r: r.ts)
    assert [(r.ts.second, r.watts) for r in rows] == [(0, 50.0), (1, 50.0), (2, 50.0)]


def test_high_bits_of_the_mask_and_samples_without_a_time(spark, tmp_path):
    (r,) = summary(spark, tmp_path, HEADER + "".join(line(s, reasons="0x8000000000000040") for s in range(11)))
    assert r.share_thermal_throttled == 1.0
    rows = [(1, START, 1.0, None, None), (1, None, 2.0, None, None), (1, START + datetime.timedelta(seconds=1), 3.0, None, None)]
    df = spark.createDataFrame(rows, "device int, ts timestamp, watts double, celsius double, reasons bigint")
    (one,), (all_,) = T.energy_summary(df, ["device"]).collect(), T.energy_summary(df).collect()
    assert one.samples == all_.samples == 3 and one.kwh == all_.kwh
