import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from statefold.functions import numeric
from statefold.functions import text as T


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("text, lang", [("hello there", "eng"), ("ನಮಸ್ಕಾರ", "kan"), ("வணக்கம்", "tam"), ("నమస్తే", "tel"), ("നമസ്കാരം", "mal"), ("ಹೇಗಿದ್ದೀರಿ ok", "kan"), ("నಕ", "kan"), ("க న", "tam"), ("", "eng"), ("ଓଡ଼ିଆ", "eng")])
def test_detected_language(spark, text, lang):
    assert column(spark, [text]).select(T.detect_language(F.col("x"))).first()[0] == lang


def test_pretokens_match_the_pattern_and_are_whole(spark):
    pattern = regex.compile(T.PRETOKEN)
    texts = ["It's  a test!!\n\n ok", "ನಮಸ್ಕಾರ ಜಗತ್ತು 123", "a b c", "x\r\n y", "  lead", "tail  ", "naïve café’s", ""]
    for r in column(spark, texts).select("x", T.pretokens(F.col("x")).alias("w")).collect():
        assert r.w == pattern.findall(r.x) and "".join(r.w) == r.x


def test_composition(spark):
    got = column(spark, ["é", "ಕೋ", None, "plain"]).select(T.nfc(F.col("x"))).collect()
    assert [r[0] for r in got] == [unicodedata.normalize("NFC", "é"), unicodedata.normalize("NFC", "ಕೋ"), None, "plain"]


def test_stops_lists_and_labels(spark):
    df = column(spark, ["one STOP two\n\nthree", "no stop", "\n\nx"])
    assert [r[0] for r in df.select(T.cut_at_stops(F.col("x"), ["\n\n", "", "STOP"])).collect()] == ["one ", "no stop", ""]
    assert column(spark, [" a, b ,,c , "]).select(T.split_list(F.col("x"))).first()[0] == ["a", "b", "c"]
    assert column(spark, ["x" * 90]).select(T.run_label(F.col("x"), F.lit(5)), T.run_label(F.col("x"), F.lit(None).cast("int"))).first()[:] == ("SMOKE-limit5-" + "x" * 80, "x" * 80)


def test_leak_scan(spark):
    files = [("a.txt", "ok\nC:\\Users\\me\\x\r\nsee FILE:///etc"), ("private/n.txt", "secret"), ("b.PNG", "file:///x"), ("c.md", "Mail Jo.Do@gmail.com  or x\nthe Word here\nsword"), ("d", "http://a.b/c d:/x"), ("e", None)]
    got = T.scan_lines(spark.createDataFrame(files, "p string, t string"), "p", "t", words=["word"]).collect()
    assert {(r.path, r.line, r.label) for r in got} == {("a.txt", 2, "windows path"), ("a.txt", 2, "user home"), ("a.txt", 3, "file url"), ("private/n.txt", 0, "private file"), ("c.md", 1, "personal mail"), ("c.md", 2, "blocked name")}


def test_norms_and_gates(spark):
    import math

    df = spark.createDataFrame([(x, [3.0, 4.0]) for x in (-800.0, -1.0, 0.0, 2.0, 800.0)], "x double, a array<double>")
    for r in df.select("x", numeric.sigmoid(F.col("x")).alias("s"), numeric.softplus(F.col("x")).alias("p"), numeric.log_decay(F.col("x")).alias("d"), numeric.l2_normalised(F.col("a")).alias("u"), numeric.rms_normalised(F.col("a"), [1.0, 2.0]).alias("r")).collect():
        assert r.s == pytest.approx(0.0 if r.x < -700 else 1 / (1 + math.exp(-r.x))) and r.d == -r.p <= 0
        assert r.p == pytest.approx(max(r.x, 0) + math.log1p(math.exp(-abs(r.x))))
        assert r.u == pytest.approx([0.6, 0.8]) and r.r == pytest.approx([3 / math.sqrt(12.5 + 1e-5), 8 / math.sqrt(12.5 + 1e-5)])
    assert numeric.mlp_hidden(1024) == 2752 and numeric.head_dim(1024, 16) == 64


def test_tolerant_parsers(spark):
    rows = column(spark, ["0x0000000000000040", "ff", "zz", "[N/A]", "", None, " 12.5 ", "1e3"]).select(numeric.parse_hex(F.col("x")).alias("h"), numeric.parse_number(F.col("x")).alias("n")).collect()
    assert [r.h for r in rows] == [64, 255, None, None, None, None, None, 0x1E3]
    assert [r.n for r in rows] == [None, None, None, None, None, None, 12.5, 1000.0]


def test_numbers_and_masks_of_every_length(spark):
    texts = ["0x8000000000000040", "8000000000000040", "0xffffffffffffffff", "1" + "0" * 20 + "4", "-0x10", "+ff", "0X_1f", "1_0", "1__0", "_1", "0x", "\t40\u00a0"]
    got = [r[0] for r in column(spark, texts).select(numeric.parse_hex(F.col("x"))).collect()]
    signed = lambda n: n - 2**64 if n >> 63 else n
    assert got == [signed(0x8000000000000040)] * 2 + [-1, 4, -16, 255, 31, 16, None, None, None, 64]
    texts = ["100d", "1f", "100.", ".5", "1_000.5e-1_0", "1__0", "-Infinity", "inf", "NaN", "0x10", "1e", " 7\t", "1 2", "+3"]
    got = [r[0] for r in column(spark, texts).select(numeric.parse_number(F.col("x"))).collect()]
    assert [str(x) for x in got] == [str(x) for x in [None, None, 100.0, 0.5, 1000.5e-10, None, float("-inf"), float("inf"), float("nan"), None, None, 7.0, None, 3.0]]


def test_white_space_of_every_kind(spark):
    edge = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [edge + "a" + edge + "b" + edge, edge, "", None, " " * 50_000 + "x" + " " * 50_000 + "y"]
    got = [r[0] for r in column(spark, texts).select(numeric.strip(F.col("x"))).collect()]
    assert got == [x if x is None else x.strip() for x in texts]
    files = [(".claude/x", "file:///a"), ("a", "\t file:///a \t")]
    got = T.scan_lines(spark.createDataFrame(files, "p string, t string"), "p", "t").collect()
    assert {(r.path, r.label, r.excerpt) for r in got} == {(".claude/x", "private file", ""), ("a", "file url", "file:///a")}


def test_commands_with_tabs(spark):
    command, argument, message = T.parse_command(F.col("x"))
    got = {r[0]: tuple(r[1:]) for r in column(spark, ["\t/lang kan", "/new\tx", "/new x", "/kan\u3000", "/eng \t hi "]).select("x", command, argument, message).collect()}
    assert got == {"\t/lang kan": ("lang", "kan", None), "/new\tx": ("unknown", None, None), "/new x": ("new", None, None), "/kan\u3000": ("unknown", None, None), "/eng \t hi ": ("once", "eng", "hi")}
