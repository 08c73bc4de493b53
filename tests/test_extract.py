import io
import zipfile

from pyspark.sql import functions as F

from statefold.sources import extract as E


def test_html():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">One</a></li><li>Two &amp; t&#119;o</li></ul></nav><!-- <p>no</p> --><h1>Head</h1><p>First
    line<br>second <b>bo</b>ld<p>Third&nbsp;&lt;x&gt;<img src="a"/><noscript>no</noscript></body></html>"""
    assert E.html_text(page) == "One\nTwo & two\nHead\nFirst line\nsecond bold\nThird <x>"
    assert E.html_text("<head><title>t</title><body>text") == "text" and E.html_text("") == "" and E.html_text("a < b") == "a < b"


def test_other_formats():
    assert E.xml_text("<a><b>x &amp; y</b> z <c/></a>") == "x & y\nz" and E.xml_text("<a><b>x") == "x"
    assert E.table_text('a,"b, c"\n\n1,"2\n3"\n') == "a b, c\n1 2 3" and E.KINDS["tsv"]("a\tb") == "a b"
    assert E.json_text('{"a": ["x", 1, null, {"b": true}]}') == "x\n1\ntrue" and E.json_text('{"a": "x"}\n{"a": "y"}\nz') == "x\ny\nz"


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>ಕ two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>")
    return raw.getvalue()


def test_column(spark):
    rows = [("<p>x</p>", "html"), ("a,b", "CSV"), (None, "txt"), ("x", None), ("x", "pdf"), (" x  y ", "txt")]
    got = spark.createDataFrame(rows, "c string, k string").select(E.extracted(F.col("c"), F.col("k")).alias("t")).collect()
    assert [r.t for r in got] == ["x", "a b", None, None, None, "x y"]
    files = spark.createDataFrame([(bytearray(_docx()), "docx"), (bytearray(b"no zip"), "docx"), (bytearray("né".encode()), "md")], "c binary, k string")
    assert [r.t for r in files.select(E.extracted(F.col("c"), F.col("k")).alias("t")).collect()] == ["One ಕ two\nThree", None, "né"]


def test_pages_against_plain_rules(spark):
    """The pages of the test data by patterns alone."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", E.extracted(F.col("html"), F.lit("html")).alias("t")).collect()
    assert rows
    for r in rows:
        t = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", r.html)
        t = re.sub(r"(?is)<head\b.*?</head>|<(script|style|noscript|template|svg)\b.*?</\1>", "", t)
        t = re.sub(r"(?i)</?(?:%s)\b[^>]*>" % "|".join(sorted(E._LINES, key=len, reverse=True)), "\x00", t.replace("\n", " "))
        t = html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", t))
        want = [re.sub(r"[^\S\n]+", " ", x).strip() for x in t.replace("\x00", "\n").split("\n")]
        assert r.t == "\n".join(x for x in want if x)
