"""Plain text of documents: markup, tables, JSON and word-processor files."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is not text, and those that begin and end a line.
_HIDDEN = frozenset("script style noscript template svg head".split())
_LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_GAP = re.compile(r"[^\S\n]+")


def _tidy(text: str) -> str:
    """Lines without white space at their ends or twice within, and without empty ones."""
    lines = (_GAP.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


class _Markup(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body":  # a head need not be closed
            self.hidden.clear()
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag in _LINES:
            self.parts.append("\n")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in _LINES:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag in _LINES:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data.replace("\n", " "))


def html_text(raw: str) -> str:
    """What a reader sees: no scripts, styles, head or comments, character references resolved, a line for each block."""
    parser = _Markup()
    parser.feed(raw)
    parser.close()
    return _tidy("".join(parser.parts))


def xml_text(raw: str) -> str:
    """The text of all elements, a line for each; what is not well formed is read as HTML."""
    try:
        return _tidy("\n".join(ElementTree.fromstring(raw).itertext()))
    except ElementTree.ParseError:
        return html_text(raw)


def table_text(raw: str, delimiter: str = ",") -> str:
    """A line for each row, its cells with spaces between."""
    return _tidy("\n".join(" ".join(x.replace("\n", " ") for x in row) for row in csv.reader(io.StringIO(raw), delimiter=delimiter)))


def _leaves(value) -> Iterator[str]:
    if isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)
    elif value is not None:
        yield value if isinstance(value, str) else json.dumps(value)


def json_text(raw: str) -> str:
    """The values of a JSON document, or of a document on each line, in order; a line that is neither is text."""
    try:
        return _tidy("\n".join(_leaves(json.loads(raw))))
    except ValueError:
        pass
    out = []
    for line in raw.splitlines():
        try:
            out += _leaves(json.loads(line))
        except ValueError:
            out.append(line)
    return _tidy("\n".join(out))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """The paragraphs of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    gaps = {_WORD + "tab": "\t", _WORD + "br": "\n"}
    return _tidy("\n".join("".join(x.text or "" if x.tag == _WORD + "t" else gaps.get(x.tag, "") for x in p.iter()) for p in root.iter(_WORD + "p")))


KINDS = {"html": html_text, "htm": html_text, "xml": xml_text, "csv": table_text, "tsv": lambda raw: table_text(raw, "\t"), "json": json_text, "jsonl": json_text, "txt": _tidy, "md": _tidy}


def extracted(content: Column, kind: Column) -> Column:
    """The text of documents, in Arrow batches: content is a string, or bytes of UTF-8 or a DOCX file; kind a suffix without its dot.

    Null for null, for an unknown kind (PDF has no reader here) and for a DOCX file that is none. Texts are taken whole.
    """

    @F.pandas_udf("string")
    def run(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_one(c, k) for c, k in zip(contents, kinds, strict=True)], index=contents.index, dtype=object)

    return run(content, F.lower(kind))


def _one(content: str | bytes | None, kind: str | None) -> str | None:
    if content is None or kind is None:
        return None
    if kind == "docx":
        try:
            return docx_text(content) if isinstance(content, bytes) else None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
    if kind not in KINDS:
        return None
    return KINDS[kind](content.decode("utf-8", "replace") if isinstance(content, bytes) else content)
