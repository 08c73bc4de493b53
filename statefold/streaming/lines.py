"""Lines of text files as a stream of commands and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import SPACE, strip
from ..functions.text import detect_language, parse_command

BLANK = SPACE.replace(r"\x09-\x0D", r"\x09\x0B\x0C")  # white space within a line


def line_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Streaming (source, place, line, command, argument, message, lang): a file is what a session was typed, and its first
    blank line ends it. The language of a message that names none is that of its script. Files come whole: a session is
    typed by hand."""
    files = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder, wholetext=True)
    typed = F.regexp_replace("value", rf"(?s)(?>^|\r\n|[\r\n])[{BLANK}]*(?:[\r\n].*|$)", "")
    lines = files.select(F.input_file_name().alias("source"), F.posexplode(F.split(typed, r"\r\n|[\r\n]")).alias("place", "_line"))
    lines = lines.select("source", "place", strip(F.col("_line")).alias("line")).where("line <> ''")
    command, argument, message = parse_command(F.col("line"))
    parsed = lines.withColumns({"command": command, "argument": argument, "message": message})
    lang = F.when(F.col("command") == "once", F.col("argument")).when(F.col("command") == "message", detect_language(F.col("message")))
    return parsed.withColumn("lang", lang)
