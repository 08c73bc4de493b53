"""A sink for text that arrives in pieces of bytes: characters come out once they are whole."""

from __future__ import annotations

import codecs
from collections.abc import Callable

from pyspark.sql import DataFrame


class HeldBack:
    """Decodes pieces of UTF-8; the bytes of an unfinished character wait for the next piece."""

    def __init__(self) -> None:
        self._decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def __call__(self, piece: bytes, last: bool = False) -> str:
        return self._decoder.decode(piece, last)

    @property
    def waiting(self) -> int:
        return len(self._decoder.getstate()[0])


def text_sink(write: Callable[[int, str], None], key: str = "conv_id", order: str = "t", piece: str = "piece") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each key's new whole characters. It is for an interactive reader: a
    micro-batch is what arrived since the last, and comes to the driver a partition at a time."""
    streams: dict[int, HeldBack] = {}

    def sink(batch: DataFrame, _batch_id: int) -> None:
        for row in batch.select(key, order, piece).orderBy(key, order).toLocalIterator():
            text = streams.setdefault(row[key], HeldBack())(bytes(row[piece]))
            if text:
                write(row[key], text)

    return sink
