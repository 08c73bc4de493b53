"""Incremental forms: the same results as the batch operators, from keyed state of constant size.

Rows of a key must come in order over micro-batches; within one they are sorted. A row whose place is not after the
last one seen is late, and dropped and counted. There is no event-time watermark: state lives until its key ends.
"""
