"""A self-test of the model: reading in blocks, stepping, and a greedy reply, compared on recorded tokens."""

from __future__ import annotations

import numpy as np

from .generate import Session, replay
from .model import Model

TOLERANCE = 1e-3


def self_test(a: Model, b: Model, prompt: list[int], n: int = 16) -> tuple[str, bool]:
    """A report on two runtimes of the same weights, and whether they agree: equal greedy tokens, and scores on the same
    tokens within the tolerance. a's tokens are fed to both, so one early difference does not hide the rest."""
    one, two = Session(a), Session(b)
    one.feed(prompt)
    two.feed(prompt)
    tokens, other = one.generate(n, stops=[]), two.generate(n, stops=[])
    gap = float(np.abs(replay(a, prompt, tokens) - replay(b, prompt, tokens)).max()) if tokens else 0.0
    passed = tokens == other and gap <= TOLERANCE
    lines = [f"parameters: {a.parameters()}", f"state bytes: {Model.state_bytes(one.states)}", f"tokens: {len(tokens)}", f"same greedy tokens: {tokens == other}", f"largest difference: {gap:.3g}", "PASS" if passed else "FAIL"]
    return "\n".join(lines), passed
