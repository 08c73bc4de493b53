"""A recurrent language model with state of constant size, in numpy.

Each layer mixes tokens through S_t = a_t S_{t-1} + b_t k_t v_t', y_t = q_t S_t, with gates from a blend of a token and the
one before it, a causal convolution of four taps on the projections, values blended with the first layer's, and a gated
output; then a SwiGLU layer. Nothing crosses from one document to the next. ``read`` takes many tokens at once, in blocks,
and ``step`` one; both go from state to state and agree, so a text may be read in any pieces.

Weights are a dict by name. Names and shapes follow the published weights' layout, so that such files load.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from typing import NamedTuple

import numpy as np

from ..functions.numeric import head_dim, mlp_hidden
from ..sources.weights import check_keys

TAPS = 4


@dataclass(frozen=True)
class Shape:
    vocab: int = 32768
    layers: int = 16
    heads: int = 16
    width: int = 1024
    chunk: int = 64
    context: int = 4096
    end: int = 0
    pad: int = 1
    write_scale: float = 2.0

    def __post_init__(self) -> None:
        head_dim(self.width, self.heads)

    @property
    def dim(self) -> int:
        return head_dim(self.width, self.heads)

    @property
    def hidden(self) -> int:
        return mlp_hidden(self.width)

    @classmethod
    def of_weights(cls, weights: dict[str, np.ndarray], **options) -> Shape:
        """The shape that the arrays imply; chunk, context, special ids and scale cannot be seen in them."""
        vocab, width = weights["tok_emb.weight"].shape
        layers = 1 + max(int(name.split(".")[1]) for name in weights if name.startswith("blocks."))
        return replace(cls(vocab=vocab, layers=layers, heads=len(weights["blocks.0.attn.alpha_proj.weight"]), width=width), **options)


class LayerState(NamedTuple):
    memory: np.ndarray  # (heads, dim, dim)
    conv: np.ndarray  # (TAPS - 1, 3 * width): projections of the tokens before
    prev: np.ndarray  # (width,): the layer's input at the token before


def weight_shapes(shape: Shape) -> dict[str, tuple[int, ...]]:
    d, h = shape.width, shape.heads
    out: dict[str, tuple[int, ...]] = {"tok_emb.weight": (shape.vocab, d), "ln_f.weight": (d,)}
    for i in range(shape.layers):
        a = f"blocks.{i}.attn."
        out |= {f"blocks.{i}.ln1.weight": (d,), f"blocks.{i}.ln2.weight": (d,), f"blocks.{i}.mlp.w1.weight": (shape.hidden, d), f"blocks.{i}.mlp.w3.weight": (shape.hidden, d), f"blocks.{i}.mlp.w2.weight": (d, shape.hidden)}
        out |= {a + "mu": (d,), a + "qkv.weight": (3 * d, d), a + "conv_weight": (3 * d, 1, TAPS), a + "conv_bias": (3 * d,), a + "alpha_proj.weight": (h, d), a + "alpha_proj.bias": (h,)}
        out |= {a + "beta_proj.weight": (h, d), a + "beta_proj.bias": (h,), a + "y_norm": (h, shape.dim), a + "gate.weight": (d, d), a + "proj.weight": (d, d)}
        if i:
            out[a + "v_residual_lamb"] = (h,)
    return out


def decay_biases(heads: int) -> np.ndarray:
    """Biases for which heads forget from 0.1 to 10**-4.5 of their state a token, evenly in the logarithm."""
    forget = np.logspace(-1.0, -4.5, heads)
    return np.log(np.expm1(-np.log1p(-forget)))


def fresh_weights(shape: Shape, seed: int = 0, spread: float = 0.02) -> dict[str, np.ndarray]:
    """Initial weights: normal, smaller where a layer writes to the residual stream; convolutions pass their input through."""
    rng, out = np.random.default_rng(seed), {}
    for name, size in weight_shapes(shape).items():
        last = name.rsplit(".", 2)[-2:] if "." in name else [name]
        if name.endswith(("ln1.weight", "ln2.weight", "ln_f.weight", "y_norm")):
            out[name] = np.ones(size)
        elif name.endswith(".mu"):
            out[name] = np.full(size, 0.5)
        elif name.endswith("conv_weight"):
            out[name] = np.zeros(size)
            out[name][:, 0, -1] = 1.0
        elif name.endswith("alpha_proj.bias"):
            out[name] = decay_biases(shape.heads)
        elif name.endswith(("bias", "v_residual_lamb", "beta_proj.weight")):
            out[name] = np.zeros(size)
        else:
            std = spread / np.sqrt(2 * shape.layers) if last[0] in ("proj", "w2") and "qkv" not in name else spread
            out[name] = rng.normal(0.0, std, size)
    return out


def perturbed(weights: dict[str, np.ndarray], seed: int = 1, spread: float = 0.3) -> dict[str, np.ndarray]:
    """Weights with noise on every array, for tests in which every part should matter."""
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0.0, spread, v.shape) for k, v in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-x))


def _silu(x: np.ndarray) -> np.ndarray:
    return x * _sigmoid(x)


def _rms(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.mean(x * x, axis=-1, keepdims=True) + 1e-5) * weight


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


class Model:
    def __init__(self, weights: dict[str, np.ndarray], **options) -> None:
        self.shape = Shape.of_weights(weights, **options)
        check_keys(set(weight_shapes(self.shape)), set(weights))
        self.w = {k: np.asarray(v, np.float64) for k, v in weights.items() if k != "head.weight"}

    def parameters(self) -> int:
        return sum(v.size for v in self.w.values())

    def empty(self) -> list[LayerState]:
        s = self.shape
        return [LayerState(np.zeros((s.heads, s.dim, s.dim)), np.zeros((TAPS - 1, 3 * s.width)), np.zeros(s.width)) for _ in range(s.layers)]

    @staticmethod
    def state_bytes(states: list[LayerState], item: int = 4) -> int:
        return sum(part.size * item for layer in states for part in layer)

    def read(self, ids: list[int] | np.ndarray, states: list[LayerState] | None = None, after_end: bool = False) -> tuple[np.ndarray, list[LayerState]]:
        """Scores (tokens, vocab) for what follows each token, and the state after the last. after_end: the token before
        ids was an end token. The last block may be short."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            raise ValueError("nothing to read")
        states = states or self.empty()
        reset = np.concatenate(([after_end], ids[:-1] == self.shape.end))
        doc = np.cumsum(reset)
        x, first, out = self.w["tok_emb.weight"][ids], None, []
        for i, state in enumerate(states):
            mixed, first, state = self._mix(i, _rms(x, self.w[f"blocks.{i}.ln1.weight"]), reset, doc, first, state)
            x = x + mixed
            h = _rms(x, self.w[f"blocks.{i}.ln2.weight"])
            x = x + (_silu(h @ self.w[f"blocks.{i}.mlp.w1.weight"].T) * (h @ self.w[f"blocks.{i}.mlp.w3.weight"].T)) @ self.w[f"blocks.{i}.mlp.w2.weight"].T
            out.append(state)
        return _rms(x, self.w["ln_f.weight"]) @ self.w["tok_emb.weight"].T, out

    def pieces(self, ids: list[int] | np.ndarray, states: list[LayerState] | None = None, after_end: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(place, scores) of ``read``, for _PIECE tokens at a time, so that what is held does not grow with the text. A narrow model's
        pieces within one document go the short way, see ``Narrow``."""
        ids, states = np.asarray(ids, np.int64), states or self.empty()
        for at in range(0, len(ids), _PIECE):
            part = ids[at : at + _PIECE]
            within = self.shape.width <= _NARROW and not after_end and not (part[:-1] == self.shape.end).any()
            scores, states = self.narrow.read(part, states) if within else self.read(part, states, after_end)
            after_end = part[-1] == self.shape.end
            yield at, scores

    @cached_property
    def narrow(self) -> Narrow:
        return Narrow(self.shape, self.w)

    def step(self, token: int, states: list[LayerState] | None = None, after_end: bool = False) -> tuple[np.ndarray, list[LayerState]]:
        """Scores (vocab,) after one token, by the recurrence itself: no blocks, no prefix sums."""
        states, s = states or self.empty(), self.shape
        x, first, out = self.w["tok_emb.weight"][int(token)], None, []
        for i, (memory, conv, prev) in enumerate(states):
            a = f"blocks.{i}.attn."
            if after_end:
                memory, conv, prev = np.zeros_like(memory), np.zeros_like(conv), np.zeros_like(prev)
            h = _rms(x, self.w[f"blocks.{i}.ln1.weight"])
            control = self.w[a + "mu"] * h + (1 - self.w[a + "mu"]) * prev
            window = np.concatenate((conv, (self.w[a + "qkv.weight"] @ h)[None]))
            u = (window * self.w[a + "conv_weight"][:, 0].T).sum(axis=0) + self.w[a + "conv_bias"]
            q, k, v, first = self._heads(i, u[None], first)
            beta, log_alpha = self._gates(a, control[None])
            memory = np.exp(log_alpha[0])[:, None, None] * memory + beta[0][:, None, None] * k[0][:, :, None] * v[0][:, None, :]
            x = x + self._emit(a, np.einsum("hd,hde->he", q[0], memory)[None], control[None])[0]
            out.append(LayerState(memory, window[1:], h))
            h = _rms(x, self.w[f"blocks.{i}.ln2.weight"])
            x = x + self.w[f"blocks.{i}.mlp.w2.weight"] @ (_silu(self.w[f"blocks.{i}.mlp.w1.weight"] @ h) * (self.w[f"blocks.{i}.mlp.w3.weight"] @ h))
        return self.w["tok_emb.weight"] @ _rms(x, self.w["ln_f.weight"]), out

    def step_many(self, tokens: np.ndarray, states: list[LayerState], after_end: np.ndarray) -> tuple[np.ndarray, list[LayerState]]:
        """``step`` for several sequences at once: tokens (rows,), states with a leading axis of rows; scores (rows, vocab)."""
        x, first, out, goes_on = self.w["tok_emb.weight"][tokens], None, [], ~np.asarray(after_end, bool)
        for i, (memory, conv, prev) in enumerate(states):
            a = f"blocks.{i}.attn."
            memory, conv, prev = memory * goes_on[:, None, None, None], conv * goes_on[:, None, None], prev * goes_on[:, None]
            h = _rms(x, self.w[f"blocks.{i}.ln1.weight"])
            control = self.w[a + "mu"] * h + (1 - self.w[a + "mu"]) * prev
            window = np.concatenate((conv, (h @ self.w[a + "qkv.weight"].T)[:, None]), axis=1)
            u = (window * self.w[a + "conv_weight"][:, 0].T).sum(axis=1) + self.w[a + "conv_bias"]
            q, k, v, first = self._heads(i, u, first)
            beta, log_alpha = self._gates(a, control)
            memory = np.exp(log_alpha)[..., None, None] * memory + beta[..., None, None] * k[..., :, None] * v[..., None, :]
            x = x + self._emit(a, (q[..., None, :] @ memory)[..., 0, :], control)
            out.append(LayerState(memory, window[:, 1:], h))
            h = _rms(x, self.w[f"blocks.{i}.ln2.weight"])
            x = x + (_silu(h @ self.w[f"blocks.{i}.mlp.w1.weight"].T) * (h @ self.w[f"blocks.{i}.mlp.w3.weight"].T)) @ self.w[f"blocks.{i}.mlp.w2.weight"].T
        return _rms(x, self.w["ln_f.weight"]) @ self.w["tok_emb.weight"].T, out

    def _heads(self, layer: int, u: np.ndarray, first: np.ndarray | None):
        s = self.shape
        q, k, v = np.moveaxis(_silu(u).reshape(len(u), 3, s.heads, s.dim), 1, 0)
        if layer == 0:
            first = v
        else:
            own = _sigmoid(self.w[f"blocks.{layer}.attn.v_residual_lamb"])[:, None]
            v = own * v + (1 - own) * first
        return _unit(q) / np.sqrt(s.dim), _unit(k), v, first

    def _gates(self, a: str, control: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beta = self.shape.write_scale * _sigmoid(control @ self.w[a + "beta_proj.weight"].T + self.w[a + "beta_proj.bias"])
        x = control @ self.w[a + "alpha_proj.weight"].T + self.w[a + "alpha_proj.bias"]
        return beta, -np.logaddexp(0.0, x)

    def _emit(self, a: str, y: np.ndarray, control: np.ndarray) -> np.ndarray:
        y = _rms(y, self.w[a + "y_norm"]).reshape(len(y), -1)
        return (y * _silu(control @ self.w[a + "gate.weight"].T)) @ self.w[a + "proj.weight"].T

    def _mix(self, layer: int, x: np.ndarray, reset: np.ndarray, doc: np.ndarray, first: np.ndarray | None, state: LayerState):
        a, n = f"blocks.{layer}.attn.", len(x)
        before = np.where(reset[:, None], 0.0, np.concatenate((state.prev[None], x[:-1])))
        control = self.w[a + "mu"] * x + (1 - self.w[a + "mu"]) * before
        raw = np.concatenate((state.conv, x @ self.w[a + "qkv.weight"].T))
        owner = np.concatenate((np.full(TAPS - 1, doc[0] - reset[0]), doc))
        taps = self.w[a + "conv_weight"][:, 0]
        u = np.zeros_like(raw[TAPS - 1 :]) + self.w[a + "conv_bias"]
        for j in range(TAPS):
            u += raw[j : j + n] * (owner[j : j + n] == doc)[:, None] * taps[:, j]
        q, k, v, first = self._heads(layer, u, first)
        beta, log_alpha = self._gates(a, control)
        y, memory = decayed_reads(q, k, v * beta[:, :, None], log_alpha, doc, int(doc[0] - reset[0]), state.memory, self.shape.chunk)
        conv = raw[-(TAPS - 1) :] * (owner[-(TAPS - 1) :] == doc[-1])[:, None]
        return self._emit(a, y, control), first, LayerState(memory, conv, x[-1])


_BLOCK = 16  # tokens whose pairs are weighed; what is before them comes through the state
_AT_ONCE = 4096  # tokens whose blocks are worked on together


def decayed_reads(q: np.ndarray, k: np.ndarray, v: np.ndarray, log_alpha: np.ndarray, doc: np.ndarray, open_doc: int, state: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Reads (tokens, heads, dim) and the state after the last token. state belongs to open_doc, the document before token 0.
    Blocks have ``size`` tokens or _BLOCK, if that is less; all of a run's blocks are worked on at once but for their states."""
    size, out = min(size, _BLOCK), np.empty_like(v)
    run = max(_AT_ONCE // size, 1) * size
    at = 0
    while at < len(q):
        left = len(q) - at
        n = min(run, left // size * size) or left  # whole blocks, and a short one at the end
        s, block = slice(at, at + n), min(size, n)
        parts = n // block
        d = doc[s].reshape(parts, block)
        p = np.cumsum(log_alpha[s].reshape(parts, block, -1), axis=1).transpose(0, 2, 1)  # (blocks, heads, rows)
        qs, ks, vs = (z[s].reshape(parts, block, *z.shape[1:]).transpose(0, 2, 1, 3) for z in (q, k, v))
        seen = np.tril(d[:, :, None] == d[:, None, :])[:, None]
        weight = np.exp(np.where(seen, p[:, :, :, None] - p[:, :, None, :], -np.inf))
        y = ((qs @ ks.transpose(0, 1, 3, 2)) * weight) @ vs
        last = np.where((d == d[:, -1:])[:, None], np.exp(p[:, :, -1:] - p), 0.0)
        added = (ks * last[..., None]).transpose(0, 1, 3, 2) @ vs
        keeps = np.exp(p[:, :, -1])[:, :, None, None]
        before = np.concatenate(([open_doc], d[:-1, -1]))
        states = np.empty((parts, *state.shape))
        for i, goes_on in enumerate((d[:, -1] == before).tolist()):
            states[i] = state
            state = keeps[i] * state + added[i] if goes_on else added[i]
        carried = np.where((d == before[:, None])[:, None], np.exp(p), 0.0)
        y += carried[..., None] * (qs @ states)
        out[s] = y.transpose(0, 2, 1, 3).reshape(n, *v.shape[1:])
        open_doc, at = int(d[-1, -1]), at + n
    return out, state


_PIECE = 512  # tokens that ``Model.pieces`` reads at once
_NARROW = 64  # widths up to which heads are worked on together


def _silu_in(x: np.ndarray, room: np.ndarray) -> None:
    np.negative(x, out=room)
    np.exp(room, out=room)
    room += 1.0
    x /= room


def _scaled(x: np.ndarray, weight: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``_rms`` into out."""
    r = 1.0 / np.sqrt(np.einsum("ij,ij->i", x, x) / x.shape[1] + 1e-5)
    np.multiply(x, r[:, None], out=out)
    out *= weight
    return out


class Narrow:
    """``Model.read`` for narrow models and tokens of one document: the same sums in arrays that are kept from piece to piece.

    A narrow layer's time goes into fresh memory and many small products. Here all heads of a block are one product, with keys and
    values spread over as many rows as there are heads, zero but in their own; and states at the beginnings of blocks are one
    product too, of what blocks add and how much of it is left. Still no positive number is exponentiated.
    """

    def __init__(self, shape: Shape, w: dict[str, np.ndarray]) -> None:
        self.shape, self.w = shape, w
        d, h, rows = shape.width, shape.heads, -(-_PIECE // _BLOCK) * _BLOCK
        self.room = {name: np.zeros((rows, size)) for name, size in (("h", d), ("u", 3 * d), ("t", 3 * d), ("c", d), ("e", d), ("q", d), ("k", d), ("v", d), ("y", d), ("z", d), ("first", d), ("la", h), ("w", h * _BLOCK), ("s", h * _BLOCK), ("m", shape.hidden), ("g", shape.hidden), ("o", shape.hidden))}
        self.raw = np.zeros((rows + TAPS - 1, 3 * d))
        self.spread = np.zeros((2, rows // _BLOCK, h * _BLOCK, d))
        self.states = np.zeros((rows // _BLOCK, d, d))
        self.own = np.repeat(np.eye(h), shape.dim, axis=1)[:, None]  # (heads, 1, width): which columns are a head's
        self.sums = np.repeat(np.eye(2 * h), shape.dim, axis=0)  # (2 width, 2 heads): adds up each head's columns
        self.after = np.where(np.tri(_BLOCK, dtype=bool), 0.0, -np.inf)[:, None]
        self.layers = []
        for i in range(shape.layers):
            a, b = f"blocks.{i}.attn.", f"blocks.{i}."
            flat = lambda name: np.ascontiguousarray(w[name].T)
            own = np.repeat(_sigmoid(w[a + "v_residual_lamb"]), shape.dim) if i else None
            self.layers.append((flat(a + "qkv.weight"), np.ascontiguousarray(w[a + "conv_weight"][:, 0].T), w[a + "conv_bias"], w[a + "mu"], flat(a + "beta_proj.weight"), w[a + "beta_proj.bias"], flat(a + "alpha_proj.weight"), w[a + "alpha_proj.bias"], own, w[a + "y_norm"].reshape(-1), flat(a + "gate.weight"), flat(a + "proj.weight"), w[b + "ln1.weight"], w[b + "ln2.weight"], flat(b + "mlp.w1.weight"), flat(b + "mlp.w3.weight"), flat(b + "mlp.w2.weight")))
        self.head = np.ascontiguousarray(w["tok_emb.weight"].T)

    def read(self, ids: np.ndarray, states: list[LayerState]) -> tuple[np.ndarray, list[LayerState]]:
        n, out = len(ids), []
        r = {name: z[:n] for name, z in self.room.items()}
        x = self.w["tok_emb.weight"][ids]
        with np.errstate(over="ignore"):
            for i, state in enumerate(states):
                ln1, ln2, w1, w3, w2 = self.layers[i][-5:]
                h = _scaled(x, ln1, r["h"])
                mixed, state = self._mix(i, h, r, state)
                x += mixed
                h = _scaled(x, ln2, r["h"])
                np.matmul(h, w1, out=r["m"])
                _silu_in(r["m"], r["g"])
                r["m"] *= np.matmul(h, w3, out=r["o"])
                x += np.matmul(r["m"], w2, out=r["z"])
                out.append(state)
        return _scaled(x, self.w["ln_f.weight"], r["h"]) @ self.head, out

    def _mix(self, i: int, x: np.ndarray, r: dict[str, np.ndarray], state: LayerState) -> tuple[np.ndarray, LayerState]:
        qkv, taps, bias, mu, beta_w, beta_b, alpha_w, alpha_b, own, y_norm, gate, proj, *_ = self.layers[i]
        n, d, heads, dim = len(x), self.shape.width, self.shape.heads, self.shape.dim
        parts = -(-n // _BLOCK)
        u, t, c, raw = r["u"], r["t"], r["c"], self.raw[: n + TAPS - 1]
        np.multiply(x, mu, out=c)
        np.multiply(x, 1.0 - mu, out=r["e"])
        c[1:] += r["e"][:-1]
        c[0] += (1.0 - mu) * state.prev
        raw[: TAPS - 1] = state.conv
        np.matmul(x, qkv, out=raw[TAPS - 1 :])
        np.multiply(raw[:n], taps[0], out=u)
        u += bias
        for j in range(1, TAPS):
            u += np.multiply(raw[j : j + n], taps[j], out=t)
        _silu_in(u, t)
        beta = self.shape.write_scale / (1.0 + np.exp(-(c @ beta_w + beta_b)))
        pairs = np.multiply(u[:, : 2 * d], u[:, : 2 * d], out=t[:, : 2 * d]) @ self.sums
        scale = 1.0 / np.maximum(np.sqrt(pairs), 1e-12)
        scale[:, :heads] /= np.sqrt(dim)
        v = u[:, 2 * d :]
        if i == 0:
            r["first"][:] = v
        else:
            v *= own
            v += np.multiply(r["first"], 1.0 - own, out=r["z"])
        # Rows beyond the last token, up to a whole block, write nothing and forget nothing.
        q, k, v_, la = (self.room[name][: parts * _BLOCK] for name in ("q", "k", "v", "la"))
        by_head = lambda z: z.reshape(len(z), -1, dim)
        for z in (q, k, v_, la):
            z[n:] = 0.0
        np.multiply(by_head(u[:, :d]), scale[:, :heads, None], out=by_head(q[:n]))
        np.multiply(by_head(u[:, d : 2 * d]), scale[:, heads:, None], out=by_head(k[:n]))
        np.multiply(by_head(v), beta[:, :, None], out=by_head(v_[:n]))
        np.negative(np.logaddexp(0.0, c @ alpha_w + alpha_b), out=la[:n])
        y, memory = self._blocks(q.reshape(parts, _BLOCK, d), k.reshape(parts, _BLOCK, d), v_.reshape(parts, _BLOCK, d), la.reshape(parts, _BLOCK, heads), state.memory)
        y = y.reshape(-1, d)[:n]
        level = np.multiply(y, y, out=r["z"]) @ self.sums[:d, :heads]
        y = by_head(y)
        y *= (1.0 / np.sqrt(level / dim + 1e-5))[:, :, None]
        y = y.reshape(n, d)
        y *= y_norm
        np.matmul(c, gate, out=r["e"])
        _silu_in(r["e"], r["z"])
        y *= r["e"]
        return np.matmul(y, proj, out=r["z"]), LayerState(memory, raw[n:].copy(), x[-1].copy())

    def _blocks(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, la: np.ndarray, memory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``decayed_reads`` gives for one document, from blocks of rows: reads, and the state after the last row."""
        (parts, block, d), heads = q.shape, la.shape[2]
        dim, rows = d // heads, parts * block
        wide, scores = (self.room[name][:rows].reshape(parts, block, heads, block) for name in ("w", "s"))
        p = np.cumsum(la, axis=1)
        np.subtract(p[..., None], p.transpose(0, 2, 1)[:, None], out=wide)
        wide += self.after
        np.exp(wide, out=wide)
        ks, vs = self.spread[0, :parts], self.spread[1, :parts]
        for z, of in ((ks, k), (vs, v)):
            np.multiply(of[:, None], self.own, out=z.reshape(parts, heads, block, d))
        flat = scores.reshape(parts, block, heads * block)
        np.matmul(q, ks.transpose(0, 2, 1), out=flat)
        scores *= wide
        y = np.matmul(flat, vs, out=self.room["y"][:rows].reshape(parts, block, d))
        left = (k.reshape(parts, block, heads, dim) * np.exp(p[:, -1:] - p)[..., None]).reshape(parts, block, d)
        each = np.arange(heads)
        added = (left.transpose(0, 2, 1) @ v).reshape(parts, heads, dim, heads, dim)[:, each, :, each].reshape(heads, parts, -1)
        past = np.concatenate((np.zeros((1, heads)), np.cumsum(p[:, -1], axis=0))).T  # (heads, parts + 1)
        decay = past[:, :, None] - past[:, None, 1:]
        decay += np.where(np.tri(parts + 1, parts, -1, dtype=bool), 0.0, -np.inf)
        states = np.exp(decay) @ added + np.exp(past)[..., None] * memory.reshape(heads, 1, -1)
        at = self.states[:parts].reshape(parts, heads, dim, heads, dim)
        for j in range(heads):
            at[:, j, :, j] = states[j, :parts].reshape(parts, dim, dim)
        carried = (q.reshape(parts, block, heads, dim) * np.exp(p)[..., None]).reshape(parts, block, d)
        y += carried @ self.states[:parts]
        return y, states[:, parts].reshape(heads, dim, dim).copy()
