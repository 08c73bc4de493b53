"""Numeric column functions: gates, norms and tolerant parsers. All run JVM-side in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)); large x does not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def write_gate(x: Column, scale: float = 2.0) -> Column:
    """How strongly a token is written: scale * sigmoid(x)."""
    return F.lit(scale) * sigmoid(x)


def log_decay(x: Column) -> Column:
    """Log of the share of state that a token keeps, never above zero: -softplus(x)."""
    return -softplus(x)


def highway(v: Column, first: Column, lam: Column) -> Column:
    """A later layer's value blended with the first layer's: sigmoid(lam) * v + (1 - sigmoid(lam)) * first."""
    s = sigmoid(lam)
    return s * v + (1.0 - s) * first


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, p: acc + p)


def l2_normalised(a: Column, eps: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / norm)


def rms_normalised(a: Column, weight: Sequence[float] | None = None, eps: float = 1e-5) -> Column:
    """x / sqrt(mean(x**2) + eps), times a weight for each place."""
    scale = F.sqrt(dot(a, a) / F.size(a) + F.lit(eps))
    out = F.transform(a, lambda x: x.cast("double") / scale)
    return out if weight is None else F.zip_with(out, F.array(*[F.lit(float(w)) for w in weight]), lambda x, w: x * w)


def head_dim(width: int, heads: int) -> int:
    if width % heads:
        raise ValueError("the width must be a multiple of the heads")
    return width // heads


def mlp_hidden(width: int) -> int:
    """Two thirds of four times the width, rounded down and then up to a multiple of 64."""
    return -(-(8 * width // 3) // 64) * 64


# Fixed value: white space as text functions take it, in the notation that Java and RE2 share.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def strip(s: Column) -> Column:
    """Text without white space of any kind at both ends. The look-behind keeps long runs inside linear."""
    return F.regexp_replace(s, rf"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+$", "")


def parse_number(s: Column) -> Column:
    """Double, or null where the text is not a number: digits with single underscores between them, a point, an exponent,
    inf, infinity or nan in any case. Letters after digits, as for literals of a type, are not a number."""
    clean = F.lower(strip(s))
    unsigned = F.regexp_replace(clean, "^[+-]", "")
    sign = F.when(clean.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(unsigned.isin("inf", "infinity"), sign * float("inf")).when(unsigned == "nan", float("nan"))
    return F.when(clean.rlike(_NUMBER), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double")).otherwise(special)


def parse_hex(s: Column) -> Column:
    """The low 64 bits, as a bigint, of hexadecimal digits with or without sign and 0x, single underscores between digits; or null."""
    clean = F.lower(strip(s))
    fits = clean.rlike("^[+-]?(?:0x_?)?[0-9a-f]+(?:_[0-9a-f]+)*$")
    digits = F.replace(F.regexp_replace(clean, "^[+-]?(?:0x)?", ""), F.lit("_"), F.lit(""))
    low = F.right(F.concat(F.lit("0" * 16), digits), F.lit(16))
    half = lambda at: F.conv(F.substring(low, at, 8), 16, 10).cast("bigint")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    # The negative as a complement: there is no overflow for the smallest.
    return F.when(fits, F.when(clean.startswith("-") & (value != F.lit(-(2**63))), -value).otherwise(value))


def parse_timestamp(s: Column) -> Column:
    """yyyy/MM/dd HH:mm:ss with one to six digits of a second, in the session's time zone, or null."""
    return F.coalesce(*[F.try_to_timestamp(strip(s), F.lit(f"yyyy/MM/dd HH:mm:ss.{'S' * n}")) for n in range(1, 7)])


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval for a proportion; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = successes / n, z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return middle - half, middle + half
