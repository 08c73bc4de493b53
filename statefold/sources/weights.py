"""Model weights: the safetensors layout read and written with numpy alone, on the driver."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np

# Names of element types in the format.
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def load_weights(path: str | Path) -> dict[str, np.ndarray]:
    """Name -> array. bfloat16 becomes float32. Pickled files are refused: reading them runs what they say."""
    path = Path(path)
    if path.suffix != ".safetensors":
        raise ValueError(f"{path.name}: only .safetensors files are read; pickled checkpoints are not unpickled")
    raw = path.read_bytes()
    (size,) = struct.unpack("<Q", raw[:8])
    header = json.loads(raw[8 : 8 + size])
    data = memoryview(raw)[8 + size :]
    out = {}
    for name, spec in header.items():
        if name == "__metadata__":
            continue
        part = data[slice(*spec["data_offsets"])]
        if spec["dtype"] == "BF16":
            array = (np.frombuffer(part, "<u2").astype("<u4") << 16).view("<f4")
        else:
            array = np.frombuffer(part, _TYPES[spec["dtype"]])
        out[name] = array.reshape(spec["shape"])
    return out


def save_weights(weights: dict[str, np.ndarray], path: str | Path, tied: tuple[str, ...] = ("head.weight",)) -> None:
    """Write arrays; ``tied`` ones, equal to another by construction, are left out."""
    names = {np.dtype(v).str: k for k, v in _TYPES.items()}
    header, parts, at = {}, [], 0
    for name, array in weights.items():
        if name in tied:
            continue
        array = np.ascontiguousarray(array)
        header[name] = {"dtype": names[array.dtype.str], "shape": list(array.shape), "data_offsets": [at, at + array.nbytes]}
        parts.append(array.tobytes())
        at += array.nbytes
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    Path(path).write_bytes(struct.pack("<Q", len(head)) + head + b"".join(parts))


def check_keys(expected: set[str], found: set[str], optional: frozenset[str] = frozenset({"head.weight"})) -> None:
    """Raise ValueError if names are missing, other than optional ones, or unexpected."""
    missing, unexpected = expected - found - optional, found - expected - optional
    if missing or unexpected:
        raise ValueError(f"weights do not fit: missing {sorted(missing)}, unexpected {sorted(unexpected)}")
