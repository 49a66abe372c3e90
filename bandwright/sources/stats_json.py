"""Statistics as JSON: {"v": 1, "dim": [...], "data": [...]}, data in row-major order; plain lists are read too."""

from __future__ import annotations

import numpy as np

from ..errors import InvalidArgs
from .header import read_json, write_json


def save(path: str, values: np.ndarray) -> None:
    values = np.asarray(values, np.float64)
    write_json(path, {"v": 1, "dim": list(values.shape), "data": values.ravel().tolist()})


def load(path: str, channels: int | None = None) -> np.ndarray:
    """The array in a file; with channels, a vector of that length."""
    found = read_json(path, InvalidArgs)
    try:
        out = np.asarray(found, np.float64) if isinstance(found, list) else np.asarray(found["data"], np.float64).reshape(found["dim"])
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidArgs(f"{path}: {e}") from e
    if channels is not None and out.shape != (channels,):
        raise InvalidArgs(f"{path}: shape {out.shape}, not ({channels},)")
    return out
