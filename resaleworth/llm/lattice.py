"""Keys of vectors by random projections onto the E8 lattice."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np

from resaleworth.llm.text import mixed

DIMS = 8


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum, for each row."""
    point = np.rint(x)
    error = x - point
    worst = np.abs(error).argmax(axis=1)
    rows = np.arange(len(x))
    step = np.where(error[rows, worst] >= 0, 1.0, -1.0) * (point.sum(axis=1) % 2)
    point[rows, worst] += step
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point: of D8 or of D8 shifted by one half."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest E8 vectors: steps to the neighbouring cells."""
    out = []
    for i, j in combinations(range(DIMS), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(DIMS)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=DIMS) if np.prod(s) > 0]
    return np.array(out)


@lru_cache(maxsize=4)
def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    """``tables`` random orthonormal bases of 8 directions, side by side, scaled so that mean distances stay."""
    rng = np.random.default_rng([seed, dim])
    width = max(dim, DIMS)
    bases = [np.linalg.qr(rng.standard_normal((width, DIMS)))[0][:dim] for _ in range(tables)]
    return np.concatenate(bases, axis=1) * np.sqrt(width / DIMS)


def cell_keys(unit: np.ndarray, tables: int, probes: int, spread: float, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) keys of unit vectors: the own cell, then the nearest neighbouring cells."""
    projected = unit @ projections(unit.shape[1], tables, seed) * spread
    x = projected.reshape(-1, DIMS)
    point = nearest_e8(x)
    steps = (x - point) @ roots().T
    best = np.argpartition(-steps, probes, axis=1)[:, :probes] if probes else np.empty((len(x), 0), dtype=int)
    cells = np.concatenate([point[:, None], point[:, None] + roots()[best]], axis=1)
    packed = np.ascontiguousarray((cells * 2).astype(np.int64).astype(np.int8)).view(np.uint64)[..., 0]
    keys = packed.reshape(len(unit), tables, 1 + probes)
    with np.errstate(over="ignore"):
        table = (np.arange(tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(keys ^ mixed(table)[None, :, None]).view(np.int64)
