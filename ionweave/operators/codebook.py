"""Codebooks: a vector of signs for each level of intensity and each bin of m/z."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ionweave.config import Settings
from ionweave.functions.peaks import bin_count


@dataclass(frozen=True)
class Codebook:
    """Signs as packed bits, 1 for +1: ``levels`` (q + 1 rows) and ``bins``, ``dim`` bits a row."""

    levels: np.ndarray
    bins: np.ndarray
    dim: int


def pack(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs > 0, axis=1)


def level_signs(dim: int, q: int, rng: np.random.RandomState) -> np.ndarray:
    """Level 0 is a random half of +1; each next level has a longer beginning of it negated, half of it for the last."""
    start = np.ones(dim, dtype=np.int8)
    start[: dim // 2] = -1
    zero = rng.permutation(start.astype(float)).astype(np.int8)
    turned = (np.array([int(k / float(q) * dim) for k in range(q + 1)]) // 2)[:, None]
    return np.where(np.arange(dim) < turned, -zero, zero)


def bin_signs(dim: int, n: int, flip: float, rng: np.random.RandomState) -> np.ndarray:
    """A chain: normal signs first, then each vector is the one before with places drawn with replacement negated."""
    current = rng.normal(0, 1, dim) > 0
    out = np.empty((n, (dim + 7) // 8), dtype=np.uint8)
    out[0] = np.packbits(current)
    for k in range(1, n):
        current[np.unique(rng.randint(0, dim, size=int(dim // flip)))] ^= True
        out[k] = np.packbits(current)
    return out


#: Bytes of a codebook that may be broadcast.
LARGEST = 1 << 28


def build(s: Settings) -> Codebook:
    """The codebook of the settings. Its size depends on them only (under 10 MB by default), so it may be broadcast; settings
    that ask for more than ``LARGEST`` bytes are refused."""
    n = int(s.max_mz or 2000.0) + 1 if s.mz_binning == "unit" else bin_count(s.min_mz or 0.0, s.max_mz or 2000.0, s.fragment_tol)
    if (n + s.hd_Q + 1) * s.hd_dim // 8 > LARGEST:
        raise ValueError(f"hd_dim {s.hd_dim} and {n} bins make a codebook of more than {LARGEST >> 20} MB")
    return _build(s.hd_dim, s.hd_Q, n, s.hd_id_flip_factor, s.seed)


@lru_cache(maxsize=4)
def _build(dim: int, q: int, n: int, flip: float, seed: int) -> Codebook:
    # vectors of bins are a chain, so more of them begin with the same ones
    rng = np.random.RandomState(seed)
    levels = pack(level_signs(dim, q, rng))
    return Codebook(levels, bin_signs(dim, n, flip, rng), dim)
