"""Counter-based random numbers: a pure function of (seed, replicate, row).

Recomputing a lost task gives the same draws, and plain SQL arithmetic on
64-bit integers gives the same numbers. Called on whole Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np

MOD = 1 << 31
MULT = 73244475
STEP_REP = 668265263
STEP_ROW = 374761393
STEP_HIGH = 1274126177

# Cumulative Poisson(1) probabilities as integers on the hash scale.
POISSON_CUTS = np.array(
    [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * MOD) for k in range(12)], dtype=np.int64
)
POISSON_CUTS = POISSON_CUTS[POISSON_CUTS < MOD - 1]


def mix_np(x: np.ndarray) -> np.ndarray:
    x = ((x ^ (x >> 16)) * MULT) % MOD
    x = ((x ^ (x >> 16)) * MULT) % MOD
    return x ^ (x >> 16)


def seed_state(seed: int) -> int:
    return int(mix_np(np.array([seed % MOD], dtype=np.int64))[0])


def hash_np(seed: int, rep: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of every (rep, row) pair given by broadcasting; values in [0, 2^31)."""
    state = mix_np((seed_state(seed) + rep * STEP_REP) % MOD)
    low = mix_np((state + (row % MOD) * STEP_ROW) % MOD)
    return mix_np((low + (row // MOD) * STEP_HIGH) % MOD)


def poisson_np(h: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from hashes."""
    return np.searchsorted(POISSON_CUTS, h, side="right")
