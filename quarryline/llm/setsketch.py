"""SetSketch registers and the joint likelihood estimate of two sets' similarity.

After Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog" (2021). Each
element sends out points at exponential distances; a register keeps the nearest point
it gets, on a scale of powers of ``BASE`` cut off at both ends. The sketch of a union is
the larger register of each pair. A small base makes registers agree about as often as
the sets' similarity.
"""

from __future__ import annotations

import math

import numpy as np

from quarryline.llm.shingles import mixed

REGISTERS = 128
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Elements that send out their points at once.
PIECE = 1 << 18


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` unsigned 16-bit registers for each set of 64-bit hashes (no elements: zeros)."""
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets], float)
    todo = np.flatnonzero(sizes > 0)
    slack = math.log(m) + 3.0
    while len(todo):
        # Points farther than ``reach`` can't be the nearest once every register has one.
        reach = slack / sizes[todo]
        all_values = np.concatenate([sets[i] for i in todo])
        all_rows = np.repeat(np.arange(len(todo)), sizes[todo].astype(int))
        near = np.full(len(todo) * m, np.inf)
        for at in range(0, len(all_values), PIECE):
            value, row = all_values[at : at + PIECE], all_rows[at : at + PIECE]
            x, k = np.zeros(len(value)), 0
            with np.errstate(over="ignore"):
                while len(value):
                    k += 1
                    z = mixed(value + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
                    x = x - np.log(((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / m
                    keep = x <= reach[row]
                    x, row, value, z = x[keep], row[keep], value[keep], z[keep]
                    np.minimum.at(near, row * m + (z % np.uint64(m)).astype(np.int64), x)
        near = near.reshape(len(todo), m)
        full = np.isfinite(near).all(axis=1)
        out[todo[full]] = near[full]
        todo, slack = todo[~full], slack * 2
    with np.errstate(divide="ignore"):
        power = np.floor(1 - np.log(out / RATE) / math.log(BASE))
    return np.clip(np.where(np.isfinite(out), power, 0), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = REGISTERS, steps: int = 200) -> np.ndarray:
    """The similarity of the greatest joint likelihood, for pairs with set sizes ``n_a``, ``n_b``.

    ``above`` and ``below`` count a's registers larger and smaller than b's.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps + 1)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    fit = above[:, None] * np.log(more + tiny) + below[:, None] * np.log(less + tiny) + (m - above - below)[:, None] * np.log(np.clip(1 - more - less, tiny, 1))
    return j[np.arange(len(j)), fit.argmax(axis=1)]
