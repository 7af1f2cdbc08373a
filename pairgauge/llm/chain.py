"""Two-state linear chains over many texts at once.

Forward and backward vectors are prefix products of 2x2 matrices. Texts are laid end to end, a matrix
that forgets the past stands at each beginning, and the products run over blocks of steps so that
every array operation covers all blocks.
"""

from __future__ import annotations

import numpy as np

STEP = 32


def _sequential(mats: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty((len(mats), 2))
    v = first
    for t in range(len(mats)):
        v = v @ mats[t]
        v = v / v.sum()
        out[t] = v
    return out


def prefix(mats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised row vectors v[t] = v[t-1] @ mats[t], beginning with ``first`` before t = 0."""
    n = len(mats)
    if n <= STEP:
        return _sequential(mats, first)
    blocks = -(-n // STEP)
    padded = np.empty((blocks * STEP, 2, 2))
    padded[:n] = mats
    padded[n:] = np.eye(2)
    padded = padded.reshape(blocks, STEP, 2, 2)
    a, b, c, d = (np.ascontiguousarray(padded[:, :, i, j].T) for i in (0, 1) for j in (0, 1))
    p, q, r, s = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for t in range(1, STEP):
        p, q, r, s = (
            p * a[t] + q * c[t],
            p * b[t] + q * d[t],
            r * a[t] + s * c[t],
            r * b[t] + s * d[t],
        )
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    whole = np.stack([np.stack([p, q], -1), np.stack([r, s], -1)], 1)
    ends = prefix(whole, first)
    x = np.concatenate([first[:1], ends[:-1, 0]])
    y = np.concatenate([first[1:], ends[:-1, 1]])
    out = np.empty((STEP, blocks, 2))
    for t in range(STEP):
        x, y = x * a[t] + y * c[t], x * b[t] + y * d[t]
        size = x + y
        x, y = x / size, y / size
        out[t, :, 0], out[t, :, 1] = x, y
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def marginals(
    emission: np.ndarray, begins: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False
):
    """Chance of state 1 at every token, and with ``pairs`` the expected moves summed over all tokens.

    emission: score of state 1 against state 0; begins: True at the first token of each text;
    start and moves: positive potentials of shape (2,) and (2, 2).
    """
    n = len(emission)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2))
    top = np.exp(np.clip(emission, -30, 30))
    forward = np.empty((n, 2, 2))
    forward[:, 0, 0], forward[:, 1, 0] = moves[0, 0], moves[1, 0]
    forward[:, 0, 1], forward[:, 1, 1] = moves[0, 1] * top, moves[1, 1] * top
    forward[begins, :, 0] = start[0]
    forward[begins, :, 1] = (start[1] * top[begins])[:, None]
    ahead = prefix(forward, np.array([0.5, 0.5]))
    backward = np.empty((n, 2, 2))  # from the vector at t to the one at t - 1
    backward[:, 0, 0], backward[:, 0, 1] = moves[0, 0], moves[1, 0]
    backward[:, 1, 0], backward[:, 1, 1] = moves[0, 1] * top, moves[1, 1] * top
    backward[begins] = 1.0
    back = np.empty((n, 2))
    back[-1] = 0.5
    back[:-1] = prefix(backward[:0:-1], np.array([0.5, 0.5]))[::-1]
    both = ahead * back
    chance = both[:, 1] / both.sum(1)
    if not pairs:
        return chance, None
    inner = np.flatnonzero(~begins)
    joint = (
        ahead[inner - 1][:, :, None]
        * moves[None]
        * np.stack([np.ones(len(inner)), top[inner]], 1)[:, None, :]
        * back[inner][:, None, :]
    )
    joint /= joint.sum((1, 2), keepdims=True)
    return chance, joint.sum(0)
