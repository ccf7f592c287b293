"""Linear-chain conditional random fields in numpy.

All sequences of a batch are laid end to end as one chain. A position that starts a sequence takes the start
scores whatever state came before, so messages never leak across sequences. The chain is cut into blocks of equal
length: block products of the transition matrices carry the messages from block to block, and within the blocks one
numpy step moves every block by one position. A long sequence therefore costs no more a position than short ones,
and memory is linear in the number of positions.
"""

from __future__ import annotations

import numpy as np


def _messages(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages [positions, states]; sums over paths, or maxima if best."""
    n, k = emit.shape
    reduce = np.max if best else np.sum
    size = int(max(16, min(512, np.sqrt(max(n, 1)))))
    blocks = -(-n // size)
    e = np.ones((blocks * size, k))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    head = np.ones(blocks * size, bool)
    head[:n] = first
    head[0] = True
    e, head = e.reshape(blocks, size, k), head.reshape(blocks, size)
    t, s = np.exp(trans), np.exp(start)
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(size):
        step = reduce(product[:, :, :, None] * t[None, None], axis=2)
        at = head[:, i]
        if at.any():
            step[at] = reduce(product[at], axis=2)[:, :, None] * s
        product = step * e[:, i, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    a = np.ones(k)
    for b in range(blocks):
        into[b] = a
        a = reduce(a[:, None] * product[b], axis=0)
        a = a / a.max()
    z = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = z
        z = reduce(product[b] * z[None, :], axis=1)
        z = z / z.max()
    alpha, beta = np.empty((blocks, size, k)), np.empty((blocks, size, k))
    a = into
    for i in range(size):
        step = reduce(a[:, :, None] * t[None], axis=1)
        at = head[:, i]
        if at.any():
            step[at] = s * reduce(a[at], axis=1)[:, None]
        a = step * e[:, i]
        a = a / a.max(axis=1, keepdims=True)
        alpha[:, i] = a
    z = out
    for i in range(size - 1, -1, -1):
        beta[:, i] = z
        right = e[:, i] * z
        step = reduce(t[None] * right[:, None, :], axis=2)
        at = head[:, i]
        if at.any():
            step[at] = reduce(s * right[at], axis=1)[:, None]
        z = step / step.max(axis=1, keepdims=True)
    return alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]


def marginals(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward: probability of each state at each position."""
    if not len(emit):
        return np.zeros(emit.shape)
    a, b = _messages(emit, trans, start, first, best=False)
    p = a * b
    return p / p.sum(axis=1, keepdims=True)


def viterbi(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best path's state at each position, from max-product messages (ties: the lower state)."""
    if not len(emit):
        return np.zeros(0, np.int64)
    a, b = _messages(emit, trans, start, first, best=True)
    return np.argmax(a * b, axis=1)


def train(features: np.ndarray, states: np.ndarray, mask: np.ndarray, n_features: int, k: int, rounds: int = 150, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum likelihood with Adam on sequences padded to one length.

    features: [sequences, length, active] feature ids, -1 where absent; states: [sequences, length]; mask: real positions.
    Returns (weights [n_features, k], transitions [k, k], start [k]).
    """
    m, length, _ = features.shape
    w = np.zeros((n_features + 1, k))  # the last row stands for absent features
    trans, start = np.zeros((k, k)), np.zeros(k)
    gold = np.eye(k)[states] * mask[:, :, None]
    pairs = mask[:, 1:] & mask[:, :-1]
    gold_trans = np.einsum("mli,mlj->ij", gold[:, :-1] * pairs[:, :, None], gold[:, 1:])
    gold_start = gold[:, 0].sum(axis=0)
    flat = features.reshape(m * length, -1)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans, start)]
    for step in range(1, rounds + 1):
        emit = w[flat].sum(axis=1).reshape(m, length, k)
        emit = np.where(mask[:, :, None], emit - emit.max(axis=2, keepdims=True), 0.0)
        e, t, s = np.exp(emit), np.exp(trans), np.exp(start)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((m, length))
        a = s * e[:, 0]
        for i in range(length):
            if i:
                a = np.where(mask[:, i, None], (a @ t) * e[:, i], a)
            scale[:, i] = a.sum(axis=1)
            a = a / scale[:, i, None]
            alpha[:, i] = a
        for i in range(length - 2, -1, -1):
            back = ((e[:, i + 1] * beta[:, i + 1]) @ t.T) / scale[:, i + 1, None]
            beta[:, i] = np.where(mask[:, i + 1, None], back, 1.0)
        p = alpha * beta
        p = p / p.sum(axis=2, keepdims=True) * mask[:, :, None]
        joint = np.einsum("mli,mlj->ij", np.where(pairs[:, :, None], alpha[:, :-1] / scale[:, 1:, None], 0.0), e[:, 1:] * beta[:, 1:]) * t
        diff = (gold - p).reshape(m * length, k)
        grad_w = np.stack([np.bincount(flat.ravel() % (n_features + 1), weights=np.repeat(diff[:, j], flat.shape[1]), minlength=n_features + 1) for j in range(k)], axis=1)
        grad_w[-1] = 0
        size = mask.sum()
        for x, g, (m1, m2) in zip((w, trans, start), (grad_w, gold_trans - joint, gold_start - p[:, 0].sum(axis=0)), moments, strict=True):
            g = g / size - decay * x
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    w[-1] = 0
    return w, trans, start
