"""Linear-chain conditional random fields in numpy, batched over many chains at once.

Every position has a fixed number of feature ids; its emission scores are the sum of their weight rows. Chains come one
after the other in flat arrays with their lengths. Forward-backward and Viterbi walk all chains side by side, longest
first, so a step costs one small matrix operation however many chains there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray  # feature id x label
    moves: np.ndarray  # label x label
    first: np.ndarray
    last: np.ndarray

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[ids].sum(axis=1)

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of every position; of equal paths the one with smaller labels from the end back."""
        labels = np.zeros(len(emissions), np.int16)
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return labels
        n, start = lengths[order], starts[order]
        back: list[np.ndarray] = []
        score = emissions[start] + self.first
        active = len(order)
        final = np.empty_like(score)
        for t in range(1, int(n[0]) + 1):
            still = int(np.searchsorted(-n, -t, "left"))  # chains longer than t
            final[still:active] = score[still:active] + self.last
            active = still
            if not active:
                break
            through = score[:active, :, None] + self.moves
            best = through.argmax(axis=1)
            back.append(best.astype(np.int8))
            score = np.take_along_axis(through, best[:, None, :], axis=1)[:, 0] + emissions[start[:active] + t]
        now = final.argmax(axis=1)
        for t in range(int(n[0]) - 1, 0, -1):
            active = len(back[t - 1])
            labels[start[:active] + t] = now[:active]
            now[:active] = back[t - 1][np.arange(active), now[:active]]
        labels[start] = now
        return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, features: int, kinds: int, rounds: int = 120, step: float = 0.15, decay: float = 0.02) -> Crf:
    """Full-batch Adam on the penalised conditional likelihood; deterministic.

    ``ids``: position x feature; ``decay`` pulls all weights to zero, so features never seen say nothing.
    """
    lengths = np.asarray(lengths, np.int64)
    model = Crf(np.zeros((features, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds), np.zeros(kinds))
    starts = np.cumsum(lengths) - lengths
    top, chains = int(lengths.max()), len(lengths)
    there = np.arange(top) < lengths[:, None]
    flat = starts[:, None] + np.minimum(np.arange(top), lengths[:, None] - 1)
    used, slot = np.unique(ids, return_inverse=True)
    slot = slot.reshape(ids.shape)
    truth = np.eye(kinds)[labels]
    held = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in (("w", np.zeros((len(used), kinds))), ("m", model.moves), ("a", model.first), ("z", model.last))}
    w = np.zeros((len(used), kinds))
    real_moves = np.zeros((kinds, kinds))
    follows = np.ones(len(labels), bool)
    follows[starts] = False
    np.add.at(real_moves, (labels[np.flatnonzero(follows) - 1], labels[follows]), 1)
    for t in range(1, rounds + 1):
        e = w[slot].sum(axis=1)[flat]
        fwd = np.zeros((chains, top, kinds))
        bwd = np.zeros((chains, top, kinds))
        fwd[:, 0] = e[:, 0] + model.first
        for i in range(1, top):
            new = _lse(fwd[:, i - 1, :, None] + model.moves, 1) + e[:, i]
            fwd[:, i] = np.where(there[:, i, None], new, fwd[:, i - 1])
        norm = _lse(fwd[:, -1] + model.last, 1)
        bwd[:, -1] = model.last
        for i in range(top - 2, -1, -1):
            new = _lse(model.moves + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(there[:, i + 1, None], new, model.last)
        chance = np.exp(fwd + bwd - norm[:, None, None]) * there[:, :, None]
        pos = np.zeros((len(labels), kinds))
        pos[flat[there]] = chance[there]
        pair = np.zeros((kinds, kinds))
        for i in range(1, top):
            x = np.exp(fwd[:, i - 1, :, None] + model.moves + (e[:, i] + bwd[:, i])[:, None, :] - norm[:, None, None])
            pair += (x * there[:, i, None, None]).sum(axis=0)
        gap = truth - pos
        grad_w = np.stack([np.bincount(slot.ravel(), np.repeat(gap[:, k], ids.shape[1]), len(used)) for k in range(kinds)], axis=1)
        ends = starts + lengths - 1
        for key, value, grad in (("w", w, grad_w), ("m", model.moves, real_moves - pair), ("a", model.first, gap[starts].sum(axis=0)), ("z", model.last, gap[ends].sum(axis=0))):
            g = grad / chains - decay * value / 10
            a, b = held[key]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            value += step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    model.weights[used] = w
    return model
