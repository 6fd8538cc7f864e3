"""A linear-chain conditional random field with two labels over sets of binary features."""

from __future__ import annotations

import numpy as np


class ChainCRF:
    def __init__(self, features: dict[str, int], weights: np.ndarray, steps: np.ndarray, ends: np.ndarray):
        self.features, self.weights, self.steps, self.ends = features, weights, steps, ends
        self.names = frozenset(f.removeprefix("name:") for f in features if f.startswith("name:"))

    def scores(self, chain: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(chain), 2))
        for i, own in enumerate(chain):
            out[i] = self.weights[[self.features[f] for f in own if f in self.features]].sum(axis=0)
        return out

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 0."""
        if not chain:
            return []
        scores = self.scores(chain).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = scores[0][0] + self.ends[0, 0], scores[0][1] + self.ends[0, 1]
        back = []
        for x, y in scores[1:]:
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        labels = [int(b + self.ends[1, 1] > a + self.ends[1, 0])]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def fit(chains: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> ChainCRF:
    """Maximum likelihood by gradient ascent; forward and backward passes over all chains at once."""
    names = sorted({f for chain, _ in chains for own in chain for f in own})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(chains), max((len(c) for c, _ in chains), default=0)
    node, feature = [], []
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, (chain, labels) in enumerate(chains):
        mask[i, :len(chain)] = True
        gold[i, :len(chain)] = labels
        for k, own in enumerate(chain):
            node += [i * longest + k] * len(own)
            feature += [number[f] for f in own]
    node, feature = np.array(node, int), np.array(feature, int)
    size = mask.sum(axis=1)
    last = (np.arange(n), np.maximum(size - 1, 0))
    some = size > 0
    w, steps, ends = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))
    params = [w, steps, ends]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    inner = mask[:, 1:]
    for turn in range(1, rounds + 1):
        scores = np.stack([np.bincount(node, w[feature, y], n * longest).reshape(n, longest) for y in (0, 1)], axis=2)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        if longest:
            alpha[:, 0] = scores[:, 0] + ends[0]
            beta[last] = ends[1]
        for k in range(1, longest):
            alpha[:, k] = scores[:, k] + np.logaddexp(alpha[:, k - 1, :1] + steps[0], alpha[:, k - 1, 1:] + steps[1])
        for k in range(longest - 2, -1, -1):
            ahead = scores[:, k + 1] + beta[:, k + 1]
            step = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
            beta[:, k] = np.where(mask[:, k + 1:k + 2], step, beta[:, k])
        total = np.logaddexp(*(alpha[last] + ends[1]).T)
        post = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        truth = np.stack([(gold == y) & mask for y in (0, 1)], axis=2)
        extra = (truth - post).reshape(-1, 2)
        g_w = np.stack([np.bincount(feature, extra[node, y], len(names)) for y in (0, 1)], axis=1)
        g_s, g_e = np.zeros((2, 2)), np.zeros((2, 2))
        for x in (0, 1):
            for y in (0, 1):
                pair = np.exp(np.where(inner, alpha[:, :-1, x] + steps[x, y] + scores[:, 1:, y] + beta[:, 1:, y] - total[:, None], -np.inf))
                g_s[x, y] = ((gold[:, :-1] == x) & (gold[:, 1:] == y) & inner).sum() - pair.sum()
        gap = truth - post
        g_e[0], g_e[1] = gap[:, 0][some].sum(axis=0), gap[last][some].sum(axis=0)
        for p, g, (m, v) in zip(params, (g_w, g_s, g_e), moment):
            g = g / max(1, n) - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return ChainCRF(number, w, steps, ends)
