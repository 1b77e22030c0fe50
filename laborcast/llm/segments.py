"""A semi-Markov conditional random field over a lattice of candidate segments.

A lattice has nodes (places in a text, in order) and candidate segments from one node to a later one. A labelling is a
set of segments that don't overlap, each with a type; its score adds up what the features of every whole segment weigh for
its type, and places outside segments score 0. Training maximises the probability of the labelled segments, normalised
over all labellings by the forward and backward recursions; decoding takes the best labelling jointly by the Viterbi
recursion. A segment spans a bounded number of nodes, so both are linear in the text.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

STEPS, RATE, L2 = 120, 0.1, 1e-3


@dataclass
class Lattice:
    """Candidates as (start, end, names of features, types it may have), by end; ``gold`` has the index and type of the labelled ones."""

    candidates: list[tuple[int, int, list[str], tuple[int, ...]]]
    gold: list[tuple[int, int]] = field(default_factory=list)

    def nodes(self) -> list[int]:
        return sorted({p for c in self.candidates for p in c[:2]})


@dataclass
class Model:
    """Weights per feature and type; a feature that training has not seen weighs nothing."""

    weights: dict[str, np.ndarray]
    n_types: int

    def scores(self, lattice: Lattice) -> np.ndarray:
        """candidates x types; -inf where a candidate can't have a type."""
        out = np.full((len(lattice.candidates), self.n_types), -np.inf)
        nothing = np.zeros(self.n_types)
        for row, (_, _, names, allowed) in enumerate(lattice.candidates):
            total = sum((self.weights.get(n, nothing) for n in names), nothing)
            out[row, list(allowed)] = total[list(allowed)]
        return out

    def decode(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """(start, end, type) of the segments of the best labelling, in order; of equal ones that with fewer segments."""
        nodes = lattice.nodes()
        at = {p: i for i, p in enumerate(nodes)}
        scores = self.scores(lattice)
        ending: dict[int, list[int]] = {}
        for row, c in enumerate(lattice.candidates):
            ending.setdefault(at[c[1]], []).append(row)
        best, back = [0.0] * len(nodes), [None] * len(nodes)
        for node in range(1, len(nodes)):
            best[node] = best[node - 1]
            for row in ending.get(node, ()):
                kind = int(np.argmax(scores[row]))
                value = best[at[lattice.candidates[row][0]]] + scores[row, kind]
                if value > best[node] + 1e-9:
                    best[node], back[node] = value, (row, kind)
        out, node = [], len(nodes) - 1
        while node > 0:
            if back[node] is None:
                node -= 1
            else:
                row, kind = back[node]
                out.append((*lattice.candidates[row][:2], kind))
                node = at[lattice.candidates[row][0]]
        return out[::-1]


class _Packed:
    """All lattices as flat arrays, so that a step of the recursions is one array operation for all of them."""

    def __init__(self, lattices: Sequence[Lattice], n_types: int):
        names = sorted({n for x in lattices for c in x.candidates for n in c[2]})
        self.names, number = names, {n: i for i, n in enumerate(names)}
        self.n_types, self.width = n_types, max((len(x.nodes()) for x in lattices), default=1)
        owner, start, end, gold, flat, sizes, closed = [], [], [], [], [], [], []
        for i, lattice in enumerate(lattices):
            at = {p: k for k, p in enumerate(lattice.nodes())}
            labelled = dict(lattice.gold)
            for row, (a, b, features, allowed) in enumerate(lattice.candidates):
                owner.append(i)
                start.append(at[a])
                end.append(at[b])
                gold.append(labelled.get(row, -1))
                flat += [number[n] for n in features]
                sizes.append(len(features))
                closed.append([k not in allowed for k in range(n_types)])
        self.n = len(lattices)
        self.owner, self.start, self.end, self.gold = (np.array(x, dtype=np.int64) for x in (owner, start, end, gold))
        self.flat, self.segment = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
        self.closed = np.array(closed, dtype=bool).reshape(-1, n_types)
        self.by_end = [np.flatnonzero(self.end == k) for k in range(self.width)]
        self.by_start = [np.flatnonzero(self.start == k) for k in range(self.width)]

    def loss(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative log-likelihood of the labelled segments and its gradient; ``weights`` is features x types."""
        scores = np.zeros((len(self.owner), self.n_types))
        np.add.at(scores, self.segment, weights[self.flat])
        scores[self.closed] = -np.inf
        total = np.logaddexp.reduce(scores, axis=1)
        ahead, behind = np.full((self.n, self.width), -np.inf), np.full((self.n, self.width), -np.inf)
        ahead[:, 0] = behind[:, -1] = 0.0
        for k in range(1, self.width):  # lattices with fewer nodes just carry on
            ahead[:, k] = ahead[:, k - 1]
            rows = self.by_end[k]
            np.logaddexp.at(ahead[:, k], self.owner[rows], ahead[self.owner[rows], self.start[rows]] + total[rows])
        for k in range(self.width - 2, -1, -1):
            behind[:, k] = behind[:, k + 1]
            rows = self.by_start[k]
            np.logaddexp.at(behind[:, k], self.owner[rows], behind[self.owner[rows], self.end[rows]] + total[rows])
        whole = ahead[:, -1]
        outside = ahead[self.owner, self.start] + behind[self.owner, self.end] - whole[self.owner]
        change = np.exp(scores + outside[:, None])  # the probability of each segment and type
        labelled = np.flatnonzero(self.gold >= 0)
        change[labelled, self.gold[labelled]] -= 1
        gradient = np.zeros_like(weights)
        np.add.at(gradient, self.flat, change[self.segment])
        return float(whole.sum() - scores[labelled, self.gold[labelled]].sum()), gradient


def fit(lattices: Sequence[Lattice], n_types: int, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Model:
    """The weights that maximise the likelihood of the labelled segments with an L2 penalty, by full steps of Adam."""
    packed = _Packed(lattices, n_types)
    weights = np.zeros((len(packed.names), n_types))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        _, gradient = packed.loss(weights)
        gradient = gradient / max(1, packed.n) + l2 * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(packed.names, weights)), n_types)
