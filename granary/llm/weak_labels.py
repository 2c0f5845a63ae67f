"""Weak supervision: a two-class model of labellers that vote or abstain, fitted by expectation-maximisation.

It works on counts of vote patterns (a row per pattern that occurs, at most 3 to the power of the labellers), so its cost does
not depend on how many documents there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

BAD, GOOD, ABSTAIN = 0, 1, 2
#: How much more often a labeller is first taken to vote bad in the bad class than in all documents (and less often in the good
#: one), and the share of all documents that stays with that belief, so that the classes keep their names.
START_LIFT, PRIOR_STRENGTH = 8.0, 0.02


def votes_of(code: int, labellers: int) -> list[int]:
    return [code // 3**k % 3 for k in range(labellers)]


@dataclass(frozen=True)
class Model:
    """chance[y][labeller][vote]: of a vote in the bad (0) and the good (1) class; good: the share of good documents."""

    chance: list[list[list[float]]]
    good: float

    def weights(self) -> list[list[float]]:
        """weights[labeller][vote]: what the vote adds to the log odds of good."""
        return [[log(g / b) for b, g in zip(bad, good, strict=True)] for bad, good in zip(*self.chance, strict=True)]

    @property
    def bias(self) -> float:
        return log(self.good / (1 - self.good))

    def posterior(self, code: int) -> float:
        w = self.weights()
        z = self.bias + sum(w[k][v] for k, v in enumerate(votes_of(code, len(w))))
        return 1 / (1 + exp(-max(-700.0, min(700.0, z))))

    def accuracy(self) -> list[float]:
        """Of each labeller: the share of its votes that agree with the class."""
        out = []
        for bad, good in zip(*self.chance, strict=True):
            right = (1 - self.good) * bad[BAD] + self.good * good[GOOD]
            out.append(right / (right + (1 - self.good) * bad[GOOD] + self.good * good[BAD]))
        return out


def fit(patterns: dict[int, int], labellers: int, rounds: int = 100) -> Model:
    """The model of patterns {code: documents}; code is the sum of vote k times 3**k. Without documents: the start."""
    rows = [(votes_of(c, labellers), n) for c, n in sorted(patterns.items())]
    total = sum(n for _, n in rows)
    seen = [[max(1e-4, sum(n for v, n in rows if v[k] == x) / max(1, total)) for x in range(3)] for k in range(labellers)]
    start: list[list[list[float]]] = [[], []]
    for k in range(labellers):
        for y, bad in ((0, min(0.9, START_LIFT * seen[k][BAD])), (1, seen[k][BAD] / START_LIFT)):
            rest = seen[k][GOOD] + seen[k][ABSTAIN]
            start[y].append([bad, (1 - bad) * seen[k][GOOD] / rest, (1 - bad) * seen[k][ABSTAIN] / rest])
    model = Model(start, 0.9)
    keep = PRIOR_STRENGTH * total
    for _ in range(rounds if total else 0):
        w, bias = model.weights(), model.bias
        mass = [[[keep * p for p in start[y][k]] for k in range(labellers)] for y in (0, 1)]
        good_mass = 0.0
        for v, n in rows:
            z = bias + sum(w[k][x] for k, x in enumerate(v))
            p = 1 / (1 + exp(-max(-700.0, min(700.0, z))))
            good_mass += n * p
            for k, x in enumerate(v):
                mass[1][k][x] += n * p
                mass[0][k][x] += n * (1 - p)
        chance = [[[x / sum(m) for x in m] for m in mass[y]] for y in (0, 1)]
        model = Model(chance, min(0.99, max(0.01, (good_mass + keep * 0.9) / (total + keep))))
    return model
