"""A tree of term subsets for all-subsets selection of random-intercept models.

Terms are decided in order; a node has decided the first of them.  Leaving a
term out costs nothing, and taking it in is one sweep step on the parent's
cross products, for all variance ratios of the grid at once.  A product is only
taken in where all its factors are.

With a limit on the distance to the best criterion, a branch is cut when not
even its best subset can come within it.  The bound holds for every subset of
the branch: with r of the open terms taken in, the others are dropped from the
model that has them all, and dropping a set raises its residual sum of squares
by at least the sum of their squared scores divided by the largest eigenvalue
of the scores' correlation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from sitepanel.functions.numerics import falling_roots
from sitepanel.operators.mixed import EXACT, THETA_GRID, WIDEST, aicc_of
from sitepanel.operators.moments import PooledMoments

LEAVES = 256  # subsets that are fitted together
SLACK = 0.01  # of a bound that cuts, for rounding
# Between the points of the grid a bound holds for whole ranges of ratios, which are halved until all of them
# cut or one can't. A search that asks for more ranges or halvings than these doesn't cut.
MOST_RANGES, HALVINGS = 4096, 40
# Ends of the ranges beyond the grid.
FAR_THETAS = 10.0 ** np.array([8.0, 10.0, 12.0, 14.0])


def step(a: np.ndarray, j: int) -> np.ndarray:
    """Stacked matrices with predictor ``j`` swept in."""
    pivot = a[:, j, j]
    row = a[:, j, :] / pivot[:, None]
    out = a - a[:, :, j, None] * row[:, None, :]
    out[:, j, :] = out[:, :, j] = row
    out[:, j, j] = -1.0 / pivot
    return out


def unstep(a: np.ndarray, j: int) -> np.ndarray:
    """Stacked matrices with predictor ``j`` swept out again."""
    pivot = a[:, j, j]
    row = -a[:, j, :] / pivot[:, None]
    out = a + a[:, :, j, None] * row[:, None, :]
    out[:, j, :] = out[:, :, j] = row
    out[:, j, j] = -1.0 / pivot
    return out


@dataclass
class Node:
    """A branch: ``subset`` of the first ``depth`` terms, and the swept cross products by variance ratio."""

    subset: int
    depth: int
    inside: np.ndarray
    log_det: np.ndarray
    most: np.ndarray | None  # the same with all open terms


class SubsetTree:
    """All allowed subsets of ``terms`` for one response, from pooled moments.

    ``theta`` fixes the variance ratio.  ``within`` limits the search to subsets
    whose criterion is at most that far above the best.
    """

    def __init__(
        self, pooled: PooledMoments, response: str, terms: Sequence[str], reml: bool, theta: float | None = None,
        within: float | None = None,
    ):
        index = [0, *[pooled.index(t) for t in terms], pooled.index(response)]
        classes, block = pooled.classes, np.ix_(index, index)
        total = classes.total[block]
        self.scale = np.sqrt(np.where(np.diag(total) > 0, np.diag(total), 1.0))
        grid = np.outer(self.scale, self.scale)
        self.total = total / grid
        self.outer = np.array([o[block] for o in classes.outer]) / grid
        self.sizes, self.weights = classes.sizes, classes.weights
        self.shift = np.array([pooled.shift[t] for t in terms])
        self.level = pooled.shift[response]
        self.n = float(total[0, 0])
        self.terms, self.reml, self.fixed, self.within = list(terms), reml, theta, within
        self.q = len(terms)
        self.needs = [
            sum(1 << self.terms.index(f) for f in t.split(":") if ":" in t and f in self.terms) for t in self.terms
        ]
        self.thetas = THETA_GRID if theta is None else np.array([theta])
        self.best = math.inf

    # Likelihood -------------------------------------------------------------

    def grams(self, thetas: np.ndarray) -> np.ndarray:
        k = thetas[:, None] / (1.0 + self.sizes[None, :] * thetas[:, None])
        return self.total[None] - np.tensordot(k, self.outer, axes=1)

    def log_sites(self, thetas: np.ndarray) -> np.ndarray:
        return (self.weights * np.log1p(self.sizes * thetas[:, None])).sum(axis=1)

    def log_lik(self, rss, log_det, log_sites, rank):
        """``rss`` and ``log_det`` are scaled; ``log_det`` already holds the terms' own scales."""
        d = self.n - rank if self.reml else self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            value = -0.5 * (d * np.log(2 * math.pi * rss * self.scale[-1] ** 2 / d) + log_sites + d)
        return value - 0.5 * log_det if self.reml else value

    def criterion(self, log_lik: float, rank: int) -> float:
        return aicc_of(log_lik, rank + (1 if self.fixed == 0 else 2), self.n)

    def penalties(self, ranks: np.ndarray) -> np.ndarray:
        """What the criterion adds to -2 log-likelihood; infinite where it is undefined."""
        k = ranks + (1 if self.fixed == 0 else 2)
        left = self.n - k - 1
        return np.where(left > 0, 2.0 * k + 2.0 * k * (k + 1) / np.where(left > 0, left, 1.0), math.inf)

    # Tree -------------------------------------------------------------------

    def root(self) -> Node:
        a = self.grams(self.thetas)
        log_det = np.log(a[:, 0, 0]) + 2 * math.log(self.scale[0])
        inside = step(a, 0)
        return Node(0, 0, inside, log_det, None if self.within is None else self._all_open(inside, 0, 0))

    def node(self, subset: int, depth: int) -> Node:
        """The node of a subset of the first ``depth`` terms, from the root."""
        node = self.root()
        for j in range(depth):
            node = self._child(node, bool(subset >> j & 1))
        return node

    def _all_open(self, inside: np.ndarray, subset: int, depth: int) -> np.ndarray:
        most = inside
        for j in self.open(subset, depth):
            most = step(most, j + 1)
        return most

    def open(self, subset: int, depth: int) -> list[int]:
        """Undecided terms that a subset of the branch may still hold."""
        reach = subset | sum(1 << j for j in range(depth, self.q))
        return [j for j in range(depth, self.q) if reach & self.needs[j] == self.needs[j]]

    def _child(self, node: Node, take: bool) -> Node:
        j = node.depth
        if not take:
            most = node.most
            if most is not None:
                gone = set(self.open(node.subset, j)) - set(self.open(node.subset, j + 1))
                for i in sorted(gone):
                    most = unstep(most, i + 1)
            return Node(node.subset, j + 1, node.inside, node.log_det, most)
        log_det = node.log_det + np.log(node.inside[:, j + 1, j + 1]) + 2 * math.log(self.scale[j + 1])
        return Node(node.subset | 1 << j, j + 1, step(node.inside, j + 1), log_det, node.most)

    def children(self, node: Node) -> list[Node]:
        j = node.depth
        takes = [True, False] if node.subset & self.needs[j] == self.needs[j] else [False]
        return [c for c in (self._child(node, take) for take in takes) if not self.hopeless(c)]

    def _least(self, node_log_det, most: np.ndarray, taken: int, free: list[int]) -> np.ndarray:
        """By variance ratio, a criterion less the sites' logarithms that no subset of the branch goes below.

        Residual sums of squares and determinants fall as the ratio grows, so it holds for all smaller ratios too.
        """
        places = [j + 1 for j in free]
        r = np.arange(len(free) + 1)
        inverse = -most[np.ix_(range(len(most)), places, places)]
        spread = np.diagonal(inverse, axis1=1, axis2=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = most[:, places, -1] ** 2 / spread if free else np.zeros((len(most), 0))
            if len(free) > 1:
                root = np.sqrt(spread)
                alike = inverse / (root[:, :, None] * root[:, None, :])
                sound = np.isfinite(alike).all(axis=(1, 2))
                widest = np.full(len(most), math.nan)
                widest[sound] = np.linalg.eigvalsh(alike[sound])[:, -1]
            else:
                widest = np.ones(len(most))
            # with r terms taken in, at best those with the smallest scores are dropped
            lost = np.cumsum(np.sort(scores, axis=1), axis=1)
            lost = np.concatenate([np.zeros((len(most), 1)), lost], axis=1)[:, ::-1] / widest[:, None]
            rss = most[:, -1, -1][:, None] + lost
            log_det = node_log_det[:, None]
            if self.reml:
                own = np.sort(-np.log(spread) + 2 * np.log(self.scale[places]), axis=1) if free else scores
                log_det = log_det + np.concatenate([np.zeros((len(most), 1)), np.cumsum(own, axis=1)], axis=1)
            ranks = 1 + taken + r
            penalties = self.penalties(ranks)[None, :]
            least = -2.0 * self.log_lik(rss, log_det, 0.0, ranks[None, :]) + penalties
        # what can't be told is no bound
        least = np.where(np.isinf(penalties), math.inf, np.where(np.isnan(least), -math.inf, least))
        return least.min(axis=1)

    def _least_of(self, subset: int, depth: int, thetas: np.ndarray) -> np.ndarray:
        """``_least`` of the branch at other ratios than the grid's."""
        a = self.grams(thetas)
        with np.errstate(divide="ignore", invalid="ignore"):
            log_det = np.log(a[:, 0, 0]) + 2 * math.log(self.scale[0])
            a = step(a, 0)
            for j in range(self.q):
                if subset >> j & 1:
                    log_det = log_det + np.log(a[:, j + 1, j + 1]) + 2 * math.log(self.scale[j + 1])
                    a = step(a, j + 1)
            return self._least(log_det, self._all_open(a, subset, depth), subset.bit_count(), self.open(subset, depth))

    def hopeless(self, node: Node) -> bool:
        """Whether no subset of the branch can come within the limit, at any variance ratio."""
        if self.within is None or not math.isfinite(self.best):
            return False
        limit = self.best + self.within + SLACK
        subset, depth = node.subset, node.depth
        least = self._least(node.log_det, node.most, subset.bit_count(), self.open(subset, depth))
        sites = self.log_sites(self.thetas)
        if not (least + sites > limit).all():
            return False
        if self.fixed is not None:
            return True
        # The sites' logarithms grow with the ratio, the rest falls: the first at a range's lower end and
        # the second at its upper end bound the whole range.
        low, high = np.append(self.thetas, FAR_THETAS[:-1]), np.append(self.thetas[1:], FAR_THETAS)
        above, below = np.append(least[1:], self._least_of(subset, depth, FAR_THETAS)), np.append(sites, self.log_sites(FAR_THETAS[:-1]))
        for _ in range(HALVINGS):
            left = ~(above + below > limit)
            if not left.any():
                return True
            if left.sum() > MOST_RANGES:
                return False
            low, high, above, below = low[left], high[left], above[left], below[left]
            middle = np.where(low > 0, np.sqrt(low * high), 0.5 * high)
            least, sites = self._least_of(subset, depth, middle), self.log_sites(middle)
            if not (least + sites > limit).all():
                return False
            low, high = np.append(low, middle), np.append(middle, high)
            above, below = np.append(least, above), np.append(below, sites)
        return False

    def branches(self, wanted: int) -> list[tuple[int, int]]:
        """At least ``wanted`` branches (subset, depth) that together hold every subset still possible, or all of them."""
        level = [self.root()]
        while level and len(level) < wanted and level[0].depth < self.q:
            level = [child for node in level for child in self.children(node)]
        return [(node.subset, node.depth) for node in level]

    def leaves(self, node: Node) -> Iterator[Node]:
        open_nodes = [node]
        while open_nodes:
            node = open_nodes.pop()
            if node.depth == self.q:
                yield node
            else:
                open_nodes += reversed(self.children(node))

    # Fits -------------------------------------------------------------------

    def _swept(self, masks: np.ndarray, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross products of each subset at its own variance ratio, its terms swept in, and log-determinants."""
        a = self.grams(thetas)
        log_det = np.log(a[:, 0, 0]) + 2 * math.log(self.scale[0])
        a = step(a, 0)
        for j in range(self.q):
            mine = np.flatnonzero(masks[:, j])
            if len(mine):
                log_det[mine] += np.log(a[mine, j + 1, j + 1]) + 2 * math.log(self.scale[j + 1])
                a[mine] = step(a[mine], j + 1)
        return a, log_det

    def _slope(self, masks: np.ndarray, thetas: np.ndarray) -> np.ndarray:
        """Slope of the profile log-likelihood in the variance ratio."""
        a, _ = self._swept(masks, thetas)
        weight = -1.0 / (1.0 + self.sizes[None, :] * thetas[:, None]) ** 2
        change = np.tensordot(weight, self.outer, axes=1)
        taken = np.concatenate([np.ones((len(masks), 1)), masks, np.zeros((len(masks), 1))], axis=1)
        contrast = -a[:, :, -1] * taken
        contrast[:, -1] = 1.0
        d_rss = np.einsum("ti,tij,tj->t", contrast, change, contrast)
        d = self.n - 1.0 - masks.sum(axis=1) if self.reml else self.n
        d_sites = (self.weights * self.sizes / (1.0 + self.sizes * thetas[:, None])).sum(axis=1)
        slope = -0.5 * (d * d_rss / a[:, -1, -1] + d_sites)
        if self.reml:
            slope += 0.5 * np.einsum("tij,tij,ti,tj->t", a, change, taken, taken)
        return slope

    def _best_thetas(self, masks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Roots of the slope around the best grid points, all subsets together."""
        grid, last = self.thetas, len(self.thetas) - 1
        slope = self._slope(masks, grid[starts])
        rising = slope > 0
        low = np.where(rising, grid[starts], grid[np.maximum(starts - 1, 0)])
        high = np.where(rising, grid[np.minimum(starts + 1, last)], grid[starts])
        for place in np.flatnonzero(rising & (starts == last)):
            while high[place] < WIDEST and self._slope(masks[[place]], high[[place]])[0] > 0:
                low[place], high[place] = high[place], high[place] * 100.0
        root = falling_roots(lambda which, at: self._slope(masks[which], at), low, high)
        return np.where(np.isnan(root), grid[starts], root)

    def fits(self, leaves: Sequence[Node]) -> list[tuple]:
        """(subset, rank, theta, log_lik, criterion, estimates, std_errors) of each leaf."""
        subsets = [leaf.subset for leaf in leaves]
        masks = np.array([[bool(s >> j & 1) for j in range(self.q)] for s in subsets], dtype=bool).reshape(len(subsets), self.q)
        ranks = 1 + masks.sum(axis=1)
        exact = ~(self._swept(masks, np.zeros(len(masks)))[0][:, -1, -1] > EXACT)
        if self.fixed is None:
            log_sites = self.log_sites(self.thetas)
            profiles = [
                self.log_lik(leaf.inside[:, -1, -1], leaf.log_det, log_sites, rank) for leaf, rank in zip(leaves, ranks)
            ]
            starts = np.array([0 if e or not np.isfinite(p).any() else int(np.nanargmax(p)) for p, e in zip(profiles, exact)])
            thetas = np.zeros(len(masks))
            thetas[~exact] = self._best_thetas(masks[~exact], starts[~exact]) if (~exact).any() else 0.0
        else:
            thetas = np.full(len(masks), float(self.fixed))
        a, log_det = self._swept(masks, thetas)
        rss = np.maximum(a[:, -1, -1], 0.0)
        values = self.log_lik(rss, log_det, self.log_sites(thetas), ranks)
        variance = rss * self.scale[-1] ** 2 / (self.n - ranks if self.reml else self.n)
        slopes = np.where(masks, a[:, 1:-1, -1], 0.0) * self.scale[-1] / self.scale[1:-1]
        taken = np.concatenate([np.ones((len(masks), 1), dtype=bool), masks], axis=1)
        cov = -a[:, :-1, :-1] / np.outer(self.scale[:-1], self.scale[:-1]) * (taken[:, :, None] & taken[:, None, :])
        lean = np.concatenate([np.ones((len(masks), 1)), np.where(masks, -self.shift, 0.0)], axis=1)
        first = a[:, 0, -1] * self.scale[-1] / self.scale[0] + self.level - slopes @ self.shift
        first_var = np.einsum("ti,tij,tj->t", lean, cov, lean)
        out = []
        for t, subset in enumerate(subsets):
            log_lik = math.nan if exact[t] else float(values[t])
            criterion = math.nan if exact[t] else self.criterion(log_lik, int(ranks[t]))
            estimates = [float(first[t]), *[float(b) if m else None for b, m in zip(slopes[t], masks[t])]]
            spread = [first_var[t], *[cov[t, j + 1, j + 1] for j in range(self.q)]]
            errors = [math.sqrt(max(v * variance[t], 0.0)) if k else None for v, k in zip(spread, taken[t])]
            out.append((subset, int(ranks[t]), float(thetas[t]), log_lik, criterion, estimates, errors))
            if criterion < self.best:
                self.best = criterion
        return out

    def search(self, subset: int, depth: int) -> Iterator[list[tuple]]:
        """Fits of the branch's subsets, LEAVES at a time; with a limit each lot sharpens the cuts."""
        lot = []
        for leaf in self.leaves(self.node(subset, depth)):
            lot.append(leaf)
            if len(lot) == (LEAVES if self.within is None else 16):
                yield self.fits(lot)
                lot = []
        if lot:
            yield self.fits(lot)

    def descend(self) -> None:
        """A first good criterion: from the full and the empty model, the best single change while it helps."""
        full = sum(1 << j for j in range(self.q))
        for subset in (full, 0):
            current = self.fits([self.node(subset, self.q)])[0]
            while True:
                options = [subset ^ 1 << j for j in range(self.q)]
                options = [s for s in options if all(not s >> j & 1 or s & self.needs[j] == self.needs[j] for j in range(self.q))]
                tried = min(self.fits([self.node(s, self.q) for s in options]), key=lambda f: f[4], default=None)
                if tried is None or not tried[4] < current[4]:
                    break
                current, subset = tried, tried[0]
