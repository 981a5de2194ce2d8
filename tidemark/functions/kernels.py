"""Small numeric kernels for aggregates that the driver holds: panels, daily series, edges."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np


def beta_inc(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + numerator * d, 1 + numerator / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t) or df <= 0:
        return 0.0 if math.isinf(t) and df > 0 else math.nan
    return beta_inc(df / (df + t * t), df / 2, 0.5)


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


@lru_cache(maxsize=32)
def _sums_up_to(parts: int) -> tuple[int, list[int]]:
    """(period, counts): the generating function 1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^parts)) as counts(q) / (1 - q^period)^(parts + 1)."""
    period = math.lcm(*range(1, parts + 1))
    counts = [1]
    for step in (1, *range(1, parts + 1)):
        grown = [0] * (len(counts) + period - step)
        for shift in range(0, period, step):
            for k, c in enumerate(counts):
                grown[k + shift] += c
        counts = grown
    return period, counts


def _arrangements_up_to(u: int, small: int, large: int) -> int:
    """How many of the C(small + large, small) arrangements without ties have a Mann-Whitney statistic of at most u.

    They are counted by the Gaussian binomial coefficient: the product of (1 - q^(large + k)) / (1 - q^k) for k up to small. Its numerator has 2^small terms and the
    rest is known in closed form, so the count takes the same few steps whatever the size of the larger side.
    """
    period, counts = _sums_up_to(small)
    total = 0
    for chosen in range(1 << small):
        k = u - sum(large + i + 1 for i in range(small) if chosen >> i & 1)
        if k >= 0:
            ways = sum(counts[r] * math.comb((k - r) // period + small, small) for r in range(k % period, min(k + 1, len(counts)), period))
            total += -ways if chosen.bit_count() % 2 else ways
    return total


def exact_rank_sum(u: float, na: int, nb: int) -> float:
    """Exact two-sided p of the Mann-Whitney statistic without ties: the share of arrangements as far out. Meant for a smaller side of few values."""
    small, large = sorted((na, nb))
    lower = math.floor(min(u, na * nb - u) + 1e-9)
    ways, whole = _arrangements_up_to(lower, small, large), math.comb(small + large, small)
    return float(min(1, Fraction(2 * ways, whole)))


def mean_difference_interval(a: np.ndarray, b: np.ndarray, draws: int = 500, seed: int = 42) -> tuple[float, float]:
    """Bootstrap interval (95 %) of mean(a) - mean(b); NaN if either is empty. The values are sorted first: their order does not matter."""
    if not len(a) or not len(b):
        return math.nan, math.nan
    rng, a, b = np.random.default_rng(seed), np.sort(a), np.sort(b)
    found = [a[rng.integers(0, len(a), len(a))].mean() - b[rng.integers(0, len(b), len(b))].mean() for _ in range(draws)]
    low, high = np.quantile(found, [0.025, 0.975])
    return float(low), float(high)


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their p-values and the residual degrees of freedom; columns that depend on others share their effect (minimum norm)."""
    inverse = np.linalg.pinv(x)
    coef = inverse @ y
    df = len(y) - np.linalg.matrix_rank(x)
    residual = y - x @ coef
    with np.errstate(divide="ignore", invalid="ignore"):
        error = np.sqrt((residual @ residual) / df * np.einsum("ij,ij->i", inverse, inverse)) if df > 0 else np.full(len(coef), np.nan)
        t = coef / error
    return coef, np.array([t_two_sided(v, df) for v in t]), float(df)


def coefficient_interval(x: np.ndarray, y: np.ndarray, draws: int = 200, seed: int = 42) -> tuple[float, float]:
    """Bootstrap interval (95 %) of the first coefficient, drawing whole rows."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(draws):
        rows = rng.integers(0, len(x), len(x))
        found.append(np.linalg.lstsq(x[rows], y[rows], rcond=None)[0][0])
    low, high = np.quantile(found, [0.025, 0.975])
    return float(low), float(high)


def fisher_z_independent(data: np.ndarray, i: int, j: int, given: tuple[int, ...], alpha: float) -> bool:
    """Whether columns i and j look independent given others, by the partial correlation."""
    precision = np.linalg.pinv(np.corrcoef(data[:, [i, j, *given]], rowvar=False))
    r = -precision[0, 1] / math.sqrt(precision[0, 0] * precision[1, 1])
    r = min(max(r, -1 + 1e-12), 1 - 1e-12)
    return normal_two_sided(math.atanh(r) * math.sqrt(len(data) - len(given) - 3)) > alpha


def skeleton(data: np.ndarray, alpha: float = 0.05) -> set[tuple[int, int]]:
    """The pairs of columns that no set of their neighbours makes independent (the undirected step of the PC algorithm)."""
    from itertools import combinations

    n = data.shape[1]
    near = {i: set(range(n)) - {i} for i in range(n)}
    for size in range(n - 1):
        for i, j in combinations(range(n), 2):
            if j in near[i]:
                sides = [*combinations(sorted(near[i] - {j}), size), *combinations(sorted(near[j] - {i}), size)]
                if any(fisher_z_independent(data, i, j, given, alpha) for given in sides):
                    near[i].discard(j)
                    near[j].discard(i)
    return {(i, j) for i in near for j in near[i] if i < j}


def communities(edges: list[tuple[str, str, float]]) -> list[list[str]]:
    """A partition of a weighted graph of high modularity: nodes move while that gains, then communities become nodes.

    Nodes are visited in sorted order and ties go to the first, so the same edges give the same partition. Weights of 0 or less are left out.
    """
    weights: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        if w > 0 and a != b:
            weights.setdefault(a, {})[b] = weights.setdefault(b, {})[a] = weights.get(a, {}).get(b, 0.0) + w
    members = {v: [v] for v in sorted(weights)}
    loops = dict.fromkeys(weights, 0.0)
    total = sum(sum(n.values()) for n in weights.values())
    while weights:
        degree = {v: sum(weights[v].values()) + 2 * loops[v] for v in weights}
        of, inside = {v: v for v in weights}, dict(degree)
        moved = changed = True
        while moved:
            moved = False
            for v in sorted(weights):
                links: dict[str, float] = {}
                for u, w in weights[v].items():
                    links[of[u]] = links.get(of[u], 0.0) + w
                inside[of[v]] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - degree[v] * inside[c] / total  # noqa: B023, E731
                best = max([of[v], *sorted(links)], key=lambda c: (gain(c) > gain(of[v]) + 1e-12, gain(c)))  # noqa: B023
                inside[best] += degree[v]
                if best != of[v]:
                    of[v], moved, changed = best, True, False
        if changed:  # no node moved
            break
        merged: dict[str, dict[str, float]] = {c: {} for c in set(of.values())}
        held, kept = dict.fromkeys(merged, 0.0), {c: [] for c in merged}
        for v in weights:
            kept[of[v]] += members[v]
            held[of[v]] += loops[v]
            for u, w in weights[v].items():
                if of[u] == of[v]:
                    held[of[v]] += w / 2
                else:
                    merged[of[v]][of[u]] = merged[of[v]].get(of[u], 0.0) + w
        weights, loops, members = merged, held, kept
    return sorted((sorted(m) for m in members.values()), key=lambda m: (-len(m), m))
