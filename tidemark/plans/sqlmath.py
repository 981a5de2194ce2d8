"""p-values as SQL text for the other engine: continued fractions folded over a list, so that the library's own are held against something else."""

from __future__ import annotations

#: Terms of the fractions and series: far more than they need here.
TERMS = 400


def beta(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function of SQL expressions, by its continued fraction from the inside out."""

    def tail(x: str, a: str, b: str) -> str:
        m = "(step_ // 2)"
        even = f"({m} * (({b}) - {m}) * ({x}) / ((({a}) + step_ - 1) * (({a}) + step_)))"
        odd = f"(-((({a}) + {m}) * (({a}) + ({b}) + {m}) * ({x})) / ((({a}) + step_ - 1) * (({a}) + step_)))"
        fraction = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({TERMS}, 0, -1), lambda step_: (CASE WHEN step_ % 2 = 0 THEN {even} ELSE {odd} END)::DOUBLE)), lambda acc, d: 1.0 + d / acc)"
        front = f"exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}) + ({a}) * ln({x}) + ({b}) * ln(1 - ({x}))) / ({a})"
        return f"({front} / ({fraction}))"

    direct, other = tail(x, a, b), tail(f"(1 - ({x}))", b, a)
    return f"(CASE WHEN ({x}) <= 0 THEN 0 WHEN ({x}) >= 1 THEN 1 WHEN ({x}) > (({a}) + 1) / (({a}) + ({b}) + 2) THEN 1 - {other} ELSE {direct} END)"


def t_two_sided(t: str, df: str) -> str:
    return beta(f"({df}) / (({df}) + ({t}) * ({t}))", f"({df}) / 2.0", "0.5::DOUBLE")


def normal_two_sided(z: str) -> str:
    """p of a normal statistic of at least 0: a series near 0, a continued fraction further out."""
    h = f"(({z}) * ({z}) / 2)"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({TERMS}, 0, -1), lambda step_: (2 * {h} / (2 * step_ + 1))::DOUBLE)), lambda acc, d: 1.0 + d * acc)"
    near = f"1 - ({z}) * sqrt(2 / pi()) * exp(-{h}) * {series}"
    fraction = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({TERMS}, 0, -1), lambda step_: (step_ / (2 * {h}))::DOUBLE)), lambda acc, d: 1.0 + d / acc)"
    far = f"exp(-{h}) / (({z}) * sqrt(pi() / 2) * {fraction})"
    return f"least(1.0, CASE WHEN ({z}) <= 0 THEN 1.0 WHEN ({z}) < 3 THEN {near} ELSE {far} END)"


def binomial_half(k: str, n: str) -> str:
    """Exact two-sided p of k of n at one half."""
    m = f"least({k}, ({n}) - ({k}))::DOUBLE"
    return f"CASE WHEN 2 * ({k}) = ({n}) THEN 1.0 ELSE least(1.0, 2 * {beta('0.5::DOUBLE', f'(({n}) - {m})', f'({m} + 1)')}) END"
