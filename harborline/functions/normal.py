"""The normal distribution in plain arithmetic, as SQL text that Spark and the check engine both read."""

from __future__ import annotations

from statistics import NormalDist

# Abramowitz and Stegun 26.2.17.
_P, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def pdf(z: str) -> str:
    return f"(exp(-0.5 * ({z}) * ({z})) / sqrt(2 * pi()))"


def cdf(z: str) -> str:
    """To about 1e-7."""
    t = f"(1.0 / (1.0 + {_P} * abs({z})))"
    tail = f"CAST({_B[-1]} AS DOUBLE)"
    for b in reversed(_B[:-1]):
        tail = f"(CAST({b} AS DOUBLE) + {t} * {tail})"
    upper = f"({pdf(z)} * {t} * {tail})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1.0 - {upper} ELSE {upper} END)"


def quantile(p: float) -> float:
    """The inverse of the cdf, 0 < p < 1; raises ValueError beyond."""
    return NormalDist().inv_cdf(p)
