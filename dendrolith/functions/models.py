"""Substitution models, rate categories and clocks as NumPy objects that tasks carry along."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from dendrolith.functions.alphabet import genetic_code, sense_codons
from dendrolith.functions.special import gauss_laguerre, pgamma, qbeta, qgamma, qlnorm, qweibull

PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]  # AC AG AT CG CT GT


def normalised(q: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Rows sum to zero and the mean rate is one."""
    q = q.copy()
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(freqs * np.diag(q)).sum()


@dataclass
class SubstitutionModel:
    """Rate matrix and stationary frequencies; transition probabilities by eigendecomposition."""

    q: np.ndarray
    freqs: np.ndarray
    reversible: bool = True

    def __post_init__(self):
        if self.reversible:
            root = np.sqrt(self.freqs)
            values, vectors = np.linalg.eigh(root[:, None] * self.q / root[None, :])
            self.values, self.left, self.right = values, vectors / root[:, None], vectors.T * root[None, :]
        else:
            self.values, self.left = np.linalg.eig(self.q)
            self.right = np.linalg.inv(self.left)

    def p(self, t) -> np.ndarray:
        """P(t) for an array of times: shape (..., n, n)."""
        return self._sum(np.exp(np.multiply.outer(np.asarray(t, dtype=float), self.values)), clip=True)

    def dp(self, t, order: int = 1) -> np.ndarray:
        """Derivatives of P(t) by t."""
        return self._sum(self.values**order * np.exp(np.multiply.outer(np.asarray(t, dtype=float), self.values)))

    def _sum(self, scale: np.ndarray, clip: bool = False) -> np.ndarray:
        out = np.real(np.einsum("ik,...k,kj->...ij", self.left, scale, self.right))
        return np.abs(out) if clip else out


def nucleotide(code: str, rates: Sequence[float] = (), freqs: Sequence[float] | None = None) -> SubstitutionModel:
    """A reversible model by its structure: six digits give each pair of states (AC AG AT CG CT GT) a rate class.

    The class of GT has rate one; ``rates`` holds the other classes in order of their digits. "000000" is JC69 or F81,
    "010010" K80 or HKY, "012345" SYM or GTR; five digits leave GT in class zero.
    """
    code = code if len(code) == 6 else code + "0"
    pi = np.full(4, 0.25) if freqs is None else np.asarray(freqs, dtype=float)
    others = [c for c in sorted(set(code)) if c != code[5]]
    value = {code[5]: 1.0} | dict(zip(others, rates, strict=True))
    q = np.zeros((4, 4))
    for (i, j), c in zip(PAIRS, code, strict=True):
        q[i, j], q[j, i] = value[c] * pi[j], value[c] * pi[i]
    return SubstitutionModel(normalised(q, pi), pi)


def jc69() -> SubstitutionModel:
    return nucleotide("000000")


def k80(kappa: float) -> SubstitutionModel:
    return nucleotide("010010", [kappa])


def hky(kappa: float, freqs: Sequence[float]) -> SubstitutionModel:
    return nucleotide("010010", [kappa], freqs)


def gtr(rates: Sequence[float], freqs: Sequence[float]) -> SubstitutionModel:
    """Five rates relative to GT, or six that are scaled so that GT is one."""
    r = np.asarray(rates, dtype=float)
    return nucleotide("012345", (r[:5] / r[5]) if len(r) == 6 else r, freqs)


def unrestricted(rates: np.ndarray, freqs: Sequence[float] | None = None) -> SubstitutionModel:
    """Any rate matrix off the diagonal; without frequencies, those of its stationary distribution."""
    q = np.array(rates, dtype=float)
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    if freqs is None:
        system = np.vstack([q.T, np.ones(len(q))])
        freqs = np.linalg.lstsq(system, np.append(np.zeros(len(q)), 1.0), rcond=None)[0]
    pi = np.asarray(freqs, dtype=float)
    return SubstitutionModel(normalised(q, pi), pi, reversible=False)


def general(structure: Sequence[int], rates: Sequence[float], freqs: Sequence[float]) -> SubstitutionModel:
    """n states; ``structure`` names the rate of each pair i < j, row by row."""
    n, pi = len(freqs), np.asarray(freqs, dtype=float)
    q = np.zeros((n, n))
    at = np.triu_indices(n, 1)
    q[at] = np.asarray(rates, dtype=float)[list(structure)]
    q = (q + q.T) * pi[None, :]
    return SubstitutionModel(normalised(q, pi), pi)


def empirical(text: str, freqs: Sequence[float] | None = None) -> SubstitutionModel:
    """An amino-acid model from a published table: a lower triangle of exchangeabilities, then 20 frequencies."""
    numbers = np.array(text.split()[:210], dtype=float)
    s = np.zeros((20, 20))
    s[np.tril_indices(20, -1)] = numbers[:190]
    pi = numbers[190:210] if freqs is None else np.asarray(freqs, dtype=float)
    pi = pi / pi.sum()
    return SubstitutionModel(normalised((s + s.T) * pi[None, :], pi), pi)


def codon_model(kappa: float, omega: float, freqs: Sequence[float] | None = None, code: str = "universal", alpha: float = 1.0) -> SubstitutionModel:
    """One-step codon model: transitions weigh kappa, changes of the amino acid omega, silent changes alpha."""
    codons, table = sense_codons(code), genetic_code(code)
    n = len(codons)
    pi = np.full(n, 1 / n) if freqs is None else np.asarray(freqs, dtype=float)
    q = np.zeros((n, n))
    for i, a in enumerate(codons):
        for j, b in enumerate(codons):
            steps = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
            if len(steps) == 1:
                transition = "".join(sorted(steps[0])) in ("AG", "CT")
                q[i, j] = pi[j] * (kappa if transition else 1.0) * (alpha if table[a] == table[b] else omega)
    return SubstitutionModel(normalised(q, pi), pi)


@dataclass
class SiteRates:
    rates: np.ndarray
    weights: np.ndarray


def rate_categories(kind: str = "constant", n: int = 4, shape: float = 1.0, invariant: float = 0.0, mean: bool = False, second: float = 1.0) -> SiteRates:
    """Rates with mean one. Kinds: constant, gamma, weibull, lognormal, beta, laguerre; medians of n equal shares or their means."""
    middle = (2 * np.arange(n) + 1) / (2 * n)
    weights = np.full(n, 1 / n)
    if kind == "constant":
        rates, weights = np.ones(1), np.ones(1)
    elif kind == "gamma" and mean:
        cuts = [0.0, *(qgamma((k + 1) / n, shape, shape) for k in range(n - 1))]
        upper = [pgamma(c, shape + 1, shape) for c in cuts] + [1.0]
        rates = np.diff(upper) * n
    elif kind == "laguerre":
        rates, weights = gauss_laguerre(n, shape - 1)
        rates = rates / shape
    else:
        quantile = {"gamma": lambda p: qgamma(p, shape, shape), "weibull": lambda p: qweibull(p, shape), "lognormal": lambda p: qlnorm(p, 0.0, shape), "beta": lambda p: qbeta(p, shape, second)}[kind]
        rates = np.array([quantile(p) for p in middle])
    if invariant > 0:
        rates, weights = np.append(0.0, rates), np.append(invariant, weights * (1 - invariant))
    return SiteRates(rates / (rates * weights).sum(), weights)


def free_rates(rates: Sequence[float], weights: Sequence[float]) -> SiteRates:
    r, w = np.asarray(rates, dtype=float), np.asarray(weights, dtype=float)
    return SiteRates(r / (r * w).sum(), w)


def clock_lengths(durations: np.ndarray, rate: float | Sequence[float], classes: Sequence[int] | None = None) -> np.ndarray:
    """Branch lengths from durations: one rate, a rate per branch, or a rate per class of branches."""
    rates = np.asarray(rate, dtype=float)
    return durations * (rates[list(classes)] if classes is not None else rates)


def inherited_rates(parents: Sequence[int | None], own: dict[int, float], root_rate: float) -> np.ndarray:
    """Local clocks: a node takes its own rate or else its parent's. Parents have larger numbers than children."""
    out = np.full(len(parents), root_rate)
    for i in range(len(parents) - 1, -1, -1):
        out[i] = own.get(i, root_rate if parents[i] is None else out[parents[i]])
    return out
