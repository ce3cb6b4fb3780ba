"""Characteristic polynomial of an integer matrix, and roots and null vectors of a symmetric one, to any precision.

Everything here is small and runs inside one task: one prime, one coefficient or one component at a time.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import comb

import numpy as np

ROOT_BITS = 160  # relative precision of a root
DIGITS = 110  # of the arithmetic of null vectors
STEPS = 4  # of inverse iteration


def is_prime(n: int) -> bool:
    """For n below 3e9, where the four bases leave no doubt."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2**31 with a product above 2 * bound."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(size: int, trace: int) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix is larger (Maclaurin's inequality)."""
    mean = trace // size + 1
    return max(comb(size, k) * mean**k for k in range(size + 1))


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal."""
    m = matrix.copy()
    for k in range(len(m) - 2):
        below = np.flatnonzero(m[k + 1 :, k])
        if not below.size:
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            m[[r, k + 1]] = m[[k + 1, r]]
            m[:, [r, k + 1]] = m[:, [k + 1, r]]
        f = m[k + 2 :, k] * pow(int(m[k + 1, k]), -1, p) % p
        m[k + 2 :] = (m[k + 2 :] - f[:, None] * m[k + 1]) % p
        m[:, k + 1] = (m[:, k + 1] + (m[:, k + 2 :] * f % p).sum(axis=1)) % p
    return m


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime below 2**31, highest power first."""
    h, n = hessenberg(matrix, p), len(matrix)
    rows = np.zeros((n + 1, n + 1), np.int64)  # rows[k, j]: coefficient of x**j for the leading k x k block
    rows[0, 0] = 1
    for k in range(1, n + 1):
        weight = np.zeros(k, np.int64)
        weight[k - 1] = h[k - 1, k - 1]
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            weight[i - 1] = int(h[i - 1, k - 1]) * product % p
        rows[k, 1:] = rows[k - 1, :-1]
        rows[k] = (rows[k] - (weight[:, None] * rows[:k] % p).sum(axis=0)) % p
    return rows[n, ::-1]


def combined(primes: list[int], residues: list[int]) -> int:
    """The number of least absolute value with these residues (Chinese remainders)."""
    pairs = sorted(zip(primes, residues))
    while len(pairs) > 1:
        joined = [
            (p * q, a + p * ((b - a) * pow(p, -1, q) % q)) for (p, a), (q, b) in zip(pairs[::2], pairs[1::2])
        ]
        pairs = joined + (pairs[-1:] if len(pairs) % 2 else [])
    modulus, value = pairs[0]
    return value - modulus if 2 * value > modulus else value


class Roots:
    """Roots of a polynomial with integer coefficients whose roots are all real and not negative."""

    def __init__(self, coefficients: list[int]):
        while len(coefficients) > 1 and coefficients[-1] == 0:
            coefficients = coefficients[:-1]
        self.coefficients = coefficients  # without the roots at zero
        self.counted: dict[tuple[int, int], int] = {}

    @property
    def positive(self) -> int:
        return len(self.coefficients) - 1

    def above(self, place: int, bits: int) -> int:
        """How many roots are greater than place / 2**bits.

        Shifted by that much, the polynomial has as many positive roots as its coefficients change sign, since all
        its roots are real (Descartes).
        """
        if (place, bits) not in self.counted:
            c = [x << (bits * k) for k, x in enumerate(self.coefficients)]
            for end in range(len(c) - 1, 0, -1):
                for i in range(1, end + 1):
                    c[i] += place * c[i - 1]
            signs = [x > 0 for x in c if x]
            self.counted[place, bits] = sum(a != b for a, b in zip(signs[:-1], signs[1:]))
        return self.counted[place, bits]

    def value(self, place: int, bits: int) -> int:
        """A number with the sign of the polynomial at place / 2**bits."""
        out = 0
        for k, x in enumerate(self.coefficients):
            out = out * place + (x << (bits * k))
        return out

    def nth(self, rank: int) -> tuple[int, int, int, int]:
        """The root of this rank from above (1 is the largest): place, bits, its multiplicity, its rank among equals."""
        bits, lo = 0, 0
        hi = 1 << (1 - self.coefficients[1]).bit_length()  # above the sum of the roots
        over, under = 0, self.positive  # roots above hi, roots above lo
        while under - over > 1 and not self._narrow(lo, hi):
            lo, hi, bits = 2 * lo, 2 * hi, bits + 1
            mid = (lo + hi) // 2
            n = self.above(mid, bits)
            if n >= rank:
                lo, under = mid, n
            else:
                hi, over = mid, n
            while lo % 2 == 0 and hi % 2 == 0 and bits:
                lo, hi, bits = lo // 2, hi // 2, bits - 1
        if under - over == 1:
            lo, hi, bits = self._refined(lo, hi, bits)
        return lo + hi, bits + 1, under - over, rank - over

    @staticmethod
    def _narrow(lo: int, hi: int) -> bool:
        return (hi - lo) << ROOT_BITS <= lo

    def _refined(self, lo: int, hi: int, bits: int) -> tuple[int, int, int]:
        """A narrow interval around the only root in (lo, hi]."""
        at_hi = self.value(hi, bits)
        if at_hi == 0:
            return hi, hi, bits
        positive = at_hi > 0
        while not self._narrow(lo, hi):
            lo, hi, bits = 2 * lo, 2 * hi, bits + 1
            mid = (lo + hi) // 2
            at = self.value(mid, bits)
            if at == 0:
                return mid, mid, bits
            if (at > 0) == positive:
                hi = mid
            else:
                lo = mid
        return lo, hi, bits


def _lower_upper(m: np.ndarray, tiny: Decimal) -> list[int]:
    """m becomes its factors; returns the row taken at each step."""
    taken = []
    for k in range(len(m)):
        r = k + max(range(len(m) - k), key=lambda i: abs(m[k + i, k]))
        taken.append(r)
        if r != k:
            m[[r, k]] = m[[k, r]]
        if m[k, k] == 0:
            m[k, k] = tiny
        m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return taken


def _solved(m: np.ndarray, taken: list[int], right: np.ndarray) -> np.ndarray:
    x = right.copy()
    for k, r in enumerate(taken):
        x[k], x[r] = x[r], x[k]
        x[k + 1 :] -= m[k + 1 :, k] * x[k]
    for k in range(len(m) - 1, -1, -1):
        x[k] = (x[k] - (m[k, k + 1 :] * x[k + 1 :]).sum()) / m[k, k]
    return x


def null_vectors(matrix: list[list[int]], place: int, bits: int, multiplicity: int) -> np.ndarray:
    """Orthonormal vectors, one a row, of a symmetric matrix for its root place / 2**bits: inverse iteration."""
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        root = Decimal(place) / (1 << bits)
        m = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object).reshape(size, size)
        scale = max(max((abs(x) for x in m.ravel()), default=Decimal(1)), Decimal(1))
        m[np.diag_indices(size)] -= root
        taken = _lower_upper(m, scale * Decimal(10) ** (5 - DIGITS))
        start = np.random.default_rng(size).integers(1, 1 << 30, (multiplicity, size))
        vectors = [np.array([Decimal(int(x)) for x in row], dtype=object) for row in start]
        for _ in range(STEPS):
            vectors = [_solved(m, taken, v) for v in vectors]
            for i, v in enumerate(vectors):
                for _ in range(2):  # once more against rounding
                    for u in vectors[:i]:
                        v = v - u * (u * v).sum()
                    v = v / (v * v).sum().sqrt()
                vectors[i] = v
        return np.array([[float(x) for x in v] for v in vectors])
