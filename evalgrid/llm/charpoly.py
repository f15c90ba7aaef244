"""Exact spectral pieces of symmetric integer matrices with no negative eigenvalue.

The characteristic polynomial comes modulo many 31-bit primes: Hessenberg form by similarity steps,
then the recurrence over its leading blocks. Chinese remaindering gives the integer coefficients, as
soon as the primes' product passes twice the largest coefficient there can be. Such a polynomial has
real roots only, so the sign changes of its coefficients, moved to x + a, are the number of roots
above a, each as often as it is one: that counts, isolates and orders the roots without rounding.
Eigenvectors solve (M - e) v = 0 by inverse iteration in as many decimal digits as the roots' gaps ask
for.
"""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from math import comb, isqrt, prod

import numpy as np

_TOP = 1 << 31


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than `bits` bits."""
    small = np.ones(isqrt(_TOP) + 1, bool)
    small[:2] = False
    for p in range(2, isqrt(len(small)) + 1):
        small[p * p :: p] = False
    divisors, out, got, high = np.flatnonzero(small), [], 0, _TOP
    while got <= bits:
        low, high = high - (1 << 14), high
        block = np.ones(high - low, bool)
        for p in divisors.tolist():
            block[-low % p :: p] = False
        for p in (low + np.flatnonzero(block))[::-1].tolist():
            out.append(p)
            got += p.bit_length() - 1
            if got > bits:
                break
        high = low
    return out


def coefficient_bits(trace: int, d: int) -> int:
    """Bits of the largest coefficient of a monic polynomial whose d roots are >= 0 and add up to
    `trace`: by Maclaurin's inequality the k-th is at most comb(d, k) * (trace / d)^k."""
    return max((comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1)) + 1


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p-2) mod p, element by element: the inverse, and 0 for 0."""
    out, e = np.ones_like(a), p - 2
    for bit in range(31):
        out = np.where(e >> bit & 1, out * a % p, out)
        a = a * a % p
    return out


def characteristic_mod(matrix: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix), highest first, modulo each prime: one row per prime.
    `matrix`: integers of any size (object)."""
    d, p = len(matrix), np.array(moduli, np.int64)
    h = np.array([(matrix % q).astype(np.int64) for q in moduli]).reshape(len(p), d, d)
    at, mod = np.arange(len(p)), p[:, None]
    for m in range(1, d - 1):
        row = m + np.argmax(h[:, m:, m - 1] != 0, axis=1)  # the pivot: itself, or the first below that is not 0
        h[at, row], h[:, m] = h[:, m].copy(), h[at, row]
        swapped = h[at, :, row].copy()
        h[at, :, row] = h[:, :, m]
        h[:, :, m] = swapped
        u = h[:, m + 1 :, m - 1] * _inverse(h[:, m, m - 1], p)[:, None] % mod
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m : m + 1] % mod[:, :, None]) % mod[:, :, None]
        for i in range(m + 1, d):  # the same steps from the other side, on columns
            h[:, :, m] = (h[:, :, m] + u[:, i - m - 1, None] * h[:, :, i]) % mod
    poly = [np.zeros((len(p), d + 1), np.int64) for _ in range(d + 1)]  # lowest coefficient first
    poly[0][:, 0] = 1
    for k in range(1, d + 1):
        poly[k][:, 1:] = poly[k - 1][:, :-1]
        poly[k] = (poly[k] - h[:, k - 1, k - 1, None] * poly[k - 1]) % mod
        below = np.ones(len(p), np.int64)
        for i in range(k - 2, -1, -1):
            below = below * h[:, i + 1, i] % p
            poly[k] = (poly[k] - (below * h[:, i, k - 1] % p)[:, None] * poly[i]) % mod
    return poly[d][:, ::-1]


def remaindered(moduli: list[int], residues: list[list[int]]) -> list[int]:
    """The integers nearest to 0 with these residues: residues[i][k] modulo moduli[i]."""
    product = prod(moduli)
    weights = [(rest := product // q) * pow(rest, -1, q) for q in moduli]
    sums = [sum(w * r[k] for w, r in zip(weights, residues)) % product for k in range(len(residues[0]))]
    return [x - product if 2 * x > product else x for x in sums]


def _rest_mod(a: list[int], b: list[int], p: int) -> list[int]:
    """Remainder of a by b modulo p, highest coefficient first, without leading zeros."""
    inverse, a = pow(b[0], -1, p), a[:]
    while len(a) >= len(b):
        f = a[0] * inverse % p
        a = [(x - f * y) % p for x, y in zip(a[1:], b[1:] + [0] * (len(a) - len(b)))]
        while a and not a[0]:
            a.pop(0)
    return a


def _common_mod(poly: list[int], p: int) -> list[int]:
    """Monic greatest common divisor of a polynomial and its derivative modulo p."""
    d = len(poly) - 1
    a, b = [c % p for c in poly], [c * (d - i) % p for i, c in enumerate(poly[:-1])]
    while b and not b[0]:
        b.pop(0)
    while b:
        a, b = b, _rest_mod(a, b, p)
    inverse = pow(a[0], -1, p)
    return [c * inverse % p for c in a]


def squarefree(poly: list[int], moduli: list[int]) -> list[int]:
    """The monic polynomial with the same roots, each once. One prime without a common divisor shows
    that there is none; else it is remaindered from the primes that show the smallest."""
    found = _common_mod(poly, moduli[0])
    if len(found) == 1:
        return poly
    each = [_common_mod(poly, q) for q in moduli]
    least = min(map(len, each))
    if least == 1:
        return poly
    good = [(q, g) for q, g in zip(moduli, each) if len(g) == least]
    divisor, rest, out = remaindered([q for q, _ in good], [g for _, g in good]), poly[:], []
    while len(rest) >= len(divisor):
        out.append(rest[0])
        rest = [x - rest[0] * y for x, y in zip(rest[1:], divisor[1:] + [0] * (len(rest) - len(divisor)))]
    if any(rest):
        raise ArithmeticError("the common divisor is not whole: too few primes")
    return out


def roots_above(poly: list[int], at: int, level: int) -> int:
    """Number of roots above at / 2^level, for a polynomial with real roots only."""
    c = [x << level * i for i, x in enumerate(poly)]
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += at * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], simple: list[int], most: int) -> list[tuple[int, int, int]]:
    """The largest roots of `poly`, `most` of them counted as often as they are one, highest first:
    (at, level, times) where at / 2^level < root <= (at + 1) / 2^level and no other root is there.
    `simple` is its squarefree part; no root is below 0."""
    out, taken, top = [], 0, max(1, sum(abs(x) for x in poly[1:2])).bit_length()
    todo = [(0, -top)] if roots_above(poly, 0, 0) else []  # level -top: one interval up to 2^top
    if todo and roots_above(poly, 1 << top, 0):
        raise ArithmeticError("a root above the trace: not a matrix of this kind")
    above = lambda p, at, level: roots_above(p, at << -level, 0) if level < 0 else roots_above(p, at, level)
    while todo and taken < most:
        at, level = todo.pop()
        n = above(simple, at, level) - above(simple, at + 1, level)
        if n == 1 and at:  # an interval that starts at 0 says little about the root's size
            times = above(poly, at, level) - above(poly, at + 1, level)
            out.append((at, level, times))
            taken += times
        elif n:
            todo += [(2 * at, level + 1), (2 * at + 1, level + 1)]
    return out


def refine(simple: list[int], at: int, level: int, upto: int) -> tuple[int, int]:
    """The isolated root's interval, halved until its level is `upto`."""

    def sign(x: int, level: int) -> int:
        value = 0
        for i, c in enumerate(simple):
            value = value * x + (c << level * i if level >= 0 else c)
        return (value > 0) - (value < 0)

    while level < upto:
        at, level = 2 * at, level + 1
        middle = at + 1
        end = at + 2
        shown = (middle << -level, end << -level, 0) if level < 0 else (middle, end, level)
        here = sign(shown[0], shown[2])
        last = sign(shown[1], shown[2])
        # one simple root in (at, end]: it is above the middle if the sign changes between them, or ends it
        if here and (here != last or last == 0):
            at = middle
    return at, level


def _solve(lu: list, rows: list[int], b: list) -> list:
    d, y = len(lu), [b[r] for r in rows]
    for i in range(d):
        y[i] -= sum((lu[i][k] * y[k] for k in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - sum((lu[i][k] * y[k] for k in range(i + 1, d)), Decimal(0))) / lu[i][i]
    return y


def _unit(vectors: list[list]) -> list[list]:
    """The vectors made orthogonal to those before them, and of length one (twice is enough)."""
    out = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                f = sum((a * b for a, b in zip(u, v)), Decimal(0))
                v = [a - f * b for a, b in zip(v, u)]
            size = sum((a * a for a in v), Decimal(0)).sqrt()
            v = [a / size for a in v]
        out.append(v)
    return out


def null_vectors(matrix: np.ndarray, simple: list[int], at: int, level: int, times: int) -> tuple[Decimal, list[list[Decimal]]]:
    """The eigenvalue in the interval, and `times` unit vectors of its null space that are orthogonal."""
    d, upto = len(matrix), max(level, 0) + 160
    low, level = refine(simple, at, level, upto)
    size = max(1, max(abs(int(x)) for x in matrix.flat)).bit_length()
    with localcontext(Context(prec=(2 * upto + 2 * size) * 302 // 1000 + 60)):
        value = (Decimal(2 * low + 1)) / Decimal(2 ** (level + 1))
        tiny = Decimal(2) ** -(2 * upto)
        a = [[Decimal(int(x)) for x in row] for row in matrix]
        for i in range(d):
            a[i][i] -= value
        rows = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda r: abs(a[r][k]))
            a[k], a[best], rows[k], rows[best] = a[best], a[k], rows[best], rows[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            for r in range(k + 1, d):
                if a[r][k]:
                    f = a[r][k] = a[r][k] / a[k][k]
                    a[r][k + 1 :] = [x - f * y for x, y in zip(a[r][k + 1 :], a[k][k + 1 :])]
        start = [[Decimal(int(x)) for x in row] for row in np.random.default_rng(1).integers(1, 1 << 40, (times, d))]
        vectors = _unit(start)
        for _ in range(2):
            vectors = _unit([_solve(a, rows, v) for v in vectors])
        return +value, vectors
