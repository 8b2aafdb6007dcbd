"""Singular values and right singular vectors of a small upper triangular matrix.

1. Householder reflections from both sides make R upper bidiagonal: R = Q B P'.
2. dqds (the differential quotient-difference transform with shifts) finds the
   squares of B's singular values; every shift is known to stay below the
   smallest one, so all quantities stay positive and accuracy is relative.
3. A twisted factorisation of B'B - e at the position of its least pivot gives
   the vector of e.  Vectors of close values are made orthogonal to the earlier
   ones of their group and improved by inverse iteration.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLOSE = 1e-3  # relative gap under which values form a group
ZERO = 16     # singular values under this many roundings of the largest are zero


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and P of r = Q B P'."""
    a = np.array(r, dtype=float)
    n = a.shape[1]
    p = np.eye(n)

    def reflector(x):
        v = x.copy()
        big = np.abs(v).max() if v.size else 0.0
        if big == 0.0:
            return None
        v /= big
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ v, v)
                p[:, k + 1:] -= 2.0 * np.outer(p[:, k + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), p


def _step(q: list, e: list, shift: float):
    """One dqds transform: new q, e, the least d, and where d first fell under zero (None if nowhere)."""
    m = len(q)
    nq, ne = [0.0] * m, [0.0] * (m - 1)
    d = q[0] - shift
    least = d
    for i in range(m - 1):
        if d < 0.0:
            return nq, ne, least, i
        nq[i] = d + e[i]
        t = q[i + 1] / nq[i] if nq[i] > 0.0 else 1.0
        ne[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    nq[m - 1] = d
    return nq, ne, least, (m - 1 if d < 0.0 else None)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found = []
    blocks = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale], 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        if len(q) > 1 and q[0] < q[-1]:  # the small end last: values leave from there (not for shifted blocks: same values)
            q, e = _reversed(q, e)
        guess = 0.0
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= (EPS * EPS) * (total + min(q[i], q[i + 1]))
                        or e[i] == 0.0), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], total))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if e[-1] <= EPS * 0.25 * q[-1] and e[-1] * q[-1] <= (EPS * (total + q[-1])) ** 2:
                found.append(total + q.pop())
                e.pop()
                continue
            shift = guess
            for _ in range(4):
                nq, ne, least, failed = _step(q, e, shift)
                if failed is None or shift == 0.0:
                    break
                late = shift + least if failed == len(q) - 1 else 0.0
                shift = late * (1.0 - 4.0 * EPS) if 0.0 < late < shift else shift * 0.25
            else:
                shift = 0.0
                nq, ne, least, failed = _step(q, e, 0.0)
            q, e, total = nq, ne, total + shift
            q[-1] = max(q[-1], 0.0)
            guess = max(least, 0.0) * (1.0 - 1e-3) if len(q) > 2 else _lower(q, e)
        found.append(total + q[0])
    return np.sort(np.maximum(np.array(found), 0.0))[::-1] * scale ** 2


def _reversed(q: list, e: list) -> tuple[list, list]:
    """The qd array of the matrix read from its other end: the same values."""
    m = len(q)
    a, b = [x ** 0.5 for x in q], [x ** 0.5 for x in e]
    # B reversed is lower bidiagonal; one QR sweep of rotations makes it upper again.
    low, diag = b[::-1], a[::-1]
    nq, ne = [0.0] * m, [0.0] * (m - 1)
    d = diag[0]
    for i in range(m - 1):
        h = (d * d + low[i] * low[i]) ** 0.5
        nq[i] = h * h
        if h == 0.0:
            c, s = 1.0, 0.0
        else:
            c, s = d / h, low[i] / h
        ne[i] = (s * diag[i + 1]) ** 2
        d = c * diag[i + 1]
    nq[m - 1] = d * d
    return nq, ne


def _lower(q: list, e: list) -> float:
    """Just under the smaller squared singular value of a 2 by 2 block."""
    t = q[0] + q[1] + e[0]
    root = max(t * t - 4.0 * q[0] * q[1], 0.0) ** 0.5
    return 2.0 * q[0] * q[1] / (t + root) * (1.0 - 8.0 * EPS) if t > 0.0 else 0.0


def _twisted(q: np.ndarray, low: np.ndarray, value: float):
    """Factors of L D L' - value from both ends: multipliers, pivots and the twist pivots."""
    n = len(q)
    tiny = EPS * EPS * max(q.max(), abs(value), 1e-300)
    down, up = np.zeros(n - 1), np.zeros(n - 1)
    dplus, dminus = np.zeros(n), np.zeros(n)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        piv = q[i] + s[i]
        piv = piv if abs(piv) > tiny else -tiny
        dplus[i] = piv
        down[i] = q[i] * low[i] / piv
        s[i + 1] = down[i] * low[i] * s[i] - value
    dplus[n - 1] = q[n - 1] + s[n - 1]
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        piv = q[i] * low[i] * low[i] + p[i + 1]
        piv = piv if abs(piv) > tiny else -tiny
        dminus[i + 1] = piv
        up[i] = q[i] * low[i] / piv
        p[i] = (p[i + 1] * (q[i] / piv) if low[i] else q[i]) - value
    dminus[0] = p[0]
    return down, up, dplus, dminus, s + p + value, tiny


def _solve(factors, r: int, b: np.ndarray) -> np.ndarray:
    """x of (N D N') x = b for the factorisation twisted at r."""
    down, up, dplus, dminus, gamma, tiny = factors
    n = len(b)
    y = b.copy()
    for i in range(r):
        y[i + 1] -= down[i] * y[i]
    for i in range(n - 1, r, -1):
        y[i - 1] -= up[i - 1] * y[i]
    y[:r] /= dplus[:r]
    y[r + 1:] /= dminus[r + 1:]
    y[r] /= gamma[r] if abs(gamma[r]) > tiny else tiny
    for i in range(r - 1, -1, -1):
        y[i] -= down[i] * y[i + 1]
    for i in range(r, n - 1):
        y[i + 1] -= up[i] * y[i]
    return y


def leading_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Eigenvectors (columns) of B'B for its ``k`` largest eigenvalues ``values[:k]``."""
    n = len(diagonal)
    if n == 1:
        return np.ones((1, k))
    top = max(float(values[0]), 1e-300)
    a = np.where(np.abs(diagonal) > EPS * top ** 0.5 * 1e-3, diagonal, EPS * top ** 0.5 * 1e-3)
    q, low = a * a, above / a[:-1]
    out = np.zeros((n, k))
    first = 0  # start of the group of close values
    for j in range(k):
        if j and values[j - 1] - values[j] > CLOSE * values[j - 1]:
            first = j
        factors = _twisted(q, low, float(values[j]))
        gamma = np.abs(factors[4])
        group = out[:, first:j]
        r = int(np.argmin(gamma))
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -factors[0][i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -factors[1][i] * z[i]
        z /= np.linalg.norm(z)
        z0 = z
        if group.shape[1]:
            # the position that the earlier vectors of the group cover least, then inverse iteration
            z = z - group @ (group.T @ z)
            if np.linalg.norm(z) < 0.5:
                start = int(np.argmin((out[:, first:j] ** 2).sum(axis=1)))
                z = np.zeros(n)
                z[start] = 1.0
                z += 1e-3 * z0 + 1e-3 * np.cos(np.arange(n) * (j + 1.0))
            for _ in range(4):
                z = z - group @ (group.T @ z)
                z /= np.linalg.norm(z)
                x = _solve(factors, r, z)
                x /= np.abs(x).max()
                z = x - group @ (group.T @ x)
                z /= np.linalg.norm(z)
            z = z - group @ (group.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of r, falling, and the right singular vectors (columns) of the ``k``
    largest; fewer where the others are zero to rounding."""
    diagonal, above, p = bidiagonal(r)
    values = dqds(diagonal, above)
    zero = (ZERO * EPS * len(values)) ** 2 * values[0] if len(values) else 0.0
    k = min(k, int((values > zero).sum()))
    if k == 0:
        return values, np.zeros((len(values), 0))
    vectors = p @ leading_vectors(diagonal, above, values, k)
    return values, vectors / np.linalg.norm(vectors, axis=0)
