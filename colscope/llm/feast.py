"""Leading eigenpairs of a small dense symmetric matrix by FEAST contour integration.

The matrix is a covariance over a fixed number of dimensions: its size does not grow with the
table. ``leading`` cuts the upper end of the spectrum into intervals with a bounded number of
eigenvalues, found by inertia counts alone; ``interval`` extracts each one's eigenpairs:

* *projection*: a Gauss-Legendre rule on a circle over the interval sums weighted solutions of
  the complex shifted systems (z I - A) Y = Q, which filters a random block Q to the
  eigenvectors inside;
* *Rayleigh-Ritz* on the filtered block; repeated until the residuals stop falling;
* *inertia*: by Sylvester's law the number of eigenvalues above a point s is the number of
  positive pivots of a symmetric factorisation of A - s I. The count inside must equal the
  number of pairs found, or the block is enlarged and the interval done again.
"""

from __future__ import annotations

import numpy as np

NODES = 8               # quadrature points on the upper half circle
PER_INTERVAL = 10       # eigenvalues in an interval, unless they are too close to be told apart
EPS = np.finfo(float).eps


def count_above(a: np.ndarray, s: float) -> int:
    """Eigenvalues of ``a`` greater than ``s``: positive pivots of a block LDL^T factorisation of
    a - s I with complete symmetric pivoting (pivots of order 1 or 2)."""
    m = a - s * np.eye(len(a))
    positive = 0
    alpha = (1 + np.sqrt(17)) / 8
    while len(m):
        diag = np.abs(np.diag(m))
        i = int(diag.argmax())
        off = np.abs(np.tril(m, -1))
        r, c = np.unravel_index(int(off.argmax()), off.shape)
        if diag[i] == 0 and off[r, c] == 0:
            return positive
        if diag[i] >= alpha * off[r, c]:
            rest = np.delete(np.arange(len(m)), i)
            positive += m[i, i] > 0
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, i], m[rest, i]) / m[i, i]
        else:       # the determinant of such a pivot is negative: one eigenvalue on each side
            two = np.array([r, c])
            rest = np.delete(np.arange(len(m)), two)
            w = m[np.ix_(rest, two)]
            positive += 1
            m = m[np.ix_(rest, rest)] - w @ np.linalg.solve(m[np.ix_(two, two)], w.T)
        m = (m + m.T) / 2
    return positive


def interval(a: np.ndarray, low: float, high: float, inside: int, seed: int = 7, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues in (low, high) and their unit eigenvectors (columns)."""
    d = len(a)
    x, w = np.polynomial.legendre.leggauss(NODES)
    theta = np.pi / 2 * (1 - x)                       # upper half circle; the lower one is its conjugate
    centre, radius = (low + high) / 2, (high - low) / 2
    z = centre + radius * np.exp(1j * theta)
    weight = radius * w / 2 * np.exp(1j * theta)
    size = min(d, max(inside + 4, 2 * inside))
    scale = np.abs(a).sum(1).max()
    while True:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
        best, pairs = np.inf, None
        for _ in range(rounds):
            y = np.zeros((d, size))
            for zj, wj in zip(z, weight):
                y += (wj * np.linalg.solve(zj * np.eye(d) - a, q)).real
            q = np.linalg.qr(y)[0]
            ritz, v = np.linalg.eigh(q.T @ a @ q)
            q = q @ v
            hit = np.flatnonzero((ritz > low) & (ritz < high))
            if len(hit) == inside:
                residual = np.linalg.norm(a @ q[:, hit] - q[:, hit] * ritz[hit], axis=0).max(initial=0.0)
                if residual >= best / 2:              # no longer falling
                    break
                best, pairs = residual, (ritz[hit], q[:, hit])
                if best <= EPS * scale:
                    break
        if pairs is not None and best <= 1e3 * EPS * scale:
            return pairs
        if size == d:
            raise ArithmeticError(f"{inside} eigenvalues counted in ({low}, {high}), not all found")
        size = min(d, 2 * size)


def _cut(a: np.ndarray, low: float, high: float, below: int, want: int, width: float) -> float:
    """A point in (low, high) with at least ``want`` eigenvalues of ``a`` above it, as few more as
    bisection tells apart; ``below`` is the count at ``low``."""
    while high - low > width and below > want:
        mid = (low + high) / 2
        n = count_above(a, mid)
        if n >= want:
            low, below = mid, n
        else:
            high = mid
    return low


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` largest positive eigenvalues (falling) and their eigenvectors (columns).
    Eigenvalues within rounding of zero are left out: their directions hold no variance."""
    d = len(a)
    trace = float(np.trace(a)) if d else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    top = float(np.abs(a).sum(1).max()) * (1 + 1e-9)            # Gershgorin
    floor = d * 16 * EPS * top
    rank = count_above(a, floor)
    count = min(count, rank)
    width = 1e-10 * top
    # cuts from the top; a cut sits in the middle of the widest gap that is cheap to find
    values, vectors, high, above = [], [], top, 0
    while above < count:
        want = min(above + PER_INTERVAL, count)
        low = _cut(a, floor, high, rank, want, width)
        n = count_above(a, low)
        gap = _cut_below(a, low, floor, n, width) if n < rank else floor
        low = (low + gap) / 2 if n < rank else floor
        e, v = interval(a, low, high, n - above)
        values.append(e[::-1])
        vectors.append(v[:, ::-1])
        high, above = low, n
    e, q = np.concatenate(values), np.concatenate(vectors, axis=1)
    # one Rayleigh-Ritz step over all intervals makes their vectors orthogonal to rounding
    q = np.linalg.qr(q)[0]
    e, v = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-e)[:count]
    return e[order], (q @ v)[:, order]


def _cut_below(a: np.ndarray, low: float, floor: float, n: int, width: float) -> float:
    """The lowest point found between ``floor`` and ``low`` with still ``n`` eigenvalues above it."""
    high = low
    while high - floor > max(width, 1e-3 * high):
        mid = (floor + high) / 2
        if count_above(a, mid) == n:
            high = mid
        else:
            floor = mid
    return high
