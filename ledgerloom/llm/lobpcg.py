"""Locally optimal block preconditioned conjugate gradients for the largest eigenvalues of a symmetric operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def independent(block: np.ndarray, image: np.ndarray | None = None, against: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray | None]:
    """Orthonormal directions of ``block`` beside orthonormal blocks, without those that rounding alone tells apart.

    ``image``, the operator's product with ``block``, gets the same linear steps;
    blocks of ``against`` come with a product of their own then.
    """
    fixed = [(q, None) if image is None else q for q in against]
    for _ in range(2):  # twice is enough for full precision
        for q, product in fixed:
            part = q.T @ block
            block = block - q @ part
            if image is not None:
                image = image - product @ part
        size = np.linalg.norm(block, axis=0)
        keep = size > 0
        block = block[:, keep] / size[keep]
        image = None if image is None else image[:, keep] / size[keep]
        if not block.shape[1]:
            break
        values, vectors = np.linalg.eigh(block.T @ block)
        keep = values > 1e-10 * max(values.max(), 1e-300)
        turn = vectors[:, keep] / np.sqrt(values[keep])
        block = block @ turn
        image = None if image is None else image @ turn
    return block, image


def largest(product: Callable[[np.ndarray], np.ndarray], size: int, count: int, guard: int = 8, tolerance: float = 64 * EPS, most: int = 300, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors.

    ``product`` multiplies the operator with a block.  Each iteration takes the
    best block of the span of the iterate, its residuals and the previous
    directions (Rayleigh-Ritz).  It ends once every wanted pair has a residual of
    at most ``tolerance`` times the largest eigenvalue and the square root of the
    size, from a product with the very vectors that are returned.
    """
    width = min(size, count + guard)
    x, _ = independent(np.random.default_rng(seed).standard_normal((size, width)))
    image, p, p_image, fresh = product(x), None, None, True
    best = np.inf
    for _ in range(most):
        values, turn = np.linalg.eigh((x.T @ image + image.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, image = x @ turn, image @ turn
        residual = image - x * values
        error = np.linalg.norm(residual[:, :count], axis=0).max()
        if error <= tolerance * np.sqrt(size) * max(values[0], 0):
            if fresh:
                return values[:count], x[:, :count]
            image, p, fresh = product(x), None, True  # certify with a product of these vectors
            continue
        beside = (x,) if p is None else (x, p)
        r, _ = independent(residual, against=beside)
        if not r.shape[1] and fresh:
            return values[:count], x[:, :count]  # no direction is left: the span is the whole space
        if not r.shape[1] or error > 1e3 * best:  # rounding has taken over: go on from products of these vectors
            x, _ = independent(x)
            image, p, fresh, best = product(x), None, True, np.inf
            continue
        best = min(best, error)
        span, images = [x, r], [image, product(r)]
        if p is not None:
            span, images = [x, r, p], [image, images[1], p_image]
        s, v = np.concatenate(span, 1), np.concatenate(images, 1)
        small = s.T @ v
        turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :width]
        rest = turn.copy()
        rest[: x.shape[1]] = 0  # what the new iterate has beside the old one
        x, image, p, p_image, fresh = s @ turn, v @ turn, s @ rest, v @ rest, False
        p, p_image = independent(p, p_image, ((x, image),))
    raise ArithmeticError(f"no certified eigenvectors after {most} iterations")
