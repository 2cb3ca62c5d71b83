"""Numeric kernels over matrices, used by the Arrow operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise squared distance, summed first to last, as the column expression sums it."""
    d = a - b
    return np.cumsum(d * d, axis=-1)[..., -1] if d.shape[-1] else np.zeros(d.shape[:-1])


def approximate_squared(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product; right up to rounding."""
    return (q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (q @ b.T)


def signs(dim: int) -> np.ndarray:
    """The random-looking diagonal of the rotation, from a multiplicative hash of the position."""
    i = np.arange(dim, dtype=np.uint64)
    return 1.0 - 2.0 * (((i * np.uint64(2654435761)) % np.uint64(1 << 32)) >> np.uint64(31)).astype(np.float64)


def rotate(x: np.ndarray) -> np.ndarray:
    """Signs, then a fast Walsh-Hadamard transform of the next power of two, then 1/sqrt(n)."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x * signs(x.shape[1])
    h = 1
    while h < n:
        z = y.reshape(len(x), n // (2 * h), 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return y / np.sqrt(n)


def encode_bits(r: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, squared norm, l1) of rotated vectors around the centroid."""
    c = r - centroid
    return np.where(c >= 0, 1.0, -1.0), (c * c).sum(axis=1), np.abs(c).sum(axis=1)


def estimate_bits(q: np.ndarray, code: np.ndarray, sq: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Squared distances of centred queries to 1-bit codes; a code without length is as far as its norm."""
    qn = (q * q).sum(axis=1)[:, None]
    safe = np.where(l1 == 0, 1.0, l1)
    return np.where(l1 == 0, sq, qn + sq - 2.0 * sq * (q @ code.T) / safe)


def encode_levels(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(levels, a) of centred vectors, rounding half away from zero."""
    a = np.abs(c).max(axis=1)
    a = np.where(a == 0, 1e-9, a)
    top = (1 << bits) - 1
    return np.clip(np.floor((c + a[:, None]) / (2 * a[:, None]) * top + 0.5), 0, top), a


def estimate_levels(q: np.ndarray, levels: np.ndarray, a: np.ndarray, sq: np.ndarray, bits: int) -> np.ndarray:
    """Squared distances with the dequantised dot product and exact norms."""
    top = (1 << bits) - 1
    back = levels / top * 2 * a[:, None] - a[:, None]
    return (q * q).sum(axis=1)[:, None] + sq - 2.0 * (q @ back.T)


def estimate_extended(q: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """Squared distances with odd levels scaled by their projection on the vector; 1 bit gives estimate_bits."""
    levels, _ = encode_levels(c, bits)
    odd = 2 * levels - ((1 << bits) - 1)
    sq, g = (c * c).sum(axis=1), (odd * c).sum(axis=1)
    safe = np.where(g == 0, 1.0, g)
    return np.where(g == 0, sq, (q * q).sum(axis=1)[:, None] + sq - 2.0 * (q @ odd.T) * sq / safe)


def prune(dist: np.ndarray, between: np.ndarray, keep: int, alpha: float = 1.2) -> list[int]:
    """Robust pruning: nearest first; a candidate goes if a kept one is closer to it than 1/alpha of its distance.

    ``dist``: candidates to the node; ``between``: candidates to each other, both in plain distance.
    """
    out: list[int] = []
    alive = np.ones(len(dist), dtype=bool)
    for i in np.lexsort((np.arange(len(dist)), dist)):
        if not alive[i]:
            continue
        out.append(int(i))
        if len(out) == keep:
            break
        alive &= ~(alpha * between[i] <= dist)
    return out


def build_graph(x: np.ndarray, degree: int = 16, width: int = 48, alpha: float = 1.2, seed: int = 42) -> list[np.ndarray]:
    """A navigable graph over the rows of one shard: random start, two passes of search, prune and back-edges."""
    n = len(x)
    rng = np.random.default_rng(seed)
    nbrs = [rng.choice(n - 1, min(degree, n - 1), replace=False) if n > 1 else np.empty(0, dtype=np.int64) for _ in range(n)]
    nbrs = [np.where(a >= i, a + 1, a) for i, a in enumerate(nbrs)]
    entry = medoid(x)

    def pruned(i: int, cand: np.ndarray) -> np.ndarray:
        cand = np.unique(cand[cand != i])
        d = np.sqrt(np.maximum(0, ((x[cand] - x[i]) ** 2).sum(axis=1)))
        between = np.sqrt(np.maximum(0, approximate_squared(x[cand], x[cand])))
        return cand[prune(d, between, degree, alpha)]

    for _ in range(2):
        for i in rng.permutation(n):
            seen = walk(x, nbrs, x[i], entry, width)[1]
            nbrs[i] = pruned(i, np.concatenate([np.array(seen, dtype=np.int64), nbrs[i]]))
            for j in nbrs[i]:
                if i not in nbrs[j]:
                    more = np.append(nbrs[j], i)
                    nbrs[j] = pruned(j, more) if len(more) > 2 * degree else more
    return [pruned(i, a) if len(a) > degree else a for i, a in enumerate(nbrs)]


def medoid(x: np.ndarray) -> int:
    return int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if len(x) else 0


def walk(x: np.ndarray, nbrs: list[np.ndarray], q: np.ndarray, entry: int, width: int) -> tuple[list[tuple[float, int]], list[int]]:
    """Greedy beam search: the ``width`` best (distance, row) and all rows expanded on the way."""
    import heapq

    d = float(((x[entry] - q) ** 2).sum())
    seen, open_, best, done = {entry}, [(d, entry)], [(-d, -entry)], []
    while open_:
        d, i = heapq.heappop(open_)
        if len(best) >= width and d > -best[0][0]:
            break
        done.append(i)
        new = [j for j in nbrs[i].tolist() if j not in seen]
        if not new:
            continue
        seen.update(new)
        for e, j in zip(((x[new] - q) ** 2).sum(axis=1).tolist(), new):
            if len(best) < width or e < -best[0][0]:
                heapq.heappush(open_, (e, j))
                heapq.heappush(best, (-e, -j))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted((-a, -b) for a, b in best), done


def code_table(q: np.ndarray) -> np.ndarray:
    """Of a centred query: for each byte of a packed code its 256 possible sums of signed elements."""
    bits = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1) * 2.0 - 1.0
    return q.reshape(-1, 8) @ bits.T


def pack_bits(signs_: np.ndarray) -> np.ndarray:
    """Eight signs a byte, the first in the lowest bit."""
    return np.packbits(signs_ > 0, axis=1, bitorder="little")


def estimate_table(q: np.ndarray, packed: np.ndarray, sq: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """estimate_bits for one query by table look-ups instead of products."""
    dots = code_table(q)[np.arange(packed.shape[1])[None, :], packed].sum(axis=1)
    return np.where(l1 == 0, sq, (q * q).sum() + sq - 2.0 * sq * dots / np.where(l1 == 0, 1.0, l1))
