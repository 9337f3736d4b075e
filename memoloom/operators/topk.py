"""Best-k bookkeeping for one set of query vectors, used inside tasks.

Scores are defined by the difference form in float64 (`l2`: 1 - squared distance, `cosine`: cosine similarity). A
float32 matrix product, with room for its rounding, finds the pairs that can matter; only those are scored in the
defining form, so the outcome does not depend on how rows are spread over batches and tasks. Ties go to the smaller id.

What is held for a query is its vector as it came and at most about 2k pairs. Everything else, such as the float64 form and
the sorting of pairs, is made for one block of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

METRICS = ("l2", "cosine")
_ROWS_PER_PRODUCT = 2048
_QUERIES_PER_PRODUCT = 1024
# Components of the pairs that are scored at a time.
_COMPONENTS_PER_SCORING = 1 << 22
# Pairs per query and k kept from one product without looking for a higher floor first.
_LOOSE = 4
# Merge found pairs once there are this many, or as many as are held.
_MERGE_AT = 4096
_LARGEST_FLOAT32_NORM = 1e15


class RunningTopK:
    """The k best rows seen so far for every query; the least score is one for all queries or one for each."""

    def __init__(self, query_ids, vectors: np.ndarray, k: int, min_score: float | np.ndarray | None, metric: str):
        self.query_ids = np.asarray(query_ids)
        self.vectors = vectors
        self.k = k
        self.metric = metric
        n = len(self.query_ids)
        self.parts = [slice(start, min(start + _QUERIES_PER_PRODUCT, n)) for start in range(0, n, _QUERIES_PER_PRODUCT)]
        self.squares = np.empty(n)
        for part in self.parts:
            block = vectors[part].astype(np.float64)
            self.squares[part] = np.einsum("ij,ij->i", block, block)
        self.floor = np.full(n, -np.inf if min_score is None else min_score, dtype=np.float64)
        self.best = [_Pairs(self.floor[part], k) for part in self.parts]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Offer rows. `vectors` has one row per id."""
        for start in range(0, len(ids), _ROWS_PER_PRODUCT):
            part = slice(start, start + _ROWS_PER_PRODUCT)
            some_ids, rows = ids[part], vectors[part]
            keep = _without_surplus_copies(some_ids, rows, self.k)
            if keep is not None:
                some_ids, rows = some_ids[keep], rows[keep]
            self._add_rows(some_ids, rows.astype(np.float64))

    def _add_rows(self, ids: np.ndarray, rows: np.ndarray) -> None:
        squares = np.einsum("ij,ij->i", rows, rows)
        right = np.hstack([rows, squares[:, None]]) if self.metric == "l2" else _unit(rows, squares)
        longest = np.sqrt(squares.max())
        safe = max(longest, np.sqrt(self.squares.max(initial=0.0))) < _LARGEST_FLOAT32_NORM
        kind = np.float32 if safe else np.float64
        right = right.astype(kind)
        size = 2.0 * np.sqrt(self.squares) * longest + longest**2 if self.metric == "l2" else np.ones(len(self.squares))
        room = 2.0 * (rows.shape[1] + 4) * np.finfo(kind).eps * (size + 1.0)
        for part, best in zip(self.parts, self.best, strict=True):
            block, own = self.vectors[part].astype(np.float64), self.squares[part]
            # l2: score = 2qr - r*r + (1 - q*q), the first two terms being one product; cosine: product of unit vectors.
            if self.metric == "l2":
                left, offset = np.hstack([2.0 * block, np.full((len(block), 1), -1.0)]), 1.0 - own
            else:
                left, offset = _unit(block, own), 0.0
            product = left.astype(kind) @ right.T
            q, r = self._candidates(product, best.floor - offset - room[part], room[part])
            step = max(_COMPONENTS_PER_SCORING // max(rows.shape[1], 1), 1)
            for start in range(0, len(q), step):
                some, of = q[start : start + step], r[start : start + step]
                best.offer(some, self._score(block, own, some, of, rows, squares), ids[of])

    def _candidates(self, product: np.ndarray, bound: np.ndarray, room: np.ndarray):
        """Pairs that may reach the bound and, where that leaves many, the k best of this product."""
        near = product >= bound.astype(product.dtype)[:, None]
        rows = product.shape[1]
        if rows > self.k and np.count_nonzero(near) > _LOOSE * self.k * len(product):
            kth = np.partition(product, rows - self.k, axis=1)[:, rows - self.k]
            near &= product >= (kth - 2.0 * room).astype(product.dtype)[:, None]
        return np.nonzero(near)

    def _score(self, block, own, q, r, rows, squares) -> np.ndarray:
        left, right = block[q], rows[r]
        if self.metric == "l2":
            gap = left - right
            return 1.0 - np.einsum("ij,ij->i", gap, gap)
        norms = np.sqrt(own[q]) * np.sqrt(squares[r])
        dots = np.einsum("ij,ij->i", left, right)
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)

    def results(self) -> Iterator[pd.DataFrame]:
        """query_id, id, score of the rows kept, by blocks of queries."""
        for part, best in zip(self.parts, self.best, strict=True):
            best.merge()
            if len(best.q):
                yield pd.DataFrame({"query_id": self.query_ids[part][best.q], "id": best.id, "score": best.score})

    def result(self) -> pd.DataFrame | None:
        """All of `results`, None without any."""
        found = list(self.results())
        return pd.concat(found, ignore_index=True) if found else None


class _Pairs:
    """The k best pairs of each query of one block. `floor` is its part of the floors of all queries, raised in place."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.q, self.score, self.id = np.empty(0, np.int64), np.empty(0), None
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        if keep.any():
            self.pending.append((q[keep], scores[keep], ids[keep]))
        if sum(len(p[0]) for p in self.pending) >= max(_MERGE_AT, len(self.q)):
            self.merge()

    def merge(self) -> None:
        """Keep the k best of held and pending pairs, and raise the floors to the k-th scores."""
        if not self.pending:
            return
        held = [] if self.id is None else [(self.q, self.score, self.id)]
        q, score, ids = (np.concatenate(columns) for columns in zip(*held, *self.pending))
        self.pending = []
        order = np.lexsort((-score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        sizes = np.diff(np.r_[first, len(q)])
        full = sizes >= self.k
        self.floor[q[first[full]]] = score[first[full] + self.k - 1]
        keep = score >= self.floor[q]
        q, score, ids = q[keep], score[keep], ids[keep]
        counts = np.bincount(q, minlength=len(self.floor))
        tied = counts[q] > self.k
        if tied.any():
            # More rows reach the k-th score than there is room for: the smaller ids stay.
            pairs = pd.DataFrame({"q": q[tied], "score": score[tied], "id": ids[tied], "at": np.flatnonzero(tied)})
            pairs = pairs.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
            surplus = pairs[pairs.groupby("q", sort=False).cumcount() >= self.k]["at"].to_numpy()
            stay = np.ones(len(q), dtype=bool)
            stay[surplus] = False
            q, score, ids = q[stay], score[stay], ids[stay]
        self.q, self.score, self.id = q, score, ids


def _unit(rows: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    norms = np.sqrt(squares)[:, None]
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _without_surplus_copies(ids: np.ndarray, vectors: np.ndarray, k: int):
    """Positions to keep when some vector occurs more than k times: its k smallest ids are all that can rank.

    Returns None when nothing is surplus, the usual case.
    """
    if len(ids) <= k:
        return None
    bits = np.ascontiguousarray(vectors, dtype=np.float32).view(np.uint32).astype(np.uint64)
    # Odd multipliers make a cheap signature; rows that share one are compared in full below.
    weights = (np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    signature = (bits * weights).sum(axis=1, dtype=np.uint64)
    _, first, group, counts = np.unique(signature, return_index=True, return_inverse=True, return_counts=True)
    if counts.max() <= k:
        return None
    same = (bits == bits[first[group]]).all(axis=1) & (counts[group] > k)
    copies = pd.DataFrame({"g": group[same], "id": ids[same], "at": np.flatnonzero(same)})
    copies = copies.sort_values(["g", "id"], kind="stable")
    surplus = copies[copies.groupby("g", sort=False).cumcount() >= k]["at"].to_numpy()
    keep = np.ones(len(ids), dtype=bool)
    keep[surplus] = False
    return np.flatnonzero(keep)
