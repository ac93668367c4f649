"""Matching against several examples: batched short warping, fusion of seeds, and anchors of transitions.

These are kernels over arrays of a shortlist; none sees a whole corpus.
"""

from __future__ import annotations

import numpy as np

from tidemark.operators.sequences import resample_fixed, unit_rows, warp


def short_scores(query: np.ndarray, references: list[np.ndarray], length: int = 12, band: float = 0.35) -> np.ndarray:
    """1 - warping distance of a query to each reference, all cut to `length` evenly spaced steps first."""
    q = unit_rows(resample_fixed(np.asarray(query, dtype=float), length))
    if not references:
        return np.zeros(0)
    own = np.stack([unit_rows(resample_fixed(np.asarray(r, dtype=float), length)) for r in references])
    return 1 - warp(1 - np.einsum("qd,nrd->nqr", q, own), band=band)


def ranks_of(scores: np.ndarray) -> np.ndarray:
    """Ranks from 0, best first, ties by place; abstaining (NaN) scores get the median rank."""
    out = np.full(len(scores), np.nan)
    live = np.flatnonzero(np.isfinite(scores))
    out[live[np.argsort(-scores[live], kind="stable")]] = np.arange(len(live))
    return np.where(np.isnan(out), np.median(out[live]) if len(live) else 0.0, out)


def fuse_seeds(scores: np.ndarray, pool: str = "mean", top: int | None = None, by: str = "rrf", constant: float = 60.0) -> np.ndarray:
    """One score a candidate from a row of scores a seed.

    pool: the mean or the maximum over seeds; top: only each candidate's best
    seeds; by: reciprocal ranks within each seed, or z-scores.
    """
    if by == "rrf":
        own = np.stack([1.0 / (constant + ranks_of(s) + 1) for s in scores])
    else:
        own = np.stack([(s - np.nanmean(s)) / (np.nanstd(s) + 1e-8) for s in scores])
    if top is not None:
        own = np.sort(own, axis=0)[::-1][:top]
    return own.mean(axis=0) if pool == "mean" else own.max(axis=0)


def best_channels(channels: dict[str, np.ndarray], seeds: list[int], top: int = 3, constant: float = 60.0) -> tuple[list[str], np.ndarray]:
    """The channels in which seeds find each other best, and candidates' scores fused over them.

    channels: seed x candidate scores, seeds being candidates themselves.  A
    channel's quality is the mean reciprocal rank of each other seed when one
    seed asks; the fusion sums 1 / (constant + rank).
    """
    quality = {}
    for name, scores in channels.items():
        found = []
        for a, i in enumerate(seeds):
            rest = [j for j in range(scores.shape[1]) if j != i]
            place = {j: r for r, j in enumerate(sorted(rest, key=lambda j: (-scores[a, j], j)))}
            found += [1.0 / (1 + place[j]) for j in seeds if j != i]
        quality[name] = float(np.mean(found)) if found else 0.0
    chosen = sorted(channels, key=lambda c: (-quality[c], c))[:top]
    fused = sum(1.0 / (constant + ranks_of(s)) for c in chosen for s in channels[c])
    return chosen, fused


def transition_anchors(vectors: np.ndarray, members: np.ndarray, draws: int = 16, seed: int = 0) -> tuple[np.ndarray, float]:
    """A prototype of a kind of transition, and its weight as a voter.

    The prototype is the mean of the members minus that of the others.  In each
    of so many seeded halvings it is made of one half and its separation of the
    other half's members from the others is measured; the weight is
    2 x (mean - 2 deviations - 1/2), at least 0.
    """
    rng = np.random.default_rng(seed)
    inside, outside = np.flatnonzero(members), np.flatnonzero(~members)
    if len(inside) < 4 or len(outside) < 4:
        return np.zeros(vectors.shape[1]), 0.0
    values = []
    for _ in range(draws):
        a, b = rng.permutation(inside), rng.permutation(outside)
        p = vectors[a[: len(a) // 2]].mean(0) - vectors[b[: len(b) // 2]].mean(0)
        s, t = vectors[a[len(a) // 2 :]] @ p, vectors[b[len(b) // 2 :]] @ p
        values.append(float((s[:, None] > t[None]).mean() + 0.5 * (s[:, None] == t[None]).mean()))
    prototype = vectors[inside].mean(0) - vectors[outside].mean(0)
    return prototype / (np.linalg.norm(prototype) + 1e-8), max(0.0, 2 * (float(np.mean(values)) - 2 * float(np.std(values)) - 0.5))


def channel_weights(inside: dict[str, np.ndarray], outside: dict[str, np.ndarray]) -> dict[str, float]:
    """A query's weights of channels: how far its own similarities lie above those to a random reference, at least 0, summing to 1."""
    raw = {c: max(0.0, float(np.mean(inside[c]) - np.mean(outside[c]))) for c in inside}
    total = sum(raw.values())
    return {c: (v / total if total else 1.0 / len(raw)) for c, v in raw.items()}


def length_blend(distance_score: float, a: int, b: int, warp_weight: float = 0.8, length_weight: float = 0.2) -> float:
    """A warping score blended with the agreement of two lengths."""
    return warp_weight * distance_score + length_weight * min(a, b) / max(a, b)


def multirate_distance(query: dict[float, np.ndarray], reference: dict[float, np.ndarray], mode: str = "match", band: float = 0.25) -> float:
    """The warping distance of recordings kept at several rates: of the pair of rates with the most similar lengths, or the least of all pairs; a rate that is missing does not compete."""
    pairs = [(a, b) for a in query for b in reference if len(query[a]) and len(reference[b])]
    if not pairs:
        return float("inf")
    if mode == "match":
        pairs = [min(pairs, key=lambda p: (abs(np.log(len(query[p[0]]) / len(reference[p[1]]))), p))]
    one = lambda x, y: float(warp((1 - unit_rows(x) @ unit_rows(y).T)[None], band=band)[0])
    return min(one(query[a], reference[b]) for a, b in pairs)
