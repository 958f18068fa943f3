"""PartEnum signatures of integer sets under a Jaccard threshold (numpy only).

Sizes fall into bands ``[l, floor(l / threshold)]``; sets that are similar enough lie in
the same band or in neighbouring ones, and differ in at most ``k`` features, where
``k`` follows from the band.  For each band that a set can meet partners in, its feature
domain is partitioned and subsets of the partitions are enumerated:

* ``k`` small (:data:`ENUMERATED`): ``k + 2`` partitions, all subsets of two.  ``k``
  differences touch at most ``k`` partitions, so two of them stay equal.
* otherwise: ``n1`` first-level partitions of which at most ``k`` are touched; here each
  second-level subset is one partition.  A set needs ``k + 1`` signatures and may choose
  them by any weight that depends on the partition's content only: it emits all
  partitions of at least the weight of its (k+1)-th.  Of two similar sets the one with
  the higher bar has an untouched partition above it, which the other one emits too.
  The weight counts features that are not known to be frequent, so passages that many
  documents share don't make signatures while anything rarer is left.

A set whose non-empty partitions don't suffice for that argument emits all it has, and
takes part in a fallback with one feature as a partition (n1 = the whole domain), where
``k + 1`` always exist.  So no pair at or above the threshold lacks a common signature.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

from .words import mix

U64 = np.uint64
#: Up to this many differences, subsets of two of k + 2 partitions are enumerated.
ENUMERATED = 3
#: Features for each first-level partition.
PER_PART = 1.4


class Bands:
    """Size bands and their parameters for ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int = 75):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent
        self.upper = [0]

    def of(self, size: int) -> int:
        while self.upper[-1] < size:
            low = self.upper[-1] + 1
            self.upper.append(max(low, low * 100 // self.percent))
        return int(np.searchsorted(self.upper, size))

    def differences(self, band: int) -> int:
        """Most differing features of a similar pair whose smaller set is in the band."""
        return self.upper[band] * (100 - self.percent) // self.percent


@cache
def _mixed(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64))[0]


def signatures(features: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """The 64-bit signatures of one set of distinct, sorted 64-bit features; ``frequent`` is sorted."""
    return set_signatures(features, np.array([0, len(features)]), bands, frequent)[0]


def set_signatures(features: np.ndarray, at: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of sets side by side, set i at ``at[i]`` to ``at[i + 1]``, and the set that each is of."""
    size = np.diff(at)
    own = np.array([bands.of(int(n)) for n in size], np.int64)
    rare = np.ones(len(features), bool)
    if len(frequent) and len(features):
        found = np.searchsorted(frequent, features)
        found[found == len(frequent)] = 0
        rare = frequent[found] != features
    sigs, owners = [], []

    def put(sig: np.ndarray, owner: np.ndarray | int) -> None:
        sigs.append(sig)
        owners.append(np.full(len(sig), owner, np.int64) if isinstance(owner, int) else owner)

    with np.errstate(over="ignore"):
        for band in (own, own - 1):
            k = np.array([bands.differences(int(x)) if x >= 1 else 0 for x in band], np.int64)
            large = np.flatnonzero((band >= 1) & (k > ENUMERATED) & (size > 0))
            for i in np.flatnonzero((band >= 1) & (k <= ENUMERATED) & (size > 0)).tolist():
                own_features = features[at[i] : at[i + 1]]
                sig, enough = _enumerated(own_features, int(k[i]), _mixed(int(band[i]) * 4 + 1))
                put(sig, i)
                if not enough:
                    put(_alone(own_features, rare[at[i] : at[i + 1]], int(band[i]), int(k[i])), i)
            if not len(large):
                continue
            n = size[large]
            ends = np.cumsum(n)
            starts = ends - n
            seed = np.array([_mixed(int(x) * 4 + 1) for x in band[large]], np.uint64)
            n1 = np.array([int(bands.upper[x] / PER_PART) + 1 for x in band[large]], np.uint64)
            chosen = np.repeat(at[large] - starts, n) + np.arange(ends[-1])
            # Partitions are ranges of the hash, so that sorting it groups them; its lowest bit tells which features are rare.
            spread = (mix(features[chosen] ^ np.repeat(seed, n)) & ~U64(1)) | rare[chosen]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                spread[a:b].sort()
            part = ((spread >> U64(32)) * np.repeat(n1, n)) >> U64(32)
            first = np.concatenate(([True], part[1:] != part[:-1]))
            first[starts] = True
            start = np.flatnonzero(first)
            set_of = np.repeat(np.arange(len(large)), n)[start]
            # A product of a hash's halves is no linear function of it, so neither are the sums.
            content = mix(np.add.reduceat((spread | U64(1)) * (spread >> U64(32)), start) + part[start] * U64(0x9E3779B97F4A7C15) + seed[set_of])
            cold = np.minimum(np.add.reduceat(spread & U64(1), start), U64(3))
            weight = (cold << U64(61)) | (content >> U64(3))
            upto = np.searchsorted(set_of, np.arange(len(large) + 1))
            bar = np.zeros(len(large), np.uint64)
            for j, (a, b, least) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), k[large].tolist(), strict=True)):
                if b - a > least:
                    bar[j] = np.partition(weight[a:b], b - a - least - 1)[b - a - least - 1]
                else:
                    i = int(large[j])
                    put(_alone(features[at[i] : at[i + 1]], rare[at[i] : at[i + 1]], int(band[i]), least), i)
            keep = weight >= bar[set_of]
            put(content[keep], large[set_of[keep]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def _enumerated(features: np.ndarray, k: int, seed: np.uint64) -> tuple[np.ndarray, bool]:
    """Subsets of two of k + 2 partitions, and whether they suffice."""
    parts = k + 2
    spread = mix(features ^ seed)
    part = spread % U64(parts)
    content = np.zeros(parts, np.uint64)
    np.add.at(content, part, mix(spread))
    used = np.bincount(part.astype(np.int64), minlength=parts) > 0
    sig = np.array([seed + U64(a * 64 + b) + content[a] * U64(3) + content[b] * U64(5) for a, b in combinations(range(parts), 2) if used[a] or used[b]], np.uint64)
    return mix(sig), bool(used.sum() >= parts - 1)


def _alone(features: np.ndarray, rare: np.ndarray, band: int, k: int) -> np.ndarray:
    """The fallback: each feature is a partition of its own."""
    alone = mix(features ^ _mixed(band * 4 + 2))
    weight = (rare.astype(np.uint64) << U64(63)) | (alone >> U64(1))
    k = min(k, len(features) - 1)
    return alone[weight >= np.partition(weight, len(features) - k - 1)[len(features) - k - 1]]
