"""Exact arithmetic of splits, folds, shards and strata."""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence


def round_half_away(x: float) -> int:
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def split_counts(n: int, test_size: float | int | None = 0.25, train_size: float | int | None = None) -> tuple[int, int]:
    """Rows of train and test. A share must be from 0 to 1 and a number from 0 to n. What neither size takes goes to test."""

    def count(size: float | int | None, label: str) -> int | None:
        if size is None:
            return None
        if isinstance(size, bool) or not isinstance(size, int | float):
            raise ValueError(f"{label}: not a number")
        if isinstance(size, float):
            if not 0 <= size <= 1:
                raise ValueError(f"{label}: out of range")
            return round_half_away(n * size)
        if not 0 <= size <= n:
            raise ValueError(f"{label}: out of range")
        return size

    test, train = count(test_size, "test_size"), count(train_size, "train_size")
    if train is None:
        return n - (test or 0), test or 0
    if test is not None and train + test > n:
        raise ValueError("invalid split sizes")
    return train, n - train


def largest_remainders(groups: Sequence[tuple[Hashable, int]], wanted: int) -> dict[Hashable, int]:
    """Share ``wanted`` among groups by their sizes: the floor of each share, then one more for the largest fractions, in the groups' order."""
    total = sum(size for _, size in groups)
    if not total:
        return {g: 0 for g, _ in groups}
    floors = {g: size * wanted // total for g, size in groups}
    left = wanted - sum(floors.values())
    by_fraction = sorted(range(len(groups)), key=lambda i: -(groups[i][1] * wanted % total))
    for i in by_fraction[:left]:
        floors[groups[i][0]] += 1
    return floors


def rounded_shares(groups: Sequence[tuple[Hashable, int]], wanted: int) -> dict[Hashable, int]:
    """Rounded share of each stratum; what exceeds ``wanted`` is taken from the largest strata first, and a shortfall stays."""
    total = sum(size for _, size in groups)
    shares = {g: round_half_away(size / total * wanted) if total else 0 for g, size in groups}
    over = sum(shares.values()) - wanted
    for g, _ in sorted(groups, key=lambda x: -shares[x[0]]):
        if over <= 0:
            break
        cut = min(over, shares[g])
        shares[g] -= cut
        over -= cut
    return shares


def shard_bounds(n: int, num_shards: int, index: int) -> tuple[int, int]:
    """First row and end of a contiguous shard; the first ``n % num_shards`` shards have one row more."""
    if num_shards < 1 or not 0 <= index < num_shards:
        raise ValueError("index must be from 0 to num_shards - 1")
    size, more = divmod(n, num_shards)
    start = index * size + min(index, more)
    return start, start + size + (index < more)


def fold_bounds(n: int, k: int, fold: int, balanced: bool = False) -> tuple[int, int]:
    """Rows tested in a fold. Unless balanced, the last ``n % k`` rows are in no test fold."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    return shard_bounds(n, k, fold) if balanced else (fold * (n // k), (fold + 1) * (n // k))


def resolve_index(i: int, n: int) -> int | None:
    """Position of a possibly negative index; None out of range."""
    at = i + n if i < 0 else i
    return at if 0 <= at < n else None
