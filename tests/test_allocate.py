import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkset.operators import allocate as a


def test_rounding_is_away_from_zero():
    assert [a.round_half_away(x) for x in (0.5, 1.5, 2.5, -0.5, 2.4)] == [1, 2, 3, -1, 2]


def test_split_counts():
    assert a.split_counts(5, 0.5) == (2, 3)
    assert a.split_counts(10) == (7, 3)
    assert a.split_counts(10, None, 4) == (4, 6)
    assert a.split_counts(10, 2, 4) == (4, 6)  # what neither takes is test
    assert a.split_counts(10, None, None) == (10, 0)
    for bad in ((1.5, None), (-1, None), (11, None), (None, 1.1), (True, None)):
        with pytest.raises(ValueError):
            a.split_counts(10, *bad)
    with pytest.raises(ValueError):
        a.split_counts(10, 8, 8)


def test_largest_remainders_break_ties_in_order():
    assert a.largest_remainders([("a", 5), ("b", 5)], 3) == {"a": 2, "b": 1}
    assert a.largest_remainders([("neg", 20), ("pos", 80)], 20) == {"neg": 4, "pos": 16}
    assert a.largest_remainders([("a", 0)], 0) == {"a": 0}


def test_overshoot_comes_off_the_largest():
    assert a.rounded_shares([("a", 5), ("b", 5), ("c", 5)], 2) == {"a": 0, "b": 1, "c": 1}
    assert a.rounded_shares([("a", 1), ("b", 1), ("c", 1)], 4) == {"a": 1, "b": 1, "c": 1}


def test_folds_leave_the_remainder_out():
    assert [a.fold_bounds(10, 3, f) for f in range(3)] == [(0, 3), (3, 6), (6, 9)]
    assert [a.fold_bounds(10, 3, f, balanced=True) for f in range(3)] == [(0, 4), (4, 7), (7, 10)]
    with pytest.raises(ValueError):
        a.fold_bounds(10, 1, 0)


@given(st.integers(0, 200), st.integers(1, 20))
def test_shards_cover_all_rows_once(n, k):
    bounds = [a.shard_bounds(n, k, i) for i in range(k)]
    assert bounds[0][0] == 0 and bounds[-1][1] == n
    assert all(x[1] == y[0] for x, y in zip(bounds, bounds[1:]))
    sizes = [y - x for x, y in bounds]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 100))
def test_remainders_add_up(sizes, percent):
    total = sum(sizes)
    wanted = total * percent // 100
    shares = a.largest_remainders(list(enumerate(sizes)), wanted)
    assert sum(shares.values()) == (wanted if total else 0)
    assert all(0 <= shares[i] <= s for i, s in enumerate(sizes))
