import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.functions.transport import assign_exact, assign_in_order, tight_flow


def one_by_one(p, caps):
    left, out = list(caps), []
    for row in p:
        order = sorted(range(len(caps)), key=lambda k: (-row[k], k))
        pick = next((k for k in order if left[k] > 0), -1)
        if pick >= 0:
            left[pick] -= 1
        out.append(pick)
    return out


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_exact_assignment_equals_brute_force(data):
    caps = np.array(data.draw(st.lists(st.integers(1, 3), min_size=2, max_size=3)))
    n, k = int(caps.sum()), len(caps)
    costs = np.array(data.draw(st.lists(st.integers(0, 12), min_size=n * k, max_size=n * k))).reshape(n, k)
    choice, prices = assign_exact(costs, caps)
    assert (np.bincount(choice, minlength=k) == caps).all()
    slots = np.repeat(np.arange(k), caps)
    best = min(costs[np.arange(n), list(p)].sum() for p in set(itertools.permutations(slots.tolist())))
    assert costs[np.arange(n), choice].sum() == best
    reduced = costs + prices
    assert (reduced[np.arange(n), choice] == reduced.min(axis=1)).all()


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_greedy_equals_sequential_rule(data):
    k = data.draw(st.integers(1, 4))
    n = data.draw(st.integers(0, 25))
    caps = np.array(data.draw(st.lists(st.integers(0, 8), min_size=k, max_size=k)))
    p = np.array(data.draw(st.lists(st.integers(0, 5), min_size=n * k, max_size=n * k)), dtype=float).reshape(n, k)
    assert list(assign_in_order(p, caps)) == one_by_one(p, caps)


def test_capacities_must_add_up():
    with pytest.raises(ValueError):
        assign_exact(np.zeros((3, 2), dtype=np.int64), np.array([1, 1]))


def test_flow_reports_the_over_demanded_set():
    flow, over, excess = tight_flow(np.array([5, 2, 1]), [[0], [0, 1], [2]], np.array([3, 2, 3]))
    assert excess == 2 and list(over) == [True, False, False] or list(over) == [True, True, False]
    assert flow.sum() == 6


def test_more_experts_than_a_machine_word():
    rng = np.random.default_rng(3)
    costs = rng.integers(0, 9, (140, 70))
    caps = np.full(70, 2)
    choice, prices = assign_exact(costs, caps)
    assert (np.bincount(choice, minlength=70) == 2).all()
    reduced = costs + prices
    assert (reduced[np.arange(140), choice] == reduced.min(axis=1)).all()
