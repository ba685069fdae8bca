"""Small numpy helpers that run inside one task, on one batch or on per-batch summaries."""

from __future__ import annotations

import numpy as np


def tight_flow(counts: np.ndarray, sets: list[list[int]], caps: np.ndarray):
    """Place ``counts[j]`` cases on the experts of ``sets[j]`` within ``caps``.

    Returns (flow, over, excess).  ``excess`` is the number of cases left over; ``over`` then marks
    the smallest set of experts for which more cases than room are bound.
    """
    flow = np.zeros((len(sets), len(caps)), dtype=np.int64)
    room = caps.astype(np.int64).copy()
    rest = counts.astype(np.int64).copy()
    for j, options in enumerate(sets):
        for k in options:
            put = min(rest[j], room[k])
            flow[j, k] += put
            rest[j] -= put
            room[k] -= put
    over = np.zeros(len(caps), dtype=bool)
    for j in np.flatnonzero(rest):
        while rest[j] > 0:
            came = {k: None for k in sets[j]}
            queue = list(sets[j])
            end = next((k for k in queue if room[k] > 0), None)
            while queue and end is None:
                k = queue.pop(0)
                for other in np.flatnonzero(flow[:, k]):
                    for nxt in sets[other]:
                        if nxt not in came:
                            came[nxt] = (k, other)
                            queue.append(nxt)
                            if room[nxt] > 0 and end is None:
                                end = nxt
            if end is None:
                over[list(came)] = True
                break
            path, k = [], end
            while came[k] is not None:
                prev, via = came[k]
                path.append((via, prev, k))
                k = prev
            put = min([rest[j], room[end], *[flow[via, prev] for via, prev, _ in path]])
            flow[j, k] += put
            for via, prev, nxt in path:
                flow[via, prev] -= put
                flow[via, nxt] += put
            rest[j] -= put
            room[end] -= put
    return flow, over, int(rest.sum())


def tight_sets(reduced: np.ndarray):
    """Group rows by the set of experts at their minimum: (set of each row, sets, counts)."""
    tight = reduced == reduced.min(axis=1, keepdims=True)
    if tight.shape[1] <= 62:
        codes = tight @ (1 << np.arange(tight.shape[1], dtype=np.int64))
        _, first, which, counts = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    else:
        _, first, which, counts = np.unique(
            tight, axis=0, return_index=True, return_inverse=True, return_counts=True
        )
    return which.reshape(-1), [list(np.flatnonzero(s)) for s in tight[first]], counts


def canonical_prices(least: np.ndarray) -> np.ndarray:
    """The one price vector that all optimal assignments of a batch share.

    ``least[e, f]`` is the least extra cost of moving a case from its expert ``e`` to ``f`` in any optimal assignment.  Prices
    that prove an optimum keep ``u[e] <= u[f] + least[e, f]``; the largest of them with the first expert at zero are the shortest
    distances from it, and do not depend on which optimum was found.  Shifted so that the lowest price is zero.
    """
    prices = least[:, 0].copy()
    prices[0] = 0
    for _ in range(len(prices)):
        prices = np.minimum(prices, (prices[None, :] + least).min(axis=1))
    return prices - prices.min()


def canonical_flow(sets: list[list[int]], counts: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Cases of each set to each expert, the same for the sets in any order."""
    order = sorted(range(len(sets)), key=lambda j: sorted(sets[j]))
    flow, _, excess = tight_flow(np.asarray(counts)[order], [sorted(int(k) for k in sets[j]) for j in order], caps)
    if excess:
        raise ValueError("these prices prove no optimum")
    out = np.empty_like(flow)
    out[order] = flow
    return out


def assign_exact(costs: np.ndarray, caps: np.ndarray):
    """Cheapest assignment of rows to experts that fills every capacity exactly.

    ``costs`` are integers, ``caps`` positive and adding up to the number of rows.  Prices of
    over-demanded sets of experts are raised to the next balance point until the cheapest choices
    fit.  Returns (expert of each row, prices); with these prices every row sits at its minimum.  Among equally cheap
    assignments the canonical one is taken: canonical prices, canonical flow, rows of a set in their order.
    """
    if caps.sum() != len(costs):
        raise ValueError(f"capacities add up to {caps.sum()}, not to the {len(costs)} cases")
    prices = np.zeros(len(caps), dtype=np.int64)
    while True:
        reduced = costs + prices
        which, sets, counts = tight_sets(reduced)
        flow, over, excess = tight_flow(counts, sets, caps)
        if excess == 0:
            break
        bound = np.array([over[s].all() for s in sets])[which]
        gaps = reduced[bound][:, ~over].min(axis=1) - reduced[bound].min(axis=1)
        prices[over] += np.partition(gaps, excess - 1)[excess - 1]
    choice = _spread(which, flow)
    least = np.stack([(costs[choice == e] - costs[choice == e, e : e + 1]).min(axis=0) for e in range(len(caps))])
    prices = canonical_prices(least)
    which, sets, counts = tight_sets(costs + prices)
    return _spread(which, canonical_flow(sets, counts, caps)), prices


def _spread(which: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Expert of each row: the rows of a set in order, its experts in order."""
    choice = np.empty(len(which), dtype=np.int64)
    for j in range(len(flow)):
        choice[which == j] = np.repeat(np.arange(flow.shape[1]), flow[j])
    return choice


def assign_in_order(p: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Each row in turn takes its likeliest expert that still has room; -1 when none has.

    Ties go to the first expert.  Works in stretches: between two closings every row's choice is
    its best open expert, so a stretch is one vector step.
    """
    room = caps.astype(np.int64).copy()
    out = np.full(len(p), -1, dtype=np.int64)
    start = 0
    while start < len(p) and (room > 0).any():
        choice = np.where(room > 0, p[start:], -np.inf).argmax(axis=1)
        closing = len(choice)
        for k in np.flatnonzero(room > 0):
            takers = np.flatnonzero(choice == k)
            if len(takers) >= room[k]:
                closing = min(closing, takers[room[k] - 1] + 1)
        out[start : start + closing] = choice[:closing]
        room -= np.bincount(choice[:closing], minlength=len(room))
        start += closing
    return out
