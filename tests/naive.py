"""Slow versions, written apart from the engine's, to hold it against."""

import itertools


def hamming(a, b):
    return sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(a, b)) / (64 * len(a))


def bfs_components(n, linked):
    seen, out = set(), []
    for start in range(n):
        if start in seen:
            continue
        part, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in range(n):
                if y not in part and linked(x, y):
                    part.add(y)
                    todo.append(y)
        seen |= part
        out.append(frozenset(part))
    return set(out)


def agglomerate(dist, eps, method):
    """Merge the closest two groups while they are at most eps apart."""
    groups = [frozenset([k]) for k in range(len(dist))]
    join = max if method == "complete" else (lambda x: sum(x) / len(x))
    while len(groups) > 1:
        best = min(((join([dist[i][j] for i in a for j in b]), k, m) for (k, a), (m, b) in itertools.combinations(enumerate(groups), 2)), key=lambda x: x[0])
        if best[0] > eps:
            break
        _, k, m = best
        merged = groups[k] | groups[m]
        groups = [g for i, g in enumerate(groups) if i not in (k, m)] + [merged]
    return set(groups)


def partition(labels, noise_alone=True):
    groups = {}
    for k, x in enumerate(labels):
        groups.setdefault(("noise", k) if x < 0 and noise_alone else x, set()).add(k)
    return {frozenset(g) for g in groups.values()}
