"""What a task does with one group of spectra: distances, clusterings, refinement, medoids. Arrays in, arrays out."""

from __future__ import annotations

import heapq

import numpy as np

from ionweave.operators import tiles

FAR = 1.0


def distances(hv: np.ndarray, mz: np.ndarray, tolerance: float | None, unit: str, kind: type = np.float32) -> np.ndarray:
    """Normalised Hamming distances as float32 values; 1.0 where precursors disagree, or the first does in ppm of the second."""
    n, words = hv.shape
    out = np.zeros((n, n), dtype=kind)
    columns = np.ascontiguousarray(hv.T)
    step = max(1, (1 << 17) // max(1, n))
    for a in range(0, n, step):
        apart = tiles.apart(columns[:, a : a + step], columns)
        d = (apart / (64.0 * words)).astype(np.float32)
        if tolerance is not None:
            gap = np.abs(mz[a : a + step, None] - mz[None, :])
            # the later of the two rows is the one that parts per million refer to
            later = np.where(np.arange(a, a + len(d))[:, None] < np.arange(n)[None, :], mz[None, :], mz[a : a + step, None])
            d[gap >= tolerance if unit == "Da" else gap * 1e6 >= np.abs(later) * tolerance] = FAR
        out[a : a + step] = d
    np.fill_diagonal(out, 0)
    return out


def dense(labels: np.ndarray) -> np.ndarray:
    """Labels from 0 by first member; -1 stays."""
    out, seen = np.full(len(labels), -1, dtype=np.int64), {}
    for k, x in enumerate(labels.tolist()):
        if x >= 0:
            out[k] = seen.setdefault(x, len(seen))
    return out


def components(dist: np.ndarray, eps: float) -> np.ndarray:
    """Connected components of the pairs at most eps apart."""
    n = len(dist)
    label = np.full(n, -1, dtype=np.int64)
    found = 0
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = found
        front = np.array([start])
        while front.size:
            near = (dist[front] <= eps).any(axis=0) & (label < 0)
            label[near] = found
            front = np.flatnonzero(near)
        found += 1
    return label


def dbscan(dist: np.ndarray, eps: float) -> np.ndarray:
    """DBSCAN with two samples: components, with lone rows as noise, -1."""
    label = components(dist, eps)
    counts = np.bincount(label, minlength=1)
    return dense(np.where(counts[label] >= 2, label, -1))


def linkage_cut(dist: np.ndarray, eps: float, method: str) -> np.ndarray:
    """Flat clusters of complete or average linkage at height eps, in each component of the pairs at most eps apart: no cluster
    leaves one."""
    out, base = np.zeros(len(dist), dtype=np.int64), 0
    parts = components(dist, eps)
    order = np.argsort(parts, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(order) else ():
        labels = merged(dist[np.ix_(own, own)], np.ones(len(own)), eps, method) if len(own) > 1 else np.zeros(1, dtype=np.int64)
        out[own] = base + labels
        base += int(labels.max()) + 1
    return dense(out)


def merged(values: np.ndarray, size: np.ndarray, eps: float, method: str) -> np.ndarray:
    """Labels of clusters that complete or average linkage merges up to height eps, in rounds of mutual nearest neighbours.

    ``values`` has the largest distance of two clusters' members, or (average) the sum of all; it is overwritten. The nearest is the
    first of equals, so the least of all pairs is always mutual and ties have one outcome. By both linkages a merge brings no
    cluster nearer to others, so mutual neighbours may merge at once, and neighbours stay where neither of two has merged.
    """
    n, size = len(values), np.array(size, dtype=np.float64)
    average = method == "average"
    # the largest of some distances is one of them, so complete linkage needs no more digits; sums do
    total = values.astype(np.float64, copy=False) if average else values
    parent, alive = np.arange(n), np.ones(n, dtype=bool)
    nearest, height = np.zeros(n, dtype=np.int64), np.full(n, np.inf)
    stale = np.arange(n)
    while True:
        for at in range(0, len(stale), 512):
            rows = stale[at : at + 512]
            d = total[rows] / (size[rows, None] * size[None, :]) if average else total[rows].copy()
            d[:, ~alive] = np.inf
            d[np.arange(len(rows)), rows] = np.inf
            nearest[rows] = d.argmin(axis=1)
            height[rows] = d[np.arange(len(rows)), nearest[rows]]
        own = np.arange(n)
        low = np.flatnonzero(alive & (height <= eps) & (nearest[nearest] == own) & (own < nearest))
        if not low.size:
            return dense(parent)
        high = nearest[low]
        for x, y in ((total, total), (total.T, total.T)):
            x[low] = x[low] + y[high] if average else np.maximum(x[low], y[high])
        size[low] += size[high]
        alive[high], height[high] = False, np.inf
        into = np.arange(n)
        into[high] = low
        parent = into[parent]
        moved = np.zeros(n, dtype=bool)
        moved[low] = moved[high] = True
        stale = np.flatnonzero(alive & (moved | (moved[nearest] & (height <= eps))))


def span_groups(values: np.ndarray, tolerance: float, unit: str | None = None) -> np.ndarray:
    """Complete linkage of numbers, cut at the tolerance: of neighbouring groups the closest merge first, and no group's
    span exceeds the tolerance (in ppm of its least)."""
    # equal values have no gap between them, so they merge before any others do
    distinct, place = np.unique(values, return_inverse=True)
    v = distinct.astype(np.float64)

    def span(lo: float, hi: float) -> float:
        return (hi - lo) / lo * 1e6 if unit == "ppm" and lo else hi - lo

    if not len(v) or span(v[0], v[-1]) <= tolerance:
        return np.zeros(len(values), dtype=np.int64)
    # groups are named by their first place; ``end`` has the place after their last, ``before`` the group to the left
    n = len(v)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(span(v[k], v[k + 1]), k, k + 2) for k in range(n - 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        gap, left, upto = heapq.heappop(heap)
        if gap > tolerance:
            break
        right = end[left]
        # merges since have left this one out of date
        if not alive[left] or right >= n or end[right] != upto:
            continue
        alive[right], end[left] = False, upto
        if upto < n:
            before[upto] = left
            heapq.heappush(heap, (span(v[left], v[end[upto] - 1]), left, end[upto]))
        if before[left] >= 0:
            heapq.heappush(heap, (span(v[before[left]], v[upto - 1]), before[left], upto))
    return (np.cumsum(alive) - 1)[place]


def refine(labels: np.ndarray, mz: np.ndarray, rt: np.ndarray, tolerance: float, unit: str, rt_tolerance: float | None, compat: bool = False, min_samples: int = 2) -> np.ndarray:
    """Split clusters so that precursors (and times) stay within tolerance; what is left alone is noise, -1."""
    out = np.full(len(labels), -1, dtype=np.int64)
    base = 0
    for c in range(int(labels.max(initial=-1)) + 1):
        own = np.flatnonzero(labels == c)
        if len(own) < min_samples:
            continue
        part = span_groups(mz[own], tolerance, unit)
        if rt_tolerance is not None:
            by_time = span_groups(rt[own], rt_tolerance)
            key = part * 2 + by_time * 3 if compat else part * (by_time.max() + 1) + by_time
            part = np.unique(key, return_inverse=True)[1]
        counts = np.bincount(part)
        fresh = np.where(counts >= min_samples, np.cumsum(counts >= min_samples) - 1, -1)
        got = fresh[part]
        out[own] = np.where(got >= 0, got + base, -1)
        base += int((counts >= min_samples).sum())
    return dense(out)


def medoids(labels: np.ndarray, dist: np.ndarray, compat: bool = False) -> np.ndarray:
    """A flag for each row: noise stands for itself, of two the first, of more the one with the least mean distance."""
    flags = labels < 0
    for c in range(int(labels.max(initial=-1)) + 1):
        own = np.flatnonzero(labels == c)
        if len(own) <= 2:
            flags[own[:1]] = True
        elif compat:
            flags[int(np.argmin(dist[own, :].mean(axis=1)))] = True
        else:
            flags[own[int(np.argmin(dist[np.ix_(own, own)].mean(axis=1, dtype=np.float64)))]] = True
    return flags


def distance_totals(hv: np.ndarray, mz: np.ndarray, tolerance: float | None, unit: str) -> np.ndarray:
    """For each of some rows, in order, the bits that differ from all the others; pairs whose precursors disagree differ in all.

    No pairs are made: rows agree with a window of those sorted by m/z, whose ones in each dimension are counted as it slides.
    Where parts per million of one of two rows hold but not of the other, the later row decides; those few are compared.
    """
    n, dim = len(hv), 64 * hv.shape[1]
    bits = hv.view(np.uint8).reshape(n, -1)
    order = np.argsort(mz, kind="stable")
    v = mz[order].astype(np.float64)

    def sure(lo: int, hi: int) -> bool:
        gap = v[hi] - v[lo]
        return tolerance is None or (gap < tolerance if unit == "Da" else gap * 1e6 < min(abs(v[lo]), abs(v[hi])) * tolerance)

    def maybe(lo: int, hi: int) -> bool:
        return unit != "Da" and (v[hi] - v[lo]) * 1e6 < max(abs(v[lo]), abs(v[hi])) * tolerance

    out = np.zeros(n, dtype=np.int64)
    if n and sure(0, n - 1):
        ones = np.zeros(dim, dtype=np.int64)
        for at in range(0, n, 1024):
            ones += np.unpackbits(bits[at : at + 1024], axis=1).sum(axis=0, dtype=np.int64)
        for at in range(0, n, 1024):
            own = np.unpackbits(bits[at : at + 1024], axis=1).astype(np.int64)
            out[at : at + 1024] = ones.sum() + own @ (n - 2 * ones)
        return out
    ones, first, last = np.zeros(dim, dtype=np.int64), 0, 0
    for k in range(n):
        while last < n and (last <= k or sure(k, last)):
            ones += np.unpackbits(bits[order[last]])
            last += 1
        while first < k and not sure(first, k):
            ones -= np.unpackbits(bits[order[first]])
            first += 1
        i, width = order[k], last - first
        own = np.unpackbits(bits[i]).astype(bool)
        out[i] += ones.sum() + (width - 2 * ones[own]).sum() + dim * (n - width)
        other = last
        while other < n and maybe(k, other):
            j = order[other]
            later = v[k] if i > j else v[other]
            if (v[other] - v[k]) * 1e6 < abs(later) * tolerance:
                apart = int(np.bitwise_count(hv[i] ^ hv[j]).sum())
                out[i] -= dim - apart
                out[j] -= dim - apart
            other += 1
    return out


def settled_group(hv, mz, rt, tolerance: float, unit: str, rt_tolerance: float | None, do_refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and representatives of the rows of one cluster, which is refined without its pairs."""
    labels = np.zeros(len(hv), dtype=np.int64)
    if do_refine:
        labels = refine(labels, mz, rt, tolerance, unit, rt_tolerance)
    return labels, medoids_without_table(labels, hv, mz, tolerance, unit)


#: Rows up to which all of a group's distances are held as a table.
TABLE = 1024


def without_table(hv, mz, algorithm: str, eps: float, tolerance: float, unit: str) -> np.ndarray:
    """Labels of a group by its vectors, of which a strip is compared at a time. Complete and average linkage hold the near pairs of rows that
    are not alike; where these are so many that a table takes less, they have one for a component at a time, which is not copied."""
    x = tiles.Vectors(hv, mz, np.arange(len(hv)))
    most = tiles.most_bits(x.dim, eps)
    if algorithm in ("hc_single", "dbscan"):
        label = tiles.connected(x, most, tolerance, unit)
        counts = np.bincount(label)
        return dense(label if algorithm == "hc_single" else np.where(counts[label] >= 2, label, -1))
    average = algorithm == "hc_average"
    near = tiles.Near(x, average, eps, tolerance, unit)
    if near.find(min(tiles.NEAR, len(near.x) ** 2 // 16)):
        return dense(near.labels())
    out, label = np.arange(len(near.x)), tiles.connected(near.x, most, tolerance, unit)
    order = np.argsort(label, kind="stable")
    for own in np.split(order, np.cumsum(np.bincount(label))[:-1]):
        if len(own) > 1:
            at, size = near.first[own], near.weight[own].astype(np.float64)
            dist = distances(hv[at], mz[at], tolerance, unit, np.float64 if average else np.float32)
            if average:
                dist *= size[:, None]
                dist *= size[None, :]
            found = merged(dist, size, eps, algorithm.removeprefix("hc_"))
            out[own] = own[np.unique(found, return_index=True)[1]][found]
    return dense(out[near.kind])


def medoids_without_table(labels: np.ndarray, hv, mz, tolerance: float, unit: str) -> np.ndarray:
    """``medoids`` by totals of distances that make no pairs."""
    flags = labels < 0
    order = np.argsort(labels, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        if labels[own[0]] >= 0:
            flags[own[0] if len(own) <= 2 else own[int(np.argmin(distance_totals(hv[own], mz[own], tolerance, unit)))]] = True
    return flags


def cluster_group(hv, mz, rt, algorithm: str, eps: float, tolerance: float, unit: str, rt_tolerance: float | None, do_refine: bool, compat: bool) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and representatives of one group, whose rows are in order."""
    if len(hv) == 1:
        return np.array([-1]), np.array([True])
    if len(hv) > TABLE and not compat:
        labels = without_table(hv, mz, algorithm, eps, tolerance, unit)
        if do_refine:
            labels = refine(labels, mz, rt, tolerance, unit, rt_tolerance)
        return labels, medoids_without_table(labels, hv, mz, tolerance, unit)
    dist = distances(hv, mz, tolerance, "ppm" if compat else unit)
    if algorithm == "dbscan":
        labels = dbscan(dist, eps)
    elif algorithm == "hc_single":
        labels = dense(components(dist, eps))
    else:
        labels = linkage_cut(dist, eps, algorithm.removeprefix("hc_"))
    if do_refine:
        labels = refine(labels, mz, rt, tolerance, unit, rt_tolerance, compat)
    return labels, medoids(labels, dist, compat)
