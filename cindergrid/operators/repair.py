"""Rings that cross themselves, rebuilt by the even-odd rule as rings that don't."""

import numpy as np
import pyarrow as pa

BLOCK = 1024


def split(ring):
    """The parts of a ring's edges between all points where it meets itself, each once; parts that it runs along an even number of times are gone."""
    ring = [p for p, q in zip(ring, ring[1:] + ring[:1]) if p != q]
    a = np.array(ring, float).reshape(-1, 2)
    d = np.roll(a, -1, axis=0) - a
    n = len(a)
    low, high = np.minimum(a, a + d), np.maximum(a, a + d)
    cuts = [{0.0: tuple(p), 1.0: tuple(q)} for p, q in zip(a.tolist(), np.roll(a, -1, axis=0).tolist())]
    for at in range(0, n, BLOCK):
        block = slice(at, at + BLOCK)
        near = (low[block, None] <= high[None]).all(2) & (low[None] <= high[block, None]).all(2)
        for i, j in zip(*np.nonzero(near)):
            i += at
            if i < j:
                meet(a, d, i, j, cuts)
    parts = {}
    for places in cuts:
        along = [places[t] for t in sorted(places)]
        for p, q in zip(along, along[1:]):
            if p != q:
                parts[min((p, q), (q, p))] = parts.get(min((p, q), (q, p)), 0) + 1
    return [e for e, times in parts.items() if times % 2]


def meet(a, d, i, j, cuts):
    """Notes where two edges meet, in both; a shared point is the same pair of numbers in either."""
    gap, turn = a[j] - a[i], d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    if turn:
        t, u = ((gap[0] * v[1] - gap[1] * v[0]) / turn for v in (d[j], d[i]))
        if 0 <= t <= 1 and 0 <= u <= 1:
            point = cuts[i].get(t) or cuts[j].get(u) or tuple((a[i] + t * d[i]).tolist())
            cuts[i].setdefault(float(t), point)
            cuts[j].setdefault(float(u), point)
    elif gap[0] * d[i, 1] == gap[1] * d[i, 0]:
        # Along one line: each one's ends that lie on the other.
        for k, m in ((i, j), (j, i)):
            for end in (0.0, 1.0):
                t = float((cuts[m][end] - a[k]) @ d[k] / (d[k] @ d[k]))
                if 0 < t < 1:
                    cuts[k].setdefault(t, cuts[m][end])


def rings_of(parts):
    """Rings along parts, each with the inside on its left: outside rings run anticlockwise, holes clockwise. Where rings touch in a point they part there."""
    p, q = (np.array([e[k] for e in parts]) for k in (0, 1))
    way = q - p
    middle = (p + q) / 2
    directed = {}
    for k in range(len(parts)):
        # The part itself is met at its middle; whether it has the inside on its left is the parity of all others on one side of it.
        x, y = middle[k]
        if abs(way[k, 1]) > abs(way[k, 0]):
            met = ((p[:, 1] > y) != (q[:, 1] > y)) & (np.arange(len(p)) != k)
            right = (p[met, 0] + (y - p[met, 1]) * way[met, 0] / way[met, 1] > x).sum() % 2
            ahead = bool(right) == (way[k, 1] < 0)
        else:
            met = ((p[:, 0] > x) != (q[:, 0] > x)) & (np.arange(len(p)) != k)
            above = (p[met, 1] + (x - p[met, 0]) * way[met, 1] / way[met, 0] > y).sum() % 2
            ahead = bool(above) == (way[k, 0] > 0)
        a, b = parts[k] if ahead else parts[k][::-1]
        directed.setdefault(a, []).append(b)
    out = []
    while directed:
        start = min(directed)
        ring, here = [start], directed[start].pop()
        if not directed[start]:
            del directed[start]
        while here != start:
            ring.append(here)
            back = np.arctan2(ring[-2][1] - here[1], ring[-2][0] - here[0])
            # Of the ways on, the first clockwise from the way back.
            ways = directed[here]
            best = min(range(len(ways)), key=lambda k: (back - np.arctan2(ways[k][1] - here[1], ways[k][0] - here[0])) % (2 * np.pi) or 2 * np.pi)
            here, at = ways.pop(best), here
            if not ways:
                del directed[at]
        out += parted(ring)
    return out


def parted(ring):
    """A ring that comes back to a point before its end, as rings that don't."""
    out, path, seen = [], [], {}
    for v in ring:
        if v in seen:
            at = seen[v]
            out.append(path[at:])
            for w in path[at + 1:]:
                del seen[w]
            del path[at + 1:]
        else:
            seen[v] = len(path)
            path.append(v)
    return [r for r in [*out, path] if len(r) >= 3]


def signed(ring):
    x, y = np.array(ring, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def inside(ring, point):
    a, (x, y) = np.array(ring, float), point
    b = np.roll(a, -1, axis=0)
    met = (a[:, 1] > y) != (b[:, 1] > y)
    return bool((a[met, 0] + (y - a[met, 1]) * (b[met, 0] - a[met, 0]) / (b[met, 1] - a[met, 1]) > x).sum() % 2)


def heights_of(a, b):
    """All heights at which edges end or cross."""
    low, high, m = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1]), (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    base, found = a[:, 0] - m * a[:, 1], [a[:, 1], b[:, 1]]
    for at in range(0, len(a), BLOCK):
        block = slice(at, at + BLOCK)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (base[None] - base[block, None]) / (m[block, None] - m[None])
        found.append(y[(y > np.maximum(low[block, None], low[None])) & (y < np.minimum(high[block, None], high[None]))])
    return np.unique(np.concatenate(found))


def level_area(ring):
    """What a ring encloses by the even-odd rule: the stretches between its edges in the middle of all slabs between two heights."""
    a = np.array(ring, float)
    b = np.roll(a, -1, axis=0)
    a, b = a[a[:, 1] != b[:, 1]], b[a[:, 1] != b[:, 1]]
    if not len(a):
        return 0.0
    heights, total = heights_of(a, b), 0.0
    for at in range(0, len(heights) - 1, BLOCK):
        y = heights[at:at + BLOCK + 1]
        middle, deep = ((y[1:] + y[:-1]) / 2)[:, None], np.diff(y)
        x = np.where((a[:, 1] > middle) != (b[:, 1] > middle), a[:, 0] + (middle - a[:, 1]) * ((b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])), np.inf)
        x.sort(axis=1)
        even = x.shape[1] // 2 * 2
        x = np.where(np.isfinite(x), x, 0.0)[:, :even]
        total += float(((x[:, 1::2] - x[:, ::2]).sum(1) * deep).sum())
    return total


def trapezoids(ring):
    """What a ring encloses by the even-odd rule, as trapezoids between two heights and two edges; no order of points along an edge is taken from rounded numbers."""
    a = np.array(ring, float)
    b = np.roll(a, -1, axis=0)
    a, b = a[a[:, 1] != b[:, 1]], b[a[:, 1] != b[:, 1]]
    if not len(a):
        return []
    heights, low, high = heights_of(a, b), np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    place = lambda k, y: a[k, 0] + (y - a[k, 1]) * (b[k, 0] - a[k, 0]) / (b[k, 1] - a[k, 1])
    out, open_ = [], {}
    for y0, y1 in zip(heights, heights[1:]):
        own = np.flatnonzero((low <= y0) & (high >= y1))
        own = own[np.argsort(place(own, (y0 + y1) / 2), kind="stable")].tolist()
        pairs = list(zip(own[::2], own[1::2]))
        # A pair of edges that goes on from the slab below is one trapezoid with it.
        out += [(k, y, y0) for k, y in open_.items() if k not in set(pairs)]
        open_ = {k: open_.get(k, y0) for k in pairs}
    out += [(k, y, heights[-1]) for k, y in open_.items()]
    found = []
    for (left, right), y0, y1 in out:
        corners = [(float(place(k, y)), float(y)) for k, y in ((left, y0), (right, y0), (right, y1), (left, y1))]
        corners = [v for v, w in zip(corners, corners[-1:] + corners[:-1]) if v != w]
        if len(corners) >= 3 and signed(corners) > 0:
            found.append(corners)
    return found


def polygons_of(ring):
    """Polygons (an outside ring and its holes) of what a ring encloses by the even-odd rule; none if it encloses nothing or has a place that is not finite.

    Where points of a ring lie so near to other edges that rounded crossings don't close to rings, or not around the ring's area, the polygons are trapezoids that touch in sides.
    """
    if ring is None or any(v is None or v[0] is None or v[1] is None or not np.isfinite(v).all() for v in ring):
        return []
    ring = [tuple(map(float, v)) for v in ring]
    whole = level_area(ring) if len(ring) >= 3 else 0.0
    try:
        found = walked(ring)
    except KeyError:
        return [[r] for r in trapezoids(ring)]
    area = sum(signed(r) for p in found for r in p)
    return found if abs(area - whole) <= 1e-9 * max(1.0, whole) else [[r] for r in trapezoids(ring)]


def walked(ring):
    """Polygons along the parts of a ring; an error where rounded parts don't close."""
    parts = split(ring)
    rings = [(signed(r), r) for r in (rings_of(parts) if len(parts) >= 3 else [])]
    outer = sorted((a, r) for a, r in rings if a > 0)
    found = [[r] for _, r in outer]
    for a, r in rings:
        if a < 0:
            # The middle of an edge isn't on another ring; the smallest outside ring around it has the hole.
            point = tuple(np.mean([r[0], r[1]], axis=0))
            home = next((k for k, (_, o) in enumerate(outer) if inside(o, point)), None)
            if home is not None:
                found[home].append(r)
    return found


def repaired(df, key, ring):
    """key, part, rings: the polygons that each row's ring encloses, numbered from 0; rings first the outside, then holes. Each row is repaired by itself, in time that grows with the square of its vertices."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches):
        for batch in batches:
            for k, r in zip(batch.column(0), batch.column(1).to_pylist()):
                found = polygons_of(r and [(v["x"], v["y"]) if v else None for v in r])
                rows = [[[{"x": x, "y": y} for x, y in one] for one in p] for p in found]
                yield pa.record_batch([pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), pa.array(range(len(rows)), pa.int32()), pa.array(rows, kind)], names=[key, "part", "rings"])
    return df.select(key, ring).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, part int, rings array<array<struct<x:double,y:double>>>")
