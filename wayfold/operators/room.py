"""Room along lines inside areas, many rows at a time.

What :func:`wayfold.operators.polygons.medial_width` asks of a row, in arrays: a
step is taken for all lines, edges or samples that have one more, in the order of
Spark's functions of lists, so that sums round alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Samples that are held at a time, but for a row that has more.
SAMPLES = 1 << 16
FIELDS = ("w", "v", "g")


@dataclass
class Runs:
    """Segments of many owners, those of one side by side."""

    first: np.ndarray
    count: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray

    def __post_init__(self) -> None:
        self.dx, self.dy = self.bx - self.ax, self.by - self.ay
        self.square = self.dx * self.dx + self.dy * self.dy
        self.n = np.sqrt(self.square)

    def steps(self, of: np.ndarray):
        """For k = 0, 1, ...: which of the asking, each with its owner in ``of``, have a segment k, and which one that is."""
        use, k, own = np.arange(len(of)), 0, self.count[of]
        while len(use := use[own[use] > k]):
            yield use, self.first[of[use]] + k
            k += 1

    def away(self, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance to the nearest segment of the owner, infinite without any."""
        best = np.full(len(of), np.inf)
        for use, s in self.steps(of):
            best[use] = np.minimum(best[use], self._distance(s, x[use], y[use]))
        return best

    def _distance(self, s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ax, ay, dx, dy, square = self.ax[s], self.ay[s], self.dx[s], self.dy[s], self.square[s]
        t = np.where(square > 0, np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(square > 0, square, 1), 0, 1), 0)
        ex, ey = x - (ax + t * dx), y - (ay + t * dy)
        return np.sqrt(ex * ex + ey * ey)

    def holds(self, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the places lie within an odd number of the owner's rings."""
        odd = np.zeros(len(of), bool)
        for use, s in self.steps(of):
            ay, by, py = self.ay[s], self.by[s], y[use]
            hit = (ay > py) != (by > py)
            dy = np.where(hit, by - ay, 1)
            odd[use] ^= hit & (x[use] < self.dx[s] * (py - ay) / dy + self.ax[s])
        return odd

    def lengths(self) -> np.ndarray:
        total = np.zeros(len(self.count))
        for use, s in self.steps(np.arange(len(total))):
            total[use] += self.n[s]
        return total

    def at(self, of: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that lie ``d`` along their owners, of which each has a segment."""
        left, x, y = d.astype(float), self.ax[self.first[of]], self.ay[self.first[of]]
        for use, s in self.steps(of):
            go = left[use] > 0
            if not go.any():
                break
            use, s = use[go], s[go]
            n = self.n[s]
            t = np.where(n > 0, np.clip(left[use] / np.where(n > 0, n, 1), 0, 1), 0)
            x[use], y[use] = self.ax[s] + t * self.dx[s], self.ay[s] + t * self.dy[s]
            left[use] -= n
        return x, y


def _begins(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def _sums(count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of ``sizes``, cut into stretches of ``count``."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(count)])])


def _linked(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, closed: bool = False) -> Runs:
    """Segments between neighbouring vertices; closed ones have one from the last vertex to the first."""
    first, of = _begins(sizes), np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) - first[of]
    count = np.where(sizes >= 2, sizes if closed else sizes - 1, 0)
    a = np.flatnonzero(at < count[of])
    b = np.where(at[a] + 1 < sizes[of[a]], a + 1, first[of[a]])
    return Runs(_begins(count), count, x[a], y[a], x[b], y[b])


def _grouped(runs: Runs, parts: np.ndarray) -> Runs:
    """The segments by rows of ``parts`` owners each."""
    count = _sums(parts, runs.count)
    return Runs(_begins(count), count, runs.ax, runs.ay, runs.bx, runs.by)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _plain(lists: pa.Array, deep: int) -> np.ndarray:
    """Which rows have no null at any depth and only finite coordinates."""
    if deep < 0:
        both = [pc.is_finite(pc.struct_field(lists, c).cast(pa.float64())) for c in "xy"]
        fine = pc.fill_null(pc.and_kleene(*both), False)
        return pc.and_(fine, lists.is_valid()).to_numpy(zero_copy_only=False)
    sizes = _sizes(lists)
    inner = _plain(lists.flatten(), deep - 1)
    return lists.is_valid().to_numpy(zero_copy_only=False) & (_sums(sizes, inner.astype(np.int64)) == sizes)


def _vertices(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tuple(pc.struct_field(flat, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")


def _crossings(lines: Runs, rows: np.ndarray, edges: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(segment, share of it) of all crossings of the segments' whole lines with the edges of their rows, by segment and share."""
    ax, ay, dx, dy = lines.ax, lines.ay, lines.dx, lines.dy
    found = [(np.empty(0, np.int64), np.empty(0))]
    long = np.flatnonzero(lines.n > 0)
    for use, e in edges.steps(rows[long]):
        s = long[use]

        def side(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return dx[s] * (y - ay[s]) - dy[s] * (x - ax[s])

        sa, sb = side(edges.ax[e], edges.ay[e]), side(edges.bx[e], edges.by[e])
        hit = np.flatnonzero((sa > 0) != (sb > 0))
        s, e, at = s[hit], e[hit], sa[hit] / (sa[hit] - sb[hit])
        px, py = edges.ax[e] + at * edges.dx[e], edges.ay[e] + at * edges.dy[e]
        found.append((s, ((px - ax[s]) * dx[s] + (py - ay[s]) * dy[s]) / lines.square[s]))
    s, share = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((share, s))
    return s[by], share[by]


def _stretches(lines: Runs, edges: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the stretches of lines that lie in their areas, in order; touching ones are one."""
    rows = np.repeat(np.arange(len(lines.count)), lines.count)
    done, sums = np.zeros(len(rows)), np.zeros(len(lines.count))
    for use, s in lines.steps(np.arange(len(lines.count))):
        done[s] = sums[use]
        sums[use] += lines.n[s]
    s, share = _crossings(lines, rows, edges)
    new = np.flatnonzero(np.diff(s, prepend=-1))
    place = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    a = np.flatnonzero((place % 2 == 0) & (np.append(s[1:], -1) == s)) if len(s) else np.empty(0, np.int64)
    low, high = np.maximum(share[a], 0.0), share[a + 1] if len(a) else np.empty(0)
    kept = low < np.minimum(high, 1.0)
    a, low, high = a[kept], low[kept], np.minimum(high[kept], 1.0)
    own = s[a]
    row, start, end = rows[own], done[own] + low * lines.n[own], done[own] + high * lines.n[own]
    if not len(row):
        return row, start, end
    apart = np.append(True, (row[1:] != row[:-1]) | ~(start[1:] - end[:-1] <= 1e-9))
    begin = np.flatnonzero(apart)
    return row[begin], start[begin], end[np.append(begin[1:], len(row)) - 1]


def _cut(lines: Runs, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Runs:
    """The stretches as lines of their own."""
    parts, done = [], np.zeros(len(row))
    for use, s in lines.steps(row):
        done[use] = done[use] + lines.n[s]
        inner = (done[use] > start[use]) & (done[use] < end[use])
        parts.append((use[inner], lines.bx[s[inner]], lines.by[s[inner]]))
    every = np.arange(len(row))
    parts = [(every, *lines.at(row, start)), *parts, (every, *lines.at(row, end))]
    of, x, y = (np.concatenate(v) for v in zip(*parts))
    by = np.argsort(of, kind="stable")
    return _linked(np.bincount(of, minlength=len(row)), x[by], y[by])


def measured(line: pa.Array, rings: pa.Array, x: pa.Array, y: pa.Array, walls: pa.Array | None, trim: float, least_length: float, least_samples: int, slack: float) -> pa.Array:
    """A struct a row: status, n and, by field and place in order (least, tenth, upper median), numbers; null where a coordinate or list is not known or not finite.

    Fields are room, room with walls, and wall less edge.
    """
    n_rows = len(line)
    at = pc.and_(pc.is_finite(x.cast(pa.float64())), pc.is_finite(y.cast(pa.float64())))
    fine = _plain(line, 0) & _plain(rings, 1) & pc.fill_null(at, False).to_numpy(zero_copy_only=False)
    if walls is not None:
        fine &= _plain(walls, 1)
    status = np.full(n_rows, None, object)
    n = np.zeros(n_rows, np.int64)
    numbers = {f"{f}{k}": np.full(n_rows, np.nan) for f in FIELDS for k in range(3)}
    use = np.flatnonzero(fine)
    if len(use):
        take = pa.array(use)
        line, rings = line.take(take), rings.take(take)
        px, py = (v.take(take).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y))
        lines = _linked(_sizes(line), *_vertices(line.flatten()))
        areas = _nested(rings, closed=True)
        obstacles = _nested(walls.take(take)) if walls is not None else None
        said = np.where(_sizes(rings) == 0, "no area", "not inside").astype(object)
        row, start, end = _stretches(lines, areas)
        own = _cut(lines, row, start, end)
        d = own.away(np.arange(len(row)), px[row], py[row])
        by = np.lexsort((start, d, row))
        by = by[np.diff(row[by], prepend=-1) != 0]  # the nearest of each row, the first of equal ones
        row, long = row[by], own.lengths()[by] + slack
        said[row] = np.where(long < least_length, "too short", "too few samples")
        each = np.floor(long - 2 * trim).astype(np.int64) + 1
        each[(long < least_length) | (each < least_samples)] = 0
        open_ = np.flatnonzero(each)
        ends = np.cumsum(each[open_])
        done = 0
        while done < len(open_):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SAMPLES, side="right")))
            part = open_[done:to]
            i, m, got = _samples(own, by[part], row[part], each[part], areas, obstacles, trim, least_samples)
            said[i], n[use[i]] = "ok", m
            for name, value in got.items():
                numbers[name][use[i]] = value
            done = to
        status[use] = said
    names = ["status", "n", *numbers]
    none = np.array([s != "ok" for s in status], bool)
    columns = [pa.array(status, pa.string()), pa.array(n, pa.int32(), mask=none)]
    columns += [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in numbers.values()]
    return pa.StructArray.from_arrays(columns, names)


def _nested(lists: pa.Array, closed: bool = False) -> Runs:
    inner = lists.flatten()
    return _grouped(_linked(_sizes(inner), *_vertices(inner.flatten()), closed), _sizes(lists))


def _samples(own: Runs, stretch: np.ndarray, row: np.ndarray, each: np.ndarray, areas: Runs, obstacles: Runs | None, trim: float, least: int):
    """(rows, how many samples, their numbers) of those that have enough samples."""
    of = np.repeat(np.arange(len(row)), each)
    x, y = own.at(stretch[of], np.arange(len(of)) - _begins(each)[of] + trim)
    edge = areas.away(row[of], x, y)
    held = np.flatnonzero((edge == 0) | areas.holds(row[of], x, y))
    of, x, y, edge = of[held], x[held], y[held], edge[held]
    m = np.bincount(of, minlength=len(row))
    ok = np.flatnonzero(m >= least)
    first, m = _begins(m)[ok], m[ok]
    places = [first, first + np.maximum(1, m // 10) - 1, first + m // 2]
    values = {"w": 2 * edge}
    if obstacles is not None:
        near = obstacles.away(row[of], x, y)
        values |= {"v": 2 * np.minimum(edge, near), "g": np.where(np.isinf(near), np.nan, near - edge)}
    got = {}
    for field, value in values.items():
        value = value[np.lexsort((value, of))]
        got |= {f"{field}{k}": value[i] for k, i in enumerate(places)}
    return row[ok], m, got
