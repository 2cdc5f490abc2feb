"""N-gram Jaccard self-join with count-vector R-trees.

A document is the set of its distinct five-word shingles (64-bit hashes); equal sets are one class.
Shingles are hashed into GROUPS groups, and the counts per group are the class's point. The overlap of
two sets is at most the sum over groups of the smaller count, and of two rectangles at most the sum of
the smaller upper corners; an R-tree packed by size and coordinates drops pairs of subtrees by that
bound and by size, the points of large sets are compared in more groups, and the pairs that survive are
verified on the sets themselves.

One tree over everything would not do: in so many dimensions rectangles of unrelated texts overlap, and
each point would meet most leaves. So there is a tree per shingle: two sets with Jaccard >= t share one
of the first n - ceil(t * n) + 1 shingles of each in any common order, and trees hold the classes that
have the shingle there. A pair is looked for at the first shingle that its sets share, so no more than
what follows that shingle in either can be common. Frequent shingles come last in the order, so that
passages that many documents share don't bring them together. Shingles that the very same classes have
make one tree, that of the first of them.

A tree is searched in two passes. The first has points only and tells which of its classes have any
partner that the bounds allow; only these get their sets, and the second verifies pairs, the likest first,
and gives links that join what isn't joined yet, so a tree gives fewer links than it has classes however
many pairs agree. Subtrees whose classes are joined already are left out. A shingle of more than CELL
classes (or MEMBERS shingles in all) has a tree for each tile of about that size, tiles being cut by size
first: tiles are searched, then one leader for each component of a tile meets the other tiles' leaders, and
at last the pairs of tiles that may still hold a link between components. No link that could join two
components is skipped.

Defined results: A-Z are lower-cased; null text and text without words have no shingle, a component of
their own, and link with nothing; fewer words than five are one shingle; very long texts count whole;
equal sets link; a null doc_id comes after all others as the name of a component; an empty table gives an
empty result; repeated rows link with each other; other columns are ignored, or kept by one_of_each,
whatever their names (but those that begin with _tm_).
"""

from __future__ import annotations

from itertools import count as numbers_from

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import LOWER, batched, components, forget, joined_bytes, mix, placed, saved, spans, summed, with_numbers, word_hashes, words

SHINGLE, GROUPS, LEAF = 5, 64, 8
#: Doublings of GROUPS that a large set's point may have; trees have GROUPS.
FINEST = 6
#: Classes and shingles of a tile, about.
CELL, MEMBERS = 2048, 1 << 20
#: A shingle is frequent if FREQUENT different texts of some batch have it; so many come last, the most frequent first chosen.
FREQUENT, MOST_FREQUENT = 4, 1 << 16
#: Pairs of points, and probes of sets, looked at together; and the most bits (a power of two) of a set, by which pairs are dropped before they are probed.
PAIRS, PROBES, BITS = 20_000, 1 << 16, 15


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row in ascending order, one row after the other, and their numbers."""
    data = LOWER[data]
    first, last = words(data)
    hashes = word_hashes(data, first, last)
    n = np.diff(np.searchsorted(first, starts))
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = spans(np.cumsum(n) - n, count)
    length = np.repeat(np.minimum(n, size), count)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = mix(total + np.where(k < length, padded[at + k], np.uint64(0))) if k else total + padded[at]
            total *= np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(count)
    for i in np.flatnonzero(count > 1):
        total[ends[i] - count[i] : ends[i]].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[(ends - count)[count > 0]] = True
    return total[new], summed(new.astype(np.int64), count)


def class_ids(values: np.ndarray, count: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit id of each set: of its size and the sum of its mixed members."""
    with np.errstate(over="ignore"):
        total = summed(mix((values ^ np.uint64(0xD6E8FEB86659FD93)) + np.uint64(seed)), count)
        return mix(total + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Members that another set must share with one of n."""
    return -(-n * percent // 100)


def prefixes(values: np.ndarray, count: np.ndarray, last: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each set in the order (frequent or not, hash), their places in it, and their numbers. last: the frequent ones, sorted."""
    take = np.where(count > 0, count - needed(count, percent) + 1, 0)
    begin = np.cumsum(count) - count
    if len(last) and len(values):
        late = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values
        values = values[np.argsort(2 * np.repeat(np.arange(len(count)), count) + late, kind="stable")]
    return values[spans(begin, take)], spans(np.zeros(len(take), np.int64), take), take


def points(values: np.ndarray, count: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """(sets, groups): members of each set in each group."""
    cell = np.repeat(np.arange(len(count)), count) * groups + (values % np.uint64(groups)).astype(np.int64)
    return np.bincount(cell, minlength=len(count) * groups).reshape(-1, groups).astype(np.int32)


def groups_of(n: np.ndarray) -> np.ndarray:
    """How many groups the point of a set of n has: a power of two, so that a group holds three members at most on average."""
    return GROUPS << np.clip(np.ceil(np.log2(np.maximum(n, 1) / (3 * GROUPS))), 0, FINEST).astype(np.int64)


class Points:
    """Points of sets of different sizes. Halves of a point add up to the point in half as many groups."""

    def __init__(self, column, n: np.ndarray, percent: int):
        rows = [x.as_buffer() for chunk in getattr(column, "chunks", [column]) for x in chunk]
        self.n, self.percent, self.groups = n, percent, groups_of(n)
        self.coarse = np.zeros((len(n), GROUPS), np.int32)
        self.place: dict[int, np.ndarray] = {}
        self.fine: dict[int, np.ndarray] = {}
        for g in np.unique(self.groups).tolist():
            own = np.flatnonzero((self.groups == g) | (self.groups == 2 * g))
            kind = {1: np.uint8, 2: np.uint16, 4: np.int32}
            points = [np.frombuffer(rows[k], kind[rows[k].size // self.groups[k]]).astype(np.int32).reshape(-1, g).sum(axis=0, dtype=np.int32) for k in own.tolist()]
            self.place[g], self.fine[g] = np.zeros(len(n), np.int64), np.stack(points)
            self.place[g][own] = np.arange(len(own))
            self.coarse[own] = self.fine[g].reshape(len(own), -1, GROUPS).sum(axis=1)

    def likely(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows may link by their points in as many groups as both have. Sizes that may link differ by one doubling of groups at most."""
        out = np.ones(len(x), bool)
        level = np.minimum(self.groups[x], self.groups[y])
        for g in np.unique(level[level > GROUPS]).tolist():
            own = np.flatnonzero(level == g)
            for at in range(0, len(own), most := max(1, PAIRS * GROUPS // g)):
                k = own[at : at + most]
                i, j = x[k], y[k]
                overlap = np.minimum(self.fine[g][self.place[g][i]], self.fine[g][self.place[g][j]]).sum(axis=1)
                out[k] = (100 + self.percent) * overlap >= self.percent * (self.n[i] + self.n[j])
        return out


def packed(values: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The points of sets, each in its own number of groups and of the narrowest integers."""
    out: list[bytes] = [b""] * len(count)
    begin, groups = np.cumsum(count) - count, groups_of(count)
    for g in np.unique(groups).tolist():
        own = np.flatnonzero(groups == g)
        for k, p in zip(own.tolist(), points(values[spans(begin[own], count[own])], count[own], g), strict=True):
            most = p.max(initial=0)
            out[k] = p.astype(np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.int32).tobytes()
    return out


class Forest:
    """A packed R-tree for each cell, all built and searched at once.

    Entries of a level lie cell by cell; the next level has one for every LEAF of a cell, until each cell
    has one root. An entry keeps its upper corner and the range of sizes, and that of two labels: pairs
    whose labels agree aren't wanted. `part` never changes; `label` does, as components grow.
    """

    def __init__(self, point: np.ndarray, size: np.ndarray, rest: np.ndarray, cell: np.ndarray, part: np.ndarray, label: np.ndarray, percent: int):
        self.percent = percent
        m = np.bincount(cell)
        first = np.cumsum(m) - m
        # Leaves are packed by part and size, then along the coordinate that varies most among like sizes.
        slab = np.lexsort((size, part, cell))
        tile = spans(np.zeros(len(m), np.int64), m) // np.repeat(LEAF * np.maximum(1, np.sqrt(m / LEAF).astype(np.int64)), m)
        wide = point[slab].astype(np.float64)
        spread = np.add.reduceat(wide**2, first, axis=0) * m[:, None] - np.add.reduceat(wide, first, axis=0) ** 2
        along = wide[np.arange(len(slab)), np.repeat(spread.argmax(axis=1), m)]
        self.order = slab[np.lexsort((along, tile, part[slab], cell[slab]))]
        self.rest = rest[self.order]
        self.levels = [(point[self.order], size[self.order], size[self.order])]
        self.cuts: list[np.ndarray] = []
        while m.max(initial=1) > 1:
            n = -(-m // LEAF)
            cut = np.repeat(np.cumsum(m) - m, n) + LEAF * spans(np.zeros(len(n), np.int64), n)
            high, low, top = self.levels[-1]
            self.levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)))
            self.cuts.append(cut)
            m = n
        self.part = self.ranges(part[self.order])
        self.relabel(label)

    def ranges(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(label, label)]
        for cut in self.cuts:
            out.append((np.minimum.reduceat(out[-1][0], cut), np.maximum.reduceat(out[-1][1], cut)))
        return out

    def relabel(self, label: np.ndarray) -> None:
        """Labels of the points, in the order given first."""
        self.label = self.ranges(label[self.order])

    def wanted(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of entries may hold a pair of points that links and whose labels differ."""
        high, low, top = self.levels[level]
        p = self.percent
        fits = (100 * top[y] >= p * low[x]) & (100 * top[x] >= p * low[y])
        lo, hi = self.label[level]
        fits &= (lo[x] != hi[x]) | (lo[y] != hi[y]) | (lo[x] != lo[y])
        if self.two:
            lo, hi = self.part[level]
            fits &= (lo[x] != hi[x]) | (lo[y] != hi[y]) | (lo[x] != lo[y])
        if not level:
            fits &= (100 + p) * np.minimum(self.rest[x], self.rest[y]) >= p * (low[x] + low[y])
        k = np.flatnonzero(fits)
        for at in range(0, len(k), PAIRS):  # a bound on the gathered corners
            own = k[at : at + PAIRS]
            overlap = np.minimum(high[x[own]], high[y[own]]).sum(axis=1)
            fits[own] = (100 + p) * overlap >= p * (low[x[own]] + low[y[own]])
        return fits

    def pairs(self, two: bool = False):
        """Blocks of pairs of points (places in the order given first) that the bounds allow. two: only between different parts."""
        self.two = two
        top = len(self.levels) - 1
        own = np.arange(len(self.levels[top][1]))
        stack = [(top, own, own)]
        while stack:  # depth first in blocks, so that the open pairs stay few
            level, x, y = stack.pop()
            if len(x) > 1024:
                stack.append((level, x[1024:], y[1024:]))
                x, y = x[:1024], y[:1024]
            if level:
                ok = self.wanted(level, x, y)
                x, y = x[ok], y[ok]
                cut = self.cuts[level - 1]
                n = np.diff(np.concatenate([cut, [len(self.levels[level - 1][1])]]))
                i = spans(cut[x], n[x])
                times = np.repeat(n[y], n[x])
                j = spans(np.repeat(cut[y], n[x]), times)
                i = np.repeat(i, times)
                keep = i < j if level == 1 else i <= j
                if keep.any():
                    stack.append((level - 1, i[keep], j[keep]))
            else:
                for at in range(0, len(x), 1 << 17):
                    i, j = x[at : at + (1 << 17)], y[at : at + (1 << 17)]
                    ok = self.wanted(0, i, j)
                    if ok.any():
                        yield self.order[i[ok]], self.order[j[ok]]


class Sets:
    """The sets of some classes, which of them link, and which are joined. values: all members, ascending in each set."""

    def __init__(self, values: np.ndarray, count: np.ndarray, root: np.ndarray, percent: int):
        self.count, self.percent = count, percent
        self.begin = np.cumsum(count) - count
        self.values = values
        wide = 1 << min(BITS, max(9, int(8 * count.max(initial=1)).bit_length()))
        self.bits = np.empty((len(count), wide // 64), np.uint64)
        for at in range(0, len(count), 512):  # a bound on the unpacked bits
            n = count[at : at + 512]
            own = np.zeros((len(n), wide), bool)
            own[np.repeat(np.arange(len(n)), n), (values[self.begin[at] :][: int(n.sum())] & np.uint64(wide - 1)).astype(np.int64)] = True
            self.bits[at : at + 512] = np.packbits(own, axis=1).view(np.uint64)
        _, first, label = np.unique(root, return_index=True, return_inverse=True)
        self.up = first[label.ravel()]

    def likely(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs may link by their bits: one that is in x only stands for a member that y hasn't."""
        out, most_at = np.empty(len(x), bool), max(1, PAIRS * 64 // self.bits.shape[1])
        for at in range(0, len(x), most_at):
            i, j = x[at : at + most_at], y[at : at + most_at]
            a, b, n, m = self.bits[i], self.bits[j], self.count[i], self.count[j]
            most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
            out[at : at + most_at] = (100 + self.percent) * most >= self.percent * (n + m)
        return out

    def overlaps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many members the sets x[k] and y[k] share."""
        less = self.count[x] <= self.count[y]
        small, large = np.where(less, x, y), np.where(less, y, x)
        out, at = np.zeros(len(x), np.int64), 0
        total = np.cumsum(self.count[small])
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PROBES)))
            a, b = small[at:end], large[at:end]
            probe = self.values[spans(self.begin[a], self.count[a])]
            # All at once, each in its own set: the last member that isn't above the probe.
            low, size = np.repeat(self.begin[b], self.count[a]), np.repeat(self.count[b], self.count[a])
            for _ in range(int(self.count[b].max() - 1).bit_length()):
                half = size >> 1
                above = self.values[low + half] <= probe
                low += half * above
                size = np.where(above, size - half, half)
            hit = self.values[low] == probe
            out[at:end] = summed(hit.astype(np.int64), self.count[a])
            at = end
        return out

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found = self.likely(x, y)
        i, j = x[found], y[found]
        found[found] = (100 + self.percent) * self.overlaps(i, j) >= self.percent * (self.count[i] + self.count[j])
        return found

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def tops(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def joined(self, x: np.ndarray, y: np.ndarray, likeness: np.ndarray) -> list[tuple[int, int]]:
        """Links that join what isn't joined yet, found among the pairs, the likest first in growing numbers."""
        order = np.argsort(-likeness, kind="stable")
        x, y, step, out = x[order], y[order], max(64, len(np.unique(x))), []
        while len(x):
            ok = self.linked(x[:step], y[:step])
            for a, b in zip(x[:step][ok].tolist(), y[:step][ok].tolist(), strict=True):
                p, q = self.top(a), self.top(b)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    out.append((a, b))
            top = self.tops()
            x, y, step = x[step:], y[step:], 2 * step
            apart = top[x] != top[y]
            x, y = x[apart], y[apart]
        return out


def memberships(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, place, n, cls, check, often): of every placed document the size and two ids of its set; on one row per batch, its frequent shingles."""

    def run(batches):
        import pyarrow as pa

        for t in batched(batches):
            values, count = shingle_sets(*joined_bytes(t.column("text")))
            ids = class_ids(values, count, 2 * seed)
            # Copies count once: only different texts that share a shingle matter.
            _, one = np.unique(ids, return_index=True)
            keep = np.zeros(len(ids), bool)
            keep[one] = True
            seen, times = np.unique(values[np.repeat(keep, count)], return_counts=True)
            often = seen[times >= FREQUENT].view(np.int64)
            lists = [None] * t.num_rows
            lists[0] = often[np.argsort(-times[times >= FREQUENT], kind="stable")].tolist()
            none = count == 0
            yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in ("doc_id", "_tm_file", "_tm_row")], pa.array(count), pa.array(ids, mask=none), pa.array(class_ids(values, count, 2 * seed + 1), mask=none), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "_tm_file", "_tm_row", "n", "cls", "check", "often"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_tm_file", "_tm_row", "text")
    return saved(own.mapInArrow(run, "doc_id long, _tm_file long, _tm_row long, n long, cls long, check long, often array<long>"), "memberships")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """memberships; (cls, doc_id, place) of each class its smallest doc_id and where one of its texts is; and the seed of the ids.

    Ids of 64 bits may agree by chance for different sets; a second id shows that, and others are taken.
    """
    for seed in numbers_from():
        member = memberships(docs, seed)
        place = F.struct("_tm_file", "_tm_row")
        found = member.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(place).alias("place"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        found = saved(found, "classes")
        if found.where("lo <> hi").isEmpty():
            return member, found.select("cls", "doc_id", "place._tm_file", "place._tm_row"), seed
        forget(member, found)


def lists(docs: DataFrame, late: np.ndarray, percent: int, seed: int) -> DataFrame:
    """(token, cls, n, rest) of classes that share a prefix shingle; after those of a shingle one row without cls: (token, late, members, shingles, a, b).

    rest: shingles of the class from this one on, in the common order. a, b: hashes of the shingle's classes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(late)
    names = ["token", "cls", "n", "rest", "late", "members", "shingles", "a", "b"]

    def emit(batches):
        import pyarrow as pa

        for t in batched(batches):
            values, count = shingle_sets(*joined_bytes(t.column("text")))
            ids = class_ids(values, count, 2 * seed)
            _, one = np.unique(ids, return_index=True)
            keep = np.zeros(len(ids), bool)
            keep[one] = True
            values, ids, count = values[np.repeat(keep, count)], ids[keep], count[keep]
            token, place, take = prefixes(values, count, shared.value, percent)
            n = np.repeat(count, take)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.repeat(ids, take)), pa.array((n << 32) | (n - place))], ["token", "cls", "size"])

    def ends(token, members, shingles, a, b):
        import pyarrow as pa

        last = shared.value
        late = np.isin(token.view(np.uint64), last).astype(np.int64)
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(token), none, none, none, *[pa.array(x) for x in (late, members, shingles, a.view(np.int64), b.view(np.int64))]], names)

    def scan(batches):
        import pyarrow as pa

        # Rows come by token and class. `held` is the last row if its token has no second class yet, `open_` what is known of a token that has.
        none = [np.zeros(0, np.int64)] * 3
        held, open_, previous = none, None, None
        for batch in batches:
            token, cls, size = (np.concatenate([h, np.asarray(batch.column(k))]) for k, h in enumerate(held))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            if previous is not None and not len(held[0]):
                new[0] = (token[0], cls[0]) != previous
            previous = (token[-1], cls[-1])
            token, cls, size = token[new], cls[new], size[new]
            if not len(token):
                held = none
                continue
            start = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            length = np.diff(np.concatenate([start, [len(token)]]))
            own = [token[start], length.copy(), np.add.reduceat(size >> 32, start)]
            with np.errstate(over="ignore"):
                own += [np.add.reduceat(mix(cls.view(np.uint64) + np.uint64(k)), start) for k in (1, 2)]
                if open_ is not None and open_[0][0] == token[0]:
                    for mine, more in zip(own[1:], open_[1:], strict=True):
                        mine[0] += more[0]
                elif open_ is not None:
                    yield ends(*open_)
            many = own[1] > 1
            alone = not many[-1]
            held = [token[-1:], cls[-1:], size[-1:]] if alone else none
            open_ = None if alone else [x[-1:] for x in own]
            keep = np.repeat(many, length)
            empty = pa.nulls(int(keep.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(x[keep]) for x in (token, cls, size >> 32, size & 0xFFFFFFFF)], *[empty] * 5], names)
            done = np.flatnonzero(many[:-1])
            yield ends(*[x[done] for x in own])
        if open_ is not None:
            yield ends(*open_)

    tokens = docs.select("text").mapInArrow(emit, "token long, cls long, size long")
    dealt = tokens.repartition("token").sortWithinPartitions("token", "cls")
    return saved(dealt.mapInArrow(scan, ", ".join(f"{c} long" for c in names)), "lists")


def profiles(texts: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """(cls, point) of texts; or, whole, (cls, members): the shingles in ascending order."""

    def run(batches):
        import pyarrow as pa

        for t in batched(batches, 2_000_000):
            values, count = shingle_sets(*joined_bytes(t.column("text")))
            facts = [values[e - k : e].tobytes() for e, k in zip(np.cumsum(count), count, strict=True)] if whole else packed(values, count)
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(values, count, 2 * seed)), pa.array(facts, pa.binary())], names)

    names = ["cls", "members" if whole else "point"]
    return saved(texts.select("text").mapInArrow(run, f"cls long, {names[1]} binary"), "profiles")


class Texts:
    """Where a text of each class is, to make of it what a search needs. docs: placed; first: (cls, place)."""

    def __init__(self, docs: DataFrame, first: DataFrame, seed: int):
        self.docs, self.first, self.seed = docs.select("text", "_tm_file", "_tm_row"), first, seed

    def profiles(self, classes_: DataFrame, whole: bool = False) -> DataFrame:
        wanted = self.first.join(classes_.select("cls").distinct(), "cls").select("_tm_file", "_tm_row", F.lit(1).alias("n"))
        return profiles(with_numbers(self.docs, wanted, "_tm_wanted").where("_tm_wanted = 1"), self.seed, whole)


CELLS = ["token", "i", "j"]


def by_cell(batches, work):
    """work(table, number of each row's cell) on whole cells; rows come sorted by cell."""
    import pyarrow as pa

    def numbered(t):
        key = [np.asarray(t.column(c)) for c in CELLS]
        return np.concatenate([[0], np.cumsum(np.any([k[1:] != k[:-1] for k in key], axis=0))])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        cell = numbered(t)
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield from work(t.slice(0, cut).combine_chunks(), cell[:cut])
        held = t.slice(cut)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield from work(held, numbered(held))


def search(cells: DataFrame, profile: DataFrame, texts: Texts, percent: int, two: bool = False, every_link: bool = False) -> DataFrame:
    """(a, b): links between classes of one cell and of different roots, as many as join them; or every link.

    cells: (token, i, j, part, cls, n, rest, root); profile: (cls, point). two: only between the parts of a cell.
    """

    def partners(t, cell):
        import pyarrow as pa

        part, root, n, rest = (np.asarray(t.column(c)) for c in ("part", "root", "n", "rest"))
        _, label = np.unique(root, return_inverse=True)
        # Classes that have a partner share a label, as a partner of theirs among themselves tells nothing new.
        label = label.ravel() + 1
        point = Points(t.column("point"), n, percent)
        trees = Forest(point.coarse, n, rest, cell, part, label, percent)
        found = np.zeros(len(n), bool)
        for x, y in trees.pairs(two):
            keep = point.likely(x, y)
            found[x[keep]] = found[y[keep]] = True
            if keep.any() and not every_link:
                trees.relabel(np.where(found, 0, label))
        yield from t.filter(pa.array(found)).select([*CELLS, "part", "cls", "n", "rest", "root"]).to_batches()

    def links(t, cell):
        import pyarrow as pa

        part, root, n, rest, cls = (np.asarray(t.column(c)) for c in ("part", "root", "n", "rest", "cls"))
        values = np.frombuffer(b"".join(x.as_buffer() for chunk in t.column("members").chunks for x in chunk), np.uint64)
        # A root in two cells is two: what joins in one cell isn't known in the other.
        _, label = np.unique(np.stack([cell, root]), axis=1, return_inverse=True)
        sets = Sets(values, n, label.ravel(), percent)
        point = points(values, n)
        trees = Forest(point, n, rest, cell, part, np.arange(len(n)) if every_link else sets.tops(), percent)
        out = []
        for x, y in trees.pairs(two):
            if every_link:
                ok = sets.linked(x, y)
                out += zip(x[ok].tolist(), y[ok].tolist(), strict=True)
                continue
            like = np.empty(len(x))
            for at in range(0, len(x), PAIRS):
                p = slice(at, at + PAIRS)
                like[p] = np.minimum(point[x[p]], point[y[p]]).sum(axis=1) / (n[x[p]] + n[y[p]])
            more = sets.joined(x, y, like)
            if more:
                out += more
                trees.relabel(sets.tops())
        pair = cls[np.array(out, np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(pair.min(axis=1)), pa.array(pair.max(axis=1))], ["a", "b"])

    def dealt(rows: DataFrame, of: DataFrame) -> DataFrame:
        own = rows.join(of, "cls").select(*CELLS, "part", "cls", "n", "rest", "root", of.columns[1])
        return own.repartition(*CELLS).sortWithinPartitions(*CELLS, "n", "cls")

    schema = "token long, i long, j long, part int, cls long, n long, rest long, root long"
    some = saved(dealt(cells, profile).mapInArrow(lambda b: by_cell(b, partners), schema), "partners")
    # Of cells that are left with the very same classes one will do: that of the first shingle, from which most is left.
    alike = (F.count(F.lit(1)).alias("classes"), *[F.sum(F.xxhash64("cls", "part", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)])
    cell = some.groupBy(*CELLS).agg(F.sum("rest").alias("left"), *alike).groupBy("classes", "h0", "h1")
    cell = cell.agg(F.max(F.struct("left", *CELLS)).alias("c")).select("c.token", "c.i", "c.j")
    kept = saved(some.join(cell, CELLS), "kept")
    sets = texts.profiles(kept, whole=True)
    found = dealt(kept, sets).mapInArrow(lambda b: by_cell(b, links), "a long, b long").where("a <> b").distinct()
    found = saved(found, "links")
    forget(some, kept, sets)
    return found


def tiles(rows: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """rows (token, cls, n, ...) of large shingles with the tile of each: a band of sizes, and a share of the band by hash. No set links beyond the next band."""
    own = rows.join(F.broadcast(large.select("token")), "token").withColumn("band", F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)))
    share = own.groupBy("token", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(CELL)), F.sum("n") / F.lit(float(MEMBERS)))).alias("share"))
    return own.join(share, ["token", "band"]).withColumn("tile", F.col("band") * F.lit(1 << 40) + F.pmod(F.xxhash64("cls"), F.col("share"))).drop("share")


def linked(docs: DataFrame, percent: int = 80, every_link: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """memberships (doc_id, place, n, cls) of placed docs, classes (cls, doc_id), and links (a, b) between classes.

    With `every_link` all links between different classes; else as many as make the components.
    """
    member, first, seed = classes(docs)
    often = member.select(F.explode("often").alias("token")).groupBy("token").count().orderBy(F.desc("count"), "token").limit(MOST_FREQUENT)
    late = np.sort(np.array([r[0] for r in often.select("token").collect()], dtype=np.int64).view(np.uint64))
    run = lists(docs, late, percent, seed)
    order = F.struct("late", F.col("token").bitwiseXOR(F.lit(-(1 << 63))), "token")
    ends = run.where("cls is null").groupBy("a", "b", "members", "shingles").agg(F.min(order)["token"].alias("token"))
    ends = saved(ends.select("token", "members", "shingles"), "ends")
    rows = saved(run.where("cls is not null").select("token", "cls", "n", "rest").join(ends.select("token"), "token"), "rows")
    texts = Texts(docs, first, seed)
    profile = texts.profiles(rows)
    def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
        root = components(links).select(F.col("node").alias("_tm_node"), "root")
        return rows.join(root, F.col("cls") == F.col("_tm_node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("_tm_node")

    def apart(rows: DataFrame) -> DataFrame:
        """Of shingles whose classes aren't all joined."""
        rows = saved(rows, "rooted")
        mixed = saved(rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token"), "apart")
        return rows.join(mixed, "token")

    def whole(rows: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")
        return rows.select("token", zero.alias("i"), zero.alias("j"), F.lit(0).alias("part"), "cls", "n", "rest", "root")

    large = ends.where(f"members > {CELL} or shingles > {MEMBERS}")
    none = large.isEmpty()
    small = (rows if none else rows.join(F.broadcast(large.select("token")), "token", "left_anti")).withColumn("root", F.col("cls"))
    if every_link:
        found = search(whole(small), profile, texts, percent, every_link=True)
    else:
        # Each class's largest shingle first; that joins most near copies, and only what is apart is searched at all shingles.
        first_of = small.join(ends.select("token", "members"), "token").groupBy("cls").agg(F.max(F.struct("members", "token"))["token"].alias("token"))
        found = search(whole(small.join(first_of.select("token").distinct(), "token")), profile, texts, percent)
        found = found.unionByName(search(whole(apart(rooted(small.drop("root"), found))), profile, texts, percent))
    if not none:
        cut = saved(tiles(rows, large, percent), "tiles")
        own = F.col("tile").alias("i"), F.col("tile").alias("j"), F.lit(0).alias("part"), "cls", "n", "rest", "root"
        now = cut.withColumn("root", F.col("cls"))
        found = found.unionByName(search((now if every_link else rooted(cut, found)).select("token", *own), profile, texts, percent, every_link=every_link))
        if not every_link:
            lead = rooted(cut, found).groupBy("token", "tile", "root").agg(F.min(F.struct("cls", "n", "rest")).alias("l"))
            lead = saved(lead.select("token", "l.cls", "l.n", "l.rest", "root"), "leaders")
            share = lead.groupBy("token").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(CELL)), F.sum("n") / F.lit(float(MEMBERS)))).alias("share"))
            tile = F.pmod(F.xxhash64("cls"), F.col("share"))
            lead = lead.join(share, "token").select("token", tile.alias("i"), tile.alias("j"), F.lit(0).alias("part"), "cls", "n", "rest", "root")
            found = found.unionByName(search(lead, profile, texts, percent))
            now = saved(rooted(cut, found), "rooted")
        at = now.groupBy("token", "band", "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        other = at.select("token", *[F.col(c).alias(f"other_{c}") for c in ("band", "tile", "lo", "hi")])
        mixed = "tile < other_tile and other_band <= band + 1 and not (lo = hi and other_lo = other_hi and lo = other_lo)"
        both = saved(at.join(other, "token").where(mixed).select("token", F.col("tile").alias("i"), F.col("other_tile").alias("j")), "both")
        if not both.isEmpty():
            side = lambda c, k: now.join(both, ["token"]).where(F.col("tile") == F.col(c)).select(*CELLS, F.lit(k).alias("part"), "cls", "n", "rest", "root")
            found = found.unionByName(search(side("i", 0).unionByName(side("j", 1)), profile, texts, percent, two=True, every_link=every_link))
    found = saved(found.distinct(), "found")  # a pair may have met at several shingles
    forget(run, ends, rows, profile)
    return member, first, found


def named(first: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, component_id): of each class the smallest doc_id that links reach."""
    root = components(links, first.select(F.col("cls").alias("node"), F.col("doc_id").alias("name")))
    found = first.select("cls", "doc_id").join(root, first["cls"] == root["node"], "left")
    return found.select(F.col("cls").alias("_tm_cls"), F.when(F.col("node").isNotNull(), F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    member, first, links = linked(placed(docs.select("doc_id", "text")), percent)
    of = named(first, links)
    out = member.join(of, member["cls"] == of["_tm_cls"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_tm_cls").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_links(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): every link between different sets, by the smallest doc_id of each set."""
    _, first, links = linked(placed(docs.select("doc_id", "text")), percent, every_link=True)
    side = lambda c: first.select(F.col("cls").alias(c), F.col("doc_id").alias(f"doc_{c}"))
    both = links.join(side("a"), "a").join(side("b"), "b")
    return both.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The first document of every component by doc_id (null last; ties by place in the files), with its own columns; those without words all stay."""
    at = placed(docs)
    member, first, links = linked(at.select("doc_id", "text", "_tm_file", "_tm_row"), percent)
    root = components(links)
    own = member.where("cls is not null").select("cls", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tm_file", "_tm_row").alias("d"))
    best = own.groupBy("cls").agg(F.min("d").alias("best"), F.count(F.lit(1)).alias("docs"))
    best = best.join(root, best["cls"] == root["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"), "best", "docs")
    best = saved(best, "best")
    # Only what isn't alone in its component can go.
    left = best.groupBy(F.col("root").alias("_tm_root")).agg(F.min("best").alias("stays"), F.sum("docs").alias("size")).where("size > 1")
    stays = saved(left.select("stays"), "stays")
    crowd = own.join(best.join(left.select("_tm_root"), F.col("root") == F.col("_tm_root"), "left_semi").select(F.col("cls").alias("_tm_cls")), F.col("cls") == F.col("_tm_cls"), "left_semi")
    gone = crowd.select("d._tm_file", "d._tm_row").join(stays.select("stays._tm_file", "stays._tm_row"), ["_tm_file", "_tm_row"], "left_anti")
    return with_numbers(at, gone.withColumn("n", F.lit(1)), "_tm_gone").where("_tm_gone = 0").select(*docs.columns)
