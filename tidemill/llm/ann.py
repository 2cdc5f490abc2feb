"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id. Each shard keeps its distinct vectors once, with the
ids of each in order, and builds one graph per level as a flat array of neighbour numbers (-1: none).
A node's level is a hash of its number, higher levels first, so a level is a prefix of the nodes. Nodes
are added in batches: a beam search in the graph so far finds candidates, of which those closer to the
node than to a neighbour already chosen become neighbours; links go both ways and full lists are cut by
the same rule. Nearness is the inner product: vectors get one more coordinate that makes their lengths
equal, so that inner product and distance agree while the graph is built. A search takes the best of
all shards; its scores are computed again in double precision from the original vectors.

A shard's graph goes to one task, which loads it once and answers all queries as they stream past.

Defined results: vectors that are null, of another length than most, zero, or that hold null or non-finite
components take no part, as queries or candidates, and neither do rows without vec_id; a row isn't its own
neighbour, but other rows of the same vec_id or the same vector are (repeated rows), and each row of a
repeated vec_id is a query of its own, ranked by itself; ties go to the smaller vec_id; fewer candidates
than wanted are all returned; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemill.llm.base import forget, mix, saved

NEIGHBOURS, BUILD, SEARCH, BATCH = 16, 64, 112, 512
#: At least so many shards, and more when one would hold more bytes of vectors (as floats) than this.
SHARDS, SHARD_BYTES = 8, 1 << 25


def beam(query: np.ndarray, entry: np.ndarray, points: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, similarities) of the best `width` nodes found for each query, best first; -1 and -inf where there are fewer.

    One step expands the best open node of every query at once.
    """
    n = len(query)
    seen = np.zeros((n, len(points)), bool)
    found = np.full((n, width), -1, np.int64)
    score = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    rows = np.arange(n)
    found[:, 0], done[:, 0] = entry, False
    score[:, 0] = np.einsum("nd,nd->n", query, points[entry])
    seen[rows, entry] = True
    live = rows
    while len(live):
        place = (~done[live]).argmax(axis=1)
        some = ~done[live, place]
        live, place = live[some], place[some]
        if not len(live):
            break
        done[live, place] = True
        near = links[found[live, place]]
        new = near >= 0
        near = np.where(new, near, 0)
        new &= ~seen[live[:, None], near]
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        sim = np.full(near.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("nd,nd->n", query[live[r]], points[near[r, c]])
        f = np.concatenate([found[live], np.where(new, near, -1)], axis=1)
        s = np.concatenate([score[live], sim], axis=1)
        d = np.concatenate([done[live], ~new], axis=1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :width]
        found[live], score[live], done[live] = (np.take_along_axis(x, order, axis=1) for x in (f, s, d))
    return found, score


def chosen(candidates: np.ndarray, score: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to `most` neighbours.

    First those nearer to the row's node than to any neighbour chosen before, then the nearest others.
    """
    n, k = candidates.shape
    real = candidates >= 0
    p = points[np.where(real, candidates, 0)]
    between = np.einsum("nid,njd->nij", p, p)
    picked = np.zeros((n, k), bool)
    blocked = ~real
    count = np.zeros(n, np.int64)
    for j in range(k):
        take = ~blocked[:, j] & (count < most)
        picked[:, j] = take
        count += take
        blocked |= take[:, None] & (between[:, j, :] >= score)
    order = np.argsort(np.where(picked, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(candidates, order, axis=1)


def linked(links: np.ndarray, source: np.ndarray, target: np.ndarray, points: np.ndarray) -> None:
    """Add source[i] to the list of target[i]; lists that would overflow are chosen anew."""
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    node, first, extra = np.unique(target, return_index=True, return_counts=True)
    width = int(extra.max()) if len(extra) else 0
    more = np.full((len(node), width), -1, np.int64)
    more[np.repeat(np.arange(len(node)), extra), np.arange(len(target)) - np.repeat(first, extra)] = source
    both = np.concatenate([links[node], more], axis=1)
    for at in range(0, len(node), 1024):
        own, part = node[at : at + 1024], both[at : at + 1024]
        score = np.einsum("nd,nkd->nk", points[own], points[np.where(part >= 0, part, 0)])
        score[part < 0] = -np.inf
        by = np.argsort(-score, axis=1, kind="stable")
        part, score = np.take_along_axis(part, by, axis=1), np.take_along_axis(score, by, axis=1)
        again = np.zeros(part.shape, bool)
        again[:, 1:] = (part[:, 1:] == part[:, :-1]) & (part[:, 1:] >= 0)
        part[again], score[again] = -1, -np.inf
        keep = min(part.shape[1], links.shape[1] + 16)
        links[own] = chosen(part[:, :keep], score[:, :keep], points, links.shape[1])


def descend(query: np.ndarray, points: np.ndarray, levels: list[np.ndarray], down_to: int) -> np.ndarray:
    """The nearest node found for each query on the levels above `down_to`."""
    at = np.zeros(len(query), np.int64)
    for level in range(len(levels) - 1, down_to, -1):
        n = len(levels[level])
        at = beam(query, at, points[:n], levels[level], 4)[0][:, 0]
    return at


def build(points: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Neighbour lists of every level, the lowest first. sizes: nodes per level, a prefix of the points each."""
    levels: list[np.ndarray] = [np.zeros((0, 0), np.int64)] * len(sizes)
    for level in range(len(sizes) - 1, -1, -1):
        n, wide = sizes[level], NEIGHBOURS * (2 if level == 0 else 1)
        links = np.full((n, wide), -1, np.int64)
        levels[level] = links
        above = sizes[level + 1] if level + 1 < len(sizes) else 0
        start = min(n, max(above, 128))
        for at in range(0, start, BATCH):  # the first nodes see each other all
            own = np.arange(at, min(start, at + BATCH))
            sim = points[own] @ points[:start].T
            sim[np.arange(len(own)), own] = -np.inf
            near = np.argsort(-sim, axis=1, kind="stable")[:, : min(BUILD, start)]
            score = np.take_along_axis(sim, near, axis=1)
            links_own = chosen(np.where(np.isfinite(score), near, -1), score, points, NEIGHBOURS)
            links[own, : links_own.shape[1]] = links_own
        own = np.arange(start)
        r, c = np.nonzero(links[own] >= 0)
        linked(links, own[r], links[own[r], c], points)
        while start < n:
            own = np.arange(start, min(n, start + min(BATCH, start)))
            entry = descend(points[own], points, levels, level)
            near, score = beam(points[own], entry, points[:start], links[:start], BUILD)
            mates = points[own] @ points[own].T
            np.fill_diagonal(mates, -np.inf)
            k = min(NEIGHBOURS, len(own))
            best = np.argsort(-mates, axis=1, kind="stable")[:, :k]
            mate_score = np.take_along_axis(mates, best, axis=1)
            near = np.concatenate([near, np.where(np.isfinite(mate_score), own[best], -1)], axis=1)
            score = np.concatenate([score, mate_score], axis=1)
            by = np.argsort(-score, axis=1, kind="stable")[:, :BUILD]
            near, score = np.take_along_axis(near, by, axis=1), np.take_along_axis(score, by, axis=1)
            neighbours = chosen(near, score, points, NEIGHBOURS)
            links[own, : neighbours.shape[1]] = neighbours
            r, c = np.nonzero(neighbours >= 0)
            linked(links, own[r], neighbours[r, c], points)
            start += len(own)
    return levels


def level_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > NEIGHBOURS * 2:
        sizes.append(-(-sizes[-1] // NEIGHBOURS))
    return sizes


def built(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, scale: float, longest: float) -> dict[str, bytes | int]:
    """A shard's index: its distinct vectors as they were given, the ids and rows of each, and the lists of each level."""
    distinct, number = np.unique(vectors, axis=0, return_inverse=True)
    number = number.ravel()
    order = np.argsort(mix(np.arange(len(distinct), dtype=np.uint64)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    distinct, number = distinct[order], place[number]
    by = np.lexsort((rows, ids, number))
    near = distinct.astype(np.float64) / scale
    points = np.concatenate([near, np.sqrt(np.maximum(longest - (near**2).sum(axis=1), 0))[:, None]], axis=1).astype(np.float32)
    sizes = level_sizes(len(distinct))
    levels = build(points, sizes)
    return {
        "nodes": len(distinct),
        "width": distinct.itemsize,
        "vectors": distinct.tobytes(),
        "ids": ids[by].astype(np.int64).tobytes(),
        "rows": rows[by].astype(np.int64).tobytes(),
        "counts": np.bincount(number, minlength=len(distinct)).astype(np.int64).tobytes(),
        "sizes": np.array(sizes, np.int64).tobytes(),
        "links": b"".join(x.astype(np.int32).tobytes() for x in levels),
    }


class Graph:
    """A shard's index, loaded once."""

    def __init__(self, index: dict):
        n = index["nodes"]
        self.vectors = np.frombuffer(index["vectors"], np.float32 if index["width"] == 4 else np.float64).reshape(n, -1)
        self.scale = float(np.abs(self.vectors).max())
        self.points = (self.vectors / self.scale).astype(np.float32)
        self.ids, self.rows, self.counts = (np.frombuffer(index[c], np.int64) for c in ("ids", "rows", "counts"))
        self.first = np.cumsum(self.counts) - self.counts
        self.levels, flat, at = [], np.frombuffer(index["links"], np.int32), 0
        for level, size in enumerate(np.frombuffer(index["sizes"], np.int64).tolist()):
            wide = NEIGHBOURS * (2 if level == 0 else 1)
            self.levels.append(flat[at : at + size * wide].reshape(size, wide))
            at += size * wide

    def search(self, row: np.ndarray, query: np.ndarray, k: int, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, vec_id, score) of up to k of the shard's rows for each query, without its own row."""
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(query), BATCH):
            given, own = query[lo : lo + BATCH], row[lo : lo + BATCH]
            q = (given / np.abs(given).max(axis=1, keepdims=True)).astype(np.float32)
            found, _ = beam(q, descend(q, self.points, self.levels, 0), self.points, self.levels[0], max(width, k + 1))
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            take = np.minimum(self.counts[node], k + 1)
            place = np.repeat(r, take)
            item = np.repeat(self.first[node] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
            score = np.einsum("nd,nd->n", given[r].astype(np.float64), self.vectors[node].astype(np.float64))
            score, vec = np.repeat(score, take), self.ids[item]
            other = self.rows[item] != own[place]
            place, vec, score = place[other], vec[other], score[other]
            by = np.lexsort((vec, -score, place))
            place, vec, score = place[by], vec[by], score[by]
            n_row = np.bincount(place, minlength=len(q))
            rank = np.arange(len(place)) - np.repeat(np.cumsum(n_row) - n_row, n_row)
            for o, x in zip(out, (place + lo, vec, score), strict=True):
                o.append(x[rank < k])
        return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


GRAPH = ["nodes", "width", "vectors", "ids", "rows", "counts", "sizes", "links"]
INDEX = "shard int, nodes long, width long, vectors binary, ids binary, rows binary, counts binary, sizes binary, links binary"


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) of the rows that take part, saved; row tells them apart. Components stay floats, or become doubles."""
    kind = rows.schema["embedding"].dataType
    exact = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{exact}>").alias("embedding")).where("vec_id is not null and embedding is not null")
    common = given.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = "size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists(embedding, x -> x != 0)"
    found = given.where((F.size("embedding") == (common[0] if common else -1)) & F.expr(good))
    return saved(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")


def index(points: DataFrame) -> DataFrame:
    """Of usable() rows one row per shard: the graph as flat arrays, in a saved table."""
    total, size, scale = points.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    scale = float(scale or 1)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / scale) * (x.cast("double") / scale))
    longest = points.agg(F.max(square)).first()[0]
    shards = max(SHARDS, -(-total * (size or 1) * 4 // SHARD_BYTES))

    def one(key, t):
        import pyarrow as pa

        ids, rows = (np.asarray(t.column(c).combine_chunks()) for c in ("vec_id", "row"))
        flat = t.column("embedding").combine_chunks().flatten()
        found = built(ids, rows, np.asarray(flat).reshape(len(ids), -1), scale, longest)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in found.items()}})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return saved(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(one, INDEX), "hnsw")


def nearest(queries: DataFrame, built_index: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (row, vec_id, embedding); row: which row of the index it is, or -1."""
    shards = (built_index.agg(F.max("shard")).first()[0] or 0) + 1
    # Every shard answers every query: a stated query set. In each shard's rows its graph comes first, then the queries stream past it.
    asked = queries.select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "embedding", F.monotonically_increasing_id().alias("query"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = built_index.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def answer(batches):
        import pyarrow as pa

        graph, at = None, None
        for batch in batches:
            shard, kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if not kind[lo]:
                    graph, at = Graph({c: part.column(c)[0].as_py() for c in GRAPH}), shard[lo]
                elif at == shard[lo]:
                    vectors = part.column("embedding").flatten()
                    place, vec, score = graph.search(np.asarray(part.column("own")), np.asarray(vectors).reshape(part.num_rows, -1), k)
                    ids, number = np.asarray(part.column("query_id")), np.asarray(part.column("query"))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number[place], ids[place], vec.astype(np.int64), score.astype(np.float64))], ["query", "query_id", "vec_id", "score"])

    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(answer, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, against all other rows."""
    points = usable(rows)
    built_index = index(points)
    found = saved(nearest(points.where(F.col("vec_id") % every == 0), built_index, k), "nearest")
    forget(points, built_index)
    return found
