"""Approximate nearest neighbours by vantage-point trees, one per shard.

Nearness is the inner product. Vectors are dealt by norm first, to bands whose
norms differ by a tenth at most, and within a band to the nearest of a few
pivots by direction; a cell of more than ``SHARD_VECTORS`` is split by a hash
of the id. Every row is in a tree.

Within a shard whose longest vector has length M, a vector x gets the further
coordinate sqrt(M^2 - |x|^2) and a query is scaled to length M (its order of
neighbours does not depend on its length): all lie on one sphere, the nearest
by distance is the one of the largest inner product, and the triangle
inequality holds. A node keeps its vantage point and the span of distances in
either half. A half is left out when ``factor`` times the least distance it
can hold exceeds the query's worst neighbour so far: ``factor`` 1 is exact
search, more looks at less.

A query visits a shard of its own cell first. What it finds there bounds what
is worth finding elsewhere: it is then sent only to cells that can still hold
something as near, by the angle to the cell's pivot less the cell's widest
angle, relaxed by the factor as well, and starts there with its bound. Queries
travel in blocks of their cell.

If no factor is given, it is chosen by a bounded sample of ``SAMPLE_QUERIES``
queries, which meet every tree: the largest of ``FACTORS`` that keeps
``WANTED`` of their true neighbours, where each query already knows the score
of its last one - the hardest case for recall.

Equal vectors are one point of a tree with all their ids behind it. Points of
equal product are kept by their least id, and ``SPARE`` more than asked for
are held, so that products that differ by rounding alone are ordered by the
scores, which are summed anew from the original vectors, in double precision
and one fixed order. Ties go to the smaller id wherever they lie.

Cases: vectors that are null, zero, or hold null or non-finite components, and
rows with a null id take no part; rows of equal id are one vector, the
smallest; vectors of another length than the query's are no candidates; with
fewer than ``k`` candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadsky.llm.common import stored, table

NEIGHBOURS = 20
SHARD_VECTORS = 8192
BLOCK_QUERIES = 1024
LEAF = 256
#: Norms of a band differ by this ratio at most.
BAND = 1.1
#: Pivots of a band, at most, and vectors they are picked from: what is known of all cells stays small.
PIVOTS = 64
PIVOT_SAMPLE = 512
FACTORS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0)
WANTED = 0.98
SAMPLE_QUERIES = 128
#: Points held beyond the neighbours asked for.
SPARE = 12
#: Distances this much of the radius apart count as equal when halves are left out.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one finite, non-zero vector of doubles per id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict:
    """A tree over the different vectors. ``points`` in tree order; a node holds points [start, end), its vantage point
    first, the nearer half up to ``middle``; ``span`` is the least and greatest distance in either half."""
    points, owner = np.unique(vectors, axis=0, return_inverse=True)
    owner = owner.ravel()
    order = np.lexsort((ids, owner))
    norms = (points * points).sum(1)
    lifted = np.column_stack([points, np.sqrt(np.maximum(norms.max() - norms, 0))])
    place = np.arange(len(points))
    nodes: list = []
    random = np.random.default_rng(len(points))
    work = [(0, len(points), None)]
    while work:
        start, end, parent = work.pop()
        node = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = node
        if end - start <= leaf:
            nodes.append([start, end, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
            continue
        swap = start + int(random.integers(end - start))
        place[[start, swap]] = place[[swap, start]]
        rest = place[start + 1 : end]
        away = np.sqrt(((lifted[rest] - lifted[place[start]]) ** 2).sum(1))
        by = np.argsort(away, kind="stable")
        place[start + 1 : end], away = rest[by], away[by]
        half = len(rest) // 2
        middle = start + 1 + half
        nodes.append([start, end, middle, -1, -1, away[0], away[half - 1], away[half], away[-1]])
        work += [(start + 1, middle, (node, 3)), (middle, end, (node, 4))]
    first = np.searchsorted(owner[order], np.arange(len(points) + 1))
    return {
        "points": points[place],
        "lift": lifted[place, -1],
        "most": np.array([norms.max()]),
        "ids": ids[order],
        "first": first[place],
        "count": (first[1:] - first[:-1])[place],
        "least_id": ids[order][first[:-1]][place],
        "nodes": np.array(nodes, float),
    }


class Search:
    """A block of queries going down one tree together. ``least``: scores that neighbours must reach."""

    def __init__(self, tree: dict, queries: np.ndarray, least: np.ndarray, k: int, factor: float):
        self.t, self.k, self.factor, self.nodes = tree, k, factor, tree["nodes"]
        self.radius = np.sqrt(tree["most"][0])
        scale = self.radius / np.sqrt((queries * queries).sum(1))
        self.q, self.least = queries * scale[:, None], least * scale
        held = k + 1 + SPARE
        self.best = np.full((len(queries), held), -np.inf)
        self.point = np.full((len(queries), held), -1, np.int64)
        self.looked = 0

    def away(self, product: np.ndarray) -> np.ndarray:
        """Distance on the sphere of points with these products."""
        return np.sqrt(np.maximum(2 * self.t["most"][0] - 2 * product, 0))

    def reach(self, qs: np.ndarray) -> np.ndarray:
        """Distance of the worst neighbour that is still wanted; the query itself may be among those held."""
        return self.away(np.maximum(self.best[qs, self.k], self.least[qs])) + SLACK * self.radius

    def offer(self, qs: np.ndarray, start: int, end: int) -> np.ndarray:
        product = self.q[qs] @ self.t["points"][start:end].T
        self.looked += product.size
        # what neither beats the worst one held nor reaches the bound is passed over
        bar = np.maximum(self.best[qs, -1], self.least[qs] - SLACK * self.t["most"][0])
        row, column = np.nonzero(product >= bar[:, None])
        if len(row):
            some = np.unique(row)
            held = np.nonzero(self.point[qs[some]] >= 0)
            query = np.concatenate([qs[some[held[0]]], qs[row]])
            value = np.concatenate([self.best[qs[some]][held], product[row, column]])
            point = np.concatenate([self.point[qs[some]][held], start + column])
            order = np.lexsort((self.t["least_id"][point], -value, query))
            query, value, point = query[order], value[order], point[order]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            top = place < self.best.shape[1]
            self.best[query[top], place[top]] = value[top]
            self.point[query[top], place[top]] = point[top]
        return product

    def go(self, node: int, qs: np.ndarray) -> None:
        if not len(qs):
            return
        start, end, middle, near, far, a, b, c, d = self.nodes[node]
        start, end = int(start), int(end)
        if near < 0:
            self.offer(qs, start, end)
            return
        away = self.away(self.offer(qs, start, start + 1)[:, 0])
        least_near = np.maximum(np.maximum(away - b, a - away), 0) * self.factor
        least_far = np.maximum(np.maximum(away - d, c - away), 0) * self.factor
        inner = least_near <= least_far
        for child, side, least in ((near, inner, least_near), (far, ~inner, least_far), (far, inner, least_far), (near, ~inner, least_near)):
            mine = np.flatnonzero(side)
            mine = mine[least[mine] <= self.reach(qs[mine])]
            self.go(int(child), qs[mine])


def nearest(tree: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[pd.DataFrame, int]:
    """(query_id, vec_id, score) of each query's best ``k`` in the tree, itself left out; and how many products it took."""
    search = Search(tree, queries, np.full(len(queries), -np.inf) if least is None else least, k, factor)
    search.go(0, np.arange(len(queries)))
    q, slot = np.nonzero(search.point >= 0)
    point = search.point[q, slot]
    score = np.add.reduce(queries[q] * tree["points"][point], axis=1)
    # a point stands for all ids of its vector: the smallest k + 1 are enough
    count = np.minimum(tree["count"][point], k + 1)
    ends = np.cumsum(count)
    ids = tree["ids"][np.repeat(tree["first"][point], count) + np.arange(int(count.sum())) - np.repeat(ends - count, count)]
    q, score = np.repeat(q, count), np.repeat(score, count)
    # what falls short of the query's bound is not among its neighbours; products at the bound may differ by rounding
    least = search.least / (search.radius / np.sqrt((queries * queries).sum(1)))
    other = (ids != query_ids[q]) & (score >= least[q] - SLACK * np.abs(least[q]))
    q, score, ids = q[other], score[other], ids[other]
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    top = rank < k
    return pd.DataFrame({"query_id": query_ids[q[top]], "vec_id": ids[top], "score": score[top]}), search.looked


# ---- cells ---------------------------------------------------------------------


@dataclass
class Cells:
    """What is known of all cells: a row each, bounded by the pivots of all bands."""

    dim: np.ndarray
    band: np.ndarray
    pivots: list[np.ndarray]
    widest: np.ndarray | None = None  # angle
    short: np.ndarray | None = None
    long: np.ndarray | None = None
    parts: np.ndarray | None = None

    def of(self, dim: int, band: int | None = None) -> np.ndarray:
        return np.flatnonzero((self.dim == dim) & (True if band is None else self.band == band))

    def cosines(self, own: np.ndarray, units: np.ndarray) -> np.ndarray:
        return np.clip(units @ np.array([self.pivots[c] for c in own]).T, -1.0, 1.0)

    def most(self, own: np.ndarray, queries: np.ndarray, factor: float) -> np.ndarray:
        """The largest score that each query can find in each cell. Relaxed, the angle between query and cell is
        ``factor`` times its least, but no more than with a cell of a ``factor``-th of its width."""
        lengths = np.sqrt((queries * queries).sum(1))
        angle, widest = np.arccos(self.cosines(own, queries / lengths[:, None])), self.widest[own]
        least = np.minimum(np.maximum(angle - widest, 0) * factor, np.maximum(angle - widest / factor, 0))
        cosine = np.cos(np.maximum(least - SLACK, 0))
        return lengths[:, None] * np.where(cosine >= 0, cosine * self.long[own], cosine * self.short[own]) * (1 + SLACK * np.sign(cosine))


def band_of(norms: np.ndarray) -> np.ndarray:
    """Unit vectors, which are a little longer or shorter than 1, lie in the middle of a band."""
    return np.floor(np.log(norms) / np.log(BAND) + 0.5).astype(np.int32)


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["v"].tolist(), float)


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, of very long and very short vectors too."""
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


def spread_out(vectors: np.ndarray, wanted: int) -> np.ndarray:
    """Directions of up to ``wanted`` vectors, each the one farthest from those before."""
    units = vectors / _norms(vectors)[:, None]
    chosen, nearest_cosine = [0], units @ units[0]
    while len(chosen) < min(wanted, len(units)):
        far = int(nearest_cosine.argmin())
        if nearest_cosine[far] > 1 - 1e-12:
            break
        chosen.append(far)
        nearest_cosine = np.maximum(nearest_cosine, units @ units[far])
    return units[chosen]


def dealt(vectors: DataFrame, shard_vectors: int) -> tuple[DataFrame, Cells]:
    """(dim, cell, part, vec_id, v) of every vector, and the cells."""

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.groupby("dim", sort=False):
                norms = _norms(_vectors(own))
                yield own.assign(norm=norms, band=band_of(norms))

    sized = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    banded = stored(sized.mapInPandas(measured, "vec_id long, v array<double>, dim int, norm double, band int"), "banded")
    counts = banded.groupBy("dim", "band").agg(F.least(F.lit(PIVOTS), 4 * F.ceil(F.count("*") / shard_vectors)).cast("int").alias("wanted"))
    order = Window.partitionBy("dim", "band").orderBy(F.xxhash64("vec_id"), "vec_id")
    first = banded.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOT_SAMPLE)

    def pick(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = spread_out(_vectors(frame.sort_values("place")), int(frame["wanted"].iloc[0]))
        return pd.DataFrame({"dim": key[0], "band": key[1], "v": found.tolist()})

    picked = first.join(counts, ["dim", "band"]).groupBy("dim", "band").applyInPandas(pick, "dim int, band int, v array<double>")
    rows = picked.orderBy("dim", "band", "v").collect()  # a bounded number a band
    pivots = [np.array(r["v"], float) for r in rows]
    cells = Cells(np.array([r["dim"] for r in rows], np.int64), np.array([r["band"] for r in rows], np.int64), pivots)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (dim, band), own in frame.groupby(["dim", "band"], sort=False):
                there = cells.of(dim, band)
                cosine = cells.cosines(there, _vectors(own) / own["norm"].to_numpy()[:, None])
                near = cosine.argmax(1)
                angle = np.arccos(cosine[np.arange(len(own)), near])
                yield own.drop(columns="band").assign(cell=there[near], angle=angle)

    placed = stored(banded.mapInPandas(assign, "vec_id long, v array<double>, dim int, norm double, cell int, angle double"), "placed")
    told = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest"), F.min("norm").alias("short"), F.max("norm").alias("long"))
    cells.widest, cells.short, cells.long = (np.zeros(len(pivots)) for _ in range(3))
    cells.parts = np.zeros(len(pivots), np.int64)
    for row in told.collect():  # a row a cell
        c = row["cell"]
        cells.widest[c], cells.short[c], cells.long[c] = row["widest"], row["short"], row["long"]
        cells.parts[c] = -(-row["n"] // shard_vectors)
    parts = F.element_at(F.array(*[F.lit(int(p)) for p in cells.parts] or [F.lit(1)]), F.col("cell") + 1)
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), parts).cast("int")
    return placed.select("dim", "cell", part.alias("part"), "vec_id", "v"), cells


@dataclass
class Index:
    """Trees by (cell, part), and the cells."""

    trees: DataFrame
    cells: Cells


def build_index(vectors: DataFrame, shard_vectors: int = SHARD_VECTORS) -> Index:
    """Trees over the rows of ``usable``."""

    def tree(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        built = build_tree(frame["vec_id"].to_numpy(np.int64), _vectors(frame))
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pack(**built)]})

    rows, cells = dealt(vectors, shard_vectors)
    trees = rows.groupBy("cell", "part").applyInPandas(tree, "cell int, part int, tree binary")
    return Index(stored(trees, "vantage"), cells)


# ---- search --------------------------------------------------------------------


def _blocks(queries: DataFrame, cells: Cells) -> DataFrame:
    """(block, dim, home, data): queries of one home cell, the cell of the best bound, in blocks."""

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, own in frame.groupby("dim", sort=False):
                there = cells.of(dim)
                bound = cells.most(there, _vectors(own), 1.0)
                yield own.assign(home=there[bound.argmax(1)])

    def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        data = pack(ids=frame["vec_id"].to_numpy(np.int64), v=_vectors(frame), least=frame["least"].to_numpy(float))
        return pd.DataFrame({"dim": [key[0]], "home": [key[1]], "data": [data]})

    named = queries.select("vec_id", "v", "least", F.size("v").alias("dim"))
    homes = named.mapInPandas(home, "vec_id long, v array<double>, least double, dim int, home int")
    # a home cell's queries are a share of its vectors: blocks follow the number of its parts
    lots = F.element_at(F.array(*[F.lit(int(max(1, -(-p * SHARD_VECTORS // BLOCK_QUERIES)))) for p in cells.parts] or [F.lit(1)]), F.col("home") + 1)
    return homes.withColumn("lot", F.pmod(F.xxhash64("vec_id", F.lit(7)), lots)).groupBy("dim", "home", "lot").applyInPandas(
        block, "dim int, home int, data binary"
    )


def _meet(sent: DataFrame, index: Index, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score) where blocks (cell, part, data) meet trees."""

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, data in zip(frame["tree"], frame["data"], strict=True):
                held = unpack(data)
                yield nearest(unpack(tree), held["ids"], held["v"], k, factor, held["least"])[0]

    found = sent.join(index.trees, ["cell", "part"]).select("tree", "data")
    return found.mapInPandas(meet, "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = NEIGHBOURS, factor: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (vec_id, v). Without a ``factor``, one is chosen."""
    cells = index.cells
    if not cells.pivots:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if factor is None:
        factor, _ = choose_factor(index, queries, k)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"cell": frame["home"], "part": np.zeros(len(frame), np.int32), "data": frame["data"]})

    def further(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, home, data in zip(frame["dim"], frame["home"], frame["data"], strict=True):
                held = unpack(data)
                there = cells.of(dim)
                worth = cells.most(there, held["v"], factor) >= held["least"][:, None]
                for cell, mine in zip(there.tolist(), worth.T, strict=True):
                    if not mine.any():
                        continue
                    own = data if mine.all() else pack(**{name: x[mine] for name, x in held.items()})
                    for part in range(int(cells.parts[cell])):
                        if (cell, part) != (home, 0):
                            yield pd.DataFrame({"cell": [cell], "part": [part], "data": [own]})

    sent = "cell int, part int, data binary"
    near = stored(_meet(_blocks(queries.withColumn("least", F.lit(float("-inf"))), cells).mapInPandas(first, sent), index, k, factor), "near")
    last = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = queries.join(last.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").na.fill(float("-inf"), ["least"])
    rest = _meet(_blocks(known, cells).mapInPandas(further, sent), index, k, factor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def choose_factor(index: Index, queries: DataFrame, k: int = NEIGHBOURS, wanted: float = WANTED) -> tuple[float, dict[float, tuple[float, float]]]:
    """The largest factor that keeps ``wanted`` of the neighbours of a sample of queries; and per factor, recall and share
    of all products that were formed. The sampled queries meet every tree: exactly first, then by each factor."""
    cells = index.cells
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE_QUERIES).collect()
    of_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["v"]) for r in sample}:
        own = [r for r in sample if len(r["v"]) == dim]
        of_dim[dim] = np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], float)

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["tree"]:
                tree = unpack(data)
                ids, q = of_dim.get(tree["points"].shape[1], (None, None))
                if ids is not None:
                    yield nearest(tree, ids, q, k, 1.0)[0]

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = index.trees.mapInPandas(exact, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()  # k a sampled query
    truth = {(r["query_id"], r["vec_id"]) for r in best}
    last: dict[int, float] = {}
    for r in best:
        if r["rank"] == k:
            last[r["query_id"]] = r["score"]
    least_of = {dim: np.array([last.get(i, -np.inf) for i in ids.tolist()]) for dim, (ids, _) in of_dim.items()}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, data in zip(frame["cell"], frame["tree"], strict=True):
                tree = unpack(data)
                dim = tree["points"].shape[1]
                if dim not in of_dim:
                    continue
                (ids, q), least = of_dim[dim], least_of[dim]
                for factor in FACTORS:
                    sent = cells.most(np.array([cell]), q, factor)[:, 0] >= least
                    met, looked = nearest(tree, ids[sent], q[sent], k, factor, least[sent])
                    kept = len(truth & set(zip(met["query_id"], met["vec_id"], strict=True)))
                    yield pd.DataFrame({"factor": [factor], "kept": [kept], "looked": [looked], "all": [len(ids) * len(tree["points"])]})

    rows = index.trees.mapInPandas(measure, "factor double, kept long, looked long, all long")
    told = rows.groupBy("factor").agg(F.sum("kept").alias("kept"), (F.sum("looked") / F.sum("all")).alias("share")).collect()
    measured = {r["factor"]: (r["kept"] / max(1, len(truth)), r["share"]) for r in told}
    return max([f for f, (recall, _) in measured.items() if recall >= wanted], default=1.0), measured


def op9_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return search(build_index(vectors), vectors.filter("vec_id % 20 = 0"))
