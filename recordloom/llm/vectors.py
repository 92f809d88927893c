"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards.

1. Equal vectors form a class; the least id stands for it. Copies go no further.
2. Centres are fitted on a bounded sample of vectors. A vector's home is its nearest centre; besides, it is a member of
   every shard whose centre is nearly as near (``margin`` in angle). A shard with many members is cut into blocks of about
   ``block`` members, and its queries (the vectors at home there) into groups that meet every block, so no task gets a
   whole hot shard.
3. A block's graph: overlapping sub-clusters, nearest neighbours in each, pruned so that edges point into different
   directions (an edge is left out if an earlier one leads closer to its end), all lists of a vector united, plus reverse edges.
4. A query walks greedily from the block's medoids (and from its own edges, where it is in the block) and then expands
   everything in range of the threshold and a slack below it. Every visited vector is compared in double precision,
   so what counts as a link is a link.
5. Tasks return how many links a query has, and a spanning forest of the links, never all pairs. Components of the
   forests are components of the links.
6. Recall is audited: a bounded set of queries is compared with all rows. Below ``floor`` everything is done anew
   with twice the margin.

Null vectors, vectors with null or non-finite components and zero vectors link with nothing, as do vectors of
different lengths. Rows that share an id are told apart by nothing but their vector, and links between them don't count as
links to others; a row without id links with nothing and is kept. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.snapshots import cut
from .common import on_workers
from .components import components

#: Edges of a vector in each sub-cluster, candidates for them, and how much closer a detour must lead to save an edge.
EDGES, CANDIDATES, DETOUR = 12, 32, 1.2
#: Members of a sub-cluster on average, vectors a walk keeps in view, and how far below the threshold it expands.
SUB, BEAM, SLACK = 512, 24, 0.08


def usable(frame: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, vector as doubles and its length, of rows that can have links."""
    own = frame.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    own = own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good) & F.exists("v", lambda x: x != 0))
    return own.withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    """Vectors of one length as unit rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 3) -> np.ndarray:
    """k directions of a sample of unit rows, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(17)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        best = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, best, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def _pruned(x: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges of a sub-cluster: nearest first, unless an earlier edge leads closer."""
    s = x[who] @ x[who].T
    np.fill_diagonal(s, -2)
    k = min(CANDIDATES, len(who) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), 1), 1)
    gap = 1 - np.take_along_axis(s, near, 1)
    starts, ends = [], []
    for a in range(0, len(who), 256):
        rows = near[a : a + 256]
        between = 1 - np.minimum(s[rows[:, :, None], rows[:, None, :]], 1)
        between[:, np.arange(k), np.arange(k)] = 0
        own, alive = gap[a : a + 256], np.ones(rows.shape, bool)
        for _ in range(min(EDGES, k)):
            some = np.flatnonzero(alive.any(1))
            if not len(some):
                break
            pick = alive[some].argmax(1)
            starts.append(who[a + some])
            ends.append(who[rows[some, pick]])
            alive[some] &= DETOUR * between[some, pick] > own[some]
            alive[some, pick] = False
    return np.concatenate(starts), np.concatenate(ends)


def graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a block in order of their start, where each vector's edges begin, and medoids."""
    n = len(x)
    c = centres(x, max(1, n // SUB), 2)
    s = x @ c.T
    medoids = np.unique(s.argmax(0))
    lists = []
    two = np.argsort(-s, 1)[:, :2]
    for k in range(len(c)):
        who = np.flatnonzero((two == k).any(1))
        if len(who) > 1:
            lists.append(_pruned(x, who))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), medoids
    a, b = (np.concatenate(z) for z in zip(*lists))
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    return edges % n, np.searchsorted(edges // n, np.arange(n + 1)), medoids


def search(x: np.ndarray, q: np.ndarray, start: int, edges, bounds, medoids, own: np.ndarray, least: float):
    """Of a few queries: pairs (query, vector) of at least the given similarity."""
    n, m = len(x), len(q)
    seen = np.full((m, n), -2.0)
    done = np.zeros((m, n), bool)

    def visit(who: np.ndarray, where: np.ndarray) -> None:
        new = seen[who, where] < -1.5
        who, where = who[new], where[new]
        for i in range(0, len(who), 100_000):
            a, b = who[i : i + 100_000], where[i : i + 100_000]
            seen[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    def expand(who: np.ndarray, where: np.ndarray) -> None:
        done[who, where] = True
        size = bounds[where + 1] - bounds[where]
        ends = np.cumsum(size)
        at = np.repeat(bounds[where] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        pair = np.unique(np.repeat(who, size) * n + edges[at])
        visit(pair // n, pair % n)

    visit(np.repeat(np.arange(m), len(medoids)), np.tile(medoids, m))
    inside = np.flatnonzero(own >= 0)
    seen[inside, own[inside]] = -1.0  # known, so it isn't visited
    expand(inside, own[inside])
    # Greedy: of the vectors in view, expand the nearest that isn't yet expanded.
    walking = np.arange(m)
    while len(walking):
        view = np.where(done[walking], -2.0, seen[walking])
        best = view.argmax(1)
        value = view[np.arange(len(walking)), best]
        worst = np.partition(seen[walking], max(0, n - BEAM), axis=1)[:, max(0, n - BEAM)]
        go = (value > -1) & (value >= worst)
        walking, best = walking[go], best[go]
        expand(walking, best)
    # Range: whatever is near the threshold leads on.
    while True:
        who, where = np.nonzero((seen >= least - SLACK) & ~done)
        if not len(who):
            break
        expand(who, where)
    who, where = np.nonzero(seen >= least)
    return who + start, where


def _forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the pairs (positions) to the least id that they connect it with."""
    root = ids.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        # Follow the least ids, too.
        order = np.argsort(ids)
        low = np.minimum(low, low[order[np.searchsorted(ids[order], low)]])
        if (low == root).all():
            break
        root = low
    some = root != ids
    return ids[some], root[some]


def _links(rows: pa.Table, least: float) -> pa.Table:
    """Links of one query group in one block: weights by query, then the forest."""
    is_query = rows.column("query").to_numpy(zero_copy_only=False)
    members, queries = rows.filter(pa.array(~is_query)), rows.filter(pa.array(is_query))
    none = pa.table({c: pa.array([], pa.int64()) for c in ("id", "links", "root")})
    if not members.num_rows or not queries.num_rows:
        return none
    x, q = matrix(members.column("v")), matrix(queries.column("v"))
    ids, weight = (members.column(c).to_numpy() for c in ("id", "weight"))
    asked = queries.column("id").to_numpy()
    order = np.argsort(ids)
    spot = np.minimum(np.searchsorted(ids[order], asked), len(ids) - 1)
    own = np.where(ids[order][spot] == asked, order[spot], -1)
    edges, bounds, medoids = graph(x)
    found = [search(x, q[i : i + 256], i, edges, bounds, medoids, own[i : i + 256], least) for i in range(0, len(q), 256)]
    a, b = (np.concatenate(z) for z in zip(*found))
    other = asked[a] != ids[b]
    a, b = a[other], b[other]
    counts = np.bincount(a, weight[b], len(asked)).astype(np.int64)
    names, place = np.unique(np.concatenate([asked[a], ids[b]]), return_inverse=True)
    nodes, roots = _forest(place[: len(a)], place[len(a) :], names)
    has = counts > 0
    return pa.table(
        {
            "id": pa.array(np.concatenate([asked[has], nodes])),
            "links": pa.array(np.concatenate([counts[has], np.zeros(len(nodes), np.int64)])),
            "root": pa.concat_arrays([pa.nulls(int(has.sum()), pa.int64()), pa.array(roots)]),
        }
    )


def _assigned(vectors: DataFrame, c: np.ndarray, margin: float) -> DataFrame:
    """Vectors by shard: once at home, and as a member of every shard that is nearly as near."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = np.arccos(np.clip(matrix(batch.column("v")) @ shared.value.T, -1, 1))
            home = angle.argmin(1)
            row, shard = np.nonzero(angle <= angle.min(1, keepdims=True) + margin)
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(shard), pa.array(home[row] == shard)], names=[*batch.schema.names, "shard", "home"])

    return vectors.mapInArrow(run, "id bigint, v array<double>, weight bigint, shard bigint, home boolean")


def _searched(vectors: DataFrame, c: np.ndarray, margin: float, least: float, block: int) -> DataFrame:
    placed = cut(_assigned(vectors, c, margin), "placed")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("members"), F.count_if("home").alias("queries")).collect()  # one row a centre
    parts = lambda n: max(1, -(-n // block))
    table = F.create_map(*[F.lit(x) for r in sizes for x in (r["shard"], f"{parts(r['members'])},{parts(r['queries'])}")]) if sizes else None
    if table is None:
        return placed.select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("root"))
    counts = F.split(F.element_at(table, F.col("shard")), ",")
    placed = placed.withColumn("blocks", counts[0].cast("int")).withColumn("groups", counts[1].cast("int"))
    hashed = F.xxhash64("id")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.select("id", "v", "weight", "shard", F.pmod(hashed, "blocks").cast("int").alias("block"), others("groups").alias("group"), F.lit(False).alias("query"))
    queries = placed.where("home").select("id", "v", "weight", "shard", others("blocks").alias("block"), F.pmod(hashed, "groups").cast("int").alias("group"), F.lit(True).alias("query"))
    grouped = members.unionByName(queries).groupBy("shard", "block", "group")
    return grouped.applyInArrow(lambda rows: _links(rows, least), "id bigint, links bigint, root bigint")


def audited(vectors: DataFrame, links: DataFrame, least: float, queries: int = 200) -> float:
    """Share of the true links of at most ``queries`` vectors (ids divisible by 20, by a hash) that were found; 1 if there are none."""
    chosen = vectors.where("id % 20 = 0").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(queries).collect()
    if not chosen:
        return 1.0
    ids = np.array([r["id"] for r in chosen])
    q = matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                other = batch.column("id").to_numpy()
                near = (q @ matrix(batch.column("v")).T >= least) & (ids[:, None] != other[None, :])
                total += near @ batch.column("weight").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    true = vectors.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    row = true.join(links, "id", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0))))).first()
    return row[1] / row[0] if row[0] else 1.0


def near_duplicates(
    frame: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample: int = 8192,
    per_centre: int = 500, most_centres: int = 4096, margin: float = 0.12, block: int = 4096, floor: float = 0.97,
) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every row.

    Centres are fitted on at most ``sample`` vectors of each length, the first by a hash of their id; there is one for ``per_centre`` vectors.
    """
    on_workers(frame.sparkSession)
    good = cut(usable(frame, id_col, vector), "vectors")
    equal = good.groupBy("v", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = cut(equal.select("rep", "v", "dim", "weight"), "equal")
    member = good.join(classes.select("v", "rep", "weight"), "v").select("id", "rep", F.col("weight").alias("size"))
    parts = []
    for dim in [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]:
        own = classes.where(F.col("dim") == dim).select(F.col("rep").alias("id"), "v", "weight")
        some = own.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select("v").collect()
        k = min(most_centres, max(1, own.count() // per_centre))
        c = centres(matrix(pa.array([r["v"] for r in some], pa.list_(pa.float64()))), k)
        wide = margin
        while True:
            found = cut(_searched(own, c, wide, least, block), "found")
            counted = found.where("root is null").groupBy("id").agg(F.sum("links").alias("links"))
            if wide > math.pi or audited(own, counted, least) >= floor:
                break
            wide *= 2
        parts.append(found)
    found = parts[0] if parts else frame.sparkSession.createDataFrame([], "id bigint, links bigint, root bigint")
    for more in parts[1:]:
        found = found.union(more)
    copies = member.where("id > rep").select("id", F.col("rep").alias("root"))
    joined = components(found.where("root is not null").select("id", "root").union(copies), "id", "root")
    links = member.join(found.where("root is null").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    links = links.select("id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")).groupBy("id").agg(F.max("n_links").alias("n_links"))
    out = frame.select(F.col(id_col).cast("bigint").alias("id")).join(links, "id", "left").join(joined, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
