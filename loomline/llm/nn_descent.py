"""Approximate nearest neighbours by NN-descent and greedy graph search.

A first neighbour list comes from cells of random half-spaces. Then, round by round, joins bring
each node's neighbours and reverse neighbours together, with their vectors, and every pair of them
is offered to both: neighbours of neighbours become neighbours. A query starts at its own node's
neighbours, and at those of the nearest nodes of a bounded sample, and repeatedly expands the
nearest nodes it has not expanded. Equal vectors are one node; what is found is expanded to ids.

Largest inner product becomes nearness on a sphere by one more component, which fills each vector
up to the greatest length; a query has zero there. Vectors travel as bytes with a scale; what is
returned is scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cuts, checkpoint, prepare

NEIGHBOURS = 50
CELL = 512
TREES = 12
#: A tree has at least this many half-spaces, so that lists come from the rounds at every size.
LEAST_BITS = 2
ROUNDS = 3
#: Neighbours of a node that take part in a round, fresh ones before old; as many reverse ones do.
MEMBERS = 36
OFFERS = 10
#: Expansions of a query in a search step, the most steps, and results that are scored exactly.
EXPAND = 8
STEPS = 24
POOL = 60
#: The search ends when a step changes the nearest ``SETTLED`` nodes of no more than this share of the queries.
STIRRED = 0.02
SETTLED = 20
#: Nodes of the sample, nearest to a query, from which it starts beside its own.
SEEDS = 15
#: Bound of the sample from which the half-spaces take their medians.
SAMPLE = 4096

LIST = "id long, ids binary, sims binary"


def pack(x: np.ndarray) -> np.ndarray:
    """Rows of floats as bytes: a scale and signed bytes."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32) / 127
    small = np.rint(x / scale).astype(np.int8)
    return np.concatenate([scale.view(np.uint8).reshape(len(x), 4), small.view(np.uint8)], axis=1)


def unpack(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows of sorted batches by their first column: the value and the other columns' values."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if rows:
                    yield key, [list(c) for c in zip(*rows)]
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, [list(c) for c in zip(*rows)]


def _out(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    return _out(rows, ["id", "ids", "sims"], [pa.int64(), pa.binary(), pa.binary()])


def _spread(directions: np.ndarray, medians: np.ndarray) -> Callable:
    """Each vector to its cell in every tree: (cell, id, vec)."""
    trees, bits, _ = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column(1).to_pylist())
            for t in range(trees):
                side = (x @ directions[t].T > medians[t]).astype(np.int64)
                cell = side @ (1 << np.arange(bits, dtype=np.int64)) + (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "id", "vec"])

    return run


def _cells(k: int) -> Callable:
    """Rows sorted by cell to each member's nearest in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, vectors) in groups(batches):
            ids, x = np.array(ids), unpack(vectors)
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            n = min(k, len(ids) - 1)
            if n < 1:
                continue
            best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(sims, best, 1)
            yield _lists([(int(i), ids[b].tobytes(), s.tobytes()) for i, b, s in zip(ids, best, near)])

    return run


def merged(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most similar of a list, each id once."""
    found, first = np.unique(ids, return_index=True)
    order = np.lexsort((found, -sims[first]))[:k]
    return found[order], sims[first][order]


def _merge(k: int) -> Callable:
    """Rows (id, ids, sims, fresh, own) sorted by id to one list of the ``k`` nearest, new ones marked fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for node, (ids, sims, old, vectors) in groups(batches):
            before = {}
            for i, o in zip(ids, old):
                if o is not None:
                    before = dict(zip(np.frombuffer(i, np.int64).tolist(), o))
            near, s = merged(np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float32), k)
            fresh = bytes(before.get(i, 1) for i in near.tolist())
            vector = next(v for v in vectors if v is not None)
            rows.append((node, near.tobytes(), s.tobytes(), fresh, vector))
            if len(rows) >= 2048:
                yield _out(rows, ["id", "ids", "sims", "fresh", "vec"], [pa.int64(), *[pa.binary()] * 4])
                rows = []
        yield _out(rows, ["id", "ids", "sims", "fresh", "vec"], [pa.int64(), *[pa.binary()] * 4])

    return run


def _chosen(ids: bytes, fresh: bytes, node: int, members: int) -> np.ndarray:
    """Places of the neighbours that take part in a round: fresh ones first, in an order by hash."""
    found = np.frombuffer(ids, np.int64).view(np.uint64)
    old = np.frombuffer(fresh, np.uint8) == 0
    mixed = (found ^ np.uint64(node & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    return np.lexsort((mixed, old))[:members]


def _edges(members: int) -> Callable:
    """Nodes to (center, member, fresh): each with its chosen neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center, member, fresh = [], [], []
            for node, ids, new in zip(*(c.to_pylist() for c in batch.columns)):
                at = _chosen(ids, new, node, members)
                center.append(np.full(len(at), node))
                member.append(np.frombuffer(ids, np.int64)[at])
                fresh.append(np.frombuffer(new, np.uint8)[at])
            if center:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(center)), pa.array(np.concatenate(member)), pa.array(np.concatenate(fresh).astype(bool))],
                    ["center", "member", "fresh"],
                )

    return run


def _aged(members: int) -> Callable:
    """Nodes with the neighbours that took part marked old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, ids, sims, new, vector in zip(*(c.to_pylist() for c in batch.columns)):
                marks = np.frombuffer(new, np.uint8).copy()
                marks[_chosen(ids, new, node, members)] = 0
                rows.append((node, ids, sims, marks.tobytes(), vector))
            yield _out(rows, ["id", "ids", "sims", "fresh", "vec"], [pa.int64(), *[pa.binary()] * 4])

    return run


def _local_join(offers: int) -> Callable:
    """Rows (center, member, fresh, bound, vec) sorted by center, each member once, to offers: lists of new near nodes for members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, (ids, fresh, bound, vectors) in groups(batches):
            if len(ids) < 2:
                continue
            ids, fresh, bound, x = np.array(ids), np.array(fresh), np.array(bound, np.float32), unpack(vectors)
            sims = x @ x.T
            np.fill_diagonal(sims, -np.inf)
            sims[np.ix_(~fresh, ~fresh)] = -np.inf
            n = min(offers, len(ids) - 1)
            best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(sims, best, 1)
            better = near > bound[:, None]
            for i in np.flatnonzero(better.any(axis=1)):
                b = better[i]
                rows.append((int(ids[i]), ids[best[i][b]].tobytes(), near[i][b].tobytes()))
            if len(rows) >= 20_000:
                yield _lists(rows)
                rows = []
        yield _lists(rows)

    return run


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _graph_of(lists: DataFrame, state: DataFrame, k: int, cuts: Cuts) -> DataFrame:
    """The state with lists merged in, in place of the last graph."""
    none = F.lit(None).cast("binary")
    own = state.select("id", "ids", "sims", "fresh", "vec")
    rows = own.unionByName(lists.select("id", "ids", "sims", none.alias("fresh"), none.alias("vec")))
    return cuts.cut("graph", _dealt(rows, "id").mapInArrow(_merge(k), f"{LIST}, fresh binary, vec binary"))


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v double array) of the vectors that take part: finite, not zero; one row an id."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # no negative zero
    rows = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, v), one for each vector of (id, v) with its least id, and (id, node) of every row.

    Vectors are told apart by 128 bits of hashes.
    """
    keyed = rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"), "v")
    nodes = checkpoint(keyed.groupBy("h", "g").agg(F.min("id").alias("id"), F.min("v").alias("v")))
    of = keyed.select("id", "h", "g").join(nodes.select("h", "g", F.col("id").alias("node")), ["h", "g"])
    return nodes.select("id", "v"), checkpoint(of.select("id", "node"))


def build(rows: DataFrame, *, k: int = NEIGHBOURS, cell: int = CELL, trees: int = TREES, rounds: int = ROUNDS, members: int = MEMBERS, offers: int = OFFERS, seed: int = 7) -> tuple[DataFrame, dict[int, bytes]]:
    """The neighbour graph (id, ids, sims, fresh, vec) of (id, v), every row's ``k`` nearest found, and the sampled nodes.

    The driver holds ``SAMPLE`` vectors, by least hash of the id, and for the half-spaces and
    as starts of searches.
    A cell of more than ``2 * cell`` rows is divided by a hash of the id; vectors are distinct.
    """
    spark = rows.sparkSession
    prepare(spark)
    sums = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    size, greatest = sums["d"] or 1, sums["m"] or 1.0
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / greatest) * (x / greatest))
    longest = float(np.sqrt(rows.agg(F.max(squares)).first()[0] or 1.0))

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1).to_pylist()
                x = np.array([v + [0.0] * (size - len(v)) for v in lists]) / greatest / longest
                rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(pack(np.hstack([x, rest])))], ["id", "vec"])

    cuts = Cuts(spark)
    packed = cuts.cut("packed", rows.mapInArrow(lift, "id long, vec binary"))
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, sums["n"]) / cell))))
    sample = packed.orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE).collect()
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(trees, bits, size + 1)).astype(np.float32)
    medians = np.zeros(directions.shape[:2], np.float32)
    if sample:
        medians = np.median(unpack([bytes(r["vec"]) for r in sample]) @ directions.transpose(0, 2, 1), axis=1).astype(np.float32)
    filed = cuts.cut("filed", packed.mapInArrow(_spread(directions, medians), "cell long, id long, vec binary"))
    large = filed.groupBy("cell").count().where(F.col("count") > 2 * cell).select("cell", F.ceil(F.col("count") / cell).alias("parts"))
    part = F.pmod(F.xxhash64("id", "cell"), F.coalesce("parts", F.lit(1)))
    filed = filed.join(large, "cell", "left").select(F.xxhash64("cell", part).alias("cell"), "id", "vec")
    near = _dealt(filed, "cell").mapInArrow(_cells(k), LIST)
    empty = F.lit(b"").cast("binary")
    graph = _graph_of(near, packed.select("id", empty.alias("ids"), empty.alias("sims"), empty.alias("fresh"), "vec"), k, cuts)
    cuts.drop("filed")
    cuts.drop("packed")
    for _ in range(rounds):
        forward = graph.select("id", "ids", "fresh").mapInArrow(_edges(members), "center long, member long, fresh boolean")
        # Of a node that many neighbour, few reverse ones take part: the limit holds before the shuffle, too.
        place = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("member", "center")))
        reverse = forward.select(F.col("member").alias("center"), F.col("center").alias("member"), "fresh")
        reverse = reverse.withColumn("_place", place).where(F.col("_place") <= members).drop("_place")
        pairs = forward.union(reverse).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
        bound = F.when(F.octet_length("sims") >= 4 * k, F.substring("sims", -4, 4))
        joined = pairs.join(graph.select(F.col("id").alias("member"), bound.alias("b"), "vec"), "member")
        shown = joined.select("center", "member", "fresh", "b", "vec").mapInArrow(_bounds, "center long, member long, fresh boolean, bound float, vec binary")
        offered = _dealt(shown, "center").mapInArrow(_local_join(offers), LIST)
        aged = graph.mapInArrow(_aged(members), f"{LIST}, fresh binary, vec binary")
        graph = _graph_of(offered, aged, k, cuts)
    return graph, {r["id"]: bytes(r["vec"]) for r in sample}


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last similarity of a full list, from its bytes; -2 for another."""
    least = np.float32(-2).tobytes()
    for batch in batches:
        bound = np.frombuffer(b"".join(b or least for b in batch.column(3).to_pylist()), np.float32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bound), batch.column(4)], ["center", "member", "fresh", "bound", "vec"])


def _expand(expand: int) -> Callable:
    """Query states to the nodes that they expand: (node, query, qvec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, ids, _, done, vector in zip(*(c.to_pylist() for c in batch.columns)):
                open_ = [i for i, d in zip(np.frombuffer(ids, np.int64).tolist(), done) if not d]
                rows.extend((i, query, vector) for i in open_[:expand])
            yield _out(rows, ["node", "query", "qvec"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, qvec, ids) to (cand, query, qvec)."""
    for batch in batches:
        rows = []
        for query, vector, ids in zip(*(c.to_pylist() for c in batch.columns)):
            rows.extend((i, query, vector) for i in np.frombuffer(ids, np.int64).tolist() if i != query)
        yield _out(rows, ["cand", "query", "qvec"], [pa.int64(), pa.int64(), pa.binary()])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, cand, qvec, vec) to one-place lists of the query."""
    for batch in batches:
        if batch.num_rows:
            sims = (unpack(batch.column(2).to_pylist()) * unpack(batch.column(3).to_pylist())).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _binary(batch.column(1).to_numpy()[:, None]), _binary(sims.astype(np.float32)[:, None])], ["id", "ids", "sims"]
            )


def _advance(expand: int, pool: int) -> Callable:
    """Rows (query, ids, sims, done, qvec) sorted by query to the query's next state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for query, (ids, sims, done, vectors) in groups(batches):
            seen, before = set(), []
            for i, d in zip(ids, done):
                if d is not None:
                    before = np.frombuffer(i, np.int64).tolist()
                    seen = {n for n, x in zip(before, d) if x} | set([n for n, x in zip(before, d) if not x][:expand])
            near, s = merged(np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float32), pool)
            state = bytes(int(n in seen) for n in near.tolist())
            moved = set(near[:SETTLED].tolist()) != set(before[:SETTLED])
            rows.append((query, near.tobytes(), s.tobytes(), state, next(v for v in vectors if v is not None), moved))
            if len(rows) >= 1024:
                yield _out(rows, *_STATE)
                rows = []
        yield _out(rows, *_STATE)

    return run


_STATE = (["id", "ids", "sims", "done", "qvec", "moved"], [pa.int64(), *[pa.binary()] * 4, pa.bool_()])


def greedy(graph: DataFrame, sample: dict[int, bytes], queries: DataFrame, *, expand: int = EXPAND, steps: int = STEPS, pool: int = POOL) -> DataFrame:
    """(query, cand): what greedy search from each query's own node and the sample finds, at most ``pool`` nodes.

    ``queries`` has id. A step joins the expanded nodes to the graph, and their neighbours to the
    vectors.
    """
    names, nodes = np.array(list(sample), np.int64), list(sample.values())

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = unpack(nodes) if nodes else None
        for batch in batches:
            rows = []
            for node, vector in zip(*(c.to_pylist() for c in batch.columns)):
                x = unpack([vector])
                x[:, -1] = 0  # a query has nothing in the added component
                sims = (places @ x[0]).astype(np.float32)
                best = [b for b in np.argsort(-sims)[: SEEDS + 1].tolist() if names[b] != node][:SEEDS]
                ids = np.concatenate([[node], names[best]])
                sims = np.concatenate([[2], sims[best]]).astype(np.float32)  # its own node is expanded first
                rows.append((node, ids.tobytes(), sims.tobytes(), bytes(len(ids)), pack(x)[0].tobytes(), True))
            yield _out(rows, *_STATE)

    schema = f"{LIST}, done binary, qvec binary, moved boolean"
    cuts = Cuts(graph.sparkSession)
    state = cuts.cut("state", graph.join(queries.select("id"), "id", "left_semi").select("id", "vec").mapInArrow(start, schema))
    count = state.count()
    none = F.lit(None).cast("binary")
    for _ in range(steps if count else 0):
        frontier = cuts.cut("frontier", state.select("id", "ids", "sims", "done", "qvec").mapInArrow(_expand(expand), "node long, query long, qvec binary"))
        near = frontier.join(graph.select(F.col("id").alias("node"), "ids"), "node").select("query", "qvec", "ids")
        pairs = near.mapInArrow(_candidates, "cand long, query long, qvec binary").dropDuplicates(["cand", "query"])
        pairs = pairs.join(graph.select(F.col("id").alias("cand"), "vec"), "cand").select("query", "cand", "qvec", "vec")
        found = pairs.mapInArrow(_similar, LIST)
        rows = state.drop("moved").unionByName(found.select("id", "ids", "sims", none.alias("done"), none.alias("qvec")))
        state = cuts.cut("state", _dealt(rows, "id").mapInArrow(_advance(expand, pool), schema))
        if state.where("moved").count() <= STIRRED * count:
            break
    return state.select(F.col("id").alias("query"), F.lit(None).cast("binary").alias("qvec"), "ids").mapInArrow(
        _candidates, "cand long, query long, qvec binary"
    ).select("query", "cand")


def nearest(vectors: DataFrame, *, ident: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, **index: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id ``every`` divides, the ``k`` nearest found among all others.

    The score is the inner product of the original vectors, summed in double precision; ties go to
    the smaller id. Null ids and vectors that are null, zero or not finite take no part; rows of
    one id count once, by the least vector; of vectors of unequal size the shorter count as filled
    with zeros; fewer candidates than ``k`` are all returned. Other columns are not read.

    Graph and search hold each distinct vector once. Of a vector found, its ``k + 1`` smallest ids
    are candidates, the query's own vector included: no others of it can be among the ``k``.
    """
    rows = checkpoint(usable(vectors, ident, vector))
    nodes, of = distinct_vectors(rows)
    graph, sample = build(nodes, **index)
    asked = of.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "node")
    own = asked.select("node").distinct()
    found = greedy(graph, sample, own.select(F.col("node").alias("id")))
    found = found.union(own.select("node", "node"))
    pairs = found.join(nodes.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    pairs = pairs.join(nodes.select(F.col("id").alias("cand"), "v"), "cand")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    scored = pairs.select("query", "cand", product.alias("score"))

    least = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    members = of.withColumn("_place", least).where(F.col("_place") <= k + 1).select(F.col("node").alias("cand"), F.col("id").alias("vec_id"))
    near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = scored.join(members, "cand").withColumn("_place", near).where(F.col("_place") <= k + 1)
    named = asked.join(best.select(F.col("query").alias("node"), "vec_id", "score"), "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
