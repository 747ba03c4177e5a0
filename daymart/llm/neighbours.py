"""Approximate nearest neighbours: a neighbour graph by NN-descent, queried by greedy graph search.

Equal vectors are one node. Random projections put nodes in order, and blocks of that order give each
node its first neighbours. Each round of the descent then joins every node's neighbours with each other:
nodes send their codes to where their neighbours meet, pairs that are nearer than a node's furthest
neighbour come back, and each node keeps the nearest, until next to no list changes any more. A query walks the finished graph from its own
node: in each round it opens the nearest nodes of its beam that are not open yet, all queries at once in
one join with the graph. What is found is scored again on the original vectors in double precision.

Vectors whose lengths differ by less than a factor of 2 are a band, with a graph of its own. A query walks
the graph of each band, from its own node and from the best of a sample that grows with the band; a small
band is looked through whole.

Codes are vectors of signed bytes with one scale each, and beside them a coordinate that gives all of a
band the same norm, so that the graph links what is near. A walk leaves that coordinate out and therefore
follows the inner product itself.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymart.llm import tiles
from daymart.session import stage

#: Neighbours of a node, nearest of those that name it, projections, nodes in a block.
NEIGHBOURS, NAMED_BY, PROJECTIONS, BLOCK = 32, 32, 2, 256
#: The descent ends after a round in which at most this share of all neighbours is new.
SETTLED = 0.01
#: Beam of a query, nodes it opens in a round, found nodes that are scored exactly.
BEAM, OPENED, RESCORED = 256, 128, 64
#: Nodes of a band that every query looks at first: at least FIRST, and WIDER times the root of the band's
#: size. A walk starts at the START best of them.
FIRST, WIDER, START = 1024, 8, 16
#: Bytes of a code before its signed bytes.
HEAD = 8
#: Nodes or queries that a task of a round takes on.
IN_TASK = 1000
SEED = 11
#: ``fresh``: how many of the neighbours the last round found.
GRAPH = "node long, code binary, ids binary, sims binary, fresh int"
GRAPH_ARROW = pa.schema([("node", pa.int64()), ("code", pa.binary()), ("ids", pa.binary()), ("sims", pa.binary()), ("fresh", pa.int32())])


def log_lengths(vectors: np.ndarray) -> np.ndarray:
    """Binary logarithms of the lengths, finite for all finite vectors that are not zero."""
    peak = np.abs(vectors).max(1)
    return np.log2(peak) + np.log2(((vectors / peak[:, None]) ** 2).sum(1)) / 2


def encode(vectors: np.ndarray, top) -> list[bytes]:
    """Scale and added coordinate (float32), then signed bytes of each vector, in units of the largest
    length of its band, whose binary logarithm is ``top``."""
    parts = vectors / np.abs(vectors).max(1, keepdims=True)
    relative = np.exp2(log_lengths(vectors) - top)
    parts *= (relative / np.sqrt((parts**2).sum(1)))[:, None]
    spare = np.sqrt(np.maximum(1 - relative**2, 0.0))
    scale = np.abs(parts).max(1) / 127
    codes = np.rint(parts / scale[:, None]).astype(np.int8)
    heads = np.stack([scale, spare], axis=1).astype(np.float32)
    return [h.tobytes() + c.tobytes() for h, c in zip(heads, codes, strict=True)]


def lengthened(raw: np.ndarray) -> np.ndarray:
    """Vectors with their added coordinate, from rows of code bytes."""
    heads = raw[:, :HEAD].copy().view(np.float32)
    return np.concatenate([raw[:, HEAD:].view(np.int8).astype(np.float32) * heads[:, :1], heads[:, 1:]], axis=1)


def decoded(codes: list[bytes]) -> np.ndarray:
    return lengthened(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1))


def products(raw: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of coded vectors (rows) with bare signed bytes of queries, up to the queries' scale."""
    return (raw[:, HEAD:].view(np.int8).astype(np.float32) @ points) * raw[:, :4].copy().view(np.float32)


def bare(codes: list[bytes]) -> np.ndarray:
    """Signed bytes of each code as floats, one column for each."""
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)[:, HEAD:].view(np.int8).astype(np.float32).T


def nearest(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids with the largest similarities; ties go to smaller ids."""
    ids, first = np.unique(ids, return_index=True)
    sims = sims[first]
    order = np.lexsort((ids, -sims))[:most]
    return ids[order], sims[order]


def graph_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), GRAPH_ARROW, strict=True)], schema=GRAPH_ARROW)


def in_batches(rows, size: int = 2000):
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield graph_batch(waiting)
            waiting = []
    if waiting:
        yield graph_batch(waiting)


def rows_of(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector array<double>`` of the rows that take part: a vector without null or non-finite
    components, not zero, and as long as most are."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    kept = own.where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))
    lengths = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return kept.where(F.size("vector") == lengths.select("n").scalar()).distinct()


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows of a key together, in as many tasks as the number of nodes asks for."""
    return rows.repartitionById(parts, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).sortWithinPartitions(*keys)


def merged(rows: DataFrame, parts: int) -> DataFrame:
    """One graph row for each node from its own row (with a code) and rows of new neighbours."""

    def merging(batches):
        def joined():
            at, code, had, ids, sims = None, None, b"", [], []
            for node, own, more, near, _ in rows_of(batches):
                if node != at:
                    if code is not None:
                        yield finished(at, code, had, ids, sims)
                    at, code, had, ids, sims = node, None, b"", [], []
                if own is not None:
                    code, had = own, more
                ids.append(np.frombuffer(more, np.int64))
                sims.append(np.frombuffer(near, np.float32))
            if code is not None:
                yield finished(at, code, had, ids, sims)

        def finished(node, code, had, ids, sims):
            best, near = nearest(np.concatenate(ids), np.concatenate(sims), NEIGHBOURS)
            fresh = len(best) - int(np.isin(best, np.frombuffer(had, np.int64)).sum())
            return node, code, best.tobytes(), near.tobytes(), fresh

        yield from in_batches(joined())

    return dealt(rows, parts, "node").mapInArrow(merging, GRAPH)


def first_graph(nodes: DataFrame, count: int, parts: int) -> DataFrame:
    """Neighbours within blocks of nodes of a band that projections put side by side."""
    bits = max(0, math.ceil(math.log2(max(count, 1) / BLOCK)))
    rows = nodes.select("node", "code", F.lit(b"").alias("ids"), F.lit(b"").alias("sims"), F.lit(0).alias("fresh"))
    for turn in range(PROJECTIONS):

        def placing(batches, turn=turn):
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = decoded(batch.column(1).to_pylist())
                planes = np.random.default_rng((SEED, turn)).standard_normal((points.shape[1], bits + 1)).astype(np.float32)
                sides = points @ planes
                cell = (sides[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(points), np.int64)
                yield pa.record_batch(
                    [*batch.columns, pa.array(cell.astype(np.int64)), pa.array(sides[:, bits].astype(np.float64))],
                    ["node", "code", "band", "cell", "along"],
                )

        def blocking(batches):
            def found():
                block: list[tuple] = []
                for row in rows_of(batches):
                    if len(block) == BLOCK or block and block[-1][2] != row[2]:
                        yield from among(block)
                        block = []
                    block.append(row)
                yield from among(block)

            yield from in_batches(found())

        def among(block):
            if len(block) < 2:
                return
            names, points = np.array([r[0] for r in block], np.int64), decoded([r[1] for r in block])
            sims = points @ points.T
            np.fill_diagonal(sims, -np.inf)
            most = min(NEIGHBOURS, len(block) - 1)
            best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            for name, own, near in zip(names.tolist(), best, np.take_along_axis(sims, best, 1), strict=True):
                yield name, None, names[own].tobytes(), near.astype(np.float32).tobytes(), 0

        placed = nodes.select("node", "code", "band").mapInArrow(placing, "node long, code binary, band int, cell long, along double")
        rows = rows.unionByName(placed.orderBy("band", "cell", "along", "node").select("node", "code", "band").mapInArrow(blocking, GRAPH))
    return merged(rows, parts)


def named(graph: DataFrame) -> DataFrame:
    """``node, other, sim``: the neighbours of each node."""

    def listing(batches):
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if ids:
                sims = [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
                nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])
                columns = [pa.array(nodes), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sims))]
                yield pa.record_batch(columns, ["node", "other", "sim"])

    return graph.select("node", "ids", "sims").mapInArrow(listing, "node long, other long, sim float")


def meetings(graph: DataFrame) -> DataFrame:
    """``at, node``: node is a neighbour of ``at``, or one of the nearest NAMED_BY that name ``at``."""
    edges = named(graph)
    order = Window.partitionBy("other").orderBy(F.desc("sim"), "node")
    back = edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NAMED_BY)
    return edges.select(F.col("node").alias("at"), F.col("other").alias("node")).unionByName(back.select(F.col("other").alias("at"), "node"))


def sent(graph: DataFrame, buckets: int) -> DataFrame:
    """Codes on their way to the buckets of the nodes where they meet: a code goes to a bucket once for
    each batch of rows, however many of its meetings are there."""
    codes = graph.select("node", "code", F.col("sims"))
    joined = meetings(graph).join(codes, "node").select("at", "node", "code", "sims")

    def packing(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes, sims = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            bucket = at % buckets
            order = np.lexsort((nodes, bucket))
            borders = [0, *(np.nonzero(np.diff(bucket[order]))[0] + 1).tolist(), len(order)]
            out = []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                own = order[a:b]
                names, lead, which = np.unique(nodes[own], return_index=True, return_inverse=True)
                lead = own[lead].tolist()
                furthest = np.array([edge_of(sims[i]) for i in lead], np.float32)
                body = tiles.pack(names, furthest, b"".join(codes[i] for i in lead), which.astype(np.int32), at[own], level=1)
                out.append((0, tiles.KEPT, int(bucket[own[0]]), body))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), tiles.ROWS_ARROW, strict=True)], schema=tiles.ROWS_ARROW)

    return joined.mapInArrow(packing, tiles.ROWS).repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int"))


def edge_of(sims: bytes) -> float:
    """The similarity a new neighbour has to beat."""
    own = np.frombuffer(sims, np.float32)
    return float(own[-1]) if len(own) == NEIGHBOURS else -np.inf


def arrived(batches):
    """All that a bucket got: names, furthest, points, and for each meeting the point and its place."""
    names, furthest, codes, which, at, base = [], [], [], [], [], 0
    for batch in batches:
        for body in batch.column(3).to_pylist():
            n, f, c, w, a = tiles.unpack(body, np.int64, np.float32, None, np.int32, np.int64)
            names.append(n)
            furthest.append(f)
            codes.append(np.frombuffer(c, np.uint8).reshape(len(n), -1))
            which.append(w.astype(np.int64) + base)
            at.append(a)
            base += len(n)
    if not names:
        return None
    at, which = np.concatenate(at), np.concatenate(which)
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    borders = [0, *(np.nonzero(np.diff(at))[0] + 1).tolist(), len(at)]
    return np.concatenate(names), np.concatenate(furthest), np.concatenate(codes), at, which, borders


def descended(graph: DataFrame, buckets: int) -> DataFrame:
    """One round: neighbours of a node meet there, and each keeps the nearest it has met."""

    def meeting(batches):
        got = arrived(batches)
        if got is None:
            return
        names, furthest, codes, _, which, borders = got
        found_a, found_b, found_s = [], [], []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            own = which[a:b]
            own = own[np.unique(names[own], return_index=True)[1]]
            points = lengthened(codes[own])
            sims = points @ points.T
            np.fill_diagonal(sims, -np.inf)
            i, j = np.nonzero(sims > furthest[own][:, None])
            found_a.append(names[own[i]])
            found_b.append(names[own[j]])
            found_s.append(sims[i, j])
        a, b, s = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_s)
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s = a[new], b[new], s[new]
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        starts = np.nonzero(np.concatenate([[True], a[1:] != a[:-1]]))[0] if len(a) else np.zeros(0, int)
        ends = np.minimum(np.concatenate([starts[1:], [len(a)]]), starts + NEIGHBOURS) if len(a) else starts
        yield from in_batches(
            (int(a[x]), None, b[x:y].tobytes(), s[x:y].astype(np.float32).tobytes(), 0) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)
        )

    return merged(graph.unionByName(sent(graph, buckets).mapInArrow(meeting, GRAPH)), buckets)


def build(nodes: DataFrame, count: int) -> DataFrame:
    """The graph of ``nodes`` (node, code, band): for each node its neighbours and similarities, nearest first.
    Every round is written to the shared folder. Similarities of a list only grow, so the rounds end;
    larger tables take more of them."""
    parts = parts_for(count)
    graph = stage(first_graph(nodes, count, parts))
    while True:
        graph = stage(descended(graph, parts))
        fresh, total = graph.agg(F.sum("fresh"), F.sum(F.length("ids") / 8)).first()
        if (fresh or 0) <= SETTLED * (total or 0):
            return graph


def parts_for(count: int) -> int:
    return max(1, math.ceil(count / IN_TASK))


def walkable(graph: DataFrame, parts: int) -> str:
    """Store each node with the codes of all it is linked to, bucketed by node; gives the table's name."""
    buckets = tiles.bucket_count(graph)

    def gathering(batches):
        got = arrived(batches)
        if got is None:
            return
        names, _, codes, at, which, borders = got
        rows = []
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            own = which[a:b]
            own = own[np.unique(names[own], return_index=True)[1]]
            rows.append((int(at[a]), codes[own].tobytes(), names[own].tobytes(), b"", 0))
            if len(rows) == 500:
                yield graph_batch(rows)
                rows = []
        if rows:
            yield graph_batch(rows)

    name = f"neighbour_graph_{uuid.uuid4().hex}"
    linked = sent(graph, parts).mapInArrow(gathering, GRAPH).select("node", F.col("code").alias("codes"), "ids")
    linked.repartition(buckets, "node").write.bucketBy(buckets, "node").format("parquet").saveAsTable(name)
    return name


STATE = "query long, band int, code binary, ids binary, sims binary, opened binary"
STATE_ARROW = pa.schema([("query", pa.int64()), ("band", pa.int32()), ("code", pa.binary()), ("ids", pa.binary()), ("sims", pa.binary()), ("opened", pa.binary())])


def walked(states: DataFrame, table: str, parts: int) -> DataFrame:
    """One round of all queries: open nodes, look at what they are linked to, keep the best beam."""
    spark = states.sparkSession

    def opening(batches):
        for query, band, code, ids, sims, opened in rows_of(batches):
            ids, done = np.frombuffer(ids, np.int64), np.frombuffer(opened, np.uint8)
            least = float(np.frombuffer(sims, np.float32)[-1]) if len(ids) == BEAM else -np.inf
            go = ids[np.nonzero(done == 0)[0][:OPENED]]
            if len(go):
                n = len(go)
                yield pa.record_batch(
                    [
                        pa.array(go),
                        pa.array([query] * n, pa.int64()),
                        pa.array([band] * n, pa.int32()),
                        pa.array([code] * n, pa.binary()),
                        pa.array([least] * n, pa.float32()),
                    ],
                    ["node", "query", "band", "code", "least"],
                )

    def looking(batches):
        for batch in batches:
            found: dict[tuple[int, int], list] = {}
            for query, band, code, least, near, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = np.frombuffer(ids, np.int64)
                sims = products(np.frombuffer(near, np.uint8).reshape(len(names), -1), bare([code]))[:, 0]
                good = sims > least
                if good.any():
                    found.setdefault((query, band), []).append((names[good], sims[good]))
            rows = []
            for (query, band), parts in found.items():
                ids, sims = nearest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), BEAM)
                rows.append((query, band, None, ids.tobytes(), sims.astype(np.float32).tobytes(), bytes(len(ids))))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STATE_ARROW, strict=True)], schema=STATE_ARROW)

    def keeping(batches):
        at, code, own, parts, out = None, None, None, [], []

        def settled():
            ids, done = np.frombuffer(own[0], np.int64), np.frombuffer(own[2], np.uint8).copy()
            done[np.nonzero(done == 0)[0][:OPENED]] = 1
            every = np.concatenate([ids, *(np.frombuffer(p[0], np.int64) for p in parts)])
            sims = np.concatenate([np.frombuffer(own[1], np.float32), *(np.frombuffer(p[1], np.float32) for p in parts)])
            kept, near = nearest(every, sims, BEAM)
            known = dict(zip(ids.tolist(), done.tolist(), strict=True))
            marks = bytes(known.get(i, 0) for i in kept.tolist())
            return *at, code, kept.tobytes(), near.tobytes(), marks

        for query, band, c, ids, sims, opened in rows_of(batches):
            if (query, band) != at:
                if own is not None:
                    out.append(settled())
                at, code, own, parts = (query, band), None, None, []
            if c is not None:
                code, own = c, (ids, sims, opened)
            else:
                parts.append((ids, sims))
            if len(out) >= 500:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), STATE_ARROW, strict=True)], schema=STATE_ARROW)
                out = []
        if own is not None:
            out.append(settled())
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), STATE_ARROW, strict=True)], schema=STATE_ARROW)

    frontier = states.mapInArrow(opening, "node long, query long, band int, code binary, least float")
    at = frontier.join(spark.table(table), "node").select("query", "band", "code", "least", "codes", "ids")
    rows = states.unionByName(at.mapInArrow(looking, STATE))
    return dealt(rows, parts, "query", "band").mapInArrow(keeping, STATE)


def first_looks(nodes: DataFrame, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each band the ids and code bytes of the nodes that every query looks at: all of a small band, of
    others a choice by hash. The driver holds the root of the table's size times WIDER."""
    if not sizes:
        return {}
    wanted = {b: max(FIRST, math.ceil(WIDER * math.sqrt(n))) for b, n in sizes.items()}
    shares = nodes.sparkSession.createDataFrame([(b, min(1.0, wanted[b] / n)) for b, n in sizes.items()], "band int, share double")
    draw = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(2**30)) / 2**30
    chosen = nodes.join(F.broadcast(shares), "band").where(draw < F.col("share")).select("band", "node", "code").toArrow()
    found: dict[int, list] = {b: [] for b in sizes}
    for band, node, code in rows_of(chosen.to_batches()):
        found[band].append((node, code))
    return {
        b: (np.array([n for n, _ in own], np.int64), np.frombuffer(b"".join(c for _, c in own), np.uint8).reshape(len(own), -1))
        for b, own in sorted(found.items())
        if own
    }


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id long, rank int, vec_id long, score double``: for each row that ``is_query`` selects the
    ``k`` rows of largest inner product found, itself left out, ties to the smaller id.

    Rows whose id or vector is null, whose vector is zero, holds null or non-finite components or has not
    the length of most take no part. Rows alike in id and vector count once; rows of equal vectors share a
    node and all of them can be found. With ``k`` or fewer other rows all are returned as far as the graph
    links them; other columns are ignored; an empty table gives an empty result.
    """
    rows = stage(clean(vectors, id_col, vector_col))

    def measuring(batches):
        for batch in batches:
            if batch.num_rows:
                lengths = log_lengths(np.array(batch.column(0).to_pylist(), float))
                # Unit vectors are in the middle of their band.
                bands = pa.array(np.floor(lengths + 0.5).astype(np.int32))
                yield pa.record_batch([*batch.columns, pa.array(lengths), bands], ["vector", "node", "length", "band"])

    distinct = rows.groupBy("vector").agg(F.min("id").alias("node"))
    classes = stage(distinct.mapInArrow(measuring, "vector array<double>, node long, length double, band int"))
    # A double has about 2,100 exponents, so there are at most so many bands.
    bands = {r.band: (r.top, r.n) for r in classes.groupBy("band").agg(F.max("length").alias("top"), F.count("*").alias("n")).collect()}
    count = sum(n for _, n in bands.values())
    # Of equal vectors only the k + 1 smallest ids can be answers. A salt keeps a common vector in many tasks.
    salted = rows.join(classes, "vector").select("node", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    for keys in (["node", "salt"], ["node"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        salted = salted.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    members = stage(salted.select("node", F.col("id").alias("member")))

    def coding(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                part = batch.slice(start, 5000)
                points = np.array(part.column(1).to_pylist(), float)
                top = np.array([bands[b][0] for b in part.column(2).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(encode(points, top), pa.binary()), part.column(2)], ["node", "code", "band"])

    nodes = stage(classes.select("node", "vector", "band").mapInArrow(coding, "node long, code binary, band int"))
    firsts = first_looks(nodes, {b: n for b, (_, n) in bands.items()})
    graph = build(nodes, count)
    parts = parts_for(count)
    table = walkable(graph, parts)
    asking = rows.where(is_query(F.col("id"))).join(classes, "vector").select(F.col("id").alias("query"), "node", "vector")

    def starting(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                queries, own, codes, homes = (c.to_pylist() for c in part.columns)
                points, out = bare(codes), []
                for band, (ids, raw) in firsts.items():
                    # A band of which all nodes are here needs no walk.
                    whole = len(ids) == bands[band][1]
                    for k, sims in enumerate(products(raw, points).T):
                        names = ids
                        if homes[k] == band:
                            # The query's own node heads the beam; other rows may share it.
                            names, sims = np.append(own[k], ids), np.append(np.float32(np.inf), sims)
                        found, near = nearest(names, sims, BEAM if whole else START)
                        out.append((queries[k], band, codes[k], found.tobytes(), near.astype(np.float32).tobytes(), bytes([whole]) * len(found)))
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), STATE_ARROW, strict=True)], schema=STATE_ARROW)

    begun = asking.select("query", "node").join(nodes, "node").select("query", "node", "code", "band")
    states = stage(begun.mapInArrow(starting, STATE))
    while True:
        states = stage(walked(states, table, parts))
        # A byte 0 marks a node of a beam that is not open yet.
        if states.where(F.instr(F.hex("opened"), "00") % 2 == 1).limit(1).count() == 0:
            break

    def listing(batches):
        for query, _, _, ids, _, _ in rows_of(batches):
            ids = np.frombuffer(ids, np.int64)[:RESCORED]
            yield pa.record_batch([pa.array([query] * len(ids), pa.int64()), pa.array(ids)], ["query", "node"])

    pairs = states.mapInArrow(listing, "query long, node long")
    own = asking.select("query", F.col("vector").alias("mine"))
    dot = F.aggregate(F.zip_with("mine", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(classes, "node").join(own, "query").select("query", "node", dot.alias("score"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("place") <= k + 1)
    named_rows = best.join(members, "node").where("member != query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "member"))
    return (
        named_rows.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")
    )
