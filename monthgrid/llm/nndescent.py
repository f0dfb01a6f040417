"""Embedding near-dedup by NN-descent.

Vectors are compared within their label only.  Equal vectors are one node with a weight.  The neighbour graph
starts from buckets of random-hyperplane codes (buckets over `bucket` rows are split at random), keeps the
`k` nearest of each node, and is refined by local joins: the neighbours of a node, either way, are compared
with one another, for as long as a round joins components.  Only edges of cosine `walk` or more are
walked: two edges at the threshold of 0.93 can't join nodes further apart than that.  Components don't depend on
the cut to k: of all threshold edges that any bucket or local join sees, a spanning forest is kept (`tree`), at most
one edge a row.  A list holds k nodes of its own component and, so that a saturated list still leads out of a dense
group, k more of as many other components, the nearest of each.  A list whose k nodes are all within the threshold is
saturated: it may hide further links, so it is doubled with every round, up to `enlarge` times k.  In the end a
node is compared with its whole component, tile by tile, so that counts are whole although only counts leave a tile.

Recall is audited for the labels of each code length by themselves (labels of one bucket are compared whole).  Random
nodes, `audit` of them at first, are compared with all rows of their label until `evidence` of them have a true link
or no node is left.  While less than `recall` of those links, or of the nodes that have some, were found, `tables`
more codes are drawn; after the fourth time all nodes that are left are compared.  Links that an audit finds are
used.  So few or no links make the audit, and a recall that stays low the last step, a comparison of whole labels.

Defined results: null, empty, zero or non-finite vectors, and vectors of a null label, link with nothing;
vectors of different lengths under one label are never compared; repeated ids are rows of their own; of equal
cosines a list takes the least ids; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtools import small_side, written
from .components import components

THRESHOLD, WALK, K, ENLARGE, TABLES, BUCKET = 0.93, 0.7, 8, 4, 8, 1024
#: The most bytes of audited vectors that are sent to the executors at once.
AUDIT_BYTES = 16 << 20
EDGE = "a bigint, b bigint, cos double, tree boolean"


def prepared(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, vec): vec is the unit vector's doubles as bytes, null where the row links with nothing."""

    def run(batches):
        for batch in batches:
            units = []
            for v, lab in zip(batch.column(2), batch.column(1)):
                x = None if not v.is_valid or not lab.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max() if x is not None else 0
                if x is None or not np.isfinite(x).all() or not top > 0:
                    units.append(None)
                    continue
                x = x / top
                units.append((x / np.linalg.norm(x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["id", "label", "vec"])

    read = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return read.mapInArrow(run, "id bigint, label string, vec binary")


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def sized(nodes: DataFrame, bucket: int) -> DataFrame:
    """nodes with the bytes of the vector and the bits of its label's codes: 0 where the label fits into one bucket."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / (bucket / 8)))).cast("bigint")
    sizes = nodes.groupBy(F.col("label").alias("of"), F.octet_length("vec").alias("bytes")).agg(bits.alias("bits"))
    return nodes.join(small_side(sizes), (F.col("label") == F.col("of")) & (F.octet_length("vec") == F.col("bytes"))).drop("of")


def coded(nodes: DataFrame, tables: int, first: int, bucket: int, seed: int) -> DataFrame:
    """(table, label, code, salt, node, vec): every node under one code for each table."""

    def run(batches):
        for batch in batches:
            for wide in set(batch.column(3).to_pylist()):
                part = batch.filter(pa.array([w == wide for w in batch.column(3).to_pylist()]))
                x, bits = matrix(part.column(2)), part.column(4).to_numpy()
                for t in range(first, first + tables):
                    planes = np.random.default_rng(seed * 1000 + t).normal(size=(x.shape[1], 40))
                    on = (x @ planes > 0).astype(np.int64) << np.arange(40)
                    code = (on.sum(axis=1)) & ((np.int64(1) << np.minimum(bits, 40)) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t)), part.column(1), part.column(3), pa.array(code), part.column(0), part.column(2)],
                        names=["t", "label", "bytes", "code", "node", "vec"],
                    )

    rows = nodes.select("node", "label", "vec", "bytes", "bits").mapInArrow(run, "t bigint, label string, bytes int, code bigint, node bigint, vec binary")
    key = ["t", "label", "bytes", "code"]
    full = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
    parts = F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1))
    return rows.join(full, key, "left").select(*key, F.pmod(F.xxhash64("node", "t"), parts).alias("salt"), "node", "vec")


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The component of each row by a boolean matrix of links, and the two ends of a spanning forest's edges."""
    of, seen, a, b = np.arange(len(near)), np.zeros(len(near), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for root in np.flatnonzero(near.any(axis=1)):
        front = np.empty(0, np.int64) if seen[root] else np.array([root])
        seen[root] = True
        while len(front):
            reach = near[front]
            new = np.flatnonzero(reach.any(axis=0) & ~seen)
            a.append(new)
            b.append(front[reach[:, new].argmax(axis=0)])
            of[new], seen[new], front = root, True, new
    return of, np.concatenate(a), np.concatenate(b)


def best(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, from `WALK` on."""
    k = min(k, cos.shape[1])
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k].ravel()
    a = np.repeat(np.arange(len(cos)), k)
    good = cos[a, top] >= WALK
    return a[good], top[good]


def nearest(table: pa.Table, k: int, threshold: float) -> pa.Table:
    """Among the rows of one bucket: the k nearest of each node, the k nearest of other components (the nearest of
    each), and a spanning forest of all threshold edges."""
    x, ids = matrix(table.column("vec")), table.column("node").to_numpy()
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    of, *ends = forest(cos >= threshold)
    pairs = [best(cos, k)]
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    if 1 < len(starts) < len(ids):
        out = np.where(of[:, None] == of[order], -2, cos[:, order])
        top = np.maximum.reduceat(out, starts, axis=1)
        first = out == np.repeat(top, np.diff(starts, append=len(ids)), axis=1)
        at = np.minimum.reduceat(np.where(first, np.arange(len(ids)), len(ids)), starts, axis=1)
        a, c = best(top, k)
        pairs.append((a, order[at[a, c]]))
    a, b = (np.concatenate([*side, end]) for side, end in zip(zip(*pairs), ends))
    return pa.table({"a": ids[a], "b": ids[b], "cos": cos[a, b], "tree": np.arange(len(a)) >= len(a) - len(ends[0])})


def placed(edges: DataFrame, label_of: DataFrame) -> DataFrame:
    """edges with the components of both ends, as la and lb; a node without a link is its own."""
    for end in "ab":
        known = label_of.select(F.col("node").alias(end), F.col("label").alias("__l"))
        edges = edges.join(small_side(known), end, "left").withColumn(f"l{end}", F.coalesce("__l", end)).drop("__l")
    return edges


def listed(k: int, most: int, threshold: float):
    """Whether the place r is in a list: among the first k, or among `most` while all before it are links."""
    return (F.col("r") <= k) | ((F.col("r") <= most) & (F.col("cos") >= threshold))


def kept(edges: DataFrame, k: int, most: int, threshold: float, label_of: DataFrame) -> DataFrame:
    """(a, b, cos, inside), over both directions of the edges found: the k nearest of each node in its own component
    (`most` of a saturated list), and k of others, the nearest of each."""
    both = edges.select("a", "b", "cos").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    by = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.col("cos").desc(), "b"))
    each = placed(both, label_of).withColumn("inside", F.col("la") == F.col("lb")).withColumn("r", by("a", "lb")).filter("inside or r = 1")
    return each.withColumn("r", by("a", "inside")).filter(listed(k, most, threshold)).select("a", "b", "cos", "inside")


def descend(edges: DataFrame, nodes: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """One round of local joins: what the neighbours of every node find among one another."""
    mid = edges.select(F.col("a").alias("mid"), F.col("b").alias("node"))
    # As many each way: those that a node chose, and of those that chose it the nearest inside and outside.
    chose = edges.withColumn("r", F.row_number().over(W.partitionBy("b", "inside").orderBy(F.col("cos").desc(), "a"))).filter(listed(k, most, threshold))
    around = mid.unionByName(chose.select(F.col("b").alias("mid"), F.col("a").alias("node"))).distinct()
    return around.join(nodes.select("node", "vec"), "node").groupBy("mid").applyInArrow(lambda t: nearest(t, k, threshold), EDGE)


def near_duplicates(
    rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    k: int = K, enlarge: int = ENLARGE, tables: int = TABLES, bucket: int = BUCKET, audit: int = 200, evidence: int = 200, recall: float = 0.98, seed: int = 1,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    every = written(prepared(rows, vec_id, embedding, label), "vectors")
    able = every.filter(F.col("vec").isNotNull())
    nodes = written(able.groupBy("label", "vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")), "nodes")
    nodes = written(sized(nodes, bucket), "sized")
    # For each code length, the number of nodes and the share of them that were audited.
    left = {r.bits: [r.n, 0.0] for r in nodes.filter("bits > 0").groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}
    repairs: list = []
    edges = trees = nodes.sparkSession.createDataFrame([], EDGE)
    first = 0
    while True:
        started = coded(nodes, tables, first, bucket, seed).groupBy("t", "label", "bytes", "code", "salt").applyInArrow(lambda t: nearest(t, k, threshold), EDGE)
        fresh = written(started, "found")
        # Each round but the last joins components, so the rounds end.
        most = k
        while True:
            trees = trees.unionByName(fresh.filter("tree"))
            label_of = components(trees)
            edges = written(kept(edges.select("a", "b", "cos").unionByName(fresh.select("a", "b", "cos")), k, most, threshold, label_of), "graph")
            fresh = written(descend(edges, nodes, k, most, threshold), "found")
            most = min(2 * most, enlarge * k)
            if not placed(fresh.filter("tree"), label_of).filter("la <> lb").limit(1).count():
                break
        first += tables
        placed_nodes = written(nodes.filter("bits > 0").join(label_of, "node", "left").select("node", nodes["label"], "vec", "weight", "bytes", "bits", F.coalesce(label_of["label"], "node").alias("least")), "placed")
        low = audited(placed_nodes, repairs, left, threshold, audit, evidence, recall, seed)
        if low and first >= 4 * tables:
            audited(placed_nodes, repairs, low, threshold, max(n for n, _ in low.values()), float("inf"), recall, seed)
        left = low
        if not left or first >= 4 * tables:
            break
    for found in repairs:
        trees = trees.unionByName(found, allowMissingColumns=True)
    label_of = components(trees) if repairs else label_of
    links = linked(nodes, label_of, threshold, bucket)
    named = nodes.join(links, "node", "left").join(label_of.withColumnRenamed("label", "least"), "node", "left")
    named = named.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "node").alias("least"))
    mine = every.join(named, ["label", "vec"], "left")
    component = F.coalesce("least", "id")
    return mine.select(
        F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )


def linked(nodes: DataFrame, label_of: DataFrame, threshold: float, bucket: int) -> DataFrame:
    """(node, n): the rows of other vectors within the threshold, counted over each component tile by tile."""
    sizes = label_of.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / bucket)
    inside = label_of.join(sizes, "label").select("node", F.col("label").alias("least"), parts.alias("parts"))
    inside = inside.join(nodes.select("node", "vec", "weight"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    sides = F.expr("transform(sequence(0, parts - 1), i -> struct(own as p, i as q, true as asks))")
    asked = F.expr("transform(sequence(0, parts - 1), i -> struct(i as p, own as q, false as asks))")
    tiles = inside.select("least", "node", "weight", "vec", F.explode(F.concat(sides, asked)).alias("x")).select("least", "x.p", "x.q", "x.asks", "node", "weight", "vec")

    def count(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        x, ids, w = matrix(table.column("vec")), table.column("node").to_numpy(), table.column("weight").to_numpy()
        near = (x[asks] @ x[~asks].T) >= threshold
        near &= ids[asks][:, None] != ids[~asks][None, :]
        return pa.table({"node": ids[asks], "n": (near * w[~asks]).sum(axis=1).astype(np.int64)})

    return tiles.groupBy("least", "p", "q").applyInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))


def audited(nodes: DataFrame, repairs: list, left: dict, threshold: float, sample: int, evidence: float, recall: float, seed: int) -> dict:
    """Those of `left` whose recall is too low and that have nodes left; what they have audited moves on, and links
    between components are added to `repairs`."""
    at = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    going, seen = dict(left), {bits: np.empty((0, 2), np.int64) for bits in left}
    most = AUDIT_BYTES // (nodes.agg(F.max("bytes")).first()[0] or 1) if left else 0
    while going:
        drawn = F.lit(False)
        for bits, span in going.items():
            lo, span[1] = span[1], span[1] + max(1, min(sample, most // len(going))) / span[0]
            drawn = drawn | ((F.col("bits") == bits) & (at >= lo) & (at < span[1]))
        found = written(compared(nodes.filter(F.col("bits").isin(list(going))), nodes.filter(drawn), threshold), "audit")
        for r in found.filter("b is null").groupBy("bits", "a").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).collect():
            seen[r.bits] = np.append(seen[r.bits], [[r.n, r.lost]], axis=0)
        pairs = found.filter("b is not null").select("a", "b")
        if pairs.limit(1).count():
            repairs.append(pairs)
        going = {bits: span for bits, span in going.items() if span[1] < 1 and len(seen[bits]) < evidence}
        sample *= 2
    share = lambda x: min(1 - x[:, 1].sum() / x[:, 0].sum(), (x[:, 1] == 0).mean())
    return {bits: span for bits, span in left.items() if span[1] < 1 and share(seen[bits]) < recall}


def compared(nodes: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """For each drawn node with a link, the rows it links with and those of them in other components (b null); and
    links with other components, one a component and batch."""
    by: dict = {}
    for r in drawn.select("node", "label", "vec", "least", "bits").collect():
        by.setdefault((r.label, len(r.vec)), []).append(r)
    asked = {key: (np.array([r.node for r in rs]), np.array([r.least for r in rs]), rs[0].bits, np.frombuffer(b"".join(bytes(r.vec) for r in rs)).reshape(len(rs), -1)) for key, rs in by.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(asked)
    names = ["bits", "a", "b", "n", "lost"]

    def run(batches):
        total: dict = {}
        for batch in batches:
            where: dict = {}
            for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist())):
                if key in shared.value:
                    where.setdefault(key, []).append(i)
            for key, rows in where.items():
                own, of, bits, x = shared.value[key]
                sums = total.setdefault(key, np.zeros((2, len(own)), np.int64))
                step = max(1, (1 << 22) // len(own))
                for s in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[s : s + step]))
                    ids, w, least = (part.column(c).to_numpy() for c in (0, 3, 4))
                    near = (matrix(part.column(2)) @ x.T >= threshold) & (ids[:, None] != own)
                    i, j = near.nonzero()
                    np.add.at(sums[0], j, w[i])
                    lost = least[i] != of[j]
                    i, j = i[lost], j[lost]
                    np.add.at(sums[1], j, w[i])
                    if len(i):
                        one = np.unique(np.stack((least[i], j)), axis=1, return_index=True)[1]
                        zero = np.zeros(len(one), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(zero + bits), pa.array(own[j[one]]), pa.array(ids[i[one]]), pa.array(zero), pa.array(zero)], names=names)
        for key, (n, lost) in total.items():
            own, _, bits, _ = shared.value[key]
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), bits)), pa.array(own[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some]), pa.array(lost[some])], names=names)

    return nodes.select("node", "label", "vec", "weight", "least", "bytes").mapInArrow(run, "bits bigint, a bigint, b bigint, n bigint, lost bigint")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT m.vec_id, coalesce(n, 0) AS n_links, component_id, m.vec_id = component_id AS kept
FROM embeddings m LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a) USING (vec_id)
JOIN (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id) USING (vec_id)
"""
