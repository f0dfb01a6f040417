"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns; its name is a chained digest of them, so that equal prefixes of any
conversations meet by name.  Turns are put in order by ranges, not by conversation, so that a conversation of any
length is shared among tasks; it is then handled in blocks of `block` turns, whose digests are chained in a second, a
thousand times smaller step.

Of the children of a node the one with most members (then with the smallest id) is heavy, and the nodes from a light one down along
heavy children are a path, so that a way to the root crosses at most log2(conversations) light edges.  A node finds
its path's top inside its block of its conversation, and blocks find theirs by pointer jumping along heavy edges.
Each path is an array of its nodes' own values, kept in blocks.  In every round the paths whose light children are all done hand
their total to the node that they hang from; after at most log2(conversations) + 1 rounds all have.  In the end
suffix sums along each path give every node the sum over its subtree.  All lookups on the way join unique keys, and all groups are summed before
they are shuffled, so a turn that begins a third of all conversations loads no task.

Defined results: rows without a conversation id belong to none; a null role or text is empty; a null turn comes
first; rows of one turn follow each other by the digest of role and text, repeated rows are turns of their own; very long texts are
only digested; a conversation without turns is a member of the root; of an empty table there is no node; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtools import forget, released, small_side, written

BLOCK = 1024
#: The most bytes of ids that one row of a node's list of ends holds.
CHUNK = 1 << 16
ROOT = b""


def ordered(turns: DataFrame, *, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, size): every turn with its place in its conversation, from 1."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(filled(role)).cast("string"), F.lit(":"), filled(role), filled(text))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.unhex(F.substring(F.sha2(framed, 256), 1, 32)).alias("digest"), F.octet_length(filled(text)).cast("bigint").alias("size"),
    )
    # Rows that are equal in all of this are dealt by what they were read as: their order doesn't matter.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        last, n = None, 0
        for batch in batches:
            out = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if conv == last else 1
                last = conv
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), *batch.columns[1:]], names=["conv", "n", "part", "digest", "size"])

    cut = written(dealt.select("conv", F.spark_partition_id().alias("part"), "digest", "size").mapInArrow(number, "conv bigint, n bigint, part int, digest binary, size bigint"), "turns")
    # Only a conversation that goes on in a later partition needs an offset: it is the last of one and the first of the next.
    edges = cut.groupBy("part").agg(F.min("conv").alias("a"), F.max("conv").alias("z"))
    shared = edges.select(F.explode(F.array("a", "z")).alias("conv"), "part").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("conv")
    pieces = cut.join(F.broadcast(shared), "conv").groupBy("conv", "part").agg(F.count(F.lit(1)).alias("m"))  # two rows a partition at most
    before = F.coalesce(F.sum("m").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(pieces.withColumn("before", before).select("conv", "part", "before"), "offsets")
    out = cut.join(small_side(offsets), ["conv", "part"], "left").select("conv", (F.col("n") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "size")
    out.read_from = (cut, offsets)
    return out


def chained(start: bytes, digests) -> list[bytes]:
    """The digest of each prefix."""
    out = []
    for d in digests:
        start = hashlib.blake2b(start + d, digest_size=16).digest()
        out.append(start)
    return out


def rebuilt(turns: DataFrame, *, group: int, cuts: int, block: int) -> DataFrame:
    """(conv, blk, digests, sizes): each rebuilt conversation in blocks of its depth; one without turns has one empty block.

    The first h turns come from the conversation conv - conv % group (h: crc32 of the id modulo cuts), the rest are its own."""
    item = F.struct("pos", "digest", "size")
    heads = turns.filter((F.col("conv") % group == 0) & (F.col("pos") < cuts)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(item)).alias("head"))
    own = turns.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("blk")).agg(F.sort_array(F.collect_list(item)).alias("own"))
    own = own.withColumn("base", F.col("conv") - F.col("conv") % group).join(heads, "base", "left")
    own = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % cuts).withColumn("head", F.slice(F.coalesce("head", F.slice("own", 1, 0)), 1, F.col("h").cast("int")))
    items = F.concat(F.when(F.col("blk") == 0, F.col("head")).otherwise(F.slice("own", 1, 0)), F.filter("own", lambda x: x["pos"] > F.col("h")))
    # How far the own turns move: the depth of one is its place less h plus the length of the head.
    own = own.withColumn("items", items).withColumn("moved", F.size("head") - F.col("h")).withColumn("first", F.size("own"))
    short = (F.col("blk") == 0) & (F.col("first") <= block - cuts)
    one = own.filter(short).select("conv", "blk", "items")
    depth = F.when((F.col("blk") == 0) & (F.col("k") < F.size("head")), F.col("k") + 1).otherwise(F.col("x.pos") + F.col("moved"))
    long = own.filter(~short).select("conv", "blk", "head", "moved", F.posexplode("items").alias("k", "x")).select("conv", depth.alias("pos"), "x.digest", "x.size")
    more = long.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("blk")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return one.unionByName(more).select("conv", "blk", F.col("items.digest").alias("digests"), F.col("items.size").alias("sizes"))


def memberships(turns: DataFrame, *, group: int, cuts: int, block: int) -> DataFrame:
    """(conv, depth, node, parent, size, ends): each rebuilt conversation's nodes, the root included.

    A node that fills a block is named by the chain over whole blocks, any other by the chain from the block's start."""
    rows = written(rebuilt(turns, group=group, cuts=cuts, block=block), "blocks")

    def whole(batches):
        for batch in batches:
            out = [chained(b"block", d)[-1] if len(d) == block else None for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["conv", "blk", "digest"])

    def starts(batches):
        held = None
        for batch in batches:
            out = []
            for conv, blk, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if held:
                    out.append((*held, held[0] != conv))
                state = held[3] if held and held[0] == conv else ROOT
                held = (conv, blk, state, hashlib.blake2b(b"blocks" + state + digest, digest_size=16).digest() if digest else None)
            yield table(out, STARTS)
        if held:
            yield table([(*held, True)], STARTS)

    long = written(rows.filter((F.col("blk") > 0) | (F.size("digests") == block)).select("conv").distinct(), "long")
    full = rows.join(small_side(long), "conv", "left_semi").select("conv", "blk", "digests").mapInArrow(whole, "conv bigint, blk bigint, digest binary")
    begun = written(full.repartition("conv").sortWithinPartitions("conv", "blk").mapInArrow(starts, "conv bigint, blk bigint, start binary, next binary, last boolean"), "starts")

    def nodes(batches):
        for batch in batches:
            out = []
            for conv, blk, digests, sizes, start, following, last in zip(*(c.to_pylist() for c in batch.columns)):
                if blk == 0:
                    out.append((conv, 0, ROOT, None, 0, not digests))
                before = start or ROOT
                for k, (node, size) in enumerate(zip(chained(before, digests), sizes), 1):
                    node = following if k == block else node
                    out.append((conv, blk * block + k, node, before, size, k == len(digests) and last is not False))
                    before = node
            yield table(out, NODES)

    found = rows.join(small_side(begun), ["conv", "blk"], "left").select("conv", "blk", "digests", "sizes", "start", "next", "last")
    made = written(found.mapInArrow(released(nodes), "conv bigint, depth bigint, node binary, parent binary, size bigint, ends boolean"), "members")
    forget(rows, long, begun)
    return made


STARTS = {"conv": pa.int64(), "blk": pa.int64(), "start": pa.binary(), "next": pa.binary(), "last": pa.bool_()}
NODES = {"conv": pa.int64(), "depth": pa.int64(), "node": pa.binary(), "parent": pa.binary(), "size": pa.int64(), "ends": pa.bool_()}
CHUNKS = {"node": pa.binary(), "first": pa.int64(), "ids": pa.string()}
HASHES = {"node": pa.binary(), "ends_sha256": pa.string()}


def table(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds.values())], names=list(kinds))


def tops(nodes: DataFrame, block: int) -> DataFrame:
    """(node, top): the node that begins each node's path.  nodes: node, parent, conv, depth, heavy."""
    units = nodes.groupBy("conv", F.floor(F.col("depth") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("depth", "node", "parent", "heavy"))).alias("nodes"))

    def local(batches):
        for batch in batches:
            node, top, up = [], [], []
            for items in batch.column(0).to_pylist():
                # A unit's nodes follow one another; until its first light node it hangs from the parent of its first.
                mine, above = None, items[0]["parent"]
                for x in items:
                    mine = mine if x["heavy"] else x["node"]
                    node.append(x["node"]), top.append(mine), up.append(None if mine is not None else above)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (node, top, up)], names=["node", "top", "up"])

    at = written(units.select("nodes").mapInArrow(local, "node binary, top binary, up binary"), "tops")
    # Units without a light node at their start wait for the top of the node above; every round doubles how far they look.
    wait = at.filter("top IS NULL").select(F.col("up").alias("node")).distinct()
    aims = written(at.join(wait, "node").select(F.col("node").alias("up"), F.col("top").alias("t"), F.col("up").alias("u")), "aims")
    while not aims.filter("t IS NULL").isEmpty():
        over = aims.select(F.col("up").alias("u"), F.col("t").alias("t2"), F.col("u").alias("u2"))
        fresh = written(aims.filter("t IS NOT NULL").unionByName(aims.filter("t IS NULL").join(over, "u").select("up", F.col("t2").alias("t"), F.col("u2").alias("u"))), "aims")
        forget(aims)
        aims = fresh
    seen = at.filter("top IS NULL").drop("top").join(aims.select("up", F.col("t").alias("top")), "up").select("node", "top")
    return at.filter("top IS NOT NULL").select("node", "top").unionByName(seen)


def light_sums(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved): what light children hand to each node, in rounds.  nodes: node, parent, top, light, leaf, own."""
    paths = nodes.groupBy("top").agg(
        F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"), F.sum("light").alias("pending"),
        F.max(F.when(F.col("node") == F.col("top"), F.col("parent"))).alias("hangs"),
    )
    paths = written(paths, "paths")
    forks = written(nodes.filter("light > 0").select("node", F.col("top").alias("of")), "forks")
    given = []
    while True:
        ready = paths.filter("pending = 0 AND hangs IS NOT NULL").groupBy(F.col("hangs").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n"))
        ready = written(ready, "given")
        if ready.isEmpty():
            break
        given.append(ready)
        to = ready.join(forks, "node").groupBy(F.col("of").alias("top")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("k"))
        fresh = written(paths.filter("pending > 0").join(to, "top", "left").select(
            "top", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("pending") - F.coalesce("k", F.lit(0))).alias("pending"), "hangs"
        ), "paths")
        forget(paths)
        paths = fresh
    out = ready.select("node", "leaves", "saved")
    for g in given:
        out = out.unionByName(g.select("node", "leaves", "saved"))
    return out.groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def suffix_sums(nodes: DataFrame, block: int) -> DataFrame:
    """nodes with leaves and saved summed from each node down its path, by blocks of the path's array."""
    blk = F.floor(F.col("depth") / block)
    parts = nodes.groupBy("top", blk.alias("blk")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    below = W.partitionBy("top").orderBy(F.desc("blk")).rowsBetween(W.unboundedPreceding, -1)
    rest = parts.select("top", "blk", F.coalesce(F.sum("l").over(below), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("s"))
    down = W.partitionBy("top", "blk").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    inside = nodes.withColumn("blk", blk).withColumns({"leaves": F.sum("leaves").over(down), "saved": F.sum("saved").over(down)})
    # Most paths are one block, whose nodes have nothing below it.
    rest = small_side(written(rest.filter("l > 0 OR s <> 0"), "below"))
    return inside.join(rest, ["top", "blk"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("blk", "l", "s")


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes that conversations end at: the ids are joined in parallel, a chunk a row, and the chunks are read in their order."""
    found = members.filter("ends").select("node", "conv")

    def joined(batches):
        node, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (at != node or size > CHUNK):
                    out.append((node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = at, conv
                held.append(str(conv))
                size += 1 + len(held[-1])
            yield table(out, CHUNKS)
        if held:
            yield table([(node, first, ",".join(held))], CHUNKS)

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if at == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256(ids.encode())
            yield table(out, HASHES)
        if state:
            yield table([(node, state.hexdigest())], HASHES)

    chunks = found.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(joined, "node binary, first bigint, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 5, cuts: int = 9, block: int = BLOCK) -> DataFrame:
    """A row for each node: node, parent (both names), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    if block < 2 * cuts:
        raise ValueError("a block holds at least twice as many turns as are ever taken over")
    turns = ordered(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    members = memberships(turns, group=group, cuts=cuts, block=block)
    forget(*turns.read_from)
    nodes = members.groupBy("node").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size")
    )
    nodes = written(nodes, "nodes")
    kids = written(nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(
        F.count(F.lit(1)).alias("n_children"), F.max_by("node", F.struct("n_convs", F.bitwise_not("conv"))).alias("child")
    ), "kids")
    flagged = nodes.join(kids.select("child"), nodes["node"] == F.col("child"), "left").withColumn("heavy", F.col("child").isNotNull()).drop("child")
    flagged = written(flagged.join(kids.select(F.col("of").alias("node"), "n_children"), "node", "left").fillna(0, ["n_children"]), "flagged")
    known = written(flagged.join(tops(flagged, block), "node").select(
        "*", F.greatest(F.col("n_children") - 1, F.lit(0)).alias("light"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"),
    ), "known")
    forget(nodes, kids, flagged)
    summed = suffix_sums(known.join(light_sums(known), "node", "left").withColumns({
        "leaves": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("own") + F.coalesce("more_saved", F.lit(0)),
    }), block)
    return (
        with_parents(summed, known).join(ends(members), "node", "left")
        .select("node", "parent", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )


def with_parents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with the smallest member of each node's parent.  Parents of a thousandth of all nodes or more are a thousand at
    most and are broadcast; the children of all others are joined by key."""
    many = known.filter(F.col("n_children") >= max(2, known.count() // 1000))
    names = lambda df: df.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    wide = rows.join(F.broadcast(names(many)), "parent")
    rest = rows.join(F.broadcast(names(many)), "parent", "left_anti").join(names(known), "parent", "left")
    return wide.unionByName(rest)


def op11(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")).drop("node", "parent")


SQL = """
WITH t AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT conv_id AS conv, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv, list({'d': digest, 's': size} ORDER BY turn NULLS FIRST, digest) AS own FROM o GROUP BY conv),
h AS (SELECT conv, own, xor(list_reduce(list_transform(range(1, length(CAST(conv AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(conv AS VARCHAR)[k]) AS BIGINT)),
  lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 9 AS h FROM l, t),
r AS (SELECT h.conv, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1 : h] END, h.own[h + 1 :]) AS turns FROM h LEFT JOIN l b ON b.conv = h.conv - h.conv % 5),
m AS (SELECT conv, d, len(turns) AS n, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1 : d], lambda x: x.d), ',')) ELSE '' END AS node,
  CASE WHEN d > 1 THEN sha256(array_to_string(list_transform(turns[1 : d - 1], lambda x: x.d), ',')) WHEN d = 1 THEN '' END AS parent, CASE WHEN d > 0 THEN turns[d].s ELSE 0 END AS size
  FROM (SELECT conv, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT node, min(conv) AS conv, max(d) AS depth, max(parent) AS parent, count(*) AS n_convs, max(size) AS size, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (d = n) AS ends FROM m GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT m.node, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved FROM n LEFT JOIN k ON k.node = n.node JOIN m ON m.conv = n.conv AND m.d <= n.depth GROUP BY m.node)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN u ON u.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n p ON p.node = n.parent
"""
