"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier are removed.

The rule, by longest-previous-factor arrays: with all suffixes of the corpus in order, the previous and the next
entries that start earlier (in the order of document ids, then of starts) hold the longest earlier match of a
suffix; where it reaches `length`, the suffix's first `length` bytes go.  Matches are followed up to `length` bytes.

To keep every array small, suffixes that may be equal are first brought together.  Each window of `length` bytes
names an anchor, its least 32-gram by hash, so equal windows name equal anchors.  Anchors seen once in the corpus
are dropped; the others send the text that their windows span to a block.  Each block sorts its suffixes by prefix
doubling, finds previous and next smaller positions, takes the longest previous factors from them by the ranks of
each doubling, and removes what factors of full length cover.  An anchor of more than `most` occurrences is spread over several blocks by document; windows
that come first in such a block are compared once more across blocks, grouped by their bytes.

Defined results: null is an empty text; texts under `length` bytes lose nothing; rows that repeat an id are documents
of their own, in the order of their texts; rows without an id lose nothing and take nothing from others; matches
are judged on the input; of equal strings the first (by id, then by place) stays; very long texts are judged whole, like any other;
kept bytes may cut a character, so they are binary; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import in_slices, mix64, released, small_batches, small_side, texts, written

LENGTH, GRAM, MOST, BLOCK = 100, 32, 20_000, 3 << 20
C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
HIGH = np.uint64(0xFFFFFFFF00000000)


def anchors(text: bytes, length: int = LENGTH, chunk: int = 1 << 20):
    """(hash, position, first window, last window) of the anchors of a text's windows, as arrays."""
    found, w = [], length - GRAM + 1
    for s in range(0, len(text) - length + 1, chunk):
        part = text[s : s + chunk + length - 1]
        n = len(part) - GRAM + 1
        u = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,))
        x = u[:n] * C[0] + u[8 : 8 + n] * C[1]
        x ^= x >> np.uint64(32)
        x *= C[2]
        x += u[16 : 16 + n] * C[3]
        x ^= x >> np.uint64(29)
        x *= C[0]
        x += u[24 : 24 + n] * C[1]
        x ^= x >> np.uint64(32)
        x *= C[2]
        x ^= x >> np.uint64(29)
        m, have = (x & HIGH) | np.arange(n, dtype=np.uint64), 1
        while 2 * have <= w:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < w:
            m = np.minimum(m[: have - w], m[w - have :])
        at = (m & ~HIGH).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
        p = at[lo]
        found.append((x[p].view(np.int64), p + s, lo + s, hi + s))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found))


def ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, 32 ... and at last `length` (8 or more) bytes, by prefix doubling."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ndarray((len(text),), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)
    rank, have = dense(key), 8
    levels = [(have, rank.astype(np.uint32))]
    while have < length:
        step = min(have, length - have)
        after = np.zeros(len(rank), np.uint64)
        after[: len(rank) - step] = rank[step:] + np.uint64(1)
        rank, have = dense(rank << np.uint64(32) | after), have + step
        levels.append((have, rank.astype(np.uint32)))
    return levels


def dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    line = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([0], line[1:] != line[:-1]))).astype(np.uint64)
    return rank


def smaller_before(p: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it that is smaller, or -1: all entries follow pointers at once, and an
    entry that is still too large hands its own pointer on."""
    p = np.concatenate(([-1], p))
    to = np.arange(len(p)) - 1
    to[0] = 0
    left = np.arange(1, len(p))
    while len(left := left[p[to[left]] > p[left]]):
        to[left] = to[to[left]]
    return to[1:] - 1


def common_lengths(text: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, up to the longest that was ranked."""
    length, rank = levels[-1]
    out = np.full(len(a), length)
    left = np.flatnonzero(rank[a] != rank[b])
    at = np.zeros(len(left), np.int64)
    for size, rank in levels[-2::-1]:
        x, y = a[left] + at, b[left] + at
        inside = (x < len(rank)) & (y < len(rank))
        at[inside] += np.where(rank[x[inside]] == rank[y[inside]], size, 0)
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8)))
    key = np.ndarray((len(text) + length,), ">u8", padded.tobytes(), 0, (1,))
    x = key[a[left] + at].astype(np.uint64) ^ key[b[left] + at].astype(np.uint64)
    high, low = (np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] for v in (x >> np.uint64(32), x))
    zeros = np.where(high > 0, 32 - high, 64 - low)
    out[left] = np.minimum(at + zeros // 8, length)
    return out


def previous_factors(text: np.ndarray, starts: np.ndarray, length: int, shorter: bool = True) -> np.ndarray:
    """The longest-previous-factor array of some suffixes, cut at `length`: the most bytes that each has in common with
    one that comes before it in `starts`.  From previous and next smaller positions in suffix order.  Without
    `shorter`, factors under `length` aren't measured and stand as 0."""
    levels = ranks(text, length)
    order = np.argsort(levels[-1][1][starts], kind="stable")
    out = np.zeros(len(starts), np.int64)
    for line in (order, order[::-1]):
        near = smaller_before(line)
        some = np.flatnonzero((near >= 0) & (out[line] < length))
        i, j = line[some], line[near[some]]
        if shorter:
            out[i] = np.maximum(out[i], common_lengths(text, levels, starts[i], starts[j]))
        else:
            rank = levels[-1][1]
            out[i[rank[starts[i]] == rank[starts[j]]]] = length
    return out


def pack(h, doc, lo, hot, segments: list[bytes]) -> bytes:
    sizes = np.array([len(s) for s in segments], np.int32)
    return b"".join([struct.pack("<q", len(h)), h.tobytes(), doc.tobytes(), lo.tobytes(), hot.tobytes(), sizes.tobytes(), *segments])


def unpack(data: bytes):
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for kind in (np.int64, np.int64, np.int64, np.bool_, np.int32):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ends = at + np.concatenate(([0], np.cumsum(out[4], dtype=np.int64)))
    return out[0], out[1], out[2], out[3], [data[ends[i] : ends[i + 1]] for i in range(n)]


def resolved(table: pa.Table, length: int) -> pa.Table:
    """(doc, start, end, window) of one block: ranges to remove; and windows that an anchor's other blocks must see."""
    z = zstandard.ZstdDecompressor()
    parts = [unpack(z.decompress(b.as_py())) for b in table.column("blob")]
    doc, lo, hot = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    segments = [s for p in parts for s in p[4]]
    order = np.lexsort((lo, doc))
    first: dict[bytes, int] = {}
    out_doc, out_lo, out_hi, fresh = [], [], [], []
    for i in order.tolist():
        if first.setdefault(segments[i], i) == i:
            fresh.append(i)
        else:  # the whole text of this anchor's windows came before
            out_doc.append(doc[i]), out_lo.append(lo[i]), out_hi.append(lo[i] + len(segments[i]))
    windows: list[tuple] = []
    if fresh:
        sizes = np.array([len(segments[i]) for i in fresh])
        text = np.frombuffer(b"".join([segments[i] for i in fresh]), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        many = sizes - length + 1
        owner = np.repeat(np.arange(len(fresh)), many)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        later = previous_factors(text, begin[owner] + offset, length, shorter=False) >= length
        at = np.flatnonzero(later)
        if len(at):
            brk = np.flatnonzero((np.diff(owner[at]) > 0) | (np.diff(offset[at]) > length)) + 1
            a, b = at[np.concatenate(([0], brk))], at[np.concatenate((brk - 1, [len(at) - 1]))]
            ids = np.array(fresh)[owner[a]]
            out_doc += doc[ids].tolist()
            out_lo += (lo[ids] + offset[a]).tolist()
            out_hi += (lo[ids] + offset[b] + length).tolist()
        spread = np.array(fresh)
        for j in np.flatnonzero(~later & hot[spread][owner]).tolist():
            i, k = fresh[owner[j]], int(offset[j])
            windows.append((int(doc[i]), int(lo[i]) + k, segments[i][k : k + length]))
    return pa.table({
        "doc": pa.array([int(x) for x in out_doc] + [w[0] for w in windows], pa.int64()),
        "start": pa.array([int(x) for x in out_lo] + [w[1] for w in windows], pa.int64()),
        "end": pa.array([int(x) for x in out_hi] + [w[1] + length for w in windows], pa.int64()),
        "win": pa.array([None] * len(out_doc) + [w[2] for w in windows], pa.binary()),
    })


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc, start, end): byte ranges, possibly overlapping, covered by windows that also start earlier."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))

    def hashes(batches):
        for batch in batches:
            every = [anchors(t, length)[0] for t in texts(batch.column(0)) if t]
            h, n = np.unique(np.concatenate(every) if every else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 1 << 30).astype(np.int32))], names=["h", "k"])

    def places(batches):
        for batch in batches:
            hs, ds, ps = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if t and d is not None:
                    h, p, lo, hi = anchors(t, length)
                    hs.append(h), ds.append(np.full(len(h), d)), ps.append(p << 14 | (p - lo) << 7 | (p - hi))
            flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(hs)), pa.array(flat(ds)), pa.array(flat(ps))], names=["h", "doc", "place"])

    often = written(
        read.select("text").mapInArrow(released(hashes), "h bigint, k int").groupBy("h").agg(F.sum("k").alias("n")).filter("n > 1"), "anchors"
    )
    total, top = often.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], "doc bigint, start bigint, end bigint")
    live = read.mapInArrow(released(places), "h bigint, doc bigint, place bigint").join(often, "h")
    by_doc = live.groupBy("doc").agg(F.collect_list(F.struct("h", "place", "n")).alias("live"))
    blocks = max(1, int(total * 1.4 * length / block))

    def zipped(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [z.compress(t) if t else b"" for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc", "z"])

    def contexts(batches):
        z, pack_z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        held, size = {}, 0

        def flush():
            blobs = [pack_z.compress(pack(*(np.concatenate(c) for c in list(zip(*v))[:4]), [s for x in v for s in x[4]])) for v in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])

        for batch in in_slices(batches, 1):
            lists = batch.column(2)
            h, place, n = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            owner = np.repeat(np.arange(batch.num_rows), [len(x) if x.is_valid else 0 for x in lists])
            ids, data = batch.column(0).to_numpy(), [z.decompress(x.as_py()) for x in batch.column(1)]
            p = place >> 14
            lo, hi = p - (place >> 7 & 127), p - (place & 127)
            parts = np.maximum(1, -(-n // most)).astype(np.uint64)
            salt = mix64(ids.view(np.uint64))[owner] % parts
            key = (mix64(h.view(np.uint64) + salt * C[0]) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else ():
                segments = [data[o][a : b + length] for o, a, b in zip(owner[g].tolist(), lo[g].tolist(), hi[g].tolist())]
                held.setdefault(int(key[g[0]]), []).append((h[g], ids[owner[g]], lo[g], parts[g] > 1, segments))
                size += sum(map(len, segments)) + 30 * len(g)
            if size > 24 << 20:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    zipped_docs = read.filter("text is not null and doc is not null").mapInArrow(released(zipped), "doc bigint, z binary")
    sent = zipped_docs.join(by_doc, "doc").select("doc", "z", "live").mapInArrow(released(contexts), "block bigint, blob binary")
    found = sent.groupBy("block").applyInArrow(lambda t: resolved(t, length), "doc bigint, start bigint, end bigint, win binary")
    if top <= most:
        return found.select("doc", "start", "end")
    found = written(found, "repeats")
    across = found.filter("win is not null")
    least = across.groupBy("win").agg(F.min(F.struct("doc", "start")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    more = across.join(least, "win").filter(F.struct("doc", "start") != F.col("least"))
    return found.filter("win is null").unionByName(more.select(found.columns)).select("doc", "start", "end")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_bytes, spans, kept): merged byte ranges removed, and the bytes left, for each document."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    if docs.groupBy("id").count().filter("count > 1").limit(1).count():  # the order of ids and texts, as numbers
        in_order = docs.orderBy("id", "text").withColumn("doc", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id()))
        docs = written(in_order, "in-order")
    else:
        docs = docs.withColumn("doc", F.col("id").cast("bigint"))
    spans = repeated_spans(docs, doc_id="doc", text="text", **options)
    by_doc = written(
        spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found")), "spans"
    )

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, spans, kept = [], [], []
            for t, found in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                t, out, left, at = t or b"", [], [], 0
                for x in found or []:
                    if out and x["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x["end"])
                    else:
                        out.append(dict(x))
                for x in out:
                    left.append(t[at : x["start"]])
                    at = x["end"]
                left.append(t[at:])
                n.append(len(t)), spans.append(out), kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"]
            )

    joined = docs.join(small_side(by_doc), "doc", "left").select("id", "text", "found")
    out = f"id {joined.schema[0].dataType.simpleString()}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return joined.mapInArrow(released(run), out).withColumnRenamed("id", doc_id)


def op2(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
