"""N-gram Jaccard join by PartEnum signatures.

A text is the set of its word shingles; two link when 100 |A & B| >= 80 |A | B|.  Sizes fall into bands r, 1.6 r,
2.56 r ...; a pair that links differs in at most (|A| + |B|) / 9 elements.  The feature domain is cut into about
0.14 r first-level partitions of three parts each, so that some partition of a linking pair differs in one element at
most, hence in one part at most.  For each partition the three subsets of two parts are enumerated, and each gives a
signature: one of them is the same for both sets.  A set signs in its own band and, where a partner may lie there, in
the band below.

Leaving elements out of the domain keeps the bound on differences, so the signatures are drawn from the rarer
shingles: those that whole batches of texts repeat (at most `common` of them, a broadcast of known size) are left
out, and a passage that very many texts share makes no bucket.  A partition whose elements fill f parts is lost to
min(f, 2) differences at best, so a set whose partitions add up to more than the pair's differences is sure to agree
with any partner on a subset that isn't empty.  Any other set also signs over the whole domain, by single parts of a
finer cut, empty parts included if it has too few others, and so does every such partner of it: no pair is lost.

Equal sets are one node, named by the 128-bit digest of the set.  Signatures travel in compressed blocks.  What a task
has signed is first reduced: of the nodes that share a signature only the least goes on, and is paired with the
others on the spot, so a signature that a third of all texts bear has one entry a task.  Each block pairs its least
node with what other tasks have sent.  Pairs are verified first by parity sketches, whose differing bits can't
outnumber the differing elements, then by the whole sets, and those that hold by the words themselves.  The nodes
paired with one node, or with one that is paired with it across tasks, are its star, which holds all of its buckets.
Stars of one component are done; in the others, the nodes outside of the largest component are compared with all
of other components tile by tile, by sketches, and only likely pairs leave a tile to be verified.

Defined results: null and wordless texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; very long texts are one set, held whole by a task; a pair at the threshold links, and the least id names a
component; repeated ids are rows of their own; an empty table gives an empty table; other columns
are not read.  Sets are counted and compared as 64-bit hashes of shingles; no pair links unless its words agree.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtools import forget, in_slices, mix64, released, settled, small_batches, small_side, spare, texts, written
from .components import components

SHINGLE, BUCKET, TILE, STEP, COMMON = 5, 64, 2048, 1.6, 200_000
#: Signatures that a task reduces at once, and those of a block.
SIGNED = 1 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
BLANKS = re.compile(rb"[\x09-\x0d ]+")
#: Lower-cases A-Z; bytes.split() then cuts at \x20 and \x09-\x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_codes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A hash of each blank-separated word, about a piece of the text at a time."""
    out, at, hashed = [], 0, xxhash.xxh3_64_intdigest
    while at < len(text):
        blank = BLANKS.search(text, at + piece) if len(text) - at > piece else None
        end = blank.start() if blank else len(text)
        words = text[at:end].split()
        out.append(np.fromiter(map(hashed, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_codes(text: bytes | None, q: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle of a text, in order."""
    h = word_codes(text.translate(LOWER)) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - q + 1)
    code = np.full(n, min(len(h), q), np.uint64)
    for j in range(min(q, len(h))):
        code = (code ^ (h[j : j + n] * ODD[j % 5])) * ODD[(j + 1) % 5]
        code ^= code >> np.uint64(31)
    return code


def shingle_set(text: bytes | None, q: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_codes(text, q))


class Words:
    """A text's shingles with their words: linked() is exact."""

    def __init__(self, text: bytes, q: int) -> None:
        self.text = BLANKS.sub(b" ", text.translate(LOWER)).strip(b" ")
        self.code, self.first = np.unique(shingle_codes(text, q), return_index=True)
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        self.start, self.end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(self.text)]))
        self.q = min(q, len(self.start))

    def shingle(self, k: int) -> bytes:
        return self.text[self.start[self.first[k]] : self.end[self.first[k] + self.q - 1]]

    def linked(self, other: "Words") -> bool:
        _, mine, its = np.intersect1d(self.code, other.code, assume_unique=True, return_indices=True)
        enough = lambda both: 100 * both >= 80 * (len(self.code) + len(other.code) - both)
        return enough(len(mine)) and enough(sum(self.shingle(i) == other.shingle(j) for i, j in zip(mine.tolist(), its.tolist())))


@lru_cache(maxsize=None)
def bound(band: int) -> int:
    """The largest size of a band."""
    return int(np.ceil(STEP**band))


def band_of(size: int) -> int:
    band = max(0, int(np.log(size) / np.log(STEP)) - 1)
    while bound(band) < size:
        band += 1
    return band


def signatures(h: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set of hashes; common: sorted, left out where it can be."""
    s, out = len(h), []
    rare = h
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rare = h[common[at] != h]
    own = band_of(s)
    for band in (own, own - 1):
        if band < 0 or (band < own and 4 * s > 5 * bound(band)):
            continue
        partner = min(1.25 * s, 1.25 * bound(band) if band == own else bound(band))  # one of the upper band has the lower as its other
        most = int((s + partner) / 9 + 1e-9)
        signs, sure = subset_signatures(rare, band)
        out.append(signs)
        if sure <= most:  # agreement on rare elements isn't certain
            signs, filled, empty = part_signatures(h, band)
            out += [signs] if filled > most else [signs, empty]
    return np.concatenate(out)


def subset_signatures(h: np.ndarray, band: int):
    """The signatures of all non-empty subsets of two of a partition's three parts; and the number of differences that
    it takes at least to change every one of them."""
    n = int(np.ceil(0.14 * bound(band))) + 2
    salt = np.uint64((2 * band + 1) * int(ODD[2]) & (2**64 - 1))
    x = mix64(h ^ ODD[0])
    cell = ((x >> np.uint64(32)) * np.uint64(3 * n)) >> np.uint64(32)
    order = np.argsort(cell, kind="stable")
    sorted_ = cell[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(x) else np.empty(0, np.int64)
    code = np.zeros(3 * n, np.uint64)
    at = sorted_[cut].astype(np.int64)
    if len(cut):
        total = np.add.reduceat(mix64(x ^ ODD[3])[order], cut)
        code[at] = mix64(total ^ mix64((at.astype(np.uint64) + np.uint64(1)) * ODD[1] ^ salt))
    full = np.zeros(3 * n, np.int64)
    full[at] = 1
    code, full = code.reshape(n, 3), full.reshape(n, 3)
    filled = full.sum(axis=1)
    # The parts but one, and which one is left out.
    rest = code.sum(axis=1, dtype=np.uint64)[:, None] - code
    place = np.arange(1, 3 * n + 1, dtype=np.uint64).reshape(n, 3)
    signs = mix64(rest ^ mix64(place * ODD[4] ^ salt))
    return signs[(filled[:, None] - full) > 0], int(np.minimum(filled, 2).sum())


def part_signatures(h: np.ndarray, band: int):
    """(signatures of the non-empty parts, their number, signatures of the empty parts) of a band's cut into more
    parts than a pair has differences."""
    parts = int(np.ceil(0.28 * bound(band))) + 2
    salt = np.uint64((2 * band + 2) * int(ODD[2]) & (2**64 - 1))
    x = mix64(h ^ np.uint64(2 * int(ODD[0]) & (2**64 - 1)))
    part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(x)  # also the order of parts
    cut = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0))) if len(x) else np.empty(0, np.int64)
    total = np.add.reduceat(mix64(x ^ ODD[3])[order], cut) if len(cut) else np.empty(0, np.uint64)
    signs = mix64(total ^ mix64((part[order][cut] + np.uint64(1)) * ODD[1] ^ salt))
    empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part)
    return signs, len(cut), mix64((empty + np.uint64(1)) * ODD[4] ^ salt)


def sketch(h: np.ndarray) -> bytes:
    """The parity of the number of elements in each of 4 |h| cells or more (a power of two): sketches of two sets, folded
    to one length, differ in no more bits than the sets differ in elements."""
    m = max(64, 4 << int(np.ceil(np.log2(max(len(h), 1)))))
    cells = (mix64(h ^ ODD[2]) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only for pairs that can't link, by their sizes or their sketches."""
    if 100 * min(n, m) < 80 * max(n, m):
        return False
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (n + m) // 9


def node_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def short_of(node: bytes) -> int:
    """Forty bits of a node's name, for signatures; nodes that share them are told apart later on."""
    return int.from_bytes(node[:5], "big")


#: The same in SQL.
SHORT = "cast(conv(hex(substring(node, 1, 5)), 16, 10) as bigint)"


def digests(docs: DataFrame, doc_id: str, text: str, q: int) -> DataFrame:
    """(id, key, n, node, ...) of each row: key is a hash of its text, node the digest of its set (null for empty ones);
    and (common, times) of shingles that three or more texts of a batch hold, in rows whose n is null."""

    def run(batches):
        no = lambda kind, n: pa.nulls(n, kind)
        names = ["id", "key", "n", "node", "common", "times"]
        for batch in batches:
            n, nodes, seen = [], [], []
            for part in in_slices([batch], 2):
                sets = [shingle_set(t, q) for t in texts(part.column(2))]
                n += map(len, sets)
                nodes += [node_of(s) if len(s) else None for s in sets]
                seen.append(np.concatenate(sets))
            h, k = np.unique(np.concatenate(seen) if seen else np.empty(0, np.uint64), return_counts=True)
            h, k = h[k >= 3].view(np.int64), k[k >= 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), no(pa.int64(), len(n)), no(pa.int64(), len(n))], names=names
            )
            yield pa.RecordBatch.from_arrays(
                [no(batch.column(0).type, len(h)), no(pa.int64(), len(h)), no(pa.int64(), len(h)), no(pa.binary(), len(h)), pa.array(h), pa.array(k.astype(np.int64))], names=names
            )

    body = F.col(text).cast("string")
    read = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))
    return read.mapInArrow(released(run), f"id {read.schema[0].dataType.simpleString()}, key bigint, n bigint, node binary, common bigint, times bigint")


def planes(x: np.ndarray) -> bytes:
    """The low five bytes of numbers, one plane a byte."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unplaned(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(5, n).T
    return out.reshape(-1).view("<u8")


def stars_of(sig: np.ndarray, node: np.ndarray):
    """Of nodes in the order of (signature, node): which come first in their bucket, and that first one for each."""
    fresh = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
    return fresh, node[np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))]


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs of different nodes."""
    return np.unique(np.stack([a, b], axis=1)[a != b], axis=0)


def signed(docs: DataFrame, text: str, q: int, common: np.ndarray, blocks: int) -> DataFrame:
    """(block, entries, pairs, blob): for each block of signatures, what tasks have left of them after pairing the
    nodes of equal ones."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        held, seen, size = [], set(), 0

        def flush():
            sig, node = np.concatenate([x for x, _ in held]), np.concatenate([np.full(len(x), v, np.uint64) for x, v in held])
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            fresh, first = stars_of(sig, node)
            rows = []
            # Blocks are ranges of the signatures; forty bits of the distance from a range's start tell them apart.
            block = ((sig >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            cut = np.concatenate((np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1)), [len(sig)]))
            drop = np.uint64(max(0, 64 - 40 - (blocks.bit_length() - 1)))
            for lo, hi in zip(cut[:-1], cut[1:]):
                own, start = fresh[lo:hi], -(-(int(block[lo]) << 32) // blocks)
                pairs = pairs_of(first[lo:hi][~own], node[lo:hi][~own])
                s = (sig[lo:hi][own] - np.uint64(start << 32)) >> drop
                data = planes(np.diff(s, prepend=np.uint64(0))) + planes(node[lo:hi][own]) + planes(pairs[:, 0]) + planes(pairs[:, 1])
                rows.append((int(block[lo]), int(own.sum()), len(pairs), z.compress(data)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "entries", "pairs", "blob"])

        for batch in in_slices(batches, 0):
            for t in texts(batch.column(0)):
                s = shingle_set(t, q)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                held.append((signatures(s, shared.value), short_of(node)))
                size += len(held[-1][0])
                if size >= SIGNED:
                    yield flush()
                    held, seen, size = [], set(), 0
        if held:
            yield flush()

    return docs.select(F.col(text).cast("string")).mapInArrow(released(run), "block bigint, entries bigint, pairs bigint, blob binary")


def starred(sent: DataFrame, blocks: int) -> DataFrame:
    """(a, b, across) of all blocks, shorts: the least node of a bucket with every other, as tasks have paired them
    (across is false) and across tasks.  Near copies share signatures of many blocks; what blocks have paired goes on
    compressed, by ranges of the pairs, and only there, once for each pair, becomes rows."""
    parts = max(1, blocks // 16)

    def paired(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        sigs, nodes, within = [], [], []
        for n, k, blob in zip(*(table.column(c).to_pylist() for c in ("entries", "pairs", "blob"))):
            data = z.decompress(blob)
            sigs.append(np.cumsum(unplaned(data[: 5 * n], n)))
            nodes.append(unplaned(data[5 * n : 10 * n], n))
            within.append(np.stack([unplaned(data[10 * n : 10 * n + 5 * k], k), unplaned(data[10 * n + 5 * k :], k)], axis=1))
        sig, node, within = np.concatenate(sigs), np.concatenate(nodes), np.unique(np.concatenate(within), axis=0)
        order = np.lexsort((node, sig))
        _, first = stars_of(sig[order], node[order])
        z, rows = zstandard.ZstdCompressor(level=1), []
        for across, pairs in ((False, within), (True, pairs_of(first, node[order]))):
            part = ((mix64(pairs[:, 0] ^ mix64(pairs[:, 1])) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            for k in np.unique(part):
                own = pairs[part == k]
                rows.append((int(k), across, len(own), z.compress(planes(own[:, 0]) + planes(own[:, 1]))))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["part", "across", "n", "pairs"])

    def once(table: pa.Table) -> pa.Table:
        z, out = zstandard.ZstdDecompressor(), []
        for wanted in (False, True):
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for across, n, blob in zip(*(table.column(c).to_pylist() for c in ("across", "n", "pairs"))):
                if across == wanted:
                    data = z.decompress(blob)
                    a.append(unplaned(data[: 5 * n], n))
                    b.append(unplaned(data[5 * n :], n))
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            out.append((a[fresh].astype(np.int64), b[fresh].astype(np.int64), np.full(int(fresh.sum()), wanted)))
        return pa.table(dict(zip(("a", "b", "across"), map(np.concatenate, zip(*out)))))

    made = sent.groupBy("block").applyInArrow(paired, "part bigint, across boolean, n bigint, pairs binary")
    return made.groupBy("part").applyInArrow(once, "a bigint, b bigint, across boolean")


def packed(docs: DataFrame, text: str, q: int) -> DataFrame:
    """(node, n, sketch, z) of every row with a set; z is the compressed text."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in in_slices(batches, 0):
            rows, seen = [], set()
            for t in texts(batch.column(0)):
                s = shingle_set(t, q)
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    rows.append((node, len(s), sketch(s), z.compress(t)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "n", "sketch", "z"]
            )

    return docs.select(F.col(text).cast("string")).mapInArrow(released(run), "node binary, n bigint, sketch binary, z binary")


def verified(pairs: DataFrame, stored: DataFrame, q: int) -> DataFrame:
    """(a, b, ok) for each pair of nodes: by sketches, then by the whole sets and their words.  Only what the pairs name
    is shuffled."""

    def with_sides(pairs, *columns):
        named = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
        needed = stored.select("node", *columns).join(small_side(named), "node", "left_semi")
        for end in "ba":
            pairs = pairs.join(needed.select(F.col("node").alias(end), *(F.col(c).alias(c + end) for c in columns)), end)
        return pairs.select("a", "b", *(c + end for end in "ab" for c in columns)), named

    def filtered(batches):
        for batch in batches:
            ok = [may_link(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    def compared(batches):
        z, last, words = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            ok = []
            for za, zb in zip(batch.column(2), batch.column(3)):
                if last != (a := za.as_py()):
                    last, words = a, Words(z.decompress(a), q)
                ok.append(words.linked(Words(z.decompress(zb.as_py()), q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    kind = "a binary, b binary, ok boolean"
    sides, named = with_sides(pairs, "n", "sketch")
    likely = written(sides.mapInArrow(released(filtered), kind), "likely")
    sides, also = with_sides(likely.filter("ok").select("a", "b"), "z")
    out = written(likely.filter("not ok").unionByName(sides.mapInArrow(released(compared), kind)), "tested")
    forget(named, also, likely)
    return out


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of one sketch with each row of another size's sketches, folded to the shorter."""
    while len(x) > y.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while y.shape[1] > len(x):
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    return np.bitwise_count(y ^ x).sum(axis=1, dtype=np.int64)


def tiled(members: DataFrame, label: DataFrame, stored: DataFrame, tile: int, closest: int | None, above: int = 0) -> DataFrame:
    """(a, b) that may link and are of two components, from the stars of more than `above` nodes: the nodes outside of a
    star's largest component meet all of its nodes, in tiles of about `tile` by `tile`.  Sketches are compared where
    they are, and only what passes leaves: all, or each node's `closest`."""
    named = members.join(small_side(label), "node", "left").select("star", "node", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("star", "label").agg(F.count(F.lit(1)).alias("k"))
    open_ = (
        counts.groupBy("star").agg(F.count(F.lit(1)).alias("labels"), F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("top"))
        .filter((F.col("labels") > 1) & (F.col("n") > above))
        .select("star", F.col("top.label").alias("most"), F.ceil(F.col("n") / tile).alias("rights"), F.ceil((F.col("n") - F.col("top.k")) / tile).alias("lefts"))
    )
    own = named.join(open_, "star").withColumn("u", F.abs(F.xxhash64("node"))).withColumn("few", F.col("label") != F.col("most"))
    own = own.withColumn("down", F.when(F.col("few"), F.col("u") % F.col("lefts"))).withColumn("over", F.col("u") % F.col("rights"))
    # A node outside of the largest component asks all columns of tiles; every node answers in all rows of its column.
    place = F.expr("""concat(
      if(few, transform(sequence(0L, rights - 1), i -> struct(down AS p, i AS q, true AS asks, i = over AS answers)), array()),
      transform(filter(sequence(0L, lefts - 1), i -> NOT few OR i <> down), i -> struct(i AS p, over AS q, false AS asks, true AS answers)))""")
    rows = own.select("star", "node", "label", "few", F.explode(place).alias("x")).select("star", "x.p", "x.q", "x.asks", "x.answers", "node", "label", "few")
    rows = rows.join(stored.select("node", "n", "sketch"), "node")

    def run(table: pa.Table) -> pa.Table:
        asks, answers, few = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "answers", "few"))
        node, n = table.column("node").combine_chunks(), table.column("n").to_numpy()
        label, rank = (np.unique(np.array(table.column(c).to_pylist(), "V16"), return_inverse=True)[1] for c in ("label", "node"))
        bits = [np.frombuffer(b, np.uint64) for b in table.column("sketch").to_pylist()]
        right = np.flatnonzero(answers)
        sizes = {w: np.array([j for j in right if len(bits[j]) == w]) for w in {len(bits[j]) for j in right}}
        stacked = {w: np.stack([bits[j] for j in js]) for w, js in sizes.items()}
        out = [np.empty((2, 0), np.int64)]
        for i in np.flatnonzero(asks):
            near, far = [], []
            for w, js in sizes.items():
                ok = (label[js] != label[i]) & (5 * np.minimum(n[js], n[i]) >= 4 * np.maximum(n[js], n[i]))
                if not closest:
                    ok &= ~few[js] | (rank[js] > rank[i])  # such pairs meet twice
                if ok.any():
                    d = differing(bits[i], stacked[w][ok])
                    fits = d <= (n[js[ok]] + n[i]) // 9
                    near.append(js[ok][fits])
                    far.append(d[fits])
            if near:
                js = np.concatenate(near)
                js = js[np.argsort(np.concatenate(far), kind="stable")[:closest]]
                first = rank[js] < rank[i]
                out.append(np.stack([np.where(first, js, i), np.where(first, i, js)]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    return rows.groupBy("star", "p", "q").applyInArrow(run, "a binary, b binary")


def component_labels(docs: DataFrame, made: DataFrame, text: str, q: int, bucket: int, common: np.ndarray) -> DataFrame:
    """(node, label) of all nodes that link with others."""
    total = made.agg(F.sum(0.8 * F.col("n") + 12)).first()[0] or 0
    blocks = max(1, int(total / SIGNED))
    stars = written(starred(signed(docs, text, q, common, blocks), blocks), "stars")
    settled(docs.sparkSession)
    rows = made.filter("node is not null").select("node", "key", F.expr(SHORT).alias("short"))
    twins = written(rows.groupBy("short").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("short", "a"), "twins")
    shorts = stars.select(F.explode(F.array("a", "b")).alias("short")).unionByName(twins.select("short"))
    involved = written(shorts.distinct(), "involved")
    # One text of each node that signatures or their shortened names have brought together.
    keys = written(rows.join(small_side(involved), "short", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key").distinct(), "keys")
    wanted = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("key")).join(small_side(keys), "key", "left_semi")
    stored = written(packed(wanted, "text", q).groupBy("node").agg(F.min(F.struct("n", "sketch", "z")).alias("t")).select("node", "t.*"), "texts")
    names = written(stored.select("node", F.expr(SHORT).alias("short")), "names")
    found = small_side(names)
    node_for = lambda end: found.select(F.col("short").alias(end), F.col("node").alias(f"n{end}"))
    same = names.join(small_side(twins), "short").filter("node <> a").select(F.col("short").alias("star"), "a", F.col("node").alias("b"))
    linked = stars.join(node_for("a"), "a").join(node_for("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    pairs = written(linked.unionByName(same.select("a", "b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # A bucket's nodes are in the star of its least node, through the least node of their task.
    direct = stars.select(F.col("a").alias("star"), "b")
    over = stars.filter("across").select(F.col("a").alias("star"), F.col("b").alias("a"))
    through = direct.unionByName(over.join(stars.filter("not across").select("a", "b"), "a").select("star", "b"))
    centred = lambda star: star.unionByName(star.select("star", F.col("star").alias("b"))).distinct().join(node_for("b"), "b").select("star", F.col("nb").alias("node"))
    twin = same.select("star", F.explode(F.array("a", "b")).alias("node"))
    members = written(centred(through).unionByName(twin).distinct(), "members")
    tested = [verified(pairs, stored, q)]
    label = components(tested[0].filter("ok").select("a", "b"))
    # The closest pairs of the stars as they were paired join what is large; the second round leaves no pair out.
    for closest, above, inside in ((3, bucket // 4, centred(direct)), (None, 0, members)):
        known = tested[0].select("a", "b")
        for more in tested[1:]:
            known = known.unionByName(more.select("a", "b"))
        fresh = written(tiled(inside, label, stored, TILE, closest, above).distinct().join(known, ["a", "b"], "left_anti"), "pairs")
        if fresh.limit(1).count():
            tested.append(verified(fresh, stored, q))
            links = tested[-1].filter("ok").select("a", "b")
            if links.limit(1).count():
                # The links found so far are those of each node with its component's least.
                old, label = label, components(links.unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b"))))
                forget(old)
        forget(fresh)
        settled(docs.sparkSession)
    forget(stars, twins, involved, keys, stored, names, pairs, members, *tested)
    return label


def grouped(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE, bucket: int = BUCKET, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, node) of each row; and (node, label, component) of nodes that link or are several rows: label is the
    component's least node, component its least id."""
    small_batches(docs.sparkSession)
    made = written(digests(docs, doc_id, text, shingle), "sets")
    often = made.filter("n is null").groupBy("common").agg(F.sum("times").alias("times")).filter("times >= 24").orderBy(F.desc("times"), "common").limit(common)
    rows = made.filter("n is not null").select("id", "key", "n", "node")
    found = often.select("common").toArrow().column(0).to_numpy().astype(np.int64)  # a row each would take the driver a hundred times the bytes
    settled(docs.sparkSession)
    label = component_labels(docs, rows, text, shingle, bucket, np.sort(found.view(np.uint64)))
    classes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = classes.join(label, "node", "left").filter(F.col("label").isNotNull() | (F.col("copies") > 1))
    named = written(named.select("node", "least", F.coalesce("label", "node").alias("label")), "classes")
    forget(label)
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    return rows, named.join(least, "label").select("node", "label", "component")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET, common: int = COMMON) -> DataFrame:
    """(id, n_shingles, component_id) for each row; component_id is the least id reachable by links."""
    rows, of = grouped(docs, doc_id, text, shingle, bucket, common)
    return rows.join(of, "node", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, **options) -> DataFrame:
    """One row of docs for each component, that of the least id; all columns kept.

    Rows of repeated or null ids are told apart by their sets: of a component's rows with the least id, that of the
    least set stays, and one of equal rows.  A null id comes after all others, so of null ids alone one row stays.
    Rows without a shingle link with nothing and all stay."""
    rows, of = grouped(docs, doc_id, text, shingle, **options)
    odd_, gone_, key_, node_, label_, component_, r_ = spare(docs.columns, *(f"__{c}" for c in ("odd", "gone", "key", "node", "label", "component", "r")))
    odd = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("id is null or rows > 1").select(F.col("id").alias(odd_)), "odd")
    placed = rows.join(of, "node")
    gone = written(placed.filter("id <> component").select(F.col("id").alias(gone_)).distinct(), "gone")
    if not odd.limit(1).count():
        return docs.join(small_side(gone), docs[doc_id] == F.col(gone_), "left_anti")
    is_odd = docs[doc_id].eqNullSafe(F.col(odd_))
    plain = docs.join(small_side(odd), is_odd, "left_anti").join(small_side(gone), docs[doc_id] == F.col(gone_), "left_anti")
    # The set of each row of those ids, by its id and text.
    known = placed.join(small_side(odd), F.col("id").eqNullSafe(F.col(odd_)), "left_semi")
    known = written(known.select(F.col("id").alias(odd_), *[F.col(c).alias(name) for c, name in (("key", key_), ("node", node_), ("label", label_), ("component", component_))]).distinct(), "known")
    strange = docs.join(small_side(odd), is_odd, "left_semi")
    same = docs[doc_id].eqNullSafe(F.col(odd_)) & (F.xxhash64(docs[text].cast("string")) == F.col(key_))
    placed = strange.join(small_side(known), same, "left").filter(F.col(label_).isNull() | docs[doc_id].eqNullSafe(F.col(component_)))
    order = F.row_number().over(W.partitionBy(label_).orderBy(node_, key_, F.xxhash64(*docs.columns)))
    first = placed.filter(F.col(label_).isNotNull()).withColumn(r_, order).filter(F.col(r_) == 1)
    return plain.unionByName(placed.filter(F.col(label_).isNull()).select(docs.columns)).unionByName(first.select(docs.columns))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[k + 1 : k + 5], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
