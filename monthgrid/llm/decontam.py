"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of `window` consecutive words; a shorter item with words is one window.  A
window is the set of its short shingles.  Containment at 1.0 needs a prefix of one shingle, so each window
is indexed under its rarest one by the corpus-wide counts.  A text shingle that meets an index entry gives
a start (positional bound), kept when the window fits the text (length bound) and all its words agree.

The item side is taken in blocks of at most `block_windows` windows, the proven bound of what is broadcast, so that
a very long item is spread over several;
texts are never shuffled, so no source, copy group or common passage can load one task.

Defined results: a null or wordless text has zero words and no hits; wordless and null items are ignored; very long texts
are read whole, a batch of about 4 MB or one text at a time;
equal windows of several items count for each; repeated rows give one result each; empty tables give empty
or clean results; other columns of either table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import WORD_BYTES, in_slices, released, small_batches, texts

SHINGLE = 3
MARK = "__"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Block:
    """The windows of some items: words as ids of the block's own vocabulary."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple, list[str]] = {}

    def add(self, item: str, words: list[bytes], window: int) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        for cut in {tuple(ids[i : i + window]) for i in range(max(1, len(ids) - window + 1))}:
            self.windows.setdefault(cut, []).append(item)

    def seal(self) -> "Block":
        """Arrays by window length: words, and the codes of each window's shingles."""
        self.by_length = {}
        for n in sorted({len(w) for w in self.windows}):
            rows = [w for w in self.windows if len(w) == n]
            words = np.array(rows, np.int32).reshape(-1, n)
            q = min(SHINGLE, n)
            codes = code_at(words, q)
            self.by_length[n] = {"q": q, "words": words, "codes": codes, "items": [self.windows[w] for w in rows]}
        self.keys = {
            q: np.unique(np.concatenate([x["codes"].ravel() for x in self.by_length.values() if x["q"] == q]))
            for q in {x["q"] for x in self.by_length.values()}
        }
        del self.windows
        return self

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """Put each window under its rarest shingle (of equals, the first in the order of codes)."""
        self.prefix = {}
        for n, x in self.by_length.items():
            rank = counts[x["q"]][np.searchsorted(self.keys[x["q"]], x["codes"])]
            rarest = np.lexsort((x["codes"], rank), axis=1)[:, 0]
            code = x["codes"][np.arange(len(rarest)), rarest]
            order = np.argsort(code, kind="stable")
            self.prefix[n] = (code[order], order, rarest[order])


def code_at(ids: np.ndarray, q: int) -> np.ndarray:
    """A code for each run of q ids along the last axis; equal runs have equal codes."""
    n = ids.shape[-1] - q + 1
    code = np.zeros(ids.shape[:-1] + (n,), np.uint64)
    for j in range(q):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[..., j : j + n].astype(np.uint64) + np.uint64(j + 1)
    return code ^ (code >> np.uint64(29))


def known_ids(words: list[bytes], vocabulary: dict) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, 0) for w in words), np.int32, len(words))


def full_runs(ids: np.ndarray, q: int) -> np.ndarray:
    """Starts of q consecutive known words."""
    if len(ids) < q:
        return np.empty(0, np.int64)
    ok = ids > 0
    run = ok[: len(ids) - q + 1].copy()
    for j in range(1, q):
        run &= ok[j : len(ids) - q + 1 + j]
    return np.flatnonzero(run)


def shingles_at(ids: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    return code_at(ids[at[:, None] + np.arange(q)], q)[:, 0] if len(at) else np.empty(0, np.uint64)


def count_shingles(block: Block, ids: np.ndarray, into: dict[int, np.ndarray]) -> None:
    for q, keys in block.keys.items():
        codes = shingles_at(ids, full_runs(ids, q), q)
        j = np.searchsorted(keys, codes)
        j = j[keys[np.minimum(j, len(keys) - 1)] == codes]
        into[q] += np.bincount(j, minlength=len(keys))


def occurrences(block: Block, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, window rows) of the block's windows in a text."""
    found = []
    for n, (codes, rows, offsets) in block.prefix.items():
        x = block.by_length[n]
        at = full_runs(ids, x["q"])
        if len(ids) < n or not len(at):
            continue
        have = shingles_at(ids, at, x["q"])
        lo, hi = np.searchsorted(codes, have, "left"), np.searchsorted(codes, have, "right")
        many = hi - lo
        if not many.any():
            continue
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        entry = np.repeat(lo - np.concatenate(([0], many.cumsum()[:-1])), many) + np.arange(many.sum())
        start = np.repeat(at, many) - offsets[entry]
        fits = (start >= 0) & (start + n <= len(ids))
        start, row = start[fits], rows[entry[fits]]
        if len(start):
            same = (ids[start[:, None] + np.arange(n)] == x["words"][row]).all(axis=1)
            if same.any():
                found.append((n, start[same], row[same]))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_windows: int):
    """Blocks of at most `block_windows` windows; a long item's windows are spread over as many as they fill."""
    block, n = Block(), 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).toLocalIterator()
    for item, text in rows:
        words = words_of(text.encode() if text else None)
        if not words or item is None:
            continue
        many, at = max(1, len(words) - window + 1), 0
        while at < many:
            take = min(many - at, block_windows - n)
            block.add(item, words[at : at + take + window - 1], window)
            at, n = at + take, n + take
            if n >= block_windows:
                yield block.seal()
                block, n = Block(), 0
    if n:
        yield block.seal()


def indexed_blocks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_windows: int = 200_000):
    """The blocks as broadcasts, each with its windows under their rarest shingles by the counts of all texts."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in blocks_of(benchmark, item_id, item_text, window, block_windows):
        shared = spark.sparkContext.broadcast(block)

        def counting(batches, shared=shared):
            block = shared.value
            total = {q: np.zeros(len(k), np.int64) for q, k in block.keys.items()}
            for batch in in_slices(batches, 0):
                for t in texts(batch.column(0)):
                    count_shingles(block, known_ids(words_of(t), block.vocabulary), total)
            for q, counts in total.items():
                j = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), q, np.int64)), pa.array(j), pa.array(counts[j])], names=["q", "j", "n"]
                )

        rarity = docs.select(F.col(text).cast("string")).mapInArrow(released(counting), "q bigint, j bigint, n bigint")
        rarity = rarity.groupBy("q", "j").agg(F.sum("n").alias("n")).collect()  # at most one row for each shingle of the block
        counts = {q: np.zeros(len(k), np.int64) for q, k in block.keys.items()}
        for q, j, n in rarity:
            counts[q][j] = n
        block.index(counts)
        shared.unpersist()
        yield spark.sparkContext.broadcast(block)


def find_windows(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of docs: id, n_words, spans (merged [start, end) word ranges), items (sorted ids)."""
    read = docs.select(F.col(doc_id), F.col(text).cast("string").alias(f"{MARK}text"))
    kind = read.schema[0].dataType.simpleString()
    out = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    state = read.select(
        F.col(doc_id).alias(f"{MARK}id"), f"{MARK}text", F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    blocks = indexed_blocks(docs, benchmark, text=text, **options)
    block = next(blocks, None)
    if block is None:
        empty = Block().seal()
        empty.index({})
        block = docs.sparkSession.sparkContext.broadcast(empty)
    while block is not None:
        following = next(blocks, None)
        schema = f"{MARK}id {kind}, {MARK}text string, {out}" if following is not None else f"{MARK}id {kind}, {out}"
        state = state.mapInArrow(released(matcher(block, following is not None)), schema)
        block = following
    return state.select(F.col(f"{MARK}id").alias(doc_id), "n_words", "spans", "items")


def matcher(shared, pass_text: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        block = shared.value
        for batch in in_slices(batches, 1):
            n_words, spans, items = [], [], []
            before, named = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for t, old, names in zip(texts(batch.column(1)), before, named):
                words = words_of(t)
                n_words.append(len(words))
                now, who = [(x["start"], x["end"]) for x in old], set(names)
                for n, start, row in occurrences(block, known_ids(words, block.vocabulary)):
                    now += [(int(s), int(s) + n) for s in np.unique(start)]
                    for r in np.unique(row):
                        who.update(block.by_length[n]["items"][r])
                spans.append([{"start": a, "end": b} for a, b in merged(now)])
                items.append(sorted(who))
            kept = [0, 1] if pass_text else [0]
            made = [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + made, names=[batch.schema.names[i] for i in [*kept, 2, 3, 4]]
            )

    return run


def contamination(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest of find_windows: counts, the digest of the items, and the verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        doc_id, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no window of an item; all columns kept, nothing shuffled."""
    at, schema, clean = docs.columns.index(text), docs.schema, docs
    for shared in indexed_blocks(docs, benchmark, text=text, **options):

        def run(batches, shared=shared):
            block = shared.value
            for batch in in_slices(batches, at):
                keep = [not occurrences(block, known_ids(words_of(t), block.vocabulary)) for t in texts(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        clean = clean.mapInArrow(released(run), schema)
    return clean


def op1(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(find_windows(docs, bench))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k + 1 : k + least(len(ws), 10)], ' ') AS g
  FROM (SELECT item, ws, unnest(range(greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, k, array_to_string(ws[k + 1 : k + n], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS k FROM w, ns WHERE len(ws) >= n)),
m AS (SELECT doc_id, dw.n, k, item FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
