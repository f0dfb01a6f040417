"""Hard-negative mining over product-quantised vectors with stored residual norms.

Vectors become whole numbers (floor of 256 times each component) and scores are their inner products, so every score is
exact.  The index holds for each row a code for each `width` components (the nearest of `centroids` centroids of
whole numbers, found by k-means over a bounded sample of about `sample` rows) and the norm of what the codes leave over.
For an anchor, a lookup table gives its product with a row's centroids, and the product with the rest is at most the
two norms' product, so a row whose table score plus or minus that bound can't reach the anchor's window or its current
k-th place is passed over without a look at its vector; all others are scored exactly.  No row that counts is lost.

Every anchor first finds its positives: its `positives` best rows of the same label.  Then each pair finds the first
`negatives` rows of other labels whose score is within the window of `low` to `high` per cent of the positive's.
Anchors are sent in blocks of a bounded number and size; each block meets all rows in two passes, a task keeps only
the best rows of each list so far, and the lists of all tasks are merged by their key.

Defined results: rows with a null id, label or vector, an empty one, or a null or non-finite component take no part, nor do vectors
whose whole numbers have a norm of 2**26 or more (of others every score, and every partial sum of one, is a whole
number that a double holds); vectors meet only those of their length;
higher scores come first, ties by smaller id; rows that repeat an id are rows of their own, and an anchor leaves out
only its own row; a positive without negatives in its window returns nothing; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtools import forget, released, shared_dir, written

WIDTH, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 8192, 8
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Norms stay under this, so that scores stay under 2**52.
LARGEST = 1 << 26
#: The most anchors of a block, and the most bytes of their vectors.
BLOCK, BLOCK_BYTES = 16_384, 16 << 20
#: Rows and anchors whose table scores are held at once.
ROWS, ANCHORS = 4096, 128


def whole(rows: DataFrame, *, vec_id: str, embedding: str, label) -> DataFrame:
    """(id, label, dims, vec) of the rows that take part; vec: the whole numbers as bytes of 32 bits each."""

    def run(batches):
        for batch in batches:
            out, dims = [], []
            for v in batch.column(2):
                x = None if not v.is_valid or v.values.null_count or not len(v.values) else np.floor(256 * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                good = x is not None and bool(np.isfinite(x).all()) and np.abs(x).max() < LARGEST and np.linalg.norm(x) < LARGEST
                out.append(x.astype(np.int32).tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "dims", "vec"])

    read = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return read.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "id bigint, label bigint, dims int, vec binary").filter("vec IS NOT NULL")


def matrix(column) -> np.ndarray:
    """Vectors of one length as a matrix of doubles, which hold these whole numbers exactly."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.float64)


def parts(dims: int, width: int) -> list[slice]:
    return [slice(k, min(k + width, dims)) for k in range(0, dims, width)]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def codebooks(x: np.ndarray, width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 5) -> list[np.ndarray]:
    """For each part of the components, centroids of whole numbers by k-means; x: the sample."""
    rng, books = np.random.default_rng(seed), []
    for at in parts(x.shape[1], width):
        own = x[:, at]
        kinds = np.unique(own, axis=0)
        c = kinds[np.sort(rng.permutation(len(kinds))[:centroids])].copy()
        for _ in range(rounds):
            mine = nearest(own, c)
            n = np.bincount(mine, minlength=len(c))
            sums = np.stack([np.bincount(mine, own[:, j], len(c)) for j in range(own.shape[1])], axis=1)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        books.append(np.rint(c))
    return books


def encoded(x: np.ndarray, books: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each row, and the norm of its residual, rounded up."""
    codes = np.stack([nearest(x[:, at], c) for at, c in zip(parts(x.shape[1], width), books)], axis=1)
    rest = sum(((x[:, at] - c[k]) ** 2).sum(axis=1) for at, c, k in zip(parts(x.shape[1], width), books, codes.T))
    return codes.astype(np.uint8 if max(map(len, books)) <= 256 else np.uint16), np.sqrt(rest) * (1 + 1e-12)


def index(rows: DataFrame, *, width: int = WIDTH, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(row, id, label, dims, vec, codes, rest) of every row as a written table, and the codebooks of each length."""
    rows = written(rows, "vectors")
    books = {}
    for dims, n in sorted((r[0], r[1]) for r in rows.groupBy("dims").count().collect()):
        fine = F.pmod(F.xxhash64("vec", "id"), F.lit(1 << 40)) / float(1 << 40) < min(1.0, sample / n)
        drawn = rows.filter(F.col("dims") == dims).filter(fine).orderBy(F.xxhash64("vec", "id")).limit(sample).select("vec").toArrow()
        drawn = drawn if len(drawn) else rows.filter(F.col("dims") == dims).limit(1).select("vec").toArrow()
        books[dims] = codebooks(matrix(drawn.column(0)), width, centroids)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            codes, rest, lengths = [b""] * batch.num_rows, np.zeros(batch.num_rows), batch.column(2).to_numpy()
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                own, left = encoded(matrix(batch.column(3).take(pa.array(at))), shared.value[dims], width)
                rest[at] = left
                for i, c in zip(at, own):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(rest)], names=[*batch.schema.names, "codes", "rest"])

    coded = rows.mapInArrow(run, "id bigint, label bigint, dims int, vec binary, codes binary, rest double")
    table = written(coded.select(F.monotonically_increasing_id().alias("row"), "*"), "index")
    forget(rows)
    return table, books


def merged(key: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first entries of each key: by score, then id, then row."""
    order = np.lexsort((rows, ids, -score, key))
    ordered = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
    rank = np.arange(len(ordered)) - np.repeat(first, np.diff(first, append=len(ordered)))
    return order[rank < k]


class Lists:
    """The k first rows of each of n lists so far, and the score from which on a list takes another one."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.least = k, floor, floor.copy()
        self.key, self.score, self.ids, self.rows = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        self.n = n

    def add(self, key, score, ids, rows):
        if not len(key):
            return
        every = [np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.ids, ids), (self.rows, rows))]
        at = merged(*every, self.k)
        self.key, self.score, self.ids, self.rows = (e[at] for e in every)
        full = np.bincount(self.key, minlength=self.n) == self.k
        worst = np.full(self.n, np.inf)
        np.minimum.at(worst, self.key, self.score)
        self.least = np.where(full, np.maximum(worst, self.floor), self.floor)


def scan(table: DataFrame, books: dict, anchors: dict, k: int, *, same: bool, width: int) -> DataFrame:
    """(key, score, id, row): the k first rows of each list of a block of anchors, for each task.

    anchors: row, label, vec (a matrix) and dims; and of each list the anchor it is of, its least and its largest score."""
    shared = table.sparkSession.sparkContext.broadcast((books[anchors["dims"]], anchors))
    dims = anchors["dims"]

    def run(batches):
        books, a = shared.value
        n = len(a["of"])
        lists = Lists(n, k, a["low"])
        norms = np.sqrt((a["vec"] ** 2).sum(axis=1)) * (1 + 1e-12)
        # A list's place among its anchor's lists; every anchor has as many places as the one with the most.
        places = int(np.bincount(a["of"]).max()) if n else 0
        list_at = np.full((len(a["row"]), places), -1)
        turn = np.arange(n) - np.searchsorted(a["of"], a["of"])
        list_at[a["of"], turn] = np.arange(n)
        tables = [[a["vec"][k0 : k0 + ANCHORS, at] @ c.T for at, c in zip(parts(dims, width), books)] for k0 in range(0, len(norms), ANCHORS)] if len(norms) <= 8 * ANCHORS else None
        for batch in batches:
            for b0 in range(0, batch.num_rows, ROWS):
                part = batch.slice(b0, ROWS)
                row, ids, label, rest = (part.column(i).to_numpy() for i in range(4))
                codes = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8 if max(map(len, books)) <= 256 else np.uint16).reshape(part.num_rows, -1)
                vec = None
                for k0 in range(0, len(norms), ANCHORS):
                    mine = slice(k0, k0 + ANCHORS)
                    lookup = tables[k0 // ANCHORS] if tables else [a["vec"][mine, at] @ c.T for at, c in zip(parts(dims, width), books)]
                    score = np.zeros((part.num_rows, lookup[0].shape[0]))
                    for m, t in enumerate(lookup):
                        score += np.ascontiguousarray(t.T)[codes[:, m]]
                    bound = rest[:, None] * norms[mine] + 1e-6 * (1 + np.abs(score))
                    fits = (label[:, None] == a["label"][mine]) == same
                    fits &= row[:, None] != a["row"][mine]
                    near = np.zeros_like(fits)
                    for p in range(places):
                        at = list_at[mine, p]
                        near |= (at >= 0) & (score + bound >= lists.least[at]) & (score - bound <= a["high"][at])
                    i, j = np.nonzero(fits & near)
                    if not len(i):
                        continue
                    vec = matrix(part.column(4)) if vec is None else vec
                    true = np.concatenate([np.einsum("ij,ij->i", vec[i[q : q + 65536]], a["vec"][k0 + j[q : q + 65536]]) for q in range(0, len(i), 65536)])
                    for p in range(places):
                        at = list_at[k0 + j, p]
                        good = (at >= 0) & (true >= lists.least[at]) & (true <= a["high"][at])
                        lists.add(at[good], true[good], ids[i[good]], row[i[good]])
        out = [pa.array(lists.key), pa.array(lists.score.astype(np.int64)), pa.array(lists.ids), pa.array(lists.rows)]
        yield pa.RecordBatch.from_arrays(out, names=["key", "score", "id", "row"])

    rows = table.filter(F.col("dims") == dims).select("row", "id", "label", "rest", "vec", "codes")
    found = rows.mapInArrow(released(run), "key bigint, score bigint, id bigint, row bigint")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def mined(rows: DataFrame, *, anchor, vec_id: str = "vec_id", embedding: str = "embedding", label=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, width: int = WIDTH, centroids: int = CENTROIDS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor: a condition on `id`."""
    spark = rows.sparkSession
    table, books = index(whole(rows, vec_id=vec_id, embedding=embedding, label=F.col("label") if label is None else label), width=width, centroids=centroids, sample=sample)
    out = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    wanted = table.filter(anchor)
    for dims in books:
        most = max(1, min(block, BLOCK_BYTES // (4 * dims)))
        own = wanted.filter(F.col("dims") == dims)
        cuts = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-own.count() // max(1, most * 3 // 4)))))
        # Blocks by a hash of the row: one with more anchors than planned is halved below.
        for cut in sorted(r[0] for r in own.select(cuts.alias("c")).distinct().collect()):
            got = own.filter(cuts == cut).select("row", "id", "label", "vec").toArrow()
            for k in range(0, got.num_rows, most):
                mine_block(table, books, got.slice(k, most).sort_by("row"), dims, out, positives, negatives, low, high, width)
    return spark.read.schema(schema).parquet(out)


def mine_block(table, books, got, dims, out, positives, negatives, low, high, width):
    """Append what a block of anchors finds."""
    spark = table.sparkSession
    row, ids, label = (got.column(i).to_numpy() for i in range(3))
    block = {"row": row, "label": label, "vec": matrix(got.column(3)), "dims": dims}
    every = np.arange(len(row))
    first = scan(table, books, block | {"of": every, "low": np.full(len(row), -np.inf), "high": np.full(len(row), np.inf)}, positives, same=True, width=width)
    pairs = first.select("key", "rank", "id", "score").orderBy("key", "rank").toArrow()  # `positives` rows an anchor of the block
    of, positive, score = pairs.column(0).to_numpy(), pairs.column(2).to_numpy(), pairs.column(3).to_numpy()
    # 100 times a score between low and high times the positive's: in whole numbers.
    floor, top = -(-(low * score) // 100), (high * score) // 100
    found = scan(table, books, block | {"of": of, "low": floor.astype(np.float64), "high": top.astype(np.float64)}, negatives, same=False, width=width)
    names = pa.table({"key": np.arange(len(of)), "anchor_id": ids[of], "positive_id": positive, "positive_score": score})
    made = found.join(F.broadcast(spark.createDataFrame(names)), "key")
    made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)


def op12(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), anchor=F.col("id") % 100 == 0, label=label)


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, b.r AS rb, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, k FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, rb) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id, rb) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
