"""Language ID by nearest centroid of TF-IDF n-gram vectors.

A text is the vector of its hashed byte trigrams (lower-cased; digits, marks and blanks are one separator),
weighted by ln(1 + tf) * idf and normalised.  Each language has several centroids, found by spherical k-means
over a sample of about `sample` rows; the prediction is the language of the nearest centroid by cosine.  A
text whose cosine is under what nearly all training rows of that centroid reach is `rejected`, and its score
is scaled down below 0.5.  Scoring is one pass without a shuffle over every whole text.

Defined results: null texts and texts without a letter are `und` with score 0; rows with a null language or
text teach nothing; with nothing learned (a table without rows, say) every text is `und`; very long texts are counted whole; equal cosines go to the language first by name;
repeated rows get one result each; a null id is drawn and held out by none; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import forget, in_slices, released, small_batches, small_side, texts, written

SAMPLE, CENTROIDS, DIMS, REJECT = 800, 4, 1 << 13, 0.005
LATIN = re.compile(rb"[A-Za-z]")
PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    """Whether a text has a character of a Unicode letter category."""
    return bool(LATIN.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def counts_of(text: bytes) -> np.ndarray:
    """Trigram counts of a whole text."""
    b = np.frombuffer(b" " + text.decode("utf-8", "replace").lower().encode().translate(PLAIN) + b" ", np.uint8)
    blank = b == 32
    if blank.any():
        b = b[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(b) < 3:
        return np.zeros(DIMS)
    code = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x27D4EB2F)
    return np.bincount((code >> np.uint32(19)).astype(np.int64), minlength=DIMS)


def packed_counts(counts: np.ndarray) -> bytes:
    """The places of counts over 0, then the counts (65,535 at most), as 16-bit numbers."""
    at = np.flatnonzero(counts)
    return np.concatenate((at, np.minimum(counts[at], 65535))).astype(np.uint16).tobytes()


def vectors(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors; with `out` (which may be counts itself) in place."""
    x = np.log1p(counts, out=out, dtype=np.float32)
    x *= idf.astype(np.float32)
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    return x


def clusters(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means; the start: rows far from those chosen so far."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(rng.choice(np.argsort(near, kind="stable")[: max(1, len(x) // 4)])))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (mine == j).any():
                mean = x[mine == j].mean(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def fit_one(packed: list[bytes], idf: np.ndarray, centroids: int = CENTROIDS) -> tuple[np.ndarray, list[float]]:
    """A language's centroids, and the cosine that nearly all its rows reach to each, from packed counts."""
    counts = np.zeros((len(packed), DIMS), np.float32)
    for row, r in zip(counts, sorted(packed)):
        at, n = np.frombuffer(r, np.uint16).reshape(2, -1)
        row[at] = n
    own = vectors(counts, idf, counts)
    c = clusters(own, centroids)
    cos = own @ c.T
    best, mine = cos.max(axis=1), cos.argmax(axis=1)
    return c, [float(np.quantile(best[mine == j], REJECT)) if (mine == j).any() else 0.0 for j in range(len(c))]


def learn(docs: DataFrame, allowed, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """Fit on about `sample` rows of each language, drawn by a hash of the id among those `allowed`.

    A language is one group of its bounded sample and is fitted on the executors; to the driver come four centroids of 32 kB for
    each language, and the document counts of the terms."""
    small_batches(docs.sparkSession)
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("__lang"), F.col(text).cast("string").alias("__text"), F.col(doc_id).alias("__id"))
    sizes = written(rows.groupBy(F.col("__lang").alias("__of")).count(), "languages")
    # Two hashes give the draw the 52 bits of a double, for languages of any size.
    fine = F.pmod(F.xxhash64("__id", F.lit(6)), F.lit(1 << 32)) / float(1 << 32)
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    drawn = rows.join(small_side(sizes), F.col("__lang") == F.col("__of")).filter((F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1_000_000)) + fine) / 1e6 < share)

    def pack(batches):
        for batch in batches:
            packed = [packed_counts(counts_of(t)) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["lang", "counts"])

    def present(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for r in batch.column(0).to_pylist():
                df[np.frombuffer(r, np.uint16).reshape(2, -1)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["at", "n"])

    packed = written(drawn.select("__lang", "__text").mapInArrow(released(pack), "lang string, counts binary"), "counts")
    found = packed.select("counts").mapInArrow(present, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row a term
    df = np.zeros(DIMS, np.int64)
    total = 0
    for r in found:
        if r.at < 0:
            total = r.n
        else:
            df[r.at] = r.n
    if not total:
        forget(sizes, packed)
        return {"idf": np.ones(DIMS), "langs": [], "centroids": [], "floor": []}
    idf = np.log((1 + total) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fit(table: pa.Table) -> pa.Table:
        c, floor = fit_one(table.column("counts").to_pylist(), shared.value, centroids)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c)), "k": pa.array(range(len(c)), pa.int32()), "centroid": pa.array([x.tobytes() for x in c], pa.binary()), "floor": pa.array(floor)})

    made = packed.groupBy("lang").applyInArrow(fit, "lang string, k int, centroid binary, floor double").collect()
    forget(sizes, packed)
    made.sort(key=lambda r: (r.lang, r.k))
    return {"idf": idf, "langs": [r.lang for r in made], "centroids": [np.frombuffer(r.centroid, np.float32) for r in made], "floor": [r.floor for r in made]}


def predict(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        idf, langs, floor = model["idf"], model["langs"], np.array(model["floor"])
        c = np.array(model["centroids"]).T if langs else None
        for batch in in_slices(batches, 1):
            names, scores, rejected = [], [], []
            for t in texts(batch.column(1)):
                if not t or c is None or not has_letter(t):
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                cos = vectors(counts_of(t), idf) @ c
                j = int(cos.argmax())
                best, low = float(np.clip(cos[j], 0, 1)), bool(cos[j] < floor[j])
                names.append(langs[j]), rejected.append(low)
                scores.append(best * 0.5 if low else 0.5 + best * 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["__id", "lang_pred", "score", "rejected"],
            )

    read = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string"))
    kind = read.schema[0].dataType.simpleString()
    return read.mapInArrow(released(run), f"__id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("__id", doc_id)


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, fold(F.col("doc_id")) != 0)
    return predict(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
