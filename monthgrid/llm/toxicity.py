"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed into a fixed space of 2**18: its words and their beginnings (for inflected
insults), each once for every number of occurrences in COUNTS that it reaches.  No term is left out.  The machine has
a bias, a weight for each term and a vector of `factors` numbers for each term whose dot products weigh pairs of terms,
so that an insult beside a mention of a group can count for more than the two apart.  A term enters with a value
between -1 and 1: how surely it tells the classes apart in the sample (its z score over `sure`), so that the
many that tell nothing add nothing.  The machine is trained here by sparse gradients, on at most about `sample`
labelled rows (drawn by a hash of the id from all rows allowed for learning); scoring is one pass without a shuffle
over every whole text.

Defined results: null, empty and wordless texts get the score of the bias alone; without labels of both
classes the score is the share of toxic labels (0 without any); labels repeated for an id count once, toxic if
any says so; null labels and ids teach nothing; repeated rows get one result each, texts of equal terms the same
score, a score at the threshold is toxic; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import in_slices, released, settled, small_batches, small_side, texts, written
from .decontam import words_of

SAMPLE, FACTORS, BITS, SURE = 5_000, 8, 18, 6.0
THRESHOLD = 0.7
#: A stem is a term for each of these numbers of occurrences that a text reaches.
COUNTS = (1, 2, 4)


def stems_of(word: bytes) -> np.ndarray:
    """The hashes of a word and of its beginnings of 4 to 8 bytes."""
    cut = [word + b"$"] + [word[:n] for n in range(4, min(9, len(word)))]
    return np.array([xxhash.xxh3_64_intdigest(x) & 0xFFFFFFFF for x in cut], np.uint32)


class Stems(dict):
    """Words to their stems, remembered up to a bound."""

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) >= 1 << 16:
            self.clear()
        found = stems_of(word)
        if len(word) < 100:
            self[word] = found
        return found


def terms_of(words: list[bytes], stems: Stems) -> np.ndarray:
    """The sorted terms of a text."""
    if not words:
        return np.empty(0, np.uint32)
    times = Counter(words)
    found = [stems[w] for w in times]
    stem, n = np.concatenate(found), np.repeat(np.fromiter(times.values(), np.int64, len(times)), list(map(len, found)))
    order = np.argsort(stem)
    stem, n = stem[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], stem[1:] != stem[:-1])))
    stem, n = stem[cut], np.add.reduceat(n, cut)
    return np.unique(np.concatenate([(stem[n >= least] * np.uint32(2 * i + 1) ^ np.uint32(i * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS) for i, least in enumerate(COUNTS)]))


def values_of(rows: list[np.ndarray], labels: np.ndarray, sure: float = SURE) -> np.ndarray:
    """The value of each term: its z score for the toxic class over `sure`, within -1 and 1; 0 for unseen ones."""
    share = labels.mean()
    count = lambda picked: np.bincount(np.concatenate(picked) if picked else np.empty(0, np.int64), minlength=1 << BITS)
    n, k = count(rows), count([r for r, y in zip(rows, labels) if y])
    return np.clip((k - n * share) / np.sqrt(n * share * (1 - share) + 1) / sure, -1, 1).astype(np.float32)


def train(rows: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, epochs: int = 10, rate: float = 0.3, decay: float = 1e-4, toxic_weight: float = 3.0, seed: int = 7) -> dict:
    """Fit on the logistic loss by steps that shrink with a parameter's past gradients; rows: the terms of each text."""
    share, size = float(labels.mean()), 1 << BITS
    rng = np.random.default_rng(seed)
    value = values_of(rows, labels)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.01, (size, factors)).astype(np.float32)
    past_b, past_w, past_v = 1e-2, np.full(size, 1e-2, np.float32), np.full((size, factors), 1e-2, np.float32)
    batches = []
    order = rng.permutation(len(rows))
    for k in range(0, len(order), 64):
        own = [rows[i] for i in order[k : k + 64]]
        of, term = np.repeat(np.arange(len(own), dtype=np.int32), list(map(len, own))), np.concatenate(own).astype(np.int32)
        by = np.argsort(term, kind="stable").astype(np.int32)
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), np.diff(term[by]) > 0)))
        batches.append((term[by], of[by], cut, labels[order[k : k + 64]]))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            term, of, cut, y = batches[k]
            if not len(term):
                continue
            x, own = value[term], term[cut]
            part = v[term] * x[:, None]
            total = lambda z: np.stack([np.bincount(of, z[:, j], len(y)) for j in range(z.shape[1])], axis=1).astype(np.float32)
            xv = total(part)
            raw = bias + np.bincount(of, w[term] * x, len(y)) + 0.5 * (xv**2 - total(part**2)).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * np.where(y > 0, toxic_weight, 1) / len(y)).astype(np.float32)
            gx = g[of] * x
            grad_w = np.add.reduceat(gx, cut) + decay * w[own]
            grad_v = np.add.reduceat(gx[:, None] * (xv[of] - part), cut) + decay * v[own]
            past_b, past_w[own], past_v[own] = past_b + g.sum() ** 2, past_w[own] + grad_w**2, past_v[own] + grad_v**2
            bias -= rate * float(g.sum()) / past_b**0.5
            w[own] -= rate * grad_w / np.sqrt(past_w[own])
            v[own] -= rate * grad_v / np.sqrt(past_v[own])
    return {"bias": bias, "w": w * value, "v": v * value[:, None]}


def margin(model: dict, terms: np.ndarray) -> float:
    """The machine's output for a text."""
    v = model["v"][terms]
    return model["bias"] + float(model["w"][terms].sum(dtype=np.float64)) + 0.5 * float((v.sum(axis=0, dtype=np.float64) ** 2).sum() - (v.astype(np.float64) ** 2).sum())


def probability(model: dict, words: list[bytes], stems: Stems) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin(model, terms_of(words, stems)) if words else model["bias"], -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, allowed, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, **options) -> dict:
    """Train on the labelled rows for which `allowed` (a condition on __id) holds."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & allowed)
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    n = known.count()
    # Two hashes give the draw the 52 bits of a double, for any number of labels.
    fine = F.pmod(F.xxhash64("__id", F.lit(12)), F.lit(1 << 32)) / float(1 << 32)
    part = (F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 20)) + fine) / float(1 << 20) < min(1.0, sample / max(n, 1))
    drawn = small_side(written(known.filter(part), "labels"))

    def present(batches):
        z, stems = zstandard.ZstdCompressor(level=3), Stems()
        for batch in in_slices(batches, 1):
            out = [terms_of(words_of(t), stems) for t in texts(batch.column(1))]
            steps = [z.compress(np.diff(r, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for r in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps, pa.binary())], names=["y", "at"])

    read = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(drawn, "__id").select("__y", "__text")
    got = read.mapInArrow(released(present), "y int, at binary").collect()  # about `sample` rows of some hundred numbers
    got.sort(key=lambda r: (r.y, bytes(r.at)))
    y = np.array([r.y for r in got], float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        level = min(max(share, 1e-6), 1 - 1e-6)
        return {"bias": float(np.log(level / (1 - level))), "w": np.zeros(1 << BITS, np.float32), "v": np.zeros((1 << BITS, FACTORS), np.float32)}
    z = zstandard.ZstdDecompressor()
    rows = [np.cumsum(np.frombuffer(z.decompress(r.at), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32) for r in got]
    del got
    model = train(rows, y, **options)
    del rows
    settled(docs.sparkSession)
    return model


def score(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, stems = shared.value, Stems()
        for batch in in_slices(batches, 1):
            out = [probability(model, words_of(t), stems) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=batch.schema.names[:1] + ["score"])

    read = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string"))
    return read.mapInArrow(released(run), f"__id {read.schema[0].dataType.simpleString()}, score double").withColumnRenamed("__id", doc_id)


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def op7(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, fold(F.col("__id")) != 1)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: dict, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs scored under the threshold, in one pass; all columns kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text)

    def run(batches):
        model, stems = shared.value, Stems()
        for batch in in_slices(batches, at_text):
            yield batch.filter(pa.array([probability(model, words_of(t), stems) < threshold for t in texts(batch.column(at_text))], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
