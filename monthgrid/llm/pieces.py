"""SentencePiece encoding and decoding: a unigram Viterbi over a double-array trie of pieces.

The pieces and their log scores are read from a model file whose path is a parameter; nothing is trained.  A
text gets a leading blank (if the model says so), blanks become the marker U+2581, and the split with the
largest sum of scores is taken; of equal sums, the one whose last piece starts first.  A character that no piece
covers costs the smallest score less 10 and is written as its bytes.  Since no piece holds a marker after
another character (checked on loading; a line feed likewise), the best split of a text is the best splits of
its blank-led words one after another.  Short words are solved together, once, and remembered up to a number of
bytes; a word over `LONG` bytes is solved alone, and its split is settled and let go of wherever all paths that are
still open share it.  So time is linear in the text, and what is held besides the ids doesn't grow with a word.

The double array is built once, on the driver, and sent to the workers as 32-bit arrays.

Decoding joins the pieces, turns markers to blanks, byte pieces to their bytes, and takes the leading blank
away.  A U+2581 in the text itself is written as bytes, so that every text comes back exactly.

Defined results: null gives null; an empty text gives no ids (as the model's library does) and comes back
empty; repeated rows get one result each; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import in_slices, released, small_batches, texts

MARKER = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of words and ids that a worker remembers; bytes of a word that is solved alone; bytes between two settlings.
REMEMBERED, LONG, SETTLE = 16 << 20, 128, 1 << 15


def fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Trie:
    """A double-array trie over bytes: the child of a node by b is base[node] + b if check there names the node."""

    def __init__(self, words: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for word, value in words.items():
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = value
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        slot, free, hint = {0: 0}, 257, 257  # only children fill the holes; families are placed further and further on
        check[0] = 0
        for node, below in enumerate(children):  # parents come before their children
            at = slot[node]
            value[at] = values[node]
            if not below:
                continue
            codes = sorted(below)
            while free < len(check) and check[free] >= 0:
                free += 1
            start = max(free if len(codes) == 1 else hint, codes[0] + 1)
            while True:
                b = start - codes[0]
                need = b + codes[-1] + 1
                if need > len(check):
                    more = need - len(check) + 4096
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[b + c] < 0 for c in codes):
                    break
                start += 1
            base[at] = b
            hint = hint if len(codes) == 1 else start
            for c in codes:
                check[b + c] = at
                slot[below[c]] = b + c
        pad = [-1] * 256  # no look-up leaves the arrays
        self.base, self.check, self.value = (np.array(x + pad, np.int32) for x in (base, check, value))


class Pieces:
    """The pieces of a model file, and what decoding shows for each."""

    def __init__(self, data: bytes) -> None:
        self.pieces, self.scores, self.kinds, self.prefix = [], [], [], True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b""))
                self.scores.append(float(piece.get(2, 0.0)))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without normalisation are read")
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.shown = [p.replace(MARKER, b" ") if k in (NORMAL, USER_DEFINED) else bytes([int(p[3:5], 16)]) if k == BYTE else b"" for p, k in zip(self.pieces, self.kinds)]
        self.shown[self.unk] = " ⁇ ".encode()

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.shown.__getitem__, ids))
        return text[1:] if self.prefix and text[:1] == b" " else text


class Model(Pieces):
    """Pieces with the trie; and the words that were solved so far."""

    def __init__(self, data: bytes) -> None:
        super().__init__(data)
        words = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED)}
        plain = [self.scores[i] for i in words.values() if self.kinds[i] == NORMAL]
        low, high = min(plain, default=0.0), max(plain, default=0.0)
        for p, i in words.items():
            if self.kinds[i] == USER_DEFINED:
                self.scores[i] = len(p.decode()) * high - 0.1
        self.unknown = low - 10.0
        self.trie = Trie(words)
        self.weights = np.array(self.scores)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.apart = all(MARKER not in p.lstrip(b"\xe2\x96\x81") for p in words)
        self.feed = all(b"\n" not in p for p in words)
        self.prepare()

    def prepare(self) -> None:
        self.cut = re.compile((rb"\n| *[^ \n]+| +" if self.feed else rb" *[^ ]+| +") if self.apart else rb"(?s).+").findall
        self.solved: dict[bytes, bytes] = {}
        self.held = 0
        t = self.trie
        self.views = tuple(map(memoryview, (t.base, t.check, t.value, self.weights)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cut", "solved", "held", "views")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.prepare()

    def viterbi(self, word: bytes, settle: int = SETTLE) -> np.ndarray:
        """The best ids of a word whose blanks are markers.

        All open paths end within a character or a piece's length of the place that is reached.  Every `settle` bytes
        they are followed back to where they meet; the path up to there can't change any more."""
        base, check, value, scores = self.views
        n, low = len(word), -np.inf
        best, begin, piece = (array(kind, [v]) for kind, v in (("d", 0.0), ("q", 0), ("i", -1)))
        out, zero, i, due = [], 0, 0, settle  # slot 0 of the arrays stands for the place `zero`
        while i < n:
            here = best[i - zero]
            if here == low:
                i += 1
                continue
            b = word[i]
            end = min(n, i + (1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4))
            node, j, alone = 0, i, False
            while j < n:
                child = base[node] + word[j]
                if check[child] != node or child == 0:
                    break
                node = child
                j += 1
                v = value[node]
                if v >= 0:
                    s = here + scores[v]
                    at = j - zero
                    while at >= len(best):
                        best.append(low), begin.append(0), piece.append(-1)
                    if s > best[at]:
                        best[at], begin[at], piece[at] = s, i, v
                    alone |= j == end
            if not alone:
                s = here + self.unknown
                at = end - zero
                while at >= len(best):
                    best.append(low), begin.append(0), piece.append(-1)
                if s > best[at]:
                    best[at], begin[at], piece[at] = s, i, -1
            i += 1
            if i >= due and i < n:
                open_ = {p for p in range(i, zero + len(best)) if best[p - zero] > low}
                while len(open_) > 1:
                    last = max(open_)
                    open_.remove(last)
                    open_.add(begin[last - zero] if last > zero else zero)
                meet = open_.pop()
                if meet > zero:
                    out.append(self.path(word, begin, piece, zero, meet))
                    del best[: meet - zero], begin[: meet - zero], piece[: meet - zero]
                    zero = meet
                    i = max(i, meet)
                due = i + settle
        out.append(self.path(word, begin, piece, zero, n))
        return np.concatenate(out)

    def path(self, word: bytes, begin, piece, zero: int, at: int) -> np.ndarray:
        """The ids of the best path from `zero` to `at`."""
        out = array("i")
        while at > zero:
            i, v = begin[at - zero], piece[at - zero]
            if v >= 0:
                out.append(v)
            else:
                out.extend([self.byte.get(b, self.unk) for b in reversed(word[i:at])] if self.byte else [self.unk])
            at = i
        return np.array(out, np.int32)[::-1]

    def solve(self, words: list[bytes]) -> list[bytes]:
        """The ids of short words, as bytes: the same steps as viterbi's, taken for all words at once."""
        t = self.trie
        base, check, value, scores = t.base, t.check, t.value, self.weights
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))  # the words still to go on with come first
        words = [words[k] for k in order]
        size = np.array([len(w) for w in words])
        going = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # at i: words of more than i bytes
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        begin = np.cumsum(size) - size  # of each word's bytes; one more slot a word for its end
        slot = begin + np.arange(len(words))
        best = np.full(len(text) + len(words), -np.inf)
        best[slot] = 0.0
        start, piece = np.zeros(len(best), np.int32), np.full(len(best), -1, np.int32)
        for i in range(int(size[0])):
            word = np.flatnonzero(best[slot[: going[i]] + i] > -np.inf)
            here = best[slot[word] + i]
            first = text[begin[word] + i]
            end = np.minimum(size[word], i + np.where(first < 128, 1, np.where(first < 224, 2, np.where(first < 240, 3, 4))))
            alone = np.zeros(len(word), bool)
            at, node, j = np.arange(len(word)), np.zeros(len(word), np.int32), i
            while len(at):
                more = size[word[at]] > j
                at, node = at[more], node[more]
                child = base[node] + text[begin[word[at]] + j]
                found = (check[child] == node) & (child != 0)
                at, node = at[found], child[found]
                j += 1
                v = value[node]
                is_piece = v >= 0
                w, v = at[is_piece], v[is_piece]
                to, total = slot[word[w]] + j, here[w] + scores[v]
                better = total > best[to]
                best[to[better]], start[to[better]], piece[to[better]] = total[better], i, v[better]
                alone[w] |= end[w] == j
            w = np.flatnonzero(~alone)
            to, total = slot[word[w]] + end[w], here[w] + self.unknown
            better = total > best[to]
            best[to[better]], start[to[better]], piece[to[better]] = total[better], i, -1
        word, at, steps = np.arange(len(words)), size.copy(), []
        while len(word):
            to = slot[word] + at
            steps.append((word, at, piece[to]))
            at = start[to].astype(np.int64)
            word, at = word[at > 0], at[at > 0]
        word, at, ids = (np.concatenate(x) for x in zip(*steps))
        by = np.lexsort((at, word))
        word, ids = word[by], ids[by].astype(np.int32)
        cut = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        odd = set(word[ids < 0].tolist())
        data, out = ids.tobytes(), [b""] * len(words)
        for k, w in enumerate(words):
            out[order[k]] = self.viterbi(w).tobytes() if k in odd else data[4 * cut[k] : 4 * cut[k + 1]]
        return out

    def learnt(self, words) -> dict[bytes, bytes]:
        """The ids of each of some words: remembered, solved together, or (long ones) one by one and not remembered."""
        out, fresh = {}, []
        for w in words:
            if (known := self.solved.get(w)) is not None:
                out[w] = known
            elif len(w) > LONG:
                out[w] = self.viterbi(w.replace(b" ", MARKER)).tobytes()
            else:
                fresh.append(w)
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            found = self.solve([w.replace(b" ", MARKER) for w in part])
            out.update(zip(part, found))
            self.held += sum(map(len, part)) + sum(map(len, found)) + 200 * len(part)
            if self.held > REMEMBERED:
                self.solved.clear()
                self.held = 0
            else:
                self.solved.update(zip(part, found))
        return out

    def encode_many(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        literal = np.array([self.byte.get(b, self.unk) for b in MARKER], np.int32).tobytes()
        lead = b" " if self.prefix else b""
        split = [[self.cut(part) for part in (lead + t).split(MARKER)] if t else None for t in texts]
        get = self.learnt({w for parts in split if parts for part in parts for w in part}).__getitem__
        return [
            None if t is None else np.frombuffer(literal.join(b"".join(map(get, part)) for part in parts), np.int32) if parts else np.empty(0, np.int32)
            for t, parts in zip(texts, split)
        ]

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    """The model of a file, built once on the driver."""
    with open(path, "rb") as f:
        return Model(f.read())


def extended(df: DataFrame, run, *new: T.StructField) -> DataFrame:
    return df.mapInArrow(released(run), T.StructType([*[f for f in df.schema if f.name not in {n.name for n in new}], *new]))


def put(batch, **values):
    keep = [i for i, n in enumerate(batch.schema.names) if n not in values]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(values.values()), names=[batch.schema.names[i] for i in keep] + list(values))


def lists(values: list) -> pa.ListArray:
    """Arrays of ids, or None, as an Arrow column."""
    ends = np.cumsum([0] + [0 if v is None else len(v) for v in values]).astype(np.int32)
    flat = np.concatenate([v for v in values if v is not None] or [np.empty(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([v is None for v in values], pa.bool_()))


def shown(model: Pieces, values: list) -> pa.Array:
    """The decoded texts of arrays of ids, or None."""
    return pa.array([None if v is None else model.decode(v.tolist()).decode("utf-8", "replace") for v in values], pa.string())


def encode(docs: DataFrame, *, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with a column of ids; the model file is read on the driver and sent along."""
    small_batches(docs.sparkSession, 128)
    shared = docs.sparkSession.sparkContext.broadcast(model_of(model))
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in in_slices(batches, at):
            yield put(batch, **{ids: lists(m.encode_many(texts(batch.column(at))))})

    return extended(docs, run, T.StructField(ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, *, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs with a column of decoded texts."""
    small_batches(docs.sparkSession, 128)
    shared = docs.sparkSession.sparkContext.broadcast(model_of(model))
    at = docs.columns.index(ids)

    def run(batches):
        m = shared.value
        for batch in batches:
            yield put(batch, **{text: shown(m, [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in batch.column(at)])})

    return extended(docs, run, T.StructField(text, T.StringType()))


def round_trip(docs: DataFrame, *, text: str = "text", ids: str = "ids", exact: str = "exact", model: str = MODEL) -> DataFrame:
    """docs with the ids of each text and whether their decoding gives the text back, byte for byte, in one pass."""
    small_batches(docs.sparkSession, 128)
    shared = docs.sparkSession.sparkContext.broadcast(model_of(model))
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in in_slices(batches, at):
            given = texts(batch.column(at))
            values = m.encode_many(given)
            same = [t is None if v is None else m.decode(v.tolist()) == t for t, v in zip(given, values)]
            yield put(batch, **{ids: lists(values), exact: pa.array(same, pa.bool_())})

    return extended(docs, run, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(exact, T.BooleanType()))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "exact")
