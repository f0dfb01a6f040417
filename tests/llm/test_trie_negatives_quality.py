"""Operators 11 to 13 against brute force, and on nulls, empty tables, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrid.llm import negatives, prefixtrie, quality

TURNS = "conv_id bigint, turn bigint, role string, text string"

# 11: the trie


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]


def plain_trie(rows):
    convs: dict[int, list] = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r[2], r[3]))):
        convs.setdefault(c, []).append((role or "", text or ""))
    nodes: dict[tuple, list] = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - (c - int(np.fix(c / 5)) * 5), [])
        turns = tuple(base[:h] + own[h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append((c, len(turns) == d))
    children = Counter(k[:-1] for k in nodes if k)
    cost = {k: (len(m) - 1) * (len(k[-1][1].encode()) if k else 0) for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(str(c) for c, end in sorted(m) if end)
        parent = min(nodes[k[:-1]])[0] if k else None
        out.append((min(m)[0], len(k), parent, len(m), children[k], sum(not children[x] for x in under), sum(cost[x] for x in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [18, 1024])
def test_trie_matches_brute_force(spark, block):
    rng = random.Random(11)
    said = ["yes", "no", "é" * 5, "", None, "z" * 70_000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in [*range(-7, 40), 10**12] for t in range(rng.randrange(0, 7))]
    same = [(t, "user", rng.choice("ab")) for t in range(30)]
    rows += [(c, *x) for c in (45, 46, 47, 49, 55) for x in same[: 30 - (c % 5) * (c % 3)]]  # long copies, cut at different places
    rows += [(60, None, "user", "first"), (60, 0, "user", "second"), (60, 0, "user", "second"), (None, 0, "user", "nobody"), (63, 5, None, None)]
    rows += [(k, 0, "user", "hub") for k in range(100, 130)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"node": F.lit(1), "top": F.lit("x"), "depth": F.lit(3)}).repartition(5)
    got = prefixtrie.trie(df, block=block).drop("node", "parent").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(5, t, "user", str(t % 3)) for t in range(300)] + [(6, t, "user", str(t % 3)) for t in range(299)]
    got = prefixtrie.trie(spark.createDataFrame(rows, TURNS), block=18).drop("node", "parent").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)
    assert prefixtrie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


# 12: negatives

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_negatives(rows, every=100):
    kept = []
    for i, v, lab in rows:
        if None in (i, lab) or v is None or not len(v) or None in v or not np.isfinite(np.array(v, np.float32)).all():
            continue
        q = np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)
        kept.append((i, q, int(np.fmod(lab + 1, 10)) if i % 7 == 0 else lab))
    out = []
    for n, (a, q, lab) in enumerate(kept):
        if a % every:
            continue
        others = sorted(((-int(q @ p), i, own) for m, (i, p, own) in enumerate(kept) if m != n and len(p) == len(q)), key=lambda r: r[:2])
        for s, i, _ in [r for r in others if r[2] == lab][:5]:
            inside = [(t, j) for t, j, own in others if own != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, i, k, j, -s, -t) for k, (t, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"width": 3, "centroids": 3, "sample": 20, "block": 2}])
def test_negatives_match_brute_force(spark, options):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 10))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=10)).round(2).tolist(), int(rng.integers(0, 4))) for i in range(600)]
    rows += [(700 + k, rows[k][1], rows[k][2]) for k in range(12)]  # equal vectors: ties
    rows += [(800, None, 1), (801, [], 1), (802, [float("nan")] * 10, 1), (803, [1.0] * 9 + [None], 1), (804, [1.0] * 10, None), (None, [1.0] * 10, 1), (900, [0.0] * 10, 2), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [0.5, 1.0], 2), (-100, [1.0] * 10, 3)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit(7), "row": F.lit("x"), "codes": F.lit(None).cast("int")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mined(df, anchor=F.col("id") % 100 == 0, label=label, **options).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_negatives_of_repeated_rows_and_empty_tables(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.5, 0.0], 2)]
    got = negatives.mined(spark.createDataFrame(rows, VECTORS), anchor=F.col("id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(100, 100, 1, 1, 65536, 32768)] * 2
    assert negatives.mined(spark.createDataFrame([], VECTORS), anchor=F.col("id") % 100 == 0).count() == 0
    huge = [(100, [3e38, 3e38], 1), (101, [3e38, 1.0], 1), (200, [262000.0, 0.0], 1), (201, [262000.0, 0.0], 1), (1, [131000.0, 1.0], 2)]
    got = negatives.mined(spark.createDataFrame(huge, VECTORS), anchor=F.col("id") % 100 == 0).collect()
    assert [tuple(r)[:2] + tuple(r)[3:] for r in got] == [(200, 201, 1, (262000 * 256) ** 2, 262000 * 131000 * 65536)]


def test_bounds_hold_and_pass_over_most_rows():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(2000, 16)))
    books = negatives.codebooks(x[:500])
    codes, rest = negatives.encoded(x, books)
    near = sum(x[:20, at] @ c[k].T for at, c, k in zip(negatives.parts(16, 2), books, codes.T))
    off = np.abs(x[:20] @ x.T - near)
    bound = np.sqrt((x[:20] ** 2).sum(axis=1))[:, None] * rest
    assert (off <= bound + 1e-6).all() and np.median(bound) < 0.25 * np.median(np.abs(x[:20] @ x.T).max(axis=1))


# 13: quality rules


def plain_quality(rows, top=quality.TOP, least=quality.LEAST_REFERENCE):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.translate(lower)).split(" ")
    kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t" else 4 if c in "\n\v\f\r" else 5 if c in ".,;:!?'\"()-" else 9 if ord(c) < 128 else 6 if ord(c) < 0x800 else 7 if ord(c) < 0x10000 else 8
    classes = lambda t: [sum(kind(c) == k for c in t) for k in range(10)]
    words, shares = {}, {}
    for _, lang, t in rows:
        if lang is not None:
            words.setdefault(lang, Counter()).update(w for w in plain(t or "") if w)
            if len(t or "") >= 200:
                shares.setdefault(lang, []).append([n * 1000 // len(t) for n in classes(t)])

    def js(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        return sum(0.5 * sum(x * np.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x > 0) for a, b in ((p, q), (q, p))) ** 0.5

    out = []
    for i, lang, t in rows:
        t = t or ""
        own = t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
        own = [w for w in own if w]
        wins = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
        hit = {j for k in range(len(own) - 7) if wins[tuple(own[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        known, ws = words.get(lang, Counter()), [w for w in plain(t) if w]
        ref = sum(known.values()) >= least and lang is not None
        tops = sorted(known.items(), key=lambda x: (-x[1], x[0].encode()))[:top]
        a = js(classes(t), np.median(shares[lang], axis=0) + 0.5) if ref and len(t) >= 200 else None
        b = js([ws.count(w) for w, _ in tops] + [len(ws) - sum(ws.count(w) for w, _ in tops)], [n for _, n in tops] + [sum(known.values()) - sum(n for _, n in tops)]) if ref and len(ws) >= 50 else None
        failed = len(own) < 20 or 100 * len(hit) > 30 * len(own)
        kept = not failed and (a or 0) <= quality.CHARS_LIMIT and (b or 0) <= quality.WORDS_LIMIT
        out.append((i, len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), a, b, failed, kept))
    return out


def test_quality_matches_brute_force(spark):
    rng = random.Random(13)
    vocabulary = ["the", "of", "and", "naïve", "日本", "word", "Xy", "a1", "𝄞"] + [f"w{k}" for k in range(60)]
    text = lambda n, mark="": " ".join(rng.choice(vocabulary) + mark for _ in range(n))
    rows = [(k, rng.choice(["en", "en", "fr"]), text(rng.randrange(15, 120))) for k in range(80)]
    rows += [(100, "en", text(60, "%%%")), (101, "en", None), (102, None, text(80)), (103, "xx", text(40)), (104, "fr", ""), (105, "en", "same line here\n" * 40), (106, "en", text(30) + "\n\t\v \n" + text(40) + "\r\n| | |\n| | |")]
    rows += [(107, "en", "tick " * 50), (108, "fr", text(20_000)), (3, "en", rows[3][2]), (109, "en", "one two three four five six seven eight " * 2 + text(60)), (110, "en", "...!!! " * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumns({"of": F.lit("x"), "words": F.lit(1), "classes": F.lit(2), "n_words": F.lit(3)})
    got = quality.judged(df).select("doc_id", *(c.split()[0] for c in quality.MEASURES.split(", ")), "js_chars", "js_words", "base_failed", "kept").collect()
    key = lambda r: (r[0], str(r))
    for ours, theirs in zip(sorted(map(tuple, got), key=key), sorted(plain_quality(rows), key=key), strict=True):
        assert ours[:6] == theirs[:6] and ours[8:] == theirs[8:]
        assert ours[6:8] == pytest.approx(theirs[6:8], abs=1e-9) if None not in theirs[6:8] else [x is None for x in ours[6:8]] == [x is None for x in theirs[6:8]]


def test_quality_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert quality.judged(df).count() == 0
    one = quality.judged(spark.createDataFrame([(None, None, "a b " * 30)], df.schema)).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in one] == [(60, True, False)]
