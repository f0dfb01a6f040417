"""The corpus operators against brute force, and on nulls, empty tables, ties, repeated rows and odd columns."""

from __future__ import annotations

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrid.llm import components, decontam, langid, lines, nndescent, partenum, pieces, suffix, toxicity, urlfilter, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, rows, extra=True):
    """Rows of (id, text), with columns whose names might clash."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"n": F.lit(1), "label": F.lit("x"), "spans": F.lit(0), "node": F.lit(2)}) if extra else df


# 1: decontamination


def plain_hits(text, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = word(text), set(), set()
    for item, body in items:
        iw = word(body)
        if not iw:
            continue
        n = min(window, len(iw))
        cuts = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in cuts:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_windows_match_brute_force(spark, block):
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate([25, 12, 10, 9, 2, 1, 0, 40])] + [(17, None), (18, "É É, é!"), (19, "mu MU")]
    rows = [(70, "long " * 100_000 + items[7][1] + "z" * 100_000)] + [(k, prose(rng, rng.randrange(0, 60), WORDS[:6] if k % 2 else WORDS)) for k in range(25)] + [(100, None), (101, ""), (102, "..."), (103, "x " + items[0][1].upper() + " y"), (103, "x " + items[0][1]), (104, items[1][1] + ". " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(5))
    got = decontam.contamination(decontam.find_windows(docs(spark, rows), bench, block_windows=block)).collect()
    key = lambda r: tuple(map(str, r))
    ours = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key)
    theirs = []
    for i, t in rows:
        n, h, names = plain_hits(t, items)
        theirs.append((i, n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0))
    assert ours == sorted(theirs, key=key)
    kept = decontam.drop_contaminated(docs(spark, rows), bench, block_windows=block)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in rows if not plain_hits(t, items)[1])
    assert kept.columns == docs(spark, rows).columns


def test_windows_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id int, text string")
    r = decontam.contamination(decontam.find_windows(docs(spark, [(1, "a b")]), bench)).collect()
    assert [(x.n_words, x.n_hit, x.items_sha256) for x in r] == [(2, 0, hashlib.sha256(b"").hexdigest())]
    assert decontam.find_windows(docs(spark, []), bench).count() == 0
    assert decontam.drop_contaminated(docs(spark, [(1, "a")]), bench).count() == 1


# 2: suffix arrays


def plain_removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows):
        b, cover = t.encode(), bytearray(len(t.encode()))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                cover[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        out[i] = bytes(x for x, c in zip(b, cover) if not c)
    return out


@pytest.mark.parametrize("options", [{}, {"most": 2, "block": 4000}])
def test_repeats_match_brute_force(spark, options):
    rng = random.Random(2)
    passage = prose(rng, 40)
    rows = [(k, prose(rng, rng.randrange(5, 60)) + (passage[rng.randrange(20) :] if k % 3 == 0 else "") + "é" * (k % 4)) for k in range(30)]
    rows += [(50, "a" * 400), (51, "ab" * 150), (52, rows[1][1]), (53, None), (54, ""), (55, passage[:99]), (56, passage + passage), (57, "日本" * 60)]
    got = {r.doc_id: (bytes(r.kept), r.n_bytes) for r in suffix.remove_repeats(docs(spark, rows), **options).collect()}
    want = plain_removed(rows, 100)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(got[i][1] == len((t or "").encode()) for i, t in rows)


def test_repeats_of_repeated_ids_and_empty_tables(spark):
    rng = random.Random(3)
    a, b = prose(rng, 50), prose(rng, 50)
    got = suffix.remove_repeats(docs(spark, [(1, a), (1, a), (1, b), (2, a + b), (None, a), (None, None)])).collect()
    order = sorted([a, a, b])
    want = plain_removed([(k, t) for k, t in enumerate([*order, a + b])], 100)
    assert sorted((r.doc_id or 9, bytes(r.kept)) for r in got) == sorted([(1, want[k]) for k in range(3)] + [(2, want[3]), (9, a.encode()), (9, b"")])
    assert suffix.remove_repeats(docs(spark, [])).count() == 0
    assert [bytes(r.kept) for r in suffix.remove_repeats(docs(spark, [(1, "short")])).collect()] == [b"short"]


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdef ghij") for _ in range(1_200_000))
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in suffix.remove_repeats(docs(spark, [(1, long), (2, "x" * 300_000), (3, long[7:700_000])])).collect()}
    assert got == {1: (1_200_000, 1_200_000), 2: (300_000, 1), 3: (699_993, 0)}


@pytest.mark.parametrize("letters, length", [(b"ab", 12), (b"a", 100), (b"abc\0", 9), (b"ab", 100)])
def test_previous_factors_match_brute_force(letters, length):
    rng = random.Random(4)
    text = bytes(rng.choice(letters) for _ in range(300)) * 2
    starts = np.arange(len(text) - length + 1)
    got = suffix.previous_factors(np.frombuffer(text, np.uint8), starts, length)
    common = lambda i, j: next((k for k in range(length) if text[i + k] != text[j + k]), length)
    assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(len(starts))]
    assert suffix.previous_factors(np.frombuffer(text, np.uint8), starts, length, shorter=False).tolist() == [length * (v == length) for v in got.tolist()]


def test_smaller_positions_match_brute_force():
    rng = np.random.default_rng(14)
    for p in [rng.permutation(200), np.arange(50), np.arange(50)[::-1], np.zeros(0, int)]:
        assert suffix.smaller_before(p).tolist() == [next((j for j in range(i - 1, -1, -1) if p[j] < p[i]), -1) for i in range(len(p))]


def test_anchors_do_not_depend_on_chunks():
    rng = random.Random(5)
    text = prose(rng, 400).encode()
    covers = lambda found: {(int(h), int(p), w) for h, p, lo, hi in zip(*found) for w in range(lo, hi + 1)}
    assert covers(suffix.anchors(text)) == covers(suffix.anchors(text, chunk=257))
    assert len(suffix.anchors(text[:99])[0]) == 0


# 3: lines


def test_boilerplate_lines(spark):
    rows = [(k, "s", f"menu \nown {k}\n\nmenu") for k in range(20)] + [(20, "s", None), (21, "t", "menu"), (22, None, "menu\nmenu"), (23, "s", "")]
    pages = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumns({"line": F.lit(1), "host": F.lit("h")})
    got = {r.doc_id: (r.text, r["__n_lines"], r["__n_dropped"]) for r in lines.drop_boilerplate(pages, host="source", text="text", ratio=0.5, min_pages=5).collect()}
    assert got[3] == ("own 3\n", 4, 2) and got[20] == (None, 0, 0) and got[21][0] == "menu" and got[22][0] == "menu\nmenu" and got[23][0] == ""
    assert lines.drop_boilerplate(pages.limit(0), host="source", text="text").count() == 0
    found = lines.boilerplate(pages, host="source", text="text", ratio=0.5).collect()
    assert [(r.host, r.line, r.pages) for r in found] == [("s", "menu", 20)]


def test_lines_lose_all_white_space_at_their_ends_and_names_may_clash(spark):
    rows = [(k, "s", "x\r\n\t\n \x0b\nown %d" % k if k % 2 else "x\n\t\nown %d" % k) for k in range(10)] + [(3, "s", "x"), (20, "s", "y" * 200_000), (21, "t", "\t")]
    pages = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumns({"__host": F.lit(1), "__kept": F.lit(2), "__boiler": F.lit(3), "__line": F.lit(4)})
    done = lines.drop_boilerplate(pages, host="source", text="text", ratio=0.5)
    got = sorted((r.doc_id, r.text, r["__kept"]) for r in done.collect())
    want = sorted((k, t.replace("x\r\n", "").replace("x\n", "").replace("x", "") if k != 20 else t, 2) for k, _, t in rows)
    assert got == want and done.columns == [*pages.columns, "__n_lines", "__n_dropped"]


# 4: pieces


@pytest.fixture(scope="module")
def model():
    return pieces.model_of(pieces.MODEL)


def best_score(model, word):
    table = {p: model.scores[i] for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (1, 4)}
    text = word.decode()
    best = [0.0] + [-1e18] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            s = table.get(text[i:j].encode())
            if s is None and j == i + 1:
                s = model.unknown
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_viterbi_is_the_best_split(model):
    rng = random.Random(6)
    for text in [prose(rng, 1) + rng.choice(["", "é", "日", "\t", "!?"]) for _ in range(60)] + ["   x", "ßßß", "thethe"]:
        word = ("▁" + text.replace(" ", "▁")).encode()
        both = model.solve([word, b"a", word]) + [model.viterbi(word).tobytes(), model.viterbi(word, settle=4).tobytes()]
        assert len({*both[:1], *both[2:]}) == 1
        total = sum(model.scores[i] for i in np.frombuffer(both[0], np.int32) if model.kinds[i] != 6)
        covered = [c for c in word.decode() if c.encode() not in {p for p, k in zip(model.pieces, model.kinds) if k == 1}]
        assert total + model.unknown * len(covered) == pytest.approx(best_score(model, word))


def test_words_solved_together_or_alone_or_settled_agree(model):
    rng = random.Random(16)
    words = [("▁" + "".join(rng.choice("abcde ▁éß日\U0001f600") for _ in range(rng.randrange(1, 50))).replace(" ", "▁")).encode() for _ in range(400)]
    alone = [model.viterbi(w).tobytes() for w in words]
    assert model.solve(words) == alone == [model.viterbi(w, settle=7).tobytes() for w in words]


@pytest.mark.parametrize("letters", ["abcdefgh/+0123456789", "日本語の😀", "x"])
def test_a_megabyte_without_a_blank(model, letters):
    rng = random.Random(17)
    word = "".join(rng.choice(letters) for _ in range((1 << 20) // len(letters[0].encode()))).encode()
    ids = model.encode(word + b" the end")
    assert model.decode(ids.tolist()) == word + b" the end" and model.held < pieces.REMEMBERED
    assert (model.viterbi(word[: 60_000 - 60_000 % 12], settle=1 << 12) == model.viterbi(word[: 60_000 - 60_000 % 12], settle=1 << 40)).all()


def test_every_text_comes_back(spark, model):
    texts = ["", "a", "  two  blanks ", "▁literal▁", "line\n\nfeeds\t", "日本語 \U0001f600", "\x00", " ", "x" * 5000, None, "a"]
    got = pieces.decode(pieces.encode(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == texts and got[9].ids is None and got[0].ids == []
    assert got[1].ids == got[10].ids and got[1].label == "x"
    assert pieces.decode(pieces.encode(docs(spark, []))).count() == 0
    both = pieces.round_trip(docs(spark, list(enumerate(texts))).withColumn("exact", F.lit(3))).orderBy("doc_id").collect()
    assert [r.ids for r in both] == [r.ids for r in got] and all(r.exact is True for r in both)
    for t in texts[:9]:
        whole = model.decode(model.encode(t.encode()).tolist())
        assert whole == t.encode()


def test_trie_finds_exactly_its_words():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "日本", "日"])}
    t = pieces.Trie(words)

    def find(word):
        node = 0
        for b in word:
            child = t.base[node] + b
            if t.check[child] != node or child == 0:
                return -1
            node = child
        return t.value[node]

    assert {w: find(w) for w in words} == words
    assert [find(w) for w in (b"", b"c", b"abcd", "本".encode())] == [-1] * 4


# 5 and 7: learned ones


def test_language_by_held_out_rows(spark):
    rng = random.Random(7)
    tongues = {"x": ["the", "and", "thing", "other"], "y": ["der", "und", "nicht", "schon"]}
    rows = [(k, prose(rng, 30, tongues[lang]), lang) for k in range(200) for lang in [rng.choice("xy")]] + [(900, None, "x"), (901, "123 !!", "x"), (902, "", None), (903, "the thing", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(9))
    learned = langid.learn(df, langid.fold(F.col("doc_id")) != 0)
    got = {r.doc_id: r for r in langid.predict(df, learned).collect()}
    held = [r for r in rows[:200] if got[r[0]].lang_pred == r[2]]
    assert len(held) == 200 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "x"]
    none = langid.learn(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_centroids_and_scores_match_brute_force(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, 12, WORDS[: 6 + k % 9]), ["a", "b", "c"][k % 3]) for k in range(60)] + [(100, WORDS[0] * 40_000, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = langid.learn(df, F.lit(True))
    for r in langid.predict(df, m).collect():
        x = np.log1p(langid.counts_of(rows[-1][1].encode() if r.doc_id == 100 else rows[r.doc_id][1].encode()).astype(float)) * m["idf"]
        cos = [float(x @ c / np.linalg.norm(x)) for c in m["centroids"]]
        best = max(range(len(cos)), key=lambda j: (round(cos[j], 6), -j))
        low = cos[best] < m["floor"][best] - 1e-6
        assert max(cos) - cos[m["langs"].index(r.lang_pred) if cos[best] != cos[best] else best] < 1e-5 and m["langs"][best] == r.lang_pred
        if not abs(cos[best] - m["floor"][best]) < 1e-6:
            assert r.score == pytest.approx(cos[best] * 0.5 + (0 if low else 0.5), abs=1e-5) and r.rejected == low
    again = langid.predict(spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1])], "doc_id bigint, text string"), m).collect()
    assert len({(r.lang_pred, r.score) for r in again}) == 1 and len(again) == 3


def test_counts_are_clamped_before_they_are_narrowed():
    counts = np.zeros(langid.DIMS)
    counts[3], counts[9] = 70_000, 5
    at, n = np.frombuffer(langid.packed_counts(counts), np.uint16).reshape(2, -1)
    assert at.tolist() == [3, 9] and n.tolist() == [65_535, 5]


@pytest.mark.parametrize("text, letter", [("½ ² ①", False), ("Ⅷ 3", False), ("_-!", False), ("日", True), ("é", True), ("12a", True), ("\U0001f600", False)])
def test_letters_are_of_letter_categories(text, letter):
    assert langid.has_letter(text.encode()) is letter


def test_the_machine_matches_brute_force():
    rng = np.random.default_rng(22)
    model = {"bias": -0.5, "w": rng.normal(size=1 << toxicity.BITS).astype(np.float32), "v": rng.normal(size=(1 << toxicity.BITS, 8)).astype(np.float32)}
    words = b"you are a a a a fool and and more".split()
    terms = toxicity.terms_of(words, toxicity.Stems())
    want = -0.5 + sum(float(model["w"][t]) for t in terms)
    want += sum(float(model["v"][s].astype(float) @ model["v"][t].astype(float)) for i, s in enumerate(terms) for t in terms[:i])
    assert toxicity.margin(model, terms) == pytest.approx(want, rel=1e-4)
    assert len(toxicity.terms_of(b"a a a a".split(), toxicity.Stems())) == len(toxicity.COUNTS) and len(toxicity.terms_of(b"a a".split(), toxicity.Stems())) == 2


def test_toxic_at_the_threshold_goes_and_repeats_agree(spark):
    zero = {"bias": float(np.log(0.7 / 0.3)), "w": np.zeros(1 << toxicity.BITS, np.float32), "v": np.zeros((1 << toxicity.BITS, 8), np.float32)}
    df = docs(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "w " * 200_000)])
    got = toxicity.score(df, zero).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    cut = got[0].score
    assert toxicity.drop_toxic(df, zero, threshold=cut).count() == 0 and toxicity.drop_toxic(df, zero, threshold=cut + 1e-9).count() == 5


def test_a_share_under_a_millionth_still_draws_rows(spark):
    df = spark.range(12_000_000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    assert set(langid.learn(df, F.lit(True), sample=8)["langs"]) == {"en"}


def test_many_languages_are_fitted_on_the_executors(spark):
    """What comes to the driver is a few centroids for each language, and they are those of a fit by hand."""
    rng = random.Random(21)
    alphabets = {f"l{k:02d}": [chr(97 + (7 * k + i) % 26) + chr(97 + (3 * k + 5 * i) % 26) for i in range(6)] for k in range(40)}
    rows = [(1000 * k + n, " ".join("".join(rng.choice(a) for _ in range(3)) for _ in range(30)), lang) for k, (lang, a) in enumerate(alphabets.items()) for n in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    model = langid.learn(df, F.lit(True), centroids=2)
    assert sorted(set(model["langs"])) == sorted(alphabets) and len(model["centroids"]) == 80
    packed = {lang: [langid.packed_counts(langid.counts_of(t.encode())) for _, t, of in rows if of == lang] for lang in alphabets}
    seen = np.zeros(langid.DIMS)
    for r in sum(packed.values(), []):
        seen[np.frombuffer(r, np.uint16).reshape(2, -1)[0]] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    assert np.allclose(idf, model["idf"])
    for lang in ("l00", "l17", "l39"):
        c, floor = langid.fit_one(packed[lang], idf, 2)
        at = [k for k, x in enumerate(model["langs"]) if x == lang]
        assert np.allclose(c, [model["centroids"][k] for k in at]) and floor == pytest.approx([model["floor"][k] for k in at])
    got = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(rows)


def test_pairs_of_terms_count(spark):
    """Two words are each harmless, but toxic together: weights of single terms can't tell."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [prose(rng, 5)] + (["insultword"] if a else []) + (["groupname"] if b else [])
        rows.append((k, " ".join(words)))
        labels.append((k, int(a and b)))
    df, lab = docs(spark, rows), spark.createDataFrame(labels + [(5, 0), (None, 1), (7, None)], "doc_id bigint, toxic int").withColumn("text", F.lit("t"))
    learned = toxicity.learn(df, lab, toxicity.fold(F.col("__id")) != 1, epochs=120)
    got = {r.doc_id: r.score for r in toxicity.score(df, learned).collect()}
    truth = dict(labels)
    assert np.mean([(got[k] >= 0.5) == bool(truth[k]) for k in got]) > 0.97
    odd = toxicity.score(docs(spark, [(1, None), (2, ""), (3, "...")]), learned).collect()
    assert len({r.score for r in odd}) == 1
    kept = toxicity.drop_toxic(df, learned, threshold=0.5)
    assert {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s < 0.5} and kept.columns == df.columns


def test_one_class_or_no_labels(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score < 1e-3 for r in toxicity.score(df, toxicity.learn(df, none, F.lit(True))).collect())
    ones = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert all(r.score > 0.9 for r in toxicity.score(df, toxicity.learn(df, ones, F.lit(True))).collect())


# 6: Jaccard join


def plain_groups(rows, q=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + q]) for k in range(max(1, len(w) - q + 1))) if w else frozenset())
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    parent = list(range(len(flat)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(flat)):
        for y in range(x):
            a, b = flat[x][1], flat[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(flat):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, len(s), least[root(x)]) for x, (i, s) in enumerate(flat))


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "common": 5}])
def test_jaccard_groups_match_brute_force(spark, options):
    rng = random.Random(9)
    rows, passage = [], prose(rng, 30)
    for base in range(12):
        text = prose(rng, rng.choice([6, 20, 60, 200])).split()
        for copy in range(rng.choice([1, 2, 6])):
            own = list(text)
            for _ in range(copy):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(own) + (" " + passage if base % 2 else "")))
    rows += [(300 + k, " ".join(prose(rng, 4000).split()[: 3990 + k])) for k in range(2)] + [(302, "y" * 100_000), (303, "y" * 100_000)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "ONE  two"), (205, "one two three"), (3, rows[3][1]), (206, rows[0][1])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(docs(spark, rows), **options).collect())
    assert got == plain_groups(rows)
    kept = partenum.one_of_each(docs(spark, rows), **options)
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({c for _, _, c in got})
    assert partenum.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_decides_by_row_where_ids_repeat_or_are_null(spark):
    rng = random.Random(4)
    a, b, c, d, f = (prose(rng, 60) for _ in range(5))
    rows = [(1, a), (2, a + " once"), (2, b), (5, c), (5, c), (7, f), (7, f + " once"), (None, d), (None, d + " once"), (None, a + " twice"), (8, None), (8, None), (9, prose(rng, 60))]
    kept = [(r.doc_id, r.text) for r in partenum.one_of_each(docs(spark, rows)).collect()]
    assert sorted((i or 0 for i, _ in kept)) == [0, 1, 2, 5, 7, 8, 8, 9] and (2, b) in kept
    assert {t for i, t in kept if i is None} < {d, d + " once"}


def test_signatures_of_similar_sets_meet():
    """Any two sets that link share a signature, whatever is left out as common."""
    rng = np.random.default_rng(10)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        only = max(0, int((n / 0.8) - n))
        k = int(rng.integers(0, only + 1))
        extra = rng.integers(0, 1 << 63, only, dtype=np.uint64)
        a, b = np.unique(np.concatenate((both, extra[:k]))), np.unique(np.concatenate((both, extra[k:])))
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        common = np.sort(both[: int(rng.integers(0, n + 1))])
        assert len(np.intersect1d(partenum.signatures(a, common), partenum.signatures(b, common)))
        assert partenum.may_link(len(a), partenum.sketch(a), len(b), partenum.sketch(b))


def test_word_codes_do_not_depend_on_pieces():
    text = ("é " * 50 + prose(random.Random(11), 300) + "  \t tail").encode()
    want = partenum.word_codes(text)
    assert len(want) == len(text.split()) and (partenum.word_codes(text, 64) == want).all()
    assert len(partenum.word_codes(b"")) == len(partenum.word_codes(b" \n ")) == 0


def test_words_that_a_polynomial_hash_confuses_stay_apart(spark):
    """Thue-Morse words of 1,024 letters: their polynomial hashes modulo 2**64 agree at every odd base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in partenum.near_duplicates(docs(spark, [(1, word), (2, other), (3, other)])).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_hashes_that_agree_do_not_link(monkeypatch):
    """Where all hashes agree, the words decide."""
    monkeypatch.setattr(partenum, "word_codes", lambda text, piece=0: np.arange(len(text.split()), dtype=np.uint64))
    one, two = (" ".join(f"{w}{k}" for k in range(40)).encode() for w in "ab")
    assert not partenum.Words(one, 5).linked(partenum.Words(two, 5)) and partenum.Words(one, 5).linked(partenum.Words(b"  " + one.upper().replace(b" ", b"\n "), 5))


def test_shortened_names_that_agree_lose_no_link(spark, monkeypatch):
    """With names cut to two bits, nearly all nodes are twins of others."""
    rng = random.Random(19)
    base = [prose(rng, 60) for _ in range(8)]
    rows = [(k, base[k % 8] + (f" x{k}" if k > 7 else "")) for k in range(24)] + [(90, "lone words here")]
    monkeypatch.setattr(partenum, "short_of", lambda node: node[0] & 3)
    monkeypatch.setattr(partenum, "SHORT", "cast(conv(hex(substring(node, 1, 1)), 16, 10) as bigint) & 3")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(docs(spark, rows)).collect())
    assert got == plain_groups(rows)


def test_signatures_reduced_in_small_parts_and_many_blocks(spark, monkeypatch):
    rng = random.Random(20)
    base = [prose(rng, 80, [f"w{k}" for k in range(300)]) for _ in range(5)]
    rows = [(k, base[k % 5].replace("w1", "v", k % 3)) for k in range(60)]
    for size in (64, 1 << 20):
        monkeypatch.setattr(partenum, "SIGNED", size)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(docs(spark, rows).repartition(7)).collect())
        assert got == plain_groups(rows)


def test_components_of_a_long_chain(spark):
    n = 70
    links = spark.createDataFrame([(k + 1, k) for k in range(1, n)] + [(500, 501), (501, 501), (500, 501)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {k: 1 for k in range(1, n + 1)} | {500: 500, 501: 500}
    assert components.components(links.limit(0)).count() == 0


# 8: archives


def test_archives_come_back(spark, tmp_path):
    long = "z" * 300
    rows = [(3, "http://a/ b", long), (1, "http://b/", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é" * 60), (1, "u", long), (None, "u", "q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit(0))
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    kind = sorted((r.record_id, r.record_type, r.refers_to or "") for r in got)
    assert kind == sorted([("urn:page:1", "response", "")] * 2 + [("urn:page:2", "revisit", "urn:page:1"), ("urn:page:3", "revisit", "urn:page:1")] + [(f"urn:page:{k}", "response", "") for k in (4, 5, 6, 7, "")])
    by = {r.record_id: r for r in got}
    assert bytes(by["urn:page:7"].payload) == ("é" * 60).encode() and by["urn:page:3"].payload_bytes == 300 and by["urn:page:3"].target_uri == "http://a/%20b"
    assert by["urn:page:2"].payload_digest == hashlib.sha256(long.encode()).hexdigest() and by["urn:page:6"].payload_bytes == 0
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == len(rows)


def test_archives_tell_damage(spark, tmp_path):
    record = warc.member("response", "urn:page:1", "http://x", None, "2024-01-01T00:00:00Z", b"body", hashlib.sha256(b"body").hexdigest())
    assert warc.parse(next(warc.members([record])))["digest_ok"]
    wrong = warc.gz(gzip.decompress(record).replace(b"body", b"bodY"))
    assert not warc.parse(next(warc.members([wrong])))["digest_ok"]
    with pytest.raises(ValueError):
        list(warc.members([record[:-20]]))
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(record)[:-6])
    two = list(warc.members([bytes([b]) for b in record + record]))
    assert len(two) == 2 and two[0] == two[1]
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("whole_bytes", [0, 1 << 26])
def test_archives_of_any_name_and_size(spark, tmp_path, whole_bytes):
    rng = random.Random(8)
    bodies = [b"", b"\n", b"\r\n\r\nWARC/1.1\r\n", b"x\n\n", bytes(rng.randrange(256) for _ in range(5000)), b"a" * (17 << 20)] + [bytes(rng.randrange(256) for _ in range(rng.randrange(200))) for _ in range(60)]
    record = lambda k, b: warc.member("response", f"urn:page:{k}", "http://x", None, "2024-01-01T00:00:00Z", b, hashlib.sha256(b).hexdigest())
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "crawl.warc.gz").write_bytes(b"".join(record(k, b) for k, b in enumerate(bodies[:40])) + warc.gz(b""))
    (tmp_path / "in" / "deep" / "second.warc.gz").write_bytes(b"".join(record(k + 40, b) for k, b in enumerate(bodies[40:])))
    got = warc.read_warc(spark, str(tmp_path / "in"), whole_bytes=whole_bytes).collect()
    assert sorted((int(r.record_id[9:]), bytes(r.payload)) for r in got) == list(enumerate(bodies)) and all(r.digest_ok for r in got)
    assert warc.read_warc(spark, str(tmp_path / "in"), pattern="crawl*", whole_bytes=whole_bytes).count() == 40
    (tmp_path / "in" / "cut.gz").write_bytes(gzip.compress(gzip.decompress(record(99, b"text"))[:-8]))
    with pytest.raises(Exception, match="inside a record|doesn't have the length"):
        warc.read_warc(spark, str(tmp_path / "in"), whole_bytes=whole_bytes).count()


def test_long_lines_are_held_a_record_at_a_time():
    """What the line-wise reader holds is one record, however many an archive has."""
    import tracemalloc

    body = b"z" * (1 << 20)
    text = gzip.decompress(warc.member("response", "urn:page:1", "http://x", None, "2024-01-01T00:00:00Z", body, hashlib.sha256(body).hexdigest()))
    many = (line for _ in range(100) for line in text.split(b"\n")[:-1])
    tracemalloc.start()
    assert sum(warc.parse(r)["digest_ok"] for r in warc.records(many)) == 100
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_archives_of_clashing_columns_and_long_payloads(spark, tmp_path):
    rows = [(1, "u", "y" * (17 << 20)), (2, "u", "y" * (17 << 20)), (3, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("__least", "__key", "__id", "id", "d", "n", "p", "__payload")})
    warc.write_warc(pages, str(tmp_path / "w"))
    got = sorted((r.record_id, r.record_type, r.payload_bytes, r.digest_ok) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [("urn:page:1", "response", 17 << 20, True), ("urn:page:2", "revisit", 17 << 20, True), ("urn:page:3", "response", 5, True)]
    kept = warc.with_revisits(pages)
    assert kept.filter("__first = 1").count() == 1 and {"__least", "__key", "__id"} <= set(kept.columns)


# 9: embeddings


@pytest.mark.parametrize("options", [{}, {"bucket": 8, "k": 2}])
def test_embedding_links_match_brute_force(spark, options):
    rng = np.random.default_rng(12)
    rows = []
    for c in range(25):
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 2, 5, 14]))):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.05).astype(float).tolist(), c % 3))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, [0.0] * 16, 0), (903, None, 0), (904, [float("nan")] * 16, 0), (905, rows[0][1], None), (906, [None] * 16, 0), (907, [1.0], 0), (908, [2.0], 0), (909, [], 0), (910, [1e200] * 16, 0), (911, [1e-200] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"node": F.lit(1), "n": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(df, **options).collect()}
    unit = {}
    for i, v, lab in rows:
        if lab is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (lab, x / np.linalg.norm(x))
    near = {i: {j for j, (m, y) in unit.items() if j != i and m == lab and len(x) == len(y) and x @ y >= 0.93} for i, (lab, x) in unit.items()}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j), todo.append(j)
        assert got[i] == (len(near.get(i, ())), min(seen), min(seen) == i), i
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"bucket": 8}])
def test_dense_groups_are_bridged_although_their_lists_are_full(spark, options):
    rng = np.random.default_rng(3)
    turn = np.arccos(0.96)
    rows = []
    for g in range(3):  # a chain of groups, cosine 0.96 from one to the next, each of more vectors than a list holds
        base = np.r_[np.cos(g * turn), np.sin(g * turn), np.zeros(14)]
        rows += [(len(rows) + i, (base + rng.normal(size=16) * 0.004).tolist(), 0) for i in range(12)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(df, **options).collect()}
    assert min(near) == 23 and got == {i: (near[i], 0, i == 0) for i in range(36)}


def test_audit_finds_the_few_pairs_of_a_large_label(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 24, 2):  # 12 pairs of cosine 0.935 among vectors without a link
        y = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = 0.935 * x[i] + np.sqrt(1 - 0.935**2) * y / np.linalg.norm(y)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(df, bucket=64, tables=1).collect()}
    assert got == {i: (1, i - i % 2, i % 2 == 0) if i < 24 else (0, i, True) for i in range(3000)}


# 10: URL lists


def test_lists_as_of_the_fetch(spark):
    entries = [("bad.example.com", "2024-01-10", True), ("bad.example.com", "2024-02-10", False), ("example.com", "2024-03-01", True), ("example.com", "2024-03-05", False), ("example.com", "2024-03-05", True), ("example.com", "2024-03-07", False), (None, "2024-01-01", True), ("x.org", None, True), ("LOCALHOST", "2024-01-01", True)]
    e = spark.createDataFrame(entries, "key string, date string, adds boolean").withColumn("date", F.col("date").cast("date"))
    asked = [("http://bad.example.com/a", "2024-01-09"), ("http://BAD.example.com:80/a", "2024-01-10"), ("https://u@bad.example.com", "2024-02-09"), ("http://bad.example.com/", "2024-02-10"), ("http://bad.example.com/", "2024-03-02"), ("http://other.example.com", "2024-03-06"), ("http://other.example.com", "2024-03-07"), ("nourl", "2024-03-06"), (None, "2024-03-06"), ("http://example.com", None), ("http://localhost/x", "2024-05-05"), ("http://localhost/x", "2024-05-05")]
    c = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "i int, url string, fetched string").withColumns({"fetched": F.col("fetched").cast("date"), "key": F.lit("k"), "at": F.lit(0)})
    got = urlfilter.evaluate(c, e).orderBy("i").collect()
    assert [r.blocked for r in got] == [False, True, True, False, True, True, False, False, False, False, True, True]
    assert got[4].rule == "example.com" and got[1].rule == "bad.example.com" and got[1].n_active == 1
    assert not any(r.blocked for r in urlfilter.evaluate(c, e.limit(0)).collect()) and urlfilter.evaluate(c.limit(0), e).count() == 0


def test_addresses_and_the_root_domain(spark):
    entries = [("3.4", True), ("9.9.9.9", True), ("[::1]", True), ("example.com.", True), ("", True), (".", True)]
    e = spark.createDataFrame(entries, "key string, adds boolean").withColumn("date", F.lit("2024-01-01").cast("date"))
    urls = ["http://1.2.3.4/", "http://9.9.9.9:80/x", "http://[::1]:8080/", "http://[::2]/", "http://example.com./a", "http://a.example.com", "http://./", "http://1.2.3.4.example.com/"]
    c = spark.createDataFrame(list(enumerate(urls)), "i int, url string").withColumns({"fetched": F.lit("2024-01-02").cast("date"), "__host": F.lit("h"), "__date": F.lit(1), "__top": F.lit(2), "blocked": F.lit("old")})
    got = urlfilter.evaluate(c, e).orderBy("i").collect()
    assert [r.blocked for r in got] == [False, True, True, False, True, True, False, True] and got[0]["__host"] == "h"
    assert [r.host for r in got][:5] == ["1.2.3.4", "9.9.9.9", "[::1]", "[::2]", "example.com"] and got[6].host is None


def test_native_operators_run_no_python(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "a\nb", "http://a.b/")], "doc_id int, source string, text string, url string").withColumn("fetched", F.current_date())
    e = spark.createDataFrame([("a.b", True)], "key string, adds boolean").withColumn("date", F.current_date())
    for out in (lines.drop_boilerplate(df, host="source", text="text"), urlfilter.evaluate(df, e)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stars_hold_each_pair_once_over_many_blocks(spark):
    """Near copies share signatures of most blocks; their pair is a row once, and the blocks together lose none."""
    rng = np.random.default_rng(8)
    words = [[f"w{v}" for v in rng.integers(0, 10**9, 120)] for _ in range(12)]
    texts = [" ".join(w[:k] + ["other"] + w[k:]) for w in words for k in (20, 60, 100)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    none = np.empty(0, np.uint64)
    got = [[(r.a, r.b) for r in partenum.starred(partenum.signed(docs, "text", 5, none, blocks), blocks).filter(F.col("across") == across).collect()] for across in (False, True) for blocks in (1, 40)]
    assert all(len(x) == len(set(x)) for x in got)
    assert set(got[0]) == set(got[1]) and set(got[2]) == set(got[3]) and got[0] + got[2]
