"""Quality rules by distribution divergence: documents against references of their language.

A document is two histograms: its characters by class (CLASSES), and its words by the `top` most common words of its
language and all others.  The references are the same histograms of the language: for each class the median of its
shares in all documents long enough to be judged (in steps of 1 / BINS, so that junk, short or long, hardly moves them),
and the words of all documents, ranked by count, then by word; both are counts summed in tasks, then by key.  A document is rejected when the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) to a reference exceeds its limit.  Short texts
are far from any reference by chance, so there are guards: under `least_chars` characters the first histogram isn't
judged, under `least_words` words the second isn't, and a language of under `least_reference` words in all has no
reference.  Base rules come first: too few words, or too many words inside repeated windows of eight.

Words of the base rules are runs of all but ASCII white space; those of the histograms are lower-cased runs of
letters, digits and non-ASCII characters.  One pass over whole texts counts, a second one judges; no text is shuffled.
References are one row a language, broadcast under a measured bound and else joined by the language.

Defined results: a null or empty text has no words and fails the base rules; a null language, or one without a
reference, is judged by the base rules alone; a distance that no guard lets through is null; a distance at its limit
is kept; very long texts are read whole, in time near linear in their length; repeated rows get one result each; an
empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtools import in_slices, released, small_batches, small_side, texts, written
from .decontam import words_of

TOP, LEAST_CHARS, LEAST_WORDS, LEAST_REFERENCE = 50, 200, 50, 1000
CHARS_LIMIT, WORDS_LIMIT, BINS = 0.18, 0.55, 1000
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SPACE, SYMBOLS, MARKS = b" \t\n\v\f\r", b"#*$%&|<>", b".,;:!?'\"()-"
#: Character classes, each by a test of a character's first byte; whatever no test takes (controls, other ASCII marks) is "other".
CLASSES = {
    "lower": lambda b: 97 <= b <= 122, "upper": lambda b: 65 <= b <= 90, "digit": lambda b: 48 <= b <= 57, "blank": lambda b: b in b" \t",
    "break": lambda b: b in b"\n\v\f\r", "mark": lambda b: b in MARKS, "two": lambda b: 0xC0 <= b < 0xE0, "three": lambda b: 0xE0 <= b < 0xF0, "four": lambda b: b >= 0xF0,
}
OTHER = len(CLASSES)
#: For each byte its class; bytes inside a character have none.
CLASS_OF = np.array([next((k for k, test in enumerate(CLASSES.values()) if test(b)), OTHER) if not 0x80 <= b < 0xC0 else OTHER + 1 for b in range(256)])
#: For each byte: whether it begins a character of a word.
IN_WORD = np.array([not 0x80 <= b < 0xC0 and b not in SPACE for b in range(256)])
IS_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def class_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_OF, counts, OTHER + 2)[: OTHER + 1].astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of `window` words (a power of two) that the text holds twice or more."""
    if len(words) <= window:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    span, kinds = 1, len(index)
    while span < window:  # windows of twice the span are pairs of windows
        _, ids = np.unique(ids[:-span] * kinds + ids[span:], return_inverse=True)
        span, kinds = 2 * span, int(ids.max()) + 1
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + window, minlength=len(words) + 1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(text: bytes, counts: np.ndarray) -> tuple[int, ...]:
    words = text.split()
    return len(words), int(counts[IN_WORD].sum()), int(counts[IS_SYMBOL].sum()), duplicate_lines(text), repeated_words(words)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms of positive sums."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST_REFERENCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(of, classes, words, word_counts): a row for each language of at least `least` words.  classes holds medians and half a
    step for what is rarer, and is null without a document long enough; word_counts ends with all other words."""
    small_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, list] = {}
        kept = 0

        def rows():
            out = [(of, "", int(c), int(n)) for of, (bins, _) in held.items() for c, n in zip(np.flatnonzero(bins), bins[bins > 0])]
            out += [(of, w, -1, n) for of, (_, words) in held.items() for w, n in words.items()]
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.int64()))], names=["of", "word", "class", "n"])

        for batch in in_slices(batches, 1):
            for of, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if t:
                    bins, words = held.setdefault(of, [np.zeros((OTHER + 1) * (BINS + 1), np.int64), Counter()])
                    classes = class_counts(byte_counts(t))
                    if (size := int(classes.sum())) >= max(1, least_chars):
                        bins[np.arange(OTHER + 1) * (BINS + 1) + classes * BINS // size] += 1
                    words.update(words_of(t))
                    kept += len(t)
            # A task sums up a while before it sends, by text read: that bounds what it holds.
            if kept > 16 << 20:
                yield rows()
                held, kept = {}, 0
        yield rows()

    read = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    counts = read.mapInArrow(released(count), "of string, word binary, class int, n bigint")
    counts = written(counts.groupBy("of", "class", "word").agg(F.sum("n").alias("n")), "histograms")
    words = counts.filter("class < 0")
    rank = F.row_number().over(W.partitionBy("of").orderBy(F.desc("n"), "word"))
    tops = (
        words.withColumn("k", rank).filter(F.col("k") <= top).groupBy("of")
        .agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("t"))
    )
    totals = words.groupBy("of").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    kind, share = F.floor(F.col("class") / (BINS + 1)), F.col("class") % (BINS + 1)
    middle = counts.filter("class >= 0").groupBy("of", kind.alias("k")).agg((F.percentile(share, F.lit(0.5), F.col("n")) + 0.5).alias("m"))
    classes = middle.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("c"))
    others = F.col("total") - F.aggregate("t.n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return totals.join(tops, "of").join(classes, "of", "left").select(
        "of", F.col("c.m").alias("classes"),
        F.col("t.word").alias("words"), F.concat("t.n", F.array(others)).alias("word_counts"),
    )


def measured(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, the base counts, js_chars, js_words) of each row; a distance is null where a guard holds it back."""
    small_batches(docs.sparkSession)

    def judge(batches):
        known: dict[str, tuple] = {}
        for batch in in_slices(batches, 1):
            out, chars, common = [], [], []
            langs = batch.column(2).to_pylist()
            for k, t in enumerate(texts(batch.column(1))):
                t, of = t or b"", langs[k]
                counts = byte_counts(t)
                out.append(measures(t, counts))
                if of is not None and of not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[of] = (np.array(batch.column(3)[k].as_py()), batch.column(4)[k].as_py(), np.array(batch.column(5)[k].as_py()))
                mine, own = class_counts(counts), words_of(t)
                chars.append(distance(mine, known[of][0]) if of is not None and mine.sum() >= max(1, least_chars) and known[of][0].ndim else None)
                if of is None or len(own) < max(1, least_words):
                    common.append(None)
                    continue
                times = Counter(own)
                best = [times[w] for w in known[of][1]]
                common.append(distance(np.array([*best, len(own) - sum(best)]), known[of][2]))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(chars, pa.float64()), pa.array(common, pa.float64())], names=["__id", *(f"m{k}" for k in range(7))])

    read = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang"))
    joined = read.join(small_side(found), F.col("__lang") == F.col("of"), "left").select("__id", "__text", "of", "classes", "words", "word_counts")
    kind = read.schema[0].dataType.simpleString()
    return joined.mapInArrow(released(judge), f"__id {kind}, {MEASURES}, js_chars double, js_words double").withColumnRenamed("__id", doc_id)


def judged(docs: DataFrame, *, chars_limit: float = CHARS_LIMIT, words_limit: float = WORDS_LIMIT, text: str = "text", lang: str = "lang", top: int = TOP, least_reference: int = LEAST_REFERENCE, **options) -> DataFrame:
    """The measures of each row with base_failed and kept."""
    found = written(references(docs, text=text, lang=lang, top=top, least=least_reference, least_chars=options.get("least_chars", LEAST_CHARS)), "references")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    near = (F.coalesce("js_chars", F.lit(0.0)) <= chars_limit) & (F.coalesce("js_words", F.lit(0.0)) <= words_limit)
    return measured(docs, found, text=text, lang=lang, **options).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)


def op13(spark, sf_dir: str) -> DataFrame:
    done = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    return done.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_words")})


def class_sql() -> str:
    """The length of a text's characters of each class, in the order of CLASSES, then all others."""
    sets = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t]", r"[\n\x0B\f\r]", r"[.,;:!?\x27\x22()\-]", r"[\x{80}-\x{7FF}]", r"[\x{800}-\x{FFFF}]", r"[\x{10000}-\x{10FFFF}]"]
    each = [f"length(text) - length(regexp_replace(text, '{x}', '', 'g'))" for x in sets]
    return "[" + ", ".join([*each, "length(text) - (" + " + ".join(f"({e})" for e in each) + ")"]) + "]"


def distance_sql(p: str, q: str) -> str:
    """The distance of two lists of shares of one length."""
    half = "list_sum(list_transform(range(1, len({0}) + 1), lambda k: CASE WHEN {0}[k] > 0 THEN {0}[k] * log2({0}[k] / (({1}[k] + {2}[k]) / 2)) ELSE 0.0 END))"
    return f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(0.0, ({half.format(p, p, q)} + {half.format(q, p, q)}) / 2)) END"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS cs FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
t AS (SELECT r, i FROM g JOIN (SELECT r, win FROM g GROUP BY r, win HAVING count(*) > 1) USING (r, win)),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM t) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
c AS (SELECT r, lang, text, {class_sql()} AS h FROM d),
rc AS (SELECT lang, list(s ORDER BY k) AS h FROM (SELECT lang, k, quantile_cont(n * {BINS} // size, 0.5) + 0.5 AS s FROM (SELECT lang, length(text) AS size, unnest(range(1, {OTHER + 2})) AS k, unnest(h) AS n FROM c WHERE lang IS NOT NULL AND length(text) >= {LEAST_CHARS}) GROUP BY lang, k) GROUP BY lang),
u AS (SELECT r, lang, unnest(cs) AS word FROM w),
n AS (SELECT lang, word, count(*) AS n FROM u WHERE lang IS NOT NULL GROUP BY lang, word),
tot AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang HAVING sum(n) >= {LEAST_REFERENCE}),
top AS (SELECT lang, word, n, k FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM n) WHERE k <= {TOP}),
rw AS (SELECT lang, list(CAST(n AS DOUBLE) / total ORDER BY k) AS q, 1 - sum(n) / CAST(max(total) AS DOUBLE) AS other FROM top JOIN tot USING (lang) GROUP BY lang),
dw AS (SELECT r, list(CAST(n AS DOUBLE) ORDER BY k) AS p, sum(n) AS s FROM (SELECT w.r, top.k, count(u.word) AS n FROM w JOIN top USING (lang) LEFT JOIN u ON u.r = w.r AND u.word = top.word GROUP BY w.r, top.k) GROUP BY r),
x AS (SELECT w.r, w.doc_id, len(ws) AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  CASE WHEN tot.lang IS NOT NULL AND length(w.text) >= {LEAST_CHARS} THEN list_transform(c.h, lambda v: v / CAST(length(w.text) AS DOUBLE)) END AS pc, list_transform(rc.h, lambda v: v / CAST(list_sum(rc.h) AS DOUBLE)) AS qc,
  CASE WHEN tot.lang IS NOT NULL AND len(cs) >= {LEAST_WORDS} THEN list_append(list_transform(dw.p, lambda v: v / len(cs)), (len(cs) - dw.s) / CAST(len(cs) AS DOUBLE)) END AS pw, list_append(rw.q, rw.other) AS qw
  FROM w JOIN c ON c.r = w.r LEFT JOIN dup ON dup.r = w.r LEFT JOIN rep ON rep.r = w.r LEFT JOIN tot ON tot.lang = w.lang LEFT JOIN rc ON rc.lang = w.lang LEFT JOIN rw ON rw.lang = w.lang LEFT JOIN dw ON dw.r = w.r),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, {distance_sql('pc', 'qc')} AS jc, {distance_sql('pw', 'qw')} AS jw FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  round(jc, 6) AS js_chars, round(jw, 6) AS js_words, base_failed, NOT base_failed AND coalesce(jc, 0) <= {CHARS_LIMIT} AND coalesce(jw, 0) <= {WORDS_LIMIT} AS kept FROM j
"""
