"""Text scalars: periods, names, bodies, URLs and dates, as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and their short forms, in the order in which they are tried.
MONTHS = {
    "январь": 1, "янв": 1, "февраль": 2, "фев": 2, "март": 3, "апрель": 4, "апр": 4, "май": 5, "июнь": 6,
    "июль": 7, "август": 8, "сентябрь": 9, "октябрь": 10, "ноябрь": 11, "декабрь": 12,
}


def parse_period(c: Column) -> Column:
    """The month start that a period text names anywhere: a month's name before a year, YYYYMmm, YYYY-mm, mm.YYYY; or that it is
    as a whole: a year, else a day-first date.  Years are of this century but in whole dates; numbers of months are read whole."""

    month, full = r"(1[0-2]|0?[1-9])(?!\d)", r"(20\d{2})"
    names, ahead = "|".join(MONTHS), r"[^0-9]*(20\d{2})"
    # At the first of the names, in their order, that has a year ahead of it: that name and the year.
    named = "^(?:" + "|".join(rf"[\s\S]*?(?={name}{ahead.replace('(', '(?:')})" for name in MONTHS) + f")({names}){ahead}"
    ymm, dotted, alone = full + r"\s*[m/.\-]\s*" + month, r"(?<!\d)(1[0-2]|0?[1-9])\s*[./\-]\s*" + full, "^" + full + r"\s*(?:год|г)?$"
    number = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    parsed = lambda t, *forms: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in forms])

    def read(t: Column) -> Column:
        part = lambda p, g: F.regexp_extract(t, p, g)
        start = lambda y, m: F.make_date(y.cast("int"), m.cast("int"), F.lit(1))
        # What is cast or parsed is looked at before: a failure costs an exception, even where it gives a null.
        day_first = F.when(t.contains("."), parsed(t, "d.M.yyyy")).when(t.contains("/"), parsed(t, "d/M/yyyy")).otherwise(parsed(t, "d-M-yyyy", "yyyy-M-d", "yyyy-M"))
        return (
            F.when(t.rlike(f"(?:{names}){ahead}"), start(part(named, 2), number[part(named, 1)]))
            .when(t.rlike(ymm), start(part(ymm, 1), part(ymm, 2))).when(t.rlike(dotted), start(part(dotted, 2), part(dotted, 1)))
            .when(t.rlike(alone), start(part(alone, 1), F.lit(1)))
            .when(t.rlike(r"^[+\-]?\d+([./\-])[+\-]?\d+(?:\1[+\-]?\d+)?$"), F.trunc(day_first, "month"))
        )

    # The folded text is bound once; written out at each of its uses, a few columns outgrow what Java compiles as one method.
    return F.transform(F.array(F.translate(F.lower(F.trim(c)), "ё", "е")), read)[0]


# Names of regions that are written in several ways, cleaned, and their keys.
REGION_ALIASES = {
    "чувашская республика чувашия": "чувашия",
    "чувашская республика — чувашия": "чувашия",
    "чувашская республика - чувашия": "чувашия",
    "г санкт петербург": "санкт-петербург",
    "город санкт петербург": "санкт-петербург",
    "москва город": "москва",
}
# Words that say what kind a region is.
REGION_KINDS = ["область", "край", "республика", "автономная область", "автономный округ", "ао"]
#: Characters whose compatible form is one other character, and those forms; by Unicode's rule.
COMPATIBLE = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(0xA0, 0x10000) if not 0xD800 <= i < 0xE000]
COMPATIBLE = [(a, b) for a, b in COMPATIBLE if a != b and len(b) == 1]
#: Letters that are often written as a letter and a mark.
COMPOSED = {"и\u0306": "й", "И\u0306": "Й", "е\u0308": "ё", "Е\u0308": "Ё"}


def clean_place(c: Column) -> Column:
    """A place name in compatible characters and lower case, without brackets, footnote marks and marks at its ends."""
    t = F.translate(F.coalesce(c, F.lit("")), *("".join(x) for x in zip(*COMPATIBLE)))
    for written, letter in COMPOSED.items():
        t = F.replace(t, F.lit(written), F.lit(letter))
    t = F.translate(F.lower(t), "ё\ufeff", "е")
    t = F.translate(F.regexp_replace(t, r"[\[\]()*†‡]+", " "), "—–", "--")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .,;:'\"\-]+|[ .,;:'\"\-]+$", "")


def bare(t: Column) -> Column:
    """Without a leading sign of a town, odd blanks, and dashes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^г\.?\s+", ""), r"\s+", " "), r"^[ \-]+|[ \-]+$", "")


def region_key(c: Column) -> Column:
    """A region's name without words for its kind; known other names become one."""
    t = clean_place(c)
    kinds = r"(?<![\p{L}\p{N}_])(?:" + "|".join(REGION_KINDS) + r")(?![\p{L}\p{N}_])"
    out = bare(F.regexp_replace(F.regexp_replace(t, r"^г\.?\s+", ""), kinds, ""))
    for alias, name in REGION_ALIASES.items():
        out = F.when(t == alias, name).otherwise(out)
    return out


def geo_key(region: Column, name: Column) -> Column:
    """A municipality's key: its name with its kind and number, after its region's key where there is one."""
    known = region_key(region)
    return F.when(known != "", F.concat_ws("::", known, bare(clean_place(name)))).otherwise(bare(clean_place(name)))


def unescaped(t: Column) -> Column:
    """All character references of HTML undone, named ones and those by number.  Only texts with an ampersand leave the JVM."""
    @F.pandas_udf("string")
    def undone(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.coalesce(undone(F.when(t.contains("&"), t)), t)


def clean_text(c: Column, limit: int = 2000) -> Column:
    """Character references undone, tags, URLs and NULs to blanks, white space collapsed, cut at `limit`."""
    t = F.regexp_replace(unescaped(c), "\\x00", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?i)(?:https?://|www\.)\S+", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+", " ")), 1, limit)


def normal_url(c: Column) -> Column:
    """An http(s) URL with lower-case scheme and host, without query and fragment; a leading www. gets https."""
    t = F.trim(c)
    t = F.when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)
    p = r"^([hH][tT][tT][pP][sS]?)://([^/?#\s]+)([^?#\s]*)"
    host = F.regexp_extract(t, p, 2)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(t, p, 1)), F.lit("://"), F.lower(host), F.regexp_extract(t, p, 3)))


def parse_when(c: Column, zone: str = "Europe/Moscow") -> Column:
    """Epoch seconds or milliseconds (1e11 and over) in digits, or ISO text with or without offset, as local time of `zone`."""
    t = F.trim(c)
    n = t.try_cast("bigint")
    epoch = F.when(F.abs(n) >= 100_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    offset = t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & t.contains(":")
    stamp = t.try_cast("timestamp")
    return F.when(t.rlike(r"^-?\d+$"), F.from_utc_timestamp(epoch, zone)).when(offset, F.from_utc_timestamp(stamp, zone)).otherwise(stamp)


def has_topic(topic: Column, tags: Column, wanted: list[str]) -> Column:
    """An exact topic, or any of the tags split at , ; or |, without case."""
    asked = F.array(*[F.lit(w.lower()) for w in wanted])
    split = F.transform(F.split(F.coalesce(tags, F.lit("")), r"[,;|]"), lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.array_contains(asked, F.lower(F.trim(topic))), F.lit(False)) | F.arrays_overlap(split, asked)
