"""Statistical exports: strict CSV, JSON tables, ZIP members, encodings, and the contracts on what they hold."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthgrid.functions.calendar import month_start, shift
from monthgrid.hadoop import Files
from monthgrid.session import assert_none, assert_unique


def discover(spark: SparkSession, folder: str, pattern: str, required: bool = True) -> str | None:
    """The one file or table of a folder, on any file system, whose name matches; several are ambiguous vintages."""
    found = [n for n in Files(spark).children(folder) if fnmatch.fnmatchcase(n, pattern)]
    if len(found) > 1:
        raise ValueError(f"{pattern}: several files match: {found}")
    if not found and required:
        raise FileNotFoundError(f"{pattern}: no file in {folder}")
    return f"{folder.rstrip('/')}/{found[0]}" if found else None


def discover_tokens(spark: SparkSession, folder: str, tokens: list[str], kinds=(".csv", ".json", ".zip", ".xls", ".xlsx")) -> list[str]:
    """Files at any depth below a folder, on any file system, whose names hold every token, without case."""
    low = [t.lower() for t in tokens]
    named = [(path, path.rsplit("/", 1)[-1].lower()) for path, _, _ in Files(spark).state(folder)]
    return sorted(path for path, name in named if name.endswith(tuple(kinds)) and all(t in name for t in low))


def strict_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """An all-string table; an empty file, a blank or repeated header and any ragged row are errors."""
    lines = spark.read.text(path).limit(1).collect()
    if not lines or not lines[0][0].strip("﻿ "):
        raise ValueError(f"{path}: empty file")
    header = [h.strip().strip('"') for h in lines[0][0].lstrip("﻿").split(sep)]
    if any(not h for h in header) or len(set(header)) < len(header):
        raise ValueError(f"{path}: blank or repeated column in {header}")
    schema = T.StructType([*[T.StructField(h, T.StringType()) for h in header], T.StructField("_bad", T.StringType())])
    read = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    if read.filter("_bad is not null").select(*header, "_bad").limit(1).collect():  # a count would prune the columns that tell
        raise ValueError(f"{path}: a row has not {len(header)} fields")
    return read.select(*header)


def statistical_rows(raw: DataFrame) -> DataFrame:
    """Accepted rows with a date, trimmed dimensions, one unit column and value * 10^multiplier."""
    units = [c for c in ("unit_measure", "unit_meas") if c in raw.columns]
    if len(units) != 1:
        raise ValueError("exactly one of unit_measure and unit_meas is needed")
    rows = raw.filter("obs_status = 'A'")
    mult = F.trim(F.col("unit_mult")).cast("int") if "unit_mult" in raw.columns else F.lit(0)
    value = F.trim("value").cast("double") * F.pow(F.lit(10.0), mult)
    fixed = {"period", "value", "obs_status", "unit_mult", units[0]}
    out = rows.select(F.to_date(F.trim("period"), "yyyy-MM-dd").alias("period"), value.alias("value"), F.trim(units[0]).alias("unit"), mult.alias("__mult"), *[F.trim(c).alias(c) for c in raw.columns if c not in fixed])
    bad = F.col("period").isNull() | ~F.col("__mult").between(-12, 12) | (F.abs("value") == float("inf"))
    return assert_none(out, F.coalesce(bad, F.lit(True)), "a row has no date, an odd multiplier or an infinite value").drop("__mult")


def load_target(rows: DataFrame, categories: list[str], category: str = "category", entity: str = "mo", ordinal: str | None = None) -> DataFrame:
    """(mo, period, y): the sum over all the categories, NULL unless every one is known; repeated rows of one file are
    told apart by slot (#2, #3 ...) and, as soon as there are any, by source."""
    rows = rows.filter(F.col(category).isin(categories)).withColumn("period", month_start(F.col("period")))
    keys = ["period", entity, category] + (["source"] if "source" in rows.columns else [])
    if ordinal and rows.groupBy("period", entity, category).count().filter("count > 1").limit(1).count():
        slot = F.row_number().over(W.partitionBy(*keys).orderBy(ordinal)) - 1
        name = F.concat(F.col(entity), F.concat(F.lit(" ["), F.col("source"), F.lit("]")) if "source" in rows.columns else F.lit(""))
        rows = rows.withColumn("__s", slot).withColumn(entity, F.when(F.col("__s") > 0, F.concat(name, F.lit(" #"), F.col("__s") + 1)).otherwise(name)).drop("__s")
    whole = F.when(F.count("value") == len(categories), F.sum("value"))
    return rows.groupBy(entity, "period").agg(whole.alias("y"))


def indicator_key(name: str, dims: list[str]):
    """name::{sorted dimensions as JSON}"""
    return F.concat(F.lit(f"{name}::"), F.to_json(F.struct(*sorted(dims))))


def load_macro(rows: DataFrame, name: str, dims: list[str], how: str = "mean", lag: int = 0) -> DataFrame:
    """(period, indicator, value): one series for each combination of the dimensions, a value a month, moved by `lag`
    months.  Kept long; `wide` pivots it."""
    assert_none(rows, F.greatest(*[F.col(d).isNull() for d in dims]) if len(dims) > 1 else F.col(dims[0]).isNull(), f"{name}: an undeclared or empty dimension")
    keyed = rows.select(month_start(F.col("period")).alias("period"), F.col("period").alias("__raw"), indicator_key(name, dims).alias("indicator"), "value")
    agg = {"mean": F.avg("value"), "sum": F.sum("value"), "last": F.max_by("value", F.when(F.col("value").isNotNull(), F.col("__raw")))}[how]
    made = keyed.groupBy("period", "indicator").agg(agg.alias("value"))
    return made.withColumns({"period": shift(F.col("period"), lag), "indicator": F.concat("indicator", F.lit(f"_lag_{lag}"))})


def wide(long: DataFrame, names: list[str], calendar: DataFrame | None = None) -> DataFrame:
    """A column for each indicator, on the whole calendar between the first and the last month."""
    table = long.groupBy("period").pivot("indicator", names).agg(F.first("value"))
    if calendar is None:
        calendar = long.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("period"))
    return calendar.join(table, "period", "left")


ENCODINGS = ("utf-8-sig", "utf-8", "cp1251")


def decoded(data: bytes, preferred: str | None = None) -> str:
    for encoding in ([preferred] if preferred else []) + list(ENCODINGS):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("unknown encoding")


def sniff(line: str) -> str:
    return max(";,\t|", key=line.count)


def csv_rows(data: bytes, encoding: str | None = None) -> pd.DataFrame:
    text = decoded(data, encoding)
    return pd.read_csv(io.StringIO(text), sep=sniff(text.split("\n", 1)[0]), dtype=str, keep_default_na=False)


def json_rows(data: bytes) -> pd.DataFrame:
    """A list of records, a mapping that holds one, or a single record."""
    found = json.loads(decoded(data))
    if isinstance(found, dict):
        found = next((found[k] for k in ("data", "items", "rows", "results") if isinstance(found.get(k), list)), [found])
    return pd.DataFrame([{k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in r.items()} for r in found])


def tables_of(path: str, data: bytes, most_mb: int = 200):
    """(name, rows) of the tables of one file, by its kind."""
    kind = path.lower().rpartition(".")[2]
    if kind == "csv":
        yield "", csv_rows(data)
    elif kind == "json":
        yield "", json_rows(data)
    elif kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for member in sorted(z.namelist()):
                if member.lower().endswith((".csv", ".json")):
                    if z.getinfo(member).file_size > most_mb << 20:
                        raise ValueError(f"{member}: over {most_mb} MB")
                    for sheet, rows in tables_of(member, z.read(member), most_mb):
                        yield f"{member}:{sheet}".rstrip(":"), rows
    elif kind in ("xls", "xlsx"):
        for sheet, rows in pd.read_excel(io.BytesIO(data), sheet_name=None, dtype=str, header=None).items():  # needs the readers of that format
            cells = rows.where(rows.notna(), None).values.tolist()
            top = header_row(cells)
            yield sheet, pd.DataFrame(cells[top + 1 :], columns=unique_names(cells[top]) if cells else [])
    else:
        raise ValueError(f"{path}: unknown kind of file")


def statistical_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, table, row, cells): every row of every table below a path, cells as a map of strings."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                for table, rows in tables_of(name, bytes(data)):
                    cells = [{str(k): None if v is None else str(v) for k, v in r.items()} for r in rows.to_dict("records")]
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "table": table, "row": range(len(cells)), "cells": cells})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, "file string, table string, row bigint, cells map<string,string>")


# The keys under which the exports hold their records.
CONTAINERS = ("messages", "items", "articles", "news", "results", "data")


def news_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, seq, record, error): the records of JSON files as JSON text: lists, mappings that hold one, or single records;
    a file that can't be parsed is one row without a record, with the reason as its error."""

    def records(value):
        if isinstance(value, list):
            yield from (v for v in value if isinstance(v, dict))
        elif isinstance(value, dict):
            inner = next((value[k] for k in CONTAINERS if isinstance(value.get(k), (list, dict))), None)
            if inner is None:
                yield value
            else:
                yield from records(inner)

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    found = list(records(json.loads(decoded(bytes(data)))))
                except (ValueError, RecursionError) as error:
                    yield pd.DataFrame({"file": [name.rsplit("/", 1)[-1]], "seq": [0], "record": [None], "error": [f"{type(error).__name__}: {error}"]})
                    continue
                yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "seq": range(len(found)), "record": [json.dumps(r, ensure_ascii=False) for r in found], "error": None})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, seq bigint, record string, error string")


def news_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """The named columns of news CSV files as strings; quoted bodies may hold line feeds.  Files are read in parallel."""
    read = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    missing = [c for c in columns if c not in read.columns]
    if missing:
        raise ValueError(f"{path}: no column {missing}")
    return read.select(*columns)


def header_row(rows: list[list], most: int = 20) -> int:
    """The row of a sheet most like a header: many cells filled, few numbers, few repeats; the first of equals."""

    def score(row: list) -> float:
        known = [str(c).strip() for c in row if c is not None and str(c).strip()]
        words = sum(not re.fullmatch(r"[-\d\s.,%]+", c) for c in known)
        return len(known) + words - (len(known) - len(set(known)))

    return max(range(min(len(rows), most)), key=lambda i: (score(rows[i]), -i), default=0)


def unique_names(names: list) -> list[str]:
    """Column names without blanks or repeats."""
    out: list[str] = []
    for k, name in enumerate(names):
        base = str(name).strip() if name is not None and str(name).strip() else f"column_{k + 1}"
        n, made = 1, base
        while made in out:
            n += 1
            made = f"{base}_{n}"
        out.append(made)
    return out


def text_of(value) -> str:
    """The text of a string, number, list or mapping, in order."""
    if value is None:
        return ""
    if isinstance(value, (str, int, float)):
        return str(value)
    if isinstance(value, list):
        return " ".join(filter(None, map(text_of, value)))
    if isinstance(value, dict):
        return next((t for k in ("text", "content", "value") if (t := text_of(value.get(k)))), "")
    return ""


def prediction_cache(frames: dict[str, DataFrame], keys=("mo", "period")) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold rows, test rows) from one table for each arm, by a full join; rows without a target are the test."""
    out = None
    for arm, df in frames.items():
        part = df.select(*keys, F.col("pred").alias(f"pred_{arm}"), *([F.col("target").alias("__t")] if "target" in df.columns else []))
        if out is None:
            out = part.withColumnRenamed("__t", "target") if "__t" in part.columns else part.withColumn("target", F.lit(None).cast("double"))
        else:
            out = out.join(part, list(keys), "full")
            if "__t" in out.columns:
                out = out.withColumn("target", F.coalesce("target", "__t")).drop("__t")
    return out.filter("target is not null"), out.filter("target is null")


def roster(df: DataFrame, expected: int, entity: str = "mo") -> DataFrame:
    """The distinct entities, exactly `expected` and none blank."""
    names = df.select(F.trim(entity).alias(entity))
    assert_none(names, F.col(entity).isNull() | (F.col(entity) == ""), "roster: a blank entity")
    unique = names.distinct()
    if (n := unique.count()) != expected:
        raise ValueError(f"roster: {n} entities, not {expected}")
    return unique


def coverage(df: DataFrame, date: str) -> DataFrame:
    """The first and the last valid date (first, last) of a date, timestamp or text column; no other column is read."""
    d = F.expr(f"try_to_timestamp(cast(`{date}` as string))").cast("date")
    return df.select(d.alias("d")).agg(F.min("d").alias("first"), F.max("d").alias("last"))


def category_history(df: DataFrame, category: str, wanted: str, period: str = "period", value: str = "value") -> DataFrame:
    """(period, y, prediction): the mean of one category's values in each month, and the mean of the three rows before as a
    naive prediction (y itself in the first).  Without a row of the category an error names those there are."""
    rows = df.filter(F.col(category) == wanted)
    if not rows.limit(1).count():
        there = [r[0] for r in df.select(category).distinct().orderBy(category).limit(50).collect()]
        raise ValueError(f"no category {wanted!r}; there are {there}")
    made = rows.groupBy(month_start(F.col(period)).alias("period")).agg(F.avg(value).alias("y"))
    before = F.avg("y").over(W.orderBy("period").rowsBetween(-3, -1))  # over months only
    return made.withColumn("prediction", F.coalesce(before, "y"))


# The names of known news exports.
NEWS_EXPORTS = ("smartlab.json", "bank offshore.json", "rbk.json")


def find_json(spark: SparkSession, configured: list[str], roots: list[str], auto: bool = True, known=NEWS_EXPORTS, primary: str | None = None) -> tuple[list[str], list[str]]:
    """(existing, looked for): the configured JSON files below each root, the primary one first, then known exports in the
    roots themselves, each once, on any file system.  A configured path that starts with the last root's own name is also taken
    inside it."""
    files, looked = Files(spark), []
    roots = [root.rstrip("/") for root in roots]
    for name in ([primary] if primary else []) + list(configured):
        if name.startswith("/") or "://" in name:
            looked.append(name)
            continue
        looked += [f"{root}/{name}" for root in roots]
        first, _, rest = name.partition("/")
        if roots and rest and first.lower() == roots[-1].rsplit("/", 1)[-1].lower():
            looked.append(f"{roots[-1]}/{rest}")
    if auto:
        looked += [f"{root}/{n}" for root in roots for n in files.children(root) if n.lower() in known]
    unique = list(dict.fromkeys(looked))
    return [p for p in unique if files.exists(p)], unique


def news_table(df: DataFrame) -> DataFrame:
    """A monthly news table under its canonical names; repeated months are an error."""
    names = {"telegram_sentiment": "sentiment_index", "telegram_volume": "news_volume", "telegram_shock": "news_shock_score", "telegram_shock_score": "news_shock_score"}
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns}).withColumn("period", month_start(F.col("period")))
    return assert_unique(out, ["period"], "news table")


def role_of_columns(df: DataFrame) -> dict[str, str]:
    """A role for each column of an ad-hoc table, from its values: date, number or entity (half or more of the known)."""
    from monthgrid.functions.numbers import messy_number
    from monthgrid.functions.text import parse_period

    share = lambda test, c: F.avg(F.when(F.col(c).isNotNull() & (F.trim(c) != ""), test.isNotNull().cast("double")))
    row = df.agg(*[share(parse_period(F.col(c)), c).alias(f"d_{c}") for c in df.columns], *[share(messy_number(F.col(c)), c).alias(f"n_{c}") for c in df.columns]).first()
    kind = lambda c: "date" if (row[f"d_{c}"] or 0) >= 0.5 else "number" if (row[f"n_{c}"] or 0) >= 0.5 else "entity"
    return {c: kind(c) for c in df.columns}
