from __future__ import annotations

import datetime
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from monthgrid.functions import text as tx
from monthgrid.functions.numbers import messy_number, ratio
from monthgrid.sources import files, sinks

D = datetime.date


def one(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_period_texts(spark):
    assert one(spark, tx.parse_period, "Январь 2023", "2023M02", "03.2023", "2023 год", "junk", "2023-07", "15.08.2022", "13.2023", None, "период 2020-05", "2020 m 05", "2023M12 (факт)", "за 4 / 2021") == [
        D(2023, 1, 1), D(2023, 2, 1), D(2023, 3, 1), D(2023, 1, 1), None, D(2023, 7, 1), D(2022, 8, 1), None, None, D(2020, 5, 1), D(2020, 5, 1), D(2023, 12, 1), D(2021, 4, 1)]
    assert one(spark, tx.parse_period, "Доля декады 2020", "маркет 2020", "маяк 2021", "2020 январь", "сен 1920", "мая 2021 г.", "марта 2021 г.", "янв. - фев. 2022", "декабрь (оценка) 2021", "1995-06", "10.03.1998", "2021 г") == [
        None, None, None, None, None, None, D(2021, 3, 1), D(2022, 1, 1), D(2021, 12, 1), D(1995, 6, 1), D(1998, 3, 1), D(2021, 1, 1)]


def test_periods_of_many_columns_compile_and_cost_no_exceptions(spark):
    """Thirteen columns of periods stay within what Java compiles as one method, and junk is not parsed by trial."""
    names = [f"c{k}" for k in range(13)]
    rows = spark.createDataFrame([("май 2021 январь 2020",) * 13, ("junk",) * 13, ("31.02.1999",) * 13, ("5/1/1998",) * 13], names)
    parsed = rows.select(*[tx.parse_period(F.col(c)).alias(c) for c in names])
    assert [[str(v) for v in r] for r in parsed.collect()] == [[v] * 13 for v in ("2020-01-01", "None", "None", "1998-01-01")]
    made = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(parsed._jdf.queryExecution().sparkPlan())
    assert len(made) < 100_000
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast" not in plan.lower() and "rlike" in plan.lower()


def test_messy_numbers(spark):
    assert one(spark, messy_number, "1 000,5", "1 100,5", "-", "..", "12 руб", None, "", "1.5e3", "2E+2", "e") == [1000.5, 1100.5, None, None, 12.0, None, None, 1500.0, 200.0, None]


def test_place_names(spark):
    got = one(spark, tx.region_key, "Республика Татарстан", "Орловская область", "г. Москва", "Чувашская Республика — Чувашия", "Город Санкт Петербург", "Краснодарский\u00a0край*", "Ямало-Ненецкий АО", None)
    assert got == ["татарстан", "орловская", "москва", "чувашия", "санкт-петербург", "краснодарский", "ямало-ненецкий", ""]
    place = lambda c: tx.geo_key(F.lit(None).cast("string"), c)
    assert one(spark, place, "Микрорайон 3", "Микрорайон 5", "город Казань", "Казань", "г. Казань", "Орёл [1]", "Ｋ и\u0306", None) == ["микрорайон 3", "микрорайон 5", "город казань", "казань", "казань", "орел 1", "k й", ""]
    assert one(spark, lambda c: tx.geo_key(F.lit("Московская область"), c), "Клин")[0] == "московская::клин"


def test_bodies_and_urls(spark):
    assert one(spark, tx.clean_text, "<p>a &amp; b</p>\x00 see https://x.y/z  now", None) == ["a & b see now", None]
    assert one(spark, tx.clean_text, "&#39;&#x416;&#128512;&nbsp;&laquo;x&raquo; &amp;lt; &# &unknown; &copy; &notin; &ampx HTTP://A.b", "&#1040;") == ["'Ж\U0001f600 «x» &lt; &# &unknown; © ∉ &x", "А"]
    assert one(spark, tx.normal_url, "HTTPS://Example.com/a?q=1#f", "www.Example.com/A", "ftp://x/y", None) == ["https://example.com/a", "https://www.example.com/A", None, None]


def test_dates_in_another_zone(spark):
    got = one(spark, tx.parse_when, "1706740200", "1706740200000", "2024-01-31T23:30:00Z", "2024-01-31T23:30:00+03:00", "2024-01-31 23:30:00", "bad", None)
    want = datetime.datetime(2024, 2, 1, 1, 30)
    assert got == [want, want, datetime.datetime(2024, 2, 1, 2, 30), datetime.datetime(2024, 1, 31, 23, 30), datetime.datetime(2024, 1, 31, 23, 30), None, None]


def test_topics(spark):
    df = spark.createDataFrame([("Economy", None), ("x", "a; Tax|b"), (None, None)], "t string, g string")
    assert [r[0] for r in df.select(tx.has_topic(F.col("t"), F.col("g"), ["economy", "tax"])).collect()] == [True, True, False]


def test_ratio_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 1.0), (float("inf"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25, None, None]


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_strict_csv(spark, tmp_path):
    good = put(tmp_path / "a.csv", "﻿a;b\n1;x\n2;y\n")
    assert files.strict_csv(spark, good).collect() == [("1", "x"), ("2", "y")]
    for name, bad in (("e", ""), ("h", "a;a\n1;2\n"), ("b", "a;\n1;2\n"), ("short", "a;b\n1\n"), ("long", "a;b\n1;2;3\n")):
        with pytest.raises(ValueError):
            files.strict_csv(spark, put(tmp_path / f"{name}.csv", bad))


def test_statistical_rows_and_target(spark):
    raw = spark.createDataFrame(
        [("2023-01-01", "10", "A", "3", "rub", "001", "a", "s"), ("2023-01-01", "4", "A", "0", "rub", "001", "b", "s"), ("2023-02-01", "6", "A", "0", "rub", "001", "a", "s"), ("2023-02-01", "9", "X", "0", "rub", "001", "b", "s")],
        "period string, value string, obs_status string, unit_mult string, unit_measure string, mo string, category string, source string")
    rows = files.statistical_rows(raw)
    got = {r.period: r.y for r in files.load_target(rows, ["a", "b"]).collect()}
    assert got == {D(2023, 1, 1): 10004.0, D(2023, 2, 1): None}
    with pytest.raises(ValueError):
        files.statistical_rows(raw.withColumn("unit_mult", F.lit("20")))
    with pytest.raises(ValueError):
        files.statistical_rows(raw.withColumn("unit_meas", F.lit("x")))


def test_repeated_names_become_slots(spark):
    rows = spark.createDataFrame([("n", D(2023, m, 1), "a", float(10 * m + k), "s", m * 10 + k) for m in (1, 2) for k in (0, 1)], "mo string, period date, category string, value double, source string, line int")
    got = files.load_target(rows, ["a"], ordinal="line").collect()
    assert len(got) == 4 and {r.mo for r in got} == {"n [s]", "n [s] #2"} and sum(r.y for r in got) == 62


def test_macro_series_keep_missing_months(spark):
    rows = spark.createDataFrame([(D(2023, m, 1), t, v * m) for m in (1, 3) for t, v in (("a", 10.0), ("b", 100.0))], "period date, type string, value double")
    long = files.load_macro(rows, "m", ["type"], lag=1)
    names = sorted(r[0] for r in long.select("indicator").distinct().collect())
    got = {r.period: tuple(r[n] for n in names) for r in files.wide(long, names).collect()}
    assert got == {D(2023, 2, 1): (10.0, 100.0), D(2023, 3, 1): (None, None), D(2023, 4, 1): (30.0, 300.0)}


def test_files_of_every_kind(spark, tmp_path):
    put(tmp_path / "a.csv", "имя|v\nx|1\n", "cp1251")
    put(tmp_path / "b.json", json.dumps({"items": [{"k": 1}, {"k": "z"}]}))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in.csv", "p;q\n1;2\n")
        z.writestr("skip.txt", "no")
    got = {(r.file, r.table, r.row): r.cells for r in files.statistical_files(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", "", 0): {"имя": "x", "v": "1"}, ("b.json", "", 0): {"k": "1"}, ("b.json", "", 1): {"k": "z"}, ("c.zip", "in.csv", 0): {"p": "1", "q": "2"}}


def test_news_json_containers(spark, tmp_path):
    paths = [put(tmp_path / n, t) for n, t in (("a.json", '{"messages": [{"id": 1}, 5]}'), ("b.json", '[{"id": 2}]'), ("c.json", '{"id": 3}'), ("d.json", "{broken"), ("e.json", '{"data": {"items": [{"id": 4}]}}'))]
    rows = files.news_json(spark, paths).collect()
    assert sorted(json.loads(r.record)["id"] for r in rows if r.error is None) == [1, 2, 3, 4]
    assert [(r.file, r.record, r.error[:15]) for r in rows if r.error] == [("d.json", None, "JSONDecodeError")]
    assert files.text_of([{"text": ["a", 1]}, "b", None]) == "a 1 b"


def test_discovery(spark, tmp_path):
    (tmp_path / "wage_2023.csv").write_text("")
    assert files.discover(spark, str(tmp_path), "wage_*.csv").endswith("wage_2023.csv")
    assert files.discover(spark, str(tmp_path), "none*", required=False) is None
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path), "none*")
    (tmp_path / "wage_2024.csv").write_text("")
    with pytest.raises(ValueError, match="several"):
        files.discover(spark, str(tmp_path), "wage_*.csv")
    assert len(files.discover_tokens(spark, str(tmp_path), ["WAGE", "2024"])) == 1


def test_cache_and_roster(spark):
    a = spark.createDataFrame([("x", D(2023, 1, 1), 1.0, 5.0)], "mo string, period date, pred double, target double")
    b = spark.createDataFrame([("x", D(2023, 1, 1), 2.0), ("y", D(2023, 1, 1), 3.0)], "mo string, period date, pred double")
    oof, test = files.prediction_cache({"a": a, "b": b})
    assert [(r.pred_a, r.pred_b, r.target) for r in oof.collect()] == [(1.0, 2.0, 5.0)]
    assert [(r.mo, r.pred_b) for r in test.collect()] == [("y", 3.0)]
    with pytest.raises(ValueError, match="entities"):
        files.roster(b.select("mo"), 3)


def test_column_roles(spark):
    df = spark.createDataFrame([("Январь 2023", "Орёл", "1 000,5"), ("2023M02", "Тула", "-")], "d string, n string, v string")
    assert files.role_of_columns(df) == {"d": "date", "n": "entity", "v": "number"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 3.5)], "a int, b double")
    note = sinks.write_with_manifest(df, str(tmp_path / "t"), ["src"])
    assert note["rows"] == 2 and note["missing_values"] == {"a": 0, "b": 1} and json.loads((tmp_path / "t.manifest.json").read_text())["sources"] == ["src"]
    paths = [str(tmp_path / f"{k}.csv") for k in "xy"]
    sinks.write_csv_copies(df, paths)
    assert open(paths[0], "rb").read() == open(paths[1], "rb").read() == b"a,b\n1,\n2,3.5\n"
    sinks.metric_reports(df, str(tmp_path / "m"))
    assert json.loads((tmp_path / "m.json").read_text())[0]["b"] is None
    key, built = sinks.fingerprint(spark, {"k": 1}, paths), []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "c"), key, lambda: built.append(1) or df).count() == 2
    assert built == [1] and key != sinks.fingerprint(spark, {"k": 2}, paths) and not [f for f in os.listdir(tmp_path / "c") if f.startswith(".work")]
