"""Registration of queries, and the panel that their SQL twins share."""

from __future__ import annotations

#: The monthly panel of nations: observed months, the gap-free calendar, and the two joined.
OBSERVED = """obs AS (
  SELECT n_name AS mo, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
PANEL = OBSERVED + """,
cal AS (SELECT mo, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM obs GROUP BY mo),
panel AS (SELECT cal.mo, cal.period, obs.y FROM cal LEFT JOIN obs USING (mo, period))"""
#: Months are whole numbers here: the index of a month in years times 12.
MONTH = "(year({0}) * 12 + month({0}))"
#: Three arms made from the panel itself: lag 1, the mean of three months, and the value a year before.
ARMS = PANEL + """,
lagged AS (
  SELECT *, lag(y, 1) OVER w AS l1, lag(y, 12) OVER w AS l12,
         CASE WHEN count(y) OVER p3 = 3 THEN avg(y) OVER p3 END AS m3
  FROM panel WINDOW w AS (PARTITION BY mo ORDER BY period), p3 AS (PARTITION BY mo ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
oof AS (
  SELECT mo, period, y AS target, l1 AS pred_trend, m3 AS pred_boost, l12 AS pred_foundation,
         (CASE month(period) % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 12 END) AS lead_months, CAST(year(period) % 3 AS INTEGER) AS fold
  FROM lagged WHERE y IS NOT NULL AND l1 IS NOT NULL AND m3 IS NOT NULL AND l12 IS NOT NULL)"""


def sql(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


def register(book: dict, name: str, twin: str | None = None):
    def put(f):
        book[name] = (f, twin)
        return f

    return put
