from __future__ import annotations

import datetime
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import detect, topology

D = datetime.date


def series(seed=42, jump=50.0, n=24):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(100, 1, n), rng.normal(100 + jump, 1, n)])


def test_cusum_alarms_after_the_jump_and_resets():
    score, alarm = detect.cusum_path(series())
    assert np.isnan(score[:4]).all() and alarm[24:].any() and np.nanmax(score) > 1
    high = low = 0.0
    y, want = series(), []
    mid, sd = y[:4].mean(), y[:4].std(ddof=1)
    for v in y[4:]:
        high, low = max(0, high + (v - mid) / sd - 0.5), max(0, low - (v - mid) / sd - 0.5)
        want.append(max(high, low) / 2)
        if want[-1] >= 1:
            high = low = 0.0
    assert score[4:] == pytest.approx(want)


@pytest.mark.parametrize("model", ["l1", "l2", "rbf"])
def test_optimal_partition_is_the_best_of_all(model):
    x = np.random.default_rng(1).normal(size=9) + np.repeat([0, 3, 0], 3)
    cost = detect.cost_matrix(x, model)

    def total(breaks):
        ends = [0, *breaks, len(x)]
        return sum(cost[a, b] for a, b in zip(ends, ends[1:])) + 0.7 * len(breaks)

    every = [c for k in range(4) for c in combinations(range(2, 8), k) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 9)))]
    assert total(detect.optimal_breaks(x, 0.7, model)) == pytest.approx(min(map(total, every)))


def test_segmentation_cost_rbf_matches_its_definition():
    x = np.random.default_rng(5).normal(size=6)
    d = (x[:, None] - x[None, :]) ** 2
    med = np.median(d[np.triu_indices(6, 1)])
    g = np.exp(-np.clip(d / med, 1e-2, 1e2))
    np.fill_diagonal(g, 1)
    assert detect.cost_matrix(x, "rbf")[1, 5] == pytest.approx(4 - g[1:5, 1:5].sum() / 4)


@pytest.mark.parametrize("method", ["pelt", "binseg"])
def test_online_breaks_do_not_look_ahead(method):
    y = series(8, 70.0)
    whole, part = detect.online_breaks(y, method=method, model="l2", penalty=2.0), detect.online_breaks(y[:32], method=method, model="l2", penalty=2.0)
    for a, b in zip(whole, part):
        np.testing.assert_array_equal(a[:32], b)
    assert whole[0][24:28].any()


def test_consensus_truth_table(spark, months):
    rows = list(zip(["a"] * 5, months(2023, 1, 5), [False, True, False, False, False], [True, False, True, False, False], [False, False, True, False, False], [False, False, False, True, False]))
    df = spark.createDataFrame(rows, "mo string, period date, cusum_shock boolean, tda_shock boolean, pelt_shock boolean, news_alert boolean")
    got = [r.consensus_shock for r in detect.consensus(df).orderBy("period").collect()]
    assert got == [False, True, True, True, False]
    assert [r.consensus_shock for r in detect.consensus(df.filter("period <> '2023-03-01'")).orderBy("period").collect()] == [False, True, False, False]


def test_gate_uses_the_row_before_only(spark, months):
    df = spark.createDataFrame(list(zip(["a"] * 4, months(2023, 1, 4), [False, False, True, False])), "mo string, period date, c boolean")
    assert [r.gate_alert for r in detect.gate(df, ["c"]).orderBy("period").collect()] == [False, False, False, True]


@pytest.mark.parametrize("model", ["l1", "l2", "rbf"])
def test_greedy_segmentation_by_hand(model):
    """Split by split over all segments, each gain from the costs of the pieces."""
    rng = np.random.default_rng(17)
    for n, penalty, size in ((14, 0.3, 2), (20, 0.8, 3), (3, 0.1, 2), (9, 1e9, 2)):
        x = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(3, 1, n - n // 2)])
        cost, segments, want = detect.cost_matrix(x, model), [(0, n)], []
        while True:
            gains = [(cost[a, b] - cost[a, m] - cost[m, b], -m, a, b) for a, b in segments for m in range(a + size, b - size + 1)]
            if not gains or max(gains)[0] <= penalty:
                break
            _, m, a, b = max(gains)
            want.append(-m)
            segments = [s for s in segments if s != (a, b)] + [(a, -m), (-m, b)]
        assert detect.greedy_breaks(x, penalty, model, size) == sorted(want)


def test_retrospective_benchmark_by_hand(spark, months):
    from itertools import combinations

    rng = np.random.default_rng(18)
    y, line = np.concatenate([rng.normal(10, 1, 6), rng.normal(14, 1, 6)]), months(2020, 1, 12)
    got = detect.retrospective(spark.createDataFrame(list(zip(line, map(float, y))), "period date, y double"), penalties=(0.5, 2.5)).collect()
    x = (y - y.mean()) / y.std()
    for model in ("l1", "l2", "rbf"):
        cost = detect.cost_matrix(x, model)
        for penalty in (0.5, 2.5):
            every = [c for k in range(6) for c in combinations(range(2, 11), k) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 12)))]
            total = lambda c: sum(cost[a, b] for a, b in zip((0, *c), (*c, 12))) + penalty * len(c)  # noqa: E731, B023
            found = tuple(line.index(r.break_period) for r in got if (r.algorithm, r.model, r.penalty) == ("pelt", model, penalty))
            assert total(sorted(found)) == pytest.approx(min(map(total, every)))
            assert sorted(line.index(r.break_period) for r in got if (r.algorithm, r.model, r.penalty) == ("binseg", model, penalty)) == detect.greedy_breaks(x, penalty, model)


def test_greedy_matching_uses_each_side_once(spark):
    found = spark.createDataFrame([("m", D(2022, 3, 10)), ("m", D(2022, 3, 20)), ("m", D(2022, 5, 1))], "method string, detected date")
    events = spark.createDataFrame([(D(2022, 3, 12),), (D(2022, 4, 10),)], "event date")
    got = {(r.detected, r.event) for r in detect.match_events(found, events).collect()}
    assert got == {(D(2022, 3, 10), D(2022, 3, 12)), (D(2022, 3, 20), D(2022, 4, 10))} or got == {(D(2022, 3, 10), D(2022, 3, 12)), (D(2022, 5, 1), D(2022, 4, 10))}
    scores = detect.event_scores(found, events).first()
    assert (scores.matched, scores.recall, round(scores.precision, 4)) == (2, 1.0, 0.6667)


def test_event_scores_count_early_ones_as_no_delay_and_silent_methods_as_nothing(spark):
    found = spark.createDataFrame([("m", D(2022, 3, 2)), ("m", D(2022, 5, 20))], "method string, detected date")
    events = spark.createDataFrame([(D(2022, 3, 12),), (D(2022, 5, 1),), (D(2030, 1, 1),)], "event date")
    months_ = spark.createDataFrame([(D(2022, 1, 1),), (D(2022, 12, 1),)], "period date")
    got = {r.method: r for r in detect.event_scores(found, events, methods=["m", "silent"], observed=months_).collect()}
    assert (got["m"].events, got["m"].out_of_range, got["m"].recall, got["m"].mean_lead_days) == (2, 1, 1.0, 4.5)
    assert got["m"].mean_delay == pytest.approx(9.5 / 30.4375)
    assert (got["silent"].detected, got["silent"].precision, got["silent"].f1, got["silent"].mean_delay) == (0, 0.0, 0.0, None)


def test_national_months_win_their_pair(spark, months):
    df = spark.createDataFrame(list(zip(months(2020, 1, 2), [0.5, None], [False, True])), "period date, share double, national boolean")
    assert [(r.event, r.share) for r in detect.macro_events(df, national="national").collect()] == [(D(2020, 2, 1), None)]


def test_macro_events_pair_up_consecutive_months(spark, months):
    df = spark.createDataFrame(list(zip(months(2023, 1, 6), [0.1, 0.3, 0.2, 0.0, 0.2, 0.2])), "period date, share double")
    got = sorted(r.event for r in detect.macro_events(df).collect())
    assert got == [D(2023, 2, 1), D(2023, 3, 1), D(2023, 5, 1)]


def test_three_points_have_the_two_shortest_distances():
    p = np.random.default_rng(0).normal(size=(3, 3))
    d = sorted(np.linalg.norm(p[i] - p[j]) for i, j in combinations(range(3), 2))
    bars = topology.persistence(p)
    assert sorted(b for _, b in bars[0]) == pytest.approx(d[:2]) and bars[1] == []


def test_a_circle_has_a_loop():
    t = np.linspace(0, 2 * np.pi, 9)[:-1]
    loops = topology.persistence(np.column_stack([np.cos(t), np.sin(t)]))[1]
    assert max(b - a for a, b in loops) > 0.5


def test_entropy_and_distance():
    assert topology.entropy([(0, 1), (0, 1)]) == pytest.approx(np.log(2))
    assert topology.entropy([]) == 0.0
    assert topology.wasserstein([(0, 1)], [(0, 1)]) == 0.0
    assert topology.wasserstein([(0, 1)], []) == pytest.approx(1 / np.sqrt(2))


def test_topology_columns_match_the_general_case(spark, months):
    y = np.random.default_rng(3).normal(size=12)
    df = spark.createDataFrame([("a", p, float(v)) for p, v in zip(months(2022, 1, 12), y)], "mo string, period date, y double")
    got = topology.features(df).orderBy("period").collect()

    def diagram(i):
        pts = topology.takens(y[i - 4 : i + 1])
        return topology.persistence(pts / pts.std(axis=0))[0]

    for i in range(6, 12):
        assert got[i].tda_entropy == pytest.approx(topology.entropy(diagram(i - 1)))
        assert got[i].tda_distance == pytest.approx(topology.wasserstein(diagram(i - 1), diagram(i - 2)), abs=1e-9)


def test_residual_barrier_needs_history(spark, months):
    df = spark.createDataFrame([("a", p, v) for p, v in zip(months(2022, 1, 8), [1.0, 1.1, 0.9, 1.0, 1.0, 9.0, 1.0, None])], "mo string, period date, residual double")
    got = detect.residual_barrier(df).orderBy("period").collect()
    assert [r.residual_eligible for r in got] == [False] * 4 + [True] * 3 + [False]
    assert [r.residual_shock for r in got][5] and not got[7].residual_shock
    assert detect.residual_barrier(df.limit(0)).count() == 0 and F is not None


def test_assignment_is_the_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(9)
    for n in range(1, 7):
        for _ in range(20):
            cost = rng.integers(0, 6, (n, n)).astype(float) if n % 2 else rng.random((n, n))
            got = topology.assignment(cost)
            assert sorted(got) == list(range(n))
            assert cost[np.arange(n), got].sum() == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_distance_of_diagrams_by_brute_force():
    import time
    from itertools import permutations

    rng = np.random.default_rng(10)
    half = lambda p: (p[1] - p[0]) / np.sqrt(2)

    def plain(a, b):
        left, right = [*a, *[None] * len(b)], [*b, *[None] * len(a)]
        cost = lambda p, q: 0.0 if p is None and q is None else half(q) if p is None else half(p) if q is None else float(np.hypot(p[0] - q[0], p[1] - q[1]))
        return min(sum(cost(p, q) for p, q in zip(left, order)) for order in permutations(right))

    bars = lambda n: [(float(b), float(b + d)) for b, d in rng.random((n, 2))]
    for n, m in ((0, 1), (1, 0), (1, 1), (2, 3), (3, 2), (3, 3), (4, 3)):
        a, b = bars(n), bars(m)
        assert topology.wasserstein(a, b) == pytest.approx(plain(a, b)) == pytest.approx(topology.wasserstein(b, a))
    began = time.perf_counter()
    a = bars(100)
    assert topology.wasserstein(a, a[::-1]) == pytest.approx(0, abs=1e-9) and topology.wasserstein(a, bars(100)) > 0
    assert time.perf_counter() - began < 4  # two of them


def test_wide_windows(spark, months):
    rng = np.random.default_rng(12)
    y = np.concatenate([np.sin(np.arange(30) * 0.7) * 5 + rng.normal(0, 0.3, 30), np.full(16, 2.0)])
    rows = [("a", p, float(v)) for p, v in zip(months(2020, 1, len(y)), y)] + [("b", p, float(k)) for k, p in enumerate(months(2020, 1, 4))] + [("a", months(2030, 1, 1)[0], None)]
    df = spark.createDataFrame(rows, "mo string, period date, y double").repartition(3)
    for width, dimension, delay in ((12, 3, 2), (5, 3, 1), (9, 2, 3)):
        got = topology.wide_features(df, width=width, dimension=dimension, delay=delay).filter("mo = 'a'").orderBy("period").collect()
        before, made = None, [(None, None)]
        for k in range(len(y)):
            bars = topology.diagram(y[k + 1 - width : k + 1], dimension, delay) if k + 1 >= width else []
            made.append((topology.entropy(bars) if bars else None, topology.wasserstein(bars, before) if bars and before is not None else None))
            before = bars or before
        assert [(r.tda_entropy, r.tda_distance) for r in got] == [pytest.approx(x, abs=1e-9) if None not in x else x for x in made[:-1]]
    assert all(r.tda_entropy is None for r in topology.wide_features(df, width=5).filter("mo = 'b'").collect())
    circle = 2 * np.pi * np.arange(12) / 12
    assert topology.diagram(np.sin(circle), 2, 3)[0][0] > 0  # a loop is born later than its points
