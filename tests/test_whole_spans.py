import random

from sextant.operators import runtime


def brute(points, spans):
    out = {}
    for i, by, line in points:
        closed = [(e - s, k) for k, b, s, e in spans if b == by and e is not None and s <= line <= e]
        opened = [(-s, k) for k, b, s, e in spans if b == by and e is None and s <= line]
        if closed or opened:
            out[i] = (min(closed) if closed else min(opened))[1]
    return out


def test_innermost_by_brute_force(spark):
    rng = random.Random(5)
    spans = [(k, rng.choice("ab"), s := rng.randrange(-40, 200), None if rng.random() < 0.1 else s + rng.choice([-3, 0, 1, 7, 63, 64, rng.randrange(300)])) for k in range(300)]
    points = [(i, rng.choice("abc"), rng.randrange(-60, 520)) for i in range(800)]
    got = runtime.innermost(spark.createDataFrame(points, "point_id long, file string, line long"), spark.createDataFrame(spans, "symbol_id long, file string, start long, end long")).collect()
    assert {r.point_id: r.symbol_id for r in got} == brute(points, spans) and len(got) == len({r.point_id for r in got})


def test_innermost_of_spans_over_one_another(spark):
    """30,000 points that are each inside of 30,000 spans: pairs would be 900 million, and long spans hold ten million cells of 64 lines each."""
    spans = spark.range(30_000).selectExpr("id symbol_id", "'f' file", "-id start", "640000000 + id end")
    points = spark.range(30_000).selectExpr("id point_id", "'f' file", "id % 7 line")
    got = runtime.innermost(points, spans).groupBy("symbol_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 30_000)]


def test_one_row_a_point_and_no_match_without_a_file(spark):
    spans = [(7, "f", 1, None), (8, "f", 6, None), (9, "f", 2, 3), (5, None, 1, None)]
    points = [(1, "f", 5), (1, "f", 9), (2, "f", 2), (2, "f", 9), (3, None, 4), (4, "f", None), (5, "f", 0)]
    got = runtime.innermost(spark.createDataFrame(points, "point_id long, file string, line long"), spark.createDataFrame(spans, "symbol_id long, file string, start long, end long")).collect()
    assert sorted((r.point_id, r.symbol_id) for r in got) == [(1, 8), (2, 9)]


def moved(spark):
    """Rows that all stages so far have dealt out."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_points_on_few_lines_are_dealt_out_once(spark):
    """Broadcast as they are few, too many for that or never broadcast, answers are the same; only the first leave points where they are until the end."""
    n, found = 100_000, 67_500
    points = spark.range(n).selectExpr("id * 3 point_id", "concat('f', id % 2) file", "id % 40 line")
    spans = spark.createDataFrame([(k + 10 * f, f"f{f}", s, e) for f in (0, 1) for k, s, e in ((1, 3, 9), (2, 5, 6), (3, 20, None), (4, 30, None), (5, 30, None))], "symbol_id long, file string, start long, end long")
    want = {k + 10 * f: n // 40 * sum(line % 2 == f for line in lines) for f in (0, 1) for k, lines in ((1, [3, 4, 7, 8, 9]), (2, [5, 6]), (3, range(20, 30)), (4, range(30, 40)))}
    dealt = []
    for few in (27, 26, 0):
        before = moved(spark)
        assert {r.symbol_id: r["count"] for r in runtime.innermost(points, spans, few=few).groupBy("symbol_id").count().collect()} == want
        dealt.append(moved(spark) - before)
    assert found <= dealt[0] < 1.1 * found and min(dealt[1:]) > n + found


def test_open_ends_deal_events_out_once(spark):
    """At any size, as events are on 1,500 lines of 25 files."""
    from sextant.plans.catalog import QUERIES

    plan = QUERIES["innermost_with_open_ends"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("Exchange hashpartitioning(point_id") == 1
