import pytest
from fixtures import frame, holdings_panel, month_end
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import holdings


def by(rows, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in rows}


def test_concentration(spark):
    r = holdings.concentration(holdings_panel(spark), top=(2,)).orderBy("date").collect()
    assert (r[0]["n_holdings"], r[0]["hhi"], r[0]["effective_n"], r[0]["top2_share"]) == (4, pytest.approx(0.30), pytest.approx(1 / 0.3), pytest.approx(0.7))
    assert r[2]["n_holdings"] == 3
    short = frame(spark, "date date, bid string, weight double", [(month_end(0), "a", -0.5), (month_end(0), "b", 0.2), (month_end(1), "c", 0.1)])
    got = by(holdings.concentration(short, top=(2, 3)).collect(), "date", "top3_share")
    assert got[(month_end(0),)] == pytest.approx(-0.3) and by(holdings.concentration(short, top=(2,)).collect(), "date", "top2_share")[(month_end(0),)] == pytest.approx(0.2)


def test_allocation_and_characteristics(spark):
    panel = holdings_panel(spark)
    got = by(holdings.allocation(panel, by="sector", benchmark_weight="bench_weight").collect(), "date", "sector", "allocation")
    assert got[month_end(0), "A"] == pytest.approx(0.2) and got[month_end(0), "B"] == pytest.approx(-0.2)
    first = panel.where(F.col("date") == F.lit(month_end(0)))
    assert holdings.characteristics(first, columns=["per"]).first()["per"] == pytest.approx(20)
    assert holdings.characteristics(first, columns=["per"], benchmark_weight="bench_weight").first()["per"] == pytest.approx(-5)
    hole = first.withColumn("per", F.when(F.col("bid") != "d", F.col("per")))
    assert holdings.characteristics(hole, columns=["per"]).first()["per"] == pytest.approx(16 / 0.9)


def test_top_holdings(spark):
    panel = holdings_panel(spark)
    assert [r["bid"] for r in holdings.top_holdings(panel, n=1).collect()] == ["a", "c"]
    assert [r["bid"] for r in holdings.top_holdings(panel, n=2, at=str(month_end(0))).collect()] == ["a", "b", "c", "d"]
    r = holdings.top_holdings(panel, n=1, benchmark_weight="bench_weight").first()
    assert r["active_weight"] == pytest.approx(0.25)


def test_contributions(spark):
    panel = holdings_panel(spark)
    got = by(holdings.contribution(panel, forward_return="ret_1m").collect(), "date", "bid", "contribution")
    assert got[month_end(0), "a"] == pytest.approx(0.04) and len(got) == 11
    seg = by(holdings.contribution(panel, forward_return="ret_1m", by="sector").collect(), "date", "sector", "contribution")
    assert seg[month_end(0), "A"] == pytest.approx(0.025)
    top = holdings.top_contributors(panel, forward_return="ret_1m", n=1).collect()
    assert [(r["bid"], r["side"], r["n_periods"]) for r in top] == [("a", "top", 3), ("b", "bottom", 3)]
    every = holdings.top_contributors(panel, forward_return="ret_1m", n=5).collect()
    assert [(r["bid"], r["side"]) for r in every] == [("a", "top"), ("c", "top"), ("d", "top"), ("b", "bottom")]
    with pytest.raises(ValidationError):
        holdings.contribution(panel.union(panel), forward_return="ret_1m")


def test_turnover_and_trades(spark):
    panel = holdings_panel(spark)
    one = by(holdings.turnover(panel).collect(), "date", "turnover")
    two = by(holdings.turnover(panel, method="two_way").collect(), "date", "turnover")
    assert one == {(month_end(0),): None, (month_end(1),): 0.0, (month_end(2),): pytest.approx(0.1)} and two[(month_end(2),)] == pytest.approx(0.2)
    t = {r["date"]: tuple(r)[1:] for r in holdings.trades(panel).collect()}
    assert t[month_end(0)] == (None,) * 4 and t[month_end(1)] == (0, 0, 0.0, 0.0) and t[month_end(2)] == (0, 1, pytest.approx(0.1), pytest.approx(0.1))


def test_holding_period(spark):
    rows = [(month_end(m), b, w) for b, ws in (("a", (1, 1, 1, 1)), ("b", (1, 0, 1, 1)), ("c", (0, 0, 0, 0)), ("d", (1, None, None, 1))) for m, w in enumerate(ws)]
    got = by(holdings.average_holding_period(frame(spark, "date date, bid string, weight double", [(d, b, None if w is None else float(w)) for d, b, w in rows])).collect(), "bid", "avg_holding_period")
    assert got == {("a",): 4.0, ("b",): 1.5, ("d",): 1.0}


def spelled(spark):
    """a: months 1-2 and 4-6 (open); b: 1-6 (open, from the start); c: 2-3; d: 5; e: never."""
    held = {"a": (0, 1, 3, 4, 5), "b": range(6), "c": (1, 2), "d": (4,), "e": ()}
    return frame(spark, "date date, bid string, weight double", [(month_end(m), i, 0.1 if m in k else 0.0 if m % 2 else None) for i, k in held.items() for m in range(6)])


def test_spells_and_their_survival(spark):
    got = {(r["bid"], r["start"]): tuple(r)[2:] for r in holdings.holding_spells(spelled(spark)).collect()}
    assert got == {("a", month_end(0)): (month_end(1), 2, True, False), ("a", month_end(3)): (month_end(5), 3, False, True), ("b", month_end(0)): (month_end(5), 6, True, True), ("c", month_end(1)): (month_end(2), 2, False, False), ("d", month_end(4)): (month_end(4), 1, False, False)}
    rows = [tuple(r) for r in holdings.holding_period_distribution(spelled(spark)).orderBy("periods").collect()]
    assert rows == [(1, 5, 1, 0, pytest.approx(0.8)), (2, 4, 2, 0, pytest.approx(0.4)), (3, 2, 0, 1, pytest.approx(0.4)), (6, 1, 0, 1, pytest.approx(0.4))]
    entered = [tuple(r) for r in holdings.holding_period_distribution(spelled(spark), entered=True).orderBy("periods").collect()]
    assert entered == [(1, 3, 1, 0, pytest.approx(2 / 3)), (2, 2, 1, 0, pytest.approx(1 / 3)), (3, 1, 0, 1, pytest.approx(1 / 3))]
    assert holdings.holding_period_distribution(spelled(spark).limit(0)).collect() == []
