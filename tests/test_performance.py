import math
from datetime import date

import numpy as np
import pytest
from fixtures import frame, month_end, series

from tidemark.config import ValidationError
from tidemark.operators import performance as perf

SIMPLE = (0.1, -0.2, 0.05, 0.2, -0.1, 0.15)


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def simple(spark):
    return series(spark, SIMPLE)


def test_levels(spark, simple):
    grown = np.cumprod(1 + np.array(SIMPLE))
    assert [r["cumulative_return"] for r in perf.cumulative_returns(simple).orderBy("date").collect()] == pytest.approx(list(grown - 1))
    logs = [r["cumulative_return"] for r in perf.cumulative_returns(simple, log=True).orderBy("date").collect()]
    assert logs == pytest.approx(list(np.log(grown)))
    assert one(perf.total_return(simple)) == pytest.approx(grown[-1] - 1) and one(perf.annualized_return(simple)) == pytest.approx(grown[-1] ** 2 - 1)
    gap = series(spark, (0.1, None, 0.1))
    assert one(perf.total_return(gap)) == pytest.approx(0.21) and one(perf.annualized_return(gap)) == pytest.approx(1.21**6 - 1)
    assert one(perf.total_return(series(spark, (None, None)))) == 0 and one(perf.annualized_return(series(spark, (None, None)))) is None
    years = frame(spark, "date date, ret double", [(date(2023, 12, 31), 0.1), (date(2024, 12, 31), 0.1)])
    assert one(perf.annualized_return(years)) == pytest.approx(0.1)


def test_ratios(spark, simple):
    x, rf = np.array(SIMPLE), 1.02 ** (1 / 12) - 1
    assert one(perf.annualized_volatility(simple, ddof=0)) == pytest.approx(x.std() * math.sqrt(12))
    assert one(perf.sharpe_ratio(simple, risk_free=0.02)) == pytest.approx((x - rf).mean() / x.std(ddof=1) * math.sqrt(12))
    assert one(perf.sortino_ratio(simple, target=0.01)) == pytest.approx(x.mean() / math.sqrt((np.minimum(x - 0.01, 0) ** 2).mean()) * math.sqrt(12))
    assert one(perf.sharpe_ratio(series(spark, (0.5, 0.5)))) is None and one(perf.sortino_ratio(series(spark, (0.1, 0.2)))) is None
    assert one(perf.hit_rate(simple)) == pytest.approx(4 / 6) and one(perf.win_loss_ratio(simple)) == pytest.approx(0.125 / 0.15)
    assert one(perf.value_at_risk(simple, level=0.2)) == pytest.approx(np.quantile(x, 0.2))
    assert one(perf.conditional_value_at_risk(simple, level=0.2)) == pytest.approx(x[x <= np.quantile(x, 0.2)].mean())


def test_drawdowns(spark, simple):
    assert one(perf.max_drawdown(simple)) == pytest.approx(-0.2) and one(perf.calmar_ratio(simple)) == pytest.approx((np.prod(1 + np.array(SIMPLE)) ** 2 - 1) / 0.2)
    table = perf.drawdown_table(simple).orderBy("rank").collect()
    assert [(r["peak"], r["valley"], r["recovery"], r["length"], r["recovery_length"]) for r in table] == [(month_end(0), month_end(1), month_end(3), 3, 2), (month_end(3), month_end(4), month_end(5), 2, 1)]
    assert table[0]["max_drawdown"] == pytest.approx(-0.2)
    deep = series(spark, (0.1, -0.2, 0.3, 0.1, -0.1))
    rows = perf.drawdown_table(deep).orderBy("rank").collect()
    assert [(r["peak"], r["valley"], r["recovery"], r["length"], r["recovery_length"]) for r in rows] == [(month_end(0), month_end(1), month_end(2), 2, 1), (month_end(3), month_end(4), None, 1, None)]
    assert perf.drawdown_table(series(spark, (0.1, 0.1))).collect() == []
    assert one(perf.max_drawdown(series(spark, (-0.5, 0.1)))) == 0.0  # the first wealth is the first high


def test_against_a_benchmark(spark, simple):
    b = series(spark, (0.05, -0.1, None, 0.1, -0.05, 0.02))
    x, y = np.delete(np.array(SIMPLE), 2), np.array([0.05, -0.1, 0.1, -0.05, 0.02])
    assert one(perf.beta(simple, b)) == pytest.approx(np.cov(x, y)[0, 1] / y.var(ddof=1))
    assert one(perf.tracking_error(simple, b)) == pytest.approx((x - y).std(ddof=1) * math.sqrt(12))
    assert one(perf.information_ratio(simple, b)) == pytest.approx((x - y).mean() * 12 / ((x - y).std(ddof=1) * math.sqrt(12)))
    up = y > 0
    assert one(perf.capture_ratio(simple, b)) == pytest.approx((np.prod(1 + x[up]) - 1) / (np.prod(1 + y[up]) - 1))
    assert one(perf.capture_ratio(simple, series(spark, (0.1,) * 6), side="down")) is None
    assert one(perf.alpha(simple, simple)) == pytest.approx(0, abs=1e-12) and perf.active_returns(simple, series(spark, SIMPLE[:3])).count() == 3
    with pytest.raises(ValidationError):
        perf.capture_ratio(simple, b, side="left")


def test_calendar(spark):
    rows = frame(spark, "date date, ret double", [(date(2024, 1, 5), 0.1), (date(2024, 1, 9), 0.1), (date(2024, 3, 1), -0.1)])
    got = {r["date"]: r["ret"] for r in perf.aggregate_returns(rows).collect()}
    assert got == {date(2024, 1, 31): pytest.approx(0.21), date(2024, 2, 29): 0.0, date(2024, 3, 31): pytest.approx(-0.1)}
    assert {r["date"]: round(r["ret"], 9) for r in perf.aggregate_returns(rows, "quarter").collect()} == {date(2024, 3, 31): 0.089}
    r = perf.monthly_table(rows).first()
    assert (r["year"], round(r["01"], 9), r["04"], round(r["year_total"], 9)) == (2024, 0.21, None, 0.089)


def test_rolling(spark, simple):
    b = series(spark, (0.05, -0.1, 0.0, 0.1, -0.05, 0.02))
    vol = [r["rolling_volatility"] for r in perf.rolling_volatility(simple, 3).orderBy("date").collect()]
    assert vol[:2] == [None, None] and vol[2] == pytest.approx(np.std(SIMPLE[:3], ddof=1) * math.sqrt(12))
    hole = [r["rolling_volatility"] for r in perf.rolling_volatility(series(spark, (0.1, None, 0.1, 0.2, 0.3)), 3, periods_per_year=12).orderBy("date").collect()]
    assert [v is None for v in hole] == [True, True, True, True, False]
    for f, name in ((perf.rolling_beta, "rolling_beta"), (perf.rolling_tracking_error, "rolling_tracking_error"), (perf.rolling_information_ratio, "rolling_information_ratio")):
        got = [r[name] for r in f(simple, b, 6).orderBy("date").collect()]
        whole = {"rolling_beta": perf.beta, "rolling_tracking_error": perf.tracking_error, "rolling_information_ratio": perf.information_ratio}[name]
        assert got[:5] == [None] * 5 and got[5] == pytest.approx(one(whole(simple, b)))
    assert perf.rolling_sharpe(simple, 6).orderBy("date").collect()[5]["rolling_sharpe"] == pytest.approx(one(perf.sharpe_ratio(simple)))


def test_summary(spark, simple):
    got = {r["metric"]: r["value"] for r in perf.performance_summary(simple, series(spark, (0.05, -0.1, 0.0, 0.1, -0.05, 0.02))).collect()}
    assert len(got) == 22 and got["n_periods"] == 6 and got["periods_per_year"] == 12 and got["max_drawdown"] == pytest.approx(-0.2)
    assert {"var_0.05", "cvar_0.05", "up_capture", "active_return"} <= set(got)
    assert len(perf.performance_summary(simple).collect()) == 15


def test_frames_of_one_column_a_series(spark):
    x = np.random.default_rng(8).normal(0.01, 0.05, (30, 2))
    rows = [(month_end(k), float(a), None if k == 4 else float(b)) for k, (a, b) in enumerate(x)]
    wide = frame(spark, "date date, `fund A` double, `b.2` double", rows)
    alone = {n: series(spark, [r[i] for r in rows]) for i, n in ((1, "fund A"), (2, "b.2"))}
    bench = series(spark, [0.01 * (k % 3 - 1) for k in range(30)])
    for metric, args, more in ((perf.sharpe_ratio, (), {"risk_free": 0.01}), (perf.max_drawdown, (), {}), (perf.beta, (bench,), {}), (perf.value_at_risk, (), {"level": 0.1})):
        got = {r["series"]: r[1] for r in perf.each_column(metric, wide, *args, **more).collect()}
        assert got == {n: pytest.approx(one(metric(df, *args, **more))) for n, df in alone.items()}
    table = {(r["series"], r["metric"]): r["value"] for r in perf.each_column(perf.performance_summary, wide, bench).collect()}
    assert len(table) == 2 * 22 and table["b.2", "n_periods"] == 29
    assert {r["series"] for r in perf.each_column(perf.drawdown_table, wide, series=["b.2"]).collect()} == {"b.2"}
    with pytest.raises(ValidationError):
        perf.each_column(perf.hit_rate, wide.select("date"))
