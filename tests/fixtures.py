"""Small tables with known answers."""

import calendar
from datetime import date


def month_end(k, year=2024):
    y, m = year + k // 12, k % 12 + 1
    return date(y, m, calendar.monthrange(y, m)[1])


def frame(spark, columns, rows):
    return spark.createDataFrame([tuple(r) for r in rows], columns)


def quantile_panel(spark, holes=(), ties=False):
    """6 months x 10 ids: factor 0..9, forward return a hundredth of it."""
    rows = [(month_end(m), f"{i:02d}", None if i in holes else 1.0 if ties else float(i), i * 0.01, "A" if i < 5 else "B", 3.0 if i == 1 else 1.0) for m in range(6) for i in range(10)]
    return frame(spark, "date date, bid string, factor double, fwd_ret double, sector string, mktcap double", rows)


def holdings_panel(spark):
    """Three months; the last id is sold in the third."""
    weights = [(0.4, 0.3, 0.2, 0.1), (0.4, 0.3, 0.2, 0.1), (0.5, 0.3, 0.2)]
    ret, per = (0.10, -0.05, 0.02, 0.0), (10.0, 20.0, 30.0, 40.0)
    rows = [(month_end(m), "abcd"[i], w, 0.25, ret[i], "AABB"[i], per[i]) for m, ws in enumerate(weights) for i, w in enumerate(ws)]
    return frame(spark, "date date, bid string, weight double, bench_weight double, ret_1m double, sector string, per double", rows)


def risk_panel(spark):
    rows = [(month_end(m), b, w, 1 / 3, x, y, 0.10, 0.01) for m in range(2) for b, w, x, y in (("a", 0.5, 1.0, 0.0), ("b", 0.3, 0.0, 1.0), ("c", 0.2, 0.5, 0.5))]
    return frame(spark, "date date, bid string, weight double, bench_weight double, F1 double, F2 double, specific_risk double, specific_ret double", rows)


def segments(spark):
    rows = [(month_end(0), "A", 0.6, 0.5, 0.10, 0.08), (month_end(0), "B", 0.4, 0.5, 0.02, 0.04), (month_end(1), "A", 0.5, 0.5, -0.03, -0.02), (month_end(1), "B", 0.5, 0.5, 0.05, 0.03)]
    return frame(spark, "date date, segment string, wp double, wb double, rp double, rb double", rows)


def series(spark, values, year=2024, start=0):
    return frame(spark, "date date, ret double", [(month_end(start + k, year), v) for k, v in enumerate(values)])
