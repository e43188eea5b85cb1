"""One query per operator over the tables of :mod:`tidemark.plans.demo`, and the SQL that gives the same rows.

Dates are given as text and doubles rounded to nine decimals on both sides, as the order of addition is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import scalars
from tidemark.operators import attribution, holdings, performance, quantile, risk, signals, sketches, stats
from tidemark.plans import chart_data
from tidemark.plans.demo import COVARIANCE, FACTORS, SHOCKS, SPECIFIC_RISK, WINDOWS, Demo
from tidemark.sources import panel as panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def shaped(df: DataFrame, digits: int = 9) -> DataFrame:
    """Dates as text, counts as longs, doubles rounded."""
    as_ = {"date": lambda c: c.cast("string"), "double": lambda c: F.round(c, digits) + F.lit(0.0), "int": lambda c: c.cast("bigint")}
    return df.select(*(as_[kind](F.col(f"`{c}`")).alias(c) if kind in as_ else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(name: str, sql: str | None = None, digits: int = 9) -> Callable:
    """Register a function of :class:`Demo` under ``name``, with its SQL if SQL can say it.

    Six digits are kept of regressions on values in the hundreds, where doubles carry eleven or twelve.
    """

    def wrap(f: Callable[[Demo], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: shaped(f(Demo(spark, sf_dir)), digits)
        if sql is not None:
            SQL[name] = sql.replace(", 9) + 0.0", f", {digits}) + 0.0")
        return f

    return wrap


# ---- SQL that several queries share ------------------------------------------------------------------------------------

_Z = "({0} - avg({0}) over (partition by date)) / nullif(stddev_samp({0}) over (partition by date), 0)"
_PANEL = f"""
monthly as (select last_day(cast(l_shipdate as date)) as date, l_suppkey as bid, sum(cast(round(l_quantity) as bigint)) qty, sum(cast(round(l_tax * 100) as bigint)) tax,
 sum(cast(round(l_discount * 100) as bigint)) disc, sum(cast(round(l_extendedprice * 100) as bigint)) cents, count(*) n from lineitem group by 1, 2),
sectors as (select s_suppkey as bid, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
base as (select date, bid, sector, case when bid % 10 <> 0 then qty::double end as factor, tax::double / n as factor2, (disc::double / n - 5) / 100 as ret,
 cents::double / sum(cents) over (partition by date) as weight, 1.0::double / count(*) over (partition by date) as bench_weight, ln(cents::double / 100) as size, n::double as lines
 from monthly join sectors using (bid)),
scored as (select *, {_Z.format("factor2")} as F1, {_Z.format("size")} as F2, {_Z.format("lines")} as F3, {SPECIFIC_RISK}::double as specific_risk from base),
grid as (select date, row_number() over (order by date) as t from (select distinct date from monthly)),
dated as (select * from scored join grid using (date)),
panel as (select a.*, b.ret as fwd_ret, c.ret as fwd_ret_2 from dated a left join dated b on b.bid = a.bid and b.t = a.t + 1 left join dated c on c.bid = a.bid and c.t = a.t + 2)"""
_SERIES = f"""{_PANEL},
series as (select date, sum(weight * ret) as ret, sum(bench_weight * ret) as bench from panel group by date),
two as (select date, 'portfolio' as series, ret from series union all select date, 'benchmark', bench from series)"""


def _select(columns: str, body: str, prefix: str = _PANEL, more: str = "") -> str:
    """``with prefix[, more] select columns from body``; a column ``~x`` is rounded and a column ``@x`` is given as text."""
    out = []
    for c in (c.strip() for c in columns.split(";")):
        expression, _, name = c.lstrip("~@").rpartition(" as ") if " as " in c else (c.lstrip("~@"), "", c.lstrip("~@"))
        out.append(f"round({expression}, 9) + 0.0 as {name}" if c[0] == "~" else f"cast({expression} as varchar) as {name}" if c[0] == "@" else f"{expression} as {name}")
    return f"with {prefix}{', ' + more if more else ''} select {', '.join(out)} from {body}"


def _rank(x: str, keys: str) -> str:
    return f"(case when {x} is not null then rank() over (partition by {keys} order by {x} nulls last) + (count(*) over (partition by {keys}, {x}) - 1) / 2.0 end)"


def _corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp(case when {y} is not null then {x} end) * stddev_samp(case when {x} is not null then {y} end), 0)"


def _quantile(x: str, n: int = 5, missing: bool = False, desc: bool = False, name: str = "q") -> str:
    """Projection of the bucket of ``x`` by date."""
    bucket = f"least(greatest(cast(ceil(row_number() over (partition by date order by {x} {'desc' if desc else ''} nulls last, bid)::double / nullif(count({x}) over (partition by date), 0) * {n}) as bigint), 1), {n})"
    return f"case when count({x}) over (partition by date) >= {n} then case when {x} is not null then {bucket} {'else 0' if missing else ''} end end as {name}"


_T = "avg({0}) / nullif(stddev_samp({0}) / sqrt(count({0})), 0)"
_P = "(select case when m <= 4 then 252 when m <= 9 then 52 when m <= 20 then 26 when m <= 45 then 12 when m <= 75 then 6 when m <= 135 then 4 when m <= 250 then 2 when m <= 450 then 1 else 365.25 / m end from (select median(g) m from (select date_diff('day', lag(date) over (order by date), date) g from (select distinct date from {0}))))"
_CAGR = "pow(product(1 + {0}), 12.0 / count({0})) - 1"


def _newey_west(source: str, key: str, x: str, name: str = "nw") -> str:
    """CTEs ending in (key, t_stat_nw) for ``source`` (key, date, x)."""
    return f"""
{name}_v as (select {key}, {x} - avg({x}) over (partition by {key}) as e, avg({x}) over (partition by {key}) as mean, count(*) over (partition by {key}) as n, row_number() over (partition by {key} order by date) as rn from {source} where {x} is not null),
{name}_w as (select *, least(floor(4 * pow(n / 100.0, 2.0 / 9)), n - 1) as most from {name}_v),
{name}_g as (select a.{key}, a.rn - b.rn as k, any_value(a.most) as most, any_value(a.n) as n, any_value(a.mean) as mean, sum(a.e * b.e) / any_value(a.n) as g from {name}_w a join {name}_w b on a.{key} = b.{key} and a.rn - b.rn between 0 and a.most group by 1, 2),
{name} as (select {key}, case when any_value(n) >= 2 and sum(case when k = 0 then g else 2 * (1 - k / (most + 1)) * g end) > 0 then any_value(mean) / sqrt(sum(case when k = 0 then g else 2 * (1 - k / (most + 1)) * g end) / any_value(n)) end as t_stat_nw from {name}_g group by 1)"""


_WEALTH = "product(1 + coalesce({0}, 0)) over (partition by {1} order by date rows unbounded preceding)"

# ---- core ----------------------------------------------------------------------------------------------------------------


@query("c3_as_wide", _select("@date; ~max(case when sector = 'ASIA' then a end) as ASIA; ~max(case when sector = 'EUROPE' then a end) as EUROPE", "s group by date", more="s as (select date, sector, sum(weight) as a from panel group by 1, 2)"))
def _(x: Demo) -> DataFrame:
    rows = holdings.allocation(x.panel, by="sector")
    return panels.as_wide(rows, "allocation", ids=["ASIA", "EUROPE"], id_col="sector")


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("c3_as_wide_all", _select("@date; " + "; ".join(f"~max(case when sector = '{r}' then a end) as \"{r}\"" for r in _REGIONS), "s group by date", more="s as (select date, sector, sum(weight) as a from panel group by 1, 2)"))
def _(x: Demo) -> DataFrame:
    return panels.as_wide(holdings.allocation(x.panel, by="sector"), "allocation", id_col="sector")


@query("c4_to_long", _select("@date; name as bid; ~v as value", "(select date, 'F1' as name, avg(F1) as v from panel group by 1 union all select date, 'ret', avg(ret) from panel group by 1) where v is not null"))
def _(x: Demo) -> DataFrame:
    return panels.to_long(x.panel.groupBy("date").agg(F.avg("F1").alias("F1"), F.avg("ret").alias("ret")))


@query("c7_infer_periods_per_year", f"with o as (select cast(o_orderdate as date) as date from orders), l as (select last_day(cast(l_shipdate as date)) as date from lineitem) select 'orders' as name, cast({_P.format('o')} as double) as periods_per_year union all select 'lineitem', cast({_P.format('l')} as double)")
def _(x: Demo) -> DataFrame:
    daily = panels.infer_periods_per_year(x.table("orders").select(F.to_date("o_orderdate").alias("date")))
    return daily.select(F.lit("orders").alias("name"), "periods_per_year").unionAll(panels.infer_periods_per_year(x.months).select(F.lit("lineitem"), "periods_per_year"))


@query("c6_check_duplicates", _select("count(*) as n", "(select distinct date, bid from panel)"))
def _(x: Demo) -> DataFrame:
    panels.check_duplicates(x.monthly, ["date", "bid"])
    return x.monthly.agg(F.count("*").alias("n"))


# ---- signals -------------------------------------------------------------------------------------------------------------

_CLIP = "case when {0} < {1} then {1} when {0} > {2} then {2} else {0} end"


@query("s1_winsorize", _select("@date; bid; ~" + _CLIP.format("factor", "lo", "hi") + " as factor_winsorized", "(select *, quantile_cont(factor, 0.05) over (partition by date) lo, quantile_cont(factor, 0.95) over (partition by date) hi from panel)"))
def _(x: Demo) -> DataFrame:
    return signals.winsorize(x.panel, factor="factor", lower=0.05, upper=0.95).select("date", "bid", "factor_winsorized")


@query("s2_clip_outliers", _select("@date; bid; ~" + _CLIP.format("factor2", "(m - 1.5 * s)", "(m + 1.5 * s)") + " as factor2_clipped", "(select *, avg(factor2) over w m, stddev_samp(factor2) over w s from panel window w as (partition by date, sector))"))
def _(x: Demo) -> DataFrame:
    return signals.clip_outliers(x.panel, factor="factor2", n_sigma=1.5, group="sector").select("date", "bid", "factor2_clipped")


@query("s3a_standardize_zscore", _select("@date; bid; ~(factor - avg(factor) over w) / nullif(stddev_samp(factor) over w, 0) as factor_z", "panel window w as (partition by date, sector)"))
def _(x: Demo) -> DataFrame:
    return signals.standardize(x.panel, factor="factor", group="sector").select("date", "bid", "factor_z")


@query("s3b_standardize_rank", _select(f"@date; bid; ~{_rank('factor', 'date')} / nullif(count(factor) over (partition by date), 0) as factor_rank", "panel"))
def _(x: Demo) -> DataFrame:
    return signals.standardize(x.panel, factor="factor", method="rank").select("date", "bid", "factor_rank")


@query("s3c_standardize_weighted", _select("@date; bid; ~case when count(x) over d >= 2 then (x - m) / nullif(sqrt(sum(w * (x - m) * (x - m)) over d / sum(w) over d), 0) end as factor_z", "v window d as (partition by date)", more="u as (select date, bid, case when factor is not null then weight end w, factor x from panel), v as (select *, sum(w * x) over (partition by date) / sum(w) over (partition by date) m from u)"))
def _(x: Demo) -> DataFrame:
    return signals.standardize(x.panel, factor="factor", weight="weight").select("date", "bid", "factor_z")


_FWL = """u as (select date, bid, sector, size, factor, case when count(factor) over (partition by date) > 2 + count(distinct sector) over (partition by date) then factor end y from panel),
 v as (select *, y - avg(y) over g dy, size - avg(case when y is not null then size end) over g dx from u window g as (partition by date, sector)),
 r as (select date, bid, y, dy - dx * coalesce(sum(case when y is not null then dx * dy end) over (partition by date) / nullif(sum(case when y is not null then dx * dx end) over (partition by date), 0), 0) as res from v)"""


@query("s4_neutralize", _select("@date; bid; ~res as factor_neutral", "r", more=_FWL), digits=6)
def _(x: Demo) -> DataFrame:
    return signals.neutralize(x.panel, factor="factor", by=["sector", "size"]).select("date", "bid", "factor_neutral")


_LINES = "ln as (select make_date(year(l_shipdate), 1, 1) as date, l_orderkey as o, l_linenumber as line, round(l_extendedprice * 100) / 100000 as y, l_quantity::double as x, l_partkey as k from lineitem)"
_WITHIN = f"""{_LINES}, lw as (select *, y - avg(y) over g as dy, x - avg(x) over g as dx from ln window g as (partition by date, k)),
 sz as (select date, count(*) > 2 + count(distinct k) as enough, sum(dx * dy) / nullif(sum(dx * dx), 0) as b, avg(y) as m from lw group by date),
 lr as (select l.*, case when enough then dy - coalesce(b, 0) * dx end as res, m from lw l join sz using (date))"""


@query("s4_neutralize_many_classes", f"with {_WITHIN} select cast(date as varchar) as date, o as \"order\", line, round(res, 9) + 0.0 as price_neutral from lr", digits=6)
def _(x: Demo) -> DataFrame:
    return signals.neutralize(x.lines, factor="price", by=["quantity", "part"], absorb=True).select("date", "order", "line", "price_neutral")


@query("s8_explained_ratio_many_classes", f"with {_WITHIN} select cast(date as varchar) as date, round(1 - sum(res * res) / sum(pow(y - m, 2)), 9) + 0.0 as r_squared from lr where res is not null group by date")
def _(x: Demo) -> DataFrame:
    return signals.explained_ratio(x.lines, factor="price", factors=["quantity", "part"], absorb="part")


@query("s7_factor_exposure_many_classes", f"with {_WITHIN} select cast(date as varchar) as date, 'quantity' as term, round(b, 9) + 0.0 as coef from sz where enough", digits=6)
def _(x: Demo) -> DataFrame:
    return signals.factor_exposure(x.lines, factor="price", factors=["quantity", "part"], absorb=True, levels=False)


def _disc(x: str, p: float, over: str) -> str:
    """The value at rank ceil(p n) of its partition, from columns ``rn`` and ``n``."""
    return f"max(case when rn = greatest(ceil({p} * n), 1) then {x} end){over}"


@query("s1_winsorize_sketched", _select("@date; bid; ~" + _CLIP.format("factor", "lo", "hi") + " as factor_winsorized", f"(select *, {_disc('factor', 0.05, ' over (partition by date)')} lo, {_disc('factor', 0.95, ' over (partition by date)')} hi from (select *, row_number() over (partition by date order by factor nulls last) rn, count(factor) over (partition by date) n from panel))"))
def _(x: Demo) -> DataFrame:
    return signals.winsorize(x.panel, factor="factor", lower=0.05, upper=0.95, accuracy=10_000).select("date", "bid", "factor_winsorized")


# a sketch's ranks against its stated error, from the values themselves
@query("s6_sketched_quantiles", _select("@date; n; true as within", "(select date, count(factor) as n from panel group by date) where n > 0"))
def _(x: Demo) -> DataFrame:
    by_sector = sketches.quantile_sketches(x.panel, value="factor", by=("date", "sector"))
    found = sketches.sketch_quantiles(sketches.merged_sketches(by_sector, by=("date",)), {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    rows = x.panel.select("date", "factor").where("factor is not null").join(found, "date")
    at = lambda n: (F.avg((F.col("factor") < F.col(n)).cast("double")), F.avg((F.col("factor") <= F.col(n)).cast("double")))
    ranks = rows.groupBy("date").agg(F.max("n").alias("n"), *(c.alias(f"{n}_{i}") for n in ("p10", "p50", "p90") for i, c in enumerate(at(n))))
    error = sketches.rank_error()
    ok = [(F.col(f"{n}_0") <= q + error) & (F.col(f"{n}_1") >= q - error) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]
    return ranks.select("date", "n", (ok[0] & ok[1] & ok[2]).alias("within"))


@query("s5_coverage", _select("@date; count(factor) as n_valid; any_value(u) as n_total; ~1 - count(factor) / count(*)::double as missing_rate; ~count(factor) / any_value(u)::double as coverage_rate", "panel, (select count(*) u from supplier) group by date"))
def _(x: Demo) -> DataFrame:
    every = x.months.crossJoin(x.sectors.select("bid"))  # the universe of a month is every supplier
    return signals.coverage(x.panel, factor="factor", universe=every)


@query("s6_distribution_summary", _select("@date; ~avg(factor) as mean; ~stddev_samp(factor) as std; ~case when count(factor) >= 3 then case when max(factor) = min(factor) then 0 else skewness(factor) end end as skew; ~case when count(factor) >= 4 then case when max(factor) = min(factor) then 0 else kurtosis(factor) end end as kurtosis; ~min(factor) as min; ~quantile_cont(factor, 0.01) as p01; ~quantile_cont(factor, 0.5) as p50; ~quantile_cont(factor, 0.99) as p99; ~max(factor) as max", "panel group by date"))
def _(x: Demo) -> DataFrame:
    return signals.distribution_summary(x.panel, factor="factor")


_ONE = "o as (select date, regr_slope(factor, size) as coef, regr_r2(factor, size) as r2 from panel group by date having count(factor) > 2)"


@query("s7_factor_exposure", _select("@date; 'size' as term; ~coef", "o", more=_ONE), digits=6)
def _(x: Demo) -> DataFrame:
    return signals.factor_exposure(x.panel, factor="factor", factors=["size"])


@query("s8_explained_ratio", _select("@date; ~r2 as r_squared", "o", more=_ONE))
def _(x: Demo) -> DataFrame:
    return signals.explained_ratio(x.panel, factor="factor", factors=["size"])


@query("s9_exposure_summary", _select(f"term; ~avg(coef) as mean; ~stddev_samp(coef) as std; ~{_T.format('coef')} as t_stat; ~any_value(t_stat_nw) as t_stat_nw; ~count_if(coef > 0) / count(coef)::double as hit_rate; count(coef) as n_periods", "e join nw using (term) group by term", more=f"{_ONE}, e as (select 'size' as term, date, coef from o), {_newey_west('e', 'term', 'coef')}"))
def _(x: Demo) -> DataFrame:
    return signals.exposure_summary(signals.factor_exposure(x.panel, factor="factor", factors=["size"]))


_RANKED = f"k as (select date, sector, {_rank('factor', 'date')} rx, {_rank('factor2', 'date')} rf, {_rank('fwd_ret', 'date')} ry, factor, factor2, fwd_ret, fwd_ret_2, {_rank('fwd_ret_2', 'date')} rz from panel)"


@query("s10_signal_correlation", _select("a as factor_1; b as factor_2; ~avg(c) as correlation", f"(select date, 'factor' a, 'factor2' b, {_corr('rx', 'rf')} c from k group by date union all select date, 'factor2', 'factor', {_corr('rf', 'rx')} from k group by date union all select date, 'factor', 'factor', {_corr('rx', 'rx')} from k group by date union all select date, 'factor2', 'factor2', {_corr('rf', 'rf')} from k group by date) group by a, b", more=_RANKED))
def _(x: Demo) -> DataFrame:
    return signals.signal_correlation(x.panel, factors=["factor", "factor2"])


@query("s11_rolling_signal_correlation", _select(f"@date; ~{_corr('factor', 'factor2')} as correlation", "panel group by date"))
def _(x: Demo) -> DataFrame:
    return signals.rolling_signal_correlation(x.panel, factors=["factor", "factor2"], method="pearson")


# ---- quantile portfolios ---------------------------------------------------------------------------------------------------

_QR = f"q as (select *, {_quantile('factor')} from panel), qr as (select date, q as quantile, avg(fwd_ret) as ret from q where q is not null and fwd_ret is not null group by 1, 2)"
_QUANTILE_RETURNS = {"factor": "factor", "forward_return": "fwd_ret"}


@query("q1_assign_quantiles", _select(f"@date; bid; {_quantile('factor', missing=True, desc=True, name='quantile')}", "panel").replace(" as quantile as case when", ""))
def _(x: Demo) -> DataFrame:
    return quantile.assign_quantiles(x.panel, factor="factor", ascending=False, missing_class=True).select("date", "bid", "quantile")


@query("q2_quantile_returns", _select("@date; quantile; ~ret", "qr", more=_QR))
def _(x: Demo) -> DataFrame:
    return quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS)


@query("q2_quantile_returns_weighted", _select("@date; q as quantile; ~sum(weight * fwd_ret) / nullif(sum(weight), 0) as ret", f"(select *, {_quantile('factor', missing=True)} from panel) where q is not null and fwd_ret is not null group by date, q"))
def _(x: Demo) -> DataFrame:
    return quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS, weight="weight", include_missing=True)


@query("q2_quantile_returns_wide", _select("@date; " + "; ".join(f"~max(case when quantile = {i} then ret end) as Q{i}" for i in range(1, 6)), "qr group by date", more=_QR))
def _(x: Demo) -> DataFrame:
    return quantile.widen(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS), 5)


@query("q3_class_returns", _select("@date; sector as class; ~avg(fwd_ret) as ret", "panel where fwd_ret is not null group by date, sector"))
def _(x: Demo) -> DataFrame:
    return quantile.class_returns(x.panel, classes="sector", forward_return="fwd_ret")


_DS = f"ds as (select date, q1, q2, fwd_ret from (select *, {_quantile('factor', 3, name='q1')}, {_quantile('factor2', 2, name='q2')} from panel) where q1 is not null and q2 is not null), cells as (select date, q1, q2, avg(fwd_ret) ret from ds where fwd_ret is not null group by 1, 2, 3)"
_DOUBLE = {"factor_1": "factor", "factor_2": "factor2", "n_quantiles_1": 3, "n_quantiles_2": 2}


@query("q4_double_sort_returns", _select("@date; q1; q2; ~ret", "cells", more=_DS))
def _(x: Demo) -> DataFrame:
    return quantile.double_sort_returns(x.panel, forward_return="fwd_ret", **_DOUBLE)


@query("q5_double_sort_summary", _select(f"q1; q2; ~case when count(*) >= 2 then {_CAGR.format('ret')} end as annualized_return", "cells group by q1, q2", more=_DS))
def _(x: Demo) -> DataFrame:
    return quantile.double_sort_summary(quantile.double_sort_returns(x.panel, forward_return="fwd_ret", **_DOUBLE))


@query("q6_double_sort_counts", _select("q1; q2; ~avg(n) as mean_count", "(select date, q1, q2, count(*) n from ds group by 1, 2, 3) group by q1, q2", more=_DS))
def _(x: Demo) -> DataFrame:
    return quantile.double_sort_counts(x.panel, **_DOUBLE)


_SUMMED = f"~avg(ret) as mean; ~stddev_samp(ret) as std; ~{_CAGR.format('ret')} as annualized_return; ~stddev_samp(ret) * sqrt(12) as annualized_volatility; ~avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as sharpe_ratio; ~min(dd) as max_drawdown; ~count_if(ret > 0) / count(ret)::double as hit_rate; ~{_T.format('ret')} as t_stat; ~any_value(t_stat_nw) as t_stat_nw; count(ret) as n_periods"


@query("q7_quantile_summary", _select(f"quantile; {_SUMMED}", "(select *, w / max(w) over (partition by quantile order by date rows unbounded preceding) - 1 as dd from wealth) join nw using (quantile) group by quantile", more=f"{_QR}, wealth as (select *, {_WEALTH.format('ret', 'quantile')} as w from qr), {_newey_west('qr', 'quantile', 'ret')}"))
def _(x: Demo) -> DataFrame:
    return quantile.quantile_summary(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS))


@query("q7_quantile_errors", _select("quantile; ~avg(ret) as mean; ~stddev_samp(ret) / sqrt(count(ret)) as std_error; ~abs(avg(ret) / nullif(any_value(t_stat_nw), 0)) as std_error_nw; count(ret) as n_periods", "qr join nw using (quantile) group by quantile", more=f"{_QR}, {_newey_west('qr', 'quantile', 'ret')}"))
def _(x: Demo) -> DataFrame:
    return quantile.quantile_errors(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS))


@query("q8_long_short_returns", _select("@date; ~max(case when quantile = 5 then ret end) - max(case when quantile = 1 then ret end) as ret", "qr group by date", more=_QR))
def _(x: Demo) -> DataFrame:
    return quantile.long_short_returns(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS))


_IC = f"{_RANKED}, ic as (select date, case when count_if(rx is not null and ry is not null) >= 5 then {_corr('rx', 'ry')} end as ic from k group by date)"


@query("q9_information_coefficient", _select("@date; ~ic", "ic", more=_IC))
def _(x: Demo) -> DataFrame:
    return quantile.information_coefficient(x.panel, **_QUANTILE_RETURNS)


@query("q9g_information_coefficient_by_group", _select(f"@date; sector; ~case when count(*) >= 5 then {_corr('rx', 'ry')} end as ic", "r group by date, sector", more=f"c as (select * from panel where factor is not null and fwd_ret is not null), r as (select date, sector, {_rank('factor', 'date, sector')} rx, {_rank('fwd_ret', 'date, sector')} ry from c)"))
def _(x: Demo) -> DataFrame:
    return quantile.information_coefficient(x.panel, **_QUANTILE_RETURNS, group="sector")


_IC_SUMMED = f"~avg(ic) as mean; ~stddev_samp(ic) as std; ~avg(ic) / nullif(stddev_samp(ic), 0) as icir; ~avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(12) as icir_annualized; ~{_T.format('ic')} as t_stat; ~any_value(t_stat_nw) as t_stat_nw; ~count_if(ic > 0) / count(ic)::double as hit_rate; count(ic) as n_periods"


@query("q10_ic_summary", _select(_IC_SUMMED, "i join nw using (one) where ic is not null group by one", more=f"{_IC}, i as (select 1 as one, date, ic from ic), {_newey_west('i', 'one', 'ic')}"))
def _(x: Demo) -> DataFrame:
    return quantile.ic_summary(quantile.information_coefficient(x.panel, **_QUANTILE_RETURNS))


@query("q11_factor_decay", _select(f"horizon; {_IC_SUMMED}", "i join nw using (horizon) where ic is not null group by horizon", more=f"{_RANKED}, i as (select 'fwd_ret' as horizon, date, case when count_if(rx is not null and ry is not null) >= 5 then {_corr('rx', 'ry')} end as ic from k group by date union all select 'fwd_ret_2', date, case when count_if(rx is not null and rz is not null) >= 5 then {_corr('rx', 'rz')} end from k group by date), {_newey_west('i', 'horizon', 'ic')}"))
def _(x: Demo) -> DataFrame:
    return quantile.factor_decay(x.panel, factor="factor", forward_returns=["fwd_ret", "fwd_ret_2"])


@query("q12_factor_autocorrelation", _select("lag; ~avg(c) as autocorrelation", f"(select b.lag, a.t, {_corr('a.x', 'b.x')} c from k a join (select bid, x, t, unnest([1, 2, 3]::bigint[]) as lag from k) b on a.bid = b.bid and a.t = b.t + b.lag group by 1, 2) group by lag", more=f"k as (select t, bid, {_rank('factor', 'date')} x from panel qualify x is not null)"))
def _(x: Demo) -> DataFrame:
    return quantile.factor_autocorrelation(x.panel, factor="factor", lags=(1, 2, 3))


_MEMBERS = f"m as (select t, bid, q from (select *, {_quantile('factor', missing=True)} from panel) where q is not null)"


@query("q13_quantile_turnover", _select("@g.date as date; g.q as quantile; ~s.turnover as turnover", "(select date, t, unnest([0, 1, 2, 3, 4, 5]) as q from grid) g left join s using (t, q)", more=f"{_MEMBERS}, s as (select a.t + 1 as t, a.q, (count(*) - count(b.bid)) / count(*)::double as turnover from m a left join m b on b.bid = a.bid and b.t = a.t + 1 and b.q = a.q group by 1, 2)").replace("0, 1, 2, 3, 4, 5]", "0, 1, 2, 3, 4, 5]::bigint[]"))
def _(x: Demo) -> DataFrame:
    return quantile.quantile_turnover(x.panel, factor="factor", include_missing=True)


@query("q14_quantile_transition_matrix", _select("f as from_quantile; g as to_quantile; ~case when sum(n) over (partition by f) is not null and sum(n) over (partition by g) is not null then coalesce(n, 0) / sum(n) over (partition by f) end as probability", "(select f, unnest([0, 1, 2, 3, 4, 5]::bigint[]) as g from (select unnest([0, 1, 2, 3, 4, 5]::bigint[]) as f)) left join c using (f, g)", more=f"{_MEMBERS}, c as (select a.q as f, b.q as g, count(*) n from m a join m b on b.bid = a.bid and b.t = a.t + 1 group by 1, 2)"))
def _(x: Demo) -> DataFrame:
    return quantile.quantile_transition_matrix(x.panel, factor="factor", include_missing=True)


# ---- holdings ----------------------------------------------------------------------------------------------------------------


@query("h1_concentration", _select("@date; count(*) as n_holdings; ~sum(weight * weight) as hhi; ~1 / sum(weight * weight) as effective_n; ~sum(case when place <= 10 then weight end) as top10_share; ~sum(case when place <= 20 then weight end) as top20_share", "(select *, row_number() over (partition by date order by weight desc, bid) as place from panel) group by date"))
def _(x: Demo) -> DataFrame:
    return holdings.concentration(x.panel)


@query("h2_allocation", _select("@date; sector; ~sum(weight) - sum(bench_weight) as allocation", "panel group by date, sector"))
def _(x: Demo) -> DataFrame:
    return holdings.allocation(x.panel, by="sector", benchmark_weight="bench_weight")


@query("h3_top_holdings", _select("@date; bid; ~weight; ~weight - bench_weight as active_weight", "(select *, row_number() over (order by weight - bench_weight desc, bid) a, count(*) over () n from panel where date = (select max(date) from panel)) where a <= 5 or a > n - 5"))
def _(x: Demo) -> DataFrame:
    return holdings.top_holdings(x.panel, n=5, benchmark_weight="bench_weight").select("date", "bid", "weight", "active_weight")


@query("h4_characteristics", _select("@date; ~sum(case when factor is not null then weight * factor end) / sum(case when factor is not null then weight end) - sum(case when factor is not null then bench_weight * factor end) / sum(case when factor is not null then bench_weight end) as factor; ~sum(weight * size) / sum(weight) - sum(bench_weight * size) / sum(bench_weight) as size", "panel group by date"))
def _(x: Demo) -> DataFrame:
    return holdings.characteristics(x.panel, columns=["factor", "size"], benchmark_weight="bench_weight")


@query("h5_contribution", _select("@date; bid; ~weight * fwd_ret as contribution", "panel"))
def _(x: Demo) -> DataFrame:
    return holdings.contribution(x.panel, forward_return="fwd_ret")


@query("h5_contribution_by_segment", _select("@date; sector; ~coalesce(sum(weight * fwd_ret), 0) as contribution", "panel group by date, sector"))
def _(x: Demo) -> DataFrame:
    return holdings.contribution(x.panel, forward_return="fwd_ret", by="sector")


@query("h6_top_contributors", _select("bid; ~c as contribution; k as n_periods; case when n <= 6 then case when c >= 0 then 'top' else 'bottom' end when a <= 3 then 'top' else 'bottom' end as side", "(select *, row_number() over (order by c desc, bid) a, count(*) over () n from (select bid, sum(weight * fwd_ret) c, count(weight * fwd_ret) k from panel group by bid) where c is not null) where a <= 3 or a > n - 3"))
def _(x: Demo) -> DataFrame:
    return holdings.top_contributors(x.panel, forward_return="fwd_ret", n=3)


_STEPS = "h as (select t, bid, weight w from panel where weight <> 0), st as (select coalesce(a.t, b.t + 1) as t, coalesce(b.w, 0) as w0, coalesce(a.w, 0) as w1 from h a full join h b on a.bid = b.bid and a.t = b.t + 1)"


@query("h7_turnover", _select("@date; ~case when grid.t > 1 then coalesce(sum(abs(w1 - w0)), 0) / 2 end as turnover", "grid left join st using (t) group by date, grid.t", more=_STEPS))
def _(x: Demo) -> DataFrame:
    return holdings.turnover(x.panel)


@query("h8_trades", _select("@date; case when grid.t > 1 then count_if(w0 = 0 and w1 <> 0) end as n_new; case when grid.t > 1 then count_if(w0 <> 0 and w1 = 0) end as n_closed; ~case when grid.t > 1 then sum(greatest(w1 - w0, 0)) end as weight_bought; ~case when grid.t > 1 then sum(greatest(w0 - w1, 0)) end as weight_sold", "grid left join st using (t) group by date, grid.t", more=_STEPS))
def _(x: Demo) -> DataFrame:
    return holdings.trades(x.panel)


@query("h9_average_holding_period", _select("bid; ~count(*) / sum(case when p = t - 1 then 0 else 1 end)::double as avg_holding_period", "(select bid, t, lag(t) over (partition by bid order by t) p from panel where weight <> 0) group by bid"))
def _(x: Demo) -> DataFrame:
    return holdings.average_holding_period(x.panel)


_SPELLS = "sl as (select bid, min(t) as f, max(t) as l, min(date) as s, max(date) as e, count(*) as p from (select h.*, t - row_number() over (partition by bid order by t) as run from (select date, bid, t from panel join grid using (date, t) where weight > 0.5 / 100 and bid % 10 <> 0) h) group by bid, run), tm as (select max(t) as tm from grid)"


@query("h10_holding_spells", _select('bid; @s as start; @e as "end"; p as periods; f = 1 as open_start; l = tm as open_end', "sl, tm", more=_SPELLS))
def _(x: Demo) -> DataFrame:
    return holdings.holding_spells(x.traded)


@query("h11_holding_period_distribution", _select("p as periods; r as at_risk; c::bigint as closed; o::bigint as censored; ~product(1 - c / r::double) over (order by p) as survival", "(select p, sum(c) over (order by p desc)::bigint + sum(o) over (order by p desc)::bigint as r, c, o from (select p, count_if(l < tm) as c, count_if(l = tm) as o from sl, tm group by p))", more=_SPELLS))
def _(x: Demo) -> DataFrame:
    return holdings.holding_period_distribution(x.traded)


# ---- performance ----------------------------------------------------------------------------------------------------------


def _per_series(columns: str, body: str = "two group by series", more: str = "") -> str:
    return _select(f"series; {columns}", body, _SERIES, more)


def _metric(name: str, sql: str | None, build: Callable[[Demo], DataFrame]) -> None:
    query(name, sql)(build)


_BOTH = {"by": "series"}
_DD = f"wl as (select *, {_WEALTH.format('ret', 'series')} as w from two), dd as (select *, w / max(w) over (partition by series order by date rows unbounded preceding) - 1 as dd from wl)"
_RF = "(ret - (pow(1.01, 1 / 12.0) - 1))"
_metric("p1_cumulative_returns", _select(f"@date; series; ~{_WEALTH.format('ret', 'series')} - 1 as cumulative_return", "two", _SERIES), lambda x: performance.cumulative_returns(x.two_series, **_BOTH))
_metric("p1_cumulative_returns_log", _select("@date; series; ~sum(ln(1 + coalesce(ret, 0))) over (partition by series order by date rows unbounded preceding) as cumulative_return", "two", _SERIES), lambda x: performance.cumulative_returns(x.two_series, log=True, **_BOTH))
_metric("p2_total_return", _per_series("~product(1 + ret) - 1 as total_return"), lambda x: performance.total_return(x.two_series, **_BOTH))
_metric("p3_annualized_return", _per_series(f"~{_CAGR.format('ret')} as annualized_return"), lambda x: performance.annualized_return(x.two_series, **_BOTH))
_metric("p4_annualized_volatility", _per_series("~stddev_pop(ret) * sqrt(12) as annualized_volatility"), lambda x: performance.annualized_volatility(x.two_series, ddof=0, **_BOTH))
_metric("p5_sharpe_ratio", _per_series(f"~avg({_RF}) / nullif(stddev_samp({_RF}), 0) * sqrt(12) as sharpe_ratio"), lambda x: performance.sharpe_ratio(x.two_series, risk_free=0.01, **_BOTH))
_metric("p6_sortino_ratio", _per_series(f"~avg({_RF}) / nullif(sqrt(avg(pow(least({_RF} - 0.001, 0), 2))), 0) * sqrt(12) as sortino_ratio"), lambda x: performance.sortino_ratio(x.two_series, risk_free=0.01, target=0.001, **_BOTH))
_metric("p7_calmar_ratio", _per_series(f"~({_CAGR.format('ret')}) / nullif(abs(min(dd)), 0) as calmar_ratio", "dd group by series", _DD), lambda x: performance.calmar_ratio(x.two_series, **_BOTH))
_metric("p8_drawdown", _select("@date; series; ~dd as drawdown", "dd", _SERIES, _DD), lambda x: performance.drawdown(x.two_series, **_BOTH))
_metric("p9_max_drawdown", _per_series("~min(dd) as max_drawdown", "dd group by series", _DD), lambda x: performance.max_drawdown(x.two_series, **_BOTH))
_EPISODES = f"{_DD}, po as (select *, row_number() over s as pos, lag(date) over s as prev, lead(date) over s as nxt, dd < 0 as under from dd window s as (partition by series order by date)), sp as (select *, sum(case when under then 0 else 1 end) over (partition by series order by date) as spell from po), ep as (select series, spell, min(pos) f, max(pos) l, coalesce(min_by(prev, pos) filter (prev is not null), min(date)) as peak, min_by(date, struct_pack(d := dd, p := pos)) as valley, min_by(pos, struct_pack(d := dd, p := pos)) as vp, max_by(struct_pack(x := nxt), pos).x as recovery, min(dd) as depth from sp where under group by 1, 2)"
_metric("p10_drawdown_table", _select("series; a as rank; @peak; @valley; @recovery; ~depth as max_drawdown; l + (recovery is not null)::int - greatest(f - 1, 1) as length; case when recovery is not null then l + 1 - vp end as recovery_length", "(select *, row_number() over (partition by series order by depth, f) a from ep) where a <= 5", _SERIES, _EPISODES), lambda x: performance.drawdown_table(x.two_series, **_BOTH))
_metric("p11_value_at_risk", _per_series("~quantile_cont(ret, 0.05) as value_at_risk"), lambda x: performance.value_at_risk(x.two_series, **_BOTH))
_metric("p12_conditional_value_at_risk", _per_series("~avg(ret) as conditional_value_at_risk", "(select *, quantile_cont(ret, 0.05) over (partition by series) v from two) where ret <= v group by series"), lambda x: performance.conditional_value_at_risk(x.two_series, **_BOTH))
_metric("p13_hit_rate", _per_series("~count_if(ret > 0) / count(ret)::double as hit_rate"), lambda x: performance.hit_rate(x.two_series, **_BOTH))
_metric("p14_win_loss_ratio", _per_series("~avg(case when ret > 0 then ret end) / nullif(abs(avg(case when ret < 0 then ret end)), 0) as win_loss_ratio"), lambda x: performance.win_loss_ratio(x.two_series, **_BOTH))


def _versus(columns: str) -> str:
    return _select(columns, "(select *, ret - bench as a from series)", _SERIES)


_metric("p15_active_returns", _versus("@date; ~a as active_return"), lambda x: performance.active_returns(x.series, x.benchmark))
_metric("p16_tracking_error", _versus("~stddev_samp(a) * sqrt(12) as tracking_error"), lambda x: performance.tracking_error(x.series, x.benchmark))
_metric("p17_information_ratio", _versus("~avg(a) * 12 / nullif(stddev_samp(a) * sqrt(12), 0) as information_ratio"), lambda x: performance.information_ratio(x.series, x.benchmark))
_metric("p18_beta", _versus("~covar_samp(ret, bench) / nullif(var_samp(bench), 0) as beta"), lambda x: performance.beta(x.series, x.benchmark))
_ALPHA = f"({_CAGR.format('ret')}) - (0.01 + covar_samp(ret, bench) / nullif(var_samp(bench), 0) * (({_CAGR.format('bench')}) - 0.01))"
_metric("p19_alpha", _versus(f"~{_ALPHA} as alpha"), lambda x: performance.alpha(x.series, x.benchmark, risk_free=0.01))
_UP = "(product(case when bench {0} 0 then 1 + ret end) - 1) / nullif(product(case when bench {0} 0 then 1 + bench end) - 1, 0)"
_metric("p20_capture_ratio", _versus(f"~{_UP.format('<')} as down_capture"), lambda x: performance.capture_ratio(x.series, x.benchmark, side="down"))
_QUARTERS = "b as (select series, last_day(cast(date_trunc('quarter', date) + interval 2 month as date)) as d, product(1 + ret) - 1 as r from two group by 1, 2), sp as (select unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)), interval 3 month)) as m from b), gr as (select distinct last_day(cast(m as date)) as d, series from sp, (select distinct series from two))"
_metric("p21_aggregate_returns", _select("@d as date; series; ~coalesce(r, 0) as ret", "gr left join b using (d, series)", _SERIES, _QUARTERS), lambda x: performance.aggregate_returns(x.two_series, "quarter", **_BOTH))
_ORDERS = "od as (select last_day(cast(o_orderdate as date)) as d, o_orderpriority as series, product(1 + (o_totalprice - 150000) / 1e9) - 1 as r from orders group by 1, 2), sp as (select distinct d from od), gr as (select d, series from sp, (select distinct series from od))"
_metric("p21_streaming_aggregate_returns", f"with {_ORDERS} select cast(d as varchar) as date, series, round(coalesce(r, 0), 9) + 0.0 as ret from gr left join od using (d, series)", lambda x: x.streamed)
_metric("p22_monthly_table", _select("cast(year(date) as bigint) as year; " + "; ".join(f'~max(case when month(date) = {m} then ret end) as "{m:02d}"' for m in range(1, 13)) + "; ~product(1 + ret) - 1 as year_total", "series group by year(date)", _SERIES), lambda x: performance.monthly_table(x.series))
_ROLL = "w as (partition by series order by date rows 11 preceding)"
_metric("p23_rolling_volatility", _select("@date; series; ~case when count(ret) over w = 12 then stddev_samp(ret) over w * sqrt(12) end as rolling_volatility", f"two window {_ROLL}", _SERIES), lambda x: performance.rolling_volatility(x.two_series, 12, **_BOTH))
_metric("p24_rolling_sharpe", _select("@date; series; ~case when count(ret) over w = 12 then avg(ret) over w / nullif(stddev_samp(ret) over w, 0) * sqrt(12) end as rolling_sharpe", f"two window {_ROLL}", _SERIES), lambda x: performance.rolling_sharpe(x.two_series, 12, **_BOTH))
_ROLL1 = "(select *, ret - bench as a from series) window w as (order by date rows 11 preceding)"
_metric("p25_rolling_beta", _select("@date; ~case when count(*) over w = 12 then covar_samp(ret, bench) over w / var_samp(bench) over w end as rolling_beta", _ROLL1, _SERIES), lambda x: performance.rolling_beta(x.series, x.benchmark, 12))
_metric("p26_rolling_tracking_error", _select("@date; ~case when count(*) over w = 12 then stddev_samp(a) over w * sqrt(12) end as rolling_tracking_error", _ROLL1, _SERIES), lambda x: performance.rolling_tracking_error(x.series, x.benchmark, 12))
_metric("p27_rolling_information_ratio", _select("@date; ~case when count(*) over w = 12 then avg(a) over w / stddev_samp(a) over w * sqrt(12) end as rolling_information_ratio", _ROLL1, _SERIES), lambda x: performance.rolling_information_ratio(x.series, x.benchmark, 12))
_METRICS = {
    "total_return": "product(1 + ret) - 1", "annualized_return": _CAGR.format("ret"), "annualized_volatility": "stddev_samp(ret) * sqrt(12)", "sharpe_ratio": "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)",
    "sortino_ratio": "avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(12)", "calmar_ratio": f"({_CAGR.format('ret')}) / nullif(abs(min(dd)), 0)", "max_drawdown": "min(dd)", "var_0.05": "quantile_cont(ret, 0.05)", "cvar_0.05": "avg(case when ret <= v then ret end)",
    "hit_rate": "count_if(ret > 0) / count(ret)::double", "win_loss_ratio": "avg(case when ret > 0 then ret end) / nullif(abs(avg(case when ret < 0 then ret end)), 0)", "skew": "skewness(ret)", "kurtosis": "kurtosis(ret)", "n_periods": "count(ret)::double", "periods_per_year": "max(12.0::double)",
    "active_return": _CAGR.format("a"), "tracking_error": "stddev_samp(a) * sqrt(12)", "information_ratio": "avg(a) * 12 / nullif(stddev_samp(a) * sqrt(12), 0)", "beta": "covar_samp(ret, bench) / nullif(var_samp(bench), 0)", "alpha": f"({_CAGR.format('ret')}) - covar_samp(ret, bench) / nullif(var_samp(bench), 0) * ({_CAGR.format('bench')})",
    "up_capture": _UP.format(">"), "down_capture": _UP.format("<"),
}
_ALL = "wl as (select *, ret - bench as a, product(1 + ret) over (order by date rows unbounded preceding) as w, quantile_cont(ret, 0.05) over () as v from series), dd as (select *, w / max(w) over (order by date rows unbounded preceding) - 1 as dd from wl)"
_metric("p28_performance_summary", f"with {_SERIES}, {_ALL} " + " union all ".join(f"select '{n}' as metric, round({e}, 9) + 0.0 as value from dd" for n, e in _METRICS.items()), lambda x: performance.performance_summary(x.series, x.benchmark))

_metric("p5_sharpe_ratio_wide", _per_series(f"~avg({_RF}) / nullif(stddev_samp({_RF}), 0) * sqrt(12) as sharpe_ratio"), lambda x: performance.each_column(performance.sharpe_ratio, x.wide, risk_free=0.01))
_metric("p9_max_drawdown_wide", _per_series("~min(dd) as max_drawdown", "dd group by series", _DD), lambda x: performance.each_column(performance.max_drawdown, x.wide))

# ---- attribution ------------------------------------------------------------------------------------------------------------

_SEGMENTS = {"segment": "sector", "asset_return": "ret"}
_SEG = "seg as (select date, sector as segment, sum(weight) wp, sum(bench_weight) wb, coalesce(sum(weight * ret) / nullif(sum(weight), 0), 0) rp, coalesce(sum(bench_weight * ret) / nullif(sum(bench_weight), 0), 0) rb from panel group by 1, 2)"
_EFF = f"{_SEG}, eff as (select date, segment, (wp - wb) * (rb - sum(wb * rb) over (partition by date)) as allocation, wb * (rp - rb) as selection, (wp - wb) * (rp - rb) as interaction from seg), tot as (select date, sum(wp * rp) as p, sum(wb * rb) as b from seg group by date)"
_LINK = f"""{_EFF}, lk as (select *, product(1 + p) over () - 1 as tp, product(1 + b) over () - 1 as tb, coalesce(product(1 + p) over (order by date rows between unbounded preceding and 1 preceding), 1) as past,
 coalesce(product(1 + b) over (order by date rows between 1 following and unbounded following), 1) as later, product(1 + b) over (order by date rows unbounded preceding) as grown, coalesce(product(1 + b) over (order by date rows between unbounded preceding and 1 preceding), 1) as grown0 from tot),
 mm as (select count(*)::double as n, product(1 + p) - 1 as tp, product(1 + b) - 1 as tb, sum(p - b) as s1, sum(pow(p - b, 2)) as s2 from tot),
 mc as (select *, case when abs(tp - tb) < 1e-12 then pow(1 + tp, (n - 1) / n) else (tp - tb) / n / (pow(1 + tp, 1 / n) - pow(1 + tb, 1 / n)) end as m from mm),
 lf as (select lk.*, (select m + coalesce((tp - tb - m * s1) / nullif(s2, 0), 0) * (p - b) from mc) as menchero, (case when abs(p - b) < 1e-12 then 1 / (1 + p) else (ln(1 + p) - ln(1 + b)) / (p - b) end) / (case when abs(tp - tb) < 1e-12 then 1 / (1 + tp) else (ln(1 + tp) - ln(1 + tb)) / (tp - tb) end) as carino, past * later as grap from lk)"""
_NAMES = ("allocation", "selection", "interaction")
_metric("a1_aggregate_segments", _select("@date; segment; ~wp; ~wb; ~rp; ~rb", "seg", more=_SEG), lambda x: attribution.aggregate_segments(x.panel, **_SEGMENTS))
_metric("a2_brinson", _select("@date; segment; ~allocation; ~selection; ~interaction", "eff", more=_EFF), lambda x: attribution.brinson(x.panel, **_SEGMENTS))
_metric("a3_effects_from_segments", _select("@date; segment; ~(wp - wb) * rb as allocation; ~wp * (rp - rb) as selection", "seg", more=_SEG), lambda x: attribution.effects_from_segments(attribution.aggregate_segments(x.panel, **_SEGMENTS), model="bhb", terms=2))
_metric("a4_total_returns", _select("@date; ~p as portfolio; ~b as benchmark; ~p - b as active", "tot", more=_EFF), lambda x: attribution.total_returns(x.panel, **_SEGMENTS))


def _linked(method: str) -> Callable[[Demo], DataFrame]:
    def run(x: Demo) -> DataFrame:
        table = attribution.aggregate_segments(x.panel, **_SEGMENTS)
        return attribution.link(attribution.effects_from_segments(table), attribution.total_returns(table), method=method)

    return run


for _m in ("carino", "grap", "menchero"):
    _metric(f"a5_link_{_m}", _select("@date; segment; " + "; ".join(f"~{n} * {_m} as {n}" for n in _NAMES), "eff join lf using (date)", more=_LINK), _linked(_m))
_metric("a5_link_frongello", _select("@date; segment; " + "; ".join(f"~{n} * past + b * grown0 * coalesce(sum({n} * past / grown) over w, 0) as {n}" for n in _NAMES), "fu window w as (partition by segment order by date rows between unbounded preceding and 1 preceding)", more=f"{_LINK}, fu as (select l.*, s.segment, coalesce(allocation, 0) allocation, coalesce(selection, 0) selection, coalesce(interaction, 0) interaction from lf l cross join (select distinct segment from eff) s left join eff using (date, segment))"), _linked("frongello"))
_metric("a5_link_simple", _select("@date; segment; ~allocation; ~selection; ~interaction", "eff", more=_EFF), _linked("simple"))
_metric("a6_brinson_summary", _select("case when grouping(segment) = 1 then 'Total' else segment end as segment; " + "; ".join(f"~sum({n} * carino) as {n}" for n in _NAMES) + "; ~sum((allocation + selection + interaction) * carino) as total", "eff join lf using (date) group by rollup (segment)", more=_LINK), lambda x: attribution.brinson_summary(x.panel, **_SEGMENTS))

_NESTED = {"path": ["sector", "country"]}
_TREE = """lv as (select date, sector, n_name as country, weight wp, bench_weight wb, ret r from panel join supplier on s_suppkey = bid join nation on n_nationkey = s_nationkey),
 tr as (select date, case when grouping(country) = 1 then 1 else 2 end as level, case when grouping(country) = 1 then sector else sector || ' > ' || country end as segment, case when grouping(country) = 1 then '' else sector end as parent, sum(wp) wp, sum(wb) wb,
  coalesce(sum(wp * r) / nullif(sum(wp), 0), 0) rp, coalesce(sum(wb * r) / nullif(sum(wb), 0), 0) rb from lv group by grouping sets ((date, sector), (date, sector, country))),
 te as (select date, level, segment, case when level = 1 then (wp - wb) * (rb - sum(wb * rb) over w) else (wp - coalesce(wb * sum(wp) over w / nullif(sum(wb) over w, 0), 0)) * (rb - coalesce(sum(wb * rb) over w / nullif(sum(wb) over w, 0), 0)) end as allocation,
  case when level = 2 then wb * (rp - rb) else 0 end as selection, case when level = 2 then (wp - wb) * (rp - rb) else 0 end as interaction from tr window w as (partition by date, level, parent))"""
_metric("a7_nested_segments", _select("@date; level::bigint as level; segment; parent; ~wp; ~wb; ~rp; ~rb", "tr", more=_TREE), lambda x: attribution.nested_segments(x.nested, **_NESTED))
_metric("a7_nested_effects", _select("@date; level::bigint as level; segment; ~allocation; ~selection; ~interaction", "te", more=_TREE), lambda x: attribution.nested_effects(attribution.nested_segments(x.nested, **_NESTED)))
_metric("a7_nested_brinson", _select("case when grouping(segment) = 0 then any_value(level)::bigint end as level; case when grouping(segment) = 1 then 'Total' else segment end as segment; " + "; ".join(f"~sum({n} * menchero) as {n}" for n in _NAMES) + "; ~sum((allocation + selection + interaction) * menchero) as total", "te join lf using (date) group by rollup (segment)", more=f"{_LINK}, {_TREE}"), lambda x: attribution.nested_brinson(x.nested, **_NESTED, method="menchero"))

# ---- risk -------------------------------------------------------------------------------------------------------------------

_MODEL = {"factors": list(FACTORS), "benchmark_weight": "bench_weight"}
_COV = "cov as (select * from (values " + ", ".join(f"('{a}', '{b}', {v}::double)" for a, b, v in [*COVARIANCE, *((b, a, v) for a, b, v in COVARIANCE if a != b)]) + ") as c(f1, f2, cov))"
_EXP = "ex as (" + " union all ".join(f"select date, '{f}' as factor, coalesce(sum((weight - bench_weight) * {f}), 0) as x from panel group by date" for f in FACTORS) + f"), {_COV}, sp as (select date, sum(pow(weight - bench_weight, 2) * pow(specific_risk, 2)) as s2 from panel group by date), fx as (select e.date, f1 as factor, sum(cov * x) as fx from ex e join cov on f2 = e.factor group by 1, 2), rk as (select date, factor, x, fx, s2, sqrt(sum(x * fx) over (partition by date) + s2) as sigma from ex join fx using (date, factor) join sp using (date))"
_metric("r1_factor_exposures", _select("@date; factor; ~x as exposure", "ex", more=_EXP), lambda x: risk.factor_exposures(x.panel, **_MODEL))
_metric("r2_risk_decomposition", _select("@date; ~any_value(sigma) as total_risk; ~sqrt(sum(x * fx)) as factor_risk; ~sqrt(any_value(s2)) as specific_risk", "rk group by date", more=_EXP), lambda x: risk.risk_decomposition(x.panel, x.covariance, **_MODEL))
_metric("r3_factor_risk_contribution", _select("@date; factor; ~exposure; ~mctr; ~cctr; ~cctr / sigma as pct_of_total", "(select date, factor, x as exposure, fx / sigma as mctr, x * fx / sigma as cctr, sigma from rk union all select date, 'specific', null, null, any_value(s2) / any_value(sigma), any_value(sigma) from rk group by date)", more=_EXP), lambda x: risk.factor_risk_contribution(x.panel, x.covariance, **_MODEL))
_metric("r3_factor_risk_contribution_grouped", _select("@date; factor; cast(null as double) as exposure; cast(null as double) as mctr; ~cctr; ~cctr / sigma as pct_of_total", "(select date, case when factor in ('F1', 'F2') then 'style' else factor end as factor, sum(x * fx / sigma) as cctr, any_value(sigma) as sigma from rk group by 1, 2 union all select date, 'specific', any_value(s2) / any_value(sigma), any_value(sigma) from rk group by date)", more=_EXP), lambda x: risk.factor_risk_contribution(x.panel, x.covariance, factor_groups={"F1": "style", "F2": "style"}, **_MODEL))
_FR = "fr as (" + " union all ".join(f"select date, '{f}' as factor, avg({f} * ret) as f from panel group by date" for f in FACTORS) + ")"
_metric("r4_factor_return_attribution", _select("@date; factor; ~contribution", "(select date, factor, x * f as contribution from ex join fr using (date, factor) union all select date, 'specific', sum((weight - bench_weight) * ret) from panel group by date)", more=f"{_EXP}, {_FR}"), lambda x: risk.factor_return_attribution(x.panel, x.factor_returns, specific_return="ret", **_MODEL))
_SHOCKED = "sh as (select * from (values " + ", ".join(f"('{a}', '{b}', {v}::double)" for a, b, v in SHOCKS) + ") as s(scenario, f, shock))"
_metric("r9_scenario_returns", _select("@date; scenario; case when grouping(f) = 1 then 'total' else f end as factor; ~sum(c) as contribution", "(select date, scenario, f, x * shock as c from ex join sh on f = factor union all select date, 'value crash', 'specific', sum((weight - bench_weight) * -0.1) from panel where bid % 7 = 0 group by date) group by grouping sets ((date, scenario, f), (date, scenario))", more=f"{_EXP}, {_SHOCKED}"), lambda x: risk.scenario_returns(x.panel, x.shocks, specific_shocks=x.specific_shocks, **_MODEL))
_WINDOWED = "wd as (select * from (values " + ", ".join(f"('{a}', date '{b}', date '{c}')" for a, b, c in WINDOWS) + ") as w(scenario, s, e))"
_metric("r10_historical_shocks", _select("scenario; factor; ~product(1 + f) - 1 as shock; count(f) as n_periods", "fr join wd on date between s and e where f is not null group by scenario, factor", more=f"{_FR}, {_WINDOWED}"), lambda x: risk.historical_shocks(x.factor_returns, x.windows))
_ZS = "zs as (select date, ret, 0.01 + month(date) / 1000.0::double as p, ret / ((0.01 + month(date) / 1000.0::double) / sqrt(12)) as z from series)"
_metric("r5_bias_statistic", _select("~stddev_samp(z) as bias_statistic; count(z) as n_periods", "zs", _SERIES, _ZS), lambda x: risk.bias_statistic(x.series, x.predicted))
_metric("r6_rolling_bias_statistic", _select("@date; ~case when count(z) over w = 12 then stddev_samp(z) over w end as bias_statistic", "zs window w as (order by date rows 11 preceding)", _SERIES, _ZS), lambda x: risk.rolling_bias_statistic(x.series, x.predicted, 12))
_metric("r8_realized_vs_predicted", _select("@date; ~p as predicted; ~case when count(ret) over w = 12 then stddev_samp(ret) over w * sqrt(12) end as realized; ~case when count(ret) over w = 12 then stddev_samp(ret) over w * sqrt(12) end / p as ratio", "zs window w as (order by date rows 11 preceding)", _SERIES, _ZS), lambda x: risk.realized_vs_predicted(x.series, x.predicted))


def _months(x: Demo) -> int:
    return x.months.count()


@query("r7_bias_confidence_interval", _select("count(*) as n; ~1 - 1.96 / sqrt(2 * count(*)) as lower; ~1 + 1.96 / sqrt(2 * count(*)) as upper", "grid"))
def _(x: Demo) -> DataFrame:
    lower, upper = scalars.bias_confidence_interval(_months(x))
    return x.months.agg(F.count(F.lit(1)).alias("n")).withColumns({"lower": F.lit(lower), "upper": F.lit(upper)})


# ---- stats ------------------------------------------------------------------------------------------------------------------

_metric("t1_t_statistic", _per_series("~(avg(ret) - 0.001) / nullif(stddev_samp(ret) / sqrt(count(ret)), 0) as t_stat"), lambda x: stats.t_statistic(x.two_series, mu=0.001, **_BOTH))
_metric("t3_newey_west_tstat", _select("series; ~t_stat_nw", "nw", _SERIES, _newey_west("two", "series", "ret")), lambda x: stats.newey_west_tstat(x.two_series, **_BOTH))
_metric("t4_bootstrap_distribution", None, lambda x: stats.bootstrap_distribution(x.series, statistic="sharpe_ratio"))
_metric("t5_bootstrap_ci", None, lambda x: stats.bootstrap_ci(x.series))
_metric("t6_bootstrap_pvalue", None, lambda x: stats.bootstrap_pvalue(x.series))
# one block as long as the series leaves one way to draw, which SQL can say
_ONE_BLOCK = {"block_length": 1_000_000, "n_boot": 1_200}
_metric("t4_bootstrap_distribution_one_block", _select("i as boot_id; ~sr as value", "(select avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as sr from series), range(1200) as r(i)", _SERIES), lambda x: stats.bootstrap_distribution(x.series, statistic="sharpe_ratio", **_ONE_BLOCK))
_metric("t5_bootstrap_ci_one_block", _select("~avg(ret) as lower; ~avg(ret) as upper", "series", _SERIES), lambda x: stats.bootstrap_ci(x.series, **_ONE_BLOCK))
_metric("t6_bootstrap_pvalue_one_block", _select("~case when avg(ret) = 1 then 1.0 else 0.0 end as p_value", "series", _SERIES), lambda x: stats.bootstrap_pvalue(x.series, null_value=1.0, **_ONE_BLOCK))
_COUNTED = f"""sr as (select series, date, ret, row_number() over (partition by series order by date) - 1 as pos, count(*) over (partition by series) as n from two where ret is not null),
 sn as (select series, any_value(n) as n, round_even(pow(any_value(n), 1.0 / 3), 0)::bigint as w from sr group by series),
 bl as (select series, n, w, boot_id, unnest(range(0, ceil(n / w::double)::bigint)) as block from sn, (select unnest(range(0, {{n}})) as boot_id)),
 bs as (select series, n, w, boot_id, block, ('0x' || substr(md5('{{seed}}:' || boot_id || ':' || block), 1, 15))::bigint % (n - w + 1) as start, least(w, n - block * w) as length from bl),
 bv as (select bs.series, boot_id, ret from bs join sr on sr.series = bs.series and pos >= start and pos < start + length),
 bd as (select series, boot_id, avg(ret) as mean, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as sharpe from bv group by 1, 2)"""
_COUNTER = {"stream": "counter", "by": "series"}
_metric("t4_bootstrap_starts", _select("series; boot_id; block; start; length", "bs", _SERIES, _COUNTED.format(n=200, seed=11)), lambda x: stats.bootstrap_starts(x.two_series, n_boot=200, seed=11, by="series"))
_metric("t4_bootstrap_distribution_counter", _select("series; boot_id; ~sharpe as value", "bd", _SERIES, _COUNTED.format(n=2000, seed=1)), lambda x: stats.bootstrap_distribution(x.two_series, statistic="sharpe_ratio", n_boot=2000, seed=1, **_COUNTER))
_metric("t5_bootstrap_ci_counter", _select("series; ~quantile_cont(mean, 0.025) as lower; ~quantile_cont(mean, 0.975) as upper", "bd group by series", _SERIES, _COUNTED.format(n=10_000, seed=0)), lambda x: stats.bootstrap_ci(x.two_series, **_COUNTER))
_metric("t6_bootstrap_pvalue_counter", _select("series; ~least(1, 2 * case when median(mean) > -0.0002 then count_if(mean <= -0.0002) else count_if(mean >= -0.0002) end / count(*)::double) as p_value", "bd group by series", _SERIES, _COUNTED.format(n=10_000, seed=0)), lambda x: stats.bootstrap_pvalue(x.two_series, null_value=-0.0002, **_COUNTER))
_MONOTONE = f"""{_QR}, qf as (select * from qr where date in (select date from qr group by date having count(*) = (select count(distinct quantile) from qr))),
 two as (select a.date, a.quantile as series, b.ret - a.ret as ret from qf a join qf b on b.date = a.date and b.quantile = a.quantile + 1)"""
_metric("t14_monotonic_relation", _select("any_value(n) as n_periods; any_value(k) + 1 as n_labels; ~any_value(j) as statistic; ~avg((least > j)::int) as p_value", "(select boot_id, min(d.mean - m.mean) as least from bd d join me m using (series) group by boot_id), (select min(mean) as j, count(*) as k from me), (select any_value(n) as n from sn)", more=f"{_MONOTONE}, {_COUNTED.format(n=1000, seed=0)}, me as (select series, avg(ret) as mean from two group by series)"), lambda x: stats.monotonic_relation(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS)))
_PARTS = f"pa as (select ntile(4) over (order by date) as split, date, ret from series), ps as (select split, min(date) as lo, max(date) as hi, count(*) as n, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12) as s, {_T.format('ret')} as t from pa group by split)"
_metric("t7_subsample", _select('split; @lo as start; @hi as "end"; n as n_periods; ~s as sharpe_ratio; ~t as t_stat', "ps", _SERIES, _PARTS), lambda x: stats.subsample(x.series, n_splits=4, statistic="sharpe_ratio"))
_metric("t8_stability", _select("~count_if(sign(s) = sign(o)) / count(s)::double as sign_agreement; ~count_if(s > 0) / count(s)::double as positive_ratio; ~stddev_samp(s) / nullif(abs(avg(s)), 0) as dispersion; ~min(s) as min; ~max(s) as max", "ps, (select avg(ret) / nullif(stddev_samp(ret), 0) as o from series)", _SERIES, _PARTS), lambda x: stats.stability(x.series, statistic="sharpe_ratio"))
_VOL = f"vo as (select date, case when count(bench) over w = 12 then stddev_samp(bench) over w end as v from series window w as (order by date rows 11 preceding)), rg as (select date, case when v is not null then (['low', 'mid', 'high'])[least(greatest(ceil({_rank('v', '1')} / count(v) over () * 3), 1), 3)::int] end as regime from vo)"
_metric("t9_make_regimes", _select("@date; regime", "rg", _SERIES, _VOL), lambda x: stats.make_regimes(x.benchmark, method="volatility", n_quantiles=3))
_metric("t10_regime_summary", _select(f"regime; count(*) as n_periods; ~{_CAGR.format('ret')} as annualized_return; ~{_T.format('ret')} as t_stat; ~count(*) / sum(count(*)) over ()::double as share", "series join rg using (date) where regime is not null group by regime", _SERIES, _VOL), lambda x: stats.regime_summary(x.series, stats.make_regimes(x.benchmark, method="volatility", n_quantiles=3), statistic="annualized_return"))
_PHI = "(0.5 + sign({0}) * exp(-({0}) * ({0}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs({0}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))))"
_MID = _PHI.format("((lo + hi) / 2)")


def _expected_max(n: int, variance: str) -> str:
    """CTEs ending in em (e): normal quantiles by bisection."""
    return f"""bi(p, lo, hi, i) as (select p, 0.0::double, 10.0::double, 0 from (values (1 - 1.0::double / {n}), (1 - 1 / ({n} * exp(1.0::double)))) as t(p)
 union all select p, case when {_MID} < p then (lo + hi) / 2 else lo end, case when {_MID} < p then hi else (lo + hi) / 2 end, i + 1 from bi where i < 60),
em as (select sqrt({variance}) * ((1 - 0.5772156649015329::double) * min((lo + hi) / 2) + 0.5772156649015329::double * max((lo + hi) / 2)) as e from bi where i = 60)"""


def _psr(limit: str, name: str, more: str = "", source: str = "zs") -> str:
    sums = f"ms as (select series, avg(ret) / nullif(stddev_samp(ret), 0) as sr, skewness(ret) as g3, kurtosis(ret) as g4, count(ret)::double as n from two group by series)"
    zs = f"zs as (select series, case when n >= 3 and 1 - g3 * sr + (g4 + 2) / 4 * sr * sr > 0 then (sr - ({limit}) / sqrt(12)) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 + 2) / 4 * sr * sr) end as z from ms)"
    body = f"series, round(case when z <= -9 then 0.0 when z >= 9 then 1.0 when z is not null then {_PHI.format('z')} end, 9) + 0.0 as {name} from zs"
    return f"with recursive {_SERIES}, {more}{sums}, {zs} select {body}"


_metric("t11_probabilistic_sharpe_ratio", _psr("-1.0", "psr"), lambda x: stats.probabilistic_sharpe_ratio(x.two_series, benchmark_sharpe=-1.0, **_BOTH))
_TRIALS = "(select var_samp(v) from (values (-1.0::double), (-0.5), (0.1), (0.4)) as t(v))"
_metric("t13_deflated_sharpe_ratio", _psr("select e from em", "dsr", _expected_max(4, _TRIALS) + ", "), lambda x: stats.deflated_sharpe_ratio(x.two_series, trials=[-1.0, -0.5, 0.1, 0.4], **_BOTH))


@query("t12_expected_max_sharpe", f"with recursive {_PANEL}, {_expected_max('(select count(*) from grid)', '0.25')} select round(e, 9) + 0.0 as expected_max_sharpe, (select count(*) from grid) as n_trials from em")
def _(x: Demo) -> DataFrame:
    return x.months.agg(F.count(F.lit(1)).alias("n_trials")).withColumn("expected_max_sharpe", F.lit(scalars.expected_max_sharpe(_months(x), variance=0.25)))


# ---- chart data -------------------------------------------------------------------------------------------------------------

_metric("v_histogram", _select("series; b as bin; count(*) as n", "(select series, least(floor((ret - lo) / nullif(hi - lo, 0) * 20), 19)::bigint as b from two, (select min(ret) lo, max(ret) hi from two)) group by 1, 2", _SERIES), lambda x: chart_data.histogram(x.two_series, value="ret", bins=20, by="series").select("series", "bin", "n"))
_metric("v_ic_heatmap", _select("cast(year(date) as bigint) as year; cast(month(date) as bigint) as month; ~avg(ic) as ic", "ic where ic is not null group by year(date), month(date)", more=_IC), lambda x: chart_data.calendar_heatmap(quantile.information_coefficient(x.panel, **_QUANTILE_RETURNS), value="ic"))
_metric("v_quantile_cumulative", _select(f"@date; quantile; ~{_WEALTH.format('ret', 'quantile')} - 1 as cumulative_return", "qr", more=_QR), lambda x: chart_data.quantile_cumulative(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS)))
_metric("v_cumulative_effects", _select("@date; " + "; ".join(f"~sum(sum({n})) over (order by date) as {n}" for n in _NAMES), "eff group by date", more=_EFF), lambda x: chart_data.cumulative_effects(attribution.brinson(x.panel, **_SEGMENTS)))
_metric("v_factor_contribution", _select("@date; factor; ~sum(x * f) over (partition by factor order by date) as contribution", "ex join fr using (date, factor)", more=f"{_EXP}, {_FR}"), lambda x: chart_data.cumulative_contribution(risk.factor_return_attribution(x.panel, x.factor_returns, **_MODEL)))
_SUMMED = "sm as (select segment, " + ", ".join(f"sum({n} * carino) as {n}" for n in _NAMES) + f" from eff join lf using (date) group by segment)"
_BARS = " union all ".join(f"select '{n}' as effect, {' + '.join(['0.0', *(f's_{m}' for m in _NAMES[:i])])} as lo, {' + '.join(f's_{m}' for m in _NAMES[: i + 1])} as hi from tl" for i, n in enumerate(_NAMES))
_metric("v_waterfall", _select("effect; ~lo as start; ~hi as end_", f"({_BARS} union all select 'total', 0.0, {' + '.join(f's_{m}' for m in _NAMES)} from tl)", more=f"{_LINK}, {_SUMMED}, tl as (select {', '.join(f'sum({n}) as s_{n}' for n in _NAMES)} from sm)"), lambda x: chart_data.waterfall(attribution.brinson_summary(x.panel, **_SEGMENTS)).withColumnRenamed("end", "end_"))
_metric("v_effect_bars", _select("segment; " + "; ".join(f"~{n}" for n in _NAMES) + "; ~allocation + selection + interaction as total", "sm", more=f"{_LINK}, {_SUMMED}"), lambda x: chart_data.effect_bars(attribution.brinson_summary(x.panel, **_SEGMENTS)))
_metric("v_effect_heatmap", _select("@date; segment; ~selection as value", "eff", more=_EFF), lambda x: chart_data.effect_heatmap(attribution.brinson(x.panel, **_SEGMENTS), effect="selection"))
_CONTRIBUTIONS = "ct as (select date, factor, x as exposure, fx / sigma as mctr, x * fx / sigma as cctr, sigma from rk union all select date, 'specific', null, null, any_value(s2) / any_value(sigma), any_value(sigma) from rk group by date)"
_metric("v_largest_contributions", _select("@date; factor; ~exposure; ~mctr; ~cctr; ~cctr / sigma as pct_of_total", "(select *, row_number() over (order by abs(cctr) desc, factor) as a from ct where date = (select max(date) from ct)) where a <= 3", more=f"{_EXP}, {_CONTRIBUTIONS}"), lambda x: chart_data.largest_contributions(risk.factor_risk_contribution(x.panel, x.covariance, **_MODEL), n=3))
_metric("v_exposure_bars", _select("term; ~any_value(m) as mean; ~any_value(t_stat_nw) as t_stat_nw; abs(any_value(t_stat_nw)) >= 2 as significant", "(select term, avg(coef) over (partition by term) as m from e) join nw using (term) group by term", more=f"{_ONE}, e as (select 'size' as term, date, coef from o), {_newey_west('e', 'term', 'coef')}"), lambda x: chart_data.exposure_bars(signals.exposure_summary(signals.factor_exposure(x.panel, factor="factor", factors=["size"]))))
_metric("v_cumulative_spread", _select("@date; ~product(1 + coalesce(ret, 0)) over (order by date rows unbounded preceding) - 1 as cumulative_return", "ls", more=f"{_QR}, ls as (select date, max(case when quantile = 5 then ret end) - max(case when quantile = 1 then ret end) as ret from qr group by date)"), lambda x: chart_data.cumulative_spread(quantile.long_short_returns(quantile.quantile_returns(x.panel, **_QUANTILE_RETURNS))))
_metric("v_rolling_mean", _select("@date; ~ret; ~case when count(ret) over w = 12 then avg(ret) over w end as rolling_mean", "series window w as (order by date rows 11 preceding)", _SERIES), lambda x: chart_data.rolling_mean(x.series, value="ret"))
_metric("v_with_benchmark", _select("@date; ~ret; ~bench as benchmark", "series", _SERIES), lambda x: chart_data.with_benchmark(x.series, x.benchmark))
_metric("v_annual_returns", _select("cast(year(date) as bigint) as year; ~product(1 + ret) - 1 as ret; ~product(1 + bench) - 1 as benchmark", "series group by year(date)", _SERIES), lambda x: chart_data.annual_returns(x.series, x.benchmark))
_metric("v_rolling", _select("@date; ~case when count(*) over w = 12 then covar_samp(ret, bench) over w / var_samp(bench) over w end as value", _ROLL1, _SERIES), lambda x: chart_data.rolling(x.series, "beta", 12, x.benchmark))
_metric("v_distribution_marks", _select("~avg(ret) as mean; ~quantile_cont(ret, 0.05) as value_at_risk", "series", _SERIES), lambda x: chart_data.distribution_marks(x.series))
_metric("v_with_mean_line", _select("@date; ~ret; ~avg(ret) over () as mean", "series", _SERIES), lambda x: chart_data.with_mean_line(x.series.select("date", "ret"), value="ret"))
_metric("v_is_stackable", _select("min(a) >= 0 as stackable", "(select sum(weight) as a from panel group by date, sector)"), lambda x: chart_data.is_stackable(holdings.allocation(x.panel, by="sector")))

# ---- names, checks and scalars ------------------------------------------------------------------------------------------------


@query("c1_set_columns", _select("@date as day; sector; ~sum(weight) as allocation", "panel group by date, sector"))
def _(x: Demo) -> DataFrame:
    renamed = x.panel.withColumnsRenamed({"date": "day", "bid": "asset"})
    try:
        config.set_columns(date="day", id="asset")
        return holdings.allocation(renamed, by="sector")
    finally:
        config.set_columns(date="date", id="bid")


@query("c2_resolve_columns", _select("d as date_col; i as id_col; n", "(select 'date' as d, 'bid' as i, count(distinct date) as n from panel union all select 'day', 'bid', count(distinct date) from panel union all select 'date', 'asset', count(distinct date) from panel)"))
def _(x: Demo) -> DataFrame:
    named = [config.resolve_columns(), config.resolve_columns("day"), config.resolve_columns(id_col="asset")]
    counts = [x.panel.withColumnsRenamed({"date": d, "bid": i}).agg(F.count_distinct(d).alias("n")).select(F.lit(d).alias("date_col"), F.lit(i).alias("id_col"), "n") for d, i in named]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def _raised(check: Callable[[], object]) -> str | None:
    try:
        check()
    except config.ValidationError as error:
        return str(error)
    return None


@query("c5_require_columns", _select("c as columns; r as raised; n", "(select 'date,bid' as c, false as r, count(*) as n from panel union all select 'date,nope', true, 0)"))
def _(x: Demo) -> DataFrame:
    def rows(names: str) -> DataFrame:
        missing = _raised(lambda: config.require_columns(x.panel, names.split(","))) is not None
        return x.panel.where(F.lit(not missing)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(names).alias("columns"), F.lit(missing).alias("raised"), "n")

    return rows("date,bid").unionAll(rows("date,nope"))


@query("c6_check_duplicates_raises", "select sum(n)::bigint as n_rows from (select count(*) as n from lineitem group by l_orderkey) where n > 1")
def _(x: Demo) -> DataFrame:
    said = _raised(lambda: panels.check_duplicates(x.table("lineitem").select("l_orderkey"), ["l_orderkey"]))
    return x.spark.createDataFrame([(int(said.split(" ", 1)[0]) if said else None,)], "n_rows long")


@query("c8_resolve_periods_per_year", f"with o as (select cast(o_orderdate as date) as date from orders) select 'given' as name, 4.0::double as periods_per_year union all select 'inferred', cast({_P.format('o')} as double)")
def _(x: Demo) -> DataFrame:
    days = x.table("orders").select(F.to_date("o_orderdate").alias("date"))
    return panels.resolve_periods_per_year(days, 4.0).select(F.lit("given").alias("name"), "periods_per_year").unionAll(panels.resolve_periods_per_year(days).select(F.lit("inferred"), "periods_per_year"))


@query("c9_volatility_scale", f"with o as (select cast(o_orderdate as date) as date from orders), l as (select last_day(cast(l_shipdate as date)) as date from lineitem), p as (select 'orders' as name, cast({_P.format('o')} as double) as p union all select 'lineitem', cast({_P.format('l')} as double)) select name, p as periods_per_year, round(sqrt(p), 9) + 0.0 as scale from p")
def _(x: Demo) -> DataFrame:
    found = panels.infer_periods_per_year(x.table("orders").select(F.to_date("o_orderdate").alias("date"))).select(F.lit("orders").alias("name"), "periods_per_year")
    found = found.unionAll(panels.infer_periods_per_year(x.months).select(F.lit("lineitem"), "periods_per_year"))
    known = F.create_map(*(F.lit(v) for p in sorted({p for _, p in panels.FREQUENCIES}) for v in (p, scalars.volatility_scale(p))))
    return found.withColumn("scale", known[F.col("periods_per_year")])


@query("q15_quantile_labels", _select("quantile as at; case when quantile = 0 then 'NA' else 'Q' || quantile end as label; count(*) as n", f"(select date, q as quantile from (select *, {_quantile('factor', missing=True)} from panel) where q is not null) group by quantile"))
def _(x: Demo) -> DataFrame:
    names = quantile.quantile_labels(5, include_missing=True)
    label = F.element_at(F.array(*(F.lit(n) for n in names)), F.when(F.col("quantile") == 0, len(names)).otherwise(F.col("quantile")))
    assigned = quantile.assign_quantiles(x.panel, factor="factor", missing_class=True).where("quantile is not null")
    return assigned.groupBy("quantile").agg(F.count(F.lit(1)).alias("n")).select(F.col("quantile").alias("at"), label.alias("label"), "n")


@query("t2_newey_west_lags", _select("count(*) as n; floor(4 * pow(count(*) / 100.0, 2.0 / 9))::bigint as lags", "grid"))
def _(x: Demo) -> DataFrame:
    return x.months.agg(F.count(F.lit(1)).alias("n")).withColumn("lags", F.lit(scalars.newey_west_lags(_months(x))).cast("bigint"))
