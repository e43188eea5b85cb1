"""A (month, supplier) panel, return series and risk-model tables derived from the order tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.sources import lineage
from tidemark.sources.panel import date_grid
from tidemark.streaming import calendar

#: Shocks to factors, and historical windows, of the demonstration's scenarios; fixed values.
SHOCKS = (("value crash", "F1", -0.2), ("value crash", "F2", 0.05), ("size rally", "F2", 0.1), ("size rally", "F3", -0.02))
WINDOWS = (("1994", "1994-01-01", "1994-12-31"), ("turn", "1995-06-30", "1996-02-10"), ("before", "1980-01-01", "1980-12-31"))
#: Factors of the demonstration's risk model, their covariances (one half) and yearly-constant specific risk; fixed values.
FACTORS = ("F1", "F2", "F3")
COVARIANCE = (("F1", "F1", 0.04), ("F1", "F2", 0.01), ("F1", "F3", -0.005), ("F2", "F2", 0.09), ("F2", "F3", 0.002), ("F3", "F3", 0.0225))
SPECIFIC_RISK = 0.25


class Demo:
    """Lazy tables over the Parquet files of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def monthly(self) -> DataFrame:
        """Integer sums by month and supplier: exact in any order of addition."""
        whole = lambda c, by=1: F.sum(F.round(F.col(c) * by).cast("bigint"))
        rows = self.table("lineitem").select(F.last_day(F.to_date("l_shipdate")).alias("date"), F.col("l_suppkey").alias("bid"), "l_quantity", "l_tax", "l_discount", "l_extendedprice")
        return rows.groupBy("date", "bid").agg(whole("l_quantity").alias("qty"), whole("l_tax", 100).alias("tax"), whole("l_discount", 100).alias("disc"), whole("l_extendedprice", 100).alias("cents"), F.count("*").alias("n"))

    @cached_property
    def sectors(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"))
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("bid"), "sector")

    @cached_property
    def countries(self) -> DataFrame:
        """(bid, country): the level within a sector."""
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("country"))
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("bid"), "country")

    @cached_property
    def lines(self) -> DataFrame:
        """(date, order, line, price, quantity, part): a year's order lines as a cross-section with thousands of classes."""
        year = F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1))
        price = F.round(F.col("l_extendedprice") * 100) / 100000
        return self.table("lineitem").select(year.alias("date"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), price.alias("price"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_partkey").cast("string").alias("part"))

    @cached_property
    def panel(self) -> DataFrame:
        """date, bid, factor (missing for every tenth id), factor2, ret, fwd_ret, fwd_ret_2, weight, bench_weight, sector, size, F1-F3, specific_risk."""
        day = Window.partitionBy("date")
        z = lambda c: ratio(F.col(c) - F.avg(c).over(day), F.stddev_samp(c).over(day))
        base = self.monthly.join(self.sectors, "bid").withColumns({
            "factor": F.when(F.col("bid") % 10 != 0, F.col("qty").cast("double")),
            "factor2": F.col("tax").cast("double") / F.col("n"),
            "ret": (F.col("disc").cast("double") / F.col("n") - 5) / 100,
            "weight": F.col("cents").cast("double") / F.sum("cents").over(day),
            "bench_weight": 1.0 / F.count("*").over(day),
            "size": F.log(F.col("cents").cast("double") / 100),
            "lines": F.col("n").cast("double"),
        }).withColumns({"F1": z("factor2"), "F2": z("size"), "F3": z("lines"), "specific_risk": F.lit(SPECIFIC_RISK)})
        dated = base.join(F.broadcast(date_grid(self.months)), "date")  # one row a month
        ahead = Window.partitionBy("bid").orderBy("t")
        at = lambda k: F.lead("t", k).over(ahead)
        ret = lambda k: F.lead("ret", k).over(ahead)
        later = {"fwd_ret": F.when(at(1) == F.col("t") + 1, ret(1)), "fwd_ret_2": F.when(at(1) == F.col("t") + 2, ret(1)).when(at(2) == F.col("t") + 2, ret(2))}
        return dated.withColumns(later).select("date", "bid", "factor", "factor2", "ret", "fwd_ret", "fwd_ret_2", "weight", "bench_weight", "sector", "size", *FACTORS, "specific_risk")

    @cached_property
    def nested(self) -> DataFrame:
        """The panel with ``country`` within ``sector``."""
        return self.panel.join(self.countries, "bid")

    @cached_property
    def traded(self) -> DataFrame:
        """The panel's dates and ids; weights under half a percent, and every tenth id's, are sold."""
        return self.panel.select("date", "bid", F.when((F.col("weight") > 0.5 / 100) & (F.col("bid") % 10 != 0), F.col("weight")).alias("weight"))

    @cached_property
    def shocks(self) -> DataFrame:
        return self.spark.createDataFrame(SHOCKS, "scenario string, factor string, shock double")

    @cached_property
    def specific_shocks(self) -> DataFrame:
        """Every seventh supplier loses a tenth."""
        return self.table("supplier").where("s_suppkey % 7 = 0").select(F.lit("value crash").alias("scenario"), F.col("s_suppkey").alias("bid"), F.lit(-0.1).alias("shock"))

    @cached_property
    def windows(self) -> DataFrame:
        return self.spark.createDataFrame(WINDOWS, "scenario string, start string, end string")

    @cached_property
    def series(self) -> DataFrame:
        """(date, ret, bench): the portfolio's and the benchmark's monthly returns."""
        return self.panel.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.sum(F.col("bench_weight") * F.col("ret")).alias("bench"))

    @cached_property
    def two_series(self) -> DataFrame:
        """(date, series, ret), long."""
        return self.series.select("date", F.inline(F.array(F.struct(F.lit("portfolio").alias("series"), F.col("ret")), F.struct(F.lit("benchmark").alias("series"), F.col("bench").alias("ret")))))

    @cached_property
    def wide(self) -> DataFrame:
        """(date, portfolio, benchmark): a column a series."""
        return self.series.select("date", F.col("ret").alias("portfolio"), F.col("bench").alias("benchmark"))

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.series.select("date", F.col("bench").alias("ret"))

    @cached_property
    def months(self) -> DataFrame:
        """The panel's dates, from one column of the source."""
        return self.table("lineitem").select(F.last_day(F.to_date("l_shipdate")).alias("date")).distinct()

    @cached_property
    def covariance(self) -> DataFrame:
        half = self.spark.createDataFrame(COVARIANCE, "factor_1 string, factor_2 string, cov double")
        return self.months.crossJoin(F.broadcast(half))  # six rows a month

    @cached_property
    def factor_returns(self) -> DataFrame:
        """(date, factor, ret): the correlation-free mean of exposure times return."""
        return self.panel.groupBy("date").agg(*(F.avg(F.col(f) * F.col("ret")).alias(f) for f in FACTORS)).unpivot(["date"], list(FACTORS), "factor", "ret")

    @cached_property
    def predicted(self) -> DataFrame:
        """(date, risk): a yearly risk forecast that moves with the month."""
        return self.months.select("date", (0.01 + F.month("date") / 1000.0).alias("risk"))

    @cached_property
    def streamed(self) -> DataFrame:
        """Monthly returns by priority of orders that arrive as a stream: what is in the file, to the end."""
        schema = self.table("orders").schema
        # a pattern, as a stream takes a path without one for a folder
        stream = self.spark.readStream.schema(schema).parquet(f"{self.folder}/orders.parque[t]")
        returns = stream.select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series"), ((F.col("o_totalprice").cast("double") - 150000) / 1e9).alias("ret"))
        folder = f"{lineage.folder(self.spark)}/stream-{uuid.uuid4().hex}"
        calendar.write_period_growth(returns, f"{folder}/out", f"{folder}/state", by="series").awaitTermination()
        return calendar.read_period_returns(self.spark, f"{folder}/out", by="series")
