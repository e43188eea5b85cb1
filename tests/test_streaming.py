from datetime import date

import pytest
from fixtures import frame
from pyspark.sql import functions as F

from tidemark.config import ValidationError
from tidemark.operators import performance
from tidemark.streaming import calendar

SCHEMA = "date date, name string, ret double"


class Feed:
    """A folder of files, one to a trigger, and what a query makes of it."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0

    def put(self, rows):
        self.files += 1
        frame(self.spark, SCHEMA, rows).coalesce(1).write.parquet(f"{self.folder}/in/{self.files:03d}")

    def play(self, **kwargs):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")
        query = calendar.write_period_growth(stream, f"{self.folder}/out", f"{self.folder}/state", by="name", **kwargs)
        query.awaitTermination()
        return query

    def result(self, freq="month"):
        got = calendar.read_period_returns(self.spark, f"{self.folder}/out", freq, by="name").collect()
        return {(r["date"], r["name"]): pytest.approx(r["ret"], abs=1e-14) for r in got}


def batch(spark, rows, freq="month"):
    return {(r["date"], r["name"]): r["ret"] for r in performance.aggregate_returns(frame(spark, SCHEMA, rows), freq, by="name").collect()}


@pytest.mark.parametrize("freq", ["month", "quarter"])
def test_stream_equals_batch_whatever_the_files(spark, tmp_path, freq):
    feed = Feed(spark, str(tmp_path))
    files = [
        [(date(2024, 1, 5), "a", 0.1), (date(2024, 1, 6), "a", None), (date(2024, 1, 7), "b", -0.2)],
        [(date(2024, 2, 1), "a", 0.03), (date(2024, 1, 31), "a", 0.02), (None, "a", 9.0)],  # January goes on
        [(date(2024, 5, 9), "b", 0.01)],  # an empty month or two before
        [(date(2024, 5, 30), "b", float("nan")), (date(2024, 4, 1), None, 0.5), (date(2024, 2, 28), "a", 0.04)],
    ]
    for rows in files[:2]:
        feed.put(rows)
    feed.play(freq=freq)
    assert feed.result(freq) == batch(spark, sum(files[:2], []), freq)
    for rows in files[2:]:  # a second query goes on from the first one's state
        feed.put(rows)
    feed.play(freq=freq)
    assert feed.result(freq) == batch(spark, sum(files, []), freq)


def test_late_rows_are_dropped_and_no_others(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.put([(date(2024, 1, 5), "a", 0.1), (date(2024, 3, 31), "a", 0.2)])
    feed.put([(date(2024, 2, 28), "a", 0.0), (date(2024, 1, 8), "a", 0.0)])  # the first file's watermark holds from the next one on
    feed.put([(date(2024, 2, 29), "a", 0.3), (date(2024, 1, 9), "a", 0.4)])  # it is February 20: January is closed
    feed.put([(date(2024, 2, 1), "a", 0.5)])
    query = feed.play(delay="40 days")
    assert feed.result() == {(date(2024, 1, 31), "a"): 0.1, (date(2024, 2, 29), "a"): 1.3 * 1.5 - 1, (date(2024, 3, 31), "a"): 0.2}
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_state_of_closed_periods_is_let_go(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    for m in range(1, 9):
        feed.put([(date(2024, m, 10), "a", 0.01), (date(2024, m, 11), "b", 0.02)])
    query = feed.play(delay="35 days")
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) <= 6 and len(feed.result()) == 16


def test_a_trigger_that_runs_again_counts_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.put([(date(2024, 1, 5), "a", 0.1)])
    feed.play()
    (folder,) = [p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()][-1:]
    for p in (folder, folder.with_name(f".{folder.name}.crc")):  # as if the query had ended before it said so
        p.unlink(missing_ok=True)
    feed.play()
    assert feed.result() == {(date(2024, 1, 31), "a"): 0.1}
    with pytest.raises(ValidationError):
        calendar.period_growth(frame(spark, SCHEMA, []), "week")


def test_a_table_has_the_same_growth(spark):
    rows = [(date(2024, 1, 5), "a", 0.1), (date(2024, 1, 9), "a", 0.2)]
    r = calendar.period_growth(frame(spark, SCHEMA, rows)).first()
    assert (r["period"].date(), r["growth"], r["n"]) == (date(2024, 1, 31), pytest.approx(1.32), 2)
    assert calendar.period_growth(frame(spark, SCHEMA, rows)).where(F.col("n") > 2).count() == 0
