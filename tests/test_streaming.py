import datetime as dt

import pytest
from impactrank.streaming.ranking import distinct_lines, stream_statistics

DAY = "2024-03-01 "


class Stream:
    """Files of lines that a query takes up where it was stopped; each run is a new query on the same checkpoint."""

    def __init__(self, spark, folder, make):
        self.spark, self.folder, self.make, self.n = spark, folder, make, 0
        (folder / "in").mkdir()

    def run(self, rows):
        self.n += 1
        (self.folder / "in" / f"{self.n}.csv").write_text("".join(f"{DAY}{t}\t{line}\n" for t, line in rows))
        lines = self.spark.readStream.schema("time timestamp, value string").option("sep", "\t").csv(str(self.folder / "in"))
        query = self.make(lines).writeStream.format("parquet").option("checkpointLocation", str(self.folder / "state")).option("path", str(self.folder / "out")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        return sorted(tuple(r) for r in self.spark.read.parquet(str(self.folder / "out")).collect())


@pytest.fixture
def streamed(spark, tmp_path):
    return lambda make: Stream(spark, tmp_path, make)


def at(text):
    return dt.datetime.fromisoformat(DAY + text)


def test_statistics_outlive_restarts_and_drop_repeats_and_late_rows(streamed):
    stream = streamed(stream_statistics)
    assert stream.run([("10:00:05", "1 red kelp"), ("10:00:40", "2 sand"), ("10:00:50", "1 red kelp"), ("10:01:10", "3 a b c"), ("10:01:11", " ")]) == []
    # the same line again after a restart, and a new one in the first window, which is still open
    assert stream.run([("10:02:00", "2 sand"), ("10:00:59", "4 late but in time"), ("10:20:00", "5 x")])[0] == (at("10:00:00"), at("10:01:00"), 3, 7, 4)
    # later than the watermark: not counted any more; the window of 10:20 ends once time has passed it
    found = stream.run([("10:00:30", "6 too late"), ("10:40:00", "7 y")])
    assert found == [(at("10:00:00"), at("10:01:00"), 3, 7, 4), (at("10:01:00"), at("10:02:00"), 1, 3, 3), (at("10:20:00"), at("10:21:00"), 1, 1, 1)]


def test_lines_come_again_after_the_time_kept(streamed):
    stream = streamed(lambda lines: distinct_lines(lines, "1 minute").select("value"))
    assert stream.run([("10:00:00", "1 red"), ("10:00:10", "1 red")]) == [("1 red",)]
    assert stream.run([("10:00:20", "1 red"), ("10:30:00", "2 sand")]) == [("1 red",), ("2 sand",)]
    assert stream.run([("10:31:00", "1 red")]) == [("1 red",), ("1 red",), ("2 sand",)]
