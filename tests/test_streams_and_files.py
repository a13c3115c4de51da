"""Lines of a progress feed with state, and files that a job commits as a whole."""

import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.sources import files, sinks
from glyphmill.streaming import progress

START = datetime.datetime(2024, 5, 1)


class Feed:
    """Rows fed file by file, each a run of the stream that goes on from the checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        os.makedirs(f"{folder}/in")

    def lines(self, *rows):
        names = ("backend", "model", "at", "phase", "completed", "total", "message")
        with open(f"{self.folder}/in/{self.n:03d}.json", "w") as out:
            for backend, model, ms, phase, completed in rows:
                at = None if ms is None else (START + datetime.timedelta(milliseconds=ms)).isoformat()
                out.write(json.dumps(dict(zip(names, (backend, model, at, phase, completed, 100, "m"), strict=True))) + "\n")
        self.n += 1
        stream = self.spark.readStream.schema(progress.LINE).json(f"{self.folder}/in")
        run = progress.write_lines(progress.shown_lines(stream, idle_ms=60_000, late="10 seconds"), f"{self.folder}/out", f"{self.folder}/marks")
        assert run.awaitTermination(120)
        got = self.spark.read.parquet(f"{self.folder}/out").collect()
        return sorted((r.backend, r.model, round((r.at - START).total_seconds() * 1000), r.phase, r.completed, r.fraction) for r in got)


def test_a_feed_shows_a_line_a_second(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "feed"))
    got = feed.lines(("a", "x", 0, "resolve", 0), *[("a", "x", 200 * i, "download", i) for i in range(1, 16)], ("b", "x", 100, "download", None), ("a", "x", None, "done", 1))
    first = [("a", "x", 0, "resolve", 0, 0.0), ("a", "x", 1200, "download", 6, 0.06), ("a", "x", 2400, "download", 12, 0.12), ("b", "x", 100, "download", 0, 0.0)]
    assert got == first
    # goes on from the state: too soon, shown at once, a repeat of the feed's start, one before the last line
    got = feed.lines(("a", "x", 3300, "download", 20), ("a", "x", 3350, "done", 100), ("a", "x", 0, "resolve", 0), ("a", "x", 2000, "download", 10), ("a", "x", 3350, "done", 100))
    assert got == sorted([*first, ("a", "x", 3350, "done", 100, 1.0)])
    # starts anew, and is later than the watermark lets earlier rows in
    got = feed.lines(("a", "x", 40_000, "resolve", 0), ("a", "x", 40_100, "error", 1))
    second = sorted([*first, ("a", "x", 3350, "done", 100, 1.0), ("a", "x", 40_000, "resolve", 0, 0.0), ("a", "x", 40_100, "error", 1, 0.01)])
    assert got == second
    got = feed.lines(("c", "x", 5_000, "resolve", 0))
    assert got == second
    # b fell silent; a had ended; c was too late to count
    got = feed.lines(("d", "x", 200_000, "resolve", 0))
    assert got == sorted([*second, ("b", "x", 60_100, "stalled", 0, 0.0), ("d", "x", 200_000, "resolve", 0, 0.0)])


def listing(top):
    return sorted(os.path.relpath(os.path.join(at, f), top) for at, _, names in os.walk(top) for f in names if not f.endswith(".crc"))


def test_icons_are_saved_as_files(spark, tmp_path):
    top = str(tmp_path / "out")
    png = sinks.png_bytes(np.full((3, 4, 4), 200, np.uint8))
    icons = spark.createDataFrame([("/s/a.png", f"icon_{i:03d}", png if i else None, f"<svg>{i}é</svg>" if i != 2 else None) for i in range(40)], "sheet_id string, stem string, png binary, svg string")
    rows = files.picture_files(icons, ["png", "tiff"]).unionByName(files.text_files(icons, F.col("svg"), "svg"))
    files.save(rows.repartition(7), top)
    names = listing(top)
    assert len(names) == 39 * 3 and not any("_staged" in n for n in names) and os.listdir(top) == [names[0].split("/")[0]]
    at = f"{top}/{names[0].split('/')[0]}"
    assert open(f"{at}/svg/icon_003.svg", encoding="utf-8").read() == "<svg>3é</svg>" and open(f"{at}/png/icon_001.png", "rb").read() == png
    assert open(f"{at}/tiff/icon_001.tiff", "rb").read() == sinks.tiff_bytes(sinks.png_pixels(png))
    more = spark.createDataFrame([("x/y.json", b"{}", 1), (f"{names[0]}", b"new", 2), ("empty.svg", None, 3)], "file string, data binary, extra int")
    files.save(more, top)
    assert listing(top) == sorted([*names, "x/y.json", "empty.svg"]) and open(f"{top}/{names[0]}", "rb").read() == b"new"
    files.save(more.limit(1), top, mode="overwrite")
    assert listing(top) == ["x/y.json"]
    files.save(more.limit(0), str(tmp_path / "none"))
    assert listing(str(tmp_path / "none")) == []


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    top = str(tmp_path / "out")
    files.save(spark.createDataFrame([("kept.svg", b"1")], "file string, data binary"), top)
    bad = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("data"))
    with pytest.raises(Exception, match="lost"):
        files.save(bad, top)
    assert listing(top) == ["kept.svg"] and os.listdir(top) == ["kept.svg"]
    for name in ("../out.svg", "a//b", "", None):
        with pytest.raises(Exception, match="no name"):
            files.save(spark.createDataFrame([(name, b"1")], "file string, data binary"), top)
    assert os.listdir(top) == ["kept.svg"]


def test_attempts_that_are_not_committed_leave_nothing(tmp_path):
    """A task that was lost halfway and ran again, and one that ran twice: only what was committed is there, once."""
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([{"file": f, "data": d} for f, d in rows], pa.schema([("file", pa.string()), ("data", pa.binary())]))

    def lost():
        yield batch(("s/a", b"1"))
        raise OSError("executor lost")

    writer = files.FileWriter(str(tmp_path / "out"), False)
    with pytest.raises(OSError):
        writer.write(lost())
    writer.write(iter([batch(("s/a", b"1"), ("s/b", b"2"))]))  # ran twice, its twin is committed
    twin = writer.write(iter([batch(("s/a", b"1"), ("s/b", b"2"))]))
    writer.commit([twin, None, writer.write(iter([]))])
    assert listing(str(tmp_path / "out")) == ["s/a", "s/b"]
    other = files.FileWriter(str(tmp_path / "out"), False)
    other.abort([other.write(iter([batch(("s/c", b"3"))])), None])
    assert listing(str(tmp_path / "out")) == ["s/a", "s/b"]


def test_a_task_that_writes_on_after_the_abort_leaves_nothing(tmp_path):
    import threading
    import time

    import pyarrow as pa

    def slow():
        time.sleep(0.6)  # its first file comes after the job's folder went
        for i in range(8):
            yield pa.RecordBatch.from_pylist([{"file": f"s/{i}", "data": b"1"}], pa.schema([("file", pa.string()), ("data", pa.binary())]))
            time.sleep(0.2)

    def killed():
        try:
            writer.write(slow())
        except OSError:
            pass  # its folder went as it wrote

    writer = files.FileWriter(str(tmp_path / "out"), False)
    task = threading.Thread(target=killed)
    task.start()
    time.sleep(0.3)
    writer.abort([None])
    task.join()
    assert listing(str(tmp_path / "out")) == [] and os.listdir(tmp_path / "out") == []
