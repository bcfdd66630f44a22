"""Following log files that grow and are rotated."""

import json
import os
import random

import pytest

from faktorium.sources.followed import LogFolder, LogReader
from faktorium.sources.logs import stream_event_log
from faktorium.streaming import jobs


def record(n):
    return json.dumps({"timestamp": f"2025-03-01T10:00:{n % 60:02d}", "level": "INFO", "message": f"record {n}", "number": n}) + "\n"


class Follower:
    """Runs of the same stream over a folder, all from one checkpoint."""

    def __init__(self, spark, tmp_path, pattern="app.log*"):
        self.spark, self.folder, self.pattern = spark, tmp_path / "logs", pattern
        self.out, self.checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
        self.folder.mkdir()

    def append(self, name, numbers):
        with (self.folder / name).open("a") as sink:
            sink.writelines(map(record, numbers))

    def numbers(self):
        stream = stream_event_log(self.spark, str(self.folder), pattern=self.pattern)
        found = jobs.run_available(stream, "followed", path=self.out, checkpoint=self.checkpoint)
        return sorted(int(r["extra"]["number"]) for r in found.collect())


def test_appended_and_rotated_records_come_once(spark, tmp_path):
    log = Follower(spark, tmp_path)
    log.append("app.log", range(10))
    log.append("other.log", range(900, 905))
    assert log.numbers() == list(range(10))
    log.append("app.log", range(10, 15))
    assert log.numbers() == list(range(15))
    # Lines that come between the last run and the rotation, then a second rotation.
    log.append("app.log", range(15, 17))
    os.rename(log.folder / "app.log", log.folder / "app.log.1")
    log.append("app.log", range(17, 19))
    assert log.numbers() == list(range(19))
    os.rename(log.folder / "app.log.1", log.folder / "app.log.2")
    os.rename(log.folder / "app.log", log.folder / "app.log.1")
    assert log.numbers() == list(range(19))
    # An old file is deleted; its number may be taken over by the next file.
    os.remove(log.folder / "app.log.2")
    log.append("app.log", range(19, 40))
    assert log.numbers() == list(range(40))


def test_a_line_counts_when_it_is_whole(spark, tmp_path):
    log = Follower(spark, tmp_path)
    line = record(0)
    (log.folder / "app.log").write_text(line[:20])
    reader = LogReader(str(log.folder), "app.log*", 1 << 20)
    assert reader.latestOffset() == {}
    (log.folder / "app.log").write_text(line + record(1)[:-1])
    assert log.numbers() == [0]
    with (log.folder / "app.log").open("a") as sink:
        sink.write("\n")
    assert log.numbers() == [0, 1]


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_ranges_share_the_lines(tmp_path, split):
    rng = random.Random(split)
    lines = ["é" * rng.randint(0, 30) + str(i) for i in range(200)] + ["", "", "x\r"]
    (tmp_path / "a.log").write_bytes("".join(line + "\n" for line in lines).encode())
    reader = LogReader(f"file:{tmp_path}", "*.log", split)
    end = reader.latestOffset()
    rows = [
        (place, value) for part in reader.partitions({}, end) for batch in reader.read(part)
        for value, place in zip(batch.column("value").to_pylist(), batch.column("position").to_pylist())
    ]
    assert [value for _, value in sorted(rows)] == [line.rstrip("\r") for line in lines]
    assert [place for place, _ in sorted(rows)] == sorted({place for place, _ in rows})
    assert reader.partitions(end, end) == []


def test_lost_lines_are_an_error(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("first\nsecond\n")
    reader = LogReader(str(tmp_path), "*.log", 1 << 20)
    end = reader.latestOffset()
    part = reader.partitions({}, end)[0]
    os.truncate(path, 6)
    with pytest.raises(ValueError):
        reader.latestOffset()
    with pytest.raises(ValueError):
        list(reader.read(part))
    path.unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))


def test_a_missed_file_is_not_read_again(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("first\n")
    reader = LogReader(str(tmp_path), "*.log", 1 << 20)
    end = reader.latestOffset()
    os.rename(path, tmp_path / "moving")
    assert reader.latestOffset() == end
    os.rename(tmp_path / "moving", tmp_path / "b.log")
    assert reader.latestOffset() == end


def test_same_first_lines_without_file_numbers(tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("banner\n")
    folder = LogFolder(str(tmp_path), "*.log")
    assert len(folder.snapshot()) == 2
    folder.local = False
    with pytest.raises(ValueError):
        folder.look()
