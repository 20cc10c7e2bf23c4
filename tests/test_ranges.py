import os
import random

import pytest

from tempolog.sources import ranges


def reader(folder, range_bytes=7, from_start=True):
    return ranges.LogRanges({"path": str(folder), "from_start": str(from_start), "range_bytes": str(range_bytes)}).streamReader(None)


def write(folder, name, content, mode="ab", at=None):
    path = folder / f"output_log_{name}.txt"
    with open(path, mode) as f:
        f.write(content)
    if at is not None:
        os.utime(path, (at, at))
    return str(path)


def taken(r, start):
    end = r.latestOffset()
    return [row for part in r.partitions(start, end) for row in r.read(part)], end


@pytest.mark.parametrize("seed", range(25))
def test_lines_are_read_once_wherever_ranges_and_batches_are_cut(tmp_path, seed):
    draw = random.Random(seed)
    content = b"".join(bytes(draw.choice([b"", b"a", b"b" * 30, "ü漢".encode()])) * draw.choice([0, 1, 3]) + draw.choice([b"\n", b"\r\n"]) for _ in range(40))
    r, rows, done = reader(tmp_path, draw.choice([1, 5, 17, 1000])), [], 0
    at = r.initialOffset()
    while done < len(content):
        step = draw.choice([1, 4, 50, 300])
        write(tmp_path, "a", content[done : done + step])
        done += step
        new, at = taken(r, at)
        rows += new
    expected, byte = [], 0
    for raw in content.split(b"\n")[:-1]:
        expected.append((str(tmp_path / "output_log_a.txt"), byte + 1, byte, raw.rstrip(b"\r").decode()))
        byte += len(raw) + 1
    assert rows == expected


def test_the_driver_reads_no_line(tmp_path, monkeypatch):
    for k in range(3):
        write(tmp_path, k, b"line\n" * 100, at=100 + k)
    r = reader(tmp_path, 64)

    def refuse(*args, **kwargs):
        raise AssertionError("a file is opened")

    monkeypatch.setattr("builtins.open", refuse)
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    assert len(parts) == 24 and max(p.high - p.low for p in parts) <= 64


def test_several_files_rotation_truncation_and_last_lines(tmp_path):
    a = write(tmp_path, "a", b"a1\na2", at=100)
    r = reader(tmp_path)
    rows, at = taken(r, r.initialOffset())
    assert [x[3] for x in rows] == ["a1"]
    b = write(tmp_path, "b", b"b1\n", at=200)  # a newer file closes the older one
    rows, at = taken(r, at)
    assert [(x[0], x[3]) for x in rows] == [(a, "a2"), (b, "b1")]
    assert taken(r, at)[0] == []
    write(tmp_path, "a", b"late\n", at=150)  # written behind the end of a closed file
    write(tmp_path, "b", b"b2\n", at=200)
    rows, at = taken(r, at)
    assert [x[3] for x in rows] == ["late", "b2"]
    write(tmp_path, "b", b"new\n", mode="wb", at=300)  # shorter than before
    rows, at = taken(r, at)
    assert [x[3] for x in rows] == ["new"]
    os.remove(a)
    assert taken(r, at)[0] == []


def test_from_now_on_begins_with_the_line_under_way(tmp_path):
    write(tmp_path, "a", b"old\nhalf")
    r = reader(tmp_path, from_start=False)
    at = r.initialOffset()
    write(tmp_path, "a", b" a line\n")
    assert [x[3] for x in taken(r, at)[0]] == ["half a line"]


def test_long_lines_over_many_ranges(tmp_path):
    write(tmp_path, "a", b"x" * 200_000 + b"\nshort\n")
    r = reader(tmp_path, 1000)
    rows, _ = taken(r, {})
    assert [len(x[3]) for x in rows] == [200_000, 5]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    spark.dataSource.register(ranges.LogRanges)

    def run():
        stream = spark.readStream.format("log_ranges").option("path", str(logs)).option("from_start", "true").option("range_bytes", 8).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        query.stop()

    write(logs, "a", b"one\ntwo\nthr")
    run()
    write(logs, "a", b"ee\nfour\n")
    run()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["four", "one", "three", "two"]
