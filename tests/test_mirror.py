import os
import random

import pytest
from pyspark.sql import Row

from tempolog.sinks import mirror


def parts(folder, archive, **options):
    source = mirror.ByteMirror({"path": str(folder), "archive": str(archive), **{k: str(v) for k, v in options.items()}})
    return source.streamReader(None), source.streamWriter(None, False)


def copied(r, w, ranges):
    return [w.write(Row("source_file", "low", "content")(*x) for x in r.read(p)) for p in ranges]


def tick(r, w, batch=0):
    ranges = r.partitions({}, r.latestOffset())
    w.commit(copied(r, w, ranges), batch)
    return ranges


def archived(archive, name):
    known = mirror.manifest(str(archive))["files"].get(name, {"bytes": 0})
    return (archive / name).read_bytes()[: known["bytes"]] if known["bytes"] else b""


@pytest.mark.parametrize("seed", range(20))
def test_archives_are_prefixes_of_their_sources_whatever_fails(tmp_path, seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(mirror, "ROW_BYTES", draw.choice([1, 3, 1000]))
    src, arc = tmp_path / "src", tmp_path / "arc"
    src.mkdir()
    content = {"a.txt": b"", "b.txt": b"", "c.txt": b""}
    for batch in range(30):
        r, w = parts(src, arc, range_bytes=draw.choice([2, 7, 100]), **({"tick_bytes": 5} if draw.random() < 0.3 else {}))
        name = draw.choice(list(content))
        content[name] += draw.randbytes(draw.choice([0, 1, 13, 60]))
        (src / name).write_bytes(content[name])
        ranges = r.partitions({}, r.latestOffset())
        done = copied(r, w, draw.sample(ranges, len(ranges)))
        fails = draw.choice(["no", "no", "before commit", "a task is missing", "commit twice", "a second writer"])
        if fails == "a task is missing":
            done = [m for m in done if draw.random() < 0.7] + [None]
        if fails == "a second writer":
            tick(*parts(src, arc, range_bytes=3), batch)
        if fails != "before commit":
            w.commit(done, batch)
        if fails == "commit twice":
            w.commit(done, batch)
        for n, whole in content.items():
            assert whole.startswith(archived(arc, n))
    for _ in range(200):
        if not tick(*parts(src, arc, tick_bytes=20)):
            break
    known = mirror.manifest(str(arc))["files"]
    for n, whole in content.items():
        if whole:
            assert (arc / n).read_bytes() == whole and known[n]["residue"] == str(int.from_bytes(whole) % mirror.PRIME)


def test_a_source_that_is_shorter_or_another_one_is_refused(spark, tmp_path, rows):
    src, arc = tmp_path / "src", tmp_path / "arc"
    src.mkdir()
    (src / "a.txt").write_bytes(b"0123456789")
    (src / "b.txt").write_bytes(b"b")
    r, w = parts(src, arc, range_bytes=4)
    tick(r, w)
    (src / "a.txt").write_bytes(b"012")
    assert tick(r, w) == [] and archived(arc, "a.txt") == b"0123456789"
    assert [(x[0], x[1], x[2], x[4], x[5]) for x in rows(mirror.state(spark, str(src), str(arc)))] == [("a.txt", 3, 10, False, True), ("b.txt", 1, 1, True, False)]
    (src / "a.txt").write_bytes(b"another file that is longer")
    (src / "b.txt").write_bytes(b"bb")
    tick(r, w)
    assert archived(arc, "a.txt") == b"0123456789" and archived(arc, "b.txt") == b"bb" and mirror.manifest(str(arc))["refused"] == ["a.txt"]
    (src / "a.txt").write_bytes(b"0123456789ab")  # the file is back
    tick(r, w)
    assert archived(arc, "a.txt") == b"0123456789ab" and mirror.manifest(str(arc))["refused"] == []


def test_planning_and_committing_open_no_source(tmp_path, monkeypatch):
    src, arc = tmp_path / "src", tmp_path / "arc"
    src.mkdir()
    (src / "a.txt").write_bytes(b"x" * 100)
    r, w = parts(src, arc, range_bytes=10)
    opened = mirror._rows

    def refuse(*args):
        raise AssertionError("bytes are read")

    monkeypatch.setattr(mirror, "_rows", refuse)
    ranges = r.partitions({}, r.latestOffset())
    assert len(ranges) == 10
    monkeypatch.setattr(mirror, "_rows", opened)
    done = copied(r, w, ranges)
    monkeypatch.setattr(mirror, "_rows", refuse)
    w.commit(done, 0)
    assert archived(arc, "a.txt") == b"x" * 100


def test_a_stream_mirrors_restarts_and_rotates(spark, tmp_path):
    src, arc = tmp_path / "src", tmp_path / "arc"
    src.mkdir()

    def run():
        query = mirror.mirror(spark, str(src), str(arc), str(tmp_path / "ck"), range_bytes=1000).start()
        query.processAllAvailable()
        query.stop()

    whole = {"a.txt": os.urandom(5500), "b.txt": os.urandom(10)}
    (src / "a.txt").write_bytes(whole["a.txt"][:2500])
    run()
    (src / "a.txt").write_bytes(whole["a.txt"])
    (src / "b.txt").write_bytes(whole["b.txt"])
    run()
    run()
    for name, content in whole.items():
        assert (arc / name).read_bytes() == content
    assert mirror.pieces(spark, str(arc)).count() >= 7 and mirror.damaged(spark, str(arc)).count() == mirror.damaged(spark, str(arc), str(src)).count() == 0
    with open(arc / "a.txt", "r+b") as f:
        f.seek(2600)
        f.write(bytes([whole["a.txt"][2600] ^ 1]))
    assert [(r["source_file"], r["low"]) for r in mirror.damaged(spark, str(arc)).collect()] == [("a.txt", 2500)]
