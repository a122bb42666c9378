"""Lines, records and hashes by byte range against plain file reading, with borders everywhere."""

import csv
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from alertweft.operators.integrity import manifest
from alertweft.operators.provenance import verify_records
from alertweft.sources import byte_ranges as B
from alertweft.sources.windows import read_blocks


def sha(data):
    return hashlib.sha256(data).hexdigest()


def local(name):
    return str(name).removeprefix("file:")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines(spark, tmp_path, size):
    rng = random.Random(2)
    files = {"empty.txt": b"", "end.txt": b"a\r\n\n\xff\xc3\xa9\nlast", "one.txt": b"x" * 300, "_left_out": b"q\n", "breaks.txt": b"\n" * 9,
             "long.txt": b"".join(bytes(rng.choices(b"abc ", k=rng.choice([0, 1, 5, 90]))) + b"\n" for _ in range(40))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = B.raw_lines(spark, str(tmp_path), size).collect()
    for name, data in files.items():
        want, at = [], 0
        for number, raw in enumerate(data.splitlines(keepends=True) if name != "end.txt" else [b"a\r\n", b"\n", b"\xff\xc3\xa9\n", b"last"], 1):
            want.append((number, at, at + len(raw), raw))
            at += len(raw)
        got = sorted((r.line_no, r.byte_start, r.byte_end, bytes(r.raw)) for r in rows if r.file.endswith("/" + name))
        assert got == ([] if name.startswith("_") else want), name


def test_no_files(spark, tmp_path):
    assert B.raw_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        B.raw_lines(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("size", [10, 1 << 20])
def test_blocks_have_their_bytes(spark, tmp_path, size):
    parts = [b"Information\tMicrosoft-Windows-Sysmon\t1\tx\r\n\r\n2025-01-01 10:00:00.5\r\nmore\n", b"Error\tother\n", "Warning\té\n\n".encode()]
    data = b"before\n" + b"".join(parts)
    (tmp_path / "a.log").write_bytes(data)
    found = sorted(read_blocks(spark, str(tmp_path), size).collect(), key=lambda r: r.block_index)
    assert [data[r.byte_start:r.byte_end] for r in found] == parts
    assert [(r.event_code, r.event_time_utc, r.first_line) for r in found] == [(1, "2025-01-01T10:00:00.5Z", 2), (0, "", 6), (0, "", 7)]
    assert found[2].raw_text == "Warning\té"


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_csv_ordinals(spark, tmp_path, size):
    text = '_id,note\n1,plain\n\n2,"two\n\nlines, ""quoted"" "\r\n3,\n"4\n","é"\n5,"last'
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode() + b'"')
    with path.open(newline="", encoding="utf-8-sig") as handle:
        want = list(csv.DictReader(handle))
    lines = B.raw_lines(spark, str(tmp_path), size)
    declared = [("csv", str(path), n, None, None, row["_id"], sha(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()))
                for n, row in enumerate(want, 2)]
    wrong = [("csv", str(path), 3, None, None, "0", "0"), ("csv", str(path), 99, None, None, "1", "0"), ("csv", None, None, None, None, None, None)]
    schema = "kind string, file string, number long, byte_start long, byte_end long, record_id string, declared_sha256 string"
    found = verify_records(spark.createDataFrame(declared + wrong, schema), lines, lines, "_id").collect()
    assert len(want) == 5
    assert sorted((r.number or 0, r.problem) for r in found) == [(0, "absent"), (3, "id mismatch"), (3, "mismatch"), (99, "absent")]


def test_lines_and_ranges_are_verified(spark, tmp_path):
    path = tmp_path / "a.log"
    data = "eins\r\nzwei é\n\nlast".encode()
    path.write_bytes(data)
    lines = B.raw_lines(spark, str(tmp_path), 4)
    row = lambda kind, number, start, end, digest, extra=0: (kind, str(path), number, start, end, "", digest, extra)
    rows = [row("line", 1, None, None, sha(b"eins")), row("line", 2, None, None, sha("zwei é".encode())), row("line", 3, None, None, sha(b"")),
            row("line", 4, None, None, sha(b"x"), 1), row("line", 5, None, None, sha(b""), 2), row("line", 2, None, None, None, 3),
            row("bytes", None, 2, 9, sha(data[2:9])), row("bytes", None, 0, len(data), sha(data)), row("bytes", None, 0, len(data) + 1, sha(data), 4),
            row("bytes", None, 3, 3, sha(b""), 5), row("bytes", None, -1, 3, sha(b""), 6), row("bytes", None, 1, 3, sha(data[1:4]), 7),
            row("bytes", None, None, None, None, 8), row("page", 1, None, None, "", 9), row(None, 1, None, None, "", 10)]
    schema = "kind string, file string, number long, byte_start long, byte_end long, record_id string, declared_sha256 string, sha256 int"
    found = verify_records(spark.createDataFrame(rows, schema), lines, lines.limit(0), "_id").collect()
    bad = "invalid byte range"
    assert sorted((r.sha256, r.problem) for r in found) == [(1, "mismatch"), (2, "absent"), (3, "mismatch"), (4, bad), (5, bad), (6, bad), (7, "mismatch"),
                                                            (8, bad), (9, "unknown locator"), (10, "unknown locator")]


def test_files_are_hashed_in_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "STEP_BYTES", 5)
    files = {"eval/a b.bin": bytes(range(256)) * 3, "eval/none.bin": b"", "tools/schema/+x.json": b"{}"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # one value may not hold the large file
    try:
        got = {r.path: (r.bytes, r.sha256, r.category) for r in manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: (len(data), sha(data), "spec" if name.startswith("tools") else "harness") for name, data in files.items()}
    missing = spark.createDataFrame([(str(tmp_path / "gone"), 0, None), (None, 0, 1)], "file string, byte_start long, byte_end long")
    assert [(r.file_bytes, r.sha256) for r in B.range_hashes(missing).collect()] == [(None, None)] * 2


def test_small_ranges_share_a_task(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"".join(b"x" * (i % 90) + b"\n" for i in range(2000)) + b"y" * 700 + b"\nend")
    (tmp_path / "b.txt").write_bytes(b"one\ntwo\n")
    reader = B.RawLinesReader(str(tmp_path), 64)
    tasks = reader.partitions()
    assert len(tasks) == 1 and len(tasks[0].ranges) > 1000
    together = [r for batch in reader.read(tasks[0]) for r in batch.to_pylist()]
    alone = [r for one in tasks[0].ranges for batch in reader.read(B.Ranges([one])) for r in batch.to_pylist()]
    assert together == alone and len(alone) == 2004
    assert b"".join(r["raw"] for r in alone if r["file"].endswith("a.txt")) == (tmp_path / "a.txt").read_bytes()
    big = [B.Range("f", "f", i << 23, (i + 1) << 23) for i in range(3)]
    assert [len(t.ranges) for t in B._dealt(big)] == [1, 1, 1]
