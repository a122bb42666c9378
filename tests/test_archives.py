"""ZIP archives read from files and from a table give the same lines."""

import io
import zipfile

from alertweft.sources.records import expand_archives, read_archives


def test_files_and_table(spark, tmp_path):
    for name, lines in (("a.zip", ["x", "y"]), ("b.zip", ["é"])):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("logs/one.log", "\n".join(lines) + "\n")
            archive.writestr("empty.log", "")
        (tmp_path / name).write_bytes(buffer.getvalue())
    (tmp_path / "other.txt").write_text("no archive")
    found = read_archives(spark, str(tmp_path))
    rows = sorted((r.archive.rsplit("/", 1)[-1], r.member, r.line_no, r.line) for r in found.collect())
    assert rows == [("a.zip", "logs/one.log", 1, "x"), ("a.zip", "logs/one.log", 2, "y"), ("b.zip", "logs/one.log", 1, "é")]
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    assert expand_archives(held).count() == 3
