"""Codecs, redaction, pseudonyms, containment, line numbering."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from alertweft.functions import codec as C
from alertweft.functions.text import evidence_ids, occurrences, snake_case
from alertweft.functions.times import natural_key, parse_time
from alertweft.operators import aliases as A, redaction as X
from alertweft.operators.projection import scheduled_task
from alertweft.sources.lines import blocks, read_lines, read_records


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def b64(text):
    return base64.b64encode(text.encode("utf-16le")).decode()


@pytest.mark.parametrize("command, expected", [
    ("powershell -enc " + b64("Get-Process | x"), "Get-Process | x"),
    ("powershell -EncodedCommand " + b64("whoami /priv").rstrip("="), "whoami /priv"),
    ("powershell -e tooshort", ""), ("no argument", ""),
    ("p -enc " + base64.b64encode(b"abcdefghijklmno" + b"q" * 6).decode(), b"abcdefghijklmnoqqqqqq"[:20].decode("utf-16le")),
])
def test_encoded_command(spark, command, expected):
    assert one(spark, C.encoded_command(F.lit(command))) == expected


def test_quoted_concat(spark):
    assert one(spark, C.quoted_concat(F.lit("iex ( 'Wri' + 'te~x' ).REPLACE('~',[string][char]45)"))) == "Write-x"
    assert one(spark, C.quoted_concat(F.lit("iex 'x'"))) == ""
    with pytest.raises(ValueError):
        C.derive("rot13", F.lit("x"))


def test_undecodable_bytes_are_dropped(spark):
    assert one(spark, C.utf8_text(F.unhex(F.lit("61FF62")))) == "ab"
    assert one(spark, C.utf16le_text(F.unhex(F.lit("6100D8D862")))) == "a"


def test_redaction_inside_and_outside_blobs(spark):
    dirty, clean = b64("Invoke-AtomicTest T1059.001"), b64("Get-ChildItem C:\\")
    text = one(spark, X.redact(F.lit(f"T1003 atomic -enc {dirty} then -e {clean} AT0MICSTRONG")))
    assert text.startswith("[id] [x] -enc ") and text.endswith(f"-e {clean} [redacted-password]")
    assert base64.b64decode(text.split()[3]).decode("utf-16le") == "Invoke-[x]Test [id]"


def test_simultaneous_replace_is_not_sequential(spark):
    mapping = F.create_map(*[F.lit(x) for x in ("ab", "host-01", "abc", "ab", "host", "Z", "a.b", "dot")])
    assert one(spark, A.replace_simultaneous(F.lit("ABC ab host axb A.B"), mapping)) == "ab host-01 Z axb dot"


def test_host_pseudonyms(spark):
    hosts = spark.createDataFrame([("c", "WIN-HOST-MHAAG-ATTACK-9.lab.local"), ("c", "aa"), ("c", "")], "case string, host string")
    got = {r.alias: r.pseudonym for r in X.host_pseudonyms(hosts, "case", "host").collect()}
    assert got == {"win-host-mhaag-attack-9.lab.local": "host-01.corp.local", "win-host-mhaag-attack-9": "host-01", "win-host-mhaag": "host-01",
                   "lab.local": "corp.local", "lab": "corp", "aa": "host-02"}
    users = spark.createDataFrame([("c", "LAB\\Ann"), ("c", "SYSTEM"), ("c", "host-1$"), ("c", "bob$")], "case string, user string")
    found = X.case_aliases(X.host_pseudonyms(hosts, "case", "host"), X.user_pseudonyms(users, "case", "user"), "case")
    both = {r.alias: r.pseudonym for r in found.collect()}
    assert both["ann"] == "user-01" and both["bob"] == "user-02" and both["dmevals"] == "corp" and "system" not in both


def test_containment_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["aa", "b", "cc", "dd\nee", "f."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    passages = [(i, docs[i][1][s:s + n]) for i, (s, n) in enumerate([(0, 30), (1, 25), (2, 9), (0, 3), (3, 14), (1, 1), (0, 2), (4, 60)])]
    passages = [p for p in passages if p[1]]
    d = spark.createDataFrame(docs, "doc long, text string")
    p = spark.createDataFrame(passages, "item long, passage string")
    got = {(r.doc, r.item) for r in X.contained_passages(d, "doc", "text", p, "item", "passage").collect()}
    assert got == {(i, j) for i, t in docs for j, s in passages if s in t}


def test_containment_of_short_and_frequent_passages(spark, monkeypatch):
    """Pieces of all sizes, runs in every document, passages that only share some runs, repeated keys and nulls."""
    monkeypatch.setattr(X, "FREQUENT", 7)
    rng = random.Random(12)
    common = "the quick brown fox jumps over the lazy dog"
    docs = [(i, f"{rng.choice('xyz')} {common} {rng.choice(['é', '\U0001f600', 'end'])} {' '.join(rng.choice('ab') * rng.randrange(1, 20) for _ in range(12))}") for i in range(40)]
    docs += [(100, ""), (101, None), (None, common), (102, "a"), (3, "another text of the same key " + common)]
    cuts = [t[s : s + n] for _, t in docs[:12] for s, n in ((0, 1), (3, 2), (5, 5), (2, 9), (7, 17), (0, 33), (1, 60))]
    passages = [(i, p) for i, p in enumerate([*cuts, common, "brown fox jumps over the lazy", "quick brown fox jumps under", "", "zzz", "e quick brown fox jumps over t", "\U0001f600"])] + [(5, "lazy"), (6, None)]
    d = spark.createDataFrame(docs, "doc long, text string").withColumn("h", F.lit(1)).withColumn("k", F.lit(2))
    p = spark.createDataFrame(passages, "item long, passage string")
    got = sorted((r.doc, r.item) for r in X.contained_passages(d, "doc", "text", p, "item", "passage").distinct().collect())
    assert got == sorted({(i, j) for i, t in docs if i is not None and t for j, s in passages if s and s in t})
    assert X.contained_passages(d, "doc", "text", p.limit(0), "item", "passage").count() == 0
    assert X.contained_passages(d.limit(0), "doc", "text", p, "item", "passage").count() == 0


def test_line_numbers_and_blocks_across_chunks(spark, tmp_path):
    lines = [("H" if i % 7 == 3 else "x") + str(i) * (i % 5) if i % 11 else "" for i in range(500)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_lines(spark, str(tmp_path))
        assert read.select("chunk").distinct().count() > 3
        rows = read.collect()
        for name in ("a.txt", "b.txt"):
            assert [r.line for r in sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.line_no)] == lines
        found = blocks(read, F.startswith("line", F.lit("H"))).filter(F.endswith("file", F.lit("a.txt"))).collect()
        starts = [i + 1 for i, line in enumerate(lines) if line.startswith("H")]
        assert sorted(r.first_line for r in found) == starts
        again = read_records(spark, str(tmp_path), F.startswith("line", F.lit("H"))).filter(F.endswith("file", F.lit("a.txt"))).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, found))
        assert "\n".join(r.text for r in sorted(found, key=lambda r: r.block_index)) == "\n".join(lines[starts[0] - 1:])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_text_helpers(spark):
    assert one(spark, snake_case(F.lit("ParentImage-Name 2"))) == "parent_image_name_2"
    assert one(spark, occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(spark, evidence_ids(F.lit("ev-001, A0x A0 EV-0012 EV-001"))) == ["EV-001", "A0"]
    assert one(spark, evidence_ids(F.lit("ev-001 A0"), ignore_case=False)) == ["A0"]
    assert one(spark, natural_key(F.lit("a:9"))) < one(spark, natural_key(F.lit("a:10")))
    assert str(one(spark, parse_time(F.lit("07/05/2026 12:03:04 AM")))) == "2026-07-05 00:03:04"
    assert one(spark, parse_time(F.lit("later"))) is None


def test_records_over_many_chunks(spark, tmp_path):
    """Records that span chunks, chunks without a start and lines before the first one; no line is sorted or shuffled."""
    rng = random.Random(5)
    texts = {}
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = [rng.choice(["H", "x", "", "long " * 40]) if rng.random() < 0.3 else "x" * rng.randrange(30) for _ in range(400)]
        texts[name] = ["no start"] * 3 + lines + (["y"] * 300 if name == "b.txt" else [])
    texts["none.txt"] = ["z"] * 50
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    expected = []
    for name, lines in texts.items():
        starts = [i for i, line in enumerate(lines) if line.startswith("H")]
        expected += [(name, n, a + 1, "\n".join(lines[a:b])) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)]), 1)]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size, batch in ((900, 10000), (4000, 7)):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], batch)
            found = read_records(spark, str(tmp_path), F.startswith("line", F.lit("H")))
            got = [(r.file.rsplit("/", 1)[1], r.block_index, r.first_line, r.text) for r in found.collect()]
            assert sorted(got) == sorted(expected)
            assert "_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_task_content_is_prepared_once(spark):
    """Blank, missing and empty-list values are left out; no lambda takes the parsing out of generated code."""
    raw = spark.createDataFrame([
        ("<Data Name='TaskName'>T</Data><Data Name='TaskContent'>&lt;Task&gt;&lt;BootTrigger/&gt;&lt;Command&gt;c&lt;/Command&gt;&lt;Arguments&gt;[]&lt;/Arguments&gt;&lt;/Task&gt;</Data>",), ("none",), (None,)],
        "raw string").select(scheduled_task(F.col("raw")).alias("a"))
    assert [r.a for r in raw.collect()] == [{"task_name": "T", "action_command": "c", "triggers": "BootTrigger"}, {}, {}]
    assert "lambda" not in raw._jdf.queryExecution().optimizedPlan().toString()
