"""Binary records: known checksums, exact round trips, and the registered query against whole-text encoding."""

import os
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from alertweft.llm import records
from alertweft.llm.crc32c import crc32c, masked
from alertweft.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def slow_crc(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_known_checksums():
    assert crc32c([b"123456789", b"", bytes(32), b"\xff" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43]
    assert masked([b""]).tolist() == [0xA282EAD8] and len(crc32c([])) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_checksums(blocks):
    assert crc32c(blocks).tolist() == [slow_crc(b) for b in blocks]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    whole = [f.ids + [1] for f in tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = records.Encoder(WORDS, 1, True).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == whole


def test_old_words_are_let_go(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 3)
    monkeypatch.setattr(records, "JOINED", 2)
    encoder, whole = records.Encoder(WORDS, None, True), records.Encoder(WORDS, None, False)
    for text in (b"one two three", b"two four five one ~ x~y", b"a b c d e f a", b"one <|endoftext|> a", b"", b"q", b"r one"):
        assert encoder.encode([text, text]) == whole.encode([text, text])
    assert len(encoder.known) + len(encoder.older) < 12


def listed(folder):
    return sorted(p for p in Path(folder).iterdir() if p.suffix in (".rec", ".idx"))


def test_round_trip(spark, docs_of):
    long = "word " * 90_000
    docs = docs_of([(9, "nine"), (None, "no id"), (2, None), (-5, "minus"), (9, "nine"), (9, "a nine"), (None, None), (4, long), (3, "\U0001f600 <|endoftext|>é")])
    path = scratch_path(spark, "records")
    records.write(docs, path, WORDS, end=1, file_bytes=1 << 12)
    rows = records.read(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(WORDS)
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert [r.id for r in rows] == [-5, 2, 3, 4, 9, 9, 9, None, None]
    assert [r.start for r in rows] == [0, *np.cumsum([len(i) for i in ids])[:-1].tolist()] and [r.n_tokens for r in rows] == [len(i) for i in ids]
    whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids + [1]
    assert ids[0] == whole("minus") and ids[1] == [1] and ids[3] == whole(long) and ids[2] == whole("\U0001f600 <|endoftext|>é")
    assert sorted(ids[4:7]) == sorted([whole("nine"), whole("nine"), whole("a nine")]) and sorted(ids[7:]) == sorted([whole("no id"), [1]])

    shuffled = [(r.start, r.ids) for r in records.read_shuffled(spark, path, seed=3, parts=2).collect()]
    assert sorted(shuffled) == sorted((r.start, r.ids) for r in rows) and [s for s, _ in shuffled] != sorted(s for s, _ in shuffled)
    assert [s for s, _ in shuffled] == [r.start for r in records.read_shuffled(spark, path, seed=3, parts=2).collect()]


def test_frames_by_hand(spark, docs_of):
    """The bytes of a file, read without the library."""
    path = scratch_path(spark, "records")
    records.write(docs_of([(7, "seven of nine")]), path, WORDS, end=70_000)
    data = next(p for p in listed(path.removeprefix("file:")) if p.suffix == ".rec").read_bytes()
    (size,) = struct.unpack("<Q", data[:8])
    payload = data[12 : 12 + size]
    mask = lambda b: ((slow_crc(b) >> 15 | slow_crc(b) << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert struct.unpack("<I", data[8:12])[0] == mask(data[:8]) and struct.unpack("<I", data[12 + size :])[0] == mask(payload)
    assert payload[:2] == b"\x04\x01" and struct.unpack("<q", payload[2:10])[0] == 7 and payload[-4:] == struct.pack("<I", 70_000)


@pytest.mark.parametrize("at", [3, 9, 14, 30, -1])
def test_damage_is_found(spark, docs_of, at):
    path = scratch_path(spark, "records")
    records.write(docs_of([(1, "some words that are written")]), path, WORDS, end=1)
    file = next(p for p in listed(path.removeprefix("file:")) if p.suffix == ".rec")
    data = bytearray(file.read_bytes())
    data[at] ^= 1
    file.write_bytes(data)
    crc = file.parent / f".{file.name}.crc"
    assert not crc.exists()
    for reader in (records.read(spark, path), records.read_shuffled(spark, path, parts=1)):
        with pytest.raises(Exception, match="broken record"):
            reader.collect()


def test_files_of_lost_tasks_do_not_count(spark, docs_of):
    path = scratch_path(spark, "records")
    records.write(docs_of({1: "one", 2: "two"}), path, WORDS, end=1)
    folder = path.removeprefix("file:")
    for suffix in (".rec", ".idx"):
        Path(folder, f"part-0000000-lost{suffix}").write_bytes(os.urandom(50))
    assert records.read(spark, path).count() == 2


def test_empty_table(spark, docs_of):
    path = scratch_path(spark, "records")
    records.write(docs_of([(1, "x")]).limit(0), path, WORDS, end=1)
    assert records.read(spark, path).count() == 0 and records.read_shuffled(spark, path, parts=1).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry

    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, set()
    for (doc_id, _), found in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)):
        ids = np.array([*found.ids, 1], dtype="<u4")
        want.add((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    rows = entry.queries()["op11_records"](spark, FOLDER)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {tuple(r) for r in rows.collect()} == want
    assert [t.simpleString() for t in (f.dataType for f in rows.schema)] == ["bigint"] * 4
