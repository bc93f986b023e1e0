"""Record files: the library's ids, a format read by its letter, damage, shuffled reads."""

import glob
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from townmeter.llm import queries, records
from townmeter.sources.shared import fresh_dir


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def brute(tokenizer, rows):
    """Rows by the contract's letter; keys differ."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(tokenizer, text), 1]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=lambda r: r[1])


def write(spark, rows, schema="doc_id long, text string", **more):
    path = fresh_dir(spark, "test-records")
    records.write_records(spark.createDataFrame(rows, schema), path, queries.vocabulary("word_bpe_49k.json"), end_id=1, **more)
    return path


def test_query_equals_the_library(spark, sf_dir, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_records(spark, sf_dir)) == brute(tokenizer, rows)


ODD = [
    (7, "Plain text."), (None, "no key"), (-3, None), (4, ""), (5, " \t\n "), (6, "İstanbul ΣΑΣ ﬁ Ａ é ́x . ́ ẞ"), (8, "a<|endoftext|>b <|startoftext|> it's IT'S 'LL"),
    (9, "nb\x1csp\x85a b　c﻿d\x0be\x0cf"), (10, "日本語 テキスト 12345 ½ 🙂🙂"), (2**62, "end"), (11, "word " * 300000), (12, "x" * 200000), (13, "\r\nline\r\n\r\nline"),
]


def test_odd_texts_equal_the_library(spark, tokenizer):
    path = write(spark, ODD)
    assert found(records.read_records(spark, path)) == brute(tokenizer, ODD)
    ids = {r.doc_id: r.ids for r in records.read_records(spark, path).collect()}
    assert all(ids[k] == [*ids_of(tokenizer, t), 1] for k, t in ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_equals_the_library(tokenizer, text):
    assert list(_encoder().ids(text)) == ids_of(tokenizer, text)


def _encoder(kept=[]):  # noqa: B006
    if not kept:
        with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
            kept.append(records._Encoder(f.read()))
    return kept[0]


@settings(max_examples=300, deadline=None)
@given(st.text("abstzEéÉßÿØ×÷ß'`,.;:!?-_1 \t\x0b\x1c\x85\xa0\u0301", max_size=25))
def test_words_and_marks_equal_the_library(tokenizer, text):
    assert list(_encoder().ids(text)) == ids_of(tokenizer, text)


def test_probes_tell_the_vocabularies_apart():
    assert _encoder().by_word and _encoder().simple
    with open(queries.vocabulary(), encoding="utf-8") as f:
        other = records._Encoder(f.read())
    assert not other.by_word and not other.simple


def test_few_kept_words(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "KEPT_WORDS", 5)
    for text in ("a b c d e f g h i j", "k l m", "a k z", "", "a b c d e f g"):
        assert list(_encoder().ids(text)) == ids_of(tokenizer, text)


def test_vocabulary_that_keeps_spaces(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    path = fresh_dir(spark, "test-records")
    records.write_records(spark.createDataFrame(ODD, "doc_id long, text string"), path, queries.vocabulary())
    assert {r.doc_id: r.ids for r in records.read_records(spark, path).collect()} == {k: t.encode(s or "", add_special_tokens=False).ids for k, s in ODD}


def test_ties_repeats_empty_and_other_columns(spark, tokenizer):
    rows = [(1, "one"), (1, "two words"), (1, "one"), (None, "x"), (None, "x"), *[(2, "copy of a row")] * 500]
    out = found(records.read_records(spark, write(spark, rows)))
    assert sorted((k is not None, k or 0, n, c) for k, _, n, c in out) == sorted((k is not None, k or 0, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for k, i in ((k, [*ids_of(tokenizer, t), 1]) for k, t in rows))
    assert [s for _, s, *_ in out] == [0, *np.cumsum([n for _, _, n, _ in out])[:-1]]
    assert [k for k, *_ in out] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    clash = [(k, t, 1, "h", 2.0) for k, t in rows]
    assert found(records.read_records(spark, write(spark, clash, "doc_id long, text string, k int, h string, seq double"))) == out
    assert found(records.read_records(spark, write(spark, []))) == []
    with pytest.raises(ValueError, match="integer"):
        write(spark, [("a", "b")], "doc_id string, text string")


def test_files_by_their_letter(spark, tokenizer):
    path = write(spark, ODD)
    mask = lambda b: (((c := zlib.crc32(b)) >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    keys, before_files = [], 0
    for row in sorted(records.manifest_of(spark, path).collect(), key=lambda r: r.part):
        data, index = (open(f"{path}/{row.file}{x}", "rb").read() for x in (".rec", ".idx"))
        at, before = 0, 0
        assert row.start == before_files and len(index) == 16 * row.records and len(data) == row.bytes
        for i in range(row.records):
            assert struct.unpack_from("<QQ", index, 16 * i) == (at, before)
            (n, crc), body = struct.unpack_from("<QI", data, at), data[at + 12 :]
            assert crc == mask(data[at : at + 8]) and struct.unpack_from("<I", body, n)[0] == mask(body[:n])
            flags, key = struct.unpack_from("<Bq", body)
            ids = np.frombuffer(body[9:n], "<u2").tolist()
            key = None if flags & 2 else key
            keys.append(key)
            assert ids == [*ids_of(tokenizer, dict(ODD)[key]), 1]
            at, before = at + 12 + n + 4, before + len(ids)
        assert before == row.ids
        before_files += row.ids
    assert keys == sorted(dict(ODD), key=lambda k: (k is not None, k or 0))
    named = {r.file for r in records.manifest_of(spark, path).collect()}
    assert {os.path.basename(f)[:-4] for f in glob.glob(f"{path}/*.rec") + glob.glob(f"{path}/*.idx")} == named


def test_shuffled_reads(spark):
    path = write(spark, [(i, f"text number {i} " * (i % 7)) for i in range(300)])
    straight, once, again, other = records.read_records(spark, path).collect(), *(records.read_shuffled(spark, path, s).collect() for s in (1, 1, 2))
    key = lambda r: r.doc_id
    assert sorted(straight, key=key) == sorted(once, key=key) == sorted(other, key=key)
    assert once == again and list(map(key, once)) != list(map(key, other))
    assert list(map(key, once)) != sorted(map(key, once))


@pytest.mark.parametrize("at, message", [(0, "length"), (9, "length"), (30, "record differs"), (-1, "record differs")])
def test_damage_is_an_error(at, message):
    data = bytearray(records.framed(5, np.arange(1, 30, dtype="<u4")))
    assert records.unframed(memoryview(bytes(data)))[0] == 5
    data[at] ^= 1
    with pytest.raises(ValueError, match=message):
        records.unframed(memoryview(bytes(data)))
    with pytest.raises(ValueError, match="cut off"):
        records.unframed(memoryview(records.framed(5, np.arange(3, dtype="<u4")))[:-2])


def test_damaged_file_is_an_error(spark):
    path = write(spark, [(i, "some text") for i in range(50)])
    name = glob.glob(f"{path}/*.rec")[0]
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 4
    with open(name, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="differs"):
        records.read_records(spark, path).collect()


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=30))
def test_round_trip(key, ids):
    frame = records.framed(key, np.array(ids, "<u4"))
    got, back, end = records.unframed(memoryview(b"junk" + frame + b"rest"), 4)
    assert (got, back.tolist(), end) == (key, ids, 4 + len(frame))
    assert len(frame) == 16 + 9 + (2 if max(ids, default=0) < 65536 else 4) * len(ids)


def test_chunks_and_pieces(spark, monkeypatch, tokenizer):
    rows = [(i, "word " * (i % 40)) for i in range(200)]
    path = write(spark, rows)
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(records, "CHUNK", chunk)
        assert found(records.read_records(spark, path)) == brute(tokenizer, rows)
    monkeypatch.setattr(records, "READ_BYTES", 200)
    files = [(r.file, r.start, r.records, r.bytes, 0, r.records) for r in sorted(records.manifest_of(spark, path).collect(), key=lambda r: r.part)]
    got = [(k, s, len(i), zlib.crc32(i.tobytes())) for k, s, i in records.records_of(path, files)]
    assert got == brute(tokenizer, rows)
