"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads."""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townmeter.llm.bpe import bytes_to_letters, ship
from townmeter.llm.common import Scratch, small_batches

# Fixed values of the file format. A record is its payload's length, the length's masked checksum, the payload, the payload's masked checksum;
# a payload is flags, key and ids; the index has each record's offset in its file and the number of ids before it there. All little-endian.
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
PAYLOAD = struct.Struct("<Bq")
INDEX = struct.Struct("<QQ")
MASK_DELTA = 0xA282EAD8
WIDE, NO_KEY = 1, 2

#: Records of a chunk, which a task reads in one piece after another.
CHUNK = 2000
#: Bytes of records that a task holds while it reads a chunk, or the longest record.
READ_BYTES = 8 << 20
#: Encoded words that a Python worker keeps, twice at most.
KEPT_WORDS = 500_000
#: Open files of a task that reads in shuffled order.
OPEN_FILES = 16


def masked(data: bytes) -> int:
    """CRC-32 of the data, turned by 15 bits and moved by a constant, so that checksums of data that holds checksums differ."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def index_entry(at: int, before: int) -> bytes:
    """A record's offset and the number of ids before it."""
    return INDEX.pack(at, before)


def framed(key: int | None, ids: np.ndarray) -> bytes:
    """One record: ids in 16 bits each if they fit, else in 32."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    payload = PAYLOAD.pack(wide * WIDE | (key is None) * NO_KEY, key or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframed(data: memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """Key, ids (32 bits each) and end of the record at a place; an error if it is cut off or a checksum differs."""
    if len(data) < at + HEAD.size:
        raise ValueError("a record is cut off")
    length, crc = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError("checksum of a record's length differs")
    start, end = at + HEAD.size, at + HEAD.size + length
    if len(data) < end + TAIL.size:
        raise ValueError("a record is cut off")
    payload = data[start:end]
    if masked(payload) != TAIL.unpack_from(data, end)[0]:
        raise ValueError("checksum of a record differs")
    flags, key = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size).astype("<u4")
    return None if flags & NO_KEY else key, ids, end + TAIL.size


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path there."""
    local = re.match(r"(?:file:)?(/.*)", path)
    return (pafs.LocalFileSystem(), re.sub("^/+", "/", local[1])) if local else pafs.FileSystem.from_uri(path)


#: Words of Latin letters with ASCII marks behind them: a vocabulary's pieces part there, as contractions and special tokens have letters behind their marks.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_WORD = re.compile(r"[^ \t\n\r]+")
#: White space by which str.split() parts words.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


class _Encoder(dict):
    """Words to the ids that the tokenizers library gives them, as bytes of 32 bits each; those of this and the last generation of KEPT_WORDS are kept.

    A vocabulary may drop white space between words; then words are encoded on their own. If it
    also lower-cases letters and spells bytes, as probes tell, its model is asked for words of Latin letters directly;
    all other words go through the whole library.
    """

    def __init__(self, content: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.last = Tokenizer.from_str(content), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.simple = self.tokenizer.model, False
        kept = [c for c in _SPACES if self._ids(f"a{c}b") != self._ids("a") + self._ids("b")]
        probes = ("a b", " a\tb ", "a\n\nb", "a \r\n b", "x's 't \n'll", "1 2", "- -", ". \u0301", "<|endoftext|> a", "\u3000 b")
        self.by_word = not set(kept) & set(" \t\n\r") and all(self._ids(p) == b"".join(map(self._ids, _WORD.findall(p))) for p in probes)
        self.kept_spaces = kept
        letters = [chr(c) for c in range(0x41, 0x100) if _SIMPLE.fullmatch(chr(c))]
        spell = bytes_to_letters()
        self.letters = {ord(c): "".join(spell[b] for b in c.encode()) for c in map(str.lower, letters)}
        words = [a + b for a in letters for b in ("", "e", "Ing", "ß,", "tion.", "s!?", "'", "<|", "-*")]
        self.simple = sys.byteorder == "little" and array("I").itemsize == 4 and all(self._spelled(w) == self._ids(w) for w in words)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spelled(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters and marks behind them, from the model alone; None for other words."""
        if word.isascii() and word.isalpha():
            low = word.lower()
        elif found := _SIMPLE.fullmatch(word):
            letters, marks = found.groups()
            if marks:
                return self[letters] + self[marks]
            low = letters.lower()
        else:
            return None
        if low != word:
            return self[low]
        return array("I", [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.last.get(word)
        if ids is None:
            ids = self._spelled(word) if self.simple else None
            if ids is None:
                ids = self._ids(word)
        if len(self) >= KEPT_WORDS:
            self.last = dict(self)
            self.clear()
        if len(word) <= 100:
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self._ids(text), "<u4")
        words = _WORD.findall(text) if any(c in text for c in self.kept_spaces) else text.split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(file: str) -> _Encoder:
    """The encoder of a vocabulary file; the tasks of a Python worker share it."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        with open(SparkFiles.get(file), encoding="utf-8") as f:
            _ENCODERS[file] = _Encoder(f.read())
    return _ENCODERS[file]


def _write(path: str, vocabulary_file: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_file)
        part, files, at, before, records = TaskContext.get().partitionId(), None, 0, 0, 0
        fs, folder = opened(path)
        # Each attempt of a task has files of its own; the manifest names those of the attempt that ended.
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        end = np.asarray([] if end_id is None else [end_id], "<u4")
        try:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    files = files or (fs.open_output_stream(f"{folder}/{name}.rec"), fs.open_output_stream(f"{folder}/{name}.idx"))
                    ids = np.concatenate([encoder.ids(text or ""), end])
                    record = framed(key, ids)
                    files[0].write(record)
                    files[1].write(index_entry(at, before))
                    at, before, records = at + len(record), before + len(ids), records + 1
        finally:
            for file in files or ():
                file.close()
        if records:
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "records": records, "ids": before, "bytes": at}], pa.schema([("part", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_records(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """Write each row's token ids as a record under path, in ascending order of the key; the manifest is returned.

    vocabulary: path of a file of the tokenizers library; end_id is put after each text's ids.
    The key is an integer, or null, which comes first; rows of one key follow one another by a
    hash of their texts. A null text is empty. Repeated rows have a record each; an empty table
    has no file; other columns are ignored, whatever their names. path is in a folder that driver
    and executors share.

    Rows are dealt by ranges of the whole order, so a hot key is no one task; each task encodes
    its rows and writes one record file (`.rec`) and one index file (`.idx`), which it holds none of
    in memory. The manifest is a Parquet table in path/manifest with a row per file, in order:
    part, file, records, ids, bytes, start (ids of all files before). Files of attempts that
    failed are in no manifest and are deleted.
    """
    spark = docs.sparkSession
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("the key must be an integer")
    small_batches(spark, 200)
    with open(vocabulary, encoding="utf-8") as f:
        vocabulary_file = ship(spark, f.read().encode(), "vocabulary")
    fs, folder = opened(path)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("h", F.xxhash64("t")).withColumn("seq", F.monotonically_increasing_id())
    order = [F.col("k").asc_nulls_first(), F.col("h"), F.col("seq")]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    files = Scratch(spark).put(ranged.select("k", "t").mapInArrow(_write(path, vocabulary_file, end_id), "part long, file string, records long, ids long, bytes long"))
    start = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files.withColumn("start", start).orderBy("part").coalesce(1).write.parquet(f"{path}/manifest")
    kept = {r.file for r in files.select("file").collect()}
    for found in fs.get_file_info(pafs.FileSelector(folder)):
        if found.extension in ("rec", "idx") and found.base_name.rpartition(".")[0] not in kept:
            fs.delete_file(found.path)
    return manifest_of(spark, path)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, file string, records long, ids long, bytes long, start long").parquet(f"{path}/manifest")


class _Open:
    """Open files of a folder, the last used ones."""

    def __init__(self, path: str):
        self.fs, self.folder = opened(path)
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, at: int, end: int) -> bytes:
        if name not in self.files:
            self.files[name] = self.fs.open_input_file(f"{self.folder}/{name}")
            if len(self.files) > 2 * OPEN_FILES:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name].read_at(end - at, at)


def _pieces(offsets: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of records [a, b) of READ_BYTES at most, or of one record; offsets has one more than there are records."""
    a = 0
    while a < len(offsets) - 1:
        b = a + 1
        while b < len(offsets) - 1 and offsets[b + 1] - offsets[a] <= READ_BYTES:
            b += 1
        yield a, b
        a = b


def records_of(path: str, chunks: Iterable[tuple[str, int, int, int, int, int]]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, start, ids) of the records of chunks (file, the file's start, its records and bytes, first record, end)."""
    files = _Open(path)
    for file, file_start, records, size, first, end in chunks:
        entries = list(INDEX.iter_unpack(files.read(f"{file}.idx", first * INDEX.size, min(end + 1, records) * INDEX.size)))
        offsets = [o for o, _ in entries[: end - first]] + [entries[-1][0] if end < records else size]
        for a, b in _pieces(offsets):
            data, at = memoryview(files.read(f"{file}.rec", offsets[a], offsets[b])), 0
            for i in range(a, b):
                if offsets[i] - offsets[a] != at:
                    raise ValueError("the index differs from the records")
                key, ids, at = unframed(data, at)
                yield key, file_start + entries[i][1], ids


def _read(path: str, give_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.list_(pa.int32()))] * give_ids
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["k", "start", "n_tokens", "ids_crc32"] + ["ids"] * give_ids)

        held = 0
        chunks = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, start, ids in records_of(path, chunks):
            for c, v in zip(out, (key, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype("<i4") if give_ids else None)):
                c.append(v)
            held += 4 * len(ids) * give_ids
            if len(out[0]) >= 2000 or held > READ_BYTES:
                yield flush()
                held = 0
        yield flush()

    return run


def _dealt(chunks: DataFrame, path: str, key: str, give_ids: bool) -> DataFrame:
    schema = "k long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * give_ids
    return chunks.select("file", "start", "records", "bytes", "first", "end").mapInArrow(_read(path, give_ids), schema).withColumnRenamed("k", key)


def read_records(spark: SparkSession, path: str, key: str = "doc_id", give_ids: bool = True) -> DataFrame:
    """One row per record under path: key, start (ids of all records before it), n_tokens, ids_crc32 (of the ids in 32 bits each), and ids.

    Each task reads chunks of CHUNK records, cut by the index. A record that is cut off, whose
    checksums differ, or that isn't where the index says is an error.
    """
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(CHUNK).cast("long")))
    chunks = manifest_of(spark, path).select("*", first.alias("first")).withColumn("end", F.least(F.col("first") + CHUNK, F.col("records")))
    return _dealt(chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "first"), path, key, give_ids)


def read_shuffled(spark: SparkSession, path: str, seed: int, key: str = "doc_id", give_ids: bool = True) -> DataFrame:
    """The same rows in an order that the seed decides: places of records are shuffled, and each record is fetched by its index entry.

    The order is the one of the rows within partitions, and of partitions; equal seeds and numbers of shuffle partitions give equal orders.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = manifest_of(spark, path).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("first")).withColumn("end", F.col("first") + 1)
    order = F.xxhash64(F.lit(seed), "file_order", "first")
    dealt = places.withColumn("file_order", F.col("part")).withColumn("order", order).repartition(tasks, "order").sortWithinPartitions("order", "part", "first")
    return _dealt(dealt, path, key, give_ids)


