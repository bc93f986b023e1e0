"""Byte-level BPE with a compiled lexicon of frequent words and exact merges for the others."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, small_batches, words
from townmeter.llm.lexicon import Lexicon, compile_lexicon

#: Frequent words that the lexicon takes, a bound on what the driver compiles.
LEXICON_WORDS = 60_000
#: Longest word, in UTF-8 bytes, that the lexicon takes.
LEXICON_BYTES = 40
#: Unseen words whose ids a Python worker keeps.
KEPT_WORDS = 400_000

# How byte-level vocabularies split text before merging. White space is the Unicode property.
# Letters come first, as most words are letters and no two alternatives before white space begin alike.
PIECES = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def bytes_to_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


_NO_RANK = 1 << 30


class Bpe:
    """The vocabulary of a byte-level tokenizers file: exact encoding of words, bytes of ids."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = {c: b for b, c in enumerate(bytes_to_letters())}
        spell = lambda token: bytes(letters[c] for c in token)
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", []) if t["content"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word borders are not supported")
        model, before = data["model"], data["pre_tokenizer"]
        if data["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        self.bytes = {i: spell(t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.letter = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank merges first, the leftmost of equal ones."""
        ids = [self.letter[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        if len(ids) < 2:
            return ids
        # Ranks of neighbours; a merge changes two of them.
        none, get = (_NO_RANK, -1), self.merges.get
        pairs = [get(pair, none) for pair in zip(ids, ids[1:])]
        ranks = [p[0] for p in pairs]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [pairs[i][1]]
            del pairs[i], ranks[i]
            if i:
                pairs[i - 1] = p = get((ids[i - 1], ids[i]), none)
                ranks[i - 1] = p[0]
            if i < len(ranks):
                pairs[i] = p = get((ids[i], ids[i + 1]), none)
                ranks[i] = p[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of pairs over a linked list."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]


class _Encoded(dict):
    """Words to ids as bytes: from the lexicon, else merged. Words of this and the last generation of KEPT_WORDS are kept."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        super().__init__()
        self.bpe, self.lexicon, self.last = bpe, lexicon, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.last.get(word)
        if ids is None:
            raw = word.encode()
            ids = self.lexicon.get(raw)
            if ids is None:
                found = self.bpe.merge(raw)
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= KEPT_WORDS:
            self.last = dict(self)
            self.clear()
        if len(word) <= 100:
            self[word] = ids
        return ids


def encode_text(text: str, bpe: Bpe, encoded: _Encoded) -> bytes:
    """A text's ids as little-endian unsigned 32-bit integers; special tokens in the text become their ids."""
    if bpe.cut is None or not any(s in text for s in bpe.special):
        return b"".join(map(encoded.__getitem__, bpe.split.findall(text)))
    out = []
    for i, part in enumerate(bpe.cut.split(text)):
        out.append(struct.pack("<I", bpe.special[part]) if i % 2 else b"".join(map(encoded.__getitem__, bpe.split.findall(part))))
    return b"".join(out)


def decode_ids(ids: bytes, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, text: str, most: int = LEXICON_WORDS) -> list[str]:
    """The words of all texts that occur so often that at most `most` words do; at most that many reach the driver.

    Words are counted per task before the shuffle. How many words have which count tells the
    least count; there are few different counts.
    """
    word = F.explode(words(F.col(text)))
    counts = docs.select(word.alias("word")).filter(F.octet_length("word") <= LEXICON_BYTES).groupBy("word").count()
    counts = Scratch(docs.sparkSession).put(counts.filter("count > 1"))
    upto = F.sum("words").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0))
    least = counts.groupBy("count").agg(F.count("*").alias("words")).withColumn("upto", upto).filter(F.col("upto") <= most).agg(F.min("count")).first()[0]
    return [] if least is None else [r.word for r in counts.filter(F.col("count") >= least).select("word").collect()]


def build_lexicon(frequent: list[str], bpe: Bpe) -> bytes:
    """The compiled lexicon of the pieces of frequent words, as they occur after a space and at a line's start."""
    pieces = {p for w in frequent for form in (w, f" {w}") for p in bpe.split.findall(form)}
    return compile_lexicon((raw, tuple(bpe.merge(raw))) for p in pieces if len(raw := p.encode()) <= LEXICON_BYTES)


def ship(spark: SparkSession, content: bytes, name: str) -> str:
    """Send a file to all executors, present and future; its name holds its hash, so that it is the same file wherever it is found."""
    name = f"{name}-{hashlib.sha256(content).hexdigest()[:24]}"
    path = os.path.join(tempfile.gettempdir(), name)  # the same path each time, as Spark takes a name from one path only
    held = None
    if os.path.exists(path):
        with open(path, "rb") as f:
            held = f.read()
    if held != content:
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(content)
        os.replace(f.name, path)
    spark.sparkContext.addFile(path)
    return name


@functools.lru_cache(maxsize=1)
def _loaded(lexicon_file: str, vocabulary_file: str) -> tuple[Bpe, _Encoded, list[bytes]]:
    """The vocabulary, the words encoded so far and the bytes of each id; the tasks of a Python worker share them."""
    with open(SparkFiles.get(vocabulary_file), encoding="utf-8") as f:
        bpe = Bpe(f.read())
    return bpe, _Encoded(bpe, Lexicon(SparkFiles.get(lexicon_file))), [bpe.bytes.get(i, b"") for i in range(max(bpe.bytes) + 1)]


def _run(lexicon_file: str, vocabulary_file: str, give_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoded, table = _loaded(lexicon_file, vocabulary_file)
        for batch in batches:
            n, id_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(text or "", bpe, encoded)
                n.append(len(ids) // 4)
                id_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decode_ids(ids, table).encode()).hexdigest())
                if give_ids:
                    all_ids.append(memoryview(ids).cast("I").tolist())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if give_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", give_ids: bool = False, most: int = LEXICON_WORDS) -> DataFrame:
    """One row per row of docs: key, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    vocabulary: path of a byte-level BPE file of the tokenizers library. Whole texts are encoded
    as that library does without added special tokens; a null text is empty. ids_sha256 is of
    the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the text that the ids
    decode to. Repeated rows give equal rows; an empty table gives an empty one; the key may be
    of any type and null; other columns are ignored.

    Words are counted over all texts; the most frequent ones, a bounded number, are compiled
    into an automaton, whose file goes to every executor and is mapped by its Python workers.
    Other words are merged exactly, and a bounded number of them is kept per worker.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    lexicon = ship(spark, build_lexicon(frequent_words(docs, text, most), Bpe(content)), "lexicon")
    vocabulary_file = ship(spark, content.encode(), "vocabulary")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * give_ids
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_run(lexicon, vocabulary_file, give_ids), schema).withColumnRenamed("id", key)
