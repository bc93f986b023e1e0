"""Substring dedup over sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, small_batches

#: Sentences of a run; words of a repeated region that is removed, or of a sentence that is a run alone.
SENTENCES, WORDS = 2, 20
#: Sentences of more words are cut before words whose hash is the least of NEAR words on both sides.
LONGEST, NEAR = 10, 3

_END = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n+")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cuts(words: list[bytes]) -> list[int]:
    """Words that a piece starts with: whether one does depends on the NEAR words on both sides only, so a passage is cut alike wherever it stands."""
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    inner = range(NEAR, len(h) - NEAR)
    return [0, *[i for i in inner if h[i - 1] >= h[i] <= h[i + 1] and h[i] == min(h[i - NEAR : i + NEAR + 1])]]


def sentences(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, words) in bytes of each sentence: it ends after . ! ? before white space or at a line's end; those over LONGEST words are cut."""
    out, start = [], 0
    for stop, after in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        piece = text[start:stop]
        split = piece.split()
        n = len(split)
        if n > LONGEST:
            words = [m.span() for m in _WORD.finditer(piece)]
            at = [*cuts(split), n]
            out += [(start + words[i][0], start + words[j - 1][1], j - i) for i, j in zip(at, at[1:], strict=False)]
        elif n:
            lead = len(piece) - len(piece.lstrip())
            out.append((start + lead, start + len(piece.rstrip()), n))
        start = after
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Every run of SENTENCES sentences, and every sentence of WORDS words or more, of each text.

    span: the run's hash; text: its place in texts; start, stop: first and last sentence; before,
    upto: words of the text before the run, and to its end.
    """
    marks: list[int] = []
    words: list[int] = []
    sizes: list[int] = []
    for text in texts:
        found = sentences(text)
        marks += [xxhash.xxh3_64_intdigest(b" ".join(text[a:b].split())) for a, b, _ in found]
        words += [n for _, _, n in found]
        sizes.append(len(found))
    mark, n, size = np.array(marks, np.uint64), np.array(words, np.int64), np.array(sizes, np.int64)
    doc, first = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size) - size, size)
    total = np.concatenate([[0], np.cumsum(n)])
    out = []
    for length, some in ((SENTENCES, np.nonzero(doc[: max(0, len(doc) - SENTENCES + 1)] == doc[SENTENCES - 1 :])[0]), (1, np.nonzero(n >= WORDS)[0])):
        span = np.full(len(some), length, np.uint64)
        for i in range(length):
            span = _mixed(span * np.uint64(0x9E3779B97F4A7C15) + mark[some + i])
        base = total[first[some]]
        out.append((span.view(np.int64), doc[some], some - first[some], some - first[some] + length - 1, total[some] - base, total[some + length] - base))
    return dict(zip(("span", "text", "start", "stop", "before", "upto"), map(np.concatenate, zip(*out, strict=True)), strict=True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 100):
            b = batch.slice(at, 100)
            r = runs(b.column(2).to_pylist())
            own = pa.array(r["text"])
            columns = [pa.array(r["span"]), b.column(0).take(own), b.column(1).take(own), *(pa.array(r[k].astype(np.int32)) for k in ("start", "stop", "before", "upto"))]
            yield pa.RecordBatch.from_arrays(columns, ["span", "id", "tag", "start", "stop", "before", "upto"])


def regions(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, before: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal regions that spans cover, with those that touch joined, if they have WORDS words or more.

    Spans are sorted by document, start and stop. (document, first sentence, last sentence) of each
    region, and the place of each span's region among them, -1 without one.
    """
    reach = np.maximum.accumulate((doc << 32) + stop)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > (reach[:-1] & 0xFFFFFFFF) + 1)
    at = np.nonzero(new)[0]
    good = np.maximum.reduceat(upto, at) - before[at] >= WORDS
    place = np.where(good, np.cumsum(good) - 1, -1)
    return doc[at][good], start[at][good], np.maximum.reduceat(stop, at)[good], place[np.cumsum(new) - 1]


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Lists of values by their owner, 0 to rows - 1; owners are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with regions, and the documents that hold the first places of their spans."""
    for batch in batches:
        if not len(batch):
            continue
        flat = batch.column(2).flatten()
        doc = np.repeat(np.arange(len(batch)), np.asarray(batch.column(2).value_lengths()))
        start, stop, before, upto, first_id = (np.asarray(flat.field(k)).astype(np.int64) for k in ("start", "stop", "before", "upto", "first_id"))
        order = np.lexsort((stop, start, doc))
        own, a, z, place = regions(doc[order], start[order], stop[order], before[order], upto[order])
        held, rows = np.unique(own, return_inverse=True)  # documents with regions
        inside = place >= 0
        pairs = np.unique(np.stack([np.searchsorted(held, doc[order][inside]), first_id[order][inside]], 1), axis=0) if len(held) else np.zeros((0, 2), np.int64)
        spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], ["start", "stop"])
        take = pa.array(held)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), _lists(rows, len(held), spans), _lists(pairs[:, 0], len(held), pa.array(pairs[:, 1]))], ["id", "tag", "regions", "first_doc_ids"]
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their regions."""
    for batch in batches:
        out = {k: [] for k in ("n_sentences", "n_removed", "words_removed", "text")}
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found, left, at = sentences(text), [], 0
            for r in gone:
                left.append(text[at : found[r["start"]][0]])
                at = found[r["stop"]][1]
            out["n_sentences"].append(len(found))
            out["n_removed"].append(sum(r["stop"] - r["start"] + 1 for r in gone))
            out["words_removed"].append(sum(found[i][2] for r in gone for i in range(r["start"], r["stop"] + 1)))
            out["text"].append(b"".join([*left, text[at:]]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(out[k], pa.int64()) for k in list(out)[:3]], pa.array(out["text"], pa.string()), batch.column(3)],
            ["id", "n_sentences", "n_removed", "words_removed", "text", "first_doc_ids"],
        )


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tag, text) of the rows with a key and a text; tag is the text's hash, so rows with one key and different texts are different documents."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and t is not null")
    return rows.select("id", F.xxhash64("t").alias("tag"), F.col("t").cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of (id, tag, spans): the runs of each document that occur earlier, in a smaller key or before in the same document.

    Every run of every text is hashed. A hash's first place is a minimum, summed up per task
    before the shuffle, so that a passage in very many documents is one row per task; runs are
    then joined with the first places of those hashes that occur more than once.
    """
    small_batches(docs.sparkSession)
    spans = scratch.put(_texts(docs, key, text).mapInArrow(_runs, "span long, id long, tag long, start int, stop int, before int, upto int"))
    place = F.struct("id", "tag", "start")
    mark = F.xxhash64("id", "tag", "start")  # tells places apart in fewer bytes than a second one
    first = spans.groupBy("span").agg(F.min(place).alias("first"), F.min(mark).alias("a"), F.max(mark).alias("b")).filter("a < b").select(F.col("span").alias("of"), "first")
    first = scratch.put(first)  # as a table, so that the join below is between two exchanges, of which AQE splits a hot span's rows
    again = spans.join(first, F.col("span") == F.col("of")).filter(place > F.col("first")).select("id", "tag", F.struct("start", "stop", "before", "upto", F.col("first.id").alias("first_id")).alias("s"))
    out = scratch.put(again.groupBy("id", "tag").agg(F.collect_set("s").alias("spans")))
    for used in (spans, first):
        scratch.drop(used)
    return out


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses sentences: key, n_sentences, n_removed, words_removed, text, first_doc_ids.

    A sentence is removed if a run of SENTENCES sentences that covers it, or itself with WORDS
    words, has occurred before, and the region of such sentences around it has WORDS words or
    more. text: what is left, in order; first_doc_ids: the documents that hold the first places of
    what was removed, sorted. Documents that aren't in the result keep their texts as they are.
    White space between words doesn't tell sentences apart. Keys are integers; rows with equal key
    and text are one document and give equal rows, rows without a key or text take no part. An
    empty table gives an empty one; other columns are ignored. Very long texts are cut whole.
    """
    scratch = Scratch(docs.sparkSession)
    found = repeated_spans(docs, scratch, key, text)
    gone = scratch.put(found.mapInArrow(_regions, "id long, tag long, regions array<struct<start:int,stop:int>>, first_doc_ids array<long>"))
    scratch.drop(found)
    joined = _texts(docs, key, text).join(gone.hint("shuffle_hash"), ["id", "tag"]).select("id", "text", "regions", "first_doc_ids")
    schema = "id long, n_sentences long, n_removed long, words_removed long, text string, first_doc_ids array<long>"
    return joined.mapInArrow(_cut, schema).withColumnRenamed("id", key)
