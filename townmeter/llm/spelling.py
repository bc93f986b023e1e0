"""Spelling variants of words: pairs at one edit from positional q-grams, forms and roots from their counts."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby
from operator import ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, checked

#: Words have at least so many code points and occurrences.
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many occurrences loses a code point, as a typing error would.
ERROR_RATE = 97
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: Code points of a gram. One edit destroys at most Q grams of either word.
Q = 2
#: Pairs that reach the overlap bound share so many of their rarest grams.
SHARED = 2
#: Words that a task indexes at a time; larger buckets are cut into blocks, and pairs of blocks are dealt out.
BLOCK = 4000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"


def occurrences(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """(word): each occurrence of a run of Latin letters, lower-cased in A-Z, with its error; only those of MIN_LENGTH or more."""
    runs = docs.select(F.coalesce(key.cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("raw")).filter(F.length("raw") >= MIN_LENGTH)
    run = F.when(F.octet_length("raw") == F.length("raw"), F.lower("raw")).otherwise(F.translate("raw", _UPPER, _LOWER))
    hashed = runs.select("k", run.alias("run")).select("run", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % ERROR_RATE == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)


def grams(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


def overlap_bound(longest: int) -> int:
    """Grams that two words at one edit share at least, at places at most one apart; longest: the length of the longer one."""
    return longest - Q + 1 - Q


def keys_of(word: str, rank: dict[str, int]) -> Iterator[tuple[int, bool]]:
    """(key, whether the word is the longer one) for each bucket of the index that holds the word.

    A bucket is a length of the longer word and two grams with their places. Words that share
    at least `overlap_bound` grams share SHARED of them among the first (grams - bound + SHARED)
    in any common order, here the rarest first; as a pair's matching grams keep their order, this
    holds for repeated grams as well. In words of one length matching grams have one place; in
    the longer of two words they are at the same place or one further.
    """
    found = sorted((rank.get(g, -1), p) for p, g in enumerate(grams(word)))
    for longest in (len(word), len(word) + 1):
        own = longest == len(word)
        first = sorted(found[: len(found) - overlap_bound(longest) + SHARED], key=lambda x: x[1])
        seen = set()
        for (a, p), (b, r) in combinations(first, 2):
            for s, t in ((0, 0),) if own else ((0, 0), (0, 1), (1, 1)):
                seen.add(hash((longest, a, p + s, b, r + t)))
        for key in seen:
            yield key, own


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]


def near_pairs(bucket: list[tuple[str, bool, int]], crossing: bool) -> Iterator[tuple[int, int]]:
    """Places (i, j) in a bucket of (word, whether longer, block) of words at one edit, each pair once.

    The bucket's words are posted by gram and place, the shorter ones first. A longer word merges
    the postings of its grams by a heap, which brings a candidate's occurrences together, before
    it is posted itself; candidates that reach the overlap bound are verified. A list that holds
    all words so far, such as those of the bucket's own grams, only lowers the bound. Pairs of
    two shorter words belong to another length. crossing: only pairs of different blocks.
    """
    postings: dict[tuple[str, int], list[int]] = {}
    held: list[int] = []
    for i in sorted(range(len(bucket)), key=lambda i: bucket[i][1]):
        word, longer, block = bucket[i]
        own = list(zip(grams(word), range(len(word))))
        if longer and held:
            lists = [found for key in own if (found := postings.get(key))]
            bound, n = overlap_bound(len(word)), len(held)
            if len(lists) >= bound:
                some = [found for found in lists if len(found) < n]
                bound -= len(lists) - len(some)
                if bound <= 0:
                    candidates = held
                elif bound == 1 and len(some) == 1:
                    candidates = [held[k] for k in some[0]]
                else:
                    candidates = [held[k] for k, times in Counter(heapq.merge(*some)).items() if times >= bound]
                for j in candidates:
                    other, _, other_block = bucket[j]
                    if not (crossing and block == other_block) and one_edit(word, other):
                        yield i, j
        at = len(held)
        for key in own if longer else {(g, p + s) for g, p in own for s in (0, 1)}:
            if found := postings.get(key):
                found.append(at)
            else:
                postings[key] = [at]
        held.append(i)


def _post(rank: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, own in keys_of(word, rank):
                    for column, value in zip(out, (key, own, word, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.string(), pa.int64()))], ["key", "longer", "word", "n"])

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, which follow one another in the rows, to near pairs in both directions."""
    out: tuple[list, list, list] = ([], [], [])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()))], ["word", "other", "other_n"])
        for column in out:
            column.clear()
        return made

    for (_, x, y), rows in groupby(_rows(batches), key=lambda r: r[:3]):
        members = [(word, longer, block, n) for _, _, _, longer, block, word, n in rows]
        if len(members) > 1 and any(m[1] for m in members):
            for i, j in near_pairs([m[:3] for m in members], x != y):
                for a, b in ((members[i], members[j]), (members[j], members[i])):
                    for column, value in zip(out, (a[0], b[0], b[3])):
                        column.append(value)
        if len(out[0]) > 5000:
            yield flush()
    yield flush()


def near_words(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, other, other_n) of different words at one edit, in both directions, each once; counted: written (word, n), no word twice.

    Words go to the buckets of their rarest grams; counts of grams are a table as large as the
    square of the alphabet. Buckets over BLOCK words are cut into blocks, of which each pair is
    a bucket of its own, so no task holds more than two blocks.
    """
    spark = counted.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gram = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - Q + 1), lambda i: F.col("word").substr(i, F.lit(Q)))))
    # At most (26 + 64)^2 grams.
    order = counted.select(gram.alias("gram")).groupBy("gram").count().collect()
    rank = {g: i for i, (_, g) in enumerate(sorted((r["count"], r["gram"]) for r in order))}
    posted = scratch.put(counted.select("word", "n").repartition(tasks, "word").mapInArrow(_post(rank), "key long, longer boolean, word string, n long"))
    large = scratch.put(posted.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("held") / BLOCK), F.lit(1)).cast("int")
    placed = posted.join(checked(large), "key", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "key", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "longer", "block", "word", "n"
    )
    pairs = scratch.put(cells.repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_meet, "word string, other string, other_n long"))
    met = scratch.put(pairs.groupBy("word", "other").agg(F.first("other_n").alias("other_n")))
    for used in (posted, large, pairs):
        scratch.drop(used)
    return met


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for written (word, form): the last word that forms lead to. Each round doubles the steps; a form has RATIO times its variant's count, so there are few."""
    at = scratch.put(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.put(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(at)
        at = moved
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")


def variants_of(counted: DataFrame, scratch: Scratch, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of written (word, n).

    n_near: words at one edit. form: the one of largest n, ties to the smaller in code-point
    order, if it has ratio times the word's n, else null; form_n is its n. root: the last word that forms lead
    to, the word itself without a form.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    near = near_words(counted, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.w"))
    found = scratch.put(counted.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")))
    roots = _roots(found.filter("form is not null"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of docs: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters in whole texts, lower-cased in A-Z, with the errors that
    the hash of key and run puts in, of at least MIN_LENGTH code points and MIN_COUNT occurrences.
    Null and empty texts have no words, a null key hashes as an empty one; repeated rows count as
    often as they are there; an empty table gives an empty one; other columns are ignored,
    whatever their names. A word of any length, and a text of any number of words, is taken whole.

    Occurrences are counted per task before the shuffle; from there on each word is one row.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.put(occurrences(docs, F.col(key), F.col(text)).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT))
    return variants_of(counted, scratch)
