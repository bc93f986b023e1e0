"""Near-duplicates: fast similarity sketching, banding, exact verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, checked, small_batches, words
from townmeter.llm.components import components

#: Bands and rows of the sketch: two sets of similarity 0.8 share no band with probability 3e-6.
BANDS, ROWS = 32, 5
#: Documents of a cluster, and shingles on average, that a task compares with as many others at a time.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Words whose hashes a Python worker keeps.
KEPT_WORDS = 300_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different k-word shingles; fewer words are one shingle.

    Words are what ASCII white space separates, with A-Z lower-cased, as bytes.lower().split() has it.
    """
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    m = min(n, k)
    total = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        total = _mix(total + w[i : n - m + 1 + i] * _ODD[i % 8])
    return np.unique(total)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketch of each non-empty set: sets x bins.

    Round i throws every element into a bin with the value i + fraction, a bin keeps its least
    value, and a set is done after the round that fills its last bin; from round `bins` on, every
    element goes to bin i - bins, so that all bins fill after 2 * bins rounds at most. Values are
    (round << 48) + 48 bits. Two sets agree in a bin with the probability of their similarity.
    """
    out = np.full((len(sets), bins), _FULL, np.uint64)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * bins):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            u = _mix(flat + np.uint64(i + 1) * _ODD[0])
        value = (u & np.uint64((1 << 48) - 1)) | np.uint64(i << 48)
        at = ((u >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out.reshape(-1), row * bins + at, value)
        left = (out == _FULL).any(axis=1)
        if not left.all():
            go = left[row]
            flat, row = flat[go], row[go]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; keys of different bands differ."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[1], (len(sketch), 1))
    for i in range(rows):
        key = _mix(key + parts[:, :, i] * _ODD[2])
    return key


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(t, k, hashes) for t in batch.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            sketch = sketches([sets[i] for i in some], bands * rows)
            keys = band_keys(sketch, bands, rows).view(np.int64)
            held = np.array([len(s) > 0 for s in sets])
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held * bands)]).astype(np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "n", "digest", "bands"])

    return run


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each row of a list column."""
    flat, ends = np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths()))
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets, 100 at a time, as signed numbers in order."""
        hashes = _Hashes()
        for batch in batches:
            for a in range(0, len(batch), 100):
                sets = [np.sort(shingle_set(t, k, hashes).view(np.int64)) for t in batch.column(1).slice(a, 100).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 100), lists], ["id", "shingles"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(_arrays(batch.column(1)), _arrays(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= percent * all their shingles, on full sets;
    component_id is the smallest key that a document reaches, kept tells whether it is its own.
    Keys are integers. A document without words is linked with nothing. Rows with the same key
    are one document, whose texts all count. A row without a key takes the component of its
    copies, null if they have no key either, and isn't kept. Empty tables give empty ones;
    other columns are ignored.

    1. One scan makes a sketch per text; equal shingle sets become one class (its least key).
    2. Classes that share a band key meet in a bucket. Each member is verified against the
       bucket's first one: as many pairs as members, however large the bucket.
    3. Buckets whose members are then one component are done. Of the others, documents whose own
       shingles, which no other of them has, exclude a link are done too. Those left must share a
       shingle of their rarest ones with another component (`_met_in_prefix`); those that do are
       clustered through these shingles and compared within clusters, block by block, on full
       sets, but for the members of a cluster's largest component among themselves; only links
       leave a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    id_text = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    signed = scratch.put(id_text.mapInArrow(_sign(k, bands, rows), "id long, n long, digest binary, bands array<long>"))
    classes = scratch.put(
        signed.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    first = scratch.put(banded.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("lead"), F.max("rep").alias("last")).filter("lead.rep < last").drop("last"))
    met = scratch.put(banded.join(checked(first), "bucket").select("bucket", "rep", "n", "lead"))

    fits = lambda m, n: 100 * F.least(m, n) >= percent * F.greatest(m, n)
    tried = scratch.put(met.filter(F.col("rep") != F.col("lead.rep")).filter(fits(F.col("n"), F.col("lead.n"))).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct())
    members = met.select("rep").distinct()
    sets = scratch.put(id_text.join(members.hint("shuffle_hash"), F.col("id") == F.col("rep"), "left_semi").mapInArrow(_shingles(k), "id long, shingles array<long>"))
    links = scratch.put(_verified(tried, sets, percent))
    found = components(links, scratch)

    part = F.coalesce("component", "rep")
    placed = scratch.put(met.select("bucket", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", part.alias("part")))
    still = scratch.put(_open(placed, scratch))
    alone = _own_shingles(sets.join(still.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi"))
    alone = alone.join(sets.groupBy("id").count().filter("count > 1"), F.col("owner") == F.col("id"), "left_anti")  # a key with several texts isn't judged by one of them
    # Of n shingles, those of the document alone are in no other's set: with too many, it is linked with none.
    near = still.join(alone, F.col("rep") == F.col("owner"), "left").filter(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n"))
    near = scratch.put(near.select("bucket", "rep", "n", "part"))
    left = scratch.put(_open(near, scratch))
    live = _met_in_prefix(left, sets, scratch, percent)
    more = scratch.put(_compared(live, sets, scratch, percent))
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)
    for used in (first, met, tried, sets, links, placed, still, near, left, live, more):  # what the result still reads stays
        scratch.drop(used)
    return (
        signed.select("id", "n", "digest").join(classes.select(F.col("digest").alias("of"), "rep"), F.col("digest") == F.col("of"), "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .withColumn("component_id", F.coalesce("component", "rep", "id"))
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(owner, own): how many of a document's shingles no other of these documents has; without a row, none."""
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    single = each.groupBy("shingle").agg(F.min("id").alias("owner"), F.max("id").alias("other")).filter("owner = other")
    return single.groupBy("owner").agg(F.count("*").alias("own"))


def _open(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets that hold several parts; placed is a written table. Rows are not dealt by bucket but where AQE can split a hot one."""
    several = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("bucket")
    return placed.join(checked(scratch.put(several)), "bucket", "left_semi")


def _met_in_prefix(left: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(bucket, rep, n, part) of the documents that share one of their rarest shingles with another part; the bucket is that shingle.

    A set of n shingles that is similar enough to one of at least its size shares at least
    2 * percent * n / (100 + percent) of them, and percent * n / 100 with any set. In an order of all
    shingles, here the rarest first, the smaller set's first ones beyond that number and the
    larger set's first ones beyond its own have a shingle in common, so no link is lost. What
    all documents share is not among the few first ones, unless they are linked by it. A
    shingle's parts are summed up as their least and largest, so its documents don't meet in pairs.
    """
    texts = sets.join(left.groupBy("rep").agg(F.min("part").alias("part")), F.col("id") == F.col("rep")).select("rep", "part", "shingles")
    # A key may have several texts, each a set of its own.
    each = texts.select("rep", "part", F.xxhash64("shingles").alias("of"), F.size("shingles").alias("n"), F.explode("shingles").alias("bucket")).distinct()
    each = scratch.put(each)
    often = scratch.put(each.groupBy("bucket").agg(F.count("*").alias("often"), F.min("part").alias("p"), F.max("part").alias("q")))
    at = F.row_number().over(Window.partitionBy("rep", "of").orderBy("often", "bucket")) - 1
    first = each.join(often, "bucket").withColumn("at", at).filter(100 * F.col("at") <= (100 - percent) * F.col("n")).filter("p < q")
    first = scratch.put(first.select("bucket", "rep", "part", "n", ((100 + percent) * F.col("at") <= (100 - percent) * F.col("n")).alias("short")))
    short = F.when(F.col("short"), F.col("part"))
    parts = first.groupBy("bucket").agg(F.min(short).alias("p"), F.max(short).alias("q"), F.min("part").alias("any_p"), F.max("part").alias("any_q")).filter("p is not null and any_p < any_q")
    other = ((F.col("p") != F.col("part")) | (F.col("q") != F.col("part"))) | (F.col("short") & ((F.col("any_p") != F.col("part")) | (F.col("any_q") != F.col("part"))))
    live = scratch.put(first.join(checked(scratch.put(parts)), "bucket").filter(other).select("bucket", "rep", F.col("n").cast("long").alias("n"), "part"))
    for used in (each, often, first):
        scratch.drop(used)
    return live


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between documents of different parts, from counts of shared shingles."""
        ids, parts = np.asarray(table["rep"]), np.asarray(table["part"])
        sets = _arrays(table["shingles"].combine_chunks())
        sizes = np.array([len(s) for s in sets])
        values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(sets)), sizes), counts[where] > 1
        column = (np.cumsum(counts > 1) - 1)[where][shared]
        row = row[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # so many shingles at a time
            lo, hi = np.searchsorted(column, (a, a + 4096))
            held = np.zeros((len(sets), 4096), np.float32)
            held[row[lo:hi], column[lo:hi] - a] = 1
            both += held @ held.T
        linked = (100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & (parts[:, None] != parts[None]) & (ids[:, None] < ids[None])
        a, b = np.nonzero(linked)
        return pa.table([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

    return run


def _compared(live: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b) of the links between different parts within clusters of documents that buckets connect.

    live: bucket, rep, n, part. A cluster's largest part is cut into blocks, and so is the rest; each
    block of the rest meets every block in a task of its own. Blocks are bounded in documents and
    on average in shingles, of which the sorted hashes are sent.
    """
    lead = checked(scratch.put(live.groupBy("bucket").agg(F.min("rep").alias("a"))))
    clusters = components(live.join(lead, "bucket").select("a", F.col("rep").alias("b")), scratch)
    docs = live.groupBy("rep", "part").agg(F.max("n").alias("n")).join(clusters, F.col("rep") == F.col("node"), "left").select("rep", "part", "n", F.coalesce("component", "rep").alias("cluster"))
    docs = scratch.put(docs)
    sizes = docs.groupBy("cluster", "part").agg(F.struct(F.count("*").alias("docs"), F.sum("n").alias("shingles")).alias("s"))
    blocks = lambda n, shingles: F.ceil(F.greatest(n / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    plan = sizes.groupBy(F.col("cluster").alias("of")).agg(F.max(F.struct("s", "part")).alias("top"), F.sum("s.docs").alias("docs"), F.sum("s.shingles").alias("shingles")).select(
        "of", F.col("top.part").alias("largest"), blocks(F.col("docs") - F.col("top.s.docs"), F.col("shingles") - F.col("top.s.shingles")).alias("rest_blocks"), blocks(F.col("top.s.docs"), F.col("top.s.shingles")).alias("top_blocks")
    )
    spot = F.when(F.col("part") == F.col("largest"), F.col("rest_blocks") + F.pmod(F.xxhash64("rep"), F.col("top_blocks"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest_blocks"))).cast("int")
    dealt = docs.join(plan, F.col("cluster") == F.col("of")).filter("rest_blocks > 0").withColumn("block", spot)
    # Tasks are pairs of blocks i <= j with i in the rest.
    i = F.sequence(F.lit(0), F.least(F.col("block"), F.col("rest_blocks") - 1))
    first = F.transform(i, lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
    j = F.filter(F.sequence(F.lit(0), F.col("rest_blocks") + F.col("top_blocks") - 1), lambda x: (x > F.col("block")) & (F.col("block") < F.col("rest_blocks")))
    second = F.transform(j, lambda x: F.struct(F.col("block").alias("i"), x.alias("j")))
    sent = dealt.join(sets, F.col("rep") == F.col("id")).select("cluster", "rep", "part", "shingles", F.explode(F.concat(first, second)).alias("t"))
    return sent.select("cluster", "t.i", "t.j", "rep", "part", "shingles").groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    both = pairs.join(other, "b").join(one, "a").select("a", "set_a", "b", "set_b")
    return both.mapInArrow(_similar(percent), "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the document of the smallest key of each component, with all columns, whatever their names.

    Rows with one key are one document. Those of them with the same words, A-Z lower-cased, are
    copies, of which the first by text and then by all columns stays; rows with other words stay,
    as nothing else holds them. Null and empty texts have no copies under other keys. Rows
    without a key can't be named by a component and stay. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    kept = scratch.put(near_duplicates(docs, key, text, **how).filter("kept").groupBy(F.col(key).alias("id")).agg(F.count("*").alias("rows")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("t"))
    keyed = lambda which: rows.join(kept.filter(which).select("id").hint("shuffle_hash"), F.col("key") == F.col("id"), "left_semi")
    out = keyed("rows = 1").select("row").unionByName(rows.filter("key is null").select("row"))
    if kept.filter("rows > 1").limit(1).count():
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        same = F.md5(F.array_join(words(F.translate("t", upper, lower)), " ").cast("binary"))
        one = F.min_by("row", F.struct("t", F.to_json("row"))).alias("row")
        out = out.unionByName(keyed("rows > 1").groupBy("key", same.alias("same")).agg(one).select("row"))
    return out.select("row.*")
