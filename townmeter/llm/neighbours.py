"""Approximate nearest neighbours by an adaptive scan of rotated dimensions within probed lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch

#: Vectors that centroids, the largest norm's stand-in and first bounds are fitted on: a bounded sample by a hash of the vector.
SAMPLE = 8_000
#: Centroids: the square root of the vectors, within these limits.
LISTS = (16, 1_024)
#: Share of the lists that a query probes, and the fewest.
PROBED, LEAST_PROBED = 0.75, 12
#: Rotated dimensions in a column block.
BLOCK = 16
#: The test's slack: larger abandons fewer vectors that belong to the result.
SLACK = 2.1
#: Vectors of lists, or of a part of a large list, that a group has at most, and queries that a task takes in at a time; a table is cut into GROUPS groups or more, of LEAST_ROWS vectors at least.
ROWS, QUERIES = 8_192, 2_048
GROUPS, LEAST_ROWS = 64, 512


def _rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with one more dimension that makes all norms `largest`, so that the largest inner products are the least distances."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, largest**2 - (x * x).sum(1)))[:, None]])


def _fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids of a bounded sample."""
    rng = np.random.default_rng(11)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * sample @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        held = np.bincount(near, minlength=len(centres))
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def scan(blocks: list[np.ndarray], query: np.ndarray, rows: np.ndarray, bound: float, k: int) -> np.ndarray:
    """Those of the rows that the adaptive scan does not abandon.

    blocks: the rotated vectors in blocks of columns. Column block after column block, the squared
    distance over the dimensions seen so far is a candidate's estimate; it is abandoned when the
    estimate is over the bound of the k-th result by more than SLACK / sqrt(dimensions seen).
    Distances of those that are left are exact and lower the bound for the next rows.
    """
    width, kept, held = len(query), [], np.zeros(0)
    for at in range(0, len(rows), 1024):
        alive, partial, seen = rows[at : at + 1024], 0.0, 0
        for block in blocks:
            piece = query[seen : seen + block.shape[1]]
            diff = block[alive] - piece
            partial = partial + np.einsum("ij,ij->i", diff, diff)
            seen += len(piece)
            stays = partial <= bound * (seen / width) * (1 + SLACK / np.sqrt(seen)) ** 2 if seen < width else partial <= bound * (1 + 1e-9) + 1e-12
            alive, partial = alive[stays], partial[stays]
            if not len(alive):
                break
        if len(alive):
            kept.append(alive)
            held = np.concatenate([held, partial])
            if len(held) > k:
                bound = min(bound, np.partition(held, k)[k])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _best(base: np.ndarray, reps: np.ndarray, query: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, scores) of the k + 1 largest inner products; products are added from the first dimension on, whoever shares the task."""
    rough = base[found] @ query
    if len(found) > k + 1:
        cut = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
        found = found[rough >= cut - 1e-9 * (1 + abs(cut))]
    score = np.cumsum(base[found] * query, axis=1)[:, -1]
    order = np.lexsort((reps[found], -score))[: k + 1]
    return reps[found][order], score[order]


def _packed(sizes: np.ndarray, rows: int) -> list[tuple[int, int, int]]:
    """(list, first group, parts): lists that follow one another share a group of about so many rows, a larger list has several of its own."""
    out, group, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            group, held = group + 1, 0
        parts = max(1, -(-n // rows))
        out.append((i, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


def dealt(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(group, asks, id, v, list, bound, lists): each vector of the groups that are probed once, asks 0, and each query once for each group that it probes, asks 1."""
    asked = probes.select(F.explode("probes").alias("p"), "query", "q", "bound").select(F.col("p.group").alias("group"), F.lit(1).alias("asks"), F.col("query").alias("id"), F.col("q").alias("v"), F.lit(None).cast("int").alias("list"), "bound", "p.lists")
    needed = F.broadcast(asked.select("group").distinct())  # as many as there are groups
    own = index.join(needed, "group", "left_semi").select("group", F.lit(0).alias("asks"), F.col("rep").alias("id"), "v", "list", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("array<int>").alias("lists"))
    return own.unionByName(asked)


def search(vectors: DataFrame, every: int, k: int = 20, key: str = "vec_id", column: str = "embedding", probed: float = PROBED) -> DataFrame:
    """The k nearest rows to each row whose key is divisible by `every`: query_id, rank, key, score.

    Nearest: largest inner product in double precision on the original vectors, ties to the
    smaller key; the query's own row takes no part. Rows whose key or vector is null, whose vector
    is zero, holds null or non-finite components, or has another length than most rows (ties: the
    longer) take no part. Equal vectors are scanned once; each stands for its k + 1 smallest keys,
    which is all that a result can hold. Rows with equal key and vector are one row. An empty
    table gives an empty one; other columns are ignored.

    Centroids and first bounds come from a sample of SAMPLE vectors; every vector is put into its
    list, and lists are packed into groups of about ROWS rows, a large list into several. A query
    probes a share of the lists, nearest first, and further ones until they hold k + 1 vectors;
    those whose every vector lies beyond the query's first bound, by distance to the centroid less
    the list's radius, are passed over. All candidates come from these scans. First bounds are
    taken from those of the sample that lie in the probed lists; queries that are left with too
    few candidates, as the test abandoned some, scan every list without a bound. A query is sent
    once to each group that it needs. A task holds the vectors of a group, of which each is sent
    once, and scans queries against them as they come, however many there are.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    none = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(sound)
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return none
    width = widths[0].width
    rows = rows.filter(F.size("v") == width)
    # The k + 1 smallest keys of each different vector, first within parts of a hot one.
    mark = F.struct(F.xxhash64("v"), F.xxhash64(F.reverse("v")))
    small = rows.select("id", mark.alias("mark"), F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt"))
    for parts in (["mark", "salt"], ["mark"]):
        small = small.withColumn("at", F.row_number().over(Window.partitionBy(*parts).orderBy("id"))).filter(F.col("at") <= k + 1).drop("at")
    groups = scratch.put(small.groupBy("mark").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    unique = scratch.put(rows.groupBy(mark.alias("mark")).agg(F.min("id").alias("rep"), F.first("v").alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    n, largest = unique.agg(F.count("*"), F.max("norm2")).first()
    lists = int(min(max(n**0.5, LISTS[0]), LISTS[1], n))
    largest = float(np.sqrt(largest))
    few = unique.select("v", F.xxhash64("v").alias("h"), "rep").orderBy("h", "rep").limit(SAMPLE).collect()
    turn = _rotation(width + 1)
    sample = _augmented(np.array([r.v for r in few], np.float64), largest) @ turn
    centres = _fit(sample, lists)
    wide = max(LEAST_PROBED, int(np.ceil(probed * lists)))
    lists_of = lambda x, centres: ((centres**2).sum(1)[None] - 2 * x @ centres.T)
    shared = spark.sparkContext.broadcast((centres, sample, lists_of(sample, centres).argmin(1), turn))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, _, turn = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                x = _augmented(_matrix(b.column(1), width), largest) @ turn
                near = lists_of(x, centres).argmin(1)
                far = np.sqrt(((x - centres[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(far), b.column(1)], ["rep", "list", "far", "v"])

    index = scratch.put(unique.select("rep", "v").mapInArrow(placed, "rep long, list int, far double, v array<double>"))
    sizes, radius = np.zeros(lists, np.int64), np.zeros(lists)
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # LISTS[1] rows at most
        sizes[r.list], radius[r.list] = r.n, r.far
    packed = _packed(sizes, int(min(ROWS, max(LEAST_ROWS, n // GROUPS))))
    groups_of = spark.createDataFrame(packed, "list int, first int, parts int")
    index = index.join(F.broadcast(groups_of), "list").withColumn("group", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def sent_to(taken: list[int]) -> list[dict]:
        """The groups that hold lists, each with its own, in their order."""
        out: dict[int, list[int]] = {}
        for i in taken:
            for g in range(packed[i][1], packed[i][1] + packed[i][2]):
                out.setdefault(g, []).append(i)
        return [{"group": g, "lists": own} for g, own in out.items()]

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sample, home, turn = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                q = _matrix(b.column(1), width)
                x = np.hstack([q, np.zeros((len(q), 1))]) @ turn
                order = lists_of(x, centres)
                near = np.argsort(order, axis=1, kind="stable")
                # Further lists follow until those probed hold k + 1 vectors.
                enough = (np.cumsum(sizes[near], axis=1) <= k).sum(1) + 1
                taken = np.arange(near.shape[1])[None] < np.maximum(enough, wide)[:, None]
                in_reach = np.zeros(near.shape, bool)
                np.put_along_axis(in_reach, near, taken, 1)
                norms = (x * x).sum(1)[:, None]
                far = np.where(in_reach[:, home], norms + (sample * sample).sum(1)[None] - 2 * x @ sample.T, np.inf)
                bound = np.partition(far, k, axis=1)[:, k] if len(sample) > k else np.full(len(x), np.inf)
                gap = np.sqrt(np.maximum(0.0, order + norms)) - radius[None]
                in_reach &= gap <= np.sqrt(np.maximum(0.0, bound))[:, None] * (1 + 1e-9) + 1e-9
                probes = [sent_to([j for j in row.tolist() if hit[j]]) for row, hit in zip(near, in_reach, strict=True)]
                kind = pa.list_(pa.struct([("group", pa.int32()), ("lists", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bound), b.column(1), pa.array(probes, kind)], ["query", "bound", "q", "probes"])

    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), mark.alias("mark"))
    asked = scratch.put(asked.join(groups.select(F.col("mark").alias("m"), F.col("ids")[0].alias("query")), F.col("mark") == F.col("m")).select("query_id", "query").distinct())
    queries = scratch.put(unique.join(asked.select("query").distinct(), F.col("rep") == F.col("query"), "left_semi").select("rep", "v"))
    kind = "query long, bound double, q array<double>, probes array<struct<group:int,lists:array<int>>>"
    probes = scratch.put(queries.mapInArrow(probing, kind))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group's vectors come first and stay; its queries are scanned against them as they come."""
        turn, held, parts, ready = shared.value[3], None, [], None
        for batch in batches:
            group, asks = np.asarray(batch["group"]), np.asarray(batch["asks"])
            cuts = [0, *(np.flatnonzero(np.diff(group.astype(np.int64) * 2 + asks)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if group[a] != held:
                    held, parts, ready = group[a], [], None
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append(piece)
                    continue
                if not parts:
                    continue
                if ready is None:
                    x = pa.Table.from_batches(parts).sort_by("list")
                    base = _matrix(x["v"].combine_chunks(), width)
                    turned = _augmented(base, largest) @ turn
                    ready = base, np.asarray(x["id"]), np.asarray(x["list"]), [np.ascontiguousarray(turned[:, c : c + BLOCK]) for c in range(0, width + 1, BLOCK)]
                base, reps, home, blocks = ready
                for first in range(0, len(piece), QUERIES):
                    some = piece.slice(first, QUERIES)
                    out: tuple[list, list, list] = ([], [], [])
                    ids, q = np.asarray(some["id"]), _matrix(some["v"], width)
                    turned_q = np.hstack([q, np.zeros((len(q), 1))]) @ turn
                    for i, (bound, own) in enumerate(zip(np.asarray(some["bound"]), some["lists"].to_pylist(), strict=True)):
                        ends = np.searchsorted(home, own, "left"), np.searchsorted(home, own, "right")
                        at = np.concatenate([np.arange(c, d) for c, d in zip(*ends, strict=True)])
                        found, score = _best(base, reps, q[i], scan(blocks, turned_q[i], at, bound, k), k)
                        out[0].extend([ids[i]] * len(found))
                        out[1].extend(found)
                        out[2].extend(score)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query", "rep", "score"])

    def candidates(probes: DataFrame) -> DataFrame:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return dealt(index, probes).repartition(tasks, "group").sortWithinPartitions("group", "asks").mapInArrow(scanned, "query long, rep long, score double")

    near = scratch.put(candidates(probes))
    enough = near.groupBy("query").count().filter(F.col("count") >= min(k + 1, n)).select("query")
    short = queries.join(enough, F.col("rep") == F.col("query"), "left_anti")
    every_list = F.broadcast(spark.createDataFrame([(sent_to(list(range(lists))),)], "probes array<struct<group:int,lists:array<int>>>"))  # one row
    everywhere = short.select(F.col("rep").alias("query"), F.lit(float("inf")).alias("bound"), F.col("v").alias("q")).crossJoin(every_list)
    again = scratch.put(everywhere)
    if again.limit(1).count():
        near = near.unionByName(candidates(again)).groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("at") <= k + 1)
    # A query's vector stands for all queries that have it; a result's vector for its keys.
    rows = (
        asked.join(best, "query").join(groups.select(F.col("ids")[0].alias("rep"), "ids"), "rep")
        .select("query_id", F.explode("ids").alias(key), "score").filter(F.col("query_id") != F.col(key))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
