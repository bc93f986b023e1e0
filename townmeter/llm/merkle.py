"""A Merkle manifest of a table: digests of rows, a subroot per group, a root, and a proof and fold for each row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from hashlib import sha256
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, checked

#: Children of a node, as a power of two.
FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Levels that a task reduces at least: a block of FAN ** LEVELS leaves becomes one node.
LEVELS = 4
#: Nodes that the blocks leave to the driver, besides one for each group; more rows give higher blocks. 64 bytes each.
TOP_NODES = 50_000
#: Groups, such as languages, whose subroots the driver holds; more are an error.
MOST_GROUPS = 1_000_000
#: Hexadecimal digits of a digest.
WIDTH = 64

Level = list[bytes]


def digest(data: bytes) -> bytes:
    """Lowercase hexadecimal sha256."""
    return sha256(data).hexdigest().encode()


def _field(value: Column) -> Column:
    """`-` for a null, else UTF-8 bytes, a colon and the value; so no two rows give one sequence."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row: the digest of its values in the order given."""
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def proves(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether a leaf and its proof, an array of (before, after), fold to the root."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256)) == root


def tree(nodes: Sequence[bytes], height: int | None = None) -> list[Level]:
    """The levels above some nodes, themselves first, until one node is left or height levels are made."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        last = levels[-1]
        levels.append([digest(b"".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def path_of(levels: list[Level], at: int) -> list[tuple[bytes, bytes]]:
    """(before, after) of node `at` of the first level on every level that has another above: its siblings on both sides."""
    path = []
    for level in levels[:-1]:
        first = at - at % FAN
        path.append((b"".join(level[first:at]), b"".join(level[at + 1 : first + FAN])))
        at //= FAN
    return path


def height_of(total: int, most: int) -> int:
    """Levels that a block of a group of `total` leaves is reduced by, `most` at most; a group of one block reaches its subroot."""
    height = 0
    while total > 1 and height < most:
        total, height = -(-total // FAN), height + 1
    return height


class Top:
    """The small upper tree: nodes of blocks by group in order, subroots by group, the root."""

    def __init__(self, nodes: Mapping[str | None, Sequence[bytes]]):
        order = sorted(nodes, key=lambda g: (g is not None, (g or "").encode()))
        self.levels = {g: tree(nodes[g]) for g in order}
        self.place = {g: i for i, g in enumerate(order)}
        self.above = tree([self.levels[g][-1][0] for g in order])
        self.root = self.above[-1][0]

    def suffix(self, group: str | None, block: int) -> tuple[bytes, list[tuple[bytes, bytes]]]:
        """A group's subroot, and the path from one of its blocks to the root."""
        levels = self.levels[group]
        return levels[-1][0], path_of(levels, block) + path_of(self.above, self.place[group])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[tuple]]]:
    """Group, block and rows of each block; rows are (group, block, pos, total, leaf, ...) in this order."""
    for (group, block), rows in groupby(_rows(batches), key=lambda r: r[:2]):
        yield group, block, list(rows)


def _reduce(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, rows in _blocks(batches):
            top = tree([r[4].encode() for r in rows], height_of(rows[0][3], height))[-1]
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([block], pa.int64()), pa.array([top[0].decode()], pa.string())], ["g", "block", "node"])

    return run


_PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_OUT = (("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("position", pa.int64()))


def _finish(height: int, shared, give_proofs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        top: Top = shared.value
        root = top.root.decode()
        kinds = (("k", first.schema.field("k").type),) + _OUT + ((("proof", _PROOF),) if give_proofs else ())
        out: list[list] = [[] for _ in kinds]

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds)], [n for n, _ in kinds])
            for c in out:
                c.clear()
            return made

        for group, block, rows in _blocks(chain([first], batches)):
            levels = tree([r[4].encode() for r in rows], height_of(rows[0][3], height))
            subroot, suffix = top.suffix(group, block)
            subroot = subroot.decode()
            path: list[tuple[bytes, bytes]] = []
            for at, (_, _, pos, _, leaf, other, key) in enumerate(rows):
                if at % FAN == 0:  # from the parent on, a run's leaves share their path
                    path = (path_of(levels[1:], at // FAN) if len(levels) > 1 else []) + suffix
                own = path_of(levels[:2], at) + path if len(levels) > 1 else path
                proof = digest(b"".join(x for pair in own for x in pair)).decode()
                folded = (leaf if other is None else other).encode()
                for before, after in own:
                    folded = digest(before + folded + after)
                folded = folded.decode()
                values = [key, leaf, subroot, root, proof, folded, folded == root, pos]
                if give_proofs:
                    values.append([{"before": a.decode(), "after": b.decode()} for a, b in own])
                for column, value in zip(out, values):
                    column.append(value)
                if len(out[0]) >= 2000:
                    yield flush()
        yield flush()

    return run


def _placed(rows: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """rows (g, k, leaf, seq, ...) with pos, a row's place in its group by k, leaf and seq, and total, the group's rows.

    Rows are dealt by ranges of the whole order, so neither a hot group nor a hot key, nor equal
    rows, are one task; the numbers of a group's rows in each range, at most ranges + groups
    rows, give the places.
    """
    order = [F.col("g").asc_nulls_first(), F.col("k").asc_nulls_first(), F.col("leaf"), F.col("seq")]
    ranged = scratch.put(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = ranged.groupBy("part", "g").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = scratch.put(runs.select(F.col("part").alias("r_part"), F.col("g").alias("r_g"), (before - F.col("first")).alias("shift"), F.sum("held").over(own).alias("total")))
    here = (F.col("part") == F.col("r_part")) & F.col("g").eqNullSafe(F.col("r_g"))
    return ranged.join(checked(runs), here).withColumn("pos", F.col("at") + F.col("shift"))


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang",
    altered: Mapping[str, Column] | None = None, give_proofs: bool = False,
) -> DataFrame:
    """One row per row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified, position, and proof if asked for.

    A leaf is the digest of a row's fields. A group's leaves ascend by key, null first; every FAN
    nodes become one until a subroot is left; subroots in the order of their groups, null first, become the root alike.
    proof: the siblings before and after on each level, and proof_sha256 their digest.
    folded_root is folded over the original siblings from the row's leaf, taken anew with the
    values of `altered`, if that names fields; verified tells whether it is the root. The
    manifest itself is of the rows as they are.

    Nulls are told from empty values. Rows of one key follow one another by their leaf, so equal
    rows have neighbouring places and proofs of their own. An empty table gives an empty one, a
    single row is its own subroot and root. Only the named fields are read, whatever other
    columns are called. Texts are hashed whole where they are read; from there on a row is a few
    digests. The key may be of any type that can be ordered.

    Tasks reduce blocks of at least FAN ** LEVELS leaves, and so high that TOP_NODES nodes are
    left besides one per group; the driver builds the tree above and broadcasts it, and tasks cut from it
    the suffix of each block's paths, finish the proofs and fold each row.
    """
    spark = docs.sparkSession
    scratch, tasks = Scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain, other = [F.col(f"`{f}`") for f in fields], F.lit(None).cast("string")
    if altered:
        changed = [altered.get(f, c) for f, c in zip(fields, plain)]
        same = F.lit(True)
        for f, c in zip(fields, plain):
            if f in altered:
                same = same & c.eqNullSafe(altered[f])
        other = F.when(~same, leaf_of(*changed))
    leaves = scratch.put(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{group}`").cast("string").alias("g"), leaf_of(*plain).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("seq")))
    placed = scratch.put(_placed(leaves, scratch, tasks).select("g", "pos", "total", "leaf", "other", "k"))
    rows, height = placed.count(), LEVELS
    while rows >> (FAN_BITS * height) > TOP_NODES:
        height += 1
    dealt = placed.withColumn("block", F.shiftright("pos", FAN_BITS * height)).select("g", "block", "pos", "total", "leaf", "other", "k").repartition(tasks, "g", "block").sortWithinPartitions("g", "block", "pos")
    nodes = scratch.put(dealt.select("g", "block", "pos", "total", "leaf").mapInArrow(_reduce(height), "g string, block long, node string"))
    if nodes.count() > TOP_NODES + MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups")
    found: dict[str | None, list[tuple[int, bytes]]] = {}
    for g, block, node in nodes.collect():
        found.setdefault(g, []).append((block, node.encode()))
    schema = f"k {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long" + ", proof array<struct<before:string,after:string>>" * give_proofs
    if not found:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    shared = spark.sparkContext.broadcast(Top({g: [node for _, node in sorted(x)] for g, x in found.items()}))
    return dealt.mapInArrow(_finish(height, shared, give_proofs), schema).withColumnRenamed("k", key)
