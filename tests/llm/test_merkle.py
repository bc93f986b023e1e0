"""The Merkle manifest against a tree built by the contract's letter."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from townmeter.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    return [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]


def climb(nodes, at):
    """Root of some nodes and the (before, after) of one of them."""
    path = []
    while len(nodes) > 1:
        first = at // 8 * 8
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        nodes, at = up(nodes), at // 8
    return nodes[0], path


def brute(rows, tamper=True):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        langs[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    leaves = {g: [leaf(r) for r in langs[g]] for g in order}
    subroots = [climb(leaves[g], 0)[0] for g in order]
    root, out = climb(subroots, 0)[0], []
    for at_g, g in enumerate(order):
        for at, row in enumerate(langs[g]):
            path = climb(leaves[g], at)[1] + climb(subroots, at_g)[1]
            other = row
            if tamper and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                other = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            folded = leaf(other)
            for before, after in path:
                folded = h(before, folded, after)
            out.append((row[0], leaves[g][at], subroots[at_g], root, h(*(x for p in path for x in p)), folded, folded == root))
    return sorted(out, key=repr)


def tampered():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}


def found(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS).collect()]
    want = brute(rows)
    assert {r[6] for r in want} == {True, False}
    assert found(queries.op12_merkle(spark, sf_dir)) == want


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n, per_lang", [(1, 1), (8, 8), (9, 9), (64, 64), (65, 65), (700, 513), (3, 1)])
def test_sizes(spark, n, per_lang):
    rows = [(i * 7, "s", f"l{i // per_lang}", i, f"Text {i}") for i in range(n)]
    assert found(merkle.manifest(table(spark, rows), altered=tampered())) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "", None, 0, ""), (3, "-", "-", -1, "-"), (3, "-", "-", -1, "-"), (3, "a", "-", 5, "B"), (3, "a1:b", "é", 5, "1:B"),
        (4, "a", "Z", 1, "ÀÉ Straße" * 50000), (5, "a", "", None, "A" * 3), (6, None, "é", None, None), *[(7, "copy", "hot", 1, "Same Text")] * 150,
    ]
    out = found(merkle.manifest(table(spark, rows), altered=tampered()))
    assert out == brute(rows)
    clash = table(spark, rows).select("*", F.lit(1).alias("leaf"), F.lit(2).alias("k"), F.lit(3).alias("g"), F.lit("x").alias("seq"))
    assert found(merkle.manifest(clash, altered=tampered())) == out
    assert found(merkle.manifest(table(spark, []))) == []


def test_unaltered_rows_verify_and_proofs_are_real(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, f"t{i}") for i in range(300)]
    df = merkle.manifest(table(spark, rows), give_proofs=True)
    assert df.select(F.bool_and("verified").alias("a"), F.bool_and(merkle.proves(F.col("leaf"), F.col("proof"), F.col("root"))).alias("b")).first() == (True, True)
    assert df.select(F.bool_or(merkle.proves(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof"), F.col("root"))).alias("a")).first() == (False,)
    assert found(df) == brute(rows, tamper=False)


@pytest.mark.parametrize("levels, top", [(1, 10**6), (2, 1), (1, 3)])
def test_any_height_of_blocks_gives_one_tree(spark, monkeypatch, levels, top):
    rows = [(i, "s", "en" if i % 5 else "de", i, f"t{i}") for i in range(650)]
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "TOP_NODES", top)
    assert found(merkle.manifest(table(spark, rows), altered=tampered())) == brute(rows)


def test_too_many_groups_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_GROUPS", 5)
    monkeypatch.setattr(merkle, "TOP_NODES", 2)
    with pytest.raises(ValueError, match="groups"):
        merkle.manifest(table(spark, [(i, "s", f"l{i}", i, "t") for i in range(9)]))


def test_key_of_another_type(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None)], "name string, body string")
    out = {r.name: r for r in merkle.manifest(df, ("name", "body"), "name", "body").collect()}
    assert out["a"].leaf == h("1:a", "-") and out["b"].root == h(h("1:a", "-"), h("1:b", "1:x"))
