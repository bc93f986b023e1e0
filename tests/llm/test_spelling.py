"""Spelling variants against brute force over whole texts."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from townmeter.llm import queries, spelling
from townmeter.llm.common import Scratch

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows):
    """The words of (key, text) rows with their numbers, by the contract's letter."""
    upper, found = {65 + i: 97 + i for i in range(26)}, Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def edits(a, b):
    """Levenshtein distance."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def brute(n):
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :], i].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(rows))
    assert len(want) > 1000 and any(form for _, form, *_ in want) and any(root != (form or w) for w, form, root, *_ in want)
    assert found(queries.op11_spelling(spark, sf_dir)) == want


def test_odd_rows(spark):
    rows = [(1, None), (None, "letter letter letter"), (2, ""), (3, "12 ?!"), (4, "Letter lettre. LETTER, lettér"), (5, "lettér lettér"), (5, "lettér lettér"), (6, "ÉTÉS étés étésé étésé étésé Étésé Étésé Étésé")]
    out = found(spelling.spelling_variants(table(spark, rows)))
    assert out == brute(counted(rows)) and {"letter", "lettér", "étésé"} <= {r[0] for r in out}
    assert found(spelling.spelling_variants(table(spark, []))) == []
    clash = table(spark, [(r, t, 1, "x", 2) for r, t in rows], "doc_id long, text string, word int, n string, key int")
    assert found(spelling.spelling_variants(clash)) == out


def test_errors_of_the_hash(spark):
    rows = [(i, "something anything") for i in range(400)]
    out = found(spelling.spelling_variants(table(spark, rows)))
    assert out == brute(counted(rows))
    assert sum(r[3] for r in out if r[0] in ("something", "anything")) < 800


def test_very_long_text_and_word(spark):
    long = "a" * 3000 + "bcdef" * 200
    rows = [(1, "spelling speling spelling " * 40000), (2, f"{long} {long} {long} {long}x {long}x {long}x")]
    assert found(spelling.spelling_variants(table(spark, rows))) == brute(counted(rows))


def pairs(words):
    return sorted((a, b) for a in words for b in words if edits(a, b) == 1)


def met(spark, words):
    scratch = Scratch(spark)
    near = spelling.near_words(scratch.put(spark.createDataFrame([(w, 3) for w in words], "word string, n long")), scratch)
    return sorted((r.word, r.other) for r in near.collect())


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    import random

    draw = random.Random(3)
    words = sorted({"".join(draw.choices("ab", k=draw.randint(5, 9))) for _ in range(400)})
    whole = met(spark, words)
    assert whole == pairs(words)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert met(spark, words) == whole


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abcé", min_size=5, max_size=9), max_size=40))
def test_index_meets_every_pair(words):
    count = Counter(g for w in words for g in set(spelling.grams(w)))
    rank = {g: i for i, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}
    buckets = defaultdict(list)
    for w in sorted(words):
        for key, own in spelling.keys_of(w, rank):
            buckets[key].append((w, own, 0))
    got = {(b[i][0], b[j][0]) for b in buckets.values() for i, j in spelling.near_pairs(b, False)}
    assert sorted(got | {(b, a) for a, b in got}) == pairs(words)


@pytest.mark.parametrize("a, b, near", [("abcde", "abcde", False), ("abcde", "abcd", True), ("abcde", "bacde", False), ("aaaaa", "aaaaaa", True), ("abcde", "xbcde", True), ("abcde", "abc", False), ("abcde", "xabcdey", False)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) is near and spelling.one_edit(b, a) is near
