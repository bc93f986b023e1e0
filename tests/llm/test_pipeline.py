"""Every stage of the pipeline against brute force, on rows with nulls, empty texts, copies, repeated rows and clashing names."""

import hashlib
import random
import struct
from collections import Counter

import corpus_pipeline
import pytest
from townmeter.llm import mixing, near_duplicates, pii
from townmeter.llm.common import Scratch
from townmeter.llm.queries import vocabulary

from tests.llm.test_llm_operators import WORDS, brute_components, counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, `row` string, `key` string, t int, m double, limits string, node long, same string, taken long, `a.b` int"


def rows_of(texts):
    more = lambda i: (7, "r", "k", 1, 2.0, "l", 3, "s", 4, i)
    return [(i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], len(t or ""), *more(i)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = [None, "", " \n", "too short", "again and " * 60, *[prose(rng.randint(60, 90)) for _ in range(30)]]
    base = prose(100).split()
    texts += [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in (3, 40, 70)] + [texts[9], texts[9].upper()]
    texts += [prose(60) + " mail a.b@c.org or 10.1.2.3, IBAN GB82 WEST 1234 5698 7654 32", prose(3000) + " +1 (555) 123-4567"]
    found = rows_of(texts)
    key_less = (None, prose(70), "en", "s1", 1, *found[0][5:])
    other_text = (10, prose(70), "en", "s1", 1, *found[0][5:])
    return [*found, found[12], found[12], key_less, other_text]


def test_stages_equal_brute_force(spark, rows):
    from tokenizers import Tokenizer

    scratch = Scratch(spark)
    docs = scratch.put(spark.createDataFrame(rows, SCHEMA))
    good = scratch.put(corpus_pipeline.keep_good(spark, docs, ""))
    passes = lambda t: (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]
    as_rows = lambda df: Counter(tuple(r) for r in df.collect())
    assert good.columns == docs.columns and as_rows(good) == Counter(r for r in rows if passes(r[1]))

    one = scratch.put(corpus_pipeline.keep_one_of_each(spark, good, ""))
    kept = [tuple(r) for r in good.collect()]
    assert Counter(r[0] for r in kept)[10] == 2  # a key with two texts
    want = brute_components([(r[0], r[1]) for r in kept if r[0] is not None and r[1] != rows[-1][1]], 5, 80)
    stay = {r for r in kept if r[0] is None or want[r[0]][1] == r[0]}
    assert one.columns == docs.columns and as_rows(one) == Counter(stay) and len(stay) < len(kept) - 4

    masked = scratch.put(corpus_pipeline.mask_personal_data(spark, one, ""))
    new = lambda t: pii.masked(t, pii.spans(t)[1])
    assert as_rows(masked) == Counter((r[0], new(r[1]), *r[2:4], len(new(r[1])), *r[5:]) for r in stay)
    assert any("<EMAIL>" in r.text and "<IP>" in r.text and "<IBAN>" in r.text for r in masked.collect())

    mixed = scratch.put(corpus_pipeline.mix_sources(spark, masked, ""))
    times = {r.doc_id: 0 for r in masked.collect()}
    for r in mixing.mix(masked).collect():
        times[r.doc_id] += r.times
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(times) - Counter()
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in masked.collect()}

    library = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert as_rows(corpus_pipeline.encode(spark, mixed, "")) == want


def test_stages_of_nothing(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, empty, "").count() == 0


def test_texts_of_one_kept_key_stay(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choices(WORDS, k=40)) for _ in range(3))
    rows = [(5, a), (5, b), (5, a), (5, a.upper()), (6, b + " x"), (7, c), (None, a)]
    out = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == Counter([(5, a.upper()), (5, b), (7, c), (None, a)])


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from townmeter.sources import shared

    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)
