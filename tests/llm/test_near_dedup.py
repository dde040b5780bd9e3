import random
from collections import defaultdict

import numpy as np
import pytest

from sluice.llm import near_dedup as N
from sluice.llm.catalog import QUERIES


def brute_classes(rows):
    """Connected components over all pairs of distinct texts: {row number: smallest id}."""
    s = N.Shingler()
    texts = sorted({t or "" for _, t in rows})
    sets = {t: s.elements(t.encode()) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    by_element = defaultdict(list)
    for t in texts:
        for e in sets[t][0].tolist():
            by_element[e].append(t)
    for a in texts:
        for b in {b for e in sets[a][0].tolist() for b in by_element[e]}:
            if a < b and N.similarity(sets[a], sets[b]) >= N.SIMILARITY:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, t in rows:
        ids[find(t or "")].append(i)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(i, name[find(t or "")], len(ids[find(t or "")])) for i, t in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_signature_agreement_estimates_similarity():
    rng = random.Random(3)
    s = N.Shingler()
    est, true = [], []
    for _ in range(60):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([8, 60, 900]))]
        other = [w if rng.random() > 0.02 else "x" + w for w in words] + words[:rng.randrange(6)]
        a, b = s.elements(" ".join(words).encode()), s.elements(" ".join(other).encode())
        sig = N.signatures([a, b])
        assert not (sig == N._EMPTY).any()
        est.append((sig[0] == sig[1]).mean())
        true.append(N.similarity(a, b))
    assert abs(np.mean(est) - np.mean(true)) < 0.02
    assert np.abs(np.array(est) - np.array(true)).max() < 0.2


def test_signature_does_not_depend_on_the_batch():
    s = N.Shingler()
    texts = [b"one", b"a b c d e f g h", b" ".join(b"%d" % i for i in range(3000)), b"", b"x x x x x x x x"]
    sets = [s.elements(t) for t in texts]
    whole = N.signatures(sets)
    for i, one in enumerate(sets):
        assert (N.signatures([one])[0] == whole[i]).all()


def test_sketches_do_not_exclude_pairs_at_the_threshold():
    rng = random.Random(8)
    s = N.Shingler()
    sets = []
    for _ in range(300):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(0, 195, 5), 4):
            other[at] = "x"
        sets += [s.elements(" ".join(w).encode()) for w in (base, other)]
    assert min(N.similarity(a, b) for a, b in zip(sets[::2], sets[1::2])) >= 0.8
    marks = N.sketches(N.signatures(sets)).view(np.uint64)
    differ = np.bitwise_count(marks[::2] ^ marks[1::2]).sum(axis=1)
    assert differ.max() <= N.SKETCH_DIFFER


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def test_classes_match_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(120)]
        texts += family(rng, base, 12, rng.choice([1, 2, 3, 5]))
    # a family around a text of which copies with many edits are near each other only
    core = [f"k{i}" for i in range(150)]
    for _ in range(5):
        texts += family(rng, family(rng, core, 1, 7)[0].split(), 6, 1)
    texts += family(rng, core, 30, 4) + [" ".join(core)]
    # a chain: each text is near its neighbour only
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i * 10:i * 10 + 100]) for i in range(10)]
    texts += ["same words here"] * 4 + ["", "", None, "tiny", "tiny", "a b c d", "loop " * 500, "loop " * 700]
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, "tiny"), (None, "lonely null id"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.class_table(df).collect()), key=key)
    assert got == sorted(brute_classes(rows), key=key)


def test_deduplicate_keeps_one_row_of_each_class(spark):
    rows = [(2, "a b c d e f", "z"), (1, "a b c d e f", "y"), (1, "a b c d e f", "x"), (None, "a b c d e f", "n"),
            (7, "other words entirely", "q"), (None, None, "e"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((tuple(r) for r in N.deduplicate(df).collect()), key=lambda r: r[0])
    assert got == [(1, "a b c d e f", "x"), (7, "other words entirely", "q"), (8, "", "e")]
    assert N.deduplicate(df.limit(0)).collect() == []


def test_connect_long_path_and_star(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 300)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], n) for n in names[201:]]
    labels, _ = N.connect(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["root"] for r in labels.collect()}
    assert {got[n] for n in names[:151]} == {min(names[:151])}
    assert {got[n] for n in names[200:]} == {min(names[200:])}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op4_dart_minhash_classes"](spark, sf).collect())
    assert got == sorted(brute_classes(rows))


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(5, "hello")][:n], "doc_id long, text string")
    assert [tuple(r) for r in N.class_table(df).collect()] == [(5, 5, 1)][:n]


def test_a_text_is_known_by_128_bits(spark):
    import hashlib

    from sluice.llm.near_dedup import near_classes
    texts = [None, "", "one text of more than five words here", "another text of more than five words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["node"] for r in near_classes(df).collect()}
    assert got == {i: hashlib.md5((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
