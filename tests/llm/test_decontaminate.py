import random
import unicodedata

import numpy as np
import pytest

from sluice.llm import decontaminate as D
from sluice.llm.catalog import QUERIES


def sellers(item, text):
    """Smallest edit distance of item to any run of words of text."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = [codes[w] for w in item]
    b = np.array([codes.get(w, -1) for w in text], dtype=np.int64)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a):
        nxt = np.empty_like(row)
        nxt[0] = i + 1
        nxt[1:] = np.minimum(row[:-1] + (b != w), row[1:] + 1)
        row = np.minimum.accumulate(nxt - steps) + steps
    return int(row.min())


def brute(docs, items, share=D.MAX_EDITS, min_words=D.MIN_WORDS):
    out = {}
    bags = [(i, D.words_of((t or "").encode())) for i, t in items]
    for n, (k, t) in enumerate(docs):
        words = D.words_of((t or "").encode())
        have = set(words)
        for i, item in bags:
            most = D.edits_allowed(len(item), share)
            if len(item) >= min_words and sum(w not in have for w in item) <= most:
                d = sellers(item, words)
                if d <= most:
                    out[n, i] = d
    return out


def found(spark, docs, items, **options):
    rows = [(n, t) for n, (_, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "n long, text string")
    f = D.find_items(spark.createDataFrame(items, "item_id long, text string"), **options)
    return {(r["n"], m["item_id"]): m for r in df.select("n", f(df["text"]).alias("m")).collect() for m in r["m"]}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 70)))) for i in range(60)]
    docs = []
    for n in range(300):
        words = [rng.choice(vocabulary + ["x%d" % rng.randrange(9999)]) for _ in range(rng.randrange(0, 200))]
        if n % 2:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, D.edits_allowed(len(item), D.MAX_EDITS) + 2)):
                at = rng.randrange(len(item))
                rng.choice([lambda: item.__setitem__(at, "zz"), lambda: item.insert(at, "zz"), lambda: item.pop(at)])()
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "!!"]) for w in item]
        docs.append((n, " ".join(words)))
    return docs, items


def test_recall_and_exactness(spark, planted):
    docs, items = planted
    want = brute(docs, items)
    got = found(spark, docs, items)
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) and len(want) > 80
    assert all(m["edits"] == want[k] for k, m in got.items())


def test_blocks_of_a_large_benchmark(spark, planted):
    docs, items = planted
    want = brute(docs, items)
    got = found(spark, docs, items, block_words=1000)  # other word numbers, so other random walks
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    items = [(1, item), (2, None), (3, ""), (4, "too short"), (5, item)]
    docs = [(1, None), (2, ""), (3, item), (4, "pre " + item.replace("three", "THREE!") + " post"),
            (5, item.replace("five", "5")), (6, " ".join(item.split()[:8])), (None, item + " " + item)]
    got = found(spark, docs, items)
    assert {k: (m["first_word"], m["n_words"], m["edits"]) for k, m in got.items()} == {
        (2, 1): (0, 10, 0), (2, 5): (0, 10, 0), (3, 1): (1, 10, 0), (3, 5): (1, 10, 0),
        (4, 1): (0, 10, 1), (4, 5): (0, 10, 1), (6, 1): (0, 10, 0), (6, 5): (0, 10, 0)}
    assert found(spark, docs, [(1, None)]) == {}
    df = spark.createDataFrame([(1, item, 0), (2, "clean text", 1), (None, None, 2)], "doc_id long, text string, __n int")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["__n"] for r in D.decontaminate(df, table).collect()) == [1, 2]
    assert D.decontaminate(df, table.limit(0)).count() == 3
    assert D.decontaminate(df.limit(0), table).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(docs[n][0], i): d for (n, i), d in brute(docs, items).items()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in QUERIES["op7_cgk_decontamination"](spark, sf).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 5
    assert all(want[k] == e for k, e in got.items())


def edited(rng, item, edits):
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, "zz"), lambda: out.insert(at, "zz"), lambda: out.pop(at)])()
    return out


def test_edited_copies_of_long_items_are_all_found(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([12, 40, 190, 500, 1000, 2000] * 3)]
    docs = []
    for i, text in items:
        item = text.split()
        around = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(2)]
        docs.append((i, " ".join(around[0] + edited(rng, item, D.edits_allowed(len(item), D.MAX_EDITS)) + around[1])))
    want = brute(docs, items)
    got = found(spark, docs, items)
    assert {(i, i) for i, _ in items} <= set(want)
    assert {k: m["edits"] for k, m in got.items()} == want


def test_best_place_is_the_smallest_distance_then_the_first(spark):
    rng = random.Random(9)
    for _ in range(60):
        item = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(10, 25))])
        text = np.array([rng.randrange(0, 5) for _ in range(10)] + edited_ids(rng, item) + [rng.randrange(0, 5) for _ in range(5)])
        most = D.edits_allowed(len(item), 0.3)
        all_runs = [(levenshtein(item, text[a:b]), a, b - a) for a in range(len(text)) for b in range(a, len(text) + 1)]
        best = min(all_runs)
        assert D.best_match(item, text, most) == (best if best[0] <= most else None)


def edited_ids(rng, item):
    return [rng.choice([int(w), int(w), int(w), 0]) for w in item if rng.random() > 0.1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            nxt.append(min(row[j] + (x != y), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return row[-1]


@pytest.mark.parametrize("n", [8, 9])
def test_verbatim_items_of_the_shortest_class_are_all_found(spark, n):
    rng = random.Random(n)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i in range(150)]
    docs = [(i, " ".join([rng.choice(vocabulary) for _ in range(20)] + t.split() + [rng.choice(vocabulary) for _ in range(40)]))
            for i, t in items]
    got = found(spark, docs, items)
    assert {k: (m["first_word"], m["n_words"], m["edits"]) for k, m in got.items()} == {(i, i): (20, n, 0) for i, _ in items}


def test_capitals_quotes_and_accents_of_any_script(spark):
    item = "Über den Äckern größer Städte übten ähnlich öde Ärzte früh Größe été déjà señor жизнь слово"
    docs = [(0, "vor " + item.upper() + " nach"), (1, " ".join(f"„{w.title()}“ –" for w in item.split())),
            (2, unicodedata.normalize("NFD", item)), (3, item.replace(" ", "\u00a0")), (4, f"«{item}»…")]
    got = found(spark, docs, [(1, item)], max_edits=0.0)
    assert {k: (m["n_words"], m["edits"]) for k, m in got.items()} == {(n, 1): (16, 0) for n in range(5)}
    assert D.words_of("¿Qué? “STRASSE” – straße user@host @name".encode()) == ["qué", "strasse", "strasse", "user@host", "@name"]


def test_short_items_are_found_verbatim(spark):
    items = [(1, "yes"), (2, "forty two"), (3, "What is the capital of France?"), (4, "..."), (5, "one two three four five six seven")]
    docs = [(0, "Yes, forty-two is not forty two"), (1, "q: what is the CAPITAL of France? Paris"),
            (2, "what is the old capital of France"), (3, "... one two three four five six seven eight"), (4, "no")]
    got = found(spark, docs, items)
    assert {k: (m["first_word"], m["n_words"], m["edits"]) for k, m in got.items()} == {
        (0, 1): (0, 1, 0), (0, 2): (4, 2, 0), (1, 3): (1, 6, 0), (3, 5): (0, 7, 0)}
    assert set(found(spark, docs, items, min_words=6)) == {(1, 3), (3, 5)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.decontaminate(df, table).collect()) == [2, 4]
    assert sorted(r["doc_id"] for r in D.decontaminate(df, table, min_words=6).collect()) == [0, 2, 4]


def test_sampling_reaches_its_recall_in_every_length_class():
    """Fresh random edits, up to as many as allowed, in texts with other words around; only what the samples find counts."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(2000)]
    sizes = [5, 9, 14, 20, 30, 45, 60, 90, 150, 300]
    items = [(k * 30 + i, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate(sizes) for i in range(30)]
    index = D.Index([(i, t.encode()) for i, t in items], D.MAX_EDITS, 1)
    assert set(index.recall) == {D.length_class(n) for n in sizes} and min(index.recall.values()) >= 0.9
    texts, wanted = [], []
    for i, t in items:
        words = t.split()
        copy = edited(rng, words, rng.randrange(D.edits_allowed(len(words), D.MAX_EDITS) + 1))
        around = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(2)]
        texts.append(" ".join(around[0] + copy + around[1]))
        wanted.append(i)
    got = [{m[0]: m for m in found} for found in index.search(texts, {})]
    assert all(i in found for i, found in zip(wanted, got))  # the pieces lose none
    for k, n in enumerate(sizes):
        mine = [found[i][4] for i, found in zip(wanted[k * 30:k * 30 + 30], got[k * 30:k * 30 + 30])]
        assert sum(mine) >= 0.9 * len(mine), (n, sum(mine))
    assert any(m[4] and m[5] for found in got for m in found.values())


def test_verbatim_items_agree_in_every_repetition():
    item = "one two three four five six seven eight nine".split()
    index = D.Index([(1, " ".join(item).encode())], D.MAX_EDITS, 1)
    assert [m[4:] for m in index.search(["x y " + " ".join(item) + " one two one", "one two three"], {})[0]] == [(True, True)]


def test_block_after_block_equals_one_block(spark, planted):
    docs, items = planted
    df = spark.createDataFrame([(n, t, n % 3) for n, (_, t) in enumerate(docs)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r[0], r[1], r[4]) for r in rows)
    whole = key(D.find_matches(df.drop("item_id"), "doc_id", table).collect())
    assert key(D.find_matches(df.drop("item_id"), "doc_id", table, block_words=1500).collect()) == whole
    clean = sorted(r["doc_id"] for r in D.decontaminate(df, table, block_words=1500).collect())
    assert clean == sorted(set(range(len(docs))) - {d for d, _, _ in whole}) and D.decontaminate(df, table).columns == df.columns
