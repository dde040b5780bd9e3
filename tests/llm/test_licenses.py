from sluice.llm import licenses as L


def test_canonical_forms_and_units(spark):
    mit = "Permission is granted, free of charge.\n\nNo warranty, whilst in favour."
    known = spark.createDataFrame([("X", "Copyright 2020 A. Author\n" + mit), ("Y", "One line licence!"), ("E", "..."),
                                   (None, "nobody"), ("Z", "one LINE license")], "license_id string, text string")
    rows = [(1, "(c) 1999 Somebody\n\npermission is GRANTED -- free of charge\nno warranty while in favor\n", "a"),
            (2, "Text before\n\none line (licence)\none line license\n\nafter", "b"),
            (3, None, "c"), (4, "", "d"), (5, "...", "e"), (None, "One   line licence", "f"),
            (2, "x\none line license", "g"), (6, "nobody", "h"), (7, "word " * 30_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted((tuple(r) for r in L.scan(docs, known).collect()), key=str)
    assert got == sorted([(1, "X", "text", 1), (1, "X", "paragraph", 1), (2, "Y", "line", 3), (2, "Z", "line", 3),
                          (None, "Y", "text", 1), (None, "Y", "paragraph", 1), (None, "Y", "line", 1),
                          (None, "Z", "text", 1), (None, "Z", "paragraph", 1), (None, "Z", "line", 1)], key=str)
    assert L.scan(docs.limit(0), known).collect() == []
    assert L.scan(docs, known.limit(0)).collect() == []


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(tuple(r) for r in L.scan(docs, L.known_licenses(spark)).collect())
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in L.scan(docs, L.known_licenses(spark)).collect()) == want
    assert {r[1] for r in want} == {"Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT"}


def test_wrapped_texts_and_spellings_are_found(spark):
    import textwrap
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    whole = [(i, t) for i, t in L.KNOWN if len(t) > 500]
    assert {i for i, _ in whole} == {"BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"}
    rows, want = [], set()
    for k, (i, t) in enumerate(whole):
        for width in (23, 31, 47, 60, 72, 79, 100):
            doc = k * 1000 + width
            notice = ["Copyright (c) 2020 A. Author", "copyright 1999, 2001 by B", "© 2024 C", "Copyright by D", "(C) E"][width % 5]
            rows.append((doc, notice + "\n\n" + wrap(t, width).upper().replace("WARRANTIES", "Warranties")))
            want.add((doc, i))
    rows.append((9999, "Wilful acts of the licence.\ncopyright notice of this licence"))
    known = L.known_licenses(spark, spark.createDataFrame([("OWN", "willful acts of the license; copyright notice of this license")],
                                                          "license_id string, text string"))
    got = {(r["doc_id"], r["license_id"]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect() if r["unit"] == "text"}
    assert got == want | {(9999, "OWN")}
