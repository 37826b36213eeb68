import pytest
from pyspark.sql import functions as F

from quillvec.llm import licences

FILES = [
    ("a/LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\nTerms and conditions for use, reproduction, and distribution"),
    ("a/x.py", "print(1)"),
    ("a/b/y.py", "no words about it"),
    ("a/b/c/z.py", "Intro.\nReleased under the MIT License.\nrest"),
    ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/d/e/w.py", ""),
    ("other/q.py", None),
    ("other/r.md", "Licensed under CC BY-NC 4.0."),
    ("other/s.md", "Some said a licence of the poet allows the word order of this line to be quite unusual and long."),
    ("LICENSE2.py", "x"),
    (None, "This work is licensed under the GNU General Public License, version 3."),
    (None, "nothing"),
    ("h/en/9/", "Licensed under CC BY 4.0."),
    ("h/en/9/page", "text"),
    ("h/en/page", "text"),
]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame([(*f, "mine") for f in FILES], "path string, text string, licence string")
    return licences.scan(df, keep=["path"]).collect()


def test_own_and_inherited(made):
    got = {}
    for r in made:
        got.setdefault(r.path, []).append((r.licence, r.licence_path))
    assert got["a/LICENSE"] == [("Apache-2.0", "a/LICENSE")] and got["a/x.py"] == [("Apache-2.0", "a/LICENSE")]
    assert got["a/b/y.py"] == [("Apache-2.0", "a/LICENSE")]
    assert got["a/b/c/z.py"] == [("MIT", "a/b/c/z.py")] and got["a/b/c/COPYING.txt"] == [("GPL-3.0", "a/b/c/COPYING.txt")]
    assert got["a/b/c/d/e/w.py"] == [("GPL-3.0", "a/b/c/COPYING.txt")]  # the nearest ancestor's
    assert got["other/q.py"] == [(None, None)] and got["other/r.md"] == [("CC-BY-NC-4.0", "other/r.md")]  # no licence file there
    assert got["other/s.md"] == [(None, None)] and got["LICENSE2.py"] == [(None, None)]
    assert sorted(got[None], key=str) == sorted([("GPL-3.0", None), (None, None)], key=str)
    assert got["h/en/9/page"] == [("CC-BY-4.0", "h/en/9/")] and got["h/en/page"] == [(None, None)]


def test_every_notice_is_its_own_best(spark):
    df = spark.createDataFrame([(i, f"f{i}", f"Some words.\n{t}\nOther words.") for i, (_, t) in enumerate(licences.TEMPLATES)], "id int, path string, text string")
    got = {r.id: r for r in licences.scan(df, keep=["id"]).collect()}
    for i, (name, _) in enumerate(licences.TEMPLATES):
        assert got[i].licence == name, (i, name, got[i])


def test_cosine_against_plain_python(spark):
    import math
    import re
    from collections import Counter

    units = ["Licensed under the Apache License", "licensed licensed under something else", "This work is licensed under the GNU General Public License, version 2"]
    got = {r.unit: r for r in licences.score(spark.createDataFrame([(u,) for u in units], "unit string")).collect()}
    terms = lambda t: Counter(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+(?:\.\d+)*", t.lower()))
    vocabulary = {x for _, t in licences.TEMPLATES for x in terms(t)}
    df = Counter(x for u in units for x in terms(u))
    idf = lambda x: math.log((len(units) + 1) / (df[x] + 1)) + 1 if x in vocabulary else 1.0
    weights = lambda t: {x: (1 + math.log(n)) * idf(x) for x, n in terms(t).items()}
    norm = lambda w: math.sqrt(sum(v * v for v in w.values()))
    for u in units:
        a = weights(u)
        best = max((sum(a.get(x, 0) * v for x, v in weights(t).items()) / norm(a) / norm(weights(t)), -i) for i, (_, t) in enumerate(licences.TEMPLATES))
        assert got[u].score == pytest.approx(best[0], abs=1e-6) and got[u].licence == licences.TEMPLATES[-best[1]][0]


def test_pages(spark):
    page = spark.createDataFrame([("https://h.org/a/b?x=1#y", "<html><script>licence()</script><p>One</p><!-- licensed --><p>Released under the MIT License.</p>")], "url string, html string")
    r = page.select(licences.page_path(F.col("url")).alias("p"), licences.page_text(F.col("html")).alias("t")).first()
    assert r.p == "h.org/a/b" and "script" not in r.t and "licensed" not in r.t and "Released under the MIT License." in r.t.split("\n")


def test_empty_repeated_and_long(spark):
    df = spark.createDataFrame([("d/x", "licence " * 20_000), ("d/x", "Released under the MIT License."), ("d/x", "Released under the MIT License.")], "path string, text string")
    assert sorted(r.licence or "" for r in licences.scan(df, keep=["path"]).collect()) == ["", "MIT", "MIT"]
    assert licences.scan(df.limit(0), keep=["path"]).collect() == []


def test_headers_over_several_lines(spark):
    """A notice that is wrapped and commented out counts as one sentence."""
    header = "/*\n * This program is free software: you can redistribute it and/or\n * modify it under the terms of the GNU General Public License as\n * published by the Free Software Foundation, either version 3 of the\n * License, or any later version.\n */\nint x;"
    hashes = "# Permission is hereby granted, free of charge, to any person\r\n# obtaining a copy of this software and associated documentation\r\n# files (the Software), to deal in the Software without restriction\r\n\r\nx = 1"
    df = spark.createDataFrame([("a/x.c", header, "kept"), ("b/y.py", hashes, "kept")], "path string, text string, licence string")
    got = {r.path: (r.licence, r.score > 0.95) for r in licences.scan(df, keep=["path"]).collect()}
    assert got == {"a/x.c": ("GPL-3.0", True), "b/y.py": ("MIT", True)}
