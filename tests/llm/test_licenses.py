import math
import random
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses

SCHEMA = "doc_id long, path string, text string, license string, own string"
APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def row(doc_id, path, text):
    return (doc_id, path, text, "x", "y")


FILES = [
    row(1, "a/LICENSE", APACHE + " and a good many words of this and that which follow here\n" * 3),
    row(2, "a/x.py", "plain words"),
    row(3, "a/b/c/y.py", "more words"),
    row(4, "a/b/LICENSE.txt", GPL),
    row(5, "a/b/own.py", "code\nReleased under the MIT License.\n" + "code and code again\n" * 50),
    row(6, "z/q.py", "nothing here"),
    row(7, None, "no path"),
    row(8, None, GPL),
    row(9, "top.py", ""),
    row(10, "a/b/n.py", None),
    row(10, "a/b/n.py", None),
    row(None, "a/none.py", "words"),
    row(11, "a/b/COPYING", APACHE),
    row(12, "", "empty path"),
]


def test_scanned(spark):
    """A directory with two licence files takes the one with the better score, then the lesser path."""
    got = {(r.doc_id, r.path): (r.license, r.origin, r.inherited_from) for r in licenses.scanned(spark.createDataFrame(FILES, SCHEMA)).collect()}
    assert got == {
        (1, "a/LICENSE"): ("Apache-2.0", "own", None),
        (2, "a/x.py"): ("Apache-2.0", "inherited", "a"),
        (3, "a/b/c/y.py"): ("Apache-2.0", "inherited", "a/b"),
        (4, "a/b/LICENSE.txt"): ("GPL-3.0", "own", None),
        (5, "a/b/own.py"): ("MIT", "own", None),
        (6, "z/q.py"): (None, "none", None),
        (7, None): (None, "none", None),
        (8, None): ("GPL-3.0", "own", None),
        (9, "top.py"): (None, "none", None),
        (10, "a/b/n.py"): ("Apache-2.0", "inherited", "a/b"),
        (None, "a/none.py"): ("Apache-2.0", "inherited", "a"),
        (11, "a/b/COPYING"): ("Apache-2.0", "own", None),
        (12, ""): (None, "none", None),
    }
    assert licenses.scanned(spark.createDataFrame(FILES, SCHEMA)).count() == len(FILES)


def test_query_inherits_along_paths(spark, tmp_path):
    """The query's inheritance has an effect where documents have paths, and is left out where they have none."""
    files = spark.createDataFrame(FILES, SCHEMA)
    columns = ["doc_id", "path", "license", "score", "origin", "inherited_from"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    files.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert rows(licenses.op10(spark, f"{tmp_path}/a")) == rows(licenses.scanned(files))
    files.drop("path").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = licenses.op10(spark, f"{tmp_path}/b")
    assert got.columns == columns and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == rows(licenses.scanned(files.withColumn("path", F.lit(None).cast("string"))))


def test_without_broadcast(spark, monkeypatch):
    files = spark.createDataFrame(FILES, SCHEMA)
    before = sorted(map(str, licenses.scanned(files).collect()))
    monkeypatch.setattr(licenses, "MAX_BROADCAST_ROWS", -1)
    assert sorted(map(str, licenses.scanned(files).collect())) == before


@pytest.fixture(scope="module")
def scanner():
    words = {t for _, text in licenses.TEMPLATES for t in licenses.terms(text)}
    common = {"the", "of", "this", "to", "in", "and", "is", "a", "under", "or"}
    return licenses.Scanner(licenses.TEMPLATES, {w: 900 if w in common else 20 for w in words}, 1000)


@pytest.mark.parametrize(("name", "text"), licenses.TEMPLATES)
def test_every_template_is_found(scanner, name, text):
    got, score, _ = scanner.scan("some words before\n" + text + "\nand some after")
    assert got == name and score > 0.99


def wrapped(text, lead, width=60):
    return "\n".join(lead + line for line in textwrap.wrap(text, width))


def test_real_files(scanner):
    """Whole files, wrapped in comments, with names and years, and code right after them."""
    found = dict((name, text) for name, text in reversed(licenses.TEMPLATES) if len(text) > 150)
    copyright_ = "Copyright (c) 2019, Jane Roe and others. All rights reserved.\n"
    for name, text in found.items():
        for lead in ("", "# ", " * ", "// "):
            got, score, share = scanner.scan(copyright_ + wrapped(text, lead) + "\nimport os\nx = 1\n")
            assert got == name and score > 0.9 and share > 0.5, (name, lead, got)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
        ("This work is licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This work is licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This file is not licensed under the MIT License.", None),
        ("It is licensed under the MIT\n# License.", "MIT"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("Released under the MIT Licence", "MIT"),
        ("All rights reserved. Released under the MIT License.", "MIT"),
        ("All rights reserved.", "proprietary"),
    ],
)
def test_deciding_words(scanner, text, name):
    assert scanner.scan("some words\n" + text + "\nmore words follow here")[0] == name


def brute(scanner, text):
    """Every window of every template, by the formula."""
    found, best = licenses.terms(text), None
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        words = licenses.terms(template)
        size = min(len(words), len(found))
        vector = lambda x: {t: (1 + math.log(n)) * scanner.idf.get(t, scanner.unseen) for t, n in Counter(x).items()}
        norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
        b = vector(words)
        for at in range(len(found) - size + 1 if found else 0):
            a = vector(found[at : at + size])
            score = sum(w * b.get(t, 0) for t, w in a.items()) / (norm(a) * norm(b))
            if score >= licenses.THRESHOLD and scanner.templates[k].admits(found, at, at + size):
                rank = (name != "proprietary", round(score, 6), -k)
                best = max(best or rank, rank)
    return (licenses.TEMPLATES[-best[2]][0], best[1]) if best else (None, 0.0)


def test_against_brute_force(scanner):
    r = random.Random(8)
    pool = [t for _, text in licenses.TEMPLATES for t in text.split()] + ["word", "other", "thing"] * 40
    for k in range(25):
        text = r.choices(pool, k=r.randint(0, 60))
        for _ in range(k % 3):
            words = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(pool)
            at = r.randint(0, len(text))
            text[at:at] = words
        text = " ".join(text)
        name, score, _ = scanner.scan(text)
        assert (name, round(score, 6)) == pytest.approx(brute(scanner, text))


def test_prefix_loses_nothing(scanner):
    """Windows that share no prefix term are below the threshold, as the bound says."""
    for t in scanner.templates:
        assert sum(w * w for x, w in t.weights.items() if x not in t.prefix) ** 0.5 < licenses.THRESHOLD * t.norm, t.name


@pytest.mark.parametrize("text", ["", "words " * 100_000, "the license plate of a public car", "free of charge", "version 2.0 of the plan"])
def test_clean_texts(scanner, text):
    assert scanner.scan(text)[0] is None


def test_empty(spark):
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def files_of(folder):
    from pathlib import Path

    return sorted(f for f in Path(folder).glob("*") if not f.is_symlink())


@pytest.mark.skipif(not files_of("/usr/share/common-licenses"), reason="no copies of licences here")
def test_whole_licence_files(spark):
    """Every file is named right or not at all, and those that are named count for their directory."""
    right = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0"}
    files = [row(k, f"{f.name}/licenses/text.txt", f.read_text()) for k, f in enumerate(files_of("/usr/share/common-licenses"))]
    files += [row(100 + r[0], r[1].replace("licenses/text.txt", "licenses/src/x.py"), "plain words") for r in files]
    found = {r.path: (r.license, r.origin) for r in licenses.scanned(spark.createDataFrame(files, SCHEMA)).collect()}
    own = {p.split("/")[0]: name for p, (name, origin) in found.items() if p.endswith(".txt")}
    assert {f: n for f, n in own.items() if n is not None and n != right.get(f, f)} == {}
    assert {"Apache-2.0", "CC0-1.0", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0"} & own.keys() <= {f for f, n in own.items() if n}
    assert all(found[f"{f}/licenses/src/x.py"] == (n, "inherited") for f, n in own.items() if n)


def test_a_window_names_its_licence():
    scanner = licenses.Scanner(licenses.TEMPLATES, {}, 1)
    assert scanner.scan("is used under the terms of the license, the License")[0] is None
    assert scanner.scan("Distributed under the terms of the MIT license")[0] == "MIT"
