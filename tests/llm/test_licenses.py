"""Licence scans: nearest template, and inheritance along directories."""

import math
import re
import textwrap
from pathlib import Path

import pytest

from tidemark.llm import licenses

TEMPLATES = dict(licenses._NAMED)


def test_scan(spark):
    mit, apache = "Released under the MIT License.", TEMPLATES["Apache-2.0"]
    body = " ".join(f"word{i}" for i in range(200))
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/code", body), (3, "a/b/c/LICENSE", f"{apache}\r\nshort note"), (4, "a/b/c/d/e/code", body), (5, "a/b/own", f"{body}\n# {TEMPLATES['GPL-3.0']}"),
        (6, "z/code", body), (7, None, body), (8, "a/x", None), (9, "root", ""), (10, "a/LICENSE.2", mit), (1, "a/LICENSE", mit), (11, None, mit), (None, "q/LICENSE", TEMPLATES["ISC"]), (12, "q/r/s", body), (13, "a/b/other", body + " license agreement terms"),
    ]
    df = spark.createDataFrame([(*f, "x") for f in files], "doc_id long, path string, text string, license string").repartition(3)
    got = {(r["doc_id"], r["path"]): (r["license"], r["how"], r["from_id"]) for r in licenses.scan(df).collect()}
    assert got[1, "a/LICENSE"] == ("MIT", "own", 1) and got[2, "a/b/code"] == ("MIT", "inherited", 1) and got[3, "a/b/c/LICENSE"] == ("Apache-2.0", "own", 3)
    assert got[4, "a/b/c/d/e/code"] == ("Apache-2.0", "inherited", 3) and got[5, "a/b/own"] == ("GPL-3.0", "own", 5) and got[6, "z/code"] == (None, "none", None)
    assert got[7, None] == (None, "none", None) and got[8, "a/x"] == ("MIT", "inherited", 1) and got[9, "root"] == (None, "none", None) and got[11, None][0] == "MIT"
    assert got[12, "q/r/s"][:2] == ("ISC", "inherited") and got[13, "a/b/other"] == ("MIT", "inherited", 1)
    assert licenses.scan(df).count() == len(files)


def test_cosine_is_that_of_tf_idf(spark):
    lines = ["Licensed under the Apache License.", "Released under the MIT License.", "a license of my own making, mit licence", licenses._MIT_GRANT[:150], "SPDX-License-Identifier: GPL-2.0-only"]
    got = {r["block"]: (r["license"], r["cosine"]) for r in licenses.score_blocks(spark.createDataFrame([(x,) for x in lines], "block string")).collect()}

    def terms(line):
        return [w.strip(".-") for w in "".join(c if c.isalnum() or c in ".-" else " " for c in line.lower()).split() if w.strip(".-")]

    every = [terms(x) for x in [*lines, *(t for _, t in licenses.TEMPLATES)]]
    idf = {w: math.log((len(every) + 1) / (sum(w in e for e in every) + 1)) + 1 for e in every for w in e}
    vector = lambda e: {w: e.count(w) * idf[w] for w in e}

    def cosine(a, b):
        a, b = vector(terms(a)), vector(terms(b))
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for line in lines:
        cosines = [(-round(cosine(line, t), 9), n) for n, t in licenses.TEMPLATES]
        best = min(cosines)
        if -best[0] >= licenses.MIN_COSINE:
            assert got[line][0] == best[1] and abs(got[line][1] + best[0]) < 1e-6
        else:
            assert line not in got


def wrapped(text, width, mark):
    return "\n".join(f"{mark}{x}".rstrip() for x in textwrap.wrap(text, width))


def test_every_template_is_found_however_it_is_wrapped(spark):
    code = "\n".join(f"value_{i} = compute({i}, other_{i})" for i in range(60))
    files, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        for j, (width, mark) in enumerate(((60, "# "), (78, " * "), (72, "// "), (10_000, ""))):
            key = 10 * i + j
            want[key] = name
            files.append((key, f"p{key}/a", f"{code}\n{wrapped(text, width, mark)}\n\n{code}"))
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    wrong = {k: (want[k], got[k]) for k in want if got[k] != want[k]}
    assert len(wrong) <= 0.02 * len(want) and all(got.values()), wrong  # the nearest block of few may be a kin's


def test_standard_files_and_headers(spark):
    mit = "MIT License\n\nCopyright (c) 2024 Some One\n\n" + "\n\n".join(wrapped(t, 77, "") for t in (licenses._MIT_GRANT, licenses._MIT_NOTICE, licenses._MIT_AS_IS))
    bsd = "Copyright (c) 2024, Some One\nAll rights reserved.\n\n" + wrapped(licenses._BSD_GRANT + licenses._BSD_TWO + licenses._BSD_THIRD + licenses._BSD_AS_IS, 80, "")
    files = [(1, "a/LICENSE", mit), (2, "a/b/x.py", "code"), (3, "c/LICENSE.txt", bsd), (4, "c/y", "code"), (5, "d/x.c", "/* SPDX-License-Identifier: MIT */\nint x;"), (6, "e/long", ("word " * 30 + ". ") * 3000 + "Licensed under the Apache License, Version 2.0. " + "word " * 5000), (7, "f/plain", "the permission slip and the license plate of the driver were lost")]
    got = {r["doc_id"]: (r["license"], r["how"], r["from_id"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", 1), 2: ("MIT", "inherited", 1), 3: ("BSD-3-Clause", "own", 3), 4: ("BSD-3-Clause", "inherited", 3), 5: ("MIT", "own", 5), 6: ("Apache-2.0", "own", 6), 7: (None, "none", None)}


#: Whole texts of licences, where the system keeps them.
TEXTS = Path("/usr/share/common-licenses")
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not all((TEXTS / n).exists() for n in WHOLE), reason="no licence texts here")
def test_whole_texts_are_named_right_and_long_ones_take_their_length(spark):
    files = [(i, f"d{i}/LICENSE", (TEXTS / n).read_text()) for i, n in enumerate(WHOLE)]
    got = {r["doc_id"]: (r["license"], r["how"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {i: (name, "own") for i, name in enumerate(WHOLE.values())}
    text = (TEXTS / "GPL-3").read_text()
    sizes = {}
    for times in (1, 8):
        made = licenses.blocks(spark.createDataFrame([(1, text * times)], "row long, text string")).selectExpr("sum(length(block))").first()[0]
        sizes[times] = made / (len(text) * times)
    assert sizes[8] <= 35 and sizes[8] <= 1.1 * sizes[1]
    assert licenses.scan(spark.createDataFrame([(1, "a/COPYING", text * 8)], "doc_id long, path string, text string")).first()["license"] == "GPL-3.0"


def test_expressions_of_several_licences(spark):
    lines = {"SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0 OR MIT", "// SPDX-License-Identifier:  (GPL-2.0-only WITH  Linux-syscall-note) OR BSD-3-Clause": "(GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", "spdx-license-identifier: ISC and Zlib": "ISC and Zlib", "Dual licensed under the MIT or GPL Version 2 licenses.": "MIT OR GPL-2.0", "# SPDX-License-Identifier: MIT": "MIT"}
    files = [(i, f"p{i}/x", f"int a;\n{line}\nint b;") for i, line in enumerate(lines)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == dict(enumerate(lines.values()))


def plain_spans(at, size):
    """(start, n) of the blocks around the lines ``at`` by plain loops."""
    regions, out = [], set()
    for x in at:
        if regions and x - regions[-1][1] <= licenses.GAP:
            regions[-1][1] = x
        else:
            regions.append([x, x])
        out |= {(x, 1), (x, 2), (x - 1, 2)}
    for first, last in regions:
        long = last - first >= licenses.REGION
        out |= {(s, n) for s in range(first - 2, (first + licenses.HEAD - 1 if long else last) + 1) for n in licenses.SPANS}
        out |= {(s, n) for n in licenses.STRIDED for s in range(first, last + 1, max(n // 4, 1)) if long}
    return {(max(s, 0), min(n, size - max(s, 0))) for s, n in out if max(s, 0) < size}


@pytest.mark.parametrize(("at", "size"), [([0], 1), ([0, 1, 5, 9], 12), ([3, 4, 20], 300), (list(range(2, 60, 3)), 61), ([*range(0, 34)], 40), ([*range(5, 40), 99], 100)])
def test_blocks_are_those_of_plain_loops(spark, at, size):
    text = "\n".join(f"license {i}" if i in at else f"line {i}" for i in range(size))
    got = licenses.blocks(spark.createDataFrame([(7, text)], "row long, text string")).collect()
    lines = text.split("\n")
    assert sorted((r["start"], r["n"]) for r in got) == sorted(plain_spans(at, size))
    assert all(r["block"] == " ".join(lines[r["start"] : r["start"] + r["n"]]) for r in got)


def test_every_template_has_a_marker():
    assert all(re.search(r"(?i)(?<![^\W_])(?:" + "|".join(licenses.MARKERS) + r")(?![^\W_])", t) for _, t in licenses.TEMPLATES)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []
