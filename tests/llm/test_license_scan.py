"""License scans: usual headers and files are recognised, similarities equal plain cosines, inheritance, odd rows."""

import math
import re

import pytest

from caseloom.llm import license_scan as ls

FOUR_LINES = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program. If not, see <https://www.gnu.org/licenses/>.
 */
int main() { return 0; }"""
MIT = dict(ls.FULL)["MIT"]
PLAIN = "A quiet story of the sea.\nIt goes on for a while.\n\nThe end, with a permit and a license to fish."
CASES = [
    ("a/LICENSE", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\nPreamble and so on", "GPL-3.0", "header"),
    ("b/x.c", FOUR_LINES, "GPL-3.0", "header"),
    ("c/LICENSE.txt", "\n  Apache License\n  Version 2.0\n\nterms", "Apache-2.0", "header"),
    ("d/x.py", "# SPDX-License-Identifier: MIT\nimport os", "MIT", "spdx"),
    ("d2/x.py", "#!/bin/sh\n\ntext // SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0", "spdx"),
    ("e/y.txt", "MIT License\n\nCopyright (c) 2021 Some One\n", "MIT", None),
    ("f/COPYING", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0", None),
    ("g/LICENSE", "Copyright 2020 A. Person\n\n" + MIT.replace(". ", ".\n\n"), "MIT", "file"),
    ("h/LICENSE", f"Some Project\nCopyright (c) 2019 B\n\n{dict(ls.FULL)['BSD-2-Clause']}", "BSD-2-Clause", "file"),
    ("i/story.txt", PLAIN, None, None),
    ("j/z.go", "// Copyright 2015 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage z", "BSD-3-Clause", "header"),
    ("k/none.txt", None, None, None),
    ("l/empty.txt", "", None, None),
    ("m/blank.txt", " \n\t\n", None, None),
    ("n/long.txt", "# plain comment\n" * 20_000 + "words " * 50_000, None, None),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, path string, text string")


@pytest.fixture(scope="module")
def scanned(spark):
    files = table(spark, [(i, p, t) for i, (p, t, _, _) in enumerate(CASES)])
    return {r["id"]: r for r in ls.scan(files).collect()}


def test_usual_headers_and_files(scanned):
    for i, (path, _, license_, unit) in enumerate(CASES):
        assert scanned[i]["license"] == license_, (path, scanned[i])
        assert scanned[i]["origin"] == ("notice" if license_ else None)
        if unit:
            assert scanned[i]["unit"] == unit, (path, scanned[i])


def plain_header(text):
    lines = text.split("\n")
    while lines and not re.search(r"\S", lines[0]):
        lines.pop(0)
    if not lines:
        return ""
    inside = ls._COMMENT if re.search(ls._COMMENT, lines[0]) else r"\S"
    out = []
    for x in lines:
        if not re.search(inside, x):
            break
        out.append(x)
    return "\n".join(x for x in out if not re.search(ls._COPYRIGHT, x))


def plain_units(path, text):
    yield from (("line", x) for x in text.split("\n"))
    yield from (("spdx", x) for x in re.findall(ls._SPDX, text))
    yield "header", plain_header(text)
    if re.match(ls.LICENSE_FILE, path.rsplit("/", 1)[-1]):
        yield "file", "\n".join(x for x in text.split("\n") if not re.search(ls._COPYRIGHT, x))


def test_similarities_equal_plain_cosines(scanned):
    texts = [(p, t or "") for p, t, _, _ in CASES]
    held = [set(ls._words(t)) for _, t in texts]
    known = {w for t in ls.TEMPLATES for w in ls._words(t.text)}
    n = len(texts)

    def vector(text):
        words = ls._words(text)
        weight = lambda w: math.log((n + 2) / (sum(w in h for h in held) + 1)) + 1e-9 if w in known else math.log(n + 2)
        raw = {w: words.count(w) * weight(w) for w in set(words)}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / norm for w, x in raw.items()}

    templates = [(t.kind, t.license, vector(t.text)) for t in ls.TEMPLATES]
    for i, (path, text) in enumerate(texts[:-1]):
        best = 0.0
        for kind, unit in plain_units(path, text):
            v = vector(unit)
            best = max([best, *(sum(x * v.get(w, 0.0) for w, x in t.items()) for k, _, t in templates if k == kind)])
        assert (best >= ls.THRESHOLD) == (scanned[i]["similarity"] is not None), path
        if best >= ls.THRESHOLD:
            assert scanned[i]["similarity"] == pytest.approx(best, abs=1e-8)


def test_nearest_directory_and_odd_rows(spark):
    rows = [
        (1, "LICENSE", MIT), (2, "a/b/LICENSE", "Apache License\nVersion 2.0"), (3, "a/b/c/x.c", "int x;"), (4, "a/y.c", "int y;"),
        (4, "a/y.c", "int y;"), (5, None, "SPDX-License-Identifier: ISC"), (6, None, None), (None, "a/b/z.c", "z"),
    ]
    got = [(r["id"], r["license"], r["origin"], r["license_dir"]) for r in ls.scan(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "MIT", "notice", None), (2, "Apache-2.0", "notice", None), (3, "Apache-2.0", "directory", "a/b"),
            (4, "MIT", "directory", ""), (4, "MIT", "directory", ""), (5, "ISC", "notice", None), (6, None, None, None),
            (None, "Apache-2.0", "directory", "a/b"),
        ],
        key=str,
    )
    assert ls.scan(table(spark, [])).count() == 0
