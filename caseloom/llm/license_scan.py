"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance from the nearest directory.

Units of a file that are compared with the templates of their kind:

* ``header``: its leading comment block, or its first paragraph if it starts with no comment;
* ``file``: the whole text of a license file (by its name);
* ``spdx``: the identifier behind an SPDX tag, wherever it stands;
* ``line``: each line, for notices within a text.

Copyright lines are left out of headers and files, since holders and years are no part of a template.  Of each kind,
only units go on that hold a word without which no template reaches the threshold; the rest is one join with the words of
the templates (a bounded table).  A file with a license notice has that license; a license file gives its license to
its directory; a file without a notice inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut_lineage


class Template(NamedTuple):
    kind: str
    license: str
    text: str


#: Notices of common licenses as they stand on a line of a text.
LINES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
#: Identifier, title and date of publication of common licenses, as license files begin.
TITLES = (
    ("MIT", "MIT License", ""),
    ("MIT", "The MIT License (MIT)", ""),
    ("Apache-2.0", "Apache License Version 2.0", "January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU General Public License Version 2", "June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3", "19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", ""),
    ("EPL-2.0", "Eclipse Public License v 2.0", ""),
    ("BSD-2-Clause", "BSD 2-Clause License", ""),
    ("BSD-3-Clause", "BSD 3-Clause License", ""),
    ("ISC", "ISC License", ""),
    ("BSL-1.0", "Boost Software License Version 1.0", "August 17th, 2003"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International", "Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal", ""),
)
_GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
#: Standard headers that licenses ask for in source files.
HEADERS = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("GPL-2.0", _GNU_HEADER.format(name="GNU General Public License", version="2")),
    ("GPL-3.0", _GNU_HEADER.format(name="GNU General Public License", version="3")),
    ("LGPL-3.0", _GNU_HEADER.format(name="GNU Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU_HEADER.format(name="GNU Affero General Public License", version="3")),
)
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole license texts without title and copyright line.  Longer ones come through ``templates``.
FULL = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. """ + _AS_IS),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("BSD-3-Clause", _BSD.format(third="""3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""")),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)


def _all_templates() -> tuple[Template, ...]:
    out = [Template("line", name, text) for name, text in LINES]
    for name, title, date in TITLES:
        for text in [title, f"{title} {date}"] if date else [title]:
            out += [Template("header", name, text), Template("line", name, text)]
    for name, text in HEADERS + FULL:
        out.append(Template("header", name, text))
    for name, text in FULL:
        out.append(Template("file", name, text))
    for name in sorted({n for n, _, _ in TITLES} | {n for n, _ in FULL}):
        endings = ["", "-only", "-or-later"] if "GPL" in name else [""]
        out += [Template("spdx", name, name + e) for e in endings]
    return tuple(out)


TEMPLATES = _all_templates()
THRESHOLD = 0.8
#: License files, by the last part of the path.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"
#: Lines of a comment, lines that name a copyright holder, and the tag of an identifier.
_COMMENT = r"^\s*(//|/\*|\*|#|--|;|%|<!--|\"\"\"|''\')"
_COPYRIGHT = r"(?i)^[^a-z0-9(]*(copyright\b|\(c\)|©)"
_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


class Weights:
    """Inverse document frequencies of the template words and the normed template vectors."""

    def __init__(self, templates, frequency: dict[str, int], files: int):
        self.unseen = math.log(files + 2)
        self.idf = {w: math.log((files + 2) / (frequency.get(w, 0) + 1)) + 1e-9 for t in templates for w in _words(t.text)}
        self.vectors = []
        for t in templates:
            words = _words(t.text)
            raw = {w: words.count(w) * self.idf[w] for w in words}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append((t.kind, t.license, {w: x / norm for w, x in raw.items()}))

    def keys(self, kind: str, threshold: float) -> list[str]:
        """Words of which a unit needs at least one: the others of a template, its most frequent ones, cannot reach the threshold."""
        out = set()
        for own, _, vector in self.vectors:
            rest = 0.0
            for w, x in sorted(vector.items(), key=lambda e: (self.idf[e[0]], e[0])) if own == kind else ():
                rest += x * x
                if math.sqrt(rest) >= threshold - 1e-9:
                    out.add(w)
        return sorted(out)


def fit_weights(files: DataFrame, templates=TEMPLATES) -> Weights:
    """Document frequencies of the template words over all whole files."""
    wanted = sorted({w for t in templates for w in _words(t.text)})
    held = F.array_intersect(_words_of(F.col("text")), F.array(*[F.lit(w) for w in wanted]))
    counts = files.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return Weights(templates, {r["w"]: r["n"] for r in counts}, files.count())


def header_of(text: Column) -> Column:
    """Leading comment block, or first paragraph, without copyright lines."""
    lines = F.split(text, "\n")
    filled = F.transform(lines, lambda x: x.rlike(r"[^\s]"))
    start = F.array_position(filled, F.lit(True))
    lines = F.when(start > 0, F.slice(lines, start.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    commented = F.transform(lines, lambda x: x.rlike(_COMMENT))
    paragraph = F.transform(lines, lambda x: x.rlike(r"[^\s]"))
    inside = F.when(F.get(commented, F.lit(0)), commented).otherwise(paragraph)
    end = F.array_position(inside, F.lit(False)).cast("int")
    block = F.when(end > 0, F.slice(lines, 1, F.greatest(end - 1, F.lit(0)))).otherwise(lines)
    return F.array_join(F.filter(block, lambda x: ~x.rlike(_COPYRIGHT)), "\n")


def _any_of(keys: set[str]) -> str:
    """Pattern of any of the words, alternatives parted by their first letter so that few are tried at each place."""
    firsts = sorted({w[0] for w in keys})
    return "|".join(f"{c}(?:{'|'.join(re.escape(w[1:]) for w in sorted(keys) if w[0] == c)})" for c in firsts)


def units(files: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """``id, kind, line, l`` of all units that may reach the threshold; ``line`` is 0 for headers and files."""

    def may(kinds: tuple[str, ...], text: Column) -> Column:
        keys = _any_of({w for k in kinds for w in weights.keys(k, threshold)})
        return F.lower(text).rlike(rf"(?<![a-z0-9])(?:{keys})(?![a-z0-9])") if keys else F.lit(False)

    # Most texts hold no key word of any kind and are read by this one pattern only.
    tagged_text = F.lower("text").contains("spdx-license-identifier")
    found = files.filter(may(("line", "header", "file"), F.col("text")) | tagged_text)
    found = found.withColumn("may", may(("line",), F.col("text")))
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(_COPYRIGHT)), "\n")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = F.when(F.col("may"), F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("l"))), lambda s: may(("line",), s["l"]))
    tags = F.regexp_extract_all("text", F.lit(_SPDX), F.lit(1))
    tagged = F.transform(tags, lambda x, i: F.struct(F.lit(0).alias("line"), x.alias("l")))
    one = lambda x, keep: F.when(keep, F.array(F.struct(F.lit(0).alias("line"), x.alias("l"))))
    header = header_of(F.col("text"))
    kinds = {
        "line": lines,
        "spdx": F.when(tagged_text, tagged),
        "header": one(header, may(("header",), F.col("text")) & may(("header",), header)),
        "file": one(body, name.rlike(LICENSE_FILE) & may(("file",), F.col("text"))),
    }
    none = F.array().cast("array<struct<kind:string,line:int,l:string>>")

    def of_kind(kind: str, found: Column) -> Column:
        named = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["line"].cast("int").alias("line"), s["l"].alias("l")))
        return F.coalesce(named, none)

    parts = [of_kind(kind, found_units) for kind, found_units in kinds.items()]
    return found.select("id", F.explode(F.concat(*parts)).alias("u")).select("id", "u.*")


def notices(files: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """Best notice of each file that has one: ``id, license, similarity, line, unit``; of equal ones the first line and template."""
    key = ["id", "kind", "line", "nth"]
    found = cut_lineage(units(files, weights, threshold).withColumn("nth", F.xxhash64("l")))
    words = found.select(*key, F.explode(_words_of(F.col("l"))).alias("w"))
    words = words.groupBy(*key, "w").agg(F.count("*").alias("tf"))
    spark = files.sparkSession
    idf = F.broadcast(spark.createDataFrame(sorted(weights.idf.items()), "w string, idf double"))
    rows = [(k, kind, name, w, x) for k, (kind, name, v) in enumerate(weights.vectors) for w, x in sorted(v.items())]
    template = F.broadcast(spark.createDataFrame(rows, "template int, kind string, license string, w string, x double"))
    words = words.join(idf, "w", "left").withColumn("y", F.col("tf") * F.coalesce("idf", F.lit(weights.unseen)))
    norms = words.groupBy(*key).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    dots = words.join(template, ["w", "kind"]).groupBy(*key, "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norms, key).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9))
    scored = scored.filter(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "line", "template", "license", "kind")).alias("b")
    return scored.groupBy("id").agg(best).select("id", "b.license", (-F.col("b.s")).alias("similarity"), "b.line", F.col("b.kind").alias("unit"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, path, license, similarity, origin, license_dir, unit`` of every row of ``id, path, text``.

    ``origin`` is 'notice', 'directory' or null, ``unit`` the kind of an own notice.  Among several license files of a directory the most similar, then the
    smallest id, counts.  A null path lies in no directory; null and empty texts hold no notice.  Rows repeated
    with one id share its notice.  An empty table gives none; other columns are left behind.
    """
    files = files.select("id", F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = cut_lineage(notices(files, fit_weights(files, templates), threshold))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    paths = files.select("id", "path", folder.alias("dir"), name.rlike(LICENSE_FILE).alias("is_license"))
    held = paths.filter("is_license").join(found, "id").groupBy("dir")
    held = held.agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id", "license")).alias("b"))
    held = held.select(F.col("dir").alias("license_dir"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_similarity"))
    # Nearest directory above each distinct directory, itself included; '' is the root.
    dirs = paths.select("dir").filter("dir IS NOT NULL").distinct().withColumn("parts", F.split("dir", "/"))
    above = dirs.select(
        "dir",
        F.explode(F.expr("transform(sequence(0, size(parts)), k -> array_join(slice(parts, 1, k), '/'))")).alias("license_dir"),
    ).distinct()
    near = above.join(held, "license_dir").groupBy("dir")
    near = near.agg(F.max(F.struct(F.length("license_dir").alias("d"), "license_dir", "dir_license", "dir_similarity")).alias("b"))
    near = near.select("dir", "b.license_dir", "b.dir_license", "b.dir_similarity")
    out = paths.join(found, "id", "left").join(near, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "id",
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.when(own, F.col("similarity")).otherwise(F.col("dir_similarity")).alias("similarity"),
        F.when(own, "notice").when(F.col("dir_license").isNotNull(), "directory").alias("origin"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
        F.when(own, F.col("unit")).alias("unit"),
    )
