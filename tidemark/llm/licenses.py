"""Licence scans: TF-IDF cosine of header blocks and licence files to templates, inherited along directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, dropped_since, mark, stored
from tidemark.llm.text import small, words

# SPDX identifiers, the standard texts, notices and grants of each licence, and sentences that name it.
_NAMED = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT OR GPL-2.0", "Dual licensed under the MIT or GPL Version 2 licenses."),
)
#: Titles, by which whole texts of licences are told apart.
_TITLES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Artistic-1.0", 'The "Artistic License" Preamble'),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{1} either version {3} of the License, or (at your option) any later version."
_GNU_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
_APACHE_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_CC = "This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{1}/4.0/."
_SPDX = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: (short name, text): each text is compared on its own, so a licence with several has several.
TEMPLATES = (
    *_NAMED,
    *_TITLES,
    *((name, f"SPDX-License-Identifier: {name}{form}") for name in _SPDX for form in (("", "-only", "-or-later") if "GPL" in name else ("",))),
    *((name, _GNU.format(thing, mark, kind, version)) for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")) for thing, mark in (("program", ":" if version == "3" else ";"), ("library", ";"))),
    *((name, _GNU.format("program", ":", kind, version) + " " + _GNU_WARRANTY.format("program", kind)) for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_THIRD + _BSD_AS_IS),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_AS_IS),
    ("ISC", _ISC_GRANT),
    ("ISC", _ISC_GRANT + _ISC_AS_IS),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_AS_IS),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("CC-BY-4.0", _CC.format("Attribution", "by")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "by-sa")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "by-nc")),
)
#: Blocks are looked for around a line with one of these words; every template has one, wherever its lines are cut.
MARKERS = ("licence", "licenced", "license", "licensed", "licenses", "spdx-license-identifier", "permission", "permissions", "permit", "permitted", "redistribute", "redistribution", "redistributions", "sublicense", "copyright", "waived", "warranty", "warranties", "merchantability", "liable", "liability", "gnu", "mozilla", "domain", "as-is", "cc0")
MARKER = rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(MARKERS)})(?:[^\p{{L}}\p{{N}}]|$)"
#: Markers at most so many lines apart are of one region. In regions of up to REGION lines a block begins at any line, or
#: at one of the two before them, and has any of SPANS lines. In longer ones (licences' whole texts) that holds for the
#: first HEAD lines; beyond, blocks of STRIDED lines begin at each quarter of their length. Markers' lines are blocks, too,
#: alone and with a neighbour. So a text's blocks together are about 35 times as long as it is, at most.
GAP, REGION, HEAD = 12, 34, 6
SPANS, STRIDED = (3, 4, 5, 6, 8, 10, 13, 17, 21, 27, 34), (5, 8, 13, 21, 34)
#: Blocks of more than one line and of more distinct words are left out: the longest template has a third of them.
MAX_WORDS = 600
#: Licences joined by operators, as SPDX writes them.
SPDX_EXPRESSION = r"(?i)SPDX-License-Identifier:[\x20\t]*(\(?[A-Z0-9.+-]+\)?(?:[\x20\t]+(?:OR|AND|WITH)[\x20\t]+\(?[A-Z0-9.+-]+\)?)+)"
MIN_COSINE = 0.75
#: Files of these names are licence files if they match at all.
FILE_NAMES = r"(?i)^(?:licen[cs]es?|copying|unlicense|notice)(?:[.-][^/]*)?$"
_COUNT = r"[^\x20\x09-\x0D]+"


def _keys(column: str, name: str) -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    return F.xxhash64(column).alias(f"{name}1"), F.xxhash64(F.lit(1), column).alias(f"{name}2")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits, dots and hyphens, without dots or hyphens at their ends."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.-]+", " "), r"(?<![^ ])[.-]+|[.-]+(?![^ ])", "")
    return F.filter(words(cleaned), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The text's lines, cut behind sentence marks too: a licence in the middle of a long line is a line of its own."""
    return F.split(F.regexp_replace(text, r"([.;!?])[\x20\t]+", "$1\n"), "\r?\n")


def _spans(at: Column, size: Column) -> Column:
    """Distinct (start, n) of the blocks around the lines ``at``, which are in order, of a text of ``size`` lines."""
    heads = F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > GAP))
    tails = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - x > GAP))
    span = lambda start, n: F.struct(F.greatest(start, F.lit(0)).cast("int").alias("start"), n.cast("int").alias("n"))
    few = F.flatten(F.transform(at, lambda x: F.array(span(x, F.lit(1)), span(x, F.lit(2)), span(x - 1, F.lit(2)))))

    def every(first: Column, last: Column) -> Column:
        return F.flatten(F.transform(F.sequence(first, last), lambda s: F.array(*(span(s, F.lit(n)) for n in SPANS))))

    def spaced(first: Column, last: Column, n: int) -> Column:
        return F.transform(F.sequence(first, last, F.lit(max(n // 4, 1))), lambda s: span(s, F.lit(n)))

    def strided(first: Column, last: Column) -> Column:
        return F.concat(*(spaced(first, last, n) for n in STRIDED))

    def near(first: Column, last: Column) -> Column:
        return F.when(last - first < REGION, every(first - 2, last)).otherwise(F.concat(every(first - 2, first + (HEAD - 1)), strided(first, last)))

    regions = F.flatten(F.zip_with(heads, tails, near))
    inside = F.filter(F.concat(few, regions), lambda s: s["start"] < size)
    return F.array_distinct(F.transform(inside, lambda s: span(s["start"], F.least(s["n"], size - s["start"]))))


def blocks(texts: DataFrame) -> DataFrame:
    """(row, start, n, block) of ``texts`` (row, text): the blocks of lines near a marker, joined by spaces.

    All of a text's blocks are cut out where it lies: neither it nor its lines are copied for each block or shuffled.
    """
    marked = texts.where(F.col("text").rlike(MARKER)).select("row", lines_of(F.col("text")).alias("lines"))
    placed = marked.select("row", "lines", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(MARKER), i)), lambda i: i.isNotNull()).alias("at"))
    spanned = placed.select("row", "lines", _spans(F.col("at"), F.size("lines")).alias("spans"))
    cut = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.concat_ws(" ", F.slice("lines", s["start"] + 1, s["n"])).alias("block")))
    made = spanned.select("row", F.explode(cut).alias("b")).select("row", "b.start", "b.n", "b.block")
    return made.where((F.col("n") == 1) | (F.size(F.array_distinct(words(F.col("block")))) <= MAX_WORDS))


def score_blocks(units: DataFrame) -> DataFrame:
    """(u1, u2, block, license, cosine) of distinct ``units`` (block) that come near a template; the nearest, ties by name.

    ``u1`` and ``u2`` are two hashes of the block, by which blocks are told apart.

    Weights are tf * idf. idf is taken over the templates and all distinct blocks of the corpus, in which a text repeated
    by a thousand files counts once; terms of no template add to a block's length only. A block that states several
    licences as SPDX does (``OR``, ``AND``, ``WITH``) has that expression, with a cosine of 1.
    """
    spark = units.sparkSession
    kinds = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, license string, block string")
    keyed = stored(units.select(*_keys("block", "u"), "block"), "license-units")
    bag = stored(keyed.select("u1", "u2", F.explode(terms(F.col("block"))).alias("term")).groupBy("u1", "u2", "term").agg(F.count("*").alias("tf")), "license-terms")
    known = kinds.select("template", F.explode(terms(F.col("block"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    n = keyed.count() + len(TEMPLATES)
    seen = bag.select("term").unionAll(known.select("term")).groupBy("term").agg((F.log(F.lit(float(n + 1)) / (F.count("*") + 1)) + 1).alias("idf"))
    idf = small(stored(seen, "license-idf"))
    weighed = bag.join(idf, "term").select("u1", "u2", "term", (F.col("tf") * F.col("idf")).alias("w"))
    vectors = stored(known.join(idf, "term").select("template", "term", (F.col("tf") * F.col("idf")).alias("v")), "license-templates")
    sizes = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    # the templates are a fixed list: their terms and sizes are small
    lists = F.broadcast(vectors.groupBy("term").agg(F.collect_list(F.struct("template", "v")).alias("ts")))
    each = weighed.join(lists, "term", "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<struct<template:int,v:double>>")))
    length = each.groupBy("u1", "u2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dot = each.select("u1", "u2", "w", F.explode("ts").alias("t")).groupBy("u1", "u2", "t.template").agg(F.sum(F.col("w") * F.col("t.v")).alias("dot"))
    near = dot.join(F.broadcast(sizes), "template").join(length, ["u1", "u2"]).withColumn("cosine", F.col("dot") / (F.col("size") * F.col("length"))).where(F.col("cosine") >= MIN_COSINE)
    best = F.min_by(F.struct("license", "cosine"), F.struct(-F.round("cosine", 9), F.col("license")))
    stated = F.regexp_replace(F.regexp_extract("block", SPDX_EXPRESSION, 1), r"[\x20\t]+", " ")
    exact = keyed.select("u1", "u2", stated.alias("license"), F.lit(1.0).alias("cosine")).where("license <> ''")
    named = near.join(F.broadcast(kinds.select("template", "license")), "template").select("u1", "u2", "license", "cosine")
    found = named.unionAll(exact).groupBy("u1", "u2").agg(best.alias("b"))
    return keyed.join(small(stored(found.select("u1", "u2", "b.license", "b.cosine"), "license-near")), ["u1", "u2"]).select("u1", "u2", "block", "license", "cosine")


def _steps(path: Column) -> Column:
    return F.split(path, "/")


def _directories(path: Column) -> Column:
    """The path's directories from the nearest to the root ``''``."""
    return F.transform(F.sequence(F.size(_steps(path)) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(_steps(path), F.lit(1), i), "/"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, path, license, cosine, how, from_id) of every row of ``files``.

    ``how``: "own" if a block of the whole text comes near a template (the nearest; ties by name), "inherited" if not but
    a directory above holds a licence file (then ``license`` is that of the nearest such directory and ``from_id`` its
    file; of several the highest cosine, then the least id), else "none". A licence file is one that has at most 20
    words besides its matching blocks', or a matching file named like one. Files are grouped by directory before the path
    join, so each distinct directory is resolved once; the root is a key of the sources alone, which are counted and
    broadcast if few. Null and empty texts match nothing, null paths inherit nothing; repeated rows give a row each; a
    very long line is cut at sentence marks; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.regexp_count(text, F.lit(_COUNT)).alias("n_words"), F.when(text.rlike(MARKER), text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "license-files")
    each, at = stored(blocks(rows), "license-blocks"), mark()
    scored = stored(score_blocks(each.select("block").distinct()).select("u1", "u2", "license", "cosine"), "license-scores")
    dropped_since(at, scored)
    matched = stored(each.select("row", "start", "n", *_keys("block", "u")).join(small(scored), ["u1", "u2"]).select("row", "start", "n", "license", "cosine"), "license-matches")
    best = F.min_by(F.struct("license", "cosine"), F.struct(-F.round("cosine", 9), F.col("license")))
    counted = rows.where("text is not null").join(small(matched.select("row").distinct()), "row").select("row", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    covered = matched.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().join(counted, ["row", "at"]).groupBy("row").agg(F.sum(F.regexp_count("line", F.lit(_COUNT))).alias("covered"))
    own = stored(matched.groupBy("row").agg(best.alias("b")).join(covered, "row").select("row", "b.license", "b.cosine", "covered"), "license-own")

    named = F.element_at(_steps(F.col("path")), -1).rlike(FILE_NAMES)
    placed = rows.select("row", "id", "path", "n_words", _directories(F.col("path"))[0].alias("dir")).select("*", *_keys("dir", "d"))
    joined = placed.join(small(own), "row", "left").withColumn("is_file", (F.col("n_words") - F.col("covered") <= 20) | (F.col("covered").isNotNull() & named))
    pick = F.min_by(F.struct("license", F.col("id").alias("from_id")), F.struct(-F.round("cosine", 9), "id"))
    sources = stored(joined.where("is_file and dir is not null").groupBy("d1", "d2").agg(pick.alias("p")).select("d1", "d2", "p.license", "p.from_id"), "license-sources")
    dirs = placed.where("dir is not null").select("dir").distinct()
    up = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.size(_steps(F.col("dir"))), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(_steps(F.col("dir")), F.lit(1), i), "/"))).alias("rise", "above"))
    nearest = stored(up.select(*_keys("dir", "e"), "rise", *_keys("above", "d")).join(small(sources), ["d1", "d2"]).groupBy("e1", "e2").agg(F.min_by(F.struct("license", "from_id"), "rise").alias("n")).select(F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.col("n.license").alias("up_license"), F.col("n.from_id").alias("up_id")), "license-nearest")
    dropped(each, scored, matched, sources)
    out = joined.join(small(nearest), ["d1", "d2"], "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("up_license").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("license", "up_license").alias("license"), F.round("cosine", 6).alias("cosine"), how.alias("how"), F.when(how == "own", F.col("id")).when(how == "inherited", F.col("up_id")).alias("from_id"))
