"""License notices and texts found by MinHash bands over overlapping windows, in DataFrame operations only.

Templates are in shelves by length. A shelf whose longest template has L words cuts texts into windows
of 2 L words (``WINDOW`` for notices) every L / 2 words, so that any span of up to one and a half
times its longest template (of ``WINDOW - STRIDE`` words and one more, for notices) is whole in some window. A
window and a template meet if one of ``BANDS`` bands of one MinHash each agrees, with
probability s for a Jaccard similarity s of their three-word shingles. A notice of three shingles wholly in a window has at
least s = 3/22, and a text wholly in a window of its shelf at least about 1/4, where the shelf's shortest text
has half the words of its longest; so a pair that has to be found is missed with a probability of at most
(1 - 3/22)^96 < 10^-6. Sharing the template's shingles only in part, as an edited copy does, costs little:
at a similarity of 0.1 it is 4 * 10^-5. The exact share of the template's shingles in the window then decides.

Band k of a template agrees with a window if the template's least shingle under hash k is in the window and is the
window's least, too. So the bands are looked up from the templates' side: only windows that hold a least
shingle of some band have a signature to compute, as no band of any other window can agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import let, read_table

WINDOW = 24
STRIDE = 12
SHINGLE = 3
BANDS = 96
CONTAINMENT = 0.95
#: Notices of 5 to 13 words.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
_GNU = "under the terms of the GNU {} as published by the Free Software Foundation{} version {} of the License"
#: License texts, or the parts of them that name no holder, and headers. GNU headers end before "or any later version".
TEXTS = {
    "apache-2.0-header": _APACHE,
    "bsd-conditions": _BSD,
    "bsd-no-endorsement": _BSD_NAMES,
    "isc-text": _ISC,
    "mit-text": _MIT,
    "mpl-2.0-header": _MPL,
    "unlicense-text": _UNLICENSE,
    "agpl-3.0-header": _GNU.format("Affero General Public License", ", either", 3),
    "gpl-2.0-header": _GNU.format("General Public License", "; either", 2),
    "gpl-2.0-header-plain": _GNU.format("General Public License", ";", 2),
    "gpl-3.0-header": _GNU.format("General Public License", ", either", 3),
    "gpl-3.0-header-plain": _GNU.format("General Public License", ",", 3),
    "lgpl-2.1-header": _GNU.format("Lesser General Public License", "; either", "2.1"),
    "lgpl-3.0-header": _GNU.format("Lesser General Public License", ", either", 3),
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    three = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    )
    return let(words, lambda w: F.when(F.size(w) >= SHINGLE, three(w)))


def signature(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))).alias("least")))


def shelves(templates: dict[str, str], texts: dict[str, str]) -> list[tuple[int, int, dict[str, str]]]:
    """Window, stride and templates: the notices, and each size class of texts."""
    found = [(WINDOW, STRIDE, templates)] if templates else []
    classes: dict[int, dict[str, str]] = {}
    for name, text in texts.items():
        classes.setdefault(len(words_of(text)).bit_length(), {})[name] = text
    for _, own in sorted(classes.items()):
        longest = max(len(words_of(t)) for t in own.values())
        found.append((2 * longest, max(1, longest // 2), own))
    return found


def grams(text: str) -> list[tuple[str, ...]]:
    words = words_of(text)
    return list(dict.fromkeys(zip(*[words[k:] for k in range(SHINGLE)], strict=False)))


def split_by_length(templates: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Notices, and longer templates."""
    notices = {k: t for k, t in templates.items() if len(words_of(t)) <= WINDOW - STRIDE + 1}
    return notices, {k: t for k, t in templates.items() if k not in notices}


def shelf_table(spark: SparkSession, kinds: list[tuple[int, int, dict[str, str]]]) -> DataFrame:
    """A row for each shelf, license and band: its ``least`` hash, the shingle that has it (``shingle``),
    and all of the license's shingles (``wanted``). As many rows as templates have bands."""
    rows = [(i, k, [list(g) for g in grams(t)]) for i, (_, _, own) in enumerate(kinds) for k, t in own.items()]
    table = spark.createDataFrame(rows, "shelf int, license string, grams array<array<string>>")
    wanted = F.transform("grams", lambda g: F.xxhash64(*[F.get(g, k) for k in range(SHINGLE)]))
    table = table.select("shelf", "license", wanted.alias("wanted"))
    least = lambda k: F.array_min(F.transform("wanted", lambda h: F.struct(F.xxhash64(h, k).alias("least"), h.alias("shingle"))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), least(k).alias("m")))
    return table.select("shelf", "license", "wanted", F.explode(bands).alias("s")).select("shelf", "license", "wanted", "s.band", "s.m.least", "s.m.shingle")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per ``doc_id`` and license found: ``windows`` that have it, ``containment``, the
    highest share of its shingles in one window, and ``first_word``, the first such
    window's first word, from 0.

    ``templates`` and ``texts`` are of three words or more and of any length, without names in common;
    each is in the windows of its length. ``TEMPLATES`` and ``TEXTS`` if neither is given.
    Null and empty texts, and texts under three words, have none, and an empty table gives an empty one; texts of any
    length are scanned whole. Rows with the same doc_id, null among them, are taken together, and repeated
    rows count their windows once. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    if texts is None:
        texts = TEXTS if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    for name, text in [*templates.items(), *texts.items()]:
        if len(words_of(text)) < SHINGLE:
            raise ValueError(f"{name} must have {SHINGLE} words")
    if set(templates) & set(texts):
        raise ValueError("a name is both a template and a text")
    notices, longer = split_by_length(templates | texts)
    kinds = shelves(notices, longer)
    shelf = shelf_table(spark, kinds)
    # The least shingles of all bands, by shelf: a fixed list, as the templates are.
    found = {r["shelf"]: r["all"] for r in shelf.groupBy("shelf").agg(F.sort_array(F.collect_set("shingle")).alias("all")).collect()}
    least = [F.array(*map(F.lit, found[i])) for i in range(len(kinds))]

    # Window starts: one more for as long as words lie beyond the last.
    def starts(i: int) -> Column:
        window, stride, _ = kinds[i]
        last = F.greatest(F.lit(0), F.size("all") + (SHINGLE - 1) - window + stride - 1)
        own = F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: F.struct(F.lit(i).alias("shelf"), F.lit(window).alias("window"), s.alias("start")))
        return F.when(F.arrays_overlap("all", least[i]), own).otherwise(F.slice(own, 1, 0))

    rows = docs.select("doc_id", shingle_hashes(F.col("text")).alias("all")).where("all is not null")
    rows = rows.select("doc_id", "all", F.explode(F.concat(*[starts(i) for i in range(len(kinds))])).alias("at"))
    rows = rows.select("doc_id", "at.shelf", "at.start", F.slice("all", F.col("at.start") + 1, F.col("at.window") - SHINGLE + 1).alias("own"))
    holds = F.lit(False)
    for i, own in enumerate(least):
        holds = F.when(F.col("shelf") == i, F.arrays_overlap("own", own)).otherwise(holds)
    rows = rows.where(holds)
    bands = rows.select("doc_id", "shelf", "start", "own", F.explode(signature(F.col("own"))).alias("s")).select("doc_id", "shelf", "start", "own", "s.*")
    # The shelf has BANDS rows a template: a fixed list.
    met = bands.join(F.broadcast(shelf), ["shelf", "band", "least"])
    share = F.size(F.array_intersect("own", "wanted")) / F.size("wanted")
    met = met.select("doc_id", "start", "license", share.alias("share")).where(F.col("share") >= containment)
    once = met.groupBy("doc_id", "license", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(F.count("*").alias("windows"), F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """SQL of all templates: each in the windows of its shelf, by exact shares."""
    notices, longer = split_by_length(TEMPLATES | TEXTS)
    rows = [(k, " ".join(words_of(t)), window, stride) for window, stride, own in shelves(notices, longer) for k, t in own.items()]
    values = ", ".join(f"('{k}', '{words}', {window}, {stride})" for k, words, window, stride in rows)
    three = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])"
    return f"""
WITH t(license, words, win, stride) AS (VALUES {values}),
ts AS MATERIALIZED (SELECT license, win, stride, list_distinct({three}) AS wanted FROM (SELECT license, win, stride, string_split(words, ' ') AS w FROM t)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, {three} AS s FROM d WHERE len(w) >= 3),
c AS MATERIALIZED (SELECT doc_id, s, license, win, stride, wanted FROM s JOIN ts ON len(list_intersect(s, wanted)) >= {CONTAINMENT} * len(wanted)),
win AS (SELECT doc_id, license, wanted, st AS start, s[st + 1 : st + win - {SHINGLE - 1}] AS own
        FROM (SELECT *, unnest(range(0, greatest(0, len(s) + {SHINGLE - 1} - win + stride - 1) + 1, stride)) AS st FROM c)),
hit AS (SELECT doc_id, start, license, CAST(len(list_intersect(own, wanted)) AS DOUBLE) / len(wanted) AS share FROM win)
SELECT doc_id, license, count(*) AS windows, max(share) AS containment, CAST(min(start) AS BIGINT) AS first_word
FROM hit WHERE share >= {CONTAINMENT} GROUP BY doc_id, license
"""


ORACLES = {"op10_license_scan": _oracle()}
