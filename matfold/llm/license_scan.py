"""License scans: texts against licence templates by Dice coefficient over word bigrams.

Units of a document are its lines, its paragraphs (runs of lines that are not
blank), runs of consecutive paragraphs and the whole text; besides these, all
windows of a template's number of words are scored, so that a notice inside a
longer line or across paragraphs is found.  A unit is normalised to lower-case alphanumeric
words; its bigrams and a template's are compared as sets, dice = 2 |A & B| /
(|A| + |B|).  A dice of t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t, so
only templates whose size lies in that range are compared, and a unit needs at
least the matching share of the smallest template's bigrams to be looked at.

A match holds at least t / (2 - t) of a template's bigrams, so it holds one of
any choice of more than the rest of them.  The bigrams of the longest words are
taken (seeds); windows and runs of paragraphs are scored around seeds only, and
none that reaches the threshold is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm import words as W
from matfold.llm.common import column_type, prepare

# Names of licences and the wording of their notices (public texts).
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
PHRASES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.",
           "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}."]
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
           "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
           "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
           "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
           "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
           "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
           "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
           "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
           "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
           "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
               "GNU General Public License for more details. You should have received a copy of the GNU General Public "
               "License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
               "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                 "binary, for any purpose, commercial or non-commercial, and by any means.",
}
GNU = ("either version {0} of the License, or (at your option) any later version. This {1} is distributed in the hope that it will be useful, but WITHOUT "
       "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} Public License for more details. "
       "You should have received a copy of the GNU {2} Public License along with this {1}")
FREE = "This {1} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the Free Software Foundation{4} " + GNU
STREET = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
SITE = ". If not, see https://www.gnu.org/licenses/."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_TWO = ("{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
           "and/or other materials provided with the distribution. ")
BSD_THIRD = ("{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
             "without specific prior written permission. ")
BSD_TAIL = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
            "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
CC = ("This work is licensed under {0} Creative Commons {1} 4.0 International License. To view a copy of this license, visit "
      "http://creativecommons.org/licenses/{2}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")
CC_KINDS = {"CC-BY-4.0": ("Attribution", "by"), "CC-BY-SA-4.0": ("Attribution-ShareAlike", "by-sa"),
            "CC-BY-NC-4.0": ("Attribution-NonCommercial", "by-nc"), "CC-BY-ND-4.0": ("Attribution-NoDerivatives", "by-nd")}
BODIES = [
    *((name, BSD_HEAD + (BSD_TWO + third).format(*marks) + BSD_TAIL) for name, third in (("BSD-2-Clause", ""), ("BSD-3-Clause", BSD_THIRD))
      for marks in (("1. ", "2. ", "3. "), ("* ", "* ", "* "))),
    *((name, FREE.format(version, what, kind, mark, comma) + end) for name, version, what, kind in (
        ("GPL-2.0", "2", "program", "General"), ("GPL-3.0", "3", "program", "General"), ("LGPL-2.1", "2.1", "library", "Lesser General"),
        ("LGPL-3.0", "3", "library", "Lesser General"), ("LGPL-3.0", "3", "program", "Lesser General"), ("AGPL-3.0", "3", "program", "Affero General"))
      for mark, comma, end in ((";", ";", STREET), (":", ",", SITE))),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                "https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain "
                "worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this "
                "software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."),
    *((name, CC.format(article, title, path)) for name, (title, path) in CC_KINDS.items() for article in ("the", "a")),
]
HEADERS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("MIT", "The MIT License (MIT)"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "The ISC License (ISC)"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("CC0-1.0", "CC0 1.0 Universal"),
    *((name, f"{title} 4.0 International Public License") for name, (title, _) in CC_KINDS.items()),
]
# end of fixed values


def default_templates() -> list[tuple[str, str]]:
    """(licence, text) of every notice."""
    short = [(name, p.format(t)) for name, titles in NAMES.items() for t in titles for p in PHRASES]
    return short + list(TEXTS.items()) + BODIES + HEADERS


class Templates:
    """Distinct bigram sets of the templates, by size."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        arr = pa.array([t for _, t in templates], pa.string())
        sets: dict[tuple[str, bytes], np.ndarray] = {}
        spans: dict[tuple[str, bytes], set[int]] = {}
        letters: dict[int, int] = {}
        for i, _, buf, at in W.slices(arr):
            h, row = bigrams(buf, at)
            w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
            size = w.end - w.start
            letters.update(zip(h.tolist(), (size[:-1] + size[1:])[w.room(2)[:-1]].tolist(), strict=True))
            for r in range(len(row) - 1):
                own = np.unique(h[row[r]:row[r + 1]])
                if len(own):
                    key = (templates[i + r][0], own.tobytes())
                    sets[key] = own
                    spans.setdefault(key, set()).add(int(row[r + 1] - row[r]))
        order = sorted(sets, key=lambda k: (len(k[1]), k))
        self.names = [k[0] for k in order]
        self.sets = [sets[k] for k in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.vocabulary = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.threshold = threshold
        low = threshold / (2 - threshold)
        self.least = int(np.ceil(low * self.sizes.min(initial=1 << 60) - 1e-9))
        self.spans = [sorted(spans[k]) for k in order]
        self.needs = [max(1, int(np.ceil(low * len(x) - 1e-9))) for x in self.sets]
        self.seeds: dict[int, list[int]] = {}
        for k, (own, need) in enumerate(zip(self.sets, self.needs, strict=True)):
            for v in sorted(own.tolist(), key=lambda v: (-letters[v], v))[:len(own) - need + 1]:
                self.seeds.setdefault(v, []).append(k)
        self.seed_keys = np.array(sorted(self.seeds), np.uint64)

    def best(self, own: np.ndarray) -> tuple[str, float] | None:
        """The template of the highest dice (then the first name), if that is high enough."""
        t, n = self.threshold, len(own)
        lo, hi = np.searchsorted(self.sizes, [n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9])
        found = []
        for k in range(lo, hi):
            dice = 2 * len(np.intersect1d(own, self.sets[k], assume_unique=True)) / (n + len(self.sets[k]))
            if dice >= t:
                found.append((-dice, self.names[k]))
        return (min(found)[1], -min(found)[0]) if found else None


    def dice(self, own: np.ndarray, k: int) -> float:
        return 2 * len(np.intersect1d(own, self.sets[k], assume_unique=True)) / (len(own) + len(self.sets[k]))

    def inside(self, g: np.ndarray, low: np.ndarray, high: np.ndarray, para: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[bool, int, int, str, float]]:
        """(whether paragraphs, first, end, licence, dice) of windows and of runs of paragraphs that reach the threshold.

        ``g`` are the bigrams at each word, of which the row of word ``p`` owns
        ``low[p]:high[p]``; ``para`` the bounds of the paragraphs in ``g``.
        Windows are places in ``g``, runs of paragraphs numbers of paragraphs.
        """
        if not len(g) or not len(self.seed_keys):
            return
        at = np.minimum(np.searchsorted(self.seed_keys, g), len(self.seed_keys) - 1)
        done: dict[tuple[int, int], int] = {}
        paragraphs, sets = set(), {}
        for p in np.flatnonzero((self.seed_keys[at] == g) & (np.arange(len(g)) < high[:len(g)])).tolist():
            q = int(np.searchsorted(para[0], p, "right")) - 1
            for k in self.seeds[int(g[p])]:
                for span in self.spans[k]:
                    begin = max(int(low[p]), p - span + 1, done.get((k, span), 0))
                    last = min(p, int(high[p]) - span)
                    done[(k, span)] = max(begin, last + 1)
                    if begin > last:
                        continue
                    held = np.r_[0, np.cumsum(np.isin(g[begin:last + span], self.sets[k]))]
                    for x in (begin + np.flatnonzero(held[span:] - held[:-span] >= self.needs[k])).tolist():
                        dice = self.dice(np.unique(g[x:x + span]), k)
                        if dice >= self.threshold:
                            yield False, x, x + span, self.names[k], dice
                most = len(self.sets[k]) * (2 - self.threshold) / self.threshold + 1e-9
                for a in range(q, -1, -1):
                    if para[0][a] < low[p]:
                        break
                    for z in range(q, len(para[0])):
                        if para[0][z] >= high[p]:
                            break
                        if (a, z) not in sets:
                            sets[(a, z)] = np.unique(g[para[0][a]:max(para[0][a], para[1][z] - 1)])
                        own = sets[(a, z)]
                        if len(own) > most:
                            break
                        if a < z and len(own) >= self.needs[k] and (k, a, z) not in paragraphs:
                            paragraphs.add((k, a, z))
                            dice = self.dice(own, k)
                            if dice >= self.threshold:
                                yield True, a, z + 1, self.names[k], dice
                    if len(sets[(a, q)]) > most:
                        break


def bigrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
    g = W.grams(w.hashes(), 2)
    return g[w.room(2)[:len(g)]], np.r_[0, np.cumsum(np.maximum(w.counts - 1, 0))]


def _units(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end line, row) of the lines, paragraphs and whole texts, first and end line of the paragraphs; lines count over the slice."""
    feed = np.flatnonzero(buf == 10)
    row = np.r_[0, np.cumsum(1 + np.diff(np.searchsorted(feed, at)))]
    n = int(row[-1])
    owner = np.repeat(np.arange(len(row) - 1), np.diff(row))
    start = np.sort(np.concatenate([feed + 1, at[:-1]]), kind="stable")
    text = W.words(buf, at, W.BLANK_WORDS)
    filled = np.bincount(np.searchsorted(start, text.start, "right") - 1, minlength=n) > 0
    line = np.flatnonzero(filled)
    lead = np.r_[True, (line[1:] != line[:-1] + 1) | (owner[line[1:]] != owner[line[:-1]])][:len(line)]
    para = line[lead]
    para_end = np.r_[line[np.flatnonzero(lead)[1:] - 1], line[-1:]] + 1
    text_rows = np.unique(owner[line])
    first = np.concatenate([line, para, row[:-1][text_rows]])
    end = np.concatenate([line + 1, para_end, row[1:][text_rows]])
    keep = np.unique(np.stack([first, end], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
    return keep[:, 0], keep[:, 1], row, para, para_end


def _apart(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of windows that overlap the one of the highest dice (then the longest, the first, the first name)."""
    out: list[tuple[int, int, str, float]] = []
    held: set[int] = set()
    for x in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        if held.isdisjoint(range(x[0], x[1] + 1)):
            held.update(range(x[0], x[1] + 1))
            out.append(x)
    return sorted(out)


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.9,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_units, license, dice, matches).

    ``matches`` are the units with a template of at least ``threshold``, as
    (first_line, end_line, license, dice), the best template of each; units of
    the same lines count once.  Windows of words follow with the lines they
    reach, those of the highest dice where they overlap, unless a unit around
    them matches the same licence as well; ``n_units`` counts lines, paragraphs
    and texts.  ``license`` and ``dice`` are the best match's
    (then the first by lines), null without one.  Null and empty texts have no
    units; repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.  The template list is an argument and
    travels with the task.
    """
    prepare(docs.sparkSession)
    kind = column_type(docs, id_col)
    given = list(templates if templates is not None else default_templates())
    schema = f"id {kind}, n_units long, matches array<struct<first_line:int,end_line:int,license:string,dice:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(given, threshold)
        item = pa.struct([("first_line", pa.int32()), ("end_line", pa.int32()), ("license", pa.string()), ("dice", pa.float64())])
        for b in batches:
            for i, j, buf, at in W.slices(b.column(1)):
                first, end, row, para, para_end = _units(buf, at)
                start = np.sort(np.concatenate([np.flatnonzero(buf == 10) + 1, at[:-1]]), kind="stable")
                w = W.words(buf, at, W.ALNUM_WORDS_LOWER)
                g = W.grams(w.hashes(), 2)
                inside = w.room(2)[:len(g)]
                line = np.searchsorted(start, w.start, "right") - 1
                place = np.minimum(np.searchsorted(known.vocabulary, g), max(0, len(known.vocabulary) - 1))
                hit = inside & (known.vocabulary[place] == g) if len(known.vocabulary) else np.zeros(len(g), bool)
                total = np.r_[0, np.cumsum(hit)]
                a = np.searchsorted(line, first)
                z = np.maximum(np.searchsorted(line, end) - 1, a)  # a unit's bigrams begin before its last word
                owner = np.searchsorted(row, first, "right") - 1
                matches: list[list[dict]] = [[] for _ in range(j - i)]
                for u in np.flatnonzero(total[np.minimum(z, len(g))] - total[np.minimum(a, len(g))] >= known.least):
                    best = known.best(np.unique(g[a[u]:z[u]]))
                    if best:
                        r = owner[u]
                        matches[r].append({"first_line": int(first[u] - row[r]), "end_line": int(end[u] - row[r]), "license": best[0], "dice": best[1]})
                low, high = np.repeat(w.row[:-1], w.counts), np.repeat(w.row[1:] - 1, w.counts)
                windows, runs = [], {}
                for whole, x, y, name, dice in known.inside(g, low, high, (np.searchsorted(line, para), np.searchsorted(line, para_end))):
                    if whole:
                        runs[(x, y)] = min(runs.get((x, y), (0.0, "")), (-dice, name))
                    else:
                        windows.append((x, y, name, dice))
                text = {(int(first[u]), int(end[u])) for u in np.flatnonzero((first == row[owner]) & (end == row[owner + 1]))} if runs else set()
                for (x, y), (dice, name) in sorted(runs.items()):
                    u = (int(para[x]), int(para_end[y - 1]))
                    r = int(np.searchsorted(row, u[0], "right")) - 1
                    if u not in text:
                        matches[r].append({"first_line": int(u[0] - row[r]), "end_line": int(u[1] - row[r]), "license": name, "dice": -dice})
                for x, y, name, dice in _apart(windows):
                    r = int(np.searchsorted(row, line[x], "right")) - 1
                    new = {"first_line": int(line[x] - row[r]), "end_line": int(line[y] + 1 - row[r]), "license": name, "dice": dice}
                    if not any(m["license"] == name and m["dice"] >= dice and m["first_line"] <= new["first_line"] and m["end_line"] >= new["end_line"] for m in matches[r]):
                        matches[r].append(new)
                units = np.bincount(owner, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(units), pa.array(matches, pa.list_(item))], ["id", "n_units", "matches"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = src.mapInArrow(run, schema)
    best = F.try_element_at(F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["first_line"].alias("f"), m["end_line"].alias("e"), m["license"].alias("l")))), F.lit(1))
    return out.select(F.col("id").alias(id_col), "n_units", best["l"].alias("license"), (-best["d"]).alias("dice"), "matches")
