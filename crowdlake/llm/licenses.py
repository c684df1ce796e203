"""License scans: winnowed template fingerprints pick candidates, banded alignment reports what matches.

Templates are cut into overlapping three-word grams; of each window of three grams the one of least hash goes
into an inverted index, and of short templates every gram. Besides, each template has anchors, of which every
text that can match has one: its deciding words, or its longest words, one more than may be missing. A text is
read once, gram by gram. Where it meets the index, the template is aligned with that part of the text inside a
band around the diagonal, which gives the matched share of the template and the span of the text. The deciding
words (name, version, variant) must stand in the span without a gap.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.llm.common import small_batches

GRAM, WINDOW = 3, 3
#: Templates of at most so many words are indexed with all their grams.
SHORT = 16

# Notices of public licenses, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the'
        " specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-3-Clause notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
        " distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
        " promote products derived from this software without specific prior written permission."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "All rights reserved": "All rights reserved.",
    "MIT-0": "Released under the MIT-0 License.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "ISC": "Released under the ISC License.",
    "ISC notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}
_BSD = TEMPLATES["BSD-3-Clause notice"]
_NEITHER = _BSD.index(" Neither the name")
TEMPLATES["BSD-2-Clause notice"] = _BSD[:_NEITHER]
TEMPLATES["BSD-4-Clause notice"] = (
    _BSD[:_NEITHER] + " All advertising materials mentioning features or use of this software must display the following"
    " acknowledgement: This product includes software developed by the organization." + _BSD[_NEITHER:]
)

#: By template, the words that tell it from its neighbours: phrases of which each must stand in the matched span
#: without a gap. ``|`` parts forms of one phrase.
DECIDING = {
    "Apache-2.0": ("apache license", "2 0"),
    "Apache-2.0 header": ("apache license", "2 0"),
    "MIT": ("mit",),
    "MIT-0": ("mit 0",),
    "MIT notice": ("shall be included in all copies",),
    "BSD": ("bsd license",),
    "BSD-2-Clause": ("bsd 2 clause",),
    "BSD-3-Clause": ("bsd 3 clause",),
    "BSD-2-Clause notice": ("redistributions in binary form",),
    "BSD-3-Clause notice": ("neither the name", "redistributions in binary form"),
    "BSD-4-Clause notice": ("all advertising materials", "neither the name"),
    "ISC": ("isc",),
    "ISC notice": ("permission to use copy modify", "appear in all copies"),
    "MPL-2.0": ("mozilla", "v 2 0|version 2 0|mpl 2 0"),
    "All rights reserved": ("all rights reserved",),
}
# Whole bodies of short licenses.
TEMPLATES["MIT body"] = TEMPLATES["MIT notice"] + (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
for _kind in ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"):
    TEMPLATES[f"{_kind} body"] = TEMPLATES[f"{_kind} notice"] + _AS_IS
TEMPLATES["ISC body"] = TEMPLATES["ISC notice"] + (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
    " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES["Zlib body"] = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
    " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
    " for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
    " following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you"
    " wrote the original software. If you use this software in a product, an acknowledgment in the product documentation"
    " would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be"
    " misrepresented as being the original software. 3. This notice may not be removed or altered from any source"
    " distribution."
)
TEMPLATES["Unlicense"] = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
    " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
    " commercial or non-commercial, and by any means."
)
# Titles that stand above a whole license.
TEMPLATES |= {
    "MIT title": "The MIT License (MIT)",
    "Apache-2.0 title": "Apache License Version 2.0, January 2004",
    "MPL-2.0 title": "Mozilla Public License Version 2.0",
    "GPL-2.0 title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0 title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1 title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0 title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0 title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
}
DECIDING |= {
    "MIT body": ("shall be included in all copies", "noninfringement"),
    "BSD-2-Clause body": ("redistributions in binary form",),
    "BSD-3-Clause body": ("neither the name", "redistributions in binary form"),
    "BSD-4-Clause body": ("all advertising materials", "neither the name"),
    "ISC body": ("permission to use copy modify", "appear in all copies"),
    "Zlib body": ("altered source versions",),
    "Unlicense": ("free and unencumbered",),
}
for _key, _text in TEMPLATES.items():
    if _key.endswith(" title"):
        DECIDING[_key] = (" ".join(re.findall(r"\w+", _text.lower())),)
# Machine-readable tags, by the identifiers of the public list.
for _key in (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0"
    " CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 EPL-1.0 EPL-2.0"
    " EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later"
    " LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense WTFPL"
    " X11 Zlib ZPL-2.1"
).split():
    TEMPLATES[f"{_key} tag"] = f"SPDX-License-Identifier: {_key}"
    DECIDING[f"{_key} tag"] = (" ".join(re.findall(r"\w+", TEMPLATES[f"{_key} tag"].lower())),)
# The GNU licenses, in short forms and with the header of a file.
for _kind, _name, _versions in (("GPL", "", "23"), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", "3")):
    for _v in _versions:
        _key, _gnu = f"{_kind}-{_v if '.' in _v else _v + '.0'}", f"gnu {_name.lower()}general"
        _head = (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
            f" {_name}General Public License as published by the Free Software Foundation,"
        )
        _any = f"{_head} either version {_v} of the License, or (at your option) any later version."
        TEMPLATES.setdefault(_key, f"This work is licensed under the GNU {_name}General Public License, version {_v}.")
        TEMPLATES[f"{_key} short"] = f"This work is licensed under the GNU {_name}General Public License v{_v}."
        TEMPLATES[f"{_key} abbreviated"] = f"distributed under the terms of the GNU {_kind} version {_v}"
        TEMPLATES[f"{_key} abbreviation"] = f"licensed under the {_kind}v{_v}"
        TEMPLATES.setdefault(f"{_key}-or-later header", _any)
        TEMPLATES.setdefault(f"{_key}-only header", f"{_head} version {_v} of the License.")
        _n = _v.replace(".", " ")
        DECIDING[_key] = DECIDING[f"{_key}-only header"] = _gnu, f"version {_n}"
        DECIDING[f"{_key} abbreviated"] = f"gnu {_kind.lower()} version {_n}|gnu {_kind.lower()} v{_n}|gnu {_kind.lower()}v{_n}",
        DECIDING[f"{_key} abbreviation"] = (f"under the {_kind.lower()}v{_n}|under {_kind.lower()}v{_n}",)
        DECIDING[f"{_key} short"] = _gnu, f"v{_n}"
        DECIDING[f"{_key}-or-later header"] = _gnu, f"version {_n}", "any later version"
# The Creative Commons licenses of each version.
for _v, _law in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
    for _short, _long in (
        ("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"),
        ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"),
    ):
        _texts = (
            (f"Licensed under CC {_short} {_v}.", f"cc {_short} {_v}"),
            (f"This work is licensed under a Creative Commons Attribution{_long} {_v} {_law} License.", f"attribution{_long} {_v}"),
        )
        for _text, _phrase in _texts:
            _key = f"CC-{_short}-{_v}" + (" notice" if _phrase.startswith("a") else "")
            if _text == TEMPLATES["CC-BY-SA-4.0"]:
                _key = "CC-BY-SA-4.0"
            elif _key == "CC-BY-SA-4.0":
                _key = "CC-BY-SA-4.0 short"
            TEMPLATES.setdefault(_key, _text)
            DECIDING[_key] = (" ".join(re.findall(r"\w+", _phrase.lower())),)

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def winnowed(tokens: list[str]) -> set[int]:
    """Positions of the grams that are least in a window of WINDOW grams; the rightmost of equals."""
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + GRAM])) for i in range(max(1, len(tokens) - GRAM + 1))]
    n = max(1, len(hashes) - WINDOW + 1)
    return {min(range(i, min(i + WINDOW, len(hashes))), key=lambda j: (hashes[j], -j)) for i in range(n)}


class Index:
    """Inverted index from the grams of winnowed fingerprints, and from anchors, to (template, position)."""

    def __init__(self, templates: tuple[tuple[str, str], ...], deciding: tuple[tuple[str, tuple[str, ...]], ...] = (), least: float = 0.8):
        self.names = [name for name, _ in templates]
        self.tokens = [words(text) for _, text in templates]
        self.least = least
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        self.anchors: dict[str, list[tuple[int, int, tuple[str, ...]]]] = defaultdict(list)
        #: For each template its deciding phrases, each as forms with spaces around.
        self.deciding: list[list[list[str]]] = []
        given = dict(deciding)
        for t, tokens in enumerate(self.tokens):
            if len(tokens) < GRAM:
                raise ValueError(f"template {self.names[t]!r} has fewer than {GRAM} words")
            for j in range(len(tokens) - GRAM + 1) if len(tokens) <= SHORT else winnowed(tokens):
                self.grams[tuple(tokens[j : j + GRAM])].append((t, j))
            whole = f" {' '.join(tokens)} "
            phrases = [[f" {form} " for form in phrase.split("|")] for phrase in given.get(self.names[t], ())]
            # A template of the user's under a known name has its own words.
            phrases = [forms for forms in phrases if any(form in whole for form in forms)]
            self.deciding.append(phrases)
            if phrases:
                # Each match has one of the first phrase's forms, wherever that stands in the template.
                j = next(whole[: whole.index(form) + 1].count(" ") - 1 for form in phrases[0] if form in whole)
                for form in phrases[0]:
                    self.anchors[form.split()[0]].append((t, j, tuple(form.split())))
            else:
                missing = int((1 - least) * len(tokens) + 1e-9)
                for j in sorted(range(len(tokens)), key=lambda j: -len(tokens[j]))[: missing + 1]:
                    self.anchors[tokens[j]].append((t, j, (tokens[j],)))
        self.grams, self.anchors = dict(self.grams), dict(self.anchors)
        self.sets = [frozenset(tokens) for tokens in self.tokens]

    def band(self, t: int) -> int:
        """As many words as a match may insert or miss."""
        return max(4, math.ceil(len(self.tokens[t]) * max(1 - self.least, 1 / self.least - 1)))

    def decided(self, t: int, found: list[str], a: int, b: int) -> bool:
        """Whether the words from ``a`` to ``b`` have a form of each deciding phrase of the template."""
        part = f" {' '.join(found[max(0, a) : b + 1])} "
        return all(any(form in part for form in forms) for forms in self.deciding[t])

    def align(self, t: int, found: list[str], start: int, band: int) -> tuple[int, int, int]:
        """Matched words of template ``t`` and the first and last of them in ``found``, by banded alignment.

        The template is to start near ``start``; at each template word the text may be ``band`` words off.
        The longest common subsequence within the band; of equals the shortest span, then the first.
        """
        none = (0, 0, -1, -1)  # matched, minus the span, first, last
        row = [none] * (2 * band + 1)
        for j, word in enumerate(self.tokens[t]):
            new = []
            for d in range(2 * band + 1):
                at = start + j + d - band
                best = row[d + 1] if d < 2 * band else none  # the template's word is missing in the text
                if d and new[d - 1] > best:
                    best = new[d - 1]  # the text has another word
                if 0 <= at < len(found) and found[at] == word:
                    matched, _, first, _ = row[d]
                    first = at if first < 0 else first
                    best = max(best, (matched + 1, first - at, first, at))
                new.append(best)
            row = new
        matched, _, first, last = max(row)
        return matched, first, last

    def hits(self, found: list[str]) -> dict[int, set[int]]:
        """For each template the diagonals where the words meet the index."""
        grams, anchors = self.grams, self.anchors
        hits = defaultdict(set)
        for i, gram in enumerate(zip(found, found[1:], found[2:])):
            if gram in grams:
                for t, j in grams[gram]:
                    hits[t].add(i - j)
        if not anchors.keys().isdisjoint(found):
            for i, word in enumerate(found):
                if word in anchors:
                    for t, j, form in anchors[word]:
                        if len(form) == 1 or tuple(found[i : i + len(form)]) == form:
                            hits[t].add(i - j)
        return hits

    def matches(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) of a whole text, by start; spans don't overlap."""
        text = text or ""
        lower = text.lower()
        # Some letters become two in lower case; then each word is lowered by itself, so that positions hold.
        found = _WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in _WORD.findall(text)]
        candidates = []
        for t, diagonals in self.hits(found).items():
            size, band, vocabulary = len(self.tokens[t]), self.band(t), self.sets[t]
            least = self.least * size - 1e-9
            last = None
            for d in sorted(diagonals):
                if last is not None and d - last <= band // 2:  # near diagonals are one candidate
                    continue
                last = d
                wide = band + band // 2  # reaches as far from the diagonals left out
                near = found[max(0, d - wide) : max(0, d + size + wide)]
                if sum(w in vocabulary for w in near) < least or not self.decided(t, near, 0, len(near)):
                    continue
                matched, a, b = self.align(t, found, d, wide)
                length = max(size, b - a + 1)  # inserted words count like missing ones
                if matched >= self.least * length - 1e-9 and self.decided(t, found, a, b):
                    candidates.append((-matched / length, -matched, self.names[t], a, b))
        chosen: list = []
        starts: list[int] = []
        for c in sorted(set(candidates)):
            at = bisect_left(starts, c[3])  # chosen spans are disjoint: only the neighbours can overlap
            if (at == 0 or chosen[at - 1][4] < c[3]) and (at == len(chosen) or c[4] < chosen[at][3]):
                starts.insert(at, c[3])
                chosen.insert(at, c)
        if not chosen:
            return []
        place = [m.span() for m in _WORD.finditer(text)]
        return sorted(((name, -cover, -n, place[a][0], place[b][1]) for cover, n, name, a, b in chosen), key=lambda m: m[3:])


@functools.cache
def _index(templates: tuple[tuple[str, str], ...], deciding: tuple[tuple[str, tuple[str, ...]], ...] = (), least: float = 0.8) -> Index:
    return Index(templates, deciding, least)


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = 0.8,
    deciding: dict[str, tuple[str, ...]] = DECIDING,
) -> DataFrame:
    """One row for each license notice found: id, license, coverage, n_matched, start, end.

    A notice is a template of which at least the share ``least`` of the words stands in order in the text; the
    share is that of the longer of template and span, so that inserted words count against it. A span without the
    template's ``deciding`` words is none. Of overlapping notices the one of highest coverage, then of most words, stays. Positions
    are code points, the end exclusive. Null and empty texts have none; repeated rows are each scanned. The
    templates are a parameter of the user's size and go to every task; texts never meet each other.
    """
    small_batches(docs.sparkSession)
    given, needed = tuple(templates.items()), tuple(deciding.items())

    @F.pandas_udf("string")
    def notices(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(given, needed, least)
        for part in texts:
            yield pd.Series(["\n".join("\t".join(map(str, m)) for m in index.matches(t)) for t in part], dtype=object)

    at = lambda i, kind: F.get("m", F.lit(i)).cast(kind)
    return (
        docs.select(id, notices(F.col(text)).alias("_found")).where("_found <> ''")
        .select(id, F.explode(F.transform(F.split("_found", "\n"), lambda x: F.split(x, "\t"))).alias("m"))
        .select(
            id, at(0, "string").alias("license"), at(1, "double").alias("coverage"), at(2, "int").alias("n_matched"),
            at(3, "long").alias("start"), at(4, "long").alias("end"),
        )
    )
