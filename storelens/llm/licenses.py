"""License scans: passages of normalised text against licence templates by Dice coefficient over word bigrams.

Text and templates are lower-cased and cut into words of letters and digits
(copyright lines of templates are left out). A passage is compared with a
template by 2 |A and B| / (|A| + |B|) over their sets of word bigrams, and is
a find from THRESHOLD on. Size bounds prune: a passage can only reach the
threshold t with at least t / (2 - t) and at most (2 - t) / t times the
template's bigrams, and with at least t / (2 - t) of the template's bigrams in
common. So only stretches that begin and end with a bigram of the template,
hold enough of them and are not too long are measured; most documents hold
none for any template. A find must state the version of its template, and a
passage counts for the licence that it is most like alone. Rows are scanned one by one; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
WORDS = re.compile(r"[^\W_]+")

#: Names of licences in short notices, by SPDX identifier; each is looked for behind each of VERBS.
NAMES: tuple[tuple[str, str], ...] = (
    ("MIT", "the MIT License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-2-Clause", "the Simplified BSD License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSD-3-Clause", "the New BSD License"),
    ("ISC", "the ISC License"),
    ("Zlib", "the zlib License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("BSL-1.0", "the Boost Software License 1.0"),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("EPL-2.0", "the Eclipse Public License, Version 2.0"),
    ("EPL-2.0", "the Eclipse Public License 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-2.0", "the GNU General Public License v2.0"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("GPL-3.0", "the GNU General Public License v3.0"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "the GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "the GNU Lesser General Public License v3.0"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License v3.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
)
VERBS = tuple(f"{x} under{y}" for x in ("Licensed", "Released", "Distributed") for y in ("", " the terms of"))
#: Earlier versions of names above.
NAMES += (
    ("Apache-1.1", "the Apache License, Version 1.1"),
    ("Apache-1.1", "the Apache Software License, Version 1.1"),
    ("MPL-1.1", "the Mozilla Public License, Version 1.1"),
    ("EPL-1.0", "the Eclipse Public License, Version 1.0"),
    ("EPL-1.0", "the Eclipse Public License 1.0"),
    ("GPL-1.0", "the GNU General Public License, version 1"),
    ("LGPL-2.0", "the GNU Library General Public License, version 2"),
)
NAMES += tuple(
    (name.replace("4.0", v), words.replace("4.0", v)) for name, words in NAMES if words.startswith("CC BY") for v in ("1.0", "2.0", "2.5", "3.0")
)

#: The headers of the GNU licences, from behind their subject ("This program", "This library", a file's name).
_GNU_USE = (
    "is free software; you can redistribute it and/or modify it under the terms of the GNU {0} License as published by"
    " the Free Software Foundation; either version {1} of the License, or (at your option) any later version. "
)
_GNU_WARRANTY = (
    "This {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. You"
    " should have received a copy of the GNU {0} License along with this {2}"
)
_GNU_BY_LINK = _GNU_USE + _GNU_WARRANTY + "; if not, see <{3}://www.gnu.org/licenses/>."
_GNU_BY_POST = _GNU_USE + _GNU_WARRANTY + "; if not, write to the Free Software Foundation, Inc., {3} USA."
_FRANKLIN = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301"
_TEMPLE = "59 Temple Place, Suite 330, Boston, MA 02111-1307"

#: Licence notices and texts by SPDX identifier (fixed values; each entry is one text that is looked for).
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details. You should have received a copy of the GNU General Public"
        " License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS'
        " OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
        " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        ' SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
        " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
        ' other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND'
        ' CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED'
        " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
        " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
        " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF"
        " USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
        " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
        " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
        " publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,"
        " for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be"
        " held liable for any damages arising from the use of this software. Permission is granted to anyone to use"
        " this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
        " subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must"
        " not claim that you wrote the original software. If you use this software in a product, an acknowledgment in"
        " the product documentation would be appreciated but is not required. 2. Altered source versions must be"
        " plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may"
        " not be removed or altered from any source distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the"
        " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
        " other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of"
        " its contributors may be used to endorse or promote products derived from this software without specific prior"
        ' written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY'
        " EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
        " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE"
        " LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
        " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
        " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"
        " (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE"
        " POSSIBILITY OF SUCH DAMAGE.",
    ),
    # only this scheme: of a GPL-3.0 header with its number changed nothing then tells GPL-2.0 better than GPL-3.0
    ("GPL-2.0", _GNU_BY_LINK.format("General Public", "2", "program", "http")),
    ("GPL-3.0", _GNU_BY_LINK.format("General Public", "3", "program", "http")),
    ("GPL-2.0", _GNU_BY_POST.format("General Public", "2", "program", _FRANKLIN)),
    ("GPL-2.0", _GNU_BY_POST.format("General Public", "2", "program", _TEMPLE)),
    ("LGPL-2.1", _GNU_BY_LINK.format("Lesser General Public", "2.1", "library", "http")),
    ("LGPL-2.1", _GNU_BY_LINK.format("Lesser General Public", "2.1", "library", "https")),
    ("LGPL-2.1", _GNU_BY_POST.format("Lesser General Public", "2.1", "library", _FRANKLIN)),
    ("LGPL-2.1", _GNU_BY_POST.format("Lesser General Public", "2.1", "library", _TEMPLE)),
    ("LGPL-3.0", _GNU_BY_LINK.format("Lesser General Public", "3", "library", "http")),
    ("LGPL-3.0", _GNU_BY_LINK.format("Lesser General Public", "3", "library", "https")),
    ("LGPL-3.0", _GNU_BY_LINK.format("Lesser General Public", "3", "program", "http")),
    ("LGPL-3.0", _GNU_BY_LINK.format("Lesser General Public", "3", "program", "https")),
    ("AGPL-3.0", _GNU_BY_LINK.format("Affero General Public", "3", "program", "http")),
    ("AGPL-3.0", _GNU_BY_LINK.format("Affero General Public", "3", "program", "https")),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
        " 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
        " v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"
        " https://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"
        ' and accompanying documentation covered by this license (the "Software") to use, reproduce, display,'
        " distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit"
        " third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices"
        " in the Software and this entire statement, including the above license grant, this restriction and the"
        " following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative"
        " works of the Software, unless such copies or derivative works are solely in the form of machine-executable"
        ' object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF'
        " ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING"
        " THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING"
        " FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this"
        " work.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights"
        " to this software to the public domain worldwide. This software is distributed without any warranty. You should"
        " have received a copy of the CC0 Public Domain Dedication along with this software. If not, see"
        " <http://creativecommons.org/publicdomain/zero/1.0/>.",
    ),
    (
        "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    (
        "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    (
        "CC-BY-NC-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"
        " License.",
    ),
)

_SHORT = tuple((spdx, f"{verb} {name}.") for spdx, name in NAMES for verb in VERBS)
_SPDX = tuple(dict.fromkeys(spdx for spdx, _ in (*TEXTS, *NAMES)))
_SHORT += (("MIT", "MIT License"),) + tuple((x, f"{tag}: {x}") for x in _SPDX for tag in ("SPDX-License-Identifier", "License"))
TEMPLATES: tuple[tuple[str, str], ...] = TEXTS + tuple(x for x in _SHORT if x not in TEXTS)

COLUMNS = "license string, dice double, first_word bigint, n_words bigint, licenses array<string>"


def normalised_words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def dice(a: set, b: set) -> float:
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@lru_cache(maxsize=4)
def _bigram_sets(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[list[tuple[str, frozenset]], dict, dict]:
    """(licence, bigrams) of the templates, the templates by bigram, and by key bigram.

    A find has the least number of a template's bigrams, so it has one of the key bigrams, the others but one less: those that
    fewest templates have.
    """
    sets, by, keys = [], {}, {}
    for name, text in templates:
        words = normalised_words(text)
        sets.append((name, frozenset(zip(words, words[1:], strict=False))))
    for i, (_, grams) in enumerate(sets):
        for g in grams:
            by.setdefault(g, []).append(i)
    for i, (_, grams) in enumerate(sets):
        least = math.ceil(threshold / (2.0 - threshold) * len(grams) - 1e-9)
        for g in sorted(grams, key=lambda g: (len(by[g]), g))[: len(grams) - max(least, 1) + 1]:
            keys.setdefault(g, []).append(i)
    return sets, by, keys


def best_passage(words: list[str], hits: list[int], grams: frozenset, threshold: float) -> tuple[float, int, int] | None:
    """The passage with the greatest Dice coefficient of at least ``threshold``: (dice, first word, words); earliest, shortest first.

    ``hits`` are the places of the document's bigrams that the template holds.
    """
    least = threshold / (2.0 - threshold) * len(grams) - 1e-9
    most = (2.0 - threshold) / threshold * len(grams) + 1e-9
    best = None
    # a passage that meets its first bigram again can start there: this bounds the work by template size times hits
    again, seen = [len(hits)] * len(hits), {}
    for i in range(len(hits) - 1, -1, -1):
        g = (words[hits[i]], words[hits[i] + 1])
        again[i] = seen.get(g, len(hits))
        seen[g] = i
    for i, a in enumerate(hits):
        last = again[i]
        if last - i < least:
            continue
        own: set = set()
        common: set = set()
        at = a
        for b in hits[i:last]:
            while at <= b:
                own.add((words[at], words[at + 1]))
                at += 1
            if len(own) > most:
                break
            common.add((words[b], words[b + 1]))
            if len(common) < least:
                continue
            score = 2.0 * len(common) / (len(own) + len(grams))
            if score >= threshold and (best is None or score > best[0]):
                best = (score, a, b + 2 - a)
        if best and best[0] == 1.0:
            break
    return best


def find_licenses(text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[float, str, int, int]]:
    """The best passage for each template that is found: (dice, licence, first word, words), best first."""
    sets, by, keys = _bigram_sets(templates, threshold)
    words = normalised_words(text)
    able = {t for g in zip(words, words[1:], strict=False) for t in keys.get(g, ())}
    hits: dict[int, list[int]] = {}
    for i, g in enumerate(zip(words, words[1:], strict=False)) if able else ():
        for t in by.get(g, ()):
            if t in able:
                hits.setdefault(t, []).append(i)
    found = []
    for t, places in hits.items():
        name, grams = sets[t]
        if len(places) >= threshold / (2.0 - threshold) * len(grams) - 1e-9 and (
            best := best_passage(words, places, grams, threshold)
        ):
            found.append((best[0], name, best[1], best[2], len(grams)))
    # of equal scores the longer template is the more telling
    return [x[:4] for x in sorted(found, key=lambda x: (-x[0], -x[4], x[1], x[2]))]


#: A stated version: behind "version", or behind a word that ends a licence's name or its short form.
VERSION = re.compile(
    r"\b(?:version|license|licence|apache|gpl|lgpl|agpl|mpl|epl|bsl|by|sa|nd|nc|cc0|sharealike|noderivatives|noderivs|noncommercial|attribution|universal|unported)"
    r" (?:version )?(?:v )?v?([0-9]+(?: [0-9])?)\b"
)
#: Words behind a passage that may still state its version.
TAIL = 6


def stated_versions(words: list[str]) -> list[str]:
    """Versions of licences that words state, in order; 2.0 and 2 are one."""
    return [v.removesuffix(" 0") for v in VERSION.findall(" ".join(words))]


def name_licenses(text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[float, str, int, int]]:
    """The finds of ``find_licenses`` that name a licence, best first.

    A template that states a version needs a passage (with the TAIL words behind it) that states the same one first: what
    names another version is no find. One passage is one licence: a find loses to a better one that holds half of its words.
    """
    found = find_licenses(text, templates, threshold)
    words = normalised_words(text) if found else []
    wanted = _versions(templates)
    kept: list[tuple[float, str, int, int]] = []
    for score, name, first, n in found:
        told = stated_versions(words[first : first + n + TAIL])
        if wanted[name] and (told[0] if told else "") not in wanted[name]:
            continue
        if any(min(first + n, a + k) - max(first, a) >= n / 2 for _, _, a, k in kept):
            continue
        kept.append((score, name, first, n))
    return kept


@lru_cache(maxsize=4)
def _versions(templates: tuple[tuple[str, str], ...]) -> dict[str, frozenset]:
    """By licence: the versions that its templates state first, "" where one states none; empty if none does."""
    out: dict[str, set] = {}
    for name, text in templates:
        told = stated_versions(normalised_words(text))
        out.setdefault(name, set()).add(told[0] if told else "")
    return {name: frozenset(v) if v != {""} else frozenset() for name, v in out.items()}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: doc_id, license (the best find; null if none), its dice, first_word and n_words, and licenses (all found, sorted).

    Finds are those of ``name_licenses``. The whole text is scanned; null and empty texts have no find. Ties of the
    score go to the longer template, then by name. Rows are scanned one by one,
    so repeated rows give repeated results; an empty table gives none; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [name_licenses(t.as_py() or "", templates, threshold) for t in batch.column("text")]
            first = [f[0] if f else (None, None, None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[1] for f in first], pa.string()),
                    pa.array([f[0] for f in first], pa.float64()),
                    pa.array([f[2] for f in first], pa.int64()),
                    pa.array([f[3] for f in first], pa.int64()),
                    pa.array([sorted({x[1] for x in f}) for f in found], pa.list_(pa.string())),
                ],
                ["doc_id", "license", "dice", "first_word", "n_words", "licenses"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {id_type}, {COLUMNS}")
