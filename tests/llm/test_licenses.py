import random

import pytest

from storelens.llm import licenses as L

from .helpers import frame


def brute(text, templates, threshold):
    """Best Dice coefficient of any passage with each template, by trying all passages."""
    words = L.normalised_words(text)
    out = {}
    for k, (_, t) in enumerate(templates):
        tw = L.normalised_words(t)
        grams = set(zip(tw, tw[1:], strict=False))
        best = 0.0
        for a in range(len(words) - 1):
            own = set()
            for b in range(a, len(words) - 1):
                own.add((words[b], words[b + 1]))
                best = max(best, L.dice(own, grams))
        if best >= threshold:
            out[k] = best
    return out


def test_equals_all_passages():
    rng = random.Random(1)
    templates = (("A", "alpha beta gamma delta"), ("B", "beta gamma beta alpha delta gamma"), ("C", "alpha alpha alpha"))
    for _ in range(400):
        text = " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(rng.randint(0, 25)))
        for threshold in (0.6, 0.8, 1.0):
            want = brute(text, templates, threshold)
            got = L.find_licenses(text, templates, threshold)
            assert sorted(round(x[0], 9) for x in got) == sorted(round(v, 9) for v in want.values()), text
            assert {x[1] for x in got} == {templates[k][0] for k in want}


def test_templates_find_themselves_within_text():
    for name, text in L.TEMPLATES:
        found = L.find_licenses("Some words before.\n" + text.upper() + "\nand some behind it")
        assert found[0][:2] == (1.0, name) and found[0][2] >= 3
        words = text.split()
        if len(words) > 60:  # a few changed words still count
            words[10], words[30] = "changed", "words"
            assert L.find_licenses(" ".join(words))[0][1] == name


def test_documents(spark):
    mit = dict(L.TEMPLATES[:1])["MIT"]
    docs = [(1, "prose of no licence " * 50), (2, f"start\n{mit}\nend"), (3, None), (4, ""), (2, f"start\n{mit}\nend"),
            (5, "word " * 200_000 + mit), (6, f"{mit} Licensed under CC BY-NC 4.0.")]
    got = sorted(map(tuple, L.scan_licenses(frame(spark, docs)).collect()), key=repr)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(docs)
    assert by[1] == by[3] == by[4] == (None, None, None, None, [])
    assert by[2] == ("MIT", 1.0, 1, 5, ["MIT"]) and by[5] == ("MIT", 1.0, 200_000, 5, ["MIT"])
    assert by[6][4] == ["CC-BY-4.0", "CC-BY-NC-4.0", "MIT"] or "CC-BY-NC-4.0" in by[6][4]
    assert L.scan_licenses(frame(spark, [])).collect() == []


GNU = (
    "This {1} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {0} License as"
    " published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
    " This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. You should"
    " have received a copy of the GNU {0} License along with this {1}; if not, "
)
LINK = "see <https://www.gnu.org/licenses/>."
POST = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("Licensed under CC0 1.0", "CC0-1.0"),
        ("Licensed under the Mozilla Public License, Version 2.0", "MPL-2.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("Licensed under the Eclipse Public License 2.0", "EPL-2.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Released under the GNU General Public License v3.0", "GPL-3.0"),
        (GNU.format("General Public", "program", "2", ";") + POST, "GPL-2.0"),
        (GNU.format("General Public", "program", "2", ";") + LINK, "GPL-2.0"),
        (GNU.format("General Public", "program", "3", ":") + LINK, "GPL-3.0"),
        (GNU.format("General Public", "program", "2", ";") + LINK.replace("https", "http"), "GPL-2.0"),
        (GNU.format("General Public", "program", "3", ":") + LINK.replace("https", "http"), "GPL-3.0"),
        (GNU.format("Lesser General Public", "library", "2.1", ";") + POST, "LGPL-2.1"),
        (GNU.format("Lesser General Public", "library", "2.1", ";") + LINK, "LGPL-2.1"),
        (GNU.format("Lesser General Public", "program", "3", ":") + LINK, "LGPL-3.0"),
        (GNU.format("Affero General Public", "program", "3", ":") + LINK, "AGPL-3.0"),
    ],
)
def test_sibling_licences_come_out_as_themselves(text, want):
    assert L.find_licenses(f"Some words.\n{text}\nOther words.")[0][1] == want


def test_bsd_3_clause_is_not_its_sibling():
    texts = {name: text for name, text in L.TEMPLATES if text.startswith("Redistribution")}
    assert set(texts) == {"BSD-2-Clause", "BSD-3-Clause"}
    for name, text in texts.items():
        assert L.find_licenses(f"Copyright 2020 Someone. {text}")[0][1] == name


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", []),
        ("Licensed under CC BY-SA 3.0.", ["CC-BY-SA-3.0"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Licensed under the Apache License, Version 1.1", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 3.0", []),
        ("Licensed under the Mozilla Public License, Version 1.1", ["MPL-1.1"]),
        ("Released under the Eclipse Public License, Version 1.0", ["EPL-1.0"]),
        ("Licensed under the GNU General Public License, version 1", ["GPL-1.0"]),
        ("Licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
        ("This project is licensed under the terms of the MIT license.", ["MIT"]),
        ("Distributed under the terms of the MIT license", ["MIT"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0"]),
        ("MIT License", ["MIT"]),
        ("License: MIT", ["MIT"]),
        (GNU.format("General Public", "program", "2", ";") + LINK, ["GPL-2.0"]),
        (GNU.format("Lesser General Public", "library", "2.1", ";") + LINK, ["LGPL-2.1"]),
        ("Licensed under CC BY-NC 4.0. Other words in between here. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
        ("Licensed under the MIT License or the Apache License, Version 2.0", ["Apache-2.0", "MIT"]),
    ],
)
def test_versions_decide_and_a_passage_is_one_licence(text, want):
    assert sorted({x[1] for x in L.name_licenses(f"Some words.\n{text}\nOther words.")}) == want


def test_templates_name_themselves():
    for name, text in L.TEMPLATES:
        assert L.name_licenses(f"Some words before. {text} and some behind it")[0][1] == name, text
