"""License scans against notices that are written out here, not taken from the table."""

import re

from markloom.llm import licenses

NOTICES = {
    "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0-notice"},
    "Licensed under CC BY 4.0.": {"CC-BY-4.0-notice"},
    "licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0-notice"},
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": {"CC-BY-ND-4.0"},
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": {"CC-BY-NC-SA-4.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
    "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
    "it under the terms of the GNU General Public License version 2 as published by": {"GPL-2.0"},
    "Released under the GNU Lesser General Public License, version 2.1": {"LGPL-2.1"},
    "Released under the GNU Affero General Public License, version 3": {"AGPL-3.0"},
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": {"GPL-2.0-header"},
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"AGPL-3.0-header"},
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.": {"GPL-2.0-text"},
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"LGPL-3.0-text"},
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": {"Apache-2.0-text"},
    "Use is under the BSD 2-Clause License, see the file": {"BSD-2-Clause-notice"},
    "made available under the terms of the Eclipse Public License 2.0 which is available at": {"EPL-2.0"},
    "the author has waived all copyright and related or neighboring rights to this work": {"CC0-1.0"},
    "CC0 1.0 Universal\n(CC0 1.0) Public Domain Dedication": {"CC0-1.0-text"},
    "Licensed under no terms at all": set(),
}


def test_planted_notices(spark):
    around = "plain words stand before and behind each of the notices here"
    rows = [(k, f"{around}\n{notice}\n{around}") for k, notice in enumerate(NOTICES)]
    got = {k: set() for k, _ in rows}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["license"])
    assert [got[k] for k, _ in rows] == list(NOTICES.values())


def test_templates_are_told_apart():
    def shingles(text):
        w = re.findall(r"\S+", re.sub(r"[^a-z0-9\s]", "", text.lower()))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {name: shingles(text) for name, text in licenses.TEMPLATES.items()}
    assert all(sets.values())
    close = {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and licenses.CONTAINMENT <= len(x & y) / len(x) < 1}
    assert not close
