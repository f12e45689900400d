import re
import textwrap

import pytest

from casemill.llm import licences
from casemill.llm.licence_texts import KNOWN


def canonical(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for pattern, replacement in licences.STEPS:
        out = re.sub(pattern, replacement, out)
    return out.strip(" ")


@pytest.mark.parametrize("width", range(60, 101))
def test_wrapped_texts_keep_their_form(width):
    for name, text in KNOWN[:9]:
        wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
        assert canonical("Copyright (c) 2024 Some One\n" + wrapped) == canonical(text), (name, width)


@pytest.fixture(scope="module")
def forms():
    out = {}
    for name, text in KNOWN:
        out.setdefault(canonical(text), set()).add(name)
    return out


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_full_texts_are_known(forms, name):
    text = open(f"/usr/share/common-licenses/{name.removesuffix('.0') if 'GPL' in name else name}", encoding="utf-8").read()
    assert forms[canonical(text)] == {name}


@pytest.mark.parametrize(
    ("name", "notice"),
    [
        ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
        ("MPL-2.0", "This file is distributed under the terms of the Mozilla Public License, v. 2.0."),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ],
)
def test_notices_are_known(forms, name, notice):
    assert forms[canonical(notice)] == {name}


def test_a_form_names_one_licence(forms):
    assert all(len(names) == 1 for names in forms.values())


def test_known_texts_have_a_cue():
    assert [t for _, t in KNOWN if not re.search(licences.CUE, t)] == []
