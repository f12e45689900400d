"""Known licence texts: licences in full, and notices that name a licence in one line.

Long texts lie in `licence_files`, one for each licence.
"""

from pathlib import Path

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""

_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: How notices name a licence; the canonical form has no case, punctuation or spelling of "licence".
_NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "Zlib": ("zlib License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal License"),
    **{f"CC-{k}-4.0": (f"CC {k} 4.0", f"CC {k} 4.0 License", f"Creative Commons {n} 4.0 International License", f"Creative Commons {n} 4.0 License") for k, n in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )},
    **{f"{k}-{v}": tuple(f"{n}{sep}{w}" for n in (f"GNU {name}", f"GNU {k}", k) for w in {v, v.removesuffix(".0")} for sep in (" version ", " ", " v. ")) for k, name, versions in (
        ("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
        ("LGPL", "Library General Public License", ("2.0",)), ("AGPL", "Affero General Public License", ("3.0",)), ("GFDL", "Free Documentation License", ("1.2", "1.3")),
    ) for v in versions},
    **{f"MPL-{v}": tuple(f"{n}{sep}{v}" for n in ("Mozilla Public License", "MPL") for sep in (" version ", " ", " v. ")) for v in ("1.1", "2.0")},
}
_SUBJECTS = ("", "This work is ", "This file is ", "This software is ", "This program is ", "This project is ")
_VERBS = ("licensed under", "released under", "distributed under", "licensed under the terms of", "distributed under the terms of")


def _notices():
    for licence, names in _NAMES.items():
        articles = ("the ", "a ", "") if licence.startswith("CC-") else ("the ", "")
        yield from ((licence, f"{subject}{verb} {article}{name}") for subject in _SUBJECTS for verb in _VERBS for article in articles for name in names)
        if licence.startswith(("GPL", "LGPL", "AGPL", "GFDL")):
            yield from ((licence, f"SPDX-License-Identifier: {licence}{end}") for end in ("", "-only", "-or-later", "+"))
        else:
            yield licence, f"SPDX-License-Identifier: {licence}"


#: (licence, text). Copyright lines are left out: the canonical form has none.
KNOWN = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_DISCLAIMER),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    *((path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "licence_files").glob("*.txt"))),
    *dict.fromkeys(_notices()),
)
