"""License scans by conditional compression.

A text is cut into sentences and lines. A piece is a candidate if zstandard, given
all templates as one raw dictionary, makes it shorter by LEAST_SAVED bytes than
without; neighbouring candidates, and up to BETWEEN short pieces between two of them,
are one block. A block is compressed with each
license's template as a raw dictionary, and templates are ranked by how much they
shorten it. A license is confirmed by exact wording: by its full name and version in
a statement, or by the stretch of its notice that stands in the block, across which
no word may differ that tells licenses apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import tune_arrow

# Public license notices, names and SPDX identifiers.
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISE = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'


def _gnu(kind: str, version: str, thing: str = "program") -> str:
    """The notice that the GNU licenses ask for."""
    name = f"GNU {kind}General Public License"
    Thing = thing.split()[-1]
    return f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {Thing}; if not, see https://www.gnu.org/licenses/."


@dataclass(frozen=True)
class License:
    """Names in full; short names that only a version makes one; the version; and the notice or whole text."""

    names: tuple[str, ...]
    version: str = ""
    short: tuple[str, ...] = ()
    text: str = ""


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GPL, _LGPL, _AGPL = ("GNU General Public License", "GNU GPL"), ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL"), ("GNU Affero General Public License", "GNU AGPL")

#: By SPDX name, the more common license first.
LICENSES = {
    "MIT": License(("MIT License", "Expat License", "MIT/Expat License"), text=_MIT),
    "Apache-2.0": License(("Apache License", "Apache Software License"), "2.0", ("Apache",), 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "BSD-3-Clause": License(("BSD 3-Clause License", "BSD 3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"), text=f"{_REDISTRIBUTE} {_SOURCE} {_BINARY} 3. {_ENDORSE} {_BSD_AS_IS}"),
    "BSD-2-Clause": License(("BSD 2-Clause License", "BSD 2-Clause", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"), text=f"{_REDISTRIBUTE} {_SOURCE} {_BINARY} {_BSD_AS_IS}"),
    "GPL-2.0": License(_GPL, "2.0", ("GPL",), _gnu("", "2")),
    "GPL-3.0": License(_GPL, "3.0", ("GPL",), _gnu("", "3")),
    "LGPL-2.1": License(_LGPL, "2.1", ("LGPL",), _gnu("Lesser ", "2.1", "library")),
    "LGPL-3.0": License(_LGPL, "3.0", ("LGPL",), _gnu("Lesser ", "3", "library")),
    "AGPL-3.0": License(_AGPL, "3.0", ("AGPL",), _gnu("Affero ", "3")),
    "ISC": License(("ISC License",), text=f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    "MPL-2.0": License(("Mozilla Public License",), "2.0", ("MPL",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": License(("The Unlicense", "Unlicense"), text="This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    **{f"CC-{k}-4.0": License((f"Creative Commons {w}", f"Creative Commons {w} International", f"CC {k}"), "4.0", text=f"This work is licensed under the Creative Commons {w} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{k.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.") for k, w in _CC.items()},
    "CC0-1.0": License(("CC0", "Creative Commons Zero", "CC0 Universal"), "1.0", text="To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the terms of CC0 1.0 Universal. The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator and subsequent owner(s) of an original work of authorship and/or a database."),
    "Zlib": License(("zlib License", "zlib/libpng License"), text="This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    "BSL-1.0": License(("Boost Software License", "Boost License"), "1.0", text='Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    "MIT-0": License(("MIT No Attribution License", "MIT No Attribution", "MIT-0"), text=f"{_GRANT}. {_AS_IS}"),
    "X11": License(("X11 License", "MIT/X11 License"), text=f"{_MIT} Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    "0BSD": License(("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD"), text=f"{_ISC_GRANT}. {_ISC_AS_IS}"),
    "BSD-1-Clause": License(("BSD 1-Clause License", "BSD 1-Clause"), text=f"{_REDISTRIBUTE} {_SOURCE} {_BSD_AS_IS}"),
    "BSD-4-Clause": License(("BSD 4-Clause License", "BSD 4-Clause", "Original BSD License"), text=f"{_REDISTRIBUTE} {_SOURCE} {_BINARY} {_ADVERTISE} 4. {_ENDORSE} {_BSD_AS_IS}"),
    "NCSA": License(("University of Illinois/NCSA Open Source License", "NCSA Open Source License", "NCSA License"), text=f'{_GRANT.replace("the rights to use", "the rights to use").replace("deal in the Software", "deal with the Software")}, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution. Neither the names of the development group, institution, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.'),
    "PostgreSQL": License(("PostgreSQL License",), text="Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies. In no event shall the university be liable to any party for direct, indirect, special, incidental, or consequential damages, including lost profits, arising out of the use of this software and its documentation."),
    "HPND": License(("Historical Permission Notice and Disclaimer",), text="Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that copyright notice and this permission notice appear in supporting documentation, and that the name of the copyright holder not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission."),
    "curl": License(("curl License",), text="Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder."),
    "WTFPL": License(("Do What The Fuck You Want To Public License", "WTFPL"), text="Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    "GPL-1.0": License(_GPL, "1.0", ("GPL",), _gnu("", "1")),
    "LGPL-2.0": License(_LGPL, "2.0", ("LGPL",), _gnu("Library ", "2", "library")),
    "GFDL-1.2": License(("GNU Free Documentation License",), "1.2", ("GFDL",), "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    "GFDL-1.3": License(("GNU Free Documentation License",), "1.3", ("GFDL",), "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    "MPL-1.1": License(("Mozilla Public License",), "1.1", ("MPL",), 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.'),
    "EPL-1.0": License(("Eclipse Public License",), "1.0", ("EPL",), "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0": License(("Eclipse Public License",), "2.0", ("EPL",), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "CDDL-1.0": License(("Common Development and Distribution License",), "1.0", ("CDDL",), 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License. When distributing Covered Code, include this CDDL HEADER in each file.'),
    "EUPL-1.2": License(("European Union Public Licence",), "1.2", ("EUPL",), "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    "OFL-1.1": License(("SIL Open Font License", "Open Font License"), "1.1", ("OFL",), "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"),
    "Artistic-2.0": License(("Artistic License",), "2.0", ("Artistic",)),
    "MS-PL": License(("Microsoft Public License", "MS-PL")),
    "MS-RL": License(("Microsoft Reciprocal License", "MS-RL")),
    "ODbL-1.0": License(("Open Database License", "Open Data Commons Open Database License"), "1.0", ("ODbL",)),
    "PDDL-1.0": License(("Public Domain Dedication and License",), "1.0", ("PDDL",)),
    "ZPL-2.1": License(("Zope Public License",), "2.1", ("ZPL",)),
    "PSF-2.0": License(("Python Software Foundation License", "PSF License")),
    "PHP-3.01": License(("PHP License",), "3.01", ("PHP",)),
    "LPPL-1.3c": License(("LaTeX Project Public License",), "1.3", ("LPPL",), "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3 of this license or (at your option) any later version."),
    "CECILL-2.1": License(("CeCILL Free Software License", "CeCILL License", "CeCILL"), "2.1"),
    "AFL-3.0": License(("Academic Free License",), "3.0", ("AFL",)),
    "OSL-3.0": License(("Open Software License",), "3.0", ("OSL",)),
    "UPL-1.0": License(("Universal Permissive License",), "1.0", ("UPL",)),
    "Vim": License(("Vim License",)),
    "Ruby": License(("Ruby License",)),
}

#: A piece is looked at if the dictionary of all templates saves it so many bytes; longer pieces are tried in parts of PIECE characters.
LEAST_SAVED, PIECE = 6, 300
#: Stand around pieces of fewer than TINY bytes, which zstandard would else store as they are.
HEAD, TAIL, TINY = bytes(range(14, 22)), bytes(range(1, 14)) * 2, 40
#: So many pieces of up to SHORT characters may stand between two candidates of one block (wrapped lines, holders' names).
BETWEEN, SHORT = 3, 90
#: A template's wording is compared if it shortens the block by this share, a stretch confirms it with so many common
#: words that are this share of the stretch; a notice with NOTICE words counts beside names of other licenses.
LEAST_REDUCTION, LONG, LEAST_WORDS, NOTICE = 0.2, 10, 0.8, 25
#: A name counts so many words behind one of these, or alone on its line.
NEAR, CUES = 8, {"under", "spdx", "terms"}
#: Template words that a block may leave out at once; more are another passage of the template, and count as so many.
GAP = 6
#: What turns a statement into its contrary when it stands so closely before the cue.
NEGATIONS, BEFORE = frozenset("not never no nor neither cannot isn aren wasn weren nicht kein pas nunca".split()), 4
#: Statements with a short name, as it is written: a cue before it, or one behind it. {} is the name.
SHORT_FORMS = (
    r"(?i:licen[sc]ed|released|distributed|published|available|made available)\s+(?i:under)\s+(?i:the\s+)?{}",
    r"(?i:licen[sc]es?|licencia|lizenz)\s*[:=]\s*{}",
    r"(?i:unter\s+der|sous\s+(?:la\s+)?licence|sous\s+la|bajo\s+(?:la\s+)?licencia|bajo\s+la)\s+{}",
    r"{}[ -](?i:licen[sc]ed)",
)
_unit = re.compile(r"[^\n]+?(?:[.!?](?=[ \t])(?![ \t]*\d)|$|(?=\n))", re.M)
_word = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_number = re.compile(r"v?(\d+(?:\.\d+)*)$")
_glued = re.compile(r"\b([al]?gpl|gfdl|mpl|epl|eupl)v(?=\d)")
_PLAIN = frozenset("a an and as at by clause free gnu in international license new of open or project public software source the this to v version".split())


def _words(text: str) -> list[str]:
    return _word.findall(_glued.sub(r"\1 v", text.lower().replace("licence", "license")))


def _version(word: str) -> str:
    """2, v2 and 2.0 alike as 2.0; '' if it is no number."""
    m = _number.match(word)
    return "" if m is None else m[1] if "." in m[1] else f"{m[1]}.0"


def _statement(spdx: str, lic: License) -> str:
    """How notices put it in a sentence."""
    full = lic.names[0] + (f", version {lic.version}" if lic.version else "")
    if spdx.startswith("CC"):
        full = f"{lic.names[-1] if spdx != 'CC0-1.0' else 'CC0'} {lic.version}"
    return f"Released under the {full}. Licensed under the {full}. This work is licensed under the {full}. This project is licensed under the terms of the {full}. SPDX-License-Identifier: {spdx}"


TEMPLATES = {k: f"{_statement(k, v)}\n{v.text}" for k, v in LICENSES.items()}


@dataclass
class _Names:
    """What a block says by name: licenses, and families named without a version, with or without a cue."""

    stated: list[str] = field(default_factory=list)
    open: list[tuple[str, ...]] = field(default_factory=list)
    mentioned: set[str] = field(default_factory=set)


class Scanner:
    """Licenses ready for comparison."""

    def __init__(self, licenses: dict[str, License] = LICENSES) -> None:
        press = lambda **o: zstandard.ZstdCompressor(level=3, write_content_size=False, **o)

        def raw(text: str) -> zstandard.ZstdCompressionDict:
            d = zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            return d

        self.licenses = licenses
        templates = {k: f"{_statement(k, v)} {v.text}" for k, v in licenses.items()}
        said = " ".join(f"license: {n}. licensed under {n}. licensed under the {n}. {n} licensed. unter der {n}-lizenz. sous licence {n}. bajo la licencia {n}." for n in self.short_names(licenses))
        # zstandard indexes every third place of a dictionary, so short statements stand in it at all three.
        said = "".join(said + "-" * ((k - len(said)) % 3) for k in (1, 1, 1))
        self.alone, self.all = press(), press(dict_data=raw(f"{said} {' '.join(templates.values())}"))
        self.under = {k: press(dict_data=raw(t)) for k, t in templates.items()}
        self.words = {k: _words(v.text) for k, v in licenses.items()}
        self.place = {k: n for n, k in enumerate(licenses)}
        #: Words of names: where two differ in one, they are different licenses.
        self.telling = {w for v in licenses.values() for n in v.names for w in _words(n)} - _PLAIN
        self.names: dict[str, list[tuple[list[str], bool, dict[str, str]]]] = {}
        families: dict[tuple[str, ...], tuple[bool, dict[str, str]]] = {}
        for k, v in licenses.items():
            for names, full in ((v.names, True), (v.short, False), ((k.rsplit("-", 1)[0] if v.version else k,), False)):
                for n in names:
                    own = tuple(_words(n))
                    if full or v.version or len(own) > 1:
                        families.setdefault(own, (full or not v.version, {}))[1][v.version] = k
        for own, (full, versions) in sorted(families.items(), key=lambda x: -len(x[0])):
            self.names.setdefault(own[0], []).append((list(own), full, versions))
        self.ids = {tuple(_words(k)): k for k in licenses}
        self.known: dict[str, list[tuple[str, float, str]]] = {}
        self.families = self.short_names(licenses)
        name = "(?:" + "|".join(sorted(map(re.escape, self.families), key=len, reverse=True)) + ")"
        # A capital word behind it, other than License, is part of a longer name.
        version = r"(?:,?[ -]?(?:[vV]ersion )?[vV]?(?P<v>\d+(?:\.\d+)*))?(?:-or-later|-only|\+)?(?![\w])(?!\s+(?!Licen[sc]e)[A-Z0-9])(?!-(?!Lizenz)[A-Z0-9])"
        self.forms = [re.compile(r"(?<![\w-])" + f.format(f"(?P<name>{name}){version}") if not f.startswith("{") else r"(?<![\w-])" + f.format(f"(?P<name>{name})" + r"(?:[ -]?[vV]?(?P<v>\d+(?:\.\d+)*))?")) for f in SHORT_FORMS]

    @staticmethod
    def short_names(licenses: dict[str, License]) -> dict[str, dict[str, str]]:
        """By short name, as written: version -> license ('' or, where names have no versions, each license by itself)."""
        out: dict[str, dict[str, str]] = {}
        for k, v in licenses.items():
            for n in {*v.short, k.split("-")[0]}:
                if not n.isdigit() and (n in v.short or not v.version):
                    out.setdefault(n, {})[v.version or k] = k
        return {n: {"": n} if n in licenses and not licenses[n].version else of for n, of in out.items() if n not in ("CC", "MS", "PSF")}

    def shortly(self, block: str) -> list[tuple[str, ...]]:
        """The licenses that the block states by a short name with a cue; more than one where it names no version."""
        found = []
        for form in self.forms:
            for m in form.finditer(block):
                before = _words(re.split(r"[.!?]\s|\n\n", block[: m.start()])[-1])[-BEFORE:]
                if NEGATIONS & set(before):
                    continue
                versions = self.families[m["name"]]
                version = _version(m["v"]) if m["v"] else ""
                if "" in versions:
                    found.append((versions[""],))
                elif version in versions:
                    found.append((versions[version],))
                elif not version:
                    found.append(tuple(versions.values()))
        return found

    def rank(self, block: str) -> list[tuple[float, str]]:
        """(reduction, license) of all templates, the largest reduction first."""
        raw = " ".join(block.lower().split()).encode()
        base = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / base, n) for n, c in self.under.items()), key=lambda x: (-x[0], self.place[x[1]]))

    def candidate(self, piece: str) -> bool:
        """Whether the templates together save the piece, or a part of it, LEAST_SAVED bytes."""
        parts = [piece]
        if len(piece) > PIECE:
            cuts = [0]
            while len(piece) - cuts[-1] > PIECE:
                blank = piece.rfind(" ", cuts[-1] + PIECE // 2, cuts[-1] + PIECE)
                cuts.append(blank + 1 if blank >= 0 else cuts[-1] + PIECE)
            parts = [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)], strict=True)]
        for p in parts:
            raw = p.lower().encode()
            raw = HEAD + raw + TAIL if len(raw) < TINY else raw
            if len(self.alone.compress(raw)) - len(self.all.compress(raw)) >= LEAST_SAVED:
                return True
        return False

    def stretch(self, own: list[str], name: str) -> tuple[int, list[str], list[str], int, int, tuple[int, int], int]:
        """Of the best stretch of own: how many words more it has in common with the license's text than it
        differs by; the words that differ; words in common; words of longer left-out passages inside it;
        where it stands in own; and words of the license's text before and behind it (GAP at most either)."""
        made = self.words[name]
        parts = [m for m in SequenceMatcher(None, made, own, autojunk=False).get_matching_blocks() if m.size]
        best = here = (0, [], [], 0, 0, (0, 0), (0, 0))
        for x, y in zip([None, *parts], parts, strict=False):
            extra = own[x.b + x.size : y.b] if x else []
            left_out = made[x.a + x.size : y.a] if x else []
            gaps, skipped = (left_out, 0) if len(left_out) <= GAP else ([], len(left_out))
            score = here[0] - len(extra) - min(len(left_out), GAP)
            # Across a number or a name that the text lacks it is another license.
            differs = any((_version(w) and len(left_out) <= GAP) or w in self.telling or w in NEGATIONS for w in extra) and bool(gaps or not left_out)
            if score <= 0 or differs:
                here = (y.size, [], [], y.size, 0, (y.b, y.b + y.size), (y.a, y.a + y.size))
            else:
                here = (score + y.size, here[1] + extra, here[2] + gaps, here[3] + y.size, here[4] + skipped, (here[5][0], y.b + y.size), (here[6][0], y.a + y.size))
            best = max(best, here, key=lambda h: (h[0], -h[4]))
        a, b = best[6]
        return *best[:6], min(a, GAP) + min(len(made) - b, GAP)

    def named(self, own: list[str], lines: list[list[str]]) -> _Names:
        """The licenses that the block names."""
        out, i = _Names(), 0
        while i < len(own):
            if own[i - 1 : i] == ["identifier"]:
                hit = max((k for k in self.ids if tuple(own[i : i + len(k)]) == k), key=len, default=None)
                if hit:
                    out.stated.append(self.ids[hit])
                    out.mentioned.add(self.ids[hit])
                    i += len(hit)
                    continue
            for name, full, versions in self.names.get(own[i], ()):
                if own[i : i + len(name)] != name:
                    continue
                end = i + len(name)
                if own[end : end + 1] == ["license"]:
                    end += 1
                at = end + (own[end : end + 1] in (["version"], ["v"]))
                version = _version(own[at]) if at < len(own) else ""
                cues = [j for j in range(max(i - NEAR, 0), i) if own[j] in CUES]
                denied = any(own[j] in NEGATIONS and own[j + 1] != "only" for j in range(max(cues[0] - BEFORE, 0), cues[0])) if cues else False
                cue = bool(cues) and not denied or not cues and any(len(x) <= end - i + 4 and " ".join(own[i:end]) in " ".join(x) and set(x) <= {*own[i : at + 1], "the", "license", "version"} for x in lines)
                if "" in versions:
                    found = [versions[""]] if full else []
                elif version:
                    found = [versions[version]] if version in versions else None
                    end = at + 1
                else:
                    found = list(versions.values()) if full else []
                if found is None or found:
                    out.mentioned.update(versions.values())
                    if found and cue:
                        (out.stated.append(found[0]) if len(found) == 1 else out.open.append(tuple(found)))
                    i = end - 1
                    break
            i += 1
        return out

    def decide(self, block: str) -> list[tuple[str, float, str]]:
        """(license, reduction, differing words) of each license that the block states."""
        if block in self.known:
            return self.known[block]
        own = _words(block)
        names = self.named(own, [_words(x) for x in block.split("\n")])
        rank = self.rank(block) if own else []
        whole = {n: r for r, n in rank}
        found = {n: (whole[n], "") for n in names.stated}
        parts = [own]
        while parts:
            part = parts.pop(0)
            if len(part) < LONG:
                continue
            worded: dict[str, tuple] = {}
            for r, n in rank if part is own else self.rank(" ".join(part)):
                if r < LEAST_REDUCTION or not self.words[n]:
                    continue
                score, extra, gaps, common, skipped, span, ends = self.stretch(part, n)
                # What another license left of the block is a license only if it is most of a notice.
                least = LONG if part is own else max(NOTICE, len(self.words[n]) // 2)
                if score >= LONG and common >= least and common >= LEAST_WORDS * (common + len(extra)):
                    worded[n] = (ends - score, skipped, -round(r, 2), self.place[n], " ".join([*(f"+{w}" for w in extra), *(f"-{w}" for w in gaps)]), score, r, span)
            # Where a block names licenses, wording can decide between those; a whole notice also counts beside them.
            fits = {n: w for n, w in worded.items() if not names.mentioned or n in names.mentioned or w[5] >= NOTICE and not any(worded[m][5] >= w[5] for m in names.mentioned & set(worded))}
            best = min(fits, key=fits.get, default=None)
            if best is None:
                continue
            stated = [m for m in names.stated if m in worded]
            for m in stated:
                found[m] = (found[m][0], worded[m][4])
            as_good = min((m for m in stated if worded[m][0] <= fits[best][0]), key=worded.get, default=None)
            if as_good is None:
                found.setdefault(best, (fits[best][6], fits[best][4]))
            a, b = worded[as_good or best][7]
            parts += [part[:a], part[b:]]
        for family in self.shortly(block):
            if not set(family) & set(found) and not any(set(family) & set(x) for x in names.open):
                names.open.append(family)
        for family in names.open:
            if not set(family) & set(found):
                found[" OR ".join(family)] = (max(whole[x] for x in family), "")
        out = [(n, round(r, 6), differs) for n, (r, differs) in found.items()]
        if len(self.known) < 20_000:
            self.known[block] = out
        return out

    def scan(self, text: str) -> list[tuple[int, str, str, float, str]]:
        """(position, block, license, reduction, differences) of the confirmed licenses of a text, block by block."""
        out: list[tuple[int, str, str, float, str]] = []
        blocks: list[tuple[int, int]] = []
        between = BETWEEN + 1  # short pieces since the last candidate; more than BETWEEN if it is out of reach
        for m in _unit.finditer(text):
            piece = m[0].strip()
            if not piece:
                continue
            if not self.candidate(piece):
                between += 1 if len(piece) <= SHORT else BETWEEN + 1
                continue
            if between <= BETWEEN:
                blocks[-1] = (blocks[-1][0], m.end())
            else:
                blocks.append((m.start(), m.end()))
            between = 0
        for a, b in blocks:
            block = text[a:b].strip()
            out += [(a, block, *found) for found in self.decide(block)]
        return out


SCHEMA = "licenses string, n_blocks long, positions array<long>, blocks array<string>, reductions array<double>, differences array<string>"


def scanned(docs: DataFrame, text: str = "text", licenses: dict[str, License] = LICENSES) -> DataFrame:
    """docs with its text column replaced by what the scan found: SCHEMA.

    licenses: the distinct names, in order, joined by commas ('' if none); a name that
    stands without a version is all its versions, joined by OR. A null or empty text has
    none; whole texts are scanned; repeated blocks each count; other columns pass
    through, and one named like a result raises; an empty table stays empty."""
    others = [c for c in docs.columns if c != text]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(licenses)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            rows = [scanner.scan(t.as_py() or "") for t in texts]
            arrays = [pa.array([",".join(sorted({x[2] for x in r})) for r in rows], pa.string()), pa.array([len(r) for r in rows], pa.int64())]
            for k, kind in ((0, pa.int64()), (1, pa.string()), (3, pa.float64()), (4, pa.string())):
                arrays.append(pa.array([[x[k] for x in r] for r in rows], pa.list_(kind)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in others), *arrays], names=[*others, *names])

    taken = {c.lower() for c in others} & set(names)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already")
    tune_arrow(docs.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in others), SCHEMA]))
