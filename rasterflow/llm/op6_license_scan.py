"""License scan by patience alignment.

A template and a stretch of text are aligned on the words that occur once in each: the longest
run of them in the same order (longest increasing subsequence) anchors the alignment,
and the gaps between anchors are aligned the same way. Coverage is the share of the
template's words that were matched.

A stretch is looked at wherever a word that is rare among the templates stands in a text, so
a notice is found at any place of a text of any length, as often as it occurs. It takes in half as many
words as the template has, before and behind and between: a notice may hold insertions up to that.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents

#: Public license notices, by SPDX identifier; what follows it (text, notice, deed) tells wordings apart.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_4 = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(what: str, name: str, version: str) -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


TEMPLATES |= {
    "MIT-full": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-0-full": f"{_GRANT}. {_AS_IS}",
    "BSD-2-Clause-full": _BSD + _BSD_END,
    "BSD-3-Clause-full": _BSD + _BSD_3 + _BSD_END,
    "BSD-4-Clause-full": _BSD + _BSD_4 + _BSD_END,
    "ISC-full": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR}",
    "0BSD-full": f"{_ISC}. {_AUTHOR}",
    "Apache-2.0-full": TEMPLATES["Apache-2.0-notice"] + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0-full": TEMPLATES["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "EPL-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.0": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-notice": _gnu("program", "General Public License", "2"),
    "LGPL-2.0-notice": _gnu("program", "Library General Public License", "2"),
    "LGPL-2.1-notice": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _gnu("program", "Lesser General Public License", "3"),
    "AGPL-3.0-notice": _gnu("program", "Affero General Public License", "3"),
    "CC0-1.0": "Licensed under CC0 1.0.",
    "CC0-1.0-deed": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: Words that a notice must have matched, as they tell its license or version from others.
REQUIRED = {
    "MIT": "mit", "GPL-3.0": "gnu general 3", "GPL-3.0-notice": "gnu general 3", "GPL-2.0": "gnu general 2", "GPL-2.0-notice": "gnu general 2",
    "LGPL-2.0": "gnu library 2", "LGPL-2.0-notice": "gnu library 2", "LGPL-2.1": "lesser 2 1", "LGPL-2.1-notice": "lesser 2 1", "LGPL-3.0": "lesser 3", "LGPL-3.0-notice": "lesser 3", "AGPL-3.0": "affero 3", "AGPL-3.0-notice": "affero 3",
    "Apache-2.0": "apache 2", "Apache-2.0-notice": "apache 2", "Apache-2.0-full": "apache 2", "MPL-2.0": "mozilla 2", "MPL-2.0-full": "mozilla 2", "MPL-1.1-notice": "mozilla 1", "EPL-1.0-notice": "eclipse v1", "EPL-2.0-notice": "eclipse 2",
    "CC0-1.0": "cc0 1", "BSL-1.0": "boost 1", "MIT-full": "included substantial", "BSD-3-Clause-full": "endorse", "BSD-4-Clause-full": "advertising acknowledgement",
}
_PARTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
for _kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
    for _version in ("4.0", "3.0", "2.5", "2.0"):
        _id = f"CC-{_kind.upper()}-{_version}"
        _long = "-".join(_PARTS[x] for x in _kind.split("-"))
        TEMPLATES |= {_id: f"Licensed under CC {_kind.upper()} {_version}.", f"{_id}-deed": f"This work is licensed under a Creative Commons {_long} {_version} International License."}
        REQUIRED |= {_id: f"cc {_kind.replace('-', ' ')} {_version[0]}" + " 5" * (_version == "2.5"), f"{_id}-deed": f"creative commons {_long.replace('-', ' ').lower()} {_version[0]}" + " 5" * (_version == "2.5")}
#: Words that make another license of a notice of those with required words, when they stand in it and are not its own.
VARIANTS = frozenset("lesser affero nc sa nd noncommercial sharealike noderivatives noderivs".split())
#: Share of a template's words that a stretch must match.
COVERAGE = 0.8

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _TOKEN.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i in a, j in b), rising in both, by patience alignment of the gaps."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()  # noqa: E741
        while i < j and k < l and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            out.append((j - 1, l - 1))
            j, l = j - 1, l - 1  # noqa: E741
        if i == j or k == l:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:l])
        at = {w: n for n, w in enumerate(b[k:l], k) if cb[w] == 1}
        both = [(n, at[w]) for n, w in enumerate(a[i:j], i) if ca[w] == 1 and w in at]
        tails, ends, back = [], [], {}
        for n, m in both:
            p = bisect_left(tails, m)
            back[n, m] = ends[p - 1] if p else None
            tails[p : p + 1], ends[p : p + 1] = [m], [(n, m)]
        chain, x = [], ends[-1] if ends else None
        while x:
            chain.append(x)
            x = back[x]
        if not chain:
            continue
        out += chain
        chain = [(i - 1, k - 1), *chain[::-1], (j, l)]
        todo += [(x + 1, n, y + 1, m) for (x, y), (n, m) in zip(chain, chain[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, required: dict[str, str] = REQUIRED):
        self.coverage = coverage
        self.required = {name: set(tokens(words)) for name, words in required.items() if name in templates}
        self.templates = {name: tokens(text) for name, text in templates.items()}
        self.words = {name: frozenset(t) for name, t in self.templates.items()}
        count = Counter(w for words in self.words.values() for w in words)
        # in any stretch that is covered enough, one of a template's rarest words stands: more of them than may miss
        self.keys: dict[str, list[tuple[str, int]]] = {}
        for name, t in self.templates.items():
            distinct = sorted(set(t), key=lambda w: (count[w] + 3 * (len(w) < 4), -len(w), w))
            missing, n = len(t) - math.ceil(coverage * len(t)), 0
            for w in distinct:
                for j in (j for j, x in enumerate(t) if x == w):
                    self.keys.setdefault(w, []).append((name, j))
                n += t.count(w)
                if n > missing:
                    break

    def told(self, name: str, stretch: list[str], got: list[tuple[int, int]]) -> bool:
        """Whether what was matched is this license and version, not one of much the same wording."""
        if not (required := self.required.get(name)):
            return True
        at = {i for i, _ in got}
        # a word after the last match may belong to the next sentence, one inside may not
        inside = (stretch[i] for i in range(got[0][0], got[-1][0]) if i not in at)
        return required <= {stretch[i] for i in at} and VARIANTS.isdisjoint(inside)

    def find(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(template, first word, end word, matched words, template's words), best first where stretches overlap."""
        t = tokens(text)
        tried, hits = set(), []
        for i, w in enumerate(t):
            for name, j in self.keys.get(w, ()):
                # one stretch for all key words that place the notice alike, also where it would begin before the text
                if (name, i - j) in tried:
                    continue
                tried.add((name, i - j))
                template, words = self.templates[name], self.words[name]
                m = len(template)
                slack = max(2, m // 2)
                start = max(0, i - j - slack)
                stretch = t[start : i - j + m + 2 * slack]
                # no more words can match than stand in the template
                if len([x for x in stretch if x in words]) < self.coverage * m:
                    continue
                got = align(stretch, template)
                if len(got) >= self.coverage * m and self.told(name, stretch, got):
                    hits.append((len(got), m, name, start + got[0][0], start + got[-1][0] + 1))
        hits.sort(key=lambda h: (-h[0], h[1], h[2], h[3], h[4]))
        out, used = [], bytearray(len(t))
        for n, m, name, s, e in hits:
            if 1 not in used[s:e]:
                out.append((name, s, e, n, m))
                used[s:e] = b"\1" * (e - s)
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, first_word, end_word, matched, template_words, coverage), a row for each notice found.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Words are
    runs of letters and digits, counted from 0. Texts without a notice, null and empty ones give
    no row. Of overlapping notices the one with the most matched words counts. A notice must have matched
    the words that tell its version and variant (``REQUIRED``). Words and texts may have any length. Repeated rows are
    scanned each, equal notices of a text count each; null doc_ids pass through; an empty table gives none.
    """
    scanner = Scanner(templates or TEMPLATES, coverage)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("matched", pa.int64()), ("template_words", pa.int64()), ("coverage", pa.float64())])
    keys = re.compile("|".join(map(re.escape, sorted(scanner.keys, key=len, reverse=True))), re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if (s := text.as_py()) and keys.search(s):
                    out += [(doc_id.as_py(), name, a, b, n, m, n / m) for name, a, b, n, m in scanner.find(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, license string, first_word long, end_word long, matched long, template_words long, coverage double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text of documents."""
    return scan(documents(spark, sf_dir))
