"""License scan: patience alignment of license templates with windows of a text.

Words that are unique to both a window and a template are anchors; the longest run of them that rises in both is kept,
and the gaps between kept anchors are aligned in the same way, where further words are unique. Where a gap has no such
words, equal words at its ends are matched. Coverage is the share of the template's words that are matched.

A template may name the license it stands for: such words must be there as they are, one after the other, so that
another version or a further condition is another license. Windows of a template with a name lie around the places of
its name, whose words are anchors already; those of one without start at runs of its words, and overlap. A notice that
is denied ("not released under ...") is none. Of notices that overlap, the one that its template is closest to stands:
twice the matched words by the words of template and span. A text is passed over for a template only if it lacks a
word of its name, or so many of its words that no alignment could reach the least coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratafield.llm.common import append_columns

_WORD = re.compile(r"[^\W_]+")
#: Texts of public licenses and notices. What is between braces is a name.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_CONDITION = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
_APACHE = "Licensed under the {Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {{{0}}} as published by the Free Software Foundation, either {{version {1}}} of the License, or (at your option) any later version."
_GNU_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/."
#: Licenses of the GNU family by short name, and conditions of Creative Commons licenses by letters.
_GNU_FAMILY = {"GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("3.0",))}
_CC_CONDITIONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Names in use, by license.
_NAMES = {
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License",),
    "Apache-1.0": ("Apache License, Version 1.0",),
    "Apache-1.1": ("Apache License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0"),
    "Unlicense": (),
    "0BSD": (),
}
_LEADS = ("Licensed under the {{{}}}", "Released under the {{{}}}", "Distributed under the {{{}}}", "This work is licensed under the {{{}}}")


def _templates() -> Iterator[tuple[str, str]]:
    """(license, text): full texts, then notices made of names and what stands before names."""
    yield from (("MIT", _MIT_GRANT + _MIT_CONDITION + _MIT_DISCLAIMER), ("MIT", _MIT_GRANT + _MIT_CONDITION), ("MIT-0", _MIT_GRANT + "." + _MIT_DISCLAIMER))
    yield from (("BSD-2-Clause", _BSD_TWO + _BSD_DISCLAIMER), ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER))
    yield from (("ISC", _ISC_GRANT + _ISC_CONDITION + _ISC_DISCLAIMER), ("0BSD", _ISC_GRANT + "." + _ISC_DISCLAIMER))
    yield from (("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("BSL-1.0", _BOOST), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL))
    names = [(k, n) for k, ns in _NAMES.items() for n in ns]
    for short, (name, versions) in _GNU_FAMILY.items():
        for v in versions:
            spelt = {v, v.removesuffix(".0")}
            for s in sorted(spelt):
                yield f"{short}-{v}", _GNU.format(name, s)
                yield f"{short}-{v}", _GNU.format(name, s) + _GNU_WARRANTY.format(name)
                names += [(f"{short}-{v}", n) for n in (f"{name}, version {s}", f"{name} v{s}", f"GNU {short} version {s}", f"GNU {short} v{s}", f"{short} version {s}", f"{short}v{s}", f"{short} {s}")]
    for (letters, words), v in product(_CC_CONDITIONS.items(), _CC_VERSIONS):
        license_ = f"CC-{letters}-{v}"
        for n in (f"CC {letters} {v}", f"Creative Commons {letters} {v}", f"Creative Commons {words} {v}"):
            yield license_, f"Licensed under {{{n}}}"
            yield license_, f"This work is licensed under a {{{n}}} International License"
    for license_, n in names:
        for lead in _LEADS:
            yield license_, lead.format(n)
    for license_ in dict.fromkeys([k for k, _ in names] + [*_NAMES] + [f"CC-{c}-{v}" for c, v in product(_CC_CONDITIONS, _CC_VERSIONS)]):
        for end in ("", "-only", "-or-later") if license_.partition("-")[0] in _GNU_FAMILY else ("",):
            yield license_, f"{{SPDX-License-Identifier: {license_}{end}}}"


TEMPLATES = tuple(_templates())
#: Words that deny a notice which they stand before, in the same sentence.
_DENIALS = frozenset("not no never neither nor cannot without unlike isn aren wasn weren hasn haven don doesn didn won nicht kein keine pas jamais nunca sin".split())
_REACH = 4


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second numbers rise: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


class Text:
    """Words of a text, where they are, and places of each."""

    def __init__(self, text: str):
        self.lowered = text.lower()
        self.words = _WORD.findall(self.lowered)
        self.present = set(self.words)
        self._spans: list[tuple[int, int]] | None = None
        self._places: dict[str, list[int]] = {}

    @property
    def spans(self) -> list[tuple[int, int]]:
        if self._spans is None:
            self._spans = [m.span() for m in _WORD.finditer(self.lowered)]
        return self._spans

    def places(self, word: str) -> list[int]:
        if word not in self._places:
            self._places[word] = [i for i, w in enumerate(self.words) if w == word]
        return self._places[word]

    def find(self, name: tuple[str, ...], first: int, past: int) -> Iterator[int]:
        """Where the words of a name stand one after the other, and go on neither before nor after."""
        places, n = self.places(name[0]), len(name)
        for k in range(bisect_left(places, first), len(places)):
            p = places[k]
            if p + n > past:
                return
            if tuple(self.words[p : p + n]) == name:
                a, z = self.spans[p][0], self.spans[p + n - 1][1]
                if not re.match(r"-\w|\.\d|\+", self.lowered[z : z + 2]) and not re.search(r"\w-$", self.lowered[max(0, a - 2) : a]):
                    yield p

    def denied(self, first: int, name: int, matched: set[int]) -> bool:
        """A denial stands shortly before the first matched word, in its sentence, or between it and the name."""
        for i in range(max(0, first - _REACH), name):
            if i not in matched and self.words[i] in _DENIALS and not re.search(r"[.!?;\n]", self.lowered[self.spans[i][1] : self.spans[max(i, first)][0]]):
                return True
        return False


class Template:
    def __init__(self, license_: str, text: str):
        self.license = license_
        self.words: list[str] = []
        self.names: list[tuple[int, int]] = []  # from, to
        for k, part in enumerate(re.split("[{}]", text)):
            words = words_of(part)
            if k % 2 and words:
                self.names.append((len(self.words), len(self.words) + len(words)))
            self.words += words
        if not self.words:
            raise ValueError(f"the template of {license_} has no words")
        self.needed = frozenset(w for a, z in self.names for w in self.words[a:z])
        self.counts = Counter(self.words)
        self.rare_first = sorted(self.counts.items(), key=lambda x: -len(x[0]))
        self.run = min(2, len(self.words))
        self.runs = {tuple(self.words[i : i + self.run]) for i in range(len(self.words) - self.run + 1)}

    def enough(self, least: float) -> int:
        """So many matched words are a share of `least`."""
        return ceil(least * len(self.words) - 1e-9)

    def can_reach(self, present, least: float) -> bool:
        spare = len(self.words) - self.enough(least)
        for w, n in self.rare_first:
            if w not in present:
                spare -= n
                if spare < 0:
                    return False
        return True

    def around_names(self, text: Text) -> Iterator[list[tuple[int, int]]]:
        """Matched places (in the text, in the template) around each place of the first name; other names follow it."""
        words, (start, end) = text.words, self.names[0]
        for p in text.find(tuple(self.words[start:end]), 0, len(words)):
            first = max(0, p - 2 * start - 2)
            left = align(words[first:p][::-1], self.words[:start][::-1])
            pairs = [(p - 1 - i, start - 1 - j) for i, j in reversed(left)] + [(p + i, start + i) for i in range(end - start)]
            at, done = p + end - start, end
            for a, z in self.names[1:]:
                q = next(text.find(tuple(self.words[a:z]), at, at + 2 * (a - done) + 4 + z - a), None)
                if q is None:
                    break
                pairs += [(at + i, done + j) for i, j in align(words[at:q], self.words[done:a])] + [(q + i, a + i) for i in range(z - a)]
                at, done = q + z - a, z
            else:
                rest = self.words[done:]
                pairs += [(at + i, done + j) for i, j in align(words[at : at + 2 * len(rest) + 2], rest)]
                if not text.denied(pairs[0][0], p, {i for i, _ in pairs}):
                    yield pairs

    def windows(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(from, to, most) of stretches at runs of template words; most: template words that are there in any order.

        They overlap, so no other run cuts a notice short. They come in three widths: the close ones have the fewest
        words that are not the notice's, the wide ones hold a notice with as many words put in as it has. A run less
        than `step` words after one that has a stretch is in that one's, which is so much longer; close stretches also
        start where words begin to agree.
        """
        n, k = len(self.words), self.run
        firsts = {r[0] for r in self.runs}
        at = [i for i, w in enumerate(words) if w in firsts and tuple(words[i : i + k]) in self.runs]
        spare, step = n // 2 + 1, max(1, n // 8)
        for before, after, close in ((0, n + n // 4, True), (spare, n + spare, False), (spare, 2 * n + spare, False)):
            inside: Counter = Counter()
            a = z = most = 0
            last, run = -step, -2
            for i in at:
                begins, run = i > run + 1, i
                if i - last < step and not (close and begins):
                    continue
                last = i
                for w in words[z : i + after + step]:
                    inside[w] += 1
                    most += inside[w] <= self.counts.get(w, 0)
                z = min(len(words), i + after + step)
                for w in words[a : max(a, i - before)]:
                    most -= inside[w] <= self.counts.get(w, 0)
                    inside[w] -= 1
                a = max(a, i - before)
                yield a, z, most

    def in_windows(self, words: list[str], least: float) -> Iterator[list[tuple[int, int]]]:
        """Matched places in each window that can reach `least`. What has been matched whole is not looked at again."""
        n, whole, end = len(self.words), [], -1
        for a, z, most in self.windows(words):
            if most < self.enough(least):
                continue
            k = bisect_left(whole, (a + 1,)) - 1
            if k >= 0 and a < whole[k][1] and z <= whole[k][1] + n:
                continue
            pairs = align(words[a:z], self.words)
            if len(pairs) == n:
                span = (a + pairs[0][0], a + pairs[-1][0] + 1)
                if span[0] > end:
                    whole.append(span)
                    end = span[1]
            yield [(a + i, j) for i, j in pairs]

    def notices(self, text: Text, least: float) -> Iterator[tuple[float, float, int, int]]:
        """(closeness, coverage, from, to) of stretches that are covered enough; of overlapping ones that with the most words."""
        n, found = len(self.words), set()
        for pairs in self.around_names(text) if self.names else self.in_windows(text.words, least):
            if pairs and len(pairs) >= self.enough(least):
                a, z = pairs[0][0], pairs[-1][0] + 1
                found.add((-len(pairs), z - a, a, z))
        for many, size, a, z in _apart(sorted(found)):
            yield -2 * many / (n + size), -many / n, a, z


def _apart(found: list[tuple]) -> Iterator[tuple]:
    """Of tuples that end with (from, to), best first, those that overlap no better one."""
    taken: list[tuple[int, int]] = []
    for x in found:
        a, z = x[-2:]
        k = bisect_left(taken, (a,))
        if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < z):
            continue
        taken.insert(k, (a, z))
        yield x


class Scanner:
    def __init__(self, templates, least: float):
        self.least = least
        self.named: dict[frozenset, list[Template]] = {}
        self.others: list[Template] = []
        for t in (Template(*t) for t in templates):
            if t.names:
                self.named.setdefault(t.needed, []).append(t)
            else:
                self.others.append(t)
        #: By the longest word of their names, one of which a text with a name must have.
        self.by_word: dict[str, list[frozenset]] = {}
        for needed in self.named:
            self.by_word.setdefault(max(needed, key=lambda w: (len(w), w)), []).append(needed)

    def notices(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, from word, to word) of all notices that stand, in order of place."""
        said = Text(text)
        found = []
        tried = [t for w in self.by_word.keys() & said.present for needed in self.by_word[w] if needed <= said.present for t in self.named[needed]]
        for t in tried + self.others:
            if t.can_reach(said.present, self.least):
                found += [(-closeness, a - z, t.license, c, a, z) for closeness, c, a, z in t.notices(said, self.least)]
        return sorted((x[2:] for x in _apart(sorted(found))), key=lambda x: x[2])

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, from word, to word) of each license's best notice, best first; ties by name."""
        best: dict[str, tuple[float, int, int]] = {}
        for license_, c, a, z in self.notices(text):
            if license_ not in best or c > best[license_][0]:
                best[license_] = (c, a, z)
        return sorted(((k, *v) for k, v in best.items()), key=lambda x: (-x[1], x[0]))


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, least: float = 0.8, name: str = "licenses") -> DataFrame:
    """docs with column `name`: array of license, coverage and span of words (start, end), best first, ties by name.

    templates: (license, text) pairs; `{...}` in a text is a name, whose words must stand as they are. Null and empty
    texts have no licenses. Texts are read whole; repeated rows stay; an existing column of that name, in any case, is
    replaced; an empty table gives an empty table.
    """
    item = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scanner = Scanner(templates, least)

        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array([[{"license": n, "coverage": c, "start": a, "end": z} for n, c, a, z in scanner.scan(t or "")] for t in column.to_pylist()], kind)]

        return work

    return append_columns(docs, [text], [T.StructField(name, T.ArrayType(item))], make)
