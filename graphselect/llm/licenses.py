"""Operator 7: license scan by winnowed fingerprints and banded alignment.

Templates are winnowed: of each window of k-grams of words, the one with the
least hash goes into an inverted index.  A document's k-grams are looked up
there; hits of one template on nearby diagonals make a candidate, and a banded
local alignment of the words there and the template's tells how much of the
template is matched, and where; what is matched is masked, and the rest aligned
again.  Any run of GRAM + WINDOW - 1 words of a template that a document repeats
makes a candidate.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 3
WINDOW = 2
#: Words by which an alignment may leave its diagonal.
BAND = 8
#: Least share of a template's words that a reported match covers.
COVERAGE = 0.6

#: Short notices, headers and full texts of widespread public licenses, by name.
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "apache-2.0-short": "Licensed under the Apache License Version 2.0",
    "gpl-3-notice": "This work is licensed under the GNU General Public License version 3",
    "gpl-2-notice": "This work is licensed under the GNU General Public License version 2",
    "lgpl-notice": "This work is licensed under the GNU Lesser General Public License",
    "agpl-3-notice": "This work is licensed under the GNU Affero General Public License version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0-grant": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
}
#: Identifiers of the SPDX list; a file tagged with one is a match of its own.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD Zlib BSL-1.0 Unlicense MPL-2.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
TEMPLATES |= {f"spdx:{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def lowered(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


class Index:
    def __init__(self, templates: dict[str, str] = TEMPLATES, gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE):
        self.gram, self.band, self.coverage = gram, band, coverage
        self.names = list(templates)
        words = [WORD.findall(lowered(x)) for x in templates.values()]
        self.code_of = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for x in words for w in x))}
        self.templates = [np.array([self.code_of[w] for w in x], np.int64) for x in words]
        self.base = len(self.code_of) + 1
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, codes in enumerate(self.templates):
            keys = self.grams(codes).tolist()
            order = [(xxhash.xxh64_intdigest(k.to_bytes(16, "little")), -p, p) for p, k in enumerate(keys)]
            for p in {min(order[a : a + window])[2] for a in range(max(1, len(order) - window + 1))} if order else ():
                self.index.setdefault(keys[p], []).append((t, p))
        self.keys = np.array(sorted(self.index), np.int64)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """One number for each k-gram; 0 where a word is in no template."""
        n = len(codes) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.gram):
            key = key * self.base + codes[k : k + n]
            known &= codes[k : k + n] > 0
        return np.where(known, key, 0)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, list[tuple[int, int]]]]:
        """(license, coverage, matched words, start, end, spans) of each match; places are code points, spans are runs of matched words."""
        low = lowered(text)
        words = WORD.findall(low)
        codes = np.fromiter(map(self.code_of.get, words, repeat(0)), np.int64, len(words))
        keys = self.grams(codes)
        at = np.flatnonzero(keys)
        at = at[np.isin(keys[at], self.keys)]
        if not len(at):
            return []
        starts: dict[int, list[int]] = {}
        for p in at.tolist():
            for t, q in self.index[int(keys[p])]:
                starts.setdefault(t, []).append(p - q)
        places: list[tuple[int, int]] = []
        matches = []
        for t, diagonals in starts.items():
            for pairs in self.matches(codes, t, sorted(diagonals)):
                places = places or [(m.start(), m.end()) for m in WORD.finditer(low)]
                runs: list[list[int]] = []
                for p, _ in pairs:
                    if runs and p == runs[-1][1] + 1:
                        runs[-1][1] = p
                    else:
                        runs.append([p, p])
                spans = [(places[x][0], places[y][1]) for x, y in runs]
                matches.append((self.names[t], len(pairs) / len(self.templates[t]), len(pairs), spans[0][0], spans[-1][1], spans))
        # Of matches that overlap the one with most words stays, then the one that covers most of its template.
        kept: list = []
        for m in sorted(matches, key=lambda m: (-m[2], -m[1], m[3], m[0])):
            k = bisect.bisect_right(kept, m[3], key=lambda x: x[3])
            if (k == 0 or kept[k - 1][4] <= m[3]) and (k == len(kept) or m[4] <= kept[k][3]):
                kept.insert(k, m)
        return kept

    def matches(self, codes: np.ndarray, t: int, diagonals: list[int]) -> Iterator[list[tuple[int, int]]]:
        """Alignments of template t around ascending diagonals, as pairs (place in codes, place in template); none shares a word with another.

        What an alignment spans is masked, and its surroundings are aligned
        again until nothing there reaches the coverage, so that copies of a
        template that stand side by side are all found.
        """
        template, masked, last = self.templates[t], None, None
        size, need = len(template), self.coverage * len(template)
        own = np.bincount(template, minlength=self.base)
        for diagonal in diagonals:
            # Copies side by side are a template's length apart.
            if last is not None and diagonal - last <= min(self.band, (size - 1) // 2):
                continue
            last = diagonal
            a, b = max(0, diagonal - 2 * self.band), diagonal + size + 2 * self.band
            while True:
                words = (codes if masked is None else masked)[a:b]
                # No alignment has more words than the two have in common in any order.
                if np.minimum(np.bincount(words[words > 0], minlength=self.base), own).sum() < need:
                    break
                pairs = self.align(words, template, diagonal - a)
                if len(pairs) < need:
                    break
                yield [(a + p, q) for p, q in pairs]
                masked = codes.copy() if masked is None else masked
                masked[a + pairs[0][0] : a + pairs[-1][0] + 1] = 0

    def align(self, doc: np.ndarray, template: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
        """Pairs (place in doc, place in template) of equal words in the best local alignment within the band around a diagonal."""
        band, n, m = self.band, len(doc), len(template)
        width = 4 * band + 1
        score = [[0] * (width + 2) for _ in range(m + 1)]  # score[j][d]: doc place j + diagonal - 2 band + d - 1
        step = [[0] * (width + 2) for _ in range(m + 1)]
        best, end = 0, (0, 0)
        doc_, template_ = doc.tolist(), template.tolist()
        for j in range(1, m + 1):
            row, above, steps, word = score[j], score[j - 1], step[j], template_[j - 1]
            for d in range(1, width + 1):
                i = j - 1 + diagonal - 2 * band + d - 1
                if not 0 <= i < n:
                    continue
                equal = above[d] + (2 if doc_[i] == word else -2)  # both move on: the same diagonal
                skip_template, skip_doc = above[d + 1] - 1, row[d - 1] - 1
                s = max(0, equal, skip_template, skip_doc)
                if s:
                    row[d] = s
                    steps[d] = 1 if s == equal else 2 if s == skip_template else 3
                    if s > best:
                        best, end = s, (j, d)
        pairs = []
        j, d = end
        while j and step[j][d]:
            kind = step[j][d]
            if kind == 1:
                i = j - 1 + diagonal - 2 * band + d - 1
                if doc_[i] == template_[j - 1]:
                    pairs.append((i, j - 1))
                j -= 1
            elif kind == 2:
                j, d = j - 1, d + 1
            else:
                d -= 1
        return pairs[::-1]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each match: doc_id, license, coverage, n_matched, start, end, spans; no shuffle.

    Null and empty texts have none, and an empty table has no row; a notice that
    a text repeats is a match each time, and so is each of rows that repeat an
    id.  Of matches that overlap the one with most words stays; of equal ones
    the one that covers most of its template, then the first by name.
    """
    common.short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        index = Index(templates or TEMPLATES, coverage=coverage)
        for batch in common.nonempty(batches):
            out = [(name, *m[:5], [{"start": a, "end": b} for a, b in m[5]]) for name, text in zip(batch.column(0).to_pylist(), common.strings(batch.column(1))) for m in index.scan(text)]
            if out:
                yield common.record(schema, list(zip(*out)))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, start long, end long, spans array<struct<start: long, end: long>>")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
