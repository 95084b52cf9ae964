"""License scans by conditional compression.

Candidate blocks are compressed alone and, for each template, with the template as zstandard raw
dictionary, and templates are ranked by the relative size reduction. Along the ranking, each
template is aligned with the block word by word until one is confirmed. The alignment is local:
the whole template against any stretch of the block, with the fewest wording differences, which
are the template's words that the stretch lacks and the words it puts in between. A template
is confirmed if they are at most DIFFERENCES percent of its words and no differing word tells
licences apart (a number, or a word of TELLING). The stretch is then cut out and both rests
are ranked anew, until nothing is confirmed.

Candidate blocks depend on words alone, not on lines, so a notice is found in any layout and in
running text. A word belongs to a block if it stands in a pair of neighbouring words that some
template has; blocks end where more words than any notice may put in between stand in no such
pair. Templates which a text cannot hold, since more of their words are absent from it than
may differ, take no part; most texts end there.

Defined results: null or empty text has no block; a block without a confirmed template gives
no row; of equal reductions the template name decides, of equal alignments the first; a
row's span (start, end) runs from its first to its last matched word with the marks behind
it; repeated rows give their rows again, with a null id if they have none; an empty table gives
no row; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, prepare

DIFFERENCES = 20
LEVEL = 19
REMEMBERED_CHARS = 2000      # blocks up to this length are remembered, 4,096 of them

# Notices of public licences, as their authors publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        'with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
}
TELLING = frozenset("affero agpl apache bsd by cc cc0 clause gnu gpl isc lesser lgpl mit mozilla mpl nc nd sa".split())
WORD = re.compile(r"\w+(?:\.\d+)*")
MARKS = re.compile(r"[^\w\s]*")      # what closes a notice behind its last word


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


WANTED = {name: words(text) for name, text in TEMPLATES.items()}
ALLOWED = {name: DIFFERENCES * len(want) // 100 for name, want in WANTED.items()}
KINDS = {name: frozenset(want) for name, want in WANTED.items()}
PAIRS = {name: frozenset(zip(want, want[1:])) for name, want in WANTED.items()}


def _telling(word: str) -> bool:
    return word in TELLING or word[0].isdigit()


def possible(kinds: set[str]) -> list[str]:
    """Templates of which a text with these words does not lack too many."""
    out = []
    for name, want in KINDS.items():
        left = ALLOWED[name]
        for w in want:
            if w not in kinds:
                left -= 1
                if left < 0 or _telling(w):
                    break
        else:
            out.append(name)
    return out


def candidate_blocks(have: list[str], names: list[str]) -> list[tuple[int, int]]:
    """[first, end) word spans that may hold notices of the templates ``names``."""
    known = frozenset().union(*(PAIRS[n] for n in names))
    pairs = [k for k, p in enumerate(zip(have, have[1:])) if p in known]
    gap, spans = max(ALLOWED[n] for n in names) + 2, []
    for k in pairs:
        if spans and k - spans[-1][1] <= gap:
            spans[-1][1] = k + 2
        else:
            spans.append([k, k + 2])
    # a notice's first and last words may stand in no pair
    edge, out = gap, []
    for a, b in spans:
        a, b = max(0, a - edge), min(len(have), b + edge)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@lru_cache(1)
def _compressors() -> tuple:
    plain = zstandard.ZstdCompressor(level=LEVEL)
    return plain, {name: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(
        text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in TEMPLATES.items()}


def reductions(block: str, names=tuple(TEMPLATES)) -> list[tuple[float, str]]:
    """(relative size reduction, template), best first."""
    plain, given = _compressors()
    raw = block.encode()
    alone = len(plain.compress(raw))
    return sorted(((1 - len(given[name].compress(raw)) / alone, name) for name in names), key=lambda x: (-x[0], x[1]))


def aligned(have: list[str], want: list[str]) -> tuple[list[str], int, int]:
    """The fewest wording differences between ``want`` and a stretch of ``have``, and the first
    and the end of its matched words; of equal ones the stretch that ends first."""
    number = {w: k for k, w in enumerate(dict.fromkeys(want))}
    x = np.array([number.get(w, -1) for w in have], np.int32)
    place = np.arange(len(x) + 1, dtype=np.int32)
    table = np.zeros((len(want) + 1, len(x) + 1), np.int32)      # fewest differences of want[:i], ending at j
    for i, w in enumerate(want, 1):
        row = table[i - 1] + 1
        row[1:] = np.where(x == number[w], table[i - 1, :-1], row[1:])
        table[i] = np.minimum.accumulate(row - place) + place
    j = int(table[-1].argmin())
    i, found, matched = len(want), [], []
    while i:
        if j and x[j - 1] == number[want[i - 1]] and table[i, j] == table[i - 1, j - 1]:
            i, j = i - 1, j - 1
            matched.append(j)
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
            found.append(f"-{want[i]}")
        else:
            j -= 1
            found.append(f"+{have[j]}")
    if not matched:
        return [f"-{w}" for w in want], 0, 0
    return found[::-1], matched[-1], matched[0] + 1


def wording_differences(block: str, template: str) -> list[str]:
    """Words of the template that the block lacks (-) and words it puts in between (+)."""
    return aligned(words(block), words(template))[0]


def confirmed(have: list[str], name: str) -> tuple[int, int, int] | None:
    """(number of differences, first and end of the matched words) if the template is there."""
    want = WANTED[name]
    lacking = Counter(want) - Counter(have)                      # differences in any alignment
    if lacking.total() > ALLOWED[name] or any(map(_telling, lacking)):
        return None
    differences, first, end = aligned(have, want)
    if len(differences) > ALLOWED[name] or any(_telling(d[1:]) for d in differences):
        return None
    return len(differences), first, end


def identify(block: str) -> list[tuple[int, int, str, float, int]]:
    """(start, end, template, reduction, number of differences) of each notice of a block."""
    places = [m.span() for m in WORD.finditer(block)]
    have = words(block)
    found, work = [], [(0, len(have))]
    while work:
        a, b = work.pop()
        part = have[a:b]
        if a == b or not possible(set(part)):
            continue
        for _, name in reductions(block[places[a][0]:places[b - 1][1]]):
            hit = confirmed(part, name)
            if hit:
                n, first, end = hit[0], a + hit[1], a + hit[2]
                start, stop = places[first][0], MARKS.match(block, places[end - 1][1]).end()
                found.append((start, stop, name, reductions(block[start:stop], (name,))[0][0], n))
                work += [(a, first), (end, b)]
                break
    return sorted(found)


_remembered = lru_cache(4096)(identify)


def notices(text: str) -> list[tuple[int, int, str, float, int]]:
    """(start, end, template, reduction, number of differences) of each notice of a text."""
    have = words(text)
    names = possible(set(have))
    if not names:
        return []
    places, out = [m.span() for m in WORD.finditer(text)], []
    for a, b in candidate_blocks(have, names):
        start = places[a][0]
        block = text[start:MARKS.match(text, places[b - 1][1]).end()]
        found = _remembered(block) if len(block) <= REMEMBERED_CHARS else identify(block)
        out += ((start + x, start + y, *rest) for x, y, *rest in found)
    return out


FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()),
                   ("reduction", pa.float64()), ("differences", pa.int64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed notice: doc_id, start and end (code points), license, reduction,
    differences (0: the exact wording)."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for hit in (notices(text) if text else ())]
            yield batches_of(dict(zip(FOUND.names, zip(*rows))) if rows else {n: [] for n in FOUND.names}, FOUND)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, end long, license string, reduction double, differences long")
