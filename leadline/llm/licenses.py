r"""Licence scan: Dice coefficient over word bigrams against licence templates.

A template's Dice in a text is the best 2 |A and B| / (|A| + |B|) of its set of word bigrams B and
the set A of any run of consecutive words: a line, a paragraph, the text, or a part of them, also
over line ends. It matches from ``least`` on. No run is left out: a best run begins and ends with a
bigram of the template, needs no second occurrence of its first one, and misses at most
(2 / least - 2) |B| others, so these alone are tried, in texts with enough of the template's bigrams.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.batches import map_texts
from leadline.llm.decontamination import words_of

LEAST = 0.8

# Grant lines and notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
    " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
    " option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    ' associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All rights reserved": "All rights reserved.",
}

# The other standard paragraphs, scanned for besides TEMPLATES.
PARAGRAPHS = {
    "Apache-2.0 disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is"
    ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
    " the specific language governing permissions and limitations under the License.",
    "BSD binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED'
    " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE"
    " ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
    " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF"
    " ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.",
    "BSD source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer.",
    "CC 4.0 notice": "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative"
    " Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "GPL copy": "You should have received a copy of the GNU General Public License along with this program. If not, see"
    " <https://www.gnu.org/licenses/>.",
    "GPL disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
    " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the Software.",
    "MIT disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED'
    " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT permission paragraph": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    ' associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
    " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(pairwise(words))


def best_run(words: list[bytes], places: list[int], own: frozenset[tuple[bytes, bytes]], least: float) -> float:
    """The best Dice with ``own`` of any run of ``words``, if it is at least ``least``; else less than that.

    ``places`` are where bigrams of ``own`` begin. Runs still open at a word began with different
    bigrams of ``own``, so the steps are at most its size times the words.
    """
    misses = len(own) * (2 / least - 2) + 1e-9
    best = 0.0
    for at in places:
        seen: set[tuple[bytes, bytes]] = set()
        shared = 0
        for k in range(at, len(words) - 1):
            gram = (words[k], words[k + 1])
            if gram in seen:
                if k > at and gram == (words[at], words[at + 1]):
                    break
                continue
            seen.add(gram)
            if gram in own:
                shared += 1
                best = max(best, 2 * shared / (len(seen) + len(own)))
            elif len(seen) - shared > misses:
                break
    return best


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and ``matches`` (licence, dice), by licence, of every row: the best run's Dice per licence.

    Words are lower-cased runs of letters, digits and non-ASCII characters. Without ``templates``
    those of TEMPLATES and PARAGRAPHS count. Templates and texts of fewer than two words match
    nothing, null texts neither. Null ids and repeated rows are passed on; an empty table stays
    empty; extra columns are not read.
    """
    bodies = {**TEMPLATES, **PARAGRAPHS} if templates is None else templates
    known = sorted((name, bigrams(words_of(text.encode()))) for name, text in bodies.items())
    ratio = least / (2 - least)
    holders: dict[tuple[bytes, bytes], list[int]] = {}
    for t, (_, own) in enumerate(known):
        for gram in own:
            holders.setdefault(gram, []).append(t)

    def work(texts, part):
        out = []
        for text in texts.to_pylist():
            words = words_of(text)
            places: dict[int, list[int]] = {}
            for k, gram in enumerate(pairwise(words)):
                for t in holders.get(gram, ()):
                    places.setdefault(t, []).append(k)
            found = []
            for t in sorted(places):
                name, own = known[t]
                # A match shares at least this part of the template's bigrams.
                if len({(words[k], words[k + 1]) for k in places[t]}) >= ratio * len(own) - 1e-9:
                    dice = best_run(words, places[t], own, least)
                    if dice >= least:
                        found.append({"licence": name, "dice": dice})
            out.append(found)
        return {"matches": out}

    match = T.StructType([T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", [T.StructField("matches", T.ArrayType(match))], work, ["doc_id"])
