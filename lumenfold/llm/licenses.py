"""License scans by an exact set-similarity join of license templates with every block of every text.

A template joins a block when the block holds at least CONTAINMENT of the template's distinct words, and all words that
name the license. Blocks of a template are all runs of 1.25 times its length in words, at every offset, and shorter whole
texts. Words are put in one global order, rarest in the corpus first, counted over all documents; a block that reaches the
threshold must hold a word of the template's prefix in that order (prefix filter), so only stretches around such words
are looked at; a stretch must hold enough of the template's words (length filter), and the words still to come after the
first shared one must suffice (positional filter). What passes is verified by a sliding count, so the join is exact. Blocks
that overlap are one find, the one with the most words; a text has as many finds of a label as it holds notices: where their first and
last shared words stand, and their containment. A find yields to one of another label that shares more words and covers
it, so that a license whose notice is part of another's isn't named for that one.

The template side is a fixed list in this module, so its index is small at any corpus size; word frequencies are
gathered for its words alone.

Nulls: a null text has no words; a null doc_id stays null. Empty tables give empty results; each repeated row gets its
row. Extra columns are ignored. doc_ids cross Python as text, as a batch with a null would make doubles of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINMENT = 0.8
BLOCK = 1.25
#: Phrases and labels of the base contract (fixed values).
PHRASES = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))
WARRANTY = "EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE"
#: Licenses' notices and texts: label, words that name it and so must all be there, text (fixed values).
TEMPLATES = (
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0"),
    ("apache-2.0", "compliance", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License. You may not use this file except in compliance with the License."),
    ("apache-2.0", "contributor patent", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "noninfringement authors", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, " + WARRANTY + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "bsd", "Licensed under the BSD License"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "redistributions binary", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "isc", "Released under the ISC License"),
    ("isc", "permission fee granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "permission fee granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("gpl", "gnu general", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "gnu general", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "gnu lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "gnu lesser", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "gnu affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "gnu affero", "Licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0"),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http www eclipse org legal epl 2.0"),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("boost", "boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at http www boost org LICENSE"),
    ("cc-by", "creative attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "creative sharealike", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "creative noncommercial", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nd", "creative noderivatives", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "creative noncommercial sharealike", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "creative noncommercial noderivatives", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"),
    ("cc-by-nd", "cc by nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "waived", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "cc0", "Released into the public domain under CC0 1.0 Universal"),
    ("wtfpl", "wtfpl", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, WTFPL, Version 2"),
    ("ofl", "ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1, OFL. This license is available with a FAQ at http scripts sil org OFL"),
    ("artistic-2.0", "artistic", "This is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0"),
)
#: Bytes that words are made of: digits, letters (lowered) and all bytes of characters beyond ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def vocabulary() -> set[bytes]:
    return {w for _, _, t in TEMPLATES for w in tokens(t)}


def word_counts(docs: DataFrame) -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents. One number per template word."""
    known = vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(known.intersection(tokens(t)))
        yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())}).astype({"word": "object", "n": "int64"})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


class Index:
    """Templates under the global word order, by the words of their prefixes."""

    def __init__(self, counts: dict[bytes, int]) -> None:
        place = {w: i for i, w in enumerate(sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w)))}
        self.sets, self.prefixes = [], {}
        for k, (label, names, text) in enumerate(TEMPLATES):
            got = tokens(text)
            order = sorted(set(got), key=place.__getitem__)
            least = ceil(CONTAINMENT * len(order))
            self.sets.append((label, order, frozenset(order), frozenset(tokens(names)), least, ceil(BLOCK * len(got))))
            for w in order[: len(order) - least + 1]:
                self.prefixes.setdefault(w, []).append(k)
        self.prefix_words = frozenset(self.prefixes)

    def matches(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, containment, first shared word, last shared word) of the finds in `words`, in order."""
        own = set(words)
        found: list[tuple[int, int, int, str, float]] = []
        for k in sorted({k for w in own & self.prefix_words for k in self.prefixes[w]}):
            label, order, whole, names, least, length = self.sets[k]
            if not names <= own or len(own) < least:
                continue
            first = next(i for i, w in enumerate(order) if w in own)
            if len(order) - first < least or sum(w in own for w in order[first:]) < least:
                continue
            start = frozenset(order[: len(order) - least + 1])
            inside = [(i, w) for i, w in enumerate(words) if w in whole]
            for part in _stretches(inside, start, length):
                if len(part) >= least:
                    found += [(n, a, b, label, n / len(order)) for n, a, b in _blocks(part, names, least, length)]
        return strongest(found)


def strongest(found: list[tuple[int, int, int, str, float]]) -> list[tuple[str, float, int, int]]:
    """Of finds (shared words, first, last, label, containment) those that stay. They are taken in order; a find is compared
    with those that are still open where it begins."""
    kept: list[tuple[int, int, int, str, float]] = []
    for label in sorted({f[3] for f in found}):
        # Of finds that overlap the one with the most words stays, then the one with the higher containment, then the first.
        mine: list[tuple[int, int, int, str, float]] = []
        for f in sorted((f for f in found if f[3] == label), key=lambda f: (-f[0], -f[4], f[1], f[2])):
            at = bisect_left(mine, f[1], key=lambda g: g[1])
            if not (at and mine[at - 1][2] >= f[1]) and not (at < len(mine) and mine[at][1] <= f[2]):
                mine.insert(at, f)
        kept += mine
    out, open_ = [], []
    for f in sorted(kept, key=lambda f: (f[1], -f[2], -f[0], f[3])):
        open_ = [g for g in open_ if g[2] >= f[1]]
        if not any(g[3] != f[3] and g[0] > f[0] and g[1] <= f[1] and f[2] <= g[2] for g in open_):
            open_.append(f)
            out.append((f[3], f[4], f[1], f[2]))
    return out


def _stretches(inside: list[tuple[int, bytes]], start: frozenset[bytes], length: int) -> Iterator[list[tuple[int, bytes]]]:
    """The shared words that lie in a block with a prefix word, in stretches; no other block can reach the threshold."""
    held: list[tuple[int, bytes]] = []
    marks = [i for i, w in inside if w in start]
    m = 0
    for i, w in inside:
        while m < len(marks) and marks[m] <= i - length:
            m += 1
        if m < len(marks) and marks[m] < i + length:
            if held and i - held[-1][0] >= length:
                yield held
                held = []
            held.append((i, w))
    if held:
        yield held


def _blocks(part: list[tuple[int, bytes]], names: frozenset[bytes], least: int, length: int) -> list[tuple[int, int, int]]:
    """(distinct words, first place, last place) of the blocks of a stretch that hold `least` words and all `names`, each cut
    to the words that count."""
    held: Counter[bytes] = Counter()
    found: list[tuple[int, int, int]] = []
    low = 0
    for k, (i, w) in enumerate(part):
        held[w] += 1
        while part[low][0] <= i - length:
            old = part[low][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            low += 1
        if len(held) >= least and names <= held.keys():
            # Words before the first one that counts once more don't belong to the block.
            while held[part[low][1]] > 1:
                held[part[low][1]] -= 1
                low += 1
            one = (len(held), part[low][0], i)
            if found and found[-1][1] == one[1] and found[-1][0] < one[0]:
                found[-1] = one  # the same block, further on
            elif not found or found[-1][0] != one[0] or found[-1][1] != one[1]:
                found.append(one)
    return found


def _places(words: list[bytes]) -> tuple[list[int], list[str]]:
    """Word positions of all base phrases, and their labels."""
    line = b" " + b" ".join(words) + b" "
    at, labels = [], []
    for phrase, label in PHRASES:
        sought, k, last, n = b" " + phrase + b" ", -1, 0, 0
        while (k := line.find(sought, k + 1)) >= 0:
            n, last = n + line.count(b" ", last, k), k  # blanks are counted on from the place before
            at.append(n)
            if label not in labels:
                labels.append(label)
    return at, labels


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: the contract's columns of op9, and `blocks`, `label:first word:last word:containment` of the
    method's finds, sorted and comma-joined."""
    index = Index(word_counts(docs))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                words = tokens(t)
                at, base = _places(words)
                more = index.matches(words)
                score = 1.0 if at else max((x[1] for x in more), default=0.0)
                blocks = ",".join(f"{x[0]}:{x[2]}:{x[3]}:{x[1]:.3f}" for x in sorted(more))
                out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *(x[0] for x in more)})), score, blocks))
            frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
            frame = frame.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})
            frame.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield frame

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scan, "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
