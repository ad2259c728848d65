"""License scans (operator 8): a positional index of rare licence words.

Texts have A-Z lower-cased; words are runs of letters, digits and characters beyond ASCII.  Base labels
come from places where a phrase's words stand one after another.

The method adds labels of its own from licence templates: one-line notices and whole licence texts.  The inverse document frequency of every
template word is counted over all texts.  A text is looked up by each template's ``LOOKUP`` words of
highest IDF: each place of such a word and each posting (template, place) of the word
vote for a start of the template in the text, and starts within ``DRIFT`` words join (a twelfth of the words
of a long template).  Where the words
found carry ``SHARE`` of the template's rare weight (the IDF of its ``LOOKUP`` highest words), the
template's mandatory key phrases are looked for in the words that it would cover; with all of them there,
the label counts.  ``score`` is the greatest such share of any template that is found, 1 if only base
phrases are, else 0.

Defined cases: null text counts as empty; texts without a word have no label, score 0 and null places;
a phrase may occur any number of times and all count; equal shares give all their labels; rows are scanned
one by one, so null ids and repeated rows need no care; extra columns are ignored; an empty table has
no words to count and no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import slices

LOOKUP, DRIFT, SHARE = 12, 3, 0.6
#: Fixed pattern: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and labels of the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates: label, usual words of the notice, mandatory key phrases.
TEMPLATES = [
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses", ["in compliance with the license", "apache org licenses"]),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit-line", "released under the mit license", ["under the mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-notice", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
]
#: Whole licence texts, fixed values: label, words, mandatory key phrases.
WHOLE = [
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall
be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited
to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
     ["permission is hereby granted", "the software is provided as is"]),
    ("bsd-2-clause-text", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce
the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is
provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or
consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on
any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
the possibility of such damage""",
     ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause-text", """redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission""",
     ["endorse or promote products", "prior written permission"]),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
     ["with or without fee", "the author disclaims all warranties"]),
    ("zlib-text", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the
following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented
as being the original software 3 this notice may not be removed or altered from any source distribution""",
     ["must not be misrepresented", "altered source versions"]),
    ("boost-text", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom
the software is furnished to do so all subject to the following""",
     ["prepare derivative works of the software"]),
    ("unlicense-text", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or
authors of this software dedicate any and all copyright interest in the software to the public domain""",
     ["free and unencumbered software", "copyright interest in the software"]),
    ("gpl-header", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without
even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu
general public license along with this program if not see https www gnu org licenses""",
     ["free software foundation", "in the hope that it will be useful"]),
    ("apache-header", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the
license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
     ["apache license", "unless required by applicable law or agreed to in writing"]),
    ("mpl-header", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
https mozilla org mpl 2 0""",
     ["mozilla public license", "a copy of the mpl was not distributed"]),
]
TEMPLATES += WHOLE
VOCABULARY = sorted({w for _, text, keys in TEMPLATES for part in (text, *keys) for w in part.split()} | {w for x in BASE for w in x.split()})
NUMBER = {w: i for i, w in enumerate(VOCABULARY)}


def licence_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of texts, licence word number of each word or -1)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")), BETWEEN)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    keep = pc.greater(pc.binary_length(flat), 0)
    at = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
    number = pc.fill_null(pc.index_in(flat.filter(keep), pa.array(VOCABULARY)), -1)
    return at, number.to_numpy(zero_copy_only=False)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many texts have each licence word, and the number of texts at the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(VOCABULARY) + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                at, number = licence_words(part.column("text"))
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                some = number >= 0
                pairs = np.unique(doc[some] * len(VOCABULARY) + number[some])
                total[:-1] += np.bincount(pairs % len(VOCABULARY), minlength=len(VOCABULARY))
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(VOCABULARY) + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    return out


class Index:
    """Template postings of each licence word, with weights by IDF."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.idf = np.log((frequencies[-1] + 1) / (frequencies[:-1] + 0.5))
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rare: list[set[int]] = []
        self.keys: list[list[list[int]]] = []
        self.length: list[int] = []
        for t, (_, text, keys) in enumerate(TEMPLATES):
            codes = [NUMBER[w] for w in text.split()]
            rare = sorted(set(codes), key=lambda w: (-self.idf[w], w))[:LOOKUP]
            self.rare.append(set(rare))
            self.length.append(len(codes))
            self.keys.append([[NUMBER[w] for w in k.split()] for k in keys])
            for i, w in enumerate(codes):
                if w in self.rare[-1]:
                    self.postings[w].append((t, i))
        self.weight = [sum(max(self.idf[w], 0.01) for w in r) for r in self.rare]
        # share of each template's weight by word, and the words of its key phrases
        self.share = np.zeros((len(VOCABULARY), len(TEMPLATES)))
        self.needs = np.zeros((len(VOCABULARY), len(TEMPLATES)))
        for t, r in enumerate(self.rare):
            for w in r:
                self.share[w, t] = max(self.idf[w], 0.01) / self.weight[t]
            self.needs[sorted({w for key in self.keys[t] for w in key}), t] = 1

    def likely(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, templates) that may go together: the text's words reach ``SHARE`` and have all words of the key phrases."""
        some = np.flatnonzero(number >= 0)
        has = np.zeros((len(at) - 1, len(VOCABULARY)), np.float32)
        has[np.searchsorted(at, some, side="right") - 1, number[some]] = 1
        return np.nonzero((has @ self.share >= SHARE - 1e-3) & (has @ self.needs >= self.needs.sum(0) - 0.5))

    def scan(self, number: np.ndarray, templates: list[int]) -> tuple[set[str], float]:
        """(labels, score) of one text's licence word numbers, of these templates."""
        labels, score = set(), 0.0
        for t in templates:
            if not all(len(places(number, key)) for key in self.keys[t]):
                continue
            votes = [(np.flatnonzero(number == w) - place, w) for w in self.rare[t] for u, place in self.postings[w] if u == t]
            starts, word = np.concatenate([s for s, _ in votes]), np.concatenate([np.full(len(s), w) for s, w in votes])
            order = np.lexsort((word, starts))
            starts, word = starts[order], word[order]
            first = np.flatnonzero(np.append(True, starts[1:] != starts[:-1])) if len(starts) else np.zeros(0, np.int64)
            drift = max(DRIFT, self.length[t] // 12)
            end = np.searchsorted(starts, starts[first] + drift, side="right")
            # repeated words count here, so that nothing is passed over that reaches the share
            upto = np.append(0.0, np.cumsum(self.share[word, t]))
            for k in np.flatnonzero(upto[end] - upto[first] >= SHARE - 1e-9).tolist():
                share = sum(self.share[w, t] for w in set(word[first[k] : end[k]].tolist()))
                if share < SHARE - 1e-12 or share <= score and TEMPLATES[t][0] in labels:
                    continue
                start = int(starts[first[k]])
                window = number[max(0, start - drift) : start + self.length[t] + 2 * drift]
                if all(len(places(window, key)) for key in self.keys[t]):
                    labels.add(TEMPLATES[t][0])
                    score = max(score, min(1.0, float(share)))
        return labels, score


def places(number: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where a phrase's words stand one after another."""
    n = len(number) - len(phrase) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(number[:n] == phrase[0])
    for j, w in enumerate(phrase[1:], 1):
        hit = hit[number[hit + j] == w]
    return hit


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of every text."""
    index = docs.sparkSession.sparkContext.broadcast(Index(document_frequencies(docs, text_col)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [([NUMBER[w] for w in x.split()], label) for x, label in BASE.items()]
        for batch in batches:
            for part in slices(batch):
                at, number = licence_words(part.column("text"))
                rows = part.num_rows
                n_base, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
                base: list[set[str]] = [set() for _ in range(rows)]
                for phrase, label in phrases:
                    hit = places(number, phrase)
                    doc = np.searchsorted(at, hit, side="right") - 1
                    inside = hit + len(phrase) <= at[doc + 1]
                    for i, d in zip(hit[inside].tolist(), doc[inside].tolist(), strict=True):
                        place = i - int(at[d])
                        n_base[d] += 1
                        first[d] = place if first[d] < 0 else min(first[d], place)
                        last[d] = max(last[d], place)
                        base[d].add(label)
                labels, scores = [set(x) for x in base], np.array([1.0 if x else 0.0 for x in base])
                likely: dict[int, list[int]] = defaultdict(list)
                for d, t in zip(*(x.tolist() for x in index.value.likely(at, number)), strict=True):
                    likely[d].append(t)
                for d, templates in likely.items():
                    got, score = index.value.scan(number[at[d] : at[d + 1]], templates)
                    if got:
                        labels[d] |= got
                        scores[d] = score
                none = first < 0
                joined = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), joined(base), joined(labels), pa.array(scores)],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(find, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)
