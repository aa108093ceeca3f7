"""License scan with a positional index of rare words.

The document frequency of every template word is counted over all documents. Templates are whole licence texts or the
notices by which files refer to them, indexed by word: word -> places in each template. Of a document's words that a
template has, those of highest IDF are looked up; a word's place in the document, less its place in the template, votes
for an alignment. Alignments with enough votes are weighed by the IDF share of the template found there, give or take
a few words, and count once the template's mandatory phrase stands where it should. The base phrases are found through
the same index, each by its rarest word, at all their places.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from kinspan.llm import _docs

# The phrases and labels that every scan reports.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WITHOUT_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
    "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
    "software even if advised of the possibility of such damage"
)
_GNU_NOTICE = (
    "this program is free software you can redistribute it and or modify it under the terms of the {0} as published by "
    "the free software foundation either version {1} of the license or at your option any later version this program is "
    "distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
    "merchantability or fitness for a particular purpose see the {0} for more details you should have received a copy of "
    "the {0} along with this program if not see"
)

# Public licence texts and notices, as words, each with a phrase that it can't be without.
#: label -> (text, mandatory phrase within it). Labels beside the base ones; add more by parameter.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations "
        "under the license",
        "apache license version 2 0",
    ),
    "gpl-2.0": ("under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-2.0-notice": (_GNU_NOTICE.format("gnu general public license", "2"), "terms of the gnu general public license as published"),
    "gpl-3.0": ("under the terms of the gnu general public license version 3", "gnu general public license version 3"),
    "gpl-3.0-notice": (_GNU_NOTICE.format("gnu general public license", "3"), "either version 3 of the license"),
    "lgpl": ("under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    "agpl-3.0-notice": (_GNU_NOTICE.format("gnu affero general public license", "3"), "gnu affero general public license"),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software " + _WITHOUT_WARRANTY,
        "permission is hereby granted free of charge",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
        "provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect "
        "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of "
        "this software",
        "with or without fee is hereby granted",
    ),
    "bsd": (_BSD_CONDITIONS + " " + _BSD_DISCLAIMER, "redistribution and use in source and binary forms"),
    "bsd-3-clause": (
        _BSD_CONDITIONS + " 3 neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission " + _BSD_DISCLAIMER,
        "endorse or promote products derived from this software",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
        "following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote "
        "the original software if you use this software in a product an acknowledgment in the product documentation would "
        "be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be "
        "misrepresented as being the original software 3 this notice may not be removed or altered from any source "
        "distribution",
        "the origin of this software must not be misrepresented",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        "mozilla public license",
    ),
    "cc-by-4.0": ("licensed under a creative commons attribution cc by 4 0 international license", "cc by 4 0"),
    "cc-by-sa": ("licensed under a creative commons attribution sharealike cc by sa license", "cc by sa"),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    "as-is": (_WITHOUT_WARRANTY, "without warranty of any kind"),
}

#: Words of highest IDF by which a document meets a template; votes that an alignment needs; words by which a part of a
#: template may be off its place.
RAREST, VOTES, DRIFT = 8, 2, 3
#: A template counts from this share of its IDF on.
LEAST = 0.3

_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_LETTERS).split()


@dataclass
class Index:
    """Templates by word. idf: of every template word, over all documents."""

    idf: dict[bytes, float]
    templates: list[tuple[str, list[bytes], list[bytes]]]  # label, words, mandatory phrase
    base: list[tuple[str, list[bytes]]]
    postings: dict[bytes, dict[int, list[int]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))

    def __post_init__(self):
        for number, (_, words, _) in enumerate(self.templates):
            for at, word in enumerate(words):
                self.postings[word][number].append(at)
        self.postings = {word: dict(of) for word, of in self.postings.items()}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]
        self.at = [_find(words, phrase) for _, words, phrase in self.templates]
        self.rarest = [(label, words, *self.rare(words)) for label, words in self.base]
        self.known = frozenset(self.idf)
        #: No document without one of these has a base phrase or a mandatory phrase.
        self.keys = frozenset(
            [w for *_, w, _ in self.rarest] + [self.rare(phrase)[0] for *_, phrase in self.templates]
        )

    def rare(self, words: list[bytes]) -> tuple[bytes, int]:
        """The word of highest IDF and its place."""
        at = max(range(len(words)), key=lambda k: (self.idf[words[k]], -k))
        return words[at], at

    def alignments(self, places: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
        """(template, shift) that VOTES of the document's rarest words agree on, for each template that has them."""
        met = defaultdict(list)
        for word in sorted(places, key=lambda w: (-self.idf[w], w)):
            for number in self.postings.get(word, ()):
                if len(met[number]) < RAREST:
                    met[number].append(word)
        for number, words in met.items():
            votes = Counter(place - at for word in words for at in self.postings[word][number] for place in places[word])
            yield from ((number, shift) for shift, n in votes.items() if n >= VOTES)

    def share(self, number: int, shift: int, words: list[bytes]) -> float:
        """How much of a template's IDF stands where the alignment puts it, give or take DRIFT words."""
        found = 0.0
        for at, word in enumerate(self.templates[number][1]):
            here = shift + at
            if here + DRIFT >= 0 and word in words[max(0, here - DRIFT) : here + DRIFT + 1]:
                found += self.idf[word]
        return min(1.0, found / (self.weight[number] or 1.0))

    def verified(self, number: int, shift: int, words: list[bytes]) -> bool:
        """Whether the mandatory phrase stands where the alignment puts it, give or take DRIFT words."""
        phrase, at = self.templates[number][2], shift + self.at[number]
        return any(words[k : k + len(phrase)] == phrase for k in range(max(0, at - DRIFT), at + DRIFT + 1))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Base places, base labels, template labels, score."""
        if self.keys.isdisjoint(words):
            return [], set(), set(), 0.0
        places = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.known:
                places[word].append(at)
        found, base, more, score = [], set(), set(), 0.0
        for label, phrase, word, inside in self.rarest:
            n = len(phrase)
            if starts := [p - inside for p in places.get(word, ()) if p >= inside and words[p - inside : p - inside + n] == phrase]:
                found += starts
                base.add(label)
                score = max(score, 0.5)
        for number, shift in self.alignments(places):
            if self.verified(number, shift, words) and (share := self.share(number, shift, words)) >= LEAST:
                more.add(self.templates[number][0])
                score = max(score, share)
        return found, base, more, score


def _find(words: list[bytes], phrase: list[bytes]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each word of the vocabulary; one small row per word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for batch in batches:
            for text in _docs.utf8(batch.column(1)):
                n += 1
                held.update(vocabulary.intersection(words_of(text)))
        held[b""] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
        )

    _docs.bound_batches(docs.sparkSession)
    rows = _docs.texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").sum("n").collect()
    df = {bytes(r[0]): r[1] for r in rows}
    return df.pop(b"", 0), df


def build_index(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> Index:
    split = [(label, words_of(notice.encode()), words_of(phrase.encode())) for label, (notice, phrase) in templates.items()]
    phrases = [(label, words_of(phrase.encode())) for phrase, label in base.items()]
    vocabulary = frozenset(w for _, words, phrase in split for w in words + phrase) | {w for _, p in phrases for w in p}
    n, df = document_frequencies(docs, vocabulary)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in sorted(vocabulary)}
    return Index(idf, split, phrases)


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """Licenses in each text of `docs` (doc_id, text).

    Gives n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start; null
    without any), base_labels and labels (with those of the templates; sorted, joined by commas) and score (0
    without a finding, 0.5 for a base phrase alone, else the share of the best template's IDF that was found).
    index: by default built from the same documents.

    Null and empty texts have no words and empty labels. Rows with equal or null doc_id are scanned each on its own.
    An empty table gives no rows. Further columns are not read.
    """
    built = index or build_index(docs)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for text in _docs.utf8(batch.column(1)):
                words = words_of(text)
                found, base, more, score = built.scan(words)
                rows.append(
                    (
                        len(words),
                        len(found),
                        min(found, default=None),
                        max(found, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | more)),
                        score,
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

        return each

    return _docs.map_batches(_docs.texts(docs), make, SCHEMA)
