"""License scans with a positional index of rare words.

The templates are licence notices, short ones and whole licences. Document
frequencies of their words are counted over all documents; the KEYS rarest words
of each template are its keys. A posting is (template, position). Each key word
of a file, minus the posting's position, votes for a place where the template
would start; where two different keys (or all, of templates with fewer) vote for
places within the template's slack of each other, the template is laid along the
file: each of its words is looked for at its place and up to SHIFT words beside
it, and where the file has gone astray by inserted or missing words, the places
of the later words move with it. The mandatory phrases must stand unbroken, and
the share of template words found is the score, of which LEAST is needed.

Beside these labels (SPDX identifiers) are the base labels, for a licence's name
found anywhere.

Defined cases: null or empty text has no words and score 0; overlapping matches
of several templates each count, of equal scores either; repeated rows are scanned
alike, each; an empty table gives no rows; other columns are not read. Memory is
a text's words, and time is linear in them: a vote opens at most one comparison."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, utf8, words_of

# Names of licences and their base labels.
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

# Notices by SPDX identifier, as normalised words; mandatory phrases after the bar.
TEMPLATES = (
    ("MIT", "released under the mit license | mit license"),
    ("MIT", "licensed under the mit license | mit license"),
    (
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction | permission is hereby granted "
        "free of charge | without restriction",
    ),
    ("Apache-2.0", "licensed under the apache license version 2 0 | apache license version 2 0"),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 | except in compliance with the license | apache org licenses license 2 0",
    ),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3 | gnu general public license version 3"),
    (
        "GPL-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license | gnu general "
        "public license | either version 3",
    ),
    (
        "GPL-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license | gnu general "
        "public license | either version 2",
    ),
    (
        "BSD-3-Clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met | redistribution and use in source and binary forms | conditions are met",
    ),
    (
        "MPL-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 | mozilla public license v 2 0",
    ),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted | permission to use copy modify | fee is hereby granted",
    ),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0 | cc by nc 4 0"),
    ("CC-BY-4.0", "licensed under cc by 4 0 | cc by 4 0"),
    ("LicenseRef-all-rights-reserved", "all rights reserved | all rights reserved"),
    (
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
        "otherwise arising from out of or in connection with the software or the use or other dealings in the software | "
        "permission is hereby granted free of charge | without warranty of any kind",
    ),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
        "provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect "
        "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
        "action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software | permission to use copy modify | disclaims all warranties",
    ),
    (
        "BSD-2-Clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
        "with the distribution this software is provided by the copyright holders and contributors as is | "
        "redistribution and use in source and binary forms | with the distribution this software is provided",
    ),
    (
        "BSD-3-Clause",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution 3 neither the "
        "name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission | redistributions in binary form | "
        "endorse or promote products",
    ),
    (
        "Zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
        "following restrictions | in no event will the authors be held liable | redistribute it freely",
    ),
    (
        "Unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means | free and unencumbered software | into the public domain",
    ),
    (
        "Apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license | distributed under the license | "
        "governing permissions and limitations",
    ),
)
KEYS = 4
SHIFT = 2
LEAST = 0.7
_STEPS = sorted(range(-SHIFT, SHIFT + 1), key=abs)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    mandatory: tuple[tuple[int, tuple[bytes, ...]], ...]  # (position, words)


def _find(words, phrase, at: int = 0) -> int:
    n = len(phrase)
    return next((i for i in range(at, len(words) - n + 1) if tuple(words[i : i + n]) == phrase), -1)


def templates(rules=TEMPLATES) -> list[Template]:
    out = []
    for label, rule in rules:
        text, *phrases = (tuple(part.encode().split()) for part in rule.split("|"))
        out.append(Template(label, text, tuple((_find(text, p), p) for p in phrases)))
    return out


@dataclass(frozen=True)
class Index:
    templates: list[Template]
    postings: dict[bytes, list[tuple[int, int]]]
    keys_of: list[frozenset]


def build_index(found: list[Template], frequency: dict[bytes, int], documents: int) -> Index:
    """Keys: each template's KEYS words of highest inverse document frequency."""
    idf = lambda w: math.log((documents + 1) / (frequency.get(w, 0) + 1))
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    keys_of = []
    for k, t in enumerate(found):
        keys = frozenset(sorted(set(t.words), key=lambda w: (-idf(w), w))[:KEYS])
        keys_of.append(keys)
        for at, w in enumerate(t.words):
            if w in keys:
                postings[w].append((k, at))
    return Index(found, dict(postings), keys_of)


def _laid(t: Template, words: list[bytes], start: int) -> list[int]:
    """Where each template word stands in the file, -1 if nowhere near its place."""
    places, drift, last = [], 0, len(t.words) - 1
    for i, w in enumerate(t.words):
        here = -1
        for step in _STEPS:
            at = start + i + drift + step
            # a word beside its place counts only if the next one follows, as common words stand everywhere
            if 0 <= at < len(words) and words[at] == w and (not step or i == last or words[at + 1 : at + 2] == [t.words[i + 1]]):
                here, drift = at, drift + step
                break
        places.append(here)
    return places


def _score(t: Template, words: list[bytes], start: int) -> float:
    """The share of template words that are found, 0 without the mandatory phrases."""
    places = _laid(t, words, start)
    for at, phrase in t.mandatory:
        first = places[at]
        if first < 0 or places[at : at + len(phrase)] != list(range(first, first + len(phrase))):
            return 0.0
    return sum(p >= 0 for p in places) / len(places)


def match(index: Index, words: list[bytes]) -> dict[str, float]:
    """SPDX label -> score of the templates that are verified in a text's words."""
    if index.postings.keys().isdisjoint(words):
        return {}
    votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for place, w in enumerate(words):
        for k, at in index.postings.get(w, ()):
            votes[k].append((place - at, w))
    out: dict[str, float] = {}
    plain = b" " + b" ".join(words) + b" "
    for k, cast in votes.items():
        t, needed = index.templates[k], min(2, len(index.keys_of[k]))
        if any(b" " + b" ".join(phrase) + b" " not in plain for _, phrase in t.mandatory):
            continue
        slack = SHIFT + len(t.words) // 16
        cast.sort()
        here: dict[bytes, int] = defaultdict(int)  # keys of the votes from first to the current one
        first, done = 0, None
        for start, w in cast:
            here[w] += 1
            while cast[first][0] < start - slack:
                old = cast[first][1]
                here[old] -= 1
                if not here[old]:
                    del here[old]
                first += 1
            if len(here) >= needed and start != done:
                done, score = start, _score(t, words, start)
                if score >= LEAST:
                    out[t.label] = max(score, out.get(t.label, 0.0))
                if score == 1.0:
                    break
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word's number, label) of every place of a phrase."""
    plain = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES.items():
        at, before, place = plain.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            place += plain.count(b" ", before, at)  # blanks since the last hit
            before = at
            out.append((place, label))
            at = plain.find(b" " + phrase + b" ", at + 1)
    return sorted(out)


def _frequencies(vocabulary: frozenset):
    def run(batch: pa.RecordBatch) -> dict:
        n: dict[bytes, int] = defaultdict(int)
        for text in utf8(batch.column(0)):
            for w in vocabulary.intersection(words_of(text)):
                n[w] += 1
        return {"word": list(n), "n": list(n.values())}

    return run


def index_for(docs: DataFrame, rules=TEMPLATES) -> Index:
    """One row per template word goes to the driver, whatever the documents."""
    found = templates(rules)
    vocabulary = frozenset(w for t in found for w in t.words)
    counted = map_batches(docs.select("text"), _frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r.word): r.n for r in counted.collect()}
    return build_index(found, frequency, docs.count())


def _scan(index: Index):
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in utf8(batch.column(1)):
            words = words_of(text)
            places, found = base_places(words), match(index, words)
            labels = {label for _, label in places}
            for k, v in {
                "n_words": len(words),
                "n_base": len(places),
                "first_word": places[0][0] if places else None,
                "last_word": places[-1][0] if places else None,
                "base_labels": ",".join(sorted(labels)),
                "labels": ",".join(sorted(labels | set(found))),
                "score": max(found.values(), default=0.5 if places else 0.0),
            }.items():
                out[k].append(v)
        return {"doc_id": batch.column(0), **out}

    return run


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """One row per document; the score is the best template's, 0.5 where only a name is found, else 0."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_batches(docs.select("doc_id", "text"), _scan(index), schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, index_for(docs))
