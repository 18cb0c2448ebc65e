"""License scan by a positional rare-token index.

Method.  The document frequency of every word of the licence templates is
counted over all documents.  A small index maps each template's rarest words
(highest inverse document frequency) to the positions where they stand in it:
two positions more than a copy of the least share may miss, so that every such
copy has two of them in place.  Each place of an index word in a document votes
for its templates at a relative position; no word or place is left out,
whatever else the document holds.
A template position with two votes is verified: the template's mandatory
key phrases must stand there word for word, and the share of template words in
place is the score.  So the labels are those of a comparison at every position.
Fixed base phrases are found exactly, beside the method.

Scale.  Two passes over the texts (frequencies, scan); the only shuffle is of
counts of template words, a vocabulary bounded by the templates.  The index and
the frequencies are sent to the tasks; their size does not depend on the
documents.

Defined cases.  A null or empty text has no words and no labels.  Ties between
equally rare words go to the word that sorts first.  Repeated rows are scanned
each.  Of the input only the id and text columns are used.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrid.llm.arrow import slices, values
from jobgrid.llm.frames import text_of

#: base phrases and their labels (fixed values)
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: licence texts or notices, each with the key phrases it must hold
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license", "version 3")),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license version 2 1",)),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]

#: bytes that part words become blanks, capital letters small ones
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes over 0x7F, A-Z lower-cased."""
    return text.translate(_WORDS).split()


class LicenseIndex:
    """Postings of the templates' words, and the base phrases."""

    def __init__(self, templates=TEMPLATES, base=BASE, least_share: float = 0.6):
        """``least_share``: share of a template's words that must stand in place."""
        self.least_share = least_share
        self.base = [(words_of(p.encode()), label) for p, label in base.items()]
        self.templates = [(label, words_of(t.encode()), [words_of(k.encode()) for k in keys]) for label, t, keys in templates]
        for _, ws, keys in self.templates:
            for key in keys:
                if not _places(ws, key):
                    raise ValueError(f"key phrase not in its template: {key}")
        self.vocabulary = {w for _, ws, _ in self.templates for w in ws}
        self.weigh(dict.fromkeys(self.vocabulary, 0.0))

    def weigh(self, idf: dict[bytes, float]) -> None:
        """Index the rarest positions of each template, two more than a copy of
        the least share may miss; with each the votes that such a copy has."""
        self.rarest: list[tuple[list[tuple[bytes, int]], int]] = []
        for _, ws, _ in self.templates:
            least = next(n for n in range(1, len(ws) + 1) if n / len(ws) >= self.least_share)
            order = sorted(enumerate(ws), key=lambda x: (-idf[x[1]], x[1], x[0]))
            self.rarest.append(([(w, at) for at, w in order[: len(ws) - least + 2]], min(2, least)))
        self.looked_up = {w for spots, _ in self.rarest for w, _ in spots} | {ws[0] for ws, _ in self.base}

    def places(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Where the licence words stand; the only look at all words."""
        found = self.looked_up.intersection(words)
        out: dict[bytes, list[int]] = {w: [] for w in found}
        if found:
            for at, w in enumerate(words):
                if w in found:
                    out[w].append(at)
        return out

    def base_places(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, str]]:
        """(start, label) of every base phrase."""
        return [(s, label) for ws, label in self.base for s in places.get(ws[0], ()) if words[s : s + len(ws)] == ws]

    def method_labels(self, words: list[bytes], places: dict[bytes, list[int]]) -> tuple[set[str], float]:
        """Labels of the verified templates and the best share of a template's
        words found in place."""
        labels, best = set(), 0.0
        for (label, ws, keys), (spots, enough) in zip(self.templates, self.rarest):
            present = [(at, places[w]) for w, at in spots if w in places]
            if len(present) < enough:
                continue
            votes: dict[int, int] = defaultdict(int)
            for at, stands in present:
                for p in stands:
                    votes[p - at] += 1
            for start, n in votes.items():
                if n < enough:
                    continue
                here = words[max(0, start) : start + len(ws)]
                share = sum(map(bytes.__eq__, here, ws[max(0, -start) :])) / len(ws)
                if share >= self.least_share and all(_places(here, key) for key in keys):
                    labels.add(label)
                best = max(best, share)
        return labels, best


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i : i + n] == phrase]


def document_frequencies(docs: DataFrame, index: LicenseIndex, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of each template word over all documents."""
    vocabulary = index.vocabulary

    def count(batches):
        n, df = 0, defaultdict(int)
        for batch in slices(batches, "t"):
            for t in values(batch.column("t")):
                n += 1
                for w in vocabulary.intersection(words_of(t)):
                    df[w] += 1
        if n:
            yield pa.RecordBatch.from_pydict({"word": [None, *(w.decode() for w in df)], "n": [n, *df.values()]})

    counted = docs.select(text_of(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # at most the templates' words
    total = found.pop(None, 0)
    return {w: math.log((1 + total) / (1 + found.get(w.decode(), 0))) for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LicenseIndex | None = None) -> DataFrame:
    """doc_id, n_words, base (array of (start, label) of the base phrases),
    method_labels (array) and score of every row."""
    index = index or LicenseIndex()
    index.weigh(document_frequencies(docs, index, text_col))
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))

    def run(batches):
        for batch in slices(batches, "t"):
            n, base, labels, score = [], [], [], []
            for t in values(batch.column("t")):
                words = words_of(t)
                places = index.places(words)
                found, best = index.method_labels(words, places) if places else ((), 0.0)
                hits = index.base_places(words, places)
                n.append(len(words)), labels.append(sorted(found)), score.append(1.0 if hits else best)
                base.append([{"start": s, "label": x} for s, x in sorted(hits)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(base, base_type), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "base", "method_labels", "score"],
            )

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(
        run, f"doc_id {kind}, n_words long, base array<struct<start:long,label:string>>, method_labels array<string>, score double"
    )
