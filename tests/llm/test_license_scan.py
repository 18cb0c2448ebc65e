"""The license scan against a comparison of every template at every position."""

from __future__ import annotations

import random

from jobgrid.llm import license_scan as ls
from tests.llm import brute
from tests.llm.conftest import SCHEMA, sentence

MIT = next(t for label, t, _ in ls.TEMPLATES if label == "mit" and t.startswith("permission"))
PROSE = "hereby granted redistribution binary attribution noncommercial mozilla associated charge obtaining person forms"


def scanned(spark, texts: list[str]) -> list[set[str]]:
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    out = ls.scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return [set(r["method_labels"]) for r in sorted(out, key=lambda r: r["doc_id"])]


def test_several_licences_in_one_long_file(spark):
    r = random.Random(3)
    notices = [t for _, t, _ in ls.TEMPLATES]
    every = "\n\n".join(x for t in notices for x in (sentence(r, 200), t, PROSE))
    pairs = [f"{sentence(r, 100)} {MIT}. {PROSE} {sentence(r, 300)} {t}. {PROSE}" for t in notices]
    # the second notices' words are the commoner ones
    texts = [every, *pairs, *(t for t in notices if t != MIT for _ in range(5))]
    got = scanned(spark, texts)
    assert got == [brute.license_labels(t, ls.TEMPLATES) for t in texts]
    assert got[0] == {label for label, _, _ in ls.TEMPLATES}
    assert all({label, "mit"} <= found for (label, _, _), found in zip(ls.TEMPLATES, got[1:]))


def test_altered_notices(spark):
    r = random.Random(4)
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(r.randrange(1, 5)):
            words = r.choice(ls.TEMPLATES)[1].split()
            for _ in range(r.randrange(0, len(words) // 2)):
                words[r.randrange(len(words))] = r.choice(PROSE.split() + ["the", "word"])
            if r.random() < 0.3:
                words = words[r.randrange(0, 3) : len(words) - r.randrange(0, 3)]
            if r.random() < 0.3:
                words.insert(r.randrange(len(words)), "inserted")
            parts += [" ".join(words), sentence(r, r.randrange(0, 5))]
        texts.append(" ".join(parts))
    want = [brute.license_labels(t, ls.TEMPLATES) for t in texts]
    assert scanned(spark, texts) == want
    assert 50 < sum(map(bool, want)) and not all(want)


def test_usual_notices(spark):
    fsf = "under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or"
    usual = [
        ("Licensed under the GNU Lesser General Public License, version 2.1.", {"lgpl-2.1"}),
        ("Licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3"}),
        (fsf.format("Lesser General Public License", "2.1"), {"lgpl-2.1"}),
        (fsf.format("Lesser General Public License", "3"), {"lgpl-3"}),
        (fsf.format("General Public License", "2"), {"gpl-2"}),
        (fsf.format("General Public License", "3"), {"gpl-3"}),
        (fsf.format("Affero General Public License", "3"), {"agpl-3"}),
        ("Subject to the terms of the Mozilla Public License, v. 1.1", set()),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2"}),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", {"isc"}),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", {"epl-2"}),
        ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ]
    assert scanned(spark, [t for t, _ in usual]) == [want for _, want in usual]
