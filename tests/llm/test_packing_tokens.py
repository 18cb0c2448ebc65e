"""Token ids of the packing operator against the library, letter by letter."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from jobgrid.llm.packing import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def differ(texts: list[str]) -> list[str]:
    library = Tokenizer.from_file(PATH)
    got = WordEncoder(PATH)([t.encode() for t in texts])
    want = library.encode_batch(texts, add_special_tokens=False)
    return [t for t, a, b in zip(texts, got, want) if np.frombuffer(a, "<u4").tolist() != b.ids]


def test_every_code_point_beside_stops_and_commas():
    points = [chr(c) for c in range(1, 0x3400)] + [chr(c) for c in range(0xA000, 0x11000) if not 0xD800 <= c < 0xE000]
    points += [chr(c) for c in range(0x1D400, 0x1D800)] + [chr(c) for c in range(0x1F100, 0x1F700)] + ["一", "\U00020000", "\U0002f800"]
    assert differ([f"ab{c}. {c}, x{c}y, .{c}., {c}" for c in points]) == []
    letters = [c for c in points if unicodedata.category(c)[0] == "L"]
    assert differ([f"{c}." for c in letters]) == [] and differ([f"A{c}, B" for c in letters]) == []


def test_known_hard_texts():
    assert differ(["İ.", "Ankara İ, x", "क़.", "ΑΣ, ΣΑΣ. σ", "É, école. ÉCOLE", "é. é,", "가. x", "a\x85b. c d, e", "1.5, 2,3 a1b2.", "..., a", "don't, we're.", ""]) == []


def test_random_texts():
    r = random.Random(4)
    pool = list("abcXYZ") * 4 + list(" .,\n\t") * 4 + list("0189'-_éÉèçßſKΣςσİıǰДя日本ก้ा́क़  🎉&<|>")
    assert differ(["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(6000)]) == []
    assert differ(["".join(r.choice("abÉé., ") for _ in range(r.randrange(40))) for _ in range(3000)]) == []


def test_marks_are_units_in_all_texts():
    assert differ(["Red&&& red!! (RED)", "a..b,,c", "x|y|z. É%%% é", "a_b <c> d@e.f", "1&2&&3", "don't&&& (we're)", "a\x7f&b", "=\u0338 <\u0338", "&\u0301a"]) == []
    encoder = WordEncoder(PATH)
    encoder([b"Red&&& red!! (RED) red... RED,&&&", "Étage*** étage".encode()])
    assert set(encoder.cache.now) == {w.encode() for w in ("red", "&&&", "!!", "(", ")", "...", ",&&&", "étage", "***")}


def test_process_keeps_a_bounded_number_of_words():
    encoder = WordEncoder(PATH)
    for part in range(4):
        encoder([" ".join(f"w{part}x{i}" for i in range(part, part + 70_000)).encode()])
    assert encoder.cache.limit <= 200_000 and len(encoder.cache.now) + len(encoder.cache.old) <= 2 * 200_000 + 70_000


def test_texts_come_in_small_batches(spark, monkeypatch):
    from jobgrid.llm import packing

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    real = packing.store
    monkeypatch.setattr(packing, "store", lambda df, what: (seen.append(int(spark.conf.get(key))), real(df, what))[1])
    before = spark.conf.get(key)
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in rows) == [(1, 3), (2, 1)]
    assert seen == [1000] and spark.conf.get(key) == before


def test_few_pieces_are_not_dealt_to_many_tasks(spark):
    from jobgrid.llm import packing

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        rows = packing.pack(spark.createDataFrame([(i, "a b " * (i % 7)) for i in range(50)], "doc_id long, text string"), PATH)
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and rows.count() == 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
