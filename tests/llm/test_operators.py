"""Parts of the operators, hot groups and the pipeline."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from jobgrid.llm import bpe, components, packing, quality_rules, repeats, secret_scan, simhash, substring_dedup, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import SCHEMA, hard_rows, sentence


def test_multikey_classes_agree_with_equality():
    r = np.random.default_rng(2)
    blob = r.integers(0, 2, 4000).astype(np.uint8)
    blob[1000:1400] = blob[3000:3400]
    starts, classes = r.integers(0, 3900, 3000), r.integers(0, 3, 3000)
    for length in (8, 13, 20, 100):
        label = suffix_dedup.multikey_classes(blob, starts, length, classes)
        keys = [(c, blob[s : s + length].tobytes()) for s, c in zip(starts.tolist(), classes.tolist())]
        pairs = set(zip(label.tolist(), keys))
        assert len(pairs) == len(set(label.tolist())) == len(set(keys))


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    text = "".join(r.choice("abc") for _ in range(3000))
    texts = [text, "xyz" + text[500:1200] + "q" * 300, text[1000:1201]]
    found: dict[str, set] = {}
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        covered = 0
        for first, last, anchor, h in zip(*repeats.stretches(repeats.byte_items(raw), 200, 50)):
            for p in range(first, last + 1):
                found.setdefault(t[p : p + 200], set()).add((int(anchor - p), int(h)))
            covered += last - first + 1
        assert covered == len(t) - 199
    assert all(len(x) == 1 for x in found.values())


def test_stretches_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    items = repeats.byte_items(r.integers(0, 5, 5000).astype(np.uint8))
    whole = {p: int(a) for f, e, a, _ in zip(*repeats.stretches(items, 60, 10)) for p in range(f, e + 1)}
    monkeypatch.setattr(repeats, "BLOCK", 700)
    cut = {p: int(a) for f, e, a, _ in zip(*repeats.stretches(items, 60, 10)) for p in range(f, e + 1)}
    assert whole == cut


def test_words_are_hashed_alike_in_blocks(monkeypatch):
    raw = np.frombuffer((" a bb  ccc\t" * 300 + "x" * 900 + " a").encode(), np.uint8)
    whole = repeats.word_items(raw)
    monkeypatch.setattr(repeats, "BLOCK", 64)
    assert np.array_equal(whole, repeats.word_items(raw)) and len(whole) == 902


def _peak(step, batch) -> float:
    """MB that a worker holds at most while ``step`` reads one large batch."""
    tracemalloc.start()
    try:
        for _ in step(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_holds_parts_of_a_large_batch():
    r = np.random.default_rng(5)
    common = [r.integers(97, 123, 400).astype(np.uint8) for _ in range(40)]
    texts = [np.concatenate([common[i % 40], r.integers(97, 123, 2600).astype(np.uint8), common[(i * 7) % 40], r.integers(97, 123, 2600).astype(np.uint8)]) for i in range(4000)]
    keys = pa.array(np.arange(4000))
    batch = pa.RecordBatch.from_arrays([keys, keys, pa.array([t.tobytes().decode() for t in texts])], names=["t1", "t2", "text"])
    repeats._powers(1)  # kept by the worker, whatever it reads
    assert _peak(repeats._anchors(repeats.byte_items, 200, 50), batch) < 40

    z, places = zstandard.ZstdCompressor(level=3).compress, []
    for t in texts:
        first, last, anchor, _ = repeats.stretches(repeats.byte_items(t), 200, 50)
        places.append(repeats._packed(first, last, anchor).tolist())
    batch = pa.RecordBatch.from_arrays(
        [keys, keys, pa.array([z(t.tobytes()) for t in texts], pa.binary()), pa.array(places, pa.list_(pa.int64()))], names=["t1", "t2", "z", "places"]
    )
    assert _peak(suffix_dedup._stretch_rows(200)[0], batch) < 60


def test_windows_compared_in_parts_give_the_same_intervals(monkeypatch):
    r = np.random.default_rng(9)
    base = r.integers(97, 100, 900).astype(np.uint8)
    texts = [np.concatenate([r.integers(97, 100, 300).astype(np.uint8), base[i * 20 : i * 20 + 450], r.integers(97, 100, 200).astype(np.uint8)]) for i in range(20)]
    rows = []
    for i, t in enumerate(texts):
        first, last, anchor, _ = repeats.stretches(repeats.byte_items(t), 200, 50)
        for f, e, a, p in zip(first, last, anchor, repeats._packed(first, last, anchor).tolist()):
            rows.append((b"", 0, 0, t[f : e + 200].tobytes(), i, i, p))
    types = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), *(pa.int64(),) * 3)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lead", "salt", "kind", "body", "t1", "t2", "place"])
    monkeypatch.setattr(suffix_dedup, "_core_rows", lambda *a: iter(()))  # asks for the task

    def covered():
        out = set()
        for b in suffix_dedup._compare(200, 50)(iter([batch])):
            for row in b.to_pylist():
                out |= {(row["t1"], p) for p in range(row["s"], row["e"])}
        return out

    whole = covered()
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 100)
    assert whole and covered() == whole


def test_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    seen = []
    for module in (repeats, suffix_dedup, simhash):
        monkeypatch.setattr(module, "store", lambda df, what, f=module.store: (seen.append((what, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))), f(df, what))[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    r = random.Random(3)
    rows = [(i, sentence(r, 60), "en", "x", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    suffix_dedup.remove_repeats(simhash.keep_one(docs)).count()
    sizes = dict(seen)
    assert all(int(sizes[x]) == 1000 for x in ("simhash-docs", "repeat-texts", "suffix-buckets"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.fixture(scope="module")
def hot(spark):
    """A passage that most rows share, between different words; many parts, so
    that its rows lie in several buckets."""
    r = random.Random(8)
    passage, line = sentence(r, 70), sentence(r, 16)
    rows = []
    for i in range(400):
        parts = [sentence(r, r.randrange(5, 20))]
        if i % 3:
            parts += [passage if i % 2 else passage[: len(passage) - r.randrange(80)], sentence(r, 9)]
        parts += [line, sentence(r, r.randrange(5))]
        rows.append((i, " ".join(parts), "en", "hot", 0))
    rows += [(400 + i, rows[5][1], "en", "hot", 0) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield rows, spark.createDataFrame(rows, SCHEMA).repartition(9).persist()
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_passage_in_several_buckets(hot):
    rows, df = hot
    cut = {(r["t1"], r["t2"]): r["kept"] for r in suffix_dedup.cut_texts(df).collect()}
    copied = {(r["t1"], r["t2"]) for r in suffix_dedup.copied_texts(df).collect()}
    keys = {r["doc_id"]: (r["t1"], r["t2"]) for r in df.select("doc_id", *repeats.text_key(F.col("text"))).collect()}
    for (i, text, *_), want in zip(rows, brute.suffix_removed([r[1] for r in rows])):
        kept = b"" if keys[i] in copied else cut.get(keys[i], text.encode())
        assert brute.sha(bytes(kept)) == want[3]


def test_hot_passage_in_several_shards(hot):
    rows, df = hot
    cut = {(r["t1"], r["t2"]): (r["removed"], r["kept"]) for r in substring_dedup.cut_texts(df).collect()}
    least = {(r["t1"], r["t2"]): r["least"] for r in substring_dedup.copied_texts(df).collect()}
    keys = {r["doc_id"]: (r["t1"], r["t2"]) for r in df.select("doc_id", *repeats.text_key(F.col("text"))).collect()}
    for (i, text, *_), want in zip(rows, brute.passages_removed([r[:2] for r in rows])):
        k = keys[i]
        removed, kept = (want[0], "") if least.get(k, i) < i else cut.get(k, (0, " ".join(text.split())))
        assert (removed, brute.sha(kept)) == want[1:]


def test_near_groups_pairwise_and_by_lookup_agree(monkeypatch):
    r = np.random.default_rng(6)
    low = np.uint64(0x1234ABCD)
    for wild in (simhash.SEGMENT, 7):
        high = np.unique(r.integers(0, 1 << 9, 400).astype(np.uint64) * np.uint64(0x00412081))
        fp = np.unique((high << np.uint64(32)) | (low ^ (r.integers(0, 2, len(high)).astype(np.uint64) << np.uint64(7) if wild == 7 else np.uint64(0))))
        monkeypatch.setattr(simhash, "PAIRWISE", 10_000)
        a = simhash._near(fp, 0, wild)
        monkeypatch.setattr(simhash, "PAIRWISE", 1)
        b = simhash._near(fp, 0, wild)
        assert np.array_equal(a, b)


def test_dense_fingerprints(spark):
    r = random.Random(9)
    centre = r.getrandbits(64)
    prints = {centre}
    for _ in range(600):
        f = centre
        for _ in range(r.randrange(1, 9)):
            f ^= 1 << r.randrange(64)
        prints.add(f)
    prints |= {r.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    stored = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {x["fp"]: x["component_id"] for x in simhash.classes(stored, "doc_id").collect()}
    assert [got[f] for f in signed] == brute.components(prints)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(500, 500)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 300)}}


def test_keep_one_keeps_one_row_of_each_class(spark, hard):
    rows, df = hard
    kept = simhash.keep_one(df).collect()
    root = brute.components([brute.fingerprint(r[1]) for r in rows])
    by_row = {}
    for r, c in zip(rows, root):
        by_row.setdefault(r[:2], c)
    assert sorted(by_row[k["doc_id"], k["text"]] for k in kept) == sorted(set(root))
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_remove_repeats_keeps_whole_characters(spark):
    r = random.Random(3)
    tail = sentence(r, 60)
    rows = [(1, "ü" + tail, "x"), (2, "ö" + tail, "x"), (3, None, "x"), (4, "short", "x")]  # ü and ö share their last... not their first byte
    got = {x["id"]: x["text"] for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "id int, text string, t1 string")).collect()}
    assert got == {1: "ü", 2: "ö", 3: None, 4: "short"}


def test_histogram_packing_loses_nothing_and_pads_little():
    r = random.Random(2)
    histogram = {n: r.randrange(1, 500) for n in range(1, 2049, 3)}
    patterns = packing.pack_histogram(histogram)
    placed: dict[int, int] = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 2048 and count > 0
        for n in pattern:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram
    packs = sum(c for _, c in patterns)
    assert sum(n * c for n, c in histogram.items()) > 0.99 * 2048 * packs
    assert packing.pack_histogram({}) == []


def test_bpe_round_trip(spark, hard):
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(hard[1], path), path)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"]) for x in back.collect()) == sorted(
        (r[0] is None, r[0] or 0, r[1] or "") for r in hard[0]
    )


def test_models_find_random_strings_and_leave_words(spark):
    """Held out: neither the secrets nor the words below are in the samples."""
    r = random.Random(7)
    syllables = "ran do ti mer lo ving ca se for men ta tion ly er".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(9))[:26]
    secret = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    rows = [(i, f"see {word()} and {word()}_{word()} then") for i in range(400)]
    rows += [(1000 + i, f"see {secret()} here") for i in range(50)]
    got = {x["doc_id"]: x["spans"] for x in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[1000 + i]) for i in range(50)) >= 48
    assert sum(bool(got[i]) for i in range(400)) <= 4


def test_redact(spark):
    rows = [(1, 'é token = "0123456789abcdef0123456789abcdef" ok', "s"), (2, None, None), (3, "clean", "c"), (3, "password=abcdef", "d")]
    got = sorted((x["id"], x["text"] or "", x["row"] or "") for x in secret_scan.redact(spark.createDataFrame(rows, "id int, text string, row string")).collect())
    assert got == [(1, 'é [SECRET]" ok', "s"), (2, "", ""), (3, "[SECRET]", "d"), (3, "clean", "c")]


def test_hosts_are_judged_by_shrunk_rates(spark):
    good, bad = sentence(random.Random(1), 80), "spam spam spam"
    rows = [(i, good, "fine.com") for i in range(100)] + [(100 + i, bad, "spam.com") for i in range(95)] + [(200 + i, good, "spam.com") for i in range(5)]
    rows += [(300, good, "one.com"), (301, bad, "two.com"), (302, good, None)] + [(400 + i, good, f"h{i % 9}.com") for i in range(90)]
    judged, m = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r["doc_id"] for r in judged.filter(f"{m}.kept").collect()}
    assert kept == {r[0] for r in rows if r[1] == good and r[2] != "spam.com"}


def expected_pipeline(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) that the stages before packing leave."""
    bad_hosts = brute.rejected_hosts(rows)
    kept = []
    for r in rows:
        m = brute.quality(r[1])
        if m[0] >= 50 and 100 * m[4] <= 50 * m[0] and r[3] not in bad_hosts:
            kept.append(r)
    root = brute.components([brute.fingerprint(r[1]) for r in kept])
    first = {}
    for r, c in zip(kept, root):
        if c not in first or (r[0] is None, r[0] or 0) < (first[c][0] is None, first[c][0] or 0):
            first[c] = r
    kept = list(first.values())
    raw = [r[1].encode() for r in kept]
    seen: dict[bytes, int] = {}
    for t in raw:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    out = []
    for r, t in zip(kept, raw):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        text, at = "", 0
        for c in r[1]:
            size = len(c.encode())
            text += "" if any(gone[at : at + size]) else c
            at += size
        runs = []
        for a, _, b in brute.spans(text):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in reversed(runs):
            text = text[:a] + "[SECRET]" + text[b:]
        out.append((r[0], text))
    return out


def test_pipeline_against_brute_force(spark, written):
    rows = hard_rows()
    docs = spark.read.parquet(f"{written}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, written)
        if k < 4:
            assert docs.columns == columns
        docs = docs.checkpoint()
        if k == 3:
            got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs.collect())
            assert got == sorted((i is None, i or 0, t) for i, t in expected_pipeline(rows))
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.run(spark, written).drop("sequence_id", "offset")
    assert sorted(map(str, packed.collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_pipeline_of_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
