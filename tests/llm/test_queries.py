"""The registered queries against brute force on hard rows."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobgrid.llm import queries as q
from tests.llm import brute


def same(got: list, want: list) -> None:
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert q.QUERIES[name](spark, empty).collect() == []


def test_secret_scan(spark, hard, written):
    kinds = ("assign", "access", "hex")
    listed = lambda t: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in brute.spans(t))
    want = [(i, *(sum(k == x for _, k, _ in brute.spans(t)) for x in range(3)), brute.sha(listed(t))) for i, t, *_ in hard[0]]
    rows = q.op2(spark, written).collect()
    same([r[:5] for r in rows], want)
    for r in rows:
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("random"))
        assert brute.sha(base) == r["base_sha256"]


def test_quality_rules(spark, hard, written):
    rows = q.op3(spark, written).collect()
    want = []
    for i, t, *_ in hard[0]:
        m = brute.quality(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows], want)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_bpe(spark, hard, written):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, x, *_ in hard[0]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    same(q.op4(spark, written).collect(), want)


def test_suffix_dedup(spark, hard, written):
    want = [(r[0], *m) for r, m in zip(hard[0], brute.suffix_removed([r[1] for r in hard[0]]))]
    same(q.op5(spark, written).collect(), want)


def test_substring_dedup(spark, hard, written):
    want = [(r[0], *m) for r, m in zip(hard[0], brute.passages_removed([r[:2] for r in hard[0]]))]
    same(q.op6(spark, written).collect(), want)


def test_packing(spark, hard, written):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = q.op8(spark, written).collect()
    want = []
    for i, x, *_ in hard[0]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    same([r[:5] for r in rows], want)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert len(by_sequence) <= total / 2048 * 1.1 + 1


def test_simhash(spark, hard, written):
    rows = hard[0]
    prints = [brute.fingerprint(r[1]) for r in rows]
    root = brute.components(prints)
    least = {c: min((r[0] for r, x in zip(rows, root) if x == c and r[0] is not None), default=None) for c in set(root)}
    same(q.op9(spark, written).collect(), [(r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, prints, root)])


def test_license_scan(spark, hard, written):
    want = []
    for i, t, *_ in hard[0]:
        n, hits = brute.license_base(t)
        want.append((i, n, len(hits), min((s for s, _ in hits), default=None), max((s for s, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    rows = q.op10(spark, written).collect()
    same([r[:6] for r in rows], want)
    for r in rows:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert any("gpl-3" in r["labels"] for r in rows)


def test_url_filter(spark, tmp_path):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.COM", "https://a.example.com/en/1?x#y", "https://www.example.com/en/2",
        "http://m.www.example.com/en/", "http://example.net/es/3", "http://net/fr/", "http://xnet/fr/", "http://b.net/fr", "ftp://x.org?q=://com/",
        "http://a.com#frag/", "http://a.com?x=/", "see http://a.com/p://q", "http://é.com/ü",
    ]
    urls += [f"https://site{i}.example.com/en/{i}" for i in range(30)] + [f"https://www.example.com/en/{i}" for i in range(30)]
    urls += [f"https://www.example.org/en/{i}" for i in range(5)]
    rows = [(None if i == 3 else i // 2, u, "x", 1) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, host string, score int").write.parquet(f"{tmp_path}/pages.parquet")
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    want = []
    for i, u, *_ in rows:
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:end].translate(brute.SMALL), rest[end:].split("?")[0].split("#")[0]
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        want.append((i, host, path, max(fits, key=len, default=None)))
    got = q.op1(spark, str(tmp_path)).collect()
    same([r[:4] for r in got], want)
    for r in got:
        assert r["verdict"] == rules[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")


def test_ann(spark, tmp_path):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    v = (centres[r.integers(0, 12, 3000)] + 0.4 * r.normal(size=(3000, 16))).astype(np.float32)
    v[100:1100] = v[100]  # a third of all rows
    rows = [(int(i), [float(y) for y in x]) for i, x in enumerate(v)]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 16), (3150, [float("nan")] * 16), (3200, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (3250, [1.0, 2.0]), rows[50]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict[int, list] = {}
    for x in sorted(q.op7(spark, str(tmp_path)).collect()):
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == set(range(0, 3000, 50))  # the row of another dimension has no candidates
    wide = v.astype(np.float64)
    length = np.sqrt((wide * wide).sum(1))
    hits = 0
    for i, found in got.items():
        cosine = wide @ wide[i] / (length * length[i])
        cosine[i] = -2
        best = np.lexsort((np.arange(3000), -np.round(cosine, 12)))[:5]
        hits += len(set(best.tolist()) & {x[1] for x in found})
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and i not in {x[1] for x in found}
        assert all(abs(cosine[x[1]] - x[2]) < 1e-12 for x in found)
    assert hits >= 0.95 * 5 * len(got)
    assert [x[1] for x in got[100]] == [101, 102, 103, 104, 105]
