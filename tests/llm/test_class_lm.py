"""The class language model against plain counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from jobgrid.llm import class_lm as lm
from jobgrid.llm import queries as q
from tests.llm import brute


def tokens(text):
    return [*brute.WORD.findall((text or "").translate(brute.SMALL)), ""]


def trains(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def counts_of(row):
    return lm._whole(*lm._unpack(row["counts"], row["words"], row["words"]))


def classes_of(blocks) -> dict:
    """Class and count by a word's bucket and number, from every block; all
    must agree."""
    out: dict = {}
    for row in blocks.select("words", "slots", "cls", "counts").collect():
        bucket, number = lm._unpack(row["slots"], row["words"], row["words"])
        for b, k, c, n in zip(bucket, number, row["cls"], counts_of(row)):
            assert out.setdefault((int(b), int(k)), (c, int(n))) == (c, int(n))
    return out


def words_of(docs, blocks) -> dict:
    """Class and count by word: the blocks' tokens against the documents'."""
    out: dict = {}
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], []).append(tokens(r["text"]))
    for row in blocks.collect():
        counts, t = counts_of(row), lm._unpack(row["tokens"])[0]
        begin = 0
        for i, end in zip(row["ids"], np.frombuffer(row["ends"], np.int64)):
            mine = t[begin:end]
            begin = end
            said = next(s for s in text[i] if len(s) == len(mine))
            for w, k in zip(said, mine):
                assert out.setdefault(w, (row["cls"][k], int(counts[k]))) == (row["cls"][k], int(counts[k]))
    return out


def test_query_base_columns(spark, hard, written):
    seqs = [(i, tokens(t)) for i, t, *_ in hard[0]]
    seen = Counter(w for i, s in seqs if trains(i) for w in s)
    n, v = sum(seen.values()), len(seen)
    got = sorted(q.op12(spark, written).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    assert len(got) == len(seqs)
    for r, (i, s) in zip(got, sorted(seqs, key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))):
        assert r[:5] == (i, not trains(i), len(s), sum(seen[w] > 0 for w in s), n)
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9)
        assert r["score"] < 0


def test_scores_follow_the_model(spark, hard):
    """Small blocks, so that every word stands in many."""
    docs = hard[1]
    blocks, pairs, n, kinds, once = lm.trained(docs, classes=8, rounds=3, block_bytes=2000, bucket=500)
    held = words_of(docs, blocks)
    assert len(classes_of(blocks)) == len({w for _, t, *_ in hard[0] for w in tokens(t)})
    seqs = [(i, tokens(t)) for i, t, *_ in hard[0]]
    seen = Counter(w for i, s in seqs if trains(i) for w in s)
    assert (n, kinds, once) == (sum(seen.values()), len(seen), sum(c == 1 for c in seen.values()))
    assert all(held[w][1] == seen[w] for _, s in seqs for w in s)
    cls = lambda w: held[w][0] if seen[w] else 8
    moves, size = Counter(), Counter()
    for i, s in seqs:
        if trains(i):
            for a, b in zip(["", *s], s):
                moves[cls(a), cls(b)] += 1
                size[cls(b)] += 1
    assert all(pairs[c, d] == moves[c, d] for c in range(8) for d in range(8))
    unknown = (once + 1) / (n + 2)
    share = lambda c: unknown if c == 8 else (1 - unknown) * size[c] / n

    def score(s):
        out = 0.0
        for a, b in zip(["", *s], s):
            c, d = cls(a), cls(b)
            before = sum(moves[c, x] for x in range(8))
            out += math.log10((moves[c, d] + lm.KAPPA * share(d)) / (before + lm.KAPPA))
            out += math.log10(seen[b] / size[d]) if seen[b] else 0.0
        return out

    got = lm.scored(docs, classes=8, rounds=3, block_bytes=2000, bucket=500).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    for (i, k, a), (j, m, b) in zip(sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in got), key=order), sorted(((i, len(s), score(s)) for i, s in seqs), key=order)):
        assert (i, k) == (j, m) and math.isclose(a, b, rel_tol=1e-9)


def test_probabilities_sum_to_one():
    pairs = np.array([[4.0, 1, 0], [2, 3, 1], [0, 2, 0]])
    assert np.allclose((10 ** lm.transitions(pairs, int(pairs.sum()), 3)).sum(1), 1)
    assert (lm.transitions(np.zeros((3, 3)), 0, 0)[:, -1] == 0).all()


def test_choose_raises_the_likelihood():
    """One word at a time, as the exchange algorithm has it."""
    r = np.random.default_rng(3)
    text = np.concatenate([r.integers(0, 20, 4000) * 2 + (np.arange(4000) % 2)])  # even and odd words take turns
    cls = r.integers(0, 4, 40)

    def table(c):
        return np.bincount(c[text[:-1]] * 4 + c[text[1:]], minlength=16).reshape(4, 4).astype(float)

    start = now = lm.likelihood(table(cls))
    for w in list(range(40)) * 3:
        before, after = np.bincount(cls[text[:-1]][text[1:] == w], minlength=4), np.bincount(cls[text[1:]][text[:-1] == w], minlength=4)
        vector = np.concatenate([before, after])
        near = np.flatnonzero(vector)
        new = cls.copy()
        new[w] = lm.choose(table(cls), np.zeros(len(near), int), near, vector[near].astype(float), cls[[w]])[0]
        if lm.likelihood(table(new)) > now:
            cls, now = new, lm.likelihood(table(new))
    assert now > start + 1000
    assert not set(cls[::2]) & set(cls[1::2])  # the two kinds of words share no class


def test_held_out_perplexity(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    start = lm.trained(docs, rounds=1)
    end = lm.trained(docs, rounds=3)
    assert lm.likelihood(end[1]) >= lm.likelihood(start[1])
    held = [r for r in lm.scored(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_word_in_every_row(spark):
    """Two of five tokens are one word, which stands in every block."""
    docs = spark.createDataFrame([(i, f"hot a{i} hot b{i}") for i in range(12_000)], "doc_id long, text string").repartition(4)
    blocks, pairs, n, kinds, once = lm.trained(docs, block_bytes=400, bucket=2000)
    held = words_of(docs, blocks)
    train = sum(map(trains, range(12_000)))
    assert held["hot"][1] == 2 * train and n == 5 * train and (kinds, once) == (2 * train + 2, 2 * train)


def test_only_held_out_documents(spark):
    ids = [i for i in range(60) if not trains(i)]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    rows = lm.scored(docs).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows] == [(True, 3, 0, 0, 0.0)] * len(ids)
    assert all(r["base_score"] == 0.0 for r in rows)
