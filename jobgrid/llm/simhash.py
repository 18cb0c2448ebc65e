"""SimHash near-duplicates by deletion-variant signatures.

Method.  A document's fingerprint has a bit set where more than half of its
shingles' 64-bit hashes have it.  Fingerprints within three bits link.  They
are cut into two segments of 32 bits, so that linked ones differ by at most one
bit in one of them.  Each segment is indexed as it is and once with each of its
bits as a wildcard; fingerprints that share a variant meet, and their distance
is verified.  Components of the links give the classes.

Scale.  Equal fingerprints are one from the start (partial aggregate), so a
group of copies costs one row per task.  Variants are 66 rows a distinct
fingerprint, shuffled by an exact 39-bit key and streamed in key order.
Fingerprints that share a variant differ in the other segment, and never leave
the task as pairs: the task links them and passes on one link a member.  Small
groups are compared pairwise, large ones by looking up every value within the
distance, which is linear in the group.  Components are joins and aggregates.

Defined cases.  A null or empty text has fingerprint zero and links like any
other.  Fewer words than a shingle are one shingle.  Repeated rows are one
fingerprint and all returned; a null id is never the smallest.  Of the input
only the id and text columns are used; ``keep_one`` returns all columns.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrid.llm.arrow import utf8
from jobgrid.llm.components import connected_components
from jobgrid.llm.frames import broadcast_if_small, free_name, small_batches, store, text_of

SHINGLE, SEED, DISTANCE, SEGMENT = 3, 42, 3, 32
#: groups up to this size are compared pair by pair, larger ones by lookup
PAIRWISE = 4096


def fingerprint_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and blanks of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    bounds = zip(starts[:n].tolist(), (ends[len(words) - n :] - 1).tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in bounds), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, 1 + n // 65536):
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        at, data = utf8(texts)
        raw, at = memoryview(data), at.tolist()
        got = [fingerprint_of(bytes(raw[a:b]), shingle, seed) for a, b in zip(at, at[1:])]
        return pa.array(np.array(got, np.uint64).view(np.int64))

    return prints(text)


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): each segment as it is (wildcard 32) and with each bit cleared."""
    fp = F.col("fp")
    v = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * (SEGMENT + 1) - 1))).alias("v"))
    v = v.select("fp", F.expr(f"cast(v div {SEGMENT + 1} as int)").alias("seg"), (F.col("v") % (SEGMENT + 1)).alias("wild"))
    value = F.when(F.col("seg") == 0, fp).otherwise(F.shiftrightunsigned(fp, SEGMENT)).bitwiseAND(F.lit((1 << SEGMENT) - 1))
    cleared = value.bitwiseAND(F.expr("~shiftleft(1L, wild)"))  # wildcard 32 clears nothing
    return v.select(F.expr("shiftleft(cast(seg as bigint), 38) | shiftleft(cast(wild as bigint), 32)").bitwiseOR(cleared).alias("key"), "fp")


class _Links:
    """Smallest-member labels of a group under links found step by step."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _near(fp: np.ndarray, seg: int, wild: int, distance: int = DISTANCE) -> np.ndarray:
    """Labels of distinct, sorted fingerprints that share a variant; members
    with equal labels are connected by links within the group.  A wildcard
    group only links members that differ in the wildcard bit; the others meet
    in the group of the exact segment."""
    found = _Links(len(fp))
    n = len(fp)
    bit = np.uint64(0 if wild == SEGMENT else 1 << (wild + SEGMENT * seg))
    if n <= PAIRWISE:
        sides = (np.arange(n), np.arange(n)) if not bit else (np.nonzero((fp & bit) == 0)[0], np.nonzero(fp & bit)[0])
        step = max(1, (1 << 20) // max(1, len(sides[1])))
        for k in range(0, len(sides[0]), step):
            part = sides[0][k : k + step]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[sides[1]][None, :]) <= distance)
            found.join(part[i], sides[1][j])
        return found.label
    other = SEGMENT * (1 - seg)
    most = distance - (1 if bit else 0)
    for k in range(0 if bit else 1, most + 1):
        for bits in combinations(range(SEGMENT), k):
            want = fp ^ (bit | np.uint64(sum(1 << (b + other) for b in bits)))
            at = np.minimum(np.searchsorted(fp, want), n - 1)
            hit = np.nonzero(fp[at] == want)[0]
            found.join(hit, at[hit])
    return found.label


def _group_links(batches):
    """(a, b) links from (key, fp) rows in order of the key."""

    def of_runs(key, fp):
        out_a, out_b = [], []
        starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        size = np.diff(starts)
        two = starts[:-1][size == 2]  # most groups: one pair
        close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE]
        out_a.append(fp[close]), out_b.append(fp[close + 1])
        for s, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist()):
            k = int(key[s])
            group = np.sort(fp[s : s + n])
            label = _near(group, k >> 38, (k >> 32) & 63)
            member = np.nonzero(label != np.arange(n))[0]
            out_a.append(group[label[member]]), out_b.append(group[member])
        a, b = (np.concatenate(x).view(np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest_key, rest_fp = np.zeros(0, np.int64), [np.zeros(0, np.uint64)]
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(key):
            continue
        if len(rest_key) and key[0] == key[-1] == rest_key[0]:  # the group goes on
            rest_key, rest_fp = key, [*rest_fp, fp]
            continue
        before = np.concatenate(rest_fp)
        key = np.concatenate([np.full(len(before), rest_key[0] if len(rest_key) else 0), key])
        fp = np.concatenate([before, fp])
        last = int(np.searchsorted(key, key[-1]))
        yield of_runs(key[:last], fp[:last])
        rest_key, rest_fp = key[last:], [fp[last:]]
    fp = np.concatenate(rest_fp)
    yield of_runs(np.full(len(fp), rest_key[0] if len(rest_key) else 0), fp)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints (fp, distinct) within the
    distance, without all pairs of a group."""
    spread = variants(prints).repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(_group_links, "a long, b long")


def classes(stored: DataFrame, id_col: str) -> DataFrame:
    """(fp, root, component_id) from a stored table with ``id_col`` and fp:
    the class's smallest fingerprint and its smallest id."""
    prints = stored.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(links(prints.select("fp")))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = store(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fp, component_id) of every row: the fingerprint as a signed
    long and the smallest id reachable over links."""
    with small_batches(docs.sparkSession):
        stored = store(docs.select(F.col(id_col), fingerprint(text_of(text_col)).alias("fp")), "simhash")
    return stored.join(classes(stored, id_col), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, one with its smallest id."""
    row, fp = free_name(docs, "simhash_row"), free_name(docs, "simhash_fp")
    stored = docs.withColumns({row: F.monotonically_increasing_id(), fp: fingerprint(text_of(text_col))})
    with small_batches(docs.sparkSession):
        stored = store(stored, "simhash-docs")
    keys = stored.select(F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"), F.col(fp).alias("fp"))
    rows = store(keys.join(classes(keys, "id"), "fp").select("id", "row", "root", "component_id"), "simhash-classes")
    first = rows.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("first"))
    gone = rows.join(first, "root").filter("row != first").select(F.col("row").alias(row))
    gone = broadcast_if_small(store(gone, "simhash-gone"))
    return stored.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
