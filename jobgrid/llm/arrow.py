"""Helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, without a copy; value i
    is ``bytes[offsets[i]:offsets[i + 1]]``."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def values(column: pa.Array) -> list[bytes]:
    at, data = utf8(column)
    raw, at = memoryview(data), at.tolist()
    return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each (one
    longer value stays whole): what a task holds at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, _ = utf8(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def lean(run: Callable) -> Callable:
    """``run``, a generator over Arrow batches, after whose last batch Arrow's
    free memory goes back to the system: the worker lives on."""

    def ran(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return ran


class Cache:
    """Values by key, made many at a time; holds two generations of ``limit``
    keys at most, so that memory is bounded and frequent keys stay."""

    def __init__(self, make: Callable[[list], Iterable], limit: int = 350_000):
        self.make, self.limit, self.now, self.old = make, limit, {}, {}

    def look_up(self, lists: list[list]) -> list[list]:
        """The values of every list's keys."""
        get = self.now.get
        out = [list(map(get, keys)) for keys in lists]
        gaps = [[j for j, v in enumerate(got) if v is None] if None in got else () for got in out]
        missing = {keys[j] for keys, gap in zip(lists, gaps) for j in gap}
        if missing:
            old = self.old
            found = {k: old[k] for k in missing if k in old}
            missing = [k for k in missing if k not in found]
            found.update(zip(missing, self.make(missing)))
            for keys, got, gap in zip(lists, out, gaps):
                for j in gap:
                    got[j] = found[keys[j]]
            if len(self.now) + len(found) > self.limit:
                self.now, self.old = {}, self.now
            self.now.update(found)
        return out
