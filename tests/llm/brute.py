"""Plain-Python versions of the operators' exact parts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fingerprint(text: str | None) -> int:
    import xxhash

    w = WORD.findall((text or "").translate(SMALL))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], most: int = 3) -> list[int]:
    """For each fingerprint the first index reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def suffix_removed(texts: list[str | None], n: int = 200) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each row"""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + n] for t in raw for p in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), len(bytes(gone).replace(b"\0", b" ").split()), sha(kept)))
    return out


def passages_removed(docs: list[tuple[int | None, str | None]], n: int = 50) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of each (id, text)"""
    rows = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in docs]
    first: dict[tuple, float] = {}
    for i, w in rows:
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = bytearray(len(w))
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = b"\1" * n
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def license_base(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    hits = [(i, x) for p, x in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(hits)


def rejected_hosts(rows: list[tuple], max_rate: float = 0.5) -> set[str]:
    """Hosts whose failure rate of any rule, shrunk by the fitted beta prior,
    passes ``max_rate``; rows: (id, text, lang, host, ..)."""
    fails: dict[str, list[list[bool]]] = {}
    for r in rows:
        if r[3] is not None:
            n, chars, symbols, dup, rep = quality(r[1])
            lines = sum(bool(WORD.search(x)) for x in (r[1] or "").split("\n"))
            flags = [n < 50, 100 * rep > 50 * n, 10 * symbols > n, 10 * dup > 3 * lines, chars < 3 * n or chars > 12 * n]
            fails.setdefault(r[3], []).append(flags)
    total = sum(map(len, fails.values()))
    bad = set()
    for k in range(5):
        f = {h: sum(x[k] for x in xs) for h, xs in fails.items()}
        mean = sum(f.values()) / total
        rates = [f[h] / len(fails[h]) for h in fails]
        var = sum(x * x for x in rates) / len(rates) - (sum(rates) / len(rates)) ** 2
        spread = var - mean * (1 - mean) * sum(1 / len(x) for x in fails.values()) / len(fails)
        strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
        bad |= {h for h in fails if (f[h] + mean * strength) / (len(fails[h]) + strength) > max_rate}
    return bad


def license_labels(text: str | None, templates, least_share: float = 0.6) -> set[str]:
    """Labels of the templates that stand at any position of the text."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = split.findall((text or "").translate(SMALL))
    out = set()
    for label, t, keys in templates:
        ws = split.findall(t)
        for s in range(1 - len(ws), len(words)):
            here = words[max(0, s) : s + len(ws)]
            share = sum(a == b for a, b in zip(here, ws[max(0, -s) :])) / len(ws)
            if share >= least_share and all(f" {k} " in f" {' '.join(here)} " for k in keys):
                out.add(label)
    return out
