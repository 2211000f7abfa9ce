"""Secret scans: fixed patterns, and weak parts of credentials that are reported only where they complete each other."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from accordis.llm import text as tx
from accordis.llm.shared import map_arrow

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds the runs of `[0-9a-f]+` that are long enough
#: Weak parts: each is common in harmless text and counts only beside its complements.
WEAK_IDENT = re.compile(r"\b(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name|_?id)?|login|tenant(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:[a-z][a-z0-9+.-]*://[^\s\"'<>]+|(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}\b|(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b)", re.IGNORECASE | re.ASCII)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping in a kind, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, BASE_KINDS[k], z) for a, k, z in sorted(out)]


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * log2(c / n) for c in Counter(token).values())


def _parts(text: str, base: list[Span]) -> list[tuple[int, int, str, bool]]:
    """(start, end, role, strong) of all parts, by start; weak ones don't overlap the fixed patterns."""
    out = [(a, z, "ident" if k == "access" else "secret", True) for a, k, z in base]
    starts, far, ends = [a for a, _, _ in base], 0, []
    for _, _, z in base:
        far = max(far, z)
        ends.append(far)

    def free(a: int, z: int) -> bool:
        i = bisect_left(starts, z)
        return not i or ends[i - 1] <= a

    for m in WEAK_IDENT.finditer(text):
        if free(*m.span()):
            out.append((*m.span(), "ident", False))
    for m in ACCESS.finditer(text):
        if 16 <= len(m[0]) < 20:
            out.append((*m.span(), "ident", False))
    for m in ASSIGN.finditer(text):
        if len(m[2]) < 6:
            out.append((*m.span(), "secret", False))
    for m in WEAK_SECRET.finditer(text):
        t = m[0]
        if free(*m.span()) and re.search("[0-9]", t) and re.search("[A-Za-z]", t) and not t.startswith("AKIA") and _entropy(t) >= 3.0:
            out.append((*m.span(), "secret", False))
    for m in ENDPOINT.finditer(text):
        if free(*m.span()):
            out.append((*m.span(), "endpoint", False))
    return sorted(set(out))


def linked_spans(text: str, base: list[Span], window: int = 240) -> list[Span]:
    """Weak parts that meet their complements: an interval join of starts within `window` code points inside a scope
    (a passage between blank lines).

    A weak secret is reported beside a strong identifier, and a weak identifier beside a strong secret; two weak
    ones count only if an endpoint is there too; an endpoint is reported where identifier and secret are. Sweeps
    the sorted parts; sums of roles up to each part answer every test, so many parts cost no pairs."""
    parts = _parts(text, base)
    roles = {(p[2], p[3]) for p in parts}
    if not any(r == "ident" for r, _ in roles) or not any(r == "secret" for r, _ in roles):
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    starts = [p[0] for p in parts]
    kinds = [("ident", True), ("ident", False), ("secret", True), ("secret", False), ("endpoint", False)]
    sums = {k: [0] for k in kinds}
    for p in parts:
        for k in kinds:
            sums[k].append(sums[k][-1] + (p[2:] == k))
    out = []
    for a, z, role, strong in parts:
        if strong:
            continue
        b = bisect_left(breaks, a)
        lo = bisect_left(starts, max(a - window, breaks[b - 1] if b else 0))
        hi = bisect_right(starts, min(a + window, breaks[b] if b < len(breaks) else len(text)))
        near = {k: sums[k][hi] - sums[k][lo] for k in kinds}
        ends = near["endpoint", False]
        ok = {
            "secret": near["ident", True] or near["ident", False] and ends,
            "ident": near["secret", True] or near["secret", False] and ends,
            "endpoint": (near["ident", True] or near["ident", False]) and (near["secret", True] or near["secret", False]),
        }[role]
        if ok:
            out.append((a, role, z))
    return out


def scan(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, linked_spans(text, base)


def _hint(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts in which any pattern can match: a : or =, the letters AKIA, or 24 hexadecimal digits in a row."""
    hint = np.zeros(len(data), bool)
    if len(data) >= 4:
        hint |= (data == 58) | (data == 61)
        hint[:-3] |= (data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)
        run = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
        for k in (1, 2, 4):
            run[:-k] &= run[k:].copy()
            run[-k:] = False
        if len(run) >= 24:
            hint[:-16] |= run[:-16] & run[8:-8] & run[16:]
            hint[-24:] |= run[-24:]
    return tx.within(hint, offs) > 0


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in it:
        ids, texts = batch.column(0), batch.column(1)
        for lo, hi, data, offs in tx.steps(texts):
            n = hi - lo
            counts, digest, spans, linked = np.zeros((3, n), np.int64), [none] * n, [""] * n, np.zeros(n, np.int64)
            for i in np.flatnonzero(_hint(data, offs)):
                base, more = scan(texts[lo + int(i)].as_py() or "")
                for _, k, _ in base:
                    counts[BASE_KINDS.index(k), i] += 1
                joined = [f"{k}:{a}:{z}" for a, k, z in base]
                digest[i] = hashlib.sha256(",".join(joined).encode()).hexdigest()
                spans[i] = ",".join(f"{k}:{a}:{z}" for a, k, z in sorted(base + more, key=lambda s: (s[0], [*BASE_KINDS, "ident", "secret", "endpoint"].index(s[1]), s[2])))
                linked[i] = len(more)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, n), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(linked)], [x.split()[0] for x in SCHEMA.split(", ")])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of each whole text.

    One narrow pass; no shuffle. spans lists the fixed patterns (assign, access, hex) and, with the kinds ident,
    secret and endpoint, weak parts that the linking adds, as kind:start:end in code points (end exclusive), by
    start, then kind (in the order assign, access, hex, ident, secret, endpoint), then end; equal spans of a kind are
    one. A null text counts as empty: no spans, the digest of an empty string. A very long text is read whole. A null
    doc_id keeps its row, repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), _batches, SCHEMA)
