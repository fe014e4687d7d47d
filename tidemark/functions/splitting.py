"""Cut one text at its most natural breaks, and join its chunks again: small helpers for the chunking jobs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

# Break patterns, strongest first. "" means any character.
TEXT_BREAKS = ("\n\n", "\n", " ", "")
SENTENCE_BREAKS = ("\n\n", "\n", r"(?<=[.?!])\s+", " ", "")
TAG_BREAKS = (
    "<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<span",
    "<table", "<tr", "<td", "<th", "<ul", "<ol", "<header", "<footer", "<nav", "<head",
    "<style", "<script", "<meta", "<title", "",
)

Span = tuple[int, int]


def split_spans(text: str, size: int, overlap: int, breaks: Sequence[str]) -> list[Span]:
    """Spans of at most `size` characters, whitespace at their edges left out."""
    spans = []
    for start, end in _divide(text, 0, len(text), size, overlap, tuple(breaks)):
        body = text[start:end]
        start += len(body) - len(body.lstrip())
        body = body.strip()
        if body:
            spans.append((start, start + len(body)))
    return spans


def _divide(text: str, lo: int, hi: int, size: int, overlap: int, breaks) -> Iterator[Span]:
    at = next(
        (i for i, b in enumerate(breaks) if b == "" or re.compile(b).search(text, lo, hi)),
        len(breaks),
    )
    if at == len(breaks) or breaks[at] == "":
        yield from _windows(lo, hi, size, overlap)
        return
    opens = (m.start() for m in re.compile(breaks[at]).finditer(text, lo, hi))
    cuts = [lo, *(p for p in opens if p > lo), hi]
    run: list[Span] = []
    for piece in zip(cuts, cuts[1:]):
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        yield from _pack(run, size, overlap)
        run = []
        yield from _divide(text, *piece, size, overlap, breaks[at + 1:])
    yield from _pack(run, size, overlap)


def _windows(lo: int, hi: int, size: int, overlap: int) -> Iterator[Span]:
    while lo < hi:
        yield lo, min(lo + size, hi)
        if lo + size >= hi:
            return
        lo += size - overlap


def _pack(run: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Join neighbouring pieces as long as they fit; start the next span `overlap` back."""
    first = 0
    for i, (start, end) in enumerate(run):
        if end - run[first][0] <= size or i == first:
            continue
        yield run[first][0], run[i - 1][1]
        while first < i and (start - run[first][0] > overlap or end - run[first][0] > size):
            first += 1
    if run:
        yield run[first][0], run[-1][1]


# --- back to one text -----------------------------------------------------------------------

PAGE_JOIN = "\n\n"
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out


class Powers:
    """Powers of BASE modulo 2 ** 64, as many as were ever needed."""

    def __init__(self):
        self.held = np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> np.ndarray:
        if n > len(self.held):
            factors = np.full(max(n, 1024), BASE, dtype=np.uint64)
            factors[0] = 1
            with np.errstate(over="ignore"):
                self.held = np.cumprod(factors, dtype=np.uint64)
        return self.held[:n]


def overlap(tail: np.ndarray, chunk: np.ndarray, powers: Powers) -> int:
    """Length of the longest end of `tail` that `chunk` begins with; both are arrays of code points.

    Hashes of all ends and all beginnings come from one running sum each, so the time is linear; a
    match of hashes is checked.
    """
    n = min(len(tail), len(chunk))
    if n == 0:
        return 0
    begin, end = chunk[:n].astype(np.uint64), tail[-n:].astype(np.uint64)
    with np.errstate(over="ignore"):
        scale = powers.first(n + 1)
        beginnings = np.cumsum(begin * scale[:n], dtype=np.uint64)  # of lengths 1 .. n
        running = np.cumsum(end * scale[:n], dtype=np.uint64)
        ends = running[-1] - np.r_[running[:-1][::-1], np.uint64(0)]  # of lengths 1 .. n, times a power of BASE
        alike = np.flatnonzero(beginnings * scale[n - 1 :: -1][:n] == ends)
    return next((int(k) + 1 for k in alike[::-1] if np.array_equal(begin[: k + 1], end[n - k - 1 :])), 0)


def joined(chunks: Sequence[str]) -> tuple[str, list[Span]]:
    """The text of ordered chunks without their overlaps, and each chunk's own new part as a span."""
    powers, parts, spans, at = Powers(), [], [], 0
    tail = np.zeros(0, dtype=np.uint32)
    longest = max(map(len, chunks), default=0)
    for chunk in chunks:
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        shared = overlap(tail, points, powers)
        gap = PAGE_JOIN if at > 0 and shared == 0 else ""
        part = gap + chunk[shared:]
        parts.append(part)
        spans.append((at, at + len(part)))
        at += len(part)
        added = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        tail = added[len(added) - longest :] if len(added) >= longest else np.concatenate([tail[len(tail) + len(added) - longest if len(tail) + len(added) > longest else 0 :], added])
    return "".join(parts), spans
