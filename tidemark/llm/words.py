"""Words of whole Arrow string batches as 64-bit hashes, without a Python object per word.

All work is on the UTF-8 bytes of a batch at once. Both word rules separate words by ASCII bytes
only, so bytes of longer code points never need decoding. Hashes of different words may collide
with a chance of about n*n / 2**65 among n distinct words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACED = "spaced"  # [^\x20\x09-\x0D]+
ALNUM = "alnum"  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@dataclass
class Words:
    """hashes: of each word in order. doc: its row in the batch. first: each row's first word, and the end."""

    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # of each word in `data`
    ends: np.ndarray
    data: np.ndarray  # lower-cased bytes

    def text(self, i: int) -> str:
        return bytes(self.data[self.starts[i] : self.ends[i]]).decode("utf-8", "replace")


class Splitter:
    """Cuts texts into words. Make one per task: it holds lookup tables of half a megabyte."""

    def __init__(self, rule: str, lower: bool = True):
        code = np.arange(256)
        if rule == SPACED:
            self.inside = (code != 0x20) & ((code < 0x09) | (code > 0x0D))
        elif rule == ALNUM:
            self.inside = ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80)
        else:
            raise ValueError(f"unknown word rule {rule!r}")
        self.lower = code.astype(np.uint8)
        if lower:
            self.lower[0x41:0x5B] += 0x20
        self.values = draws(65536, 11)  # of a byte after another byte
        self.powers = np.ones(1, dtype=np.uint64)

    def _powers(self, longest: int) -> np.ndarray:
        if longest > len(self.powers):
            base = np.full(max(longest, 64), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
            base[0] = 1
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(base, dtype=np.uint64)
        return self.powers

    def words(self, texts: pa.Array) -> Words:
        """The words of a string array; a null has none."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
        held = texts.buffers()[2]
        raw = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
        low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        bounds = offsets - low
        data = self.lower[raw[low:high]]
        inside = self.inside[data]
        edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins or ends here
        edge[bounds] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[edge[:-1]] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(starts, bounds)
        doc = np.repeat(np.arange(n), np.diff(first))
        if len(starts) == 0:
            return Words(np.zeros(0, np.uint64), doc, first, starts, ends, data)
        lengths = ends - starts
        at = np.flatnonzero(inside)
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        previous = data[at - 1].astype(np.int64) << 8  # -1 wraps, but the first place is masked
        previous[place == 0] = 0
        with np.errstate(over="ignore"):
            value = self.values[previous + data[at]] * self._powers(int(lengths.max()))[place]
            sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
            hashes = mix(sums + lengths.astype(np.uint64))
        return Words(hashes, doc, first, starts, ends, data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the `k` words from each place on; the last k - 1 places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j, factor in enumerate(draws(k, 23) | np.uint64(1)):
            out += hashes[j : j + n] * factor
        return mix(out + np.uint64(k))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 22):
    """The batch in parts of about `max_bytes` of text, one row at least."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    row = 0
    while row < batch.num_rows:
        base = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield batch.slice(row, end - row)
        row = end
