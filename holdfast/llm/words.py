"""Words of many texts as numpy arrays: boundaries, 64-bit names, and names of word sequences.

The name of a word is a hash of its bytes, eight at a time, each mixed in by a bijection that is not
linear; long words are hashed by xxh3. The name of a stretch of words comes from two polynomials in
different bases modulo the prime 2^31 - 1, so two prefix sums give it. Equal words and sequences have
equal names; different ones agree with chance about 2^-60, also where they differ in a regular way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Bytes of text that are turned into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

# Longer words are hashed one by one.
LONG_WORD = 128

_ODD = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_220_703_125, 630_360_016)
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def byte_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


BLANKS = byte_table(b" \t\n\x0b\x0c\r")
# ASCII characters other than letters and digits.
MARKS = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; different values stay different."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


def word_names(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bytes of every word."""
    # Eight bytes from every place on, whatever its alignment.
    eights = np.ndarray((len(joined),), dtype="<u8", buffer=joined + b"\0" * 8, strides=(1,))
    left = ends - starts
    names = mix(left.astype(np.uint64) * np.uint64(_ODD))
    active, at = np.flatnonzero(left <= LONG_WORD), starts
    if len(active) < len(starts):
        for k in np.flatnonzero(left > LONG_WORD).tolist():
            names[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
        at, left = at[active], left[active]
    while len(active):
        found = eights[at] & _KEPT[np.minimum(left, 8)]
        names[active] = mix(names[active] ^ found) * np.uint64(_ODD) + _STEP
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return names


def _reduced(values: np.ndarray) -> np.ndarray:
    """Values below 2^63 modulo the prime."""
    values = (values & _PRIME) + (values >> np.uint64(31))
    values = (values & _PRIME) + (values >> np.uint64(31))
    return np.where(values >= _PRIME, values - _PRIME, values)


class Powers:
    """Powers of a base and of its inverse modulo the prime, grown on demand."""

    def __init__(self, base: int):
        prime = int(_PRIME)
        self.bases = (base % prime, pow(base, -1, prime))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= count:
            size = len(self.up)
            self.up, self.down = (
                np.concatenate([have, _reduced(have * np.uint64(pow(base, size, int(_PRIME))))])
                for have, base in zip((self.up, self.down), self.bases)
            )
        return self.up, self.down


class Namer:
    """Turns slices of texts into word arrays; one per task."""

    def __init__(self, separators: np.ndarray = BLANKS, lower: bool = False):
        self.separators, self.lower = separators, lower
        self.powers = [Powers(base) for base in _BASES]

    def words(self, texts: list[bytes]) -> Words:
        joined = b"\n" + b"\n".join(texts) + b"\n"
        if self.lower:
            joined = joined.lower()
        data = np.frombuffer(joined, dtype=np.uint8)
        blank = self.separators[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        firsts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
        names = word_names(joined, starts, ends)
        return Words(self, joined, starts, ends, names, np.searchsorted(starts, firsts + 1))


class Words:
    """Words of a slice. ``firsts[d]`` to ``firsts[d + 1]`` are the words of document ``d``."""

    def __init__(self, namer: Namer, joined: bytes, starts, ends, names, firsts):
        self.namer, self.joined, self.starts, self.ends, self.names, self.firsts = namer, joined, starts, ends, names, firsts
        self._sums: list[np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.names)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def last(self) -> np.ndarray:
        """For each word, the end of its document."""
        return np.repeat(self.firsts[1:], np.diff(self.firsts))

    def _prefixes(self) -> list[np.ndarray]:
        """Sums of the words before each place, by base, each times the power of its place."""
        if self._sums is None:
            self._sums = []
            for k, powers in enumerate(self.namer.powers):
                up, _ = powers.upto(len(self.names) + 1)
                part = _reduced(_reduced(self.names >> np.uint64(32 * k) & np.uint64(0xFFFFFFFF)) * up[: len(self.names)])
                self._sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), _reduced(np.cumsum(part))]))
        return self._sums

    def _named(self, begin, end, size: np.ndarray) -> np.ndarray:
        """Names of the sequences between two sets of places, given as indices or slices."""
        found = np.uint64(0)
        for sums, powers in zip(self._prefixes(), self.namer.powers):
            part = (sums[end] + _PRIME - sums[begin]) * powers.down[: len(sums)][begin]
            found = found << np.uint64(31) | _reduced(part)
        return mix(found + size * np.uint64(_ODD))

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the word sequences from ``begin`` up to ``end``."""
        return self._named(begin, end, (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Names of all ``size`` consecutive words, whether or not they lie in one document."""
        count = max(0, len(self.names) - size + 1)
        if not count:
            return np.zeros(0, dtype=np.uint64)
        return self._named(slice(0, count), slice(size, size + count), np.array([size], dtype=np.uint64))

    def bytes_of(self, index: int) -> bytes:
        return self.joined[self.starts[index] : self.ends[index]]


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``SLICE_BYTES`` of text each, and their texts."""
    for batch in batches:
        texts = encoded(batch.column(batch.schema.get_field_index(column)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low), texts[low:high]


def signed(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)
