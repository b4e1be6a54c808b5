"""Texts of an Arrow column cut at white space by bytes, so that a word is looked at once a batch."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text that is cut at a time, in bytes, and runs whose dictionary is made at a time.
BYTES, RUNS = 4 << 20, 1 << 22
# Bytes of strings that are hashed at a time, and the odd numbers of the hash.
PIECE = 1 << 18
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def slices(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` (or ``BYTES``) of ``text``; one text is never cut."""
    _, offsets = flat(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + (size or BYTES), side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and the last ends.

    A null text is empty.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space: the Unicode property, without U+001C to
    U+001F."""
    found = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))

    def mark(lead: int, *rest) -> None:
        """Characters of one lead byte, each of the others within its bounds."""
        at = np.flatnonzero(data[: len(data) - len(rest)] == lead)
        for k, (low, high) in enumerate(rest, 1):
            at = at[(data[at + k] >= low) & (data[at + k] <= high)]
        for k in range(len(rest) + 1):
            found[at + k] = True

    for character in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000":
        lead, *rest = character.encode()
        mark(lead, *((b, b) for b in rest))
    mark(0xE2, (0x80, 0x80), (0x80, 0x8A))  # U+2000 to U+200A
    return found


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the white space before them, and white space at a text's end: their bytes one after
    the other, where each begins and the last ends, and the number of them before each text and
    in all."""
    data, offsets = flat(texts)
    blank = white(data)
    first = _at(offsets, len(data))
    first[1:] |= blank[1:] & ~blank[:-1]
    starts = np.flatnonzero(first)
    return data, np.append(starts, len(data)), np.searchsorted(starts, offsets)


def _at(offsets: np.ndarray, size: int) -> np.ndarray:
    """Where texts begin."""
    found = np.zeros(size, dtype=bool)
    found[offsets[:-1][offsets[:-1] < size]] = True
    return found


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without white space, as ``units`` gives them: what is between them is left out."""
    data, offsets = flat(texts)
    dark = ~white(data)
    first = dark.copy()
    first[1:] &= ~dark[:-1] | _at(offsets, len(data))[1:]
    starts = np.flatnonzero(first)
    before = np.concatenate(([0], np.cumsum(dark)))
    return data[dark], np.append(before[starts], before[-1]), np.searchsorted(starts, offsets)


def parts(data: np.ndarray, borders: np.ndarray) -> Iterator[pa.Array]:
    """The runs as Arrow strings, ``RUNS`` of them at a time."""
    for at in range(0, len(borders) - 1, RUNS):
        own = borders[at : at + RUNS + 1]
        part = np.ascontiguousarray(data[own[0] : own[-1]])
        cut = np.ascontiguousarray(own - own[0])
        yield pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(part))


def dictionaries(data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[list[str], pa.Array]]:
    """Distinct runs, and for every run which it is, ``RUNS`` of them at a time."""
    for part in parts(data, borders):
        found = part.dictionary_encode()
        yield found.dictionary.to_pylist(), found.indices


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of unsigned 32-bit integers that lie one after the other."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes)))), pa.array(values, pa.uint32()))


def keys(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: its bytes times powers of an odd number, summed, for ``PIECE``
    bytes at a time. A longer string has its checksum."""
    data, borders = flat(distinct)
    found, at = np.empty(len(distinct), np.uint64), 0
    while at < len(found):
        end = max(int(np.searchsorted(borders, borders[at] + PIECE, side="right")) - 1, at + 1)
        part, own = data[borders[at] : borders[end]], borders[at : end + 1] - borders[at]
        if len(part) > PIECE:
            found[at] = zlib.crc32(part)
        else:
            sizes = np.diff(own)
            powers = np.full(int(sizes.max()), _FACTOR, np.uint64).cumprod()
            sums = powers.take(np.arange(len(part)) - np.repeat(own[:-1], sizes)) if len(part) else powers
            sums *= part + np.uint64(1)
            sums = np.concatenate((np.zeros(1, np.uint64), sums.cumsum()))
            mixed = (sums[own[1:]] - sums[own[:-1]]) * _MIX
            found[at:end] = mixed ^ mixed >> np.uint64(32)
        at = end
    return found


class Known:
    """Ids of the distinct runs met so far, in two Arrow columns of bounded size.

    A run takes some forty bytes there, where Python's own objects would take hundreds, and twelve
    more in a sorted column of hashes that stays from call to call. Equal hashes are not trusted: the
    runs are compared, and one that shares its hash with another is learnt again. ``learn``
    gives a list of ids for each of some distinct runs.
    """

    def __init__(self, learn: Callable[[pa.Array], pa.Array], limit: int):
        self.learn, self.limit = learn, limit
        self.runs, self.ids = pa.array([], pa.large_string()), lists(np.zeros(0), np.zeros(0, np.int64))
        # Hashes in order, and where each one's run is.
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _find(self, distinct: pa.Array) -> np.ndarray:
        """Where each of the distinct runs is, after learning those that are not there."""
        wanted = keys(distinct)
        order = np.argsort(wanted)
        spots = np.empty(len(wanted), np.int64)
        spots[order] = np.searchsorted(self.keys, wanted[order])
        at = np.full(len(wanted), -1, np.int64)
        there = np.flatnonzero(spots < len(self.keys))
        there = there[self.keys[spots[there]] == wanted[there]]
        places = self.places[spots[there]]
        same = pc.equal(self.runs.take(pa.array(places)), distinct.take(pa.array(there))).to_numpy(zero_copy_only=False)
        at[there[same]] = places[same]
        fresh = at < 0
        if fresh.any():
            new = distinct.filter(pa.array(fresh))
            at[fresh] = np.arange(len(self.runs), len(self.runs) + len(new))
            self.ids = pa.concat_arrays([self.ids, self.learn(new)])
            self.runs = pa.concat_arrays([self.runs, new])
            order = order[fresh[order]]
            self.keys, self.places = (
                np.insert(old, spots[order], more[order].astype(old.dtype))
                for old, more in ((self.keys, wanted), (self.places, at))
            )
        return at

    def ids_of(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the runs one after the other, and the number of each run's ids."""
        wanted = wanted.dictionary_encode()
        at = self._find(wanted.dictionary)
        taken = self.ids.take(pa.array(at))
        if self.runs.nbytes + self.ids.nbytes > self.limit:  # only these runs stay
            self.runs, self.ids = self.runs.take(pa.array(at)), taken
            stay = np.full(int(self.places.max()) + 1, -1, np.int32)
            stay[at] = np.arange(len(at))
            places = stay[self.places]
            self.keys, self.places = self.keys[places >= 0], places[places >= 0]
        each = wanted.indices.to_numpy()
        borders, values = taken.offsets.to_numpy(), taken.values.to_numpy()
        sizes = np.diff(borders)[each]
        before = borders[:-1][each] - sizes.cumsum() + sizes
        spots = np.repeat(before, sizes)
        spots += np.arange(len(spots))
        return values.take(spots), sizes

    def ids_of_all(self, data: np.ndarray, borders: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and where each text's begin and the last one's end.

        The arguments are what ``units`` or ``words`` give.
        """
        done = [self.ids_of(part) for part in parts(data, borders)]
        if not done:
            return np.zeros(0, "<u4"), np.zeros(len(first), np.int64)
        ids, sizes = (np.concatenate(x) for x in zip(*done))
        return ids, np.concatenate(([0], np.cumsum(sizes)))[first]
