"""Blocks of token ids under an adaptive context-mixing range coder, in numpy.

A block stands alone: its model starts fresh and its bytes and ids are checksummed. The ids of a
block run in lanes that advance together, so that one numpy operation codes a symbol of
every lane; lanes share the block's model. Order 1 and order 2 predict an id (the last
confirmed one after that context) with a confidence. Adaptive weights, chosen by both
confidences, mix the two predictions with the adaptive order-0 distribution over all ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 20
LANES = 8192
STEPS = 128
_HASHED = 1 << 18
_GATE_BITS, _ID_BITS = 12, 20
# Places of the ids' range that are looked up together.
_STRETCH_BITS = 2
_U = np.uint64
_TOP, _NARROW = _U(1 << 48), _U((1 << 40) - 1)
_SIXTEEN, _FORTY_EIGHT = _U(16), _U(48)
_HEAD = struct.Struct("<4sIIIII")
MAGIC = b"TIDB"


class Model:
    """Counts of one block; encoder and decoder update it alike, a step of all lanes at a time.

    A prediction and its confidence lie in one cell, ``id * 16 + confidence``, so that a context
    is looked up once and stored once; narrow cells keep the tables in a core's cache.
    """

    def __init__(self, vocabulary: int):
        self.size = vocabulary
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.every = np.arange(vocabulary, dtype=np.int32)
        self.cells = [np.zeros(vocabulary, np.int32), np.zeros(_HASHED, np.int32)]
        self.gate = np.tile(np.array([1, 1, 2], np.int64), (512, 1))
        # What was coded since the shares were last set: weights' places, and ids of neither order.
        self.gates, self.others = [], []
        self.step = 0

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """Look both contexts up and set the weights of this step. ``one`` is the id before."""
        # The place needs only the low 25 bits of the product.
        two = (two.astype(np.uint32) * np.uint32(40503) + one.astype(np.uint32)) * np.uint32(2654435761)
        self.at = [one, (two >> np.uint32(7) & np.uint32(_HASHED - 1)).astype(np.intp)]
        self.held = [c.take(a) for c, a in zip(self.cells, self.at)]
        self.said = [h >> 4 for h in self.held]
        self.sure = [h & 15 for h in self.held]
        self.mix = ((self.sure[1] << 4 | self.sure[0]) << 1) + (self.said[0] == self.said[1])
        if self.step < 8 or self.step % 8 == 0:
            self._share()

    def _share(self) -> None:
        """Turn counts into whole shares of the coder's range, none of them zero."""
        if self.gates:
            self.gate += np.bincount(np.concatenate(self.gates), minlength=1536).reshape(512, 3)
            self.counts += np.bincount(np.concatenate(self.others), minlength=self.size) * 8
            self.gates, self.others = [], []
        total = self.gate.sum(axis=1, keepdims=True)
        share = self.gate * ((1 << _GATE_BITS) - 3) // total + 1
        self.gate_size = share.astype(_U).ravel()
        self.gate_from = (np.cumsum(share, axis=1) - share).astype(_U).ravel()
        room = (1 << _ID_BITS) - self.size
        size = self.counts * room // self.counts.sum() + 1
        self.id_ends = np.cumsum(size)
        self.id_size = size.astype(_U)
        self.id_from = (self.id_ends - size).astype(_U)

    def index(self) -> None:
        """For every stretch of the ids' range the id that its start belongs to; the last id's part
        ends the range."""
        self.stretches = np.repeat(self.every, np.diff(-(-self.id_ends >> _STRETCH_BITS), prepend=0))

    def holder(self, slot: np.ndarray) -> np.ndarray:
        """The id whose part of the range each place is in."""
        found, last = self.stretches.take(slot >> _STRETCH_BITS, mode="clip"), self.size - 1
        late = np.flatnonzero(self.id_ends.take(found) <= slot)
        while len(late):
            after = found.take(late) + 1
            found[late] = np.minimum(after, last)
            late = late.compress((after < last) & (self.id_ends.take(after, mode="clip") <= slot.take(late)))
        return found

    def choose(self, ids: np.ndarray) -> np.ndarray:
        """0: order 2 has the id, 1: order 1 has it, 2: neither."""
        # An id's cells with any confidence are the fifteen after the one without.
        one, two = ((h - (ids << 4) - 1).view(np.uint32) < 15 for h in self.held)
        return (np.int8(2) - one.view(np.int8)) * (~two).view(np.int8)

    def update(self, ids: np.ndarray, gates: np.ndarray, rest: np.ndarray) -> None:
        """``gates`` are the places of the choices in the table of weights."""
        self.gates.append(gates)
        self.others.append(ids[rest])
        fresh = ids << 4
        for cells, at, held, sure in zip(self.cells, self.at, self.held, self.sure):
            hit = (held - fresh).view(np.uint32) < 16
            # Confirmed: surer. Refuted: replaced if there was little confidence, else half as sure.
            less = sure + 1 >> 1
            made = held - less + hit * (less + (sure < 15))
            made += ((sure <= 1) & ~hit) * (fresh + 1 - made)
            # Of lanes with the same context the last one counts, in numpy's order of assignment.
            cells[at] = made
        self.step += 1


class _Interval:
    """Low end and width of every lane's interval; carry-free, so lanes emit 16 bits at a time."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, _U)
        self.width = np.full(lanes, 2**64 - 1, _U)

    def narrow(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        self.width >>= _U(bits)
        self.low += self.width * start
        self.width *= size

    def some(self, lanes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Low ends of some lanes, and their widths' units."""
        return self.low.take(lanes), self.width.take(lanes) >> _U(bits)

    def narrow_some(self, lanes, low, unit, start: np.ndarray, size: np.ndarray) -> None:
        """``low`` and ``unit`` are what ``some`` gave."""
        self.low[lanes], self.width[lanes] = low + unit * start, unit * size

    def settled(self):
        """Lanes whose top 16 bits are final and these bits, until there is none."""
        low, width, lanes = self.low, self.width, None
        while True:
            ready = (low ^ (low + width)) < _TOP
            narrow = width <= _NARROW
            tight = np.flatnonzero(narrow & ~ready)
            if len(tight):
                width[tight] = (~low[tight] + _U(1)) & _NARROW
                ready |= narrow
            at = np.flatnonzero(ready)
            if not len(at):
                return
            part = low.take(at)
            yield at if lanes is None else lanes.take(at), part >> _FORTY_EIGHT
            if lanes is None:
                # Every lane by a factor: half of them are ready, and sparse stores cost more.
                factor = (ready.view(np.uint8) * np.uint16(0xFFFF)).astype(_U) + _U(1)
                self.low *= factor
                self.width *= factor
                lanes = at.compress(self.width.take(at) < _TOP)
            else:
                lanes = lanes.take(at)
                self.low[lanes], self.width[lanes] = part << _SIXTEEN, width.take(at) << _SIXTEEN
                lanes = lanes.compress(self.width.take(lanes) < _TOP)
            if not len(lanes):  # equal top bits need a width below them
                return
            low, width = self.low.take(lanes), self.width.take(lanes)


def _shape(count: int) -> tuple[int, int]:
    lanes = min(LANES, -(-count // STEPS))
    return lanes, -(-count // lanes)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block; ``ids`` holds 1 to ``BLOCK`` ids below ``vocabulary``."""
    lanes, steps = _shape(len(ids))
    laid = np.zeros(lanes * steps, dtype=np.int32)
    laid[: len(ids)] = ids
    laid = np.ascontiguousarray(laid.reshape(lanes, steps).T)
    model, interval = Model(vocabulary), _Interval(lanes)
    # Words of all lanes as they come, and whose they are.
    out, whose = [], []

    def emit(lane, words):
        out.append(words.astype("<u2"))
        whose.append(lane.astype(np.uint16))

    one = two = np.zeros(lanes, dtype=np.int64)
    for now in laid:
        model.predict(one, two)
        choice = model.choose(now)
        gates = (model.mix * 3 + choice).astype(np.intp)
        interval.narrow(model.gate_from.take(gates), model.gate_size.take(gates), _GATE_BITS)
        rest = np.flatnonzero(choice == 2)
        ids_now = now[rest]
        interval.narrow_some(rest, *interval.some(rest, _ID_BITS), model.id_from.take(ids_now), model.id_size.take(ids_now))
        for settled in interval.settled():
            emit(*settled)
        model.update(now, gates, rest)
        one, two = now.astype(np.intp), one
    final = (interval.low + _NARROW) & ~_NARROW  # inside the interval, and ends in zeros
    for shift in (48, 32):
        emit(np.arange(lanes), final >> _U(shift) & _U(0xFFFF))
    whose = np.concatenate(whose)
    words = np.concatenate(out)[np.argsort(whose, kind="stable")]
    payload = np.bincount(whose, minlength=lanes).astype("<u4").tobytes() + words.tobytes()
    plain = np.ascontiguousarray(ids, dtype="<u4").tobytes()
    head = (MAGIC, vocabulary, len(ids), len(payload), zlib.crc32(payload), zlib.crc32(plain))
    return _HEAD.pack(*head) + payload


def read_head(head: bytes) -> tuple[int, int, int, int, int]:
    """Vocabulary, number of ids, bytes of payload, checksum of payload and of ids."""
    magic, *rest = _HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    return tuple(rest)


HEAD_BYTES = _HEAD.size


def decode_block(head: bytes, payload: bytes) -> np.ndarray:
    """The ids of a block; a damaged block is an error."""
    vocabulary, count, _, checksum, ids_checksum = read_head(head)
    if zlib.crc32(payload) != checksum:
        raise ValueError("damaged block: payload checksum")
    lanes, steps = _shape(count)
    used = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    width = int(used.max()) + 8
    words = np.zeros((lanes, width), dtype=np.uint16)
    words[np.arange(width)[None, :] < used[:, None]] = np.frombuffer(payload, "<u2", offset=4 * lanes)
    model, interval = Model(vocabulary), _Interval(lanes)
    code = np.zeros(lanes, _U)
    for k in range(4):
        code = code << _SIXTEEN | words[:, k]
    words = words.ravel()
    following = np.arange(lanes) * width + 4

    def take():
        for at, _ in interval.settled():
            where = following.take(at)
            code[at] = code.take(at) << _SIXTEEN | words.take(where)
            following[at] = where + 1

    laid, shared = np.empty((steps, lanes), dtype=np.int32), None
    one = two = np.zeros(lanes, dtype=np.int64)
    for t in range(steps):
        model.predict(one, two)
        gates = (model.mix * 3).astype(np.intp)
        unit = interval.width >> _U(_GATE_BITS)
        # The part of the gate by comparing with its borders; a multiplication beats a division.
        inside = code - interval.low
        choice = (inside >= unit * model.gate_from.take(gates + 1)).view(np.int8)
        choice = choice + (inside >= unit * model.gate_from.take(gates + 2)).view(np.int8)
        gates += choice
        interval.narrow(model.gate_from.take(gates), model.gate_size.take(gates), _GATE_BITS)
        now = np.where(choice == 0, model.said[1], model.said[0])
        rest = np.flatnonzero(choice == 2)
        low, unit = interval.some(rest, _ID_BITS)
        slot = (code.take(rest) - low) // unit
        if shared is not model.id_ends:
            model.index()
            shared = model.id_ends
        found = model.holder(slot.astype(np.intp))
        now[rest] = found
        interval.narrow_some(rest, low, unit, model.id_from.take(found), model.id_size.take(found))
        take()
        model.update(now, gates, rest)
        laid[t] = now
        one, two = now.astype(np.intp), one
    ids = laid.T.reshape(-1)[:count].astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_checksum:
        raise ValueError("damaged block: ids checksum")
    return ids
