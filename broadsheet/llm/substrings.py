"""Removal of word passages that an earlier document has, found in FM-indexes of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T, Window

from broadsheet.llm import runs
from broadsheet.llm.common import tidy, written
from broadsheet.llm.fmindex import FmIndex

WINDOW = 13
# Words of an anchor; a window's anchor is the least of the hashes of its word groups so long.
ANCHOR = 6
# An anchor in more documents than this is dealt out window by window.
HOT = 10_000
# Symbols of a shard's index.
SHARD = 400_000
# Text whose windows are worked out at a time.
BYTES = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def digest_of(text: bytes | None) -> bytes:
    """128 bits that stand for a text; Spark's md5 gives the same."""
    return hashlib.md5(text or b"").digest()


class Windows:
    """Words of some texts and the windows over them, as arrays over all the texts.

    A window's anchor is the leftmost least hash of the word groups in it, so equal windows have
    equal anchors wherever they stand. Windows next to each other with one anchor are a run.
    """

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        data, offsets = runs.flat(texts)
        self.window = window
        blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        inner = np.ones(len(data) + 1, dtype=bool)  # no text begins there
        inner[offsets] = False
        first = ~blank
        first[1:] &= blank[:-1] | ~inner[1:-1]
        last = ~blank
        last[:-1] &= blank[1:] | ~inner[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: The number of words before each text, and in all.
        self.before = np.searchsorted(starts, offsets)
        left = np.repeat(self.before[1:], np.diff(self.before)) - np.arange(len(starts))
        whole = np.flatnonzero(left >= window)  # where windows start
        self.groups = np.zeros(0, np.int64)
        self.starts = self.ends = self.places = self.owners = np.zeros(0, np.int64)
        if not len(whole):
            return
        groups = _group_hashes(data, starts, ends, anchor)
        self.groups = groups.view(np.int64)
        places = _leftmost_least(groups, window - anchor + 1)[whole]
        new = np.concatenate(([True], places[1:] != places[:-1]))
        #: Of every run the first and last window, the place of the anchor and the text.
        self.starts, self.ends = whole[new], whole[np.append(new[1:], True)]
        self.places = places[new]
        self.owners = np.searchsorted(self.before, self.starts, side="right") - 1
        # Words joined by one space, and where each begins and ends there.
        joined, kept = data.copy(), ~blank
        spaces = starts[inner[starts]] - 1
        joined[spaces], kept[spaces] = 0x20, True
        at = np.cumsum(kept)
        self._joined, self._starts, self._ends = joined[kept].tobytes(), at[starts] - 1, at[ends - 1]

    def anchors(self) -> np.ndarray:
        """The anchor of every run."""
        return self.groups[self.places]

    def words(self, start: int, end: int) -> bytes:
        """The words of the windows from one to another, joined by one space."""
        return self._joined[self._starts[start] : self._ends[end + self.window - 1]]


def _group_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, anchor: int) -> np.ndarray:
    """Hashes of all groups of ``anchor`` words, by the first and last 8 bytes and the length of a
    word; one longer than 16 bytes is hashed whole."""
    eight = _eights(data)
    size = ends - starts
    mask = (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)
    head = np.where(size >= 8, eight[starts], eight[starts] & mask)
    tail = np.where(size > 8, eight[np.maximum(ends - 8, starts)], np.uint64(0))
    hashes = (head * _MIX[0]) ^ (tail + size.astype(np.uint64)) * _MIX[1]
    long = np.flatnonzero(size > 16)
    if len(long):
        whole, cuts = data.tobytes(), zip(starts[long].tolist(), ends[long].tolist())
        hashes[long] = [xxhash.xxh64_intdigest(whole[a:b]) for a, b in cuts]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX[1]
    hashes ^= hashes >> np.uint64(29)
    groups = np.zeros(len(starts) - anchor + 1, dtype=np.uint64)
    for j in range(anchor):
        groups = groups * _MIX[0] + hashes[j : len(groups) + j]
    groups ^= groups >> np.uint64(31)
    groups *= _MIX[1]
    groups ^= groups >> np.uint64(29)
    return groups


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of ``width`` values the place of the leftmost least one."""
    places, covered = np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = places[:-step], places[step:]
        places = np.where(values[left] <= values[right], left, right)
        covered += step
    return places


_ANCHORS = "doc_id long, short long, anchor long, known boolean"


def _anchors(batches, window: int, anchor: int):
    """The distinct anchors of every text with the text's digest, cut to 64 bits. Of equal texts in
    a batch only the first one has anchors.

    An anchor of several texts in the batch is ``known`` to repeat, once for each; two of those
    texts still name it as witnesses for other batches. So an anchor that many texts have
    leaves a batch twice at most.
    """
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        found, owner, short, seen, at = [], [], np.zeros(len(ids), dtype=np.int64), set(), 0
        for part in runs.slices(batch, BYTES):
            fresh = np.zeros(len(part), dtype=bool)
            for i, text in enumerate(part.column("text").cast(pa.binary())):
                whole = digest_of(text.as_py())
                short[at + i] = int.from_bytes(whole[:8], "little", signed=True)
                fresh[i] = whole not in seen
                seen.add(whole)
            windows = Windows(part.column("text"), window, anchor)
            rows = np.flatnonzero(fresh[windows.owners])
            found.append(windows.anchors()[rows])
            owner.append(at + windows.owners[rows])
            at += len(part)
        if not sum(map(len, found)):
            continue
        values, owners = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((owners, values))
        again = (values[order][1:] == values[order][:-1]) & (owners[order][1:] == owners[order][:-1])
        order = order[np.concatenate(([True], ~again))]
        new = np.concatenate(([True], values[order][1:] != values[order][:-1]))
        end = np.concatenate((new[1:], [True]))
        known, witness = np.zeros(len(values), bool), np.zeros(len(values), bool)
        known[order], witness[order] = ~(new & end), new | end
        for chosen, flag in ((witness, False), (known, True)):
            rows = np.flatnonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owners[rows]]), pa.array(short[owners[rows]]), pa.array(values[rows]),
                 pa.array(np.full(len(rows), flag))],
                ["doc_id", "short", "anchor", "known"],
            )


_PLACES = "first long, nth int, at long, route long, key long"
_SEGMENTS = "route long, key long, words string, first long, last long"


def _segments(batch: pa.RecordBatch, window: int, anchor: int):
    """Runs of windows with one repeated anchor; windows of a hot anchor one by one.

    For every ``BYTES`` of text the rows (first, nth, at, route, words): the document's first
    id and text number, the first word, and where the segment is dealt to.
    """
    for part in runs.slices(batch, BYTES):
        # The entry of each text, and the anchors of its entry.
        entries = part.column("entries")
        entry, own = entries.flatten(), np.diff(entries.offsets.to_numpy())
        holder = np.repeat(np.arange(len(part)), own)
        digests = [digest_of(text.as_py()) for text in part.column("text").cast(pa.binary())]
        wholes = entry.field("whole").to_pylist()
        matching = np.array([whole == digests[i] for whole, i in zip(wholes, holder.tolist())], dtype=bool)
        first, nth = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        first[holder[matching]] = entry.field("first").to_numpy()[matching]
        nth[holder[matching]] = entry.field("nth").to_numpy()[matching]
        lists = entry.field("anchors")
        marked, own = lists.flatten(), np.diff(lists.offsets.to_numpy())
        wanted, hot = (marked.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "hot"))
        theirs = np.repeat(np.where(matching, holder, -1), own)
        # A text and an anchor as one number.
        known = np.unique(wanted)
        if not len(known):
            continue
        windows = Windows(part.column("text"), window, anchor)
        values = windows.anchors()
        number = np.minimum(np.searchsorted(known, values), len(known) - 1)
        pairs = np.where(known[number] == values, windows.owners * len(known) + number, -1)
        own = theirs * len(known) + np.searchsorted(known, wanted)
        chosen = np.flatnonzero((pairs >= 0) & np.isin(pairs, own[theirs >= 0]))
        is_hot = np.isin(pairs[chosen], own[(theirs >= 0) & hot])
        rows = []
        owners = windows.owners[chosen]
        begin, starts, ends = windows.before[owners].tolist(), windows.starts[chosen].tolist(), windows.ends[chosen].tolist()
        for f, n, base, s, e, value, each in zip(
            first[owners].tolist(), nth[owners].tolist(), begin, starts, ends, values[chosen].tolist(), is_hot.tolist()
        ):
            if not each:
                rows.append((f, n, s - base, value, windows.words(s, e)))
                continue
            for i in range(s, e + 1):
                piece = windows.words(i, i)
                rows.append((f, n, i - base, _signed(xxhash.xxh64_intdigest(piece, 7)), piece))
        if rows:
            yield rows


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _key(words: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(words, 11))


def _segment_places(batches, window: int, anchor: int):
    for batch in batches:
        for rows in _segments(batch, window, anchor):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                 pa.array([_key(r[4]) for r in rows], pa.int64())],
                ["first", "nth", "at", "route", "key"],
            )


def _segment_texts(batches, window: int, anchor: int):
    """The distinct segments of a batch with their least and greatest document."""
    for batch in batches:
        held: dict[tuple[int, bytes], tuple[int, int]] = {}
        for rows in _segments(batch, window, anchor):
            for first, _, _, route, words in rows:
                low, high = held.get((route, words), (first, first))
                held[route, words] = (min(low, first), max(high, first))
        if not held:
            continue
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.int64()), pa.array([_key(k[1]) for k in held], pa.int64()),
             pa.array([k[1] for k in held], pa.binary()).cast(pa.string()),
             pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            ["route", "key", "words", "first", "last"],
        )


def shard_minima(segments: list[bytes], documents: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every segment the least document that has it, by one FM-index.

    The index is over the shard's segments; the segments are streamed through it backwards, and
    every place whose matching statistic reaches the window reports its interval.
    """
    ids: dict[bytes, int] = {}
    sequences = [np.array([ids.setdefault(w, len(ids) + 1) for w in s.split()], dtype=np.int64) for s in segments]
    index = FmIndex(sequences, window)
    found = [np.zeros(len(s) - window + 1, dtype=np.int64) for s in sequences]
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found])))
    streams, places, lows = (np.concatenate(x) for x in zip(*index.matches(sequences)))
    flat = np.empty(int(offsets[-1]), dtype=np.int64)
    flat[offsets[streams] + places] = index.group_minimum(documents, lows)
    return np.split(flat, offsets[1:-1])


_MINIMA = "route long, key long, least array<long>"


def _shards(batches, window: int):
    """Cut a partition, sorted by route and words, into shards of about ``SHARD`` symbols; keep the
    segments of which some holder has a window that an earlier document has too."""

    def finish(rows):
        minima = shard_minima([r[2].encode() for r in rows], np.array([r[3] for r in rows], dtype=np.int64), window)
        kept = [i for i, m in enumerate(minima) if (m < rows[i][4]).any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in kept], pa.int64()), pa.array([rows[i][1] for i in kept], pa.int64()),
             pa.array([minima[i].tolist() for i in kept], pa.list_(pa.int64()))],
            ["route", "key", "least"],
        )

    rows, symbols = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("route", "key", "words", "first", "last"))):
            before = rows[-1] if rows else None
            if before is not None and before[0] == row[0]:
                if before[2] == row[2]:  # the same segment from another batch
                    rows[-1] = (*row[:3], min(before[3], row[3]), max(before[4], row[4]))
                    continue
            elif symbols >= SHARD:
                yield finish(rows)
                rows, symbols = [], 0
            rows.append(row)
            symbols += row[2].count(" ") + 2
    if rows:
        yield finish(rows)


def _cut(batches, window: int, joined: bool):
    for batch in (part for whole_batch in batches for part in runs.slices(whole_batch)):
        sizes, removed, spans, kept = [], [], [], []
        texts = batch.column("text").cast(pa.binary())
        for text, entries in zip(texts, batch.column("marks")):
            words, entries = words_of(text.as_py()), entries.as_py()
            gone = np.zeros(len(words) + 1, dtype=bool)
            if entries:
                whole = digest_of(text.as_py())
                for entry in entries:
                    if entry["whole"] == whole:
                        if entry["copy"] and len(words) >= window:
                            gone[: len(words)] = True
                        steps = np.zeros(len(words) + 1, dtype=np.int64)
                        starts = np.array(entry["starts"] or [], dtype=np.int64)
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, starts + window, -1)
                        gone |= np.cumsum(steps) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))))
            ranges = edges.reshape(-1, 2)
            sizes.append(len(words))
            removed.append(int(gone.sum()))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in ranges])
            if not len(ranges):
                kept.append(b" ".join(words) if joined else text.as_py())
            else:
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("rest"),
                pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            ],
            ["doc_id", "text", "rest", "n_words", "n_removed", "spans"],
        )


def repeated(docs: DataFrame, window: int = WINDOW, joined: bool = True) -> DataFrame:
    """``doc_id, text, rest, n_words, n_removed, spans`` of every row of ``docs``.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    ``doc_id``; windows are judged on the input. ``text`` are the kept words joined by one space
    (with ``joined=False`` a text that loses nothing stays as it is), ``spans`` the removed runs
    of words, ``rest`` a struct of all other columns. A null text has no words, and stays null
    unless ``joined``. A row with a null ``doc_id`` neither removes nor loses anything. Rows of
    one ``doc_id`` do not remove words from each other. Other columns' names do not matter.

    1. Equal texts are one text of the smallest id; the others lose all words (if they have a
       window).
    2. Every window has an anchor, a group of words that its content alone chooses. Anchors in
       two different texts are kept; only windows with such an anchor can repeat.
    3. Runs of windows with one kept anchor are segments, made distinct, with their smallest
       document, in every batch and again in a shard. All equal windows have equal anchors, so segments are dealt into shards by
       anchor, and a shard needs nothing from outside. An anchor in over ``HOT`` documents is
       dealt out by whole windows.
    4. A shard is an FM-index of bounded size; see ``shard_minima``.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    # A cast that changes nothing would keep the plans from sharing one shuffle of the texts.
    wide = docs.schema["doc_id"].dataType == T.LongType()
    doc_id = F.col("doc_id") if wide else F.col("doc_id").cast("long").alias("doc_id")
    every = docs.select(doc_id, "text", packed.alias("rest"))
    rows = every.filter(F.col("doc_id").isNotNull())

    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    identity = written(rows.select("doc_id", digest.alias("whole")).distinct(), "digests")
    # A document id usually has one text; ``nth`` tells the texts of one id apart.
    numbered = F.row_number().over(Window.partitionBy("first").orderBy("whole"))
    firsts = written(
        identity.groupBy("whole").agg(F.min("doc_id").alias("first")).withColumn("nth", numbered), "first-documents"
    )

    # Anchors in two different texts. At most two rows per anchor and batch come together.
    anchors = rows.select("doc_id", "text").mapInArrow(tidy(lambda b: _anchors(b, window, ANCHOR)), _ANCHORS)
    route = F.when(F.col("known"), F.xxhash64("doc_id", "anchor")).otherwise(F.col("anchor"))
    # The key is a column of its own, so that both windows share one shuffle.
    together = Window.partitionBy("route")
    low, high = F.min("short").over(together).alias("low"), F.max("short").over(together).alias("high")
    met = anchors.withColumn("route", route).select("doc_id", "anchor", "known", low, high)
    repeating = written(met.filter("known OR low < high").select("doc_id", "anchor"), "repeated-anchors")
    hot = repeating.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    marked = repeating.join(hot, "anchor", "left").select(
        "doc_id", F.struct("anchor", F.coalesce("hot", F.lit(False)).alias("hot")).alias("a")
    )
    of_doc = marked.groupBy("doc_id").agg(F.collect_set("a").alias("anchors"))
    known_as = identity.join(firsts, "whole")
    entries = (
        known_as.join(of_doc, "doc_id")
        .groupBy("doc_id").agg(F.collect_list(F.struct("whole", "first", "nth", "anchors")).alias("entries"))
    )
    candidates = rows.join(entries, "doc_id")
    segments = candidates.mapInArrow(tidy(lambda b: _segment_texts(b, window, ANCHOR)), _SEGMENTS)
    minima = segments.repartition("route").sortWithinPartitions("route", "words").mapInArrow(tidy(lambda b: _shards(b, window)), _MINIMA
    )
    places = candidates.mapInArrow(tidy(lambda b: _segment_places(b, window, ANCHOR)), _PLACES)
    earlier = F.expr("filter(transform(least, (m, i) -> if(m < first, at + i, null)), x -> x is not null)")
    starts = (
        places.join(minima, ["route", "key"]).select("first", "nth", earlier.alias("starts")).filter(F.size("starts") > 0)
        .groupBy("first", "nth").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    )
    copies = known_as.filter("doc_id <> first").select(
        "doc_id", "whole", F.lit(True).alias("copy"), F.lit(None).cast("array<long>").alias("starts")
    )
    parts = firsts.join(starts, ["first", "nth"]).select(
        F.col("first").alias("doc_id"), "whole", F.lit(False).alias("copy"), "starts"
    )
    marks = copies.unionByName(parts).groupBy("doc_id").agg(F.collect_list(F.struct("whole", "copy", "starts")).alias("marks"))

    kind = every.schema["rest"].dataType.simpleString()
    schema = (
        f"doc_id long, text string, rest {kind}, n_words long, n_removed long, "
        "spans array<struct<first: long, last: long>>"
    )
    judged = rows.join(marks, "doc_id", "left").unionByName(
        every.filter(F.col("doc_id").isNull()).withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
    )
    return judged.mapInArrow(tidy(lambda b: _cut(b, window, joined)), schema)


def drop_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated passages, in the columns of ``docs``.

    Documents that lose nothing stay as they are; what is left of others is joined by one space
    and ``n_chars``, if there is such a column, follows. Documents that lose all words go.
    """
    done = repeated(docs, window, joined=False).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))

    def column(name):
        if name in ("doc_id", "text"):
            return F.col(name)
        value = F.col(f"rest.`{name}`")
        if name == "n_chars":
            value = F.when(F.col("n_removed") == 0, value).otherwise(F.length("text"))
        return value.alias(name)

    return done.select(*[column(c) for c in docs.columns])
