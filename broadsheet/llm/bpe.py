"""Byte-pair encoding of whole texts by merge ranks, and decoding."""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm import runs
from broadsheet.llm.common import tidy

END = "</w>"
# White space as the tokenizer files mean it: the Unicode property, without U+001C to U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = regex.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+"
).findall
# Bytes of distinct words and their ids that a worker keeps, and text that is encoded at a time.
KEPT, BYTES = 24 << 20, 2 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's
    own where it is printable in Latin-1, else the next unused one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the word-end kind: NFC, lower case, words merged by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        vocabulary: dict[str, int] = loaded["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocabulary, **self.special}.items()}
        characters = byte_characters()
        self.inner = [vocabulary[c] for c in characters]
        self.final = [vocabulary[c + END] for c in characters]
        if max(self.tokens) > 0xFFFF:
            raise ValueError("ids of more than 16 bits")
        # A pair of ids in one integer, to its rank and the id it becomes.
        self.merges = {
            vocabulary[a] << 16 | vocabulary[b]: rank << 16 | vocabulary[a + b]
            for rank, (a, b) in enumerate(loaded["model"]["merges"])
        }
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.path, self._library = path, None
        self.split_special = regex.compile(f"({marks})").split
        # Vocabulary strings by id, each with the space that parts it from the next.
        self._strings = pa.array([self.tokens.get(i, "") + " " for i in range(max(self.tokens) + 1)], pa.large_string())
        self._known = runs.Known(self._learn, KEPT)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one word.

        Symbols are a doubly linked list in two arrays. The queue holds mergeable pairs by rank,
        then place; an entry is stale, and skipped, if its pair has changed since.
        """
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        size = len(symbols)
        if size == 1:
            return symbols
        get = self.merges.get
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        # The merge that the pair starting at each symbol allows now, -1 for none.
        allowed = [get(a << 16 | b, -1) for a, b in zip(symbols, symbols[1:])]
        queue = [merge * size + i for i, merge in enumerate(allowed) if merge >= 0]
        heapq.heapify(queue)
        while queue:
            merge, i = divmod(heapq.heappop(queue), size)
            if allowed[i] != merge:
                continue
            made = symbols[i] = merge & 0xFFFF
            j = after[i]
            k = after[i] = after[j]
            symbols[j] = -1
            if k < size:
                before[k] = i
                allowed[j] = -1
                following = allowed[i] = get(made << 16 | symbols[k], -1)
                if following >= 0:
                    heapq.heappush(queue, following * size + i)
            else:
                allowed[i] = -1
            h = before[i]
            if h >= 0:
                leading = allowed[h] = get(symbols[h] << 16 | made, -1)
                if leading >= 0:
                    heapq.heappush(queue, leading * size + h)
        return [s for s in symbols if s >= 0]

    def _pieces_of_newer(self, part: str) -> list[str]:
        """Pieces of a run with characters that are newer than Python's Unicode tables: whether
        they are letters, digits or neither is asked of the library's own tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        part = self._library.normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(part)]

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of a run without white space."""
        ids: list[int] = []
        for part in self.split_special(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                for piece in self._pieces_of_newer(part):
                    ids += self.merge(piece.encode())
                continue
            if not part.isascii():
                # Lower case character by character: no special form at the end of a word.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            for piece in (part,) if part.isalpha() and part.isascii() else _PIECE(part):
                ids += self.merge(piece.encode())
        return ids

    def _learn(self, chunks: pa.Array) -> pa.Array:
        made = [self._chunk(chunk) for chunk in chunks.to_pylist()]
        return runs.lists(np.array([i for ids in made for i in ids], "<u4"), np.array([len(ids) for ids in made]))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and where each text's begin and the last one's
        end. A distinct word is worked out once."""
        return self._known.ids_of_all(*runs.words(texts))

    def decode_all(self, ids: np.ndarray, borders: np.ndarray) -> list[bytes]:
        """What the ids of each text decode to, in UTF-8: vocabulary strings one after the other;
        the file has no decoder, so by spaces."""
        data, ends = runs.flat(self._strings.take(pa.array(ids)))
        data, cuts = data.tobytes(), ends[borders].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]

    def encode_decode(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """Ids of a whole text and the UTF-8 text that they decode to."""
        ids, borders = self.encode_all(pa.array([text], pa.string()))
        return ids, self.decode_all(ids, borders)[0]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: token ids of the whole text and their decoded text.

    ``tokenizer`` is the path of a tokenizer file that every machine has. Equal to the public
    tokenizers library without special tokens added. A null text is an empty one: no ids and
    an empty text. Repeated rows are encoded each; other columns are not read. No shuffle; a
    task keeps the ids of distinct words in ``KEPT`` bytes and works on ``BYTES`` of text at a time.
    """

    def run(batches):
        model = _loaded(tokenizer)
        for batch in batches:
            for part in runs.slices(batch, BYTES):
                ids, borders = model.encode_all(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(model.decode_all(ids, borders), pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


_MODELS: dict[str, WordBpe] = {}


def _loaded(path: str) -> WordBpe:
    """One tokenizer per worker process: its cache serves all tasks there."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]
