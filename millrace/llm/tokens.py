"""Token ids of whole texts by the tokenizers library, each distinct chunk of text encoded once.

A tokenizer that first splits its text gives a text the ids of its chunks, one after the other,
if the chunks are cut only where it always splits:

- "words" (white space only parts words, case is folded): at ASCII white space, which goes;
  A-Z are lowered beforehand;
- "bytes" (byte-level pattern, a word takes the blank before it): before a single blank between
  other characters, and around a single line feed between other characters. A text with
  white space or separators beyond ASCII is encoded whole;
- both: between an ASCII letter and ASCII punctuation, but not after an apostrophe.

Chunks are cut and counted as arrays. A cache of two generations keeps the ids of chunks seen
before: when the younger is full it becomes the older, from which chunks still in use move over.
Spark runs many tasks in one Python worker, so `shared_encoder` keeps a worker's encoder between them.
With `special`, a text that holds the string of a special token is encoded whole, as the library
does by default: the string becomes that token's id. Without, such strings are ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a cache generation, and bytes of text that are encoded at once.
CACHE, BLOCK_BYTES = 300_000, 2 << 20
#: White space and separators that the byte-level pattern could join with a blank.
_RARE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x1c-\\x1f]"


_BLANK_FIRST = re.compile(rb" [^\x09-\x0d\x20]+")
_BYTES = np.arange(256)
_IS_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_IS_APOSTROPHE = _BYTES == 39
_IS_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_IS_LETTER & ~((_BYTES >= 48) & (_BYTES <= 57))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


class _Known:
    """The ids of known chunks, end to end."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts = self.sizes = np.zeros(0, np.int64)

    def find(self, chunks: list[bytes]) -> np.ndarray:
        """Each chunk's place, -1 for an unknown one."""
        return np.fromiter(map(self.places.get, chunks, repeat(-1)), np.int64, len(chunks))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of each)."""
        size = self.sizes[places]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.starts[places] - before, size) + np.arange(int(size.sum()))], size

    def add(self, chunks: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of new chunks."""
        ends = self.used + np.cumsum(sizes)
        end = int(ends[-1]) if len(ends) else self.used
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end), np.uint32)])
        self.ids[self.used : end] = flat
        places = np.arange(len(self.sizes), len(self.sizes) + len(chunks))
        self.places.update(zip(chunks, places.tolist(), strict=True))
        self.starts, self.sizes = np.concatenate([self.starts, ends - sizes]), np.concatenate([self.sizes, sizes])
        self.used = end
        return places


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def shared_encoder(path: str, kind: str, end_id: int, special: bool = False) -> ChunkEncoder:
    """This process's encoder of these parameters, with what it has learnt; one other is forgotten for a new one."""
    key = (path, kind, end_id, special)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


class ChunkEncoder:
    def __init__(self, path: str, kind: str, end_id: int, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; Spark has the others
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind, self.end_id = kind, end_id
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.young, self.old = _Known(), _Known()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_whole(self, texts: list[str]) -> list[list[int]]:
        """Special tokens count, if they are to."""
        self.tokenizer.encode_special_tokens = not self.special
        try:
            return self._encode(texts)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _encode_apart(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk)."""
        lists = self._encode([c.decode() for c in chunks])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _encode_joined(self, chunks: list[bytes], between: str, run: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that stay apart with `between` in between: many to a text, told apart by the tokens' offsets."""
        words = [c.decode() for c in chunks]
        runs = [words[i : i + run] for i in range(0, len(words), run)]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, e in zip(runs, self.tokenizer.encode_batch([between.join(r) for r in runs], add_special_tokens=False), strict=True):
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + len(between))
            starts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_bytes(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for byte-level chunks: those of one blank and no further white space are joined."""
        joined = np.fromiter((_BLANK_FIRST.fullmatch(c) is not None for c in chunks), bool, len(chunks))
        order = np.argsort(~joined, kind="stable")
        n = int(joined.sum())
        a, a_sizes = self._encode_joined([chunks[i] for i in order[:n].tolist()], "")
        b, b_sizes = self._encode_apart([chunks[i] for i in order[n:].tolist()])
        flat, grouped = np.concatenate([a, b]), np.concatenate([a_sizes, b_sizes])
        starts, sizes = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        starts[order], sizes[order] = np.cumsum(grouped) - grouped, grouped
        return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def _places(self, chunks: list[bytes]) -> np.ndarray:
        """The places of distinct chunks among the younger known ones, all known afterwards."""
        if len(self.young.places) + len(chunks) > CACHE:
            self.young, self.old = _Known(), self.young
        place = self.young.find(chunks)
        missing = np.flatnonzero(place < 0)
        before = self.old.find([chunks[i] for i in missing.tolist()])
        moved = missing[before >= 0]
        place[moved] = self.young.add([chunks[i] for i in moved.tolist()], *self.old.take(before[before >= 0]))
        new = missing[before < 0]
        for i in range(0, len(new), 20_000):
            part = [chunks[k] for k in new[i : i + 20_000].tolist()]
            place[new[i : i + 20_000]] = self.young.add(part, *(self._encode_joined(part, " ") if self.kind == "words" else self._encode_bytes(part)))
        return place

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, chunk offsets, chunks before each text and in all)."""
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        letter, sign = _IS_LETTER[data], _IS_SIGN[data]
        first = np.zeros(len(data), bool)
        first[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & ~_IS_APOSTROPHE[data[:-1]] & letter[1:])
        if self.kind == "words":
            first[1:] |= blank[:-1]
            first[edge] = True
            first &= ~blank
            kept = np.concatenate([[0], np.cumsum(~blank, dtype=np.int32)])
            starts = np.flatnonzero(first)
            return _LOWER[data[~blank]], np.append(kept[starts], kept[-1]), np.searchsorted(starts, offsets)
        alone = blank.copy()
        alone[1:] &= ~blank[:-1]
        alone[:-1] &= ~blank[1:]
        first |= alone & ((data == 32) | (data == 10))
        first[1:] |= (alone & (data == 10))[:-1]
        first[edge] = True
        starts = np.flatnonzero(first)
        return data, np.append(starts, len(data)), np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of all texts, each with the end id; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _RARE).to_numpy(zero_copy_only=False) if self.kind == "bytes" else np.zeros(len(texts), bool)
        for content in self.special:
            whole = whole | pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        fast = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        fast = fast.cast(pa.large_binary())
        at = np.frombuffer(fast.buffers()[1], np.int64)[fast.offset : fast.offset + len(fast) + 1]
        data = np.frombuffer(fast.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        data, cuts, by_text = self._chunks(data, at - at[0])
        many = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = many.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        flat, size = self.young.take(place)
        before = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(before[by_text])
        if whole.any():
            slow = dict(zip(np.flatnonzero(whole).tolist(), self._encode_whole(texts.filter(pa.array(whole)).to_pylist()), strict=True))
            parts = np.split(flat, before[by_text][1:-1])
            parts = [np.array(slow[i], np.uint32) if i in slow else p for i, p in enumerate(parts)]
            counts, flat = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(offsets[-1], self.end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = flat
        return out, offsets


def blocks(batch: pa.RecordBatch, column: int = 1, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts hold about `size` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
