"""Byte-level BPE over whole Arrow batches.

The public vocabulary is looked up in two tiers. A *minimal perfect hash* over the vocabulary resolves every
pre-token that is itself a vocabulary entry with one probe; the remaining pre-tokens are merged with a heap over a
doubly linked list of bytes. Pre-tokens are cut with array operations over the UTF-8 bytes of many texts at once and
dictionary-encoded, so both tiers see each distinct pre-token of a batch once.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The Unicode White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Entries of the per-process memo of distinct pre-tokens; it is emptied when full, so memory stays bounded.
MEMO_ENTRIES = 400_000
#: Pre-tokens above this many bytes are not kept in the memo.
MEMO_BYTES = 64
#: Text bytes handled by one round of array operations; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


@functools.cache
def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte of valid UTF-8; all bytes of a character carry the character's class."""
    table = code_point_classes()
    cls = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        b0 = data[lead].astype(np.int32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = b0 & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            has = size > k
            cp[has] = (cp[has] << 6) | (data[lead[has] + k] & 0x3F)
        own = table[np.minimum(cp, 0x10FFFF)]
        for k in range(4):
            has = size > k
            cls[lead[has] + k] = own[has]
    return cls


def pre_token_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start offsets of all pre-tokens of the texts data[bounds[i]:bounds[i+1]] laid end to end.

    Equivalent to matching, again and again: a contraction; an optional blank with letters, with numbers or with other
    visible characters; white space up to the last before a visible character; white space.
    """
    n = data.size
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[1:n] = cls[1:] != cls[:-1]
    text_start = np.zeros(n + 1, bool)
    text_start[bounds] = True
    first |= text_start
    first[n] = True
    runs = np.flatnonzero(first)
    start, end = runs[:-1], runs[1:]
    kind = cls[start]
    mark = first.copy()

    # A run of white space before a visible character leaves its last character to what follows.
    gap = (kind == SPACE) & ~text_start[end]
    a, b = start[gap], end[gap]
    last = b - 1
    back = data[last] >= 0x80
    while back.any():  # White space of two or three bytes.
        last = np.where(back & (data[last] < 0xC0), last - 1, last)
        back = (data[last] >= 0x80) & (data[last] < 0xC0)
    mark[last[last > a]] = True
    mark[b[data[last] == 0x20]] = False

    # A lone apostrophe that starts a match takes the letters of a contraction.
    quote = (kind == OTHER) & (end - start == 1) & (data[start] == 0x27) & mark[start] & ~text_start[end]
    quote = np.flatnonzero(quote)
    quote = quote[kind[np.minimum(quote + 1, kind.size - 1)] == LETTER]
    if quote.size:
        at, room = end[quote], end[quote + 1] - end[quote]
        one = data[at]
        two = data[np.minimum(at + 1, n - 1)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = (room >= 2) & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        mark[at[single | double]] = False
        mark[at[single] + 1] = True
        mark[at[double] + 2] = True
    return np.flatnonzero(mark[:n])


@dataclass(frozen=True)
class Vocabulary:
    """A byte-pair vocabulary behind a minimal perfect hash (bucketed displacement, one slot for each entry)."""

    shift: np.ndarray  # displacement of each bucket; negative: the slot of the bucket's only key
    slot_id: np.ndarray
    slot_start: np.ndarray
    blob: bytes

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls.build([(base64.b64decode(t), int(r)) for t, r in (line.split() for line in lines if line.strip())])

    @classmethod
    def build(cls, ranks: list[tuple[bytes, int]]) -> Vocabulary:
        n = len(ranks)
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(n // 4 + 1)]
        for k, (token, _) in enumerate(ranks):
            h = xxhash.xxh3_128_intdigest(token)
            buckets[h % len(buckets)].append((k, (h >> 64) & 0xFFFFFFFF, (h >> 96) | 1))
        shift, owner, free = np.zeros(len(buckets), np.int64), [-1] * n, n - 1
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            keys = buckets[b]
            if len(keys) == 1:
                while owner[free] >= 0:
                    free -= 1
                owner[free], shift[b] = keys[0][0], -1 - free
            elif keys:
                d = 0
                while True:
                    slots = {(x + d * y) % n for _, x, y in keys}
                    if len(slots) == len(keys) and all(owner[s] < 0 for s in slots):
                        break
                    d += 1
                shift[b] = d
                for k, x, y in keys:
                    owner[(x + d * y) % n] = k
        tokens = [ranks[k][0] for k in owner]
        return cls(shift, np.array([ranks[k][1] for k in owner], np.int64), np.cumsum([0, *map(len, tokens)]), b"".join(tokens))

    def __reduce__(self):
        return Vocabulary, (self.shift, self.slot_id, self.slot_start, self.blob)

    @functools.cached_property
    def _plain(self) -> tuple[list[int], list[int], list[int]]:
        return self.shift.tolist(), self.slot_id.tolist(), self.slot_start.tolist()

    def rank(self, token: bytes) -> int:
        """The id of a token, or -1: one hash, one probe, one comparison."""
        shift, ids, start = self._plain
        h = xxhash.xxh3_128_intdigest(token)
        d = shift[h % len(shift)]
        slot = -1 - d if d < 0 else (((h >> 64) & 0xFFFFFFFF) + d * ((h >> 96) | 1)) % len(ids)
        return ids[slot] if self.blob[start[slot] : start[slot + 1]] == token else -1

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    @functools.cached_property
    def _merges(self) -> dict[bytes, int]:
        start = self._plain[2]
        return {self.blob[a:b]: r for a, b, r in zip(start, start[1:], self._plain[1])}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-ranked pair first, leftmost on ties: a heap over linked bytes.

        An entry of the heap is rank * n + place; it is stale unless the pair at that place still has that rank.
        """
        n, get, none = len(piece), self._merges.get, 1 << 40
        end, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [get(piece[k : k + 2], none) for k in range(n - 1)]
        pair.append(none)
        heap = [r * n + k for k, r in enumerate(pair) if r != none]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, k = divmod(pop(heap), n)
            if pair[k] != r:
                continue
            m = end[k]
            stop = end[k] = end[m]
            pair[m] = -1
            if stop < n:
                before[stop] = k
                r = pair[k] = get(piece[k : end[stop]], none)
                if r != none:
                    push(heap, r * n + k)
            else:
                pair[k] = none
            left = before[k]
            if left >= 0:
                r = pair[left] = get(piece[left:stop], none)
                if r != none:
                    push(heap, r * n + left)
        out, k = [], 0
        while k < n:
            out.append(get(piece[k : end[k]]))
            k = end[k]
        return out


@dataclass
class Encoded:
    """Pre-tokens and ids of a run of texts laid end to end."""

    starts: np.ndarray  # byte offset of each pre-token
    counts: np.ndarray  # ids in each pre-token
    text_first: np.ndarray  # index of the first pre-token of each text, and one past the last
    ids: np.ndarray | None


class Encoder:
    """Encodes Arrow strings with one vocabulary; one object lives in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo = vocabulary, {}

    @functools.cached_property
    def token_bytes(self) -> dict[int, bytes]:
        return {r: t for t, r in self.vocabulary._merges.items()}

    def lookup(self, piece: bytes) -> list[int]:
        found = self.memo.get(piece)
        if found is None:
            found = self.vocabulary.encode(piece)
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[piece] = found
        return found

    def encode(self, data: np.ndarray, bounds: np.ndarray, with_ids: bool = True) -> Encoded:
        """data: UTF-8 bytes; bounds: offsets of the texts in it, first 0, last data.size."""
        starts = pre_token_starts(data, bounds)
        first = np.searchsorted(starts, bounds)
        if not starts.size:
            return Encoded(starts, starts, first, starts.astype(np.int32) if with_ids else None)
        offsets = np.append(starts, data.size).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = list(map(self.lookup, pieces.dictionary.to_pylist()))
        size = np.fromiter(map(len, found), np.int32, len(found))
        which = pieces.indices.to_numpy(zero_copy_only=False)
        counts = size[which]
        ids = None
        if with_ids:
            flat = np.fromiter((x for f in found for x in f), np.int32, int(size.sum()))
            begin = np.cumsum(size) - size
            total = np.cumsum(counts, dtype=np.int64)
            place, ids = total - counts, np.empty(int(total[-1]), np.int32)
            ids[place] = flat[begin[which]]
            many = np.flatnonzero(counts > 1)
            if many.size:
                more = counts[many]
                inner = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
                ids[np.repeat(place[many], more) + inner] = flat[np.repeat(begin[which[many]], more) + inner]
        return Encoded(starts, counts, first, ids)


def chunks(column: pa.Array):
    """Slices (first row, rows, bytes, bounds) of a string column with at most CHUNK_BYTES of text, or one text, each."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if column.null_count:  # A null text has no bytes that count.
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        stop = min(stop, n)
        yield row, stop - row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


_encoders: dict[str, Encoder] = {}


def worker_encoder(key: str, vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; kept between tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]
