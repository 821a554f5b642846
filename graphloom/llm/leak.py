"""Evaluation texts leaking into training text (problem 7): Wu-Manber multi-pattern search over normalised words.

Patterns are all runs of SEED_WORDS words of the evaluation texts, read as strings over words; a block is two neighbouring
words. The shift table tells, by the hash of the block that ends the window, how far the window may move without missing
a pattern: the distance from the block's last place in any pattern to the pattern's end, and a whole pattern less the
block where no pattern holds it. Texts are cut into lanes that move through their windows side by side, each by its own
shifts. Where the shift is 0, the bucket of the window's suffix hash names the patterns that may end there, with every
evaluation text that holds them, however many those are. Hashes only nominate: a candidate's words are then compared
directly, in an alignment of its surroundings with the whole evaluation text.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.bpe import CHUNK_BYTES

SEED_WORDS, BLOCK_WORDS = 3, 2
#: A word is an evaluation text's own if at most OWN_SHARE of the texts hold it, or OWN_LEAST of them where they are few.
#: Sentences of the same build with other content differ in such words; this decides no search, only that question.
OWN_SHARE, OWN_LEAST = 0.0125, 3
#: Characters of evaluation texts held by one broadcast; more texts are searched in several passes.
PASS_CHARS = 64_000_000
#: Score of a word changed, added or left out inside a passage, against 1 for an equal word.
GAP_COST = 2.0
#: Words without an occurrence that end a cluster of occurrences; a passage of a gap this long scores less than its parts.
CLUSTER_GAP = 60
#: Occurrences that a passage of least_words words has at least, with its usual changes; a shorter one has one.
LEAST_SEEDS = 2
#: Lanes that move through a chunk side by side.
LANES = 4096
#: Blanks inside a tag or comment from which it holds prose and is searched as text.
PROSE_BLANKS = 12

_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")
_MARKS = re.compile("[\u0300-\u036f]")
_FOREIGN = regex.compile(r"[^\p{L}\p{N}\p{M}\x00-\x7f]+")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|&#?\w{1,8};")
_SEPARATOR, _WORD, _DROPPED = 0, 1, 2


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.full(256, _SEPARATOR, np.uint8)
    lower[65:91] += 32
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD
    kind[ord("_")] = _DROPPED
    return lower, kind


LOWER, KIND = _tables()


def plain(text: str) -> str:
    """Rarely needed part of the normal form: escapes, compatibility forms, accents, invisible and foreign punctuation."""
    if "&" in text or "\\u" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else html.unescape(m[0]), text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
        text = _MARKS.sub("", unicodedata.normalize("NFD", text)).lower()
        text = _FOREIGN.sub(" ", text)
        text = text.encode("utf-8", "replace").decode()
    return text


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normal form of UTF-8 bytes: the kept lower-case bytes, where each came from, and starts and ends of its words.

    Case, punctuation, markup tags, backslash escapes, underscores and hyphens at line ends vanish; words are runs of
    letters and digits.
    """
    kind = KIND[data]
    n = data.size
    at = np.flatnonzero(data == 0x5C)  # backslashes
    if at.size:
        after = data[np.minimum(at + 1, n - 1)]
        letter = np.isin(after, np.frombuffer(b"nrtfv", np.uint8))
        kind[at] = np.where(KIND[after] == _WORD, _SEPARATOR, _DROPPED)
        kind[np.minimum(at[letter] + 1, n - 1)] = _SEPARATOR
    at = np.flatnonzero(data == 0x3C)  # tags
    if at.size:
        after = data[np.minimum(at + 1, n - 1)]
        at = at[(after == 0x2F) | (after == 0x21) | (KIND[after] == _WORD)]
        close = np.append(np.flatnonzero(data == 0x3E), n)
        stop = close[np.searchsorted(close, at)]
        near = (stop < n) & (np.append(at[1:], n + 1) > stop)
        at, stop = at[near], stop[near]
        blank = np.append(0, np.cumsum((data == 32) | ((data >= 9) & (data <= 13))))
        bare = blank[stop] - blank[at] < PROSE_BLANKS
        depth = np.zeros(n + 1, np.int8)
        depth[at[bare]] = 1
        depth[stop[bare] + 1] -= 1
        inside = np.cumsum(depth[:n], dtype=np.int8) > 0
        kind[inside & (kind == _WORD)] = _SEPARATOR
    at = np.flatnonzero((data[:-1] == 0x2D) & ((data[1:] == 10) | (data[1:] == 13))) if n > 1 else np.zeros(0, np.int64)
    for k in at.tolist():  # hyphens at line ends
        stop = k + 1
        while stop < n and data[stop] in b" \t\r\n>*#/":
            stop += 1
        if k and stop < n and kind[k - 1] == _WORD and 97 <= data[stop] <= 122:
            kind[k:stop] = _DROPPED
    keep = np.flatnonzero(kind != _DROPPED)
    word = kind[keep] == _WORD
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    return LOWER[data[keep]], keep, edge[::2], edge[1::2]


_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def word_hashes(kept: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from its length and its first, middle and last eight bytes."""
    if not start.size:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([kept, np.zeros(16, np.uint8)])
    eight = np.ndarray((padded.size - 8,), "<u8", padded, strides=(1,))
    size = end - start
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
    out = (eight[start] & mask) * _M1 + size.astype(np.uint64) * _M4
    long = np.flatnonzero(size > 8)
    a, b = start[long], end[long]
    tail, middle = eight[b - 8], eight[np.minimum(a + 8, b - 8)]
    out[long] = (out[long] ^ (out[long] >> np.uint64(29))) * _M2 + tail * _M3 + (middle ^ (middle >> np.uint64(31))) * _M4
    out ^= out >> np.uint64(32)
    return out * _M1


def blocks(words: np.ndarray) -> np.ndarray:
    """Hash of each two neighbouring words."""
    return (words[:-1] * _M2 + (words[1:] ^ (words[1:] >> np.uint64(30))) * _M3) * _M1


def runs(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Hash of each run of SEED_WORDS words."""
    return (pairs[: words.size - SEED_WORDS + 1] * _M4 + words[SEED_WORDS - 1 :]) * _M2


@dataclass
class Patterns:
    """Tables of the search, as flat arrays; the size follows the evaluation texts, which a pass bounds by PASS_CHARS."""

    shift: np.ndarray  # by the top bits of a block's hash: words that the window may move
    bits: int
    seeds: np.ndarray  # sorted seed hashes: the suffix buckets
    first: np.ndarray  # postings of each seed
    places: np.ndarray  # of each posting, the word at which the seed starts
    names: list
    letters: np.ndarray  # all words of all items, with a blank after each
    start: np.ndarray  # where each word starts in letters, and the end
    item: np.ndarray  # the first word of each item, and the end
    own: np.ndarray  # of each word, whether few items hold it
    hashes: np.ndarray  # of each word
    fewest: np.ndarray | None = None  # own words that any passage of an item must hold, see least_own()
    own_words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # their sorted hashes, the postings of each, and its items

    @classmethod
    def build(cls, texts: list[tuple[object, str]], spread: dict[str, int] | None = None, total: int | None = None) -> Patterns:
        """spread: in how many of total distinct texts each word occurs; counted in texts if they are all there are."""
        names, raw, sizes, texts_of, seen = [], [], [], [], {}
        for name, text in texts:
            words = split_words(text)
            if words:
                names.append(name)
                sizes.append(len(words))
                texts_of.append(seen.setdefault(tuple(words), len(seen)))
                raw += words
        coded = [w.encode() for w in raw]
        start, item = np.cumsum([0, *(len(w) + 1 for w in coded)]), np.cumsum([0, *sizes])
        letters = np.frombuffer(b" ".join(coded) + b" ", np.uint8) if coded else np.zeros(0, np.uint8)
        h = word_hashes(letters, start[:-1], start[1:] - 1)
        most = max(OWN_LEAST, int(OWN_SHARE * (len(seen) if total is None else total)))
        if spread is None:
            text = np.repeat(np.array(texts_of, np.int64), sizes)
            _, which = np.unique(h, return_inverse=True)
            held = np.unique(which * np.int64(len(seen) + 1) + text) // np.int64(len(seen) + 1)
            own = np.bincount(held)[which] <= most if h.size else np.zeros(0, bool)
        else:
            own = np.array([spread.get(w, 0) <= most for w in raw], bool)
        bits = max(16, min(26, h.size.bit_length() + 6))
        shift = np.full(1 << bits, SEED_WORDS - BLOCK_WORDS + 1, np.uint8)
        where, seed = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if h.size >= SEED_WORDS:
            pair = blocks(h)
            seed = runs(h, pair)
            last = np.repeat(item[1:], sizes)  # where each word's item ends
            where = np.flatnonzero(np.arange(seed.size) + SEED_WORDS <= last[: seed.size])
            for k in range(SEED_WORDS - BLOCK_WORDS + 1):  # a block at place k may end the window after SEED_WORDS - BLOCK_WORDS - k more words
                np.minimum.at(shift, pair[where + k] >> np.uint64(64 - bits), SEED_WORDS - BLOCK_WORDS - k)
            seed = seed[where]
        order = np.argsort(seed, kind="stable")
        seeds, first = np.unique(seed[order], return_index=True)
        return cls(shift, bits, seeds, np.append(first, seed.size), where[order].astype(np.int32), names, letters, start, item, own, h)

    def prepare(self, length: int, least_words: int) -> None:
        """Tables of own words: what any passage of length words must hold of them, in items of least_words words or more."""
        count, size = np.append(0, np.cumsum(self.own)), np.diff(self.item)
        self.fewest = np.zeros(size.size, np.int64)
        for k in np.flatnonzero(size >= max(length, least_words, 1)).tolist():
            part = count[self.item[k] : self.item[k + 1] + 1]
            self.fewest[k] = (part[length:] - part[: part.size - length]).min()
        word, item = self.hashes[self.own], np.repeat(np.arange(size.size), size)[self.own]
        order = np.lexsort((item, word))
        word, item = word[order], item[order]
        new = np.append(True, (word[1:] != word[:-1]) | (item[1:] != item[:-1]))[: word.size]
        hashes, first = np.unique(word[new], return_index=True)
        self.own_words = hashes, np.append(first, new.sum()), item[new]

    def own_near(self, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words from low to high of the words of hash h are own words of item, for each of them."""
        hashes, first, items = self.own_words
        if not hashes.size:
            return np.zeros(item.size, np.int64)
        where = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
        at = np.flatnonzero(hashes[where] == h)
        many = (first[1:] - first[:-1])[where[at]]
        post = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[where[at]], many)
        key = np.sort(items[post] * np.int64(h.size + 1) + np.repeat(at, many))
        return np.searchsorted(key, item * np.int64(h.size + 1) + high) - np.searchsorted(key, item * np.int64(h.size + 1) + low)

    def words(self, k: int) -> list[str]:
        """Words of item number k."""
        raw = self.letters[self.start[self.item[k]] : self.start[self.item[k + 1]]].tobytes()
        return raw.decode("utf-8", "replace").split(" ")[:-1]

    def occurrences(self, pair: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the words of hash h (and of block hashes pair) seeds start, and the number of each."""
        top, windows = np.uint64(64 - self.bits), h.size - SEED_WORDS + 1
        lanes = min(LANES, windows)
        at = np.arange(lanes, dtype=np.int64) * windows // lanes
        stop, found = np.append(at[1:], windows), []
        while at.size:
            move = self.shift[pair[at + SEED_WORDS - BLOCK_WORDS] >> top]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        begin = np.concatenate(found)
        begin.sort()
        seed = (pair[begin] * _M4 + h[begin + SEED_WORDS - 1]) * _M2
        where = np.minimum(np.searchsorted(self.seeds, seed), self.seeds.size - 1)
        same = self.seeds[where] == seed
        return begin[same], where[same]


def split_words(text: str) -> list[str]:
    """Words of one text in normal form."""
    data = np.frombuffer(plain(text).encode("utf-8", "replace"), np.uint8)
    if not data.size:
        return []
    kept, _, start, end = word_spans(data)
    raw = kept.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]


def passage(item: list[str], words: list[str], rare: np.ndarray) -> tuple[int, int, int, int]:
    """The best passage of item in words: words of item it spans, of them found, and the same of its rare words.

    Runs of equal words score, words changed, added or left out between them cost.
    """
    best, run, score = (0, 0, 0, 0, 0), None, 0.0
    before = np.append(0, np.cumsum(rare))
    for a, b, size in difflib.SequenceMatcher(None, item, words, autojunk=False).get_matching_blocks():
        if not size:
            break
        if run is not None:
            score -= GAP_COST * max(a - run[1], b - run[2])
        if run is None or score <= 0:
            run, score = [a, a, b, 0, 0], 0.0
        score += size
        run[1], run[2], run[3], run[4] = a + size, b + size, run[3] + size, run[4] + int(before[a + size] - before[a])
        if score > best[0]:
            best = (score, run[1] - run[0], run[3], int(before[run[1]] - before[run[0]]), run[4])
    return best[1:]


#: Words of an evaluation text up to which possible() looks at all of its passages.
POSSIBLE_WORDS = 600


def possible(held: np.ndarray, own: np.ndarray, least: int, least_share: float) -> bool:
    """Whether an item has a passage of least words of which enough, and enough of its own ones, are held at all.

    This is necessary for an accepted alignment, whatever the order of the words, and spares most alignments with texts of
    the same build. Items of more than POSSIBLE_WORDS words are always aligned.
    """
    n = held.size
    if n > POSSIBLE_WORDS:
        return True
    share = np.append(0.0, np.cumsum(held)) - least_share * np.arange(n + 1) + 1e-9 * np.arange(n + 1)
    mine = np.append(0, np.cumsum(2 * (held & own) - own.astype(np.int64)))
    return bool(np.triu((share[:, None] <= share) & (mine[:, None] <= mine), max(1, least)).any())


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "query_text", least_words: int = 20, least_share: float = 0.8, slack: int = 3) -> DataFrame:
    """Documents that hold an evaluation text or a passage of it: (id_col, item_col, span_words int, found_words int).

    A passage counts if it spans at least least_words words of the item in their order (all of a shorter item), up to
    slack of which may be changed at its ends, and at least least_share of the spanned words are there, as well as half of
    its own words, those that few items hold (else it is a sentence of the same build with other content). Case,
    punctuation, line ends, markup, escapes and invisible characters do not matter. One row for each document and item;
    found_words is the number of equal words of the best passage. A row of df with a null or blank text, and an item with
    a null or blank text, gives nothing; repeated rows of df give repeated rows; an item repeated under one id counts
    once; empty tables give no rows; further columns are not read.

    Items may share passages, in any number: each comes out. df is read once in a narrow pass without a shuffle. The items
    are the pattern side: they are read to the driver and broadcast in blocks of at most PASS_CHARS characters, with one
    pass over df for each block.
    """
    kept = df.select(df[id_col], df[text_col].alias("__text")).filter(F.length("__text") > 0)
    own = items.select(items[item_col].alias("__id"), items[item_text_col].alias("__text")).filter(F.length("__text") > 0).distinct()
    schema = T.StructType([T.StructField(id_col, kept.schema[0].dataType), T.StructField(item_col, own.schema[0].dataType), T.StructField("span_words", T.IntegerType()), T.StructField("found_words", T.IntegerType())])
    total = own.agg(F.sum(F.length("__text"))).first()[0] or 0
    passes = -(-total // PASS_CHARS) or 1
    counts = _word_counts(own) if passes > 1 else None
    texts = own.select("__text").distinct().count() if passes > 1 else None
    result = None
    for k in range(passes):
        block = own.filter(F.pmod(F.xxhash64("__id"), F.lit(passes)) == k) if passes > 1 else own
        spread = {r[0]: r[1] for r in _words(block).join(counts, "word").collect()} if counts is not None else None  # words of one block
        patterns = Patterns.build([(r[0], r[1]) for r in block.collect()], spread, texts)
        part = _search(kept, patterns, schema, least_words, least_share, slack)
        result = part if result is None else result.unionAll(part)
    return result


@F.pandas_udf(T.ArrayType(T.StringType()))
def _distinct_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(set(split_words(t))))


def _words(items: DataFrame) -> DataFrame:
    return items.select("__text").distinct().select(F.explode(_distinct_words("__text")).alias("word")).distinct()


def _word_counts(items: DataFrame) -> DataFrame:
    """In how many distinct texts each word occurs."""
    return items.select("__text").distinct().select(F.explode(_distinct_words("__text")).alias("word")).groupBy("word").count()


def _search(kept: DataFrame, patterns: Patterns, schema: T.StructType, least_words: int, least_share: float, slack: int) -> DataFrame:
    patterns.prepare(least_words - slack, least_words)
    shared = kept.sparkSession.sparkContext.broadcast(patterns)
    item_type = to_arrow_type(schema[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = batch.column(1)
            row, rows = 0, len(texts)
            while row < rows:
                stop, size, parts = row, 0, []
                while stop < rows and (not parts or size < CHUNK_BYTES):
                    text = texts[stop].as_py()
                    raw = (plain(text) if "&" in text or "\\u" in text or not text.isascii() else text).encode("utf-8", "replace")
                    parts.append(raw)
                    size += len(raw) + 1
                    stop += 1
                data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
                found = search_chunk(table, data, np.cumsum([0, *(len(p) + 1 for p in parts)]), least_words, least_share, slack)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([row + f[0] for f in found], pa.int32())), pa.array([table.names[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                        schema.names,
                    )
                row = stop

    return kept.mapInArrow(run, schema)


def search_chunk(table: Patterns, data: np.ndarray, bounds: np.ndarray, least_words: int, least_share: float, slack: int) -> list[tuple[int, int, int, int]]:
    """(text, item, span, found) of every leak in the texts data[bounds[i]:bounds[i+1]]."""
    kept, origin, start, end = word_spans(data)
    if start.size < SEED_WORDS or not table.seeds.size:
        return []
    h = word_hashes(kept, start, end)
    begin, where = table.occurrences(blocks(h), h)
    text = np.searchsorted(bounds, origin[start[begin]], "right") - 1
    whole = text == np.searchsorted(bounds, origin[start[begin + SEED_WORDS - 1]], "right") - 1
    begin, where, text = begin[whole], where[whole], text[whole]
    many = table.first[where + 1] - table.first[where]
    if not many.sum():
        return []
    # Every occurrence once for each of its postings, by text and item, in the order of the text.
    post = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(table.first[where], many)
    place, begin, text = table.places[post].astype(np.int64), np.repeat(begin, many), np.repeat(text, many)
    item = np.searchsorted(table.item, place, "right") - 1
    order = np.lexsort((begin, item, text))
    begin, text, item, place = begin[order], text[order], item[order], place[order]
    size = np.diff(table.item)
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > CLUSTER_GAP))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], begin.size) - 1
    cluster = np.cumsum(new) - 1
    distinct = np.bincount(np.unique(cluster * np.int64(table.start.size) + place) // np.int64(table.start.size), minlength=head.size)
    enough = np.flatnonzero(distinct >= np.where(size[item[head]] >= least_words, LEAST_SEEDS, 1))
    low = np.maximum(np.searchsorted(origin[start], bounds)[text[head]], begin[head] - CLUSTER_GAP)
    high = np.minimum(np.searchsorted(origin[start], bounds)[text[head] + 1], begin[tail] + SEED_WORDS + CLUSTER_GAP)
    if table.own_words is not None:  # too few of the item's own words are near for any passage of it
        enough = enough[2 * table.own_near(h, item[head[enough]], low[enough], high[enough]) >= table.fewest[item[head[enough]]]]
    raw, best = kept.tobytes(), {}
    near_key, near, there, own_key, own = None, None, h[:0], None, []
    for c in enough.tolist():
        t, k, x, y = int(text[head[c]]), int(item[head[c]]), int(low[c]), int(high[c])
        mine, need = slice(table.item[k], table.item[k + 1]), min(least_words, int(size[k]))
        if near_key != (x, y):
            near_key, near, there = (x, y), None, np.unique(h[x:y])
        held = there[np.minimum(np.searchsorted(there, table.hashes[mine]), there.size - 1)] == table.hashes[mine]
        if not possible(held, table.own[mine], need - slack, least_share):
            continue
        if near is None:
            near = [raw[a:z].decode("utf-8", "replace") for a, z in zip(start[x:y].tolist(), end[x:y].tolist())]
        if own_key != k:
            own_key, own = k, table.words(k)
        span, equal, rare, rare_equal = passage(own, near, table.own[mine])
        if span >= need - slack and equal >= least_share * span and 2 * rare_equal >= rare and equal > best.get((t, k), (0, 0))[1]:
            best[t, k] = (span, equal)
    return [(*key, *value) for key, value in sorted(best.items())]
