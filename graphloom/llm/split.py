"""Splitting oversized texts at natural boundaries with overlap (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import bpe
from graphloom.llm.tokenize import VOCABULARY, vocabulary

#: Kinds of cut, best last: inside a pre-token, between words, after a sentence, a line, a paragraph.
HARD, WORD, SENTENCE, LINE, PARAGRAPH = -1, 0, 1, 2, 3
#: Pre-tokens of more ids than this also offer cuts inside them.
INNER_IDS = 16
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def cuts(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, encoder: bpe.Encoder, inner_ids: int = INNER_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Possible cuts of one text: byte offsets, ids before each (prefix sums) and kinds, all sorted by offset."""
    ends = np.append(starts[1:], data.size)
    blank = BLANK[data[ends - 1]]
    lines = np.cumsum(data == 10)
    newlines = np.where(blank, lines[ends - 1] - np.where(starts > 0, lines[starts - 1], 0), 0)
    run = newlines.copy()
    run[1:] += np.where(blank[1:] & blank[:-1], newlines[:-1], 0)
    tail3 = data[np.maximum(ends - 3, 0)]
    stop = STOP[data[ends - 1]] | ((tail3 == 0xE3) & (data[np.maximum(ends - 2, 0)] == 0x80) & (data[ends - 1] == 0x82))
    wide = stop & (data[ends - 1] == 0x82)
    after = stop.copy()
    after[1:] |= blank[1:] & stop[:-1]
    follows = np.append(BLANK[data[starts[1:]]], True)
    kind = np.where(run >= 2, PARAGRAPH, np.where(run == 1, LINE, np.where(wide | after & (follows | blank), SENTENCE, WORD)))
    where, before, kinds = np.append(0, ends), np.append(0, np.cumsum(counts, dtype=np.int64)), np.append(PARAGRAPH, kind)
    big = np.flatnonzero(counts > inner_ids)
    if big.size:
        more_where, more_before = [], []
        for k in big.tolist():
            piece = data[starts[k] : ends[k]].tobytes()
            size = np.array([len(encoder.token_bytes[i]) for i in encoder.lookup(piece)])
            inner = np.cumsum(size)[:-1]
            safe = (data[starts[k] + inner] & 0xC0) != 0x80  # never inside a character
            more_where.append(starts[k] + inner[safe])
            more_before.append(before[k] + 1 + np.flatnonzero(safe))
        where = np.concatenate([where, *more_where])
        before = np.concatenate([before, *more_before])
        kinds = np.concatenate([kinds, np.full(where.size - kinds.size, HARD)])
        order = np.argsort(where, kind="stable")
        where, before, kinds = where[order], before[order], kinds[order]
    return where, before, kinds


def pieces(before: np.ndarray, kinds: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Index pairs of cuts: each piece has at most limit ids and starts with up to overlap ids of the one before."""
    out, start, done, last = [], 0, 0, before.size - 1
    natural = np.flatnonzero(kinds >= WORD)
    while True:
        base = before[start]
        high = int(np.searchsorted(before, base + limit, "right")) - 1
        if high >= last:
            out.append((start, last))
            return out
        if high <= done and start < done:
            start = done  # nothing new fits behind the overlap
            continue
        cut = max(high, start + 1)  # without a boundary within the limit: a hard cut
        for least in (base + limit // 2, base + overlap + 1):
            low = max(int(np.searchsorted(before, least, "left")), done + 1)
            if low <= high and (best := int((window := kinds[low : high + 1]).max())) > HARD:
                cut = low + int(np.flatnonzero(window == best)[-1])
                break
        out.append((start, cut))
        target = before[cut] - min(overlap, before[cut] - base - 1)
        first = int(np.searchsorted(before, target, "left"))
        k = int(np.searchsorted(natural, first, "left"))
        again = int(natural[k]) if k < natural.size else cut
        start, done = min(max(again if again < cut else first, start + 1), cut), cut


def split_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, overlap: int = 64, vocabulary_path: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """Pieces of the texts of more than limit tokens.

    Result: (id_col, piece int, start_byte bigint, end_byte bigint, n_tokens int, overlap_tokens int[, text string]).
    Offsets are into the UTF-8 text. A piece ends at the last paragraph end of the second half of its window, else at
    the last line, sentence or word end, and only without any of these inside a word (never inside a character). It starts
    with up to overlap of the last tokens of the piece before: at the first word boundary among them, or exactly overlap
    tokens back in unbroken text. Every piece is encoded again and has at most limit tokens on its own.

    One narrow pass without a shuffle; texts of at most limit bytes are dropped in the scan, as a token has a byte or
    more. Null, empty and short texts give no row; repeated rows are split each; an empty table gives no rows; further
    columns of df are not read. limit must be at least 8 and at least twice overlap.
    """
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be at least 8, and overlap between 0 and half of it")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kept = df.select(df[id_col], df[text_col].alias("__text")).filter(F.octet_length("__text") > limit)
    id_type = kept.schema[0].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("overlap_tokens", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(vocabulary_path, shared.value)
        for batch in batches:
            names = batch.column(0)
            for row, _, data, bounds in bpe.chunks(batch.column(1)):
                found = encoder.encode(data, bounds, with_ids=False)
                total = np.append(0, np.cumsum(found.counts, dtype=np.int64))[found.text_first]
                plans = {}
                for k in np.flatnonzero(np.diff(total) > limit).tolist():
                    own = slice(found.text_first[k], found.text_first[k + 1])
                    text = data[bounds[k] : bounds[k + 1]]
                    plans[k] = (text, *cuts(text, found.starts[own] - bounds[k], found.counts[own], encoder, min(INNER_IDS, limit // 4)))
                yield from split_chunk(plans, names, row, encoder)

    def split_chunk(plans: dict, names: pa.Array, row: int, encoder: bpe.Encoder) -> Iterator[pa.RecordBatch]:
        done, todo = {}, dict.fromkeys(plans, limit)
        while todo:
            spans = {k: pieces(plans[k][2], plans[k][3], cap, min(overlap, cap // 2)) for k, cap in todo.items()}
            parts = [plans[k][0][plans[k][1][a] : plans[k][1][b]] for k, own in spans.items() for a, b in own]
            again = encoder.encode(np.concatenate(parts), np.cumsum([0, *(p.size for p in parts)]), with_ids=False)
            size = np.diff(np.append(0, np.cumsum(again.counts, dtype=np.int64))[again.text_first])
            at = 0
            for k, own in spans.items():
                sizes = size[at : at + len(own)]
                at += len(own)
                if (worst := int(sizes.max())) > limit:  # Ids can differ where white space meets a cut.
                    todo[k] -= worst - limit
                else:
                    done[k] = (own, sizes)
                    del todo[k]
        if not done:
            return
        index, number, start, end, tokens, shared_tokens, texts = [], [], [], [], [], [], []
        for k, (own, sizes) in done.items():
            text, where, before, _ = plans[k]
            stop = 0
            for j, (a, b) in enumerate(own):
                index.append(row + k)
                number.append(j)
                start.append(int(where[a]))
                end.append(int(where[b]))
                tokens.append(int(sizes[j]))
                shared_tokens.append(int(before[stop] - before[a]) if j else 0)
                stop = b
                if with_text:
                    texts.append(text[where[a] : where[b]].tobytes())
        columns = [names.take(pa.array(index, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(tokens, pa.int32()), pa.array(shared_tokens, pa.int32())]
        if with_text:
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
        yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))
