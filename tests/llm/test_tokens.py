import random
from pathlib import Path

import pyarrow as pa
import pytest

from graphloom.llm import bpe
from graphloom.llm.split import split_texts
from graphloom.llm.tokenize import VOCABULARY, encode_corpus, vocabulary

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def public():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "Bc", "'", "s", "re", "'ll", "'ve", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "1", "\u00b2", "\u00e9", "e\u0301", "\u5b57", "!", "\u2026", "\U0001f469\u200d\U0001f4bb", "\u200b", "'t", "don't", "\r\n", "\x1c", "\x85", "<|endoftext|>", "\u0627", "getHTTPResponse"]


def texts(n=3000, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(n)] + [None, "", " ", "'", "'s", "a" * 9000, "\u00e9" * 5000, " " * 3000, "\n" * 999 + "x", "x" + "'re" * 500]


def test_perfect_hash_is_minimal():
    v = vocabulary(VOCABULARY)
    pairs = {v.blob[a:b]: r for a, b, r in zip(v.slot_start, v.slot_start[1:], v.slot_id)}
    assert len(pairs) == len(v.slot_id) == 50_256 and all(v.rank(t) == r for t, r in pairs.items())
    assert v.rank(b"\xff\xfe no such") == -1 and v.rank(b"") == -1


def test_same_ids_as_the_public_tokenizer(public):
    own, encoder = texts(), bpe.Encoder(vocabulary(VOCABULARY))
    for row, rows, data, bounds in bpe.chunks(pa.array(own)):
        found = encoder.encode(data, bounds)
        at = [int(x) for x in [0, *found.counts.cumsum()]]
        for k in range(rows):
            ids = found.ids[at[found.text_first[k]] : at[found.text_first[k + 1]]].tolist()
            assert ids == public.encode_ordinary(own[row + k] or ""), own[row + k]


def test_small_chunks_and_memo(public, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 50)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    test_same_ids_as_the_public_tokenizer(public)


def test_corpus(spark, public):
    rows = [(k, t, [k]) for k, t in enumerate(texts(300))] + [(1, "again", [0]), (None, "no id", [0])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = encode_corpus(df.repartition(3)).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.ids) for r in got) == sorted(((d if d is not None else -1), public.encode_ordinary(t or "")) for d, t, _ in rows)
    assert encode_corpus(df.limit(0)).count() == 0 and [f.dataType.simpleString() for f in encode_corpus(df).schema] == ["bigint", "array<int>"]


def sample():
    r = random.Random(5)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "queue", "snapshotStore", "x1"]) for _ in range(n))
    paragraphs = "\n\n".join(". ".join(words(r.randrange(5, 30)) for _ in range(6)) + "." for _ in range(60))
    return {1: paragraphs, 2: "a" * 30_000, 3: "\u5b57" * 6_000, 4: words(3000), 5: "short", 6: None, 7: "", 8: "x y\n" * 2000, 9: "\U0001f469\u200d\U0001f4bb" * 2000, 10: " " * 5000 + "z" * 50, 11: "\n\n" * 3000, 12: "k" * 1023}


@pytest.mark.parametrize("limit,overlap", [(1024, 64), (100, 10), (16, 8), (8, 0), (9, 4)])
def test_pieces(spark, public, limit, overlap):
    own = sample()
    df = spark.createDataFrame([(k, t, 0) for k, t in own.items()], "doc_id long, text string, piece int")
    rows = sorted(split_texts(df, limit=limit, overlap=overlap).collect(), key=lambda r: (r.doc_id, r.piece))
    by = {k: [r for r in rows if r.doc_id == k] for k in own}
    assert {k for k in own if by[k]} == {k for k, t in own.items() if t and len(public.encode_ordinary(t)) > limit}
    for k, parts in by.items():
        raw = (own[k] or "").encode()
        if not parts:
            continue
        assert parts[0].start_byte == 0 and parts[-1].end_byte == len(raw) and parts[0].overlap_tokens == 0
        for r in parts:
            assert raw[r.start_byte : r.end_byte].decode() == r.text
            assert r.n_tokens == len(public.encode_ordinary(r.text)) <= limit
        for a, b in zip(parts, parts[1:]):
            assert a.start_byte < b.start_byte <= a.end_byte < b.end_byte
            assert 0 <= b.overlap_tokens <= overlap
    if (limit, overlap) == (1024, 64):
        assert all(r.text.endswith("\n\n") for r in by[1][:-1]) and all(r.text.endswith("\n") for r in by[8][:-1])
        assert {r.overlap_tokens for r in by[2][1:]} == {64} and min(r.overlap_tokens for r in by[4][1:]) > 50
        short = split_texts(df, with_text=False)
        assert "text" not in short.columns and short.count() == len(rows)
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, limit=10, overlap=6)
