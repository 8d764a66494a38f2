"""Packing, byte-level BPE and token counts, against the libraries."""

import hashlib
import random
import zlib
from array import array

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from textquarry.llm import byte_bpe, packing, token_counts
from textquarry.llm.common import table

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "the", "é", "é", "ß", "İ", "Σ", "'s", "don't", "1234", "!!", "<|endoftext|>", "<|startoftext|>", " ", "\x1c", "　", "漢字", "🙂", "x" * 50, "́", "İ,", "word.", "!", "<|ENDOFTEXT|>", "WORD"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def texts(seed, n=120, most=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_word_cache_equals_the_library(tokenizer):
    words = packing.WordIds(WORDS)
    for seed in range(3):
        some = texts(seed)
        assert words.encode([words.words(t.encode()) for t in some]) == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in some]


def test_cuts_are_powers_of_two():
    for n in (1, 2, 3, 4095, 4096, 4097, 10_000, 12_288):
        lengths = packing.cuts(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 4096 for x in lengths) and lengths == sorted(lengths, reverse=True)


def test_packing_whole_texts(spark, sf, tokenizer):
    rows = packing.op1_packing(spark, sf).collect()
    documents = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(documents)
    for doc, text in documents.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(of[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset, 1 << r.bucket) == (at, len(ids), 0, r.length)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd, WORDS).collect()
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2, 3)] == [(1, 1)] * 3
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert packing.pack(empty, WORDS).count() == 0


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTES), special_tokens={})


def test_segment_tree_equals_the_library(library):
    ranks, rng = byte_bpe.read_ranks(BYTES), random.Random(1)
    for piece in [bytes(rng.choice([97, 98, 195, 169, 32, 10, 255]) for _ in range(rng.randint(1, 60))) for _ in range(400)] + [b"a" * 5000, b"ab" * 3000]:
        assert byte_bpe.encode_piece(piece, ranks) == library._encode_single_piece(piece)


def test_byte_bpe_query(spark, sf, library):
    documents = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in byte_bpe.op7_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_byte_bpe_round_trip_of_odd_rows(odd, empty, library):
    encoded = byte_bpe.encode(odd, BYTES, P.PATTERN)
    back = sorted(((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded, BYTES).collect()), key=str)
    assert back == sorted(((r.doc_id, (r.text or "").encode()) for r in odd.collect()), key=str)
    assert byte_bpe.encode(empty, BYTES, P.PATTERN, decode=True).count() == 0


def test_resynchronised_counts(tokenizer):
    def encode(t):
        e = tokenizer.encode(t, add_special_tokens=False)
        return e.ids, e.offsets

    for t in texts(7, 300, 300):
        for chunk, overlap in ((8, 2), (64, 8), (300, 32)):
            assert token_counts.count_tokens(t, encode, chunk, overlap) == len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_counts(spark, sf, odd, empty, tokenizer):
    for df, counted in ((table(spark, sf, "documents"), token_counts.op10_token_counts(spark, sf)), (odd, token_counts.token_counts(odd, WORDS, chunk=5000))):
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()), key=str)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in counted.collect()), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in counted.collect())
    assert token_counts.token_counts(empty, WORDS).count() == 0
