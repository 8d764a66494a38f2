"""Byte-level BPE encoding and decoding with a segment tree.

A segment tree over a piece's byte positions holds, at each leaf, the rank of the pair that begins there
and its position as one number; the root is then the leftmost minimum rank. A merge joins a live token
with its live right neighbour and updates at most three leaves, each in logarithmic time, so a piece of n
bytes takes O(n log n) even without a single space in it.

Defined cases: a null or empty text has no ids and decodes to nothing; special strings are ordinary text;
repeated rows and null ids pass through.
"""

from __future__ import annotations

import base64
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import Recent, id_and_text, kept, lists, map_batches, table

#: Pieces of a generation in a worker's cache, and the longest piece (characters) that is kept there.
CACHE_PIECES, CACHE_PIECE_CHARS = 350_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ranks_and_tokens(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


def tokens_and_cache(path: str) -> tuple[list[bytes], Recent]:
    ranks, tokens = ranks_and_tokens(path)
    return tokens, Recent(lambda piece: tuple(encode_piece(piece.encode(), ranks)), CACHE_PIECES, CACHE_PIECE_CHARS)


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * size + size
    rank_of = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the live token that begins at a position
    while (least := tree[1]) < none:
        i = least & (size - 1)
        j = end[i]
        stop = end[i] = end[j]
        points = [(j, none)]
        if stop < n:
            before[stop] = i
            rank = rank_of(piece[i : end[stop]])
            points.append((i, none if rank is None else rank * size + i))
        else:
            points.append((i, none))
        if i:
            h = before[i]
            rank = rank_of(piece[h:stop])
            points.append((h, none if rank is None else rank * size + h))
        for at, value in points:
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with decode also decoded (binary), the bytes that the ids stand for."""

    def setup():
        import numpy as np
        import regex

        find = regex.compile(pattern).findall
        tokens, pieces = kept(("pieces", ranks_path), lambda: tokens_and_cache(ranks_path))
        ids_of = pieces.__getitem__

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = list(chain.from_iterable(map(ids_of, find(text))))
                flat.append(np.array(ids, dtype=np.int32))
                counts.append(len(ids))
                if decode:
                    decoded.append(b"".join(map(tokens.__getitem__, ids)))
            columns = [batch.column(0), lists(np.concatenate(flat), counts, pa.int32())] + [pa.array(decoded, type=pa.binary())] * decode
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

        return step

    return map_batches(id_and_text(docs, id_col, text_col), setup, "doc_id long, ids array<int>" + ", decoded binary" * decode)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded's doc_id and the bytes of its ids (null: none), in the column decoded."""

    def setup():
        tokens = ranks_and_tokens(ranks_path)[1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()], type=pa.binary())], names=["doc_id", "decoded"])

        return step

    return map_batches(encoded.select("doc_id", "ids"), setup, "doc_id long, decoded binary")


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
