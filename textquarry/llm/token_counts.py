"""Token counts of whole texts, huge documents by overlap resynchronisation.

A document of at most CHUNK characters is encoded whole, its words through a bounded cache (no token spans
white space). A longer one is encoded in overlapping chunks with
offsets. Two neighbours are spliced at a position in their overlap where both begin a token and that
follows white space: this vocabulary drops white space and no token, pair of characters to be composed or
special string spans it, so the two encodings go on alike from there; the tokens of both that follow in the
overlap are compared as a proof. Where the overlap has no such position (one word longer than it), or the
tokens differ, the overlap is doubled until it has one or the rest of the text is one chunk.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows are counted each; null ids stay.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import id_and_text, kept, map_batches, table
from textquarry.llm.packing import WordIds

CHUNK, OVERLAP, LIMIT = 16_384, 512, 2048
#: White space that the vocabulary's own patterns drop.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def splice(left: tuple[list, list], right: tuple[list, list], text: str, begin: int, end: int) -> int | None:
    """left, right: (ids, spans) of two chunks that share text[begin:end]. The first common boundary there: both begin a token at it, it follows white space, and from it to the last white space of the overlap both have the same tokens. None if there is none."""
    stop = end
    while stop > begin and text[stop - 1] not in SPACES:
        stop -= 1
    (left_ids, left_spans), (right_ids, right_spans) = left, right
    first = {}
    for k in range(bisect_left(right_spans, (begin, -1)), until_right := bisect_left(right_spans, (stop, -1))):
        first.setdefault(right_spans[k][0], k)
    until = bisect_left(left_spans, (stop, -1))
    for i in range(bisect_left(left_spans, (begin, -1)), until):
        start = left_spans[i][0]
        if start > begin and text[start - 1] in SPACES and (j := first.get(start)) is not None:
            return start if left_spans[i:until] == right_spans[j:until_right] and left_ids[i:until] == right_ids[j:until_right] else None
    return None


def count_tokens(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of text, chunk by chunk; encode: text -> (ids, offsets)."""

    def part(begin: int, end: int) -> tuple[list, list]:
        ids, spans = encode(text[begin:end])
        return ids, [(a + begin, b + begin) for a, b in spans]

    total, begin, end = 0, 0, min(len(text), chunk)
    now = part(begin, end)
    while end < len(text):
        wide = overlap
        while (start := end - wide) > begin:
            stop = min(len(text), end + chunk)
            after = part(start, stop)
            at = splice(now, after, text, start, end)
            if at is not None:
                keep = bisect_left(after[1], (at, -1))
                total += bisect_left(now[1], (at, -1))
                now, begin, end = (after[0][keep:], after[1][keep:]), at, stop
                break
            wide *= 2
        else:  # the overlap is as wide as the chunk: the chunk itself grows
            end = min(len(text), begin + 2 * max(chunk, end - begin))
            now = part(begin, end)
    return total + len(now[1])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per document."""

    def setup():
        words = kept(("words", vocabulary), lambda: WordIds(vocabulary))
        tokenizer = words.tokenizer

        def whole(text: str):
            e = tokenizer.encode(text, add_special_tokens=False)
            return e.ids, e.offsets

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = iter(words.encode([words.words(t.encode()) for t in texts if len(t) <= chunk]))
            n = [len(next(counts)) // 4 if len(t) <= chunk else count_tokens(t, whole, chunk, overlap) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, type=pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_batches(rows, setup, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
