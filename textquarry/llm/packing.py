"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of binary length: as many of the longest (4096) as fit, then the
binary digits of the rest, longest first. Each piece is a sequence of its own; sequences of equal length
form a bucket, so batches need no padding and no sequence crosses documents.

Token ids come from the tokenizers library. The vocabulary's white space is dropped and no token spans it,
so a document's ids are those of its words one after another; a bounded cache keeps the ids of words
that were seen, and words that were not are encoded together.

Defined cases: a null or empty text has the end id alone, one piece of length 1; a null doc_id stays null;
repeated rows are packed each on their own; an empty table gives no pieces.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import id_and_text, kept, map_batches, table

END_ID = 2
LONGEST = 4096
#: Words of a generation in a worker's cache, and the longest word (bytes) that is kept there.
CACHE_WORDS, CACHE_WORD_BYTES = 500_000, 64


class WordIds:
    """Ids of words as little-endian unsigned 32-bit bytes. Words that were not seen lately are encoded together; two generations of CACHE_WORDS bound the memory.

    New words are encoded as one text with a mark between them, whose id only words with an exclamation mark
    can have; those are encoded each. The vocabulary parts letters from other characters, so letters with one
    stop at their end are the letters' ids and the stop's.
    """

    MARK, STOPS, TOGETHER = "!", ".,;:?", 512

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.now, self.old = Tokenizer.from_file(vocabulary), {}, {}
        self.mark = self.each([self.MARK])[0]
        self.stop = dict(zip(self.STOPS.encode(), self.each(list(self.STOPS)), strict=True))

    def each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Of words without the mark."""
        if len(self.mark) != 4:
            return self.each(words)
        out = []
        for i in range(0, len(words), self.TOGETHER):
            text = f" {self.MARK} ".join(words[i : i + self.TOGETHER])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = (4 * np.flatnonzero(ids == int.from_bytes(self.mark, "little"))).tolist()
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip([0, *(k + 4 for k in at)], [*at, len(data)], strict=True)]
        return out

    def add(self, words: list[bytes]) -> None:
        """Puts words that are in neither generation into the new one."""
        now, old, stop = self.now, self.old, self.stop
        ended = [w for w in words if w[-1] in stop and w[:-1].decode().lower().isalpha()]
        rest = set(words).difference(ended)
        marked = [w for w in rest if b"!" in w]
        rest.difference_update(marked)
        for w in ended:
            stem = w[:-1]
            if stem not in now:
                if stem in old:
                    now[stem] = old[stem]
                else:
                    rest.add(stem)
        new = list(rest)
        if new:
            now.update(zip(new, self.together([w.decode() for w in new]), strict=True))
        if marked:
            now.update(zip(marked, self.each([w.decode() for w in marked]), strict=True))
        for w in ended:
            now[w] = now[w[:-1]] + self.stop[w[-1]]

    @staticmethod
    def words(data: bytes) -> list[bytes]:
        """The words of a text in UTF-8. ASCII capitals are lowered as the vocabulary lowers them, unless a special string might arise from that."""
        return data.split() if b"<|" in data else data.lower().split()

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Of each list of words, the ids one after another."""
        if len(self.now) > CACHE_WORDS:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        found, open_, missing = [], [], set()
        for words in texts:
            ids = list(map(now.get, words))
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                missing.update([words[k] for k in gaps])
                open_.append((words, ids, gaps))
            found.append(ids)
        new = [w for w in missing if w not in old]
        now.update((w, old[w]) for w in missing.difference(new))
        self.add(new)
        for words, ids, gaps in open_:
            for k in gaps:
                ids[k] = now[words[k]]
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                now.pop(w, None)
        return [b"".join(ids) for ids in found]


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two, none above longest (itself one), longest first."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if n % longest >> k & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket (log2 of the length).

    sequence_id has the bucket in its high bits, then the partition, then a running number of this bucket in the partition: unique without a shuffle, and a bucket's sequences form one range.
    """

    def setup():
        words, end, part = kept(("words", vocabulary), lambda: WordIds(vocabulary)), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        used: dict[int, int] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(list(map(words.words, batch.column(1).to_pylist()))), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                for length in cuts(n, longest):
                    bucket = length.bit_length() - 1
                    used[bucket] = number = used.get(bucket, -1) + 1
                    for column, value in zip(out, (doc, start, length, ids[4 * start : 4 * (start + length)], n, bucket << 57 | part << 36 | number, bucket), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "bucket"])

        return step

    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary"))
    packed = map_batches(texts, setup, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, bucket int")
    return packed.withColumn("offset", F.lit(0).cast("long"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


