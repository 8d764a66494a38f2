"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic function of a bias and the weights
of its words, a word's weight the sum of the weights of those of its character n-grams (hashed) that a
chi-squared test finds telling; a document's score
is the noisy-or of its STRONGEST sentences that differ. Without that bound the small probabilities of calm sentences
would add up with the length of a text, and any long text would be toxic; a sentence said again is no new evidence.
Only document labels are needed: the gradient of the noisy-or hands a
toxic label to the sentences that explain it, and those are then located.

The model is fitted on a bounded sample of labelled rows (MAX_TOXIC, MAX_CLEAN, MAX_CHARS) that is picked
by a hash of the id, and on UNIONS of clean ones, so that it meets bags of many sizes (a bag of calm bags is calm). Every text is scored whole.

Defined cases: a null or empty text, or one of white space, has no sentence and scores 0; a null doc_id counts as the empty id for
the split and takes no label; of several labels of one id the largest counts, null labels none; without
labels of both kinds the weights stay at their start and every score is near 0; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import Recent, crc_mod, id_and_text, kept, map_batches, table

#: Bounds of the training sample: documents of each label, characters of one.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1200, 2400, 50_000
FEATURES, START_BIAS, EPOCHS, STEP, DECAY = 1 << 18, -5.0, 60, 0.15, 1e-6
#: Sentences of a document that its score joins; bags that are unions of clean documents, and documents of one.
STRONGEST, UNIONS, UNION = 5, 200, 12
THRESHOLD = 0.7
#: One feature in ten thousand passes by chance.
CHI2 = 15.14
SENTENCE = re.compile(r"[^.!?\n]+")
CACHE_WORDS, CACHE_CHARS = 120_000, 64
EDGES = "\"'()[]{}<>,;:*_|#-+=~`/\\"


def grams(word: str) -> set[str]:
    """A word's features: itself, its beginnings of 3 to 6 characters and its inner 4-grams. A word of more than CACHE_CHARS characters is taken in blocks of so many."""
    word = word.strip(EDGES).lower()
    if len(word) > CACHE_CHARS:
        return set().union(*(grams(word[i : i + CACHE_CHARS]) for i in range(0, len(word), CACHE_CHARS)))
    return ({f"={word}"} | {f"^{word[:k]}" for k in range(3, 1 + min(6, len(word)))} | {word[i : i + 4] for i in range(len(word) - 3)}) if word else set()


def hashed(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % FEATURES


class Model:
    """A bias and the weights of the telling n-grams."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.name = weights, bias, uuid.uuid4().hex

    def scorer(self):
        """text -> (score, [(begin, end, sentence score)]); the process keeps it from task to task, with the weights of words in a bounded cache."""
        return kept(("toxicity", self.name), self.make_scorer)

    def make_scorer(self):
        weights, bias = self.weights, self.bias

        def weight_of(word: str) -> float:
            return sum(weights.get(g, 0.0) for g in grams(word))

        weight = Recent(weight_of, CACHE_WORDS, CACHE_CHARS).__getitem__

        def score(text: str):
            known, found = {}, []
            for m in SENTENCE.finditer(text):
                sentence = m.group().strip()
                if not sentence:
                    continue
                if (z := known.get(sentence)) is None:
                    z = known[sentence] = bias + sum(map(weight, sentence.split()))
                if z > 0:
                    found.append((m.start(), m.end(), 1 / (1 + math.exp(-min(z, 700.0)))))
            total = sum(z if z > 30 else math.log1p(math.exp(z)) for z in nlargest(STRONGEST, known.values()))
            return -math.expm1(-total), found

        return score


def telling(doc: np.ndarray, word: np.ndarray, of_word: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features tell toxic documents from clean ones: chi-squared of the documents that have them, CHI2 at least. doc and word: of each token; of_word and feature: each word's features."""
    edges = np.searchsorted(of_word, np.arange(of_word[-1] + 2 if len(of_word) else 1))
    a, have = np.zeros(FEATURES), np.zeros(FEATURES)
    ends = np.searchsorted(doc, np.arange(len(y) + 1))
    for d, label in enumerate(y):
        words = [feature[edges[w] : edges[w + 1]] for w in np.unique(word[ends[d] : ends[d + 1]]) if w + 1 < len(edges)]
        if words:
            seen = np.unique(np.concatenate(words))
            have[seen] += 1
            a[seen] += label
    n, toxic = len(y), y.sum()
    b, c = have - a, toxic - a
    d = n - toxic - b
    return n * np.maximum(np.abs(a * d - b * c) - n / 2, 0) ** 2 / np.maximum(1.0 * have * (n - have) * toxic * (n - toxic), 1) >= CHI2


def bags_of(texts: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The words of all different sentences of each text, numbered by index (which grows), one after another; how many words each sentence has; and each text's bag of sentence numbers."""
    words, lengths, bags = array("i"), array("i"), []
    for text in texts:
        begin = len(lengths)
        for sentence in dict.fromkeys(x for m in SENTENCE.finditer(text) if (x := m.group().strip())):
            own = [index.setdefault(w, len(index)) for w in sentence.split()]
            words.extend(own)
            lengths.append(len(own))
        bags.append(list(range(begin, len(lengths))))
    return np.array(words, dtype=np.int32), np.array(lengths, dtype=np.int32), bags


def strongest(z: np.ndarray, bag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of the STRONGEST members of each bag. bag: the bag of each member, ascending; first: where each bag begins."""
    order = np.lexsort((-z, bag))
    return order[np.arange(len(z)) - first[bag[order]] < STRONGEST]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, unions: int = UNIONS) -> Model:
    """Noisy-or likelihood by full-batch Adam; words are looked up once, sentences are sparse rows of words, bags are rows of sentences."""
    index: dict[str, int] = {}
    word_of, lengths, bags = bags_of(texts, index)
    sentences, bias, weights = len(lengths), START_BIAS, np.zeros(FEATURES)
    if not sentences or len(set(labels)) < 2:
        return Model({}, bias)
    sentence_of = np.repeat(np.arange(sentences, dtype=np.int32), lengths)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(b) for b in bags])
    of_word, feature = array("i"), array("i")
    for w, k in index.items():
        fs = sorted(map(hashed, grams(w)))
        of_word.extend([k] * len(fs))
        feature.extend(fs)
    of_word, feature = np.array(of_word, dtype=np.int32), np.array(feature, dtype=np.int32)
    told = telling(doc_of[sentence_of], word_of, of_word, feature, np.array(labels))[feature]
    of_word, feature = of_word[told], feature[told]
    rng, clean = np.random.default_rng(8), np.flatnonzero(np.array(labels) == 0)
    joined = [np.unique(rng.choice(clean, int(rng.integers(2, UNION + 1)))) for _ in range(unions)]
    bags += [[k for d in group for k in bags[d]] for group in joined]
    y = np.array(list(labels) + [0] * len(joined))
    sizes = np.array([len(b) for b in bags])
    n, member, bag, first = len(bags), np.array([k for b in bags for k in b], dtype=np.int32), np.repeat(np.arange(len(bags)), sizes), np.cumsum(sizes) - sizes
    m1, m2, b1, b2 = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for t in range(1, epochs + 1):
        by_word = np.bincount(of_word, weights[feature], len(index))
        z = np.clip(bias + np.bincount(sentence_of, by_word[word_of], sentences), -30, 30)
        top = strongest(z[member], bag, first)
        of, z = bag[top], z[member[top]]
        p, s = 1 / (1 + np.exp(-z)), np.bincount(of, np.logaddexp(0, z), n)
        by_bag = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-6), 1.0) / n
        slope = p * by_bag[of]
        of_sentence = np.bincount(member[top], slope, sentences)
        g = np.bincount(feature, np.bincount(word_of, of_sentence[sentence_of], len(index))[of_word], FEATURES) + DECAY * weights
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        gb = slope.sum()
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        weights -= STEP * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-7)
        bias -= STEP * (b1 / c1) / (math.sqrt(b2 / c2) + 1e-7)
    return Model({g: float(w) for word in index for g in sorted(grams(word)) if abs(w := weights[hashed(g)]) > 1e-4}, float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, training: Column, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> list:
    """Rows (text, toxic) of at most max_toxic and max_clean documents of at most max_chars characters; training: which rows of labels may be used. A label takes a place only if its document is there and short enough. The ids, bounded by the two numbers, are broadcast to the scan."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.filter(training & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = id_and_text(docs).filter(F.char_length("text") <= max_chars)
    labels = labels.join(short.select("doc_id").distinct(), "doc_id")
    first = lambda kind, n: labels.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = first(1, max_toxic).unionByName(first(0, max_clean))
    return sorted(short.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").limit(2 * (max_toxic + max_clean)).collect())


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    rows = training_sample(docs, labels, training)
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, and the offending sentences as spans array<struct<begin,end,score>> (code points, end exclusive), one row per document."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def setup():
        of = broadcast.value.scorer()
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, spans = zip(*map(of, batch.column(1).to_pylist()), strict=True)
            spans = [[dict(zip(("begin", "end", "score"), s, strict=True)) for s in x] for x in spans]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64()), pa.array(spans, type=span)], names=["doc_id", "score", "spans"])

        return step

    out = map_batches(id_and_text(docs, id_col, text_col), setup, "doc_id long, score double, spans array<struct<begin:int,end:int,score:double>>")
    return out.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; nothing moves."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def setup():
        of = shared.value.scorer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([of(t or "")[0] < threshold for t in batch.column(at).to_pylist()]))

        return step

    return map_batches(docs, setup, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", F.size("spans").alias("n_offending"))
