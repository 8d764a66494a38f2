"""Language-model scores: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Words of all training texts are counted in Spark. The OWN most frequent words are predicted themselves, in two levels: a class,
then the word in its class. Classes are GROUPS sets of words that have like neighbours in a sample, cut along principal axes to
equal sizes; the end of a text is a class of its own, and other words fall into TAILS classes by their last bytes. From the ORDER
tokens before, h = sum of c_i * R[token_i]; a class has h . Q[class] + b, a word in its class h . U[word] + d. Both levels are
trained against noise (classes by their frequency, words by that in their class). Scores are normalised: matrix products of
blocks of tokens with all classes, and of a class's tokens with all its words, give softmax log-probabilities; a word of a tail
class has the share (c + 1) / (N + V + 1) of that class, with one place for words that were never seen.

Training starts on the driver from a bounded sample (SAMPLE_DOCS, SAMPLE_TOKENS) and goes on over every position of all training
texts: the texts are dealt into shards by a hash of the id, as many as their positions need, each shard goes on from the
start in the order of ids, and the shards' models are averaged by their numbers of positions. So the result depends on
neither partitions nor executors (but for the rounding of sums). The TOP most frequent words (each of TOP_BYTES at most) are broadcast, a bound of
16 MB; counts of all others are joined by word.

Defined cases: a null or empty text is the end alone; a null doc_id counts as the empty id for the split; without
training texts every count is 0 and the model uniform; repeated rows are scored each; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import bounded_batches, crc_mod, id_and_text, lists, map_batches, table, written

OWN, GROUPS, TAILS, ORDER, WIDTH = 6144, 96, 31, 5, 16
TOP, TOP_BYTES = 1 << 18, 64
#: Noise classes of a batch, noise words of each class in a batch, rows of a batch, step.
NOISE, NOISE_WORDS, BATCH, RATE = 32, 16, 8192, 0.1
#: Neighbouring positions that are trained together; batches are made of such stretches, shuffled.
STRETCH = 128
SAMPLE_DOCS, SAMPLE_TOKENS, SAMPLE_EPOCHS, SAMPLE_BATCH = 1000, 8000, 3, 1024
#: Neighbours by which words are put into classes: this many of the most frequent words, before and after.
NEIGHBOURS = 64
#: Positions of a shard, and of the pieces that it is trained in.
SHARD_POSITIONS, PIECE = 4_000_000, 1 << 18
#: Words that a counting task holds before it sends its counts on.
HELD_WORDS = 300_000
#: Tokens that are scored at once, and rows of a softmax over the classes.
BLOCK, ROWS = 16_384, 2048


def words_of(text: str) -> list[bytes]:
    """Words parted by ASCII white space, ASCII capitals lowered."""
    return text.encode().lower().split()


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def count_words(docs: DataFrame) -> DataFrame:
    """word, c, tail: how often each word occurs in all texts (without ends). Tasks add up what they can hold, Spark adds the rest."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], type=pa.string()), pa.array([tail_of(w) for w in held], type=pa.int32()), pa.array(list(held.values()), type=pa.int64())], names=["word", "tail", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(1).to_pylist():
                held.update(words_of(text))
                if len(held) >= HELD_WORDS:
                    yield made()
        if held:
            yield made()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, tail int, c long").groupBy("word", "tail").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The TOP words with their counts, by falling count, and the tail classes' totals."""

    def __init__(self, words: list[str], counts: list[int], tails: list[list[int]], n_docs: int):
        """tails: total count and number of words of each tail class, own words included."""
        self.words, self.counts, self.n_docs = words, np.array(counts, dtype=np.int64), n_docs
        totals = np.array(tails, dtype=np.float64).reshape(TAILS, 2)
        self.n, self.v = int(totals[:, 0].sum()) + n_docs, int(totals[:, 1].sum()) + (n_docs > 0)
        self.own = min(OWN, len(words))
        for w, c in zip(words[: self.own], counts[: self.own], strict=True):
            totals[tail_of(w.encode())] -= c, 1
        self.share, self.tail_counts = np.log10(totals.sum(axis=1) + 1), totals[:, 0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def lookup(self):
        """words -> number among the TOP words, or -1 - tail; kept by the process."""
        if not hasattr(self, "_lookup"):

            class Numbers(dict):
                def __missing__(self, word):
                    return -1 - tail_of(word)

            self._lookup = Numbers((w.encode(), k) for k, w in enumerate(self.words)).__getitem__
            self._log = np.log10(self.counts + 1.0)
        return self._lookup


class Layout:
    """Places of tokens: own words class by class, the end, the tail classes. And the noise of both levels."""

    def __init__(self, vocabulary: Vocabulary, order: np.ndarray, sizes: np.ndarray):
        """order: numbers of the own words class by class; sizes: words of each class."""
        self.v, self.groups = len(order), len(sizes)
        self.edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.tail = np.array([tail_of(w.encode()) for w in vocabulary.words], dtype=np.int32) + self.v + 1
        self.tail[order] = np.arange(self.v)  # the place of each of the TOP words
        self.top = np.concatenate((np.repeat(np.arange(self.groups), sizes), self.groups + np.arange(1 + TAILS))).astype(np.int64)
        self.tops, self.places = self.groups + 1 + TAILS, self.v + 1 + TAILS
        counts = vocabulary.counts[order] + 1.0
        of_group = np.bincount(self.top[: self.v], counts, self.groups) if self.v else np.zeros(0)
        noise = np.concatenate((of_group, [vocabulary.n_docs + 1.0], vocabulary.tail_counts + 1))
        self.noise, self.word_noise = noise / noise.sum(), counts / of_group[self.top[: self.v]] if self.v else counts
        self.cdf, self.word_cdf = np.cumsum(self.noise), np.concatenate(([0], np.cumsum(self.word_noise)))

    def stream(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The places of rows of numbers one after another, each after ORDER ends and before one, and where its tokens are (its end included)."""
        lengths = np.array([len(r) for r in rows])
        numbers = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
        places = self.v - numbers  # -1 - tail becomes v + 1 + tail
        known = numbers >= 0
        places[known] = self.tail[numbers[known]]
        begins = np.cumsum(lengths + ORDER + 1) - (lengths + ORDER + 1) + ORDER
        out = np.full(int((lengths + ORDER + 1).sum()), self.v, dtype=np.int32)
        at = np.arange(len(numbers)) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
        out[at] = places
        spots = np.arange(int((lengths + 1).sum())) + np.repeat(begins - (np.cumsum(lengths + 1) - (lengths + 1)), lengths + 1)
        return out, spots

    def noise_words(self, rng, many: int) -> np.ndarray:
        """Words of each class drawn by their frequency in it."""
        low, high = self.word_cdf[self.edges[:-1]], self.word_cdf[self.edges[1:]]
        drawn = np.searchsorted(self.word_cdf, low[:, None] + rng.random((self.groups, many)) * (high - low)[:, None], side="right") - 1
        return np.clip(drawn, self.edges[:-1, None], self.edges[1:, None] - 1)


def like_neighbours(vocabulary: Vocabulary, rows: list[np.ndarray], groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the own words class by class, and the classes' sizes: halves along the first principal axis of the words' neighbours, halved again and again. rows: numbers of sample texts."""
    v, near = vocabulary.own, min(NEIGHBOURS, vocabulary.own)
    groups = min(groups, v)
    seen = np.zeros((v, 2 * near))
    for r in rows:
        for a, b, side in ((r[1:], r[:-1], 0), (r[:-1], r[1:], near)):
            pair = (a >= 0) & (a < v) & (b >= 0) & (b < near)
            np.add.at(seen, (a[pair], b[pair] + side), 1)
    shape = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    parts, sizes = [], []

    def halve(words: np.ndarray, many: int) -> None:
        if many == 1:
            parts.append(np.sort(words))
            return sizes.append(len(words))
        x = shape[words] - shape[words].mean(axis=0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        axis *= np.sign(axis[np.argmax(np.abs(axis))]) or 1
        ordered, left = words[np.argsort(np.round(x @ axis, 9), kind="stable")], many // 2
        cut = len(words) * left // many
        halve(ordered[:cut], left)
        halve(ordered[cut:], many - left)

    if v:
        halve(np.arange(v), groups)
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)), np.array(sizes, dtype=np.int64)


def by_place(places: np.ndarray, rows: np.ndarray, many: int) -> np.ndarray:
    """The sums of rows of WIDTH values by place."""
    at = places.astype(np.int64)[:, None] * WIDTH + np.arange(WIDTH)
    return np.bincount(at.ravel(), rows.ravel(), many * WIDTH).reshape(many, WIDTH).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """r: vectors of tokens before; c: weights of the places before; q, b: classes; u, d: words in their classes."""

    NAMES = ("r", "c", "q", "b", "u", "d")

    def __init__(self, layout: Layout, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.r, self.q, self.u = (rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32) for n in (layout.places, layout.tops, layout.v))
        self.c = (rng.normal(0, 0.1, (ORDER, WIDTH)) + 1 / ORDER).astype(np.float32)
        self.b, self.d = np.log(layout.noise).astype(np.float32), np.log(layout.word_noise).astype(np.float32)
        self.sums = [np.full_like(getattr(self, n), 1e-8) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float64)

    def load(self, values: np.ndarray) -> Model:
        at = 0
        for name in self.NAMES:
            x = getattr(self, name)
            setattr(self, name, values[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def copy(self) -> Model:
        out = object.__new__(Model)
        for name in self.NAMES:
            setattr(out, name, getattr(self, name).copy())
        out.sums = [x.copy() for x in self.sums]
        return out

    def hidden(self, vectors: np.ndarray) -> np.ndarray:
        """h of every position but the first ORDER. vectors: rows of r for positions one after another (the last axis but one)."""
        n = vectors.shape[-2] - ORDER
        h = vectors[..., ORDER - 1 : ORDER - 1 + n, :] * self.c[0]
        for k in range(1, ORDER):
            h += vectors[..., ORDER - 1 - k : ORDER - 1 - k + n, :] * self.c[k]
        return h

    def train(self, layout: Layout, stream: np.ndarray, spots: np.ndarray, rng, batch: int = BATCH) -> None:
        """One pass of noise-contrastive estimation with Adagrad over the spots, in shuffled stretches; the noise of a batch is shared by its rows, that of a class by the rows of that class."""
        expected, expected_words = np.log(NOISE * layout.noise).astype(np.float32), np.log(NOISE_WORDS * layout.word_noise).astype(np.float32)
        wanted = np.zeros(len(stream) + STRETCH, dtype=bool)
        wanted[spots] = True
        padded = np.concatenate((stream, np.full(STRETCH, layout.v, dtype=stream.dtype)))
        begins = rng.permutation(np.arange(ORDER, len(stream), STRETCH))
        for i in range(0, len(begins), max(1, batch // STRETCH)):
            first = begins[i : i + max(1, batch // STRETCH), None]
            x, used = padded[first + np.arange(-ORDER, STRETCH)], wanted[first + np.arange(STRETCH)]
            if not used.any():
                continue
            vectors = self.r[x]
            h, y = self.hidden(vectors)[used], x[:, ORDER:][used]
            t = layout.top[y]
            z = np.minimum(np.searchsorted(layout.cdf, rng.random(NOISE)), layout.tops - 1)
            of_t = self.q[t]
            data = sigmoid(expected[t] - np.einsum("bw,bw->b", h, of_t) - self.b[t])
            false = sigmoid(h @ self.q[z].T + (self.b[z] - expected[z]))
            back = data[:, None] * of_t - false @ self.q[z]
            gq = by_place(t, data[:, None] * h, layout.tops)
            np.add.at(gq, z, -(false.T @ h))
            gb = np.bincount(t, data, layout.tops).astype(np.float32)
            np.add.at(gb, z, -false.sum(axis=0))
            gu, gd = np.zeros_like(self.u), np.zeros_like(self.d)
            own = np.flatnonzero(y < layout.v)
            if len(own):
                own = own[np.argsort(t[own], kind="stable")]
                edges = np.searchsorted(t[own], np.arange(layout.groups + 1))
                word, ho = y[own], h[own]
                of_word = self.u[word]
                data = sigmoid(expected_words[word] - np.einsum("bw,bw->b", ho, of_word) - self.d[word])
                back_own = data[:, None] * of_word
                drawn = layout.noise_words(rng, NOISE_WORDS)
                u, d = self.u[drawn], self.d[drawn] - expected_words[drawn]
                gz, gzd = np.zeros_like(u), np.zeros_like(d)
                for k in np.flatnonzero(edges[1:] > edges[:-1]):
                    part = slice(edges[k], edges[k + 1])
                    false = sigmoid(ho[part] @ u[k].T + d[k])
                    back_own[part] -= false @ u[k]
                    gz[k], gzd[k] = false.T @ ho[part], false.sum(axis=0)
                back[own] += back_own
                gu = by_place(word, data[:, None] * ho, layout.v) - by_place(drawn.ravel(), gz.reshape(-1, WIDTH), layout.v)
                gd = (np.bincount(word, data, layout.v) - np.bincount(drawn.ravel(), gzd.ravel(), layout.v)).astype(np.float32)
            whole = np.zeros((*used.shape, WIDTH), dtype=np.float32)
            whole[used] = back
            into, gc = np.zeros_like(vectors), np.empty_like(self.c)
            for k in range(ORDER):
                part = slice(ORDER - 1 - k, ORDER - 1 - k + STRETCH)
                into[:, part] += whole * self.c[k]
                gc[k] = np.einsum("sbw,sbw->w", whole, vectors[:, part])
            gr = by_place(x.ravel(), into.reshape(-1, WIDTH), layout.places)
            n = np.float32(1 / len(y))
            for name, g, s in zip(self.NAMES, (gr, gc, gq, gb, gu, gd), self.sums, strict=True):
                g *= n
                s += g * g
                value = getattr(self, name)
                value += RATE * g / np.sqrt(s)

    def log10(self, layout: Layout, stream: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Normalised log10 of the probability of each spot's place (an own word, the end, a tail class) after the places before it, in blocks."""
        out = np.empty(len(spots))
        for i in range(0, len(spots), BLOCK):
            at = spots[i : i + BLOCK]
            y, h = stream[at], self.hidden(self.r[stream[at[0] - ORDER : at[-1] + 1]])[at - at[0]]
            t, mine = layout.top[y], np.empty(len(at), dtype=np.float32)
            for k in range(0, len(at), ROWS):
                mine[k : k + ROWS] = log_softmax_of(h[k : k + ROWS] @ self.q.T + self.b, t[k : k + ROWS])
            own = np.flatnonzero(y < layout.v)
            if len(own):
                own = own[np.argsort(t[own], kind="stable")]
                edges, ho, word = np.searchsorted(t[own], np.arange(layout.groups + 1)), h[own], y[own]
                inner = np.empty(len(own), dtype=np.float32)
                for k in np.flatnonzero(edges[1:] > edges[:-1]):
                    part, words = slice(edges[k], edges[k + 1]), slice(layout.edges[k], layout.edges[k + 1])
                    inner[part] = log_softmax_of(ho[part] @ self.u[words].T + self.d[words], word[part] - layout.edges[k])
                mine[own] += inner
            out[i : i + BLOCK] = mine
        return out / math.log(10)


def log_softmax_of(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of one value of each row of s, which is used up. Rows are shifted by their largest value only where a plain sum would leave the range."""
    if s.max() > 60 or s.max(axis=1).min() < -60:
        s -= s.max(axis=1, keepdims=True)
    mine = s[np.arange(len(at)), at]
    return mine - np.log(np.exp(s, out=s).sum(axis=1))


def arrays(column: pa.Array) -> list[np.ndarray]:
    """A list column of ints as arrays."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def numbered(docs: DataFrame, training: Column, vocabulary: Vocabulary) -> DataFrame:
    """docs: doc_id, text. Written, one row per document: doc_id, training, numbers (of its words), n_known, base and extra (sums of the logs of known words' counts: of all, and of those outside the own words), words and times of the words beyond the TOP."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # TOP words at most

    def setup():
        known_words = shared.value
        lookup, end_log = known_words.lookup(), math.log10(known_words.n_docs + 1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            numbers, base, extra, known, rest, times, many = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                n = np.array(list(map(lookup, words)), dtype=np.int32)
                have = n[n >= 0]
                logs = known_words._log[have]
                numbers.append(n)
                base.append(float(logs.sum()) + end_log)
                extra.append(float(logs[have >= known_words.own].sum()))
                known.append(len(have) + (known_words.n_docs > 0))
                other = Counter([words[k] for k in np.flatnonzero(n < 0)])
                rest += [w.decode() for w in other]
                times += other.values()
                many.append(len(other))
            columns = [batch.column(0), batch.column(1), lists(np.concatenate(numbers), [len(n) for n in numbers], pa.int32()), pa.array(known, type=pa.int64()), pa.array(base), pa.array(extra), lists(rest, many, pa.string()), lists(times, many, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "training", "numbers", "n_known", "base", "extra", "words", "times"])

        return step

    rows = map_batches(docs.select("doc_id", training.alias("training"), "text"), setup, "doc_id long, training boolean, numbers array<int>, n_known long, base double, extra double, words array<string>, times array<long>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def start(rows: DataFrame, vocabulary: Vocabulary) -> tuple[Layout, Model]:
    """Classes and a first model from SAMPLE_DOCS training texts of at most SAMPLE_TOKENS words, on the driver."""
    short = rows.filter(F.col("training") & (F.size("numbers") <= SAMPLE_TOKENS))
    picked = short.select("numbers", F.xxhash64("doc_id").alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("numbers").alias("c")).orderBy("a", "b", "c").limit(SAMPLE_DOCS)
    sample = arrays(picked.select("numbers").toArrow().column("numbers").combine_chunks()) if vocabulary.n_docs else []
    layout = Layout(vocabulary, *like_neighbours(vocabulary, sample))
    model, rng = Model(layout), np.random.default_rng(4)
    if sample:
        stream, spots = layout.stream(sample)
        for _ in range(SAMPLE_EPOCHS):
            model.train(layout, stream, spots, rng, SAMPLE_BATCH)
    return layout, model


class Shard:
    """The training of one shard: pieces of its texts in the order in which they come."""

    def __init__(self, layout: Layout, first: Model, number: int):
        self.layout, self.model, self.number, self.rng = layout, first.copy(), number, np.random.default_rng([4, number])
        self.rows, self.waiting, self.seen = [], 0, 0

    def add(self, numbers: np.ndarray) -> None:
        self.rows.append(numbers)
        self.waiting += len(numbers) + 1
        if self.waiting >= PIECE:
            self.learn()

    def learn(self) -> None:
        if self.rows:
            stream, spots = self.layout.stream(self.rows)
            for k in range(0, len(spots), 2 * PIECE):  # a very long text is more than a piece
                part = spots[k : k + 2 * PIECE]
                self.model.train(self.layout, stream[part[0] - ORDER : part[-1] + 1], part - part[0] + ORDER, self.rng)
            self.seen += len(spots)
            self.rows, self.waiting = [], 0


def train(rows: DataFrame, layout: Layout, model: Model) -> Model:
    """One pass over every position of all training texts, shard by shard, averaged. rows: as numbered() gives them."""
    spark = rows.sparkSession
    rows = rows.filter("training")
    positions = rows.agg(F.sum(F.size("numbers") + 1)).first()[0] or 0
    shards = max(1, -(-positions // SHARD_POSITIONS))
    first = spark.sparkContext.broadcast((layout, model))  # TOP places and some 200,000 weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, model = first.value
        total, weight, shard = None, 0, None

        def close() -> None:
            nonlocal total, weight
            if shard is not None:
                shard.learn()
                part = shard.model.flat() * shard.seen
                total, weight = part if total is None else total + part, weight + shard.seen

        for batch in batches:
            for number, numbers in zip(batch.column(0).to_pylist(), arrays(batch.column(1)), strict=True):
                if shard is None or number != shard.number:
                    close()
                    shard = Shard(layout, model, number)
                shard.add(numbers)
        close()
        if weight:
            yield pa.RecordBatch.from_arrays([lists(total, [len(total)], pa.float64()), pa.array([float(weight)])], names=["total", "weight"])

    bounded_batches(spark)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "numbers", "doc_id", F.xxhash64("numbers").alias("tie"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie").select("shard", "numbers")  # a task a shard: a hash would put several into one
    sums = dealt.mapInArrow(run, "total array<double>, weight double").select("weight", F.posexplode("total").alias("k", "value"))
    found = sums.groupBy("k").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow().sort_by("k")
    return model.copy().load(found.column("value").to_numpy()) if len(found) else model


def frequent(counts: DataFrame) -> pa.Table:
    """word, c of the most frequent words, at most TOP, by falling count. A histogram of steps of the count (each count up to 1000, then 64 steps an octave) gives the least step that fits; so no task sorts the vocabulary."""
    short = counts.filter(F.octet_length("word") <= TOP_BYTES).withColumn("step", F.when(F.col("c") <= 1000, F.col("c")).otherwise(F.floor(F.log2("c") * 64).cast("long") + 1000))
    room, least = TOP, 1 << 62
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["step"]
    return short.filter(F.col("step") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])


def fit(docs: DataFrame, training: Column) -> tuple[Vocabulary, Layout, Model, DataFrame, DataFrame]:
    """docs: doc_id, text. The vocabulary, the places, the model, the written table of all counts, and all documents numbered."""
    learnt = docs.filter(training)
    counts = written(count_words(learnt), "counts")
    tails = {r["tail"]: [int(r["c"]), int(r["v"])] for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    top = frequent(counts)
    vocabulary = Vocabulary(top.column("word").to_pylist(), top.column("c").to_pylist(), [tails.get(k, [0, 0]) for k in range(TAILS)], learnt.count())
    rows = numbered(docs, training, vocabulary)
    layout, model = start(rows, vocabulary)
    return vocabulary, layout, train(rows, layout, model), counts, rows


def score(rows: DataFrame, vocabulary: Vocabulary, layout: Layout, model: Model, counts: DataFrame) -> DataFrame:
    """One row per document of numbered(): doc_id, n_tokens, n_known, base_score (unigram, add one) and score (the model), both log10 of the whole text."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.share, layout, model))

    def setup():
        share, layout, lm = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            numbers = arrays(batch.column(1))
            stream, spots = layout.stream(numbers)
            token, y = lm.log10(layout, stream, spots), stream[spots]
            tailed = y > layout.v
            token[tailed] -= share[y[tailed] - layout.v - 1]
            lengths = np.array([len(n) + 1 for n in numbers])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, type=pa.int64()), *batch.columns[2:6], pa.array(np.add.reduceat(token, np.cumsum(lengths) - lengths))], names=["row", "n_tokens", "doc_id", "n_known", "base", "extra", "score"])

        return step

    scored = map_batches(rows.select("row", "numbers", "doc_id", "n_known", "base", "extra"), setup, "row long, n_tokens long, doc_id long, n_known long, base double, extra double, score double")
    tails = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    rare = tails.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("t").alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    out = scored.join(rare, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), (F.col("base") + more - F.col("n_tokens") * math.log10(vocabulary.n + vocabulary.v + 1)).alias("base_score"), (F.col("score") + F.col("extra") + more).alias("score"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    vocabulary, layout, model, counts, rows = fit(docs, ~held_out)
    out = score(rows, vocabulary, layout, model, counts)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")
