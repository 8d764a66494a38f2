"""Personal data, language-model scores and toxicity: brute force, held-out accuracy, gradients."""

import copy
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import language_model, pii, toxicity
from textquarry.llm.common import crc_mod, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, *m.span()) for (k, ok), p in zip(tests.items(), (EMAIL, IP, CARD, PHONE), strict=True) for m in p.finditer(text) if ok(m.group())]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(1)
    samples = ["a@b.c@d.e.f", "x@@y.z", "@a.b", "a@b", "a.b@c.d.@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "0004.1.1.1", "+1 (976) 555-9947 +12", "4111 1111-1111 1111", "4111111111111112", "+1+2+33333333333"]
    samples += ["".join(rng.choice(list("ab1.2@+- ()4 9"), 60)) for _ in range(3000)]
    for t in samples:
        assert pii.base_spans(t) == plain_base(t), t


@pytest.fixture(scope="module")
def tagger(spark, sf):
    return pii.fit(table(spark, sf, "documents"))


def test_gradients():
    x, y = pii.examples(["some plain words to fill a window with"], 4)
    tagger = pii.Tagger(hidden=3)
    _, grads = tagger.loss(x[:, :20], y[:, :20])
    for name in pii.Tagger.NAMES:
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        sides = []
        for e in (0.01, -0.01):
            moved = copy.deepcopy(tagger)
            getattr(moved, name)[at] += e
            sides.append(moved.loss(x[:, :20], y[:, :20])[0])
        assert abs((sides[0] - sides[1]) / 0.02 - grads[name][at]) < 0.01 * abs(grads[name][at]) + 1e-3


def test_tagger_finds_labelled_items(tagger):
    rng, hit, total = np.random.default_rng(11), 0, 0
    for _ in range(150):
        kind = int(rng.integers(4))
        item = pii.made_item(rng, kind)
        text = f"words before it {item} and words after it"
        total += 1
        hit += (pii.KINDS[kind], 16, 16 + len(item)) in [s[:3] for s in pii.all_spans([text], tagger)[0]]
    assert hit / total > 0.9


def test_added_spans_and_clean_texts(tagger):
    got = pii.all_spans(["call (976) 555-9947 now", "josé.pérez@münchen.de wrote", "in 2024 and 3 of 12 chapters, version 4.2, p. 12", "", "x" * 250 + " " + "a" * 90 + "@mail.example.com end"], tagger)
    assert got[0] == [("phone", 5, 19, False)] and got[1] == [("email", 0, 21, False)] and got[2] == got[3] == []
    assert got[4] == [("email", 251, 358, True)]


def test_viterbi_equals_all_paths(tagger):
    """The best of all label paths of short rows, by enumeration."""
    texts = ["a@b", "1.2.", "x 4-", "::ab"]
    x = np.stack([np.pad(pii.codes(t), (0, 4 - len(t)), constant_values=pii.PAD) for t in texts])
    path, over = tagger.decode(x)
    e = tagger.scores(x)[0]
    for row in range(len(texts)):

        def value(labels, row=row):
            if not pii.FIRST[labels[0]] or not all(pii.ALLOWED[a, b] for a, b in itertools.pairwise(labels)):
                return -math.inf
            return float(tagger.start[labels[0]] + sum(e[t, row, k] for t, k in enumerate(labels)) + sum(tagger.trans[a, b] for a, b in itertools.pairwise(labels)))

        best = max(itertools.product(range(pii.LABELS), repeat=4), key=value)
        assert abs(value(best) - value(tuple(int(k) for k in path[row]))) < 1e-3
        assert np.allclose(over[row], [e[t, row, path[row, t]] - e[t, row, 0] for t in range(4)], atol=1e-5)


def planted(documents, count, seed):
    """Texts with items of known places put between their words, and these (kind, begin, end)."""
    rng, out = np.random.default_rng(seed), []
    for k in range(count):
        words, parts, spans, at = [w for w in documents[k % len(documents)].split(" ") if not pii.ANCHOR.search(w)][:300], [], [], 0
        if len(words) < 5:
            continue
        places = {int(p): int(rng.integers(5)) for p in rng.choice(len(words), min(4, len(words)), replace=False)}
        for j, word in enumerate(words):
            if j in places:
                item = pii.made_item(rng, places[j])
                if places[j] < 4:
                    spans.append((pii.KINDS[places[j]], at, at + len(item)))
                parts.append(item)
                at += len(item) + 1
            parts.append(word)
            at += len(word) + 1
        out.append((" ".join(parts), spans))
    return out


def test_tagger_on_planted_documents(spark, tagger):
    """Texts of which none was in the sample; the bounds are below what was measured (see the README)."""
    documents = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").filter("doc_id >= 500 AND length(text) < 20000").orderBy("doc_id").collect() if r.text]
    texts = planted(documents, 300, 12)
    found = [{s[:3] for s in spans} for spans in pii.all_spans([t for t, _ in texts], tagger)]
    wanted = [set(s) for _, s in texts]
    hit = sum(len(a & b) for a, b in zip(found, wanted, strict=True))
    recall, precision = hit / sum(map(len, wanted)), hit / sum(map(len, found))
    print(f"planted items: precision {precision:.3f}, recall {recall:.3f} of {sum(map(len, wanted))}")
    assert recall > 0.9 and precision > 0.9


def test_windows_lose_nothing(tagger):
    """Every window of the grid is run, one by one: the same spans as from those that hold an anchor."""
    rng = np.random.default_rng(5)
    for text, _ in planted(["plain words that fill up the lines of a text and say nothing at all " * 12] * 8, 8, int(rng.integers(1000))):
        c, spans = pii.codes(text), []
        for begin in range(0, max(1, len(c) - pii.WINDOW + pii.STRIDE), pii.STRIDE):
            part = c[begin : begin + pii.WINDOW]
            path, over = tagger.decode(np.pad(part, (0, pii.WINDOW - len(part)), constant_values=pii.PAD)[None])
            spans += pii.window_spans(path[0], over[0], begin, len(part), len(c))
        whole = [(k, a, b) for k, a, b in pii.reconciled(spans) if pii.ANCHOR.search(text[a:b])]
        assert [s for s in pii.tagged([text], tagger)[0] if pii.ANCHOR.search(text[s[1] : s[2]])] == whole


def test_shapes():
    assert pii.phone_shape("976.555.9947") and pii.phone_shape("1.976.555.9947") and not pii.phone_shape("10.12.2024") and not pii.phone_shape("3.14159265")
    assert pii.ip_shape("dead:beef::cafe") and pii.ip_shape("2001:db8::1") and not pii.ip_shape("a:b:c") and not pii.ip_shape("12:30:45") and not pii.ip_shape("::")


def test_reconciliation():
    assert pii.reconciled([(0, 5, 20, 3.0, True), (0, 5, 30, 9.0, False), (1, 28, 40, 2.0, False)]) == [(0, 5, 30)]
    assert pii.reconciled([(0, 5, 20, 3.0, True), (0, 18, 30, 9.0, True)]) == [(0, 5, 30)]
    assert pii.reconciled([(0, 0, 4, 5.0, False), (1, 2, 8, 6.0, False), (2, 6, 9, 5.0, False)]) == [(0, 0, 4), (2, 6, 9)]


def test_pii_query(spark, sf):
    documents = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in pii.op2_pii(spark, sf).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in plain_base(documents[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_pii_odd_rows(odd, empty, tagger):
    assert pii.find(odd, tagger).filter("size(spans) > 0").count() == 0 and pii.find(odd, tagger).count() == odd.count()
    kept = pii.redact_documents(odd, tagger)
    assert kept.columns == odd.columns and kept.filter("text IS NULL").count() == 2
    assert pii.find(empty, tagger).count() == 0
    assert pii.fit(empty) is not None
    assert pii.redact("a x@y.z b", [("email", 2, 7, True), ("ip", 3, 8, True)]) == "a [EMAIL]b"


def test_language_model_query(spark, sf):
    documents = {r.doc_id: (r.text or "").encode().lower().split() for r in table(spark, sf, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    counts = Counter(w for i, t in documents.items() if not held[i] for w in t)
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    rows = language_model.op5_language_model(spark, sf).collect()
    for r in rows:
        t = documents[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t) + 1, sum(counts[w] > 0 for w in t) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


@pytest.fixture(scope="module")
def small_model():
    """A vocabulary of 300 words, 250 of them own ones, and a model that has learnt something."""
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(300)]
    counts, tails = sorted(rng.integers(1, 500, 300).tolist(), reverse=True), np.zeros((language_model.TAILS, 2), dtype=int)
    for w, c in zip(names, counts, strict=True):
        tails[language_model.tail_of(w.encode())] += c, 1
    words = language_model.Vocabulary(names, counts, tails.tolist(), 20)
    words.own = 250
    words = rebuilt(words, names, counts, tails)
    rows = [rng.integers(-language_model.TAILS, 300, int(n)).astype(np.int32) for n in (0, 1, 7, 300, 40)]
    layout = language_model.Layout(words, *language_model.like_neighbours(words, rows, 12))
    model = language_model.Model(layout)
    stream, spots = layout.stream(rows)
    model.train(layout, stream, spots, np.random.default_rng(1), 64)
    return words, layout, model, rows


def rebuilt(words, names, counts, tails):
    """With the totals of the tail classes without the own words."""
    totals = tails.astype(float).copy()
    for w, c in zip(names[: words.own], counts[: words.own], strict=True):
        totals[language_model.tail_of(w.encode())] -= c, 1
    words.share, words.tail_counts = np.log10(totals.sum(axis=1) + 1), totals[:, 0]
    return words


def test_language_model_equals_a_plain_softmax(small_model):
    """Token by token: the class's softmax, then the word's in its class; and all places of a context sum to one."""
    words, layout, model, rows = small_model
    assert sorted(layout.tail[: layout.v].tolist()) == list(range(250)) and np.diff(layout.edges).max() - np.diff(layout.edges).min() <= 1
    stream, spots = layout.stream(rows)
    got = iter(model.log10(layout, stream, spots))

    def logs(before):
        h = sum(model.c[k].astype(float) * model.r[p] for k, p in enumerate(before))
        of_class = model.q @ h + model.b
        of_class = of_class - np.log(np.exp(of_class).sum())
        out = []
        for place in range(layout.places):
            t = layout.top[place]
            inner = 0.0
            if place < layout.v:
                mates = [p for p in range(layout.v) if layout.top[p] == t]
                s = {p: float(model.u[p] @ h + model.d[p]) for p in mates}
                inner = s[place] - math.log(sum(math.exp(x) for x in s.values()))
            out.append((of_class[t] + inner) / math.log(10))
        return out

    for row in rows:
        places = [int(layout.tail[n]) if n >= 0 else layout.v - int(n) for n in row] + [layout.v]
        for k, place in enumerate(places):
            value = next(got)
            if k < 6 or k == len(places) - 1:
                all_logs = logs([places[k - 1 - j] if k - 1 - j >= 0 else layout.v for j in range(language_model.ORDER)])
                assert abs(all_logs[place] - value) < 1e-4 and abs(sum(10**x for x in all_logs) - 1) < 1e-6
    assert next(got, None) is None
    share = Counter()  # known words of a tail class, and one place for unknown ones
    for k, n in enumerate(words.share):
        known = [c for w, c in zip(words.words[words.own :], words.counts[words.own :], strict=True) if language_model.tail_of(w.encode()) == k]
        share[k] = sum((c + 1) / 10**n for c in known) + 1 / 10**n
    assert all(abs(x - 1) < 1e-9 for x in share.values())


def test_classes_part_words_by_neighbours():
    """Words of two languages that never meet fall into different halves."""
    rng = np.random.default_rng(6)
    names = [f"w{k}" for k in range(40)]
    words = language_model.Vocabulary(names, [100] * 40, [[4000, 40]] * language_model.TAILS, 1)
    rows = [(2 * rng.integers(0, 20, 500) + k % 2).astype(np.int32) for k in range(20)]
    order, sizes = language_model.like_neighbours(words, rows, 2)
    assert sizes.tolist() == [20, 20] and len(set((order[:20] % 2).tolist())) == 1


def test_language_model_trains_on_every_position(small_model, monkeypatch):
    _, layout, model, rows = small_model
    met, train = [], language_model.Model.train

    def spied(self, layout, stream, spots, *rest):
        met.extend(stream[spots].tolist())
        return train(self, layout, stream, spots, *rest)

    monkeypatch.setattr(language_model.Model, "train", spied)
    monkeypatch.setattr(language_model, "PIECE", 16)  # several pieces, and a row of more than two
    before = model.flat()
    shard = language_model.Shard(layout, model, 7)
    for r in rows:
        shard.add(r)
    shard.learn()
    stream, spots = layout.stream(rows)
    assert shard.seen == len(spots) and sorted(met) == sorted(stream[spots].tolist())
    assert np.array_equal(before, model.flat()) and not np.array_equal(before, shard.model.flat())


def test_noise_words_follow_their_frequency(small_model):
    _, layout, _, _ = small_model
    drawn = layout.noise_words(np.random.default_rng(1), 20_000)
    for k in range(layout.groups):
        part = slice(layout.edges[k], layout.edges[k + 1])
        assert drawn[k].min() >= part.start and drawn[k].max() < part.stop
        assert np.abs(np.bincount(drawn[k] - part.start, minlength=part.stop - part.start) / 20_000 - layout.word_noise[part]).max() < 0.02


def test_language_model_does_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_POSITIONS", 15_000)  # several shards
    docs = table(spark, sf, "documents").selectExpr("doc_id", "coalesce(text, '') AS text")
    found = []
    for many in (1, 7):
        words, layout, model, counts, rows = language_model.fit(docs.repartition(many), F.lit(True))
        found.append({r.doc_id: r.score for r in language_model.score(rows, words, layout, model, counts).collect()})
    assert all(math.isclose(found[0][k], found[1][k], rel_tol=1e-5) for k in found[0])


def test_language_model_odd_rows(odd, empty):
    docs = odd.select("doc_id", "text").fillna({"text": ""})
    words, layout, model, counts, numbered = language_model.fit(docs, F.lit(True))
    rows = language_model.score(numbered, words, layout, model, counts).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    none = empty.select("doc_id", "text")
    words, layout, model, counts, numbered = language_model.fit(none, F.lit(True))
    assert language_model.score(numbered, words, layout, model, counts).count() == 0
    words, layout, model, counts, numbered = language_model.fit(docs, F.lit(False))
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in language_model.score(numbered, words, layout, model, counts).collect())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    positive, negative = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([a > b for a in positive for b in negative]) > 0.75
    assert np.mean([s >= 0.7 for s in negative]) < 0.05


def test_offending_sentences_are_found():
    rng = np.random.default_rng(2)
    calm = lambda: " ".join(f"w{rng.integers(40)}" for _ in range(8))
    texts, labels = [], []
    for k in range(200):
        sentences = [calm() for _ in range(6)]
        if k % 3 == 0:
            sentences[int(rng.integers(6))] += " you vilefoo" + "abc"[int(rng.integers(3))]
        texts.append(". ".join(sentences) + ".")
        labels.append(int(k % 3 == 0))
    score = toxicity.train(texts, labels).scorer()
    p, found = score(f"{calm()}. Oh vilefooz. {calm()}.")
    assert p > 0.7 and len(found) == 1 and score(f"{calm()}. {calm()}.")[0] < 0.3
    assert score("") == (0.0, [])


def plain_toxicity(model, text):
    """The noisy-or of the strongest five of the sentences that differ, gram by gram."""
    zs = {}
    for sentence in re.split(r"[.!?\n]", text):
        if words := sentence.split():
            zs[" ".join(words)] = model.bias + sum(model.weights.get(g, 0.0) for w in words for g in toxicity.grams(w))
    clean = 1.0
    for z in sorted(zs.values())[-5:]:
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


@pytest.fixture(scope="module")
def toxicity_model(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"), crc_mod(F.col("doc_id"), 3) != 1)


def test_toxicity_scores_equal_a_plain_loop(spark, sf, toxicity_model):
    score = toxicity_model.scorer()
    for r in table(spark, sf, "documents").collect():
        assert abs(score(r.text or "")[0] - plain_toxicity(toxicity_model, r.text or "")) < 1e-9


def test_long_clean_texts_stay_clean(spark, toxicity_model):
    score = toxicity_model.scorer()
    assert score("We walked along the river and had a quiet lunch by the bridge. " * 5000)[0] < 0.1
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    calm = sorted((r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect() if r.text and labels.get(r.doc_id) == 0)
    calm = [t for _, t in calm if score(t)[0] < 0.3]
    assert len(calm) > 200
    for t in calm:
        assert abs(score(t)[0] - score((t + "\n") * 10)[0]) < 1e-9  # what is said again is no new evidence
    assert all(score("\n".join(calm[k : k + 20]))[0] < 0.7 for k in range(0, 200, 20))


def test_strongest_of_each_bag():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 12, 5, 0, 7])
    bag, first, z = np.repeat(np.arange(6), sizes), np.cumsum(sizes) - sizes, rng.normal(size=27)
    got = set(toxicity.strongest(z, bag, first).tolist())
    assert got == {k for b in range(6) for k in sorted(np.flatnonzero(bag == b), key=lambda k: -z[k])[: toxicity.STRONGEST]}


def test_labels_without_usable_documents_take_no_place(spark):
    docs = spark.createDataFrame([(1, "x" * 100), (2, "bad"), (3, "good"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k != 3)) for k in (1, 2, 3, 4, 90, 91, 92, 93)], "doc_id long, toxic int")
    got = toxicity.training_sample(docs, labels, F.lit(True), max_toxic=2, max_clean=1, max_chars=50)
    assert [(r.doc_id, r.text, r.toxic) for r in got] == [(2, "bad", 1), (3, "good", 0), (4, "", 1)]


def test_toxicity_odd_rows(spark, odd, empty, make):
    labels = spark.createDataFrame([(6, 1, 0), (7, None, 1), (None, 1, 1), (6, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(odd, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r.score == 0 for r in rows if r.doc_id in (1, 2))
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd, model).count() == odd.count()
    assert toxicity.score(empty, model).count() == 0
    assert odd.select((crc_mod(F.col("doc_id"), 3) == 1).alias("x")).filter("x IS NULL").count() == 0
