"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The base patterns (e-mail, ip, card, phone) are matched over every whole text. The tagger is trained in numpy
from labelled spans: generated items of each kind, in the forms of the base patterns and in others (national
phone numbers, IPv6, addresses outside ASCII, cards with other separators), and look-alikes without a label,
are put at known places into texts of a bounded sample (SAMPLE_DOCS documents of at most SAMPLE_CHARS).

A text is covered by overlapping windows on a fixed grid. Each is decoded by Viterbi; spans that a window's
edge cuts give way to whole ones of a neighbour, or join with the other half; what is left is reconciled over the
whole text as the heaviest set of spans that don't overlap. Every kind needs a digit, an @ or :: (SHAPES), so a
window that has none can hold no span and isn't run.

Defined cases: a null or empty text has no spans; positions are code points, end exclusive; a null doc_id stays;
repeated rows are searched each; an empty table gives none; other columns are ignored by find().
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import id_and_text, map_batches, table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN = 128, 64, 24
SAMPLE_DOCS, SAMPLE_CHARS, EXAMPLES, EPOCHS, BATCH, RATE = 300, 20_000, 3072, 6, 64, 0.015
#: Windows that are run at once.
AT_ONCE = 4096

# The base patterns.
EMAIL_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]|::")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's leftmost matches, found from each @: a match begins with the run of local characters before it, so no run is walked twice."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in EMAIL_LOCAL:
            begin -= 1
        if begin < at and (m := EMAIL_AFTER_AT.match(text, at)):
            found.append((begin, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)  # nothing before this @ can begin a later match
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) by kind as listed, then by place."""
    if not ANCHOR.search(text):
        return []
    ips = [m.span() for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15] if "+" in text else []
    return [(kind, a, b) for kind, spans in zip(KINDS, (emails(text), ips, cards, phones), strict=True) for a, b in spans]


def email_shape(s: str) -> bool:
    return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", s))


def ip_shape(s: str) -> bool:
    """IPv6: eight groups, or :: once; without :: it needs a digit."""
    groups = s.split(":")
    return bool(re.search("[0-9]|::", s)) and any(groups) and 3 <= len(groups) <= 8 and s.count("::") <= 1 and (len(groups) == 8 or "::" in s) and all(re.fullmatch("[0-9A-Fa-f]{0,4}", g) for g in groups)


def card_shape(s: str) -> bool:
    return bool(re.fullmatch(r"[0-9]+(?:[ ./-]{1,3}[0-9]+)*", s)) and 13 <= len(d := digits_of(s)) <= 19 and luhn(d)


def phone_shape(s: str) -> bool:
    """Digits in groups; a number without any separator is no phone number, and points alone part them only as in 976.555.9947."""
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s)) and 7 <= len(digits_of(s)) <= 15 and bool(re.search(r"[0-9][ ().-]+[0-9]", s)) and (not re.fullmatch(r"[0-9.]+", s) or bool(re.fullmatch(r"([0-9]{1,3}\.)?[0-9]{3}\.[0-9]{3}\.[0-9]{4}", s)))


#: What a span that the tagger adds has to look like.
SHAPES = dict(zip(KINDS, (email_shape, ip_shape, card_shape, phone_shape), strict=True))

# Characters: printable ASCII, line end, other letters, anything else, padding.
CHARS, LETTER, OTHER, PAD = 100, 96, 97, 98
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
ALLOWED = np.array([[not (j and j % 2 == 0) or i in (j, j - 1) for j in range(LABELS)] for i in range(LABELS)])
FIRST = np.array([not (j and j % 2 == 0) for j in range(LABELS)])
NEVER = -1e4


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(points), OTHER, dtype=np.int16)
    plain = (points >= 32) & (points < 127)
    out[plain] = points[plain] - 32
    out[points == 10] = 95
    out[(points >= 0xAA) & (points < 0x2000) | (points >= 0x3040) & (points < 0xFB00)] = LETTER
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Gate inputs by character (one table per direction), recurrent weights, labels' scores, CRF transitions."""

    NAMES = ("x0", "u0", "x1", "u1", "w", "b", "trans", "start")

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.normal(0, scale, shape)).astype(np.float32)
        self.h = hidden
        for k in "01":
            table_ = normal(0.3, CHARS, 4 * hidden)
            table_[:, hidden : 2 * hidden] += 1  # the gate that keeps the cell begins open
            setattr(self, f"x{k}", table_)
            setattr(self, f"u{k}", normal(hidden**-0.5, hidden, 4 * hidden))
        self.w, self.b = normal(0.3, 2 * hidden, LABELS), np.zeros(LABELS, dtype=np.float32)
        self.b[0] = 2
        self.trans, self.start = normal(0.1, LABELS, LABELS), normal(0.1, LABELS)

    def lstm(self, x: np.ndarray, k: int, keep: bool = False):
        """x: steps by rows of character codes. Hidden states of each step, and what backward() needs if keep."""
        h, inputs, u = self.h, getattr(self, f"x{k}"), getattr(self, f"u{k}")
        steps, rows = x.shape
        out, state, cell, tape = np.empty((steps, rows, h), dtype=np.float32), np.zeros((rows, h), dtype=np.float32), np.zeros((rows, h), dtype=np.float32), []
        for t in range(steps):
            g = inputs[x[t]]
            g += state @ u
            gates, new = sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            before = cell
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            if keep:
                tape.append((state, before, gates, new, squashed))
            state = gates[:, 2 * h :] * squashed
            out[t] = state
        return out, tape

    def backward(self, x: np.ndarray, k: int, tape: list, slope: np.ndarray, grads: dict) -> None:
        h, u = self.h, getattr(self, f"u{k}")
        gx, gu = np.zeros_like(getattr(self, f"x{k}")), np.zeros_like(u)
        back, of_cell, one = np.zeros_like(slope[0]), np.zeros_like(slope[0]), np.eye(CHARS, dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, before, gates, new, squashed = tape[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            d = slope[t] + back
            of_cell = of_cell + d * o * (1 - squashed * squashed)
            g = np.concatenate((of_cell * new * i * (1 - i), of_cell * before * f * (1 - f), d * squashed * o * (1 - o), of_cell * i * (1 - new * new)), axis=1)
            gu += state.T @ g
            gx += one[x[t]].T @ g
            back, of_cell = g @ u.T, of_cell * f
        grads[f"x{k}"], grads[f"u{k}"] = gx, gu

    def scores(self, x: np.ndarray, keep: bool = False):
        """x: rows by steps. Labels' scores: steps by rows by labels."""
        ahead, tape0 = self.lstm(x.T, 0, keep)
        behind, tape1 = self.lstm(x.T[::-1], 1, keep)
        both = np.concatenate((ahead, behind[::-1]), axis=2)
        return both @ self.w + self.b, both, tape0, tape1

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the label rows y, and the gradients."""
        e, both, tape0, tape1 = self.scores(x, keep=True)
        e = e.astype(np.float64)
        steps, rows, _ = e.shape
        y = y.T
        trans, start = np.where(ALLOWED, self.trans, NEVER).astype(np.float64), np.where(FIRST, self.start, NEVER).astype(np.float64)

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        r = np.arange(rows)
        gold = start[y[0]] + sum(e[t, r, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        slope = np.exp(alpha + beta - total[None, :, None])
        g_start, g_trans = slope[0].sum(axis=0), np.zeros_like(trans)
        np.subtract.at(g_start, y[0], 1)
        for t in range(1, steps):
            g_trans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
            np.subtract.at(g_trans, (y[t - 1], y[t]), 1)
            slope[t, r, y[t]] -= 1
        slope[0, r, y[0]] -= 1
        slope = (slope / rows).astype(np.float32)
        grads = {"trans": g_trans / rows * ALLOWED, "start": g_start / rows * FIRST, "w": np.einsum("trh,trl->hl", both, slope, optimize=True), "b": slope.sum(axis=(0, 1))}
        into = slope @ self.w.T
        self.backward(x.T, 0, tape0, into[:, :, : self.h], grads)
        self.backward(x.T[::-1], 1, tape1, into[::-1, :, self.h :], grads)
        return float((total - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> list[float]:
        """Adam over shuffled batches with a falling rate; the mean loss of each epoch."""
        rng, moments, t, losses = np.random.default_rng(seed), {n: [0.0, 0.0] for n in self.NAMES}, 0, []
        steps = epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order, lost = rng.permutation(len(x)), []
            for k in range(0, len(x), BATCH):
                rows = order[k : k + BATCH]
                value, grads = self.loss(x[rows], y[rows])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                t += 1
                for n in self.NAMES:
                    g, m = grads[n] * min(1, 5 / max(norm, 1e-9)), moments[n]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
                    step = RATE * (1 - t / (steps + 1)) * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - step).astype(np.float32))
                lost.append(value)
            losses.append(float(np.mean(lost)))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best label path of each row, and each step's score of its label over outside."""
        e = self.scores(x)[0]
        steps, rows, _ = e.shape
        trans = np.where(ALLOWED, self.trans, NEVER).astype(np.float32)
        best, came = np.where(FIRST, self.start, NEVER).astype(np.float32) + e[0], np.empty((steps, rows, LABELS), dtype=np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + trans
            came[t] = through.argmax(axis=1)
            best = np.take_along_axis(through, came[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        path = np.empty((rows, steps), dtype=np.int8)
        path[:, -1] = best.argmax(axis=1)
        r = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = came[t, r, path[:, t]]
        over = np.take_along_axis(e.transpose(1, 0, 2), path[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0].T
        return path, over


def made_item(rng, kind: int) -> str:
    """An item of a kind (0 to 3), or a look-alike that is none (4)."""
    pick, n = lambda xs: xs[int(rng.integers(len(xs)))], lambda a, b: int(rng.integers(a, b))
    digits = lambda k: "".join(str(n(0, 10)) for _ in range(k))
    letters = lambda k, extra="": "".join(pick(string.ascii_lowercase + extra) for _ in range(k))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    if kind == 0:
        extra = pick(["", "éüñøß"])
        local = pick(["{0}.{2}", "{0}.{1}", "{0}", "{0}_{1}", "{0}+{2}"]).format(letters(n(2, 10), extra), letters(n(2, 9)), digits(2))
        return f"{local}@{pick(['mail', letters(n(2, 9), extra)])}{pick(['', digits(1)])}.{pick(['example.com', 'com', 'org', 'de', 'co.uk', 'fr'])}"
    if kind == 1:
        return ".".join(str(n(0, 256)) for _ in range(4)) if n(0, 4) else ":".join(f"{n(0, 65536):x}" for _ in range(8)) if n(0, 2) else f"2001:db8::{n(1, 65536):x}" if n(0, 2) else f"{hexes(4)}:{hexes(4)}::{hexes(4)}"
    if kind == 2:
        body = pick("3456") + digits(n(12, 16))
        check = next(c for c in string.digits if luhn(body + c))
        size = pick([0, 0, 4])
        return pick([" ", "-", ".", " - "]).join((body + check)[i : i + size] for i in range(0, len(body) + 1, size)) if size else body + check
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(["+1 ({0}) {1}-{2}", "+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "+{0} {1} {2}", "+44 20 {1} {2}", "+49 {0} {1}{2}"]).format(a, b, c)
    return pick([f"password={hexes(18)}", f'token = "{hexes(40)}"', f"AKIA{''.join(pick(string.ascii_uppercase + string.digits) for _ in range(16))}", f"version {n(1, 20)}.{n(0, 20)}.{n(0, 99)}", f"CC BY-NC {n(1, 5)}.0", f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", digits(n(1, 13)), f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"${digits(3)}.{digits(2)}", f"id {digits(6)}-{digits(4)}", f"{digits(4)} {digits(4)}", f"@{letters(6)}", hexes(32), f"{n(1, 999)},{digits(3)}", f"p. {n(1, 400)}-{n(400, 900)}"])


def examples(texts: list[str], count: int = EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and labels: pieces of the texts with up to three items at known places."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()] or ["the quick brown fox jumps over the lazy dog, then rests.\n"]
    x, y = np.full((count, WINDOW), PAD, dtype=np.int16), np.zeros((count, WINDOW), dtype=np.int64)
    for row in range(count):
        text = texts[int(rng.integers(len(texts)))]
        at = int(rng.integers(max(1, len(text) - WINDOW)))
        words, parts, labels = ANCHOR.sub("x", text[at : at + WINDOW]).split(" "), [], []
        items = {int(rng.integers(len(words))): int(rng.integers(5)) for _ in range(int(rng.integers(1, 4)))}
        for k, word in enumerate(words):
            if k in items:
                item, kind = made_item(rng, items[k]), items[k]
                after = str(rng.choice(["", "", "", ".", ",", ")", ":"]))
                parts += [item + after, " "]
                labels += ([0] * len(item) if kind == 4 else [1 + 2 * kind] + [2 + 2 * kind] * (len(item) - 1)) + [0] * (len(after) + 1)
            parts += [word, " "]
            labels += [0] * (len(word) + 1)
        whole, shift = codes("".join(parts)), 0
        if len(whole) > WINDOW:
            shift = int(rng.integers(len(whole) - WINDOW + 1))
        n = min(WINDOW, len(whole))
        x[row, :n], y[row, :n] = whole[shift : shift + n], labels[shift : shift + n]
        if y[row, 0] and y[row, 0] % 2 == 0:
            y[row, 0] -= 1  # cut by the window: it begins here
    return x, y


def sample_texts(docs: DataFrame, docs_bound: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    short = docs.filter(F.char_length("text") <= chars)
    ids = short.select("doc_id").dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_bound)
    return sorted(r["text"] for r in short.join(F.broadcast(ids), "doc_id").select("text").limit(2 * docs_bound).collect())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    tagger = Tagger()
    tagger.train(*examples(sample_texts(id_and_text(docs, id_col, text_col))))
    return tagger


def window_spans(path: np.ndarray, over: np.ndarray, begin: int, n: int, length: int) -> list[tuple[int, int, int, float, bool]]:
    """(kind, begin, end, score, cut) of a decoded window of n characters in a text of some length; cut: an inner edge of the window touches it."""
    found, t = [], 0
    while t < n:
        if path[t]:
            kind, first = (path[t] - 1) // 2, t
            t += 1
            while t < n and path[t] == 2 + 2 * kind:
                t += 1
            found.append((int(kind), begin + first, begin + t, float(over[first:t].sum()), (first == 0 and begin > 0) or (t == n and begin + n < length)))
        else:
            t += 1
    return found


def reconciled(spans: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """One reading of a whole text: whole spans before cut ones, halves joined, then the heaviest set without overlap."""
    whole = sorted(s for s in spans if not s[4])
    starts = sorted((a, b) for _, a, b, _, _ in whole)
    joined: list[tuple[int, int, int, float]] = []
    for kind, a, b, w, _ in sorted(s for s in spans if s[4]):
        if any(x < b and a < y for x, y in starts):
            continue
        if joined and joined[-1][0] == kind and a <= joined[-1][2]:
            last = joined[-1]
            joined[-1] = (kind, last[1], max(last[2], b), last[3] + w)
        else:
            joined.append((kind, a, b, w))
    spans = sorted({(b, a, kind): w for kind, a, b, w in [*(s[:4] for s in whole), *joined]}.items())
    ends = [b for (b, _, _), _ in spans]
    best, taken = [0.0], []
    for (_, a, _), w in spans:
        k = int(np.searchsorted(ends, a, side="right"))
        k = min(k, len(best) - 1)
        take = best[k] + max(w, 1e-6)
        taken.append(take > best[-1])
        best.append(max(take, best[-1]))
    out, k = [], len(spans)
    while k:
        (b, a, kind), _ = spans[k - 1]
        if taken[k - 1]:
            out.append((kind, a, b))
            k = min(int(np.searchsorted(ends, a, side="right")), k - 1)
        else:
            k -= 1
    return out[::-1]


def tagged(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """For each text the tagger's spans (kind, begin, end)."""
    where, rows = [], []
    for d, text in enumerate(texts):
        grid = sorted({k for m in ANCHOR.finditer(text) for k in range(max(0, (m.start() - WINDOW) // STRIDE + 1), m.start() // STRIDE + 1)})
        if grid:
            c = codes(text)
            for k in grid:
                if k and k * STRIDE + WINDOW - STRIDE >= len(c):
                    continue  # the window before reaches the end
                part = c[k * STRIDE : k * STRIDE + WINDOW]
                row = np.full(WINDOW, PAD, dtype=np.int16)
                row[: len(part)] = part
                where.append((d, k * STRIDE, len(part), len(c)))
                rows.append(row)
    found: list[list] = [[] for _ in texts]
    for i in range(0, len(rows), AT_ONCE):
        path, over = tagger.decode(np.stack(rows[i : i + AT_ONCE]))
        for k in np.flatnonzero(path.any(axis=1)):
            d, begin, n, length = where[i + k]
            found[d] += window_spans(path[k], over[k], begin, n, length)
    return [reconciled(f) if f else [] for f in found]


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, begin, end, base) by kind as listed, then by place: base spans, and the tagger's that have their kind's shape and touch none of those."""
    out = []
    for text, more in zip(texts, tagged(texts, tagger), strict=True):
        base = base_spans(text)
        spans = [(KINDS.index(k), a, b, True) for k, a, b in base]
        for kind, a, b in more:
            while a < b and text[a] in " \n\t,;:.":
                a += 1
            while a < b and text[b - 1] in " \n\t,;:.":
                b -= 1
            inside = a > 0 and text[a - 1].isalnum() or b < len(text) and text[b].isalnum()
            if not inside and SHAPES[KINDS[kind]](text[a:b]) and all(b <= x or y <= a for _, x, y in base):
                spans.append((kind, a, b, False))
        out.append([(KINDS[k], a, b, f) for k, a, b, f in sorted(spans)])
    return out


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans array<struct<kind,begin,end,base>>, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # some 30,000 weights

    def setup():
        span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = all_spans(batch.column(1).to_pylist(), shared.value)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "begin", "end", "base"), s, strict=True)) for s in x] for x in found], type=span)], names=["doc_id", "spans"])

        return step

    return map_batches(id_and_text(docs, id_col, text_col), setup, "doc_id long, spans array<struct<kind:string,begin:int,end:int,base:boolean>>")


def redact(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """Each stretch that spans cover becomes [KIND] of its first span."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:] if spans else text


def redact_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with their texts redacted and n_chars counted anew; all columns stay, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    at, schema = docs.columns.index("text"), docs.schema

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            spans = all_spans([t or "" for t in texts], shared.value)
            new = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], type=batch.column(at).type)
            return pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

        return step

    out = map_batches(docs, setup, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
