"""Toxicity by a subsequence string kernel, a support vector machine and
Nystroem landmarks.

The kernel of two words is the cosine of their gap-weighted subsequences: all
``i < j < k`` at most ``SPAN`` apart, each skipped character costing a factor
``DECAY``, so that an insult with characters left out, inserted or appended
still shares most of them. Words are delimited by a mark on each side; single
letters in a row count as one word. A few signs between two letters end a word,
and are also read as put into a longer one; ``$ ! | +`` beside a letter also as
the letters they are written for. Landmarks are words of the labelled sample:
those that its toxic documents hold far more often than its clean ones, and
common ones. The machine learns the former from the sentences of clean documents:
each gives its most suspicious word, and the worst of them join the negative
examples, again after every fit. As the decision is linear in the kernel's features, all
landmarks collapse into one weight per subsequence (64 ** 3 of them, whatever
the corpus), and scoring a word is a sum of table entries. A document's margin
is its largest; a logistic curve fitted on labelled documents apart makes it a
score.

Training uses a bounded sample of labelled rows: at most ``SAMPLE`` documents a
class, in the order of a hash of their ids, of at most ``SAMPLE_BYTES`` bytes
each. Scoring runs over every whole text in its own task: no shuffle.

Defined cases: null and wordless texts score as low as the curve goes for a
margin of ``FLOOR``; a sample of one class only gives that class's share as
score to all; repeated rows score alike; input columns named like an output
are replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.llm import frames
from callsheet.llm.words import LOWER, buffers, slices, words_of

SAMPLE, SAMPLE_BYTES = 1_500, 32 << 10
TOXIC_LANDMARKS, CLEAN_LANDMARKS, COMMON, SUSPECTS, ROUNDS = 160, 40, 2_000, 3_000, 4
DECAY, SPAN, FLOOR, COST = 0.6, 4, -3.0, 20.0
MARK, SIZE = 63, 1 << 18
#: offsets (of the second and third character) and their weight
GAPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN + 1) for a in range(1, b)]
#: byte -> symbol: letters 1-26, lead bytes 27, their continuations 28-59, all else 0, which no subsequence holds
SYMBOL = np.zeros(256, np.int32)
SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x80:0xC0] = 28 + (np.arange(0x80, 0xC0) & 31)
SYMBOL[0xC0:] = 27
#: Digits and signs written for letters.
for _sign, _letter in zip("013457@", "oieasta"):
    SYMBOL[ord(_sign)] = SYMBOL[ord(_letter)]
#: bytes of words: all that have a symbol, other digits, and what is put between letters
INSIDE = SYMBOL > 0
INSIDE[[ord(c) for c in "2689-_'"]] = True
INSIDE[0x41:0x5B] = True
#: signs that end a word, but up to FEW in a row between its letters are also read as put in
SIGN = np.zeros(256, bool)
SIGN[0x21:0x7F] = True
SIGN &= ~INSIDE
FEW = 3
#: Signs written for letters where they touch one; apart from that they end words.
SIGNED = SYMBOL.copy()
for _sign, _letter in zip("$!|+", "silt"):
    SIGNED[ord(_sign)] = SYMBOL[ord(_letter)]
READ = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip("$!|+", "silt"):
    READ[ord(_sign)] = ord(_letter)


def _spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words in folded bytes; single letters in a row
    have one start and one end."""
    w = words_of(buf, offs, INSIDE)
    doc = w.doc
    one = (w.end - w.start) == 1
    glued = np.zeros(len(one), bool)
    glued[1:] = one[1:] & one[:-1] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~glued)
    last = np.append(first[1:], len(one))[:len(first)] - 1
    return w.start[first], w.end[last], doc[first]


def _signed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, kind) of the words that hold signs: a few between two
    letters, or ones written for letters beside one. Kind 1: those are read as
    their letters; 2: as put in, like all others (only where that differs)."""
    n, sign, inside = len(buf), SIGN[buf], INSIDE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    head, tail = sign.copy(), sign.copy()
    head[1:] &= ~sign[:-1] | cut[1:n]
    tail[:-1] &= ~sign[1:] | cut[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    left = inside[start - 1] & ~cut[start]
    right = inside[np.minimum(end, n - 1)] & ~cut[end]
    plain = np.concatenate(([0], np.cumsum(sign & (SIGNED[buf] == 0))))  # signs that stand for no letter
    ok = (end - start <= FEW) & (left & right | (left | right) & (plain[end] == plain[start]))
    step = np.zeros(n + 1, np.int8)
    step[start[ok]] += 1
    step[end[ok]] -= 1
    put = np.cumsum(step[:n]) > 0
    w = words_of(np.where(put, ord("a"), np.where(sign, 0x20, buf)).astype(np.uint8), offs, INSIDE)
    count = np.concatenate(([0], np.cumsum(put)))
    letter = np.concatenate(([0], np.cumsum(put & (SIGNED[buf] > 0))))
    one = np.flatnonzero(count[w.end] > count[w.start])
    two = np.flatnonzero(letter[w.end] > letter[w.start])
    both = np.concatenate((one, two))
    return w.start[both], w.end[both], w.doc[both], np.repeat([1, 2], [len(one), len(two)])


def _layout(col: pa.Array, signs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, word heads, words per text): all words one after another with
    a mark before each and one at the end; a head is the place of a mark. With
    ``signs``, a word with signs put in or written for letters counts beside
    the words that these signs part."""
    seq, head, count, _ = _placed(col, signs)
    return seq, head, count


def _placed(col: pa.Array, signs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The layout, and per word (start, end, kind) in the folded bytes."""
    buf, offs = buffers(col)
    buf = LOWER[buf]
    start, end, doc = _spans(buf, offs)
    kind = np.zeros(len(start), np.int64)
    if signs and len(buf):
        start, end, doc, kind = (np.concatenate(x) for x in zip((start, end, doc, kind), _signed(buf, offs)))
        order = np.argsort(doc, kind="stable")
        start, end, doc, kind = start[order], end[order], doc[order], kind[order]
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    byte = buf[np.arange(len(owner)) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)] if len(n) else buf[:0]
    symbol = np.where(kind[owner] == 1, SIGNED[byte], SYMBOL[byte])
    full = symbol > 0  # what has none is as if it weren't there
    n = np.bincount(owner[full], minlength=len(n))
    head = np.concatenate(([0], np.cumsum(n + 1)))
    seq = np.full(head[-1] + 1, MARK, np.int32)
    seq[np.arange(np.count_nonzero(full)) + np.repeat(head[1:] - np.cumsum(n), n)] = symbol[full]
    return seq, head[:-1], np.bincount(doc, minlength=len(offs) - 1), [start, end, kind, buf]


def _subsequences(seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, features, weight) for each pattern of gaps, within words."""
    marks = np.cumsum(seq == MARK)
    for a, b, weight in GAPS:
        m = len(seq) - b
        if m <= 0:
            continue
        first, mid, last = seq[:m], seq[a:a + m], seq[b:]
        ok = (marks[b - 1:b - 1 + m] == marks[:m]) & (first > 0) & (mid > 0) & (last > 0) & ((first != MARK) | (mid != MARK))
        at = np.flatnonzero(ok)
        yield at, (first[at] << 12) | (mid[at] << 6) | last[at], weight


def word_sums(seq: np.ndarray, heads: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per word: the table's sum over its subsequences by the norm that its
    length allows (every subsequence being counted as distinct)."""
    total, norm = np.zeros(len(seq), np.float32), np.zeros(len(seq), np.float32)
    for at, feature, weight in _subsequences(seq):
        total[at] += weight * table[feature]
        norm[at] += weight * weight
    return np.add.reduceat(total, heads) / np.sqrt(np.maximum(np.add.reduceat(norm, heads), 1.0))


def features(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit feature vectors of words as triples (word, feature, value)."""
    seq, heads, _ = _layout(pa.array(some, pa.string()), signs=False)
    owner = np.searchsorted(heads, np.arange(len(seq)), "right") - 1
    row, col, val, norm = [], [], [], np.zeros(len(heads))
    for at, feature, weight in _subsequences(seq):
        row.append(owner[at])
        col.append(feature)
        val.append(np.full(len(at), weight))
        norm += np.bincount(owner[at], minlength=len(heads)) * weight * weight
    row, col, val = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (row, col, val))
    return row, col, val / np.sqrt(np.maximum(norm, 1.0))[row]


def kernel(some: list[str], marks: list[str]) -> np.ndarray:
    """Kernel of every word with every landmark."""
    r, c, v = features(marks)
    known, c = np.unique(c, return_inverse=True)
    z = np.zeros((len(known), len(marks)), np.float32)
    np.add.at(z, (c, r), v)
    out = np.zeros((len(some), len(marks)), np.float32)
    for a in range(0, len(some), 1000):  # bounded memory
        r, c, v = features(some[a:a + 1000])
        i = np.minimum(np.searchsorted(known, c), len(known) - 1)
        ok = known[i] == c
        x = np.zeros((min(1000, len(some) - a), len(known)), np.float32)
        np.add.at(x, (r[ok], i[ok]), v[ok])
        out[a:a + 1000] = x @ z
    return out


def _words(text: str) -> set[str]:
    """Candidate landmarks of a text."""
    return {x for x in re.findall(r"[^\W\d_]+", text.lower()) if 2 < len(x) < 40}


def _apart(texts: list[str]) -> list[str]:
    """Of texts that share their rarest-looking word (copies, mostly) one."""
    out: dict[int, str] = {}
    for x in texts:
        out.setdefault(min((zlib.crc32(w.encode()) for w in _words(x) if len(w) > 6), default=zlib.crc32(x.encode())), x)
    return list(out.values())


def landmarks(toxic: list[str], clean: list[str]) -> tuple[list[str], list[float], list[str]]:
    """Words that toxic texts hold far more often than clean ones (no two
    nearly alike) with the number of texts that hold them, and common words of
    clean texts."""
    hot, cold = Counter(), Counter()
    for count, texts in ((hot, toxic), (cold, clean)):
        for x in texts:
            count.update(_words(x))
    rate = len(clean) / len(toxic)
    gain = {w: n for w, n in hot.items() if n > 2 and n * rate > 8 * (cold[w] + 0.5)}
    order = sorted(gain, key=lambda w: (-gain[w], w))[:4 * TOXIC_LANDMARKS]
    some: list[int] = []
    if order:
        near = kernel(order, order)
        for i in range(len(order)):
            if len(some) < TOXIC_LANDMARKS and (not some or near[i, some].max() < 0.95):
                some.append(i)
    common = [w for w, _ in sorted(cold.items(), key=lambda x: (-x[1], x[0])) if w not in gain]
    return [order[i] for i in some], [float(gain[order[i]]) for i in some], common[:COMMON]


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows
    within the margin; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * c[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (Platt's
    smoothed targets, Newton steps)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class Model:
    table: np.ndarray  #: weight of each subsequence
    bias: float
    slope: float
    offset: float

    def margins(self, col: pa.Array) -> np.ndarray:
        seq, heads, count = _layout(col)
        out = np.full(len(col), FLOOR)
        if len(heads):
            got = word_sums(seq, heads, self.table) + self.bias
            first = np.concatenate(([0], np.cumsum(count)))[:-1][count > 0]
            out[count > 0] = np.maximum(np.maximum.reduceat(got, first), FLOOR)
        return out

    def scores(self, col: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(col) + self.offset, -30, 30)))


def _table(marks: list[str], beta: np.ndarray) -> np.ndarray:
    """The landmarks' weights as one weight per subsequence."""
    r, c, v = features(marks)
    return np.bincount(c, v * beta[r], SIZE).astype(np.float32)


def fit(texts: list[str], labels: list[int], odds: float | None = None) -> Model:
    """The model of a labelled sample. Every third document is left out of the
    machine and fits the logistic curve. ``odds`` of class 1 among all labelled
    rows, if the sample's differ."""
    flat = Model(np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0)
    y = np.array(labels)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model(flat.table, 0.0, 0.0, float(np.log(share / (1 - share))))
    learn = np.arange(len(y)) % 3 != 2
    toxic = _apart([x for x, t, k in zip(texts, labels, learn) if t == 1 and k])
    clean = _apart([x for x, t, k in zip(texts, labels, learn) if t != 1 and k])
    hot, often, common = landmarks(toxic, clean) if toxic and clean else ([], [], [])
    table, bias = flat.table, 0.0
    if hot:
        marks = hot + common[:CLEAN_LANDMARKS]
        value, vector = np.linalg.eigh(kernel(marks, marks).astype(float))
        root = vector[:, value > 1e-4] / np.sqrt(value[value > 1e-4])  # Nystroem: K ** -1/2
        bad = kernel(hot, marks) @ root
        weight = np.sqrt(np.array(often))
        sentences = [s for x in clean for s in re.split(r"[.!?\n]+", x) if s.strip()]
        seen: dict[str, None] = dict.fromkeys(common)
        table = _table(marks, np.r_[np.ones(len(hot)), np.zeros(len(marks) - len(hot))])
        for _ in range(ROUNDS):
            suspects = sorted(set(_suspect(sentences, table)), reverse=True)[:SUSPECTS]
            seen.update(dict.fromkeys(w for _, w in suspects if w not in hot))
            good = kernel(list(seen), marks) @ root
            x, t = np.vstack([bad, good]), np.r_[np.ones(len(bad)), -np.ones(len(good))]
            w = _svm(x, t, COST * np.r_[weight, np.ones(len(good))])
            table, bias = _table(marks, root @ w[:-1]), float(w[-1])
    model = Model(table, bias, 0.0, 0.0)
    held = np.flatnonzero(~learn)
    m = model.margins(pa.array([texts[i] for i in held], pa.string()))
    model.slope, model.offset = _sigmoid(m, np.where(y[held] == 1, 1.0, -1.0))
    model.slope = max(0.0, model.slope)
    if odds:
        model.offset += float(np.log(odds * (y != 1).sum() / (y == 1).sum())) / 2
    return model


def _suspect(sentences: list[str], table: np.ndarray) -> list[tuple[float, str]]:
    """(sum, word): the word with the largest sum of each sentence that has one."""
    col = pa.array(sentences, pa.string())
    seq, heads, count, (start, end, kind, buf) = _placed(col, True)
    if not len(heads):
        return []
    got = word_sums(seq, heads, table)
    out, at = [], 0
    for c in count.tolist():
        if c:
            k = at + int(np.argmax(got[at:at + c]))
            raw = buf[start[k]:end[k]]
            raw = READ[raw] if kind[k] == 1 else raw
            out.append((float(got[k]), raw[INSIDE[raw]].tobytes().decode("utf-8", "replace")))
        at += c
    return out


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          learn: Column | None = None) -> Model:
    """Fit on the bounded sample of labelled rows; ``learn``: a condition on
    the labels' rows."""
    known = labels.where(labels[id_col].isNotNull() & labels[label].isNotNull())
    known = known if learn is None else known.where(learn)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.md5(F.col("_id").cast("string"))
    sample = None
    for y in (0, 1):
        own = known.where(F.col("_y") == y).orderBy(order, "_id").limit(SAMPLE)
        sample = own if sample is None else sample.unionByName(own)
    sample = F.broadcast(frames.stored(sample, "sample"))  # 2 * SAMPLE rows at most
    rows = docs.join(sample, docs[id_col] == F.col("_id")).where(F.octet_length(docs[text]) <= SAMPLE_BYTES) \
        .select(order.alias("o"), docs[text].alias("text"), "_y").distinct().orderBy("o", "text").limit(2 * SAMPLE).collect()
    return fit([r.text for r in rows], [r["_y"] for r in rows], n.get(1, 0) / max(1, n.get(0, 0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of being toxic)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.slope, model.offset))
    out = frames.without(docs, ["score"])
    schema = frames.with_fields(out, score=T.DoubleType())
    names = schema.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*sent.value)
        for part in slices(batches, text):
            cols = dict(zip(part.schema.names, part.columns))
            cols["score"] = pa.array(ready.scores(part.column(text)), pa.float64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return out.mapInArrow(add, schema)
