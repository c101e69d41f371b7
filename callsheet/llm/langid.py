"""Language identification by cross-parsing.

Per language, a suffix automaton of labelled text recognises every substring of
it. A text is parsed greedily against each automaton: a phrase is the longest
match from where the last one ended, so a text in the automaton's language
needs few, long phrases. The number of phrases times the logarithm of the
sample's bound, by the text's length, estimates the cross entropy; the
language with the least wins. The price of a phrase is one for all languages, so
that a language with little text gains nothing by it.

The automata are tables (state x symbol -> state, with a flag where a phrase
ends), so that many texts are parsed side by side, a symbol per step; texts are
parsed in segments of ``SEGMENT`` symbols, all of them, to bound the steps.
Symbols are lower-cased letters, each one its own; whatever is no letter is a
blank. The tables are dense for the ``OWN`` most frequent letters; transitions by
any other are looked up in a sorted list (as exact, and slower: it serves scripts
of thousands of letters).

Training uses a bounded sample: at most ``SAMPLE`` characters per language, of
pieces of ``PIECE`` characters from anywhere in its texts, at most ``PIECES`` of
a text, picked and ordered by hash, each distinct piece once.
The tables hold at most 2 * SAMPLE * SYMBOLS entries a language, the lists 3 *
SAMPLE, and are broadcast; scoring runs over every whole text in its own task, no shuffle.

Defined cases: a null text, and one without a letter, is ``und`` with score 0;
so is every text if no language was learned; ties go to the language first in
code point order; repeated rows get equal results; input columns named like an
output are replaced by it.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.llm import frames
from callsheet.llm.words import buffers, slices

SAMPLE, PIECE, PIECES, SEGMENT = 12_000, 500, 4, 512
#: symbol 0: no letter; up to OWN: the most frequent letters; above: OWN + 1 + code point of any other
OWN = 80
SYMBOLS = OWN + 1
#: bits of a symbol in the key of a transition
BITS = 21
UNKNOWN = "und"
ENDS = np.int32(-2**31)


def alphabet(texts: list[str]) -> np.ndarray:
    """Code point -> symbol, learned from the sample."""
    known = Counter(c for x in texts for c in x.lower() if unicodedata.category(c)[0] == "L")
    own = {ord(c): k for k, (c, _) in enumerate(sorted(known.items(), key=lambda x: (-x[1], x[0]))[:OWN], 1)}
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = own.get(low, OWN + 1 + low)
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the
    root (Blumer et al., built symbol by symbol)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def parse_table(symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton as one array for the symbols up to ``OWN``: where no longer
    match exists, the entry starts a new phrase and is flagged. One more state,
    the last, stands after a symbol that the text hasn't; such a symbol is a
    phrase of its own. Then the transitions by other symbols: sorted keys (state
    and symbol) and states."""
    step = suffix_automaton(symbols)
    root = np.full(SYMBOLS, len(step), np.int32)
    for c, to in step[0].items():
        if c <= OWN:
            root[c] = to
    out = np.broadcast_to(root | ENDS, (len(step) + 1, SYMBOLS)).copy()
    out[0] = root
    rare: dict[int, int] = {}
    for state, to in enumerate(step):
        for c, t in to.items():
            if c <= OWN:
                out[state, c] = t
            else:
                rare[state << BITS | c] = t
    keys = sorted(rare)
    return out.ravel(), np.array(keys, np.int64), np.array([rare[k] for k in keys], np.int32)


class Model:
    """Parse tables of all languages, joined."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.symbol = alphabet(list(texts.values()))
        tables, self.start, self.cost, at = [], [], [], 0
        keys, states, self.unknown = [np.array([-1])], [np.zeros(1, np.int32)], []  # one that no key equals
        for lang in self.langs:
            code = np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32)
            one, key, to = parse_table(self.symbol[code].tolist())
            tables.append((one & ~ENDS) + at | (one & ENDS))
            self.start.append(at)
            self.cost.append(float(np.log2(SAMPLE)))
            keys.append(key + (at << BITS))
            states.append(to + np.int32(at))
            at += len(one) // SYMBOLS
            self.unknown.append(at - 1)
        self.keys, self.states = np.concatenate(keys), np.concatenate(states)
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)

    def rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What the table would hold for symbols above ``OWN``."""
        def step(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.keys[at] == key, self.states[at]

        start = np.array(self.start, np.int64)[:, None]
        hit, to = step(state << BITS | symbol)
        anew, first = step(start << BITS | symbol)
        first = np.where(anew, first, np.array(self.unknown, np.int32)[:, None])
        return np.where(hit, to, np.where(state == start, first, first | ENDS))

    def phrases(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of every segment (rows) in every language (columns)."""
        order = np.argsort(-size, kind="stable")
        begin, n = start[order], size[order]
        state = np.repeat(np.array(self.start, np.int64)[:, None], len(order), 1)
        count = np.ones((len(self.langs), len(order)), np.int32)
        active = len(order) - np.cumsum(np.bincount(n, minlength=int(n.max()) + 1)) if len(n) else []
        for j in range(int(n[0]) if len(n) else 0):
            m = int(active[j])
            symbol = symbols[begin[:m] + j]
            rare = np.flatnonzero(symbol > OWN)
            got = self.table[state[:, :m] * SYMBOLS + np.minimum(symbol, OWN)]
            if len(rare):
                got[:, rare] = self.rare(state[:, rare], symbol[rare])
            count[:, :m] += got < 0
            state[:, :m] = got & ~ENDS
        out = np.empty((len(order), len(self.langs)), np.int32)
        out[order] = count.T
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        buf, offs = buffers(col)
        heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
        symbols = self.symbol[np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        letters = np.concatenate(([0], np.cumsum(symbols > 0)))
        has = letters[heads[1:]] > letters[heads[:-1]]
        pred, score = np.full(len(col), -1), np.zeros(len(col))
        if not self.langs or not has.any():
            return [UNKNOWN] * len(col), score
        doc = np.flatnonzero(has)
        n = np.diff(heads)[doc]
        parts = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(doc)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = heads[doc][owner] + k * SEGMENT
        got = self.phrases(symbols, start, np.minimum(n[owner] - k * SEGMENT, SEGMENT))
        rate = np.add.reduceat(got, np.cumsum(parts) - parts, 0) * np.array(self.cost) / n[:, None]
        pred[doc] = rate.argmin(1)
        low = np.sort(rate, 1)
        score[doc] = 1 - low[:, 0] / low[:, 1] if len(self.langs) > 1 else 1.0
        return [self.langs[p] if p >= 0 else UNKNOWN for p in pred.tolist()], score


def held_out(id_col: Column, folds: int = 3) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 1


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None) -> Model:
    """Automata of a bounded sample of each language's documents."""
    rows = docs.where(docs[lang].isNotNull() & docs[text].rlike(r"\p{L}"))
    rows = rows if learn is None else rows.where(learn)
    rows = rows.select(docs[lang].alias("lang"), docs[id_col].cast("string").alias("id"), docs[text].alias("text"))
    pieces = F.ceil(F.length("text") / PIECE)
    sizes = rows.groupBy("lang").agg(F.sum(F.least(pieces, F.lit(PIECES))).alias("n"), F.sum(F.least(F.length("text"), F.lit(PIECE * PIECES))).alias("chars"))
    # a share of each language's pieces by hash holds about twice the sample; the rest is never moved
    share = F.least(F.lit(1.0), 2.0 * SAMPLE / F.col("chars") + 16.0 / F.col("n")) * (1 << 32)
    limits = frames.small(frames.stored(sizes.select(F.col("lang").alias("_lang"), share.cast("long").alias("_below")), "languages"))
    every = F.transform(F.sequence(F.lit(0), pieces.cast("int") - 1), lambda k: F.struct(F.pmod(F.xxhash64("id", k), F.lit(1 << 32)).alias("h"), k.alias("k")))
    picked = F.filter(F.slice(F.array_sort(every), 1, PIECES), lambda x: F.pmod(F.xxhash64("id", F.lit("keep"), x["k"]), F.lit(1 << 32)) <= F.col("_below"))
    some = rows.join(limits, F.col("lang") == F.col("_lang")).select("lang", "text", F.explode(picked["k"]).alias("k")) \
        .select("lang", F.substring(F.col("text"), F.col("k") * PIECE + 1, F.lit(PIECE)).alias("text")).distinct() \
        .orderBy("lang", F.md5("text"), "text")
    texts: dict[str, str] = {}
    for r in some.toLocalIterator():
        got = texts.get(r.lang, "")
        if len(got) < SAMPLE:
            texts[r.lang] = (got + "\n" + r.text)[:SAMPLE]
    return Model(texts)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (how far the runner-up's
    entropy lies above the winner's, as a share: 0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    out = frames.without(docs, ["lang_pred", "score"])
    schema = frames.with_fields(out, lang_pred=T.StringType(), score=T.DoubleType())
    names = schema.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model.__new__(Model)
        vars(ready).update(sent.value)
        for part in slices(batches, text):
            cols = dict(zip(part.schema.names, part.columns))
            lang, score = ready.predict(part.column(text))
            cols["lang_pred"], cols["score"] = pa.array(lang, pa.string()), pa.array(score, pa.float64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return out.mapInArrow(add, schema)
