"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document, from counts
of its text. Expectation-maximisation over the vote patterns estimates, without
labels, how often each rule is right on good and on bad documents and what
share is good; a document's posterior probability of being good then replaces
the usual all-rules-must-pass filter. Only DataFrame functions run on the
executors: counts are expressions on the row, the EM sees nothing but the
number of documents per vote pattern (3 to the number of rules at most), and
the posterior is a sum of votes' weights on the row. Nothing is shuffled but
those pattern counts. Repeated word windows are found by sorting a document's
own window hashes, so a long text costs n log n.

Defined cases: a null or empty text has zero counts and fails the base rules;
repeated rows are judged alike; no rows give no rows; input columns named like
an output are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.llm import frames

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_bare")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WINDOW = 3
#: Rule -> (numerator, denominator, good up to, bad from); between the two it abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.02, 0.15),
    "duplicate_lines": ("n_dup_lines", "n_lines", 0.10, 0.30),
    "repeated_words": ("n_repeat_words", "n_words", 0.10, 0.30),
    "capitals": ("n_upper", "n_letters", 0.15, 0.50),
    "non_letters": ("n_other", "word_chars", 0.15, 0.30),
    "bare_words": ("n_bare", "n_words", 0.05, 0.20),
    "word_length": ("word_chars", "n_words", 9.0, 14.0),
}
ROUNDS, PRIOR, SMOOTH = 50, 0.85, 1.0


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS and MORE (long, 0 for a null text)."""
    names = [*COUNTS, *MORE]
    out = frames.without(docs, names)
    t = F.coalesce(out[text], F.lit(""))
    kept = [F.col(f"`{c}`") for c in out.columns]
    cut = out.select(*kept, F.regexp_extract_all(t, F.lit(frames.WORD), F.lit(0)).alias("_w"),
                     F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashes = cut.withColumn("_g", F.when(F.size("_w") < WINDOW, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.struct(
            F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))))
    ordered = hashes.withColumn("_g", F.sort_array("_g"))
    again = ordered.withColumn("_g", F.transform(
        F.filter("_g", lambda x, k: (F.get("_g", k - 1)["h"] == x["h"]) | (F.get("_g", k + 1)["h"] == x["h"])),
        lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform("_g", lambda i: F.array(*[i + k for k in range(WINDOW)]))))
    values = {
        "n_words": F.size("_w"), "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "n_repeat_words": F.size(covered),
        "n_lines": F.size("_l"), "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_bare": F.size(F.filter("_w", lambda x: ~x.rlike(r"\p{L}"))),
    }
    return again.select(*kept, *[values[c].cast("long").alias(c) for c in names])


def base_failed() -> Column:
    """The hard rules: too short, or more than half in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Rule -> its vote on a row with text counts."""
    other = F.col("word_chars") - F.col("n_letters")
    out = {}
    for name, (top, per, good, bad) in RULES.items():
        share = (other if top == "n_other" else F.col(top)) / F.greatest(F.col(per), F.lit(1))
        out[name] = F.when(F.col("n_words") == 0, 0).when(share <= good, 1).when(share >= bad, -1).otherwise(0)
    return out


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS, prior: float = PRIOR) \
        -> tuple[float, list[tuple[float, float]]]:
    """EM over vote pattern -> documents. Returns the share of good documents
    and each rule's accuracy on good and on bad ones, given that it votes.

    Most rules see one kind of fault, so a document counts as bad at the start
    if any rule says so, and a prior as heavy as the data holds that rules are
    right on good documents and that most documents are good (else faults that
    exclude each other look like independent noise). No rule may vote for good more often on bad documents
    than on good ones: its votes would only swap the classes' names.
    """
    if not patterns:
        return prior, []
    n_rules = len(next(iter(patterns)))
    post = {p: 1 / (1 + math.exp(6 * p.count(-1) - 4)) for p in patterns}
    share, right = prior, [(0.7, 0.7)] * n_rules
    for _ in range(rounds):
        total = sum(patterns.values())
        share = (sum(n * post[p] for p, n in patterns.items()) + prior * total) / (2 * total)
        right = []
        for j in range(n_rules):
            good = {v: sum(n * post[p] for p, n in patterns.items() if p[j] == v) + SMOOTH for v in (1, -1)}
            bad = {v: sum(n * (1 - post[p]) for p, n in patterns.items() if p[j] == v) + SMOOTH for v in (1, -1)}
            on_good = (good[1] + 0.999 * total) / (good[1] + good[-1] + total)
            right.append((on_good, max(1 - on_good, bad[-1] / (bad[1] + bad[-1]))))
        post = {p: 1 / (1 + math.exp(-_logit(p, share, right))) for p in patterns}
    return share, right


def _weights(right: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Log-odds that a vote for good, and one for bad, adds."""
    return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in
            ((min(max(x, 0.001), 0.999) for x in pair) for pair in right)]


def _logit(pattern: Sequence[int], share: float, right: Sequence[tuple[float, float]]) -> float:
    share = min(max(share, 0.001), 0.999)
    got = math.log(share / (1 - share)) + sum(w[0] if v == 1 else w[1] if v == -1 else 0
                                              for v, w in zip(pattern, _weights(right)))
    return max(-500.0, min(500.0, got))


def quality(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all if none are named) with the text
    counts, ``votes`` (array in the order of RULES), ``base_failed``,
    ``posterior`` (probability of being good) and ``kept``.

    The counts are computed once and written; the EM runs over documents that
    pass the base rules, all of them."""
    added = ["votes", "base_failed", "posterior", "kept"]
    counted = text_counts(docs, text)
    keep = [c for c in counted.columns if c in (*COUNTS, *MORE) or carry is None or c in carry]
    judged = frames.without(counted.select(*[f"`{c}`" for c in keep]), added) \
        .withColumn("votes", F.array(*[v.cast("int") for v in votes().values()])).withColumn("base_failed", base_failed())
    judged = frames.stored(judged, "votes")
    rows = judged.where("NOT base_failed").groupBy("votes").count().collect()  # 3 ** rules at most
    patterns = {tuple(r["votes"]): r["count"] for r in rows}
    share, right = estimate(patterns)
    share = min(max(share, 0.001), 0.999)
    logit = F.lit(math.log(share / (1 - share)))
    for j, (good, bad) in enumerate(_weights(right) if patterns else ()):
        logit = logit + F.when(F.col("votes")[j] == 1, good).when(F.col("votes")[j] == -1, bad).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-logit))
    return judged.withColumn("posterior", posterior) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
