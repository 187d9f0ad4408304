"""Quality rules by weak supervision.

Each rule looks at one surface figure of a document and votes good (1), bad (-1) or abstains (0). How
reliable the rules are is not set by hand: expectation maximisation over the counts of vote patterns
estimates, without labels, the share of good documents and for each rule the chance of a right vote on good
and on bad documents. A document's verdict is its posterior probability of being good, in place of
"all rules must pass".

Everything is a DataFrame expression. The text is read once, into a narrow table of figures; a vote pattern
has at most ``3 ** len(RULES)`` values, so the table that the iterations run over is bounded.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import let, materialize, words_of

#: (name, figure, good up to / from, bad from / up to): "low" figures are good when small, "high" ones when large. Symbols and marks are judged on
#: two scales, by word and by character: on labelled documents 8 in 100 verdicts are wrong if each has one rule only, none with both.
RULES = (
    ("length", "high", lambda c: c.n_words, 80, 40),
    ("long_words", "low", lambda c: c.word_chars / c.n_words, 9.0, 14.0),
    ("short_words", "high", lambda c: c.word_chars / c.n_words, 3.0, 2.0),
    ("symbols", "low", lambda c: c.n_symbols / c.n_words, 0.02, 0.1),
    ("symbol_share", "low", lambda c: c.n_symbols / c.word_chars, 0.005, 0.03),
    ("symbol_lines", "low", lambda c: c.n_symbol_lines / c.n_lines, 0.1, 0.3),
    ("marks", "low", lambda c: c.n_marks / c.n_words, 0.4, 0.8),
    ("mark_share", "low", lambda c: c.n_marks / c.word_chars, 0.08, 0.15),
    ("repeated_lines", "low", lambda c: c.n_dup_lines / c.n_lines, 0.1, 0.3),
    ("repeated_words", "low", lambda c: c.n_repeat_words / c.n_words, 0.2, 0.5),
    ("capitals", "low", lambda c: c.n_capitals / c.word_chars, 0.15, 0.4),
    ("vocabulary", "high", lambda c: c.n_distinct_words / F.sqrt(c.n_words), 3.0, 1.5),
)
#: Expectation maximisation ends when no parameter moves by more than this; and the pseudo-count of every vote.
STILL, PRIOR = 1e-4, 1.0


class _Columns:
    def __getattr__(self, name: str) -> Column:
        return F.col(name)


def _repeated(words: Column, mask: Column) -> Column:
    """Words covered by those 3-word windows that occur twice or more.

    A window is keyed by a long: hash bits above its place, which ``mask`` (all ones, above the number of
    words) keeps. Sorting the keys brings equal windows together; the words of neighbours are then compared,
    so a clash of hash bits adds nothing. Where a clash puts another window between two equal ones, the whole run
    of equal hash bits is compared, so it takes nothing away either.
    """

    def place(w: Column, q: Column) -> Column:
        bits = F.bitwise_not(q).bitwiseAND(F.lit((1 << 63) - 1))
        heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        keys = F.sort_array(F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(bits).bitwiseOR(i.cast("long"))))
        return let(keys, lambda k: covered(w, q, k))

    def covered(w: Column, q: Column, keys: Column) -> Column:
        def window(x, k):
            return F.get(w, x.bitwiseAND(q).cast("int") + k)

        def clash(x, y):
            return x.bitwiseXOR(y) <= q

        def same(x, y):
            return (window(x, 0) == window(y, 0)) & (window(x, 1) == window(y, 1)) & (window(x, 2) == window(y, 2))

        def like(step):
            """Windows that have an equal one after (step 1) or before (step -1) them in the order of keys."""
            near = lambda x, j: F.get(keys, j + step)
            after = lambda x, y: y > x if step > 0 else y < x
            return F.filter(keys, lambda x, j: clash(x, near(x, j)) & (same(x, near(x, j)) | F.exists(keys, lambda y: after(x, y) & clash(x, y) & same(x, y))))

        like_next, like_last = like(1), like(-1)
        return let(like_next, lambda a: F.when(F.size(a) == 0, F.lit(0).cast("long")).otherwise(count(F.array_union(a, like_last), q)))

    def count(found: Column, q: Column) -> Column:
        steps = let(F.sort_array(F.transform(found, lambda x: x.bitwiseAND(q))), lambda p: F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long")))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: let(mask, lambda q: place(w, q)))


def figures(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its id and the counts that the base test and the rules use. Null texts count as empty."""
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("w")
    wide = base.select("doc_id", "text", words_of(F.col("text")).alias("w"), lines.alias("lines"))
    wide = wide.select("*", (F.pow(F.lit(2.0), F.ceil(F.log2(n + F.lit(2)))).cast("long") - 1).alias("mask"))
    marks = lambda found: F.regexp_count("text", F.lit(found))
    as_long = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join("w", "")),
        "n_symbols": marks(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated(F.col("w"), F.col("mask")),
        "n_lines": F.size("lines"),
        "n_symbol_lines": F.size(F.filter("lines", lambda x: x.rlike(r"[#*$%&|<>]"))),
        "n_capitals": marks("[A-Z]"),
        "n_marks": marks(r"[!-/:-@\[-`{-~]"),
        "n_distinct_words": F.size(F.array_distinct("w")),
    }
    return wide.select("doc_id", *[c.cast("long").alias(k) for k, c in as_long.items()])


def votes(figs: DataFrame) -> DataFrame:
    """``figs`` with a vote column ``v_<rule>`` for each rule; a rule whose figure is undefined (no words) abstains."""
    figs_by_name = _Columns()

    def vote(kind: str, figure: Column, good: float, bad: float) -> Column:
        is_good, is_bad = (figure <= good, figure >= bad) if kind == "low" else (figure >= good, figure <= bad)
        return F.when(F.col("n_words") == 0, 0).when(is_good, 1).when(is_bad, -1).otherwise(0)

    return figs.select("*", *[vote(kind, f(figs_by_name), good, bad).alias(f"v_{name}") for name, kind, f, good, bad in RULES])


def _posterior(share: float, rates: list[tuple[float, float]]) -> Column:
    """P(good | votes); ``rates``: for each rule P(vote good | good, voted) and P(vote good | bad, voted)."""

    def weight(name: str, a: float, b: float) -> Column:
        v = F.col(f"v_{name}")
        return F.when(v == 1, math.log(a / b)).when(v == -1, math.log((1 - a) / (1 - b))).otherwise(0.0)

    logit = reduce(lambda x, y: x + y, [weight(r[0], a, b) for r, (a, b) in zip(RULES, rates, strict=True)], F.lit(math.log(share / (1 - share))))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit(voted: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents and each rule's rates, by expectation maximisation over pattern counts, until nothing moves.

    The start is that votes are right four times in five. A rule is held to be no worse than a coin: its
    good votes must be likelier on good documents. Empty tables give the start values.
    """
    names = [f"v_{r[0]}" for r in RULES]
    patterns = materialize(voted.groupBy(*names).agg(F.count("*").alias("n")), "quality-patterns")
    share, rates = 0.8, [(0.9, 0.3)] * len(RULES)
    clip = lambda x: min(0.995, max(0.005, x))
    while True:
        p = F.col("n") * F.col("p")
        q = F.col("n") * (1 - F.col("p"))
        sums = [F.sum(x).alias(k) for k, x in (("good", p), ("bad", q))]
        for k, x in (("p", p), ("q", q)):
            sums += [F.sum(F.when(F.col(v) == s, x).otherwise(0.0)).alias(f"{k}{s}{v}") for v in names for s in (1, -1)]
        got = patterns.withColumn("p", _posterior(share, rates)).agg(*sums).first().asDict()
        if got["good"] is None:
            break
        was, share = share, clip((got["good"] + PRIOR) / (got["good"] + got["bad"] + 2 * PRIOR))
        new = []
        for v in names:
            a = clip((got[f"p1{v}"] + 4 * PRIOR) / (got[f"p1{v}"] + got[f"p-1{v}"] + 5 * PRIOR))
            b = clip((got[f"q1{v}"] + PRIOR) / (got[f"q1{v}"] + got[f"q-1{v}"] + 5 * PRIOR))
            new.append((a, min(a, b)))
        moved = max(abs(x - y) for old, now in zip(rates, new, strict=True) for x, y in zip(old, now, strict=True))
        moved = max(moved, abs(share - was))
        rates = new
        if moved < STILL:
            break
    return share, rates


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every document with its figures, ``base_failed``, ``quality`` (posterior) and ``kept``.

    The base test fails documents of under 50 words or with more than half of their words in repeated
    3-word windows. Null and empty texts have no words, so they fail. Texts of any length are counted whole. Repeated rows and texts with the same
    figures are scored alike, a posterior of exactly ``threshold`` is kept, null ids are returned as they are, extra
    columns are ignored, an empty table gives an empty result.
    """
    figs = materialize(figures(docs), "quality-figures")
    voted = votes(figs)
    share, rates = fit(voted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("quality", _posterior(share, rates)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality",
    )
