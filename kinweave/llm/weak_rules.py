"""Quality rules combined by weak supervision, in DataFrame expressions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains). Expectation-maximisation estimates, from the votes of all
documents and no labels, how often each rule casts each vote on good and on bad documents; a document's verdict is
its posterior probability of being good. The votes of the whole corpus enter through the counts of distinct vote
vectors, of which there are at most 3 to the number of rules, whatever the number of rows.

Defined results: a null or empty text has no words and fails the base rules; repeated rows get equal verdicts; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import kept

#: White space between words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Printable ASCII other than letters, digits and the blank.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts for each whole text. Windows of five words are compared by 64-bit hashes; where some repeat, their places are ordered to count the words they cover. No step is worse than n log n in a text's words."""
    t = F.col("_t")
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.select(
        key,
        "_t",
        F.filter(F.split(F.translate(t, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("_lines"),
        F.length(t).alias("_chars"),
        _without(t, BLANKS).alias("word_chars"),
        _without(t, SYMBOLS).alias("_plain"),
        _without(t, CAPITALS).alias("_small"),
        _without(t, "!").alias("_calm"),
        _without(t, MARKS).alias("_bare"),
    )
    w = F.col("_w")
    hashes = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        key,
        F.size(w).cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        (F.col("_chars") - F.col("_plain")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.col("_chars") - F.col("_small")).cast("long").alias("n_capitals"),
        (F.col("_chars") - F.col("_calm")).cast("long").alias("n_shouts"),
        (F.col("_chars") - F.col("_bare")).cast("long").alias("n_marks"),
        hashes.alias("_h"),
    )
    h = F.col("_h")
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_s", ordered).drop("_h")
    s = F.col("_s")
    same = lambda x, k: x["h"].eqNullSafe(F.get(s, k)["h"])
    twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    rows = rows.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("_s")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate(F.col("_p"), start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("_p")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``features``. Ratios with no words abstain."""
    n = F.col("n_words")
    per_word = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": _vote(n < 10, n >= 40),
        "symbols": _vote(per_word("n_symbols") > 0.1, (n > 0) & (per_word("n_symbols") < 0.03)),
        "repeats": _vote(per_word("n_repeat_words") > 0.2, (n >= 20) & (per_word("n_repeat_words") < 0.05)),
        "lines": _vote(F.col("n_dup_lines") / lines > 0.5, (F.col("n_lines") > 1) & (F.col("n_dup_lines") / lines < 0.1)),
        "word_length": _vote((n > 0) & ((per_word("word_chars") < 2.5) | (per_word("word_chars") > 12)), (per_word("word_chars") >= 3) & (per_word("word_chars") <= 10)),
        "capitals": _vote(per_char("n_capitals") > 0.4, (n > 0) & (per_char("n_capitals") < 0.15)),
        "marks": _vote(per_word("n_marks") > 0.6, (n > 0) & (per_word("n_marks") < 0.35)),
        "shouts": _vote(per_word("n_shouts") > 0.3, (n > 0) & (per_word("n_shouts") < 0.1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: What rules are taken to do before the votes are seen: P(vote) on bad and on good documents. Good documents get few bad votes; bad ones fail some rules and meet others.
BELIEF = {-1: (0.25, 0.005), 0: (0.1, 0.095), 1: (0.65, 0.9)}


def estimate(counts: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200, prior: float = 0.85, belief: float = 0.2) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over distinct vote vectors and their counts. Returns P(good) and, by rule and vote, (P(vote | bad), P(vote | good)). BELIEF fixes what good means: it is the start, and it weighs in each step as ``belief`` times the number of documents (one vote at least)."""
    p, rate = prior, [dict(BELIEF) for _ in range(rules)]
    weight = max(1.0, belief * sum(n for _, n in counts))
    last = -math.inf
    for _ in range(rounds):
        good_all = bad_all = likelihood = 0.0
        seen = [{v: [weight * x, weight * y] for v, (x, y) in BELIEF.items()} for _ in range(rules)]
        for vote, n in counts:
            bad = math.log(1 - p) + sum(math.log(rate[r][v][0]) for r, v in enumerate(vote))
            good = math.log(p) + sum(math.log(rate[r][v][1]) for r, v in enumerate(vote))
            top = max(bad, good)
            total = top + math.log(math.exp(bad - top) + math.exp(good - top))
            q = math.exp(good - total)
            likelihood += n * total
            good_all, bad_all = good_all + n * q, bad_all + n * (1 - q)
            for r, v in enumerate(vote):
                seen[r][v][0] += n * (1 - q)
                seen[r][v][1] += n * q
        p = (good_all + 1) / (good_all + bad_all + 2)
        rate = [{v: (x[0] / sum(y[0] for y in s.values()), x[1] / sum(y[1] for y in s.values())) for v, x in s.items()} for s in seen]
        if abs(likelihood - last) < 1e-9 * max(1.0, abs(likelihood)):
            break
        last = likelihood
    return p, rate


def posterior(p: float, rate: list[dict[int, tuple[float, float]]], names: list[str]) -> Column:
    """P(good) as an expression over the vote columns."""
    logit = F.lit(math.log(p / (1 - p)))
    for name, r in zip(names, rate, strict=True):
        odds = {v: math.log(good / bad) for v, (bad, good) in r.items()}
        logit = logit + F.when(F.col(name) == 1, F.lit(odds[1])).when(F.col(name) == -1, F.lit(odds[-1])).otherwise(F.lit(odds[0]))
    return 1.0 / (1.0 + F.exp(-logit))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row: the base counts, base_failed, the votes (vote_*), quality (posterior) and kept.

    The texts are read once: the counts and votes, a few numbers a row, are kept in the shared folder, and both the
    estimation and the result read them there."""
    names = [f"vote_{k}" for k in votes()]
    rows = kept(features(df, key, text).withColumns({f"vote_{k}": v for k, v in votes().items()}).withColumn("base_failed", base_failed()), "votes")
    counts = [(tuple(r[:-1]), r[-1]) for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()]  # at most 3 ** 8 rows
    p, rate = estimate(sorted(counts), len(names))
    rows = rows.withColumn("quality", posterior(p, rate, names))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
