"""Match probabilities of pairs: native expressions, external models in Arrow batches, and a trainable one."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scores import jaccard, match_probability
from kinweave.functions.text import record_text, tokens


class Strategy(Protocol):
    """What a scorer of pairs offers: a column over l_* and r_* columns."""

    def probability(self) -> Column: ...


class TokenJaccard:
    """Jaccard of the records' tokens."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def token_set(self, prefix: str = "") -> Column:
        return tokens(F.concat_ws(" ", *[F.col(f"{prefix}{c}").cast("string") for c in self.columns]))

    def probability(self) -> Column:
        return jaccard(self.token_set("l_"), self.token_set("r_"))

    def identity(self) -> Column:
        """What decides a record's probabilities."""
        return F.array_join(F.array_sort(self.token_set()), " ")

    def least_jaccard(self, least: float) -> float | None:
        """The token Jaccard that pairs of a probability of ``least`` or more have at least; 0: they share a token, or are 0."""
        return max(least, 0.0)


class EditDistance:
    """1 - Levenshtein distance over the longer text's length."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def probability(self) -> Column:
        text = lambda p: F.lower(F.concat_ws(" ", *[F.col(f"{p}{c}").cast("string") for c in self.columns]))
        a, b = text("l_"), text("r_")
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


class Logistic:
    """Likeness of tokens and of characters, weighed by a logistic regression that ``fit`` learns; a plain expression."""

    def __init__(self, columns: list[str], weights: list[float], intercept: float):
        self.columns, self.weights, self.intercept = columns, weights, intercept

    @staticmethod
    def features(columns: list[str]) -> list[Column]:
        return [TokenJaccard(columns).probability(), EditDistance(columns).probability()]

    @classmethod
    def fit(cls, enriched: DataFrame, columns: list[str], label: str = "label") -> Logistic:
        """Learns from labelled pairs (l_*, r_*); without any, there is nothing to learn and ValueError is raised."""
        rows = enriched.select(F.col(label).cast("double").alias("y"), *[f.alias(f"f{i}") for i, f in enumerate(cls.features(columns))]).where("y IS NOT NULL")
        if rows.isEmpty():
            raise ValueError("no labelled pairs to learn from")
        model = trained(rows, [c for c in rows.columns if c != "y"], "y").stages[-1]
        return cls(columns, [float(w) for w in model.coefficients], float(model.intercept))

    def token_set(self, prefix: str = "") -> Column:
        return TokenJaccard(self.columns).token_set(prefix)

    def identity(self) -> Column:
        return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in self.columns]))

    def least_jaccard(self, least: float) -> float | None:
        """Where the likeness of characters, 1 at most, can't reach ``least`` by itself; else None, as pairs without a common token may."""
        by_tokens, by_characters = self.weights
        if by_tokens <= 0 or not 0 < least < 1:
            return None
        needed = (math.log(least / (1 - least)) - self.intercept - max(by_characters, 0.0)) / by_tokens
        return needed if needed > 0 else None

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for w, f in zip(self.weights, self.features(self.columns), strict=True):
            z = z + F.lit(w) * f
        return 1.0 / (1.0 + F.exp(-z))


class External:
    """A model outside: ``load()`` runs once in a task and returns a function from text lines to two logits a line. A record is its id first and its values as they are, nulls left out."""

    def __init__(self, columns: list[str], load: Callable[[], Callable[[list[str]], list[tuple[float, float]]]], key: str | None = "id"):
        self.columns, self.load, self.key = columns, load, key

    def of_texts(self, left: Column, right: Column) -> Column:
        """The probability of two records' texts: one model a task, whole Arrow batches of lines at a time."""
        load = self.load

        @F.pandas_udf("struct<l0:double,l1:double>")
        def logits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for part in parts:
                found = model(part.tolist())
                yield pd.DataFrame({"l0": [float(x) for x, _ in found], "l1": [float(y) for _, y in found]})

        both = logits(F.concat_ws("\t", left, right, F.lit("0")))
        return match_probability(both["l0"], both["l1"])

    def probability(self) -> Column:
        names = [*([self.key] if self.key else []), *[c for c in self.columns if c != self.key]]
        return self.of_texts(record_text(names, "l_", "inference", clean=False), record_text(names, "r_", "inference", clean=False))


class TextPairs:
    """A plain function of two texts, in batches."""

    def __init__(self, match: Callable[[str, str], float]):
        self.match = match

    def of_texts(self, left: Column, right: Column) -> Column:
        match = self.match

        @F.pandas_udf("double")
        def scored(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([float(match(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

        return scored(left, right)


def strategy(name: str, *args, **options) -> Strategy:
    """A new scorer by its name; nothing is shared between calls."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown scorer: {name}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[name](*args, **options)


def pairwise_baseline(enriched: DataFrame, scorer: Strategy, threshold: float = 0.5) -> DataFrame:
    """Pairs with prob and pred, each pair by itself."""
    return enriched.withColumn("prob", scorer.probability()).withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def trained(train: DataFrame, features: list[str], label: str = "label"):
    """A logistic regression over numeric pair features; ``transform`` of the result adds ``probability`` and ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), LogisticRegression(featuresCol="_features", labelCol=label)]).fit(train)


class TextMatcher:
    """A matcher of two texts learned from labelled pairs: which tokens both share, which stand on one side only, and which of the left stand against which of the right, each hashed to one of 2^bits weights. A plain expression, for pairs of records and for texts."""

    #: Strengths of regularisation that are tried; the best on the valid pairs stays.
    TRIED = (0.3, 0.1, 0.03, 0.01, 0.003)

    def __init__(self, columns: list[str], weights: list[float], intercept: float):
        self.columns, self.weights, self.intercept = columns, weights, intercept

    @staticmethod
    def features(left: Column, right: Column, n: int) -> Column:
        """Numbers of weights, one for each feature: shared tokens, tokens of one side, and pairs of those."""
        a, b = tokens(left), tokens(right)
        at = lambda kind, *x: F.pmod(F.xxhash64(F.lit(kind), *x), F.lit(n)).cast("int")
        both, only_a, only_b = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
        crossed = F.flatten(F.transform(only_a, lambda x: F.transform(only_b, lambda y: at("x", x, y))))
        shared = F.flatten(F.transform(both, lambda x: F.array(at("=", x), at("shared"))))
        single = lambda side: F.flatten(F.transform(side, lambda x: F.array(at("1", x), at("single"))))
        return F.concat(shared, single(only_a), single(only_b), crossed)

    @classmethod
    def fit_texts(cls, train: DataFrame, valid: DataFrame, columns: list[str], left: Column, right: Column, label: str = "label", bits: int = 12) -> TextMatcher:
        """Learns from ``train``; of TRIED the strength with the best F1 on ``valid`` (of equal ones the stronger) stays. Without labelled pairs of both kinds ValueError is raised."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizerModel

        n = 1 << bits
        counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], inputCol="_f", outputCol="_v")
        rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), cls.features(left, right, n).cast("array<string>").alias("_f"))
        if rows.select("_y").distinct().count() < 2:
            raise ValueError("no labelled pairs of both kinds to learn from")
        made = counted.transform(rows).select("_y", "_v").cache()
        best, told = None, valid.where(F.col(label).isNotNull())
        for strength in cls.TRIED:
            model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=strength, standardization=False).fit(made)
            tried = cls(columns, [float(w) for w in model.coefficients.toArray()], float(model.intercept))
            y, p = F.col(label) == 1, tried.of_texts(left, right) >= 0.5
            right_, wrong = told.agg(F.sum((y & p).cast("int")).alias("a"), F.sum((y != p).cast("int")).alias("b")).first()
            f1 = 2 * (right_ or 0) / (2 * (right_ or 0) + (wrong or 0)) if (right_ or 0) + (wrong or 0) else 0.0
            if best is None or f1 > best[0]:
                best = f1, tried
        made.unpersist()
        return best[1]

    @classmethod
    def fit(cls, train: DataFrame, valid: DataFrame, columns: list[str], label: str = "label", bits: int = 12) -> TextMatcher:
        """The same of enriched pairs (l_*, r_*)."""
        return cls.fit_texts(train, valid, columns, *(record_text(columns, p, "inference", clean=False) for p in ("l_", "r_")), label, bits)

    def of_texts(self, left: Column, right: Column) -> Column:
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        z = F.aggregate(self.features(left, right, len(self.weights)), F.lit(float(self.intercept)), lambda s, i: s + F.get(weights, i))
        return 1.0 / (1.0 + F.exp(-z))

    def probability(self) -> Column:
        return self.of_texts(*(record_text(self.columns, p, "inference", clean=False) for p in ("l_", "r_")))


STRATEGIES = {"TOKEN_JACCARD": TokenJaccard, "EDIT_DISTANCE": EditDistance, "LOGISTIC": Logistic, "EXTERNAL": External, "TEXT_MATCHER": TextMatcher}
