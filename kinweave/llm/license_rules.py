"""License scans by ordered signature rules, in DataFrame expressions only.

A text becomes lower-case words with one blank between. A rule of ``license_table`` is tried where one of its keywords is
among them; where it matches, it claims an interval of words. Overlapping claims are settled by priority: a claim goes where one of
higher priority, or of the same priority and standing first (the longer, then the earlier rule), holds its whole interval. Claims
that overlap in part both stay. As holding is transitive, whether a claim goes doesn't depend on claims that have gone
themselves: one pass over the claims by start tells it, with the farthest end so far for each priority.

Three phrases (``BASE``) are found by themselves besides, word by word; their labels always stay.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows get equal results. Letters beyond ASCII
are parts of words (lower-cased too, which makes no word of BASE from another). Very long texts are scanned whole; claims of one rule don't overlap each other. An
empty table gives an empty table. Other columns are carried by ``detections`` on request and not read otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.license_table import RULES, Rule

#: Phrases and labels of the base, fixed values.
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What a place of a base phrase is worth as evidence.
BASE_WEIGHT = 0.9
#: What stands between lower-case words: ASCII other than digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PRIORITIES = sorted({r.priority for r in RULES}, reverse=True)
_GROUPS = "array<struct<keywords:array<string>,rules:array<struct<number:int,label:string,priority:int,weight:double,regex:string>>>>"
_SPAN = "struct<start:int,stop:int,priority:int,number:int,label:string,weight:double>"
#: Items folded before their spans are put away: an append copies what was appended since, not all before it.
CHUNK = 512


def split_words(text: Column) -> Column:
    """The words of a text in lower case; where it begins or ends with something else, the first or the last is empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN)


def grouped(rules: list[Rule]) -> Column:
    """The rules by keywords, as a constant."""
    groups = [{"keywords": k, "rules": [{"number": r.number, "label": r.label, "priority": r.priority, "weight": r.weight, "regex": r.regex} for r in some]} for k, some in groupby(rules, lambda r: r.keywords)]
    return F.from_json(F.lit(json.dumps(groups)), _GROUPS)


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, " ", ""))


def _gathered(items: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """The spans that a fold over the items appends to ``spans``, in time nearly linear. ``step`` gives the other fields of the state and the spans so far."""
    none = F.array().cast(f"array<{_SPAN}>")
    state = lambda fields, spans: F.struct(*[c.alias(n) for n, c in fields.items()], spans.alias("spans"))

    def chunk(held: Column, k: Column) -> Column:
        fields = {n: held["now"][n] for n in start}
        now = F.aggregate(F.slice(held["items"], k * CHUNK + 1, CHUNK), state(fields, none), lambda s, x: state(*step(s, x)))
        return F.struct(held["items"].alias("items"), now.alias("now"), F.array_append(held["parts"], held["now"]["spans"]).alias("parts"))

    held = F.struct(items.alias("items"), state(start, none).alias("now"), F.array().cast(f"array<array<{_SPAN}>>").alias("parts"))
    chunks = F.sequence(F.lit(0), F.floor(F.size(items) / CHUNK).cast("int"))
    return F.aggregate(chunks, held, chunk, lambda s: F.flatten(F.array_append(s["parts"], s["now"]["spans"])))


def _claims(norm: Column, rule: Column) -> Column:
    """The intervals of words where the rule matches: pieces between matches and matches, one after the other, give the places. A match holds the blanks before its words."""
    found = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
    pieces = F.split(norm, rule["regex"])
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(_blanks(p).alias("before"), _blanks(m).alias("inside")))

    # ``at``: words so far; a word has one blank in front, its own.
    def add(state: Column, step: Column) -> tuple[dict[str, Column], Column]:
        begin = state["at"] + step["before"]
        span = F.struct(begin.alias("start"), (begin + step["inside"]).alias("stop"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return {"at": begin + step["inside"]}, F.array_append(state["spans"], span)

    return _gathered(steps, {"at": F.lit(0)}, add)


def _settled(claims: Column) -> Column:
    """Claims that stay, by start. In the order of start, longer, higher priority and earlier rule, whatever holds a claim stands before it."""
    key = lambda s: F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), (-s["priority"]).alias("c"), s["number"].alias("d"), s.alias("s"))
    ordered = F.transform(F.sort_array(F.transform(claims, key)), lambda x: x["s"])
    names = [f"p{p}" for p in _PRIORITIES]

    def step(state: Column, s: Column) -> tuple[dict[str, Column], Column]:
        held = F.lit(False)
        for p, n in zip(_PRIORITIES, names, strict=True):
            held = held | ((s["priority"] <= p) & (state[n] >= s["stop"]))
        ends = {n: F.when(s["priority"] == p, F.greatest(state[n], s["stop"])).otherwise(state[n]) for p, n in zip(_PRIORITIES, names, strict=True)}
        return ends, F.when(held, state["spans"]).otherwise(F.array_append(state["spans"], s))

    return _gathered(ordered, {n: F.lit(-1) for n in names}, step)


def _places(w: Column, phrase: str) -> Column:
    """Where the phrase's words stand, from 0."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(w, i + k) == part)
        return out

    return F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), here)


def found(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, words, claims (all), stay (those that stay) and base (places by label) of each row. Words, labels and weights of a claim are in its struct; an interval is from ``start`` up to, not with, ``stop``, in words."""
    w, norm, hits = F.col("_w"), F.col("_norm"), F.col("_hits")
    keywords = sorted({k for r in rules for k in r.keywords} | {max(phrase.split(), key=len) for phrase in BASE})
    rows = df.select(F.col(key).alias("key"), F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"), split_words(F.col(text)).alias("_w"))
    n = F.size(w) - (w[0] == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
    rows = rows.select("key", "carried", n.cast("long").alias("n_words"), "_w", F.array_intersect(w, F.array(*map(F.lit, keywords))).alias("_hits"))
    # Only texts with a keyword keep their words.
    clean = F.when(F.size(hits) > 0, F.filter(w, lambda x: x != ""))
    rows = rows.select("key", "carried", "n_words", "_hits", clean.alias("_w"))
    rows = rows.select("*", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_norm"))
    tried = F.flatten(F.transform(F.filter(grouped(rules), lambda g: F.arrays_overlap(g["keywords"], hits)), lambda g: g["rules"]))
    claims = F.when(norm.isNotNull(), F.flatten(F.transform(F.filter(tried, lambda r: F.rlike(norm, r["regex"])), lambda r: _claims(norm, r))))
    none = F.array().cast(f"array<{_SPAN}>")
    nowhere = F.array().cast("array<int>")
    base = [F.when(F.contains(norm, F.lit(f" {phrase} ")), _places(w, phrase)).otherwise(nowhere).alias(label) for phrase, label in BASE.items()]
    rows = rows.select("key", "carried", "n_words", F.struct(*base).alias("base"), F.coalesce(claims, none).alias("claims"))
    return rows.select("*", F.when(F.size("claims") > 0, _settled(F.col("claims"))).otherwise(none).alias("stay"))


def detections(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each claim that stays: key, start, stop, priority, rule (its number), label, weight; and ``carried``."""
    rows = found(df, key, text, rules, carry).select(F.col("key").alias(key), *(["carried"] if carry else []), F.explode("stay").alias("s"))
    return rows.select(*[c for c in rows.columns if c != "s"], "s.start", "s.stop", "s.priority", F.col("s.number").alias("rule"), "s.label", "s.weight")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_claims and n_stay of each row. The score is the greatest weight among base places and claims that stay."""
    every = F.concat(*[F.col(f"base.{label}") for label in BASE.values()])
    labelled = F.array_compact(F.array(*[F.when(F.size(F.col(f"base.{label}")) > 0, F.lit(label)) for label in BASE.values()]))
    rows = found(df, key, text, rules).select("key", "n_words", every.alias("_every"), labelled.alias("_base"), "claims", "stay")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    weight = F.greatest(F.coalesce(F.array_max(F.transform("stay", lambda s: s["weight"])), F.lit(0.0)), F.when(F.size("_every") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0)))
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        F.size("_every").cast("long").alias("n_base"),
        F.array_min("_every").cast("long").alias("first_word"),
        F.array_max("_every").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.concat("_base", F.transform("stay", lambda s: s["label"]))).alias("labels"),
        weight.alias("score"),
        F.size("claims").cast("long").alias("n_claims"),
        F.size("stay").cast("long").alias("n_stay"),
    )
