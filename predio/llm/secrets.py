"""Secrets in whole texts, with SQL functions only: fixed patterns, and random strings by Markov models.

Two character models give the chance of each character, or of the end, after the one before.  The
ordinary one is learnt from the runs of key characters that recur in the documents, less those that
stand in labelled secrets; the random one from the labelled secrets, which are the values that the patterns
find.  Every run of 8 or more key characters is scored by both models, equal runs once; where it touches
no pattern's span, it is a secret if their log-likelihood ratio exceeds the odds.

Spans come from splitting a text at its matches: the lengths of pieces and matches add up to
the offsets, in code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from predio.llm.lines import _may_match as may_match
from predio.scale import settle

# Kinds in order, their patterns, the group measured, its least length, and
# what a text must hold to be searched at all.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = [
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
RANDOM = "random"
_KEY = "[A-Za-z0-9+/_=-]"
_NOT_KEY = "[^A-Za-z0-9+/_=-]+"
#: Least length of a run of key characters that is scored.
LEAST = 8
#: Odds against a run that the likelihood ratio must exceed.
ODDS = 1e4
ALPHABET = 128
#: The sets of characters that keys are drawn from are unions of these.
CLASSES = ["[0-9]", "[a-z]", "[A-Z]", "[+/_=-]"]
KEY_CODES = [i for i in range(1, ALPHABET) if chr(i).isalnum() or chr(i) in "+/_=-"]
#: Stands before the first and after the last character of a run.
EDGE = 0
#: Observations that a character's overall frequency counts for.
BACK_OFF = 10.0
#: Share of a uniform draw in the random model.
UNIFORM = 0.5


def _may_hold(kind: str, text: Column) -> Column:
    if kind == "assign":
        low = F.lower(text)
        return F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    return text.rlike("[0-9a-f]{24}")


def _matches(kind: str, pattern: str, group: int, text: Column) -> Column:
    """Kind, number, length of the piece before, length and measured value of every match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    each = F.arrays_zip(before.alias("gap"), F.transform(found, lambda x: F.length(x)).alias("size"), value.alias("value"))
    rows = F.transform(
        F.slice(each, 1, F.size(found)),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")
        ),
    )
    return F.when(_may_hold(kind, text), rows)


def _spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, _print, kind, start, end, value`` of every match of a pattern that is long enough."""
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.col(text).alias("_text"))
    found = []
    for kind, pattern, group, _ in BASE:
        none = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:string>>")
        found.append(F.coalesce(_matches(kind, pattern, group, F.col("_text")), none))
    # (Outer: else Spark searches a second time to see whether there are matches.)
    rows = rows.select("_key", "_print", F.explode_outer(F.concat(*found)).alias("m")).select("_key", "_print", "m.*")
    rows = _placed(rows.filter("kind is not null"))
    least = F.lit(0)
    for kind, _, _, size in BASE:
        least = F.when(F.col("kind") == kind, size).otherwise(least)
    return rows.filter(F.length("value") >= least).drop("i")


def _placed(rows: DataFrame) -> DataFrame:
    """Offsets of matches ``_key, _print, kind, i, gap, size, value``: those of a kind are added up in their order."""
    # Repeated rows find the same.
    rows = rows.dropDuplicates(["_key", "_print", "kind", "i"])
    so_far = Window.partitionBy("_key", "_print", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return rows.select("_key", "_print", "kind", "i", (end - F.col("size")).alias("start"), end.alias("end"), "value")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _random_runs(runs: DataFrame, models: tuple[list[float], list[float]], odds: float) -> DataFrame:
    """``_run, _hash`` of the runs of ``runs`` whose likelihood ratio exceeds the odds; each is scored once."""
    long = runs.filter(F.length("_run") >= LEAST).filter(likelihood_ratio(F.col("_run"), models) > math.log(odds))
    return settle(long.select("_run", F.xxhash64("_run").alias("_hash")), "random_runs")


def _random_spans(docs: DataFrame, random: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, _print, kind, start, end, value`` of every place where a run of the stored table ``random`` stands.

    Runs are looked up where the text is read; only texts that hold a secret are read again and hand on the
    lengths of all their runs.
    """
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.col(text).alias("_text"))
    pattern = f"{_KEY}{{{LEAST},}}"
    runs = F.regexp_extract_all(F.col("_text"), F.lit(pattern), F.lit(0))
    each = rows.select("_key", "_print", F.posexplode_outer(runs).alias("i", "_run")).filter("_run is not null")
    found = may_match(each.withColumn("_hash", F.xxhash64("_run")), random).drop("_hash").join(random.select("_run"), "_run")
    # Repeated rows find the same.
    found = settle(found.select("_key", "_print", "i", F.col("_run").alias("value")).distinct(), "random_places")

    texts = may_match(rows, settle(found.select("_print").distinct(), "texts_with_secrets"), "_print")
    sizes = F.transform(runs, lambda x: F.length(x))
    gaps = F.transform(F.split(F.col("_text"), pattern, -1), lambda x: F.length(x))
    lengths = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"))
    # (The last piece has no run behind it.)
    places = texts.select("_key", "_print", F.posexplode_outer(lengths).alias("i", "m")).filter("m.size is not null")
    placed = _placed(places.select("_key", "_print", F.lit(RANDOM).alias("kind"), "i", "m.gap", "m.size", F.lit(None).cast("string").alias("value")))
    same = placed["_key"].eqNullSafe(found["_key"]) & (placed["_print"] == found["_print"]) & (placed["i"] == found["i"])
    return placed.join(found, same).select(placed["_key"], placed["_print"], "kind", "start", "end", found["value"])


def _codes(run: Column) -> Column:
    """Codes of the characters, in one pass over a run of any length."""
    return F.transform(F.split(run, ""), lambda c: F.ascii(c))


def _pairs(runs: DataFrame) -> DataFrame:
    """Counts ``(_pair, n)`` of neighbouring characters of the runs ``_run``, ``_n`` times each, as a * 128 + b."""
    edge = F.array(F.lit(EDGE))
    pairs = lambda codes: F.zip_with(F.concat(edge, codes), F.concat(codes, edge), lambda a, b: a * ALPHABET + b)
    places = runs.select("_n", F.explode(_bound(_codes(F.col("_run")), pairs)).alias("_pair"))
    return places.groupBy("_pair").agg(F.sum("_n").alias("n"))


def _runs(rows: DataFrame, text: str) -> DataFrame:
    """How often each run of key characters occurs: ``_run, _n``."""
    runs = rows.select(F.explode_outer(F.split(F.col(text), _NOT_KEY)).alias("_run"))
    return runs.filter("_run != ''").groupBy("_run").agg(F.count("*").alias("_n"))


def transition_table(count: dict[int, int], uniform: float = 0.0) -> dict[int, float]:
    """Chance of each key character, or the end, after each key character, or the start; key a * 128 + b.

    Rare pairs back off to the frequency of their second character; ``uniform`` is the share of a draw in
    which all characters are equally likely, the end staying as learnt.
    """
    codes = [EDGE, *KEY_CODES]
    second = {b: 1 + sum(count.get(a * ALPHABET + b, 0) for a in codes) for b in codes}
    every, table = sum(second.values()), {}
    for a in codes:
        total = sum(count.get(a * ALPHABET + b, 0) for b in codes)
        seen = {b: (count.get(a * ALPHABET + b, 0) + BACK_OFF * second[b] / every) / (total + BACK_OFF) for b in codes}
        for b in KEY_CODES:
            table[a * ALPHABET + b] = (1 - uniform) * seen[b] + uniform * (1 - seen[EDGE]) / len(KEY_CODES)
        table[a * ALPHABET + EDGE] = seen[EDGE]
    return table


def train(
    docs: DataFrame, spans: DataFrame, text: str = "text", runs: DataFrame | None = None
) -> tuple[list[float], list[float]]:
    """Log-likelihood ratios of all pairs of characters (128 * 128), and shares of character sets (128 * 16).

    Labelled secrets are the values of ``spans``; ordinary runs are those that occur twice or more in all
    documents, their places inside labelled values not counted: keys that no pattern knows occur once.  The
    patterns know few kinds of keys, so the random model is half learnt and half uniform over key
    characters.  A key is drawn from one of the 15 unions of digits, small letters, capitals and marks, all
    equally likely before; the second table holds the log chance that the next character (or end) is allowed
    by a union, which the random model divides by, so that digits alone need not pass for a draw of all 67.
    ``runs`` are the counted runs of ``docs``, where they are stored already.
    """
    # A value may be found by two patterns: once per place.
    once = spans.groupBy("_key", "_print", "end").agg(F.max(F.struct(F.length("value").alias("size"), "value")).alias("v"))
    secret = settle(_runs(once.select("v.value"), "value"), "labelled_secrets")
    ordinary = (_runs(docs, text) if runs is None else runs).join(secret.select("_run", F.col("_n").alias("_taken")), "_run", "left")
    ordinary = ordinary.select("_run", (F.col("_n") - F.coalesce("_taken", F.lit(0))).alias("_n")).filter("_n > 1")
    counts = [{r["_pair"]: r["n"] for r in _pairs(runs).collect()} for runs in (secret, ordinary)]  # at most 67 * 67 rows each
    random, plain = transition_table(counts[0], UNIFORM), transition_table(counts[1])
    ratios = [math.log(random[i] / plain[i]) if i in random else 0.0 for i in range(ALPHABET * ALPHABET)]
    member = {c: sum(1 << k for k, kind in enumerate(CLASSES) if re.match(kind, chr(c))) for c in KEY_CODES}
    shares = []
    for a in range(ALPHABET):
        for chosen in range(1 << len(CLASSES)):
            known = a == EDGE or a in member
            allowed = [EDGE, *[b for b in KEY_CODES if member[b] & chosen]]
            shares.append(math.log(sum(random[a * ALPHABET + b] for b in allowed)) if known else 0.0)
    return ratios, shares


def likelihood_ratio(run: Column, models: tuple[list[float], list[float]]) -> Column:
    """Log-likelihood ratio of a run of key characters, random against ordinary."""
    # (One text that Spark folds to an array; a literal per number takes seconds to plan.)
    ratios, shares = (F.split(F.lit(",".join(map(repr, m))), ",").cast("array<double>") for m in models)
    unions = 1 << len(CLASSES)
    chosen = F.lit(0)
    for k, kind in enumerate(CLASSES):
        chosen = chosen + F.when(run.rlike(kind), 1 << k).otherwise(0)
    first = F.struct(F.lit(EDGE).alias("last"), F.lit(-math.log(unions - 1)).alias("sum"))

    def step(state: Column, code: Column, chosen: Column) -> Column:
        more = F.get(ratios, state["last"] * ALPHABET + code) - F.get(shares, state["last"] * unions + chosen)
        return F.struct(code.alias("last"), (state["sum"] + more).alias("sum"))

    return _bound(
        chosen,
        lambda union: F.aggregate(
            F.concat(_codes(run), F.array(F.lit(EDGE))), first, lambda state, code: step(state, code, union), lambda state: state["sum"]
        ),
    )


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", odds: float = ODDS) -> DataFrame:
    """One row per secret: ``key``, ``_print`` (a hash of the text), ``kind``, ``start``, ``end``, ``value``.

    Kinds are ``assign``, ``access``, ``hex`` and ``random``; offsets are code points, ``end``
    exclusive; ``value`` is the matched text, of ``assign`` what is assigned.  Spans of different base
    kinds may overlap; a random string that touches a base span is left out.  Null and empty texts hold
    no secret, very long ones are scored whole like others; rows that repeat key and text give each secret once; a missing key is passed on; an empty
    table gives an empty table; other columns are not looked at.
    """
    spans = settle(_spans(docs, key, text), "spans")
    runs = settle(_runs(docs, text), "runs")
    random = _random_spans(docs, _random_runs(runs, train(docs, spans, text, runs), odds), key, text)
    spans = spans.unionByName(random)
    base = F.col("kind") != RANDOM
    doc = Window.partitionBy("_key", "_print").orderBy("start")
    before = F.max(F.when(base, F.col("end"))).over(doc.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(doc.rangeBetween(0, Window.unboundedFollowing))
    spans = spans.withColumn("_before", before).withColumn("_after", after)
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))
    return spans.filter(base | free).select(F.col("_key").alias(key), "_print", "kind", "start", "end", "value")


def secret_summary(docs: DataFrame, key: str = "doc_id", text: str = "text", odds: float = ODDS) -> DataFrame:
    """Per row of ``docs``: the key, counts by base kind, ``base`` and ``spans`` as kind:start:end lists.

    Lists are ordered by start and then by kind; a text without secrets, a null or an empty one has empty
    lists and counts of 0.  Every row of ``docs`` gives one row, repeated ones equal rows; a missing key is
    passed on; an empty table gives an empty table; other columns are not looked at.
    """
    found = find_secrets(docs, key, text, odds)
    order = [kind for kind, *_ in BASE] + [RANDOM]
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    each = F.struct(F.col("start").alias("s"), place.alias("k"), F.col("end").alias("e"), name.alias("name"))
    listed = F.sort_array(F.collect_list(each))
    by_doc = found.groupBy(F.col(key).alias("_key"), "_print").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in order], listed.alias("_all")
    )
    by_doc = settle(
        by_doc.withColumn("base", F.array_join(F.transform(F.filter("_all", lambda x: x["k"] < len(order)), lambda x: x["name"]), ","))
        .withColumn("spans", F.array_join(F.transform("_all", lambda x: x["name"]), ","))
        .drop("_all"),
        "secrets",
    )
    rows = docs.select(F.col(key).alias("_own"), F.xxhash64(text).alias("_hash"))
    joined = rows.join(by_doc, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_print")), "left")
    return joined.select(
        F.col("_own").alias(key),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in order],
        F.coalesce("base", F.lit("")).alias("base"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
