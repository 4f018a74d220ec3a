"""License notices in whole texts, with SQL functions only.

Texts and templates become sequences of 5-word shingle hashes.  Short templates (up to 8
shingles) are compared with windows of one shingle, longer ones with windows of 12 that
overlap by half; every window has a MinHash signature, one band per hash function.

* A one-shingle window has the same minimum under every function, so it collides with a short
  template if it is the shingle that gives one of the template's minima: certain for a whole
  copy, and lost only if all of the template's (up to 6) minimal shingles are changed.
* A window of 12 and the nearest template window share at least 9 of 15 shingles, so 6 bands of
  one row miss a whole copy with a chance of 0.4 ** 6 = 0.4 % per template window.

Candidates are verified exactly: the share of the template's distinct shingles found in the
stretch of text where the template would stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from predio.scale import settle

# Names and wording of public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All rights reserved", "All rights reserved."),
]

SHINGLE, SHORT, WINDOW, BANDS = 5, 8, 12, 6
CONTAINED = 0.8
WINDOWS = "array<struct<_band:int,_at:int,_min:bigint>>"
#: Seeds that turn one shingle hash into six orders.
SEEDS = [0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x41C64E6D5851F42D, 0x5BD1E995C4CEB9FE, 0x6C62272E07BB0142]


def templates(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(texts or TEMPLATES)]
    return spark.createDataFrame(rows, "template int, license string, text string")


def _words(text: Column) -> Column:
    """Words of letters and digits in lower case, with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _whole(words: Column, start: Column, n: int) -> Column:
    """The hash of ``n`` words, fewer than a shingle has."""
    return F.xxhash64(*[F.get(words, start + j) for j in range(n)], F.lit("whole"))


def _hashes(words: Column) -> Column:
    """Hashes of all 5-word shingles of an array of words, or of the words as one if they are fewer."""
    n = F.size(words)
    full = F.transform(
        F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])
    )
    found = F.when(n >= SHINGLE, full).when(F.get(words, 0) == "", F.array().cast("array<bigint>"))
    for few in range(1, SHINGLE):
        found = found.when(n == few, F.array(_whole(words, F.lit(0), few)))
    return found


def _shingles(df: DataFrame) -> DataFrame:
    """Replace ``_words`` by ``_h``, the hashes of all 5-word shingles (or of the words, if fewer)."""
    return df.withColumn("_h", _bound(F.split("_words", " "), _hashes)).drop("_words")


def _minima(hashes: Column) -> list[Column]:
    return [F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(seed)))) for seed in SEEDS]


def _template_table(known: DataFrame) -> DataFrame:
    """Stored templates with distinct shingles; those without a word are left out."""
    rows = known.select("template", "license", _words(F.coalesce("text", F.lit(""))).alias("_words"))
    rows = _shingles(rows.withColumn("_few", F.size(F.split("_words", " ")))).filter(F.size("_h") > 0)
    return settle(rows.withColumn("_set", F.array_distinct("_h")), "templates")


def _template_bands(table: DataFrame) -> DataFrame:
    """``_band, _min`` of all template windows, with the template and the window's place in it.

    Band -1 holds single shingles, -2 templates of fewer words than a shingle.
    """
    size = F.size("_h")
    short = table.filter(size <= SHORT).select("template", "_few", "_h", F.posexplode(F.array(*_minima(F.col("_h")))).alias("_k", "_m"))
    seeds = F.array(*[F.lit(x) for x in SEEDS])
    short = short.withColumn("_min", F.col("_m").bitwiseXOR(F.get(seeds, F.col("_k"))))
    short = short.select(
        F.when(F.col("_few") < SHINGLE, -2).otherwise(-1).alias("_band"), "_min", "template", (F.array_position("_h", F.col("_min")) - 1).cast("int").alias("_place")
    )
    steps = F.sequence(F.lit(0), F.greatest(F.size("_h") - WINDOW, F.lit(0)), F.lit(WINDOW // 2))
    long = table.filter(size > SHORT).select("template", "_h", F.explode(steps).alias("_place"))
    long = long.withColumn("_win", F.slice("_h", F.col("_place") + 1, WINDOW))
    long = long.select("template", "_place", F.posexplode(F.array(*_minima(F.col("_win")))).alias("_band", "_min"))
    return settle(short.unionByName(long.select("_band", "_min", "template", F.col("_place").cast("int"))).distinct(), "bands")


def find_licenses(
    docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text", contained: float = CONTAINED
) -> DataFrame:
    """One row per text and template found: ``key``, ``_print``, ``template``, ``license``, ``share``, ``at``.

    ``share`` is the largest part of the template's distinct shingles (at least ``contained``) in a
    stretch as long as the template, ``at`` the first shingle of that stretch; where several templates
    stand, the one with most shingles found (or the shortest of them) is returned.  Words are letters and
    digits, case and marks aside; a template of fewer than 5 words is found wherever its words
    stand, next to longer ones too, and ``at`` is the first of them.  Null and empty texts hold no license; rows that repeat key and text give each
    find once; very long texts are scanned whole; a missing key is passed on; an empty table gives an empty table; other columns are not
    looked at.  ``known`` has ``template``, ``license`` and ``text``.
    """
    table = _template_table(known if known is not None else templates(docs.sparkSession))
    bands = _template_bands(table)
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.col(text).alias("_text"))
    few = [r["_few"] for r in table.filter(F.col("_few") < SHINGLE).select("_few").distinct().collect()]  # at most 4

    # All windows of a text in one pass: single shingles, the bands of several, and few words.
    def windows(x: Column) -> Column:
        h, w = x["h"], x["w"]
        window = lambda band, at, value: F.struct(band.alias("_band"), at.alias("_at"), value.alias("_min"))
        single = F.transform(h, lambda value, i: window(F.lit(-1), i, value))
        steps = F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW // 2, F.lit(0)), F.lit(WINDOW // 2))
        bands = lambda i: _bound(
            F.slice(h, i + 1, WINDOW), lambda win: F.array(*[window(F.lit(k), i, m) for k, m in enumerate(_minima(win))])
        )
        wide = F.when(F.size(h) > 0, F.flatten(F.transform(steps, bands))).otherwise(F.array().cast(WINDOWS))
        words = lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: window(F.lit(-2), i, _whole(w, i, n)))
        tiny = [F.when(F.size(w) >= n, words(n)).otherwise(F.array().cast(WINDOWS)) for n in few]
        return F.concat(single, wide, *tiny)

    sequences = _bound(F.split(_words(F.col("_text")), " "), lambda w: F.struct(w.alias("w"), _hashes(w).alias("h")))
    # (Outer: else Spark computes the array a second time to see whether it is empty.)
    all_windows = rows.select("_key", "_print", F.explode_outer(_bound(sequences, windows)).alias("_x")).select("_key", "_print", "_x.*")
    hits = all_windows.join(bands, ["_band", "_min"])
    tiny_template = F.col("_band") == -2
    found = settle(
        hits.select("_key", "_print", "template", (F.col("_at") - F.col("_place")).alias("_from"), tiny_template.alias("_exact")).distinct(),
        "license_hits",
    )
    exact = found.filter("_exact").select("_key", "_print", "template", F.lit(1.0).alias("share"), F.col("_from").alias("at"))
    wanted = found.filter("not _exact").groupBy("_key", "_print").agg(F.collect_set(F.struct("template", "_from")).alias("_hits"))
    wanted = settle(wanted, "license_docs")
    # Only texts with a hit are read as words again; repeated rows once.
    again = rows.select(F.col("_key").alias("_k"), F.col("_print").alias("_p"), "_text")
    same = again["_k"].eqNullSafe(wanted["_key"]) & (F.col("_p") == wanted["_print"])
    again = again.join(wanted, same).dropDuplicates(["_key", "_print"])
    again = _shingles(again.select("_key", "_print", "_hits", _words(F.col("_text")).alias("_words")))
    pairs = again.select("_key", "_print", "_h", F.explode("_hits").alias("_hit"))
    pairs = pairs.select("_key", "_print", "_h", "_hit.*").join(table.drop("_h"), "template")
    # Where the template would stand, and half its length to either side for changed words.
    n = F.size("_set")
    spare = F.ceil(n / 2).cast("int")
    begin = F.greatest(F.col("_from") - spare, F.lit(0))
    stretch = F.slice("_h", begin + 1, n + 2 * spare)
    share = F.size(F.array_intersect("_set", stretch)) / n
    verified = pairs.select("_key", "_print", "template", share.alias("share"), F.greatest("_from", F.lit(0)).alias("at"))
    verified = verified.filter(F.col("share") >= contained).unionByName(exact)
    best = verified.groupBy("_key", "_print", "template").agg(F.max(F.struct("share", (-F.col("at")).alias("m"))).alias("b"))
    # Of templates that stand at the same words the one with most shingles found; a list has a template at most once.
    names = table.select("template", "license", n.alias("_n"), (F.col("_few") < SHINGLE).alias("_tiny"))
    best = best.join(names, "template").select(
        "_key", "_print",
        F.struct("template", "license", F.col("b.share").alias("share"), (-F.col("b.m")).alias("at"), "_n", "_tiny").alias("_find"),
    )
    finds = best.groupBy("_key", "_print").agg(F.collect_list("_find").alias("_finds"))

    def worse(x: Column, y: Column) -> Column:
        meet = (x["at"] < y["at"] + y["_n"]) & (y["at"] < x["at"] + x["_n"])
        found = lambda t: F.round(t["share"] * t["_n"])
        more = (found(y) > found(x)) | ((found(y) == found(x)) & (y["_n"] < x["_n"]))
        return meet & ~x["_tiny"] & ~y["_tiny"] & more

    finds = finds.withColumn("_finds", F.filter("_finds", lambda x: ~F.exists("_finds", lambda y: worse(x, y))))
    return finds.select(F.col("_key").alias(key), "_print", F.explode("_finds").alias("_find")).select(
        key, "_print", "_find.template", "_find.license", "_find.share", "_find.at"
    )
