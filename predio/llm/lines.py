"""Line deduplication by log templates, with SQL functions only.

A line is parsed to a fixed depth: words with a digit become ``<*>``, and the number of words
and the leading words lead to a leaf.  A leaf has several templates: lines look at the most frequent
line that shares a pair of words with them, for each of their pairs; one that agrees with no such line
is a template, lines that agree with it in enough of the other words are the same template with ``<*>``
where they differ, and the rest is looked at again, in a few passes; what they leave is compared by its rarer
words, with no line left out.  A template found in several documents recurs: its lines stay in the first of them only.

Texts are split once, into a stored table of lines; lines are told apart by 64-bit hashes, and their
words are compared only in leaves with several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from predio.llm.frames import without
from predio.scale import settle

#: Leading words that lead to a leaf, and least constant words of a template.
DEPTH, LEAST = 3, 3
#: Passes over the lines of a leaf.
PASSES = 4
#: The largest bitmap that is sent to all tasks, and its bits per wanted hash.
FILTER_BYTES, FILTER_BITS = 64 << 20, 8
_BUCKET = 32768  # bits of one bitmap of Spark's


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, _print, _pos, _line`` of every line of every document.

    Lines have single spaces, none at their ends, and ``<*>`` for words with a digit; a line with too
    few words without a digit stays as it is, so that rows of numbers are equal only if their numbers are.
    """
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.col(text).alias("_text"))
    # (Outer: else Spark splits a second time to see whether there are lines.)
    rows = rows.select("_key", "_print", F.posexplode_outer(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    line = F.col("_line")
    blank = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    spaced = F.when(blank, F.regexp_replace(line, "[\t\r\x0b\x0c ]+", " ")).otherwise(line)
    rows = rows.withColumn("_line", F.trim(spaced))
    masked = rows.withColumn("_mask", F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")))
    words = F.split("_mask", " ")
    enough = _constant(F.size(F.filter(words, lambda x: x != "<*>")), F.size(words))
    return masked.withColumn("_line", F.when(F.col("_mask").isNotNull() & enough, F.col("_mask")).otherwise(line)).drop("_mask")


def _constant(n: Column, words: Column) -> Column:
    """Are ``n`` constant words enough to generalise a line of ``words``?  Three, and half of all."""
    return (n >= LEAST) & (2 * n >= words)


def _alike(same: Column) -> Column:
    """Are lines one template, by their words after the leading ones, null where they differ?

    Half of the words and one more must agree, and enough of all words must be equal and constant;
    leading words are equal, and count unless they hold digits.
    """
    others = F.size(same)
    equal = F.size(F.filter(same, lambda x: x.isNotNull()))
    constant = F.size(F.filter(same, lambda x: x.isNotNull() & (x != "<*>")))
    lead = F.size(F.filter(F.slice(F.split("_line", " "), 1, DEPTH), lambda x: x != "<*>"))
    return (others > 0) & (2 * equal >= others + 2) & _constant(lead + constant, others + DEPTH)


def _rest(line: str) -> Column:
    """The words after the leading ones."""
    return F.slice(F.split(line, " "), DEPTH + 1, 1 << 30)


def _may_match(rows: DataFrame, wanted: DataFrame, column: str = "_hash") -> DataFrame:
    """Rows whose hash may be among those of the stored table ``wanted``, before they are joined.

    A bitmap of the wanted hashes, a byte for each, leaves out nearly all other rows where they are
    read; if it were larger than ``FILTER_BYTES`` all rows go to the join.  (Join the result inner: Spark
    moves a left semi join in front of the bitmap.)
    """
    buckets = max(1, -(-FILTER_BITS * wanted.count() // _BUCKET))
    if buckets * _BUCKET // 8 > FILTER_BYTES:
        return rows
    place = F.pmod(column, F.lit(buckets * _BUCKET))
    bucket, bit = F.floor(place / _BUCKET).cast("int").alias("_bucket"), (place % _BUCKET).cast("int").alias("_bit")
    bits = settle(wanted.select(bucket, bit).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmaps")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("_bit") % 8 + 1)) != 0
    return rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bits), "_bucket").filter(set_bit).drop("_bucket", "_bit", "_bits")


def _agreeing(both: DataFrame, texts: DataFrame) -> DataFrame:
    """``(_hash, _pivot)`` of those whose lines are one template."""
    both = both.join(texts, "_hash").join(texts.toDF("_of", "_other"), F.col("_pivot._hash") == F.col("_of"))
    same = F.zip_with(_rest("_line"), _rest("_other"), lambda x, y: F.when(x == y, x))
    return both.select("_hash", "_pivot", "_line", same.alias("_same")).filter(_alike(F.col("_same"))).select("_hash", "_pivot")


def _taken(looked_at: DataFrame, agree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines looked at that agree with none, and the lines that these take, each the most frequent one it can have."""
    top = settle(looked_at.join(agree.select("_hash").distinct(), "_hash", "left_anti"), "top")
    taken = agree.join(top.select(F.col("_hash").alias("_of")), F.col("_pivot._hash") == F.col("_of"), "left_semi")
    return top, settle(taken.groupBy("_hash").agg(F.max("_pivot")["_hash"].alias("_template")), "taken")


def _rest_taken(open_rows: DataFrame, texts: DataFrame, assigned: DataFrame) -> DataFrame:
    """``assigned`` and the lines left by the passes: all that agree with each other are found.

    Lines of a leaf that are one template have more than half of their words after the leading ones in common, so
    they share one of the rarer half of these: of n words the n // 2 that fewest lines have.  Such lines
    are compared, however many there are, and templates taken from the most frequent line down.
    """
    lines = open_rows.select("_hash", "_rank").distinct().join(texts, "_hash")
    head = F.xxhash64(F.size(F.split("_line", " ")), F.substring_index("_line", " ", DEPTH))
    words = lines.select("_hash", "_rank", head.alias("_head"), F.posexplode(_rest("_line")).alias("_at", "_word"))
    words = settle(words.select("_hash", "_rank", F.xxhash64("_head", "_at", "_word").alias("_word")), "rest")
    if words.isEmpty():
        return assigned
    counts = words.groupBy("_word").agg(F.count("*").alias("_lines")).filter("_lines > 1")
    # A word that no other line has leads nowhere, but is among the rarest.
    own = Window.partitionBy("_hash")
    rarest = words.join(counts, "_word", "left").select(
        "_hash", "_rank", "_word", "_lines",
        F.row_number().over(own.orderBy(F.coalesce("_lines", F.lit(1)), "_word")).alias("_nth"), F.count("*").over(own).alias("_all"),
    )
    keys = settle(rarest.filter((F.col("_lines") > 1) & (2 * F.col("_nth") <= F.col("_all"))).select("_hash", "_rank", "_word"), "rarest")
    both = keys.join(keys.select("_word", F.col("_rank").alias("_pivot")), "_word").filter("_rank < _pivot").select("_hash", "_pivot").distinct()
    agree = settle(_agreeing(both, texts), "agree")
    # Lines depend on more frequent ones only, so each turn settles those that depend on none.
    while not agree.isEmpty():
        top, taken = _taken(agree.select(F.col("_pivot._hash").alias("_hash")).distinct(), agree)
        assigned = assigned.unionByName(taken)
        done = settle(top.unionByName(taken.select("_hash")), "done")
        agree = agree.join(done, "_hash", "left_anti")
        agree = settle(agree.join(done.toDF("_of"), F.col("_pivot._hash") == F.col("_of"), "left_anti"), "agree")
    return assigned


def _templates(rows: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``(_hash, _template)`` of the lines that join another one of their leaf (``_leaf, _hash, _n, _words, _line``).

    Lines of a leaf that are one template differ in fewer places than it has pairs of words after the
    leading ones, so they agree in some pair.  In a pass every line is compared with the most frequent
    line of each of its pairs (of equally frequent ones that with the largest hash).  A line that others
    look at and that agrees with none it looks at is a template and takes the lines that agree with it, each
    the most frequent one it can have; both are done, and the next pass looks at the rest.  The
    lines left after ``PASSES`` passes are compared with all that can agree with them.
    """
    pairs = F.floor((F.col("_words") - DEPTH) / 2).cast("int")

    def hashed(rest, i):
        # The last pair has a third word if their number is odd.
        return F.xxhash64("_leaf", i, F.slice(rest, 2 * i + 1, F.when(i == pairs - 1, 3).otherwise(2)))

    # The outer transform splits the line once.
    pair = F.get(F.transform(F.array(_rest("_line")), lambda rest: F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: hashed(rest, i))), 0)
    rank = F.struct("_n", "_hash").alias("_rank")
    open_rows = settle(rows.filter(pairs > 1).select("_hash", rank, F.explode(pair).alias("_pair")), "pairs")
    assigned = None
    for _ in range(PASSES):
        # A pair left to one line joins nothing.
        pivots = open_rows.groupBy("_pair").agg(F.max("_rank").alias("_pivot"), F.min("_rank").alias("_low"))
        pivots = settle(pivots.filter("_low <> _pivot").select("_pair", "_pivot"), "pivots")
        if pivots.isEmpty():
            break
        both = open_rows.join(pivots, "_pair").filter("_rank < _pivot").select("_hash", "_pivot").distinct()
        agree = settle(_agreeing(both, texts), "agree")
        looked_at = pivots.select(F.col("_pivot._hash").alias("_hash")).distinct()
        top, taken = _taken(looked_at, agree)
        assigned = taken if assigned is None else assigned.unionByName(taken)
        done = top.unionByName(taken.select("_hash"))
        open_rows = settle(open_rows.join(pivots.select("_pair"), "_pair", "left_semi").join(done, "_hash", "left_anti"), "left")
    else:
        assigned = _rest_taken(open_rows, texts, assigned)
    return assigned


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, _print, _pos``: the lines that go, each a repeat of a template that an earlier document has.

    Documents are ordered by key (a missing one first), then by a hash of the text.
    """
    parsed = _lines(docs, key, text).withColumn("_words", F.size(F.split("_line", " ")))
    leaf = F.xxhash64("_words", F.substring_index("_line", " ", DEPTH))
    stored = settle(
        parsed.select("_key", "_print", "_pos", leaf.alias("_leaf"), F.xxhash64("_line").alias("_hash"), "_words", "_line"), "lines"
    )
    # (Filtered here, not before storing: Spark would parse every line a second time for the filter.)
    stored = stored.filter(F.col("_words") >= LEAST)
    # Most lines stand in a leaf that one document has; only the others go on.
    own = F.xxhash64("_key", "_print")
    leaves = stored.groupBy("_leaf").agg(F.min(own).alias("_a"), F.max(own).alias("_z"))
    leaves = settle(leaves.filter("_a <> _z").select("_leaf"), "leaves")
    stored = settle(_may_match(stored, leaves, "_leaf").join(leaves, "_leaf"), "shared")
    narrow = stored.drop("_line", "_words")
    doc = F.struct("_key", "_print")
    variants = stored.groupBy("_leaf", "_hash").agg(
        F.first("_words").alias("_words"), F.count("*").alias("_n"), F.min(doc).alias("_first"), F.max(doc).alias("_last")
    )
    variants = settle(variants, "variants")
    sizes = settle(variants.groupBy("_leaf").agg(F.count("*").alias("_variants")), "sizes")
    alive = variants.join(sizes, "_leaf")

    # The lines of leaves with several of them, once each.
    several = settle(alive.filter("_variants > 1").select("_leaf", "_hash", "_n", "_words"), "several")
    wanted = settle(several.filter(F.col("_words") >= DEPTH + 4).select("_hash").distinct(), "wanted")
    read = _may_match(stored.select("_hash", "_line"), wanted).join(wanted, "_hash")
    read = settle(read.groupBy("_hash").agg(F.first("_line").alias("_line")), "texts")
    assigned = _templates(several.join(read, "_hash"), read)
    named = several.select("_leaf", "_hash")
    if assigned is not None:
        named = named.join(settle(assigned, "assigned"), "_hash", "left").select("_leaf", "_hash", F.coalesce("_template", "_hash").alias("_name"))
    else:
        named = named.withColumn("_name", F.col("_hash"))
    single = alive.filter("_variants = 1").select("_leaf", "_hash", F.col("_hash").alias("_name"))
    names = settle(single.unionByName(named), "names")

    templates = (
        variants.join(names, ["_leaf", "_hash"])
        .groupBy("_leaf", "_name")
        .agg(F.min("_first").alias("_a"), F.max("_last").alias("_z"))
        .filter("_a <> _z")
        .drop("_z")
    )
    # Stored, its size is known: sent to all tasks if it is small, else joined with hot names split.
    recurring = settle(names.join(settle(templates, "templates"), ["_leaf", "_name"]).select("_leaf", "_hash", "_a"), "recurring")
    return _may_match(narrow, recurring).join(recurring, ["_leaf", "_hash"]).filter(doc != F.col("_a")).select("_key", "_print", "_pos")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_empty: bool = False) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n``; lines of fewer than 3 words never go.  Texts without recurring lines stay as
    they are; a null text stays null with 0 lines and an empty one has 1 line.  With ``drop_empty``
    documents whose every line with a word went are left out.  Rows that repeat key and text are one
    document and all lose the same lines; rows that share only the key are told apart by their texts.
    Columns named like a new one are replaced; an empty table gives an empty table.
    """
    docs = without(docs, [c for c in ("n_lines", "n_dropped") if c != text])
    gone = recurring_lines(docs, key, text).distinct()
    gone = gone.groupBy("_key", "_print").agg(F.array_sort(F.collect_list("_pos")).alias("_gone"))
    gone = settle(gone, "gone")
    rows = docs.withColumn("_own", F.xxhash64(text))
    joined = rows.join(gone, rows[key].eqNullSafe(gone["_key"]) & (F.col("_own") == F.col("_print")), "left")
    lines = F.split(F.col(text), "\n", -1)
    line_ends = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    # The outer transform splits the text once.
    kept = F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    cut = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.get(kept, 0))
    out = joined.select(
        *[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(line_ends + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    if drop_empty:
        out = out.filter((F.col("n_dropped") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    return out
