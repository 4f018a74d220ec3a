"""Quality rules per document, and verdicts per host that a document alone cannot give.

Rule counts come from one pass over the texts.  Failures are counted per host; the hosts'
failure rates give a beta prior by moments, each host's rate is shrunk to it by its number
of documents, and a host whose shrunk rate reaches the limit loses all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from predio.llm.frames import add_columns, without
from predio.llm.words import SPACE, shingles, text_buffers, words
from predio.scale import settle

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 3

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeated(hashes: np.ndarray) -> int:
    """Words inside windows that occur at least twice."""
    if len(hashes) <= WINDOW:
        return 0
    _, each, count = np.unique(shingles(hashes, np.array([0, len(hashes)]), WINDOW)[0], return_inverse=True, return_counts=True)
    twice = count[each] > 1
    inside = np.zeros(len(hashes), bool)
    for j in range(WINDOW):
        inside[j : len(twice) + j] |= twice
    return int(inside.sum())


def _count(column: pa.Array) -> list[pa.Array]:
    data, at = text_buffers(column)
    n = len(column)
    _, _, hashes, row = words(data, at, 0, n)
    out = np.zeros((len(COUNTS), n), np.int64)
    out[0] = np.diff(row)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        text = data[a:b]
        out[1, i] = np.count_nonzero(((text & 0xC0) != 0x80) & ~SPACE[text])
        out[2, i] = np.count_nonzero(_IS_SYMBOL[text])
        lines = [x for x in text.tobytes().split(b"\n") if x.strip(BLANK)]
        out[3, i] = len(lines) - len(set(lines))
        out[4, i] = _repeated(hashes[row[i] : row[i + 1]])
    return [pa.array(x) for x in out]


def rule_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``.

    Words are runs of characters outside space and 09-0D; ``word_chars`` are their code points,
    ``n_symbols`` the characters of ``#*$%&|<>``, ``n_dup_lines`` the lines with a word that equal an
    earlier one, ``n_repeat_words`` the words in 3-word windows found at least twice in the text.
    Windows are compared by a 64-bit hash.  A null text counts as empty: all counts are 0.
    """
    return add_columns(df, [T.StructField(c, T.LongType(), False) for c in COUNTS], lambda: _count, text)


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def rule_failed() -> Column:
    """A failure that counts against the host: a base rule, many symbols, or many repeated lines."""
    return (
        F.col("base_failed")
        | (10 * F.col("n_symbols") > F.col("word_chars"))
        | (F.col("n_dup_lines") * 10 > F.col("n_words"))
    )


def host_rates(df: DataFrame, host: str = "source", failed: str = "failed") -> DataFrame:
    """Per host ``n_docs``, ``n_failed`` and ``rate``, the failure rate shrunk to the prior of all hosts.

    The prior Beta(a, b) has the mean and variance of the hosts' rates; with one host, or no more
    variance than the mean allows, it weighs as one document.  Rows without a host are one host.
    """
    hosts = settle(
        df.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed")),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    mean, square = hosts.agg(F.avg(rate), F.avg(rate * rate)).first()
    weight = 1.0
    if mean is not None:
        spread = square - mean * mean
        if spread > 1e-12 and mean * (1 - mean) > spread:
            weight = mean * (1 - mean) / spread - 1
    prior = (mean or 0.0) * weight
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(prior)) / (F.col("n_docs") + F.lit(weight)))


def host_rules(
    df: DataFrame, host: str = "source", text: str = "text", limit: float = 0.5, keep_text: bool = False
) -> DataFrame:
    """Add the counts of ``rule_counts``, ``base_failed``, ``host_rate`` and ``kept``.

    ``kept`` is false for documents that fail a base rule and for all documents of a host whose
    shrunk failure rate is at least ``limit``.  A null text fails as an empty one; a null host is a
    host; repeated rows each count; an empty table gives an empty table; columns of ``df`` named like
    a new one are replaced.  The counted rows are stored once, without the text unless ``keep_text``.
    """
    new = [*COUNTS, "base_failed", "failed", "host_rate", "kept"]
    df = without(df, [c for c in new if c not in (host, text)])
    counted = rule_counts(df, text).withColumn("base_failed", base_failed()).withColumn("failed", rule_failed())
    counted = settle(counted if keep_text else counted.drop(text), "rules")
    rates = host_rates(counted, host).select(F.col(host).alias("_host"), F.col("rate").alias("host_rate"))
    rates = settle(rates, "rates")
    judged = counted.join(rates, F.col(host).eqNullSafe(F.col("_host"))).drop("_host", "failed")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < limit))
