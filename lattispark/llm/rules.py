"""Quality rules with a verdict on hosts.

Each text gets counts and base rules. Failures are summed by host, each host's failure rate is
shrunk towards a beta prior fitted to all hosts by the method of moments, and the verdict on
the host is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, arrow_stage, documents, narrow, rolled, words_of

SYMBOLS = "#*$%&|<>"
#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Hosts up to this number are broadcast; beyond it Spark joins by shuffle.
BROADCAST_HOSTS = 100_000


def repeated_words(codes: np.ndarray, width: int = 8) -> int:
    """Words inside windows of `width` codes that occur at two or more places, the first included."""
    keys = rolled(codes, width)
    if len(keys) < 2:
        return 0
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twin = np.zeros(len(keys), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    places = np.flatnonzero(twin)
    # equal hashes are compared as windows, so that a collision can't count
    windows = Counter(codes[p : p + width].tobytes() for p in places)
    delta = np.zeros(len(codes) + 1, np.int64)
    for p in places:
        if windows[codes[p : p + width].tobytes()] > 1:
            delta[p] += 1
            delta[p + width] -= 1
    return int((np.cumsum(delta[:-1]) > 0).sum())


def _ids(text: str, known: dict) -> np.ndarray:
    """Words as small integers, the same for the same word of this text."""
    parts = []
    for words in words_of(text):
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has none."""
    if not text:
        return 0, 0, 0, 0, 0
    codes = _ids(text, {})
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif WORD.search(line):
            seen.add(line)
    return len(codes), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(codes)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The columns kept and the five counts of each row's text. Texts of any length are counted whole,
    in parts; every row gives one, rows that repeat a key too, so an empty table gives none."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} long" for n in NAMES)])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            counts = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(NAMES))
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            return pa.RecordBatch.from_pydict(kept | {n: pa.array(counts[:, k]) for k, n in enumerate(NAMES)})

        return each

    return arrow_stage(narrow(df, *keep, text), make, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_rates(df: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """One row per host: host, n_docs, n_failed, rate, with the empirical beta prior's mean.

    The prior's mean is the share of failures over all hosts, and its strength comes from the
    variance of the hosts' rates weighted by their documents, less what binomial noise explains.
    It is kept between 1 and 10,000 documents. A null host is a host of its own.
    """
    hosts = df.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("h"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("s2"))
    mean = F.col("f") / F.col("n")
    spread = F.col("s2") / F.col("n") - mean * mean  # weighted variance of the rates
    noise = mean * (1 - mean) * F.col("h") / F.col("n")
    between = F.greatest(spread - noise, F.lit(0.0))
    inside = mean * (1 - mean)
    strength = F.when(between > 0, F.least(F.greatest(inside / F.when(between > 0, between) - 1, F.lit(1.0)), F.lit(10000.0))).otherwise(F.lit(10000.0))
    prior = total.select(mean.alias("prior_mean"), strength.alias("prior_docs"))
    rate = (F.col("n_failed") + F.col("prior_mean") * F.col("prior_docs")) / (F.col("n_docs") + F.col("prior_docs"))
    # the prior is one row
    return hosts.join(F.broadcast(prior), F.lit(True), "left").select("host", "n_docs", "n_failed", rate.alias("host_rate"))


def judged(counts: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """counts with base_failed, host_rate and kept: false where the base rules fail, and where
    the host's shrunk failure rate is above max_rate. Every row stays, in any number per host.
    """
    rows = counts.withColumn("base_failed", base_failed())
    rates = host_rates(rows, host).select(F.col("host").alias("_host"), "host_rate")
    few = rates.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(rates) if few else rates, rows[host].eqNullSafe(rates["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    counts = table(measured(documents(spark, sf_dir)), "rules")  # read twice: for the hosts and for the rows
    return judged(counts).select("doc_id", *NAMES, "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM lines GROUP BY ALL),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY ALL),
c AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::BIGINT AS f FROM b GROUP BY ALL),
p0 AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS s2, count(*) / sum(n) AS hn FROM h),
p1 AS (SELECT m, greatest(s2 - m * m - m * (1 - m) * hn, 0.0) AS v FROM p0),
p AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM p1),
r AS (SELECT source, (f + m * k) / (n + k) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
