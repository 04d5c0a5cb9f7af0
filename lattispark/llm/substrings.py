"""Substring dedup: passages of `length` words that a document with a smaller key has already.

Suffix automata hold reference text; documents are streamed through them for their matching
statistics (the longest match that ends at each word), and words under matches of at least
`length` words go. The reference is the corpus itself and grows with it, so automata of all of
it can't be broadcast within a proven bound. They are made per reference shard instead:

1. Each window of `length` words has an anchor: the least hash among its grams of GRAM words.
   Equal windows have equal anchors, so they meet in the shard of their anchor.
2. Anchors of one place only are dropped. Which anchors repeat is told to the executors by a
   bitmap of fixed size; a false hit costs some work and changes nothing.
3. The surroundings of each repeated anchor go to its shard, in order of the key. A document is
   first streamed through the automaton of what smaller keys have brought, and then added.
4. Anchors of more than HOT places would make a shard too large. Their windows are hashed
   instead, the least key of each is aggregated before the shuffle, and joined back to places
   dealt over SALTS copies of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Codes, arrow_stage, bitmap, documents, held, rolled, sliding, table, words_of

LENGTH, GRAM = 50, 8
HOT = 256
#: Tasks that the places of a common window are dealt to, at least.
SALTS = 16


class Automaton:
    """A suffix automaton of several sequences."""

    def __init__(self):
        self.next, self.link, self.size = [{}], [-1], [0]

    def add(self, sequence: list[int]) -> None:
        steps, link, size = self.next, self.link, self.size
        last = 0
        for c in sequence:
            known = steps[last].get(c)
            if known is not None:
                last = known if size[known] == size[last] + 1 else self._split(last, c, known)
                continue
            new = len(steps)
            steps.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        steps, link, size = self.next, self.link, self.size
        copy = len(steps)
        steps.append(dict(steps[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = copy
            p = link[p]
        return copy

    def matches(self, sequence: list[int]) -> list[int]:
        """The length of the longest match that ends at each place."""
        steps, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for c in sequence:
            after = steps[state].get(c)
            while after is None and state:
                state = link[state]
                length = size[state]
                after = steps[state].get(c)
            if after is None:
                length = 0
            else:
                state = after
                length += 1
            out.append(length)
        return out


def anchors(codes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams, and of each window its anchor's hash."""
    grams = rolled(codes, gram)
    width = length - gram + 1
    if len(grams) < width:
        return grams, np.empty(0, np.uint64)
    return grams, sliding(np.minimum, grams, width)


def places(grams: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where grams lie that are the anchor of a window (each of several equal ones)."""
    if not len(chosen):
        return np.empty(0, np.int64)
    width = len(grams) - len(chosen) + 1
    rim = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([rim, chosen, rim]), width) == grams)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _marks(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    def make():
        codes = Codes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, texts = _columns(batch, "doc", "text")
            out = []
            for text in texts:
                grams, chosen = anchors(codes.of(text), length, gram)
                out.append(grams[places(grams, chosen)])
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), _lists(out)], ["doc", "anchors"])

        return each

    return arrow_stage(docs.select("doc", "text"), make, f"doc {kind}, anchors array<long>")


def _snippets(docs: DataFrame, kind: str, length: int, gram: int, sent) -> DataFrame:
    """Rows (anchor, doc, same, first, words): the words around each repeated anchor."""

    def make():
        codes = Codes()
        repeated, hot = sent.value

        def each(batch: pa.RecordBatch):
            out: list[list] = [[] for _ in range(5)]
            for key, same, text in zip(*_columns(batch, "doc", "same", "text"), strict=True):
                own = codes.of(text)
                grams, chosen = anchors(own, length, gram)
                own_places = places(grams, chosen)
                values = grams[own_places]
                packed = (own >> np.uint64(32)).astype("<u4").tobytes()
                for k in np.flatnonzero(held(repeated, values) & ~held(hot, values)):
                    first = max(0, int(own_places[k]) - (length - gram))
                    last = min(len(own), int(own_places[k]) + length)
                    for column, value in zip(out, (int(values[k].view(np.int64)), key, same, first, packed[4 * first : 4 * last]), strict=True):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield flush(out, batch)
            if out[0]:
                yield flush(out, batch)

        def flush(out, batch):
            types = [pa.int64(), batch.schema.field("doc").type, pa.int64(), pa.int32(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["anchor", "doc", "same", "first", "words"])
            for c in out:
                c.clear()
            return made

        return each

    return arrow_stage(docs, make, f"anchor long, doc {kind}, same long, first int, words binary")


def _streamed(snippets: DataFrame, kind: str, length: int) -> DataFrame:
    """Rows (doc, same, first, last): runs of words that a smaller key has. A task holds the
    automaton of one anchor, of at most HOT places, and the snippets of one document."""
    dealt = snippets.repartition("anchor").sortWithinPartitions("anchor", "doc")

    def run(stream):
        anchor = doc = None
        automaton, waiting = Automaton(), []
        for batch in stream:
            out: list[list] = [[] for _ in range(4)]
            for a, d, same, first, words in zip(*_columns(batch, "anchor", "doc", "same", "first", "words"), strict=True):
                if a != anchor:
                    anchor, doc, automaton, waiting = a, d, None, []
                elif d != doc:
                    automaton = automaton or Automaton()
                    for sequence in waiting:
                        automaton.add(sequence)
                    doc, waiting = d, []
                sequence = np.frombuffer(words, "<u4").tolist()
                matched = automaton.matches(sequence) if automaton else []
                if not matched or matched[-1] < len(sequence):
                    waiting.append(sequence)
                end = -1
                for k, m in enumerate(matched):
                    if m >= length:
                        start = first + k - length + 1
                        if start <= end:
                            out[3][-1] = end = first + k + 1
                        else:
                            end = first + k + 1
                            for column, value in zip(out, (d, same, start, end), strict=True):
                                column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["doc", "same", "first", "last"])

    return dealt.mapInArrow(run, f"doc {kind}, same long, first int, last int")


def _windows(docs: DataFrame, kind: str, length: int, gram: int, sent) -> DataFrame:
    """Rows (anchor, hash, doc, same, first) of the windows whose anchor is hot."""

    def make():
        codes = Codes()
        _, hot = sent.value

        def each(batch: pa.RecordBatch):
            for key, same, text in zip(*_columns(batch, "doc", "same", "text"), strict=True):
                own = codes.of(text)
                grams, chosen = anchors(own, length, gram)
                at = np.flatnonzero(held(hot, chosen))
                if len(at):
                    hashes = rolled(own, length, seed=0x51A2B3C4D5E6F701)[at]
                    n = len(at)
                    yield pa.RecordBatch.from_pydict({
                        "anchor": pa.array(chosen[at].view(np.int64)), "hash": pa.array(hashes.view(np.int64)),
                        "doc": pa.array([key] * n, batch.schema.field("doc").type), "same": pa.array([same] * n, pa.int64()), "first": pa.array(at.astype(np.int32)),
                    })

        return each

    return arrow_stage(docs, make, f"anchor long, hash long, doc {kind}, same long, first int")


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc, same, first, last): runs of words (last exclusive) that lie under windows of
    `length` words whose sequence also starts in a row with a smaller key. Runs may overlap.

    same is the text's hash, which tells rows of one key apart: these never remove each other's
    words. Null and short texts, and rows with a null key, have no part in it.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("same"), F.col(text).alias("text")).where("doc is not null and text is not null")
    places = _marks(docs, kind, length, gram).select("doc", F.explode("anchors").alias("anchor"))
    repeated = places.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("anchor", "n")
    repeated = table(repeated, "anchors")
    hot = repeated.where(F.col("n") > HOT)
    sent = df.sparkSession.sparkContext.broadcast((bitmap(repeated, "anchor"), bitmap(hot, "anchor")))
    found = _streamed(_snippets(docs, kind, length, gram, sent), kind, length)
    if hot.isEmpty():
        return found
    windows = _windows(docs, kind, length, gram, sent)
    least = windows.groupBy("anchor", "hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    least = least.select("anchor", "hash", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("doc", "first"), F.lit(SALTS)))
    later = dealt.join(least, ["anchor", "hash", "salt"]).where("doc > least")
    return found.unionByName(later.select("doc", "same", "first", (F.col("first") + length).cast("int").alias("last")))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of df: key, n_words, n_removed, kept (the words left, joined by one space).

    Windows are judged on the input, not on what is left. A null text has no words.
    """
    kind = df.schema[key].dataType.simpleString()
    runs = spans(df, key, text, length, gram).groupBy("doc", "same").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    rows = df.select(F.col(key), F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    runs = runs.select(F.col("doc").alias("_doc"), F.col("same").alias("_same"), "runs")
    both = rows.join(runs, (F.col(key) == F.col("_doc")) & (F.col("same") == F.col("_same")), "left")
    both = both.select(key, "text", F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, removed, kept = [], [], []
            for value, firsts, lasts in zip(*_columns(batch, "text", "firsts", "lasts"), strict=True):
                parts = list(words_of(value))
                words = parts[0] if len(parts) == 1 else [w for p in parts for w in p]
                gone = 0
                if firsts:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, firsts, 1)
                    np.add.at(delta, lasts, -1)
                    stays = np.cumsum(delta[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    sizes.append(len(words))
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                else:
                    sizes.append(len(words))
                removed.append(gone)
                kept.append(" ".join(words))
            return pa.RecordBatch.from_pydict({key: batch.column(batch.schema.get_field_index(key)), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

        return each

    return arrow_stage(both, make, f"`{key}` {kind}, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
dup AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM dup)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda p: CASE WHEN list_contains(ps, p) THEN NULL ELSE ws[p] END), lambda x: x IS NOT NULL) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
