"""N-gram Jaccard join by a token-group matrix.

1. Documents with the same set of shingles form a class; its least key stands for it from here on.
2. Classes are grouped: each meets the least class that shares one of its lowest shingles, and
   joins its group if their sets really link. Near copies come together here in a number of
   comparisons in proportion to theirs. Large groups are dealt into parts of bounded size.
3. Shingles are ordered, rare ones first, by a count sketch of the whole corpus. A prefix is the
   part of an ordered set of which two linked sets must share some. The matrix holds, for each
   part of a group, the union of its members' prefix shingles, each with the members' sizes and
   the most that any of them has from that shingle on.
4. A class is matched against the matrix. The first shingle that two sets share bounds their
   overlap by what either has from there on, so only parts of groups are opened in which a member
   of a fitting size can reach the threshold by some shingle of both prefixes.
5. An opened part holds the union of its members' whole sets. A class shares so many shingles with
   the union; if these are enough, its overlap with every member is counted.

Steps 2 and 5 compare whole sets, so no link is lost or invented, except by a collision of
64-bit hashes. Links within a group need no further comparison, since the group is one component
already, and of the links between a class and a part of another group the strongest is enough.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Codes, arrow_stage, batches, bitmap, bounded, documents, drop, give_back, held, narrow, rolled, table

WIDTH, PERCENT = 4, 85
#: Lowest shingles by which classes are grouped, and how many of them must agree.
LOWEST, AGREE = 12, 4
#: The count sketch has 2**SKETCH counters, in blocks of 2**BLOCK. Its size is fixed; the order of
#: shingles, and so speed alone, depends on it.
SKETCH, BLOCK = 24, 18
#: Documents that look into one part of a group in a task, or so, and shingles of such a part, or so.
MEMBERS, PART = 256, 100_000
#: Shingles that are in more prefixes are matched by sizes too, in bins of this ratio.
CROWD, BIN = 256, 1.03
#: Rounds in which components must settle; each about halves the longest chain.
ROUNDS = 60


def lowered(text: str | None) -> bytes:
    """A-Z in lower case; other letters as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingle_set(text: str | None, codes: Codes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles, ascending. With fewer words than `width`, the whole
    sequence is the one shingle; without words the set is empty."""
    own = codes.of(lowered(text))
    if not len(own):
        return np.empty(0, np.uint64)
    return np.unique(rolled(own, min(width, len(own)), seed=2 * min(width, len(own)) + 0x9E3779B97F4A7C01))


def at_least(n, percent: int = PERCENT):
    """The least number of shared shingles of a set of n and any set that it links with."""
    return (percent * n + 99) // 100


def _lists(parts: list[np.ndarray], kind=None) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64), pa.int64()))


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH)).astype(np.int64)


def _marks(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row of (key, n, digest) for each row, and rows without n: what a task adds to a block of the sketch."""
    kind = df.schema[key].dataType.simpleString()

    def run(stream):
        codes, sketch = Codes(), np.zeros(1 << SKETCH, np.uint16)
        keys = None
        for batch in batches()(stream):
            keys = batch.column(batch.schema.get_field_index(key))
            sets = [shingle_set(t, codes, width) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            places, counts = np.unique(_slots(np.concatenate(sets)), return_counts=True) if sets else ([], 0)
            sketch[places] = np.minimum(sketch[places] + counts, 65535)
            yield pa.RecordBatch.from_pydict({
                key: keys, "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "block": pa.nulls(len(sets), pa.int32()),
            })
        pack = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(sketch.reshape(-1, 1 << BLOCK)):
            if keys is not None and part.any():
                yield pa.RecordBatch.from_pydict({key: pa.nulls(1, keys.type), "n": pa.nulls(1, pa.int64()), "digest": pa.array([pack.compress(part.tobytes())], pa.binary()), "block": pa.array([k], pa.int32())})
        del sketch
        give_back()

    bounded(df.sparkSession)
    return narrow(df, key, text).mapInArrow(run, f"`{key}` {kind}, n long, digest binary, block int")


def _sketch(marks: DataFrame) -> np.ndarray:
    """How frequent the shingles of each counter are together, in 256 steps: exact below 64, then by
    twelfths of a doubling."""

    def run(stream):
        sums: dict[int, np.ndarray] = {}  # as many as there are blocks at most
        for batch in stream:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zstandard.decompress(raw.as_py()), np.uint16)
                sums[k] = part.astype(np.float32) if k not in sums else sums[k] + part  # beyond 2**24, near enough
        for k, part in sums.items():
            steps = np.where(part < 64, part, 64 + 12 * np.log2(np.maximum(part, 64) / 64))
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "steps": pa.array([np.minimum(steps, 255).astype(np.uint8).tobytes()], pa.binary())})

    rows = marks.where("n is null").select("block", "digest").repartition("block")
    out = np.zeros((1 << (SKETCH - BLOCK), 1 << BLOCK), np.uint8)
    made = rows.mapInArrow(run, "block int, steps binary").toArrow()  # as many bytes as there are counters
    for k, steps in zip(made.column("block").to_pylist(), made.column("steps").to_pylist(), strict=True):
        out[k] = np.frombuffer(steps, np.uint8)
    del made
    give_back()
    return out.reshape(-1)


def _ordered(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rare shingles first; those of one step by hash."""
    return tokens[np.argsort(sketch[_slots(tokens)], kind="stable")]


def _prefixes(df: DataFrame, key: str, text: str, width: int, percent: int, sketch: np.ndarray, heads: np.ndarray) -> DataFrame:
    """Rows (doc, n, low, prefix) of the rows with shingles whose key's hash is in the bitmap of heads.
    A row that gets in by a false hit is a copy of one that is there; it costs work in proportion."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast((sketch, heads))

    def make():
        codes = Codes()
        steps, bits = sent.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = batch.filter(pa.array(held(bits, batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64))))
            sets = [shingle_set(t, codes, width) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            return pa.RecordBatch.from_pydict({
                "doc": batch.column(batch.schema.get_field_index("doc")), "n": pa.array([len(s) for s in sets], pa.int64()),
                "low": _lists([s[:LOWEST] for s in sets]),
                "prefix": _lists([_ordered(s, steps)[: len(s) - at_least(len(s), percent) + 1] if len(s) else s for s in sets]),
            })

        return each

    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    return arrow_stage(rows, make, f"doc {kind}, n long, low array<long>, prefix array<long>").where("n > 0")


def _wanted(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(doc, text) of the rows whose key may be among the ids, which a bitmap of fixed size tells
    without a shuffle; the join that follows settles it."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc").alias("h")), "h"))

    def make():
        bits = sent.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64)
            return batch.select(["doc", "text"]).filter(pa.array(held(bits, hashes)))

        return each

    return arrow_stage(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(key).alias("h")), make, f"doc {kind}, text string")


class Part:
    """Members of a part of a group, with the union of their sets and who has which of its shingles."""

    def __init__(self, members: list[tuple[object, np.ndarray]], percent: int):
        self.docs, sets = [d for d, _ in members], [s for _, s in members]
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.who = who[order]
        self.union, self.start, self.count = np.unique(tokens[order], return_index=True, return_counts=True)

    def best(self, own: np.ndarray):
        """The member that links with a set and shares most with it (of equals, the first), or None."""
        fits = self.sizes[(100 * self.sizes >= self.percent * len(own)) & (self.percent * self.sizes <= 100 * len(own))]
        if not len(fits) or not len(own):
            return None
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if len(at) * (100 + self.percent) < self.percent * (len(own) + int(fits.min())):
            return None  # the union bounds the overlap with each member
        count = self.count[at]
        places = np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(self.who[places], minlength=len(self.sizes))
        links = 100 * shared >= self.percent * (len(own) + self.sizes - shared)
        return self.docs[int(np.argmax(np.where(links, shared, -1)))] if links.any() else None


def _linked(members: DataFrame, queries: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Of queries (grp, sub, doc), the pairs (a, b) of each and the member (grp, sub, doc) of its part
    that it links with by whole sets and shares most with.

    Only parts that are asked for are read. The texts of a part's members come to one task, before
    those of its queries, which are compared as they stream in. The queries of a part of many are
    dealt out, MEMBERS to a task or so, and its members go to each of these.
    """
    kind = docs.schema[key].dataType.simpleString()
    # of so many shingles that a part has, and so many queries: both bounded but for one long text
    deals = queries.groupBy("grp", "sub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("deals"))
    asked = queries.join(deals, ["grp", "sub"]).select("grp", "sub", F.pmod(F.xxhash64("doc"), "deals").cast("int").alias("deal"), "doc", F.lit(1).alias("rank"))
    there = members.join(deals, ["grp", "sub"]).select("grp", "sub", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "doc", F.lit(0).alias("rank"))
    seats = table(there.unionByName(asked), "seats")
    texts = _wanted(docs, key, text, seats.select("doc").distinct())
    rows = seats.join(texts, "doc").repartition("grp", "sub", "deal").sortWithinPartitions("grp", "sub", "deal", "rank", "doc")

    def make():
        codes = Codes()
        state: dict = {"at": None, "members": [], "part": None}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = [], []
            for grp, sub, deal, doc, rank, value in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "sub", "deal", "doc", "rank", "text")), strict=True):
                if (grp, sub, deal) != state["at"]:
                    state.update(at=(grp, sub, deal), members=[], part=None)
                own = shingle_set(value, codes, width)
                if rank == 0:
                    state["members"].append((doc, own))
                    continue
                state["part"] = state["part"] or Part(state["members"], percent)
                if (found := state["part"].best(own)) is not None:
                    left.append(doc)
                    right.append(found)
            keys = batch.schema.field("doc").type
            return pa.RecordBatch.from_pydict({"a": pa.array(left, keys), "b": pa.array(right, keys)})

        return each

    links = table(arrow_stage(rows, make, f"a {kind}, b {kind}").distinct(), "links")
    drop(seats)
    return links


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc, component): for each key of an edge (a, b), the least key that it reaches.

    Large stars and small stars take turns until nothing changes; the minimum of a key's
    neighbours is aggregated before it is joined back, so a hub's edges can be split.
    """
    e = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = state(e)
    for _ in range(rounds if was[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, table(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(old)
        now = state(e)
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct())


def _starts(rows: DataFrame) -> DataFrame:
    """Pairs of a class (doc) and, of the classes that are least among those with one of its lowest
    shingles, the one (grp) that is so for most of them, and for at least AGREE."""
    low = rows.select("doc", "n", F.explode("low").alias("token"))
    hubs = low.groupBy("token").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").select("token", "hub")
    met = low.join(hubs, "token").where("doc <> hub").groupBy("doc", "hub", "n").count()
    met = met.where(F.col("count") >= F.least(F.lit(AGREE), F.col("n")))
    return met.groupBy("doc").agg(F.min_by("hub", F.struct(-F.col("count"), F.col("hub"))).alias("grp"))


def _parts(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, grp, sub): the members of groups (doc, component), dealt into parts of PART shingles or so."""
    members = groups.join(sizes, "doc").groupBy("doc", F.col("component").alias("grp")).agg(F.sum("n").alias("n"))
    parts = members.groupBy("grp").agg(F.ceil(F.sum("n") / PART).alias("parts"))
    return members.join(parts, "grp").select("doc", "grp", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("sub"))


def _bin(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(BIN)).cast("int")


def _bins(n: Column, small: Column, large: Column, rest: Column, percent: int) -> Column:
    """Bins of the sizes that a set can have that links with one of n shingles, and of which small to
    large fit, if the first shingle that both share leaves `rest` to the set."""
    low = lambda b: F.greatest(F.floor(F.pow(F.lit(BIN), b.cast("double"))) - 1, small)  # noqa: E731  never above the bin's least size
    return F.filter(F.sequence(_bin(small), _bin(large)), lambda b: rest * (100 + percent) >= percent * (n + low(b)))


def _opened(rows: DataFrame, percent: int) -> DataFrame:
    """(grp, sub, doc): parts of other groups that the matrix can't rule out for a class. Of two
    groups, classes of the one with the greater key look into the other."""
    least = lambda n: F.floor((n * percent + 99) / 100)
    most = lambda n: F.floor(n * 100 / percent)
    cells = rows.select("doc", "n", "grp", "sub", F.posexplode("prefix").alias("pos", "token")).withColumn("rest", F.col("n") - F.col("pos")).drop("pos")
    crossed = cells.groupBy("token").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.count(F.lit(1)).alias("crowd")).where("g1 < g2").select("token", (F.col("crowd") > CROWD).alias("crowded"))
    cells = table(cells.join(crossed, "token"), "cells")
    # a pair's rows meet at (token, bin of the class, bin of the member): where a token is crowded,
    # either side goes only to bins in which its own rest is enough
    one = F.array(F.lit(-1))
    x, y = F.col("n"), F.col("least")
    asks = cells.select("token", "doc", "n", "rest", "grp", F.when(F.col("crowded"), _bin(x)).otherwise(-1).alias("bx"), F.explode(F.when(F.col("crowded"), _bins(x, least(x), most(x), F.col("rest"), percent)).otherwise(one)).alias("by"))
    by = F.when(F.col("crowded"), _bin(F.col("n"))).otherwise(-1).alias("by")
    matrix = cells.groupBy("token", "crowded", F.col("grp").alias("other"), "sub", by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("room"))
    matrix = matrix.select("token", "other", "sub", "least", "most", "room", "by", F.explode(F.when(F.col("crowded"), _bins(y, least(y), most(F.col("most")), F.col("room"), percent)).otherwise(one)).alias("bx"))
    fits = (F.col("most") * 100 >= percent * x) & (y * percent <= 100 * x)
    reach = F.least("rest", "room") * (100 + percent) >= percent * (x + F.greatest(y, least(x)))
    hit = asks.join(matrix, ["token", "bx", "by"]).where((F.col("other") < F.col("grp")) & fits & reach)
    opened = table(hit.select(F.col("other").alias("grp"), "sub", "doc").distinct(), "opened")
    drop(cells)
    return opened


def join(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df: key, n_shingles, component (the least key that it reaches).

    Two documents link when 100 * shared >= percent * united shingles. A null or empty text has
    no shingles and links with nothing; its component is its own key. Rows with a null key take
    no part, and their component is null. Rows that share a key are one document. Keys may be of
    any type that has an order. An empty table gives no rows, a text of any length is one set, and
    other columns are left out. If components don't settle in so many rounds, that is an error.
    """
    docs = narrow(df, key, text)
    marks = table(_marks(docs, key, text, width), "marks")
    rows = marks.where(F.col("n").isNotNull())
    classes = table(rows.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy("digest").agg(F.min(key).alias("doc")), "classes")
    whole = docs.where(F.col(key).isNotNull())
    heads = bitmap(classes.select(F.xxhash64("doc").alias("h")), "h")
    prefixes = table(_prefixes(whole, key, text, width, percent, _sketch(marks), heads), "prefixes")
    del heads
    starts = table(_starts(prefixes), "pairs").withColumn("sub", F.lit(0))
    hubs = starts.select("grp", "sub", F.col("grp").alias("doc")).distinct()
    links = _linked(hubs, starts, whole, key, text, width, percent)
    groups = table(_parts(components(links, rounds), prefixes.select("doc", "n")), "groups")
    grouped = prefixes.join(groups, "doc", "left").select("doc", "n", "prefix", F.coalesce("grp", "doc").alias("grp"), F.coalesce("sub", F.lit(0)).alias("sub"))
    opened = _opened(grouped, percent)
    # groups of one class have no row of their own among groups
    members = opened.select("grp", "sub").distinct().join(groups, ["grp", "sub"], "left").select("grp", "sub", F.coalesce("doc", "grp").alias("doc"))
    more = _linked(members, opened, whole, key, text, width, percent)
    final = components(links.unionByName(more), rounds)
    drop(links, more, groups, opened, prefixes)
    named = classes.join(final, "doc", "left").select("digest", F.coalesce("component", "doc").alias("component"))
    out = rows.select(key, "n", "digest").join(named, "digest", "left")
    component = F.when(F.col(key).isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col(key)))
    return out.select(key, F.col("n").alias("n_shingles"), component.alias("component"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, array_to_string(ws[i : i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) AS c USING (doc_id)
"""
