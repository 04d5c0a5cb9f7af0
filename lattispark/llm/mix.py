"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents are laid end to end in a random but fixed order and cut into blocks of
equal numbers of words. A source's target is a whole number of blocks. A splitting tree deals
these exact quotas out to the output shards: a node holds a quota for each source, and its left
child draws half of all blocks, so many of each source as a multivariate hypergeometric draw
gives. The blocks of a source are permuted, and a leaf's quotas are runs of permuted blocks, so
the shards' draws are disjoint. A source whose target exceeds its size goes round again from its
first permuted block. Within a shard, slices are shuffled by a hash (see shards()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, documents, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Words of a block; the tree has 2**DEPTH shards.
BLOCK, DEPTH = 32, 4
#: Documents of a part of a source's order, or so; the sums of parts are known before documents are
#: ranked within them.
RANKED = 10_000
#: Blocks are permuted by b -> (b * P + c) mod n, where P is the first of these primes that doesn't
#: divide n. Products of a block's number and P fit 64 bits for up to 2**40 blocks of a source.
PRIMES = (4_194_301, 4_194_287, 4_194_277)
#: Parts of a shard that are shuffled apart, each in one task.
LOTS = 16
#: Sources up to this number are broadcast; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 20_000


def _random(*parts: Column) -> Column:
    """A fixed number in [0, 1) for the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def sized(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source and size: the number of words, 0 for null; and columns to carry along."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    return df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *carry)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, at (its place by code point, null last), source_size, target.

    Weights repeat along the places. Sources together get `share` of all sizes; a target stops
    at `most` times its source's size, and the excess goes to the others by weight until none is
    above. A source without words has target 0. Sources are gathered in one array, so their
    number, not that of documents, must fit a row.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = totals.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.hex(F.encode("source", "UTF-8")), F.lit("")).alias("place"), "source", "source_size"))).alias("s"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    listed = listed.select(F.transform("s", lambda x, i: F.struct(x["source"].alias("source"), i.alias("at"), x["source_size"].alias("source_size"), F.element_at(cycle, (i % len(weights) + 1).cast("int")).alias("w"))).alias("s"))
    # filling: sources reach their limit in order of limit over weight. With the k first at their
    # limit, the rest share what is left; the right k is the first whose next source stays below.
    ordered = F.array_sort(F.transform("s", lambda x: F.struct((x["source_size"] * most / x["w"]).alias("ratio"), x["w"].alias("w"), (x["source_size"] * most).alias("limit"))))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["source_size"]) * share
    weight = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
    zero = F.struct(F.col("total").alias("left"), F.col("weight").alias("w"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        stop = a["done"] | (a["left"] / a["w"] <= x["ratio"])
        return F.struct(F.when(stop, a["left"]).otherwise(a["left"] - x["limit"]).alias("left"), F.when(stop, a["w"]).otherwise(a["w"] - x["w"]).alias("w"), stop.alias("done"))

    level = F.aggregate("ordered", zero, step, lambda a: F.when(a["w"] > 0, a["left"] / F.when(a["w"] > 0, a["w"])).otherwise(F.lit(float("inf"))))
    filled = listed.select("s", ordered.alias("ordered"), total.alias("total"), weight.alias("weight")).select("s", level.alias("level"))
    return filled.select(F.explode("s").alias("x"), "level").select("x.source", "x.at", "x.source_size", F.least(F.col("x.source_size") * most, F.col("x.w") * F.col("level")).alias("target"))


def _hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` from `population` are marked, by inversion outward from the mode.

    Weights relative to the mode's are summed over twelve standard deviations to each side, which
    leaves out less than a double can hold, and the place where they pass u times their sum is
    the draw.
    """
    n, k, m = population.cast("double"), marked.cast("double"), draws.cast("double")
    low, high = F.greatest(F.lit(0.0), m - (n - k)), F.least(m, k)
    mode = F.least(F.greatest(F.floor((m + 1) * (k + 1) / (n + 2)).cast("double"), low), high)
    deviation = F.sqrt(F.greatest(m * k * (n - k) * (n - m) / (n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
    reach = F.least(F.ceil(deviation * 12).cast("double") + 3, F.greatest(high - mode, mode - low))
    setup = F.struct(n.alias("n"), k.alias("k"), m.alias("m"), mode.alias("mode"), low.alias("low"), high.alias("high"), reach.alias("reach"), u.alias("u"))

    def walk(s: Column, stop: Column | None) -> Column:
        start = F.struct(F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("sum"), s["mode"].alias("got"), (F.lit(False) if stop is None else stop < 1.0).alias("done"))

        def step(a: Column, i: Column) -> Column:
            x, y = s["mode"] + i - 1, s["mode"] - i + 1
            up = F.when(x + 1 <= s["high"], a["up"] * (s["k"] - x) * (s["m"] - x) / ((x + 1) * (s["n"] - s["k"] - s["m"] + x + 1))).otherwise(0.0)
            down = F.when(y - 1 >= s["low"], a["down"] * y * (s["n"] - s["k"] - s["m"] + y) / ((s["k"] - y + 1) * (s["m"] - y + 1))).otherwise(0.0)
            if stop is None:
                return F.struct(up.alias("up"), down.alias("down"), (a["sum"] + up + down).alias("sum"), a["got"].alias("got"), a["done"].alias("done"))
            first, both = a["sum"] + up, a["sum"] + up + down
            got = F.when(a["done"], a["got"]).when(stop < first, x + 1).when(stop < both, y - 1).otherwise(a["got"])
            return F.struct(up.alias("up"), down.alias("down"), both.alias("sum"), got.alias("got"), (a["done"] | (stop < both)).alias("done"))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(s["reach"].cast("int"), F.lit(1))), start, step)

    held = F.transform(F.array(setup), lambda s: F.struct(s.alias("s"), (walk(s, None)["sum"] * s["u"]).alias("stop")))
    drawn = F.transform(held, lambda h: walk(h["s"], h["stop"])["got"])
    return F.element_at(drawn, 1).cast("long")


def split(quotas: DataFrame, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """Rows of (shard, quotas: one per source) from one row with the quotas of all sources.

    Each level halves every node: the left child takes the draws source after source, each a
    hypergeometric draw from the blocks that remain.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas")
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        drawn = nodes.select("shard", "quotas", total.alias("total"))
        start = F.struct(F.col("total").alias("left"), F.floor(F.col("total") / 2).cast("long").alias("draws"), F.expr("cast(array() as array<bigint>)").alias("out"))

        turn = F.lit(level)

        def step(a: Column, q: Column) -> Column:
            u = _random(F.lit(seed), turn, F.col("shard"), F.size(a["out"]))
            took = F.when(q <= 0, F.lit(0).cast("long")).when(q >= a["left"], a["draws"]).otherwise(_hypergeometric(a["left"], q, a["draws"], u))
            pair = F.transform(F.array(took), lambda t: F.struct((a["left"] - q).alias("left"), (a["draws"] - t).alias("draws"), F.concat(a["out"], F.array(t)).alias("out")))
            return F.element_at(pair, 1)

        both = drawn.select("shard", "quotas", F.aggregate("quotas", start, step)["out"].alias("own"))
        rest = F.zip_with("quotas", "own", lambda q, t: q - t)
        nodes = both.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("own").alias("quotas")), F.struct((F.col("shard") * 2 + 1).alias("shard"), rest.alias("quotas")))).alias("x")).select("x.*")
    return nodes


def plan(sizes: DataFrame, block: int = BLOCK, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """One row per source: source, at, source_size, target, blocks, and ends: where each shard's run
    of blocks ends in the source's permuted order gone round and round."""
    goal = targets(sizes).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    goal = table(goal, "targets")  # one row per source, read twice
    # a turn's last block may be short, so whole turns and the rest are counted apart
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    quota = turns * F.col("blocks") + F.round((F.col("target") - turns * F.col("source_size")) / block)
    one = goal.agg(F.array_sort(F.collect_list(F.struct("at", quota.cast("long").alias("q")))).alias("s")).select(F.transform("s", lambda x: x["q"]).alias("quotas"))
    shards = split(one, depth, seed)
    rows = shards.select("shard", F.posexplode("quotas").alias("at", "q"))
    ends = rows.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("shard", "q"))).alias("s"))
    running = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("t"), F.expr("cast(array() as array<bigint>)").alias("o")), lambda a, x: F.struct((a["t"] + x["q"]).alias("t"), F.concat(a["o"], F.array(a["t"] + x["q"])).alias("o")))["o"]
    ends = ends.select("at", running.alias("ends"))
    return goal.join(ends, "at")


SLICE = "array<struct<shard:bigint,first:bigint,last:bigint,turn:bigint,place:bigint>>"


def _permutation(full: Column, name: Column, seed: int) -> tuple[Column, Column]:
    """(step, shift) by which the full blocks of a source change places: b -> (b * step + shift) mod full.
    A short one stays the last."""
    shift = F.pmod(F.xxhash64(F.lit(seed + 2), name), F.greatest(full, F.lit(1)))
    prime = F.lit(PRIMES[-1]).cast("long")
    for p in reversed(PRIMES[:-1]):
        prime = F.when(full % p != 0, F.lit(p).cast("long")).otherwise(prime)
    return prime % F.greatest(full, F.lit(1)), shift


def _moved(number: Column, full: Column, step: Column, shift: Column) -> Column:
    """Where a block comes in its source's permuted order."""
    return F.when(number < full, (number * step + shift) % full).otherwise(number)


def _permuted(number: Column, full: Column, name: Column, seed: int) -> Column:
    """_moved() for a single block, with its source's permutation worked out in place."""
    return _moved(number, full, *_permutation(full, name, seed))


def mixed(sizes: DataFrame, block: int = BLOCK, depth: int = DEPTH, seed: int = 0, whole: bool = False) -> DataFrame:
    """One row per row of sizes (see sized): doc_id, source, size, source_size, target, slices, taken.

    slices are the words (first, one past last) that a shard takes of the document in a turn
    through its source, with the slice's place in the shard's order; taken is their sum. A slice is
    the part of a block that lies in the document. With whole, documents aren't cut: a source's
    documents, in their random order, take the place of its blocks, and a turn takes all of a document
    where the block of its first word is taken.
    Rows of a source are ranked in parts of RANKED documents or so, so that no task ranks a whole source.
    Equal rows may change places with each other. Columns carried by sizes stay. A null source is a
    source like any other, a null key sorts first, rows that repeat a key are documents of their own,
    and a document without words, or all of an empty table's none, gives no slices.
    """
    rows = sizes.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1))
    rows = table(rows, "sizes")  # read for the sums and for the ranks
    buckets = -(-rows.count() // RANKED) or 1  # from file footers
    rows = rows.withColumn("bucket", F.floor(F.col("h") / float(1 << 63) * buckets).cast("long"))
    runs = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    # the sums by part join on a string, since a null source must meet itself
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    within = Window.partitionBy("name", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("name", named).join(runs.select(named.alias("name"), "bucket", "base"), ["name", "bucket"])
    ranked = ranked.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    full = F.floor(F.col("source_size") / block).cast("long")
    step, shift = _permutation(full, named, seed)
    goal = table(plan(rows.select("source", "size"), block, depth, seed), "plan")
    goal = goal.select(named.alias("name"), "source_size", "target", "blocks", "ends", F.element_at("ends", -1).alias("quota"), full.alias("full"), step.alias("step"), shift.alias("shift"))
    goal = table(goal, "sources")  # a row per source, so that nothing of it is worked out per block
    few = goal.count() <= BROADCAST_SOURCES
    joined = ranked.join(F.broadcast(goal) if few else goal, "name")
    turns = F.sequence(F.lit(0).cast("long"), F.lit(int(MOST)).cast("long"))
    start, size, blocks = F.col("start"), F.col("size"), F.col("blocks")
    of = lambda word: F.floor(word / block).cast("long")
    numbers = F.array(of(start)) if whole else F.sequence(of(start), of(start + size - 1))

    def located(at: Column) -> Column:
        """The shard of a place below the quota: how many of the ascending ends it has passed, by bisection."""
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(depth))]) if depth else F.expr("cast(array() as array<int>)")
        return F.aggregate(halves, F.lit(0), lambda n, h: n + F.when(F.get("ends", n + h - 1) <= at, h).otherwise(0)).cast("long")

    def cut(turn: Column) -> Column:
        def place(number: Column) -> Column:
            moved = number if whole else _moved(number, F.col("full"), F.col("step"), F.col("shift"))
            return F.struct(number.alias("number"), (turn * blocks + moved).alias("at"))

        def one(x: Column) -> Column:
            number = x["number"]
            first = F.lit(0).cast("long") if whole else F.greatest(number * block - start, F.lit(0).cast("long"))
            last = size if whole else F.least((number + 1) * block - start, size)
            made = lambda shard: F.struct(shard.alias("shard"), first.alias("first"), last.alias("last"), turn.alias("turn"), F.xxhash64(F.lit(seed + 1), "doc_id", turn, first, shard).alias("place"))
            return F.get(F.transform(F.array(located(x["at"])), made), F.lit(0))  # binds the shard, which is used twice

        hits = F.filter(F.transform(numbers, place), lambda x: x["at"] < F.col("quota"))
        return F.when(turn * blocks < F.col("quota"), F.transform(hits, one)).otherwise(F.expr(f"cast(array() as {SLICE})"))

    cuts = F.when(size > 0, F.flatten(F.transform(turns, cut))).otherwise(F.expr(f"cast(array() as {SLICE})"))
    out = joined.withColumn("slices", cuts)
    taken = F.aggregate("slices", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    carried = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    return out.select("doc_id", "source", "size", "source_size", "target", "slices", taken.alias("taken"), *carried)


def shards(mix: DataFrame, *columns: str, lots: int = LOTS) -> DataFrame:
    """A row per slice of mixed(): shard, lot, place, doc_id, first, last and the columns named,
    shuffled within its shard: rows of a shard's lot come together, in the order of their place,
    and a slice's lot follows from its place, so lots in turn are the whole shard in order."""
    # places are uniform, so lots are even whatever the source
    rows = mix.select("doc_id", F.explode("slices").alias("x"), *columns).select("x.shard", "x.place", "doc_id", "x.first", "x.last", *columns)
    rows = rows.withColumn("lot", F.floor((F.col("place").cast("double") / float(1 << 64) + 0.5) * lots).cast("int"))
    rows = rows.select("shard", "lot", "place", "doc_id", "first", "last", *columns)
    return rows.repartition("shard", "lot").sortWithinPartitions("shard", "lot", "place")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(sized(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")
