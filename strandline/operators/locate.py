"""From positions to sequences and back: locate, extract, samples and the run-head index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import PathIndex
from ..plans.tables import agreement, as_of, cut, forget, kept, passing, sums_within
from .search import RANGE_BLOCK, visits_in
from .stats import sampled


def try_locate(index: PathIndex, positions: DataFrame, interval: int) -> DataFrame:
    """(node, off, seq_id): the sampled sequence of each position, or null."""
    return positions.join(sampled(index, interval), ["node", "off"], "left").select("node", "off", "seq_id")


def next_sample(index: PathIndex, positions: DataFrame, interval: int) -> DataFrame:
    """(node, off, sample_off, seq_id): the first sample at or after each position of a node with samples.

    The order runs over all nodes that have samples, one after the other: behind a node's last sample comes the first of a later node,
    and ``sample_off`` counts on from the position's own node. Positions behind the last sample of all have no row.
    """
    samples = sampled(index, interval)
    nodes = samples.select("node").distinct().join(index.node_sizes, "node")
    upto = sums_within(nodes, [], "node", [], F.col("size"), "upto")
    starts = cut(upto.select("node", (F.col("upto") - F.col("size")).alias("start")))
    back = lambda df: df.join(starts, "node").withColumn("g", -(F.col("start") + F.col("off")))
    found = as_of(back(positions.select("node", "off")), back(samples).select("g", "seq_id"), [], "g", ["seq_id"])
    return found.filter("met is not null").select("node", "off", (-F.col("met.at") - F.col("start")).alias("sample_off"), "met.seq_id")


def locate_positions(index: PathIndex, positions: DataFrame) -> DataFrame:
    """(node, off, seq_id) of each position."""
    return positions.join(index.visits.select("node", "off", "seq_id"), ["node", "off"])


def locate_by_walking(index: PathIndex, positions: DataFrame, interval: int) -> DataFrame:
    """The same with samples only: step along the path until a sample is met. What has met none is written after each step."""
    samples, steps = sampled(index, interval), index.visits.select("node", "off", "next", "next_off")
    open_ = positions.select("node", "off", F.col("node").alias("n"), F.col("off").alias("o"))
    found = None
    at = lambda df: df.select(F.col("node").alias("n"), F.col("off").alias("o"), *df.columns[2:])
    for _ in range(interval):
        hit = open_.join(at(samples), ["n", "o"]).select("node", "off", "seq_id")
        found = hit if found is None else found.unionByName(hit)
        missed = open_.join(at(samples), ["n", "o"], "left_anti")
        open_ = cut(missed.join(at(steps), ["n", "o"]).select("node", "off", F.col("next").alias("n"), F.col("next_off").alias("o")))
        if not open_.limit(1).count():
            break
    return found


#: Queries and sequences of a range that are paired by one task.
PAIRED_QUERIES, PAIRED_SEQUENCES = 1 << 11, 1 << 16


def _per_range(states: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, bool]:
    """(query_id, range) of the distinct states, written; the distinct ranges as states whose query_id is the range; whether each query has one range only."""
    own = kept(cut(states.select("query_id", F.struct("node", "sp", "ep").alias("range"), *more).distinct()))
    single = not own.groupBy("query_id").count().filter("count > 1").limit(1).count()
    return own.select("query_id", "range"), own.select(F.col("range").alias("query_id"), "range.*", *more).distinct(), single


def _paired(own: DataFrame, members: DataFrame, single: bool) -> DataFrame:
    """(query_id, seq_id) of queries (query_id, range) and what was located in each range (query_id, seq_id), whose query_id is the range.

    Only here are queries and sequences paired, as they are returned. A range of many queries or sequences is dealt out by blocks of both, so
    what is copied is one row for thousands of pairs, and pairs are sorted or shuffled only where a query has several ranges.
    """
    members = kept(cut(members.select(F.col("query_id").alias("range"), "seq_id")))
    blocks = lambda df, n, name: df.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / n).cast("long").alias(name))
    sizes = blocks(own, PAIRED_QUERIES, "na").join(blocks(members, PAIRED_SEQUENCES, "nb"), "range")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    queries = own.join(sizes, "range").select("query_id", "range", one("query_id", "na").alias("a"), every("nb").alias("b"))
    found = members.join(sizes, "range").select("seq_id", "range", every("na").alias("a"), one("seq_id", "nb").alias("b"))
    # A number of its own, since the pairs are many more than the rows that adaptive execution would put together.
    n, keys = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["range", "a", "b"]
    # Each sequence goes through its queries, not the other way round: a task holds the fewer of the two, and files of such pairs shrink, as the queries come again soon.
    pairs = found.repartition(n, *keys).join(queries.repartition(n, *keys), keys).select("query_id", "seq_id")
    return pairs if single else pairs.distinct()


def state_sequences(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, seq_id): the distinct sequences of each state (query_id, node, sp, ep), state by state."""
    return visits_in(index, states.select("query_id", "node", "sp", "ep")).select("query_id", "seq_id").distinct()


def offset_sequences(index: PathIndex, states: DataFrame) -> DataFrame:
    """The same, position by position; a range is listed block by block, so that no row holds all of it."""
    blocks = states.select("query_id", "node", "sp", "ep", F.explode(F.sequence(F.floor(F.col("sp") / RANGE_BLOCK), F.floor(F.col("ep") / RANGE_BLOCK))).alias("block"))
    low, high = F.greatest("sp", F.col("block") * RANGE_BLOCK), F.least("ep", F.col("block") * RANGE_BLOCK + (RANGE_BLOCK - 1))
    each = blocks.select("query_id", "node", F.explode(F.sequence(low, high)).alias("off"))
    return each.join(index.visits.select("node", "off", "seq_id"), ["node", "off"]).select("query_id", "seq_id").distinct()


def locate_states(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, seq_id): the distinct sequences of each state (query_id, node, sp, ep). A range that many queries share is located once."""
    own, ranges, single = _per_range(states)
    return _paired(own, state_sequences(index, ranges), single)


def locate_offsets(index: PathIndex, states: DataFrame) -> DataFrame:
    """The same, position by position."""
    own, ranges, single = _per_range(states)
    return _paired(own, offset_sequences(index, ranges), single)


def locate_agreement(index: PathIndex, states: DataFrame) -> DataFrame:
    """One row (compared, differing): what ``agreement`` says of ``locate_states`` and ``locate_offsets``.

    Both are compared range by range, and each range counts once for every query that has it, as long as no query has several.
    """
    own, ranges, single = _per_range(states)
    ranges = cut(ranges)
    a, b = state_sequences(index, ranges), offset_sequences(index, ranges)
    if not single:
        return agreement(_paired(own, a, single), _paired(own, b, single))
    rows = a.withColumn("_one", F.lit(1)).unionByName(b.withColumn("_one", F.lit(-1)))
    sums = rows.groupBy("query_id", "seq_id").agg(F.count_if(F.col("_one") == 1).alias("n"), F.sum("_one").alias("more"))
    each = sums.groupBy(F.col("query_id").alias("range")).agg(F.sum("n").alias("n"), F.count_if(F.col("more") != 0).alias("d"))
    queries = own.groupBy("range").agg(F.count(F.lit(1)).alias("queries"))
    total = lambda c: F.coalesce(F.sum(F.col(c) * F.col("queries")), F.lit(0))
    return each.join(queries, "range").agg(total("n").alias("compared"), total("d").alias("differing"))


def extract(index: PathIndex, sequences: DataFrame) -> DataFrame:
    """(seq_id, path) of each sequence; an unknown one has an empty path."""
    return sequences.join(index.rebuilt_paths, "seq_id", "left").select("seq_id", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


def extract_from(index: PathIndex, positions: DataFrame, max_length: int | None = None) -> DataFrame:
    """(node, off, path): what follows from each position, itself included; nothing at the endmarker."""
    at = positions.join(index.visits.select("node", "off", "seq_id", "pos"), ["node", "off"]).join(index.paths, "seq_id")
    length = F.size("path") if max_length is None else F.lit(max_length)
    rest = F.slice("path", F.greatest(F.col("pos"), F.lit(1)).cast("int"), length)
    return at.select("node", "off", F.when(F.col("pos") > 0, rest).otherwise(F.array().cast("array<bigint>")).alias("path"))


def suffix_array(index: PathIndex) -> DataFrame:
    """(node, off, seq_id, seq_offset, packed, max_length): distance to the path's end, and both numbers in one."""
    visits = index.visits
    lengths = visits.groupBy("seq_id").agg(F.max("pos").alias("length"))
    longest = lengths.agg((F.max("length") + 1).alias("max_length"))
    joined = visits.join(lengths, "seq_id").crossJoin(F.broadcast(longest))  # one row
    offset = F.col("length") - F.col("pos")
    return joined.select("node", "off", "seq_id", offset.alias("seq_offset"), pack(F.col("seq_id"), offset, F.col("max_length")).alias("packed"), "max_length")


def pack(seq_id: Column, seq_offset: Column, max_length: Column) -> Column:
    return seq_id * max_length + seq_offset


def unpack(packed: Column, max_length: Column) -> tuple[Column, Column]:
    """(seq_id, seq_offset)."""
    return F.floor(packed / max_length).cast("long"), F.pmod(packed, max_length)


def run_ends(index: PathIndex) -> DataFrame:
    """(node, run_id, start_off, end_off, head_seq, head_offset, tail_seq, tail_offset): the logical runs with the samples of their ends."""
    sa = suffix_array(index)
    runs = index.logical_runs.select("node", "run_id", "start_off", (F.col("start_off") + F.col("len") - 1).alias("end_off"))
    end = lambda at, name: sa.select("node", F.col("off").alias(at), F.col("seq_id").alias(f"{name}_seq"), F.col("seq_offset").alias(f"{name}_offset"))
    return runs.join(end("start_off", "head"), ["node", "start_off"]).join(end("end_off", "tail"), ["node", "end_off"]).select("node", "run_id", "start_off", "end_off", "head_seq", "head_offset", "tail_seq", "tail_offset")


def run_samples(index: PathIndex) -> DataFrame:
    """(node, run_id, head_seq, head_offset, tail_seq, tail_offset) of each logical run."""
    return run_ends(index).drop("start_off", "end_off")


def find_with_first(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, node, sp, ep, first, max_length): each state with the packed value at its start."""
    at = suffix_array(index).select("node", F.col("off").alias("sp"), F.col("packed").alias("first"), "max_length")
    return states.select("query_id", "node", "sp", "ep").join(at, ["node", "sp"]).select("query_id", "node", "sp", "ep", "first", "max_length")


def successors(runs: DataFrame) -> DataFrame:
    """(seq, off, to_seq, to_off) of the tail of each of the ``runs`` (``run_samples``): the visit that follows it in its node, the head of the next run; null at the node's end.

    Both are given as (sequence, distance to the path's end). A visit that is no tail steps on in one run with the visit that
    follows it, so the two keep their distance until the first one reaches a tail: these rows define the follower of every visit.
    """
    heads = runs.select("node", (F.col("run_id") - 1).alias("run_id"), F.col("head_seq").alias("to_seq"), F.col("head_offset").alias("to_off"))
    return runs.join(heads, ["node", "run_id"], "left").select(F.col("tail_seq").alias("seq"), F.col("tail_offset").alias("off"), "to_seq", "to_off")


def followed(points: DataFrame, jumps: DataFrame, longest: int | None = None) -> DataFrame:
    """``points`` (seq, off, ...) with the visit (next_seq, next_off) that jumps (seq, off, to_seq, to_off) lead to: by the last jump not beyond each."""
    met = as_of(points, jumps, ["seq"], "off", ["to_seq", "to_off"], last=longest)
    return met.select(*points.columns, F.col("met.to_seq").alias("next_seq"), (F.col("met.to_off") + F.col("off") - F.col("met.at")).alias("next_off"))


def doubled_jumps(jumps: DataFrame, longest: int | None = None) -> DataFrame:
    """The jumps that go twice as far.

    An interval of visits that jump together is cut where its image meets the beginning of another one. Images don't overlap, so an as-of
    look-up finds the interval that a beginning is the image of; each gives one cut at most, and there are never more jumps than visits.
    """
    images = jumps.filter("to_seq is not null").select(F.col("to_seq").alias("seq"), F.col("to_off").alias("off"), F.col("seq").alias("from_seq"), F.col("off").alias("from_off"))
    met = as_of(jumps.select("seq", "off"), images, ["seq"], "off", ["from_seq", "from_off"], last=longest).filter("met is not null")
    cuts = met.select(F.col("met.from_seq").alias("seq"), (F.col("met.from_off") + F.col("off") - F.col("met.at")).alias("off"), F.col("seq").alias("mid_seq"), F.col("off").alias("mid_off"))
    # An image that ends before the beginning does not hold it: jumping from the cut leads elsewhere then.
    cuts = cut(followed(cuts, jumps, longest).filter("next_seq = mid_seq and next_off = mid_off").select("seq", "off", "mid_seq", "mid_off"))
    starts = jumps.select("seq", "off", F.col("to_seq").alias("mid_seq"), F.col("to_off").alias("mid_off")).unionByName(cuts).dropDuplicates(["seq", "off"])
    far = followed(starts.filter("mid_seq is not null").select(F.col("mid_seq").alias("seq"), F.col("mid_off").alias("off"), F.col("seq").alias("own_seq"), F.col("off").alias("own_off")), jumps, longest)
    ended = starts.filter("mid_seq is null").select("seq", "off", F.col("mid_seq").alias("to_seq"), F.col("mid_off").alias("to_off"))
    return far.select(F.col("own_seq").alias("seq"), F.col("own_off").alias("off"), F.col("next_seq").alias("to_seq"), F.col("next_off").alias("to_off")).unionByName(ended)


def locate_next(index: PathIndex, values: DataFrame) -> DataFrame:
    """Packed values (..., packed, max_length) with ``next_packed``, the value that follows each in its node, from the run samples alone; other columns stay."""
    seq, off = unpack(F.col("packed"), F.col("max_length"))
    met = followed(values.select("*", seq.alias("seq"), off.alias("off")), successors(run_samples(index)), index.longest).filter("next_seq is not null")
    return met.select(*[c for c in values.columns if c != "max_length"], pack(F.col("next_seq"), F.col("next_off"), F.col("max_length")).alias("next_packed"))


def _pieces(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, cnt, seq, off): the parts of each state that lie in one run, by the first visit of each; the state's own first one begins the first part."""
    block = lambda df, a, b: df.withColumn("_block", F.explode(F.sequence(F.floor(F.col(a) / RANGE_BLOCK), F.floor(F.col(b) / RANGE_BLOCK))))
    seq, off = unpack(F.col("first"), F.col("max_length"))
    states = block(found.select("query_id", "node", "sp", "ep", seq.alias("seq"), off.alias("off")), "sp", "ep")
    met = states.join(block(runs.select("node", "start_off", "end_off", "head_seq", "head_offset"), "start_off", "end_off"), ["node", "_block"])
    begin, end = F.greatest("sp", "start_off"), F.least("ep", "end_off")
    met = met.filter((begin <= end) & (F.floor(begin / RANGE_BLOCK) == F.col("_block")))
    own = F.col("start_off") <= F.col("sp")
    return met.select("query_id", (end - begin + 1).alias("cnt"), F.when(own, F.col("seq")).otherwise(F.col("head_seq")).alias("seq"), F.when(own, F.col("off")).otherwise(F.col("head_offset")).alias("off"))


def locate_by_successors(index: PathIndex, found: DataFrame) -> DataFrame:
    """(query_id, seq_id) of states with the first visit of each (``find_with_first``), from the run samples alone.

    A range that many queries share is located once. It is cut at the run heads in it, which are known. From the values known to be 0 .. 2^k - 1 places behind a part's first one, a jump of
    2^k places gives as many again; the jumps are doubled alongside. So there are as many rounds as the longest part has binary digits, each a
    sweep over jumps and values.
    """
    with passing():
        own, ranges, single = _per_range(found, "first", "max_length")
        runs = cut(run_ends(index))
        known = cut(_pieces(runs, ranges).withColumn("place", F.lit(0).cast("long")))
        longest = known.agg(F.max("cnt")).first()[0] or 0
        # A follower is in the same node, so that only sequences which visit a state's node are jumped from or to.
        near = index.visits.join(ranges.select("node").distinct(), "node", "left_semi").select(F.col("seq_id").alias("seq")).distinct()
        jumps = cut(successors(runs).join(near, "seq", "left_semi")) if longest > 1 else None
        forget(runs)
        step, out = 1, known
        while step < longest:
            moved = followed(out.filter(F.col("place") + step < F.col("cnt")), jumps, index.longest)
            moved = cut(moved.select("query_id", "cnt", F.col("next_seq").alias("seq"), F.col("next_off").alias("off"), (F.col("place") + step).alias("place")))
            out = out.unionByName(moved)
            step *= 2
            if step < longest:
                with passing():
                    far = kept(cut(doubled_jumps(jumps, index.longest)))
                forget(jumps)
                jumps = far
        if jumps is not None:
            forget(jumps)
        return _paired(own, out.select("query_id", F.col("seq").alias("seq_id")).distinct(), single)
