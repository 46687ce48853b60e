"""Subpath search and navigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import PREFIX_LIMIT, PathIndex, flip, reverse_path
from ..plans.tables import BLOCK, cut, sums_within


def find_nodes(index: PathIndex, nodes: DataFrame) -> DataFrame:
    """(node, sp, ep, cnt) of each node that is visited."""
    own = index.node_sizes.join(nodes.select("node").distinct(), "node", "left_semi")
    return own.select("node", F.lit(0).cast("long").alias("sp"), (F.col("size") - 1).alias("ep"), F.col("size").alias("cnt"))


#: The two hashes that name a word of several nodes: 128 bits, so that equal names are taken for equal words.
WORD = ("w1", "w2")


def named(*parts: Column) -> list[Column]:
    """The name of a word from its two nodes, or from the names of its halves."""
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in enumerate(WORD)]


def _pattern_words(patterns: DataFrame, half: int | None) -> DataFrame:
    """``patterns`` (pattern, names) with the names of all their words of twice ``half`` nodes; of two nodes to begin with."""
    size = F.size("pattern")
    both = lambda a, b: F.struct(*named(*([a, b] if half is None else [a["w1"], a["w2"], b["w1"], b["w2"]])))
    shift, items = (1, F.col("pattern")) if half is None else (half, F.col("names"))
    n = F.size(items) - shift
    return patterns.filter(size >= 2 * (half or 1)).select("pattern", F.zip_with(F.slice(items, 1, n), F.slice(items, F.lit(1 + shift), n), both).alias("names"))


def _found(index: PathIndex, patterns: DataFrame, from_start: bool = False) -> DataFrame:
    """(pattern, node, sp, ep, cnt) of the distinct patterns of two nodes at least that occur.

    Visits and patterns name their words of 2, 4, 8, ... nodes alike. A pattern is its first and its last word of the largest length that
    fits, so that a visit's two words are all that is compared: visits are counted by them first, and patterns are looked up
    in the counts. Words of two nodes stand in the visits; each doubling is one equi-join of the visits whose word some pattern has.
    """
    rest = _pattern_words(patterns.select("pattern").distinct().filter(F.size("pattern") > 1), None)
    longest = patterns.agg(F.max(F.size("pattern"))).first()[0] or 0
    visits = index.visits.filter("pos > 0 and next <> 0").select("seq_id", "pos", F.col("next_off").alias("end"), *named(F.col("node"), F.col("next")))
    out, length = None, 2
    while out is None or length <= longest:
        rest = cut(rest)
        words = visits.join(rest.select(F.explode("names").alias("w")).select("w.*").distinct(), list(WORD), "left_semi")
        words = cut(words) if 2 * length <= longest else words
        due = rest.filter(F.size("pattern") < 2 * length).select("pattern", F.size("pattern").alias("m"), F.get("names", F.lit(0)).alias("f"), F.element_at("names", -1).alias("l")).select("pattern", "m", "f.*", F.col("l.w1").alias("l1"), F.col("l.w2").alias("l2"))
        begin = words.filter("pos = 1") if from_start else words
        met = begin.join(due.select(*WORD, "m").distinct(), list(WORD))
        whole = met.filter(F.col("m") == length).select(*WORD, "m", F.col("w1").alias("l1"), F.col("w2").alias("l2"), "end")
        last = words.select("seq_id", F.col("pos").alias("last"), F.col("w1").alias("l1"), F.col("w2").alias("l2"), "end")
        longer = met.filter(F.col("m") > length).drop("end").withColumn("last", F.col("pos") + F.col("m") - length).join(last, ["seq_id", "last"]).select(*WORD, "m", "l1", "l2", "end")
        counts = whole.unionByName(longer).groupBy(*WORD, "l1", "l2", "m").agg(F.min("end").alias("sp"), F.max("end").alias("ep"), F.count(F.lit(1)).alias("cnt"))
        states = due.join(counts, [*WORD, "l1", "l2", "m"]).select("pattern", F.element_at("pattern", -1).alias("node"), "sp", "ep", "cnt")
        out = states if out is None else out.unionByName(states)
        if 2 * length <= longest:
            after = words.select("seq_id", (F.col("pos") - length).alias("pos"), F.col("w1").alias("l1"), F.col("w2").alias("l2"), F.col("end").alias("far"))
            visits = words.join(after, ["seq_id", "pos"]).select("seq_id", "pos", F.col("far").alias("end"), *named(F.col("w1"), F.col("w2"), F.col("l1"), F.col("l2")))
            rest = _pattern_words(rest, length)
        length *= 2
    return out


def _answers(patterns: DataFrame, single: DataFrame, states: DataFrame) -> DataFrame:
    """States of the patterns of one node (node, sp, ep, cnt) and of longer ones (pattern, ...), for each query."""
    longer = patterns.join(states, "pattern").select("query_id", "node", "sp", "ep", "cnt")
    short = patterns.filter(F.size("pattern") == 1).select("query_id", F.get("pattern", F.lit(0)).alias("node"))
    return longer.unionAll(short.join(single, "node").select("query_id", "node", "sp", "ep", "cnt"))


def find(index: PathIndex, patterns: DataFrame) -> DataFrame:
    """(query_id, node, sp, ep, cnt) of each pattern (query_id, pattern) that occurs; an empty pattern doesn't."""
    single = index.node_sizes.select("node", F.lit(0).cast("long").alias("sp"), (F.col("size") - 1).alias("ep"), F.col("size").alias("cnt"))
    return _answers(patterns, single, _found(index, patterns))


def find_by_extension(index: PathIndex, patterns: DataFrame, longest: int) -> DataFrame:
    """The same by extending node by node: ``longest`` sweeps, each on shrinking states that are written, so that plans stay flat."""
    first = patterns.filter(F.size("pattern") > 0)
    states = first.select("query_id", "pattern", F.element_at("pattern", 1).alias("node")).join(index.node_sizes.select("node", F.lit(0).cast("long").alias("sp"), (F.col("size") - 1).alias("ep")), "node")
    for k in range(2, longest + 1):
        rest = states.filter(F.size("pattern") >= k).withColumn("to", F.get("pattern", F.lit(k - 1)))
        done = states.filter(F.size("pattern") < k)
        moved = extend(index, rest.select("query_id", "node", "sp", "ep", "to")).select("query_id", "node", "sp", "ep")
        states = cut(done.unionByName(moved.join(first.select("query_id", "pattern"), "query_id")))
    return states.select("query_id", "node", "sp", "ep", (F.col("ep") - F.col("sp") + 1).alias("cnt"))


def prefix(index: PathIndex, patterns: DataFrame) -> DataFrame:
    """As ``find``, for paths that begin with the pattern; the empty one gives all sequences at the endmarker."""
    all_seqs = index.visits.filter("pos = 0").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 0")
    empty = patterns.filter(F.size("pattern") == 0).select("query_id").crossJoin(F.broadcast(all_seqs))  # one row
    empty = empty.select("query_id", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("sp"), (F.col("cnt") - 1).alias("ep"), "cnt")
    first = index.visits.filter("pos = 1").groupBy("node").agg(F.min("off").alias("sp"), F.max("off").alias("ep"), F.count(F.lit(1)).alias("cnt"))
    return _answers(patterns, first, _found(index, patterns, from_start=True)).unionByName(empty)


#: Offsets per block of a range join.
RANGE_BLOCK = 1024


def visits_in(index: PathIndex, states: DataFrame) -> DataFrame:
    """Each state (query_id, node, sp, ep, ...) with the visits in its range.

    Ranges are cut into blocks of offsets, so that the join is on equal (node, block) and a hot node's visits meet only the
    states that reach their block.
    """
    blocks = states.withColumn("_block", F.explode(F.sequence(F.floor(F.col("sp") / RANGE_BLOCK), F.floor(F.col("ep") / RANGE_BLOCK))))
    own = index.visits.withColumn("_block", F.floor(F.col("off") / RANGE_BLOCK))
    return blocks.join(own, ["node", "_block"]).filter(F.col("off").between(F.col("sp"), F.col("ep"))).drop("_block")


def counts_before(index: PathIndex, points: DataFrame) -> DataFrame:
    """Points (node, via, at, ...) with ``before``: the visits of ``node`` at smaller offsets than ``at`` that go to ``via``.

    Points and visits are laid out by offset within (node, via) and swept once, block by block; nothing is paired.
    """
    cols = points.columns
    wanted = points.select("node", "via").distinct()
    points = points.withColumn("at", F.col("at").cast("long"))
    steps = index.visits.select("node", F.col("next").alias("via"), F.col("off").alias("at")).join(wanted, ["node", "via"], "left_semi").withColumn("_step", F.lit(1))
    rows = points.withColumn("_step", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    return sums_within(rows, ["node", "via"], "at", ["_step"], F.col("_step"), "before", index.largest).filter("_step = 0").select(*cols, "before")


def _range_counts(index: PathIndex, states: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, *key, node, next, lo, cnt) of states with ``via``: visits toward it before, and within, the range."""
    end = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("end"))
    ends = states.select("query_id", *key, "node", "via", F.inline(F.array(end(F.col("sp"), 0), end(F.col("ep") + 1, 1))))
    both = counts_before(index, ends).groupBy("query_id", *key, "node", "via").agg(*[F.max(F.when(F.col("end") == n, F.col("before"))).alias(name) for n, name in enumerate(("lo", "hi"))])
    return both.select("query_id", *key, "node", F.col("via").alias("next"), "lo", (F.col("hi") - F.col("lo")).alias("cnt"))


def successor_counts(index: PathIndex, states: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every edge of each state's node."""
    edges = index.edges.select(F.col("src").alias("node"), F.col("dst").alias("via"))
    return _range_counts(index, states.select("query_id", *key, "node", "sp", "ep").join(edges, "node"), list(key))


def _toward(index: PathIndex, states: DataFrame, *more: str) -> DataFrame:
    """The counts of each state's one edge to ``to``."""
    return _range_counts(index, states.select("query_id", *more, "node", "sp", "ep", F.col("to").alias("via")), list(more))


def _moved(index: PathIndex, counts: DataFrame, *more: str) -> DataFrame:
    """Counts of an edge (node -> next) as the state they lead to; the endmarker has a count but no range."""
    start = index.edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "rank_off")
    at = F.when(F.col("next") != 0, F.col("rank_off") + F.col("lo"))
    return counts.filter("cnt > 0").join(start, ["node", "next"]).select("query_id", *more, F.col("node").alias("from"), F.col("next").alias("node"), at.alias("sp"), (at + F.col("cnt") - 1).alias("ep"), "cnt")


def extend(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, node, sp, ep, cnt) of (query_id, node, sp, ep, to)."""
    return _moved(index, _toward(index, states)).select("query_id", "node", "sp", "ep", "cnt")


def lf(index: PathIndex, positions: DataFrame) -> DataFrame:
    """(node, off, next, next_off): one step along the path."""
    return positions.join(index.visits.select("node", "off", "next", "next_off"), ["node", "off"])


def lf_to(index: PathIndex, positions: DataFrame) -> DataFrame:
    """(node, off, to, target): where a visit at (node, off) that went to ``to`` would stand; null without that edge."""
    counted = counts_before(index, positions.select("node", F.col("off").alias("at"), F.col("to").alias("via"))).withColumnRenamed("via", "to")
    reach = index.edges.filter("dst <> 0").select(F.col("src").alias("node"), F.col("dst").alias("to"), "rank_off")
    return counted.join(reach, ["node", "to"], "left").select("node", F.col("at").alias("off"), "to", (F.col("rank_off") + F.col("before")).alias("target"))


def before_source(index: PathIndex, pairs: DataFrame) -> DataFrame:
    """(src, dst, less) of distinct pairs (src, dst): the visits of ``dst`` from smaller sources than ``src``, whether there is such an edge or not.

    Sources are looked up in the running sums of the target's incoming edges by one sweep, so that rows are as many as edges and pairs.
    """
    rows = pairs.select("src", "dst", F.lit(0).cast("long").alias("cnt"), F.lit(0).alias("_edge"))
    rows = rows.unionByName(index.edges.filter("dst <> 0").select("src", "dst", "cnt", F.lit(1).alias("_edge")))
    return sums_within(rows, ["dst"], "src", ["_edge"], F.col("cnt"), "less").filter("_edge = 0").select("src", "dst", "less")


def full_lf(index: PathIndex, positions: DataFrame) -> DataFrame:
    """As ``lf_to``, but defined without the edge: visits of ``to`` from smaller sources; 0 for a missing node, null for the endmarker."""
    counted = counts_before(index, positions.select("node", F.col("off").alias("at"), F.col("to").alias("via"))).withColumnRenamed("via", "to")
    less = before_source(index, positions.select(F.col("node").alias("src"), F.col("to").alias("dst")).distinct()).withColumnsRenamed({"src": "node", "dst": "to"})
    return counted.join(less, ["node", "to"]).select("node", F.col("at").alias("off"), "to", F.when(F.col("to") != 0, F.col("less") + F.col("before")).alias("target"))


def lf_range_first(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, node, sp, ep, starts_with_to, first_run): the range step with the first logical run that goes to ``to``."""
    moved = _moved(index, _toward(index, states.withColumn("from_sp", F.col("sp")), "from_sp"), "from_sp").filter("node <> 0")
    first = index.visits.select(F.col("next").alias("node"), F.col("next_off").alias("sp"), F.col("node").alias("from"), F.col("off").alias("first"))
    runs = numbered(index, logical=True).select(F.col("node").alias("from"), F.col("off").alias("first"), F.col("run_id").alias("first_run"))
    with_run = moved.join(first, ["node", "sp", "from"]).join(runs, ["from", "first"])
    return with_run.select("query_id", "node", "sp", "ep", (F.col("first") == F.col("from_sp")).alias("starts_with_to"), "first_run")


def numbered(index: PathIndex, logical: bool = False) -> DataFrame:
    """(node, off, run_id): the run of each visit."""
    return index.run_of_visits(logical).select("node", "off", "run_id")


def run_lf(index: PathIndex, positions: DataFrame) -> DataFrame:
    """(node, off, next, next_off, run_id, run_end): a step with the concrete run that covers the position."""
    runs = index.runs.select("node", "run_id", (F.col("start_off") + F.col("len") - 1).alias("run_end"))
    return lf(index, positions).join(numbered(index), ["node", "off"]).join(runs, ["node", "run_id"]).select("node", "off", "next", "next_off", "run_id", "run_end")


def inverse_lf(index: PathIndex, positions: DataFrame) -> DataFrame:
    """(node, off, prev, prev_off): one step back; nothing at the endmarker, and only for bidirectional indexes."""
    found = positions.join(index.visits.filter("node <> 0").select("node", "off", "prev", "prev_off"), ["node", "off"])
    return found if index.bidirectional else found.limit(0)


def offset_to(index: PathIndex, targets: DataFrame) -> DataFrame:
    """(node, off, to, i): the visit (node, off) that a step leads to position ``i`` of ``to``."""
    return targets.join(index.visits.select(F.col("next").alias("to"), F.col("next_off").alias("i"), "node", "off"), ["to", "i"])


def bd_find(index: PathIndex, nodes: DataFrame) -> DataFrame:
    """(node, sp, ep, back_node, back_sp, back_ep): both states of a single node."""
    own = find_nodes(index, nodes).select("node", "sp", "ep")
    return own.select("node", "sp", "ep", flip(F.col("node")).alias("back_node"), F.col("sp").alias("back_sp"), F.col("ep").alias("back_ep"))


def reverse_offset(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, to, reverse_offset): visits in range whose reversed successor precedes the reversed ``to``; ends count as smaller.

    A range that many queries share is counted once, and one count of its edges serves every ``to``.
    """
    own = cut(states.select("query_id", "to", F.struct("node", "sp", "ep").alias("range")).distinct())
    counts = successor_counts(index, own.select(F.col("range").alias("query_id"), "range.*").distinct()).select(F.col("query_id").alias("range"), "next", "cnt")
    asked = own.select("range", "to").distinct().join(counts, "range").groupBy("range", "to").agg(F.sum(F.when(_smaller(), F.col("cnt")).otherwise(0)).alias("n"))
    return own.join(asked, ["range", "to"]).groupBy("query_id", "to").agg(F.sum("n").alias("reverse_offset"))


def _smaller() -> Column:
    return (F.col("next") != F.col("to")) & ((F.col("next") == 0) | (flip(F.col("next")) < flip(F.col("to"))))


BD_STATE = ("node", "sp", "ep", "back_node", "back_sp", "back_ep")


def bd_extend_forward(index: PathIndex, states: DataFrame) -> DataFrame:
    """Both states after appending ``to``; (query_id, *BD_STATE)."""
    key = ("to", "back_node", "back_sp")
    toward = F.col("next") == F.col("to")
    of = lambda c: F.max(F.when(toward, F.col(c))).alias(c)
    shift = F.sum(F.when(_smaller(), F.col("cnt")).otherwise(0)).alias("shift")
    # One pass over the counts of all edges gives both ends of the reversed range and the edge that is taken.
    taken = successor_counts(index, states, key).groupBy("query_id", *key, "node").agg(shift, of("lo"), of("cnt")).withColumn("next", F.col("to"))
    moved = _moved(index, taken.filter("next <> 0 and cnt > 0"), *key, "shift")
    start = F.col("back_sp") + F.col("shift")
    return moved.select("query_id", "node", "sp", "ep", "back_node", start.alias("back_sp"), (start + F.col("cnt") - 1).alias("back_ep"))


def bd_flip(states: DataFrame) -> DataFrame:
    """Exchange the two directions."""
    swap = {"node": "back_node", "sp": "back_sp", "ep": "back_ep", "back_node": "node", "back_sp": "sp", "back_ep": "ep"}
    return states.select(*[F.col(swap[c]).alias(c) if c in swap else F.col(c) for c in states.columns])


def bd_extend_backward(index: PathIndex, states: DataFrame) -> DataFrame:
    """Both states after putting ``to`` in front."""
    return bd_flip(bd_extend_forward(index, bd_flip(states).withColumn("to", flip(F.col("to")))))


def bd_search(index: PathIndex, patterns: DataFrame, longest: int) -> DataFrame:
    """Both states of each pattern: from its middle to the right, then to the left."""
    middle = (F.size("pattern") / 2).cast("int")
    own = patterns.filter(F.size("pattern") > 0).withColumn("mid", middle)
    nodes = own.select(F.get("pattern", F.col("mid")).alias("node"))
    states = own.select("query_id", F.get("pattern", F.col("mid")).alias("node")).join(bd_find(index, nodes), "node").select("query_id", *BD_STATE)
    for step in range(1, (longest - 1) // 2 + 1):
        at = F.col("mid") + step
        states = _advance(index, states, own.filter(at < F.size("pattern")), at, bd_extend_forward, own)
    for step in range(1, longest // 2 + 1):
        at = F.col("mid") - step
        states = _advance(index, states, own.filter(at >= 0), at, bd_extend_backward, own)
    return states


def _advance(index, states: DataFrame, due: DataFrame, at: Column, how, own: DataFrame) -> DataFrame:
    """Extend the states of the patterns that are ``due``; keep the others."""
    moved = how(index, states.join(due.select("query_id", F.get("pattern", at).alias("to")), "query_id"))
    kept = states.join(due.select("query_id"), "query_id", "left_anti")
    return cut(kept.select("query_id", *BD_STATE).unionByName(moved.select("query_id", *BD_STATE)))


def find_both(index: PathIndex, patterns: DataFrame) -> DataFrame:
    """What ``bd_search`` gives, by two direct searches: the pattern's and its reverse's."""
    back = find(index, patterns.select("query_id", reverse_path(F.col("pattern")).alias("pattern")))
    names = {"node": "back_node", "sp": "back_sp", "ep": "back_ep"}
    return find(index, patterns).drop("cnt").join(back.select("query_id", *[F.col(a).alias(b) for a, b in names.items()]), "query_id")


def start(index: PathIndex, sequences: DataFrame) -> DataFrame:
    """(seq_id, node, off): the first position of each sequence; the endmarker for an empty one."""
    return sequences.join(index.visits.filter("pos = 0").select("seq_id", F.col("next").alias("node"), F.col("next_off").alias("off")), "seq_id")


def longest_common_suffix(index: PathIndex, method: str | None = None) -> DataFrame:
    """(node, off, lcs): how many nodes back, itself included, the visits ``off`` and ``off + 1`` agree.

    Short paths are compared as arrays of their preceding nodes, long ones by ranks of doubled lengths.
    """
    if method is None:
        longest = index.visits.agg(F.max("pos")).first()[0] or 0
        method = "prefix" if longest <= PREFIX_LIMIT else "doubling"
    if method == "doubling":
        return _lcs_by_doubling(index)
    own = index.visits.filter("node <> 0").select("node", "off", "seq_id", "pos")
    back = own.join(index.paths, "seq_id").select("node", "off", F.reverse(F.slice("path", 1, F.greatest(F.col("pos") - 1, F.lit(0)).cast("int"))).alias("back"))
    pairs = back.join(back.select("node", (F.col("off") - 1).alias("off"), F.col("back").alias("other")), ["node", "off"])
    same = F.zip_with("back", "other", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    common = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("back"), F.size("other")))
    return pairs.select("node", "off", (common + 1).cast("long").alias("lcs"))


#: Nodes before a visit that are compared one by one before words are doubled.
NEAR = 16


def _lcs_by_doubling(index: PathIndex) -> DataFrame:
    """Neighbours are compared by their last ``NEAR`` nodes. Where all agree and the visits before both are neighbours too, the two agree in one node more than
    those, which is filled in along the sequence; only the other pairs go back by doubled words. Start rows never agree."""
    rows = index.visits.select("node", "off", "seq_id", "pos", "prev", "prev_off")
    back = F.reverse(F.collect_list("node").over(Window.partitionBy("seq_id").orderBy("pos").rowsBetween(1 - NEAR, Window.currentRow)))
    rows = rows.withColumn("back", back).filter("node <> 0")
    block = F.floor(F.col("off") / BLOCK)
    rows = rows.withColumn("_block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("off") - 1) / BLOCK)))))
    after = F.lead(F.struct("seq_id", "pos", "prev", "prev_off", "back")).over(Window.partitionBy("node", "_block").orderBy("off"))
    pairs = rows.withColumn("b", after).filter(block == F.col("_block")).filter("b is not null")
    same = F.zip_with("back", "b.back", lambda x, y: F.coalesce((x == y) & (x != 0), F.lit(False)))
    near = F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1
    follows = F.coalesce((F.col("prev") != 0) & (F.col("prev") == F.col("b.prev")) & (F.col("prev_off") + 1 == F.col("b.prev_off")), F.lit(False))
    pairs = cut(pairs.select("node", "off", F.col("seq_id").alias("seq_a"), F.col("pos").alias("pos_a"), F.col("b.seq_id").alias("seq_b"), F.col("b.pos").alias("pos_b"), near.cast("long").alias("lcs"), follows.alias("follows")))
    open_ = pairs.filter("lcs is null and not follows").drop("lcs", "follows")
    known = pairs.filter("lcs is not null or follows").select("node", "off", "seq_a", "pos_a", "lcs")
    if open_.limit(1).count():
        known = known.unionByName(_lcs_by_words(index, open_))
    along = Window.partitionBy("seq_a").orderBy("pos_a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("lcs").isNotNull(), F.col("lcs") - F.col("pos_a")), ignorenulls=True).over(along)
    return known.select("node", "off", (last + F.col("pos_a")).alias("lcs"))


def _lcs_by_words(index: PathIndex, pairs: DataFrame) -> DataFrame:
    """(node, off, seq_a, pos_a, lcs): both visits of a pair go back by the longest words that agree, then by shorter ones."""
    needed = pairs.select(F.col("seq_a").alias("seq_id")).unionAll(pairs.select("seq_b")).distinct()
    along, size, levels = Window.partitionBy("seq_id").orderBy("pos"), 1, []
    words = index.visits.select("seq_id", "pos", F.when(F.col("node") == 0, -1 - F.col("seq_id")).otherwise(F.col("node")).alias("w")).join(needed, "seq_id", "left_semi")
    words = words.withColumn("word_1", F.struct(*[F.xxhash64(F.lit(salt), "w").alias(name) for salt, name in enumerate(WORD)]))
    while size <= index.longest:
        levels.append(size)
        own, before = F.col(f"word_{size}"), F.lag(f"word_{size}", size).over(along)
        words, size = words.withColumn(f"word_{2 * size}", F.when(before.isNotNull(), F.struct(*named(before["w1"], before["w2"], own["w1"], own["w2"])))), 2 * size
    words = cut(words.select("seq_id", "pos", *[f"word_{n}" for n in levels]))
    pairs = pairs.select("*", F.col("pos_a").alias("at_a"), F.col("pos_b").alias("at_b"))
    for n in reversed(levels):
        of = lambda x: words.filter(f"word_{n} is not null").select(F.col("seq_id").alias(f"seq_{x}"), F.col("pos").alias(f"at_{x}"), F.col(f"word_{n}").alias(f"w_{x}"))  # noqa: E731, B023
        met = pairs.join(of("a"), ["seq_a", "at_a"], "left").join(of("b"), ["seq_b", "at_b"], "left")
        step = F.when(F.col("w_a") == F.col("w_b"), n).otherwise(0)
        pairs = cut(met.select("node", "off", "seq_a", "pos_a", "seq_b", (F.col("at_a") - step).alias("at_a"), (F.col("at_b") - step).alias("at_b")))
    return pairs.select("node", "off", "seq_a", "pos_a", (F.col("pos_a") - F.col("at_a")).alias("lcs"))


def extend_all(index: PathIndex, states: DataFrame) -> DataFrame:
    """(query_id, node, sp, ep, cnt) for every successor of each state but the endmarker."""
    return _moved(index, successor_counts(index, states).filter("next <> 0")).select("query_id", "node", "sp", "ep", "cnt")


def chain(index: PathIndex, step, states: DataFrame, nodes: list[int]) -> DataFrame:
    """Extend all states by the same nodes in turn."""
    return reduce(lambda s, n: step(index, s.withColumn("to", F.lit(n).cast("long"))), nodes, states)
