"""Conversation structure repair over a suffix-shared automaton (DAWG) of role and fault signatures.

1. Rows are numbered by one range-partitioned order of (conversation, turn, role, digest of the text), so no task holds a
   conversation. A row's symbol is its role's initial and its fault. ``CHUNK`` consecutive rows of a conversation make one
   signature string, and equal signatures are one from there on.
2. The automaton's nodes are the distinct suffixes of the distinct signatures: its strings share all that they have in common from
   the end. Signatures are dealt and sorted by their reversal; a task keeps the path of the signature at hand and values
   only the nodes that it does not share with the one before.
3. A node's value is, for each state of the role grammar, the cost to go and the place of its best audit suffix among the four
   states'. Costs relative to the least and places suffice for every decision before the node, and only a few dozen such
   values exist (``CLASSES``). So a node holds one small number, a step one table look-up, and a signature acts on the classes as a
   map, by which the chunks of a long conversation are joined without reading its rows again.
4. The best audit of each signature is read once, forward, from the states its uses begin in, and handed to the conversations. A last
   pass streams the texts by conversation, beside their audits, and hashes the repaired conversation without holding it.

Grammar of role initials: ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant
text 2; a truncated row that stays adds 1. Of the cheapest audits the ASCII-least is taken; it fixes every role it writes.

Edge cases: a null conversation, turn, role or text counts as one space where it is spelled (a null text is blank, a null role has
the initial " "); null conversations are one conversation, null turns come first and don't count for gaps. Rows of one turn
are ordered by role, then by the SHA-256 of their text; repeated rows are duplicates of the first. An empty role has no
initial, fits nowhere and is reroled or deleted. Very long texts are one row each and are streamed; a conversation of any length is
cut into chunks. A conversation without rows has zeros, an empty audit and the hash of the empty string. An empty table
gives no rows. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import placed
from .common import Scratch, table

#: Rows of a conversation in one signature.
CHUNK = 4096
SPACE = " \t\n\v\f\r"
COLUMNS = ("conv_id", "turn", "role", "text")
OUT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

#: Symbols: a sound row's role initial (- for another), a truncated row's in capitals (_ for another), x for a row that must go.
SYMBOLS = "sua-SUA_x"
#: Grammar states: nothing yet, after system, after user, after assistant.
START, STATES = 0, 4
BEGIN, SYSTEM, USER, ASSISTANT = range(STATES)
KEEP = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that may be written next, and the state after it.
WRITES = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: A class of nodes: for each state the cost to go above the least, and the place of the best audit suffix among the states'.
Class = tuple[tuple[int, int], ...]


def _edits(state: int, symbol: str) -> Iterator[tuple[int, str, int]]:
    """(cost, initials, next state) of all that can be done up to and with one row; more insertions than two never pay."""
    rest = 1 if symbol in "SUA_" else 0
    for n in range(3):
        yield 2 * n + 3, "I" * n + "D", state
        if symbol != "x":
            kept = KEEP.get(symbol.lower(), {}).get(state)
            if kept is not None:
                yield 2 * n + rest, "I" * n + "K", kept
            yield 2 * n + 2 + rest, "I" * n + "R", WRITES[state]
        state = WRITES[state]


def _end() -> tuple[Class, list[str]]:
    """The class after the last row, and what is inserted there in each state."""
    tail = {BEGIN: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    order = sorted(set(tail.values()))
    return tuple((2 * len(tail[s]), order.index(tail[s])) for s in range(STATES)), [tail[s] for s in range(STATES)]


@cache
def classes() -> tuple[list[Class], list[dict], list[dict]]:
    """All classes from the end on; for each, by symbol, the class before it, and the best (cost, initials, next state) in each state.

    Strings that are prepended differ before either ends (each ends with its only D, K or R), so suffixes need be known by place only.
    """
    known = [_end()[0]]
    before: list[dict] = []
    choice: list[dict] = []
    for child in known:  # grows while it is read
        before.append({})
        choice.append({})
        for symbol in SYMBOLS:
            best = [min((cost + child[to][0], edit, child[to][1], cost, to) for cost, edit, to in _edits(s, symbol)) for s in range(STATES)]
            least = min(b[0] for b in best)
            order = sorted({b[1:3] for b in best})
            node = tuple((b[0] - least, order.index(b[1:3])) for b in best)
            if node not in known[1:]:  # the end is a class by itself, as insertions may follow there only
                known.append(node)
            before[-1][symbol] = known.index(node, 1)
            choice[-1][symbol] = [(b[3], b[1], b[4]) for b in best]
    return known, before, choice


END = 0  # the class after the last row


def signature_map(signature: str) -> bytes:
    """For each class after a signature, the class before it."""
    _, before, _ = classes()
    step = {s: bytes(b[s] for b in before) for s in set(signature)}
    out = bytes(range(len(before)))
    for symbol in reversed(signature):
        out = out.translate(step[symbol] + bytes(256 - len(before)))
    return out


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature_map(s) for s in batch.column(0).to_pylist()], pa.binary())], names=["sig", "map"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, sig, sorted by cls and the reversed sig) -> each with the costs, audits and last states from each state."""
    _, before, choice = classes()
    tails = _end()[1]
    path: list[int] = []  # classes of the nodes from the end to the signature at hand
    last_cls, last = None, ""
    for batch in batches:
        out: list[list] = [[], [], []]
        for cls, sig in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            turned = sig[::-1]
            shared = 0
            if cls == last_cls:
                least = min(len(turned), len(last))
                while shared < least and turned[shared] == last[shared]:
                    shared += 1
            else:
                path = [cls]
            del path[shared + 1 :]
            for symbol in turned[shared:]:
                path.append(before[path[-1]][symbol])
            last_cls, last = cls, turned
            row: tuple[list, list, list] = ([], [], [])
            for state in range(STATES):
                cost, audit = 0, []
                for i, symbol in enumerate(sig):
                    c, edit, state = choice[path[len(sig) - 1 - i]][symbol][state]
                    cost += c
                    audit.append(edit)
                if cls == END:
                    audit.append(tails[state])
                    cost += 2 * len(tails[state])
                for col, x in zip(row, (cost, "".join(audit), state), strict=True):
                    col.append(x)
            for col, x in zip(out, row, strict=True):
                col.append(x)
        kinds = pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["cls", "sig", "costs", "audits", "exits"])


def _fold_classes(chunks):
    """The class after each chunk of a long conversation, from its last chunk on."""
    chunks = chunks.sort_values("chunk", ascending=False)
    cls, after = END, []
    for m in chunks["map"]:
        after.append(cls)
        cls = m[cls]
    return chunks[["conv_id", "chunk"]].assign(cls=after)


def _fold_states(chunks):
    """The state in which each chunk of a long conversation begins."""
    chunks = chunks.sort_values("chunk")
    state, begins = START, []
    for exits in chunks["exits"]:
        begins.append(state)
        state = int(exits[state])
    return chunks[["conv_id", "chunk"]].assign(begins=begins)


def _spelled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(talks: DataFrame) -> DataFrame:
    """The rows after the contract's damage: drop, empty, strip stops, repeat, set the role; no null roles or texts."""
    kind = F.crc32(F.concat(_spelled("conv_id"), F.lit(":"), _spelled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_spelled("text"), ".!?", "")).otherwise(_spelled("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_spelled("role"))
    rows = talks.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(*COLUMNS)


def with_spelling(talks: DataFrame) -> DataFrame:
    """The four columns, with null roles and texts as one space."""
    return talks.select("conv_id", "turn", _spelled("role").alias("role"), _spelled("text").alias("text"))


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, digest, at, fault, sym): the rows in their order, with their first fault."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(stripped == "", "blank").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
    )
    slim = scratch.keep(placed(slim, ["conv_id", "turn", "role", "digest"], "at"))
    firsts = slim.filter("fault <> 'blank'").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    slim = slim.join(firsts, "at", "left").withColumn("fault", F.when((F.col("fault") != "blank") & F.col("first").isNull(), "duplicate").otherwise(F.col("fault")))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("-")
    sym = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.translate(initial, "sua-", "SUA_")).otherwise(initial)
    return slim.select("conv_id", "turn", "role", "digest", "at", "fault", initial.alias("initial"), sym.alias("sym"))


def _chunks(numbered: DataFrame, size: int) -> DataFrame:
    """One row per chunk of a conversation: its signature, its first row's place in the order, counts of faults and of illegal neighbours."""
    spell = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda x: x[name]), "")
    first = F.min(F.struct("at", "turn", "role", "digest"))
    of = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    parts = numbered.groupBy("conv_id", F.floor(F.col("at") / size).alias("chunk")).agg(
        spell("sym").alias("sig"), spell("initial").alias("initials"), first.alias("first"), F.min("at").alias("low"), F.max("at").alias("high"), of("blank"), of("duplicate"), of("truncated")
    )
    # A neighbour across chunks is found by its place: the last row of one chunk is right before the first of the next.
    heads = parts.select(F.col("conv_id").alias("next_conv"), (F.col("low") - 1).alias("high"), F.substring("initials", 1, 1).alias("head"))
    parts = parts.join(heads, "high", "left").withColumn("more", F.coalesce(F.col("next_conv").eqNullSafe(F.col("conv_id")) & F.col("head").isNotNull(), F.lit(False)))
    pairs = F.when(F.col("more"), F.concat("initials", "head")).otherwise(F.col("initials"))
    legal = lambda i: F.substring(pairs, i, F.lit(2)).isin("su", "ua", "au")
    illegal = F.when(F.length(pairs) < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.length(pairs) - 1), lambda i: ~legal(i))))
    tails = parts.filter("more").select((F.col("high") + 1).alias("low"), F.lit(True).alias("goes_on"))
    return parts.join(tails, "low", "left").select(
        "conv_id", "chunk", "sig", "first", "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), (F.col("more") | F.coalesce("goes_on", F.lit(False))).alias("long"),
    )


def _cheapest(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """``chunks`` with the cost and the audit of each."""
    conv = chunks.schema["conv_id"].dataType.simpleString()
    long = scratch.keep(chunks.filter("long").select("conv_id", "chunk", "sig"))
    maps = long.select("sig").distinct().mapInArrow(_maps, "sig string, map binary")
    after = scratch.keep(long.join(maps, "sig").select("conv_id", "chunk", "map").groupBy("conv_id").applyInPandas(_fold_classes, f"conv_id {conv}, chunk long, cls int"))
    chunks = chunks.join(after.withColumnsRenamed({"conv_id": "c", "chunk": "k"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left")
    chunks = scratch.keep(chunks.withColumn("cls", F.coalesce("cls", F.lit(END))).drop("c", "k"))
    nodes = chunks.select("cls", "sig", F.reverse("sig").alias("turned")).distinct().repartitionByRange("cls", "turned").sortWithinPartitions("cls", "turned").drop("turned")
    audits = scratch.keep(nodes.mapInArrow(_audits, "cls int, sig string, costs array<long>, audits array<string>, exits array<int>"))
    begins = long.select("conv_id", "chunk").alias("l").join(chunks.select("conv_id", "chunk", "cls", "sig").alias("r"), same_rows("l", "r")).select("l.conv_id", "l.chunk", "cls", "sig")
    begins = begins.join(audits.select("cls", "sig", "exits"), ["cls", "sig"]).select("conv_id", "chunk", "exits").groupBy("conv_id").applyInPandas(_fold_states, f"conv_id {conv}, chunk long, begins int")
    chunks = chunks.alias("l").join(begins.alias("r"), same_rows("l", "r"), "left").select("l.*", F.coalesce("r.begins", F.lit(START)).alias("begins"))
    at = F.col("begins") + 1
    return chunks.join(audits, ["cls", "sig"]).withColumns({"cost": F.element_at("costs", at), "audit": F.element_at("audits", at)}).drop("cls", "sig", "costs", "audits", "exits", "begins", "long")


def same_rows(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))


def _texts(state: int, letters: str, row: tuple[str, str] | None) -> tuple[int, list[tuple[str, str]]]:
    """What some edits write: the state after them and (role, text) rows; ``row`` is the one that the last letter is about, if any."""
    out = []
    for letter in letters:
        if letter in "IR":
            state = WRITES[state]
            out.append((NAMES[state], "" if letter == "I" else row[1]))
        elif letter == "K":
            state = KEEP[row[0][:1]][state]
            out.append(row)
    return state, out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, role, text, audit), audits before the rows they are about, by conversation -> (conv_id, text_sha256) of each."""
    conv, queue, head, state, sha, wrote, open_ = None, "", 0, START, hashlib.sha256(), False, False
    schema = None

    def write(rows: list[tuple[str, str]]) -> None:
        nonlocal wrote
        for role, text in rows:
            sha.update(f"{chr(10) if wrote else ''}{role}:{text}".encode())
            wrote = True

    def closed() -> tuple:
        write(_texts(state, queue[head:], None)[1])
        return conv, sha.hexdigest()

    for batch in batches:
        schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), pa.field("sha", pa.string())])
        done = []
        for c, role, text, audit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not open_ or c != conv:
                if open_:
                    done.append(closed())
                conv, queue, head, state, sha, wrote, open_ = c, "", 0, START, hashlib.sha256(), False, True
            if audit is not None:
                queue, head = queue[head:] + audit, 0
                continue
            begin = head
            while queue[head] == "I":
                head += 1
            head += 1
            state, rows = _texts(state, queue[begin:head], (role, text))
            write(rows)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema.field(0).type), pa.array([d[1] for d in done])], schema=schema)
    if open_:
        conv_, hex_ = closed()
        yield pa.RecordBatch.from_arrays([pa.array([conv_], schema.field(0).type), pa.array([hex_])], schema=schema)


def repair(talks: DataFrame, rows: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of ``talks`` (conv_id, turn, role, text): what is wrong, the cheapest audit and the repaired conversation's hash.

    ``rows`` are the rows to repair, ``talks`` itself unless given.
    """
    scratch = Scratch(talks.sparkSession)
    conv = talks.schema["conv_id"].dataType.simpleString()
    rows = with_spelling(talks) if rows is None else rows
    numbered = _numbered(rows, scratch)
    turns = numbered.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    chunks = scratch.keep(_cheapest(scratch.keep(_chunks(numbered, chunk)), scratch))

    order = ["conv_id", "turn", "role", "digest", "tag", "chunk"]
    audits = chunks.select("conv_id", "first.turn", "first.role", "first.digest", F.lit(0).alias("tag"), "chunk", F.lit(None).cast("string").alias("text"), "audit")
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("tag"), F.lit(0).cast("long").alias("chunk"), "text", F.lit(None).cast("string").alias("audit"))
    stream = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "audit")
    hashes = stream.mapInArrow(_stream, f"conv_id {conv}, sha string")

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zero = F.lit(0).cast("long")
    part = lambda df, audit=None, sha=None: df.select("conv_id", *[(F.col(c) if c in df.columns else zero).alias(c) for c in counts], (audit if audit is not None else F.lit(None).cast("struct<chunk:bigint,audit:string>")).alias("audit"), (sha if sha is not None else F.lit(None).cast("string")).alias("sha"))
    whole = part(talks.select("conv_id").distinct()).unionByName(part(turns)).unionByName(part(chunks.drop("first"), F.struct("chunk", "audit"))).unionByName(part(hashes, None, F.col("sha")))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list("audit")), lambda x: x["audit"]), "")
    out = whole.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], spelled.alias("audit"), F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return out.select(*OUT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select(*COLUMNS)
    return repair(talks, damaged(talks))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(e ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS e FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM keyed, crc
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM kinds WHERE kind <> 0
), placed_ AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p, rtrim(text, E' \t\n\x0B\x0C\r') AS stripped FROM rows_
), faulty AS (
  SELECT *, CASE WHEN stripped = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS i FROM placed_
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS q FROM faulty
), inserts(s, n, t, said) AS (
  VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (3, 1, 2, ['user:']), (2, 1, 3, ['assistant:']),
    (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (3, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:'])
), edits(s, t, e, cost, i, role) AS (
  VALUES (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (3, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (0, 2, 'R', 2, NULL, 'user'), (1, 2, 'R', 2, NULL, 'user'),
    (3, 2, 'R', 2, NULL, 'user'), (2, 3, 'R', 2, NULL, 'assistant'), (0, 0, 'D', 3, NULL, NULL), (1, 1, 'D', 3, NULL, NULL), (2, 2, 'D', 3, NULL, NULL), (3, 3, 'D', 3, NULL, NULL)
), moves AS (
  SELECT x.s, y.t, repeat('I', x.n) || y.e AS initials, y.e, 2 * x.n + y.cost AS cost, y.i, y.role, x.said FROM inserts x JOIN edits y ON x.t = y.s
), best(conv_id, q, s, cost, audit, said) AS (
  SELECT c.conv_id, 0::BIGINT, e.s, e.cost::BIGINT, e.audit, e.said
  FROM (SELECT DISTINCT conv_id FROM steps) c, (VALUES (0, 0, '', []::VARCHAR[]), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', [])) e(s, cost, audit, said)
  UNION ALL
  SELECT conv_id, q, s, min(k).cost, min(k).audit, arg_min(said, k) FROM (
    SELECT r.conv_id, r.q, m.s, {'cost': b.cost + m.cost + CASE WHEN m.e <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': m.initials || b.audit} AS k,
      m.said || CASE m.e WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [m.role || ':' || r.text] END || b.said AS said
    FROM best b JOIN steps r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.q = b.q + 1 JOIN moves m ON m.t = b.s AND (m.e = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.i IS NULL OR m.i = r.i)
  ) GROUP BY conv_id, q, s
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p > 1 AND coalesce(li || i, '') NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS li FROM steps) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.s = 0 AND b.q = c.n
"""
