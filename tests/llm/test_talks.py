"""Conversation repair against enumerated audits and against its SQL."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import talks

WS = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, sig string, chunk int, digest string, cost long"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spell = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{spell(conv)}:{spell(turn)}".encode()) % 20
        role, text = ("user" if kind == 4 else spell(role)), spell(text)
        text = {1: "", 2: re.sub(r"[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """The contract for one conversation's rows, by trying every audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        s = text.strip(WS)
        faults.append("blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    best = None
    slots = [[""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)] for _ in range(len(rows) + 1)]
    acts = [["D"] + ([] if f in ("blank", "duplicate") else ["K", "Ru", "Ra"]) for f in faults]
    for ins in itertools.product(*slots):
        for act in itertools.product(*acts):
            cost, audit, said = 0, "", []
            for i, row in enumerate(rows):
                said += [(c, "") for c in ins[i]]
                audit += "I" * len(ins[i]) + act[i][0]
                cost += 2 * len(ins[i]) + {"D": 3, "K": 0, "R": 2}[act[i][0]] + (act[i] != "D" and faults[i] == "truncated")
                said += [] if act[i] == "D" else [(row[2], row[3])] if act[i] == "K" else [(act[i][1], row[3])]
            said += [(c, "") for c in ins[-1]]
            audit, cost = audit + "I" * len(ins[-1]), cost + 2 * len(ins[-1])
            if not all(r for r, _ in said) or not re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, [({"u": "user", "a": "assistant"}.get(r, r), t) for r, t in said]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best[:2], sha


def some_rows(n, longest, seed):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n - 1)]:
        for _ in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sub"]), rng.choice(["Yes.", "no", " ", "", None, "Why? \n", "ü!", "Yes."])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("chunk", [1, 2, 5, talks.CHUNK])
def test_repair_agrees_with_every_audit_tried(spark, chunk):
    rows = some_rows(40, 3, 5)
    df = frame(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in talks.repair(df, talks.damaged(df), chunk).collect()}
    assert set(got) == {r[0] for r in rows}
    after = damage(rows)
    for conv in got:
        assert got[conv] == plain([r for r in after if r[0] == conv]), conv


@pytest.mark.parametrize("chunk", [3, 64, talks.CHUNK])
def test_long_conversations_agree_with_sql(spark, tmp_path, chunk):
    rows = some_rows(8, 60, 9) + [(100, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(700)]
    df = frame(spark, rows)
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.sql(talks.OP11_SQL)
    assert want.columns == list(talks.OUT)
    assert Counter(map(tuple, talks.repair(df, talks.damaged(df), chunk).collect())) == Counter(want.fetchall())


def test_undamaged_and_empty(spark):
    df = frame(spark, [(1, 1, "user", "a."), (1, 2, "assistant", "b. "), (2, 1, "assistant", "x" * 200_000), (3, 1, "user", None)])
    got = {r["conv_id"]: r for r in talks.repair(df).collect()}
    assert got[1]["audit"] == "KK" and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(b"user:a.\nassistant:b. ").hexdigest()
    assert got[2]["audit"] == "D" and got[2]["truncated"] == 1 and got[2]["cost"] == 3  # IK would cost 3 as well
    assert got[3]["audit"] == "D" and got[3]["blank"] == 1 and got[3]["repaired_sha256"] == hashlib.sha256().hexdigest()
    assert talks.repair(df.limit(0)).count() == 0


def test_conversation_whose_rows_all_go(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = frame(spark, [(conv, 1, "user", "a.")])
    assert [tuple(r) for r in talks.repair(df, talks.damaged(df)).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_nodes_are_few_and_shared():
    known, before, choice = talks.classes()
    assert len(known) < 256 and len(before) == len(choice) == len(known)
    sigs = ["ua" * 50, "sua" + "ua" * 20, "uxaSU-"]
    for sig in sigs:
        for cls in range(len(known)):
            want = cls
            for symbol in reversed(sig):
                want = before[want][symbol]
            assert talks.signature_map(sig)[cls] == want


def test_a_long_conversation_is_not_held(spark):
    """A conversation of many chunks: neighbouring chunks are joined by their maps."""
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    row = talks.repair(df, chunk=256).first()
    assert row["audit"] == "K" * 20_000 and row["cost"] == row["illegal"] == row["gaps"] == 0
