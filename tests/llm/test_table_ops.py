"""URL filters, secrets, mixing, line dedup, search and near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import codes, line_dedup, mixing, near_dedup, secrets, url_filter
from strandline.llm.common import Scratch

# URL filters -----------------------------------------------------------------------------------------

URLS = ["http://A.casino-win.example.com/en/1?x", "https://spam-farm.example.org#a", "http://ok.example.com/en/700", "ftp://x.net/de/1", "http://example.net/de/8/", "nothing", "://", None, "http://a.org/es/", "http://aorg/es/", "HTTP://ÄB.COM/en/"]


def test_cascade_is_exact(spark):
    rng = random.Random(1)
    rows = [(f"key{i}", rng.random() < 0.2) for i in range(3000)]
    universe = Scratch(spark).keep(spark.createDataFrame(rows, "key string, listed boolean"))
    levels = url_filter.cascade(universe)
    assert len(levels) > 2
    assert universe.filter(url_filter.member(F.col("key"), levels) != F.col("listed")).count() == 0
    assert sum(f.n_bits for f in levels) < 3000 * 8
    assert url_filter.cascade(universe, max_bits=100) is None
    assert url_filter.cascade(universe.filter("not listed")) == []


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 0])
def test_url_verdicts(spark, max_bits):
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r")], "page_id long, url string, html string, rule string")
    rows = url_filter.filter_urls(pages, max_bits=max_bits).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(URLS) + 1
    assert got[0] == ("a.casino-win.example.com", "/en/1", "com/en/", "block")
    assert got[1] == ("spam-farm.example.org", "", None, "block")
    assert got[2] == ("ok.example.com", "/en/700", "example.com/en/7", "allow")
    assert got[None] == ("x.net", "/de/1", "net/de/", "allow")
    assert got[4] == ("example.net", "/de/8/", "example.net/de/8", "block")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("org/es/", "block") and got[9][2:] == (None, "allow")
    assert got[10][0] == "Äb.com" and got[10][3] == "block"
    assert url_filter.filter_urls(pages.limit(0), max_bits=max_bits).count() == 0


def test_listed_hosts_as_a_table(spark):
    """A list of hosts, with some that no page has, repeated and null ones: as many levels as it takes, the same answer by filters and by join."""
    pages = spark.createDataFrame([(i, f"http://h{i % 700}.x/{i}") for i in range(2100)] + [(5000, None)], "page_id long, url string")
    hosts = spark.createDataFrame([(f"h{k}.x",) for k in range(0, 1400, 3)] * 2 + [(None,), ("",)], "name string")
    for bits in (url_filter.MAX_BITS, 0):
        rows = url_filter.filter_urls(pages, rules=(), listed=hosts, max_bits=bits).collect()
        assert len(rows) == 2101 and all((r["verdict"] == "block") == (r["page_id"] == 5000 or r["page_id"] % 700 % 3 == 0) for r in rows)


def test_cascades_in_shards(spark):
    """A list cut into many shards, filters only: the same keys, with a few bits each, and no listed key in the table."""
    rng = random.Random(2)
    rows = [(f"key{i}", rng.random() < 0.3) for i in range(4000)]
    scratch = Scratch(spark)
    universe = scratch.keep(spark.createDataFrame(rows, "key string, listed boolean"))
    filters, shards = url_filter.sharded_cascade(universe, scratch, shard_bits=1000)
    assert shards > 5 and filters.count() == shards
    probed = universe.withColumn("shard", url_filter._shard(F.col("key"), shards)).join(filters, "shard", "left")
    assert probed.filter(url_filter.sharded_member(F.col("key"), F.col("levels")) != F.col("listed")).count() == 0
    assert filters.select(F.explode("levels").alias("l")).agg(F.sum("l.n_bits")).first()[0] < 4000 * 8
    assert filters.schema.simpleString() == "struct<shard:bigint,levels:array<struct<level:int,n_hashes:int,n_bits:bigint,words:array<bigint>>>>"
    none, _ = url_filter.sharded_cascade(universe.filter("not listed"), scratch)
    assert none.count() == 0


def test_registered_queries_agree_with_their_sql(spark):
    """Every query of the subpackage that has SQL, on the smallest tables."""
    import duckdb

    from strandline.llm import registry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        found = registry.queries()[name](spark, sf)
        want = con.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(want.columns), name
        order = [want.columns.index(c) for c in columns]
        assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall()), name


# Secrets ---------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def all_spans(text):
    """Base findings and the weak ones beside a complement, pair by pair."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    ends = [(m.start(), m.end(), "endpoint") for m in re.finditer(r"https?://[A-Za-z0-9._:/-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text)]
    tokens = [(m.start(), m.end(), "token") for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    meet = lambda p, others: any(p[0] < o[1] and o[0] < p[1] for o in others)
    near = lambda p, kinds: any(0 <= max(o[0] - p[1], p[0] - o[1]) <= secrets.SCOPE for o in base + ends if o[2] in kinds)
    weak = [t for t in tokens if not meet(t, base + ends) and near(t, ("access", "endpoint"))]
    weak += [e for e in ends if not meet(e, base) and near(e, ("access", "assign", "hex"))]
    rank = ["assign", "access", "hex", "endpoint", "token"].index
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + weak, key=lambda x: (x[0], rank(x[2]))))


def test_links_by_gap(spark, make, tmp_path):
    """Spans against pairwise linking, in Spark and in SQL, for random mixtures of parts and fillers."""
    import duckdb

    rng = random.Random(5)
    part = lambda: rng.choice([KEY, "q1W2e3R4t5Y6u7I8", "https://cdn1/abcdefgh12345678", "10.0.0.1", "0a" * 13, "token=abcdef1", "x1" * rng.randint(8, 200), "secret: https://h/" + "a1" * 10, "token=" + "y2" * 130])
    filler = lambda: rng.choice([" ", " . ", "é " * rng.randint(1, 60), " - " * rng.randint(20, 80), ""])
    texts = ["see https://cdn1/abcdefgh12345678 end", KEY + " " * 190 + "q1W2e3R4t5Y6u7I8", KEY + " " * 201 + "q1W2e3R4t5Y6u7I8", "q1" * 200 + " " + KEY, "token=" + "z9" * 150 + " https://h.x/y"]
    texts += ["".join(part() + filler() for _ in range(rng.randint(1, 9))) for _ in range(200)]
    make(list((i, t, None) for i, t in enumerate(texts))).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: all_spans(t) for i, t in enumerate(texts)}
    assert want[0] == "" and "token" in want[1] and "token" not in want[2] and "token" in want[3] and "endpoint" in want[4]
    assert {r["doc_id"]: r["spans"] for r in secrets.op5_secrets(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(f"SELECT doc_id, spans FROM ({secrets.OP5_SQL})").fetchall()) == want


KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
TEXTS = [
    None, "", "token=abc", "token=abcdef", f"PassWord: 'hunter22' 🙂 {KEY} and " + "0a" * 12, 'secret:token"=abcdefgh', "api_key = x apikey==========" , "AKIA" + "A" * 15, "é" * 500 + f" passwd=123456 {KEY}{KEY}",
    "kİey ſecret=abcdef toKen=abcdef", "tokentoken=aaaaaa=bbbbbb token : :x secret :  value-6", "z" * 20_000 + " token=" + "q" * 9000, ("token=" + "a" * 8 + " ") * 3000,
    f"{KEY} q1W2e3R4t5Y6u7I8 https://api.host/x", "q1W2e3R4t5Y6u7I8", "q1W2e3R4t5Y6u7I8 " + "." * 300 + " 10.0.0.1", "https://api.host/x 10.1.2.3", "10.1.2.3 secret=abcdefg",
]


def test_secret_spans(spark, make, tmp_path):
    docs = make([(i, t, None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, TEXTS[3], None)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = secrets.op5_secrets(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([*range(len(TEXTS)), 3, None])
    for r in rows:
        want = base_spans(TEXTS[r["doc_id"] if r["doc_id"] is not None else 3] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r
        counts = [sum(p.startswith(k) for p in want.split(",")) for k in ("assign", "access", "hex")]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    by = {r["doc_id"]: r["spans"] for r in rows}
    for i, text in enumerate(TEXTS):
        assert by[i] == all_spans(text or ""), (i, text)
    assert "token:21:37" in by[13] and "endpoint:38:56" in by[13]
    assert by[14] == by[15] == by[16] == "" and by[17].startswith("endpoint:0:8,assign")
    empty = secrets.scan_secrets(make([(1, "x", None)]).limit(0))
    assert empty.count() == 0


def test_a_long_dump_of_keys(spark):
    """32,000 keys in one text: the frames over a text's parts are running ones, so the time grows with the parts, not with their square."""
    import time

    text = "".join(f"{k:032x}\n" for k in range(32_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = secrets.scan_secrets(df).collect()
    assert len(row["found"]) == 32_000 and row["found"][-1]["end"] == len(text) - 1
    assert time.time() - began < 30


# Mixing ----------------------------------------------------------------------------------------------


def test_poisson_counts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).when(F.col("id") % 4 == 2, "c").otherwise("d").alias("source"))
    rate = spark.createDataFrame([("a", 0.3), (None, 2.5), ("c", 700.0), ("d", 0.0)], "source string, rate double")
    counts = {r["source"]: r for r in mixing.mix(docs.filter("source <> 'c' or source is null or doc_id < 800"), rate).groupBy("doc_id", "source").count().groupBy("source").agg(F.sum("count").alias("s"), F.sum(F.col("count") ** 2).alias("q"), F.count("*").alias("n")).collect()}
    for source, mean, docs_n in (("a", 0.3, 5000), (None, 2.5, 5000), ("c", 700.0, 200)):
        r = counts[source]
        assert abs(r["s"] / docs_n - mean) < 5 * (mean / docs_n) ** 0.5
        assert abs(r["q"] / docs_n - (r["s"] / docs_n) ** 2 - mean) < 0.5 * mean
    assert "d" not in counts
    assert abs(counts["a"]["n"] / 5000 - (1 - np.exp(-0.3))) < 0.03


def test_mixing_is_reproducible_and_weighted(spark, make, odd):
    docs = make(odd)
    for name in ("_n", "_source", "_lambda", "key", "at", "copy", "cdf"):
        docs = docs.withColumn(name, F.lit("own"))
    rate = mixing.rates(docs, weights={"1": 1.0})
    assert all(r["_n"] == r["_source"] == r["at"] == r["key"] == "own" and r["copy"] >= 1 for r in mixing.mix(docs, rate).collect())
    one, two = (sorted(map(str, mixing.mix(docs, rate).collect())) for _ in range(2))
    assert one == two
    rows = mixing.mix(docs.limit(0), mixing.rates(docs.limit(0))).collect()
    assert rows == []
    sizes = spark.createDataFrame([(i, "y" * (10 if i < 900 else 1000), "big" if i < 900 else "small") for i in range(1000)], "doc_id long, text string, source string")
    mixed = mixing.mix(sizes, mixing.rates(sizes, weights={"big": 0.5, "small": 0.5}, epochs=4.0))
    chars = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.length("text") + 1)).collect()}
    assert 0.85 < chars["big"] / chars["small"] < 1.18
    assert mixing.mix(sizes, mixing.rates(sizes, weights={})).count() == 0


# Line dedup ------------------------------------------------------------------------------------------


def brute_lines(rows):
    keys = [[x.strip(" \t\n\v\f\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(list)
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in {k for k in ks if len(k) >= 20}:
            holders[k].append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if last.get(k) is None or i is not None and i >= last[k]]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    pool = [f"shared line number {k} with enough text" for k in range(6)] + ["short", "", "ÄÖÜ äöü üüüüüüüüüüüü é", " \x0b\x0c a padded line of many words \t"]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(30)]
    rows += [(None, pool[0]), (None, pool[0] + "\n" + pool[1]), (30, None), (31, ""), (29, rows[29][1]), (32, "a line that only null holds has\n" * 2)]
    return rows + [(None, "a line that only null ids do hold")] * 3 + [(33, "\n" * 5000 + pool[0] * 3000)]


def probes(built):
    """Membership of keys (h1, h2) in a table of filters."""
    held = {r["shard"]: line_dedup.CuckooFilter.read(bytes(r["slots"])) for r in built.collect()}
    n = max(held, default=0) + 1
    return lambda h1, h2: np.array([h % n in held and held[h % n].holds(np.array([x]))[0] for h, x in zip(h1, h2, strict=True)])


@pytest.mark.parametrize("sizes", [(line_dedup.SHARD_KEYS, line_dedup.GROUP_LINES), (3, 5)])
def test_lines_match_brute_force(make, monkeypatch, sizes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", sizes[0])
    monkeypatch.setattr(line_dedup, "GROUP_LINES", sizes[1])
    rows = line_rows()
    docs = make([(i, t, None) for i, t in rows])
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_filters_spare_the_exact_join(spark):
    """Lines that no filter holds don't come through; those of a common key are dealt to several groups."""
    rows = [(i, f"a common line of many documents\na line of its own, number {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines, counts = line_dedup.hashed_lines(docs), line_dedup.LineIndex.of(docs).counts()
    held = line_dedup.held_lines(lines, counts, line_dedup.build_filters(counts.filter("n_docs >= 3"), 1), 1)
    assert 400 <= held.count() < 410 and held.select("h1").distinct().count() <= 11


def test_line_ids_of_other_types(spark):
    text = "a line that all of them do hold\n"
    docs = spark.createDataFrame([("d-1", text), ("d-3", text), ("d-2", text + "x"), (None, text)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()} == {"d-1": 1, "d-2": 1, "d-3": 0, None: 1}


def test_index_is_reversible(spark, make):
    rows = line_rows()
    first, second = make([(i, t, None) for i, t in rows[:20]]), make([(i, t, None) for i, t in rows[20:]])
    index = line_dedup.LineIndex.of(first)
    grown = index.insert(second)
    table = lambda x: sorted(map(str, x.counts().collect()))
    whole = line_dedup.reference_counts(line_dedup.hashed_lines(make([(i, t, None) for i, t in rows])))
    assert table(grown) == sorted(map(str, whole.collect()))
    assert table(grown.delete(second)) == table(index)
    hot = lambda x: x.counts().filter("n_docs >= 3").select("h1", "h2")
    before, after = hot(index), hot(grown)
    n = 4
    filters = line_dedup.build_filters(before, n)
    moved = line_dedup.update_filters(filters, after.exceptAll(before), before.exceptAll(after), n)
    back = line_dedup.update_filters(moved, before.exceptAll(after), after.exceptAll(before), n)
    for built, keys, others in ((moved, after, None), (back, before, after.exceptAll(before))):
        holds = probes(built)
        k = keys.toPandas()
        assert holds(k["h1"].to_numpy(), k["h2"].to_numpy()).all()
        assert others is None or not (o := others.toPandas()).size or holds(o["h1"].to_numpy(), o["h2"].to_numpy()).mean() < 0.5


def test_unknown_documents_are_not_deleted(make):
    """Deleting what is not held changes nothing, now or after a later insertion; a repeated row goes as often as it is deleted."""
    line = "one line that is long enough"
    docs = lambda *ids: make([(i, line, None) for i in ids])
    counts = lambda x: [(r["n_docs"], r["last"]) for r in x.counts().collect()]
    index = line_dedup.LineIndex.of(docs(1, 2))
    assert counts(index.delete(docs(3)).insert(docs(3))) == [(3, 3)]
    assert counts(index.insert(docs(2)).delete(docs(2))) == [(2, 2)] and counts(index.delete(docs(2, 2, 2))) == [(1, 1)]
    assert counts(index.delete(docs(1, 2))) == [] and counts(index.delete(docs(1, 2)).insert(docs(None))) == [(1, None)]


def test_overflowing_filters_are_rebuilt(spark):
    rng = np.random.default_rng(6)
    frame = lambda k: spark.createDataFrame([(int(a), int(b)) for a, b in k], "h1 long, h2 long")
    few, many = rng.integers(-(2**62), 2**62, (20, 2)) * 2, rng.integers(-(2**62), 2**62, (4000, 2)) * 2
    many[2000:, 0] += 1  # two shards: one outgrows its filter, the other had none
    none, filters = frame([]), line_dedup.build_filters(frame(few), 2)
    whole = np.concatenate([few, many])
    moved = line_dedup.update_filters(filters, frame(many), none, 2, frame(whole))
    assert probes(moved)(whole[:, 0], whole[:, 1]).all()
    left = line_dedup.update_filters(moved, none, frame(many), 2, frame(few))
    holds = probes(left)
    assert holds(few[:, 0], few[:, 1]).all() and holds(many[:, 0], many[:, 1]).mean() < 0.02
    with pytest.raises(Exception, match="overflows"):
        line_dedup.update_filters(filters, frame(many), none, 2).collect()


def test_inserted_and_deleted_documents(make):
    rows = line_rows() + [(100 + k, "\n".join(f"a new line of the increment, number {k // 4 * 500 + j}" for j in range(500))) for k in range(12)]
    docs = lambda part: make([(i, t, None) for i, t in part])
    hot = lambda x: x.counts().filter("n_docs >= 3").select("h1", "h2")
    found = lambda part, x, filters: sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs(part), index=x, filters=filters).collect())
    first, second = rows[:20], rows[20:]
    index = line_dedup.LineIndex.of(docs(first))
    grown = index.insert(docs(second))
    before, after = hot(index), hot(grown)
    moved = line_dedup.update_filters(line_dedup.build_filters(before, 2), after.exceptAll(before), before.exceptAll(after), 2, after)
    whole = brute_lines(rows)
    ids = {str(i) for i, _ in second} - {str(i) for i, _ in first}
    got = found(second, grown, (moved, 2))
    assert [r for r in got if r[0] in ids] == [r for r in whole if r[0] in ids]
    assert found(rows, grown, (moved, 2)) == found(rows, grown, None) == whole
    back = line_dedup.update_filters(moved, before.exceptAll(after), after.exceptAll(before), 2, before)
    assert found(first, grown.delete(docs(second)), (back, 2)) == brute_lines(first)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 20_000)
    built = line_dedup.CuckooFilter.build(keys)
    assert built.holds(keys).all() and line_dedup.CuckooFilter.read(built.slots.tobytes()).holds(keys).all()
    assert built.holds(rng.integers(-(2**63), 2**63, 20_000)).mean() < 0.001
    assert all(built.delete(int(k)) for k in keys[:5000])
    assert built.holds(keys[5000:]).all() and built.holds(keys[:5000]).mean() < 0.01


# Search ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dim", "n"), [(64, 150), (5, 60), (130, 90)])
def test_search_matches_brute_force(spark, dim, n):
    rng = np.random.default_rng(dim)
    vecs = rng.normal(size=(n, dim)).round(3)
    vecs[n // 2 : n // 2 + 20] = vecs[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vecs)] + [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * dim, 1), (n + 3, [1.0] * (dim + 1), 1), (None, vecs[0].tolist(), 1), (5, vecs[5].tolist(), 1)]
    rows[7] = (7, [float("nan")] * dim, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = sorted(tuple(r) for r in codes.search(df, F.col("vec_id") % 9 == 0, k=5).collect())
    bits = {i: [x > 0 for x in v] for i, v, _ in rows[:n]}
    want = []
    for q in range(0, n, 9):
        near = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits if i != q)[:5]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == sorted(want)


def test_search_of_common_segments(spark, monkeypatch):
    """Codes that share segment values, with an index that is not broadcast and whose common values are cut into blocks."""
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(codes, "BLOCK_CODES", 16)
    monkeypatch.setattr(codes, "LANDMARKS", 3)
    monkeypatch.setattr(codes, "PROBES_A_TASK", 500)
    rng = np.random.default_rng(11)
    vecs = rng.choice([-1.0, 1.0], size=(260, 24))
    vecs[:200, :16] = 1.0
    rows = [(f"v{i:03}", v.tolist(), i % 5 == 0) for i, v in enumerate(vecs)] + [("v000", vecs[0].tolist(), False)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, asks boolean")
    want = []
    for q in range(0, 260, 5):
        near = sorted((int((vecs[q] != vecs[i]).sum()), f"v{i:03}") for i in range(260) if i != q)[:7]
        want += [(f"v{q:03}", r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(tuple(r) for r in codes.search(df, F.col("asks"), k=7).collect()) == sorted(want)


def test_search_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in codes.search(df, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50, 1), (50, 1, 0, 1)]
    assert codes.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert codes.search(df, F.lit(False)).count() == 0


def test_search_in_every_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(4, 70, 9)[min(2, i % 5)]).round(3).tolist()) for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q, v in rows[::3]:
        near = sorted((sum((x > 0) != (y > 0) for x, y in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(v) == len(w))[:5]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(tuple(r) for r in codes.search(df, F.col("vec_id") % 3 == 0, k=5).collect()) == sorted(want)


def test_changes_of_an_index_read_no_earlier_document(spark, tmp_path):
    """Inserting, deleting and judging go on after the files of the first documents are gone, and their plans name none of them."""
    import shutil

    line = "a line that is long enough to count"
    first = [(1, f"{line}\nonly one here, and it is long enough"), (2, line), (None, line)]
    spark.createDataFrame(first, "doc_id long, text string").write.parquet(f"{tmp_path}/first")
    index = line_dedup.LineIndex.of(spark.read.parquet(f"{tmp_path}/first"))
    shutil.rmtree(f"{tmp_path}/first")
    new = spark.createDataFrame([(5, line), (6, f"{line}\nx")], "doc_id long, text string")
    counts = lambda x: sorted((r["n_docs"], r["last"]) for r in x.counts().collect())
    assert counts(index) == [(1, 1), (3, 2)]
    grown = index.insert(new)
    assert counts(grown) == [(1, 1), (5, 6)] and "first" not in grown.counts()._jdf.queryExecution().toString()
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(new, index=grown).collect()} == {5: 1, 6: 0}
    assert counts(grown.delete(new.filter("doc_id = 6"))) == [(1, 1), (4, 5)]
    back = grown.delete(new)
    assert counts(back) == counts(index) and counts(back.delete(new)) == counts(index)
    for _ in range(line_dedup.MAX_PARTS + 1):
        index = index.insert(new)
    assert len(index.parts) <= line_dedup.MAX_PARTS and counts(index) == [(1, 1), (3 + 2 * (line_dedup.MAX_PARTS + 1), 6)]


# Near duplicates -------------------------------------------------------------------------------------


def brute_components(rows, words, percent):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append(set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), d) if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(least[top(i)])) for i, (d, _) in enumerate(rows))


def near_rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(6):
        base = rng.choices(words, k=120)
        for _ in range(5 + 20 * (g == 0)):
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, rows[3][1].upper()) for k in range(4)]
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "two words"), (204, "Two  WORDS"), (205, "two"), (None, "null id text of a few words"), (206, "null id text of a few words"), (None, "only nulls have this text here"), (None, "only nulls have this text here"), (7, rows[7][1]), (207, "long " * 20_000)]


def test_components_match_brute_force(make):
    rows = near_rows()
    got = near_dedup.near_components(make([(i, t, None) for i, t in rows]), words=4).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None) for r in got)


def test_no_documents(make):
    assert near_dedup.near_components(make([(1, "x", None)]).limit(0)).count() == 0


def test_posterior_bounds():
    """Simulated pairs at the threshold survive; pairs far below don't."""
    rng = np.random.default_rng(0)
    least = near_dedup.least_equal(0.8)
    ends = [(k + 1) * near_dedup.BATCH for k in range(len(least))]
    at = (rng.random((20_000, near_dedup.HASHES)) < 0.8).cumsum(axis=1)[:, np.array(ends) - 1]
    below = (rng.random((20_000, near_dedup.HASHES)) < 0.4).cumsum(axis=1)[:, np.array(ends) - 1]
    assert (at >= least).all(axis=1).mean() > 0.9999 and (below >= least).all(axis=1).mean() < 0.001


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
    equal = [(near_dedup.min_hashes(near_dedup._mix(x[:300] + np.uint64(k))) == near_dedup.min_hashes(near_dedup._mix(x[100:] + np.uint64(k)))).mean() for k in range(40)]
    assert abs(np.mean(equal) - 0.5) < 0.02


def test_classes_that_share_a_name(make):
    """Names of 4 bits clash all the time; the result is that of brute force."""
    rows = near_rows()
    got = near_dedup.near_components(make([(i, t, None) for i, t in rows]), words=4, name_bits=4).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, 4, 80)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("d-2", "one and the same few words"), ("d-1", "one and the same few words"), ("e", "something else altogether, my dear")], "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_components(df).collect()}
    assert got == {"d-1": ("d-1", True), "d-2": ("d-1", False), "e": ("e", True)}


def test_alike_members_are_dealt_once(spark):
    """One stray class among many of one component costs a row a member, not one for each block."""
    n = 20_000
    labelled = spark.range(n + 1).select(F.lit(7).cast("long").alias("bh"), F.lit(0).alias("band"), F.col("id").alias("k1"), F.lit(30).cast("long").alias("n"), F.when(F.col("id") == n, 1).otherwise(0).cast("long").alias("c"), F.lit(None).cast("binary").alias("sig"))
    sizes = near_dedup.bucket_blocks(labelled)
    (r,) = sizes.collect()
    dealt = near_dedup.deal_blocks(labelled.join(sizes.drop("dealt"), "bh"))
    assert (r["rest_blocks"], r["main_blocks"]) == (1, 20) and dealt.count() == r["dealt"] == n + 21
    met = dealt.filter("k1 = 20000").select("bi", "bj").distinct().count()
    assert met == 21 and dealt.filter("bi > 0").count() == 0
    small = labelled.filter(F.col("k1") > n - 500)
    sizes = near_dedup.bucket_blocks(small)
    assert near_dedup.deal_blocks(small.join(sizes.drop("dealt"), "bh")).count() == sizes.first()["dealt"] == 500
    assert near_dedup.bucket_blocks(labelled.filter("c = 0")).count() == 0


def test_bucket_of_several_blocks(make, monkeypatch):
    """Blocks of few members, so that main and rest are cut: the components are those of brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "SALTS", 64)
    rows = near_rows()
    got = near_dedup.near_components(make([(i, t, None) for i, t in rows]), words=4).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, 4, 80)


def test_pairs_at_the_threshold_share_a_band():
    """Pairs of similarity 0.8 exactly, through the real hashes: none is missed by the bands, none pruned."""
    rng = np.random.default_rng(4)
    least, missed = near_dedup.least_equal(0.8), 0
    for _ in range(600):
        x = rng.integers(0, 2**63, 100).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        short = [(near_dedup._mix(near_dedup.min_hashes(s).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16) for s in (x[:90], x[10:])]
        ends = (short[0] == short[1]).cumsum()[np.arange(1, len(least) + 1) * near_dedup.BATCH - 1]
        missed += not (near_dedup.band_hashes(short[0]) == near_dedup.band_hashes(short[1])).any() or (ends < least).any()
    assert missed == 0
