"""The pipeline's stages against brute force and the operators' own guarantees."""

import re

import pytest

import corpus_pipeline
from strandline.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(at / name))
        before, docs = docs, spark.read.parquet(str(at / name))
        out.append((name, before, docs))
    return out


def test_columns(stages):
    for _, _, after in stages[:-1]:
        assert set(after.columns) == set(corpus_pipeline.COLUMNS)


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_score(before, model).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, s in scores.items() if s < 0.7}


def test_lines_and_near_copies(stages):
    from test_table_ops import brute_components, brute_lines

    rows = [(r["doc_id"], r["text"]) for r in stages[1][1].collect()]
    kept = [(r["doc_id"], r["text"], r["n_chars"]) for r in stages[1][2].collect()]
    assert sorted((str(i), t) for i, t, _ in kept) == [(i, t) for i, _, _, t in brute_lines(rows)]
    assert all(n == len(t) for _, t, n in kept)
    want = {i for i, _, c in brute_components([(i, t) for i, t, _ in kept], 5, 80) if i == c}
    assert {str(r["doc_id"]) for r in stages[2][2].collect()} == want


def test_near_copies_are_rows_not_ids(spark):
    from pyspark.sql import functions as F

    copy, other = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    near = copy + " and a little more"
    rows = [(1, copy), (2, near), (2, other), (3, copy), (5, "x y z q r s t"), (5, "x y z q r s t"), (None, copy), (None, "only nulls hold this text of some words")]
    rows += [(None, "only nulls hold this text of some words"), (6, None), (6, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = sorted(map(str, [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]))
    assert got == sorted(map(str, [rows[0], rows[2], rows[4], rows[7], *rows[9:]]))


def test_mixing_and_tokens(stages):
    _, before, after = stages[3]
    own = {r["doc_id"]: r for r in before.collect()}
    assert all(own[r["doc_id"]] == r for r in after.select(*before.columns).collect())
    rows = stages[4][2].collect()
    assert len(rows) == after.count() and all(r["lossless"] for r in rows)
    assert all(re.search(r"\S", r["text"]) is None or r["n_tokens"] for r in rows)


def test_copies_are_cut_by_draws_of_their_own(spark):
    text = "an invented sentence of rather many words that can be cut in many ways, " * 6
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.encode(spark, docs, SF).collect()
    cuts = {tuple(r["token_ids"]) for r in found if r["text"]}
    assert len(found) == 7 and len(cuts) == 5 and all(r["lossless"] for r in found)
    assert sorted(map(str, corpus_pipeline.encode(spark, docs, SF).collect())) == sorted(map(str, found))


def test_odd_rows_pass_all_stages(spark, make, odd, tmp_path):
    """Nulls, empty and long texts, ties and repeated rows through every stage, each against brute force on its own input."""
    from pyspark.sql import functions as F
    from test_table_ops import brute_lines

    docs = make(odd, extra=False).select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, given: _written(stages[name](spark, given, str(tmp_path)), tmp_path / name)
    clean = run("toxicity", docs)
    model = toxicity.train(docs, labels)
    want = [(r["doc_id"], r["text"]) for r in toxicity.with_score(docs, model).collect() if r["score"] < 0.7]
    assert _rows(clean) == sorted(map(str, want)) and len(want) >= len(odd) - 1
    lines = run("line_dedup", clean)
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.collect()) == [(i, t) for i, _, _, t in brute_lines(want)]
    apart = run("near_dedup", lines)
    texts = [(r["doc_id"], r["text"]) for r in lines.collect()]
    fox = [i for i, t in texts if t.startswith("the quick")]
    assert _rows(apart) == sorted(map(str, [x for x in texts if not x[1].startswith("the quick")] + [(min(i for i in fox if i is not None), next(t for i, t in texts if i == 6))]))
    mixed = run("mixing", apart)
    assert set(_rows(mixed)) <= set(_rows(apart)) and mixed.columns == list(corpus_pipeline.COLUMNS)
    coded = run("sentencepiece", mixed)
    assert coded.count() == mixed.count() and coded.filter("not lossless").count() == 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


def _written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def _rows(df):
    return sorted(map(str, [(r["doc_id"], r["text"]) for r in df.collect()]))
