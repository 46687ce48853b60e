"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from strandline.llm import spelling
from strandline.llm.common import Scratch


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_chars=6, min_count=5):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    vocab = {w: n for w, n in words.items() if len(w) >= min_chars and n >= min_count}
    return groups(vocab)


def groups(vocab, factor=5):
    near = {w: [] for w in vocab}
    for a, b in combinations(vocab, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in vocab:
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= factor * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, vocab[w], len(near[w]), vocab.get(form[w])))
    return sorted(out, key=str)


def some_words(rng, n, letters, longest):
    return ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)]


def test_scan_finds_every_pair():
    rng = random.Random(1)
    for letters, longest in (("ab", 7), ("abc", 5), ("aé", 12)):
        for _ in range(60):
            words = sorted(set(some_words(rng, 40, letters, longest)))
            want = {(i, j) for i, j in combinations(range(len(words)), 2) if one_edit(words[i], words[j])}
            found = list(spelling.near_pairs(words))
            assert set(found) == want and len(found) == len(want)


def test_words_of_texts(make):
    rng = random.Random(7)
    base = ["strasse", "straße", "ÉTUDIANT", "étudiant", "letters", "Letters", "letter", "lettters", "lettres", "mottled", "mottle", "abcdef", "abcdeg", "bbcdef", "abcde", "xxxxxxx", "x" * 5000, "x" * 5001]
    rows = [(i if i % 11 else None, " ".join(rng.choices(base, weights=range(1, len(base) + 1), k=60)) + ". 1a2b " * (i % 2)) for i in range(60)] + [(1, None), (2, ""), (3, "é"), (3, "letters!")]
    got = spelling.variant_groups(spelling.vocabulary(spelling.damaged(spelling.runs(make([(i, t, None) for i, t in rows])))))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[1] for r in want) and any(r[4] for r in want)
    empty = make([(1, "x", None)]).limit(0)
    assert spelling.variant_groups(spelling.vocabulary(spelling.damaged(spelling.runs(empty)))).count() == 0


@pytest.mark.parametrize("bucket", [1, 5, spelling.BUCKET])
def test_dense_words_and_large_buckets(spark, bucket):
    """Words of two letters share halves by the hundred: buckets are dealt anew until they fit, and each pair is counted once."""
    rng = random.Random(4)
    vocab = {w: rng.choice([1, 2, 5, 10, 30, 200]) for w in some_words(rng, 500, "ab", 9) + some_words(rng, 60, "aé𝒳", 4)}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variant_groups(df, bucket=bucket).collect()), key=str) == groups(vocab)


def test_chains_of_forms(spark):
    words = [("a" * 6 + "b" * k, 6**k) for k in range(9)]
    got = {r["word"]: r["root"] for r in spelling.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}


def test_buckets_are_bounded(spark):
    """No bucket that can still be cut holds more than its bound, and none is cut without need."""
    words = spark.createDataFrame([("prefix" + a + b + c + "suffix", 9) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    near = spelling.near_words(words, Scratch(spark), bucket=20)
    assert {r["n_near"] for r in near.collect()} == {21}
