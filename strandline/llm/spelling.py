"""Spelling variant grouping: words one edit apart, by dynamic programming over sorted lists.

1. The vocabulary is counted with built-in functions: runs of letters, exploded and summed before they are shuffled.
2. Two words at one edit, the shorter of m code points, differ at one place, the length of their common prefix. So they agree before and
   after whatever interval of places holds it: a word is dealt to a bucket for each half of the places, named by what it has outside of it, once
   with the words of its own length and the next, once with those one shorter. A pair belongs to the one interval with its place. Buckets of
   more than ``BUCKET`` words are dealt anew by halves of their interval, down to single places, where a bucket is bounded by the alphabet.
3. A bucket is one sorted list (of reversed words, where they agree at the end). For each of its words the list is scanned onward with the
   banded edit matrix: rows of the prefix that a word shares with the one scanned before are reused, and where all of a row exceeds one edit,
   the whole range of words that share that prefix is skipped.
4. Tasks return what they found for each word, not pairs: the number of near words and the most frequent of them.
5. A word's form is its most frequent near word, if that is frequent enough; roots follow forms by pointer doubling. Forms grow by
   a factor a step, so chains are short and free of cycles.

Edge cases: a null or empty text has no runs; a null id is spelled as the empty string; only A-Z are lower-cased. Repeated rows count
each. Words of any length are compared whole. Ties of the largest count go to the smallest word in code-point order. An empty table gives no
rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_CHARS, MIN_COUNT, FACTOR = 6, 5, 5
#: One run in so many loses a letter in the query's contract.
DAMAGED = 199
#: Words of a bucket that is scanned as it is.
BUCKET = 4096
FAR = 2  # stands for two edits and more

KEY = ("m", "lo", "hi", "stem")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every run of letters, lower-cased."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))


def damaged(found: DataFrame) -> DataFrame:
    """(word) of runs (id, run): some lose one code point, by the CRC-32 of id and run."""
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least so many code points and occurrences."""
    return words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs of places in a sorted list of distinct words whose words are one edit apart."""
    shared = [0, *(len(commonprefix(pair)) for pair in zip(words, words[1:], strict=False))]
    for a in range(len(words) - 1):
        q, i = words[a], a + 1
        size, keep = len(q), shared[i]
        # Row d: the distances of the first d letters read to the first d - 1, d and d + 1 of q.
        rows = [(1 if d else FAR, 0, 1 if d < size else FAR) for d in range(keep + 1)]
        while i < len(words):
            w = words[i]
            del rows[keep + 1 :]
            low, d = 0, keep
            while d < len(w) and low < FAR:
                left, here, right = rows[d]
                c = w[d]
                new_left = min(here + 1, left + (c != q[d - 1])) if 0 < d <= size else here + 1 if d == 0 else FAR
                new_here = min(right + 1, here + (c != q[d]), new_left + 1) if d < size else FAR
                new_right = min(right + (c != q[d + 1]), new_here + 1) if d + 1 < size else FAR
                rows.append((new_left, new_here, new_right))
                low = min(rows[-1])
                d += 1
            if low < FAR:
                if -1 <= size - len(w) <= 1 and rows[len(w)][1 + size - len(w)] == 1:
                    yield a, i
                i += 1
            else:  # every word that shares these letters is too far
                i = bisect_right(words, w[:d], i, key=lambda s, d=d: s[:d])
            if i < len(words):
                keep = min(shared[i], len(rows) - 1)


def scan_bucket(m: int, lo: int, hi: int, counts: list[tuple[str, int]]) -> dict[str, list]:
    """word -> [near words, the largest count among them, its smallest word], of the pairs that belong to the bucket."""
    turn = -1 if lo < m - hi else 1
    ordered = sorted((w[::turn], n) for w, n in counts)
    out: dict[str, list] = {}
    for i, j in near_pairs([w for w, _ in ordered]):
        (u, nu), (v, nv) = ((w[::turn], n) for w, n in (ordered[i], ordered[j]))
        if min(len(u), len(v)) == m and lo <= min(len(commonprefix((u, v))), m - 1) < hi:
            for word, other, n in ((u, v, nv), (v, u, nu)):
                got = out.setdefault(word, [0, 0, ""])
                got[0] += 1
                if n > got[1] or n == got[1] and other < got[2]:
                    got[1:] = n, other
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, lo, hi, stem, word, n), sorted by bucket -> (word, n_near, form_n, form), a row for each word of a bucket with near ones."""
    key, held = None, []

    def found() -> list[tuple]:
        return [(w, *got) for w, got in scan_bucket(*key[:3], held).items()] if len(held) > 1 else []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        out = []
        for *own, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                out += found()
                key, held = own, []
            held.append((word, n))
        if out:
            yield batch_of(out)
    if rest := found():
        yield batch_of(rest)


def _stem() -> Column:
    """What a word has before and after the interval."""
    tail = F.col("m") - F.col("hi")
    return F.concat(F.substring("word", F.lit(1), F.col("lo")), F.right("word", tail))


def halves(words: DataFrame) -> DataFrame:
    """(m, lo, hi, stem, word, n): each word with those of its length and the next, and with those one shorter, for both halves of the places."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m > 0)).alias("m"))
    mid = F.floor((F.col("m") + 1) / 2).cast("int")
    rows = rows.select("word", "n", "m", F.explode(F.array(F.struct(F.lit(0).alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("m").alias("hi")))).alias("part"))
    return rows.select("m", "part.lo", "part.hi", "word", "n").filter("lo < hi").withColumn("stem", _stem()).select(*KEY, "word", "n")


def halved(rows: DataFrame) -> DataFrame:
    """Rows of buckets dealt anew by the halves of their interval."""
    mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
    parts = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
    rows = rows.select("word", "n", "m", F.explode(parts).alias("part"))
    return rows.select("m", "part.lo", "part.hi", "word", "n").withColumn("stem", _stem()).select(*KEY, "word", "n")


def near_words(words: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, best (less, form)) of the words (word, n) that have near ones; ``less`` is minus the form's count."""
    rows, scans = scratch.keep(halves(words)), []
    while True:
        large = rows.filter("hi - lo > 1").groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > bucket).drop("size")
        large = scratch.keep(large)
        left = large.limit(1).count() > 0
        fit = rows.join(large, list(KEY), "left_anti") if left else rows
        scans.append(fit.repartition(*KEY).sortWithinPartitions(*KEY).select(*KEY, "word", "n").mapInArrow(_scan, "word string, n_near long, form_n long, form string"))
        if not left:
            break
        rows = scratch.keep(halved(rows.join(large, list(KEY), "left_semi")))
    found = scans[0]
    for more in scans[1:]:
        found = found.unionAll(more)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last."""
    known = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.keep(known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = new.filter("moved").limit(1).count()
        known = new.select("word", "root")
        if not moved:
            return known


def variant_groups(words: DataFrame, factor: int = FACTOR, bucket: int = BUCKET) -> DataFrame:
    """One row per word of the vocabulary (word, n): word, form, root, n, n_near, form_n."""
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", "n"))
    near = near_words(words, scratch, bucket)
    chosen = -F.col("best.less") >= factor * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    known = scratch.keep(known)
    ends = roots(known.filter("form is not null").select("word", "form"), scratch)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(vocabulary(damaged(runs(table(spark, sf_dir, "documents")))))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(e ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS e FROM range(256) r(i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (SELECT run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), vocab AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocab b ON a.v = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocab b ON a.v = b.word
), best AS (SELECT word, count(*) AS n_near, arg_min(other, {'less': -m, 'word': other}) AS form, max(m) AS form_n FROM near GROUP BY word), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM vocab v LEFT JOIN best USING (word)
), walk(word, root, last) AS (
  SELECT word, coalesce(form, word), form IS NULL FROM forms UNION ALL SELECT w.word, coalesce(f.form, w.root), f.form IS NULL FROM walk w JOIN forms f ON f.word = w.root WHERE NOT w.last
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM walk WHERE last) USING (word)
"""
