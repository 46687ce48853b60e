"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text accepts exactly the substrings of
that text. A new text is parsed greedily into the longest phrases that each automaton accepts; the
number of phrases, each weighted with the logarithm of the labelled text's length, or with the bits of a code point if it is a letter
that this text lacks, per character, estimates the cross entropy, and the lowest one wins (the first language by name on a tie). A phrase end is folded into the transition table
(a missing transition becomes the root's, marked), so the parse of thousands of texts in all languages at once is one table
lookup per character. Texts are parsed in blocks of ``BLOCK`` characters, so that long texts run beside
short ones. A block first runs from the root; then it is run again from the states that the block before it ends in, up to where both
runs meet, so that the phrases are those of the whole text.

Letters are lower-cased and runs of other characters become one separator. A letter that a language's text lacks ends the current
phrase and is one by itself. The ``LETTERS`` most frequent letters are columns of the table; the
transitions of all others are sorted keys beside it, which gives the same phrases with a search for each such letter.

Learning takes a bounded sample: about ``SAMPLE_ROWS`` rows a language by the hash of their ids, of each a window at a hashed place
of up to ``ROW_CHARS`` characters, all shortened alike so that a language has at most ``LANG_CHARS``.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language, or with a null id, are not learned
from; without any labelled row all is ``und``; repeated rows are judged alike; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE_ROWS, ROW_CHARS, LANG_CHARS = 300, 1000, 40_000
BLOCK = 4096
LETTERS = 62
#: Entries of the table of frequent letters; where all automata have very many states, fewer letters are columns.
TABLE_CELLS = 64_000_000
#: Bits of a letter that is spelled out, as no phrase of the labelled text can stand for it.
LETTER_BITS = math.log2(0x110000)
#: Characters that are encoded at a time.
PIECE_CHARS = 1 << 22
UNKNOWN_LANGUAGE = "und"
LETTER = re.compile(r"[^\W\d_]")
GAP = re.compile(r"(?:[\W\d_])+")


def normalise(text: str) -> str:
    """Lower case, with one space for each run of other characters."""
    return GAP.sub(" ", text.lower())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Parser:
    """The languages' automata as one table of (next state, phrases ended: the one before, and a letter that the text lacks)."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(k for k, v in texts.items() if v.strip())
        texts = {k: normalise(texts[k]) for k in self.names}
        letters = [c for c, _ in sorted(Counter("".join(texts.values())).items(), key=lambda x: (-x[1], x[0]))]
        codes = {c: i for i, c in enumerate(letters)}
        automata = [suffix_automaton([codes[c] for c in texts[name]]) for name in self.names]
        sizes = [len(trans) for trans in automata]
        dense = min(len(letters), LETTERS + 1, max(1, TABLE_CELLS // max(1, sum(sizes)) - 2))
        self.unknown, self.width, self.rare = dense, dense + 1, len(letters) - dense
        # Codes of rare letters follow those of the columns and the unknown letter.
        self.codes = np.full(0x110000, self.unknown, np.min_scalar_type(self.width + self.rare))
        for c, i in codes.items():
            self.codes[ord(c)] = i if i < dense else i + 1
        self.roots = [int(x) for x in np.cumsum([0, *sizes])[:-1]]
        table = np.empty((sum(sizes), self.width), np.int32)
        self.rare_root = np.repeat(np.array(self.roots, np.int32)[:, None] << 2 | 2, self.rare, axis=1)
        rare = {}
        for k, (start, trans) in enumerate(zip(self.roots, automata, strict=True)):
            part = table[start : start + len(trans)]
            part[0], part[1:] = start << 2 | 1, start << 2 | 2
            for c, to in trans[0].items():
                if c < dense:
                    part[:, c] = (start + to) << 2 | 1
                else:
                    self.rare_root[k, c - dense] = (start + to) << 2 | 1
            for s, out in enumerate(trans):
                for c, to in out.items():
                    if c < dense:
                        part[s, c] = (start + to) << 2
                    else:
                        rare[(start + s) * self.rare + c - dense] = (start + to) << 2
        self.table = table.ravel()
        self.lacks = np.ones((len(self.names), self.width + self.rare), np.uint8)
        for k, name in enumerate(self.names):
            self.lacks[k, [self.codes[ord(c)] for c in set(texts[name])]] = 0
        self.rare_keys = np.array(sorted(rare), np.int64)
        self.rare_steps = np.array([rare[k] for k in self.rare_keys.tolist()], np.int32)
        self.bits = np.array([math.log2(max(2, len(texts[k]))) for k in self.names])

    def encode(self, text: str) -> np.ndarray:
        """The codes of a text's letters, made from a piece at a time, so that only the codes are held for all of it."""
        pieces = (text[i : i + PIECE_CHARS] for i in range(0, len(text), PIECE_CHARS))
        return np.concatenate([np.zeros(0, self.codes.dtype), *(self.codes[np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)] for p in pieces)])

    def costs(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the bits that each normalised text takes."""
        coded = [self.encode(t) for t in texts]
        # Letters that a language lacks, from each text's counts of letters: the memory is that of the alphabet, whatever the length.
        lacking = np.array([self.lacks @ np.bincount(c, minlength=self.lacks.shape[1]) for c in coded], np.int64).reshape(len(coded), len(self.names))
        return (self.phrases(coded) - lacking) * self.bits + lacking * LETTER_BITS

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): the number of phrases of each encoded text."""
        sizes = np.array([len(c) for c in coded], np.int64)
        blocks = np.maximum(1, -(-sizes // BLOCK))
        number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        flat = np.concatenate([np.zeros(0, self.codes.dtype), *coded])
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + number * BLOCK
        lengths = np.minimum(BLOCK, np.repeat(sizes, blocks) - number * BLOCK)
        roots = np.array(self.roots, np.int32)[:, None]
        entry = np.repeat(roots, len(starts), axis=1)
        ends, count = self.run(flat, starts, lengths, entry)
        pending = np.flatnonzero(number > 0)
        while pending.size:
            pending = pending[(ends[:, pending - 1] != entry[:, pending]).any(axis=0)]
            before = ends[:, pending - 1]
            more, after = self.rejoin(flat, starts[pending], lengths[pending], entry[:, pending], before, ends[:, pending])
            moved = (after != ends[:, pending]).any(axis=0)
            count[:, pending] += more
            entry[:, pending], ends[:, pending] = before, after
            pending = pending[moved] + 1
            pending = pending[pending < len(number)]
            pending = pending[number[pending] > 0]
        last = np.cumsum(blocks) - 1
        count[:, last] += ends[:, last] != roots
        out = np.zeros((len(coded), len(self.names)))
        np.add.at(out, np.repeat(np.arange(len(coded)), blocks), count.T)
        return out

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """(languages, blocks): the next states, shifted, with the number of phrases that end."""
        if self.rare and (at := np.flatnonzero(column >= self.width)).size:
            step = self.table[state * self.width + np.where(column < self.width, column, self.unknown)]
            step[:, at] = self.rare_step(state[:, at], column[at].astype(np.int64) - self.width)
            return step
        return self.table[state * self.width + column]

    def run(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that blocks end in and the phrases that end in them; the longest first, so that those still running are a slice."""
        order = np.argsort(-lengths, kind="stable")
        begin, left = starts[order], -lengths[order]
        state, count = entry[:, order], np.zeros(entry.shape, np.int32)
        for t in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(left, -t))
            step = self.step(state[:, :m], flat[begin[:m] + t])
            count[:, :m] += step & 3
            state[:, :m] = step >> 2
        back = np.argsort(order, kind="stable")
        return state[:, back], count[:, back]

    def rejoin(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, old: np.ndarray, new: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many more phrases end in blocks that begin in states ``new`` instead of ``old``, and the states they end in instead of ``ends``."""
        more, after = np.zeros(old.shape, np.int32), ends.copy()
        live, t = np.arange(len(starts)), 0
        while live.size:
            over = lengths[live] <= t
            after[:, live[over]] = new[:, over]
            live, old, new = live[~over], old[:, ~over], new[:, ~over]
            column = flat[starts[live] + t]
            was, now = self.step(old, column), self.step(new, column)
            more[:, live] += (now & 3) - (was & 3)
            apart = (was != now).any(axis=0)
            live, old, new, t = live[apart], was[:, apart] >> 2, now[:, apart] >> 2, t + 1
        return more, after

    def rare_step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """(languages, blocks): what the table would hold for letters that are not among its columns."""
        keys = state.astype(np.int64) * self.rare + letter
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        step = np.where(self.rare_keys[at] == keys, self.rare_steps[at], self.rare_root[:, letter])
        return step - (((step & 3) == 2) & (state == np.array(self.roots)[:, None]))  # at the root no phrase is under way

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN_LANGUAGE] * len(texts), [0.0] * len(texts)
        judged = [i for i, t in enumerate(texts) if t is not None and self.names and LETTER.search(t)]
        begin = 0
        while begin < len(judged):  # a bounded number of characters at a time, one text at least
            end, size = begin, 0
            while end < len(judged) and (end == begin or size < 4_000_000):
                size += len(texts[judged[end]])
                end += 1
            part = judged[begin:end]
            cost = self.costs([normalise(texts[i]) for i in part])
            for i, row in zip(part, cost, strict=True):
                best = int(row.argmin())
                rest = np.delete(row, best)
                langs[i], scores[i] = self.names[best], float(1 - row[best] / rest.min()) if len(rest) else 1.0
            begin = end
        return langs, scores


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shortened(parts: list[str], budget: int) -> list[str]:
    """All parts, the longest ones cut to one length, so that they and the ends between them fit the budget."""
    left, sizes = budget, sorted(len(x) + 1 for x in parts)
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return [x[: max(0, left // (len(sizes) - i) - 1)] for x in parts]
        left -= size
    return parts


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Parser:
    """The automata from the labelled rows that are not held out."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Parser({})
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, 1_500_000 * sample_rows // n))])
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    begin = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.length("text") - ROW_CHARS + 1, F.lit(1))).cast("int")
    window = F.substring(F.col("text"), begin + 1, F.lit(ROW_CHARS))
    chosen = rows.filter(at < F.element_at(shares, F.col("lang"))).select("lang", at.alias("at"), window.alias("text"))
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.at, r.text)):  # at most about 1.5 sample_rows a language
        texts[r.lang].append(r.text)
    return Parser({lang: "\n".join(shortened(parts, LANG_CHARS)) for lang, parts in texts.items()})


def _predict(batches: Iterator[pa.RecordBatch], parser) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = parser.value.predict(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[batch.schema.names[0], "lang_pred", "score"])


def identify(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by LANG_CHARS a language and TABLE_CELLS
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda it: _predict(it, shared), f"`{id_col}` {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
