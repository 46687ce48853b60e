"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A published piece vocabulary is read, never trained. All ways to cut a text into pieces form a lattice;
a forward pass sums the weights of all cuts that reach each position, and a backward
pass draws one cut with its exact probability. The random numbers are hashes of (seed, row key,
word number, step), so a row is always cut alike, wherever and however often it is encoded.

Pieces hold blanks at their start only and never a line feed, so that a text's lattice falls apart at
the words: the forward pass runs once for each distinct word of a batch, for all of them at once.
Weights are Zipf's law over the vocabulary's ranks to the power ``alpha``: larger values prefer the likeliest cuts.

Nothing is normalised: blanks are pieces' word marks, a blank is put in front and taken away by decoding, and characters
without a piece (the word mark itself among them) are written as byte pieces. Decoding is therefore exact.

Edge cases: an empty text has no tokens and decodes to the empty text; a null one has null tokens and decodes to null; a null row key
hashes as the empty string; repeated rows get equal tokens; texts of any length are cut into words, and a word of any
length is handled; an empty table gives no rows. Other columns are carried along by name; the names of the added columns are reserved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: The vocabulary file where neither a call nor the session setting ``strandline.pieces.model`` names one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 1
ZIPF_SHIFT = 2.7
ALPHABET, FAST_LENGTH = 254, 64
#: Factor per character that keeps the sums of words up to that length in range; it cancels, as all cuts of a word have its length.
LIFT = 30.0
BATCH_CHARS = 1_000_000
MARK = "▁"
WORD = re.compile(r"\n| *[^ \n]+| +")
U = np.uint64


class Vocabulary:
    """Pieces, their weights, and a dense trie over the commonest characters; fixed size, so it can be broadcast."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        pieces = [(model.id_to_piece(i).replace(MARK, " "), i) for i in ids]
        assert all(" " not in p.lstrip(" ") and "\n" not in p for p, _ in pieces), "a piece crosses words"
        self.raw = [b""] * size
        for p, i in pieces:
            self.raw[i] = p.encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        weight = (1 / (np.arange(len(pieces)) + ZIPF_SHIFT)) ** alpha
        weight /= weight.sum()
        self.weight = np.zeros(size)
        self.weight[ids] = weight
        self.byte_weight = float(weight.min())
        self.of = dict(pieces)
        self.lifted = self.weight.copy()
        for p, i in pieces:
            self.lifted[i] *= LIFT ** len(p)
        self.longest = max(len(p) for p, _ in pieces)
        self._build_trie(pieces)

    def _build_trie(self, pieces: list[tuple[str, int]]) -> None:
        used = Counter(c for p, _ in pieces for c in set(p))
        self.chars = set(used)
        common = sorted((c for c in used if c in self.of), key=lambda c: (ord(c) > 126, -used[c], c))[:ALPHABET]
        self.codes = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(common, 1):
            self.codes[ord(c)] = i
        self.width = len(common) + 1
        nodes, own = [{}], [-1]
        for p, i in pieces:
            at = 0
            for c in p:
                code = int(self.codes[ord(c)])
                if not code:
                    break
                if code not in nodes[at]:
                    nodes[at][code] = len(nodes)
                    nodes.append({})
                    own.append(-1)
                at = nodes[at][code]
            else:
                own[at] = i
        self.trie = np.zeros((len(nodes), self.width), np.min_scalar_type(len(nodes)))
        for at, out in enumerate(nodes):
            for code, to in out.items():
                self.trie[at, code] = to
        self.trie, self.own = self.trie.ravel(), np.array(own, np.int32)


class Lattice:
    """The lattices of distinct words: for each position, the pieces that end there and their probabilities."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        self.vocab = vocab
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.base = np.concatenate([[0], np.cumsum(self.length + 1)])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        flat = vocab.codes[points]
        odd = np.unique(points[flat == 0])  # not in the trie: pieces that hold them are found one word at a time
        raw = [chr(c).encode() for c in odd.tolist()]
        self.bytes_of = [[vocab.byte_ids[b] for b in r] for r in raw]  # token sequences of characters without a piece
        self.odd_weight = np.array([vocab.byte_weight ** len(r) * LIFT for r in raw])
        self.place_of = {chr(c): i for i, c in enumerate(odd.tolist())}
        known = np.array([chr(c) in vocab.chars for c in odd.tolist()], bool)
        which = np.zeros(len(flat), np.int32)
        which[flat == 0] = np.searchsorted(odd, points[flat == 0]) + 1
        starts = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        slow = np.concatenate([[False], known])[which]
        fast = (self.length <= FAST_LENGTH) & (~np.logical_or.reduceat(slow, starts) if len(words) else False)
        self.which = which
        parts = [self._fast(np.flatnonzero(fast & (self.length > low) & (self.length <= high)), flat, starts) for low, high in ((0, 8), (8, 16), (16, 32), (32, FAST_LENGTH))]
        parts += [self._slow(int(w), words[w]) for w in np.flatnonzero(~fast)]
        node, size, token, prob = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(node, kind="stable")
        self.size, self.token, self.prob = size[order], token[order], prob[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=self.base[-1]))])

    def _fast(self, words: np.ndarray, flat: np.ndarray, starts: np.ndarray):
        v = self.vocab
        n, longest = len(words), int(self.length[words].max(initial=0))
        codes = np.zeros((n, longest + v.longest), np.uint8)
        length = self.length[words]
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        codes[row, col] = flat[starts[words][row] + col]
        odd = np.zeros((n, longest), np.int32)
        odd[row, col] = self.which[starts[words][row] + col]
        has_odd = odd.any(axis=0)
        total = np.zeros((n, longest + 1))
        total[:, 0] = 1
        edges = []
        for i in range(longest):
            rows = np.flatnonzero(length > i)
            at, reach = np.zeros(len(rows), np.int64), total[rows, i]
            if has_odd[i]:
                r = np.flatnonzero(odd[:, i])
                w = total[r, i] * self.odd_weight[odd[r, i] - 1]
                total[r, i + 1] += w
                edges.append((r.astype(np.int32), np.full(len(r), i + 1, np.int32), np.ones(len(r), np.int16), -odd[r, i], w))
            for k in range(v.longest):
                at = v.trie[at * v.width + codes[rows, i + k]].astype(np.int64)
                alive = at > 0
                rows, at, reach = rows[alive], at[alive], reach[alive]
                if not len(rows):
                    break
                token = v.own[at]
                hit = token >= 0
                r, t = rows[hit], token[hit]
                w = reach[hit] * v.lifted[t]
                total[r, i + k + 1] += w
                edges.append((r.astype(np.int32), np.full(len(r), i + k + 1, np.int32), np.full(len(r), k + 1, np.int16), t, w))
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int32), np.zeros(0)
        r, end, size, token, w = (np.concatenate(x) for x in zip(*edges, strict=True))
        return self.base[words][r] + end, size, token, w / total[r, end]

    def _slow(self, number: int, word: str):
        """One word of any length and any characters, with the sums kept near 1."""
        v, n = self.vocab, len(word)
        total, scale = [0.0] * (n + 1), [0.0] * (n + 1)  # the sum at i is total[i] * exp(scale[i])
        total[0] = 1.0
        out = []
        for j in range(1, n + 1):
            found = []
            for k in range(1, min(j, v.longest) + 1):
                token = v.of.get(word[j - k : j])
                if token is not None:
                    found.append((k, token, v.weight[token]))
            if word[j - 1] not in v.of:
                place = self.place_of[word[j - 1]]
                found.append((1, -1 - place, v.byte_weight ** len(self.bytes_of[place])))
            top = max(scale[j - k] for k, _, _ in found)
            w = [total[j - k] * np.exp(max(scale[j - k] - top, -700)) * p for k, _, p in found]
            total[j], scale[j] = 1.0, top + float(np.log(sum(w)))
            out += [(self.base[number] + j, k, t, x / sum(w)) for (k, t, _), x in zip(found, w, strict=True)]
        node, size, token, prob = zip(*out, strict=True)
        return np.array(node, np.int64), np.array(size, np.int16), np.array(token, np.int32), np.array(prob)

    def sample(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each word has."""
        step, live = 0, np.arange(len(words))
        start = self.base[words]
        node = start + self.length[words]
        drawn = []
        while len(live):
            u = (_mix(keys[live] + U(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(np.float64) * 2.0**-53
            edge, last = self.first[node], self.first[node + 1] - 1
            moving = np.arange(len(live))
            while True:
                on = (edge[moving] < last[moving]) & (u[moving] >= self.prob[edge[moving]])
                moving = moving[on]
                if not len(moving):
                    break
                u[moving] -= self.prob[edge[moving]]
                edge[moving] += 1
            drawn.append((live, edge))
            node = node - self.size[edge]
            on = node > start[live]
            live, node, step = live[on], node[on], step + 1
        count = np.zeros(len(words), np.int64)
        for who, _ in drawn:
            count[who] += 1
        place = np.cumsum(count)
        tokens = np.zeros(int(count.sum()), np.int64)
        for back, (who, edge) in enumerate(drawn):
            tokens[place[who] - 1 - back] = self.token[edge]
        return self._with_bytes(tokens, count)

    def _with_bytes(self, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(tokens < 0)
        if not len(odd):
            return tokens.astype(np.int32), count
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        flat, starts = np.array([b for x in self.bytes_of for b in x]), np.cumsum(sizes) - sizes
        which = -tokens[odd] - 1
        n = np.ones(len(tokens), np.int64)
        n[odd] = sizes[which]
        word = np.repeat(np.arange(len(count)), count)
        out, begin = np.repeat(tokens, n), np.cumsum(n) - n
        for k in range(int(sizes.max())):
            more = sizes[which] > k
            out[begin[odd[more]] + k] = flat[starts[which[more]] + k]
        return out.astype(np.int32), np.bincount(word, n, len(count)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Numbers(dict):
    """Numbers the words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode(vocab: Vocabulary, texts: list[str], keys: list, seed: int = SEED) -> list[np.ndarray]:
    """The sampled tokens of each text; ``keys`` are the row keys."""
    index, found, counts = Numbers(), [], []
    for text in texts:
        words = WORD.findall(" " + text) if text else []
        counts.append(len(words))
        found += words
    ids = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
    del found
    counts = np.array(counts, np.int64)
    if not len(ids):
        return [np.zeros(0, np.int32) for _ in texts]
    own = np.array([xxhash.xxh3_64_intdigest("" if k is None else str(k), seed) for k in keys], U)
    number = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        word_keys = _mix(np.repeat(own, counts) + number.astype(U) * U(0x9E3779B97F4A7C15))
    tokens, per_word = Lattice(vocab, list(index)).sample(ids, word_keys)
    ends = np.cumsum(per_word)[np.maximum(np.cumsum(counts) - 1, 0)]
    ends = np.where(np.cumsum(counts) > 0, ends, 0)
    return np.split(tokens, ends[:-1])


def decode(vocab: Vocabulary, tokens: list[int]) -> str:
    return b"".join(map(vocab.raw.__getitem__, tokens))[1:].decode()


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` together, or one row."""
    begin = 0
    while begin < len(sizes):
        end, total = begin + 1, sizes[begin]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield begin, end
        begin = end


def _encoded(batches: Iterator[pa.RecordBatch], vocab, key_at: int, text_at: int, seed: int, proof: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()
        for a, b in _slices(sizes, BATCH_CHARS):
            part = batch.slice(a, b - a)
            texts = [t or "" for t in part.column(text_at).to_pylist()]
            found = encode(vocab.value, texts, part.column(key_at).to_pylist(), seed)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            absent = pc.is_null(part.column(text_at))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=absent)
            columns, names = [*part.columns, lists], [*part.schema.names, "token_ids"]
            if proof:
                sizes_of = pa.array(np.diff(offsets), mask=absent.to_numpy(zero_copy_only=False))
                columns += [sizes_of, pa.array([decode(vocab.value, x.tolist()) == t for x, t in zip(found, texts, strict=True)])]
                names += ["n_tokens", "lossless"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_texts(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, proof: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``; with ``proof`` also ``n_tokens`` and ``lossless``: the tokens decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    if proof:
        added += [T.StructField("n_tokens", T.IntegerType()), T.StructField("lossless", T.BooleanType())]
    key_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _encoded(it, shared, key_at, text_at, seed, proof), T.StructType([*docs.schema.fields, *added]))


def _decoded(batches: Iterator[pa.RecordBatch], vocab, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(at)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
        for a, b in _slices(sizes, BATCH_CHARS // 4):
            texts = [None if x is None else decode(vocab.value, x) for x in column.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decode_tokens(tokens: DataFrame, vocab: Vocabulary, token_col: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded``."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocab)
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])
    at = tokens.columns.index(token_col)
    return tokens.mapInArrow(lambda it: _decoded(it, shared, at), schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``lossless`` (the decoded tokens are the text), in one pass."""
    path = path or docs.sparkSession.conf.get("strandline.pieces.model", MODEL)
    return encode_texts(docs, Vocabulary(path), id_col, text_col, proof=True)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
