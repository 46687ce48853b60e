"""Sentence pieces, language, toxicity, media: exact round trips, brute force and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, media, pieces, toxicity


# Pieces ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary()


def test_pieces_round_trip(spark, make, odd):
    rows = pieces.round_trip(make(odd)).collect()
    assert len(rows) == len(odd) and all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
    repeated = [r["token_ids"] for r in rows if r["doc_id"] == 6]
    assert repeated[0] == repeated[1]
    assert pieces.round_trip(make(odd).limit(0)).count() == 0
    assert [(r["token_ids"], r["n_tokens"]) for r in rows if r["text"] is None] == [(None, None)]
    back = pieces.decode_tokens(pieces.encode_texts(make(odd), pieces.Vocabulary()), pieces.Vocabulary())
    assert all(r["text"] == r["decoded"] for r in back.collect())


def test_pieces_do_not_depend_on_the_batch(vocab):
    texts = ["the lazy dog sleeps", "Ünd Èaition " * 9, "a\n\n  b"]
    together = pieces.encode(vocab, texts, [1, 2, 3])
    for i, t in enumerate(texts):
        assert (pieces.encode(vocab, [t], [i + 1])[0] == together[i]).all()
    assert any((pieces.encode(vocab, [texts[0]], [k])[0].tolist() != together[0].tolist()) for k in range(20, 40))


@pytest.mark.parametrize("word", [" the", " inon", " ab"])
def test_whole_cuts_are_drawn_with_their_probabilities(vocab, word):
    """Against the enumeration of all cuts of a short word."""
    cuts = {}

    def walk(at, tokens, weight):
        if at == len(word):
            cuts[tuple(tokens)] = weight
        for end in range(at + 1, len(word) + 1):
            t = vocab.of.get(word[at:end])
            if t is not None:
                walk(end, [*tokens, t], weight * vocab.weight[t])

    walk(0, [], 1.0)
    n = 6000
    seen, total = Counter(tuple(x.tolist()) for x in pieces.encode(vocab, [word[1:]] * n, list(range(n)))), sum(cuts.values())
    assert len(cuts) > 2 and set(seen) <= set(cuts)
    for tokens, w in cuts.items():
        p = w / total
        assert abs(seen[tokens] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


@pytest.mark.parametrize("word", [" thering", "È" + "a" * 3, " " + "abcdefgh" * 9])
def test_cuts_are_drawn_with_their_probabilities(vocab, word):
    """The marginal of the last piece, by plain forward sums."""
    n = 4000
    drawn = pieces.encode(vocab, [word[1:] if word[0] == " " else word] * n, list(range(n)))
    word = word if word[0] == " " else " " + word
    total = [1.0] + [0.0] * len(word)
    last = {}
    for j in range(1, len(word) + 1):
        for k in range(1, min(16, j) + 1):
            t = vocab.of.get(word[j - k : j])
            w = vocab.weight[t] if t is not None else vocab.byte_weight ** len(word[j - 1].encode()) if k == 1 and word[j - 1] not in vocab.of else 0.0
            total[j] += total[j - k] * w * (1e3**k)
            if j == len(word) and w:
                last[t] = total[j - k] * w * (1e3**k)
    z = sum(last.values())
    seen = Counter(int(x[-1]) for x in drawn)
    for t, w in last.items():
        assert abs(seen[t] / n - w / z) < 5 * (w / z * (1 - w / z) / n) ** 0.5 + 1e-3


# Language --------------------------------------------------------------------------------------------


def cross_parse(text, labelled):
    """Phrases by plain substring search; a letter that the labelled text lacks is one by itself."""
    count, phrase = 0, ""
    for c in text:
        if phrase + c in labelled:
            phrase += c
            continue
        count += phrase != ""
        phrase = c if c in labelled else ""
        count += c not in labelled
    return count + (phrase != "")


@pytest.mark.parametrize("block", [langid.BLOCK, 37, 1])
def test_phrases_match_brute_force(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(3)
    labelled = {k: "".join(rng.choice(v) for _ in range(300)) for k, v in {"aa": "abcd ", "bb": "cdef "}.items()}
    parser = langid.Parser(labelled)
    texts = [langid.normalise("".join(rng.choice("abcdefxyz ") for _ in range(n))) for n in (1, 7, 300, 1500)]
    texts += ["", labelled["aa"], labelled["aa"] * 3, "abab" * 200, langid.normalise("a" * 700)]
    want = [[cross_parse(t, langid.normalise(labelled[k])) for k in parser.names] for t in texts]
    assert parser.phrases([parser.encode(t) for t in texts]).tolist() == want


@pytest.mark.parametrize("cells", [langid.TABLE_CELLS, 20_000])
def test_rare_letters_count(monkeypatch, cells):
    monkeypatch.setattr(langid, "TABLE_CELLS", cells)
    rng = random.Random(5)
    shared, first, second = ("".join(map(chr, range(0x4E00 + a, 0x4E00 + b))) for a, b in ((0, 70), (100, 130), (400, 800)))
    labelled = {k: "".join(rng.choice(shared if rng.random() < 0.9 else own) for _ in range(1500)) for k, own in {"aa": first, "bb": second}.items()}
    parser = langid.Parser(labelled)
    texts = ["".join(rng.choice(shared + first + second + "xyz ") for _ in range(n)) for n in (1, 7, 300, 1500)]
    want = [[cross_parse(t, labelled[k]) for k in parser.names] for t in texts]
    assert parser.phrases([parser.encode(t) for t in texts]).tolist() == want


def test_scripts_of_thousands_of_letters():
    """Two scripts of 3,000 letters each, half of them shared, beside two that use the Latin one."""
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(4500)]
    latin = {"en": ["the", "quick", "brown", "fox", "over", "lazy", "dogs", "and"], "de": ["der", "schnelle", "braune", "fuchs", "über", "faule", "hunde", "und"]}
    scripts = {"ja": han[:3000], "zh": han[1500:]}
    text = lambda k, n: ("".join(rng.choice(scripts[k]) for _ in range(n)) if k in scripts else " ".join(rng.choice(latin[k]) for _ in range(n)))[:n]
    parser = langid.Parser({k: text(k, langid.LANG_CHARS) for k in ("en", "de", "ja", "zh")})
    given = [(k, text(k, n)) for k in ("en", "de", "ja", "zh") for n in (40, 200) for _ in range(50)]
    langs, _ = parser.predict([t for _, t in given])
    assert np.mean([a == b for (a, _), b in zip(given, langs, strict=True)]) > 0.95


def test_sample_takes_every_language_and_place(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "Parser", seen.update)
    start = "shared license passage " * 60
    rows = [(i, start + f"{'abcdefgh'[i % 8]} " * 3000, "abcdefgh"[i % 8]) for i in range(320)]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(seen) == list("abcdefgh")
    for lang, text in seen.items():
        assert 20_000 < len(text) <= langid.LANG_CHARS and text.count(f"{lang} ") > 5000 and len(text.split("\n")) > 20


def test_language_accuracy_and_odd_texts(spark, make, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97 and all(0 <= r["score"] <= 1 for r in found)
    own = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(make(odd), langid.learn(docs)).collect()}
    assert own[1] == own[2] == own[9] == ("und", 0.0) and own[6][0] in {"de", "en", "es", "fr"}
    assert {r["lang_pred"] for r in langid.identify(make(odd), langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(make(odd).limit(0), langid.learn(docs)).count() == 0
    assert langid.learn(make(odd)).names == ["de", "en"]


# Toxicity --------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows():
    rng = random.Random(5)
    bad, good = ["idiot", "moron", "scum"], ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(900):
        words = rng.choices(good, k=rng.randint(5, 200))
        label = i % 5 == 0
        if label:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "!", ","])
        rows.append((" ".join(words), int(label), "en"))
    model = toxicity.fit(*map(list, zip(*rows[:600], strict=True)))
    again = toxicity.fit(*map(list, zip(*rows[:600], strict=True)))
    ids = toxicity.WordIds()
    scores = [model.score(toxicity.buckets(t, ids)) for t, _, _ in rows[600:]]
    assert scores == [again.score(toxicity.buckets(t, ids)) for t, _, _ in rows[600:]]
    assert np.mean([(s >= 0.7) == bool(y) for s, (_, y, _) in zip(scores, rows[600:], strict=True)]) > 0.97
    long = " ".join(rng.choices(good, k=150_000)) + " moron"
    assert model.score(toxicity.buckets(long, ids)) >= 0.7, "the end of a long text counts"
    assert model.score(toxicity.buckets(None, ids)) == model.score(toxicity.buckets("", ids)) < 0.7


def test_filters_against_a_plain_convolution(monkeypatch):
    """The pooled maxima of random filters, window by window, also where the text is read in chunks."""
    rng = np.random.default_rng(8)
    emb = rng.normal(size=(2 * toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    kernels = [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    biases = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    model = toxicity.Model(emb, kernels, biases, None, 0.0, None, None, 1.0)
    for chunk in (toxicity.CHUNK_WORDS, 4):
        monkeypatch.setattr(toxicity, "CHUNK_WORDS", chunk)
        for n in (0, 1, 2, 3, 4, 5, 30):
            ids = toxicity.buckets(" ".join(f"w{k}" for k in range(n)), toxicity.WordIds())
            want = [max([0.0] + [float(sum(emb[ids[a + k]].sum(axis=0) @ kernels[j][k][:, f] for k in range(w)) + biases[j][f]) for a in range(n - w + 1)]) for j, w in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]
            assert np.allclose(model.pooled(ids)[0], want, atol=1e-4)


def test_toxicity_query(spark):
    """The registered query on its table: what it says of held-out rows, and how many of them it gets right."""
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op4_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([p for p, y in held if y == 1]) > 0.7 and np.mean([1 - p for p, y in held if y == 0]) > 0.97


def test_toxicity_rows(spark, make, odd):
    labels = spark.createDataFrame([(2, 0, 0), (6, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(make(odd), labels)
    rows = toxicity.with_score(make(odd).drop("score"), model).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] < 0.7 for r in rows)
    assert toxicity.with_score(make(odd).drop("score").limit(0), model).count() == 0
    held = {r[0]: r[1] for r in spark.range(50).select("id", toxicity.held_out(F.col("id"))).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


# Media -----------------------------------------------------------------------------------------------


def test_png_round_trip_and_filters():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 1000):
        payload = media.padded(rng.randbytes(n))
        assert len(payload) % 64 == 0 and payload and media.decode_png(media.encode_png(payload)).tobytes() == payload
    samples = np.frombuffer(rng.randbytes(64 * 6), np.uint8).reshape(6, 64).astype(int)
    rows = b""
    for i, how in enumerate([0, 1, 2, 3, 4, 4]):
        left = np.concatenate([[0], samples[i, :-1]])
        up = samples[i - 1] if i else np.zeros(64, int)
        corner = np.concatenate([[0], up[:-1]])
        guess = left + up - corner
        da, db, dc = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        rows += bytes([how]) + ((samples[i] - [0 * left, left, up, (left + up) // 2, paeth][how]) & 255).astype(np.uint8).tobytes()
    good = media.encode_png(samples.astype(np.uint8).tobytes())
    body = zlib.compress(rows)
    at = good.index(b"IDAT")
    chunk = len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big")
    end = good[good.index(b"IEND") - 4 :]
    assert (media.decode_png(good[: at - 4] + chunk + end) == samples).all()
    with pytest.raises(ValueError):
        media.decode_png(good[:at] + b"IDAX" + good[at + 4 :])


def test_sequences_keep_order_and_captions(spark):
    page = '<p>one <b>two</b></p><script>no</script><figure><img src="a.png" alt="x"><figcaption>cap &amp; tion</figcaption></figure>three<img src="b.png" alt="alt"><img><p>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (1, page)], "page_id long, html string")
    rows = sorted((r["page_id"], [(s["position"], s["kind"], s["text"], s["ref"], s["caption"]) for s in r["segments"]]) for r in media.sequences(pages).collect())
    want = [(0, "text", "one two", None, None), (1, "media", None, "a.png", "cap & tion"), (2, "text", "three", None, None), (3, "media", None, "b.png", "alt")]
    assert rows == [(1, want), (1, want), (2, []), (3, [])]


def test_interleaved_pages(spark, make):
    """Positions, captions and payloads stay together, however often a payload is referred to; the driver's pages parse to text in order."""
    from strandline.llm.common import Scratch

    scratch = Scratch(spark)
    texts = ["first payload", "second payload", "ü" * 100]
    digest = lambda t: media.SCHEME + hashlib.sha256(media.padded(t.encode())).hexdigest()
    refs = [digest(t) for t in texts] + [media.SCHEME + "0" * 64, "plain.png"]
    rng = random.Random(9)
    orders = [[rng.randrange(len(refs)) for _ in range(n)] for n in (0, 1, 5, 40)]
    page = lambda order: "".join(f"<p>text {k}</p><figure><img src='{refs[i]}'><figcaption>caption {k} of {i}</figcaption></figure>" for k, i in enumerate(order))
    pages = spark.createDataFrame([(k, page(o)) for k, o in enumerate(orders)] + [(9, None), (2, page(orders[2]))], "page_id long, html string")
    store = media.store(make([(k, t, None) for k, t in enumerate(texts)]), scratch)
    sha = {r["digest"]: hashlib.sha256(bytes(r["media"])).hexdigest() for r in store.collect()}
    rows = media.interleaved(pages, store, scratch).collect()
    assert sorted(r["page_id"] for r in rows) == [0, 1, 2, 2, 3, 9]
    for r in rows:
        order = orders[r["page_id"]] if r["page_id"] < 9 else []
        assert [s["position"] for s in r["segments"]] == list(range(2 * len(order)))
        for k, i in enumerate(order):
            text, figure = r["segments"][2 * k], r["segments"][2 * k + 1]
            assert (text["text"], text["media_sha256"]) == (f"text {k}", None)
            assert (figure["ref"], figure["caption"], figure["media_sha256"]) == (refs[i], f"caption {k} of {i}", sha.get(refs[i].removeprefix(media.SCHEME)))
            assert (figure["feature"] is None) == (i > 2)
    own = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in media.interleaved(own, store, scratch).collect():
        assert r["segments"] and all(s["kind"] == "text" and s["position"] == i for i, s in enumerate(r["segments"]))


@pytest.mark.parametrize("tag", ["noscript", "template"])
def test_unclosed_silence(tag):
    page = f"<p>one</p><{tag}><p>two</p><img src='a.png'>three"
    assert media.parse_page(page) == media.parse_page(f"{page}</{tag}>") == [("text", "one", None, None), ("media", None, "a.png", None)]
    assert media.parse_page(f"<{tag}>two</{tag}>three</{tag}>four") == [("text", "threefour", None, None)]


def test_pages_query(spark, make, tmp_path):
    """Whole pages, null, empty and repeated ones too, as the parser gives them one by one; references find the documents' payloads."""
    texts = ["payload", None, ""]
    make([(k, t, None) for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    ref = lambda t: media.SCHEME + hashlib.sha256(media.padded((t or "").encode())).hexdigest()
    html = [None, "", "no tags", f"<p>a<img src='{ref('payload')}' alt='x'>b<img src='{ref(None)}'><img src='{ref('other')}'>" + "c " * 10**5]
    pages = [(i, h) for i, h in enumerate(html)] + [(3, html[3])]
    spark.createDataFrame(pages, "page_id long, html string").withColumn("segments", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    rows = media.media_pages(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in rows) == [0, 1, 2, 3, 3]
    for r in rows:
        want = media.parse_page(html[r["page_id"]])
        assert [(s["kind"], s["text"], s["ref"], s["caption"]) for s in r["segments"]] == want
        assert (r["n_text"], r["n_media"]) == (sum(w[0] == "text" for w in want), sum(w[0] == "media" for w in want))
        found = [s["media_sha256"] is not None for s in r["segments"] if s["kind"] == "media"]
        assert found == ([True, True, False] if r["page_id"] == 3 else [])


def test_media_of_texts(spark, make, odd, tmp_path):
    make(odd).write.parquet(str(tmp_path / "documents.parquet"))
    rows = media.op2_media(spark, str(tmp_path)).collect()
    texts = Counter((i, t) for i, t, _ in odd)
    assert len(rows) == len(odd)
    for (i, t), n in texts.items():
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        same = [r for r in rows if r["doc_id"] == i]
        assert len(same) == n
        for r in same:
            at = [s for s in r["segments"] if s["kind"] == "media"]
            digest = media.SCHEME + hashlib.sha256(pad).hexdigest()
            assert [(s["ref"], s["caption"]) for s in at] == [(digest, f"{len(t or '')} characters"), (digest, f"{len((t or '').split(chr(10)))} lines")]
            lines = [" ".join(x.split()) for x in (t or "").split("\n")]
            sizes = [len(x) for x in lines]
            assert [s["chars"] for s in r["segments"]] == [n for n in sizes[:1] if n] + [0] + [n for n in sizes[1:] if n] + [0]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    refs = spark.createDataFrame([(1, "missing")], "id long, digest string")
    from strandline.llm.common import Scratch

    scratch = Scratch(spark)
    assert media.resolve(refs, media.store(make(odd), scratch), scratch).first()["feature"] is None


def test_letters_that_languages_lack(monkeypatch):
    """Texts encoded in small pieces cost the same; letters that a language lacks are counted by the text's alphabet, not along its length."""
    parser = langid.Parser({"aa": "abcabc abd", "bb": "xyz xyzzy äöü", "cc": "𝒳𝒴 abc"})
    texts = ["abc xyz", "", "äöü" * 3000 + "𝒳?", "q" * 50, "abd abd"]
    want = parser.costs(texts)
    monkeypatch.setattr(langid, "PIECE_CHARS", 7)
    assert np.array_equal(parser.costs(texts), want)
    lacking = [[sum(int(parser.lacks[k, c]) for c in parser.encode(t)) for k in range(len(parser.names))] for t in texts]
    coded = [parser.encode(t) for t in texts]
    assert np.allclose(want, (parser.phrases(coded) - np.array(lacking)) * parser.bits + np.array(lacking) * langid.LETTER_BITS)


def test_memory_of_a_very_long_text():
    """Ten million characters in 40 languages: far below what a running sum along the text would take (3.2 GB)."""
    import tracemalloc

    parser = langid.Parser({f"l{k}": "".join(chr(97 + (i * (k + 3)) % 26) for i in range(300)) for k in range(40)})
    text = "the quick brown fox jumps over it. " * 300_000
    tracemalloc.start()
    cost = parser.costs([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cost.shape == (1, 40) and peak < 400_000_000
