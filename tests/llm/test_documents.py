"""Operators on documents against plain versions, and on odd rows."""

import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.llm import language, mixing, packing, repetition, scoring, similar, subwords, toxicity
from veilwork.llm.queries import QUERIES
from veilwork.llm.tables import Workspace, read
from veilwork.llm.words import PIECE_BYTES, pieces

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, NULLs in every column, and columns whose names operators use."""
    rows = [(i, t, "en", None if i % 3 else "s", 1, True, 0.5, "x") for i, t in enumerate(plain.ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "some text without id", None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words long, kept boolean, score double, size string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def odd_texts():
    return {i: t for i, t in enumerate(plain.ODD_TEXTS)}


def test_words_across_pieces():
    rng = random.Random(5)
    column = [rng.choice(["", "ab  c\n", None, "é\tü x" * 50]) for _ in range(300)] + ["z " * (PIECE_BYTES // 2 + 9), "q"]
    found, at, seen = [], 0, {}
    for piece in pieces(pa.array(column)):
        assert piece.rows.start == at
        at = piece.rows.stop
        hashes = piece.hashes()
        for d in range(len(piece)):
            part = range(piece.first[d], piece.first[d + 1])
            found.append([piece.buf[piece.starts[i]:piece.ends[i]].tobytes().decode() for i in part])
            for i, w in zip(part[:20], found[-1]):
                assert seen.setdefault(int(hashes[i]), w) == w
    assert found == [plain.words(t) for t in column]
    assert len(seen) == len(set(seen.values()))


def test_repetition_query(spark, texts):
    rows = QUERIES["op5_repetition"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        if len(texts[r.doc_id]) < 20000:
            want = plain.repetition(texts[r.doc_id])
            assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repetition_random():
    rng = random.Random(3)
    column = ["".join(rng.choice(["a", "b", "é", "a b\n", "$ "]) + rng.choice([" ", "", "\n"])
                      for _ in range(rng.randint(0, 150))) for _ in range(300)]
    got = {}
    for piece in pieces(pa.array(column)):
        for k, v in repetition.measure(piece).items():
            got.setdefault(k, []).extend(v.tolist())
    for i, text in enumerate(column):
        want = plain.repetition(text)
        assert {k: got[k][i] for k in want} == want


@pytest.mark.parametrize("stride", [1, 4, 1 << 10])
def test_repetition_periods(monkeypatch, stride):
    """Texts of a period repeat almost whole, however the places are strided."""
    monkeypatch.setattr(repetition, "STRIDE", stride)
    rng = random.Random(stride)
    column = []
    for _ in range(60):
        period = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        column.append(" ".join((period * 40)[:rng.randint(0, 90)] + ["z"] * rng.randint(0, 9) + period))
    got = [repetition.measure(piece) for piece in pieces(pa.array(column))]
    for i, text in enumerate(column):
        want = plain.repetition(text)
        assert {k: int(np.concatenate([g[k] for g in got])[i]) for k in want} == want


@pytest.mark.parametrize("period", [1, 999])
def test_repetition_memory_of_a_long_text(period):
    """A text that repeats itself throughout takes a bounded number of bytes a word."""
    n = 400_000
    words = np.resize(np.arange(period), n)
    tracemalloc.start()
    twice, longest = repetition.repeats(words, np.array([0, n]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert twice.all() and longest.max() == n - period and peak < 150 * n


def test_repetition_odd(odd, empty):
    rows = repetition.repetition(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_words == 0 and by_id[0].base_failed and not by_id[0].kept
    assert by_id[13].n_repeat_words == by_id[13].n_words == 6000 and not by_id[13].kept
    assert by_id[len(plain.ODD_TEXTS) - 1].kept
    assert repetition.repetition(empty).count() == 0
    kept = repetition.good(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [len(plain.ODD_TEXTS) - 1]


def test_language_held_out(spark):
    found = QUERIES["op8_byte_cnn"](spark, SF)
    true = read(spark, SF, "documents").select("doc_id", "lang")
    rows = found.join(true, "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.collect())


def test_language_odd(odd, empty):
    model = language.fit(odd)
    assert model.languages == ["en"]
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 12)] == ["und"] * 4 and rows[0].score == 0
    assert rows[4].lang_pred == "en"
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    kept = language.known_language(odd, model)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


def test_language_network_learns():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 200)
    windows = np.where(labels[:, None] == 1, rng.integers(97, 105, (200, language.WINDOW)),
                       rng.integers(103, 112, (200, language.WINDOW)))
    model = language.train(windows, labels, ["a", "b"])
    assert (model.probabilities(windows).argmax(axis=1) == labels).mean() == 1


def _plain_probabilities(model, window):
    """The network on one window, one product after the other."""
    padded = [*window, *[256] * (language.WINDOW - len(window))]
    embedded = [[float(x) for x in model.embedding[b]] for b in padded]
    hidden = []
    for f in range(model.filters.shape[1]):
        width = language.WIDTHS[f // language.FILTERS]
        taps = model.filters[:, f].reshape(-1, language.EMBEDDING)
        sums = [sum(float(taps[k][e]) * embedded[at + k][e] for k in range(width) for e in range(language.EMBEDDING))
                for at in range(language.WINDOW - max(language.WIDTHS) + 1)]
        hidden.append(max(0.0, max(sums) + float(model.bias[f])))
    logits = [sum(h * float(w) for h, w in zip(hidden, model.weights[:, k])) + float(model.offset[k])
              for k in range(len(model.languages))]
    total = sum(math.exp(x - max(logits)) for x in logits)
    return [math.exp(x - max(logits)) / total for x in logits]


def test_language_equals_a_plain_network(spark):
    """Predictions are the plain network's, averaged over the windows of a text by their length."""
    model = language.fit(read(spark, SF, "documents"), per_language=20)
    some = ["short", "Wörter und mehr", "The quick brown fox " * 30, "x" * 256 + "é"]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    rows = {r.doc_id: r for r in language.identify(frame, model).collect()}
    for i, text in enumerate(some):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        windows = [data[a:a + language.WINDOW] for a in range(0, len(data), language.WINDOW)]
        found = [_plain_probabilities(model, w) for w in windows]
        mean = [sum(p[k] * len(w) for p, w in zip(found, windows)) / len(data) for k in range(len(model.languages))]
        assert abs(rows[i].score - max(mean)) < 1e-3 and rows[i].lang_pred == model.languages[mean.index(max(mean))]


def test_language_learns_from_bounded_windows(spark):
    """A very long text gives no more windows than any other, drawn over its whole length, wherever it is read."""
    texts = spark.createDataFrame([(1, "en", "a" * 100 + "b" * 60_000 + "c" * 60_000), (2, "de", "kurz")],
                                  "spread long, lang string, text string")
    found = sorted((r.spread, r.nth, bytes(r.window)) for r in language._drawn(texts).collect())
    assert [r[0] for r in found] == [1] * language.WINDOWS_PER_TEXT + [2]
    assert found == sorted((r.spread, r.nth, bytes(r.window)) for r in language._drawn(texts.repartition(2)).collect())
    assert max(r[1] for r in found) > 100


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_toxicity"](spark, sf)
    rows = found.join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.93 * len(rows)
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_planted_words(spark):
    rng = random.Random(9)

    def text(bad):
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)]
        for _ in range(bad):
            w[rng.randrange(60)] = rng.choice(["vilest", "Nasty,"])
        return " ".join(w) + "."

    rows = [(i, text(3 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    new = spark.createDataFrame([(1, "é alpha vilest beta.", 7), (2, "alpha beta gamma.", 7), (3, None, 7)],
                                "doc_id long, text string, score int")
    found = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert [found[i].predicted for i in (1, 2, 3)] == [1, 0, 0]
    assert [tuple(s) for s in found[1].spans] == [(8, 14)]


def test_toxicity_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    odds, steps = np.exp(rng.normal(size=5)), np.exp(rng.normal(size=(2, 2)))
    opens = np.array([True, False, False, True, False])
    got = toxicity.marginals(odds, opens, steps)[0]
    for begin, end in ((0, 3), (3, 5)):
        weight = np.zeros((end - begin, 2))
        for path in range(2 ** (end - begin)):
            states = [path >> k & 1 for k in range(end - begin)]
            w = np.prod([odds[begin + k] if s else 1 for k, s in enumerate(states)])
            w *= np.prod([steps[a, b] for a, b in zip(states, states[1:])])
            for k, s in enumerate(states):
                weight[k, s] += w
        assert np.allclose(got[begin:end], weight[:, 1] / weight.sum(axis=1))


def test_toxicity_excerpts(spark):
    """Texts up to the bound stay whole; longer ones give their beginning, end and what lies evenly between."""
    bound, part = toxicity.EXCERPTS * toxicity.EXCERPT_CHARS, toxicity.EXCERPT_CHARS
    long = "".join(chr(0x4E00 + i // 100) for i in range(10 * bound))
    texts = ["short", "é" * bound, "x" * (bound + 1), long]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    got = [r.t for r in frame.select(toxicity.excerpts(F.col("text")).alias("t")).collect()]
    assert got[:2] == texts[:2]
    assert [len(t) for t in got[2:]] == [bound + toxicity.EXCERPTS - 1] * 2
    parts = got[3].split("\n")
    places = [int((len(long) - part) / (toxicity.EXCERPTS - 1) * k) for k in range(toxicity.EXCERPTS)]
    assert parts == [long[p:p + part] for p in places] and places[-1] + part == len(long)


def test_toxicity_scores_as_a_plain_field(spark):
    """Scores of documents from the chances of all taggings of their sentences."""
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=1 << toxicity.TABLE_BITS, scale=0.4), rng.normal(size=(2, 2)),
                           rng.normal(size=3))
    texts = ["bad words here. and some more of them\nlast line", "one", "a b c d e f g h", ""]
    got = [r.score for r in toxicity.score(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, found in zip(texts, got):
        chances = [0.0]
        for piece in pieces(pa.array([text]), lower=True):
            features, opens = toxicity._features(piece)
            own = model.table[toxicity._slots(features, opens)].sum(axis=1)
            begins = [*np.flatnonzero(opens), len(own)]
            for a, b in zip(begins, begins[1:]):
                weigh = {}
                for tags in itertools.product((0, 1), repeat=int(b - a)):
                    steps = sum(model.steps[x, y] for x, y in zip(tags, tags[1:]))
                    weigh[tags] = math.exp(sum(o for o, t in zip(own[a:b], tags) if t) + steps)
                chances += [sum(w for tags, w in weigh.items() if tags[k]) / sum(weigh.values()) for k in range(b - a)]
        top = min(max(*chances, 1e-6, 1e-6), 1 - 1e-6)
        seen = [1, math.log(top / (1 - top)), math.log1p(sum(c for c in chances if c > 0.01))]
        assert math.isclose(found, 1 / (1 + math.exp(-float(np.dot(seen, model.curve)))), rel_tol=1e-6)


def test_toxicity_odd(odd, empty):
    labels = odd.select("doc_id", F.lit(0).alias("toxic"))
    assert toxicity.fit(odd, labels) is None and toxicity.fit(empty, labels) is None and toxicity.fit(odd, labels.where("false")) is None
    rows = toxicity.score(odd, None).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.0}
    model = toxicity.fit(odd, odd.select("doc_id", (F.col("doc_id") == 4).cast("int").alias("toxic")))
    assert len(toxicity.score(odd, model).collect()) == odd.count()
    assert toxicity.score(empty, model).count() == 0


def test_near_duplicates_query(spark, texts):
    want = plain.near_duplicates(texts)
    rows = QUERIES["op4_minhash_forest"](spark, SF).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == want and len(rows) == len(want)


def test_near_duplicates_planted(spark, monkeypatch):
    """Chains of edited copies, in groups larger than a block."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    monkeypatch.setattr(similar, "GROUP_ROWS", 50)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows[i] = " ".join(w)
    rows |= {100 + i: " ".join(f"y{rng.randrange(50)}" for _ in range(60)) for i in range(60)}
    rows |= {200: rows[3], 201: rows[3], 202: None, 203: None, 204: "", 205: "a b", 206: "a b", 207: "a  b\n"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar.near_duplicates(docs).collect()}
    assert got == plain.near_duplicates(rows)
    kept = similar.deduplicated(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c, _ in got.values()})


def test_near_duplicates_beside_a_hot_group(spark):
    """Isolated pairs exactly at the threshold are all met, whatever else the corpus holds."""
    rng = random.Random(5)

    def copies(n, length, places):
        base = [f"w{rng.randrange(10 ** 9)}" for _ in range(length)]
        return [" ".join([*base[:p], f"x{rng.randrange(10 ** 9)}", *base[p + 1:]]) for p in rng.sample(places, n)]

    rows = list(enumerate(copies(150, 400, range(5, 395))))
    for i in range(500):  # one word of 49 replaced: 40 of 50 shingles are common
        base = [f"w{rng.randrange(10 ** 9)}" for _ in range(49)]
        rows += [(1000 + 2 * i, " ".join(base)), (1001 + 2 * i, " ".join([*base[:24], "other", *base[25:]]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 149) if i < 1000 else (i - i % 2, 1) for i, _ in rows}


def test_near_duplicates_odd(odd, empty):
    rows = similar.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_links for r in rows if r.doc_id == 4} == {2}
    kept = similar.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        [i for i in range(len(plain.ODD_TEXTS)) if i != 6] + [None], key=str)
    assert similar.near_duplicates(empty).count() == 0 and similar.deduplicated(empty).count() == 0


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = {r.doc_id: r for r in QUERIES["op7_bit_packing"](spark, SF).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, packing.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_special_strings_move_later_starts(spark):
    """Ids read back of texts with the string of an added token, and where the next document starts."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    some = {3: "a <|endoftext|> b", 5: "c d", 8: "<|endoftext|>" * 2, 9: None}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    rows = packing.read_ids(packing.write_ids(docs, BYTE_BPE, Workspace(spark, "special"))).collect()
    want, start = {}, 0
    for i in sorted(some):
        n = len(library.encode(some[i] or "", add_special_tokens=False).ids) + 1
        want[i], start = (start, n), start + n
    assert {r.doc_id: (r.start, r.n_tokens) for r in rows} == want


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    column = plain.ODD_TEXTS + ["".join(rng.choice(
        ["a", "Bc", "é", "1", ".", "'s", " ", "  ", "\n", "\t", "\r", "\x0b", "日本", " ", "\x1d", "_", "😀", "-"])
        for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    column += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|", "A b" * 9 + "<|endoftext|>" * 3]
    encoder, library = packing.Encoder(BYTE_BPE, cached=100), Tokenizer.from_file(BYTE_BPE)
    want = [e.ids for e in library.encode_batch([t or "" for t in column], add_special_tokens=False)]
    assert len(library.encode("<|endoftext|>", add_special_tokens=False).ids) == 1
    got = []
    for _, ids, counts in encoder.batches(pa.array(column)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 24])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (packing.unpack(data, bits, 0, 1003) == ids).all() and (packing.unpack(data, bits, 77, 501) == ids[77:501]).all()
    block = packing.Block(packing.write_block(ids, np.array([3, 0, 1000]), bits))
    assert [len(block[i]) for i in range(3)] == [3, 0, 1000] and (block[2] == ids[3:]).all()


def test_packing_odd(spark, odd, empty):
    rows = packing.read_ids(packing.write_ids(odd, BYTE_BPE, Workspace(spark, "odd"), block_ids=50)).collect()
    assert len(rows) == odd.count()
    assert sorted(r.start for r in rows) == np.cumsum([0] + [r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1].tolist()
    assert next(r for r in rows if r.doc_id == 0).n_tokens == 1
    assert max(rows, key=lambda r: r.start).doc_id is None
    assert packing.read_ids(packing.write_ids(empty, BYTE_BPE, Workspace(spark, "none"))).count() == 0


def test_scoring_query(spark, texts):
    training = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    want = plain.base_scores(texts, training)
    rows = QUERIES["op9_deleted_interpolation"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, r.doc_id not in training)
        assert r.base_score == pytest.approx(base)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scoring_is_a_distribution(spark):
    """The chances of all words that can follow a context add up to one; small blocks and buckets change nothing."""
    learned = ["a b a c", "b a", "a b a c", "c c b", "a"]
    tests = {10 + i: f"a {w}" for i, w in enumerate(["a", "b", "c", "unseen"])} | {20: "a"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(learned)] + list(tests.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in scoring.score(docs, F.col("doc_id") < 10).collect()}
    again = {r.doc_id: r for r in scoring.score(docs, F.col("doc_id") < 10, block_words=3).collect()}
    for i, r in rows.items():
        assert again[i].score == pytest.approx(r.score) and again[i].base_score == pytest.approx(r.base_score)
    assert sum(10 ** rows[i].base_score for i in (0, 1)) < 1
    counts = {len(t.split()): 0 for t in learned}
    assert all(rows[i].n_tokens == len(t.split()) + 1 for i, t in enumerate(learned)) and counts


def test_weights_by_expectation_maximisation():
    """Held-out words that only their pairs explain give the pair all weight, and the other way round."""
    def cell(kind, pair, word):
        return (kind * scoring._CHANCES + pair) * scoring._CHANCES + word

    cells = np.array([cell(3, 1, 60), cell(5, 0, 2), cell(0, 0, 9)])
    weights = scoring.learn_weights(cells, np.array([50.0, 50.0, 50.0]), 1e-4)
    assert weights[3, 0] > 0.95 and weights[5, 1] > 0.95 and weights[0, 0] == 0
    assert np.allclose(weights.sum(axis=1), 1)


def test_scoring_odd(odd, empty):
    rows = scoring.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and next(r for r in rows if r.doc_id == 0).n_tokens == 1
    untrained = scoring.score(odd, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in untrained} == {(0, 0)} and all(r.base_score == 0 for r in untrained)
    assert scoring.score(empty, F.lit(True)).count() == 0


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    for source in {r.row.source for r in rows}:
        mine = [r for r in rows if r.row.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert mine[0].target <= 3 * mine[0].source_size + 1e-9 and all(0 <= r.copies <= 3 for r in mine)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1, "c": 50, "d": 400, None: 449}
    got = {r.source: r.target for r in mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, open_ = {}, set(sizes)
    while True:  # share, fix those above their limit, share the rest again
        left = 1000 - sum(want.values())
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    assert got == pytest.approx(want)


def test_mixing_near_target(spark):
    rows = QUERIES["op10_systematic_mix"](spark, "/root/testdata/sf0.01").toPandas()
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source").toPandas()
    by = rows.merge(docs, on="doc_id").groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((by["taken"] - by["target"]).abs() <= 1.5 * by["size"]).all()
    again = QUERIES["op10_systematic_mix"](spark, "/root/testdata/sf0.01").toPandas()
    assert again.sort_values("doc_id").reset_index(drop=True).equals(rows.sort_values("doc_id").reset_index(drop=True))


@pytest.fixture(scope="module")
def vocabulary():
    return subwords.Vocabulary.load(PIECES)


def test_subwords_equal_library(spark, texts, vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = [(i, texts[i]) for i in sorted(texts)[:60]] + [(1000 + i, t) for i, t in enumerate(plain.ODD_TEXTS)]
    some += [(2000, max(texts.values(), key=len) * 20), (2001, "x" * 50_000 + " y"), (2002, "a▁b ▁")]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    rows = {r.doc_id: r for r in subwords.encoded(docs, vocabulary).collect()}
    assert {i: r.ids for i, r in rows.items()} == {i: model.encode(t or "") for i, t in some}
    assert all(r.round_trip == (i != 2002) and r.n_pieces == len(r.ids) for i, r in rows.items())


def test_subwords_query(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r.doc_id: r for r in QUERIES["op2_sentencepiece_lattice"](spark, SF).collect()}
    assert {i: r.ids for i, r in rows.items()} == {i: model.encode(t or "") for i, t in texts.items()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows.values())


def test_subwords_state_is_bounded(vocabulary, monkeypatch):
    """Forgetting units, and lattices of few characters at once, change nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(subwords, "CACHED_UNITS", 5)
    monkeypatch.setattr(subwords, "_CHARACTERS", 16)
    merges = subwords.Merges(vocabulary, 9)
    some = [t for t in plain.ODD_TEXTS if t is None or len(t) < 1000] * 3
    got = []
    for piece in pieces(pa.array(some), size=40):
        ids, first = merges.piece(piece)
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [model.encode(t or "") for t in some]


def test_subwords_viterbi(spark):
    """With log chances as scores the fold finds the path with the largest sum."""
    rng = random.Random(6)
    found = {"a": -2.0, "b": -2.5, "c": -3.0, "▁": -1.0, "ab": -2.2, "bc": -4.0, "abc": -6.0, "▁a": -2.0, "cab": -5.5, "bca": -3.1}
    table = {p: (300 + k, s) for k, (p, s) in enumerate(found.items())}
    small = subwords.Vocabulary([(p, i, s) for p, (i, s) in table.items()], list(range(256)), [], False)
    units = ["".join(rng.choice("abc▁é") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(units)), "nth int, unit string")
    got = {r.nth: r.ids for r in subwords.best_path(subwords.lattice(frame, ["nth"], small), ["nth"], small).collect()}
    for i, unit in enumerate(units):
        want = [j for x in plain.viterbi(unit, table, small.unknown)
                for j in ([x] if x >= 0 else list(chr(-1 - x).encode()))]
        assert got[i] == want


@pytest.mark.parametrize("limit", [0, 4])
def test_subwords_long_units(spark, vocabulary, monkeypatch, limit):
    """Long units, folded where they are met, have the ids of the library too."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(limit)
    units = ["▁" + "".join(rng.choice(["a", "b", "ing", "the", "é", "日", "er", "\U0001f600"]) for _ in range(rng.randint(1, 60)))
             for _ in range(300)]
    assert [vocabulary.path(u) for u in units] == [model.encode(u[1:]) for u in units]
    monkeypatch.setattr(subwords, "LONG_UNIT", limit)
    docs = spark.createDataFrame([(i, f"{u[1:]} the {u[1:]}") for i, u in enumerate(units[:40])], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in subwords.encoded(docs, vocabulary).collect()}
    assert rows == {i: model.encode(f"{u[1:]} the {u[1:]}") for i, u in enumerate(units[:40])}


def test_viterbi_of_long_units():
    table = {"a": (300, -2.0), "b": (301, -2.5), "ab": (302, -2.2), "ba": (303, -4.0), "aba": (304, -3.1)}
    small = subwords.Vocabulary([(p, i, s) for p, (i, s) in table.items()], list(range(256)), [], False)
    rng = random.Random(1)
    for _ in range(50):
        unit = "".join(rng.choice("abé") for _ in range(rng.randint(1, 15)))
        assert small.path(unit) == [j for x in plain.viterbi(unit, table, small.unknown)
                                    for j in ([x] if x >= 0 else list(chr(-1 - x).encode()))]


def test_subwords_odd(odd, empty, vocabulary):
    rows = subwords.encoded(odd, vocabulary).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    assert [r.ids for r in rows if r.doc_id in (0, 1)] == [[], []]
    assert subwords.encoded(empty, vocabulary).count() == 0
