"""Operators on single texts."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import langid, nbsvm, packing, pieces, pii, toxicity
from quire.llm import textkit as tk
from tests.llm.conftest import DOCS, prose

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# personal data


def base_spans(t):
    """The contract's base spans, as plainly as it says them."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_at_random():
    rng = random.Random(6)
    parts = ["@", ".", "a", "Z9", "-", " ", "4111111111111111", "4111 1111 1111 1111", "+1", "(555)", "12", "255", "256", "1.2.3.4", "+", "%", "é", "x@y.z", "0", "\n"]
    for _ in range(6000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.detect(t) == base_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john (at) mail [dot] example.com now", "email", "john (at) mail [dot] example.com"), ("john at mail dot example dot com", "email", "john at mail dot example dot com"),
        ("ｊohn＠mail.example.com", "email", "ｊohn＠mail.example.com"), ("jоhn@example.com", "email", "jоhn@example.com"), ("jo​hn​@ex.com", "email", "jo​hn​@ex.com"),
        ("call plus one eight eight six five five five nine six seven four", "phone", "plus one eight eight six five five five nine six seven four"), ("１０.0.0.１", "ip", "１０.0.0.１"),
        ("at 10 dot 0 dot 0 dot 1 now", "ip", "10 dot 0 dot 0 dot 1"), ("10[.]20[.]30[.]40", "ip", "10[.]20[.]30[.]40"), ("john @ example.com", "email", "john @ example.com"), ("j<at>ex{dot}com", "email", "j<at>ex{dot}com"),
        ("call +1 (886) five five five-9674 x", "phone", "+1 (886) five five five-9674"), ("4111\xa01111–1111 1111", "card", "4111\xa01111–1111 1111"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, found):
    spans = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_spans(text)[1]]
    assert (kind, found) in spans


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("call +1 555 one two 34567", "phone", "+1 555 one two 34567"), ("card 4111 1111 1111 111one x", "card", "4111 1111 1111 111one"), ("host 10.20.30.four up", "ip", "10.20.30.four"),
        ("mail " + "a dot " * 11 + "b at c dot de now", "email", "a dot " * 11 + "b at c dot de"), ("mail ab (at) c" + " dot c" * 20 + " now", "email", "ab (at) c" + " dot c" * 20),
        ("mail john\t@\texample.com", "email", "john\t@\texample.com"),
    ],
)
def test_disguises_of_any_length(text, kind, found):
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_spans(text)[1]]


def test_plain_text_has_no_disguise():
    for t in ("we met at noon. the dot is red", "one two three", "look at 3.14.15 and 12 - 13", "a@b", "polka dot at home"):
        assert pii.find_spans(t) == ([], [])


def test_linear_on_long_runs():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "one " * 50_000, "a.b" * 60_000 + "@", "a dot " * 40_000, "a at " * 40_000 + "dot", "(dot)" * 40_000, "a@ " * 40_000 + " dot "):
        pii.find_spans(t)


def test_pii_tables(spark, odd, odd_rows, nothing):
    got = pii.digests(pii.find(odd)).collect()
    assert len(got) == len(odd_rows) and {r.spans for r in got} == {""}
    df = spark.createDataFrame([(1, "x a@b.cd 10.0.0.1 y", None, None, 19) + (None,) * 5], DOCS)
    r = pii.digests(pii.find(df)).first()
    assert (r.n_email, r.n_ip, r.spans) == (1, 1, "email:2:8,ip:9:17")
    red = pii.redact(df).first()
    assert red.text == "x [EMAIL] [IP] y" and red.n_chars == len(red.text)
    assert pii.redact(odd).collect() == odd.collect()
    assert pii.digests(pii.find(nothing)).count() == 0 and pii.redact(nothing).count() == 0


# pieces


def encode(texts, keys=None, **k):
    v, out = pieces.vocabulary(PIECES), []
    keys = np.array(keys if keys is not None else range(len(texts)), np.uint64)
    for i, j, buf, off in tk.slices(pa.array(texts, pa.string())):
        ids, at = pieces.encode(v, buf, off, keys[i:j], **k)
        back, back_at = pieces.decode(v, ids, at)
        assert bytes(back) == bytes(buf) and (back_at == off).all()
        out += [ids[at[x] : at[x + 1]].tolist() for x in range(j - i)]
    return out


def test_sampling_has_the_lattice_distribution():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alpha = 2e-4
    known = {sp.id_to_piece(i).replace("▁", " ").encode(): i for i in range(259, sp.get_piece_size())}
    word = b" hello"

    def paths(p):
        if p == len(word):
            yield (), 0.0
        for q in range(p + 1, len(word) + 1):
            if word[p:q] in known:
                for r, s in paths(q):
                    yield (known[word[p:q]], *r), s + alpha * sp.get_score(known[word[p:q]])

    every = dict(paths(0))
    total = sum(np.exp(s) for s in every.values())
    got = encode(["hello"] * 20_000)
    for path, s in every.items():
        assert abs(sum(tuple(g) == path for g in got) / 20_000 - np.exp(s) / total) < 0.015
    best = max(every, key=every.get)
    assert tuple(encode(["hello"], alpha=None)[0]) == best


def test_pieces_do_not_depend_on_batches():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 80)) + rng.choice(["", "\n\n x", " ▁ ", "  日本😀", "\x00"]) for _ in range(60)] + ["", None, " ", "\n", "word " * 3000]
    whole = encode(texts)
    assert [encode([t], keys=[k])[0] for k, t in enumerate(texts)] == whole
    assert encode(texts, seed=1) != whole


def test_piece_tables(spark, odd, odd_rows, nothing):
    ids = pieces.encode_documents(odd, PIECES)
    back = pieces.decode_documents(ids, PIECES).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((r[0], r[1] or "") for r in odd_rows if r[0])
    digest = pieces.encode_documents(odd, PIECES, output="digest").collect()
    assert all(r.lossless for r in digest)
    want = sorted((r.doc_id or -1, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in ids.collect())
    assert sorted((r.doc_id or -1, r.n_pieces, r.ids_crc32) for r in digest) == want
    assert pieces.encode_documents(nothing, PIECES).count() == 0


# packing


def test_units_are_the_tokenizer():
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    rng = random.Random(4)
    parts = ["Word", "l'été", "É", "é", "'s", "'", "42", "...", "!!", " ", "  ", "\n", "\x1c", "\x85", " ", "ß", "×", "日本", "é", "<|endoftext|>", "İ", "ﬁ", "Σς", "\x7f", "a-b", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [None, ""]
    got = packing.UnitTokenizer(BPE).encode(pa.array(texts, pa.string()))
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def check_packing(rows, got, size):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    want = sorted([(*tok.encode(t or "", add_special_tokens=False).ids, 1) for _, t in rows])
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist()
        total = sum(n for _, n in s)
        assert total == size or total < size and total & (total - 1) == 0
    joined = sorted(x for p in docs.values() for x in [sum((i for _, i in sorted(p)), ())])
    return want, joined, seqs


def test_packing_table(spark, odd, odd_rows, nothing):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] not in (17, 20, None)]
    df = odd.where("doc_id not in (17, 20)")
    want, joined, seqs = check_packing(rows, packing.pack(df, BPE).collect(), 2048)
    assert joined == want and len(seqs) <= sum(map(len, want)) // 2048 + 11
    assert packing.pack(nothing, BPE).count() == 0
    assert packing.pack(odd, BPE).where("start = 0").count() == len(odd_rows)


def test_packing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 400))) for i in range(300)]
    df = spark.createDataFrame([(i, t) + (None,) * 8 for i, t in rows], DOCS).repartition(20)
    want, joined, seqs = check_packing(rows, packing.pack(df, BPE, size=256, windows=4).collect(), 256)
    assert joined == want and len(seqs) <= sum(map(len, want)) // 256 + 8


# classifiers


def learnable(spark, mark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, mark(prose(rng, 60), rng) if bad else prose(rng, 60), "en", None, None, *(None,) * 5))
    labels = [(i, 1 if i % 3 == 0 else 0, "extra") for i in range(n)] + [(i, None, "x") for i in range(5)] + [(None, 1, "x"), (10_000, 1, "x")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, y int, text string")


def insult(t, rng):
    w = t.split()
    w[rng.randrange(len(w))] = rng.choice(["vequola", "vequemi", "zorkfel", "zorkan"])
    return " ".join(w)


def accuracy(scored, bar=0.5):
    got = [(r.doc_id, r.score) for r in scored.collect()]
    held = [(s >= bar) == (i % 3 == 0) for i, s in got if i is not None and i % 5 == 0]
    assert all(0 <= s <= 1 for _, s in got)
    return sum(held) / len(held)


def test_toxicity(spark, odd, odd_rows, nothing):
    docs, labels = learnable(spark, insult)
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"), "y")
    assert accuracy(toxicity.score(docs, model)) >= 0.9
    assert toxicity.score(odd, model).count() == len(odd_rows) and toxicity.score(nothing, model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 0.6 * 400 < kept.count() < 0.75 * 400
    none = toxicity.fit(docs, labels.where("y = 5"), "y")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.fit(nothing, labels, "y").prior == 0.0


def test_toxicity_in_small_slices():
    rng = random.Random(5)
    texts = pa.array([prose(rng, 300) for _ in range(500)])
    ratio = np.random.default_rng(0).normal(0, 1, toxicity.EVENTS).astype(np.float16)
    model = toxicity.Model(toxicity.Table(ratio), np.array([0.3, 0.2, 0.1, 0.4, -1.0]), 0.1)
    want = model.scores(texts)
    assert np.allclose(want, [model.scores(texts.slice(k, 1))[0] for k in range(len(texts))], rtol=0, atol=1e-9)
    tracemalloc.start()
    model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 1 << 20 and peak < 16 * texts.nbytes


def test_packed_counts():
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, 4 * toxicity.EVENTS, 5000))
    n = rng.integers(1, 1 << 40, len(code))
    width = 4 * toxicity.EVENTS // toxicity.CHUNKS
    back = [(c, *toxicity._unpack(x)) for c, x in toxicity._pack(code, n)]
    assert all((k // width == c).all() for c, k, _ in back)
    assert (np.concatenate([k for _, k, _ in back]) == code).all() and (np.concatenate([m for *_, m in back]) == n).all()


def plain_symbols(t):
    """The alphabet, said again: letters, digits, marks as one blank between words."""
    out = []
    for byte in (t or "").encode():
        c = chr(byte)
        k = 31 if byte >= 0xC0 else 1 + byte % 64 % 30 if byte >= 0x80 else ord(c.lower()) - 96 if c.isalpha() else 27 if c.isdigit() else 0
        if k or (out and out[-1]):
            out.append(k)
    return [0] * 4 + out + [0]


def test_kneser_ney_plainly():
    """The table against Kneser-Ney estimates by dictionaries, in fractions of the same counts."""
    rng = random.Random(1)
    texts = [(insult(prose(rng, 12), rng) if i % 3 == 0 else prose(rng, 12), int(i % 3 == 0)) for i in range(40)] + [("", 0), (None, 1), ("42 été", 0)]
    own = [{}, {}]
    for t, y in texts:
        s = plain_symbols(t)
        for i in range(4, len(s)):
            e = tuple(s[i - 4 : i + 1])
            own[y][e] = own[y].get(e, 0) + 1
    sets = [set(own[0]) | set(own[1])]
    kinds = []
    for _ in range(4):  # how many different symbols stood before each shorter event
        before = {}
        for e in sets[-1]:
            before.setdefault(e[1:], set()).add(e[0])
        kinds.append({e: len(x) for e, x in before.items()})
        sets.append(set(before))

    def shared(e):
        if not e:
            return 1 / 32
        level = kinds[4 - len(e)]
        same = [n for x, n in level.items() if x[:-1] == e[:-1]]
        return max(level[e] - 0.75, 0) / sum(same) + sum(min(n, 0.75) for n in same) / sum(same) * shared(e[1:])

    def like(y, e):
        same = [n for x, n in own[y].items() if x[:-1] == e[:-1]]
        back = shared(e[1:])
        if not same:
            return back
        n = own[y].get(e, 0)
        return (n - min(n, 2.5)) / sum(same) + sum(min(x, 2.5) for x in same) / sum(same) * back

    number = lambda e: sum(k << 5 * (4 - i) for i, k in enumerate(e))
    key = np.array(sorted(map(number, sets[0])))
    by = {number(e): e for e in sets[0]}
    n = np.array([[own[y].get(by[k], 0) for k in key.tolist()] for y in (0, 1)], float)
    table = toxicity.log_ratios(key, n)
    for k in key.tolist()[::7]:
        assert abs(float(table[k]) - np.log(like(1, by[k]) / like(0, by[k]))) < 5e-3
    buf = pa.array([t for t, _ in texts], pa.string())
    for _, _, b, off in tk.slices(buf):
        got, at = toxicity.events(b, off)
        x = toxicity.evidence(table, b, off)
    for i, (t, _) in enumerate(texts):
        s = plain_symbols(t)
        want = [number(s[k - 4 : k + 1]) for k in range(4, len(s))]
        assert got[at[i] : at[i + 1]].tolist() == want
        assert abs(x[i, 0] - np.mean([float(table[k]) for k in want])) < 1e-6  # length-normalised


def test_quality(spark, odd, odd_rows, nothing):
    docs, labels = learnable(spark, lambda t, rng: t.upper().replace(" ", "!! "))
    model = nbsvm.fit(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"), "y", sample_rows=200)
    assert accuracy(nbsvm.score(docs, model)) >= 0.97
    assert nbsvm.score(odd, model).count() == len(odd_rows) and nbsvm.score(nothing, model).count() == 0
    assert {r.score for r in nbsvm.score(docs, nbsvm.fit(docs, labels.where("y = 5"), "y")).collect()} == {0.5}
    assert {r.score for r in nbsvm.score(docs, nbsvm.fit(docs, labels.where("y = 1"), "y")).collect()} == {1.0}


def test_hinge_loss_separates():
    rng = np.random.default_rng(2)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 10), [60 + i % 2]])) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, b = nbsvm.dual_coordinate_descent(rows, np.ones(100), y)
    assert all(np.sign(w[f].sum() / np.sqrt(len(f)) + b) == t for f, t in zip(rows, y, strict=True))


def test_language(spark, odd, odd_rows, nothing):
    rng = random.Random(3)
    syll = {"xx": ["ka", "lo", "mi"], "yy": ["ßtü", "wer", "zun"], "zz": ["ique", "ção", "lh"]}
    rows = [(i, " ".join("".join(rng.choices(syll[k], k=3)) for _ in range(20)), k if i % 7 else None, None, None, *(None,) * 5) for i in range(300) for k in [list(syll)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    protos = langid.learn(docs.where("doc_id % 4 <> 2"))
    assert set(protos) == set(syll)
    got = {r.doc_id: r for r in langid.predict(docs, protos).collect()}
    assert np.mean([got[i].lang_pred == list(syll)[i % 3] for i in range(300) if i % 4 == 2]) >= 0.98
    odd_got = {r.doc_id: r for r in langid.predict(odd, protos).collect()}
    assert len(odd_got) and all(odd_got[i].lang_pred == "und" and odd_got[i].score == 0 for i in (7, 8, 9)) and odd_got[19].lang_pred != "und"
    assert langid.predict(nothing, protos).count() == 0 and langid.learn(nothing) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def plain_vector(t):
    """A text's bundle, a trigram at a time."""
    out = np.zeros(langid.DIMS)
    s = [0] + [ord(c) if c.isalpha() else 0 for c in (t or "").lower()] + [0]
    letter = lambda c: 1 - 2 * np.unpackbits(langid.letter_bits(np.array([c]))[0]).astype(float)
    for i in range(1, len(s) - 1):
        if s[i]:
            out += np.roll(letter(s[i - 1]), 2) * np.roll(letter(s[i]), 1) * letter(s[i + 1])
    return out


def test_language_vectors_plainly():
    texts = ["Die Ölung, ja", "", None, "日本語 テスト", "a", "12 . 7", "aba bab aba", "😀 x𝔘y"]
    v = langid.vectors(texts)
    for t, x in zip(texts, v, strict=True):
        plain = plain_vector(t)
        assert np.allclose(x * np.linalg.norm(plain), plain, atol=1e-3), t
    assert abs(plain_vector("abc") @ plain_vector("cba")) < 0.5 * np.linalg.norm(plain_vector("abc")) ** 2  # order matters
    near = plain_vector("abc")
    assert near.any() and langid.letter_bits(np.arange(5)).shape == (5, langid.DIMS // 8)


def test_language_prototypes_plainly(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("ein wort", "de"), ("un mot", "fr"), ("noch eins", "de"), ("une phrase", "fr"), ("x", None), (None, "de")])]
    protos = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    for y in ("de", "fr"):
        want = sum(plain_vector(t) for _, t, z in rows if z == y and t)
        assert np.allclose(protos[y], want / np.linalg.norm(want), atol=1e-5)
    got = langid.predict(spark.createDataFrame([(1, "ein mot")], "doc_id long, text string"), protos).first()
    cos = {y: plain_vector("ein mot") @ protos[y] / np.linalg.norm(plain_vector("ein mot")) for y in protos}
    assert got.lang_pred == max(cos, key=cos.get) and abs(got.score - max(cos.values())) < 1e-5


def test_log_count_ratios_plainly(spark):
    """The model's weights are those of a hinge loss fitted on ratios that are counted text by text."""
    docs, labels = learnable(spark, insult, n=90)
    model = nbsvm.fit(docs, labels, "y", sample_rows=90)
    rows = {r.doc_id: nbsvm.features((r.text or "").encode()) for r in docs.collect()}
    y = {r.doc_id: r.y for r in labels.collect() if r.y is not None and r.doc_id in rows}
    n = np.ones((2, nbsvm.BINS))
    for i, f in rows.items():
        assert len(set(f.tolist())) == len(f)
        if i in y:
            n[y[i]][f] += 1
    total = [sum(v == c for v in y.values()) + 2 for c in (0, 1)]
    ratio = np.log(n[1] / total[1]) - np.log(n[0] / total[0])
    used = np.flatnonzero(model.weight)
    sign = {i: np.sign(model.weight[f] @ np.ones(len(f)) / np.sqrt(len(f)) + model.bias) for i, f in rows.items()}
    assert np.mean([sign[i] == (1 if y[i] else -1) for i in y]) > 0.95
    # a weight is a multiple of its ratio, so it is none where the classes have a feature alike
    assert (np.abs(ratio[used]) > 0).all()


def test_quality_learns_words(spark):
    """Texts of one shape that differ by their words only."""
    docs, labels = learnable(spark, insult)
    model = nbsvm.fit(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"), "y")
    assert accuracy(nbsvm.score(docs, model)) >= 0.9
