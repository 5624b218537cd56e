"""Whitening against numpy on exact integers, token alignment against sets of byte positions."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from stationcast.llm import alignment, whitening

VECTORS = "vec_id long, embedding array<float>, n int, component string"
DOCS = "doc_id long, text string, row string, a int"


def whitened(spark, rows, **kw):
    return whitening.whiten(whitening.integers(spark.createDataFrame(rows, VECTORS)), **kw).toPandas()


@pytest.mark.parametrize("far", [0.0, 5e6])
def test_whitening_equals_numpy(spark, far):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + [far, 0, -far, 1, 2, 3]
    rows = [(i, [float(x) for x in np.float32(v)], 1, "x") for i, v in enumerate(mixed)]
    rows += [(3, rows[7][1], 1, "x"), (None, rows[8][1], 1, "x")]
    broken = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0])]
    got = whitened(spark, rows + [(i, v, 0, None) for i, v in broken])
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in map(float, v)] for _, v, *_ in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    y = n * x - total
    exact = [[Fraction(int((y[:, i] * y[:, j]).sum()), n**3) for j in range(6)] for i in range(6)]
    values, vectors = np.linalg.eigh(np.array(exact, dtype=float))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (y.astype(float) / n) @ vectors / np.sqrt(values)
    assert len(got) == 6 * n and set(got.n) == {n}
    got = got.sort_values(["vec_id", "deviation", "component"], na_position="last")
    have = {}
    for r in got.itertuples():
        have.setdefault((r.vec_id if r.vec_id == r.vec_id else None, r.deviation), []).append(r)
    for (i, *_), v, w in zip(rows, y, want):
        found = have[i, int((v * v).sum())]
        for r in found:
            assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-7
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_whitening_takes_components_in_order(spark):
    rows = [(i, [float((i * k) % 17) for k in (1, 3, 5)], 0, None) for i in range(50)]
    got = whitened(spark, rows, components=2)
    assert sorted(set(got.component)) == [1, 2] and len(got) == 100
    signs = got[got.component == 1].set_index("vec_id").whitened
    assert signs.var(ddof=0) == pytest.approx(1.0)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 4])
def test_whitening_without_spread_gives_no_rows(spark, vectors):
    got = whitened(spark, [(i, v, 0, None) for i, v in enumerate(vectors)])
    assert len(got) == 0 and list(got.columns)[-1] == "identity_error"


def test_whitening_keeps_wide_values_exact(spark):
    rows = [(i, [v, 1.0, float(i)], 0, None) for i, v in enumerate([1e8, -1e8, 3.0, 1e7])]
    got = whitened(spark, rows)
    x = [[int(np.floor(64 * float(np.float32(c)))) for c in v] for _, v, *_ in rows]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(v, total)) for i, v in enumerate(x)}
    # A deviation that a long can't hold is null.
    assert {r.vec_id: r.deviation for r in got.itertuples() if r.deviation == r.deviation} == {i: w for i, w in want.items() if w < 1 << 63}


def ends_of(sizes):
    return np.cumsum(sizes).tolist()


def test_groups_and_links_equal_sets_of_bytes():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randrange(1, 60)
        mostly = rng.random()
        shared = {i for i in range(1, size) if rng.random() < mostly}
        a = sorted(shared | {i for i in range(1, size) if rng.random() < 0.2} | {size})
        b = sorted(shared | {i for i in range(1, size) if rng.random() < 0.2} | {size})
        both = sorted(set(a) & set(b))
        cut_a, cut_b = (x.tolist() for x in alignment.groups(np.array(a), np.array(b)))
        assert cut_a == [a.index(e) + 1 for e in both] and cut_b == [b.index(e) + 1 for e in both]
        spans = [[range(s, e) for s, e in zip([0, *x], x)] for x in (a, b)]
        want = {(i, j) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if set(p) & set(q)}
        i, j = alignment.links(np.array(a), np.array(b))
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def brute_force(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, held = [], Counter()
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        b = second.encode(text or "")
        spelled = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, second.id_to_piece(b))]
        if not text or b"".join(spelled) != (" " + text).encode():
            rows.append(None)
            continue
        # A byte-level token has one character a byte.
        sizes = [len(t) for t in a.tokens]
        ends_a, ends_b = ends_of(sizes), ends_of([len(s) for s in spelled])
        cover_a = [i for i, n in enumerate(sizes) for _ in range(n)]
        cover_b = [j for j, s in enumerate(spelled) for _ in s]
        links = sorted(set(zip(cover_a, cover_b)))
        both = sorted(set(ends_a) & set(ends_b))
        groups = []
        for s, e in zip([0, *both], both):
            groups.append((sorted({cover_a[k] for k in range(s, e)}), sorted({cover_b[k] for k in range(s, e)})))
        written = ";".join(",".join(str(a.ids[i]) for i in p) + "|" + ",".join(str(b[j]) for j in q) for p, q in groups)
        rows.append((len(a.ids), len(b), len(groups), [(a.ids[i], b[j]) for i, j in links], hashlib.sha256(written.encode()).hexdigest()))
        held.update(set(rows[-1][3]))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            pairs = r[3]
            out.append((r[0], r[1], r[2], len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), r[4]))
    return out


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "the  double   spaces\tand\nlines ", " leading", "naïve café – 日本語 emoji 🎉🎉", "a▁b has the mark itself",
    "<s> </s> <unk> <0x41> <|endoftext|> are plain", "x", " ", "\x00 nul", "", None, "word " * 3000, "unbrokenlongword" * 500, "The quick brown fox jumps over the lazy dog.",
    "zahlen 1234567890 und §§ Äöü ß", "The lazy dog sleeps.",
]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_alignment_equals_brute_force(spark, frequent):
    rng = random.Random(2)
    words = "the of and in das ist un été niño über 42 don't thing-like ing ed …".split()
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    how = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(spark, docs, *how, frequent=frequent).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_force(texts)):
        assert got[i if i != 4 else None] == want, (i, texts[i])


def test_alignment_of_nothing(spark):
    how = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert alignment.align(spark, spark.createDataFrame([], DOCS), *how).collect() == []
    got = alignment.align(spark, spark.createDataFrame([(1, None, "", 0), (1, "", "", 0)], DOCS), *how).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_compares_whole_parts_with_what_tokens_spell():
    spelling = alignment._Spelling([b"a", b"", b"bc", b"\xe2\x82", b"\xac"])
    ids, counts = alignment._flat([[0, 2], [], [3, 4, 1], [2, 0], [0], []])
    assert counts.tolist() == [2, 0, 3, 2, 1, 0]
    found = spelling(ids, counts, [b"abc", b"", "€".encode(), b"abc", b"ab", b"a"])
    assert found.tolist() == [True, True, True, False, False, False]


def test_alignment_tokens_equal_the_library_with_special_strings_as_text():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    texts = ["a", "  two  spaces ", "line\n\nbreak \n end\t", "x<|endoftext|> y  <|endoftext|>z", "naïve Σς ǅ İ ࢏", "日本語 🙂", "don't I'M", "x" * 300, "ab " * 50]
    ids, counts = alignment.byte_tokens(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    wanted = [lib.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_words_encoded_alone_equal_the_library_on_whole_texts(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(3)
    model, tokens = SentencePieceProcessor(model_file=path), alignment.piece_tokens(path)
    seen = []
    monkeypatch.setattr(SentencePieceProcessor, "Encode", lambda self, words, f=SentencePieceProcessor.Encode, **k: (seen.append(words), f(self, words, **k))[1])
    monkeypatch.setattr(SentencePieceProcessor, "encode", SentencePieceProcessor.Encode)
    monkeypatch.setattr(alignment, "PIECES", 20)
    parts = [" ", "  ", "▁", "a", "b", "the", "\n", "\0", "é", "日本", "<s>", "<0x0A>", "\u3000", "\ufb01", "!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2000)] + ["", " ", "  ", "a ", " a", "▁"]
    for some in (texts, texts[:30], [""], []):
        ids, counts = tokens.encode(some)
        want = [model.Encode(t) for t in some]
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    # A word that recurs in a part, or is kept from an earlier one, is not encoded again.
    seen.clear()
    for _ in range(2):
        assert tokens.encode(["the house the house"] * 5)[1].tolist() == [4] * 5
    assert [sorted(x) for x in seen] in ([["house", "the"], []], [["house"], []])
