"""Cross-tokenizer alignment against a plain double loop over the libraries' own tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from msgrisk.llm import align
from msgrisk.llm.align import PairEncoder, align_tokens, cut_groups, linked_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, row int"
TEXTS = [
    None, "", " ", "one", "Two  spaces\n\nand lines. \n", " leading and trailing ", "日本語 😀 é\t<0x41> x <|endoftext|>", "the ▁mark", "<s> </s> <unk>",
    "a\x1cb \x1f c\r\nd  e f", "x\ny z\n w", "naïve café ﬁne ½", "repeated row", "repeated row", "don't I'LL 123 4567,89.", "\x00nul ́acute",
    "0123456789abcdef" * 30, "word " * 3000, "\n", "\n\n x", "a\n", "\t\ta b",
]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


STAND_INS = {c: k for k, c in align.TextEncoder(A).stand_ins.items()}


def spelled(text, library):
    """Tokens of a text with their bytes, or nothing."""
    if not text:
        return [], []
    a, b = library
    left = [(i, bytes(STAND_INS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def brute(texts, library):
    rows, counts = [], Counter()
    for text in texts:
        left, right = spelled(text, library)
        spans = [[], []]
        for side, tokens in enumerate((left, right)):
            at = 0
            for _, raw in tokens:
                spans[side].append((at, at + len(raw)))
                at += len(raw)
        links = [(left[i][0], right[j][0]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e] if len(left) < 500 else None
        if links is None:  # one pass for long texts
            links, j = [], 0
            for i, (s, e) in enumerate(spans[0]):
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(right) and spans[1][k][0] < e:
                    links.append((left[i][0], right[k][0]))
                    k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[0]) for t, (s, e) in zip(tokens, side) if before < e <= cut) for tokens, side in zip((left, right), spans)) if len(left) < 500 else "")
            before = cut
        rows.append((len(left), len(right), len(cuts), links, ";".join(groups)))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (a, b, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text)
        for a, b, g, links, text in rows
    ]


def test_encoder_equals_libraries(library):
    encoder = PairEncoder(A, B)
    assert encoder.chunked
    rng = np.random.default_rng(4)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "1", "　", "!!", "▁", "\x85", "日"]
    made = ["".join(alphabet[k] for k in rng.integers(0, len(alphabet), size=int(rng.integers(1, 25)))) for _ in range(1500)]
    for text in TEXTS + made:
        left, right = spelled(text, library)
        found = encoder.encode(text)
        if not left:
            assert found is None, text
        else:
            assert np.frombuffer(found[0], "<u4").tolist() == [i for i, _ in left], text
            assert np.frombuffer(found[1], "<u4").tolist() == [i for i, _ in right], text


def test_cuts_and_links_equal_plain_ones():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = [rng.integers(1, 5, size=int(rng.integers(1, 40))) for _ in range(3)]
        others = []
        for x in lengths:
            total, other = int(x.sum()), []
            while total:
                other.append(min(int(rng.integers(1, 7)), total))
                total -= other[-1]
            others.append(np.asarray(other))
        ends_a, ends_b = np.cumsum(np.concatenate(lengths)), np.cumsum(np.concatenate(others))
        first_a, first_b = (np.cumsum([0, *map(len, x)]) for x in (lengths, others))
        groups = cut_groups(ends_a, ends_b, first_a, first_b)
        assert ends_a[groups[:, 1] - 1].tolist() == sorted(set(ends_a.tolist()) & set(ends_b.tolist())) == ends_b[groups[:, 3] - 1].tolist()
        assert groups[1:, 0].tolist() == groups[:-1, 1].tolist() and groups[1:, 2].tolist() == groups[:-1, 3].tolist()
        links = set(zip(*(x.tolist() for x in linked_tokens(ends_a, ends_b))))
        starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
        assert links == {(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]}


@pytest.mark.parametrize("limit,gathered", [(align.BROADCAST_PAIRS, align.GATHERED_PAIRS), (0, 10)])
def test_operator(spark, library, monkeypatch, limit, gathered):
    monkeypatch.setattr(align, "GATHERED_PAIRS", gathered)
    docs = spark.createDataFrame([(None if i == 3 else i, t, "clash", 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    out = align_tokens(docs, A, B, with_groups=True, broadcast_pairs=limit).toPandas()
    wanted = brute(TEXTS, library)
    assert len(out) == len(TEXTS)
    for r in out.itertuples():
        i = 3 if np.isnan(r.doc_id) else int(r.doc_id)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == wanted[i][:6], TEXTS[i]
        if wanted[i][0] == 0:
            assert r.groups_sha256 == "" and (r.groups or "") == ""
        else:
            assert r.groups_sha256 == hashlib.sha256(r.groups.encode()).hexdigest()
            if r.n_a < 500:
                assert r.groups == wanted[i][6]
    assert sum(w[0] == 0 for w in wanted) >= 3 and sum(w[0] > 0 for w in wanted) >= 12


def test_edges(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert align_tokens(docs, A, B).count() == 0
    nulls = spark.createDataFrame([(1, None, "", 1), (None, "", "", 1)], SCHEMA)
    assert [tuple(r)[1:5] for r in align_tokens(nulls, A, B).collect()] == [(0, 0, 0, 0)] * 2
    with pytest.raises(ValueError):
        align_tokens(docs, A, B, keep=["doc_id", "n_a"])
