"""Alignment against a plain version that walks bytes, on odd texts and on a whole small table."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from unitloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(A), alignment.Pieces(B)


def tokens(text):
    """(id, bytes) lists of both tokenizers, by their libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "made"):
        tokens.made = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        tokens.made[0].encode_special_tokens = True
    first, second = tokens.made
    alphabet = alignment.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def brute(texts):
    """Per text: ids of a and b, groups, links, by walking the bytes."""
    out, counts = [], Counter()
    for text in texts:
        a, b = tokens(text or "")
        data = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            out.append(None)
            continue
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted(set(zip(*owner)))
        ends = [set(), set()]
        for side, found in zip((a, b), ends):
            at = 0
            for _, x in side:
                at += len(x)
                found.add(at)
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(side[k][0]) for k in sorted(set(own[start:end]))) for side, own in zip((a, b), owner)))
            start = end
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(pairs)
        out.append((len(a), len(b), len(groups), pairs, ";".join(groups)))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, pairs, groups = found
            rows.append((n_a, n_b, n_groups, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                         sha256(groups.encode()).hexdigest()))
    return rows


ODD = [
    None, "", " ", "a", "a▁b", "plain words, don't I'LL 12ab", "<|endoftext|> x <s></s>", "é́ ΣΑΣ ＡＢ 漢字 🙂", "\x00\x85\x1c　", "tabs\tand\n\nlines  ",
    "word " * 3000, "x" * 30_000, "same text here", "same text here", "ñandú über straße", "  lead", "trail  ", " nbsp", "áb", "​zero",
]


def test_odd_texts(spark, stored):
    texts = ODD * 3
    docs = stored([(i % 50 if i else None, t) for i, t in enumerate(texts)])
    found = alignment.aligned_documents(docs, A, B, slice_bytes=20_000, join_bytes=6_000)
    assert found.columns == NAMES
    expected = [(i % 50 if i else None, *row) for i, row in enumerate(brute(texts))]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r[0], *row) for r, row in zip(rows, brute([r[1] for r in rows]))]
    assert sorted(map(tuple, alignment.op13_tokenizer_alignment(spark, folder).collect())) == sorted(expected)


def test_empty_table(spark, stored):
    found = alignment.aligned_documents(stored([]), A, B)
    assert found.columns == NAMES and found.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é.,'▁<|>Ωß12\n\t\x00İ ")) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=8))
def test_ids_are_the_librarys(sides, texts):
    first, second = tokens("") and tokens.made
    assert sides[0].encode([" " + t for t in texts]).to_pylist() == [first.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert sides[1].encode(texts).to_pylist() == second.encode(texts)
    counts, pairs = alignment.align(texts, *sides)
    expected = [(i, *row) for i, row in enumerate(brute(texts)) if row[0]]
    digests = [sha256(g.encode()).hexdigest() for g in counts["groups"].to_pylist()]
    assert list(zip(*[counts[n].to_pylist() for n in ("doc", "n_a", "n_b", "n_groups", "n_links")], digests)) == [(*e[:5], e[7]) for e in expected]
