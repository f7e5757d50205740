"""Toxicity, tokenizing, packing, sanitisation and the pipeline: brute force, round trips, odd inputs."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from unitloom.llm import packing, pieces, sanitise, toxicity
from unitloom.llm.chunk_table import ChunkTable
from unitloom.llm.common import ROW

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "same text here"), (4, "Same Text Here"), (4, "same text here"), (9, "É  é́ ΣΑΣ"),
       (11, "x" * 30_000), (12, "word " * 6000), (14, "<|startoftext|>a <|endoftext|> don't I'LL 12ab"), (15, "a▁b\x00\x85c\x1cd　e"), (16, "  a  b ")]
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
CORPUS = st.lists(st.text(alphabet=st.sampled_from(list("ab é.,'▁<|>Ωß12\n\t\x00")) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=12)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PIECES)


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(WORDS)


def lists(flat, counts):
    ends = np.cumsum(counts)
    return [flat[end - n:end].tolist() for end, n in zip(ends, counts)]


@settings(max_examples=60, deadline=None)
@given(CORPUS)
def test_pieces_are_the_librarys(codec, texts):
    assert codec.chunked
    flat, counts = codec.encode(texts)
    assert lists(flat, counts) == codec.model.encode(texts, add_eos=True)
    assert codec.decode(flat, counts) == [codec.model.decode(ids) for ids in lists(flat, counts)]


@settings(max_examples=60, deadline=None)
@given(CORPUS)
def test_words_are_the_librarys(encoder, texts):
    assert encoder.by_cut
    flat, counts = encoder.encode(texts)
    assert lists(flat, counts) == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_are_the_librarys(codec, encoder):
    texts = [text or "" for _, text in ODD]
    assert lists(*codec.encode(texts)) == codec.model.encode(texts, add_eos=True)
    assert lists(*encoder.encode(texts)) == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_full_table_starts_anew():
    table = ChunkTable(lambda chunks: [[len(c), 7] for c in chunks], most=3)
    for _ in range(3):
        flat, counts = table.encode([["a", "bb", "a"], [], ["ccc", "dddd", "e"]])
        assert flat.tolist() == [1, 7, 2, 7, 1, 7, 3, 7, 4, 7, 1, 7] and counts.tolist() == [6, 0, 6]
        assert len(table.places) <= 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_and_bounds(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit_decreasing(lengths, 20)
    for b in set(bins.tolist()):
        own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 20
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
    assert bound <= len(set(bins.tolist())) and bound >= -(-int(lengths.sum()) // 20)


def test_bound_counts_pieces_that_cannot_share():
    counts = np.zeros(21, np.int64)
    counts[11], counts[7] = 5, 3
    assert packing.lower_bound(counts, 20) == 5
    counts[7], counts[10] = 0, 3
    assert packing.lower_bound(counts, 20) == 7


def test_packing_in_parts(spark, stored, encoder):
    rng = random.Random(2)
    rows = ODD + [(100 + i, " ".join(rng.choice(["apple", "pear", "Zebra!", "x9"]) for _ in range(rng.randrange(1, 90)))) for i in range(150)]
    docs = stored(rows)
    made = packing.cut_lineage(
        packing.pieces_of(docs, WORDS, capacity=64, with_ids=True))
    out = made.join(packing.pack(made, 64, part_pieces=40), [ROW, "piece"]).collect()
    own, places = {}, {}
    for r in out:
        own.setdefault(r[ROW], []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    texts = []
    for parts in own.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [64 * i for i in range(len(parts))]
        texts.append([i for r in parts for i in r.ids])
    wanted = [e.ids + [0] for e in encoder.tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert sorted(texts) == sorted(wanted)
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64
    counts = np.bincount([r.length for r in out], minlength=65)
    assert len(places) <= packing.lower_bound(counts, 64) * 1.02 + 1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) < 256 for x in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[name]():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans(spark, stored):
    rng = random.Random(4)
    alphabet = ["a", ".", "@", "b-c", "1", "0", "255", "256", "4111 1111 1111 1111", "+49 (30) 123-456", "é", " ", "\n", "x@y.z", "_", "-", "+", "10.0.0.1", "😀"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))) for i in range(250)] + [(900, None), (901, "a" * 30000 + "@"), (902, "9" * 30000),
             (903, "1 2-" * 20000), (904, "a@b" + ".c" * 20000), (905, "a@b" + ".c" * 9 + "..d@e.f\ue000@x.y \ue000 a.@b.c. +1" + "(2" * 9000)]
    out = sanitise.personal_spans(stored(rows), least_surroundings=10 ** 6).collect()
    found = {r.doc_id: [(s.start, s.kind, s.stop) for s in r.base] for r in out}
    assert found == {doc: brute_spans(text or "") for doc, text in rows}


def test_terms_that_disclose_are_taken_out(spark, stored):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    rows = [(i, f"{word()} {word()} zaphod {word()} write zaphod@ship.org {word()} {word()}") for i in range(8)]
    rows += [(100 + i, f"{word()} write {word()} someone{i}@else.org write {word()}") for i in range(120)] + [(500, "zaphod alone"), (501, None)]
    docs = stored(rows)
    out = {r.doc_id: r for r in sanitise.personal_spans(docs).collect()}
    for doc, text in rows[:8]:
        assert [(t.start, t.stop) for t in out[doc].terms] == [(text.index("zaphod"), text.index("zaphod") + 6)]
    assert all(not r.terms for doc, r in out.items() if doc >= 100)
    clean = {r.doc_id: r.text for r in sanitise.sanitised(docs).collect()}
    assert "[TERM] " in clean[0] and "[EMAIL]" in clean[0] and "zaphod" not in clean[0]
    assert clean[500] == "zaphod alone" and clean[501] is None and sanitise.sanitised(docs).columns == docs.columns
    assert sanitise.sanitised(docs.limit(0)).collect() == []


def test_label_model_finds_classes_without_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.2
    votes = np.column_stack([rng.random(3000) < np.where(truth, hit, 0.01) for hit in (0.6, 0.5, 0.7, 0.4)] + [np.zeros(3000, bool)])
    votes[:, 4] = votes[:, 0]
    posterior = toxicity.label_model(votes.astype(float), np.where(rng.random(3000) < 0.3, 1 - truth, truth).astype(float))
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_toxicity_on_held_out_rows(spark, stored):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[3], words[17], words[30] = "idiot", rng.choice(["zorgon", "zorgul", "zorgix"]), "scum"
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    docs = stored(rows + [(2000, None), (2001, ""), (None, "you idiot scum idiot")])
    gold = spark.createDataFrame(labels + [(None, 0, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, gold)).collect()}
    assert all((out[i] >= 0.7) == bool(t) for i, _, t in labels) and out[None] >= 0.7 and out[2000] == out[2001] < 0.7
    assert {r.doc_id for r in toxicity.drop_toxic(docs, gold).collect()} == {i for i, _, t in labels if not t} | {2000, 2001}
    assert toxicity.drop_toxic(docs, gold).columns == docs.columns
    for empty in (gold.limit(0), gold.where("toxic = 0")):
        assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, empty)).collect()} == {0.0}


def test_pipeline_stages(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " tail"), (3, base.upper()), (4, "mail me at a@b.org"), (5, None), (6, ""), (7, None), (7, "other words entirely"),
            (None, "nothing here either")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row_key string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet" if not seen else tmp_path / f"s{len(seen)}")), str(tmp_path))
        seen[name] = docs.columns
        docs.write.parquet(str(tmp_path / f"s{len(seen)}"))
    assert len({tuple(c) for c in list(seen.values())[:-1]}) == 1
    kept = spark.read.parquet(str(tmp_path / "s4")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted(
        [("2", base + " tail"), ("4", "mail me at [EMAIL]"), ("7", ""), ("7", "other words entirely"), ("None", "nothing here either")])
    assert sorted(str(r.doc_id) for r in spark.read.parquet(str(tmp_path / "s5")).collect()) == ["2", "4", "7", "7", "None"]


def test_near_copies_are_dropped_by_component_not_by_id(spark, stored):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (3, text("c")), (3, text("d")), (4, text("d") + " more"), (3, text("e")), (None, text("e") + " more"),
            (3, None), (None, "")]
    kept = corpus_pipeline.drop_near_copies(spark, stored(rows), "").collect()
    # a null id is smaller than any other
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted(
        (str(d), t or "") for d, t in rows if d != 4 and t != text("e"))


def test_frequent_words_vote_and_copies_count_once(spark, stored):
    # "you zorgon" in 200 toxic texts, always after the same word, and in 2 clean ones; copies of another in one text
    rows = [(i, f"a{i} you zorgon") for i in range(200)] + [(1000 + i, "copied blarg") for i in range(50)]
    rows += [(2000 + i, f"c{i} you there") for i in range(1798)] + [(4000 + i, f"d{i} you zorgon") for i in range(2)]
    gold = spark.createDataFrame([(i, 0, int(i < 2000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = stored(rows)
    sample = docs.join(gold, "doc_id").select("text", "toxic")
    counted, toxic, clean = toxicity.count_units(sample)
    found = {r.unit: (r.toxic, r.clean) for r in counted.collect()}
    assert (toxic, clean) == (201, 1800) and found["w:zorgon"] == (200, 2) and found["w:blarg"] == (1, 0)
    model = toxicity.fit(docs, gold)
    assert "zorgon" in model.lexicon and "blarg" not in model.lexicon


def test_disclosing_terms_anywhere_in_the_document(spark, stored):
    far = " filler" * 40
    rows = [(i, f"user42{far} one{i} write zaphod@ship.org two{i}{far} User42") for i in range(4)]
    # copies are one text, so their terms have no support
    rows += [(50 + i, f"lonely words and me@copy.org{far}") for i in range(6)]
    rows += [(100 + i, f"write{far} someone{i}@else.org and words{i}") for i in range(300)]
    out = {r.doc_id: r.terms for r in sanitise.personal_spans(stored(rows)).collect()}
    for doc, text in rows[:4]:
        assert [(t.start, t.stop, t.removed) for t in out[doc]] == [(0, 6, True), (len(text) - 6, len(text), True)]
    assert not any(out[doc] for doc, _ in rows[4:])


@pytest.mark.parametrize("lengths", [(1032, 528, 520, 496), tuple(range(520, 1021, 7)), (1025,), (683, 1)])
def test_hard_lengths_come_to_an_end(spark, stored, lengths):
    """Lengths that never fill a bin: rounds end, ids are distinct, and few bins more are used than by one run over all."""
    rows = [(i, 0, lengths[i % len(lengths)]) for i in range(4000)]
    pieces = stored(rows, f"{ROW} long, piece int, length long")
    found = packing.pack(pieces, part_pieces=800).join(pieces, [ROW, "piece"]).select(ROW, "sequence_id", "offset", "length").collect()
    assert sorted(r[ROW] for r in found) == list(range(4000))
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    whole, _ = packing.best_fit_decreasing(np.array([length for _, _, length in rows]))
    assert len(bins) <= 1.01 * (whole.max() + 1) + 5


def test_packing_of_a_whole_table(spark):
    """The query against the library's own ids: every piece, its place and its checksum."""
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    expected = {}
    for doc_id, text in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start:start + 2048], "<u4")
            expected[doc_id, piece] = (start, len(own), zlib.crc32(own.tobytes()))
    found = packing.op9_bestfit_packing(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([length for _, length in sorted(held)])
        assert [offset for offset, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    counts = np.bincount([length for _, length, _ in expected.values()], minlength=2049)
    assert packing.lower_bound(counts) <= len(bins) <= packing.best_fit_decreasing(np.repeat(np.arange(2049), counts))[0].max() + 1
    empty = packing.packed_documents(spark.read.parquet(f"{folder}/documents.parquet").where("false"), WORDS)
    assert empty.count() == 0


def test_pieces_of_a_whole_table(spark, stored):
    """The query's ids and texts against the library's, on a table and on odd rows: nulls, repeats, clashing columns, no rows."""
    from hashlib import sha256

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    folder = "/root/testdata/sf0.001"
    found = pieces.op7_sentencepiece(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = []
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = model.encode(row["text"] or "", add_eos=True)
        digests = [sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), model.decode(ids))]
        expected.append((row["doc_id"], len(ids), *digests))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    odd = pieces.encoded(stored(ODD), PIECES, texts_at_once=3)
    wanted = [(i, model.encode(t or "", add_eos=True)) for i, t in ODD]
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in odd.collect()), key=repr) == sorted(
        ((i, ids, model.decode(ids)) for i, ids in wanted), key=repr)
    assert pieces.encoded(stored([]), PIECES).count() == 0


def test_many_addresses_in_one_text(spark, stored):
    """A text of 100,000 addresses: places are right and the time does not grow with the square of their number."""
    import time

    body = " ".join(f"1.2.{i % 200}.{i % 250}" for i in range(100_000))
    docs = stored([(1, body), (2, "a@b.cc " * 700), (3, "1.2.3.4")])
    start = time.monotonic()
    out = {r.doc_id: [(s.start, s.stop) for s in r.base] for r in sanitise.personal_spans(docs, least_surroundings=10 ** 6).collect()}
    assert time.monotonic() - start < 120
    assert out[1] == [m.span() for m in re.finditer(r"[0-9.]+", body)]
    assert out[2] == [(7 * i, 7 * i + 6) for i in range(700)] and out[3] == [(0, 7)]


def test_disclosures_are_those_of_a_plain_count(spark, stored):
    """The rule counted in plain Python over distinct texts: same pairs, whatever is cut before pairs are made."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    people = [f"user{i}@mail.org" for i in range(9)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, k=8))
        if i % 3 == 0:
            person = rng.choice(people)
            text += f" {person} nick{person[4]} {'often' if rng.random() < 0.5 else ''} rare{rng.randrange(30)}"
        rows.append((i, text))
    rows += rows[:40]  # copies count once
    texts = {text for _, text in rows}
    entities = {t: set(re.findall(r"user[0-9]@mail\.org", t)) for t in texts}
    terms = {t: set(re.findall(r"\w{2,}", t.lower())) for t in texts}
    holders, held, both = {}, {}, {}
    for t in texts:
        for e in entities[t]:
            holders[e] = holders.get(e, 0) + 1
        for w in terms[t]:
            held[w] = held.get(w, 0) + 1
            for e in entities[t]:
                both[e, w] = both.get((e, w), 0) + 1
    total, bar = len(texts), np.log2(len(holders) * len(held))
    wanted = set()
    for (e, w), n in both.items():
        given, base = n / held[w], holders[e] / total
        gain = np.log2(given / base)
        other = (1 - given) * np.log2((1 - given) / (1 - base)) if given < 1 else 0
        if n >= 2 and holders[e] >= 2 and given >= 0.5 and gain >= 3 and held[w] * (given * gain + other) >= bar:
            wanted.add((e, w))
    assert {w for _, w in wanted} >= {"nick1", "nick8"}
    docs = stored(rows)
    out = {r.doc_id: {(t.start, t.stop) for t in r.terms} for r in sanitise.personal_spans(docs).collect() if r.doc_id >= 0}
    for i, text in rows:
        covered = [m.span() for m in re.finditer(r"user[0-9]@mail\.org", text)]
        expected = {m.span() for m in re.finditer(r"\w{2,}", text) if any((e, m.group().lower()) in wanted for e in entities[text])
                    and not any(m.start() < b and m.end() > a for a, b in covered)}
        assert out[i] == expected
