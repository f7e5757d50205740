"""Exact, substring, line and near-duplicate operators against brute force, with odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from unitloom.llm import block_naming, components, jaccard, line_dedup, substring_dedup
from unitloom.llm.common import ROW, join_by_row, with_row_key
from unitloom.session import cut_lineage

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "same text here"), (4, "Same Text Here"), (4, "same text here"), (9, "É"), (10, "é"),
       (11, "x" * 20_000), (12, "x" * 20_000), (12, "x" * 20_000), (13, "x" * 19_999 + "y"), (14, "one"), (15, "one\ntwo\x00")]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("block_bytes, route", [(4096, F.xxhash64), (7, lambda block: F.length(block).cast("long"))])
def test_exact_dedup(spark, stored, block_bytes, route):
    rng = random.Random(3)
    rows = ODD + [(100 + i, "".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(120)]
    found = block_naming.exact_dedup(stored(rows), block_bytes=block_bytes, route=route).collect()
    assert len(found) == len(rows)
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    wanted = sorted((str(doc), str(max((d for d in groups[lowered(t)] if d is not None), default=None)), len(groups[lowered(t)]),
                     hashlib.sha256(lowered(t).encode()).hexdigest()) for doc, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == wanted
    assert sum(r.kept for r in found) == len(groups) and all(r.doc_id == r.keep_id for r in found if r.kept)


def test_dropping_copies_keeps_all_columns(spark, stored):
    docs = stored(ODD)
    kept = block_naming.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({lowered(t) for _, t in ODD})
    assert block_naming.exact_dedup(docs.limit(0)).collect() == []


def brute_substrings(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    rank = [-(1 << 63) if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(rank, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (doc, _), d, w in zip(rows, rank, words):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for j in range(i, i + window)}
        out.append((str(doc), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("window, batch_bytes, arrow_rows", [(13, 1 << 24, "10000"), (8, 200, "3")])
def test_substring_dedup(spark, stored, monkeypatch, window, batch_bytes, arrow_rows):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch_bytes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        rng = random.Random(window)
        passages = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 40))) for _ in range(12)]
        rows = list(ODD)
        for i in range(90):
            parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(12)))
                     for _ in range(rng.randrange(6))]
            rows.append((rng.randrange(60), " \n".join(parts)))
        found = substring_dedup.substring_dedup(stored(rows), window=window).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == brute_substrings(rows, window)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cover_holds_every_difference():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def test_streams_cut_anywhere():
    import pyarrow as pa
    rng = random.Random(5)
    rows = sorted((rng.randrange(6), rng.randrange(1000), False) for _ in range(60))
    for size in (1, 2, 3, 60):
        batches = [pa.RecordBatch.from_arrays([*map(pa.array, zip(*part))], names=["h", "row", "known"])
                   for part in (rows[i:i + size] for i in range(0, len(rows), size))]
        found = sorted((h, r) for b in substring_dedup._shared_anchors(iter(batches)) for r, h in zip(*(c.to_pylist() for c in b.columns)))
        counts = {h: sum(x[0] == h for x in rows) for h in range(6)}
        assert found == sorted((h, r) for h, r, _ in rows if counts[h] > 1)
        pairs = [(s, a, b) for out in jaccard._stars(iter(
            pa.RecordBatch.from_arrays([pa.array([0] * len(part)), pa.array([x[0] for x in part]), pa.array([-1] * len(part)), pa.array([x[1] for x in part])],
                                       names=["route", "sig", "hub", "row"]) for part in (rows[i:i + size] for i in range(0, len(rows), size))))
            for s, a, b in zip(*(c.to_pylist() for c in out.columns))]
        assert sorted(pairs) == sorted((h, min(x[1] for x in rows if x[0] == h), r) for k, (h, r, _) in enumerate(rows) if k and rows[k - 1][0] == h)


def brute_components(rows, words, similar):
    sets = [jaccard.shingles(jaccard.words_of(t or ""), words) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]), str(min((d for d in members[root(i)] if d is not None), default=None))) for i in range(len(rows)))


@pytest.mark.parametrize("words, similar, arrow_rows", [(4, 85, "10000"), (5, 80, "4")])
def test_jaccard_join(spark, stored, words, similar, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        rng = random.Random(words)
        rows = list(ODD)
        for base in range(9):
            text = [f"w{rng.randrange(30)}" for _ in range(rng.choice([3, 8, 20, 60, 150]))]
            for copy in range(14):
                varied = [f"v{rng.randrange(9)}" if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in text]
                rows.append((rng.randrange(500), " ".join(varied + [f"t{k}" for k in range(rng.randrange(3))])))
        found = jaccard.jaccard_components(stored(rows), words=words, similar=similar).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_components(rows, words, similar)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=60, deadline=None)
@given(st.integers(8, 400), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10 ** 6), st.sampled_from([80, 85, 90]))
def test_similar_sets_always_share_a_signature(size, added, lost, seed, similar):
    rng = np.random.default_rng(seed)
    every = np.unique(rng.integers(0, 1 << 63, size + added, dtype=np.uint64))
    a, b = np.sort(every[:size]), np.sort(every[min(lost, size - 1):])
    both = len(np.intersect1d(a, b))
    bands = jaccard.Bands(similar, top=600)
    bands.allocate({band: 10 ** 9 for band in range(40)} if seed % 2 else {})
    if 100 * both >= similar * (len(a) + len(b) - both) and len(a) != both or len(b) != both and 100 * both >= similar * (len(a) + len(b) - both):
        assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_bit_parallel_distance_and_shared_keys(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        x = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 30)))
        y = list(x)
        for _ in range(rng.randrange(edits + 2)):
            i, kind = rng.randrange(len(y) + 1), rng.randrange(3)
            y[i:i + (kind > 0)] = [] if kind == 1 else [rng.choice("abcé")]
        pairs.append((x, "".join(y) or "a"))
    keys = [line_dedup.segment_keys(F.col(c), edits, 4).alias(f"k{c}") for c in "xy"]
    for r in spark.createDataFrame(pairs, "x string, y string").select(
            "x", "y", line_dedup.near(F.col("x"), F.col("y"), edits).alias("near"), *keys).collect():
        close = edit_distance(r.x, r.y) <= edits
        assert r.near == close, (r.x, r.y)
        if close and r.x != r.y and min(len(r.x), len(r.y)) >= 4:
            assert set(r.kx) & set(r.ky), (r.x, r.y)


def brute_lines(rows, edits, least):
    # stored rows with one id apiece, so that order is by id and position
    firsts = {}
    for doc, text in rows:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if line and (line not in firsts or (doc, pos) < firsts[line]):
                firsts[line] = (doc, pos)
    label = {line: line for line in firsts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    lines = sorted(firsts)
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits:
                label[root(x)] = root(y)
    begun = {}
    for line in lines:
        begun[root(line)] = min(begun.get(root(line), (firsts[line], line)), (firsts[line], line))
    out = []
    for doc, text in rows:
        parts = text.split("\n") if text is not None else []
        gone = [p for p, line in enumerate(parts) if line and (doc, p) > begun[root(line)][0]]
        out.append((doc, len(parts), sum(begun[root(parts[p])][1] != parts[p] for p in gone), gone))
    return sorted(out)


def test_line_dedup(spark, stored):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(3, 60))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([None, "", "\n", "a\n\na", "é\n" * 5])]
    for doc in range(5, 25):
        lines = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice("abcdefg")
            lines.append("".join(line))
        rows.append((doc, "\n".join(lines)))
    docs = stored(rows)
    found = line_dedup.line_dedup(docs, edits=2, least_chars=8).collect()
    wanted = brute_lines(rows, 2, 8)
    assert sorted((r.doc_id, r.n_lines, r.n_near, r.removed) for r in found) == wanted
    kept = {r.doc_id: r.text for r in line_dedup.deduped(docs, edits=2, least_chars=8).collect()}
    for doc, text in rows:
        gone = next(w[3] for w in wanted if w[0] == doc)
        assert kept[doc] == (text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    assert line_dedup.deduped(docs, edits=2, least_chars=8).columns == docs.columns


def test_odd_rows_do_not_break_line_dedup(spark, stored):
    docs = stored(ODD)
    assert line_dedup.line_dedup(docs).count() == len(ODD)
    plan = docs.select(line_dedup.near(F.col("text"), F.col("text"), 2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    for empty in (line_dedup.line_dedup, substring_dedup.substring_dedup, jaccard.jaccard_components):
        assert empty(docs.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(30)) and found[300] == 200
    assert ROW not in found


def test_row_keys_do_not_depend_on_splits(spark, stored):
    docs = stored([(i, f"text {i}") for i in range(60)] + [(None, None)])
    keys = [{r[ROW]: r.text for r in with_row_key(docs, F.col("text")).collect()}]
    rows = cut_lineage(with_row_key(docs, F.col("text").alias("own")), "rows")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        again = spark.read.parquet(*docs.inputFiles())
        keys += [{r[ROW]: r.text for r in with_row_key(table, F.col("text")).collect()} for table in (docs.select("*"), again)]
        met = join_by_row(docs, rows, "inner").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(keys[0]) == 61 and keys[0] == keys[1] == keys[2]
    assert len(met) == 61 and all(r.text == r.own for r in met)


def test_copies_in_a_batch_are_sent_on_once(spark, stored):
    docs = stored([(i, " ".join(f"w{k}" for k in range(40))) for i in range(20)], files=1)
    assert jaccard.buckets(docs, "doc_id", "text", 4, jaccard.Bands(top=40)).count() == 0


@pytest.mark.parametrize("words, similar", [(4, 85), (5, 80), (1, 50)])
def test_rare_shingles_find_all_similar_pairs_and_no_group_by_a_shared_passage(spark, stored, words, similar):
    rng = random.Random(words)
    passage, texts = [f"p{i}" for i in range(60)], []
    for i in range(40):  # a passage and words of its own: too many to be similar, or nearly so
        texts.append(" ".join(passage + [f"u{i}x{j}" for j in range(rng.choice((60, 90)))]))
    for i in range(25):  # changed copies, which are similar or just not
        body = [f"c{i % 3}y{j}" for j in range(rng.choice((20, 50, 100)))]
        for _ in range(rng.randrange(6)):
            body[rng.randrange(len(body))] = f"n{rng.random()}"
        texts.append(" ".join(body[:rng.randrange(len(body) - 8, len(body) + 1)]))
    docs = stored(list(enumerate(texts)))
    nodes = jaccard.shingle_sets(docs, "doc_id", "text", words).collect()
    ids, sizes = {row[ROW]: row["doc_id"] for row in nodes}, {row[ROW]: row["n"] for row in nodes}
    apart = spark.createDataFrame([(key, sizes[key], key) for key in ids], "rep long, n long, component long")
    found = {frozenset((ids[a], ids[b])) for a, b in jaccard._rare(
        apart, docs, "doc_id", "text", words, jaccard.Bands(similar, top=max(sizes.values()))).collect()}
    sets = [jaccard.shingles(jaccard.words_of(text), words) for text in texts]
    linked = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])}
    assert linked and linked <= found
    if similar > 50:
        assert not any(max(pair) < 40 for pair in found)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900), st.integers(0, 60), st.integers(0, 700), st.integers(0, 10 ** 6))
def test_sketches_differ_in_no_more_bits_than_sets_in_elements(size, lost, added, seed):
    pool = np.unique(np.random.default_rng(seed).integers(0, 2 ** 64, size + added, dtype=np.uint64))
    a, b = pool[:size], pool[min(lost, size - 1):]
    one, two = jaccard.sketch(a), jaccard.sketch(b)
    for bits in (256, 8 * min(len(one), len(two))):
        assert (jaccard.folded(one, bits) ^ jaccard.folded(two, bits)).bit_count() <= len(np.setxor1d(a, b))
        longer = max((a, b), key=len)
        assert jaccard.folded(jaccard.sketch(longer), bits) == sum(1 << i for i in range(bits) if np.count_nonzero(longer % np.uint64(bits) == i) % 2)


@pytest.mark.parametrize("similar", [80, 85])
def test_pairs_far_apart_move_no_texts(spark, stored, similar):
    rng = random.Random(similar)
    texts = []
    for i in range(30):  # of one text, with more and more words changed
        body = [f"w{j}" for j in range(400)]
        for j in rng.sample(range(400), i):
            body[j] = f"n{i}x{j}"
        texts.append(" ".join(body * (1 + i % 2) if i > 25 else body))
    nodes = jaccard.shingle_sets(stored(list(enumerate(texts)), files=1), "doc_id", "text", 4)
    ids = {row[ROW]: row["doc_id"] for row in nodes.collect()}
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
    kept = {frozenset((ids[r.a], ids[r.b])) for r in jaccard.may_be_similar(pairs, nodes, similar).collect()}
    sets = [jaccard.shingles(jaccard.words_of(text), 4) for text in texts]
    linked = {frozenset((i, j)) for i in range(30) for j in range(i) if 100 * len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])}
    assert linked and linked <= kept and len(kept) < len(linked) + 0.5 * (435 - len(linked))


@pytest.mark.parametrize("n", [1, 4, 5])
def test_texts_hashed_together_have_their_own_shingles(n, monkeypatch):
    rng = random.Random(n)
    bodies = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(40))) for _ in range(60)] + ["", " \n", "one"]
    for at_once in (1, 30, 50_000):
        monkeypatch.setattr(jaccard, "WORDS_AT_ONCE", at_once)
        found = list(jaccard.all_shingle_hashes(bodies, n))
        assert len(found) == len(bodies)
        assert all(np.array_equal(h, jaccard.shingle_hashes(jaccard.words_of(t), n)) for h, t in zip(found, bodies))


@pytest.mark.parametrize("edits", [1, 2])
def test_near_lines_pass_what_is_tested_before_they_are_compared(spark, edits):
    rng = random.Random(40 + edits)
    pairs = []
    for _ in range(400):
        x = "".join(rng.choice("abcé😀漢") for _ in range(rng.randrange(1, 60)))
        y = list(x)
        for _ in range(rng.randrange(edits + 1)):
            i, kind = rng.randrange(len(y) + 1), rng.randrange(3)
            y[i:i + (kind > 0)] = [] if kind == 1 else [rng.choice("abcé😀漢")]
        pairs.append((x, "".join(y) or "a"))
    x, y = F.col("x"), F.col("y")
    told = spark.createDataFrame(pairs, "x string, y string").select(
        "x", "y", line_dedup.mostly_shared(line_dedup.wide(x), line_dedup.wide(y), F.length(x), F.length(y), edits).alias("shared"),
        line_dedup.parities(x).alias("px"), line_dedup.parities(y).alias("py"))
    for r in told.collect():
        ones, twos = ((r.px[c] ^ r.py[c]) & (2 ** 64 - 1) for c in ("ones", "twos"))
        if edit_distance(r.x, r.y) <= edits:
            assert r.shared and ones.bit_count() <= 2 * edits and twos.bit_count() <= 4 * edits, (r.x, r.y)


@pytest.mark.parametrize("edits", [1, 2])
def test_keys_by_rows_are_those_of_a_line(spark, edits):
    rng = random.Random(edits)
    lines = spark.createDataFrame([("".join(rng.choice("ab") for _ in range(n)),) for n in range(40)], "line string")
    wanted = {r.line: set(r.k) for r in lines.select("line", line_dedup.segment_keys(F.col("line"), edits, 4).alias("k")).collect()}
    told = lines.select(F.col("line").alias("k1"), F.length("line").alias("chars"), line_dedup.wide(F.col("line")).alias("wide"))
    found: dict = {line: set() for line in wanted}
    for r in line_dedup.keys_of(told, edits, 4).collect():
        found[r.k1].add(r.key)
    assert found == wanted and any(wanted.values())


def test_lines_that_share_a_part_and_nothing_else_are_not_paired(spark, stored, monkeypatch):
    rng = random.Random(3)
    part = "the same beginning of all lines, "
    rest = ["".join(rng.choice("abcdefghijklmnop") for _ in range(66)) for _ in range(40)]
    texts = [part + line for line in rest] + [part + rest[0][:-1] + "z", part + rest[7][1:]]
    compared, whole = [], line_dedup._apart

    def counted(pairs, texts, edits):
        compared.append(pairs.count())
        return whole(pairs, texts, edits)
    monkeypatch.setattr(line_dedup, "_apart", counted)
    rows = list(enumerate(texts))
    found = line_dedup.line_dedup(stored(rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_near, r.removed) for r in found) == brute_lines(rows, 2, 20)
    # a line with the first one of each key, and of 861 pairs next to none across classes
    assert sum(compared) < 150, compared


def test_sets_keyed_together_have_their_own_subsets():
    rng = random.Random(11)
    pool = np.random.default_rng(1).integers(0, 2 ** 64, 3000, dtype=np.uint64)
    sets = [np.sort(pool[rng.sample(range(len(pool)), rng.choice((1, 2, 3, 7, 30, 200, 900)))]) for _ in range(60)]
    for similar, weight in ((85, 0), (85, 10 ** 7), (60, 10 ** 9)):
        bands = jaccard.Bands(similar, top=900)
        bands.allocate(dict.fromkeys(range(len(bands.plans)), weight))
        found: dict = {}
        for keys, places in bands.signatures_of(sets):
            for key, place in zip(keys.tolist(), places.tolist()):
                found.setdefault(place, set()).add(key)
        assert all(found.get(i, set()) == set(bands.signatures(one).tolist()) for i, one in enumerate(sets))


def test_words_hashed_together_are_told_apart():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"ab\0") for _ in range(size)) for size in (*range(1, 20), 63, 64, 65, 200) for _ in range(20)}
    texts = [b"", b" \t", *words, b"\x0b".join(words), "\u0085  x".encode()]
    hashes, counts = jaccard.word_hashes(texts)
    assert counts.tolist() == [len(text.split()) for text in texts]
    assert len(set(hashes.tolist())) == len(words) + 2
    assert hashes[:len(words)].tolist() == hashes[len(words):2 * len(words)].tolist()
    assert jaccard.word_hashes([b"ABC Zz"])[0].tolist() == jaccard.word_hashes([b"abc zZ"])[0].tolist()
