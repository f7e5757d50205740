"""N-gram Jaccard join by universe partitioning.

Two sets with a Jaccard similarity of at least s/100 differ in no more than H elements, H growing
with their sizes.  Sets are banded by size; in a band the universe of shingles is hashed into
segments.  Each segment has a threshold: 1 asks for equal subsets, 2 for subsets that differ in at
most one element, which the subsets with one deletion find.  If the thresholds sum to more than H,
two similar sets meet a threshold somewhere, by the pigeonhole principle.  The sum exceeds H by some
slack, so that empty subsets, which would bring unrelated sets together, need not be indexed.  How
many segments get threshold 2 is chosen by cost, from the measured number of sets of the band.

Sets meet by the hash of a subset.  Equal sets are one node.  A subset that a whole Arrow batch
repeats is sent on once, so a bucket receives a row per batch at most, and sets are compared with
the first of their bucket, then, where a bucket holds several components, with the set that lies in
most buckets.  What buckets still hold several components then hide is found by rare shingles instead of
by the subset they all share: of shingles that several components hold, in the order of their number of
sets, two similar sets share one of their first few (prefix filter), and a passage that thousands of sets
share comes last.  Every comparison is exact, on words.  A skipped comparison lies within a component, so
no component loses a link.

Before texts are moved, pairs meet by sketches: bit i of a set's sketch tells whether an odd number of its shingles
hash to i, so two sketches differ in no more bits than the sets differ in elements, and pairs whose sketches differ in more than
similar sets can are dropped, exactly.

Null texts and texts without words have the empty set, which is linked with nothing.  Rows that
repeat an id are documents of their own with the same id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.common import ROW, table, with_row_key
from unitloom.llm.components import components
from unitloom.session import cut_lineage

WORDS, SIMILAR = 4, 85
#: Rounds that compare with central sets before sets are compared across components.
CENTRES = 2
#: Each band's sizes reach up to this many times its least; sets that meet by rare shingles lie in narrower ones.
BAND_RATIO, NARROW_RATIO = 1.5, 1.06
#: Thresholds beyond H, as a share of H + 1; at least one.
SLACK = 0.06
#: Words of documents that are hashed together, at some six bytes a word.
WORDS_AT_ONCE, WORD_BYTES = 50_000, 6
#: Bytes of the longest word that is hashed with others.
LONG_WORD = 64
#: Shingles of documents whose subsets are keyed together.
HASHES_AT_ONCE = 50_000
#: Least bits of a sketch, and bits that sets carry where they meet by rare shingles.
SKETCH_BITS = 256
#: Assumed share of sets that hold a given element of a small subset, for the choice of thresholds.
COMMON = 0.05

_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes that are white space, and masks of the lowest bytes of eight.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW_BYTES = np.array([(1 << 8 * size) - 1 for size in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX_A
    x = (x ^ (x >> np.uint64(33))) * _MIX_B
    return x ^ (x >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and each text's number of words.

    Words are read eight bytes at a time, all words together; the few longer than ``LONG_WORD`` one by one.
    """
    body = b" " + b" ".join(texts).lower() + bytes([32] * 8)
    white = _WHITE[np.frombuffer(body, np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(body) - 7, "<u8", body, 0, (1,))
    found = lengths.astype(np.uint64) * _MIX_A
    part, at = slice(None), np.arange(len(starts))
    for step in range(0, LONG_WORD, 8):
        if not len(at):
            break
        read = eights[starts[part] + step] & _LOW_BYTES[np.minimum(lengths[part] - step, 8)]
        found[part] = mixed(found[part] + read)
        part = at = at[lengths[at] > step + 8]
    for place in at:
        found[place] = xxhash.xxh3_64_intdigest(body[starts[place]:starts[place] + lengths[place]])
    begin = np.cumsum([1, *[len(text) + 1 for text in texts]])
    return found, np.diff(np.searchsorted(starts, begin))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles."""
    return next(_hashed_at_once([b" ".join(words)], n))


def all_shingle_hashes(bodies: list[str], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; many texts are hashed at once."""
    waiting, held = [], 0
    for body in bodies:
        waiting.append(body.encode())
        held += len(waiting[-1])
        if held >= WORDS_AT_ONCE * WORD_BYTES:
            yield from _hashed_at_once(waiting, n)
            waiting, held = [], 0
    yield from _hashed_at_once(waiting, n)


def _hashed_at_once(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    found, counts = word_hashes(texts)
    # windows over two texts are hashed too, and not read
    total = np.zeros(max(len(found) - n + 1, 0), np.uint64)
    for i in range(n):
        total = mixed(total + found[i:len(total) + i])
    start = 0
    for count in counts.tolist():
        if count > n:
            hashes = np.sort(total[start:start + count - n + 1])
            new = hashes[1:] != hashes[:-1]
            yield hashes if new.all() else hashes[np.concatenate([[True], new])]
        else:
            whole = np.zeros(min(count, 1), np.uint64)
            for value in found[start:start + count]:
                whole = mixed(whole + value)
            yield whole
        start += count


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the number of hashes by their low bits; a set of twice the size has a sketch of twice the length."""
    bits = SKETCH_BITS
    while bits < 2 * len(hashes):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketched: bytes, bits: int) -> int:
    """A sketch with fewer bits, as its hashes would give it."""
    value, held = int.from_bytes(sketched, "little"), 8 * len(sketched)
    while held > bits:
        held //= 2
        value = (value >> held) ^ (value & ((1 << held) - 1))
    return value


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) <= n:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(n)]))


def band_starts(top: int, similar: int, ratio: float) -> list[int]:
    """Least size of each band, past the sizes that sets similar to one of ``top`` elements have."""
    starts = [1]
    while starts[-1] <= top * 100 // similar + 1:
        starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
    return starts


class Bands:
    """Size bands and what each needs: segments, those with threshold 2, and the slack."""

    def __init__(self, similar: int = SIMILAR, ratio: float = BAND_RATIO, top: int = 1):
        self.similar = similar
        self.top = top
        self.starts = band_starts(top, similar, ratio)
        self.plans = [self._plan(band, 0.0) for band in range(len(self.starts) - 1)]

    def apart(self, a: int, b: int) -> int:
        """Most elements in which similar sets of these sizes differ."""
        return (100 - self.similar) * (a + b) // (100 + self.similar)

    def _plan(self, band: int, sets: float) -> tuple[int, int, int]:
        low, high = self.starts[band], self.starts[band + 1] - 1
        most = self.apart(high, high)
        if not most:
            return 0, 0, 0
        slack = max(1, ceil(SLACK * (most + 1)))
        needed = most + 1 + slack
        best = None
        for double in range(0, min(8, needed // 2) + 1):
            segments = needed - double
            size = low / segments
            rows = segments - double + double * (1 + size)
            chance = sets * ((segments - double) * COMMON ** size + double * (1 + size) * COMMON ** max(0.0, size - 1))
            if best is None or rows + chance < best[0]:
                best = (rows + chance, segments, double)
        return best[1], best[2], slack

    def allocate(self, sets: dict[int, int]) -> None:
        """Choose thresholds by cost from the number of sets per band."""
        self.plans = [self._plan(band, float(sets.get(band, 0) + sets.get(band - 1, 0))) for band in range(len(self.plans))]

    def of(self, size: int) -> list[int]:
        """A set's own band, and higher ones that hold sets large enough to be similar."""
        own = int(np.searchsorted(self.starts, size, "right")) - 1
        bands = [own]
        while bands[-1] + 1 < len(self.plans) and 100 * size >= self.similar * self.starts[bands[-1] + 1]:
            bands.append(bands[-1] + 1)
        return bands

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """Keys under which a set's subsets are indexed; low bits hold the band and the threshold."""
        out = []
        for band in self.of(len(hashes)):
            segments, double, slack = self.plans[band]
            if not segments:
                continue
            place = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            held, values = place[first].astype(np.int64), mixed(hashes)
            sums = np.add.reduceat(values, first)
            salt = mixed(np.uint64(band << 32) + np.arange(segments, dtype=np.uint64))
            out.append(self._key(sums + salt[held], band, held < double))
            for k in np.flatnonzero(held < double):
                end = first[k + 1] if k + 1 < len(first) else len(hashes)
                lessened = sums[k] - values[first[k]:end] + salt[held[k]]
                out.append(self._key(lessened, band, np.ones(len(lessened), bool)))
            silent = np.ones(segments, bool)
            silent[held] = False
            empty = np.flatnonzero(silent)
            kept = empty < double
            # an empty subset with threshold 2 still meets subsets of one element
            if kept.sum() * 2 + (~kept).sum() > slack:
                out.append(self._key(salt[empty], band, kept))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def signatures_of(self, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, places in ``sets``): :meth:`signatures` of sets that are not empty, all at once and with repeats."""
        sizes = np.array([len(found) for found in sets], np.int64)
        hashes, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
        values, own = mixed(hashes), np.searchsorted(self.starts, sizes, "right") - 1
        for band in range(int(own.min()), len(self.plans)):
            chosen = np.flatnonzero((own == band) | ((own < band) & (100 * sizes >= self.similar * self.starts[band])))
            segments, double, slack = self.plans[band]
            if not len(chosen):
                if band > own.max():
                    break
                continue
            if not segments:
                continue
            lengths = sizes[chosen]
            at = np.arange(lengths.sum()) + np.repeat(begin[chosen] - np.cumsum(lengths) + lengths, lengths)
            inside = values[at]
            cell = ((hashes[at] >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).view(np.int64)
            cell += np.repeat(np.arange(len(chosen)) * segments, lengths)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            filled = cell[first]
            owner, held = chosen[filled // segments], filled % segments
            salt = mixed(np.uint64(band << 32) + np.arange(segments, dtype=np.uint64))
            sums = np.add.reduceat(inside, first) + salt[held]
            yield self._key(sums, band, held < double), owner
            if double:
                subset = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cell))))
                lessened = held[subset] < double
                subset = subset[lessened]
                yield self._key(sums[subset] - inside[lessened], band, np.ones(len(subset), bool)), owner[subset]
            silent = np.ones(len(chosen) * segments, bool)
            silent[filled] = False
            empty = np.flatnonzero(silent)
            whose, kept = empty // segments, empty % segments < double
            # an empty subset with threshold 2 still meets subsets of one element
            told = np.bincount(whose, 1 + kept, len(chosen))[whose] > slack
            yield self._key(salt[empty[told] % segments], band, kept[told]), chosen[whose[told]]

    @staticmethod
    def _key(sums: np.ndarray, band: int, double: np.ndarray) -> np.ndarray:
        return (mixed(sums) & ~np.uint64(255)) | np.uint64(band << 1) | double.astype(np.uint64)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def shingle_sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(row, doc_id, n, digest, sketch): size, identity and sketch of each document's set."""
    def measure(batches):
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for found in all_shingle_hashes(batch.column(2).to_pylist(), words):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sketches.append(sketch(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                names=[ROW, "doc_id", "n", "digest", "sketch"])
    return _texts(docs, doc_id, text).mapInArrow(measure, f"{ROW} long, doc_id long, n long, digest binary, sketch binary")


def _stars(batches):
    """Of rows sorted by route and key, pairs with the first row of each key; pairs made earlier pass."""
    last_sig, last_row = None, None
    for batch in batches:
        sig, hub, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        done = hub >= 0
        yield pa.RecordBatch.from_arrays([pa.array(sig[done]), pa.array(hub[done]), pa.array(row[done])], names=["sig", "hub", "row"])
        sig, row = sig[~done], row[~done]
        if not len(sig):
            continue
        new = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        hubs = np.where(first >= 0, row[np.maximum(first, 0)], last_row if last_row is not None else -1)
        last_sig, last_row = sig[-1], hubs[-1]
        pair = ~new
        yield pa.RecordBatch.from_arrays([pa.array(sig[pair]), pa.array(hubs[pair]), pa.array(row[pair])], names=["sig", "hub", "row"])


def buckets(docs: DataFrame, doc_id: str, text: str, words: int, bands: Bands) -> DataFrame:
    """(sig, hub, row): rows that share a subset, each with the first of them in its batch or overall."""
    def emit(batches):
        for batch in batches:
            seen, keys, owners, held, held_rows, size = set(), [], [], [], [], 0

            def told():
                rows = np.array(held_rows, np.int64)
                for key, place in bands.signatures_of(held):
                    keys.append(key)
                    owners.append(rows[place])

            for row, found in zip(batch.column(0).to_pylist(), all_shingle_hashes(batch.column(2).to_pylist(), words)):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if len(found) and digest not in seen:
                    seen.add(digest)
                    held.append(found)
                    held_rows.append(row)
                    size += len(found)
                    if size >= HASHES_AT_ONCE:
                        told()
                        held, held_rows, size = [], [], 0
            if held:
                told()
            if not keys:
                continue
            sig, row = np.concatenate(keys).view(np.int64), np.concatenate(owners)
            order = np.lexsort((row, sig))
            sig, row = sig[order], row[order]
            distinct = np.concatenate([[True], (sig[1:] != sig[:-1]) | (row[1:] != row[:-1])]) if len(sig) else np.zeros(0, bool)
            sig, row = sig[distinct], row[distinct]
            new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
            hub = np.where(new, -1, row[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))])
            route = np.where(new, sig, mixed((sig ^ row).view(np.uint64)).view(np.int64))
            for start in range(0, len(sig), 200_000):
                part = slice(start, start + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[part]), pa.array(sig[part]), pa.array(hub[part]), pa.array(row[part])],
                    names=["route", "sig", "hub", "row"])
    emitted = _texts(docs, doc_id, text).mapInArrow(emit, "route long, sig long, hub long, row long")
    return emitted.repartition("route").sortWithinPartitions("sig", "row").mapInArrow(_stars, "sig long, hub long, row long")


def _compare(words: int, similar: int):
    def compare(batches):
        known: dict = {}

        def found(row, body):
            if row not in known:
                if len(known) > 200:
                    known.clear()
                known[row] = shingles(words_of(body), words)
            return known[row]

        waiting = None
        for batch in batches:
            out = ([], [])
            for a, b, side, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if waiting is None or waiting[:2] != (a, b):
                    waiting = (a, b, body)
                    continue
                one, two = found(a, waiting[2]), found(b, body)
                both = len(one & two)
                if both and 100 * both >= similar * (len(one) + len(two) - both):
                    out[0].append(a)
                    out[1].append(b)
                waiting = None
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])
    return compare


def may_be_similar(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Of pairs (a, b) of row keys, those whose sketches differ in no more bits than similar sets may differ in elements."""
    def compare(batches):
        for batch in batches:
            kept = []
            for a_n, b_n, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                bits = 8 * min(len(a), len(b))
                differ = (folded(a, bits) ^ folded(b, bits)).bit_count()
                kept.append((100 + similar) * differ <= (100 - similar) * (a_n + b_n))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    def side(name):
        return sets.select(F.col(ROW).alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
    # merged at every size, as the table of sketches grows with the input
    told = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return told.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, similar: int) -> DataFrame:
    """The pairs (a, b) of row keys whose sets are similar, compared word by word."""
    sides = pairs.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    asked = sides.withColumn(ROW, F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    # merged at every size: the texts are shuffled once, and a hot row key is split
    told = asked.hint("merge").join(_texts(docs, doc_id, text).select(ROW, "text"), ROW).select("a", "b", "side", "text")
    placed = told.repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return placed.mapInArrow(_compare(words, similar), "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                       similar: int = SIMILAR) -> DataFrame:
    """(row key, doc_id, n_shingles, component_id, class) of each row of a stored table.

    A component is all rows that links reach from one another; its id is its smallest doc_id.  Components
    that share that id, or have none as all their ids are null, are told apart by ``class``.
    """
    sets = cut_lineage(shingle_sets(docs, doc_id, text, words), "sets")
    same = cut_lineage(sets.where("n > 0").groupBy("digest").agg(F.min(ROW).alias("rep")), "same")
    nodes = cut_lineage(sets.join(same, "digest", "left").select(ROW, "doc_id", "n", "rep"), "nodes")
    bands = Bands(similar, top=nodes.agg(F.max("n")).first()[0] or 1)
    starts = F.array([F.lit(start) for start in bands.starts])
    band = F.size(F.filter(starts, lambda start: start <= F.col("n"))) - 1
    bands.allocate({row[0]: row[1] for row in nodes.where(f"n > 0 AND rep = {ROW}").groupBy(band.alias("band")).count().collect()})
    met = cut_lineage(buckets(docs, doc_id, text, words, bands), "buckets")

    def node(name):
        return nodes.select(F.col(ROW).alias(name), F.col("rep").alias(f"{name}_rep"), F.col("n").alias(f"{name}_n"))

    def fitting(pairs):
        a, b = F.col("a_n"), F.col("b_n")
        return pairs.where((100 * a >= similar * b) & (100 * b >= similar * a))

    def linked(pairs):
        near = cut_lineage(may_be_similar(pairs, sets, similar), "near")
        return cut_lineage(verified(near, docs, doc_id, text, words, similar), "links")

    named = met.join(node("hub"), "hub").join(node("row"), "row")
    first = named.where("hub_rep <> row_rep").select(
        F.least("hub_rep", "row_rep").alias("a"), F.greatest("hub_rep", "row_rep").alias("b"),
        F.col("hub_n").alias("a_n"), F.col("row_n").alias("b_n"))
    tried = cut_lineage(fitting(first).select("a", "b").distinct(), "pairs")
    links = linked(tried)
    reached = components(links)
    held = met.select("sig", F.explode(F.array("hub", "row")).alias(ROW)).join(nodes.select(ROW, "rep", "n"), ROW).drop(ROW)
    for step in range(CENTRES + 1):
        held = _mixed(held, reached)
        pairs = _central(held, similar) if step < CENTRES else _rare(_able(held, bands), docs, doc_id, text, words, bands, sets)
        pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        more = linked(pairs)
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            reached = components(links)
    placed = nodes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "class", F.coalesce("component", "rep", ROW))
    placed = cut_lineage(placed.select(ROW, "doc_id", "n", "class"), "placed")
    smallest = cut_lineage(placed.groupBy("class").agg(F.min("doc_id").alias("component_id")), "smallest")
    return placed.join(smallest, "class").select(ROW, "doc_id", F.col("n").alias("n_shingles"), "component_id", "class")


def _mixed(held: DataFrame, reached: DataFrame) -> DataFrame:
    """(sig, rep, n, component): of ``held``, the sets of buckets that hold several components."""
    of = held.select("sig", "rep", "n").join(reached.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig", "rep", "n", F.coalesce("component", "rep").alias("component"))
    of = cut_lineage(of, "held")
    ends = of.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return cut_lineage(of.join(cut_lineage(ends.select("sig"), "mixed"), "sig").distinct(), "mixed")


def _fits(similar: int):
    a, b = F.col("a_n"), F.col("b_n")
    return (F.col("a_class") != F.col("b_class")) & (100 * a >= similar * b) & (100 * b >= similar * a)


def _central(held: DataFrame, similar: int) -> DataFrame:
    """Pairs of each bucket's sets with the one of them that lies in most buckets, as the original of many copies does."""
    often = cut_lineage(held.groupBy("rep").agg(F.count(F.lit(1)).alias("buckets")), "often")
    ranked = held.join(often, "rep")
    hubs = cut_lineage(ranked.groupBy("sig").agg(F.max(F.struct("buckets", "rep", "n", "component")).alias("hub")), "hubs")
    hubs = hubs.select("sig", F.col("hub.rep").alias("b"), F.col("hub.n").alias("b_n"), F.col("hub.component").alias("b_class"))
    pairs = held.select("sig", F.col("rep").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_class")).join(hubs, "sig")
    return pairs.where(_fits(similar)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _able(held: DataFrame, bands: Bands) -> DataFrame:
    """(rep, n, component): the sets that share subsets enough with other components to be similar to a set there."""
    band = F.shiftright(F.col("sig").bitwiseAND(255), 1).cast("int")
    # thresholds of unmet segments sum to at most the number of elements in which the sets differ
    told = held.groupBy("rep", "n", "component", band.alias("band")).agg(F.sum(1 + F.col("sig").bitwiseAND(1)).alias("weight"))
    sums, slack, ends = (F.element_at(F.array([F.lit(value) for value in values]), F.col("band") + 1) for values in (
        [segments + double for segments, double, _ in bands.plans], [slack for _, _, slack in bands.plans],
        [start - 1 for start in bands.starts[1:]]))
    largest = F.least(ends, F.floor(100 * F.col("n") / bands.similar))
    most = F.floor((100 - bands.similar) * (F.col("n") + largest) / (100 + bands.similar))
    return told.where(F.col("weight") + slack >= sums - most).select("rep", "n", "component").distinct()


def _elements(words: int):
    """A row per set and shingle."""
    def emit(batches):
        for batch in batches:
            held, size = [], 0
            for rep, n, component, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = shingle_hashes(words_of(body), words).view(np.int64)
                held.append((found, rep, n, component))
                size += len(found)
                if size >= 100_000:
                    yield _rows_of(held)
                    held, size = [], 0
            if held:
                yield _rows_of(held)
    return emit


def _rows_of(held: list) -> pa.RecordBatch:
    lengths = [len(row[0]) for row in held]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([row[0] for row in held]), pa.int64()),
         *[pa.array(np.repeat([row[i] for row in held], lengths), pa.int64()) for i in (1, 2, 3)]],
        names=["element", "rep", "n", "component"])


def _prefixes(starts: list[int], similar: int):
    """Of each set's shingles, sorted by ``rep`` with the most frequent first, those that a similar set must meet, by its band."""
    least = np.array(starts, np.int64)
    span = 1
    while (NARROW_RATIO ** (span - 1)) * similar < 100:
        span += 1

    def emit(batches):
        last, passed = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            element, rep, n, component = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.concatenate([[rep[0] != last], rep[1:] != rep[:-1]])
            place = np.arange(len(rep))
            first = np.maximum.accumulate(np.where(new, place, -1))
            # how many of the set's shingles are as frequent or more, itself included
            after = np.where(first >= 0, place - first, place + passed) + 1
            last, passed = rep[-1], int(after[-1])
            own = np.searchsorted(least, n, "right") - 1
            for step in range(-span, span + 1):
                other = np.clip(own + step, 0, len(least) - 2)
                small = np.maximum(least[other], -(-similar * n // 100))
                large = np.minimum(least[other + 1] - 1, 100 * n // similar)
                shared = -(-similar * (n + small) // (100 + similar))
                kept = (other == own + step) & (small <= large) & (after >= shared)
                if not kept.any():
                    continue
                low, high = np.minimum(own, other)[kept], np.maximum(own, other)[kept]
                salt = mixed((low * len(least) + high).view(np.uint64))
                key = mixed(element[kept].view(np.uint64) ^ salt).view(np.int64)
                side = pa.array(np.full(len(key), (step > 0) - (step < 0), np.int8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), side, *[pa.array(values[kept]) for values in (rep, n, component)]],
                    names=["key", "side", "rep", "n", "component"])
    return emit


_BITS = [f"bits_{i}" for i in range(SKETCH_BITS // 64)]
_SHORT = ", ".join(["rep long", *[f"{column} long" for column in _BITS]])


def _short(batches):
    """The short form of each set's sketch, 64 bits a column."""
    for batch in batches:
        short = b"".join(folded(value, SKETCH_BITS).to_bytes(SKETCH_BITS // 8, "little") for value in batch.column(1).to_pylist())
        table = np.frombuffer(short, "<i8").reshape(batch.num_rows, len(_BITS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(_BITS))]], names=["rep", *_BITS])


def _rare(sets: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, bands: Bands,
          sketched: DataFrame | None = None) -> DataFrame:
    """Pairs across components that may be similar, as both hold one of the rarest shingles that several components have.

    The order of shingles is by their number of sets, and those that one component alone holds come before all
    others.  Similar sets of sizes n and m share s * (n + m) / (100 + s) shingles, so the first one they share in
    that order has so many shingles of each set from itself on.  Sets meet by that shingle and both their bands.
    With ``sketched``, the table of :func:`shingle_sets`, pairs are held to a short form of their sketches where they meet.
    """
    similar, wanted = bands.similar, cut_lineage(sets.withColumnRenamed("rep", ROW), "able")
    told = wanted.hint("merge").join(_texts(docs, doc_id, text).select(ROW, "text"), ROW).select(ROW, "n", "component", "text")
    elements = cut_lineage(told.mapInArrow(_elements(words), "element long, rep long, n long, component long"), "elements")
    common = cut_lineage(elements.groupBy("element").agg(
        F.count(F.lit(1)).alias("sets"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high").select("element", "sets"), "common")
    ordered = elements.join(common, "element").repartition("rep").sortWithinPartitions("rep", F.desc("sets"), F.desc("element"))
    starts = band_starts(bands.top, similar, NARROW_RATIO)
    met = cut_lineage(ordered.select("element", "rep", "n", "component").mapInArrow(
        _prefixes(starts, similar), "key long, side byte, rep long, n long, component long"), "prefixes")
    several = met.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    met = met.join(cut_lineage(several.select("key"), "several"), "key")
    bits = [] if sketched is None else _BITS
    if sketched is not None:
        met = met.join(sketched.select(F.col(ROW).alias("rep"), "sketch").mapInArrow(_short, _SHORT), "rep")
    met = cut_lineage(met, "rare")

    def side(name, taken):
        return met.where(taken).select(
            "key", F.col("side").alias(f"{name}_side"), F.col("rep").alias(name), F.col("n").alias(f"{name}_n"),
            F.col("component").alias(f"{name}_class"), *[F.col(column).alias(f"{name}_{column}") for column in bits])
    pairs = side("a", "side >= 0").join(side("b", "side <= 0"), "key")
    facing = (F.col("a_side") + F.col("b_side") == 0) & ((F.col("a_side") != 0) | (F.col("a") < F.col("b")))
    differ = sum((F.bit_count(F.col(f"a_{column}").bitwiseXOR(F.col(f"b_{column}"))) for column in bits), F.lit(0))
    near = (100 + similar) * differ <= (100 - similar) * (F.col("a_n") + F.col("b_n"))
    return pairs.where(facing & _fits(similar) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op10_jaccard_join(spark, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents")).drop(ROW, "class")


SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
      WHERE 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (an + bn - shared)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT r.d, k.b FROM r JOIN k ON r.c = k.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON s.doc_id = r.d GROUP BY s.doc_id, len(g)
"""
