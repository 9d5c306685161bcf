"""Benchmark decontamination: gapped n-gram seeds, then Smith-Waterman alignment.

1. Words are the ``\\w+`` runs of the lower-cased text, held as 64-bit hashes.  Test
   items of equal words are one item, named by its smallest id.
2. A *gram* is ``n`` words of the item in order with up to ``2n - 3`` words left out
   between them.  An alignment of score ``s`` with an item of ``L`` words has at least
   ``R = s L - n + 1`` runs of ``n`` successive matches with so few columns between them
   (each match over ``s L`` pays for at most two errors, an error lies in ``n - 1``
   runs), and these runs begin at different words of the item.  So of the rarest
   ``L - n + 1 - R + t`` of its words, by the documents' counts, at least ``t`` begin
   such a run: the grams that begin there are its *seeds*, and only passages with seeds
   of ``t`` words are aligned, yet every pair from ``min_score`` on is (for ``R < 1``,
   ``t`` is one and all grams are seeds).  ``t`` is the number with the least expected
   work, from the chance of the seeds in a passage of ordinary words.
3. The documents are scanned once more, for words with as few left out.  Two tables sized
   by the number of seeds let through the grams that may be seeds, with the reach and
   the ``t`` of the items behind them; benchmarks with more than ``PASS_SEEDS`` seeds
   are searched in several passes over the documents.  Around the hits a *passage* is
   cut out, long enough to hold any alignment of the item from ``min_score`` on at
   either side; overlapping ones are merged.
4. The hits of the passages join the seeds by hash, which gives the pairs of passage
   and item with ``t`` seed words; each pair is aligned: a match counts ``MATCH``, a
   substitution or a gap ``-1``, and the best local score is divided by that of the
   whole item.  Pairs from ``min_score`` on are leaks, so exact, edited and partly
   reworded copies are found and chance hits are not.

Items of fewer than ``min_words`` words are found where their words stand next to each
other, unedited; those of fewer than ``n`` words only where they are a whole document.

Everything joins by key; a seed held by a third of all documents is one row on the
items' side, so the large side can be split.  The result has one row per document and
item, the best alignment.  Null and empty texts and items hold nothing; items with a
null id are searched too, and items that share an id are searched each by itself.
Equal documents are reported once; an empty corpus or benchmark gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import materialise, require_columns, row_key, text_slices

SEED_WORDS = 3
MIN_WORDS = 8
MIN_SCORE = 0.5
MATCH = 2
MAX_RATE = 1.0
#: Seeds of one pass, and cells of its table per seed (the table has at most 2**26 cells).
PASS_SEEDS = 1 << 21
CELLS = 32
#: Cells of the table of words, 16 per word at most; words beyond it share cells.
MOST_WORD_BITS = 27
#: Hits that cost as much as one alignment.
HITS_PER_ALIGNMENT = 1000
GOLDEN = 0x9E3779B97F4A7C15
BITS = 64


# -- words --------------------------------------------------------------------------

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
#: The bytes after 0xC3 that make capital letters.
CAPITAL = np.zeros(256, bool)
CAPITAL[0x80:0x9F] = True
CAPITAL[0x97] = False
POWERS = np.cumprod(np.full(1 << 12, GOLDEN, np.uint64))
WORD = re.compile(r"\w+")


def hashed_words(texts):
    """Word hashes of an Arrow string array, and each text's start in them.

    Works on the bytes of Basic Latin and the Latin-1 letters; texts with other
    characters are first rewritten as their words, in lower case.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    rows, raw = _buffers(filled)
    lead = np.concatenate(([0], raw[:-1])) == 0xC3
    odd = np.flatnonzero((raw >= 128) & (raw != 0xC3) & ~lead)
    if len(odd):
        slow = np.unique(np.searchsorted(rows, odd, side="right") - 1)
        rewritten = [" ".join(WORD.findall(t.lower())) for t in filled.take(pa.array(slow)).to_pylist()]
        mask = np.zeros(len(filled), bool)
        mask[slow] = True
        filled = pc.replace_with_mask(filled, pa.array(mask), pa.array(rewritten, pa.large_string()))
        rows, raw = _buffers(filled)
        lead = np.concatenate(([0], raw[:-1])) == 0xC3
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
    low = LOWER_BYTE[raw]
    low[lead & CAPITAL[raw]] += 32
    sign = lead & ((raw == 0x97) | (raw == 0xB7))               # the signs of multiplication and division
    inside = WORD_BYTE[raw] & ~sign
    inside[:-1] &= ~sign[1:]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[rows] = True
    begin = inside & (fresh[:-1] | np.concatenate(([True], ~inside[:-1])))
    at = np.flatnonzero(begin)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
    low[~inside] = 0
    run = np.diff(np.append(at, len(raw)))
    place = np.arange(at[0], len(raw)) - np.repeat(at, run)
    bytes_ = low[at[0]:].astype(np.uint64)
    long = int(place.max()) + 1
    powers = POWERS if long <= len(POWERS) else np.cumprod(np.full(long, GOLDEN, np.uint64))
    h = np.add.reduceat(bytes_ * powers[place], at - at[0])
    # mixed, since tables use the high bits
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32), np.searchsorted(at, rows)


def _buffers(strings):
    rows = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[rows[0]:rows[-1]] if data is not None and rows[-1] > rows[0] \
        else np.empty(0, np.uint8)
    return rows - rows[0], raw


def shapes(n: int):
    """Places, from the first one, of ``n`` words with up to 2n - 3 words left out between them."""
    most = max(2 * n - 3, 0)
    for steps in itertools.product(range(1, most + 2), repeat=n - 1):
        if sum(steps) - len(steps) <= most:
            yield (0, *itertools.accumulate(steps))


def mix(k: int):
    """The odd multiplier of a gram's k-th word."""
    return np.uint64(pow(GOLDEN, 2 * k + 1, 1 << BITS))


def placed(words, places, at=None):
    """Hashes of the words at ``places`` after each word, or after those at ``at``."""
    if at is None:
        at = np.arange(max(len(words) - places[-1], 0))
    gram = words[at] * mix(0)
    for k, place in enumerate(places[1:], 1):
        gram = gram + words[at + place] * mix(k)
    return gram


def grams_of(words, n: int):
    """For each shape: its span, and the 64-bit hashes of the words so placed from each word on."""
    for places in shapes(n):
        yield places[-1] + 1, placed(words, places)


def whole_run(words, size: int, at=None):
    """Hashes of ``size`` successive words; unlike those of grams."""
    return placed(words, tuple(range(size)), at) ^ np.uint64(size * 0x5851F42D4C957F2D & (1 << BITS) - 1)


def _longs(values):
    return np.ascontiguousarray(values).view(np.int64)


def _lists(values, starts):
    """An Arrow list array over one flat array of 64-bit values."""
    import pyarrow as pa
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(_longs(values)))


# -- the benchmark ----------------------------------------------------------------

def benchmark_items(benchmark: DataFrame, text: str, item_id: str, n: int, min_words: int) -> DataFrame:
    """(key, item, words, short) of the items with words, equal ones once."""
    def hashed(batches):
        import pyarrow as pa
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*hashed_words(batch.column(1)))],
                                                 names=["item", "words"])

    kind = benchmark.schema[item_id].dataType.simpleString()
    rows = benchmark.select(F.col(item_id).alias("_item"), F.col(text).alias("_text"))
    found = rows.mapInArrow(hashed, f"item {kind}, words array<long>").where(F.size("words") > 0)
    key = F.concat_ws(":", F.xxhash64("words"), F.xxhash64(F.lit("second"), "words"))
    return (found.groupBy("words").agg(F.min("item").alias("item"))
                 .select(key.alias("key"), "item", "words", (F.size("words") < max(min_words, n)).alias("short")))


def word_filter(items: DataFrame):
    """A bit table of the items' words, packed on the executors: at most 16 MiB."""
    words = items.select(F.explode("words").alias("word")).distinct()
    bits = min(max(math.ceil(math.log2(16 * words.count() + 1)), 16), MOST_WORD_BITS)
    cell = F.shiftrightunsigned("word", BITS - bits)
    rows = (words.groupBy(F.shiftright(cell, 15).alias("bucket"))
                 .agg(F.bitmap_construct_agg(cell.bitwiseAND(F.lit((1 << 15) - 1).cast("long"))).alias("bits")).collect())
    table = np.zeros(max((1 << bits) >> 3, 1 << 12), np.uint8)
    for row in rows:
        table[row.bucket << 12:(row.bucket + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return bits, table


def in_filter(held, words):
    """Which words may be in a ``word_filter`` that was unpacked."""
    bits, table = held
    return table[(words >> np.uint64(BITS - bits)).astype(np.int64)]


def unpacked(packed):
    return packed[0], np.unpackbits(packed[1], bitorder="little").astype(bool)


def corpus_counts(docs: DataFrame, text: str, words) -> DataFrame:
    """(word, n): occurrences of the words in the filter ``words``; word null: of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        import pyarrow as pa
        held = unpacked(shared.value)
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                words, _ = hashed_words(batch.column(0))
                found, times = np.unique(words[in_filter(held, words)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *_longs(found).tolist()], pa.int64()),
                     pa.array([len(words), *times.tolist()], pa.int64())], names=["word", "n"])

    return (docs.select(F.col(text).alias("_text")).mapInArrow(count, "word long, n long")
                .groupBy("word").agg(F.sum("n").alias("n")))


def seed_words(log_rates, runs: int, window: int) -> tuple[int, int]:
    """(m, t): the m rarest words of an item begin its seeds, t of them any pair from the score limit on.

    The least expected work in a passage of ``window`` ordinary words: its hits, and the
    alignment if t seed words (taken as independent) meet by chance.
    """
    begins = len(log_rates)
    if runs < 1:
        return begins, 1
    expected = window * np.cumsum(np.exp(np.sort(log_rates)))
    t = np.arange(1, runs + 1)
    hits = expected[begins - runs:begins]
    chance = np.minimum(t * np.log(np.maximum(hits, 1e-300)) - np.array([math.lgamma(k + 1) for k in t]), 0)
    best = int(np.argmin(hits + HITS_PER_ALIGNMENT * np.exp(chance)))
    return begins - runs + 1 + best, 1 + best


def seeds_of(items: DataFrame, counts: DataFrame, n: int, max_rate: float = MAX_RATE,
             min_score: float = MIN_SCORE) -> DataFrame:
    """(key, gram, place, need, reach, short): the seeds of each item by the word that they begin at."""
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 1       # one number
    shares = items.select("key", "short", F.posexplode("words").alias("pos", "word")).join(counts, "word", "left")
    log_share = F.log(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0.5)) / F.lit(float(total)))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "word", log_share.alias("share"))))
    of_item = shares.groupBy("key", "short").agg(ordered.alias("placed")).select(
        "key", "short", F.col("placed.word").alias("words"), F.col("placed.share").alias("shares"))

    def choose(batches):
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                short = batch.column(1)[i].as_py()
                words = batch.column(2)[i].values.to_numpy().view(np.uint64)
                share = batch.column(3)[i].values.to_numpy()
                if short:
                    grams, at, need = whole_run(words, len(words)), np.zeros(1, np.int64), 1
                else:
                    begins = len(words) - n + 1
                    grams, at, rate = [], [], np.full(begins, -np.inf)
                    for places in shapes(n):
                        gram = placed(words, places)
                        own = sum(share[p:p + len(gram)] for p in places)
                        rate[:len(gram)] = np.logaddexp(rate[:len(gram)], own)
                        grams.append(gram)
                        at.append(np.arange(len(gram)))
                    runs = math.ceil(min_score * len(words) - 1e-9) - n + 1
                    m, need = seed_words(np.minimum(rate, math.log(max_rate)), runs, 6 * len(words))
                    chosen = np.zeros(begins, bool)
                    chosen[np.argsort(rate, kind="stable")[:m]] = True
                    grams, at = np.concatenate(grams), np.concatenate(at)
                    grams, at = grams[chosen[at]], at[chosen[at]]
                size = len(grams)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * size, pa.int64())), pa.array(_longs(grams)),
                     pa.array(at, pa.int32()), pa.array([need] * size, pa.int32()),
                     pa.array([len(words)] * size, pa.int32()), pa.array([short] * size, pa.bool_())],
                    names=["key", "gram", "place", "need", "reach", "short"])

    return of_item.mapInArrow(choose, "key string, gram long, place int, need int, reach int, short boolean")


# -- the documents ----------------------------------------------------------------

def seed_table(seeds: DataFrame, n: int):
    """What the scan needs to know of the seeds; its size follows their number.

    Cells of the long items' seeds with the greatest reach and the least need, cells of
    the short items' runs, and the short items' lengths.
    """
    bits = min(max(math.ceil(math.log2(CELLS * seeds.count() + 1)), 16), 26)
    cell = F.shiftrightunsigned("gram", BITS - bits).cast("int").alias("cell")
    # a second place, from other bits of the gram
    other = F.shiftrightunsigned(F.shiftleft("gram", 32), BITS - bits).cast("int").alias("other")
    others = seeds.where("not short").select(other).distinct().toPandas()["other"].to_numpy(np.int32)
    long = seeds.where("not short").groupBy(cell).agg(F.max("reach").alias("reach"), F.min("need").alias("need")).toPandas()
    short = seeds.where("short").select(cell, "reach").distinct().toPandas()
    return (bits, others, long["cell"].to_numpy(np.int32), long["reach"].to_numpy(np.int32), long["need"].to_numpy(np.int32),
            short["cell"].to_numpy(np.int32), sorted(set(short["reach"].tolist())))


def passages(docs: DataFrame, seeds: DataFrame, text: str, doc_id: str, n: int,
             min_score: float = MIN_SCORE, words=None) -> DataFrame:
    """(_k1, _k2, _id, start, words, hits): the neighbourhoods of possible seeds.

    ``words``: the ``word_filter`` of the items, which spares the grams of other words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((seed_table(seeds, n), words))
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa
        (bits, others, cells, reaches, needs, short_cells, short_sizes), filtered = shared.value
        to_cell = np.uint64(BITS - bits)
        reach, need = np.zeros(1 << bits, np.int32), np.ones(1 << bits, np.int32)
        reach[cells], need[cells] = reaches, needs
        wanted, second, short = reach > 0, np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        second[others], short[short_cells] = True, True
        held = unpacked(filtered) if filtered is not None else None
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                words, starts = hashed_words(batch.column(3))
                ours = in_filter(held, words) if held is not None else np.ones(len(words), bool)
                places, spans, kinds = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for shape in shapes(n):
                    size = max(len(words) - shape[-1], 0)
                    at = ours[:size].copy()
                    for place in shape[1:]:
                        at &= ours[place:place + size]
                    at = np.flatnonzero(at)
                    gram = placed(words, shape, at)
                    hit = wanted[gram >> to_cell]
                    hit[hit] = second[(gram[hit] << np.uint64(32)) >> to_cell]
                    places.append(at[hit])
                    spans.append(np.full(int(hit.sum()), shape[-1] + 1))
                    kinds.append(gram[hit])
                found, span, gram = np.concatenate(places), np.concatenate(spans), np.concatenate(kinds)
                row = np.searchsorted(starts, found, side="right") - 1
                inside = found + span <= starts[row + 1]       # not across two documents
                found, row, span, gram = found[inside], row[inside], span[inside], gram[inside]
                cell = (gram >> to_cell).astype(np.int64)
                far = reach[cell].astype(np.int64)
                # the errors that a copy of the whole item can have
                far += np.ceil(2 * max(1 - min_score, 0) * far).astype(np.int64)
                lo, hi = np.maximum(found - far, starts[row]), np.minimum(found + span + far, starts[row + 1])
                # a later hit of a longer item may reach further back: merged in order of their
                # beginnings, the passages of a document are disjoint
                order = np.lexsort((lo, row))
                found, gram, row, lo, hi, least = (x[order] for x in (found, gram, row, lo, hi, need[cell]))
                if len(gram):
                    # a passage ends where no hit so far reaches; ends grow with the rows' offsets
                    far_end = np.maximum.accumulate(hi)
                    first = np.flatnonzero(np.concatenate(([True], (lo[1:] > far_end[:-1]) | (row[1:] != row[:-1]))))
                    part = np.cumsum(np.isin(np.arange(len(gram)), first)) - 1
                    begin, end = lo[first], np.maximum.reduceat(hi, first)
                    # different places with a hit: an alignment has as many as its item needs
                    pairs = np.unique(part.astype(np.int64) << 40 | found)
                    enough = np.bincount(pairs >> 40, minlength=len(first)) >= np.minimum.reduceat(least, first)
                    own = np.unique(np.rec.fromarrays((part[enough[part]], _longs(gram[enough[part]]))))
                    yield _passages(batch, starts, words, row[first][enough], begin[enough], end[enough],
                                    own.f1, np.flatnonzero(enough), own.f0)
                for size in short_sizes:
                    yield from _short_runs(batch, starts, words, ours, size, n, short, to_cell)

    rows = docs.select(*row_key(doc_id, text), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(scan, f"_k1 long, _k2 long, _id {kind}, start long, "
                                 "words array<long>, hits array<long>")


def _passages(batch, starts, words, row, begin, end, hits, parts, part_of_hit):
    """A record batch of passages; ``hits`` are sorted by the passage (of ``parts``) that holds them."""
    import pyarrow as pa
    size = end - begin
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = words[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    at = pa.array(row, pa.int64())
    cuts = np.append(np.searchsorted(part_of_hit, parts), len(hits))
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c).take(at) for c in range(3)), pa.array(begin - starts[row], pa.int64()),
         _lists(flat, ends), _lists(hits, cuts)], names=["_k1", "_k2", "_id", "start", "words", "hits"])


def _short_runs(batch, starts, words, ours, size, n, short, to_cell):
    """The runs of ``size`` words that may be a short item, each once a document."""
    at = ours[:max(len(words) - size + 1, 0)].copy()
    for k in range(1, size):
        at &= ours[k:k + len(at)]
    at = np.flatnonzero(at)
    gram = whole_run(words, size, at)
    hit = short[gram >> to_cell]
    at, gram = at[hit], gram[hit]
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + size <= starts[row + 1]
    if size < n:                                            # only a whole document
        inside &= (at == starts[row]) & (at + size == starts[row + 1])
    at, gram, row = at[inside], gram[inside], row[inside]
    _, first = np.unique(np.rec.fromarrays((row, _longs(gram))), return_index=True)
    if len(first):
        at, gram, row = at[first], gram[first], row[first]
        yield _passages(batch, starts, words, row, at, at + size, _longs(gram), np.arange(len(at)), np.arange(len(at)))


def local_alignment(item, passage):
    """(score, end in passage): the best Smith-Waterman score of two word sequences."""
    steps = np.arange(1, len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row[:-1] + np.where(passage == word, MATCH, -1), row[1:] - 1)
        # a gap in the item: the best cell to the left, less the distance
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        row = np.concatenate(([0], new))
        at = int(new.argmax())
        if new[at] > best:
            best, end = int(new[at]), at + 1
    return best, end


def align(item, passage, least: float = 0):
    """(share of the item's own score, start, end) of the best alignment; (0, 0, 0) below ``least``.

    No alignment scores more than the matches of all words that both hold, and one
    without a match scores nothing.
    """
    if np.isin(item, passage).sum() < max(least * len(item), 1):
        return 0.0, 0, 0
    score, end = local_alignment(item, passage)
    if score < least * MATCH * len(item):
        return 0.0, 0, 0
    _, back = local_alignment(item[::-1], passage[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
               item_text: str = "text", item_id: str = "item_id", n: int = SEED_WORDS,
               min_words: int = MIN_WORDS, min_score: float = MIN_SCORE,
               pass_seeds: int = PASS_SEEDS) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, score, start_word, end_word), one row per document and item."""
    require_columns(docs, text, doc_id)
    require_columns(benchmark, item_text, item_id)
    if n < 1:
        raise ValueError("seeds of one word or more")
    items = materialise(benchmark_items(benchmark, item_text, item_id, n, min_words), "leak-items")
    words = word_filter(items)
    counts = materialise(corpus_counts(docs, text, words), "leak-counts")
    seeds = materialise(seeds_of(items, counts, n, min_score=min_score), "leak-seeds")
    n_passes = max(1, -(-seeds.count() // pass_seeds))
    scored = None
    for k in range(n_passes):           # one, unless the benchmark is very large
        own = seeds if n_passes == 1 else seeds.where(F.pmod(F.xxhash64("key"), F.lit(n_passes)) == k)
        near = materialise(passages(docs, own, text, doc_id, n, min_score, words), "leak-passages")
        found = _scored(near, own, items, min_score)
        scored = found if scored is None else scored.unionByName(found)
    best = scored.groupBy("_k1", "_k2", "_id", "key", "item").agg(
        F.max(F.struct("score", (-F.col("start_word")).alias("first"), "end_word")).alias("best"))
    return best.select("_k1", "_k2", F.col("_id").alias(doc_id), F.col("item").alias(item_id),
                       "best.score", (-F.col("best.first")).alias("start_word"),
                       F.col("best.end_word").alias("end_word"))


def _scored(near: DataFrame, seeds: DataFrame, items: DataFrame, min_score: float) -> DataFrame:
    """(_k1, _k2, _id, key, item, score, start_word, end_word) of the passages' alignments."""
    near = near.withColumn("size", F.size("words"))
    place = ["_k1", "_k2", "start", "size"]
    met = (near.select(*place, F.explode("hits").alias("gram"))
               .join(seeds.select("gram", "key", "place", "need", F.when(F.col("short"), F.col("reach")).alias("whole")), "gram")
               .where(F.col("whole").isNull() | (F.col("whole") == F.col("size"))))
    pairs = (met.select(*place, "key", "need", F.col("place")).distinct()
                .groupBy(*place, "key", "need").agg(F.count("*").alias("n")).where("n >= need").select(*place, "key"))
    both = (pairs.join(near.dropDuplicates(place).select(*place, "_id", "words"), place)
                 .join(items.select("key", "item", "short", F.col("words").alias("item_words")), "key"))
    kinds = [near.schema["_id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()]

    def score(batches):
        import pyarrow as pa
        for batch in batches:
            kept, out = [], []
            columns = [batch.column(i) for i in range(5, 9)]
            for i in range(batch.num_rows):
                first, words, item, short = (c[i] for c in columns)
                least = 1.0 if short.as_py() else min_score
                share, a, b = align(item.values.to_numpy(), words.values.to_numpy(), least)
                if share >= least:
                    kept.append(i)
                    out.append((round(share, 6), first.as_py() + a, first.as_py() + b))
            at = pa.array(kept, pa.int64())
            found = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(5)), *found],
                names=["_k1", "_k2", "_id", "key", "item", "score", "start_word", "end_word"])

    return both.select("_k1", "_k2", "_id", "key", "item", "start", "words", "item_words", "short").mapInArrow(
        score, f"_k1 long, _k2 long, _id {kinds[0]}, key string, item {kinds[1]}, "
               "score double, start_word long, end_word long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
               **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    leaks = find_leaks(docs, benchmark, text, doc_id, **options).select("_k1", "_k2").distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return (rows.select("_row", *row_key("_id", "_text")).join(leaks, ["_k1", "_k2"], "left_anti")
                .select("_row.*"))
