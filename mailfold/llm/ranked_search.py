"""Ranked lexical search: sharded inverted lists searched by Block-Max MaxScore.

Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower case.
A term found ``tf`` times in a document of ``n`` terms has there the *impact*
``(10**9 tf) div (1000 tf + 20 m)``, ``m = 100 - 50 + (50 n N) div L``; a document's
score is the sum over the query's terms of weight times impact, the weight being
``floor(1000 ln((2N + 2) / (2 df + 1)))``.  All but the weight is 64-bit integer work.

1. One scan counts the documents with terms, ``N``, and their terms, ``L``.
2. A second scan writes the index.  A *shard* is a bounded run of documents of one task;
   its documents are numbered by ascending id.  A row per shard and term holds the
   list: blocks of 128 postings, each compressed by itself, with the block's last slot
   and highest impact beside it, and the list's highest impact.
3. Lists of the queries' terms join the queries, which come in tiles of bounded size,
   and are dealt out by tile and shard.  In a shard, the lists of a query are ordered
   by their bounds.  Those whose bounds together stay below the query's threshold are
   *non-essential*: documents that only they hold cannot enter the result.  The others
   are read, in windows of slots; a document found there is dropped as soon as its
   score so far, the block maxima of the non-essential lists at its slot and the
   bounds of those not yet looked at stay below the threshold, and a non-essential
   block is decompressed only where a document survives.
4. A task keeps one heap per query of its tile, so later shards start with the threshold
   of earlier ones; Spark merges the tasks' heaps by rank.

The result is exact.  Null and empty texts have no terms; null ids come last among equal
scores; repeated rows are documents of their own; items of equal id and text are one
item, items of one id and different texts are ranked each by itself; an item without a
known term returns nothing.  Empty tables give an empty result, and other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .chunks import Generations, gather, split_chunks
from .common import LOWER, UPPER, materialise, partitions, require_columns, text_slices, worker_state

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_DOCS = 1 << 16
SHARD_POSTINGS = 1 << 22
RUN = 1 << 18               # postings compressed at a time
BLOCK = 128
WINDOW = 4096
TILE_QUERIES = 256
HEAD = np.dtype([("last", "<u2"), ("top", "<u4"), ("end", "<u4")])      # of a block


class Terms:
    """The terms of white-space chunks, kept between batches."""

    def __init__(self):
        self.find = re.compile(TERM).findall
        self.lower = str.maketrans(UPPER, LOWER)
        self.seen = Generations(250_000)

    def of(self, chunk: str) -> tuple:
        known = self.seen.get(chunk)
        if known is None:
            known = self.seen.put(chunk, tuple(self.find(chunk.translate(self.lower))))
        return known


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_factor(n, n_docs: int, n_terms: int):
    return 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)


# -- compressed lists -----------------------------------------------------------------

def pack(values):
    """Variable-length bytes of non-negative integers, low seven bits first; and each one's end."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, rest = ends - size, values
    for k in range(5):
        out[at + k] = (rest & 127) | np.where(size > k + 1, 128, 0)
        more = size > k + 1
        if not more.any():
            break
        at, rest, size = at[more], rest[more] >> 7, size[more]
    return out, ends


def unpack(data):
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins)


def compressed_lists(starts, slots, tf, impacts):
    """(list tops, heads, payloads) of the lists that begin at ``starts``, their postings sorted by slot."""
    n = np.diff(np.append(starts, len(slots)))
    n_blocks = -(-n // BLOCK)
    which = np.repeat(np.arange(len(starts)), n_blocks)
    number = np.arange(len(which)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = starts[which] + BLOCK * number
    last = np.append(begin[1:], len(slots)) - 1
    gaps = np.diff(slots, prepend=0)
    gaps[begin] = slots[begin]              # a block is read without those before it
    data, ends = pack(np.stack((gaps, tf), axis=1).ravel())
    list_end = ends[2 * (starts + n) - 1]
    list_begin = np.concatenate(([0], list_end[:-1]))
    heads = np.empty(len(which), HEAD)
    heads["last"], heads["top"] = slots[last], np.maximum.reduceat(impacts, begin)
    heads["end"] = ends[2 * last + 1] - list_begin[which]
    head_end = HEAD.itemsize * np.cumsum(n_blocks)
    return (np.maximum.reduceat(impacts, starts), (heads.tobytes(), head_end), (data.tobytes(), list_end))


def binary_column(data: bytes, ends):
    import pyarrow as pa
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


# -- the index ------------------------------------------------------------------------

def corpus_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """(documents with a term, terms in all): two numbers."""
    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            n = pc.fill_null(pc.count_substring_regex(batch.column(0), TERM), 0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()),
                                              pa.array([int(n.sum(dtype=np.int64))], pa.int64())], names=["d", "t"])

    row = (docs.select(F.col(text).alias("_text")).mapInArrow(count, "d long, t long")
               .agg(F.sum("d"), F.sum("t")).first())
    return row[0] or 0, row[1] or 0


class Shard:
    """Documents gathered for one shard: their ids, lengths, terms and postings."""

    def __init__(self):
        self.names, self.ids, self.lengths, self.parts = {}, [], [], []
        self.docs = self.postings = 0

    def add(self, terms: Terms, texts, ids) -> None:
        codes, chunks, offsets = split_chunks(texts)
        names = self.names
        pieces = [np.array([names.setdefault(t, len(names)) for t in terms.of(c)], np.int64).tobytes()
                  for c in chunks]
        flat, starts = gather(codes, offsets, pieces, np.int64)
        lengths = np.diff(starts)
        slot = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        both = np.sort(flat * SHARD_DOCS + slot)
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
        tf = np.diff(np.append(first, len(both)))
        self.parts.append((both[first] + self.docs, tf.astype(np.int32)))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.docs += len(lengths)
        self.postings += len(first)

    def full(self, n_next: int) -> bool:
        return bool(self.docs) and (self.postings >= SHARD_POSTINGS or self.docs + n_next > SHARD_DOCS)

    def sorted(self):
        """(ids by slot, lengths by slot, terms, list starts, slots, tf); frees what was gathered."""
        import pyarrow as pa
        import pyarrow.compute as pc
        ids = pa.concat_arrays(self.ids)
        order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        new_slot = np.empty(self.docs, np.int64)
        new_slot[order] = np.arange(self.docs)
        lengths = np.concatenate(self.lengths)[order]
        keys = np.concatenate([p[0] for p in self.parts])
        tf = np.concatenate([p[1] for p in self.parts])
        self.parts.clear()
        keys = keys & ~0xFFFF | new_slot[keys & 0xFFFF]
        placed = np.argsort(keys, kind="stable")
        keys, tf = keys[placed], tf[placed]
        starts = np.searchsorted(keys, np.arange(len(self.names) + 1) << 16)
        return ids.take(pa.array(order)), lengths, list(self.names), starts, (keys & 0xFFFF).astype(np.int32), tf


def build_index(docs: DataFrame, n_docs: int, n_terms: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The written index: (shard, term, df, top, heads, payload) per list, and one row per
    shard with ``ids`` and ``lengths`` by slot (term null)."""
    require_columns(docs, text, doc_id)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["shard", "term", "df", "top", "heads", "payload", "ids", "lengths"]
    schema = (f"shard long, term string, df long, top long, heads binary, payload binary, "
              f"ids array<{kind}>, lengths array<int>")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        terms = worker_state("ranked-search", Terms)
        number, shard, id_type = TaskContext.get().partitionId() << 32, Shard(), None

        def rows(n, **given):
            kinds = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(),
                                     pa.list_(id_type), pa.list_(pa.int32())]))
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, kinds[c])).cast(kinds[c]) for c in names],
                                              names=names)

        def close():
            if not shard.docs:
                return
            ids, lengths, found, starts, slots, tf = shard.sorted()
            one = pa.array([0, len(ids)], pa.int32())
            yield rows(1, shard=pa.array([number]), ids=pa.ListArray.from_arrays(one, ids),
                       lengths=pa.ListArray.from_arrays(one, pa.array(lengths.astype(np.int32))))
            m = length_factor(lengths, n_docs, n_terms)
            first = 0
            while first < len(found):           # a run of lists at a time
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + RUN, side="right")) - 1)
                last = min(last, first + 20_000)
                own, own_tf = slots[starts[first]:starts[last]].astype(np.int64), tf[starts[first]:starts[last]].astype(np.int64)
                begin = starts[first:last] - starts[first]
                tops, heads, payload = compressed_lists(begin, own, own_tf, impact(own_tf, m[own]))
                yield rows(last - first, shard=pa.array(np.full(last - first, number)),
                           term=pa.array(found[first:last]), df=pa.array(np.diff(starts[first:last + 1])),
                           top=pa.array(tops), heads=binary_column(*heads), payload=binary_column(*payload))
                first = last

        for whole in batches:
            id_type = whole.schema.field(0).type
            for batch in text_slices(whole, "_text"):
                for at in range(0, batch.num_rows, SHARD_DOCS):
                    part = batch.slice(at, SHARD_DOCS)
                    if shard.full(part.num_rows):
                        yield from close()
                        number, shard = number + 1, Shard()
                    shard.add(terms, part.column(1), part.column(0))
        yield from close()

    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
    return materialise(found, "ranked-index")


# -- the queries ----------------------------------------------------------------------

def query_terms(items: DataFrame, text: str, item_id: str, tile_queries: int) -> DataFrame:
    """(tile, query, item, term), each term of a query once; tiles of about ``tile_queries``."""
    kind = items.schema[item_id].dataType.simpleString()

    def split(batches):
        import pyarrow as pa
        terms = Terms()
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                codes, chunks, offsets = split_chunks(batch.column(1))
                each = [sorted({t for c in codes[a:b].tolist() for t in terms.of(chunks[c])})
                        for a, b in zip(offsets, offsets[1:])]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(e) for e in each]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at),
                     pa.array([t for e in each for t in e], pa.string())],
                    names=["item", "tile", "query", "term"])

    own = items.select(F.col(item_id).alias("item"), F.col(text).alias("_text")).distinct()
    n_tiles = max(1, -(-own.count() // tile_queries))
    key = F.xxhash64("item", "_text", F.col("item").isNull(), F.col("_text").isNull())
    second = F.xxhash64(F.lit("query"), "item", "_text", F.col("_text").isNull())
    keyed = own.select("item", "_text", F.pmod(key, F.lit(n_tiles)).alias("tile"),
                       F.concat_ws(":", key, second).alias("query"))
    return materialise(keyed.mapInArrow(split, f"item {kind}, tile long, query string, term string"), "ranked-queries")


class List:
    """One inverted list of a shard; blocks are decompressed when first asked for."""

    def __init__(self, top: int, heads: bytes, payload: bytes, m):
        self.top = top
        self.heads = np.frombuffer(heads, HEAD)
        self.last = self.heads["last"].astype(np.int64)
        self.tops = self.heads["top"].astype(np.int64)
        self.ends = self.heads["end"].tolist()
        self.payload, self.m, self.held = payload, m, {}

    def block(self, k: int):
        known = self.held.get(k)
        if known is None:
            begin = self.ends[k - 1] if k else 0
            both = unpack(np.frombuffer(self.payload, np.uint8)[begin:self.ends[k]])
            slots, tf = np.cumsum(both[::2]), both[1::2]
            known = self.held[k] = slots, impact(tf, self.m[slots])
        return known

    def blocks(self, which):
        found = [self.block(int(k)) for k in which]
        if len(found) == 1:
            return found[0]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def search_shard(lists, size: int, k: int, threshold: int, window: int = WINDOW):
    """The best ``k`` (slots, scores) of one query in a shard, none below ``threshold``.

    ``lists``: (weight, List) pairs.  Equal scores keep the lower slots.
    """
    lists = sorted(((w, of) for w, of in lists if w * of.top > 0), key=lambda x: x[0] * x[1].top)
    bounds = np.cumsum([0] + [w * of.top for w, of in lists])      # bounds[i]: of the lists below i together
    slots, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    threshold = max(threshold, 1)
    for low in range(0, size, window):
        high = min(low + window, size)
        essential = int(np.searchsorted(bounds[1:], threshold))    # lists below: non-essential
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for weight, of in lists[essential:]:
            first, last = np.searchsorted(of.last, (low, high - 1))
            if first == len(of.last):
                continue
            at, gained = of.blocks(range(first, min(last, len(of.last) - 1) + 1))
            a, b = np.searchsorted(at, (low, high))
            sums[at[a:b] - low] += weight * gained[a:b]
        here = np.flatnonzero(sums)
        here = here[sums[here] + bounds[essential] >= threshold]
        for i in range(essential - 1, -1, -1):
            if not len(here):
                break
            weight, of = lists[i]
            block = np.searchsorted(of.last, here + low)
            inside = block < len(of.last)
            tops = np.where(inside, of.tops[np.minimum(block, len(of.last) - 1)], 0)
            alive = sums[here] + weight * tops + bounds[i] >= threshold      # before decompression
            here, block, inside = here[alive], block[alive], inside[alive]
            if not inside.any():
                continue
            at, gained = of.blocks(np.unique(block[inside]))
            place = np.minimum(np.searchsorted(at, here + low), len(at) - 1)
            sums[here] += np.where(at[place] == here + low, weight * gained[place], 0)
            here = here[sums[here] + bounds[i] >= threshold]
        here = here[sums[here] >= threshold]
        slots, scores = np.concatenate((slots, here + low)), np.concatenate((scores, sums[here]))
        if len(slots) > k:
            best = np.lexsort((slots, -scores))[:k]
            slots, scores = slots[best], scores[best]
        if len(slots) == k:
            threshold = max(threshold, int(scores.min()))
    best = np.lexsort((slots, -scores))
    return slots[best], scores[best]


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id", tile_queries: int = TILE_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    require_columns(items, item_text, item_id)
    n_docs, n_terms = corpus_size(docs, text)
    index = build_index(docs, n_docs, n_terms, text, doc_id)
    return search_index(index, n_docs, n_terms, items, k, doc_id, item_text, item_id, tile_queries)


def search_index(index: DataFrame, n_docs: int, n_terms: int, items: DataFrame, k: int = 50, doc_id: str = "doc_id",
                 item_text: str = "text", item_id: str = "item_id", tile_queries: int = TILE_QUERIES) -> DataFrame:
    asked = query_terms(items, item_text, item_id, tile_queries)
    lists = index.where("term is not null")
    terms = asked.select("term").distinct()
    df = lists.select("term", "df").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = materialise(df.select("term", weight.alias("weight")), "ranked-weights")
    wanted = asked.groupBy("tile", "term").agg(F.collect_set("query").alias("queries")).join(weighed, "term")
    own = materialise(lists.select("shard", "term", "top", "heads", "payload").join(wanted, "term").select(
        "tile", "shard", "weight", "queries", "top", "heads", "payload"), "ranked-lists")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in own.schema[2:]}
    of_shards = (index.where("term is null").select("shard", "ids", "lengths")
                      .join(own.select("tile", "shard").distinct(), "shard").withColumns(blank))
    empty = {c: F.lit(None).cast(index.schema[c].dataType) for c in ("ids", "lengths")}
    columns = [*own.columns, "ids", "lengths"]
    dealt = (own.withColumns(empty).select(columns).unionByName(of_shards.select(columns))
                .repartition(partitions(index.sparkSession), "tile", "shard")
                .sortWithinPartitions("tile", "shard", F.col("weight").asc_nulls_first()))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa
        best, shard, of_query, tile, id_type = {}, None, {}, None, None

        def order(hit):
            return -hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0

        def finish():
            """One shard: search it for every query that has lists in it."""
            ids, size = shard[2], len(shard[3])
            for query, own in of_query.items():
                heap = best.setdefault(query, [])
                slots, scores = search_shard(own, size, k, heap[-1][0] if len(heap) == k else 1)
                if len(slots):
                    heap += [(s, ids[at].as_py()) for at, s in zip(slots.tolist(), scores.tolist())]
                    heap.sort(key=order)
                    del heap[k:]
            of_query.clear()

        def heaps():
            hits = [(query, d, s) for query, heap in best.items() for s, d in heap]
            best.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.string(), id_type, pa.int64()))],
                names=["query", "_id", "score"])

        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            places = zip(columns["tile"].to_pylist(), columns["shard"].to_pylist())
            for i, place in enumerate(places):
                if shard is None or shard[:2] != place:
                    if shard is not None:
                        finish()
                        if place[0] != tile:
                            yield heaps()
                    tile = place[0]
                    # the row without a weight comes first: ids and lengths by slot
                    lengths = columns["lengths"][i].values.to_numpy().astype(np.int64)
                    shard = (*place, columns["ids"][i].values, length_factor(lengths, n_docs, n_terms))
                    continue
                held = List(*(columns[c][i].as_py() for c in ("top", "heads", "payload")), shard[3])
                weight = columns["weight"][i].as_py()
                for query in columns["queries"][i].as_py():
                    of_query.setdefault(query, []).append((weight, held))
        if shard is not None:
            finish()
            yield heaps()

    hits = dealt.mapInArrow(run, f"query string, _id {kind}, score long")
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    named = asked.select("query", F.col("item").alias(item_id)).distinct()
    return (hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
                .join(named, "query").select(item_id, "rank", F.col("_id").alias(doc_id), "score"))
