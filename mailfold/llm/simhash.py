"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight byte positions.  Two fingerprints that differ
in at most k bits differ in at most k bytes, so they share at least 8 - k
positional bytes: the guaranteed minimum matches.  The lists of single bytes
would each hold 1/256 of the corpus, so they are intersected beforehand:
every fingerprint is posted under each set of 8 - k positions with the bytes
it has there (28 lists of 48 bits for k = 2).  Inside a list each pair's shared
positional bytes are tallied; a pair that reaches the minimum is retained in
the first list that it shares, so it comes out once, and its bit distance is
verified.

Only distinct fingerprints are posted, so a list holds at most 256**k of them
whatever the size of a group of copies, and a fingerprint has at most
C(64,1) + C(64,2) links for k = 2: neither candidates nor links grow with the
square of a group.  Lists beyond ``SMALL_LIST`` members look up their members'
possible partners instead of comparing all pairs; both ways give the same links.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased.
A null, empty or blank text has the fingerprint zero, which links like any
other.  Rows with a null id get a fingerprint and a component, but are nobody's
smallest id (a component of such rows alone has a null id).  Repeated rows are
copies like others; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, require_columns, row_key, text_slices
from .components import connected_components

SEED = 42
SMALL_LIST = 32
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[size - 1:]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(ends), HASHES_AT_ONCE):
        spans = zip(starts[lo:lo + HASHES_AT_ONCE], ends[lo:lo + HASHES_AT_ONCE])
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
                    .sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns with ``_fp``, the fingerprint's bits as a signed long."""
    require_columns(docs, text, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    width = len(keep)

    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(width)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(width)), pa.array(found.view(np.int64))],
                    names=[*keep, "_fp"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, _fp long")


# -- the index ------------------------------------------------------------------

def position_sets(max_bits: int):
    return list(combinations(range(8), 8 - max_bits))


def _mask(positions) -> int:
    bits = sum(0xFF << (8 * p) for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def _first_sets(max_bits: int):
    """For each pattern of shared positions, the first set it contains (-1: too few shared)."""
    sets = [sum(1 << p for p in s) for s in position_sets(max_bits)]
    return np.array([next((i for i, s in enumerate(sets) if shared & s == s), -1)
                     for shared in range(256)], np.int16)


def _flips(positions, max_bits: int):
    """All changes of at most ``max_bits`` bits outside ``positions``."""
    free = [8 * p + b for p in range(8) if p not in positions for b in range(8)]
    return [sum(1 << b for b in bits) for n in range(1, max_bits + 1) for bits in combinations(free, n)]


def _linked(a, b, number, first_sets, max_bits: int):
    """Count filter and verification of candidate pairs of list ``number``."""
    apart = a ^ b
    shared = np.packbits((apart.view(np.uint8).reshape(-1, 8) == 0), axis=1, bitorder="little").ravel()
    retained = first_sets[shared] == number          # enough shared bytes, and this list is the first
    return retained & (np.bitwise_count(apart) <= max_bits)


def link_fingerprints(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) of all pairs of different fingerprints within ``max_bits`` bits, each once.

    ``distinct`` has one row per fingerprint in ``_fp``.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits from 0 to 3: a list may hold 256**max_bits fingerprints")
    sets = position_sets(max_bits)
    lists = [F.col("_fp").bitwiseAND(F.lit(_mask(s))) for s in sets]
    postings = (distinct.select("_fp", F.posexplode(F.array(*lists)).alias("_list", "_bytes"))
                        .repartition("_list", "_bytes").sortWithinPartitions("_list", "_bytes"))
    small = SMALL_LIST

    def compare(batches):
        import pyarrow as pa
        first_sets = _first_sets(max_bits)

        def links_of(number, held, fp):
            """Links inside the complete lists that these postings hold."""
            new = np.flatnonzero((np.diff(number) != 0) | (np.diff(held) != 0)) + 1
            starts = np.concatenate(([0], new))
            sizes = np.diff(np.concatenate((starts, [len(fp)])))
            of = np.repeat(np.arange(len(starts)), sizes)
            pairs = []
            few = np.flatnonzero((sizes[of] > 1) & (sizes[of] <= small))
            n, g, f = number[few], of[few], fp[few]
            for lag in range(1, small):
                near = np.flatnonzero(g[:-lag] == g[lag:]) if lag < len(g) else []
                if not len(near):
                    break
                a, b = f[near], f[near + lag]
                ok = _linked(a, b, n[near], first_sets, max_bits)
                pairs.append((a[ok], b[ok]))
            for k in np.flatnonzero(sizes > small):
                members = np.sort(fp[starts[k]:starts[k] + sizes[k]])
                for flip in _flips(sets[number[starts[k]]], max_bits):
                    partner = members ^ np.uint64(flip)
                    at = np.minimum(np.searchsorted(members, partner), len(members) - 1)
                    ok = (members[at] == partner) & (members < partner)
                    a, b = members[ok], partner[ok]
                    ok = _linked(a, b, number[starts[k]], first_sets, max_bits)
                    pairs.append((a[ok], b[ok]))
            return pairs

        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        names = ["a", "b"]

        def batch_of(pairs):
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = (batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64),
                       batch.column(2).to_numpy(zero_copy_only=False),
                       batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held = tuple(np.concatenate(x) for x in zip(held, columns))
            # the last list may go on in the next batch
            cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            done = int(cut[-1]) + 1 if len(cut) else 0
            if done:
                yield batch_of(links_of(*(x[:done] for x in held)))
                held = tuple(x[done:] for x in held)
        if len(held[2]):
            yield batch_of(links_of(*held))

    return postings.mapInArrow(compare, "a long, b long")


def classes_of(marked: DataFrame, doc_id: str, max_bits: int) -> DataFrame:
    """(_fp, root, component_id) of the fingerprints of ``marked`` (``_fp`` and ids): the
    component's least fingerprint and smallest id."""
    distinct = marked.groupBy("_fp").agg(F.min(doc_id).alias("_least"))
    links = link_fingerprints(distinct.select("_fp"), max_bits)
    roots = connected_components(links, "simhash")
    linked = materialise(roots.join(distinct, roots.node == distinct["_fp"])
                              .select("_fp", "root", "_least"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("_least").alias("_component"))
    named = linked.join(least, "root").select("_fp", "root", "_component")
    # a written table of its own: the joins with it then split a fingerprint that many rows share
    return materialise(distinct.join(named, "_fp", "left").select(
        "_fp", F.coalesce("root", "_fp").alias("root"), F.coalesce("_component", "_least").alias("component_id")),
        "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = materialise(fingerprints(docs, shingle, text, (doc_id,)), "simhash-fingerprints")
    classes = classes_of(marked, doc_id, max_bits)
    return marked.join(classes, "_fp").select(
        doc_id, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text",
                         doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id's, of its texts the first by hash.

    Rows of one id whose texts are in different components each stand for their own.
    Rows without an id cannot be named as anyone's copy and stay.
    """
    keyed = docs.select(*row_key(doc_id, text), F.col(doc_id).alias("_id"), F.col(text).alias("_text"),
                        F.struct("*").alias("_row"))
    marked = materialise(fingerprints(keyed, shingle, "_text", ("_k1", "_k2", "_id")), "simhash-fingerprints")
    classes = classes_of(marked, "_id", max_bits)
    # the least row key of the smallest id stands for the component
    least = (marked.where("_id is not null").join(classes, "_fp").where(F.col("component_id") == F.col("_id"))
                   .groupBy("root").agg(F.min(F.struct("_k1", "_k2")).alias("_k")).select("_k.*"))
    first = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    chosen = (keyed.where("_id is not null").join(least, ["_k1", "_k2"], "left_semi")
                   .withColumn("_n", F.row_number().over(first)).where("_n = 1"))
    return chosen.select("_row.*").unionByName(keyed.where("_id is null").select("_row.*"))
