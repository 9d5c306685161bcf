"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the same bytes (a space and the text).  Places where a token of
both ends cut them into *groups*; every pair of an A and a B token whose bytes
overlap is a *link*.  The links of an id pair are counted over the corpus:

1. Documents are numbered by block and slot (a block is at most 65,536 documents of
   one task).  For each block and id pair, one compressed bitmap holds the slots of
   the documents with the pair, and *multiplicity planes* hold, bit by bit, how many
   links beyond the first a document has.  The bitmaps of a block's slices are
   OR-merged before they are written; blocks are disjoint.
2. A pair's documents are the popcount of its bitmap, its links the popcounts of
   bitmap and planes by their weights; Spark adds them over the blocks, and takes
   the highest count of each B id.
3. The bitmaps are the postings by which the counts return: every block's bitmaps
   are unfolded once and each pair's count is added to the slots that hold it.

White space after other characters starts a token in both tokenizers, so a text is
cut there into chunks; tokens, groups and links of a distinct chunk are worked out
once.  An executor's memory is bounded by ``BLOCK_LINKS`` and one text; a pair has
one row per block, so no key is hotter than the number of blocks.

Texts that are null or empty, or whose tokens do not spell the bytes (such as those
with U+2581, which B writes for a space), have no tokens: zeros and an empty
``groups`` text.  Repeated rows and ties are rows and ties like any other: each row
is a document and each id pair with the highest count of its B id is a best one.
An empty table gives an empty result; columns beside the two used are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import sys

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_letters
from .chunks import Generations, gather
from .common import materialise, require_columns, text_slices, worker_state

BLOCK_DOCS = 1 << 16
BLOCK_LINKS = 1 << 22       # document and pair combinations in a block, before its last slice
RUN_CHUNKS = 64             # encoded together
PAIR = "a int, b int"
LIST, BITS = 0, 1           # first byte of a bitmap: a list of slots, or a bit for each slot


class Aligner:
    """Tokens, groups and links of chunks; both tokenizers come as their files' content."""

    def __init__(self, byte_spec: str, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        code = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocabulary = json.loads(byte_spec)["model"]["vocab"]
        spelt = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if all(c in code for c in piece):
                spelt[i] = bytes(code[c] for c in piece)
        self.a_bytes = Spelling(spelt)
        self.b_bytes = Spelling([self._piece_bytes(i) for i in range(self.b.get_piece_size())])
        n = max(len(spelt), self.b.get_piece_size())
        self.written = Spelling([f"{i}{mark}".encode() for i in range(n) for mark in ",|;"])
        self.seen = Generations(400_000)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's number of A tokens, A ids and B ids, as 32-bit integers.

        Chunks are encoded in runs, since no token spans two of them; a run ends after
        a chunk that ends in white space or holds B's blank, which stands alone.  The
        bytes that the tokens spell tell the chunks of a run apart.
        """
        sizes = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        runs, first = [], 0
        for i, c in enumerate(chunks):
            alone = "▁" in c
            if alone and first < i:
                runs.append((first, i))
                first = i
            if alone or i + 1 - first == RUN_CHUNKS or c[-1].isspace() or i + 1 == len(chunks):
                runs.append((first, i + 1))
                first = i + 1
        texts = ["".join(chunks[a:b]) for a, b in runs]
        a_ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a blank before what it is given: a letter takes it, and both are left out again
        b_ids = self.b.encode(["x" + t for t in texts], num_threads=1)
        of_a = self._apart(a_ids, self.a_bytes, runs, sizes, 0)
        of_b = self._apart(b_ids, self.b_bytes, runs, sizes, 2)
        return [(len(a) // 4).to_bytes(4, sys.byteorder) + a + b for a, b in zip(of_a, of_b)]

    @staticmethod
    def _apart(ids, spelling, runs, sizes, before: int) -> list[bytes]:
        """The ids of each chunk; ``before``: the bytes in front of each run."""
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n_ids.sum()))
        ends = np.cumsum(spelling.size[flat])
        run_end = np.cumsum(n_ids)
        base = np.concatenate(([0], ends))[run_end - n_ids]         # bytes before each run's tokens
        first, last = np.array(runs).T
        chunk_end = np.cumsum(sizes)
        run_of = np.repeat(np.arange(len(runs)), last - first)
        cut = base[run_of] + before + chunk_end - (chunk_end - sizes)[first][run_of]
        stop = np.minimum(np.searchsorted(ends, cut, side="right"), run_end[run_of])
        stop[last - 1] = run_end                                    # whatever the tokens spell, they are the run's
        begin = np.concatenate(([0], stop[:-1]))
        begin[first] = np.searchsorted(ends, base + before, side="right") if before else run_end - n_ids
        data = flat.tobytes()
        return [data[4 * i:4 * j] for i, j in zip(begin.tolist(), stop.tolist())]

    def tokens(self, chunks: list[str]) -> list[bytes]:
        """For each chunk its number of A tokens, the A ids and the B ids, as 32-bit integers."""
        seen = self.seen
        found = [seen.new.get(c) or seen.get(c) for c in chunks]
        new = [i for i, known in enumerate(found) if known is None]
        for k in range(0, len(new), 1 << 14):
            at = new[k:k + (1 << 14)]
            run = [chunks[i] for i in at]
            for i, c, ids in zip(at, run, self._encode(run)):
                found[i] = seen.put(c, ids)
        return found

    def align(self, chunks):
        """(right, n_a, n_b, n_groups, link keys, their chunks, groups) of an Arrow array of chunks.

        ``right``: whether the tokens of both spell the chunk; the others have none.
        The ends of all tokens cut the bytes into intervals, each within one A and one
        B token: the links.
        """
        import pyarrow.compute as pc
        n = len(chunks)
        packed = self.tokens(chunks.to_pylist())
        flat = np.frombuffer(b"".join(packed), np.int32)
        size = np.fromiter(map(len, packed), np.int64, n) // 4
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(n), size)
        place = np.arange(len(flat)) - first[owner]
        side_b = place > flat[first][owner]
        side_a = (place > 0) & ~side_b
        a, b, of_a, of_b = flat[side_a], flat[side_b], owner[side_a], owner[side_b]
        plain = pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset:chunks.offset + n + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if n else np.empty(0, np.uint8)
        right = np.ones(n, bool)
        for ids, of, spelling in ((a, of_a, self.a_bytes), (b, of_b, self.b_bytes)):
            right &= np.bincount(of, spelling.size[ids], n).astype(np.int64) == plain
        at = np.repeat(np.arange(n), plain)
        for ids, of, spelling in ((a, of_a, self.a_bytes), (b, of_b, self.b_bytes)):
            whole = right.copy()
            wrong = spelling.bytes(ids[whole[of]]) != data[whole[at]]
            right[at[whole[at]][wrong]] = False
        a, b, of_a, of_b = a[right[of_a]], b[right[of_b]], of_a[right[of_a]], of_b[right[of_b]]
        end_a, end_b = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        ends = np.sort(np.concatenate((end_a, end_b)), kind="stable")       # two sorted runs
        ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[i] == ends) & (end_b[j] == ends)
        links = a[i].astype(np.uint64) << np.uint64(32) | b[j].astype(np.uint64)
        # groups written out: A's ids, then B's, with the mark behind each
        group = 2 * np.concatenate((np.searchsorted(ends[both], end_a), np.searchsorted(ends[both], end_b)))
        group[len(a):] += 1
        order = np.argsort(group, kind="stable")
        group = group[order]
        last = np.concatenate((group[1:] != group[:-1], [True])) if len(group) else np.empty(0, bool)
        items = 3 * np.concatenate((a, b))[order].astype(np.int64) + np.where(last, 1 + group % 2, 0)
        sizes = np.bincount(np.concatenate((of_a, of_b))[order], self.written.size[items], n).astype(np.int64)
        text, cuts = self.written.bytes(items).tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist()
        return (right, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n),
                np.bincount(of_a[i[both]], minlength=n), links, of_a[i],
                [text[x:y] for x, y in zip(cuts, cuts[1:])])


class Spelling:
    """The bytes of numbered strings, joined for arrays of numbers."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([*map(len, strings)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(strings), np.uint8)

    def bytes(self, numbers):
        size = self.size[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.all[np.repeat(self.begin[numbers] - (ends - size), size) + np.arange(total)]


def cut(texts):
    """(codes, distinct chunks, row offsets) of an Arrow string array; each row is a space and its text.

    A chunk begins at a space or line end after a character that is surely no white
    space (in doubt the chunk goes on), so no token spans two chunks.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    blank, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(blank, filled, space)
    spaced = pa.concat_arrays([spaced]) if spaced.offset else spaced
    rows = np.frombuffer(spaced.buffers()[1], np.int64)[:len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[:rows[-1]]
    before = np.concatenate(([32], data[:-1]))
    firm = before > 32
    # after a character of several bytes: not one of the blocks with white space in them
    wide = np.flatnonzero((before >= 128) & ((data == 32) | (data == 10)))
    if len(wide):
        two, three = data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        firm[wide] = (two != 0xC2) & (three != 0xE1) & (three != 0xE2) & (three != 0xE3)
    begins = ((data == 32) | (data == 10)) & firm
    begins[rows[:-1]] = True
    at = np.flatnonzero(begins)
    flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, rows[-1])), spaced.buffers()[2])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary, np.searchsorted(at, rows)


# -- bitmaps ------------------------------------------------------------------------

def bitmaps(pair, slots, n_pairs: int) -> list[bytes]:
    """A compressed bitmap of the slots of each pair (both sorted); empty where it has none."""
    ends = np.searchsorted(pair, np.arange(n_pairs + 1)).tolist()
    low = slots.astype("<u2").tobytes()
    found = []
    for begin, end in zip(ends, ends[1:]):
        if begin == end:
            found.append(b"")
        elif 2 * (end - begin) <= (int(slots[end - 1]) >> 3) + 1:
            found.append(b"\0" + low[2 * begin:2 * end])
        else:
            bits = np.zeros(int(slots[end - 1]) + 1, np.uint8)
            bits[slots[begin:end]] = 1
            found.append(b"\1" + np.packbits(bits, bitorder="little").tobytes())
    return found


def slots_of(bitmap: bytes):
    if bitmap[0] == LIST:
        return np.frombuffer(bitmap, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little")).astype("<u2")


def popcount(bitmap):
    """The set bits of a compressed bitmap, as a column."""
    rest = F.expr(f"substring({bitmap}, 2)") if isinstance(bitmap, str) else F.substring(bitmap, 2, 1 << 30)
    col = F.col(bitmap) if isinstance(bitmap, str) else bitmap
    return (F.when(F.length(col) == 0, 0)
             .when(F.substring(col, 1, 1) == F.lit(bytes([LIST])), ((F.length(col) - 1) / 2).cast("long"))
             .otherwise(F.bitmap_count(rest)))


class Block:
    """The slices of one block: the slots and multiplicities of their id pairs."""

    def __init__(self):
        self.docs, self.links, self.parts = 0, 0, []

    def add(self, codes, keys, starts) -> None:
        """Links of a slice: ``keys[codes]`` in text order, ``starts`` of its documents."""
        n = len(starts) - 1
        slot = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
        both = np.sort(codes.astype(np.int64) * max(n, 1) + slot)
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(both)))
        pair, slot = np.divmod(both[first], max(n, 1))
        self.parts.append((keys, pair.astype(np.int32), (slot + self.docs).astype(np.uint16), times))
        self.docs += n
        self.links += len(first)

    def full(self, n_next: int) -> bool:
        return bool(self.docs) and (self.links >= BLOCK_LINKS or self.docs + n_next > BLOCK_DOCS)

    def merged(self):
        """(pair keys, bitmaps, planes): the slices' bitmaps OR-merged; their slots are disjoint."""
        keys = np.unique(np.concatenate([p[0] for p in self.parts]))
        pair = np.concatenate([np.searchsorted(keys, p[0])[p[1]] for p in self.parts])
        order = np.argsort(pair, kind="stable")         # slots ascend from slice to slice
        pair = pair[order]
        slots = np.concatenate([p[2] for p in self.parts])[order]
        more = np.concatenate([p[3] for p in self.parts])[order] - 1
        planes = []
        while more.any():
            odd = (more & 1).astype(bool)
            planes.append(bitmaps(pair[odd], slots[odd], len(keys)))
            more >>= 1
        found = bitmaps(pair, slots, len(keys))
        used = [[] for _ in found]
        for k, plane in enumerate(planes):
            for i, b in enumerate(plane):
                if b:
                    used[i] += [b""] * (k - len(used[i])) + [b]
        return keys, found, used


# -- Spark jobs ---------------------------------------------------------------------

def index_pairs(docs: DataFrame, byte_spec: str, piece_model: bytes, text: str, doc_id: str,
                with_groups: bool = False) -> DataFrame:
    """One written table: a row per document (a is null) and one per block and id pair."""
    require_columns(docs, text, doc_id)
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((byte_spec, piece_model))
    key = hashlib.sha256(byte_spec.encode() + piece_model).digest()
    names = ["block", "slot", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups",
             "a", "b", "docs", "planes"]
    schema = (f"block long, slot int, _id {kind}, n_a long, n_b long, n_groups long, n_links long, "
              f"groups_sha256 string, groups string, {PAIR}, docs binary, planes array<binary>")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        of = worker_state(("alignment", key), lambda: Aligner(*shared.value))
        types = [pa.int64(), pa.int32(), None, *[pa.int64()] * 4, pa.string(), pa.string(),
                 pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())]
        number, block = TaskContext.get().partitionId() << 32, Block()

        def rows(n, **given):
            kinds = dict(zip(names, types)) | {"_id": id_type}
            return pa.RecordBatch.from_arrays(
                [given[c].cast(kinds[c]) if c in given else pa.nulls(n, kinds[c]) for c in names], names=names)

        def close():
            if block.docs:
                keys, found, planes = block.merged()
                for k in range(0, len(keys), 20_000):
                    part = keys[k:k + 20_000]
                    yield rows(len(part), block=pa.array(np.full(len(part), number)),
                               a=pa.array((part >> np.uint64(32)).astype(np.int32)),
                               b=pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                               docs=pa.array(found[k:k + 20_000], pa.binary()),
                               planes=pa.array(planes[k:k + 20_000], pa.list_(pa.binary())))

        id_type = None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for batch in text_slices(whole, "_text"):
                for at in range(0, batch.num_rows, BLOCK_DOCS):
                    part = batch.slice(at, BLOCK_DOCS)
                    if block.full(part.num_rows):
                        yield from close()
                        number, block = number + 1, Block()
                    figures, links, starts = _slice(of, part.column(1), with_groups)
                    base = block.docs
                    block.add(*links, starts)
                    yield rows(part.num_rows, block=pa.array(np.full(part.num_rows, number)),
                               slot=pa.array(np.arange(base, base + part.num_rows)), _id=part.column(0), **figures)
        yield from close()

    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
    return materialise(found, "alignment")


def _slice(of: Aligner, texts, with_groups: bool):
    """Figures of each text, and the links of all of them."""
    import pyarrow as pa
    import pyarrow.compute as pc
    codes, chunks, offsets = cut(texts)
    right, *counts, links, of_link, groups = of.align(chunks)
    n_chunks = np.diff(offsets)
    row = np.repeat(np.arange(len(texts)), n_chunks)
    spelt = np.bincount(row, ~right[codes], len(texts)) == 0
    spelt &= pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
    figures = {}
    for name, each in zip(("n_a", "n_b", "n_groups"), counts):
        figures[name] = pa.array(np.where(spelt, np.bincount(row, each[codes], len(texts)), 0).astype(np.int64))
    used = spelt[row]
    in_use = (np.bincount(codes[used], minlength=len(chunks)) > 0)[of_link]
    keys, inverse = np.unique(links[in_use], return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum(np.bincount(of_link[in_use], minlength=len(chunks))))).tolist()
    inverse = inverse.astype("<i4").tobytes()
    flat, starts = gather(codes[used], np.concatenate(([0], np.cumsum(np.where(spelt, n_chunks, 0)))),
                          [inverse[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])], "<i4")
    figures["n_links"] = pa.array(np.diff(starts))
    digests, written = [], []
    for i in range(len(texts)):
        text = b"".join([groups[c] for c in codes[offsets[i]:offsets[i + 1]].tolist()])[:-1] if spelt[i] else b""
        digests.append(hashlib.sha256(text).hexdigest() if spelt[i] else "")
        written.append(text.decode() if with_groups else None)
    figures["groups_sha256"] = pa.array(digests, pa.string())
    figures["groups"] = pa.array(written, pa.string())
    return figures, (flat, keys), starts


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): corpus-wide popcounts; ``best``: the highest of its B id."""
    weigh = F.aggregate(
        F.transform("planes", lambda p, k: popcount(p) * F.pow(F.lit(2.0), k).cast("long")),
        F.lit(0).cast("long"), lambda x, y: x + y)
    n_docs = popcount("docs").cast("long")
    each = index.where("a is not null").select("a", "b", n_docs.alias("n"), (n_docs + weigh).alias("links"))
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("n_docs"), F.sum("links").alias("n_links"))
    counts = materialise(counts, "alignment-counts")
    top = counts.groupBy("b").agg(F.max("n_links").alias("top"))
    return counts.join(top.hint("merge"), "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, slot, n_best, count_sum): the pairs' counts returned along their postings."""
    postings = index.where("a is not null").select("block", "a", "b", "docs", "planes")
    # the same join at every size: neither side has a proven bound
    scored = postings.join(counts.select("a", "b", "n_links", "best").hint("merge"), ["a", "b"])

    def unfold(table):
        import pyarrow as pa
        sums, bests = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

        def add(maps, counts, best, weight):
            held = [i for i, m in enumerate(maps) if m]
            slots = [slots_of(maps[i]) for i in held]
            if held:
                size = np.fromiter(map(len, slots), np.int64, len(slots))
                flat = np.concatenate(slots)
                np.add.at(sums, flat, np.repeat(counts[held] * weight, size))
                np.add.at(bests, flat, np.repeat(best[held] * weight, size))
                return flat
            return np.empty(0, np.uint16)

        counts = table["n_links"].to_numpy().astype(np.int64)
        best = table["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        used = np.unique(add(table["docs"].to_pylist(), counts, best, 1))
        planes = table["planes"].to_pylist()
        for k in range(max(map(len, planes), default=0)):
            add([p[k] if k < len(p) else b"" for p in planes], counts, best, 1 << k)
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array(np.full(len(used), block)), "slot": pa.array(used.astype(np.int32)),
                         "n_best": pa.array(bests[used]), "count_sum": pa.array(sums[used])})

    return (scored.select("block", "docs", "planes", "n_links", "best")
                  .groupBy("block").applyInArrow(unfold, "block long, slot int, n_best long, count_sum long"))


def align_documents(docs: DataFrame, byte_spec: str, piece_model: bytes, text: str = "text",
                    doc_id: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and ``groups`` if asked for)."""
    index = index_pairs(docs, byte_spec, piece_model, text, doc_id, with_groups)
    found = scores(index, pair_counts(index))
    rows = index.where("a is null").join(found, ["block", "slot"], "left")
    return rows.select(F.col("_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links",
                       F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
                       F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256",
                       *(["groups"] if with_groups else []))
