"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file holds the ids of its documents end to end as little-endian unsigned
32-bit integers, cut into frames of about ``frame_ids`` ids.  Layout:

* data frames, each a complete zstandard frame with a content checksum;
* one skippable frame with the document index: for each document its id, its
  null flag and its number of ids (zstandard-compressed, its checksum inside), or,
  where the ids are no integers, an Arrow stream of ids and numbers;
* one skippable frame with the seek table, in the public "seekable format":
  compressed size, decompressed size and the low 32 bits of the XXH64 of each
  data frame, then the footer (number of frames, flags, magic number).

Any zstandard tool decompresses a file to the plain stream of ids.  A reader
takes the footer, the seek table and the index from the end, and decompresses
only the frames that overlap the documents asked for; both checksums are
verified.  A document may span several frames, so neither side ever holds more
than one frame beside the ids handed out.

Writing: rows are range-partitioned by document id (with a hash of the text as
tie-breaker, so that a run of equal or null ids can be split) and sorted; each
task writes one file under a name of its own attempt and moves it into place,
so a task that runs twice leaves one whole file.  Documents lie in ascending id
order across the files, nulls first; equal ids are ordered by text.  Empty
partitions write no file; an empty table writes none and reads back as no rows.
A null or empty text is a document of the end id alone.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import sys
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..session import shared_dir
from .bpe import Words
from .chunks import Generations, gather, split_chunks
from .common import materialise, require_columns, text_slices, worker_state

# Fixed values of the public formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_ARROW_INDEX = 0x184D2A51
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = "<IBI"
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_ids", "<u8")])
HEAD = "<II"

FRAME_IDS = 1 << 16
MARKS = ".,;:!?"
#: A word of letters that NFC leaves alone and that have one lower-case letter, perhaps with a mark behind.
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[{MARKS}]?$"


class LibraryEncoder(Words):
    """The tokenizers library, called on what is new to this worker: its BPE model on the
    words of ordinary chunks, its whole pipeline on chunks that may hold a special token."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.marks = tuple({t["content"][:2] for t in json.loads(spec)["added_tokens"]})
        self.seen, self.words_seen = Generations(300_000), Generations(300_000)

    def _ids(self, word: str) -> bytes:
        """Ids of a word in byte letters."""
        ids = array("I", [t.id for t in self.tokenize(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word in lower case, of letters that NFC leaves alone, or of one mark."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return self.words_seen.put(word, self._ids(letters))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of any other chunk."""
        if any([mark in chunk for mark in self.marks]):
            ids = np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b"".join(map(self._ids, self.pieces(chunk)))
        return self.seen.put(chunk, ids)

    def encode_texts(self, texts):
        """Ids of an Arrow string array, in order, and each text's start in them.

        A chunk is a word and perhaps a mark, which are looked up by themselves, so
        capitals and marks make no chunk new; others are looked up whole.
        """
        import pyarrow as pa
        import pyarrow.compute as pc
        codes, chunks, offsets = split_chunks(texts, as_list=False)
        plain = pc.match_substring_regex(chunks, PLAIN)
        words = pc.utf8_rtrim(pc.utf8_lower(chunks.filter(plain)), MARKS).dictionary_encode()
        others = chunks.filter(pc.invert(plain)).to_pylist()
        plain = plain.to_numpy(zero_copy_only=False)
        marks = pc.match_substring_regex(chunks, f"[{MARKS}]$").to_numpy(zero_copy_only=False) & plain
        known, seen = self.words_seen, self.seen
        units = [known.new.get(w) or known.get(w) or self._word(w) for w in words.dictionary.to_pylist()]
        n_words = len(units)
        units += [seen.get(c) or self._chunk(c) for c in others]
        n_chunks = len(units)
        units += [known.get(m) or self._word(m) for m in MARKS]
        # each chunk's units, then each unit's ids
        first = np.empty(len(chunks), np.int64)
        first[plain] = words.indices.to_numpy(zero_copy_only=False)
        first[~plain] = n_words + np.arange(len(others))
        size = 1 + marks.astype(np.int64)
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int64)
        flat[at] = first
        ending = pc.utf8_slice_codeunits(chunks.filter(pa.array(marks)), -1, 2**31 - 1)
        flat[at[marks] + 1] = n_chunks + pc.index_in(ending, pa.array(list(MARKS), ending.type)).to_numpy()
        counts = size[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        of_units = flat[np.repeat(at[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        return gather(of_units, ends[offsets], units, "<u4")


# -- the file format ----------------------------------------------------------

def packed_index(parts) -> tuple[int, bytes]:
    """The index of (Arrow ids, numbers of token ids) parts, and its frame's magic number."""
    import pyarrow as pa
    n_ids = np.concatenate([n for _, n in parts]) if parts else np.empty(0, np.int64)
    kinds = {ids.type for ids, _ in parts}
    if all(pa.types.is_integer(k) for k in kinds):
        index = np.zeros(len(n_ids), INDEX)
        if parts:
            ids = pa.concat_arrays([ids.cast(pa.int64()) for ids, _ in parts])
            index["is_null"] = ids.is_null().to_numpy(zero_copy_only=False)
            index["doc_id"] = ids.fill_null(0).to_numpy()
        index["n_ids"] = n_ids
        return SKIPPABLE_INDEX, index.tobytes()
    table = pa.table({"doc_id": pa.chunked_array([ids for ids, _ in parts]), "n_ids": n_ids})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return SKIPPABLE_ARROW_INDEX, out.getvalue().to_pybytes()


class Writer:
    """Streams documents into a file object; holds one frame and the index."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard
        self.out, self.limit = out, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting, self.n_waiting = [], 0
        self.frames, self.index = [], []

    def add(self, doc_ids, ids, starts) -> None:
        """Documents in order: ``ids`` of all of them, and each one's start in it (one more than documents)."""
        self.index.append((doc_ids, np.diff(starts)))
        at, end = int(starts[0]), int(starts[-1])
        while at < end:
            part = ids[at:min(at + self.limit - self.n_waiting, end)]
            self.waiting.append(part)
            self.n_waiting += len(part)
            at += len(part)
            if self.n_waiting == self.limit:
                self._flush()

    def _flush(self) -> None:
        import xxhash
        plain = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.compressor.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        if self.n_waiting:
            self._flush()
        kind, index = packed_index(self.index)
        index = self.compressor.compress(index)
        self.out.write(struct.pack(HEAD, kind, len(index)) + index)
        table = np.array(self.frames, ENTRY).tobytes()
        footer = struct.pack(FOOTER, len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack(HEAD, SKIPPABLE_SEEK_TABLE, len(table) + len(footer)) + table + footer)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        import pyarrow as pa
        import zstandard
        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        size = source.seek(0, io.SEEK_END) if not hasattr(source, "size") else source.size()
        head, tail = struct.calcsize(HEAD), struct.calcsize(FOOTER)
        n, flags, magic = struct.unpack(FOOTER, self._at(size - tail, tail))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file: bad footer")
        table_at = size - tail - n * ENTRY.itemsize
        self.frames = np.frombuffer(self._at(table_at, n * ENTRY.itemsize), ENTRY)
        self.packed_at = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        self.plain_at = np.concatenate(([0], np.cumsum(self.frames["plain"], dtype=np.int64)))
        magic, length = struct.unpack(HEAD, self._at(int(self.packed_at[-1]), head))
        if magic not in (SKIPPABLE_INDEX, SKIPPABLE_ARROW_INDEX):
            raise ValueError("not a token file: no document index")
        index = self.decompressor.decompress(self._at(int(self.packed_at[-1]) + head, length))
        if magic == SKIPPABLE_INDEX:
            index = np.frombuffer(index, INDEX)
            self.doc_ids = pa.array(index["doc_id"], pa.int64(), mask=index["is_null"].astype(bool))
            self.n_ids = index["n_ids"].astype(np.int64)
        else:
            table = pa.ipc.open_stream(index).read_all()
            self.doc_ids = table["doc_id"].combine_chunks()
            self.n_ids = table["n_ids"].to_numpy().astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.n_ids)))
        self.frames_read = 0
        self._held = (-1, b"")

    def _at(self, where: int, length: int) -> bytes:
        self.source.seek(where)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        import xxhash
        if self._held[0] != k:
            packed = self._at(int(self.packed_at[k]), int(self.frames["packed"][k]))
            plain = self.decompressor.decompress(packed)      # verifies the frame's own checksum
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.frames["check"][k]):
                raise ValueError(f"frame {k}: checksum differs")
            self._held = (k, plain)
            self.frames_read += 1
        return self._held[1]

    def pieces(self, i: int):
        """Document i's ids as byte strings, one frame at a time."""
        at, end = int(self.start[i]) * 4, int(self.start[i + 1]) * 4
        while at < end:
            k = int(np.searchsorted(self.plain_at, at, side="right")) - 1
            base = int(self.plain_at[k])
            yield self.frame(k)[at - base:end - base]
            at = int(self.plain_at[k + 1])

    def doc_id(self, i: int):
        return self.doc_ids[i].as_py()

    def read(self, doc_ids) -> dict:
        """Ids of the documents asked for; other documents' frames stay untouched."""
        wanted = set(doc_ids)
        return {d: np.frombuffer(b"".join(self.pieces(i)), "<u4")
                for i, d in enumerate(self.doc_ids.to_pylist()) if d in wanted}


# -- Spark jobs ---------------------------------------------------------------

def write_token_files(docs: DataFrame, spec: str, folder: str, end_id: int = 2, text: str = "text",
                      doc_id: str = "doc_id", frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write the files under ``folder`` (a shared one); return the manifest.

    Manifest: shard, path, n_docs, n_ids, start (ids in all files before it).
    """
    require_columns(docs, text, doc_id)
    integral = isinstance(docs.schema[doc_id].dataType, IntegralType)
    own_id = F.col(doc_id).cast("long") if integral else F.col(doc_id)
    ordered = (docs.select(own_id.alias("_id"), F.col(text).alias("_text"))
                   .repartitionByRange("_id", F.xxhash64("_text"))
                   .sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first()))
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext
        task = TaskContext.get()
        encoder = worker_state(("library", hashlib.sha256(shared.value.encode()).digest()),
                               lambda: LibraryEncoder(shared.value))
        store, root = fs.FileSystem.from_uri(folder)
        shard = task.partitionId()
        path, own = f"{root}/shard-{shard:06d}.ids.zst", f"{root}/.shard-{shard:06d}.{task.taskAttemptId()}"
        out = writer = None
        n_docs = n_ids = 0
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(own, compression=None)
                    writer = Writer(out, frame_ids)
                ids, starts = encoder.encode_texts(batch.column(1))
                ids = np.insert(ids, starts[1:], end_id)            # each document's end id
                writer.add(batch.column(0), ids, starts + np.arange(len(starts)))
                n_docs += batch.num_rows
                n_ids += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)
            store.move(own, path)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([f"shard-{shard:06d}.ids.zst"]),
                 pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())],
                names=["shard", "file", "n_docs", "n_ids"])

    files = materialise(ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long"),
                        "token-manifest")
    # one row per file, so this window is small whatever the corpus
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Read every document back: doc_id, start, n_tokens, ids_crc32 (of the ids, u32 LE).

    ``id_type``: that of the documents' ids; all integer types are read as long.
    """
    n = max(1, manifest.count())

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    for lo in range(0, len(reader.n_ids), 10_000):
                        span = range(lo, min(lo + 10_000, len(reader.n_ids)))
                        crcs = []
                        for i in span:
                            crc = 0
                            for piece in reader.pieces(i):
                                crc = zlib.crc32(piece, crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [reader.doc_ids.slice(lo, len(span)),
                             pa.array(first + reader.start[lo:span.stop], pa.int64()),
                             pa.array(reader.n_ids[lo:span.stop], pa.int64()),
                             pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (manifest.select("file", "start").repartition(n, "file")
                    .mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def read_documents(folder: str, file: str, doc_ids) -> dict:
    """The ids of some documents of one file, decompressing their frames only."""
    from pyarrow import fs
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{file}") as source:
        return Reader(source).read(doc_ids)


def round_trip(docs: DataFrame, spec: str, end_id: int = 2, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """Write the files into the shared folder, then read them back."""
    folder = shared_dir(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, spec, folder, end_id, text, doc_id)
    kind = docs.schema[doc_id].dataType
    return read_token_files(manifest, folder, "long" if isinstance(kind, IntegralType) else kind.simpleString())
