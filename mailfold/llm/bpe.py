"""BPE encoding by per-prefix dynamic programming, and decoding.

For a sequence of symbols the tokenisation that the merges give to any prefix
is fixed, so it is enough to store the *last token of every prefix*.  A token
that ends at position i (found by an Aho-Corasick automaton over the
vocabulary, whose suffix links list all matches ending there) is that last
token exactly if it is compatible with the last token of the prefix before it:
merging the two tokens' symbols side by side must leave the border between
them standing.  One match passes; following the back-pointers from the end
gives the ids.

``compatible`` takes the two tokens apart along the border, newest merge first;
if a merge across the border would have happened before the parts at hand were
built, the border falls.

Texts are normalised and cut into words the way the tokenizer file says:
special tokens first, then NFC, lower case, and the word pattern.  Ordinary
chunks take a regular expression; a chunk with any unusual character is
normalised and cut by the tokenizers library's own components.  The merges are
always done here.

Null and empty texts have no ids and decode to the empty text.  Repeated rows
are encoded each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .chunks import Cache, Generations, gather, split_chunks
from .common import require_columns, text_slices, worker_state

END = "\0"     # stands for the end-of-word mark: one character, in no token otherwise


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable
    bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        if b in printable:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Words:
    """Cuts chunks without white space into words the way a tokenizer file with this word pattern does."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.letters = byte_letters()
        self.table = {i: c for i, c in enumerate(self.letters)}
        # the file's word pattern, for chunks without white space
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # printable Basic Latin, Latin-1 and Latin Extended-A/B: NFC leaves them alone
        self.plain = regex.compile(r"[!-~¡-¬®-ɏ]*")

    def pieces(self, chunk: str):
        """The words of a chunk (no ASCII white space inside) in byte letters."""
        if chunk.isascii():
            if chunk.isalpha():
                return (chunk.lower(),)
            if chunk[:-1].isalpha() and chunk[-1].isprintable():     # a word and one mark
                return chunk[:-1].lower(), chunk[-1]
        if self.plain.fullmatch(chunk):
            return [word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
                    for word in self.words.findall(chunk.lower())]
        lib = self.library
        return [word for word, _ in
                lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk))]


class WordBpe(Words):
    """Encoder and decoder for one tokenizer file with an end-of-word suffix."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex
        super().__init__(spec)
        model = json.loads(spec)
        suffix = model["model"]["end_of_word_suffix"]
        vocab = model["model"]["vocab"]
        self.strings = {i: t for t, i in vocab.items()}
        self.merged = {(vocab[a], vocab[b]): vocab[a + b]
                       for a, b in model["model"]["merges"]}
        self.halves = {}
        for pair, token in self.merged.items():
            self.halves.setdefault(token, pair)
        self.automaton = ahocorasick.Automaton()
        self.size = {}
        letters = set(byte_letters())
        for text, token in vocab.items():
            ends = text.endswith(suffix)
            body = text.removesuffix(suffix)
            if token not in self.halves and not (len(body) == 1 and body in letters):
                continue                            # no merge ever makes it
            self.size[token] = len(body)
            self.automaton.add_word(body + END * ends, (token, len(body)))
        self.automaton.make_automaton()
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        for text, token in self.specials.items():
            self.strings[token] = text
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") \
            if self.specials else None
        # each worker of an executor has its own; the limits change the time taken, never an id
        self.fits = Cache(1 << 17)
        self.words_seen = Generations(150_000)      # a word costs more to encode than a chunk to look up
        self.chunks_seen = Cache(100_000)

    # -- merges ---------------------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            known = self.fits.put(key, self._border_stands(left, right))
        return known

    def _border_stands(self, left: int, right: int) -> bool:
        # A merge with id below ``before`` happens before the newest token taken
        # apart so far; ids follow the order of the merges.
        merged, halves, before = self.merged, self.halves, len(self.strings)
        while True:
            if merged.get((left, right), before) < before:
                return False
            # The newer of the two is taken apart; on a tie the left one was
            # built first (merges run from left to right), so the right goes.
            if left > right:
                if left in halves:
                    before, left = left, halves[left][1]
                elif right in halves:
                    before, right = right + 1, halves[right][0]
                else:
                    return True
            elif right in halves:
                before, right = right + 1, halves[right][0]
            elif left in halves:
                before, left = left, halves[left][1]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters, by the prefix table."""
        n = len(word)
        unfinished = n - 1          # there the whole word lacks its mark
        last = [None] * (n + 1)
        fits = self.fits
        for at, (token, size) in self.automaton.iter(word + END):
            if at == unfinished:
                continue
            # a match that ends in the mark completes the word; others end a proper prefix
            end = at + 1 if at < n else n
            if last[end] is not None:
                continue
            start = end - size
            if start:
                known = fits.get(last[start] << 32 | token)
                if known is None:
                    known = self.compatible(last[start], token)
                if not known:
                    continue
            last[end] = token
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        ids.reverse()
        return ids

    # -- words and chunks -----------------------------------------------------
    def _plain_bytes(self, chunk: str) -> bytes:
        found = []
        for word in self.pieces(chunk):
            known = self.words_seen.get(word)
            if known is None:
                ids = array("I", self.encode_word(word))
                if sys.byteorder == "big":
                    ids.byteswap()
                known = self.words_seen.put(word, ids.tobytes())
            found.append(known)
        return b"".join(found)

    def chunk_bytes(self, chunk: str) -> bytes:
        """A chunk's ids as little-endian unsigned 32-bit integers."""
        known = self.chunks_seen.get(chunk)
        if known is None:
            if "<|" in chunk and self.special_split:
                known = b"".join(np.array([self.specials[part]], "<u4").tobytes()
                                 if part in self.specials else self._plain_bytes(part)
                                 for part in self.special_split.split(chunk))
            else:
                known = self._plain_bytes(chunk)
            self.chunks_seen.put(chunk, known)
        return known

    def encode_texts(self, texts):
        """Ids of an Arrow string array, in order, and each text's start in them."""
        codes, chunks, offsets = split_chunks(texts)
        return gather(codes, offsets, [self.chunk_bytes(c) for c in chunks], "<u4")

    def decode(self, ids) -> str:
        """The tokens' strings joined by a space, as the file's (absent) decoder does."""
        return " ".join(map(self.strings.__getitem__, ids))


def coder(spec: str) -> WordBpe:
    return worker_state(("word_bpe", hashlib.sha256(spec.encode()).digest()), lambda: WordBpe(spec))


def encode(docs: DataFrame, spec: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int), ``decoded`` (the ids decoded) per row."""
    return _run(docs, spec, text, keep, "n_tokens long, ids array<int>, decoded string", _with_ids)


def digests(docs: DataFrame, spec: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, and SHA-256 of the ids (u32 LE) and of the decoded text.

    The same as hashing the columns of ``encode``, without shipping them to the JVM.
    """
    return _run(docs, spec, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                _with_digests)


def _with_ids(ids, decoded):
    return [len(ids), ids.astype(np.int32), decoded]


def _with_digests(ids, decoded):
    return [len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest()]


def _run(docs, spec, text, keep, result, row_of):
    require_columns(docs, text, *keep)
    kept = docs.select(*keep)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, {result}"
    names = [part.split()[0] for part in result.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    width = len(keep)

    def run(batches):
        import pyarrow as pa
        bpe = coder(shared.value)
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                ids, starts = bpe.encode_texts(batch.column(width))
                rows = []
                for i in range(batch.num_rows):
                    own = ids[starts[i]:starts[i + 1]]
                    rows.append(row_of(own, bpe.decode(own.tolist())))
                columns = [pa.array(list(c)) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(width)] + columns,
                                                 names=[*keep, *names])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
