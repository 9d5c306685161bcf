"""Word-piece counts, personal data, BPE and token files against plain versions."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mailfold.llm import bpe, pii, token_files, wordpiece
from mailfold.llm.registry import tokenizer_spec, word_pieces

DOCS = "doc_id long, text string, source string, `_text` string, ids string"
HARD = [None, "", " ", "\n\n", "It's DON'T we'll 'sup", "<|endoftext|>x<|startoftext|><|endof", "a" * 30_000,
        "½²Ⅷ á \x1c\x85\xa0 İ ǅ ẛ̣ 日本語 😀😀 ''''s _a_b '’s", "ſ K Å ̈́ ΣΑΣ ｆｕｌｌ", "tie tie tie", "tie tie tie"]


def random_texts(n, letters, size=150, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, None, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", "s", None, None)]
    return spark.createDataFrame(rows, DOCS)


# -- op 3 -----------------------------------------------------------------------

def greedy(word, vocabulary):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in vocabulary:
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def test_longest_match_counts_equal_greedy_search():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        vocabulary = {("##" if rng.random() < .6 else "") + p for p in pieces}
        automaton = wordpiece.LongestMatch(vocabulary)
        for _ in range(40):
            word = "".join(rng.choice("aab") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_token_counts_of_hard_texts(spark):
    vocabulary = word_pieces()
    held = set(vocabulary)
    texts = HARD[:6] + HARD[7:] + random_texts(30, "theinanonr .,é日\n")
    got = {r.doc_id: r for r in wordpiece.count_tokens(frame(spark, texts), vocabulary).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        counts = [greedy(w, held) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (
            len(counts), sum(max(c, 1) for c in counts), counts.count(0)), repr(text)


def test_long_word_takes_linear_work():
    automaton = wordpiece.LongestMatch(["a", "##a", "##" + "a" * 50 + "b"])
    assert automaton.count("a" * 200_000) == 200_000


# -- op 4 -----------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[-1::-2]]
            even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and sum(odd + even) % 10 == 0
                    or kind == "phone" and 8 <= len(digits) <= 15):
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_base_spans_equal_the_plain_patterns():
    finder = pii.Finder()
    texts = random_texts(3000, "ab.@@-_1 2", 40) + random_texts(3000, "0125. -+()", 60, 2) + [
        "a@b.c@d.e a@b.cd_x@y.z @a.b x@y 1.2.3.4.5.6.7.8.9 256.1.1.1.1 4111 1111-1111 1111 +1 (800) 555-1234."]
    for text in texts:
        assert pii.write_spans(finder.spans(text)) == ",".join(plain_base(text)), repr(text)


@pytest.mark.parametrize("text, found", [
    ("write to john.doe [at] mail8 (dot) example [dot] com now", {"email": "john.doe [at] mail8 (dot) example [dot] com"}),
    ("write to john at mail dot example dot com now", {"email": "john at mail dot example dot com"}),
    ("to john at mail.example dot com now", {"email": "john at mail.example dot com"}),
    ("john_at_mail_dot_com", {"email": "john_at_mail_dot_com"}),
    ("by john -at- mail -dot- com.", {"email": "john -at- mail -dot- com"}),
    ("by john*AT*mail*DOT*com!", {"email": "john*AT*mail*DOT*com"}),
    ("by john&#64;mail&#46;com", {"email": "john&#64;mail&#46;com"}),
    ("to bosbt dot four two at mail8 dot example dot com", {"email": "bosbt dot four two at mail8 dot example dot com"}),
    ("host 42 dot 144 dot 35 dot 254 up", {"ip": "42 dot 144 dot 35 dot 254"}),
    ("ring plus one (319) five five five 5132", {"phone": "plus one (319) five five five 5132"}),
    ("a stay-at-home-mom with a polka-dot-dress", {}),
    ("look at example.com, or at the dot", {}),
    ("meet at home. Then at one dot", {}),
    ("j\u043ehn@m\u0430il.c\u043em", {"email": "j\u043ehn@m\u0430il.c\u043em"}),
    ("\uff4a\uff4f\uff48\uff4e\uff20\uff4d\uff41\uff49\uff4c\uff0e\uff43\uff4f\uff4d",
     {"email": "\uff4a\uff4f\uff48\uff4e\uff20\uff4d\uff41\uff49\uff4c\uff0e\uff43\uff4f\uff4d"}),
    ("see john@\u200bmail.com", {"email": "john@\u200bmail.com"}),
    ("card four one one one 1111 1111 1111 ok", {"card": "four one one one 1111 1111 1111"}),
    ("ip one nine two dot one six eight dot one dot two", {"ip": "one nine two dot one six eight dot one dot two"}),
    ("call plus four nine eight nine one two three four five six",
     {"phone": "plus four nine eight nine one two three four five six"}),
    ("call +1 (8OO) 555-l234 now", {"phone": "+1 (8OO) 555-l234"}),
    ("\u0661\u0664\u0661\u0661 4111 1111 1111 1111".replace("\u0661\u0664\u0661\u0661 ", ""),
     {"card": "4111 1111 1111 1111"}),
    ("n \u0664\u0661\u0661\u0661 \u0661\u0661\u0661\u0661 1111 1111",
     {"card": "\u0664\u0661\u0661\u0661 \u0661\u0661\u0661\u0661 1111 1111"}),
    ("\u00c9\u00e8the at of, in one two", {}),
])
def test_disguised_data_maps_back_to_the_source(text, found):
    base, every = pii.Finder().all_spans(text)
    assert {pii.KINDS[k]: text[s:e] for k, s, e in every} == found
    assert set(base) <= set(every)


DISGUISES = [
    "write to john*AT*mail.com please", "by john -at- mail.com", "john_at_mail.com", "john = at = mail.com",
    "john \x1c-\x0bat\x0b- mail.com", "john (at) mail.com", "john <\x0bat\x1d> mail.com", "john arroba mail.com",
    "john at mail dot com", "john dot doe at mail.com", "jane.doe at example.com", "jane_doe at example.com",
    "jane+x\x0bat example.com", "_one.two.three.four_", "one\u00b7two\u00b7three\u00b7four", "\u00b9.\u00b2.\u00b3.\u00b9",
    "+one (two) (three) (four) (five)(six)(seven)(eight)", "one dot two dot three [dot] four",
    "plus one two three four five six seven eight"]


def test_every_disguise_passes_the_gate(spark):
    texts = DISGUISES + HARD + [f"{a}{b}{c}at{c}{b}mail{d}com" for a in ("john", "x.y") for b in ("", " ", "\x0b")
                                for c in "* | = ~ \" ' _ - -- ( <".split() for d in (".", " dot ", "(.)")]
    finder = pii.Finder()
    got = {r.doc_id: r.spans for r in pii.find_private(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [pii.write_spans(finder.all_spans(t or "")[1]) for t in texts]
    assert all(got[i] for i in range(len(DISGUISES)))


def test_bare_at_and_wider_spans():
    spans = lambda t: pii.write_spans(pii.Finder().all_spans(t)[1])
    assert spans("ask jane.doe at example.com.") == "email:4:27"
    assert spans("look at example.com") == spans("the end. at example.com") == ""
    assert spans("www.here.org at example.com") == spans("jane.doe at home") == ""
    assert spans("to john dot doe@mail.com") == "email:3:24,email:12:24"
    assert spans("a@b.de dot com, x@y.de") == "email:0:6,email:0:14,email:16:22"


@pytest.mark.parametrize("text", [
    "version 2.0 at example.com", "look at p.s at foo.com", "jane.doe at work.Thanks", "i.e. at example.com",
    "twenty one dot two dot three dot four", "vingt-un dot deux dot trois dot quatre", "see file_1.2 at 10.30",
    "double trouble at home", "meet v1.2 at noon.Then go"])
def test_prose_with_at_and_larger_numbers_is_left_alone(text):
    assert pii.Finder().all_spans(text)[1] == []


@pytest.mark.parametrize("text, found", [
    ("mail jane-_doe at mail.com please", {"email": "jane-_doe at mail.com"}),
    ("mail jane%.doe at mail.com please", {"email": "jane%.doe at mail.com"}),
    ("mail maria chiocciola mail punto it", {"email": "maria chiocciola mail punto it"}),
    ("mail joao arroba mail ponto pt", {"email": "joao arroba mail ponto pt"}),
    ("call plus four nine double five triple six one two", {"phone": "plus four nine double five triple six one two"}),
    ("call plus triple one triple two triple three", {"phone": "plus triple one triple two triple three"}),
])
def test_more_disguises(spark, text, found):
    assert {pii.KINDS[k]: text[s:e] for k, s, e in pii.Finder().all_spans(text)[1]} == found
    row = pii.find_private(frame(spark, [text])).first()
    assert row.spans == pii.write_spans(pii.Finder().all_spans(text)[1]) and row.n_spans == 1


def test_the_gate_lets_through_whatever_is_found(spark):
    """Random strings of the transducers' own words and marks, with and without the gate."""
    rng = random.Random(5)
    words = ("jane doe x p.s a_b j+k mail com example at AT dot punkt ponto arroba chiocciola one two oh vier cinq "
             "double triple twenty plus + @ . ( ) [ ] * - _ % &#64; &#46; %40 %2e \u00b7 \x0b \x1c").split(" ")
    texts = ["".join(rng.choice(words) + rng.choice(("", " ", " ", "_", ".")) for _ in range(rng.randint(3, 12)))
             for _ in range(20_000)]
    finder = pii.Finder()
    got = {r.doc_id: r.spans for r in pii.find_private(frame(spark, texts)).collect()}
    want = {i: pii.write_spans(finder.all_spans(t)[1]) for i, t in enumerate(texts)}
    assert {i: got[i] for i in want} == want and sum(map(bool, want.values())) > 100


def test_base_and_disguised_spans_stand_side_by_side():
    base, every = pii.Finder().all_spans("a@b.de and c (at) d.ef")
    assert pii.write_spans(base) == "email:0:6" and pii.write_spans(every) == "email:0:6,email:11:22"


@pytest.mark.parametrize("text", [" " * 200_000 + "(7", "( " * 60_000 + "7", "+ " * 60_000, "1 " * 60_000,
                                  "a@" * 60_000, "one " * 40_000, "o" * 200_000 + "7", "&#" * 60_000 + "7",
                                  "a" + "_" * 100_000 + "7", "- " * 60_000 + "7", ".1" * 60_000, "a dot " * 20_000])
def test_long_runs_take_linear_time(text):
    import time
    began = time.process_time()
    pii.Finder().all_spans(text)
    assert time.process_time() - began < 10


def test_private_data_of_hard_texts(spark):
    texts = HARD + ["a@b.de " * 3, "x" * 20_000 + "@" + "y" * 20_000 + ".com", "1" * 50_000, "+1 " + "(" * 20_000]
    got = {r.doc_id: r for r in pii.find_private(frame(spark, texts)).collect()}
    for i, text in enumerate(texts[:-3]):
        base = plain_base(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [
            sum(b.startswith(k + ":") for b in base) for k in BASE]
    assert got[len(HARD)].spans == "email:0:6,email:7:13,email:14:20"
    assert got[len(HARD) + 1].n_email == 1 and got[len(HARD) + 2].spans == ""


# -- ops 5 and 8 ------------------------------------------------------------------

@pytest.fixture(scope="module")
def spec():
    return tokenizer_spec()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer
    return Tokenizer.from_str(spec)


TEXTS = [t for t in HARD if t] + random_texts(300, "abcdefghijklmnopqrstuvwxyz'é<|>日 ́12.,_ß")


def test_prefix_table_gives_the_library_ids(spec, library):
    coder = bpe.WordBpe(spec)
    ids, starts = coder.encode_texts(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[starts[i]:starts[i + 1]].tolist() == want, repr(text[:80])
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_unbounded_and_tiny_caches_agree(spec):
    small, large = bpe.WordBpe(spec), bpe.WordBpe(spec)
    small.chunks_seen.limit = small.words_seen.limit = small.fits.limit = 3
    assert small.encode_texts(pa.array(TEXTS))[0].tolist() == large.encode_texts(pa.array(TEXTS))[0].tolist()


def test_encode_keeps_rows_nulls_and_clashing_names(spark, spec, library):
    got = bpe.encode(frame(spark, HARD), spec, keep=("doc_id", "source")).collect()
    assert len(got) == len(HARD) + 1
    for r in got:
        text = "no id" if r.doc_id is None else HARD[r.doc_id] or ""
        assert list(r.ids) == library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(frame(spark, []).limit(0), spec).count() == 0


def test_library_encoder_tells_joined_chunks_apart(spec, library):
    ids, starts = token_files.LibraryEncoder(spec).encode_texts(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert ids[starts[i]:starts[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


CASES = ["Don't", "WORD.", "word,", "word!?", "Été.", "İstanbul", "İ.", "ß", "ẞ", "ǅ", "ŉ", "ĿL·", "ª", "x×y", "a÷", "ǰ.", "ȿ",
         "<|endoftext|>.", "é", "É;", "a.", ".a", ".", "..", "ſ.", "µ", "Ångström:", "naïve?!", "K"]


def test_library_encoder_of_words_with_capitals_and_marks(spec, library):
    texts = [*CASES, " ".join(CASES), *random_texts(400, "aÀéİıſßĿ.,!'’ǅ3×ɏɐ ", 40)]
    of = token_files.LibraryEncoder(spec)
    for run in (texts, texts[::-1]):                    # the second time from the caches
        ids, starts = of.encode_texts(pa.array(run))
        for i, text in enumerate(run):
            assert ids[starts[i]:starts[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_of_other_id_types(spark, spec):
    docs = spark.createDataFrame([("b", "one two"), (None, "three"), ("a", None)], "doc_id string, text string")
    got = {r.doc_id: r.start for r in token_files.round_trip(docs, spec).collect()}
    assert list(sorted(got, key=got.get)) == [None, "a", "b"]
    small = docs.selectExpr("cast(length(doc_id) as int) as doc_id", "text")
    assert sorted(r.n_tokens for r in token_files.round_trip(small, spec).collect()) == [1, 2, 3]


def token_file(lengths, frame_ids=100):
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_ids)
    docs = {i: np.arange(n, dtype="<u4") + 7 * i for i, n in enumerate(lengths)}
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ids = np.concatenate([*docs.values(), np.empty(0, "<u4")])
    for some in (range(len(docs) // 2), range(len(docs) // 2, len(docs))):       # two batches
        writer.add(pa.array(some, pa.int64()), ids, starts[some.start:some.stop + 1])
    writer.close()
    return out.getvalue(), docs


def test_token_file_reads_only_the_frames_asked_for():
    data, docs = token_file([10, 0, 250, 99, 1, 1000])
    reader = token_files.Reader(io.BytesIO(data))
    assert {i: ids.tolist() for i, ids in reader.read(docs).items()} == {i: d.tolist() for i, d in docs.items()}
    reader = token_files.Reader(io.BytesIO(data))
    assert reader.read([0])[0].tolist() == docs[0].tolist() and reader.frames_read == 1
    import zstandard
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert stream == np.concatenate(list(docs.values())).tobytes()


def test_damage_is_noticed():
    data, docs = token_file([50, 300])
    reader = token_files.Reader(io.BytesIO(data))
    broken = bytearray(data)
    broken[int(reader.packed_at[1]) + 12] ^= 0x55
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(broken))).read([1])


def test_token_files_round_trip_in_id_order(spark, spec, library, tmp_path):
    texts = list(reversed(HARD))
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(frame(spark, texts), spec, folder, frame_ids=64)
    got = {r.doc_id: r for r in token_files.read_token_files(manifest, folder).collect()}
    at = 0
    for i in [None, *range(len(texts))]:
        ids = library.encode("no id" if i is None else texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens) == (at, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    file = manifest.orderBy("shard").first()["file"]
    assert None in token_files.read_documents(folder, file, [None])
    assert token_files.round_trip(frame(spark, []).limit(0), spec).count() == 0
