"""Cross-tokenizer alignment, secret scan and ranked search against plain versions."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mailfold.llm import alignment, ranked_search, secrets
from mailfold.llm.bpe import byte_letters
from mailfold.llm.registry import SQL, tokenizer_model, tokenizer_spec

DOCS = "doc_id long, text string, source string, `_id` string, slot string, term string, kind string"
HARD = [None, "", " ", "  ", "\n", "a\n", " a", "a  b", "a \n b", "\n\na", "tab\there", "x  y", "x  y \x1c z", "x\x85 y",
        "<|endoftext|> <s></s><unk> <0x0A>", "a▁b", "▁", "\x00 nul", "naïve café 日本語 😀 … “quote” it's ’s", "İ ǅ ẛ̣ ſK",
        "w" * 30_000, " ".join(["word"] * 3000), "same text", "same text", "line one\r\nline two\n\n\n  three   "]


def frame(spark, texts, extra=(None, "no id")):
    rows = [(i, t, None, "clash", "clash", "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(*extra, "s", None, None, None, None)], DOCS)


def random_texts(n, letters, size=150, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]


# -- op 11 ----------------------------------------------------------------------

class PlainAligner:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        spec = tokenizer_spec("byte_bpe_50k.json")
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_model("piece_bpe_32k.model"))
        code = {c: i for i, c in enumerate(byte_letters())}
        self.bytes_a = {i: bytes(code.get(c, 0) for c in t) for t, i in json.loads(spec)["model"]["vocab"].items()}

    def piece(self, i):
        piece = self.b.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """[(id, start, end)] by A and by B; none where the bytes differ."""
        if not text:
            return [], []
        sides = []
        for ids, spell in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a.get),
                           (self.b.encode(text), self.piece)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at := at + len(spell(i))))
            if b"".join(map(spell, ids)) != (" " + text).encode():
                return [], []
            sides.append(side)
        return sides


def plain_alignment(texts):
    of = PlainAligner()
    both = [of.tokens(t) for t in texts]
    links = []
    for a, b in both:
        own, first = [], 0
        for i, lo, hi in a:
            while first < len(b) and b[first][2] <= lo:
                first += 1
            k = first
            while k < len(b) and b[k][1] < hi:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
    counts = Counter(x for own in links for x in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for (a, b), own in zip(both, links):
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        cut, groups = 0, []
        for end in ends:
            groups.append(",".join(str(x[0]) for x in a if cut < x[2] <= end) + "|" +
                          ",".join(str(x[0]) for x in b if cut < x[2] <= end))
            cut = end
        rows.append((len(a), len(b), len(ends), len(own), sum(counts[x] == best[x[1]] for x in own),
                     sum(counts[x] for x in own),
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return rows, counts, Counter(x for own in links for x in set(own))


def align(docs, **options):
    return alignment.align_documents(docs, tokenizer_spec("byte_bpe_50k.json"),
                                     tokenizer_model("piece_bpe_32k.model"), **options)


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_plain_alignment(spark):
    short = [t if t is None or len(t) < 2000 else t[:2000] for t in HARD]
    texts = short + random_texts(60, "the in an or é日 \n\t.,'’ ")
    expected, _, _ = plain_alignment([*texts, "no id"])
    got = {r.doc_id: r for r in align(frame(spark, texts)).collect()}
    assert len(got) == len(texts) + 1
    for key, row in zip([*range(len(texts)), None], expected):
        assert tuple(got[key][c] for c in FIGURES) == row, key


def test_alignment_of_long_texts_groups_and_pair_counts(spark):
    texts = ["w" * 30_000, " ".join(["word of"] * 3000), "word of", "word of", None]
    expected, counts, docs = plain_alignment([*texts, "no id"])
    frame_ = frame(spark, texts).repartition(3)
    got = {r.doc_id: r for r in align(frame_, with_groups=True).collect()}
    for key, row in zip([0, 1, 2, 3, 4, None], expected):
        assert tuple(got[key][c] for c in FIGURES) == row
        if got[key].n_a:
            assert hashlib.sha256(got[key].groups.encode()).hexdigest() == got[key].groups_sha256
    index = alignment.index_pairs(frame_, tokenizer_spec("byte_bpe_50k.json"),
                                  tokenizer_model("piece_bpe_32k.model"), "text", "doc_id")
    pairs = {(r.a, r.b): r for r in alignment.pair_counts(index).collect()}
    assert {k: r.n_links for k, r in pairs.items()} == dict(counts)
    assert {k: r.n_docs for k, r in pairs.items()} == dict(docs)


def test_alignment_over_several_blocks_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    texts = random_texts(40, "ab c", 60, seed=4)
    expected, _, _ = plain_alignment([*texts, "no id"])
    # slices of one text each: every few texts begin a block
    monkeypatch.setattr(alignment, "text_slices", lambda b, c: (b.slice(i, 1) for i in range(b.num_rows)))
    got = {r.doc_id: r for r in align(frame(spark, texts)).collect()}
    assert [tuple(got[k][c] for c in FIGURES) for k in [*range(40), None]] == expected
    assert align(frame(spark, texts).where("doc_id < 0")).collect() == []


def test_bitmaps_hold_their_slots():
    rng = np.random.default_rng(2)
    for size, among in ((1, 1), (1, 60_000), (5, 10), (300, 400), (300, 65_536), (65_536, 65_536)):
        slots = np.sort(rng.choice(among, size, replace=False))
        empty, held = alignment.bitmaps(np.ones(size, np.int64), slots, 2)
        assert empty == b"" and alignment.slots_of(held).tolist() == slots.tolist()
        assert len(held) <= min(2 * size, among // 8 + 1) + 1


# -- op 12 ----------------------------------------------------------------------

def plain_spans(text):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [("assign", "access", "hex")[k] + f":{a}:{b}" for a, k, b in sorted(spans)]


SECRET_TEXTS = HARD + [
    "password=abcdefghijkl", "PassWord\"  :  'abcdefghijkl", "token: secret: abcdefghijklmn", "apikey=api_key=shortvalue12",
    "toKen=abcdefghijkl paſſword=abcdefghijkl toKen=abcdefghijkl", "AKIA" + "Q" * 14, "AKIAAKIA" + "Z" * 9, "xAKIA12345678901234x",
    "f" * 15 + " " + "f" * 16 + "G" + "0" * 16, "x" * 5 + "deadbeef" * 3 + "é" + "a" * 16, "secret" + " " * 5000 + "=" + "a" * 40,
    "password=abc password=abcdefghijkl", "😀 token=abcdefghijkl"]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = SECRET_TEXTS + random_texts(300, ["password", "token", "api_key", "=", ":", " ", "'", '"', "AKIA", "a", "f0", "9Z", "é"], 60)
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, texts)).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        spans, row = plain_spans(text or ""), got[i]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), repr(text)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        every = row.spans.split(",") if row.spans else []
        assert set(spans) <= set(every) and len(every) == len(spans) + row.n_inferred == len(row.found)
        for span, found in zip(every, row.found):
            kind, a, b = span.split(":")
            assert (found.kind, found.start, found.end) == (kind, int(a), int(b))


def credential(rng):
    return "ghx_" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24))


def test_formats_learnt_from_labels_find_bare_credentials_and_leave_prose_alone(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 18))) for _ in range(400)]
    prose = [" ".join(rng.choices(words, k=60)) + " Supercalifragilistic well-known-compound-word 2024-01-01T10:20:30 "
             "https://example.com/some/path/index.html 3.14159265358 4155551234567" for _ in range(300)]
    labels = [f"config token={credential(rng)} end" for _ in range(300)]
    bare = [f"please keep {credential(rng)} safe, {rng.choice(words)}" for _ in range(60)]
    texts = labels + prose + bare
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, texts)).collect()}
    assert sum(got[i].n_inferred for i in range(600)) == 0
    found = [got[600 + i].spans == "assign:12:40" for i in range(60)]
    assert sum(found) >= 57                                    # held-out credentials of the format
    # too few labels: no automaton, the base spans stay
    few = {r.doc_id: r for r in secrets.find_secrets(frame(spark, labels[:5] + bare)).collect()}
    assert [few[i].n_assign for i in range(6)] == [1] * 5 + [0] and sum(r.n_inferred for r in few.values()) == 0


def test_labels_beyond_the_sample_and_long_ones_give_formats_too(spark):
    rng = random.Random(11)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    formats = [lambda: "ghx_" + some("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 24),
               lambda: "zq+" + some("01", 40),                        # 30 among 2130: few in the sample
               lambda: "ghy_" + some("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 140)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 18))) for _ in range(400)]
    prose = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    labels = [f"config token={of()} end" for of, n in zip(formats, (2000, 30, 100)) for _ in range(n)]
    bare = [f"please keep {of()} safe" for of in formats for _ in range(10)]
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, prose + labels + bare), sample=300).collect()}
    assert sum(got[i].n_inferred for i in range(len(prose))) == 0
    for k, size in enumerate((28, 43, 144)):
        first = len(prose) + len(labels) + 10 * k
        assert sum(f"assign:12:{12 + size}" in got[first + i].spans.split(",") for i in range(10)) >= 8, k


def test_all_labelled_values_are_counted_in_their_automata(spark):
    rng = random.Random(12)
    values = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
              for letters, sizes, n in (("abcdef0123456789", (32, 40, 64), 500), ("XYZ=", (300, 150), 60)) for _ in range(n)}
    found = secrets.infer(spark.createDataFrame([(2, v) for v in values], "kind int, value string").repartition(3), sample=25)
    left, counted = values, 0
    for kind, step, cost, shortest, longest, typical in found:
        own = sorted(left)
        followed = secrets.passages(step, own)[1]
        own = [v for v, ok in zip(own, followed) if ok]
        assert kind == 2 and (shortest, longest) == (min(map(len, own)), max(map(len, own))) and 0 < typical < math.inf
        assert np.allclose(cost, secrets.costs(secrets.passages(step, own)[0]))
        left, counted = left - {*own}, counted + len(own)
    assert counted + len(left) == len(values) and len(left) < secrets.LEAST


def test_merged_automaton_is_a_distribution_and_generalises():
    rng = random.Random(5)
    values = ["AB" + "".join(rng.choice("01") for _ in range(10)) for _ in range(400)]
    of = secrets.Automaton(values)
    assert of.states < 20                                       # the random part became loops
    weight = np.exp(-of.cost[:of.states])
    assert np.allclose(weight.sum(axis=1), 1)
    unseen = ["AB0101010101", "AB1111100000"]
    cost = secrets.likelihood_cost(of.step, of.cost, unseen + ["BA0101010101", "AB01010101zz", "AB"])
    assert max(cost[:2]) < 15 < min(cost[2:4])
    for value, own in zip(unseen, cost):                        # one value at a time
        state, total = 0, 0.0
        for c in value:
            total += of.cost[state, secrets.CODE[ord(c)]]
            state = of.step[state, secrets.CODE[ord(c)]]
        assert math.isclose(total + of.cost[state, secrets.END], own)


def test_unlike_states_stay_apart():
    values = ["ax"] * 300 + ["by"] * 300
    of = secrets.Automaton(values)
    cost = secrets.likelihood_cost(of.step, of.cost, ["ax", "by", "ay", "bx"])
    assert max(cost[:2]) < 1 < 5 < min(cost[2:])


def test_secret_scan_of_an_empty_table(spark):
    assert secrets.find_secrets(frame(spark, []).where("false")).collect() == []


# -- op 13 ----------------------------------------------------------------------

def plain_search(texts, items, k):
    """texts: [(doc_id, text)]; the ranked (doc_id, score) of each item."""
    def terms(text):
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    bags = [Counter(terms(t)) for _, t in texts]
    n_docs, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item in items:
        hits = []
        for (doc, _), bag in zip(texts, bags):
            n = sum(bag.values())
            m = 50 + (50 * n * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                        ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(item)) if bag[t])
            if score > 0:
                hits.append((-score, doc is None, doc if doc is not None else 0))
        out.append([(None if none else doc, -s) for s, none, doc in sorted(hits)[:k]])
    return out


ITEMS = "item_id long, text string, `query` string, tile string, shard string"


def ranked(spark, texts, items, k, **options):
    rows = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in items], ITEMS)
    found = defaultdict(list)
    for r in ranked_search.search(frame(spark, texts), rows, k=k, **options).orderBy("item_id", "rank").collect():
        found[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(found[r.item_id])
    return found


@pytest.mark.parametrize("k,tile", [(1, 256), (5, 2), (50, 256)])
def test_ranked_search_equals_scoring_everything(spark, k, tile):
    texts = HARD + random_texts(150, ["a ", "b ", "the ", "Cat ", "dog ", "é ", "x1 ", "_", "-"], 60, seed=2) + ["cat dog"] * 30
    items = [(0, "the cat"), (1, "dog x1 dog"), (2, None), (3, ""), (4, "unknown words only"), (5, "A b C the Cat dog é x1"),
             (None, "cat"), (7, "same text"), (7, "same text"), (8, "w" * 30_000)]
    got = ranked(spark, texts, items, k, tile_queries=tile)
    expected = plain_search([*enumerate(texts), (None, "no id")], [t for _, t in items], k)
    for (item, _), hits in zip(items, expected):
        assert got.get(item, []) == hits, item


def test_ranked_search_prunes_blocks_over_shards_and_windows(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(1500)]
    items = [(i, " ".join(rng.choices(words, weights, k=6)) + f" w{250 + i}") for i in range(12)]
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", 3000)
    monkeypatch.setattr(ranked_search, "text_slices", lambda b, c: (b.slice(i, 100) for i in range(0, b.num_rows, 100)))
    got = ranked(spark, texts, items, 10)
    expected = plain_search([*enumerate(texts), (None, "no id")], [t for _, t in items], 10)
    assert [got[i] for i, _ in items] == expected


def lists_of(rng, size, n):
    lists = []
    for _ in range(n):
        slots = np.sort(rng.choice(size, rng.integers(1, size + 1), replace=False)).astype(np.int64)
        tf = rng.integers(1, 400, len(slots))
        m = np.full(size, 100)
        tops, heads, payload = ranked_search.compressed_lists(np.array([0]), slots, tf, ranked_search.impact(tf, m[slots]))
        lists.append((int(rng.integers(1, 9000)), ranked_search.List(int(tops[0]), heads[0], payload[0], m), slots, tf))
    return lists


def test_shard_search_with_any_threshold_and_window():
    rng = np.random.default_rng(3)
    for size in (1, 130, 3000):
        lists = lists_of(rng, size, 5)
        total = np.zeros(size, np.int64)
        for weight, _, slots, tf in lists:
            total[slots] += weight * ranked_search.impact(tf, np.int64(100))
        order = np.lexsort((np.arange(size), -total))
        order = order[total[order] > 0]
        for k in (1, 10, 4000):
            for threshold in (1, int(np.median(total)) + 1, int(total.max()) + 1):
                for window in (64, 4096):
                    slots, scores = ranked_search.search_shard([x[:2] for x in lists], size, k, threshold, window)
                    own = [s for s in order if total[s] >= threshold][:k]
                    assert slots.tolist() == own and scores.tolist() == total[own].tolist()


def test_search_leaves_blocks_compressed():
    size = 1 << 15
    m = np.full(size, 100)

    def of(slots, tf):
        tops, heads, payload = ranked_search.compressed_lists(np.array([0]), slots, tf, ranked_search.impact(tf, m[slots]))
        return ranked_search.List(int(tops[0]), heads[0], payload[0], m)
    rare = of(np.array([5, 20_000]), np.array([9, 9]))
    common = of(np.arange(size), np.ones(size, np.int64))
    slots, _ = ranked_search.search_shard([(9000, rare), (10, common)], size, 2, 9000 * rare.top, 1 << 16)
    assert slots.tolist() == [5, 20_000] and len(common.held) == 2 < len(common.heads)


def test_packed_integers():
    rng = np.random.default_rng(9)
    values = np.concatenate((rng.integers(0, 300, 500), rng.integers(0, 1 << 34, 200), [0, 127, 128, 16383, 16384]))
    data, ends = ranked_search.pack(values)
    assert ranked_search.unpack(data).tolist() == values.tolist() and ends[-1] == len(data)


def test_ranked_search_of_empty_tables(spark):
    assert ranked(spark, [], [], 5) == {}
    texts = frame(spark, ["a b"]).where("false")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(texts, items).collect() == []


def test_ranked_search_with_other_id_types(spark):
    docs = spark.createDataFrame([("b", "cat"), ("a", "cat"), (None, "cat"), ("c", "dog cat")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "cat")], "item_id string, text string")
    got = [r.doc_id for r in ranked_search.search(docs, items).orderBy("rank").collect()]
    assert got == ["a", "b", None, "c"]


def test_search_sql_is_registered():
    assert "op13_ranked_search" in SQL
