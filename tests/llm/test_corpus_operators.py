"""Quality, line dedup, SimHash, decontamination, licences, url rules, pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailfold.llm import bpe, decontaminate, licences, line_dedup, quality, registry, simhash, url_rules
from mailfold.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_text` string, `_k1` long, host string"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 9))) for _ in range(4000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Documents with copies, near copies, hot lines, repeats, leaks, nulls, ties."""
    docs = []
    for i in range(60):
        docs.append(prose(60 + i, i) + "\n" + prose(30, 1000 + i))
    docs += [docs[3]] * 25                                              # exact copies
    docs += [docs[4] + f"\n{prose(1, 2000 + i)}" for i in range(15)]     # near copies
    docs += [f"Common Header LINE {i % 7}\n" + prose(40, 3000 + i) for i in range(30)]
    docs += ["  Shared line of all \n" + prose(35, 4000 + i) + "\nshared LINE of all" for i in range(14)]
    docs += [" ".join([prose(10, 5000)] * 6), "one two\none two\n\none two\n", "#*$ %& | <> " * 30]
    docs += [None, "", " \t\n", "short", "short", prose(20_000, 6000), "\n" * 500, "É É é ß\x0b\x0cİ"]
    return docs


def frame(spark, texts, ids=None):
    rows = [((ids[i] if ids else i), t, "en", f"s{i % 2}" if i % 9 else None, len(t or ""), "clash", 5, "clash")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def register(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return con


def same_rows(df, sql, con):
    want = con.sql(sql)
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    key = lambda rows: sorted(map(repr, rows))
    assert key(got) == key([tuple(r) for r in want.fetchall()])


# -- op 1 ---------------------------------------------------------------------------

def plain_quality(texts, hosts, max_docs):
    def norm(line):
        return re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(re.split(r"[\x20\x09-\x0D]+", line.strip(" \t\n\x0b\x0c\r")))))
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    lines = [[norm(x) for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")] for t in texts]
    held = Counter()
    for host, text in zip(hosts, texts):                 # every text is a document of its own
        for line in {norm(x) for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")}:
            held[host, line] += 1
    out = []
    for w, ls, host, text in zip(words, lines, hosts, texts):
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        seen = Counter(wins)
        covered = {p for i, x in enumerate(wins) if seen[x] > 1 for p in range(i, i + 8)}
        raw = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        gone = sum(len(x.split(" ")) for x in ls if held[host, x] > max_docs)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(raw) - len(set(raw)),
                    len(covered), failed, not failed and len(w) - gone >= .5 * len(w), gone))
    return out


@pytest.mark.parametrize("max_docs", [3, 100])
def test_quality_equals_the_plain_version(spark, max_docs):
    texts = corpus()
    docs = frame(spark, texts)
    hosts = [f"s{i % 2}" if i % 9 else None for i in range(len(texts))]
    want = plain_quality(texts, hosts, max_docs)
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality(docs, max_docs=max_docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = quality.keep_good(docs, max_docs=max_docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert sorted(rows) == [i for i, w in enumerate(want) if w[6]]
    for i, r in rows.items():
        assert len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]) == want[i][0] - want[i][7]
        assert r.n_chars == len(r.text) and (want[i][7] or r.text == texts[i])


def test_quality_sql_and_empty(spark):
    docs = frame(spark, corpus())
    same_rows(quality.quality(docs), registry.SQL["op1_quality"], register(docs))
    assert quality.quality(docs.limit(0)).count() == quality.keep_good(docs.limit(0)).count() == 0


def test_long_lines_and_copies_count_as_lines_of_their_documents(spark):
    notice = prose(60, 5)                                               # one line of sixty words
    texts = [f"{notice}\n{prose(30, 1000 + i)}" for i in range(8)] + [prose(30, 77)] * 8 + [prose(40, 78)]
    docs = frame(spark, texts).withColumn("source", F.col("lang"))
    got = {r.doc_id: r for r in quality.quality(docs, max_docs=5).collect()}
    assert [got[i].n_removed_words for i in range(17)] == [60] * 8 + [30] * 8 + [0]
    assert [got[i].kept for i in range(17)] == [False] * 16 + [True]
    con = register(docs)
    sql = registry.SQL["op1_quality"].replace("> 100)", "> 5)")
    assert sql != registry.SQL["op1_quality"]
    same_rows(quality.quality(docs, max_docs=5), sql, con)


def test_repeated_rows_do_not_inflate_removed_words(spark):
    texts = [f"menu item line\n{prose(30, i)}" for i in range(5)]
    docs = frame(spark, texts).union(frame(spark, texts))
    assert {r.n_removed_words for r in quality.quality(docs.withColumn("source", docs.lang), max_docs=3).collect()} == {3}


# -- op 2 ---------------------------------------------------------------------------

def components_by_pairs(fps, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if (a ^ b).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_all_pairs(spark):
    texts = corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [simhash.fingerprint(t, 3) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert {i: r.component_id for i, r in got.items()} == components_by_pairs(fps, range(len(texts)))
    kept = simhash.keep_representatives(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()})
    assert kept.columns == SCHEMA.replace("`", "").replace(" long", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_of_dense_fingerprints(spark, max_bits):
    rng = random.Random(max_bits)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << rng.randrange(20) for _ in range(rng.randint(0, 4))) for _ in range(400)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = {f & (1 << 64) - 1 for f in fps}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rows = spark.createDataFrame([(signed(f),) for f in fps], "_fp long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.link_fingerprints(rows, max_bits).collect())
    want = sorted(tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps
                  if a < b and (a ^ b).bit_count() <= max_bits)
    assert got == want and len(want) > 200


def test_null_ids_repeats_and_empty(spark):
    texts = ["a b c d", "a b c d", "x y z", "x y z", None, ""]
    docs = frame(spark, texts, [None, 7, None, None, 3, 3])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (None, None), (None, None), (3, 3), (3, 3)], key=repr)
    assert sorted((r.doc_id for r in simhash.keep_representatives(docs).collect()), key=repr) == sorted(
        [None, None, None, 3, 7], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_repeated_id_loses_no_text_and_keeps_no_copy(spark):
    a, b, c = prose(60, 61), prose(60, 62), prose(60, 63)
    docs = frame(spark, [a, a, b, c, b, None, None], ids=[1, 2, 2, 3, 2, 4, 5])
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect()), key=repr)
    assert kept == sorted([(1, a), (2, b), (3, c), (4, None)], key=repr)
    clash = docs.withColumn("_k1", F.lit(7)).withColumn("_n", F.lit(1)).withColumn("_fp", F.lit(3)).withColumn("root", F.lit(1))
    assert sorted(r.doc_id for r in simhash.keep_representatives(clash).collect()) == [1, 2, 3, 4]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# -- op 6 ---------------------------------------------------------------------------

def test_line_dedup_equals_sql(spark):
    docs = frame(spark, corpus())
    same_rows(line_dedup.dedup_digests(docs), registry.SQL["op6_line_dedup"], register(docs))
    assert line_dedup.dedup_digests(docs.limit(0)).count() == 0


def test_dedup_documents_keeps_columns_and_texts(spark):
    docs = frame(spark, corpus())
    digests = {r.doc_id: r for r in line_dedup.dedup_digests(docs).collect()}
    out = line_dedup.dedup_documents(docs)
    assert out.columns == docs.columns and out.schema == docs.schema or out.dtypes == docs.dtypes
    for r in out.collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == digests[r.doc_id].kept_sha256
        assert r.text is None or r.n_chars == len(r.text)


def answers(state, spark, docs):
    return sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_digests(docs, 10, 1, state=state).collect())


def test_insert_and_delete_are_reversible(spark):
    texts = corpus()
    docs = frame(spark, texts)
    first, rest = docs.where("doc_id < 110"), docs.where("doc_id >= 110")
    state = line_dedup.new_state(line_dedup.document_keys(first, "text", "doc_id", 1), 10)
    before = answers(state, spark, docs)
    grown = line_dedup.insert_documents(state, rest)
    assert answers(grown, spark, docs) == sorted(
        (r.doc_id, r.n_dropped) for r in line_dedup.dedup_digests(docs).collect()) != before
    back = line_dedup.delete_documents(grown, rest)
    assert answers(back, spark, docs) == before
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, state.counts.collect()))
    with pytest.raises(ValueError):
        line_dedup.delete_documents(back, rest)


def test_deletions_of_strangers_and_replayed_batches_change_nothing(spark, tmp_path):
    docs = frame(spark, [f"shared line\nown {i}" for i in range(12)])
    others = frame(spark, ["shared line\nown x"] * 3, ids=[100, 101, 102])
    state = line_dedup.new_state(line_dedup.document_keys(docs, "text", "doc_id", 1), 10)
    counts = lambda s: sorted(map(tuple, s.counts.collect()))
    before = counts(state)
    for stranger in (others, docs.where("doc_id = 1").union(docs.where("doc_id = 1"))):     # unknown; once too often
        with pytest.raises(ValueError):
            line_dedup.delete_documents(state, stranger)
    once = line_dedup.delete_documents(state, docs.where("doc_id < 3"), batch="a")
    again = line_dedup.delete_documents(once, docs.where("doc_id < 3"), batch="a")
    assert counts(once) == counts(again) != before
    line_dedup.save_state(again, f"{tmp_path}/state")
    kept = line_dedup.load_state(spark, f"{tmp_path}/state")
    assert counts(line_dedup.insert_documents(kept, docs.where("doc_id < 3"), batch="a")) == counts(once)
    back = line_dedup.insert_documents(kept, docs.where("doc_id < 3"), batch="b")
    assert counts(back) == before and state_answers(back, docs) == state_answers(state, docs)


def state_answers(state, docs):
    return sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_digests(docs, 10, 1, state=state).collect())


def test_cuckoo_filter_never_forgets_and_deletes():
    rng = random.Random(5)
    keys = [(rng.getrandbits(63) - (1 << 62), rng.getrandbits(63) - (1 << 62)) for _ in range(5000)]
    held = line_dedup.CuckooFilter.from_bytes(line_dedup.build_filter(*zip(*keys)))
    assert held.contains(*zip(*keys)).all()
    others = [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(5000)]
    assert held.contains(*zip(*others)).mean() < 0.01
    for k in keys[:2500]:
        assert held.delete(*k)
    assert held.contains(*zip(*keys[2500:])).all() and held.contains(*zip(*keys[:2500])).mean() < 0.01
    small = line_dedup.CuckooFilter.for_keys(4)
    assert not all(small.insert(*k) for k in keys[:50])
    assert len(line_dedup.changed_filter(small.to_bytes(), tuple(zip(*keys[:50])), ((), ()),
                                         lambda: tuple(zip(*keys[:50])))) > len(small.to_bytes())


def test_many_shards_give_the_same_answers(spark, monkeypatch):
    docs = frame(spark, corpus())
    want = answers(None, spark, docs)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 2)
    assert answers(None, spark, docs) == want


# -- op 7 ---------------------------------------------------------------------------

def smith_waterman(item, passage):
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_leaks_equal_aligning_everything(spark):
    rng = random.Random(2)
    items = [prose(rng.randint(12, 50), 9000 + i) for i in range(12)] + ["too few words here", None, ""]
    items.append(items[0].upper())                                       # equal words: one item

    def edited(text, every):
        words = text.split()
        return " ".join("edit" + w if i % every == every - 1 else w for i, w in enumerate(words))
    texts = [prose(50, 100 + i) for i in range(20)]
    texts += [prose(30, 200) + " " + items[1] + ". " + prose(30, 201), prose(9, 202) + " " + edited(items[2], 5),
              edited(items[3], 4).title() + "\n" + prose(500, 203), items[4].replace(" ", ", \n"),
              " ".join(items[5].split()[:4]), items[6] + " " + prose(300, 7) + " " + items[7], items[8], items[8],
              None, "", prose(20, 1) + " " + " ".join(w for i, w in enumerate(items[9].split()) if i % 6),
              " ".join(x for i, w in enumerate(items[10].split()) for x in ([w, "added"] if i % 5 == 0 else [w]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, words string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items[:12]):
            share = smith_waterman(words(item), words(text)) / (2 * len(words(item)))
            if share >= .5:
                want[d, k] = round(share, 6)
    assert {k: r.score for k, r in got.items()} == want
    assert {(20, 1), (21, 2), (22, 3), (23, 4), (25, 6), (25, 7), (26, 8), (27, 8), (30, 9), (31, 10)} == set(want)
    r = got[20, 1]
    assert words(texts[20])[r.start_word:r.end_word] == words(items[1])
    clean = decontaminate.drop_leaks(docs, bench)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert clean.columns == docs.columns
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_copied_everywhere_are_still_found(spark):
    item = prose(30, 77)
    docs = frame(spark, [prose(20, i) + " " + item for i in range(300)] + [prose(60, 500 + i) for i in range(50)])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()) == list(range(300))


def test_heavily_edited_leaks_equal_aligning_everything(spark):
    rng = random.Random(8)
    items = [prose(rng.randint(8, 59), 9500 + i) for i in range(10)]

    def edited(text, every, at):
        return " ".join("edit" + w if i % every == at else w for i, w in enumerate(text.split()))
    copies = [edited(t, every, at) for t in items for every, at in ((3, 0), (3, 1), (3, 2), (4, 1))]
    copies += [" ".join(x for w in t.split() for x in (w, "added" + w)) for t in items]      # no two words adjacent
    copies += [" ".join(w for i, w in enumerate(t.split()) if i % 4) for t in items]
    texts = [prose(70, 300 + i) + " " + t + " " + prose(70, 700 + i) for i, t in enumerate(copies)]
    words = [t.split() for t in texts]
    want = {}
    for d, text in enumerate(words):
        for k, item in enumerate(items):
            share = decontaminate.local_alignment(*(np.array([hash(w) for w in x]) for x in (item.split(), text)))[0] / (
                2 * len(item.split()))
            if share >= .5:
                want[d, k] = round(share, 6)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    # every word is common: no gram is rare
    docs = frame(spark, texts + [" ".join(WORDS)] * 2)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want and len(want) > 40


def test_a_long_item_reaches_back_over_a_short_one(spark):
    short, long = prose(16, 801), prose(59, 802)
    other = prose(62, 803).split()
    words = (other[:2] + short.split()[:3] + other[5:59] + short.split()[5:8] + long.split()
             + prose(90, 804).split())
    docs = frame(spark, [" ".join(words)])
    bench = spark.createDataFrame([(0, short), (1, long)], "item_id long, text string")
    seeds = decontaminate.seeds_of(
        decontaminate.benchmark_items(bench, "text", "item_id", 3, 8),
        spark.createDataFrame([(None, 1)], "word long, n long"), 3, 1.0)
    near = decontaminate.passages(docs, seeds, "text", "doc_id", 3).collect()
    spans = sorted((r.start, r.start + len(r.words)) for r in near)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert [(r.item_id, r.score) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1.0)]


def test_hashed_words_are_the_words_in_lower_case():
    rng = random.Random(4)
    texts = [None, "", "  ", "Été×À÷é_1", "É", "a\x00B", "naïve “x” ΣΑΣ İ", "ª µ½", "w" * 5000, "Straße", "×", "x×", "3rd É.é"]
    texts += ["".join(rng.choice("aBÉé×÷ß _-.9\nЖ日") for _ in range(rng.randrange(30))) for _ in range(300)]
    hashes, starts = decontaminate.hashed_words(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        words = re.findall(r"\w+", (text or "").lower())
        assert starts[i + 1] - starts[i] == len(words), text
        for word, h in zip(words, hashes[starts[i]:starts[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_items_that_share_an_id_or_have_none_or_are_short(spark):
    items = [(1, prose(20, 31)), (1, prose(25, 32)), (None, prose(18, 33)), (2, "four words of text"), (3, "Word"),
             (4, None), (5, "four words of text"), (6, "two words")]
    texts = [prose(40, 51) + " " + items[0][1], items[1][1] + " " + prose(9, 52), prose(9, 53) + items[2][1] + prose(5, 54),
             "say Four Words, of text! " + prose(30, 55), "four words in text", "word", "Two words?", "two words more word", None,
             prose(9, 56) + " " + items[0][1] + " " + items[1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pass_seeds in (1 << 21, 100):                       # one pass, several passes
        found = decontaminate.find_leaks(frame(spark, texts), bench, pass_seeds=pass_seeds).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == sorted(
            [(0, 1), (1, 1), (2, None), (3, 2), (5, 3), (6, 6), (9, 1), (9, 1)], key=repr)
        assert {r.score for r in found if r.doc_id != 2} == {1.0}
    r = next(r for r in found if r.doc_id == 3)
    assert (r.start_word, r.end_word) == (1, 5)
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame(spark, texts), bench).collect()) == [4, 7, 8]


def test_seed_words_meet_the_bound():
    rng = np.random.default_rng(1)
    for begins in (6, 20, 80):
        rates = np.log(rng.random(begins) ** 4 * 1e-4)
        for runs in (-2, 0, 1, begins // 2, begins):
            m, t = decontaminate.seed_words(rates, runs, 200)
            assert 1 <= t <= max(runs, 1) and m <= begins
            assert t <= max(runs - (begins - m), 1)         # so many of the m begin a clean run
    assert decontaminate.seed_words(np.log(np.full(38, 1e-4)), 18, 240)[1] > 1


# -- op 9 ---------------------------------------------------------------------------

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """# This program is free software: you can redistribute it and/or modify it under the
# terms of the GNU General Public License as published by the Free Software Foundation,
# either version 3 of the License, or (at your option) any later version."""


def test_licences(spark):
    texts = [MIT, "text\nAll rights reserved.\nmore text", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
             "licensed UNDER the apache  license version 2 0", "A licence, but an unknown one.", None, "",
             "x. Licensed under the Apache License, Version 2.0. y", prose(5000, 1) + "\nAll rights reserved.",
             "you may not use this file except in compliance with the License.", "Do not distribute.\nAll rights reserved.",
             "All rights reserved. Do not distribute."]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [got[i].licences for i in range(len(texts))] == [
        "MIT", "LicenseRef-Proprietary", "CC-BY-NC-4.0,MIT", "Apache-2.0", None, None, None, "Apache-2.0",
        "LicenseRef-Proprietary", None, "LicenseRef-Proprietary", "LicenseRef-Proprietary"]
    assert got[0].sentence_ids == "MitRef,PermissionGrant,NoticeIncluded"
    assert got[9].unmatched == "ApacheComply" and got[10].unmatched == "NoDistribution" and got[11].unmatched is None
    same_rows(licences.scan(docs), licences.scan_sql(), register(docs))
    assert licences.scan(docs.limit(0)).count() == 0


def test_more_notices_and_rights_reserved(spark):
    mit = " ".join(t for n, t in licences.SENTENCES if n in ("PermissionGrant", "NoticeIncluded", "AsIs"))
    texts = ["Copyright (c) 2020 Foo Corp. All rights reserved.\n\n" + mit, "All rights reserved.",
             "All rights reserved. Do not distribute.",
             "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
             "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
             "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General "
             "Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your "
             "option) any later version."]
    docs = frame(spark, texts)
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert got == {0: "MIT", 1: "LicenseRef-Proprietary", 2: "LicenseRef-Proprietary", 3: "ISC", 4: "LGPL-2.1-or-later"}
    same_rows(licences.scan(docs), registry.SQL["op9_licences"], register(docs))


def test_longer_licence_rules_go_first(spark):
    got = licences.scan(frame(spark, [GPL.replace("\n# either", "\n# either")])).first()
    assert got.licences == "GPL-3.0-or-later" and got.unmatched is None


GPL3_NOTICE = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
GPL2_NOTICE = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""


def test_licences_of_wrapped_notices(spark):
    gpl3, gpl2 = "FreeSoftware,Gpl3Either,GplHope", "FreeSoftware,Gpl2Terms,Gpl2Later"
    apache = "ApacheRef2,ApacheComply,ApacheCopy,ApacheAsIs"
    want = [(GPL3_NOTICE, gpl3, "GPL-3.0-or-later"), (GPL2_NOTICE, gpl2, "GPL-2.0-or-later"),
            (APACHE_NOTICE, apache, "Apache-2.0"),
            (MIT + MIT_AS_IS, "MitRef,PermissionGrant,NoticeIncluded,AsIs", "MIT")]
    for mark in ("% ", "! ", ";; ", " * ", "// ", "> "):
        want += [(mark + text.replace("\n", "\n" + mark), ids, name) for text, ids, name in want[:4]]
    want += [(text.replace("\n", "\r\n"), ids, name) for text, ids, name in want[:4]]
    want += [("MIT\n\nLicense", None, None), ("MIT\nLicense", "MitRef", "MIT"), ("A MIT\nLicense", None, None),
             ("MIT. License", None, None), ("MIT\x01License", "MitRef", "MIT")]
    docs = frame(spark, [w[0] for w in want])
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    same_rows(licences.scan(docs), registry.SQL["op9_licences"], register(docs))
    assert [(got[i].sentence_ids, got[i].licences) for i in range(len(want))] == [w[1:] for w in want]


def test_licence_sql_agrees_on_notices_broken_anywhere(spark):
    rng = random.Random(11)
    breaks = ["\n", "\n\n", "\r\n", "\n# ", "\n! ", "\n * ", " \n", "\x01", "\t", "  ", ". ", "; ", "\n;; "]
    texts = []
    for _ in range(400):
        words = " ".join(rng.choice(licences.SENTENCES)[1] for _ in range(rng.randint(1, 4))).split(" ")
        texts.append("".join(w + (rng.choice(breaks) if rng.random() < 0.06 else " ") for w in words))
    docs = frame(spark, [*texts, None, "", "\n", "\x01"])
    same_rows(licences.scan(docs), registry.SQL["op9_licences"], register(docs))
    assert licences.scan(docs).where("n_sentences > 0").count() > 200


def test_licence_cues_stand_in_the_raw_text(spark):
    texts = ["This work is in the public\ndomain.", "This work is in the public  domain.",
             "# This work is in the public\n# domain.", "All\nrights\nreserved."]
    got = {r.doc_id: r.licences for r in licences.scan(frame(spark, texts)).collect()}
    assert got == {0: "LicenseRef-Public-Domain", 1: "LicenseRef-Public-Domain", 2: "LicenseRef-Public-Domain",
                   3: "LicenseRef-Proprietary"}
    own = licences.scan(frame(spark, ["Take it. Use as you like!", "go on", "nothing"]),
                        sentences=[("Free", "use as you like"), ("Go", "Go on.")], rules=[("Any", "Free"), ("On", "Go")])
    assert sorted((r.doc_id, r.licences) for r in own.collect()) == [(0, "Any"), (1, "On"), (2, None)]


# -- op 10 --------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://COM/x", "https://a.example.com/en/1", "https://WWW.example.com/en/2",
        "https://x.www.example.com/en/2?u=http://a.net/es/", "http://example.com/en", "http://example.com/en/",
        "http://xexample.com/en/", "http://a.net/es/", "http://a.net/ES/", "http://net/fr/x#y", "http://net?/fr/",
        "a://b://c", "http://com", "http://example.com:80/en/", "http://example.com./en/", "http://a.net/es/"]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "clash", None) for i, u in enumerate(urls)],
                                 "page_id long, url string, host string, `_url` string")


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(h.count("."), len(p), i, h + p, v) for i, (v, h, p) in enumerate(rules)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[4] if fits else "allow"


def test_url_rules_equal_the_plain_version(spark):
    rng = random.Random(4)
    part = lambda n: [rng.choice(["a", "b", "ab", ""]) for _ in range(rng.randint(1, n))]
    rules = [(rng.choice(["allow", "block"]), ".".join(part(3)), "/" + "/".join(part(3))) for _ in range(60)]
    urls = ["x://" + ".".join(part(4)) + "/" + "/".join(part(4)) for _ in range(400)]
    for chosen, given in ((registry.URL_RULES, URLS), (rules, URLS + urls)):
        want = [(i, *plain_verdict(u, chosen)) for i, u in enumerate(given)]
        for limit in (url_rules.MAX_BROADCAST_BYTES, 0):
            got = url_rules.judge_urls(pages(spark, given), chosen, max_broadcast_bytes=limit)
            assert sorted(map(tuple, got.collect())) == want
    assert url_rules.judge_urls(pages(spark, []), rules).count() == 0


# -- pipeline -------------------------------------------------------------------------

def test_pipeline_equals_a_plain_run(spark, tmp_path):
    item = prose(30, 88)
    texts = corpus() + [prose(40, 700) + "\n" + item, "menu\n" + item]
    docs = frame(spark, texts).drop("_text", "_k1", "host")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    hosts = {r.doc_id: r.source for r in docs.collect()}
    order = sorted(rows)
    good = plain_quality([rows[i] for i in order], [hosts[i] for i in order], 100)
    rows = {i: rows[i] for i, q in zip(order, good) if q[6]}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} if k)
    rows = {i: "\n".join(x for x in t.split("\n") if held[key(x)] < 10) for i, t in rows.items()}
    groups = components_by_pairs([simhash.fingerprint(t, 3) for t in rows.values()], list(rows))
    rows = {i: rows[i] for i in set(groups.values())}
    rows = {i: t for i, t in rows.items() if item not in t}
    coder = bpe.WordBpe(registry.tokenizer_spec())
    want = {i: coder.library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert all(r.decoded == coder.decode(r.ids) and r.n_tokens == len(r.ids) for r in got.values())
    assert len(want) > 60 and not {len(texts) - 1, len(texts) - 2} & set(want)
