"""The opN_* queries: each applies one operator to its whole table."""

from __future__ import annotations

import functools

from ..sources.tables import read_table
from .licences import scan_sql


def tokenizer_spec(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer file's content; the file itself stays where the package keeps it."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def tokenizer_model(name: str) -> bytes:
    """A public sentencepiece model's content."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def word_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The pieces of a public tokenizer: those with the word mark begin words, the others
    go on (``##``); control and byte pieces are left out."""
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            pieces.append(piece[1:] if piece.startswith("\u2581") else "##" + piece)
    return [p for p in pieces if "\u2581" not in p and p not in ("", "##")]


def _documents(run):
    @functools.wraps(run)
    def query(spark, sf_dir):
        return run(read_table(spark, sf_dir, "documents"), spark, sf_dir)
    return query


@_documents
def op1_quality(docs, spark, sf_dir):
    from . import quality
    return quality.quality(docs)


@_documents
def op2_simhash(docs, spark, sf_dir):
    from . import simhash
    return simhash.near_duplicates(docs, shingle=3, max_bits=2)


@_documents
def op3_token_counts(docs, spark, sf_dir):
    from . import wordpiece
    return wordpiece.count_tokens(docs, word_pieces())


@_documents
def op4_private_data(docs, spark, sf_dir):
    from . import pii
    return pii.find_private(docs)


@_documents
def op5_bpe(docs, spark, sf_dir):
    from . import bpe
    return bpe.digests(docs, tokenizer_spec())


@_documents
def op6_line_dedup(docs, spark, sf_dir):
    from . import line_dedup
    return line_dedup.dedup_digests(docs, min_docs=10, min_length=1)


@_documents
def op7_decontamination(docs, spark, sf_dir):
    from . import decontaminate
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark")).drop("_k1", "_k2")


@_documents
def op8_token_files(docs, spark, sf_dir):
    from . import token_files
    return token_files.round_trip(docs, tokenizer_spec())


@_documents
def op11_alignment(docs, spark, sf_dir):
    from . import alignment
    return alignment.align_documents(docs, tokenizer_spec("byte_bpe_50k.json"), tokenizer_model("piece_bpe_32k.model"))


@_documents
def op12_secrets(docs, spark, sf_dir):
    from . import secrets
    return secrets.find_secrets(docs).drop("found")


@_documents
def op13_ranked_search(docs, spark, sf_dir):
    from . import ranked_search
    return ranked_search.search(docs, read_table(spark, sf_dir, "benchmark"), k=50)


# The rules of the url query (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@_documents
def op9_licences(docs, spark, sf_dir):
    from . import licences
    return licences.scan(docs)


def op10_url_rules(spark, sf_dir):
    from . import url_rules
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_private_data": op4_private_data,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_token_files": op8_token_files,
    "op9_licences": op9_licences,
    "op10_url_rules": op10_url_rules,
    "op11_alignment": op11_alignment,
    "op12_secrets": op12_secrets,
    "op13_ranked_search": op13_ranked_search,
}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql() -> str:
    tests = [(v, h, p) for v, h, p in URL_RULES]
    rows = ", ".join(f"('{v}', '{h}', '{p}', {i})" for i, (v, h, p) in enumerate(tests))
    return f"""
WITH rules(verdict, rh, rp, pos) AS (VALUES {rows}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
                              THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), {UPPER_LOWER}) AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT host, path, rh || rp AS rule, verdict,
                row_number() OVER (PARTITION BY host, path
                    ORDER BY length(rh) - length(replace(rh, '.', '')) DESC, length(rp) DESC, pos DESC) AS n
         FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
           ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.n = 1
"""


LINE_SQL = f"""
WITH lines AS (SELECT d.rid, d.doc_id, l.i, d.parts[l.i] AS line,
                      translate(trim(d.parts[l.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                {UPPER_LOWER}) AS key
               FROM (SELECT row_number() OVER () AS rid, doc_id,
                            string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
                    LATERAL (SELECT unnest(generate_series(1, len(d.parts))) AS i) l),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (key IN (SELECT key FROM frequent)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                       FILTER (key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM lines GROUP BY rid, doc_id
"""


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RE_WS = r"[\x20\x09-\x0D]+"
QUALITY_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
                     list_filter(regexp_split_to_array(coalesce(text, ''), '{RE_WS}'), lambda x: x <> '') AS words
              FROM documents),
windows AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
            FROM docs, LATERAL (SELECT unnest(generate_series(1, len(words) - 7)) AS i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n
            FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, doc_id, source, text, line,
                 translate(regexp_replace(trim(line, {WS}), '{RE_WS}', ' ', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
          FROM (SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE trim(line, {WS}) <> ''),
sized AS (SELECT *, len(norm) - len(replace(norm, ' ', '')) + 1 AS n_words FROM lines),
frequent AS (SELECT source, norm FROM sized
             GROUP BY source, norm HAVING count(DISTINCT (doc_id, text)) > 100),
removed AS (SELECT s.rid, sum(s.n_words) AS n FROM sized s JOIN frequent f
              ON s.norm = f.norm AND s.source IS NOT DISTINCT FROM f.source GROUP BY s.rid),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
figures AS (SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
                   len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
                   CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
            FROM docs LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
           AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM figures
"""


SEARCH_SQL = f"""
WITH terms AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}),
                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
               FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
lengths AS (SELECT rid, count(*) AS n FROM terms GROUP BY rid),
total AS (SELECT count(*) AS nd, CAST(coalesce(sum(n), 0) AS BIGINT) AS nt FROM lengths),
found AS (SELECT rid, doc_id, term, count(*) AS tf FROM terms GROUP BY rid, doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM found GROUP BY term), total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}),
              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, rid, doc_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN found USING (term) JOIN lengths USING (rid), total
           GROUP BY item_id, rid, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank,
                  doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


SQL = {
    "op13_ranked_search": SEARCH_SQL,
    "op1_quality": QUALITY_SQL,
    "op6_line_dedup": LINE_SQL,
    "op9_licences": scan_sql(),
    "op10_url_rules": _url_sql(),
}
