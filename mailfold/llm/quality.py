"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base figures of a document (words are runs of ``[^\\x20\\x09-\\x0D]``):
``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (characters
of ``#*$%&|<>``); ``n_dup_lines`` (lines with a word that equal an earlier line
of the document); ``n_repeat_words`` (words inside windows of eight words that
the document holds twice or more, the first one included).  ``base_failed``:
fewer than 20 words, or more than 30 % of them repeated.

Line frequency: each line is normalised (ends stripped, white space collapsed,
A-Z lower-cased, digits as 0) and hashed to 128 bits; for each host the documents
that hold it are counted, each once.  A line that more than ``max_docs`` documents
of the host hold is boilerplate, whatever its length, and is removed.  A document is
depleted, and rejected, when the lines left hold fewer than ``min_share`` of its words.
``kept`` is false for documents that fail the base rules or are depleted.

Windows are compared by a 64-bit hash inside one document.  Null texts have no
words and fail.  A null host is a host of its own.  Rows of equal id, host and text
are one document and get equal results; copies under other ids count.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_WS, LOWER, UPPER, let, materialise, require_columns, row_key

# Fixed values of the contract.
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"

MAX_DOCS = 100
MIN_SHARE = 0.5


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(tokens: Column) -> Column:
    """Words covered by windows of WINDOW words that occur at least twice in ``tokens``."""
    def covered(hashes):
        def by_hash(ordered):
            # equal hashes stand side by side; a window repeats if a neighbour has its hash
            twin = lambda k: F.get(ordered, k)["h"]
            repeats = F.filter(ordered, lambda x, k: F.coalesce(x["h"] == twin(k - 1), F.lit(False))
                               | F.coalesce(x["h"] == twin(k + 1), F.lit(False)))
            places = F.sort_array(F.transform(repeats, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda acc, i: F.struct(
                (i + WINDOW).alias("end"),
                (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n")))["n"]
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(marked), by_hash))

    window = lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(WINDOW)))
    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - WINDOW), window)
    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                    lambda line: F.trim(line, F.lit(ASCII_WS)) != "")


def base_figures(text: Column) -> Column:
    """Struct of the base figures of one text."""
    def figures(tokens):
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            repeated_words(tokens).alias("n_repeat_words"))

    def duplicates(lines):
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_SYMBOL, "")).cast("long")
    of_words = let(words(text), figures)
    return let(of_words, lambda w: F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
        let(lines_with_words(text), duplicates).alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def passes_base(text: Column) -> Column:
    return let(words(text), lambda tokens: ~base_failed(F.size(tokens), repeated_words(tokens)))


def normalised_line(line: Column) -> Column:
    return F.translate(F.regexp_replace(F.trim(line, F.lit(ASCII_WS)), SPACE, " "),
                       UPPER + "123456789", LOWER + "0" * 9)


def line_hashes(line: Column):
    """Of a normalised line."""
    return F.xxhash64(line), F.xxhash64(F.lit("second"), line)


def document_lines(docs: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    """(_k1, _k2, host, line_no, h1, h2, n_words): the lines with words."""
    norms = F.transform(lines_with_words(F.col(text)), normalised_line)
    h1, h2 = line_hashes(F.col("_line"))
    n_words = F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + 1
    return (docs.select(*row_key(doc_id, host, text), F.col(host).alias("host"),
                        F.posexplode(norms).alias("line_no", "_line"))
                .select("_k1", "_k2", "host", "line_no", h1.alias("h1"), h2.alias("h2"), n_words.alias("n_words")))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h1, h2) of the lines above the limit; distinct documents are counted in two
    aggregations, so a line that a third of all documents hold is pre-aggregated everywhere."""
    once = lines.select("host", "h1", "h2", "_k1", "_k2").distinct()
    return (once.groupBy("host", "h1", "h2").agg(F.count("*").alias("n"))
                .where(F.col("n") > max_docs).select("host", "h1", "h2"))


def _hits(docs, text, host, doc_id, max_docs):
    lines = materialise(document_lines(docs, text, host, doc_id), "quality-lines")
    frequent = frequent_lines(lines, max_docs).withColumnRenamed("host", "_host")
    same = ["h1", "h2"]
    return (lines.join(frequent, same).where(F.col("host").eqNullSafe(F.col("_host"))))


def quality(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
            max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, the base figures, base_failed, n_removed_words, kept."""
    require_columns(docs, text, host, doc_id)
    # equal rows share a key and would count their lines once each: a line number counts once
    removed = (_hits(docs, text, host, doc_id, max_docs)
               .select("_k1", "_k2", "line_no", "n_words").distinct()
               .groupBy("_k1", "_k2").agg(F.sum("n_words").alias("n_removed_words")))
    figures = docs.select(*row_key(doc_id, host, text), F.col(doc_id).alias("_id"),
                          base_figures(F.col(text)).alias("_f"))
    found = figures.join(removed, ["_k1", "_k2"], "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    n_words = F.col("_f.n_words")
    failed = base_failed(n_words, F.col("_f.n_repeat_words"))
    depleted = n_words - F.col("n_removed_words") < min_share * n_words
    return found.select(F.col("_id").alias(doc_id), "_f.*", failed.alias("base_failed"),
                        (~failed & ~depleted).alias("kept"), "n_removed_words")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
              max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, length: str = "n_chars") -> DataFrame:
    """The kept rows, without their frequent lines; a ``length`` column follows the text."""
    require_columns(docs, text, host, doc_id)
    gone = (_hits(docs, text, host, doc_id, max_docs)
            .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("h1", "h2")).alias("_gone")))
    # the base rules need the text alone: what fails them is neither shuffled nor judged again
    rows = docs.where(passes_base(F.col(text))).select(
        F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(host).alias("_host"),
        F.col(text).alias("_text"))
    found = rows.select("*", *row_key("_id", "_host", "_text")).join(gone, ["_k1", "_k2"], "left")

    def is_gone(line):
        h1, h2 = line_hashes(normalised_line(line))
        return F.array_contains("_gone", F.struct(h1.alias("h1"), h2.alias("h2")))

    left = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.filter(F.split("_text", "\n"), lambda line: ~is_gone(line)), "\n"))
    found = found.select("_row", F.col("_gone").isNotNull().alias("_cut"), F.col("_text"), left.alias("_left"))
    depleted = F.col("_cut") & (F.size(words(F.col("_left"))) < min_share * F.size(words(F.col("_text"))))
    changed = {text: F.col("_left")}
    if length in docs.columns:
        changed[length] = F.length("_left").cast(docs.schema[length].dataType)
    return found.where(~depleted).select(
        *(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
