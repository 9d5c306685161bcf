"""Parsing jobs: tool payloads (text or JSON) into mail records, ids and labels.

The original parses one payload at a time with Python regexes.  Here a table
of payloads is parsed in one pass of native expressions: ``split`` on a
look-ahead cuts a text payload into message blocks, ``explode`` makes them
rows, ``regexp_extract`` reads the headers.  A payload is one poll batch, so a
row never holds more than a page of mail.

Fixture renderers turn the event log into payloads of the shapes the mail
tool returns, so the parsers run on data that grows with the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.agg import ordered_listagg
from ..functions.text import nonempty, strip_recipient
from ..schema import MESSAGE_JSON, NO_SUBJECT, SNIPPET_CHARS

PAGE = 64  # messages per rendered payload (one poll page)

BLOCK_SPLIT = r"(?m)(?=^Message ID:)"
WS_EDGES = r"^\s+|\s+$"


def _strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(c, WS_EDGES, "")


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")


# --------------------------------------------------------------------------
# fixture renderers
# --------------------------------------------------------------------------

def _page(msgs: DataFrame) -> Column:
    return F.floor(F.col("id") / PAGE).cast("bigint")


def render_text_payloads(msgs: DataFrame) -> DataFrame:
    """One text payload per (mailbox, page): header lines, a blank line, the body.

    Every fourth message has an empty ``Subject:`` header, a missing date gives
    an empty ``Date:`` header, and the recipient is written in angle brackets.
    """
    k = F.col("k")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Message ID: "), F.col("id").cast("string")),
        F.concat(F.lit("Subject: "), F.when(k % 4 == 0, F.lit("")).otherwise(_one_line(F.col("subject")))),
        F.concat(F.lit("From: "), F.col("sender")),
        F.concat(F.lit("Date: "), F.coalesce(F.col("date"), F.lit(""))),
        F.when(F.col("recipient").isNotNull(), F.concat(F.lit("To: <"), F.col("recipient"), F.lit(">"))),
        F.concat(F.lit("Web Link: https://mail.example.com/m/"), F.col("id").cast("string")),
        F.lit(""),
        F.coalesce(F.col("body"), F.lit("")),
    )
    grouped = msgs.select("mailbox_id", _page(msgs).alias("page"), "id", block.alias("block"))
    return grouped.groupBy("mailbox_id", "page").agg(
        ordered_listagg("block", "\n\n", "id").alias("payload"))


def render_json_messages(msgs: DataFrame) -> DataFrame:
    """One JSON message per mail, with the key variations the legacy tool shows."""
    k = F.col("k")
    sid = F.col("id").cast("string")
    rec = F.struct(
        F.when(k % 5 != 0, sid).alias("message_id"),
        F.when(k % 5 == 0, sid).alias("id"),
        F.col("thread_id").alias("thread_id"),
        F.col("sender").alias("from"),
        F.col("recipient").alias("to"),
        F.when(k % 4 != 2, F.col("subject")).alias("subject"),
        F.col("snippet").alias("snippet"),
        F.when(k % 4 == 1, F.lit(None).cast("string")).when(k % 4 == 3, F.lit(""))
        .otherwise(F.col("body")).alias("body"),
        F.array_compact(F.array(F.lit("INBOX"), F.when(F.col("unread"), F.lit("UNREAD"))))
        .alias("labels"),
        F.col("date").alias("date"),
    )
    return msgs.select("mailbox_id", "id", F.to_json(rec).alias("payload"))


def render_search_payloads(msgs: DataFrame) -> DataFrame:
    """Search results per (mailbox, page): text lines on even pages, a JSON list on odd ones.

    JSON entries of every seventh message carry an empty id, which must be dropped.
    """
    page = _page(msgs)
    text_line = F.concat(F.lit("Message ID: "), F.col("id").cast("string"),
                         F.lit("\nSubject: "), _one_line(F.col("subject")))
    entry = F.to_json(F.struct(
        F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.col("id").cast("string"))
        .alias("message_id")))
    rows = msgs.select("mailbox_id", page.alias("page"), "id", text_line.alias("t"),
                       entry.alias("j"))
    agg = rows.groupBy("mailbox_id", "page").agg(
        ordered_listagg("t", "\n", "id").alias("text"),
        ordered_listagg("j", ",", "id").alias("json"))
    return agg.select(
        "mailbox_id", "page",
        F.when(F.col("page") % 2 == 0, F.col("text"))
        .otherwise(F.concat(F.lit("["), F.col("json"), F.lit("]"))).alias("payload"))


def render_label_listing(catalog: DataFrame) -> DataFrame:
    """The label listing per mailbox: bullet text, or a JSON list for even mailboxes."""
    line = F.concat(F.lit("• "), F.col("label"), F.lit(" (ID: "), F.col("label_id"), F.lit(")"))
    entry = F.to_json(F.struct(F.col("label").alias("name"), F.col("label_id").alias("id")))
    rows = catalog.select("mailbox_id", "label", line.alias("t"), entry.alias("j"))
    agg = rows.groupBy("mailbox_id").agg(
        ordered_listagg("t", "\n", "label").alias("text"),
        ordered_listagg("j", ",", "label").alias("json"))
    return agg.select(
        "mailbox_id",
        F.when(F.col("mailbox_id") % 2 == 0, F.concat(F.lit("["), F.col("json"), F.lit("]")))
        .otherwise(F.concat(F.lit("Labels:\n"), F.col("text"))).alias("payload"))


# --------------------------------------------------------------------------
# parsers
# --------------------------------------------------------------------------

def payload_kind(c: Column) -> Column:
    """P5: a payload that parses as JSON is structured; anything else is plain text."""
    return F.when(F.try_parse_json(c).isNotNull(), F.lit("json")).otherwise(F.lit("text"))


def json_objects(payload: Column, schema) -> Column:
    """The objects of a payload that is an object or a list, as an array of structs.

    A list is read as an array of JSON texts first, so an entry of another
    kind costs that entry only.
    """
    shape = schema if isinstance(schema, str) else schema.simpleString()
    entries = F.when(F.ltrim(payload).startswith("["),
                     F.from_json(F.variant_get(F.try_parse_json(payload), "$", "string"), "array<string>")
                     ).otherwise(F.array(payload))
    objects = F.filter(entries, lambda e: F.ltrim(e).startswith("{"))
    return F.transform(objects, lambda e: F.from_json(e, shape))


def _header(block: Column, name: str) -> Column:
    """Header value from the header block only; an empty header is '' (not the next line)."""
    return _strip(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(\S.*)?$", 1))


def parse_text_messages(payloads: DataFrame, keys=("mailbox_id", "page")) -> DataFrame:
    """P1 (+P6): text payload -> 0..n messages."""
    blocks = payloads.select(*keys, F.explode(F.split("payload", BLOCK_SPLIT)).alias("b"))
    b = _strip(F.col("b"))
    blocks = blocks.select(*keys, b.alias("block")).where(F.col("block").startswith("Message ID:"))
    head = F.regexp_extract("block", r"(?s)^(.*?)\n\s*\n", 1)
    has_blank = F.col("block").rlike(r"\n\s*\n")
    head = F.when(has_blank, head).otherwise(F.col("block"))
    body = _strip(F.regexp_extract("block", r"(?s)^.*?\n\s*\n(.*)$", 1))
    hdr = blocks.select(*keys, head.alias("h"), body.alias("body_raw"))
    to_raw = _header(F.col("h"), "To")
    return hdr.select(
        *keys,
        _header(F.col("h"), "Message ID").alias("id"),
        F.lit("").alias("thread_id"),
        _header(F.col("h"), "From").alias("sender"),
        F.when(to_raw != "", strip_recipient(to_raw)).alias("recipient"),
        F.coalesce(nonempty(_header(F.col("h"), "Subject")), F.lit(NO_SUBJECT)).alias("subject"),
        F.substring("body_raw", 1, SNIPPET_CHARS).alias("snippet"),
        nonempty("body_raw").alias("body"),
        F.array().cast("array<string>").alias("labels"),
        nonempty(_header(F.col("h"), "Date")).alias("date"),
        nonempty(_header(F.col("h"), "Web Link")).alias("web_link"),
    )


def parse_json_messages(payloads: DataFrame, keys=("mailbox_id",)) -> DataFrame:
    """JSON messages -> records, from one object or a list of them.

    ``message_id`` else ``id``; falsy optional fields -> NULL; a missing subject
    becomes '(no subject)' but an empty one stays empty.  List entries that are
    no objects are skipped.
    """
    rows = payloads.select(*keys, F.explode(json_objects(F.col("payload"), MESSAGE_JSON)).alias("m"))
    return rows.select(
        *keys,
        F.coalesce(F.col("m.message_id"), F.col("m.id"), F.lit("")).alias("id"),
        F.coalesce(F.col("m.thread_id"), F.lit("")).alias("thread_id"),
        F.coalesce(F.col("m.from"), F.lit("")).alias("sender"),
        nonempty(F.col("m.to")).alias("recipient"),
        F.coalesce(F.col("m.subject"), F.lit(NO_SUBJECT)).alias("subject"),
        F.coalesce(F.col("m.snippet"), F.lit("")).alias("snippet"),
        nonempty(F.col("m.body")).alias("body"),
        F.coalesce(F.col("m.labels"), F.array().cast("array<string>")).alias("labels"),
        nonempty(F.col("m.date")).alias("date"),
        nonempty(F.col("m.web_link")).alias("web_link"),
    )


def parse_search_ids(payloads: DataFrame, keys=("mailbox_id", "page")) -> DataFrame:
    """Ids from a search response, text or JSON list; empty ids dropped."""
    is_json = payload_kind(F.col("payload")) == "json"
    from_text = F.regexp_extract_all("payload", F.lit(r"Message ID:\s*(\S+)"), 1)
    listed = json_objects(F.col("payload"), "struct<message_id:string>")
    from_json = F.transform(F.filter(listed, lambda e: nonempty(e["message_id"]).isNotNull()),
                            lambda e: e["message_id"])
    ids = F.when(is_json, from_json).otherwise(from_text)
    return payloads.select(*keys, F.posexplode(ids).alias("position", "id"))


def parse_label_list(payloads: DataFrame, keys=("mailbox_id",)) -> DataFrame:
    """Label listing -> (name, id), from a JSON list or from '• name (ID: id)' lines;
    of a repeated name the last entry counts."""
    is_json = payload_kind(F.col("payload")) == "json"
    pat = r"•\s+(.+?)\s+\(ID:\s+(.+?)\)"
    names = F.regexp_extract_all("payload", F.lit(pat), 1)
    ids = F.regexp_extract_all("payload", F.lit(pat), 2)
    text_pairs = F.arrays_zip(names.alias("name"), ids.alias("id"))
    listed = F.from_json("payload", "array<struct<name:string,id:string>>")
    json_pairs = F.filter(listed, lambda e: e["name"].isNotNull() & e["id"].isNotNull())
    pairs = F.when(is_json, json_pairs).otherwise(text_pairs)
    later = lambda i: F.slice(pairs, i + 2, F.size(pairs))
    last = F.filter(pairs, lambda p, i: ~F.exists(later(i), lambda q: q["name"] == p["name"]))
    return (payloads.select(*keys, F.explode(last).alias("p"))
            .select(*keys, F.col("p.name").alias("label"), F.col("p.id").alias("label_id")))
