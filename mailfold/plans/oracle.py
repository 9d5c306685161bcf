"""DuckDB SQL that computes the same answers independently (the correctness gate).

Tables are the driver's parquet views.  The event log is spelled out once as
a CTE and the state tables are written with window functions, not with the
``min_by``/``max_by`` fold the Spark side uses, so the two sides share no logic.
DuckDB's ``arg_max`` skips NULL values, which is why ``row_number`` is used.
"""

from __future__ import annotations

LOG = """
ev AS (
  SELECT e.event_id AS seq, e.ts, e.user_id, e.event_type,
         CAST(regexp_extract(e.props, '[0-9]+') AS INTEGER) AS k,
         CAST(floor(CASE WHEN e.event_id % 3 = 0
                    THEN (CAST(e.event_id AS DOUBLE) * (SELECT count(*) FROM documents)
                          / (SELECT count(*) FROM events)) / 2
                    ELSE CAST(e.event_id AS DOUBLE) * (SELECT count(*) FROM documents)
                          / (SELECT count(*) FROM events) END) AS BIGINT) AS id
  FROM events e
),
log AS (
  SELECT ev.seq, ev.id, ev.user_id % 8 AS mailbox_id,
         't' || d.source AS thread_id,
         'u' || CAST(ev.user_id AS VARCHAR) || '@example.com' AS sender,
         CASE WHEN ev.k % 9 = 0 THEN NULL
              ELSE 'box' || CAST(ev.user_id % 8 AS VARCHAR) || '@example.com' END AS recipient,
         substr(d.text, 1, 60) AS subject,
         substr(d.text, 1, 200) AS snippet,
         CASE WHEN ev.k % 11 = 0 THEN NULL ELSE d.text END AS body,
         CASE WHEN ev.k % 13 = 0 THEN NULL ELSE CAST(CAST(ev.ts AS DATE) AS VARCHAR) END AS date,
         ev.k % 3 = 0 AS unread,
         CASE WHEN ev.event_type IN ('view', 'signup') THEN 'human' ELSE 'automated' END AS email_type,
         CASE WHEN ev.event_type IN ('view', 'signup') THEN NULL
              WHEN ev.event_type = 'error' THEN 'alerts'
              WHEN ev.event_type = 'purchase' THEN 'shopping'
              WHEN ev.event_type = 'click' THEN 'marketing' END AS domain,
         CASE WHEN ev.k % 17 = 0 THEN 'bad['
              ELSE '["' || d.source || '","' || d.lang || '"]' END AS entities,
         CASE WHEN ev.k % 19 = 0 THEN '' ELSE 'doc ' || CAST(ev.id AS VARCHAR) END AS summary,
         ev.k % 2 = 0 AS requires_reply,
         CASE WHEN ev.k % 5 = 0 THEN 'by day ' || CAST(ev.k AS VARCHAR)
              WHEN ev.k % 7 = 0 THEN '' END AS deadline,
         ev.ts AS processed_at,
         CASE WHEN ev.k % 3 = 1 THEN 'done' ELSE 'pending' END AS follow_up_status,
         CASE WHEN ev.k % 3 = 1 THEN 'done' ELSE 'open' END AS deadline_status,
         ev.k
  FROM ev JOIN documents d ON d.doc_id = ev.id
),
firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM log) WHERE rn = 1
),
lasts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1
),
emails AS (
  SELECT f.id, f.mailbox_id, f.thread_id, f.sender, f.subject, f.snippet, f.body, f.date,
         l.email_type, l.domain, l.summary, l.requires_reply, l.deadline, l.entities,
         f.processed_at
  FROM firsts f JOIN lasts l ON f.id = l.id
),
contacts AS (
  SELECT sender AS email_address, count(*) AS total_emails,
         max(CASE WHEN rn = 1 THEN date END) AS last_contact
  FROM (SELECT sender, date,
               row_number() OVER (PARTITION BY sender ORDER BY seq DESC) AS rn FROM log)
  GROUP BY sender
),
follow_ups AS (
  SELECT seq AS id, id AS email_id, follow_up_status AS status,
         CAST(NULL AS VARCHAR) AS notes, processed_at AS created_at
  FROM firsts WHERE requires_reply
),
deadlines AS (
  SELECT seq AS id, id AS email_id, deadline AS description, deadline_status AS status,
         processed_at AS created_at
  FROM firsts WHERE deadline IS NOT NULL AND deadline <> ''
),
as_of AS (SELECT max(ts) AS now FROM events),
messages AS (
  SELECT f.id, f.mailbox_id, f.thread_id, f.sender, f.recipient, f.subject, f.snippet, f.body,
         f.date, f.processed_at, l.unread, f.k
  FROM firsts f JOIN lasts l ON f.id = l.id
),
emails_dangling AS (SELECT * FROM emails WHERE id % 10 <> 3),
stored_before AS (
  SELECT DISTINCT id FROM log WHERE processed_at < (SELECT now FROM as_of) - INTERVAL 3 DAY
),
fetched AS (
  SELECT * FROM messages
  WHERE processed_at >= CAST(CAST((SELECT now FROM as_of) AS DATE) - INTERVAL 7 DAY AS TIMESTAMP)
),
lab_ev AS (
  SELECT id AS email_id, seq, mailbox_id, processed_at, 'AI/Human' AS label
  FROM log WHERE email_type = 'human'
  UNION ALL
  SELECT id, seq, mailbox_id, processed_at, 'AI/Human/FollowUp'
  FROM log WHERE email_type = 'human' AND requires_reply
  UNION ALL
  SELECT id, seq, mailbox_id, processed_at,
         CASE domain WHEN 'finance' THEN 'AI/Automated/Finance'
                     WHEN 'shopping' THEN 'AI/Automated/Shopping'
                     WHEN 'travel' THEN 'AI/Automated/Travel'
                     WHEN 'health' THEN 'AI/Automated/Health'
                     WHEN 'government' THEN 'AI/Automated/Government'
                     WHEN 'work' THEN 'AI/Automated/Work'
                     WHEN 'education' THEN 'AI/Automated/Education'
                     WHEN 'newsletter' THEN 'AI/Automated/Newsletter'
                     WHEN 'marketing' THEN 'AI/Automated/Marketing'
                     WHEN 'social' THEN 'AI/Automated/Social'
                     WHEN 'alerts' THEN 'AI/Automated/Alerts'
                     ELSE 'AI/Automated/Other' END
  FROM log WHERE email_type <> 'human'
),
vindex AS (
  SELECT id,
         concat_ws(chr(10) || chr(10), subject, coalesce(nullif(body, ''), nullif(snippet, '')),
                   nullif(summary, '')) AS document,
         sender, subject, thread_id, coalesce(date, '') AS date, email_type,
         coalesce(domain, '') AS domain, requires_reply, summary
  FROM lasts
),
results AS (
  SELECT l.doc_id, l.quality, l.toxic, CAST(l.doc_id AS VARCHAR) AS custom_id,
         CASE WHEN l.quality = 1 THEN 'succeeded' ELSE 'errored' END AS result_type,
         e.id AS eid, e.email_type,
         CASE WHEN l.doc_id % 10 = 7 THEN 'unknown' ELSE nullif(e.domain, '') END AS domain,
         CASE WHEN json_valid(e.entities) THEN from_json(e.entities, '["VARCHAR"]')
              ELSE CAST([] AS VARCHAR[]) END AS entities,
         CASE WHEN l.doc_id % 10 = 8 THEN '' ELSE coalesce(e.summary, '') END AS summary,
         coalesce(e.requires_reply, false) AS requires_reply,
         nullif(e.deadline, '') AS deadline
  FROM labels l LEFT JOIN emails e ON e.id = l.doc_id
),
parsed AS (
  SELECT *, coalesce(email_type IN ('human', 'automated')
             AND (domain IS NULL OR domain IN ('finance', 'shopping', 'travel', 'health',
                  'government', 'work', 'education', 'newsletter', 'marketing', 'social',
                  'alerts', 'other')), false) AS valid
  FROM results
),
applied AS (
  SELECT p.*, CASE WHEN p.quality <> 1 THEN 'not_succeeded'
                   WHEN d.id IS NULL THEN 'unknown_id'
                   WHEN p.toxic = 1 THEN 'no_tool_call'
                   WHEN NOT p.valid THEN 'invalid_analysis' END AS reason
  FROM parsed p LEFT JOIN emails_dangling d ON d.id = p.doc_id
)
"""



def with_log(body: str, extra: str = "") -> str:
    ctes = LOG.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return "WITH " + ctes + "\n" + body.strip()


SQL: dict[str, str] = {}


def register(name: str, body: str, extra: str = "") -> None:
    SQL[name] = with_log(body, extra)


def alias(name: str, other: str) -> None:
    SQL[name] = SQL[other]


def embed_ctes(name: str, source: str, id_expr: str, text_expr: str) -> str:
    """Hashed bag-of-words cells of ``source`` as CTEs ``{name}_cells`` / ``{name}_vec``."""
    chunk = "CAST(('0x' || substr(md5(w), {0}, 8)) AS BIGINT)"
    c = [chunk.format(1 + 8 * i) for i in range(4)]
    return f"""
{name}_tok AS (
  SELECT {id_expr} AS id, unnest(regexp_split_to_array(lower({text_expr}), '\\s+')) AS w
  FROM {source}
),
{name}_cells AS (
  SELECT id, CAST((256 * (({c[0]} + {c[1]} + {c[2]}) % 384) + {c[3]}) % 384 AS INTEGER) AS idx,
         count(*) AS cnt
  FROM {name}_tok WHERE w <> '' GROUP BY 1, 2
),
{name}_vec AS (
  SELECT c.id, c.idx, c.cnt, c.cnt / sqrt(n.ss) AS weight
  FROM {name}_cells c JOIN (SELECT id, sum(cnt * cnt) AS ss FROM {name}_cells GROUP BY id) n
    ON c.id = n.id
)"""


QUERY0 = "(SELECT 0 AS id, text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"


def one_query_topn(corpus_vec: str, n: int = 10) -> str:
    return f"""
scored AS (
  SELECT d.id, 1.0 - sum(d.weight * coalesce(q.weight, 0)) AS distance
  FROM {corpus_vec} d LEFT JOIN q_vec q ON d.idx = q.idx GROUP BY d.id
),
hits AS (
  SELECT id, round(distance, 6) AS distance,
         row_number() OVER (ORDER BY round(distance, 9), id) AS rank
  FROM scored QUALIFY rank <= {n}
)"""


def batch_topn(corpus_vec: str, n: int = 10) -> str:
    return f"""
pairs AS (
  SELECT q.id AS qid, d.id, 1.0 - sum(d.weight * q.weight) AS distance
  FROM {corpus_vec} d JOIN b_vec q ON d.idx = q.idx GROUP BY q.id, d.id
),
bhits AS (
  SELECT qid, id, round(distance, 6) AS distance,
         row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank
  FROM pairs QUALIFY rank <= {n}
)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def html_native(x: str) -> str:
    y = x
    for pat in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>",
                r"(?s)<!--.*?-->", r"<[^>]*>"):
        y = f"regexp_replace({y}, '{pat}', ' ', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        y = f"replace({y}, '{ent}', '{ch}')"
    y = f"trim(regexp_replace({y}, '\\s+', ' ', 'g'))"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN NOT contains({x}, '<') THEN {x} "
            f"WHEN length({y}) > length({x}) * 0.1 THEN {y} ELSE {x} END")


MSG_COLS = "id, mailbox_id, thread_id, sender, recipient, subject, snippet, body, date, processed_at"
EMAIL_COLS = ("id, mailbox_id, thread_id, sender, subject, snippet, body, date, email_type, "
              "domain, summary, requires_reply, deadline, entities, processed_at")
ENTITIES = ("CASE WHEN json_valid(entities) THEN from_json(entities, '[\"VARCHAR\"]') "
            "ELSE CAST([] AS VARCHAR[]) END")
NOW = "(SELECT now FROM as_of)"
TODAY = "CAST(CAST((SELECT now FROM as_of) AS DATE) AS VARCHAR)"
NL = "chr(10)"

# ---- state -----------------------------------------------------------------
register("emails_state", "SELECT * FROM emails")
register("contacts_state", "SELECT * FROM contacts")
alias("contact_stats", "contacts_state")
register("follow_ups_state", "SELECT * FROM follow_ups")
register("deadlines_state", "SELECT * FROM deadlines")

# ---- sources ---------------------------------------------------------------
register("scan_unread_ids", """
SELECT mailbox_id, id FROM messages WHERE unread
QUALIFY row_number() OVER (PARTITION BY mailbox_id ORDER BY processed_at DESC, id) <= 500""")
register("scan_unread_content", f"""
SELECT {MSG_COLS} FROM messages WHERE id IN (
  SELECT id FROM messages WHERE unread
  QUALIFY row_number() OVER (PARTITION BY mailbox_id ORDER BY processed_at DESC, id) <= 50)""")
alias("capped_fetch", "scan_unread_content")
register("scan_since_days", f"""
SELECT {MSG_COLS} FROM fetched
QUALIFY row_number() OVER (PARTITION BY mailbox_id ORDER BY processed_at DESC, id) <= 500""")
register("email_lookup", f"SELECT {MSG_COLS} FROM messages WHERE id = 42")
register("full_table_scan", "SELECT * FROM emails ORDER BY processed_at, id")
register("batch_results_source", """
SELECT CAST(doc_id AS VARCHAR) AS custom_id,
       CASE WHEN quality = 1 THEN 'succeeded' ELSE 'errored' END AS result_type,
       CAST(CASE WHEN quality = 1 THEN 2 END AS BIGINT) AS n_blocks
FROM labels""")

# ---- parsing ---------------------------------------------------------------
register("parse_text_messages", f"""
SELECT mailbox_id, CAST(floor(id / 64) AS BIGINT) AS page, CAST(id AS VARCHAR) AS id,
       '' AS thread_id, sender, recipient,
       CASE WHEN k % 4 = 0 THEN '(no subject)'
            ELSE coalesce(nullif({strip("regexp_replace(subject, '[\\r\\n]+', ' ', 'g')")}, ''),
                          '(no subject)') END AS subject,
       substr({strip("coalesce(body, '')")}, 1, 200) AS snippet,
       nullif({strip("coalesce(body, '')")}, '') AS body,
       CAST([] AS VARCHAR[]) AS labels,
       date,
       'https://mail.example.com/m/' || CAST(id AS VARCHAR) AS web_link
FROM messages""")
register("parse_json_messages", """
SELECT mailbox_id, CAST(id AS VARCHAR) AS id, thread_id, sender, nullif(recipient, '') AS recipient,
       CASE WHEN k % 4 = 2 THEN '(no subject)' ELSE subject END AS subject,
       coalesce(snippet, '') AS snippet,
       CASE WHEN k % 4 IN (1, 3) THEN NULL ELSE nullif(body, '') END AS body,
       CASE WHEN unread THEN ['INBOX', 'UNREAD'] ELSE ['INBOX'] END AS labels,
       nullif(date, '') AS date, CAST(NULL AS VARCHAR) AS web_link
FROM messages""")
register("parse_search_ids", """
SELECT mailbox_id, page,
       row_number() OVER (PARTITION BY mailbox_id, page ORDER BY id) - 1 AS position,
       CAST(id AS VARCHAR) AS id
FROM (SELECT mailbox_id, CAST(floor(id / 64) AS BIGINT) AS page, id, k FROM messages)
WHERE page % 2 = 0 OR k % 7 <> 0""")
TAXONOMY = ("['AI', 'AI/Human', 'AI/Automated', 'AI/Human/FollowUp', 'AI/Automated/Finance', "
            "'AI/Automated/Shopping', 'AI/Automated/Travel', 'AI/Automated/Health', "
            "'AI/Automated/Government', 'AI/Automated/Work', 'AI/Automated/Education', "
            "'AI/Automated/Newsletter', 'AI/Automated/Marketing', 'AI/Automated/Social', "
            "'AI/Automated/Alerts', 'AI/Automated/Other']")
CATALOG = f"""
SELECT mailbox_id, label,
       'Label_' || CAST(mailbox_id AS VARCHAR) || '_' ||
       CAST(coalesce(list_position({TAXONOMY}, label), 0) AS VARCHAR) AS label_id
FROM (SELECT DISTINCT mailbox_id, label FROM lab_ev {{where}})"""
register("parse_label_list", CATALOG.format(where=""))
register("detect_payload_kind", """
SELECT DISTINCT mailbox_id, CAST(floor(id / 64) AS BIGINT) AS page,
       CASE WHEN CAST(floor(id / 64) AS BIGINT) % 2 = 0 THEN 'text' ELSE 'json' END AS kind
FROM messages""")
register("strip_recipient", "SELECT id, recipient FROM messages")
register("html_to_text", f"SELECT page_id, {html_native('html')} AS text FROM pages")

# ---- projections -------------------------------------------------------------
PLAIN = html_native("coalesce(nullif(body, ''), nullif(snippet, ''), '')")
PROMPT = f"""
'Analyse the following email and call record_email_analysis with your findings.' || {NL} || {NL} ||
concat_ws({NL}, 'From: ' || sender, 'Subject: ' || subject,
          CASE WHEN nullif(recipient, '') IS NOT NULL THEN 'To: ' || recipient END,
          CASE WHEN nullif(date, '') IS NOT NULL THEN 'Date: ' || date END,
          '', substr(plain, 1, 4000),
          CASE WHEN length(plain) > 4000 THEN {NL} || '[… email truncated …]' END)"""
register("build_prompt", f"""
SELECT id, {PROMPT} AS prompt FROM (SELECT *, {PLAIN} AS plain FROM messages)""")
register("batch_request_fields", f"""
SELECT id, CAST(id AS VARCHAR) AS custom_id, 'analysis-model' AS model, 1024 AS max_tokens,
       'record_email_analysis' AS tool, 'record_email_analysis' AS tool_choice, 'user' AS role,
       {PROMPT} AS content FROM (SELECT *, {PLAIN} AS plain FROM messages)""")
register("parse_analysis", """
SELECT custom_id, email_type, domain, entities, summary, requires_reply, deadline, valid
FROM parsed WHERE quality = 1 AND toxic = 0""")
register("valid_analysis", "SELECT custom_id, valid FROM parsed WHERE quality = 1 AND toxic = 0")
register("select_tool_block", """
SELECT custom_id, result_type,
       CASE WHEN quality = 1 AND toxic = 0 THEN 'record_email_analysis' END AS block_name
FROM results""")
DOC = (f"concat_ws({NL} || {NL}, subject, coalesce(nullif(body, ''), nullif(snippet, '')), "
       "nullif(summary, ''))")
register("build_document", f"SELECT id, {DOC} AS document FROM emails")
register("build_metadata", """
SELECT id, sender, subject, thread_id, coalesce(date, '') AS date, email_type,
       coalesce(domain, '') AS domain, requires_reply, summary FROM emails""")
LABELS_OF = """
SELECT id AS email_id, mailbox_id, 'AI/Human' AS label FROM {src} WHERE email_type = 'human'
UNION ALL
SELECT id, mailbox_id, 'AI/Human/FollowUp' FROM {src} WHERE email_type = 'human' AND requires_reply
UNION ALL
SELECT id, mailbox_id,
       CASE domain WHEN 'finance' THEN 'AI/Automated/Finance'
                   WHEN 'shopping' THEN 'AI/Automated/Shopping'
                   WHEN 'travel' THEN 'AI/Automated/Travel'
                   WHEN 'health' THEN 'AI/Automated/Health'
                   WHEN 'government' THEN 'AI/Automated/Government'
                   WHEN 'work' THEN 'AI/Automated/Work'
                   WHEN 'education' THEN 'AI/Automated/Education'
                   WHEN 'newsletter' THEN 'AI/Automated/Newsletter'
                   WHEN 'marketing' THEN 'AI/Automated/Marketing'
                   WHEN 'social' THEN 'AI/Automated/Social'
                   WHEN 'alerts' THEN 'AI/Automated/Alerts'
                   ELSE 'AI/Automated/Other' END
FROM {src} WHERE email_type <> 'human'"""
register("assign_labels", LABELS_OF.format(src="emails"))
register("email_record", f"""
SELECT id, mailbox_id, thread_id, sender, subject, snippet, body, date, email_type, domain,
       summary, requires_reply, deadline, {ENTITIES} AS entities, processed_at FROM emails""")
register("reindex_projection", f"""
SELECT id, thread_id, sender, subject, snippet, body, date, email_type, domain,
       {ENTITIES} AS entities, summary, requires_reply, deadline FROM emails""")

MAIL_SEARCH = (embed_ctes("vi", "vindex", "id", "document") + "," +
               embed_ctes("q", QUERY0, "id", "text") + "," + one_query_topn("vi_vec"))
register("search_display", """
SELECT h.rank, v.subject, v.sender, substr(v.date, 1, 10) AS date, v.email_type, v.domain,
       round(greatest(0.0, 1.0 - h.distance), 2) AS score
FROM hits h JOIN vindex v ON v.id = h.id""", MAIL_SEARCH)

# ---- filters -----------------------------------------------------------------
NEEDS_REPLY = """
SELECT * FROM emails
WHERE email_type = 'human' AND requires_reply
  AND processed_at >= (SELECT now FROM as_of) - INTERVAL {h} HOUR
ORDER BY processed_at DESC, id"""
register("needs_reply", NEEDS_REPLY.format(h=24))
register("needs_reply_240h", NEEDS_REPLY.format(h=240))
alias("order_newest", "needs_reply_240h")
alias("needs_reply_snapshot", "needs_reply")
register("stored_ids_since", f"""
SELECT DISTINCT id FROM emails WHERE processed_at >= {NOW} - INTERVAL 7 DAY""")
alias("distinct_ids", "stored_ids_since")
register("follow_ups_by_status", "SELECT * FROM follow_ups WHERE status = 'pending'")
register("open_deadlines_raw", "SELECT * FROM deadlines WHERE status = 'open' ORDER BY created_at, id")
alias("order_oldest", "open_deadlines_raw")
register("email_by_id", f"""
SELECT id, mailbox_id, thread_id, sender, subject, snippet, body, date, email_type, domain,
       summary, requires_reply, deadline, {ENTITIES} AS entities, processed_at
FROM emails WHERE id = 42""")
register("contact_by_address", "SELECT * FROM contacts WHERE email_address = 'u7@example.com'")
register("metadata_where", """
SELECT id, sender, subject FROM vindex WHERE email_type = 'human' AND requires_reply""")

# ---- joins -------------------------------------------------------------------
register("new_emails_antijoin", f"""
SELECT {MSG_COLS} FROM fetched WHERE id NOT IN (SELECT id FROM stored_before)""")
register("poll_antijoin", f"""
SELECT {MSG_COLS} FROM messages WHERE id IN (
  SELECT id FROM (
    SELECT id FROM messages WHERE unread
    QUALIFY row_number() OVER (PARTITION BY mailbox_id ORDER BY processed_at DESC, id) <= 50)
  WHERE id NOT IN (SELECT id FROM stored_before))""")
register("batch_result_join", """
SELECT custom_id, result_type,
       CASE WHEN reason IS NULL THEN 'processed' ELSE 'failed' END AS outcome, reason
FROM applied""")
register("topic_emails", f"""
SELECT h.rank, h.distance, e.* FROM hits h JOIN emails_dangling e ON e.id = h.id""", MAIL_SEARCH)
alias("emails_for_topic", "topic_emails")
register("pending_followups", """
SELECT f.*, e.id AS mail_id, e.subject AS mail_subject, e.sender AS mail_sender,
       CASE WHEN e.id IS NULL THEN NULL WHEN json_valid(e.entities)
            THEN from_json(e.entities, '["VARCHAR"]') ELSE CAST([] AS VARCHAR[]) END AS mail_entities,
       e.processed_at AS mail_processed_at
FROM (SELECT * FROM follow_ups WHERE status = 'pending') f
LEFT JOIN emails_dangling e ON e.id = f.email_id""")
register("open_deadlines", """
SELECT d.*, e.id AS mail_id, e.subject AS mail_subject, e.sender AS mail_sender,
       CASE WHEN e.id IS NULL THEN NULL WHEN json_valid(e.entities)
            THEN from_json(e.entities, '["VARCHAR"]') ELSE CAST([] AS VARCHAR[]) END AS mail_entities,
       e.processed_at AS mail_processed_at
FROM (SELECT * FROM deadlines WHERE status = 'open') d
LEFT JOIN emails_dangling e ON e.id = d.email_id""")
CURRENT = """
SELECT email_id, mailbox_id, label FROM lab_ev
QUALIFY row_number() OVER (PARTITION BY email_id, label ORDER BY seq DESC) = 1"""
register("label_events", CURRENT)
register("missing_labels", f"""
SELECT m.mailbox_id, t.label, CAST(len(string_split(t.label, '/')) - 1 AS INTEGER) AS level,
       CAST(t.ordinal AS INTEGER) AS ordinal
FROM (SELECT DISTINCT mailbox_id FROM emails) m,
     (SELECT unnest({TAXONOMY}) AS label, unnest(range(16)) AS ordinal) t
WHERE NOT EXISTS (SELECT 1 FROM ({CURRENT}) c WHERE c.mailbox_id = m.mailbox_id AND c.label = t.label)
ORDER BY 1, 3, 4""")
register("resolve_label_ids", f"""
SELECT w.mailbox_id, w.label, c.label_id, c.label_id IS NULL AS needs_create
FROM (SELECT DISTINCT mailbox_id, label FROM lab_ev WHERE processed_at >= {NOW} - INTERVAL 3 DAY) w
LEFT JOIN ({CATALOG.format(where=f"WHERE processed_at < {NOW} - INTERVAL 3 DAY")}) c
  ON c.mailbox_id = w.mailbox_id AND c.label = w.label""")

# ---- aggregations ------------------------------------------------------------
register("email_count", "SELECT count(*) AS email_count FROM emails")
register("vector_count", "SELECT count(*) AS vector_count FROM vindex")
register("status_counts", f"""
SELECT (SELECT count(*) FROM emails) AS total_emails,
       (SELECT count(*) FROM vindex) AS vector_count,
       (SELECT count(*) FROM emails WHERE email_type = 'human' AND requires_reply
          AND processed_at >= {NOW} - INTERVAL 24 HOUR) AS needing_reply,
       (SELECT count(*) FROM follow_ups WHERE status = 'pending') AS pending_followups,
       (SELECT count(*) FROM deadlines WHERE status = 'open') AS open_deadlines""")
alias("status", "status_counts")
register("batch_outcomes", """
SELECT count(*) FILTER (WHERE result_type = 'succeeded') AS succeeded,
       count(*) FILTER (WHERE result_type = 'errored') AS errored,
       count(*) FILTER (WHERE result_type IS NULL
                        OR result_type NOT IN ('succeeded', 'errored')) AS other,
       count(*) FILTER (WHERE reason IS NULL) AS processed,
       count(*) FILTER (WHERE reason IS NOT NULL) AS failed
FROM applied""")
alias("backfill_apply_counts", "batch_outcomes")

ITEMS = f"""
items AS (
  SELECT mailbox_id, 1 AS section, -epoch_us(processed_at) AS k1, id AS k2, id AS email_id,
         subject, sender, summary, CAST(NULL AS VARCHAR) AS description,
         CAST(NULL AS VARCHAR) AS created_day
  FROM emails WHERE email_type = 'human' AND requires_reply
    AND processed_at >= {NOW} - INTERVAL 24 HOUR
  UNION ALL
  SELECT e.mailbox_id, 2, f.id, 0, f.email_id, e.subject, e.sender, NULL, NULL,
         substr(CAST(f.created_at AS VARCHAR), 1, 10)
  FROM follow_ups f LEFT JOIN emails e ON e.id = f.email_id WHERE f.status = 'pending'
  UNION ALL
  SELECT e.mailbox_id, 3, epoch_us(d.created_at), d.id, d.email_id, e.subject, e.sender, NULL,
         d.description, NULL
  FROM deadlines d LEFT JOIN emails e ON e.id = d.email_id WHERE d.status = 'open'
),
mailboxes AS (SELECT DISTINCT mailbox_id FROM emails),
counts AS (
  SELECT m.mailbox_id, s.section, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM mailboxes m CROSS JOIN (SELECT unnest([1, 2, 3]) AS section) s
  LEFT JOIN (SELECT mailbox_id, section, count(*) AS n FROM items GROUP BY 1, 2) c
    ON c.mailbox_id = m.mailbox_id AND c.section = s.section
)"""
register("briefing_sections", "SELECT * FROM counts", ITEMS)
LINE_COLS = "mailbox_id, section, part, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, line"
PROMPT_LINES = f"""
SELECT {LINE_COLS} FROM (
  SELECT mailbox_id, 0 AS section, 0 AS part, 0 AS k1, 0 AS k2,
         'Today is ' || {TODAY} || '. Generate a concise morning email briefing.' || {NL} AS line
  FROM mailboxes
  UNION ALL
  SELECT mailbox_id, section, 0, 0, 0,
         CASE section WHEN 1 THEN 'HUMAN EMAILS NEEDING REPLY (last 24h):'
                      WHEN 2 THEN {NL} || 'PENDING FOLLOW-UPS:'
                      ELSE {NL} || 'OPEN DEADLINES:' END
  FROM counts
  UNION ALL
  SELECT mailbox_id, section, 1, 0, 0, '  None' FROM counts WHERE n = 0
  UNION ALL
  SELECT mailbox_id, section, 1, k1, k2,
         CASE section
           WHEN 1 THEN '  - ' || subject || ' (from ' || sender || '): ' || summary
           WHEN 2 THEN '  - ' || coalesce(subject, '(unknown)') || ' (from ' || coalesce(sender, '?')
                       || ', waiting since ' || created_day || ')'
           ELSE '  - ' || description || ' (email: ' || coalesce(subject, '(unknown)') || ')' END
  FROM items
  UNION ALL
  SELECT mailbox_id, 4, 0, 0, 0,
         {NL} || 'Format the briefing with clear labelled sections. Be specific — reference '
         || 'actual names, dates, and action items from the data above. End with a '
         || '"Recommended focus" of 1–3 items for today.'
  FROM mailboxes)"""
register("briefing_prompt", PROMPT_LINES, ITEMS)
FALLBACK_LINES = f"""
SELECT {LINE_COLS} FROM (
  SELECT mailbox_id, 0 AS section, 0 AS part, 0 AS k1, 0 AS k2,
         '# Morning Briefing — ' || {TODAY} || {NL} AS line
  FROM mailboxes
  UNION ALL
  SELECT mailbox_id, 0, 1, 0, 0, '*(model unavailable — raw data)*' || {NL} FROM mailboxes
  UNION ALL
  SELECT mailbox_id, section, 0, 0, 0,
         {NL} || CASE section WHEN 1 THEN '## Human emails needing reply ('
                              WHEN 2 THEN '## Pending follow-ups ('
                              ELSE '## Open deadlines (' END || CAST(n AS VARCHAR) || ')'
  FROM counts
  UNION ALL
  SELECT mailbox_id, section, 1, k1, k2,
         CASE section WHEN 1 THEN '- ' || subject || ' — ' || sender
                      WHEN 2 THEN '- ' || coalesce(subject, CAST(email_id AS VARCHAR))
                      ELSE '- ' || description END
  FROM items)"""
register("briefing_text", FALLBACK_LINES, ITEMS)
alias("daily_briefing_job", "briefing_text")
register("briefing_file", f"""
SELECT mailbox_id, -1 AS section, 0 AS part, CAST(0 AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2,
       '---' || {NL} || 'date: ' || {TODAY} || {NL} || 'generated_at: '
       || replace(substr(CAST({NOW} AS VARCHAR), 1, 19), ' ', 'T') || '+00:00' || {NL} || '---' || {NL} AS line
FROM mailboxes
UNION ALL
{FALLBACK_LINES}""", ITEMS)

register("briefing_items", "SELECT * FROM items", ITEMS)
# a line that holds line ends is several lines of the file
register("briefing_written", f"""
SELECT mailbox_id, unnest(string_split(line, {NL})) AS line FROM (
SELECT mailbox_id, '---' || {NL} || 'date: ' || {TODAY} || {NL} || 'generated_at: '
       || replace(substr(CAST({NOW} AS VARCHAR), 1, 19), ' ', 'T') || '+00:00' || {NL} || '---' || {NL} AS line
FROM mailboxes
UNION ALL
SELECT mailbox_id, line FROM ({FALLBACK_LINES}))""", ITEMS)
register("rule_analysis", """
SELECT id, CASE WHEN auto THEN 'automated' ELSE 'human' END AS email_type,
       CASE WHEN auto THEN CASE WHEN regexp_matches(t, 'invoice|receipt|payment|bank') THEN 'finance'
                                WHEN regexp_matches(t, 'order|shipped|delivery') THEN 'shopping'
                                WHEN regexp_matches(t, 'flight|hotel|booking') THEN 'travel'
                                WHEN regexp_matches(t, 'unsubscribe|newsletter') THEN 'newsletter' ELSE 'other' END END AS domain,
       CAST([] AS VARCHAR[]) AS entities, coalesce(subject, '') AS summary, NOT auto AND contains(t, '?') AS requires_reply,
       nullif(regexp_extract(t, 'by (monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|end of day)'), '')
         AS deadline
FROM (SELECT *, regexp_matches(sender, '(?i)(no-?reply|notifications?|mailer)') AS auto,
             lower(concat_ws(' ', subject, body, snippet)) AS t FROM messages)""")

TOPIC_BATCH = (embed_ctes("vi", "vindex", "id", "document") + "," +
               embed_ctes("b", "benchmark", "item_id", "text") + "," + batch_topn("vi_vec"))
register("topic_context", f"""
SELECT h.qid, count(*) AS n_emails,
       string_agg('From: ' || e.sender || {NL} || 'Date: ' || coalesce(e.date, 'unknown') || {NL}
                  || 'Subject: ' || e.subject || {NL} || {NL}
                  || coalesce(nullif(e.body, ''), e.snippet),
                  {NL} || {NL} || '---' || {NL} || {NL} ORDER BY h.rank) AS context
FROM bhits h JOIN emails_dangling e ON e.id = h.id GROUP BY h.qid""", TOPIC_BATCH)
register("hit_rank", "SELECT * FROM bhits", TOPIC_BATCH)
alias("batch_search_mail", "hit_rank")

# ---- windows -----------------------------------------------------------------
register("latest_analysis", """
SELECT id, email_type, domain, summary, requires_reply, deadline, entities FROM lasts""")
register("first_raw", """
SELECT id, mailbox_id, thread_id, sender, subject, snippet, body, date, processed_at FROM firsts""")
register("first_seen_rows", "SELECT id, seq, requires_reply, deadline, processed_at FROM firsts")
register("surrogate_ids", "SELECT id, email_id, row_number() OVER (ORDER BY id) AS ordinal FROM follow_ups")

# ---- set operations ----------------------------------------------------------
register("id_difference", "SELECT id FROM fetched EXCEPT ALL SELECT id FROM stored_before")
register("seen_union", """
SELECT id FROM stored_before UNION
SELECT id FROM (SELECT id FROM fetched EXCEPT ALL SELECT id FROM stored_before)""")

# ---- vectors -----------------------------------------------------------------
DOC_SEARCH = (embed_ctes("d", "documents", "doc_id", "text") + "," +
              embed_ctes("q", QUERY0, "id", "text") + "," + one_query_topn("d_vec"))
register("embed_udf_cells", "SELECT id, idx, round(weight, 6) AS weight FROM d_vec",
         embed_ctes("d", "documents", "doc_id", "text"))
register("hash_embed", "SELECT id, idx, cnt, round(weight, 6) AS weight FROM d_vec",
         embed_ctes("d", "documents", "doc_id", "text"))
register("cosine_topk", "SELECT * FROM hits", DOC_SEARCH)
alias("topk_search", "cosine_topk")
DENSE = """
qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings
       WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
dense AS (
  SELECT vec_id, label,
         list_dot_product(CAST(embedding AS DOUBLE[]), q) AS dot,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
           * sqrt(list_dot_product(q, q)) AS den
  FROM embeddings, qv {where}
),
dhits AS (
  SELECT vec_id, label,
         CASE WHEN den = 0 THEN 1.0 ELSE 1.0 - dot / den END AS distance FROM dense
)"""
DENSE_BODY = """
SELECT vec_id, label, round(distance, 6) AS distance,
       row_number() OVER (ORDER BY round(distance, 9), vec_id) AS rank
FROM dhits QUALIFY rank <= 10"""
register("cosine_topk_dense", DENSE_BODY, DENSE.format(where=""))
register("cosine_topk_filtered", DENSE_BODY, DENSE.format(where="WHERE label = 3"))
register("batch_search", "SELECT * FROM bhits",
         embed_ctes("d", "documents", "doc_id", "text") + "," +
         embed_ctes("b", "benchmark", "item_id", "text") + "," + batch_topn("d_vec"))
register("vector_upsert", "SELECT * FROM vindex")
register("reindex", f"""
SELECT id, {DOC} AS document, sender, subject, thread_id, coalesce(date, '') AS date, email_type,
       coalesce(domain, '') AS domain, requires_reply, summary FROM emails""")
register("search_tool", """
SELECT h.id AS email_id, h.distance, v.sender, v.subject, v.thread_id, v.date, v.email_type,
       v.domain, v.requires_reply, v.summary
FROM hits h JOIN vindex v ON v.id = h.id""", MAIL_SEARCH)
alias("search", "search_tool")
SCOPED = "(SELECT v.* FROM vindex v JOIN firsts f ON f.id = v.id WHERE f.mailbox_id = 3 AND v.email_type = 'human')"
register("search_filtered", """
SELECT h.id AS email_id, h.distance, h.rank, f.mailbox_id, v.sender, v.subject, v.thread_id, v.date, v.email_type,
       v.domain, v.requires_reply, v.summary
FROM hits h JOIN vindex v ON v.id = h.id JOIN firsts f ON f.id = h.id""",
         embed_ctes("d", SCOPED, "id", "document") + "," + embed_ctes("q", QUERY0, "id", "text") + ","
         + one_query_topn("d_vec"))
register("stored_vectors", "SELECT id, idx, round(weight, 6) AS weight FROM d_vec",
         embed_ctes("d", "vindex", "id", "document"))

# ---- sinks -------------------------------------------------------------------
register("fanout", """
SELECT 'labels' AS sink, count(*) AS n FROM lab_ev
UNION ALL SELECT 'vectors', count(*) FROM vindex
UNION ALL SELECT 'emails', count(*) FROM emails
UNION ALL SELECT 'contacts', count(*) FROM contacts
UNION ALL SELECT 'follow_ups', count(*) FROM follow_ups
UNION ALL SELECT 'deadlines', count(*) FROM deadlines""")
register("analysis_failures", """
SELECT custom_id, result_type, reason, CAST(NULL AS VARCHAR) AS bad_line FROM applied WHERE reason IS NOT NULL""")
register("batch_results_rejects", """
SELECT CAST(NULL AS VARCHAR) AS custom_id, CAST(NULL AS VARCHAR) AS result_type, 'malformed_result' AS reason,
       '{"custom_id":"' || CAST(doc_id AS VARCHAR) || '","result":{"ty' AS bad_line
FROM labels WHERE doc_id % 5 = 0""")
register("reindex_vectors", "SELECT id, idx, round(weight, 6) AS weight FROM d_vec",
         embed_ctes("d", f"(SELECT id, {DOC} AS document FROM emails)", "id", "document"))
register("fanout_retry", """
SELECT 'labels' AS sink, count(*) AS n, false AS written FROM lab_ev
UNION ALL SELECT 'contacts', count(*), true FROM contacts
UNION ALL SELECT 'follow_ups', count(*), false FROM follow_ups
UNION ALL SELECT 'deadlines', count(*), false FROM deadlines""")
register("briefing_schedule", f"""
SELECT DISTINCT mailbox_id, {TODAY} AS date,
       CASE mailbox_id % 4 WHEN 0 THEN '0730' WHEN 1 THEN '1200' WHEN 2 THEN '0730' ELSE '2359' END AS run
FROM firsts""")
for _general, _fixture in (("emails_state_log", "emails_state"), ("contacts_state_log", "contacts_state"),
                           ("follow_ups_state_log", "follow_ups_state"), ("deadlines_state_log", "deadlines_state"),
                           ("latest_analysis_log", "latest_analysis"), ("first_raw_log", "first_raw"),
                           ("first_seen_rows_log", "first_seen_rows")):
    alias(_general, _fixture)
register("backfill_state", f"""
SELECT f.id, f.mailbox_id, f.thread_id, f.sender, f.subject, f.snippet, f.body, f.date, l.email_type, l.domain,
       l.summary, l.requires_reply, l.deadline, l.entities, f.processed_at
FROM (SELECT * FROM before QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) f
JOIN (SELECT * FROM before QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) l ON l.id = f.id
UNION ALL
SELECT m.id, m.mailbox_id, m.thread_id, m.sender, m.subject, m.snippet, m.body, m.date, p.email_type, p.domain,
       p.summary, p.requires_reply, p.deadline, CAST(to_json(p.entities) AS VARCHAR), {NOW}
FROM fetched m JOIN parsed p ON p.doc_id = m.id
WHERE m.id NOT IN (SELECT id FROM stored_before) AND p.quality = 1 AND p.toxic <> 1 AND p.valid""",
         f"before AS (SELECT * FROM log WHERE processed_at < {NOW} - INTERVAL 3 DAY)")
register("backfill_prepare", f"""
SELECT id, {PROMPT} AS prompt
FROM (SELECT *, {PLAIN} AS plain FROM fetched WHERE id NOT IN (SELECT id FROM stored_before))""")
register("backfill_apply", """
SELECT custom_id, email_type, domain, summary, requires_reply, deadline
FROM applied WHERE reason IS NULL""")

# ---- streaming (compared after draining) -------------------------------------
register("stream_ingest", """
SELECT seq, id, mailbox_id, thread_id, sender, recipient, subject, snippet, body, date, unread,
       email_type, domain, entities, summary, requires_reply, deadline, processed_at,
       follow_up_status, deadline_status
FROM log""")
register("stream_dedup", "SELECT id, seq, sender, processed_at FROM firsts")
register("stream_seed", """
SELECT id, seq, processed_at FROM firsts WHERE id NOT IN (SELECT id FROM stored_before)""")
register("stream_failures", "SELECT id, seq, 'no body' AS reason FROM firsts WHERE body IS NULL")
register("stream_state", "SELECT * FROM emails")
register("stream_contacts", "SELECT * FROM contacts")
register("stream_follow_ups", "SELECT * FROM follow_ups")
register("stream_deadlines", "SELECT * FROM deadlines")

alias("topic_status_context", "topic_context")
alias("email", "email_by_id")
alias("contact", "contact_by_address")
register("thread_context", f"""
SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS block, count(*) AS n_turns,
       min(turn) AS first_turn,
       string_agg(role || ': ' || text, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY turn) AS context
FROM conversations GROUP BY conv_id, CAST(floor(turn / 64) AS BIGINT)""")
