"""Schemas, enumerations and the label taxonomy.

Everything under "fixed values" must equal what the original application
uses, so that labels, enum checks and tool requests line up with it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# fixed values
# ---------------------------------------------------------------------------

EMAIL_TYPES = ["human", "automated"]

DOMAINS = [
    "finance", "shopping", "travel", "health", "government", "work",
    "education", "newsletter", "marketing", "social", "alerts", "other",
]

HUMAN_LABEL = "AI/Human"
HUMAN_FOLLOWUP_LABEL = "AI/Human/FollowUp"

# Label taxonomy in creation order (a parent always precedes its children).
AI_LABELS = [
    "AI",
    "AI/Human",
    "AI/Automated",
    "AI/Human/FollowUp",
    "AI/Automated/Finance",
    "AI/Automated/Shopping",
    "AI/Automated/Travel",
    "AI/Automated/Health",
    "AI/Automated/Government",
    "AI/Automated/Work",
    "AI/Automated/Education",
    "AI/Automated/Newsletter",
    "AI/Automated/Marketing",
    "AI/Automated/Social",
    "AI/Automated/Alerts",
    "AI/Automated/Other",
]

# domain -> label applied to automated mail
DOMAIN_LABEL = {
    "finance": "AI/Automated/Finance",
    "shopping": "AI/Automated/Shopping",
    "travel": "AI/Automated/Travel",
    "health": "AI/Automated/Health",
    "government": "AI/Automated/Government",
    "work": "AI/Automated/Work",
    "education": "AI/Automated/Education",
    "newsletter": "AI/Automated/Newsletter",
    "marketing": "AI/Automated/Marketing",
    "social": "AI/Automated/Social",
    "alerts": "AI/Automated/Alerts",
    "other": "AI/Automated/Other",
}

ANALYSIS_TOOL_NAME = "record_email_analysis"
ANALYSIS_TOOL_DESCRIPTION = "Record structured analysis of an email."
BODY_CHAR_LIMIT = 4000
SNIPPET_CHARS = 200
TRUNCATION_MARKER = "\n[… email truncated …]"
PROMPT_HEADER = ("Analyse the following email and call record_email_analysis "
                 "with your findings.\n\n")
NO_SUBJECT = "(no subject)"
UNREAD_PAGE = 500        # id search page size
POLL_BATCH = 50          # mails fetched per poll
EMBED_DIM = 384          # hashed bag-of-words dimension

# ---------------------------------------------------------------------------
# record schemas
# ---------------------------------------------------------------------------


# JSON message as returned by the legacy content tool
MESSAGE_JSON = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("date", T.StringType()),
    T.StructField("web_link", T.StringType()),
])

# tool-call input produced by the analysis model
ANALYSIS_INPUT = T.StructType([
    T.StructField("email_type", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("requires_reply", T.BooleanType()),
    T.StructField("deadline", T.StringType()),
])

CONTENT_BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("input", ANALYSIS_INPUT),
])

# one line of a batch-inference result file
BATCH_RESULT = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StructType([
            T.StructField("stop_reason", T.StringType()),
            T.StructField("content", T.ArrayType(CONTENT_BLOCK)),
        ])),
    ])),
])

# The folded emails table, in the order the original table declares it
# (plus mailbox_id, the key that spreads the work over many mailboxes).
EMAIL_COLUMNS = [
    "id", "mailbox_id", "thread_id", "sender", "subject", "snippet", "body", "date",
    "email_type", "domain", "summary", "requires_reply", "deadline", "entities",
    "processed_at",
]
RAW_COLUMNS = ["mailbox_id", "thread_id", "sender", "subject", "snippet", "body", "date",
               "processed_at"]
ANALYSIS_COLUMNS = ["email_type", "domain", "summary", "requires_reply", "deadline",
                    "entities"]
