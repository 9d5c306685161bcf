"""URL filter: a broadcast trie over reversed host labels and path segments.

A rule ``(verdict, host, path)`` fits its host and all subdomains when the
url's path starts with the rule's path.  Of the fitting rules the longest wins:
the one with more host labels, then the longer path; of two entries for the
same place the later one holds.  Without a fitting rule the verdict is
``default``.

Host and path of a url: the host is what follows the first ``://`` up to ``/``,
``?``, ``#`` or the end, with A-Z lower-cased; the path runs from there up to
``?``, ``#`` or the end.  A null url, or one without ``://``, has both empty.
An empty table gives an empty result; repeated rows are judged each by itself.

The trie is broadcast only while its pickled size stays within
``max_broadcast_bytes``; a larger rule list is judged by an equi-join on host
suffixes (``judge_by_join``), which gives the same rows.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, UPPER, require_columns

MAX_BROADCAST_BYTES = 32 << 20
RESULT = "host string, path string, rule string, verdict string"


def build_trie(rules):
    """Nested dicts: host labels from the right, then at ``None`` the path segments.

    A node of the path part holds at ``""`` the entries that end inside its
    next segment: ``[(rest, rule, verdict)]``, longest rest first.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *segments, rest = path.split("/")
        for segment in segments:
            node = node.setdefault("/" + segment, {})
        entries = [e for e in node.get("", []) if e[0] != rest]
        node[""] = sorted([*entries, (rest, host + path, verdict)], key=lambda e: -len(e[0]))
    return root


def longest_rule(trie, host: str, path: str):
    """(rule, verdict) of the longest fitting rule, or None."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        found = _longest_path(node.get(None), segments) if None in node else None
        best = found or best          # a deeper host beats any shallower one
    return best


def _longest_path(node, segments):
    best = None
    for i, segment in enumerate(segments):
        for rest, rule, verdict in node.get("", ()):
            if segment.startswith(rest):
                best = (rule, verdict)
                break
        node = node.get("/" + segment)
        if node is None or i + 1 == len(segments):
            break
    return best


def split_url(url: str | None):
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def judge_urls(df: DataFrame, rules, url: str = "url", keep=("page_id",), default: str = "allow",
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` with host, path, rule and verdict of each row's url."""
    require_columns(df, url, *keep)
    rules = list(rules)
    trie = build_trie(rules)
    packed = pickle.dumps(trie)
    if len(packed) > max_broadcast_bytes:
        rows = [(v, h, p, i) for i, (v, h, p) in enumerate(rules)]
        table = df.sparkSession.createDataFrame(
            rows, "verdict string, rule_host string, rule_path string, position long")
        return judge_by_join(df, table, url, keep, default)
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(RESULT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        held = pickle.loads(shared.value)
        out = []
        for u in urls:
            host, path = split_url(u)
            rule, verdict = longest_rule(held, host, path) or (None, default)
            out.append((host, path, rule, verdict))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    return (df.select(*keep, judge(F.col(url)).alias("_judged"))
              .select(*keep, "_judged.host", "_judged.path", "_judged.rule", "_judged.verdict"))


def host_and_path(url: Column):
    mark = F.locate("://", url)
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_by_join(df: DataFrame, rules: DataFrame, url: str = "url", keep=("page_id",),
                  default: str = "allow") -> DataFrame:
    """The same verdicts for a rule table of any size (verdict, rule_host, rule_path, position).

    Distinct (host, path) pairs are judged once: each host suffix joins the
    rules of that host, the longest survivor is a grouped maximum, and the
    verdict joins back to the rows.
    """
    judged = df.select(F.struct(*keep).alias("_keep"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    judged = judged.select("_keep", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = judged.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = places.join(rules, "rule_host").where(F.startswith("path", F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.size(F.split("rule_host", r"\.")).alias("depth"), F.length("rule_path").alias("reach"),
        "position", F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    return (judged.join(best, ["host", "path"], "left")
                  .select("_keep.*", "host", "path", F.col("best.rule").alias("rule"),
                          F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
