"""URL filters: a trie over reversed host labels and path segments.

``judge`` adds ``host``, ``path``, ``rule`` and ``verdict`` to a table of URLs.
The trie is built once from the rule list and broadcast; every URL walks it
label by label (``org`` -> ``example`` -> ``www``) and, at each host node that
carries rules, segment by segment down the path.  The deepest host wins, within
it the longest path; the last segment of a rule may match the beginning of the
URL's segment.  Two rules for one host and path: ``allow`` wins.

The broadcast is limited to ``MAX_TRIE_RULES`` rules.  A longer list takes
``judge_by_join``: the same walk as equi-joins of each URL's host suffixes and
path prefixes with the rules, nothing broadcast by hand.

Null URLs and URLs without ``://`` have empty host and path and get the default
verdict; repeated rows are judged row by row; an empty table gives no rows;
other columns of the input are not carried, only the key column is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.session import materialize

MAX_TRIE_RULES = 200_000

Rule = tuple[str, str, str]          # (verdict, host, path)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Host (A-Z lower-cased) and path as columns, in native expressions."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    raw_host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw_host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.expr("substring(_rest, char_length(_raw) + 1)")
    return (df.withColumn("_rest", rest).withColumn("_raw", raw_host).withColumn("host", host)
            .withColumn("path", F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)).drop("_rest", "_raw"))


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts.  Host node: ``{"kids": {label: node}, "paths": node|None}``;
    path node: ``{"kids": {segment: node}, "ends": {beginning: (rule, verdict)}}``."""
    root: dict = {"kids": {}, "paths": None}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"kids": {}, "ends": {}}
        at = node["paths"]
        *whole, last = path.split("/")
        for segment in whole:
            at = at["kids"].setdefault(segment, {"kids": {}, "ends": {}})
        if verdict == "allow" or last not in at["ends"]:
            at["ends"][last] = (host + path, verdict)
    return root


def _path_match(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        ends = node["ends"]
        if ends:
            for n in range(len(segment), -1, -1):
                if segment[:n] in ends:
                    best = ends[segment[:n]]
                    break
        node = node["kids"].get(segment)
        if node is None:
            break
    return best


def walk(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match, or None."""
    node, found, segments = trie, None, path.split("/")
    for label in reversed(host.split(".")):
        node = node["kids"].get(label)
        if node is None:
            break
        if node["paths"] is not None:
            found = _path_match(node["paths"], segments) or found
    return found


def judge(df: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule (null if none), verdict."""
    if len(rules) > MAX_TRIE_RULES:
        return judge_by_join(df, df.sparkSession.createDataFrame(
            [tuple(r) for r in rules], "verdict string, host string, path string"), key, url, default)
    sent = df.sparkSession.sparkContext.broadcast(build_trie(rules))
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = sent.value
        for frame in frames:
            hits = [walk(trie, h, p) for h, p in zip(frame["host"], frame["path"], strict=True)]
            frame["rule"] = [h[0] if h else None for h in hits]
            frame["verdict"] = [h[1] if h else default for h in hits]
            yield frame

    return (split_url(df.select(key, url), url).select(key, "host", "path")
            .mapInPandas(run, f"{key} {kind}, host string, path string, rule string, verdict string"))


def judge_by_join(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                  default: str = "allow") -> DataFrame:
    """``judge`` for any number of rules: distinct (host, path) pairs meet the
    rules by equal host suffix and equal path prefix; the best match per pair
    comes from a partial aggregate and is joined back."""
    judged = split_url(df.select(key, url), url).select(key, "host", "path")
    pairs = materialize(judged.select("host", "path").distinct(), "url-pairs")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.select(F.length("path").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))
    reach = (pairs.withColumn("ns", lengths.scalar())      # the path lengths that rules have
             .withColumn("rhost", F.explode(suffixes))
             .withColumn("n", F.explode(F.filter("ns", lambda n: n <= F.length("path"))))
             .withColumn("rpath", F.expr("substring(path, 1, n)")))
    best = (reach.join(rules.select(F.col("host").alias("rhost"), F.col("path").alias("rpath"),
                                    F.col("verdict").alias("rverdict")), ["rhost", "rpath"])
            .groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), F.col("rverdict").alias("verdict")),
                          F.struct(F.length("rhost"), F.length("rpath"), (F.col("rverdict") == "allow"))).alias("m")))
    return (judged.join(best, ["host", "path"], "left")
            .select(key, "host", "path", F.col("m.rule").alias("rule"),
                    F.coalesce("m.verdict", F.lit(default)).alias("verdict")))
