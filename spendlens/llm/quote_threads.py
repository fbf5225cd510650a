"""Quotation linking: reply-ordered conversations without quotes.

Messages quote earlier ones as mail does: a line's quote level is the number of
``>`` signs it begins with (spaces may stand between them).  Lines of one level
that follow each other form a passage.  A passage is normalised (lower case, one
space between words) and hashed with SHA-256; a message's own passage, its text
of level 0, is hashed alike, as a whole, paragraph by paragraph and line by line.
Runs of some of its lines are hashed where a quoted passage begins with the same
line, for every number of lines that such passages have (blank lines not counted).

Linking joins quoted passages to original messages of the same conversation by
hash.  The original is the earliest message that holds the passage as its own
words: its whole passage, one paragraph, or lines that follow each other; it must
come before the quoting one.  Wrapping matters only for part of a paragraph.  The passage of level 1 (of several,
the one from the latest original) names the message that is replied to.

A conversation is then a forest.  ``root_turn`` and ``depth`` come from pointer
jumping (a few joins, each written to the shared folder), and ``position`` counts
the messages of a conversation ordered by thread root and turn, so a reply always
follows what it answers; it is counted over range partitions, so one huge
conversation is no single task.  Bodies are the texts without quoted lines.

Rows without conv_id or turn are left out; repeated rows of one (conv_id, turn)
count once, with the least role and text; null and empty texts are messages with
an empty body that nothing links to; an empty table gives no rows; extra columns
are ignored.  Long messages cost time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.session import materialize

KEY = ["conv_id", "turn"]


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, no, level, body, hash): the passages of every message in order."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:>\s?)*)", 1), "[^>]", "")).alias("level"),
        F.regexp_replace(line, r"^(?:>\s?)*", "").alias("line")))
    # a new passage starts where the level changes; every line is looked at once
    at = lambda x, i: F.get(x, i)["level"]                                               # noqa: E731
    runs = _once(lines, lambda x: _once(
        F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (at(x, i) != at(x, i - 1))),
        lambda starts: F.transform(starts, lambda s, j: F.struct(
            at(x, s).alias("level"),
            F.array_join(F.slice(x, s + 1, F.coalesce(F.get(starts, j + 1), F.size(x)) - s)["line"], "\n").alias("body")))))
    flat = messages.select(*KEY, F.posexplode(runs).alias("no", "p")).select(*KEY, "no", "p.level", "p.body")
    return flat.withColumn("hash", F.sha2(normalise(F.col("body")), 256))


def _lines(body: Column) -> Column:
    """The normalised lines of a passage, without blank ones."""
    return F.filter(F.transform(F.split(body, "\n"), normalise), lambda x: x != "")


def _run_hashes(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, hash): runs of two or more own lines that begin as a quoted
    passage of their conversation does and have as many lines.  Only the distinct
    numbers of lines meet an own line, so one common line is no product of rows."""
    sha = lambda x: F.sha2(x, 256)                                                       # noqa: E731
    ks = (quoted.select("conv_id", _lines(F.col("body")).alias("lines")).where(F.size("lines") > 1)
          .select("conv_id", sha(F.col("lines")[0]).alias("first"), F.size("lines").alias("k"))
          .groupBy("conv_id", "first").agg(F.collect_set("k").alias("ks")))
    lines = own.select(*KEY, "no", _lines(F.col("body")).alias("lines")).where(F.size("lines") > 1)
    starts = lines.select(*KEY, "no", F.size("lines").alias("m"), F.posexplode(F.transform("lines", sha)).alias("i", "first"))
    found = (starts.join(ks, ["conv_id", "first"])
             .select(*KEY, "no", "i", F.filter("ks", lambda k: F.col("i") + k <= F.col("m")).alias("ks"))
             .where(F.size("ks") > 0).groupBy(*KEY, "no").agg(F.collect_list(F.struct("i", "ks")).alias("at")))
    run = lambda i, k: sha(F.array_join(F.slice("lines", i + 1, k), " "))                # noqa: E731
    runs = F.flatten(F.transform("at", lambda a: F.transform(a["ks"], lambda k: run(a["i"], k))))
    return lines.join(found, [*KEY, "no"]).select(*KEY, F.explode(F.array_distinct(runs)).alias("hash"))


def own_hashes(parts: DataFrame) -> DataFrame:
    """(conv_id, hash, turn): the earliest message that holds a passage as its own
    words, for whole own passages, their paragraphs, lines and quoted runs of lines;
    empty ones are no passages."""
    full = parts.where(normalise(F.col("body")) != "")
    own, quoted = full.where(F.col("level") == 0), full.where(F.col("level") > 0)
    pieces = F.filter(F.concat(F.array("body"), F.split("body", r"\n\s*\n"), F.split("body", "\n")), lambda p: normalise(p) != "")
    one = own.select(*KEY, F.explode(F.array_distinct(F.transform(pieces, lambda p: F.sha2(normalise(p), 256)))).alias("hash"))
    return one.unionByName(_run_hashes(own, quoted)).groupBy("conv_id", "hash").agg(F.min("turn").alias("turn"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, source_turn) for every distinct quoted passage;
    source_turn is null where no earlier message holds it."""
    parts = materialize(passages(messages), "quote-passages")
    quoted = parts.where((F.col("level") > 0) & (normalise(F.col("body")) != "")).select(*KEY, "level", "hash").distinct()
    source = materialize(own_hashes(parts).withColumnRenamed("turn", "source"), "quote-sources")
    return (quoted.join(source, ["conv_id", "hash"], "left")
            .select(*KEY, "level", "hash", F.when(F.col("source") < F.col("turn"), F.col("source")).alias("source_turn")))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) by pointer jumping; a message without
    parent is its own root.  A parent's turn is smaller, so this ends."""
    now = materialize(parents.select(*KEY, F.coalesce("parent_turn", "turn").alias("up"),
                                     F.col("parent_turn").isNotNull().cast("long").alias("steps")), "quote-up")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        new = materialize(now.join(above, ["conv_id", "up"])
                          .select(*KEY, F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"),
                                  (F.col("next") != F.col("up")).alias("moved")), "quote-up")
        if new.where("moved").isEmpty():
            return new.select(*KEY, F.col("up").alias("root_turn"), F.col("steps").alias("depth"))
        now = new.drop("moved")


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``position`` (from 0) within conv_id by (root_turn, turn): rows are
    numbered inside range partitions, conversations that span several partitions
    get the sum of what came before."""
    order = ["conv_id", "root_turn", "turn"]
    laid = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()),
                       "quote-order")
    held = laid.groupBy("conv_id", "_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = materialize(held.select("conv_id", "_part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
                       "quote-parts")
    return (laid.join(held, ["conv_id", "_part"])
            .withColumn("position", F.col("_id") - F.col("first") + F.col("before"))
            .drop("_part", "_id", "first", "before"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, root_turn, depth, n_quotes,
    n_linked and body of every message."""
    rows = materialize(messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
                       .groupBy(*KEY).agg(F.min(F.struct("role", "text")).alias("m"))
                       .select(*KEY, "m.role", "m.text"), "quote-messages")
    links = (link(rows).groupBy(*KEY)
             .agg(F.max(F.when(F.col("level") == 1, F.col("source_turn"))).alias("parent_turn"),
                  F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked")))
    joined = materialize(rows.join(links, KEY, "left"), "quote-links")
    # own lines only, in their order; blank lines left by quotes are trimmed
    body = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~x.startswith(">")), "\n")
    placed = _positions(joined.join(_roots(joined), KEY).withColumn("body", F.regexp_replace(body, r"^\s+|\s+$", "")))
    return placed.select("conv_id", "position", "turn", "role", "parent_turn", "root_turn", "depth",
                         F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
                         F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "body")


def with_quotes(table: DataFrame, partial: bool = False) -> DataFrame:
    """Stand-in input: the test table's messages written as mail.  A message quotes
    the whole text of an earlier one (turn - 1, or turn div 2 at every third
    turn), and below it, one level deeper, what that one had quoted.  ``partial``
    leaves out the first line of the text quoted at odd turns and the last line at
    even ones, where it has three or more."""
    rows = table.select("conv_id", "turn", "role", "text")
    of = lambda t: F.when(t % 3 == 2, F.floor(t / 2)).otherwise(t - 1)                   # noqa: E731
    told = rows.withColumn("a", of(F.col("turn"))).withColumn("b", of(F.col("a")))
    one = rows.select("conv_id", F.col("turn").alias("a"), F.col("text").alias("ta"))
    two = rows.select("conv_id", F.col("turn").alias("b"), F.col("text").alias("tb"))
    mark = lambda c, sign: F.concat(F.lit(sign), F.regexp_replace(c, "\n", "\n" + sign))
    lines = F.split("ta", "\n")
    some = F.when(F.size(lines) > 2, F.array_join(F.slice(lines, F.when(F.col("turn") % 2 == 0, 1).otherwise(2),
                                                          F.size(lines) - 1), "\n")).otherwise(F.col("ta"))
    return (told.join(one, ["conv_id", "a"], "left").join(two, ["conv_id", "b"], "left")
            .select("conv_id", "turn", "role",
                    F.concat_ws("\n", mark(F.col("tb"), ">> "), mark(some if partial else F.col("ta"), "> "),
                                F.col("text")).alias("text")))
