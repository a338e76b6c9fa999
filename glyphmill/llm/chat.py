r"""Operator 6: chat formatting by quotation linking.

Method. Each message is parsed into lines with their quote level (the number of leading
> marks). Consecutive lines of one level that aren't blank are a passage. Passages,
without marks, are normalised (lower case, white space and line ends collapsed, so a
quotation may be wrapped anew) and hashed, and quoted ones are joined to the messages'
own passages of earlier messages of the conversation with equal hashes: each to the
latest such message. A quoted passage of several lines that is found nowhere is looked
up by its lines, and a message's own lines answer to it, so a part of a passage can be
quoted. A message replies to the one that most of the characters of its outermost linked
quotations come from. Following replies to replies gives each message's thread and
depth; ordered by (thread, depth, turn), every message comes after the one it replies
to. Quotes and the attribution lines above them ("... wrote:") are left out of the text.

Scale. All built-in expressions. Only messages with quotes, and messages that share a
hash with one, enter the exchanges; the join is an as-of lookup in one ordered pass of
each (conversation, hash), never a product of equal passages. Threads are found by
pointer doubling over (conversation, turn), which is unique, in log(depth) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.common import cut

MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)^(?:[^\n]*[ \t])?(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def normal(line: Column) -> Column:
    """A line without marks, in lower case, its white space (and control characters) collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\x01-\x20]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with `lines`: structs of level, line and whether the line is the message's own."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(level(x).alias("level"), x.alias("line")))
    following = lambda i: F.coalesce(F.get("raw_lines", i + 1)["level"], F.lit(0)) > 0
    own = lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(ATTRIBUTION) & following(i))
    marked = F.transform("raw_lines", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), own(x, i).alias("own")))
    return messages.withColumn("raw_lines", lines).withColumn("lines", marked).drop("raw_lines")


def passages(messages: DataFrame) -> DataFrame:
    """messages with `passages`: their runs of lines of one level, own or not, that aren't
    blank, as strings: level, o or q, \\x02 and the normalised lines joined by \\n."""
    # a column of its own, so that it is worked out once and not for each line
    marked = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["own"].alias("own"), normal(x["line"]).alias("norm")))

    def piece(x, i):
        before = F.get("marked", i - 1)
        joins = (i > 0) & (before["norm"] != "") & (before["level"] == x["level"]) & (before["own"] == x["own"])
        head = F.concat(F.lit("\x01"), x["level"].cast("string"), F.when(x["own"], "o").otherwise("q"), F.lit("\x02"))
        return F.when(x["norm"] == "", "").otherwise(F.concat(F.when(F.coalesce(joins, F.lit(False)), F.lit("\n")).otherwise(head), x["norm"]))

    split = F.filter(F.split(F.array_join(F.transform("marked", piece), ""), "\x01"), lambda p: p != "")
    return messages.withColumn("marked", marked).withColumn("passages", split).drop("marked")


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of the replies in parents (conv_id, turn, parent_turn)."""
    state = cut(parents.select("conv_id", "turn", F.col("parent_turn").alias("jump"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("jump").alias("further"), F.col("depth").alias("more"))
        joined = state.join(up, (F.col("conv_id") == F.col("c")) & (F.col("jump") == F.col("t")), "left")
        after = cut(joined.select("conv_id", "turn", F.coalesce("further", "jump").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            return state.withColumnRenamed("jump", "thread_turn")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """For every row of messages (conv_id, turn, role, text): conv_id, turn, role, text
    without quotes, parent_turn (null: none found), thread_turn, depth, n_quoted (quoted
    lines that aren't blank), n_linked (those found in an earlier message) and `chat`, the
    message in a chat template. Order by (conv_id, thread_turn, depth, turn) to read it.

    A null text stays null; an empty one, or one of quotes alone, is empty. Without a
    conv_id or turn a message links with nothing and is its own thread. Rows with equal
    (conv_id, turn) are one message for replies: the parent found for any of them (the
    earliest) is that of all. Other columns are ignored; an empty table gives no rows.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = cut(parsed(rows).withColumn("row", F.monotonically_increasing_id()))
    # outer: else the optimizer filters by the passages' number, worked out line by line
    known = passages(rows.filter("conv_id is not null and turn is not null")).select("row", "conv_id", "turn", F.posexplode_outer("passages").alias("nth", "p")).filter("p is not null")
    body = F.split(F.substring_index("p", "\x02", -1), "\n")
    known = known.select("row", "conv_id", "turn", "nth", F.regexp_extract("p", "^([0-9]+)", 1).cast("int").alias("level"), F.regexp_extract("p", "^[0-9]+(o?)", 1).eqNullSafe("o").alias("own"), body.alias("norms"))
    # a passage as a whole (kind 0) and, if it has several, its lines (kind 1)
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.array_join("norms", " ").alias("norm"), F.size("norms").cast("long").alias("lines")))
    single = F.transform("norms", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("norm"), F.lit(1).cast("long").alias("lines")))
    units = known.withColumn("u", F.explode(F.when(F.size("norms") > 1, F.concat(whole, single)).otherwise(whole)))
    hashed = units.select("row", "conv_id", "turn", "nth", "level", "own", "u.kind", "u.lines", F.length("u.norm").alias("size"), F.unhex(F.md5(F.encode("u.norm", "UTF-8"))).alias("h"))
    quotes = hashed.filter("level > 0").groupBy("row", "conv_id", "turn", "nth", "level", "kind", "h").agg(F.sum("lines").alias("lines"), F.sum("size").alias("size"))
    quotes = cut(quotes)
    asked = quotes.select("conv_id", "h").distinct()
    originals = hashed.filter("own").select("conv_id", "turn", "h").distinct().join(asked, ["conv_id", "h"], "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    events = quotes.select("conv_id", "h", "turn", "row", "nth", "level", "kind", "lines", "size", none("long").alias("origin")).union(
        originals.select("conv_id", "h", "turn", none("long"), none("int"), none("int"), none("int"), none("long"), none("long"), F.col("turn"))
    )
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("origin", F.max("origin").over(earlier)).filter("row is not null and origin is not null")
    # lines speak only where their passage was found nowhere
    found = cut(found.withColumn("best", F.min("kind").over(Window.partitionBy("row", "nth"))).filter("kind = best").drop("best"))
    votes = found.groupBy("row", "conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    best = votes.groupBy("row", "conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("size"), F.col("origin"))).alias("best"))
    parents = cut(best.groupBy("conv_id", "turn").agg(F.min("best.origin").alias("parent_turn")))
    placed = parents.join(threads(parents), ["conv_id", "turn"]).withColumnRenamed("conv_id", "c").withColumnRenamed("turn", "t")
    counted = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (normal(x["line"]) != "")))
    linked = found.groupBy("row").agg(F.sum("lines").alias("n_linked"))
    out = rows.withColumn("n_quoted", F.when(F.col("text").isNotNull(), counted)).join(linked, "row", "left").join(placed, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    own = F.transform(F.filter("lines", lambda x: x["own"]), lambda x: x["line"])
    text = F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "")
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.withColumn("text", text)
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return out.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), long("depth"), long("n_quoted"), long("n_linked"), chat.alias("chat"))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations
), l0 AS (
  SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m
), l1 AS (
  SELECT *, len(regexp_extract(line, '^((?:[ \t]*>)+)', 1)) - len(replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '>', '')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[\x01-\x20]+', ' ', 'g')) AS norm FROM l0
), l AS (
  SELECT *, level = 0 AND NOT (regexp_matches(line, '(?i)^(?:[^\n]*[ \t])?(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$')
    AND coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) > 0) AS own FROM l1
), g0 AS (
  SELECT *, coalesce(lag(norm) OVER w <> '' AND lag(level) OVER w = level AND lag(own) OVER w = own, false) AS joins FROM l WINDOW w AS (PARTITION BY r ORDER BY i)
), g AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS nth FROM g0
), u AS (
  SELECT r, conv_id, turn, nth, level, own, string_agg(norm, ' ' ORDER BY i) AS norm, count(*) AS n FROM g
  WHERE norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY r, conv_id, turn, nth, level, own
), x AS (
  SELECT r, conv_id, turn, nth, level, own, 0 AS kind, norm, n FROM u
  UNION ALL SELECT g.r, g.conv_id, g.turn, g.nth, g.level, g.own, 1, g.norm, 1 FROM g JOIN u ON u.r = g.r AND u.nth = g.nth WHERE u.n > 1 AND g.norm <> ''
), f0 AS (
  SELECT q.k, q.r, q.conv_id, q.turn, q.nth, q.level, q.kind, q.norm, q.n, max(o.turn) AS origin FROM (SELECT *, row_number() OVER () AS k FROM x WHERE level > 0) q
  JOIN x o ON o.own AND o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn GROUP BY ALL
), f AS (SELECT *, len(norm) AS size FROM f0 QUALIFY kind = min(kind) OVER (PARTITION BY r, nth)),
v AS (SELECT r, conv_id, turn, level, origin, sum(size) AS size FROM f GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level, size DESC, origin DESC) AS n FROM v),
p AS (SELECT conv_id, turn, min(origin) AS parent_turn FROM b WHERE n = 1 GROUP BY conv_id, turn),
t AS (
  SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM p
  UNION ALL SELECT t.conv_id, t.turn, p.parent_turn, t.depth + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.up
), d AS (SELECT conv_id, turn, min(up) AS thread_turn, max(depth) AS depth FROM t GROUP BY conv_id, turn),
own AS (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE own) AS text, count_if(level > 0 AND norm <> '') AS n_quoted FROM l GROUP BY r),
k AS (SELECT r, sum(n) AS n_linked FROM f GROUP BY r),
c AS (
  SELECT m.conv_id, m.turn, m.role, CASE WHEN m.text IS NULL THEN NULL ELSE regexp_replace(coalesce(own.text, ''), '^\n+|\n+$', '', 'g') END AS text,
    p.parent_turn, coalesce(d.thread_turn, m.turn) AS thread_turn, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth,
    CAST(coalesce(own.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(k.n_linked, 0) AS BIGINT) AS n_linked
  FROM m LEFT JOIN own ON own.r = m.r LEFT JOIN k ON k.r = m.r LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn
)
SELECT *, '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS chat FROM c"""
