"""Quotation linking: conversations in reply order, without quotes. All native.

Lines that begin with ``>`` are quotes; the number of ``>`` is their level. Neighbouring lines of one
level make a passage. A passage and each of its lines are normalised (lower case, single blanks) and
hashed; so are every message's own lines, paragraphs and whole body. A passage belongs to the latest
earlier message of its conversation with an equal text. A message replies to what its least quote
level with a match leads to; of several, the longest text decides, then the later message. Replies
form trees, whose paths come from pointer doubling, and messages are sorted by path: each reply
stands after what it answers and before the next answer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace

_PREFIX = r"^(?:[ \t]{0,3}>)+"
#: A line that only announces a quote.
ATTRIBUTION = r"^\s*On .+ wrote:\s*$"
#: Turns of one window; a passage met in more turns than that is looked up in steps.
TURNS = 4096


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(text: Column) -> tuple[Column, Column, Column]:
    """Arrays for each line: level, content; and the body, which has no quotes nor lines that announce one."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    level = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 0), "[^>]", "")))
    content = F.transform(lines, lambda x: F.regexp_replace(x, _PREFIX + " ?", ""))
    own = F.filter(F.arrays_zip(level.alias("l"), content.alias("c"), F.concat(F.slice(level, 2, F.size(level)), F.array(F.lit(0))).alias("next")), lambda x: (x["l"] == 0) & ~((x["next"] > 0) & x["c"].rlike(ATTRIBUTION)))
    return level, content, F.regexp_replace(F.array_join(F.transform(own, lambda x: x["c"]), "\n"), r"^\s+|\s+$", "")


def _digits(turn: Column) -> Column:
    """Twenty digits that sort as 64-bit numbers do."""
    zero = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.lpad((turn.cast("decimal(20,0)") + zero).cast("decimal(20,0)").cast("string"), 20, "0")


def passages(level: Column, content: Column) -> Column:
    """Runs of one level: array of (level, text)."""
    n = F.size(level)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(level, i - 1) != F.get(level, i - 2)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n + 1))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda x: F.struct(F.get(level, x["a"] - 1).alias("level"), F.slice(content, x["a"], x["z"] - x["a"]).alias("lines")))
    return F.filter(runs, lambda r: r["level"] > 0)


def link_quotations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, body, reply_to, thread_turn, depth, order_key, n_passages, n_linked, sorted in reply order.

    Every row stays. A null text has an empty body. Rows with a null conv_id or turn neither link nor
    are linked to and come first. Rows of one conv_id and turn are one message with several texts.
    A message that quotes nothing known begins a thread. An order_key has 20 digits for each message on
    the way from its thread's start, so that its length grows with the depth of replies. Texts of any
    length and levels of any depth are parsed whole. Other columns have no effect. An empty table
    gives an empty table.
    """
    spark = messages.sparkSession
    work = Workspace(spark, "quotations")
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    level, content, body = parsed(F.col("text"))
    rows = work.save(rows.select("conv_id", "turn", "role", level.alias("level"), content.alias("content"), body.alias("body")).select("conv_id", "turn", "role", "body", passages(F.col("level"), F.col("content")).alias("passages")).withColumn("row", F.monotonically_increasing_id()), "messages")
    known = rows.where("conv_id is not null and turn is not null")
    # Quoted texts: each passage as a whole and line by line
    each = known.where(F.size("passages") > 0).select("conv_id", "turn", "row", F.posexplode("passages").alias("at", "p"))
    texts = F.array_distinct(F.concat(F.array(F.array_join("p.lines", " ")), F.col("p.lines")))
    quoted = each.select("conv_id", "turn", "row", "at", F.col("p.level").alias("level"), F.explode(texts).alias("t")).select("conv_id", "turn", "row", "at", "level", normalised(F.col("t")).alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    quoted = work.save(quoted, "quoted")
    asked = quoted.select("conv_id", "h").distinct()
    body_lines = F.split("body", "\n")
    paragraphs = F.transform(F.split("body", r"\n\s*\n"), lambda x: x)
    own = known.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array(F.col("body")), paragraphs, body_lines))).alias("t")).select("conv_id", "turn", normalised(F.col("t")).alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    own = own.join(asked, ["conv_id", "h"], "left_semi").select("conv_id", "h", "t", "turn").distinct()
    # The latest earlier message of each text: within a step of turns, else from the steps before
    step = F.floor(F.col("turn") / TURNS)
    both = quoted.select("conv_id", "h", "t", "turn", "row", "at", "level", F.lit(None).cast("long").alias("source")).unionByName(own.select("conv_id", "h", "t", "turn", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("level"), F.col("turn").alias("source"))).withColumn("step", step)
    key = ["conv_id", "h", "t"]
    near = F.max("source").over(Window.partitionBy(*key, "step").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    by_step = both.groupBy(*key, "step").agg(F.max("source").alias("source"))
    before = F.max("source").over(Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    steps = by_step.withColumn("before", before).drop("source")
    met = both.withColumn("near", near).where("row is not null").join(steps, [*key, "step"], "left")
    met = met.withColumn("source", F.coalesce("near", "before")).where("source is not null").groupBy("row", "conv_id", "turn", "at", "level").agg(F.max(F.struct(F.length("t").alias("n"), F.col("source"))).alias("m"))
    met = work.save(met, "met")
    per_row = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_linked"))
    edges = met.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "m.n", "m.source")).alias("x")).select("conv_id", "turn", F.col("x.source").alias("up"))
    paths = work.save(edges.withColumn("path", F.array("turn")), "paths-0")
    k, more = 0, not paths.isEmpty()
    while more:  # as often as the logarithm of the depth
        above = paths.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("upper"), F.col("path").alias("head"))
        k += 1
        joined = paths.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("upper", "up").alias("up"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"), F.col("upper").isNotNull().alias("moved"))
        joined = work.save(joined, f"paths-{k}")
        work.drop(f"paths-{k - 1}")
        more, paths = not joined.where("moved").isEmpty(), joined.drop("moved")
    parent = edges.select("conv_id", "turn", F.col("up").alias("reply_to"))
    full = paths.select("conv_id", "turn", F.concat(F.array("up"), "path").alias("path")).join(parent, ["conv_id", "turn"])
    out = rows.join(full, ["conv_id", "turn"], "left").join(per_row, "row", "left").withColumn("path", F.coalesce("path", F.array("turn")))
    order = F.array_join(F.transform("path", lambda t: _digits(t)), "/")
    out = out.select("conv_id", "turn", "role", "body", "reply_to", F.get("path", F.lit(0)).alias("thread_turn"), (F.size("path") - 1).alias("depth"), order.alias("order_key"), F.size("passages").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"))
    return out.orderBy("conv_id", "order_key", "role", "body")


def op2_quotations(spark, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row_, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
x AS (SELECT row_, conv_id, turn, role, i, regexp_extract(lines[i], '^([ \t]{0,3}>)+') AS pre, regexp_replace(lines[i], '^([ \t]{0,3}>)+ ?', '') AS content
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM m)),
y AS (SELECT *, length(regexp_replace(pre, '[^>]', '', 'g')) AS level FROM x),
z AS (SELECT *, lead(level, 1, 0) OVER w AS next_, level <> lag(level, 1, -1) OVER w AS new_ FROM y WINDOW w AS (PARTITION BY row_ ORDER BY i)),
g AS (SELECT *, sum(CAST(new_ AS INTEGER)) OVER (PARTITION BY row_ ORDER BY i) AS run FROM z),
b AS (SELECT row_, conv_id, turn, role, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (next_ > 0 AND regexp_matches(content, '^\s*On .+ wrote:\s*$'))), ''), '^\s+|\s+$', '', 'g') AS body,
             CAST(count(DISTINCT run) FILTER (level > 0) AS INTEGER) AS n_passages FROM g GROUP BY ALL),
p AS (SELECT row_, conv_id, turn, run, level, list(content ORDER BY i) AS lines FROM g WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
q AS (SELECT DISTINCT row_, conv_id, turn, run, level, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM (SELECT *, unnest(list_append(lines, array_to_string(lines, ' '))) AS t FROM p)),
o AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t
      FROM (SELECT conv_id, turn, unnest(list_concat([body], string_split_regex(body, '\n\s*\n'), string_split(body, chr(10)))) AS t FROM b)),
f AS (SELECT q.row_, q.conv_id, q.turn, run, level, length(q.t) AS n, max(o.turn) AS source FROM q JOIN o ON o.conv_id = q.conv_id AND o.t = q.t AND o.turn < q.turn WHERE q.t <> '' GROUP BY ALL),
h AS (SELECT row_, conv_id, turn, run, level, max({'n': n, 'source': source}) AS m FROM f GROUP BY ALL),
e AS (SELECT conv_id, turn, max({'l': -level, 'n': m.n, 's': m.source}).s AS up FROM h GROUP BY ALL),
r AS (SELECT conv_id, turn, up, [up, turn] AS path FROM e UNION ALL SELECT r.conv_id, r.turn, e.up, list_prepend(e.up, r.path) FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.up),
t AS (SELECT conv_id, turn, arg_max(path, len(path)) AS path FROM r GROUP BY ALL),
k AS (SELECT row_, CAST(count(*) AS INTEGER) AS n_linked FROM h GROUP BY 1)
SELECT b.conv_id, b.turn, b.role, b.body, e.up AS reply_to, coalesce(t.path, [b.turn])[1] AS thread_turn, CAST(len(coalesce(t.path, [b.turn])) - 1 AS INTEGER) AS depth,
       array_to_string(list_transform(coalesce(t.path, [b.turn]), lambda v: lpad(CAST(CAST(v AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0')), '/') AS order_key, b.n_passages, coalesce(k.n_linked, 0) AS n_linked
FROM b LEFT JOIN e USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn) LEFT JOIN k USING (row_)
"""
