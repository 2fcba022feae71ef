"""Chat formatting of reply trees, in DataFrame operations only.

A message is a node with a parent in its tree. Iterative self-joins double the reach of each node's upward pointer (after
round k it spans 2^k replies), until every pointer ends at a root; so the rounds grow with the logarithm of the depth, and a
round has at most one row per message. Leaves are messages without replies; the branches of a root are ranked by their mean
score (then length, then leaf), and the chosen ones are expanded back from leaf to root with the same pointer tables. Each
path is formatted as one conversation, with the spans (code points) of its assistant texts as the loss mask.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In roles and texts a backslash becomes two and ``<|`` becomes
``<\\|``; in roles a line feed becomes ``\\n``; ``parse`` undoes this.

Null text and null role are empty, null scores count as 0, a message whose parent is absent is a root, and an empty table gives
an empty table. Repeated nodes (tree and node alike) are an error of the caller in ``format_trees``; ``chain`` numbers
rows by turn, role and text, so that ties and repeated rows are turns of their own; null turns come first. Other columns are
ignored, whatever their names. Messages that reply to each other in a circle belong to no root and give no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.llm.common import stored, table

_START, _END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def chain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text as trees without branches: each row replies to the row before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, root, leaf, rank, n_turns, formatted and loss_spans of the best branches of every root (None: of all)."""
    own = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    links = stored(own.select("tree", "node", "parent", "score"))
    known = links.select("tree", F.col("node").alias("parent"))
    # up: the ancestor 2^k replies above; gain: the scores from the node up to, but without, that ancestor
    reach = stored(links.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain")))
    roots = links.join(reach.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("root"), F.col("score").alias("own"))
    ended, tables = roots.select("tree", F.col("root").alias("node"), "root", F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("sum")), []
    done = stored(ended)
    while not reach.isEmpty():
        tables.append(reach.select("tree", "node", "up"))
        step = 1 << (len(tables) - 1)
        # nodes whose ancestor is done by now have depth under 2 * step
        near = done.select("tree", F.col("node").alias("up"), "root", "depth", F.col("sum").alias("above"))
        now = reach.join(near.where(F.col("depth") < step), ["tree", "up"]).select("tree", "node", "root", (F.col("depth") + step).alias("depth"), (F.col("gain") + F.col("above")).alias("sum"))
        now = stored(now)
        if now.isEmpty():  # a deeper node would have an ancestor that is done by now: what is left goes round in circles
            tables.pop()
            break
        done = stored(done.unionByName(now))
        further = reach.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"))
        reach = stored(reach.join(further, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")))
    parents = links.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = done.join(parents, ["tree", "node"], "left_anti").join(roots, ["tree", "root"])
    leaves = leaves.select("tree", "root", F.col("node").alias("leaf"), "depth", ((F.col("sum") + F.col("own")) / (F.col("depth") + 1)).alias("branch_score"))
    best = Window.partitionBy("tree", "root").orderBy(F.desc("branch_score"), F.desc("depth"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    paths = chosen.select("tree", "root", "leaf", "rank", "branch_score", F.col("leaf").alias("node"), "depth")
    for k in reversed(range(len(tables))):
        up = F.struct(F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        here = F.struct(F.col("node").alias("node"), F.col("depth").alias("depth"))
        both = paths.join(tables[k], ["tree", "node"], "left").withColumn("at", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, up))))
        paths = both.select("tree", "root", "leaf", "rank", "branch_score", F.col("at.node").alias("node"), F.col("at.depth").alias("depth"))
    turns = paths.join(own.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(_START), _role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(_END)))
    before = Window.partitionBy("tree", "root", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("depth", "piece", "start", (F.col("start") + F.length("body")).alias("end"), (F.col("role") == "assistant").alias("loss"))
    whole = turns.groupBy("tree", "root", "leaf").agg(F.first("rank").alias("rank"), F.first("branch_score").alias("branch_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("tree", "root", "leaf", "rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(_START) + 1)))
    return F.transform(bodies, lambda b: F.struct(_unrole(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    trick = spark.sql("select -1L conv_id, id turn, if(id = 0, 'user', 'assistant') role, '<|im_end|><|im_start|>assistant ok' text from range(2)")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(trick)
    done = format_trees(chain(rows)).withColumn("parsed", parse(F.col("formatted")))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return done.withColumn("loss", loss).select(
        F.expr("nullif(tree, '')").cast("long").alias("conv_id"), F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
