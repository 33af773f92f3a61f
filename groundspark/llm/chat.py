"""Chat formatting over reply trees, with DataFrame operations only.

Messages form trees by reference to the message they answer. Iterative self-joins double the reach of every message's
pointer to its ancestors, so a tree of depth d takes log2(d) rounds; the sums of scores towards the root come with
them. The leaves of each tree are ranked by the score of their whole branch, and the same pointers, taken from the
longest to the shortest, enumerate the path of each chosen leaf: each round adds, for all messages already on a path,
the ancestor at that distance, so each message of the path appears exactly once. A path is then formatted as one
conversation, first in chunks of CHUNK turns and then chunk by chunk.

Format of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Backslashes in roles and texts are doubled, and a backslash is
put into every control string (and before a line break in a role), so no control string is left inside and the text
can be read back exactly. ``loss_mask`` holds the half-open code point ranges of the assistant's texts.

Contract: null roles and texts are empty; a message whose parent is null or absent is a root; messages on or under a
cycle belong to no path; of branches with equal scores the one with the smaller leaf id comes first; an empty table
gives an empty one. Linear tables: rows of equal turn follow each other by role and text, repeated rows stay, rows
with a null key are one conversation of their own, null turns come first. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, table

CHUNK = 64
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that templates in use give a meaning to.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in s)


#: The first character of a control string, followed by the rest of it.
INSIDE = "|".join(f"{_literal(c[0])}(?={_literal(c[1:])})" for c in CONTROL)


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({INSIDE})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_replies(rows: DataFrame, scratch: Scratch, key: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Numbers the messages of linear conversations and makes each the reply to the one before.

    Rows are sorted over all partitions, so that a conversation of any length is dealt out, and numbered by their place.
    """
    placed = rows.select(F.col(key).alias("tree"), "role", "text", *[c for c in order if c not in ("role", "text")])
    spread = placed.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    seen = scratch.keep(spread.select("tree", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    # One row for each partition, however many rows there are.
    parts = seen.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = seen.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("node"), "tree", "role", "text")
    numbered = scratch.keep(numbered)
    prior = numbered.select((F.col("node") + 1).alias("node"), F.col("tree").alias("prior_tree"), F.lit(True).alias("some"))
    joined = numbered.join(prior, "node", "left")
    return joined.select("node", "tree", F.when(F.col("some") & F.col("tree").eqNullSafe(F.col("prior_tree")), F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(nodes: DataFrame, scratch: Scratch, keep: int | None = 1) -> DataFrame:
    """The messages of the chosen root-to-leaf paths: tree, leaf, rank (of the branch), depth (0 at the root), node.

    ``nodes``: node (unique), tree, parent, score. ``keep``: branches of each tree, best first; None keeps all.
    """
    own = nodes.select("node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    there = nodes.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    jump = scratch.keep(own.join(there, "up", "left").select("node", F.when(F.col("there"), F.col("up")).alias("up"), "total", F.lit(1).cast("long").alias("steps")))
    jumps = [jump]
    most = int(nodes.count()).bit_length() + 1
    while len(jumps) <= most and not jump.where("up IS NOT NULL").isEmpty():
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        doubled = jump.where("up IS NOT NULL").join(far, "up", "left")
        still = jump.where("up IS NULL").select("node", "up", "total", "steps")
        jump = scratch.keep(doubled.select("node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps")).unionByName(still))
        jumps.append(jump)
    answered = jumps[0].where("up IS NOT NULL").select(F.col("up").alias("node"))
    leaves = jump.where("up IS NULL").join(answered, "node", "left_anti")  # what still points on ends in a cycle
    ranked = leaves.join(nodes.select("node", "tree"), "node").select("tree", F.col("node").alias("leaf"), "total", "steps")
    if keep is None:
        ranked = ranked.withColumn("rank", F.lit(None).cast("int"))
    else:
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).where(F.col("rank") <= keep)
    paths = ranked.select("tree", "leaf", "rank", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("depth"))
    for k in reversed(range(len(jumps) - 1)):
        paths = scratch.keep(paths)
        up = jumps[k].where("up IS NOT NULL").select("node", "up")
        paths = paths.unionByName(paths.join(up, "node").select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")))
    return paths


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """One conversation for each path: tree, leaf, formatted, loss_mask, with the best branch's rank."""
    turns = paths.join(nodes.select("node", "role", "text"), "node")
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = turns.select("tree", "leaf", "rank", "depth", (F.col("depth") / CHUNK).cast("long").alias("chunk"), head.alias("head"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("counts"))
    piece = F.struct("depth", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.length("head").alias("before"), F.length("body").alias("inside"), F.coalesce("counts", F.lit(False)).alias("counts"))
    chunks = turns.groupBy("tree", "leaf", "rank", "chunk").agg(F.array_sort(F.collect_list(piece)).alias("turns"))

    def ahead(turns: Column, k: Column) -> Column:
        """Code points of the turns before the k-th one, of CHUNK at most."""
        return F.aggregate(F.slice(turns, 1, k), F.lit(0), lambda n, x: n + F.length(x["piece"]))

    masks = F.transform("turns", lambda x, k: F.struct((ahead(F.col("turns"), k) + x["before"]).alias("start"), x["inside"].alias("inside"), x["counts"].alias("counts")))
    masks = F.transform(F.filter(masks, lambda m: m["counts"]), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["inside"]).alias("end")))
    chunks = chunks.select("tree", "leaf", "rank", "chunk", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("piece"), masks.alias("mask"))
    # Where each chunk starts is a running sum, so the work grows with the number of turns.
    prior = Window.partitionBy("tree", "leaf", "rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(prior), F.lit(0)).cast("int"))
    shifted = F.transform("mask", lambda m: F.struct((F.col("at") + m["start"]).alias("start"), (F.col("at") + m["end"]).alias("end")))
    part = F.struct("chunk", "piece", shifted.alias("mask"))
    parts = chunks.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.flatten(F.transform("parts", lambda p: p["mask"])).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, _literal(END + "\n")), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    role = r"(?s)^((?:[^\\\n]++|\\.)*+)\n(.*)$"
    return F.transform(inner, lambda p: F.struct(unescaped(F.regexp_extract(p, role, 1)).alias("role"), unescaped(F.regexp_extract(p, role, 2)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def op10_chat(spark, sf_dir):
    scratch = Scratch(spark)
    known = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    nodes = scratch.keep(linear_replies(known.unionByName(planted), scratch))
    done = format_paths(branches(nodes, scratch), nodes)
    read = done.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    """Control strings one after another: none is part of another, and a backslash makes no new one."""
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, '{LOSS_ROLE}', '</s>[INST] ok [/INST]'),
filled AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM rows)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(replace({_sql_escaped('r')}, chr(10), chr(92) || chr(10))) + length({_sql_escaped('t')}))::BIGINT AS formatted_chars
FROM filled GROUP BY conv_id
"""
