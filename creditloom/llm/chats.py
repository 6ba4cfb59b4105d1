"""Training conversations from reply trees.

Messages form trees: a message names its parent in the same tree.  A branch is a path from a root to a leaf.
Paths are found by self-joins that double their reach: a table of every message's ancestor 2**k steps up, joined with
itself, gives the one 2**(k + 1) steps up and the score and length of the way, so a tree takes as many rounds as its depth has
binary digits.  Branches are ranked by the sum of their scores (null counts 0), longer ones first among equals, then by
the leaf's node; the messages of the chosen branches follow from the same tables by one join a round, and only
then is text fetched.

A branch is written as one conversation::

    <|turn|>role<|text|>text<|end|><|turn|>role<|text|>...

Control strings inside roles and texts get a backslash behind their first character and backslashes are doubled, so the
marks stand for themselves only and every text can be read back.  The loss mask is a list of spans, in code
points of the written form: the texts of the roles that are learnt.  A conversation is put together from sorted rows
in a stream and is one row; one that passes ``PART`` code points goes on in further rows, cut between turns, so a
tree with a great part of all messages needs no more memory than another.

A null text or role is empty.  A null node is nobody's parent.  A parent that isn't there, or is the message
itself, makes the message a root.  Of several messages with one node the first by role and text hash has the children, the others
end branches.  Null is a tree like any other.  Identical rows are messages of their own.  Messages of a circle
of parents, and those below one, have no root and no branch.  An empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from creditloom.llm.scratch import materialize

#: Code points after which a conversation goes on in another row.
PART = 4_000_000
ESCAPE = "\\"

# Control strings of public chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>")


@dataclass(frozen=True)
class Template:
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    #: Roles whose texts are learnt.
    learnt: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = field(default=CONTROL)

    @property
    def strings(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.control)

    def __post_init__(self):
        if any(len(c) < 2 or ESCAPE in c for c in self.strings):
            raise ValueError("a control string has two characters or more and no backslash")

    def escape(self, text: Column) -> Column:
        """``text`` with no control string left in it; null is empty."""
        out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for c in self.strings:
            out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
        return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def linked(messages: DataFrame, score: bool) -> DataFrame:
    """m_row, m_tree, m_node, up (the row of the parent, null for a root) and gain of every message."""
    s = F.coalesce(F.col("m_score").cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    order = F.struct("m_role", F.xxhash64("m_text"), "m_row")
    owners = messages.filter("m_node is not null").groupBy("m_tree", "m_node").agg(F.min(order).alias("o"))
    owners = owners.select("m_tree", F.col("m_node").alias("m_parent"), F.col("o.m_row").alias("up"))
    ids = messages.select("m_row", "m_tree", "m_node", "m_parent", s.alias("gain"))
    on = F.col("a.m_tree").eqNullSafe(F.col("b.m_tree")) & (F.col("a.m_parent") == F.col("b.m_parent"))
    up = F.when(F.col("b.up") != F.col("a.m_row"), F.col("b.up"))
    return ids.alias("a").join(owners.alias("b"), on, "left").select("a.m_row", "a.m_tree", "a.m_node", up.alias("up"), "a.gain")


def branches(links: DataFrame, keep: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """The chosen leaves (leaf, m_tree, branch, steps), and for each k the table of ancestors 2**k steps up."""
    links = materialize(links, "links")
    state = links.select("m_row", "up", "gain", F.lit(1).cast("long").alias("steps"))
    jumps: list[DataFrame] = []
    before = None
    while True:
        still = state.filter("up is not null")
        n = still.count()
        if n == 0 or n == before:
            break
        before = n
        jumps.append(still.select("m_row", "up"))
        a, b = still.alias("a"), state.alias("b")
        moved = a.join(b, F.col("a.up") == F.col("b.m_row")).select(
            "a.m_row", "b.up", (F.col("a.gain") + F.col("b.gain")).alias("gain"), (F.col("a.steps") + F.col("b.steps")).alias("steps")
        )
        state = materialize(moved.unionByName(state.filter("up is null")), "state")
    inner = links.select(F.col("up").alias("m_row")).filter("m_row is not null")
    leaves = state.filter("up is null").drop("up").join(inner, "m_row", "left_anti").join(links.select("m_row", "m_tree", "m_node"), "m_row")
    best = Window.partitionBy("m_tree").orderBy(F.desc("gain"), F.desc("steps"), F.asc("m_node"), F.asc("m_row"))
    ranked = leaves.withColumn("branch", F.row_number().over(best).cast("long"))
    if keep is not None:
        ranked = ranked.filter(F.col("branch") <= keep)
    return materialize(ranked.select(F.col("m_row").alias("leaf"), "m_tree", "branch", "steps", F.col("gain").alias("score")), "branches"), jumps


def paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """leaf, m_row and dist (steps above the leaf) of every message of the chosen branches."""
    reach = chosen.select("leaf", F.col("leaf").alias("m_row"), F.lit(0).cast("long").alias("dist"))
    for k, jump in enumerate(jumps):
        more = reach.join(jump, "m_row").select("leaf", F.col("up").alias("m_row"), (F.col("dist") + 2**k).alias("dist"))
        reach = materialize(reach.unionByName(more), "paths")
    return reach


def reply_paths(
    messages: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text", score: str | None = None, keep: int | None = 1
) -> DataFrame:
    """One row per turn of the ``keep`` best branches of each tree (all for None): tree, branch (from 1), score, turn
    (from 0), role and text."""
    named = {"m_tree": tree, "m_node": node, "m_parent": parent, "m_role": role, "m_text": text} | ({"m_score": score} if score else {})
    rows = messages.select(F.monotonically_increasing_id().alias("m_row"), *(F.col(c).alias(n) for n, c in named.items()))
    rows = materialize(rows, "messages")  # the rows' numbers hold from here on
    chosen, jumps = branches(linked(rows, score is not None), keep)
    turns = paths(chosen, jumps).join(chosen, "leaf").select("m_row", "m_tree", "branch", "score", (F.col("steps") - 1 - F.col("dist")).alias("turn"))
    texts = rows.select("m_row", "m_role", "m_text")
    return turns.join(texts, "m_row").select(F.col("m_tree").alias("tree"), "branch", "score", "turn", F.col("m_role").alias("role"), F.col("m_text").alias("text"))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def conversations(turns: DataFrame, template: Template = Template(), part: int = PART) -> DataFrame:
    """tree, branch, part (from 0), formatted and loss_spans of the turns that ``reply_paths`` gives."""
    head = F.concat(F.lit(template.turn), template.escape(F.col("role")), F.lit(template.text))
    body = template.escape(F.col("text"))
    pieces = turns.select(
        "tree",
        "branch",
        "turn",
        F.concat(head, body, F.lit(template.end)).alias("piece"),
        F.length(head).cast("long").alias("skip"),
        F.coalesce(F.col("role").isin(*template.learnt), F.lit(False)).alias("learnt"),
    )
    kind = turns.schema["tree"].dataType
    schema = T.StructType(
        [
            T.StructField("tree", kind),
            T.StructField("branch", T.LongType()),
            T.StructField("part", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_spans", T.ArrayType(SPAN)),
        ]
    )
    tail = len(template.end)

    def put_together(batches):
        key, number, held, length, spans = None, 0, [], 0, []
        for batch in batches:
            done = []
            values = (batch.column(n).to_pylist() for n in ("tree", "branch", "piece", "skip", "learnt"))
            for tree, branch, piece, skip, learnt in zip(*values):
                if held and (key != (tree, branch) or length >= part):
                    done.append((*key, number, "".join(held), spans))
                    number = number + 1 if key == (tree, branch) else 0
                    held, length, spans = [], 0, []
                key = (tree, branch)
                if learnt:
                    spans.append({"start": length + skip, "end": length + len(piece) - tail})
                held.append(piece)
                length += len(piece)
            if done:
                yield _batch(done, batch.schema.field("tree").type)
        if held:
            yield _batch([(*key, number, "".join(held), spans)], batch.schema.field("tree").type)

    keys = ["tree", "branch"]
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "turn").mapInArrow(put_together, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    tree, branch, part, formatted, spans = zip(*rows)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [pa.array(tree, kind), pa.array(branch, pa.int64()), pa.array(part, pa.int64()), pa.array(formatted, pa.string()), pa.array(spans, span)]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "branch", "part", "formatted", "loss_spans"])


def turns_of(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """Roles and texts of a written conversation."""
    out = []
    for piece in formatted.split(template.turn)[1:]:
        role, text = piece.removesuffix(template.end).split(template.text)
        out.append((unescape(role), unescape(text)))
    return out


_READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of conversations, read from their written form and loss spans; the parts of one are read in a stream."""
    kind = formatted.schema["tree"].dataType
    schema = T.StructType([T.StructField("tree", kind), T.StructField("branch", T.LongType()), *T._parse_datatype_string(_READ).fields])

    def read(batches):
        key, n, turns, chars, loss, size = None, 0, None, 0, None, 0
        for batch in batches:
            done = []
            values = (batch.column(c).to_pylist() for c in ("tree", "branch", "formatted", "loss_spans"))
            for tree, branch, text, spans in zip(*values):
                if key != (tree, branch):
                    if key is not None:
                        done.append((*key, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    key, n, turns, chars, loss, size = (tree, branch), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, said in turns_of(text, template):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans:
                    learnt = unescape(text[span["start"] : span["end"]])
                    chars += len(learnt)
                    loss.update(learnt.encode())
                size += len(text)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], arrow(batch))
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, n, turns.hexdigest(), chars, loss.hexdigest(), size)))], arrow(batch))

    def arrow(batch):
        types = {"tree": batch.schema.field("tree").type} | {n: pa.string() if n.endswith("sha256") else pa.int64() for n in schema.names[1:]}
        return pa.schema(list(types.items()))

    keys = ["tree", "branch"]
    rows = formatted.repartition(*keys).sortWithinPartitions(*keys, "part")
    return rows.mapInArrow(read, schema)


def in_a_row(conversation: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conversation`` as a tree without forks: node numbers its rows by turn (equal ones by role and text), parent is the one before."""
    order = Window.partitionBy(tree).orderBy(F.asc(turn), F.asc("role"), F.asc("text"))
    numbered = conversation.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.withColumn("parent", F.col("node") - 1)


def chats_query(table: DataFrame) -> DataFrame:
    spark = table.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    turns = reply_paths(in_a_row(rows), "conv_id", "node", "parent")
    out = read_back(conversations(turns))
    return out.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
