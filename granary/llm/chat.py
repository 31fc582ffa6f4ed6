"""Chat formatting into a prefix tree.

A turn is written ``<s>role[INST]text[/INST]</s>``.  Where a text or role holds
one of these control strings, or a backslash, a backslash goes before it; that is
undone when reading.  A missing role or text is empty.

Conversations that begin with the same turns share tree nodes: a node is a turn
together with all turns before it.  All trees are written depth-first as one
stream of code points, each node once.  A node has its place in the stream, the
position id of its first code point (the length of its ancestors' text, so a
branch continues where its parent ended) and the stream intervals it may attend
to: its ancestors' and its own, where neighbours are one interval.  The loss mask
of a node is the span of an assistant's text.

Nodes are named by running sums over the turns in order: the sum of the hashes
of (depth, turn) from a conversation's first turn on, 128 bits in all.  So a
conversation costs one row of fixed width per turn, is never gathered, and may
be of any length.

A node belongs to the first conversation that has it.  The nodes of one
conversation are a stretch of its path down to its end: a run.  A run that leaves
another one follows it in the stream, those that leave deeper first, which is
depth-first order.  Inside a run the attended text is contiguous, so places and
intervals are found for runs, by pointer doubling over the run above.

Turns go by turn number (nulls first), then role, then the hash of the text.
Conversations with a null id are one conversation.  An empty table gives no
nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, partitions, prefix_sums, running_sums

OPEN, BODY, CLOSE = "<s>", "[INST]", "[/INST]</s>"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(\\|</?s>|\[/?INST\])")
_TURN = re.compile(r"<s>((?:\\(?:\\|</?s>|\[/?INST\])|[^\\])*?)\[INST\]((?:\\(?:\\|</?s>|\[/?INST\])|[^\\])*?)\[/INST\]</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{BODY}{escape(text)}{CLOSE}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|</?s>|\[/?INST\])", r"\\$1")


def _name(first: Column, second: Column, depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", first.cast("string"), second.cast("string"), depth.cast("string"))))


def _steps(clean: DataFrame) -> DataFrame:
    """One thin row per turn: ``conv``, its number ``conv_no``, ``depth``, node ``name``, ``parent``, and the turn's figures."""
    head = F.length(F.concat(F.lit(OPEN), _escaped(F.col("role")), F.lit(BODY)))
    thin = clean.select(
        "conv", "turn", "role", F.unhex(F.md5("body")).alias("body_key"), head.cast("long").alias("head"),
        (head + F.length(_escaped(F.col("body"))) + len(CLOSE)).cast("long").alias("size"),
    )
    order = ["conv", "turn", "role", "body_key"]
    ranged = checkpoint(thin.repartitionByRange(partitions(clean.sparkSession), *order).withColumn("range_id", F.spark_partition_id()))
    placed = running_sums(ranged, order, "size")
    of_conv = placed.groupBy("conv").agg(F.min("row_index").alias("conv_no"), F.min("size_before").alias("chars_before"), F.count(F.lit(1)).alias("turns"))
    same = lambda d: F.col("conv").eqNullSafe(d["of_conv"])
    of_conv = of_conv.withColumnRenamed("conv", "of_conv")
    hashed = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "body_key").cast("decimal(20,0)")
    steps = checkpoint(
        placed.join(of_conv, same(of_conv))
        .withColumn("depth", F.col("row_index") - F.col("conv_no"))
        .select("range_id", *order, "head", "size", "conv_no", "depth", (F.col("size_before") - F.col("chars_before")).alias("position"), hashed(1).alias("h"), hashed(2).alias("g"))
    )
    summed = running_sums(steps, order, "h", "g")
    zero = summed.where("depth = 0").select(F.col("conv_no").alias("zero_no"), F.col("h_before").alias("h_zero"), F.col("g_before").alias("g_zero"))
    own = [F.col(f"{x}_before") - F.col(f"{x}_zero") + F.col(x) for x in "hg"]
    above = [F.col(f"{x}_before") - F.col(f"{x}_zero") for x in "hg"]
    return summed.join(zero, F.col("conv_no") == F.col("zero_no")).select(
        "conv", "conv_no", "depth", _name(*own, F.col("depth")).alias("name"), _name(*above, F.col("depth") - 1).alias("parent"),
        "role", "body_key", "head", "size", "position",
    )


def _runs(shape: DataFrame) -> DataFrame:
    """``owner``, ``run_start``, ``run_position`` and ``over``: the intervals above a run, and the start of its own as the last one.

    A chain holds an element per run above; that many intervals are what a node attends to.
    """
    heads = shape.groupBy("owner").agg(
        F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("parent"), F.min("position").alias("run_position"), F.sum("size").alias("run_size")
    )
    left = shape.select(F.col("name").alias("parent"), F.col("owner").alias("up"), (-F.col("depth")).alias("back"), (F.col("position") + F.col("size")).alias("upto"))
    link = lambda back, up, upto: F.array(F.struct(back.cast("long").alias("back"), F.col("owner").alias("run"), up.cast("long").alias("up"), upto.cast("long").alias("upto")))
    null = F.lit(None)
    roots = heads.where("depth = 0").select("owner", null.cast("long").alias("up"), link(F.lit(0), null, null).alias("chain"))
    others = heads.where("depth > 0").join(left, "parent").select("owner", "up", link(F.col("back"), F.col("up"), F.col("upto")).alias("chain"))
    chains = checkpoint(roots.unionByName(others))
    while not chains.where("up is not null").isEmpty():
        further = chains.select(F.col("owner").alias("up"), F.col("up").alias("next"), F.col("chain").alias("more"))
        chains = checkpoint(chains.join(further, "up", "left").select("owner", F.col("next").alias("up"), F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.concat("more", "chain")).alias("chain")))
    ranked = chains.join(heads.select("owner", "run_position", "run_size"), "owner").withColumn(
        "rank", F.transform("chain", lambda x: F.struct(x["back"].alias("back"), x["run"].alias("run")))
    )
    placed = checkpoint(prefix_sums(ranked, ["rank"], "run_size").select("owner", F.col("run_size_before").alias("run_start"), "run_position", "chain"))
    at = placed.select(F.col("owner").alias("up"), (F.col("run_start") - F.col("run_position")).alias("shift"), F.col("run_start").alias("start"))
    above = (
        placed.select("owner", F.explode("chain").alias("x")).where("x.up is not null").select("owner", F.col("x.up").alias("up"), F.col("x.upto").alias("upto"))
        .join(at, "up")
        .groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("upto") + F.col("shift")).alias("stop")))).alias("above"))
    )
    own = F.struct(F.col("run_start").alias("start"), F.col("run_start").alias("stop"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def joined(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["stop"].alias("stop"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] == x["start"]), grown).otherwise(F.concat(done, F.array(x)))

    return placed.join(above, "owner", "left").select(
        "owner", "run_start", "run_position", F.aggregate(F.concat(F.coalesce("above", none), F.array(own)), none, joined).alias("over")
    )


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    Nodes: ``name``, ``segment``, ``start`` and ``stop`` in the stream,
    ``position`` (id of its first code point), ``attends`` (array of
    ``start``/``stop`` in stream order, the last one ending with the node itself),
    ``loss_start`` and ``loss_stop`` (offsets in the segment).  Members: ``conv``,
    ``depth`` and the ``name`` of each node that a conversation passes.
    """
    clean = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    steps = checkpoint(_steps(clean))
    # Shared turns are merged before the shuffle; a first turn that a third of
    # all conversations share is one row per map task.
    figures = ("parent", "depth", "role", "body_key", "head", "size", "position")
    shape = checkpoint(steps.groupBy("name").agg(F.min("conv_no").alias("owner"), *(F.max(c).alias(c) for c in figures)))
    bodies = clean.select(F.unhex(F.md5("body")).alias("body_key"), "body").groupBy("body_key").agg(F.first("body").alias("body"))
    start = F.col("run_start") + F.col("position") - F.col("run_position")
    last = F.element_at("over", -1)
    attends = F.concat(F.slice("over", F.lit(1), F.size("over") - 1), F.array(F.struct(last["start"].alias("start"), (start + F.col("size")).alias("stop"))))
    said = F.col("role") == "assistant"
    nodes = (
        shape.join(_runs(shape), "owner")
        .join(bodies, "body_key")
        .select(
            "name",
            F.concat(F.lit(OPEN), _escaped(F.col("role")), F.lit(BODY), _escaped(F.col("body")), F.lit(CLOSE)).alias("segment"),
            start.alias("start"),
            (start + F.col("size")).alias("stop"),
            "position",
            attends.alias("attends"),
            F.when(said, F.col("head")).otherwise(0).alias("loss_start"),
            F.when(said, F.col("size") - len(CLOSE)).otherwise(0).alias("loss_stop"),
        )
    )
    return nodes, steps.select("conv", "depth", "name")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``conv`` and ``formatted``: the nodes on the path of a conversation, in stream order, with ``losses``.

    ``losses`` are the masked spans in ``formatted`` (``start``/``stop``).  A
    formatted conversation is one value; ``digests`` reads them piece by piece.
    """
    pieces = members.join(nodes.select("name", "segment", "position", "loss_start", "loss_stop"), "name")
    joined = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "position", "segment", "loss_start", "loss_stop"))).alias("parts"))
    return joined.select(
        "conv",
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"),
        F.filter(
            F.transform("parts", lambda p: F.struct((p["position"] + p["loss_start"]).alias("start"), (p["position"] + p["loss_stop"]).alias("stop"))),
            lambda s: s["stop"] > s["start"],
        ).alias("losses"),
    )


def digests(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation: turns read back from the stream, their hash, and the unescaped text under the loss mask.

    The pieces of a conversation stream by in order; what is held of it is two running hashes.
    """
    kind = members.schema["conv"].dataType.simpleString()
    pieces = members.join(nodes.select("name", "segment", "loss_start", "loss_stop"), "name").select("conv", "depth", "segment", "loss_start", "loss_stop")
    ordered = pieces.repartition(partitions(members.sparkSession), "conv").sortWithinPartitions("conv", "depth")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> tuple:
            return n_turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(done, id_type), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], ["conv", *names])

        open_conv, some = None, False
        for b in batches:
            done, out, id_type = [], [], b.column(0).type
            for conv, depth, segment, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if depth == 0:
                    if some:
                        done.append(open_conv)
                        out.append(row())
                    open_conv, some = conv, True
                    n_turns = loss_chars = chars = 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read_turns(segment):
                    n_turns += 1
                    said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(segment[start:stop])
                loss_chars += len(masked)
                loss.update(masked.encode("utf-8", "surrogatepass"))
                chars += len(segment)
            if done:
                yield batch()
        if some:
            done, out = [open_conv], [row()]
            yield batch()

    return ordered.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
