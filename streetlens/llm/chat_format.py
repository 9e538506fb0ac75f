"""Conversations as training text: a template is a black box, turns are located by comparing renderings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm.vectors import named
from streetlens.session import stage_table

#: Turns of one output row; longer conversations are several rows, dealt over the tasks.
PART_TURNS = 512

Turn = tuple[str, str]


@dataclass(frozen=True)
class Template:
    """A template as a black box: ``render`` gives the text of a list of (role, text).

    ``context`` is the number of turns before a turn that may shape its text (only asked for where a conversation
    does not fit into one part).
    """

    render: Callable[[Sequence[Turn]], str]
    context: int = 1


class InstTemplate:
    """Instruction format with markers, whose texts can be read back.

    A control string inside a text gets a backslash behind its first sign, and a backslash is doubled; so no text can
    close its turn or open another, and ``unescape`` takes every backslash off again.
    """

    #: Markers of the format.
    CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]")
    context = 0

    _CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
    _TURN = re.compile(
        r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>"
        r"|\[ROLE (?P<role>(?:\\.|[^\]\\])*)\](?P<other>.*?)\[/ROLE\]", re.S)

    def escape(self, text: str) -> str:
        return self._CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> str:
        text = self.escape(text)
        if role == "user":
            return f"<s>[INST] {text} [/INST]"
        if role == "assistant":
            return f" {text}</s>"
        if role == "system":
            return f"<<SYS>>\n{text}\n<</SYS>>"
        return f"[ROLE {self.escape(role).replace(']', chr(92) + ']')}]{text}[/ROLE]"

    def render(self, turns: Sequence[Turn]) -> str:
        return "".join(self.turn(role, text) for role, text in turns)

    def read(self, formatted: str) -> list[Turn]:
        """The turns of a formatted text; an error where something stands between them."""
        out, at = [], 0
        while at < len(formatted):
            match = self._TURN.match(formatted, at)
            if not match:
                raise ValueError(f"no turn at {at}")
            at = match.end()
            role = match.lastgroup if match.lastgroup != "other" else self.unescape(match["role"])
            out.append((role, self.unescape(match[match.lastgroup])))
        return out


@dataclass
class Formatted:
    """A rendered conversation: ends of the turns, places of the texts under the loss, first turn that changed others."""

    text: str
    ends: list[int]
    loss: list[tuple[int, int]]
    rewritten: int | None


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def format_turns(template, turns: Sequence[Turn], loss_roles: Sequence[str], before: Sequence[Turn] = ()) -> Formatted:
    """Render successive prefixes and compare each output with the one before.

    What an output adds is the span of its turn. A prefix whose output does not begin with the output before rewrites
    history: its turn is named in ``rewritten``, the earlier spans end where the two outputs part, and no text is put
    under the loss, as the model would learn texts that later turns change. The place of a text in its turn's span is
    found by rendering the turn with two other texts, "0" and "1": what these outputs share at both ends frames the
    text. A text that the template changed in part (its frame does not enclose all of the span) is still what stands
    between them.
    """
    done = list(before)
    last = template.render(done) if done else ""
    origin = start = len(last)
    ends: list[int] = []
    loss: list[tuple[int, int]] = []
    rewritten = None
    for number, (role, text) in enumerate(turns):
        now = template.render([*done, (role, text)])
        if not now.startswith(last):
            rewritten = number if rewritten is None else rewritten
            start = common_prefix(last, now)
            ends = [min(e, start) for e in ends]
            origin = min(origin, start)
        if role in loss_roles and rewritten is None:
            zero, one = (template.render([*done, (role, probe)]) for probe in "01")
            head = common_prefix(zero, one)
            tail = common_prefix(zero[head:][::-1], one[head:][::-1])
            if head >= start and now.startswith(zero[start:head], start) and now.endswith(zero[len(zero) - tail:]) and head + tail <= len(now):
                loss.append((head, len(now) - tail))
        done.append((role, text))
        ends.append(len(now))
        last, start = now, len(now)
    if rewritten is not None:
        loss = []
    return Formatted(last[origin:], [max(0, e - origin) for e in ends], [(a - origin, b - origin) for a, b in loss], rewritten)


def renderer(template, loss_roles: Sequence[str]):
    """Task: rows of (conv_id, part, position, before, role, text) in order to one row for each part.

    Rows of a part stand together; at most ``PART_TURNS`` and the context are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, turns = None, [], []
        out: list[dict] = []
        size = 0

        def close() -> int:
            made = format_turns(template, turns, loss_roles, before)
            out.append({
                "conv_id": key[0], "part": key[1], "n_turns": len(turns), "formatted": made.text, "turn_ends": made.ends,
                "loss": [{"start": a, "stop": b} for a, b in made.loss], "rewritten_turn": made.rewritten})
            return len(made.text)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"], row["part"]) != key:
                    if turns:
                        size += close()
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out.clear()
                        size = 0
                    key, before, turns = (row["conv_id"], row["part"]), [], []
                (before if row["before"] else turns).append((row["role"], row["text"]))
        if turns:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("turn_ends", pa.list_(pa.int64())), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("rewritten_turn", pa.int64())])
    return run


PARTS = (
    "conv_id bigint, part bigint, n_turns bigint, formatted string, turn_ends array<bigint>, "
    "loss array<struct<start: bigint, stop: bigint>>, rewritten_turn bigint")
_ORDER = ("turn", "role", "text_hash", "text")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their ``position`` in their conversation, counted without holding a conversation in one task.

    Rows are dealt by range of (conversation, turn, role, hash) and written with their place in the task; the number
    of rows that earlier tasks hold of the same conversation comes from one count for each task and conversation.
    """
    placed = rows.repartitionByRange("conv_id", "turn", "role", "text_hash").sortWithinPartitions("conv_id", *_ORDER)
    # the lower 33 bits of the id count the rows of a task
    number = F.monotonically_increasing_id()
    placed = stage_table(placed.select("*", F.shiftright(number, 33).alias("task"), number.bitwiseAND((1 << 33) - 1).alias("place")), "long-chats")
    counts = placed.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    earlier = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(earlier, F.lit(0)) - F.col("first")
    starts = counts.select(F.col("conv_id").alias("start_id"), F.col("task").alias("start_task"), shift.alias("shift"))
    same = F.col("conv_id").eqNullSafe(F.col("start_id")) & (F.col("task") == F.col("start_task"))
    return placed.join(starts, same).withColumn("position", F.col("place") + F.col("shift"))


def format_conversations(
    turns: DataFrame, template, loss_roles: Sequence[str] = ("assistant",), conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", part_turns: int = PART_TURNS,
) -> DataFrame:
    """Every conversation formatted, with the spans of its turns and the mask of the texts to learn.

    Result: ``conv_id``, ``part``, ``n_turns``, ``formatted``, ``turn_ends`` (end of each turn in ``formatted``, in code
    points), ``loss`` (start and stop of each text of ``loss_roles``), ``rewritten_turn`` (first turn, from 0, whose
    rendering changes what came before; null for a template that only adds; such a part has no loss), ``long``. A
    conversation is one row, or where it has more than ``part_turns`` turns (``long``) one row for each so many, whose
    texts in order of ``part`` are the conversation.

    Turns are ordered by turn, those of one turn number by role and a hash of the text; repeated rows are repeated
    turns. A null role or text is empty; a null turn number comes first; null conversation ids are one conversation.
    An empty table gives no row. Other columns are ignored.

    Ordinary conversations are exchanged once and rendered where they arrive. Long ones are numbered by ranges and dealt
    by part, each with the ``template.context`` turns before it, so no task holds a whole one.
    """
    rows = turns.select(
        named(conv_column).cast("bigint").alias("conv_id"), named(turn_column).cast("bigint").alias("turn"),
        F.coalesce(named(role_column), F.lit("")).alias("role"), F.coalesce(named(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = stage_table(sizes.filter(F.col("n") > part_turns).select(F.col("conv_id").alias("long_id")), "long-ids")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))

    fields = ("conv_id", "part", "before", "role", "text")
    run = renderer(template, tuple(loss_roles))
    short = rows.join(long, is_long, "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    short = short.select("*", F.lit(0).cast("bigint").alias("part"), F.lit(False).alias("before")).select(*fields).mapInArrow(run, PARTS)

    placed = numbered(rows.join(long, is_long, "left_semi"))
    part = F.floor(F.col("position") / part_turns).cast("bigint")
    ahead = (F.col("position") + template.context) / part_turns
    # a turn also stands before every part that begins within its reach
    copies = F.transform(F.sequence(part, F.floor(ahead).cast("bigint")), lambda p: F.struct(p.alias("part"), (p != part).alias("before")))
    dealt = placed.withColumn("copy", F.explode(copies)).select("*", "copy.part", "copy.before")
    dealt = dealt.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.desc("before"), "position")
    parts = dealt.select(*fields).mapInArrow(run, PARTS)
    return short.withColumn("long", F.lit(False)).union(parts.withColumn("long", F.lit(True)))


def digester(template):
    """Task: formatted parts in order to one row for each conversation, read back and hashed as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, state = [], (), None

        def close():
            turns, loss, totals = state
            out.append({
                "conv_id": key[0], "n_turns": totals[0], "turns_sha256": turns.hexdigest(), "loss_chars": totals[1],
                "loss_sha256": loss.hexdigest(), "formatted_chars": totals[2]})

        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"],) != key:
                    if key:
                        close()
                    key, state = (row["conv_id"],), (hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
                turns, loss, totals = state
                text = row["formatted"]
                for role, said in template.read(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    totals[0] += 1
                for span in row["loss"]:
                    said = template.unescape(text[span["start"]:span["stop"]])
                    loss.update(said.encode())
                    totals[1] += len(said)
                totals[2] += len(text)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if key:
            close()
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return run


def read_back(formatted: DataFrame, template) -> DataFrame:
    """Digests of every conversation, from its formatted text and mask alone.

    Result: ``conv_id``, ``n_turns``, ``turns_sha256`` (role, new line, text, new line of each turn), ``loss_chars`` and
    ``loss_sha256`` (texts under the mask, unescaped), ``formatted_chars``. A text whose turns cannot be read raises.

    Conversations of one row are read where they are. The parts of long ones are put in order and read as a stream; a
    digest over a whole conversation has to pass through one task, which holds one part at a time.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    needed = ("conv_id", "part", "formatted", "loss")
    whole = formatted.filter(~F.col("long")).select(*needed).mapInArrow(digester(template), schema)
    parts = formatted.filter("long").select(*needed).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.union(parts.mapInArrow(digester(template), schema))
