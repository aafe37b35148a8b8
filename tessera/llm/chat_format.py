"""Chat formatting in budgeted windows.

Turns are sorted by (conversation, turn) in ranges; running sums of their tokens, carried over the ends of the
ranges, give each turn its offset in its conversation. Offsets choose the windows: a conversation is laid on
stretches of STRETCH times a window's room for new turns, and the turns that start in a stretch are dealt to windows one after
another, a window ending before the turn that would not fit; a turn larger than the room makes a window of its own. So windows end with
turns, are as full as the turns allow but for the last of a stretch, and no turn needs more than its stretch: a very long conversation is
cut over many tasks. A window repeats the system turn and as many of the last turns before it as fit the history budget; only its new
assistant turns are in the loss mask, so every target counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, partitions, small_batches, tidied, whole_id

#: Tokens of a window for history and new turns (the system turn is on top), and of these for history.
BUDGET, HISTORY = 1024, 256
#: Rooms of a stretch.
STRETCH = 32
#: The template's marks, and further control strings that texts must not contain as such.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_WINDOWS = "conv_id long, window long, text string, repeated int, loss array<long>"


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn in the template, and where its text begins."""
    head = f"{TURN}{escape(role)}{TEXT}"
    return f"{head}{escape(text)}{END}", len(head)


def parse_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn."""
    out, at = [], 0
    while at < len(text):
        middle = text.index(TEXT, at)
        end = text.index(END, middle)
        out.append((unescape(text[at + len(TURN) : middle]), unescape(text[middle + len(TEXT) : end]), middle + len(TEXT), end))
        at = end + len(END)
    return out


def word_tokens(text: Column) -> Column:
    """Words and single other characters, and four for the template."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + 4


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from batch.slice(at, 1000).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_TURNS = pa.schema([("known", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with the tokens and turns before them in their conversation, as far as this range has it."""
    part = TaskContext.get().partitionId()

    def run() -> Iterator[dict]:
        key, before, nth = None, 0, 0
        for row in _rows(batches):
            if (row["known"], row["conv"]) != key:
                key, before, nth = (row["known"], row["conv"]), 0, 0
            yield row | {"part": part, "before": before, "nth": nth}
            before, nth = before + row["n"], nth + 1

    return _batches(run(), _TURNS)


def _format(batches: Iterator[pa.RecordBatch], room: int, history: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns of stretches to windows. One window's turns are held at a time, and the history before them."""
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()), ("loss", pa.list_(pa.int64()))])

    def window(conv: int | None, system: dict | None, past: list[dict], new: list[dict]) -> dict:
        first = [system] if system and new[0]["nth"] > 0 else []
        turns = first + past + new
        text, loss, length = [], [], 0
        for i, t in enumerate(turns):
            piece, head = format_turn(t["role"], t["text"])
            if i >= len(turns) - len(new) and t["role"] == "assistant":
                loss += [length + head, length + len(piece) - len(END)]
            text.append(piece)
            length += len(piece)
        return {"conv_id": conv, "window": new[0]["nth"], "text": "".join(text), "repeated": len(turns) - len(new), "loss": loss}

    def last(turns: list[dict], before: int) -> list[dict]:
        """The turns just before a place that fit the history, none left out between; the system turn has its own place."""
        left, out = history, []
        for t in reversed(turns):
            left -= t["n"]
            if left < 0 or t["nth"] != before - 1 - len(out) or is_system(t):
                break
            out.append(t)
        return out[::-1]

    def is_system(t: dict) -> bool:
        return t["nth"] == 0 and t["role"] == "system"

    def run() -> Iterator[dict]:
        for (known, conv, _), turns in groupby(_rows(batches), key=lambda r: (r["known"], r["conv"], r["stretch"])):
            system, past, new, size = None, [], [], 0
            conv = conv if known else None
            for t in turns:
                system = t if is_system(t) else system
                if t["kind"] == "old":
                    past.append(t)
                elif t["kind"] == "new":
                    if not new or size + t["n"] > room:
                        if new:
                            yield window(conv, system, past, new)
                        past = last(past + new, t["nth"])
                        new, size = [], 0
                    new.append(t)
                    size += t["n"]
            if new:
                yield window(conv, system, past, new)

    return _batches(run(), schema, 100)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: object = word_tokens) -> DataFrame:
    """Windows: conv_id, window (number of its first new turn), text, repeated (leading turns that repeat), loss (start, end, ...).

    turns: conv_id, turn, role, text; other columns are not read. Turns are taken in the order of turn, nulls first,
    ties by role and text. A null text or role counts as empty, a null conv_id as one conversation. The system turn is
    the conversation's first turn if its role is system. loss holds code-point spans of the escaped texts of new assistant
    turns. Nothing is cut or left out, however long; an empty table gives no windows. conv_id and turn hold whole numbers (others are an error).
    """
    if not 0 <= 2 * history <= budget:
        raise ValueError("history must be at most half the budget")
    spark = turns.sparkSession
    small_batches(spark)
    room = budget - history
    n = partitions(spark)
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(whole_id(turns, "conv_id"), F.lit(0)).alias("conv"), whole_id(turns, "turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("n", tokens(F.col("text"))).withColumn("tie", F.sha2(F.to_json(F.struct("role", "text")), 256))
    order = ["known", "conv", F.col("turn").asc_nulls_first(), "tie"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("known", "conv", "n", "role", "text")
    rows = materialize(rows.mapInArrow(tidied(_offsets), "known boolean, conv long, part int, nth long, before long, n long, role string, text string"), "turns")

    # What earlier ranges hold of a conversation; one row a range at most.
    sums = rows.groupBy("known", "conv", "part").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    earlier = W.partitionBy("known", "conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("known", "conv", "part", F.sum("n").over(earlier).alias("n_before"), F.sum("k").over(earlier).alias("k_before")).where("n_before IS NOT NULL")
    rows = rows.join(F.broadcast(carried), ["known", "conv", "part"], "left")
    rows = rows.withColumn("before", F.col("before") + F.coalesce("n_before", F.lit(0))).withColumn("nth", F.col("nth") + F.coalesce("k_before", F.lit(0)))
    rows = rows.withColumn("stretch", F.floor(F.col("before") / (STRETCH * room)).cast("long"))

    # Besides its own stretch, a turn may be history of the next one's first window; the system turn goes to all.
    use = lambda stretch, kind: F.struct(stretch.alias("stretch"), F.lit(kind).alias("kind"))
    is_system = (F.col("nth") == 0) & (F.col("role") == "system")
    near = (F.col("before") >= (F.col("stretch") + 1) * (STRETCH * room) - history) & (F.col("n") <= history) & ~is_system
    uses = F.array(use(F.col("stretch"), "new"), F.when(near, use(F.col("stretch") + 1, "old")))
    own = ["known", "conv", "nth", "n", "role", "text"]
    placed = rows.select(*own, F.explode(F.array_compact(uses)).alias("use")).select(*own, "use.*")
    later = rows.where("stretch > 0").select("known", "conv", "stretch").distinct()
    placed = placed.unionByName(later.join(rows.where(is_system).select(*own), ["known", "conv"]).withColumn("kind", F.lit("system")))
    # By a digest of conversation and stretch: a conversation's stretches spread over the tasks.
    placed = placed.repartition(n, "known", "conv", "stretch").sortWithinPartitions("known", "conv", "stretch", "nth")
    return placed.mapInArrow(tidied(lambda it: _format(it, room, history)), _WINDOWS)


def read_windows(windows: DataFrame) -> DataFrame:
    """The conversations as the windows hold them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation is sequential, so each conversation streams through one task, a window at a time.
    """
    n = partitions(windows.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[dict]:
            for conv, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                turns, losses = hashlib.sha256(), hashlib.sha256()
                k = chars = formatted = 0
                for w in group:
                    formatted += len(w["text"])
                    for role, text, _, _ in parse_window(w["text"])[w["repeated"] :]:
                        turns.update(f"{role}\n{text}\n".encode())
                        k += 1
                    for start, end in zip(w["loss"][::2], w["loss"][1::2], strict=True):
                        target = unescape(w["text"][start:end])
                        losses.update(target.encode())
                        chars += len(target)
                yield {"conv_id": conv, "n_turns": k, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": losses.hexdigest(), "formatted_chars": formatted}

        return _batches(run(), schema)

    ordered = windows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(tidied(digest), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_SPECIAL = "|".join(re.escape(c) for c in CONTROL)
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, 4 + len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]')) AS n,
  replace(role, '\', '\\') AS role2, replace(text, '\', '\\') AS text2 FROM t),
p AS (SELECT conv_id, nth, role, text, n, sum(n) OVER (PARTITION BY conv_id ORDER BY nth) - n AS before, (sum(n) OVER (PARTITION BY conv_id ORDER BY nth) - n) // {STRETCH * (BUDGET - HISTORY)} AS stretch,
  {len(TURN + TEXT + END)} + length(role2) + len(regexp_extract_all(role2, '{_SPECIAL}')) + length(text2) + len(regexp_extract_all(text2, '{_SPECIAL}')) AS chars FROM e),
g AS (SELECT conv_id, nth, nth AS first, n AS fill, stretch FROM p WHERE nth = 0
  UNION ALL SELECT p.conv_id, p.nth, CASE WHEN p.stretch <> g.stretch OR g.fill + p.n > {BUDGET - HISTORY} THEN p.nth ELSE g.first END, CASE WHEN p.stretch <> g.stretch OR g.fill + p.n > {BUDGET - HISTORY} THEN p.n ELSE g.fill + p.n END, p.stretch
  FROM g JOIN p ON p.conv_id = g.conv_id AND p.nth = g.nth + 1),
w AS (SELECT DISTINCT g.conv_id, g.first, p.before FROM g JOIN p ON p.conv_id = g.conv_id AND p.nth = g.first),
old AS (SELECT w.conv_id, sum(p.chars) AS chars FROM w JOIN p ON p.conv_id = w.conv_id AND p.nth < w.first AND (p.nth = 0 AND p.role = 'system' OR w.before - p.before <= {HISTORY}) GROUP BY w.conv_id)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(p.chars) + coalesce(any_value(old.chars), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN old ON old.conv_id = p.conv_id GROUP BY p.conv_id
"""


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_windows(materialize(format_windows(turns), "windows"))
