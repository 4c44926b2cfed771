"""Chat logs rebuilt from events, rendered under a template with a loss mask, and read back.

An event log has a conversation, a message, a sequence number, a kind and a text:
`open` starts a message with a role, `delta` appends, `edit` puts a whole new text,
`regenerate` throws the text away and streams anew. The log is partitioned by
conversation and sorted by message and sequence number; one pass over the sorted
rows folds each message's events, renders the message and reads it back, holding
one message at a time, so that texts are shuffled once.

A conversation of more than `HOT_ROWS` rows or `HOT_CHARS` characters is dealt by
ranges of its messages instead, so that many tasks fold and render it. Only its
digests, if asked for, need its rendered messages in one stream: SHA-256 has no
other way.

Template: `[ROLE role]`, line feed, text, `</s>`, line feed for each message. Inside
roles and texts a backslash is doubled and control strings get a backslash after
their first character, so that every escaped text reads back exactly and no text
can end its turn. The loss mask covers the texts of assistant messages.

Defined results: a null text is empty, a null role the empty role; a message without
`open` has the empty role; events of equal sequence number are taken in the order
of kind (`open`, `regenerate`, `edit`, `delta`) and text; repeated rows of a
conversation table are turns of their own; turns with one number are ordered by
role and text, a null number comes first; a null conversation is one of its own; a
very long text is held once, with the message that it belongs to; columns other
than those named play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import common

KINDS = ("open", "regenerate", "edit", "delta")
#: What a reader of the format could take for structure.
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?SYS>>|\[ROLE ")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"
#: A text is streamed in deltas of so many characters when a table of turns is made a log.
DELTA_CHARS = 4096
#: A conversation beyond either is dealt by ranges of its messages.
HOT_ROWS = 10_000
HOT_CHARS = 16 << 20
#: Messages of a table of turns are numbered in each task; a task's numbers lie beyond those of the task before.
TASK_BITS = 33
#: Rows of a batch that are Python objects at once.
ROWS_AT_ONCE = 256
PLANTED_ID = -7
PLANTED_TEXT = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """Roles stand on the marker's line: brackets and line feeds are written out too."""
    return escape(role).replace("]", "\\]").replace("\n", "\\\n")


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A message as formatted, and the span of its text if that counts for the loss."""
    head = f"[ROLE {escape_role(role)}]\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == LOSS_ROLE else None
    return f"{head}{body}</s>\n", span


TURN = re.compile(r"\[ROLE ((?:\\.|[^\]\\])*)\]\n(.*?)</s>\n", re.DOTALL)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation or of whole messages of one."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


def fold(events: Iterable[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """The role and text after events of (kind, role, text) in sequence order."""
    role, parts = "", []
    for kind, said, text in events:
        if kind == "open":
            role = said or ""
        elif kind in ("edit", "regenerate"):
            parts = [text or ""]
        elif kind == "delta":
            parts.append(text or "")
        else:
            raise ValueError(f"unknown event {kind!r}")
    return role, "".join(parts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length, bounded too in the characters of column `sized`."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[sized]) if sized is not None else 0
        if len(held) >= 4096 or size > 1 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


Event = tuple[int | None, int, str, str | None, str | None]
Message = tuple[int | None, int, str, str]
Rendered = tuple[int | None, int, str, int | None, int | None]


def stream_turns(rows: Iterable[tuple], first: int = 0) -> Iterator[Event]:
    """Sorted rows of conversation, role and text as a log: each opens a message and sends its text in deltas."""
    for message, (conv, role, text) in enumerate(rows, first):
        yield conv, message, "open", role, None
        for at in range(0, len(text or ""), DELTA_CHARS):
            yield conv, message, "delta", None, text[at : at + DELTA_CHARS]


def fold_messages(events: Iterable[Event]) -> Iterator[Message]:
    """The final messages of a sorted log."""
    for (conv, message), group in itertools.groupby(events, key=lambda e: e[:2]):
        yield conv, message, *fold(e[2:] for e in group)


def render_messages(messages: Iterable[Message]) -> Iterator[Rendered]:
    """Each message as formatted, and the span in it under the loss mask; a conversation is its messages' texts in order."""
    for conv, message, role, text in messages:
        formatted, span = render(role, text)
        yield conv, message, formatted, *(span or (None, None))


def digest_conversations(rendered: Iterable[Rendered]) -> Iterator[tuple]:
    """A row for each conversation, read back from its formatted messages: turns and loss texts, as counts and digests."""
    for conv, group in itertools.groupby(rendered, key=lambda r: r[0]):
        turns = loss = chars = 0
        all_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
        for _, _, formatted, start, end in group:
            chars += len(formatted)
            for role, text in parse(formatted):
                turns += 1
                all_sha.update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(formatted[start:end])
                loss += len(masked)
                loss_sha.update(masked.encode())
        yield conv, turns, all_sha.hexdigest(), loss, loss_sha.hexdigest(), chars


MESSAGES = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("text", pa.string())])
MESSAGES_SQL = "conv_id long, message long, role string, text string"
RENDERED = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
RENDERED_SQL = "conv_id long, message long, formatted string, loss_start long, loss_end long"
DIGESTS_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Log:
    """Rows that are dealt by conversation, the order in which they make a log, and what makes events of them."""

    rows: DataFrame
    #: Orders the rows of a conversation; the first `ranged` of these columns keep a message together.
    order: tuple[Column, ...]
    ranged: int
    sent: tuple[str, ...]
    events: Callable[[Iterator[tuple]], Iterator[Event]]

    def split(self, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS) -> tuple[Log, Log | None]:
        """The conversations that one task can take, and the others, if there are any."""
        sizes = self.rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
        hot = common.settle(sizes.where((F.col("n") > hot_rows) | (F.col("chars") > hot_chars)).select(F.col("conv_id").alias("hot_id")), "chat-hot")
        if hot.isEmpty():
            common.release(hot)
            return self, None
        of = lambda how: replace(self, rows=self.rows.join(hot, F.col("conv_id").eqNullSafe(F.col("hot_id")), how))
        return of("left_anti"), of("left_semi")

    def pass_over(self, step: Callable[[Iterator[Event]], Iterator[tuple]], schema: pa.Schema, schema_sql: str, sized: int | None = None, by_range: bool = False) -> DataFrame:
        """One pass over the sorted log, dealt by conversation or by ranges of messages."""
        make = self.events

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(step(make(_rows(batches))), schema, sized)

        conv = F.col("conv_id").asc_nulls_first()
        dealt = self.rows.repartitionByRange(conv, *self.order[: self.ranged]) if by_range else self.rows.repartition("conv_id")
        return dealt.sortWithinPartitions(conv, *self.order).select(*self.sent).mapInArrow(common.lean(run), schema_sql)


def log_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Log:
    """A table of turns as a log."""
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # Turns of one number are dealt by the start of their text too; the whole text is a sort key only.
    order = (F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32), F.col("text"))
    return Log(rows, order, 3, ("conv_id", "role", "text"), lambda r: stream_turns(r, TaskContext.get().partitionId() << TASK_BITS))


def log_of_events(events: DataFrame) -> Log:
    """A table of events (conv_id, message, seq, kind, role, text) as a log; messages stand in the order of their numbers."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = (F.col("message"), F.col("seq"), place, F.col("text").asc_nulls_first())
    return Log(events.select("conv_id", "message", "seq", "kind", "role", "text"), order, 1, ("conv_id", "message", "kind", "role", "text"), iter)


def reconstruct(log: Log, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS) -> DataFrame:
    """Final messages of a log: conv_id, message, role, text; `message` orders the messages of a conversation."""
    return _every(log, fold_messages, MESSAGES, MESSAGES_SQL, 3, hot_rows, hot_chars)


def _every(log: Log, step: Callable[[Iterator[Event]], Iterator[tuple]], schema: pa.Schema, schema_sql: str, sized: int, hot_rows: int, hot_chars: int) -> DataFrame:
    cold, hot = log.split(hot_rows, hot_chars)
    out = cold.pass_over(step, schema, schema_sql, sized)
    return out if hot is None else out.unionAll(hot.pass_over(step, schema, schema_sql, sized, by_range=True))


def format_log(log: Log, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS) -> DataFrame:
    """Each message's formatted text and the span in it under the loss mask; `message` orders the messages of a conversation."""
    return _every(log, lambda events: render_messages(fold_messages(events)), RENDERED, RENDERED_SQL, 2, hot_rows, hot_chars)


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation from its formatted messages in order: turns and loss texts, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(digest_conversations(_rows(batches)), DIGESTS)

    return rendered.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "message").mapInArrow(common.lean(run), DIGESTS_SQL)


def format_and_read_back(log: Log, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS) -> DataFrame:
    """The digests of all conversations: each is folded, rendered and read back in the pass that sorts it, but for very large ones."""
    cold, hot = log.split(hot_rows, hot_chars)
    out = cold.pass_over(lambda events: digest_conversations(render_messages(fold_messages(events))), DIGESTS, DIGESTS_SQL)
    if hot is None:
        return out
    return out.unionAll(read_back(hot.pass_over(lambda events: render_messages(fold_messages(events)), RENDERED, RENDERED_SQL, 2, by_range=True)))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(PLANTED_ID, 0, "user", PLANTED_TEXT), (PLANTED_ID, 1, "assistant", PLANTED_TEXT)], "conv_id long, turn long, role string, text string")
    return format_and_read_back(log_of_turns(turns.unionByName(planted)))


#: The escapes add a character for each control string; the marks are "[ROLE ]\n" and "</s>\n" around role and text.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(role) + length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[ROLE '))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
