"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, seq, kind, msg_id, role, text) is partitioned by conversation and sorted
by sequence; each conversation's events are folded into its final messages, which are then rendered.
Kinds: `message` adds a whole message, the first of its msg_id being the one that others refer to; `delta` appends to message msg_id, opening it if need be;
`edit` replaces its text; `regenerate` empties it and drops the messages after it, for new deltas;
`delete` removes it. The fold streams through sorted rows and holds one conversation at a time.

Template: each turn is `### role: text </turn>` and a newline. Backslashes, `###`, `</turn>` and
colons of roles inside role and text are escaped by a backslash, reversibly.

Defined results: null text and role are empty. Events that tie in sequence go by kind, msg_id, role,
text; repeated rows repeat. Edits, regenerations and deletions of unknown messages, and events of
unknown kinds, change nothing. A null conv_id is a conversation of its own. Empty table: no rows.
Texts of any length are rendered whole; one conversation is held by one task, as its digest is of
its whole text in order. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

OPEN, CLOSE = "### ", " </turn>\n"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.S)
#: What a planted conversation says, to show that control strings survive.
TRICKY = "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: {"###": "\\#\\#\\#"}.get(m[0], "\\" + m[0]), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, end) of it that bear loss."""
    parts, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == loss_role:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() had; raises if there is anything between them."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def fold(events) -> list[tuple[str, str]]:
    """Final (role, text) messages of one conversation's events (kind, msg_id, role, text) in order."""
    messages: dict[object, list] = {}
    for i, (kind, msg_id, role, text) in enumerate(events):
        text, key = text or "", ("id", msg_id)
        if kind == "message":
            messages[("row", i) if key in messages else key] = [role or "", [text]]
        elif kind == "delta":
            messages.setdefault(key, [role or "", []])[1].append(text)
        elif key in messages:
            if kind == "edit":
                messages[key][1] = [text]
            elif kind == "delete":
                del messages[key]
            elif kind == "regenerate":
                names = list(messages)
                for k in names[names.index(key) + 1 :]:
                    del messages[k]
                messages[key][1] = [text]
    return [(role, "".join(parts)) for role, parts in messages.values()]


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(conv_id, events) of rows sorted by conversation, across batches."""
    now, events = None, []
    for b in batches:
        for conv, *event in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "msg_id", "role", "text"))):
            if events and conv != now:
                yield now, events
                events = []
            now = conv
            events.append(event)
    if events:
        yield now, events


def reconstruct(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, formatted and mask (array of spans) for each conversation of the log."""
    spark = log.sparkSession
    common.bound_batches(spark)
    dealt = log.select("conv_id", "seq", "kind", "msg_id", "role", "text").repartition(*([partitions] if partitions else []), "conv_id").sortWithinPartitions("conv_id", "seq", "kind", "msg_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, masks = [], [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": s, "end": e} for s, e in m] for m in masks], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "mask"])

        size = 0
        for conv, events in _conversations(batches):
            formatted, mask = render(fold(events))
            ids.append(conv), texts.append(formatted), masks.append(mask)
            size += len(formatted)
            if size > 4 << 20:
                yield full()
                ids, texts, masks, size = [], [], [], 0
        if ids:
            yield full()

    return dealt.mapInArrow(run, "conv_id long, formatted string, mask array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, mask in zip(b.column("formatted").to_pylist(), b.column("mask").to_pylist()):
                turns = parse(text)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in mask))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(conversations: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as an event that adds a message."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("string").alias("msg_id"), "role", "text")


def streamed(conv_id: int, turns: list[tuple[str, str]]) -> list[tuple]:
    """A log that ends in these turns: drafts that are edited, an answer that is regenerated, then streamed in small pieces."""
    log: list[tuple] = []

    def add(kind: str, msg_id: str | None, role: str | None, text: str | None) -> None:
        log.append((conv_id, len(log), kind, msg_id, role, text))

    for i, (role, text) in enumerate(turns):
        if role != LOSS_ROLE:
            add("message", f"m{i}", role, text[::-1] + " draft")
            add("edit", f"m{i}", role, text)
            continue
        add("delta", f"m{i}", role, "a first answer")
        add("message", f"m{i}x", "user", "a question that goes with it")
        add("regenerate", f"m{i}", None, None)
        for at in range(0, len(text), 5):
            add("delta", f"m{i}", role, text[at : at + 5])
        add("message", f"m{i}y", "user", "sent by mistake")
        add("delete", f"m{i}y", None, None)
    return log


def op5(spark, sf_dir: str) -> DataFrame:
    """All conversations, each row an event, and conversation -7, which is reconstructed from a streamed log with edits."""
    rows = events_of(common.table(spark, sf_dir, "conversations"))
    planted = spark.createDataFrame(streamed(-7, [("user", TRICKY), ("assistant", TRICKY)]), "conv_id long, seq long, kind string, msg_id string, role string, text string")
    return digests(reconstruct(rows.unionByName(planted)))
