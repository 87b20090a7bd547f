"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share a path of the tree. Sorted by the chain
hashes of their turns, a tree's conversations follow each other depth first, so each one emits
only the turns beyond what it shares with the one before. A segment carries its position ids
(they go on after the shared turns) and the intervals of its pack that hold its ancestors,
which together with its own causal part is what its characters may attend to.

Segments are laid out in packs of bounded length; a pack begins with a whole conversation, so
shared turns are written once in a pack. Packs never cross tasks: conversations are dealt by
ranges of (path, id), which also splits copies of one conversation.

``tokenized`` turns segments into token ids with the position id of every token; offsets of
segments themselves count characters.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` without the blanks. In texts and roles a
``<``, any backslashes and ``|`` get one backslash more before the bar, and lose it on reading,
so no control string can come from a text; a newline in a role is written ``<|nl|>``.

Defined cases: a null text or role is empty; repeated rows are turns of their own; turns are
ordered by number, role, text, nulls first; a row with a null conv_id is a conversation of its
own, so that such rows never meet in one task; an empty table gives no packs; other columns are
ignored. A conversation is one training example, so one task holds it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import pick, staged

START, STOP, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNED_ROLE = "assistant"
PACK_CHARS = 1 << 20
_GUARD, _UNGUARD = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

SEGMENTS = (
    "pack long, seq long, conv_id long, start long, position long, text string, "
    "ancestors array<struct<start:long,stop:long>>, loss array<struct<start:long,stop:long>>"
)


def escape(text: str) -> str:
    return _GUARD.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn in the template, and the part of it that is learned."""
    head = f"{START}{escape(role).replace(chr(10), NEWLINE)}\n"
    body = escape(text)
    return f"{head}{body}{STOP}\n", (len(head), len(head) + len(body)) if role == LEARNED_ROLE else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(role.replace(NEWLINE, "\n")), unescape(text)) for role, text in _TURN.findall(formatted)]


def gathered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order."""
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turn = F.struct("turn", blank("role"), blank("text"))
    of = F.col("conv_id").cast("long").alias("conv_id")
    known = rows.where("conv_id is not null").groupBy(of).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return known.unionByName(rows.where("conv_id is null").select(of, F.array(turn).alias("turns")))


def with_paths(conversations: DataFrame) -> DataFrame:
    """Adds path: eight bytes for each turn, a hash of all turns up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for turns in batch.column(1).to_pylist():
                chain, path = b"", []
                for t in turns:
                    role, text = t["role"].encode(), t["text"].encode()
                    chain = xxhash.xxh3_128_digest(b"%b%d:%b%d:%b" % (chain, len(role), role, len(text), text))
                    path.append(chain[:8])
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.binary())], names=["conv_id", "turns", "path"])

    return conversations.mapInArrow(run, "conv_id long, turns array<struct<turn:long,role:string,text:string>>, path binary")


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _emit(batches: Iterator[pa.RecordBatch], pack_chars: int) -> Iterator[dict]:
    """The segments of sorted conversations."""
    task = TaskContext.get()
    pack = (task.partitionId() if task else 0) << 32
    seq, used = 0, 0
    stack: list[tuple[tuple[str, str], int, int]] = []  # turns of the last conversation: (turn, start, stop)
    for batch in batches:
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if used >= pack_chars:
                pack, seq, used, stack = pack + 1, 0, 0, []
            keys = [(t["role"], t["text"]) for t in turns]
            shared = 0
            while shared < min(len(stack), len(keys)) and stack[shared][0] == keys[shared]:
                shared += 1
            del stack[shared:]
            spans = [(a, b) for _, a, b in stack]
            position = sum(b - a for a, b in spans)
            pieces, loss, at = [], [], 0
            for role, text in keys[shared:]:
                piece, learned = render(role, text)
                if learned:
                    loss.append({"start": at + learned[0], "stop": at + learned[1]})
                stack.append(((role, text), used + at, used + at + len(piece)))
                pieces.append(piece)
                at += len(piece)
            yield {"pack": pack, "seq": seq, "conv_id": conv_id, "start": used, "position": position, "text": "".join(pieces), "ancestors": _merged(spans), "loss": loss}
            seq, used = seq + 1, used + at


def _rows(rows: Iterator[dict], schema: pa.Schema, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + 200
        if size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SEGMENT = pa.schema([("pack", pa.int64()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("text", pa.string()), ("ancestors", _SPAN), ("loss", _SPAN)])


def format_conversations(conversations: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Segments (see SEGMENTS) of conversations as ``gathered`` gives them. Offsets count code
    points: ``start`` and ``ancestors`` in the pack, ``loss`` in the segment's text, and
    ``position`` is the position id of the segment's first character."""
    ordered = staged(with_paths(conversations), "paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(lambda batches: _rows(_emit(batches, pack_chars), _SEGMENT), SEGMENTS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, shared_chars long"


def read_conversations(segments: DataFrame) -> DataFrame:
    """Read every conversation back from the segments: what its ancestors' intervals hold, then
    its own text. Packs are read in order; only the text of the current path is held."""
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pack, held = None, []  # held: (start, stop, text, learned spans in the pack) of the current path
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    pack, held = row["pack"], []
                parts = []
                for span in row["ancestors"]:
                    for start, stop, text, loss in held:
                        a, b = max(start, span["start"]), min(stop, span["stop"])
                        if a < b:
                            parts.append((a, b, text[a - start : b - start], [(max(x, a), min(y, b)) for x, y in loss if max(x, a) <= min(y, b) and a <= x <= y <= b]))
                start = row["start"]
                parts.append((start, start + len(row["text"]), row["text"], [(start + x["start"], start + x["stop"]) for x in row["loss"]]))
                held = parts
                formatted = "".join(text for _, _, text, _ in parts)
                turns = parse(formatted)
                learned = [unescape(text[x - at : y - at]) for at, _, text, loss in parts for x, y in loss]
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                yield {
                    "conv_id": row["conv_id"],
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "loss_chars": sum(map(len, learned)),
                    "loss_sha256": hashlib.sha256("".join(learned).encode()).hexdigest(),
                    "formatted_chars": len(formatted),
                    "shared_chars": row["position"],
                }

    ordered = segments.repartition("pack").sortWithinPartitions("pack", "seq")
    return ordered.mapInArrow(lambda batches: _rows(read(batches), schema), READ)


TOKENS = (
    "pack long, seq long, conv_id long, start long, token_ids array<int>, positions array<int>, "
    "ancestors array<struct<start:long,stop:long>>, loss array<struct<start:long,stop:long>>"
)


def tokenized(segments: DataFrame, path: str, pattern: str) -> DataFrame:
    """Segments as tokens (see TOKENS) by the ranks at ``path``: shared tokens once in a pack, the
    position id of each token in its conversation, and the intervals of the pack's tokens that
    hold its ancestors. ``loss`` counts tokens of the segment. The parts of a turn, its head, text
    and end, are encoded by themselves, so that intervals and loss begin and end between tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = codec(path, pattern)
        pack, used, edges = None, 0, {}  # edges: characters of the pack up to a turn's end -> tokens
        for batch in batches:
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    pack, used, edges = row["pack"], 0, {0: 0}
                text, begin, loss = row["text"], used, []
                learned = {x["start"] for x in row["loss"]}
                turns = list(_TURN.finditer(text))
                parts = own.encode([p for m in turns for p in (text[m.start() : m.start(2)], m[2], text[m.end(2) : m.end()])])
                ids = np.frombuffer(b"".join(parts), "<u4").tolist()
                for m, (head, body, end) in zip(turns, zip(*[iter(parts)] * 3, strict=True), strict=True):
                    if m.start(2) in learned and body:
                        at = used - begin + len(head) // 4
                        loss.append({"start": at, "stop": at + len(body) // 4})
                    used += (len(head) + len(body) + len(end)) // 4
                    edges[row["start"] + m.end()] = used
                ancestors = [{"start": edges[x["start"]], "stop": edges[x["stop"]]} for x in row["ancestors"]]
                first = sum(x["stop"] - x["start"] for x in ancestors)
                yield {
                    "pack": pack, "seq": row["seq"], "conv_id": row["conv_id"], "start": begin, "token_ids": ids, "positions": list(range(first, first + len(ids))),
                    "ancestors": ancestors, "loss": loss, "text": text,
                }

    ints = pa.list_(pa.int32())
    schema = pa.schema([("pack", pa.int64()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("start", pa.int64()), ("token_ids", ints), ("positions", ints), ("ancestors", _SPAN), ("loss", _SPAN)])
    ordered = segments.repartition("pack").sortWithinPartitions("pack", "seq")
    return ordered.mapInArrow(lambda batches: _rows(encode(batches), schema), TOKENS)


PROBE_TEXT = f"{STOP}{START}assistant ok"


def with_probe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Adds conversation -1, whose texts hold the template's own control strings."""
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return pick(df, conv_id="conv_id", turn="turn", role="role", text="text").unionByName(probe)


def round_trip(df: DataFrame) -> DataFrame:
    return read_conversations(staged(format_conversations(gathered(df)), "segments"))


def _extra(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '<\\*\|'))"


SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum({len(START) + 1 + len(STOP) + 1} + length(role) + {_extra("role")} + {len(NEWLINE) - 1} * (length(role) - length(replace(role, chr(10), ''))) + length(text) + {_extra("text")})::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
