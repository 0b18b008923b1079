"""Chat formatting: conversations rendered by a compiled template, with the spans that a model learns, and read back again.

A turn's text depends on its message and its number alone (the template language carries nothing from round to round), so
turns are rendered wherever they lie: a conversation of any length is spread over tasks, as pieces in order. Control
strings inside texts are broken by a backslash behind their first character, and backslashes are doubled, which a
reader undoes; so only the template's own marks are marks.

Cases: rows are ordered by turn (null first), then role and text; null roles and texts count as empty; a null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives nothing; further columns are not read.
Only the digests need a conversation's turns in one task, one after the other: a hash over a text cannot be split.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed
from .templates import Template

#: The marks of TEMPLATE, which texts may hold only broken.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = """
{#- Users' and system texts stand between marks; an assistant's stands alone up to its end mark and is what is learned. -#}
{%- for message in messages -%}
  {%- if loop.first -%} {{ '<s>' }} {%- endif -%}
  {%- if message.role == 'user' -%} {{ '[INST] ' ~ (message.text | guarded) ~ ' [/INST]' }}
  {%- elif message.role == 'system' -%} {{ '[SYS] ' ~ (message.text | guarded) ~ ' [/SYS]' }}
  {%- elif message.role == 'assistant' -%} {% generation %}{{ message.text | guarded }}{% endgeneration %}{{ '</s>' }}
  {%- else -%} {{ '[ROLE]' ~ (message.role | guarded) ~ '[TEXT]' ~ (message.text | guarded) ~ '[/ROLE]' }}
  {%- endif -%}
{%- endfor -%}
"""

_BREAK = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_MEND = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[SYS\] (.*?) \[/SYS\]|\[ROLE\](.*?)\[TEXT\](.*?)\[/ROLE\]|(.*?)</s>", re.S)


def guarded(text: str) -> str:
    """text without control strings: any that begins in it is broken behind its first character; backslashes are doubled."""
    return _BREAK.sub(lambda m: "\\\\" if m[1] is None else m[1] + "\\", text)


def unguarded(text: str) -> str:
    return _MEND.sub(r"\1", text)


@functools.cache
def compiled(source: str) -> Template:
    return Template(source, {"guarded": guarded})


def formatted(convs: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, place (a turn's number), total (turns of the conversation), piece, and
    loss: the spans (begin, end) of piece that are generated. A conversation's text is its pieces in order of place."""
    compiled(template).piece({"role": "", "text": ""}, 0, 1)  # a bad template fails here, not in the tasks
    rows = convs.select(
        F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("conversation"),
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = placed(rows, "conversation", [F.col("turn").asc_nulls_first()], [F.col("role"), F.col("text")])
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template_ = compiled(template)
        for batch in batches:
            texts, spans = [], []
            for role, text, place, total in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                written, loss = template_.piece({"role": role, "text": text}, place, total)
                texts.append(written)
                spans.append([{"begin": b, "end": e} for b, e in loss])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], names=["conv_id", "place", "total", "piece", "loss"])

    return ordered.select("conv_id", "role", "text", "place", "total").mapInArrow(render, "conv_id long, place long, total long, piece string, loss array<struct<begin:int,end:int>>")


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text, or of pieces of one."""
    text = text.removeprefix("<s>")
    out, at = [], 0
    for found in _TURN.finditer(text):
        if found.start() != at:
            break
        user, system, role, said, answer = found.groups()
        turn = ("user", user) if user is not None else ("system", system) if system is not None else ("assistant", answer) if answer is not None else (unguarded(role), said)
        out.append((turn[0], unguarded(turn[1])))
        at = found.end()
    if at != len(text):
        raise ValueError(f"no turn at {text[at : at + 40]!r}")
    return out


def digests(pieces: DataFrame) -> DataFrame:
    """What formatted() made, read back: conv_id, n_turns, turns_sha256 (over role, line feed, text, line feed of every turn), loss_chars and
    loss_sha256 (of the mended text under the spans), formatted_chars. Pieces stream through their conversation's hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        at, sums = (), None

        def told() -> tuple:
            return at[0], sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4]

        for batch in batches:
            done = []
            for conv, piece, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (conv,) != at:
                    if at:
                        done.append(told())
                    at, sums = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(piece):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    learned = unguarded(piece[span["begin"] : span["end"]])
                    sums[2] += len(learned)
                    sums[3].update(learned.encode())
                sums[4] += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(told(), schema)], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "piece", "loss")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are made of the template's own marks.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(convs: DataFrame) -> DataFrame:
    """conversations and number -1: a user and an assistant who both say PROBE."""
    probe = convs.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
