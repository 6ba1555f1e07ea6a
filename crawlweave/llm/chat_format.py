"""Chat formatting: conversations rendered through a compiled template.

Rows of a conversation come together by one shuffle and arrive in turn order as
a sorted stream; the template is compiled once per task. Control strings inside
texts and roles are escaped reversibly, so ``read_back`` recovers every turn
from the formatted text alone, and the loss spans hold the assistant's texts.

Defined cases: a null text or role is the empty string; a null conversation id
is one conversation; turns that tie (null first) go by role, then text; repeated
rows are turns of their own; a conversation is one formatted text and therefore
one row, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.chat_template import compile_template, unescape, unescape_name

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | escape_name) }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' }}\n{% endfor %}"
)

_SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def _render(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def turns():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("_id", "role", "text")), strict=True)

        out, chars = [], 0

        def packed() -> pa.RecordBatch:
            ids, counts, texts, spans = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in s] for s in spans],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["_id", "n_turns", "formatted", "loss_spans"],
            )

        for conv, rows in groupby(turns(), key=lambda r: r[0]):
            messages = [{"role": role or "", "text": text or ""} for _, role, text in rows]
            text, spans = render(messages)
            out.append((conv, len(messages), text, spans))
            chars += len(text)
            if chars > 4 << 20:
                yield packed()
                out, chars = [], 0
        if out:
            yield packed()

    return run


def format_conversations(
    turns: DataFrame,
    template: str = TEMPLATE,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``_id, n_turns, formatted, loss_spans`` per conversation; ids are whole numbers."""
    compile_template(template)  # a bad template fails here, not in a task
    rows = turns.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("_id", T.LongType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_spans", _SPANS),
        ]
    )
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(width, "_id")
        .sortWithinPartitions("_id", "turn", "role", "text")
        .mapInArrow(_render(template), schema)
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a text made with ``TEMPLATE``."""
    turns = []
    for part in formatted.split(END + "\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape_name(role), unescape(text)))
    return turns


def loss_texts(formatted: str, spans: list[dict]) -> list[str]:
    return [unescape(formatted[s["start"] : s["end"]]) for s in spans]
