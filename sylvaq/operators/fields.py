"""Several values packed in one text field: one row per value, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaq.ship import ship

DELIMITERS = ",;|/\t\n\r"
QUOTES = "\"'"
OPEN, CLOSE = "([{", ")]}"

# States of the tokenizer.
_LEAD, _BARE, _QUOTED, _AFTER = range(4)


def split_field(
    text: str | None,
    delimiters: str = DELIMITERS,
    quotes: str = QUOTES,
    escape: str = "\\",
) -> list[str]:
    """Values of one field, left to right.

    A finite-state pass over the characters. Before a value (LEAD) blanks are
    skipped and a quote opens a quoted value; inside it (QUOTED) delimiters are
    plain, a doubled quote is one quote, and the closing quote leads to AFTER,
    where text up to the next delimiter is appended. In a bare value brackets
    raise a nesting depth that protects delimiters until it falls back to zero,
    and the escape character makes a following delimiter, quote or escape plain.
    A quote inside a bare value is an ordinary character. What never closes does
    not protect: from a quote or bracket without its partner on, that quote
    character, or all brackets, are ordinary characters, and the text is read
    again from there. That happens once per kind, so the time is linear.
    Bare values are trimmed and dropped when blank; a quoted value is kept as it
    stands, even when blank. None and blank texts give no values.
    """
    out: list[str] = []
    if not text:
        return out
    n, i = len(text), 0
    state, depth, quote, begin = _LEAD, 0, "", 0
    buf: list[str] = []
    opening, brackets = set(quotes), True
    bracket_at, bracket_len = -1, 0

    def flush() -> None:
        nonlocal buf, state, depth
        if state == _AFTER:
            out.append(("".join(buf)).rstrip() if tail else "".join(buf))
        elif state == _BARE and (value := "".join(buf).strip()):
            out.append(value)
        buf, state, depth = [], _LEAD, 0

    tail = False
    while True:
        if i == n:
            if state == _QUOTED:  # never closed: read again as bare text
                opening.discard(quote)
                i, buf, state = begin, [], _LEAD
                continue
            if state == _BARE and depth:  # never closed: brackets are plain from here
                brackets, i, depth = False, bracket_at, 0
                buf = buf[:bracket_len]
                continue
            flush()
            return out
        c = text[i]
        if state == _LEAD:
            if c in delimiters or c.isspace():
                i += 1
            elif c in opening:
                state, quote, begin, tail = _QUOTED, c, i, False
                i += 1
            else:
                state = _BARE
        elif state == _QUOTED:
            if c != quote:
                buf.append(c)
                i += 1
            elif text[i + 1 : i + 2] == quote:
                buf.append(c)
                i += 2
            else:
                state = _AFTER
                i += 1
        elif state == _AFTER:
            if c in delimiters:
                flush()
            else:
                if tail or not c.isspace():
                    buf.append(c)
                    tail = True
            i += 1
        elif c == escape and i + 1 < n and (text[i + 1] in delimiters or text[i + 1] in quotes or text[i + 1] == escape):
            buf.append(text[i + 1])
            i += 2
        elif brackets and c in OPEN:
            if not depth:
                bracket_at, bracket_len = i, len(buf)
            depth += 1
            buf.append(c)
            i += 1
        elif c in CLOSE and depth:
            depth -= 1
            buf.append(c)
            i += 1
        elif c in delimiters and not depth:
            flush()
            i += 1
        else:
            buf.append(c)
            i += 1


def split_values(
    df: DataFrame,
    column: str,
    keep: list[str],
    value: str = "value",
    pos: str = "pos",
    min_values: int = 1,
    delimiters: str = DELIMITERS,
    quotes: str = QUOTES,
) -> DataFrame:
    """One row per value of ``column``: the ``keep`` columns, ``pos`` from 1, ``value``.

    A narrow map without a shuffle: only ``keep`` and ``column`` are read, every
    Arrow batch is dictionary-encoded, and the tokenizer runs once per distinct
    text of the batch; the expansion is Arrow ``take``. Fields with fewer than
    ``min_values`` values give no rows; NULL, empty and blank fields have none.
    Repeated rows and repeated values stay. Other columns of ``df`` are not
    touched, whatever their names.
    """
    ship(df.sparkSession)
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(pos, T.IntegerType()), T.StructField(value, T.StringType())])
    aliases = [f"k{i}" for i in range(len(keep))]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            enc = batch.column(len(aliases)).dictionary_encode()
            parts = [split_field(x, delimiters, quotes) for x in enc.dictionary.to_pylist()]
            parts = [p if len(p) >= min_values else [] for p in parts] + [[]]
            code = enc.indices.fill_null(len(parts) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([len(p) for p in parts], np.int64)
            flat = pa.array([v for p in parts for v in p], pa.string())
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            count = size[code]
            row = np.repeat(np.arange(len(code)), count)
            if not len(row):
                continue
            ordinal = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            take = pa.array(row)
            values = flat.take(pa.array(start[code][row] + ordinal))
            cols = [batch.column(i).take(take) for i in range(len(aliases))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array((ordinal + 1).astype(np.int32)), values], names=names)

    narrow = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, aliases)], F.col(f"`{column}`").cast("string").alias("v"))
    return narrow.where(F.col("v").isNotNull()).mapInArrow(run, schema)
