"""Scanning and classifying the bytes of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.operators.fuzzy import as_bytes

_JSON = re.compile(rb'\\.|["{}\[\]:,]', re.S)
_STRUCTURAL = frozenset(b"{}[]:,")


def structure(raw: bytes, escaped: bool = False, inside: bool = False) -> tuple[list[int], bool, bool]:
    """Places of structural characters outside strings, and the state to go on with: whether the next byte
    is escaped, and whether it is inside a string. A backslash escapes the byte after it, inside strings or not."""
    out, start = [], 0
    if escaped and raw:
        if raw[0] in _STRUCTURAL and not inside:
            out.append(0)
        start = 1
    for m in _JSON.finditer(raw, start):
        b = raw[m.start()]
        if b == 0x5C:
            if raw[m.end() - 1] in _STRUCTURAL and not inside:
                out.append(m.end() - 1)
        elif b == 0x22:
            inside = not inside
        elif not inside:
            out.append(m.start())
    tail = len(raw) - len(raw.rstrip(b"\\"))
    odd = (tail + (1 if escaped and tail == len(raw) else 0)) % 2 == 1 if tail else escaped and not raw
    return out, odd, inside


def json_structure(df: DataFrame, text: str, out: str = "structure") -> DataFrame:
    """df with the byte places of {}[]:, outside JSON strings, as an array; null for null texts."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else structure(t.encode())[0] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def escaped_places(text: Column) -> Column:
    """Byte places right after an odd run of backslashes, in the JVM: runs are found by a pattern."""
    raw = as_bytes(text)
    runs = F.split(F.regexp_replace(raw, r"\\\\", "  "), "")
    return F.filter(F.transform(runs, lambda c, i: F.when(c == "\\", i + 1)), lambda p: p.isNotNull() & (p < F.length(raw)))


def class_counts(text: Column, classes: dict[str, str]) -> dict[str, Column]:
    """For each named class (the inside of a bracket pattern over bytes) the number of bytes in it."""
    raw = as_bytes(text)
    return {name: F.length(raw) - F.length(F.regexp_replace(raw, f"[{inside}]", "")) for name, inside in classes.items()}


def map_bytes(text: Column, table: list[int]) -> Column:
    """Every byte of a text through a table of 256 entries: BINARY."""
    changed = [b for b in range(256) if table[b] != b]
    source, target = "".join(map(chr, changed)), "".join(chr(table[b]) for b in changed)
    return F.encode(F.translate(as_bytes(text), source, target), "ISO-8859-1")
