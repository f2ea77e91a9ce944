"""Scans of byte streams that carry their state from chunk to chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from bitlake.operators.bytescan import structure

OUT = "stream_id string, chunk long, structure array<int>"
STATE = "escaped boolean, inside boolean, next long, early array<long>, texts array<string>"


def json_structure(chunks: DataFrame) -> DataFrame:
    """(stream_id, chunk, structure) for a stream of (stream_id, chunk, text): the places of structural
    characters of each chunk, where strings and escapes may cross chunks. The chunks of a stream are numbered
    from 0 without gaps and taken in that order; one that comes early waits in the state for those before it.
    A null text is an empty chunk; a number that has been taken is passed over, as is a null one; of chunks that
    wait under one number the first stays."""

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        escaped, inside, after, early, texts = state.get if state.exists else (False, False, 0, [], [])
        waiting = dict(zip(early, texts, strict=True))
        for frame in frames:
            for chunk, text in zip(frame["chunk"], frame["text"], strict=True):
                if pd.notna(chunk) and chunk >= after:
                    waiting.setdefault(int(chunk), text or "")
        out = []
        while after in waiting:
            places, escaped, inside = structure(waiting.pop(after).encode(), escaped, inside)
            out.append((key[0], after, places))
            after += 1
        state.update((bool(escaped), bool(inside), after, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["stream_id", "chunk", "structure"])

    return chunks.groupBy("stream_id").applyInPandasWithState(scan, OUT, STATE, "append", "NoTimeout")
