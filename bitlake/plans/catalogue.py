"""Registry of the library's queries and their SQL oracles."""

from __future__ import annotations

from bitlake.plans import frame_queries, word_queries

QUERIES: dict = {**frame_queries.QUERIES, **word_queries.QUERIES}
ORACLES: dict = {**frame_queries.ORACLES, **word_queries.ORACLES}


def flagship(spark, sf_dir):
    return QUERIES["spatial_range_hilbert"](spark, sf_dir)
