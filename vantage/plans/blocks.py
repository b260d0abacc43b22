"""Queries over pages as blocks."""

from __future__ import annotations

from vantage.catalog import query
from vantage.operators import blocks as B
from vantage.sources.tables import table


@query("R02_block_chunks")
def r02_blocks(spark, sf_dir):
    """Chunks of whole units of every page, with their heading paths."""
    return B.block_chunks(table(spark, sf_dir, "pages").select("page_id", "html"))
