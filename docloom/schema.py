"""The relations of the document model.

Every relation is keyed by ``doc_id`` and, where order matters, by ``pos``: DataFrames have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<text:string,rowspan:int,colspan:int,image:string>"
ROWS = f"array<struct<cells:array<{CELL}>>>"
ITEMS = "array<struct<kind:string,text:string>>"

#: Columns of a block after its key.
BLOCK = {
    "kind": "string",  # heading paragraph list text table image code footnote raw
    "level": "int",
    "text": "string",
    "ordered": "boolean",
    "items": ITEMS,
    "rows": ROWS,
    "alt": "string",
    "path": "string",
    "title": "string",
    "language": "string",
    "label": "string",
}
BLOCKS = "doc_id long, pos int, " + ", ".join(f"{k} {v}" for k, v in BLOCK.items())


def block(kind: str | Column, **fields: Column) -> Column:
    """A block as a struct; fields that are not given are null."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(k.alias("kind"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in BLOCK.items() if f != "kind"])


def exploded(df: DataFrame, blocks: str, *keys: str) -> DataFrame:
    """Rows (keys, pos, block columns) of an array column of blocks."""
    return df.select(*keys, F.posexplode(blocks).alias("pos", "b")).select(*keys, "pos", "b.*")
