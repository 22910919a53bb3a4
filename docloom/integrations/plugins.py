"""Block filters by name: functions from block tables to block tables, with a manifest of what they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

ABI = 1
BlockFilter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    abi: int = ABI
    permissions: tuple[str, ...] = ()


_known: dict[str, tuple[Manifest, BlockFilter]] = {}


def register(manifest: Manifest, function: BlockFilter) -> None:
    if manifest.abi != ABI:
        raise ValueError(f"plugin {manifest.name} has ABI {manifest.abi}, not {ABI}")
    _known[manifest.name] = (manifest, function)


def apply(blocks: DataFrame, *names: str) -> DataFrame:
    """``blocks`` through the named filters in order; each must keep the columns."""
    for n in names:
        columns = blocks.columns
        blocks = _known[n][1](blocks)
        if blocks.columns != columns:
            raise ValueError(f"plugin {n} changed the block columns")
    return blocks
