"""What a conversion may call besides its own parsers. Nothing is called unless it is given here and asked for by options."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..options import Options


@dataclass(frozen=True)
class Services:
    """A language-model provider (request dict to text), a recognizer (image bytes to text), a rasterizer (PDF bytes to page images), block filters by name."""

    provider: Callable[[dict], str] | None = None
    recognize: Callable[[bytes], str] | None = None
    rasterize: Callable[[bytes], list[bytes]] | None = None
    filters: tuple[str, ...] = ()

    def check(self, options: Options) -> None:
        """An option that nothing here can carry out is an error, not a silent wish."""
        if (options.llm != "none" or options.restructure or options.translate) and self.provider is None:
            raise ValueError("llm, restructure and translate need a provider")
        if options.ocr != "none" and (self.recognize is None or self.rasterize is None):
            raise ValueError("ocr needs a recognizer and a rasterizer")


def named(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once, however often it is read: calls to services are not repeated by a plan. In the checkpoint folder if there is one."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()
