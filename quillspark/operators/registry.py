"""Names for functions that users add: chunkers over element tables, partitioners over file tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import segment

CHUNKERS: dict[str, Callable[..., DataFrame]] = {"basic": segment.chunk_basic, "by_title": segment.chunk_by_title}
PARTITIONERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_chunker(name: str, f: Callable[..., DataFrame]) -> None:
    CHUNKERS[name] = f


def chunk(elements: DataFrame, strategy: str, *args, **kwargs) -> DataFrame:
    """elements chunked by a registered strategy; an unknown one raises KeyError."""
    return CHUNKERS[strategy](elements, *args, **kwargs)


def register_partitioner(category: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """f takes the files of a category (see sources.files.route_files) and gives elements."""
    PARTITIONERS[category] = f


def partition(files: DataFrame) -> DataFrame | None:
    """Elements of all files whose category has a partitioner, in one table; None without any partitioner."""
    out = None
    for category, f in PARTITIONERS.items():
        rows = f(files.where(files["category"] == category))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
