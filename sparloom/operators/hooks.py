"""What needs a third-party library comes from functions that the user registers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND: dict[str, Callable] = {}


def register_group_key(fn: Callable[[pd.Series], pd.Series]) -> None:
    """Structure text to group key (a scaffold); null where there is none."""
    _FOUND["group_key"] = fn


def register_validity(fn: Callable[[pd.Series], pd.Series]) -> None:
    _FOUND["validity"] = fn


def register_fingerprint(fn: Callable[[pd.Series], pd.Series]) -> None:
    """Structure text to a list of floats; zeros where it is invalid."""
    _FOUND["fingerprint"] = fn


def register_generator(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> None:
    """Batches of (id, prompt) to batches of (id, prediction_text)."""
    _FOUND["generator"] = fn


@contextmanager
def given(**functions: Callable) -> Iterator[None]:
    """Functions by name that hold within the block only."""
    before = dict(_FOUND)
    _FOUND.update(functions)
    try:
        yield
    finally:
        _FOUND.clear()
        _FOUND.update(before)


def _get(name: str) -> Callable:
    if name not in _FOUND:
        raise LookupError(f"register a {name} function first")
    return _FOUND[name]


def group_key(structure: Column, invalid: str = "INVALID_SMILES", none: str = "NO_SCAFFOLD") -> Column:
    """The registered key; null results and empty ones get the two names.  An audit passes empty names."""
    fn = _get("group_key")
    found = F.pandas_udf(fn, "string")(structure)
    return F.when(found.isNull(), invalid).when(found == "", none).otherwise(found)


def is_valid(structure: Column) -> Column:
    return F.pandas_udf(_get("validity"), "boolean")(structure)


def fingerprint(structure: Column) -> Column:
    return F.pandas_udf(_get("fingerprint"), "array<float>")(structure)


def generate(prompts: DataFrame) -> DataFrame:
    """(id, prediction_text) of (id, prompt), one batch stream a partition, so a model loads once for each."""
    return prompts.select("id", "prompt").mapInPandas(_get("generator"), "id string, prediction_text string")
