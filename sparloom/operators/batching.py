"""Training batches from conversations: token ids, loss masks that cover the answer alone, padded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.lineage import numbered

#: The label of a token that takes no part in the loss.
IGNORED = -100


def render_turns(messages: Column) -> Column:
    """``ROLE: content`` by blank lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def render_prompt(messages: Column) -> Column:
    """All turns but the last, and the cue for an answer."""
    before = F.when(F.size(messages) > 1, F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))))
    return F.when(before.isNull(), "ASSISTANT:").otherwise(F.concat(render_turns(before), F.lit("\n\nASSISTANT:")))


def masked(records: DataFrame, tokens: Callable[[Column], Column], max_length: int, messages: str = "messages") -> DataFrame:
    """Adds ``input_ids``, ``attention_mask`` and ``labels`` (arrays of int): the tokens of the whole conversation, cut at
    ``max_length``, ones, and the tokens again with ``IGNORED`` for as many as the prompt has.

    ``tokens`` makes an array of int of a text column.  Null and empty conversations have empty arrays; a prompt that
    fills ``max_length`` leaves no token to learn.
    """
    turns = F.coalesce(F.col(messages), F.array().cast(records.schema[messages].dataType))
    empty = F.array().cast("array<int>")
    whole = F.when(F.size(turns) > 0, F.slice(tokens(render_turns(turns)), 1, max_length)).otherwise(empty)
    out = records.withColumns({"input_ids": whole, "labels": F.size(F.slice(tokens(render_prompt(turns)), 1, max_length))})
    n, of_prompt = F.size("input_ids"), F.col("labels")
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.least(of_prompt, n)), F.slice("input_ids", F.least(of_prompt, n) + 1, F.greatest(n - of_prompt, F.lit(0))))
    return out.withColumns({"attention_mask": F.array_repeat(F.lit(1), n), "labels": labels})


def padded_batches(rows: DataFrame, id_col: str, size: int, seed: Column, bucket: int = 64, pad_id: int = 0) -> DataFrame:
    """Adds ``batch`` and ``place`` (from 0) and fills the three arrays of ``masked`` up to the longest of their batch:
    with ``pad_id``, 0 and ``IGNORED``.

    Rows go in order of their length in steps of ``bucket`` tokens, then of ``seed``, then of the id, so a batch has rows
    of about one length and few fillings.  The last batch may have fewer rows.  An empty table gives none.
    """
    length = F.size("input_ids")
    placed = numbered(rows.withColumns({"_steps": F.ceil(length / bucket), "_seed": seed}), [F.col("_steps"), F.col("_seed"), F.col(id_col)], "_n").drop("_steps", "_seed")
    placed = placed.withColumns({"batch": F.floor(F.col("_n") / size).cast("long"), "place": (F.col("_n") % size).cast("int")}).drop("_n")
    longest = placed.groupBy("batch").agg(F.max(length).alias("_longest"))
    wide = placed.join(longest, "batch")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_longest") - F.size(c)))
    return wide.withColumns({c: fill(F.col(c), v) for c, v in (("input_ids", pad_id), ("attention_mask", 0), ("labels", IGNORED))}).select("batch", "place", *[c for c in rows.columns])
