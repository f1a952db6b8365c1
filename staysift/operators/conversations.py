"""Conversation tables: opening turns, routing by the last turn, prompts per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staysift.operators.aggregates import json_records


def prepend_system_turn(turns: DataFrame, prompt: str | None) -> DataFrame:
    """One extra first turn per conversation; the table unchanged when there is no prompt."""
    if not prompt:
        return turns
    opening = turns.groupBy("conv_id").agg((F.min("turn") - 1).alias("turn"))
    opening = opening.withColumns({"role": F.lit("system"), "text": F.lit(prompt)})
    return turns.unionByName(opening.select(*turns.columns))


def route_by_last_turn(turns: DataFrame, asks_tool: Column) -> DataFrame:
    """Per conversation the newest turn and ``continue`` or ``end``.

    ``asks_tool`` is a predicate over one turn. The newest turn is kept by a partial aggregate,
    so a long conversation is reduced inside every task.
    """
    row = F.struct("turn", "role", asks_tool.alias("asks_tool"))
    newest = turns.groupBy("conv_id").agg(F.max_by(row, "turn").alias("last"))
    return newest.select(
        "conv_id",
        F.col("last.turn").alias("last_turn"),
        F.col("last.role").alias("last_role"),
        F.when(F.col("last.asks_tool"), "continue").otherwise("end").alias("route"),
    )


def prompt_per_group(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    columns: Sequence[str],
    template: str,
    page_rows: int,
) -> DataFrame:
    """``template`` with its one ``%s`` filled by JSON records: one prompt per page of a group.

    A page holds at most ``page_rows`` rows, so all rows of a group are in its prompts.
    """
    context = json_records(df, group, order, columns, page_rows)
    return context.select(group, "page_no", F.format_string(template, "records").alias("prompt"))
