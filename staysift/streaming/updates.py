"""Update events (node name to messages) flattened to message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def flatten_updates(events: DataFrame, key: str, updates: str = "updates") -> DataFrame:
    """``key, node_no, node, message_no`` and the message fields, in order.

    ``updates`` maps a node name to a struct with an array ``messages``; a missing array gives no
    rows. Two narrow steps, so the same code serves batch and streaming frames.
    """
    nodes = events.select(key, F.posexplode(F.map_entries(updates)).alias("node_no", "_entry"))
    messages = nodes.select(
        key,
        "node_no",
        F.col("_entry.key").alias("node"),
        F.posexplode("_entry.value.messages").alias("message_no", "_message"),
    )
    return messages.select(key, "node_no", "node", "message_no", "_message.*")
