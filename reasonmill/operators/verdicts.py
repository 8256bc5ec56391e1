"""Verdict requests in batches that can be resumed: equal requests are asked once, answered ones not again.

A request is known by the hash of its kind and text, whatever sample, run or dataset it comes from. Answers are a table
``(request_id, response)`` that only grows; asking again takes what it does not hold yet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.operators.ordering import with_position
from reasonmill.plans.stage import staged


def keyed(requests: DataFrame) -> DataFrame:
    """Requests with their ``request_id``; pairs with an automatic verdict have none."""
    return requests.withColumn("request_id", F.when(F.col("request").isNotNull(), F.sha2(F.concat_ws("\n", "kind", "request"), 256)))


def open_requests(requests: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(request_id, kind, request, n_pairs) of every different request without an answer. Equal requests collapse before
    they are shuffled, so one that a third of all pairs share is no hot key."""
    asked = keyed(requests).where("request_id is not null")
    each = asked.groupBy("request_id").agg(
        F.min("kind").alias("kind"), F.min("request").alias("request"), F.count("*").alias("n_pairs")
    )
    return each if answers is None else each.join(answers.select("request_id").distinct(), "request_id", "left_anti")


def batches(requests: DataFrame, answers: DataFrame | None = None, size: int = 256) -> DataFrame:
    """What is open, in batches of ``size`` by order of id: (batch, request_id, kind, request, n_pairs).

    Only ids are sorted and counted; texts meet their batch by id.
    """
    todo = staged(open_requests(requests, answers), "open-requests")
    placed = with_position(todo.select("request_id"), ["request_id"], "_pos")
    numbered = placed.select("request_id", F.expr(f"_pos div {size}").alias("batch"))
    return numbered.join(todo, "request_id").select("batch", "request_id", "kind", "request", "n_pairs")


def responses(requests: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answers back at their pairs: (keys, kind, i, j, response), the form that matching takes. Of several answers of a
    request the least text counts."""
    pairs = keyed(requests).where("request_id is not null").select(*keys, "kind", "i", "j", "request_id")
    one = answers.groupBy("request_id").agg(F.min("response").alias("response"))
    return pairs.join(one, "request_id").select(*keys, "kind", "i", "j", "response")
