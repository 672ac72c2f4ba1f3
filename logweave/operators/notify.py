"""Alerts to logged-in users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import fits_broadcast, lookup_join


def addressees(alerts: DataFrame, users: str = "users", max_users: int | None = None) -> DataFrame:
    """One row per alert and name it is for, which takes the place of the list ``users``.

    A name comes once per alert; ``*`` stays for everyone where it is the whole list.
    """
    names = F.transform(F.split(F.col(users), "[, ]+"), F.trim)
    names = F.filter(names, lambda u: u != "")
    if max_users is not None:
        names = F.slice(names, 1, max_users)
    return (alerts.withColumn("_n", F.array_distinct(names))
            .withColumn(users, F.explode(F.when(F.col(users) == "*", F.array(F.lit("*")))
                                         .otherwise(F.filter("_n", lambda u: u != "*"))))
            .drop("_n"))


def notify_fanout(alerts: DataFrame, sessions: DataFrame, users: str = "users",
                  max_users: int | None = None, max_rows: int = 1_000_000) -> DataFrame:
    """One row per alert and terminal it is shown on.

    ``users`` is a comma-separated list, or ``*`` for everyone. Terminals whose
    name starts with ``ftp`` or ``uucp`` are skipped, and a user named twice is
    told once. ``max_users`` keeps the first so many names of a list (a daemon
    limit of 20); by default there is none.

    The smaller side is broadcast when it was measured to be within ``max_rows``: the
    sessions, otherwise the alerts to everyone and those to names, each by itself.
    """
    asked = addressees(alerts.withColumn("_to", F.col(users)), "_to", max_users)
    # every session answers to its user and to everyone, so one equality join does
    open_ = (sessions.filter(~F.col("terminal").rlike("^(ftp|uucp)"))
             .withColumn("_to", F.explode(F.array(F.col("user"), F.lit("*")))))
    if fits_broadcast(open_, max_rows):
        return asked.join(F.broadcast(open_), "_to").drop("_to")

    def told(who) -> DataFrame:
        few, there = asked.filter(who), open_.filter(who)
        if fits_broadcast(few, max_rows):
            return F.broadcast(few).join(there, "_to").drop("_to")
        return lookup_join(few, there, ["_to"], "inner", max_rows=max_rows).drop("_to")

    return told(F.col("_to") == "*").union(told(F.col("_to") != "*"))
