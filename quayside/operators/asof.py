"""Point-in-time sums: what was known about a key at the moment a request came in.

History and requests are put on one time line per key, and running sums along it give every request the sums of what came before it. A look-back
is the difference of two places on the line. Each history row is read once however many requests look at it, no interval is joined, and
a key with a third of all rows is cut into time buckets (``ordered.running``).
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.ordered import hour_bucket, running


def known_before(requests: DataFrame, history: DataFrame, keys: Sequence[str], values: Mapping[str, Column], days: int | None = None,
                 id_col: str = "batch_id", at: str = "submitted_at", known: str = "decided_at") -> DataFrame:
    """(id, value sums): for each request the sums over the history rows of its key that were known before it, in the last ``days`` if given.

    A row known at the very moment of the request does not count; one known exactly ``days`` before does. Requests without a key, or of
    one without history, are left out; rows without a time count nowhere. Ids of requests must be unique."""
    names = list(values)
    none = [F.lit(0).cast("bigint").alias(n) for n in names]
    line = [F.col(known).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(requests.schema[id_col].dataType).alias("id"), F.lit(0).alias("sign")]
    rows = [history.select(*keys, *line, *[v.cast("bigint").alias(n) for n, v in values.items()])]
    moments = [(F.col(at), 1)] if days is None else [(F.col(at), 1), (F.col(at) - F.expr(f"INTERVAL {int(days)} DAYS"), -1)]
    rows += [requests.select(*keys, t.alias("t"), F.lit(0).alias("kind"), F.col(id_col).alias("id"), F.lit(sign).alias("sign"), *none) for t, sign in moments]
    every = functools.reduce(DataFrame.unionByName, rows).where(F.col("t").isNotNull())
    before = running(every, keys, [F.col("t"), F.col("kind"), F.col("id")], hour_bucket(F.col("t")), {f"sum_{n}": ("sum", F.col(n)) for n in names}, include_current=False)
    asked = before.where("kind = 0")
    return asked.groupBy(F.col("id").alias(id_col)).agg(*[F.sum(F.col("sign") * F.col(f"sum_{n}")).alias(n) for n in names])


def rates_at_arrival(requests: DataFrame, history: DataFrame, carrier_days: int = 30) -> DataFrame:
    """Requests with the rates of their importer, carrier (last days only) and tariff chapter, and the importer's mean corrections, as known when they came in.

    Without a decided case they are zero; the counts tell."""
    one, bad = F.lit(1), F.coalesce("rejected", F.lit(False)).cast("int")
    importer = known_before(requests, history, ["company_id"], {"importer_submissions": one, "importer_bad": bad, "importer_fixes": F.coalesce("corrections", F.lit(0))})
    carrier = known_before(requests, history, ["carrier"], {"carrier_decisions": one, "carrier_bad": bad}, carrier_days)
    chapter = known_before(requests, history, ["chapter"], {"chapter_decisions": one, "chapter_bad": bad})
    found = requests.join(importer, "batch_id", "left").join(carrier, "batch_id", "left").join(chapter, "batch_id", "left")

    def rate(bad_: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(bad_), F.col(of)), F.lit(0.0))

    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("importer_submissions", "carrier_decisions", "chapter_decisions")]
    return found.select(
        *requests.columns, *counts, rate("importer_bad", "importer_submissions").alias("importer_rejection_rate"), rate("carrier_bad", "carrier_decisions").alias("carrier_rejection_rate"),
        rate("chapter_bad", "chapter_decisions").alias("chapter_rejection_rate"), F.coalesce(F.try_divide("importer_fixes", "importer_submissions"), F.lit(0.0)).alias("mean_corrections"),
    )
