"""Batches of rows through an extraction function: retries, a time limit, a quality gate.

A batch is an Arrow pass. Task slots take the place of a semaphore: `concurrency` partitions run
at most that many rows at a time. Failures and rejected rows come back as rows with a status, so
what callbacks would have got are filters of the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.scoring import FINAL_ERRORS, RETRIES, RETRY_BASE, RETRY_MOST
from loomwright.session import ship

RESULT = "status string, attempts int, title string, content string, score double, error string"


def retryable(message: str) -> bool:
    return not any(w in message.lower() for w in FINAL_ERRORS)


def waits(retries: int = RETRIES, base: int = RETRY_BASE, factor: float = 2, most: int = RETRY_MOST) -> list[float]:
    """Milliseconds before each further attempt."""
    return [min(base * factor**k, most) for k in range(retries)]


def with_retry(fn: Callable, delays: list[float], condition: Callable[[str], bool] = retryable, sleep: Callable[[float], None] = time.sleep):
    """(result, attempts), or the last error after the delays (ms) are used up or the condition says no."""
    for attempt, delay in enumerate([*delays, None], 1):
        try:
            return fn(), attempt
        except Exception as e:
            e.attempts = attempt
            if delay is None or not condition(str(e)):
                raise
            sleep(delay / 1000)


class TokenBucket:
    """At most `burst` at once and `rate` a second after that."""

    def __init__(self, rate: float = 2.0, burst: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def adapted(latencies: list[float], start: int = 3, least: int = 1, most: int = 10, target: float = 2000) -> list[int]:
    """The concurrency of each chunk from the chunks' mean latencies (ms): one less after a slow
    chunk, one more after one under 70 % of the target."""
    out, now = [], start
    for ms in latencies:
        out.append(now)
        now = max(least, now - 1) if ms > target else min(most, now + 1) if ms < 0.7 * target else now
    return out


def extract_batch(rows: DataFrame, extract: Callable[[dict], dict], gate: float = 0.7, concurrency: int | None = None, timeout: float | None = None,
                  retries: int = RETRIES, base: int = RETRY_BASE, condition: Callable[[str], bool] = retryable) -> DataFrame:
    """rows with status (ok, filtered, failed), attempts, title, content, score, error.

    extract: a function of a row that returns title, content and score, or raises. A row under the
    gate is filtered and has no content. timeout: seconds for one attempt. concurrency: partitions
    that the rows are dealt to; None leaves them as they are."""
    ship(rows.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + RESULT
    delays = waits(retries, base)

    def run(batches):
        pool = ThreadPoolExecutor(1) if timeout else None
        for b in batches:
            out = []
            for row in b.to_pylist():
                call = (lambda row=row: pool.submit(extract, row).result(timeout)) if pool else (lambda row=row: extract(row))
                try:
                    got, n = with_retry(call, delays, condition)
                    ok = got["score"] >= gate
                    out.append(("ok" if ok else "filtered", n, got.get("title"), got.get("content") if ok else None, got["score"], None if ok else f"Content quality too low: {got['score']:.2f} < {gate}"))
                except Exception as e:
                    out.append(("failed", getattr(e, "attempts", 1), None, None, None, "timeout" if isinstance(e, Late) else str(e)))
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "status", "attempts", "title", "content", "score", "error"])

    return (rows if concurrency is None else rows.repartition(concurrency)).mapInArrow(run, schema)


def summary(results: DataFrame) -> DataFrame:
    """One row: total, successful, failed, mean_quality (0 without a success)."""
    ok = F.col("status") == "ok"
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("mean_quality"))
