"""Job events as a stream: latest state, filtered chunks, idle jobs.

The reference keeps no history for absent listeners; here the log is replayable, and who comes late reads the
terminal state from the stored table (`terminal_events`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROGRESS = "doc_id string, segment_id string, done int, total int, page int, num_pages int, source_preview string, translated_preview string, emitted_at timestamp, arrived_at timestamp"
CHUNKS = "stream_id string, seq int, chunk string"  # seq counts from 0 in each stream; a null chunk ends it
TERMINAL = ("done", "error", "cancelled")


def read_events(spark: SparkSession, folder: str, schema: str = PROGRESS, fmt: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """Files of a folder as a stream; `per_trigger` bounds the files of one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)


def latest(events: DataFrame) -> DataFrame:
    """The furthest event of each job; works on tables and, in update or complete mode, on streams."""
    e = events.groupBy("doc_id").agg(F.max_by(F.struct("segment_id", "total", "page"), "done").alias("x"), F.max("done").alias("done"))
    return e.select("doc_id", "x.segment_id", "done", "x.total", "x.page")


def delays(events: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Events and their mean delay by hour of emission; rows later than `late` are dropped by the watermark."""
    e = events.withColumn("delay_s", F.col("arrived_at").cast("double") - F.col("emitted_at").cast("double"))
    return e.withWatermark("emitted_at", late).groupBy(F.window("emitted_at", window)).agg(F.count(F.lit(1)).alias("n"), F.avg("delay_s").alias("mean_delay_s"))


class ThinkFilter:
    """Drops <think> blocks from chunks, even when a tag is split over chunks; an unclosed block swallows the rest."""

    OPEN, CLOSE = "<think>", "</think>"

    def __init__(self, inside: bool = False, held: str = "") -> None:
        self.inside, self.held = inside, held

    def feed(self, chunk: str) -> str:
        text, out = self.held + (chunk or ""), ""
        self.held = ""
        while text:
            tag = self.CLOSE if self.inside else self.OPEN
            at = text.find(tag)
            if at >= 0:
                out += "" if self.inside else text[:at]
                text, self.inside = text[at + len(tag) :], not self.inside
                continue
            keep = next((k for k in range(min(len(tag) - 1, len(text)), 0, -1) if text.endswith(tag[:k])), 0)
            out += "" if self.inside else text[: len(text) - keep]
            self.held = text[len(text) - keep :] if keep else ""
            break
        return out

    def flush(self) -> str:
        rest, self.held = ("" if self.inside else self.held), ""
        return rest


def filter_chunks(chunks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Visible text of each stream's chunks in order of their seq, from 0: stream_id, seq, visible.

    A chunk that arrives before its turn waits in the state. A null chunk ends the stream: what was held as the start
    of a tag is shown, and the state is dropped. A stream idle for `idle_ms` is ended too, gaps in it are passed over.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, held, nxt, seqs, texts = state.get if state.exists else (False, "", 0, [], [])
        f, waiting = ThinkFilter(inside, held), dict(zip(seqs, texts, strict=True))
        over = state.hasTimedOut
        for frame in () if over else frames:
            waiting.update({int(r.seq): r.chunk for r in frame.itertuples(index=False) if r.seq >= nxt})
        shown = []
        while waiting and (nxt in waiting or over):
            nxt = nxt if nxt in waiting else min(waiting)
            chunk = waiting.pop(nxt)
            ended = chunk is None
            shown.append((key[0], nxt, f.flush() if ended else f.feed(chunk)))
            nxt += 1
            if ended:
                over = True
                break
        if over:
            shown.append((key[0], nxt, f.flush()))
            state.remove()
        else:
            state.update((f.inside, f.held, nxt, list(waiting), list(waiting.values())))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([s for s in shown if s[2]], columns=["stream_id", "seq", "visible"])

    kept = "inside boolean, held string, next int, seqs array<int>, texts array<string>"
    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq int, visible string", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_pings(events: DataFrame, idle_ms: int = 15_000) -> DataFrame:
    """A ping for each job without events for `idle_ms`."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0] + 1
            state.update((n,))
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"doc_id": [key[0]], "ping": [n]})
            return
        for _ in frames:
            pass
        state.update((state.get[0] if state.exists else 0,))
        state.setTimeoutDuration(idle_ms)

    return events.groupBy("doc_id").applyInPandasWithState(run, "doc_id string, ping int", "n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def terminal_events(jobs: DataFrame) -> DataFrame:
    """What a late listener gets: the terminal event of a job from its stored status; a cancelled one ends as an error."""
    t = jobs.where(F.col("status").isin(*TERMINAL))
    return t.select("doc_id", F.when(F.col("status") == "done", "done").otherwise("error").alias("event"), F.to_json(F.struct("status", "error")).alias("data"))


def write_latest(events: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Writes the jobs that changed in each batch to `target`, a folder for each batch; a repeated batch replaces its own.

    Only changed jobs are written, never the state of all; `read_latest` gives the latest of each job.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    w = latest(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of every job from the batches of `write_latest`."""
    return latest(spark.read.parquet(target))
