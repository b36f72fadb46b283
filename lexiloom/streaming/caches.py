"""Streaming twins of the causal-state operators: one state for each key, updated after it was used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


class LastSeen(StatefulProcessor):
    """For each event of a key: how many events of the key ago the same value was last seen, and the copy-state bin.

    State is one entry for each value of a key. Events of a micro-batch are put in order first; an event that comes
    after a later one was processed is answered by the order of arrival.
    """

    def __init__(self, key: str, order: str, value: str) -> None:
        self.key, self.order, self.value = key, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "clock long")
        self.clock = handle.getValueState("clock", "clock long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        clock = self.clock.get()[0] if self.clock.exists() else 0
        gaps = []
        for value in batch[self.value].astype(str):
            clock += 1
            gaps.append(clock - self.seen.getValue((value,))[0] if self.seen.containsKey((value,)) else None)
            self.seen.updateValue((value,), (clock,))
        self.clock.update((clock,))
        bins = ["new" if g is None or g > 40 else "lag1" if g == 1 else "lag2-5" if g <= 5 else "lag6-40" for g in gaps]
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "at": batch[self.order].astype("int64").to_numpy(), "gap": pd.array(gaps, dtype="Int64"), "state": bins})

    def close(self) -> None:
        pass


def last_seen(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at, gap, state) of a stream; the batch twin is sequence.copy_state over lag(clock)."""
    schema = StructType([StructField("key", StringType()), StructField("at", LongType()), StructField("gap", LongType()), StructField("state", StringType())])
    return stream.groupBy(key).transformWithStateInPandas(LastSeen(key, order, value), schema, "Append", "None")


class AdaptiveCache(StatefulProcessor):
    """Bits of each word's letters under the counts of the unit's earlier words: predict, then update with the whole word.

    With a horizon, the letters of words further back are taken out again.
    """

    def __init__(self, order: str, word: str, alphabet: int, mass: float, horizon: int | None) -> None:
        self.order, self.word, self.alphabet, self.mass, self.horizon = order, word, alphabet, mass, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "symbol string", "n long")
        self.total = handle.getValueState("total", "n long")
        self.window = handle.getListState("window", "word string")

    def _add(self, word: str, sign: int) -> None:
        for s in word + "$":
            n = self.counts.getValue((s,))[0] if self.counts.containsKey((s,)) else 0
            self.counts.updateValue((s,), (n + sign,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        import math

        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        total = self.total.get()[0] if self.total.exists() else 0
        window = [w[0] for w in self.window.get()] if self.horizon else []
        bits = []
        for word in batch[self.word]:
            b = 0.0
            for s in word + "$":
                n = self.counts.getValue((s,))[0] if self.counts.containsKey((s,)) else 0
                b -= math.log2((n + self.mass / self.alphabet) / (total + self.mass))
            bits.append(b)
            self._add(word, 1)
            total += len(word) + 1
            if self.horizon:
                window.append(word)
                if len(window) > self.horizon:
                    old = window.pop(0)
                    self._add(old, -1)
                    total -= len(old) + 1
        self.total.update((total,))
        if self.horizon:
            self.window.put([(w,) for w in window])
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "at": batch[self.order].astype("int64").to_numpy(), "bits": bits})

    def close(self) -> None:
        pass


def adaptive_cache(stream: DataFrame, key: str, order: str, word: str, alphabet: int, mass: float = 32.0, horizon: int | None = None) -> DataFrame:
    """(key, at, bits) of a stream of words; equals state.adaptive_cache for words in order with a uniform base."""
    schema = StructType([StructField("key", StringType()), StructField("at", LongType()), StructField("bits", DoubleType())])
    return stream.groupBy(key).transformWithStateInPandas(AdaptiveCache(order, word, alphabet, mass, horizon), schema, "Append", "None")


class ModularCounter(StatefulProcessor):
    """Counter modulo m that a reset value sets back to 0."""

    def __init__(self, order: str, value: str, modulus: int, reset: str) -> None:
        self.order, self.value, self.modulus, self.reset = order, value, modulus, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        n, out = self.n.get()[0] if self.n.exists() else 0, []
        for v in batch[self.value]:
            n = 0 if v == self.reset else (n + 1) % self.modulus
            out.append(n)
        self.n.update((n,))
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "at": batch[self.order].astype("int64").to_numpy(), "phase": pd.array(out, dtype="int32")})

    def close(self) -> None:
        pass


def modular_counter(stream: DataFrame, key: str, order: str, value: str, modulus: int, reset: str) -> DataFrame:
    schema = StructType([StructField("key", StringType()), StructField("at", LongType()), StructField("phase", IntegerType())])
    return stream.groupBy(key).transformWithStateInPandas(ModularCounter(order, value, modulus, reset), schema, "Append", "None")


def windowed_counts(stream: DataFrame, ts: str, by: list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window behind a watermark; timestamps without zone are read as the session's zone."""
    at = stream.withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", late)
    return at.groupBy(F.window("ts_", length, slide or length), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")
