"""Absences as keyed state: claims that none of the last N successful runs of their source has mentioned.

State is keyed by source and bucket of the claim id, so that a source with very many claims is spread. Each key holds the
days of the last N runs, the day on which each of its claims was last mentioned, and the claims of each such day. A mention
moves its claim; a run moves the day before which claims are unmentioned, and only the claims of the days passed over are
looked at. Nothing reads earlier events. Events may come in any order: days decide, not arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import ship_code

RETIRED = "source_id long, id string, last_seen_at date, cutoff date"


class Absences(StatefulProcessor):
    """Input: (source_id, bucket, id, day, retire_after) rows; a row with an id is a mention, one without a run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "days array<int>")
        self.seen = handle.getMapState("seen", "id string", "day int")
        self.of_day = handle.getMapState("of_day", "day int", "ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        source, _ = key
        days, last, moved = list(self.runs.get()[0]) if self.runs.exists() else [], 1, {}
        for part in rows:
            last = int(part["retire_after"].iloc[0])
            runs = part["id"].isna()
            days = sorted([*days, *part.loc[runs, "day"].tolist()])[-last:]
            for name, day in part.loc[~runs].groupby("id")["day"].max().items():
                moved[name] = max(int(day), moved.get(name, int(day)))
        self.runs.update(([int(d) for d in days],))
        added: dict[int, list[str]] = {}
        for name, day in moved.items():
            if not self.seen.containsKey((name,)) or self.seen.getValue((name,))[0] < day:
                self.seen.updateValue((name,), (day,))
                added.setdefault(day, []).append(name)
        for day, names in added.items():
            old = list(self.of_day.getValue((day,))[0]) if self.of_day.containsKey((day,)) else []
            self.of_day.updateValue((day,), (old + names,))
        if len(days) < last:
            return
        out, passed = [], [d[0] for d in self.of_day.keys() if d[0] < days[0]]
        for day in passed:
            for name in dict.fromkeys(self.of_day.getValue((day,))[0]):
                if self.seen.containsKey((name,)) and self.seen.getValue((name,))[0] == day:
                    out.append((source, name, day, days[0]))
                    self.seen.removeKey((name,))
            self.of_day.removeKey((day,))
        if out:
            frame = pd.DataFrame(out, columns=["source_id", "id", "last_seen_at", "cutoff"])
            for c in ("last_seen_at", "cutoff"):
                frame[c] = pd.to_datetime(frame[c], unit="D").dt.date
            yield frame

    def close(self) -> None:
        pass


def unmentioned(events: DataFrame, sources: DataFrame, buckets: int = 64) -> DataFrame:
    """(source_id, id, last_seen_at, cutoff): a stream of claims as they become unmentioned, each once until it is
    mentioned again.

    events: (source_id, started_at, ok, id) as a stream; a row with an id mentions that claim on its day, one without is a
    run, which counts if it succeeded. sources: (source_id, retire_after); a source without the number never retires. Needs
    the RocksDB state store.
    """
    ship_code(events.sparkSession)
    asked = sources.filter("retire_after is not null").select("source_id", "retire_after")
    told = events.filter("id is not null or ok").join(asked, "source_id")
    own, every = F.array(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")), F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = told.select("source_id", F.explode(F.when(F.col("id").isNull(), every).otherwise(own)).alias("bucket"), "id", F.unix_date("started_at").alias("day"), "retire_after")
    return dealt.groupBy("source_id", "bucket").transformWithStateInPandas(Absences(), RETIRED, "Append", "None")
