"""Alert episodes as state with timers: candidates open and extend them, status events close them, time forgets them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: The state store that these operators need, a setting of the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "zone_id long, indicator string, episode long, what string, candidate_id long, at timestamp"


class Episodes(StatefulProcessor):
    """Open episodes of one zone and indicator: a map from their number to their first and last day."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "episode long", "first long, last long")
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["at", "kind", "number"], ignore_index=True)
        days = frame["at"].to_numpy().astype("datetime64[D]").astype(int).tolist()
        known = {int(k[0]): [int(v[0]), int(v[1])] for k, v in self.open.iterator()}
        made, before, out = int(self.made.get()[0]) if self.made.exists() else 0, set(known), []
        for day, at, kind, number in zip(days, frame["at"], frame["kind"], frame["number"], strict=True):
            if kind == 0:
                for e in sorted(e for e, (first, _) in known.items() if first <= day and (pd.isna(number) or e == number)):
                    del known[e]
                    out.append((e, "closed", None, at))
                continue
            near = [(last, e) for e, (first, last) in known.items() if first - self.days <= day <= last + self.days]
            if near:
                e = max(near)[1]
                known[e] = [min(known[e][0], day), max(known[e][1], day)]
            else:
                made = e = made + 1
                known[e] = [day, day]
            out.append((e, "observed", int(number), at))
        self.made.update((made,))
        for e in before - set(known):
            self.open.removeKey((e,))
        for e, span in known.items():
            self.open.updateValue((e,), tuple(span))
            self.handle.registerTimer((span[1] + self.days + 1) * DAY_MS)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        over = sorted((int(k[0]), int(v[1])) for k, v in self.open.iterator() if int(v[1]) + self.days < now)
        for e, _ in over:
            self.open.removeKey((e,))
        yield self._rows(key, [(e, "expired", None, pd.Timestamp((last + self.days + 1) * DAY_MS, unit="ms")) for e, last in over])

    def close(self) -> None:
        pass

    def _rows(self, key, out) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["episode", "what", "candidate_id", "at"])
        frame["candidate_id"] = frame["candidate_id"].astype("Int64")
        frame["at"] = pd.to_datetime(frame["at"])
        return frame.assign(zone_id=key[0], indicator=key[1])[["zone_id", "indicator", "episode", "what", "candidate_id", "at"]]


def tracked(candidates: DataFrame, status: DataFrame | None = None, *, days: int = 14, late: str = "30 days") -> DataFrame:
    """What happens to episodes (see OUTPUT): observed (a candidate and its episode), closed, expired.

    ``candidates`` is a stream of alertable ones (zone_id, indicator, candidate_id, observed_at); ``status`` one of events
    that close episodes (zone_id, indicator, at, and episode, null for all that are open). A candidate joins the open episode
    last observed of those within ``days`` days of it, which a late one extends backwards, else it opens one; after a
    closing event, or once the watermark, ``late`` behind the newest time, is more than ``days`` past an episode, it takes no
    more. Rows behind the watermark are dropped by Spark. At one time, closing events come before candidates. A timer for
    each last day forgets an episode, so state is what is open. The session needs PROVIDER.
    """
    seen = candidates.select(F.col("zone_id").cast("long").alias("zone_id"), "indicator", F.lit(1).alias("kind"), F.col("candidate_id").cast("long").alias("number"), F.col("observed_at").cast("timestamp").alias("at"))
    if status is not None:
        seen = seen.unionByName(status.select(F.col("zone_id").cast("long").alias("zone_id"), "indicator", F.lit(0).alias("kind"), F.col("episode").cast("long").alias("number"), F.col("at").cast("timestamp").alias("at")))
    grouped = seen.withWatermark("at", late).groupBy("zone_id", "indicator")
    return grouped.transformWithStateInPandas(Episodes(days), OUTPUT, "append", "eventtime")
