"""Live continuity as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlog.operators.validate import LAG_MESSAGE
from driftlog.schemas import MAX_SAFE_INTEGER

_OUTPUT = "stream_id string, arrival bigint, seq bigint, outcome string, notice string, detail string"
_STATE = "last_seq bigint, last_session string, broken boolean"


class ContinuityProcessor(StatefulProcessor):
    """Accept arrivals until the first violation of a stream, then block.

    Rows of one call are not in arrival order, so they are sorted by their
    arrival number and never by seq, which would hide the gap to be reported.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("continuity", _STATE)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("arrival")
        seq, session, broken = (
            self.state.get() if self.state.exists() else (None, None, False)
        )
        out = []
        for row in batch.itertuples(index=False):
            number = None if pd.isna(row.seq) else int(row.seq)
            notice = detail = None
            if broken:
                outcome = "blocked"
            else:
                notice, detail = self._violation(row, number, seq, session)
                broken = notice is not None
                outcome = "notice" if broken else "accepted"
                if not broken:
                    seq, session = number, row.session_id
            out.append((key[0], int(row.arrival), number, outcome, notice, detail))
        self.state.update((seq, session, broken))
        result = pd.DataFrame(out, columns=[c.split()[0] for c in _OUTPUT.split(", ")])
        result["seq"] = result["seq"].astype("Int64")
        yield result

    @staticmethod
    def _violation(row, number, last_seq, last_session):
        if row.lag is not None and not pd.isna(row.lag):
            return "sse_overflow", row.lag or LAG_MESSAGE
        if number is None or not 0 <= number <= MAX_SAFE_INTEGER or not row.session_id:
            return "sequence_gap", "Invalid live event envelope"
        if last_session is not None and row.session_id != last_session:
            return "sequence_gap", f"Session changed from {last_session} to {row.session_id}"
        if last_seq is not None and number != last_seq + 1:
            return "sequence_gap", f"Expected sequence {last_seq + 1}, received {number}"
        return None, None

    def close(self) -> None:
        pass


def live_continuity_stream(arrivals: DataFrame) -> DataFrame:
    """Streaming form of ``operators.validate.live_continuity``; needs the
    RocksDB state store."""
    slim = arrivals.select("stream_id", "arrival", "seq", "session_id", "lag")
    return slim.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=ContinuityProcessor(),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
