"""Which content a session has had before: state per session, with a limit on what is known and on silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeglass.operators.report import KNOWN_IDS, SESSION_MINUTES

OUTPUT = "session string, content_id string, ts timestamp, representation string"


def remember(known: list[str], content: str, most: int = KNOWN_IDS) -> tuple[str, list[str]]:
    """Whether content is known (reference) or not (full), and what is known then; the oldest go first."""
    if content in known:
        return "reference", known
    return "full", [*known, content][-most:]


def session_references_stream(answers: DataFrame, *, minutes: int = SESSION_MINUTES, most: int = KNOWN_IDS, late: str = "1 minute") -> DataFrame:
    """The answers (session, content_id, ts) of a stream with their representation.

    A session forgets all when it is silent for `minutes`, and the oldest when it knows more than `most`. Within a
    micro-batch answers are taken in order of time. The state of silent sessions goes when the watermark passes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(batches)).sort_values(["ts", "content_id"])
        out = []
        for content, ts in zip(rows["content_id"], rows["ts"]):
            if last is not None and ts.timestamp() - last >= minutes * 60:
                known = []
            what, known = remember(known, content, most)
            last = ts.timestamp()
            out.append((key[0], content, ts, what))
        state.update((known, last))
        state.setTimeoutTimestamp(max(int((last + minutes * 60) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "content_id", "ts", "representation"])

    return answers.select("session", "content_id", "ts").withWatermark("ts", late).groupBy("session").applyInPandasWithState(step, OUTPUT, "known array<string>, last double", "append", GroupStateTimeout.EventTimeTimeout)
