"""The session state of the incremental compression (T4).

``transformWithState`` keeps one row for every session: its pieces as
``Segments`` (bounded by the byte cap and their number), the last batch merged,
whether a batch came that could not be placed, and the newest time.
"""

from __future__ import annotations

import json

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from logsift.operators.pieces import Segments

OUT = ("session_id string, placed boolean, seq long, last_at long, n_debug long, n_content long, n_runs long, "
       "texts array<string>, counts array<long>")
STATE = StructType([StructField("segments", StringType()), StructField("last_batch", LongType()), StructField("placed", BooleanType()),
                    StructField("newest", LongType())])


def merge_processor(max_bytes: int, segments: int):
    """A processor that merges the pieces of each trigger into the session's state and gives the whole piece.

    It works on plain rows and asks for a state once to read and once to write it, since what a session costs
    is mostly these calls (a pandas frame for each session took several times that)."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    out_row = Row(*(c.split()[0] for c in OUT.split(", ")))

    def plain(row) -> dict:
        out = {k: row[k] for k in ("n_debug", "n_content", "n_runs", "first_key", "last_key", "last_at")}
        out |= {k: [row[f"{k}1"], row[f"{k}2"]] for k in ("lo", "hi")}
        return out | {k: list(row[k]) for k in ("texts", "counts", "sizes")}

    class MergePieces(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("session", STATE)

        def handleInputRows(self, key, rows, timerValues):
            kept = self.state.get() or ("[]", -1, True, None)
            state, (last, placed, newest) = Segments(json.loads(kept[0]), max_bytes, segments), kept[1:]
            new = sorted((r["seq"], n, plain(r)) for n, r in enumerate(rows) if r["seq"] > last)  # a replayed batch was merged before
            for _, _, piece in new:
                placed = placed and state.add(piece)
                newest = max((t for t in (newest, piece["last_at"]) if t is not None), default=None)
            if new:
                last = new[-1][0]
                self.state.update((json.dumps(state.pieces), last, placed, newest))
                whole = state.whole()
                yield out_row(key[0], placed, last, newest, *(whole[c] for c in ("n_debug", "n_content", "n_runs", "texts", "counts")))

        def close(self) -> None:
            pass

    return MergePieces()
