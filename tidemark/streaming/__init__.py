"""Online change scores: the sliding divergence over a stream of feature vectors.

State per series is the last ``2 * half`` vectors.  A score is emitted for the middle
of every full frame, as the batch operator would give it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.divergence import frame_divergence


def online_divergence(stream: DataFrame, key: str = "subject_id", half: int = 25, alpha: float = 0.5) -> DataFrame:
    """key, w and d for a stream of (key string, w long, x array<double>) whose vectors arrive in order, each once, within a series."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first = (state.get[0], state.get[1]) if state.exists else ([], 0)
        held = [list(x) for x in held]
        new = pd.concat(list(batches)).sort_values("w")
        out = []
        for w, x in zip(new["w"], new["x"], strict=True):
            if not held:
                first = int(w)
            held.append([float(v) for v in x])
            if len(held) > 2 * half:
                held, first = held[1:], first + 1
            if len(held) == 2 * half:
                out.append((name[0], first + half, frame_divergence(np.array(held), half, alpha)))
        state.update((held, first))
        yield pd.DataFrame(out, columns=[key, "w", "d"])

    return stream.select(key, "w", "x").groupBy(key).applyInPandasWithState(run, f"{key} string, w long, d double", "held array<array<double>>, first long", "append", GroupStateTimeout.NoTimeout)
