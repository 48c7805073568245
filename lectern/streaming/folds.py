"""State machines over ordered rows: rows are dealt by key and sorted, and a task walks through them batch by batch, so a
key's rows never gather in memory however many there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: step(state or None, row as dict) -> (state, output rows as tuples)
Step = Callable[[dict | None, dict], tuple[dict, list[tuple]]]


def fold(df: DataFrame, key: str, order: list[str], step: Step, schema: str, finish: Callable[[object, dict], list[tuple]] | None = None) -> DataFrame:
    """Rows that `step` makes while it walks through each key's rows in `order`; `finish(key, state)` makes a key's last ones."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for frame in frames:
            out: list[tuple] = []
            for row in frame.to_dict("records"):
                if not begun or row[key] != now:
                    if begun and finish:
                        out += finish(now, state)
                    now, state, begun = row[key], None, True
                state, made = step(state, row)
                out += made
            yield pd.DataFrame(out, columns=names)
        if begun and finish:
            yield pd.DataFrame(finish(now, state), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
