"""State carried along ordered rows, for recurrences that window functions cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

# step(state, row) -> (state, outputs); ``state`` is None at the first row of a key.
Step = Callable[[object, tuple], tuple[object, tuple]]


def fold_ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], step: Step, outputs: str
) -> DataFrame:
    """Append the ``outputs`` that ``step`` yields for every row, key by key in order.

    Keys are hashed to tasks and sorted there; rows stream through in Arrow batches, so a long key
    costs time in one task but never memory.  A null or NaN key is a key like any other.
    """
    keys, inputs = list(keys), list(inputs)
    names = [part.strip().split()[0] for part in outputs.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + outputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            produced = []
            for key, row in zip(
                zip(*[batch[k] for k in keys]), zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in inputs])
            ):
                key = tuple(None if pd.isna(part) else part for part in key)
                if key != current:
                    current, state = key, None
                state, values = step(state, row)
                produced.append(values)
            extra = pd.DataFrame(produced, columns=names, index=batch.index, dtype=object)
            yield pd.concat([batch, extra], axis=1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
