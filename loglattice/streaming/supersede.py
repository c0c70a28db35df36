"""The best row of each key on a stream, as the folds of ``operators.fold`` give it on a table: a better row that comes late supersedes.

State is one row a key. What is given out is a stream of corrections: ``version`` counts how often a key has been told, so a reader
takes each key's last version, whatever order rows came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

#: Sessions that stream with state need this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Best(StatefulProcessor):
    """Keeps the row with the largest score of a key, and tells it whenever it changes."""

    def __init__(self, names: list[str], keys: list[str], rest: StructType, score: list[str]):
        self.names, self.keys, self.rest, self.score = names, keys, rest, [rest.names.index(c) for c in score]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", StructType([*self.rest.fields, StructField("version", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        row, version = (tuple(held[:-1]), int(held[-1])) if held is not None else (None, 0)
        changed = False
        for pdf in rows:
            for new in self._rows(pdf):
                if row is None or self._of(new) > self._of(row):
                    row, changed = new, True
        if changed:
            self.best.update((*row, version + 1))
            yield pd.DataFrame([[*key, *row, version + 1]], columns=[*self.keys, *self.rest.names, "version"])

    def _rows(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """The rows as they were: pandas reads whole numbers with gaps as floats, and computed columns come without their names."""
        pdf = pdf.set_axis(self.names, axis=1)[self.rest.names]
        columns = []
        for f in self.rest.fields:
            whole = isinstance(f.dataType, IntegralType)
            columns.append([None if gone else int(v) if whole else v for v, gone in zip(pdf[f.name], pdf[f.name].isna(), strict=True)])
        yield from zip(*columns, strict=True)

    def _of(self, row: tuple) -> tuple:
        """Scores in order; a missing one is below all others, as in SQL's order of structs."""
        return tuple((row[k] is not None, row[k]) if row[k] is not None else (False,) for k in self.score)

    def close(self) -> None:
        pass


def superseding(rows: DataFrame, keys: list[str], score: list[str]) -> DataFrame:
    """Corrections of a stream (or a table): keys, the other columns and ``version``."""
    rest = StructType([f for f in rows.schema.fields if f.name not in keys])
    out = StructType([*(rows.schema[k] for k in keys), *(StructField(f.name, f.dataType) for f in rest.fields), StructField("version", LongType())])
    return rows.groupBy(*keys).transformWithStateInPandas(Best(rows.columns, keys, rest, score), out, "Update", "None")


def current(corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Each key as it was told last."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return corrections.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "version")
