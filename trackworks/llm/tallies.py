"""Counts by key that a task keeps as an Arrow table, so that it hands out each key about once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that a task keeps before they are merged; more different keys than half of it are handed out at once.
MOST_ROWS = 500_000


class Tally:
    """Tables of the same columns, whose `counts` are summed by all others.

    What `add` and `rest` yield has each key once since the last time; memory stays near `most` rows.
    """

    def __init__(self, counts: list[str], most: int = MOST_ROWS) -> None:
        self.counts, self.most, self.tables, self.rows = counts, most, [], 0

    def _merged(self) -> pa.Table:
        t = pa.concat_tables(self.tables)
        keys = [n for n in t.column_names if n not in self.counts]
        s = t.group_by(keys).aggregate([(c, "sum") for c in self.counts])
        return pa.table([s.column(n if n in keys else f"{n}_sum") for n in t.column_names], schema=t.schema)

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.tables.append(table)
        self.rows += table.num_rows
        if self.rows > self.most:
            self.tables = [self._merged()]
            self.rows = self.tables[0].num_rows
            if 2 * self.rows > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            yield from self._merged().to_batches(max_chunksize=1 << 16)
        self.tables, self.rows = [], 0
