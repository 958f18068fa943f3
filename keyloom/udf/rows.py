"""The rows of one group as Python functions see them, in memory that doesn't grow with the group."""

from __future__ import annotations

import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa

#: Values that a group keeps in memory; a larger group goes to a file of the task's own.
IN_MEMORY = 1_000_000
#: Batches that are held as rows, so that neighbouring rows can be asked for one by one.
HELD = 2


def _values(column: pa.Array) -> list:
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        values = column.to_pylist()
    else:
        values = column.to_numpy(zero_copy_only=False).tolist()
    return [None if v != v else v for v in values] if pa.types.is_floating(column.type) else values


class Group:
    """Record batches that can be read again: the first in memory, all of them in a file once there are many values."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.ends, self.file, self.reader = [], [0], None, None
        writer, values = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            self.ends.append(self.ends[-1] + batch.num_rows)
            values += batch.num_rows * batch.num_columns
            if writer is None and values > IN_MEMORY:
                self.file = tempfile.TemporaryFile()
                writer = pa.ipc.new_file(pa.PythonFile(self.file, "w"), batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                for b in self.batches:
                    writer.write_batch(b)
                self.batches = []
            if writer is None:
                self.batches.append(batch)
            else:
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
            self.reader = pa.ipc.open_file(pa.PythonFile(self.file, "r"))

    def batch(self, i: int) -> pa.RecordBatch:
        return self.batches[i] if self.reader is None else self.reader.get_batch(i)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Data(Sequence):
    """[names, types, row, row, ...] of some columns of a group.  Rows are made as they are asked for; a slice is a view."""

    def __init__(self, head: list[list], group: Group, columns: list[int], at: range | None = None):
        self.head, self.group, self.columns = head, group, columns
        self.at = range(len(head) + group.ends[-1]) if at is None else at
        self.held: dict[int, list[list]] = {}

    def __len__(self) -> int:
        return len(self.at)

    def _rows(self, i: int) -> list[list]:
        if i not in self.held:
            if len(self.held) >= HELD:
                self.held.pop(next(iter(self.held)))
            batch = self.group.batch(i)
            self.held[i] = [list(row) for row in zip(*(_values(batch.column(c)) for c in self.columns), strict=True)]
        return self.held[i]

    def _one(self, at: int) -> list:
        if at < len(self.head):
            return self.head[at]
        i = bisect_right(self.group.ends, at - len(self.head)) - 1
        return self._rows(i)[at - len(self.head) - self.group.ends[i]]

    def __getitem__(self, i):
        return Data(self.head, self.group, self.columns, self.at[i]) if isinstance(i, slice) else self._one(self.at[i])

    def __iter__(self) -> Iterator[list]:
        if self.at.step != 1:
            yield from map(self._one, self.at)
            return
        at = self.at.start
        while at < self.at.stop:
            if at < len(self.head):
                yield self.head[at]
                at += 1
                continue
            i = bisect_right(self.group.ends, at - len(self.head)) - 1
            lo = at - len(self.head) - self.group.ends[i]
            rows = self._rows(i)[lo : lo + self.at.stop - at]
            yield from rows
            at += len(rows)

    def __eq__(self, other) -> bool:
        return isinstance(other, (list, Data)) and len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))

    __hash__ = None

    def __add__(self, other) -> list:
        return [*self, *other]

    def __radd__(self, other) -> list:
        return [*other, *self]

    def copy(self) -> list:
        return list(self)
