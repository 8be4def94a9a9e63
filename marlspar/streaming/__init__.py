"""The dialect has no streams; tables are read in batches.  ``append`` feeds one from a stream."""

from __future__ import annotations


def append(engine, table: str):
    """A ``foreachBatch`` function that inserts each micro-batch into a table, constraints and triggers included."""

    def write(batch, _epoch) -> None:
        engine.bind("__batch", batch)
        try:
            out = engine.execute(f"INSERT INTO {table} SELECT * FROM __batch")
            if not out.ok:
                raise ValueError(out.message)
        finally:
            engine.bound.pop("__batch", None)

    return write
