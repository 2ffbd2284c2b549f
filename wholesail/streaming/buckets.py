"""State of many keys behind one state key.

Spark calls a Python state function once per state key, and a call costs milliseconds (its frames, its reads and writes of
state) whatever it does.  With one state key per customer that cost, not the rows, decides the time of a batch.  Here keys
are dealt into a fixed number of buckets, and the state of a bucket is one Arrow table as bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Part of a stream's state: a checkpoint written with another number cannot be carried on.
BUCKETS = 1024


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pack(fields: dict[str, str], rows: Iterable[tuple]) -> bytes:
    """``rows`` as an Arrow stream with columns ``fields`` (name → Arrow type)."""
    columns = list(zip(*rows)) or [()] * len(fields)
    table = pa.table({n: pa.array(c, t) for (n, t), c in zip(fields.items(), columns, strict=True)})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(state: bytes) -> Iterator[tuple]:
    table = pa.ipc.open_stream(bytes(state)).read_all()
    return zip(*(c.to_pylist() for c in table.columns), strict=True)
