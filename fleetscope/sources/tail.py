"""A streaming source that follows a folder of Parquet files by the rows' own time."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Slice(InputPartition):
    """Rows after ``lo`` up to ``hi``."""

    def __init__(self, lo: float, hi: float):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class TailReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path, self.ts = options["path"], options.get("ts", "ts")
        self.lag, self.slice = float(options.get("lag", 5.0)), float(options.get("slice", 3600.0))
        self.skip = float(options.get("skipafter", "inf"))
        self.upto = float(options["upto"]) if "upto" in options else None
        self.since = float(options["since"]) if "since" in options else None

    def _horizon(self) -> float:
        return (time.time() if self.upto is None else self.upto) - self.lag

    def initialOffset(self) -> dict:
        return {"ts": self._horizon() if self.since is None else self.since}

    def latestOffset(self, *_) -> dict:
        return {"ts": self._horizon()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """Slices of the time between two offsets; none where that is longer than ``skipAfter``, as after a sleep: the stream goes on from now."""
        lo, hi = start["ts"], end["ts"]
        if hi <= lo or hi - lo > self.skip:
            return []
        edges = [lo]
        while edges[-1] < hi:
            edges.append(min(hi, edges[-1] + self.slice))
        return [Slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        """Batches of the files' rows; row groups whose times lie outside the slice are not read, and columns that a file lacks are null."""
        want = to_arrow_schema(self.schema)
        rows = ds.dataset(self.path, format="parquet", schema=want)
        inside = (pc.field(self.ts) > partition.lo) & (pc.field(self.ts) <= partition.hi)
        yield from rows.to_batches(columns=want.names, filter=inside)

    def commit(self, end: dict) -> None:
        """Offsets are Spark's to keep."""


class TailSource(DataSource):
    """Options: path, ts (the time column), lag (seconds that rows may take to arrive), slice (seconds of one task), skipAfter (a longer
    stretch between two batches is passed over), since (where a new stream starts; now if not given), upto (a fixed now)."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_tail"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(schema, {k.lower(): v for k, v in self.options.items()})


def tail_stream(spark: SparkSession, path: str, schema: str, **options):
    """The live stream of a folder's rows in order of time: each batch has those between its offsets, once, over restarts too."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("telemetry_tail").schema(schema).option("path", path).options(**options).load()
