"""A driver for stages over tables: a declared graph, counts of the pass that writes, quarantine, resume.

A stage names the tables it reads and returns rows; a row with an error (a
column of that name that isn't null) is quarantined: it is written beside the
others, and the next stages don't see it. The counts of a stage are observed
while its rows are written, so that nothing is read again for them.

A stage's fingerprint covers its name, its version, its settings, and the
fingerprints of what it reads; a source's covers its rows in any order. A stage
whose folder is complete for its fingerprint is read, with its counts; after a
crash, or a change of one stage, only the stages below run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ERROR, FAILED = "error", "_failed"


@dataclass(frozen=True)
class Stage:
    """run gets the tables named in reads; counts: further aggregates over all its rows, failed ones too; settings and version are part of the fingerprint."""

    name: str
    run: Callable[..., DataFrame]
    reads: tuple[str, ...]
    counts: dict[str, Column] = field(default_factory=dict)
    settings: str = ""
    version: int = 1


def ordered(stages: Sequence[Stage], sources: Sequence[str]) -> list[Stage]:
    """The stages so that each stands behind what it reads. Unknown tables, repeated names and circles raise."""
    names = [s.name for s in stages]
    if len(set(names)) < len(names) or set(names) & set(sources):
        raise ValueError("stages and sources need names of their own")
    done, left, out = set(sources), list(stages), []
    while left:
        ready = [s for s in left if set(s.reads) <= done]
        if not ready:
            raise ValueError(f"no way to {sorted(s.name for s in left)}: unknown tables or a circle")
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return out


def content_fingerprint(df: DataFrame) -> str:
    """Of the schema and of all rows in any order: their number, and sums of hashes."""
    each = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]) if df.columns else F.lit(0)
    n, a, b = df.agg(F.count("*"), F.sum(each.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(each, F.lit(1)))).first()
    return hashlib.sha1(json.dumps([df.schema.json(), n, str(a), b]).encode()).hexdigest()


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/report/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Driver:
    """Stages over sources, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, sources: dict[str, DataFrame], stages: Sequence[Stage]):
        self.spark, self.folder, self.sources = spark, folder.rstrip("/"), sources
        self.stages = ordered(stages, list(sources))
        self.tables: dict[str, DataFrame] = {}
        self.reports: list[dict] = []

    def _path(self, name: str, mark: str) -> str:
        return f"{self.folder}/{name}-{mark[:16]}"

    def run(self) -> DataFrame:
        """Runs what isn't there; the report: (stage, fingerprint, reused, rows, failed, counts), a row for each stage."""
        marks = {name: content_fingerprint(df) for name, df in self.sources.items()}
        self.tables, self.reports = dict(self.sources), []
        for s in self.stages:
            marks[s.name] = hashlib.sha1(json.dumps([s.name, s.version, s.settings, [marks[r] for r in s.reads]]).encode()).hexdigest()
            path = self._path(s.name, marks[s.name])
            reused = _complete(self.spark, path)
            if not reused:
                self._write(s, path)
            report = json.loads(self.spark.read.text(f"{path}/report").first()[0])
            self.tables[s.name] = self.spark.read.parquet(f"{path}/rows/{FAILED}=false")
            self.reports.append({"stage": s.name, "fingerprint": marks[s.name], "reused": reused, **report})
        return self.spark.createDataFrame([(r["stage"], r["fingerprint"], r["reused"], r["rows"], r["failed"], r["counts"]) for r in self.reports], "stage string, fingerprint string, reused boolean, rows bigint, failed bigint, counts map<string,bigint>")

    def _write(self, s: Stage, path: str) -> None:
        rows = s.run(*[self.tables[r] for r in s.reads])
        if ERROR not in rows.columns:
            rows = rows.withColumn(ERROR, F.lit(None).cast("string"))
        seen = Observation()
        failed = F.col(ERROR).isNotNull()
        counted = {"rows": F.count("*"), "failed": F.count_if(failed)} | {f"count {k}": v.cast("bigint") for k, v in s.counts.items()}
        # A table of each kind must be there to be read, also where no row is of that kind.
        for kind in ("false", "true"):
            rows.limit(0).write.mode("overwrite").parquet(f"{path}/rows/{FAILED}={kind}")
        rows.withColumn(FAILED, failed).observe(seen, *[v.alias(k) for k, v in counted.items()]).write.mode("append").partitionBy(FAILED).parquet(f"{path}/rows")
        got = seen.get
        report = {"rows": got["rows"], "failed": got["failed"], "counts": {k.removeprefix("count "): v for k, v in got.items() if k.startswith("count ")}}
        # The report comes last: a folder without one is run again.
        self.spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")

    def quarantined(self, name: str) -> DataFrame:
        """The failed rows of a stage of the last run, with their errors."""
        mark = next(r["fingerprint"] for r in self.reports if r["stage"] == name)
        return self.spark.read.parquet(f"{self._path(name, mark)}/rows/{FAILED}=true")
