"""A log of JSON lines with immutable versions, for replacing and appending so that a reader never sees a half-done state.

Rows are written under a name of their own in `data`; a version is one small document in `commits` that lists the names it
consists of. A commit writes its document beside the others and gives it the next version's name by a rename that fails if
the name is taken; whoever loses reads the new version and tries again on top of it. So the newest document is the pointer:
it changes at once, what it lists never changes, and a crash between the steps leaves the last version as it was (and data
that no version lists, which `clean` removes).

A commit may carry a transaction: the name of a writer and a rising number. A version remembers each writer's last number,
and a commit whose number is not above it is not made again, so that a repeated batch is appended once.

Defined cases: a log without versions reads as empty; a commit of no rows is a version; null values are kept; a version that
`clean` removed can no longer be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sievework.sources.shared import hadoop_path

DIGITS = 12


@dataclass
class Version:
    number: int = 0
    parts: list[str] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, folder: str) -> list[str]:
        at, fs = hadoop_path(self.spark, f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(name[:DIGITS]) for name in self._files("commits") if name[:DIGITS].isdigit()]

    def version(self, number: int | None = None) -> Version:
        """That version, or the last one."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return Version()
        at, fs = hadoop_path(self.spark, f"{self.path}/commits/{number:0{DIGITS}d}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, schema: str | StructType, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless a number is given."""
        parts = self.version(number).parts
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json([f"{self.path}/data/{p}" for p in parts])

    def write_data(self, rows: DataFrame) -> str:
        """The first step: rows under a name that no version lists yet."""
        name = uuid.uuid4().hex
        rows.write.json(f"{self.path}/data/{name}", ignoreNullFields=False)
        return name

    def commit(self, change: Callable[[Version], list[str]], txn: tuple[str, int] | None = None) -> Version:
        """The second step: the next version, whose parts `change` makes of the last one's. A known transaction changes nothing."""
        while True:
            last = self.version()
            if txn and last.writers.get(txn[0], -1) >= txn[1]:
                return last
            new = Version(last.number + 1, change(last), last.writers | ({txn[0]: txn[1]} if txn else {}))
            if self._publish(new):
                return new

    def _publish(self, new: Version) -> bool:
        """Whether the version's name was free."""
        jvm = self.spark.sparkContext._jvm
        final, fs = hadoop_path(self.spark, f"{self.path}/commits/{new.number:0{DIGITS}d}.json")
        hidden, _ = hadoop_path(self.spark, f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(hidden, final, options)
        except Exception:
            fs.delete(hidden, False)
            if fs.exists(final):
                return False
            raise
        return True

    def replace(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> Version:
        """A version of these rows alone."""
        return self._written(rows, lambda last, name: [name], txn)

    def append(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> Version:
        """A version of the last one's rows and these."""
        return self._written(rows, lambda last, name: [*last.parts, name], txn)

    def _written(self, rows: DataFrame, change: Callable[[Version, str], list[str]], txn: tuple[str, int] | None) -> Version:
        if txn and self.version().writers.get(txn[0], -1) >= txn[1]:
            return self.version()
        name = self.write_data(rows)
        return self.commit(lambda last: change(last, name), txn)

    def append_once(self, rows: DataFrame, key: list[str], order: list[str], schema: str | StructType, txn: tuple[str, int] | None = None) -> Version:
        """Appends the first row of each key, in the order, whose key the last version does not have.

        The check and the commit hold together: if another writer commits in between, the check is made again on its version.
        """
        from pyspark.sql import functions as F

        while True:
            last = self.version()
            if txn and last.writers.get(txn[0], -1) >= txn[1]:
                return last
            first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_one")).select("_one.*")
            fresh = first.join(self.read(schema, last.number).select(*key).distinct(), key, "left_anti") if last.parts else first
            name = self.write_data(fresh.select(*rows.columns))
            new = Version(last.number + 1, [*last.parts, name], last.writers | ({txn[0]: txn[1]} if txn else {}))
            if self._publish(new):
                return new

    def clean(self, keep: int = 1) -> int:
        """Removes all but the last `keep` versions and what none of these lists; how many parts went. No writer may be at work."""
        numbers = sorted(self.versions())
        stay = numbers[-keep:]
        used = {p for n in stay for p in self.version(n).parts}
        gone = [p for p in self._files("data") if p not in used]
        for folder, names in (("commits", [f"{n:0{DIGITS}d}.json" for n in numbers if n not in stay]), ("data", gone)):
            for name in names:
                at, fs = hadoop_path(self.spark, f"{self.path}/{folder}/{name}")
                fs.delete(at, True)
        return len(gone)
