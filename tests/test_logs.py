"""Commit logs that outlive crashes between their steps, and the stateful stream of attempts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievework.sources.commits import CommitLog
from sievework.streaming import logs, verify

KIND = "k long, v string"


def rows(spark, *ks):
    return spark.createDataFrame([(k, None if k % 2 else "v") for k in ks], KIND)


def held(log, number=None):
    return sorted(r.k for r in log.read(KIND, number).collect())


def test_versions_and_repeated_transactions(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert held(log) == [] and log.version().number == 0
    log.replace(rows(spark, 1, 2))
    for _ in range(2):
        log.append(rows(spark, 3), ("w", 0))
    log.append(rows(spark, 4), ("w", 1))
    log.append(rows(spark, 5), ("other", 1))
    assert held(log) == [1, 2, 3, 4, 5] and held(log, 1) == [1, 2] and log.versions() == [1, 2, 3, 4]
    assert {r.v for r in log.read(KIND).where("k = 3").collect()} == {None}
    log.replace(rows(spark))
    assert held(log) == []
    assert log.clean() == 4 and log.versions() == [5]
    log.append(rows(spark, 9), ("w", 1))
    assert held(log) == []


def test_a_crash_between_the_steps_leaves_the_last_version(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.replace(rows(spark, 1))
    monkeypatch.setattr(CommitLog, "_publish", lambda self, new: (_ for _ in ()).throw(RuntimeError("died")))
    for step in (lambda: log.replace(rows(spark, 7)), lambda: log.append(rows(spark, 8), ("w", 3))):
        with pytest.raises(RuntimeError):
            step()
    monkeypatch.undo()
    assert held(log) == [1] and log.version().number == 1
    log.append(rows(spark, 8), ("w", 3))
    assert held(log) == [1, 8] and log.clean() == 2 and held(log) == [1, 8]


def test_the_loser_of_two_writers_commits_on_top(spark, tmp_path, monkeypatch):
    log, other = CommitLog(spark, str(tmp_path / "log")), CommitLog(spark, str(tmp_path / "log"))
    log.replace(rows(spark, 1))
    publish, met = CommitLog._publish, []

    def raced(self, new):
        if not met:
            met.append(True)
            other.append(rows(spark, 2, 3))
        return publish(self, new)

    monkeypatch.setattr(CommitLog, "_publish", raced)
    log.append(rows(spark, 4))
    assert held(log) == [1, 2, 3, 4]
    met.clear()
    log.append_once(rows(spark, 3, 5, 5), ["k"], ["v"], KIND)
    assert held(log) == [1, 2, 2, 3, 3, 4, 5]  # the other writer's plain append came in between; 3 was there, 5 comes once


def attempts(seed):
    rng, start, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for u in range(60):
        for n in range(rng.randint(1, 7)):
            at = start + dt.timedelta(minutes=40 * n + (150 if u % 5 == 0 and n >= 2 else 0))
            out.append((f"u{u}" if u else None, n, at, rng.choice([True, False, False, None]), rng.choice([True, True, False, None]), rng.choice([None, "a", "b"]), f"t{u}-{n}", f"f{u}"))
    return out + [r for r in out if r[1] == 1]  # repeated rows


def one_by_one(data, budget):
    """(unit, text, pick, attempts, fell_back), as a loop over a unit's attempts."""
    units, out = {}, []
    for r in sorted(set(data), key=lambda r: (str(r[0]), r[1])):
        units.setdefault(r[0], []).append(r)
    for unit, own in units.items():
        first = own[0][5] if own[0][4] else None
        answer = None
        for i, r in enumerate(own[:budget]):
            if i and r[2] - own[i - 1][2] > dt.timedelta(hours=1):
                answer = (unit, own[0][7], first, i, True)
                break
            if r[3]:
                answer = (unit, r[6], r[5], i + 1, False) if r[4] and r[5] else (unit, own[0][7], first, i + 1, True)
                break
        out.append(answer or (unit, own[0][7], first, min(len(own), budget), True))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget,cut", [(4, 2)])
def test_answers_do_not_depend_on_batches_or_restarts(spark, tmp_path, budget, cut):
    data = attempts(2)
    want = one_by_one(data, budget)
    table = spark.createDataFrame(data, verify.ATTEMPT)
    assert sorted((tuple(r) for r in verify.answers_by_rule(table, budget).collect()), key=str) == want
    src, log, checkpoint = (str(tmp_path / x) for x in ("src", "log", "ck"))
    stream = lambda: verify.first_verified(verify.attempts_of(spark, src), budget, late="1 day")
    for n in range(7):
        table.where(F.col("number") == n).coalesce(1).write.mode("append").json(src)
        if n == cut:
            verify.run_to_end(stream(), log, checkpoint, "w")
            early = CommitLog(spark, log).read(verify.ANSWER).count()
            assert 0 < early < len(want)
    ends = [("~", i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None, None, None, None, None) for i in (40, 80)]
    for end in ends:
        spark.createDataFrame([end], verify.ATTEMPT).coalesce(1).write.mode("append").json(src)
    for _ in range(2):
        verify.run_to_end(stream(), log, checkpoint, "w")
    got = CommitLog(spark, log).read(verify.ANSWER).where("unit <> '~' or unit is null").drop("due").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_pending_units_make_no_grid(spark):
    units = spark.createDataFrame([(1,), (2,), (3,), (3,)], "unit long")
    kinds = spark.createDataFrame([("a",), ("b",)], "kind string")
    done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "z"), (9, "a")], "unit long, kind string")
    left = logs.pending_units(units, kinds, done)
    assert sorted((r.unit, r.kind) for r in left.collect()) == [(2, "a"), (3, "a"), (3, "b")]
    assert "Cross" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert logs.pending_units(units, kinds.limit(0), done).collect() == []
