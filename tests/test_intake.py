"""Polls of a folder against one pass over all files; filters that merge; a poll that is run twice."""

import random

import pytest

from tallyforge.streaming import intake
from tallyforge.streaming.intake import Intake

FILES = "tenant string, path string, checksum string"


def polls(n=5, seed=4):
    rng = random.Random(seed)
    return [[(rng.choice(["a", "b", "c", None, "unknown"]), f"p{k}_{i:03d}", f"c{rng.randrange(40)}") for i in range(30)] for k in range(n)]


def brute(batches):
    first, out = {}, []
    for files in batches:
        known = dict(first)
        for t, p, c in sorted((f for f in files if f[0] in ("a", "b", "c")), key=lambda f: f[1]):
            first.setdefault((t, c), p)
            out.append((t, p, c, first[t, c], (t, c) not in known and first[t, c] == p))
    return sorted(out)


def told(run):
    return sorted(tuple(r) for r in run.taken().select("tenant", "path", "checksum", "first_path", "is_new").collect())


@pytest.mark.parametrize("segments", [1, 4096])
def test_each_content_is_taken_once(spark, tmp_path, monkeypatch, segments):
    monkeypatch.setattr(intake, "SEGMENTS", segments)
    monkeypatch.setattr(intake, "BITS", 64 if segments == 1 else 8192)  # a filter that is always full, and one that is empty
    tenants = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tenant string")
    run, batches = Intake(spark, str(tmp_path / "run"), tenants), polls(3)
    for k, files in enumerate(batches):
        run.poll(spark.createDataFrame(files, FILES), k)
    assert told(run) == brute(batches)
    ids = run.taken().select("tenant", "checksum", "document").distinct().collect()
    assert len({(r.tenant, r.checksum) for r in ids}) == len(ids) == len({r.document for r in ids}) == run.history().count()
    jobs = run.jobs().collect()
    assert len({j.job for j in jobs}) == len(jobs) == run.history().count()
    assert all(len({j.batch for j in jobs if (j.tenant, j.poll) == key}) == 1 for key in {(j.tenant, j.poll) for j in jobs})


def test_a_poll_that_is_run_again_makes_the_same(spark, tmp_path):
    run, batches = Intake(spark, str(tmp_path / "run")), polls(2)
    seen = []
    for k in (0, 1, 1):
        run.poll(spark.createDataFrame(batches[k], FILES), k)
        seen.append((told(run), sorted(map(tuple, run.jobs().collect())), run.history().count()))
    assert seen[1] == seen[2] != seen[0]


def test_a_stream_of_files(spark, tmp_path):
    batches = [[f for f in b if f[0] in ("a", "b", "c")] for b in polls(3)]
    for files in batches[:2]:
        spark.createDataFrame(files, FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    Intake(spark, str(tmp_path / "run")).run(stream)
    spark.createDataFrame(batches[2], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = Intake(spark, str(tmp_path / "run"))
    run.run(stream)
    assert told(run) == brute(batches)


def test_filters_hold_all_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("'t' as tenant", "md5(string(id)) as checksum")
    other = spark.range(20_000, 40_000).selectExpr("'t' as tenant", "md5(string(id)) as checksum")
    half = intake.bloom(rows.where("checksum < '8'")).unionByName(intake.bloom(rows.where("checksum >= '8'")))
    assert intake.maybe_known(rows, half).count() == 20_000
    assert intake.maybe_known(other, half).count() < 20
    assert intake.maybe_known(rows.limit(0), half).count() == 0
