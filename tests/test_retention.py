"""What expires goes as a whole folder, and nothing else is touched."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veritab.plans.workspace import Workspace
from veritab.sources import folders, registry

NOW = datetime(2024, 3, 10, 12)


def files(path):
    return {os.path.join(root, name): os.stat(os.path.join(root, name)).st_mtime_ns
            for root, _, names in os.walk(path) for name in names}


def expiring(spark, path, days):
    moments = [int((NOW + timedelta(days=d)).timestamp()) for d in days]
    registry.append_expiring(spark.createDataFrame([(d, t) for d, t in zip(days, moments)], "d int, ttl long"), path)


def test_days_that_are_over_go_and_others_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "log")
    expiring(spark, path, [-40, -2, -1, 0, 1, 30])
    expiring(spark, path, [-1, 5])
    before = files(path)
    being_read = spark.read.parquet(path).filter("d >= 0")
    assert registry.drop_expired(spark, path, NOW) == [
        "expiry_day=2024-01-30", "expiry_day=2024-03-08", "expiry_day=2024-03-09"]
    assert sorted(r["d"] for r in spark.read.parquet(path).collect()) == [0, 1, 5, 30]
    assert sorted(r["d"] for r in being_read.filter("expiry_day >= '2024-03-10'").collect()) == [0, 1, 5, 30]
    after = files(path)
    live = {f: t for f, t in before.items() if not any(day in f for day in ("2024-01-30", "2024-03-08", "2024-03-09"))}
    assert after == live
    assert registry.drop_expired(spark, path, NOW) == []
    assert registry.drop_expired(spark, str(tmp_path / "none"), NOW) == []


def test_a_removed_folder_is_hidden_before_it_is_deleted(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_expired-left").mkdir()
    (tmp_path / "a" / "x").write_text("x")
    assert folders.subfolders(spark, str(tmp_path)) == ["a"]
    assert folders.remove(spark, str(tmp_path / "a")) and not folders.remove(spark, str(tmp_path / "a"))
    assert folders.subfolders(spark, str(tmp_path)) == []


def test_workspace_expires_idle_sessions(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "root"))
    (tmp_path / "in.csv").write_text("a,b\n" + "\n".join(f"{i},{i % 3}" for i in range(30)))
    old, new = (work.upload(str(tmp_path / "in.csv"), name) for name in ("old", "new"))
    work.recommend(old)
    later = work.sessions().agg(F.max("updated_at")).first()[0]
    kept = files(work._path("datasets/new"))
    gone = work.expire(later + timedelta(days=1))
    assert gone["sessions"] == [] and gone["decisions"] == []
    work._update("new", quality_score=1.0)
    registry.upsert_session(registry.session_frame(spark, [
        {"session_id": "new", "updated_at": later + timedelta(days=20)}]), work._path("sessions"))
    gone = work.expire(later + timedelta(days=35))
    assert gone["sessions"] == ["old"] and len(gone["decisions"]) == 1 and len(gone["responses"]) == 1
    assert files(work._path("datasets/new")) == kept and work.dataset("new").count() == 30
    assert folders.subfolders(spark, work._path("datasets")) == ["new"]
