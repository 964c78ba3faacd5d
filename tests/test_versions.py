"""The bucketed, compacting vector table against a plain dictionary."""

import random
import re

import pytest

from lorekeep.sources import versions
from lorekeep.sources.versions import compact_levels, live, read_current, remove_covered, write_version, written_segments


def frame(spark, rows):
    return spark.createDataFrame([("s", f"d{d}#{i}", f"d{d}", text) for d, i, text in rows], "site_id string, id string, document_id string, text string")


def state(spark, path, **how):
    return {r["id"]: r["text"] for r in read_current(spark, path, **how).collect()}


def test_many_versions_merge_and_give_the_same_rows(spark, tmp_path):
    path, wanted, r = str(tmp_path / "t"), {}, random.Random(7)
    history = []
    for version in range(14):
        rows = [(r.randrange(30), i, f"v{version}") for i in range(r.choice([1, 3, 20]))]
        rows = list({(d, i): (d, i, t) for d, i, t in rows}.values())
        gone = [k for k in r.sample(sorted(wanted), min(3, len(wanted))) if k not in {f"d{d}#{i}" for d, i, _ in rows}]
        dead = spark.createDataFrame([("s", k, k.split("#")[0]) for k in gone], "site_id string, id string, document_id string")
        write_version(frame(spark, rows), path, version, dead, buckets=8)
        wanted = wanted | {f"d{d}#{i}": t for d, i, t in rows}
        wanted = {k: v for k, v in wanted.items() if k not in gone}
        history.append(wanted)
        compact_levels(spark, path, before=version, fan_in=3)
    assert state(spark, path) == wanted
    now = live(written_segments(spark, path))
    assert len(now) < 9 and [s.first for s in now[1:]] == [s.last + 1 for s in now[:-1]]
    assert state(spark, path, before=13) == history[12]  # the last batch replayed sees what was there before it
    assert remove_covered(spark, path) > 0 and state(spark, path) == wanted
    assert sorted(written_segments(spark, path), key=lambda s: s.first) == now


def test_a_batch_reads_only_the_buckets_of_its_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    for version in range(3):
        write_version(frame(spark, [(d, 0, f"v{version}") for d in range(200)]), path, version, buckets=32)
    batch = frame(spark, [(3, 0, ""), (4, 0, "")]).select("site_id", "document_id")
    known = read_current(spark, path, ["text"], documents=batch)
    plan = known._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", plan)
    assert {r["id"]: r["text"] for r in known.collect()} == {"d3#0": "v2", "d4#0": "v2"}


def test_a_write_without_its_entry_is_not_seen_and_may_be_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(frame(spark, [(1, 0, "a")]), path, 0)
    frame(spark, [(1, 0, "half")]).write.parquet(f"{path}/segments/first=1/last=1/bucket=0")
    assert state(spark, path) == {"d1#0": "a"}
    for _ in range(2):
        write_version(frame(spark, [(1, 0, "b")]), path, 1)
    assert state(spark, path) == {"d1#0": "b"}


def test_empty_versions_new_columns_and_tombstones_without_a_document(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not versions.has_versions(spark, path)
    write_version(frame(spark, []), path, 0)
    assert versions.has_versions(spark, path) and state(spark, path) == {}
    write_version(frame(spark, [(1, 0, "a"), (2, 0, "b")]), path, 1)
    write_version(frame(spark, [(3, 0, "c")]).selectExpr("*", "1 AS extra"), path, 2, spark.createDataFrame([("s", "d1#0")], "site_id string, id string"))
    assert state(spark, path) == {"d2#0": "b", "d3#0": "c"}
    assert {r["id"]: r["extra"] for r in read_current(spark, path).collect()} == {"d2#0": None, "d3#0": 1}


@pytest.mark.parametrize("sizes,run", [([1, 1], None), ([1, 1, 1], (0, 3)), ([100, 1, 1, 1], (1, 4)), ([9, 9, 9, 1], (0, 3)), ([], None)])
def test_which_segments_are_due(sizes, run):
    assert versions.due([versions.Segment(i, i, n, 8, "id", "") for i, n in enumerate(sizes)], 3) == run
