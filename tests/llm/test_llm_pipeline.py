"""The corpus pipeline, stage by stage, on a table with planted cases."""

import corpus_pipeline
from lorekeep.llm import jaccard_join
from tests.llm.helpers import ODD, documents, prose


def test_pipeline_stages(spark, tmp_path):
    passage, leak = prose(999, 70), prose(998, 40)
    docs = [(i, prose(i, 150)) for i in range(40)]
    docs += [(50, docs[1][1]), (51, docs[1][1] + " one more word"), (60, prose(60, 80) + ".\n" + passage), (61, prose(61, 80) + ".\n" + passage), (70, prose(70, 80) + " " + leak), *ODD]
    docs += [(100 + i, " ".join(w.upper() + "!!" for w in prose(i + 200, 80).split())) for i in range(10)]
    frame = documents(spark, docs)
    folder = str(tmp_path)
    frame.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, held = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, folder)
        if n < 4:
            assert out.columns == frame.columns
        out.write.parquet(f"{folder}/{n}")
        seen = spark.read.parquet(f"{folder}/{n}")
        held[name] = [tuple(r) for r in seen.select("doc_id", *(["text"] if n < 4 else [])).collect()]
    assert set(range(40)) <= {i for i, _ in held["quality"]} and not {i for i, _ in held["quality"]} & set(range(100, 110))
    near = [i for i, _ in held["near_duplicates"]]
    assert 1 in near and 50 not in near and 51 not in near and near.count(10) <= 1 and {60, 61, 70} <= set(near)
    cut = dict(held["substring_dedup"])
    assert passage in cut[60] and passage not in cut[61] and cut[2] == docs[2][1] and len(cut) == len(set(near))
    assert 70 not in dict(held["decontamination"]) and set(range(2, 40)) <= set(dict(held["decontamination"]))
    assert {i for i, in held["packing"]} == set(dict(held["decontamination"]))
    whole = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in whole.select("doc_id").collect()} == {i for i, in held["packing"]}


def test_rows_keep_their_numbers_when_scans_are_cut_anew(spark, tmp_path, monkeypatch):
    """Every table that is written changes how Spark cuts the files of the next scan, as a lost executor does."""
    folder, name, cost = str(tmp_path), "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"
    # files of growing size: in one task they are read from the largest to the smallest, in several each is numbered anew
    for n in range(6):
        held = [(10 * n + i, prose(10 * n + i, 60 + 40 * n)) for i in range(5)] + ([(900 + n, prose(7, 100) + f" copy{n}")] if n in (1, 4) else [])
        documents(spark, held).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    times, before = [], spark.conf.get(cost)

    def toggled(stored):
        def run(df, label):
            out = stored(df, label)
            times.append(label)
            spark.conf.set(name, str(1 + len(times)))
            return out

        return run

    monkeypatch.setattr(jaccard_join, "stored", toggled(jaccard_join.stored))
    monkeypatch.setattr(corpus_pipeline, "stored", toggled(corpus_pipeline.stored))
    try:
        spark.conf.set(cost, "1")
        spark.conf.set(name, "1")
        kept = [r[0] for r in corpus_pipeline.keep_one_of_each(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id").collect()]
    finally:
        spark.conf.set(cost, before)
        spark.conf.unset(name)
    assert sorted(i for i in kept if i < 900) == sorted(10 * n + i for n in range(6) for i in range(5))
    assert len([i for i in kept if i >= 900]) == 1
