"""What the stages of the pipeline leave in the shared folder."""

import corpus_pipeline
from alarmlens.llm import common

SF = "/root/testdata/sf0.001"


def written(monkeypatch):
    """The paths drawn from now on, and which of them are there."""
    drawn, scratch = [], common.scratch_path

    def noted(spark, name):
        drawn.append(scratch(spark, name))
        return drawn[-1]

    monkeypatch.setattr(common, "scratch_path", noted)
    there = lambda spark: sum((lambda fs, p: fs.exists(p))(*common._file_system(spark, path)) for path in drawn)
    return drawn, there


def test_tables_on_the_way_are_deleted(spark, monkeypatch):
    drawn, there = written(monkeypatch)

    def make():
        first = common.materialize(spark.range(10), "first")
        second = common.settled(spark, "second", lambda: common.materialize(first.filter("id > 4"), "inner").filter("id > 6"))
        return first.join(second, "id")

    got = common.settled(spark, "all", make)
    assert sorted(r.id for r in got.collect()) == [7, 8, 9] and len(drawn) == 4 and there(spark) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_stages_keep_their_rows_and_what_was_found(spark, monkeypatch, tmp_path):
    """A stage that has ended keeps one copy of what it was given and one table of findings, whatever its rounds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        drawn, there = written(monkeypatch)
        made = stage(spark, docs, SF)
        assert len(drawn) > 5 and there(spark) == 2, name
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
