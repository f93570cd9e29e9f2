"""Readers and writers."""

import os

import pytest
from pyspark.sql import functions as F

from duolex.operators.frequency import token_probabilities
from duolex.session import drop_stage_tables, materialise, shared_dir, small_side, work_path
from duolex.sources import corpora as C
from duolex.sources import sinks


def test_line_numbers_over_file_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = [f"line {i} " + "x" * (i % 40) for i in range(1000)]
        (tmp_path / "en.para.valid.tok").write_text("\n".join(lines) + "\n")
        df = C.load_parallel_text(spark, str(tmp_path), "en", "valid")
        got = {r.row_index: r.text for r in df.collect()}
        assert got == dict(enumerate(lines))
        assert {r.split for r in df.collect()} == {"valid"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_corpus_names(spark, tmp_path):
    for split, name in (("train", "mono.train"), ("valid", "para.valid"), ("test", "para.test")):
        for lang in ("cpp", "cuda"):
            (tmp_path / f"{lang}.{name}.tok").write_text(f"{lang} {split} a\n{lang} {split} b\n")
    df = C.load_text_corpus(spark, str(tmp_path), ["cpp", "cuda"])
    assert df.count() == 12 and df.where("text = concat(lang, ' ', split, ' a')").count() == 6
    assert C.load_parallel_only(spark, str(tmp_path), ["cpp", "cuda"]).select("split").distinct().count() == 2


def test_json_corpora(spark, tmp_path):
    for name in ("mono.train", "para.valid", "para.test"):
        (tmp_path / f"f.{name}.jsonl").write_text('{"text": "a\\nb", "extra": 1}\n')
        (tmp_path / f"f.{name}.aer.jsonl").write_text('{"tokens": ["a", "b"], "tags": [1, 0]}\n')
    assert {r.text for r in C.load_json_corpus(spark, str(tmp_path), ["f"]).collect()} == {"a\nb"}
    tagged = C.load_tagged_corpus(spark, str(tmp_path), ["f"]).collect()
    assert [(r.tokens, r.tags) for r in tagged] == [(["a", "b"], [1, 0])] * 3


def test_synthetic_pairs(spark, tmp_path):
    (tmp_path / "cpp.cuda.train.synthetic.jsonl").write_text('{"cpp": "a", "generated_cuda": "b"}\n')
    for split in ("valid", "test"):
        (tmp_path / f"cpp.para.{split}.tok").write_text("c1\nc2\n")
        (tmp_path / f"cuda.para.{split}.tok").write_text("u1\nu2\n")
    got = sorted((r.split, r.cpp, r.cuda) for r in C.load_synthetic_pairs(spark, str(tmp_path), "cpp", "cuda").collect())
    assert got == [("test", "c1", "u1"), ("test", "c2", "u2"), ("train", "a", "b"), ("valid", "c1", "u1"), ("valid", "c2", "u2")]


def test_save_and_reuse(spark, tmp_path, corpus):
    path = str(tmp_path / "saved")
    assert sinks.load_if_cached(spark, path) is None
    sinks.save_sharded(corpus.withColumn("split", F.lit("train")).coalesce(1), path, max_records=10)
    files = [f for f in os.listdir(f"{path}/split=train") if f.endswith(".parquet")]
    assert len(files) == 6
    assert sinks.load_if_cached(spark, path).count() == 60
    os.remove(f"{path}/_SUCCESS")  # as a write that was cut short leaves it
    assert sinks.load_if_cached(spark, path) is None


def test_frequency_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("en", 7, 10, 1), ("en", 8, 5, 2)], C.FREQUENCY_CSV)
    back = C.read_frequency_csv(spark, sinks.write_frequency_csv(df, str(tmp_path / "f")))
    probs = [round(r.prob, 6) for r in token_probabilities(back).orderBy("rank").collect()]
    assert probs == [0.666667, 0.333333]
    text = next(p for p in (tmp_path / "f").iterdir() if p.suffix == ".csv").read_text()
    assert text.startswith("lang|token_id|freq|rank\n")


@pytest.mark.parametrize("sep", ["|", ","])
def test_predictions_round_trip(spark, tmp_path, sep):
    rows = [('a "q" | b, c', " lead"), ("line\nbreak", 'x"'), ("\\", "\\\""), ("", "tail ")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    path = sinks.write_predictions(df, str(tmp_path / "p"), sep)
    got = sorted((r.Label, r.Prediction) for r in sinks.read_predictions(spark, path, sep).collect())
    assert got == sorted(rows)


class Named:
    """Stands in for a session with or without a shared folder."""

    def __init__(self, path, master):
        self.conf = self.sparkContext = self
        self.path, self.master, self.own = path, master, None

    def get(self, name, default):
        return self.path or default

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, path):
        self.own = path


def test_shared_folder_is_read_from_the_session():
    assert shared_dir(Named("/shared/x", "yarn")) == "/shared/x"
    assert work_path(Named("/shared/x", "yarn"), "t").startswith("/shared/x/t-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Named(None, "spark://host:7077"))
    local = Named(None, "local[2]")
    assert shared_dir(local) == local.own == shared_dir(local)


def test_stage_tables_can_be_dropped(spark):
    drop_stage_tables(spark)
    table = materialise(spark.range(5), "t")
    path = table.inputFiles()[0].replace("file:", "").rsplit("/", 1)[0]
    assert table.count() == 5 and os.path.exists(path)
    assert drop_stage_tables(spark) == 1 and not os.path.exists(path)
    assert drop_stage_tables(spark) == 0


def test_small_side_checks_the_size(spark):
    df = spark.range(50)
    assert "broadcast" in small_side(df, 50)._jdf.queryExecution().logical().toString().lower()
    assert small_side(df, 49) is df


def test_malformed_line_is_an_error(spark, tmp_path):
    from duolex.sources.corpora import load_json_corpus

    lines = ['{"text": "good one"}', '{"text": broken', '{"text": "good two"}']
    (tmp_path / "en.mono.train.jsonl").write_text("\n".join(lines) + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_json_corpus(spark, str(tmp_path), ["en"], splits=("train",)).collect()
    kept = load_json_corpus(spark, str(tmp_path), ["en"], splits=("train",), mode="DROPMALFORMED")
    assert sorted(r.text for r in kept.collect()) == ["good one", "good two"]
