import pytest
from pyspark.sql import functions as F

from helpers import log_of
from tastegrid.operators import splits as cuts
from tastegrid.plans import jobs
from tastegrid.sources import logs as sources
from tastegrid.sources import sinks

# The rows that the expected results of these tests rest on.
HISTORY = [(0, 10, 1, 1), (1, 11, 2, 0)]
FUTURE = [(0, 11, 10, 1), (1, 10, 11, 1), (0, 12, 12, 0), (1, 12, 13, 1)]
AUDIT = [(0, 12, 20, 1)]


def times(frame):
    return sorted(row["event_time"] for row in frame.collect())


def split(spark, history, future, fraction=0.5):
    return cuts.split_future(
        log_of(spark, history), log_of(spark, future), log_of(spark, AUDIT), fraction
    )


def test_cut_halves_the_future_and_passes_the_audit_on(spark):
    found = split(spark, HISTORY, FUTURE)
    assert [times(getattr(found, name)) for name in cuts.SPLITS] == [[1, 2], [10, 11], [12, 13], [20]]


def test_overlapping_future_rows_are_dropped(spark):
    history = [(0, 10, 10, 1), (1, 11, 20, 1)]
    future = [(0, 12 + at, 19 + at, 1) for at in range(6)]
    found = split(spark, history, future)
    assert times(found.validation.unionByName(found.test)) == [21, 22, 23, 24]
    assert max(times(found.train)) < min(times(found.validation))


@pytest.mark.parametrize("fraction", [0.01, 0.3, 0.5, 0.77, 0.99])
def test_cut_is_exact_inside_a_time_tie(spark, fraction):
    day = 86_400_000
    future = [(at % 3, at, day * (5 + at // 20), 1) for at in range(47)]
    found = split(spark, HISTORY, future, fraction)
    wanted = min(max(int(47 * fraction), 1), 46)
    items = lambda frame: sorted(row["item_id"] for row in frame.collect())
    assert items(found.validation) == list(range(wanted))
    assert items(found.test) == list(range(wanted, 47))


@pytest.mark.parametrize("fraction", [0.2, 0.5, 0.75])
def test_copies_at_the_cut_are_dealt_out_by_count(spark, fraction):
    future = log_of(spark, FUTURE[1:2] * 5 + FUTURE[:1] + FUTURE[3:] * 2)
    future = future.withColumn("tie", F.lit(1).cast("bigint"))
    found = cuts.split_future(log_of(spark, HISTORY), future, log_of(spark, AUDIT), fraction)
    every = [10] + [11] * 5 + [13] * 2
    cut = int(8 * fraction)
    assert times(found.validation) == every[:cut] and times(found.test) == every[cut:]


@pytest.mark.parametrize("unit", [1, 1_000_000, 2**53 // 10])
def test_cut_at_any_unit_of_time(spark, unit):
    future = [(at, at, 100 + at * unit + at % 2, 1) for at in range(40)]
    found = split(spark, HISTORY, future, 0.3)
    assert times(found.validation) == sorted(row[2] for row in future)[:12]


def test_bad_inputs_are_refused(spark):
    with pytest.raises(ValueError, match="between 0 and 1"):
        split(spark, HISTORY, FUTURE, 1.0)
    with pytest.raises(ValueError, match="at least two"):
        split(spark, HISTORY, FUTURE[:1])


def write_raw(spark, root):
    for name, rows in (
        (sources.HISTORY_FILE, HISTORY),
        (sources.FUTURE_FILE, FUTURE),
        (sources.RANDOM_FILE, AUDIT),
    ):
        lines = ["user_id,video_id,time_ms,is_click"] + [",".join(map(str, r)) for r in rows]
        (root / name).write_text("\n".join(lines) + "\n")


def test_prepare_writes_every_split(spark, tmp_path):
    raw, processed = tmp_path / "raw", tmp_path / "processed"
    raw.mkdir()
    write_raw(spark, raw)
    summary = {r["split"]: r for r in jobs.prepare(spark, str(raw), str(processed)).collect()}
    assert summary["train"]["interactions"] == 2
    assert summary["train"]["positive_rate"] == 0.5
    for name in cuts.SPLITS:
        assert (processed / "splits" / f"split={name}").exists()
    assert list((processed / "summary.json").glob("*.json"))
    loaded = sources.load_prepared(spark, str(processed / "splits"))
    assert times(loaded.validation) == [10, 11] and times(loaded.test) == [12, 13]


def test_csv_sink_writes_gzip_per_split(spark, tmp_path):
    sinks.write_splits_csv(split(spark, HISTORY, FUTURE), str(tmp_path))
    for name in cuts.SPLITS:
        assert list((tmp_path / f"{name}.csv.gz").glob("*.csv.gz"))
    back = spark.read.option("header", True).csv(str(tmp_path / "test.csv.gz"))
    assert sorted(row["event_time"] for row in back.collect()) == ["12", "13"]


def test_csv_splits_come_back_with_their_order(spark, tmp_path):
    texts = ["a,b", 'say "so"', "", None, "two\nlines", " x "]
    rows = [(at, at % 3, at // 2, at % 2, (at, text), text) for at, text in enumerate(texts)]
    schema = "user_id bigint, item_id bigint, event_time bigint, label int, tie struct<a: int, b: string>, note string"
    frame = spark.createDataFrame(rows, schema)
    sinks.write_splits_csv(cuts.Splits(frame, frame.limit(2), frame.limit(1), frame), str(tmp_path))
    back = sources.read_splits_csv(spark, str(tmp_path))
    assert back.train.schema == frame.schema
    assert back.train.orderBy("event_time", "tie").collect() == frame.orderBy("event_time", "tie").collect()
    spark.range(1).write.mode("overwrite").option("header", True).csv(str(tmp_path / "test.csv.gz"))
    with pytest.raises(ValueError, match="columns"):
        sources.read_splits_csv(spark, str(tmp_path))


def test_a_folder_of_part_files_counts_as_one_file(spark, tmp_path):
    spark.range(5).repartition(3).write.csv(str(tmp_path / "deep" / "log.csv"))
    assert sources.find_unique_file(spark, str(tmp_path), "log.csv").endswith("/deep/log.csv")


def test_missing_split_is_reported(spark, tmp_path):
    path = str(tmp_path / "part")
    found = split(spark, HISTORY, FUTURE)
    found.stacked().filter("split != 'test'").write.partitionBy("split").parquet(path)
    with pytest.raises(FileNotFoundError, match="test"):
        sources.load_prepared(spark, path)


def test_reader_checks_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.find_unique_file(spark, str(tmp_path), "log.csv")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "log.csv").write_text("user_id,video_id\n1,2\n")
    found = sources.find_unique_file(spark, str(tmp_path), "log.csv")
    with pytest.raises(ValueError, match="is_click"):
        sources.read_log(spark, found)
    (tmp_path / "b" / "log.csv").write_text("user_id,video_id,time_ms,is_click\n")
    with pytest.raises(RuntimeError, match="not unique"):
        sources.find_unique_file(spark, str(tmp_path), "log.csv")
    with pytest.raises(ValueError, match="is empty"):
        sources.read_log(spark, str(tmp_path / "b" / "log.csv"))


def test_reader_keeps_other_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("user_id,video_id,time_ms,is_click,tab\n1,2,3,1,x\n")
    row = sources.read_log(spark, str(path)).first()
    assert (row["user_id"], row["item_id"], row["event_time"], row["label"]) == (1, 2, 3, 1)
    assert row["tab"] == "x"


def test_feature_files_need_their_id(spark, tmp_path):
    (tmp_path / sources.USER_FEATURE_FILE).write_text("user_id,register_days\n1,30\n")
    (tmp_path / sources.ITEM_FEATURE_FILE).write_text("id,tag\n1,3\n")
    with pytest.raises(ValueError, match="video_id"):
        sources.load_features(spark, str(tmp_path))
