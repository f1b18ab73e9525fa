import pytest
from pyspark.sql import functions as F

from segflow.operators.checks import room_category
from segflow.sources import listings, sinks


def test_manifest_requires_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("file_id,start_s,speaker_id\na,0.0,x\n")
    with pytest.raises(ValueError, match="end_s"):
        listings.load_manifest(spark, str(tmp_path / "m.csv"))
    (tmp_path / "n.csv").write_text("file_id,start_s,end_s,speaker_id,has_overlap,notes\na,0.0,1.5,x,True,\nb,1,2,y,False,n\nc,1,2,y,maybe,n\n")
    rows = listings.load_manifest(spark, str(tmp_path / "n.csv")).orderBy("file_id").collect()
    assert [r.has_overlap for r in rows] == [True, False, None] and rows[0].end_s == 1.5


def test_speakers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("; comment\n\n14 | f | clean | 25 | A\n 15|M|x\n16 | X | y\n17\n")
    rows = {tuple(r) for r in listings.load_speakers(spark, str(tmp_path / "s.txt")).collect()}
    assert rows == {("14", "F"), ("15", "M")}


def test_clip_catalogue(spark, tmp_path):
    for name in ("s1/ch/a.FLAC", "s1/b.wav", "s2/c.txt", "s3/d.mp3"):
        path = tmp_path / "pool" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12")
    rows = sorted((r.speaker_id, r.path.rsplit("/", 1)[1], r.length) for r in listings.clip_catalogue(spark, str(tmp_path / "pool")).collect())
    assert rows == [("s1", "a.FLAC", 2), ("s1", "b.wav", 2), ("s3", "d.mp3", 2)]


def test_bank_listing(spark, tmp_path):
    root = tmp_path / "BANK"
    names = ["simulated_rirs/smallroom/Room1/r.wav", "simulated_rirs/x/noise1.wav", "pointsource_noises/n.wav", "real_rirs_isotropic_noises/q.WAV", "other/o.wav"]
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"1")
    found = lambda: sorted(r.path for r in listings.bank_listing(spark, str(root)).collect())
    assert found() == ["real_rirs_isotropic_noises/q.WAV", "simulated_rirs/smallroom/Room1/r.wav"]
    (root / "simulated_rirs" / "rir_list").write_text("--rir-id 1 BANK/other/o.wav\n\n--rir-id 2 other/o.wav\n--rir-id 3 BANK/missing.wav\n")
    assert found() == ["other/o.wav"]


def test_room_category(spark):
    cases = {
        "simulated_rirs/smallroom/a.wav": "smallroom",
        "simulated_rirs/largeroom/R/a.wav": "largeroom",
        "simulated_rirs/a.wav": "other",
        "real_rirs_isotropic_noises/a.wav": "real",
        "b.wav": "other",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.c for r in df.select("p", room_category(F.col("p")).alias("c")).collect()} == cases


def test_transcript_fields(spark):
    df = spark.createDataFrame([("é\"x", None, 1.23456, None), ("b", 0.5, 2.0, 0.12345)], "t string, c double, d double, s double")
    entry = sinks.transcript_json(F.timestamp_seconds(F.lit(1704067200)), F.col("t"), F.col("c"), F.col("d"), F.col("s"))
    a, b = [r[0] for r in df.select(entry).collect()]
    assert a == '{"timestamp":"2024-01-01T00:00:00.000000+00:00","text":"é\\"x","confidence":null,"duration_seconds":1.235}'
    assert b.endswith('"confidence":0.5,"duration_seconds":2.0,"segment_start_seconds":0.123}')


def test_stream_transcript_writes_a_repeated_batch_once(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), tmp_path / "cp"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))

    def run(low, high):
        spark.range(low, high).select(F.col("id").cast("string").alias("value")).coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        sinks.stream_transcript(source, out, str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run(0, 5)
    run(5, 8)
    values = lambda: sorted(int(r.value) for r in sinks.read_transcript(spark, out).collect())
    assert values() == list(range(8))
    # the driver fails after the last batch was written and before it was committed: the batch comes again
    for name in ("1", ".1.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    run(8, 9)
    assert values() == list(range(9))
    sinks.write_transcript_batch(spark.createDataFrame([("7",)], "value string"), 99, out)
    sinks.write_transcript_batch(spark.createDataFrame([("7",)], "value string"), 99, out)
    assert values().count(7) == 2  # one from batch 1, one from batch 99


def test_frozen_set_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "set")
    assert sinks.frozen_set(spark, path, make).count() == sinks.frozen_set(spark, path, make).count() == 3
    assert len(calls) == 1


def test_frozen_set_is_tied_to_seed_recipe_and_content(spark, tmp_path):
    path, make = str(tmp_path / "set"), lambda: spark.range(20)
    assert sinks.frozen_set(spark, path, make, 1, ("a", 0.5)).count() == 20
    for seed, recipe in ((2, ("a", 0.5)), (1, ("a", 0.6)), (None, None)):
        with pytest.raises(ValueError, match="was made with"):
            sinks.frozen_set(spark, path, make, seed, recipe)
    folder = next(p for p in (tmp_path / "set").iterdir() if p.name.startswith("set-"))
    spark.range(1).write.mode("append").parquet(str(folder))
    with pytest.raises(ValueError, match="has changed"):
        sinks.frozen_set(spark, path, make, 1, ("a", 0.5))


def test_a_broken_first_write_is_made_again(spark, tmp_path):
    path = str(tmp_path / "set")

    def broken():
        spark.range(7).write.parquet(f"{path}/set-left-behind")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sinks.frozen_set(spark, path, broken, 1)
    assert sinks.frozen_set(spark, path, lambda: spark.range(3), 1).count() == 3
    assert sinks.frozen_set(spark, path, broken, 1).count() == 3
