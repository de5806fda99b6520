"""TFRecord framing, Example encoding and the data source round trip."""

import struct

import pytest

from seqwright.sources import tfrecord as T


def test_crc32c_check_value():
    assert T.crc32c(b"123456789") == 0xE3069283
    assert T.crc32c(b"") == 0


def test_example_round_trip():
    ex = {"user_list": ("float", [1.0, 1.0, 2.5]), "ids": ("int64", [3, -7, 1 << 40]),
          "name": ("bytes", [b"abc"]), "empty": ("float", [])}
    back = T.decode_example(T.encode_example(ex))
    assert back["user_list"] == ("float", [1.0, 1.0, 2.5])
    assert back["ids"] == ("int64", [3, -7, 1 << 40])
    assert back["name"] == ("bytes", [b"abc"])
    assert back["empty"][1] == []


def test_framing_detects_corruption(tmp_path):
    p = tmp_path / "x.tfrecord"
    rec = T.encode_example({"a": ("int64", [1, 2, 3])})
    p.write_bytes(T.frame(rec) + T.frame(rec))
    assert list(T.read_records(str(p))) == [rec, rec]
    raw = bytearray(p.read_bytes())
    raw[14] ^= 0xFF
    p.write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        list(T.read_records(str(p)))
    assert struct.unpack("<Q", bytes(raw[:8]))[0] == len(rec)


def test_data_source_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F
    from seqwright.sources.tables import events_interactions
    from conftest import SF001
    ev = events_interactions(spark, SF001)
    df = ev.groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("items"),
                                F.count("*").alias("n"), F.first(F.col("user").cast("string")).alias("tag"))
    path = str(tmp_path / "out")
    T.write_tfrecord(df.repartition(3), path)
    back = T.read_tfrecord(spark, path, "user BIGINT, items ARRAY<BIGINT>, n BIGINT, tag STRING, missing ARRAY<FLOAT>")
    got = {r["user"]: (list(r["items"]), r["n"], r["tag"], r["missing"]) for r in back.collect()}
    exp = {r["user"]: (list(r["items"]), r["n"], r["tag"], []) for r in df.collect()}
    assert got == exp


def test_vectorised_crc_and_framing_match_single():
    import os
    import numpy as np
    rng = np.random.default_rng(0)
    recs = [os.urandom(int(n)) for n in rng.integers(0, 700, 300)] + [b"123456789"]
    many = T.crc32c_many(recs)
    assert [int(x) for x in many] == [T.crc32c(r) for r in recs]
    assert int(many[-1]) == 0xE3069283
    assert T.frame_many(recs) == b"".join(T.frame(r) for r in recs)


def _random_batch(rng, n):
    import pyarrow as pa

    def lists(make, kind):
        rows = [None if rng.random() < 0.1 else [make() for _ in range(int(rng.integers(0, 6)))] for _ in range(n)]
        return pa.array(rows, pa.list_(kind))
    return pa.RecordBatch.from_arrays([
        lists(lambda: float(rng.normal()), pa.float32()), lists(lambda: int(rng.integers(-2**62, 2**62)), pa.int64()),
        lists(lambda: "é" * int(rng.integers(0, 200)), pa.string()),
        pa.array([None if rng.random() < 0.2 else int(rng.integers(-3, 300)) for _ in range(n)], pa.int64()),
        pa.array([None if rng.random() < 0.2 else "x" * int(rng.integers(0, 20)) for _ in range(n)], pa.string())], names=["f", "i", "s", "n", "t"])


def test_columns_encode_as_single_records_do():
    import numpy as np
    rng = np.random.default_rng(1)
    kinds = [("f", "float"), ("i", "int64"), ("s", "bytes"), ("n", "int64"), ("t", "bytes")]
    whole = _random_batch(rng, 90)
    for batch in (whole, whole.slice(13, 40), whole.slice(5, 0), _random_batch(rng, 1)):
        got = T.encode_columns(batch, kinds)
        want = []
        for r in batch.to_pylist():
            feats = {}
            for name, kind in kinds:
                v = r[name]
                v = [] if v is None else v if isinstance(v, list) else [v]
                feats[name] = (kind, [x.encode() if isinstance(x, str) else x for x in v])
            want.append(T.encode_example(feats))
        assert [got.data[a:b].tobytes() for a, b in zip(got.off[:-1], got.off[1:])] == want
        assert T.frame_columns(got) == T.frame_many(want)


@pytest.mark.parametrize("split", [40, 1000, 70_000, 1 << 22])
def test_splits_read_every_record_once(tmp_path, split):
    import numpy as np
    rng = np.random.default_rng(split)
    recs = [rng.bytes(int(n)) for n in rng.integers(0, 400, 500)] + [rng.bytes(200_000), b"", b""] + [bytes(300)] * 5
    path = tmp_path / "one.tfrecord"
    path.write_bytes(T.frame_many(recs))
    size = path.stat().st_size
    got = [r for a in range(0, size, split) for r in T.read_records(str(path), start=a, end=min(size, a + split))]
    assert got == recs


def test_one_large_file_gives_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.range(5000).select(F.col("id").cast("float").alias("x"), F.sequence(F.lit(0), F.col("id") % 50).cast("array<float>").alias("v"))
    path = str(tmp_path / "big")
    T.write_tfrecord(df.coalesce(1), path)
    back = T.read_tfrecord(spark, path, "x FLOAT, v ARRAY<FLOAT>", split_bytes=50_000)
    assert back.rdd.getNumPartitions() > 5
    assert sorted(r["x"] for r in back.collect()) == [float(i) for i in range(5000)]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    assert sorted(map(str, T.decoded(files, "x FLOAT, v ARRAY<FLOAT>").collect())) == sorted(map(str, back.collect()))


def test_an_overwrite_that_dies_leaves_the_old_or_the_new_files(spark, tmp_path, monkeypatch):
    import os
    path = str(tmp_path / "out")
    read = lambda: sorted(r["x"] for r in T.read_tfrecord(spark, path, "x BIGINT").collect())
    T.write_tfrecord(spark.range(5).toDF("x").repartition(2), path)
    T.write_tfrecord(spark.range(5, 8).toDF("x").repartition(2), path, mode="append")
    assert read() == list(range(8))
    # by hand, as the job's commit would run: it dies before and after the manifest is renamed
    w = T.TFRecordWriter({"path": path}, spark.range(1).toDF("x").schema, True)
    import pyarrow as pa
    done = w.write(iter([pa.RecordBatch.from_arrays([pa.array([100, 101])], names=["x"])]))
    assert read() == list(range(8))
    real = os.replace
    monkeypatch.setattr(os, "replace", lambda a, b: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        w.commit([done])
    monkeypatch.setattr(os, "replace", real)
    assert read() == list(range(8))
    monkeypatch.setattr(os, "remove", lambda a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        w.commit([done])
    monkeypatch.undo()
    assert read() == [100, 101]
