from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.functions import vectors as V
from simlake.functions.vectors import is_image
from simlake.operators import images, stats
from simlake.operators.codebook import Codebook
from simlake.sources import archives, datasets, drawing, hdf5, matfiles, records, reports
from simlake.streaming import scoring as streaming


def png(a: np.ndarray) -> bytes:
    """An (H, W, 3) picture as a PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    made = {}
    for name in ("image_2.PNG", "image_1.png", "image_3.png"):
        made[name] = rng.integers(0, 256, (4, 5, 3), np.uint8)
        (tmp_path / name).write_bytes(png(made[name]))
    (tmp_path / "notes.txt").write_text("no image")
    return tmp_path, made


def test_paths_are_numbered_in_order_of_names(spark, folder):
    rows = datasets.image_paths(spark, str(folder[0]), ".png").collect()
    assert [(r["image_id"], r["path"].split("/")[-1]) for r in rows] == [(1, "image_1.png"), (2, "image_2.PNG"), (3, "image_3.png")]


def test_decoding_and_extracting(spark, folder):
    where, made = folder
    own = datasets.decoded(spark, str(where), ".png")
    assert own.where(is_image(F.col("image"))).count() == 3
    corner = images.Extractor(lambda a: a[0, :2].astype(float), 3).descriptors(own)
    got = {(r["image"].split("/")[-1], r["desc"]): r["x"] for r in corner.collect()}
    assert got["image_1.png", 1] == made["image_1.png"][0, 1].tolist()  # red, green, blue
    assert images.Extractor(lambda a: None, 3).descriptors(own).count() == 0
    whole = {r["image"].split("/")[-1]: r["bag"] for r in images.Extractor(lambda a: None if a[0, 0, 0] % 2 else a[0, :2].astype(float), 3).bags(own).collect()}
    assert whole == {n: [] if a[0, 0, 0] % 2 else a[0, :2].tolist() for n, a in made.items()}
    with pytest.raises(Exception, match="gave shape"):
        images.Extractor(lambda a: a[0, :2, :2], 3).descriptors(own).collect()
    with pytest.raises(ValueError):
        images.Extractor(None, 3)


def test_blur_keeps_constants_and_checks_sizes(spark):
    assert np.allclose(images.blurred(np.full((9, 9), 3.0)), 3)
    delta = np.zeros((15, 15))
    delta[7, 7] = 1
    assert images.blurred(delta).sum() == pytest.approx(1) and images.blurred(delta)[7, 7] == pytest.approx(images.gaussian_kernel()[3] ** 2)
    for size in (5, 13):
        with pytest.raises(ValueError):
            images.gaussian_kernel(size, 1.0)


def test_purposes(spark):
    for bad in (["train", "train"], "other"):
        with pytest.raises(ValueError):
            datasets.checked_purposes(bad)
    ids = spark.createDataFrame([("train", 1), ("test", 2), ("validation", 3)], "split string, image_id int")
    assert {r["split"]: r["image_id"] for r in datasets.split_ids(ids).collect()} == {"test": 1, "train": 2, "validation": 3}


def test_a_split_that_is_missing_is_told(spark):
    t = lambda n: spark.range(n)
    splits = spark.createDataFrame([("train", 1), ("train", 2), ("other", 3)], "split string, image_id int")
    got = {r["part"]: (r["n"], r["expected"], r["ok"]) for r in datasets.integrity(t(3), t(3), splits, {"labels": 3, "images": 4, "train": 2, "validation": 1, "test": 0}).collect()}
    assert got == {"labels": (3, 3, True), "images": (3, 4, False), "train": (2, 2, True), "validation": (0, 1, False), "test": (0, 0, True), "other": (1, None, False)}


def element(kind, data, small=False):
    if small:
        return struct.pack("<HH", kind, len(data)) + data.ljust(4, b"\0")
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, a, kind, of):
    """A numeric array as a data element: flags, dimensions, name, values in column order."""
    body = element(6, struct.pack("<II", of, 0)) + element(5, struct.pack("<ii", *a.shape)) + element(1, name.encode(), len(name) <= 4) + element(kind, a.ravel(order="F").tobytes(), a.nbytes <= 4)
    return element(14, body)


def test_mat_files(spark, tmp_path):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    labels, ids = np.array([[3, 1, 2, 2]], "u1"), np.array([[7, 4, 1]], "<u2")
    text = element(14, element(6, struct.pack("<II", 4, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, b"note") + element(4, b"x\0"))
    packed = zlib.compress(matrix("labels", labels, 2, 9))
    (tmp_path / "labels.mat").write_bytes(head + text + struct.pack("<II", 15, len(packed)) + packed)
    (tmp_path / "ids.mat").write_bytes(head + matrix("trn", ids, 4, 6) + matrix("grid", np.array([[1.5, 2], [3, 4]]), 9, 6))
    assert {r["image_id"]: r["label"] for r in matfiles.labels(spark, f"{tmp_path}/labels.mat").collect()} == {1: 3, 2: 1, 3: 2, 4: 2}
    got = matfiles.split_ids(spark, f"{tmp_path}/ids.mat", {"trn": "train"})
    assert sorted((r["split"], r["image_id"]) for r in datasets.split_ids(got).collect()) == [("test", 1), ("test", 4), ("test", 7)]
    assert matfiles.arrays((tmp_path / "ids.mat").read_bytes())["grid"].tolist() == [[1.5, 2], [3, 4]]
    with pytest.raises(ValueError):
        matfiles.arrays(b"nothing")


def test_functions_that_take_images_refuse_others(spark, folder):
    own = datasets.decoded(spark, str(folder[0]), ".png")

    @images.takes_images()
    def sizes(df):
        return df.select("image.height").collect()

    assert len(sizes(own)) == 3
    with pytest.raises(ValueError):
        sizes(own.select("path"))
    with pytest.raises(ValueError):
        sizes()
    bad = own.withColumn("image", F.col("image").withField("width", F.lit(9)))
    with pytest.raises(Exception, match="not an image"):
        sizes(bad)
    second = images.takes_images(1, names=("third",))(lambda a, b, third=None: third.count())
    assert second(None, own, third=own) == 3


def test_outliers_are_the_points_past_the_whiskers(spark):
    p = spark.createDataFrame([(0.1, float(y)) for y in (1, 2, 3, 4, 100)], "x double, y double")
    assert [r["y"] for r in stats.outliers(p, 2).collect()] == [100]


def test_rows_are_zipped_by_place(spark):
    a, b = spark.createDataFrame([("b",), ("a",), ("c",)], "path string"), spark.createDataFrame([(5, 2), (4, 1)], "label int, at int")
    assert sorted((r["path"], r["label"]) for r in datasets.zipped(a, b, ["path"], ["at"]).collect()) == [("a", 4), ("b", 5)]


def test_records_round_trip(spark, tmp_path):
    record = {"n": 3, "x": 1.5, "s": "é", "m": np.arange(6.0).reshape(2, 3), "in": {"l": [1, 2], "flag": True}, "names": ["a", "b"]}
    records.save_record(spark, record, f"{tmp_path}/r")
    got = records.load_record(spark, f"{tmp_path}/r")
    assert got == {"n": 3, "x": 1.5, "s": "é", "m": [[0, 1, 2], [3, 4, 5]], "in": {"l": [1, 2], "flag": 1}, "names": ["a", "b"]}
    with pytest.raises(TypeError):
        records.save_record(spark, {"x": object()}, f"{tmp_path}/bad")
    records.save_json(spark, {"a": [1, {"b": "ü"}]}, f"{tmp_path}/j")
    assert records.load_json(spark, f"{tmp_path}/j") == {"a": [1, {"b": "ü"}]}


def test_files_are_copied_and_moved(spark, folder, tmp_path):
    where, _ = folder
    assert records.transfer(spark, [f"{where}/image_1.png"], f"{tmp_path}/to") == 1
    assert datasets.exists(spark, f"{tmp_path}/to/image_1.png") and (where / "image_1.png").exists()
    records.transfer(spark, [f"{where}/image_1.png"], f"{tmp_path}/moved", "cut")
    assert not (where / "image_1.png").exists()
    with pytest.raises(ValueError):
        records.transfer(spark, [], f"{tmp_path}/to", "link")


def test_tables_of_charts(spark):
    m = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(2) for c in (2, 0, 1)], "q int, id int, sim double")
    assert {r["row"]: r["cells"] for r in reports.heatmap(m).collect()} == {0: [0, 1, 2], 1: [10, 11, 12]}
    line = reports.line(spark.createDataFrame([(i, 100 - i) for i in range(50)], "x int, y int"), sort_y=True)
    t = reports.ticks(line).orderBy("i").collect()
    assert len(t) == 20 and t[0]["i"] == 0 and t[-1]["i"] == 49 and t[0]["y"] == 51
    assert reports.ticks(line.limit(1)).count() == 1


def test_streams(spark, tmp_path):
    rows = [(i, [float(i % 2) * 5, 1.0], f"2024-01-01 00:{i:02d}:00") for i in range(10)]
    df = spark.createDataFrame(rows, "q long, v array<double>, t string").select("q", "v", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    book = Codebook(np.array([[0.0, 1.0], [5.0, 1.0]]))
    q = streaming.counts(stream(), book, every="5 minutes").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("counted").collect()) == [(0, 2), (0, 3), (1, 2), (1, 3)]
    base = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "id long, v array<double>")
    q = streaming.start_top_k(stream(), base, f"{tmp_path}/out", f"{tmp_path}/cp", 1)
    q.processAllAvailable()
    q.stop()
    got = {r["q"]: r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: 7 if i % 2 else 8 for i in range(10)}


def test_pictures_by_channel(spark):
    chw = [[[0.0, 1.0]], [[0.5, 0.25]], [[1.0, 1.000001]]]
    df = spark.createDataFrame([(chw, [[1.0, 2.0]]), ([[[0.0]], [[2.0]], [[0.0]]], [[1.5]]), ([[[0.0]]], [[1.0], [1.0, 2.0]])], "v array<array<array<double>>>, m array<array<double>>")
    rows = df.select(V.is_channels_first(F.col("v")).alias("a"), V.is_mask(F.col("m")).alias("b"), V.channels_last(F.col("v")).alias("c")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(True, True), (False, False), (False, False)]
    assert rows[0]["c"] == [[[0.0, 0.5, 1.0], [1.0, 0.25, 1.000001]]]


def test_archives(tmp_path):
    import logging
    import tarfile
    import zipfile

    (tmp_path / "a.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.txt", "in/a.txt")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "a.txt", "t.txt")
    assert archives.unpack(tmp_path / "a.zip", tmp_path) and archives.unpack(tmp_path / "a.tar", tmp_path) and not archives.unpack(tmp_path / "a.txt", tmp_path)
    assert (tmp_path / "in/a.txt").exists() and (tmp_path / "t.txt").exists()
    with pytest.raises(ValueError):
        archives.unpack(tmp_path / "bad.zip", tmp_path / "in")
    assert archives.fetch((tmp_path / "a.txt").as_uri(), tmp_path / "b.txt").read_text() == "x"
    archives.set_up_logging(tmp_path / "logs")
    logging.getLogger("simlake").info("hello")
    assert "hello" in (tmp_path / "logs/simlake.log").read_text()


def test_hdf5_round_trip_where_there_is_h5py(tmp_path):
    record = {"n": 3, "s": "é", "m": np.arange(6.0).reshape(2, 3), "in": {"l": [1, 2], "names": ["a", "b"]}}
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            hdf5.save(record, f"{tmp_path}/x.h5")
        return
    hdf5.save(record, f"{tmp_path}/x.h5")
    got = hdf5.load(f"{tmp_path}/x.h5")
    assert got["n"] == 3 and got["s"][0] == "é" and np.array_equal(got["m"], record["m"]) and got["in"]["names"].tolist() == ["a", "b"]


def test_modules_by_name():
    class Model:
        def named_modules(self):
            return [("", self), ("features.0", "first"), ("features.1", "second")]

    assert images.submodule(Model(), "features.1") == "second"
    with pytest.raises(ValueError, match="features.0"):
        images.submodule(Model(), "other")


def test_pictures_have_shapes(tmp_path):
    with pytest.raises(ValueError):
        drawing.picture(np.zeros((2, 2, 4)), f"{tmp_path}/x.png")


def test_drawing_says_what_it_needs(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "i int, x double, y double")
    with pytest.raises(ValueError):
        drawing.barplot(["a"], [], "x.png")
    try:
        drawing.lineplot(df, f"{tmp_path}/x.png")
    except ImportError as e:
        assert "matplotlib" in str(e)


def test_numbered_labels_are_of_single_precision_as_in_sql(spark, tmp_path):
    import duckdb

    from simlake.plans import analysis

    tenths = (np.arange(-32, 32) / 10).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate((tenths, np.nextafter(tenths, np.float32(0))))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = analysis.src2_numbered_labels(spark, str(tmp_path)).select("kind", "image_id", "label").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(analysis.ORACLE_SQL["src2_numbered_labels"]).fetchall())
