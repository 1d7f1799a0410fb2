"""Files in and out, and the service."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrove.operators import assign as A
from vecgrove.operators.tree import build_tree, sample_leaders
from vecgrove.sources import files, images, results
from vecgrove.sources import vectors as V
from vecgrove.streaming.service import Service


def test_raw_descriptors(spark, tmp_path):
    x = np.arange(-128, 128, dtype=np.int16).astype(np.int8)
    (tmp_path / "7.sift").write_bytes(x.tobytes())
    (tmp_path / "8.sift").write_bytes(b"short")
    (tmp_path / "x.sift").write_bytes(x.tobytes())
    got = {r["key"]: (r["id"], list(r["vec"])) for r in V.raw_descriptors(spark, str(tmp_path)).collect()}
    assert got == {"7_0": (7, x[:128].tolist()), "7_1": (7, x[128:].tolist())}


@pytest.mark.parametrize("whole", [1 << 20, 640, 64])
def test_raw_descriptors_of_large_files(spark, tmp_path, monkeypatch, whole):
    """Files written in ranges and read in splits, beside ones read whole: no image's vectors gather in one row."""
    monkeypatch.setattr(V, "WHOLE", whole)
    monkeypatch.setattr(V, "_ROWS", 7)
    x = np.random.default_rng(3).integers(-128, 128, (400, 16))
    image = [5 if i < 300 else -3 if i < 395 else 6 for i in range(400)]
    v = spark.createDataFrame([((i * 77) % 1000, image[i], x[i].tolist()) for i in range(400)], "id bigint, image_id bigint, vec array<int>")
    V.write_raw_descriptors(v.repartition(3), str(tmp_path / "raw"))
    want = {}
    for n in set(image):
        own = sorted(((i * 77) % 1000, i) for i in range(400) if image[i] == n)
        assert (tmp_path / "raw" / f"{n}.sift").read_bytes() == b"".join(x[i].astype(np.int8).tobytes() for _, i in own)
        want |= {f"{n}_{k}": (n, x[i].tolist()) for k, (_, i) in enumerate(own)}
    (tmp_path / "raw" / "8.sift").write_bytes(b"x" * 1001)
    got = [(r["key"], (r["id"], list(r["vec"]))) for r in V.raw_descriptors(spark, str(tmp_path / "raw"), 16).collect()]
    assert len(got) == 400 and dict(got) == want
    (tmp_path / "raw").rename(tmp_path / "a,[b]")
    again = V.raw_descriptors(spark, str(tmp_path / "a,\\[b\\]"), 16)
    assert {r["key"]: (r["id"], list(r["vec"])) for r in again.collect()} == want
    with pytest.raises(Exception, match="without a value"):
        V.write_raw_descriptors(v.selectExpr("id", "image_id", "array(1, null) AS vec"), str(tmp_path / "null"))


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1:0:55:9\n1000 : 1000\n2:1:66\nbad\n")
    assert sorted(map(tuple, V.ground_truth(spark, str(tmp_path / "g.txt")).collect())) == [(1, 55), (2, 66)]


def test_databases_and_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(i, [i, -i]) for i in range(30)], "id bigint, vec array<int>")
    index = build_tree(sample_leaders(v, 9), 2)
    V.save_index(index, str(tmp_path / "index"))
    again = V.load_index(spark, str(tmp_path / "index"))
    assert (again.n_leaders, again.levels) == (9, 2)
    db = A.database(v, again)
    A.save_database(db, str(tmp_path / "db"), "both")
    flat = V.read_database(spark, f"{tmp_path}/db/sorted")
    grouped = V.read_database(spark, f"{tmp_path}/db/grouped", "grouped")
    assert sorted(map(str, flat.select("cluster_id", "id", "vec").collect())) == sorted(map(str, grouped.collect()))
    assert V.read_database(spark, f"{tmp_path}/db/sorted--{tmp_path}/db/sorted").count() == 60
    for bad in (lambda: A.save_database(db, "x", "no"), lambda: V.read_database(spark, "x", "no")):
        with pytest.raises(ValueError):
            bad()


def test_image_descriptors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "5.jpg").write_bytes(bytes([10, 20]))
    (tmp_path / "sub" / "name.JPG").write_bytes(bytes([30]))
    (tmp_path / "sub" / "bad.jpg").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"x")

    def detect(content):
        if not content:
            raise ValueError("broken")
        return [[b / 100, 0.5, 0.6] for b in content]

    found = images.descriptors(images.image_files(spark, str(tmp_path)), detect)
    rows = sorted((r["query_image"].rsplit("/", 1)[-1], r["qp_no"], list(r["vec"])) for r in found.collect())
    assert rows == [("5.jpg", 0, [-76, -128, -77 + 256 - 256]), ("5.jpg", 1, [-25, -128, -77]), ("name.JPG", 0, [25, -128, -77])]
    assert {r["image_id"] for r in found.where(F.endswith("query_image", F.lit("5.jpg"))).collect()} == {5}
    stats = images.extraction_stats(found).first()
    assert (stats["images"], stats["descriptors"], stats["per_image"]) == (2, 3, 1.5)


def test_result_files(spark, tmp_path):
    knn = spark.createDataFrame([(3, 1, 8, 4), (3, 2, 9, 5), (12345, 1, 1, 1)], "qid bigint, rank int, id bigint, dist bigint")
    assert results.write_knn_files(knn, str(tmp_path / "k")) == 2
    assert (tmp_path / "k" / "003.knn").read_text() == "3\n\n0 8 4\n1 9 5\n" and (tmp_path / "k" / "12345.knn").exists()
    results.write_knn_text(knn, str(tmp_path / "t"))
    hubs = spark.createDataFrame([(1, 2, 3)], "id bigint, hubness bigint, max_dist bigint")
    results.write_hubness_csv(hubs, str(tmp_path / "h"))
    assert [r["_c0"] for r in spark.read.csv(str(tmp_path / "h")).collect()] == ["1"]
    assert results.read_batch_header("1:2:3:4:") == {"b": 1, "k": 2, "m": 3, "seconds": 4}
    assert results.read_batch_header("1:2:3:4:0.5:")["queries"] == 4
    assert results.move_into_database("/x/1.jpg", 7, "/db") == "/db/7.jpg"
    assert "<img" in results.result_page("a&b.jpg", [("c.jpg", 3)])


@pytest.fixture
def service(spark, tmp_path):
    v = spark.createDataFrame([(i, i // 5, [i * 3, i % 7]) for i in range(50)], "id bigint, image_id bigint, vec array<int>")
    index = build_tree(sample_leaders(v, 6), 1)

    def points(names):
        paths = v.withColumn("query_image", F.concat(F.lit("/img/"), F.col("image_id").cast("string"))).withColumnRenamed("id", "qid")
        return paths.join(names, "query_image").select("qid", "query_image", "vec")

    return Service(spark, A.database(v, index), index, points, str(tmp_path / "out"))


def test_service_answers_batches_and_halts(service, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.batch").write_text("3:5:10\n/img/1\n/img/2\n/img/none\n")
    (box / "b.batch").write_text("x:y:z\n/img/3\n")
    (box / "empty.batch").write_text("1:5:10\n")
    (box / "save.batch").write_text(f"parquet\n{tmp_path}/saved\n")
    service.run(str(box), once=True)
    head = (tmp_path / "out/a/batch.res").read_text().splitlines()
    assert head[0].startswith("3:5:10:2:") and len(head) == 3
    lines = (tmp_path / "out/a/#img#1.res").read_text().splitlines()
    assert lines[0] == "/img/1:5:" and lines[1].startswith("1.jpg:5:")
    assert (tmp_path / "out/b/batch.res").read_text().startswith("1:20:100:1:")
    assert not (tmp_path / "out/empty").exists() and (tmp_path / "saved").exists()
    assert not list(box.glob("*.batch"))
    (box / "halt.batch").write_text("")
    service.run(str(box), every="100 milliseconds")
    assert service.halted


def test_service_uses_bags(service):
    assert service.answer("c.batch", "1:5:10\n/img/4\n/img/999\n").name == "c"
    assert service.answer("c.batch", "1:5:10\n/img/4\n").name.startswith("c_")


def png(grey):
    """A grey image file."""
    h, w = grey.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + r.tobytes() for r in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_decoded_and_resized(spark, tmp_path):
    wide = np.tile(np.array([10, 30, 50, 70], np.uint8), (6, 25))
    (tmp_path / "1.png").write_bytes(png(wide))
    (tmp_path / "2.png").write_bytes(png(wide.T.copy()))
    (tmp_path / "3.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in images.decoded_images(spark, str(tmp_path), edge=50).collect()}
    assert set(got) == {"1.png", "2.png"}
    assert (got["1.png"]["height"], got["1.png"]["width"]) == (3, 50) and (got["2.png"]["height"], got["2.png"]["width"]) == (50, 3)
    assert np.frombuffer(got["1.png"]["pixels"], np.uint8).reshape(3, 50).tolist() == [[20, 60] * 25] * 3
    whole = {r["width"] for r in images.decoded_images(spark, str(tmp_path), edge=1000).collect()}
    assert whole == {100, 6}
    assert images.resized_to(np.full((7, 5), 9, np.uint8), 3).tolist() == [[9, 9]] * 3


def test_dense_descriptors_and_an_index_from_images(spark, tmp_path):
    """From image files to an index and an extended database, with the detector that needs no library."""
    rng = np.random.default_rng(4)
    for i in range(6):
        (tmp_path / f"{i}.png").write_bytes(png(rng.integers(0, 255, (40, 48), dtype=np.uint8)))
    grey = rng.integers(0, 255, (40, 48), dtype=np.uint8)
    found = images.dense_descriptors(grey)
    assert found.shape == (4 * 5, 128) and (found >= 0).all() and found.max() <= 0.2
    assert images.dense_descriptors(np.full((40, 48), 7, np.uint8)).shape == (0, 128)
    assert images.dense_descriptors(grey[:3, :3]).shape == (0, 128)

    def detect(content):
        return images.dense_descriptors(np.frombuffer(content, np.uint8).reshape(40, 48))

    decoded = images.decoded_images(spark, str(tmp_path)).selectExpr("path", "pixels AS content")
    points = images.image_points(images.descriptors(decoded.withColumn("path", F.regexp_replace("path", "png$", "jpg")), detect))
    assert points.count() == 120 and points.select("id").distinct().count() == 120
    assert {r["image_id"] for r in points.select("image_id").distinct().collect()} == set(range(6))
    index = build_tree(sample_leaders(points, 10), 2)
    db = A.database(points.where("image_id < 4"), index).select("cluster_id", "id", "image_id", "vec")
    from vecgrove.operators.images import extend_database

    whole = extend_database(db, points.where("image_id >= 4"), index)
    want = A.database(points, index).select("cluster_id", "id", "image_id")
    assert whole.count() == 120 and whole.select("cluster_id", "id", "image_id").exceptAll(want).count() == 0


def test_descriptors_of_a_list(spark, tmp_path):
    (tmp_path / "5.jpg").write_bytes(bytes([10, 20]))
    rows = images.descriptors(images.listed_files(spark, [str(tmp_path / "5.jpg")]), lambda c: [[b / 100] for b in c], scale="unit").collect()
    assert [(r["image_id"], r["qp_no"], list(r["vec"])) for r in rows] == [(5, 0, [12]), (5, 1, [25])]
    assert images.listed_files(spark, []).count() == 0


def test_small_files(spark, tmp_path):
    at = f"{tmp_path}/a b/x%20.txt"
    files.write_text(spark, at, "é1")
    files.write_text(spark, at, "é2")
    assert files.exists(spark, at) and (tmp_path / "a b" / "x%20.txt").read_text() == "é2"
    assert results.move_into_database(at, 7, f"{tmp_path}/a b", spark) == f"{tmp_path}/a b/7.jpg"
    assert not files.exists(spark, at) and (tmp_path / "a b" / "7.jpg").exists()
    results.move_into_database(at, 8, str(tmp_path), spark)
    files.delete(spark, f"{tmp_path}/a b", recursive=True)
    assert not (tmp_path / "a b").exists()


def test_stores_and_batches(spark, tmp_path):
    v = spark.createDataFrame([(i, i, [i, -i]) for i in range(30)], "desc_id bigint, query_id bigint, vec array<int>")
    assert V.save_ground_truth(v, f"{tmp_path}/g") and not V.save_ground_truth(v, f"{tmp_path}/g")
    assert V.load_ground_truth(spark, f"{tmp_path}/g").count() == 30
    results.save_batches(v.withColumn("batch", F.col("desc_id") % 5), f"{tmp_path}/b")
    assert results.load_batches(spark, f"{tmp_path}/b").count() == 30
    assert {r["batch"] for r in results.load_batches(spark, f"{tmp_path}/b", 1, 3).collect()} == {1, 2}
    V.save_descriptors(v, f"{tmp_path}/d")
    assert V.load_descriptors(spark, f"{tmp_path}/d", 7).rdd.getNumPartitions() == 7


def test_samples(spark):
    from vecgrove.operators import sample as S

    v = spark.range(5000)
    got = S.sample_upto(v, 500, seed=3)
    assert abs(got.count() - 500) < 100 and got.exceptAll(S.sample_upto(v.repartition(3), 500, seed=3)).count() == 0
    assert S.sample_upto(v, 5000).count() == 5000 and S.sample_upto(v, 500, seed=4).exceptAll(got).count() > 0
    ids = S.random_ids(spark, 400, 1000)
    assert 250 < ids.count() <= 400 and all(0 <= r["id"] < 1000 for r in ids.collect())
    assert S.absent_ids(spark, 400, 1000, ids).count() == 0


def test_a_service_started_again_goes_on(spark, service, tmp_path):
    """Batch files that stay where they are are answered once, by whichever service comes first."""
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.batch").write_text("3:5:10\n/img/1\n")
    service.remove = False
    service.run(str(box), once=True)
    (box / "b c.batch").write_text("3:5:10\n/img/2\n")
    again = Service(spark, service.db, service.index, service.points_of, service.result_folder, remove=False)
    again.run(str(box), once=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b c"]
    assert len(list(box.glob("*.batch"))) == 2
    again.close()


def test_service_keeps_and_extends_its_database(spark, service):
    assert service.db.storageLevel.useDisk and not service.db.storageLevel.useMemory and service.bags.storageLevel.useMemory
    before = service.db.count()
    new = spark.createDataFrame([(1000 + i, 77, [i * 3, i % 7]) for i in range(5)], "id bigint, image_id bigint, vec array<int>")
    service.extend(new)
    assert service.db.count() == before + 5 and service.db.storageLevel.useDisk
    found = service.answer("z.batch", "10:5:10\n/img/0\n")
    assert "77.jpg:" in (found / "#img#0.res").read_text()
    service.close()
    assert not service.db.storageLevel.useDisk
