import numpy as np
import pytest

from blockweave.functions import jpegcore as J
from blockweave.sources import formats, images
from blockweave.streaming import files as streams

CASES = [
    ("pnm", "u8"),
    ("ppm", "444-u8-p012"),
    ("pam", "u8"),
    ("pam", "444-u8-p012"),
    ("pam", "4444-u8-p0123"),
    ("y4m", "u8"),
    ("y4m", "420-u8-p0p1p2"),
    ("y4m", "422-u8-p0p1p2"),
    ("y4m", "444-u8-p0p1p2"),
    ("bmp", "444-u8-p012"),
    ("bmp", "4444-u8-p0123"),
    ("tga", "u8"),
    ("tga", "444-u8-p012"),
    ("tga", "4444-u8-p0123"),
    ("png", "u8"),
    ("png", "444-u8-p012"),
    ("png", "4444-u8-p0123"),
]


@pytest.mark.parametrize(("ext", "pf"), CASES)
def test_formats(ext, pf):
    cs = "ycbcr-jpeg" if ext == "y4m" or pf == "u8" else "rgb"
    raw = J.lcg(J.image_size(37, 23, pf)).tobytes()
    for options in ({}, {"rle": True}):
        name, file = formats.save(f"a.{ext}", 37, 23, cs, pf, raw, **options)
        assert formats.load(name, file) == (37, 23, cs, pf, raw)
        assert formats.probe(name, file) == (37, 23, cs, pf)


def test_run_length_tga():
    raw = bytes(37 * 23 * 3)
    file = formats.write_tga(37, 23, "rgb", "444-u8-p012", raw, rle=True)
    assert len(file) < 200 and formats.load("a.tga", file)[4] == raw


def test_foreign_png_bmp_gif(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(21, 13, 1)
    p = np.zeros((13, 21, 3), np.uint8)
    for y in range(13):
        for x in range(21):
            p[y, x] = (x // 7 * 100, y // 5 * 90, 30)
            image.setRGB(x, y, int(p[y, x, 0]) << 16 | int(p[y, x, 1]) << 8 | int(p[y, x, 2]))
    for ext in ("png", "bmp", "gif"):
        file = str(tmp_path / f"j.{ext}")
        assert jvm.javax.imageio.ImageIO.write(image, ext, jvm.java.io.File(file))
        w, h, cs, pf, raw = formats.load(file, open(file, "rb").read())
        assert (w, h, cs) == (21, 13, "rgb")
        got = J.unpack(raw, w, h, pf)[:, :, :3].astype(int)
        assert np.abs(got - p).max() <= (30 if ext == "gif" else 0)


def test_extensions_and_choice():
    assert formats.file_format("dir.x/A.JPG") == "JPEG" and formats.file_format("none") is None and formats.file_format("a.txt") is None
    raw = bytes(300)
    assert formats.save("a.XXX", 10, 10, "rgb", "444-u8-p012", raw)[0] == "a.pnm"
    assert formats.save("a.XXX", 10, 10, "rgb", "4444-u8-p0123", bytes(400))[0] == "a.pam"
    assert formats.save("a.XXX", 10, 10, "ycbcr-jpeg", "444-u8-p0p1p2", raw)[0] == "a.y4m"
    assert formats.load("a.rgb", raw, 10, 10)[:4] == (10, 10, "rgb", "444-u8-p012")
    for bad in (
        lambda: formats.save("a.gif", 10, 10, "rgb", "444-u8-p012", raw),
        lambda: formats.load("a.rgb", raw),
        lambda: formats.parse_tst("x.tst"),
        lambda: formats.load("a.ppm", b"P6\n9 9\n255\nxx"),
        lambda: formats.save("a.y4m", 10, 10, "rgb", "444-u8-p0p1p2", raw),
    ):
        with pytest.raises(formats.FormatError):
            bad()


def test_test_images():
    w, h, cs, pf, raw = formats.parse_tst("10x20.tst")
    assert [raw[y * 30] for y in range(20)] == [y * 255 // 20 for y in range(20)]
    assert formats.parse_tst("4x2.p_u8.random.tst")[4] == bytes([68, 211, 23, 138, 98, 90, 241, 156])
    assert formats.parse_tst("4x2.p_u8.blank=7.tst")[4] == bytes([7] * 8)


def test_read_write_probe_and_errors(spark, tmp_path):
    images.register(spark)
    df = spark.read.format("tst").option("names", "16x16.tst;8x8.p_u8.random.tst").load()
    assert df.count() == 2
    images.write_images(
        df.selectExpr("replace(path, '.tst', '.png') path", "width", "height", "color_space", "pixel_format", "data"), str(tmp_path / "out")
    ).collect()
    (tmp_path / "out" / "bad.png").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path / "out")).collect()}
    assert got["16x16.png"].width == 16 and got["8x8.p_u8.random.png"].pixel_format == "u8"
    assert got["bad.png"].data is None and got["bad.png"].error
    with pytest.raises(Exception, match="not a PNG"):
        images.read_images(spark, str(tmp_path / "out"), mode="FAILFAST").collect()
    probed = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in images.probe_images(spark, str(tmp_path / "out")).collect()}
    assert probed["16x16.png"] == (16, 16) and probed["bad.png"] == (None, None)


def test_probe_long_head(spark, tmp_path):
    """A JPEG file whose frame header lies beyond the first 65,536 bytes."""
    _, data = formats.save("a.jpg", 16, 16, "rgb", "444-u8-p012", bytes(768))
    (tmp_path / "long.jpg").write_bytes(data[:2] + 2 * (b"\xff\xe2\xff\xff" + bytes(65533)) + data[2:])
    (tmp_path / "short.jpg").write_bytes(data)
    (tmp_path / "bad.png").write_bytes(bytes(100_000))
    got = {r.path.rsplit("/", 1)[1]: r for r in images.probe_images(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and all((got[n].width, got[n].height, got[n].error) == (16, 16, None) for n in ("long.jpg", "short.jpg"))


IMAGE = "path string, width int, height int, color_space string, pixel_format string, data bytes".replace("bytes", "binary")


def test_written_files_keep_their_folders(spark, tmp_path):
    """Files of one base name in different folders stay apart; each image is encoded once."""
    rows = [(f"file:/in/{sub}/a.png", 4, 2, "rgb", "444-u8-p012", bytes([k] * 24)) for k, sub in enumerate(("x", "y", "y/z"))]
    rows.append(("file:/in/bad.gif", 4, 2, "rgb", "444-u8-p012", bytes(24)))
    df = spark.createDataFrame(rows, IMAGE)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    out = images.write_images(df.mapInPandas(counted, IMAGE), str(tmp_path / "out"), base="/in")
    got = {r.path: (r.file, r.bytes, r.error) for r in out.collect()}
    assert calls.value == 4 and len(got) == 4
    for k, sub in enumerate(("x", "y", "y/z")):
        file, size, error = got[f"file:/in/{sub}/a.png"]
        body = (tmp_path / "out" / sub / "a.png").read_bytes()
        assert (file, size, error) == (f"{sub}/a.png", len(body), None) and formats.load("a.png", body)[4] == bytes([k] * 24)
    assert got["file:/in/bad.gif"][0] is None and "GIF is not written" in got["file:/in/bad.gif"][2]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")) == ["x", "y"]
    assert not [p for p in (tmp_path / "out").rglob("*") if "_writing" in p.name]


def test_clashing_names_are_an_error(spark, tmp_path):
    rows = [(f"file:/in/{sub}/a.png", 4, 2, "rgb", "444-u8-p012", bytes([k] * 24)) for k, sub in enumerate(("x", "y"))]
    with pytest.raises(FileExistsError, match="a.png"):
        images.write_images(spark.createDataFrame(rows, IMAGE), str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.png"))
    images.register(spark)
    files = spark.createDataFrame([("d/a.jpg", b"1"), ("d/./a.jpg", b"2")], "path string, content binary")
    with pytest.raises(Exception, match="written as one file"):
        files.write.format("imagefiles").mode("append").save(str(tmp_path / "out2"))
    assert not list((tmp_path / "out2").rglob("*.jpg"))
    files.where("content = X'31'").write.format("imagefiles").mode("append").save(str(tmp_path / "out2"))
    assert (tmp_path / "out2" / "d" / "a.jpg").read_bytes() == b"1"
    for bad in ("../a.jpg", "/a.jpg", ""):
        with pytest.raises(ValueError, match="no path below"):
            images.Store(str(tmp_path)).at(bad)


def test_probe_reads_heads_only(spark, tmp_path, monkeypatch):
    """A large file is probed by its head; its content is in no plan."""
    (tmp_path / "big.ppm").write_bytes(formats.write_pnm(2000, 1000, "rgb", "444-u8-p012", bytes(6_000_000)))
    df = images.probe_images(spark, str(tmp_path), head=512)
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[-1].split("Relation")[0]
    assert [(r.width, r.height, r.error) for r in df.collect()] == [(2000, 1000, None)]
    monkeypatch.setattr(images, "_known", lambda path: False)
    assert [(r.width, r.height, r.error) for r in images.probe_images(spark, str(tmp_path), head=512).collect()] == [(2000, 1000, None)]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.ppm").write_bytes(formats.write_pnm(20, 10, "rgb", "444-u8-p012", J.lcg(600, k + 1).tobytes()))
    q = streams.encode_stream(spark, str(folder), files_a_batch=1).writeStream.format("memory").queryName("coded").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select * from coded").collect()
    assert len(rows) == 3 and all(J.read(bytes(r.jpeg)).width == 20 for r in rows)
