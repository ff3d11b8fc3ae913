import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockweave.functions import jpegcore as J
from blockweave.functions import tables as T
from blockweave.operators import codec


def smooth(w, h, n):
    base = np.add.outer(np.arange(h) * 3, np.arange(w) * 2) % 200
    return np.stack([(base + 20 * k) // (k + 1) for k in range(n)], axis=2).astype(np.uint8)


def psnr_of(raw, back):
    return J.psnr(np.frombuffer(raw, np.uint8), np.frombuffer(back, np.uint8))


@pytest.mark.parametrize("pf", T.PIXEL_FORMATS)
@pytest.mark.parametrize("interleaved", [False, True])
@pytest.mark.parametrize("restart", [0, 5, None])
def test_round_trip(pf, interleaved, restart):
    n = T.PIXEL_FORMATS[pf][1]
    cs = "rgb" if n == 4 else "ycbcr-jpeg"
    raw = J.pack(smooth(53, 37, n), pf)
    assert len(raw) == J.image_size(53, 37, pf)
    p = J.Params(quality=95, interleaved=interleaved, restart_interval=restart, segment_info=True, comp_count=n, color_space_internal=cs)
    jpeg = J.encode(raw, 53, 37, cs, pf, 0, p)
    back = J.decode(jpeg, cs, pf)
    assert back[:2] == (53, 37) and psnr_of(raw, back[5]) > 40
    assert J.decode(J.reindex(jpeg), cs, pf) == back
    j, plain = J.read(jpeg), J.read(jpeg, use_index=False)
    assert [s[1] for s in j.scans] == [s[1] for s in plain.scans]


def test_published_quality():
    for w, h, pf, q, n, cs, internal, want in (
        (1119, 561, "u8", 75, 1, "ycbcr-jpeg", "ycbcr-jpeg", 28.538),
        (1119, 561, "444-u8-p012", 75, 3, "rgb", "ycbcr-jpeg", 22.262),
        (1119, 561, "4444-u8-p0123", 90, 4, "rgb", "rgb", 36.43),
    ):
        raw = J.lcg(J.image_size(w, h, pf)).tobytes()
        back = J.decode(J.encode(raw, w, h, cs, pf, 0, J.Params(quality=q, comp_count=n, color_space_internal=internal)), cs, pf)[5]
        assert abs(psnr_of(raw, back) - want) < 0.001


def test_zero_and_odd_sizes():
    for w, h in ((1, 1), (16, 16), (7, 9), (32, 1024), (64, 64)):
        for pf in ("u8", "444-u8-p0p1p2", "420-u8-p0p1p2"):
            raw = bytes(J.image_size(w, h, pf))
            cs = "ycbcr-jpeg"
            back = J.decode(J.encode(raw, w, h, cs, pf, 0, J.Params(restart_interval=1)), cs, pf)[5]
            assert back == raw


def test_structure():
    raw = J.lcg(J.image_size(100, 60, "444-u8-p012")).tobytes()
    jpeg = J.encode(raw, 100, 60)
    assert jpeg.startswith(J.SOI) and jpeg.endswith(J.EOI)
    marks = list(J.markers(jpeg))
    dri = next(p for _, c, p in marks if c == 0xDD)
    assert dri == b"\0\x08"
    for _, c, body in marks:
        if c == 0:
            found = [body[i + 1] for i in range(len(body) - 1) if body[i] == 255 and body[i + 1] != 0]
            assert found == [0xD0 + k % 8 for k in range(-(-13 * 8 // 8) - 1)]
    assert J.read(jpeg).segment_count == 3 * 13


def test_lost_segment_loses_those_up_to_the_marker_that_is_due():
    raw = J.lcg(J.image_size(64, 64, "u8")).tobytes()
    jpeg = J.encode(raw, 64, 64, "ycbcr-jpeg", "u8", 0, J.Params(restart_interval=8))
    body = next(p for _, c, p in J.markers(jpeg) if c == 0)
    parts = J.split_scan(body)
    at = len(parts[0]) + 2
    broken = body[:at] + body[at + len(parts[1]) + 2 :]
    again = J.split_scan(broken)  # no marker with the lost one's number follows, as there are eight segments in all
    assert len(parts) == 8 and again == [parts[0], parts[2] + b"\xff\xd2"]


def test_headers_exif_orientation_and_spaces():
    raw = J.pack(smooth(40, 24, 3), "444-u8-p012")
    for cs, header, kind in (
        ("rgb", "default", "Adobe"), ("ycbcr-bt709", "default", "SPIFF"), ("ycbcr-bt601", "JFIF", "JFIF"), ("ycbcr-jpeg", "Exif", "Exif")
    ):
        j = J.read(J.encode(raw, 40, 24, params=J.Params(color_space_internal=cs, header=header)))
        assert (j.color_space, j.header) == (cs, kind)
    for o in T.ORIENTATIONS:
        for header in ("default", "Exif"):
            jpeg = J.encode(raw, 40, 24, params=J.Params(orientation=o, header=header))
            assert J.read(jpeg).orientation == o
            assert J.decode(jpeg)[:2] == (40, 24)
    little = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    assert J.parse_exif(little) == {0x112: 6}


def test_foreign_decoder_reads_our_files(spark, tmp_path):
    """The JVM's own JPEG reader, through Spark's image source."""
    raw = J.pack(smooth(61, 47, 3), "444-u8-p012")
    for k, p in enumerate(
        (
            J.Params(quality=95),
            J.Params(quality=95, interleaved=True, sampling=((2, 2), (1, 1), (1, 1))),
            J.Params(quality=95, interleaved=True, restart_interval=0),
        )
    ):
        (tmp_path / f"{k}.jpg").write_bytes(J.encode(raw, 61, 47, params=p))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.width", "image.height", "image.data", "image.nChannels").collect()
    assert len(rows) == 3
    for r in rows:
        assert (r.width, r.height, r.nChannels) == (61, 47, 3)
        bgr = np.frombuffer(bytes(r.data), np.uint8).reshape(47, 61, 3)
        assert J.psnr(bgr[:, :, ::-1], np.frombuffer(raw, np.uint8).reshape(47, 61, 3)) > 25


def test_our_decoder_reads_foreign_files(spark, tmp_path):
    """Files of the JVM's JPEG writer."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(61, 47, 1)
    p = smooth(61, 47, 3)
    for y in range(47):
        for x in range(61):
            image.setRGB(x, y, int(p[y, x, 0]) << 16 | int(p[y, x, 1]) << 8 | int(p[y, x, 2]))
    file = str(tmp_path / "java.jpg")
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(file))
    w, h, cs, pf, _, raw = J.decode(open(file, "rb").read())
    assert (w, h, cs, pf) == (61, 47, "rgb", "444-u8-p012") and psnr_of(p.tobytes(), raw) > 25


def test_errors():
    with pytest.raises(J.CodingError):
        J.read(b"no image")
    with pytest.raises(J.CodingError):
        J.encode(b"short", 10, 10)
    with pytest.raises(J.CodingError):
        J.convert(np.zeros((1, 1, 3), np.uint8), "rgb", "cmyk")
    with pytest.raises(J.CodingError):
        J.remap(np.zeros((1, 1, 3), np.uint8), "01")
    jpeg = J.encode(bytes(300), 10, 10)
    at = jpeg.index(b"\xff\xc0")
    with pytest.raises(J.CodingError):
        J.read(jpeg[: at + 1] + b"\xc2" + jpeg[at + 2 :])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-1023, 1023), min_size=64, max_size=64), min_size=1, max_size=6), st.integers(0, 63), st.booleans())
def test_any_coefficients_survive_the_bits(blocks, zeros, chroma):
    b = np.array(blocks, np.int16)
    b[:, zeros:] = 0
    comp = np.arange(len(b)) % 2
    kinds = ["luma", "chroma" if chroma else "luma"]
    data = J.pack_segment(b, comp, kinds)
    tables = lambda g: [J.lookup(*T.HUFFMAN[k, g]) for k in kinds]
    assert (J.unpack_segment(data, comp.tolist(), tables("dc"), tables("ac"), 2) == b).all()


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, 255)] * 3), st.sampled_from(sorted(T.TO)), st.sampled_from([*sorted(T.TO), "rgb"]))
def test_colour_arithmetic_matches_the_definition(c, source, target):
    def matrix(v, m, before, after):
        r = [int((x - b) * 256 / 255) for x, b in zip(v, before, strict=True)]  # truncates toward zero
        return [min(255, max(0, ((sum(m[3 * k + i] * r[i] for i in range(3)) + 128) >> 8) + after[k])) for k in range(3)]

    want = list(c)
    if source != target:
        want = matrix(c, T.FROM[source][0], T.FROM[source][1], (0, 0, 0))
        want = want if target == "rgb" else matrix(want, T.TO[target][0], (0, 0, 0), T.TO[target][1])
    assert J.convert(np.array(c, np.uint8).reshape(1, 1, 3), source, target).ravel().tolist() == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=64, max_size=64), min_size=2, max_size=8), st.integers(0, 63), st.data())
def test_segments_side_by_side(blocks, zeros, data):
    b = np.array(blocks, np.int16)
    b[:, zeros:] = 0
    starts = np.array(sorted({0, *data.draw(st.lists(st.integers(0, len(b) - 1), max_size=4))}))
    comp = np.arange(len(b)) % 3
    kinds = ["luma", "chroma", "chroma"]
    bounds = list(zip(starts, [*starts[1:], len(b)], strict=True))
    packed = J.pack_segments(b, comp, starts, kinds)
    assert packed == [J.pack_segment(b[x:y], comp[x:y], kinds) for x, y in bounds]
    tables = tuple([J._lookup(T.HUFFMAN[k, g]) for k in kinds] for g in ("dc", "ac"))
    lanes = J.unpack_side_by_side(packed, [comp[x:y] for x, y in bounds], [tables] * len(bounds))
    assert (np.concatenate(lanes) == b).all()
    short = [p[: len(p) // 2] for p in packed]
    one_by_one = [J.unpack_segment(p, comp[x:y].tolist(), *tables, 3) for p, (x, y) in zip(short, bounds, strict=True)]
    try:
        together = J.unpack_side_by_side(short, [comp[x:y] for x, y in bounds], [tables] * len(bounds))
    except J.CodingError:
        return
    assert all((p == q).all() for p, q in zip(one_by_one, together, strict=True))


def images_frame(spark, rows):
    return spark.createDataFrame(
        rows, "image_id long, width int, height int, color_space string, pixel_format string, width_padding int, data binary"
    )


def test_frames(spark):
    raw = J.pack(smooth(40, 24, 3), "444-u8-p012")
    frame = images_frame(
        spark,
        [(1, 40, 24, "rgb", "444-u8-p012", 0, raw), (2, 40, 24, "rgb", "444-u8-p012", 0, b"short"), (3, 40, 24, "rgb", "nothing", 0, raw)],
    )
    out = {r.image_id: r for r in codec.encode(frame).collect()}
    assert bytes(out[1].jpeg) == J.encode(raw, 40, 24) and out[1].error is None
    assert out[2].jpeg is None and "too few" in out[2].error and out[3].error
    spread = {r.image_id: r for r in codec.encode(frame, spread=True).collect()}
    assert bytes(spread[1].jpeg) == bytes(out[1].jpeg) and spread[2].error and spread[2].jpeg is None
    with pytest.raises(Exception, match="too few"):
        codec.encode(frame.where("image_id = 2"), mode="FAILFAST").collect()
    files = codec.encode(frame).select("image_id", "jpeg").where("jpeg is not null")
    back = codec.decode(files, alignment=16).first()
    assert (back.width, back.height, back.pixel_format, back.error) == (40, 24, "444-u8-p012", None)
    bad = codec.decode(spark.createDataFrame([(9, b"x")], "image_id long, jpeg binary")).first()
    assert bad.data is None and bad.error
    assert codec.encode(frame.limit(0)).count() == 0 and codec.decode(files.limit(0)).count() == 0


def test_options():
    p = codec.options(quality="90", interleaved="yes", restart_interval="auto", flip="1")
    assert (p.quality, p.interleaved, p.restart_interval, p.flip) == (90, True, None, True)
    raw = J.pack(smooth(16, 16, 3), "444-u8-p012")
    once = J.decode(J.encode(raw, 16, 16, params=codec.options(quality=95, flip=True)))[5]
    rows = np.frombuffer(once, np.uint8).reshape(16, 16, 3)
    assert J.psnr(rows[::-1], np.frombuffer(raw, np.uint8).reshape(16, 16, 3)) > 25


def test_rows_are_aligned():
    """Padding of whole pixels makes the bytes of a row a multiple of the alignment, with as few of them as do."""
    raw = J.lcg(5 * 4 * 3).tobytes()
    data = J.encode(raw, 5, 4)
    plain = np.frombuffer(J.decode(data)[5], np.uint8).reshape(4, 15)
    for alignment, pixels in ((0, 0), (1, 0), (3, 0), (16, 11), (32, 27), (6, 1)):
        w, h, _, _, padding, out = J.decode(data, alignment=alignment)
        assert padding == pixels and len(out) == (5 + pixels) * 3 * 4 and (not alignment or (5 + pixels) * 3 % alignment == 0)
        assert (np.frombuffer(out, np.uint8).reshape(4, -1)[:, :15] == plain).all()
        assert J.unpack(out, w, h, "444-u8-p012", padding).tobytes() == plain.tobytes()


def test_markers_out_of_turn():
    """Bytes up to the marker that is due are skipped; without one the rest of the scan is lost."""
    scan = lambda numbers: b"".join(bytes([k]) * 3 + bytes([0xFF, 0xD0 + n % 8]) for k, n in enumerate(numbers)) + b"end"
    assert J.split_scan(scan(range(20))) == [bytes([k]) * 3 for k in range(20)] + [b"end"]
    wrong = [*range(4), 7, *range(5, 20)]
    assert J.split_scan(scan(wrong)) == [bytes([k]) * 3 for k in range(5)] + [bytes([k]) * 3 for k in range(13, 20)] + [b"end"]
    assert J.split_scan(scan([0, 1, 5, 3, 4])) == [b"\0\0\0", b"\1\1\1", b"\2\2\2\xff\xd5"]
    assert J.split_scan(scan([0])[:-3]) == [b"\0\0\0"] and J.split_scan(b"") == []


@pytest.mark.parametrize(
    "params",
    [{}, {"interleaved": True, "sampling": ((2, 2), (1, 1), (1, 1))}, {"sampling": ((2, 1), (1, 1), (1, 1)), "restart_interval": 3}],
)
def test_decode_in_bands(spark, params):
    """Images of more than one band, with a broken file and one that lost its last segments, as in one task each."""
    files = [(k, J.encode(J.lcg(w * h * 3, k + 1).tobytes(), w, h, params=J.Params(**params))) for k, (w, h) in enumerate([(70, 300), (33, 17), (130, 129)])]
    at = files[0][1].rindex(b"\xff\xd0")
    files += [(10, files[0][1][:at] + b"\xff\xd9"), (11, b"broken")]
    df = spark.createDataFrame(files, "image_id long, jpeg binary")
    for options in ({}, {"alignment": 16, "remap": "210"}, {"color_space": "ycbcr-jpeg", "pixel_format": "420-u8-p0p1p2"}, {"flip": True}):
        key = lambda rows: sorted(
            (r.image_id, r.width, r.height, r.pixel_format, r.width_padding, r.data and bytes(r.data), r.error) for r in rows
        )
        assert key(codec.decode(df, spread=True, **options).collect()) == key(codec.decode(df, **options).collect())


def test_durations(spark):
    df = spark.createDataFrame([(1, 64, 64, "rgb", "444-u8-p012", 0, J.lcg(64 * 64 * 3).tobytes())], codec.IMAGES)
    got = [(r.stage, r.milliseconds) for r in codec.durations(df).collect()]
    assert len(got) == len(dict(got)) == 6 and all(ms > 0 for _, ms in got)


@pytest.mark.parametrize(
    ("pf", "params"),
    [
        ("444-u8-p012", {}),
        ("444-u8-p012", {"interleaved": True, "sampling": ((2, 2), (1, 1), (1, 1)), "restart_interval": 7}),
        ("444-u8-p012", {"sampling": ((2, 1), (1, 1), (1, 1)), "restart_interval": 0, "flip": True}),
        ("420-u8-p0p1p2", {"color_space_internal": "ycbcr-jpeg", "restart_interval": 5}),
        ("420-u8-p0p1p2", {"sampling": ((1, 1), (1, 1), (1, 1)), "interleaved": True, "restart_interval": 0}),
        ("422-u8-p1020", {"restart_interval": None}),
        ("4444-u8-p0123", {"comp_count": 4, "quality": 90}),
        ("u8", {"interleaved": True}),
    ],
)
def test_encode_in_bands(spark, pf, params):
    """Images of several bands, and one that is too short, give the files that a task for each image gives."""
    sizes = [(70, 300), (33, 17), (131, 257)]
    cs = "ycbcr-jpeg" if "p0p1p2" in pf else "rgb"
    rows = [(k, w, h, cs, pf, 3 * (k == 0 and T.PIXEL_FORMATS[pf][2] > 0), J.lcg(J.image_size(w, h, pf, 3), k + 1).tobytes()) for k, (w, h) in enumerate(sizes)]
    rows.append((9, 50, 50, cs, pf, 0, b"short"))
    df = spark.createDataFrame(rows, codec.IMAGES)
    key = lambda out: sorted((r.image_id, r.jpeg and bytes(r.jpeg), r.error) for r in out.collect())
    p = J.Params(**params)
    assert key(codec.encode(df, p, spread=True)) == key(codec.encode(df, p))
