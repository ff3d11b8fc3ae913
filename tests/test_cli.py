from blockweave.__main__ import main
from blockweave.functions import jpegcore as J
from blockweave.sources import formats


def test_cli(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    raw = J.lcg(32 * 24 * 3).tobytes()
    (src / "a.ppm").write_bytes(formats.write_pnm(32, 24, "rgb", "444-u8-p012", raw))
    assert main(["encode", str(src), str(tmp_path / "out"), "quality=95", "interleaved=yes"]) == 0
    data = (tmp_path / "out" / "a.jpg").read_bytes()
    assert data == J.encode(raw, 32, 24, params=J.Params(quality=95, interleaved=True))
    assert main(["decode", str(tmp_path / "out"), str(tmp_path / "back"), "format=png"]) == 0
    assert formats.load("a.png", (tmp_path / "back" / "a.png").read_bytes())[4] == J.decode(data)[5]
    assert main(["info", str(tmp_path / "out")]) == 0 and "ycbcr-jpeg" in capsys.readouterr().out
    (src / "b.ppm").write_bytes(b"broken")
    assert main(["encode", str(src), str(tmp_path / "out2")]) == 1 and (tmp_path / "out2" / "a.jpg").exists()
    assert main(["options"]) == 0 and "encode quality=75" in capsys.readouterr().out
    (src / "sub").mkdir()
    (src / "sub" / "a.ppm").write_bytes(formats.write_pnm(8, 8, "rgb", "444-u8-p012", bytes(192)))
    assert main(["encode", str(src), str(tmp_path / "out3")]) == 1
    assert J.read((tmp_path / "out3" / "sub" / "a.jpg").read_bytes()).width == 8 and J.read(
        (tmp_path / "out3" / "a.jpg").read_bytes()
    ).width == 32
    assert main(["formats"]) == main(["--version"]) == main([]) == 0 and main(["what", "a", "b"]) == 2
