"""Raw image files: parsing, probing and writing of PNM, PAM, Y4M, BMP, TGA, PNG and headerless data."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from blockweave.functions import jpegcore as J
from blockweave.functions import tables as T


class FormatError(ValueError):
    pass


def file_format(name: str) -> str | None:
    """What a file holds by its extension, whatever its case."""
    return T.EXTENSIONS.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


# Each parser gives (width, height, colour space, pixel format, offset of the samples, or the samples themselves).

_RAW = {
    "RGB": ("rgb", "444-u8-p012"),
    "RGBA": ("rgb", "4444-u8-p0123"),
    "YUV": ("ycbcr-bt709", "444-u8-p012"),
    "YUVA": ("ycbcr-bt709", "4444-u8-p0123"),
    "UYVY": ("ycbcr-bt709", "422-u8-p1020"),
    "I420": ("ycbcr-bt709", "420-u8-p0p1p2"),
    "GRAY": ("ycbcr-jpeg", "u8"),
}


def _tokens(data: bytes, n: int) -> tuple[list[bytes], int]:
    out, at = [], 0
    while len(out) < n:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)").match(data, at)
        if not m:
            raise FormatError("the header ends early")
        out.append(m[1])
        at = m.end()
    return out, at + 1


def parse_pnm(data: bytes):
    (magic, w, h, top), at = _tokens(data, 4)
    if magic not in (b"P5", b"P6") or int(top) != 255:
        raise FormatError("only P5 and P6 with a maximum of 255 are read")
    return int(w), int(h), *(("rgb", "444-u8-p012") if magic == b"P6" else ("ycbcr-jpeg", "u8")), at


def parse_pam(data: bytes):
    if not data.startswith(b"P7"):
        raise FormatError("not a PAM file")
    end = data.find(b"ENDHDR")
    if end < 0:
        raise FormatError("the header ends early")
    fields = dict(x.split(None, 1) for x in data[2:end].split(b"\n") if len(x.split(None, 1)) == 2 and not x.startswith(b"#"))
    w, h, depth, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    if top != 255 or depth not in (1, 3, 4):
        raise FormatError("only depths 1, 3 and 4 with a maximum of 255 are read")
    cs, pf = {1: ("ycbcr-jpeg", "u8"), 3: ("rgb", "444-u8-p012"), 4: ("rgb", "4444-u8-p0123")}[depth]
    return w, h, cs, pf, data.find(b"\n", end) + 1


_CHROMA = {
    b"420": "420-u8-p0p1p2",
    b"420jpeg": "420-u8-p0p1p2",
    b"420paldv": "420-u8-p0p1p2",
    b"420mpeg2": "420-u8-p0p1p2",
    b"422": "422-u8-p0p1p2",
    b"444": "444-u8-p0p1p2",
    b"mono": "u8",
}


def parse_y4m(data: bytes):
    """The first frame only."""
    end = data.find(b"\n")
    if not data.startswith(b"YUV4MPEG2 ") or end < 0:
        raise FormatError("not a Y4M file")
    words = data[10:end].split()
    field = lambda c, default=None: next((x[1:] for x in words if x[:1] == c), default)
    chroma = field(b"C", b"420")
    if chroma not in _CHROMA:
        raise FormatError(f"chroma {chroma.decode()} is not read")
    full = b"XCOLORRANGE=FULL" in words
    frame = data.find(b"FRAME", end)
    return int(field(b"W")), int(field(b"H")), "ycbcr-jpeg" if full else "ycbcr-bt709", _CHROMA[chroma], data.find(b"\n", frame) + 1


def parse_bmp(data: bytes):
    if data[:2] != b"BM":
        raise FormatError("not a BMP file")
    at, _, w, h, _, depth, packing = struct.unpack("<IIiiHHI", data[10:34])
    if depth not in (8, 24, 32) or packing not in (0, 3):
        raise FormatError("only 8, 24 and 32 bits without compression are read")
    line = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), at).reshape(abs(h), line)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        size = struct.unpack("<I", data[14:18])[0]
        table = np.frombuffer(data[14 + size : at], np.uint8).reshape(-1, 4)[:, 2::-1]
        return w, abs(h), "rgb", "444-u8-p012", table[rows[:, :, 0]].tobytes()
    order = [2, 1, 0, 3][: depth // 8]
    return w, abs(h), "rgb", "444-u8-p012" if depth == 24 else "4444-u8-p0123", rows[:, :, order].tobytes()


def parse_tga(data: bytes):
    n, kind = data[0], data[2]
    w, h, depth, flags = struct.unpack("<HHBB", data[12:18])
    if kind not in (2, 3, 10, 11) or depth not in (8, 24, 32):
        raise FormatError("only true-colour and gray TGA are read")
    b, at, need = depth // 8, 18 + n, w * h
    if kind >= 10:
        out, have = [], 0
        while have < need:
            run = data[at]
            size = (run & 127) + 1
            if run & 128:
                out.append(data[at + 1 : at + 1 + b] * size)
                at += 1 + b
            else:
                out.append(data[at + 1 : at + 1 + b * size])
                at += 1 + b * size
            have += size
        raw = b"".join(out)[: need * b]
    else:
        raw = data[at : at + need * b]
    p = np.frombuffer(raw, np.uint8).reshape(h, w, b)
    p = p if flags & 0x20 else p[::-1]
    if b == 1:
        return w, h, "ycbcr-jpeg", "u8", p.tobytes()
    return w, h, "rgb", "444-u8-p012" if b == 3 else "4444-u8-p0123", p[:, :, [2, 1, 0, 3][:b]].tobytes()


def parse_png(data: bytes):
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FormatError("not a PNG file")
    at, body, palette, clear = 8, [], None, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    if depth != 8 or laced or color not in (0, 2, 3, 4, 6):
        raise FormatError("only 8 bits without interlacing are read")
    b = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w * b + 1)
    out = np.zeros((h + 1, w * b + b), np.int32)  # a border of 0 above and to the left
    for y in range(h):
        mode, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), out[y]
        now = out[y + 1]
        if mode == 0:
            now[b:] = line
        elif mode == 2:
            now[b:] = (line + up[b:]) & 255
        elif mode == 1:
            now[b:] = (np.cumsum(line.reshape(w, b), axis=0) & 255).ravel()
        else:
            for i in range(w * b):
                a, u, c = int(now[i]), int(up[i + b]), int(up[i])
                if mode == 3:
                    guess = (a + u) // 2
                else:
                    pa, pu, pc = abs(u - c), abs(a - c), abs(a + u - 2 * c)
                    guess = a if pa <= pu and pa <= pc else u if pu <= pc else c
                now[i + b] = (line[i] + guess) & 255
    p = out[1:, b:].astype(np.uint8).reshape(h, w, b)
    if color == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        p = np.concatenate([palette, alpha[:, None]], axis=1)[p[:, :, 0]] if clear else palette[p[:, :, 0]]
    elif color == 4:
        p = np.concatenate([np.repeat(p[:, :, :1], 3, axis=2), p[:, :, 1:]], axis=2)
    n = p.shape[2]
    return w, h, "ycbcr-jpeg" if n == 1 else "rgb", {1: "u8", 3: "444-u8-p012", 4: "4444-u8-p0123"}[n], np.ascontiguousarray(p).tobytes()


def _gif_colours(data: bytes, at: int, flags: int, table: np.ndarray) -> int:
    n = 2 << (flags & 7)
    table[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
    return at + 3 * n


def _gif_head(data: bytes):
    """(width, height, background, colours, transparent index or None, where the first frame starts)."""
    if data[:3] != b"GIF":
        raise FormatError("not a GIF file")
    w, h, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    at = 13
    table = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        at = _gif_colours(data, at, flags, table)
    clear = None
    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise FormatError("a GIF without a frame")
        if data[at + 1] == 0xF9 and data[at + 3] & 1:
            clear = data[at + 6]
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    return w, h, back, table, clear, at


def parse_gif(data: bytes):
    """The first frame."""
    w, h, back, table, clear, at = _gif_head(data)
    x0, y0, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
    at += 10
    if flags & 0x80:
        at = _gif_colours(data, at, flags, table)
    least = data[at]
    at += 1
    packed = b""
    while data[at]:
        packed += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    words: list[bytes] = []
    reset, size, old, out, acc, bits = 1 << least, least + 1, None, [], 0, 0
    for byte in packed:
        acc |= byte << bits
        bits += 8
        while bits >= size:
            code = acc & ((1 << size) - 1)
            acc >>= size
            bits -= size
            if code == reset:
                words = [bytes([i]) for i in range(reset)] + [b"", b""]
                size, old = least + 1, None
                continue
            if code == reset + 1:
                break
            if old is None:
                entry = words[code]
            else:
                entry = words[code] if code < len(words) else old + old[:1]
                if len(words) < 4096:
                    words.append(old + entry[:1])
                    if len(words) == 1 << size and size < 12:
                        size += 1
            out.append(entry)
            old = entry
    rows = np.frombuffer(b"".join(out)[: fw * fh].ljust(fw * fh, b"\0"), np.uint8).reshape(fh, fw)
    if flags & 0x40:
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, fh, step)]
        whole = np.zeros_like(rows)
        whole[order] = rows
        rows = whole
    indices = np.full((h, w), back, np.uint8)
    indices[y0 : y0 + fh, x0 : x0 + fw] = rows
    p = table[indices]
    if clear is not None:
        return w, h, "rgb", "4444-u8-p0123", np.concatenate(
            [p, np.where(indices == clear, 0, 255).astype(np.uint8)[:, :, None]], axis=2
        ).tobytes()
    return w, h, "rgb", "444-u8-p012", p.tobytes()


_TST = re.compile(r"(?:.*/)?(\d+)x(\d+)((?:\.[cp]_[^.]+)*)(?:\.(gradient|noise|random|blank)(?:=(\d+))?)?\.tst$", re.I)


def parse_tst(name: str):
    """A synthetic image from its name WIDTHxHEIGHT[.c_SPACE][.p_FORMAT][.PATTERN[=VALUE]].tst."""
    m = _TST.match(name)
    if not m:
        raise FormatError(f"{name!r} names no test image")
    w, h = int(m[1]), int(m[2])
    parts = dict(x.split("_", 1) for x in m[3].split(".") if x)
    cs, pf = T.COLOR_SPACES.get(parts.get("c", "rgb")), parts.get("p", "444-u8-p012")
    if cs is None or pf not in T.PIXEL_FORMATS:
        raise FormatError(f"{name!r} names an unknown colour space or pixel format")
    n = J.image_size(w, h, pf)
    pattern, value = (m[4] or "gradient").lower(), m[5]
    if pattern == "gradient":
        rows = np.repeat((np.arange(h) * 255 // h).astype(np.uint8)[:, None], w, axis=1)
        raw = J.pack(np.repeat(rows[:, :, None], T.PIXEL_FORMATS[pf][1], axis=2), pf)
    elif pattern == "blank":
        raw = bytes([int(value or 0) & 255]) * n
    elif pattern == "random":
        raw = J.lcg(n, int(value or 12345)).tobytes()
    else:
        raw = np.random.default_rng().integers(0, 256, n, np.uint8).tobytes()
    return w, h, cs, pf, raw


PARSERS = {
    "PNM": parse_pnm,
    "PGM": parse_pnm,
    "PPM": parse_pnm,
    "PAM": parse_pam,
    "Y4M": parse_y4m,
    "BMP": parse_bmp,
    "TGA": parse_tga,
    "PNG": parse_png,
    "GIF": parse_gif,
}


def load(name: str, data: bytes, width: int = 0, height: int = 0, color_space: str | None = None, pixel_format: str | None = None):
    """(width, height, colour space, pixel format, samples); headerless files need a size."""
    kind = file_format(name)
    if kind == "TST":
        return parse_tst(name)
    if kind == "JPEG":
        w, h, cs, pf, _, raw = J.decode(data)
        return w, h, cs, pf, raw
    if kind in PARSERS:
        w, h, cs, pf, body = PARSERS[kind](data)
        raw = body if isinstance(body, bytes) else data[body : body + J.image_size(w, h, pf)]
        if len(raw) < J.image_size(w, h, pf):
            raise FormatError(f"{name} ends early")
        return w, h, cs, pf, raw
    cs, pf = _RAW.get(kind or "", ("rgb", "444-u8-p012"))
    cs, pf = color_space or cs, pixel_format or pf
    if not width or not height:
        raise FormatError(f"{name} has no header, so its size must be given")
    return width, height, cs, pf, data[: J.image_size(width, height, pf)]


def probe(name: str, head: bytes):
    """(width, height, colour space, pixel format) from the head of a file, without its samples where the format allows."""
    kind = file_format(name)
    if kind == "JPEG":
        j = J.read(head, stop_at_scan=True)
        return j.width, j.height, j.color_space, J.native_format(len(j.ids), j.sampling, j.interleaved)
    if kind == "PNG":
        w, h, _, color = struct.unpack(">IIBB", head[16:26])
        return w, h, "rgb" if color else "ycbcr-jpeg", {
            0: "u8", 2: "444-u8-p012", 3: "444-u8-p012", 4: "4444-u8-p0123", 6: "4444-u8-p0123"
        }[color]
    if kind == "BMP":
        w, h, _, depth = struct.unpack("<iiHH", head[18:30])
        return w, abs(h), "rgb", "4444-u8-p0123" if depth == 32 else "444-u8-p012"
    if kind == "TGA":
        w, h, depth = struct.unpack("<HHB", head[12:17])
        return w, h, "ycbcr-jpeg" if depth == 8 else "rgb", {8: "u8", 24: "444-u8-p012", 32: "4444-u8-p0123"}[depth]
    if kind == "GIF":
        w, h, _, _, clear, _ = _gif_head(head)
        return w, h, "rgb", "444-u8-p012" if clear is None else "4444-u8-p0123"
    if kind in ("PNM", "PGM", "PPM", "PAM", "Y4M"):
        return PARSERS[kind](head)[:4]
    if kind == "TST":
        return parse_tst(name)[:4]
    raise FormatError(f"{name} has no header")


# ---- writing --------------------------------------------------------------------


def _packed(raw: bytes, w: int, h: int, pf: str, allowed) -> np.ndarray:
    if pf not in allowed:
        raise FormatError(f"{pf} cannot be written to this format")
    return J.unpack(raw, w, h, pf)


def write_pnm(w, h, cs, pf, raw) -> bytes:
    p = _packed(raw, w, h, pf, ("u8", "444-u8-p012"))
    if pf != "u8" and cs != "rgb":
        raise FormatError("only RGB and gray are written")
    return f"P{5 if pf == 'u8' else 6}\n{w} {h}\n255\n".encode() + p.tobytes()


def write_pam(w, h, cs, pf, raw) -> bytes:
    p = _packed(raw, w, h, pf, ("u8", "444-u8-p012", "4444-u8-p0123"))
    if pf != "u8" and cs != "rgb":
        raise FormatError("only RGB and gray are written")
    n = p.shape[2]
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {n}\nMAXVAL 255\nTUPLTYPE {
        {1: 'GRAYSCALE', 3: 'RGB', 4: 'RGB_ALPHA'}[n]
    }\nENDHDR\n".encode() + p.tobytes()


def write_y4m(w, h, cs, pf, raw) -> bytes:
    chroma = {"u8": "mono", "420-u8-p0p1p2": "420", "422-u8-p0p1p2": "422", "444-u8-p0p1p2": "444"}.get(pf)
    if chroma is None or cs == "rgb":
        raise FormatError("only planar images that are not RGB are written")
    return f"YUV4MPEG2 W{w} H{h} F25:1 Ip A0:0 C{chroma} XCOLORRANGE={'FULL' if cs == 'ycbcr-jpeg' else 'LIMITED'}\nFRAME\n".encode() + raw[
        : J.image_size(w, h, pf)
    ]


def write_bmp(w, h, cs, pf, raw) -> bytes:
    p = J.widen(_packed(raw, w, h, pf, ("u8", "444-u8-p012", "4444-u8-p0123")), 4 if pf == "4444-u8-p0123" else 3, "rgb")
    b = p.shape[2]
    line = -(-w * b // 4) * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * b] = p[::-1][:, :, [2, 1, 0, 3][:b]].reshape(h, w * b)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + line * h, 0, 54, 40, w, h, 1, 8 * b, 0, line * h, 0, 0, 0, 0) + rows.tobytes()


def write_tga(w, h, cs, pf, raw, rle: bool = False) -> bytes:
    p = _packed(raw, w, h, pf, ("u8", "444-u8-p012", "4444-u8-p0123"))
    b = p.shape[2]
    p = p if b == 1 else p[:, :, [2, 1, 0, 3][:b]]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, (3 if b == 1 else 2) + 8 * rle, 0, 0, 0, 0, 0, w, h, 8 * b, 0x20 | (8 if b == 4 else 0))
    if not rle:
        return head + np.ascontiguousarray(p).tobytes()
    out = [head]
    for row in p:
        same = np.concatenate([[False], (row[1:] == row[:-1]).all(axis=1), [False]])
        x = 0
        while x < w:
            n = 1
            if same[x + 1]:
                while n < 128 and x + n < w and same[x + n]:
                    n += 1
                out.append(bytes([127 + n]) + row[x].tobytes())
            else:
                while n < 128 and x + n < w and not same[x + n + 1]:
                    n += 1
                out.append(bytes([n - 1]) + np.ascontiguousarray(row[x : x + n]).tobytes())
            x += n
    return b"".join(out)


def write_png(w, h, cs, pf, raw) -> bytes:
    p = _packed(raw, w, h, pf, ("u8", "444-u8-p012", "4444-u8-p0123"))
    color = {1: 0, 3: 2, 4: 6}[p.shape[2]]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(
        b"IDAT", zlib.compress(lines, 6)
    ) + chunk(b"IEND", b"")


WRITERS = {
    "PNM": write_pnm,
    "PGM": write_pnm,
    "PPM": write_pnm,
    "PAM": write_pam,
    "Y4M": write_y4m,
    "BMP": write_bmp,
    "TGA": write_tga,
    "PNG": write_png,
}


def save(name: str, w: int, h: int, cs: str, pf: str, raw: bytes, **options) -> tuple[str, bytes]:
    """(name, bytes) of a file; for the extension XXX the format follows from the image."""
    if name.lower().endswith(".xxx"):
        planar = T.PIXEL_FORMATS[pf][0]
        name = name[:-3] + ("y4m" if planar and cs != "rgb" else "pam" if pf == "4444-u8-p0123" else "pnm")
    kind = file_format(name)
    if kind == "GIF":
        raise FormatError("GIF is not written")
    if kind == "JPEG":
        return name, J.encode(raw, w, h, cs, pf, 0, options.get("params"))
    if kind in WRITERS:
        return name, WRITERS[kind](w, h, cs, pf, raw, **({"rle": True} if kind == "TGA" and options.get("rle") else {}))
    return name, raw
