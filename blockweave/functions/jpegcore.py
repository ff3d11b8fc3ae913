"""Arrays behind the image operators: planes, blocks, transforms, entropy codes and the JPEG container."""

from __future__ import annotations

import dataclasses
import math
import struct
from dataclasses import dataclass, field

import numpy as np

from blockweave.functions import tables as T

ZZ = np.array(T.ZIGZAG)
_D = np.array([[np.sqrt(1 / 8) if u == 0 else 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
INDEX_LIMIT = 65436
CREATOR = "CREATOR: blockweave, quality = "


@dataclass
class Params:
    """How to encode. comp_count 0 takes the format's components, without alpha; restart_interval None suggests one."""

    quality: int = 75
    restart_interval: int | None = 8
    interleaved: bool = False
    segment_info: bool = False
    comp_count: int = 0
    sampling: tuple[tuple[int, int], ...] | None = None
    color_space_internal: str = "ycbcr-jpeg"
    header: str = "default"
    flip: bool = False
    remap: str | None = None
    orientation: tuple[int, bool] | None = None
    exif_tags: dict[int, tuple[str, object]] = field(default_factory=dict)


@dataclass
class Component:
    index: int
    kind: str
    h: int
    v: int
    width: int
    height: int
    data_width: int
    data_height: int
    mcu_x: int
    mcu_y: int
    segment_mcus: int
    segments: int


class CodingError(ValueError):
    pass


def suggest_restart(width: int, height: int, comps: int, subsampled: bool, interleaved: bool) -> int:
    load = width * height * comps / 3e6
    r = 4 if load < 1 else 8 if load < 3 else 10 if load < 9 else 12
    if subsampled and interleaved:
        r //= 2
    return r if interleaved else r * comps


def geometry(width: int, height: int, sampling, restart: int, interleaved: bool, color_space: str = "ycbcr-jpeg") -> list[Component]:
    mh, mv = max(s[0] for s in sampling), max(s[1] for s in sampling)
    up = lambda a, b: -(-a // b)
    out = []
    for i, (h, v) in enumerate(sampling):
        dh, dv = mh // h, mv // v
        w, ht = up(width, dh) * dh * h // mh, up(height, dv) * dv * v // mv
        sx, sy = (8 * h, 8 * v) if interleaved else (8, 8)
        mx, my = up(w, sx), up(ht, sy)
        seg = restart or mx * my
        out.append(Component(i, T.kind_of(i, color_space), h, v, w, ht, mx * sx, my * sy, mx, my, seg, up(mx * my, seg)))
    if interleaved and len({(c.mcu_x, c.mcu_y) for c in out}) > 1:  # the image's MCUs rule
        mx, my = up(width, 8 * mh), up(height, 8 * mv)
        for c in out:
            c.mcu_x, c.mcu_y, c.data_width, c.data_height = mx, my, mx * 8 * c.h, my * 8 * c.v
            c.segment_mcus = restart or mx * my
            c.segments = up(mx * my, c.segment_mcus)
    return out


def image_size(width: int, height: int, pixel_format: str, padding: int = 0) -> int:
    _, comps, bpp, _ = T.PIXEL_FORMATS[pixel_format]
    if bpp:
        return (width + padding) * height * bpp
    half_w, half_h = (width + 1) // 2, (height + 1) // 2
    return width * height + 2 * {"444-u8-p0p1p2": width * height, "422-u8-p0p1p2": half_w * height, "420-u8-p0p1p2": half_w * half_h}[
        pixel_format
    ]


def unpack(data: bytes, width: int, height: int, pixel_format: str, padding: int = 0) -> np.ndarray:
    """height x width x components; subsampled components are repeated."""
    planar, comps, bpp, sampling = T.PIXEL_FORMATS[pixel_format]
    if len(data) < image_size(width, height, pixel_format, padding):
        raise CodingError(f"{len(data)} bytes are too few for {width}x{height} {pixel_format}")
    raw = np.frombuffer(data, np.uint8)
    if not planar:
        line = (width + padding) * bpp
        rows = raw[: line * height].reshape(height, line)[:, : width * bpp]
        if pixel_format == "422-u8-p1020":
            # pairs of pixels as c1 y0 c2 y1; a lone last pixel has its own first chroma and the second of its neighbour
            x = np.arange(width)
            y, even = rows[:, 1::2], rows[:, 0::2]
            odd = np.minimum(x // 2 * 2 + 1, width - 1)
            return np.stack([y, even[:, x // 2 * 2], even[:, odd]], axis=2)
        return rows.reshape(height, width, bpp)
    out, at = [], 0
    mh, mv = sampling[0]
    for k, (h, v) in enumerate(sampling):
        dh, dv = mh // h, mv // v
        w, ht = -(-width // dh), -(-height // dv)
        plane = raw[at : at + w * ht].reshape(ht, w)
        at += w * ht
        out.append(plane[np.arange(height) // dv][:, np.arange(width) // dh])
    return np.stack(out, axis=2)


def pack(pixels: np.ndarray, pixel_format: str, padding: int = 0) -> bytes:
    height, width, _ = pixels.shape
    planar, comps, bpp, sampling = T.PIXEL_FORMATS[pixel_format]
    if not planar:
        if pixel_format == "422-u8-p1020":
            rows = np.zeros((height, width * 2), np.uint8)
            rows[:, 1::2] = pixels[:, :, 0]
            x = np.arange(width)
            rows[:, 0::2] = np.where(x % 2 == 0, pixels[:, :, 1], pixels[:, np.maximum(x - x % 2, 0), 2])
        else:
            rows = pixels[:, :, :comps].reshape(height, width * bpp)
        return np.pad(rows, ((0, 0), (0, padding * bpp))).tobytes()
    mh, mv = sampling[0]
    return b"".join(np.ascontiguousarray(pixels[:: mv // v, :: mh // h, k]).tobytes() for k, (h, v) in enumerate(sampling))


#: c * 256 / 255, truncated toward zero, for c from -255 to 255.
_SCALED = np.array([int(c * 256 / 255) for c in range(-255, 256)], np.int32)


def _matrix(p: np.ndarray, m, shift_in, shift_out) -> np.ndarray:
    r = [_SCALED[p[:, :, k].astype(np.int16) + (255 - shift_in[k])] for k in range(3)]
    out = np.empty((*p.shape[:2], p.shape[2]), np.uint8)
    for k in range(3):
        out[:, :, k] = np.clip(((m[3 * k] * r[0] + m[3 * k + 1] * r[1] + m[3 * k + 2] * r[2] + 128) >> 8) + shift_out[k], 0, 255)
    out[:, :, 3:] = p[:, :, 3:]
    return out


def convert(p: np.ndarray, source: str, target: str) -> np.ndarray:
    """Between colour spaces; those that are not RGB meet in clamped 8-bit RGB."""
    if source == target or "none" in (source, target):
        return p
    for cs in (source, target):
        if cs != "rgb" and cs not in T.TO:
            raise CodingError(f"no such colour space: {cs}")
    if source != "rgb":
        p = _matrix(p, T.FROM[source][0], T.FROM[source][1], (0, 0, 0))
    return p if target == "rgb" else _matrix(p, T.TO[target][0], (0, 0, 0), T.TO[target][1])


def remap(p: np.ndarray, spec: str) -> np.ndarray:
    if len(spec) != p.shape[2] or any(c not in "FZ" and not (c.isdigit() and int(c) < p.shape[2]) for c in spec):
        raise CodingError(f"channel remap {spec!r} does not fit {p.shape[2]} channels")
    fill = {"F": 255, "Z": 0}
    return np.stack([np.full(p.shape[:2], fill[c], np.uint8) if c in fill else p[:, :, int(c)] for c in spec], axis=2)


def widen(p: np.ndarray, comps: int, color_space: str) -> np.ndarray:
    """More or fewer channels: gray repeats in RGB and has neutral chroma elsewhere; alpha is opaque."""
    if p.shape[2] == 1 and comps >= 3:
        gray = p[:, :, 0]
        rest = gray if color_space == "rgb" else np.full_like(gray, 128)
        p = np.stack([gray, rest, rest], axis=2)
    if p.shape[2] == 3 and comps == 4:
        p = np.concatenate([p, np.full((*p.shape[:2], 1), 255, np.uint8)], axis=2)
    return p[:, :, :comps]


def blocks_of(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)


def forward(plane: np.ndarray, q: np.ndarray) -> np.ndarray:
    """rows x columns x 64 quantised coefficients in zig-zag order."""
    b = blocks_of(plane.astype(np.float64) - 128)
    c = (_D @ b @ _D.T).reshape(*b.shape[:2], 64)
    return np.rint(np.round(c / q, 6)).astype(np.int16)[:, :, ZZ]


def inverse(coefs: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The plane of zig-zag coefficients (rows x columns x 64)."""
    rows, cols, _ = coefs.shape
    natural = np.zeros(coefs.shape)
    natural[:, :, ZZ] = coefs
    c = (natural * q).reshape(rows, cols, 8, 8)
    s = _D.T @ c @ _D
    return np.clip(np.rint(np.round(s, 6) + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


# ---- entropy codes --------------------------------------------------------------


def _code_arrays(kind: str, group: str) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in T.codes(kind, group).items():
        code[s], bits[s] = c, n
    return code, bits


_CODE_TABLE, _BITS_TABLE = (np.stack(x) for x in zip(*(_code_arrays(k, g) for k in ("luma", "chroma") for g in ("dc", "ac")), strict=True))


def category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))) + 1).astype(np.int64)


def pack_segments(blocks: np.ndarray, comp: np.ndarray, starts: np.ndarray, kinds: list[str]) -> list[bytes]:
    """Bits of restart segments, all at once: blocks (n x 64, zig-zag, in coding order) of the components ``comp``.

    ``starts`` has the first block of each segment. Every symbol of every block gets its code and the value bits behind it, and a
    running sum of their lengths, anew in each segment, says where its bits go.
    """
    n = len(blocks)
    blocks = blocks.astype(np.int64)
    seg = np.searchsorted(starts, np.arange(n), side="right") - 1
    diff = np.zeros(n, np.int64)
    for c in np.unique(comp):
        at = np.flatnonzero(comp == c)
        fresh = np.concatenate([[True], seg[at][1:] != seg[at][:-1]])
        diff[at] = np.where(fresh, blocks[at, 0], np.diff(blocks[at, 0], prepend=0))
    b, z = np.nonzero(blocks[:, 1:])
    z = z + 1
    first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
    run = z - np.where(first, 0, np.concatenate([[0], z[:-1]])) - 1 if len(b) else z
    value = blocks[b, z]
    cat, dcat = category(value), category(diff)
    if cat.max(initial=0) > 10 or dcat.max(initial=0) > 11:
        raise CodingError("a coefficient has no code")
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, z)
    # Symbols in order: DC, then for each coefficient its runs of 16 zeros and itself, then the end of the block.
    again = np.repeat(np.arange(len(b)), run // 16)
    e = np.flatnonzero(last < 63)
    place = np.concatenate([np.arange(n) * 130, b[again] * 130 + 2 * z[again], b * 130 + 2 * z + 1, e * 130 + 129])
    o = np.argsort(place, kind="stable")
    none, zeros = np.zeros(len(e), np.int64), np.zeros(len(again), np.int64)
    symbol = np.concatenate([dcat, zeros + 0xF0, run % 16 * 16 + cat, none])[o]
    vbits = np.concatenate([dcat, zeros, cat, none])[o]
    val = np.concatenate([diff, zeros, value, none])[o]
    blk = place[o] // 130
    dc = place[o] % 130 == 0
    chroma = np.array([k == "chroma" for k in kinds])[comp[blk]]
    table = chroma * 2 + ~dc
    code, bits = _CODE_TABLE[table, symbol], _BITS_TABLE[table, symbol]
    word, length = (code << vbits) | np.where(val >= 0, val, val - 1 + (1 << vbits)), bits + vbits
    # Each segment starts at a byte of its own; what is left of its last byte are ones.
    end = np.cumsum(length)
    of = seg[blk]
    edges = np.searchsorted(of, np.arange(len(starts) + 1))
    before = np.concatenate([[0], end])[edges]
    size = -(-np.diff(before) // 8)
    base = np.concatenate([[0], np.cumsum(size)])
    start = end - length - before[of] + base[of] * 8
    out = np.ones(int(base[-1]) * 8, np.uint8)
    total = int(end[-1]) if len(end) else 0
    which = np.repeat(np.arange(len(word)), length)
    within = np.arange(total) - (end - length)[which]
    out[start[which] + within] = (word[which] >> (length[which] - 1 - within)) & 1
    packed = np.packbits(out).tobytes()
    return [packed[x:y].replace(b"\xff", b"\xff\x00") for x, y in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def pack_segment(blocks: np.ndarray, comp: np.ndarray, kinds: list[str]) -> bytes:
    return pack_segments(blocks, comp, np.zeros(1, np.int64), kinds)[0]


def lookup(bits, symbols) -> tuple[list[int], list[int]]:
    """For each 16-bit prefix the symbol and the length of its code; length 0 where there is none."""
    sym, size = [0] * 65536, [0] * 65536
    for s, (code, n) in T.canonical(bits, symbols).items():
        lo = code << (16 - n)
        span = 1 << (16 - n)
        if lo + span > 65536:
            raise CodingError("a Huffman table has too many codes")
        sym[lo : lo + span] = [s] * span
        size[lo : lo + span] = [n] * span
    return sym, size


def unpack_segment(data: bytes, plan: list[int], dc: list, ac: list, comps: int) -> np.ndarray:
    """Coefficients (n x 64, zig-zag) of the blocks whose components ``plan`` lists; short data leaves zeros."""
    out = np.zeros((len(plan), 64), np.int32)
    clean = data.replace(b"\xff\x00", b"\xff")
    pos, total = 0, len(clean) * 8
    padded = clean + b"\0" * 8
    last = [0] * comps

    def peek(n):
        byte = pos >> 3
        return (int.from_bytes(padded[byte : byte + 5], "big") >> (40 - (pos & 7) - n)) & ((1 << n) - 1)

    for i, c in enumerate(plan):
        sym, size = dc[c]
        if pos >= total:
            break
        p = peek(16)
        if not size[p]:
            raise CodingError("no such DC code")
        pos += size[p]
        s = sym[p]
        if s:
            v = peek(s)
            pos += s
            last[c] += v if v >> (s - 1) else v - (1 << s) + 1
        out[i, 0] = last[c]
        sym, size = ac[c]
        k = 1
        while k < 64 and pos < total:
            p = peek(16)
            if not size[p]:
                raise CodingError("no such AC code")
            pos += size[p]
            rs = sym[p]
            s = rs & 15
            if not s:
                if rs != 0xF0:
                    break
                k += 16
                continue
            k += rs >> 4
            if k > 63:
                raise CodingError("a run passes the end of a block")
            v = peek(s)
            pos += s
            out[i, k] = v if v >> (s - 1) else v - (1 << s) + 1
            k += 1
    return out


#: Blocks that are packed at once; more take more memory and are no faster.
CHUNK = 2048


def pack_all(segments: list[tuple[np.ndarray, np.ndarray]], kinds: list[str]) -> list[bytes]:
    """Bits of segments (component of each block, blocks), by chunks of so many blocks that memory stays small."""
    out: list[bytes] = []
    at = 0
    while at < len(segments):
        n, to = 0, at
        while to < len(segments) and (to == at or n + len(segments[to][0]) <= CHUNK):
            n += len(segments[to][0])
            to += 1
        part = segments[at:to]
        sizes = np.array([len(c) for c, _ in part])
        out += pack_segments(np.concatenate([b for _, b in part]), np.concatenate([c for c, _ in part]), np.cumsum(sizes) - sizes, kinds)
        at = to
    return out


#: So many segments at least are decoded side by side; fewer go one after another.
LANES = 48


def unpack_side_by_side(parts: list[bytes], plans: list[np.ndarray], tables: list[tuple[list, list]]) -> list[np.ndarray]:
    """unpack_segment for many segments, a symbol of each at a time: segments are the lanes of array operations."""
    clean = [p.replace(b"\xff\x00", b"\xff") for p in parts]
    data = np.frombuffer(b"".join(c + b"\0" * 8 for c in clean), np.uint8).astype(np.int64)
    size = np.array([len(c) for c in clean])
    pos = (np.cumsum(size + 8) - size - 8) * 8
    end = pos + size * 8
    known: dict[int, int] = {}
    rows: list[np.ndarray] = []

    def row(table) -> int:
        if id(table) not in known:
            known[id(table)] = len(rows)
            rows.append(np.array(table[1], np.int32) << 8 | np.array(table[0], np.int32))
        return known[id(table)]

    lanes = np.arange(len(parts))
    n = np.array([len(p) for p in plans])
    first = np.cumsum(n) - n
    comp = np.concatenate(plans).astype(np.int64) if len(plans) else np.zeros(0, np.int64)
    widest = int(comp.max(initial=0)) + 1
    of = np.full((len(parts), widest, 2), -1)
    for lane, (dc, ac) in enumerate(tables):
        for c in range(min(widest, len(dc))):
            if dc[c] is not None:
                of[lane, c] = row(dc[c]), row(ac[c])
    table = np.stack(rows) if rows else np.zeros((1, 65536), np.int32)
    out = np.zeros((int(n.sum()), 64), np.int32)
    last = np.zeros((len(parts), widest), np.int64)
    block, k = first.copy(), np.zeros(len(parts), np.int64)
    stop = first + n
    lanes = lanes[(n > 0) & (size > 0)]
    while len(lanes):
        p, kk, bb = pos[lanes], k[lanes], block[lanes]
        at = p >> 3
        window = data[at] << 32 | data[at + 1] << 24 | data[at + 2] << 16 | data[at + 3] << 8 | data[at + 4]
        room = 40 - (p & 7)
        c = comp[bb]
        is_dc = kk == 0
        found = table[of[lanes, c, (~is_dc).astype(np.int64)], (window >> (room - 16)) & 0xFFFF]
        bits, sym = found >> 8, found & 255
        if not bits.all():
            raise CodingError("no such code")
        s = np.where(is_dc, sym, sym & 15)
        raw = (window >> np.maximum(room - bits - s, 0)) & ((1 << s) - 1)
        value = np.where(s == 0, 0, np.where(raw >> np.maximum(s - 1, 0) > 0, raw, raw - (1 << s) + 1))
        pos[lanes] = p + bits + s
        d = lanes[is_dc]
        last[d, c[is_dc]] += value[is_dc]
        out[bb[is_dc], 0] = last[d, c[is_dc]]
        ac = ~is_dc & (s > 0)
        to = kk + np.where(ac, sym >> 4, 0)
        if (to > 63).any():
            raise CodingError("a run passes the end of a block")
        out[bb[ac], to[ac]] = value[ac]
        kk = np.where(is_dc, 1, np.where(ac, to + 1, np.where(sym == 0xF0, kk + 16, 64)))
        done = kk >= 64
        k[lanes] = np.where(done, 0, kk)
        block[lanes] = bb + done
        lanes = lanes[(block[lanes] < stop[lanes]) & (pos[lanes] < end[lanes])]
    return [out[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def coding_order(comps: list[Component], interleaved: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """For each scan: component, block row and block column of each block in order, MCUs, and MCUs a segment."""
    if not interleaved:
        out = []
        for c in comps:
            by, bx = np.divmod(np.arange(c.mcu_x * c.mcu_y), c.mcu_x)
            out.append((np.full(len(by), c.index), by, bx, c.mcu_x * c.mcu_y, c.segment_mcus))
        return out
    n = comps[0].mcu_x * comps[0].mcu_y
    my, mx = np.divmod(np.arange(n), comps[0].mcu_x)
    cols = [(c.index, y, x, c.h, c.v) for c in comps for y in range(c.v) for x in range(c.h)]
    comp = np.tile([k[0] for k in cols], n)
    by = np.stack([my * v + y for _, y, _, _, v in cols], axis=1).ravel()
    bx = np.stack([mx * h + x for _, _, x, h, _ in cols], axis=1).ravel()
    return [(comp, by, bx, n, comps[0].segment_mcus)]


def direct(color_space: str, pixel_format: str, sampling, comps: int, p: Params) -> bool:
    """Whether a buffer's planes are the components as they are: no colour, channel or sampling change."""
    planar, own, _, of_format = T.PIXEL_FORMATS[pixel_format]
    return (planar or own == 1) and own == comps and not p.remap and (comps == 1 or color_space == p.color_space_internal) and tuple(
        map(tuple, sampling)
    ) == of_format


def planes_in(data: bytes, width: int, height: int, pixel_format: str, comps: list[Component], flip: bool = False) -> list[np.ndarray]:
    """The padded components of a planar buffer, copied without a detour over pixels."""
    raw, at, out = np.frombuffer(data, np.uint8), 0, []
    mh, mv = T.PIXEL_FORMATS[pixel_format][3][0]
    for c, (h, v) in zip(comps, T.PIXEL_FORMATS[pixel_format][3], strict=True):
        w, ht = -(-width // (mh // h)), -(-height // (mv // v))
        plane = np.zeros((c.data_height, c.data_width), np.uint8)
        plane[:ht, :w] = raw[at : at + w * ht].reshape(ht, w)
        at += w * ht
        out.append(plane[::-1] if flip else plane)
    return out


def planes_of(pixels: np.ndarray, comps: list[Component], flip: bool = False) -> list[np.ndarray]:
    mh, mv = max(c.h for c in comps), max(c.v for c in comps)
    out = []
    for c in comps:
        kept = pixels[:: mv // c.v, :: mh // c.h, c.index][: c.height, : c.width]
        plane = np.zeros((c.data_height, c.data_width), np.uint8)
        plane[: kept.shape[0], : kept.shape[1]] = kept
        out.append(plane[::-1] if flip else plane)
    return out


def settle(width: int, height: int, pixel_format: str, p: Params) -> tuple[int, tuple, int]:
    """Components, their sampling and the restart interval that the parameters come to for an image."""
    _, comps, _, sampling = T.PIXEL_FORMATS[pixel_format]
    n = p.comp_count or min(comps, 3)
    s = p.sampling or (sampling if len(sampling) >= n else ((1, 1),) * n)
    s = tuple(s[:n]) if len(s) >= n else tuple(s) + ((s[0],) * (n - len(s)))
    if n == 4 and p.sampling and len(p.sampling) == 3:
        s = tuple(p.sampling) + (p.sampling[0],)
    subsampled = len(set(s)) > 1
    r = p.restart_interval if p.restart_interval is not None else suggest_restart(width, height, comps, subsampled, p.interleaved)
    return n, s, r


def quantise(data: bytes, width: int, height: int, color_space: str, pixel_format: str, padding: int, p: Params):
    """Components and the zig-zag coefficients of each."""
    n, sampling, restart = settle(width, height, pixel_format, p)
    internal = p.color_space_internal
    comps = geometry(width, height, sampling, restart, p.interleaved, internal)
    qs = {k: np.array(T.quant(k, p.quality), np.float64) for k in ("luma", "chroma")}
    if len(data) < image_size(width, height, pixel_format, padding):
        raise CodingError(f"{len(data)} bytes are too few for {width}x{height} {pixel_format}")
    if direct(color_space, pixel_format, sampling, n, p) and not padding:
        planes = planes_in(data, width, height, pixel_format, comps, p.flip)
        return comps, [forward(plane, qs[c.kind]) for c, plane in zip(comps, planes, strict=True)], restart
    pixels = unpack(data, width, height, pixel_format, padding)
    if p.remap:
        pixels = remap(pixels, p.remap)
    pixels = widen(pixels, max(n, 3) if n > 1 else pixels.shape[2], color_space) if pixels.shape[2] != 1 or n > 1 else pixels
    if pixels.shape[2] >= 3:
        pixels = convert(pixels, color_space, internal)
    pixels = widen(pixels, n, internal)
    return comps, [forward(plane, qs[c.kind]) for c, plane in zip(comps, planes_of(pixels, comps, p.flip), strict=True)], restart


def cut_rows(data: bytes, width: int, height: int, pixel_format: str, padding: int, rows: int) -> list[tuple[int, bytes]]:
    """(height, buffer) of the bands of so many rows that a buffer consists of; rows is a multiple of 8."""
    planar, _, bpp, sampling = T.PIXEL_FORMATS[pixel_format]
    if len(data) < image_size(width, height, pixel_format, padding):
        raise CodingError(f"{len(data)} bytes are too few for {width}x{height} {pixel_format}")
    mh, mv = sampling[0]
    planes, at = [], 0  # (start, bytes a line, rows of the image a line) of each plane
    for h, v in sampling if planar else ((mh, mv),):
        line = -(-width // (mh // h)) if planar else (width + padding) * bpp
        planes.append((at, line, mv // v))
        at += line * -(-height // (mv // v))
    out = []
    for y in range(0, height, rows):
        to = min(height, y + rows)
        out.append((to - y, b"".join(data[start + line * (y // d) : start + line * -(-to // d)] for start, line, d in planes)))
    return out


def band_pieces(comps: list[Component], k: int, band: int, coefs: list[np.ndarray], interleaved: bool):
    """Yields (scan, segment, place in the scan's order, component of each block, blocks) of the segments that band k has a part of."""
    each = sum(c.h * c.v for c in comps)
    parts, before = [], 0
    for c, own in zip(comps, coefs, strict=True):
        by, bx = (x.ravel() for x in np.indices(own.shape[:2]))
        by = by + k * band * c.v
        if interleaved:
            order = (by // c.v * c.mcu_x + bx // c.h) * each + before + by % c.v * c.h + bx % c.h
            fits = by // c.v < c.mcu_y
        else:
            order, fits = by * c.mcu_x + bx, by < c.mcu_y
        before += c.h * c.v
        parts.append(
            (
                order[fits],
                np.full(int(fits.sum()), c.index, np.uint8),
                own.reshape(-1, 64)[fits],
                c.segment_mcus * (each if interleaved else 1),
            )
        )
    if interleaved:
        parts = [(*(np.concatenate(x) for x in list(zip(*parts, strict=True))[:3]), parts[0][3])]
    for scan, (order, comp, blocks, per) in enumerate(parts):
        at = np.argsort(order, kind="stable")
        order, comp, blocks = order[at], comp[at], blocks[at]
        cut = np.flatnonzero(np.diff(order // per)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
            if b > a:
                yield scan, int(order[a] // per), int(order[a]), comp[a:b], blocks[a:b].astype(np.int16)


def segments_of(comps: list[Component], coefs: list[np.ndarray], interleaved: bool):
    """Yields (scan, segment, mcus, component of each block, blocks) in order."""
    for scan, (comp, by, bx, mcus, per) in enumerate(coding_order(comps, interleaved)):
        each = len(comp) // mcus
        blocks = np.zeros((len(comp), 64), np.int16)
        for c in comps:
            m = comp == c.index
            blocks[m] = coefs[c.index][by[m], bx[m]]
        for seg in range(-(-mcus // per)):
            a, b = seg * per * each, min(mcus, (seg + 1) * per) * each
            yield scan, seg, (b - a) // each, comp[a:b], blocks[a:b]


# ---- container ------------------------------------------------------------------


def marker(code: int, payload: bytes | None = None) -> bytes:
    return bytes([0xFF, code]) + (b"" if payload is None else struct.pack(">H", len(payload) + 2) + payload)


SOI, EOI = marker(0xD8), marker(0xD9)
APP0 = marker(0xE0, b"JFIF\0\1\1\1" + struct.pack(">HHBB", 300, 300, 0, 0))
APP14 = marker(0xEE, b"Adobe" + struct.pack(">HHHB", 100, 0, 0, 0))


def component_id(i: int, color_space: str) -> int:
    return b"RGBA"[i] if color_space == "rgb" else i + 1


def spiff(width: int, height: int, n: int, color_space: str, orientation) -> bytes:
    cs = 8 if n == 1 else {"ycbcr-bt709": 1, "ycbcr-jpeg": 3, "ycbcr-bt601": 4, "rgb": 10}.get(color_space, 2)
    out = marker(0xE8, b"SPIFF\0" + struct.pack(">HBBIIBBBBII", 0x100, 1 if cs in (3, 8) else 0, n, height, width, cs, 8, 5, 0, 1, 1))
    if orientation:
        out += marker(0xE8, struct.pack(">IBBH", 4, orientation[0], int(orientation[1]), 0))
    return out + bytes([0xFF, 0xE8]) + struct.pack(">HI", 8, 1) + SOI


#: Exif types: code and bytes of a value.
EXIF_TYPES = {
    "BYTE": (1, 1),
    "ASCII": (2, 1),
    "SHORT": (3, 2),
    "LONG": (4, 4),
    "RATIONAL": (5, 8),
    "UNDEFINED": (7, 1),
    "SLONG": (9, 4),
    "SRATIONAL": (10, 8),
}


def _exif_value(kind: str, value) -> tuple[int, bytes]:
    if kind in ("ASCII", "UNDEFINED", "BYTE") and isinstance(value, (str, bytes)):
        raw = value.encode() if isinstance(value, str) else value
        raw += b"\0" if kind == "ASCII" else b""
        return len(raw), raw
    values = value if isinstance(value, (list, tuple)) else [value]
    if kind in ("RATIONAL", "SRATIONAL"):
        flat = [x for v in values for x in (v if isinstance(v, (list, tuple)) else (v, 1))]
        return len(values), struct.pack(f">{len(flat)}{'I' if kind == 'RATIONAL' else 'i'}", *flat)
    return len(values), struct.pack(f">{len(values)}{ {'BYTE': 'B', 'SHORT': 'H', 'LONG': 'I', 'SLONG': 'i'}[kind] }", *values)


def exif(width: int, height: int, p: Params) -> bytes:
    first = {
        0x11A: ("RATIONAL", [(72, 1)]),
        0x11B: ("RATIONAL", [(72, 1)]),
        0x128: ("SHORT", 2),
        0x131: ("ASCII", "blockweave"),
        0x213: ("SHORT", 1),
    }
    if p.orientation:
        first[0x112] = ("SHORT", next(k for k, v in T.EXIF_ORIENTATION.items() if v == (p.orientation[0], bool(p.orientation[1]))))
    second = {
        0x9000: ("UNDEFINED", "0230"),
        0x9101: ("UNDEFINED", b"\1\2\3\0"),
        0xA000: ("UNDEFINED", "0100"),
        0xA001: ("SHORT", 1),
        0xA002: ("SHORT", width),
        0xA003: ("SHORT", height),
    }
    for tag, kv in p.exif_tags.items():
        (second if tag >= 0x9000 else first)[tag] = tuple(kv)

    def ifd(tags: dict, at: int) -> bytes:
        heads, tail = b"", b""
        end = at + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            kind, value = tags[tag]
            n, raw = _exif_value(kind, value)
            if len(raw) <= 4:
                body = raw.ljust(4, b"\0")
            else:
                body = struct.pack(">I", end + len(tail))
                tail += raw + b"\0" * (len(raw) % 2)
            heads += struct.pack(">HHI", tag, EXIF_TYPES[kind][0], n) + body
        return struct.pack(">H", len(tags)) + heads + b"\0\0\0\0" + tail

    first[0x8769] = ("LONG", 0)
    first[0x8769] = ("LONG", 8 + len(ifd(first, 8)))
    head = ifd(first, 8)
    return marker(0xE1, b"Exif\0\0MM\0*\0\0\0\x08" + head + ifd(second, 8 + len(head)))


def header_kind(p: Params, n: int) -> str:
    if p.header != "default":
        return p.header
    if n == 4 or p.orientation or p.color_space_internal in ("ycbcr-bt601", "ycbcr-bt709"):
        return "SPIFF"
    return "Adobe" if p.color_space_internal == "rgb" else "JFIF"


def head(width: int, height: int, comps: list[Component], restart: int, p: Params) -> bytes:
    n, cs = len(comps), p.color_space_internal
    kind = header_kind(p, n)
    out = [
        SOI,
        {
            "SPIFF": lambda: spiff(width, height, n, cs, p.orientation),
            "Adobe": lambda: APP14,
            "JFIF": lambda: APP0,
            "Exif": lambda: exif(width, height, p),
        }[kind](),
    ]
    kinds = list(dict.fromkeys(c.kind for c in comps))
    out += [marker(0xDB, bytes([k == "chroma"]) + bytes(np.array(T.quant(k, p.quality))[ZZ].tolist())) for k in kinds]
    out.append(
        marker(
            0xC0,
            struct.pack(">BHHB", 8, height, width, n) + b"".join(
                bytes([component_id(c.index, cs), c.h << 4 | c.v, c.kind == "chroma"]) for c in comps
            ),
        )
    )
    for k in kinds:
        for group, base in (("dc", 0), ("ac", 16)):
            bits, symbols = T.HUFFMAN[k, group]
            out.append(marker(0xC4, bytes([base + (k == "chroma")]) + bytes(bits) + bytes(symbols)))
    out.append(marker(0xDD, struct.pack(">H", restart)))
    out.append(marker(0xFE, f"{CREATOR}{min(100, max(1, p.quality))}".encode() + b"\0"))
    if cs == "ycbcr-bt601":
        out.append(marker(0xFE, b"CS=ITU601\0"))
    return b"".join(out)


def scan_head(scan: int, comps: list[Component], interleaved: bool, color_space: str) -> bytes:
    own = comps if interleaved else [comps[scan]]
    return marker(
        0xDA,
        bytes([len(own)]) + b"".join(
            bytes([component_id(c.index, color_space), 0x11 if c.kind == "chroma" else 0]) for c in own
        ) + b"\0\x3f\0",
    )


def segment_index(scan: int, offsets: list[int]) -> bytes:
    raw = struct.pack(f">{len(offsets)}I", *offsets)
    return b"".join(marker(0xED, bytes([scan]) + raw[at : at + INDEX_LIMIT]) for at in range(0, len(raw), INDEX_LIMIT))


def assemble(width: int, height: int, comps: list[Component], restart: int, p: Params, segments: list[tuple[int, int, bytes]]) -> bytes:
    """The file of (scan, segment, bits) in order: markers, and restart markers between the segments of a scan."""
    out = [head(width, height, comps, restart, p)]
    scans: dict[int, list[bytes]] = {}
    for scan, _, data in sorted(segments, key=lambda s: s[:2]):
        scans.setdefault(scan, []).append(data)
    for scan, parts in scans.items():
        body, offsets = b"", [0]
        pieces = []
        at = 0
        for k, part in enumerate(parts):
            piece = part + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"")
            pieces.append(piece)
            at += len(piece)
            offsets.append(at)
        body = b"".join(pieces)
        if p.segment_info and restart:
            out.append(segment_index(scan, offsets))
        out += [scan_head(scan, comps, p.interleaved, p.color_space_internal), body]
    return b"".join([*out, EOI])


def encode(
    data: bytes,
    width: int,
    height: int,
    color_space: str = "rgb",
    pixel_format: str = "444-u8-p012",
    padding: int = 0,
    params: Params | None = None,
) -> bytes:
    p = params or Params()
    comps, coefs, restart = quantise(data, width, height, color_space, pixel_format, padding, p)
    found = list(segments_of(comps, coefs, p.interleaved))
    packed = pack_all([(comp, blocks) for _, _, _, comp, blocks in found], [c.kind for c in comps])
    return assemble(width, height, comps, restart, p, [(scan, seg, data) for (scan, seg, *_), data in zip(found, packed, strict=True)])


# ---- reading --------------------------------------------------------------------

_UNSUPPORTED = {0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def markers(data: bytes, stop_at_scan: bool = False):
    """Yields (offset, code, payload); after a start of scan come its entropy-coded bytes as code 0."""
    if data[:2] != SOI:
        raise CodingError("no start of image")
    yield 0, 0xD8, b""
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise CodingError(f"a marker is missing at byte {at}")
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data):
            return
        code = data[at + 1]
        if code == 0xD9:
            yield at, code, b""
            return
        if code == 0xD8 or 0xD0 <= code <= 0xD7 or code == 0x01:
            yield at, code, b""
            at += 2
            continue
        if at + 4 > len(data):
            raise CodingError("the data end within a marker")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        payload = data[at + 4 : at + 2 + size]
        if code == 0xE8 and size == 8 and payload[:4] == b"\0\0\0\1":  # its length takes in the second start of image
            payload = payload[:4]
            size = 6
        if len(payload) < size - 2:
            raise CodingError("the data end within a marker")
        yield at, code, payload
        at += 2 + size
        if code == 0xDA:
            if stop_at_scan:
                return
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            yield at, 0, data[at:end]
            at = end


def parse_exif(payload: bytes) -> dict[int, object]:
    """Tags of the 0th IFD of an Exif payload, in either byte order."""
    if payload[:6] != b"Exif\0\0" or payload[6:8] not in (b"MM", b"II"):
        return {}
    t = payload[6:]
    e = ">" if t[:2] == b"MM" else "<"
    out: dict[int, object] = {}
    try:
        at = struct.unpack(e + "I", t[4:8])[0]
        for k in range(struct.unpack(e + "H", t[at : at + 2])[0]):
            tag, kind, n = struct.unpack(e + "HHI", t[at + 2 + 12 * k : at + 10 + 12 * k])
            size = next((s for c, s in EXIF_TYPES.values() if c == kind), 1)
            body = t[at + 10 + 12 * k : at + 14 + 12 * k]
            raw = body[: size * n] if size * n <= 4 else t[(o := struct.unpack(e + "I", body)[0]) : o + size * n]
            fmt = {1: "B", 3: "H", 4: "I", 9: "i"}.get(kind)
            if fmt:
                v = struct.unpack(f"{e}{n}{fmt}", raw)
                out[tag] = v[0] if n == 1 else list(v)
            elif kind in (5, 10):
                out[tag] = list(struct.unpack(f"{e}{2 * n}{'I' if kind == 5 else 'i'}", raw))
            else:
                out[tag] = raw.rstrip(b"\0").decode("latin-1")
    except struct.error:
        pass
    return out


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    ids: list[int] = field(default_factory=list)
    sampling: list[tuple[int, int]] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple] = field(default_factory=dict)
    restart: int = 0
    interleaved: bool = False
    header: str | None = None
    comment: str | None = None
    orientation: tuple[int, bool] | None = None
    color_space: str = "none"
    warning: str | None = None
    scans: list[tuple[list[tuple[int, int, int]], list[bytes], dict]] = field(default_factory=list)
    index: dict[int, list[int]] = field(default_factory=dict)

    @property
    def segment_count(self) -> int:
        return sum(len(parts) for _, parts, _ in self.scans)


def split_scan(data: bytes) -> list[bytes]:
    """Restart segments of a scan.

    At a marker out of turn all bytes up to the next marker that is due are skipped, and the segments among them are lost. If no
    such marker is left, the segment ends with the marker out of turn and the rest of the scan is lost. An empty last segment goes.
    """
    parts, start, at, due = [], 0, 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        code = data[at + 1]
        if not 0xD0 <= code <= 0xD7:
            at += 1 if code == 0xFF else 2
            continue
        found = at if code == 0xD0 + due else data.find(bytes([0xFF, 0xD0 + due]), at + 2)
        if found < 0:
            return [*parts, data[start : at + 2]]
        parts.append(data[start:at])
        start = at = found + 2
        due = (due + 1) % 8
    if start < len(data):
        parts.append(data[start:])
    return parts


def split_by_index(data: bytes, offsets: list[int]) -> list[bytes]:
    """Restart segments by an index of offsets: no byte is searched."""
    return [data[a : b - 2] if k + 2 < len(offsets) else data[a:b] for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))]


def read(data: bytes, stop_at_scan: bool = False, use_index: bool = True) -> Jpeg:
    j = Jpeg()
    from_header = "none"
    adobe = None
    scan = None
    for _, code, payload in markers(data, stop_at_scan):
        if code in _UNSUPPORTED:
            raise CodingError(f"SOF{code - 0xC0} is not supported")
        if code in (0xC0, 0xC1):
            precision, j.height, j.width, n = struct.unpack(">BHHB", payload[:6])
            if precision != 8:
                raise CodingError(f"precision {precision} is not supported")
            if n > 4:
                raise CodingError(f"{n} components are not supported")
            if code == 0xC1:
                j.warning = "SOF1 is read as SOF0"
            for k in range(n):
                i, s, t = payload[6 + 3 * k : 9 + 3 * k]
                j.ids.append(i)
                j.sampling.append((s >> 4, s & 15))
                j.tables.append(t)
        elif code == 0xE0 and payload[:4] == b"JFIF":
            j.header, from_header = j.header or "JFIF", "ycbcr-jpeg" if from_header == "none" else from_header
        elif code == 0xE1 and payload[:6] == b"Exif\0\0":
            j.header = j.header or "Exif"
            o = parse_exif(payload).get(0x112)
            if o in T.EXIF_ORIENTATION:
                j.orientation = T.EXIF_ORIENTATION[o]
            from_header = "ycbcr-jpeg" if from_header == "none" else from_header
        elif code == 0xE8 and payload[:6] == b"SPIFF\0":
            j.header = "SPIFF"
            cs, _, compression = payload[18], payload[19], payload[20]
            if compression != 5:
                raise CodingError(f"SPIFF compression {compression} is not JPEG")
            known = {1: "ycbcr-bt709", 2: "none", 3: "ycbcr-jpeg", 8: "ycbcr-jpeg", 4: "ycbcr-bt601", 10: "rgb"}
            if cs not in known:
                raise CodingError(f"SPIFF colour space {cs} is not supported")
            from_header = known[cs]
        elif code == 0xE8 and payload[:4] == b"\0\0\0\4":
            j.orientation = (payload[4] & 3, bool(payload[5]))
        elif code == 0xEE and payload[:5] == b"Adobe" and len(payload) >= 12:
            j.header, adobe = "Adobe", payload[11]
        elif code == 0xED and payload:
            j.index.setdefault(payload[0], []).extend(
                struct.unpack(f">{(len(payload) - 1) // 4}I", payload[1 : 1 + (len(payload) - 1) // 4 * 4])
            )
        elif code == 0xFE:
            text = payload.rstrip(b"\0").decode("latin-1")
            if text == "CS=ITU601":
                from_header = "ycbcr-bt601"
            else:
                j.comment = j.comment or text
        elif code == 0xDB:
            at = 0
            while at < len(payload):
                if payload[at] >> 4:
                    raise CodingError("16-bit quantisation tables are not supported")
                table = np.zeros(64)
                table[ZZ] = np.frombuffer(payload[at + 1 : at + 65], np.uint8)
                j.quant[payload[at] & 15] = table
                at += 65
        elif code == 0xC4:
            at = 0
            while at < len(payload):
                bits = tuple(payload[at + 1 : at + 17])
                n = sum(bits)
                j.huffman[payload[at]] = (bits, tuple(payload[at + 17 : at + 17 + n]))
                at += 17 + n
        elif code == 0xDD:
            j.restart = struct.unpack(">H", payload[:2])[0]
        elif code == 0xDA:
            n = payload[0]
            j.interleaved |= n > 1
            scan = [(j.ids.index(payload[1 + 2 * k]), payload[2 + 2 * k] >> 4, payload[2 + 2 * k] & 15) for k in range(n)]
        elif code == 0 and scan is not None:
            offsets = j.index.get(len(j.scans))
            parts = split_by_index(payload, offsets) if use_index and offsets and offsets[-1] <= len(payload) else split_scan(payload)
            j.scans.append((scan, parts, dict(j.huffman)))
    if not j.ids:
        raise CodingError("no frame")
    if adobe is not None:
        from_header = "ycbcr-jpeg" if adobe == 1 or len(j.ids) == 1 else "rgb" if adobe == 0 and len(j.ids) >= 3 else from_header
    if from_header == "none" and len(j.ids) >= 3:
        ids = bytes(j.ids[:3])
        from_header = "ycbcr-jpeg" if ids == b"\1\2\3" else "rgb" if ids in (b"RGB", b"rgb") else "none"
    if len(j.ids) == 1 and from_header == "rgb":
        from_header = "ycbcr-jpeg"
    j.color_space = from_header if from_header != "none" else "ycbcr-jpeg"
    return j


def scan_plan(j: Jpeg, k: int) -> tuple[list[Component], np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Components of the image, then component, row and column of each block of scan k, MCUs, MCUs a segment."""
    comps = geometry(j.width, j.height, j.sampling, j.restart, j.interleaved, j.color_space)
    own = [c for c, _, _ in j.scans[k][0]]
    if len(own) > 1:
        comp, by, bx, mcus, per = coding_order([comps[c] for c in own], True)[0]
        return comps, comp, by, bx, mcus, per
    c = comps[own[0]]
    wide, high = -(-c.width // 8), -(-c.height // 8)
    by, bx = np.divmod(np.arange(wide * high), wide)
    return comps, np.full(len(by), c.index), by, bx, len(by), j.restart or len(by)


def scan_tables(j: Jpeg, k: int) -> tuple[list, list]:
    """DC and AC lookups of scan k by component."""
    spec, _, huffman = j.scans[k]
    dc, ac = [None] * len(j.ids), [None] * len(j.ids)
    for c, d, a in spec:
        dc[c] = _lookup(huffman.get(d, T.HUFFMAN["luma" if d == 0 else "chroma", "dc"]))
        ac[c] = _lookup(huffman.get(16 + a, T.HUFFMAN["luma" if a == 0 else "chroma", "ac"]))
    return dc, ac


def decode_segments(j: Jpeg, wanted: list[tuple[int, int, bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Component, row, column and coefficients of the blocks of segments (scan, segment, bits)."""
    plans = {k: scan_plan(j, k)[1:] for k in {k for k, _, _ in wanted}}
    tables = {k: scan_tables(j, k) for k in plans}
    cells = []
    for k, seg, _ in wanted:
        comp, by, bx, mcus, per = plans[k]
        each = len(comp) // mcus
        part = slice(seg * per * each, min(mcus, (seg + 1) * per) * each)
        cells.append((comp[part], by[part], bx[part]))
    if len(wanted) < LANES:
        found = [
            unpack_segment(data, comp.tolist(), *tables[k], len(j.ids)) for (k, _, data), (comp, _, _) in zip(wanted, cells, strict=True)
        ]
    else:
        found = unpack_side_by_side([data for _, _, data in wanted], [c for c, _, _ in cells], [tables[k] for k, _, _ in wanted])
    return [(*cell, blocks) for cell, blocks in zip(cells, found, strict=True)]


_LOOKUPS: dict = {}


def _lookup(table):
    if table not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[table] = lookup(*table)
    return _LOOKUPS[table]


def native_format(n: int, sampling, interleaved: bool) -> str:
    if n == 1:
        return "u8"
    if n == 4:
        return "4444-u8-p0123"
    gh, gv = int(np.gcd.reduce([s[0] for s in sampling])), int(np.gcd.reduce([s[1] for s in sampling]))
    s = [(h // gh, v // gv) for h, v in sampling]
    if s[1] == s[2] == (1, 1):
        found = {
            (True, 1, 1): "444-u8-p012",
            (False, 1, 1): "444-u8-p0p1p2",
            (True, 2, 1): "422-u8-p1020",
            (False, 2, 1): "422-u8-p0p1p2",
            (True, 2, 2): "420-u8-p0p1p2",
            (False, 2, 2): "420-u8-p0p1p2",
        }.get((interleaved, *s[0]))
        if found:
            return found
    return "444-u8-p012" if interleaved else "444-u8-p0p1p2"


def output_format(j: Jpeg, color_space: str, pixel_format: str) -> tuple[str, str]:
    """What default or automatic output comes to for an image."""
    n = len(j.ids)
    if color_space == "none":
        color_space = j.color_space
    if color_space == "default":
        color_space = "ycbcr-jpeg" if pixel_format == "u8" or pixel_format in ("auto", "native", "std", "no-alpha") and n == 1 else "rgb"
    if pixel_format in ("auto", "native", "std", "no-alpha"):
        if n == 1:
            pixel_format = "u8"
        elif pixel_format == "native":
            pixel_format = native_format(n, j.sampling, j.interleaved)
        elif pixel_format == "std" and color_space != "rgb":
            s = [tuple(x) for x in j.sampling[:3]]
            pixel_format = "420-u8-p0p1p2" if s == [(2, 2), (1, 1), (1, 1)] else "422-u8-p0p1p2" if s == [
                (2, 1), (1, 1), (1, 1)
            ] else "444-u8-p0p1p2"
        elif n == 3 or pixel_format == "no-alpha":
            pixel_format = "444-u8-p012"
        else:
            pixel_format = "4444-u8-p0123"
    return color_space, pixel_format


def bare(data: bytes) -> bytes:
    """The head of a file, then the heads of all its scans without their bits: enough to decode any segment."""
    at = next(at for at, code, _ in markers(data) if code == 0xDA)
    return data[:at] + b"".join(marker(code, payload) for _, code, payload in markers(data) if code in (0xDA, 0xC4)) + EOI


def pixels_of(
    j: Jpeg, coefs: list[np.ndarray], color_space: str, pixel_format: str, flip: bool = False, remap_to: str | None = None
) -> np.ndarray:
    """Rows of pixels, in the output's colour space and components, from each component's coefficients."""
    comps = geometry(j.width, j.height, j.sampling, j.restart, j.interleaved, j.color_space)
    mh, mv = max(c.h for c in comps), max(c.v for c in comps)
    planes = []
    for c, k in zip(comps, coefs, strict=True):
        plane = inverse(k, j.quant[j.tables[c.index]])
        plane = plane[::-1] if flip else plane
        y, x = np.arange(j.height) * c.v // mv, np.arange(j.width) * c.h // mh
        planes.append(plane[np.minimum(y, plane.shape[0] - 1)][:, np.minimum(x, plane.shape[1] - 1)])
    pixels = np.stack(planes, axis=2)
    color_space, pixel_format = output_format(j, color_space, pixel_format)
    n = T.PIXEL_FORMATS[pixel_format][1]
    pixels = widen(pixels, max(n, pixels.shape[2]), j.color_space)
    if pixels.shape[2] >= 3:
        pixels = convert(pixels, j.color_space, color_space)
    pixels = widen(pixels, n, color_space)
    return remap(pixels, remap_to) if remap_to else pixels


def finish(j: Jpeg, pixels: np.ndarray, color_space: str, pixel_format: str, alignment: int = 0):
    """(data, colour space, pixel format, padding) of an image's pixels."""
    color_space, pixel_format = output_format(j, color_space, pixel_format)
    bpp = T.PIXEL_FORMATS[pixel_format][2]
    # Padding is counted in pixels, so as many are added as make the bytes of a row a multiple of the alignment.
    padding = -j.width % (alignment // math.gcd(alignment, bpp)) if alignment and bpp else 0
    return pack(pixels, pixel_format, padding), color_space, pixel_format, padding


def rebuild(
    j: Jpeg,
    coefs: list[np.ndarray],
    color_space: str = "default",
    pixel_format: str = "auto",
    alignment: int = 0,
    flip: bool = False,
    remap_to: str | None = None,
):
    """(data, colour space, pixel format, padding) from each component's coefficients."""
    return finish(j, pixels_of(j, coefs, color_space, pixel_format, flip, remap_to), color_space, pixel_format, alignment)


def band_blocks(j: Jpeg, band: int) -> list[int]:
    """Rows of blocks of each component in a band of so many rows of MCUs."""
    return [band * v for _, v in j.sampling]


def band_pixels(
    j: Jpeg, k: int, band: int, at: np.ndarray, blocks: np.ndarray, color_space: str, pixel_format: str, remap_to: str | None
) -> np.ndarray:
    """Pixels of band k, whose coefficients are blocks at (component, row, column); rows below the image come with them."""
    mv = max(v for _, v in j.sampling)
    part = dataclasses.replace(j, height=8 * mv * band, scans=[], index={})
    coefs = empty_coefs(part)
    for c, (plane, rows) in enumerate(zip(coefs, band_blocks(j, band), strict=True)):
        own = at[0] == c
        plane[at[1, own] - k * rows, at[2, own]] = blocks[own]
    return pixels_of(part, coefs, color_space, pixel_format, remap_to=remap_to)


def join_bands(
    j: Jpeg, bands: dict[int, bytes], band: int, color_space: str, pixel_format: str, alignment: int = 0, remap_to: str | None = None
):
    """(data, colour space, pixel format, padding) of the bands' pixels; a band of which all segments are lost has no coefficients."""
    height = 8 * max(v for _, v in j.sampling) * band
    n = T.PIXEL_FORMATS[output_format(j, color_space, pixel_format)[1]][1]
    none = np.zeros((3, 0), int), np.zeros((0, 64), np.int32)
    rows = []
    for k in range(-(-j.height // height)):
        if k in bands:
            rows.append(np.frombuffer(bands[k], np.uint8).reshape(height, j.width, n))
        else:
            rows.append(band_pixels(j, k, band, *none, color_space, pixel_format, remap_to))
    return finish(j, np.concatenate(rows)[: j.height], color_space, pixel_format, alignment)


def empty_coefs(j: Jpeg) -> list[np.ndarray]:
    comps = geometry(j.width, j.height, j.sampling, j.restart, j.interleaved, j.color_space)
    return [np.zeros((c.data_height // 8, c.data_width // 8, 64), np.int32) for c in comps]


def coefficients(j: Jpeg) -> list[np.ndarray]:
    """Each component's coefficients, decoded from all segments."""
    coefs = empty_coefs(j)
    found = decode_segments(j, [(k, seg, part) for k, (_, parts, _) in enumerate(j.scans) for seg, part in enumerate(parts)])
    if found:
        comp, by, bx, blocks = (np.concatenate(x) for x in zip(*found, strict=True))
        for c in range(len(coefs)):
            m = comp == c
            coefs[c][by[m], bx[m]] = blocks[m]
    return coefs


def decode(data: bytes, color_space: str = "default", pixel_format: str = "auto", **options):
    j = read(data)
    raw, cs, pf, padding = rebuild(j, coefficients(j), color_space, pixel_format, **options)
    return j.width, j.height, cs, pf, padding, raw


def reindex(data: bytes) -> bytes:
    """The same image with segment indexes before its scans; entropy-coded bytes stay as they are."""
    out, scan = [], 0
    found = list(markers(data))
    for k, (at, code, payload) in enumerate(found):
        if code == 0xED:
            continue  # an index that was there already
        end = found[k + 1][0] if k + 1 < len(found) else len(data)
        if code == 0xDA:
            offsets, pos = [0], 0
            parts = split_scan(found[k + 1][2])
            for n, part in enumerate(parts):
                pos += len(part) + (2 if n + 1 < len(parts) else 0)
                offsets.append(pos)
            out.append(segment_index(scan, offsets))
            scan += 1
        out.append(data[at:end])
    return b"".join(out)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    e = float(((a.astype(np.float64) - b) ** 2).mean())
    return float("inf") if e == 0 else 10 * float(np.log10(255**2 / e))


def lcg(n: int, seed: int = 12345) -> np.ndarray:
    """Bytes of the deterministic test noise."""
    out = np.zeros(n, np.uint8)
    s = seed
    for i in range(n):
        s = ((1664525 * s + 1013904223) & 0xFFFFFFFF) % 0x7FFFFFFF
        out[i] = s & 255
    return out
