"""Fixed values of baseline image coding, and tables that follow from them by rule."""

from __future__ import annotations

import math

# Fixed values, needed for equal results: the recommended quantisation tables, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
QUANT = {"luma": LUMA, "chroma": CHROMA}

# The standard Huffman tables as (number of codes of 1..16 bits, symbols in order of their codes).
_AC_LUMA = (
    1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240,
    36, 51, 98, 114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72,
    73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 131,
    132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170,
    178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216,
    217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250,
)
_AC_CHROMA = (
    0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193, 9, 35, 51, 82, 240,
    21, 98, 114, 209, 10, 22, 36, 52, 225, 37, 241, 23, 24, 25, 26, 38, 39, 40, 41, 42, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71,
    72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 130,
    131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169,
    170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215,
    216, 217, 218, 226, 227, 228, 229, 230, 231, 232, 233, 234, 242, 243, 244, 245, 246, 247, 248, 249, 250,
)
HUFFMAN = {
    ("luma", "dc"): ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    ("chroma", "dc"): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
    ("luma", "ac"): ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), _AC_LUMA),
    ("chroma", "ac"): ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), _AC_CHROMA),
}

# Integer colour matrices (rows of 256ths) and bases, to and from RGB.
TO = {
    "ycbcr-bt601": ((66, 129, 25, -38, -74, 112, 112, -94, -18), (16, 128, 128)),
    "ycbcr-jpeg": ((77, 150, 29, -43, -85, 128, 128, -107, -21), (0, 128, 128)),
    "ycbcr-bt709": ((47, 157, 16, -26, -87, 112, 112, -102, -10), (16, 128, 128)),
    "yuv": ((77, 150, 29, -38, -74, 112, 157, -132, -26), (0, 128, 128)),
}
FROM = {
    "ycbcr-bt601": ((298, 0, 409, 298, -100, -208, 298, 516, 0), (16, 128, 128)),
    "ycbcr-jpeg": ((256, 0, 359, 256, -88, -183, 256, 454, 0), (0, 128, 128)),
    "ycbcr-bt709": ((298, 0, 459, 298, -55, -136, 298, 541, 0), (16, 128, 128)),
    "yuv": ((256, 0, 292, 256, -101, -149, 256, 520, 0), (0, 128, 128)),
}

# Pixel formats as (planar, components, bytes a pixel or 0, sampling of each component).
PIXEL_FORMATS = {
    "u8": (False, 1, 1, ((1, 1),)),
    "444-u8-p012": (False, 3, 3, ((1, 1), (1, 1), (1, 1))),
    "444-u8-p0p1p2": (True, 3, 0, ((1, 1), (1, 1), (1, 1))),
    "422-u8-p1020": (False, 3, 2, ((2, 1), (1, 1), (1, 1))),
    "422-u8-p0p1p2": (True, 3, 0, ((2, 1), (1, 1), (1, 1))),
    "420-u8-p0p1p2": (True, 3, 0, ((2, 2), (1, 1), (1, 1))),
    "4444-u8-p0123": (False, 4, 4, ((1, 1), (1, 1), (1, 1), (1, 1))),
}

# File extensions and what they hold.
EXTENSIONS = {
    "raw": "RAW", "rgb": "RGB", "rgba": "RGBA", "yuv": "YUV", "yuva": "YUVA", "uyvy": "UYVY", "i420": "I420", "r": "GRAY",
    "jpg": "JPEG", "jpeg": "JPEG", "jfif": "JPEG", "bmp": "BMP", "gif": "GIF", "png": "PNG", "tga": "TGA",
    "pnm": "PNM", "pgm": "PGM", "ppm": "PPM", "pam": "PAM", "y4m": "Y4M", "tst": "TST", "xxx": "RAW",
}

# Names of colour spaces and header types, and of orientations by (rotation, flip).
COLOR_SPACES = {
    "rgb": "rgb",
    "yuv": "yuv",
    "ycbcr": "ycbcr-bt709",
    "ycbcr-jpeg": "ycbcr-jpeg",
    "ycbcr-bt601": "ycbcr-bt601",
    "ycbcr-bt709": "ycbcr-bt709",
}
HEADERS = ("JFIF", "SPIFF", "Adobe", "Exif")
ORIENTATIONS = {
    (0, False): "normal", (0, True): "mirror horizontal", (1, False): "rotated CW 90 deg", (1, True): "rotated CW 90 and mirrored horizontal",
    (2, False): "rotated 180 deg", (2, True): "flipped vertical", (3, False): "rotated CW 270 deg", (3, True): "rotated CW 270 deg and mirrored horizontal",
}
EXIF_ORIENTATION = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (1, False), 7: (3, True), 8: (3, False)}

#: ZIGZAG[zz] is the natural position (row * 8 + column) of the zz-th coefficient: diagonals in turn, up and down.
ZIGZAG = tuple(r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])))


def quant(kind: str, quality: int) -> tuple[int, ...]:
    """The table of a kind scaled to a quality, in natural order."""
    q = min(100, max(1, quality))
    s = 5000 // q if q < 50 else 200 - 2 * q
    return tuple(min(255, max(1, (s * t + 50) // 100)) for t in QUANT[kind])


def codes(kind: str, group: str) -> dict[int, tuple[int, int]]:
    """Canonical (code, bits) by symbol."""
    bits, symbols = HUFFMAN[kind, group]
    return canonical(bits, symbols)


def canonical(bits, symbols) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def basis() -> list[tuple[int, int, float]]:
    """(k, n, weight) of the 8x8 cosine transform; that of the constant is 0.125 exactly."""
    one = [[math.sqrt(1 / 8) if u == 0 else 0.5 * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    return [
        (
            8 * v + u, 8 * y + x, 0.125 if u == v == 0 else one[v][y] * one[u][x]
        ) for v in range(8) for u in range(8) for y in range(8) for x in range(8)
    ]


def kind_of(comp: int, color_space: str) -> str:
    """Luma tables serve RGB, the first component and alpha."""
    return "luma" if color_space == "rgb" or comp in (0, 3) else "chroma"
