"""Images to JPEG files and back, as DataFrames.

``images``: image_id, width, height, color_space, pixel_format, width_padding, data.

Encoding makes quantised coefficients of each image, cut into restart segments, then packs the bits of each segment, then
joins the segments of an image to a file. With many images a task does all of it for its images and nothing is shuffled;
``spread=True`` deals bands of rows out before the transform and segments by (image, scan, segment) after it, for few or very large images.
Bad rows give a null result and a text in ``error``, or fail the query with mode="FAILFAST".
"""

from __future__ import annotations

import dataclasses
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions import jpegcore as J

Params = J.Params
IMAGES = "image_id long, width int, height int, color_space string, pixel_format string, width_padding int, data binary"
SEGMENTS = "image_id long, scan int, seg int, mcu_count int, comp binary, coefs binary, kinds array<string>, error string"
#: Rows of MCUs in a band, the part of a large image that goes to a task of its own.
BAND = 16
ORIENTATION = "struct<rotation: int, flip: boolean>"
INFO = (
    "width int, height int, comp_count int, sampling array<struct<h: int, v: int>>, color_space string, interleaved boolean, restart_interval int, "
    f"segment_count int, header_type string, comment string, orientation {ORIENTATION}, warning string, error string"
)


def _failing(mode: str, e: Exception) -> str:
    if mode == "FAILFAST":
        raise e
    return f"{type(e).__name__}: {e}"


def _image(row):
    return bytes(row.data), int(row.width), int(row.height), row.color_space, row.pixel_format, int(row.width_padding or 0)


def encode(images: DataFrame, params: Params | None = None, mode: str = "PERMISSIVE", spread: bool = False) -> DataFrame:
    """image_id, jpeg, error."""
    p = params or Params()
    if spread:
        segs = segments(images, p, mode).repartition("image_id", "scan", "seg") if p.flip else segments_by_bands(images, p, mode)
        return assemble(images, pack(segs, mode), p)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    out.append((row.image_id, J.encode(*_image(row), p), None))
                except Exception as e:  # noqa: BLE001  any bad row becomes an error of its own
                    out.append((row.image_id, None, _failing(mode, e)))
            yield pd.DataFrame(out, columns=["image_id", "jpeg", "error"])

    return images.mapInPandas(run, "image_id long, jpeg binary, error string")


def segments(images: DataFrame, params: Params | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """image_id, scan, seg, mcu_count, comp (binary, a byte a block), coefs (binary, 64 shorts a block), kinds, error."""
    p = params or Params()
    schema = SEGMENTS

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                try:
                    comps, coefs, _ = J.quantise(*_image(row), p)
                    kinds = [c.kind for c in comps]
                    found = J.segments_of(comps, coefs, p.interleaved)
                    out = [(row.image_id, scan, seg, mcus, comp.astype(np.uint8).tobytes(), blocks.tobytes(), kinds, None) for scan, seg, mcus, comp, blocks in found]
                except Exception as e:  # noqa: BLE001
                    out = [(row.image_id, 0, 0, 0, b"", b"", [], _failing(mode, e))]
                yield pd.DataFrame(out, columns=["image_id", "scan", "seg", "mcu_count", "comp", "coefs", "kinds", "error"])

    return images.mapInPandas(run, schema)


def segments_by_bands(images: DataFrame, params: Params | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """As ``segments``, with the rows of an image dealt out in bands before the transform; without a flip."""
    p = params or Params()
    cut_schema = "image_id long, band int, width int, height int, rows int, color_space string, pixel_format string, width_padding int, data binary, error string"
    piece_schema = "image_id long, scan int, seg int, at int, each int, comp binary, coefs binary, kinds array<string>, error string"

    def cut(batches):
        for batch in batches:
            for row in batch.itertuples():
                try:
                    data, w, h, cs, pf, padding = _image(row)
                    mv = max(v for _, v in J.settle(w, h, pf, p)[1])
                    out = [(row.image_id, k, w, h, n, cs, pf, padding, part, None) for k, (n, part) in enumerate(J.cut_rows(data, w, h, pf, padding, 8 * mv * BAND))]
                except Exception as e:  # noqa: BLE001
                    out = [(row.image_id, -1, 0, 0, 0, None, None, 0, None, _failing(mode, e))]
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in cut_schema.split(", ")])

    def transform(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                error = r.error
                if error is None:
                    try:
                        _, sampling, restart = J.settle(r.width, r.height, r.pixel_format, p)
                        comps = J.geometry(r.width, r.height, sampling, restart, p.interleaved, p.color_space_internal)
                        _, coefs, _ = J.quantise(bytes(r.data), r.width, r.rows, r.color_space, r.pixel_format, r.width_padding, p)
                        kinds, each = [c.kind for c in comps], sum(c.h * c.v for c in comps) if p.interleaved else 1
                        found = J.band_pieces(comps, r.band, BAND, coefs, p.interleaved)
                        out += [(r.image_id, scan, seg, at, each, comp.tobytes(), blocks.tobytes(), kinds, None) for scan, seg, at, comp, blocks in found]
                    except Exception as e:  # noqa: BLE001
                        error = _failing(mode, e)
                if error is not None:
                    out.append((r.image_id, 0, 0, 0, 1, b"", b"", [], error))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in piece_schema.split(", ")])

    bands = images.mapInPandas(cut, cut_schema).repartition("image_id", "band")
    pieces = bands.mapInPandas(transform, piece_schema)
    parts = F.array_sort(F.collect_list(F.struct("at", "comp", "coefs"))).alias("parts")
    segs = pieces.groupBy("image_id", "scan", "seg").agg(
        parts, F.max("each").alias("each"), F.max("kinds").alias("kinds"), F.max("error").alias("error")
    )
    joined = lambda c: F.aggregate("parts", F.lit(b"").cast("binary"), lambda got, x: F.concat(got, x[c])).alias(c)
    return segs.select(
        "image_id",
        "scan",
        "seg",
        F.floor(F.aggregate("parts", F.lit(0), lambda n, x: n + F.length(x["comp"])) / F.col("each")).cast("int").alias("mcu_count"),
        joined("comp"),
        joined("coefs"),
        "kinds",
        "error",
    )


def pack(segs: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """image_id, scan, seg, mcu_count, data, error: the bits of each segment."""

    def run(batches):
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for at, (kinds, error) in enumerate(zip(batch.kinds, batch.error, strict=True)):
                if error is None:
                    groups.setdefault(tuple(kinds), []).append(at)
            data, errors = [None] * len(batch), batch.error.tolist()
            blocks = lambda at: (  # noqa: B023, E731
                np.frombuffer(batch.comp.iloc[at], np.uint8).astype(int), np.frombuffer(batch.coefs.iloc[at], np.int16).reshape(-1, 64)
            )
            for kinds, rows in groups.items():
                try:
                    packed = J.pack_all([blocks(at) for at in rows], list(kinds))
                except J.CodingError:  # one of them has no code; which one shows when each goes alone
                    packed = []
                    for at in rows:
                        try:
                            packed += J.pack_all([blocks(at)], list(kinds))
                        except J.CodingError as e:
                            errors[at] = _failing(mode, e)
                            packed.append(None)
                for at, bits in zip(rows, packed, strict=True):
                    data[at] = bits
            yield batch[["image_id", "scan", "seg", "mcu_count"]].assign(data=data, error=errors)

    return segs.mapInPandas(run, "image_id long, scan int, seg int, mcu_count int, data binary, error string")


def assemble(images: DataFrame, packed: DataFrame, params: Params | None = None) -> DataFrame:
    """Files of packed segments: one group an image, which is no more than its file."""
    p = params or Params()
    parts = packed.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("scan", "seg", "data"))).alias("parts"), F.max("error").alias("error")
    )
    sizes = images.select("image_id", "width", "height", "pixel_format")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                jpeg = None
                if row.error is None:
                    n, sampling, restart = J.settle(row.width, row.height, row.pixel_format, p)
                    comps = J.geometry(row.width, row.height, sampling, restart, p.interleaved, p.color_space_internal)
                    jpeg = J.assemble(
                        row.width, row.height, comps, restart, p, [(s["scan"], s["seg"], bytes(s["data"])) for s in row.parts]
                    )
                out.append((row.image_id, jpeg, row.error))
            yield pd.DataFrame(out, columns=["image_id", "jpeg", "error"])

    return sizes.join(parts, "image_id").select("image_id", "width", "height", "pixel_format", "parts", "error").mapInPandas(
        run, "image_id long, jpeg binary, error string"
    )


_DECODED = ["image_id", "width", "height", "color_space", "pixel_format", "width_padding", "data", "error"]
_INTS = {c: "Int32" for c in ("width", "height", "width_padding")}


def decode(
    files: DataFrame,
    color_space: str = "default",
    pixel_format: str = "auto",
    column: str = "jpeg",
    mode: str = "PERMISSIVE",
    alignment: int = 0,
    flip: bool = False,
    remap: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """IMAGES and error of JPEG files (image_id, ``column``).

    Each image is decoded in one task, or with ``spread`` its segments and then bands of its rows in many. A flip needs all rows at once, so
    with it each image has one task in any case. Rows are padded with whole pixels until their bytes are a multiple of ``alignment``.
    """
    if spread and not flip:
        return _decode_spread(files, color_space, pixel_format, column, mode, alignment, remap)

    def run(batches):
        for batch in batches:
            out = []
            for i, data in zip(batch.image_id, batch.data, strict=True):
                try:
                    w, h, cs, pf, padding, raw = J.decode(
                        bytes(data), color_space, pixel_format, alignment=alignment, flip=flip, remap_to=remap
                    )
                    out.append((i, w, h, cs, pf, padding, raw, None))
                except Exception as e:  # noqa: BLE001
                    out.append((i, None, None, None, None, None, None, _failing(mode, e)))
            yield pd.DataFrame(out, columns=_DECODED).astype(_INTS)

    return files.select("image_id", F.col(column).alias("data")).mapInPandas(run, f"{IMAGES}, error string")


def _decode_spread(files, color_space, pixel_format, column, mode, alignment, remap) -> DataFrame:
    """Segments to coefficients, bands of coefficients to pixels, bands to images; only the last step has an image in one place."""

    def split(batches):
        for batch in batches:
            for i, data in zip(batch.image_id, batch.data, strict=True):
                try:
                    data = bytes(data)
                    j, bare = J.read(data), J.bare(data)
                    J.output_format(j, color_space, pixel_format)
                    out = [(i, k, s, part, bare, None) for k, (_, parts, _) in enumerate(j.scans) for s, part in enumerate(parts)]
                except Exception as e:  # noqa: BLE001
                    out = [(i, -1, -1, None, None, _failing(mode, e))]
                yield pd.DataFrame(out, columns=["image_id", "scan", "seg", "data", "head", "error"])

    def blocks(batches):
        for batch in batches:
            out = [(r.image_id, -1, r.head, None, None, None, None, r.error) for r in batch[batch.error.notna()].itertuples()]
            for head, part in batch[batch.error.isna()].groupby("head", sort=False):
                j = J.read(bytes(head))
                step = J.band_blocks(j, BAND)
                for r in part.itertuples():
                    try:
                        for comp, by, bx, blocks in J.decode_segments(j, [(r.scan, r.seg, bytes(r.data))]):
                            key = comp * (1 << 20) + by // np.array(step)[comp]
                            for k in np.unique(key):
                                m = key == k
                                at = np.stack([comp[m], by[m], bx[m]]).astype(np.int32)
                                out.append(
                                    (
                                        r.image_id,
                                        int(k % (1 << 20)),
                                        head,
                                        at.tobytes(),
                                        blocks[m].astype(np.int32).tobytes(),
                                        r.scan,
                                        r.seg,
                                        None,
                                    )
                                )
                    except Exception as e:  # noqa: BLE001
                        out.append((r.image_id, -1, head, None, None, r.scan, r.seg, _failing(mode, e)))
            yield pd.DataFrame(out, columns=["image_id", "band", "head", "at", "blocks", "scan", "seg", "error"]).astype(
                {"scan": "Int32", "seg": "Int32"}
            )

    def pixels(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["scan", "seg"])
        first = part.iloc[0]
        error = next((e for e in part.error if e is not None), None)
        rows = None
        if error is None:
            at = np.concatenate([np.frombuffer(a, np.int32).reshape(3, -1) for a in part["at"]], axis=1)
            found = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 64) for b in part.blocks])
            rows = J.band_pixels(J.read(bytes(first["head"])), int(first.band), BAND, at, found, color_space, pixel_format, remap).tobytes()
        return pd.DataFrame({"image_id": [first.image_id], "band": [first.band], "head": [first["head"]], "rows": [rows], "error": [error]})

    def join(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                errors = [b["error"] for b in r.bands if b["error"] is not None]
                if errors:
                    out.append((r.image_id, None, None, None, None, None, None, errors[0]))
                    continue
                j = J.read(bytes(r.head))
                bands = {int(b["band"]): bytes(b["rows"]) for b in r.bands}
                raw, cs, pf, padding = J.join_bands(j, bands, BAND, color_space, pixel_format, alignment, remap)
                out.append((r.image_id, j.width, j.height, cs, pf, padding, raw, None))
            yield pd.DataFrame(out, columns=_DECODED).astype(_INTS)

    parts = files.select("image_id", F.col(column).alias("data")).mapInPandas(
        split, "image_id long, scan int, seg int, data binary, head binary, error string"
    )
    found = parts.repartition("image_id", "scan", "seg").mapInPandas(
        blocks, "image_id long, band int, head binary, at binary, blocks binary, scan int, seg int, error string"
    )
    bands = found.groupBy("image_id", "band").applyInPandas(pixels, "image_id long, band int, head binary, rows binary, error string")
    whole = bands.groupBy("image_id").agg(
        F.first("head", ignorenulls=True).alias("head"), F.collect_list(F.struct("band", "rows", "error")).alias("bands")
    )
    return whole.mapInPandas(join, f"{IMAGES}, error string")


def durations(images: DataFrame, params: Params | None = None) -> DataFrame:
    """image_id, stage, milliseconds: of encoding and decoding each image, stage by stage, in the task that does it."""
    p = params or Params()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                marks = [("start", time.perf_counter())]
                done = lambda stage: marks.append((stage, time.perf_counter()))  # noqa: B023, E731
                comps, coefs, restart = J.quantise(*_image(row), p)
                done("encode: transform")
                found = list(J.segments_of(comps, coefs, p.interleaved))
                packed = J.pack_all([(comp, blocks) for _, _, _, comp, blocks in found], [c.kind for c in comps])
                done("encode: entropy code")
                bits = [(scan, seg, data) for (scan, seg, *_), data in zip(found, packed, strict=True)]
                jpeg = J.assemble(row.width, row.height, comps, restart, p, bits)
                done("encode: container")
                j = J.read(jpeg)
                done("decode: container")
                coefs = J.coefficients(j)
                done("decode: entropy code")
                J.rebuild(j, coefs)
                done("decode: transform")
                out += [(row.image_id, stage, 1000 * (b - a)) for (_, a), (stage, b) in zip(marks, marks[1:], strict=False)]
            yield pd.DataFrame(out, columns=["image_id", "stage", "milliseconds"])

    return images.mapInPandas(run, "image_id long, stage string, milliseconds double")


def split_segments(files: DataFrame, column: str = "jpeg", use_index: bool = False) -> DataFrame:
    """image_id, scan, seg, data: restart segments of files, by their markers or by their segment index."""

    def run(batches):
        for batch in batches:
            out = []
            for i, data in zip(batch.image_id, batch.data, strict=True):
                for k, (_, parts, _) in enumerate(J.read(bytes(data), use_index=use_index).scans):
                    out += [(i, k, s, part) for s, part in enumerate(parts)]
            yield pd.DataFrame(out, columns=["image_id", "scan", "seg", "data"])

    return files.select("image_id", F.col(column).alias("data")).mapInPandas(run, "image_id long, scan int, seg int, data binary")


def coefficients(files: DataFrame, column: str = "jpeg", spread: bool = True) -> DataFrame:
    """image_id, scan, seg, comp, by, bx, coefs (array, zig-zag): decoded segment by segment.

    With ``spread`` segments are dealt out with the head of their file, so a large image with restart markers takes many tasks.
    """

    def split(batches):
        for batch in batches:
            for i, data in zip(batch.image_id, batch.data, strict=True):
                data = bytes(data)
                j, bare = J.read(data), J.bare(data)
                out = [(i, k, s, part, bare) for k, (_, parts, _) in enumerate(j.scans) for s, part in enumerate(parts)]
                yield pd.DataFrame(out, columns=["image_id", "scan", "seg", "data", "head"])

    def run(batches):
        for batch in batches:
            out = []
            for head, part in batch.groupby("head", sort=False):
                wanted = [(row.scan, row.seg, bytes(row.data)) for row in part.itertuples()]
                for i, (scan, seg, _), (comp, by, bx, blocks) in zip(
                    part.image_id, wanted, J.decode_segments(J.read(bytes(head)), wanted), strict=True
                ):
                    out += [(i, scan, seg, int(c), int(y), int(x), b) for c, y, x, b in zip(comp, by, bx, blocks, strict=True)]
            yield pd.DataFrame(out, columns=["image_id", "scan", "seg", "comp", "by", "bx", "coefs"])

    parts = files.select("image_id", F.col(column).alias("data")).mapInPandas(
        split, "image_id long, scan int, seg int, data binary, head binary"
    )
    parts = parts.repartition("image_id", "scan", "seg") if spread else parts
    return parts.mapInPandas(run, "image_id long, scan int, seg int, comp int, by int, bx int, coefs array<int>")


def jpeg_info(files: DataFrame, column: str = "jpeg", count_segments: bool = True, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """What the markers of files say, without decoding; not even scans are read unless segments are to be counted."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.data:
                try:
                    j = J.read(bytes(data), stop_at_scan=not count_segments)
                    out.append(
                        (
                            j.width,
                            j.height,
                            len(j.ids),
                            [{"h": h, "v": v} for h, v in j.sampling],
                            j.color_space,
                            j.interleaved,
                            j.restart,
                            j.segment_count if count_segments else None,
                            j.header,
                            j.comment,
                            {"rotation": j.orientation[0], "flip": j.orientation[1]} if j.orientation else None,
                            j.warning,
                            None,
                        )
                    )
                except Exception as e:  # noqa: BLE001
                    out.append((None,) * 12 + (_failing("PERMISSIVE", e),))
            names = [
                f.split(" ")[0] for f in (
                    "width",
                    "height",
                    "comp_count",
                    "sampling",
                    "color_space",
                    "interleaved",
                    "restart_interval",
                    "segment_count",
                    "header_type",
                    "comment",
                    "orientation",
                    "warning",
                    "error",
                )
            ]
            frame = pd.DataFrame(out, columns=names).astype(
                {c: "Int32" for c in ("width", "height", "comp_count", "restart_interval", "segment_count")}
            ).astype({"interleaved": "boolean"})
            for k in reversed(keys):
                frame.insert(0, k, batch[k].to_numpy())
            yield frame

    heads = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, F.col(column).alias("data")).mapInPandas(run, f"{heads}, {INFO}")


def jpeg_markers(files: DataFrame, column: str = "jpeg") -> DataFrame:
    """image_id, ord, byte_offset, marker, length: every marker, scans' bits as marker 0."""

    def run(batches):
        for batch in batches:
            out = [(i, k, at, code, len(payload)) for i, data in zip(batch.image_id, batch.data, strict=True) for k, (at, code, payload) in enumerate(J.markers(bytes(data)))]
            yield pd.DataFrame(out, columns=["image_id", "ord", "byte_offset", "marker", "length"])

    return files.select("image_id", F.col(column).alias("data")).mapInPandas(
        run, "image_id long, ord int, byte_offset long, marker int, length int"
    )


def exif_tags(files: DataFrame, column: str = "jpeg") -> DataFrame:
    """image_id, tag, value: the 0th IFD of each file's Exif."""

    def run(batches):
        for batch in batches:
            out = [(i, tag, str(v)) for i, data in zip(batch.image_id, batch.data, strict=True) for _, code, payload in J.markers(bytes(data), stop_at_scan=True) if code == 0xE1 for tag, v in J.parse_exif(payload).items()]
            yield pd.DataFrame(out, columns=["image_id", "tag", "value"])

    return files.select("image_id", F.col(column).alias("data")).mapInPandas(run, "image_id long, tag int, value string")


def reindex(files: DataFrame, column: str = "jpeg") -> DataFrame:
    """Files with a segment index before each scan, all else unchanged."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"image_id": batch.image_id, "jpeg": [J.reindex(bytes(d)) for d in batch.data]})

    return files.select("image_id", F.col(column).alias("data")).mapInPandas(run, "image_id long, jpeg binary")


def options(params: Params | None = None, **changes) -> Params:
    """Parameters with changes by name; text values are read as their option strings."""
    read = {
        "quality": int, "restart_interval": lambda v: None if v == "auto" else int(v), "interleaved": lambda v: str(v).lower() in (
            "1", "true", "yes"
        ),
        "segment_info": lambda v: str(v).lower() in ("1", "true", "yes"), "comp_count": int, "flip": lambda v: str(v).lower() in (
            "1", "true", "yes"
        ),
    }
    return dataclasses.replace(params or Params(), **{k: read[k](v) if k in read and isinstance(v, str) else v for k, v in changes.items()})
