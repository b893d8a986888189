"""DICOM files: data sets, their frames, and the samples of a frame.

Transfer syntaxes: little-endian explicit and implicit, deflated, and RLE Lossless (in fragments, with or without an offset table). Any other is an error that names it.
A file may have many frames; each is a plane, with a position of its own where the file gives one, else a slice thickness further along the normal.
Samples are those bits that are stored, with their sign.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

# fixed values of the format
EXPLICIT, IMPLICIT, DEFLATED, RLE = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
#: Value representations whose explicit form has a 4-byte length.
LONG_VR = {b"OB", b"OW", b"OF", b"OD", b"SQ", b"UT", b"UN", b"UC", b"UR", b"OL", b"OV", b"SV", b"UV"}
UNDEFINED = 0xFFFFFFFF
SYNTAX, PIXELS, ITEM, ITEM_END, SEQUENCE_END = 0x00020010, 0x7FE00010, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
SERIES, INSTANCE, POSITION, ORIENTATION = 0x0020000E, 0x00200013, 0x00200032, 0x00200037
FRAMES, ROWS, COLUMNS, SAMPLES_PER_PIXEL, PIXEL_SPACING = 0x00280008, 0x00280010, 0x00280011, 0x00280002, 0x00280030
ALLOCATED, STORED, HIGH, SIGNED, INTERCEPT, SLOPE = 0x00280100, 0x00280101, 0x00280102, 0x00280103, 0x00281052, 0x00281053
THICKNESS, BETWEEN = 0x00180050, 0x00180088
SHARED_GROUPS, FRAME_GROUPS, PLANE_POSITION, PLANE_ORIENTATION, PIXEL_MEASURES, VALUE_TRANSFORM = 0x52009229, 0x52009230, 0x00209113, 0x00209116, 0x00289110, 0x00289145
#: Sequences that are looked into; the implicit form doesn't say that they are sequences.
SEQUENCES = {SHARED_GROUPS, FRAME_GROUPS, PLANE_POSITION, PLANE_ORIENTATION, PIXEL_MEASURES, VALUE_TRANSFORM}
KINDS = {(8, False): "uchar", (8, True): "schar", (16, False): "ushort", (16, True): "short", (32, False): "uint", (32, True): "int"}
NUMPY = {"uchar": "u1", "schar": "i1", "ushort": "<u2", "short": "<i2", "uint": "<u4", "int": "<i4"}


class NotDicom(ValueError):
    """A file without the format's mark."""


def _read(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the file is cut short")
    return data


def _head(f, explicit: bool, head: bytes) -> tuple[int, bytes, int]:
    """(tag, value representation, length) of an element whose first 4 bytes are ``head``."""
    group, element = struct.unpack("<HH", head)
    tag = group << 16 | element
    if group == 0xFFFE:
        return tag, b"", struct.unpack("<I", _read(f, 4))[0]
    if not explicit:
        return tag, b"", struct.unpack("<I", _read(f, 4))[0]
    vr = _read(f, 2)
    if vr in LONG_VR:
        _read(f, 2)
        return tag, vr, struct.unpack("<I", _read(f, 4))[0]
    return tag, vr, struct.unpack("<H", _read(f, 2))[0]


def _elements(f, explicit: bool, end: int | None, top: bool) -> dict:
    """Elements by tag up to ``end``, the end of the item, or the pixel data of the top level (whose place and length are given, not its bytes)."""
    out: dict = {}
    while end is None or f.tell() < end:
        head = f.read(4)
        if not head and top:
            break
        if len(head) < 4:
            raise ValueError("the file is cut short")
        tag, vr, length = _head(f, explicit, head)
        if tag in (ITEM_END, SEQUENCE_END):
            break
        if tag == PIXELS and top:
            out[PIXELS] = (f.tell(), length)
            break
        if tag == PIXELS and length == UNDEFINED:
            _fragments(f)
        elif vr == b"SQ" or length == UNDEFINED or tag in SEQUENCES:
            out[tag] = _items(f, explicit and vr != b"UN", length)
        else:
            out[tag] = _read(f, length)
    return out


def _items(f, explicit: bool, length: int) -> list[dict]:
    out, end = [], None if length == UNDEFINED else f.tell() + length
    while end is None or f.tell() < end:
        tag, n = _item(f)
        if tag == SEQUENCE_END:
            break
        out.append(_elements(f, explicit, None if n == UNDEFINED else f.tell() + n, False))
    return out


def _item(f) -> tuple[int, int]:
    group, element, n = struct.unpack("<HHI", _read(f, 8))
    tag = group << 16 | element
    if tag not in (ITEM, SEQUENCE_END):
        raise ValueError("a sequence has no end")
    return tag, n


def _fragments(f) -> tuple[bytes, list[tuple[int, int]]]:
    """The offset table, and place and length of each fragment; their bytes aren't read."""
    table, parts = None, []
    while True:
        tag, n = _item(f)
        if tag == SEQUENCE_END:
            return table or b"", parts
        if table is None:
            table = _read(f, n)
        else:
            parts.append((f.tell(), n))
            f.seek(f.tell() + n)


def _opened(f) -> tuple[object, str]:
    """The file after its meta group (inflated, if it is deflated), and the transfer syntax."""
    f.seek(0)
    if f.read(132)[128:] != b"DICM":
        raise NotDicom("not a DICOM file")
    syntax = IMPLICIT
    while True:
        at = f.tell()
        head = f.read(4)
        if len(head) < 4 or head[:2] != b"\x02\0":
            f.seek(at)
            break
        tag, _, length = _head(f, True, head)
        value = _read(f, length)
        if tag == SYNTAX:
            syntax = value.rstrip(b"\0 ").decode("latin-1")
    if syntax not in (EXPLICIT, IMPLICIT, DEFLATED, RLE):
        raise ValueError(f"transfer syntax {syntax} isn't supported")
    if syntax == DEFLATED:
        z = zlib.decompressobj(-zlib.MAX_WBITS)
        try:
            data = z.decompress(f.read())
        except zlib.error as e:
            raise ValueError(f"deflated data: {e}") from e
        if not z.eof:
            raise ValueError("the deflated data are cut short")
        return io.BytesIO(data), syntax
    return f, syntax


def _frame_parts(f, syntax: str, place: tuple[int, int], frames: int, size: int) -> list[list[tuple[int, int]]]:
    """Place and length of each frame's bytes, in parts."""
    at, length = place
    if length != UNDEFINED:
        if syntax == RLE:
            raise ValueError("RLE samples aren't in fragments")
        if length < frames * size:
            raise ValueError(f"{frames} frames of {size} bytes don't fit in {length}")
        return [[(at + k * size, size)] for k in range(frames)]
    f.seek(at)
    table, parts = _fragments(f)
    if syntax != RLE:
        raise ValueError("samples that aren't compressed are in fragments")
    starts = list(struct.unpack(f"<{len(table) // 4}I", table))
    if len(starts) == frames and parts:
        base = parts[0][0] - 8
        ends = [*starts[1:], UNDEFINED]
        found = [[p for p in parts if a <= p[0] - 8 - base < b] for a, b in zip(starts, ends, strict=True)]
    elif len(parts) == frames:
        found = [[p] for p in parts]
    elif frames == 1:
        found = [parts]
    else:
        found = []
    if len(found) != frames or not all(found):
        raise ValueError(f"{len(parts)} fragments for {frames} frames, and no offsets that tell them apart")
    return found


def frames(f) -> list[dict]:
    """The frames of a file, without their samples; none where it has no pixel data."""
    f, syntax = _opened(f)
    top = _elements(f, syntax != IMPLICIT, None, True)
    if PIXELS not in top:
        return []
    text = lambda d, tag: d.get(tag, b"").rstrip(b"\0 ").decode("latin-1").strip()
    numbers = lambda d, tag: [float(x) for x in text(d, tag).split("\\")] if text(d, tag) else None
    word = lambda tag, default: struct.unpack("<H", top[tag][:2])[0] if len(top.get(tag, b"")) >= 2 else default
    inside = lambda groups, tag: (groups.get(tag) or [{}])[0]
    shared, own = (top.get(SHARED_GROUPS) or [{}])[0], top.get(FRAME_GROUPS) or []
    n, nx, ny = int(text(top, FRAMES) or 1), word(COLUMNS, 0), word(ROWS, 0)
    bits, signed = word(ALLOCATED, 16), word(SIGNED, 0) == 1
    kind = KINDS.get((bits, signed))
    if kind is None:
        raise ValueError(f"{bits} bits a sample")
    if word(SAMPLES_PER_PIXEL, 1) != 1:
        raise ValueError(f"{word(SAMPLES_PER_PIXEL, 1)} samples a pixel")
    stored = word(STORED, bits)
    high = word(HIGH, stored - 1)
    parts = _frame_parts(f, syntax, top[PIXELS], n, nx * ny * bits // 8)
    out = []
    for k in range(n):
        groups = own[k] if k < len(own) else {}

        def said(group: int, tag: int, groups: dict = groups):
            return numbers(inside(groups, group), tag) or numbers(inside(shared, group), tag) or numbers(top, tag)

        spacing, thick = said(PIXEL_MEASURES, PIXEL_SPACING) or [1.0, 1.0], (said(PIXEL_MEASURES, BETWEEN) or said(PIXEL_MEASURES, THICKNESS) or [1.0])[0]
        a, b = np.split(np.array(said(PLANE_ORIENTATION, ORIENTATION) or [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), 2)
        normal = np.cross(a, b)
        position = numbers(inside(groups, PLANE_POSITION), POSITION)
        if position is None and (first := said(PLANE_POSITION, POSITION)):
            position = list(np.array(first) + k * thick * normal)
        out.append(
            {
                "series": text(top, SERIES),
                "instance": int(text(top, INSTANCE) or 0),
                "frame": k,
                "nx": nx,
                "ny": ny,
                "spacing": [spacing[1], spacing[0], thick],
                "origin": [float(x) for x in position or (0.0, 0.0, 0.0)],
                "along": float(np.dot(position, normal)) if position else None,
                "direction": [float(x) for i in range(3) for x in (a[i], b[i], normal[i])],
                "scalar_type": kind,
                "parts": parts[k],
                "encoding": {RLE: "rle", DEFLATED: "deflated"}.get(syntax, "raw"),
                "stored": stored,
                "high": high,
                "slope": (said(VALUE_TRANSFORM, SLOPE) or [1.0])[0],
                "intercept": (said(VALUE_TRANSFORM, INTERCEPT) or [0.0])[0],
            }
        )
    return out


def _unpacked(data: bytes, size: int) -> np.ndarray:
    """PackBits: a byte n below 128 is followed by n + 1 bytes as they are, one above 128 by a byte that comes 257 - n times."""
    out, at, n, end = np.zeros(size, np.uint8), 0, 0, len(data)
    while n < size and at < end:
        c = data[at]
        if c < 128:
            part = np.frombuffer(data, np.uint8, min(c + 1, end - at - 1), at + 1)[: size - n]
            out[n : n + len(part)] = part
            n, at = n + len(part), at + c + 2
        elif c > 128:
            if at + 1 >= end:
                break
            more = min(257 - c, size - n)
            out[n : n + more] = data[at + 1]
            n, at = n + more, at + 2
        else:
            at += 1
    if n < size:
        raise ValueError("an RLE segment is cut short")
    return out


def _from_rle(data: bytes, pixels: int, width: int) -> np.ndarray:
    """Bytes of little-endian samples from planes of bytes, the highest first."""
    if len(data) < 64:
        raise ValueError("an RLE frame is cut short")
    n, *starts = struct.unpack_from("<16I", data)
    if n != width:
        raise ValueError(f"{n} RLE segments for samples of {width} bytes")
    ends = [*starts[1:n], len(data)]
    planes = [_unpacked(data[a:b], pixels) for a, b in zip(starts[:n], ends, strict=True)]
    return np.ascontiguousarray(np.stack(planes[::-1], axis=1)).reshape(-1)


def samples(f, r: dict) -> np.ndarray:
    """The samples of a frame (a row of ``frames``), as stored: no slope or intercept."""
    kind = np.dtype(NUMPY[r["scalar_type"]])
    if r["encoding"] == "deflated":
        f, _ = _opened(f)
    data = b""
    for at, length in r["parts"]:
        f.seek(at)
        data += _read(f, length)
    pixels = r["nx"] * r["ny"]
    raw = _from_rle(data, pixels, kind.itemsize) if r["encoding"] == "rle" else np.frombuffer(data, np.uint8)
    if len(raw) < pixels * kind.itemsize:
        raise ValueError("a frame is cut short")
    bits, stored, low = 8 * kind.itemsize, r["stored"], r["high"] + 1 - r["stored"]
    values = raw[: pixels * kind.itemsize].view(kind)
    if stored == bits:
        return values
    whole = values.view(f"<u{kind.itemsize}").astype(np.int64) >> low & ((1 << stored) - 1)
    return np.where(whole >> (stored - 1) & 1, whole - (1 << stored), whole) if kind.kind == "i" else whole


def _element(tag: int, vr: bytes, value: bytes) -> bytes:
    value += (b"\0" if vr == b"UI" or vr in LONG_VR else b" ") * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr
    return head + (b"\0\0" + struct.pack("<I", len(value)) if vr in LONG_VR else struct.pack("<H", len(value))) + value


def _packed(data: np.ndarray) -> bytes:
    """PackBits of bytes: runs of three and more as runs, the rest as they are."""
    starts = np.append(np.flatnonzero(np.append(True, data[1:] != data[:-1])), len(data))
    out, plain = bytearray(), bytearray()

    def flush():
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.extend(bytes([len(part) - 1]) + part)
        plain.clear()

    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 3:
            plain += data[a:b].tobytes()
            continue
        flush()
        for k in range(a, b, 128):
            n = min(128, b - k)
            out += bytes([257 - n, data[a]]) if n > 1 else bytes([0, data[a]])
    flush()
    return bytes(out) + b"\0" * (len(out) % 2)


def _to_rle(frame: np.ndarray) -> bytes:
    width = frame.dtype.itemsize
    planes = [_packed(np.ascontiguousarray(frame.reshape(-1).view(np.uint8).reshape(-1, width)[:, k])) for k in reversed(range(width))]
    starts = np.cumsum([64, *map(len, planes)])[:-1].tolist()
    return struct.pack("<16I", width, *starts, *[0] * (15 - width)) + b"".join(planes)


def written(frames_: np.ndarray, series: str, instance: int, origin: tuple[float, float, float], thickness: float, syntax: str = EXPLICIT) -> bytes:
    """A file of 16-bit signed frames (along the first axis), a slice thickness apart from ``origin`` along z."""
    n, ny, nx = frames_.shape
    data, word = frames_.astype("<i2"), lambda x: struct.pack("<H", x)
    body = b"".join(
        _element(tag, vr, value)
        for tag, vr, value in (
            (THICKNESS, b"DS", f"{thickness:.10g}".encode()),
            (SERIES, b"UI", series.encode()),
            (INSTANCE, b"IS", str(instance).encode()),
            (POSITION, b"DS", "\\".join(f"{x:.10g}" for x in origin).encode()),
            (FRAMES, b"IS", str(n).encode()),
            (ROWS, b"US", word(ny)),
            (COLUMNS, b"US", word(nx)),
            (ALLOCATED, b"US", word(16)),
            (SIGNED, b"US", word(1)),
        )
    )
    if syntax == RLE:
        item = lambda x: struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x
        parts = [item(_to_rle(f)) for f in data]
        table = np.cumsum([0, *map(len, parts)])[:-1].astype("<u4").tobytes()
        body += struct.pack("<HH", PIXELS >> 16, PIXELS & 0xFFFF) + b"OB\0\0" + struct.pack("<I", UNDEFINED) + item(table) + b"".join(parts) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    else:
        body += _element(PIXELS, b"OW", data.tobytes())
    if syntax == DEFLATED:
        z = zlib.compressobj(wbits=-zlib.MAX_WBITS)
        body = z.compress(body) + z.flush()
    return b"\0" * 128 + b"DICM" + _element(SYNTAX, b"UI", syntax.encode()) + body
