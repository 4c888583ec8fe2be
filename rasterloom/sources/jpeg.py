"""What the headers of a JPEG stream say, without decoding it."""

from __future__ import annotations

from dataclasses import dataclass

from .storage import FormatError

#: Markers of frame headers, and markers without a length. Fixed values.
FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})
ALONE = frozenset({0x01, *range(0xD0, 0xD9)})
#: Beginnings of JPEG XL streams. Fixed values.
JXL = (b"\xff\x0a", b"\x00\x00\x00\x0cJXL \r\n\x87\n")


@dataclass(frozen=True)
class Frame:
    marker: int
    precision: int
    width: int
    height: int
    components: int


def frame_header(data: bytes) -> Frame | None:
    """The first frame header of a stream; None if it isn't JPEG or breaks off before one."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker == 0xDA or marker == 0xD9:
            return None
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if marker in FRAMES:
                body = data[at + 4 : at + 10]
                if len(body) < 6:
                    return None
                return Frame(marker, body[0], int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), body[5])
            at += 2 + size
    return None


def baseline_size(data: bytes) -> tuple[int, int] | None:
    """Width and height, of baseline streams of 8 bits only."""
    f = frame_header(data)
    return (f.width, f.height) if f and f.marker == 0xC0 and f.precision == 8 else None


def codec_of(payload: bytes) -> str:
    """JPEG, SOF3 (lossless) or JXL by signature."""
    if payload.startswith(b"\xff\xd8"):
        f = frame_header(payload)
        if f is None:
            raise FormatError("jpeg_header_invalid", "codec")
        return "SOF3" if f.marker == 0xC3 else "JPEG"
    if payload.startswith(JXL):
        return "JXL"
    raise FormatError("unsupported_codec", "codec")
