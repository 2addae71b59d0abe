"""Media columns: what the bytes of a column really are, and media hidden inside them.

Magic bytes of all known formats are located in one pass of an automaton over the whole value. A hit only
counts if the format's own structure holds there: header fields, chunk chains, lengths within the value,
end marks. A valid hit at the start corrects the declared type; valid hits further in are carved out.

Payloads are stored as 8-bit samples in a RIFF/WAVE container and read back from the stored bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import column

UNKNOWN = "application/octet-stream"
#: Magic bytes, where they stand in a file, and the type they announce (public format definitions).
MAGIC = [
    (b"RIFF", 0, "riff"), (b"\x89PNG\r\n\x1a\n", 0, "image/png"), (b"\xff\xd8\xff", 0, "image/jpeg"), (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"), (b"%PDF-", 0, "application/pdf"), (b"PK\x03\x04", 0, "application/zip"), (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"), (b"OggS", 0, "audio/ogg"), (b"BM", 0, "image/bmp"), (b"ftyp", 4, "video/mp4"),
]


#: Bytes of a compressed stream that are read at once.
PIECE = 1 << 16


class Marks:
    """Where the end marks of a value stand: each kind is looked for once, however many beginnings ask for it."""

    def __init__(self, value: bytes):
        self.value, self.found = value, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1."""
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.value)]
        places = self.found[mark]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1


def _riff(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    """Chunks must follow each other up to the stated length; audio needs a format before its samples."""
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, pos, seen = at + 8 + size, at + 12, []
    if end > len(b) or size < 4:
        return None
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + n > end:
            return None
        seen.append(name)
        pos += 8 + n + n % 2
    if form == b"WAVE" and b"fmt " in seen and b"data" in seen and seen.index(b"fmt ") < seen.index(b"data"):
        return "audio/wav", end - at
    return ("image/webp", end - at) if form == b"WEBP" and seen and seen[0] in (b"VP8 ", b"VP8L", b"VP8X") else None


def _png(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or first and (name != b"IHDR" or n != 13):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return "image/png", pos - at
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind, n = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(b):
            return None
        pos += 2 + n
        if kind == 0xDA:
            end = marks.after(b"\xff\xd9", pos)
            return ("image/jpeg", end + 2 - at) if end >= 0 else None
    return None


def _gif(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 14 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return "image/gif", pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            own = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            return None
    return None


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    end = marks.after(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if 0 <= marks.after(b"startxref", at) < end else None


def _zip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, begin, note = struct.unpack_from("<IIH", b, end + 12)
    return ("application/zip", end + 22 + note - at) if begin + size == end - at and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    reader, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not reader.eof:
            piece = b[pos : pos + PIECE]
            pos += len(piece)
            while piece and not reader.eof:
                reader.decompress(piece, 1 << 20)
                piece = reader.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", pos - at - len(reader.unused_data)) if reader.eof else None


def _flac(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    return ("audio/flac", len(b) - at) if at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and b[at + 5 : at + 8] == b"\0\0\x22" else None


def _ogg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        n = b[pos + 26]
        after = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if after > len(b):
            return None
        pos = after
    return ("audio/ogg", pos - at) if pos > at else None


def _bmp(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, spare, begin, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", size) if spare == 0 and header in (12, 40, 108, 124) and 14 + header <= begin <= size and at + size <= len(b) else None


def _mp4(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    pos = at
    while pos + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if n < 8 or pos + n > len(b) or not name.isalnum():
            break
        pos += n
    return ("video/mp4", pos - at) if pos > at + 8 else None


CHECKS = {
    "riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
    "audio/flac": _flac, "audio/ogg": _ogg, "image/bmp": _bmp, "video/mp4": _mp4,
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) - 1 + offset, kind))
    a.make_automaton()
    return a


def sniff(value: bytes, declared: str = UNKNOWN) -> tuple[str, list[tuple[int, int, str]]]:
    """The true type of a value and the media carved from it as (begin, length, type).

    The declared type stays if nothing valid begins at 0. What lies inside a valid container that starts
    the value is carved too; media inside carved media are not carved again. b"" keeps its declared type.
    """
    kind, carved, covered, marks = declared, [], 0, Marks(value)
    for end, (back, name) in _automaton().iter(value.decode("latin-1")):
        at = end - back
        if at < 0 or 0 < at < covered or at == 0 and kind != declared:
            continue
        if found := CHECKS[name](value, at, marks):
            if at == 0:
                kind = found[0]
            else:
                carved.append((at, found[1], found[0]))
                covered = at + found[1]
    return kind, carved


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Bytes as the 8-bit samples of one channel."""
    pad = len(samples) % 2
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def wav_samples(stored: bytes) -> bytes:
    """The samples of a RIFF/WAVE value, found through its chunks."""
    pos = 12
    while pos + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, pos)
        if name == b"data":
            return stored[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    raise ValueError("no samples")


def padded(text: str | None) -> bytes:
    """A text as UTF-8 with bytes 0 up to a positive multiple of 64; null is empty."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % 64 if data else 64)


def features(samples: bytes) -> dict[str, float]:
    """Loudness and shape of 8-bit samples: mean, deviation, peak, crossings of the middle, entropy of levels."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256)[:256] / max(len(x), 1)
    share = share[share > 0]
    mean = float(x.mean()) if len(x) else 0.0
    return {
        "mean": mean, "dev": float(x.std()) if len(x) else 0.0, "peak": int(x.max(initial=0)),
        "cross": int(np.count_nonzero(np.diff(x > mean))), "bits": float(-(share * np.log2(share)).sum()),
    }


STORED = "doc_id long, n_bytes long, media binary, declared string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, carved int"


def store_texts(docs: DataFrame, declared: str = UNKNOWN) -> DataFrame:
    """Texts as a media column: (doc_id, n_bytes, media, declared). Null text is empty; every row is kept. Columns other than doc_id and
    text are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([wav(padded(t)) for t in texts], pa.binary()), pa.array([declared] * len(texts), pa.string())],
                ["doc_id", "n_bytes", "media", "declared"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def inspect_media(media: DataFrame) -> DataFrame:
    """Type, carved media and sample features of a media column (doc_id, n_bytes, media, declared).

    One row per row. Samples are read back from audio/wav; other types give null digests of the payload and
    an empty feature. Null media counts as empty. ``carved`` is the number of media found inside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, declared in zip(column(batch, "media").to_pylist(), column(batch, "declared").to_pylist(), strict=True):
                value = value or b""
                kind, carved = sniff(value, declared or UNKNOWN)
                payload = wav_samples(value) if kind == "audio/wav" else None
                feature = ""
                if payload is not None:
                    f = features(payload)
                    inside = ",".join(f"{k}@{a}+{n}" for a, n, k in carved)
                    feature = f"{kind};mean={f['mean']:.4f};dev={f['dev']:.4f};peak={f['peak']};cross={f['cross']};bits={f['bits']:.4f};carved={inside}"
                rows.append((
                    None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(),
                    None if payload is None else zlib.crc32(payload[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature, kind, len(carved)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "n_bytes"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "carved"])

    return media.select("doc_id", "n_bytes", "media", "declared").mapInArrow(run, DIGEST)
