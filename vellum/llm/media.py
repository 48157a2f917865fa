"""Media columns: signature sniffing, validation, correction of declared types and carving of embedded media.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a cell; the validator of each
hit's format then walks the format's own structure (chunks, blocks, boxes, pages) and confirms its length. A declared
type gives way to the confirmed type at offset 0, and confirmed media further on are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from . import common as C

UNKNOWN = "application/octet-stream"


def _png(d: bytes, at: int) -> tuple[int, str] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, pos)
        if pos + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(d[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", d, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at, "image/png"
    return None


def _jpeg(d: bytes, at: int) -> tuple[int, str] | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(d) and d[pos] == 0xFF:
        mark = d[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if mark == 0xD9:
            return (pos + 2 - at, "image/jpeg") if frame else None
        n = struct.unpack_from(">H", d, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(d):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data, up to a marker that is neither stuffing nor a restart
            while True:
                pos = d.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(d):
                    return None
                if d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
    if d[pos : pos + 2] == b"\xff\xd9" and frame:
        return pos + 2 - at, "image/jpeg"
    return None


def _gif(d: bytes, at: int) -> tuple[int, str] | None:
    if at + 13 > len(d):
        return None

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(pos: int) -> int:
        while pos < len(d) and d[pos]:
            pos += d[pos] + 1
        return pos + 1

    pos, image = at + 13 + table(d[at + 10]), False
    while pos < len(d):
        if d[pos] == 0x3B:
            return (pos + 1 - at, "image/gif") if image else None
        if d[pos] == 0x21:
            pos = blocks(pos + 2)
        elif d[pos] == 0x2C and pos + 10 < len(d):
            pos, image = blocks(pos + 10 + table(d[pos + 9]) + 1), True
        else:
            return None
    return None


def _bmp(d: bytes, at: int) -> tuple[int, str] | None:
    if at + 26 > len(d):
        return None
    size, reserved, data, head = struct.unpack_from("<IIII", d, at + 2)
    if reserved or head not in (12, 40, 52, 56, 64, 108, 124) or not 14 + head <= data <= size or at + size > len(d):
        return None
    return size, "image/bmp"


def _riff(d: bytes, at: int) -> tuple[int, str] | None:
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    end, pos, seen = at + 8 + size, at + 12, set()
    if not kind or end > len(d):
        return None
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, pos)
        seen.add(name)
        pos += 8 + n + (n & 1)
    need = {"audio/wav": [{b"fmt ", b"data"}], "image/webp": [{b"VP8 "}, {b"VP8L"}, {b"VP8X"}], "video/avi": [{b"LIST"}]}[kind]
    return (8 + size, kind) if pos in (end, end + 1) and any(x <= seen for x in need) else None


def _crc_step(top: int) -> int:
    crc = top << 24
    for _ in range(8):
        crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


_OGG = [_crc_step(i) for i in range(256)]


def _ogg_crc(page: bytes) -> int:
    crc = 0
    for b in page:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _OGG[crc >> 24 ^ b]
    return crc


def _ogg(d: bytes, at: int) -> tuple[int, str] | None:
    pos = at
    if at + 27 > len(d) or not d[at + 5] & 2:  # a stream begins with a page that says so
        return None
    while d[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(d):
        n = d[pos + 26]
        end = pos + 27 + n + sum(d[pos + 27 : pos + 27 + n])
        if end > len(d) or _ogg_crc(d[pos : pos + 22] + b"\0\0\0\0" + d[pos + 26 : end]) != struct.unpack_from("<I", d, pos + 22)[0]:
            return None
        last, pos = d[pos + 5] & 4, end
        if last:
            return pos - at, "audio/ogg"
    return None


def _mp4(d: bytes, at: int) -> tuple[int, str] | None:
    at, pos, seen = at - 4, at - 4, set()
    while at >= 0 and pos + 8 <= len(d):
        n, name = struct.unpack_from(">I4s", d, pos)
        if n == 1 and pos + 16 <= len(d):
            n = struct.unpack_from(">Q", d, pos + 8)[0]
        if name not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"meta", b"wide", b"pdin") or n < 8 or pos + n > len(d):
            break
        seen.add(name)
        pos += n
    return (pos - at, "video/mp4") if {b"ftyp", b"moov"} <= seen else None


#: (magic bytes, distance of the magic bytes from the start, validator)
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"BM", 0, _bmp),
    (b"RIFF", 0, _riff),
    (b"OggS", 0, _ogg),
    (b"ftyp", 4, _mp4),
]

_automaton = None


def automaton():
    """The automaton of all magic bytes, built once in each worker; bytes are taken as the first 256 code points."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, back, check in SIGNATURES:
            _automaton.add_word(magic.decode("latin-1"), (len(magic), back, check))
        _automaton.make_automaton()
    return _automaton


def sniff(content: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of confirmed media: one at 0 if any, and embedded ones that don't overlap each other.

    What is embedded in the medium at 0 counts; what is embedded in an embedded medium doesn't.
    """
    found, end = [], 0
    for last, (size, back, check) in automaton().iter(content.decode("latin-1")):
        at = last + 1 - size
        start = at - back
        if start < 0 or (start > 0 and start < end):
            continue
        if got := check(content, at):
            found.append((start, got[0], got[1]))
            end = start + got[0] if start else end
    return found


def sniff_column(df: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with detected_type, is_valid, corrected and embedded (array of offset, length, type).

    detected_type is the confirmed type at offset 0; if none is, the declared type stays and is_valid is false.
    Null content: nulls and an empty array. Input columns named as an output are replaced.
    """
    df = C.without(df, "detected_type", "is_valid", "corrected", "embedded")
    C.bounded_batches(df.sparkSession)
    media = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
    names = [*df.columns, "detected_type", "is_valid", "corrected", "embedded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types, valid, corrected, embedded = [], [], [], []
            said = b.column(names.index(declared)).to_pylist() if declared else [UNKNOWN] * b.num_rows
            for cell, was in zip(b.column(names.index(content)), said, strict=True):
                found = sniff(cell.as_py()) if cell.is_valid else []
                top = found[0][2] if found and found[0][0] == 0 else None
                types.append((top or was) if cell.is_valid else None)
                valid.append(top is not None if cell.is_valid else None)
                corrected.append(top is not None and top != was if cell.is_valid else None)
                embedded.append([{"offset": o, "length": n, "type": t} for o, n, t in found if o])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(valid, pa.bool_()), pa.array(corrected, pa.bool_()), pa.array(embedded, media)], names)

    item = StructType([StructField("offset", LongType()), StructField("length", LongType()), StructField("type", StringType())])
    added = [("detected_type", StringType()), ("is_valid", BooleanType()), ("corrected", BooleanType()), ("embedded", ArrayType(item))]
    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(*x) for x in added]]))


def carve(df: DataFrame, content: str) -> DataFrame:
    """A row for each embedded medium of each cell: the columns of ``df`` but ``content``, and media_offset, media_length, media_type and media (its bytes).

    Null and empty cells, and those that embed nothing, have no rows. Input columns named as an output are replaced.
    """
    outputs = ("media_offset", "media_length", "media_type", "media")
    rest = [c for c in C.without(df, *outputs, content).columns]
    found = sniff_column(df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{content}`").alias("_vl_content")) if rest else df.select(F.col(f"`{content}`").alias("_vl_content")), "_vl_content")
    rows = found.select(*[F.col("row")[c].alias(c) for c in rest], "_vl_content", F.explode("embedded").alias("m"))
    cut = F.substring("_vl_content", (F.col("m.offset") + 1).cast("int"), F.col("m.length").cast("int"))
    return rows.select(*[f"`{c}`" for c in rest], F.col("m.offset").alias("media_offset"), F.col("m.length").alias("media_length"), F.col("m.type").alias("media_type"), cut.alias("media"))


def wav(payload: Column, n: Column) -> Column:
    """A WAV file of 8-bit mono samples at 8 kHz, of n (even) bytes of payload."""
    byte = lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")
    le32 = lambda x: F.unhex(F.concat(*[byte(F.shiftright(x, s)) for s in (0, 8, 16, 24)]))
    fixed = F.lit(bytearray(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data"))
    return F.concat(F.lit(bytearray(b"RIFF")), le32(n + 36), fixed, le32(n), payload)


def wav_samples(content: bytes) -> memoryview:
    """The samples of a confirmed WAV file."""
    pos = 12
    while content[pos : pos + 4] != b"data":
        n = struct.unpack_from("<I", content, pos + 4)[0]
        pos += 8 + n + (n & 1)
    n = struct.unpack_from("<I", content, pos + 4)[0]
    return memoryview(content)[pos + 8 : pos + 8 + n]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    raw = C.text_of("text").cast("binary")
    n = F.octet_length(raw).cast("long")
    padded = F.greatest(F.lit(1), F.ceil(n / 576)).cast("long") * 576
    payload = F.rpad(raw, padded.cast("int"), F.lit(bytearray(b"\xff")))
    stored = docs.select("doc_id", n.alias("n_bytes"), wav(payload, padded).alias("media"), F.lit(UNKNOWN).alias("declared"))
    sniffed = sniff_column(C.materialize(stored, "media"), "media", "declared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, cell in enumerate(b.column("media")):
                content = cell.as_py()
                kind, spots = b.column("detected_type")[i].as_py(), b.column("embedded")[i].as_py()
                if kind != "audio/wav":
                    raise ValueError(f"a stored medium was read back as {kind}")
                samples = wav_samples(content)
                carved = ",".join(f"{x['type']}@{x['offset']}+{x['length']}" for x in spots)
                feature = f"{kind} u8 mono 8000 Hz, {len(samples)} samples, mean {_mean(samples):.3f}, embedded [{carved}]"
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(content), hashlib.sha256(content).hexdigest(), feature, b.column("declared")[i].as_py() != kind))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected"])

    return sniffed.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean")


def _mean(samples: memoryview) -> float:
    import numpy as np

    return float(np.frombuffer(samples, np.uint8).mean())
