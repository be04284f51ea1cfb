"""Media columns: telephony audio.

Mu-law and A-law bytes are expanded by lookup tables; IMA ADPCM blocks are decoded step by step with numpy
across all blocks of a batch of files at once. A stored file is WAV with one channel at 8 kHz; the decoded
samples are resampled to 16 kHz 16-bit PCM (linear interpolation) and kept as a column.

``store_payloads`` pads a text's UTF-8 bytes with spaces to a positive multiple of 192. Their CRC picks the
codec, a third of the payloads each: the bytes become the samples of a mu-law or an A-law file or the
bodies of ADPCM blocks of 192 bytes behind a header of zeros, so they come back unchanged. ``read_media``
needs nothing but the file. Files that are damaged, of an unknown codec, with several channels, of widths
other than 8 bits (16 for PCM as well, 4 for ADPCM) or a rate outside 1,000 to 384,000 give null samples
and an ``error``; they never stop a task. Null texts count as empty; equal texts give equal rows;
repeated rows stay; extra columns are kept or ignored, those with clashing names dropped. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

RATE, RESAMPLED = 8000, 16000
UNIT = 192
#: WAV format tags.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 0x0001, 0x0006, 0x0007, 0x0011
#: Bytes of media in an output batch, about.
BATCH_BYTES = 4 << 20


def mu_law_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()

#: Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks; a short last block is decoded as far as it goes."""
    whole = len(data) // block
    out = [_adpcm_blocks(np.frombuffer(data, np.uint8, whole * block).reshape(whole, block))] if whole else []
    rest = data[whole * block :]
    if len(rest) >= 4:
        out.append(_adpcm_blocks(np.frombuffer(rest, np.uint8).reshape(1, -1)))
    return np.concatenate(out) if out else np.zeros(0, np.int16)


def _adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    body = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = value
    for i in range(2 * body.shape[1]):
        code = (body[:, i >> 1] >> (4 * (i & 1)) & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGES[code], 0, len(STEPS) - 1)
        out[:, 1 + i] = value
    return out.ravel()


def resample(samples: np.ndarray, rate: int, to: int = RESAMPLED) -> np.ndarray:
    """Linear interpolation, rounded half up; the last sample is held."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    if to == 2 * rate:
        x = samples.astype(np.int32)
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        out[1:-1:2] = x[:-1] + x[1:] + 1 >> 1
        out[-1] = x[-1]
        return out
    n = len(samples) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // to, at % to
    high = np.minimum(low + 1, len(samples) - 1)
    x = samples.astype(np.int64)
    return ((x[low] * (to - part) + x[high] * part + to // 2) // to).astype(np.int16)


def wav_file(data: bytes, tag: int = MU_LAW, rate: int = RATE, block: int = 1, bits: int = 8, channels: int = 1) -> bytes:
    form = struct.pack("<HHIIHHH", tag, channels, rate, rate * block if tag != IMA_ADPCM else rate * block // (2 * block - 7), block, bits, 0)
    pad = b"\0" * (len(data) & 1)
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(data)) + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


#: Bits of a sample by codec.
WIDTHS = {PCM: (8, 16), A_LAW: (8,), MU_LAW: (8,), IMA_ADPCM: (4,)}
RATES = range(1_000, 384_001)


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and sample bytes of a WAV file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 8 + size > len(media):
                raise ValueError("damaged format")
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or at + 8 + size > len(media):
                raise ValueError("damaged data")
            tag, channels, rate, _, block, bits = form
            if tag not in WIDTHS:
                raise ValueError(f"unknown codec {tag:#x}")
            if channels != 1:
                raise ValueError(f"{channels} channels")
            if bits not in WIDTHS[tag]:
                raise ValueError(f"{bits} bits a sample")
            if rate not in RATES:
                raise ValueError(f"a rate of {rate}")
            if tag == IMA_ADPCM and block < 5 or tag == PCM and block != bits // 8:
                raise ValueError(f"blocks of {block} bytes")
            return tag, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def decode(tag: int, data: bytes, block: int) -> np.ndarray:
    """The 16-bit samples of a file's sample bytes."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MU_LAW:
        return MU_TABLE[raw]
    if tag == A_LAW:
        return A_TABLE[raw]
    if tag == IMA_ADPCM:
        return decode_adpcm(data, block)
    return np.frombuffer(data, "<i2", len(data) // 2) if block == 2 else ((raw.astype(np.int16) - 128) << 8)


def decode_together(files: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """The samples of several files: ADPCM blocks of one size are decoded at once, whichever file they are of."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    by_block: dict[int, list[int]] = {}
    for i, (tag, _, block, data) in enumerate(files):
        if tag == IMA_ADPCM and len(data) % block == 0 and data:
            by_block.setdefault(block, []).append(i)
        else:
            out[i] = decode(tag, data, block)
    for block, own in by_block.items():
        samples = decode_adpcm(b"".join(files[i][3] for i in own), block)
        at = 0
        for i in own:
            n = len(files[i][3]) // block * (2 * block - 7)
            out[i] = samples[at : at + n]
            at += n
    return out


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


_HEADER = bytes(4)


def stored_file(payload: bytes) -> bytes:
    """The file of a payload, in the codec that its CRC picks."""
    codec = (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    if codec != IMA_ADPCM:
        return wav_file(payload, codec)
    return wav_file(b"".join(_HEADER + payload[i : i + UNIT] for i in range(0, len(payload), UNIT)), codec, block=UNIT + 4, bits=4)


def payload_of(tag: int, block: int, data: bytes) -> bytes:
    """A file's sample bytes without the headers of blocks."""
    if tag != IMA_ADPCM:
        return data
    whole = len(data) // block * block
    return np.frombuffer(data, np.uint8, whole).reshape(-1, block)[:, 4:].tobytes() + data[whole + 4 :]


def store_payloads(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` for each row: its text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch, "text", BATCH_BYTES):
                data, off = tx.flat(piece.column(piece.schema.get_field_index("text")))
                raw = data.tobytes()
                files = [stored_file(pad(raw[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("doc_id")), pa.array(np.diff(off)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


_READ = (
    ("codec", pa.int32(), "int"), ("payload", pa.binary(), "binary"), ("pcm", pa.binary(), "binary"), ("peak", pa.int64(), "bigint"), ("energy", pa.int64(), "bigint"),
    ("crossings", pa.int64(), "bigint"), ("samples", pa.int64(), "bigint"), ("error", pa.string(), "string"),
)


def _read(files: list[bytes | None]) -> list[tuple]:
    rows: list[tuple] = [()] * len(files)
    good = []
    for i, media in enumerate(files):
        try:
            good.append((i, read_wav(media or b"")))
        except ValueError as e:
            rows[i] = (None, None, None, None, None, None, None, str(e))
    for (i, (tag, rate, block, data)), samples in zip(good, decode_together([g[1] for g in good]), strict=True):
        pcm = resample(samples, rate)
        x = pcm.astype(np.int64)
        signs = x < 0
        rows[i] = (tag, payload_of(tag, block, data), pcm.astype("<i2").tobytes(), int(np.abs(x).max()) if len(x) else 0, int((x * x).sum()), int((signs[1:] != signs[:-1]).sum()), len(x), None)
    return rows


def read_media(stored: DataFrame) -> DataFrame:
    """``stored`` with what its ``media`` column holds: codec, sample bytes, 16 kHz PCM and its features."""
    names = [n for n in stored.columns if n not in {r[0] for r in _READ}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch, "media", BATCH_BYTES // 2):
                rows = _read(piece.column(piece.schema.get_field_index("media")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(piece.schema.get_field_index(n)) for n in names), *(pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(_READ))], [*names, *(r[0] for r in _READ)]
                )

    schema = ", ".join([*(f"`{n}` {stored.schema[n].dataType.simpleString()}" for n in names), *(f"{n} {kind}" for n, _, kind in _READ)])
    return stored.select(*names).mapInArrow(run, schema)


def write_pcm(stored: DataFrame, path: str) -> None:
    """Write the files' 16 kHz PCM as a binary column beside their other columns; the files themselves are left out."""
    read_media(stored).drop("media", "payload").write.parquet(path)


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of the stored files of ``docs`` and of what they give back."""
    read = read_media(store_payloads(docs))
    feature = F.concat_ws(";", F.concat(F.lit("codec="), "codec"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("peak="), "peak"), F.concat(F.lit("energy="), "energy"), F.concat(F.lit("crossings="), "crossings"), F.concat(F.lit("pcm="), F.crc32("pcm")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).cast("bigint").alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def expected_digest(text: str | None) -> tuple[int, int, str, int]:
    """What a text's payload must give, for tests."""
    raw = (text or "").encode()
    payload = pad(raw)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
