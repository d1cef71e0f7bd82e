"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, and resampled PCM.

* Expansion of mu-law and A-law is one table lookup for each byte.
* ADPCM is a recursion along a block, so that numpy steps through the nibbles
  of all blocks of a batch of files at once.
* Decoded sound is resampled from 8 to 16 kHz by a symmetric half-band filter
  and stored as 16-bit PCM.

`encode_media` stores any bytes losslessly as samples: bytes are mu-law or
A-law codes, or the nibbles of ADPCM blocks of 64 data bytes. Which of the
three a payload gets follows from its CRC, so equal payloads are equal files.

`with_pcm` decodes a column of files: `pcm` is their sound, resampled; a file that
is null or no such WAV has null there and the reason in `error`.

Defined cases: a null or empty text is 64 zero bytes; other columns, of whatever
names, are handed on by `with_pcm` and not read otherwise; rows that repeat stay
apart; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.base import written

UNIT = 64
#: Format tags of WAV.
ALAW, MULAW, IMA = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima_adpcm"}
RATE = 8000


def mulaw_table() -> np.ndarray:
    """16-bit sample of every mu-law code (G.711): inverted bits, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of every A-law code (G.711): even bits inverted, sign bit set for positive."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, mantissa * 16 + 8, (mantissa * 16 + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM."""
    # Fixed values of the format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ])


#: Change of the step index for the low three bits of a nibble (fixed values of the format).
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (rows of header and data bytes): one step for each nibble, across all blocks."""
    steps = ima_steps()
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    data = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * data.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * data.shape[1]):
        nibble = data[:, k // 2] >> (4 * (k % 2)) & 15
        step = steps[index]
        low = (nibble & 7).astype(np.int64)
        change = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[low], 0, 88)
        out[:, k + 1] = value
    return out


def padded(data: bytes) -> bytes:
    return data + bytes((-len(data)) % UNIT or (0 if data else UNIT))


def payload_of(text: str | None) -> bytes:
    return padded((text or "").encode("utf-8", "surrogatepass"))


def format_of(payload: bytes) -> int:
    return (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]


def encode_media(payload: bytes, tag: int) -> bytes:
    """A WAV file whose samples are the payload's bytes (mu-law, A-law) or nibbles (ADPCM)."""
    if tag == IMA:
        blocks = np.zeros((len(payload) // UNIT, 4 + UNIT), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, samples = blocks.tobytes(), 4 + UNIT, 4, len(blocks) * (2 * UNIT + 1)
        extra = struct.pack("<HH", 2, 2 * UNIT + 1)
        byte_rate = RATE * align // (2 * UNIT + 1)
    else:
        data, align, bits, samples, extra, byte_rate = payload, 1, 8, len(payload), struct.pack("<H", 0), RATE
    head = struct.pack("<HHIIHH", tag, 1, RATE, byte_rate, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_media(media: bytes | None) -> tuple[int, int, bytes]:
    """Format tag, block size and sample data of a WAV file; ValueError says what is wrong with it."""
    if media is None:
        raise ValueError("no file")
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, align = 12, None, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if size < 14 or at + 22 > len(media):
                raise ValueError("broken format chunk")
            tag, _, _, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        if name == b"data" and tag in NAMES:
            data = media[at + 8 : at + 8 + size]
            if len(data) < size:
                raise ValueError("file ends within the sound")
            if tag == IMA and (align < 5 or len(data) % align):
                raise ValueError("broken ADPCM blocks")
            return tag, align, data
        at += 8 + size + size % 2
    raise ValueError("no telephony sound in this file")


def read_payload(media: bytes) -> bytes:
    tag, align, data = read_media(media)
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes() if tag == IMA else data


def decode_media(files: list[bytes | None]) -> list[np.ndarray | str]:
    """16-bit samples of each file, or what is wrong with it; the ADPCM blocks of all files go together, by block size."""
    out: list = [None] * len(files)
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        try:
            tag, align, data = read_media(media)
        except ValueError as e:
            out[i] = str(e)
            continue
        codes = np.frombuffer(data, np.uint8)
        if tag == IMA:
            waiting.setdefault(align, []).append((i, codes.reshape(-1, align)))
        else:
            out[i] = TABLES[tag][codes]
    for own in waiting.values():
        all_blocks = np.concatenate([b for _, b in own])
        samples = np.concatenate([decode_ima(all_blocks[k : k + 65536]) for k in range(0, len(all_blocks), 65536)]) if len(all_blocks) else np.zeros((0, 1), np.int16)
        at = 0
        for i, blocks in own:
            out[i] = samples[at : at + len(blocks)].ravel()
            at += len(blocks)
    return out


def resample(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and those between come from the taps (-1, 9, 9, -1) / 16 with repeated ends."""
    if not len(samples):
        return np.zeros(0, "<i2")
    x = np.concatenate([samples[:1], samples, samples[-1:], samples[-1:]]).astype(np.int32)
    between = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    out = np.empty(2 * len(samples), "<i2")
    out[::2] = samples
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def feature_of(tag: int, samples: np.ndarray, pcm: np.ndarray) -> str:
    """Format, counts, peak, energy (integers, so that every machine agrees), sign changes and the PCM's CRC."""
    x = samples.astype(np.int64)
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{NAMES[tag]};samples={len(x)};pcm={len(pcm)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};turns={turns};pcm_crc={zlib.crc32(pcm.tobytes())}"


def _slices(b: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Runs of rows of a batch with at most `most` bytes in a column, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0))
    at = 0
    while at < len(sizes):
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield b.slice(at, end - at)
        at = end


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, stored as telephony sound."""
    names = ["doc_id", "n_bytes", "media"]

    def run(batches):
        for b in batches:
            for part in _slices(b, 1):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                files = [encode_media(p, format_of(p)) for p in map(padded, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def with_pcm(files: DataFrame, media: str = "media") -> DataFrame:
    """All columns of files, `pcm` (16-bit, twice the rate, little-endian) and `error`."""
    names = [c for c in files.columns if c not in ("pcm", "error")]
    at = names.index(media)
    files = files.select(*(files[c] for c in names))

    def run(batches):
        for b in batches:
            for part in _slices(b, at):
                sounds = decode_media(part.column(at).to_pylist())
                pcm = [None if isinstance(s, str) else resample(s).tobytes() for s in sounds]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary()), pa.array([s if isinstance(s, str) else None for s in sounds], pa.string())], [*names, "pcm", "error"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("pcm", T.BinaryType()), T.StructField("error", T.StringType())]))


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pcm): every whole text as telephony sound, and its 16 kHz 16-bit PCM."""
    return with_pcm(as_media(docs)).drop("error")


def digests(files: DataFrame) -> DataFrame:
    """What a table of `as_media` holds: digests of the payload read back and of the file, and the sound's feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            for part in _slices(b, 2):
                media = part.column(2).to_pylist()
                back = [read_payload(f) for f in media]
                features = [feature_of(read_media(f)[0], s, resample(s)) for f, s in zip(media, decode_media(media), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(p) for p in back], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                        pa.array([zlib.crc32(p[-UNIT:]) for p in back], pa.int64()),
                        pa.array([len(f) for f in media], pa.int64()),
                        pa.array([hashlib.sha256(f).hexdigest() for f in media], pa.string()),
                        pa.array(features, pa.string()),
                    ],
                    names,
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text stored as a file in the shared folder, and the digests of what is read back from there."""
    return digests(written(as_media(docs), "media", compression="zstd"))


def pcm_digests(docs: DataFrame) -> DataFrame:
    """doc_id, media_bytes, pcm_bytes, pcm_sha256, error: every text's sound decoded, resampled and stored as 16-bit PCM in the shared folder, and digests of what is read back from there."""
    stored = written(with_pcm(as_media(docs)).select("doc_id", F.octet_length("media").cast("long").alias("media_bytes"), "pcm", "error"), "pcm", compression="zstd")
    return stored.select("doc_id", "media_bytes", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"), "error")
