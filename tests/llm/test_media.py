import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import media as M


def slow_mulaw(code):
    code = ~code & 255
    t = (((code & 15) << 3) + 132) << ((code & 112) >> 4)
    return 132 - t if code & 128 else t - 132


def slow_alaw(code):
    code ^= 0x55
    t, seg = (code & 15) << 4, (code & 112) >> 4
    t = t + 8 if seg == 0 else (t + 0x108) << (seg - 1)
    return t if code & 128 else -t


def slow_ima(block):
    steps = M.ima_steps().tolist()
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step, change = steps[index], steps[index] >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                change += step >> shift if nibble & bit else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_tables():
    assert M.mulaw_table().tolist() == [slow_mulaw(c) for c in range(256)]
    assert M.alaw_table().tolist() == [slow_alaw(c) for c in range(256)]
    assert len(M.ima_steps()) == 89


def test_adpcm_blocks_together_and_alone():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (40, 68)).astype(np.uint8)
    blocks[:, 2] %= 100
    assert M.decode_ima(blocks).tolist() == [slow_ima(bytes(b)) for b in blocks]


@pytest.mark.parametrize("tag", [M.MULAW, M.ALAW, M.IMA])
def test_files_are_lossless(tag):
    for n in (64, 640, 64 * 1000):
        payload = random.Random(n).randbytes(n)
        media = M.encode_media(payload, tag)
        assert M.read_payload(media) == payload and media[:4] == b"RIFF"
        assert len(M.decode_media([media])[0]) == (n if tag != M.IMA else n // 64 * 129)
    with pytest.raises(ValueError, match="WAV"):
        M.read_media(b"nothing")


def test_resampling():
    flat = np.full(50, 1000, np.int16)
    assert M.resample(flat).tolist() == [1000] * 100
    wave = (10_000 * np.sin(np.arange(200) / 9)).astype(np.int16)
    twice = M.resample(wave)
    assert (twice[::2] == wave).all()
    assert np.abs(twice[20:-20].astype(int) - 10_000 * np.sin(np.arange(400) / 18)[20:-20]).max() < 30
    assert len(M.resample(wave[:1])) == 2 and len(M.resample(wave[:0])) == 0


def test_whole_operator(spark, awkward, nothing):
    rows = M.media_digests(awkward).collect()
    assert len(rows) == awkward.count()
    own = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for r in rows:
        data = (own[r["doc_id"]] or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
    same = {tuple(r)[1:] for r in rows if r["doc_id"] in range(7, 14)}
    assert len(same) == 1 and {r["feature"].split(";")[0] for r in rows} == {"mulaw", "alaw", "ima_adpcm"}
    stored = M.with_media(awkward).where(F.col("doc_id") == 14).first()
    assert M.read_payload(stored["media"]) == M.payload_of(own[14])
    assert stored["pcm"] == M.resample(M.decode_media([stored["media"]])[0]).tobytes()
    assert M.media_digests(nothing).count() == 0


def test_files_of_any_kind(spark):
    """Bad files have no sound and a reason; good ones beside them are decoded."""
    payload = random.Random(2).randbytes(640)
    good = {t: M.encode_media(payload, t) for t in (M.MULAW, M.ALAW, M.IMA)}
    cut = good[M.IMA][:-100]
    odd = good[M.IMA].replace((10 * 68).to_bytes(4, "little"), (10 * 68 - 1).to_bytes(4, "little"))
    empty = M.encode_media(b"", M.MULAW)
    files = [*good.values(), None, b"", b"RIFF", b"RIFF1234WAVEfmt ", cut, odd, good[M.MULAW][:30], empty, M.encode_media(b"", M.IMA)]
    d = spark.createDataFrame([(k, f, 7, "old", "x") for k, f in enumerate(files)], "n int, file binary, pcm int, error string, media string").repartition(3)
    got = M.with_pcm(d, "file")
    assert got.columns == ["n", "file", "media", "pcm", "error"]
    rows = {r["n"]: r for r in got.collect()}
    for k, f in enumerate(good.values()):
        assert rows[k]["error"] is None and rows[k]["pcm"] == M.resample(M.decode_media([f])[0]).tobytes() and rows[k]["media"] == "x"
    assert [rows[k]["error"] for k in range(3, 10)] == ["no file", "not a WAV file", "not a WAV file", "no telephony sound in this file", "file ends within the sound", "broken ADPCM blocks", "broken format chunk"]
    assert all(rows[k]["pcm"] is None for k in range(3, 10)) and rows[10]["pcm"] == rows[11]["pcm"] == b""
    assert M.with_pcm(d.where("false"), "file").count() == 0


def test_stored_pcm_and_features_against_plain_python(spark, awkward, nothing):
    """Every document's PCM as it was stored, and each part of its feature, sample by sample."""
    own = {r["doc_id"]: r["text"] for r in awkward.collect() if r["text"] is None or len(r["text"]) < 20_000}
    feature = {r["doc_id"]: r["feature"] for r in M.media_digests(awkward).collect()}
    stored = {r["doc_id"]: r for r in M.pcm_digests(awkward).collect()}
    assert len(own) > 10 and M.pcm_digests(nothing).count() == 0
    for k, text in own.items():
        payload = M.payload_of(text)
        kind = ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(payload) % 3]
        if kind == "ima_adpcm":
            samples = [s for at in range(0, len(payload), 64) for s in slow_ima(bytes(4) + payload[at : at + 64])]
        else:
            samples = [(slow_mulaw if kind == "mulaw" else slow_alaw)(c) for c in payload]
        wide = [samples[0], *samples, samples[-1], samples[-1]]
        pcm = []
        for i, s in enumerate(samples):
            pcm += [s, max(-32768, min(32767, (9 * (wide[i + 1] + wide[i + 2]) - wide[i] - wide[i + 3] + 8) // 16))]
        raw = b"".join(s.to_bytes(2, "little", signed=True) for s in pcm)
        assert (stored[k]["pcm_bytes"], stored[k]["pcm_sha256"], stored[k]["error"]) == (len(raw), hashlib.sha256(raw).hexdigest(), None)
        turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        said = f"{kind};samples={len(samples)};pcm={len(pcm)};peak={max(map(abs, samples))};energy={sum(s * s for s in samples)};turns={turns};pcm_crc={zlib.crc32(raw)}"
        assert feature[k] == said
