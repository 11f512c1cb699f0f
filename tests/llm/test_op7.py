import hashlib
import io
import wave
import zlib

import numpy as np

from tessera.llm import op7_media as m


def test_round_trip_of_all_texts(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = m.op7_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    same = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        pay = data + b"\0" * (max(64, (len(data) + 63) // 64 * 64) - len(data))
        wav = m.to_wav(pay)
        assert wave.open(io.BytesIO(wav)).readframes(10**9) == pay
        want = (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want
        assert same.setdefault(data, r.feature) == r.feature


def test_peak_of_a_tone_and_pairs():
    t = np.arange(4 * m.FRAME)
    tone = (128 + 100 * np.sin(2 * np.pi * 37 * t / m.FRAME)).astype(np.uint8)
    assert m.peaks(tone).tolist() == [37] * 4
    assert m.peaks(np.full(m.FRAME, 128, np.uint8)).tolist() == [-1]
    codes = m.fingerprint(np.array([5, -1, 7, 9])).tolist()
    assert codes == sorted([(0 << 24) | (5 << 12) | (7 << 3) | 2, (2 << 24) | (7 << 12) | (9 << 3) | 1])


def test_blocks_do_not_change_the_result(monkeypatch):
    data = m.to_wav(m.padded(bytes(np.random.default_rng(0).integers(0, 256, 50_000, dtype=np.uint8))))
    whole = m.describe(data)
    monkeypatch.setattr(m, "BLOCK_FRAMES", 3)
    again = m.describe(data)
    assert whole[:5] == again[:5] and whole[5].tolist() == again[5].tolist()


def test_edges(spark):
    schema = "doc_id long, text string, media string, payload_bytes string"
    assert m.wav_features(m.store_wav(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, None, "x", "y"), (1, "", "x", "y"), (1, "é", "x", "y"), (1, "é", "x", "y"), (2, "lang " * 100000, "x", "y")]
    got = m.wav_features(m.store_wav(spark.createDataFrame(rows, schema))).collect()
    assert sorted(r.payload_bytes for r in got) == [64, 64, 64, 64, 500032]
    assert len({r.media_sha256 for r in got}) == 3


def test_short_texts_have_fingerprints_of_their_own():
    rng = np.random.default_rng(3)
    for size in (5, 20, 64, 100, 300, 500):
        texts = {bytes(rng.integers(97, 123, size, dtype=np.uint8)) for _ in range(50)}
        codes = [tuple(m.describe(m.to_wav(m.padded(t)))[5].tolist()) for t in texts]
        assert all(codes) and len(set(codes)) == len(texts)


def codes_by_definition(payload: bytes) -> set[int]:
    """The fingerprint by its definition: sums of cosines and sines for each bin of each frame, peaks one by one."""
    frame = min(512, max(len(payload) // 16 * 4, 16))
    hop = frame // 4
    samples = [128] * (frame - hop) + list(payload) + [128] * (frame - hop)
    starts = range(0, len(samples) - frame + hop, hop) if (len(samples) - frame) % hop else range(0, len(samples) - frame + 1, hop)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / (frame - 1))
    angle = 2 * np.pi * np.outer(np.arange(1, 257), np.arange(frame)) / 512
    peaks = []
    for a in starts:
        own = np.array(samples[a : a + frame] + [128] * max(0, a + frame - len(samples)), float) - 128
        own = (own - own.mean()) * window
        power = [-1, *np.round(np.hypot(np.cos(angle) @ own, np.sin(angle) @ own), 2), -1]
        local = [k for k in range(1, 257) if power[k] > 0 and power[k] >= power[k - 1] and power[k] > power[k + 1]]
        peaks.append(sorted(local, key=lambda k: (-power[k], k))[:3])
    return {(t << 24) | (a << 12) | (b << 3) | d for d in (1, 2) for t in range(len(peaks) - d) for a in peaks[t] for b in peaks[t + d]}


def test_feature_equals_its_definition(spark, sf_dir):
    """Up to 4,000 bytes; rounded powers may differ in a transform's last digit, and then in a peak, once in a thousand codes."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 4000}
    wrong = every = 0
    for r in m.op7_media(spark, sf_dir).collect():
        if r.doc_id in texts:
            want, got = codes_by_definition(m.padded(texts[r.doc_id].encode())), {int(c, 16) for c in r.feature.split(",") if c}
            every, wrong = every + len(want), wrong + len(want ^ got)
    assert every > 20_000 and wrong <= every / 1000, (wrong, every)


def test_samples_at_frame_edges_count():
    data = np.full(4 * m.FRAME, 128, np.uint8)
    data[m.FRAME - 2 : m.FRAME + 2] = 255
    other = data.copy()
    other[m.FRAME - 2 : m.FRAME + 2] = (0, 255, 0, 255)
    one, two = (m.describe(m.to_wav(d.tobytes()))[5].tolist() for d in (data, other))
    assert one and two and one != two
