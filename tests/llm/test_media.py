import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import media as m

from ..oracle import DATA
from .conftest import ROWS


def round_trip(payloads):
    images = m.encode(payloads)
    parsed, rows, base = m.decode(images)
    assert [m.payload_of(p, rows[base[d] : base[d + 1]]) for d, p in enumerate(parsed)] == payloads
    return images, m.tensors(parsed, rows, base)


def test_payloads():
    rnd = random.Random(5)
    few = [bytes(64), bytes(range(256)), b"\x80" * 640, bytes(rnd.randrange(256) for _ in range(6400))]
    sparse = [bytes(rnd.choice([127] + [128] * k + [129]) for _ in range(64 * 70)) for k in (1, 8, 40, 300)]
    together, rgb = round_trip(few + sparse)
    for p, image, own in zip(few + sparse, together, rgb, strict=True):
        alone, (tensor,) = round_trip([p])
        assert alone == [image] and (tensor == own).all()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_any_bytes(data):
    round_trip([m.padded(data)])


def test_scans_are_progressive():
    p = m.parse(m.encode([bytes(range(64)) * 9])[0])
    assert [(s[1], s[2], s[3], s[4]) for s in p["scans"]][:2] == [(0, 0, 0, 1), (1, 5, 0, 1)] and {s[3] for s in p["scans"]} == {0, 1}


def test_inverse_transform():
    rng = np.random.default_rng(1)
    c = rng.integers(-50, 50, 64).astype(float)
    natural = np.zeros(64)
    natural[m.zigzag()] = c
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    k = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    want[y, x] += k * natural[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert (c @ m.inverse_dct()).reshape(8, 8) == pytest.approx(want)
    assert m.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_another_decoder_agrees(spark, tmp_path):
    image, (rgb,) = round_trip([b"\x80" * 64 * 12 + bytes([100] + [128] * 63) * 12])
    (tmp_path / "a.jpg").write_bytes(image[0])
    j = spark._jvm
    seen = j.javax.imageio.ImageIO.read(j.java.io.File(str(tmp_path / "a.jpg")))
    h, w, _ = rgb.shape
    px = np.array(list(seen.getRGB(0, 0, w, h, None, 0, w)), np.int64) & 0xFFFFFF
    theirs = np.stack([px >> 16, px >> 8 & 255, px & 255], 1).reshape(h, w, 3)
    assert np.abs(theirs @ [0.299, 0.587, 0.114] - rgb @ [0.299, 0.587, 0.114]).mean() < 2


def test_rows(docs, none):
    got = m.media_columns(docs, carry=["doc_id"]).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len((x[1] or "").encode()) for x in ROWS)
    assert all(len(r.rgb) == r.height * r.width * 3 and r.media_bytes == len(r.media) for r in got)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    assert m.media_columns(none, carry=["doc_id"]).collect() == []


def test_query(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    for r in m.op6_media_columns(spark, DATA).collect():
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
