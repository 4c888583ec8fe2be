"""The JPEG codec against a reader of the JVM, itself, and files that aren't its own."""

import numpy as np
import pytest

from rasterloom.functions import jpeg_codec


def picture(h, w, comps):
    y, x = np.mgrid[0:h, 0:w]
    planes = [(np.sin(x / 9) + 1) * 120, (np.cos(y / 7) + 1) * 110, (x + y) % 200]
    return np.stack(planes[:comps], 2).astype(np.uint8)


@pytest.mark.parametrize("comps", [1, 3])
@pytest.mark.parametrize("quality", [1, 50, 90, 100])
def test_round_trip(comps, quality):
    limit = {1: 40, 50: 5, 90: 2, 100: 0.3}[quality]
    for h, w in ((61, 83), (8, 8), (1, 1), (16, 7)):
        px = picture(h, w, comps)
        back = jpeg_codec.decode(jpeg_codec.encode(px, quality))
        assert back.shape == px.shape and np.abs(back.astype(int) - px).mean() <= limit
        stripped = jpeg_codec.encode(px, quality, stripped=True)
        assert (jpeg_codec.decode(stripped, jpeg_codec.tables(quality, comps)) == back).all()
    noise = np.random.default_rng(0).integers(0, 256, (40, 40, comps)).astype(np.uint8)
    assert np.abs(jpeg_codec.decode(jpeg_codec.encode(noise, 100)).astype(int) - noise).max() <= 3


def test_the_jvm_reads_what_is_written(spark, tmp_path):
    pictures = {"a": picture(61, 83, 3), "b": picture(24, 17, 1)}
    for name, px in pictures.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg_codec.encode(px, 95))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == 2
    for r in rows:
        px = pictures[r["origin"][-5]]
        assert (r["height"], r["width"], r["nChannels"]) == px.shape
        theirs = np.frombuffer(r["data"], np.uint8).reshape(px.shape)[..., ::-1]
        mine = jpeg_codec.decode(jpeg_codec.encode(px, 95))
        assert np.abs(theirs.astype(int) - mine).max() <= 2


def test_files_that_cannot_be_read():
    good = jpeg_codec.encode(picture(16, 16, 3))
    for bad in (b"", b"xx" + good[2:], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[: len(good) // 2 + 200]):
        with pytest.raises(jpeg_codec.JpegError):
            jpeg_codec.decode(bad)
    with pytest.raises(jpeg_codec.JpegError):
        jpeg_codec.encode(np.zeros((4, 4, 2), np.uint8))
