"""Image files on disk to pixels: the readers and the decoder's byte order."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from roadframe.operators import raster as A
from roadframe.sources import io as S


def png(a):
    """A PNG file of an array (h, w) or (h, w, 3 or 4)."""
    kind = {2: 0, 3: 2 if a.shape[-1] == 3 else 6}[a.ndim]
    lines = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, path = np.random.default_rng(1), tmp_path_factory.mktemp("images")
    made = {"colour.png": r.integers(0, 256, (5, 7, 3)), "grey.png": r.integers(0, 256, (4, 3)), "alpha.png": np.dstack([r.integers(0, 256, (2, 9, 3)), np.full((2, 9), 255)])}
    for name, a in made.items():
        (path / name).write_bytes(png(a))
    return path, made


def test_images_become_pixels(spark, folder):
    path, made = folder
    got = {}
    for p in S.image_to_pixels(S.read_images(spark, str(path))).collect():
        got.setdefault(p["origin"].rsplit("/", 1)[1], {})[p["y"], p["x"]] = (p["r"], p["g"], p["b"])
    assert got.keys() == made.keys()
    for name, a in made.items():
        rgb = a[..., :3] if a.ndim == 3 else np.dstack([a] * 3)
        assert got[name] == {(y, x): tuple(int(v) for v in rgb[y, x]) for y in range(a.shape[0]) for x in range(a.shape[1])}


def test_decoded_pixels_feed_the_statistics(spark, folder):
    path, made = folder
    px = S.image_to_pixels(S.read_images(spark, str(path))).withColumnRenamed("origin", "image_id")
    tone = {r["image_id"].rsplit("/", 1)[1]: r for r in px.groupBy("image_id").agg({"g": "avg"}).collect()}
    assert abs(tone["colour.png"][1] - made["colour.png"][..., 1].mean()) < 1e-9
    assert {(r["h"], r["w"]) for r in A.dims(px).collect()} == {a.shape[:2] for a in made.values()}


def test_files_are_read_as_bytes_and_known_by_their_hash(spark, folder):
    path, made = folder
    files = S.read_files(spark, str(path))
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in files.collect()}
    assert got == {name: png(a) for name, a in made.items()}
    hashed = S.content_hash(files.withColumnRenamed("path", "asset_id")).collect()
    assert {r["sha256"] for r in hashed} == {hashlib.sha256(b).hexdigest() for b in got.values()} and {r["copies"] for r in hashed} == {1}
