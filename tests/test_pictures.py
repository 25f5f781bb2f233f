"""Picture files: sizes of whole ones, and every cut or changed one found."""

import struct
import zlib

import pytest

from provlake.functions.pictures import NoPicture, examined
from provlake.operators import catalog, pool
from tests.test_catalogue import tables  # noqa: F401


def png(width=1, height=1, note=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"note\0" + note) + chunk(b"IDAT", zlib.compress(bytes((width + 1) * height))) + chunk(b"IEND", b"")


def jpeg(width=1, height=1):
    part = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    scan = part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"\x12\xff\x00\x34\xff\xd0\x56"
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\xff\xd9") + b"\xff" + part(0xC2, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00") + scan + part(0xC4, b"\0" * 17) + scan + b"\xff\xd9"


@pytest.mark.parametrize("make", [png, jpeg])
def test_sizes_and_cuts(make):
    whole = make(300, 20)
    assert examined(whole) == examined(whole + b"more") == (300, 20)
    for n in range(len(whole)):
        with pytest.raises(NoPicture):
            examined(whole[:n])


def test_changes():
    whole = png(3, 2, b"x" * 40)
    for i in range(len(whole)):
        with pytest.raises(NoPicture):
            examined(whole[:i] + bytes([whole[i] ^ 4]) + whole[i + 1 :])
    assert examined(b"GIF89a" + bytes(9)) == (None, None)
    for other in (b"", b"<html>", b"\xff\xd8\xff\xd9", b"\xff\xd8 text"):
        with pytest.raises(NoPicture):
            examined(other)


def test_verify_and_relocate(spark, tables, tmp_path):  # noqa: F811
    """A flat file moves to its category once; a damaged one is found and repaired to failed."""
    scan = catalog.photo_scan(*tables)
    old, new = tmp_path / "Ann/a.jpg", tmp_path / "identity/Ann/a.jpg"
    old.parent.mkdir()
    old.write_bytes(jpeg())
    assert [r.path for r in pool.relocate(scan, str(tmp_path)).collect() if r.moved] == ["identity/Ann/a.jpg"]
    assert new.read_bytes() == jpeg() and not old.exists()
    old.write_bytes(b"later")
    assert not any(r.moved for r in pool.relocate(scan, str(tmp_path)).collect()) and old.exists()  # what is there stays
    assert pool.verified(scan, pool.listing(spark, str(tmp_path))).first().verdict == "ok"
    new.write_bytes(jpeg()[:-5])
    found = pool.verified(scan, pool.listing(spark, str(tmp_path)))
    assert found.first().verdict == "corrupt" and pool.repaired(tables[0], found).where("id = 1").first().status == "failed"


def filtered(pixels, kinds, colour):
    """A PNG with these pixels (rows, columns, samples), each line under its filter."""
    import struct
    import zlib

    import numpy as np

    h, w, s = pixels.shape
    px = np.zeros((h + 1, w + 1, s), int)
    px[1:, 1:] = pixels
    out = bytearray()
    for y in range(1, h + 1):
        out.append(kinds[y - 1])
        for x in range(1, w + 1):
            for k in range(s):
                a, b, c = px[y, x - 1, k], px[y - 1, x, k], px[y - 1, x - 1, k]
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((px[y, x, k] - [0, a, b, (a + b) // 2, near][kinds[y - 1]]) % 256)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    palette = chunk(b"PLTE", bytes(range(256)) * 3) if colour == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + palette + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")


def test_pixels_of_all_filters():
    import numpy as np

    from provlake.functions.pictures import NoPicture, luminance

    r = np.random.default_rng(1)
    for colour, samples in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = r.integers(0, 256, (11, 7, samples))
        got = luminance(filtered(pixels, [0, 1, 2, 3, 4, 4, 3, 2, 1, 4, 0], colour))
        want = (pixels[:, :, :3] @ [299, 587, 114] + 500) // 1000 if samples >= 3 else pixels[:, :, 0]
        assert (got == want).all()
    with pytest.raises(NoPicture):
        luminance(filtered(r.integers(0, 256, (2, 2, 1)), [0, 0], 0)[:-20])


def test_scaled_pictures_share_their_hash():
    import numpy as np

    from provlake.functions.pictures import phash

    r = np.random.default_rng(2)
    coarse = np.kron(r.integers(0, 256, (9, 12)), np.ones((20, 20), int))
    smooth = sum(np.roll(coarse, k, i) for i in (0, 1) for k in range(12)) // 24
    versions = [smooth, smooth[::2, ::2], smooth[::3, ::3], np.kron(smooth, np.ones((2, 2), int))]
    hashes = [int(phash(filtered(v[:, :, None], [1] * len(v), 0)), 16) for v in versions]
    other = int(phash(filtered(255 - smooth[:, ::-1, None], [2] * len(smooth), 0)), 16)
    assert all((hashes[0] ^ h).bit_count() <= 4 for h in hashes) and (hashes[0] ^ other).bit_count() > 12
    assert phash(b"\xff\xd8\xff\xd9") is None


def test_pictures_over_the_cap_are_scaled():
    import numpy as np

    from provlake.functions.pictures import capped, phash, pixels

    r = np.random.default_rng(3)
    for colour, samples in ((2, 3), (0, 1), (6, 4)):
        coarse = np.kron(r.integers(0, 256, (6, 8, samples)), np.ones((10, 10, 1), int))
        data = filtered(coarse, [i % 5 for i in range(60)], colour)
        small, width, height = capped(data, 60 * 80 / 1e6 / 4)
        assert (width, height) == examined(small) == (40, 30)
        assert (pixels(small) == coarse[::2, ::2, : min(samples, 3)]).all()  # tiles of one colour keep it
        assert (int(phash(small), 16) ^ int(phash(data), 16)).bit_count() <= 4
    assert capped(jpeg(300, 20), 0.001) is None
