import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotbox.errors import InvalidImage
from ballotbox.operators import metrics as M
from ballotbox.plans.scanner import Scanner
from ballotbox.sources import images as I
from ballotbox.sources import pixels as P
from ballotbox.specimens import corpus, linear, qr, reader


def jvm_image(spark, a):
    h, w = a.shape[:2]
    out = spark._jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            out.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
    return out


def jvm_pixels(image):
    return np.array([[[image.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(image.getWidth())] for y in range(image.getHeight())], np.uint8)


@pytest.mark.parametrize("kind", ["png", "bmp", "gif"])
def test_files_as_the_jvm_reads_them(spark, kind):
    r = np.random.default_rng(1)
    for w, h in ((7, 5), (33, 12)):
        a = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        a[:, : w // 2] = a[:1, :1]
        out = spark._jvm.java.io.ByteArrayOutputStream()
        spark._jvm.javax.imageio.ImageIO.write(jvm_image(spark, a), kind, out)
        content = bytes(out.toByteArray())
        want = jvm_pixels(spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(content)))
        assert (P.decode(content) == want).all() and P.kind_of(content) == kind and P.header_size(content, kind) == (w, h)
        for cut in (len(content) // 2, 20, 9):
            with pytest.raises(InvalidImage):
                P.decode(content[:cut])
    back = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(P.to_png(a)))
    assert (jvm_pixels(back) == a).all()


def test_ppm_kinds():
    want = [[[255] * 3, [0] * 3, [255] * 3]]
    assert P.decode(b"P1\n3 1\n0 1 0").tolist() == P.decode(b"P4\n3 1\n\x40").tolist() == P.decode(b"P2 3 1 9 9 0 9 ").tolist() == P.decode(b"P5 3 1 255\n\xff\x00\xff").tolist() == want
    assert P.decode(b"P3 1 1 255 1 2 3 ").tolist() == P.decode(b"P6 # x\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]


def test_any_input(spark, tmp_path):
    pixels = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    png = P.to_png(pixels)
    (tmp_path / "a.png").write_bytes(png)

    class Picture:
        size = (3, 2)

        def convert(self, mode):
            return pixels

    for x in (png, bytearray(png), tmp_path / "a.png", str(tmp_path / "a.png"), io.BytesIO(png), pixels, Picture()):
        assert (P.decode(P.content_of(x)) == pixels).all()
    for x in (tmp_path, tmp_path / "none.png", "a\0b", None, 7, [1, 2], io.StringIO("x"), np.zeros((2, 2)), np.zeros((0, 2), np.uint8), np.zeros((2, 2, 7), np.uint8)):
        with pytest.raises(InvalidImage):
            P.content_of(x)
    rows = I.table_of(spark, [png, tmp_path / "none.png", b"junk", pixels]).orderBy("image_id").collect()
    assert [(r.format, r.width, r.height, r.error and r.error.type) for r in rows] == [("png", 3, 2, None), (None, None, None, "InvalidImage"), (None, None, None, "InvalidImage"), ("ppm", 3, 2, None)]


def test_envelope(spark):
    big = b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR" + (70_000).to_bytes(4, "big") * 2 + bytes(5)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x14\x00\x1e\x01\x01\x11\x00"
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + bytes(8) + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")
    tiff = b"II*\x00\x08\x00\x00\x00\x02\x00\x00\x01\x03\x00\x01\x00\x00\x00\x1e\x00\x00\x00\x01\x01\x03\x00\x01\x00\x00\x00\x14\x00\x00\x00"
    ico = b"\x00\x00\x01\x00\x01\x00\x1e\x14"
    files = [big, jpeg, webp, tiff, ico, b"P5 30 20 255\n", b"P5 0 20 255\n", b"\xff\xd8\xff", None, b""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(files)], "id int, content binary")
    got = {r.id: r for r in I.probed(df).collect()}
    assert "bomb" in got[0].error.message
    assert [(got[i].format, got[i].width, got[i].height, got[i].error) for i in range(1, 6)] == [(k, 30, 20, None) for k in ("jpeg", "webp", "tiff", "ico", "ppm")]
    assert "without pixels" in got[6].error.message and got[7].error and got[8].error.message == got[9].error.message == "no content"
    whole = {r.id: r for r in I.probed(df, decoded=True).collect()}
    assert "no reader for jpeg" in whole[1].error.message and whole[5].error


def test_registered_reader():
    P.register_reader("jpeg", lambda: lambda content: np.full((2, 2), 9, np.uint8))
    try:
        assert P.decode(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x02\x00\x02\x01\x01").tolist() == [[[9] * 3] * 2] * 2 and "jpeg" in P.readable()
    finally:
        P._READERS.clear()
        P._reader.cache_clear()


def test_qr_against_published_examples():
    assert list(qr.remainder(bytes([32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17]), 10)) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]
    assert f"{qr._bch(0, qr.FORMAT_POLY, 10) ^ qr.FORMAT_MASK:015b}" == "101010000010010" and f"{qr._bch(5, qr.FORMAT_POLY, 10) ^ qr.FORMAT_MASK:015b}" == "100000011001110"
    assert f"{qr._bch(7, qr.VERSION_POLY, 12):018b}" == "000111110010010100"


def test_qr_round_trip():
    r = random.Random(3)
    for n in (0, 1, 14, 26, 62, 106, 122, 152, 180, 213):
        text = "".join(r.choice("abcXYZ 019") for _ in range(n))
        m = qr.matrix(text)
        assert qr.read(m) == text
        m[9, -1] ^= True
        assert qr.read(m) is None
    with pytest.raises(ValueError):
        qr.matrix("x" * 214)


def test_linear_round_trip():
    r = random.Random(4)
    assert all(sum(map(int, x)) == 11 and sum(map(int, x[::2])) % 2 == 0 for x in linear.CODE_128[:-1]) and len(set(linear.CODE_128)) == 107
    assert all(x.count("w") == 3 for c, x in linear.CODE_39.items() if c not in "$/+%")
    for _ in range(60):
        for symbology, chars, n in (("code_128", "aZ09-/ 12345678", r.randrange(1, 20)), ("code_39", "AZ09-. $/+%", r.randrange(1, 12)), ("ean_13", "0123456789", 12)):
            text = "".join(r.choice(chars) for _ in range(n))
            found = reader.read(linear.image(text, symbology, module=r.choice((1, 2, 3))))
            assert [(x["symbology"], x["text"]) for x in found] == [(symbology, text + (linear.check_digit(text) if symbology == "ean_13" else ""))]
    for symbology, text in (("ean_13", "123"), ("ean_13", "0123456789013"), ("code_39", "a"), ("code_128", "é")):
        with pytest.raises(ValueError):
            linear.DRAW[symbology](text)


def test_corpora(spark):
    clean, composite = corpus.clean(spark), corpus.composite(spark)
    assert clean.groupBy("symbology").count().rdd.collectAsMap() == {"qr": 6, "code_128": 4, "code_39": 3, "ean_13": 3}
    rows = composite.collect()
    assert sum(len(r.expected) for r in rows) == 17 and [tuple(r) for r in rows] == [tuple(r) for r in corpus.composite(spark).collect()]
    assert all(any(r.degrees) == ("rotated" in r.spec_id or "dense" in r.spec_id) for r in rows)
    planted = composite.select("image_id", F.explode("expected").alias("e")).select("image_id", "e.payload", "e.symbology")
    found = Scanner(reader.Plain()).scan(composite).select("image_id", F.explode("detections").alias("d")).select("image_id", "d.payload", "d.symbology")
    scores = {r.image_id: r for r in M.fabrication(planted, found).collect()}
    assert all(r.fabricated == 0 for r in scores.values()) and scores[100].missed == scores[102].missed == 0


def test_rotation():
    p = corpus.draw("a", "qr")
    assert corpus.rotated(p, 0) is p and (corpus.rotated(p, 90) == np.rot90(p)).all()
    turned = corpus.rotated(p, 30)
    assert turned.shape[0] > p.shape[0] and turned[0, 0] == 255 and abs(int((turned < 128).sum()) - int((p < 128).sum())) < 0.02 * p.size
    assert corpus.composed([]).shape == (400, 400)


def test_truth_from_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"image_id": 1, "codes": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4, "symbology": "qr", "payload": "p"}]}\n{"image_id": 2, "codes": []}\n')
    assert [tuple(r) for r in M.load_truth(spark, str(tmp_path / "t.json")).collect()] == [(1, 0, 1.0, 2.0, 3.0, 4.0, "qr", "p")]
    (tmp_path / "bad.json").write_text('{"image_id": "x"}\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        M.load_truth(spark, str(tmp_path / "bad.json")).collect()
