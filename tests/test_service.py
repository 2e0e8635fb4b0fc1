from __future__ import annotations

import json

import fixtures as X
import numpy as np
import pytest

from docspark.operators import service
from docspark.pdf import jpeg
from docspark.pdf.document import Document, parse
from docspark.pdf.image import NativeRenderer, decode_png
from docspark.pdf.objects import Name, Stream

CASES = [
    ("metadata", [X.outline_and_links()], None, 200, None), ("figures", [X.figure_with_caption()], "", 200, None), ("chunks", [X.multi_heading()], '{"target_tokens": 5}', 200, None), ("extract", [X.scanned()], None, 200, None),
    ("structure", [X.tagged_minimal()], None, 200, None), ("outline", [X.born_digital()], None, 200, None), ("merge", [X.pages_doc(2), X.pages_doc(3)], None, 200, None), ("split", [X.pages_doc(3)], '{"ranges": [[1, 1], [2, 3]]}', 200, None),
    ("rotate", [X.pages_doc(1)], '{"page": 1, "degrees": 90}', 200, None), ("watermark", [X.pages_doc(1)], '{"text": "X"}', 200, None), ("fill", [X.form()], '{"fields": {"name": "Ada"}}', 200, None), ("render", [X.scanned()], '{"width": 60}', 200, None),
    ("merge", [X.pages_doc(1)], None, 400, "expected_multiple_files"), ("chunks", [], None, 400, "expected_one_file"), ("chunks", [b"hello"], None, 400, "not_a_pdf"), ("chunks", [b"%PDF-1.4"], None, 400, "malformed_pdf"),
    ("split", [X.pages_doc(3)], '{"ranges": []}', 400, "empty_ranges"), ("split", [X.pages_doc(3)], None, 400, "missing_options"), ("split", [X.pages_doc(3)], '{"ranges": [[2, 9]]}', 422, "page_out_of_range"), ("rotate", [X.pages_doc(1)], '{"page": 1, "degrees": 10}', 400, "invalid_degrees"),
    ("extract", [X.encrypted()], None, 422, "password_required_or_incorrect"), ("extract", [X.encrypted()], '{"password": "open-sesame"}', 200, None), ("extract", [X.scanned()], "{bad", 400, "bad_options"), ("extract", [X.scanned()], "[1]", 400, "bad_options"),
    ("extract", [X.scanned()], '{"mode": "odd"}', 400, "bad_options"), ("render", [X.scanned()], '{"width": 60000}', 413, "budget_exceeded"), ("dance", [X.scanned()], None, 501, "not_implemented"),
]


def test_answers(spark):
    rows = [(i, op, files, o) for i, (op, files, o, _, _) in enumerate(CASES)]
    got = {r.request_id: r for r in service.answers(spark.createDataFrame(rows, "request_id int, operation string, files array<binary>, options string")).collect()}
    for i, (op, _, _, status, code) in enumerate(CASES):
        assert (got[i].status, got[i].code) == (status, code), (op, got[i].message)
        assert code or (got[i].json is not None) != (got[i].files is not None)
    assert json.loads(got[0].json)["links"] == [{"page": 1, "links": [{"x0": 50.0, "y0": 700.0, "x1": 150.0, "y1": 720.0, "kind": "uri", "uri": "https://example.com"}, {"x0": 200.0, "y0": 700.0, "x1": 350.0, "y1": 720.0, "kind": "page", "target_page": 2}]}]
    assert json.loads(got[1].json) == [{"page": 1, "figures": [{"bbox": [100.0, 400.0, 500.0, 700.0], "caption": "Figure 1: A sample chart."}]}]
    assert set(json.loads(got[2].json)) == {"chunks", "document_text"} and json.loads(got[3].json)["page_images"][0]["width"] == 1275
    assert parse(bytes(got[6].files[0]))["meta"]["page_count"] == 5 and len(got[7].files) == 2 and parse(bytes(got[10].files[0]))["form"][0]["value"] == "Ada"
    assert decode_png(bytes(got[11].files[0])).shape == (78, 60, 3) and "encrypted" in json.loads(got[21].json)["text"]


@pytest.fixture(scope="module")
def as_jpeg(spark):
    """A JPEG of RGB pixels, written by the JVM's own encoder."""

    def make(pixels: np.ndarray, gray: bool = False) -> bytes:
        jvm = spark.sparkContext._jvm
        h, w = pixels.shape[:2]
        image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 5)
        for y in range(h):
            for x in range(w):
                r, g, b = map(int, pixels[y, x])
                if gray:
                    image.getRaster().setSample(x, y, 0, r)
                else:
                    image.setRGB(x, y, (r << 16 | g << 8 | b) - (1 << 24))
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        return bytes(out.toByteArray())

    return make


@pytest.mark.parametrize("shape", [(8, 8), (17, 30), (40, 33)])
def test_jpeg_is_close_to_its_pixels(as_jpeg, shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    pixels = np.stack([60 + 3 * x, 200 - 2 * y, 90 + x + y], axis=2).clip(0, 255).astype(np.uint8)
    got = jpeg.decode(as_jpeg(pixels))
    assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels).mean() < 6
    gray = np.repeat(pixels[:, :, :1], 3, axis=2)
    assert np.abs(jpeg.decode(as_jpeg(gray, gray=True)).astype(int) - gray).mean() < 6


def test_jpeg_on_a_page(as_jpeg):
    red = np.zeros((16, 16, 3), np.uint8)
    red[:, :, 0] = 220
    r = X.Raw()
    image = r.s.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 16, "Height": 16, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}, as_jpeg(red)))
    r.resources["XObject"] = {"Im1": image}
    r.page(b"q 612 0 0 792 0 0 cm /Im1 Do Q")
    pixel = NativeRenderer().render(Document(r.save()), 1, {"width": 20})[10, 10].astype(int)
    assert np.abs(pixel - [220, 0, 0, 255]).max() < 12
    assert jpeg.decode(b"\xff\xd8\xff\xc2\x00\x04\x08\x00") is None and jpeg.decode(b"\xff\xd8 nothing") is None
