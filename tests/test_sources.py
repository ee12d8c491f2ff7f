import os

import numpy as np
from pyspark.sql import functions as F

from millrace.sources import readers, sinks


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(text)
    return str(path)


def test_annotations_and_labels(spark, tmp_path):
    a = put(tmp_path / "a.csv", 'filename,text\nx.jpg, AB 1 \ny.jpg,"a,b"\n')
    assert [tuple(r) for r in readers.annotation_csv(spark, a).collect()] == [("x.jpg", "AB 1"), ("y.jpg", "a,b")]
    t = put(tmp_path / "l.txt", "p/1.jpg\tA\tB\nno tab\n")
    assert [tuple(r) for r in readers.tab_labels(spark, t).collect()] == [("p/1.jpg", "A\tB")]
    df = spark.createDataFrame([("d/AB_12-x.png",)], "p string")
    assert df.select(readers.label_from_name(F.col("p"))).first()[0] == "AB 12 x"


def test_voc_to_yolo(spark, tmp_path):
    obj = lambda n, *b: f"<object><name>{n}</name><bndbox><xmin>{b[0]}</xmin><ymin>{b[1]}</ymin><xmax>{b[2]}</xmax><ymax>{b[3]}</ymax></bndbox></object>"
    for i, body in enumerate([obj("Spur", -5, 10, 50, 60), obj("short", 0, 0, 20, 20) + obj("spur", 5, 5, 5.5, 90)]):
        put(tmp_path / f"v/{i}.xml", f"<annotation><filename>{i}.jpg</filename><size><width>100</width><height>200</height><depth>3</depth></size>{body}</annotation>")
    boxes = readers.voc_boxes(spark, str(tmp_path / "v"), ["spur", "short"])
    assert boxes.count() == 3
    lines = sorted(r.line for r in sinks.yolo_lines(boxes, ["short", "spur"]).collect())
    assert lines == ["0 0.100000 0.050000 0.200000 0.100000", "1 0.250000 0.175000 0.500000 0.250000"]


def test_binary_sources(spark, tmp_path):
    put(tmp_path / "i/a/x.jpg", b"\1\2", "wb")
    put(tmp_path / "i/x_label.bmp", b"\0\0", "wb")
    img = readers.images(spark, str(tmp_path / "i"), "*.jpg")
    masks = readers.images(spark, str(tmp_path / "i"), "*.bmp").withColumn("defect", F.hex("content").rlike("[1-9A-F]"))
    assert [(r.stem, r.defect) for r in readers.paired(img.select("path"), masks).collect()] == [("x", False)]
    assert img.select(sinks.content_name(F.col("content"), F.col("path"))).first()[0].endswith(".jpg")
    np.savez(tmp_path / "b.npz", bank=np.eye(3))
    assert readers.npz_bank(spark, str(tmp_path / "b.npz")).count() == 3


def test_documents_and_ocr(spark):
    df = spark.createDataFrame([("a.pdf", "x" * 40), ("a.PDF", " "), ("a.djvu", ""), ("a.heic", "")], "path string, text string")
    assert [r[0] for r in df.select(readers.document_route(F.col("path"), F.col("text"))).collect()] == ["text", "ocr", "rejected", "ocr"]
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, " ")], "path string, page int, text string")
    assert readers.joined_pages(pages).first().text == "one\n\ntwo"
    o = spark.createDataFrame([([[[0.0]], [[1.0]]], ["a", "b"], [0.5]), ([], [], [])], "b array<array<array<double>>>, t array<string>, s array<double>")
    rows = [r.r for r in o.select(readers.ocr_result(F.col("b"), F.col("t"), F.col("s"), "e").alias("r")).collect()]
    assert (rows[0].text, rows[0].confidence, rows[1].text, rows[1].lines) == ("a\nb", 0.25, "", [])


def test_json_sources(spark, tmp_path):
    log = put(tmp_path / "log.jsonl", '{"ts": "1", "level": "INFO", "msg": "m"}\n')
    assert readers.json_log(spark, log).first().level == "INFO"
    rep = put(tmp_path / "r.json", '{"summary": {}, "results": {"a.jpg": {"prediction": "x", "cer": 0.5}}}')
    assert [(r.file, r.cer) for r in readers.evaluation_report(spark, rep).collect()] == [("a.jpg", 0.5)]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, 0.8)], "id long, confidence double")
    r = spark.createDataFrame([(1, None)], "id long, due_date string")
    sinks.csv_export(c, r, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/contracts"), header=True).columns == sinks.CONTRACT_COLUMNS
    a, b = sinks.sheet_rows(c, r)
    assert a.first().confidence == "80%" and b.first().due_date == "待定"
    assert sinks.run_exports({"x": lambda: 1 / 0, "y": lambda: None}, ["x", "y"])["y"] == "ok"
    for i in range(4):
        kept = sinks.snapshot(c, str(tmp_path / "snap"), f"{i}", keep=2)
    assert kept == ["snapshot=2", "snapshot=3"] and len(os.listdir(tmp_path / "snap")) == 2
    sinks.archive(c.selectExpr("'p' as product", "'s' as session", "id"), str(tmp_path / "arch"))
    assert (tmp_path / "arch/product=p/session=s").is_dir()
    q = spark.createDataFrame([("x" * 6000, "y" * 300)], "defect_json string, barcode_content string")
    assert [len(v) for v in sinks.qc_rows(q).first()] == [5000, 200]


def test_masks_by_their_pixels(spark):
    def bitmap(pixels):
        head = b"BM" + (62 + len(pixels)).to_bytes(4, "little") + bytes(4) + (62).to_bytes(4, "little")
        return bytes(head + bytes([40]) + bytes(47) + pixels)

    images = spark.createDataFrame([("/a/x.jpg",), ("/a/y.jpg",), ("/a/z.jpg",)], "path string")
    masks = spark.createDataFrame([("/a/x_label.bmp", bytearray(bitmap(bytes(16)))), ("/a/y_label.bmp", bytearray(bitmap(bytes(15) + b"\x01")))], "path string, content binary")
    got = {r.path: r.defect for r in readers.paired(images, masks).collect()}
    assert got == {"/a/x.jpg": False, "/a/y.jpg": True, "/a/z.jpg": None}


def test_written_xml_is_compressed_and_bounded(spark):
    from millrace.plans import more_queries as q

    boxes = spark.range(250_000).selectExpr("id AS frame_id", "'R' AS label", "1.0D AS x1", "2.0D AS y1", "3.0D AS x2", "4.0D AS y2").coalesce(1)
    back = q.s6_voc_boxes(boxes)
    files = back.inputFiles()
    assert len(files) >= 3 and all(f.endswith(".xml.gz") for f in files)
    assert back.count() == 250_000 and back.filter("filename = 'f7.jpg' and label = 'r' and ymax = 4.0").count() == 1
