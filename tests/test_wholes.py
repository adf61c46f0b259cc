"""Nothing is left out for its depth, place or size, and broken files give a row that says so."""

import io
import zipfile

from pyspark.sql import functions as F

from quirel.operators import grids, layout
from quirel.sources import convert, package, plain


def test_structure_deeper_than_64_cycles_and_missing_parents(spark):
    rows = [(0, None, "Document")] + [(i, i - 1, f"L{i}") for i in range(1, 150)] + [(500, 501, "a"), (501, 500, "b"), (502, 501, "c"), (600, 999, "d"), (0, None, "Document")]
    df = spark.createDataFrame([(i, p, 0, r) for i, p, r in rows], "elem_id long, parent_id long, child_no int, struct_role string")
    got = {r["elem_id"]: (r["depth"], r["path"]) for r in layout.structure_paths(df).collect()}
    assert set(got) == set(range(150)) and got[149][0] == 149 and got[149][1] == "Document/" + "/".join(f"L{i}" for i in range(1, 150))
    assert layout.structure_paths(df.limit(0)).count() == 0


def test_every_pipe_table_is_a_grid(spark):
    md = "| a | b |\n| --- | --- |\n| 1 | 2 |\n\ntext\n\n| c |\n| --- |\n| x |\n| y |"
    got = grids.pipe_cells(spark.createDataFrame([(7, md)], "id long, t string"), "id", "t").collect()
    assert {(r["grid"], r["row_no"], r["col_no"]): r["text"] for r in got} == {("7:1", 0, 0): "a", ("7:1", 0, 1): "b", ("7:1", 1, 0): "1", ("7:1", 1, 1): "2", ("7:2", 0, 0): "c", ("7:2", 1, 0): "x", ("7:2", 2, 0): "y"}


def test_regions_of_every_page_meet_items_in_squares(spark):
    items = spark.createDataFrame([(1, 1, 1, 10.0, 10.0, 350.0, 10.0), (1, 2, 1, 10.0, 500.0, 20.0, 10.0), (1, 2, 2, -30.0, -30.0, 10.0, 10.0), (2, 1, 1, None, 0.0, 1.0, 1.0)], "result_id long, page_no int, item_no int, x double, y double, width double, height double")
    regions = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 900.0), (1, 50.0, 0.0, 900.0, 900.0)], "region_no int, rx1 double, ry1 double, rx2 double, ry2 double")
    got = layout.assign_regions(items, regions)
    assert {(r["page_no"], r["item_no"]): (r["region_no"], r["area"]) for r in got.collect()} == {(1, 1): (1, 3100.0), (2, 1): (0, 200.0)}
    keyed = regions.withColumn("result_id", F.lit(1).cast("long")).withColumn("page_no", F.lit(2))
    plan = layout.assign_regions(items, keyed)
    assert [(r["page_no"], r["item_no"]) for r in plan.collect()] == [(2, 1)]
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_broken_files_give_error_rows(spark):
    files = spark.createDataFrame([(1, "a.docx", b"PK\x03\x04broken"), (2, "a.pdf", b"%PDF-1.4 broken"), (3, "a.html", b"<p>x</p>"), (4, "a.html", None)], "doc_id long, file_name string, data binary")
    for f in (convert.blocks, convert.cells):
        got = {r["doc_id"]: r["error_code"] for r in f(files).collect()}
        assert got[1] and got[2] and got[4] == "missing" and got.get(3) is None
    for f in (convert.pdf_items, convert.pdf_pages):
        assert {r["doc_id"] for r in f(files).where("error_code IS NOT NULL").collect()} == {1, 2, 3, 4}


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


def test_packages_by_content_type_and_manifest():
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://purl.oclc.org/ooxml/officeDocument/relationships/officeDocument" Target="x/main.xml"/></Relationships>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/X/Main.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>'
    data = zipped({"_rels/.rels": rels, "[Content_Types].xml": types, "x/main.xml": "<anything/>"})
    assert package.detect(data) == "xlsx" and package.Package(data).content_type("y/z.xml") == "application/xml" and package.Package(data).content_type("none") is None
    manifest = '<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.presentation"/></manifest:manifest>'
    assert package.detect(zipped({"META-INF/manifest.xml": manifest, "content.xml": "<x/>"})) == "odp"
    assert package.usual_uri("http://purl.oclc.org/ooxml/wordprocessingml/main") == "http://schemas.openxmlformats.org/wordprocessingml/2006/main" and package.usual_uri("http://x.invalid/a") is None
    assert package.declared_encoding(b"<?xml version='1.0' encoding = 'latin-1'?>") == "latin-1" and package.declared_encoding(b"<?xml?>") is None


def test_font_table_after_200_000_bytes():
    fonts = b"".join(b"{\\f%d\\fcharset0 Font;}" % i for i in range(2, 10_000)) + b"{\\f1\\fcharset204 Cyr;}"
    doc = plain.rtf(b"{\\rtf1\\ansi{\\fonttbl" + fonts + b"}\\f1 \\'cf\\'f0\\par}")
    assert "".join(r.text for b in doc.blocks for r in b.runs) == "Пр"
