"""Collections of files as rows of results: detection, conversion, one bad file never ends a job.

Defined results: empty files are "malformed"; null bytes "io"; files over the limit "resourceLimit"; formats that need a
provider without one "PROVIDER_REQUIRED"; unknown formats "unsupported". Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.functions import text as T

from .model import Block, ConvertError, Document
from .package import detect

INPUT_MAX = 500 << 20
RESULT = "title string, category string, format string, markdown string, n_blocks int, warnings array<string>, error_code string, error_message string"
BLOCKS = "block_no int, parent_no int, kind string, level int, text string, marker string, lang string, error_code string"
CELLS = "block_no int, row_no int, col_no int, is_origin boolean, row_span int, col_span int, is_header boolean, text string, error_code string"
#: Extensions of each reader.
READERS = {"docx": "docx docm dotx", "xlsx": "xlsx xlsm", "pptx": "pptx pptm ppsx ppsm potx", "odt": "odt ott", "ods": "ods ots", "odp": "odp otp", "epub": "epub", "rtf": "rtf", "csv": "csv", "html": "html htm xhtml", "pdf": "pdf", "doc": "doc", "ppt": "ppt pps pot", "xls": "xls"}
BY_EXTENSION = {e: k for k, v in READERS.items() for e in v.split()}


def to_document(data: bytes, fmt: str) -> Document:
    """The document model of bytes in a known format."""
    from . import odf, office, ole, plain, web

    if fmt in ("doc", "ppt", "xls") and data[:8] == ole.MAGIC:
        return {"doc": ole.doc, "ppt": ole.ppt, "xls": ole.xls}[fmt](data)
    if fmt == "docx":
        return office.docx(data)
    if fmt == "xlsx":
        return office.xlsx(data)
    if fmt == "pptx":
        return office.pptx(data)
    if fmt in ("odt", "ods", "odp"):
        return odf.odf(data)
    if fmt == "epub":
        return web.epub(data)
    if fmt == "html":
        return web.html(plain.decode(data))
    if fmt == "csv":
        return plain.delimited(data)
    if fmt == "rtf" or (fmt == "doc" and data[:5] == b"{\\rtf"):
        return plain.rtf(data)
    raise ConvertError("unsupported", f"no reader for {fmt}")


def extension(name: str | None) -> str:
    base = (name or "").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[1].lower() if "." in base[1:] else ""


def category(ext: str) -> str:
    return next((k for k, v in T.CATEGORIES.items() if ext in v.split()), "unsupported")


def convert_one(name: str | None, data: bytes | None, by_content: bool = False, providers: dict[str, Callable[[bytes, str], tuple[str, float | None]]] | None = None) -> tuple:
    """A row of RESULT. The extension chooses the reader, or with by_content the bytes do, the extension if they don't tell."""
    from . import pdf, plain, render, web

    ext = extension(name)
    cat = category(ext)
    stem = (name or "").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if ext else stem
    title, fmt, warnings = stem or "document", BY_EXTENSION.get(ext), []
    try:
        if data is None:
            raise ConvertError("io", "no bytes")
        if len(data) > INPUT_MAX:
            raise ConvertError("resourceLimit", "file too large")
        if not data:
            raise ConvertError("malformed", "empty file")
        if by_content:
            fmt = detect(data) or fmt
        if fmt == "pdf":
            got = pdf.process(data)
            md, warnings, n = got["markdown"], got["warnings"], len(got["pages"])
            if not md.strip():
                if not providers or "ocr" not in providers:
                    raise ConvertError("PROVIDER_REQUIRED", f"{got['kind']} PDF without text")
                md = providers["ocr"](data, stem)[0]
        elif cat in ("image", "audio", "video") and not by_content:
            key = "ocr" if cat == "image" else "transcription"
            if not providers or key not in providers:
                raise ConvertError("PROVIDER_REQUIRED", f"{cat} needs a provider")
            md, n = providers[key](data, stem)[0], 1
        elif cat == "text":
            try:
                md, n = data.decode("utf-8"), 1
            except UnicodeDecodeError:
                raise ConvertError("malformed", "not UTF-8") from None
        elif fmt is None:
            raise ConvertError("unsupported", f"no reader for {fmt or ext or 'this file'}")
        else:
            doc = to_document(data, fmt)
            md, warnings, n = render.to_markdown(doc), doc.warnings, len(doc.blocks)
            title = doc.title or title
        if not md.strip():
            warnings = [*warnings, "no text"]
        return title, cat, fmt, md, n, warnings, None, None
    except ConvertError as x:
        return title, cat, fmt, None, 0, warnings, x.code, str(x)
    except RecursionError:
        return title, cat, fmt, None, 0, warnings, "resourceLimit", "nested too deep"
    except Exception as x:  # noqa: BLE001
        return title, cat, fmt, None, 0, warnings, "malformed", f"{type(x).__name__}: {x}"[:500]


def convert(files: DataFrame, key: str = "doc_id", name: str = "file_name", data: str = "data", by_content: bool = False, providers: dict | None = None) -> DataFrame:
    """(key, RESULT...) of each file: one pass, a batch at a time."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    recs = files.select(F.col(key).alias("__k"), F.col(name).alias("__n"), F.col(data).alias("__d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *convert_one(n, bytes(d) if d is not None else None, by_content, providers)) for k, n, d in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["__k", *names])

    return recs.mapInPandas(run, f"__k {recs.schema['__k'].dataType.simpleString()}, {RESULT}").withColumnRenamed("__k", key)


def flat_blocks(doc: Document) -> list[tuple]:
    """Rows of BLOCKS in reading order; children point to the block that holds them."""
    from .model import plain

    rows: list[tuple] = []

    def add(blocks: list[Block], parent: int | None) -> None:
        for b in blocks:
            no = len(rows) + 1
            rows.append((no, parent, b.kind, b.level or None, plain(b.runs) or b.text or None, b.ordered or None, b.lang or None))
            add(b.blocks, no)
            for i in b.items:
                add(i.blocks, no)

    add(doc.blocks, None)
    return rows


def flat_cells(doc: Document) -> list[tuple]:
    """Rows of CELLS: every grid place once, covered places point back by being no origin."""
    from .model import plain

    rows: list[tuple] = []
    for no, b in enumerate(doc.blocks, 1):
        for r, row in enumerate(b.grid):
            for c, x in enumerate(row):
                rows.append((no, r, c, x is not None, x.rows if x else None, x.cols if x else None, r < b.header_rows, " ".join(plain(y.runs) for y in x.blocks) if x else None))
    return rows


def _whole(data) -> bytes:
    if data is None:
        raise ConvertError("missing", "no bytes")
    return bytes(data)


def _rows_or_error(key, names: list[str], make: Callable[[], list[tuple]]) -> list[tuple]:
    """A file's rows, or one row of nulls with the code of what is wrong with it."""
    try:
        return [(key, *r, None) for r in make()]
    except ConvertError as x:
        code = x.code
    except Exception:  # noqa: BLE001 - whatever a broken file raises
        code = "malformed"
    return [(key, *[None] * (len(names) - 1), code)]


def _explode(files: DataFrame, key: str, name: str, data: str, schema: str, flat: Callable[[Document], list[tuple]]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    recs = files.select(F.col(key).alias("__k"), F.col(name).alias("__n"), F.col(data).alias("__d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n, d in pdf.itertuples(index=False, name=None):
                rows += _rows_or_error(k, names, lambda d=d, n=n: flat(to_document(_whole(d), BY_EXTENSION.get(extension(n)) or detect(bytes(d)) or "")))
            yield pd.DataFrame(rows, columns=["__k", *names]).astype(object)

    return recs.mapInPandas(run, f"__k {recs.schema['__k'].dataType.simpleString()}, {schema}").withColumnRenamed("__k", key)


def blocks(files: DataFrame, key: str = "doc_id", name: str = "file_name", data: str = "data") -> DataFrame:
    return _explode(files, key, name, data, BLOCKS, flat_blocks)


def cells(files: DataFrame, key: str = "doc_id", name: str = "file_name", data: str = "data") -> DataFrame:
    return _explode(files, key, name, data, CELLS, flat_cells)


ITEMS = "page_no int, item_no int, text string, x float, y float, width float, font string, font_size float, mcid long, error_code string"
SIGNALS = "page_no int, text_operator_count int, has_images boolean, has_template_image boolean, total_image_area long, image_count int, unique_text_chars int, unique_alphanum_chars int, path_op_count int, has_vector_text boolean, has_identity_h_no_tounicode boolean, has_only_type3_fonts boolean, font_change_count int, has_decodable_text_fonts boolean, error_code string"


def _pdf_rows(files: DataFrame, key: str, data: str, schema: str, rows_of: Callable[[dict], list[tuple]]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    recs = files.select(F.col(key).alias("__k"), F.col(data).alias("__d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from . import pdf as P

        for pdf in batches:
            rows = []
            for k, d in pdf.itertuples(index=False, name=None):
                rows += _rows_or_error(k, names, lambda d=d: rows_of(P.process(_whole(d))))
            yield pd.DataFrame(rows, columns=["__k", *names]).astype(object)

    return recs.mapInPandas(run, f"__k {recs.schema['__k'].dataType.simpleString()}, {schema}").withColumnRenamed("__k", key)


def pdf_items(files: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    return _pdf_rows(files, key, data, ITEMS, lambda g: [(p.no, i, t.text, t.x, t.y, t.width, t.font, t.size, t.mcid) for p in g["pages"] for i, t in enumerate(p.items, 1)])


def pdf_pages(files: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    return _pdf_rows(files, key, data, SIGNALS, lambda g: [tuple(s.values()) for s in g["signals"]])


ELEMENTS = "elem_id int, parent_id int, child_no int, struct_role string, alt_text string, actual_text string, lang string, page_no int, mcid int, error_code string"
TABLES = "page_no int, table_no int, detector string, n_rows int, n_cols int, markdown string, error_code string"
LINKS = "page_no int, x1 double, y1 double, x2 double, y2 double, target string, error_code string"
FIELDS = "name string, kind string, page_no int, value string, error_code string"


def pdf_structure(files: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """Structure elements of tagged PDFs; an element with several marked contents has a row for each."""
    return _pdf_rows(files, key, data, ELEMENTS, lambda g: [(n.elem_id, n.parent_id, n.child_no, n.role, n.alt, n.actual, n.lang, page, mcid) for n in g["nodes"] for mcid, page in n.content or [(None, None)]])


def pdf_tables(files: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """Tables of each page with the detector that found them."""

    def rows(g: dict) -> list[tuple]:
        from . import pdf as P

        return [(p.no, i, t[3], len(t[0]), max(map(len, t[0])), P.pipe(t[0])) for p in g["pages"] for i, t in enumerate(P.find_tables(p, g["tagged"]), 1)]

    return _pdf_rows(files, key, data, TABLES, rows)


def pdf_links(files: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    from .tagged import links

    return _pdf_rows(files, key, data, LINKS, lambda g: links(g["pdf"]))


def pdf_fields(files: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    from .tagged import form_fields

    return _pdf_rows(files, key, data, FIELDS, lambda g: form_fields(g["pdf"]))


def read_files(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int = INPUT_MAX) -> DataFrame:
    """(doc_id, file_name, size_bytes, data) of files under an allowed root; larger ones are listed without bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("data"))
