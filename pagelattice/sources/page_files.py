"""Spans of page files, where a PDF library is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPAN_DDL = (
    "doc_id bigint, path string, ord int, text string, bx0 double, by0 double, bx1 double, by1 double, "
    "page_width double, page_height double, size double, flags int, font string, color int"
)


def spans_of(content: bytes) -> Iterator[tuple]:
    """Spans of the text blocks of a file's first page."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        page = doc[0]
        texts = (b for b in page.get_text("dict")["blocks"] if b.get("type") == 0)
        spans = (s for b in texts for line in b["lines"] for s in line["spans"])
        for k, s in enumerate(spans):
            yield k, s["text"], *map(float, s["bbox"]), float(page.rect.width), float(page.rect.height), float(s["size"]), s["flags"], s["font"], s["color"]


def page_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of the page files below a folder; adapters.spans_to_tokens makes tokens of them."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise ImportError("page files need the library PyMuPDF; without it start from spans or tokens") from e
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(SPAN_DDL)
    names = schema.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, name, content in zip(*[b.column(i) for i in range(3)], strict=True):
                rows = [dict(zip(names, (doc.as_py(), name.as_py(), *s), strict=True)) for s in spans_of(content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content").mapInArrow(read, schema)
