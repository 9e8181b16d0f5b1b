"""Text of DOCX files: the paragraphs of the main document part, without tables' layout."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.tables import read_binary

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs(content: bytes) -> str | None:
    """One line a paragraph; null if the file is no DOCX."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as file:
            root = ElementTree.fromstring(file.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for p in root.iter(f"{_W}p"):
        lines.append("".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in p.iter()))
    return "\n".join(lines)


def read_docx_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name and text of the DOCX files below a folder; a file is read by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "file_name": part["path"].str.rsplit("/", n=1).str[-1], "text": [paragraphs(bytes(c)) for c in part["content"]]})

    files = read_binary(spark, path, "*.docx").select("path", "content")
    return files.mapInPandas(run, "path string, file_name string, text string")
