"""Texts of files: plain text and Markdown, and word-processor documents, which are zipped XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PLAIN, WORD = ("txt", "md"), ("docx",)


def docx_text(data: bytes) -> str:
    """Paragraphs of a document's body in order, then the rows of its tables, cells joined by tabs; broken files raise."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_NS}body")

    def plain(node) -> str:
        return "".join("\t" if x.tag == f"{_NS}tab" else "\n" if x.tag == f"{_NS}br" else x.text or "" for x in node.iter() if x.tag in (f"{_NS}t", f"{_NS}tab", f"{_NS}br"))

    lines = [plain(p) for p in body.findall(f"{_NS}p")]
    for row in body.iter(f"{_NS}tr"):
        lines.append("\t".join("\n".join(plain(p) for p in cell.findall(f"{_NS}p")) for cell in row.findall(f"{_NS}tc")))
    return "\n".join(lines)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, fault`` of the files in a folder, by their ending.

    A file that can't be read, or of another kind, has a null text and says
    why in ``fault``. Bytes that are no UTF-8 become the replacement character.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("ending"), "content")

    def run(batches):
        for pdf in batches:
            texts, faults = [], []
            for ending, data in zip(pdf["ending"], pdf["content"]):
                text, fault = None, None
                try:
                    if ending in PLAIN:
                        text = bytes(data).decode("utf-8", "replace")
                    elif ending in WORD:
                        text = docx_text(bytes(data))
                    else:
                        fault = f"no reader for {ending}"
                except Exception as e:  # a broken file mustn't stop the others
                    fault = f"{type(e).__name__}: {e}"
                texts.append(text)
                faults.append(fault)
            yield pdf[["path"]].assign(text=texts, fault=faults)

    return files.mapInPandas(run, "path string, text string, fault string")
