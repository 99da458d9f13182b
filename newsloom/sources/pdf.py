"""PDF files as landed rows: a small reader of plain and deflated text streams, run over Spark's binary files.

It reads what simple writers make: page objects with their content streams, literal and hexadecimal strings of the
text operators, and the title and date of the information dictionary. Fonts with encodings of their own, encrypted
files and object streams are not read; such a file gives what text it has in the open.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "struct<pages:array<string>,title:string,created:string>"
_object = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_string = r"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
_shown = re.compile(rf"({_string}|<[0-9A-Fa-f\s]*>)|\b(Td|TD|T\*|ET|Tj|TJ)(?![A-Za-z])|(['\"])(?=\s)", re.S)
_escapes = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _text(raw: str) -> str:
    """A literal or hexadecimal string of the file."""
    if raw.startswith("<"):
        digits = re.sub(r"\s", "", raw[1:-1])
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        octal = lambda m: chr(int(m[1], 8)) if m[1] else "" if m[2] in "\r\n" else _escapes.get(m[2], m[2])
        data = re.sub(r"\\(?:([0-7]{1,3})|(\r\n|.))", octal, raw[1:-1], flags=re.S).encode("latin-1", "replace")
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")


def _stream(body: bytes) -> str:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return ""
    data = m[1]
    if b"/FlateDecode" in body[: m.start()]:
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            return ""
    return data.decode("latin-1")


def _lines(content: str) -> str:
    """The strings that a content stream shows; moving to a new line begins one."""
    out, line = [], []
    for shown, move, _ in _shown.findall(content):
        if shown:
            line.append(_text(shown))
        elif move in ("Td", "TD", "T*", "ET") and line:
            out.append("".join(line))
            line = []
    return "\n".join([*out, *(["".join(line)] if line else [])])


def read_pdf(data: bytes | None) -> dict:
    """pages (texts), title and created (as the file has them) of a file's bytes."""
    objects = {int(m[1]): m[2] for m in _object.finditer(data or b"")}
    pages = []
    for body in objects.values():
        if re.search(rb"/Type\s*/Page(?![a-zA-Z])", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            found = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
            pages.append("\n".join(_lines(_stream(objects[n])) for n in found if n in objects))

    def info(key: str) -> str | None:
        for body in objects.values():
            if m := re.search(rf"/{key}\s*({_string}|<[0-9A-Fa-f\s]*>)", body.decode("latin-1"), re.S):
                return _text(m[1])
        return None

    return {"pages": pages, "title": info("Title"), "created": info("CreationDate")}


def landed_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of url, bytes, pages, title and created, as the connector of PDF files takes them, from a folder of files."""

    @F.pandas_udf(PAGES)
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_pdf(x) for x in column], columns=["pages", "title", "created"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.col("path").alias("url"), F.col("content").alias("bytes"), read("content").alias("r")).select("url", "bytes", "r.*")
