"""A BibTeX reader: entries by balanced braces, strings and concatenation resolved; one row for each entry."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bibliography import brace_months, parse_item, split_items
from .files import decoded


def _closing(text: str, at: int, opener: str = "{", closer: str = "}") -> int:
    """The place of the bracket that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "\\":
            continue
        if text[i] in (opener, closer) and (i == 0 or text[i - 1] != "\\"):
            depth += 1 if text[i] == opener else -1
            if not depth:
                return i
    return -1


def _value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field's value from `at`: braced, quoted, a number or a name, joined by #."""
    out = []
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        if text[at] == "{":
            end = _closing(text, at)
            if end < 0:
                return "".join(out) + text[at + 1 :], len(text)
            out.append(text[at + 1 : end])
            at = end + 1
        elif text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth):
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            out.append(text[at + 1 : end])
            at = end + 1
        else:
            m = re.compile(r"[^\s,#{}]+").match(text, at)
            if not m:
                break
            out.append(strings.get(m[0].lower(), m[0]))
            at = m.end()
        m = re.compile(r"\s*#").match(text, at)
        if not m:
            break
        at = m.end()
    return "".join(out), at


def parse(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; field names in lower case, of a repeated field the last; comments and preambles go."""
    strings: dict[str, str] = {}
    head, name = re.compile(r"@\s*([A-Za-z]+)\s*([{(])"), re.compile(r"[\s,]*([^\s=,{}()]+)\s*=")
    at = 0
    while m := head.search(text, at):
        kind, closer = m[1].lower(), {"{": "}", "(": ")"}[m[2]]
        end = _closing(text, m.end() - 1, m[2], closer)
        body = text[m.end() : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else m.end()
        if kind in ("comment", "preamble"):
            continue
        key, p = "", 0
        if kind != "string":
            key, _, _ = body.partition(",")
            p = len(key) + 1
        fields: dict[str, str] = {}
        while f := name.match(body, p):
            value, p = _value(body, f.end(), strings)
            fields[f[1].lower()] = re.sub(r"\s+", " ", value).strip()
        if kind == "string":
            strings.update(fields)
        elif key.strip():
            yield kind, key.strip(), fields


def entries(files: DataFrame) -> DataFrame:
    """(path, pos, entrytype, id, fields) of bib files(path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(path, i, k, key, list(f.items())) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (k, key, f) in enumerate(parse(text or ""))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "pos", "entrytype", "id", "fields"])

    return files.select("path", brace_months(decoded(F.col("content"))).alias("t")).mapInArrow(run, "path string, pos int, entrytype string, id string, fields map<string,string>")


def gathered(files: DataFrame) -> DataFrame:
    """(path, kind, pos, key, entrytype, fields, body) of all entries of files(path, ext, content): those of bib files, the
    items of bbl files and of the thebibliography blocks of tex files, in this order of kinds. bib entries have fields,
    items a body and the fields that can be read from it, under the names that BibTeX has for them."""
    decoded_files = files.select("path", "ext", decoded(F.col("content")).alias("content"))
    own = entries(files.where(F.col("ext") == "bib")).select(
        "path", F.lit(0).alias("kind"), "pos", F.col("id").alias("key"), "entrytype", "fields", F.lit(None).cast("string").alias("body")
    )

    def items(ext: str, kind: int) -> DataFrame:
        parsed = split_items(decoded_files.where(F.col("ext") == ext), blocks=ext == "tex").withColumn("p", parse_item(F.col("body")))
        names = {n: F.col(f"p.{n}") for n in ("author", "title", "volume", "number", "pages", "year", "doi", "url")}
        for kind_, name in (("inproceedings", "booktitle"), ("article", "journal"), ("misc", "howpublished")):
            names[name] = F.when(F.col("p.entrytype") == kind_, F.col("p.venue"))
        fields = F.map_filter(F.create_map(*(x for n, c in names.items() for x in (F.lit(n), c))), lambda k, v: v.isNotNull() & (v != ""))
        return parsed.select("path", F.lit(kind).alias("kind"), "pos", "key", F.col("p.entrytype").alias("entrytype"), fields.alias("fields"), "body")

    return own.unionByName(items("bbl", 1)).unionByName(items("tex", 2))
