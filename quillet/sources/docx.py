"""Word documents as a data source: rows of blocks to one .docx file for each document, and files back to rows.

    spark.dataSource.register(DocxSource)
    blocks.write.format("docx").mode("append").save(folder)      # see render.write_documents for the partitioning
    spark.read.format("docx").load(folder)

A task writes the documents of its partition one after another, each as a stream: what it holds is one block, and the
footnotes of one document. Its files lie in a folder of its own inside a staging folder; once all tasks are done the driver moves one
folder a task, and no file. A task that fails removes what it wrote; a job that fails removes the staging folder. So a folder has
whole documents of whole jobs alone, and a task that is run again leaves nothing behind.

Folders are paths of pyarrow's file systems (local, hdfs, s3, gs). Characters that XML does not know are left out; line breaks and tabs become those of
the format.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.images import kind_and_size
from ..functions.latex import GRID

#: A document's blocks in order. body: STX n ETX marks footnote n of `notes`. grid: a table's cells. panels: a figure's images,
#: side by side, each with its caption.

SCHEMA = (
    "document string, pos int, kind string, level int, prefix string, body string, notes array<struct<n:int,id:int,body:string>>, "
    f"grid {GRID}, panels array<struct<name:string,image:binary,caption:string,width:double>>"
)
READ = "document string, pos int, kind string, level int, text string, notes array<string>, images int"
# The names that the format gives to its parts.
_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_PIECES = re.compile(r"\x02(\d+)\x03|(\t)|(\r\n|[\n\r])|\\text(super|sub)script\{([^{}]*)\}|((?:[^\x02\x03\t\n\r\\]++|\\(?!text(?:super|sub)script\{[^{}]*\}))+)|.", re.S)
_EMU = 914_400  # English Metric Units of an inch
#: Inches from which an image has a line for itself.
WIDE = 5.0
_SIZES = {1: 32, 2: 28, 3: 24}


def _run(text: str, props: str = "", ids: dict[int, int] | None = None) -> str:
    """Runs of a text, with references where footnotes are marked."""
    out = []
    for m in _PIECES.finditer(text):
        if m[1] and (own := (ids or {}).get(int(m[1]))) is not None:
            out.append(f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteReference w:id="{own}"/></w:r>')
        elif m[2] or m[3]:
            out.append(f"<w:r>{props}<w:{'tab' if m[2] else 'br'}/></w:r>")
        elif m[4]:
            out.append(_run(m[5], f'<w:rPr><w:vertAlign w:val="{m[4]}script"/></w:rPr>'))
        elif m[6] and (clean := _NOT_XML.sub("", m[6])):
            out.append(f'<w:r>{props}<w:t xml:space="preserve">{escape(clean)}</w:t></w:r>')
    return "".join(out)


def _styled(runs, bold: bool) -> str:
    out = []
    for r in runs or []:
        marks = ("<w:b/>" if bold or r["bold"] else "") + ("<w:i/>" if r["italic"] else "") + ('<w:u w:val="single"/>' if r["underline"] else "")
        marks += '<w:vertAlign w:val="superscript"/>' if r["superscript"] else '<w:vertAlign w:val="subscript"/>' if r["subscript"] else ""
        out.append(_run(r["text"], f"<w:rPr>{marks}</w:rPr>" if marks else ""))
    return "".join(out)


def _table(cells) -> str:
    """A grid as a table: a cell of several rows begins a vertical merge, which the rows below it go on with."""
    rows = max((c["row"] + c["row_span"] for c in cells), default=0)
    cols = max((c["col"] + c["col_span"] for c in cells), default=0)
    lines: list[list[tuple[int, str]]] = [[] for _ in range(rows)]
    for c in cells:
        wide = f'<w:gridSpan w:val="{c["col_span"]}"/>' if c["col_span"] > 1 else ""
        shade = f'<w:shd w:val="clear" w:fill={quoteattr(c["shade"])}/>' if re.fullmatch("[0-9A-Fa-f]{6}", c["shade"] or "") else ""
        side = {"c": "center", "r": "right"}.get("c" if c["row"] == 0 else c["align"], "left")
        for k in range(c["row_span"]):
            merge = "" if c["row_span"] == 1 else '<w:vMerge w:val="restart"/>' if k == 0 else "<w:vMerge/>"
            inside = _styled(c["runs"], c["row"] == 0) if k == 0 else ""
            lines[c["row"] + k].append((c["col"], f'<w:tc><w:tcPr>{wide}{merge}{shade}</w:tcPr><w:p><w:pPr><w:jc w:val="{side}"/></w:pPr>{inside}</w:p></w:tc>'))
    body = "".join("<w:tr>" + "".join(x for _, x in sorted(line)) + "</w:tr>" for line in lines)
    return f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/><w:jc w:val="center"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * cols}</w:tblGrid>{body}</w:tbl>'


def _picture(rel: str, number: int, wide: int, high: int) -> str:
    return (
        f'<w:r><w:drawing><wp:inline xmlns:wp="{_DRAWING}/wordprocessingDrawing"><wp:extent cx="{wide}" cy="{high}"/><wp:docPr id="{number}" name="image{number}"/>'
        f'<a:graphic xmlns:a="{_DRAWING}/main"><a:graphicData uri="{_DRAWING}/picture"><pic:pic xmlns:pic="{_DRAWING}/picture"><pic:nvPicPr><pic:cNvPr id="{number}" name="image{number}"/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip r:embed="{rel}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{wide}" cy="{high}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
        "</pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>"
    )


class _Document:
    """One .docx while it is written: images go to the archive as they come, the text to a file beside it until the end."""

    def __init__(self, out) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.text = tempfile.TemporaryFile()  # of the task alone
        self.notes: list[str] = []
        self.suffixes: list[str] = []

    def put(self, block) -> None:
        props, style = "", f'<w:pStyle w:val={quoteattr(block["kind"] or "paragraph")}/>' + (f'<w:outlineLvl w:val="{block["level"] - 1}"/>' if block["level"] else "")
        if block["level"]:
            props = f'<w:rPr><w:b/><w:sz w:val="{_SIZES.get(block["level"], 21)}"/></w:rPr>'
        ids = {n["n"]: n["id"] for n in block["notes"] or []}
        self.notes += [f'<w:footnote w:id="{n["id"]}"><w:p>{_run(n["body"] or "")}</w:p></w:footnote>' for n in block["notes"] or []]
        xml = [self._figure(block["panels"])] if block["panels"] else []
        if block["grid"]:
            xml.append(_table(block["grid"]))
        said = " ".join(x for x in (block["prefix"], block["body"]) if x)
        xml.append(f"<w:p><w:pPr>{style}</w:pPr>{_run(said, props, ids)}</w:p>")
        self.text.write("".join(xml).encode())

    def _figure(self, panels) -> str:
        """Images with their captions below: narrow ones side by side, wide ones under each other; one that is not there leaves its name."""
        above, below = [], []
        for p in panels:
            found = kind_and_size(p["image"])
            if found and found[1] and found[2]:
                suffix, wide, high = found
                self.suffixes.append(suffix)
                n = len(self.suffixes)
                self.zip.writestr(f"word/media/image{n}.{suffix}", p["image"])
                cx = int(p["width"] * _EMU)
                shown = _picture(f"rId{n + 1}", n, cx, max(1, cx * high // wide))
            else:
                shown = _run(f"[图片: {p['name']}]") if p["name"] else ""
            above.append(f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr>{shown}</w:p>')
            below.append(f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr>{_run(p["caption"] or "")}</w:p>')
        if any(p["width"] >= WIDE for p in panels):
            return "".join(a + (b if p["caption"] else "") for a, b, p in zip(above, below, panels, strict=True))
        rows = "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr/>{x}</w:tc>" for x in line) + "</w:tr>" for line in (above, below))
        return f'<w:tbl><w:tblPr><w:jc w:val="center"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * len(panels)}</w:tblGrid>{rows}</w:tbl>'

    def close(self) -> None:
        put, rel = self.zip.writestr, "<Relationship Id={} Type={} Target={}/>"
        with self.zip.open("word/document.xml", "w", force_zip64=True) as f:
            f.write(f'{_HEAD}<w:document xmlns:w="{_MAIN}" xmlns:r="{_REL}"><w:body>'.encode())
            self.text.seek(0)
            while chunk := self.text.read(1 << 20):
                f.write(chunk)
            f.write(b"<w:sectPr/></w:body></w:document>")
        self.text.close()
        rels = [rel.format('"rId1"', quoteattr(f"{_REL}/footnotes"), '"footnotes.xml"')]
        rels += [rel.format(f'"rId{n + 1}"', quoteattr(f"{_REL}/image"), f'"media/image{n}.{s}"') for n, s in enumerate(self.suffixes, 1)]
        lines = "".join(f'<w:footnote w:id="{i}" w:type="{t}"><w:p><w:r><w:{t}/></w:r></w:p></w:footnote>' for i, t in ((-1, "separator"), (0, "continuationSeparator")))
        put("word/footnotes.xml", f'{_HEAD}<w:footnotes xmlns:w="{_MAIN}">{lines}{"".join(self.notes)}</w:footnotes>')
        put("word/_rels/document.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(rels)}</Relationships>')
        put("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{rel.format(chr(34) + "rId1" + chr(34), quoteattr(f"{_REL}/officeDocument"), chr(34) + "word/document.xml" + chr(34))}</Relationships>')
        kinds = "".join(f'<Default Extension="{s}" ContentType="image/{s}"/>' for s in sorted(set(self.suffixes)))
        parts = "".join(f'<Override PartName="/word/{p}.xml" ContentType="{_TYPE}.{t}+xml"/>' for p, t in (("document", "document.main"), ("footnotes", "footnotes")))
        put("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}{parts}</Types>')
        self.zip.close()


def _files(path: str):
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), posixpath.abspath(path)
    return fs.FileSystem.from_uri(path)


def file_name(document: str | None) -> str:
    """A document's name as a file's: what is not a letter, a digit or one of ._- is written as its code."""
    name = "".join(c if c.isalnum() and c.isascii() or c in ".-" else f"_{ord(c):x}_" for c in document or "")
    return f"{name or '_'}.docx"


@dataclass
class _Done(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    @property
    def _staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator: Iterator) -> _Done:
        from pyspark import TaskContext

        files, path = _files(self.path)
        task = TaskContext.get()
        folder = f"part-{task.partitionId():05d}-{self.job}"
        own = f"{path}/{self._staging}/{folder}-{task.taskAttemptId()}"
        name = out = doc = None
        seen: set[str | None] = set()
        try:
            for block in iterator:
                if doc is None or block["document"] != name:
                    if block["document"] in seen:
                        raise ValueError(f"the blocks of {block['document']!r} do not follow one another: sort by document and pos")
                    if doc:
                        doc.close()
                        out.close()
                    elif not seen:
                        files.create_dir(own)
                    name = block["document"]
                    seen.add(name)
                    out = files.open_output_stream(f"{own}/{file_name(name)}")
                    doc = _Document(out)
                doc.put(block)
            if doc:
                doc.close()
                out.close()
        except BaseException:
            if seen:
                files.delete_dir(own)
            raise
        return _Done(f"{folder}-{task.taskAttemptId()}" if seen else None)

    def commit(self, messages: list) -> None:
        files, path = _files(self.path)
        if self.overwrite:
            for old in files.get_file_info(_selector(path)):
                if not posixpath.basename(old.path).startswith("_staging-"):
                    (files.delete_dir if old.is_file is False else files.delete_file)(old.path)
        for m in messages:
            if m and m.folder:
                files.move(f"{path}/{self._staging}/{m.folder}", f"{path}/{m.folder.rpartition('-')[0]}")
        self._clear(files, path)

    def abort(self, messages: list) -> None:
        files, path = _files(self.path)
        self._clear(files, path)

    def _clear(self, files, path: str) -> None:
        try:
            files.delete_dir(f"{path}/{self._staging}")
        except FileNotFoundError:
            pass


def _selector(path: str, deep: bool = False):
    from pyarrow import fs

    return fs.FileSelector(path, allow_not_found=True, recursive=deep)


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int, most_bytes: int) -> None:
        self.path, self.most, self.most_bytes = path, most, most_bytes

    def partitions(self) -> list[InputPartition]:
        files, path = _files(self.path)
        found = sorted((f.path, f.size or 0) for f in files.get_file_info(_selector(path, True)) if f.is_file and f.path.endswith(".docx") and "/_staging-" not in f.path)
        parts: list[list[str]] = []
        held = 0
        for name, size in found:
            if not parts or len(parts[-1]) >= self.most or held + size > self.most_bytes:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size
        return [InputPartition(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = _files(self.path)
        for path in partition.value:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                yield from _blocks(posixpath.basename(path)[:-5], z)


def _text(node, ids: list[str]) -> str:
    w, out = f"{{{_MAIN}}}", []
    for x in node.iter():
        if x.tag == f"{w}t":
            out.append(x.text or "")
        elif x.tag in (f"{w}br", f"{w}tab"):
            out.append("\n" if x.tag == f"{w}br" else "\t")
        elif x.tag == f"{w}footnoteReference":
            ids.append(x.get(f"{w}id"))
    return "".join(out)


def _blocks(name: str, z: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs and tables (rows as lines, cells parted by tabs) of a document, in order; one at a time in memory."""
    w = f"{{{_MAIN}}}"
    said = {n.get(f"{w}id"): _text(n, []) for n in ElementTree.fromstring(z.read("word/footnotes.xml"))} if "word/footnotes.xml" in z.namelist() else {}
    document = re.sub("_([0-9a-f]+)_", lambda m: chr(int(m[1], 16)), name)
    depth = pos = 0
    with z.open("word/document.xml") as f:
        for event, x in ElementTree.iterparse(f, ("start", "end")):
            depth += 1 if event == "start" else -1
            if event == "end" and depth == 2 and x.tag in (f"{w}p", f"{w}tbl"):
                ids: list[str] = []
                style, level = x.find(f"{w}pPr/{w}pStyle"), x.find(f"{w}pPr/{w}outlineLvl")
                kind = "table" if x.tag == f"{w}tbl" else style.get(f"{w}val") if style is not None else "paragraph"
                text = "\n".join("\t".join(_text(c, ids) for c in row.iter(f"{w}tc")) for row in x.iter(f"{w}tr")) if x.tag == f"{w}tbl" else _text(x, ids)
                images = sum(1 for _ in x.iter(f"{{{_DRAWING}/main}}blip"))
                yield document, pos, kind, int(level.get(f"{w}val")) + 1 if level is not None else 0, text, [said.get(i) for i in ids], images
                pos += 1
                x.clear()


class DocxSource(DataSource):
    """Options: path, a folder; for reading files_per_partition (100) and bytes_per_partition (1 MiB, or one file), whichever ends first."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("files_per_partition", 100)), int(self.options.get("bytes_per_partition", 1 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
