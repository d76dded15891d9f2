"""A small PDF reader: positioned text runs of plain files, through ``binaryFile`` and a pandas kernel.

It reads classic cross-referenced objects, object streams and Flate streams, inherited page attributes,
``/Rotate``, and the text operators ``BT ET Tf Tm Td TD T* Tj TJ ' "`` with ``q Q cm``. Encrypted files and
composite (CID) fonts are out of its reach and reported as errors. Widths are those of the standard faces.
``write_pdf`` makes such files for fixtures.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.geometry import BOLD
from sheaf.plans.staging import stage
from sheaf.sources.corpus import text_width

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1, 0, 0, 1, 0, 0)
LEXEME = re.compile(
    rb"%[^\r\n]*|(<<|>>|\[|\]|\{|\})|/([^\s()<>\[\]{}/%]*)|<([0-9A-Fa-f\s]*)>|(\()|([^\s()<>\[\]{}/%]+)"
)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name."""


class Op(str):
    """An operator of a content stream, or a keyword."""


class Ref(int):
    """A reference to a numbered object."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening parenthesis is just before ``at``."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        if c == b"\\":
            nxt = raw[at + 1 : at + 2]
            if octal := re.match(rb"[0-7]{1,3}", raw[at + 1 : at + 4]):
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
                continue
            out += ESCAPES.get(nxt, b"" if nxt in b"\r\n" else nxt)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    raise ValueError("a string does not end")


def lexemes(raw: bytes, at: int = 0) -> Iterator[object]:
    while m := LEXEME.search(raw, at):
        at = m.end()
        if m[1]:
            yield Op(m[1].decode())
        elif m[2] is not None:
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[2]).decode("latin-1"))
        elif m[3] is not None:
            digits = re.sub(rb"\s", b"", m[3])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m[4]:
            text, at = _string(raw, at)
            yield text
        elif m[5]:
            word = m[5].decode("latin-1")
            try:
                yield float(word) if "." in word else int(word)
            except ValueError:
                yield Op(word)


def values(tokens: Iterator[object]) -> Iterator[object]:
    """Lexemes with arrays, dictionaries and references put together."""
    stack: list[list] = [[]]
    for t in tokens:
        if isinstance(t, Op) and t in ("[", "<<"):
            stack.append([])
        elif isinstance(t, Op) and t in ("]", ">>"):
            items = stack.pop()
            stack[-1].append(items if t == "]" else dict(zip(items[::2], items[1::2])))
        elif isinstance(t, Op) and t == "R" and len(stack[-1]) >= 2:
            stack[-1][-2:] = [Ref(stack[-1][-2])]
        else:
            stack[-1].append(t)
        if len(stack) == 1 and isinstance(t, Op) and t not in ("]", ">>", "R"):
            yield from stack[0]
            stack[0] = []
    yield from stack[0]


class Document:
    def __init__(self, raw: bytes):
        if not raw.lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\b", raw):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", raw):
            self._add(int(m[1]), raw, m.end())
        for value, data in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, data)

    def _add(self, number: int, raw: bytes, at: int) -> None:
        end = raw.find(b"endobj", at)
        start = re.compile(rb"stream\r?\n").search(raw, at, end if end >= 0 else len(raw))
        head = raw[at : start.start() if start else end if end >= 0 else len(raw)]
        value = next(iter(values(lexemes(head))), None)
        data = b""
        if start and isinstance(value, dict):
            length = value.get("Length")
            stop = start.end() + length if type(length) is int else raw.find(b"endstream", start.end())
            data = self._decode(value, raw[start.end() : stop])
        self.objects[number] = (value, data)

    @staticmethod
    def _decode(value: dict, data: bytes) -> bytes | None:
        """The stream's bytes, or None where a filter isn't read (images are never asked for)."""
        filters = value.get("Filter", [])
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                return None
            data = zlib.decompressobj().decompress(data)
        return data

    def _unpack(self, value: dict, data: bytes | None) -> None:
        if data is None:
            raise ValueError("a filter of an object stream is not read")
        first, n = value["First"], value["N"]
        heads = [int(x) for x in data[:first].split()[: 2 * n]]
        for number, at in zip(heads[::2], heads[1::2]):
            self.objects.setdefault(number, (next(iter(values(lexemes(data, first + at))), None), b""))

    def get(self, x):
        return self.objects.get(int(x), (None, b""))[0] if isinstance(x, Ref) else x

    def pages(self) -> list[dict]:
        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("the file has no catalogue")
        out: list[dict] = []

        def walk(node: dict, inherited: dict, depth: int) -> None:
            node = inherited | {k: v for k, v in node.items() if k not in ("Kids", "Type", "Parent")} | {"Kids": node.get("Kids"), "Type": node.get("Type")}
            if node["Type"] == "Pages" and depth < 50:
                for kid in self.get(node["Kids"]) or []:
                    walk(self.get(kid) or {}, {k: node[k] for k in ("MediaBox", "Rotate", "Resources") if k in node}, depth + 1)
            else:
                out.append(node)

        walk(self.get(root.get("Pages")) or {}, {}, 0)
        return out

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        parts = parts if isinstance(parts, list) else self.get(parts) if isinstance(self.get(parts), list) else [parts]
        found = [self.objects[int(p)][1] for p in parts if isinstance(p, Ref) and int(p) in self.objects]
        if None in found:
            raise ValueError("a filter of page content is not read")
        return b"\n".join(found)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def viewport(box: list[float], rotation: int) -> tuple[Matrix, float, float]:
    """From user space to the page as shown: origin at the top left, y down."""
    x0, y0, x1, y1 = box
    w, h = x1 - x0, y1 - y0
    matrix = {0: (1, 0, 0, -1, -x0, y1), 90: (0, 1, 1, 0, -y0, -x0), 180: (-1, 0, 0, 1, x1, -y0), 270: (0, -1, -1, 0, y1, x1)}[rotation % 360]
    return matrix, *((h, w) if rotation % 180 else (w, h))


def runs(doc: Document, page: dict) -> list[tuple[str, Matrix, float, str]]:
    """(text, matrix scaled to the font size, width in text space, font) of each run on a page."""
    fonts = (doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}).items()
    named = {k: doc.get(v) or {} for k, v in fonts}
    drawn = doc.get((doc.get(page.get("Resources")) or {}).get("XObject")) or {}
    out: list[tuple[str, Matrix, float, str]] = []
    ctm, saved, text, line, font, size, leading = IDENTITY, [], IDENTITY, IDENTITY, "", 0.0, 0.0
    args: list = []

    def show(raw: bytes) -> None:
        nonlocal text
        s = raw.decode("cp1252", "replace")
        face = str(named.get(font, {}).get("BaseFont", font))
        width = text_width(s, 1.0, re.search(BOLD[4:], face, re.I) is not None)
        out.append((s, multiply((size, 0, 0, size, 0, 0), multiply(text, ctm)), width, face))
        text = multiply((1, 0, 0, 1, width * size, 0), text)

    def move(x: float, y: float) -> None:
        nonlocal text, line
        text = line = multiply((1, 0, 0, 1, x, y), line)

    for t in values(lexemes(doc.content(page))):
        if not isinstance(t, Op):
            args.append(t)
            continue
        match t:
            case "q":
                saved.append(ctm)
            case "Q":
                ctm = saved.pop() if saved else IDENTITY
            case "cm":
                ctm = multiply(tuple(args[-6:]), ctm)
            case "BT":
                text = line = IDENTITY
            case "Tf":
                font, size = args[-2], float(args[-1])
                if named.get(font, {}).get("Subtype") == "Type0":
                    raise ValueError("composite fonts are not read")
            case "Do":
                if (doc.get(drawn.get(args[-1])) or {}).get("Subtype") != "Image":
                    raise ValueError("form objects are not read")
            case "TL":
                leading = args[-1]
            case "Tm":
                text = line = tuple(args[-6:])
            case "Td" | "TD":
                leading = -args[-1] if t == "TD" else leading
                move(args[-2], args[-1])
            case "T*" | "'" | '"':
                move(0, -leading)
                if t != "T*":
                    show(args[-1])
            case "Tj":
                show(args[-1])
            case "TJ":
                for part in args[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    else:
                        text = multiply((1, 0, 0, 1, -part / 1000 * size, 0), text)
        args = []
    return out


def upright_turn(found: list[tuple[str, Matrix, float, str]], view: Matrix) -> int:
    """The quarter turn at which most text runs on the shown page: 90, 270, or 0."""
    votes: dict[int, int] = {}
    for s, m, _, _ in found:
        a = multiply(m, view)
        turn = int(math.floor(math.degrees(math.atan2(a[1], a[0])) / 90 + 0.5) * 90) % 360
        if weight := len(s.strip()):
            votes[turn] = votes.get(turn, 0) + weight
    best = max(votes, key=votes.__getitem__, default=0)
    return best if best in (90, 270) else 0


def read_pdf(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(tokens, pages) without the document's name; boxes as a reader sees them."""
    doc = Document(raw)
    tokens, pages = [], []
    for index, page in enumerate(doc.pages()):
        box = [float(doc.get(x)) for x in doc.get(page.get("MediaBox")) or (0, 0, 595, 842)]
        rotation = int(doc.get(page.get("Rotate")) or 0) % 360
        found = runs(doc, page)
        turn = upright_turn(found, viewport(box, rotation)[0])
        view, width, height = viewport(box, rotation - turn)
        pages.append((index, width, height, (rotation - turn) % 360, turn))
        for s, m, run_width, font in found:
            if not s.strip():
                continue
            a = multiply(m, view)
            corners = [(x * a[0] + y * a[2] + a[4], x * a[1] + y * a[3] + a[5]) for x in (0, run_width) for y in (0, 1)]
            xs, ys = zip(*corners)
            size = math.hypot(a[2], a[3])
            bold = re.search(BOLD[4:], font, re.I) is not None
            tokens.append((index, len(tokens), s, min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), size, font, bold))
    return tokens, pages


PARSED = (
    "doc_id string, error string, "
    "tokens array<struct<page:int,ord:int,text:string,x:double,y:double,w:double,h:double,size:double,font:string,bold:boolean>>, "
    "pages array<struct<page:int,width:double,height:double,rotation:int,correction:int>>"
)
TOKEN_FIELDS = ("page", "ord", "text", "x", "y", "w", "h", "size", "font", "bold")
PAGE_FIELDS = ("page", "width", "height", "rotation", "correction")


def parse_files(files: DataFrame) -> DataFrame:
    """doc_id, error, tokens, pages of ``path`` and ``content``; an unreadable file has its reason and no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    tokens, pages = read_pdf(bytes(content))
                    out.append((path, None, [dict(zip(TOKEN_FIELDS, t)) for t in tokens], [dict(zip(PAGE_FIELDS, p)) for p in pages]))
                except Exception as e:  # noqa: BLE001  one bad file must not cost the others
                    out.append((path, str(e) or type(e).__name__, [], []))
            yield pd.DataFrame(out, columns=["doc_id", "error", "tokens", "pages"])

    return files.select("path", "content").mapInPandas(run, PARSED)


FILES = "binaryFile"


def list_files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(path, doc_id) of the PDF files under a folder that are read, and how many files are skipped.

    Skipped are other kinds of files, and all but one of several files of one name and size. Only names
    and sizes are read. A document is called by its file's name, or by its path where the name isn't its own.
    """
    every = spark.read.format(FILES).option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = every.withColumn("name", F.element_at(F.split("path", "/"), -1))
    total = named.count()
    pdf = named.filter(F.lower("name").endswith(".pdf")).groupBy("name", "length").agg(F.min("path").alias("path"))
    names = pdf.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    kept = stage(pdf.join(names, "name").select("path", F.when(F.col("n") == 1, F.col("name")).otherwise(F.col("path")).alias("doc_id")), "pdf-files")
    return kept, total - kept.count()


def read_contents(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """doc_id and content of the listed files; the list is small beside the contents, which stay where they are read."""
    files = spark.read.format(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").join(kept, "path").select("doc_id", "content")


def read_pdfs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, pages, unreadable) of all PDF files under a folder. Raises if not one can be read."""
    kept, _ = list_files(spark, path)
    return tokens_of(read_contents(spark, path, kept))


def tokens_of(contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, pages, unreadable) of doc_id and content. Raises if there are files and not one can be read."""
    parsed = stage(parse_files(contents.withColumnRenamed("doc_id", "path")), "pdf-parsed")
    total, bad, reason = parsed.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNotNull()), F.min("error")).first()
    if total and bad == total:
        raise ValueError(f"no file could be read: {reason}")
    tokens = parsed.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.*")
    pages = parsed.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    return tokens, pages, parsed.filter("error is not null").select("doc_id", "error")


def write_pdf(pages: list[tuple[float, float, int, list[tuple[str, float, float, float, bool]]]], compress: bool = True) -> bytes:
    """A file of (width, height, rotation, runs); a run is (text, x, baseline from the top, size, bold)."""
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>"]
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    bodies.append(f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>")
    bodies += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{f} /Encoding /WinAnsiEncoding >>" for f in ("Helvetica", "Helvetica-Bold")]
    out = [b.encode() for b in bodies]
    for width, height, rotation, text in pages:
        out.append((
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Rotate {rotation} "
            f"/Resources << /Font << /F0 3 0 R /F1 4 0 R >> >> /Contents {len(out) + 2} 0 R >>"
        ).encode())
        body = b""
        for s, x, y, size, bold in text:
            raw = re.sub(rb"([()\\])", rb"\\\1", s.encode("cp1252", "replace"))
            body += f"BT /F{int(bold)} {size} Tf 1 0 0 1 {x} {height - y} Tm (".encode() + raw + b") Tj ET\n"
        data = zlib.compress(body) if compress else body
        head = f"<< /Length {len(data)}{' /Filter /FlateDecode' if compress else ''} >>\nstream\n"
        out.append(head.encode() + data + b"\nendstream")
    file, places = b"%PDF-1.4\n", []
    for i, body in enumerate(out, 1):
        places.append(len(file))
        file += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    tail = f"xref\n0 {len(out) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(out) + 1} /Root 1 0 R >>\nstartxref\n{len(file)}\n%%EOF\n"
    return file + tail.encode()
