"""Statement files: routing by bytes, CSV and XLSX rows, and typed line fields. Python only splits a file into rows of cells; header
search, column mapping and typing are DataFrame operations."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
import zlib
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.constants import FIELD_FAMILIES, HEADER_SYNONYMS
from statera.functions import scalar as S

HEAD, BATCH_ROWS = 8192, 4096
MOST_BYTES, MOST_ROWS, MOST_CELL, MOST_COLUMNS, HEADER_ROWS, HEADER_SHARE = 32 << 20, 5000, 64 << 10, 1024, 100, 0.6


#: What the readers raise over a file that is cut short or malformed. Anything else is a fault of the program and ends the job.
DAMAGE = (csv.Error, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, struct.error, EOFError, KeyError, IndexError, ValueError, ArithmeticError, NotImplementedError, RuntimeError)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content; pruned to what a query needs."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def safe_path(c) -> F.Column:
    """True for a relative path that stays inside its folder."""
    p = S._col(c)
    return p.isNotNull() & (F.length(p) > 0) & ~p.contains("\x00") & ~p.rlike(r"^[/\\]|^[A-Za-z]:") & ~p.rlike(r"(^|[/\\])\.\.([/\\]|\z)")


def looks_delimited(content) -> F.Column:
    """Printable text with two of one of comma, bar and tab in its head; line ends count as control characters."""
    head = F.substring(S._col(content), 1, HEAD)
    # cp1252 by way of Latin-1: they differ in the C1 range, of which cp1252 leaves five bytes undefined.
    other = F.regexp_replace(F.decode(head, "iso-8859-1"), r"[\x81\x8D\x8F\x90\x9D]", "\uFFFD")
    text = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(other)
    bad = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0A-\x1F\uFFFD]", ""))
    clean = F.regexp_replace(text, r"[\x00-\x08\x0A-\x1F]", "")
    enough = F.lit(False)
    for mark in (",", "|", "\t"):
        enough = enough | (F.length(clean) - F.length(F.translate(clean, mark, "")) >= 2)
    return (F.length(text) > 0) & (bad <= F.length(text) * 0.1) & enough


def pdf_kind(data: bytes) -> tuple[str, str | None]:
    """(route, error) of a PDF by its trailer: encrypted, cut short, or a PDF, whose text layer route() takes from a table of words."""
    if b"/Encrypt" in data:
        return "unprocessable", "encrypted"
    return ("pdf", None) if b"%%EOF" in data[-1024:] else ("unprocessable", "truncated")


def zip_kind(data: bytes) -> tuple[str, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return ("xlsx", None) if "xl/workbook.xml" in z.namelist() else ("unprocessable", "unrecognized")
    except zipfile.BadZipFile:
        return "unprocessable", "truncated"


def _deep(contents: pa.Array) -> pa.Array:
    """Route and error of PDFs and archives; NULL, which other files are given as, says nothing."""
    out = []
    for content in contents:
        data = content.as_py()
        try:
            out.append((None, None) if data is None else pdf_kind(data) if data.startswith(b"%PDF-") else zip_kind(data))
        except DAMAGE:
            out.append(("unprocessable", "truncated"))
    return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], ["route", "error"])


def routed(files: DataFrame) -> DataFrame:
    """files (content and others) with route and error by signature, as route() says them without layers. Nothing is moved: the files keep
    their rows, and of the contents only PDFs and archives go through Python. A result that is read by its route is best written first."""
    c = F.col("content")
    binary = (F.substring(c, 1, 5) == F.lit(b"%PDF-")) | (F.substring(c, 1, 4) == F.lit(b"PK\x03\x04"))
    say = lambda route, error=None: F.struct(F.lit(route).alias("route"), F.lit(error).cast("string").alias("error"))
    plain = F.when(F.octet_length("content") == 0, say("unprocessable", "empty")).when(looks_delimited("content"), say("csv")).otherwise(say("unprocessable", "unrecognized"))
    out = files.withColumn("_deep", F.arrow_udf(_deep, "route string, error string")(F.when(binary, c)))
    return out.withColumn("_kind", F.when(F.coalesce(binary, F.lit(False)), F.col("_deep")).otherwise(plain)).select(*files.columns, "_kind.route", "_kind.error")


def route(files: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """path, route, error by signature, never by name: empty, PDF, workbook, delimited text, or unrecognized. layers (path, route) says which
    PDFs show text (pdf.text_layer); a PDF it doesn't name is scanned. Without layers nothing is known of their text, and the route is `pdf`."""
    out = routed(files.select("path", "content")).drop("content")
    if layers is not None:
        out = out.join(layers.select("path", F.col("route").alias("_layer")), "path", "left")
    layer = F.coalesce("_layer", F.lit("scanned_pdf")) if layers is not None else F.lit("pdf")
    return out.select("path", F.when(F.col("route") == "pdf", layer).otherwise(F.col("route")).alias("route"), "error")


MARKS = ",|\t"


def _steady(head: str) -> str:
    """What csv.Sniffer takes for the delimiter of a head without quotes, counting MARKS alone where it counts each ASCII character in each
    line: the mark whose usual number a line the most lines agree on, ten lines at a time until only one mark is steady enough; else ''."""
    lines = [x for x in head.split("\n") if x]
    counts: dict[str, dict[int, int]] = {m: {} for m in MARKS}
    good: dict[str, tuple[int, int]] = {}
    modes: dict[str, tuple[int, int]] = {}
    step = min(10, len(lines))
    for end in range(step, len(lines) + step, step or 1):
        for m, seen in counts.items():
            for line in lines[end - step : end]:
                n = line.count(m)
                seen[n] = seen.get(n, 0) + 1
            usual = max(seen.items(), key=lambda x: x[1])
            modes[m] = (usual[0], 2 * usual[1] - sum(seen.values()))
        total, asked = float(min(end, len(lines))), 1.0
        while not good and asked >= 0.9:
            good = {m: v for m, v in modes.items() if v[0] > 0 and v[1] > 0 and v[1] / total >= asked}
            asked -= 0.01
        if len(good) == 1:
            break
    return next((m for m in csv.Sniffer().preferred if m in good), "") or max(((v, m) for m, v in good.items()), default=("", ""))[1]


def _mark(head: str) -> str:
    """The delimiter of a head. The sniffer chooses among those that occur; it takes many times as long as reading a small file, so it isn't
    asked where only one does, nor where no quote is to be considered."""
    found = [m for m in MARKS if m in head]
    if len(found) < 2:
        return found[0] if found else ","
    best = max(MARKS, key=head.count)
    if '"' not in head and "'" not in head:
        return _steady(head) or best
    try:
        return csv.Sniffer().sniff(head, MARKS).delimiter
    except csv.Error:
        return best


def _csv_cells(data: bytes) -> list[list[str]]:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    text = text.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf")
    csv.field_size_limit(MOST_BYTES)  # the module's own limit would end a file for a cell that MOST_CELL is to judge
    return list(csv.reader(io.StringIO(text), delimiter=_mark(text[:4096])))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


_ROW, _CELL, _VALUE, _TEXT = (f"{{{_NS['m']}}}{n}" for n in ("row", "c", "v", "t"))
_LETTERS, _CONTROL = re.compile("[A-Z]*"), re.compile(r"[\x00-\x08\x0A-\x1F]")


# Workbooks of one origin share the small parts beside the sheet, byte for byte; each is parsed once a worker.
@lru_cache(64)
def _formats(styles: bytes) -> tuple[str, ...]:
    """The number format of each cell style; built-in ones by what they show."""
    root = ElementTree.fromstring(styles)
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", _NS)}
    known = {str(i): "yyyy-mm-dd" for i in (*range(14, 18), 22, *range(27, 32), 36, *range(50, 59))} | {str(i): "$#,##0.00" for i in (5, 6, 7, 8, 42, 44)}
    return tuple(own.get(x.get("numFmtId"), known.get(x.get("numFmtId"), "")) for x in root.findall("m:cellXfs/m:xf", _NS))


def cell_text(value: str, number_format: str, epoch: date = date(1899, 12, 30)) -> str:
    """A numeric cell as the sheet shows it: a date in ISO form, money grouped behind a dollar sign, else plain digits. Never a float."""
    number = Decimal(value)
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", number_format).lower()
    if "y" in bare or ("d" in bare and "m" in bare):
        return (epoch + timedelta(days=int(number))).isoformat()
    if "$" not in number_format:
        return format(number, "f")
    return ("-" if number < 0 else "") + f"${abs(number).quantize(Decimal('0.01'), ROUND_HALF_UP):,}"


_R, _REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}", "{http://schemas.openxmlformats.org/package/2006/relationships}"


@lru_cache(64)
def _sheet_ids(book: bytes) -> tuple[str | None, ...]:
    return tuple(s.get(f"{_R}id") for s in ElementTree.fromstring(book).findall("m:sheets/m:sheet", _NS))


@lru_cache(64)
def _related(relations: bytes) -> tuple[tuple[str | None, str], ...]:
    return tuple((r.get("Id"), r.get("Target", "")) for r in ElementTree.fromstring(relations).findall(f"{_REL}Relationship"))


def _small(parse, part: bytes):
    """parse(part), remembered unless the part is large."""
    return parse(part) if len(part) <= 16 << 10 else parse.__wrapped__(part)


def _first_sheet(z: zipfile.ZipFile, book: bytes, names: list[str]) -> str:
    """The part of the first sheet in the workbook's own order; by name only in a workbook that lists no sheets."""
    sheets = _small(_sheet_ids, book)
    if sheets and "xl/_rels/workbook.xml.rels" in names:
        for rid, target in _small(_related, z.read("xl/_rels/workbook.xml.rels")):
            if rid == sheets[0]:
                return target[1:] if target.startswith("/") else f"xl/{target}"
    return min(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))


def _xlsx_cells(data: bytes) -> list[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise OverflowError
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        formats = _small(_formats, z.read("xl/styles.xml")) if "xl/styles.xml" in names else ()
        book = z.read("xl/workbook.xml")
        sheet = ElementTree.fromstring(z.read(_first_sheet(z, book, names)))
    epoch = date(1904, 1, 1) if re.search(rb'date1904="(1|true)"', book) else date(1899, 12, 30)
    out = []
    for row in sheet.iter(_ROW):
        cells: dict[int, str] = {}
        for i, c in enumerate([x for x in row if x.tag == _CELL]):
            at = 0
            for ch in _LETTERS.match(c.get("r", ""))[0]:
                at = at * 26 + ord(ch) - 64
            kind = c.get("t", "n")
            if kind == "inlineStr":
                text = "".join([t.text or "" for t in c.iter(_TEXT)])
            else:
                text = next((v.text or "" for v in c if v.tag == _VALUE), "")
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b" and text:
                    text = str(text == "1")
                elif kind == "d":
                    text = text[:10]
                elif kind == "n" and text:
                    style = int(c.get("s", 0))
                    text = cell_text(text, formats[style] if style < len(formats) else "", epoch)
            cells[at - 1 if at else i] = text if text.isprintable() else _CONTROL.sub("", text)
        if cells and max(cells) >= MOST_COLUMNS:
            raise OverflowError
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


def parsed(data: bytes, kind: str) -> tuple[list[list[str]], str | None]:
    """Rows of cells and an error of one file; a file that can't be read is one row without cells."""
    if not data:
        return [[]], "empty"
    try:
        rows = {"csv": _csv_cells, "xlsx": _xlsx_cells}[kind](data) if len(data) <= MOST_BYTES else []
    except OverflowError:  # a ceiling; ArithmeticError otherwise
        rows = []
    except DAMAGE:
        return [[]], "truncated"
    over = not rows or len(rows) > MOST_ROWS + HEADER_ROWS or any(len(c) > MOST_CELL for r in rows for c in r)
    return ([[]], "too_large") if over else (rows, None)


def dealt(keys: DataFrame) -> DataFrame:
    """keys in as many parts as a shuffle has. A table is read in parts of so many bytes, and one of keys alone is small: what is made from
    them and read back would be the work of one task."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sheets(files: DataFrame, kind: str = "csv") -> DataFrame:
    """doc_id, rows, error: a file's rows of cells in order, as one value, which the ceilings bound; a file that can't be read has one row
    without cells and an error."""
    kinds = [pa.string(), pa.list_(pa.list_(pa.string())), pa.string()]

    def run(batches):
        cols, held = ([], [], []), 0

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "rows", "error"])
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, error = parsed(content.as_py() or b"", kind)
                for col, value in zip(cols, (doc.as_py(), rows, error), strict=True):
                    col.append(value)
                held += len(rows)
                if held >= BATCH_ROWS:
                    yield batch_of()
                    held = 0
        yield batch_of()

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, rows array<array<string>>, error string")


def cell_rows(files: DataFrame, kind: str = "csv") -> DataFrame:
    """doc_id, row_no, cells, error: a row of sheets() for each of a file's rows."""
    return sheets(files, kind).select("doc_id", F.posexplode("rows").alias("row_no", "cells"), "error")


def _whole(rows: DataFrame) -> DataFrame:
    """rows as sheets() gives them, or as cell_rows() does, gathered again."""
    if "rows" in rows.columns:
        return rows
    one = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"])
    return rows.groupBy("doc_id").agg(one.alias("rows"), *([F.max("error").alias("error")] if "error" in rows.columns else []))


def _header(stacked: bool) -> F.Column:
    """row_no, h (less the hits) and names of a file's header, NULL without one. Captions stand high: a row is looked
    at where none of the first three before it is the header, and the rest where none of these is."""
    known = F.create_map(*[F.lit(x) for name, words in HEADER_SYNONYMS.items() for w in words for x in (w, name)])

    def judged(cells, row_no):
        names = F.transform(cells, lambda c: F.try_element_at(known, S.header_key(c)))
        filled = F.size(F.filter(cells, lambda c: c.rlike(r"\S")))
        return F.struct(row_no.alias("row_no"), (-F.size(F.filter(names, lambda n: n.isNotNull()))).alias("h"), names.alias("names"), filled.alias("filled"))

    def variants(cells, row_no):
        if not stacked:
            return F.array(judged(cells, row_no))
        above = F.coalesce(F.get(F.col("rows"), row_no - 1), F.array())
        joined = F.zip_with(above, cells, lambda a, b: S.stripped(F.concat_ws(" ", a, b)))
        return F.transform(F.array_distinct(F.array(cells, joined)), lambda v: judged(v, row_no))

    def first(low, high):
        each = F.flatten(F.transform(F.slice("rows", low + 1, high - low), lambda cells, i: variants(cells, i + low)))
        return F.array_min(F.filter(each, lambda x: (x["filled"] > 0) & (-x["h"] >= HEADER_SHARE * x["filled"]) & (-x["h"] >= (2 if stacked else 1))))

    return F.coalesce(*[first(i, i + 1) for i in range(3)], first(3, HEADER_ROWS))


def _headed(rows: DataFrame, stacked: bool) -> DataFrame:
    """doc_id, rows, header_row, names of the files that have a header."""
    found = _whole(rows).select("doc_id", "rows", F.explode(F.filter(F.array(_header(stacked)), lambda h: h.isNotNull())).alias("f"))
    # A field named by two columns belongs to the first.
    once = F.transform("f.names", lambda n, i: F.when(F.array_position(F.col("f.names"), n) == i + 1, n))
    return found.select("doc_id", "rows", F.col("f.row_no").alias("header_row"), once.alias("names"))


def headers(rows: DataFrame, stacked: bool = False) -> DataFrame:
    """doc_id, header_row, names: the first row whose known captions are at least HEADER_SHARE of its filled cells. stacked also tries each
    row joined to the one above, as workbooks split captions over two rows. rows: as sheets() or cell_rows() gives them."""
    return _headed(rows, stacked).select("doc_id", "header_row", "names")


def line_fields(rows: DataFrame, stacked: bool = False) -> DataFrame:
    """Typed fields of the data rows below the header; blank rows and total rows don't count as lines. rows: as sheets() gives them, which
    moves nothing, or as cell_rows() does, which are gathered by document first."""
    body = _headed(rows.filter("error IS NULL AND doc_id IS NOT NULL"), stacked)
    blank = lambda c: ~c.rlike(r"\S")
    text = lambda cells: F.get(F.filter(cells, lambda c: ~blank(c)), F.lit(0))
    lines = F.filter(F.slice("rows", F.col("header_row") + 2, F.size("rows")), lambda cells: ~text(cells).rlike(r"(?i)^\s*total"))
    body = body.select("doc_id", "names", F.posexplode(lines).alias("at", "cells"))
    cells = body.select("doc_id", (F.col("at") + 1).alias("line_no"), F.explode(F.filter(F.arrays_zip("names", "cells"), lambda z: z["names"].isNotNull() & z["cells"].isNotNull())).alias("z"))
    family = F.create_map(*[F.lit(x) for kv in FIELD_FAMILIES.items() for x in kv])
    out = cells.select("doc_id", "line_no", F.col("z.names").alias("name"), F.col("z.cells").alias("raw_text")).withColumn("family", F.element_at(family, F.col("name")))
    # Each text is read as what its family holds, and as nothing else.
    out = out.withColumn("value_cents", F.when(F.col("family") == "amount", S.amount_cents("raw_text"))).withColumn("value_date", F.when(F.col("family") == "date", S.plausible_date("raw_text")))
    value = F.when(F.col("family") == "amount", S.format_cents("value_cents")).when(F.col("family") == "date", F.col("value_date").cast("string")).when(F.col("family") == "reference", F.nullif(S.reference("raw_text"), F.lit(""))).otherwise(F.nullif(S.stripped("raw_text"), F.lit("")))
    out = out.withColumn("value", value).select("doc_id", "line_no", "name", "raw_text", "family", "value", "value_cents", "value_date")
    ok = F.col("value").isNotNull()
    return out.withColumn("field_id", F.format_string("fld-%s-%04d-%s", "doc_id", "line_no", "name")).withColumn("confidence", F.when(ok, 1.0).otherwise(0.0)).withColumn("status", F.when(ok, "auto_accepted").otherwise("needs_review"))


def to_csv(lines: DataFrame) -> DataFrame:
    """doc_id, content: one CSV per statement, with a title line, a header and a total at the end."""
    cell = F.concat_ws(",", F.coalesce("invoice_number", F.lit("")), F.coalesce(F.col("line_date").cast("string"), F.lit("")), F.concat(F.lit('"'), S.styled_amount("amount_cents", F.lit("dollar_comma")), F.lit('"')))
    rows = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", cell.alias("c")))), lambda x: x["c"]), "\n").alias("body"), F.sum("amount_cents").alias("total"))
    text = F.concat(F.lit("Statement of account\nInvoice #,Post Dt,AMT\n"), F.col("body"), F.lit("\n\nTotal,,"), S.format_cents("total"), F.lit("\n"))
    return rows.select("doc_id", text.cast("binary").alias("content"))
