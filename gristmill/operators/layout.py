"""Word boxes of scanned or text-layer pages to lines, cells, tables and blocks.

``words(page_id, text, x0, x1, y0, y1)``. A page holds a bounded number of boxes, so windows and groups by page stay
small; pages are spread over the cluster by their key. Words become one row a line as early as possible: cells, table
rows and texts are array functions of that row, so no step looks at the words a second time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import lines as L
from gristmill.functions.text import collapse, let


_LINE, _WORD = ["page_id", "line_no"], "struct<word_no: int, text: string, x0: double, x1: double>"


def _page_starts(page: pa.Array | None, ids: pa.Array) -> np.ndarray:
    """Where the page differs from that of the word before; words whose page is a null number share no page."""
    v = pa.concat_arrays([pa.nulls(1, ids.type) if page is None else page, ids])
    if pa.types.is_nested(ids.type):
        v = v.to_pylist()
        return np.array([a != b for a, b in zip(v, v[1:])])
    null = v.is_null().to_numpy(zero_copy_only=False)
    differs = pc.fill_null(pc.not_equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    if pa.types.is_integer(ids.type) or pa.types.is_floating(ids.type) or pa.types.is_timestamp(ids.type):
        differs |= null[1:]
    return differs


_NUMBERS = ("x0", "x1", "_c")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as they are shuffled: those of a page and batch in the order of their centres, by columns, compressed."""
    codec = pa.Codec("zstd", 1)
    for b in batches:
        if not b.num_rows:
            continue
        ids = b["page_id"].dictionary_encode()
        page, c = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False), b["_c"].to_numpy(zero_copy_only=False)
        order = np.lexsort((c, b["_c"].is_valid().to_numpy(zero_copy_only=False), page))
        b, page = b.take(pa.array(order)), page[order]
        at = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
        sizes, blobs = [], []
        text = b["text"]
        missing = np.stack([b[k].is_null().to_numpy(zero_copy_only=False) for k in ("text", *_NUMBERS)])
        length = pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int32)
        end = np.append(0, np.cumsum(length))
        chars = b"".join(x.encode() for x in text.to_pylist() if x)
        values = [pc.fill_null(b[k], 0.0).to_numpy() for k in _NUMBERS]
        for i, j in zip(at.tolist(), np.append(at[1:], len(page)).tolist()):
            # bytes of equal weight stand together, which compresses well
            planes = [np.ascontiguousarray(v[i:j]).view(np.uint8).reshape(j - i, -1).T.tobytes() for v in (*values, length)]
            raw = b"".join([*planes, np.packbits(missing[:, i:j], axis=1).tobytes(), chars[end[i]:end[j]]])
            sizes.append(len(raw))
            blobs.append(codec.compress(raw, asbytes=True))
        n = np.diff(np.append(at, len(page))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b["page_id"].take(pa.array(at)), b["_c"].take(pa.array(at)), pa.array(sizes, pa.int32()), pa.array(n), pa.array(blobs, pa.binary())],
                                         ["page_id", "first", "size", "n", "words"])


def _unpacked(raw: bytes, n: int) -> pa.RecordBatch:
    def numbers(at: int, width: int, kind) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()

    values = [numbers(8 * n * k, 8, np.float64) for k in range(3)]
    end = np.append(0, np.cumsum(numbers(24 * n, 4, np.int32))).astype(np.int32)
    width = -(-n // 8)
    missing = np.unpackbits(np.frombuffer(raw, np.uint8, 4 * width, 28 * n).reshape(4, width), axis=1, count=n).astype(bool)
    text = pa.StringArray.from_buffers(n, pa.py_buffer(end.tobytes()), pa.py_buffer(raw[28 * n + 4 * width:]))
    if missing[0].any():
        text = pc.if_else(pa.array(missing[0]), pa.scalar(None, pa.string()), text)
    return pa.RecordBatch.from_arrays([text, *(pa.array(v, mask=m) for v, m in zip(values, missing[1:]))], ["text", *_NUMBERS])


def _unpack(batches: Iterator[pa.RecordBatch], least: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The words of each page in the order of their centres; of a page only what its next part can still precede is held."""
    codec, page, held = pa.Codec("zstd"), None, None
    ids: list[pa.Array] = []
    ready: list[pa.RecordBatch] = []
    rows = 0

    def let_go(words: pa.RecordBatch) -> int:
        if words.num_rows:
            ids.append(pa.repeat(page, words.num_rows))
            ready.append(words)
        return words.num_rows

    def batch() -> pa.RecordBatch:
        words = pa.Table.from_batches(ready).combine_chunks()
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(words[k].combine_chunks() for k in ("text", *_NUMBERS))], ["page_id", "text", *_NUMBERS])
        ids.clear()
        ready.clear()
        return out

    for b in batches:
        for i in range(b.num_rows):
            own, first = b["page_id"][i], b["first"][i].as_py()
            words = _unpacked(codec.decompress(b["words"][i].as_py(), b["size"][i].as_py(), asbytes=True), b["n"][i].as_py())
            if held is not None and own == page:
                # words before the first of this part are in place, the others are put in order with it
                c = held["_c"]
                k = c.null_count
                cut = 0 if first is None else k + int(np.searchsorted(c.to_numpy(zero_copy_only=False)[k:], first))
                rows += let_go(held.slice(0, cut))
                words = pa.Table.from_batches([held.slice(cut), words]).combine_chunks().to_batches()[0]
                words = words.take(pa.array(np.lexsort((words["_c"].to_numpy(zero_copy_only=False), words["_c"].is_valid().to_numpy(zero_copy_only=False)))))
            elif held is not None:
                rows += let_go(held)
            page, held = own, words
            if rows >= least:
                yield batch()
                rows = 0
    if held is not None:
        let_go(held)
        yield batch()


def _word_order(t: pa.Table, line: np.ndarray) -> np.ndarray:
    """Order of words by line, left edge (null first, NaN last) and text."""
    x, known = t["x0"].to_numpy(), t["x0"].is_valid().to_numpy()
    order = np.lexsort((x, known, line))
    a, b = order[1:], order[:-1]
    if ((line[a] == line[b]) & (known[a] == known[b]) & ~((x[a] < x[b]) | (x[a] > x[b]))).any():
        text = t["text"].combine_chunks()
        rank = pc.rank(text, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, np.where(known, x, 0.0), known, line))
    return order


def layout_lines(words: DataFrame, tolerance: float = 8.0, by_line: bool = False) -> DataFrame:
    """Add ``line_no`` (0-based) and ``word_no`` (order by x inside the line).

    With ``by_line`` a line is one row, (page_id, line_no, _w) with its words (word_no, text, x0, x1) in order, which the
    functions below take as well: words are then shuffled once, and not a second time to be put together.

    A word joins the running line while its centre is within ``tolerance`` of the mean centre of the line so far. The
    mean moves with every word, which no window function can express, so sorted partitions are streamed with four
    values of state and the words of the last line; no page is ever held as a group. Words further apart than the
    tolerance are always parted, and a run of words no higher than the tolerance is always one line, so the mean is
    followed word by word only in runs that are neither.
    """
    kind = dict(words.dtypes)["page_id"]

    def finished(t: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = _word_order(t, np.cumsum(start))
        at = np.flatnonzero(start)
        no = np.arange(len(start)) - np.repeat(at, np.diff(np.append(at, len(start))))
        t = t.take(pa.array(order)).add_column(2, "word_no", pa.array(no, pa.int32()))
        if by_line:
            parts = ["word_no", "text", "x0", "x1"]
            held = pa.StructArray.from_arrays([t[c].combine_chunks() for c in parts], parts)
            rows = pa.ListArray.from_arrays(pa.array(np.append(at, len(start)), pa.int32()), held)
            t = t.select(_LINE).take(pa.array(at)).append_column("_w", rows)
        yield from t.combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, line, last, mean, n = None, 0, 0.0, 0.0, 0
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            c = b["_c"].to_numpy(zero_copy_only=False)
            new = _page_starts(page, b["page_id"])
            with np.errstate(invalid="ignore"):  # differences of infinite centres
                slack = 1e-6 * (np.abs(c) + tolerance)  # far more than the mean is ever rounded by
                start = new | ~(np.diff(c, prepend=last) <= tolerance + slack)
                first = np.flatnonzero(start) if start[0] else np.append(0, np.flatnonzero(start))
                end = np.append(first[1:], len(c))
                follow = ~(c[end - 1] - c[first] <= tolerance - slack[first] - slack[end - 1])
            follow[0] |= not start[0]
            follow[-1] = True
            for i, j in zip(first[follow].tolist(), end[follow].tolist()):
                if start[i]:
                    mean, n, i = float(c[i]), 1, i + 1
                for k, x in enumerate(c[i:j].tolist(), i):
                    if abs(x - mean) <= tolerance:
                        n += 1
                        mean = (mean * (n - 1) + x) / n
                    else:
                        start[k], mean, n = True, x, 1
            more = np.cumsum(start & ~new)
            at = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
            no = np.where(at >= 0, more - more[at], more + line)
            page, line, last = b["page_id"].slice(len(c) - 1), int(no[-1]), float(c[-1])
            t = pa.Table.from_batches([b]).drop_columns("_c").add_column(1, "line_no", pa.array(no, pa.int32()))
            starts = np.flatnonzero(start)
            if len(starts):  # the last line may go on in the next batch
                before = sum(x.num_rows for x in held)
                if before + starts[-1]:
                    flags = np.append(np.zeros(before, bool), start[:starts[-1]])
                    flags[0] = True
                    yield from finished(pa.concat_tables([*held, t.slice(0, starts[-1])]), flags)
                held, t = [], t.slice(starts[-1])
            held.append(t)
        if held:
            t = pa.concat_tables(held)
            yield from finished(t, np.arange(t.num_rows) == 0)

    c = ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("_c")
    x = words.select("page_id", F.col("text").cast("string"), *(F.col(k).cast("double") for k in ("x0", "x1")), *([] if by_line else [F.col(k).cast("double") for k in ("y0", "y1")]), c)
    if not by_line:
        x = x.repartition("page_id").sortWithinPartitions("page_id", "_c")
        return x.mapInArrow(scan, f"page_id {kind}, line_no int, word_no int, text string, x0 double, x1 double, y0 double, y1 double")
    made, alone = f"page_id {kind}, line_no int, _w array<{_WORD}>", None
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "timestamp_ntz"):
        # words of such a page share none, so each is the first of its line; lines of equal page and number are one
        none = F.col("page_id").isNull() | (F.isnan("page_id") if kind in ("float", "double") else F.lit(False))
        alone = x.filter(none).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.lit(0).alias("word_no"), "text", "x0", "x1"))).cast(f"array<{_WORD}>").alias("_w"))
        x = x.filter(~none)
    packed = f"page_id {kind}, first double, size int, n int, words binary"
    x = x.mapInArrow(_pack, packed).repartition("page_id").sortWithinPartitions("page_id", "first")
    x = x.mapInArrow(lambda rows: scan(_unpack(rows)), made)
    return x if alone is None else x.unionByName(alone.select("page_id", F.lit(0).alias("line_no"), "_w"))


def layout_lines_by_gap(words: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Window form: a new line starts when the centre lies more than ``tolerance`` below the previous word's."""
    c = (F.col("y0") + F.col("y1")) / 2
    w = W.partitionBy("page_id").orderBy("_c", "x0", "text")
    x = words.withColumn("_c", c)
    x = x.withColumn("_new", F.coalesce((F.col("_c") - F.lag("_c").over(w) > tolerance).cast("int"), F.lit(0)))
    x = x.withColumn("line_no", F.sum("_new").over(w).cast("int")).drop("_c", "_new")
    return x.withColumn("word_no", (F.row_number().over(W.partitionBy("page_id", "line_no").orderBy("x0", "text")) - 1).cast("int"))


def _line_rows(lines: DataFrame, make) -> DataFrame:
    """One row a line: the structs in ``make(words, gaps, positive)``, from its words in order, the gap before each and the sorted positive gaps."""
    g = lines
    if "_w" not in lines.columns:
        g = lines.groupBy(*_LINE).agg(F.sort_array(F.collect_list(F.struct("word_no", "text", "x0", "x1"))).alias("_w"))
    made = let(F.col("_w"), lambda w: let(F.transform(w, lambda x, i: x["x0"] - F.get(w, i - 1)["x1"]), lambda gaps: let(
        F.sort_array(F.filter(gaps, lambda x: x > 0)), lambda positive: make(w, gaps, positive))))
    return g.select(*_LINE, F.inline(made))


def _text(words: Column) -> Column:
    return collapse(F.array_join(F.transform(words, lambda w: w["text"]), " "))


def _cell_starts(gaps: Column, positive: Column) -> Column:
    """Places of the words that begin a cell."""
    low = F.get(positive, F.lit(0))
    limit = F.when(low.isNull(), 15.0).otherwise(F.least(F.lit(50.0), F.greatest(F.lit(8.0), low * 2.5)))
    return let(limit, lambda m: F.filter(F.transform(gaps, lambda g, i: F.when((i == 0) | (g > m), i)), lambda i: i.isNotNull()))


def _cells(words: Column, gaps: Column, positive: Column) -> Column:
    """Cells (text, x0, x1) of a line, in order."""
    def cell(w: Column) -> Column:
        return F.struct(_text(w).alias("text"), F.get(w, F.lit(0))["x0"].alias("x0"), F.element_at(w, -1)["x1"].alias("x1"))

    return let(_cell_starts(gaps, positive), lambda s: F.transform(s, lambda at, i: let(
        F.slice(words, at + 1, F.coalesce(F.get(s, i + 1), F.size(words)) - at), cell)))


def layout_cells(lines: DataFrame) -> DataFrame:
    """Cells of each line: a gap wider than 2.5 x the smallest gap (kept within 8..50) starts a new cell."""
    return _line_rows(lines, lambda w, gaps, positive: F.transform(_cells(w, gaps, positive), lambda c, i: F.struct(
        i.alias("cell_no"), c["text"].alias("text"), c["x0"].alias("x0"), c["x1"].alias("x1"))))


def _is_row(words: Column, positive: Column) -> Column:
    low = F.get(positive, F.lit(0))
    limit = F.least(F.lit(50.0), F.greatest(F.lit(8.0), F.greatest(low * 2.5, low + 6)))
    wide = F.size(let(limit, lambda m: F.filter(positive, lambda x: x > m)))
    return (F.size(words) >= 4) & (F.size(positive) >= 3) & (wide >= 3)


def table_rows(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, is_row): at least four words and three wide gaps."""
    return _line_rows(lines, lambda w, gaps, positive: F.array(F.struct(_is_row(w, positive).alias("is_row"))))


def _columns(edges: Column, column_gap: float) -> Column:
    """Column starts: means of runs of sorted left edges, a new one where the step is wider than ``column_gap``."""
    def state(cols: Column, total: Column, n: Column, last: Column) -> Column:
        return F.struct(cols, total, n, last).cast("struct<cols: array<double>, total: double, n: bigint, last: double>")

    def grown(s: Column) -> Column:
        return F.concat(s["cols"], F.array(s["total"] / s["n"]))

    return F.aggregate(
        F.sort_array(F.filter(edges, lambda x: x.isNotNull())),
        state(F.array().cast("array<double>"), F.lit(0.0), F.lit(0), F.lit(None)),
        lambda s, x: F.when(x - s["last"] > column_gap, state(grown(s), x, F.lit(1), x)).otherwise(state(s["cols"], s["total"] + x, s["n"] + 1, x)),
        lambda s: F.sort_array(F.when(s["n"] > 0, grown(s)).otherwise(s["cols"])))


def _row_cells(cells: Column, cols: Column, steps: Column) -> Column:
    """(col_no, text) of a table row: each cell goes to its nearest column, the first of equals; cells of a column are joined."""
    def column(x: Column) -> Column:  # halving steps to the right, as long as the column there is nearer than the one before it
        nearer = lambda at: F.abs(x - F.get(cols, at)) < F.abs(x - F.get(cols, at - 1))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(nearer(at + step), at + step).otherwise(at))

    def joined(a: Column) -> Column:
        nos = F.array_distinct(F.transform(a, lambda c: c["col_no"]))
        texts = lambda k: F.transform(F.filter(a, lambda c: c["col_no"] == k), lambda c: c["text"])
        return F.when(F.size(nos) == F.size(a), a).otherwise(F.transform(nos, lambda k: F.struct(k.alias("col_no"), F.array_join(texts(k), " ").alias("text"))))

    return let(F.transform(cells, lambda c: F.struct(column(c["x0"]).alias("col_no"), c["text"].alias("text"))), joined)


def layout_tables(lines: DataFrame, column_gap: float = 25.0) -> DataFrame:
    """Table cells: (page_id, table_no, row_no, col_no, text, line_start, line_end); runs of two or more table rows."""
    r = _line_rows(lines.filter(F.col("page_id").isNotNull()), lambda w, gaps, positive: F.when(
        _is_row(w, positive), F.array(F.struct(_cells(w, gaps, positive).alias("cells")))))
    r = r.withColumn("_run", F.col("line_no") - F.row_number().over(W.partitionBy("page_id").orderBy("line_no")))
    r = r.groupBy("page_id", "_run").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.sort_array(F.collect_list(F.struct("line_no", "cells"))).alias("_r"))
    edges = F.flatten(F.transform("_r", lambda r: F.transform(r["cells"], lambda c: c["x0"])))

    def rows(cols: Column) -> Column:
        steps = F.filter(F.transform(F.sequence(F.lit(30), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int")), lambda p: p < F.size(cols))
        return F.when(F.size(cols) >= 3, let(steps, lambda p: F.flatten(F.transform("_r", lambda r: F.transform(_row_cells(r["cells"], cols, p), lambda c: F.struct(
            (r["line_no"] - F.col("line_start")).alias("row_no"), c["col_no"].alias("col_no"), c["text"].alias("text")))))))

    return r.select("page_id", "line_start", "line_end", F.inline(F.when(F.size("_r") >= 2, let(_columns(edges, column_gap), rows))))


def line_texts(lines: DataFrame) -> DataFrame:
    return _line_rows(lines, lambda w, gaps, positive: F.array(F.struct(_text(w).alias("t"))))


# Heading shapes and page numbers of scanned pages.
HEADING_WORDS = r"(?i)^(article|artikel|kapitel|chapter|section|avsnitt|sektion|bilaga|annex|appendix|exhibit|schedule|table|tabell)\s+[\dIVX]+"
SCAN_PAGE_RE = r"(?i)^(\d{1,4}|page\s+\d+(\s+of\s+\d+)?|sida\s+\d+(\s+av\s+\d+)?|\d+\s*/\s*\d+|[-–—]\s*\d+\s*[-–—]|\[\s*\d+\s*\])$"


def is_scan_heading(t: Column) -> Column:
    n = F.length(t)
    letters, uppers = F.regexp_count(t, F.lit("[A-Za-zÅÄÖåäö]")), F.regexp_count(t, F.lit("[A-ZÅÄÖ]"))
    shape = (
        t.rlike(r"^§\s*\d+") | (t.rlike(r"^\d+(\.\d+){0,3}[.)]?\s+[A-ZÅÄÖ]") & (n < 80)) | t.rlike(HEADING_WORDS) | (t.rlike(r"^[IVX]+\.\s+[A-ZÅÄÖ]") & (n < 80))
        | ((letters > 4) & (n < 70) & (uppers / F.greatest(letters, F.lit(1)) > 0.8)) | ((n < 60) & ~t.rlike(r"[.,;:!?]$") & t.rlike("^[A-ZÅÄÖ]")))
    return (n > 0) & (n <= 90) & shape


def heading_level(t: Column) -> Column:
    return F.when(t.rlike(r"^§\s*\d+") | t.rlike(r"^\d+[.)]?\s+[A-ZÅÄÖ]"), 1).otherwise(2)


def layout_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of a page: (page_id, block_no, type, level, text, words). Types h, ul, p, table; page numbers are dropped.

    Line classes, then islands: a list is a run of list lines; a paragraph ends at a sentence end before a capital.
    """
    x = _line_rows(lines, lambda w, gaps, positive: F.array(let(_is_row(w, positive) & F.col("page_id").isNotNull(), lambda row: F.struct(
        row.alias("_row"), _text(w).alias("t"), F.when(row, F.transform(_cell_starts(gaps, positive), lambda i: F.get(w, i)["x0"])).alias("_x")))))
    # runs of table rows, all other lines alone; a run of two rows and three columns or more is a table
    w = W.partitionBy("page_id").orderBy("line_no")
    run = F.col("line_no") - F.when(F.col("_row"), F.sum(F.col("_row").cast("int")).over(w)).otherwise(0)
    r = x.withColumn("_run", run).groupBy("page_id", "_row", "_run").agg(
        F.min("line_no").alias("_start"), F.sort_array(F.collect_list(F.struct("line_no", "t", "_x"))).alias("_r"))
    n_cols = F.size(_columns(F.flatten(F.transform("_r", lambda r: r["_x"])), 25.0))
    table = F.when(F.col("_row") & (F.size("_r") >= 2), F.when(n_cols >= 3, F.col("_start")))
    x = r.select("page_id", F.inline(let(table, lambda start: F.transform("_r", lambda r: F.struct(
        r["line_no"].alias("line_no"), r["t"].alias("t"), start.alias("line_start"))))))
    x = x.filter((F.col("t") != "") | F.col("line_start").isNotNull())
    t = F.col("t")
    kind = (
        F.when(F.col("line_start").isNotNull(), "table").when(t.rlike(SCAN_PAGE_RE), "skip").when(is_scan_heading(t), "h").when(L.is_list_line(t), "ul").otherwise("p"))
    x = x.withColumn("type", kind)
    prev, prev_t = F.lag("type").over(w), F.lag("t").over(w)
    ends = F.coalesce(prev_t.rlike(r"[.!?:;]$") & t.rlike("^[A-ZÅÄÖ]"), F.lit(False))
    same_table = F.coalesce(F.lag("line_start").over(w) == F.col("line_start"), F.lit(False))
    goes_on = F.when(F.col("type") == "table", same_table).when(F.col("type") == "ul", prev == "ul").when(F.col("type") == "p", (prev == "p") & ~ends).otherwise(False)
    x = x.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("block_no", F.sum("_new").over(w))
    strip = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\s*[-*•·–—]\s+", ""), r"^\s*\d+[.)]\s+", ""), r"(?i)^\s*[a-z][.)]\s+", "")
    # texts of lines are collapsed: words are parted by one space, and joined lines need no second pass
    body = F.when(F.col("type") == "ul", strip).otherwise(t)
    n = F.when(F.col("b") == "", 0).otherwise(F.length("b") - F.length(F.replace(F.col("b"), F.lit(" "), F.lit(""))) + 1)
    g = x.filter("type <> 'skip'").withColumn("b", body).groupBy("page_id", "block_no", "type").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "b"))).alias("_l"), F.sum(n).cast("int").alias("words"))
    parts = F.transform("_l", lambda r: r["b"])
    text = F.when(F.col("type") == "p", F.array_join(parts, " ")).otherwise(F.array_join(parts, "\n"))
    out = g.select("page_id", "block_no", "type", text.alias("text"), "words")
    level = F.when(F.col("type") == "h", heading_level(F.col("text")))
    no = F.row_number().over(W.partitionBy("page_id").orderBy("block_no"))
    return out.select("page_id", no.alias("block_no"), "type", level.alias("level"), "text", "words")
