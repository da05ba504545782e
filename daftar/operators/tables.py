"""Tables inside texts: runs of pipe rows, their cells, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import bound, words
from daftar.operators.chunking import MARK, window_array

PIPE, DASH = r"(?U)^\s*\|.*\|.*\|", r"(?U)^\s*[-|─—\s]{4,}\s*$"


def is_dash(line: Column) -> Column:
    return line.rlike(DASH)


def is_pipe(line: Column) -> Column:
    return line.rlike(PIPE) & ~is_dash(line)


def _trim(x: Column) -> Column:
    return F.trim(x)  # a function of one argument: ``transform`` would hand the index to a second one


def _laid_out(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __lines, __runs): the lines of each text that may hold a table, and where its tables are; rows stay where they lie.

    One letter per line (p pipe row, d dash line, o other) makes a word in which
    a run is ``p[pd]*``; it counts with two pipe rows or more.
    """
    t = df.where(F.col(text).contains("|")).select(key, F.split(text, "\n").alias("__lines"))
    letter = lambda x: F.when(is_dash(x), "d").when(x.rlike(PIPE), "p").otherwise("o")
    t = t.withColumn("__kinds", F.array_join(F.transform("__lines", letter), ""))
    return t.withColumn("__runs", F.expr("""aggregate(
        zip_with(regexp_extract_all(__kinds, '([^p]*)p[pd]*', 1), regexp_extract_all(__kinds, '[^p]*(p[pd]*)', 1),
            (g, b) -> named_struct('gap', length(g), 'size', length(b), 'n', length(replace(b, 'd', '')))),
        named_struct('at', 0, 'runs', cast(array() as array<struct<first_line:int,last_line:int,n_rows:bigint>>)),
        (a, x) -> named_struct('at', a.at + x.gap + x.size, 'runs', if(x.n >= 2,
            array_append(a.runs, named_struct('first_line', a.at + x.gap, 'last_line', a.at + x.gap + x.size - 1, 'n_rows', bigint(x.n))), a.runs)),
        a -> a.runs)""")).drop("__kinds")  # fmt: skip


def runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_line, last_line, n_rows): table runs of each text.

    A run begins at a pipe row and goes on over pipe and dash lines; it counts
    with two pipe rows or more.  Null and empty texts have none.
    """
    return _laid_out(df, key, text).select(key, F.inline("__runs"))


def cells(line: Column) -> Column:
    """Cells of a pipe row: blanks collapsed, wholly empty parts dropped, empty cells at the end dropped."""
    parts = F.filter(F.split(line, r"\|"), lambda x: x != "")
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    last = F.aggregate(F.transform(clean, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(clean, 1, last)


def sentence(header: Column, row: Column) -> Column:
    """A table row as a sentence; null if it holds nothing.

    An empty heading becomes ``row_name`` for the first column and ``more info``
    for others; empty cells and cells beyond the header say nothing.
    """
    n = F.least(F.size(header), F.size(row))
    at = F.sequence(F.lit(0), n - 1)
    said = F.transform(
        at,
        lambda i: F.when(
            F.get(row, i) != "",
            F.concat(F.when(F.get(header, i) != "", F.get(header, i)).when(i == 0, "row_name").otherwise("more info"), F.lit(" is "), F.get(row, i)),
        ),
    )
    said = F.when(n > 0, F.filter(said, lambda x: x.isNotNull()))
    return F.when(F.size(said) > 0, F.concat(F.lit("In this row: "), F.array_join(said, ", "), F.lit(".")))


def _rows_of(run: Column, lines: Column) -> Column:
    """Cells of the pipe rows of a run, the header first."""
    inside = F.slice(lines, run["first_line"] + 1, run["last_line"] - run["first_line"] + 1)
    return F.transform(F.filter(inside, lambda x: x.rlike(PIPE) & ~is_dash(x)), cells)


def _tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __lines, first_line, __rows): one row per table."""
    t = _laid_out(df, key, text).select(key, "__lines", F.explode("__runs").alias("__run"))
    return t.select(key, "__lines", "__run.first_line", _rows_of(F.col("__run"), F.col("__lines")).alias("__rows"))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_line, row_no, header, said): the data rows of every table as sentences."""
    t = _tables(df, key, text).select(key, "first_line", F.get("__rows", F.lit(0)).alias("__header"), F.posexplode("__rows").alias("row_no", "__row"))
    out = t.where("row_no > 0").select(key, "first_line", "row_no", F.array_join("__header", " | ").alias("header"), sentence(F.col("__header"), F.col("__row")).alias("said"))
    return out.where("said is not null")


def page_of_line(lines: Column, line_no: Column) -> Column:
    """The page a line stands on: the number of the last page mark above it, 1 without any."""
    above = F.filter(F.slice(lines, F.lit(1), line_no + 1), lambda x: x.rlike(MARK))
    return F.when(F.size(above) > 0, F.regexp_extract(F.element_at(above, -1), MARK, 1).try_cast("int")).otherwise(F.lit(1))


def _chunks_of(rows: Column, max_words: int) -> Column:
    """The chunks of a table: its sentences packed whole, each chunk under the repeated caption.

    A sentence that does not fit begins the next chunk, a single one over the
    size stands alone.  A table without any sentence has none.
    """
    header = F.get(rows, F.lit(0))
    caption = F.concat(F.lit("Table: "), F.array_join(header, " | "))
    room = F.greatest(F.lit(1), F.lit(max_words) - F.size(words(caption)))
    said = F.filter(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: sentence(header, r)), lambda x: x.isNotNull())
    state = lambda done, open_, n: F.struct(done.alias("done"), open_.alias("open"), n.alias("n"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(words(x))
        fits = (a["open"] == "") | (a["n"] + n <= room)
        return F.when(fits, state(a["done"], F.when(a["open"] == "", x).otherwise(F.concat(a["open"], F.lit(" "), x)), a["n"] + n)).otherwise(state(F.array_append(a["done"], a["open"]), x, n))

    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    bodies = F.aggregate(said, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return F.transform(bodies, lambda b: F.concat(caption, F.lit("\n"), b))


def table_chunks(df: DataFrame, key: str, text: str, max_words: int = 250) -> DataFrame:
    """(key, first_line, page, chunk_no, chunk_text): the chunks of every table, with the page its first line stands on."""
    t = _tables(df, key, text).withColumn("page", page_of_line(F.col("__lines"), F.col("first_line")))
    return t.select(key, "first_line", "page", F.posexplode(_chunks_of(F.col("__rows"), max_words)).alias("chunk_no", "chunk_text"))


def prose_of(text: Column, lines: Column, runs: Column) -> Column:
    """A text without the lines of its tables."""
    kept = F.filter(lines, lambda x, i: ~F.exists(runs, lambda r: (i >= r["first_line"]) & (i <= r["last_line"])))
    return F.when(F.size(F.coalesce(runs, F.array())) > 0, F.array_join(kept, "\n")).otherwise(text)


def prose(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, prose_text): each text without the lines of its tables; rows stay where they lie, a text of tables alone gives none."""
    t = _laid_out(df, key, text)
    inside = F.aggregate("__runs", F.lit(0), lambda a, r: a + r["last_line"] - r["first_line"] + 1)
    t = t.where(inside < F.size("__lines")).select(key, prose_of(F.array_join("__lines", "\n"), F.col("__lines"), F.col("__runs")).alias("prose_text"))
    return df.where(~F.col(text).contains("|")).select(key, F.col(text).alias("prose_text")).unionByName(t)


def pieces(df: DataFrame, key: str, text: str, size: int = 250, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, content_type, page_start, page_end, chunk_text): the stored form of a text.

    Its pages without tables in windows of words first, then the chunks of its
    tables in order, numbered through.  Text and tables above the first page
    mark belong to no page and are left out.  Every text is worked on in its own
    row; nothing is shuffled.  Null texts and texts without words give no rows.
    """
    t = df.where(F.col(text).isNotNull()).withColumn("__text", F.col(text))
    plain = t.where(~F.col(text).contains("|")).select(key, F.col("__text").alias("__prose"), F.expr("cast(array() as array<struct<page:int,chunks:array<string>>>)").alias("__tables"))
    laid = _laid_out(t, key, text)
    said = lambda run, lines: _chunks_of(_rows_of(run, lines), size)
    marked = F.exists("__lines", lambda x: x.rlike(MARK))
    placed = lambda r: ~marked | F.exists(F.slice("__lines", F.lit(1), r["first_line"] + 1), lambda x: x.rlike(MARK))
    tabled = F.transform(F.filter("__runs", placed), lambda r: F.struct(page_of_line(F.col("__lines"), r["first_line"]).alias("page"), said(r, F.col("__lines")).alias("chunks")))
    laid = laid.select(key, prose_of(F.array_join("__lines", "\n"), F.col("__lines"), F.col("__runs")).alias("__prose"), tabled.alias("__tables"))
    both = plain.unionByName(laid)
    piece = lambda kind, a, b, x: F.struct(F.lit(kind).alias("content_type"), a.alias("page_start"), b.alias("page_end"), x.alias("chunk_text"))
    windows = F.transform(window_array(F.col("__prose"), size, overlap), lambda w: piece("text", w["page_start"], w["page_end"], w["chunk_text"]))
    chunks = F.flatten(F.transform("__tables", lambda t: F.transform(t["chunks"], lambda c: piece("table", t["page"], t["page"], c))))
    return both.select(key, F.posexplode(F.concat(windows, chunks)).alias("chunk_index", "__p")).select(key, "chunk_index", "__p.*")


def _filled(cell: Column) -> Column:
    return F.coalesce(F.trim(cell), F.lit("")) != ""


def _wordy(cell: Column) -> Column:
    """A long single word of letters only: a torn piece of prose."""
    c = F.trim(cell)
    return c.rlike(r"^\p{L}{9,}$")


def _has_digit(cell: Column) -> Column:
    return cell.rlike(r"\p{Nd}")


def looks_real(rows: Column) -> Column:
    """Whether extracted rows (arrays of cells) are a data table.

    It has 2 to 20 columns, at least four filled cells and two well filled
    rows, numbers in 30 % of the cells, and few long, huge or wordy ones.
    """
    flat = F.transform(F.filter(F.flatten(rows), _filled), _trim)
    n = F.size(flat)
    share = lambda p: F.size(F.filter(flat, p)) / n
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    solid = lambda r: F.size(F.filter(r, lambda c: F.length(F.trim(c)) > 1))
    substantial = F.size(F.filter(rows, lambda r: (solid(r) >= 2) & (solid(r) >= F.lit(0.4) * width)))
    return F.coalesce(
        (F.size(rows) >= 2) & width.between(2, 20) & (n >= 4) & (substantial >= 2) & (share(_has_digit) >= 0.30)
        & (share(lambda c: F.length(c) > 30) <= 0.35) & (F.array_max(F.transform(flat, lambda x: F.length(x))) <= 80) & (share(_wordy) <= 0.15),
        F.lit(False),
    )


def _joined(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.array_join(F.filter(F.array(F.trim(x), F.trim(y)), lambda c: F.coalesce(c, F.lit("")) != ""), " "))


def _with_first_two_merged(rows: Column) -> Column:
    return F.concat(F.array(_joined(F.element_at(rows, 1), F.element_at(rows, 2))), F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))))


def merge_gapped_header(rows: Column) -> Column:
    """A header over two rows becomes one, if the first has gaps and the second words but no digits."""
    a, b = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    split = (F.size(rows) >= 3) & F.exists(a, lambda c: ~_filled(c)) & F.exists(b, _filled) & ~F.exists(b, lambda c: F.coalesce(_has_digit(c), F.lit(False)))
    return F.when(split, _with_first_two_merged(rows)).otherwise(rows)


def merge_sparse_header(rows: Column) -> Column:
    """The same, if 40 % of the first row is empty and less than 40 % of the second has digits."""
    a, b = F.get(rows, F.lit(0)), F.filter(F.get(rows, F.lit(1)), _filled)
    sparse = (F.size(rows) >= 3) & (F.size(F.filter(a, lambda c: ~_filled(c))) >= F.lit(0.4) * F.size(a)) & (F.size(b) > 0) & (F.size(F.filter(b, _has_digit)) < F.lit(0.4) * F.size(b))
    return F.when(sparse, _with_first_two_merged(rows)).otherwise(rows)


def is_data_row(row: Column) -> Column:
    return F.exists(row, lambda c: F.coalesce(_has_digit(c), F.lit(False))) & ~F.exists(row, lambda c: F.coalesce(_wordy(c), F.lit(False)))


def strip_caption(rows: Column) -> Column:
    """Rows above the one before the first data row are caption and go."""
    first = F.array_position(F.transform(rows, is_data_row), True).cast("int")
    return F.when(first > 1, F.slice(rows, first - 1, F.size(rows))).otherwise(rows)


def drop_prose_rows(rows: Column) -> Column:
    """The header and the data rows after it."""
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), is_data_row)
    return F.when(F.size(rows) >= 2, F.concat(F.slice(rows, 1, 1), body)).otherwise(rows)


def fold_subscripts(rows: Column) -> Column:
    """Cells of two lines with as many words, short ones below, read as base_subscript; other line breaks become blanks."""

    def fold(cell: Column) -> Column:
        return F.when(~cell.contains("\n"), cell).otherwise(bound(F.filter(F.transform(F.split(cell, "\n"), _trim), lambda x: x != ""), lambda parts: joined(cell, parts)))

    def joined(cell: Column, parts: Column) -> Column:
        top, low = words(F.get(parts, F.lit(0))), words(F.get(parts, F.lit(1)))
        paired = (F.size(parts) == 2) & (F.size(top) == F.size(low)) & F.forall(low, lambda w: F.length(w) <= 6)
        return F.when(paired, F.array_join(F.zip_with(top, low, lambda a, b: F.concat(a, F.lit("_"), b)), " ")).otherwise(F.array_join(words(cell), " "))

    return F.transform(rows, lambda r: F.transform(r, fold))


def clean_rows(rows: Column) -> Column:
    """All of these in turn; each step's outcome is computed once."""
    for step in (fold_subscripts, merge_gapped_header, strip_caption, merge_sparse_header, drop_prose_rows):
        rows = bound(rows, step)
    return rows


def signature(rows: Column) -> Column:
    """The first 12 of the sorted filled cells: equal for the same table found twice."""
    return F.slice(F.array_sort(F.transform(F.filter(F.flatten(rows), _filled), _trim)), 1, 12)


def caption(page: Column, label: Column) -> Column:
    """The caption of a numbered table from its page: the line that begins with the label, and up to five lines that continue it.

    An empty line, the next caption or a line of mostly numbers ends it; a word
    broken by a hyphen is joined; at most 500 characters.  Without such a line
    the label itself.
    """
    number = F.regexp_extract(label, r"Table\s*(\d+)", 1)
    lines = F.transform(F.split(page, "\n"), _trim)
    at = lambda p: F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.concat(F.lit(r"^Table\s*"), number, F.lit(p)))), True)
    start = F.when(at(r"\s*:") > 0, at(r"\s*:")).otherwise(at(r"\b")).cast("int")
    numeric = lambda x: F.size(F.filter(words(x), _has_digit)) * 2 > F.size(words(x))
    after = F.slice(lines, start + 1, F.lit(5))
    ends = F.transform(after, lambda x: (x == "") | x.rlike(r"^(Table|Figure)\s*\d") | numeric(x))
    n = F.when(F.array_position(ends, True) > 0, F.array_position(ends, True) - 1).otherwise(F.size(after)).cast("int")
    parts = F.concat(F.slice(lines, start, F.lit(1)), F.slice(after, 1, n))
    joined = F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x)))
    return F.when((number != "") & (start > 0), F.substring(F.array_join(words(joined), " "), 1, 500)).otherwise(F.trim(label))


def without_markdown_tables(text: Column) -> Column:
    """A text without its markdown tables: a line with a bar, a separator line of bars, dashes and colons under it, and the lines with bars that follow."""
    lines = F.split(text, "\n")
    # One letter a line: s separator, b bar, o other. A table is ``[bs]s[bs]*``.
    letter = lambda x: F.when(~x.contains("|"), "o").when(x.rlike(r"^[\s|:\- ]*$"), "s").otherwise("b")

    def kept(all_: Column) -> Column:
        kinds = F.array_join(F.transform(all_, letter), "")
        marks = F.split(F.regexp_replace(F.regexp_replace(kinds, "[bs]s[bs]*", "<$0>"), "", " "), " ")
        depth = F.aggregate(
            F.filter(marks, lambda m: m != ""), F.struct(F.lit(False).alias("inside"), F.array().cast("array<boolean>").alias("out")),
            lambda a, m: F.when(m == "<", F.struct(F.lit(True).alias("inside"), a["out"].alias("out"))).when(m == ">", F.struct(F.lit(False).alias("inside"), a["out"].alias("out")))
            .otherwise(F.struct(a["inside"].alias("inside"), F.array_append(a["out"], a["inside"]).alias("out"))), lambda a: a["out"],
        )
        return F.array_join(F.filter(all_, lambda x, i: ~F.get(depth, i)), "\n")

    return bound(lines, kept)


def first_of_equal(df: DataFrame, rows: str, within: list[str], order: list[str]) -> DataFrame:
    """``df`` with the first by ``order`` of tables of equal ``signature`` in each group ``within``; empty signatures are all kept."""
    sign = df.withColumn("__s", signature(F.col(rows)))
    key = F.struct(*order)
    first = sign.groupBy(*within, "__s").agg(F.min(key).alias("__first"))
    met = sign.join(first, [*within, "__s"]).where((F.size("__s") == 0) | (key == F.col("__first")))
    return met.drop("__s", "__first")


def rows_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_line, rows): every table of a text as its rows of cells, the header first."""
    return _tables(df, key, text).select(key, "first_line", F.col("__rows").alias("rows"))
