"""Column functions that mend what a reader of pages leaves: cell texts, split numbers, cells under the wrong header, candidates
that are no tables; and small structs of answers and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scrambled populations and ages, and what they are rewritten to.
ORDER_REPAIRS = [
    (r"([0-9]+)\s*万\s*\.\s*([0-9]+)\s*人\s*([0-9]+)", "$1.$2$3万人"),
    (r"万\s*([0-9]+)\s*\.\s*([0-9]+)\s*人", "$1.$2万人"),
    (r"([0-9]+)\s*万\s*([0-9]+)\s*\.\s*人\s*([0-9]+)", "$1$2.$3万人"),
    (r"岁\s*([0-9]+)\s*以下", "$1岁以下"),
    (r"([0-9]+)\s*-\s*岁\s*([0-9]+)", "$1-$2岁"),
]
#: A number piece, a page mark, and dots that lead to a page number.
NUMBER_PIECE, PAGE_MARK, DOT_LEADER = r"^[0-9\s\-\.\,/\(\)%～—]+$", r"^[0-9\s—\-－]+$", r"[.．·]{4,}"
#: Rows, columns and share of leader cells of a table candidate; characters of a number piece and of the mended number.
ROWS, COLUMNS, LEADERS, PIECE, MENDED = (2, 300), (2, 40), 0.2, 3, 6


def reordered(text: Column) -> Column:
    for pattern, value in ORDER_REPAIRS:
        text = F.regexp_replace(text, pattern, value)
    return text


def cell_text(text: Column) -> Column:
    """A cell without blanks inside Chinese text and numbers with units, marks back in place, then ``reordered``."""
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r"(?<=[一-鿿])\s+(?=[一-鿿])", "")
    text = F.regexp_replace(text, r"(?<=[0-9])\s+(?=[一-鿿%％])|(?<=[一-鿿])\s+(?=[0-9])", "")
    text = F.regexp_replace(text, r"\s+([，。；：、,.!?;:%％）)])", "$1")
    text = F.regexp_replace(text, r"([（(])\s+", "$1")
    text = F.regexp_replace(text, r"([%％])([一-鿿])。", "$1。$2")
    text = F.regexp_replace(text, r"([。；])([一-鿿][^。；]*?)([0-9]{1,2}[.．])。$", "$1$3$2。")
    return F.trim(reordered(text))


def merged_numbers(lines: Column) -> Column:
    """Lines of tab-parted cells; a line of short number pieces only is joined to the one before, cell by cell, where it has as many cells and the numbers stay short."""
    pieces = lambda line: F.split(line, "\t", -1)

    def fits(last: Column, line: Column) -> Column:
        own, before = pieces(line), pieces(last)
        short = F.forall(own, lambda c: F.trim(c).rlike(NUMBER_PIECE) & (F.length(F.trim(c)) <= PIECE))
        lengths = F.zip_with(before, own, lambda a, b: F.length(F.trim(a)) + F.length(F.trim(b)))
        return (last != "") & (F.size(own) == F.size(before)) & short & F.forall(lengths, lambda n: n <= MENDED)

    def add(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.array_join(F.zip_with(pieces(last), pieces(line), lambda a, b: F.concat(F.rtrim(a), F.trim(b))), "\t")
        push = F.concat(done, F.array(line))
        return F.when(F.size(done) == 0, push).when(fits(last, line), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(push)

    return F.aggregate(lines, F.array().cast("array<string>"), add)


def field_by_header(headers: Column, cells: Column, pattern: str) -> Column:
    """The first cell that isn't blank under a header that fits the pattern, trimmed; else null."""
    both = F.arrays_zip(headers.alias("h"), cells.alias("c"))
    hit = F.filter(both, lambda x: F.coalesce(x["h"].rlike(pattern) & (F.trim(x["c"]) != ""), F.lit(False)))
    return F.trim(F.get(hit, F.lit(0))["c"])


def is_page_fragment(cell: Column) -> Column:
    """One to four digits with a dash before or after them: the rest of a page number."""
    plain = F.trim(cell)
    digits = F.length(F.regexp_replace(plain, "[^0-9]", ""))
    return plain.rlike(PAGE_MARK) & digits.between(1, 4) & plain.rlike(r"^[—\-－]|[—\-－]$")


def cells_of_columns(keys: Column, values: Column, columns: Column) -> Column:
    """Array of (column, cell): each column's cell by its header without ``#n``, else by place; then fields that no column
    names. Cells that are rests of page numbers are left out. Keys are distinct."""
    fields = F.map_from_arrays(keys, values)
    base = lambda c: F.regexp_replace(c, "#[0-9]+$", "")
    pair = lambda k, v: F.struct(k.alias("column"), v.alias("cell"))
    placed = F.transform(columns, lambda c, i: pair(c, F.coalesce(F.try_element_at(fields, base(c)), F.get(values, i))))
    bases = F.transform(columns, base)
    rest = F.transform(F.filter(keys, lambda k: ~F.array_contains(bases, k)), lambda k: pair(k, F.try_element_at(fields, k)))
    # a field whose key is some column's full name overrides what the column got
    names = F.transform(rest, lambda x: x["column"])
    both = F.concat(F.filter(placed, lambda x: ~F.array_contains(names, x["column"])), rest)
    return F.filter(both, lambda x: F.coalesce(~is_page_fragment(x["cell"]), F.lit(False)))


def effective_columns(rows: Column) -> Column:
    """How many columns have two cells or more that aren't blank."""
    widest = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    places = F.when(widest > 0, F.sequence(F.lit(0), widest - 1)).otherwise(F.array().cast("array<int>"))
    filled = lambda i: F.size(F.filter(rows, lambda r: F.trim(F.coalesce(F.get(r, i), F.lit(""))) != ""))
    return F.size(F.filter(places, lambda i: filled(i) >= 2))


def is_candidate(rows: Column) -> Column:
    """Whether rows have the shape of a table: rows and columns within bounds, two effective columns, and no table of contents."""
    widest = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    cells = F.filter(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    leaders = F.size(F.filter(cells, lambda c: c.rlike(DOT_LEADER)))
    contents = (F.size(cells) > 0) & (leaders >= LEADERS * F.size(cells))
    return F.size(rows).between(*ROWS) & widest.between(*COLUMNS) & (effective_columns(rows) >= 2) & ~contents


def table_blocks(title: Column, headers: Column, rows: Column) -> Column:
    """Array of blocks (type, raw, text): the table in Markdown, with its title before it, and one block a row."""

    def mark(cell: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\|", r"\\\|"))
        return F.when(plain == "", " ").otherwise(plain)

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    body = F.transform(rows, lambda r: line(F.transform(headers, lambda _, i: mark(F.get(r, i)))))
    ruled = line(F.transform(headers, lambda _: F.lit("---")))
    text = F.array_join(F.concat(F.array(line(F.transform(headers, mark)), ruled), body), "\n")
    block = lambda kind, raw, normal: F.struct(F.lit(kind).alias("type"), raw.alias("raw"), normal.alias("text"))
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n"), text)).otherwise(text)
    own = F.transform(rows, lambda r: block("table_row", F.array_join(r, "\t", ""), F.array_join(F.filter(r, lambda c: c != ""), " ")))
    return F.concat(F.array(block("table", text, titled)), own)


def object_text(title: Column, content: Column, headers: Column, cells: Column) -> Column:
    """Title, content and ``header：cell`` of each field, parted by blanks; empty parts are left out."""
    fields = F.zip_with(headers, cells, lambda h, c: F.concat(h, F.lit("："), c))
    return F.array_join(F.filter(F.concat(F.array(title, content), F.coalesce(fields, F.array())), lambda x: x != ""), " ")


def answer_diagnostics(raw: Column, clean: Column, shown: Column, reasons: Column) -> Column:
    """Struct of the trimmed conclusions, the reasons and whether the display replaced a conclusion; null where nothing happened."""
    raw, clean, shown = F.trim(raw), F.trim(clean), F.trim(shown)
    replaced = (clean != "") & (clean != shown)
    told = F.struct(raw.alias("raw"), clean.alias("clean"), shown.alias("shown"), reasons.alias("reasons"), replaced.alias("replaced"))
    return F.when((raw != "") | replaced | (F.size(reasons) > 0), told)


def evaluation_account(user: Column) -> Column:
    """The trimmed account of a question, or null for the default one."""
    return F.nullif(F.trim(user), F.lit(""))
