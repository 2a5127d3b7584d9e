"""Problem 1: loading delimited lines and setting apart those that do not parse.

Every record is parsed at minimum cost by a dynamic program over the tokens of its line (quotes, delimiters, runs of
spaces, words). It may insert quotes and delimiters between tokens and delete them, each at cost one, and keep an
invalid value at cost one. A path of cost zero is the plain grammar: delimiters outside quotes separate fields, a field
that begins with the quote character ends at the next one that isn't doubled, and there is one valid value per column.
Such records load; of the others the operations of the cheapest parse state the reason:

    quote edits → 'quoting', delimiter edits → 'column count', none → 'value'

Most lines hold the right number of fields and only plain valid values: for these the path of cost zero is plain to see
and is taken by built-in expressions. Only the rest reaches Python. Lines are independent: one narrow stage, no
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.sources.tables import table

NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", re.ASCII)


@dataclass(frozen=True)
class Field:
    name: str
    role: str
    value_type: str
    low: float | None
    high: float | None
    levels: frozenset[str]


@dataclass(frozen=True)
class Layout:
    """How lines of one data set are written."""

    delimiter: str
    quote: str | None
    comment: str | None
    missing: frozenset[str]  # lower case
    columns: tuple[Field, ...] = field(default=())

    def is_record(self, line: str | None) -> bool:
        return bool(line) and not line.isspace() and not (self.comment and line.startswith(self.comment))

    def value(self, column: Field, text: str) -> tuple[bool, str | None]:
        """(valid, value): a missing value is valid and gives None."""
        text = text.strip()
        if column.role == "target":
            text = text.rstrip(".")
        if not text.strip() or text.lower() in self.missing:
            return True, None
        if column.role != "numeric":
            return text in column.levels, text
        if not NUMBER.fullmatch(text):
            return False, text
        number = float(text)
        inside = (column.low is None or number >= column.low) and (column.high is None or number <= column.high)
        return inside and (column.value_type != "int" or number.is_integer()), text


def _tokens(line: str, layout: Layout) -> list[str]:
    marks = "|".join(re.escape(m) for m in (layout.delimiter, layout.quote) if m)
    return [t for t in re.split(f"({marks}| +)", line) if t]


# A state is (column, mode): before a field, in an unquoted field, in a quoted one, after a closing quote, and in an
# unquoted field that has taken a delimiter as text.
START, OPEN, QUOTED, CLOSED, LITERAL = range(5)
_BEGUN = re.compile(r"[+-]?(?:[0-9]+(?:\.(?:[0-9]+(?:[eE][+-]?[0-9]*)?)?|[eE][+-]?[0-9]*)?)?\s*", re.ASCII)


class Residues:
    """What of a field's text so far can matter for its validity: the text itself while it may still become valid, else nothing."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.known: dict[tuple[int, str], str | None] = {}
        self.starts = []
        for c in layout.columns:
            words = {m for m in layout.missing} | {w.lower() for w in (() if c.role == "numeric" else c.levels)}
            self.starts.append(frozenset(w[:i] for w in words for i in range(len(w) + 1)))

    def of(self, column: int, text: str) -> str | None:
        known = self.known.get((column, text), 0)
        if known == 0:
            c = self.layout.columns[column]
            left = text.lstrip()
            bare = left.rstrip()
            dots = bare.rstrip(".") if c.role == "target" else bare
            begun = self.starts[column]
            alive = left.lower() in begun or bare.lower() in begun or dots.lower() in begun or self.layout.value(c, text)[0]
            known = left if alive or (c.role == "numeric" and _BEGUN.fullmatch(left)) else None
            if len(self.known) < 50_000:
                self.known[column, text] = known
        return known


# A path: (cost, edits, text of the field so far, its residue, (operation, before), (field, before)).
_Path = tuple


def cheapest_parse(line: str, layout: Layout, residues: Residues | None = None) -> tuple[int, list[str], list[str]]:
    """(cost, operations, fields) of a parse with exactly one field per column; no parse costs less.

    The bound on the cost is raised step by step, so that the usual line, none, one or two edits away from a good one,
    never carries dearer paths along. Some parse always exists: everything may be deleted.
    """
    tokens = _tokens(line, layout)
    residues = residues or Residues(layout)
    bound = 0
    while (found := _parse_within(tokens, layout, bound, residues)) is None:
        bound = bound + 1 if bound < 4 else 2 * bound
    return found


def _parse_within(tokens: list[str], layout: Layout, bound: int, residues: Residues) -> tuple[int, list[str], list[str]] | None:
    """The cheapest parse of cost up to `bound`, or None.

    The text of a field changes what the rest of a path costs by at most one: its value is valid or not. So a path
    dearer than another of its state is never needed, and of equally dear ones one per residue is; of these the one
    with fewer edits is kept, then the one found first.
    """
    columns, delimiter, quote = layout.columns, layout.delimiter, layout.quote
    last = len(columns) - 1
    front: dict[tuple[int, int], dict[str | None, _Path]] = {(0, START): {"": (0, 0, "", "", None, None)}}

    def offer(into: dict, state: tuple[int, int], path: _Path) -> None:
        cost = path[0]
        if cost > bound:
            return
        known = into.get(state)
        if known is None:
            into[state] = {path[3]: path}
            return
        best = next(iter(known.values()))[0]
        if cost > best:
            return
        if cost < best:
            known.clear()
        same = known.get(path[3])
        if same is None or path[1] < same[1]:
            known[path[3]] = path

    def paths(states: dict) -> list:
        return [(j, mode, path) for (j, mode), kept in states.items() for path in kept.values()]

    def close(column: int, path: _Path) -> _Path:
        cost, edits, text, _, ops, fields = path
        text = text.strip(" ")
        bad = not layout.value(columns[column], text)[0]
        return (cost + bad, edits, "", "", (f"value {columns[column].name}", ops) if bad else ops, (text, fields))

    def edited(path: _Path, what: str) -> _Path:
        return (path[0] + 1, path[1] + 1, path[2], path[3], (what, path[4]), path[5])

    def add(column: int, path: _Path, text: str) -> _Path:
        whole = path[2] + text
        return (path[0], path[1], whole, None if path[3] is None else residues.of(column, whole), path[4], path[5])

    def inserts(states: dict) -> dict:
        """States reached by inserting quotes or delimiters here."""
        if bound == 0:
            return states
        out = {k: dict(v) for k, v in states.items()}
        for j, mode, path in paths(states):
            if quote and path[0] < bound:
                if mode == START:
                    offer(out, (j, QUOTED), edited(path, "insert quote"))
                elif mode == QUOTED:
                    offer(out, (j, CLOSED), edited(path, "insert quote"))
        for column in range(last):  # several in a row leave empty fields
            for mode in (START, OPEN, CLOSED, LITERAL):
                for path in list(out.get((column, mode), {}).values()):
                    if path[0] < bound:
                        offer(out, (column + 1, START), edited(close(column, path), "insert delimiter"))
        return out

    for at, token in enumerate(tokens):
        new: dict = {}
        for j, mode, path in paths(inserts(front)):
            if token == quote:
                if mode == START:
                    offer(new, (j, QUOTED), path)
                elif mode == QUOTED:
                    offer(new, (j, CLOSED), path)
                elif mode == CLOSED and at and tokens[at - 1] == quote:
                    offer(new, (j, QUOTED), add(j, path, quote))  # doubled
                offer(new, (j, mode), edited(path, "delete quote"))
            elif token == delimiter:
                if mode == QUOTED:
                    offer(new, (j, QUOTED), add(j, path, token))
                else:
                    if j < last:
                        offer(new, (j + 1, START), close(j, path))
                    offer(new, (j, mode), edited(path, "delete delimiter"))
                    if mode != CLOSED and path[0] < bound:
                        offer(new, (j, LITERAL), edited(add(j, path, token), "delete delimiter"))
            elif mode in (START, CLOSED) and token[0] == " " and not token.strip(" "):
                offer(new, (j, mode), path)
            elif mode == START:
                offer(new, (j, OPEN), add(j, path, token))
            elif mode == CLOSED:  # the quotes before didn't close a field
                if path[0] < bound:
                    offer(new, (j, OPEN), edited(add(j, path, token), "delete quote"))
            else:
                offer(new, (j, mode), add(j, path, token))
        front = new
        if not front:
            return None
    ends: dict = {}
    for j, mode, path in paths(inserts(front)):
        if mode != QUOTED:
            offer(ends, (j, CLOSED), close(j, path))
    if (last, CLOSED) not in ends:
        return None
    cost, _, _, _, ops, fields = min(ends[last, CLOSED].values(), key=lambda p: p[:2])

    def chain(link) -> list[str]:
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return out[::-1]

    return cost, chain(ops), chain(fields)


def read_line(line: str, layout: Layout | None, residues: Residues | None = None) -> tuple[str | None, int, list[str], list[str | None]]:
    """(reason or None, cost, operations, values) of one record."""
    if layout is None or not layout.columns:
        return "column count", 1, ["no layout"], []
    cost, ops, fields = cheapest_parse(line, layout, residues)
    values = [layout.value(c, f)[1] for c, f in zip(layout.columns, fields, strict=True)]
    if not cost:
        return None, 0, [], values
    if any(op.endswith("quote") for op in ops):
        return "quoting", cost, ops, values
    return ("column count" if any(op.endswith("delimiter") for op in ops) else "value"), cost, ops, values


def _literal(text: str) -> str:
    """`text` itself as a pattern of Java and Python."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def plain_pattern(layout: Layout) -> str | None:
    """A pattern of lines whose path of cost zero is plain to see: the right number of fields, quoted or not, that hold
    only words of the layout, numbers and blanks. Bounds of numbers are left to be checked. It may miss some lines,
    never accept another. Each field is a group, with the quotes it may have."""
    delimiter, quote = layout.delimiter, layout.quote

    def words(c: Field, *without: str | None) -> str:
        known = [w for w in sorted(c.levels) if w and w == w.strip() and not w.endswith(".")]
        known = [_literal(w) for w in known if not any(m and m in w for m in without)] if c.role != "numeric" else [NUMBER.pattern]
        missing = [_literal(m) for m in sorted(layout.missing) if m and m.isascii() and m == m.strip() and not m.endswith(".") and not any(x and x in m for x in without)]
        return "(?:" + "|".join(["", "(?i:" + "|".join(missing) + ")", *known]) + ")" + (r"\.*" if c.role == "target" else "")

    pad = "" if delimiter == " " else " *"
    fields = []
    for c in layout.columns:
        within = f"{_literal(quote)} *{words(c, quote)} *{_literal(quote)}|" if quote else ""
        fields.append(f"{pad}({within}{words(c, delimiter, quote)}){pad}")
    comment = f"(?!{_literal(layout.comment)})" if layout.comment else ""
    return "^" + comment + r"(?!\s*$)" + _literal(delimiter).join(fields) + r"\z" if fields else None


def _texts(layout: Layout, line: Column) -> list[Column]:
    """The trimmed fields of a line matched by `plain_pattern`, without quotes."""
    out, pattern = [], plain_pattern(layout)
    for i, c in enumerate(layout.columns):
        text = F.trim(F.substring_index(F.substring_index(line, layout.delimiter, i + 1), layout.delimiter, -1))
        if layout.quote:
            text = F.when(F.contains(line, F.lit(layout.quote)), F.btrim(F.regexp_extract(line, pattern, i + 1), F.lit(" " + layout.quote))).otherwise(text)
        out.append(F.rtrim(text, F.lit(".")) if c.role == "target" else text)
    return out


def plain(known: dict[str, Layout], line: Column, dataset: Column) -> Column:
    """Whether a line surely loads, by its look alone; never NULL. Each text is evaluated once: a lambda holds it."""

    def outside(c: Field):
        def test(v: Column) -> Column:
            bad = F.abs(v) == float("inf")
            bad = bad | (v < F.lit(c.low)) if c.low is not None else bad
            bad = bad | (v > F.lit(c.high)) if c.high is not None else bad
            return bad | (v % F.lit(1.0) != 0) if c.value_type == "int" else bad

        return test

    out = F.lit(False)
    for name, layout in known.items():
        pattern = plain_pattern(layout)
        if pattern is None:
            continue
        fine = (dataset == name) & line.rlike(pattern)
        for c, text in zip(layout.columns, _texts(layout, line), strict=True):
            if c.role == "numeric":  # words for missing values are no numbers and have no bounds
                fine = fine & ~F.coalesce(F.exists(F.array(text.try_cast("double")), outside(c)), F.lit(False))
        out = out | fine
    return F.coalesce(out, F.lit(False))


def _unless_missing(layout: Layout):
    return lambda t: F.when(~((F.trim(t) == "") | F.lower(t).isin(sorted(layout.missing))), t)


def plain_values(known: dict[str, Layout], line: Column, dataset: Column) -> Column:
    """Values of a line that is `plain`, NULL where missing."""
    out = F.lit(None).cast("array<string>")
    for name, layout in known.items():
        if layout.columns:
            out = F.when(dataset == name, F.transform(F.array(*_texts(layout, line)), _unless_missing(layout))).otherwise(out)
    return out


def layouts(specs: DataFrame, columns: DataFrame) -> dict[str, Layout]:
    """Layouts by data set, from the fixed tables dataset_spec and dataset_columns (3 and 13 rows)."""
    by: dict[str, list] = {}
    for r in columns.orderBy("dataset_id", "column_position").collect():
        by.setdefault(r["dataset_id"], []).append(Field(r["column_name"], r["column_role"], r["value_type"], r["min_value"], r["max_value"], frozenset(r["levels"] or ())))
    return {
        r["dataset_id"]: Layout(r["delimiter"] or ",", r["quote_char"] or None, r["comment_prefix"] or None, frozenset(m.strip().lower() for m in r["missing_markers"] or () if m is not None), tuple(by.get(r["dataset_id"], ())))
        for r in specs.collect()
    }


def parse_records(raw: DataFrame, known: dict[str, Layout]) -> DataFrame:
    """(line_id, dataset_id, member_file, reason, cost, operations, values): one row per record of `raw`.

    reason is NULL for rows that load; their values are by column position, NULL where missing. For the others the
    values are those of the cheapest parse. Blank and NULL lines and comments aren't records and give no row. Lines of
    a data set without layout come out with the reason 'column count'. Repeated lines are parsed as often as they come;
    an empty table gives no rows; a NULL line_id or member_file stays NULL.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        none = Layout(",", None, None, frozenset())
        residues = {name: Residues(layout) for name, layout in known.items()}
        for batch in batches:
            ids, sets, files, lines = (batch.column(i).to_pylist() for i in range(4))
            keep, out = [], []
            for i, (d, line) in enumerate(zip(sets, lines, strict=True)):
                layout = known.get(d)
                if (layout or none).is_record(line):
                    keep.append(i)
                    out.append(read_line(line, layout, residues.get(d)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in keep], pa.int64()), pa.array([sets[i] for i in keep], pa.string()), pa.array([files[i] for i in keep], pa.string()),
                    pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.string())), pa.array([o[3] for o in out], pa.list_(pa.string())),
                ],
                names=["line_id", "dataset_id", "member_file", "reason", "cost", "operations", "values"],
            )

    surely = plain(known, F.col("raw_line"), F.col("dataset_id"))
    narrow = raw.select(F.col("line_id").cast("bigint").alias("line_id"), "dataset_id", "member_file", "raw_line")
    nothing = [F.lit(None).cast("string").alias("reason"), F.lit(0).alias("cost"), F.array().cast("array<string>").alias("operations")]
    split = narrow.where(surely).select("line_id", "dataset_id", "member_file", *nothing, plain_values(known, F.col("raw_line"), F.col("dataset_id")).alias("values"))
    rest = narrow.where(~surely)
    return split.unionByName(rest.mapInArrow(run, "line_id bigint, dataset_id string, member_file string, reason string, cost int, operations array<string>, values array<string>"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_records", "line_id", "dataset_id", "member_file", "raw_line")
    return parse_records(raw, layouts(table(spark, sf_dir, "dataset_spec"), table(spark, sf_dir, "dataset_columns")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that don't parse."""
    return _records(spark, sf_dir).where("reason is not null").select("line_id").distinct()


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with reason, cost, edit operations and values."""
    return _records(spark, sf_dir)


def p1_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded and rejected rows per file against the reported number; `matches` is NULL where none is given."""
    sums = _records(spark, sf_dir).groupBy("dataset_id", "member_file").agg(F.count_if(F.col("reason").isNull()).alias("loaded"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    told = table(spark, sf_dir, "cleaning_report", "dataset_id", "member_file", "raw_rows").groupBy("dataset_id", "member_file").agg(F.max("raw_rows").alias("raw_rows"))
    both = sums.join(told, ["dataset_id", "member_file"], "full").na.fill(0, ["loaded", "rejected"])
    return both.withColumn("matches", F.col("loaded") + F.col("rejected") == F.col("raw_rows"))
