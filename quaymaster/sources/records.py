"""Records that may span lines, read in as many tasks as the file has splits.

A text file is read in splits, and where a split begins nobody knows whether a quote or
an array is open there. So each split is first scanned for every state in which it might begin; what
it does to a state is a small function, and these functions, put together in file order, tell the state in
which each split really begins (one small row per split). A second narrow pass then cuts the
records. Only a record that crosses a split boundary is put together by a shuffle, of its
own pieces alone; all other rows stay in the task that read them.

The scans are per-line Python helpers fed by Arrow; Spark splits, numbers and joins the work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quaymaster.session import cut_lineage

EARLIER = (Window.unboundedPreceding, -1)
BLANKS = " \t\r\ufeff"
SURVEY = "_split long, end0 boolean, n0 long, end1 boolean, n1 long"
CUT = "row long, first long, files long, part long, whole boolean, record string"


def quote_scanner(sep: str = ",", quote: str = '"') -> Callable[[str], tuple[bool, bool]]:
    """text -> (is a quote open behind it if none was before it, if one was before it).

    A quote opens a field only as its first character, blanks aside; a doubled quote stays within the field. All repeats are
    possessive, so a line takes linear time.
    """
    s, q = re.escape(sep), re.escape(quote)
    body = rf"(?:[^{q}]|{q}{q})*+"
    field = rf"(?:[ \t]*+{q}{body}{q}[^{s}]*+|(?![ \t]*+{q})[^{s}]*+)"
    opens = re.compile(rf"(?s)(?:{field}{s})*+[ \t]*+{q}{body}\Z")
    stays = re.compile(rf"(?s){body}\Z")
    closes = re.compile(rf"(?s){body}{q}[^{s}]*+(?:{s}|\Z)")

    def scan(text: str) -> tuple[bool, bool]:
        if quote not in text:
            return False, True
        outside = opens.match(text) is not None
        if stays.match(text):
            return outside, True
        end = closes.match(text).end()
        # Behind a separator a new field begins, which a quote may open again.
        return outside, text[end - 1:end] == sep and opens.match(text, end) is not None
    return scan


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _survey(scan):
    """Per split and state of its beginning: the state at its end and the records that start in it."""
    def run(batches):
        seen: dict[int, list] = {}  # splits of this task only
        for batch in batches:
            for split, text in _columns(batch, "_split", "value"):
                at = seen.setdefault(split, [False, 0, True, 0])
                after = scan(text)
                for i in (0, 2):
                    if not at[i] and text.strip(BLANKS):
                        at[i + 1] += 1
                    at[i] = after[at[i]]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *(pa.array([v[i] for v in seen.values()], t) for i, t in enumerate(
            (pa.bool_(), pa.int64(), pa.bool_(), pa.int64())))], names=["_split", "end0", "n0", "end1", "n1"])
    return run


def _cut(scan):
    """Records, or the pieces of one that a split boundary cuts (``whole`` false), with the constants of their split."""
    def run(batches):
        split, state, row, held, began, constants = None, False, -1, [], False, ()
        for batch in batches:
            out = []
            for here, no, inside, before, first, files, text in _columns(batch, "_split", "_no", "_inside", "_before", "_first", "_files", "value"):
                if here != split:
                    if held:
                        out.append((row, *constants, False, "\n".join(held)))
                    split, constants, state, row, held, began = here, (first, files, no), inside, before - 1, [], False
                if not state:
                    if not text.strip(BLANKS):
                        continue
                    row, held, began = row + 1, [], True
                held.append(text)
                state = scan(text)[state]
                if not state:
                    out.append((row, *constants, began, "\n".join(held)))
                    held = []
            yield _rows(out)
        if held:
            yield _rows([(row, *constants, False, "\n".join(held))])
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.bool_(), pa.string()))], names=[c.split()[0] for c in CUT.split(", ")])


def _any_open(scan):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scan(t)[0] for t in batch.column("value").to_pylist()], pa.bool_())], names=["open"])
    return run


def has_quoted_breaks(spark: SparkSession, path, sep: str = ",", quote: str = '"') -> bool:
    """Does any line end within quotes? Only lines that hold a quote are looked at."""
    lines = spark.read.text(path).filter(F.contains("value", F.lit(quote))).select("value")
    return not lines.mapInArrow(_any_open(quote_scanner(sep, quote)), "open boolean").filter("open").isEmpty()


def _split_lines(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    return lines.withColumn("_split", F.xxhash64("_path", "_start"))


def quoted_records(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """(row, first, files, record): every record of the files as text, its line breaks kept as ``\\n``.

    ``row`` numbers all records from 0 in file order, ``first`` is the number of the first record of the same file and ``files`` counts
    the files up to this one. Lines that are blank outside quotes are no records. A quote that is never closed
    raises when the plan is built: all that follows it would be one record.
    """
    scan = quote_scanner(sep, quote)
    lines = _split_lines(spark, path)
    # One small row per split; a million of them (128 TB in the usual splits) make 60 MB.
    names = lines.select("_split", "_path", "_start").distinct()
    # Put away by a checkpoint, not the cache, which would serve an old survey for a file written anew.
    plan = cut_lineage(_entries(names.join(lines.mapInArrow(_survey(scan), SURVEY), "_split")))
    unclosed = plan.filter("_last and _ends_inside").select("_path").limit(1).collect()
    if unclosed:
        raise ValueError(f"a quote in {unclosed[0][0]} is never closed")
    constants = ["_no", "_inside", "_before", "_first", "_files"]
    placed = lines.join(F.broadcast(plan.select("_split", *constants)), "_split", "left")
    # raise_error must stay uncast: an explicit cast of it is folded to NULL.
    number = F.when(F.col("_no").isNotNull(), F.col("_no")).otherwise(F.raise_error(F.lit("file splits changed while records were being cut")))
    cut = placed.select("_split", number.alias("_no"), *constants[1:], "value").mapInArrow(_cut(scan), CUT)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda x: x["record"]), "\n")
    joined = cut.filter("not whole").groupBy("row").agg(F.max("first").alias("first"), F.max("files").alias("files"), text.alias("record"))
    return cut.filter("whole").select("row", "first", "files", "record").union(joined)


def _resolved(splits: DataFrame) -> DataFrame:
    """``_inside``: the state in which each split begins, by putting the splits' functions together.

    A split whose end does not depend on its beginning fixes the state; between such splits each that swaps the states
    turns it. Both are sums over the splits before, so no split waits for another.
    """
    in_file = Window.partitionBy("_path").orderBy("_start")
    swapped = splits.withColumn("_swaps", F.sum((F.col("end0") & ~F.col("end1")).cast("int")).over(in_file))
    fixed = F.when(F.col("end0") == F.col("end1"), F.struct("end0", "_swaps"))
    known = swapped.withColumn("_known", F.last(fixed, ignorenulls=True).over(in_file.rowsBetween(*EARLIER))).withColumn(
        "_turned", F.coalesce(F.lag("_swaps").over(in_file), F.lit(0)))
    turns = F.col("_turned") - F.coalesce(F.col("_known._swaps"), F.lit(0)) + F.coalesce(F.col("_known.end0").cast("int"), F.lit(0))
    return known.withColumn("_inside", turns % 2 == 1).drop("_swaps", "_known", "_turned")


def _entries(splits: DataFrame) -> DataFrame:
    """State and number of the first record of each split, number of the first of its file, and files so far."""
    in_file, order = Window.partitionBy("_path").orderBy("_start"), Window.orderBy("_path", "_start")
    starts = _resolved(splits).withColumn("_starts", F.when(F.col("_inside"), F.col("n1")).otherwise(F.col("n0"))).select(
        "*", F.when(F.col("_inside"), F.col("end1")).otherwise(F.col("end0")).alias("_ends_inside"),
        F.lead("_start").over(in_file).isNull().alias("_last"), F.lag("_start").over(in_file).isNull().alias("_opens"),
        F.sum("_starts").over(Window.partitionBy("_path")).alias("_in_file"))
    placed = starts.select(
        "*", (F.row_number().over(order) - 1).cast("long").alias("_no"),
        F.coalesce(F.sum("_starts").over(order.rowsBetween(*EARLIER)), F.lit(0)).alias("_before"),
        F.sum((F.col("_opens") & (F.col("_in_file") > 0)).cast("long")).over(order).alias("_files"))
    return placed.withColumn("_first", F.first("_before").over(in_file))


# --- JSON arrays ---------------------------------------------------------------------------------
#
# The text is read in pieces that end before a closing brace, so a file is split wherever it has
# objects, line breaks or not. A piece then has no closing brace but the one before it, and at
# most one object of the top array begins in it.

_STRINGS = re.compile(r'(?s)"(?:[^"\\]|\\.)*+"')
_REST_OF_STRING = re.compile(r'(?s)(?:[^"\\]|\\.)*+"')
_OPEN_STRING = re.compile(r'(?s)"(?:[^"\\]|\\.)*+\Z')
_BETWEEN = re.compile(r"\s*(,?)\s*")
JSON_SURVEY = "_split long, end0 boolean, d0 long, end1 boolean, d1 long"
JSON_CUT = "row long, part long, whole boolean, record string"


def _outside(text: str, inside: bool) -> tuple[bool, str]:
    """(is a string open behind the text, the text without its strings)."""
    if inside:
        end = _REST_OF_STRING.match(text)
        if end is None:
            return True, ""
        text = text[end.end():]
    bare = _STRINGS.sub('""', text)
    open_at = _OPEN_STRING.search(bare.replace('""', "  "))
    return (True, bare[:open_at.start()]) if open_at else (False, bare)


def _depth(bare: str) -> int:
    return bare.count("{") + bare.count("[") - bare.count("]")


def _json_survey(batches):
    """Per split and state of its beginning: the state at its end and by how much nesting grew."""
    seen: dict[int, list] = {}
    for batch in batches:
        for split, closes, text in _columns(batch, "_split", "_closes", "value"):
            at = seen.setdefault(split, [False, 0, True, 0])
            for i in (0, 2):
                at[i + 1] -= closes and not at[i]
                at[i], bare = _outside(text, at[i])
                at[i + 1] += _depth(bare)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *(pa.array([v[i] for v in seen.values()], t) for i, t in enumerate(
        (pa.bool_(), pa.int64(), pa.bool_(), pa.int64())))], names=[c.split()[0] for c in JSON_SURVEY.split(", ")])


def _objects(rows: Iterator[tuple], started: Callable[[int], None], done: Callable[[int, bool, str], None]) -> None:
    """Walk the pieces of one split; ``done(part, whole, text)`` of every object or of what the split has of it."""
    state, depth, held, began, no = False, 0, None, False, 0
    for first, no, inside, entered, closes, text in rows:
        if first:
            state, depth, began = inside, entered, False
            held = [] if depth > 1 or state else None
        if closes and not state:
            depth -= 1
            if depth == 1 and held is not None:
                done(no, began, "".join([*held, "}"]))
                held = None
        elif closes and held is not None:
            held.append("}")
        if closes and not state and held is not None:
            held.append("}")
        if depth == 0 and not state and held is None:
            top = text.lstrip(BLANKS + "\n")
            if first and entered == 0 and not closes:
                if not top.startswith("["):
                    raise ValueError(f"expected a JSON array of objects, found {top[:40]!r}")
                text, depth = top[1:], 1
            elif top:
                raise ValueError(f"text after a JSON array: {top[:40]!r}")
            else:
                continue
        if depth == 1 and not state and held is None:
            rest = text[_BETWEEN.match(text).end():]
            if rest.startswith("]"):
                if rest[1:].strip(BLANKS + "\n"):
                    raise ValueError(f"text after a JSON array: {rest[:40]!r}")
                depth = 0
                continue
            if not rest:
                continue
            if not rest.startswith("{"):
                raise ValueError(f"expected a JSON array of objects, found {rest[:40]!r}")
            started(no)
            text, held, began = rest, [], True
        state, bare = _outside(text, state)
        depth += _depth(bare)
        if held is not None:
            held.append(text)
    if held is not None:
        done(no, False, "".join(held))


def _json_cut(counting: bool):
    """Objects of each split with their number, or with ``counting`` only how many begin in it."""
    def run(batches):
        out: list[tuple] = []
        numbers = {"row": -1}

        def flush():
            columns = list(zip(*out)) or [()] * 4
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=[c.split()[0] for c in JSON_CUT.split(", ")])
            out.clear()
            return rows

        def started(no):
            numbers["row"] += 1
            if counting:
                out.append((1, no, True, None))

        def done(no, whole, text):
            if not counting:
                out.append((numbers["row"], no, whole, text))

        for split in _splits_of(batches):
            numbers["row"] = split[0][4] - 1
            _objects(((i == 0, no, inside, depth, closes, text) for i, (no, inside, depth, closes, _, text) in enumerate(split)), started, done)
            yield flush()
    return run


def _splits_of(batches) -> Iterator[list[tuple]]:
    """The rows of one split after another; a split is what one task holds at a time."""
    held, last = [], None
    for batch in batches:
        for split, *values in _columns(batch, "_split", "_no", "_inside", "_depth", "_closes", "_before", "value"):
            if split != last and held:
                yield held
                held = []
            held.append(tuple(values))
            last = split
    if held:
        yield held


def json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(row, record): the objects of files that hold one JSON array each, as text, numbered from 0 in file order.

    Anything but an array of objects is an error when it is read; an array that is not closed, when the plan is built.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = pieces.withColumn("_split", F.xxhash64("_path", "_start"))
    splits = pieces.groupBy("_split", "_path", "_start").agg(F.min("_id").alias("_first_id"))
    # Every piece follows a closing brace but the first of a file.
    marked = pieces.join(F.broadcast(splits.select("_split", "_first_id")), "_split").withColumn(
        "_closes", (F.col("_start") > 0) | (F.col("_id") > F.col("_first_id")))
    in_file, order = Window.partitionBy("_path").orderBy("_start"), Window.orderBy("_path", "_start")
    surveyed = _resolved(splits.join(marked.mapInArrow(_json_survey, JSON_SURVEY), "_split")).withColumn(
        "_grows", F.when(F.col("_inside"), F.col("d1")).otherwise(F.col("d0")))
    entries = cut_lineage(surveyed.select(
        "_split", "_path", "_start", "_first_id", "_inside", F.coalesce(F.sum("_grows").over(in_file.rowsBetween(*EARLIER)), F.lit(0)).alias("_depth"),
        F.sum("_grows").over(Window.partitionBy("_path")).alias("_left_open"), (F.row_number().over(order) - 1).cast("long").alias("_no")))
    bad = entries.filter("_left_open <> 0").select("_path").limit(1).collect()
    if bad:
        raise ValueError(f"expected a JSON array of objects in {bad[0][0]}")
    columns = ["_split", "_no", "_inside", "_depth", "_closes", "_before", "value"]
    counted = (marked.drop("_first_id").join(F.broadcast(entries.select("_split", "_no", "_inside", "_depth")), "_split").withColumn("_before", F.lit(0).cast("long"))
               .select(*columns).mapInArrow(_json_cut(True), JSON_CUT).groupBy(F.col("part").alias("_no")).agg(F.sum("row").alias("_starts")))
    placed = entries.join(counted, "_no", "left").select(
        "_split", "_no", "_inside", "_depth", F.coalesce(F.sum(F.coalesce("_starts", F.lit(0))).over(order.rowsBetween(*EARLIER)), F.lit(0)).alias("_before"))
    cut = marked.drop("_first_id").join(F.broadcast(placed), "_split").select(*columns).mapInArrow(_json_cut(False), JSON_CUT)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda x: x["record"]), "")
    return cut.filter("whole").select("row", "record").union(cut.filter("not whole").groupBy("row").agg(text.alias("record")))
