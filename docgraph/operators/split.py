"""Splitting, chunking and packing under token budgets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .. import vocab
from ..functions.scalar import count_tokens
from ..session import checkpointed, python_map


def slide(docs: DataFrame, text: str = "text", size: int = vocab.CHUNK_CHARS, stride: int = vocab.STRIDE_CHARS) -> DataFrame:
    """Windows of size characters every stride, the last one ending with the text; windows without text are dropped.
    Adds char_offset and chunk; a text that fits is one window."""
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / stride) * stride).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride)))
    out = docs.withColumn("char_offset", F.explode(starts))
    out = out.withColumn("chunk", F.trim(F.substring(text, F.col("char_offset") + 1, F.lit(size))))
    return out.filter(F.length("chunk") > 0)


_HEADING = re.compile(r"^(#{1,3})\s+(.+)$", re.MULTILINE)


def section_spans(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, path of headings) of each section, with what precedes the first heading under an empty path."""
    found = list(_HEADING.finditer(text))
    spans: list[tuple[int, int, list[str]]] = []
    if not found or found[0].start() > 0:
        spans.append((0, found[0].start() if found else len(text), []))
    stack: list[tuple[int, str]] = []
    for m, after in zip(found, [*found[1:], None][: len(found)], strict=True):
        level = len(m[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, m[2].strip()))
        spans.append((m.start(), after.start() if after else len(text), [t for _, t in stack]))
    return spans


#: Chunks that a Python worker holds before it hands them on.
PIECES = 10_000


def chunk(docs: DataFrame, limit: int = vocab.CHUNK_TOKENS) -> DataFrame:
    """doc_id, char_offset, section_path and chunk: a document that fits is one chunk, else each section is, else its windows."""
    size, stride = limit * vocab.CHARS_PER_TOKEN, (limit - limit // 8) * vocab.CHARS_PER_TOKEN

    def pieces(text: str) -> Iterator[tuple[int, list[str], str]]:
        whole = len(text) // vocab.CHARS_PER_TOKEN <= limit
        for start, end, path in [(0, len(text), [])] if whole else section_spans(text):
            at = start
            while at < end:
                to = end if (end - start) // vocab.CHARS_PER_TOKEN <= limit else min(end, at + size)
                if part := text[at:to].strip():
                    yield at, path, part
                if to >= end:
                    break
                at += stride

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = ((i, *p) for i, t in zip(b["doc_id"], b["text"], strict=True) if t for p in pieces(t))
            while some := list(islice(rows, PIECES)):
                yield pd.DataFrame(some, columns=["doc_id", "char_offset", "section_path", "chunk"])

    return python_map(docs.select("doc_id", "text"), run, "doc_id long, char_offset int, section_path array<string>, chunk string")


_TIERS = ((re.compile(r"^#{1,2}\s+.+$", re.MULTILINE), "start"), (re.compile(r"\n\s*\n"), "end"), (re.compile(r"[.!?]\s"), "end"), (re.compile(r"\n"), "end"))


def greedy_bounds(text: str, budget: int) -> list[tuple[int, int]]:
    """Ranges that cover text, each within budget tokens where a cut allows it. A cut backs off to the latest place of the
    strongest kind since the last one: heading or paragraph, sentence, line, fixed step."""
    tokens = lambda n: 0 if n == 0 else max(1, n // vocab.CHARS_PER_TOKEN)
    n = len(text)
    if tokens(n) <= budget:
        return [(0, n)]
    step = max(200, budget * vocab.CHARS_PER_TOKEN)
    strength: dict[int, int] = {c: 3 for c in range(step, n, step)}  # weakest first, so that stronger kinds overwrite
    for pattern, side in reversed(_TIERS):
        kind = 0 if side == "start" or pattern is _TIERS[1][0] else 1 if pattern is _TIERS[2][0] else 2
        for m in pattern.finditer(text):
            c = m.start() if side == "start" else m.end()
            if kind == 2 and strength.get(c) == 3:
                continue  # a line end on a fixed step keeps the step's rank
            strength[c] = kind
    strength.pop(0, None)
    out, start, latest = [], 0, {}
    for c in sorted(strength):
        if c <= start:
            continue
        if tokens(c - start) > budget:
            cut = next((latest[k] for k in range(4) if k in latest), c)
            out.append((start, cut))
            start, latest = cut, {}
        else:
            latest[strength[c]] = c
    if start < n:
        out.append((start, n))
    return out


_STAMP = re.compile(r"^\[?(\d{1,2}/\d{1,2}/\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)\]?\s+", re.I | re.M)
_FORMATS = tuple(f"{d} {t}" for d in ("%d/%m/%Y", "%m/%d/%Y", "%d/%m/%y", "%m/%d/%y") for t in ("%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p"))


# How times of chat lines are written, in the order in which they are tried.
STAMPS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "dd/MM/yy HH:mm:ss", "dd/MM/yy HH:mm", "MM/dd/yy HH:mm:ss", "MM/dd/yy HH:mm", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy hh:mm a")


def line_time(line: Column) -> Column:
    """The time at the begin of a chat line, by the first form that fits; null where there is none. Days, months and hours may have one digit."""
    parts = r"(?i)^\[?(\d{1,2})/(\d{1,2})/(\d{2,4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?\]?\s+"
    part = lambda k: F.regexp_extract(line, parts, k)
    two = lambda k: F.lpad(part(k), 2, "0")
    second, half = F.when(part(6) != "", F.concat(F.lit(":"), part(6))).otherwise(""), F.when(part(7) != "", F.concat(F.lit(" "), F.upper(part(7)))).otherwise("")
    plain = F.concat(two(1), F.lit("/"), two(2), F.lit("/"), part(3), F.lit(" "), two(4), F.lit(":"), part(5), second, half)
    fits = lambda form: (F.length(part(3)) == (4 if "yyyy" in form else 2)) & ((part(7) != "") == form.endswith("a"))
    return F.coalesce(*[F.when(fits(form), F.try_to_timestamp(plain, F.lit(form))) for form in STAMPS])


def gap_bounds(text: str, budget: int, gap: int = vocab.CHAT_GAP_SECONDS) -> list[tuple[int, int]]:
    """Ranges of a chat export: cut at the largest silence of gap seconds or more until each part fits the budget; parts
    without one are cut like other texts."""
    marks: list[tuple[int, pd.Timestamp]] = []
    for m in _STAMP.finditer(text):
        for f in _FORMATS:
            ts = pd.to_datetime(f"{m[1]} {m[2].upper()}", format=f, errors="coerce")
            if not pd.isna(ts):
                marks.append((m.start(), ts))
                break
    silences = [(b[0], (b[1] - a[1]).total_seconds()) for a, b in zip(marks, marks[1:], strict=False)]
    silences = [(at, s) for at, s in silences if s >= gap]

    def parts(lo: int, hi: int) -> list[tuple[int, int]]:
        if (hi - lo) // vocab.CHARS_PER_TOKEN <= budget:
            return [(lo, hi)]
        inside = [x for x in silences if lo < x[0] < hi]
        if not inside:
            return [(lo + a, lo + b) for a, b in greedy_bounds(text[lo:hi], budget)]
        at = max(inside, key=lambda x: (x[1], -x[0]))[0]
        return parts(lo, at) + parts(at, hi)

    return parts(0, len(text))


def split(docs: DataFrame, budget: int = vocab.SPLIT_BUDGET, chats: bool = False) -> DataFrame:
    """doc_id, part (from 0), n_parts, origin_char (of the trimmed part) and text of every part that has text."""
    bounds = gap_bounds if chats else greedy_bounds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                cut = [(a, text[a:z]) for a, z in bounds(text or "", budget) if text and text[a:z].strip()]
                rows += [(doc, k, len(cut), a + len(t) - len(t.lstrip()), t.strip()) for k, (a, t) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "n_parts", "origin_char", "text"])

    return python_map(docs.select("doc_id", "text"), run, "doc_id long, part int, n_parts int, origin_char long, text string")


def islands(df: DataFrame, partition: list[str], order: list[str], key: Column) -> DataFrame:
    """Numbers the runs of rows with an equal key, in order, from 1: column island."""
    w = Window.partitionBy(*partition).orderBy(*order)
    change = F.when(key.eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_change")


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str], numbers: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(values of keys, arrays of the numbers) of runs of rows with equal keys; only the numbers of one run are held."""
    key, held = None, [[] for _ in numbers]
    for b in batches:
        own = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
        values = [b.column(c).to_numpy(zero_copy_only=False) for c in numbers]
        at = 0
        for i in range(1, len(own) + 1):
            if i < len(own) and own[i] == own[at]:
                continue
            if key is not None and own[at] != key:
                yield key, [np.concatenate(h) for h in held]
                held = [[] for _ in numbers]
            key = own[at]
            for h, v in zip(held, values, strict=True):
                h.append(v[at:i])
            at = i
    if key is not None:
        yield key, [np.concatenate(h) for h in held]


def _exits(size: np.ndarray, spare: np.ndarray, budget: int) -> dict[str, list]:
    """What a run of rows does to the bins of those before it: for each row that may be the first to begin a bin here, its place, its end, the limit of
    the last bin that begins here after it, and how many do. Bins before fill by what is less than the budget, so only the rows of the first `budget` may be."""
    end = np.cumsum(size)
    start = end - size
    limit = start + spare + budget
    after = np.maximum(np.arange(1, len(size) + 1), np.searchsorted(end, limit, "right"))
    may = np.flatnonzero((start <= budget) & ((size > 0) | (np.arange(len(size)) == 0)))
    known: dict[int, tuple[int, int]] = {}
    for i in may.tolist()[::-1]:
        way = []
        while i < len(size) and i not in known:
            way.append(i)
            i = int(after[i])
        found = known.get(i)
        for j in way[::-1]:
            found = known[j] = (int(limit[j]), 1) if found is None else (found[0], found[1] + 1)
    return {"place": may.tolist(), "end": end[may].tolist(), "limit": [known[i][0] for i in may.tolist()], "count": [known[i][1] for i in may.tolist()]}


def greedy_pack(df: DataFrame, partition: list[str], order: list[str], size: str, budget: int, spare: str | None = None) -> DataFrame:
    """Bins of consecutive rows whose sizes sum to at most budget (a larger row is a bin of its own): partition, order, size and bin. spare: a column of what
    the first row of a bin does not count of its size.

    Where a bin ends depends on all rows before, but a range of rows needs to know one number of them: where the bin that is open at its begin has its limit. Rows
    are dealt by ranges of the whole order, so that a group of any size is spread. Each range works out for every row that may begin its first bin (those within one
    budget) the limit that it hands on; one pass over these, a few a range, follows the chain; then the ranges number their bins."""
    rows = df.select(*partition, *order, F.col(size).cast("long").alias(size), *([spare] if spare else []))
    rows = rows.withColumns({"_size": F.coalesce(size, F.lit(0)).cast("long"), "_spare": F.coalesce(spare, F.lit(0)).cast("long") if spare else F.lit(0).cast("long")})
    sorting = [*partition, *order, size]
    ranged = checkpointed(rows.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("_range", F.spark_partition_id()))
    keys = ["_range", *partition]
    lists = ("place", "end", "limit", "count")
    fields = [ranged.schema[k] for k in keys]

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (sizes, spares) in _segments(batches, keys, ["_size", "_spare"]):
            found = _exits(sizes, spares, budget)
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | {"total": int(sizes.sum()), "rows": len(sizes)} | found], to_arrow_schema(exit_schema))

    exit_schema = T.StructType([*fields, T.StructField("total", T.LongType()), T.StructField("rows", T.LongType()), *(T.StructField(n, T.ArrayType(T.LongType())) for n in lists)])
    handed = ranged.sortWithinPartitions("_range", *sorting).select(*keys, "_size", "_spare").mapInArrow(exits, exit_schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before, limit, bins = None, 0, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if group != [r[k] for k in partition]:
                    group, before, limit, bins = [r[k] for k in partition], 0, 0, 0
                at = bisect_right(r["end"], limit - before) if bins else 0
                entered = at < len(r["place"])
                out.append({k: r[k] for k in keys} | {"_entry": r["place"][at] if entered else r["rows"], "_bins": bins})
                if entered:
                    limit, bins = before + r["limit"][at], bins + r["count"][at]
                before += r["total"]
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(mark_schema))

    mark_schema = T.StructType([*fields, T.StructField("_entry", T.LongType()), T.StructField("_bins", T.LongType())])
    marks = handed.repartition(*partition).sortWithinPartitions(*partition, "_range").mapInArrow(chain, mark_schema).alias("m")
    same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    both = ranged.alias("r").join(marks, same).select("r.*", "m._entry", "m._bins").repartition("_range").sortWithinPartitions("_range", *sorting)
    schema = T.StructType([*rows.drop("_size", "_spare").schema.fields, T.StructField("bin", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, load, bin_ = None, 0, 0, 0
        for b in batches:
            out = []
            columns = (b.column(c).to_pylist() for c in ("_size", "_spare", "_entry", "_bins"))
            for own, n, less, entry, bins in zip(zip(*(b.column(c).to_pylist() for c in keys), strict=True), *columns, strict=True):
                if own != key:
                    key, at, bin_ = own, 0, bins - 1
                if at == entry or (at > entry and load + n > budget):
                    bin_, load = bin_ + 1, n - less
                else:
                    load += n
                at += 1
                out.append(bin_)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), pa.array(out, pa.int64())], schema.names)

    return both.mapInArrow(number, schema)


def combined(units: DataFrame, partition: list[str], order: list[str], fits: Column, tokens: Column, separator: Column, budget: int, most: int = vocab.SPLIT_BUDGET) -> DataFrame:
    """units with run and bin: consecutive units that `fits` (small ones of one kind, by its value; null: not to be joined) are a run; a run within the budget is one
    bin, a longer one is cut greedily at the smaller of both limits, where all but the first unit of a bin bring a separator. Units that do not fit have a run each."""
    rows = islands(units.withColumns({"_fits": fits, "_n": tokens.cast("long"), "_sep": separator.cast("long")}), partition, order, F.coalesce("_fits", F.concat_ws("/", F.lit(""), *order)))
    run = [*partition, "island"]
    rows = rows.withColumn("_n", F.col("_n") + F.col("_sep"))
    sums = rows.groupBy(*run).agg((F.sum("_n") - F.min_by("_sep", F.struct(*order))).alias("_total"))
    packed = greedy_pack(rows, run, order, "_n", min(budget, most), "_sep").select(*run, *order, "bin")
    cut = packed.join(sums, run).select(*run, *order, F.when(F.col("_total") <= budget, 0).otherwise(F.col("bin")).cast("long").alias("bin"))
    return units.join(cut, [*partition, *order]).withColumnRenamed("island", "run")


def carved(docs: DataFrame, order: str, cap: int = vocab.LEAD_TOKENS, budget: int = vocab.SPLIT_BUDGET, joined: Column | None = None) -> DataFrame:
    """The units of docs (doc_id, text, order) with a first one that is quickly done: of the first document, if it is above the cap and not `joined` from several, the
    first part within the cap is a unit of its own, and what follows is split again by the budget. All others stay whole. doc_id, order, piece (from 0; 0 of a lead is the
    head), kind (whole, head, rest), origin_char and text."""
    joined = F.lit(False) if joined is None else joined
    first = docs.agg(F.min(order).alias("m"))
    lead = docs.filter(F.col(order) == first.scalar()).filter(~joined & (count_tokens(F.col("text")) > cap)).limit(1)
    heads = split(lead, min(cap, vocab.SPLIT_BUDGET)).filter("part < 2 AND n_parts > 1")
    cut = heads.groupBy("doc_id").agg(F.max(F.when(F.col("part") == 1, F.col("origin_char"))).alias("_cut"))
    rest = lead.join(cut, "doc_id").select("doc_id", "_cut", F.expr("substring(text, _cut + 1)").alias("text"))
    after = split(rest, min(budget, vocab.SPLIT_BUDGET)).join(rest.select("doc_id", "_cut"), "doc_id")
    head = heads.filter("part = 0").select("doc_id", F.lit(0).alias("piece"), F.lit("head").alias("kind"), "origin_char", "text")
    pieces = head.unionByName(after.select("doc_id", (F.col("part") + 1).alias("piece"), F.lit("rest").alias("kind"), (F.col("origin_char") + F.col("_cut")).alias("origin_char"), "text"))
    own = [] if order == "doc_id" else [order]
    pieces = pieces.join(lead.select("doc_id", *own), "doc_id")
    whole = docs.join(cut.select("doc_id"), "doc_id", "left_anti")
    whole = whole.select("doc_id", F.lit(0).alias("piece"), F.lit("whole").alias("kind"), F.lit(0).cast("long").alias("origin_char"), "text", *own)
    return pieces.unionByName(whole)


def running_offsets(df: DataFrame, partition: list[str], order: list[str], length: Column) -> DataFrame:
    """Adds begin and end of every row in the concatenation of its partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("end_char", F.sum(length).over(w).cast("long"))
    return out.withColumn("begin_char", (F.col("end_char") - length).cast("long"))


def gap_sessions(df: DataFrame, partition: list[str], ts: str, order: list[str], gap: int = vocab.CHAT_GAP_SECONDS) -> DataFrame:
    """Numbers each partition's sessions from 1: a new one starts after gap seconds or more of silence."""
    w = Window.partitionBy(*partition).orderBy(ts, *order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    pause = at - F.lag(at).over(w)
    cut = F.when(pause >= gap * 1_000_000, 1).otherwise(0)
    return df.withColumn("_cut", cut).withColumn("session", (F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_cut")


def batchable(source_type: Column, text: Column, budget: int = vocab.SPLIT_BUDGET) -> Column:
    """Short texts of the kinds that are sent together."""
    n = count_tokens(text)
    return source_type.isin("text", "markdown", "journal") & (n < vocab.BATCH_ENTRY_TOKENS) & (n < int(0.25 * budget))
