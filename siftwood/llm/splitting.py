"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is worked on in ranges of bytes, of whatever size it is. The ranges of a
text are spread over the tasks; each is read with a halo: one piece before it and
one behind. Within its range a worker finds the boundaries and describes the range
by a small table; stitching the tables tells every range what the ones before it
amount to, and the ranges emit their own pieces by offset. No task needs a whole
text, and no whole text is shuffled.

For `boundaries` the table says how the lines and runs of lines begin, end and what
the longest between is. Two neighbours join into one such table: the open line of
the first goes on in the second, and so does the open run.

For the pieces, where a piece starts depends only on where the one before it
started, so the table is a map: from each place where the first piece of the range
may start to the first start behind the range, with the number of pieces between.
Steps soon meet, so a map is a few intervals on which the start behind is fixed or
moves along. Maps are composed in blocks of ranges, the blocks are followed from the
start of the text, and within each block the ranges: prefix sums in two levels that
give each range its first start, its piece number and its line number.

A cut prefers, within the space that a piece may fill, the last blank line, then
the last line end, then the last end of a sentence, then the last white space,
and cuts between two characters only if there is none of these. The next piece
starts up to `overlap` tokens before the cut, at the earliest line start there,
else at the earliest word, else at the earliest character.

Tokens are the estimate (UTF-8 bytes + 3) div 4.

Defined results: null, empty and small texts give no pieces (`split_oversized`)
and no row (`boundaries`); a null start_line counts as 1; repeated rows of a key
give their pieces once, and of texts that differ under one key, null included, one
counts (that of the smallest hash); a text in which a character is badly encoded is
cut by its bytes and the pieces are decoded with U+FFFD; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.session import materialize

LIMIT_TOKENS = 512
OVERLAP_TOKENS = 32
#: Bytes of a range of a text in a table, and of a range of a file.
RANGE_BYTES = 8 << 10
FILE_RANGE_BYTES = 1 << 20
#: Ranges that are handed on at a time.
PART_RANGES = 1024
#: Ranges whose maps are composed in one step.
BLOCK_RANGES = 64

_BLANK = re.compile(rb"(?:\A|(?<=\n))[ \t\r]*(?:\n|\Z)")
_SENTENCE = re.compile(rb"[.!?;:](?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
_SPACE = re.compile(rb"[ \t]+")


def tokens_of(n_bytes: int) -> int:
    """The estimate: bytes, plus three, by four."""
    return (n_bytes + 3) // 4


class Cutter:
    """Boundaries of one range, and the steps from the start of a piece to its end and to the next start.

    data holds the bytes from `at` on; start and stop bound the range itself, end
    is the length of the whole text. All positions are those of the whole text.
    """

    def __init__(self, data: bytes, at: int, start: int, stop: int, end: int, limit: int, overlap: int):
        self.data, self.at, self.start, self.stop, self.end = data, at, start, stop, end
        self.limit, self.overlap = limit, overlap
        self.lines = [at + m.end() for m in re.finditer(rb"\n", data)]
        if at == 0:
            self.lines.insert(0, 0)
        self.blanks = [at + m.end() for m in _BLANK.finditer(data) if m.end() > m.start() and (m.start() or not at)]
        self._step: dict[int, tuple[int, int]] = {}

    def _last(self, places: list[int], low: int, high: int) -> int:
        i = bisect.bisect_right(places, high) - 1
        return places[i] if i >= 0 and places[i] > low else -1

    def _match(self, pattern: re.Pattern[bytes], low: int, high: int) -> int:
        best = -1
        for m in pattern.finditer(self.data, max(0, low - self.at), high - self.at):
            if self.at + m.end() > low:
                best = self.at + m.end()
        return best

    def _whole(self, place: int, low: int) -> int:
        """place, moved down to the start of a character and off a line end's middle."""
        i = place - self.at
        while i > low - self.at + 1 and i < len(self.data) and (self.data[i] & 0xC0) == 0x80:
            i -= 1
        if i - 1 > low - self.at and i < len(self.data) and self.data[i] == 10 and self.data[i - 1] == 13:
            i -= 1
        return self.at + i

    def step(self, s: int) -> tuple[int, int]:
        """The end of the piece that starts at s, and the start of the next one."""
        found = self._step.get(s)
        if found is None:
            found = self._step[s] = self._find(s)
        return found

    def _find(self, s: int) -> tuple[int, int]:
        if self.end - s <= self.limit:
            return self.end, self.end
        low, high = s + self.overlap, s + self.limit
        cut = self._last(self.blanks, low, high)
        if cut < 0:
            cut = self._last(self.lines, low, high)
        if cut < 0:
            cut = self._match(_SENTENCE, low, high)
        if cut < 0:
            cut = self._match(_SPACE, low, high)
        if cut < 0:
            cut = self._whole(high, low)
        if not self.overlap:
            return cut, cut
        i = bisect.bisect_left(self.lines, cut - self.overlap)
        if i < len(self.lines) and self.lines[i] < cut:
            return cut, self.lines[i]
        found = _SPACE.search(self.data, cut - self.overlap - self.at, cut - self.at)
        if found and self.at + found.end() < cut:
            return cut, self.at + found.end()
        back = cut - self.overlap
        while back < cut and (self.data[back - self.at] & 0xC0) == 0x80:
            back += 1
        return cut, back

    def walk(self, s: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, next start) of the pieces that start in the range, from s on."""
        while s < self.stop:
            cut, after = self.step(s)
            yield s, cut, after
            if cut >= self.end:
                return
            s = after

    def table(self) -> list[tuple[int, int, int, int, int]]:
        """(low, high, leave, count, slope): from a first start s in low to high the first start behind the range is leave, plus s - low if slope is 1.

        A step advances by the limit at most, so the first starts lie in the first
        `limit` bytes of the range; that of the first range is the start of the text.
        """
        known: dict[int, tuple[int, int]] = {}
        last = 1 if self.start == 0 else min(self.stop, self.start + self.limit + 1)
        places = [s for s in range(self.start, last) if s - self.at >= len(self.data) or (self.data[s - self.at] & 0xC0) != 0x80 or s == self.start]
        for s in reversed(places):
            count, place = 0, s
            while place < self.stop:
                if place in known and place != s:
                    place, count = known[place][0], count + known[place][1]
                    break
                cut, after = self.step(place)
                count += 1
                place = self.end if cut >= self.end else after
            known[s] = (place, count)
        out: list[list[int]] = []
        for s in places:
            leave, count = known[s]
            if out:
                low, _, first, number, slope = now = out[-1]
                if count == number and (slope != 1 and leave == first or slope != 0 and leave - s == first - low):
                    now[1], now[4] = s + 1, 0 if leave == first else 1
                    continue
            out.append([s, s + 1, leave, count, -1])
        return [(low, high, leave, count, max(slope, 0)) for low, high, leave, count, slope in out]

    def line_ends(self, low: int, high: int) -> int:
        return self.data.count(b"\n", low - self.at, high - self.at)


# A summary of a stretch of text for `boundaries`, as integers. A stretch without a line
# end is (0, bytes, filled); any other is (1, bytes and filled of what comes before its first
# line end, the longest whole line, the runs of its whole lines, bytes and filled of what
# comes after its last line end). Runs are (a blank line was seen, bytes of the run at the
# beginning, of the longest between, of the run at the end), with -1 for none.


def _line(n: int, filled: int) -> tuple[int, int, int, int]:
    return (0, n, -1, n) if filled else (1, -1, -1, -1)


def _grown(a: int, b: int) -> int:
    """The bytes of a run that goes on: its lines are joined by one byte."""
    return a if b < 0 else b if a < 0 else a + b + 1


def _runs(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    if not a[0]:
        pre = _grown(a[1], b[1])
        return (0, pre, -1, pre) if not b[0] else (1, pre, b[2], b[3])
    joint = _grown(a[3], b[1])
    return (1, a[1], a[2], joint) if not b[0] else (1, a[1], max(a[2], b[2], joint), b[3])


_NO_RUNS = (0, -1, -1, -1)


def summary(data: bytes) -> tuple[int, ...]:
    """The summary of a stretch of text."""
    lines = [(len(x), int(bool(x.strip(b" \t\r")))) for x in data.split(b"\n")]
    if len(lines) == 1:
        return (0, *lines[0])
    runs = _NO_RUNS
    for x in lines[1:-1]:
        runs = _runs(runs, _line(*x))
    return (1, *lines[0], max((n for n, _ in lines[1:-1]), default=-1), *runs, *lines[-1])


def stitched(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """The summary of two neighbouring stretches."""
    if not a[0] and not b[0]:
        return (0, a[1] + b[1], a[2] | b[2])
    if not a[0]:
        return (1, a[1] + b[1], a[2] | b[2], *b[3:])
    if not b[0]:
        return (*a[:-2], a[-2] + b[1], a[-1] | b[2])
    n, filled = a[-2] + b[1], a[-1] | b[2]
    runs = _runs(_runs(a[4:8], _line(n, filled)), b[4:8])
    return (1, a[1], a[2], max(a[3], n, b[3]), *runs, *b[-2:])


def _kind(found: tuple[int, ...], limit_tokens: int) -> str:
    """The boundary of a text with this summary."""
    if not found[0]:
        line, runs = found[1], _line(*found[1:])
    else:
        line = max(found[1], found[3], found[-2])
        runs = _runs(_runs(_line(*found[1:3]), found[4:8]), _line(*found[-2:]))
    if tokens_of(max(0, *runs[1:])) <= limit_tokens:
        return "blank"
    return "line" if tokens_of(line) <= limit_tokens else "inside"


def _big(df: DataFrame, key: str, text: str, limit: int, extra: list) -> DataFrame:
    """Key, copy (the hash of the text), extra columns, size and text of the oversized texts."""
    size = F.octet_length(F.col("__text")).cast("bigint")
    picked = df.select(F.col(f"`{key}`").alias("__key"), *extra, F.col(f"`{text}`").cast("string").alias("__text"))
    big = picked.where(size > limit)
    return big.select("__key", F.xxhash64("__text").alias("copy"), *[c for c in big.columns if c not in ("__key", "__text")], size.alias("size"), "__text")


def _cut(batch: pa.RecordBatch, range_bytes: int, halo: int) -> Iterator[tuple[int, int, int, int, int, memoryview]]:
    """(row, range_no, at, start, stop, bytes) of the ranges of the texts in a batch, which are not copied."""
    for i, value in enumerate(batch.column("__text").cast(pa.large_binary())):
        raw = memoryview(value.as_buffer())
        for n, start in enumerate(range(0, len(raw), range_bytes)):
            stop = min(start + range_bytes, len(raw))
            at = max(0, start - halo)
            yield i, n, at, start, stop, raw[at : min(stop + halo, len(raw))]


def _ranges(big: DataFrame, range_bytes: int, halo: int) -> DataFrame:
    """One row per range of an oversized text: the columns but the text, range_no, at, start, stop and data."""
    kept = [f for f in big.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("range_no", "at", "start", "stop")), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = _cut(batch, range_bytes, halo)
            while some := list(islice(cuts, PART_RANGES)):
                at = pa.array([c[0] for c in some])
                columns = [batch.column(f.name).take(at) for f in kept] + [pa.array([c[j] for c in some], pa.int64()) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([bytes(c[5]) for c in some], pa.binary())], names=schema.names)

    return big.mapInArrow(run, schema)


def boundaries(
    df: DataFrame,
    key: str = "chunk_id",
    text: str = "text",
    *,
    limit_tokens: int = LIMIT_TOKENS,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """key and boundary of each text above the limit.

    boundary is 'blank' if every run of lines between blank lines is within the
    limit, else 'line' if every line is, else 'inside'. It comes from the stitched
    tables of the text's ranges.
    """
    key_field = T.StructField("__key", df.schema[key].dataType)
    fields = [key_field, T.StructField("copy", T.LongType()), T.StructField("range_no", T.LongType()), T.StructField("told", T.ArrayType(T.LongType()))]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(i, n, list(summary(bytes(data)))) for i, n, _, _, _, data in _cut(batch, range_bytes, 0)]
            at = pa.array([x[0] for x in told], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key").take(at), batch.column("copy").take(at), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.list_(pa.int64()))],
                names=[f.name for f in fields],
            )

    # equal rows fold before the shuffle; a table is eleven numbers at most
    tables = _big(df, key, text, limit_tokens * 4, []).mapInArrow(describe, T.StructType(fields)).distinct()

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, whole = None, None
        for batch in batches:
            keys, kinds = [], []
            for k, copy, told in zip(*(batch.column(c).to_pylist() for c in ("__key", "copy", "told")), strict=True):
                if here is None or here[0] != k:
                    if here is not None:
                        keys.append(here[0]), kinds.append(_kind(whole, limit_tokens))
                    here, whole = (k, copy), tuple(told)
                elif copy == here[1]:  # another text under the same key doesn't count
                    whole = stitched(whole, tuple(told))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(kinds, pa.string())], names=["__key", "boundary"])
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here[0]], batch.schema.field(0).type), pa.array([_kind(whole, limit_tokens)], pa.string())], names=["__key", "boundary"])

    # the ranges of a text in order, streamed
    ordered = tables.repartition("__key").sortWithinPartitions("__key", "copy", "range_no")
    told = ordered.mapInArrow(stitch, T.StructType([key_field, T.StructField("boundary", T.StringType())]))
    return told.select(F.col("__key").alias(key), "boundary")


_PIECE = [
    T.StructField("piece_no", T.LongType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("start_byte", T.LongType()),
    T.StructField("end_byte", T.LongType()),
    T.StructField("text", T.StringType()),
]


def _pieces(cutter: Cutter, first: int, number: int, line: int) -> Iterator[tuple]:
    """The pieces of a range, given its first start, their first number and the line on which the range begins."""
    place = cutter.start
    for s, cut, _ in cutter.walk(first):
        line += cutter.line_ends(place, s) if s >= place else -cutter.line_ends(s, place)
        place = s
        body = cutter.data[s - cutter.at : cut - cutter.at]
        last = line + body.count(b"\n") - body.endswith(b"\n")
        yield number, line, max(line, last), s, cut, body.decode("utf-8", errors="replace")
        number += 1


def split_oversized(
    df: DataFrame,
    key: str = "chunk_id",
    text: str = "text",
    start_line: str | None = "start_line",
    *,
    limit_tokens: int = LIMIT_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """key, piece_no, start_line, end_line, start_byte, end_byte and text of the pieces of each text above the limit."""
    limit, overlap = limit_tokens * 4, overlap_tokens * 4
    if not 0 <= overlap * 2 < limit or range_bytes < 4 * limit:
        raise ValueError("the overlap must be below half the limit, a range at least four times the limit")
    line = F.coalesce(F.col(f"`{start_line}`").cast("int"), F.lit(1)) if start_line else F.lit(1)
    key_field = T.StructField("__key", df.schema[key].dataType)
    # written once: both passes read the same rows, known by a number
    ranges = _ranges(_big(df, key, text, limit, [line.alias("__line")]), range_bytes, limit + 8)
    ranges = materialize(ranges.withColumn("row", F.monotonically_increasing_id()), "ranges")
    one = ranges.groupBy("__key").agg(F.min(F.struct("copy", "__line")).alias("one")).select("__key", "one.*")
    chosen = ranges.select("__key", "copy", "__line", "range_no", "row").alias("r").join(one.alias("o"), F.col("r.__key").eqNullSafe(F.col("o.__key")) & (F.col("r.copy") == F.col("o.copy")) & (F.col("r.__line") == F.col("o.__line")))
    chosen = chosen.groupBy("r.__key", "range_no").agg(F.min("row").alias("row")).select("row")
    # the ranges of a text that has several are spread over the tasks
    alone = F.col("size") <= range_bytes
    picked = ranges.where(alone).unionByName(ranges.where(~alone).repartition("__key", "range_no")).join(chosen, "row", "left_semi")
    firsts = _stitch(picked, key_field, limit, overlap)
    rows = _emitted(ranges.join(firsts.select("row", "first", "number", "lines"), "row"), key_field, limit, overlap)
    return rows.select(F.col("__key").alias(key), *[f.name for f in _PIECE])


def _emitted(ranges: DataFrame, key_field: T.StructField, limit: int, overlap: int) -> DataFrame:
    """The pieces of ranges that know their first start, piece number and line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.column("__key").type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            for i in range(batch.num_rows):
                got = {c: batch.column(c)[i].as_py() for c in ("__key", "data", "at", "start", "stop", "size", "first", "number", "lines", "__line")}
                cutter = Cutter(got["data"], got["at"], got["start"], got["stop"], got["size"], limit, overlap)
                out: list[list] = [[] for _ in range(7)]
                for piece in _pieces(cutter, got["first"], got["number"], got["__line"] + got["lines"]):
                    for column, value in zip(out, (got["__key"], *piece), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["__key", *(f.name for f in _PIECE)])

    wanted = ["__key", "data", "at", "start", "stop", "size", "first", "number", "lines", "__line"]
    return ranges.select(*wanted).mapInArrow(emit, T.StructType([key_field, *_PIECE]))


#: Low, high, leave, count and slope of an interval of a map.
Interval = tuple[int, int, int, int, int]


def _at(table: list[Interval], s: int) -> tuple[int, int]:
    """The start behind the ranges of a map, and the pieces between, from a first start; one behind them goes past."""
    i = bisect.bisect_right(table, (s, 1 << 62)) - 1
    if i < 0 or s >= table[i][1]:
        return s, 0
    low, _, leave, count, slope = table[i]
    return leave + (s - low if slope else 0), count


def composed(a: list[Interval], b: list[Interval]) -> list[Interval]:
    """The map of two neighbouring stretches: a start goes through the first, then through the second."""
    edges = sorted({x for low, high, *_ in b for x in (low, high)})
    out: list[Interval] = []
    for low, high, leave, count, slope in a:
        if not slope:
            after, more = _at(b, leave)
            cuts = [(low, high, after, count + more, 0)]
        else:
            inner = [x - leave + low for x in edges[bisect.bisect_right(edges, leave) : bisect.bisect_left(edges, leave + high - low)]]
            cuts = []
            for x, y in zip([low, *inner], [*inner, high], strict=True):
                i = bisect.bisect_right(b, (leave + x - low, 1 << 62)) - 1
                moves = i < 0 or leave + x - low >= b[i][1] or b[i][4]
                after, more = _at(b, leave + x - low)
                cuts.append((x, y, after, count + more, int(bool(moves))))
        for x in cuts:
            if out and out[-1][1] == x[0] and out[-1][2:] == x[2:] and not x[4]:
                out[-1] = (out[-1][0], x[1], *x[2:])
            else:
                out.append(x)
    return out


def _flat(table: list[Interval]) -> list[int]:
    return [n for x in table for n in x]


def _table(flat: list[int]) -> list[Interval]:
    return list(zip(*(flat[i::5] for i in range(5)), strict=True))


def _stitch(ranges: DataFrame, key_field: T.StructField, limit: int, overlap: int) -> DataFrame:
    """Key, range_no and row of each range with its first start, first piece number and the line ends before it."""
    longs = T.ArrayType(T.LongType(), False)
    number = T.LongType()
    fields = [key_field, *(T.StructField(c, number) for c in ("range_no", "row", "ends")), T.StructField("map", longs)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, maps = [], []
            for i in range(batch.num_rows):
                cutter = Cutter(*(batch.column(c)[i].as_py() for c in ("data", "at", "start", "stop", "size")), limit, overlap)
                ends.append(cutter.line_ends(cutter.start, cutter.stop))
                maps.append(_flat(cutter.table()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), batch.column("range_no"), batch.column("row"), pa.array(ends, pa.int64()), pa.array(maps, pa.list_(pa.int64()))], names=[f.name for f in fields]
            )

    tables = ranges.select("__key", "range_no", "row", "at", "start", "stop", "size", "data").mapInArrow(describe, T.StructType(fields))
    tables = materialize(tables.withColumn("block", F.floor(F.col("range_no") / BLOCK_RANGES).cast("bigint")), "maps")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's ranges come in order; a range that goes on in the next batch is kept open
        here, ends, whole = None, 0, []
        schema = None
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            schema = [batch.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64())]
            for k, block, n, flat in zip(*(batch.column(c).to_pylist() for c in ("__key", "block", "ends", "map")), strict=True):
                if here == (k, block):
                    ends, whole = ends + n, composed(whole, _table(flat))
                    continue
                if here is not None:
                    for column, value in zip(out, (*here, ends, _flat(whole)), strict=True):
                        column.append(value)
                here, ends, whole = (k, block), n, _table(flat)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema, strict=True)], names=["__key", "block", "ends", "map"])
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*here, ends, _flat(whole)), schema, strict=True)], names=["__key", "block", "ends", "map"])

    def follow(step: str):
        """Prefix sums along the rows of a group, from the group's own start, or from the text's where it names none."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, first, count, lines = None, 0, 0, 0
            for batch in batches:
                out: list[list] = [[] for _ in range(3)]
                begins = zip(*(batch.column(c).to_pylist() for c in ("b_first", "b_number", "b_lines")), strict=True)
                for k, group, begin, n, flat in zip(batch.column("__key").to_pylist(), batch.column("grp").to_pylist(), begins, batch.column("ends").to_pylist(), batch.column("map").to_pylist(), strict=True):
                    if here != (k, group):
                        here, (first, count, lines) = (k, group), begin
                    for column, value in zip(out, (first, count, lines), strict=True):
                        column.append(value)
                    first, more = _at(_table(flat), first)
                    count, lines = count + more, lines + n
                yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column(step), batch.column("row"), *(pa.array(c, pa.int64()) for c in out)], names=["__key", step, "row", "first", "number", "lines"])

        return run

    def followed(rows: DataFrame, step: str) -> DataFrame:
        ordered = rows.repartition("__key", "grp").sortWithinPartitions("__key", "grp", step)
        schema = T.StructType([key_field, *(T.StructField(c, number) for c in (step, "row", "first", "number", "lines"))])
        return ordered.mapInArrow(follow(step), schema)

    zero = F.lit(0).cast("bigint")
    nothing = [zero.alias(c) for c in ("b_first", "b_number", "b_lines")]
    block_fields = T.StructType([key_field, T.StructField("block", number), T.StructField("ends", number), T.StructField("map", longs)])
    blocks = tables.select("__key", "block", "range_no", "ends", "map").repartition("__key", "block").sortWithinPartitions("__key", "block", "range_no").mapInArrow(compose, block_fields)
    begins = followed(blocks.select("__key", zero.alias("grp"), "block", zero.alias("row"), "ends", "map", *nothing), "block")
    begins = begins.select(F.col("__key").alias("b_key"), F.col("block").alias("b_block"), F.col("first").alias("b_first"), F.col("number").alias("b_number"), F.col("lines").alias("b_lines"))
    rows = tables.join(begins, F.col("__key").eqNullSafe(F.col("b_key")) & (F.col("block") == F.col("b_block")))
    return followed(rows.select("__key", F.col("block").alias("grp"), "range_no", "row", "ends", "map", "b_first", "b_number", "b_lines"), "range_no")


def split_files(
    spark: SparkSession,
    paths: list[tuple[str, int]],
    *,
    limit_tokens: int = LIMIT_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    range_bytes: int = FILE_RANGE_BYTES,
) -> DataFrame:
    """The pieces of files given by path and length: each task seeks to its range and reads that and its halo.

    The paths must lie where every executor can open them (a mounted folder). The
    files may be of any size; none is read whole by a task.
    """
    limit, overlap = limit_tokens * 4, overlap_tokens * 4
    halo = limit + 8
    files = spark.createDataFrame(paths, "__key string, size bigint").where("size > 0")
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / range_bytes).cast("bigint"))).alias("range_no")
    start = F.col("range_no") * range_bytes
    spans = files.select("__key", "size", number).select(
        "__key", "size", "range_no", F.greatest(start - halo, F.lit(0).cast("bigint")).alias("at"), start.alias("start"), F.least(start + range_bytes, F.col("size")).alias("stop"), F.col("range_no").alias("row")
    )
    spans = spans.repartition("__key", "range_no")
    read_schema = T.StructType([*spans.schema.fields, T.StructField("data", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                path, at = one.column("__key")[0].as_py(), one.column("at")[0].as_py()
                stop, size = one.column("stop")[0].as_py(), one.column("size")[0].as_py()
                with open(path, "rb") as f:
                    f.seek(at)
                    data = f.read(min(stop + halo, size) - at)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], names=read_schema.names)

    key_field = T.StructField("__key", T.StringType())
    firsts = materialize(_stitch(spans.mapInArrow(read, read_schema), key_field, limit, overlap), "firsts")
    # the first starts go to the ranges before they are read again, so that no bytes are shuffled
    joined = spans.join(firsts.select("__key", "range_no", "first", "number", "lines"), ["__key", "range_no"]).withColumn("__line", F.lit(1))
    read_schema = T.StructType([*joined.schema.fields, T.StructField("data", T.BinaryType())])
    rows = _emitted(joined.mapInArrow(read, read_schema), key_field, limit, overlap)
    return rows.withColumnRenamed("__key", "path")
