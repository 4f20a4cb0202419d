"""Row pattern matching: regular expressions over consecutive rows of a key, with the results of a backtracking search.

From right to left, a pass notes for each state of the pattern's automaton and each row the largest value of a match's first row
with which the rest can still succeed.  The forward walk then takes the first choice that this table allows and never goes back.

Rows are dealt by ranges of (key, time, id), so that a hot key lies over many tasks.  A row that only a match's first letter fits
is a *break*: no match goes over its left side.  What lies between the first and the last break of a range is solved where
it is; the *head* before the first and the *tail* from the last one on, and ranges without any break, wait for their neighbours:
the table's values come from the right, walks under way from the left, range by range, in as many rounds as the longest
sequence of ranges without a break has, usually none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skein.llm.common import stored
from skein.operators.ranges import before, range_count

#: Bounds beyond every value.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Bit that says that a row has a value; letters have the bits below it.
HAS_VALUE = 1 << 30


@dataclass(frozen=True)
class Letter:
    """What a letter fits: rows with a value for which ``where``, an SQL condition, holds, whose value is ``step`` ("", "down" or "up") from that of the
    row before, which is at least the value of the match's first row if ``least``, and whose time is within the pattern's gap
    of the row before if ``near``."""

    name: str
    where: str = "true"
    step: str = ""
    least: bool = False
    near: bool = True


@dataclass(frozen=True)
class Part:
    """A piece of a pattern, built by ``seq``, ``either``, ``many`` and ``maybe``."""

    kind: str
    parts: tuple[Part | Letter, ...]
    lazy: bool = False


def seq(*parts: Part | Letter) -> Part:
    return Part("seq", parts)


def either(*parts: Part | Letter) -> Part:
    """The first of the parts that leads to a match."""
    return Part("either", parts)


def many(part: Part | Letter, lazy: bool = False) -> Part:
    """Any number of times, none included: as often as possible, or if ``lazy`` as seldom."""
    return Part("many", (part,), lazy)


def maybe(part: Part | Letter, lazy: bool = False) -> Part:
    return Part("maybe", (part,), lazy)


@dataclass
class Automaton:
    """``options[state]``: in order of preference, (letter, next state), or None where the match may end.  State 0 begins."""

    letters: list[Letter]
    options: list[list[tuple[int, int] | None]]
    outer: int = 0
    inner: int = 0
    base: list[int] = field(default_factory=list)

    def __post_init__(self):
        later = {o for s in self.reached() for o in self.options[s] if o is not None}
        first = {o[0] for o in self.options[0] if o is not None}
        if any(self.letters[i].step or self.letters[i].near for i in first):
            raise ValueError("a match's first letter sees its own row alone")
        self.outer, self.inner = (sum(1 << i for i in x) for x in (first, {o[0] for o in later}))
        self.base = [MOST if None in o else LEAST for o in self.options]

    def reached(self) -> set[int]:
        """States that a match can be in after its first row."""
        found, todo = set(), [o[1] for o in self.options[0] if o is not None]
        while todo:
            if (s := todo.pop()) not in found:
                found.add(s)
                todo += [o[1] for o in self.options[s] if o is not None]
        return found


def automaton(pattern: Part | Letter) -> Automaton:
    """The pattern's automaton; parts that may repeat must take a row each time, and so must the whole."""
    nodes: list = [("end",)]
    letters: list[Letter] = []

    def build(part: Part | Letter, then: int) -> int:
        if isinstance(part, Letter):
            if part.name not in [x.name for x in letters]:
                letters.append(part)
            nodes.append(("letter", [x.name for x in letters].index(part.name), then))
        elif part.kind == "seq":
            for piece in reversed(part.parts):
                then = build(piece, then)
            return then
        elif part.kind == "either":
            nodes.append(("fork", [build(x, then) for x in part.parts]))
        else:
            at = len(nodes)
            nodes.append(None)
            body = build(part.parts[0], at if part.kind == "many" else then)
            nodes[at] = ("fork", [then, body] if part.lazy else [body, then])
            if part.kind == "many" and at in silent(body):
                raise ValueError("a part that repeats may not be empty")
            return at
        return len(nodes) - 1

    def silent(node: int, seen: dict[int, None] | None = None) -> dict[int, None]:
        """Nodes reached without a row, in order of preference."""
        seen = {} if seen is None else seen
        if node not in seen:
            seen[node] = None
            if nodes[node] and nodes[node][0] == "fork":
                for x in nodes[node][1]:
                    silent(x, seen)
        return seen

    begin = build(pattern, 0)
    numbers, options, todo = {begin: 0}, [], [begin]
    while todo:
        out: list[tuple[int, int] | None] = []
        for x in silent(todo.pop(0)):
            if nodes[x][0] == "end":
                out.append(None)
            elif nodes[x][0] == "letter":
                if nodes[x][2] not in numbers:
                    numbers[nodes[x][2]] = len(numbers)
                    todo.append(nodes[x][2])
                out.append((nodes[x][1], numbers[nodes[x][2]]))
        options.append(out)
    if None in options[0]:
        raise ValueError("a pattern may not be empty")
    return Automaton(letters, options)


@dataclass
class Rows:
    """Columns of consecutive rows: places, keys, times in microseconds, ids, values, and bits of the letters whose own
    condition holds."""

    place: np.ndarray
    key: pa.Array
    at: np.ndarray
    id: np.ndarray
    value: np.ndarray
    bits: np.ndarray

    def __len__(self) -> int:
        return len(self.place)

    def cut(self, low: int, high: int) -> Rows:
        return Rows(*(x[low:high] for x in (self.place, self.key, self.at, self.id, self.value, self.bits)))

    def then(self, other: Rows) -> Rows:
        key = pa.concat_arrays([self.key, other.key])
        return Rows(np.concatenate([self.place, other.place]), key, *(np.concatenate([a, b]) for a, b in ((self.at, other.at), (self.id, other.id), (self.value, other.value), (self.bits, other.bits))))


def fitting(machine: Automaton, rows: Rows, prev: Rows | None, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the letters that fit each row as a match's first, and as a later one; without the row before, none as a later one."""
    all_rows = prev.then(rows) if prev is not None else rows
    at, value, bits, key = all_rows.at, all_rows.value, all_rows.bits, all_rows.key.to_numpy(zero_copy_only=False)
    same, near, down, up = (np.zeros(len(all_rows), bool) for _ in range(4))
    same[1:] = np.asarray(key[1:] == key[:-1], bool)
    near[1:] = at[1:] - at[:-1] <= gap
    valued = same[1:] & (bits[:-1] & HAS_VALUE > 0)
    down[1:], up[1:] = valued & (value[1:] < value[:-1]), valued & (value[1:] > value[:-1])
    later = np.zeros(len(all_rows), np.int64)
    for i, letter in enumerate(machine.letters):
        if machine.inner >> i & 1:
            ok = same & (bits & 1 << i > 0) & {"": same, "down": down, "up": up}[letter.step]
            later |= (ok & near if letter.near else ok).astype(np.int64) << i
    begin = 0 if prev is None else 1
    return rows.bits & machine.outer, later[begin:]


#: A walk under way: state, value, part, place and id of its first row, id of its last one, rows and sum of values so far, letters.
Walk = tuple[int, int, int, int, int, int, int, int, str]


def table_of(machine: Automaton, values: list[int], later: list[int], right: list[int]) -> list[list[int]]:
    """For each row, and after the last one, by state: the largest first value with which the rest can succeed."""
    states = sorted(machine.reached())
    least = [x.least for x in machine.letters]
    choices = [(s, [o for o in machine.options[s] if o is not None]) for s in states]
    base, now, out = machine.base, right, [right] * (len(values) + 1)
    for j in range(len(values) - 1, -1, -1):
        if bits := later[j]:
            row = base.copy()
            for s, ways in choices:
                best = row[s]
                for letter, t in ways:
                    if bits >> letter & 1:
                        bound = min(values[j], now[t]) if least[letter] else now[t]
                        if bound > best:
                            best = bound
                row[s] = best
            now = row
        else:
            now = base
        out[j] = now
    return out


def solve(machine: Automaton, rows: Rows, first: np.ndarray, later: np.ndarray, part: int, right: list[int] | None, entry: Walk | None) -> tuple[list[tuple], Walk | None, list[int]]:
    """Matches that end in ``rows``, the walk under way at their end, and the table at their first row.

    ``right`` is the table at the row after them, None where no match goes on there; ``entry`` a walk that comes from the left."""
    closed = right is None
    values, firsts, laters = rows.value.tolist(), first.tolist(), later.tolist()
    table = table_of(machine, values, laters, machine.base if closed else right)
    letters, options, n, out = machine.letters, machine.options, len(rows), []
    i = 0
    while i < n or entry:
        if entry:
            state, a, from_part, from_place, from_id, last_id, count, total, names = entry
            labels, j, entry = [names], i, None
        else:
            a, bits, nxt = values[i], firsts[i], table[i + 1]
            begun = next((o for o in options[0] if bits >> o[0] & 1 and nxt[o[1]] >= a), None) if bits else None
            if begun is None:
                i += 1
                continue
            labels, state = [letters[begun[0]].name], begun[1]
            from_part, from_place, from_id, last_id, count, total, j = part, int(rows.place[i]), int(rows.id[i]), int(rows.id[i]), 1, a, i + 1
        while True:
            chosen = None
            for option in options[state]:
                if option is None:
                    chosen = "end"
                elif j == n and not closed:
                    chosen = "wait"
                elif j < n and laters[j] >> option[0] & 1 and (not letters[option[0]].least or values[j] >= a) and table[j + 1][option[1]] >= a:
                    chosen = option
                if chosen is not None:
                    break
            if chosen == "end":
                out.append((from_part, from_place, from_id, last_id, count, total, "".join(labels)))
                break
            if chosen == "wait":
                return out, (state, a, from_part, from_place, from_id, last_id, count, total, "".join(labels)), table[0]
            labels.append(letters[chosen[0]].name)
            last_id, count, total, state, j = int(rows.id[j]), count + 1, total + values[j], chosen[1], j + 1
        i = j
    return out, None, table[0]


#: Kinds of rows: matches, rows of ranges' heads and tails and of ranges without a break, and walks under way at a range's end.
MATCH, HEAD, TAIL, WHOLE, EXIT = range(5)
WALK = ("state_", "a_", "from_part_", "from_place_", "from_id_", "last_", "rows_", "total_", "labels_")
MATCHED = ("part_", "place_", "key_", "id_", "last_", "rows_", "total_", "labels_")
def as_rows(table: pa.Table | pa.RecordBatch, prefix: str = "", place: np.ndarray | None = None) -> Rows:
    def column(name: str) -> pa.Array:
        found = table.column(prefix + name)
        return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found

    numbers = [column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("at_", "id_", "value_", "bits_")]
    return Rows(column("place_").to_numpy() if place is None else place, column("key_"), *numbers)


def batch_of(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch with the columns that are given, one value for all rows or a list, and nulls in the others."""

    def column(field: pa.Field) -> pa.Array:
        value = columns.get(field.name)
        if value is None:
            return pa.nulls(n, field.type)
        if isinstance(value, (pa.Array, pa.ChunkedArray)):
            return value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value
        return pa.array(value if isinstance(value, (list, tuple, np.ndarray)) else [value] * n, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def matched(found: list[tuple], keys: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    part, place, first, last, rows, total, labels = zip(*found, strict=True)
    return batch_of(schema, len(found), kind_=MATCH, part_=part, place_=place, key_=keys, id_=first, last_=last, rows_=rows, total_=total, labels_=labels)


def first_pass(machine: Automaton, gap: int, schema: pa.Schema):
    """Solves what lies between a range's first and last break and hands on the other rows.  Rows wait until a break comes."""

    def loose(kind: int, part: int, rows: Rows) -> pa.RecordBatch:
        return batch_of(schema, len(rows), kind_=kind, part_=part, place_=rows.place, key_=rows.key, at_=rows.at, id_=rows.id, value_=rows.value, bits_=rows.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, begun = TaskContext.get().partitionId(), 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            more = as_rows(batch, place=np.arange(n, n + batch.num_rows))
            n += batch.num_rows
            held = held.then(more) if held is not None else more
            first, later = fitting(machine, held, None, gap)
            breaks = np.flatnonzero(later[1:] == 0) + 1
            if not len(breaks):
                continue
            low, high = 0 if begun else int(breaks[0]), int(breaks[-1])
            if not begun:
                begun = True
                yield loose(HEAD, part, held.cut(0, low))
            found = solve(machine, held.cut(low, high), first[low:high], later[low:high], part, None, None)[0]
            if found:
                yield matched(found, held.key.take(pa.array([f[1] - int(held.place[0]) for f in found])), schema)
            held = held.cut(high, len(held))
        if held is not None:
            yield loose(TAIL if begun else WHOLE, part, held)

    return run


def one_range(machine: Automaton, gap: int, schema: pa.Schema, going: str):
    """What the rows of a head, a tail or a range without break give with what their neighbours told: ``left``, the table at the
    first row, or ``right``, the matches that end there and the walk under way at their end."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place_")
        told = {c: table.column(c)[0].as_py() for c in table.column_names if c not in ("place_", "key_", "at_", "id_", "value_", "bits_")}
        own = as_rows(table)
        prev = as_rows(table.slice(0, 1), "prev_", np.zeros(1, np.int64)) if told["kind_"] != TAIL and told["prev_bits_"] is not None else None
        first, later = fitting(machine, own, prev, gap)
        if going == "left":
            left = table_of(machine, own.value.tolist(), later.tolist(), told["right_"] or machine.base)[0]
            return pa.Table.from_batches([batch_of(schema, 1, seq_=told["seq_"], left_=[left])])
        walk = told["walk_"]
        found, after, _ = solve(machine, own, first, later, told["part_"], told["right_"], walk and tuple(walk[c] for c in WALK))
        begun = own.key[0].as_py() if walk is None or after is None or after[2:4] != (walk["from_part_"], walk["from_place_"]) else walk["from_key_"]
        out = [batch_of(schema, 1, kind_=EXIT, seq_=told["seq_"], walk_=[None if after is None else dict(zip(WALK, after, strict=True)) | {"from_key_": begun}])]
        if found:
            keys = [walk["from_key_"] if walk and f[:2] == (walk["from_part_"], walk["from_place_"]) else own.key[0].as_py() for f in found]
            out.append(matched(found, pa.array(keys, own.key.type), schema))
        return pa.Table.from_batches(out)

    return run


def bound_for(rows: DataFrame, machine: Automaton, gap: int) -> DataFrame:
    """Matches (part_, place_, key_, id_, last_, rows_, total_, labels_) of rows (key_, at_, id_, value_, bits_, more_), in order by
    part_ and place_ of their first rows."""
    spark, order = rows.sparkSession, ["key_", "at_", "id_", "more_"]
    key = rows.schema["key_"].dataType.simpleString()
    kinds = f"kind_ int, part_ long, place_ long, key_ {key}, at_ long, id_ long, value_ long, bits_ long, last_ long, rows_ long, total_ long, labels_ string"
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    dealt = rows.repartitionByRange(range_count(rows), *order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(first_pass(machine, gap, arrow(kinds)), kinds), "row_matches")
    waiting = found.where(F.col("kind_") != MATCH).select("kind_", "part_", "place_", "key_", "at_", "id_", "value_", "bits_")
    ends = waiting.groupBy("part_").agg(F.max_by(F.struct("key_", "at_", "id_", "value_", "bits_"), "place_").alias("end_"), F.max((F.col("kind_") == WHOLE).cast("int")).alias("whole_"))
    ends = stored(before(ends, [], "part_", F.lit(1)).withColumn("seq_", F.coalesce("before_", F.lit(0)).cast("long")), "range_ends")
    told = ends.agg(F.max("seq_").alias("last"), F.sum("whole_").alias("wholes")).first()
    if told["last"] is None:
        return found.where(F.col("kind_") == MATCH).select(*MATCHED)
    prev = ends.select((F.col("seq_") + 1).alias("seq_"), *[F.col(f"end_.{c}").alias(f"prev_{c}") for c in ("key_", "at_", "id_", "value_", "bits_")])
    # one row a range grows with the input: nothing is broadcast
    pieces = waiting.join(ends.select("part_", "seq_").hint("merge"), "part_").join(prev.hint("merge"), "seq_", "left")
    heads, tails, wholes = (pieces.where(F.col("kind_") == k) for k in (HEAD, TAIL, WHOLE))

    left_kinds = "seq_ long, left_ array<long>"
    walk_kinds = f"struct<state_: int, a_: long, from_part_: long, from_place_: long, from_id_: long, last_: long, rows_: long, total_: long, labels_: string, from_key_: {key}>"
    out_kinds = f"{kinds}, seq_ long, walk_ {walk_kinds}"
    no_table, no_walk = F.lit(None).cast("array<long>").alias("right_"), F.lit(None).cast(walk_kinds).alias("walk_")

    def lefts(some: DataFrame) -> DataFrame:
        return some.groupBy("seq_").applyInArrow(one_range(machine, gap, arrow(left_kinds), "left"), left_kinds)

    def walked(some: DataFrame) -> DataFrame:
        return some.groupBy("seq_").applyInArrow(one_range(machine, gap, arrow(out_kinds), "right"), out_kinds)

    from_right = lambda tables: tables.select((F.col("seq_") - 1).alias("seq_"), F.col("left_").alias("right_")).hint("merge")
    from_left = lambda done: done.where(F.col("kind_") == EXIT).select((F.col("seq_") + 1).alias("seq_"), "walk_").hint("merge")
    end = spark.range(1).select(F.lit(told["last"] + 1).cast("long").alias("seq_"), F.lit(None).cast("array<long>").alias("left_"))
    tables = stored(lefts(heads.select("*", no_table)).unionByName(end), "range_tables")
    latest, open_ = tables, told["wholes"]
    while open_:
        latest = stored(lefts(wholes.join(from_right(latest), "seq_")), "range_tables")
        tables, open_ = tables.unionByName(latest), open_ - latest.count()
    done = stored(walked(tails.join(from_right(tables), "seq_").select("*", no_walk)), "range_walks")
    begin = spark.range(1).select(F.lit(EXIT).alias("kind_"), F.lit(-1).cast("long").alias("seq_"), no_walk)
    latest, open_ = done.unionByName(begin, allowMissingColumns=True), told["wholes"]
    while open_:
        latest = stored(walked(wholes.join(from_right(tables), "seq_").join(from_left(latest), "seq_")), "range_walks")
        done, open_ = done.unionByName(latest), open_ - latest.where(F.col("kind_") == EXIT).count()
    last = walked(heads.select("*", no_table).join(from_left(done), "seq_", "left"))
    found, done, last = (x.where(F.col("kind_") == MATCH).select(*MATCHED) for x in (found, done, last))
    return found.unionByName(done).unionByName(last)


def matches(rows: DataFrame, pattern: Part | Letter, key: str, at: str, id_col: str, value: Column, gap_seconds: float) -> DataFrame:
    """Matches of ``pattern`` over each key's distinct rows in order of ``at`` and ``id_col``: the key, match_no from 1, first_id,
    last_id, n_rows, total (the sum of ``value``) and labels, the name of the letter of each row.

    The search starts at a key's first row, goes on with the next row where it fails, and after a match with the row after its
    last.  ``value`` is a whole number; rows where it is null fit no letter, but stand between others.  Rows without key or time
    are dropped, equal rows count once, and different rows of equal time and id are put in a fixed order; an empty table has
    no matches; other columns may have any names.
    """
    machine = automaton(pattern)
    column = lambda c: F.col(f"`{c}`")
    here = value.cast("long")
    bits = F.when(here.isNull(), F.lit(0)).otherwise(F.lit(HAS_VALUE))
    for i, letter in enumerate(machine.letters):
        bits = bits + F.when(here.isNotNull() & F.expr(letter.where), F.lit(1 << i)).otherwise(F.lit(0))
    more = F.unhex(F.md5(F.to_json(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]))))
    narrow = rows.where(column(key).isNotNull() & column(at).isNotNull())
    narrow = narrow.select(column(key).alias("key_"), column(at).alias("at_"), column(id_col).cast("long").alias("id_"), here.alias("value_"), bits.cast("long").alias("bits_"), more.alias("more_"))
    found = stored(bound_for(narrow.distinct(), machine, round(gap_seconds * 1_000_000)), "row_matches")
    counts = before(found.groupBy("key_", "part_").agg(F.count("*").alias("n_")), ["key_"], "part_", F.col("n_")).select("key_", "part_", F.coalesce("before_", F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("key_", "part_").orderBy("place_"))
    out = found.withColumn("inside_", inside).join(counts.hint("merge"), ["key_", "part_"])
    return out.select(F.col("key_").alias(key), (F.col("before_") + F.col("inside_")).cast("long").alias("match_no"), F.col("id_").alias("first_id"), F.col("last_").alias("last_id"), F.col("rows_").alias("n_rows"), F.col("total_").alias("total"), F.col("labels_").alias("labels"))


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null where the value is null or isn't finite."""
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(9e16))
    return F.when(finite, F.floor(100 * value + 0.5))


def rise_to_purchase() -> Part:
    """``A (D|U)*? P``: any row, falls and rises that are no errors, then at once a purchase of at least the first row's value."""
    fine = "kind IS NOT NULL AND kind <> 'error'"
    return seq(Letter("A", near=False), many(either(Letter("D", fine, "down"), Letter("U", fine, "up")), lazy=True), Letter("P", "kind = 'purchase'", least=True))


def digests(clicks: DataFrame, gap_seconds: float = 600) -> DataFrame:
    """Matches of ``rise_to_purchase`` over each client's clicks, the letters as a digest."""
    found = matches(clicks, rise_to_purchase(), "client_id", "ts", "click_id", cents(F.col("value")), gap_seconds)
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", F.col("total").alias("sum_cents"), F.sha2("labels", 256).alias("labels_sha256"))
