"""Row patterns against a plain backtracking search, with ranges so small that matches go over many of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.llm import rowmatch
from skein.llm.rowmatch import Letter, either, many, maybe, seq

A, ANY = Letter("A", near=False), Letter("N")
D, U, P = Letter("D", step="down"), Letter("U", step="up"), Letter("P", "kind = 'p'", least=True)
PATTERNS = {
    "lazy": seq(A, many(either(D, U), lazy=True), P),
    "greedy": seq(A, many(either(D, U)), P),
    "fork": seq(A, either(seq(D, P), seq(D, D), U), maybe(P)),
    "tail": seq(A, many(D), many(U)),
    "back": seq(A, many(seq(U, maybe(D)), lazy=True), either(P, seq(D, D, P))),
    "all": seq(A, many(ANY), P),
}


def search(pattern, rows, i):
    """The end and letters of the match that a backtracking search finds from row ``i``, or None."""

    def fits(letter, j):
        v, prev = rows[j][1], rows[j - 1][1] if j else None
        if v is None or (letter.name == "P" and rows[j][2] != "p") or (letter.least and v < rows[i][1]):
            return False
        if letter.near and (j == 0 or rows[j][0] - rows[j - 1][0] > 10):
            return False
        return not letter.step or (prev is not None and (v < prev if letter.step == "down" else v > prev))

    def go(part, j, then):
        if isinstance(part, Letter):
            return then(j + 1, part.name) if j < len(rows) and fits(part, j) else None
        if part.kind == "seq":
            step = then
            for piece in reversed(part.parts):
                step = (lambda piece, step: lambda k, names: (lambda r: r and (r[0], names + r[1]))(go(piece, k, step)))(piece, step)
            return step(j, "")
        if part.kind == "either":
            return next((r for x in part.parts if (r := go(x, j, then))), None)
        again = part if part.kind == "many" else None
        more = lambda: go(part.parts[0], j, lambda k, names: (lambda r: r and (r[0], names + r[1]))(go(again, k, then) if again else then(k, "")))
        ways = (lambda: then(j, ""), more) if part.lazy else (more, lambda: then(j, ""))
        return next((r for way in ways if (r := way())), None)

    return go(pattern, i, lambda j, names: (j, names))


def by_hand(pattern, data):
    out, keys = [], {}
    for key, at, id_, value, kind in sorted({r for r in data if r[0] is not None and r[1] is not None}, key=lambda r: (r[0], r[1], r[2])):
        keys.setdefault(key, []).append((at, value, kind, id_))
    for key, rows in keys.items():
        i, n = 0, 0
        while i < len(rows):
            found = search(pattern, rows, i) if rows[i][1] is not None else None
            if found:
                n += 1
                out.append((key, n, rows[i][3], rows[found[0] - 1][3], found[0] - i, sum(r[1] for r in rows[i : found[0]]), found[1]))
                i = found[0]
            else:
                i += 1
    return sorted(out)


def table(spark, data):
    frame = spark.createDataFrame([(k, a, i, v, x, "own") for k, a, i, v, x in data], "key long, at long, id long, value long, kind string, part_ string")
    return frame.withColumn("at", F.timestamp_seconds("at"))


def made(seed, n, smooth):
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice((1, 2, 5) if smooth else (1, 5, 10, 11))
        value = rng.randrange(30) if smooth or rng.random() > 0.1 else None
        out.append((rng.choice((1, 1, 1, 2)) if not smooth else 7, at, i, value, rng.choice("pqqq")))
    return out + out[: n // 9] + [(None, 1, 1, 1, "p"), (3, None, 1, 1, "p")]


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_equals_backtracking(spark, name, monkeypatch):
    data = made(1, 80, False) + [(k if k is None else k + 10, m, i + 1000, v, x) for k, m, i, v, x in made(2, 40, True)]
    monkeypatch.setattr(rowmatch, "range_count", lambda rows: 9)
    got = rowmatch.matches(table(spark, data), PATTERNS[name], "key", "at", "id", F.col("value"), 10)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(PATTERNS[name], data)


def test_ranges_without_break(spark, monkeypatch):
    """One match over many ranges, and one that never comes to its end."""
    monkeypatch.setattr(rowmatch, "range_count", lambda rows: 9)
    rise = [(1, i, i, i, "q") for i in range(40)]
    for last in ("p", "q"):
        data = [*rise, (1, 40, 40, 70, last), (1, 41, 41, 71, "p")]
        got = rowmatch.matches(table(spark, data), PATTERNS["lazy"], "key", "at", "id", F.col("value"), 10).collect()
        assert sorted(tuple(r) for r in got) == by_hand(PATTERNS["lazy"], data)
    got = rowmatch.matches(table(spark, rise), PATTERNS["lazy"], "key", "at", "id", F.col("value"), 10).collect()
    assert got == []


def test_awkward_rows(spark):
    assert rowmatch.matches(table(spark, []), PATTERNS["lazy"], "key", "at", "id", F.col("value"), 10).collect() == []
    values = spark.createDataFrame([(x,) for x in (1.005, -0.005, math.nan, math.inf, None, 2.675)], "v double")
    assert [r.c for r in values.select(rowmatch.cents(F.col("v")).alias("c")).collect()] == [math.floor(100 * 1.005 + 0.5), math.floor(0.0), None, None, None, math.floor(100 * 2.675 + 0.5)]


def test_patterns_are_checked():
    with pytest.raises(ValueError, match="may not be empty"):
        rowmatch.automaton(seq(A, many(many(D))))
    with pytest.raises(ValueError, match="may not be empty"):
        rowmatch.automaton(many(A))
    with pytest.raises(ValueError, match="its own row alone"):
        rowmatch.automaton(seq(D, U))
