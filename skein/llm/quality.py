"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a bounded sample of labelled documents are gathered, the trees are fitted on the driver, flattened
into arrays and broadcast (their size is fixed by the parameters); one pass over the documents computes statistics
and scores batch by batch with a vectorised traversal.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Sent, pieces, raw

#: Labelled rows that a fit uses, at most; a documented bound on what the driver gathers.
SAMPLE_ROWS = 12_000
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "ascii_letter", "non_ascii", "space", "period", "comma", "other_mark", "pipe", "repeat_mark",
    "distinct_words", "top_word", "twins", "distinct_pairs", "top_pair", "distinct_triples", "lines", "line_bytes", "distinct_lines", "all_caps_words", "capital_words",
    "marked_ends", "single_mark_words", "longest_run", "hapax", "worst_line",
)


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 other mark, 1 upper, 2 lower, 3 digit, 4 non-ASCII, 5 white space, 6 full stop, 7 comma, 8 bar, 9 marks seldom doubled in prose."""
    out = np.zeros(256, np.int64)
    for kind, members in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, range(128, 256)), (5, b" \t\n\r\x0b\x0c"), (6, b"."), (7, b","), (8, b"|"), (9, b"*#$%&!@^~_=<>{}[]\\")):
        for b in members:
            out[b] = kind
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text, from the whole text; an empty text has zeros."""
    classes, out = byte_classes(), np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.split()
        n, size = len(words), len(text)
        if not n:
            continue
        kinds = np.bincount(classes, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=10) / size
        counts = Counter(words)
        pairs = Counter(zip(words, words[1:]))  # noqa: B905
        triples = len(set(zip(words, words[1:], words[2:])))  # noqa: B905
        twins = sum(c for (a, b), c in pairs.items() if a == b)
        lines = [x for x in text.split(b"\n") if x.strip()]
        ends = Counter()
        caps = capital = single = 0
        for w, c in counts.items():
            ends[w[-1]] += c
            if 65 <= w[0] <= 90:
                capital += c
                if len(w) > 1 and w.isupper():
                    caps += c
            if len(w) == 1 and not w.isalnum():
                single += c
        longest = run = 1
        if twins:
            for a, b in zip(words, words[1:]):  # noqa: B905
                run = run + 1 if a == b else 1
                longest = max(longest, run)
        marks = sum(c for e, c in ends.items() if classes[e] in (0, 8, 9))
        sizes = [len(x) for x in lines]
        worst = max(lines, key=len).split()
        out[i] = (
            np.log1p(size), np.log1p(n), sum(len(w) * c for w, c in counts.items()) / n, kinds[1], kinds[3], kinds[1] + kinds[2], kinds[4], kinds[5], kinds[6], kinds[7], kinds[0], kinds[8], kinds[9],
            len(counts) / n, max(counts.values()) / n, twins / n, len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / n, triples / max(1, n - 2), np.log1p(len(lines)), np.log1p(sum(sizes) / len(lines)),
            len(set(lines)) / len(lines), caps / n, capital / n, marks / n, single / n, np.log1p(longest), sum(c == 1 for c in counts.values()) / n, len(set(worst)) / max(1, len(worst)),
        )
    return out


@dataclass
class Trees:
    """Boosted trees as arrays; row t, node k has children 2k+1 and 2k+2, and a leaf points to itself by feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: all rows walk a tree together, one level per step."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node]))
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_hessian: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss over quantile histograms.

    One label only, or no rows, gives trees of one leaf and the base rate (0.5 without rows).
    """
    n, m = x.shape
    nodes = 2 ** (depth + 1) - 1
    out = Trees(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), 0.0, depth)
    if not n:
        return out
    rate_1 = np.clip(y.mean(), 0.01, 0.99)
    out.base = float(np.log(rate_1 / (1 - rate_1)))
    if y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m)[None, :] * bins
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth + 1):
            first, width = 2**level - 1, 2**level
            live = (node >= first) & (node < first + width)
            if not live.any():
                break
            at = node[live] - first
            gs, hs = (np.bincount(at, weights=w[live], minlength=width) for w in (g, h))
            out.value[t, first : first + width] = rate * gs / (hs + l2)
            if level == depth:
                break
            cells = (at[:, None] * (m * bins) + flat[live]).ravel()
            sums = [np.bincount(cells, weights=np.repeat(w[live], m), minlength=width * m * bins).reshape(width, m, bins).cumsum(axis=2) for w in (g, h)]
            gl, hl = sums
            gr, hr = gs[:, None, None] - gl, hs[:, None, None] - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs**2 / (hs + l2))[:, None, None]
            gain[(hl < min_hessian) | (hr < min_hessian)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(axis=1) > 1e-6).tolist():
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    out.feature[t, first + k], out.threshold[t, first + k] = f, edges[f][b]
            f = out.feature[t, node]
            go = live & (f >= 0)
            node = np.where(go, 2 * node + 1 + (x[np.arange(n), np.maximum(f, 0)] > out.threshold[t, node]), node)
        margin += out.value[t, node]
    return out


def remainder(id_col: str):
    """crc32 of the id as text, modulo 5; 0 marks held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents, chosen by a hash of the id, none held out.  Of rows that
    repeat an id one is taken, so that ``rows`` bounds what the driver gathers; an id labelled twice has its larger label."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 0))
    chosen = usable.groupBy(F.col(id_col).cast("long").alias("id_")).agg(F.max(label_col).cast("int").alias("y_")).orderBy(F.xxhash64("id_", F.lit(7)), "id_").limit(rows)
    found = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(chosen), "id_")
    found = found.groupBy("id_").agg(F.min_by("text_", F.xxhash64("text_")).alias("text_"), F.max("y_").alias("y_")).select("text_", "y_")

    def run(batches):
        for batch in pieces(batches):
            x = statistics(raw(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = found.mapInArrow(run, "x array<double>, y int").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the same order whatever the partitions
    return x[order], y[order]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on labelled documents that aren't held out.  At most ``rows`` ids are broadcast and gathered.

    Rows without id or label don't count, of rows that repeat an id one is taken, and an id labelled twice has its larger label.
    A null text has the statistics of an empty one, texts of any length are read whole.  Without labelled rows, or with one label
    only, every text scores the base rate (0.5 without rows); other columns may have any names.
    """
    return fit(*sample(docs, labels, id_col, text_col, label_col, rows))


def scores(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Null and empty texts score by their zero statistics.

    A null doc_id isn't held out.  Repeated rows each get their row; texts of any length are read whole; an empty table gives no
    rows; other columns may have any names.
    """
    sent = Sent(docs.sparkSession, trees)

    def run(batches):
        model = sent.get()
        for batch in pieces(batches):
            score = model.score(statistics(raw(batch.column(1))))
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents, all their columns, that score ``threshold`` or more.  Rows pass straight through, whatever their ids, repeated
    ones each; null and empty texts score by their zero statistics, texts of any length are read whole; an empty table stays
    empty; other columns may have any names."""
    sent = Sent(docs.sparkSession, trees)

    def run(batches):
        model = sent.get()
        for batch in pieces(batches):
            yield batch.filter(pa.array(model.score(statistics(raw(batch.column(text_col)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
