"""Queries over the shop's tables: joins in time, changes, ranks, moving frames, sketches, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import index, merge, ranges, sentences, sketches, temporal
from skein.plans.adapters import table
from skein.sources.shared import shared_dir, stored
from skein.streaming import shop as streams


def whole_cents(column: str) -> Column:
    return F.floor(F.col(column) * 100 + 0.5)


def asof_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the last change of its client at its time or before."""
    clicks = table(spark, d, "clicks").select("click_id", "client_id", "ts", "kind")
    changes = table(spark, d, "client_changes").select("client_id", "valid_at", "seq", "change_id", "op", "segment", "city")
    out = temporal.as_of(clicks, changes, "client_id", "ts", "valid_at", ["seq", "change_id"])
    return out.select("click_id", "client_id", "ts", "kind", F.col("right_change_id").alias("change_id"), F.col("right_valid_at").alias("valid_at"), F.col("right_op").alias("op"), F.col("right_segment").alias("segment"), F.col("right_city").alias("city"))


def client_spans(spark: SparkSession, d: str) -> DataFrame:
    """The time for which each change of a client holds."""
    changes = table(spark, d, "client_changes").select("client_id", "valid_at", "seq", "change_id", "op", "segment")
    return temporal.spans(changes, "client_id", "valid_at", ["seq", "change_id"])


def sale_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sales, from sold to arrived, with each change of the client that held meanwhile."""
    sales = table(spark, d, "sales").select("sale_id", "client_id", "sold_at", "arrived_at", "status")
    held = stored(client_spans(spark, d).select("client_id", "valid_at", "valid_to", "change_id", "segment"), "spans")
    out = temporal.overlaps(sales, held, "client_id", ("sold_at", "arrived_at"), ("valid_at", "valid_to"))
    return out.select("sale_id", "client_id", "sold_at", "arrived_at", "status", F.col("right_change_id").alias("change_id"), F.col("right_segment").alias("segment"), F.col("right_valid_at").alias("valid_at"), F.col("right_valid_to").alias("valid_to"))


def client_merge(spark: SparkSession, d: str) -> DataFrame:
    """Clients after all changes."""
    columns = {"source": "source", "updated_at": "valid_at", "city": "city", "segment": "segment", "balance": "balance"}
    return merge.apply_changes(table(spark, d, "clients"), table(spark, d, "client_changes"), "client_id", ["seq", "change_id"], "op", columns)


def sale_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The place of each sale among all by its total."""
    sales = table(spark, d, "sales").select("sale_id", whole_cents("total").alias("cents"))
    return ranges.ranked(sales, ["cents"], ["sale_id"])


def clicks_half_hour(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the clicks and cents of its client in the half hour up to it, and the clicks of the minute after."""
    clicks = table(spark, d, "clicks").select("click_id", "client_id", "ts", whole_cents("value").alias("cents"))
    out = temporal.moving(clicks, "client_id", "ts", 1800, {"clicks_before": F.count("*"), "cents_before": F.sum("cents"), "most_before": F.max("cents")})
    return out


def click_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches by day, stored and merged by month, held against exact figures."""
    clicks = table(spark, d, "clicks").where("ts is not null").select(F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day"), "client_id", "click_id", whole_cents("value").alias("cents"))
    days = stored(sketches.states(clicks, ["month", "day"], "click_id", "cents", "client_id"), "sketches")
    told = sketches.audited(clicks, sketches.merged(days, ["month"]), ["month"], "click_id", "cents", "client_id")
    within = lambda error, bound: F.coalesce(F.col(error), F.lit(0.0)) <= bound
    return told.select("month", "n_rows", "exact_distinct", within("distinct_error", sketches.DISTINCT_ERROR).alias("distinct_ok"), within("rank_error", sketches.RANK_ERROR).alias("quantiles_ok"), within("count_error", sketches.COUNT_ERROR).alias("items_ok"))


LEVELS = [("status", "priority", "month"), ("status", "month"), ("priority",), ()]


def sale_levels(spark: SparkSession, d: str) -> DataFrame:
    """Sales, cents and distinct clients on four levels."""
    sales = table(spark, d, "sales").select("status", "priority", F.date_format("sold_at", "yyyy-MM").alias("month"), "client_id", whole_cents("total").alias("cents"))
    return sketches.levels(sales, ["status", "priority", "month"], LEVELS, "client_id", {"cents": F.col("cents")})


#: A start of a stream for each of these spans of arrival: before the first bound, and so on.
ARRIVED = ("2024-02-01", "2024-04-01")


def arrivals(rows: DataFrame) -> list[DataFrame]:
    at = F.col("arrived_at")
    bounds = [F.lit(x).cast("timestamp_ntz") for x in ARRIVED]
    return [rows.where(at < bounds[0]), rows.where((at >= bounds[0]) & (at < bounds[1])), rows.where((at >= bounds[1]) | at.isNull())]


def click_windows(spark: SparkSession, d: str) -> DataFrame:
    """Clicks by windows of event time, late ones dropped, as three starts of a stream give them."""
    clicks, at = table(spark, d, "clicks"), f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    for part in arrivals(clicks.select("ts", "kind", "value", "arrived_at")):
        part.drop("arrived_at").write.mode("append").parquet(f"{at}/in")
        streams.finished(streams.appended(streams.windowed(streams.events(spark, f"{at}/in", part.drop("arrived_at"))), f"{at}/out", f"{at}/state"))
    return spark.read.parquet(f"{at}/out")


def clicks_followed(spark: SparkSession, d: str) -> DataFrame:
    """Purchases among the clicks with the sales of the hour after, from two streams."""
    at = f"{shared_dir(spark)}/followed-{uuid.uuid4().hex}"
    clicks = table(spark, d, "clicks").where("kind = 'purchase'").select("click_id", "client_id", "ts", "arrived_at")
    sales = table(spark, d, "sales").select("sale_id", "client_id", "sold_at", "arrived_at")
    for some, others in zip(arrivals(clicks), arrivals(sales), strict=True):
        some.drop("arrived_at").write.mode("append").parquet(f"{at}/clicks")
        others.drop("arrived_at").write.mode("append").parquet(f"{at}/sales")
        met = streams.followed(streams.events(spark, f"{at}/clicks", some.drop("arrived_at")), streams.events(spark, f"{at}/sales", others.drop("arrived_at")))
        streams.finished(streams.appended(met, f"{at}/out", f"{at}/state"))
    return spark.read.parquet(f"{at}/out")


def click_queues(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred clicks of each client, kept as state of a stream over three starts."""
    at = f"{shared_dir(spark)}/queues-{uuid.uuid4().hex}"
    for part in arrivals(table(spark, d, "clicks").select("click_id", "client_id", "ts", "arrived_at")):
        part.drop("arrived_at").write.mode("append").parquet(f"{at}/in")
        streams.finished(streams.queued(streams.events(spark, f"{at}/in", part.drop("arrived_at")), f"{at}/out", f"{at}/state"))
    ids = F.col("ids").cast("array<string>")
    return streams.queues(spark, f"{at}/out").select("client_id", F.size("ids").cast("long").alias("n_kept"), F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"))


def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    """One digest of all documents in order, by a tree over ranges."""
    return index.tree_version(table(spark, d, "documents"), ["doc_id"], F.concat_ws(":", "doc_id", "text"))


#: Abbreviations put into the texts (fixed values of the fixture).
SHORT = ((" of ", " Dr. of "), (" in ", " etc. in "), (" de ", " z.B. de "), (" and ", " No. 5. and "))


def shortened(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for old, new in SHORT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


def sentence_model(spark: SparkSession, d: str) -> DataFrame:
    """Abbreviations that the texts tell, with their scores."""
    return sentences.abbreviations(shortened(spark, d)).select("word", "with_stop", "without_stop", F.round("score", 3).alias("score"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the texts by the abbreviations that they tell."""
    rows = shortened(spark, d)
    known = stored(sentences.abbreviations(rows).select("word"), "abbreviations")
    return sentences.split(rows, ["doc_id"], known).select("doc_id", "sentence_no", F.md5("sentence").alias("sentence_md5"))


ALL = (corpus_digest, sentence_model, sentence_split, click_sketches, sale_levels, click_windows, clicks_followed, click_queues, asof_changes, client_spans, sale_spans, client_merge, sale_ranks, clicks_half_hour)

SPANS = """
h AS (
  SELECT client_id, valid_at, max(seq) AS seq, max_by(change_id, seq * 4294967296 + change_id) AS change_id, max_by(op, seq * 4294967296 + change_id) AS op,
         max_by(ROW(segment), seq * 4294967296 + change_id) AS segment
  FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY client_id, valid_at),
s AS (SELECT client_id, valid_at, seq, change_id, op, segment[1] AS segment, lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at) AS valid_to FROM h)
"""

RANKED = """
SELECT sale_id, cents, row_number() OVER (ORDER BY cents NULLS FIRST, sale_id NULLS FIRST) AS row_no, rank() OVER (ORDER BY cents NULLS FIRST) AS rank,
       percent_rank() OVER (ORDER BY cents NULLS FIRST) AS percent_rank, ntile(100) OVER (ORDER BY cents NULLS FIRST, sale_id NULLS FIRST) AS tile
FROM (SELECT sale_id, CAST(floor(total * 100 + 0.5) AS BIGINT) AS cents FROM sales)
"""

TYPED = r"regexp_replace(regexp_replace(lower(%s), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$', '', 'g'), '\.{2,}$', '')"
SHORTENED = "replace(replace(replace(replace(coalesce(text, ''), " + "), ".join(f"'{a}', '{b}'" for a, b in SHORT) + ")"
MODEL = rf"""x AS (SELECT doc_id, {SHORTENED} AS text FROM documents),
tok AS (SELECT {TYPED % 'token'} AS t FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS token FROM x)),
cnt AS (SELECT CASE WHEN ends_with(t, '.') THEN left(t, length(t) - 1) ELSE t END AS word, count(*) AS n, count(*) FILTER (ends_with(t, '.')) AS k FROM tok GROUP BY 1),
al AS (SELECT sum(n) AS all_n, sum(k) AS all_k FROM cnt),
sc AS (
  SELECT word, k, n - k AS without, 2 * (k * ln(0.99) + (n - k) * ln(1 - 0.99) - (k * ln(all_k / all_n) + (n - k) * ln(1 - all_k / all_n))) * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
         * pow(length(replace(word, '.', '')), k - n) AS score
  FROM cnt, al WHERE k > 0 AND regexp_matches(word, '\p{{L}}') AND all_k < all_n),
ab AS (SELECT * FROM sc WHERE score >= 0.3)"""

MERGED = """
WITH c AS (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq, change_id) AS n FROM (SELECT DISTINCT * FROM client_changes)
  WHERE client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL AND op IN ('I', 'U', 'D')),
g AS (SELECT client_id, max(n) AS last, max(n) FILTER (op = 'D') AS gone FROM c GROUP BY client_id),
a AS (
  SELECT client_id, last, gone,
    max_by(source, n) FILTER (fresh AND source IS NOT NULL) AS source, max_by(valid_at, n) FILTER (fresh AND valid_at IS NOT NULL) AS valid_at, max_by(city, n) FILTER (fresh AND city IS NOT NULL) AS city,
    max_by(segment, n) FILTER (fresh AND segment IS NOT NULL) AS segment, max_by(balance, n) FILTER (fresh AND balance IS NOT NULL) AS balance
  FROM (SELECT c.*, last, gone, op <> 'D' AND n > coalesce(gone, 0) AS fresh FROM c JOIN g USING (client_id)) GROUP BY client_id, last, gone)
SELECT coalesce(b.client_id, a.client_id) AS client_id, CASE WHEN gone IS NULL THEN master_id END AS master_id, coalesce(a.source, CASE WHEN gone IS NULL THEN b.source END) AS source,
       coalesce(valid_at, CASE WHEN gone IS NULL THEN updated_at END) AS updated_at, CASE WHEN gone IS NULL THEN name END AS name, CASE WHEN gone IS NULL THEN email END AS email,
       coalesce(a.city, CASE WHEN gone IS NULL THEN b.city END) AS city, CASE WHEN gone IS NULL THEN nation_id END AS nation_id,
       coalesce(a.segment, CASE WHEN gone IS NULL THEN b.segment END) AS segment, coalesce(a.balance, CASE WHEN gone IS NULL THEN b.balance END) AS balance,
       CASE WHEN last IS NULL THEN 'same' WHEN gone = last THEN 'delete' WHEN b.k IS NULL THEN 'insert' WHEN gone IS NOT NULL THEN 'replace' ELSE 'update' END AS action
FROM (SELECT *, 1 AS k FROM clients) b FULL JOIN a ON a.client_id = b.client_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "asof_changes": f"""WITH {SPANS}, w AS (
  SELECT client_id, valid_at, change_id, op, max_by(ROW(segment, city), seq * 4294967296 + change_id) AS x FROM client_changes SEMI JOIN s USING (client_id, valid_at, change_id) GROUP BY ALL)
SELECT click_id, c.client_id, c.ts, kind, change_id, valid_at, op, x[1] AS segment, x[2] AS city FROM clicks c ASOF LEFT JOIN w ON c.client_id = w.client_id AND c.ts >= w.valid_at""",
        "client_spans": f"WITH {SPANS} SELECT client_id, valid_at, seq, change_id, op, segment, valid_to FROM s",
        "sale_spans": f"""WITH {SPANS}
SELECT sale_id, l.client_id, sold_at, arrived_at, status, change_id, segment, valid_at, valid_to FROM sales l JOIN s ON l.client_id = s.client_id AND sold_at <= arrived_at
  AND (sold_at < coalesce(valid_to, TIMESTAMP '2200-01-01') OR sold_at = valid_at) AND (valid_at < arrived_at OR sold_at = valid_at)""",
        "click_sketches": """
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_rows, count(DISTINCT click_id) AS exact_distinct, true AS distinct_ok, true AS quantiles_ok, true AS items_ok FROM clicks WHERE ts IS NOT NULL GROUP BY ALL""",
        "sale_levels": """
SELECT CAST(grouping_id(status, priority, month) AS INTEGER) AS level, status, priority, month, count(DISTINCT client_id) AS n_distinct, count(*) AS n_rows, CAST(sum(CAST(floor(total * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
FROM (SELECT *, strftime(sold_at, '%Y-%m') AS month FROM sales) GROUP BY GROUPING SETS ((status, priority, month), (status, month), (priority), ())""",
        "click_windows": f"""
WITH c AS (SELECT *, CASE WHEN arrived_at < TIMESTAMP '{ARRIVED[0]}' THEN 0 WHEN arrived_at < TIMESTAMP '{ARRIVED[1]}' THEN 1 ELSE 2 END AS b, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start FROM clicks),
w AS (SELECT b, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY b)) - INTERVAL 1 DAY AS mark FROM c GROUP BY b),
kept AS (SELECT c.* FROM c LEFT JOIN w ON w.b = c.b - 1 WHERE ts IS NOT NULL AND (mark IS NULL OR start + INTERVAL 6 HOURS > mark))
SELECT start, kind, count(*) AS n_clicks, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM kept WHERE start + INTERVAL 6 HOURS <= (SELECT max(mark) FROM w) GROUP BY ALL""",
        "clicks_followed": """
SELECT click_id, sale_id, c.client_id, ts, sold_at FROM clicks c JOIN sales s ON c.client_id = s.client_id AND sold_at >= ts AND sold_at <= ts + INTERVAL 1 HOUR WHERE kind = 'purchase'""",
        "click_queues": """
SELECT client_id, count(*) AS n_kept, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY n)) AS ids_sha256
FROM (SELECT client_id, click_id, row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, click_id DESC) AS n FROM (SELECT DISTINCT client_id, ts, click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)) WHERE n <= 100 GROUP BY client_id""",
        "corpus_digest": """
WITH RECURSIVE lv AS (
  SELECT row_number() OVER (ORDER BY doc_id, d) - 1 AS i, d, count(*) OVER () AS n FROM (SELECT doc_id, sha256(coalesce(concat_ws(':', doc_id, text), '')) AS d FROM documents)
  UNION ALL SELECT i // 256, sha256(string_agg(d, '' ORDER BY i)), (n + 255) // 256 FROM lv WHERE n > 1 GROUP BY i // 256, n)
SELECT (SELECT count(*) FROM documents) AS n_rows, d AS digest FROM lv WHERE n = 1""",
        "sentence_model": f"WITH {MODEL} SELECT word, k AS with_stop, without AS without_stop, round(score, 3) AS score FROM ab",
        "sentence_split": rf"""WITH {MODEL},
pt AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS part FROM (SELECT doc_id, string_split(regexp_replace(trim(text, E' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM x WHERE trim(text, E' \t\n\r') <> '')),
wd AS (SELECT *, {TYPED % "regexp_extract(part, '(\\S+)$', 1)"} AS w, coalesce(lead(part) OVER (PARTITION BY doc_id ORDER BY i), '') AS nxt FROM pt),
fl AS (SELECT *, ends_with(w, '.') AND (left(w, length(w) - 1) IN (SELECT word FROM ab) OR (regexp_matches(left(w, length(w) - 1), '^\p{{N}}+$') AND regexp_matches(nxt, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}'))) AS on_ FROM wd),
nm AS (SELECT *, 1 + coalesce(sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence_no FROM fl)
SELECT doc_id, CAST(sentence_no AS BIGINT) AS sentence_no, md5(string_agg(part, ' ' ORDER BY i)) AS sentence_md5 FROM nm GROUP BY doc_id, sentence_no""",
        "client_merge": MERGED,
        "sale_ranks": RANKED,
        "clicks_half_hour": """
SELECT click_id, client_id, ts, cents, CASE WHEN known THEN count(*) OVER w END AS clicks_before, CASE WHEN known THEN CAST(sum(cents) OVER w AS BIGINT) END AS cents_before, CASE WHEN known THEN max(cents) OVER w END AS most_before
FROM (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, client_id IS NOT NULL AND ts IS NOT NULL AS known FROM clicks)
WINDOW w AS (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW)""",
    }
