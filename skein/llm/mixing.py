"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, in DataFrame operations only.

Token weights are summed into cells, one per combination of the margins' values, before anything else; the raking
works on the cells, and the documents are only scanned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored

#: Topics by rule, the first that holds (fixed values of the default topic margin): name and SQL condition on ``text``.
TOPICS = (
    ("licence", "text LIKE '%Licensed under%'"),
    ("listing", "text LIKE '% | %'"),
    ("contact", "text LIKE '%@%'"),
    ("note", "length(text) < 600"),
)
OTHER_TOPIC = "prose"
#: Cells that one task rakes; more are dealt by the margins' values.
ONE_TASK_CELLS = 200_000
#: Difference of a share from its target that is good enough, and by what factor some rounds must lessen it to go on.
TOLERANCE, SETTLED = 1e-4, 0.98
WORD = r"[^\x09-\x0D\x20]+"
NONE = "(none)"


def topic(text_col: str = "text") -> Column:
    """The topic of a text by TOPICS; null text is a note."""
    cases = " ".join(f"WHEN {rule.replace('text', f'`{text_col}`')} THEN '{name}'" for name, rule in TOPICS)
    return F.expr(f"CASE WHEN `{text_col}` IS NULL THEN 'note' {cases} ELSE '{OTHER_TOPIC}' END")


def n_tokens(text_col: str = "text") -> Column:
    """Weight of a document: its words between ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def cells(docs: DataFrame, margins: Mapping[str, Column], tokens: Column) -> DataFrame:
    """Sum of tokens for each combination of margin values; null values form a value of their own."""
    return docs.select(*[F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"m_{k}") for k, c in margins.items()], tokens.alias("tokens")).groupBy(*[f"m_{k}" for k in margins]).agg(F.sum("tokens").alias("tokens"))


def aimed(of_cells: DataFrame, names: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None, alpha: float) -> DataFrame:
    """Cells that have tokens, with ``total``, a target share ``t_*`` for each margin's value, and ``weight``, their tokens.

    Targets are shares by value, normalised; values without one get 0.  A margin without targets aims at its own shares to
    the power ``alpha``, normalised (1 keeps the mix, 0 makes values equal).
    """
    out = of_cells.where("tokens > 0")
    seen = out.agg(F.count("*").alias("n"), F.sum("tokens").cast("double").alias("total")).first()
    out = (out.coalesce(1) if seen.n <= ONE_TASK_CELLS else out).withColumn("total", F.lit(seen.total))
    for k in names:
        if targets and k in targets:
            pairs = [x for v, share in targets[k].items() for x in (F.lit(v), F.lit(float(share)))]
            out = out.withColumn(f"t_{k}", F.coalesce(F.create_map(*pairs)[F.col(f"m_{k}")], F.lit(0.0)) / sum(targets[k].values()))
        else:
            powered = F.pow(F.sum("tokens") / F.lit(seen.total), F.lit(alpha))
            norm = of_cells.where("tokens > 0").groupBy(f"m_{k}").agg(powered.alias("p")).agg(F.sum("p")).first()[0]
            own = F.sum("tokens").over(Window.partitionBy(f"m_{k}"))
            out = out.withColumn(f"t_{k}", F.pow(own / F.col("total"), F.lit(alpha)) / F.lit(norm))
    return out.withColumn("weight", F.col("tokens").cast("double"))


def rounds_of(out: DataFrame, names: Sequence[str], rounds: int) -> DataFrame:
    """A round scales each margin in turn by target over present share.  Few cells are raked by one task without a shuffle,
    more by the margins' values."""
    for _ in range(rounds):
        for k in names:
            present = F.sum("weight").over(Window.partitionBy(f"m_{k}"))
            out = out.withColumn("weight", F.when(present > 0, F.col("weight") * F.col(f"t_{k}") * F.col("total") / present).otherwise(F.lit(0.0)))
    return out


def residuals(raked: DataFrame, names: Sequence[str]) -> DataFrame:
    """(margin, value, target, share) of raked cells: how far each margin is from its targets."""
    out = None
    for k in names:
        one = raked.groupBy(F.lit(k).alias("margin"), F.col(f"m_{k}").alias("value")).agg(F.max(f"t_{k}").alias("target"), (F.sum("weight") / F.max("total")).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def rake(of_cells: DataFrame, names: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None, alpha: float, rounds: int, tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """Cells with ``total``, targets and ``weight``, stored: tokens scaled so that each margin's shares meet its targets.

    After every ``rounds`` rounds the largest difference of a share from its target is looked at: raking ends when it is at
    most ``tolerance``, or no longer falls, as with targets that can't be met together.  With ``strict`` those raise.
    """

    def off(cells: DataFrame) -> float:
        return residuals(cells, names).agg(F.max(F.abs(F.col("target") - F.col("share")))).first()[0] or 0.0

    out = stored(rounds_of(aimed(of_cells, names, targets, alpha), names, rounds), "raked")
    now = off(out)
    while now > tolerance:
        few = out.count() <= ONE_TASK_CELLS
        following = stored(rounds_of(out.coalesce(1) if few else out, names, rounds), "raked")
        after = off(following)
        if after > now * SETTLED:
            break
        out, now = following, after
    if strict and now > tolerance:
        raise ValueError(f"the targets can't be met together: a share is off by {now:.4f}")
    return out


def calibrate(raked: DataFrame, keep_share: float | None) -> DataFrame:
    """Cells with ``probability``.

    Without ``keep_share``, the largest sample whose expected mix is the raked one exactly: weight over tokens,
    divided by its maximum.  With it, about that share of all tokens is kept: probabilities are in proportion to
    weight over tokens and capped at 1, the factor raised until the expected tokens come out right.
    """
    ratio = F.col("weight") / F.col("tokens")
    seen = raked.agg(F.max(ratio).alias("most"), F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens")).first()
    if not seen.most:
        return raked.withColumn("probability", F.lit(1.0))
    factor = 1 / seen.most
    if keep_share is not None:
        factor = seen.tokens * keep_share / seen.weight
        while True:
            capped = F.coalesce(ratio * F.lit(factor) >= 1, F.lit(False))
            now = raked.agg(F.sum(F.when(capped, F.col("tokens"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("rest")).first()
            following = (seen.tokens * keep_share - (now.full or 0)) / now.rest if now.rest else factor
            if following <= factor:
                break
            factor = following
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(factor)))


def uniform(id_col: str, seed: int, text_col: str = "text") -> Column:
    """A number in [0, 1) from the MD5 of seed and id, or text where there is no id: the same for the same document in any run."""
    told = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.col(f"`{text_col}`")), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), told).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def margins_of(docs: DataFrame, source_col: str, lang_col: str, topic_col: str | None, text_col: str) -> dict[str, Column]:
    return {"source": F.col(source_col), "lang": F.col(lang_col), "topic": F.col(topic_col) if topic_col else topic(text_col)}


def decided(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = 0.7, rounds: int = 8, keep_share: float | None = None, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """(doc, topic, probability, sampled): each document as a struct of all its columns, with its margin value, its chance,
    and whether the sample takes it.

    Null source, language or topic is a value of its own; a document whose cell has no tokens gets probability 1
    (it changes no mix); repeated rows of an id share one decision, and so do rows without id and with equal texts; texts of
    any length are counted whole; an empty table stays empty; other columns may have any names.
    """
    margins = margins_of(docs, source_col, lang_col, topic_col, text_col)
    summed = stored(cells(docs, margins, n_tokens(text_col)), "cells")
    chances = calibrate(rake(summed, list(margins), targets, alpha, rounds, tolerance, strict), keep_share)
    keys = [f"m_{k}" for k in margins]
    known = stored(chances.select(*keys, F.round("probability", 9).alias("chance")), "chances")
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(packed.alias("doc"), uniform(id_col, seed, text_col).alias("u"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"m_{k}") for k, c in margins.items()])
    chance = F.coalesce("chance", F.lit(1.0))
    return marked.join(known, keys, "left").select("doc", F.col("m_topic").alias("topic"), chance.alias("probability"), (F.col("u") < chance).alias("sampled"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, that the calibrated sample takes."""
    return decided(docs, **options).where("sampled").select("doc.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability (6 decimals), sampled."""
    field = lambda name: F.col(f"doc.`{options.get(name + '_col', 'doc_id' if name == 'id' else name)}`")
    words = F.regexp_count(F.coalesce(field("text"), F.lit("")), F.lit(WORD)).cast("long")
    return decided(docs, **options).select(field("id").alias("doc_id"), field("source").alias("source"), field("lang").alias("lang"), "topic", words.alias("n_tokens"), F.round("probability", 6).alias("probability"), "sampled")


def report_sql(alpha: float = 0.7, rounds: int = 8, seed: int = 13) -> str:
    """DuckDB SQL for ``report`` with its defaults."""
    cases = " ".join(f"WHEN {rule.replace('text', 't')} THEN '{name}'" for name, rule in TOPICS)
    names = ("source", "lang", "topic")
    steps = [
        f"d AS (SELECT doc_id, text, source, lang, coalesce(source, '{NONE}') AS m_source, coalesce(lang, '{NONE}') AS m_lang, CASE {cases} ELSE '{OTHER_TOPIC}' END AS m_topic, "
        "CAST(len(regexp_extract_all(t, '[^\\x09-\\x0D\\x20]+')) AS BIGINT) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "c AS (SELECT m_source, m_lang, m_topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM c)",
    ]
    for k in names:
        steps.append(f"g_{k} AS (SELECT m_{k}, pow(sum(tokens) / any_value(total), {alpha}) AS p FROM c, tot GROUP BY m_{k})")
        steps.append(f"t_{k} AS (SELECT m_{k}, p / sum(p) OVER () AS t_{k} FROM g_{k})")
    steps.append("w0 AS (SELECT m_source, m_lang, m_topic, tokens, total, t_source, t_lang, t_topic, CAST(tokens AS DOUBLE) AS weight FROM c CROSS JOIN tot JOIN t_source USING (m_source) JOIN t_lang USING (m_lang) JOIN t_topic USING (m_topic))")
    for i in range(rounds * 3):
        k = names[i % 3]
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (weight * t_{k} * total / sum(weight) OVER (PARTITION BY m_{k}) AS weight) FROM w{i})")
    steps.append(f"p AS (SELECT m_source, m_lang, m_topic, round(least(1.0, weight / tokens / max(weight / tokens) OVER ()), 9) AS probability FROM w{rounds * 3})")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, m_topic AS topic, n_tokens, round(coalesce(probability, 1.0), 6) AS probability, "
        f"CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, '')), 1, 13)) AS BIGINT) / CAST({16**13} AS DOUBLE) < coalesce(probability, 1.0) AS sampled "
        "FROM d LEFT JOIN p USING (m_source, m_lang, m_topic)"
    )
