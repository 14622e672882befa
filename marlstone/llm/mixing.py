"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by source, language and topic; the cells' weights are raked until each of the three
margins has its target shares.  A document is then kept with a probability in proportion to its cell's
weight over its cell's tokens, scaled so that the expected tokens meet the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.common import BROADCAST_ROWS, Staged, lookup, table, text_of, unused

MARGINS = ("source", "lang", "topic")
#: A margin's target shares go with its token shares to this power: 1 leaves them, 0 makes them equal.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 20
SCALE_ROUNDS = 12
#: Rounds in one plan; longer plans cost more to compile than a written table.
ROUNDS_A_PLAN = 5
BUDGET = 0.5
NONE = "(none)"


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the make-up of a text; the first that holds."""
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when(F.instr(text, "icense") > 0, "legal")
        .when(F.instr(text, "@") > 0, "contact")
        .when(text.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def draw(doc_id: Column) -> Column:
    """A fixed number from [0, 1) for each id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def features() -> Column:
    """(source, lang, topic, tokens) of a document; null source and language as one value."""
    text = text_of()
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return F.struct(none("source"), none("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"))


def _targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, share): shares of the margin's tokens to a power, adding up to one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("_sum"))
    raised = sums.select(margin, F.when(F.col("_sum") > 0, F.pow(F.col("_sum").cast("double"), F.lit(power))).otherwise(0.0).alias("_part"))
    total = raised.agg(F.sum("_part").alias("_all"))
    return raised.join(F.broadcast(total)).select(margin, (F.col("_part") / F.nullif("_all", F.lit(0.0))).alias(f"target_{margin}"))


def rake(cells: DataFrame, rounds: int = ROUNDS, temperatures: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, staged: Staged | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens, ...) with the target of each margin and ``share``, the raked
    share of all tokens.

    ``targets`` can give (margin, target_<margin>) tables; otherwise they follow from the temperatures. A
    margin value without a target gets none of the weight. The cells are raked in one partition if they are
    few (their number is read first), else each margin's sums are shuffled and joined back, which takes any
    number of cells. After the rounds the last margin is met exactly and the others up to :func:`residual`.
    """
    staged = staged or Staged(cells.sparkSession, "rake")
    temperatures = temperatures or TEMPERATURES
    for m in MARGINS:
        goal = staged.keep((targets or {}).get(m, _targets(cells, m, temperatures[m])), f"target_{m}")
        cells = lookup(cells, goal, m)
    total = Window.partitionBy()
    few = cells.count() <= BROADCAST_ROWS
    start = F.col("tokens").cast("double")
    if few:
        now = cells.coalesce(1).withColumn("share", start / F.nullif(F.sum(start).over(total), F.lit(0.0)))
    else:
        every = cells.agg(F.sum(start).alias("_all"))
        now = cells.join(F.broadcast(every)).withColumn("share", start / F.nullif("_all", F.lit(0.0))).drop("_all")
    now = staged.keep(now, "cells")
    for done in range(0, rounds, ROUNDS_A_PLAN if few else 1):
        before = now
        now = now.coalesce(1) if few else now
        for _ in range(min(ROUNDS_A_PLAN, rounds - done) if few else 1):
            for m in MARGINS:
                if few:
                    sums = F.sum("share").over(Window.partitionBy(m))
                    now = now.withColumn("share", F.coalesce(F.col("share") * F.col(f"target_{m}") / F.nullif(sums, F.lit(0.0)), F.lit(0.0)))
                else:
                    sums = staged.keep(now.groupBy(m).agg(F.sum("share").alias("_sum")), "sums")
                    now = lookup(now, sums, m).withColumn("share", F.coalesce(F.col("share") * F.col(f"target_{m}") / F.nullif("_sum", F.lit(0.0)), F.lit(0.0))).drop("_sum")
        now = staged.keep(now, "cells")
        staged.drop(before)
    return now


def probabilities(cells: DataFrame, budget: float = BUDGET, rounds: int = SCALE_ROUNDS) -> DataFrame:
    """Raked ``cells`` with ``weight`` (target share over actual share) and ``prob``, at most one.

    The scale is set so that the expected tokens are ``budget`` of all, what cells that are kept whole lack
    going to the others. A cell without tokens costs nothing and is kept.
    """
    all_tokens = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    rate = F.col("share") * F.lit(all_tokens) / F.nullif("tokens", F.lit(0))
    scale = budget
    for _ in range(rounds if all_tokens else 0):
        full = rate * F.lit(scale) >= 1.0
        capped, rest = cells.where("tokens > 0").agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0))
        ).first()
        after = (budget * all_tokens - capped) / (rest * all_tokens) if rest > 0 else scale
        if after == scale:
            break
        scale = max(after, 0.0)
    return cells.withColumns({"weight": rate, "prob": F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * F.lit(scale))).otherwise(1.0)})


def residual(raked: DataFrame) -> float:
    """The greatest difference of a margin's raked share from its target; 0 of no cells."""
    worst = 0.0
    for m in MARGINS:
        sums = raked.groupBy(m).agg(F.sum("share").alias("share"), F.first(f"target_{m}").alias("target"))
        worst = max(worst, sums.agg(F.max(F.abs(F.col("share") - F.col("target")))).first()[0] or 0.0)
    return worst


def _with_weights(tagged: DataFrame, mix: str, budget: float, staged: Staged) -> DataFrame:
    """``tagged`` (its cell in the column ``mix``) with weight, prob and sampled."""
    cells = tagged.select(f"`{mix}`.*").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    cells = staged.keep(probabilities(rake(staged.keep(cells, "counts"), staged=staged), budget), "probable")
    key = unused("cell", tagged)
    name = lambda c: F.concat_ws("\x1f", *[F.col(c(m)) for m in MARGINS]).alias(key)
    by_cell = staged.keep(cells.select(name(lambda m: m), "weight", "prob"), "by_cell")
    plain = [F.col(f"`{c}`") for c in tagged.columns]
    out = lookup(tagged.select(*plain, name(lambda m: f"`{mix}`.{m}")), by_cell, key)
    return out.select(*plain, "weight", "prob", (draw(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def mixed(docs: DataFrame, budget: float = BUDGET, mix: str = "mix") -> DataFrame:
    """``docs`` with ``mix`` (its source, lang, topic and tokens), weight, prob, and sampled (whether it is drawn).

    The draw depends on doc_id alone: repeated rows are drawn together, null ids all alike. Null texts are
    empty, null sources and languages one value each. An empty table gives an empty result; other columns stay, and
    those of the names of the new ones are replaced.
    """
    rest = docs.drop(mix, "weight", "prob", "sampled")
    return _with_weights(rest.withColumn(mix, features()), mix, budget, Staged(docs.sparkSession, "mixing"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, weight, probability and draw of every document. Texts are read once, for the staged cells."""
    staged = Staged(spark, "mixing")
    tagged = staged.keep(table(spark, sf_dir, "documents").select("doc_id", features().alias("mix")), "tagged")
    out = _with_weights(tagged, "mix", BUDGET, staged)
    return out.select("doc_id", "mix.*", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "sampled")


def _oracle() -> str:
    """The same by unrolled common table expressions."""
    step = []
    for m in MARGINS:
        step.append(
            f"target_{m} AS (SELECT {m}, p / nullif(sum(p) OVER (), 0) AS target_{m} FROM (SELECT {m}, CASE WHEN sum(tokens) > 0 "
            f"THEN pow(sum(tokens)::DOUBLE, {TEMPERATURES[m]}) ELSE 0 END AS p FROM counts GROUP BY {m}))"
        )
    step.append(
        "w0 AS MATERIALIZED (SELECT c.*, target_source, target_lang, target_topic, tokens::DOUBLE / nullif(sum(tokens::DOUBLE) OVER (), 0) AS share "
        "FROM counts c JOIN target_source USING (source) JOIN target_lang USING (lang) JOIN target_topic USING (topic))"
    )
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            step.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(share * target_{m} / nullif(sum(share) OVER (PARTITION BY {m}), 0), 0) AS share) FROM w{n})")
            n += 1
    step.append(f"r AS MATERIALIZED (SELECT *, sum(tokens) OVER ()::DOUBLE AS total, share * (sum(tokens) OVER ())::DOUBLE / nullif(tokens, 0) AS rate FROM w{n})")
    step.append(f"s0 AS MATERIALIZED (SELECT {BUDGET}::DOUBLE AS scale)")
    for i in range(SCALE_ROUNDS):
        step.append(
            f"s{i + 1} AS MATERIALIZED (SELECT greatest(CASE WHEN coalesce(sum(share) FILTER (rate * scale < 1), 0) > 0 THEN "
            f"({BUDGET} * max(total) - coalesce(sum(tokens) FILTER (rate * scale >= 1), 0)) / (sum(share) FILTER (rate * scale < 1) * max(total)) "
            f"ELSE max(scale) END, 0) AS scale FROM r, s{i} WHERE tokens > 0)"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, "
        "CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, 'icense') THEN 'legal' WHEN contains(t, '@') THEN 'contact' "
        "WHEN regexp_matches(t, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic, "
        "len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)), "
        "counts AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL), " + ", ".join(step) +
        " SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(r.rate, 6) AS weight, "
        "round(CASE WHEN r.tokens > 0 THEN least(1.0, r.rate * scale) ELSE 1.0 END, 6) AS prob, "
        "('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 "
        "< CASE WHEN r.tokens > 0 THEN least(1.0, r.rate * scale) ELSE 1.0 END AS sampled "
        f"FROM d JOIN r ON d.source = r.source AND d.lang = r.lang AND d.topic = r.topic, s{SCALE_ROUNDS}"
    )


ORACLE = _oracle()
