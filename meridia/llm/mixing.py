"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) of token totals. Raking
scales the cells until their sums meet the targets of each of the three marginals
in turn: given weights, or else tempered shares. A cell's documents are sampled with its factor as their probability, 1 at most;
what is above 1 stays as their weight, so probability times weight is calibrated and
no rare cell thins out all others. sample() puts the weight into effect by repeating
rows, up to a given number of times; what a cell at that bound cannot hold, other cells of its values take as far as they can.
fit() reports how near the targets were come, as some cannot be met at once. DataFrame functions only; the rounds work on cells, never on
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import join_bounded, stored

MARGINS = ("source", "lang", "topic")
#: Rounds at least and at most, the relative difference that ends them between, and the power of the tempered shares.
ROUNDS, MOST, TOLERANCE, ALPHA = 12, 60, 1e-6, 0.7
#: Rounds between two looks at the difference; a look that finds more than STAGNANT of what the look before found ends the rounds.
EVERY, STAGNANT = 4, 0.99
#: How often sample() puts out a row at most.
COPIES = 16


def topic(text: Column) -> Column:
    """A coarse topic by the look of the text: table, markup, licensed, or prose by length."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("###") | text.contains("$$$") | text.contains("%%%"), "markup")
        .when(F.lower(text).contains("license"), "licensed")
        .when(F.length(text) < 500, "short")
        .when(F.length(text) < 5000, "medium")
        .otherwise("long")
    )


def tokens(text: Column) -> Column:
    """Words of a text, parted by ASCII blanks."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the doc_id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def goals(cells: DataFrame, margin: str, alpha: float, targets: DataFrame | None) -> DataFrame:
    """margin's values with goal_<margin>: what their cells are to sum up to.

    targets(margin, value, weight): the values named there share, by their weights, what the
    margin's other values leave; these keep their share of tokens. A margin without
    targets has shares of tokens to the power alpha. Named values without tokens, null and negative weights are left out.
    """
    total = F.sum("w").over(Window.partitionBy())  # a margin's values: few rows
    by = cells.groupBy(margin).agg(F.sum("w").alias("w"))
    if targets is not None:
        own = targets.where((F.col("margin") == margin) & (F.col("weight") >= 0)).groupBy(F.col("value").alias(margin)).agg(F.sum("weight").cast("double").alias("t"))
        if not own.isEmpty():
            named = by.join(own, margin, "left").withColumn("t", F.when(F.col("w") > 0, F.col("t")))
            every = Window.partitionBy()
            rest = F.sum(F.when(F.col("t").isNotNull(), F.col("w"))).over(every)
            share = F.when(F.sum("t").over(every) > 0, F.col("t") / F.sum("t").over(every)).otherwise(0.0)
            return named.select(margin, F.when(F.col("t").isNull(), F.col("w")).otherwise(rest * share).alias(f"goal_{margin}"))
    shares = by.select(margin, F.when(F.col("w") > 0, F.pow(F.col("w") / total, F.lit(alpha))).otherwise(0.0).alias("s"), total.alias("t"))
    return shares.select(margin, (F.col("t") * F.col("s") / F.sum("s").over(Window.partitionBy())).alias(f"goal_{margin}"))


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, rounds: int = ROUNDS, alpha: float = ALPHA, every: int = EVERY, targets: DataFrame | None = None, most: int = MOST, tolerance: float = TOLERANCE, bound: float | None = None) -> DataFrame:
    """cells(*margins, w) with factor and goal_<margin>: the sums of w * factor meet each marginal's goals.

    `rounds` rounds are made, and more up to `most` while a sum is further from its goal than `tolerance` of it and `every` more
    rounds still bring it nearer: targets that cannot be met at once end early. No factor is above `bound`; where none ends above it
    anyway, the factors are those without it. Values without tokens keep the factor 1. Equal cells are to be one row; an empty table gives no rows.
    """
    cells = stored(cells, "margins")
    if bound is not None:
        free = rake(cells, margins, rounds, alpha, every, targets, most, tolerance)
        if free.where(F.col("factor") > float(bound)).isEmpty():
            return free
    for m in margins:
        cells = cells.join(goals(cells.select(*margins, "w"), m, alpha, targets), m)
    cells = stored(cells.withColumn("factor", F.lit(1.0)), "cells")
    least = (lambda x: x) if bound is None else (lambda x: F.least(x, F.lit(float(bound))))
    i, before = 0, None
    while True:
        for m in margins:
            now = F.sum(F.col("w") * F.col("factor")).over(Window.partitionBy(m))
            cells = cells.withColumn("now", now).withColumn("factor", F.when(F.col("now") > 0, least(F.col("factor") * F.col(f"goal_{m}") / F.col("now"))).otherwise(F.col("factor"))).drop("now")
        i += 1
        if i % every == 0 or i == rounds:
            cells = stored(cells, "cells")
            if i < rounds:
                continue
            far = residual(cells, margins)
            if i >= most or far <= tolerance or (before is not None and far > STAGNANT * before):
                return cells
            before = far


def residual(cells: DataFrame, margins: tuple[str, ...] = MARGINS) -> float:
    """How far the sums of raked cells are from their goals at most, as a share of the goal; 0 without cells."""
    return max((reached(cells, m).agg(F.max(F.abs(F.col("reached") - F.col("goal")) / F.greatest("goal", F.lit(1e-9))).alias("r")).first()["r"] or 0.0 for m in margins), default=0.0)


def reached(cells: DataFrame, margin: str) -> DataFrame:
    """margin, value, goal, reached of raked cells, in tokens."""
    return cells.groupBy(F.col(margin).alias("value")).agg(F.first(f"goal_{margin}").alias("goal"), F.sum(F.col("w") * F.col("factor")).alias("reached")).select(F.lit(margin).alias("margin"), "value", "goal", "reached")


def counted(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """The cells of documents: source, lang, topic and w, their tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(label(source_col).alias("source"), label(lang_col).alias("lang"), topic(text).alias("topic"), tokens(text).alias("n_tokens"))
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("w"))


def fit(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = ROUNDS, alpha: float = ALPHA, targets: DataFrame | None = None, tolerance: float = 1e-3, copies: float | None = None) -> DataFrame:
    """margin, value, goal, reached, met: each value's tokens as they ought to be and as the mixture has them.

    met is false where the two differ by more than `tolerance` of the goal, and where targets name a value that has
    no tokens (goal null): no weights can meet such targets. With `copies` the report is that of sample() with this bound, and false too where the bound
    leaves a goal unmet. Nulls and an empty table as in mix().
    """
    cells = stored(rake(counted(docs, text_col, source_col, lang_col), MARGINS, rounds, alpha, targets=targets, bound=copies), "raked")
    out = reached(cells, MARGINS[0])
    for m in MARGINS[1:]:
        out = out.unionByName(reached(cells, m))
    if targets is not None:
        named = targets.where(F.col("weight") > 0).select("margin", "value").distinct()
        missing = named.join(out.where("reached > 0").select("margin", "value"), ["margin", "value"], "left_anti")
        out = out.unionByName(missing.select("margin", "value", F.lit(None).cast("double").alias("goal"), F.lit(0.0).alias("reached")).join(out.select("margin", "value"), ["margin", "value"], "left_anti"))
    return out.withColumn("met", F.coalesce(F.abs(F.col("reached") - F.col("goal")) <= tolerance * F.col("goal"), F.lit(False)))


def label(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = ROUNDS, alpha: float = ALPHA, targets: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, weight, sampled.

    Null sources and languages count as '', null texts as empty. A document without
    tokens has the probability of its cell; rows that repeat a doc_id are drawn
    alike; a null doc_id draws the number of the empty id. An empty table gives no rows. `targets` as in goals().
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), label(source_col).alias("source"), label(lang_col).alias("lang"), topic(text).alias("topic"), tokens(text).alias("n_tokens")), "mix")
    cells = rake(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("w")), MARGINS, rounds, alpha, targets=targets)
    one = F.lit(1.0)
    chance = cells.select(*MARGINS, F.round(F.least("factor", one), 9).alias("probability"), F.round(F.greatest("factor", one), 9).alias("weight"))
    return join_bounded(rows, chance, list(MARGINS), "inner").select("doc_id", *MARGINS, "n_tokens", "probability", "weight", (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rounds: int = ROUNDS, alpha: float = ALPHA, targets: DataFrame | None = None, copies: float = COPIES) -> DataFrame:
    """The rows of docs, all columns, each as often as its cell's factor says: the whole part of the factor times, and once more with the rest as probability.

    A cell above 1 so grows by repeated rows and one below 1 is thinned, and the tokens of what
    comes out have the target shares. No row comes out more than `copies` times; fit(copies=...) says which goals that leaves unmet.
    The draw goes by the doc_id's number, as in mix().
    Rows without tokens have no share to raise and are not repeated. Null sources, languages and texts count as '';
    rows that repeat a doc_id are drawn alike, a null doc_id draws the number of the empty id; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [f"_mix_{m}" for m in MARGINS]
    factors = rake(counted(docs, text_col, source_col, lang_col), MARGINS, rounds, alpha, targets=targets, bound=copies)
    times = factors.select(*[F.col(m).alias(o) for m, o in zip(MARGINS, own, strict=True)], F.round("factor", 9).alias("_mix_factor"))
    rows = docs.withColumns({own[0]: label(source_col), own[1]: label(lang_col), own[2]: topic(text)})
    factor = F.when(text.rlike(r"[^ \t\n\r]"), F.col("_mix_factor")).otherwise(F.least("_mix_factor", F.lit(1.0)))
    drawn = join_bounded(rows, times, own, "inner").withColumn("_mix_factor", factor)
    whole = F.floor("_mix_factor").cast("int")
    again = (uniform(F.col(id_col).cast("long")) < F.col("_mix_factor") - whole).cast("int")
    return drawn.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(True), whole + again))).select(*docs.columns)


def mix_sql(documents: str, rounds: int = ROUNDS, alpha: float = ALPHA, most: int = MOST) -> str:
    """The CTEs of DuckDB SQL that end in mixed(doc_id, source, lang, topic, n_tokens, probability, weight, sampled)."""
    out = [
        f"""mix_rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '###') OR contains(t, '$$$') OR contains(t, '%%%') THEN 'markup'
    WHEN contains(lower(t), 'license') THEN 'licensed' WHEN length(t) < 500 THEN 'short' WHEN length(t) < 5000 THEN 'medium' ELSE 'long' END AS topic,
  CAST(len(regexp_extract_all(t, '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM {documents}))""",
        "mix_c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS w FROM mix_rows GROUP BY ALL)",
    ]
    for m in MARGINS:
        out += [
            f"mix_m_{m} AS (SELECT {m}, sum(w) AS w FROM mix_c GROUP BY {m})",
            f"mix_s_{m} AS (SELECT {m}, CASE WHEN w > 0 THEN pow(w / sum(w) OVER (), {alpha}) ELSE 0.0 END AS s, sum(w) OVER () AS t FROM mix_m_{m})",
            f"mix_g_{m} AS (SELECT {m}, t * s / sum(s) OVER () AS goal_{m} FROM mix_s_{m})",
        ]
    held = ", ".join([*MARGINS, "w", *(f"goal_{m}" for m in MARGINS)])
    turn = "mix_k"
    for m in MARGINS:
        turn = f"(SELECT k, {held}, CASE WHEN now > 0 THEN factor * goal_{m} / now ELSE factor END AS factor FROM (SELECT *, sum(w * factor) OVER (PARTITION BY {m}) AS now FROM {turn}))"
    out.append(f"mix_k AS (SELECT 0 AS k, {held}, CAST(1.0 AS DOUBLE) AS factor FROM mix_c " + " ".join(f"JOIN mix_g_{m} USING ({m})" for m in MARGINS) + f" UNION ALL SELECT k + 1, {held}, factor FROM {turn} WHERE k < {most})")
    far = " UNION ALL ".join(f"SELECT k, max(abs(r - g) / greatest(g, 1e-9)) AS far FROM (SELECT k, {m}, sum(w * factor) AS r, any_value(goal_{m}) AS g FROM mix_k GROUP BY k, {m}) GROUP BY k" for m in MARGINS)
    looks = f"k >= {rounds} AND (k = {rounds} OR k % {EVERY} = 0)"
    out.append(f"mix_f AS (SELECT k, far, lag(far) OVER (ORDER BY k) AS before FROM (SELECT k, max(far) AS far FROM ({far}) WHERE {looks} GROUP BY k))")
    out.append(f"mix_end AS (SELECT min(k) AS k FROM mix_f WHERE k >= {most} OR far <= {TOLERANCE} OR far > {STAGNANT} * before)")
    out.append(f"mix_p AS (SELECT source, lang, topic, round(least(factor, 1.0), 9) AS probability, round(greatest(factor, 1.0), 9) AS weight FROM mix_k JOIN mix_end USING (k))")
    out.append("""mixed AS (SELECT doc_id, source, lang, topic, n_tokens, probability, weight,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
  FROM mix_rows JOIN mix_p USING (source, lang, topic))""")
    return ",\n".join(out)
