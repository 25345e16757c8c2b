"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values that a margin doesn't list share this class, so there are at most as many
#: cells as the product of the margins' sizes, whatever the data hold.
OTHER = "(other)"
#: The range of the hash that decides on a row: 52 bits.
HASH_RANGE = 1 << 52
#: Less than this, left of 1 by listed shares, is rounding and no share.
NO_SHARE = 1e-9


def word_count(text: Column) -> Column:
    """Words: maximal runs of characters other than ASCII white space. Null: 0."""
    blanks = " \t\n\x0b\x0c\r"
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(blanks))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _full(margins: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """The margins with a share for ``OTHER``: what the listed shares leave of 1."""
    out = {}
    for name, shares in margins.items():
        if not shares or min(shares.values()) < 0:
            raise ValueError(f"margin {name} needs shares of 0 or more")
        out[name] = dict(shares) | ({} if OTHER in shares else {OTHER: max(0.0, 1 - sum(shares.values()))})
    return out


def _leaves_nothing(shares: dict[str, float]) -> bool:
    """Whether the shares give ``OTHER`` none: they don't name it and take all of 1."""
    return OTHER not in shares and 1 - sum(shares.values()) < NO_SHARE


def rake(cells: DataFrame, margins: dict[str, dict[str, float]], fraction: float, sweeps: int = 15, fills: int = 10) -> DataFrame:
    """Probabilities for ``cells``: one row for each combination of margin values, with its ``tokens``.

    All steps are window sums over the cells in a single partition, which holds no more
    rows than the margins allow. Each sweep scales the weights to one margin after
    another. The weights' ratios to the natural shares are then scaled to keep
    ``fraction`` of all tokens: cells whose probability reaches 1 are filled and the
    rest scaled up again, ``fills`` times. Adds ``weight`` (its raked share) and ``p``.

    Where a margin's listed shares take all of 1, ``OTHER`` has the share of the tokens
    that it has in ``cells``, and the listed values divide the rest by their shares. If
    no cell has a share above 0 in every margin, all probabilities are 0.
    """
    names = list(_full(margins))
    everything = W.partitionBy(F.lit(1))
    now = cells.where("tokens > 0").coalesce(1)
    now = now.withColumn("_share", F.col("tokens") / F.sum("tokens").over(everything))
    for k, (name, shares) in enumerate(_full(margins).items()):
        target = F.coalesce(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]).getItem(F.col(name)), F.lit(0.0))
        now = now.withColumn(f"_t{k}", target)
    # shares of values that no row has go to the others in proportion
    for k, name in enumerate(names):
        now = now.withColumn(f"_n{k}", F.count(F.lit(1)).over(W.partitionBy(name)))
    for k in range(len(names)):
        total = F.sum(F.col(f"_t{k}") / F.col(f"_n{k}")).over(everything)
        now = now.withColumn(f"_t{k}", F.when(total > 0, F.col(f"_t{k}") / total).otherwise(0.0))
    # listed shares that leave nothing: the other values keep the share that they have
    for k, (name, shares) in enumerate(margins.items()):
        if _leaves_nothing(shares):
            mass = lambda of: F.sum(F.when(of, F.col("_share")).otherwise(0.0)).over(everything)
            other = F.col(name) == OTHER
            listed = F.when(mass(other) > 0, F.col(f"_t{k}") * mass(~other)).otherwise(F.col(f"_t{k}"))
            now = now.withColumn(f"_t{k}", F.when(other, mass(other)).otherwise(listed))
    now = now.withColumn("weight", F.col("_share"))
    for _ in range(sweeps):
        for k, name in enumerate(names):
            mass = F.sum("weight").over(W.partitionBy(name))
            now = now.withColumn("weight", F.when(mass > 0, F.col("weight") * F.col(f"_t{k}") / mass).otherwise(0.0))
    total = F.sum("weight").over(everything)
    now = now.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0))
    now = now.withColumns({"_r": F.col("weight") / F.col("_share"), "_s": F.lit(float(fraction))})
    for _ in range(fills):
        filled = F.sum(F.when(F.col("_s") * F.col("_r") >= 1, F.col("_share")).otherwise(0.0)).over(everything)
        open_ = F.sum(F.when(F.col("_s") * F.col("_r") < 1, F.col("weight")).otherwise(0.0)).over(everything)
        now = now.withColumn("_s", F.when(open_ > 0, F.greatest(F.col("_s"), (F.lit(float(fraction)) - filled) / open_)).otherwise(F.col("_s")))
    return now.withColumn("p", F.least(F.lit(1.0), F.col("_s") * F.col("_r"))).select(*names, "tokens", "weight", "p")


def mix(docs: DataFrame, margins: dict[str, tuple[Column, dict[str, float]]], fraction: float, tokens: Column, id_col: str = "doc_id", seed: str = "mix", sweeps: int = 15) -> DataFrame:
    """``docs`` with the probability that brings their tokens to the target margins, and the draw.

    ``margins``: for each name an expression for a row's value and the target share of
    each value. Other values, and null, count as one class that has what is left of 1.
    If nothing is left, it has the share of the tokens that it has in ``docs``, and the
    listed values divide the rest; only a share of 0 that names it (``OTHER``) drops it.
    Tokens are summed by cell (a combination of values; combined before the shuffle),
    the cells raked, and the cells' probabilities broadcast: there are at most as many
    as the margins' sizes multiplied. No text is shuffled.

    A row is sampled if its hash, of ``seed`` and id, is under its probability: the
    same row has the same draw on any cluster and after any retry, and rows that repeat
    an id share one. A null id counts as empty. Rows without tokens have probability 0
    unless their cell has tokens of other rows. An empty table gives no rows.

    Returns the columns of ``docs``, then ``mix_<name>`` for each margin,
    ``mix_tokens``, ``mix_p`` and ``mix_sampled``, which replace columns of these names.
    """
    shares = _full({f"mix_{k}": v[1] for k, v in margins.items()})
    classes = {f"mix_{k}": F.when(v[0].isin([x for x in shares[f"mix_{k}"] if x != OTHER]), v[0]).otherwise(F.lit(OTHER)) for k, v in margins.items()}
    names = [*classes, "mix_tokens", "mix_p", "mix_sampled"]
    tagged = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), *[v.alias(k) for k, v in classes.items()], tokens.alias("mix_tokens"))
    cells = tagged.groupBy(*classes).agg(F.sum("mix_tokens").alias("tokens"))
    raked = rake(cells, {f"mix_{k}": v[1] for k, v in margins.items()}, fraction, sweeps).select(*classes, F.col("p").alias("mix_p"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(HASH_RANGE))
    joined = tagged.join(F.broadcast(raked), list(classes), "left").withColumn("mix_p", F.coalesce("mix_p", F.lit(0.0)))
    return joined.withColumn("mix_sampled", draw < F.col("mix_p")).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in names], *names)


def mix_sql(table: str, margins: dict[str, tuple[str, dict[str, float]]], fraction: float, tokens: str, seed: str = "mix", sweeps: int = 15, fills: int = 10) -> str:
    """DuckDB SQL with the columns doc_id, mix_..., for a table with doc_id and what the expressions name.

    It equals ``mix`` where all values with tokens are listed or the listed shares leave some of 1.
    """
    shares = _full({k: v[1] for k, v in margins.items()})
    names = [f"mix_{k}" for k in margins]
    lists = {k: ", ".join("'" + x + "'" for x in shares[k] if x != OTHER) for k in margins}
    classes = ", ".join(f"CASE WHEN {e} IN ({lists[k]}) THEN {e} ELSE '{OTHER}' END AS mix_{k}" for k, (e, _) in margins.items())
    ctes = [f"tagged AS (SELECT *, {classes}, {tokens} AS mix_tokens FROM {table})"]
    ctes.append(f"cells AS (SELECT {', '.join(names)}, sum(mix_tokens)::DOUBLE AS tokens FROM tagged GROUP BY ALL HAVING sum(mix_tokens) > 0)")
    targets = ", ".join(f"coalesce(map {{{', '.join(f"'{v}': {x!r}::DOUBLE" for v, x in shares[k].items())}}}[mix_{k}], 0) AS t{i}, count(*) OVER (PARTITION BY mix_{k}) AS n{i}" for i, k in enumerate(margins))
    ctes.append(f"c0 AS (SELECT *, tokens / sum(tokens) OVER () AS share, {targets} FROM cells)")
    ctes.append(f"w0 AS (SELECT * REPLACE ({', '.join(f't{i} / sum(t{i} / n{i}) OVER () AS t{i}' for i in range(len(names)))}), share AS weight FROM c0)")
    at = 0
    for _ in range(sweeps):
        for i, name in enumerate(names):
            mass = f"sum(weight) OVER (PARTITION BY {name})"
            ctes.append(f"w{at + 1} AS (SELECT * REPLACE (CASE WHEN {mass} > 0 THEN weight * t{i} / {mass} ELSE 0 END AS weight) FROM w{at})")
            at += 1
    ctes.append(f"f0 AS (SELECT *, weight / share AS r, {float(fraction)!r}::DOUBLE AS s FROM (SELECT * REPLACE (weight / sum(weight) OVER () AS weight) FROM w{at}))")
    for i in range(fills):
        filled, rest = "sum(CASE WHEN s * r >= 1 THEN share ELSE 0 END) OVER ()", "sum(CASE WHEN s * r < 1 THEN weight ELSE 0 END) OVER ()"
        ctes.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {rest} > 0 THEN greatest(s, ({float(fraction)!r} - {filled}) / {rest}) ELSE s END AS s) FROM f{i})")
    on = " AND ".join(f"tagged.{n} = f.{n}" for n in names)
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(HASH_RANGE)!r}"
    return (
        f"WITH {', '.join(ctes)}, done AS (SELECT tagged.*, coalesce(least(1, s * r), 0) AS mix_p FROM tagged LEFT JOIN f{fills} f ON {on})\n"
        f"SELECT *, {draw} < mix_p AS mix_sampled FROM done"
    )
