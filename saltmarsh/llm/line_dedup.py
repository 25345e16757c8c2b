"""Line deduplication within an edit bound, by a join of deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.scratch import discard, materialize
from saltmarsh.llm.skew import filter_of, join_group, maybe_member

#: Stands for a null id: such rows come after all others.
LAST_ID = (1 << 63) - 1
BLANKS = " \t\r"


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row for each line that isn't blank: document key, position, trimmed line and its 128-bit hash."""
    text = F.col(text_col)
    exploded = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64(text).alias("_th"),
        F.posexplode(F.split(text, "\n")).alias("_pos", "_raw"),
    )
    trimmed = exploded.select("_id", "_th", "_pos", F.btrim("_raw", F.lit(BLANKS)).alias("_line")).where("_line <> ''")
    return trimmed.withColumns({"_h1": F.xxhash64("_line"), "_h2": F.xxhash64("_line", F.lit(1)), "_len": F.length("_line")})


def _half_keys(line: Column, length: Column) -> list[Column]:
    """Hashes of which two lines within one edit share at least one.

    The edit lies in one half of the shorter line, so the other half is common to
    both. A line can be the shorter of a pair (or as long) or one character longer.
    """
    keys = []
    for shorter in (length, length - 1):
        head = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), shorter, F.substring(line, F.lit(1), head)))
        keys.append(F.xxhash64(F.lit("tail"), shorter, F.right(line, shorter - head)))
    return keys


def _blocks(lines: DataFrame, target: str, base: bool) -> DataFrame:
    """About sqrt(length) blocks of each line, cut where a variant of ``target`` characters is cut.

    ``base``: the line is the variant itself. Else a block has one character more than the
    variant's, which a deletion in it takes away; what stands before and after is hashed
    once for the block, so that all variants of n characters take about n * sqrt(n) steps.
    Lines that are one edit apart, with the edit in this block, share ``_around``.
    """
    extra = 0 if base else 1
    sized = lines.withColumn("_m", F.expr(target)).withColumn("_b", F.greatest(F.lit(1), F.floor(F.sqrt("_m")).cast("int")))
    cut = "cast(floor(cast({j} as double) * _m / _b) as int)"
    low, high = cut.format(j="j"), cut.format(j="(j + 1)")
    made = sized.select(
        "_lid",
        "_first",
        F.expr(
            f"explode(transform(sequence(0, _b - 1), j -> named_struct('low', {low}, "
            f"'block', substring(_line, {low} + 1, {high} - {low} + {extra}), "
            f"'around', xxhash64(_m, j, substring(_line, 1, {low}), substring(_line, {high} + {extra} + 1)))))"
        ).alias("_k"),
    )
    return made.select("_lid", "_first", F.lit(base).alias("_base"), F.col("_k.low").alias("_low"), F.col("_k.block").alias("_block"), F.col("_k.around").alias("_around"))


def _shared(rows: DataFrame, keys: list[str], also=None) -> DataFrame:
    """The rows of keys that several lines have, and by chance some others, which do no harm."""
    ends = rows.groupBy(*keys).agg(F.min("_lid").alias("_from"), F.max("_lid").alias("_to"), F.bool_or("_base").alias("_any_base")).where("_from <> _to")
    found = materialize((ends if also is None else ends.where(also)).select(*keys), "shared-keys")
    slot = F.xxhash64(*keys)
    return maybe_member(rows, filter_of(found, slot), slot, "_hit").where("_hit").drop("_hit")


def _neighbourhood(blocks: DataFrame) -> DataFrame:
    """Hashed keys of lines and of their variants with one character deleted: key, kind, base, line.

    kind ``sub``: the variant with the position of the deletion; lines that share one
    differ in that character only. kind ``gap``: the variant alone, and each line
    itself (``_base``); a variant equal to a line is one insertion away from it.
    """
    deleted = blocks.where("not _base").select(
        "_lid",
        "_first",
        F.expr(
            "explode(transform(sequence(1, length(_block)), i -> named_struct("
            "'y', xxhash64(_around, concat(substring(_block, 1, i - 1), substring(_block, i + 1))), 'p', _low + i)))"
        ).alias("_v"),
    )
    both = F.array(F.struct(F.xxhash64("_v.y", "_v.p").alias("key"), F.lit("sub").alias("kind")), F.struct(F.col("_v.y").alias("key"), F.lit("gap").alias("kind")))
    deleted = deleted.select("_lid", "_first", F.explode(both).alias("_r")).select("_r.key", "_r.kind", F.lit(False).alias("_base"), "_lid", "_first")
    whole = blocks.where("_base").select(F.xxhash64("_around", "_block").alias("key"), F.lit("gap").alias("kind"), "_base", "_lid", "_first")
    return deleted.unionByName(whole)


def _near_lines(docs: DataFrame, text_col: str, id_col: str, distinct: DataFrame, near_min_chars: int) -> DataFrame:
    """The distinct lines (``_h1``) within one edit of a line that comes first earlier."""
    keyed = distinct.where(F.col("_len") >= near_min_chars).select("_h1", "_h2", F.explode(F.array("_k1", "_k2", "_k3", "_k4")).alias("_k"))
    halves = keyed.groupBy("_k").agg(F.min("_h1").alias("_low"), F.max("_h1").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low <> _high").select("_k", "_n")
    sharing = join_group(keyed, halves, ["_k"], "_n", 4 * distinct.count(), "inner").select("_h1", "_h2").distinct()
    sharing = materialize(sharing.join(distinct.select("_h1", "_h2", "_first"), ["_h1", "_h2"]), "sharing")
    slot = F.xxhash64("_h1", "_h2")
    found = maybe_member(_lines(docs, text_col, id_col).select("_h1", "_h2", "_line", "_len"), filter_of(sharing, slot), slot, "_hit").where("_hit")
    texts = found.groupBy("_h1", "_h2").agg(F.first("_line").alias("_line"), F.first("_len").alias("_len"))
    lines = materialize(texts.join(sharing, ["_h1", "_h2"]).select(F.col("_h1").alias("_lid"), "_first", "_line", "_len"), "near-lines")

    blocks = _blocks(lines, "_len - 1", False).unionByName(_blocks(lines, "_len", True))
    blocks = materialize(_shared(blocks, ["_around"]), "blocks")
    members = materialize(_shared(_neighbourhood(blocks), ["key", "kind"], "kind = 'sub' or _any_base"), "members")
    ends = members.groupBy("key", "kind").agg(
        F.min(F.struct("_first", "_lid")).alias("_any"),
        F.min(F.when(F.col("_base"), F.struct("_first", "_lid"))).alias("_whole"),
        F.min(F.when(~F.col("_base"), F.struct("_first", "_lid"))).alias("_cut"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = join_group(members, ends, ["key", "kind"], "_n", members.count(), "inner")
    other = F.when(F.col("kind") == "sub", F.col("_any")).when(F.col("_base"), F.col("_cut")).otherwise(F.col("_whole"))
    pairs = joined.select("_lid", "_first", other.alias("_o")).where("_o._first < _first").select("_lid", F.col("_o._lid").alias("_other")).distinct()
    left = lines.select("_lid", F.col("_line").alias("_a"))
    right = lines.select(F.col("_lid").alias("_other"), F.col("_line").alias("_b"))
    checked = pairs.join(left, "_lid").join(right, "_other").where(F.levenshtein("_a", "_b", 1) >= 0)
    return checked.select(F.col("_lid").alias("_h1")).distinct()


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_edits: int = 1, near_min_chars: int = 0, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without the lines that stand earlier in the corpus, equal or within ``max_edits`` edits.

    Lines are compared without blanks at their ends. Their order is that of
    (id, hash of the text, position). A line goes if an equal line comes earlier, or
    if ``max_edits`` is 1 and a line within one insertion, deletion or substitution
    of a character comes earlier; whether the earlier one itself stays doesn't
    matter. Lines of any length are compared; with ``near_min_chars`` those under so many
    characters only go for equal ones.

    Method: the variants of a line with one character deleted, as hashed keys; lines
    that share a variant are verified by edit distance. A pair within one edit shares a
    half, and all before and after the block that the edit is in: only distinct lines that
    share a half with another one are looked at, and only blocks whose surroundings are
    shared get variants. That drops no pair.
    Groups of equal keys yield one pair per line, with the earliest of the group.

    Returns the columns of ``docs`` with the text shortened, and ``counts``: ``n_lines`` and
    ``n_dropped`` (of lines that aren't blank), which replace columns of these names. Blank lines stay. A null text stays
    null, with no lines. A null id comes after all others. Rows that repeat both id
    and text count as one document, and each gets its result. An empty table gives no rows.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = _lines(docs, text_col, id_col)
    half = dict(zip(("_k1", "_k2", "_k3", "_k4"), _half_keys(F.col("_line"), F.col("_len")), strict=True))
    occurrences = materialize(lines.select("_id", "_th", "_pos", "_h1", "_h2", "_len", *[v.alias(k) for k, v in half.items()]), "lines")
    distinct = occurrences.groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("_id", "_th", "_pos")).alias("_first"),
        *[F.min(c).alias(c) for c in ("_len", *half)],
    )
    distinct = materialize(distinct, "distinct-lines")
    groups = distinct.select("_h1", "_h2", "_n", "_first")
    if max_edits:
        near = _near_lines(docs, text_col, id_col, distinct, near_min_chars).withColumn("_near", F.lit(True))
        groups = groups.join(near, "_h1", "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    else:
        groups = groups.withColumn("_near", F.lit(False))
    groups = materialize(groups.where("_n > 1 or _near"), "line-groups")
    met = join_group(occurrences.select("_id", "_th", "_pos", "_h1", "_h2"), groups, ["_h1", "_h2"], "_n", occurrences.count(), "inner")
    gone = met.where("_near or not (_first._id = _id and _first._th = _th and _first._pos = _pos)")
    drops = gone.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_drop"))
    drops = materialize(drops, "drops")

    whole = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"))
    slot = F.xxhash64("_id", "_th")
    sorted_out = maybe_member(whole, filter_of(drops, slot), slot, "_hit")
    touched = sorted_out.where("_hit").join(drops, ["_id", "_th"], "left").select("_doc", "_drop")
    untouched = sorted_out.where("not _hit").select("_doc", F.lit(None).cast("array<int>").alias("_drop"))
    text = F.col("_doc").getField(text_col)
    out = touched.unionByName(untouched).withColumn("_all", F.split(text, "\n"))
    shorter = F.expr("array_join(transform(array_except(sequence(0, size(_all) - 1), _drop), i -> _all[i]), '\n')")
    others = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c != text_col and c not in counts]
    result = out.select(
        *others,
        F.when(F.col("_drop").isNull(), text).otherwise(shorter).alias(text_col),
        F.when(text.isNull(), 0).otherwise(F.size(F.filter("_all", lambda x: F.btrim(x, F.lit(BLANKS)) != ""))).cast("long").alias(counts[0]),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias(counts[1]),
    )
    discard(distinct)
    discard(occurrences)
    return result.select(*[c for c in docs.columns if c not in counts], *counts)
