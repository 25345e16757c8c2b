"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.llm.components import components
from saltmarsh.llm.hashing import shingle_sets
from saltmarsh.llm.scratch import discard, materialize
from saltmarsh.llm.skew import filter_of, join_group, maybe_member
from saltmarsh.llm.tokens import in_portions
from saltmarsh.llm.worker import small_batches, task

#: Classes that a task remembers to have met; beyond, it forgets them all, and those that recur come up again.
MET = 1 << 17
#: Shingles whose counts a task holds at once; those it saw once are dropped then.
COUNTED = 1 << 21
#: A shingle seen in fewer documents isn't frequent.
FREQUENT_LEAST = 8
#: At most so many frequent shingles are broadcast (16 MB), whatever the input's size.
FREQUENT_MOST = 1 << 20
#: Lists of about so many documents are dealt out to one task each.
LIST_SHARE = 4096
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Prefixes are lengthened by one of these less one.
MULTIPLICITIES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 63)
#: A document asks for at least one common prefix shingle in so many of its shingles.
SHINGLES_EACH = 25
#: A verification costs as much as one posting for so many shingles.
SHINGLES_A_POSTING = 16
#: Lists of up to so many classes are paired by a join; longer ones are compared by blocks.
PAIRED = 32
#: Classes in a block.
BLOCK = 1024
#: Shingles that a block comparison holds at once.
COLUMNS = 4096
#: Bits of the shortest and of the longest signature.
SIGNATURE_LEAST, SIGNATURE_MOST = 1 << 6, 1 << 17
#: A row of a long list names so many longer lists of its class; a block comparison heeds so many of them.
NAMED, HEEDED = 16, 512
# What a posting's ``info`` holds, from the lowest bit: name -> bits.
FIELDS = {"ell": 6, "central": 5, "salt": 8, "base": 1}


def _field(name: str) -> Column:
    shift = 0
    for other, bits in FIELDS.items():
        if other == name:
            return F.shiftright("info", shift).bitwiseAND(F.lit((1 << bits) - 1))
        shift += bits
    raise KeyError(name)


def _class_of(shingles: np.ndarray) -> int:
    """The id of all documents with this set: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signer():
    """Documents' set sizes and classes; and, in rows of their own, shingles that recur in a task with their counts."""

    @task("shingles")
    def sign(batches):
        import pyarrow as pa

        names = ["_id", "n", "node", "shingles", "counts"]
        seen, held, size = set(), [], 0

        def recurring():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
            for k in range(0, len(values), 1 << 16):
                arrays = [pa.array([values[k : k + (1 << 16)]], pa.list_(pa.int64())), pa.array([counts[k : k + (1 << 16)].astype(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *arrays], names)

        for batch in batches:
            ids = batch.column("_id")
            for portion in in_portions(batch.column("_text")):
                sets = shingle_sets([data for _, data in portion])
                nodes = [_class_of(s) if len(s) else None for s in sets]
                if len(seen) > MET:
                    seen.clear()
                for node, s in zip(nodes, sets, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        held.append(s)
                        size += len(s)
                n = len(portion)
                empty = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(portion[0][0], n), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), empty, empty], names)
                if size >= COUNTED:
                    yield from recurring()
                    held, size = [], 0
        if held:
            yield from recurring()

    return sign


def least_multiplicity(n: int) -> int:
    """The common prefix shingles that any document of ``n`` shingles asks for at least; never fewer for more shingles."""
    return max(m for m in MULTIPLICITIES if m <= max(1, n // SHINGLES_EACH))


def _least_multiplicity(n: Column) -> Column:
    out = F.lit(MULTIPLICITIES[0])
    for m in MULTIPLICITIES[1:]:
        out = F.when(F.floor(n / SHINGLES_EACH) >= m, m).otherwise(out)
    return out


def choose_multiplicity(costs: np.ndarray, n: int, base: int) -> int:
    """How many prefix shingles partners must share, by estimated cost.

    ``costs``: for each of a document's shingles in order, how many other documents are
    thought to have it. A prefix asking for m common shingles is m - 1 longer than
    ``base``. Its postings meet sum(costs) others; each document verified met m of them,
    so there are sum / m at most, each costing by its shingles.
    """
    options = [m for m in MULTIPLICITIES if base + m - 1 <= n and m >= least_multiplicity(n)]
    sums = np.cumsum(costs)
    price = [sums[base + m - 2] * (1 + n / m / SHINGLES_A_POSTING) + (m - 1) for m in options]
    return options[int(np.argmin(price))]


def _poster(frequent, percent: int):
    """Postings (token, node, info) of each document's prefix."""

    @task("shingles")
    def post(batches):
        import pyarrow as pa

        tokens, levels = frequent.value
        seen = set()
        shift = np.cumsum([0, *FIELDS.values()])
        for batch in batches:
            for portion in in_portions(batch.column("_text")):
                out = []
                if len(seen) > MET:
                    seen.clear()
                for s in shingle_sets([data for _, data in portion]):
                    n = len(s)
                    if not n or (node := _class_of(s)) in seen:
                        continue
                    seen.add(node)
                    signed = s.view(np.int64)
                    level = np.zeros(n, dtype=np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, signed), len(tokens) - 1)
                        level = np.where(tokens[at] == signed, levels[at], 0).astype(np.int64)
                    order = np.lexsort((signed, level))
                    signed, level = signed[order], level[order]
                    base = n - -(-percent * n // 100) + 1
                    ell = choose_multiplicity(np.exp2(level / 2) - 1, n, base) if level[-1] else least_multiplicity(n)
                    k = base + ell - 1
                    parts = np.minimum(np.ceil(np.exp2(level[:k] / 2) / LIST_SHARE), 255).astype(np.int64)
                    salt = np.where(parts > 1, 1 + (node & 0x7FFFFFFF) % parts, 0)
                    central = min(31, int(level.mean()))
                    info = ell | central << int(shift[1]) | salt << int(shift[2]) | (np.arange(k) < base).astype(np.int64) << int(shift[3])
                    out.append((signed[:k], np.full(k, node, np.int64), info))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["token", "node", "info"])

    return post


@task("shingles")
def _sets_of(batches):
    """Each class's shingles, once in a task."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        for portion in in_portions(batch.column("_text")):
            rows = []
            if len(seen) > MET:
                seen.clear()
            for s in shingle_sets([data for _, data in portion]):
                if len(s) and (node := _class_of(s)) not in seen:
                    seen.add(node)
                    rows.append((node, s.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["node", "shingles"])


def _frequent(signed: DataFrame):
    """The shingles that many documents have, with twice the logarithm of their counts, on the driver.

    Tasks count what recurs in them, so counts are estimates from below over all
    documents; any count gives a valid order. Those kept have at least 1 in
    FREQUENT_MOST of all that was counted, so there are at most so many.
    """
    parts = signed.where("shingles is not null").select(F.explode(F.arrays_zip("shingles", "counts")).alias("_c"))
    counts = parts.groupBy(F.col("_c.shingles").alias("token")).agg(F.sum("_c.counts").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    counts = materialize(counts, "frequent")
    total = counts.agg(F.sum("n")).head()[0] or 0
    table = counts.where(F.col("n") >= -(-total // FREQUENT_MOST)).toArrow()
    discard(counts)
    tokens, n = (table.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], np.floor(2 * np.log2(np.maximum(n[order], 1))).astype(np.uint8)


def _lists(docs: DataFrame, classes: DataFrame, frequent, percent: int) -> DataFrame:
    """Postings (token, salt, node, n, ell, central) that can matter: of shingles that several classes have in
    their prefixes, and of classes with enough such shingles for any partner.

    A partner of a class of n shingles has at least percent * n / 100, and asks for at least what any
    document of that size does.
    """
    postings = docs.select("_text").mapInArrow(_poster(frequent, percent), "token long, node long, info long")
    postings = postings.withColumn("salt", _field("salt"))
    whole = W.partitionBy("token", "salt").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    several = postings.withColumns({"_low": F.min("node").over(whole), "_high": F.max("node").over(whole)}).where("_low <> _high or salt > 0")
    several = materialize(several.select("token", "node", "info"), "postings")
    met = several.groupBy("node").agg(F.count_distinct("token").alias("_k"))
    enough = met.join(classes.select("node", "n"), "node").where(F.col("_k") >= _least_multiplicity(F.ceil(F.col("n") * percent / 100))).select("node", "n")
    enough = materialize(enough, "open-classes")
    slot = F.xxhash64("node")
    kept = maybe_member(several, filter_of(enough, slot), slot, "_hit").where("_hit").join(enough, "node")
    lists = materialize(kept.select("token", "node", "n", *[_field(f).alias(f) for f in FIELDS]).distinct(), "lists")
    discard(several)
    discard(enough)
    return lists


def _stars(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's members with its leader; leaders of a list in parts pair with the first of them.

    The leader is the document whose shingles are the most frequent ones: of a group of
    near copies the one that most others resemble. Pairs must meet in as many lists as the
    less demanding of the two asks for. Those that would meet elsewhere too come up again later.
    """
    order = W.partitionBy("token", "salt").orderBy(F.desc("central"), "node")
    led = posted.withColumn("to", F.first(F.struct("node", "n", "ell")).over(order))
    heads = led.where("salt > 0 and node = to.node").withColumn("to", F.first(F.struct("node", "n", "ell")).over(W.partitionBy("token").orderBy(F.desc("central"), "node")))
    ends = led.unionByName(heads).where("node <> to.node").where(_could_link(F.col("n"), F.col("to.n"), percent))
    pairs = ends.groupBy(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).agg(F.count(F.lit(1)).alias("_m"), F.min(F.least("ell", "to.ell")).alias("_need"))
    return pairs.where("_m >= _need").select("a", "b")


def _could_link(n: Column, m: Column, percent: int) -> Column:
    """Set sizes that allow the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _texts(source: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of the representatives of the classes in ``nodes``, and some more.

    A bit filter picks the texts, so none is shuffled; chance hits and copies do no harm.
    """
    slot = F.xxhash64("_rep")
    wanted = filter_of(nodes.join(classes.select("node", "_rep"), "node"), slot)
    return maybe_member(source, wanted, F.xxhash64("_id"), "_hit").where("_hit").select("_text")


def _sets(source: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingles of the classes in ``nodes``, from the texts of their representatives."""
    own = F.xxhash64("node")
    found = _texts(source, classes, nodes).mapInArrow(_sets_of, "node long, shingles array<long>")
    return materialize(maybe_member(found, filter_of(nodes, own), own, "_hit").where("_hit").drop("_hit"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def block_links(nodes: np.ndarray, comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between side 0 and side 1 (or inside, if there is one side) that join different components: a forest.

    Intersections of all are products of a 0/1 matrix of the shingles that several have.
    """
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(where) > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    rows, columns = rows[keep], column[where[keep]]
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == sides.max())
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(columns, (first, first + COLUMNS))
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[rows[a:b], columns[a:b] - first] = 1
        common += x[left] @ x[right].T
    n = np.array([len(s) for s in sets], dtype=np.float64)
    union = n[left][:, None] + n[right][None, :] - common
    close = 100.0 * common >= percent * union
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    out = []
    for i, j in zip(*(side.tolist() for side in np.nonzero(close & (comps[left][:, None] != comps[right][None, :]))), strict=True):
        p, q = left[i], right[j]
        c, d = find(int(comps[p])), find(int(comps[q]))
        if c != d:
            root[c] = d
            out.append((int(nodes[p]), int(nodes[q])))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """For each of 2 ** k slots, as many as there are shingles or more, whether an odd number of shingles falls there.

    Two signatures of one length differ in no more bits than the sets have shingles that
    only one of them has. Half a signature's bits are its two halves, one xored with the other.
    """
    bits = min(max(SIGNATURE_LEAST, 1 << (len(shingles) - 1).bit_length()), SIGNATURE_MOST)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@task("shingles")
def _signatures_of(batches):
    """Each class's set size and signature, once in a task."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        for portion in in_portions(batch.column("_text")):
            rows = []
            if len(seen) > MET:
                seen.clear()
            for s in shingle_sets([data for _, data in portion]):
                if len(s) and (node := _class_of(s)) not in seen:
                    seen.add(node)
                    rows.append((node, len(s), signature(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "signature"])


def _heeded(lists: list[list[int]]) -> np.ndarray:
    """For each member a bit for each of the ``HEEDED`` commonest of ``lists``."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, where, counts = np.unique(np.concatenate([np.array(x, np.int64) for x in lists]), return_inverse=True, return_counts=True)
    place = np.full(len(values), -1)
    most = np.argsort(-counts, kind="stable")[:HEEDED]
    place[most] = np.arange(len(most))
    column = place[where]
    bits = np.zeros((len(lists), HEEDED), dtype=np.uint8)
    bits[rows[column >= 0], column[column >= 0]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def close_members(comps: np.ndarray, sides: np.ndarray, sizes: np.ndarray, signatures: list[bytes], before: list[list[int]], percent: int) -> np.ndarray:
    """Which members may link with one of the other side (or of the same, if there is one side) in another component.

    d shingles that only one of two sets has allow the similarity where d * (100 + percent) <=
    (100 - percent) * the sum of their sizes; signatures bound d from below, so no link is missed.
    Two that share one of the lists ``before`` this one are compared there.
    """
    met = _heeded(before)
    out = np.zeros(len(sizes), dtype=bool)
    lengths = np.array([len(s) for s in signatures])
    of = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
    bits = {n: np.frombuffer(b"".join(signatures[i] for i in at), np.uint64).reshape(len(at), n // 8) for n, at in of.items()}

    def folded(x: np.ndarray, words: int) -> np.ndarray:
        while x.shape[1] > words:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    for n, at in of.items():
        for m, to in of.items():
            mine, theirs = np.flatnonzero(sides[at] == 0), np.flatnonzero(sides[to] == sides.max())
            theirs = theirs[np.argsort(sizes[to[theirs]], kind="stable")]
            left, right = at[mine], to[theirs]
            first = np.searchsorted(sizes[right], -(-percent * sizes[left] // 100))
            last = np.searchsorted(sizes[right], 100 * sizes[left] // percent, "right")
            if not (first < last).any():
                continue
            x, y = folded(bits[n][mine], min(n, m) // 8), folded(bits[m][theirs], min(n, m) // 8)
            for k in np.flatnonzero(first < last).tolist():
                others = right[first[k] : last[k]]
                new = np.flatnonzero((comps[others] != comps[left[k]]) & ~(met[others] & met[left[k]]).any(axis=1))
                if not len(new):
                    continue
                apart = np.bitwise_count(y[first[k] + new] ^ x[k]).sum(axis=1, dtype=np.int64)
                near = new[apart * (100 + percent) <= (100 - percent) * (sizes[others[new]] + sizes[left[k]])]
                if len(near):
                    out[left[k]] = True
                    out[others[near]] = True
    return out


def _close(rows: DataFrame, source: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of long lists (token, node, comp, _n), in each pair (i, j) of blocks the members that may link there.

    Only signatures go to every pair of blocks, a bit or two for each shingle. Two classes
    are compared in the longest list that they share: rows name the lists before theirs.
    """
    nodes = rows.select("node").distinct()
    own = F.xxhash64("node")
    signed = _texts(source, classes, nodes).mapInArrow(_signatures_of, "node long, n long, signature binary")
    signed = materialize(maybe_member(signed, filter_of(nodes, own), own, "_hit").where("_hit").drop("_hit").dropDuplicates(["node"]), "signatures")
    lists = rows.groupBy("node", "comp").agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("less"), "token"))).alias("lists"))
    each = lists.join(signed, "node").select("node", "comp", "n", "signature", "lists", F.posexplode("lists").alias("at", "_list"))
    before = F.slice("lists.token", F.lit(1), F.least(F.col("at"), F.lit(NAMED)))
    parts = F.ceil(-F.col("_list.less") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    each = each.select(F.col("_list.token").alias("token"), "node", "comp", "n", "signature", before.alias("before"), own.alias("own"), parts.alias("parts"))
    dealt = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node", "comp", "n", "signature", "before")

    def pick(table):
        import pyarrow as pa

        comps, sides, sizes = (table.column(c).to_numpy() for c in ("comp", "side", "n"))
        close = close_members(comps, sides, sizes, table.column("signature").to_pylist(), table.column("before").to_pylist(), percent) if len(comps) > 1 and (comps != comps[0]).any() else np.zeros(len(comps), dtype=bool)
        return table.select(["token", "i", "j", "side", "node", "comp"]).filter(pa.array(close))

    close = materialize(dealt.groupBy("token", "i", "j").applyInArrow(pick, "token long, i int, j int, side int, node long, comp long"), "close")
    discard(signed)
    return close


def _blockwise(close: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of pairs of blocks (token, i, j, side, node, comp): each pair is a group of its own.

    A group has two blocks at most, whatever the list's length, and yields fewer links than it has classes.
    """
    held = close.join(sets, "node")

    def compare(table):
        import pyarrow as pa

        shingles = table.column("shingles").combine_chunks()
        values, cuts = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        split = [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        nodes, comps, sides = (table.column(c).to_numpy() for c in ("node", "comp", "side"))
        found = block_links(nodes, comps, sides, split, percent) if len(split) > 1 and (comps != comps[0]).any() else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return held.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_t"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_i", F.size(F.array_intersect("_s", "_t")))
    return both.where(100 * F.col("_i") >= percent * (F.size("_s") + F.size("_t") - F.col("_i"))).select("a", "b").distinct()


def ngram_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 75) -> DataFrame:
    """Components of documents linked by Jaccard similarity of their 5-word shingles.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Two
    documents link where 100 * intersection >= ``percent`` * union. Returns a row for each
    of ``docs``: the id, ``n_shingles`` and ``component_id``, the smallest id that it
    reaches over links. A document without words (or a null text) links with nothing and
    is its own component. Documents with fewer than five words have one shingle, all
    their words. A null id is reached by others but never the smallest. Repeated rows link.

    1. Documents with the same set form a class, known by a 64-bit digest of it and
       counted once from here on.
    2. Shingles are ordered by frequency, rare ones first. A class posts a prefix of its
       shingles. For m common prefix shingles it is n - ceil(percent * n / 100) + m long, and
       partners are sure to share min(m, m'); m is chosen by estimated cost. Classes that
       have too few shingles in common with any other are left out from here on.
    3. In each list of classes posted under one shingle all pair with one leader. Pairs
       that meet often enough are verified on the whole sets; components follow.
    4. Lists whose members are in several components now are open. Short ones yield the
       pairs between components that may reach the similarity by their sizes, share enough
       prefix shingles (long lists count as shared) and weren't verified; these are verified
       too. Of long lists only the prefixes for one common shingle are needed: they are cut
       into blocks, and each two blocks compared in a task by signatures, of a bit or two for
       each shingle. Members that may link there are compared whole, by matrix products, which
       yields a forest of links. Pairs inside a component can't change it, so no list is
       expanded to all its pairs as rows.

    Shingles are known by 64-bit hashes. What goes to the driver: the frequent shingles, of
    which there are at most ``FREQUENT_MOST`` at any input size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"))
    signed = materialize(source.mapInArrow(_signer(), "_id long, n long, node long, shingles array<long>, counts array<long>"), "signed")
    rows = signed.where("shingles is null").select("_id", "n", "node")
    classes = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("_copies"), F.min("n").alias("n"), F.min("_id").alias("_rep"), F.min(F.when(F.col("_id") != NO_ID, F.col("_id"))).alias("_least"))
    classes = materialize(classes, "classes")
    frequent = spark.sparkContext.broadcast(_frequent(signed))

    posted = _lists(source, classes, frequent, percent)
    stars = materialize(_stars(posted, percent), "stars")
    sets = _sets(source, classes, _ends(stars))
    links = materialize(_verified(stars, sets, percent), "verified")
    discard(sets)
    comps = components(links)

    placed = materialize(posted.join(comps, "node", "left").select("token", "node", "n", "ell", "base", F.coalesce("comp", "node").alias("comp")), "placed")
    discard(posted)
    split = placed.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_from"), F.max("comp").alias("_to")).where("_from <> _to").select("token", "_n")
    split = materialize(split, "split")
    open_ = materialize(join_group(placed, split, ["token"], "_n", placed.count(), "inner"), "open")
    discard(placed)
    long_ = open_.where(F.col("_n") > PAIRED)
    elsewhere = long_.groupBy("node").agg(F.count(F.lit(1)).alias("_g"))
    short = open_.where(F.col("_n") <= PAIRED).join(elsewhere, "node", "left").withColumn("g", F.coalesce("_g", F.lit(0)))
    short = materialize(short.select("token", "node", "comp", "n", "ell", "g"), "short")
    one = short.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "comp", "n", "ell", "g")])
    two = short.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "ell", "g")])
    met = one.join(two, "token").where((F.col("comp_a") != F.col("comp_b")) & (F.col("node_a") < F.col("node_b")) & _could_link(F.col("n_a"), F.col("n_b"), percent))
    need = F.least("ell_a", "ell_b") - F.least("g_a", "g_b")
    shared = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count(F.lit(1)).alias("_m"), F.min(need).alias("_need"))
    pairs = materialize(shared.where("_m >= _need").join(stars, ["a", "b"], "left_anti").select("a", "b"), "pairs")
    close = _close(long_.where("base = 1"), source, classes, percent)
    sets = _sets(source, classes, _ends(pairs).unionByName(close.select("node")).distinct())
    more = _verified(pairs, sets, percent).unionByName(_blockwise(close, sets, percent))
    more = materialize(more, "verified")
    for table in (stars, open_, short, pairs, close, sets):
        discard(table)
    if more.take(1):
        comps = components(links.unionByName(more))

    named = classes.select("node", "_copies", "_least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named, "named")
    least = named.groupBy("comp").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = materialize(join_group(named, least, ["comp"], "_n", named.count(), "inner").select("node", "_copies", "component_id"), "labels")
    linked = join_group(rows.where("n > 0"), named, ["node"], "_copies", rows.count(), "inner").select("_id", "n", "component_id")
    alone = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    null_back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked.unionByName(alone).select(null_back("_id").alias(id_col), F.col("n").alias("n_shingles"), null_back("component_id").alias("component_id"))
