"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame expressions only.

A text's paragraphs (pieces between line ends or sentence ends) are digested; each distinct digest enters one cell in
each third of a table of cells, which hold a count, the XOR of digests and the XOR of their checks. The first table, of
24 cells, is the fingerprint. Likeness of two texts comes from their tables alone: subtracted, they leave the differing
digests, which rounds of peeling recover: every cell with count 1 or -1 and a fitting check gives a digest that is taken
out of its other cells. If cells remain, larger tables are tried: digests are dealt by value into blocks of about DEAL,
and each block has a table of 24 cells, then 48, 96, 384, and last 384 at other places. The digests of a block of which
no table peels all count as differing. Likeness is 1 - differing / all digests of both.

Edge cases: a null text is empty, which is one empty paragraph; the only document is its own next one; null ids come
first, and equal ids are ordered by a hash of their text; an empty table gives an empty table; further columns are
ignored; long texts cost little more than their length, as blocks are dealt in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, written

#: Cells of a fingerprint, and cells and seed of the tables that are tried in turn for a block; cells are three times a power of two.
FIRST, TABLES = 24, ((24, 0), (48, 0), (96, 0), (384, 0), (384, 1))
ROUNDS = 12
PIECES = r"(?<=[.!?])\\s+|\\n+"
#: Digests that share a block on average.
DEAL = 8
#: Parts of the order of documents for each shuffle partition.
PARTS = 4


def digests(text: str) -> str:
    return f"array_distinct(transform(split({text}, '{PIECES}'), x -> xxhash64(x)))"


def table(keys: str, size: int, seed: int = 0) -> str:
    """SQL for the cells of a set of digests."""
    w = size // 3
    inside = f"filter({keys}, x -> (shiftright({placed('x', seed)}, j) & {w - 1}L) = i)"
    cell = f"aggregate({inside}, named_struct('c', 0L, 'k', 0L, 'h', 0L), (s, x) -> named_struct('c', s.c + 1L, 'k', s.k ^ x, 'h', s.h ^ xxhash64(x)))"
    return f"flatten(transform(array(0, 20, 40), j -> transform(sequence(0L, {w - 1}L), i -> {cell})))"


def placed(key: str, seed: int) -> str:
    """What decides a digest's cells: its own bits, or those of another hash."""
    return f"xxhash64({key}, {seed})" if seed else key


def less(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c - q.c, 'k', p.k ^ q.k, 'h', p.h ^ q.h))"


def peeled(cells: str, size: int, seed: int = 0) -> str:
    """SQL for the number of digests that peeling recovers, or null if cells remain."""
    w = size // 3
    pure = "array_distinct(transform(filter(s.t, c -> abs(c.c) = 1 and xxhash64(c.k) = c.h), c -> named_struct('c', c.c, 'k', c.k)))"
    inside = f"filter(g, p -> (shiftright({placed('p.k', seed)}, 20 * (i div {w})) & {w - 1}L) = i % {w})"
    out = f"transform(s.t, (c, i) -> if(c.c = 0L and c.k = 0L and c.h = 0L and size(g) = 0, c, aggregate({inside}, c, (a, p) -> named_struct('c', a.c - p.c, 'k', a.k ^ p.k, 'h', a.h ^ xxhash64(p.k)))))"
    step = f"transform(array({pure}), g -> named_struct('t', {out}, 'n', s.n + size(g), 'go', size(g) > 0))[0]"
    full = "exists(s.t, c -> c.c != 0L or c.k != 0L)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('t', {cells}, 'n', 0, 'go', true), (s, r) -> if(s.go and {full}, {step}, s), s -> if({full}, cast(null as int), s.n))"


def recovered(a: str, b: str) -> str:
    """SQL for the number of digests that the tables of a block give back, the first that peels."""
    tried = []
    for size, seed in TABLES:
        # a table cannot give up more digests than it has cells
        small = f"abs(size({a}) - size({b})) > {size}"
        tried.append(f"if({small}, cast(null as int), {peeled(less(table(a, size, seed), table(b, size, seed)), size, seed)})")
    # coalesce stops at the first table that peels
    return f"coalesce({', '.join(tried)}, size({a}) + size({b}))"


def dealt(a: str, b: str, parts: str, shift: int, name: str, inner: str) -> str:
    """SQL that deals both sets into `parts` groups by value and sums `inner` of each group. The bits that decide are not
    those of the cells."""

    def pick(x: str) -> str:
        return f"if({name}_n = 1, {x}, filter({x}, x -> pmod(shiftright(x, {shift}), {name}_n) = {name}_i))"

    each = f"transform(array(named_struct('a', {pick(a)}, 'b', {pick(b)})), {name} -> {inner})[0]"
    return f"aggregate(transform(array(cast({parts} as int)), {name}_n -> aggregate(transform(sequence(0, {name}_n - 1), {name}_i -> {each}), 0, (total, y) -> total + y)), 0, (total, y) -> total + y)"


def differing(a: str, b: str, first_a: str, first_b: str) -> Column:
    """How many digests are in one of two texts only, from their fingerprints' tables or, if those don't peel, larger ones.
    n digests are dealt into the square root of n / DEAL groups, and each group into blocks."""
    groups = f"ceil(sqrt((size({a}) + size({b})) / {DEAL}))"
    larger = dealt(a, b, groups, 8, "u", dealt("u.a", "u.b", f"greatest(1, (size(u.a) + size(u.b)) div {DEAL})", 28, "v", recovered("v.a", "v.b")))
    small = f"abs(size({a}) - size({b})) > {FIRST}"
    return F.expr(f"coalesce(if({small}, cast(null as int), {peeled(less(first_a, first_b), FIRST)}), {larger})")


def likeness(a: str, b: str, first_a: str, first_b: str) -> Column:
    return F.lit(1.0) - differing(a, b, first_a, first_b) / (F.size(a) + F.size(b))


def hexed(cells: str) -> Column:
    """A table's cells in hex: counts in four digits, digests in sixteen."""
    return F.expr(f"lower(array_join(transform({cells}, c -> concat(lpad(hex(pmod(c.c, 65536L)), 4, '0'), lpad(hex(c.k), 16, '0'))), ''))")


def with_parts(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text), `tie` (a hash of the text, not negative) and `part`, which never falls in ascending order of
    doc_id (null first) and tie. Quantiles of the ids are the borders; an id that is a border is a part of its own, or several,
    by tie, if it is as frequent as several parts; so are null ids. Their number is that of shuffle partitions, times PARTS."""
    n = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], F.lit(max(10000, 10 * n))), F.count("*"), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    found = facts[0] or []
    border = sorted(set(found))
    times = [found.count(b) for b in border]
    none = max(1, -(-n * (facts[2] or 0) // max(1, facts[1])))
    most = max([none, *times])
    tied = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    if not border:
        return tied.withColumn("part", F.floor(F.col("tie") / float(1 << 63) * none))
    halves = [1 << k for k in reversed(range(len(border).bit_length()))]
    borders, counts, steps = (F.expr("array(" + ",".join(f"{x}{s}" for x in values) + ")") for values, s in ((border, "L"), (times, ""), (halves, "")))
    # binary search: how many borders are below the id
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(border)) & (F.get(borders, at + s - 1) < F.col("doc_id")), at + s).otherwise(at))
    out = tied.withColumn("_below", below)
    own = F.get(borders, F.col("_below")).eqNullSafe(F.col("doc_id"))
    split = F.when(F.col("doc_id").isNull(), none).when(own, F.get(counts, F.col("_below"))).otherwise(1)
    code = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + 2 * F.col("_below") + own.cast("int"))
    sub = F.least(F.floor(F.col("tie") / float(1 << 63) * split), split - 1)
    return out.withColumn("part", (code * most + sub).cast("long")).drop("_below")


def with_next(rows: DataFrame, name: str = "next") -> DataFrame:
    """rows (doc_id, text) and the text of the next row by ascending doc_id; after the last comes the first.

    Each part of the order finds its own successors; the first row of each part is also put behind the part before it."""
    parts = with_parts(rows)
    # one row of ids for each part: their number is that of shuffle partitions
    heads = sorted(parts.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head")).select("part", "head.doc_id", "head.tie").collect())
    if not heads:
        return rows.withColumn(name, F.lit(None).cast("string"))
    turn = rows.sparkSession.createDataFrame([(h["part"], h["tie"], h["doc_id"], heads[k - 1]["part"]) for k, h in enumerate(heads)], "part long, tie long, head_id long, before long")
    guests = parts.join(F.broadcast(turn), ["part", "tie"]).where(F.col("doc_id").eqNullSafe(F.col("head_id"))).select(F.col("before").alias("part"), F.lit(True).alias("guest"), "doc_id", "tie", "text")
    both = parts.select("part", F.lit(False).alias("guest"), "doc_id", "tie", "text").unionByName(guests)
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return both.withColumn(name, F.lead("text").over(order)).where("not guest").select("doc_id", "text", name)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text's digest, fingerprints of text and edited text, and the likeness of the
    fingerprint to the edited text's and to the next document's."""
    rows = ids_and_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    pairs = with_next(rows).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next, 1, cast(n_chars div 2 as int)))")
    keyed = pairs.select("doc_id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), F.expr(digests("text")).alias("own"), edited.alias("edited"), F.expr(digests("next")).alias("other"))
    keyed = keyed.select("doc_id", "n_chars", "edited_sha256", "own", F.expr(digests("edited")).alias("new"), "other")
    keyed = written(keyed, "digests")
    tables = keyed.select("*", *(F.expr(table(x, FIRST)).alias(f"first_{x}") for x in ("own", "new", "other")))
    return tables.select("doc_id", "n_chars", "edited_sha256", hexed("first_own").alias("fingerprint"), hexed("first_new").alias("edited_fingerprint"), likeness("own", "new", "first_own", "first_new").alias("near_edited"), likeness("own", "other", "first_own", "first_other").alias("near_next"))
