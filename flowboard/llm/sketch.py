"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.llm.common import chunk_of, cut, documents, drop, hash_pair, order_bounds

#: Cells in each of the three parts of a sketch. Each digest lies in one cell of each part.
PART = 8
#: A sketch that fails to peel is replaced by this many, one for each next digit of the digests.
FAN = 8
_ITEM = "struct<d:bigint,chk:bigint,i0:int,i1:int,i2:int>"


def digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of the paragraphs (lines that are not empty)."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p))))


def _items(digest_array: Column, seed: int | Column) -> Column:
    """Each digest with its check sum and its three cells."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    where = lambda h, k: F.shiftrightunsigned(h, 16 * k).bitwiseAND(0xFFFF).cast("int") % PART
    hashed = F.transform(digest_array, lambda d: F.struct(d.alias("d"), F.xxhash64(F.lit("cell"), seed, d).alias("h")))
    return F.transform(hashed, lambda x: F.struct(
        x["d"].alias("d"), x["h"].bitwiseAND(0xFFFFFFFF).alias("chk"),
        *[where(F.shiftrightunsigned(x["h"], 16), k).alias(f"i{k}") for k in range(3)]))


def cells(items: Column) -> Column:
    """The sketch: 3 * PART cells of (n, key, chk), the count, XOR of digests and XOR of check sums."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("chk"))
    add = lambda c, x: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x["d"]).alias("key"), c["chk"].bitwiseXOR(x["chk"]).alias("chk"))
    part = lambda k: F.transform(F.sequence(F.lit(0), F.lit(PART - 1)), lambda c: F.aggregate(F.filter(items, lambda x: x[f"i{k}"] == c), empty, add))
    return F.concat(part(0), part(1), part(2))


def fingerprint(n: Column, sketch: Column) -> Column:
    """Printable sketch: number of digests, then count, XOR and check sum of each cell in hex."""
    return F.concat_ws(".", n.cast("string"), F.array_join(F.transform(sketch, lambda c: F.concat_ws(
        ",", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["chk"]))), "."))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct(
        (a["n"] - b["n"]).alias("n"), a["key"].bitwiseXOR(b["key"]).alias("key"), a["chk"].bitwiseXOR(b["chk"]).alias("chk")))


def peel(difference: Column, seed: int | Column) -> Column:
    """(done, left, right): how many digests only either side holds, recovered from the cells.

    A cell whose count is 1 or -1 and whose check sum fits its XOR holds a single digest: it is
    read off and taken out of its other cells, and so on until all cells are empty (done) or none
    is readable. All readable cells are taken at once in each of 3 * PART rounds, more
    than any peeling needs, since each round empties a cell.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed

    def single(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (F.xxhash64(F.lit("cell"), seed, c["key"]).bitwiseAND(0xFFFFFFFF) == c["chk"])

    def read(state: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(state["cells"], single), lambda c: F.struct(c["key"].alias("d"), c["n"].alias("n"))))
        hashed = F.transform(found, lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"), F.xxhash64(F.lit("cell"), seed, x["d"]).alias("h")))
        cell = lambda h, k: F.shiftrightunsigned(h, 16 + 16 * k).bitwiseAND(0xFFFF).cast("int") % PART + k * PART
        return F.transform(hashed, lambda x: F.struct(
            x["d"].alias("d"), x["n"].alias("n"), x["h"].bitwiseAND(0xFFFFFFFF).alias("chk"), *[cell(x["h"], k).alias(f"i{k}") for k in range(3)]))

    def without(c: Column, i: Column, found: Column) -> Column:
        hit = F.filter(found, lambda x: (x["i0"] == i) | (x["i1"] == i) | (x["i2"] == i))
        return F.aggregate(hit, c, lambda s, x: F.struct(
            (s["n"] - x["n"]).alias("n"), s["key"].bitwiseXOR(x["d"]).alias("key"), s["chk"].bitwiseXOR(x["chk"]).alias("chk")))

    def step(state: Column, _: Column) -> Column:
        # One-element transform: `read` is evaluated once and named.
        return F.when(state["idle"], state).otherwise(F.element_at(F.transform(F.array(read(state)), lambda found: F.struct(
            F.when(F.size(found) == 0, state["cells"]).otherwise(F.transform(state["cells"], lambda c, i: without(c, i, found))).alias("cells"),
            (state["left"] + F.size(F.filter(found, lambda x: x["n"] == 1))).alias("left"),
            (state["right"] + F.size(F.filter(found, lambda x: x["n"] == -1))).alias("right"), (F.size(found) == 0).alias("idle"))), 1))

    begin = F.struct(difference.alias("cells"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(False).alias("idle"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(3 * PART)), begin, step, lambda s: F.struct(
        (~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))).alias("done"), s["left"].alias("left"), s["right"].alias("right")))


def differences(pairs: DataFrame) -> DataFrame:
    """id, only_a, only_b for pairs (id, a, b) of digest arrays, from their sketches alone.

    Both sketches are subtracted and peeled. A pair that fails is retried with a sketch FAN times
    as large: FAN sketches, each over the digests with one value of the next digit. Only the parts
    that fail again grow further, so the work follows the number of differing digests, and a very
    long document becomes many rows. It ends by itself, since differing digests differ in some digit.
    """
    spark, done = pairs.sparkSession, []
    todo, level, scratch = pairs.select("id", F.lit(0).cast("bigint").alias("part"), "a", "b"), 0, []
    while True:
        tried = todo.withColumn("got", peel(subtract(cells(_items(F.col("a"), level)), cells(_items(F.col("b"), level))), level))
        tried = cut(tried.select("id", "part", "got", *[F.when(~F.col("got.done"), F.col(c)).alias(c) for c in ("a", "b")]))
        scratch.append(tried)
        done.append(tried.where("got.done").select("id", "got.left", "got.right"))
        rest = tried.where("not got.done")
        if rest.isEmpty():
            break
        digit = lambda d, level=level: F.shiftrightunsigned(d, 3 * (level % 21)).bitwiseAND(FAN - 1)
        parts = rest.select("id", "part", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("digit"))
        todo = parts.select("id", (F.col("part") * FAN + F.col("digit")).alias("part"), *[
            F.filter(c, lambda d: digit(d) == F.col("digit")).alias(c) for c in ("a", "b")]).where("size(a) + size(b) > 0")
        level += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    out = cut(every.groupBy("id").agg(F.sum("left").cast("bigint").alias("only_a"), F.sum("right").cast("bigint").alias("only_b")))
    for table in scratch:
        drop(spark, table)
    return out


def likeness(n_a: Column, n_b: Column, only_a: Column, only_b: Column) -> Column:
    """Shared digests over all digests; 1 where neither side has any."""
    every = n_a + only_b
    return F.when(every == 0, F.lit(1.0)).otherwise((n_a - only_a) / every).cast("double")


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row with `next_text`, the text that follows in descending order of doc_id; the last is followed by the first.

    Ties go by text hash, nulls come last. The order is cut into chunks by bounds on doc_id, so
    the text is shuffled once. The first row of each chunk, at most one a chunk, is also dealt
    to the chunk before it, where the last row needs it.
    """
    spark = docs.sparkSession
    bounds = order_bounds(docs.select("doc_id"))
    t1, t2 = hash_pair(F.col("text"))
    flat = docs.select("doc_id", "text", *columns, t1.alias("t1"), t2.alias("t2"), chunk_of(F.col("doc_id"), bounds).alias("chunk"))
    top = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not("t1").alias("u1"), F.bitwise_not("t2").alias("u2"))
    heads = sorted(((r["chunk"], r["head"]) for r in flat.groupBy("chunk").agg(F.max(top).alias("head")).collect()), key=lambda x: -x[0])
    if not heads:
        return flat.select("doc_id", "text", *columns, F.lit(None).cast("string").alias("next_text"))
    before = [(h["doc_id"], ~h["u1"], ~h["u2"], heads[i - 1][0]) for i, (_, h) in enumerate(heads)]
    firsts = spark.createDataFrame(before, "h_id bigint, h1 bigint, h2 bigint, to int")
    met = flat.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")), "left")
    own = F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("extra")))
    dealt = F.when(F.col("to").isNull(), own).otherwise(F.concat(own, F.array(F.struct(F.col("to").alias("chunk"), F.lit(True).alias("extra")))))
    rows = met.select("doc_id", "text", *columns, "t1", "t2", F.inline(dealt))
    w = Window.partitionBy("chunk").orderBy("extra", F.col("doc_id").desc_nulls_last(), "t1", "t2")
    return rows.select("doc_id", "text", *columns, "extra", F.lead("text").over(w).alias("next_text")).where("not extra").drop("extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of an edit of it, and how near they and the next document's are.

    The edited text ends, in place of its last floor(n / 2) code points, with as many of the next
    document's first ones (descending doc_id; all if it has fewer). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Nearness is the Jaccard
    likeness of paragraph digest sets, from the digests that peeling the subtracted sketches recovers.
    Repeated rows each give a row; texts without paragraphs are alike (1.0) among themselves. A single document is its own next.
    """
    pairs = with_next(documents(docs))
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.expr("left(next_text, int(floor(length(text) / 2)))"))
    rows = pairs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), digests(F.col("text")).alias("a"), digests(F.col("next_text")).alias("c"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("b"), "c")
    base = cut(rows.withColumn("id", F.monotonically_increasing_id()))
    both = base.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("b").alias("b")), F.struct(F.lit(1).alias("side"), F.col("c").alias("b")))).alias("x"), "a")
    near = differences(both.select(F.struct("id", "x.side").alias("id"), "a", "x.b"))
    near = near.select("id.*", "only_a", "only_b").groupBy("id").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("only_a", "only_b")])
    made = lambda c: fingerprint(F.size(c), cells(_items(F.col(c), 0)))
    n = {c: F.size(c).cast("bigint") for c in "abc"}
    return base.join(near, "id").select(
        "doc_id", "n_chars", "edited_sha256", made("a").alias("fingerprint"), made("b").alias("edited_fingerprint"),
        likeness(n["a"], n["b"], F.col("only_a0"), F.col("only_b0")).alias("near_edited"),
        likeness(n["a"], n["c"], F.col("only_a1"), F.col("only_b1")).alias("near_next"))
