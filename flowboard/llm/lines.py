"""Line dedup: winnowed line hashes find runs of lines that repeat; later runs are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowboard.llm.common import cut, drop, hash_pair

#: Words a repeated run of lines needs; every shared run this long is found.
MIN_WORDS = 50
_KEY = ["doc_id", "t1", "t2"]


def _windows(lines: Column, min_words: int) -> Column:
    """All shortest windows of `min_words` words or more that begin or end at each line.

    `lines` lists (a, b, words, at) of the lines that hold words, so no window is longer than
    `min_words` lines. A window is (s, e, from, to, fp, w1, w2): first and last line among these and among all, its fingerprint (the
    least line hash in it) and 128 bits of hash over all its lines.
    """
    n = F.size(lines)

    def grow(piece: Column) -> Column:
        """Lines needed from the start of `piece` to reach the words, 0 if it never does."""
        add = lambda s, x: F.struct(
            (s["words"] + x["words"]).alias("words"), (s["lines"] + F.when(s["words"] < min_words, 1).otherwise(0)).alias("lines"))
        return F.aggregate(piece, F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")), add,
                           lambda s: F.when(s["words"] >= min_words, s["lines"]).otherwise(0))

    ahead = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("s"), (i + grow(F.slice(lines, i, F.lit(min_words))) - 1).alias("e")))
    back = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        (i - grow(F.reverse(F.slice(lines, F.greatest(i - min_words + 1, F.lit(1)), F.least(i, F.lit(min_words))))) + 1).alias("s"), i.alias("e")))
    # As numbers, since structs would be compared each with each; dense ones, since s and e in one half each would share few hash codes.
    number = lambda w: w["s"].cast("bigint") * min_words + w["e"] - w["s"]
    spans = F.array_distinct(F.transform(F.filter(F.concat(ahead, back), lambda w: w["s"] <= w["e"]), number))
    spans = F.transform(spans, lambda x: F.struct(
        F.floor(x / min_words).cast("int").alias("s"), (F.floor(x / min_words) + x % min_words).cast("int").alias("e")))
    # Cut first, then the field: the other way round every window would copy all lines.
    part = lambda w: F.slice(lines, w["s"], w["e"] - w["s"] + 1)
    return F.transform(spans, lambda w: F.struct(
        w["s"].alias("s"), w["e"].alias("e"), F.element_at(lines, w["s"])["at"].alias("from"), F.element_at(lines, w["e"])["at"].alias("to"), F.array_min(part(w)["a"]).alias("fp"),
        F.xxhash64(part(w)["a"]).alias("w1"), F.xxhash64(part(w)["b"]).alias("w2")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: doc_id, t1, t2 (hashes of the text), s, e (lines with words, from 1), from, to (the same among all lines).

    Lines without words are passed over. A run is deleted where the same lines, holding
    `min_words` words or more in all, occur earlier: in a document before it (by doc_id, nulls
    first, then text hash) or further up in the same one without overlap.

    Winnowing: of each shortest window of `min_words` words the line with the least hash is its
    fingerprint. Equal runs hold equal windows, hence equal fingerprints, so windows whose
    fingerprint occurs once are done with. The others are compared whole, which
    extends the match from the fingerprint both ways to the window's ends; each is matched with
    the first window like it, never with all. Overlapping and touching windows join to runs; as
    windows begin and end at every line, runs reach as far both ways as lines agree.
    """
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    worded = F.transform(split, lambda x, i: F.struct((i + 1).alias("at"), *[h.alias(k) for h, k in zip(hash_pair(x), "ab")], F.regexp_count(x, F.lit(r"[^ \t\r\f]+")).alias("words")))
    t1, t2 = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.filter(worded, lambda x: x["words"] > 0).alias("lines"))
    lines = lines.where(F.size("lines") > 0)
    windows = cut(lines.select(*_KEY, F.explode(_windows(F.col("lines"), min_words)).alias("w")).select(*_KEY, "w.*"))
    many = windows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    likely = windows.join(many, "fp", "left_semi")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "t1", "t2", "s", "e")
    first = likely.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    later = likely.join(first, ["w1", "w2"]).where(~same | (F.col("s") > F.col("first.e"))).select(*_KEY, "s", "e", "from", "to").distinct()
    by_doc = Window.partitionBy(*_KEY).orderBy("s", "e")
    reach = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("opens", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(by_doc))
    runs = cut(runs.groupBy(*_KEY, "run").agg(*[F.min(c).alias(c) for c in ("s", "from")], *[F.max(c).alias(c) for c in ("e", "to")]).drop("run"))
    drop(docs.sparkSession, windows)
    return runs


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with later repeated runs cut from `text`, and how much: row, text, lines_removed, chars_removed.

    `row` holds the input row in whole as a struct; `text` is what remains of it, null where it was null. Lines without
    words stay where they are. Documents that lose
    nothing keep their exact text; one that loses all lines gets an empty one. The first occurrence of any line always
    stays. Rows with the same doc_id and text are one document and get the same result: a repeated row is no repetition. An empty table
    gives an empty result. Runs are cut in one pass over a text's lines; a window is at most `min_words` lines, so long texts cost in proportion
    to their lines; a repeated line held by every row is one group of counts, and its windows
    join with one row.
    """
    spans = repeated_runs(docs, min_words).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("from", "to", "s", "e"))).alias("runs"))
    t1, t2 = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("k"), t1.alias("t1"), t2.alias("t2"))
    # Always sort-merge: text moves in proportion to the input, whether or not few documents have runs.
    met = rows.hint("merge").join(spans.withColumnRenamed("doc_id", "k0"), F.col("k").eqNullSafe(F.col("k0")) & (rows["t1"] == spans["t1"]) & (rows["t2"] == spans["t2"]), "left")
    # One mark a line, laid out run by run, then one pass over lines and marks.
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["to"])
    marks = F.flatten(F.transform("runs", lambda r, i: F.concat(
        F.array_repeat(F.lit(False), (r["from"] - before(i) - 1).cast("int")), F.array_repeat(F.lit(True), (r["to"] - r["from"] + 1).cast("int")))))
    left = F.zip_with(F.split("row.text", "\n"), marks, lambda x, m: F.when(F.coalesce(m, F.lit(False)) & x.rlike(r"[^ \t\r\f]"), F.lit(None)).otherwise(x))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["e"] - r["s"] + 1)
    return met.select("row", text.alias("text"), F.when(F.col("runs").isNull(), 0).otherwise(gone).alias("lines_removed")).withColumn(
        "chars_removed", F.coalesce(F.length("row.text") - F.length("text"), F.lit(0)))
