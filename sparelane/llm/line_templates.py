"""Line deduplication by a log-template tree.

The tree has a fixed depth: the first level is a line's token count, the next ``depth``
levels its leading tokens, where a token with a digit is a variable field. In a leaf, a
token is constant at its position if lines of at least ``min_docs`` documents (counted for each
distinct line) have it there, and a variable field otherwise; what is left of a line is its template. A template with at least
``min_constant`` of its tokens constant that ``min_docs`` documents have is recurring. Its
lines stay in the first of them (smallest doc_id) and are dropped from the others. A line without
variable fields, or of ``LONG`` tokens, also recurs if just two documents have all its tokens.

Counting is order-free, so the tree needs no sequential pass: each level is an aggregation,
with partial sums before each shuffle. DataFrame functions only.

Defined results: a null text has no lines and stays null; blank lines stay; rows that share a
``doc_id``, or have none, are one document for counting, and each loses lines of its own only; a null
``doc_id`` comes last; a document that had lines and loses all of them is marked ``emptied``; input
columns named n_lines, n_dropped or emptied give way to the operator's, other names are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded, told_apart
from .scratch import materialize

FIELD = "<*>"
#: Tokens from which a line with variable fields is compared as it stands, too.
LONG = 50


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, row, line_no, line (blanks squeezed), size (in tokens), leaf of each line that isn't blank."""
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    squeezed = F.when(F.col("line").rlike(r"[\t\x0b\x0c\r]|  "), F.regexp_replace("line", r"[\t\x0b\x0c\r ]+", " ")).otherwise(F.col("line"))
    lines = lines.withColumn("line", F.trim(squeezed)).filter("line <> ''")
    lines = lines.withColumn("size", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    # only the leading tokens are split off
    lines = lines.withColumn("lead", F.split(F.substring_index("line", " ", depth), " "))
    return lines.withColumn("leaf", F.concat_ws(" ", F.col("size").cast("string"), *(masked(F.get("lead", F.lit(i))) for i in range(depth)))).drop("lead")


def scanned_lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, row, line_no, leaf (a hash), key of the whole line where it has no variable field or is long: one scan for both searches."""
    whole = ~F.col("line").rlike("[0-9]") | (F.col("size") >= LONG)
    key = F.when(whole, F.unhex(F.md5(F.col("line").cast("binary"))))
    return materialize(_lines(docs, depth).select("doc_id", "row", "line_no", F.xxhash64("leaf").alias("leaf"), key.alias("key")), "lines")


def recurring_lines(docs: DataFrame, scanned: DataFrame, min_docs: int = 10, depth: int = 3, min_constant: float = 0.6) -> DataFrame:
    """Lines of recurring templates: doc_id, row, line_no, template, n_docs, first_doc; ``docs``: doc_id, row, text."""
    leaves = scanned.groupBy("leaf", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select(F.col("leaf").alias("h"))
    leaves = bounded(materialize(leaves, "leaves"))
    kept = _lines(docs, depth).join(leaves, F.xxhash64("leaf") == F.col("h"), "left_semi").withColumn("tokens", F.split("line", " "))
    masks = kept.select("leaf", "doc_id", "row", "line_no", F.transform("tokens", masked).alias("tokens"))
    rows = materialize(masks.withColumn("key", F.md5(F.array_join("tokens", " ").cast("binary"))), "leaf-lines")
    # each distinct masked line once, with its number of documents
    counted = rows.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"))
    flat = rows.select("leaf", "key", "tokens").dropDuplicates(["key"]).join(counted, "key").select("leaf", "key", "n", F.posexplode("tokens").alias("pos", "token"))
    constant = flat.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("docs")).filter((F.col("docs") >= min_docs) & (F.col("token") != FIELD)).select("leaf", "pos", "token", F.lit(True).alias("same"))
    general = flat.join(constant, ["leaf", "pos", "token"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("same"), F.col("token")).otherwise(F.lit(FIELD)).alias("t")))).alias("t"))
    general = general.filter(F.size(F.filter("t", lambda x: x["t"] != FIELD)) >= min_constant * F.size("t"))
    templates = materialize(general.select("key", F.array_join(F.col("t.t"), " ").alias("template")), "templates")
    of = rows.select("key", "doc_id", "line_no").join(templates, "key")
    by = of.groupBy("template", "doc_id").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") >= min_docs)
    chosen = templates.join(by, "template")
    return rows.select("key", "doc_id", "row", "line_no").join(chosen, "key").drop("key")


def repeated_lines(scanned: DataFrame) -> DataFrame:
    """Lines without variable fields, or long ones, that several documents have: doc_id, row, line_no, first_doc."""
    rows = scanned.filter("key is not null").select("doc_id", "row", "line_no", "key")
    by = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    several = by.filter(F.col("first_doc").isNotNull() & ((F.col("first_doc") < F.col("last_doc")) | F.col("unnamed"))).select("key", "first_doc")
    return rows.join(several, "key").drop("key")


#: Columns that :func:`drop_lines` adds.
ADDED = ("n_lines", "n_dropped", "emptied")


def drop_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, min_constant: float = 0.6) -> DataFrame:
    """``docs`` with text less its recurring lines, and n_lines, n_dropped, emptied."""
    names = [c for c in docs.columns if c not in ADDED]
    # one struct, so that no column of the input meets the operator's own
    docs = docs.select("doc_id", told_apart(docs).alias("row"), "text", F.struct(*names).alias("given"))
    scanned = scanned_lines(docs, depth)
    found = recurring_lines(docs, scanned, min_docs, depth, min_constant).select("doc_id", "row", "line_no", "first_doc")
    found = found.unionByName(repeated_lines(scanned).select("doc_id", "row", "line_no", "first_doc")).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    drop = found.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_set("line_no").alias("gone"))
    joined = docs.join(drop, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    none = F.col("gone").isNull()
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(none, 0).otherwise(F.size("gone")).cast("long")
    left = joined.select("given", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("left"))
    emptied = F.coalesce((F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("left", r"[\s]", "")) == ""), F.lit(False))
    row = [F.col("left").alias("text") if c == "text" else F.col("given")[c].alias(c) for c in names]
    return left.select(*row, "n_lines", "n_dropped", emptied.alias("emptied"))
