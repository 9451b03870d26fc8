"""Benchmark decontamination on a distributed positional inverted index.

``PositionalIndex`` stores postings (document, term, position) of the training documents
as a table in the shared folder. It holds the terms that a search starts from: corpus
counts choose the two rarest terms of each test phrase, and only their postings are
written. A search shifts both lists by the terms' offsets in the phrase, intersects them,
and compares the whole phrase in the documents that are left. ``proximity`` indexes the terms it
is asked for and intersects their lists within a distance.

DataFrame functions only. Test terms are broadcast only below ``BROADCAST_CHARS``
characters; beyond that the same joins shuffle.

Defined results: a null text has no words and no phrases; every row is a document of its own,
also where rows share a ``doc_id`` or have none; repeated benchmark rows count once; empty tables
give empty results or no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import told_apart
from .scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of test terms or phrases up to which they are broadcast.
BROADCAST_CHARS = 32_000_000
#: Places to compare up to which they go to the documents, and not the documents to them.
BROADCAST_PLACES = 1_000_000


def lower_ascii(text: Column) -> Column:
    # lower() is the fast path where all characters are ASCII
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(text: Column) -> Column:
    """The words in order; an empty string stands before or after them if the text begins or ends otherwise."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)


def n_words(parts: Column) -> Column:
    edge = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return (F.size(parts) - F.when(F.size(parts) == 1, edge(1)).otherwise(edge(1) + edge(-1))).cast("long")


def _bounded(df: DataFrame, *texts: str) -> DataFrame:
    size = df.agg(F.sum(sum((F.char_length(F.col(c)) for c in texts), F.lit(32)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_CHARS else df


def phrases(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows of ``window`` words of the items: phrase_id, terms, k, items.

    An item of fewer words, but not none, is one window.
    """
    words = benchmark.select("item_id", F.filter(pieces(F.col("text")), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    at = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    terms = at.select("item_id", F.slice("w", F.col("i"), F.least(F.size("w"), F.lit(window))).alias("terms"))
    found = terms.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return materialize(found.select(F.monotonically_increasing_id().alias("phrase_id"), "terms", F.size("terms").alias("k"), "items"), "phrases")


class PositionalIndex:
    """Postings of chosen terms over documents, stored in the shared folder.

    ``postings``: doc_id, n_words, pos (0-based word position), term; each document also has a
    row with a null term, so that its length is there even without a posting.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame):
        """``terms``: a column ``term`` of distinct words to index; a doc_id may be of any type, but names one row."""
        self.terms = terms.select("term")
        self.docs = docs.select("doc_id", pieces(F.col("text")).alias("parts"))
        chosen = _bounded(terms.select("term", F.lit(True).alias("wanted")), "term")
        flat = self.docs.select("doc_id", n_words(F.col("parts")).alias("n_words"), (F.element_at("parts", 1) == "").cast("int").alias("skip"), (F.size("parts") - 1).alias("last"), F.posexplode("parts").alias("at", "term"))
        got = flat.join(chosen, "term", "left").filter(F.col("wanted") | (F.col("at") == F.col("last")))
        self.postings = materialize(
            got.select("doc_id", "n_words", F.explode(F.array_compact(F.array(F.when(F.col("at") == F.col("last"), F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("pos"))), F.when(F.col("wanted"), F.struct("term", (F.col("at") - F.col("skip")).alias("pos")))))).alias("p")).select("doc_id", "n_words", "p.term", "p.pos"),
            "postings",
        )

    def lengths(self) -> DataFrame:
        return self.postings.filter(F.col("term").isNull()).select("doc_id", "n_words")

    def occurrences(self, phrases: DataFrame) -> DataFrame:
        """Exact phrase matches: doc_id, start, k, items. ``phrases``: phrase_id, terms, k, items, first, second (term, at)."""
        lists = self.postings.filter(F.col("term").isNotNull()).select("doc_id", "term", "pos")
        ids = phrases.select("phrase_id", "k", F.col("first.term").alias("term"), F.col("first.at").alias("shift"), (F.col("k") > 1).alias("more"))
        one = lists.join(_bounded(ids, "term"), "term").select("doc_id", "phrase_id", (F.col("pos") - F.col("shift")).alias("start"), "more").filter("start >= 0")
        ids = phrases.filter("k > 1").select("phrase_id", F.col("second.term").alias("term"), F.col("second.at").alias("shift"))
        two = lists.join(_bounded(ids, "term"), "term").select("doc_id", "phrase_id", (F.col("pos") - F.col("shift")).alias("start")).filter("start >= 0")
        both = one.filter("more").select("doc_id", "phrase_id", "start").join(two.withColumnsRenamed({"doc_id": "d", "phrase_id": "p", "start": "s"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("phrase_id") == F.col("p")) & (F.col("start") == F.col("s"))).select("doc_id", "phrase_id", "start")
        left = both.unionAll(one.filter("not more").select("doc_id", "phrase_id", "start"))
        # what both lists allow is compared with the documents, each read once; few have any
        grouped = materialize(left.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("phrase_id", "start")).alias("at")), "candidates")
        size = grouped.agg(F.sum(F.size("at") + 4)).first()[0] or 0
        grouped = F.broadcast(grouped) if size <= BROADCAST_PLACES else grouped
        there = self.docs.join(grouped, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", F.filter("parts", lambda x: x != "").alias("w"), F.explode("at").alias("at"))
        tested = there.select("doc_id", "w", F.col("at.phrase_id").alias("phrase_id"), F.col("at.start").alias("start")).join(_bounded(phrases.select("phrase_id", "terms", "k", "items", F.array_join("terms", " ").alias("said")), "said").drop("said"), "phrase_id")
        return tested.filter(F.slice("w", F.col("start") + 1, F.col("k")) == F.col("terms")).select("doc_id", "start", "k", "items").distinct()

    def near(self, a: str, b: str, distance: int) -> DataFrame:
        """Proximity matches: documents and positions where ``b`` stands within ``distance`` words of ``a``."""
        missing = {a, b} - {r.term for r in self.terms.filter(F.col("term").isin(a, b)).collect()}
        if missing:
            raise ValueError(f"not indexed: {', '.join(sorted(missing))}")
        p = self.postings.select("doc_id", "term", "pos")
        x, y = p.filter(F.col("term") == a).select("doc_id", F.col("pos").alias("pos_a")), p.filter(F.col("term") == b).select(F.col("doc_id").alias("d"), F.col("pos").alias("pos_b"))
        # cells of that width make it an equi-join
        x = x.withColumn("cell", F.explode(F.array(*(F.floor(F.col("pos_a") / distance) + i for i in (-1, 0, 1)))))
        y = y.withColumn("c", F.floor(F.col("pos_b") / distance))
        return x.join(y, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("cell") == F.col("c"))).filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= distance) & (F.col("pos_a") != F.col("pos_b"))).select("doc_id", "pos_a", "pos_b")


def proximity(docs: DataFrame, a: str, b: str, distance: int) -> DataFrame:
    """Where the words ``a`` and ``b`` stand within ``distance`` words of each other: doc_id, pos_a, pos_b."""
    docs = docs.select("doc_id", "text")
    named = docs.select(F.struct("doc_id", told_apart(docs).alias("row")).alias("doc_id"), "text")
    terms = docs.sparkSession.createDataFrame([(x,) for x in sorted({a, b})], "term string")
    return PositionalIndex(named, terms).near(a, b, distance).select("doc_id.doc_id", "pos_a", "pos_b")


def rarest_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``phrases`` with the two rarest terms of each by corpus count (``first``, ``second``); those with a term that no document has are gone."""
    vocabulary = materialize(found.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    stream = docs.select(F.explode(pieces(F.col("text"))).alias("term"))
    counts = materialize(stream.join(_bounded(vocabulary, "term"), "term").groupBy("term").agg(F.count("*").alias("n")), "counts")
    placed = found.select("phrase_id", "k", F.posexplode("terms").alias("at", "term")).join(_bounded(counts, "term"), "term")
    best = placed.groupBy("phrase_id", "k").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by")).filter(F.size("by") == F.col("k"))
    return materialize(found.join(best.select("phrase_id", F.get("by", F.lit(0)).alias("first"), F.get("by", F.lit(1)).alias("second")), "phrase_id"), "anchored")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, row: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside occurrences), items (array of item ids), contaminated.

    ``row``: an expression of ``docs`` that names a row, which then is a column too.
    """
    own = told_apart(docs) if row is None else row
    docs = docs.select(F.struct("doc_id", own.alias("row")).alias("doc_id"), "text")
    anchored = rarest_first(docs, phrases(benchmark, window))
    terms = anchored.select(F.explode(F.array("first.term", "second.term")).alias("term")).filter(F.col("term").isNotNull()).distinct()
    index = PositionalIndex(docs, terms)
    found = index.occurrences(anchored).withColumn("end", F.col("start") + F.col("k"))
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = found.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0))).select("doc_id", F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered")).cast("long").alias("hit"), "items")
    hits = new.groupBy(F.col("doc_id").alias("d")).agg(F.sum("hit").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    out = index.lengths().join(hits, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast(hits.schema["items"].dataType))
    return out.select("doc_id.doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), (n_hit > 0).alias("contaminated"), *([] if row is None else ["doc_id.row"]))
