"""A lexical index that is kept, batch by batch, and searched exactly with block maxima.

A batch's documents are dealt by hash into ranges of about 32. A row of the postings is a block: one term in one range, with the
documents as differences from the block's first, term frequencies and document sizes, and for each frequency the smallest size,
of which the block's greatest BM25 part follows for any mean size. So old blocks stay exact when later batches change the
mean. Blocks lie in folders by a hash of the term, sorted by term, so that a search reads the buckets of its terms only.

A search reads the blocks' maxima first. The sum of the maxima of a query's terms bounds all documents of a range, and the ranges of the greatest
bounds are scored at once, which gives a k-th best score to reach. A query's weakest terms, as many as can't reach it together, are
left out at first: only documents with one of the other terms are candidates, and only those stay whose score so far,
with the maxima of the weak terms in their range, reaches it. For these the weak terms' blocks are read.

A batch counts once its totals are written, which is the last step: a batch that failed half-way is never seen, and
one that is sent again under the same name replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..shared import broadcast_if_small, exists, forget, shared_folder, written

RANGE_DOCS, BUCKETS = 32, 32


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def add_batch(docs: DataFrame, folder: str, batch: str, key: str, text: str, range_docs: int = RANGE_DOCS) -> None:
    """Add documents to the index in ``folder``; those whose key the index has from another batch are left as they are.

    Keys are integers, not null, and unique in a batch; a null text counts as a document without words.
    """
    spark = docs.sparkSession
    parts = {p: f"{folder}/{p}/batch={batch}" for p in ("totals", "docs", "postings")}
    forget(spark, parts["totals"])
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    if exists(spark, f"{folder}/totals"):
        rows = rows.join(documents(spark, folder).select("doc"), "doc", "left_anti")
    sized = rows.select("doc", F.size("w").alias("size"), "w")
    ranges = max(1, -(-rows.count() // range_docs))
    dealt = sized.withColumn("range", F.pmod(F.xxhash64("doc"), F.lit(ranges)).cast("int"))
    dealt.select("doc", "size", "range").write.mode("overwrite").parquet(parts["docs"])
    counts = dealt.select("doc", "size", "range", F.explode("w").alias("term")).groupBy("term", "range", "doc", "size").agg(F.count("*").alias("tf"))
    blocks = counts.groupBy("term", "range").agg(F.sort_array(F.collect_list(F.struct("doc", F.col("tf").cast("int").alias("tf"), "size"))).alias("p"))
    tf = F.col("p.tf")
    tops = F.transform(F.array_distinct(tf), lambda t: F.struct(t.alias("tf"), F.array_min(F.transform(F.filter("p", lambda x: x["tf"] == t), lambda x: x["size"])).alias("size")))
    packed = blocks.select(_bucket(F.col("term")).alias("bucket"), "term", "range", F.size("p").alias("n"), tops.alias("tops"), F.get("p.doc", 0).alias("first"), F.transform("p.doc", lambda d: d - F.get("p.doc", 0)).alias("docs"), tf.alias("tfs"), F.col("p.size").alias("sizes"))
    packed.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(parts["postings"])
    totals = spark.read.schema("doc long, size int, range int").parquet(parts["docs"]).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_words"))
    totals.coalesce(1).write.mode("overwrite").parquet(parts["totals"])


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("n_docs long, n_words long, batch string").parquet(f"{folder}/totals")


def _of_batches(spark: SparkSession, folder: str, part: str, schema: str) -> DataFrame:
    """A part of the index, of the batches that have totals."""
    paths = [f"{folder}/{part}/batch={r.batch}" for r in _batches(spark, folder).select("batch").collect()]
    schema += ", batch string"
    return spark.read.schema(schema).option("basePath", f"{folder}/{part}").parquet(*paths) if paths else spark.createDataFrame([], schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, size, range, batch) of all documents of the index."""
    return _of_batches(spark, folder, "docs", "doc long, size int, range int")


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks of the index."""
    return _of_batches(spark, folder, "postings", "term string, range int, n int, tops array<struct<tf:int,size:int>>, first long, docs array<long>, tfs array<int>, sizes array<int>, bucket int")


class Search:
    """One search of a set of queries: its terms, their weights, and which blocks were read."""

    def __init__(self, spark: SparkSession, folder: str, queries: DataFrame, query_key: str, query: str, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6):
        self.spark, self.folder, self.k, self.k1, self.b, self.digits, self.query_key = spark, folder, k, k1, b, digits, query_key
        totals = _batches(spark, folder).agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
        self.n_docs, self.mean = totals.d or 0, (totals.w or 0) / max(1, totals.d or 0)
        self.asked = written(queries.select(F.col(query_key).alias("q"), F.explode(F.array_distinct(words(F.col(query)))).alias("term")), "terms")
        self.wanted = self.asked.select("term", _bucket(F.col("term")).alias("bucket")).distinct()
        buckets = [r.bucket for r in self.wanted.select("bucket").distinct().collect()]
        near = postings(spark, folder).filter(F.col("bucket").isin(buckets)).join(broadcast_if_small(self.wanted), ["bucket", "term"])
        self.postings = near
        self.heads = written(near.select("term", "batch", "range", "n", F.array_max(F.transform("tops", lambda t: self.part(t["tf"], t["size"]))).alias("top")), "heads")
        df = self.heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.ln(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.terms = written(self.asked.join(df, "term").select("q", "term", idf.alias("idf")), "idf")

    def part(self, tf: Column, size: Column) -> Column:
        """What a term's frequency in a document of a size adds to its score, before its weight."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size / self.mean))

    def parts(self, blocks: DataFrame) -> DataFrame:
        """(q, batch, range, doc, part) of each posting in the blocks (q, term, batch, range)."""
        met = blocks.select("q", "term", "batch", "range").join(broadcast_if_small(self.terms), ["q", "term"]).join(self.postings.select("term", "batch", "range", "first", "docs", "tfs", "sizes"), ["term", "batch", "range"])
        each = met.select("q", "batch", "range", "idf", "first", F.explode(F.arrays_zip("docs", "tfs", "sizes")).alias("p"))
        return each.select("q", "batch", "range", (F.col("first") + F.col("p.docs")).alias("doc"), (F.col("idf") * self.part(F.col("p.tfs"), F.col("p.sizes"))).alias("part"))

    def best(self, found: DataFrame) -> DataFrame:
        rounded = found.select("q", "doc", F.round("score", self.digits).alias("score"))
        return rounded.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))).filter(F.col("rn") <= self.k)

    def run(self) -> DataFrame:
        """(query, doc, score, rn): the k best documents of each query, scores rounded, equal scores by document.

        ``blocks`` then tells for each query and block of its terms whether its postings were read. Queries without a known word have
        no row.
        """
        at = ["q", "batch", "range"]
        blocks = written(self.heads.join(broadcast_if_small(self.terms), "term").select(*at, "term", "n", (F.col("idf") * F.col("top")).alias("bound")), "blocks")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "batch", "range")
        leads = blocks.groupBy(*at).agg(F.sum("bound").alias("bound")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= self.k)
        leads = written(leads.select(*at), "leads")
        begun = written(self.parts(blocks.join(broadcast_if_small(leads), at, "left_semi")).groupBy("q", "doc").agg(F.sum("part").alias("score")), "scores")
        # a rounded score can tie with one that is lower by a last digit at most
        least = self.best(begun).filter(F.col("rn") == self.k).select("q", (F.col("score") - 10.0**-self.digits).alias("least"))
        # the terms of least weight, as many as together can't reach the k-th score: a document needs one of the others
        weak = Window.partitionBy("q").orderBy("most", "term")
        terms = blocks.groupBy("q", "term").agg(F.max("bound").alias("most")).join(least, "q", "left")
        terms = written(terms.select("q", "term", "least", (F.col("least").isNull() | (F.sum("most").over(weak) >= F.col("least"))).alias("needed")), "needed")
        marked = blocks.join(broadcast_if_small(leads), at, "left_anti").join(broadcast_if_small(terms), ["q", "term"])
        reaches = lambda have: F.col("least").isNull() | (have >= F.col("least"))
        rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0))
        open_ranges = marked.groupBy(*at).agg(F.first("least").alias("least"), F.sum("bound").alias("bound"), rest.alias("rest"), F.bool_or("needed").alias("some")).filter(F.col("some") & reaches(F.col("bound")))
        open_ranges = written(open_ranges, "open")
        strong = marked.filter("needed").join(open_ranges.select(*at), at, "left_semi")
        hits = self.parts(strong).groupBy(*at, "doc").agg(F.sum("part").alias("part")).join(open_ranges, at)
        hits = written(hits.filter(reaches(F.col("part") + F.col("rest"))).select(*at, "doc", "part"), "hits")
        filled = marked.filter(~F.col("needed")).join(hits.select(*at).distinct(), at, "left_semi")
        more = self.parts(filled).join(hits.select("q", "doc"), ["q", "doc"], "left_semi").select("q", "doc", "part")
        scores = hits.select("q", "doc", "part").unionByName(more).groupBy("q", "doc").agg(F.sum("part").alias("score"))
        out = written(self.best(begun.unionByName(scores)), "found")
        read = strong.select(*at, "term").unionByName(filled.select(*at, "term")).unionByName(blocks.join(leads, at, "left_semi").select(*at, "term"))
        self.blocks = blocks.join(read.withColumn("read", F.lit(True)), [*at, "term"], "left").withColumn("read", F.coalesce("read", F.lit(False)))
        self.made = [blocks, leads, begun, terms, open_ranges, hits, self.asked, self.heads, self.terms]
        return out.select(F.col("q").alias(self.query_key), "doc", "score", "rn")

    def forget(self) -> None:
        """Delete the tables that the search wrote, but for its result."""
        forget(self.spark, *self.made)


def search(spark: SparkSession, folder: str, queries: DataFrame, query_key: str, query: str, k: int, **settings) -> DataFrame:
    """The k best documents of each query by BM25, from the index in ``folder`` (see ``Search.run``)."""
    asked = Search(spark, folder, queries, query_key, query, k, **settings)
    found = asked.run()
    asked.forget()
    return found


def search_documents(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query: str, k: int) -> DataFrame:
    """An index of ``docs``, searched once and deleted."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "index")
    add_batch(docs, folder, "0", key, text)
    found = search(spark, folder, queries, query_key, query, k)
    forget(spark, folder)
    return found
