"""Collation tables derived from the star-schema and text tables, for queries, benchmarks and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a documents file for each part its texts are dealt to: what is made of a text is many times its bytes.
PART_BYTES = 4_000_000


def text_parts(texts: DataFrame) -> int:
    spark = texts.sparkSession
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def spread_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents dealt over tasks by their ids, whatever the file's row groups are: the work on a text is far more than its bytes."""
    texts = table(spark, sf_dir, "documents").select("doc_id", *columns)
    return texts.repartition(text_parts(texts), "doc_id")


#: Letters of the texts that stand for romanised ones, so that transliteration and normalisation meet diacritics.
LETTERS = ("éèêüöäñçóáíßÉÈÊÜÖÄÑÇÓÁÍxqj", "āīūṛṝāñśṝāīṣāīūṛṝāñśṝāīṣṭñ")


def romanised(text: str = "text") -> Column:
    """Lower case, words of letters alone."""
    kept = "a-zA-Z" + "".join(sorted(set(LETTERS[1])))
    return F.lower(F.regexp_replace(F.translate(text, *LETTERS), f"[^{kept}]+", " "))


def witness_seq(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Eight witnesses a passage, whole texts. ``together``: dealt by passage, for work that brings its witnesses together anyway."""
    number, passage = F.col("doc_id") % 8, F.floor(F.col("doc_id") / 8).cast("long").alias("passage_id")
    if together:
        texts = table(spark, sf_dir, "documents").select("doc_id", passage, "text")
        texts = texts.repartition(text_parts(texts), "passage_id")
    else:
        texts = spread_documents(spark, sf_dir, "text").select("doc_id", passage, "text")
    return texts.select("passage_id", number.cast("int").alias("wit_ord"), F.concat(F.lit("W"), number.cast("string")).alias("siglum"), romanised().alias("seq"))


def witness_segments(spark: SparkSession, sf_dir: str, size: int = 120) -> DataFrame:
    """Whole texts as consecutive segments of at most ``size`` characters, cut behind a space unless a word is longer.

    The k-th segments of eight witnesses are the passage ``group.k``; a witness has no row in passages behind its end.
    """
    pieces = F.regexp_extract_all("seq", F.lit(f".{{1,{size - 1}}}(?: |$)|.{{1,{size}}}"), F.lit(0))
    cut = witness_seq(spark, sf_dir).select("passage_id", "wit_ord", "siglum", F.posexplode(F.when(F.length("seq") > 0, pieces).otherwise(F.array("seq"))).alias("k", "seq"))
    return cut.select(F.concat_ws(".", "passage_id", "k").alias("passage_id"), "wit_ord", "siglum", "seq")


def witness_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a passage of three witnesses: the text; a copy with words left out and longer ones; and a copy with other
    vowels, words put in and, in one document of four, an insertion of 300 characters."""
    doc, words = F.col("doc_id"), F.filter(F.split("seq", " "), lambda w: w != "")
    base = spread_documents(spark, sf_dir, "text").select("doc_id", romanised().alias("seq")).withColumn("words", words)
    shorter = F.transform("words", lambda x, i: F.when((doc + 7 * i) % 23 == 0, "").when((doc + i) % 31 == 0, F.concat(x, F.lit("a"))).otherwise(x))
    other = F.transform("words", lambda x, i: F.when((3 * doc + i) % 19 == 0, F.translate(x, "aeo", "eoa")).when((doc + 5 * i) % 41 == 0, F.concat(x, F.lit(" et"))).otherwise(x))
    put_in = F.when(doc % 4 == 0, F.array(F.reverse(F.substring("seq", 1, 300)))).otherwise(F.array().cast("array<string>"))
    longer = F.concat(F.slice(other, 1, 20), put_in, F.slice(other, F.lit(21), F.greatest(F.size("words") - 20, F.lit(0))))
    copies = F.array("words", F.filter(shorter, lambda w: w != ""), longer)
    held = base.select(F.col("doc_id").alias("passage_id"), F.posexplode(copies).alias("wit_ord", "words"))
    return held.select("passage_id", "wit_ord", F.concat(F.lit("W"), F.col("wit_ord").cast("string")).alias("siglum"), F.array_join("words", " ").alias("seq"))


def words_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_documents(spark, sf_dir, "text").select("doc_id", romanised().alias("seq"))


def passage_of() -> Column:
    return F.floor(F.col("l_orderkey") / 16).cast("long").alias("passage_id")


def column_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the few columns of the corpus, from one pruned scan."""
    return table(spark, sf_dir, "lineitem").agg(F.sort_array(F.collect_set((F.col("l_linenumber") - 1).cast("int"))).alias("ns"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main matrix: orders are witnesses, line numbers columns, flags readings.

    The grid of a passage is the cross product of its witnesses and the few columns of the corpus.
    """
    raw = table(spark, sf_dir, "lineitem").select(passage_of(), (F.col("l_orderkey") % 16).cast("int").alias("wit_ord"), (F.col("l_linenumber") - 1).cast("int").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("reading"))
    # Dealt by witness once: both groupings find their rows together.
    raw = raw.repartition("passage_id", "wit_ord").groupBy("passage_id", "wit_ord", "n").agg(F.min("reading").alias("reading"))
    # One row a witness with a map of its readings: the grid is filled without a second shuffle of cells.
    rows = raw.groupBy("passage_id", "wit_ord").agg(F.map_from_entries(F.collect_list(F.struct("n", "reading"))).alias("held"))
    grid = rows.crossJoin(F.broadcast(column_numbers(spark, sf_dir))).select("passage_id", "wit_ord", "held", F.explode("ns").alias("n"))
    return grid.select("passage_id", "wit_ord", F.concat(F.lit("W"), F.col("wit_ord").cast("string")).alias("siglum"), "n", F.coalesce(F.try_element_at("held", "n"), F.lit("")).alias("reading"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "lineitem").select(passage_of()).distinct()
    distinct = passages.crossJoin(F.broadcast(column_numbers(spark, sf_dir))).select("passage_id", F.explode("ns").alias("n"))
    return distinct.select("passage_id", "n", F.floor(F.col("n") / 3).cast("int").alias("group_id"), (F.col("n") % 7 == 5).alias("insignificant"), (F.col("n") % 7 == 2).alias("binary"))


def cells_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemma = F.when((F.col("n") % 2 == 0) & (F.col("reading") != ""), F.substring("reading", 1, 1))
    return cells(spark, sf_dir).withColumn("lemma", lemma)


def cells_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.when((F.col("reading") != "") & ((F.col("wit_ord") + F.col("n")) % 3 != 0), F.concat("reading", F.lit(" "))).otherwise(F.col("reading"))
    return cells(spark, sf_dir).withColumn("reading", spaced)


def cells_holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with columns and rows that are gaps throughout."""
    blank = ((F.col("passage_id") + F.col("n")) % 5 == 0) | ((F.col("passage_id") + F.col("wit_ord")) % 11 == 0)
    return cells(spark, sf_dir).withColumn("reading", F.when(blank, "").otherwise(F.col("reading")))


def cell_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where((F.col("passage_id") + F.col("wit_ord") + F.col("n")) % 97 == 0).select("passage_id", "siglum", "n", F.lit("ZZ").alias("new_reading"))


def tree(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A binary tree over sixteen witnesses: nodes 1 to 15 have children 2k and 2k + 1; leaf 16 + w is witness w."""
    nodes = spark.range(1, 32).select(F.lit("t16").alias("tree_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") >= 16, F.concat(F.lit("W"), (F.col("id") - 16).cast("string"))).alias("label"), (F.col("id") == 1).alias("is_root"))
    edges = spark.range(2, 32).select(F.lit("t16").alias("tree_id"), F.col("id").cast("int").alias("edge_ord"), F.floor(F.col("id") / 2).cast("int").alias("source"), F.col("id").cast("int").alias("target"), (F.lit(0.01) * ((F.col("id") * 7) % 13)).alias("length"))
    return nodes, edges


def customer_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each nation over its customers, taken sixteen at a time: the heap tree, grown from the tables."""
    nodes, edges = tree(spark)
    ids = table(spark, sf_dir, "customer").select(F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 160).cast("string")).alias("tree_id")).distinct()
    return nodes.drop("tree_id").crossJoin(ids), edges.drop("tree_id").crossJoin(ids)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments of passages; witness i of three reads a turn when (turn + i) mod 3 is not 0."""
    wits = F.filter(F.array(*[F.when((F.col("turn") + i) % 3 != 0, F.lit(w)) for i, w in enumerate("ABC")]), lambda w: w.isNotNull())
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("passage_id"), F.col("turn").cast("int").alias("seg_no"), F.col("role").alias("kind"), wits.alias("wits"), "text")
