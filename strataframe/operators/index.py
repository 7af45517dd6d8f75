"""An index of chunks that is kept up by fingerprint, and an inverted index that ranks batches of questions.

The chunk index is a ledger: each run appends the chunks of documents that are new or changed, and a document's current chunks are those of the last run
that has it. The inverted index has a row a term and block of chunks, with the term's chunks and what the block can score at most; questions
join to terms, a question's best block gives it a limit, and chunks are scored in their blocks, which only those that can still be among the first leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators.lifecycle import INDEXED_IN
from strataframe.operators.retrieval import chunk_tables, chunk_texts
from strataframe.sources import ledger
from strataframe.sources.staging import stored

#: Extractions that may be indexed (fixed values).
EXTRACTED = ("completed", "ocr_unavailable")
_CHUNKS = "document_id long, chunk_index int, content string, section_heading string, content_hash string, token_count int, source_ref string, sheet_name string"
_DOCUMENTS = "document_id long, fingerprint string, chunks long"
#: BM25's constants, what a phrase and a heading add, and the most results of a question (fixed values).
K1, B, PHRASE, HEADING, MOST = 1.5, 0.75, 0.5, 0.3, 20


# chunks of documents, by run


def current_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, fingerprint, chunks, batch): each document's last committed run. Runs are in the order of their names."""
    return ledger.committed(spark, path, "documents", _DOCUMENTS).groupBy("document_id").agg(F.max(F.struct("batch", "fingerprint", "chunks")).alias("last")).select("document_id", "last.fingerprint", "last.chunks", "last.batch")


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document's last committed run."""
    return ledger.committed(spark, path, "chunks", _CHUNKS).join(current_documents(spark, path).select("document_id", "batch"), ["document_id", "batch"], "left_semi").drop("batch")


def indexable(documents: DataFrame) -> DataFrame:
    """Documents whose status and extraction allow it, with the fingerprint of text and tables."""
    ready = documents.where(F.col("status").isin(*INDEXED_IN) & F.col("extraction_status").isin(*EXTRACTED))
    return ready.withColumn("fingerprint", scalars.document_fingerprint(F.col("raw_text"), F.col("tables")))


def index_documents(spark: SparkSession, documents: DataFrame, path: str, run: str, force: bool = False) -> int:
    """Index what is new or changed in ``documents(document_id, status, extraction_status, raw_text, tables array<struct<source_ref, sheet_name, section_heading, headers, rows>>)``; how many documents that was.

    A document is left alone if its last committed run has its fingerprint, unless ``force`` is set. Text chunks come first, then those of its tables. The run is one batch of a ledger: if it dies,
    readers see the index as it was, and it can run again; a run without changes writes nothing. Run names rise.
    """
    ready = indexable(documents)
    if not force:
        ready = ready.join(current_documents(spark, path).select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")
    todo = stored(ready.select("document_id", "fingerprint", "raw_text", "tables"), spark)
    if todo.isEmpty():
        return 0
    none = F.lit(None).cast("string")
    texts = chunk_texts(todo.select("document_id", F.col("raw_text").alias("text"))).select("*", none.alias("source_ref"), none.alias("sheet_name"))
    tables = todo.select("document_id", F.posexplode("tables").alias("place", "t")).select("document_id", "place", "t.*")
    numbered = tables.withColumn("source_ref", F.coalesce("source_ref", F.concat(F.lit("table:"), (F.col("place") + 1).cast("string"))))
    cut = chunk_tables(numbered).withColumn("sheet_name", F.coalesce("sheet_name", F.lit("")))
    # tables follow the text, in the order of their place in the document
    places = numbered.select("document_id", "source_ref", "place").groupBy("document_id", "source_ref").agg(F.min("place").alias("place"))
    offset = todo.select("document_id").join(texts.groupBy("document_id").agg(F.count("*").alias("before")), "document_id", "left").na.fill(0, ["before"])
    order = Window.partitionBy("document_id").orderBy("place", "chunk_index")
    cut = cut.join(places, ["document_id", "source_ref"]).withColumn("at", F.row_number().over(order) - 1).join(offset, "document_id").withColumn("chunk_index", (F.col("at") + F.col("before")).cast("int"))
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    chunks = stored(texts.select(names).unionByName(cut.select(names)), spark)
    counted = todo.select("document_id", "fingerprint").join(chunks.groupBy("document_id").agg(F.count("*").alias("chunks")), "document_id", "left").na.fill(0, ["chunks"])
    counted = stored(counted, spark)
    ledger.append_once(spark, path, run, {"chunks": chunks, "documents": counted})
    return counted.count()


# the inverted index


def build(chunks: DataFrame, spark: SparkSession, path: str, block: int = 1024) -> None:
    """Index ``chunks(chunk_id long, scopes array<string>, content, section_heading)`` below ``path``; a chunk is found in each of its scopes.

    ``postings`` (scope, term, block, n, most, least, tokens, entries) has a row a term of a block, with what the block can score at most (the highest frequency and the shortest chunk) beside its chunks; ``scopes``
    (scope, n, avgdl) has their sizes; ``texts`` what the bonuses need, in folders. A block has about ``block`` chunks.

    Texts go to their block before they are cut into tokens, so words are counted and listed where they are: a text is moved once, and no row a word is.
    """
    heading = F.coalesce("section_heading", F.lit(""))
    n = chunks.count()
    blocks, drawers = max(1, -(-n // block)), max(1, -(-n // (16 * block)))
    hashed = F.xxhash64("chunk_id")
    tokens = F.concat(scalars.rank_tokens(F.coalesce("content", F.lit(""))), scalars.rank_tokens(heading))
    placed = chunks.select("chunk_id", F.array_distinct("scopes").alias("scopes"), "content", "section_heading", F.pmod(hashed, F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    words = placed.select("block", "chunk_id", "scopes", tokens.alias("tokens")).select("block", "chunk_id", "scopes", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    counted = words.groupBy("block", "chunk_id", "scopes", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    each = counted.select("block", "term", F.explode("scopes").alias("scope"), F.struct("chunk_id", "tf", "dl").alias("e"))
    listed = each.groupBy("scope", "term", "block").agg(F.count("*").alias("n"), F.max("e.tf").alias("most"), F.min("e.dl").alias("least"), F.sum("e.tf").alias("tokens"), F.collect_list("e").alias("entries"))  # a block's chunks
    listed.sortWithinPartitions("scope", "term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings").groupBy("scope").agg(F.sum("tokens").alias("tokens"))
    sizes = chunks.select(F.explode(F.array_distinct("scopes")).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))
    scopes = sizes.join(held, "scope", "left").select("scope", "n", F.greatest(F.lit(1.0), F.coalesce("tokens", F.lit(0)) / F.col("n")).alias("avgdl"))
    scopes.write.mode("overwrite").parquet(f"{path}/scopes")
    spark.range(1).select(F.lit(drawers).alias("drawers")).write.mode("overwrite").parquet(f"{path}/meta")
    drawer = F.pmod(hashed, F.lit(drawers)).cast("int")
    chunks.select("chunk_id", F.lower(F.coalesce("content", F.lit(""))).alias("low"), F.lower(heading).alias("head"), drawer.alias("drawer")).repartition("drawer").write.partitionBy("drawer").mode("overwrite").parquet(f"{path}/texts")


def _weight(tf: Column, dl: Column) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def search(spark: SparkSession, path: str, questions: DataFrame, top: int = 5, least: float = 0.1) -> DataFrame:
    """``questions(question_id, scope, text)`` to (question_id, rank, chunk_id, score): the first ``top`` (20 at most) of each, of them those of ``least`` or more.

    Statistics are of the question's scope. A token asked for twice counts twice; +0.5 if the tokens, with spaces between, stand in the content, +0.3 if one stands in the heading. Ties
    go to the smaller chunk. Questions without tokens, null ones and those of an unknown scope have no results.

    All questions are answered together. The best block of each by its bound is scored first; its places give the question a limit. The lists of the terms that are asked for go to
    their blocks, where chunks are scored, and only those that reach the limit leave. Texts are looked at where a chunk can still be among the first, in the folders that hold such chunks.
    """
    top = max(1, min(MOST, top))
    tokens = stored(questions.select("question_id", "scope", scalars.rank_tokens(F.col("text")).alias("tokens")).where("size(tokens) > 0"), spark)
    asked = tokens.select("question_id", "scope", F.explode("tokens").alias("term")).groupBy("question_id", "scope", "term").agg(F.count("*").alias("times"))
    asked = stored(asked.join(spark.read.parquet(f"{path}/scopes").withColumnRenamed("n", "chunks"), "scope"), spark)
    terms = stored(asked.select("scope", "term").distinct(), spark)
    postings = spark.read.parquet(f"{path}/postings").join(terms, ["scope", "term"], "left_semi")
    idf = F.log(1.0 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = asked.join(postings.groupBy("scope", "term").agg(F.sum("n").alias("df")), ["scope", "term"])
    rare = stored(rare.select("question_id", "scope", "term", "avgdl", (idf * F.col("times")).alias("gain")), spark)
    # what each block can give
    bound = F.sum(F.col("gain") * _weight(F.col("most"), F.col("least"))).alias("bound")
    best = postings.select("scope", "term", "block", "most", "least").join(rare, ["scope", "term"]).groupBy("question_id", "block").agg(bound)
    best = stored(best.groupBy("question_id").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block")), spark)
    # a block's lists come together, so that its chunks are scored where they are
    lists = postings.select("scope", "term", "block", "entries").repartition("block")

    def scored(wanted: DataFrame, on: list[str]) -> DataFrame:
        hits = lists.join(wanted, on).select("block", "question_id", "gain", "avgdl", F.inline("entries"))
        return hits.groupBy("block", "question_id", "chunk_id").agg(F.sum(F.col("gain") * _weight(F.col("tf"), F.col("dl"))).alias("base")).drop("block")

    near = F.col("limit").isNull() | (F.col("base") + PHRASE + HEADING + 1e-6 >= F.col("limit"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("base")))
    limited = lambda rows: rows.withColumn("r", place).where(F.col("r") == top).select("question_id", F.col("base").alias("limit"))
    limits = stored(limited(scored(rare.join(best, "question_id"), ["scope", "term", "block"])), spark)
    found = stored(scored(rare, ["scope", "term"]).join(limits, "question_id", "left").where(near).drop("limit"), spark)
    found = found.join(limited(found), "question_id", "left").where(near).drop("limit")
    # bonuses of those that are left
    drawers = spark.read.parquet(f"{path}/meta").first()[0]
    found = stored(found.join(tokens.select("question_id", "tokens"), "question_id").withColumn("drawer", F.pmod(F.xxhash64("chunk_id"), F.lit(drawers)).cast("int")), spark)
    # the condition, which all meet, lets Spark prune folders by what is found
    held = found.where("base > 0").join(spark.read.parquet(f"{path}/texts"), ["drawer", "chunk_id"])
    bonus = F.when(F.contains("low", F.array_join("tokens", " ")), PHRASE).otherwise(0.0) + F.when(F.exists("tokens", lambda t: F.contains(F.col("head"), t)), HEADING).otherwise(0.0)
    ranked = held.select("question_id", "chunk_id", F.round(F.col("base") + bonus, 3).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.where((F.col("rank") <= top) & (F.col("score") >= least)).select("question_id", "rank", "chunk_id", "score")


def narrative_context(spark: SparkSession, path: str, questions: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """(question_id, context, sources): the contents of the first ``top`` chunks of each question, in rank order, with their references; questions without any have no row."""
    found = stored(search(spark, path, questions, top), spark).join(chunks.select("chunk_id", "content", "source_ref"), "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "content", "source_ref")))  # top of them
    out = found.groupBy("question_id").agg(listed.alias("l"))
    return out.select("question_id", F.array_join(F.transform("l", lambda x: x["content"]), "\n\n").alias("context"), F.transform("l", lambda x: x["source_ref"]).alias("sources"))
