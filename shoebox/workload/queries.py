"""One whole-table Spark query per operator. SQL twins live in ``oracle.py`` under the same names."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions import paths, vectors as vec
from shoebox.functions.bits import hamming_hex
from shoebox.operators import checks, exact, folders, hash_index, near_dup, parts, stats
from shoebox.operators import embedding, filters, lifecycle, search
from shoebox.session import dense_order, durable, shared_dir
from shoebox.sources.catalog import Catalog
from shoebox.streaming import changes as change_stream
from shoebox.workload import tables as t

QUERIES = {}
DIMENSIONS = 64
QUERY_VECTOR = [math.cos(i) for i in range(DIMENSIONS)]  # a fixed direction, as a text encoder would give


def query(f):
    QUERIES[f.__name__] = f
    return f


# ------------------------------------------------------------------ scalar columns


@query
def content_hash(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", t.document_sha().alias("sha256_hex"))


@query
def mime_type(spark, sf):
    return t.scanned(spark, sf).select(
        F.col("ord").alias("doc_id"),
        paths.extension("path").alias("extension"),
        paths.mime_type("path").alias("mime"),
        "file_size",
    )


@query
def object_key(spark, sf):
    return t.scanned(spark, sf).select(
        F.col("ord").alias("doc_id"),
        paths.object_key("sha256_hex").alias("object_key"),
        paths.object_path("album", "sha256_hex").alias("object_path"),
    )


@query
def phash(spark, sf):
    return t.pictures(spark, sf).select(F.col("ord").alias("doc_id"), "phash")


@query
def hamming(spark, sf):
    docs = t.table(spark, sf, "documents")
    left = F.substring(t.document_sha(), 1, 16)
    right = F.substring(F.md5(F.col("text").cast("binary")), 1, 16)
    return docs.select("doc_id", hamming_hex(left, right).cast("int").alias("distance"))


@query
def l2_normalize(spark, sf):
    units = t.vectors(spark, sf).select("id", F.posexplode(vec.l2_normalize("embedding")).alias("pos", "x"))
    return units.select(F.col("id").alias("vec_id"), "pos", F.round("x", 5).alias("x"))


@query
def cosine_score(spark, sf):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return t.vectors(spark, sf).select(
        F.col("id").alias("vec_id"), F.round(vec.cosine("embedding", q), 4).alias("score")
    )


@query
def fmt_bytes(spark, sf):
    orders = t.table(spark, sf, "orders")
    size = F.floor("o_totalprice") * F.col("o_custkey") * F.col("o_custkey")
    return orders.select("o_orderkey", size.alias("bytes"), paths.human_bytes(size).alias("shown"))


@query
def folder_title(spark, sf):
    docs = t.table(spark, sf, "documents")
    title = F.when(F.col("lang") == "en", "").when(F.col("lang") == "de", F.upper("source"))
    folder = F.concat(F.lit("/lib/"), "lang", F.lit("/"), "source")
    return docs.select("doc_id", paths.folder_title(title, folder).alias("title"))


# ------------------------------------------------------------------ filters


@query
def image_filter(spark, sf):
    return filters.images_only(t.scanned(spark, sf)).select(F.col("ord").alias("doc_id"), "path")


@query
def needs_embedding(spark, sf):
    return t.labelled_contents(spark, sf).where(filters.needs_embedding()).select("id", "status")


@query
def recovery_queue(spark, sf):
    return filters.unfinished(t.labelled_contents(spark, sf)).select("id", "status")


# ------------------------------------------------------------------ exact duplicates and files


@query
def exact_dedup(spark, sf):
    return exact.first_per_hash(t.scanned(spark, sf)).select("sha256_hex", F.col("ord").alias("first_doc"), "copies")


@query
def store_once(spark, sf):
    """English files arrive in a library that holds all other languages; one row per key to put."""
    files = t.scanned(spark, sf)
    held = files.where("lang <> 'en'").select("sha256_hex", F.lit("INDEXED").alias("status"))
    return exact.to_store(files.where("lang = 'en'"), held)


@query
def incremental_scan(spark, sf):
    """The library knows each path as of its last change below 100; which paths must be read again?"""
    rows = t.changes(spark, sf)
    scan = rows.groupBy("path").agg(F.max("disk_mtime").alias("disk_mtime"))
    known = rows.where("value < 100").groupBy(F.col("path").alias("local_path")).agg(
        F.max("disk_mtime").alias("disk_mtime")
    )
    return exact.incremental(scan.withColumn("disk_mtime", F.col("disk_mtime").cast("timestamp")),
                             known.withColumn("disk_mtime", F.col("disk_mtime").cast("timestamp"))).select("path")


@query
def missing_files(spark, sf):
    rows = t.changes(spark, sf)
    files = rows.groupBy(F.col("path").alias("local_path")).agg(F.lit(True).alias("present_locally"))
    scan = rows.groupBy("path").agg(F.max("value").alias("top")).where("top > 200").select("path")
    return exact.missing_files(scan, files).select(F.col("local_path").alias("path"))


@query
def latest_per_path(spark, sf):
    rows = t.changes(spark, sf).select("path", "disk_mtime", "ord", F.col("event_type").alias("kind"))
    return exact.latest_per_path(rows, ["disk_mtime", "ord"]).select("path", F.col("ord").alias("event_id"), "kind")


@query
def upsert_files(spark, sf):
    before, batch = t.first_and_last(spark, sf)
    state = exact.upsert_files(
        t.as_file_rows(before),
        t.as_file_rows(batch).withColumnRenamed("local_path", "path").withColumn("image_type", F.lit("DUPLICATE")),
    )
    return state.select(
        "id", "local_path", "sha256_hex", "file_size", "image_type", "content_id",
        F.unix_micros(F.col("disk_mtime").cast("timestamp")).alias("mtime_us"),
    )


@query
def file_classification(spark, sf):
    before, batch = t.first_and_last(spark, sf)
    typed = exact.classify(batch.select("ord", "path", "content_id"), t.as_file_rows(before), F.lit(False))
    return typed.select("path", "content_id", "image_type")


@query
def sync_report(spark, sf):
    rows = t.changes(spark, sf)
    scan = rows.groupBy("path").agg(
        F.max_by("event_type", "ord").alias("kind"), F.max("disk_mtime").cast("timestamp").alias("disk_mtime")
    )
    known = rows.where("value < 100").groupBy(F.col("path").alias("local_path")).agg(
        F.max("disk_mtime").cast("timestamp").alias("disk_mtime")
    )
    read = exact.incremental(scan, known).select("path").withColumn("_read", F.lit(True))
    outcome = (
        F.when(F.col("_read").isNull(), "skipped").when(F.col("kind") == "error", "error").otherwise("ingested")
    )
    return lifecycle.sync_report(scan.join(read, "path", "left").select(outcome.alias("outcome")))


# ------------------------------------------------------------------ near duplicates


@query
def near_dup_match(spark, sf):
    """What each content matches when contents arrive in order of their first file."""
    return near_dup.match_earlier(t.contents(spark, sf))


@query
def near_dup_stored(spark, sf):
    """Match all documents without a label against the stored ones, those with a label."""
    docs = t.pictures(spark, sf)
    labels = t.table(spark, sf, "labels").select(F.col("doc_id").alias("ord")).distinct()
    docs = durable(docs.join(labels.withColumn("_labelled", F.lit(True)), "ord", "left"))
    stored = docs.where("_labelled").groupBy("sha256_hex").agg(
        F.min("ord").alias("id"), F.min("bits").alias("bits")
    )
    probes = docs.where("_labelled is null")
    found = near_dup.match_stored(probes, stored)
    return probes.join(found, "bits").select(F.col("ord").alias("doc_id"), "content_id", "distance")


@query
def near_dup_indexed(spark, sf):
    """The same match through a stored index: two batches of hashes appended, looked up by the documents without a label."""
    docs = t.pictures(spark, sf)
    labels = t.table(spark, sf, "labels").select(F.col("doc_id").alias("ord")).distinct()
    docs = durable(docs.join(labels.withColumn("_labelled", F.lit(True)), "ord", "left"))
    stored = durable(docs.where("_labelled").groupBy("sha256_hex").agg(F.min("ord").alias("id"), F.min("bits").alias("bits")))
    catalog = Catalog(spark, f"{shared_dir(spark)}/shoebox/library-{uuid.uuid4().hex}")
    for batch in (stored.where("id % 2 = 0"), stored.where("id % 2 = 1")):
        catalog.commit(append={"hashes": hash_index.index_rows(batch)})
    probes = docs.where("_labelled is null")
    around = durable(hash_index.near(catalog.read("hashes"), probes))
    found = near_dup.match_stored(probes, around)
    return probes.join(found, "bits").select(F.col("ord").alias("doc_id"), "content_id", "distance")


@query
def dup_groups(spark, sf):
    fresh = t.contents(spark, sf)
    nothing = spark.createDataFrame([], "id long, bits long, dup_group long")
    return near_dup.group_keep(nothing, fresh)


@query
def dup_groups_incremental(spark, sf):
    """Labelled documents are stored, ungrouped contents; the others arrive afterwards, in order."""
    docs = t.pictures(spark, sf)
    labels = t.table(spark, sf, "labels").select(F.col("doc_id").alias("ord")).distinct()
    docs = docs.join(labels.withColumn("_labelled", F.lit(True)), "ord", "left")
    per_sha = durable(
        docs.groupBy("sha256_hex").agg(
            F.min(F.when(F.col("_labelled"), F.col("ord"))).alias("stored_id"),
            F.min("ord").alias("first_id"),
            F.min("bits").alias("bits"),
        )
    )
    stored = per_sha.where("stored_id is not null").select(
        F.col("stored_id").alias("id"), "bits", F.lit(None).cast("long").alias("dup_group")
    )
    last = F.lit(10**12).cast("long")
    fresh = per_sha.where("stored_id is null").select((F.col("first_id") + last).alias("id"), "bits")
    return near_dup.group_keep(stored, fresh)


@query
def near_dup_discard(spark, sf):
    """Policy discard from an empty library: every file whose content is not kept, and its match."""
    files = durable(t.pictures(spark, sf).select("ord", "sha256_hex", "bits"))
    nodes = durable(files.groupBy("bits").agg(F.min("ord").alias("ord")))
    nothing = spark.createDataFrame([], "bits long, ord long")
    kept = near_dup.keep_in_order(nothing, nodes)
    kept = durable(kept.select("bits", "ord", F.col("ord").alias("content_id")))
    kept_sha = files.join(kept.select("ord"), "ord", "left_semi").select("sha256_hex")
    others = files.join(kept_sha, "sha256_hex", "left_anti")
    return near_dup.assign_similar(others, kept).select(F.col("ord").alias("doc_id"), "content_id", "distance")


@query
def compare_folders(spark, sf):
    """Pictures of the English folder that no other language's folder holds."""
    docs = durable(t.pictures(spark, sf).select(F.col("ord").alias("path"), "sha256_hex", "bits", "lang"))
    only = exact.compare(docs.where("lang = 'en'"), docs.where("lang <> 'en'"))
    return only.select(F.col("path").alias("doc_id"))


# ------------------------------------------------------------------ folders


@query
def resolve_folder(spark, sf):
    named = dense_order(t.page_folder_paths(spark, sf), "path", name="id", start=1)
    listed = named.select("id", F.col("path").alias("parent_folder_path"))
    return folders.resolve_owner(t.page_paths(spark, sf), listed).select("page_id", "parent_folder_id")


@query
def upsert_folders(spark, sf):
    """Folders of https pages are registered; then all page folders are synced."""
    every = t.page_folder_paths(spark, sf)
    known = dense_order(every.where("path like 'https:%'"), "path", name="id", start=1).select(
        "id",
        F.col("path").alias("parent_folder_path"),
        F.lit(None).cast("timestamp").alias("added_at"),
        F.lit("known").alias("title"),
    )
    wanted = every.withColumn("title", F.lit("").cast("string"))
    return folders.register_folders(known, wanted, F.lit(None).cast("timestamp")).select(
        "id", "parent_folder_path", "title"
    )


# ------------------------------------------------------------------ statistics and checks


@query
def library_stats(spark, sf):
    return stats.library_stats(t.orders_as_content(spark, sf), t.lines_as_files(spark, sf))


@query
def saved_bytes(spark, sf):
    return stats.saved_bytes(t.orders_as_content(spark, sf), t.lines_as_files(spark, sf))


@query
def library_stats_ext(spark, sf):
    ext = stats.index_stats(t.orders_as_content(spark, sf), t.vectors(spark, sf))
    return ext.select(F.date_format("last_upload", "yyyy-MM-dd").alias("last_upload"), "index_bytes")


@query
def status_rollup(spark, sf):
    before = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "PENDING")
        .when(F.col("o_orderpriority") == "2-HIGH", "UPLOADING")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ERROR")
        .when(F.col("o_orderpriority") == "5-LOW", "INDEXED")
        .otherwise("UPLOADED")
    )
    stored = lifecycle.after_store(before, F.col("o_orderstatus") != "P")
    final = lifecycle.after_embedding(stored, F.col("o_orderstatus") == "O", F.col("o_totalprice") > 100000)
    rows = t.table(spark, sf, "orders").select(final.alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("contents"))


@query
def check_violations(spark, sf):
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "UPLOADED").when(F.col("o_orderstatus") == "F", "DONE").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("total_size"),
    )
    return checks.check_violations(rows, "uploads")


@query
def unique_violations(spark, sf):
    rows = t.scanned(spark, sf).select("sha256_hex")
    return checks.unique_violations(rows, "content")


@query
def fk_violations(spark, sf):
    files = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = t.orders_as_content(spark, sf).where("status <> 'ERROR'").select("id")
    return checks.fk_violations(files, "l_orderkey", parents)


@query
def fk_set_null(spark, sf):
    files = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = t.orders_as_content(spark, sf).where("status <> 'ERROR'").select("id")
    return checks.release_missing(files, "l_orderkey", parents)


# ------------------------------------------------------------------ parts of large objects


def _upload_plan(spark, sf):
    plan = parts.plan_parts(t.orders_as_uploads(spark, sf).select(F.col("id").alias("upload_row_id"), "total_size"))
    return plan.select("upload_row_id", "part_number", "part_offset", "part_size")


@query
def chunk_plan(spark, sf):
    return _upload_plan(spark, sf)


@query
def chunk_pending(spark, sf):
    pending = parts.pending_parts(_upload_plan(spark, sf), t.lines_as_ledger(spark, sf))
    return pending.select("upload_row_id", "part_number", "part_size", "ledger_id")


@query
def chunk_manifest(spark, sf):
    done = parts.manifests(_upload_plan(spark, sf), t.lines_as_ledger(spark, sf))
    line = F.transform("manifest", lambda p: F.concat_ws(":", p["part_number"].cast("string"), p["part_etag"]))
    return done.select("upload_row_id", "parts", F.array_join(line, ",").alias("manifest"))


@query
def resume_decision(spark, sf):
    customers = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("content_id"))
    as_of = F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")
    return parts.resume_decisions(customers, t.orders_as_uploads(spark, sf), as_of)


@query
def reconcile_uploads(spark, sf):
    listed = t.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("upload_id")
    )
    return parts.reconcile(listed, t.orders_as_uploads(spark, sf))


# ------------------------------------------------------------------ vectors


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 4))


@query
def search_topk(spark, sf):
    return _rounded(search.search(t.vectors(spark, sf), QUERY_VECTOR))


@query
def search_lines(spark, sf):
    found = search.search(t.vectors(spark, sf), QUERY_VECTOR)
    return found.select(paths.result_line("score", "id", "s3_path").alias("line"))


@query
def search_batch(spark, sf):
    """One query per label: the mean of its vectors, against all vectors."""
    rows = t.vectors(spark, sf)
    means = (
        rows.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))  # one entry per dimension
        .select(F.col("label").cast("long").alias("query_id"), F.col("xs.x").alias("embedding"))
    )
    return _rounded(search.search_batch(rows, means))


@query
def more_like_this(spark, sf):
    return _rounded(search.more_like_this(t.vectors(spark, sf), 0))


def letter_counts():
    """Encoder for texts and payloads alike: how often each character code modulo 64 occurs."""

    def encode(inputs):
        def one(value):
            text = value.decode("utf-8") if isinstance(value, (bytes, bytearray)) else value
            if not text:
                raise ValueError("empty input")
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            return np.bincount(codes % DIMENSIONS, minlength=DIMENSIONS)

        return np.stack([one(v) for v in inputs])

    return encode


@query
def embed_queries(spark, sf):
    """Every benchmark text as a query: encode, then search all vectors."""
    texts = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    encoded = embedding.embed_queries(texts, letter_counts)
    return _rounded(search.search_batch(t.vectors(spark, sf), durable(encoded.drop("text")), threshold=None))


def _cautious():
    encode = letter_counts()

    def strict(inputs):
        if any(len(v) < 1000 for v in inputs):
            raise ValueError("too small")
        return encode(inputs)

    return strict


@query
def embed_update(spark, sf):
    """Encode what needs a vector; the encoder refuses texts below 1,000 characters."""
    done = embedding.embed_update(t.labelled_contents(spark, sf), _cautious, "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return done.select("id", "status", F.round(total, 2).alias("vector_sum"))


@query
def embed_images(spark, sf):
    """Vector of every payload's bytes, as one row per content and non-zero dimension count."""
    docs = t.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    encoded = t.spread(docs).select("doc_id", embedding.encode_udf(letter_counts)("payload").alias("e"))
    used = F.size(F.filter("e.vector", lambda x: x > 0))
    return encoded.select("doc_id", used.alias("dimensions"), F.col("e.error").isNotNull().alias("failed"))


# ------------------------------------------------------------------ streams


def _stream_table(spark, sf, name):
    static = t.table(spark, sf, name)
    # The last letter as a pattern: a stream reads folders or patterns, not one named file.
    return spark.readStream.schema(static.schema).parquet(f"{sf}/{name}.parque[t]")


@query
def stream_dedup(spark, sf):
    """Repeated notifications: the event table read twice in one stream, each change kept once."""
    events = _stream_table(spark, sf, "events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".jpg")).alias("path"),
        F.col("ts").cast("timestamp").alias("mtime"),
    )
    once = change_stream.drop_repeats(events.unionByName(events))
    out = f"{shared_dir(spark)}/shoebox/{uuid.uuid4().hex}"
    run = once.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/checkpoint"
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(once.schema).parquet(f"{out}/rows")
    return rows.select("path", F.unix_micros("mtime").alias("mtime_us"))


@query
def stream_changes(spark, sf):
    """The event table as a change feed: each micro-batch is folded into the state per path."""
    feed = _stream_table(spark, sf, "events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".jpg")).alias("path"),
        F.col("ts").cast("timestamp").alias("mtime"),
        F.col("event_id"),
        F.floor(F.col("value") * 100).cast("long").alias("file_size"),
    )
    checkpoint = f"{shared_dir(spark)}/shoebox/{uuid.uuid4().hex}"
    state = change_stream.fold_latest(feed, checkpoint, ["mtime", "event_id"])
    return state.select("path", "event_id", "file_size")
