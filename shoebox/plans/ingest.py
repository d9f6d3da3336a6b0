"""Batch ingest: decide, store, record, embed. Each stage ends in one commit of the catalogue.

A job that dies between two commits leaves contents as UPLOADING or UPLOADED; the next run finds
and finishes them, and stored objects are never stored twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox import settings
from shoebox.functions.bits import hex_to_bits
from shoebox.functions.paths import object_key
from shoebox.operators import exact, filters, folders, hash_index, lifecycle, near_dup, parts, stats
from shoebox.operators.embedding import Encoder, embed_queries, encode_each
from shoebox.operators.narrow import narrowed
from shoebox.operators.search import search as vector_search
from shoebox.plans.decide import decide
from shoebox.session import dense_order, durable
from shoebox.sources import facts as fact_source
from shoebox.sources import scan, store
from shoebox.sources.catalog import Catalog, one_version
from shoebox.sources.storage import plain

ENCODE_ROWS = 16  # pictures handed to the model at once
INDEX_SETS = 16  # appended sets of the hash index before they are rebuilt as one


@dataclass
class Library:
    """A catalogue, the object store beside it, and the parameters of ingest."""

    spark: SparkSession
    catalog_root: str
    store_root: str
    bucket: str = "library"
    policy: str = settings.DEFAULT_POLICY
    threshold: int = settings.NEAR_THRESHOLD
    single_put_limit: int = settings.SINGLE_PUT_LIMIT
    part_size: int = settings.PART_SIZE
    encoder: Callable[[], Encoder] | None = None
    decoder: fact_source.Decoder | None = None
    catalog: Catalog = field(init=False)

    def __post_init__(self):
        filters.check_policy(self.policy)
        self.catalog = Catalog(self.spark, self.catalog_root)

    def table(self, name: str) -> DataFrame:
        return self.catalog.read(name)


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc))


def _update(content: DataFrame, changes: DataFrame) -> DataFrame:
    """The contents with the changed columns replaced by ``id``."""
    changed = [c for c in changes.columns if c != "id"]
    new = changes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in changed])
    touched = F.col("_id").isNotNull()
    return content.join(new, F.col("id") == F.col("_id"), "left").select(
        *[(F.when(touched, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)) for c in content.columns]
    )


def _changed(content: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of the contents that change, after it. ``changes`` is a durable table."""
    return _update(narrowed(content, changes, "id"), changes)


@one_version
def ensure_folder(lib: Library, path: str, title: str | None = None) -> int:
    """Id of the synced folder ``path``, registering it on first use."""
    known = lib.table("synced_folders")
    row = known.where(F.col("parent_folder_path") == path).select("id").first()
    if row is None:
        wanted = lib.spark.createDataFrame([(path, title)], "path string, title string")
        lib.catalog.commit(replace={"synced_folders": folders.register_folders(known, wanted, _now())})
        row = lib.table("synced_folders").where(F.col("parent_folder_path") == path).select("id").first()
    return row[0]


def _store_large(lib: Library, large: DataFrame) -> DataFrame:
    """Store large files by parts, resuming what the ledger knows. Returns ``id``, ``error``."""
    uploads, ledger = lib.table("uploads"), lib.table("upload_parts")
    contents = large.select(F.col("id").alias("content_id"), "file_size", "path", "sha256_hex")
    decisions = durable(parts.resume_decisions(contents, uploads, _now()))
    starting = decisions.where("decision = 'fresh'").join(contents, "content_id")
    last = uploads.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    fresh = durable(
        dense_order(starting, "content_id", name="id", start=last + 1).select(
            "id",
            F.expr("uuid()").alias("upload_id"),
            "content_id",
            F.lit("UPLOADING").alias("status"),
            F.col("file_size").alias("total_size"),
            _now().alias("initiated_at"),
        )
    )
    uploads = uploads.unionByName(fresh)
    # Upload ids are on record before the first part leaves.
    lib.catalog.commit(replace={"uploads": uploads})
    uploads = lib.table("uploads")
    active = fresh.select("id", "upload_id", "content_id").unionByName(
        decisions.where("decision = 'resume'").select(
            F.col("upload_row_id").alias("id"), "upload_id", "content_id"
        )
    )
    active = durable(active.join(contents, "content_id"))
    plan = durable(
        parts.plan_parts(active, "file_size", lib.single_put_limit, lib.part_size).withColumnRenamed(
            "id", "upload_row_id"
        )
    )
    pending = durable(parts.pending_parts(plan, ledger))
    sent = durable(
        store.put_parts(pending.select(F.col("upload_row_id").alias("id"), "path", "part_number", "part_offset", "part_size", "upload_id"), lib.store_root)
    )
    outcome = pending.join(sent.withColumnRenamed("id", "upload_row_id"), ["upload_row_id", "part_number"])
    outcome = durable(
        outcome.select(
            "ledger_id",
            "upload_row_id",
            "part_number",
            F.when(F.col("error").isNull(), F.col("part_size")).alias("part_size"),
            F.col("etag").alias("part_etag"),
            F.when(F.col("error").isNull(), "UPLOADED").otherwise("ERROR").alias("upload_status"),
        )
    )
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    added = dense_order(
        outcome.where("ledger_id is null").drop("ledger_id"), "upload_row_id", "part_number", name="id", start=last + 1
    )
    reused = outcome.where("ledger_id is not null").withColumnRenamed("ledger_id", "id")
    ledger = durable(
        ledger.join(reused.select("id"), "id", "left_anti").unionByName(reused).unionByName(added)
    )
    ready = parts.manifests(plan, ledger).select("upload_row_id", "parts")
    complete = active.join(ready, F.col("id") == F.col("upload_row_id")).select(
        F.col("content_id").alias("id"), "path", "upload_id", F.col("parts").cast("int").alias("parts"), "sha256_hex",
        object_key("sha256_hex").alias("object_key"), "file_size", F.col("upload_row_id"),
    )
    complete = durable(complete)
    joined = durable(store.complete_objects(complete, lib.store_root))
    finished = joined.where("error is null").join(complete.select("id", "upload_row_id"), "id").select(
        F.col("upload_row_id").alias("_finished")
    )
    uploads = uploads.join(finished, F.col("id") == F.col("_finished"), "left").withColumn(
        "status", F.when(F.col("_finished").isNotNull(), "UPLOADED").otherwise(F.col("status"))
    )
    lib.catalog.commit(replace={"uploads": uploads.drop("_finished"), "upload_parts": ledger})
    done_before = decisions.where("decision = 'done'").select(F.col("content_id").alias("id"))
    stored = joined.where("error is null").select("id").unionByName(done_before).withColumn("_ok", F.lit(True))
    reasons = joined.where("error is not null").select("id", F.col("error").alias("_why"))
    return (
        large.select("id")
        .join(stored, "id", "left")
        .join(reasons, "id", "left")
        .select("id", F.when(F.col("_ok").isNull(), F.coalesce("_why", F.lit("parts missing"))).alias("error"))
    )


def _store(lib: Library, wanted: DataFrame) -> DataFrame:
    keyed = wanted.withColumn("object_key", object_key("sha256_hex"))
    is_large = F.col("file_size") > lib.single_put_limit
    done = store.put_objects(keyed.where(~is_large), lib.store_root).select("id", "error")
    large = durable(wanted.where(is_large))
    if not large.isEmpty():
        done = done.unionByName(_store_large(lib, large))
    return durable(done)


def _encode_files(rows: DataFrame, factory: Callable[[], Encoder]) -> DataFrame:
    """Vectors of the files at ``path`` for contents ``id``; read, encoded and dropped in the task."""

    def run(batches):
        encode = factory()
        for batch in batches:
            listed = batch.to_pylist()
            for start in range(0, len(listed), ENCODE_ROWS):
                group = listed[start : start + ENCODE_ROWS]
                payloads, errors = [], []
                for row in group:
                    try:
                        payloads.append(fact_source.read_file(row["path"]))
                        errors.append(None)
                    except Exception as problem:  # noqa: BLE001
                        payloads.append(None)
                        errors.append(f"{type(problem).__name__}: {problem}")
                vectors: list = [None] * len(group)
                there = [i for i, p in enumerate(payloads) if p is not None]
                got, failed = encode_each(encode, [payloads[i] for i in there])
                for i, vector, error in zip(there, got, failed):
                    vectors[i], errors[i] = vector, error
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["id"] for r in group], pa.int64()),
                        pa.array(
                            [None if v is None else np.asarray(v, dtype=np.float32).tolist() for v in vectors],
                            pa.list_(pa.float32()),
                        ),
                        pa.array(errors, pa.string()),
                    ],
                    names=["id", "embedding", "error"],
                )

    dealt = fact_source.by_bytes(rows).select("id", "path")
    return dealt.mapInArrow(run, "id long, embedding array<float>, error string")


@one_version
def embed_contents(lib: Library, sources: DataFrame, force: bool = False) -> DataFrame:
    """Embed contents that need it, from ``sources`` (``id``, ``path``, ``file_size``): one file
    or object each. Commits vectors and status together; returns ``id``, ``error`` of what was tried."""
    nothing = lib.spark.createDataFrame([], "id long, error string")
    if lib.encoder is None:
        return nothing
    content, vectors = lib.table("content"), lib.table("vectors")
    sources = durable(sources)
    has = narrowed(vectors.select("id"), sources, "id").withColumn("embedding", F.lit(True))
    state = narrowed(content.select("id", "status", "s3_path"), sources, "id").join(has, "id", "left")
    todo = durable(sources.join(state.where(filters.is_stored() | (F.col("status") == "ERROR"))
                                .where(filters.needs_embedding(force=force)), "id"))
    if todo.isEmpty():
        return nothing
    # The rows under work are on record first: a run that dies here leaves INDEXING behind.
    lib.catalog.commit(upsert={"content": _changed(content, todo.select("id", F.lit("INDEXING").alias("status")))})
    encoded = durable(_encode_files(todo.select("id", "path", "file_size"), lib.encoder))
    ok = F.col("embedding").isNotNull()
    status = lifecycle.after_embedding(F.lit("INDEXING"), F.lit(True), ok)
    changed = _changed(lib.table("content"), encoded.select("id", status.alias("status")))
    new = encoded.where(ok).join(todo.select("id", "s3_path"), "id").select("id", "s3_path", "embedding")
    if force:
        kept = narrowed(vectors, durable(new.select("id")), "id", outside=True)
        lib.catalog.commit(replace={"vectors": kept.unionByName(new)}, upsert={"content": changed})
    else:
        lib.catalog.commit(append={"vectors": new}, upsert={"content": changed})
    return encoded.select("id", "error")


def _near_stored(lib: Library, probes: DataFrame) -> DataFrame:
    """Ids of the contents near any of the hashes, by the stored index; a library without one is keyed whole first."""
    if not lib.catalog.folders("hashes"):
        every = lib.table("content").where(filters.is_stored() | F.col("uploaded_at").isNotNull())
        every = every.select("id", hex_to_bits("phash").alias("bits"))
        if every.isEmpty():
            return lib.table("hashes").select("id")
        lib.catalog.commit(append={"hashes": hash_index.index_rows(durable(every))})
    return durable(hash_index.near(lib.table("hashes"), probes, lib.threshold).select("id"))


def _index_changes(lib: Library, added: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """What a commit does to the hash index: a set more, or all sets as one."""
    if not lib.catalog.folders("hashes") or lib.catalog.folders("hashes") < INDEX_SETS:
        return {"append": {"hashes": hash_index.index_rows(added)}}
    every = durable(hash_index.all_hashes(lib.table("hashes")).unionByName(added))
    return {"replace": {"hashes": hash_index.index_rows(every)}}


@one_version
def ingest_facts(lib: Library, facts: DataFrame, parent_id: int | None = None, policy: str | None = None) -> DataFrame:
    """Bring files with known facts into the library. Returns ``path``, ``outcome``, ``error``."""
    policy = filters.check_policy(policy or lib.policy)
    catalog = lib.catalog
    facts = durable(facts)
    failed = facts.where("error is not null").select("path", "error")
    good = facts.where("error is null").drop("error")
    content, files = lib.table("content"), lib.table("files")
    decided = decide(good, content, policy, lib.threshold, near=lambda probes: _near_stored(lib, probes))
    batch, wanted = decided.files, durable(decided.to_store)

    # 1. New and resumed contents are on record as UPLOADING before their bytes move.
    location = F.concat(F.lit(f"{lib.bucket}/"), object_key("sha256_hex"))
    opened = wanted.where("is_new").select(
        "id", "sha256_hex", "phash", F.lit(0).cast("long").alias("uploaded_bytes"),
        F.lit(None).cast("timestamp").alias("uploaded_at"), F.col("mime").alias("content_mime_type"),
        location.alias("s3_path"), F.lit(None).cast("long").alias("dup_group"),
        F.lit(None).cast("int").alias("near_dup_distance"), F.lit("UPLOADING").alias("status"),
    )
    reopened = wanted.where("not is_new").select("id", F.lit("UPLOADING").alias("status"))
    counts = wanted.agg(F.count("*").alias("all"), F.count_if("is_new").alias("new")).first()
    if counts["all"]:
        catalog.commit(upsert={"content": _changed(content, durable(reopened)).unionByName(opened)})
        content = lib.table("content")
        stored = _store(lib, wanted)
    else:
        stored = lib.spark.createDataFrame([], "id long, error string")

    # 2. Stored contents, their groups and the file rows become visible together.
    good_ids = stored.where("error is null").select("id")
    uploaded = wanted.join(good_ids, "id", "left_semi").select(
        "id", F.col("file_size").alias("uploaded_bytes"), _now().alias("uploaded_at"), F.lit("UPLOADED").alias("status")
    )
    arrived = durable(wanted.join(good_ids, "id", "left_semi").select("id", "bits", "is_new"))
    fresh = arrived.where("is_new").select("id", "bits")
    touched = arrived.select("id")
    grouping = policy == "keep" and counts["new"]
    if grouping:
        # Only stored contents near a new one have a part in its group: those of the index, and what this batch resumed.
        touched = durable(_near_stored(lib, fresh.select("bits")).unionByName(touched).distinct())
    updated = durable(_update(narrowed(content, touched, "id"), uploaded))
    if grouping:
        held = updated.where(filters.is_stored()).join(fresh.select("id"), "id", "left_anti").select(
            "id", hex_to_bits("phash").alias("bits"), "dup_group"
        )
        labels = durable(near_dup.group_keep(held, fresh, lib.threshold))
        labelled = labels.join(updated.select("id", F.col("near_dup_distance").alias("_old")), "id").select(
            "id", "dup_group", F.coalesce("near_dup_distance", "_old").alias("near_dup_distance")
        )
        now = arrived.select("id").unionByName(labels.select("id")).distinct()
        updated = _update(updated, labelled).join(now, "id", "left_semi")
    bad_ids = stored.where("error is not null").select(F.col("id").alias("content_id"), F.col("error").alias("store_error"))
    judged = durable(batch.join(bad_ids, "content_id", "left"))
    recorded = judged.where("store_error is null").drop("store_error")
    by_path = durable(narrowed(files, recorded.select(F.col("path").alias("local_path")), "local_path"))
    by_content = narrowed(files, recorded, "content_id").join(by_path.select("id"), "id", "left_anti")
    typed = exact.classify(recorded, by_path.unionByName(by_content), F.col("is_first"), F.col("is_similar"))
    if parent_id is None:
        known = lib.table("synced_folders")
        with_orphan = durable(folders.with_orphan_folder(known, _now()))
        owned = folders.resolve_owner(typed, with_orphan)
    else:
        known = with_orphan = None
        owned = typed.withColumn("parent_folder_id", F.lit(parent_id).cast("long"))
    owned = durable(owned)
    last = files.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    added = owned.join(by_path.select(F.col("local_path").alias("path")), "path", "left_anti").select("ord")
    numbered = dense_order(added, "ord", name="id", start=last + 1)
    rows = owned.join(numbered, "ord", "left").withColumn("discovered_at", _now())
    replace, upsert = {}, {"content": updated, "files": exact.upsert_files(by_path, rows)}
    if with_orphan is not None:
        orphan = with_orphan.where(F.col("parent_folder_path") == settings.ORPHAN_PATH).select(
            F.col("id").alias("parent_folder_id")
        )
        if not owned.join(orphan, "parent_folder_id", "left_semi").isEmpty():
            replace["synced_folders"] = with_orphan
    # A content is a match from the moment it counts as stored: its hash enters the index in the same commit.
    index = {} if arrived.isEmpty() else _index_changes(lib, arrived.select("id", "bits"))
    catalog.commit(replace={**replace, **index.get("replace", {})}, append=index.get("append"), upsert=upsert)

    # 3. Vectors: from the content's own bytes, never from a merely similar picture.
    own = owned.where("not is_similar").groupBy(F.col("content_id").alias("id")).agg(
        F.min_by(F.struct("path", "file_size"), "ord").alias("_f")
    )
    tried = embed_contents(lib, own.select("id", "_f.path", "_f.file_size"))
    embed_errors = tried.where("error is not null").select(F.col("id").alias("content_id"), F.col("error").alias("embed_error"))
    done = owned.join(embed_errors, "content_id", "left").select("path", F.col("embed_error").alias("error"))
    not_stored = judged.where("store_error is not null").select("path", F.col("store_error").alias("error"))
    outcomes = done.unionByName(not_stored).unionByName(failed)
    return durable(
        outcomes.select("path", F.when(F.col("error").isNull(), "ingested").otherwise("error").alias("outcome"), "error")
    )


def ingest_paths(lib: Library, paths: DataFrame | list[str], parent_id: int | None = None, policy: str | None = None) -> DataFrame:
    """Ingest named files, whatever their extension. A path without a file is an error row."""
    policy = filters.check_policy(policy or lib.policy)
    if isinstance(paths, list):
        paths = lib.spark.createDataFrame([(plain(p),) for p in paths], "path string")
    listed = durable(scan.stat_paths(paths))
    gone = listed.where("file_size is null").select(
        "path", F.lit("error").alias("outcome"), F.lit("FileNotFoundError: not a file").alias("error")
    )
    there = listed.where("file_size is not null")
    facts = fact_source.gather(there.drop("found"), lib.decoder)
    return ingest_facts(lib, facts, parent_id, policy).unionByName(gone)


def ingest_file(lib: Library, path: str, parent_id: int | None = None, policy: str | None = None) -> int:
    """Ingest one file and return its content id; problems are raised."""
    result = ingest_paths(lib, [path], parent_id, policy).first()
    if result["outcome"] == "error":
        if result["error"].startswith("FileNotFoundError"):
            raise FileNotFoundError(f"no file to ingest at {path}")
        raise RuntimeError(f"{path} was not ingested: {result['error']}")
    return lib.table("files").where(F.col("local_path") == plain(path)).select("content_id").first()[0]


@one_version
def _mark_back(lib: Library, listed: DataFrame) -> None:
    files = lib.table("files")
    gone = files.where("not present_locally")
    back = durable(gone.join(listed.select(F.col("path").alias("local_path")), "local_path", "left_semi"))
    if not back.isEmpty():
        lib.catalog.commit(upsert={"files": back.withColumn("present_locally", F.lit(True))})


def sync_folder(lib: Library, root: str, title: str | None = None, policy: str | None = None) -> DataFrame:
    """Ingest every new or changed picture below ``root``: one row of ingested, skipped, errors.

    A folder that may not be listed counts as one error. Known files that are back are present again.
    """
    policy = filters.check_policy(policy or lib.policy)
    root = plain(root).rstrip("/") or "/"
    listed, unlisted = scan.list_tree(lib.spark, root)
    _mark_back(lib, listed)
    folder_id = ensure_folder(lib, root, title)
    changed = durable(exact.incremental(listed, lib.table("files")))
    total, new = listed.count(), changed.count()
    skipped = lib.spark.createDataFrame([(total - new, unlisted.count())], "skipped long, errors long")
    if new:
        outcomes = ingest_facts(lib, fact_source.gather(changed, lib.decoder, root), folder_id, policy)
        counted = lifecycle.sync_report(outcomes).drop("skipped")
    else:
        counted = lib.spark.createDataFrame([(0, 0)], "ingested long, errors long")
    return counted.unionByName(skipped, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ingested", "skipped", "errors")]
    )


def search_text(
    lib: Library,
    query: str,
    text_encoder: Callable[[], Encoder],
    k: int = settings.TOP_K,
    threshold: float | None = settings.SIMILARITY_FLOOR,
) -> DataFrame:
    """The k stored pictures nearest to a text, best first: ``score``, ``id``, ``s3_path``."""
    asked = lib.spark.createDataFrame([(query,)], "text string")
    vector = embed_queries(asked, text_encoder).first()["embedding"]
    return vector_search(lib.table("vectors"), vector, k, threshold)


def statistics(lib: Library) -> DataFrame:
    """One row of library statistics with the last upload and the size of the vector index."""
    content = lib.table("content")
    core = stats.library_stats(content, lib.table("files"))
    more = stats.index_stats(content, lib.table("vectors"))
    both = core.unionByName(more, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def recover(lib: Library) -> DataFrame:
    """Finish stored contents without a vector, from their stored objects.

    A file whose embedding failed is known by path and time, so a later sync skips it; this is
    what picks its content up again. Contents whose store was interrupted come back by sync.
    """
    waiting = filters.unfinished(lib.table("content")).where(
        filters.is_stored() | ((F.col("status") == "ERROR") & F.col("uploaded_at").isNotNull())
    )
    sources = waiting.select(
        "id",
        F.concat(F.lit(f"{lib.store_root}/"), object_key("sha256_hex")).alias("path"),
        F.col("uploaded_bytes").alias("file_size"),
    )
    return embed_contents(lib, sources)


@one_version
def mark_missing(lib: Library, root: str) -> int:
    """Set ``present_locally`` of the known files below ``root``, of any extension, by looking at each.

    Files that cannot be looked at keep their flag; objects stay stored.
    """
    files = lib.table("files")
    below = files.where(F.col("local_path").startswith(plain(root).rstrip("/") + "/"))
    seen = scan.stat_paths(below.select(F.col("local_path").alias("path"))).select(F.col("path").alias("local_path"), "found")
    marked = below.join(seen, "local_path").where(F.col("found") != F.col("present_locally"))
    return lib.catalog.commit(upsert={"files": marked.withColumn("present_locally", F.col("found")).select(*files.columns)})
