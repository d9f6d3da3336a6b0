"""Facts of files: content hash, perceptual hash, size, time of change and MIME type.

Only paths travel between tasks. The task that reads a file hashes and decodes it on the spot and
hands on a short row; a file that cannot be read or decoded becomes a row with ``error``.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.paths import local_path, mime_type
from shoebox.functions.pixels import SIDE, hash_picture, hash_small, phash_of_image
from shoebox.session import durable
from shoebox.sources.storage import locate

Decoder = Callable[[bytes], np.ndarray]  # file bytes -> gray picture (height, width)
BLOCK = 8 * 1024 * 1024
BYTES_PER_TASK = 64 * 1024 * 1024
NAMED = 5_000  # about so many named files are looked up by one read of Spark's image source


def pillow_decoder() -> Decoder | None:
    """Gray decoder for every format the Pillow library knows, if it is installed."""
    try:
        from PIL import Image
    except ImportError:
        return None

    def decode(data: bytes) -> np.ndarray:
        small = Image.open(io.BytesIO(data)).convert("L").resize((SIDE, SIDE), Image.Resampling.LANCZOS)
        return np.asarray(small)

    return decode


def by_bytes(rows: DataFrame, size: str = "file_size", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Deal rows out so that a task reads about ``BYTES_PER_TASK``.

    The number is explicit: by the size of the path rows alone Spark would merge them all into
    one task.
    """
    total = rows.agg(F.sum(size).alias("b"), F.count("*").alias("n")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-(total["b"] or 0) // BYTES_PER_TASK))
    return rows.repartition(max(1, min(wanted, total["n"])), *keys)


def read_file(uri: str) -> bytes:
    system, path = locate(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def _fingerprint(decoder: Decoder | None):
    def one(path):
        data = read_file(path)
        sha = hashlib.sha256(data).hexdigest()
        if decoder is None:
            return sha, None, len(data), None
        gray = decoder(data)
        phash = hash_small(gray[None])[0] if gray.shape == (SIDE, SIDE) else hash_picture(gray)
        return sha, phash, len(data), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            rows = []
            for path in paths:
                try:
                    rows.append(one(path))
                except Exception as problem:  # noqa: BLE001 - one bad file must not stop the others
                    rows.append((None, None, None, f"{type(problem).__name__}: {problem}"))
            shas, hashes, sizes, errors = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(paths, pa.string()),
                    pa.array(shas, pa.string()),
                    pa.array(hashes, pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(errors, pa.string()),
                ],
                names=["path", "sha256_hex", "phash", "file_size", "error"],
            )

    return run


def image_source_hashes(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """``path`` and ``phash`` by Spark's image source, NULL hash where it cannot decode."""
    images = (
        spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(files)
    )
    return images.select(
        # Origins are percent-encoded; a plus sign in one stands for itself.
        local_path(F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))).alias("path"),
        phash_of_image(F.struct("image.height", "image.width", "image.nChannels", "image.data")).alias("phash"),
    )


def _hashes_of_named(listing: DataFrame) -> DataFrame:
    """Image-source hashes of the listed files only, block by block of the paths' hashes, however many there are."""
    spark, paths = listing.sparkSession, listing.select("path")
    blocks = max(1, -(-paths.count() // NAMED))
    found = spark.createDataFrame([], "path string, phash string")
    for block in range(blocks):
        names = [r[0] for r in paths.where(F.pmod(F.xxhash64("path"), F.lit(blocks)) == block).collect()]
        if names:
            found = found.unionByName(durable(image_source_hashes(spark, names)))
    return found


def gather(listing: DataFrame, decoder: Decoder | None = None, root: str | None = None) -> DataFrame:
    """Facts of listed files (``path``, ``file_size``, ``disk_mtime``), one row per path.

    Without a decoder Pillow is used; without Pillow the pictures below ``root``, or the listed files where no
    root is given, are decoded by Spark's image source in a second pass.
    """
    spark = listing.sparkSession
    decoder = decoder or pillow_decoder()
    read = by_bytes(listing).select("path").mapInArrow(
        _fingerprint(decoder), "path string, sha256_hex string, phash string, file_size long, error string"
    )
    if decoder is None:
        found = _hashes_of_named(listing) if root is None else image_source_hashes(spark, root)
        decoded = found.withColumnRenamed("phash", "_phash")
        read = (
            read.join(decoded, "path", "left")
            .withColumn("phash", F.col("_phash"))
            .withColumn("error", F.coalesce("error", F.when(F.col("_phash").isNull(), "cannot decode picture")))
            .drop("_phash")
        )
    return read.join(listing.select("path", "disk_mtime"), "path").select(
        "path", "sha256_hex", "phash", "file_size", "disk_mtime", mime_type("path").alias("mime"), "error"
    )


def facts_of_payload(rows: DataFrame, decoder: Decoder, payload: str = "content") -> DataFrame:
    """The same facts for bytes that are already a column, as the binaryFile source gives them."""

    @F.pandas_udf("string")
    def phash(data):
        def one(value):
            try:
                return hash_picture(decoder(bytes(value)))
            except Exception:  # noqa: BLE001
                return None

        return data.map(one).astype(object)

    hashed = rows.withColumn("phash", phash(payload))
    return hashed.select(
        local_path("path").alias("path"),
        F.sha2(payload, 256).alias("sha256_hex"),
        "phash",
        F.octet_length(payload).cast("long").alias("file_size"),
        F.col("modificationTime").alias("disk_mtime"),
        mime_type("path").alias("mime"),
        F.when(F.col("phash").isNull(), "cannot decode picture").alias("error"),
    )
