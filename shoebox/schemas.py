"""Table contracts of the catalogue."""

from pyspark.sql import types as T

CONTENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sha256_hex", T.StringType()),
    T.StructField("phash", T.StringType()),
    T.StructField("uploaded_bytes", T.LongType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("content_mime_type", T.StringType()),
    T.StructField("s3_path", T.StringType()),
    T.StructField("dup_group", T.LongType()),
    T.StructField("near_dup_distance", T.IntegerType()),
    T.StructField("status", T.StringType()),
])

# Vectors live beside the content rows: they are appended, never rewritten with a status change.
VECTORS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("s3_path", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

FILES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("local_path", T.StringType()),
    T.StructField("sha256_hex", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("discovered_at", T.TimestampType()),
    T.StructField("disk_mtime", T.TimestampType()),
    T.StructField("present_locally", T.BooleanType()),
    T.StructField("image_type", T.StringType()),
    T.StructField("content_id", T.LongType()),
    T.StructField("parent_folder_id", T.LongType()),
])

FOLDERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("parent_folder_path", T.StringType()),
    T.StructField("added_at", T.TimestampType()),
    T.StructField("title", T.StringType()),
])

UPLOADS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("content_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_size", T.LongType()),
    T.StructField("initiated_at", T.TimestampType()),
])

UPLOAD_PARTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("upload_row_id", T.LongType()),
    T.StructField("part_number", T.IntegerType()),
    T.StructField("part_size", T.LongType()),
    T.StructField("part_etag", T.StringType()),
    T.StructField("upload_status", T.StringType()),
])

FACTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("sha256_hex", T.StringType()),
    T.StructField("phash", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("disk_mtime", T.TimestampType()),
    T.StructField("mime", T.StringType()),
    T.StructField("error", T.StringType()),
])

CHANGES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("kind", T.StringType()),
])

HASHES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("bits", T.LongType()),
    T.StructField("of", T.IntegerType()),
    T.StructField("mask", T.IntegerType()),
    T.StructField("bucket", T.IntegerType()),
])

TABLES = {
    "content": CONTENT,
    "vectors": VECTORS,
    "files": FILES,
    "synced_folders": FOLDERS,
    "uploads": UPLOADS,
    "upload_parts": UPLOAD_PARTS,
    "hashes": HASHES,
}

# Tables kept in hash buckets of this column, their key: a commit writes the buckets it touches.
BUCKETED = {"content": "id", "files": "local_path"}

# Tables whose folders are cut further, by these columns.
PARTITIONED = {"hashes": ("of", "mask", "bucket")}
