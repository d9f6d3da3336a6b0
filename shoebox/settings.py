"""Default parameters of the media library.

The values below are fixed: results only agree with existing libraries when they are equal.
"""

# Fixed values.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tiff", ".tif", ".ico")
POLICIES = ("keep", "discard")
DEFAULT_POLICY = "keep"
NEAR_THRESHOLD = 5
SIMILARITY_FLOOR = 0.22
TOP_K = 20
SINGLE_PUT_LIMIT = 8 * 1024 * 1024
PART_SIZE = 8 * 1024 * 1024
RESUME_DAYS = 7
ORPHAN_PATH = "/"
ORPHAN_TITLE = "Orphan Files"
KEY_PREFIX = "photos/"
UNKNOWN_MIME = "application/octet-stream"
CONTENT_STATUSES = ("PENDING", "UPLOADING", "UPLOADED", "INDEXING", "INDEXED", "ERROR")
STORED_STATUSES = ("UPLOADED", "INDEXED", "INDEXING")
UPLOAD_STATUSES = ("PENDING", "UPLOADING", "UPLOADED", "ERROR")
FILE_TYPES = ("ORIGINAL", "DUPLICATE", "SIMILAR")

# MIME type by lower-case extension.
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".ico": "image/vnd.microsoft.icon",
}

# Physical knobs: they change speed, never results.
HOT_ROWS = 20_000  # rows one join key may hold before it is split further
ROWS_PER_CHUNK = 250_000  # longest stretch of one key a running window sees at once
BROADCAST_BYTES = 64 * 1024 * 1024  # largest side this library ships to every executor
