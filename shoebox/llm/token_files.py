"""Binary token output: documents in ascending id order, Simple-8b files, and their reader.

``write`` range-partitions the documents by id and sorts inside each partition; the task of a partition encodes
its texts as they come and writes one file ``part-NNNNN.s8b`` below a shared folder, under another name until it is whole.
A task that runs again replaces its file by the same bytes. ``read`` opens the files by task, decodes runs of blocks,
and returns one row per document. Only the manifest (one row per file) passes through the driver.

File: a magic word, runs of blocks (words, then escapes), then a tail of arrays in fixed order, then its place.
Little-endian. A null text is empty; equal ids keep all their rows; rows with a null id come first;
no documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import simple8b, text, tokens
from shoebox.llm.spark import fresh_folder, open_folder

MAGIC = b"TOKS8B01"
KNOWN_PIECES = 1_500_000  # a task of its own: no other operator's memory beside it
RUN = 256 * simple8b.BLOCK  # ids coded and decoded at a time
TAIL = (
    ("n_ids", "<u4"), ("n_words", "<u4"), ("n_escapes", "<u4"), ("cap", "<u1"), ("place", "<u8"),
    ("doc_id", "<i8"), ("has_id", "<u1"), ("n_tokens", "<u8"),
)
WRITTEN = "part int, file string, n_tokens long, n_docs long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


class Files(NamedTuple):
    folder: str
    parts: list  # (part, file, n_tokens, start), one entry per file


class _Writer:
    def __init__(self, stream):
        self.stream, self.at, self.waiting, self.held = stream, len(MAGIC), [], 0
        self.tail = {name: [] for name, _ in TAIL}
        stream.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= RUN:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // RUN * RUN
            for k in range(0, whole, RUN):
                self._run(ids[k : k + RUN])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _run(self, ids: np.ndarray) -> None:
        blocks = simple8b.encode(ids)
        sizes = blocks.n_words * 8 + blocks.n_escapes * 4
        word_at, escape_at = np.cumsum(blocks.n_words), np.cumsum(blocks.n_escapes)
        for k in range(len(sizes)):
            w, e = int(blocks.n_words[k]), int(blocks.n_escapes[k])
            self.stream.write(blocks.words[word_at[k] - w : word_at[k]].astype("<u8").tobytes())
            self.stream.write(blocks.escapes[escape_at[k] - e : escape_at[k]].astype("<u4").tobytes())
        self.tail["place"].append(self.at + np.cumsum(sizes) - sizes)
        self.at += int(sizes.sum())
        for name in ("n_ids", "n_words", "n_escapes", "cap"):
            self.tail[name].append(getattr(blocks, name))

    def close(self) -> None:
        if self.held:
            self._run(np.concatenate(self.waiting))
        parts = []
        for name, kind in TAIL:
            flat = np.concatenate(self.tail[name]) if self.tail[name] else np.zeros(0)
            parts += [np.array([len(flat)], "<u8").tobytes(), flat.astype(kind).tobytes()]
        self.stream.write(b"".join(parts) + np.array([self.at], "<u8").tobytes() + MAGIC)
        self.stream.close()


def write(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None) -> Files:
    """Encode and write every document; ``parts`` files, by default one per shuffle partition."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "tokens")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, total, count = None, 0, 0
        here = TaskContext.get()
        fs, base = open_folder(folder)
        name = f"part-{here.partitionId():05d}.s8b"
        draft = f"{base}/_{name}-{here.taskAttemptId()}"
        for batch in batches:
            doc_id = batch.column("doc_id")
            known = ~np.asarray(doc_id.is_null())
            plain = np.asarray(doc_id.fill_null(0))
            for part in text.slices(batch):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = _Writer(fs.open_output_stream(draft))
                ids, bounds = tokens.with_end(*tokens.encode(part.raw, part.bounds, tokenizer, KNOWN_PIECES), end_id)
                writer.add(ids)
                writer.tail["doc_id"].append(plain[part.first : part.last])
                writer.tail["has_id"].append(known[part.first : part.last])
                writer.tail["n_tokens"].append(np.diff(bounds))
                total, count = total + len(ids), count + part.last - part.first
        if writer:
            writer.close()
            fs.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist(
                [{"part": here.partitionId(), "file": f"{folder}/{name}", "n_tokens": total, "n_docs": count}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]),
            )

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id")
    rows = sorted(dealt.sortWithinPartitions("doc_id").mapInArrow(task, WRITTEN).collect())
    start, listed = 0, []
    for part, file, n_tokens, _ in rows:
        listed.append((part, file, n_tokens, start))
        start += n_tokens
    return Files(folder, listed)


def documents_of(file: str, with_ids: bool = True) -> Iterator[tuple]:
    """(doc_id or None, ids) of each document of one file, in file order, holding one run of blocks and one document."""
    fs, path = open_folder(file)
    with fs.open_input_file(path) as stream:
        size = stream.size()
        stream.seek(size - 16)
        tail_at = int(np.frombuffer(stream.read(8), "<u8")[0])
        if stream.read(8) != MAGIC:
            raise ValueError(f"not a whole token file: {file}")
        stream.seek(tail_at)
        tail = {}
        for name, kind in TAIL:
            n = int(np.frombuffer(stream.read(8), "<u8")[0])
            tail[name] = np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        ends = np.append(tail["place"], tail_at).astype(np.int64)

        def runs():
            step = RUN // simple8b.BLOCK
            for k in range(0, len(tail["n_ids"]), step):
                here = slice(k, k + step)
                stream.seek(int(ends[k]))
                raw = np.frombuffer(stream.read(int(ends[min(k + step, len(ends) - 1)] - ends[k])), np.uint8)
                n_words, n_escapes = tail["n_words"][here].astype(np.int64), tail["n_escapes"][here].astype(np.int64)
                sizes = np.stack([n_words * 8, n_escapes * 4], 1).ravel()
                is_word = np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)
                yield simple8b.decode(
                    simple8b.Blocks(
                        np.frombuffer(raw[is_word].tobytes(), "<u8"), np.frombuffer(raw[~is_word].tobytes(), "<u4"),
                        tail["n_ids"][here].astype(np.int64), n_words, n_escapes, tail["cap"][here],
                    )
                )

        source, held = runs(), np.zeros(0, np.uint32)
        for doc_id, has_id, n in zip(tail["doc_id"].tolist(), tail["has_id"].tolist(), tail["n_tokens"].tolist(), strict=True):
            if len(held) < n:
                pieces = [held]
                have = len(held)
                while have < n:
                    pieces.append(next(source))
                    have += len(pieces[-1])
                held = np.concatenate(pieces)
            yield (doc_id if has_id else None), held[:n]
            held = held[n:]


def read(spark: SparkSession, files: Files, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    schema = READ if with_ids else READ.rsplit(",", 1)[0]
    if not files.parts:
        return spark.createDataFrame([], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out, held = row["start"], [], 0

                def packed(out):
                    columns = {
                        "doc_id": pa.array([o[0] for o in out], pa.int64()),
                        "start": pa.array([o[1] for o in out], pa.int64()),
                        "n_tokens": pa.array([o[2] for o in out], pa.int64()),
                        "ids_crc32": pa.array([o[3] for o in out], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([o[4].astype(np.int32) for o in out], pa.list_(pa.int32()))
                    return pa.RecordBatch.from_pydict(columns)

                for doc_id, ids in documents_of(row["file"]):
                    out.append((doc_id, start, len(ids), tokens.crc32(ids), ids.copy() if with_ids else None))
                    start += len(ids)
                    held += len(ids)
                    if held >= 4 * RUN or len(out) >= 10_000:
                        yield packed(out)
                        out, held = [], 0
                if out:
                    yield packed(out)

    listed = spark.createDataFrame(files.parts, "part int, file string, n_tokens long, start long")
    return listed.repartition(len(files.parts)).mapInArrow(task, schema)
