"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.encoding import encoder
from cadenza.llm.text import slices
from cadenza.session import materialize

NO_ID = np.iinfo(np.int64).min


def _open(uri: str, mode: str):
    """A stream at a URI of any file system; folders are made on writing."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


def _mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    """The file's numbers: memory-mapped where it is a local or mounted path, else read."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path) if parts.scheme else uri
        try:
            return np.memmap(path, dtype=dtype, mode="r")
        except ValueError:  # an empty file can't be mapped
            return np.empty(0, dtype)
    with _open(uri, "r") as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 keep: int = 500_000) -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the manifest.

    Rows are dealt out by ranges of the id, sorted, and each partition writes
    `<name>.bin` (ids in 2 or 4 unsigned bytes, little-endian), `<name>.idx`
    (64-bit offsets, one more than documents) and `<name>.ids`. A repeated
    attempt writes under a new name; only files in the manifest count, so a
    lost executor leaves no half shard behind. Manifest: shard, path, width,
    n_docs, n_tokens and base, the tokens of all shards before it (a prefix
    sum over one row per shard).

    Null text is the empty text (its end id only). Null ids come first and
    are read back as null. Rows with equal ids follow each other by text.
    Other columns are not read. An empty table gives an empty manifest. `keep`
    bounds the chunks a worker remembers: memory against time, never the ids.
    """

    def write(batches):
        enc = encoder(tokenizer, keep)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        name, bin_file, lengths, ids = None, None, [], []
        for batch, _, _ in slices(batches, "_text"):
            if bin_file is None:
                name = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                bin_file = _open(f"{name}.bin", "w")
            got = enc.encode(batch.column("_text"))
            bin_file.write(end.join(got) + end)
            lengths.append(np.array([len(g) // enc.dtype.itemsize + 1 for g in got], np.int64))
            ids.append(batch.column("_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if bin_file is not None:
            bin_file.close()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
            for kind, data in (("idx", offsets), ("ids", np.concatenate(ids).astype("<i8"))):
                with _open(f"{name}.{kind}", "w") as f:
                    f.write(data.tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [name], "width": pa.array([enc.dtype.itemsize], pa.int32()),
                                              "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ranged = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    manifest = materialize(ranged.mapInArrow(write, "shard long, path string, width int, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files.

    The checksum is over the ids as little-endian unsigned 32-bit numbers,
    whatever the width in the file.
    """

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                ids = _mapped(shard["path"] + ".bin", np.dtype(f"<u{shard['width']}"))
                offsets = _mapped(shard["path"] + ".idx", np.dtype("<i8"))
                names = _mapped(shard["path"] + ".ids", np.dtype("<i8"))
                for lo in range(0, len(names), 10_000):
                    hi = min(len(names), lo + 10_000)
                    parts = [ids[offsets[i]:offsets[i + 1]].astype("<u4") for i in range(lo, hi)]
                    out = {
                        "doc_id": pa.array(np.asarray(names[lo:hi]), mask=np.asarray(names[lo:hi]) == NO_ID),
                        "start": pa.array(shard["base"] + offsets[lo:hi]),
                        "n_tokens": pa.array(np.diff(offsets[lo:hi + 1])),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInArrow(read, schema)
