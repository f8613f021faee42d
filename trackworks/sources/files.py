"""File sources and sinks: inventories, PCM WAV blocks, metadata tables, versioned manifests."""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackworks.operators.columns import nfc

#: Samples of each channel in a block.
BLOCK_FRAMES = 32_768
#: Bytes of samples that a task reads from a file at a time.
RANGE_BYTES = 32 << 20
#: Samples and rows that decoded blocks leave a task by at a time; a block with more samples is a batch of its own.
BATCH_SAMPLES, BATCH_ROWS = 1 << 20, 1 << 14


def read_metadata(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A CSV table with a header and a fixed schema; the key is in Unicode NFC."""
    return spark.read.csv(path, header=True, schema=schema).withColumn(key, nfc(F.col(key)))


def read_label_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record from each JSON file, with the file's name without extension as `id`; a broken file gives nulls."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumn("id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def inventory(spark: SparkSession, path: str, pattern: str = "*.wav", dataset: str = "", name: str = r"([^/]*)\.[^./]*$") -> DataFrame:
    """Paths, sizes and roles of files; contents aren't read. name: the part of a path that says the role, as a pattern's first group."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    stem = F.regexp_extract("path", name, 1)
    return f.withColumns({"dataset": F.lit(dataset), "role": F.when(stem.endswith("_master"), "master").otherwise("stem")})


_BLOCKS = "path string, block_idx int, sr int, n_frames int, samples array<array<float>>, error string"


def _scaled(raw: bytes, width: int, channels: int) -> np.ndarray:
    """float32 samples [frames, channels] of little-endian PCM bytes."""
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}")
    else:
        raise ValueError(f"{8 * width}-bit samples")
    return (x / float(1 << (8 * width - 1))).astype(np.float32).reshape(-1, channels)


def decode_pcm(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and float32 samples [frames, channels] of a 16, 24 or 32-bit PCM WAV."""
    with wave.open(io.BytesIO(data)) as w:
        return w.getframerate(), _scaled(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())


def wav_header(read: Callable[[int, int], bytes], size: int) -> dict[str, int]:
    """Where a PCM WAV's samples are and what they are, from its chunk headers alone: sr, channels, width, at, frames.

    read(offset, n) gives bytes of the file. A data chunk that says more than the file holds ends with the file.
    """
    if (head := read(0, 12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", read(at + 8, 16))
        elif name == b"data":
            if form is None or form[0] not in (1, 0xFFFE):  # fixed values: PCM, and the extensible form of it
                raise ValueError("not PCM" if form else "samples before their format")
            _, channels, sr, _, frame, bits = form
            if bits not in (16, 24, 32) or frame != channels * bits // 8:
                raise ValueError(f"{bits}-bit samples in frames of {frame} bytes")
            return {"sr": sr, "channels": channels, "width": bits // 8, "at": at + 8, "frames": min(n, size - at - 8) // frame}
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _opened(path: str):
    """A file of any store that Arrow's file systems reach, by the path that Spark gives."""
    from pyarrow import fs

    if re.match("file:|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))  # Spark's paths aren't escaped
    return system.open_input_file(at)


def wav_ranges(spark: SparkSession, path: str, block_frames: int = BLOCK_FRAMES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of a folder's WAV files: path, sr, channels, width, at (its first byte), frames, first_block, error.

    A range is whole blocks, about range_bytes of samples; only headers are read, each once. A bad file is one row with its
    error and no range.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def heads(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, size in zip(f["path"], f["length"], strict=True):
                row = {"path": p, "sr": None, "channels": None, "width": None, "at": None, "frames": None, "error": None}
                try:
                    with _opened(p) as file:
                        row |= wav_header(lambda at, n, file=file: file.read_at(n, at), int(size))
                except Exception as e:  # noqa: BLE001  a bad file must not end the scan
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows).astype({"sr": "Int32", "channels": "Int32", "width": "Int32", "at": "Int64", "frames": "Int64"})

    h = found.mapInPandas(heads, "path string, sr int, channels int, width int, at long, frames long, error string")
    frame = F.col("channels") * F.col("width")
    step = F.greatest(F.lit(1), F.floor(range_bytes / (frame * block_frames)))  # blocks
    starts = F.when(F.col("frames") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("frames") - 1) / block_frames), step)).otherwise(F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("long"))))
    x = h.withColumn("step", step).withColumn("first_block", F.explode(starts))
    first = F.col("first_block") * block_frames
    return x.select("path", "sr", "channels", "width", (F.col("at") + first * frame).alias("at"), F.least(F.col("frames") - first, F.col("step") * block_frames).alias("frames"), "first_block", "error")


def encode_pcm(x: np.ndarray, sr: int) -> bytes:
    """A 16-bit PCM WAV of samples [frames, channels]; halves round to even, and what is beyond full scale is clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(2), w.setframerate(sr)
        w.writeframes(np.clip(np.round(x * 32768.0), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_files(df: DataFrame, path: str, channels: str, sr: int) -> DataFrame:
    """(path, content): a WAV file of each row's channels (an array of sample arrays), as bytes in a table.

    A folder of many small files is better kept so; wav_blocks reads such a table as it reads a folder.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [encode_pcm(np.stack([np.asarray(c, float) for c in x], 1), sr) for x in f["channels"]]})

    return df.select(F.col(path).cast("string").alias("path"), F.col(channels).alias("channels")).mapInPandas(run, "path string, content binary")


def read_wav_blocks(spark: SparkSession, path: str, block_frames: int = BLOCK_FRAMES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The WAV files of a folder as wav_blocks gives them, read by ranges: a long file is many tasks, and none reads it whole."""
    ranges = wav_ranges(spark, path, block_frames, range_bytes)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is not None:
                    yield r["path"], None, None, None, r["error"]
                    continue
                size = r["channels"] * r["width"]
                with _opened(r["path"]) as file:
                    for k in range(-(-r["frames"] // block_frames)):
                        n = min(block_frames, r["frames"] - k * block_frames)
                        part = _scaled(file.read_at(n * size, r["at"] + k * block_frames * size), r["width"], r["channels"])
                        yield r["path"], r["first_block"] + k, r["sr"], part, None

    return ranges.repartition("path", "first_block").mapInArrow(lambda batches: _batches(rows(batches)), _BLOCKS)


#: path, block_idx, sr, float32 samples [frames, channels], error
Block = tuple[str, int | None, int | None, np.ndarray | None, str | None]


def _batches(blocks: Iterable[Block]) -> Iterator[pa.RecordBatch]:
    """Blocks as Arrow batches of _BLOCKS: many short ones make a batch, so that what a batch costs isn't paid by each."""

    def batch(own: list[Block]) -> pa.RecordBatch:
        paths, idx, sr, parts, errors = zip(*own, strict=True)
        n = [None if x is None else len(x) for x in parts]
        channels = [0 if x is None else x.shape[1] for x in parts]
        lengths = np.repeat([k or 0 for k in n], channels)
        flat = np.concatenate([np.empty(0, np.float32), *(x.T.ravel() for x in parts if x is not None)])
        each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat, pa.float32()))
        samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *channels]), pa.int32()), each, mask=pa.array([x is None for x in parts]))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(idx, pa.int32()), pa.array(sr, pa.int32()), pa.array(n, pa.int32()), samples, pa.array(errors, pa.string())], names=["path", "block_idx", "sr", "n_frames", "samples", "error"])

    own, size = [], 0
    for b in blocks:
        more = 0 if b[3] is None else b[3].size
        if own and (size + more > BATCH_SAMPLES or len(own) >= BATCH_ROWS):
            yield batch(own)
            own, size = [], 0
        own.append(b)
        size += more
    if own:
        yield batch(own)


def wav_blocks(files: DataFrame, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """A table of small PCM WAV files (path, content) as blocks of block_frames (the last one shorter), channel by channel; a bad file is one row with its error."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    sr, x = decode_pcm(content)
                except Exception as e:  # noqa: BLE001  a bad file must not end the scan
                    yield p, None, None, None, f"{type(e).__name__}: {e}"
                    continue
                for k, at in enumerate(range(0, len(x), block_frames)):
                    yield p, k, sr, x[at : at + block_frames], None

    return files.select("path", "content").mapInArrow(lambda batches: _batches(rows(batches)), _BLOCKS)


def write_manifest(df: DataFrame, path: str, columns: list[str], order: list[str], csv_twin: bool = True) -> None:
    """A manifest under a new name: fixed columns in a fixed order (absent ones null), sorted, as parquet and CSV.

    An existing output is never replaced: the write raises.
    """
    have = set(df.columns)
    fixed = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).sort(*order)
    fixed.write.mode("errorifexists").parquet(f"{path}/parquet")
    if csv_twin:
        fixed.write.mode("errorifexists").csv(f"{path}/csv", header=True)
