"""Media columns: texts stored as lossless WebP images, and images read back as pixel arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm import kernels, webp
from cliplane.llm.runtime import ship

ROW = 576
CHANNELS = 3
FILL = 255
BATCH_BYTES = 16 << 20
TEXT_BYTES, MEDIA_BYTES = 8 << 20, 8 << 20  # that are encoded or decoded together


def payload_of(text: bytes) -> np.ndarray:
    """The bytes, filled up with FILL to a positive multiple of ROW, as rows of pixels of red, green and blue."""
    rows = max(1, -(-len(text) // ROW))
    out = np.full(rows * ROW, FILL, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, ROW // CHANNELS, CHANNELS)


def _argb(samples: np.ndarray) -> np.ndarray:
    out = np.full((*samples.shape[:2], 4), 255, np.uint8)
    out[..., :3] = samples[..., None] if samples.ndim == 2 else samples[..., ::-1]
    return out.view("<u4")[..., 0]


def stored_all(every: list[np.ndarray]) -> list[bytes]:
    """Samples (h, w) of grey or (h, w, 3) of colour, each as one WebP file, or several one after another where the image would be too high."""
    parts = [(k, x[a : a + webp.MAX_SIDE]) for k, x in enumerate(map(_argb, every)) for a in range(0, len(x), webp.MAX_SIDE)]
    out = [b""] * len(every)
    for (k, _), data in zip(parts, webp.encode_all([x for _, x in parts]), strict=True):
        out[k] += data
    return out


def stored(samples: np.ndarray) -> bytes:
    return stored_all([samples])[0]


def pixels_all(every: list[bytes]) -> list[np.ndarray]:
    """All pixel rows (h, w) of each medium's files, as ARGB values."""
    files = [webp.files_in(m) for m in every]
    images = iter(webp.decode_all([s for f in files for s in f]))
    return [np.concatenate([next(images) for _ in f]) for f in files]


def pixels(media: bytes) -> np.ndarray:
    """All pixel rows (h, w) of the stored files, as ARGB values."""
    return np.concatenate([webp.decode_stream(s) for s in webp.files_in(media)])


def samples_of(argb: np.ndarray) -> np.ndarray:
    """(h, w, channels): red, green and blue, and alpha too unless all pixels are opaque."""
    c = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)
    return np.ascontiguousarray(c[..., 2::-1]) if (c[..., 3] == 255).all() else c[..., [2, 1, 0, 3]]


def feature_of(samples: np.ndarray) -> str:
    """Shape, mean, deviation, mean step to the right neighbour, and entropy in bits of the samples."""
    share = np.bincount(samples.reshape(-1), minlength=256) / samples.size
    values = np.arange(256)
    mean = float((share * values).sum())
    spread = float(np.sqrt(max(0.0, (share * values * values).sum() - mean * mean)))
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()) if samples.shape[1] > 1 else 0.0
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]};mean={mean:.4f};spread={spread:.4f};step={step:.4f};entropy={abs(entropy):.4f}"


def _parts(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``most`` bytes of their last column."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[-1])
        if size >= most:
            yield kept
            kept, size = [], 0
    if kept:
        yield kept


def _limited(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES of their last column."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), kinds, strict=True)], names)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), kinds, strict=True)], names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text as a lossless WebP file.

    Null and empty texts are one row of fill bytes. Texts over 9 MB take several
    files in one value. Null ids are kept, repeated rows stored each, other
    columns ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                texts = kernels.texts_of(batch.column(1))
                every = ((doc_id, texts.bytes_of(i)) for i, doc_id in enumerate(batch.column(0).to_pylist()))
                for some in _parts(every, TEXT_BYTES):
                    for (doc_id, text), data in zip(some, stored_all([payload_of(text) for _, text in some]), strict=True):
                        yield doc_id, len(text), data

        yield from _limited(rows(), [id_col, "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Each row of ``store``, decoded: its columns but media, and width, height, channels, samples, media_bytes, media_sha256, feature.

    ``samples`` holds the pixel array row by row: red, green and blue of each pixel, and
    alpha where a pixel is not opaque. Rows with a null medium are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                every = ((doc_id, n, data.as_py()) for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
                for some in _parts(every, MEDIA_BYTES):
                    for (doc_id, n, data), argb in zip(some, pixels_all([data for *_, data in some]), strict=True):
                        x = samples_of(argb)
                        yield doc_id, n, x.shape[1], x.shape[0], x.shape[2], len(data), hashlib.sha256(data).hexdigest(), feature_of(x), x.tobytes()

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        yield from _limited(rows(), [id_col, "n_bytes", "width", "height", "channels", "media_bytes", "media_sha256", "feature", "samples"], kinds)

    id_col = media.columns[0]
    return media.filter(F.col("media").isNotNull()).mapInArrow(run, f"`{id_col}` long, n_bytes long, width int, height int, channels int, media_bytes long, media_sha256 string, feature string, samples binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The decoded rows with checksums of their samples in place of them."""
    id_col = decoded.columns[0]
    return decoded.select(
        id_col,
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
