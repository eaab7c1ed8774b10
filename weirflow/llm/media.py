"""Media columns: WAV audio in a binary column, its spectrogram's peak pairs as time-coded arrays.

Audio is written and read by the wave module in the worker that holds the row; the rows never leave their
partition. Features come from the samples that were read back, never from what was to be written.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 8000
FRAME = 576
HOP = 288
BLOCK = 2048
#: Edges of the frequency bands, in bins of the transform; the strongest bin of each band can be a peak.
BANDS = (1, 9, 33, 97, 289)


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each band in each frame, and its power; frames in blocks, so memory is bounded."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, power = [], []
    for at in range(0, len(frames), BLOCK):
        s = np.fft.rfft(frames[at : at + BLOCK] * _WINDOW, axis=1)
        p = s.real**2 + s.imag**2
        best = [p[:, a:b].argmax(1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)]
        bins.append(np.stack(best, 1))
        power.append(np.stack([p[np.arange(len(p)), b] for b in best], 1))
    return np.concatenate(bins).astype(np.int32), np.concatenate(power)


def pair_fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and hashes: each frame's peaks paired with the strongest of this and the next two frames.

    A hash holds the first bin (9 bits), the second (9 bits) and the frames between them (2 bits).
    """
    bins, power = peaks(samples)
    top = bins[np.arange(len(bins)), power.argmax(1)]
    times, hashes = [], []
    for dt in (0, 1, 2):
        n = len(bins) - dt
        if n > 0:
            h = (bins[:n].astype(np.int64) << 11) | (top[dt:, None].astype(np.int64) << 2) | dt
            keep = np.ones(h.shape, bool) if dt else bins[:n] != top[:n, None]
            times.append(np.broadcast_to(np.arange(n)[:, None], h.shape)[keep])
            hashes.append(h[keep])
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def encode_wav(df: DataFrame, data_col: str, media_col: str = "media", rate: int = RATE) -> DataFrame:
    """``df`` with a binary column of WAV files whose 8-bit samples are the bytes of ``data_col`` (null: null, empty: no samples).

    An old column named ``media_col`` is replaced. Rows are taken one by one; an empty table stays empty.
    """

    @F.pandas_udf("binary")
    def encode(s):
        return s.map(lambda b: None if b is None else wav_bytes(bytes(b), rate))

    return df.withColumn(media_col, encode(F.col(f"`{data_col}`")))


def wav_fingerprints(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``fingerprints``, an array of (t, hash) in order of time, from a column of WAV files (null: null).

    An old column of that name is replaced. Equal files get equal arrays, files shorter than a frame are padded with
    silence; an empty table stays empty. What is no WAV file is an error.
    """
    pairs = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("hash", T.IntegerType())]))
    source = df.drop("fingerprints")
    schema = T.StructType([*source.schema.fields, T.StructField("fingerprints", pairs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [None if m is None else pair_fingerprints(wav_samples(m)) for m in b.column(media_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, time_coded(found)], [*b.schema.names, "fingerprints"])

    return source.mapInArrow(run, schema)


def time_coded(found: list) -> pa.Array:
    ends = np.cumsum([0] + [0 if f is None else len(f[0]) for f in found], dtype=np.int32)
    parts = [f for f in found if f is not None]
    t = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
    h = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
    values = pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(h, pa.int32())], ["t", "hash"])
    missing = pa.array([f is None for f in found]) if len(parts) < len(found) else None
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)


def framed(text: str | None, unit: int = FRAME) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and the bytes padded with 255 to a positive multiple of ``unit``."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % unit or unit * (not raw))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as audio and read back: digests of both, and the features of what was read.

    Null and empty texts become one frame of padding. Equal texts get equal values; a text of any length is one
    row's work, its transforms running in blocks of frames. Rows repeat as they come; an empty table stays empty.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, fingerprints array<struct<t:int,hash:int>>"
    )
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                cols: list[list] = [[] for _ in range(7)]
                found = []
                for text in b.column("text").to_pylist():
                    n, payload = framed(text)
                    media = wav_bytes(payload)
                    back = wav_samples(media)
                    found.append(pair_fingerprints(back))
                    values = (
                        n,
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-32:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"{len(found[-1][0])}:{hashlib.md5(found[-1][0].tobytes() + found[-1][1].tobytes()).hexdigest()}",
                    )
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays, time_coded(found)], names)

    return source.mapInArrow(run, schema)
