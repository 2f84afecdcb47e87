"""Media columns: audio in a binary column, fingerprinted by chroma and aligned by offset histograms.

A recording is a RIFF/WAVE file with 16-bit or 8-bit PCM samples.  Overlapping
frames are transformed and their energy is summed into twelve pitch classes,
which are scaled to a unit vector.  Sixteen filters compare rectangles of the
(frame, pitch class) picture, each sum taken from an integral image in constant
time; each comparison gives two bits, so a frame position gives a packed 32-bit
integer.

Recordings with equal fingerprints form one class first, so copies never meet in
pairs.  Classes are dealt to blocks and each two blocks meet in one task, which
tries every offset of every shared integer of all pairs of classes, in numpy; no
integer, however common, makes rows or skew.  For each pair with few enough
differing bits at some such offset the histogram of offsets, over all
occurrences of all shared integers, picks the alignment, and the share of
differing bits over the overlap, at least ``least`` positions long, decides.
Linked classes are joined into components.  A task gives the number of links of
each class and a tree over linked classes, not the links.

Pairs without any equal integer have no offset and are not alike.  The work
grows with the square of the number of classes.

Defined results: a null, unreadable, silent or too short recording has an empty
fingerprint and is in a class of its own; repeated rows are copies of each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialised, table
from .components import connected_components
from .simhash import merge_labels

FRAME, HOP, BANDS = 1024, 256, 12
#: Blocks at least, and classes and bytes of fingerprints in a block at most, about.
BLOCKS, BLOCK, BLOCK_BYTES = 16, 4096, 16 << 20
#: (kind, first band, bands, frames): 0 whole, 1 upper/lower halves, 2 left/right halves, 3 quarters crosswise.
FILTERS = (
    (0, 4, 3, 15), (3, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (3, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (1, 10, 2, 10), (1, 6, 4, 14), (2, 5, 6, 4), (2, 1, 9, 12), (1, 9, 3, 16), (2, 0, 12, 8),
)
WIDEST = max(f[3] for f in FILTERS)
#: A comparison's log ratio falls below the first, above the last, or between.
LEVELS = (-0.25, 0.0, 0.25)


def samples_of(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the sample rate; none if the bytes are not such a file."""
    none = np.zeros(0, np.float32), 8000
    if not data or len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        if name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            if kind != 1 or bits not in (8, 16) or not channels or not rate:
                return none
            width = channels * bits // 8
            raw = np.frombuffer(body[: len(body) // width * width], "<i2" if bits == 16 else "u1").astype(np.float32)
            return (raw / 32768 if bits == 16 else raw / 128 - 1).reshape(-1, channels).mean(1), rate
        at += 8 + size + size % 2
    return none


def wave(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit RIFF/WAVE file."""
    body = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


_classes: dict[int, np.ndarray] = {}


def pitch_classes(rate: int) -> np.ndarray:
    """Sums transform bins from 60 to 3500 Hz into pitch classes, A first."""
    if rate not in _classes:
        hz = np.arange(FRAME // 2 + 1) * rate / FRAME
        picked = np.zeros((len(hz), BANDS), np.float32)
        for i in np.flatnonzero((hz >= 60) & (hz <= min(3500, rate / 2))):
            picked[i, round(BANDS * np.log2(hz[i] / 440)) % BANDS] = 1
        _classes[rate] = picked
    return _classes[rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Unit pitch-class vectors of overlapping frames; zero where silent."""
    if len(samples) < FRAME:
        return np.zeros((0, BANDS), np.float32)
    out, window = [], np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(frames), 256):
        power = np.abs(np.fft.rfft(frames[at : at + 256] * window, axis=1)) ** 2
        out.append(power.astype(np.float32) @ pitch_classes(rate))
    found = np.concatenate(out)
    size = np.sqrt((found * found).sum(1, keepdims=True))
    return np.where(size > 0.01, found / np.maximum(size, 1e-9), 0)


def fingerprint(picture: np.ndarray) -> np.ndarray:
    """Packed integers for each position of a chroma picture."""
    n = len(picture) - WIDEST + 1
    if n <= 0 or not picture.any():
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(picture) + 1, BANDS + 1))
    integral[1:, 1:] = picture.cumsum(0, dtype=float).cumsum(1)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        rows = lambda x, y: integral[x : x + n, y]
        return rows(x1, y1) - rows(x0, y1) - rows(x1, y0) + rows(x0, y0)

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole, mx, my = area(0, w, y, y + h), w // 2, y + h // 2
        if kind == 0:
            one, other = whole, area(0, w, 0, BANDS) - whole
        elif kind == 1:
            one = area(0, w, my, y + h)
            other = whole - one
        elif kind == 2:
            one = area(mx, w, y, y + h)
            other = whole - one
        else:
            one = area(0, mx, y, my) + area(mx, w, my, y + h)
            other = whole - one
        ratio = np.log((1 + np.maximum(one, 0)) / (1 + np.maximum(other, 0)))
        level = np.digitize(ratio, LEVELS)
        packed = packed << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)  # neighbours differ in one bit
    return packed


def aligned(a: np.ndarray, b: np.ndarray, least: int = 8) -> tuple[int, int, float]:
    """Offset of b in a, positions of overlap, and the share of differing bits there; (0, 0, 1) if they share nothing."""
    order = np.argsort(a, kind="stable")
    first, past = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = past - first
    if not n.sum():
        return 0, 0, 1.0
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    ends = n.cumsum()
    start = 0
    while start < len(b):  # some millions of occurrences at once
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + 4_000_000, "right")))
        some = n[start:stop]
        at_a = order[np.repeat(first[start:stop] - np.cumsum(some) + some, some) + np.arange(some.sum())]
        votes += np.bincount(at_a - np.repeat(np.arange(start, min(stop, len(b))), some) + len(b) - 1, minlength=len(votes))
        start = stop
    offsets = np.flatnonzero(votes)
    votes = votes[offsets]
    offsets -= len(b) - 1
    picked = np.lexsort((np.abs(offsets), -votes))
    picked = picked[votes[picked] >= votes[picked][:3][-1]]  # the three best and those equal to the third
    best = 0, 0, 1.0
    for offset in offsets[picked].tolist():
        x, y = a[max(0, offset) :], b[max(0, -offset) :]
        size = min(len(x), len(y))
        if size >= min(least, len(a), len(b)):
            error = float(np.bitwise_count(x[:size] ^ y[:size]).sum()) / (32 * size)
            if error < best[2]:
                best = offset, size, error
    return best


def keys(print_: np.ndarray) -> np.ndarray:
    """The distinct pairs of integers two positions from each other; a shorter fingerprint's first and last."""
    apart = min(2, len(print_) - 1)
    wide = print_.astype(np.uint64)
    return np.unique(wide[: len(wide) - apart] << np.uint64(32) | wide[apart:])


class Prints:
    """Fingerprints end to end, and their integers in order."""

    def __init__(self, prints: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, prints), np.int64, len(prints))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, np.uint32), *prints])
        order = np.argsort(self.flat, kind="stable")
        self.sorted = self.flat[order]
        self.row = np.repeat(np.arange(len(prints)), self.sizes)[order]
        self.at = order - self.first[self.row]


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans with these starts and sizes, end to end."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def parts(sizes: np.ndarray, most: int = 4_000_000) -> list[np.ndarray]:
    """Numbers of neighbours whose sizes add up to about ``most`` at once."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes.cumsum() // most)) + 1) if len(sizes) else []


def near(a: Prints, b: Prints, least: int, error: float, same: bool = False) -> np.ndarray:
    """Pairs of places in a and b that share an integer at an offset at which few enough bits differ.

    Every offset of every shared integer is tried, so no pair is lost that ``is_match`` could accept.
    With ``same`` a and b are one list, and only pairs in order count.
    """
    first, past = np.searchsorted(b.sorted, a.sorted, "left"), np.searchsorted(b.sorted, a.sorted, "right")
    some = np.flatnonzero(past > first)
    n, found = (past - first)[some], []
    for chunk in parts(n):
        x, y = np.repeat(some[chunk], n[chunk]), spans(first[some[chunk]], n[chunk])
        i, j, offset = a.row[x], b.row[y], a.at[x] - b.at[y]
        if same:
            ordered = i < j
            i, j, offset = i[ordered], j[ordered], offset[ordered]
        if not len(i):
            continue
        lowest, wide = offset.min(), int(np.ptp(offset)) + 1
        tried = np.unique((i * len(b.sizes) + j) * wide + offset - lowest)
        pair, offset = tried // wide, tried % wide + lowest
        i, j = pair // len(b.sizes), pair % len(b.sizes)
        at_a, at_b = np.maximum(offset, 0), np.maximum(-offset, 0)
        size = np.minimum(a.sizes[i] - at_a, b.sizes[j] - at_b)
        long = size >= np.minimum(least, np.minimum(a.sizes[i], b.sizes[j]))
        i, j, at_a, at_b, size = i[long], j[long], at_a[long], at_b[long], size[long]
        for own in parts(size):
            bits = np.bitwise_count(a.flat[spans(a.first[i[own]] + at_a[own], size[own])] ^ b.flat[spans(b.first[j[own]] + at_b[own], size[own])])
            wrong = np.add.reduceat(bits, size[own].cumsum() - size[own], dtype=np.int64)
            close = own[wrong <= error * 32 * size[own] + 1e-6]
            found.append(np.column_stack((i[close], j[close])))
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)


def sharing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """All pairs of places in a and b whose fingerprints share an integer."""
    return near(Prints(a), Prints(b), 0, 1.0)


def is_match(a: np.ndarray, b: np.ndarray, least: int, error: float) -> bool:
    _, size, wrong = aligned(a, b, least)
    return size > 0 and wrong <= error


def fingerprints(media: DataFrame, key: str, content: str) -> DataFrame:
    """id, frames, and fingerprint (its integers as bytes) of every row."""

    def run(batches):
        for batch in batches:
            frames, prints = [], []
            for data in batch.column(1).to_pylist():
                picture = chroma(*samples_of(data))
                frames.append(len(picture))
                prints.append(fingerprint(picture).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.int64()), pa.array(prints, pa.binary())], ["id", "frames", "fingerprint"])

    bounded_batches(media.sparkSession, 256)
    return media.select(F.col(key).cast("long").alias("id"), content).mapInArrow(run, "id long, frames long, fingerprint binary")


def match(media: DataFrame, key: str = "id", content: str = "audio", least: int = 8, error: float = 0.12) -> DataFrame:
    """id, frames, fingerprint, class_id, component_id and n_links of every row.

    class_id is the smallest id with the same fingerprint, component_id the
    smallest id reachable by matches, n_links the class's number of matches.
    """
    marked = materialised(fingerprints(media, key, content), "fingerprints")
    # A recording without a fingerprint is like no other.
    same = F.when(F.length("fingerprint") > 0, F.col("fingerprint")).otherwise(F.encode(F.concat(F.lit("none "), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8"))
    marked = marked.withColumn("same", same)
    classes = materialised(marked.groupBy("same").agg(F.min("id").alias("class_id"), F.first("fingerprint").alias("fingerprint")).filter("class_id is not null"), "classes")

    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("fingerprint")), F.lit(0)).alias("bytes")).first()
    blocks = max(BLOCKS, -(-size.n // BLOCK), -(-size.bytes // BLOCK_BYTES))
    own = classes.filter("length(fingerprint) > 0").select("class_id", "fingerprint", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "fingerprint")

    def compared(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        ids, prints, block = t["class_id"].to_numpy(), [np.frombuffer(b, "<u4") for b in t["fingerprint"].to_pylist()], t["block"].to_numpy()
        here, there = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = np.zeros((0, 2), np.int64)
        if len(here) and len(there):
            one = Prints([prints[x] for x in here])
            pairs = near(one, one if i == j else Prints([prints[x] for x in there]), least, error, i == j)
            pairs = np.column_stack([here[pairs[:, 0]], there[pairs[:, 1]]])
            found = pairs[[is_match(prints[x], prints[y], least, error) for x, y in pairs.tolist()]] if len(pairs) else pairs
        degree = np.bincount(found.ravel(), minlength=len(ids))
        label = merge_labels(np.arange(len(ids)), found[:, 0], found[:, 1])
        some, child = np.flatnonzero(degree), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": np.r_[ids[some], ids[child]], "v": np.r_[ids[some], ids[label[child]]], "n": np.r_[degree[some], np.zeros(len(child), np.int64)]})

    links = materialised(met.groupBy("i", "j").applyInArrow(compared, "u long, v long, n long"), "links")
    degree = links.filter("u = v").groupBy(F.col("u").alias("class_id")).agg(F.sum("n").alias("n_links"))
    component = connected_components(links.filter("u <> v").select("u", "v")).toDF("class_id", "component_id")
    known = classes.select("same", "class_id").join(degree, "class_id", "left").join(component, "class_id", "left")
    out = marked.join(known, "same", "left")
    return out.select("id", "frames", "fingerprint", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def sonified(vectors: DataFrame, key: str, vector: str, rate: int = 8000, note: int = 512) -> DataFrame:
    """id and audio: each vector played as a melody, one note for each component (null: no recording)."""
    tones = np.sin(2 * np.pi * 220 * 2 ** (np.arange(25)[:, None] / 12) * np.arange(note) / rate).astype(np.float32) * np.hanning(note).astype(np.float32) * 0.8

    def run(batches):
        for batch in batches:
            sounds = []
            for v in batch.column(1).to_pylist():
                x = None if v is None else np.nan_to_num(np.array([c or 0.0 for c in v], float), posinf=1, neginf=-1)
                sounds.append(None if x is None else wave(tones[np.clip(np.round(12 + 32 * x), 0, 24).astype(int)].ravel(), rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sounds, pa.binary())], ["id", "audio"])

    bounded_batches(vectors.sparkSession, 256)
    return vectors.select(F.col(key).cast("long").alias("id"), vector).mapInArrow(run, "id long, audio binary")


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and matches of all vectors, played as melodies: the tables hold no audio."""
    found = match(sonified(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "frames", F.lower(F.hex(F.xxhash64("fingerprint"))).alias("fingerprint"), "class_id", "component_id", "n_links")
