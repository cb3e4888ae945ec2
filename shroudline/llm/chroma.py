"""Chroma audio fingerprints of a media column, and alignment of recordings by them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, join_sized, table

#: Samples of a frame at the fingerprint's sampling rate of 2048 Hz, and between frames.
RATE, FRAME, HOP = 2048, 512, 128
#: Frames of the widest filter; each window of so many frames gives one packed integer.
WIDTH = 16
#: A window whose mean energy is under this share of full scale is silent and isn't looked up.
SILENCE = 1e-4
#: Equal packed integers at one offset that make a candidate; bit errors that a match has at most, over at least so many windows.
MIN_VOTES, MAX_BIT_ERROR, MIN_OVERLAP = 3, 0.25, 24
#: Of a run of equal packed integers the first is looked up, and every STEADY-th after it.
STEADY = 8
#: For the bounded way: a packed integer that more windows have is looked up together with the next ones, up to so many of them.
LONG_LIST, AHEAD = 256, 4
#: Looked-up windows of a block of recordings, about; meetings that one step of a block's task counts at most.
BLOCK, STEP = 500_000, 1_000_000
#: Thresholds between the four levels of a filter's response. None is at zero, which is the response to two areas without sound: noise would decide there.
LEVELS = (-0.35, 0.04, 0.35)


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters as (kind, first pitch class, pitch classes, frames): kinds are up/down, left/right, checkers and middle/outside."""
    return [(k % 4, (5 * k) % 8, (2, 4, 3, 4)[k // 4], (4, 8, 12, 16)[(k + k // 4) % 4]) for k in range(16)]


_PITCH = None


def _pitch_matrix() -> np.ndarray:
    """(bins, 12): each bin of the spectrum between 60 and 1000 Hz to its pitch class."""
    global _PITCH
    if _PITCH is None:
        hz = np.fft.rfftfreq(FRAME, 1 / RATE)
        inside = (hz >= 60) & (hz <= 1000)
        out = np.zeros((len(hz), 12), dtype=np.float32)
        pitch = np.round(12 * np.log2(np.where(inside, hz, 440) / 440)).astype(int) % 12
        out[np.flatnonzero(inside), pitch[inside]] = 1
        _PITCH = out
    return _PITCH


def resample(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE: means over the source samples of each step when going down, else linear interpolation."""
    if rate == RATE or not len(pcm):
        return pcm
    n = max(1, int(len(pcm) * RATE / rate))
    if rate > RATE:
        total = np.concatenate([[0.0], np.cumsum(pcm)])
        edges = np.minimum((np.arange(n + 1) * rate / RATE).astype(int), len(pcm))
        return np.diff(total[edges]) / np.maximum(np.diff(edges), 1)
    return np.interp(np.arange(n) * rate / RATE, np.arange(len(pcm)), pcm)


def chroma(pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pitch-class frames (frames, 12), each of sum one, and the frames' energies."""
    n = (len(pcm) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12)), np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[:: HOP][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    pitch = power @ _pitch_matrix()
    return pitch / np.maximum(pitch.sum(axis=1, keepdims=True), 1e-9), (frames**2).mean(axis=1)


def fingerprint(pcm: np.ndarray, rate: int = RATE) -> tuple[list[int], list[bool]]:
    """Packed 32-bit integers, one for each window of WIDTH frames, and whether the window has sound.

    Sums over rectangles of the pitch-class frames come from the integral image. A filter compares
    two areas as log((1 + a) / (1 + b)); its level, 0 to 3, is Gray-coded into two bits.
    """
    image, energy = chroma(resample(pcm.astype(float), rate))
    n = len(image) - WIDTH + 1
    if n < 1:
        return [], []
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x0, x1, y0, y1):
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    packed = np.zeros(n, dtype=np.uint32)
    for kind, low, height, width in filters():
        high, mid, half = low + height, low + height // 2, width // 2
        whole = area(0, width, low, high)
        if kind == 0:
            a = area(0, width, mid, high)
        elif kind == 1:
            a = area(half, width, low, high)
        elif kind == 2:
            a = area(0, half, low, mid) + area(half, width, mid, high)
        else:
            a = area(width // 4, width - width // 4, low, high)
        level = np.digitize(np.log((1 + a) / (1 + whole - a)), LEVELS)
        packed = (packed << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    loud = np.convolve(energy, np.ones(WIDTH) / WIDTH, "valid") >= SILENCE
    return packed.astype(np.int32, casting="unsafe").tolist(), loud.tolist()


def fingerprints(media: DataFrame, id_col: str = "id", audio_col: str = "audio", rate_col: str | None = "sample_rate", decode: Callable[[int | None, object], bytes | None] | None = None) -> DataFrame:
    """(id, fp array<int>, loud array<boolean>) of a media column with mono 16-bit little-endian PCM.

    decode turns (id, stored value) into such audio inside the task, where a column holds another format.
    Cases: null or too short audio has an empty fingerprint; a trailing odd byte is ignored; a null
    rate, or no column of rates, is RATE; repeated rows give a row each.

    Audio is large, so rows reach Python a hundred at a time at most, not in Arrow batches of ten
    thousand; a row costs milliseconds, beside which its transfer is nothing.
    """

    @F.udf("struct<fp:array<int>,loud:array<boolean>>", useArrow=False)
    def one(key, value, rate):
        raw = (value if decode is None else decode(key, value)) or b""
        return fingerprint(np.frombuffer(raw, dtype="<i2", count=len(raw) // 2) / 32768, rate or RATE)

    rate = F.lit(None) if rate_col is None else F.col(rate_col)
    key = F.col(id_col).cast("long")
    got = media.select(key.alias("id"), one(key, F.col(audio_col), rate.cast("int")).alias("f"))
    return got.select("id", "f.fp", "f.loud")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits, and compared integers, when a[i] lies over b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    x = a[lo:hi].view(np.uint32) ^ b[lo + offset : hi + offset].view(np.uint32)
    return float(np.bitwise_count(x).sum()) / (32 * (hi - lo)), hi - lo


def _classes(fps: DataFrame) -> DataFrame:
    """(rep, n, fp, loud): recordings with one fingerprint as one row, named by the smallest id."""
    return fps.where("id IS NOT NULL").groupBy("fp", "loud").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def _postings(classes: DataFrame) -> DataFrame:
    """(rep, pos, ahead): the packed integers of sounding windows that are looked up, each with up to AHEAD - 1 next ones behind it."""

    def run(batches):
        for batch in batches:
            rep, pos, ahead = [], [], []
            for r, fp, loud in zip(*(batch.column(c).to_pylist() for c in ("rep", "fp", "loud"))):
                at = looked_up(np.array(fp, dtype=np.int64), np.array(loud, dtype=bool))
                values = [fp[i] for i in at]
                rep += [r] * len(at)
                pos += at
                ahead += [values[k : k + AHEAD] for k in range(len(at))]
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(pos, pa.int32()), pa.array(ahead, pa.list_(pa.int32()))], names=["rep", "pos", "ahead"])

    return classes.select("rep", "fp", "loud").mapInArrow(run, "rep long, pos int, ahead array<int>")


def looked_up(fp: np.ndarray, loud: np.ndarray) -> list[int]:
    """Positions of the integers that are looked up: those that begin a run of equal ones, and every STEADY-th of a run."""
    if not len(fp):
        return []
    first = np.concatenate([[True], fp[1:] != fp[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
    return np.flatnonzero(loud & ((np.arange(len(fp)) - start) % STEADY == 0)).tolist()


def meetings(asking: DataFrame, known: DataFrame, long_list: int | None = None) -> DataFrame:
    """(q, q_pos, rep, pos): windows of the asking recordings and of the known ones (both as _postings gives them) with the same key.

    The key of a window is its packed integer: all equal ones meet. With a long_list, the bounded way,
    an integer that more than long_list known windows have is keyed anew together with the next one,
    and so on up to AHEAD integers, so that what a window meets stays bounded as the table grows; a list
    that is long even then is joined as it is. A common integer thus votes only where its neighbours
    agree, too, and matches may be lost. Nothing is lost by exact_votes, which align takes.
    What a level leaves to the next is checkpointed, so that no level runs again.
    """
    key = lambda k: F.xxhash64(F.lit(k), F.slice("ahead", 1, k + 1))
    asking = asking.select(F.col("rep").alias("q"), F.col("pos").alias("q_pos"), "ahead")
    if long_list is None:
        value = F.col("ahead")[0].alias("value")
        return asking.select("q", "q_pos", value).join(known.select("rep", "pos", value), "value").select("q", "q_pos", "rep", "pos")
    known, asking, out = known.checkpoint(), asking.checkpoint(), None
    for k in range(AHEAD):
        known, asking = known.withColumn("key", key(k)), asking.withColumn("key", key(k))
        long = known.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > long_list).withColumn("long", F.lit(True)).checkpoint()
        more = k + 1 < AHEAD and not long.isEmpty()
        if more:
            known, asking = join_sized(known, long, "key", "n", "rep"), join_sized(asking, long, "key", "n", "q")
            short = asking.where("long IS NULL").join(known.where("long IS NULL"), "key")
        else:
            short = asking.join(known, "key")
        met = short.select("q", "q_pos", "rep", "pos")
        out = met if out is None else out.union(met)
        if not more:
            return out
        known, asking = (df.where("long").drop("key", "long").checkpoint() for df in (known, asking))


def _windows(classes: DataFrame) -> DataFrame:
    """(rep, pos array<int>, value array<int>): the looked-up windows of each recording that has any, and their packed integers."""

    def run(batches):
        for batch in batches:
            rep, pos, value = [], [], []
            for r, fp, loud in zip(*(batch.column(c).to_pylist() for c in ("rep", "fp", "loud"))):
                at = looked_up(np.array(fp, dtype=np.int64), np.array(loud, dtype=bool))
                if at:
                    rep.append(r)
                    pos.append(at)
                    value.append([fp[i] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(pos, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.int32()))], names=["rep", "pos", "value"])

    return classes.select("rep", "fp", "loud").mapInArrow(run, "rep long, pos array<int>, value array<int>")


def by_integer(rep: np.ndarray, pos: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows (recording counted from zero, position, integer) in the order of their integers, then of recordings: (codes, rep, pos)."""
    rep, pos, value = (np.asarray(x, dtype=np.int64) for x in (rep, pos, value))
    codes = (value + (1 << 31)) * (int(rep.max(initial=0)) + 1) + rep
    order = np.argsort(codes, kind="stable")
    return codes[order], rep[order], pos[order]


def best_offsets(known: tuple[np.ndarray, ...], asking: tuple[np.ndarray, ...], min_votes: int, step: int = STEP) -> tuple[np.ndarray, ...]:
    """(q, rep, offset, votes) of all pairs that have min_votes equal integers at one offset: the offset with the most, of equal ones the smallest shift.

    known is by_integer of the known windows; asking is (recording, position, integer), one entry a window, whose
    recordings do not decrease. Pairs are counted apart from each other, so that more than step
    meetings are counted for fewer askers at a time, then for fewer known recordings, and those of one pair
    for fewer of its windows.
    """
    (codes, rep, pos), (q, q_pos, q_value) = known, (np.asarray(x, dtype=np.int64) for x in asking)
    out = [np.zeros((4, 0), dtype=np.int64)]
    if not len(codes) or not len(q):
        return tuple(out[0])
    n, shift = int(rep.max()) + 1, int(q_pos.max())
    span = int(pos.max()) + shift + 1
    q_code = (q_value + (1 << 31)) * n

    def cells(i: int, j: int, low: int, high: int) -> np.ndarray:
        """One number for asker, known recording and offset of each meeting of the asking windows i to j with the recordings low to high."""
        first, last = np.searchsorted(codes, q_code[i:j] + low), np.searchsorted(codes, q_code[i:j] + high)
        many = last - first
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        return (np.repeat(q[i:j] - q[i], many) * n + rep[at]) * span + pos[at] - np.repeat(q_pos[i:j], many) + shift

    def keep(i: int, cell: np.ndarray, votes: np.ndarray) -> None:
        cell, votes = cell[votes >= min_votes], votes[votes >= min_votes]
        pair, offset = cell // span, cell % span - shift
        rank = np.lexsort((offset, -np.abs(offset), votes, pair))
        pair, offset, votes = pair[rank], offset[rank], votes[rank]
        best = np.append(pair[1:] != pair[:-1], True)[: len(pair)]
        out.append(np.stack([q[i] + pair[best] // n, pair[best] % n, offset[best], votes[best]]))

    todo = [(0, len(q), 0, n)]
    while todo:
        i, j, low, high = todo.pop()
        met = int((np.searchsorted(codes, q_code[i:j] + high) - np.searchsorted(codes, q_code[i:j] + low)).sum())
        several = q[i] != q[j - 1]
        if not met:
            continue
        if met <= step and (int(q[j - 1] - q[i]) + 1) * n * span < 1 << 62:
            keep(i, *np.unique(cells(i, j, low, high), return_counts=True))
        elif several:
            # The cut that is nearest to the middle between two askers.
            middle = q[(i + j) // 2]
            cut = i + int(np.searchsorted(q[i:j], middle))
            cut = cut if cut > i else i + int(np.searchsorted(q[i:j], middle, "right"))
            todo += [(i, cut, low, high), (cut, j, low, high)]
        elif high - low > 1:
            todo += [(i, j, low, (low + high) // 2), (i, j, (low + high) // 2, high)]
        else:
            votes = np.zeros(span, dtype=np.int64)
            size = max(1, (j - i) * step // met)
            for k in range(i, j, size):
                votes += np.bincount(cells(k, min(j, k + size), low, high) - low * span, minlength=span)
            at = np.flatnonzero(votes)
            keep(i, at + low * span, votes[at])
    return tuple(np.concatenate(out, axis=1))


def exact_votes(asking: DataFrame, known: DataFrame, min_votes: int, block: int = BLOCK) -> DataFrame:
    """(q, rep, offset, votes) of every pair of classes with min_votes equal integers or more at one offset, whatever the lengths of their lists.

    Known recordings are dealt into blocks of about so many looked-up windows. A looked-up window of an asking one
    goes once to each block that holds its integer, however many windows there have it. A block's task counts
    all votes of its recordings, so that no meeting is shuffled; an asking recording is counted whole before the next one.
    Cost: the meetings are counted, and they grow with the square of the table; a common integer costs as many
    rows as there are blocks, not as many as its list is long.
    """
    spark = known.sparkSession
    theirs, ours = _windows(known).checkpoint(), _windows(asking).checkpoint()
    n_windows = theirs.agg(F.sum(F.size("pos"))).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_windows // block))
    theirs = theirs.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int"))
    asked = ours.select(F.col("rep").alias("q"), F.inline(F.arrays_zip("pos", "value"))).withColumn("value", F.col("value").cast("long"))
    places = theirs.select("block", F.explode(F.array_distinct(F.col("value").cast("array<bigint>"))).alias("value")).distinct()
    sized = asked.groupBy("value").agg(F.count("*").alias("n")).join(places, "value").groupBy("value", "n").agg(F.collect_list("block").alias("blocks")).checkpoint()
    sent = join_sized(asked, sized, "value", "n", "q").select(F.explode("blocks").alias("block"), F.col("q").alias("id"), F.array("pos").alias("pos"), F.array(F.col("value").cast("int")).alias("value"))
    rows = theirs.select("block", F.lit(False).alias("asks"), F.col("rep").alias("id"), "pos", "value").union(sent.select("block", F.lit(True), "id", "pos", "value"))

    def run(batches):
        held, known, names, waiting = None, None, None, []

        def parts(batch):
            size = pa.compute.list_value_length(batch.column("pos")).to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            return np.repeat(ids, size), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pos", "value"))

        def counted(last: bool):
            """Votes of the askers that wait; the last one may go on in the next batch, and waits unless this is the end of the block."""
            nonlocal known, names, waiting
            if not waiting:
                return
            ids, pos, value = (np.concatenate(x) for x in zip(*waiting))
            end = len(ids) if last else int(np.searchsorted(ids, ids[-1]))
            waiting = [(ids[end:], pos[end:], value[end:])] if end < len(ids) else []
            if not end:
                return
            if names is None:
                got = [np.concatenate(x) for x in zip(*known)]
                names, local = np.unique(got[0], return_inverse=True)
                known = by_integer(local, got[1], got[2])
            askers, local = np.unique(ids[:end], return_inverse=True)
            q, rep, offset, votes = best_offsets(known, (local, pos[:end], value[:end]), min_votes)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(askers[q], pa.int64()), pa.array(names[rep], pa.int64()), pa.array(offset, pa.int32()), pa.array(votes, pa.int64())], names=["q", "rep", "offset", "votes"])

        for batch in batches:
            blocks, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks"))
            edges = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]))) if len(blocks) else []
            for i, j in zip(edges, [*edges[1:], len(blocks)]):
                if blocks[i] != held:
                    yield from counted(True)
                    held, known, names = blocks[i], [], None
                (waiting if asks[i] else known).append(parts(batch.slice(i, j - i)))
            yield from counted(False)
        yield from counted(True)

    dealt = rows.repartition(n_blocks, "block").sortWithinPartitions("block", "asks", "id")
    return dealt.mapInArrow(run, "q long, rep long, offset int, votes long")


def align(fps: DataFrame, asked: DataFrame, min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR, long_list: int | None = None) -> DataFrame:
    """Find the recordings of fps (id, fp, loud) that the recordings of asked (likewise) are part of or overlap with.

    Recordings with one fingerprint are one class, so that copies cost nothing in the search. Packed
    integers of sounding windows are looked up; equal ones vote for the offset between two classes;
    for the offset with the most votes, min_votes or more (of equal ones the smallest shift),
    the bit error over the whole overlap decides. All votes are counted (exact_votes); with a long_list only
    those that meetings leaves. Returns (query_id, match_id, n_copies, offset, votes,
    bit_error): match_id is the smallest id of the matching class and n_copies its size.
    Cases: recordings without an id are left out; empty and silent ones match nothing; repeated
    rows count as copies; an empty table on either side gives no rows.
    """
    ensure_checkpoint_dir(fps.sparkSession)
    known, asked = _classes(fps).checkpoint(), asked.where("id IS NOT NULL").checkpoint()
    wanted = _classes(asked).checkpoint()
    if long_list is None:
        votes = exact_votes(wanted, known, min_votes)
    else:
        votes = (
            meetings(_postings(wanted), _postings(known), long_list)
            .groupBy("q", "rep", (F.col("pos") - F.col("q_pos")).alias("offset"))
            .agg(F.count("*").alias("votes"))
            .where(F.col("votes") >= min_votes)
            .groupBy("q", "rep")
            .agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("best"))
            .select("q", "rep", "best.offset", "best.votes")
        )
    pairs = votes.join(wanted.select(F.col("rep").alias("q"), F.col("fp").alias("q_fp")), "q").join(known.select("rep", "fp", "n"), "rep")

    def verify(batches):
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("q_fp", "fp", "offset")}
            both = [bit_error(np.array(a, np.int32), np.array(b, np.int32), o) for a, b, o in zip(cols["q_fp"], cols["fp"], cols["offset"])]
            errors = [error if n >= min(MIN_OVERLAP, len(a)) else 1.0 for (error, n), a in zip(both, cols["q_fp"])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "rep", "n", "offset", "votes")), pa.array(errors, pa.float64())], names=["q", "rep", "n", "offset", "votes", "bit_error"])

    found = pairs.mapInArrow(verify, "q long, rep long, n long, offset int, votes long, bit_error double").where(F.col("bit_error") <= max_bit_error)
    members = asked.join(wanted, ["fp", "loud"]).select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    return members.join(found, "q").select("query_id", F.col("rep").alias("match_id"), F.col("n").alias("n_copies"), "offset", "votes", "bit_error")


# ---- recordings for tables without media ----

#: Samples of a note of a rendered recording.
NOTE = 256


def render(vector: list[float] | None) -> bytes:
    """A vector as a melody: each number picks one of 24 semitones above 110 Hz; mono 16-bit PCM at RATE."""
    v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in vector or []])
    if not len(v):
        return b""
    hz = 110 * 2 ** (np.floor(v * 199).astype(np.int64) % 24 / 12)
    phase = np.cumsum(np.repeat(hz, NOTE)) * (2 * np.pi / RATE)
    return (np.sin(phase) * 16000).astype("<i2").tobytes()


#: Where the excerpts begin, in samples: not on a frame, so that the windows differ a little. Their noise as a share of full scale.
EXCERPT_START, EXCERPT_NOISE = 24 * HOP + 37, 0.01
def excerpt(key: int | None, raw: bytes) -> bytes:
    """A recording without its beginning and with some noise, as another recording of it would be."""
    pcm = np.frombuffer(raw, dtype="<i2")[EXCERPT_START:]
    noise = np.random.default_rng(abs(key or 0)).normal(0, 32768 * EXCERPT_NOISE, len(pcm))
    return np.clip(pcm + noise, -32768, 32767).astype("<i2").tobytes()


def op3_chroma(spark, sf_dir):
    """Recordings rendered from all embeddings; a noisy excerpt of every one whose id is divisible by 20 is looked for in all of them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    known = fingerprints(vectors, "vec_id", "embedding", None, lambda _, v: render(v))
    return align(known, fingerprints(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", None, lambda k, v: excerpt(k, render(v))))
