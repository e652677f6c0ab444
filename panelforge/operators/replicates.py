"""Resampling with replicates as lanes of arrays.

A draw is a function of the group, the replicate and the slot alone (a counter, no state), so
any task can make any lane's draws, and no row stands for a draw. Groups are told once for each
block of lanes; a task works its lanes off in arrays of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import written

#: Numbers that a task holds in one array of lanes.
A_BLOCK = 1 << 21

#: Slots whose words are made at once, and those of a stretch of a path that is told by its sums;
#: stretches of a permutation are no more than 2^A_BUCKETS.
A_CACHE, A_STRETCH, A_BUCKETS = 1 << 16, 1 << 8, 10

#: First slots of a draw that are walked for all lanes together where only a fall to a floor is asked for.
A_HEAD = 1 << 12

#: Words that are looked up together: their places lie in a share of the amounts that a processor's cache holds.
A_PART = 5 << 17

#: Blocks of lanes that all groups together are cut in, and at most those of one group.
A_TASKS, A_GROUP_TASKS = 256, 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words whose output bits each hang on all input bits."""
    x = x.astype(np.uint32)
    return _mix(x, np.empty_like(x))


def _mix(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """mixed(x) in the place of x; `part` is room for as many words."""
    np.right_shift(x, np.uint32(16), out=part)
    for shift, factor in ((15, 0x7FEB352D), (16, 0x846CA68B)):
        np.bitwise_xor(x, part, out=x)
        np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(shift), out=part)
    return np.bitwise_xor(x, part, out=x)


def unmixed(x: np.ndarray) -> np.ndarray:
    """The words whose mixed(x) is x."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(pow(0x846CA68B, -1, 1 << 32))
    x ^= (x >> np.uint32(15)) ^ (x >> np.uint32(30))
    x *= np.uint32(pow(0x7FEB352D, -1, 1 << 32))
    return x ^ (x >> np.uint32(16))


def counters(group: int, reps: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """32-bit words of each replicate (row) and slot (column) of a group."""
    a, b = mixed(np.array([group & 0xFFFFFFFF, (group + 1) & 0xFFFFFFFF]))
    return mixed(mixed(slots.astype(np.uint32) ^ a)[None, :] + mixed(reps.astype(np.uint32) ^ b)[:, None])


def drawn(words: np.ndarray, n: int) -> np.ndarray:
    """Words as places 0 to n - 1."""
    return ((words.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).view(np.int64)


def by_word(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Ascending slots by their words: both are sorted as one number, which is faster than by index."""
    return (np.sort((words.astype(np.uint64) << np.uint64(32)) | slots.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def group_word(by: list[str], seed: int) -> Column:
    """The word of a group: the first 32 bits of an MD5 of the seed and the keys."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def in_lanes(df: DataFrame, replicates: int, lanes: int) -> DataFrame:
    """df once for each block of lanes: `_lane` is the first replicate of the block."""
    return df.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(max(replicates, 1) - 1), F.lit(lanes))))


class Path:
    """Lanes of additive equity: segments are appended, each on the state that the ones before left."""

    def __init__(self, lanes: int, capital: float):
        self.at, self.top, self.worst = (np.full(lanes, x) for x in (capital, capital, 0.0))

    def append(self, steps: np.ndarray) -> None:
        """steps: (lanes, slots) of amounts in their order."""
        if not steps.shape[1]:
            return
        path = np.cumsum(np.concatenate([self.at[:, None], steps], axis=1), axis=1)[:, 1:]
        tops = np.maximum(np.maximum.accumulate(path, axis=1), self.top[:, None])
        self.worst = np.minimum(self.worst, ((path - tops) / tops).min(axis=1))
        self.at, self.top = path[:, -1], tops[:, -1]

    def keep(self, lanes: np.ndarray) -> None:
        """Goes on with some lanes."""
        self.at, self.top, self.worst = (x[lanes] for x in (self.at, self.top, self.worst))


def _walk(start: float, top: float, steps: np.ndarray) -> float:
    """The deepest relative fall of a path from `start` under a former `top`."""
    path = np.cumsum(np.concatenate([[start], steps]))[1:]
    tops = np.maximum(np.maximum.accumulate(path), top)
    return float(((path - tops) / tops).min())


def bounded_fall(gains: np.ndarray, losses: np.ndarray, capital: float, steps_of, floor: float | None = None) -> tuple[float, float] | None:
    """(last amount, deepest relative fall) of a path told in stretches by their sums of gains and of losses.

    Within a stretch the path lies between its start less the losses and its start plus the
    gains. Stretches that can hold a new top are walked first; then tops are known, and only
    those that can fall deeper than the ends of stretches do are walked. `steps_of(stretches)`
    gives their amounts in order. None where many stretches can hold a top: then all are walked.
    With `floor` the fall told is a lesser one, but at `floor` or below where the deepest is: only
    stretches that can reach it are walked, and tops after them aren't asked for.
    """
    ends = capital + np.cumsum(gains - losses)
    if not np.isfinite(ends[-1]):
        return None
    at = np.concatenate([[capital], ends[:-1]])
    slack = 1e-9 * (np.abs(at) + gains + losses + capital)
    tops = np.maximum.accumulate(np.concatenate([[capital], ends]))
    low, rising, near = at - losses - slack, np.flatnonzero(at + gains + slack > tops[:-1]), None
    if floor is not None:
        worst = min(0.0, float(((ends - tops[1:]) / tops[1:]).min()))
        near = np.flatnonzero(low / np.maximum.accumulate(np.maximum(at + gains + slack, capital)) - 1 <= floor)
        if worst <= floor or not len(near):
            return float(ends[-1]), worst
        rising = rising[rising <= near[-1]]
    if max(len(rising), 0 if near is None else len(near)) > max(8, len(at) // 4):
        return None
    risen = dict(zip(rising.tolist(), steps_of(rising), strict=True))
    for k, steps in risen.items():
        if len(steps):
            tops[k + 1] = max(tops[k + 1], at[k] + float(np.cumsum(steps).max()))
    tops = np.maximum.accumulate(tops)
    worst = min(0.0, float(((ends - tops[1:]) / tops[1:]).min()))
    deep = np.flatnonzero(low / tops[:-1] - 1 < worst) if near is None else near
    # a stretch with a new top may fall from that
    deep = deep[~np.isin(deep, rising)]
    for k, steps in [*risen.items(), *zip(deep.tolist(), steps_of(deep), strict=True)]:
        if len(steps):
            worst = min(worst, _walk(at[k], tops[k], steps))
    return float(ends[-1]), worst


#: The two kinds of replicates.
KINDS = ("bootstrap", "permutation")


class _Lanes:
    """Replicates of one group: what each word of a slot is, in blocks that a processor's cache holds.

    Both kinds of a replicate go by the same words, so these are made once. A draw's stretch is
    A_STRETCH slots; a permutation's is the words with the same first bits.
    """

    def __init__(self, group: int, net: np.ndarray, capital: float):
        self.net, self.capital, self.n = np.array(net, float), capital, len(net)
        self.a, self.b = mixed(np.array([group & 0xFFFFFFFF, (group + 1) & 0xFFFFFFFF]))
        self.slots = mixed(np.arange(self.n, dtype=np.uint32) ^ self.a)
        self.wide = A_STRETCH * max(1, A_CACHE // A_STRETCH)
        self.bits = min(A_BUCKETS, max(1, (self.n // A_STRETCH).bit_length() - 1))
        self.buckets = 1 << self.bits
        # gains and losses of a bucket are two places of one histogram
        self.sizes, self.side = np.abs(self.net), np.where(self.net < 0, self.buckets, 0).astype(np.uint32)
        # tops and the deepest fall of falling amounts lie in the first and last buckets: their slots are kept from the first pass
        self.ends = min(self.buckets // 2, max(2, self.buckets >> 8))
        self._last: tuple = (None, None)
        room = min(self.wide, -(-self.n // A_STRETCH) * A_STRETCH)
        self._word, self._part, self._near = np.empty(room, np.uint32), np.empty(room, np.uint32), np.empty(room, bool)
        self._place, self._step = np.empty(room, np.uint64), np.empty(room)
        self._all: np.ndarray | None = None

    def words(self, rep: int, first: int, last: int, every: np.ndarray | None = None) -> np.ndarray:
        """Words of the slots, at most `wide`, in their places of `every`; else in an array that is used again for the next ones."""
        x = self._word[: last - first] if every is None else every[first:last]
        np.add(self.slots[first:last], self._of(rep), out=x)
        return _mix(x, self._part[: len(x)])

    def _of(self, rep: int) -> np.ndarray:
        """The word of a replicate."""
        if self._last[0] != rep:
            self._last = rep, mixed(np.array([rep], np.uint32) ^ self.b)
        return self._last[1]

    def blocks(self, rep: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first slot, words) of all slots."""
        for s in range(0, self.n, self.wide):
            yield s, self.words(rep, s, min(self.n, s + self.wide))

    def of(self, rep: int, kinds: tuple[str, ...], floor: float | None = None) -> list[tuple[float, float]]:
        """(last amount, deepest relative fall) of each kind; with `floor` the fall is as bounded_fall tells it."""
        drawn, dealt = [], np.zeros(2 * self.buckets)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for s, w in self.blocks(rep):
            if "bootstrap" in kinds:
                drawn.append(self._drawn_sums(w))
            if "permutation" in kinds:
                near.append(self._dealt(s, w, dealt))
        told = {"bootstrap": lambda: self._drawn(rep, drawn, floor), "permutation": lambda: self._permuted(rep, dealt, near, floor)}
        return [told[k]() for k in kinds]

    def to_floor(self, reps: np.ndarray, kinds: tuple[str, ...], floor: float) -> list[list[tuple[float, float]]]:
        """As `of` with `floor`, for each replicate. A path that reaches it among its first trades is only summed up after those.

        Words of a replicate differ, so a permutation's first trades are the slots of its least
        words. How many of these are looked at is told by the draws' heads; a path that doesn't
        reach the floor in its head is told in stretches.
        """
        if not np.isfinite(np.abs(self.net).max() * self.n):
            return [self.of(r, kinds) for r in reps.tolist()]
        told, lanes = [], max(1, A_BLOCK // (2 * A_HEAD))
        for s in range(0, len(reps), lanes):
            told += self._lanes_to_floor(reps[s : s + lanes], kinds, floor)
        return told

    def _lanes_to_floor(self, reps: np.ndarray, kinds: tuple[str, ...], floor: float) -> list[list[tuple[float, float]]]:
        falls, used = self._heads(reps, floor)
        known = np.flatnonzero((falls <= floor) | (self.n <= A_HEAD))
        least = np.empty((len(known), min(self.n, 2 * used) if "permutation" in kinds else 0), np.uint32)
        sums = [self._sum_and_least(rep, "bootstrap" in kinds, x) for rep, x in zip(reps[known].tolist(), least, strict=True)]
        least.sort(axis=1)
        path = Path(len(known), self.capital)
        path.append(self.net[self._slots_of(reps[known], least)])
        dealt = (path.worst <= floor) | (least.shape[1] == self.n)
        total = self.capital + float(self.net.sum())
        told = {}
        for k, drawn_sum, fall, whole in zip(known.tolist(), sums, path.worst.tolist(), dealt.tolist(), strict=True):
            of = {"bootstrap": (self.capital + drawn_sum, float(falls[k])), "permutation": (total, fall)}
            if "permutation" in kinds and not whole:
                of["permutation"] = self.of(int(reps[k]), ("permutation",), floor)[0]
            told[k] = [of[kind] for kind in kinds]
        return [told[k] if k in told else self.of(rep, kinds, floor) for k, rep in enumerate(reps.tolist())]

    def _sum_and_least(self, rep: int, summed: bool, least: np.ndarray) -> float:
        """Sum of the amounts that a replicate draws; as many of its least words as `least` has room for are put there.

        Draws are looked up part by part of the amounts: a processor's cache holds one, not all amounts of a large group.
        """
        if self._all is None:
            self._all = np.empty(self.n, np.uint32)
        for s in range(0, self.n, self.wide):
            self.words(rep, s, min(self.n, s + self.wide), self._all)
        first = _parted(self._all)
        if 0 < len(least) < self.n:
            self._all[: first if len(least) < first else self.n].partition(len(least))
        least[:] = self._all[: len(least)]
        return sum(float(self._take(self._all[s : s + self.wide]).sum()) for s in range(0, self.n, self.wide)) if summed else 0.0

    def _slots_of(self, reps: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Slots of each replicate's (row) words."""
        return unmixed(unmixed(words) - mixed(reps.astype(np.uint32) ^ self.b)[:, None]) ^ self.a

    def _heads(self, reps: np.ndarray, floor: float) -> tuple[np.ndarray, int]:
        """(deepest fall of each replicate's first draws, up to A_HEAD or where it reaches the floor; slots after which few hadn't reached it)."""
        word, path = mixed(reps.astype(np.uint32) ^ self.b), Path(len(reps), self.capital)
        falls, left, first, used = np.zeros(len(reps)), np.arange(len(reps)), 0, 1
        while len(left) and first < min(self.n, A_HEAD):
            last = min(self.n, A_HEAD, max(64, 2 * first))
            path.append(self.net[drawn(mixed(self.slots[first:last] + word[left, None]), self.n)])
            falls[left] = path.worst
            if len(left) * 32 > len(reps):
                used = last
            left, first = left[path.worst > floor], last
            path.keep(path.worst > floor)
        return falls, used

    def _take(self, w: np.ndarray) -> np.ndarray:
        """Amounts that words draw; the array is used again for the next ones."""
        at, x = self._place[: len(w)], self._step[: len(w)]
        np.copyto(at, w)
        np.multiply(at, np.uint64(self.n), out=at)
        np.right_shift(at, np.uint64(32), out=at)
        # every place is below n: the mode only saves a copy
        return np.take(self.net, at.view(np.int64), out=x, mode="wrap")

    def _drawn_sums(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._take(w)
        x = self._step[: -(-len(w) // A_STRETCH) * A_STRETCH]
        x[len(w) :] = 0
        total = x.reshape(-1, A_STRETCH).sum(axis=1)
        return total, np.abs(x, out=x).reshape(-1, A_STRETCH).sum(axis=1)

    def _drawn(self, rep: int, sums: list[tuple[np.ndarray, np.ndarray]], floor: float | None = None) -> tuple[float, float]:
        total, size = (np.concatenate(x) for x in zip(*sums, strict=True))

        def steps_of(ks: np.ndarray) -> list[np.ndarray]:
            slots = (ks[:, None] * A_STRETCH + np.arange(A_STRETCH)).ravel()
            # only the last stretch may be cut short
            x = self.net.take(drawn(mixed(self.slots[slots[slots < self.n]] + self._of(rep)), self.n))
            return np.split(x, np.arange(1, len(ks)) * A_STRETCH) if len(ks) else []

        told = bounded_fall((size + total) / 2, (size - total) / 2, self.capital, steps_of, floor)
        return told or self._whole(self._take(w) for _, w in self.blocks(rep))

    def _dealt(self, s: int, w: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds to the gains and losses of the buckets; (slots, words) of the first and the last buckets."""
        part, at = self._part[: len(w)], self._place[: len(w)].view(np.int64)
        np.right_shift(w, np.uint32(32 - self.bits), out=part)
        np.add(part, self.side[s : s + len(w)], out=part)
        np.copyto(at, part)
        sums += np.bincount(at, self.sizes[s : s + len(w)], len(sums))
        # last and first buckets are one run of words that goes over the greatest
        edge = self.ends << (32 - self.bits)
        np.add(w, np.uint32(edge & 0xFFFFFFFF), out=part)
        near = np.less_equal(part, np.uint32(2 * edge - 1), out=self._near[: len(w)])
        found = _flat(near)
        return s + found, w[found]

    def _permuted(self, rep: int, sums: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], floor: float | None = None) -> tuple[float, float]:
        place = lambda w: (w >> np.uint32(32 - self.bits)).astype(np.int64)

        def steps_of(ks: np.ndarray) -> list[np.ndarray]:
            if not len(ks):
                return []
            asked = np.zeros(self.buckets, bool)
            asked[ks] = True
            seen = near if not asked[self.ends : self.buckets - self.ends].any() else ((s + np.arange(len(w)), w) for s, w in self.blocks(rep))
            found = [(slots[k], w[k]) for slots, w in seen for k in [np.flatnonzero(asked[place(w)])]]
            slots, w = (np.concatenate(x) for x in zip(*found, strict=True))
            order = by_word(w, slots)
            return np.split(self.net[order], np.searchsorted(np.sort(place(w)), ks[1:]))

        if told := bounded_fall(sums[: self.buckets], sums[self.buckets :], self.capital, steps_of, floor):
            return told
        w = np.concatenate([w.copy() for _, w in self.blocks(rep)])
        return self._whole([self.net[by_word(w, np.arange(self.n))]])

    def _whole(self, blocks) -> tuple[float, float]:
        path = Path(1, self.capital)
        for x in blocks:
            for s in range(0, len(x), A_CACHE):
                path.append(x[None, s : s + A_CACHE])
        return float(path.at[0]), float(path.worst[0])


def _parted(words: np.ndarray) -> int:
    """Puts words, in their array, in parts of at most A_PART that follow each other; the length of the first part."""
    if len(words) <= A_PART:
        return len(words)
    half = len(words) // 2
    words.partition(half)
    _parted(words[half:])
    return _parted(words[:half])


def _flat(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero, in a mask with few set places by looking at eight as one number."""
    if np.count_nonzero(mask) * 16 > len(mask):
        return np.flatnonzero(mask)
    even = len(mask) & ~7
    found = (np.flatnonzero(mask[:even].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([found[mask[found]], even + np.flatnonzero(mask[even:])])


def path_lanes(group: int, net: np.ndarray, reps: np.ndarray, capital: float, permute: bool | None, floor: float | None = None) -> tuple[np.ndarray, ...]:
    """(return, deepest relative fall) of each replicate: trades drawn with replacement, or all in another order; None: both of the former, both of the latter.

    With `floor` a fall may be told as a lesser one, but as one to `floor` or below where the deepest is.
    """
    lanes, kinds = _Lanes(group, net, capital), KINDS if permute is None else (KINDS[permute],)
    told = np.array([lanes.of(r, kinds) for r in reps.tolist()] if floor is None else lanes.to_floor(reps, kinds, floor))
    return tuple(x for k in range(len(kinds)) for x in (told[:, k, 0] / capital - 1, told[:, k, 1]))


def _packed(names: list[str], schema: pa.Schema, piece: int = 1 << 16):
    """Sorted rows as pieces of their groups: keys, word, place of the piece, amounts as bytes. Null is no amount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, at = np.empty(0), None, 0

        def out(net: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, key, strict=True)) | {"_at": at, "_net": net.tobytes()}], schema)

        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            net = b.column(b.schema.get_field_index("net")).fill_null(0.0).to_numpy(zero_copy_only=False)
            first = 0
            for last in sorted({x for c in columns for x in pc.run_end_encode(c).run_ends.to_pylist()}):
                k = tuple(c[first].as_py() for c in columns)
                if key is not None and k != key:
                    yield out(held)
                    held, at = held[:0], 0
                key, held = k, np.concatenate([held, net[first:last]])
                while len(held) > piece:
                    yield out(held[:piece])
                    held, at = held[piece:], at + 1
                first = last
        if key is not None:
            yield out(held)

    return run


def _run_paths(names: list[str], lanes: int, replicates: int, capital: float, permute: bool | None, least: int, floor: float | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            net = np.frombuffer(b"".join(held))
            if len(net) < least:
                raise ValueError(f"{len(net)} trades, at least {least} are needed")
            *group, word, lane = key
            reps = np.arange(lane, min(lane + lanes, replicates))
            told = path_lanes(word, net, reps, capital, permute, floor)
            falls = told[1::2] if floor is None else [~(x <= floor) for x in told[1::2]]
            n = len(reps) * len(told) // 2
            keys = [pa.array([g] * n, schema.field(i).type) for i, g in enumerate(group)]
            if permute is None:
                keys.append(pa.array(np.repeat(KINDS, len(reps)).tolist(), pa.string()))
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.resize(reps, n), pa.int32()), *(pa.array(np.concatenate(x)) for x in (told[::2], falls))], schema=schema)

        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in [*names, "_lane"]]
            for k, x in zip(zip(*columns, strict=True), b.column(b.schema.get_field_index("_net")).to_pylist(), strict=True):
                if key is not None and k != key:
                    yield out()
                    held = []
                key = k
                held.append(x)
        if key is not None:
            yield out()

    return run


def resampled_paths(trades: DataFrame, by: list[str], order: str, replicates: int, seed: int, capital: float, permute: bool | None, lanes: int | None = None, floor: float | None = None) -> DataFrame:
    """(by..., rep, ret, max_drawdown) of replicates of each group's trades by `order`, then by amount; permute None: both kinds, told by `kind`.

    With `floor`, `shallow` in the place of max_drawdown: whether that is above the floor. A path is then followed only as far as that asks for.

    A group's amounts are written once as pieces of 8 bytes a trade and reach each block of lanes; a task holds
    some four numbers a trade, and blocks of A_CACHE. A permutation asks for a lane's whole order only where its
    stretches don't tell its fall. Blocks are few and large (some A_TASKS in all, at most A_GROUP_TASKS a group, of 128 lanes
    or more), as a group's trades are shuffled once for each; they are dealt by ranges, which are as many as blocks: a hash
    would give some tasks several.
    """
    least = 1 if permute is False else 2
    n = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [trades.schema[c] for c in by]
    told = trades.select(*by, group_word(by, seed).alias("_g"), F.col("net").cast("double").alias("net"), F.col(order).alias("_o"))
    kind = StructType([*keys, *StructType.fromDDL("_g bigint, _at bigint, _net binary").fields])
    sorted_ = told.repartition(n, *by).sortWithinPartitions(*by, "_o", "net").drop("_o")
    pieces = written(sorted_.mapInArrow(_packed([*by, "_g"], to_arrow_schema(kind)), kind), "trades")
    groups = pieces.filter("_at = 0").count()
    if not groups:
        raise ValueError(f"no trades, at least {least} are needed")
    lanes = lanes or max(128, -(-replicates // min(A_GROUP_TASKS, -(-A_TASKS // groups))))
    parts = min(groups * -(-max(replicates, 1) // lanes), 4096)
    blocks = in_lanes(pieces, replicates, lanes).repartitionByRange(parts, *by, "_lane").sortWithinPartitions(*by, "_lane", "_at")
    kinds = [] if permute is not None else StructType.fromDDL("kind string").fields
    kind = StructType([*keys, *kinds, *StructType.fromDDL(f"rep int, ret double, {'max_drawdown double' if floor is None else 'shallow boolean'}").fields])
    return blocks.mapInArrow(_run_paths([*by, "_g"], lanes, replicates, capital, permute, least, floor, to_arrow_schema(kind)), kind)


def correlation_lanes(group: int, unit: np.ndarray, y: np.ndarray, scores: list[np.ndarray], reps: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(Spearman correlations of each score with y by replicate, units): whole units drawn with replacement.

    A replicate's ranks are running sums of its multiplicities over values that are sorted once.
    """
    units, at = np.unique(unit, return_inverse=True)
    m = len(units)
    ties = [np.unique(x, return_inverse=True)[1] for x in (y, *scores)]
    out = np.full((len(scores), len(reps)), np.nan)
    for r in range(len(reps)):
        times = np.zeros(m)
        for s in range(0, m, A_BLOCK):
            times += np.bincount(drawn(counters(group, reps[r : r + 1], np.arange(s, min(m, s + A_BLOCK)))[0], m), minlength=m)
        k = times[at]
        total = k.sum()
        ranks = []
        for t in ties:
            tied = np.bincount(t, weights=k)
            ranks.append((np.cumsum(tied) - tied / 2 - total / 2)[t])
        vy = (k * ranks[0] ** 2).sum()
        for i, x in enumerate(ranks[1:]):
            vx = (k * x**2).sum()
            if vx > 0 and vy > 0:
                out[i, r] = (k * x * ranks[0]).sum() / np.sqrt(vx * vy)
    return list(out), m


def resampled_correlations(df: DataFrame, by: list[str], unit: str, scores: list[str], y: str, replicates: int, seed: int, lanes: int = 128) -> DataFrame:
    """(by..., rep, ic_<score>..., n, n_units): rank correlations of resampled units of each group.

    A group's rows reach each block of lanes once; a task holds some 24 + 16 bytes a score of
    each of them, whatever the replicates. Rows without y or a score count nowhere.
    """
    rows = df.dropna(subset=[y, *scores]).select(*by, group_word(by, seed).alias("_g"), F.col(unit).alias("_unit"), *(F.col(c).cast("double").alias(f"_s_{c}") for c in [y, *scores]))
    kind = StructType([*(df.schema[c] for c in by), *StructType.fromDDL("rep int").fields, *(StructField(f"ic_{c}", DoubleType()) for c in scores), *StructType.fromDDL("n bigint, n_units bigint").fields])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["_lane"].iloc[0])
        reps = np.arange(first, min(first + lanes, replicates))
        column = lambda c: rows[f"_s_{c}"].to_numpy()
        unit_of = rows["_unit"]
        ics, m = correlation_lanes(int(rows["_g"].iloc[0]), unit_of.to_numpy() if unit_of.dtype != object else unit_of.astype(str).to_numpy(), column(y), [column(c) for c in scores], reps)
        out = {c: [rows[c].iloc[0]] * len(reps) for c in by} | {"rep": reps} | {f"ic_{c}": pd.Series(x).astype(object).where(~np.isnan(x), None) for c, x in zip(scores, ics, strict=True)}
        return pd.DataFrame(out | {"n": len(rows), "n_units": m})

    return in_lanes(rows, replicates, lanes).groupBy(*by, "_lane").applyInPandas(run, kind)

