"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

Sets A and B with a Jaccard similarity of t or more lack at most d(n) = floor((1-t) n) of each
other's elements, n being the own size. So, in any common order of elements, the first d + k of
each share k or more.

* Light sets enumerate all subsets of `SUBSET` elements out of their first d + SUBSET ones, in
  hash order; linked light sets share a subset.
* Heavy sets put their first p = d + k elements in inverted lists, k growing with n. Linked
  sets share k' or more of those, k' being the k of the smallest size a partner may have; so
  the p - k' + 1 rarest of the p share one in the order of list lengths. Elements that stand in
  one set alone find nothing and leave at once.

The boundary is the size with the least total of subsets and list entries; sets down to t times
the boundary go into the inverted lists too, so that no pair across it is lost.

Equal sets are one node, named by a hash of the set. Candidates are verified on whole sets.
Since only classes are asked for, a list first tries each member against one hub; members that
are linked by then are never paired, and only pairs across classes are tried in the end, block by
block where the sets lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, packed, partitions
from .shingles import mix, set_id, shingle_set

SUBSET = 2


@dataclass(frozen=True)
class Sizes:
    """What a set of n elements needs at a similarity of percent / 100."""

    percent: int

    def missing(self, n: int) -> int:
        return n * (100 - self.percent) // 100

    def smallest(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def shared(self, n: int) -> int:
        """k of a heavy set: three tenths of it, as far as there are elements."""
        return max(1, min(n - self.missing(n), -(-3 * n // 10)))

    def listed(self, n: int) -> int:
        return self.missing(n) + self.shared(n)

    def kept(self, n: int) -> int:
        """How many of the listed elements, rarest first, have to stay."""
        return self.listed(n) - min(self.shared(m) for m in (self.smallest(n), n)) + 1

    def subsets(self, n: int) -> int:
        m = min(n, self.missing(n) + SUBSET)
        return m * (m - 1) // 2


def light_keys(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Hashes of all subsets of two out of the first elements in hash order."""
    first = s[: sizes.missing(len(s)) + SUBSET]
    if len(first) < SUBSET:
        return first[:0]
    pairs = np.array(list(combinations(range(len(first)), SUBSET)))
    return mix(mix(first[pairs[:, 0]] + np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB) + first[pairs[:, 1]])


def choose_boundary(have: dict[int, int], sizes: Sizes, largest: int = 200) -> int:
    """The light-heavy boundary of least cost, from how many sets there are of each size up to `largest`."""

    def cost(x: int) -> int:
        return sum(c * sizes.subsets(n) for n, c in have.items() if n <= x) + sum(c * sizes.listed(n) for n, c in have.items() if n >= sizes.smallest(x + 1))

    return min(range(largest + 1), key=lambda x: (cost(x), x))


def _size_counts(docs: DataFrame, words: int, largest: int = 200) -> tuple[dict[int, int], int]:
    """How many texts there are of about each set size up to `largest`, and about how many elements in all.

    Told from blanks, without a shingle: only costs depend on it.
    """
    n = F.greatest(F.length("text") - F.length(F.translate("text", " ", "")) + 2 - words, F.lit(1))
    rows = docs.filter("text is not null").groupBy(F.least(n, F.lit(largest + 1)).alias("n")).agg(F.count("*").alias("c"), F.sum(n).alias("elements")).collect()
    return {r["n"]: r["c"] for r in rows if r["n"] <= largest}, sum(r["elements"] for r in rows)


_PACK = "bucket int, keys binary, sids binary, sizes binary, counts binary, doc_ids array<string>, texts binary"


def _postings(docs: DataFrame, words: int, sizes: Sizes, boundary: int, buckets: int, flush: int = 500_000) -> DataFrame:
    """List entries in packs: (bucket, keys, sids, sizes, counts), each set once for each task; and packs of rows, with doc_ids and hashes of texts in place of keys and counts.

    Keys of one set stand together, so its name and size are told once a pack. A light key has
    its lowest bit set, a heavy one clear. An empty set has the size 0.
    """
    from_size = sizes.smallest(boundary + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        sids: list[int] = []
        ns: list[int] = []
        held = 0

        def packs() -> pd.DataFrame:
            count = np.array([len(k) for k in keys])
            every, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), count)
            to = ((every >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            every, owner, to = every[order], owner[order], to[order]
            edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
            rows = []
            sid, n = np.array(sids, np.int64), np.array(ns, np.int32)
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                own, c = np.unique(owner[a:z], return_counts=True)
                rows.append((int(to[a]), every[a:z].tobytes(), sid[own].tobytes(), n[own].tobytes(), c.astype(np.int32).tobytes(), None, None))
            return pd.DataFrame(rows, columns=["bucket", "keys", "sids", "sizes", "counts", "doc_ids", "texts"])

        for b in batches:
            row_sids, row_ns = [], []
            for text in b["text"]:
                s = shingle_set(text, words)
                sid = set_id(s)
                row_sids.append(sid)
                row_ns.append(len(s))
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                own = []
                if len(s) <= boundary:
                    own.append(light_keys(s, sizes) | np.uint64(1))
                if len(s) >= from_size:
                    own.append(s[: sizes.listed(len(s))] & ~np.uint64(1))
                k = np.unique(np.concatenate(own)) if own else s[:0]
                if len(k):
                    keys.append(k)
                    sids.append(sid)
                    ns.append(len(s))
                    held += len(k)
                if held > flush:
                    yield packs()
                    keys, sids, ns, held = [], [], [], 0
            if len(b):
                told = np.array(row_sids, np.int64)
                yield pd.DataFrame({"bucket": [int(mix(told[:1].view(np.uint64))[0] % np.uint64(buckets))], "keys": None, "sids": [told.tobytes()], "sizes": [np.array(row_ns, np.int32).tobytes()], "counts": None, "doc_ids": [b["doc_id"].tolist()], "texts": [b["h"].to_numpy(np.int64).tobytes()]})
        if keys:
            yield packs()

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInPandas(run, _PACK)


_ENTRY = "key bigint, sid bigint, n bigint, length bigint, doc_id string, h bigint"


def _shared_entries(packs: DataFrame) -> DataFrame:
    """(key, sid, n, length): entries of the lists that hold two sets or more; and with a length of 0 all rows (doc_id, sid, n, h)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, pdf = pdf[pdf["keys"].isna()], pdf[pdf["keys"].notna()]
        told = pd.DataFrame({"key": 0, "sid": np.frombuffer(b"".join(rows["sids"]), np.int64), "n": np.frombuffer(b"".join(rows["sizes"]), np.int32).astype(np.int64), "length": 0, "doc_id": [i for ids in rows["doc_ids"] for i in ids], "h": np.frombuffer(b"".join(rows["texts"]), np.int64)})
        told["doc_id"] = told["doc_id"].astype(object)
        if pdf.empty:
            return told
        count = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        sids = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sids"]]), count)
        n = np.repeat(np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]]), count)
        order = np.argsort(keys, kind="stable")
        keys, sids, n = keys[order], sids[order], n[order]
        more = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        more[1:] |= same
        more[:-1] |= same
        keys, sids, n = keys[more], sids[more], n[more]
        # a set that several tasks told is one entry
        order = np.lexsort((sids, keys))
        keys, sids, n = keys[order], sids[order], n[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
        keys, sids, n = keys[first], sids[first], n[first]
        _, at, length = np.unique(keys, return_inverse=True, return_counts=True)
        length = length[at] if len(keys) else length
        keep = length > 1
        found = pd.DataFrame({"key": keys[keep].view(np.int64), "sid": sids[keep], "n": n[keep].astype(np.int64), "length": length[keep], "doc_id": None, "h": 0})
        return pd.concat([told, found]) if len(told) else found

    return packs.groupBy("bucket").applyInPandas(run, _ENTRY)


def _rarest(entries: DataFrame, percent: int) -> DataFrame:
    """Drop the entries of heavy sets that the rarest ones make needless: `Sizes` as expressions."""
    missing = lambda n: f"({n} * {100 - percent} div 100)"
    shared = lambda n: f"greatest(1, least({n} - {missing(n)}, (3 * {n} + 9) div 10))"
    smallest = f"(({percent} * n + 99) div 100)"
    mine = Window.partitionBy("sid", "light")
    # elements in no shared list are rarer than all that are
    ranked = entries.withColumn("light", F.col("key").bitwiseAND(F.lit(1)) == 1).withColumns({"rank": F.row_number().over(mine.orderBy("length", "key")), "mine": F.count("*").over(mine)})
    return ranked.filter(F.expr(f"light or rank <= mine + 1 - least({shared(smallest)}, {shared('n')})")).select("key", "sid", "n")


def _bits(names: DataFrame, log_bits: int) -> np.ndarray:
    """A bitmap of hashes (h): what it lets through too much costs bytes, not results."""
    word = F.shiftrightunsigned("h", 70 - log_bits)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = names.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << log_bits - 6, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _whole_sets(docs: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """(sid, elements) of the sets that stand in any list, from one text each; candidates: (sid, h), h the hash of such a text.

    The bitmap has 16 bits a candidate, at most 2^30 in all; no other text is shingled.
    """
    log_bits = min(30, max(16, (16 * candidates.count()).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(_bits(candidates, log_bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bits.value
        seen: set[int] = set()
        for b in batches:
            h = b["h"].to_numpy(np.int64)
            word = (h.view(np.uint64) >> np.uint64(70 - log_bits)).astype(np.int64)
            hit = (held[word].view(np.uint64) >> (h.view(np.uint64) & np.uint64(63))) & np.uint64(1)
            own = [(x, text) for x, text in zip(h[hit == 1].tolist(), b["text"][hit == 1], strict=True) if x not in seen]
            seen.update(x for x, _ in own)
            sets = [shingle_set(text, words) for _, text in own]
            sets = [s for s in sets if len(s)]
            yield pd.DataFrame({"sid": np.array([set_id(s) for s in sets], np.int64), "elements": [s.tobytes() for s in sets]})

    told = docs.select(F.xxhash64("text").alias("h"), "text").mapInPandas(run, "sid bigint, elements binary")
    return told.join(candidates.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for x, y in zip(b["x"], b["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.loc[good, ["a", "b"]]

    held = pairs.join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("elements").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint")


def _linked_in_group(entries: pd.DataFrame, held: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between sets of two blocks, or within one, that share a list and whose labels differ."""
    if entries.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    held = held.sort_values("node")
    sids, label, block, n = (held[c].to_numpy(copy=True) for c in ("node", "label", "block", "n"))
    sets = [np.frombuffer(x, np.uint64) for x in held["elements"]]
    start = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    flat = np.concatenate(sets)
    place = np.searchsorted(sids, entries["sid"].to_numpy())
    order = np.argsort(entries["key"].to_numpy(), kind="stable")
    key, place = entries["key"].to_numpy()[order], place[order]
    lists = np.split(place, np.flatnonzero(key[1:] != key[:-1]) + 1)
    of: list[list[int]] = [[] for _ in sids]
    for k, members in enumerate(lists):
        for m in members:
            of[m].append(k)
    two = block.min() != block.max()
    good: list[tuple[int, int]] = []
    for i in range(len(sids)):
        if two and block[i] != block.min():
            continue
        others = np.unique(np.concatenate([lists[k] for k in of[i]]))
        others = others[(block[others] != block[i]) if two else others > i]
        others = others[(label[others] != label[i]) & (n[others] * percent <= n[i] * 100) & (n[i] * percent <= n[others] * 100)]
        if not len(others):
            continue
        size = n[others]
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        every = flat[np.arange(size.sum()) - np.repeat(begin - start[others], size)]
        hit = sets[i][np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)] == every
        both = np.add.reduceat(hit, begin, dtype=np.int64)
        linked = others[100 * both >= percent * (size + n[i] - both)]
        # of equal labels all are connected: one link to each is enough, and merges them here, too
        olds, first = np.unique(label[linked], return_index=True)
        for old, m in zip(olds, linked[first], strict=True):
            good.append((int(sids[i]), int(sids[m])))
            label[label == old] = label[i]
    return pd.DataFrame(good, columns=["a", "b"], dtype="int64")


def _blocks(nodes: DataFrame, nodes_a_block: int, bytes_a_block: int) -> DataFrame:
    """(sid, block) of nodes (sid, least, n): those of one least key in as many blocks as their count and bytes need."""
    count, elements = nodes.agg(F.count("*"), F.sum("n")).first()
    blocks = max(1, -(-count // nodes_a_block), -(-8 * (elements or 0) // bytes_a_block))
    need = F.greatest(F.ceil(F.count("*") / nodes_a_block), F.ceil(8 * F.sum("n") / bytes_a_block))
    # most least keys have few sets: four blocks will do
    hot = nodes.groupBy("least").agg(need.alias("parts")).filter("parts > 4")
    parts = F.coalesce("parts", F.lit(4))
    block = F.pmod(F.xxhash64("least") % blocks + F.pmod(F.xxhash64("sid"), parts), F.lit(blocks)).cast("int")
    return nodes.join(hot, "least", "left").select("sid", block.alias("block"))


def _across(told: DataFrame, sets: DataFrame, percent: int, nodes_a_block: int = 600, bytes_a_block: int = 12_000_000) -> DataFrame:
    """Links between sets that share a list and have different labels: (a, b), enough of them to connect what is linked.

    Sets are dealt to blocks by their least key, so that likely partners are together; a least
    key of very many sets has blocks of its own number. Every two blocks that meet in a list are one group, which gets the entries and sets concerned and
    tries its pairs where they are. No pair becomes a row unless it is a link.
    """
    mixed = materialize(told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"))
    some = materialize(told.join(mixed, "key"))
    nodes = some.groupBy("sid").agg(F.min("key").alias("least"), F.first("n").alias("n"))
    placed = materialize(some.join(_blocks(nodes, nodes_a_block, bytes_a_block), "sid"))
    met = materialize(placed.groupBy("key").agg(F.collect_set("block").alias("blocks")))
    own, other = F.col("block"), F.explode("blocks").alias("other")
    met_by = placed.join(met, "key").select("key", "sid", "n", "label", "block", other)
    group = [F.least(own, F.col("other")).alias("g"), F.greatest(own, F.col("other")).alias("h")]
    dealt = met_by.select(*group, "key", "sid")
    wanted = met_by.select(*group, F.col("sid").alias("node"), "n", "label", "block").distinct().join(sets.select(F.col("sid").alias("node"), "elements"), "node").withColumnsRenamed({"g": "g2", "h": "h2"})

    def run(entries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _linked_in_group(entries, held, percent)

    return dealt.groupBy("g", "h").cogroup(wanted.groupBy("g2", "h2")).applyInPandas(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(sid, label): the smallest name reachable, for every name that stands in an edge (a, b).

    Each round takes the least label among neighbours and then that label's own; joins are on
    written tables, so that a name with very many edges can be split.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")))
    labels = materialize(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("sid").alias("b"), "label"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("sid").alias("label"), F.col("label").alias("up"))
        jumped = labels.join(up, "label", "left").join(near, "sid")
        labels = materialize(jumped.select("sid", F.least("label", "near", F.coalesce("up", "label")).alias("label"), F.col("label").alias("old")))
        if labels.filter("label <> old").isEmpty():
            return labels.select("sid", "label")
        labels = labels.select("sid", "label")


def _classes(docs: DataFrame, percent: int, words: int, hub_rounds: int, scratch: Scratch) -> DataFrame:
    """(doc_id as text, h, n, sid, label) of every row (doc_id, text): h is a hash of the text, label names its class; both null for an empty set."""
    sizes = Sizes(percent)
    have, elements = _size_counts(docs, words)
    boundary = choose_boundary(have, sizes)
    buckets = max(2 * partitions(docs.sparkSession), elements // 2_000_000)
    every = scratch.keep(_shared_entries(_postings(docs, words, sizes, boundary, buckets)))
    rows = every.filter("length = 0").select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    told = scratch.keep(_rarest(every.filter("length > 0").select("key", "sid", "n", "length"), percent).withColumn("label", F.col("sid")))
    candidates = materialize(rows.join(told.select("sid").distinct(), "sid").groupBy("sid").agg(F.min("h").alias("h")))
    sets = scratch.keep(_whole_sets(docs, candidates, words))
    fits = (F.col("n") * percent <= F.col("hub_n") * 100) & (F.col("hub_n") * percent <= F.col("n") * 100)

    found = []
    for turn in range(hub_rounds):
        hub = F.min_by(F.struct(F.col("sid").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label")), F.xxhash64("sid", F.lit(turn)))
        hubs = told.groupBy("key").agg(hub.alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key", "h.*")
        tries = told.join(materialize(hubs), "key").filter("label <> hub_label").filter(fits)
        best = tries.groupBy("sid", "hub").agg(F.count("*").alias("c"), F.first("hub_label").alias("hub_label")).groupBy("sid").agg(F.max_by(F.struct("hub", "hub_label"), F.struct("c", "hub")).alias("h"))
        best = materialize(best.select("sid", "h.*"))
        linked = materialize(_verified(best.select(F.col("sid").alias("a"), F.col("hub").alias("b")), sets, percent))
        found.append(linked)
        # who is linked takes the hub's label: of equal labels all are connected
        new = materialize(linked.select(F.col("a").alias("sid")).join(best, "sid").select("sid", F.col("hub_label").alias("new")))
        told = scratch.keep(told.join(new, "sid", "left").select("key", "sid", "n", F.coalesce("new", "label").alias("label")))
    found.append(materialize(_across(told, sets, percent)))
    labels = components(reduce(DataFrame.union, found))
    classes = scratch.keep(rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    scratch.drop(*range(scratch.count - 1))
    return classes


def jaccard_components(docs: DataFrame, percent: int = 80, words: int = 5, hub_rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two rows link when the Jaccard similarity of their sets of `words`-word shingles is percent
    / 100 or more; component_id is the smallest doc_id reachable by links. Null or empty texts
    have empty sets and are linked with nothing, nor is a null id's row named by itself; rows
    that repeat a text are one node. Other columns are not read. `hub_rounds` changes cost,
    never results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _classes(texts, percent, words, hub_rounds, Scratch(docs.sparkSession)).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), "label")
    least = materialize(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    # most classes have one row: only those of larger ones meet the others
    alone = F.when(F.col("label").isNull() | ~F.col("found"), F.col("doc_id")).otherwise(F.col("component_id"))
    whole = rows.join(least.withColumn("found", F.lit(True)), "label", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return whole.select("doc_id", "n_shingles", alone.alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class one row, all its columns: the one with the smallest id, a null id last.

    Rows with empty sets stay. Of rows that are equal in id and text all stay or all go.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _classes(texts, percent, words, 1, Scratch(docs.sparkSession)).filter("label is not null").select(F.col("doc_id").cast(kind).alias("near_id"), F.col("h").alias("near_text"), "label")
    first = F.min(F.struct(F.col("near_id").isNull().alias("no_id"), F.col("near_id").alias("i"), F.col("near_text").alias("t")))
    kept = materialize(rows.groupBy("label").agg(first.alias("kept"), F.count("*").alias("c")).filter("c > 1").select("label", "kept.i", "kept.t"))
    gone = materialize(rows.join(kept, "label").filter(~(F.col("near_id").eqNullSafe(F.col("i")) & (F.col("near_text") == F.col("t")))).select("near_id", "near_text").distinct())
    held = packed(docs, i=docs[f"`{id_col}`"], t=F.xxhash64(docs[f"`{text_col}`"]))
    return held.join(gone, F.col("i").eqNullSafe(F.col("near_id")) & (F.col("t") == F.col("near_text")), "left_anti").select("row.*")
