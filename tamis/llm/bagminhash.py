"""Near-duplicate classes: BagMinHash signatures of word-shingle multisets, banding, exact verification.

A document's weights are the counts of its shingles of five words (runs of lower-cased A-Z, 0-9 and non-ASCII
characters). For each shingle and each dyadic level of weight, [0,1), [1,2), [2,4), ..., a seeded Poisson process of
the level's width yields points in order of time, each with a slot and a place inside the level; points placed above
the shingle's weight are thinned out, and a slot keeps its earliest time. Two multisets agree in a slot with the
probability of their weighted Jaccard similarity, whatever their sizes, and a process stops as soon as its time
passes the document's latest slot. Slots are cut into bands; texts that agree in a band are candidates.

Texts of the same words are one node, so copies never multiply. Links of similarity >= 0.8 are verified on the
multisets themselves, and connected components are taken by alternating stars, or on the driver where the links are
few (FEW_LINKS). In every bucket the member that agrees
most with others is the centre, and each other member is verified against it, a pair at most once whatever the number
of shared buckets. Only buckets whose other members are then of several components need more work, one bucket for all
that hold the same members: members outside the largest component are held in runs of bounded size while all stream
past. That comparison forms no pairs: sizes and signatures rule most of them out, the rest are verified there and then,
and only links come out. What is lost is what banding misses (at similarity 0.8 a pair shares a band with probability
0.9994) and pairs whose signatures agree six deviations too little (one in a thousand million).

Result: one row per document with the least id of its class. A document without words, or of fewer than four shingles
and no copy, is a class of its own (each such row; with a null id its class is null). Null ids join classes and sort
after others. Repeated rows stay repeated. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import discard, free_name, materialize
from tamis.llm.decontaminate import words_of

SHINGLE = 5
BANDS, BAND_ROWS = 40, 8
#: Members of one centre that one verification run is meant to hold.
MEMBERS_PER_RUN = 500
#: Least share of equal slots: six deviations below the similarity.
LEAST_ESTIMATE = 0.8 - 6 * (0.8 * 0.2 / (BANDS * BAND_ROWS)) ** 0.5
#: Members and shingles that one comparison run holds, and members that stream past it.
RUN_HELD, RUN_SHINGLES, RUN_PASSING = 1_500, 1_500_000, 50_000
#: Sets of keys of up to this size are sent to every executor instead of shuffling texts.
BROADCAST_KEYS = 200_000
#: Up to so many links (8 MB of keys) are joined to components on the driver; alternating stars take any number.
FEW_LINKS = 250_000
#: Text and documents that are hashed at a time.
BATCH_BYTES, BATCH_DOCS = 1_000_000, 4_000
#: Keys with more than one in so many rows are hot: there are few, and their rows stay where they are in joins.
HOT_SHARE = 1_000

_U, _MASK = np.uint64, (1 << 64) - 1
_GOLDEN, _BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN) | _U(1)


class _Powers:
    """_BASE ** k and its inverse modulo 2 ** 64, grown as needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            one = np.ones(1, dtype=np.uint64)
            cls.up = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([one, np.full(size - 1, inverse)]), dtype=np.uint64)
        return cls.up, cls.down


def normalise(text: str | None) -> bytes:
    return b" ".join(words_of(text))


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts (normalised), and each hash's text. A text of fewer words is one shingle."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    up, down = _Powers.get(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], dtype=np.uint64, out=sums[1:])
    stops = np.flatnonzero((buffer == 32) | (buffer == 10))  # end of each word
    text_of = np.cumsum(buffer[stops] == 10) - (buffer[stops] == 10)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    if not len(stops):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(text_of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(len(stops))
    place = at - first[text_of]
    begins = (place + size <= count[text_of]) | (place == 0)
    begins &= stops[first[text_of] + count[text_of] - 1] > starts[first[text_of]]  # not the empty text
    at = at[begins]
    last = np.minimum(at + size, first[text_of[at]] + count[text_of[at]]) - 1
    s, e = starts[at], stops[last]
    return _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), text_of[at]


def signatures(hashes: np.ndarray, text_of: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots earliest times of the thinned Poisson processes; infinite where a text has no shingle."""
    key = _mix(hashes + text_of.astype(np.uint64) * _GOLDEN)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.concatenate([new, [len(key)]])).astype(np.float64)
    h, d = hashes[order[new]], text_of[order[new]]
    parts, level = [], 0
    while True:  # level k >= 1 is [2 ** (k - 1), 2 ** k)
        low = 0.0 if level == 0 else 2.0 ** (level - 1)
        inside = weight > low if level else np.ones(len(h), dtype=bool)
        if not inside.any():
            break
        parts.append((_mix(h[inside] + _U((level + 1) * int(_GOLDEN) & _MASK)), d[inside], weight[inside], np.full(inside.sum(), low), np.full(inside.sum(), max(1.0, low))))
        level += 1
    earliest = np.full((n, slots), np.inf)
    if not parts:
        return earliest
    state, d, weight, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    t, latest, flat = np.zeros(len(d)), np.full(n, np.inf), earliest.reshape(-1)
    while len(d):
        state = state + _GOLDEN
        r = _mix(state)
        t = t - np.log1p(-((r >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        alive = t < latest[d]
        if not alive.all():
            state, d, weight, low, width, t, r = (x[alive] for x in (state, d, weight, low, width, t, r))
            if not len(d):
                break
        r = _mix(r ^ _BASE)
        slot = ((r >> _U(32)) * _U(slots)) >> _U(32)
        taken = low + width * ((r & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight
        np.minimum.at(flat, (d * slots + slot.astype(np.int64))[taken], t[taken])
        active = np.unique(d) if len(d) < 50 * n else np.arange(n)
        latest[active] = earliest[active].max(axis=1)
    return earliest


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash per text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, signature.shape[1] // bands)
    out = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _BASE), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = _mix(out * _GOLDEN + bits[:, :, k])
    return out.view(np.int64)


def slot_bytes(signature: np.ndarray) -> np.ndarray:
    """One byte per slot; equal slots have equal bytes, others by chance one in 256."""
    return (_mix(signature.view(np.uint64)) & _U(255)).astype(np.uint8)


def _slices(sizes: list[int]) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > BATCH_BYTES and i > start or i - start >= BATCH_DOCS:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, len(sizes))


def _sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(key, n, bands, slots): key digests the words; n counts shingles; the rest is null below four."""
    for batch in batches:
        out = [pd.DataFrame({c: [] for c in ("key", "n", "bands", "slots")}, dtype=object)]
        for s in _slices([len(t) if t else 0 for t in batch]):
            part = [normalise(t) for t in batch.iloc[s]]
            hashes, text_of = shingle_hashes(part)
            n = np.bincount(text_of, minlength=len(part))
            big = np.flatnonzero(n >= 4)
            index = np.full(len(part), -1)
            index[big] = np.arange(len(big))
            keep = n[text_of] >= 4
            bands: list = [None] * len(part)
            slots: list = [None] * len(part)
            signature = signatures(hashes[keep], index[text_of[keep]], len(big), BANDS * BAND_ROWS)
            for i, b, x in zip(big, band_hashes(signature), slot_bytes(signature), strict=True):
                bands[i], slots[i] = b, x.tobytes()
            out.append(pd.DataFrame({"key": [xxhash.xxh3_128_digest(t) if t else None for t in part], "n": n.astype(object), "bands": bands, "slots": slots}))
        yield pd.concat(out, ignore_index=True).astype({"n": "int64"})


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [normalise(t) for t in batch]
        yield pd.DataFrame({"key": [xxhash.xxh3_128_digest(t) for t in words], "words": words})


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets (sorted values, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def similar(common: int, n: int, m: int) -> bool:
    """Weighted Jaccard similarity of 0.8 or more, in integers."""
    return 9 * common >= 4 * (n + m)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (centre, run, member, words) in order, the centre's own row (member null) first; yields links."""
    now, held = None, None
    for batch in batches:
        words = [bytes(w) for w in batch["words"]]
        for s in _slices([len(w) for w in words]):
            hashes, text_of = shingle_hashes(words[s])
            cuts = np.searchsorted(text_of, np.arange(len(words[s]) + 1))
            out = []
            for i, (centre, member) in enumerate(zip(batch["centre"].iloc[s], batch["member"].iloc[s], strict=True)):
                bag = np.unique(hashes[cuts[i] : cuts[i + 1]], return_counts=True)
                size = int(cuts[i + 1] - cuts[i])
                if member is None:
                    now, held, held_size = centre, bag, size
                elif centre == now and similar(overlap(held, bag), held_size, size):
                    out.append((centre, member))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=object)


def verified(pairs: DataFrame, texts: DataFrame, members_per_run: int = MEMBERS_PER_RUN) -> DataFrame:
    """The pairs (centre, member) whose multisets are similar, as (a, b). A centre's members are dealt over runs, each
    of which gets the centre's text once."""
    sizes = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("_n")).select("centre", F.ceil(F.col("_n") / members_per_run).cast("int").alias("runs"))
    members = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("member"), F.col("runs")).cast("int").alias("run"), "member")
    members = members.join(texts.withColumnRenamed("key", "member"), "member").select("centre", "run", "member", "words")
    centres = sizes.join(texts.withColumnRenamed("key", "centre"), "centre").select("centre", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("binary").alias("member"), "words")
    rows = centres.unionByName(members).repartition("centre", "run").sortWithinPartitions("centre", "run", F.col("member").asc_nulls_first())
    return rows.mapInPandas(_verify, "a binary, b binary")


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row per key and the number _n of its rows. Keys of more than one
    in HOT_SHARE of the `total` rows, fewer than HOT_SHARE of them, are sent to the rows, the others shuffled."""
    hot = F.col("_n") * HOT_SHARE > total
    sent = keyed.filter(hot).drop("_n").withColumn("_hot", F.lit(True))
    apart = rows.join(F.broadcast(sent), key, "left")
    columns = [*rows.columns, *(c for c in keyed.columns if c not in (key, "_n"))]
    cold = apart.filter("_hot is null").select(*rows.columns).join(keyed.filter(~hot).drop("_n"), key)
    return apart.filter("_hot").select(*columns).unionByName(cold.select(*columns))


def least_of_component(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the connected component of each of n nodes, for links u > v: trees are hooked to the least
    neighbouring root and flattened, until every link is inside one tree."""
    top = np.arange(n)
    while len(u):
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
        while ((up := top[top]) != top).any():
            top = up
        u, v = top[u], top[v]
        u, v = u[u != v], v[u != v]
    return top


def _few_components(edges: DataFrame) -> DataFrame:
    """(key, comp) of a bounded number of edges (u, v), on the driver."""
    got = edges.toArrow()
    ends = pa.concat_arrays([c.cast(pa.binary()) for name in ("u", "v") for c in got[name].chunks])
    coded = ends.dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()  # bytes in order, as in Spark
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    node = rank[coded.indices.to_numpy()]
    top = least_of_component(*np.split(node, 2), len(names))
    names = names.take(pa.array(order))
    return edges.sparkSession.createDataFrame(pa.table({"key": names, "comp": names.take(pa.array(top))}))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(key, comp): the least key of the connected component of every key in `links`, as a table. Up to FEW_LINKS links
    are joined on the driver, more by alternating large and small stars; a hub's rows are pre-aggregated and stay where
    they are."""
    flat = links.filter(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    edges = materialize(flat, "links")
    seen = state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if 0 < state[0] <= FEW_LINKS:
        out = materialize(_few_components(edges), "components")
        discard(edges)
        return out
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = join_hot(both.filter(F.col("v") > F.col("u")), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = join_hot(large, least, "u", state[0]).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges, large)
        edges = now
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    tops = edges.select(F.col("v").alias("key")).distinct()
    out = materialize(edges.select(F.col("u").alias("key"), F.col("v").alias("comp")).unionByName(tops.select("key", F.col("key").alias("comp"))), "components")
    discard(edges)
    return out


def _mixed(others: DataFrame, comps: DataFrame) -> DataFrame:
    """(hash, key, n, comp): of the buckets whose members besides the centre are of several components, one of each set
    of members."""
    rows = others.select("hash", "key", "n").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    marks = (F.min(F.xxhash64("comp")).alias("lo"), F.max(F.xxhash64("comp")).alias("hi"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"), F.count(F.lit(1)).alias("size"))
    several = rows.groupBy("hash").agg(*marks).filter("lo != hi").groupBy("x", "y", "size").agg(F.min("hash").alias("hash"))
    several = materialize(several.select("hash"), "several")
    out = materialize(rows.join(several, "hash"), "mixed")
    discard(several)
    return out


def bags(words: list[bytes]) -> list[np.ndarray]:
    """The shingle multisets as sorted sets: an element's k-th occurrence is an element of its own."""
    hashes, text_of = shingle_hashes(words)
    order = np.lexsort((hashes, text_of))
    h, t = hashes[order], text_of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    coded, cuts = h + nth.astype(np.uint64) * _GOLDEN, np.searchsorted(t, np.arange(len(words) + 1))
    return [np.sort(coded[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def shared_elements(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a):
        return 0
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


class _Run:
    """The held members of a bucket's run, and which components it has found to be one."""

    def __init__(self, held: pd.DataFrame):
        self.keys, self.comps, self.n = (held[c].to_numpy() for c in ("key", "comp", "n"))
        self.slots = np.frombuffer(b"".join(held["slots"]), np.uint8).reshape(len(held), -1)
        self.bags = [b for s in _slices([len(w) for w in held["words"]]) for b in bags(held["words"].iloc[s].tolist())]
        self.top: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (up := self.top.get(x, x)) != x:
            x = up
        return x

    def links(self, passing: pd.DataFrame, cells: int = 100_000) -> list[tuple[bytes, bytes]]:
        """Verified links to passing members of other components; the likeliest first, none between what is one already."""
        other = np.frombuffer(b"".join(passing["slots"]), np.uint8).reshape(len(passing), -1)
        keys, comps, m, minor, words = (passing[c].to_numpy() for c in ("key", "comp", "n", "minor", "words"))
        step, width, out = max(1, cells // len(self.keys)), self.slots.shape[1], []
        for at in range(0, len(passing), step):
            equal = np.count_nonzero(self.slots[:, None, :] == other[None, at : at + step, :], axis=2)
            size = m[at : at + step]
            i, j = np.nonzero((equal >= width * (LEAST_ESTIMATE * 255 / 256 + 1 / 256)) & (5 * self.n[:, None] >= 4 * size[None]) & (5 * size[None] >= 4 * self.n[:, None]))
            share, j = equal[i, j], j + at
            apart = (self.comps[i] != comps[j]) & (~minor[j].astype(bool) | (self.keys[i] < keys[j]))
            i, j, share = i[apart], j[apart], share[apart]
            known: dict[int, np.ndarray] = {}
            for k in np.argsort(-share, kind="stable"):
                a, b = int(i[k]), int(j[k])
                x, y = self.find(self.comps[a]), self.find(comps[b])
                if x == y:
                    continue
                if b not in known:
                    known[b] = bags([words[b]])[0]
                if similar(shared_elements(self.bags[a], known[b]), int(self.n[a]), int(m[b])):
                    out.append((self.keys[a], keys[b]))
                    self.top[max(x, y)] = min(x, y)
        return out


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (hash, run, side, key, comp, n, slots, minor, words), held ones (side 0) first; yields verified links."""
    now: tuple | None = None
    held: list = []
    run: _Run | None = None
    for batch in batches:
        group = list(zip(batch["hash"], batch["run"], strict=True))
        side, at, out = batch["side"].to_numpy(), 0, []
        while at < len(group):
            end = at
            while end < len(group) and group[end] == group[at] and side[end] == side[at]:
                end += 1
            if group[at] != now:
                now, held, run = group[at], [], None
            if side[at] == 0:
                held.append(batch.iloc[at:end])
            elif held:
                run = run or _Run(pd.concat(held))
                out += run.links(batch.iloc[at:end])
            at = end
        yield pd.DataFrame(out, columns=["a", "b"], dtype=object)


def compare_buckets(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) between members of different components of a bucket; rows are (hash, key, n, comp). Members
    outside the bucket's largest component are held in runs of bounded size; all members stream past each run."""
    sizes = rows.groupBy("hash", "comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.groupBy("hash").agg(F.max(F.struct("members", "shingles", "comp")).alias("top"), F.sum("members").alias("total"), F.sum("shingles").alias("all"))
    blocks = F.greatest((F.col("total") - F.col("top.members")) / RUN_HELD, (F.col("all") - F.col("top.shingles")) / RUN_SHINGLES)
    sizes = materialize(sizes.select("hash", F.col("top.comp").alias("major"), F.ceil(blocks).cast("int").alias("blocks"), F.ceil(F.col("total") / RUN_PASSING).cast("int").alias("salts")), "sizes")
    rows = rows.join(sizes, "hash").withColumn("minor", F.col("comp") != F.col("major"))
    block, salt = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ("hash", "run", "side", "key", "comp", "n", "minor")
    held = rows.filter("minor").withColumn("_k", each(F.col("salts"))).withColumns({"run": block * F.col("salts") + F.col("_k"), "side": F.lit(0)}).select(*columns)
    passing = rows.withColumn("_k", each(F.col("blocks"))).withColumns({"run": F.col("_k") * F.col("salts") + salt, "side": F.lit(1)}).select(*columns)
    full = nodes.select("key", "slots").join(texts, "key")
    runs = held.unionByName(passing).join(full, "key").repartition("hash", "run").sortWithinPartitions("hash", "run", "side")
    return runs.select("hash", "run", "side", "key", "comp", "n", "slots", "minor", "words").mapInPandas(_compare, "a binary, b binary")


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, key, n, bands, slots) of every document, as a table; print is a fingerprint of the row's text."""
    signed = F.pandas_udf(_sign, "key binary, n long, bands array<long>, slots binary").asNondeterministic()
    return materialize(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), signed(F.col(text_col)).alias("s")).select("id", "print", "s.*"), "signed")


def _node_texts(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, words) of the members (key, id): found by id, where their number is bounded without moving texts."""
    n = members.count()
    small = n <= BROADCAST_KEYS
    bound = F.broadcast if small else (lambda x: x)
    ids = bound(members.select(F.col("id").alias("_need")).distinct())
    words = F.pandas_udf(_texts, "key binary, words binary").asNondeterministic()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("_need")), "left_semi").select(words("text").alias("t")).select("t.*")
    return materialize(found.join(bound(members.select("key")), "key", "left_semi").dropDuplicates(["key"]), "texts")


def link_components(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, comp) of the word sequences that have a similar other one."""
    first = signed.filter("bands is not null").groupBy("key").agg(F.min("id").alias("id"))
    banded = signed.filter("bands is not null").select("key", "n", "bands").dropDuplicates(["key"]).select("key", "n", F.explode("bands").alias("hash"))
    shared = banded.groupBy("hash").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = materialize(banded.join(shared, "hash"), "buckets")
    popular = materialize(buckets.groupBy("key").agg(F.sum("size").alias("agrees")), "popular")
    members = materialize(first.join(popular.select("key"), "key", "left_semi"), "members")
    texts = _node_texts(docs, members, id_col, text_col)

    ranked = buckets.select("hash", "key").join(popular, "key").groupBy("hash").agg(F.max(F.struct("agrees", "key")).alias("c"))
    centres = materialize(ranked.select("hash", F.col("c.key").alias("centre")), "centres")
    others = materialize(buckets.select("hash", "key", "n").join(centres, "hash").filter("key != centre"), "others")
    discard(buckets, centres)
    links = materialize(verified(others.select("centre", F.col("key").alias("member")).distinct(), texts), "verified")
    comps = components(links)
    rows = _mixed(others, comps)
    discard(others)
    if not rows.isEmpty():
        nodes = signed.join(popular.select("key"), "key", "left_semi").select("key", "slots").dropDuplicates(["key"])
        discard(comps)
        more = materialize(compare_buckets(rows, nodes, texts), "compared")
        comps = components(links.unionByName(more))
        discard(more)
    discard(links, rows, texts, popular, members)
    return comps


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, first, print) of every document; first marks the rows of the class's least (id, text
    fingerprint), print is that fingerprint."""
    signed = sign(docs, id_col, text_col)
    comps = link_components(docs, signed, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("print").alias("print"))
    of_key = signed.filter("key is not null").groupBy("key").agg(F.min(rank).alias("least"))
    of_key = of_key.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    of_comp = of_key.groupBy("comp").agg(F.min("least").alias("head"))
    named = of_key.join(of_comp, "comp").select("key", "head")
    found = signed.select("id", "print", "key").join(named, "key", "left")
    alone = F.col("key").isNull()
    return found.select(
        F.col("id").alias("id"), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        (alone | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("print") == F.col("head.print")))).alias("first"), "print",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` per class, with its columns: the one of the least id; rows that repeat id and text count once."""
    found = materialize(classes(docs, id_col, text_col).filter("first").groupBy("id", "print").agg(F.count(F.lit(1)).alias("n")), "heads")
    own, mark = free_name("_id", docs), free_name("_print", docs)
    found = found.select(F.col("id").alias(own), F.col("print").alias(mark), F.col("n").alias("_n"))
    same = docs[id_col].eqNullSafe(found[own]) & (F.xxhash64(docs[text_col]) == found[mark])
    kept = docs.join(found.filter("_n = 1"), same, "left_semi")
    repeated = found.filter("_n > 1")
    if not repeated.isEmpty():
        print_ = free_name("_p", docs)
        kept = kept.unionByName(docs.join(repeated, same, "left_semi").withColumn(print_, F.xxhash64(text_col)).dropDuplicates([id_col, print_]).drop(print_))
    return kept.select(*docs.columns)
