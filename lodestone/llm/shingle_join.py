"""Jaccard similarity join on word shingles, by prefix filters under three global orders.

1. Shingles become 64-bit hashes. Texts with the same set share a key and are one node.
2. The nodes' hashes meet in ranges of the hash space, which gives every hash its number of nodes.
   Hashes that a bounded sample shows to be in very many nodes don't meet there: they rank last
   together, and are dealt out by node. A hash of one node can't be in an intersection, so a node
   with too few shared hashes for the threshold has no partner and drops out.
3. Three total orders put a node's own hashes first, then the shared ones: by ascending number of
   nodes, by ascending hash, by descending hash. Two similar sets share a hash within their prefixes
   under each order, so all links lie inside the components that the first order's prefixes make.
   Where such a component is large, the second order's prefixes cut it, then the third's, until none
   changes. Only narrow rows take part: a node's hashes stay where they are.
4. A component's sets then meet in one task. A node asks an index of the prefixes under each order;
   candidates are in all three answers and fit by size, and only they are intersected. Nodes of the
   largest group found so far needn't ask, which leaves the components exact.
5. A component that is still too large for a task goes through it in blocks that share some pivots;
   then the nodes outside its commonest label ask all its blocks in the same way.

Hashes travel as packed blocks, not as rows: seven bytes a hash and twenty a node and range. Two
texts of a thousand shingles are linked or missed wrongly only if hashes of 59 bits and more of
theirs collide, which has a chance below 1e-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, hash_sample, row_key, salted_lookup, staying_rows

WORDS = 5
SIMILARITY = 75  # in hundredths
HASHES_PER_RANGE = 2_000_000
LEAST_RANGES = 8
_BLOCK_HASHES, _BLOCK_NODES, _MEMORY = 500_000, 4_096, 100_000
#: Nodes to a file of narrow rows (node, label): some dozen bytes each.
_NODES_PER_FILE = 500_000
#: Bytes of a hash that travel; the range holds the first bits.
_WIDTH = 7
_SALTS = 64
#: A component of up to so many nodes and hashes meets in one task; larger ones go in blocks of them.
CLUSTER_NODES, CLUSTER_HASHES = 2_000, 1_000_000
PIVOTS = 24
#: Hashes of at least HOT_NODES of a sample of SAMPLE_NODES nodes are dealt out by node; at most HOT.
SAMPLE_NODES, HOT_NODES, HOT = 8_192, 16, 65_536
_LAST = 255
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; remembers words' hashes within bounds."""

    def __init__(self, words: int = WORDS):
        self.words, self.memory = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
        if not words:
            return np.empty(0, np.uint64)
        memory = self.memory
        if len(memory) > _MEMORY:
            memory.clear()
        for w in set(words):
            if w not in memory:
                memory[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _mixed(out + h[i : i + n] * _MULTIPLIERS[i % 5] + np.uint64(i))
        return np.unique(out)


def node_key(hashes: np.ndarray) -> bytes:
    """Sixteen bytes: a digest of the set, and its size."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=12).digest() + len(hashes).to_bytes(4, "little")


def least_shared(n, similarity: int = SIMILARITY):
    """Shingles of a set of n that a partner must share."""
    return -(-similarity * n // 100)


def _slices(batches, size: int = 256) -> Iterator[list[list]]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            yield [part.column(k).to_pylist() for k in range(part.num_columns)]


def _sizes(words: int):
    def run(batches):
        shingle = Shingler(words)
        for docs, ties, texts in _slices(batches):
            sets = [shingle(t) for t in texts]
            sizes, keys = [len(s) for s in sets], [node_key(s) for s in sets]
            columns = [pa.array(c, pa.int64()) for c in (docs, ties, sizes)] + [pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "n_shingles", "key"])

    return run


def _hashes(words: int):
    """Rows (key, hash) of the distinct nodes of a partition."""

    def run(batches):
        shingle, seen = Shingler(words), set()
        for (texts,) in _slices(batches):
            for t in texts:
                s = shingle(t)
                if len(s) and (key := node_key(s)) not in seen:
                    seen.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(s), pa.binary()), pa.array(s.view(np.int64))], names=["key", "hash"])

    return run


def hot_hashes(texts: DataFrame, sizes: DataFrame, words: int) -> np.ndarray:
    """Hashes that many nodes of a bounded sample hold, ascending: at most HOT of them.

    The choice moves load between tasks and places hashes in the first order; no result hangs on it.
    """
    nodes = sizes.where("n_shingles > 0").groupBy("key").agg(F.min("tie").alias("tie"))
    # At most SAMPLE_NODES rows: small enough to broadcast by construction.
    chosen = hash_sample(nodes, SAMPLE_NODES, "key").select("tie")
    sample = texts.join(F.broadcast(chosen), "tie").select("text").mapInArrow(_hashes(words), "key binary, hash long")
    held = sample.distinct().groupBy("hash").count().where(F.col("count") >= HOT_NODES)
    found = [r["hash"] for r in held.orderBy(F.desc("count"), "hash").limit(HOT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _home(keys: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of each node, from its key as rows of sixteen bytes."""
    k = keys.astype(np.int64)
    return (k[:, 0] << 16 | k[:, 1] << 8 | k[:, 2]) % homes


def _payload(keys: np.ndarray, owner: np.ndarray, data: np.ndarray) -> bytes:
    """Nodes, their counts and their rows of data, which are in order of owner."""
    counts = np.bincount(owner, minlength=len(keys))
    held = np.flatnonzero(counts)
    return len(held).to_bytes(4, "little") + keys[held].tobytes() + counts[held].astype("<u4").tobytes() + data.tobytes()


def _parsed(payload, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    keys = np.frombuffer(payload, np.uint8, 16 * n, 4).reshape(n, 16)
    counts = np.frombuffer(payload, "<u4", n, 4 + 16 * n)
    return keys, counts.astype(np.int64), np.frombuffer(payload, np.uint8, -1, 4 + 20 * n).reshape(-1, width)


def _narrow(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH]


def _wide(low: np.ndarray) -> np.ndarray:
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :_WIDTH] = low
    return out.view("<u8").ravel()


def _groups(at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions in order) of each value below n that occurs."""
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i] : cuts[i + 1]]


def _blocks(words: int, ranges: int, hot: np.ndarray):
    """Rows (range, payload): nodes' keys, their counts in the range, their hashes' low bytes. Hot
    hashes go beyond the ranges, by the bucket of the node, and have their range beside them."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def emit(keys: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(s) for s in sets])
        names = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        is_hot = np.zeros(len(hashes), bool)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
        at = (hashes >> shift).astype(np.int32) if ranges > 1 else np.zeros(len(hashes), np.int32)
        to, rows = [], []
        cold = np.flatnonzero(~is_hot)
        for r, part in _groups(at[cold], ranges):
            part = cold[part]
            to.append(r)
            rows.append(_payload(names, owner[part], _narrow(hashes[part])))
        warm = np.flatnonzero(is_hot)
        for b, part in _groups(_home(names, ranges)[owner[warm]], ranges):
            part = warm[part]
            to.append(ranges + b)
            rows.append(_payload(names, owner[part], np.column_stack([_narrow(hashes[part]), at[part].astype("<i4").view(np.uint8).reshape(-1, 4)])))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(rows, pa.binary())], names=["range", "payload"])

    def run(batches):
        shingle = Shingler(words)
        seen: dict[bytes, np.ndarray] = {}
        held = 0
        for (texts,) in _slices(batches, 64):
            for t in texts:
                s = shingle(t)
                if len(s) and (key := node_key(s)) not in seen:
                    seen[key] = s
                    held += len(s)
                    if held >= _BLOCK_HASHES or len(seen) >= _BLOCK_NODES:
                        yield emit(list(seen), list(seen.values()))
                        seen, held = {}, 0
        if seen:
            yield emit(list(seen), list(seen.values()))

    return run


def _code(count: np.ndarray) -> np.ndarray:
    """Number of nodes in a byte: as it is to 200, then by quarters of a doubling; 255 is for hot hashes."""
    far = 200 + np.minimum(54, 4 * np.log2(np.maximum(count, 200) / 200)).astype(np.int64)
    return np.where(count <= 200, count, far).astype(np.uint8)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of sixteen bytes, and which of them each row is."""
    k = keys.view("<u8").reshape(-1, 2)
    order = np.lexsort((k[:, 0], k[:, 1]))
    new = np.append(True, (k[order[1:]] != k[order[:-1]]).any(1)) if len(k) else np.empty(0, bool)
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[order[new]], which


def _shared(buckets: int):
    """Of a range: the hashes of two nodes or more, by bucket of nodes. What lies beyond the ranges is in its
    bucket already and is passed on."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        kinds = pa.schema([("bucket", pa.int32()), ("range", pa.int32()), ("payload", pa.binary())])
        if at >= buckets:
            n = table.num_rows
            return pa.table([pa.array([at - buckets] * n, pa.int32()), pa.array([-1] * n, pa.int32()), table.column("payload").cast(pa.binary())], schema=kinds)
        parsed = [_parsed(p.as_buffer(), _WIDTH) for p in table.column("payload")]
        names, which = _distinct(np.concatenate([k for k, _, _ in parsed]))
        taken = np.zeros(len(names), bool)
        hashes, owners, k = [], [], 0
        for keys, counts, low in parsed:
            node = which[k : k + len(keys)]
            own = np.repeat(~taken[node], counts)  # a set in several blocks is one node
            taken[node] = True
            k += len(keys)
            owners.append(np.repeat(node.astype(np.int32), counts)[own])
            hashes.append(_wide(low[own]))
        del parsed
        hash_, owner = np.concatenate(hashes), np.concatenate(owners)
        del hashes, owners
        order = np.argsort(hash_)
        ordered = hash_[order]
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        runs = np.diff(np.append(begins, len(ordered)))
        again = np.repeat(runs > 1, runs)
        code = np.repeat(_code(runs[runs > 1]), runs[runs > 1])
        owner, low = owner[order[again]], _narrow(ordered[again])
        by_owner = np.argsort(owner, kind="stable")
        owner, data = owner[by_owner], np.column_stack([low, code])[by_owner]
        to, rows = [], []
        for b, part in _groups(_home(names, buckets)[owner], buckets):
            to.append(b)
            rows.append(_payload(names, owner[part], data[part]))
        return pa.table([pa.array(to, pa.int32()), pa.array([at] * len(to), pa.int32()), pa.array(rows, pa.binary())], schema=kinds)

    return run


SETS = "key binary, n int, own int, hashes binary, prefix array<long>"
_KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]


def _survivors(similarity: int, ranges: int):
    """Of a bucket of nodes: those with enough shared hashes, and their prefixes under the first order."""
    shift = np.uint64(64 - ranges.bit_length() + 1)
    low_bits = np.uint64((1 << min(8 * _WIDTH, int(shift))) - 1)

    def top(at: np.ndarray) -> np.ndarray:
        return at.astype(np.uint64) << shift if ranges > 1 else np.zeros(len(at), np.uint64)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, counts, hashes, codes = [], [], [], []
        for at, payload in zip(table.column("range").to_pylist(), table.column("payload")):
            k, c, raw = _parsed(payload.as_buffer(), _WIDTH + (4 if at < 0 else 1))
            ranges_ = raw[:, _WIDTH:].copy().view("<i4").ravel() if at < 0 else np.full(len(raw), at)
            names.append(k)
            counts.append(c)
            hashes.append(_wide(raw[:, :_WIDTH]) & low_bits | top(ranges_))
            codes.append(np.full(len(raw), _LAST, np.uint8) if at < 0 else raw[:, _WIDTH])
        name, which = _distinct(np.concatenate(names))
        owner = np.repeat(which, np.concatenate(counts))
        hash_, code = np.concatenate(hashes), np.concatenate(codes)
        del names, hashes, codes
        order = np.lexsort((hash_, owner))
        owner, hash_, code = owner[order], hash_[order], code[order]
        once = np.append(True, (hash_[1:] != hash_[:-1]) | (owner[1:] != owner[:-1]))  # hot ones come from each block
        owner, hash_, code = owner[once], hash_[once], code[once]
        size = np.ascontiguousarray(name[:, 12:]).view("<u4").ravel().astype(np.int64)
        cuts = np.searchsorted(owner, np.arange(len(name) + 1))
        out: list[tuple] = []
        for i in np.flatnonzero(np.diff(cuts) >= least_shared(size, similarity)):
            h, n = hash_[cuts[i] : cuts[i + 1]], int(size[i])
            own = n - len(h)
            width = n - int(least_shared(n, similarity)) + 1 - own
            first = np.lexsort((h, code[cuts[i] : cuts[i + 1]]))[:width]
            out.append((name[i].tobytes(), n, own, h.astype("<u8").tobytes(), h[first].view(np.int64)))
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[c.split()[0] for c in SETS.split(", ")])

    return run


class _Index:
    """Tokens of several nodes, and which nodes hold given ones."""

    def __init__(self, parts: list[np.ndarray]):
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens = np.concatenate(parts)
        order = np.argsort(tokens)
        self.tokens, self.owner = tokens[order], owner[order]

    def holders(self, tokens: np.ndarray) -> np.ndarray:
        begin, end = np.searchsorted(self.tokens, tokens), np.searchsorted(self.tokens, tokens, "right")
        n = end - begin
        return self.owner[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Sets:
    """Nodes of a group: sets of n shingles, of which the shared ones are here, ascending."""

    def __init__(self, n, own, hashes: list[np.ndarray], prefixes: list[np.ndarray], similarity: int):
        self.n, self.hashes, self.similarity = np.asarray(n, np.int64), hashes, similarity
        self.shared = self.n - np.asarray(own, np.int64)
        width = self.shared - least_shared(self.n, similarity) + 1
        #: Prefixes under the three orders.
        self.prefixes = [prefixes, [h[:w] for h, w in zip(hashes, width)], [h[-w:] for h, w in zip(hashes, width)]]
        self._indexes: list[_Index] | None = None

    @staticmethod
    def of(table: pa.Table, similarity: int) -> Sets:
        n, own = (table.column(c).to_numpy() for c in ("n", "own"))
        lists = table.column("prefix").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        prefixes = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return Sets(n, own, [np.frombuffer(h.as_buffer(), "<u8") for h in table.column("hashes")], prefixes, similarity)

    def partners(self, of: Sets, i: int, among: np.ndarray) -> np.ndarray:
        """Nodes here, of those among, that are similar to the other group's node i."""
        if self._indexes is None:
            self._indexes = [_Index(p) for p in self.prefixes]
        s, n, most = self.similarity, of.n[i], np.minimum(self.shared, of.shared[i])
        maybe = among & (100 * most >= s * (self.n + n - most)) & (100 * np.minimum(self.n, n) >= s * np.maximum(self.n, n))
        for index, prefix in zip(self._indexes, of.prefixes):
            held = np.zeros(len(self.n), bool)
            held[index.holders(prefix[i])] = True
            maybe &= held
        found = np.flatnonzero(maybe)
        if not len(found):
            return found
        mine, sizes = of.hashes[i], self.shared[found]
        theirs = np.concatenate([self.hashes[j] for j in found])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        both = np.bincount(np.repeat(np.arange(len(found)), sizes), hit, len(found)).astype(np.int64)
        return found[100 * both >= s * (self.n[found] + n - both)]


def components_within(sets: Sets) -> np.ndarray:
    """For each node the first node of its component.

    The node with the fewest own shingles asks first. Of two linked nodes of different components one
    at least is outside the largest, so when all of those have asked, no link is left unseen.
    """
    k = len(sets.n)
    label, asked = np.arange(k), np.zeros(k, bool)
    turn = np.argsort(1 - sets.shared / sets.n, kind="stable")
    while True:
        main = np.bincount(label, minlength=k).argmax()
        rest = turn[~asked[turn] & (label[turn] != main)]
        if not len(rest):
            return label
        i = rest[0]
        asked[i] = True
        found = sets.partners(sets, i, label != label[i])
        if len(found):
            joined = np.append(label[found], label[i])
            label[np.isin(label, joined)] = joined.min()


def _runs(batches, column: str) -> Iterator[pa.Table]:
    """Tables of the rows that share a value, which lie together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        value = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1), len(value)] if len(value) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and value[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value[a]
    if held:
        yield pa.Table.from_batches(held)


LABELS = "node long, label long"


def _labelled(column: str, similarity: int):
    """(node, label) of components within each run of rows; label is the component's smallest node."""

    def run(batches):
        nodes, labels = [], []
        for table in _runs(batches, column):
            node = table.column("node").to_numpy()
            first = components_within(Sets.of(table, similarity))
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, first, node)
            nodes.append(node)
            labels.append(least[first])
            if len(nodes) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(labels))], names=["node", "label"])
                nodes, labels = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(labels))], names=["node", "label"])

    return run


def _asked(similarity: int):
    """Links (a, b) between labels: those of a block's asking nodes and of the nodes that answer."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        links: set[tuple[int, int]] = set()
        asks = np.array(table.column("asks").to_pylist(), bool)
        asking, answers = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if asking.num_rows and answers.num_rows:
            mine, theirs = Sets.of(asking, similarity), Sets.of(answers, similarity)
            a, b = asking.column("label").to_numpy(), answers.column("label").to_numpy()
            known: dict[int, set[int]] = {}
            for i, me in enumerate(a.tolist()):
                seen = known.setdefault(me, {me})
                for x in np.unique(b[theirs.partners(mine, i, ~np.isin(b, list(seen)))]).tolist():
                    seen.add(x)
                    links.add((min(x, me), max(x, me)))
        rows = sorted(links)
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    return run


def components(links: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node of its component.

    Rounds of the smallest neighbouring label and of label-of-label, each a written table; a round's
    table replaces the one before. Hubs are join keys of one row against many, which adaptive
    execution splits, and are pre-aggregated before they are shuffled.
    """
    both = scratch.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", files)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = scratch.write(labels, "labels", files)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("top"))
        moved = scratch.write(hooked.join(up, "to").select("node", "was", F.col("top").alias("label")), "labels", files)
        labels = moved.select("node", "label")
        if not moved.where("was <> label").limit(1).count():
            scratch.drop("links")
            return labels


def stars(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Links (a, b) of each node in a bucket with the bucket's least node."""
    first = buckets.groupBy(*by).agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a <> _last").drop("_last")
    return buckets.join(first, by).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _prefixes(order: int, similarity: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = pa.Table.from_batches([batch.slice(i, 1_000)])
                found = Sets.of(part, similarity).prefixes[order]
                sizes = [len(p) for p in found]
                columns = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "label")] + [np.concatenate(found).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "label", "hash"])

    return run


class _Clusters:
    """Members (node, label, n) of components of candidates, apart by whether a component fits a task."""

    def __init__(self, members: DataFrame, scratch: Scratch, files: int, turn: int = 0):
        size = members.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("hashes")).where("nodes > 1")
        large = (F.col("nodes") > CLUSTER_NODES) | (F.col("hashes") > CLUSTER_HASHES)
        placed = scratch.write(members.join(size, "label").withColumn("large", large), f"members-{turn}", files)
        self.small, self.large = placed.where("not large"), placed.where("large")
        self.count = self.large.select("label").distinct().count()


def _cut(members: DataFrame, sets: DataFrame, order: int, similarity: int, scratch: Scratch, files: int) -> DataFrame:
    """members (node, label, n) with their components cut by the prefixes under an order."""
    tokens = members.select("node", "label").join(sets.drop("key"), "node").mapInArrow(_prefixes(order, similarity), "node long, label long, hash long")
    parts = components(scratch.write(stars(tokens, ["label", "hash"]), "stars", files), scratch, files).withColumnRenamed("label", "_new")
    return members.select("node", "n").join(parts, "node").select("node", F.col("_new").alias("label"), "n")


def _in_blocks(members: DataFrame, sets: DataFrame, similarity: int, scratch: Scratch, files: int) -> DataFrame:
    """(node, label) of the nodes of large components, exactly.

    Each block of a component finds its own components together with some pivots, nodes that all its
    blocks hold. Of two linked nodes that are still apart, one at least has another label than the
    component's commonest: those ask every block. No pair of nodes is a row.
    """
    cluster = F.col("label").alias("cluster")
    parts = lambda nodes, hashes: F.ceil(F.greatest(F.col(nodes) / CLUSTER_NODES, F.col(hashes) / CLUSTER_HASHES)).cast("long")
    hashed = F.xxhash64(F.lit(3), "node")
    # A node's own hash makes it a pivot, PIVOTS of each component on average.
    pivot = F.pmod(hashed, F.lit(1 << 40)) < PIVOTS / F.col("nodes") * (1 << 40)
    part = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.lit(4), "node"), F.col("_parts"))))
    dealt = members.withColumn("_parts", parts("nodes", "hashes")).select("node", cluster, F.explode(part).alias("_part"))
    block = F.xxhash64("cluster", "_part").alias("block")
    grouped = dealt.select("node", block).join(sets.drop("key"), "node").repartition("block").sortWithinPartitions("block")
    local = scratch.write(grouped.mapInArrow(_labelled("block", similarity), LABELS).where("node <> label").distinct(), "stars")
    found = components(local.select(F.col("label").alias("a"), F.col("node").alias("b")), scratch, files)
    placed = members.select("node", cluster, "n", "nodes", "hashes").join(found, "node", "left")
    placed = scratch.write(placed.withColumn("label", F.coalesce("label", "node")), "blocks", files)
    by_label = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"))
    main = by_label.groupBy("cluster").agg(
        F.max_by("label", F.struct("_k", "label")).alias("_main"), F.sum("_k").alias("_all"),
        (F.sum("_k") - F.max("_k")).alias("_askers"), (F.sum("_n") - F.max_by("_n", F.struct("_k", "label"))).alias("_asking"),
    ).where("_askers > 0").drop("_all")
    open_ = placed.join(main, "cluster").withColumn("_parts", parts("nodes", "hashes")).withColumn("_sides", parts("_askers", "_asking"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64(F.lit(5), "node"), F.col(n))
    answers = open_.select("node", "label", "cluster", F.lit(False).alias("asks"), at("_parts").alias("block"), every("_sides").alias("side"))
    asking = open_.where("label <> _main").select("node", "label", "cluster", F.lit(True).alias("asks"), at("_sides").alias("side"), every("_parts").alias("block"))
    both = asking.unionByName(answers).join(sets.drop("key"), "node")
    links = scratch.write(both.groupBy("cluster", "block", "side").applyInArrow(_asked(similarity), "a long, b long").distinct(), "stars")
    moved = components(links, scratch, files).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return placed.join(moved, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))


def linked_nodes(sets: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """(node, label) of the nodes that may have partners; label is the same for linked nodes."""
    files = -(-sets.count() // _NODES_PER_FILE) or 1
    first = sets.select("node", F.explode("prefix").alias("hash"))
    maybe = components(scratch.write(stars(first, ["hash"]), "stars", files), scratch, files)
    clusters = _Clusters(maybe.join(sets.select("node", "n"), "node"), scratch, files)
    small, turn, stable = [clusters.small], 0, 0
    while clusters.count and stable < 2:
        turn, before = turn + 1, clusters.count
        members = clusters.large.select("node", "label", "n")
        clusters = _Clusters(_cut(members, sets, turn % 3, similarity, scratch, files), scratch, files, turn)
        small.append(clusters.small)
        shrunk = clusters.large.count() < members.count() or clusters.count != before
        stable = 0 if shrunk else stable + 1
    groups = small[0]
    for more in small[1:]:
        groups = groups.unionByName(more)
    placed = groups.select("node", "label").join(sets.drop("key"), "node").repartition("label").sortWithinPartitions("label")
    found = scratch.write(placed.mapInArrow(_labelled("label", similarity), LABELS), "found")
    return found.unionByName(_in_blocks(clusters.large, sets, similarity, scratch, files)) if clusters.count else found


def similar_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
    hashes_per_range: int = HASHES_PER_RANGE,
) -> DataFrame:
    """Per row of df: doc_id, tie (a hash of the text), n_shingles, first: the (doc_id, tie) that comes
    first in the row's component, null identifiers last."""
    scratch = Scratch(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    sizes = scratch.write(texts.mapInArrow(_sizes(words), "doc_id long, tie long, n_shingles long, key binary"), "sizes")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(LEAST_RANGES, 1 << max(0, (-(-total // hashes_per_range) - 1).bit_length()))
    hot = hot_hashes(texts, sizes, words)
    blocks = texts.select("text").mapInArrow(_blocks(words, ranges, hot), "range int, payload binary")
    # A task for each range and each bucket, so what a task reads doesn't grow with the corpus.
    shared = blocks.repartitionById(2 * ranges, F.col("range")).groupBy("range").applyInArrow(_shared(ranges), "bucket int, range int, payload binary")
    found = shared.repartitionById(ranges, F.col("bucket")).groupBy("bucket").applyInArrow(_survivors(similarity, ranges), SETS)
    sets = scratch.write(found.withColumn("node", F.monotonically_increasing_id()), "sets")
    nodes = scratch.write(sets.select("node", "key").join(linked_nodes(sets, similarity, scratch), "node").select("key", "label"), "nodes")
    scratch.drop(*(name for name in list(scratch.paths) if name not in ("sizes", "nodes")))
    # The first row of each key, then of each component; copies meet their key by salted pairs.
    full = sizes.where("n_shingles > 0").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    me = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    by_key = full.groupBy("key").agg(F.min(me).alias("_first"))
    linked = by_key.join(nodes, "key")
    by_label = linked.groupBy("label").agg(F.min("_first").alias("_least"))
    moved = linked.join(by_label, "label").select("key", "_least")
    entries = by_key.join(moved, "key", "left").select("key", F.coalesce("_least", "_first").alias("first"))
    columns = ["doc_id", "tie", "n_shingles", "first"]
    return salted_lookup(full, ["key"], entries, "_salt").select(*columns).unionByName(
        sizes.where("n_shingles = 0").withColumn("first", me).select(*columns)
    )


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles, are linked with nothing and are their own component.
    Rows with one identifier are rows of their own; null identifiers count as larger than others, so
    a component of them alone has a null id. An empty table gives no rows; other columns aren't read.
    """
    groups = similar_groups(df, id_col, text_col, **options)
    return groups.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df, with all its columns, that come first in their component: the smallest
    identifier, null ones last, then the smallest hash of the text. Of rows that share both, the one
    with the smallest hash of the whole row stays. Texts without words stay, once for each identifier.
    An empty table gives no rows."""
    groups = similar_groups(df, id_col, text_col, **options)
    first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("tie") == F.col("first.tie"))
    kept = groups.where(first).select(row_key("doc_id", "tie").alias("_row")).distinct()
    return staying_rows(df, row_key(F.col(id_col).cast("long"), F.xxhash64(text_col)), kept)
