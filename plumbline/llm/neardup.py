"""Operator 4: near-duplicates by SuperMinHash.

1. Every text's words make a set of hashed shingles and a SuperMinHash signature:
   element after element draws a permutation's ranks step by step, and a text
   stops when no step can lower its signature. Texts with equal words are one
   class; only classes go on.
2. Signatures are cut into bands; classes with an equal band share a bucket.
   Buckets with the same members count once. Inside a bucket signatures are
   compared, and each bucket gives a spanning forest of its pairs whose estimated
   similarity comes near the threshold (``slack`` below it): no more links than
   members. Members of a large bucket are first compared with a few of them; only
   pairs that this doesn't connect are dealt in blocks, every two blocks in a task
   of their own.
3. The forests' connected components are the candidate groups. Inside a group the
   full shingle sets are compared exactly, again in blocks of bounded members and
   bytes, and every task gives a spanning forest of the pairs that reach the
   threshold.
4. Connected components of the confirmed links give the result. Components are
   found by rounds of joins (each node takes the least label near it, and labels
   are followed to their labels), checkpointed; nothing is collected.

The chance that banding misses a pair at similarity 0.8 is (1 - 0.8^5)^36, below
one in a million, and that the estimate falls by the slack about as small.

Defined results: null texts and texts without words have an empty set, are linked
with nothing and kept. Equal texts are linked. Rows with the same id are nodes of
their own; a null id is its own component's null. kept is doc_id = component_id,
so among repeated rows all or none are kept. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, LOWER, UPPER, WORD_SQL, discard, docs_repeat, freeing, numbered, slices, stored, stored_at, words_of

SHINGLE = 4
THRESHOLD = (80, 100)
BANDS, ROWS = 36, 5
#: How far below the threshold an estimate may be: 0.8 - 0.17 is more than five standard deviations of 180 draws.
SLACK = 0.17
#: Members of a block of a bucket or of a candidate group.
BUCKET_BLOCK, GROUP_BLOCK = 2048, 512
#: Bytes of full sets in a block of a candidate group.
BLOCK_BYTES = 8_000_000
#: Members of a large group that all others are compared with first.
REPRESENTATIVES = 32
#: Keys that more than HOT rows share are looked up apart, of HOT_KEYS at most.
HOT, HOT_KEYS = 1000, 100_000
#: Words that a task remembers with their hashes.
REMEMBERED = 200_000
#: Elements that are drawn for together.
DRAW = 16384

_MIX1, _MIX2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to the hash of its ASCII lower case, filled on demand."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.translate(ASCII_LOWER).encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def word_hashes(text: str, memory: WordHashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles, sorted."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, len(words[:k]), np.uint64)
    for i in range(min(k, len(words))):
        h = mix(h * _GOLDEN + words[i : i + n])
    return np.unique(h)


class SuperMinHash:
    """Signatures of many sets at once. Position p's value is step * 2^32 + draw, the least over a set's elements; an element's step j sends it to one of the positions it hasn't been to."""

    def __init__(self, size: int = BANDS * ROWS):
        self.size = size

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(sets), self.size), np.iinfo(np.uint64).max, np.uint64)
        lo = 0
        while lo < len(sets):
            hi, n = lo, 0
            while hi < len(sets) and (n == 0 or n + len(sets[hi]) <= DRAW):
                n += len(sets[hi])
                hi += 1
            if n:
                for part in range(0, n, 4 * DRAW):  # one very large set goes in parts
                    elements = np.concatenate(sets[lo:hi])[part : part + 4 * DRAW]
                    owner = np.repeat(np.arange(lo, hi), [len(s) for s in sets[lo:hi]])[part : part + 4 * DRAW]
                    self._draw(elements, owner, out)
            lo = hi
        return out

    def _draw(self, elements: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        m, flat = self.size, out.reshape(-1)
        order = None
        for j in range(m):
            r = mix(elements + np.uint64((j + 1) * int(_GOLDEN) % 2**64))
            k = (j + ((r >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)) if m - j > 1 else np.full(len(elements), j)
            if order is None:
                at, first = k, k
            else:
                rows = np.arange(len(elements))
                at = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, j]
            np.minimum.at(flat, owner * m + at, (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
            # a text goes on while one of its positions can still be lowered by step j + 1
            going = (out[owner[0] : owner[-1] + 1].max(1) >> np.uint64(32)) > j
            keep = going[owner - owner[0]]
            if not keep.any():
                return
            if order is None:
                elements, owner, first = elements[keep], owner[keep], first[keep]
                order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                order[np.arange(len(elements)), first] = 0
            elif not keep.all():
                elements, owner, order = elements[keep], owner[keep], order[keep]


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands))
    cut = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        keys = mix(keys * _GOLDEN + cut[:, :, i])
    return keys


def signed(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, cls (of equal words; null without words), n_shingles, sig (a byte per position), keys (one per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, hasher = WordHashes(), SuperMinHash(bands * rows)
        for batch in slices(batches, 256):
            words = [word_hashes(t or "", memory) for t in batch.column(1).to_pylist()]
            sets = [shingles(w, k) for w in words]
            sigs = hasher.signatures(sets)
            keys = band_keys(sigs, bands, rows).view(np.int64)
            small = mix(sigs).astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh3_128_digest(w.tobytes()) if f else None for w, f in zip(words, full, strict=True)], pa.binary()),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([s.tobytes() if f else None for s, f in zip(small, full, strict=True)], pa.binary()),
                    pa.array([x if f else None for x, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "cls", "n_shingles", "sig", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), f"doc_id {kind}, cls binary, n_shingles long, sig binary, keys array<long>")


def in_groups(df: DataFrame, links: Callable[[list, list], list[tuple]]) -> DataFrame:
    """Links (a, b) from rows (group, side, cls, data) that are sorted by group inside partitions; links() gets a group's sorted (side, cls) and its data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        names: list = []
        data: list = []
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = [[x[i] for x in out] for i in (0, 1)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

        for batch in batches:
            for group, side, cls, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != held:
                    if names:
                        out += links(names, data)
                    held, names, data = group, [], []
                names.append((side, cls))
                data.append(value)
            if len(out) > 50_000:
                yield made()
        if names:
            out += links(names, data)
        if out:
            yield made()

    return df.select("group", "side", "cls", "data").mapInArrow(freeing(run), "a binary, b binary")


def _spanning(names: list, near: Callable[[int, int, int], np.ndarray]) -> list[tuple]:
    """A spanning forest of the pairs that near(row, from, to) tells; where a group holds two blocks, of the pairs across them only."""
    n = len(names)
    first = sum(1 for side, _ in names if side == names[0][0])
    tree, out = np.arange(n), []
    for i in range(first if first < n else n):
        lo = first if first < n else i + 1
        close = near(i, lo, n)
        while (apart := close & (tree[lo:] != tree[i])).any():
            j = int(apart.argmax()) + lo
            tree[tree == tree[j]] = tree[i]
            out.append((names[i][1], names[j][1]))
    return out


def likely_links(least: int) -> Callable[[list, list], list[tuple]]:
    """Pairs whose signatures agree in ``least`` positions."""

    def links(names: list, data: list) -> list[tuple]:
        sigs = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        return _spanning(names, lambda i, lo, hi: (sigs[lo:hi] == sigs[i]).sum(1) >= least)

    return links


def confirmed_links(share: tuple[int, int]) -> Callable[[list, list], list[tuple]]:
    """Pairs of sets with share[1] * intersection >= share[0] * union."""
    over, under = share

    def links(names: list, data: list) -> list[tuple]:
        sets = [np.frombuffer(d, np.uint64) for d in data]
        sizes = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(names[0][1], names[1][1])] if under * both >= over * (int(sizes.sum()) - both) else []
        # elements of one set only can't be shared; the others get numbers, and a set's shared elements a row of ones
        every = np.concatenate(sets)
        values, number, times = np.unique(every, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = times > 1
        new = np.cumsum(shared) - 1
        owner, number = owner[shared[number]], new[number[shared[number]]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 2048
        order = np.argsort(number // width, kind="stable")
        owner, number = owner[order], number[order]
        edges = np.searchsorted(number // width, np.arange(int(shared.sum()) // width + 2))
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                ones = np.zeros((len(sets), width), np.float32)
                ones[owner[a:b], number[a:b] % width] = 1
                rows = np.unique(owner[a:b])
                part = ones[rows]
                both[np.ix_(rows, rows)] += part @ part.T

        def near(i: int, lo: int, hi: int) -> np.ndarray:
            x = both[i, lo:hi].astype(np.int64)
            return under * x >= over * (sizes[i] + sizes[lo:hi] - x)

        return _spanning(names, near)

    return links


def blocks(members: DataFrame, group: str, counts: DataFrame) -> DataFrame:
    """Deals (group, cls, data) to tasks (group, side, cls, data): one for a group of one block, else one for every two blocks and every block; counts: (group, k)."""
    df = members.join(counts.select(group, "k"), group).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    name = F.concat_ws("-", F.hex(group), F.least("mine", "other"), F.greatest("mine", "other"))
    return df.select(name.alias("group"), F.col("mine").alias("side"), "cls", "data")


def across(some: DataFrame, members: DataFrame, group: str, counts: DataFrame) -> DataFrame:
    """Deals the pairs of some (group, cls, data) of a group's members and all of them to tasks (group, side, cls, data), for every block of either side; counts:
    (group, k, some_k)."""
    sizes = counts.select(group, "k", "some_k")
    out = None
    for side, df, own, far in ((0, some, "some_k", "k"), (1, members, "k", "some_k")):
        df = df.join(sizes, group).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(far) - 1)))
        places = ("mine", "other") if side == 0 else ("other", "mine")
        df = df.select(F.concat_ws("-", F.hex(group), *places).alias("group"), F.lit(side).alias("side"), "cls", "data")
        out = df if out is None else out.unionByName(df)
    return out


def gathered(df: DataFrame) -> DataFrame:
    return df.repartition("group").sortWithinPartitions("group", "side", "cls")


def links_within(members: DataFrame, group: str, counts: DataFrame, links: Callable[[list, list], list[tuple]], name: str) -> DataFrame:
    """(a, b), links that connect in each group (group, cls, data) what links() links; counts: (group, n, k), members and blocks of each group, stored.

    Groups of one block are compared whole. In a larger one, all members are first compared with about REPRESENTATIVES of them. Pairs inside the largest component
    that this gives need no comparing any more; all others are compared, block by block, as every such pair has a member outside of that component. So a large group
    of copies takes steps in proportion to its size, and no pair is left out."""
    small = in_groups(gathered(blocks(members, group, counts.filter("k = 1"))), links)
    large = counts.filter("k > 1")
    if not large.limit(1).count():
        return stored(small.distinct(), name)
    held, held_at = stored_at(members.join(large.select(group), group, "left_semi").select(group, "cls", "data"), "large")
    some = held.join(large.select(group, "n"), group).filter(F.pmod(F.xxhash64(F.lit(4), "cls"), F.col("n")) < REPRESENTATIVES).drop("n")
    first = in_groups(gathered(across(some, held, group, large.withColumn("some_k", F.lit(1)))), links).filter("a != b")
    first, first_at = stored_at(first.distinct(), "first")
    parts = components(first).select(F.col("node").alias("cls"), F.col("label").alias("part"))
    at = held.select(group, "cls").join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    at, at_at = stored_at(at, "placed")
    most = at.groupBy(group, "part").agg(F.count(F.lit(1)).alias("c")).groupBy(group).agg(F.max(F.struct("c", "part"))["part"].alias("most"))
    rest = at.join(most, group).filter("part != most").select(group, "cls")
    sizes = rest.groupBy(group).agg(F.count(F.lit(1)).alias("r")).join(large, group)
    sizes = stored(sizes.withColumn("some_k", F.ceil(F.col("k") * F.col("r") / F.col("n")).cast("int")), "rest")
    every = held.join(sizes.select(group), group, "left_semi")
    second = in_groups(gathered(across(held.join(rest, [group, "cls"], "left_semi"), every, group, sizes)), links).filter("a != b")
    out = stored(small.unionByName(first).unionByName(second).distinct(), name)
    for path in (held_at, first_at, at_at):
        discard(members.sparkSession, path)
    return out


def followed(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with the columns of table, which has each key once. Keys of hot, of which there are few and which many rows share, are looked up in a broadcast table, so
    that no task gets all rows of one."""
    few = F.broadcast(hot.select(key))  # at most HOT_KEYS rows
    return rows.join(few, key, "left_anti").join(table, key).unionByName(rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key))


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys that more than HOT rows share, or more than one in HOT_KEYS: at most HOT_KEYS."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(HOT, total // HOT_KEYS)).select(key)


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (a, b): node and label, the least node it is connected with. Each round a node takes the least of its
    neighbours' labels and of its label's label; the number of rounds grows with the logarithm of a component's size, or for long
    chains of unlucky order a little faster."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, edges_at = stored_at(both, "edges")
    hubs, hubs_at = stored_at(hot_keys(both, "b", both.count()), "hubs")
    labels, labels_at = stored_at(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    nodes = labels.count()
    while True:
        near = followed(both, "b", labels.select(F.col("node").alias("b"), "label"), hubs).groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # what a node has found is also news for the label it leaves
        news = hooked.filter("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("news"))
        hooked = hooked.join(news, "node", "left").select("node", "old", F.least("label", F.coalesce("news", "label")).alias("label"))
        hooked, hooked_at = stored_at(hooked, "hooked")
        jumped = followed(hooked, "label", hooked.select(F.col("node").alias("label"), F.col("label").alias("far")), hot_keys(hooked, "label", nodes))
        new, new_at = stored_at(jumped.select("node", "old", F.least("label", "far").alias("label")), "labels")
        for path in (labels_at, hooked_at):
            discard(spark, path)
        labels, labels_at = new.select("node", "label"), new_at
        if not new.filter("label != old").limit(1).count():
            for path in (edges_at, hubs_at):
                discard(spark, path)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK, bucket_block: int = BUCKET_BLOCK, group_block: int = GROUP_BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    sign = stored(signed(docs, id_col, text_col, k, bands, rows), "signed")
    classes = sign.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "classes")

    # buckets of two members or more, and one of each set of members
    members = classes.select("cls", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("least"), F.bit_xor(F.xxhash64("cls")).alias("all")).filter("n > 1")
    single = buckets.groupBy("n", "least", "all").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / F.lit(bucket_block)).cast("int").alias("k"))
    single, single_at = stored_at(single, "buckets")
    full, full_at = stored_at(members.join(single.select("key"), "key", "left_semi"), "members")
    least = int(bands * rows * (threshold[0] / threshold[1] - slack))
    data = full.join(classes.select("cls", F.col("sig").alias("data")), "cls")
    likely = links_within(data, "key", single, likely_links(least), "likely")
    for path in (single_at, full_at):
        discard(docs.sparkSession, path)

    # candidate groups and their sets
    groups = components(likely)
    wanted, wanted_at = stored_at(groups.join(classes.select(F.col("cls").alias("node"), "first", "size"), "node").select("node", "label", "first", "size"), "wanted")
    most = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(group_block)), F.ceil(8 * F.sum("size") / F.lit(BLOCK_BYTES)))
    counts = stored(wanted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), most.cast("int").alias("k")), "counts")
    sets = shingle_sets(docs, wanted, id_col, text_col, k)
    confirmed = links_within(sets, "label", counts, confirmed_links(threshold), "confirmed")
    discard(docs.sparkSession, wanted_at)

    labels = components(confirmed)
    named = labels.join(classes.select(F.col("cls").alias("node"), "first"), "node")
    least_id = named.groupBy("label").agg(F.min("first").alias("component"))
    linked = followed(named, "label", least_id, hot_keys(named, "label", named.count())).select(F.col("node").alias("cls"), "component")
    ids = classes.select("cls", "first").join(linked, "cls", "left").select("cls", F.coalesce("component", "first").alias("component"))
    ids = stored(ids, "ids")
    copies = classes.filter(F.col("n") > HOT).orderBy(F.desc("n")).limit(HOT_KEYS).select("cls")  # texts with most copies; the rest is looked up by a join
    out = sign.filter("cls is not null").select("doc_id", "cls", "n_shingles")
    out = followed(out, "cls", ids, copies).unionByName(sign.filter("cls is null").select("doc_id", "cls", "n_shingles").withColumn("component", F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL for near_duplicates() of documents with its own parameters: all links by a join on shingles, components by their closure.
ORACLE = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_SQL}') as w from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 80 * (a.n + b.n - common)),
e as (select x, y from l union all select y, x from l),
reach(doc_id, far) as (select doc_id, doc_id from documents union select r.doc_id, e.y from reach r join e on e.x = r.far),
c as (select doc_id, min(far) as component_id from reach group by 1)
select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n using (doc_id)"""


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One whole row of each group, the one with the least id, null being the greatest. Where ids repeat, rows are nodes of their own, so
    of rows with one id only those whose texts are linked go."""
    if not docs_repeat(docs, id_col):
        ids = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("_id"))
        rows = docs.select(F.struct(*docs.columns).alias("_all"), F.col(id_col).alias("_doc"))
        return rows.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_all.*")
    rows = numbered(docs)
    row_id = F.col("_all").getField(id_col)
    keys = rows.select(F.struct(row_id.isNull().alias("none"), row_id.alias("id"), F.col("_row").alias("row")).alias("_key"), F.col("_all").getField(text_col).alias("_text"))
    kept = near_duplicates(keys, "_key", "_text", **options).filter("kept").select(F.col("doc_id.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_all.*")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(label, cls, data) with the full sets of the wanted classes (node, label, first), one of each class."""
    few = wanted.count() <= broadcast_rows  # at most so many rows of 60 bytes
    ids = wanted.select(F.col("first").alias("_first")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in slices(batches, 512):
            words = [word_hashes(t or "", memory) for t in batch.column(1).to_pylist()]
            names = pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array([shingles(w, k).tobytes() for w in words], pa.binary())], names=["cls", "data"])

    sets = rows.select("doc_id", "text").mapInArrow(freeing(run), "cls binary, data binary")
    w = wanted.select(F.col("node").alias("cls"), "label")
    joined = sets.join(F.broadcast(w) if few else w, "cls")
    return joined.groupBy("label", "cls").agg(F.first("data").alias("data")) if docs_repeat(docs, id_col) else joined
