"""Joining documents whose sets of word shingles are similar, by signature trees.

Exact for every link between different sets, and linear where documents resemble each other in crowds:

1. A document becomes the set of hashes of its shingles. Equal sets are one node, named by a hash of the set.
2. Shingles have one global order: frequent ones last, else by hash. Similar sets share one of the first
   quarter of their shingles in that order (their prefix), so a block per prefix shingle brings every
   similar pair together somewhere. Frequent ones last keeps a passage that many documents quote out of blocks.
3. In every block each set is compared with the block's first and last. What is similar becomes a component,
   so a crowd of near copies costs two comparisons per member. Blocks of frequent shingles are salted, and their
   salted parts' first sets are compared with each other.
4. What is left are pairs from different components in the same block. A block is a signature tree: leaves
   hold a bitmap of a set's shingles and its size, inner nodes the OR of their bitmaps, the range of sizes and
   the most shingles that share a bit, and the nodes below the root are the components. A dual traversal
   descends only into pairs of nodes whose greatest possible overlap can still make a link. Blocks of
   more than ``BLOCK`` sets are dealt to tasks as pairs of parts. A pair that shares several blocks comes out of the
   first: rows carry the first ``EARLY`` blocks of their set, and a pair with an earlier block in common is left to it.
5. Survivors are compared shingle by shingle.

Which shingles count as frequent, and the salts, only decide who is compared first, never the result.
"""

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errorloom.llm.common import Scratch, lean, maybe_in, scratch, stored
from errorloom.llm.graph import components
from errorloom.llm.wordscan import chunks, mix64, words

WORDS = 5
SIMILAR = (3, 4)  # at least 3/4
FREQUENT_IN_BATCH = 6
FREQUENT = 1 << 20  # shingles kept in order of frequency: at most 8 MB
FILTER = 1 << 24
SALTS = 64
BLOCK = 4096
HASH_BITS = 50
TEXTS = 1 << 13
CHUNK = 1 << 19
SHARP = 1 << 13
EARLY = 8  # first blocks of a set that its rows carry


def shingle_sets(texts: pa.Array, size: int = WORDS):
    """The sorted distinct shingle hashes of each text, and where each text's begin, with the end last.

    Texts with fewer words than a shingle have the whole sequence as one, texts without words have none. The number of
    a text takes 14 bits beside the hash, so more texts are done in turns.
    """
    if len(texts) > TEXTS:
        parts = [shingle_sets(texts.slice(at, TEXTS), size) for at in range(0, len(texts), TEXTS)]
        before = np.cumsum([0, *(len(hashes) for hashes, _ in parts)])
        ends = [ends[:-1] + start.astype(ends.dtype) for (_, ends), start in zip(parts, before)]
        return np.concatenate([hashes for hashes, _ in parts]), np.append(np.concatenate(ends), before[-1])
    hashes, bounds = words(texts)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(hashes)) - bounds[doc] if len(hashes) else np.zeros(0, np.int64)
    left = count[doc] - place
    # A shingle of the words that are there, from every place with enough words or, in short texts, the first.
    starts = np.flatnonzero((left >= size) | ((place == 0) & (left < size)))
    rolled = np.full(len(starts), 0, dtype=np.uint64)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    with np.errstate(over="ignore"):
        for k in range(size):
            part = np.where(left[starts] > k, padded[starts + k], np.uint64(0))
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    # Text and hash in one number: sorting it sorts the hashes of each text.
    keys = np.sort((doc[starts].astype(np.uint64) << np.uint64(HASH_BITS)) | (rolled >> np.uint64(64 - HASH_BITS)))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    keys = keys[first]
    ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
    return keys & np.uint64((1 << HASH_BITS) - 1), ends


def set_names(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    with np.errstate(over="ignore"):
        sums = [np.append(np.uint64(0), np.cumsum(mix64(values ^ np.uint64(salt)), dtype=np.uint64)) for salt in (1, 2)]
        n = np.diff(bounds).astype(np.uint64)
        return np.stack([mix64(s[bounds[1:]] - s[bounds[:-1]] + n) for s in sums], 1).view(np.int64)


def signature(values: np.ndarray, spread: int = 4) -> bytes:
    """A bitmap of the set, its width the power of two from ``spread`` times the size on.

    Beyond ``SHARP`` bits the size is enough: a long text is in many blocks, each with its bitmap.
    """
    width = 64
    while width < min(spread * len(values), max(len(values), SHARP)):
        width *= 2
    bits = np.zeros(width, dtype=np.uint8)
    bits[(values % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bitmap(signature: bytes) -> tuple:
    """A signature as an integer, and its width."""
    return int.from_bytes(signature, "little"), 8 * len(signature)


def prefix_size(n: int) -> int:
    """A set and a similar one share at least three quarters of it, so one of these first shingles."""
    over, under = SIMILAR
    return n - -(-over * n // under) + 1


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that many sets have, at most ``FREQUENT`` of them. Sets that are equal in a batch count once."""

    def counted(batches):
        for batch in batches:
            seen, found = set(), []
            for texts in chunks(batch.column(0), CHUNK):
                values, bounds = shingle_sets(texts)
                names = set_names(values, bounds)[:, 0].tolist()
                keep = np.array([not (name in seen or seen.add(name)) for name in names], dtype=bool)
                found.append(values[np.repeat(keep, np.diff(bounds))])
            found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(found)))
            often = n >= FREQUENT_IN_BATCH
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[starts[often]].view(np.int64)), pa.array(n[often])], ["shingle", "n"]
            )

    rows = docs.select("text").mapInArrow(lean(counted), "shingle bigint, n bigint")
    top = rows.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    return np.sort(top.select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))


def _sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per document its set: name, size, signature, a narrow one (sketch), and the prefix apart by whether shingles are frequent."""

    def made(batches):
        mask = np.uint64(FILTER - 1)
        maybe = np.zeros(FILTER, dtype=bool)
        maybe[(frequent & mask).astype(np.int64)] = True
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1), CHUNK):
                values, bounds = shingle_sets(texts)
                names, n = set_names(values, bounds), np.diff(bounds)
                often = maybe[(values & mask).astype(np.int64)]
                hits = np.flatnonzero(often)
                if len(hits):
                    places = np.minimum(np.searchsorted(frequent, values[hits]), len(frequent) - 1)
                    often[hits] = frequent[places] == values[hits]
                rare, common, signatures, sketches = [], [], [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own, mark = values[a:b], often[a:b]
                    size = prefix_size(b - a) if b > a else 0
                    seldom = own[~mark][:size]
                    rare.append(seldom.view(np.int64))
                    common.append(own[mark][: size - len(seldom)].view(np.int64))
                    signatures.append(signature(own))
                    sketches.append(signature(own, 1))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, common)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]),
                     pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary()), *lists],
                    ["doc_id", "n", "node", "check", "signature", "sketch", "rare", "common"],
                )
                at += len(texts)

    columns = "doc_id bigint, n bigint, node bigint, check bigint, signature binary, sketch binary"
    return docs.select("doc_id", "text").mapInArrow(lean(made), f"{columns}, rare array<bigint>, common array<bigint>")


def similar(shared: int, a: int, b: int) -> bool:
    over, under = SIMILAR
    return under * shared >= over * (a + b - shared)


def least_overlap(a: int, b: int) -> int:
    """The smallest overlap that makes sets of these sizes similar."""
    over, under = SIMILAR
    return -(-over * (a + b) // (over + under))


class Tree:
    """A node over leaves (set, size, bitmap as an integer, its width), given in order of size."""

    __slots__ = ("leaves", "children", "bits", "width", "least", "most", "doubled")

    def __init__(self, leaves):
        self.leaves = leaves
        self.least, self.most = leaves[0][1], leaves[-1][1]
        self.width = min(leaf[3] for leaf in leaves)
        self.bits, self.doubled = 0, 0
        for _, n, bits, width in leaves:
            bits = fold(bits, width, self.width)
            self.bits |= bits
            self.doubled = max(self.doubled, n - bits.bit_count())
        half = len(leaves) // 2
        self.children = (Tree(leaves[:half]), Tree(leaves[half:])) if half else ()


def fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits & ((1 << width) - 1)) | bits >> width
    return bits


def may_link(a: Tree, b: Tree) -> bool:
    """Whether some set below ``a`` can be similar to one below ``b``.

    Sizes must allow it, and shared shingles lie in bits that both have; one bit holds further shingles of
    a set at most as often as ``doubled`` says.
    """
    over, under = SIMILAR
    if under * a.most < over * b.least or under * b.most < over * a.least:
        return False
    width = min(a.width, b.width)
    x, y = fold(a.bits, a.width, width), fold(b.bits, b.width, width)
    # Narrowing a bitmap makes more shingles share a bit.
    extra = min(a.doubled if a.width == width else a.most, b.doubled if b.width == width else b.most)
    return (x & y).bit_count() + extra >= least_overlap(a.least, b.least)


def sets_may_link(n: int, bits: int, width: int, m: int, others: int, other_width: int) -> bool:
    """``may_link`` for two sets, by the shingles of each that surely miss the other."""
    narrow = min(width, other_width)
    x, y = fold(bits, width, narrow), fold(others, other_width, narrow)
    shared = (x & y).bit_count()
    return min(n - x.bit_count() + shared, m - y.bit_count() + shared) >= least_overlap(n, m)


def traverse(a: Tree, b: Tree, found: list) -> None:
    """Pairs of leaves below two nodes that can be similar."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not may_link(a, b):
            continue
        if not a.children and not b.children:
            (one, *own), (other, *its) = a.leaves[0], b.leaves[0]
            if sets_may_link(*own, *its):
                found.append((one, other))
        elif a.children and (not b.children or len(a.leaves) >= len(b.leaves)):
            stack.extend((child, b) for child in a.children)
        else:
            stack.extend((a, child) for child in b.children)


def block_pairs(shingle, nodes, sizes, signatures, groups, parts, early) -> list:
    """Candidates among the sets of a block, from different groups and, in a block of two parts, different parts.

    A pair comes out of the first block that it shares only, as far as the first blocks of both (``early``) show that.
    """
    several = len(set(parts)) > 1
    own = {node: (part, frozenset(first)) for node, part, first in zip(nodes, parts, early)}

    def here(a, b):
        (part, first), (other, its) = own[a], own[b]
        return not (several and part == other) and min(first & its, default=shingle) >= shingle

    by_group: dict = {}
    for node, n, bits, group in zip(nodes, sizes, signatures, groups):
        by_group.setdefault(group, {})[node] = (node, int(n), *bitmap(bits))
    trees = [Tree(sorted(leaves.values(), key=lambda x: x[1])) for leaves in by_group.values()]
    found: list = []
    for a, b in root_pairs(trees):
        traverse(a, b, found)
    return [pair for pair in found if here(*pair)]


def root_pairs(trees):
    """The pairs of trees whose roots pass ``may_link``, a root against all others in one array operation."""
    over, under = SIMILAR
    by_width: dict = {}
    for tree in sorted(trees, key=lambda tree: tree.least):
        by_width.setdefault(tree.width, []).append(tree)
    tables = {
        width: (
            np.frombuffer(b"".join(t.bits.to_bytes(width // 8, "little") for t in roots), "<u8").reshape(len(roots), -1),
            *np.array([(t.least, t.most, t.doubled) for t in roots], dtype=np.int64).T,
        )
        for width, roots in by_width.items()
    }
    for narrow, wide in combinations_with_replacement(sorted(by_width), 2):
        bits, least, most, doubled = tables[narrow]
        others, other_least, other_most, extra = tables[wide]
        if under * most.max() < over * other_least[0] or under * other_most.max() < over * least[0]:
            continue
        if wide > narrow:
            extra = other_most
            while others.shape[1] > bits.shape[1]:
                half = others.shape[1] // 2
                others = others[:, :half] | others[:, half:]
        ends = np.searchsorted(other_least, under * most // over, side="right")
        for i in range(len(bits)):
            at = slice(i + 1 if narrow == wide else 0, ends[i])
            shared = np.bitwise_count(bits[i] & others[at]).sum(1, dtype=np.int64)
            needed = -(-over * (least[i] + other_least[at]) // (over + under))
            passed = (shared + np.minimum(doubled[i], extra[at]) >= needed) & (under * other_most[at] >= over * least[i])
            for j in np.flatnonzero(passed):
                yield by_width[narrow][i], by_width[wide][at.start + j]


def _blocks(sets: DataFrame, brief: Scratch) -> DataFrame:
    """(shingle, salt, node, first, last): the sets of every block that has at least two, or a frequent shingle."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int") + 1
    rows = sets.select("node", F.explode("rare").alias("shingle"), F.lit(0).alias("salt")).unionByName(
        sets.select("node", F.explode("common").alias("shingle"), salt.alias("salt"))
    )
    block = Window.partitionBy("shingle", "salt")
    return stored(
        rows.withColumn("first", F.min("node").over(block)).withColumn("last", F.max("node").over(block))
        .where("first <> last or salt > 0"),
        "blocks", within=brief,
    )


def _linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that are similar, after comparing their sets."""
    with scratch(docs.sparkSession):
        pairs = stored(pairs, "pairs")
        named = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        needed = stored(named.join(needed, "node"), "needed")
        asked = maybe_in(needed, "doc_id")

        def packed(batches):
            for batch in batches:
                for at, texts in chunks(batch.column(1), CHUNK, places=True):
                    values, bounds = shingle_sets(texts)
                    # Forty bits of each shingle: enough to tell the shingles of two sets apart.
                    five = np.ascontiguousarray((values >> np.uint64(HASH_BITS - 40)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                    five = [five[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(texts)), pa.array(set_names(values, bounds)[:, 0]), pa.array(five, pa.binary())],
                        ["doc_id", "node", "shingles"],
                    )

        found = docs.where(asked("doc_id")).select("doc_id", "text").mapInArrow(lean(packed), "doc_id bigint, node bigint, shingles binary")
        texts = stored(found.select("node", "shingles"), "sets")

        @F.pandas_udf("boolean")
        def alike(left: pd.Series, right: pd.Series) -> pd.Series:
            return pd.Series([_alike(x, y) for x, y in zip(left, right)], dtype=bool)

        a = texts.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        b = texts.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        compared = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(alike("left", "right"))
        return stored(compared.select("a", "b").distinct(), "links", kept=1)


def _alike(left: bytes, right: bytes) -> bool:
    a, b = (np.frombuffer(x, dtype="V5") for x in (left, right))
    a, b = (np.frombuffer(x.tobytes(), dtype=np.uint8).reshape(-1, 5).astype(np.uint64) for x in (a, b))
    scale = np.uint64(256) ** np.arange(5, dtype=np.uint64)
    shared = len(np.intersect1d(a @ scale, b @ scale, assume_unique=True))
    return similar(shared, len(a), len(b))


def _near(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) that their sketches do not rule out."""

    @F.pandas_udf("boolean")
    def possible(n: pd.Series, bits: pd.Series, m: pd.Series, others: pd.Series) -> pd.Series:
        own, its = (zip(x.tolist(), *zip(*map(bitmap, y))) for x, y in ((n, bits), (m, others)))
        return pd.Series([sets_may_link(*x, *y) for x, y in zip(own, its)], dtype=bool)

    a = signed.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = signed.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    size = (F.col("nb") * 4 >= F.col("na") * 3) & (F.col("na") * 4 >= F.col("nb") * 3)
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(size).where(possible("na", "sa", "nb", "sb")).select("a", "b")


def _across(blocks: DataFrame, groups: DataFrame, signed: DataFrame, brief: Scratch) -> DataFrame:
    """Candidate pairs from different groups, block by block. The blocks are gone (``brief``) once they have their groups."""
    grouped = (
        blocks.select("shingle", "node").distinct()
        .join(groups.withColumnRenamed("component", "group"), "node", "left")
        .withColumn("group", F.coalesce("group", "node"))
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    with scratch(signed.sparkSession):
        grouped = stored(grouped, "grouped")
        brief.remove()
        # A passage that the same sets share gives as many equal blocks as it has shingles: one of them is enough.
        members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"members{i}") for i in (1, 2)]
        mixed = (
            grouped.groupBy("shingle")
            .agg(F.min("group").alias("least"), F.max("group").alias("most"), F.count(F.lit(1)).alias("sets"), *members)
            .where("least <> most")
            .groupBy("least", "most", "sets", "members1", "members2").agg(F.min("shingle").alias("shingle"))
            .select("shingle", F.ceil(F.col("sets") / BLOCK).cast("int").alias("parts"))
        )
        grouped = stored(grouped.join(stored(mixed, "mixed"), "shingle").withColumn("part", part), "mixed", kept=1)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                                 lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j"))))
    early = grouped.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("shingle")), 1, EARLY).alias("early"))
    rows = (
        grouped.select("node", "group", "shingle", "part", pair.alias("at"))
        .select("node", "group", "shingle", "part", "at.*")
        .join(signed.select("node", "n", "signature").join(early, "node"), "node")
        .repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    )

    def pairs(frames):
        held = None
        for frame in frames:
            frame = pd.concat([held, frame]) if held is not None else frame
            keys = frame[["shingle", "i", "j"]].to_numpy()
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(ends):
                held = frame
                continue
            yield _pairs(frame.iloc[: ends[-1]], ends)
            held = frame.iloc[ends[-1] :]
        if held is not None:
            yield _pairs(held, [len(held)])

    def _pairs(frame, ends):
        found, start = set(), 0
        for end in ends:
            part = frame.iloc[start:end]
            start = end
            columns = (part[x] for x in ("node", "n", "signature", "group", "part", "early"))
            found.update((min(p), max(p)) for p in block_pairs(part["shingle"].iloc[0], *columns))
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(lean(pairs), "a bigint, b bigint").distinct()


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id that links lead to).

    A null text counts as empty; a text without words has no shingles and no links, but equal texts with words
    are linked. Rows that repeat an id count as one document with the links of all its texts. Rows without an id
    are linked with nothing and have no component. Other columns are not read. Empty tables are fine.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    with scratch(docs.sparkSession) as brief, scratch(docs.sparkSession):
        return stored(_grouped(docs, brief), "groups", kept=2)


def _grouped(docs: DataFrame, brief: Scratch) -> DataFrame:
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            made = stored(_sets(docs, _frequent(docs)), "made")
            all_sets = stored(made.select("doc_id", "n", "node", "check"), "documents", kept=2)
            # One row per distinct set, so that copies of a text, however many, are in its blocks once. The prefixes, most
            # of a row, are apart as only the blocks need them.
            distinct = made.where("doc_id is not null and n > 0").groupBy("node")
            one = lambda *names: distinct.agg(*(F.any_value(x).alias(x) for x in names))
            signed = stored(one("n", "signature", "sketch"), "signed", kept=2)
            prefixes = stored(one("rare", "common"), "prefixes", kept=1)
        blocks = _blocks(prefixes, brief)
    sets = all_sets.where("doc_id is not null and n > 0")
    clash = sets.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
    if not clash.isEmpty():
        raise RuntimeError("two different sets have one name")

    heads = blocks.where("salt > 0").groupBy("shingle").agg(F.min("first").alias("head"))
    pivots = F.when(F.col("node") == F.col("first"), F.array()).otherwise(F.array("first", "last"))
    stars = blocks.select(F.col("node").alias("a"), F.explode(pivots).alias("b")).unionByName(
        blocks.where("salt > 0").select("shingle", "first").distinct().join(stored(heads, "heads"), "shingle")
        .select(F.col("first").alias("a"), F.col("head").alias("b"))
    )
    links = _linked(_near(stars.where("a <> b").distinct(), signed), sets, docs)
    # Rows that repeat an id join their sets.
    least = sets.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    repeats = sets.join(least.select("doc_id", "b"), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    links = links.unionByName(repeats)
    first = components(links)
    more = _linked(_across(blocks, first, signed, brief), sets, docs)
    nodes = first if more.isEmpty() else components(links.unionByName(more))

    placed = sets.select("doc_id", "node").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed.select("doc_id", "component"), "placed")
    ids = stored(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    named = placed.join(ids, "component").select("doc_id", "component_id").distinct()
    return (
        all_sets.select("doc_id", F.col("n").alias("n_shingles")).join(stored(named, "named"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    )


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group, and rows without an id. Of repeated rows all stay."""
    gone = stored(groups(docs, id_column, text_column).where("doc_id <> component_id").select("doc_id"), "gone")
    suspect = F.coalesce(maybe_in(gone, "doc_id")(F.col(f"`{id_column}`").cast("bigint")), F.lit(False))
    checked = docs.where(suspect)
    return docs.where(~suspect).union(checked.join(gone, checked[f"`{id_column}`"] == gone["doc_id"], "left_anti"))
