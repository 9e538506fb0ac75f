"""Jaccard join on word shingles: subsets of small sets, inverted lists of large ones, boundary by cost."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetlens.llm.arrays import RangeHash, chunks, mixed, signed
from streetlens.llm.columns import as_row
from streetlens.llm.components import connected_components, maybe, value_filter
from streetlens.llm.shingles import shingle_sets
from streetlens.session import stage_table

#: Growth of the set sizes that share one division into segments; larger ones share more and cut finer.
CLASS_GROWTH = 1.5

#: Segments of a set, in times those that a pair may differ in: the more, the more of them a pair must share.
SEGMENT_SLACK = 1.25

#: What reading one row of an inverted list costs, in rows written.
SCAN_COST = 8.0

#: Largest size that the boundary may take: more than two shingles left out give too many subsets.
LARGEST_SMALL = 29

#: Bytes of text a task works on at once.
PIECE_BYTES = 1 << 20

#: Marks that a task holds at once, that a part of all has, about, and the least number of parts.
TASK_MARKS, PART_MARKS, LEAST_PARTS = 1 << 19, 1 << 17, 1 << 10

#: Sets of a group of candidates that one task compares with one another.
BLOCK_SETS = 256


class Rule:
    """Link rule: ``share`` hundredths of the union are common. Sizes, subsets and segments that follow from it."""

    def __init__(self, share: int, boundary: int = 0):
        self.share, self.boundary = share, boundary
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * CLASS_GROWTH)))

    def largest(self, size: int) -> int:
        """Largest partner of a set."""
        return size * 100 // self.share

    def smallest(self, size: int) -> int:
        return -(-size * self.share // 100)

    def apart(self, total: int) -> int:
        """Most shingles that are in one only of two linked sets of this total size."""
        return total * (100 - self.share) // (100 + self.share)

    def segments(self, number: int) -> int:
        """Segments of class ``number``: two linked sets agree in one at least that is not empty in both."""
        return math.ceil(SEGMENT_SLACK * (self.apart(2 * self.largest(self.edges[number + 1] - 1)) + 1)) + 1

    def needed(self, number: int) -> int:
        return self.apart(2 * self.largest(self.edges[number + 1] - 1)) + 1

    def classes(self, size: int) -> list[int]:
        """Classes a set belongs to: its own, and the one below if a partner may be of it."""
        own = int(np.searchsorted(self.edges, size, "right")) - 1
        return [own - 1, own] if own and self.smallest(size) < self.edges[own] else [own]

    def subset_sizes(self, size: int) -> range:
        """Sizes of the subsets by which a set meets partners of which the smaller is small."""
        return range(self.smallest(size), min(size, self.boundary) + 1)

    def subset_cost(self, size: int) -> float:
        return float(sum(math.comb(size, k) for k in self.subset_sizes(size)))

    def list_cost(self, size: int) -> float:
        return sum(self.segments(c) for c in self.classes(size)) * (1 + SCAN_COST)


def best_boundary(share: int, counts: dict[int, int]) -> int:
    """Size up to which sets meet by subsets: the one with the least total cost for these numbers of sets by size."""
    def total(boundary: int) -> float:
        rule = Rule(share, boundary)
        return sum(n * (rule.subset_cost(s) + (rule.list_cost(s) if s > boundary else 0)) for s, n in counts.items())

    return min(range(LARGEST_SMALL + 1), key=lambda b: (total(b), b))


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit value per set, equal for equal sets; 0 for an empty one."""
    key = RangeHash(values, seed=3).of(first[:-1], first[1:])
    return np.where(np.diff(first) > 0, key | np.uint64(1), np.uint64(0))


def subset_keys(rule: Rule, values: np.ndarray) -> list[int]:
    """Keys of all subsets of the sizes that count, by which shingles are left out."""
    size, total = len(values), int(values.sum(dtype=np.uint64))
    sizes = rule.subset_sizes(size)
    if not len(sizes):
        return []
    out = []
    numbers = values.tolist()
    for gone in range(size - sizes[-1], size - sizes[0] + 1):
        out += [(total - sum(left)) & 0xFFFFFFFFFFFFFFFF for left in itertools.combinations(numbers, gone)]
    return out


def join_keys(rule: Rule, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and number of the set for every list a set is in: subsets of small sets, segments of large ones.

    With each the kind of list (the class, -1 for subsets, less for empty segments), and in how many lists of
    this kind the set must meet others: a partner differs in so many segments at most, and agrees in the rest.
    """
    sizes = np.diff(first)
    keys, owners, needs, kinds = [np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))
    spread = mixed(values + np.uint64(5))
    for i in np.flatnonzero((sizes > 0) & (sizes <= rule.largest(rule.boundary))):
        found = np.array(subset_keys(rule, spread[first[i]:first[i + 1]]), np.uint64)
        keys.append(mixed(found + np.uint64(0x51)))
        owners.append(np.full(len(found), i))
        needs.append(np.ones(len(found), np.int64))
        kinds.append(np.full(len(found), -1))
    large = np.flatnonzero(sizes > rule.boundary)
    number, owner = [], []
    for i in large:
        for c in rule.classes(int(sizes[i])):
            number.append(c)
            owner.append(i)
    number, owner = np.array(number, np.int64), np.array(owner, np.int64)
    for c in np.unique(number):
        sets = owner[number == c]
        m = rule.segments(int(c))
        size = sizes[sets]
        which = np.repeat(np.arange(len(sets)), size)
        at = np.repeat(first[sets] - (np.cumsum(size) - size), size) + np.arange(len(which))
        # sets are sorted by hash, so that a segment, a range of hashes, is a run of them
        segment = ((values[at] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place = which * np.int64(m) + segment.astype(np.int64)
        edge = np.flatnonzero(np.diff(place, prepend=-1))
        content = np.add.reduceat(spread[at], edge) if len(edge) else np.zeros(0, np.uint64)
        tag = (segment[edge] + np.uint64(int(c) << 32)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(mixed(content ^ mixed(tag)))
        owners.append(sets[which[edge]])
        # a set with too many empty segments can agree in empty ones only, with another such set
        filled = np.bincount(which[edge], minlength=len(sets))
        most = np.array([rule.apart(s + rule.largest(s)) for s in size.tolist()])
        needs.append(np.maximum(filled - most, 1)[which[edge]])
        kinds.append(np.full(len(edge), c))
        for j in np.flatnonzero(filled < rule.needed(int(c))):
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), segment[edge][which[edge] == j])
            keys.append(mixed(mixed((empty + np.uint64(int(c) << 32)) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0xE)))
            owners.append(np.full(len(empty), sets[j]))
            needs.append(np.ones(len(empty), np.int64))
            kinds.append(np.full(len(empty), -2 - c))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(needs), np.concatenate(kinds)


def describer(width: int):
    """Task: size and key of the set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE_BYTES):
            values, first = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_shingles": np.diff(first),
                "set_id": signed(set_keys(values, first))})

    return run


def pieces_of(batches: Iterator[pa.RecordBatch], chosen) -> Iterator[pa.RecordBatch]:
    """The documents that may stand for their set, in pieces."""
    for batch in chunks(batches, "text", PIECE_BYTES):
        batch = batch.filter(pa.array(maybe(chosen.value, batch.column("key").to_numpy())))
        if batch.num_rows:
            yield batch


def packed(marks: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the marks, what is above their lower 32 bits; of equal ones two say as much as more."""
    marks = np.sort(marks)
    keep = np.ones(len(marks), bool)
    keep[2:] = marks[2:] != marks[:-2]
    marks = marks[keep]
    part = (marks >> np.uint64(32)).astype(np.int64)
    low = (marks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    rows = [low[i:j].tobytes() for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(low)], strict=True)]
    return pa.RecordBatch.from_pydict({"part": pa.array(part[edge]), "marks": pa.array(rows, pa.binary())})


def marker(width: int, share: int, boundary: int, chosen, shift: int):
    """Task: the marks of the lists that its sets are in, the upper bits of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(share, boundary)
        held: list[np.ndarray] = []
        for batch in pieces_of(batches, chosen):
            held.append(join_keys(rule, *shingle_sets(batch.column("text"), width))[0] >> np.uint64(shift))
            if sum(map(len, held)) >= TASK_MARKS:
                yield packed(np.concatenate(held))
                held = []
        if any(map(len, held)):
            yield packed(np.concatenate(held))

    return run


def repeated_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: marks that occur more than once in its parts; the rows of a part come one after another."""

    def repeated(part: int, rows: list[bytes]) -> pa.RecordBatch:
        low = np.sort(np.frombuffer(b"".join(rows), np.uint32))
        again = np.unique(low[1:][low[1:] == low[:-1]])
        return pa.RecordBatch.from_pydict({"mark": again.astype(np.int64) | (part << 32)})

    at, held = -1, []
    for batch in batches:
        for part, row in zip(batch.column("part").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            if part != at and held:
                yield repeated(at, held)
                held = []
            at = part
            held.append(row)
    if held:
        yield repeated(at, held)


def mark_shift(total: float) -> int:
    """Bits of a key that its mark leaves out: the more marks, the more parts of some ``PART_MARKS`` each."""
    parts = max(LEAST_PARTS, math.ceil(total / PART_MARKS))
    return max(1, 32 - (parts - 1).bit_length())


def lister(width: int, share: int, boundary: int, chosen, wanted, shift: int):
    """Task: the rows of the inverted lists whose mark may be wanted, with what they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(share, boundary)
        for batch in pieces_of(batches, chosen):
            values, first = shingle_sets(batch.column("text"), width)
            key, owner, need, kind = join_keys(rule, values, first)
            keep = np.flatnonzero(maybe(wanted.value, key >> np.uint64(shift)))
            yield pa.RecordBatch.from_pydict({
                "key": signed(key[keep]), "set_id": signed(set_keys(values, first)[owner[keep]]),
                "need": need[keep].astype(np.int32), "kind": kind[keep].astype(np.int32)})

    return run


def set_reader(width: int, chosen, wanted):
    """Task: the whole sets of documents whose set may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, chosen):
            values, first = shingle_sets(batch.column("text"), width)
            key = set_keys(values, first)
            keep = np.flatnonzero(maybe(wanted.value, key) & (key != 0))
            lists = [signed(values[first[i]:first[i + 1]]).tobytes() for i in keep]
            yield pa.RecordBatch.from_pydict({"set_id": pa.array(signed(key[keep])), "shingles": pa.array(lists, pa.binary())})

    return run


def linked(rule: Rule, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected, among sets of a group; if it has two sides, between those.

    A sketch of segment sums comes first: sets differ in as many shingles at least as segments. What it leaves
    is compared in full, except for pairs that are connected already.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    width = 256
    while width < min(1 << 13, 2 * rule.apart(2 * int(sizes.max()))):
        width *= 2
    sketch = np.zeros((n, width), np.uint8)
    for i, s in enumerate(sets):
        np.add.at(sketch[i], (s >> np.uint64(32)) % np.uint64(width), (mixed(s) & np.uint64(255)).astype(np.uint8))
    both = len(set(sides.tolist())) > 1
    label = np.arange(n)
    found = []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        open_ = (100 * low >= rule.share * high) & (label[rest] != label[i])
        rest = rest[open_ & (sides[rest] != sides[i])] if both else rest[open_]
        for a in range(0, len(rest), 512):
            some = rest[a:a + 512]
            limit = (sizes[some] + sizes[i]) * (100 - rule.share) // (100 + rule.share)
            for j in some[(sketch[some] != sketch[i]).sum(axis=1) <= limit]:
                if label[j] == label[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= rule.share * (sizes[i] + sizes[j] - common):
                    found.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return found


def comparer(share: int):
    """Task: links within each group of candidates; groups come one after another."""

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        ids = [r["set_id"] for r in rows]
        return [(ids[a], ids[b]) for a, b in linked(Rule(share), sets, np.array([r["side"] for r in rows]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["group"], held[0]["pair"]) != (row["group"], row["pair"]):
                    out += links(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})
                out = []
        if held:
            out = links(held)
            if out:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})

    return run


def rarest_lists(members: DataFrame) -> DataFrame:
    """``key``, ``set_id``: of the lists that a set shares, the rarest in which it must meet every partner.

    ``members`` (``key``, ``set_id``, ``kind``, ``need``) has each set once in a list. Linked sets share ``need``
    lists of a kind at least. With lists in one order for all sets, here by size and key, the first that two linked
    sets share is among the first ``n - need + 1`` of the ``n`` of either; a set with fewer than ``need`` has no
    partner. Lists of a common passage, which chain unlike texts to one large group, come last and are left out.
    """
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    own = Window.partitionBy("set_id", "kind")
    ranked = members.join(shared, "key").select(
        "key", "set_id", "need", F.row_number().over(own.orderBy("sets", "key")).alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    return ranked.filter("place <= n - need + 1").select("key", "set_id")


def similar_groups(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """Groups of similar documents: ``doc_id``, ``n_shingles``, ``component_id``, ``key``, ``set_id``, ``label``.

    A document's set holds its distinct shingles of ``width`` words (of fewer words, all of them as one; of none,
    nothing). Two documents are linked when ``100 * common >= share * union``. ``component_id`` is the smallest
    ``doc_id`` that links lead to. Equal sets have the same ``set_id``; an empty set (0) is linked with nothing.
    ``label`` is the same within a group and in no other; ``key`` is a hash of id and text.

    Nulls: a null text has an empty set; a null ``doc_id`` is never a component's id unless there is no other.
    Repeated rows are copies of one another. Only ``doc_id`` and ``text`` are read. Empty tables stay empty.

    * Equal sets are one from the start, by their 64-bit key. Copies are never paired.
    * Small sets meet by their subsets of each size that an overlap may have. Large ones are cut into segments by
      hash, one more than the shingles in which two linked sets can differ, so that they agree in one; sets are in
      an inverted list for each segment's content. Lists of single shingles would hold a third of all documents
      where a passage is common; lists of segments hold only texts that agree around it, too. The boundary between
      small and large is the one of least cost for the sizes counted.
    * Lists are first told by marks, upper bits of their keys that are sent packed; only what may be in a list whose
      mark occurs twice becomes a row. Lists with one set only are dropped. A set that is left in fewer lists than
      it must share with any partner has none and is dropped, too. Of the others'
      lists the rarest stay, as many as it takes to meet every partner (``rarest_lists``). These give each set a link
      to the least one: a star, no pairs. Connected stars are a group of candidates.
    * Groups are compared in blocks of bounded size, with whole sets, and each task gives only the links that
      connect. No candidate is left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    plain = texts.select("key", "text")
    about = stage_table(texts.mapInArrow(describer(width), "doc_id bigint, key bigint, n_shingles bigint, set_id bigint"), "sets")
    limit = Rule(share).largest(LARGEST_SMALL)
    sizes = about.filter(F.col("n_shingles").between(1, limit)).groupBy("n_shingles").agg(F.count(F.lit(1)))
    counts = {int(s): int(n) for s, n in sizes.collect()}
    boundary = best_boundary(share, counts)
    shingles = about.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shift = mark_shift(shingles + sum(n * Rule(share, boundary).subset_cost(s) for s, n in counts.items()))

    # one document stands for all of its set; where the filter lets copies through they do no harm
    chosen = value_filter(about.filter("set_id <> 0").groupBy("set_id").agg(F.min("key").alias("key")).select("key"))
    marks = plain.mapInArrow(marker(width, share, boundary, chosen, shift), "part bigint, marks binary")
    marks = marks.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(repeated_marks, "mark bigint")
    wanted = value_filter(stage_table(marks, "marks"))
    members = plain.mapInArrow(
        lister(width, share, boundary, chosen, wanted, shift), "key bigint, set_id bigint, need int, kind int")
    members = stage_table(members.distinct(), "members")
    members = stage_table(rarest_lists(members), "rarest")
    least = stage_table(members.groupBy("key").agg(F.min("set_id").alias("least")), "least")
    stars = members.join(least, "key").filter("set_id <> least").select(F.col("least").alias("a"), F.col("set_id").alias("b")).distinct()
    groups = connected_components(stars).select(F.col("id").alias("set_id"), F.col("label").alias("group"))

    whole = plain.mapInArrow(set_reader(width, chosen, value_filter(groups.select("set_id"))), "set_id bigint, shingles binary")
    whole = whole.groupBy("set_id").agg(F.min("shingles").alias("shingles"))
    blocks = stage_table(groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks")), "blocks")
    placed = groups.join(blocks, "group").withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    # a set goes to its own block and to one task for each other block of its group
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.select("set_id", "group", "side", other.alias("other")).select(
        "set_id", "group", "side", (F.least("side", "other").cast("bigint") * (1 << 31) + F.greatest("side", "other")).alias("pair"))
    tasks = pairs.join(whole, "set_id").repartition(F.col("group"), F.col("pair")).sortWithinPartitions("group", "pair", "side", "set_id")
    found = stage_table(tasks.select("group", "pair", "side", "set_id", "shingles").mapInArrow(comparer(share), "a bigint, b bigint"), "found")

    labels = connected_components(found)
    ids = stage_table(about.filter("set_id <> 0").groupBy("set_id").agg(F.min("doc_id").alias("least_doc")), "ids")
    named = ids.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = stage_table(named.groupBy("label").agg(F.min("least_doc").alias("component_id")), "smallest")
    classes = stage_table(named.join(smallest, "label").select("set_id", "label", "component_id"), "classes")
    columns = ["doc_id", "n_shingles", "component_id", "key", "set_id", "label"]
    alone = about.filter("set_id = 0").withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("bigint")})
    return about.filter("set_id <> 0").join(classes, "set_id").select(*columns).union(alone.select(*columns))


def one_of_each_group(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """The document with the smallest ``doc_id`` of each group of similar ones, with all its columns.

    Documents without words are similar to nothing and stay. Of repeated rows one stays.
    """
    similar = similar_groups(docs, width, share).filter("set_id <> 0")
    # a null id comes last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    kept = similar.groupBy("label").agg(first).select(F.col("first.key").alias("similar_key"))
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = docs.filter(worded).select(as_row(docs.columns), F.xxhash64("doc_id", "text").alias("similar_key"))
    chosen = rows.join(stage_table(kept, "kept"), "similar_key").dropDuplicates(["similar_key"])
    return chosen.select("row.*").union(docs.filter(~worded))
