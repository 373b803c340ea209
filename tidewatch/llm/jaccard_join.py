"""N-gram Jaccard self-join with a grouped prefix filter.

A document is the set of its distinct shingles, each a 64-bit hash. Two documents link when 100 * intersection >= percent * union.

1. Frequent shingles are found by counts over all documents in a table of fixed size. All sets are ordered by (frequency class, hash), rare ones first.
   The class only sets the order; any order gives the same links.
2. Documents with equal sets are one class, represented by the smallest doc_id. Classes with the same size and the same prefix form
   a group.
3. Each group sends the shingles of its prefix to buckets, whose number grows with the prefixes' bytes; a shingle whose count says that its
   list is long goes to several. A bucket keeps the shingles that groups of compatible size share. Shingles whose lists have the same
   groups, such as those of one passage, become one list with each group's first position, which loses no pair.
4. The groups of a shingle's list meet the list's leader. The different pairs of groups that sizes and positions let link are expanded
   to pairs of members, which are verified: first by parity sketches, whose distance is never more than the symmetric difference
   of the sets, so that no link is lost, then on whole sets. Once more, members that aren't connected with the most linked member of
   their list meet that one.
5. The lists whose members aren't all connected yet are cut by size and into blocks of bounded number and bytes. Two blocks meet in a
   unit of work, but the members of a list's largest component never meet each other. A unit compares sketches, and those that may link
   meet again with their whole sets, of which a unit returns a spanning forest of its links: never more rows than it has members.
   So no link between components is missed, and rows don't grow with the square of a group.
6. Links give connected components; the component is the smallest doc_id in it.

A shingle is a 64-bit hash of its words, of which 58 bits are kept beside the frequency class: sets are equal when these are.

Defined cases: a null text or one without words has an empty set, links with nothing and is its own component; a text with fewer words
than a shingle is one shingle; rows that share a doc_id are one document in the links and each keeps its row; a row with a null doc_id
links nothing, has the component of a document with an equal set, and else null; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined_labels
from .shared import LOWER_ASCII, joined_bytes, mix, salted_join, saved, slices, tidy, whole_groups, windows, with_columns, word_hashes, word_spans

SHINGLE_WORDS = 3
PERCENT = 90
#: Cells of the table of shingle counts, a fixed number whatever the input; tasks send it in slices.
CELL_BITS = 22
SLICES = 256

#: Members of a list, and bytes of their sets, that one block of the last step holds at most, but for chance.
BLOCK_MEMBERS = 512
BLOCK_BYTES = 8 << 20
#: Rows of prefix shingles in a bucket, 24 bytes each, and of one shingle beyond which it goes to several.
LIST_ROWS = 1 << 19
#: Entries of a list up to which they are compared by pairs side by side with other lists; longer ones by rows.
MET_LIST = 64
#: Bytes of sketches that are compared in one step.
STEP_BYTES = 16 << 20
#: Counted doc_ids (8 bytes each) up to which those whose sets are wanted go to the texts; beyond, the texts are joined with them.
BROADCAST_IDS = 500_000

_SHORT = np.uint64(0xA24BAED4963EE407)


def shingle_hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The hashes of each text's shingles, repeats included."""
    data, offsets = joined_bytes(texts)
    data = LOWER_ASCII[data]
    starts, ends, docs = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    hashes, first = windows(words, docs, size)
    n = len(texts)
    cuts = np.searchsorted(docs[first] if len(first) else np.zeros(0, np.int64), np.arange(n + 1))
    word_cuts = np.searchsorted(docs, np.arange(n + 1))
    out = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for k in np.flatnonzero((np.diff(word_cuts) > 0) & (np.diff(word_cuts) < size)):
        h = _SHORT
        for w in words[word_cuts[k] : word_cuts[k + 1]]:
            h = mix(np.array([h ^ w]))[0]
        out[k] = np.array([h], np.uint64)
    return out


def ordered_set(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Distinct shingles as (class, 58 bits of the hash), ascending: rare shingles first."""
    return np.unique((classes[hashes >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(58)) | (hashes & np.uint64((1 << 58) - 1)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def may_link(n, pos, o, pos2, percent: int):
    """Whether sets of sizes n and o whose first common shingle is at pos and pos2 can link: what is left of both must hold the overlap
    that a link needs. A pair that fails at a later common shingle was met at its first. For numbers, arrays or columns alike."""
    return (100 * n >= percent * o) & (100 * o >= percent * n) & ((100 + percent) * (n - pos) >= percent * (n + o)) & ((100 + percent) * (o - pos2) >= percent * (n + o))


def _count_codes(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: those below 128 as they are, greater ones by sixteenths of their logarithm."""
    large = 128 + np.minimum(16 * np.log2(np.maximum(counts, 128) / 128), 127)
    return np.where(counts < 128, counts, large).astype(np.uint8)


_COUNT_OF = np.where(np.arange(256) < 128, np.arange(256), 128 * 2.0 ** ((np.arange(256) - 128) / 16)).astype(np.int64)


def frequency_classes(documents: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each cell, 0 for all that don't stand out from the mean, 4 MB at any input; and of each class about the most that a cell
    of it counts.

    Every task sends its counts, a byte each, in slices; a slice's counts are added up as they arrive, so that a task holds one sum
    for each of its slices. The driver gets the sums, 32 MB at any input.
    """
    wide = (1 << CELL_BITS) // SLICES

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                every = np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(part.column("text"), size)])
                np.add.at(counts, every >> np.uint64(64 - CELL_BITS), 1)
        sent = _count_codes(counts).reshape(SLICES, wide)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in sent], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + _COUNT_OF[np.frombuffer(raw, np.uint8)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    sums = np.zeros((SLICES, wide), np.int64)
    for k, raw in documents.select("text").mapInArrow(tidy(cells), kind).repartition("slice").mapInArrow(tidy(add), kind).collect():  # SLICES rows
        sums[k] = np.frombuffer(raw, "<i8")
    sums = sums.reshape(-1)
    least = sums.mean() + 4 * np.sqrt(sums.mean()) + 2
    classes = np.where(sums > least, np.clip(1 + 4 * np.log2(np.maximum(sums, 1) / least), 1, 63), 0).astype(np.uint8)
    most = np.zeros(64, np.int64)
    np.maximum.at(most, classes, sums)
    return classes, most


def parity_sketch(keys: np.ndarray) -> np.ndarray:
    """Bits that each tell whether an odd number of keys falls on them; about two bits a key, a power of two and 256 at least."""
    bits = max(256, 1 << int(2 * len(keys) - 1).bit_length())
    return np.packbits(np.bincount((mix(keys) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def fingerprints(documents: DataFrame, size: int, percent: int, classes) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hashes of the whole set), prefix and sketch (its size in eight bytes first) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = classes.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [ordered_set(h, rank) for h in shingle_hashes(part.column("text"), size)]
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([mix(s ^ _SHORT).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                prefix = [s[: prefix_length(len(s), percent)].tobytes() if len(s) else None for s in sets]
                sketch = [np.int64(len(s)).tobytes() + parity_sketch(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "prefix", "sketch"])

    return documents.mapInArrow(tidy(rows), "doc_id long, n_shingles long, h1 long, h2 long, prefix binary, sketch binary")


def shared_postings(groups: DataFrame, percent: int, most: np.ndarray, parts: int) -> DataFrame:
    """token, gid, n, pos of the prefix shingles that two groups share whose sizes and positions let them link; token names a list of groups,
    that of all shingles with the same groups. `most` bounds the count of each class of shingles, `parts` is the least number of buckets.

    A bucket's rows are LIST_ROWS on average. A shingle that may have more goes to several buckets by its groups' hash and is kept whole, as none of them
    sees all of its list; so the most common shingle of a corpus is no task's alone."""
    shares = np.maximum(-(-most // LIST_ROWS), 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(p, "<u8") for p in batch.column("prefix").to_pylist()]
            length = np.array([len(t) for t in tokens], np.int64)
            token = np.concatenate([np.zeros(0, np.uint64), *tokens])
            gid, n = (np.repeat(batch.column(c).to_numpy(), length) for c in ("gid", "n"))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            several = shares[token >> np.uint64(58)]
            share = np.where(several > 1, 1 + (mix(gid.astype(np.uint64)) % several.astype(np.uint64)).astype(np.int64), 0)  # 0: whole in its bucket
            for k in range(0, max(len(token), 1), 65_536):
                own = slice(k, k + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(token[own].view(np.int64)), pa.array(share[own].astype(np.int32)), pa.array(gid[own]), pa.array(n[own].astype(np.int32)), pa.array(pos[own].astype(np.int32))], ["token", "share", "gid", "n", "pos"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if not every:
            return
        table = pa.Table.from_batches(every)
        token, share, gid, n, pos = (table.column(c).to_numpy() for c in ("token", "share", "gid", "n", "pos"))
        order = np.lexsort((n, token))
        token, share, gid, n, pos = token[order], share[order], gid[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        last = np.append(np.flatnonzero(token[1:] != token[:-1]), len(token) - 1)
        runs = np.diff(last, prepend=-1)
        size = np.repeat(runs, runs)
        left = np.repeat(last, runs) - np.arange(len(token))  # entries of the list that follow
        keep = (size > MET_LIST) | (share > 0)
        for step in range(1, MET_LIST):
            a = np.flatnonzero((left >= step) & ~((size > MET_LIST) | (share > 0)))
            if not len(a):
                break
            fit = a[may_link(n[a], pos[a], n[a + step], pos[a + step], percent)]
            keep[fit] = keep[fit + step] = True
        token, share, gid, n, pos = token[keep], share[keep], gid[keep], n[keep], pos[keep]
        if len(token):
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            same = np.bitwise_xor.reduceat(mix(gid.astype(np.uint64) ^ _SHORT), first)
            whole = share[first] == 0
            names = np.where(whole, same, mix(token[first].view(np.uint64)))  # equal names only add pairs
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, np.diff(np.append(first, len(token)))).view(np.int64)), pa.array(gid), pa.array(n), pa.array(pos)], ["token", "gid", "n", "pos"])

    entries = groups.agg(F.sum(F.octet_length("prefix").cast("long"))).first()[0] or 0
    buckets = max(parts, -(-entries // 8 // LIST_ROWS))
    sent = groups.select("gid", "n", "prefix").mapInArrow(tidy(send), "token long, share int, gid long, n int, pos int").repartition(int(buckets), "token", "share")
    met = sent.mapInArrow(tidy(meet), "token long, gid long, n long, pos long")
    return met.groupBy("token", "gid").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))


class Sketches:
    """Parity sketches of many sets, those of a width side by side, and sums over pairs of them."""

    def __init__(self, sketches: list[np.ndarray]):
        width = np.array([len(x) for x in sketches], np.int64)
        self.width, self.place, self.of = width, np.zeros(len(width), np.int64), {}
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            self.place[own] = np.arange(len(own))
            self.of[int(w)] = np.stack([sketches[k] for k in own]).view(np.uint64)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that differ for each pair, at most the symmetric difference. The longer sketch is folded to the length of the shorter."""
        a, b = np.where(self.width[a] >= self.width[b], a, b), np.where(self.width[a] >= self.width[b], b, a)
        out = np.zeros(len(a), np.int64)
        pair = self.width[a] * (1 << 32) + self.width[b]
        for key in np.unique(pair):
            p, q = int(key) >> 32, int(key) & 0xFFFFFFFF
            own = np.flatnonzero(pair == key)
            step = max(1, STEP_BYTES // p)
            for k in range(0, len(own), step):
                i = own[k : k + step]
                x = np.bitwise_xor.reduce(self.of[p][self.place[a[i]]].reshape(len(i), p // q, -1), axis=1)
                out[i] = np.bitwise_count(x ^ self.of[q][self.place[b[i]]]).sum(axis=1, dtype=np.int64)
        return out


def n_common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verified(pairs: DataFrame, sketches: DataFrame, whole_sets, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Sketches (rep, sketch) leave few; only of these are whole sets made, by whole_sets(ids)."""

    def with_both(some: DataFrame, table: DataFrame, column: str) -> DataFrame:
        # joins can be split where an end has very many pairs
        left, right = table.select(F.col("rep").alias("a"), F.col(column).alias("x")), table.select(F.col("rep").alias("b"), F.col(column).alias("y"))
        return some.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [*batch.column("x"), *batch.column("y")]
            n = np.array([np.frombuffer(r.as_buffer(), "<i8", 1)[0] for r in raw], np.int64)
            k = np.arange(len(batch))
            apart = Sketches([np.frombuffer(r.as_buffer(), np.uint8, offset=8) for r in raw]).distance(k, k + len(k))
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * (n[: len(k)] + n[len(k) :])))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = n_common(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = saved(with_both(pairs, sketches, "sketch").mapInArrow(tidy(near), "a long, b long").distinct(), "near-pairs")
    ids = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return with_both(left, whole_sets(ids), "members").mapInArrow(tidy(link), "a long, b long").distinct()


def _unit_pairs(n: np.ndarray, pos: np.ndarray, label: np.ndarray, side: np.ndarray, unit: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of a unit with different labels that sizes and positions let link; rows are sorted by unit. A member on side 0
    meets those on side 1, and on side 2 all members of a unit meet each other. Short units are taken side by side, long ones by rows."""

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (label[a] != label[b]) & ((side[a] == 2) | (side[a] != side[b])) & may_link(n[a], pos[a], n[b], pos[b], percent)

    first = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
    size = np.diff(np.append(first, len(unit)))
    left = np.repeat(first + size, size) - np.arange(len(unit))
    short = np.repeat(size <= MET_LIST, size)
    for step in range(1, MET_LIST):
        a = np.flatnonzero(short & (left > step))
        if not len(a):
            break
        good = fit(a, a + step)
        if good.any():
            yield a[good], a[good] + step
    for start, count in zip(first[size > MET_LIST], size[size > MET_LIST], strict=True):
        every = np.arange(start, start + count)
        for k in range(0, count, 64):
            own = every[k : k + 64]
            a, b = np.repeat(own, count), np.tile(every, len(own))
            a, b = a[a < b], b[a < b]
            good = fit(a, b)
            if good.any():
                yield a[good], b[good]


def open_links(rows: DataFrame, sketches: DataFrame, whole_sets, percent: int, parts: int) -> DataFrame:
    """Links (a, b) that connect what the members of lists (token, rep, n, pos, label) have with different labels, in blocks."""
    # sizes of a link differ by at most one of these steps: a member goes to the two lists of its step
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * float(np.log(100 / percent))))
    cut = rows.withColumn("token", F.explode(F.array(F.xxhash64("token", step), F.xxhash64("token", step - 1))))
    labels = cut.groupBy("token", "label").agg(F.count("*").alias("k"), F.sum("n").alias("bytes"))
    sums = labels.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max(F.struct("k", "label", "bytes")).alias("x"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes"))

    def blocks(k, size):
        return F.greatest(F.ceil(k / BLOCK_MEMBERS), F.ceil(8 * size / BLOCK_BYTES), F.lit(1)).cast("long")

    sums = sums.where("x.k < k").select("token", "main", blocks(F.col("x.k"), F.col("x.bytes")).alias("n_main"), blocks(F.col("k") - F.col("x.k"), F.col("bytes") - F.col("x.bytes")).alias("n_minor"))
    dealt = salted_join(cut, sums, ["token"], ["rep"])
    minor = F.col("label") != F.col("main")
    block = F.pmod(F.xxhash64("rep"), F.when(minor, F.col("n_minor")).otherwise(F.col("n_main")))
    dealt = dealt.select("token", "rep", "n", "pos", "label", minor.alias("minor"), block.alias("own"), "n_main", "n_minor")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    other = F.when(F.col("minor"), F.concat(F.transform(each(F.col("n_main")), lambda i: F.struct(F.lit(True).alias("main"), i.alias("k"))), F.transform(each(F.col("n_minor")), lambda i: F.struct(F.lit(False).alias("main"), i.alias("k")))))
    dealt = dealt.withColumn("other", F.explode(other.otherwise(F.transform(each(F.col("n_minor")), lambda i: F.struct(F.lit(False).alias("main"), i.alias("k"))))))
    with_main = ~F.col("minor") | F.col("other.main")
    low = F.when(with_main, F.when(F.col("minor"), F.col("other.k")).otherwise(F.col("own"))).otherwise(F.least("own", "other.k"))
    high = F.when(with_main, F.when(F.col("minor"), F.col("own")).otherwise(F.col("other.k"))).otherwise(F.greatest("own", "other.k"))
    side = F.when(with_main, F.col("minor").cast("int")).when(F.col("own") == F.col("other.k"), 2).otherwise((F.col("own") > F.col("other.k")).cast("int"))
    units = dealt.select(F.xxhash64("token", with_main, low, high).alias("unit"), "rep", "n", "pos", "label", side.alias("side"))

    def columns(table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in ("n", "pos", "label", "side", "unit")]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit"):
            n, *rest = columns(table)
            sketch = Sketches([np.frombuffer(x.as_buffer(), np.uint8, offset=8) for x in table.column("sketch")])
            keep = np.zeros(len(n), bool)
            for a, b in _unit_pairs(n, *rest, percent):
                near = (100 + percent) * sketch.distance(a, b) <= (100 - percent) * (n[a] + n[b])
                keep[a[near]] = keep[b[near]] = True
            yield from table.drop_columns(["sketch"]).filter(pa.array(keep)).to_batches()

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit"):
            n, pos, label, side, unit = columns(table)
            rep = table.column("rep").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("members")]
            sketch = Sketches([parity_sketch(x) for x in sets])
            _, root = np.unique(np.stack((unit, label)), axis=1, return_inverse=True)
            root = root.reshape(-1)
            links: list[tuple[int, int]] = []
            for a, b in _unit_pairs(n, pos, label, side, unit, percent):
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                near = (100 + percent) * sketch.distance(a, b) <= (100 - percent) * (n[a] + n[b])
                for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    if root[i] != root[j]:
                        common = n_common(sets[i], sets[j])
                        if 100 * common >= percent * (int(n[i]) + int(n[j]) - common):
                            links.append((int(rep[i]), int(rep[j])))
                            root[root == root[j]] = root[i]
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=1, initial=2**63 - 1)), pa.array(found.max(axis=1, initial=-(2**63)))], ["a", "b"])

    def in_units(some: DataFrame) -> DataFrame:
        return some.repartition(parts, "unit").sortWithinPartitions("unit")

    kind = "unit long, rep long, n long, pos long, label long, side int"
    left = saved(in_units(units.join(sketches, "rep").select("unit", "rep", "n", "pos", "label", "side", "sketch")).mapInArrow(tidy(suspects), kind), "suspects")
    sets = whole_sets(left.select(F.col("rep").alias("doc_id")).distinct())
    with_sets = left.join(sets, "rep").select("unit", "rep", "n", "pos", "label", "side", "members")
    return in_units(with_sets).mapInArrow(tidy(forests), "a long, b long")


def near_duplicates(documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = documents.sparkSession
    docs = with_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found, most = frequency_classes(docs, size)
    classes = spark.sparkContext.broadcast(found)  # 4 MB at any input
    prints = saved(fingerprints(docs, size, percent, classes), "fingerprints")

    full = prints.where("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("doc_id", "prefix", "sketch")).alias("x"))
    same = saved(same.select(F.col("n_shingles").alias("n"), "h1", "h2", F.col("x.doc_id").alias("rep"), F.col("x.prefix").alias("prefix"), F.col("x.sketch").alias("sketch")), "classes")
    groups = saved(same.groupBy("n", "prefix").agg(F.min("rep").alias("gid"), F.count("*").alias("n_members")), "groups")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = saved(shared_postings(groups, percent, most, buckets), "postings")

    # expansion of groups to members: a group of one is its only member; others are looked up by their prefix
    several = groups.where("n_members > 1").select("n", "prefix", "gid")
    members = saved(same.join(several, ["n", "prefix"]).select("gid", "rep", "n"), "members")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = classes.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [ordered_set(h, rank).tobytes() for h in shingle_hashes(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["rep", "members"])

    repeats = _repeats(full)

    def whole_sets(ids: DataFrame) -> DataFrame:
        ids = saved(ids, "wanted")
        wanted = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        # a document of several rows has a set for each, and links where one of them does
        return saved((wanted.dropDuplicates(["doc_id", "text"]) if repeats else wanted).mapInArrow(tidy(whole), "rep long, members binary"), "sets")

    sketches = same.select("rep", "sketch")
    fits = may_link(F.col("n"), F.col("pos"), F.col("o"), F.col("pos2"), percent)

    # pairs of groups: each list's groups with its leader, the group of the smallest hash, so that lists with the same groups have the same
    order = F.struct(F.xxhash64("gid").alias("h"), "gid", F.col("n").alias("o"), F.col("pos").alias("pos2"))
    lead = postings.groupBy("token").agg(F.min(order).alias("x")).select("token", F.col("x.gid").alias("lead"), "x.o", "x.pos2")
    group_pairs = saved(salted_join(postings, lead, ["token"], ["gid"]).where((F.col("gid") != F.col("lead")) & fits).select("gid", "lead").distinct(), "group-pairs")
    expanded = group_pairs.join(members.select("gid", "rep"), "gid", "left").select(F.coalesce("rep", "gid").alias("x"), F.col("lead").alias("y"))
    expanded = expanded.unionByName(members.where("rep <> gid").select(F.col("rep").alias("x"), F.col("gid").alias("y")))
    star = saved(expanded.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "star-pairs")
    links = saved(verified(star, sketches, whole_sets, percent), "links")
    if repeats:  # the classes of a document's rows are connected through it
        often = full.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
        owner = same.select(F.col("n").alias("n_shingles"), "h1", "h2", "rep")
        links = saved(links.unionByName(full.join(often, "doc_id").join(owner, ["n_shingles", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()), "links")
    labels = components(links)

    # lists of members, those of a group among them
    listed = postings.join(members.select("gid", "rep"), "gid", "left").select("token", F.coalesce("rep", "gid").alias("rep"), "n", "pos")
    within = members.select(F.xxhash64("gid", F.lit("group")).alias("token"), "rep", "n", F.lit(0).cast("long").alias("pos"))
    lists = listed.unionByName(within)

    def still_open(rows: DataFrame) -> DataFrame:
        """The lists whose members aren't all connected yet, with the label (component so far) of each member."""
        own = labels.select(F.col("id").alias("rep"), "component")
        rows = saved(rows.join(own, "rep", "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("label")), "labelled")
        ends = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        return saved(salted_join(rows, ends, ["token"], ["rep"], "left_semi"), "open")

    rest = still_open(lists)
    degrees = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    order = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.xxhash64("rep").alias("h"), F.col("rep").alias("lead"), F.col("n").alias("o"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
    lead = rest.join(degrees, "rep", "left").groupBy("token").agg(F.min(order).alias("x")).select("token", "x.lead", "x.o", "x.pos2", "x.label2")
    star = salted_join(rest, lead, ["token"], ["rep"]).where((F.col("label") != F.col("label2")) & fits).select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    labels = joined_labels(labels, saved(verified(saved(star, "star-pairs"), sketches, whole_sets, percent), "links"))

    rest = still_open(rest.drop("label"))
    labels = joined_labels(labels, saved(open_links(rest, sketches, whole_sets, percent, buckets), "links"))

    owner = same.select(F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rep")
    owner = owner.join(labels, F.col("rep") == F.col("id"), "left").select("_n", "_h1", "_h2", F.coalesce("component", "rep").alias("label"))
    out = prints.join(owner, (F.col("n_shingles") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _repeats(prints: DataFrame) -> bool:
    """Whether a doc_id occurs more than once."""
    return bool(prints.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count())


def keep_one(documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a document of their component with a smaller doc_id stands for; all columns are kept.

    Rows that share a doc_id are one document and stay or go together.
    """
    found = near_duplicates(documents, size, percent)
    gone = saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return documents.join(gone, documents["doc_id"].cast("long") == gone["_gone"], "left_anti")
