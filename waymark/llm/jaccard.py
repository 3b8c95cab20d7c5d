"""Exact Jaccard join of documents over word n-grams, as a metric-space join.

1 - Jaccard similarity is a metric, so a link within radius r obeys the triangle inequality for every
pivot. Pivots drawn at random cannot cut a corpus, as unrelated texts all lie at distance 1 from them
and from each other; so pivots are drawn where they are near something:

1. Points. Documents with equal sets are one point, whatever their number.
2. Pivots. The universe of a size region (sizes within 2:1; a set whose window reaches below its region
   joins the one below too) is dealt into parts by hash. Linked sets differ in at most D elements,
   hence in at most D parts; of the first D + 1 parts that either has, one is equal in both and not
   empty. The least point of those that share a part becomes a pivot, and they join its cell. Any two
   linked points so share a cell.
3. Sketches. How many elements a set has in each of SKETCH hash classes embeds it in a space in which no
   two sets lie further apart than they are. Points of a cell that are too far apart in that space are
   not linked; what is connected below that distance makes a smaller cell, with its least point as the
   pivot, and points without any such neighbour drop out before a set is shipped.
4. Cells. The distance of each point to its cell's pivot is computed exactly. Points within r of it are
   linked to it and thus with each other; the others, the ring, can be linked only with points whose
   distance to the pivot differs by at most r (``metric_links``). What the windows leave is joined in the
   same way with a new pivot out of the ring, until it no longer shrinks; then shared elements are
   counted.
5. Large cells are spread over tasks, each with a copy of the pivot, for the distances. What their
   windows leave is, where it is far from the pivot (texts that share a passage), dealt anew by other
   parts within the cell, which draws new pivots; else it is cut into Voronoi regions: a point joins the
   region of pivot p if d(p) <= d(nearest) + 2r and d(p) < CORE + r, and the far region if
   d(nearest) >= CORE - r, so that any two points within r share a region (proof in ``cells``). Regions
   over LEAF points are cut again. Of one that does not shrink, points within r of its pivots are
   grouped by them, and blocks are compared against blocks unless both are of one group.

Everything is exact; only spanning forests of links leave a task, and components are formed of links
alone. A part shared by a third of all points reaches a task as one row for each slice read.

Defined results: null, empty and blank texts have no n-grams and link with nothing; texts under n
words are one n-gram; repeated rows are equal sets; null ids are no component's smallest id unless
it has no other; very long texts are one set, held whole by one worker at a time; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Points, and bytes of their sets, that one task compares.
LEAF, LEAF_BYTES = 512, 32 << 20
#: Hash classes of a sketch, and points of a cell that one task compares by sketches.
SKETCH, SKETCH_LEAF = 128, 2048
#: Part keys that meet in one task, and bytes of sets that one task verifies.
TASK_KEYS, TASK_BYTES = 1 << 20, 24 << 20
#: Rows, and bytes of texts or sets, that a worker holds at once (one row at least).
SLICE, SLICE_BYTES = 1000, 8 << 20
#: A large cell is dealt anew so often while its points are far from its pivot.
DEALS = 3
#: Pivots of a Voronoi region over LEAF, and bytes of pivots that one round broadcasts.
PIVOTS, PIVOT_BYTES = 32, 32 << 20
#: What a cut must save of the pairs to compare, and how often it may copy points.
GAIN, COPIES = 0.3, 4
#: Distance from its pivot up to which a set belongs to a Voronoi region alone.
CORE = 0.5
#: Elements in at least so many sets are counted by matrix product, others by pairs of sets.
DENSE = 8
#: Rounding of distances.
SLACK = 1e-9

#: Lower bounds of the size regions.
BOUNDS = [1 << i for i in range(48)]

#: What a word's hash is multiplied by for each word that follows it in an n-gram: odd, and 3 modulo 8, so that
#: words that change places keep all but three bits of their difference.
NEXT = np.uint64(0x9E3779B97F4A7C13)
FIRST = np.zeros(1, np.int64)

#: A part's key and the tag of a point: the first 64 bits of its identity. Points whose tags collide
#: share their cells, no more.
ROW = np.dtype([("k", "<u8"), ("c", "<i8")])


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams, A-Z lower-cased, from the hashes of their words."""
    words = text.lower().split()  # on bytes: ASCII white space and letters only
    if not words:
        return np.empty(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    width = min(n, len(words))
    found = np.full(len(words) - width + 1, salt_of(width))
    for i in range(width):
        found = found * NEXT + each[i : i + len(found)]
    found = mixed(found)
    found.sort()
    return found[starts_of(found)]


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.concatenate((FIRST[: len(ordered)], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt_of(number: int) -> np.uint64:
    return np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def most_apart(n: int, percent: int) -> int:
    """Elements in which a set of size n and one linked to it may differ."""
    return n * (100 - percent) // percent


def size_regions(n: int, percent: int) -> list[int]:
    """Where a set of size n meets sets linked to it that are not larger, and those that are."""
    return list(range(bisect_right(BOUNDS, -(-n * percent // 100)) - 1, bisect_right(BOUNDS, n)))


def parts_of(region: int, percent: int) -> int:
    """Parts of a size region: more than its sets may differ in, and more than chance leaves empty."""
    d = most_apart(BOUNDS[region + 1] - 1, percent) + 1
    return int(d * (1 + 4 * exp(-percent / (100 - percent)))) + 1 if percent < 100 else 1


def part_tokens(s: np.ndarray, region: int, percent: int, deal: int = 0) -> np.ndarray:
    """A set's parts in a size region, largest first.

    The order depends on a part's content alone, so the first parts of linked sets still have one in
    common: what comes before their first common part differs, and that is at most D. Large parts are
    shared by chance least."""
    at = mixed(s + salt_of(deal)) if deal else s
    if deal:
        order = np.argsort(at)
        s, at = s[order], at[order]
    part = ((at >> np.uint64(32)) * np.uint64(parts_of(region, percent))) >> np.uint64(32)  # ascending, as ``at`` is
    first = starts_of(part)
    tokens = mixed(np.add.reduceat(mixed(s), first) + mixed(part[first] + salt_of(region)))
    return tokens[np.lexsort((tokens, first - np.append(first[1:], len(s))))]


def part_keys(s: np.ndarray, percent: int, deal: int = 0) -> np.ndarray:
    """The parts by which a set draws pivots, over its size regions; none if only equal sets link with it.

    A set with too few parts to be sure of an equal one gives all of them and single elements also: a
    pair with one such set meets in the other's parts, a pair of such sets in its elements.
    """
    if most_apart(len(s), percent) == 0:
        return np.empty(0, np.uint64)
    out, own = [], bisect_right(BOUNDS, len(s)) - 1
    for region in size_regions(len(s), percent):
        # in a region below it meets smaller sets only, which differ from it in less
        d = most_apart(len(s), percent) if region == own else len(s) * (100 - percent) // 100
        tokens = part_tokens(s, region, percent, deal)
        out.append(tokens[: d + 1])
        if len(tokens) <= d:
            out.append(np.sort(mixed(s + salt_of(deal) + salt_of(region) + np.uint64(1)))[: d + 1])
    return np.concatenate(out)


def sketch_of(s: np.ndarray) -> bytes:
    """Elements in each of SKETCH hash classes, 255 at most."""
    return np.minimum(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def sketch_groups(sketches: np.ndarray, size: np.ndarray, percent: int) -> list[np.ndarray]:
    """Groups of two and more sets that chains of near sketches connect. Linked sets of sizes n and m
    differ in at most (n + m)(100 - percent) / (100 + percent) elements, their sketches in no more."""
    rest, out = np.arange(len(size)), []
    while len(rest) > 1:
        group, queue, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            apart = (np.maximum(sketches[rest], sketches[x]) - np.minimum(sketches[rest], sketches[x])).sum(axis=1, dtype=np.int64)
            near = apart * (100 + percent) <= (size[rest] + size[x]) * (100 - percent)
            group += rest[near].tolist()
            queue += rest[near].tolist()
            rest = rest[~near]
        if len(group) > 1:
            out.append(np.array(group))
    return out


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All (i, j), i < j, of sets that link, by counting shared elements. Sets with more elements of
    their own than a link allows drop out first, again and again."""
    size = np.array([len(s) for s in sets], np.int64)
    alive = np.flatnonzero(size > 0)
    while len(alive) > 1:
        element = np.concatenate([sets[i] for i in alive])
        owner = np.repeat(np.arange(len(alive)), size[alive])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        first = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        df = np.diff(np.r_[first, len(element)])
        own = np.bincount(owner[first[df == 1]], minlength=len(alive))
        stay = own <= size[alive] * (100 - percent) // percent
        if stay.all():
            break
        alive = alive[stay]
    m = len(alive)
    if m < 2:
        return []
    shared = np.zeros((m, m), np.float64)  # exact up to 2^53 shared elements
    flat = shared.reshape(-1)
    for d in np.unique(df[(df > 1) & (df < DENSE)]):
        owners = owner[first[df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(flat, owners[:, i] * m + owners[:, j], 1.0)
    dense = np.flatnonzero(df >= DENSE)
    for k in range(0, len(dense), 4096):
        some = dense[k : k + 4096]
        held = np.zeros((m, len(some)), np.float32)
        for column, (a, d) in enumerate(zip(first[some], df[some])):
            held[owner[a : a + d], column] = 1
        shared += held @ held.T
    both = np.triu(shared, 1).astype(np.int64)
    n = size[alive]
    i, j = np.nonzero((both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both)))
    return [(int(alive[a]), int(alive[b])) for a, b in zip(i, j)]


def to_pivot(sets: list[np.ndarray], pivot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, linked) of each set, none empty, to a pivot."""
    size = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, element), len(pivot) - 1)
    both = np.bincount(np.repeat(np.arange(len(sets)), size)[pivot[at] == element], minlength=len(sets))
    either = size + len(pivot) - both
    return 1 - both / either, 100 * both >= percent * either


def metric_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect; sets[0] is the first pivot.

    With d the distance to the pivot, sets of d <= r are linked to it, hence need no links among each
    other. A pair with one of the ring (d > r) in it has distances that differ by r at most, so sets below
    the ring's least distance less r drop out, the pivot among them.
    """
    alive, pivot, out = np.arange(len(sets)), 0, []
    while len(alive) > 1:
        distance, linked = to_pivot([sets[i] for i in alive], sets[pivot], percent)
        out += [(pivot, int(x)) for x in alive[linked] if x != pivot]
        if linked.all():
            return out
        stay = ~linked | (distance >= distance[~linked].min() - (100 - percent) / 100 - SLACK)
        stay[alive == pivot] = False
        pivot = int(alive[np.argmax(np.where(linked, -1.0, distance))])
        before, alive = len(alive), alive[stay]
        if len(alive) > 0.9 * before:
            break
    return out + [(int(alive[i]), int(alive[j])) for i, j in links([sets[i] for i in alive], percent)]


def forest(pairs, n: int) -> list[tuple[int, int]]:
    """(member, root) for members of ``pairs`` that are not their component's root."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in range(n) if (r := root(x)) != x]


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All elements in order, whose each is, and the set sizes."""
    element, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(element, kind="stable")
    return element[order], of[order], np.array([len(s) for s in sets])


def shared_with(s: np.ndarray, pivots: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    element, of, size = pivots
    lo, hi = np.searchsorted(element, s, "left"), np.searchsorted(element, s, "right")
    hit = np.concatenate([of[a:b] for a, b in zip(lo, hi) if a < b] or [np.empty(0, np.int64)])
    return np.bincount(hit, minlength=len(size))


def cells(s: np.ndarray, pivots: tuple[np.ndarray, np.ndarray, np.ndarray], radius: float) -> list[int]:
    """The Voronoi regions of a set; the number of pivots stands for the far region.

    Let d(x, y) <= r and p be the pivot nearest to x, at a. If a < CORE then d(y, p) <= a + r < CORE + r
    and, for the pivot q nearest to y, d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r: y joins
    p's region as x does. Else y is at CORE - r or more from every pivot, and both join the far region.
    """
    both = shared_with(s, pivots)
    d = 1 - both / (len(s) + pivots[2] - both)
    near = d.min()
    out = [int(j) for j in np.flatnonzero((d <= near + 2 * radius + SLACK) & (d < CORE + radius + SLACK))]
    return out + [len(d)] * bool(near >= CORE - radius - SLACK)


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows and about SLICE_BYTES."""
    for batch in batches:
        step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _tasks(amount: int | None, each: int) -> int:
    return max(1, -(-int(amount or 0) // each))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


POINT = "doc_id long, mark long, n_shingles long, cls binary, tag long, sketch binary, keys binary"


def points_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): a hash of its text, its set's size, 128-bit
    identity, tag and sketch, and the parts by which it draws pivots."""
    C.ship_by_value(__name__)

    def emit(batches):
        for batch in _slices(batches):
            sizes, ids, sketches, keys = [], [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                s = shingle_set(text or b"", n)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(sketch_of(s))
                keys.append(part_keys(s, percent).tobytes())
            tags = [int.from_bytes(x[:8], "little", signed=True) if x else None for x in ids]
            yield _batch(POINT, batch.column("doc_id"), batch.column("mark"), sizes, ids, tags, sketches, keys)

    return marked(docs).mapInArrow(emit, POINT)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): rows of one id with different texts are told apart by the mark."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _stars(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, other) of the different points of each key."""
    rows = rows[np.lexsort((rows["c"], rows["k"]))]
    new = np.r_[True, rows["k"][1:] != rows["k"][:-1]]
    once = new | np.r_[True, rows["c"][1:] != rows["c"][:-1]]
    rows, new = rows[once], new[once]
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows["c"][first[~new]], rows["c"][~new]


def drawn_pivots(keyed: DataFrame) -> DataFrame:
    """(p, x): each point that shares a part, with the pivot that the part draws. ``keyed``: (tag, keys).

    Keys are packed by bucket where they are read, equal points of a slice being one; a worker holds one
    bucket at a time. A pair is given once for each part that finds it, so rows grow as the points do.
    """
    C.ship_by_value(__name__)
    tasks = _tasks(keyed.agg(F.sum(F.octet_length("keys"))).first()[0], 8 * TASK_KEYS)
    buckets = 8 * tasks

    def combine(batches):
        for batch in _slices(batches):
            held = list({(c, k) for c, k in zip(batch.column("tag").to_pylist(), batch.column("keys").to_pylist()) if k})
            if not held:
                continue
            rows = np.empty(sum(len(k) for _, k in held) // 8, ROW)
            rows["k"] = np.frombuffer(b"".join(k for _, k in held), "<u8")
            rows["c"] = np.repeat(np.array([c for c, _ in held], "<i8"), [len(k) // 8 for _, k in held])
            bucket = (rows["k"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield _batch("bucket long, data binary", bucket[cut], [x.tobytes() for x in np.split(rows, cut[1:])])

    def meet(batches):
        for _, held in _runs(batches, ["bucket"], ["data"]):
            p, x = _stars(np.frombuffer(b"".join(d for (d,) in held), ROW))
            if len(p):
                yield _batch("p long, x long", p, x)

    packed = keyed.select("tag", "keys").mapInArrow(combine, "bucket long, data binary")
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "p long, x long")


def _runs(batches, by: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of consecutive rows with equal keys."""
    key, held = None, []
    for batch in _slices(batches):
        for *new, row in zip(*(batch.column(c).to_pylist() for c in by), zip(*(batch.column(c).to_pylist() for c in columns))):
            if new != key:
                if held:
                    yield tuple(key), held
                key, held = new, []
            held.append(row)
    if held:
        yield tuple(key), held


def near_cells(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(p, x): the cells of ``pairs`` (p, x), cut down to the points that near sketches connect. ``points``:
    (tag, n_shingles, sketch). Cells over SKETCH_LEAF stay as they are."""
    C.ship_by_value(__name__)
    pairs = pairs.distinct()
    sizes = C.Staged(pairs.groupBy("p").count(), "sizes")
    large = C.stage(sizes.df.where(F.col("count") >= SKETCH_LEAF).select(F.col("p").alias("cell")), "large")
    small = pairs.join(C.bounded(large), F.col("p") == F.col("cell"), "left_anti")
    heads = sizes.df.where(F.col("count") < SKETCH_LEAF).select("p", F.col("p").alias("x"))

    def compare(batches):
        for _, held in _runs(batches, ["p"], ["tag", "n_shingles", "sketch"]):
            tags, size, data = zip(*held)
            tags = np.array(tags, np.int64)
            for group in sketch_groups(np.frombuffer(b"".join(data), np.uint8).reshape(len(tags), -1), np.array(size, np.int64), percent):
                own = np.unique(tags[group])
                if len(own) > 1:
                    yield _batch("p long, x long", np.repeat(own[0], len(own) - 1), own[1:])

    rows = small.unionByName(heads).join(points, F.col("x") == F.col("tag")).select("p", "tag", "n_shingles", "sketch")
    tasks = _tasks(sizes.df.agg(F.sum("count") + F.count("*")).first()[0], TASK_BYTES // SKETCH)
    found = rows.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(compare, "p long, x long")
    return found.unionByName(pairs.join(C.bounded(large), F.col("p") == F.col("cell"), "left_semi")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(tag, cls, data): the sets of ``wanted`` (id, its_mark, cls), made again from their texts."""
    C.ship_by_value(__name__)

    def emit(batches):
        for batch in _slices(batches):
            out = []
            for text, cls in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("cls").to_pylist()):
                data = shingle_set(text or b"", n).tobytes()
                if xxhash.xxh3_128_digest(data) == cls:  # marks may collide
                    out.append((int.from_bytes(cls[:8], "little", signed=True), cls, data))
            yield _batch("tag long, cls binary, data binary", *(list(zip(*out)) or [()] * 3))

    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its_mark"))
    return marked(docs).join(C.bounded(wanted), same).select("text", "cls").mapInArrow(emit, "tag long, cls binary, data binary")


FOUND = "a binary, b binary, p long, d double, linked boolean"


def _spread(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, s, spread, kind, cls, data): points (kind 1) by cell and share of it, each share with the pivot
    (kind 0) in front. Cells over LEAF have several shares."""
    size = sets.groupBy(F.col("tag").alias("x")).agg(F.max(F.octet_length("data")).alias("b"))
    sizes = C.Staged(pairs.join(size, "x").groupBy("p").agg(F.greatest(F.ceil(F.count("*") / LEAF), F.ceil(F.sum("b") / LEAF_BYTES)).cast("int").alias("shares"), F.sum("b").alias("b")), "sizes")
    tasks = _tasks(sizes.df.agg(F.sum("b")).first()[0], TASK_BYTES)
    large = C.bounded(C.stage(sizes.df.where("shares > 1").select(F.col("p").alias("cell"), "shares"), "large"))
    shares = F.coalesce("shares", F.lit(1))
    points = pairs.join(large, F.col("p") == F.col("cell"), "left").select("p", F.pmod(F.xxhash64("x"), shares).cast("int").alias("s"), (shares > 1).alias("spread"), F.lit(1).alias("kind"), "x")
    pivots = sizes.df.select("p", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("s"), (F.col("shares") > 1).alias("spread"), F.lit(0).alias("kind"), F.col("p").alias("x"))
    rows = points.unionByName(pivots).join(sets, F.col("x") == F.col("tag")).select("p", "s", "spread", "kind", "cls", "data")
    return rows.repartition(tasks, "p", "s").sortWithinPartitions("p", "s", "kind", "cls")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> C.Staged:
    """Links (a, b) that connect the points of each cell of ``pairs`` (p, x). Of cells in several shares,
    only links to the pivot, and a row (a, p, d, linked) for each point: its distance to the pivot."""
    C.ship_by_value(__name__)

    def compare(batches):
        for (p, _, spread), held in _runs(batches, ["p", "s", "spread"], ["kind", "cls", "data"]):
            ids, sets_ = [x[1] for x in held], [np.frombuffer(x[2], "<u8") for x in held]
            if held[0][0] or len(held) < 2:
                continue
            if not spread:
                trees = forest(metric_links(sets_, percent), len(ids))
                yield _batch(FOUND, [ids[x] for x, _ in trees], [ids[r] for _, r in trees], [None] * len(trees), [None] * len(trees), [None] * len(trees))
                continue
            distance, linked = to_pivot(sets_[1:], sets_[0], percent)
            yield _batch(FOUND, ids[1:], [ids[0] if x else None for x in linked], [p] * len(linked), distance, linked)

    return C.Staged(_spread(pairs, sets).mapInArrow(compare, FOUND), "verified")


def cell_links(pairs: DataFrame, sets: DataFrame, percent: int, deal: int = 0) -> list[DataFrame]:
    """Tables (a, b) of links that connect the points of each cell of ``pairs`` (p, x), recursively."""
    radius = (100 - percent) / 100
    found = verified(pairs, sets, percent).df
    out = [found.where("b IS NOT NULL").select("a", "b")]
    apart = found.where("p IS NOT NULL")
    least = apart.groupBy(F.col("p").alias("cell")).agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("least"), F.avg((F.col("d") > 3 * radius).cast("int")).alias("far")).where("least IS NOT NULL")
    left = apart.join(C.bounded(C.stage(least, "least")), F.col("p") == F.col("cell")).where(~F.col("linked") | (F.col("d") >= F.col("least") - radius - SLACK))
    left = C.stage(left.select("p", F.col("a").alias("cls"), (F.col("far") > 0.5).alias("far")).distinct(), "left")
    if not left.limit(1).count():
        return out
    held = left.join(sets.withColumnRenamed("cls", "point"), F.col("cls") == F.col("point"))
    near = held.where(~F.col("far")) if deal < DEALS else held
    regions = near.select(F.encode(F.col("p").cast("string"), "UTF-8").alias("region"), "cls", "data")
    out += region_links(regions, percent)
    if deal < DEALS:
        again = C.stage(_dealt_anew(held.where("far"), percent, deal + 1), "keys")
        again = C.stage(drawn_pivots(again).distinct(), "pivots")
        if again.limit(1).count():
            out += cell_links(again, sets, percent, deal + 1)
    return out


def _dealt_anew(members: DataFrame, percent: int, deal: int) -> DataFrame:
    """(tag, keys): parts of another deal that only points of the same cell share."""
    C.ship_by_value(__name__)

    def emit(batches):
        for batch in _slices(batches):
            keys = []
            for p, data in zip(batch.column("p").to_pylist(), batch.column("data").to_pylist()):
                keys.append(mixed(part_keys(np.frombuffer(data, "<u8"), percent, deal) ^ np.uint64(p & (1 << 64) - 1)).tobytes())
            yield _batch("tag long, keys binary", batch.column("tag"), keys)

    return members.select("p", "tag", "data").mapInArrow(emit, "tag long, keys binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), by alternating large and small stars.

    Every round leaves an edge table in the shared folder; the rounds end when its edges are stars:
    every node has one root, and no root has one itself. The least neighbours are combined before any
    shuffle and staged, so that the joins with them can split the rows of a hub.
    """
    edges = C.Staged(edges.where("a <> b"), "edges")
    while True:
        e = edges.df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = C.Staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "low")
        large = C.Staged(both.where("b > a").join(low.df, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = C.Staged(large.df.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "low")
        small = large.df.join(least.df, F.col("a") == F.col("u")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = C.Staged(small, "edges")
        for old in (edges, low, large, least):
            old.drop()
        edges, roots = new, new.df.select(F.col("b").alias("root")).distinct()
        rows, nodes = new.df.agg(F.count("*"), F.count_distinct("a")).first()
        if rows == nodes and not new.df.join(roots, F.col("a") == F.col("root"), "left_semi").limit(1).count():
            return new.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root"))


def _pivots(members: DataFrame, sizes: dict[bytes, int], depth: int) -> dict[bytes, list[tuple[bytes, np.ndarray]]]:
    """For each region of ``sizes``, about PIVOTS members (cls, set) drawn by hash. At most PIVOT_BYTES
    come to the driver, as the caller limits the regions, and the members over their share are left out."""
    draw = F.pmod(F.xxhash64("cls", F.lit(depth)), F.lit(1 << 30))
    least = F.create_map(*[F.lit(x) for r, n in sizes.items() for x in (r.hex().upper(), min(1 << 30, (1 << 30) * 3 * PIVOTS // n))])
    drawn = members.where(draw < F.element_at(least, F.hex("region"))).groupBy("region").agg(F.slice(F.sort_array(F.collect_set(F.struct(draw.alias("draw"), "cls", "data"))), 1, PIVOTS).alias("p"))
    return {bytes(row["region"]): [(bytes(x["cls"]), np.frombuffer(x["data"], "<u8")) for x in row["p"]] for row in drawn.collect()}


def _dealt(members: DataFrame, pivots: dict, percent: int) -> DataFrame:
    """(region, cell, cls, data): members of the pivots' regions in each Voronoi region they belong to."""
    shared = members.sparkSession.sparkContext.broadcast({r: inverted([s for _, s in p]) for r, p in pivots.items()})
    radius = (100 - percent) / 100

    def deal(batches):
        for batch in _slices(batches):
            out = []
            for r, c, d in zip(*(batch.column(k).to_pylist() for k in ("region", "cls", "data"))):
                out += [(r, cell, c, d) for cell in cells(np.frombuffer(d, "<u8"), shared.value[r], radius)]
            yield _batch("region binary, cell int, cls binary, data binary", *(list(zip(*out)) or [()] * 4))

    return _in_regions(members, list(pivots)).mapInArrow(deal, "region binary, cell int, cls binary, data binary")


def _in_regions(members: DataFrame, ids: list[bytes], inside: bool = True) -> DataFrame:
    found = F.hex("region").isin([x.hex().upper() for x in ids])
    return members.where(found if inside else ~found)


def _grouped(members: DataFrame, pivots: dict, percent: int) -> DataFrame:
    """(region, cls, data, mask): bit i says that the member is linked to the region's pivot i."""
    shared = members.sparkSession.sparkContext.broadcast({r: inverted([s for _, s in p]) for r, p in pivots.items()})
    schema = "region binary, cls binary, data binary, mask long"

    def emit(batches):
        for batch in _slices(batches):
            masks = []
            for r, d in zip(batch.column("region").to_pylist(), batch.column("data").to_pylist()):
                s, index = np.frombuffer(d, "<u8"), shared.value[r]
                both = shared_with(s, index)
                masks.append(sum(1 << int(i) for i in np.flatnonzero(100 * both >= percent * (len(s) + index[2] - both))))
            yield _batch(schema, *(batch.column(c) for c in ("region", "cls", "data")), masks)

    return members.mapInArrow(emit, schema)


def _dense(members: DataFrame, pivots: dict[bytes, list[tuple[bytes, np.ndarray]]], percent: int) -> tuple[DataFrame, DataFrame]:
    """Of regions that do not shrink: links (a, b) to their pivots, and units (unit, cls, data) in which
    all other links lie. Members linked to the same or connected pivots are one group, the ring is what
    is linked to none; blocks of half a leaf meet unless both are of one group. The driver gets a row
    for each pair of a region's pivots with a common member, and each group's size."""
    spark = members.sparkSession
    rows = C.stage(_grouped(_in_regions(members, list(pivots)), pivots, percent), "grouped")
    bits = F.filter(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    scored = rows.select("region", "cls", "data", bits.alias("bits"))
    common: dict[bytes, list[tuple[int, int]]] = {}
    for r in scored.select("region", F.get("bits", F.lit(0)).alias("i"), F.explode("bits").alias("j")).distinct().collect():
        common.setdefault(bytes(r["region"]), []).append((r["i"], r["j"]))
    laws = []
    for region, own in pivots.items():
        name = dict(forest(common.get(region, []), len(own)))
        laws.append((bytearray(region), [name.get(i, i) for i in range(len(own))], [bytearray(c) for c, _ in own]))
    laws = F.broadcast(spark.createDataFrame(laws, "region binary, label array<int>, heads array<binary>"))
    group = F.when(F.size("bits") > 0, F.get("label", F.get("bits", F.lit(0)))).otherwise(-1)
    rows = scored.join(laws, "region").select("region", "cls", "data", "heads", group.alias("group"))
    out = rows.where(F.col("group") >= 0).select(F.col("cls").alias("a"), F.get("heads", F.col("group")).alias("b"))
    ends, spans = dict.fromkeys(pivots, 0), []
    for r in rows.groupBy("region", "group").count().orderBy("region", "group").collect():
        region, length = bytes(r["region"]), -(-r["count"] // (LEAF // 2))
        spans.append((bytearray(region), r["group"], ends[region], length))
        ends[region] += length
    spans = [(*x, ends[bytes(x[0])]) for x in spans]
    spans = F.broadcast(spark.createDataFrame(spans, "region binary, group int, start int, length int, blocks int"))
    own = (F.col("start") + F.pmod(F.xxhash64("cls"), F.col("length"))).cast("int")
    rows = rows.drop("heads").join(spans, ["region", "group"]).withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("group") < 0) | (j < F.col("start")) | (j >= F.col("start") + F.col("length")))
    pair = F.transform(others, lambda j: F.concat_ws("/", F.hex("region"), F.least("own", j).cast("string"), F.greatest("own", j).cast("string")))
    return out, rows.select(F.explode(pair).alias("unit"), "cls", "data").select(F.encode("unit", "UTF-8").alias("unit"), "cls", "data")


def region_links(members: DataFrame, percent: int) -> list[DataFrame]:
    """Tables (a, b) of links that connect the points of each region of ``members`` (region, cls, data).

    Regions over LEAF are cut until they fit a task. The Voronoi regions are counted first; a cut is taken
    if that saves GAIN of the pairs to compare and copies its members no more than COPIES times. Any other
    region is dense.
    """
    C.ship_by_value(__name__)
    out, open_, depth = [], C.stage(members.select("region", "cls", "data"), "members"), 0
    while True:
        large = open_.groupBy("region").agg(F.count_distinct("cls").alias("n"), F.avg(F.octet_length("data")).alias("b")).where(F.col("n") > LEAF).orderBy(F.desc("n"), "region").limit(256)
        sizes, room = {}, PIVOT_BYTES
        for r in large.collect():
            room -= PIVOTS * r["b"]
            if room >= 0 or not sizes:
                sizes[bytes(r["region"])] = r["n"]
        if not sizes:
            return [*out, linked(open_.withColumnRenamed("region", "unit"), percent)]
        pivots = _pivots(_in_regions(open_, list(sizes)), sizes, depth)
        dealt = _dealt(open_, pivots, percent)
        counts: dict[bytes, list[int]] = {}
        for r in dealt.groupBy("region", "cell").count().collect():
            counts.setdefault(bytes(r["region"]), []).append(r["count"])
        good = [r for r, c in counts.items() if sum(x * x for x in c) <= (1 - GAIN) * sizes[r] ** 2 and sum(c) <= COPIES * sizes[r]]
        if bad := {r: p for r, p in pivots.items() if r not in good}:
            to_pivots, units = _dense(open_, bad, percent)
            out += [to_pivots, linked(units, percent)]
        rest = _in_regions(open_, list(sizes), False)
        if good:
            named = F.unhex(F.md5(F.concat(F.col("region"), F.encode(F.concat_ws("/", F.lit(depth), "cell"), "UTF-8"))))
            rest = rest.unionByName(_in_regions(dealt, good).select(named.alias("region"), "cls", "data"))
        open_, depth = C.stage(rest, "members"), depth + 1


def linked(units: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each unit (unit, cls, data)."""
    C.ship_by_value(__name__)

    def compare(batches):
        for _, held in _runs(batches, ["unit"], ["cls", "data"]):
            held = dict(held)
            names = list(held)
            trees = forest(links([np.frombuffer(d, "<u8") for d in held.values()], percent), len(names))
            if trees:
                yield _batch("a binary, b binary", [names[x] for x, _ in trees], [names[r] for _, r in trees])

    tasks = _tasks(units.agg(F.sum(F.octet_length("data"))).first()[0], TASK_BYTES)
    return units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(compare, "a binary, b binary")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def linked_rows(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, mark, n_shingles, cls, group, n_equal) for every row: its set's identity, the group that links
    connect it with (null without n-grams), and how many rows have the same set."""
    points = C.Staged(points_of(docs, n, percent), "points")
    drawn = C.Staged(drawn_pivots(points.df.where("n_shingles > 0")).distinct(), "pivots")
    rows = C.stage(points.df.drop("keys", "sketch"), "rows")
    same = points.df.where("n_shingles > 0").groupBy("cls", "tag", "n_shingles", "sketch")
    classes = C.Staged(same.agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.count("*").alias("n_equal")), "classes")
    points.drop()
    pairs = C.Staged(near_cells(drawn.df, classes.df.select("tag", "n_shingles", "sketch"), percent), "cells")
    drawn.drop()
    inside = pairs.df.select("x").unionByName(pairs.df.select(F.col("p").alias("x"))).distinct()
    wanted = C.Staged(classes.df.join(inside, F.col("tag") == F.col("x")).select(F.col("one.doc_id").alias("id"), F.col("one.mark").alias("its_mark"), "cls"), "wanted")
    sets = C.Staged(sets_of(docs, wanted.df, n), "sets")
    if sets.df.groupBy("cls").count().where("count > 1").limit(1).count():  # equal rows give their set as often
        once = C.Staged(sets.df.dropDuplicates(["cls"]), "sets")
        sets.drop()
        sets = once
    wanted.drop()
    found = components(_union(cell_links(pairs.df, sets.df, percent)).distinct())
    for old in (pairs, sets):
        old.drop()
    grouped = classes.df.select(F.col("cls").alias("name"), "n_equal").join(found, F.col("name") == F.col("node"), "left")
    grouped = C.stage(grouped.select("name", F.coalesce("root", "name").alias("group"), "n_equal"), "groups")
    classes.drop()
    out = rows.join(grouped, F.col("cls") == F.col("name"), "left")
    return out.select("doc_id", "mark", "n_shingles", "cls", "group", F.coalesce("n_equal", F.lit(1)).alias("n_equal"))


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_equal) for every row: the smallest doc_id that links of
    similarity ``percent`` / 100 or more reach, and how many rows have the same set."""
    rows = C.stage(linked_rows(docs, n, percent), "linked")
    # most groups are one row; only the others are looked up
    least = rows.where("n_shingles > 0").groupBy(F.col("group").alias("g")).agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    out = rows.join(C.stage(least, "least"), F.col("group") == F.col("g"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "n_equal")


def one_of_each(docs: DataFrame, **law) -> DataFrame:
    """One row of ``docs`` for each group of linked rows, and every row that is linked with none.

    The row with the smallest doc_id stays (a null one is the largest; between equal ids the text's hash
    decides), one of several equal rows. Rows without n-grams are linked with nothing and all stay.
    """
    rows = C.stage(linked_rows(docs, **law), "linked").where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = C.stage(rows.groupBy(F.col("group").alias("g")).agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first")
    held = rows.join(first, F.col("group") == F.col("g")).select("doc_id", "mark", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    listed = C.stage(held.groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count("*").alias("k")).where("k > 1 OR NOT stays"), "listed")
    ids = [F.col("doc_id").alias(C.own("id")), F.col("mark").alias(C.own("mark"))]
    same = F.col("doc_id").eqNullSafe(F.col(C.own("id"))) & (F.xxhash64("text") == F.col(C.own("mark")))
    out = docs.join(C.bounded(listed.select(*ids)), same, "left_anti")
    twice = listed.where("stays").select(*ids)
    if twice.limit(1).count():
        equal = docs.join(C.bounded(twice), same, "left_semi").withColumn(C.own("mark"), F.xxhash64("text"))
        out = out.unionByName(equal.dropDuplicates(["doc_id", C.own("mark")]).drop(C.own("mark")))
    return out


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)),
n AS (SELECT doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, n, list_sort(list(s)) AS all_s FROM n LEFT JOIN s USING (doc_id) GROUP BY doc_id, n)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, CASE WHEN n = 0 THEN 1 ELSE count(*) OVER (PARTITION BY all_s) END AS n_equal FROM k JOIN g ON k.doc_id = g.a
"""
