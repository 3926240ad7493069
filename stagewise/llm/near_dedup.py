"""Near-duplicates by chosen-path set similarity join.

A document's set holds the hashes of its distinct shingles. Equal sets become
one representative at once, so a group of copies is one row from here on.

Trees. A representative has a signature of minwise values. At a node of a tree,
each coordinate is selected with probability 1 / (threshold x coordinates), the
same ones for all rows of the node, and every row branches to the child named
by (node, coordinate, its minwise value there). Two sets as similar as the
threshold share one child on average, so a tree keeps them together at depth d
with a probability that is known beforehand for each number of coordinates in
which they agree; trees are repeated until a pair at the threshold is found with
the target probability, averaged over that number, at the greatest depth (pairs
that part from the crowd earlier are surer). Nodes with one row
end; nodes of up to `leaf` rows are compared exhaustively; larger ones branch
on. Nodes of different trees with the same members are compared once.

Crowds. A crowd of near-copies would meet again in nearly every tree. So rows that share a
value of one of a few coordinates are counted, and of the greatest such crowds some rows vote
for a centre, coordinate by coordinate. Every row is compared with the centres once, before the
trees. Disagreeing coordinates are a metric: if rows that disagree in more than h coordinates are
never links, a row linked with one within h of a centre is within 2h of it. Rows within 2h are tied,
and those within h take no part in the trees: all that they may be linked with is tied to
the same row. Centres with few near-copies among the rows within 2h (a passage that many texts
share), and crowds that aren't among the greatest, are left to the trees.

Large nodes. A node of more than `leaf` rows is mostly one crowd of near-copies, and
branching all of it again and again finds nothing new. So a few of its rows, the
pivots, are compared with every row by their signatures, in blocks of the node. If
x disagrees with a pivot in r at most, then a row linked with x disagrees with that
pivot in r + h at most. Rows so near to a pivot are tied to it, and those within r
are done with in this node; only the others branch on. No proposal is lost by that, and
a crowd of any size is one level's rows.

Comparing. Within a leaf, signatures are compared, and rows whose agreement
leaves a similarity at the threshold possible (four standard errors at least) are tied
to the least of their cluster. What is left of nodes that are still large at the greatest depth
is tied as it is. Ties only propose: the connected groups of ties are where
full sets are compared, and only links confirmed there count. Groups of up to
`block` members are compared in one task, skipping pairs already connected.
Larger groups are cut into blocks: all members are compared with a few pivots,
then every member that isn't in the group's largest class by then is compared,
in packs, with all members. So no pair that isn't connected already goes
unchecked and no task holds more than a block and a pack.

Defined results: null texts count as empty; a text without words is linked with
nothing; a text of fewer words than a shingle has one shingle, all its words; rows
with a null id are linked with nothing and kept; rows repeating an id are compared
each by its own text, and named by that id all the same; an empty table gives no
rows; input columns play no part but id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import Union, bitmap_of, byte_slices, checkpointed, components, marked, parts_for, ship
from stagewise.llm.words import FACTORS, U64, hashed_words, mixed, odd_numbers

COORDINATES = 64
SIGN_A, SIGN_B = odd_numbers(b"sign a", COORDINATES), odd_numbers(b"sign b", COORDINATES)


def shingle_set(h: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of hashed words."""
    k = min(shingle, len(h))
    if not k:
        return np.empty(0, U64)
    n = len(h) - k + 1
    total = np.full(n, k * int(FACTORS[40]) % 2**64, U64)
    for j in range(k):
        total += h[j : j + n] * FACTORS[j]
    return np.unique(mixed(total, 0xC2B2AE3D27D4EB4F))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, U64)
    for k in range(0, len(s), 2048):
        out = np.minimum(out, ((SIGN_A[:, None] * s[None, k : k + 2048] + SIGN_B[:, None]) >> U64(32)).min(1))
    return out.astype(np.uint32)


def set_key(s: np.ndarray, factor: int = 0x9FB21C651E98DF25) -> int:
    """A hash of the set."""
    return int(mixed(s, factor).sum(dtype=U64).astype(np.int64))


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """id, t (hash of the text), n (set size), k1 and k2 (hash of the set), sig (signature) of each row."""
    ship(docs.sparkSession)
    names = ["id", "t", "n", "k1", "k2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2):
            n, k1, k2, sig = [], [], [], []
            for h in hashed_words(batch.column(2), lower=True):
                s = shingle_set(h, shingle)
                n.append(len(s))
                k1.append(set_key(s))
                k2.append(set_key(s, 0xD6E8FEB86659FD93))
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield _batch(names, batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()))

    return docs.select("id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "id long, t long, n long, k1 long, k2 long, sig binary")


def agreements(threshold: float) -> list[float]:
    """Probability of each number of coordinates in which signatures of a pair at the threshold agree."""
    return [math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)]


def recall_of(trees: int, depth: int, threshold: float, need: int) -> float:
    """Probability that a pair at the threshold agrees in `need` coordinates and stays together in a tree down to the depth.

    All trees branch on the same coordinates: they are independent only for a given number of agreeing ones.
    """
    found = 0.0
    for k, p in enumerate(agreements(threshold)):
        q = 1.0
        for _ in range(depth):
            q = 1 - (1 - q / (threshold * COORDINATES)) ** k
        found += p * (1 - (1 - q) ** trees) if k >= need else 0.0
    return found


def trees_for(recall: float, depth: int, threshold: float = 0.8) -> int:
    """Trees after which a pair at the threshold is proposed with the probability recall, at the greatest depth."""
    need = least_agreement(threshold, recall)
    high = 1
    while recall_of(high, depth, threshold, need) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if recall_of(mid, depth, threshold, need) >= recall else (mid, high)
    return high


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def children(rows: DataFrame, threshold: float, trees: int = 0) -> DataFrame:
    """(node, rep) of the children of rows (node, rep, sig); trees: start that many trees from rows (rep, sig) instead."""
    odds = int(2**64 / (threshold * COORDINATES))
    salts = odd_numbers(b"select", COORDINATES)
    start = odd_numbers(b"tree", trees) if trees else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = np.array(batch.column("rep").to_pylist(), np.int64)
            values = _signatures(batch.column("sig"))
            at = np.arange(len(rep))
            if start is not None:
                node, at = np.tile(start, len(rep)), np.repeat(at, trees)
            else:
                node = np.array(batch.column("node").to_pylist(), np.int64).astype(U64)
            for k in range(0, len(node), 20_000):
                now = node[k : k + 20_000]
                chosen = mixed(mixed(now[:, None] + salts[None, :], 0x9FB21C651E98DF25), 0xC2B2AE3D27D4EB4F) < U64(odds)
                row, coordinate = np.nonzero(chosen)
                of = at[k : k + 20_000][row]
                child = mixed(mixed(now[row] + salts[coordinate], 0xD6E8FEB86659FD93) + values[of, coordinate].astype(U64) * FACTORS[9], 0xC2B2AE3D27D4EB4F)
                yield _batch(["node", "rep"], pa.array(child.astype(np.int64)), pa.array(rep[of]))

    return rows.mapInArrow(run, "node long, rep long")


def _groups(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return zip(edges, [*edges[1:], len(key)], strict=True)


def least_agreement(threshold: float, recall: float) -> int:
    """Agreeing coordinates below which a pair is dropped: four standard errors, or more where those would cost half of what recall may miss."""
    need = max(1, math.floor(COORDINATES * threshold - 4 * math.sqrt(COORDINATES * threshold * (1 - threshold))))
    chances = agreements(threshold)
    while need > 1 and math.fsum(chances[:need]) > (1 - recall) / 2:
        need -= 1
    return need


def leaf_ties(rows: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Ties (a, b) within each leaf of rows (node, rep, sig): every row to the least row of its cluster."""
    need = least_agreement(threshold, recall)

    def ties(rep: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int]]:
        u = Union()
        for i in range(len(rep) - 1):
            for j in i + 1 + np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= need):
                u.join(i, int(j))
        for i in range(len(rep)):
            if (r := u.find(i)) != i:
                yield int(rep[r]), int(rep[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch, last in _with_last(batches):
            held.append(batch)
            t = pa.Table.from_batches(held)
            node = np.array(t.column("node").to_pylist(), np.int64)
            out: list[tuple[int, int]] = []
            done = 0
            for i, j in _groups(node):
                if j < len(node) or last:  # the last group may go on in the next batch
                    part = t.slice(i, j - i)
                    sig = _signatures(part.column("sig"))
                    out += ties(np.array(part.column("rep").to_pylist(), np.int64), sig)
                    done = j
            held = t.slice(done).to_batches()
            a, b = zip(*out, strict=True) if out else ((), ())
            yield _batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    return rows.repartition("node").sortWithinPartitions("node", "rep").select("node", "rep", "sig").mapInArrow(run, "a long, b long")


def _with_last(batches: Iterator) -> Iterator[tuple]:
    now = next(batches, None)
    while now is not None:
        after = next(batches, None)
        yield now, after is None
        now = after


def compare(rep: np.ndarray, sig: np.ndarray, pivots: np.ndarray, known: np.ndarray, u: Union, within: int, far: int) -> Iterator[tuple]:
    """(row, tie, whether it goes on) of rows against pivots; known names the row to tie those near a pivot to. Ties of such rows come with them, and don't go on."""
    apart = np.stack([(sig != p).sum(1) for p in pivots], 1)
    near, done = apart <= within + far, (apart <= within).any(1)
    first = near.argmax(1)
    for i in np.flatnonzero(near.sum(1) > 1).tolist():
        for k in np.flatnonzero(near[i]).tolist():
            if u.join(int(first[i]), k):
                yield int(known[k]), int(known[first[i]]), False
    for x, some, k, d in zip(rep.tolist(), near.any(1).tolist(), first.tolist(), done.tolist(), strict=True):
        yield x, int(known[k]) if some else None, not d


#: Rows that share a value of one of the LOOKED_AT first coordinates are a crowd from so many on; crowds at most; rows that vote for a centre, at most;
#: rows tied to a centre, at most, for each one that is as near as the threshold.
CROWD, LOOKED_AT, CROWDS, VOTERS, LOOSE = 1000, 4, 64, 64, 4


def centres(reps: DataFrame, within: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the centres of the greatest crowds of near-copies among reps (rep, sig), CROWDS at most; the row is one to tie others to."""
    value = lambda c: F.struct(F.lit(c).alias("c"), F.expr(f"substring(sig, {4 * c + 1}, 4)").alias("value"))
    keyed = reps.select("rep", "sig", F.explode(F.array(*map(value, range(LOOKED_AT)))).alias("at"))
    crowds = checkpointed(keyed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).orderBy(F.desc("n"), "at").limit(CROWDS))

    def vote(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        sig = _signatures(t.column("sig"))
        centre = np.array([v[n.argmax()] for v, n in (np.unique(x, return_counts=True) for x in sig.T)], np.uint32)
        k = int((sig != centre).sum(1).argmin())
        return t.slice(k, 1).select(["n", "rep"]).append_column("centre", pa.array([centre.tobytes()], pa.binary()))

    few = keyed.join(F.broadcast(crowds), "at").groupBy("at", "n", F.pmod(F.xxhash64("rep"), F.lit(VOTERS)).alias("__of")).agg(F.min(F.struct(F.xxhash64("rep", F.lit(5)), "rep", "sig")).alias("x"))
    known, sigs = [], np.empty((0, COORDINATES), np.uint32)
    if not crowds.isEmpty():
        for n, rep, centre in sorted(few.select("at", "n", "x.rep", "x.sig").groupBy("at").applyInArrow(vote, "n long, rep long, centre binary").collect(), key=lambda x: (-x.n, x.rep, x.centre)):
            sig = np.frombuffer(centre, np.uint32)
            if not ((sigs != sig).sum(1) <= within).any():  # each crowd is found by several coordinates
                known.append(rep)
                sigs = np.vstack([sigs, sig])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close, near = np.zeros(len(sigs), np.int64), np.zeros(len(sigs), np.int64)
        for batch in batches:
            sig = _signatures(batch.column(0))
            for k, p in enumerate(sigs):
                apart = (sig != p).sum(1)
                close[k] += (apart <= within).sum()
                near[k] += (apart <= 2 * far).sum()
        yield _batch(["k", "close", "near"], pa.array(range(len(sigs)), pa.int64()), pa.array(close), pa.array(near))

    if known:
        counts = reps.select("sig").mapInArrow(count, "k long, close long, near long").groupBy("k").agg(F.sum("close").alias("close"), F.sum("near").alias("near"))
        taken = sorted(r.k for r in counts.where(F.col("near") <= LOOSE * F.col("close")).collect())
        known, sigs = [known[k] for k in taken], sigs[taken]
    return np.array(known, np.int64), sigs


def without_crowds(reps: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame | None]:
    """(reps without the rows of crowds that are tied to all they may be linked with, ties (a, b) of crowds, if there are any)."""
    far = COORDINATES - least_agreement(threshold, recall)
    known, sigs = centres(reps, COORDINATES - round(COORDINATES * threshold), far)
    if not len(known):
        return reps, None

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = Union()
        for batch in batches:
            rows = compare(np.asarray(batch.column(0)), _signatures(batch.column(1)), sigs, known, u, far, far)
            pairs = [(min(x, tie), max(x, tie)) for x, tie, _ in rows if tie is not None and tie != x]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield _batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column(1))
            yield batch.filter(pa.array(np.all([(sig != p).sum(1) > far for p in sigs], 0)))

    rows = reps.select("rep", "sig")
    return rows.mapInArrow(left, "rep long, sig binary"), checkpointed(rows.mapInArrow(tied, "a long, b long"))


#: Rows of a large node that all its rows are compared with, and rows of a node that one task compares with them.
PIVOTS, NODE_BLOCK = 16, 10_000


def resolved(large: DataFrame, reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, rep, tie, stays) of rows (node, rep, n) of large nodes of n rows: a pivot to tie the row to, if any, and whether it goes on branching.

    More rows tie pivots with one another; they don't stay.
    """
    far = COORDINATES - least_agreement(threshold, recall)
    within = COORDINATES - round(COORDINATES * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots, known, u = None, None, None, Union()
        for batch in batches:
            node, block, rep = (np.asarray(batch.column(k)) for k in (0, 1, 3))
            pivot = np.array(batch.column(2).to_pylist(), bool)
            sig = _signatures(batch.column(4))
            out: list[tuple] = []
            for i, j in _groups(node * 1_000_003 + block):
                if (key := (node[i], block[i])) != now:
                    now, pivots, known, u = key, sig[:0], rep[:0], Union()
                at = i + int(pivot[i:j].sum())  # pivots come first
                pivots, known = np.concatenate([pivots, sig[i:at]]), np.concatenate([known, rep[i:at]])
                out += [(int(node[i]), *x) for x in compare(rep[at:j], sig[at:j], pivots, known, u, within, far)] if at < j else []
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield _batch(["node", "rep", "tie", "stays"], *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)))

    blocks = F.ceil(F.col("n") / NODE_BLOCK).cast("int")
    first = Window.partitionBy("node").orderBy(F.xxhash64("rep", "node"), "rep")
    picked = large.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= PIVOTS).select("node", "rep", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("pivot"))
    every = large.select("node", "rep", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.lit(False).alias("pivot"))
    rows = every.unionByName(picked).join(reps, "rep").select("node", "block", "pivot", "rep", "sig").repartition("node", "block").sortWithinPartitions("node", "block", F.desc("pivot"), "rep")
    return rows.mapInArrow(run, "node long, rep long, tie long, stays boolean")


def proposed(reps: DataFrame, threshold: float, recall: float, depth: int, leaf: int) -> DataFrame:
    """Ties (a, b) between representatives (rep, sig)."""
    reps, ties = without_crowds(reps, threshold, recall)
    rows = children(reps, threshold, trees_for(recall, depth, threshold))
    for level in range(1, depth + 1):
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("m2"), F.min("rep").alias("least")).where("n > 1")
        # leaves with the same members count once
        chosen = stats.groupBy("m1", "m2", "n").agg(F.min(F.struct("node", "least")).alias("s"), F.collect_set(F.when(F.col("n") > leaf, F.col("node"))).alias("large"))
        chosen = chosen.select(F.explode(F.when(F.col("n") > leaf, F.col("large")).otherwise(F.array("s.node"))).alias("__node"), (F.col("n") > leaf).alias("large"), "n")
        members = checkpointed(rows.join(chosen, F.col("node") == F.col("__node")).select("node", "rep", "large", "n"))
        if level == 1:  # signatures of others aren't shuffled; deeper nodes have no other members
            parts = parts_for(members.count())
            reps = checkpointed(marked(reps, F.xxhash64("rep"), checkpointed(bitmap_of(members, F.xxhash64("rep"), parts)), "__in", parts).where("__in").drop("__in"))
        found = checkpointed(leaf_ties(members.where(~F.col("large")).join(reps, "rep"), threshold, recall))
        ties = found if ties is None else ties.union(found)
        large = members.where("large")
        if large.isEmpty():
            return ties
        after = checkpointed(resolved(large.select("node", "rep", "n"), reps, threshold, recall))
        ties = ties.union(after.where("tie <> rep").select(F.least("tie", "rep").alias("a"), F.greatest("tie", "rep").alias("b")))
        rest = after.where("stays").select("node", "rep")
        if rest.isEmpty():
            return ties
        if level == depth:
            least = rest.groupBy("node").agg(F.min("rep").alias("a"))
            return ties.union(rest.join(least, "node").where("rep != a").select("a", F.col("rep").alias("b")))
        rows = checkpointed(children(rest.join(reps, "rep").select("node", "rep", "sig"), threshold))
    return ties


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(rows: DataFrame, shingle: int, percent: int, recall: float) -> DataFrame:
    """Links (a, b) between full sets, enough to connect what is linked.

    rows: (grp, block, pack, rep, k1, text). The rows of a (grp, block) come together; those with pack are compared with
    all its rows; without any pack, all with all. A text whose set isn't that of k1 is another one with the same id, and goes.
    """
    need = least_agreement(percent / 100, recall)

    def links(rep: list[int], pack: list[bool], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        sig = np.stack([signature(s) for s in sets])
        packed = np.array(pack)
        left = np.flatnonzero(packed) if packed.any() else np.arange(len(rep))
        near = [np.flatnonzero(((sig == sig[i]).sum(1) >= need) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))) for i in left]
        u = Union()
        for k in sorted(range(len(left)), key=lambda k: -len(near[k])):  # the most central first: it connects most
            i = int(left[k])
            for j in near[k].tolist():
                if rep[i] != rep[j] and u.find(rep[i]) != u.find(rep[j]) and linked(sets[i], sets[j], percent):
                    u.join(rep[i], rep[j])
                    yield rep[i], rep[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in byte_slices(batches, 5):
            out: list[tuple[int, int]] = []
            for grp, block, pack, rep, k1, h in zip(*(c.to_pylist() for c in batch.columns[:5]), hashed_words(batch.column(5), lower=True), strict=True):
                if (grp, block) != now:
                    if len(held) > 1:
                        out += links(*zip(*held, strict=True))
                    now, held = (grp, block), []
                if held and held[-1][:2] == (rep, pack):  # rows that repeat an id and a set count once
                    continue
                s = shingle_set(h, shingle)
                if set_key(s) == k1:
                    held.append((rep, pack, s))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield _batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))
        out = list(links(*zip(*held, strict=True))) if len(held) > 1 else []
        a, b = zip(*out, strict=True) if out else ((), ())
        yield _batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    rows = rows.select("grp", "block", "pack", "rep", "k1", "text").repartition("grp", "block").sortWithinPartitions("grp", "block", "pack", "rep")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable over links) and kept (whether that is the id itself) of every row."""
    return decided(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def decided(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80, recall: float = 0.998, depth: int = 4, leaf: int = 200, block: int = 256, pivots: int = 16) -> DataFrame:
    """id, t (hash of the text), n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    threshold = percent / 100
    every = checkpointed(signed(docs, shingle))
    sets = every.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("first"), F.first("sig").alias("sig"))
    sets = checkpointed(sets)
    # a set goes by its least id; of several sets with that least id, one does, and the others by a hash
    shared = checkpointed(sets.groupBy("first").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("k1", "k2", "n")).alias("__owner")).where("__n > 1").select(F.col("first").alias("__first"), "__owner"))
    if shared.isEmpty():
        sets = sets.withColumn("rep", F.col("first"))
    else:
        rep = F.when(F.col("__owner").isNull() | (F.col("__owner") == F.struct("k1", "k2", "n")), F.col("first")).otherwise(F.col("k1"))
        sets = checkpointed(sets.join(shared, F.col("first") == F.col("__first"), "left").select("k1", "k2", "n", "first", "sig", rep.alias("rep")))
    groups = components(proposed(sets.select("rep", "sig"), threshold, recall, depth, leaf))

    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    placed = groups.join(sizes.select(F.col("label").alias("grp"), F.xxhash64("label").alias("__k"), "members"), (F.xxhash64("label") == F.col("__k")) & (F.col("label") == F.col("grp"))).select(F.col("v").alias("rep"), "grp", "members")
    blocks = F.ceil(F.col("members") / block).cast("int")
    placed = placed.withColumn("block", F.when(F.col("members") <= block, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), blocks)).cast("int"))
    placed = checkpointed(placed.join(sets.select(F.col("rep").alias("__r"), "first", "k1"), F.col("rep") == F.col("__r")).drop("__r"))

    def texts_of(which: DataFrame) -> DataFrame:
        """Their full texts; others aren't shuffled."""
        parts = parts_for(which.count())
        held = marked(docs, F.xxhash64("id"), checkpointed(bitmap_of(which, F.xxhash64("first"), parts)), "held", parts).where("held")
        return held.join(which, F.col("id") == F.col("first")).select("grp", "block", "members", "rep", "k1", "text")

    small = texts_of(placed.where(F.col("members") <= block)).withColumn("pack", F.lit(False))
    links = checkpointed(confirmed(small, shingle, percent, recall))

    if not placed.where(F.col("members") > block).isEmpty():
        big = checkpointed(texts_of(placed.where(F.col("members") > block)))
        spread = F.explode(F.sequence(F.lit(0), blocks - 1))
        first = Window.partitionBy("grp").orderBy(F.xxhash64("rep"), "rep")
        picked = big.select("grp", "rep").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= pivots).select(F.col("rep").alias("__r"))
        packs = big.join(picked, F.col("rep") == F.col("__r")).withColumn("block", spread).withColumn("pack", F.lit(True)).drop("__r")
        by_pivot = checkpointed(confirmed(big.withColumn("pack", F.lit(False)).unionByName(packs), shingle, percent, recall))
        classes = components(by_pivot)
        labelled = big.select("grp", "rep", "members").join(classes, F.col("rep") == F.col("v"), "left").select("grp", "rep", "members", F.coalesce("label", "rep").alias("label"))
        largest = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
        others = checkpointed(labelled.join(largest.select(F.col("grp").alias("__g"), "main", F.xxhash64("grp").alias("__k")), (F.xxhash64("grp") == F.col("__k")) & (F.col("grp") == F.col("__g"))).where("label != main").select(F.col("grp").alias("__g"), F.col("rep").alias("__r")))
        links = links.unionByName(by_pivot)
        if not others.isEmpty():
            counts = others.groupBy("__g").agg(F.count(F.lit(1)).alias("__others"))
            packs_of = F.ceil(F.col("__others") / block).cast("int")
            # a block for each (block, pack): members meet every pack, packs meet every block
            members = big.join(counts, (F.col("grp") == F.col("__g"))).withColumn("__pack", F.explode(F.sequence(F.lit(0), packs_of - 1))).withColumn("pack", F.lit(False))
            packs = big.join(others.select("__r"), F.col("rep") == F.col("__r")).join(counts, F.col("grp") == F.col("__g")).withColumn("__pack", F.pmod(F.xxhash64("rep", F.lit(3)), packs_of).cast("int"))
            packs = packs.withColumn("block", spread).withColumn("pack", F.lit(True))
            rows = members.select("grp", "block", "__pack", "rep", "k1", "text", "pack", "members").unionByName(packs.select("grp", "block", "__pack", "rep", "k1", "text", "pack", "members"))
            links = links.unionByName(checkpointed(confirmed(rows.withColumn("block", F.col("__pack") * blocks + F.col("block")), shingle, percent, recall)))

    linked_sets = checkpointed(components(links).join(sets.select("rep", "first"), F.col("rep") == F.col("v")).select("rep", "first", "label"))
    names = linked_sets.groupBy("label").agg(F.min("first").alias("component")).select(F.col("label").alias("__label"), F.xxhash64("label").alias("__k"), "component")
    named = linked_sets.join(names, (F.xxhash64("label") == F.col("__k")) & (F.col("label") == F.col("__label"))).select(F.col("rep").alias("v"), "component")
    final = checkpointed(sets.join(named, F.col("rep") == F.col("v"), "left").select(F.col("k1").alias("__1"), F.col("k2").alias("__2"), F.col("n").alias("__n"), F.coalesce("component", "first").alias("label")))
    out = every.join(final, (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")) & (F.col("n") == F.col("__n")), "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.col("label"))
    return out.select("id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps; texts of rows that surely stay aren't shuffled."""
    gone = checkpointed(decided(docs, id_col, text_col, **options).where("not kept").select("id", "t").distinct())
    parts = parts_for(gone.count())
    ids, texts = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rows = marked(docs, F.xxhash64(ids), checkpointed(bitmap_of(gone, F.xxhash64("id"), parts)), "__held", parts)
    gone = gone.select(F.col("id").alias("__gone"), F.col("t").alias("__t"))
    return rows.where(~F.col("__held")).unionByName(rows.where("__held").join(gone, (ids == F.col("__gone")) & (texts == F.col("__t")), "left_anti")).select(*docs.columns)
