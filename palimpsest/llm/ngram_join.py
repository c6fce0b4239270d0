"""Jaccard self-join of documents on word shingles, by parity sketches and the pigeonhole principle.

A document is the set A of hashes of its shingles.  Sets of Jaccard similarity t or more
have a symmetric difference of at most d = (1 - t) / (1 + t) * (|A| + |B|) elements.

* Candidates.  Within a band of |A| + |B| the hash space is cut into k parts, and a part's
  word is the XOR of the hashes in it.  One element changes one word, so at most d words
  differ and some word of elements agrees.  The first agreeing part has at most d parts of
  the document before it, hence each document only emits its first d + 1 words.  Where both
  documents of a pair have too many empty parts, both emit single hashes in their place.
* Sketches.  A parity sketch has a bit for each hash residue, flipped by each element; its
  Hamming distance is a lower bound of the symmetric difference, also after folding.
* Work.  A group of documents with a common word is not expanded into pairs.  Each is tried
  against the group's least member; what that links is joined into components, and only
  members of a group that are then in different components are compared, by sketch: the
  nearest first, round by round, as they join most of the components, then all the rest.
* Verification counts the common elements of the whole sets of a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Workspace, bucket_count, few_rows, key_of, table, text_of
from .graph import connected_components

#: Words of a shingle; the similarity as a fraction.
WORDS, NUM, DEN = 5, 3, 4
#: Sum of sizes that a band reaches, for each of its parts.
FILL = 5.95
#: Words in a bucket, beyond which times of that it is split, and members of a group that are compared at once.
BUCKET_WORDS, HOT_TIMES, BLOCK = 1_000_000, 4, 2048
#: 64-bit words of sketches that are compared at once.
STRIP = 500_000
#: Signed words a task holds before it hands them on.
FLUSH = 600_000
#: Pairs of a member that are tried first among those that are left.
NEAREST = 2
#: Groups of a node, the least by name, by which a pair that several groups have is said only once as a rule.
NAMED_GROUPS = 8
#: Up to so many documents to read again are told to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a UTF-8 text; A-Z count as a-z."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), _U, len(tokens))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, _U)
    for j in range(n):
        total = mix64(total + h[j : j + len(total)])
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def node_of(found: np.ndarray) -> int:
    """A long that stands for the set: equal sets, equal nodes."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _sketch_bits(n: int) -> int:
    """A power of two of bits, two for each element at least: twice as many let through 7% fewer pairs, but weigh twice as much."""
    return max(64, 1 << (2 * n - 1).bit_length())


def parity_sketch(found: np.ndarray) -> bytes:
    bits = _sketch_bits(len(found))
    flips = np.bincount((found & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _fold(words: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to n words."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _allowed(a, b, num: int, den: int):
    """The greatest symmetric difference of linked sets of sizes a and b."""
    return (den - num) * (a + b) // (den + num)


def band_words(found: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The words by which a set meets every set that it may be linked with."""
    n = len(found)
    low, high = n + -(-n * num // den), n + n * den // num
    out, spread = [], mix64(found)
    band = max(0, int(np.ceil(np.log2(max(low, 1) / FILL))))
    while True:
        reach = int(FILL * (1 << band))
        if reach < low:
            band += 1
            continue
        most = _allowed(min(reach, high), 0, num, den)
        part = found >> _U(64 - band) if band else np.zeros(n, _U)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        tag = _U((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        keys = mix64(mix64(np.bitwise_xor.reduceat(spread, first)) + part[first] * _U(0xD6E8FEB86659FD93) + tag)
        out.append(keys[: most + 1])
        if len(keys) <= most:
            out.append(mix64(spread[: most + 1] + (tag ^ _U(0xA5A5A5A5A5A5A5A5))))
        if reach >= high:
            return np.concatenate(out)
        band += 1


SIGNED = "kind int, doc_id long, hash long, n long, node long, sketch binary, bucket int, words binary, nodes binary, counts binary"
_SIGNED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary())])


def _sign(words: int, num: int, den: int, n_buckets: int, ship: bool):
    """Rows of sets (kind 0) and of how many words buckets get (2); with ``ship`` the words themselves (1) only.

    A bucket's words travel as their low 32 bits: the high ones choose the bucket, and unequal
    words that agree in both only make a group larger than need be.
    """
    shift = _U(64 - n_buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, owners, total = [], [], 0

        def bucketed():
            if not held:
                return
            keys, sizes = np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))
            nodes = np.repeat(np.array(owners, np.int64), sizes)
            bucket = (keys >> shift).astype(np.int32) if n_buckets > 1 else np.zeros(len(keys), np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, nodes, bucket = keys[order], nodes[order], bucket[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = []
            for lo, hi in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                own = nodes[lo:hi]
                if not ship:
                    rows.append((2, None, None, int(hi - lo), None, None, int(bucket[lo]), None, None, None))
                    continue
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                counts = np.diff(np.append(at, hi - lo)).astype(np.uint32)
                rows.append((1, None, None, None, None, None, int(bucket[lo]), keys[lo:hi].astype(np.uint32).tobytes(), own[at].tobytes(), counts.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SIGNED, strict=True)], schema=_SIGNED)

        for batch in batches:
            rows = []
            for doc_id, text, digest in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = shingle_set(text, words)
                if not len(found):
                    if not ship:
                        rows.append((0, doc_id, digest, 0, None, None))
                    continue
                node = node_of(found)
                if not ship:
                    rows.append((0, doc_id, digest, len(found), node, parity_sketch(found)))
                if node not in seen:  # copies within a task say it once
                    seen.add(node)
                    held.append(band_words(found, num, den))
                    owners.append(node)
                    total += len(held[-1])
                    if total >= FLUSH:
                        yield from bucketed()
                        held, owners, total = [], [], 0
            if rows:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SIGNED)[:6], strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(rows), f.type) for f in list(_SIGNED)[6:])], schema=_SIGNED)
        yield from bucketed()

    return run


MATCHED = "a long, b long, grp long, part int, members array<long>, word long, lead long"


def _runs_of(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, where each key's run begins, and how long it is."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
    keys, nodes = keys[fresh], nodes[fresh]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys, nodes, start, np.diff(np.append(start, len(keys)))


_MATCHED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grp", pa.int64()), ("part", pa.int32()), ("members", pa.list_(pa.int64())), ("word", pa.int64()), ("lead", pa.int64())])


def _rows(n: int, **columns) -> pa.Table:
    """``n`` rows of ``MATCHED``, null where no column is given."""
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _MATCHED], schema=_MATCHED)


def _match(bucket: pa.Table) -> pa.Table:
    """Of one bucket: the least member of each group with each other, and groups of three or more.

    Of one ``part`` of a split bucket, which holds some members of each group: the least of
    these with each other, what there is of each group, and its word with that least member.
    """
    part = bucket.column("part")[0].as_py()
    packed = [bucket.column(c).to_pylist() for c in ("words", "nodes", "counts")]
    keys = np.frombuffer(b"".join(packed[0]), np.uint32) | _U(bucket.column("bucket")[0].as_py() << 32)
    nodes = np.repeat(np.frombuffer(b"".join(packed[1]), np.int64), np.frombuffer(b"".join(packed[2]), np.uint32))
    if not part:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        shared = order[np.append(same, False) | np.append(False, same)]
        keys, nodes = keys[shared], nodes[shared]
    if not len(keys):
        return _rows(0)
    keys, nodes, start, size = _runs_of(keys, nodes)
    leader = np.repeat(nodes[start], size)
    star = np.unique(np.stack([leader, nodes], 1)[leader != nodes], axis=0)
    out = _rows(len(star), a=star[:, 0], b=star[:, 1])
    if part:
        more = _rows(len(start), grp=keys[start].view(np.int64), part=np.full(len(start), part), members=np.split(nodes, start[1:]), word=keys[start].view(np.int64), lead=nodes[start])
    else:
        groups: dict[int, np.ndarray] = {}
        for lo, n in zip(start[size > 2], size[size > 2], strict=True):
            members = nodes[lo : lo + n]
            groups.setdefault(xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63), members)
        more = _rows(len(groups), grp=list(groups), part=np.zeros(len(groups), np.int32), members=list(groups.values()))
    return pa.concat_tables([out, more])


def _words_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)


def _near(num: int, den: int):
    """Keeps pairs whose sketches are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(k).to_pylist() for k in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True):
                size = min(len(sa), len(sb)) // 8
                away = np.bitwise_count(_fold(_words_of([sa]), size) ^ _fold(_words_of([sb]), size)).sum()
                keep.append(bool(den * min(na, nb) >= num * max(na, nb) and away <= _allowed(na, nb, num, den)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "rep_a", "rep_b"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [shingle_set(x, words) for x in part.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "items"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common >= num * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _nearest(p: np.ndarray, q: np.ndarray, away: np.ndarray, n: int) -> np.ndarray:
    """Which pairs are among the ``n`` nearest of either end."""
    pick = np.zeros(len(p), bool)
    for end in (p, q):
        order = np.lexsort((p + q, away, end))
        first = np.append(True, end[order][1:] != end[order][:-1])
        nth = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
        pick[order[nth < n]] = True
    return pick


def _residual(num: int, den: int, nearest: int | None):
    """Near pairs of different components within runs of rows of one group and block pair.

    Rows are (grp, i, j, node, root, n, sketch, block, grps).  ``grps`` are
    some of the node's groups; a pair that has a lesser one of them in common is left to that.
    Without ``nearest`` all other pairs are given; with it, a run that has more than that many
    a member gives the nearest of each member, and a row of null and its group says that others are left.
    """

    def pairs(rows: list[tuple]) -> tuple[list[tuple[int, int]], bool]:
        held, count, partial = [np.empty((3, 0), np.int64)], 0, False
        node = np.array([r[3] for r in rows], np.int64)
        root = np.array([r[4] for r in rows], np.int64)
        n = np.array([r[5] for r in rows], np.int64)
        block = np.array([r[7] for r in rows], np.int64)
        width = np.array([len(r[6]) // 8 for r in rows], np.int64)
        across = rows[0][1] != rows[0][2]
        if (root == root[0]).all():
            return [], False
        before = [frozenset(g for g in r[8] if g < r[0]) for r in rows]
        for w in np.unique(width):
            low = np.flatnonzero(width == w)
            # sizes of linked sets differ den / num times at most, widths less than twice that
            for v in np.unique(width[(width >= w) & (width * num < 2 * w * den)]):
                other = np.flatnonzero(width == v)
                x = _words_of([rows[i][6] for i in low])
                y = _fold(_words_of([rows[i][6] for i in other]), w)
                step = max(1, STRIP // len(other))
                chunk = max(1, STRIP // int(w))
                for s in range(0, len(low), step):
                    i = low[s : s + step]
                    ok = (root[i][:, None] != root[other][None, :]) & (np.minimum(n[i][:, None], n[other]) * den >= np.maximum(n[i][:, None], n[other]) * num)
                    if v == w:
                        ok &= i[:, None] < other[None, :]
                    if across:
                        ok &= block[i][:, None] != block[other][None, :]
                    at, to = np.nonzero(ok)
                    for k in range(0, len(at), chunk):
                        a, b = at[k : k + chunk], to[k : k + chunk]
                        away = np.bitwise_count(x[s + a] ^ y[b]).sum(axis=1, dtype=np.int64)
                        good = np.flatnonzero(away <= _allowed(n[i[a]], n[other[b]], num, den))
                        first = [before[p].isdisjoint(before[q]) for p, q in zip(i[a[good]].tolist(), other[b[good]].tolist(), strict=True)]
                        good = good[np.array(first, bool)]
                        found = np.stack([node[i[a[good]]], node[other[b[good]]], away[good]])
                        count += found.shape[1]
                        partial = bool(nearest and count > nearest * len(rows))
                        held.append(found[:, _nearest(*found, nearest)] if partial else found)
        p, q, away = np.concatenate(held, axis=1)
        if partial:
            pick = _nearest(p, q, away, nearest)
            p, q = p[pick], q[pick]
        return list(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), strict=True)), partial

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: set[tuple[int | None, int]] = set()

        def take():
            new, partial = pairs(held)
            found.update(new)
            if partial:
                found.add((None, held[0][0]))

        def out():
            cols = list(zip(*found, strict=True)) if found else [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    take()
                    held = []
                    if len(found) > 500_000:
                        yield out()
                        found.clear()
                held.append(row)
        if held:
            take()
        yield out()

    return run


class _Join:
    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.ws = Workspace(docs.sparkSession, "ngram")
        self.docs = docs.select(key_of("doc_id").alias("doc_id"), text_of("text").alias("text"))
        self.words, self.num, self.den = words, num, den
        #: groups with pairs that no round has given yet; None before the first round: all.
        self.unfinished: DataFrame | None = None

    def sign(self) -> None:
        size = self.docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n_buckets = min(1 << 30, bucket_count(size // 15, BUCKET_WORDS))  # about a word in 15 bytes
        signed = self.docs.withColumn("hash", F.xxhash64("text"))
        pass_ = lambda ship: _sign(self.words, self.num, self.den, n_buckets, ship)
        # words are made again for their shuffle rather than written too, as they are most of the disk
        buckets = signed.mapInArrow(pass_(True), SIGNED).select("bucket", "words", "nodes", "counts")
        signed = self.ws.save(signed.mapInArrow(pass_(False), SIGNED), "signed")
        self.members = self.ws.save(signed.where("kind = 0").select("doc_id", "hash", "n", "node"), "members")
        first = signed.where("kind = 0 and n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "hash", "n", "sketch")).alias("x"))
        self.nodes = self.ws.save(first.select("node", F.col("x.doc_id").alias("rep"), F.col("x.hash").alias("rep_hash"), "x.n", "x.sketch"), "nodes")
        # a word that very many sets share makes its bucket hot: such buckets are dealt to parts by node
        hot = signed.where("kind = 2").groupBy("bucket").agg(F.sum("n").alias("total")).where(F.col("total") > HOT_TIMES * BUCKET_WORDS)
        hot = self.ws.save(hot.select("bucket", F.ceil(F.col("total") / BUCKET_WORDS).cast("int").alias("parts")), "hot")
        self.ws.drop("signed")
        dealt = buckets.join(hot, "bucket", "left")
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("nodes"), F.col("parts")).cast("int") + 1)
        dealt = dealt.withColumn("part", part).drop("parts")
        self.matched = self.ws.save(dealt.groupBy("bucket", "part").applyInArrow(_match, MATCHED), "matched")
        self.ws.drop("hot")

    def tried(self) -> DataFrame:
        """Distinct pairs of a group's least member and another; parts of a group meet by their least members."""
        stars = self.matched.where("a is not null").select("a", "b")
        leads = self.matched.where("word is not null").select("word", "lead")
        least = leads.groupBy("word").agg(F.min("lead").alias("least"))
        across = leads.join(least, "word").where("least != lead").select(F.col("least").alias("a"), F.col("lead").alias("b"))
        return self.ws.save(stars.unionByName(across).distinct(), "tried")

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        """Of distinct ``pairs(a, b)`` those whose sets are similar enough."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        known = self.nodes.join(F.broadcast(ends), "node", "left_semi") if few_rows(ends, BROADCAST_ROWS) else self.nodes
        side = lambda s: known.select(*[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "sketch")], F.col("node").alias(s))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b")
        near = self.ws.save(near.mapInArrow(_near(self.num, self.den), "a long, b long, rep_a long, rep_b long"), f"near_{label}")
        wanted = near.select(F.col("a").alias("node"), F.col("rep_a").alias("doc_id")).union(near.select("b", "rep_b")).distinct()
        wanted = self.ws.save(wanted, f"wanted_{label}")
        reps = wanted.select("doc_id").distinct()
        few = few_rows(wanted, BROADCAST_ROWS)
        texts = self.docs.join(F.broadcast(reps) if few else reps, "doc_id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets(self.words), "node long, items binary").dropDuplicates(["node"])
        sets = self.ws.save(sets.join(F.broadcast(wanted) if few else wanted, "node", "left_semi"), f"sets_{label}")
        item = lambda s: sets.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}"))
        checked = near.select("a", "b").join(item("a"), "a").join(item("b"), "b").select("a", "b", "items_a", "items_b")
        linked = self.ws.save(checked.mapInArrow(_verify(self.num, self.den), "a long, b long"), f"linked_{label}")
        self.ws.drop(f"near_{label}", f"wanted_{label}", f"sets_{label}")
        return linked

    def residual(self, roots: DataFrame, tried: DataFrame, label: str, nearest: int | None) -> tuple[DataFrame, bool]:
        """Pairs left to try: near by sketch, in one group, in different components; whether others are left.

        Members of a group's largest component are met by the others only, not by one another.
        Groups that had nothing left in the round before are done: all their pairs were given,
        or left to lesser groups, which give them or are unfinished.
        """
        groups = self.matched.where("grp is not null").select("grp", "part", "members").dropDuplicates(["grp", "part"])
        if self.unfinished is not None:
            groups = groups.join(self.unfinished, "grp", "left_semi")
        rows = groups.select("grp", F.explode("members").alias("node"))
        rows = self.ws.save(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"grouped_{label}")
        by_root = rows.groupBy("grp", "root").agg(F.count("*").alias("n"))
        mixed = by_root.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("roots")).where("roots > 1")
        blocks = lambda c: F.ceil(c / BLOCK).cast("int")
        mixed = mixed.select("grp", F.col("top.root").alias("major"), blocks(F.col("total") - F.col("top.n")).alias("minors"), blocks(F.col("top.n")).alias("majors"))
        rows = self.ws.save(rows.join(mixed, "grp"), f"mixed_{label}")
        # a node has as many groups as words at most
        grps = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("grp")), 1, NAMED_GROUPS).alias("grps"))
        known = self.nodes.select("node", "n", "sketch").join(grps, "node")
        minor = F.col("root") != F.col("major")
        own = F.when(minor, F.pmod(F.xxhash64("node"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).cast("int")
        last = F.when(minor, F.col("minors") + F.col("majors") - 1).otherwise(F.col("minors") - 1)
        rows = rows.withColumn("block", own).withColumn("to", F.explode(F.sequence(F.lit(0), last))).join(known, "node")
        rows = rows.select("grp", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "node", "root", "n", "sketch", "block", "grps")
        rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
        found = rows.mapInArrow(_residual(self.num, self.den, nearest), "a long, b long").distinct()
        found = self.ws.save(found.join(tried, ["a", "b"], "left_anti"), f"residual_{label}")
        self.ws.drop(f"grouped_{label}", f"mixed_{label}")
        self.unfinished = found.where("a is null").select(F.col("b").alias("grp"))
        return found.where("a is not null"), not self.unfinished.isEmpty()


def ngram_join(docs: DataFrame, *, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    Two documents are linked when their sets of distinct ``words``-word shingles have
    Jaccard similarity of ``num / den`` or more; a component's id is its smallest doc_id.
    Texts of fewer words are one shingle; null texts and texts without words have none and
    are linked with nothing.  A null id sorts last: such a row's component is its smallest
    non-null id, or null.  Repeated rows are kept, and linked like any equal texts.  An
    empty table gives no rows.  Other columns are ignored.
    """
    return ngram_groups(docs, words=words, num=num, den=den).select("doc_id", "n_shingles", "component_id")


def ngram_groups(docs: DataFrame, *, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``ngram_join`` with ``text_hash`` (xxhash64 of the text, null read as empty) and ``kept``.

    ``kept`` marks one document of each component, that with the smallest doc_id and of
    these the one with the smallest hash; texts without words are all kept.
    """
    join = _Join(docs, words, num, den)
    ws = join.ws
    join.sign()
    tried = join.tried()
    linked = join.links(tried, "0")
    roots = connected_components(ws, linked, "cc0")
    # the nearest pairs of large groups join most of what is apart; once they link nothing new, all others are tried
    turn, nearest, partial = 0, NEAREST, True
    while partial:
        turn += 1
        more, partial = join.residual(roots, tried, str(turn), nearest)
        new = join.links(more, str(turn)) if not more.isEmpty() else more
        if new.isEmpty():
            nearest = None
            continue
        tried, linked = tried.unionByName(more), linked.unionByName(new)
        roots = connected_components(ws, linked, f"cc{turn}")
    labelled = join.nodes.select("node", "rep", "rep_hash").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min(F.struct("rep", "rep_hash")).alias("x")).select("root", F.col("x.rep").alias("component"), F.col("x.rep_hash").alias("component_hash"))
    component = ws.save(labelled.join(smallest, "root").select("node", "component", "component_hash"), "components")
    out = join.members.join(component, "node", "left")
    real = lambda c: F.when(c != NULL_ID, c)
    kept = (F.col("n") == 0) | ((F.col("doc_id") == F.col("component")) & (F.col("hash") == F.col("component_hash")))
    return out.select(
        real(F.col("doc_id")).alias("doc_id"), F.col("hash").alias("text_hash"), F.col("n").alias("n_shingles"),
        real(F.coalesce("component", "doc_id")).alias("component_id"), kept.alias("kept"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
