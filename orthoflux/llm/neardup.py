"""Near-duplicate documents: one-permutation MinHash with optimal densification.

Words are lower-cased (A-Z) and taken whole; a document's set holds the distinct
five-word shingles (all words as one shingle where there are fewer).  Two documents
are linked when ``100 * |A & B| >= 75 * |A | B|``.

1. Equal sets are collapsed to their least id, so groups of exact copies of any size
   go on as one row.
2. One hash per shingle fills ``BINS`` bins; empty bins borrow from a bin probed by
   a universal hash of (bin, attempt) until a filled one is met.
3. ``BANDS`` bands of ``ROWS`` bins make buckets.  Each bucket gives two stars: every
   member is compared with the least member and with the hub, the member that shares
   most buckets with others, so a bucket of n gives less than 2n pairs.
4. Stars are confirmed on full sets and turned into components; a size ratio and the
   agreement of four-bit sketches, over four standard deviations wide, thin the pairs
   inside the join.  What a star may have missed are links between members of one
   bucket that are in different components.  Buckets with such members are tied into
   groups, a group is cut into blocks of bounded size, and the sketches and sets of a
   block are written once into the shared folder.  A task that compares two blocks is
   dealt their names only; it loads sketches, and sets of the few documents whose
   sketches agree, and gives the links that join components, fewer than documents.
5. The components of all confirmed links are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import graph_components
from ..skew import own_exchange
from .storage import attempt, keep, materialize, open_input, scope, scratch, write_atomically
from .text import U, chunks, mix, words_of

SHINGLE, BINS, ROWS = 5, 256, 6
BANDS = BINS // ROWS
#: Of 256 bins, how many must agree (in four bits each) in linked sets of at least SKETCH_MIN shingles: at the threshold
#: 196 are expected with a deviation of 7 (measured for sets of 12 to 600), so 166 is over four deviations below.
SKETCH_PLANES, SKETCH_AGREE, SKETCH_MIN = 4, 166, 12
#: Documents of one block in the second round, and bytes of sets that one comparison holds.
BLOCK, HELD_BYTES = 512, 64 << 20


def shingle_sets(texts: pa.Array, length: int = SHINGLE):
    """Sorted distinct shingle hashes (uint64) of each text, in order."""
    for first, last, buf, offs in chunks(texts):
        words = words_of(buf, offs, lower=True)
        p, h = words.windows(length)
        at = np.searchsorted(p, words.offs)
        for d in range(last - first):
            own = h[at[d] : at[d + 1]]
            if not len(own):
                w = words.hashes[0][words.offs[d] : words.offs[d + 1]]
                own = mix(w * U(0x9FB21C651E98DF25) + U(len(w))) if len(w) == 1 else w
                for x in own[1:] if len(w) > 1 else ():
                    own = mix(own[:1] * U(0x9FB21C651E98DF25) + x)
                yield own[:1]
            else:
                yield np.unique(own)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation signatures; rows of empty sets are all zero."""
    sig = np.zeros((len(sets), bins), U)
    filled = np.zeros((len(sets), bins), bool)
    for d, s in enumerate(sets):
        if len(s):
            b = (s >> U(56)).astype(np.int64) * bins >> 8
            lead = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            sig[d, b[lead]], filled[d, b[lead]] = s[lead], True
    some = filled.any(axis=1)
    r, c = np.nonzero(~filled & some[:, None])
    cols, attempt = np.arange(bins, dtype=U), 0
    while len(r):
        attempt += 1
        j = (mix(cols * U(0x9E3779B97F4A7C15) + U(attempt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % U(bins)).astype(np.int64)[c]
        ok = filled[r, j]
        sig[r[ok], c[ok]] = sig[r[ok], j[ok]]
        r, c = r[~ok], c[~ok]
    return sig


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of every mixed signature bin, as planes of 256 bits: sixteen longs."""
    m = mix(sig)
    planes = [np.packbits(((m >> U(p)) & U(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(SKETCH_PLANES)]
    return np.ascontiguousarray(np.hstack(planes))


_SIGNED = "id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>"


def _sign(batches):
    mults = mix(np.arange(1, ROWS + 1, dtype=U))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = list(shingle_sets(part.column(1)))
            sig = signatures(sets)
            bands = np.zeros((len(sets), BANDS), U)
            for r in range(ROWS):
                bands += sig[:, r : BANDS * ROWS : ROWS] * mults[r]
            bands = mix(bands + mix(np.arange(BANDS, dtype=U)))
            n = np.array([len(s) for s in sets], np.int64)
            s1 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], U)
            s2 = np.array([np.add.reduce(mix(s ^ U(0xD1B54A32D192ED03))) if len(s) else 0 for s in sets], U)
            lists = lambda a: pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * a.shape[1], a.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists(bands), lists(_sketch(sig))], names=["id", "n_shingles", "s1", "s2", "bands", "sketch"])


def _confirm(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keep = []
            for i, (a, b) in enumerate(zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= 75 * (len(a) + len(b) - both))
            kept = part.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def confirm_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose full shingle sets pass; ``texts(id, text)``."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirm, "a long, b long").distinct()


def _alike(x: str, y: str) -> F.Column:
    """Whether sizes and sketches of rows x and y allow a link."""
    words = BINS // 64
    apart = F.lit(0)
    for i in range(words):
        unequal = " | ".join(f"({x}.sketch[{p * words + i}] ^ {y}.sketch[{p * words + i}])" for p in range(SKETCH_PLANES))
        apart = apart + F.bit_count(F.expr(unequal))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (n * 4 >= m * 3) & (m * 4 >= n * 3) & ((F.least(n, m) < SKETCH_MIN) | (apart <= BINS - SKETCH_AGREE))


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches (rows of sixteen longs) of each x and y agree in enough bins."""
    words = BINS // 64
    out = np.empty((len(x), len(y)), bool)
    for i in range(len(x)):
        unequal = x[i] ^ y
        any_ = unequal[:, :words].copy()
        for p in range(1, SKETCH_PLANES):
            any_ |= unequal[:, p * words : (p + 1) * words]
        out[i] = np.bitwise_count(any_.view(U)).sum(1, dtype=np.int64) <= BINS - SKETCH_AGREE
    return out


_PACKED = "g long, blk long, uri string, at long, n_docs long"


def _pack(folder: str):
    """Writes blocks (rows in order of group and block) into one file a task and names them.

    A block is four columns of longs (id, size, component, place of the set) and the
    sketches; the sets, as sorted unsigned longs, stand before it.
    """

    def run(batches):
        uri, named = f"{folder}/{attempt()}.sets", []

        def write(out):
            key, rows, at = None, [], 0

            def close():
                nonlocal at
                if rows:
                    head = np.array([r[:4] for r in rows], "<i8").T.tobytes() + np.array([r[4] for r in rows], "<i8").tobytes()
                    out.write(head)
                    named.append((*key, uri, at, len(rows)))
                    at += len(head)
                    rows.clear()

            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    cols = [part.column(c).to_pylist() for c in ("g", "blk", "id", "c", "sketch")]
                    for (g, blk, doc, c, sketch), own in zip(zip(*cols, strict=True), shingle_sets(part.column("text")), strict=True):
                        if (g, blk) != key:
                            close()
                            key = (g, blk)
                        out.write(own.astype("<u8").tobytes())
                        rows.append((doc, len(own), c, at, sketch))
                        at += 8 * len(own)
            close()

        write_atomically(uri, write)
        cols = list(zip(*named, strict=True)) or [()] * 5
        kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "blk", "uri", "at", "n_docs"])

    return run


class _Block:
    """A block of ``_pack``; sets are loaded one by one and at most ``HELD_BYTES`` of them kept."""

    def __init__(self, uri: str, at: int, n_docs: int):
        self._in = open_input(uri)
        self._in.seek(at)
        longs = np.frombuffer(self._in.read(8 * n_docs * (4 + SKETCH_PLANES * BINS // 64)), "<i8")
        self.ids, self.n, self.c, self._at = longs[: 4 * n_docs].reshape(4, n_docs)
        self.sketch = longs[4 * n_docs :].reshape(n_docs, -1)
        self._sets: dict[int, np.ndarray] = {}
        self._held = 0

    def set_of(self, i: int) -> np.ndarray:
        got = self._sets.get(i)
        if got is None:
            self._in.seek(int(self._at[i]))
            got = np.frombuffer(self._in.read(8 * int(self.n[i])), "<u8")
            if self._held + got.nbytes > HELD_BYTES:
                self._sets.clear()
                self._held = 0
            self._sets[i] = got
            self._held += got.nbytes
        return got

    def close(self) -> None:
        self._in.close()


def _links_between(x: _Block, y: _Block) -> list[tuple[int, int]]:
    """Links between documents of two blocks (or of one) that join components not joined by the links before."""
    n, m = x.n[:, None], y.n[None]
    may = (_agreeing(x.sketch, y.sketch) | (np.minimum(n, m) < SKETCH_MIN)) & (4 * n >= 3 * m) & (4 * m >= 3 * n) & (x.c[:, None] != y.c[None])
    if x is y:
        may = np.triu(may, 1)
    root: dict[int, int] = {}

    def find(k):
        while k in root:
            k = root[k]
        return k

    out = []
    for i, j in np.argwhere(may).tolist():
        p, q = find(int(x.c[i])), find(int(y.c[j]))
        if p == q:
            continue
        a, b = x.set_of(i), y.set_of(j)
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            root[max(p, q)] = min(p, q)
            out.append((int(max(x.ids[i], y.ids[j])), int(min(x.ids[i], y.ids[j]))))
    return out


def _compare(batches):
    for batch in batches:
        for row in batch.to_pylist():
            x = _Block(row["uri"], row["at"], row["n_docs"])
            same = (row["uri"], row["at"]) == (row["uri2"], row["at2"])
            y = x if same else _Block(row["uri2"], row["at2"], row["n_docs2"])
            found = _links_between(x, y)
            x.close()
            y.close()
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def rest_links(rows: DataFrame, together: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)``: links that join all components which a link between ``rows(id, n, sketch, c)`` in one bucket joins.

    ``together(bucket, id)`` ties rows into groups.  A group is cut into blocks of about
    ``BLOCK`` documents and every two blocks are compared: work that is quadratic in a
    group of alike texts below the threshold, though in steps of bounded memory, and
    nothing but the names of blocks is dealt for it.
    """
    spark = rows.sparkSession
    first = together.groupBy("bucket").agg(F.min("id").alias("root"))
    ties = together.join(own_exchange(first, "bucket"), "bucket").where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    group = graph_components(ties)
    mine = materialize(rows.join(group, rows.id == group.node).drop("node").withColumnRenamed("component", "g"), "grouped")
    sizes = mine.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    placed = mine.join(own_exchange(sizes, "g"), "g").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(texts, "id")
    dealt = placed.select("g", "blk", "id", "c", "sketch", "text").repartition("g", "blk").sortWithinPartitions("g", "blk", "id")
    packed = materialize(dealt.mapInArrow(_pack(scratch(spark, "sets")), _PACKED), "packed")
    own = packed.join(own_exchange(sizes, "g"), "g").select("*", F.explode(F.sequence("blk", F.col("blocks") - 1)).alias("o"))
    other = packed.select("g", F.col("blk").alias("o"), F.col("uri").alias("uri2"), F.col("at").alias("at2"), F.col("n_docs").alias("n_docs2"))
    pairs = own.join(other, ["g", "o"]).select("uri", "at", "n_docs", "uri2", "at2", "n_docs2")
    # about four comparisons of whole blocks a task, or many of small ones
    work = pairs.agg(F.sum(F.col("n_docs") * F.col("n_docs2") + 8192)).first()[0] or 0
    tasks = max(1, min(work // (4 * BLOCK * BLOCK) + 1, 1_000_000))
    return pairs.repartition(tasks, "uri", "at", "uri2", "at2").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Null and blank texts have an empty set and are linked with nothing; rows with a
    null id are kept, unlinked, with a null component.  Repeated rows come back as
    often as they came; of different texts under one id a link of any counts for the
    id.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with scope(spark) as own:
        signed = materialize(base.mapInArrow(_sign, _SIGNED), "signed")
        whole = signed.where("n_shingles > 0 AND id IS NOT NULL")
        key = ["n_shingles", "s1", "s2"]
        classes = materialize(whole.groupBy(*key).agg(F.min("id").alias("rep")), "classes")
        # the rows of a class meet nowhere: only that of its least id is looked up, by its id
        lead = own_exchange(classes.select(*key, F.col("rep").alias("id")), "id", *key)
        one = whole.join(lead, ["id", *key]).groupBy("id", *key).agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        reps = materialize(one.select("id", F.col("n_shingles").alias("n"), "bands", "sketch"), "reps")
        # size and least member of each bucket: a partial aggregate of a few longs a bucket
        entries = reps.select("id", F.explode("bands").alias("bucket"))
        buckets = entries.groupBy("bucket").agg(F.min("id").alias("center"), F.max("id").alias("top"), F.count(F.lit(1)).alias("size")).where("center < top").drop("top")
        joined = entries.join(own_exchange(buckets, "bucket"), "bucket")
        members = materialize(joined.join(reps.select("id", "n", "sketch"), "id"), "members")
        # a second centre: the member that shares most buckets with others, as the text does that others were made from
        degrees = members.groupBy("id").agg(F.sum("size").alias("degree"))
        hubs = members.select("bucket", "id").join(degrees, "id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("order"))).alias("h")).select("bucket", (-F.col("h.order")).alias("hub"))
        centers = members.select("bucket", F.col("center").alias("id")).unionByName(hubs.select("bucket", F.col("hub").alias("id"))).distinct()
        c = own_exchange(members.select("bucket", "id", "n", "sketch").join(own_exchange(centers, "bucket", "id"), ["bucket", "id"]), "bucket", "id").alias("c")
        m = members.alias("m")
        pair = F.col("m.id"), F.col("c.id")
        stars = m.join(c, (F.col("m.bucket") == F.col("c.bucket")) & (pair[0] != pair[1]) & _alike("m", "c")).select(F.greatest(*pair).alias("a"), F.least(*pair).alias("b")).distinct()
        stars = materialize(stars, "stars")
        wanted = members.select("id").distinct()
        texts = materialize(base.join(wanted, "id").distinct(), "texts")
        links = materialize(confirm_links(stars, texts), "links")
        parts = graph_components(links)

        # round two: members of one bucket that the stars left in different components
        placed = materialize(members.select("bucket", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "placed")
        split = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket", "lo")
        open_ = materialize(placed.join(own_exchange(split, "bucket"), "bucket").select("bucket", "id", "c"), "open")
        rows = reps.select("id", "n", "sketch").join(open_.select("id", "c").distinct(), "id")
        more = materialize(rest_links(rows, open_.select("bucket", "id"), texts), "links")
        if not more.isEmpty():
            parts = graph_components(links.unionByName(more))

        found = classes.join(parts, classes.rep == parts.node, "left").select(*key, F.coalesce("component", "rep").alias("c"))
        comp = signed.where("n_shingles > 0").select("id", *key).join(own_exchange(found, *key), key, "left")
        # empty sets need no look-up
        rest = signed.where("n_shingles = 0").select("id", "n_shingles", F.lit(None).cast("long").alias("c"))
        out = keep(comp.select("id", "n_shingles", "c").unionByName(rest), "near-duplicates", own)
    comp = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
