"""Operator 6: n-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents
with equal sets form a class. Classes link when 100 * |A & B| >= 80 * |A | B|.

Sketch. Each shingle flips one bit of a long sparse bit sketch, so two
sketches differ in at most |A ^ B| bits, and with a = |A| <= b = |B| a link
needs |A ^ B| <= (a + b) / 9 <= a / 4. The sketch is cut into m blocks (kept as
XOR folds of their bits' codes: equal blocks have equal folds); at most a // 4
of them can differ, so by the pigeonhole principle a linked pair agrees on at
least ``slack + 1`` of A's non-empty blocks, slack = non-empty - a // 4 - 1.
m depends on the size band of the smaller document: every document emits its
non-empty blocks under its own band, and under the band below if a partner can
lie there. (band, block, fold) is the join key.

Candidates. One shuffle by key. A key held by at most HOT rows makes all its
pairs candidates. A hotter key (a common passage) is skipped, which is safe
unless more than ``slack`` of a document's own keys are hot. Such documents
("over": members of a large cloud of variants, or mostly made of a passage) and
documents without slack (small sets crowded into few blocks, hardly ever seen)
are a query set compared in blocks: sketch against sketch inside a task, with
the classes of a fitting size that hold one of their hot keys (all classes, for
those without slack). So no link is lost and no group emits all its pairs.

Verification. A second, compact parity sketch (1024 bits, more for large sets)
and the sizes drop nearly all false candidates: its Hamming distance may be at
most (a + b) / 9. Texts decide by exact set sizes. Only components are needed,
so each class first verifies its nearest candidate, then its nearest in another
component, and then all candidates whose ends are still apart.

Cases: words are split at space and \\t..\\r after lower-casing A-Z; fewer than 5
words are one shingle; null or wordless texts have no shingles and link with
nothing; equal rows share a class; a null doc_id takes part but is never a
component_id while another id is there; empty table: no rows; other columns
are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut_lineage, fresh, release, small_enough, text_bytes

SHINGLE = 5
HOT = 12
BLOCK = 512                     # classes a side in one unit of the block comparison
SKETCH_WORDS = 16               # 64-bit words of the compact sketch up to 1000 shingles
CHUNK_BYTES = 1 << 20           # texts are hashed about this many bytes at a time
_U = np.uint64
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser of x + salt."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _M64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 77)
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POW.get(base, ())) < n:
        p = np.full(max(n, CHUNK_BYTES + 4096), base, _U)
        p[0] = 1
        _POW[base] = np.multiply.accumulate(p)
    return _POW[base][:n]


def _word_hashes(raw: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``raw`` (``start``: flags a first byte of a text)."""
    first = word.copy()
    first[1:] &= ~word[:-1] | start[1:]
    last = word.copy()
    last[:-1] &= ~word[1:] | start[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    return mix((sums[b] - sums[a]) * _powers(_BASE_INV, len(raw) + 1)[a] + (b - a).astype(_U)), a


def shingle_sets(data: bytes, off: np.ndarray):
    """(hashes, ends): sorted distinct shingle hashes of all texts, text i's at
    ``hashes[ends[i]:ends[i + 1]]``."""
    data = data.lower()                     # bytes: only A-Z change
    n_docs = len(off) - 1
    out, counts = [], np.zeros(n_docs, np.int64)
    i = 0
    while i < n_docs:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        words, places = [], []
        at = lo
        while at < hi:                      # one long text: hashed in pieces cut at white space
            end = hi
            if hi - at > 2 * CHUNK_BYTES:
                end = at + CHUNK_BYTES
                while end < hi and not _SPACE[data[end]]:
                    end += 1
            raw = np.frombuffer(data, np.uint8, end - at, at)
            start = np.zeros(end - at, bool)
            inner = off[i:j] - at
            start[inner[(inner >= 0) & (inner < end - at)]] = True
            h, a = _word_hashes(raw, ~_SPACE[raw], start)
            words.append(h)
            places.append(a + at)
            at = end
        w = np.concatenate(words) if words else np.zeros(0, _U)
        p = np.concatenate(places) if places else np.zeros(0, np.int64)
        cut = np.searchsorted(p, off[i:j + 1])
        nw = np.diff(cut)
        if len(w) >= SHINGLE:
            acc = w[:len(w) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                acc = acc * _U(0xD6E8FEB86659FD93) + w[k:len(w) - SHINGLE + 1 + k]
            acc = mix(acc, 5)
        for d in range(j - i):
            a, n = int(cut[d]), int(nw[d])
            if n >= SHINGLE:
                s = acc[a:a + n - SHINGLE + 1]
                s.sort()
                if len(s) > 1:
                    new = np.empty(len(s), bool)
                    new[0] = True
                    np.not_equal(s[1:], s[:-1], out=new[1:])
                    s = s[new]
            elif n:
                x = 0
                for v in w[a:a + n].tolist():
                    x = (x * 0xD6E8FEB86659FD93 + v) & _M64
                s = mix(np.array([x], _U), n)
            else:
                continue
            out.append(s)
            counts[i + d] = len(s)
        i = j
    ends = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(out) if out else np.zeros(0, _U)), ends


def class_hash(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash per set (0 for an empty set)."""
    sums = np.concatenate(([_U(0)], np.cumsum(mix(h, 11), dtype=_U)))
    n = np.diff(ends)
    c = mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(_U), 12)
    return np.where(n > 0, c.view(np.int64), 0)


def bit_sketches(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Compact parity sketch of each set; one of twice the length folds to the
    shorter by XOR of its halves."""
    n = np.diff(ends)
    words = SKETCH_WORDS << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 1000))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(words * 64)))
    doc = np.repeat(np.arange(len(n)), n)
    pos = (mix(h, 21) >> _U(8)).astype(np.int64) & (words[doc] * 64 - 1)
    bits = np.bincount(base[doc] + pos, minlength=int(base[-1])) & 1
    packed = np.packbits(bits.astype(np.uint8)).tobytes()
    return [packed[i:j] for i, j in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def _distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distances of all sketches of ``a`` to all of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for x in np.unique(la):
        for y in np.unique(lb):
            i, j = np.flatnonzero(la == x), np.flatnonzero(lb == y)
            u = np.frombuffer(b"".join([a[k] for k in i]), np.uint64).reshape(len(i), -1)
            v = np.frombuffer(b"".join([b[k] for k in j]), np.uint64).reshape(len(j), -1)
            while u.shape[1] > v.shape[1]:
                u = u[:, :u.shape[1] // 2] ^ u[:, u.shape[1] // 2:]
            while v.shape[1] > u.shape[1]:
                v = v[:, :v.shape[1] // 2] ^ v[:, v.shape[1] // 2:]
            d = np.zeros((len(i), len(j)), np.int32)
            for k in range(u.shape[1]):
                d += np.bitwise_count(u[:, k, None] ^ v[None, :, k])
            out[np.ix_(i, j)] = d
    return out


def _pair_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distance of each sketch of ``a`` to that of ``b`` in its place."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    for x, y in {(int(p), int(q)) for p, q in zip(la, lb)}:
        at = np.flatnonzero((la == x) & (lb == y))
        u, v = (np.frombuffer(b"".join([s[k] for k in at]), np.uint64).reshape(len(at), -1) for s in (a, b))
        while u.shape[1] > v.shape[1]:
            u = u[:, :u.shape[1] // 2] ^ u[:, u.shape[1] // 2:]
        while v.shape[1] > u.shape[1]:
            v = v[:, :v.shape[1] // 2] ^ v[:, v.shape[1] // 2:]
        out[at] = np.bitwise_count(u ^ v).sum(1)
    return out


# bands of set sizes [BOUNDS[k], BOUNDS[k + 1]); partners (at most 5/4 as large)
# lie in the same band or the next. Sets below 4 link only when equal.
BOUNDS = [4]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(-(-BOUNDS[-1] * 7 // 5))
_BOUNDS = np.array(BOUNDS)


def n_blocks(band: int) -> int:
    """Blocks of a band: enough that the largest set of it has slack."""
    t = (BOUNDS[band + 1] - 1) // 4 + 1
    return max(64, int(t * (1.15 + 0.7 / t ** 0.5)) + 1)


_BLOCKS = np.array([n_blocks(k) for k in range(len(BOUNDS) - 1)])


def _folds(h: np.ndarray, ends: np.ndarray, band: np.ndarray):
    """(set index, key) of the non-empty blocks of the sets under ``band``."""
    m = _BLOCKS[band]
    doc = np.repeat(np.arange(len(band)), np.diff(ends))
    block = ((mix(h, 31) >> _U(32)) * m[doc].astype(_U) >> _U(32)).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(m)))
    gid = base[doc] + block
    code = mix(h, 32)
    order = np.argsort(gid, kind="stable")
    gid, code = gid[order], code[order]
    at = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1]))) if len(gid) else np.zeros(0, np.int64)
    fold = np.bitwise_xor.reduceat(code, at) if len(at) else code
    gid = gid[at]
    doc = np.searchsorted(base, gid, "right") - 1
    tag = (gid - base[doc]).astype(_U) * _U(0x9E3779B97F4A7C15) + band[doc].astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    return doc, mix(fold ^ mix(tag, 41), 42).view(np.int64)


def block_keys(h: np.ndarray, ends: np.ndarray):
    """(set index, key, slack): own-band rows carry the slack, the others -1."""
    n = np.diff(ends)
    band = np.searchsorted(_BOUNDS, n, "right") - 1
    parts = []
    for own in (True, False):
        if own:
            use = n >= BOUNDS[0]
            b = band
        else:                               # a partner of 4/5 the size may lie one band below
            use = (band >= 1) & (4 * n <= 5 * (_BOUNDS[np.maximum(band, 0)] - 1))
            b = band - 1
        which = np.flatnonzero(use)
        if not len(which):
            continue
        sel = np.repeat(use, n)
        e = np.concatenate(([0], np.cumsum(n[which])))
        doc, key = _folds(h[sel], e, b[which])
        slack = np.full(len(key), -1, np.int64)
        if own:
            slack = (np.bincount(doc, minlength=len(which)) - n[which] // 4 - 1)[doc]
        parts.append((which[doc], key, slack))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _slices(off: np.ndarray, limit: int = 4 * CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes each."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls, bare (no slack), sketch:
    one row a document."""
    import pyarrow as pa
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, off, _ = text_bytes(batch.column("text"))
            for i, j in _slices(off):
                h, ends = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.diff(ends)
                own, _, slack = block_keys(h, ends)
                bare = np.zeros(j - i, bool)
                bare[own[slack >= 0]] = True
                bare = (n >= BOUNDS[0]) & ~bare
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(n),
                     pa.array(class_hash(h, ends)),
                     pa.array(bare), pa.array(bit_sketches(h, ends), pa.binary())],
                    names=["doc_id", "th", "n_shingles", "cls", "bare", "sketch"])
    return d.mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, cls long, bare boolean, sketch binary")


def sketch_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, cls, slack): the block keys of every class a task meets."""
    import pyarrow as pa

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, off, _ = text_bytes(batch.column(0))
            for i, j in _slices(off):
                h, ends = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])
                cls = class_hash(h, ends)
                unseen = np.zeros(j - i, bool)
                for d, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        unseen[d] = True
                n = np.diff(ends)
                sel = np.repeat(unseen, n)
                doc, key, slack = block_keys(h[sel], np.concatenate(([0], np.cumsum(n[unseen]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(cls[unseen][doc]), pa.array(slack.astype(np.int32))],
                    names=["key", "cls", "slack"])
    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, cls long, slack int")


def _class_texts(docs: DataFrame, reps: DataFrame, classes: DataFrame, id_col, text_col) -> DataFrame:
    """(cls, text) of the wanted classes, one text each."""
    import pyarrow as pa
    want = cut_lineage(classes.select("cls").distinct().join(reps.select("cls", "rep"), "cls"), "join-want")
    want = F.broadcast(want) if small_enough(want, 24) else want
    d = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    got = d.join(want, d["rep"].eqNullSafe(want["rep"])).select("cls", "text")

    def same(batches):                      # rows may share a doc_id: keep the class's own text
        for batch in batches:
            data, off, _ = text_bytes(batch.column("text"))
            for i, j in _slices(off):
                h, ends = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(class_hash(h, ends) == part.column("cls").to_numpy()))
    return got.mapInArrow(same, "cls long, text string").dropDuplicates(["cls"])


def _verify(docs, reps, pairs: DataFrame, id_col, text_col) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets link."""
    import pyarrow as pa
    texts = cut_lineage(_class_texts(docs, reps, pairs.select(F.col("a").alias("cls"))
                                     .union(pairs.select("b")), id_col, text_col), "join-texts")
    both = (pairs.select("a", "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b"))

    def judge(batches):
        for batch in batches:
            (da, oa, _), (db, ob, _) = (text_bytes(batch.column(c)) for c in ("ta", "tb"))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in _slices(oa):
                (ha, ea), (hb, eb) = (shingle_sets(d[o[lo]:o[hi]], o[lo:hi + 1] - o[lo]) for d, o in ((da, oa), (db, ob)))
                for i in range(hi - lo):
                    x, y = ha[ea[i]:ea[i + 1]], hb[eb[i]:eb[i + 1]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep[lo + i] = 100 * same >= 80 * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))
    return both.select("a", "b", "ta", "tb").mapInArrow(judge, "a long, b long")


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


_PAIR = "a long, b long, d double"


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """(a, b, d) of the pairs whose sizes and compact sketches allow a link; d is
    the sketch distance per shingle."""
    import pyarrow as pa
    side = lambda s: info.select(F.col("cls").alias(s), F.col("n_shingles").alias("n" + s),
                                 F.col("sketch").alias("s" + s))
    d = pairs.join(side("a"), "a").join(side("b"), "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")

    def run(batches):
        for batch in batches:
            n = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).astype(float)
            apart = _pair_distances(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()).astype(float)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"),
                                              pa.array(apart / np.maximum(n, 1))], ["a", "b", "d"])
            yield out.filter(pa.array(9 * apart <= n))
    return d.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, _PAIR)


def block_pairs(info: DataFrame, nearest: bool) -> DataFrame:
    """(a, b, d): plausible pairs of different components, of a ``query`` class
    and any class, compared in blocks of BLOCK by BLOCK sketches of a size band.
    ``nearest``: only the nearest partner of each class of a block.

    ``info``: cls, n_shingles, sketch, query, comp."""
    import pyarrow as pa
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(1.4))).cast("int")
    p = info.withColumn("band", band)
    # a partner is at most one band away: queries go to three bands
    q = p.where("query").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    sizes = (p.groupBy("band").agg(F.count(F.lit(1)).alias("np"))
             .join(q.groupBy("band").agg(F.count(F.lit(1)).alias("nq")), "band")
             .select("band", F.ceil(F.col("np") / BLOCK).cast("int").alias("bp"),
                     F.ceil(F.col("nq") / BLOCK).cast("int").alias("bq")))
    sizes = F.broadcast(sizes)              # one row a size band: under a hundred
    cols = ["cls", "n_shingles", "sketch", "comp"]
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = p.join(sizes, "band").select(*cols, "band", own("bp").alias("i"), every("bq").alias("j"), F.lit(False).alias("q"))
    right = q.join(sizes, "band").select(*cols, "band", every("bp").alias("i"), own("bq").alias("j"), F.lit(True).alias("q"))

    def unit(t):
        q = t.column("q").to_numpy()
        cls, n, comp = (t.column(c).to_numpy() for c in ("cls", "n_shingles", "comp"))
        sk = t.column("sketch").to_pylist()
        x, y = np.flatnonzero(q), np.flatnonzero(~q)
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        apart = _distances([sk[k] for k in x], [sk[k] for k in y])
        nx, ny = n[x][:, None], n[y][None, :]
        ok = (9 * apart <= nx + ny) & (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx) & (comp[x][:, None] != comp[y][None, :])
        d = np.where(ok, apart / (nx + ny), np.inf)
        if nearest:
            best = np.zeros(ok.shape, bool)
            best[np.arange(len(x)), d.argmin(1)] = True
            best[d.argmin(0), np.arange(len(y))] = True
            ok &= best
        i, j = np.nonzero(ok)
        a, b = cls[x[i]], cls[y[j]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d[i, j]})
    return left.union(right).groupBy("band", "i", "j").applyInArrow(unit, _PAIR)


def key_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, cls, slack, cnt): the rows of keys that several classes hold."""
    from pyspark.sql import Window
    w = Window.partitionBy("key")
    return (sketch_keys(docs, text_col)
            .withColumn("lo", F.min("cls").over(w)).withColumn("hi", F.max("cls").over(w))
            .withColumn("cnt", F.count(F.lit(1)).over(w)).where("lo <> hi")
            .groupBy("key", "cls").agg(F.max("slack").alias("slack"), F.max("cnt").alias("cnt")))


def query_classes(groups: DataFrame, hot: int = HOT) -> DataFrame:
    """(cls, query): classes that hold a hot key of an over class; query = over."""
    heat = groups.where(F.col("cnt") > hot)
    over = (heat.where("slack >= 0").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("slack").alias("s"))
            .where("n > s").select("cls", F.lit(True).alias("query")))
    heat = heat.select("key", "cls").join(over, "cls", "left")
    live = heat.where("query").select("key").distinct()
    return (heat.join(live, "key", "left_semi").groupBy("cls")
            .agg(F.max(F.coalesce("query", F.lit(False))).alias("query")))


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hot: int = HOT) -> DataFrame:
    """doc_id, th, n_shingles, cls, component_id (smallest doc_id reachable by
    links) and keep: true for one document of each component (equal doc_id and
    text count as one document)."""
    sets = cut_lineage(document_sets(docs, id_col, text_col), "join-sets")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    reps = cut_lineage(sets.where("n_shingles > 0").groupBy("cls").agg(F.min(best).alias("best"))
                       .select("cls", F.col("best.doc_id").alias("rep"), "best"), "join-reps")
    groups = cut_lineage(key_groups(docs, text_col), "join-groups")
    query = query_classes(groups, hot)
    bare = sets.where("bare").select("cls", F.lit(True).alias("query")).distinct()
    if not bare.isEmpty():                  # documents without slack are compared with all
        query = (sets.where("n_shingles > 0").select("cls", F.lit(False).alias("query"))
                 .union(query).union(bare).groupBy("cls").agg(F.max("query").alias("query")))
    query = cut_lineage(query, "join-query")
    seen = groups.select("cls").union(query.select("cls")).distinct()
    info = cut_lineage(sets.join(seen, "cls", "left_semi").groupBy("cls").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "join-info")
    cold = groups.where(F.col("cnt") <= hot).select("key", "cls")
    cold = (cold.join(cold.withColumnRenamed("cls", "b"), "key").where("cls < b")
            .select(F.col("cls").alias("a"), "b").distinct())
    cold = cut_lineage(_plausible(cold, info), "join-cold")
    block = cut_lineage(info.join(query, "cls"), "join-block")
    none = reps.sparkSession.createDataFrame([], "a long, b long")
    links, tested, comp = none, none, none.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for nearest in (True, True, False):
        release(reps.sparkSession)
        of = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias("r" + c))  # noqa: E731,B023
        near = block.join(of("cls"), "cls", "left").withColumn("comp", F.coalesce("rcls", "cls")).drop("rcls")
        left = (cold.join(of("a"), "a", "left").join(of("b"), "b", "left")
                .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "d")
                .union(block_pairs(near, nearest)))
        left = left.groupBy("a", "b").agg(F.min("d").alias("d")).join(tested, ["a", "b"], "left_anti")
        if nearest:
            ends = left.select("a", "b", "d", F.explode(F.array("a", "b")).alias("v"))
            left = (ends.groupBy("v").agg(F.min(F.struct("d", "a", "b")).alias("p"))
                    .select("p.a", "p.b").distinct())
        left = cut_lineage(left.select("a", "b"), "join-pairs")
        if left.isEmpty():
            break
        got = cut_lineage(_verify(docs, reps, left, id_col, text_col), "join-links")
        tested = tested.union(left)
        if not got.isEmpty():
            links = links.union(got)
            comp = components(links)
    named = reps.select("cls", "best").join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left")
    named = named.withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("best").alias("first"))
    named = cut_lineage(named.join(least, "root").select(
        "cls", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("first_th")), "join-named")
    out = sets.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls"))
    alone = F.col("n_shingles") == 0
    return (out.join(named, "cls", "left")
            .select("doc_id", "th", "n_shingles", "cls",
                    F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    (alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th"))))
                    .alias("keep")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` (all columns) without all but one document of each
    component."""
    got = cut_lineage(linked_documents(docs, id_col, text_col, hot), "join-result")
    i, h = fresh("__id", docs.columns), fresh("__th", docs.columns)
    drop = got.where(~F.col("keep")).select(F.col("doc_id").alias(i), F.col("th").alias(h)).distinct()
    drop = F.broadcast(drop) if small_enough(drop, 32) else drop
    out = docs.join(drop, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(h)), "left_anti")
    twice = got.where("keep").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if twice.isEmpty() else out.dropDuplicates([id_col, text_col])


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    return linked_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
