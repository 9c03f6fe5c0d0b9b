"""Operator 1: benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents inside a task. Its texts are split
into words, words become codes of the benchmark vocabulary (0: not in it), and
an FM-index is built over the shard's code sequence: suffix array by prefix
doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix
positions. All windows of all benchmark items are searched at once, last word
first, by wavelet ranks; occurrences are located by walking to the next sampled
position, and their spans are merged per document.

Indexed are the runs of vocabulary words that are long enough to hold the
shortest window, each distinct run of the shard once: no occurrence can lie
elsewhere, so this loses nothing and copies cost nothing.

The windows travel as a broadcast of bounded size: a benchmark above
``max_bench_bytes`` is cut into parts, and the documents pass through one
search per part in the same task (no shuffle in either case).

Cases: null and wordless texts have no words, are never hit and are not
contaminated; null or wordless items have no windows; windows of an item with
null item_id remove words but name no item; repeated rows are judged one by
one; repeated item_ids count once; an empty benchmark hits nothing; an empty
table gives no rows. ``keep`` columns pass through unchanged; result columns
whose names clash with them get a trailing underscore.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sha_hex, text_bytes

WINDOW = 13
MAX_BENCH_BYTES = 16 << 20     # of benchmark text per broadcast part
SHARD_SYMBOLS = 1 << 21        # of one FM-index (a longer run stays whole)
SAMPLE = 8                     # every 8th suffix position is kept
# ASCII: A-Z to a-z, 0-9 and a-z stay, the rest separates; bytes >= 0x80 are word bytes
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


# ---------------------------------------------------------------- FM-index

def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (``s`` ends in a unique smallest symbol)."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        new = np.empty(n, np.int64)
        new[sa] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = new
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level."""

    def __init__(self, s: np.ndarray, top: int):
        self.shifts = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for sh in self.shifts:
            bit = (s >> sh) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k], for all k."""
        start = np.zeros_like(i)
        for sh, ones, zeros in zip(self.shifts, self.ones, self.zeros):
            bit = ((c >> sh) & 1).astype(bool)
            ri, rs = ones[i], ones[start]
            i = np.where(bit, zeros + ri, i - ri)
            start = np.where(bit, zeros + rs, start - rs)
        return i - start


class FMIndex:
    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))[:-1]
        self.wm = WaveletMatrix(self.bwt, top)
        kept = sa % sample == 0
        self.kept, self.kept_rank = kept, np.cumsum(kept) - 1
        self.positions = sa[kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``patterns``: suffix ranges [lo, hi)."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.first[c] + self.wm.rank(c, lo[live])
            hi[live] = self.first[c] + self.wm.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps to a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            r = rows[left]
            done = self.kept[r]
            out[left[done]] = self.positions[self.kept_rank[r[done]]] + steps
            left, r = left[~done], r[~done]
            c = self.bwt[r]
            rows[left] = self.first[c] + self.wm.rank(c, r)
            steps += 1
        return out


# ---------------------------------------------------------------- windows

def windows_of(items, window: int = WINDOW) -> dict:
    """vocab {word: code >= 2}, patterns {length: matrix}, ids {length: list of
    sorted item_id tuples} of the (item_id, text) pairs."""
    vocab: dict[bytes, int] = {}
    found: dict[tuple, set] = {}
    for item, text in items:
        codes = [vocab.setdefault(w, len(vocab) + 2) for w in words_of((text or "").encode())]
        n = min(window, len(codes))
        for i in range(len(codes) - n + 1 if n else 0):
            ids = found.setdefault(tuple(codes[i:i + n]), set())
            if item is not None:
                ids.add(item)
    by_len: dict[int, list] = {}
    for k in found:
        by_len.setdefault(len(k), []).append(k)
    return {"vocab": vocab, "patterns": {n: np.array(v, np.int64) for n, v in by_len.items()},
            "ids": {n: [tuple(sorted(found[k])) for k in v] for n, v in by_len.items()}}


def search_shard(runs: list[np.ndarray], win: dict) -> list[tuple]:
    """Per run of codes: (merged hit spans as an (n, 2) array, item_ids)."""
    top = len(win["vocab"]) + 1
    lens = np.array([len(r) for r in runs])
    starts = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
    text = np.ones(int(lens.sum()) + len(runs) + 1, np.int64)     # 1 separates runs
    text[-1] = 0
    for s, r in zip(starts, runs):
        text[s:s + len(r)] = r
    fm = FMIndex(text, top)
    cover = np.zeros(len(text) + 1, np.int64)
    items: list[set] = [set() for _ in runs]
    for n, patterns in win["patterns"].items():
        lo, hi = fm.search(patterns)
        cnt = hi - lo
        which = np.repeat(np.arange(len(patterns)), cnt)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(lo, cnt)
        pos = fm.locate(rows)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + n, -1)
        run = np.searchsorted(starts, pos, "right") - 1
        for r, p in set(zip(run.tolist(), which.tolist())):
            items[r].update(win["ids"][n][p])
    hit = np.concatenate(([False], np.cumsum(cover) > 0))
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    a, b = edge[::2], edge[1::2]
    run = np.searchsorted(starts, a, "right") - 1
    cut = np.searchsorted(run, np.arange(len(runs) + 1))
    return [(np.stack([a[i:j], b[i:j]], 1) - starts[r], items[r])
            for r, (i, j) in enumerate(zip(cut[:-1], cut[1:]))]


def scan_texts(texts, win: dict, shard: int = SHARD_SYMBOLS) -> list[tuple]:
    """Per text (UTF-8 bytes): (n_words, hit spans in words, item_ids)."""
    shortest = min(win["patterns"], default=0)
    get = win["vocab"].get
    distinct: dict[bytes, int] = {}
    runs: list[np.ndarray] = []
    per_doc, n_words = [], []
    for data in texts:
        words = words_of(data)
        n_words.append(len(words))
        own = []
        if shortest and len(words) >= shortest:
            codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            known = np.concatenate(([False], codes > 0, [False]))
            edge = np.flatnonzero(known[1:] != known[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= shortest:
                    r = codes[a:b]
                    k = distinct.setdefault(r.tobytes(), len(runs))
                    if k == len(runs):
                        runs.append(r)
                    own.append((a, k))
        per_doc.append(own)
    hits, at = [], 0
    while at < len(runs):
        end, size = at, 0
        while end < len(runs) and (end == at or size + len(runs[end]) < shard):
            size += len(runs[end]) + 1
            end += 1
        hits += search_shard(runs[at:end], win)
        at = end
    out = []
    for n, own in zip(n_words, per_doc):
        spans = [hits[k][0] + a for a, k in own if len(hits[k][0])]
        ids = set().union(*(hits[k][1] for a, k in own)) if own else set()
        out.append((n, np.concatenate(spans) if spans else np.zeros((0, 2), np.int64), ids))
    return out


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) spans, sorted."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[ends]], 1)


# ---------------------------------------------------------------- operator

def _bench_parts(bench: DataFrame, id_col: str, text_col: str, limit: int):
    """Benchmark rows on the driver, one part of bounded size at a time."""
    b = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-2 * total // limit) if total > limit else 1)
    for k in range(parts):
        part = b if parts == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", keep=("doc_id",),
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       max_bench_bytes: int = MAX_BENCH_BYTES) -> DataFrame:
    """``keep`` columns plus n_words, n_hit, items array<bigint>, spans
    array<struct<start,end>> (removal spans in words, merged) and contaminated."""
    import pyarrow as pa
    keep = list(keep)
    names = {}
    for c in ("n_words", "n_hit", "items", "spans", "contaminated"):
        names[c] = fresh(c, keep + list(names.values()))
    text = fresh("__text", keep)
    span_t = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    d = docs.select(*keep, F.col(text_col).alias(text))
    out_t = T.StructType(list(d.schema.fields) + [
        T.StructField(names["n_words"], T.LongType()), T.StructField(names["items"], T.ArrayType(T.LongType())),
        T.StructField(names["spans"], span_t)])
    d = (d.withColumn(names["n_words"], F.lit(None).cast("long"))
          .withColumn(names["items"], F.lit(None).cast("array<bigint>"))
          .withColumn(names["spans"], F.lit(None).cast(span_t)))
    sc = docs.sparkSession.sparkContext
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def searcher(bc):
        def run(batches):
            for batch in batches:
                data, off, _ = text_bytes(batch.column(text))
                got = scan_texts((data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())), bc.value)
                old_items = batch.column(names["items"]).to_pylist()
                old_spans = batch.column(names["spans"]).to_pylist()
                items, flat, ends = [], [], [0]
                for (n, spans, ids), oi, os_ in zip(got, old_items, old_spans):
                    if os_:
                        spans = merge_spans(np.concatenate((spans, [(x["start"], x["end"]) for x in os_])))
                    items.append(sorted(ids.union(oi or ())))
                    flat.append(spans)
                    ends.append(ends[-1] + len(spans))
                flat = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
                spans = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))
                cols = [batch.column(c) for c in keep + [text]]
                cols += [pa.array([g[0] for g in got], pa.int64()), pa.array(items, pa.list_(pa.int64())),
                         spans.cast(arrow_span)]
                yield pa.RecordBatch.from_arrays(cols, names=keep + [text, names["n_words"], names["items"],
                                                                    names["spans"]])
        return run

    for part in _bench_parts(bench, item_col, item_text_col, max_bench_bytes):
        d = d.mapInArrow(searcher(sc.broadcast(windows_of(part, window))), out_t)
    spans, n = F.col(names["spans"]), F.col(names["n_words"])
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return d.drop(text).select(
        *keep, n, n_hit.alias(names["n_hit"]), names["items"], spans,
        ((n_hit > 0) & (20 * n_hit >= n)).alias(names["contaminated"]))


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    r = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    sha_hex(ids).alias("items_sha256"), "contaminated")


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
p AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
h AS (SELECT p.rid, p.i, p.n, win.item_id FROM p JOIN win ON win.n = p.n AND win.g = list_slice(p.w, p.i, p.i + p.n - 1)),
pos AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items,
              array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
