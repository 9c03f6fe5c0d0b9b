"""Operator 3: toxicity by a subsequence string kernel and support vectors.

Kernel. A word is its beginning (``^`` and PIECE - 1 letters) and, if longer,
overlapping pieces of PIECE letters. Pieces are compared by the gap-weighted
subsequence kernel of length P (each common subsequence counts LAMBDA per letter
it spans in either), normalised, squared, and cut off below FLOOR; so
``id-iot``, ``idxiot`` and ``1diot`` stay close to ``idiot``. Two sentences are compared by the sum over
their pairs of words (a convolution kernel). Single letters set apart
(``i d i o t``) are joined to one word first; common digit-for-letter writings
are undone.

Nystroem. Landmarks are the word beginnings that best tell the labels of the sample
apart (counted in Spark; three toxic documents of evidence at least, copies not
counted). With K the kernel of the landmarks (not cut off, so positive definite),
a sentence's coordinates are K ** -1/2 times its kernel values against them. A linear squared-hinge SVM
is trained on labelled sentences (dual coordinate descent): all sentences of
clean texts that touch a landmark, and of each toxic text the sentence that
currently scores highest, twice over. A document scores as its highest sentences,
calibrated to 0..1 (TOP sentences are added up, so one odd word weighs less than
several).

Since both maps are linear, a word's weight is one number. A task evaluates the
kernel once per distinct word and then adds up numbers per sentence of the whole
text. Landmarks that can't reach FLOOR are passed over by a proven bound: with
some of a landmark's letters missing in the word, only its subsequences of the
other letters can match, so by Cauchy-Schwarz the normalised kernel is at most
the share of the landmark's norm that these have (one table a landmark).

Cases: null and empty texts score as a text without any landmark; without labels
of both classes every score is the share of label 1 (0 without labels); repeated
rows score alike, and in the fit count as one document (the least text of a
repeated doc_id); very long texts and words are read whole; empty table: no rows;
``keep`` columns pass through, a clashing name gets an underscore.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_score, crc_fold, cut_lineage, dual_coordinate_descent, labelled_sample, platt

P = 3
LAMBDA = 0.6
FLOOR = 0.4
LANDMARKS = 96
MAX_FIT = 4000                  # labelled documents in the fit, about
PIECE = 8                       # signs; longer words are compared in overlapping pieces
CACHE = 200_000                 # words whose weight a task remembers
TOP = 3                         # sentences that make a document's score
CUTOFF = 0.3
# digits and signs commonly written for letters
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_NOT_LETTER = re.compile(r"[^\w\n]|_")
_SPACED = re.compile(r"(?<!\S)(?:\w[\s.*_-]){2,}\w(?!\S)")


def normalise(words: list[str]) -> list[str]:
    """Letters of each word: digits for letters undone, signs dropped."""
    joined = "\n".join(words)
    for sign, letter in _LEET.items():
        joined = joined.replace(sign, letter)
    return _NOT_LETTER.sub("", joined).split("\n") if words else []


def _codes(words: list[str], width: int, pad: str) -> np.ndarray:
    """Code points of the words as rows of ``width``, filled up with ``pad``."""
    joined = "".join([w.ljust(width, pad) for w in words])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, p: int = P, lam: float = LAMBDA) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows of code points (padding of ``s``
    and ``t`` must differ): one value per row."""
    n, ls = s.shape
    lt = t.shape[1]
    same = (s[:, :, None] == t[:, None, :]).transpose(1, 2, 0) * (lam * lam)
    same = same.astype(np.float32)                          # (ls, lt, n)
    kp = np.ones((ls + 1, lt + 1, n), np.float32)
    for _ in range(p - 1):
        new = np.zeros((ls + 1, lt + 1, n), np.float32)
        for i in range(1, ls + 1):
            row = np.zeros(n, np.float32)
            for j in range(1, lt + 1):
                row = lam * row + same[i - 1, j - 1] * kp[i - 1, j - 1]
                new[i, j] = lam * new[i - 1, j] + row
        kp = new
    return (same * kp[:-1, :-1]).sum(axis=(0, 1)).astype(np.float64)


def _pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    out, own = [], []
    for i, w in enumerate(words):
        out.append("^" + w[:PIECE - 1])
        own.append(i)
        for k in range(PIECE // 2, len(w) - PIECE // 2 + 1, PIECE // 2):
            out.append(w[k:k + PIECE])
            own.append(i)
    return out, np.array(own, np.int64)


class Landmarks:
    """Kernel values of words against a fixed list of pieces."""

    def __init__(self, pieces: list[str]):
        self.words = pieces
        self.width = max((len(w) for w in self.words), default=1)
        self.codes = _codes(self.words, self.width, "\1")
        self.masks = self._masks(self.words)
        self.bounds = [self._bounds(w) for w in self.words]
        self.self_k = self._self(self.words)

    @staticmethod
    def _bounds(word: str) -> tuple[np.ndarray, np.ndarray]:
        """(letters as hashed bits, norm share of the subsequences whose letters
        are all present) with the present letters as bits of the index."""
        letters = sorted(set(word))
        own = _codes([word], len(word), "\1")
        n = 1 << len(letters)
        s = np.repeat(own, n, 0)
        t = s.copy()
        for i, c in enumerate(letters):                     # a missing letter matches nothing
            gone = (np.arange(n) >> i & 1) == 0
            t[gone[:, None] & (own == ord(c))] = 0
        k = subsequence_kernel(s, t)
        return (np.array([ord(c) % 64 for c in letters], np.uint64),
                np.sqrt(np.maximum(k, 0) / max(float(k[-1]), 1e-30)))

    def _possible(self, j: int, mask: np.ndarray) -> np.ndarray:
        """Whether words of these letter bits can reach FLOOR against landmark j."""
        bits, share = self.bounds[j]
        present = np.zeros(len(mask), np.int64)
        for i, b in enumerate(bits):
            present |= ((mask >> b) & np.uint64(1)).astype(np.int64) << i
        return share[present] >= FLOOR * (1 - 1e-6)

    @staticmethod
    def _masks(words) -> np.ndarray:
        joined = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        bits = np.where(joined == 10, np.uint64(0), np.uint64(1) << (joined % 64).astype(np.uint64))
        start = np.concatenate(([0], np.flatnonzero(joined == 10)))
        return np.bitwise_or.reduceat(bits, start) if len(bits) else np.zeros(len(words), np.uint64)

    @staticmethod
    def _self(words) -> np.ndarray:
        out = np.empty(len(words))
        lens = np.array([len(w) for w in words])
        for lo in range(0, PIECE + 1, 4):
            pick = np.flatnonzero((lens > lo - 4) & (lens <= lo))
            for k in range(0, len(pick), 2000):
                sel = pick[k:k + 2000]
                a = [words[i] for i in sel]
                out[sel] = subsequence_kernel(_codes(a, max(lo, 1), "\1"), _codes(a, max(lo, 1), "\2"))
        return out

    def gram(self) -> np.ndarray:
        """The landmarks' kernel, normalised and squared: positive definite."""
        m = len(self.words)
        i, j = np.divmod(np.arange(m * m), max(m, 1))
        s = _codes(self.words, self.width, "\2")
        k = np.concatenate([subsequence_kernel(s[i[a:a + 2000]], self.codes[j[a:a + 2000]])
                            for a in range(0, m * m, 2000)] or [np.zeros(0)])
        k = (k / np.sqrt(np.maximum(self.self_k[i] * self.self_k[j], 1e-30))).reshape(m, m)
        return ((k + k.T) / 2) ** 2

    def reachable(self, words: list[str]) -> np.ndarray:
        """Indexes of the words of which a piece can pass ``compare``: a word has
        all letters of its pieces, and its first piece is the longest."""
        mask = self._masks(words) | np.uint64(1 << ord("^") % 64)
        lens = np.minimum(np.array([len(w) for w in words], np.int64) + 1, PIECE)
        ok = np.zeros(len(words), bool)
        for j in range(len(self.words)):
            ok |= self._possible(j, mask)
        return np.flatnonzero(ok & (lens >= P))

    def values(self, words: list[str]):
        """Sparse (word index, landmark index, kernel) of normalised words."""
        near = self.reachable(words)
        pieces, own = _pieces([words[i] for i in near.tolist()])
        i, j, v = self.compare(pieces)
        return near[own[i]], j, v

    def compare(self, words: list[str]):
        """Sparse (piece index, landmark index, kernel) of pieces."""
        z = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not words or not self.words:
            return z
        mask = self._masks(words)
        lens = np.array([len(w) for w in words])
        wi, li = [], []
        for j in range(len(self.words)):
            k = np.flatnonzero(self._possible(j, mask) & (lens >= P))
            wi.append(k)
            li.append(np.full(len(k), j))
        wi, li = np.concatenate(wi), np.concatenate(li)
        val = np.zeros(len(wi))
        size = lens[wi]
        for lo in range(4, PIECE + 4, 4):
            pick = np.flatnonzero((size > lo - 4) & (size <= lo))
            for k in range(0, len(pick), 2000):
                sel = pick[k:k + 2000]
                val[sel] = subsequence_kernel(_codes([words[i] for i in wi[sel]], lo, "\2"), self.codes[li[sel]])
        # a word's own kernel is at least that of its unbroken subsequences
        least = np.maximum(size - P + 1, 1) * LAMBDA ** (2 * P)
        near = val >= FLOOR * np.sqrt(least * self.self_k[li])
        wi, li, val = wi[near], li[near], val[near]
        if not len(wi):
            return z
        uniq, inv = np.unique(wi, return_inverse=True)
        own_k = self._self([words[i] for i in uniq])[inv]
        val = val / np.sqrt(np.maximum(own_k * self.self_k[li], 1e-30))
        near = val >= FLOOR
        return wi[near], li[near], val[near] ** 2


def spaced_words(text: str) -> list[str]:
    """Words written as single letters set apart."""
    return [re.sub(r"[\W_]+", "", m) for m in _SPACED.findall(text)]


class WordWeights:
    """Weight of a word under a function of its (landmark, kernel value) pairs,
    remembered per distinct word; kernel values are remembered per piece."""

    def __init__(self, marks: Landmarks, weight):
        self.marks, self.weight, self.known, self.hits, self.pieces = marks, weight, {}, set(), {}

    def learn(self, words) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
            self.hits.clear()
        if len(self.pieces) > 2 * CACHE:
            self.pieces.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(dict.fromkeys(new))
        plain = normalise(new)
        near = self.marks.reachable(plain).tolist()
        pieces, own = _pieces([plain[i] for i in near])
        unseen = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        self.pieces.update(dict.fromkeys(unseen, ()))
        for i, j, v in zip(*(x.tolist() for x in self.marks.compare(unseen))):
            self.pieces[unseen[i]] += ((j, v),)
        got: dict[int, tuple] = {}
        for p, i in zip(pieces, own.tolist()):
            if self.pieces[p]:
                got[near[i]] = got.get(near[i], ()) + self.pieces[p]
        for i, jv in got.items():
            x = self.weight(jv)
            if x is not None:
                self.known[new[i]] = x
                self.hits.add(new[i])


def sentences(words: list[str], spaced: list[str], ww: WordWeights) -> list[list]:
    """Weights of the words with one, per sentence that has any; words written
    as single letters are sentences of their own."""
    out, last = [], None
    for i in [i for i, w in enumerate(words) if w in ww.hits]:
        if last is None or any(w[-1] in ".!?" for w in words[last:i]):
            out.append([])
        out[-1].append(ww.known[words[i]])
        last = i
    return out + [[ww.known[w]] for w in spaced if w in ww.hits]


def top_sum(scores) -> float:
    """Sum of the TOP largest positive sentence scores."""
    return float(sum(sorted((x for x in scores if x > 0), reverse=True)[:TOP]))


def _vocabulary(words, spaced) -> set:
    return set().union(*words, *spaced)


def landmark_words(sample: DataFrame, n: int = LANDMARKS) -> list[str]:
    """The n word beginnings that best tell toxic texts of the sample apart.

    A word counts once per word it follows, not per text: the words of one text
    that is copied many times are no evidence, an insult strewn over texts is.
    """
    ws = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    pairs = F.transform("ws", lambda w, i: F.struct(
        w.alias("w"), F.xxhash64(F.when(i > 0, F.get("ws", i - 1)).otherwise("")).alias("before")))
    d = sample.select("y", "doc_id", ws.alias("ws")).select("y", "doc_id", F.explode(pairs).alias("x"))
    n_letters = F.array(*[F.lit(k) for k in range(3, PIECE)])
    d = d.where(F.length("x.w") >= 4).select("y", "doc_id", "x.w", "x.before", F.explode(n_letters).alias("k"))
    # a context belongs to its first document: copies add no evidence
    d = (d.where("k <= length(w)").groupBy("y", F.expr("substring(w, 1, k)").alias("w"), "before")
         .agg(F.min("doc_id").alias("owner")))
    c = cut_lineage(d.groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"),
                                       F.count_distinct(F.when(F.col("y") > 0, F.col("owner"))).alias("docs")),
                    "toxic-words")
    t = c.agg(F.sum("p"), F.sum("q")).first()
    if not t[0] or not t[1]:
        return []
    lift = F.log((F.col("p") + 0.5) / (t[0] + 1.0)) - F.log((F.col("q") + 0.5) / (t[1] + 1.0))
    # clearly more frequent in toxic texts: ten times the rate at least
    top = (c.withColumn("lift", lift).where("p >= 3 and docs >= 3 and lift >= ln(10.0)")
           .orderBy((F.col("p") * F.col("lift")).desc(), "w").limit(6 * n))
    kept: dict[str, int] = {}
    for r in top.collect():
        # a beginning that says the same as a kept longer or shorter one is left out
        same = (k for k, p in kept.items() if (r.w.startswith(k) or k.startswith(r.w)) and 0.7 * p <= r.p <= p / 0.7)
        if len(kept) < n and next(same, None) is None:
            kept[r.w] = r.p
    return ["^" + w for w in dict.fromkeys(normalise(list(kept)))]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_fit: int = MAX_FIT,
        n_landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", c: float = 1.0) -> dict:
    """{words, v, bias, a, b}: landmarks, their weights, and the calibration."""
    import pyarrow as pa
    sample = labelled_sample(docs, labels, label_col, max_fit, id_col, text_col)
    sample = cut_lineage(sample.select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"))
                         .repartition(24, "doc_id"), "toxic-sample")
    words = [w for w in landmark_words(sample, n_landmarks) if len(w) >= P]
    t = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    share = (t[0] or 0) / t[1] if t[1] else 0.0
    flat = {"words": [], "v": np.zeros(0), "bias": 0.0, "a": 0.0,
            "b": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))}
    if not words:
        return flat

    def run(batches):
        ww = WordWeights(Landmarks(words), lambda jv: jv)
        for batch in batches:
            texts = [(x or "").lower() for x in batch.column("text").to_pylist()]
            spaced = [spaced_words(t_) for t_ in texts]
            split = [t_.split() for t_ in texts]
            ww.learn(_vocabulary(split, spaced))
            rows = []
            for t_, sp in zip(split, spaced):
                ss = []
                for s in sentences(t_, sp, ww):
                    v: dict[int, float] = {}
                    for jv in s:
                        for j, x in jv:
                            v[j] = v.get(j, 0.0) + x
                    ss.append([{"j": j, "x": x} for j, x in sorted(v.items())])
                rows.append(ss)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("y"),
                 pa.array(rows, pa.list_(pa.list_(pa.struct([("j", pa.int32()), ("x", pa.float64())]))))],
                names=["doc_id", "y", "s"])
    got = sample.select("doc_id", "y", "text").mapInArrow(
        run, "doc_id long, y int, s array<array<struct<j:int,x:double>>>").collect()
    got.sort(key=lambda r: r.doc_id)
    return train([[{e.j: e.x for e in s} for s in r.s] for r in got], np.array([r.y for r in got]), words, c)


def train(bags, y: np.ndarray, words: list[str], c: float = 1.0) -> dict:
    """Model from the sentences ({landmark: value}) of each labelled document."""
    m = len(words)
    marks = Landmarks(words)
    val, vec = np.linalg.eigh(marks.gram())
    root = (vec / np.sqrt(np.maximum(val, 1e-3))) @ vec.T         # K ** -1/2
    dense = [np.array([[s.get(j, 0.0) for j in range(m)] for s in bag]).reshape(-1, m) @ root for bag in bags]
    all_idx = np.arange(m)
    clean = [x for bag, s in zip(dense, y) if not s for x in bag] + [np.zeros(m)]
    toxic = [bag for bag, s in zip(dense, y) if s and len(bag)]
    w = None
    for _ in range(2):
        picked = [bag[np.argmax(bag @ w[:m] if w is not None else (bag * bag).sum(1))] for bag in toxic]
        if not picked:
            break
        rows = [(all_idx, x) for x in clean + picked]
        w = dual_coordinate_descent(rows, np.array([-1] * len(clean) + [1] * len(picked)), m, c)
    if w is None:
        w = np.zeros(m + 1)
    f = np.array([top_sum(bag @ w[:m]) + w[m] for bag in dense])
    sign = np.where(y > 0, 1, -1)
    a, b = platt(f, sign)
    if a <= 0:                          # a few clean texts far out must not turn the order round
        a, b = platt(np.clip(f, *np.quantile(f, [0.05, 0.95])), sign)
        a = max(a, 1e-6)
    return {"words": words, "v": root @ w[:m], "bias": float(w[m]), "a": a, "b": b}


def scorer(model: dict):
    """Function from an Arrow string array to scores."""
    v = model["v"].tolist()

    def weight(jv):
        x = sum(v[j] * k for j, k in jv)
        return x if x else None                             # 0 changes nothing
    ww = WordWeights(Landmarks(model["words"]), weight)

    def score(texts) -> np.ndarray:
        texts = [(t or "").lower() for t in texts.to_pylist()]
        best = np.zeros(len(texts))
        if model["words"]:
            spaced = [spaced_words(t) for t in texts]
            words = [t.split() for t in texts]
            ww.learn(_vocabulary(words, spaced))
            for i, (t, sp) in enumerate(zip(words, spaced)):
                best[i] = top_sum([sum(s) for s in sentences(t, sp, ww)])
        return 1 / (1 + np.exp(-np.clip(model["a"] * (best + model["bias"]) + model["b"], -40, 40)))
    return score


def score_documents(docs: DataFrame, labels: DataFrame, keep=("doc_id",), text_col: str = "text",
                    label_col: str = "toxic", max_fit: int = MAX_FIT) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: toxic likelier)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, max_fit, text_col=text_col))
    return add_score(docs, text_col, keep, lambda: scorer(model.value))


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    d = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", F.coalesce(crc_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
