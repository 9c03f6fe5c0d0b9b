"""Operators 11 to 13 against brute force on small tables."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest

from riskfold.llm import filter_audit, phrases, sharding
from riskfold.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, size long, part string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------ op 11
def shard_docs():
    out = []
    for i in range(900):
        text = "same text" if i % 3 == 0 else (None if i % 97 == 0 else ("" if i % 53 == 0 else f"text é {i % 400}"))
        out.append((None if i == 7 else i, text, "en", None if i % 11 == 0 else f"s{i % 5}", i, "x"))
    return out + [(12, "same text", "en", "s2", 0, "x")] * 4 + [(5000 + i, "lonely", "en", f"one{i}", 0, "x")
                                                               for i in range(60)]


def test_shards_follow_the_mixture(spark):
    data = shard_docs()
    got = rows(sharding.assign_shards(spark.createDataFrame(data, DOCS), keep=["size", "part"]))
    assert len(got) == len(data)
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by = Counter((r["source"], r["shard"]) for r in got)
    for source, n in Counter(r["source"] for r in got).items():
        for s in range(8):
            assert abs(by[(source, s)] - n / 8) <= 2
    want = Counter((i, s, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), kept)
                   for i, t, _, s, kept, _ in data)
    assert want == Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"], r["size_"]) for r in got)
    # the order itself, by plain sorting
    md5 = lambda x: hashlib.md5(x).hexdigest()
    groups = defaultdict(list)
    for i, t, _, s, _, _ in data:
        th = md5(b"0shard") if t is None else md5(b"1shard" + t.encode())
        groups[s].append((th, md5(f"{'' if i is None else i}:shard".encode()), i))
    line = []
    for s, members in groups.items():
        members.sort(key=lambda x: x[:2])
        name = "" if s is None else f"={s}"
        u = (int(md5(f"{name}/shard".encode())[:12], 16) + 0.5) / 16 ** 12
        line += [((k + u) / len(members), name, *m) for k, m in enumerate(members)]
    line.sort(key=lambda x: x[:4])
    seen = {(r["position"], r["doc_id"]) for r in got}
    assert seen == {(k, m[4]) for k, m in enumerate(line)}


def test_shards_do_not_depend_on_the_split_of_work(spark):
    d = spark.createDataFrame(shard_docs(), DOCS)
    cols = ["doc_id", "source", "text_crc32", "fraction", "position", "shard", "slot"]
    key = lambda f: sorted(map(str, f.select(cols).collect()))
    one = key(sharding.assign_shards(d))
    assert key(sharding.assign_shards(d.repartition(5), rows_per_bucket=7)) == one
    assert key(sharding.assign_shards(d.repartition(3, "text"), rows_per_bucket=60, max_cuts=9)) == one
    assert sharding.assign_shards(d.limit(0)).count() == 0


def test_shards_are_written_in_slot_order(spark, tmp_path):
    d = spark.createDataFrame(shard_docs(), DOCS)
    got = sharding.assign_shards(d, keep=["text"])
    sharding.write_shards(got, str(tmp_path / "out"))
    for s in range(8):
        back = spark.read.parquet(str(tmp_path / "out" / f"shard={s}")).toPandas()
        for _, part in back.groupby("part"):
            assert list(part["slot"]) == sorted(part["slot"])
        ends = back.groupby("part")["slot"].agg(["min", "max"]).sort_index()
        assert (ends["min"].to_numpy()[1:] > ends["max"].to_numpy()[:-1]).all()
    assert spark.read.parquet(str(tmp_path / "out")).count() == d.count()


# ------------------------------------------------------------------ op 12
def audit_docs():
    long = " ".join(f"w{i}" for i in range(210))
    flat = " ".join("same words here".split() * 70)
    texts = [long, flat, long + " $", "SHOUT " * 210, "short", "", None, long + " é", flat + " #", long.upper()]
    out = []
    for i in range(260):
        out.append((i, texts[(i * 7) % 10], "en", [None, "", "a", "b"][i % 4] if i % 3 else "a", i, "x"))
    return out + [(None, long, "en", "a", 0, "x"), (3, texts[1], "en", "b", 0, "x"), (3, texts[1], "en", "b", 0, "x"),
                  (4, "short", "en", "b", 0, "x"), (4, long, "en", "b", 0, "x")]


def brute_audit(data, labels):
    first = {}
    for i, t, *_ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = defaultdict(list)
    for i, t, _, source, *_ in data:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and first[t] < i)) if x}
        good = any(q == 1 for j, q, _ in labels if j == i and i is not None)
        toxic = any(x == 1 for j, _, x in labels if j == i and i is not None)
        docs[source or ""].append((fails, good, toxic))
    out = {}
    for part, members in docs.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                earlier = [m for m in members if f in m[0] and m[0] & set(order[:step - 1])]
                left = [m for m in left if f not in m[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(earlier), sum(m[0] == {f} for m in members),
                    sum(m[1] for m in gone), sum(m[2] for m in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return out


def test_audit_equals_brute_force(spark):
    data = audit_docs()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 260, 3)] + [(6, 1, 1), (9, None, None), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(data, DOCS).repartition(5)
    want = brute_audit(data, labels)
    for per_task in (filter_audit.ROWS_PER_TASK, 9):
        got = rows(filter_audit.audit(filter_audit.failures(d, lab), rows_per_task=per_task))
        assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
            "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want
    assert filter_audit.audit(filter_audit.failures(d.limit(0), lab.limit(0))).count() == 0


def test_union_sizes_by_galloping():
    import numpy as np
    rng = np.random.default_rng(3)
    lists = [np.flatnonzero(rng.random(500) < p) for p in (0.5, 0.01, 0.2, 0.0)]
    w = rng.integers(1, 5, (500, 3))
    got = filter_audit.union_sizes(lists, w)
    for s in range(16):
        u = sorted(set().union(*[set(lists[f].tolist()) for f in range(4) if s >> f & 1]))
        assert (got[s] == w[u].sum(0)).all()


# ------------------------------------------------------------------ op 13
def phrase_docs():
    import random
    rng = random.Random(5)
    words = ["New", "york", "city", "big", "é", "of", "the", "Ünder", "a-b", "x"]
    out = []
    for i in range(300):
        n = rng.randrange(0, 40)
        toks = []
        while len(toks) < n:
            toks += ["new", "york", "city"] if rng.random() < 0.2 else [rng.choice(words)]
        text = "".join(t + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n"]) for t in toks)
        out.append((i % 250, text if i % 41 else None, rng.choice(["en", "de", None, "und"]), "s", 0, "p"))
    return out + [(1, "", "en", "s", 0, "p"), (2, "...!!", "fr", "s", 0, "p"), (None, "new york " * 400, "en", "s", 0, "p")]


def brute_phrases(data, support, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in data:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    dropped = set()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                sub = (lang, w[i:i + k])
                if 100 * a >= 80 * f[sub]:
                    dropped.add(sub)
    out = defaultdict(list)
    for (lang, w), a in cands.items():
        if (lang, w) not in dropped:
            score, _, lf, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                  for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), lf, r))
    return {(lang, k): (p.decode(), -a, lf, r, n[lang], -s) for lang, members in out.items()
            for k, (s, a, p, lf, r) in enumerate(sorted(members)[:top], 1)}


@pytest.mark.parametrize("how", [dict(support=5), dict(support=4, shards=3, slot_bits=16), dict(support=6, shards=2, slot_bits=4),
                                 dict(support=3, shards=7, slot_bits=8)])
def test_collocations_equal_brute_force(spark, how):
    data = phrase_docs()
    d = spark.createDataFrame(data, DOCS).repartition(6)
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
           for r in rows(phrases.top_collocations(d, top=25, **how))}
    assert got == brute_phrases(data, how["support"], 25)


def test_collocations_of_words_whose_numbers_agree(spark):
    import numpy as np
    import pyarrow as pa
    h, _, _, row, new = phrases.piece_words(b"w113413 w68406", np.array([0, 14]))
    numbers = phrases.word_numbers(h, row, new, phrases._lang_salts(pa.array(["en"])))
    assert numbers[0] >> 1 == numbers[1] >> 1
    data = [(i, t, "en", "s", 0, "p") for i, t in enumerate(["old w113413 x w68406 bar"] * 9 + ["old w68406 bar"] * 7)]
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
           for r in rows(phrases.top_collocations(spark.createDataFrame(data, DOCS).coalesce(1), support=5))}
    assert got == brute_phrases(data, 5, 2000)


def test_collocations_of_nothing(spark):
    d = spark.createDataFrame([(1, None, "en", "s", 0, "p"), (2, " , ", None, "s", 0, "p")], DOCS)
    assert phrases.top_collocations(d).count() == 0
    assert phrases.top_collocations(d.limit(0)).count() == 0


def test_words_of_a_long_text_are_cut_like_those_of_short_ones():
    import numpy as np
    text = ("ab  cd,ef\tgh. " * 90000).encode()
    short = "ab  cd,ef\tgh. ".encode()
    h, a, b, row, new = phrases.piece_words(text + short, np.array([0, len(text), len(text) + len(short)]))
    assert len(h) == 4 * 90001 and set(np.unique(h[:4])) == set(np.unique(h))
    assert (h.reshape(-1, 4) == h[:4]).all() and (new.reshape(-1, 4) == [True, False, True, False]).all()
    assert row.tolist() == [0] * 360000 + [1] * 4
    assert pd.Series([text[x:y] for x, y in zip(a[:8], b[:8])]).tolist() == [b"ab", b"cd", b"ef", b"gh"] * 2


def test_pii_examples_come_from_all_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from riskfold.llm import pii

    class Enough(Exception):
        pass

    def seen(docs, text_col="t"):
        assert docs.count() == 30_000
        raise Enough
    monkeypatch.setattr(pii, "examples", seen)
    d = spark.range(30_000).select(F.concat(F.lit("tel "), F.col("id").cast("string")).alias("text"))
    with pytest.raises(Enough):
        pii.fit(d, "text")
