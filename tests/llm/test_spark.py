"""The training-data operators on small tables: edge rows, brute force, SQL."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskfold.llm import (bottomk, chat, decontam, html_text, mixing, parity_join, pii, quality, toxicity, warc)
from riskfold.llm.common import components, cut_lineage, platt
from riskfold.llm.queries import ORACLE, QUERIES
from riskfold.sources.files import scratch_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, spans string, score int"


def _docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None, "x", "y", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def _edge(spark):
    long = "word " * 20000
    return _docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n "), (None, "a b c d e f"),
                         (5, long), (6, "x"), (-7, "call +1 (017) 555-7713 now")])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name]).fetchall()
    cols = [d[0] for d in con.description] if con.description else con.sql(ORACLE[name]).columns
    got = QUERIES[name](spark, SF).select(*con.sql(ORACLE[name]).columns).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert cols is not None and sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "A b c"), (1, "c d e"), (2, None), (3, ""), (None, "word word")],
                                  "item_id long, text string")
    got = decontam.find_contamination(_edge(spark), bench, keep=["doc_id", "n_hit", "spans"])
    assert got.columns == ["doc_id", "n_hit", "spans", "n_words", "n_hit_", "items", "spans_", "contaminated"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 9
    assert rows[1]["n_hit_"] == 5 and rows[1]["items"] == [1] and rows[1].contaminated
    assert rows[2].n_words == 0 and not rows[2].contaminated and rows[4].n_words == 0
    assert rows[5]["n_hit_"] == 20000 and rows[5]["items"] == []      # null item_id names no item
    empty = decontam.find_contamination(_edge(spark).limit(0), bench)
    assert empty.count() == 0
    assert decontam.find_contamination(_edge(spark), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontam.find_contamination(docs, bench).orderBy("doc_id").collect()
    parts = decontam.find_contamination(docs, bench, max_bench_bytes=2000).orderBy("doc_id").collect()
    assert one == parts and any(r.contaminated for r in one)


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "<turn>a\\b\\l</turn>\n<part>"), (1, 3, "assistant", None),
            (1, 3, "assistant", "z<par"), (None, 0, None, "x"), (2, None, "as\n\\sistant", "\\"),
            (2, 1, "assistant", "</turn>" * 300)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(d.withColumn("formatted", F.lit(1)))
    got = {r.conv_id: r for r in out.withColumn("t", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("t"), F.col("loss_mask"))).collect()}
    assert [tuple(x) for x in got[1].t] == [("user", rows[1][3]), ("assistant", "b"), ("assistant", ""),
                                            ("assistant", "z<par")]
    assert got[1].n_merged == 2 and got[1].loss == "bz<par" and got[1].formatted.count("<turn>") == 2
    assert [tuple(x) for x in got[2].t] == [("as\n\\sistant", "\\"), ("assistant", "</turn>" * 300)]
    assert [tuple(x) for x in got[None].t] == [("", "x")]
    assert chat.format_chats(d.limit(0)).count() == 0


def _union_find(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("hot", [64, 3])
def test_jaccard_join_equals_brute_force(spark, hot):
    rnd = random.Random(9)
    voc = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(voc) for _ in range(40)]
    texts = {}
    for base in range(25):
        n = rnd.choice([3, 6, 9, 14, 30, 80, 200])
        t = [rnd.choice(voc) for _ in range(n)]
        if base % 3 == 0:
            t[n // 2:n // 2] = passage
        for _ in range(rnd.choice([1, 1, 4, 12])):
            c = list(t)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                c[rnd.randrange(len(c))] = rnd.choice(voc)
            texts[len(texts)] = " ".join(c)
    texts[len(texts)] = None
    texts[len(texts)] = " \t"
    d = _docs(spark, list(texts.items())).repartition(3)
    got = {r.doc_id: r for r in parity_join.linked_documents(d, hot=hot).collect()}
    sets = {i: _shingles(t) for i, t in texts.items()}
    want = _union_find(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    kept = {r.doc_id for r in parity_join.one_of_each(d, hot=hot).collect()}
    assert kept == set(want.values())


def test_jaccard_join_edges(spark):
    got = parity_join.linked_documents(_edge(spark)).collect()
    assert len(got) == 9
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(2, 1)] * 2 and by[None] == [(2, 1)] and by[2] == [(0, 2)] and by[5][0][0] == 1
    assert sorted((r.doc_id for r in parity_join.one_of_each(_edge(spark)).collect()),
                  key=lambda x: (x is None, x)) == [-7, 1, 2, 3, 4, 5, 6]
    assert parity_join.linked_documents(_edge(spark).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    rnd = random.Random(4)
    name = rnd.sample(range(10 ** 6), 60)
    e = [(name[i], name[i + 1]) for i in range(39)] + [(name[50], name[51]), (name[51], name[50]), (name[52], name[52])]
    got = components(spark.createDataFrame(e, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 40]


def _base(text):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
            return 12 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    got = [(m.start(), n, k, m.end()) for n, k in enumerate(rx) for m in re.finditer(rx[k], text or "") if ok(k, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(got)]


def test_pii_base_spans_equal_plain_search(spark):
    rnd = random.Random(6)
    bits = ["a@b.c", "x.y@z-1.co.uk", "@", ".", "1.2.3.4", "255.255.255.256", "001.2.3.4.5.6.7.8", " ", "-", "é",
            "4111 1111 1111 1111", "4111111111111112", "0810992847249404", "+1 (017) 555-7713", "+", "(", "12", "a",
            "😀", "_", "a@b", "\n", "+49 30 1234567", "1-2-3-4-5-6-7-8-9-0-1-2-3-4"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "7" * 30000, "a" * 30000 + "@", "1 " * 20000, "a@b.cc " * 700]
    d = _docs(spark, list(enumerate(texts)))
    got = {r.doc_id: [tuple(s)[:3] for s in r["s"] if s.base] for r in d.select(
        "doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _base(t), (i, t[:200])


def test_pii_full_and_redaction(spark):
    mixed = [(i, f"mail me{i}@x.org, call +1 (017) 555-77{i:02d}, id 4111 1111 1111 1111, no 12-{i}") for i in range(40)]
    d = _docs(spark, mixed).union(_edge(spark))
    r = pii.find_pii(d, keep=["doc_id", "spans", "text"])
    assert r.columns[-1] == "spans_" and r.count() == 49
    rows = {x.doc_id: x for x in r.withColumn("clean", pii.redact(F.col("text"), F.col("spans_"))).collect()}
    for i, t in mixed:
        if i in rows and rows[i].text == t:
            assert [tuple(s)[:3] for s in rows[i]["spans_"] if s.base] == _base(t)
    assert rows[20].clean.startswith("mail [EMAIL], call [PHONE], id [CARD]")
    assert rows[3].clean in ("", None) or "[" in rows[3].clean
    assert pii.find_pii(d.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = [(i, " ".join(f"v{(i * 7 + k) % 90}" for k in range(20 + 5 * i))) for i in range(40)]
    d = _docs(spark, texts).union(_edge(spark))
    got = bottomk.neighbours(d, rows_per_range=5, derived={"fp": bottomk.sketch}).collect()
    rows = sorted(((r[0], r[1] or "") for r in d.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    nxt = sorted((rows[i] + (rows[(i + 1) % len(rows)][1],) for i in range(len(rows))), key=str)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=str) == nxt
    assert all(len(r.fp) == len(_shingles(r.text)) for r in got if len(_shingles(r.text)) < bottomk.K)
    assert bottomk.neighbours(d.limit(0)).count() == 0
    one = bottomk.neighbours(_docs(spark, [(1, "a")])).first()
    assert one.next_text == "a"
    pair = spark.createDataFrame([("a b c d e f g h", "c d e f g h i j"), ("", ""), ("", "x")], "a string, b string")
    a, b = bottomk.sketch(F.col("a")), bottomk.sketch(F.col("b"))
    r = pair.select(bottomk.resemblance(a, b).alias("r"), bottomk.containment(a, b).alias("c"),
                    bottomk.distinct_count(a).alias("n"), bottomk.merge(a, b).alias("m")).collect()
    assert [x.r for x in r] == [2 / 6, 1.0, 0.0] and r[0].c == 0.5 and r[0].n == 4.0 and len(r[0].m) == 6
    big = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda x: x.cast("string")), " ").alias("t"))
    n = big.select(bottomk.distinct_count(bottomk.sketch(F.col("t"))).alias("n")).first().n
    assert abs(n / 29996 - 1) < 0.35
    parts = spark.createDataFrame([("k", [1, 5, 9]), ("k", [2, 5]), ("l", [3])], "k string, s array<bigint>")
    assert {x.k: x["s"] for x in bottomk.merge_parts(parts, "k", "s", 3).collect()} == {"k": [1, 2, 5], "l": [3]}


def test_page_queries(spark):
    page = '<body><div class="ad">x</div><article><p>main {}</p></article></body>'
    rows = [(i, f"https://H{i % 2}.org/{i}", page.format(i)) for i in range(6)] + [(7, None, None), (8, "odd", "plain")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.main_text(d).collect()}
    assert got[3].text == "main 3" and got[3].path == ">body>article" and got[7].text == "" and got[8].text == "plain"
    assert html_text.main_text(d.limit(0)).count() == 0


def test_warc_chain_rejects_magic_in_payloads(spark):
    inner = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    rows = []
    for i in range(120):
        h = "é" * (i * 7 % 200)
        if i % 5 == 0:
            h += inner * (i % 4) + "WARC/1.1\r\njunk"
        if i % 11 == 0:
            h = inner + h + "WARC/1.1\r\n"
        rows.append((i, f"http://a\n/{i}" if i % 3 else None, None if i % 17 == 0 else h))
    rows += [(500, "u", "z" * 99), (501, "u", "z" * 99), (502, "u", "z" * 100), (503, "u", "z" * 100), (None, "u", "z" * 100)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    path = warc.write_warc(d.repartition(2), scratch_path(spark, "warc-test"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "333"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = warc.read_warc(spark, path).collect()
            assert len(got) == len(rows) and all(r.digest_ok for r in got)
            by = {r.page_id: r for r in got}
            for i, _, h in rows:
                b = (h or "").encode()
                assert by[i].payload_bytes == len(b) and by[i].payload_digest == hashlib.sha256(b).hexdigest()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    kinds = {r.page_id: (r.type, r.refers_to) for r in got}
    assert kinds[501] == ("response", None) and kinds[502] == ("response", None)
    assert kinds[503] == ("revisit", 502) and kinds[None] == ("revisit", 502)
    assert warc.read_warc(spark, warc.write_warc(d.limit(0), scratch_path(spark, "warc-none"))).count() == 0


def _pii_corpus(rnd):
    """Texts with base spans among plain numbers, and some without any."""
    words = lambda n: " ".join(rnd.choice(["the", "report", "of", "and", "was", "sold", "year", "met"]) for _ in range(n))

    def digits(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        total = sum(2 * int(x) - 9 * (int(x) > 4) if i % 2 == 0 else int(x) for i, x in enumerate(reversed(d)))
        d += str(-total % 10)
        return " ".join(d[i:i + 4] for i in range(0, 16, 4))
    facts = [lambda: f"u{digits(3)}.{rnd.choice('abc')}@mail{digits(1)}.org", card,
             lambda: f"{rnd.randint(1, 250)}.{rnd.randint(1, 250)}.{rnd.randint(1, 250)}.{rnd.randint(1, 250)}",
             lambda: f"+49 {digits(3)} {digits(3)} {digits(2)} {digits(2)}"]
    plain = [lambda: digits(7), lambda: f"{rnd.randint(1, 28)}-{rnd.randint(1, 12)}-2020", lambda: f"1.{digits(1)}.{digits(1)}",
             lambda: f"{digits(2)},{digits(3)},{digits(3)}", lambda: f"{digits(4)} {digits(4)}", lambda: digits(12),
             lambda: "2019 2020 2021", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}"]
    return [" ".join([words(5), rnd.choice(facts)() if i % 2 else "", words(4), rnd.choice(plain)(), words(3),
                      rnd.choice(plain)() + ",", words(2)]) for i in range(1200)]


def test_pii_finds_forms_that_the_patterns_miss(spark):
    rnd = random.Random(3)
    found = {9001: "please tel 0171 555 77 13 today", 9002: "mail: jo.doe [at] mail1 [dot] org please", 9003: "her card 4111.1111.1111.1111 is",
             9004: "the host 10-20-30-41 is down", 9005: "write to ann(at)mail2(dot)net soon", 9006: "call (491) 712-3456 now"}
    clean = {9101: "in 2021 about 1234567 people met on 12-11-2020", 9102: "version 1.2.3 of year 2019 sold 12,345,678",
             9103: "the report of 2019 2020 2021 was sold", 9104: "nothing to see here"}
    d = _docs(spark, [*enumerate(_pii_corpus(rnd)), *found.items(), *clean.items()])
    got = {r.doc_id: r for r in pii.find_pii(d, keep=["doc_id", "text"]).withColumn(
        "clean", pii.redact(F.col("text"), F.col("spans"))).where("doc_id > 9000").collect()}
    hits = [i for i in found if any(not s.base for s in got[i].spans)]
    assert len(hits) >= 4, {i: got[i].spans for i in found}
    assert all("[" in got[i].clean.replace("[at]", "").replace("[dot]", "") for i in hits)
    for i, t in clean.items():
        assert not got[i].spans and got[i].clean == t, (t, got[i].spans)
    # planted forms of the corpus itself: precision and recall of the chosen threshold
    ex = pii.examples(d.where("doc_id < 9000").select(F.col("text").alias("t")))
    score, cuts = pii.fit(d.where("doc_id < 9000"), "text")
    bar = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))])
    r = ex.select("label", (score(F.col("x")) >= F.coalesce(F.try_element_at(bar, F.col("kind")), F.lit(2.0))).alias("pick")
                  ).groupBy("label", "pick").count().collect()
    n = {(int(x.label), x.pick): x["count"] for x in r}
    assert n.get((1, True), 0) / (n.get((1, True), 0) + n.get((0, True), 0)) >= 0.97
    assert n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)) >= 0.6


def test_redact_merges_overlaps_by_running_maxima(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        t = "".join(rnd.choice("abcdef\U0001F600") for _ in range(rnd.randint(1, 1500 if i % 9 == 0 else 60)))
        spans = sorted({(rnd.randrange(len(t)), rnd.randrange(4), rnd.randint(1, 9)) for _ in range(rnd.randint(0, 300 if i % 9 == 0 else 8))})
        rows.append((i, t, [(pii.KINDS[k], s, min(len(t), s + n), True) for s, k, n in spans]))
    d = spark.createDataFrame(rows, f"i int, t string, s array<{pii.SPAN}>")
    got = {r.i: r.r for r in d.select("i", pii.redact(F.col("t"), F.col("s")).alias("r")).collect()}
    for i, t, spans in rows:
        merged = []
        for k, s, e, _ in spans:
            if merged and merged[-1][2] > s:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([k, s, e])
        want, at = "", 0
        for k, s, e in merged:
            want, at = want + t[at:s] + f"[{k.upper()}]", e
        assert got[i] == want + t[at:], i


def _mix_brute(docs, weights=(5, 2, 1), seed="mix"):
    size = {}
    for i, s, n in docs:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(size.values()), {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= 3 * size[s]}
        if not over:
            target.update({s: w[s] * level for s in open_})
            break
        target.update({s: 3.0 * size[s] for s in over})
        open_ -= over
    served = []
    for s in order:
        q = sorted(((hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest(), n, i) for i, t, n in docs if t == s),
                   key=lambda x: (x[0], x[1]))
        at = 0
        for e in range(3):
            for _, n, i in q:
                if n and at < target[s]:
                    served.append(((at + n) / target[s], order.index(s), n, i, at + n <= target[s]))
                at += n
    taken, used = {}, 0
    for f, s, n, i, early in sorted(served):
        used += n
        if early or used - n / 2 <= sum(target.values()) + 1e-6:
            taken[(i, order[s])] = taken.get((i, order[s]), 0) + n
    return target, taken


def test_mixing_equals_brute_force(spark):
    rnd = random.Random(8)
    docs = [(i, rnd.choice(["a", "b", "é", None, "z"]) if i > 3 else "tiny", rnd.randint(0, 30)) for i in range(200)]
    d = _docs(spark, [(i, " ".join(["w"] * n) or None) for i, s, n in docs], {i: s for i, s, n in docs})
    target, taken = _mix_brute(docs)
    for per in (2000, 10):                  # bucket sizes change nothing
        got = {r.doc_id: r for r in mixing.mix(d, rows_per_bucket=per).collect()}
        assert len(got) == 200
        for i, s, n in docs:
            assert got[i].size == n and abs(got[i].target - target[s]) < 1e-6 and got[i].taken == taken.get((i, s), 0)
            assert got[i].taken <= 3 * n
    assert mixing.mix(_edge(spark)).count() == 9 and mixing.mix(d.limit(0)).count() == 0


def test_mixing_comes_near_the_targets(spark):
    d = _docs(spark, [(0, "w " * 400)] + [(i, "w " * 10) for i in range(1, 60)], {0: "big"})
    got = mixing.mix(d).collect()
    assert {r.taken for r in got if r.source == "big"} == {800}     # target 707: two passes are nearer than one
    same = _docs(spark, [(1, "a b c d e f g h i j")] * 3 + [(2, "a " * 20)], {2: "other"})
    assert sorted(r.repeats for r in mixing.mix(same, weights=(1, 9)).where("doc_id = 1").collect()) == [1, 2, 2]


def test_classifiers_on_small_tables(spark):
    lab = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for op, col in ((quality, "quality"), (toxicity, "toxic")):
        for labels in (lab, lab.limit(0)):
            got = op.score_documents(_edge(spark), labels, keep=["doc_id", "score"], label_col=col)
            assert got.columns == ["doc_id", "score", "score_"] and got.count() == 9
            assert got.where("score_ is null or score_ < 0 or score_ > 1").count() == 0
        assert op.score_documents(_edge(spark).limit(0), lab).count() == 0


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(y)[order]
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = np.flatnonzero(s == v)
        rank[at] = at.mean() + 1
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("name,label,least", [("op5_quality_nbsvm", "quality", (0.9, 0.9, 0.95)),
                                              ("op3_toxicity_ssk", "toxic", (0.6, 0.6, 0.85))])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = (QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
           .select("score", "predicted", F.col(label).alias("y")).toPandas())
    hit = ((got["predicted"] == 1) & (got["y"] == 1)).sum()
    recall, precision = hit / (got["y"] == 1).sum(), hit / max(1, (got["predicted"] == 1).sum())
    larger = max(got["y"].mean(), 1 - got["y"].mean())
    assert (got["predicted"] == got["y"]).mean() > larger
    assert recall >= least[0] and precision >= least[1] and _auc(got["score"], got["y"]) >= least[2]


def test_calibration_keeps_the_order_of_spread_margins():
    f = np.array([-1.3] * 200 + [0.1] * 2400 + [5.0] * 100 + [1.0] * 30 + [3.0] * 150 + [5.5] * 130 + [50.0] * 20)
    y = np.array([-1] * 2700 + [1] * 330)
    a, b = platt(f, y)
    p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
    assert len(np.unique(p)) == len(np.unique(f)) and _auc(p, (y + 1) // 2) == _auc(f, (y + 1) // 2)
    assert abs(p.mean() - (y > 0).mean()) < 0.01


def test_toxicity_order_with_clean_outliers():
    bags = [[{0: 1.0}]] * 100 + [[]] * 90 + [[{0: 60.0}]] * 10
    model = toxicity.train(bags, np.array([1] * 100 + [0] * 100), ["^idiot"])
    none, one = toxicity.scorer(model)(pa.array(["a fine day", "you idiot"]))
    assert one > none or model["v"][0] <= 0


def test_toxicity_scores_by_plain_loops(spark):
    """The scorer against the kernel evaluated pair by pair."""
    words = ["^idiot", "^stupi", "^loser"]
    bags = [[{0: 1.0}]] * 4 + [[{1: 0.8}]] * 3 + [[{2: 0.9}, {0: 0.3}]] * 3 + [[]] * 6 + [[{1: 0.2}]] * 3
    model = toxicity.train(bags, np.array([1] * 10 + [0] * 9), words)
    marks = toxicity.Landmarks(words)
    texts = ["You idiot. So stupid and a loser! Fine day.", "nothing here", "", "l o s e r", "idi-ot idiot stupidly. loser loser"]
    for text, got in zip(texts, toxicity.scorer(model)(pa.array(texts))):
        best = []
        split = text.lower().split()
        cut, sentence = [], []
        for w in split:                     # a word that ends with . ! ? ends its sentence
            sentence.append(w)
            if w[-1] in ".!?":
                cut.append(sentence)
                sentence = []
        for ws in [*cut, sentence, *[[w] for w in toxicity.spaced_words(text.lower())]]:
            total = 0.0
            for w in toxicity.normalise(ws) if ws else []:
                for piece in toxicity._pieces([w])[0]:
                    if len(piece) < toxicity.P:
                        continue
                    code = lambda x, pad: toxicity._codes([x], len(x), pad)
                    k = lambda x, z: toxicity.subsequence_kernel(code(x, "\1"), code(z, "\2"))[0]
                    for v, m in zip(model["v"], words):
                        near = k(piece, m) / np.sqrt(k(piece, piece) * k(m, m))
                        total += v * near ** 2 if near >= toxicity.FLOOR else 0.0
            best.append(total)
        f = sum(sorted([x for x in best if x > 0], reverse=True)[:toxicity.TOP])
        want = 1 / (1 + np.exp(-(model["a"] * (f + model["bias"]) + model["b"])))
        assert abs(got - want) < 1e-5, text


def test_fingerprint_query_by_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    rnd = random.Random(4)
    rows = [(i, None if i == 5 else " ".join(rnd.choice("abcdef\u00e9") for _ in range(rnd.choice([0, 3, 9, 40, 300]))))
            for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_bottomk_fingerprint"](spark, sf).collect()}
    text = {i: t or "" for i, t in rows}
    for i, t in text.items():
        nxt = text[i - 1] if i else text[39]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = _shingles(t), _shingles(edited), _shingles(nxt)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        for near, other in ((got[i].near_edited, b), (got[i].near_next, c)):
            exact = len(a) < bottomk.K and len(other) < bottomk.K
            assert abs(near - like(a, other)) < (1e-9 if exact else 0.2)


def test_pipeline(spark):
    import corpus_pipeline as cp
    got = cp.run(spark, SF)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {"doc_id", "text", "taken", "target"} <= set(got.columns) and 0 < got.count() < docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = [i for i, r in ((r.doc_id, r) for r in got.collect())]
    sets = {i: _shingles(text[i].translate({c: c + 32 for c in range(65, 91)})) for i in kept}
    assert len(kept) == len(set(kept)) and _union_find(sets) == {i: i for i in kept}
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = cut_lineage(stage(spark, empty, SF), "pipeline-empty")
        assert empty.count() == 0
    odd = _edge(spark).select("*", F.lit(1).alias("size"), F.lit("c").alias("contaminated"))
    for name, stage in cp.STAGES:
        out = cut_lineage(stage(spark, odd, SF), "pipeline-odd")
        assert name == "mixing" or out.columns == odd.columns
        odd = out
