r"""Operator 4: personal data by gradient-boosted candidates, in SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns with checks and always
stay. The patterns are written so that a match can start only at the start of a
run or where the last match ended (``\G``), and quantifiers are possessive: the
matches are those of the plain leftmost search, in linear time on any text.
Positions are prefix sums over the pieces between matches (``split``) and the
matches, in code points.

On top of them high-recall generators propose spans (numbers with loose
separators, dotted or coloured address forms, written-out addresses), which may
overlap. Boosted trees (MLlib, fitted on all documents) tell them apart by
format and context. Their examples come from the texts without contradicting the base patterns: each base span found is
written anew in forms the patterns don't match (other separators, brackets,
spelled-out signs, no plus; half of them behind a cue word), set back between
its own neighbours, and what the generators find there is positive; candidates
of the texts as they are that touch no base span (numbers, dates, matches that
failed their check) are negative. Half of the documents train, and on the others
the least score per kind that keeps ``precision`` is its threshold (negatives are
unlabelled: hidden personal data among them makes the measured precision too
low, never too high). The trees are
applied as one column expression inside the row, so scoring needs no shuffle. A
candidate that touches a base span is never selected.

Overlaps are found by sorting spans and candidates together and running maxima,
and ``redact`` by running maxima too: no step compares all pairs of a text.

Cases: null text is empty and has no spans; spans are half-open; spans of
different kinds may overlap; repeated rows are searched one by one; an empty
table, or one without both kinds of examples, adds no spans; ``keep`` columns
pass through, result columns whose names clash get a trailing underscore.
"""
from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh

KINDS = ("email", "ip", "card", "phone")
_L = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?:(?<![0-9A-Fa-f:.])|\G)(?:[0-9]{1,3}+(?:[.:-][0-9]{1,3}+){3}+|(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+)",
    "card": r"[0-9](?:[\x20./-]{0,2}+[0-9]){10,20}+",
    "phone": r"\+?[(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,14}+",
}
# cheap tests that a text must pass before a pattern is tried on it
_GATE = {"email": r"@|[\[({] ?at ?[\])}]", "ip": "[0-9A-Fa-f][.:-]", "card": "[0-9]", "phone": "[0-9]"}
# a text without any of these holds no span: patterns need a digit or an address sign
_ANY = r"[0-9@]|[\[({] ?at ?[\])}]"
_BLOCK = 256

SPAN = "struct<kind:string,start:int,end:int,base:boolean>"


def _let(value: Column, body):
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_fold(a: Column, zero, op) -> Column:
    """``op`` over ``zero`` and the elements before each element, in about n * 256
    steps (``op`` associative, ``zero`` neutral)."""
    def fold(x):
        return F.aggregate(x, zero, op)

    def outer(x):
        n_blocks = F.ceil(F.size(x) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
                             lambda b: fold(F.slice(x, b * _BLOCK + 1, _BLOCK)))
        offs = _let(blocks, lambda s: F.transform(s, lambda y, i: fold(F.slice(s, F.lit(1), i))))
        return _let(offs, lambda o: F.transform(x, lambda y, i: op(
            F.element_at(o, F.floor(i / _BLOCK).cast("int") + 1),
            fold(F.slice(x, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))))
    return _let(a, outer)


def prefix_sums(lens: Column) -> Column:
    """Sums of the elements before each element."""
    return prefix_fold(lens, F.lit(0), lambda s, x: s + x)


def prefix_max(a: Column, least: int = -1) -> Column:
    """Largest of the elements before each element (``least`` before the first)."""
    return prefix_fold(a, F.lit(least), lambda s, x: F.greatest(s, x))


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<m, pre, post, start, end>> of a pattern's matches; pre and
    post are the neighbouring pieces' ends."""
    def place(found, gaps):
        size = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                          lambda m, g: F.char_length(m) + F.char_length(g))
        return _let(prefix_sums(size), lambda at: F.transform(found, lambda m, i: _let(
            F.element_at(at, i + 1) + F.char_length(F.element_at(gaps, i + 1)),
            lambda s: F.struct(m.alias("m"), F.right(F.element_at(gaps, i + 1), F.lit(24)).alias("pre"),
                               F.left(F.element_at(gaps, i + 2), F.lit(8)).alias("post"),
                               s.alias("start"), (s + F.char_length(m)).alias("end")))))
    none = F.array().cast("array<struct<m:string,pre:string,post:string,start:int,end:int>>")
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.coalesce(_let(found, lambda f: F.when(
        F.size(f) > 0, _let(F.split(text, pattern, -1), lambda g: place(f, g)))), none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn check of a string of digits."""
    def points(i):
        x = F.substring(d, -i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 0, 2 * x).otherwise(x)
        return F.when(y > 9, y - 9).otherwise(y)
    steps = F.transform(F.sequence(F.lit(1), F.length(d)), points)
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(digits(m))).otherwise(False)


def _base_row(k: int, kind: str):
    def ok(x):
        return valid(kind, x["m"])

    def row(x):
        return F.struct(x["start"].alias("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"),
                        x["end"].alias("end"))
    return ok, row


def base_spans(text: Column) -> Column:
    """All base spans, ordered by start, then kind as listed."""
    per = []
    for k, kind in enumerate(KINDS):
        need = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(
            kind, text.rlike("[0-9]"))
        ok, row = _base_row(k, kind)
        per.append(F.transform(F.filter(matches(text, BASE[kind], need), ok), row))
    return F.transform(F.sort_array(F.concat(*per)), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("base")))


FEATURES = ["kind", "length", "digits", "groups", "separators", "dots", "plus", "bracket", "at",
            "space_before", "word_before", "clean_after", "cue", "first_group", "letters"]


def features(kind: int, c: Column) -> Column:
    """Format and context of a candidate, as array<double> in FEATURES' order."""
    m, flag = c["m"], lambda x: F.when(x, 1.0).otherwise(0.0)
    f = [F.lit(float(kind)), F.length(m), F.length(digits(m)), F.regexp_count(m, F.lit("[0-9]+")),
         F.regexp_count(m, F.lit(r"[ ().-]")), F.regexp_count(m, F.lit(r"\.")), flag(F.startswith(m, F.lit("+"))),
         flag(F.contains(m, F.lit("("))), flag(F.contains(m, F.lit("@"))),
         flag(c["pre"].rlike(r"(^|\s)$")), flag(c["pre"].rlike(r"[A-Za-z0-9]$")),
         flag(c["post"].rlike(r"^($|[\s.,;:!?)])")),
         flag(c["pre"].rlike(r"(?i)(tel|phone|call|mail|card|visa|contact|ip|host|fax|mobile)[^a-z]{0,4}$")),
         F.length(F.regexp_extract(m, "[0-9]+", 0)), F.regexp_count(m, F.lit("[A-Za-z]"))]
    return F.array(*[x.cast("double") for x in f])


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, kind, x>> of all generators' finds that touch no
    base span, by start.

    Finds and base spans are sorted together by start; a find touches a base span
    that begins before it if the largest end of those is beyond its start, or
    one that begins later if the next one begins before its end."""
    def row(k, kind):
        return lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("find"), c["end"].alias("end"),
                                  F.lit(kind).alias("kind"), features(k, c).alias("x"))

    def free(every):
        reach = prefix_max(F.transform(every, lambda e: F.when(e["find"] == 0, e["end"]).otherwise(F.lit(-1))))
        back = F.reverse(every)         # negated starts: the largest is the nearest
        ahead = F.reverse(prefix_max(F.transform(back, lambda e: F.when(e["find"] == 0, -e["start"])
                                                 .otherwise(F.lit(-2147483647))), -2147483647))
        tagged = F.zip_with(F.zip_with(every, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), ahead,
                            lambda t, h: F.struct(t["e"].alias("e"), t["r"].alias("r"), h.alias("h")))
        kept = F.filter(tagged, lambda t: (t["e"]["find"] == 1) & (t["r"] <= t["e"]["start"])
                        & (-t["h"] >= t["e"]["end"]))
        return F.transform(kept, lambda t: t["e"])
    finds = F.concat(*[F.transform(matches(text, GENERATORS[kind], text.rlike(_GATE[kind])), row(k, kind))
                       for k, kind in enumerate(KINDS)])
    # base spans sort before finds of the same start
    spans = F.transform(base, lambda b: F.struct(
        b["start"].alias("start"), F.lit(0).alias("find"), b["end"].alias("end"), b["kind"].alias("kind"),
        F.array().cast("array<double>").alias("x")))
    return _let(finds, lambda f: F.when(F.size(f) == 0, f).otherwise(
        _let(F.sort_array(F.concat(spans, f)), free)))


# how a base span is written anew for the positive examples: pairs of a pattern
# and its replacement, applied in turn
_EMAIL = [[("@", " [at] "), (r"\.(?=[^@]*$)", " [dot] ")], [("@", "(at)"), (r"\.(?=[^@()]*$)", "(dot)")],
          [("@", " @ ")], [("@", "{at}"), (r"\.(?=[^@{}]*$)", "{dot}")], [("@", " (at) "), (r"\.(?=[^@()]*$)", " (dot) ")]]
_IP = [[(r"\.", "-")], [(r"\.", ":")]]
_CARD = [[("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1.")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1/")],
         [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1  ")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1. ")]]
_PHONE = [[("[^0-9]", ""), ("^[0-9]{2}", "0"), ("([0-9]{3})(?=[0-9]{2})", "$1 ")],
          [("[^0-9]", ""), ("^([0-9]{3})", "($1) "), ("([0-9]{3})([0-9]{4})$", "$1-$2")],
          [("[^0-9]", ""), ("([0-9]{3})(?=[0-9]{2})", "$1.")], [("[^0-9]", ""), ("([0-9]{3})(?=[0-9]{2})", "$1-")],
          [("[^0-9]", ""), ("^[0-9]{2}", "0"), ("^([0-9]{4})([0-9]{3})([0-9]{2})", "$1 $2 $3 ")]]
REWRITES = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
CUES = {"email": "mail: ", "ip": "host ", "card": "card ", "phone": "tel "}


def rewritten(kind: Column, m: Column, pick: Column) -> Column:
    """The text ``m`` of a base span in a form that its pattern doesn't match."""
    out = F.lit(None).cast("string")
    for k, forms in REWRITES.items():
        for i, steps in enumerate(forms):
            new = m
            for pattern, to in steps:
                new = F.regexp_replace(new, pattern, to)
            out = F.when((kind == k) & (F.pmod(pick, F.lit(len(forms))) == i), new).otherwise(out)
    return out


def examples(docs: DataFrame, text_col: str = "t") -> DataFrame:
    """kind, label, h (hash of the document), x: the trees' examples."""
    t = F.col(text_col)
    d = docs.select(t.alias("t"), F.xxhash64(text_col).alias("h"), base_spans(t).alias("base"))
    plain = (d.select("h", F.explode(candidates(F.col("t"), F.col("base"))).alias("c"))
             .select(F.col("c.kind").alias("kind"), F.lit(0.0).alias("label"), "h", F.col("c.x").alias("x")))
    b = d.select("h", "t", F.explode("base").alias("b"))
    cut = lambda a, n: F.substring(F.col("t"), a + 1, n)
    b = b.select("h", F.col("b.kind").alias("kind"), F.col("b.start").alias("s"), F.col("b.end").alias("e"), "t")
    b = b.withColumn("pick", F.xxhash64("h", "s", "kind"))
    cue = F.lit("")
    for k, word in CUES.items():
        cue = F.when(F.col("kind") == k, F.lit(word)).otherwise(cue)
    b = b.select("h", "kind", F.concat(
        cut(F.greatest(F.col("s") - 24, F.lit(0)), F.least(F.col("s"), F.lit(24))),
        F.when(F.pmod(F.shiftright("pick", 8), F.lit(2)) == 0, cue).otherwise("")).alias("pre"),
        rewritten(F.col("kind"), cut(F.col("s"), F.col("e") - F.col("s")), F.col("pick")).alias("new"),
        cut(F.col("e"), F.lit(8)).alias("post"))
    b = b.withColumn("t", F.concat("pre", "new", "post")).withColumn("at", F.char_length("pre"))
    b = b.withColumn("to", F.col("at") + F.char_length("new"))
    planted = (b.select("h", "kind", "at", "to", F.explode(candidates(F.col("t"), base_spans(F.col("t")))).alias("c"))
               .where((F.col("c.kind") == F.col("kind")) & (F.col("c.start") < F.col("to")) & (F.col("c.end") > F.col("at")))
               .select("kind", F.lit(1.0).alias("label"), "h", F.col("c.x").alias("x")))
    return plain.unionByName(planted)


def _tree(node, x: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    s = node.split()
    return F.when(F.element_at(x, int(s.featureIndex()) + 1) <= float(s.threshold()),
                  _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def fit(docs: DataFrame, text_col: str, precision: float = 0.95, rounds: int = 8, depth: int = 3, seed: int = 7):
    """(score, thresholds): a function array<double> Column -> probability
    Column, and the selecting threshold per kind; None without examples.

    All documents give examples, half of them for the trees and half for the
    thresholds; the examples stay distributed.
    """
    # other texts hold no base span and no candidate
    d = docs.select(F.col(text_col).alias("t")).where(F.col("t").rlike(_ANY))
    c = examples(d).withColumn("train", F.pmod(F.col("h"), F.lit(2)) == 0)
    c = cut_lineage(c.select("kind", "label", "train", "x"), "pii-examples")
    both = c.where("train").agg(F.min("label"), F.max("label")).first()
    if both[0] is None or both[0] == both[1]:
        return None
    flat = c.where("train").select("label", *[F.col("x")[i].alias(f) for i, f in enumerate(FEATURES)])
    flat = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(flat)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed).fit(flat)
    trees = list(zip(model.treeWeights, model._java_obj.trees()))

    def score(x: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * _tree(t.rootNode(), x) for w, t in trees])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * margin))
    # calibration: hundredths of the score, counted per kind on the held-out half
    hist = (c.where("not train").groupBy("kind", F.floor(score(F.col("x")) * 100).alias("s"))
            .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect())
    cuts = {}
    for kind in KINDS:
        good = total = 0
        for r in sorted((r for r in hist if r.kind == kind), key=lambda r: -r.s):
            good, total = good + r.good, total + r.n
            if good >= precision * total:
                cuts[kind] = r.s / 100.0
    return score, cuts


def find_pii(docs: DataFrame, text_col: str = "text", keep=("doc_id",), precision: float = 0.95) -> DataFrame:
    """``keep`` columns, the text as ``text`` and ``spans`` array<struct<kind,
    start, end, base>> ordered by start, then kind."""
    keep = list(keep)
    text, spans = fresh("__t", keep), fresh("spans", keep)
    model = fit(docs, text_col, precision)
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    t = F.col(text)
    d = d.withColumn(spans, base_spans(t))
    if model and model[1]:
        score, cuts = model
        bar = F.create_map(*[y for k, v in cuts.items() for y in (F.lit(k), F.lit(v))])

        def extra(base):
            good = F.filter(candidates(t, base), lambda c: (
                score(c["x"]) >= F.coalesce(F.try_element_at(bar, c["kind"]), F.lit(2.0))))
            order = F.array(*[F.lit(k) for k in KINDS])
            every = F.concat(F.transform(base, lambda s: F.struct(
                s["start"].alias("start"), F.array_position(order, s["kind"]).alias("ord"), s["kind"].alias("kind"),
                s["end"].alias("end"), s["base"].alias("base"))), F.transform(good, lambda c: F.struct(
                    c["start"].alias("start"), F.array_position(order, c["kind"]).alias("ord"), c["kind"].alias("kind"),
                    c["end"].alias("end"), F.lit(False).alias("base"))))
            return F.transform(F.sort_array(every), lambda x: F.struct(
                x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
        # only texts with a digit or an address sign can hold a candidate
        d = d.withColumn(spans, F.when(t.rlike(_ANY), _let(F.col(spans), extra))
                         .otherwise(F.col(spans)))
    return d


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by [KIND] of
    the first. ``spans`` are sorted by start."""
    def heads(sp, reach):
        """Spans that begin at or after all earlier ends, with that end."""
        return F.filter(F.zip_with(sp, reach, lambda s, r: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), r.alias("before"))),
            lambda h: (h["before"] < 0) | (h["start"] >= h["before"]))

    def build(h, end):
        # the piece before a head begins where the last merged span ended
        parts = F.transform(h, lambda s: _let(F.greatest(s["before"], F.lit(0)), lambda a: F.concat(
            F.substring(text, a + 1, s["start"] - a), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.lit(2147483647)))

    def outer(sp):
        return _let(prefix_max(F.transform(sp, lambda s: s["end"])), lambda reach: build(
            heads(sp, reach), F.array_max(F.transform(sp, lambda s: s["end"]))))
    return F.when(F.size(spans) > 0, _let(spans, outer)).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    from .common import prepare, sha_hex, table
    prepare(spark)
    d = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return d.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                    sha_hex(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
