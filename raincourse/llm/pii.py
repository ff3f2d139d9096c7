"""PII by bootstrapped contextual extraction, in column expressions only.

Base spans seed a graph of patterns and instances. A pattern is a kind with words beside a span: one or two to the
left, one to the right, or one on each side, in lower case and with 0 for digits. An instance is a
string of a kind's loose shape. Each round scores patterns by the share of what stands in their context
that is known for the kind, and instances by the best trusted pattern that extracts them; instances that
are known now support new patterns in the next round, until no more patterns are trusted.
Trusted patterns give the spans that no base rule has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.session import sized

KINDS = ["email", "ip", "card", "phone"]

# The given rules, written so that a failing start is not tried again inside the same run and no
# repetition backtracks: matches are the same, time is linear in the text. Cards are the runs of
# digits with single separators whose number of digits is 13 to 19.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What may be an identifier: a run of its characters with a digit or @, and digit groups after it.
SHAPE = r"(?<![A-Za-z0-9@._%+()-])(?=[A-Za-z._%+()-]*+[0-9@])[A-Za-z0-9@._%+()-]++(?:[\x20][0-9(][0-9().-]++)*+"


def _spans(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, v>>: positions in code points from the text between the matches."""
    p = pattern.replace("\\", "\\\\")
    return f"""aggregate(
        arrays_zip(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0)),
        named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int,v:string>>)),
        (acc, x) -> named_struct('at', acc.at + length(x.`0`) + coalesce(length(x.`1`), 0), 'out',
            if(x.`1` IS NULL, acc.out, concat(acc.out, array(named_struct(
                's', acc.at + length(x.`0`), 'e', acc.at + length(x.`0`) + length(x.`1`), 'v', x.`1`)))))
    ).out"""


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (acc, i) -> acc +
    if(i % 2 = 1, int(substr({_DIGITS}, -i, 1)),
       int(2 * int(substr({_DIGITS}, -i, 1)) - if(int(substr({_DIGITS}, -i, 1)) > 4, 9, 0)))) % 10 = 0"""
_RULE = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), d -> length(ltrim('0', d)) <= 3 AND coalesce(try_cast(right(d, 3) AS int), 999) <= 255)",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
# Loose shapes: what a trusted context may add to a kind, found inside an identifier-like string, again without backtracking.
_LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)*+", "true"),
    "ip": (r"(?<![0-9])[0-9]{1,3}+(?:[.-][0-9]{1,3}+){3,}+", "true"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+", f"length({_DIGITS}) <= 19"),
    "phone": (r"[+(]?[0-9][0-9\x20().-]+[0-9]", f"length({_DIGITS}) BETWEEN 7 AND 15"),
}


def _patterns(text: str, start: str, end: str) -> str:
    """SQL for the patterns of a span: words in the 64 characters on either side; none where there are no words."""
    words = lambda part: f"filter(split(regexp_replace(lower({part}), '[0-9]+', '0'), '[\\\\s]+'), w -> w != '')"
    left, right = words(f"substr({text}, greatest({start} - 63, 1), least({start}, 64))"), words(f"substr({text}, {end} + 1, 64)")
    return (f"transform(array(named_struct('l', reverse({left}), 'r', {right})), w -> filter(array(concat('l1 ', get(w.l, 0)), concat('l2 ', get(w.l, 1), ' ', get(w.l, 0)), "
            "concat('r1 ', get(w.r, 0)), concat('lr ', get(w.l, 0), ' ', get(w.r, 0))), c -> c IS NOT NULL))[0]")


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to (rid, doc_id, base, loose, rest).

    base: array of (k, s, e, v, p) by kind and start, k the place in KINDS, p the patterns.
    loose: the same for strings of a loose shape that overlap no base span. rest: the patterns of
    identifier-like strings that are neither.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for i, kind in enumerate(KINDS):
        rows = rows.withColumn(f"k{i}", F.expr(f"filter({_spans('t', BASE[kind])}, x -> {_RULE[kind]})"))
    rows = rows.withColumn("o", F.expr(_spans("t", SHAPE)))
    base = ", ".join(f"transform(k{i}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 'v', x.v))" for i in range(len(KINDS)))
    rows = rows.withColumn("b", F.expr(f"concat({base})"))
    free = "NOT exists(b, y -> y.s < x.e AND x.s < y.e)"
    loose = []
    for i, kind in enumerate(KINDS):
        shape, rule = _LOOSE[kind]
        shape = shape.replace("\\", "\\\\")
        inner = f"transform(o, x -> named_struct('at', x.s, 'v', regexp_extract(x.v, '{shape}', 0), 'of', x.v))"
        placed = f"transform(filter({inner}, x -> x.v != ''), x -> named_struct('k', {i}, 's', x.at + instr(x.of, x.v) - 1, 'e', x.at + instr(x.of, x.v) - 1 + length(x.v), 'v', x.v))"
        loose.append(f"filter({placed}, x -> {free} AND {rule})")
    rows = rows.withColumn("l", F.expr(f"concat({', '.join(loose)})"))
    with_patterns = lambda name: F.expr(f"transform({name}, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'p', {_patterns('t', 'x.s', 'x.e')}))")
    rest = F.expr(f"flatten(transform(filter(o, x -> {free} AND NOT exists(l, y -> y.s < x.e AND x.s < y.e)), x -> {_patterns('t', 'x.s', 'x.e')}))")
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", with_patterns("b").alias("base"), with_patterns("l").alias("loose"), rest.alias("rest"))


def trusted_patterns(found: DataFrame, rounds: int = 10, support: int = 3, confidence: float = 0.6) -> DataFrame:
    """(k, c) of the patterns that point to kind k with at least ``confidence``.

    Confidence is known mass / (mass + 1): mass counts all identifier-like strings in the context,
    whatever their kind, so a word that stands before anything is no pattern. An instance counts
    1 if a base rule knows it, else the best confidence of the trusted patterns that extract it. A
    pattern needs ``support`` different instances of at least ``confidence``. Rounds end when no further pattern is trusted,
    at the latest after ``rounds``.
    """
    item = lambda name, known: found.select(F.explode(name).alias("x")).select("x.k", F.explode("x.p").alias("c"), F.lower("x.v").alias("v"), F.lit(known).alias("known"))
    items = item("base", 1.0).union(item("loose", 0.0))
    edges = sized(items.groupBy("k", "c", "v").agg(F.max("known").alias("known"), F.count(F.lit(1)).alias("n")), "pii-edges")
    mass = edges.select("c", "n").union(found.select(F.explode("rest").alias("c"), F.lit(1).cast("long").alias("n"))).groupBy("c").agg(F.sum("n").alias("mass"))
    # Fewer different values than the support can never make a pattern.
    live = edges.groupBy("k", "c").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= support).select("k", "c")
    live = sized(live.join(mass, "c"), "pii-live")
    edges = sized(edges.join(live, ["k", "c"]), "pii-edges")
    now, trusted, before = edges, None, -1
    for _ in range(rounds):
        score = now.groupBy("k", "c").agg(F.count_if(F.col("known") >= confidence).alias("seeds"), (F.sum(F.col("known") * F.col("n")) / (F.max("mass") + 1)).alias("conf"))
        trusted = sized(score.where((F.col("seeds") >= support) & (F.col("conf") >= confidence)).select("k", "c", "conf"), "pii-patterns")
        number = trusted.count()
        if number == before:
            break
        before = number
        best = sized(edges.where("known < 1").join(trusted, ["k", "c"]).groupBy("k", "v").agg(F.max("conf").alias("best")), "pii-instances")
        now = edges.join(best, ["k", "v"], "left").withColumn("known", F.greatest("known", F.coalesce("best", F.lit(0.0)))).drop("best")
    return trusted.select("k", "c")


def find_pii(docs: DataFrame, rounds: int = 10, support: int = 3, confidence: float = 0.6) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and spans, array of (k, s, e, v, base).

    A null text is empty; a null doc_id stays null; repeated rows each give their own row; other
    columns are ignored. A text without identifiers has an empty array. Spans of a kind never
    overlap: what a context adds lies outside all base spans.
    """
    found = sized(base_spans(docs), "pii-found")
    trusted = trusted_patterns(found, rounds, support, confidence)
    loose = found.select("rid", F.explode("loose").alias("x")).select("rid", "x.k", "x.s", "x.e", "x.v", F.explode("x.p").alias("c"))
    added = (loose.join(trusted, ["k", "c"], "left_semi").select("rid", F.struct("k", "s", "e", "v", F.lit(False).alias("base")).alias("x")).distinct()
             .groupBy("rid").agg(F.collect_list("x").alias("added")))
    base = F.expr("transform(base, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'base', true))")
    return (found.select("rid", "doc_id", base.alias("base")).join(added, "rid", "left")
            .select("doc_id", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, from the spans of ``find_pii``."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    line = f"array_join(transform({{}}, x -> concat_ws(':', element_at(array({names}), x.k + 1), string(x.s), string(x.e))), ',')"
    base = "filter(spans, x -> x.base)"
    counts = [F.expr(f"bigint(size(filter(spans, x -> x.k = {i})))").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.expr(f"sha2({line.format(base)}, 256)").alias("base_sha256"), F.expr(line.format("spans")).alias("spans"))
