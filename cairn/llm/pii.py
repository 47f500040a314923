"""Personal data by bootstrapped contextual extraction, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NONSPACE, bounded_broadcast, checkpointed

KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted from this share (in millionths) of the instances that it meets, if so many distinct ones are of its kind.
TRUST, SUPPORT, ROUNDS = 500_000, 3, 3
#: Spans found up to this many are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
_ONE = 1_000_000

# A run is entered at its begin or where the match before has ended: the places in between could not match either.
_MAIL = "A-Za-z0-9._%+-"
#: The contract's patterns, with possessive repeats where giving back can't help, so that each takes linear time.
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_S = r"\x20\x09-\x0D"
_TOKEN = rf"[^{_S}0-9@(\[{{]*+[0-9@(\[{{][^{_S}]*+"
_NUMBER = r"[(+]{0,2}+[0-9][0-9()+./-]*+"
#: What may be an identifier: two to six numbers one blank apart, or a word with a digit, an at sign or a bracket.
CANDIDATE = rf"(?<![^{_S}])(?:{_NUMBER}(?:\x20{_NUMBER}){{1,5}}+|{_TOKEN})"
_PUNCT = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Looser shapes of the kinds, which contexts must confirm. An identifier has 4 to 64 characters.
SHAPES = {
    "email": r"^[^\x20]+(?:@|[\[({<](?:at|AT)[\])}>])[^\x20]+$",
    "ip": r"^(?:(?:[0-9]{1,4}[^A-Za-z0-9\x20]{1,3}){3}[0-9]{1,4}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})$",
    "card": r"^[0-9](?:[\x20./-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}$",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once: a lambda's variable isn't computed anew at each mention."""
    return F.transform(F.array(value), use)[0]


def running_sums(x: Column, block: int = 256) -> Column:
    """Sums of an array of longs up to and with each element. Blocks keep the copies that a growing array costs short."""
    one = lambda b: F.aggregate(b, F.array(F.lit(0).cast("long")), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))

    def joined(blocks: Column) -> Column:
        totals = one(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return _let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 2, block), lambda v: v + t[i]))))

    def summed(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda i: one(F.slice(x, i * block + 1, block)))
        return F.when(F.size(x) == 0, F.array().cast("array<long>")).otherwise(_let(cut, joined))

    return _let(x, summed)


def _context_word(w: Column, edge: str) -> Column:
    """A neighbour in lower case without punctuation around it; `#` for numbers, a mark of its own at a text's edge."""
    plain = F.regexp_replace(F.lower(w), rf"^[{_PUNCT}]+|[{_PUNCT}]+$", "")
    return F.when(w.isNull(), edge).when(w.rlike("[0-9]"), "#").otherwise(F.coalesce(F.nullif(plain, F.lit("")), w))


def _shape(value: Column) -> Column:
    """Bits of the kinds that a candidate may be."""
    fits = [F.when(value.rlike(SHAPES[k]), 1 << n).otherwise(0) for n, k in enumerate(KINDS)]
    return F.when(F.length(value).between(4, 64), sum(fits[1:], fits[0])).otherwise(0)


def _patterns(left: Column, right: Column) -> Column:
    """What stands around a place: two words before, one before, one on each side, two after."""
    words = lambda side: F.regexp_extract_all(side, F.lit(f"({NONSPACE})"), F.lit(1))

    def named(w: Column) -> Column:
        l2, l1 = (_context_word(F.try_element_at(w["a"], F.lit(-n)), "^") for n in (2, 1))
        r1, r2 = (_context_word(F.try_element_at(w["b"], F.lit(n)), "$") for n in (1, 2))
        made = F.array(F.concat_ws(" ", l2, l1, F.lit("_")), F.concat_ws(" ", l1, F.lit("_")), F.concat_ws(" ", l1, F.lit("_"), r1), F.concat_ws(" ", F.lit("_"), r1, r2))
        return F.filter(made, lambda p: ~p.rlike(r"^[\^ ]*_[$ ]*$"))  # a text's edge alone says nothing

    return _let(F.struct(words(F.substring(left, -80, 80)).alias("a"), words(F.substring(right, 1, 80)).alias("b")), named)


def _found(text: Column, pattern: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(value, start, patterns) of each match, leftmost first and apart, with code point positions."""
    parts = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"))

    def placed(z: Column) -> Column:
        ends = running_sums(F.transform(z["found"], lambda m, i: (F.length(z["parts"][i]) + F.length(m)).cast("long")))
        return _let(ends, lambda e: F.transform(z["found"], lambda m, i: make(m, e[i] - F.length(m), _patterns(z["parts"][i], z["parts"][i + 1]))))

    return _let(parts, placed)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _place(n: int, shape: Column, value: Column, start: Column, patterns: Column) -> Column:
    return F.struct(F.lit(n).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), F.lower(value).alias("value"), shape.cast("int").alias("shape"), patterns.alias("patterns"))


def base_spans(text: Column) -> Column:
    """The contract's matches of all kinds: array of (kind, start, end, value, shape, patterns), by kind and start."""
    of = lambda n, k: F.filter(_found(text, PATTERNS[k], lambda m, s, p: _place(n, F.lit(1 << n), m, s, p)), lambda x: _valid(k, x["value"]))
    return F.concat(*[of(n, k) for n, k in enumerate(KINDS)])


def candidate_spans(text: Column) -> Column:
    """What looks like an identifier of some kind, without the punctuation around it; kind is -1."""

    def trimmed(m: Column, start: Column, patterns: Column) -> Column:
        lead = F.length(F.regexp_extract(m, r"^([\x00-\x27\x29\x2A\x2C-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+)", 1))
        core = F.regexp_replace(F.substr(m, lead + 1), r"[\x00-\x28\x2A-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++$", "")
        return _let(F.struct(core.alias("v"), lead.alias("lead")), lambda c: _place(-1, _shape(c["v"]), c["v"], start + c["lead"], patterns))

    return F.filter(_found(text, CANDIDATE, trimmed), lambda x: x["shape"] > 0)


def pattern_instance_graph(places: DataFrame) -> DataFrame:
    """pattern, instance, kind (-1: a candidate), shape: distinct edges of patterns that more than one instance has."""
    edges = places.select(F.explode("patterns").alias("pattern"), F.concat_ws(":", F.col("kind").cast("string"), "value").alias("instance"), "kind", "shape").groupBy("pattern", "instance").agg(F.first("kind").alias("kind"), F.first("shape").alias("shape"))
    shared = edges.groupBy("pattern").agg(F.count("*").alias("n")).where("n > 1").select("pattern")
    return edges.join(shared, "pattern", "left_semi")


def trusted_patterns(graph: DataFrame, rounds: int = ROUNDS, trust: int = TRUST, support: int = SUPPORT) -> DataFrame:
    """pattern and, a kind, its score in millionths (0 if it isn't trusted).

    A pattern's score for a kind is the sum of its instances' scores over their number and one, where only identifiers and
    candidates of that shape count. Seeds are certain; a candidate is as likely as not to be missed by all of its trusted
    patterns. Each round scores patterns by instances and then instances by patterns. All sums are of whole numbers, so
    that no order of adding changes them.
    """
    scores = None
    for _ in range(rounds):
        rated = graph if scores is None else graph.join(scores, "instance", "left")
        held = {k: F.lit(0) if scores is None else F.coalesce(F.col(f"i_{k}"), F.lit(0)) for k in KINDS}
        sums = []
        for n, k in enumerate(KINDS):
            x = F.when(F.col("kind") == n, _ONE).when((F.col("kind") < 0) & (F.col("shape").bitwiseAND(1 << n) > 0), held[k])
            sums += [F.sum(x).alias(f"s_{k}"), F.sum(F.when(x.isNotNull() | (F.col("kind") >= 0), 1)).alias(f"n_{k}"), F.sum(F.when(x >= trust, 1)).alias(f"c_{k}")]
        score = {k: F.expr(f"s_{k} div (n_{k} + 1)") for k in KINDS}
        rules = rated.groupBy("pattern").agg(*sums).select("pattern", *[F.when((F.col(f"c_{k}") >= support) & (score[k] >= trust), score[k]).otherwise(0).alias(k) for k in KINDS])
        rules = checkpointed(rules.where(F.greatest(*KINDS) > 0))
        miss = [F.sum(F.round(-F.log(1 - F.least(F.col(k), F.lit(_ONE - 50_000)) / _ONE) * _ONE).cast("long")).alias(k) for k in KINDS]
        votes = graph.where("kind < 0").join(rules, "pattern").groupBy("instance").agg(*miss)
        scores = checkpointed(votes.select("instance", *[F.round((1 - F.exp(-F.col(k) / _ONE)) * _ONE).cast("long").alias(f"i_{k}") for k in KINDS]))
    return rules


def _free(places: DataFrame) -> DataFrame:
    """Candidates that no base span of their document overlaps."""
    by, order = Window.partitionBy("key", "doc_id"), [F.col(c) for c in ("start", "end", "kind")]
    sure = lambda c: F.when(F.col("kind") >= 0, F.col(c))
    so_far = lambda order: by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # what follows is what precedes in the other direction: Spark would add a frame to the end up anew for each row
    before, after = F.max(sure("end")).over(so_far(order)), F.min(sure("start")).over(so_far([c.desc() for c in order]))
    marked = places.withColumns({"before": before, "after": after})
    return marked.where((F.col("kind") < 0) & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))).drop("before", "after")


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans in order."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, trust: int = TRUST, support: int = SUPPORT, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Numbers and base_sha256 are of the base spans, those that the kinds' patterns and checks find. They are the seeds: the
    words around them are lexical patterns, and other words of a kind's looser shape are candidates. Patterns and
    instances score each other on the graph of what stands in what (trusted_patterns); a candidate in a trusted pattern's
    place becomes a span of the kind that its best pattern speaks for, unless it overlaps a base span. Copies of a text
    add no weight, as instances are counted once a pattern. The text is read once; what is shuffled are places and words
    around them, partial sums first.

    Null text is empty and has no spans. A null doc_id is an id. Rows that repeat an id and text get the same result; the
    same id with another text is judged apart. Ties between kinds go to the first listed. An empty table gives no rows.
    Texts of any length are read whole, in time linear in their length. Extra columns are not read.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    read = checkpointed(whole.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("more")))
    places = read.select("doc_id", "key", F.explode(F.concat("base", "more")).alias("p")).select("doc_id", "key", "p.*")
    free = checkpointed(_free(places))
    graph = checkpointed(pattern_instance_graph(places.where("kind >= 0").select("patterns", "kind", "value", "shape").unionByName(free.select("patterns", "kind", "value", "shape"))))
    rules = trusted_patterns(graph, rounds, trust, support)
    near = bounded_broadcast(rules, rules.count(), limit)
    spoken = free.select("doc_id", "key", "start", "end", "shape", F.explode("patterns").alias("pattern")).join(near, "pattern")
    votes = F.array_max(F.array(*[F.struct(F.when(F.col("shape").bitwiseAND(1 << n) > 0, F.col(k)).otherwise(0).alias("score"), F.lit(-n).alias("kind")) for n, k in enumerate(KINDS)]))
    best = spoken.withColumn("vote", votes).where("vote.score > 0").groupBy("doc_id", "key", "start", "end").agg(F.max("vote").alias("vote"))
    found = best.groupBy("doc_id", "key").agg(F.collect_set(F.struct((-F.col("vote.kind")).alias("kind"), "start", "end")).alias("found")).select(F.col("doc_id").alias("own_id"), F.col("key").alias("own"), "found")
    found = checkpointed(found)
    side = bounded_broadcast(found, found.agg(F.sum(F.size("found"))).first()[0] or 0, limit)
    out = read.select("doc_id", "key", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    out = out.join(side, (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    number = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    spans = F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("found", F.slice("base", 1, 0)))))
    return out.select("doc_id", *[number(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"))
