"""Personal data, source divergence and the Merkle manifest: brute force on small tables, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm import ODD, odd  # noqa: E402

from cairn.llm import divergence, merkle, pii  # noqa: E402

# --- 11 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def spans(r):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(","))] if r["spans"] else []


def check(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), texts[r["doc_id"]][:200]
        assert Counter(k for k, _, _ in want) == Counter({k: r[f"n_{k}"] for k in BASE if r[f"n_{k}"]})
        got = spans(r)
        assert set(want) <= set(got) and len(got) == len(set(got))
        assert got == sorted(got, key=lambda s: (list(BASE).index(s[0]), s[1:]))
        more = [s for s in got if s not in want]
        assert all(b <= c or d <= a for _, a, b in more for _, c, d in want)


TRICKY = [
    "a@b.c_d@e.f x@y.z.@q.w 😀 1.2.3.4.5.6.7.8 1.2.3.256 000.001.1.255",
    "+1((( +12345678 +1 ( 499 ) 555 6666 4111 1111-1111 1111 4111 1111 1111 1112",
    "é@a.b aé@b.c.😀@d.e a@b a@.b @a.b --@-.- %@a.b+c@d.e.f.",
    "4111111111111111 4111-1111 1111-1111 4111  111111111111 0000000000000000 41111111111111111111",
    "+1 2 3 4 5 6 7 8+1 2 3 4 5 6 7 8 9 +12.34.56.78. +1-2 +123456789012345 +1234567890123456",
    "1.1.1.1.1 01.1.1.1 1..1.1.1 300.1.1.1.1 255.255.255.255",
]


def test_base_spans_are_the_patterns(spark, small):
    rng = random.Random(3)
    pieces = ["a", "b.", "@", "1", "12", ".", "-", "+", " ", "(", ")", "_", "é", "😀", "4111111111111111", "\n", "255", "x@y.z"]
    rows = list(enumerate(TRICKY + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(400)]))
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{small}/documents.parquet")):
        check(pii.personal_data(df).collect(), {r["doc_id"]: r["text"] for r in df.collect()})


def graph_scores(docs, rounds=pii.ROUNDS):
    """Trusted patterns by brute force, from the operator's places."""
    edges = {}
    for r in docs.collect():
        for p in r["patterns"]:
            edges[p, (r["kind"], r["value"])] = r["shape"]
    by = defaultdict(list)
    for (p, i), shape in edges.items():
        by[p].append((i, shape))
    by = {p: v for p, v in by.items() if len(v) > 1}
    held = {}
    for _ in range(rounds):
        rules = {}
        for p, v in by.items():
            for n, k in enumerate(pii.KINDS):
                x = [1_000_000 if i[0] == n else held.get((i, k), 0) if i[0] < 0 and shape >> n & 1 else None for i, shape in v]
                size = sum(y is not None or i[0] >= 0 for y, (i, _) in zip(x, v, strict=True))
                score = sum(y or 0 for y in x) // (size + 1)
                if sum((y or 0) >= pii.TRUST for y in x) >= pii.SUPPORT and score >= pii.TRUST:
                    rules[p, k] = score
        held = {}
        for (p, k), s in rules.items():
            for i, _ in by[p]:
                if i[0] < 0:
                    held[i, k] = 1 - (1 - held.get((i, k), 0)) * (1 - min(s, 950_000) / 1e6)
        held = {x: round(v * 1e6) for x, v in held.items()}
    return rules


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"Write to mail: u{i}@h{i}.org now please") for i in range(6)]
    rows += [(10 + i, f"Write to mail: u{i}@host now please {i}") for i in range(3)]
    rows += [(20 + i, f"please call +1 222 333 444{i} today") for i in range(5)]
    rows += [(30, "please call 222 333 4449 today."), (31, "see page 222 333 4449 of it"), (32, "mail: u@host, call 12 today, call (0222) 333-4449 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(k, dict(rows)[r["doc_id"]][a:b]) for k, a, b in spans(r)] for r in pii.personal_data(docs).collect()}
    assert got[10] == [("email", "u0@host")] and got[12] == [("email", "u2@host")]
    assert got[30] == [("phone", "222 333 4449")] and got[31] == []
    assert got[32] == [("phone", "(0222) 333-4449")] or got[32] == [("email", "u@host"), ("phone", "(0222) 333-4449")]
    check(pii.personal_data(docs).collect(), dict(rows))
    places = docs.select(F.explode(F.concat(pii.base_spans(F.col("text")), pii.candidate_spans(F.col("text")))).alias("p")).select("p.*").where("kind >= 0 or not value rlike '^[+]?1? ?222 333 444[0-4]$'").where("kind >= 0 or not value rlike '[.]org$'")
    want = graph_scores(places)
    rules = pii.trusted_patterns(pii.pattern_instance_graph(places)).collect()
    found = {(r["pattern"], k): r[k] for r in rules for k in pii.KINDS if r[k]}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) <= 2 for x in want)
    # without broadcasts the same
    far = pii.personal_data(docs, limit=-1)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, pii.personal_data(docs).collect()))


@pytest.mark.parametrize("rows", [ODD, []])
def test_personal_data_of_odd_rows(spark, rows):
    more = [(20, "a@b.cc " * 3000, "en", "a", 1), (21, "x@" * 20_000 + "1" * 50_000 + "a." * 20_000, "en", "a", 1)] if rows else []
    got = pii.personal_data(odd(spark, rows + more)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows + more)
    if rows:
        of = {r["doc_id"]: r for r in got}
        assert of[20]["n_email"] == 3000 and of[3]["spans"] == "" and of[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
        check([of[20], of[21]], {r[0]: r[1] for r in more})


# --- 12 source divergence


def brute_divergence(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source, words = lang or "", source or "", terms(text)
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = lambda n, size: 1 + 10**9 * (n + 5) // (size + 5 * len(kept))
        mine = {s: [p(counts[lang, s][t], total[s]) for t in kept] for s in sources}
        whole = [p(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pair = sorted(((-sum(abs(a - b) for a, b in zip(mine[s], mine[o], strict=True)), o.encode()) for o in sources - {s}))
            term = sorted((q - a, t.encode()) for t, a, q in zip(kept, mine[s], whole, strict=True) if counts[lang, s][t] and a > q)[:top]
            out |= {(lang, s, part, i.decode(), -v, r + 1) for part, x in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(x)}
    return out


@pytest.mark.parametrize("block, tile, least", [(1024, 64, 2), (7, 2, 1), (64, 1, 3), (200, 3, 40)])
def test_divergence_is_brute_force(spark, block, tile, least):
    rng = random.Random(block)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ünd", "ünd", "ÉA", "éa"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 200))), rng.choice(["en", "en", "de", None]), rng.choice([f"s{k}" for k in range(9)] + [None, "é"]), 0) for i in range(120)]
    rows += [(200 + i, "only here", "xx", f"t{i}", 0) for i in range(3)] + [(300, "12 !", "yy", "a", 0), (301, None, "yy", "b", 0)]
    got = divergence.source_divergence(odd(spark, rows), least=least, top=5, block=block, tile=tile, limit=4000).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(rows, least, 5)


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 3 * 10**12 + 7, 10**13 + 1, 10**6
    r = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert r == 1 + 10**9 * (n + 5) // (total + 5 * v)


@pytest.mark.parametrize("rows", [ODD, []])
def test_divergence_of_odd_rows(spark, rows):
    got = divergence.source_divergence(odd(spark, rows), least=1, top=50).collect()
    assert {tuple(r) for r in got} == brute_divergence(rows, 1, 50)


# --- 13 Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at - at % 3 : at - at % 3 + 3]
        out.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: sha("".join(map(field, (i, s, g, n, t))))
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        own = leaf(i, text, lang, source, n)
        bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None
        by[source].append(((i is not None, i or 0, own), i, own, leaf(i, text.replace("\n", ""), lang, source, n) if bad else own))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names]) if names else [[None]]
    out = []
    for at, s in enumerate(names):
        for k, (_, i, own, seen) in enumerate(sorted(by[s])):
            path = siblings(trees[s], k) + siblings(top, at)
            folded = seen
            for a, b in path:
                folded = sha("".join(a) + folded + "".join(b))
            out.append((i, own, trees[s][-1][0], top[-1][0], sha("".join(h for a, b in path for h in a + b)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every, sizes", [(5, [700, 1, 81, 82]), (1, [40, 3, 4]), (2, [9, 10, 81, 1, 28]), (2, [50]), (5, [1]), (1, [1] * 11)])
def test_manifest_is_brute_force(spark, every, sizes):
    rng = random.Random(every)
    rows = [(1000 * s + i, rng.choice(["a", "a\nb", "", None, "é\n"]), "en", None if s == 2 else f"s{s}é" if s % 2 else f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    got = merkle.manifest(odd(spark, rows).repartition(3), every=every).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)
    assert any(not r["verified"] for r in got) == any(z[1] and "\n" in z[1] and zlib.crc32(str(z[0]).encode()) % 2 == 0 for z in rows)


@pytest.mark.parametrize("rows", [ODD, [], [(1, "x" * 300_000 + "\n", "en", "a", 1)] * 5])
def test_manifest_of_odd_rows(spark, rows):
    got = merkle.manifest(odd(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("merged", ["true", "false"])
def test_a_source_is_placed_by_many_tasks(spark, merged):
    """A hot source goes to many ranges, and places follow the order all the same."""
    rows = spark.range(3000).selectExpr("'=a' as tree", "cast(2999 - id as long) as id", "sha2(cast(id as string), 256) as node")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, merged)
    try:
        got = merkle.placed(rows.repartition(7), ["id", "node"])
        assert got.where("pos <> id or size <> 3000").count() == 0
        if merged == "false":
            assert rows.repartitionByRange("tree", "id", "node").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset(setting)
