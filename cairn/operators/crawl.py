"""The crawl frontier as table operators: robots rules, throttling, conditional headers, attempt chains."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..sources.tables import scratch, staged

#: URLs of an origin that one task decides, and requests of a host that one task puts in a row.
URL_BLOCK, REQUEST_BLOCK = 200_000, 100_000
#: Origins of several tasks are broadcast up to so many.
BROADCAST_ORIGINS = 200_000


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, rule_no, path, allow: the rules for the agent of each robots text (origin, body); the group that names
    the agent goes before the one for all. A null body has no rules."""
    name = agent.split("/")[0].lower()

    def groups(body: str) -> list[tuple[list[str], list[tuple[str, bool]]]]:
        out, agents, rules = [], [], []
        for line in [*body.splitlines(), None]:
            field, _, value = (line or "").split("#")[0].partition(":")
            field, value = field.strip().lower(), value.strip()
            if line is None or (field == "user-agent" and rules):
                if agents:
                    out.append((agents, rules))
                agents, rules = [], []
            if field == "user-agent":
                agents.append(value.lower())
            elif field in ("allow", "disallow") and agents:
                # an empty disallow allows all
                rules.append((unquote(value), field == "allow" or not value))
        return out

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for origin, body in zip(f["origin"], f["body"], strict=True):
                found = groups(body or "")
                mine = next((r for a, r in found if any(x != "*" and x in name for x in a)), None)
                if mine is None:
                    mine = next((r for a, r in found if "*" in a), [])
                rows += [(origin, i, path, allow) for i, (path, allow) in enumerate(mine)]
            yield pd.DataFrame(rows, columns=["origin", "rule_no", "path", "allow"])

    return robots.select("origin", "body").mapInPandas(parse, "origin string, rule_no int, path string, allow boolean")


@F.pandas_udf(StructType().add("origin", StringType()).add("path", StringType()))
def split_url(url: pd.Series) -> pd.DataFrame:
    parts = [urlsplit(u or "") for u in url]
    path = [unquote(p.path or "/") + ("?" + p.query if p.query else "") for p in parts]
    return pd.DataFrame({"origin": [f"{p.scheme}://{p.netloc}" for p in parts], "path": path})


def _first_rules(rules: Iterable[tuple[int, str, bool]]) -> dict:
    """The rules' paths as a trie: a node's children by character, and under "" the number and verdict of its first rule."""
    root: dict = {}
    for no, path, allow in rules:
        node = root
        for ch in path:
            node = node.setdefault(ch, {})
        node[""] = min((no, allow), node.get("", (no, allow)))
    return root


def _verdict(root: dict, path: str) -> bool:
    """The first rule, by number, among those that the path begins with; true without one."""
    node, found = root, root.get("")
    for ch in path:
        node = node.get(ch)
        if node is None:
            break
        own = node.get("")
        if own is not None and (found is None or own < found):
            found = own
    return found is None or found[1]


def _decided(key: tuple, urls: pa.Table, rules: pa.Table) -> pa.Table:
    root = _first_rules(zip(*(rules.column(c).to_pylist() for c in ("rule_no", "path", "allow")), strict=True))
    return pa.table({"__url": urls.column("url"), "__allowed": pa.array([_verdict(root, p) for p in urls.column("at").to_pylist()], pa.bool_())})


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, block: int = URL_BLOCK) -> DataFrame:
    """Adds `allowed`: by the first rule of the origin that the path begins with; true without one.

    Distinct URLs are decided and joined back, so repeated ones stay. An origin's rules are a trie that each URL walks once;
    an origin of more than `block` URLs is several tasks, each with the trie.
    """
    split = urls.select("url").distinct().withColumn("__p", split_url("url")).select("url", F.col("__p.origin").alias("origin"), F.col("__p.path").alias("at"))
    busy = split.groupBy("origin").agg(F.ceil(F.count("*") / block).cast("int").alias("tiles")).where("tiles > 1")
    few = busy.count() <= BROADCAST_ORIGINS
    near = lambda df: F.broadcast(df) if few else df
    placed = split.join(near(busy), "origin", "left").select("url", "origin", "at", F.pmod(F.xxhash64("url"), F.coalesce("tiles", F.lit(1))).cast("int").alias("tile"))
    rules = robots_rules(robots, agent).withColumnRenamed("origin", "of").join(near(busy.select(F.col("origin").alias("of"), F.col("tiles").alias("all"))), "of", "left")
    rules = rules.select("of", "rule_no", "path", "allow", F.explode(F.sequence(F.lit(0), F.coalesce("all", F.lit(1)) - 1)).alias("part"))
    decided = placed.groupBy("origin", "tile").cogroup(rules.groupBy("of", "part")).applyInArrow(_decided, StructType([StructField("__url", StringType()), StructField("__allowed", BooleanType())]))
    return urls.join(decided, F.col("url").eqNullSafe(F.col("__url"))).withColumn("allowed", F.col("__allowed")).select(*urls.columns, "allowed")


def throttle(requests: DataFrame, host: str, ts: str, order: str, interval_s: float = V.HOST_INTERVAL_S, block: int = REQUEST_BLOCK) -> DataFrame:
    """Adds slot_us: the microsecond at which each request may start, a host's at least an interval apart, none dropped.

    With requests of a host numbered n by time, the running maximum of t - n * interval, plus
    n * interval, is what waiting one by one gives. Both are associative: requests are sorted by ranges of (host, time,
    order), numbers and maxima are taken inside blocks of at most `block` rows, and carried over from block to block by
    each block's count and maximum. So a host of any number of requests, at one time too, is many tasks. The sorted rows are
    written once in the shared folder, for blocks must not change between their summary and their use.
    """
    step = int(interval_s * 1_000_000)
    rows = requests.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.repartitionByRange(host, ts, order).sortWithinPartitions(host, ts, order).withColumn("__at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("__b", F.floor(F.col("__at") / block)), scratch(requests.sparkSession))
    inside = Window.partitionBy(host, "__b").orderBy("__at")
    rows = rows.withColumn("__n", F.row_number().over(inside).cast("long") * step).withColumn("__s", F.col("__t") - F.col("__n"))
    blocks = rows.groupBy(host, "__b").agg(F.count("*").alias("__c"), F.max("__s").alias("__m"))
    before = Window.partitionBy(host).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__base", F.coalesce(F.sum("__c").over(before), F.lit(0)) * step)
    blocks = blocks.withColumn("__low", F.max(F.col("__m") - F.col("__base")).over(before)).select(F.col(host).alias("__h"), F.col("__b").alias("__k"), "__base", "__low")
    both = rows.withColumn("__r", F.max("__s").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(blocks, F.col(host).eqNullSafe(F.col("__h")) & (F.col("__b") == F.col("__k")))
    slot = F.greatest(F.col("__low"), F.col("__r") - F.col("__base")) + F.col("__base") + F.col("__n")
    return both.select(*requests.columns, slot.alias("slot_us"))


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """Map of the headers whose validator is there and not empty."""
    return F.map_filter(F.create_map(F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), last_modified), lambda _, v: v.isNotNull() & (v != ""))


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """request_id, tier, status_code: the first attempt by tier whose status is neither 429 nor 404, else the last one."""
    one = F.struct("tier", "status_code")
    decides = ~F.col("status_code").isin(429, 404)
    found = attempts.groupBy("request_id").agg(F.coalesce(F.min_by(F.when(decides, one), F.when(decides, F.col("tier"))), F.max_by(one, "tier")).alias("a"))
    return found.select("request_id", "a.tier", "a.status_code")
