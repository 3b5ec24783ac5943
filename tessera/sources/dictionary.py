"""Dictionaries: lookups of a key in a small table, as joins whose size is checked, or as a literal map if it is tiny."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_if_small

LAYOUTS = ("flat", "hashed", "sparse_hashed", "complex_key_hashed", "range_hashed", "cache", "ip_trie", "direct")
#: Rows up to which ``literal`` makes a map.
LITERAL = 10_000


@dataclass(frozen=True)
class Dictionary:
    """``keys`` identify a row of ``source``; ``parent`` names the key of the row above; a ``range_hashed`` one has validity
    bounds (``low``, ``high``, both included); an ``ip_trie`` one has CIDR prefixes as its key."""

    name: str
    source: DataFrame
    keys: tuple[str, ...]
    layout: str = "hashed"
    low: str | None = None
    high: str | None = None
    parent: str | None = None
    lifetime: tuple[int, int] = (0, 0)

    def _side(self) -> DataFrame:
        """One row of each key."""
        unique = [*self.keys, *([self.low, self.high] if self.layout == "range_hashed" else [])]
        return broadcast_if_small(self.source.dropDuplicates(unique))

    def lookup(self, df: DataFrame, on: list[str] | str, select: list[str] | dict[str, str], defaults: dict[str, Any] | None = None, at: str | None = None, found: str | None = None) -> DataFrame:
        """``df`` with attributes of the row of its key, null or the default on a miss; ``found`` names a flag. ``at`` is the
        column that a range dictionary's bounds hold."""
        on = [on] if isinstance(on, str) else on
        names = select if isinstance(select, dict) else {c: c for c in select}
        if self.layout == "ip_trie":
            return self._by_prefix(df, on[0], names, defaults or {}, found)
        side = self._side()
        packed = side.select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(self.keys)], *([F.col(self.low).alias("_low"), F.col(self.high).alias("_high")] if self.layout == "range_hashed" else []), F.struct(*[F.col(c) for c in names]).alias("_row"))
        same = F.lit(True)
        for i, k in enumerate(on):
            same = same & (df[k] == F.col(f"_d{i}"))
        if self.layout == "range_hashed":
            if at is None:
                raise ValueError("a range dictionary is looked up at a column")
            same = same & df[at].between(F.col("_low"), F.col("_high"))
        return self._finish(df.join(broadcast_if_small(packed), same, "left"), df.columns, names, defaults or {}, found)

    def _finish(self, joined: DataFrame, columns: list[str], names: dict[str, str], defaults: dict[str, Any], found: str | None) -> DataFrame:
        made = []
        for c, to in names.items():
            x = F.col("_row")[c]
            made.append((F.when(F.col("_row").isNull(), F.lit(defaults[c])).otherwise(x) if c in defaults else x).alias(to))
        flag = [F.col("_row").isNotNull().alias(found)] if found else []
        return joined.select(*[F.col(f"`{c}`") for c in columns], *made, *flag)

    def get(self, df: DataFrame, on: list[str] | str, attribute: str, to: str | None = None, at: str | None = None) -> DataFrame:
        return self.lookup(df, on, {attribute: to or attribute}, at=at)

    def get_or_default(self, df: DataFrame, on: list[str] | str, attribute: str, default: Any, to: str | None = None, at: str | None = None) -> DataFrame:
        return self.lookup(df, on, {attribute: to or attribute}, {attribute: default}, at=at)

    def has(self, df: DataFrame, on: list[str] | str, to: str = "has", at: str | None = None) -> DataFrame:
        return self.lookup(df, on, [], found=to, at=at) if self.layout != "ip_trie" else self.lookup(df, on, [], found=to)

    def get_children(self, df: DataFrame, on: str, to: str = "children") -> DataFrame:
        """An array of the keys right below, empty if there are none."""
        if not self.parent:
            raise ValueError(f"{self.name} has no parent column")
        lists = self.source.where(F.col(self.parent).isNotNull()).groupBy(F.col(self.parent).alias("_p")).agg(F.array_sort(F.collect_set(self.keys[0])).alias(to))
        out = df.join(broadcast_if_small(lists), df[on] == F.col("_p"), "left").drop("_p")
        return out.withColumn(to, F.coalesce(F.col(to), F.array().cast(out.schema[to].dataType)))

    def get_ancestor(self, df: DataFrame, on: str, level: int, to: str = "ancestor") -> DataFrame:
        """The key ``level - 1`` steps up: level 1 is the key itself. Null above the root."""
        if not self.parent:
            raise ValueError(f"{self.name} has no parent column")
        if level < 1:
            raise ValueError("levels count from 1")
        up = broadcast_if_small(self.source.select(F.col(self.keys[0]).alias("_k"), F.col(self.parent).alias("_p")).dropDuplicates(["_k"]))
        out = df.join(up, df[on] == F.col("_k"), "left").withColumn(to, F.col("_k")).drop("_k", "_p")
        for _ in range(level - 1):
            out = out.join(up, F.col(to) == F.col("_k"), "left").withColumn(to, F.col("_p")).drop("_k", "_p")
        return out

    def _by_prefix(self, df: DataFrame, on: str, names: dict[str, str], defaults: dict[str, Any], found: str | None) -> DataFrame:
        """The longest prefix that holds the address, of IPv4 or IPv6: an equality join for each prefix length that occurs (129
        at most), on the address's own prefix of that length."""
        parts = F.split(F.col(self.keys[0]), "/")
        net, given = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int")
        size = F.when(net.contains(":"), F.coalesce(given, F.lit(128))).otherwise(F.coalesce(given, F.lit(32)) + 96)
        side = self.source.select(ip_bits(net).alias("_net"), size.alias("_len"), F.struct(*[F.col(c) for c in names]).alias("_attrs"))
        side = side.where("_net is not null and _len between 0 and 128").withColumn("_net", F.left("_net", F.col("_len")))
        sizes = sorted(r["_len"] for r in side.select("_len").distinct().collect())
        asked = df.select(F.col(on).alias("_ip")).distinct().withColumn("_bits", ip_bits(F.col("_ip")))
        asked = asked.where("_bits is not null").withColumn("_l", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
        hits = asked.join(broadcast_if_small(side), (F.left("_bits", F.col("_l")) == F.col("_net")) & (F.col("_l") == F.col("_len")))
        best = hits.groupBy("_ip").agg(F.max_by("_attrs", "_len").alias("_row"))
        return self._finish(df.join(best, df[on] == F.col("_ip"), "left"), df.columns, names, defaults, found)

    def literal(self, key: Column, attribute: str, default: Any = None) -> Column:
        """A column expression, for dictionaries of one key and up to ``LITERAL`` rows, which are collected."""
        rows = self.source.select(self.keys[0], attribute).dropDuplicates([self.keys[0]]).limit(LITERAL + 1).collect()
        if len(rows) > LITERAL:
            raise ValueError(f"{self.name} has too many rows for a literal map")
        made = F.create_map(*[F.lit(v) for r in rows for v in r])
        return F.coalesce(F.try_element_at(made, key), F.lit(default))

    def to_sql(self) -> str:
        body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.source.schema.fields)
        return f"CREATE DICTIONARY {self.name} ({body}) PRIMARY KEY {', '.join(self.keys)} LAYOUT({self.layout.upper()}) LIFETIME(MIN {self.lifetime[0]} MAX {self.lifetime[1]})"


def ip_number(text: Column) -> Column:
    """An IPv4 address as a whole number, null if it isn't one."""
    parts = F.split(text, r"\.")
    n = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    ok = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*n) <= 255)
    return F.when(ok, n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def ip_bits(text: Column) -> Column:
    """The 128 binary digits of an address, that of IPv4 mapped into IPv6; null if it is neither."""
    plain = ip_number(text)
    four = F.concat(F.repeat(F.lit("0"), 80), F.repeat(F.lit("1"), 16), F.lpad(F.bin(plain), 32, "0"))
    # An IPv4 address at the end stands for two groups.
    tail = F.regexp_extract(text, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    digits = F.lpad(F.hex(ip_number(tail)), 8, "0")
    whole = F.when(tail != "", F.concat(F.left(text, F.length(text) - F.length(tail)), F.left(digits, F.lit(4)), F.lit(":"), F.right(digits, F.lit(4)))).otherwise(text)
    halves = F.split(F.lower(whole), "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    head, end = groups(0), groups(1)
    missing = F.lit(8) - F.size(head) - F.size(end)
    every = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), end)
    ok = text.contains(":") & (F.size(halves) <= 2) & ~whole.rlike(r":::|^:[^:]|[^:]:$") & ((missing == 0) & (F.size(halves) == 1) | (missing >= 1) & (F.size(halves) == 2)) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    six = F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.when(plain.isNotNull(), four).when(ok, six)


def dictionary(name: str, source: DataFrame | str, keys: list[str] | str, *, spark: SparkSession | None = None, layout: str = "hashed", **options: Any) -> Dictionary:
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    source = spark.table(source) if isinstance(source, str) else source
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    lost = [c for c in [*keys, *[options[o] for o in ("low", "high", "parent") if options.get(o)]] if c not in source.columns]
    if lost:
        raise ValueError(f"{name}: no column {', '.join(lost)}")
    if layout == "range_hashed" and not (options.get("low") and options.get("high")):
        raise ValueError(f"{name}: a range dictionary needs low and high")
    return Dictionary(name, source, keys, layout, **options)
