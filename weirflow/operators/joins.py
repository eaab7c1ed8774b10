"""Lookups and joins, exact and fuzzy. Which side is broadcast is left to the optimizer, which knows the sizes."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.graph import connected
from weirflow.sources.shared import kept, spread


def first_by_key(ref: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key, the first by the given columns (all others by default)."""
    by = order or [c for c in ref.columns if c not in keys]
    if len(by) == 1 and isinstance(ref.schema[by[0]].dataType, (T.NumericType, T.DatetimeType, T.BooleanType)):
        # A hash aggregate; nulls come first here, as in a struct.
        least = F.when(F.count(F.lit(1)) == F.count(by[0]), F.min(by[0])).alias(by[0])
        return spread(ref.select(*keys, by[0])).groupBy(*keys).agg(least).select(*keys, by[0])
    top = F.min(F.struct(*[F.col(c) for c in by])).alias("_top") if by else F.lit(0).alias("_top")
    one = ref.groupBy(*keys).agg(top)
    return one.select(*keys, *[F.col(f"_top.{c}") for c in by])


def lookup(df: DataFrame, ref: DataFrame, keys: list[tuple[str, str]], columns: list[tuple[str, str]], no_match: str = "ignore", unique: bool = False) -> dict[str, DataFrame]:
    """Add columns (of the reference, new name) of the first reference row with equal keys.

    ``no_match``: "ignore" leaves nulls in ``match``; "redirect" parts the rows into ``match`` and ``no_match``. A null
    key matches nothing. ``unique`` says that the reference has no key twice.
    """
    names = [r for _, r in keys]
    ref = ref.select(*dict.fromkeys([*names, *[c for c, _ in columns]]))
    if not unique:
        ref = first_by_key(ref, names)
    renamed = ref.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(names)], *[F.col(c).alias(f"_v{i}") for i, (c, _) in enumerate(columns)])
    condition: Column = F.lit(True)
    for i, (c, _) in enumerate(keys):
        condition = condition & (F.col(c) == F.col(f"_k{i}"))
    joined = df.join(renamed, condition, "inner" if no_match == "redirect" else "left")
    taken = {n for _, n in columns}
    match = joined.select(*[df[c] for c in df.columns if c not in taken], *[F.col(f"_v{i}").alias(n) for i, (_, n) in enumerate(columns)])
    out = {"match": match}
    if no_match == "redirect":
        out["no_match"] = df.join(renamed, condition, "left_anti")
    return out


def merge_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Equi-join; ``columns`` are (side, column, new name). Null keys match nothing."""
    kinds = {"inner": "inner", "left": "left", "leftouter": "left", "full": "full", "fullouter": "full"}
    kind = kinds.get(how.lower().replace(" ", "").replace("_", ""))
    if kind is None:
        raise ValueError(f"unknown join type {how}")
    a = left.select(*[F.col(c).alias(f"_l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    condition: Column = F.lit(True)
    for x, y in keys:
        condition = condition & (F.col(f"_l_{x}") == F.col(f"_r_{y}"))
    return a.join(b, condition, kind).select(*[F.col(f"_{side[0]}_{c}").alias(n) for side, c, n in columns])


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def edits(longest: Column, min_similarity: float) -> Column:
    """The most edits that two values may be apart of which the longer has ``longest`` characters."""
    return F.floor(longest * F.lit(1 - min_similarity) + F.lit(1e-9)).cast("int")


def _cut(length: Column, i: Column, min_similarity: float) -> tuple[Column, Column]:
    """Where segment ``i`` of a value begins, and its length: segments are one more than edits, and even but for one."""
    n = edits(length, min_similarity) + 1
    base, longer = F.floor(length / n).cast("int"), (length % n).cast("int")
    late = F.greatest(i - (n - longer), F.lit(0))
    return i * base + late, base + F.when(i >= n - longer, 1).otherwise(0)


def _span(low: Column, high: Column, fn, kind: str = "bigint") -> Column:
    """What ``fn`` makes of each number from ``low`` to ``high``; nothing if there are none."""
    return F.when(low <= high, F.transform(F.sequence(low.cast("int"), high.cast("int")), fn)).otherwise(F.array().cast(f"array<{kind}>"))


def segments(value: Column, min_similarity: float) -> Column:
    """The keys of a value's segments. A value that is as long at most and near enough has one of them as a part."""
    n = F.length(value)

    def key(i: Column) -> Column:
        start, size = _cut(n, i, min_similarity)
        return F.xxhash64(n, i, F.substr(value, start + 1, size))

    return _span(F.lit(0), edits(n, min_similarity), key)


def parts(value: Column, min_similarity: float, shorter: bool) -> Column:
    """The keys of a value's parts that can be segments of a longer value, or with ``shorter`` unset of one as long.

    A part stands where the segments before it and after it leave edits enough: with d edits in all and i segments before
    it, it is shifted by i places at most, and by d - i at most against the other end.
    """
    own = F.length(value)
    longest = F.floor(own / F.lit(min_similarity) + F.lit(1e-9)).cast("int")

    def of_length(length: Column) -> Column:
        most, more = edits(length, min_similarity), length - own

        def of_segment(i: Column) -> Column:
            start, size = _cut(length, i, min_similarity)
            low = F.greatest(F.lit(0), start - F.least(i, more + most - i))
            high = F.least(own - size, start - F.greatest(-i, more - most + i))
            return _span(low, high, lambda at: F.xxhash64(length, i, F.substr(value, at + 1, size)))

        return F.flatten(_span(F.lit(0), most, of_segment, "array<bigint>"))

    return F.array_distinct(F.flatten(_span(own + (1 if shorter else 0), longest, of_length, "array<bigint>")))


def candidates(a: DataFrame, b: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs of ``_value`` of ``a`` and ``_match`` of ``b`` that can be similar enough; a pair may come more than once.

    The longer value of a pair gives its segments, the shorter one its parts, so a pair meets where both share one.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("a least similarity over 0, up to 1, is needed: else all pairs are similar")

    def keyed(df: DataFrame, c: str, long_role: int) -> DataFrame:
        long, short = segments(F.col(c), min_similarity), parts(F.col(c), min_similarity, shorter=long_role == 1)
        role = lambda keys, n: F.transform(keys, lambda k: F.struct(F.lit(n).alias("role"), k.alias("key")))
        return df.select(c, F.explode(F.concat(role(long, long_role), role(short, 1 - long_role))).alias("k")).select(c, "k.role", "k.key")

    return keyed(a, "_value", 0).join(keyed(b, "_match", 1), ["role", "key"]).select("_value", "_match")


def similar(a: DataFrame, b: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs of distinct ``_value`` and ``_match`` that are similar enough, with ``_similarity``."""
    pairs = candidates(a, b, min_similarity)
    scored = pairs.withColumn("_similarity", similarity(F.col("_value"), F.col("_match")))
    return scored.filter(F.col("_similarity") >= min_similarity).distinct()


#: Different ends at which heads are looked up, at best and at most, and the most keys of one head and depth.
FEW_ENDS, MOST_ENDS, HEAD_KEYS = 8, 64, 64


def _cut_place(b: DataFrame) -> tuple[int, bool] | None:
    """After how many characters, and whether from the back, ``_match`` is cut so that few different ends are left."""
    longest = b.agg(F.max(F.length("_match"))).first()[0]
    if longest is None:
        return None
    words = b.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("_match").alias("w")), F.struct(F.lit(True).alias("back"), F.reverse("_match").alias("w")))).alias("x")).select("x.*")
    cuts = words.select("back", "w", F.explode(F.sequence(F.lit(0), F.lit(min(longest, HEAD_KEYS)))).alias("place"))
    ends = cuts.select("back", "place", F.length("w").alias("n"), F.xxhash64(F.substr("w", F.col("place") + 1)).alias("end")).distinct()
    found = ends.groupBy("place", "back").count().filter(F.col("count") <= MOST_ENDS).collect()
    # With few ends a shorter head is better; a long one has too many keys.
    best = min(found, key=lambda r: (r["count"] > FEW_ENDS or comb(r["place"], 2) > HEAD_KEYS, r["place"], r["back"]), default=None)
    return (best["place"], best["back"]) if best else None


def _with_fewer(word: Column, most: int) -> Column:
    """A word, and what is left of it without each one of its characters, up to ``most`` of them."""
    one_less = lambda w: _span(F.lit(1), F.length(w), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)), "string")
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one_less))))
    return out


def block_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of ``_value`` and ``_match`` of one block, with ``_similarity``."""
    return a.join(b, "_block").select("_value", "_match", similarity(F.col("_value"), F.col("_match")).alias("_similarity"))


def nearest(a: DataFrame, b: DataFrame, min_similarity: float, top: int = 1) -> DataFrame:
    """Pairs of ``_value`` and ``_match`` of one ``_block`` with ``_similarity``: of each value the ``top`` best and their ties.

    The reference values are cut into heads and the few different ends that they have, as the name of a table and zeros. An
    edit distance is the sum of two for some place to cut the value. The one to the end is known for every end and place,
    and is most of it where all ends differ from the value's. So few edits are left for the head, which is looked up by
    what is left of both heads without so many characters. A first round seeks what is as near as the ends let it be, the
    next ones an edit more; a value is done when it has found ``top`` that near. Values that leave the head more edits than
    the keys have are held against their whole block.
    """
    cut = _cut_place(b)
    if cut is None:
        return block_pairs(a, b).filter(F.col("_similarity") >= min_similarity)
    place, back = cut
    depth = max(n for n in range(3) if comb(place, n) <= HEAD_KEYS)
    word = lambda c: F.reverse(c) if back else F.col(c)
    parted = b.select("_block", "_match", F.length("_match").alias("n"), F.substr(word("_match"), F.lit(1), F.lit(place)).alias("head"), F.substr(word("_match"), F.lit(place + 1)).alias("end"))
    ends = parted.select("n", "end").distinct().collect()
    index = kept(parted.select("_block", "_match", "n", "end", F.explode(_with_fewer(F.col("head"), depth)).alias("key")), "heads")
    every = F.array(*[F.struct(F.lit(r["n"]).alias("n"), F.lit(r["end"]).alias("end"), F.lit(len(r["end"])).alias("size"), F.lit(min(place, r["n"])).alias("cut")) for r in ends])
    own, size = F.col("_word"), F.col("_size")
    to_end = lambda e, at: F.levenshtein(F.substr(own, at + 1), e["end"])
    longest = lambda e: F.greatest(size, e["n"])

    def tries(e: Column) -> Column:
        """The places to cut a value for one end, and the edits that they leave for the head."""
        far = lambda at: F.abs(at - e["cut"])
        every_place = F.sequence(F.greatest(F.lit(0), e["cut"] - e["most"]), F.greatest(F.lit(0), F.least(size, e["cut"] + e["most"])))
        places = F.filter(every_place, lambda at: (at <= size) & (far(at) + F.abs(size - at - e["size"]) <= e["most"]))
        left = F.transform(places, lambda at: F.struct(e["n"].alias("n"), e["end"].alias("end"), at.alias("at"), (e["most"] - to_end(e, at)).alias("edits")))
        return F.filter(left, lambda x: x["edits"] >= far(x["at"]))

    fields = ("n", "end", "size", "cut")
    costs = F.transform(every, lambda e: F.struct(*[e[f].alias(f) for f in fields], to_end(e, e["cut"]).alias("cost")))
    values = spread(kept(a.select("_block", "_value", word("_value").alias("_word"), F.length("_value").alias("_size")), "values"), 0)
    todo = kept(values.withColumn("_ends", costs), "costs")
    most = lambda e: F.floor((1 - F.col("_least")) * longest(e) + F.lit(1e-9)).cast("int")
    able = F.filter(F.transform("_ends", lambda e: F.struct(*[e[f].alias(f) for f in (*fields, "cost")], most(e).alias("most"))), lambda e: e["cost"] <= e["most"])
    bound = F.array_max(F.transform("_ends", lambda e: 1 - e["cost"] / F.greatest(longest(e), F.lit(1))))
    step = 1 / F.greatest(size, F.lit(max(r["n"] for r in ends)), F.lit(1))
    known, wide = [], []
    for more in range(depth + 1):
        least = spread(todo, 0).withColumn("_least", F.greatest(bound - more * step, F.lit(float(min_similarity))))
        tried = kept(least.withColumn("_tries", F.flatten(F.transform(able, tries))), "tries")
        too_many = F.exists("_tries", lambda x: x["edits"] > depth)
        wide.append(tried.filter(too_many).select("_block", "_value"))
        sought = tried.filter(~too_many)
        probes = sought.select("_block", "_value", "_word", "_least", F.explode("_tries").alias("t")).select("_block", "_value", "_least", "t.n", "t.end", "t.edits", F.substr("_word", F.lit(1), F.col("t.at")).alias("head"))
        keys = F.when(F.col("edits") == 0, F.array("head"))
        for n in range(1, depth + 1):
            keys = keys.when(F.col("edits") == n, _with_fewer(F.col("head"), n))
        probes = probes.withColumn("key", F.explode(keys)).select("_block", "_value", "_least", "n", "end", "key")
        # As files heads are far smaller than in memory, so the optimizer would broadcast them.
        pairs = probes.join(index.hint("merge"), ["_block", "n", "end", "key"]).select("_value", "_match", "_least").distinct()
        scored = pairs.withColumn("_similarity", similarity(F.col("_value"), F.col("_match"))).filter((F.col("_similarity") >= F.col("_least") - 1e-12) & (F.col("_similarity") >= min_similarity))
        counted = scored.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_value")))
        hits = kept(counted.filter((F.col("_n") >= top) | (F.col("_least") <= min_similarity)).select("_value", "_match", "_similarity"), "hits")
        known.append(hits)
        open_ = sought.filter(F.col("_least") > min_similarity).join(hits.select("_value").distinct(), "_value", "left_anti")
        todo = kept(open_.select("_block", "_value", "_word", "_size", "_ends"), "costs")
        if todo.isEmpty():
            break
    wide.append(todo.select("_block", "_value"))
    out = known[0]
    for hits in known[1:]:
        out = out.unionByName(hits)
    rest = wide[0]
    for more in wide[1:]:
        rest = rest.unionByName(more)
    rest = kept(rest, "rest")
    if rest.isEmpty():
        return out
    return out.unionByName(block_pairs(spread(rest, 0), b).filter(F.col("_similarity") >= min_similarity))


def fuzzy_lookup(df: DataFrame, ref: DataFrame, column: str, ref_column: str, block=None, ref_block=None, min_similarity: float = 0.5, top: int = 1) -> DataFrame:
    """The most similar reference values of each row: ``_match``, ``_similarity``.

    Every value is held against every reference value that shares a segment with it, which all do that are similar enough.
    Where ``block`` makes a block's name from a value, only values of one block are compared, see ``nearest``. Equal values
    are looked up once and all their rows stay. Null values match nothing; ties go to the smaller value.
    """
    a = df.select(F.col(column).alias("_value")).filter("_value IS NOT NULL").distinct()
    b = ref.select(F.col(ref_column).alias("_match")).filter("_match IS NOT NULL").distinct()
    if block:
        scored = nearest(a.withColumn("_block", block(F.col("_value"))), b.withColumn("_block", (ref_block or block)(F.col("_match"))), min_similarity, top)
    else:
        scored = similar(a, b, min_similarity)
    best = Window.partitionBy("_value").orderBy(F.desc("_similarity"), "_match")
    found = scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top).drop("_n")
    return df.join(found, F.col(column) == F.col("_value")).drop("_value")


def fuzzy_grouping(df: DataFrame, column: str, min_similarity: float = 0.8) -> DataFrame:
    """``_group_key``, ``_group_id``, ``_canonical`` and ``_similarity``, that of a row's value to the canonical one.

    Values belong together if a chain of values leads from one to the other, each as similar to the next as
    ``min_similarity``. A group's key is its smallest value, its id a hash of that, its canonical value the one that most
    rows have, of equally frequent ones the smallest. Rows without a value have nulls.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    counts = kept(counts, "values")
    values = counts.select("_value")
    pairs = similar(values, values.withColumnRenamed("_value", "_match"), min_similarity).filter("_value < _match")
    groups = connected(pairs, "_value", "_match")
    named = counts.join(groups, F.col("_value") == F.col("node"), "left").select("_value", "_n", F.coalesce("component", "_value").alias("_group_key"))
    named = kept(named, "groups")
    heads = named.groupBy(F.col("_group_key").alias("_key")).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_value")).alias("_head"))
    known = named.join(heads, F.col("_group_key") == F.col("_key")).select("_value", "_group_key", F.col("_head._value").alias("_canonical"))
    out = df.join(known, F.col(column) == F.col("_value"), "left").drop("_value")
    return out.withColumns({"_group_id": F.when(F.col("_group_key").isNotNull(), F.xxhash64("_group_key")), "_similarity": similarity(F.col(column), F.col("_canonical"))})


def _seconds(df: DataFrame, column: str) -> Column:
    """A number as it is; a time in microseconds' exactness as seconds."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(f"`{column}`").cast("timestamp").cast("double")
    return F.col(f"`{column}`")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str], width: float, tolerance: float | None = None) -> DataFrame:
    """The left rows with ``columns`` of the last right row of their keys that is not later, nulls if there is none.

    Times are timestamps or numbers; ``tolerance`` is how much earlier the right row may be, in seconds or units. Of right rows
    with equal keys and times the largest by ``columns`` counts. Rows without a time find nothing, keys meet as SQL has it.

    Both sides are put in one order by key and time. To keep a hot key out of one task, time is cut into bins of ``width``:
    inside a bin the last right row goes on to those after it, and each bin starts with the last row of the bins before it.
    """
    number = _seconds
    bin_of = lambda c: F.floor(c.cast("double") / F.lit(float(width)))
    names = [f"_k{i}" for i in range(len(keys))]
    key_of = lambda: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]
    able: Column = F.col("_t").isNotNull()
    for n in names:
        able = able & F.col(n).isNotNull()
    a = left.select(*key_of(), number(left, at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    b = right.select(*key_of(), number(right, right_at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_new")).filter(able)
    last = b.groupBy(*names, bin_of(F.col("_t")).alias("_bin")).agg(F.max(F.struct("_t", "_new")).alias("_last"))
    bins = a.filter(able).select(*names, bin_of(F.col("_t")).alias("_bin")).distinct()
    order = Window.partitionBy(*names).orderBy("_bin")
    # A row for each bin that has rows: what the bins before it leave.
    both = bins.join(last, [*names, "_bin"], "full")
    carried = both.withColumn("_carry", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    starts = carried.filter("_carry IS NOT NULL").select(*names, "_bin", F.col("_carry._t").alias("_t"), F.lit(0).alias("_side"), F.col("_carry._new").alias("_new"), F.col("_carry._t").alias("_from"))
    inside = Window.partitionBy(*names, "_bin").orderBy("_t", "_side", "_new").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.withColumns({"_bin": bin_of(F.col("_t")), "_side": F.lit(2)})
    changes = b.withColumns({"_bin": bin_of(F.col("_t")), "_side": F.lit(1), "_from": F.col("_t")})
    every = rows.filter(able).unionByName(changes, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    found = every.withColumn("_hit", F.last(F.when(F.col("_side") < 2, F.struct("_from", "_new")), ignorenulls=True).over(inside)).filter("_side = 2")
    near = F.col("_hit").isNotNull() if tolerance is None else (F.col("_t") - F.col("_hit._from") <= F.lit(tolerance))
    hit = found.select("_row", F.when(near, F.col("_hit._new")).alias("_new"))
    none = a.filter(~F.coalesce(able, F.lit(False))).select("_row", F.lit(None).cast(b.schema["_new"].dataType).alias("_new"))
    taken = {c.lower() for c in columns}
    return hit.unionByName(none).select(*[F.col(f"_row.`{c}`") for c in left.columns if c.lower() not in taken], *[F.col(f"_new.`{c}`") for c in columns])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, columns: list[str], width: float, how: str = "inner") -> DataFrame:
    """The left rows with ``columns`` of each right row of their keys whose interval, from ``start`` up to ``end``, has their time.

    A null end is open. Time is cut into bins of ``width`` (seconds, or units of numbers): an interval stands in each bin that
    it touches between the first and the last time of the left rows, and rows meet by key and bin. So the join is an equi-join,
    whose hot keys adaptive execution splits. ``how`` is inner or left.
    """
    number = lambda df, c: _seconds(df, c).cast("double")
    bin_of = lambda c: F.floor(c / F.lit(float(width)))
    low, high = left.agg(F.min(number(left, at)), F.max(number(left, at))).first()
    names = [f"_k{i}" for i in range(len(keys))]
    a = left.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], number(left, at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    b = right.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], number(right, start).alias("_s"), number(right, end).alias("_e"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_new"))
    first, last = F.greatest(F.col("_s"), F.lit(low)), F.least(F.coalesce("_e", F.lit(high)), F.lit(high))
    b = b.filter((first <= last) if low is not None else F.lit(False)).withColumn("_bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    a = a.withColumn("_bin", bin_of(F.col("_t")))
    condition: Column = (F.col("a._bin") == F.col("b._bin")) & (F.col("a._t") >= F.col("b._s")) & (F.col("b._e").isNull() | (F.col("a._t") < F.col("b._e")))
    for n in names:
        condition = condition & (F.col(f"a.{n}") == F.col(f"b.{n}"))
    taken = {c.lower() for c in columns}
    return a.alias("a").join(b.alias("b"), condition, how).select(*[F.col(f"a._row.`{c}`") for c in left.columns if c.lower() not in taken], *[F.col(f"b._new.`{c}`") for c in columns])


SEPARATOR = "[^\\p{L}\\p{N}]+"


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def term_lookup(df: DataFrame, terms: DataFrame, column: str, term_column: str, key: str) -> DataFrame:
    """(key, term, frequency): how often each term, a word or a phrase, stands in a row's text, case apart.

    Runs of as many words as some term has are joined to the terms, so no pair of text and term is tried that shares none.
    """
    known = terms.select(F.col(term_column).alias("term"), F.array_join(text_words(F.col(term_column)), " ").alias("_gram")).filter("_gram <> ''").distinct()
    lengths = sorted(r[0] for r in known.select(F.size(F.split("_gram", " "))).distinct().collect()) or [1]
    words = df.select(F.col(key), text_words(F.col(column)).alias("_w"))
    some = F.concat(*[F.when(F.size("_w") >= n, _grams(n)).otherwise(F.array().cast("array<string>")) for n in lengths])
    grams = words.select(key, F.explode(some).alias("_gram")).groupBy(key, "_gram").agg(F.count(F.lit(1)).alias("frequency"))
    return grams.join(known, "_gram").select(key, "term", "frequency")


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))


def term_extraction(df: DataFrame, column: str, min_frequency: int = 2, min_length: int = 2) -> DataFrame:
    """(term, frequency, documents) of the words of all texts."""
    words = spread(df.select(column)).select(F.split(F.lower(F.col(column)), SEPARATOR).alias("_w"))
    # Every word, then once more each that the text has: one pass with partial sums, so only terms are shuffled.
    every = words.select(F.posexplode(F.concat("_w", F.array_distinct("_w"))).alias("k", "term"), F.size("_w").alias("n"))
    own = (F.col("k") < F.col("n")).cast("long")
    counts = every.filter(F.length("term") >= max(1, min_length)).groupBy("term").agg(F.sum(own).alias("frequency"), F.sum(1 - own).alias("documents"))
    return counts.filter(F.col("frequency") >= min_frequency)
