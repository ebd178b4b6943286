"""Name resolution: exact normalised-name lookup, then a lossless blocked similarity join.

Similarity ≥ t means at most k = ⌊(1−t)·longest⌋ edits. A name of length l is cut into
K(l)+1 disjoint pieces, K(l) being the largest k any admissible partner allows; K edits can
damage at most K pieces, so a partner contains at least one piece unchanged near its place
(the partition scheme of Li, Deng, Wang, Feng: Pass-Join, PVLDB 2011). Matching pieces is an
equi-join on a 64-bit block key; candidates are verified with ``levenshtein``.

Pieces many names share would make a block quadratic. Names holding such a piece are cut into
K+3 pieces instead, of which at least three stay unchanged, and every three pieces of a name make a
key. Three pieces together are far rarer than one (a first name that many share fills two at most
of them), so the hot block splits without losing a pair.
The counts that decide this stay in a joined table; nothing is collected or capped. Only probes that hold a
piece of such a name are cut in threes: a name similar to it must hold one.

Pieces are joined by sort-merge: their number is many times what the size of the names says, so that a planner which
goes by sizes would send them to every task.

Only distinct names enter; candidate pairs are reduced per (probe, score) before the top two
scores of a probe are looked at, so no list of candidates is ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import similarity
from attestor.operators.identity import IdentityIndex
from attestor.operators.skew import fits_broadcast
from attestor.session import write_through

_EPS = 1e-9
NAME_COLUMNS = ("name_key", "holders", "sot_ord")


@dataclass(frozen=True)
class FuzzyRules:
    """``threshold`` and ``gap`` as the reviewers know them; ``hot_block`` tunes the plan only."""

    threshold: float = 0.85
    gap: float = 0.10
    hot_block: int = 1000


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def max_edits(longest: Column, rules: FuzzyRules) -> Column:
    return _floor(longest * F.lit(1.0 - rules.threshold) + F.lit(_EPS))


def _edits_of_indexed(length: Column, rules: FuzzyRules) -> Column:
    return max_edits(_floor(length / F.lit(rules.threshold) + F.lit(_EPS)), rules)


def _piece_start(i: Column, length: Column, pieces: Column) -> Column:
    return _floor(i * length / pieces)


def _pieces(rows: DataFrame) -> DataFrame:
    """One row per piece of an index name of length ``l`` with ``edits`` allowed: i, start, size."""
    return (
        rows.withColumn("count", F.col("edits") + 1)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .withColumn("start", _piece_start(F.col("i"), F.col("l"), F.col("count")))
        .withColumn("size", _piece_start(F.col("i") + 1, F.col("l"), F.col("count")) - F.col("start"))
    )


def _piece_triples(rows: DataFrame) -> DataFrame:
    """One row per three pieces i < j < m of an index name cut into ``edits`` + 3 pieces: their starts s, t, u and ends."""
    place = lambda i: _piece_start(i, F.col("l"), F.col("count"))
    return (
        rows.withColumn("count", F.least(F.col("l"), F.col("edits") + 3))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 3)))
        .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("count") - 2)))
        .withColumn("m", F.explode(F.sequence(F.col("j") + 1, F.col("count") - 1)))
        .withColumns({n: place(F.col(c)) for n, c in (("s", "i"), ("t", "j"), ("u", "m"))})
        .withColumns({f"{n}_end": place(F.col(c) + 1) for n, c in (("s", "i"), ("t", "j"), ("u", "m"))})
    )


def _block_key(text: Column) -> Column:
    return F.xxhash64(F.lit(0), F.col("l"), F.col("i"), text)


def _triple_key(name: str, shifts: tuple) -> Column:
    cut = [F.substring(name, F.col(n) + x + 1, F.col(f"{n}_end") - F.col(n)) for n, x in zip("stu", shifts)]
    return F.xxhash64(F.lit(1), F.col("l"), F.col("i"), F.col("j"), F.col("m"), *cut)


def _full_width(df: DataFrame, key: str) -> DataFrame:
    """Names are few bytes but expand many-fold: keep all tasks busy, whatever the byte size."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if fits_broadcast(df):
        tasks = min(tasks, spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def _indexed_names(names: DataFrame, rules: FuzzyRules) -> DataFrame:
    rows = names.select(*NAME_COLUMNS, F.char_length("name_key").alias("l"))
    return rows.withColumn("edits", _edits_of_indexed(F.col("l"), rules)).where("edits > 0")


def _indexed_blocks(names: DataFrame, rules: FuzzyRules) -> DataFrame:
    """(name_key, holders, sot_ord, block) of every piece of every index name."""
    text = F.substring("name_key", F.col("start") + 1, F.col("size"))
    return _pieces(_indexed_names(names, rules)).select(*NAME_COLUMNS, _block_key(text).alias("block"))


def _indexed_triples(names: DataFrame, rules: FuzzyRules) -> DataFrame:
    """(name_key, holders, sot_ord, block) of every three pieces of every index name."""
    zero = (F.lit(0),) * 3
    return _piece_triples(_indexed_names(names, rules)).select(*NAME_COLUMNS, _triple_key("name_key", zero).alias("block"))


def _probe_lengths(probes: DataFrame, rules: FuzzyRules) -> DataFrame:
    """One row per probe and admissible length of an index name."""
    p, length = F.col("p"), F.col("l")
    return (
        probes.select("probe", F.char_length("probe").alias("p"))
        .withColumn(
            "l",
            F.explode(
                F.sequence(
                    F.ceil(p * F.lit(rules.threshold) - F.lit(_EPS)).cast("int"),
                    _floor(p / F.lit(rules.threshold) + F.lit(_EPS)),
                )
            ),
        )
        .withColumns({
            "edits": _edits_of_indexed(length, rules),
            "k": max_edits(F.greatest(length, p), rules),
            "delta": p - length,
        })
        .where("k > 0 and edits > 0")
    )


def _probe_blocks(probes: DataFrame, rules: FuzzyRules) -> DataFrame:
    """(probe, block) for every place a probe can meet an admissible index name.

    For an index name of length l and a shift x of a piece, |x| edits are needed left of the
    piece and |delta - x| right of it (delta = length difference), so their sum must not exceed
    the pair's k. Piece i also has at most i pieces' worth of edits to its left and
    ``edits - i`` to its right.
    """
    p, delta, right = F.col("p"), F.col("delta"), F.col("edits") - F.col("i")
    low = F.greatest(-_floor((F.col("k") - delta) / 2), -F.col("start"), -F.col("i"), delta - right)
    high = F.least(_floor((F.col("k") + delta) / 2), p - F.col("size") - F.col("start"), F.col("i"), delta + right)
    text = F.substring("probe", F.col("start") + F.col("x") + 1, F.col("size"))
    return (
        _pieces(_probe_lengths(probes, rules))
        .withColumns({"low": low, "high": high})
        .where("low <= high")
        .withColumn("x", F.explode(F.sequence("low", "high")))
        .select("probe", _block_key(text).alias("block"))
    )


def _probe_triples(probes: DataFrame, rules: FuzzyRules) -> DataFrame:
    """(probe, block) for every three places at which a probe can hold three pieces of an index name.

    Shifts x, y and z of the pieces need |x| edits before the first, |y - x| and |z - y| between
    them and |delta - z| after the last: at most k in all.
    """
    p, k, x, y, z = (F.col(c) for c in ("p", "k", "x", "y", "z"))
    rows = _piece_triples(_probe_lengths(probes, rules))
    spent, last = F.lit(0), F.lit(0)
    for n, shift in zip("stu", "xyz"):
        # Shifts of the earlier pieces have spent some edits already; pieces stay inside the probe.
        low, high = F.greatest(last - (k - spent), -F.col(n)), F.least(last + (k - spent), p - F.col(f"{n}_end"))
        rows = rows.withColumns({"low": low, "high": high}).where("low <= high").withColumn(shift, F.explode(F.sequence("low", "high")))
        spent, last = spent + F.abs(F.col(shift) - last), F.col(shift)
    rows = rows.where(spent + F.abs(F.col("delta") - z) <= k)
    return rows.select("probe", _triple_key("probe", (x, y, z)).alias("block"))


def candidate_pairs(probes: DataFrame, names: DataFrame, rules: FuzzyRules = FuzzyRules()) -> DataFrame:
    """(probe, name_key, holders, sot_ord, score) for every pair at or above the threshold, once.

    ``probes``: distinct column ``probe``; ``names``: distinct ``name_key`` with the number of
    its holders and the first holder's ``sot_ord``.
    """
    probes = _full_width(probes.select("probe"), "probe")
    single, sought = _indexed_blocks(names, rules), _probe_blocks(probes, rules)
    hot = single.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.hot_block).select("block")
    crowded = write_through(single.join(hot, "block", "left_semi").select("name_key").distinct(), "crowded-names")
    if crowded.isEmpty():
        return verified(meet(sought, single).select("probe", *NAME_COLUMNS), NAME_COLUMNS, rules)
    pairs = meet(sought, single.join(crowded, "name_key", "left_anti"))
    near = near_crowded(sought, single.join(crowded, "name_key", "left_semi"))
    triple = _indexed_triples(names.join(crowded, "name_key", "left_semi"), rules)
    pairs = pairs.select("probe", *NAME_COLUMNS).unionByName(meet(_probe_triples(near, rules), triple).select("probe", *NAME_COLUMNS))
    return verified(pairs, NAME_COLUMNS, rules)


def meet(sought: DataFrame, index: DataFrame, how: str = "inner") -> DataFrame:
    """Join on block keys, never by broadcast: see the head of this module."""
    return sought.join(index.hint("merge"), "block", how)


def near_crowded(sought: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct probes of ``sought`` (probe, block) that hold a piece of a crowded name, whose pieces are ``blocks``."""
    return meet(sought, blocks.select("block").distinct(), "left_semi").select("probe").distinct()


def verified(pairs: DataFrame, columns: tuple[str, ...], rules: FuzzyRules) -> DataFrame:
    """Distinct (probe, columns, score) of the pairs at or above the threshold, equal names left out."""
    a, b = F.col("probe"), F.col("name_key")
    k = max_edits(F.greatest(F.char_length(a), F.char_length(b)), rules)
    # levenshtein(a, b, k) stops early and returns -1 beyond k; the score test repeats the
    # rule's own double arithmetic.
    near = pairs.where((a != b) & (F.call_function("levenshtein", a, b, k) >= 0))
    return (
        near.groupBy("probe", *columns)
        .agg(F.first(similarity(a, b)).alias("score"))
        .where(F.col("score") >= rules.threshold)
    )


def decide(pairs: DataFrame, rules: FuzzyRules = FuzzyRules()) -> DataFrame:
    """Best name per probe and whether it wins clearly.

    ``pairs``: the output of ``candidate_pairs``. The gap is taken between records, so a best name with two holders is ambiguous. A probe has at most
    a few dozen distinct scores, which is what the second aggregation collects.
    """
    by_score = pairs.groupBy("probe", "score").agg(
        F.sum("holders").alias("holders"), F.min_by("name_key", "sot_ord").alias("name_key")
    )
    top = by_score.groupBy("probe").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("score", "holders", "name_key")))).alias("s")
    )
    best = F.col("s")[0]
    second = F.when(best["holders"] > 1, best["score"]).otherwise(F.get("s", F.lit(1))["score"])
    clear = second.isNull() | (best["score"] - second >= rules.gap)
    return top.select(
        "probe",
        best["name_key"].alias("name_key"),
        best["score"].alias("score"),
        F.when(clear, F.lit("fuzzy_name")).otherwise(F.lit("fuzzy_ambiguous")).alias("match_type"),
    )


def resolve_names(probes: DataFrame, index: IdentityIndex, rules: FuzzyRules = FuzzyRules()) -> DataFrame:
    """(name_key, match_type, sot) for every probe name that matches.

    ``probes``: distinct non-blank ``name_key``. Both ``probes`` and the name index are read
    several times; pass stored tables.

    One holder of the exact name is a clear match, several are ambiguous; only names nobody
    holds go to the similarity search.
    """
    names = index.by_name.select("name_key", "holders", F.col("sot.sot_ord").alias("sot_ord"))
    looked_up = probes.select("name_key").join(names.hint("merge"), "name_key", "left")
    exact = looked_up.where(F.col("holders").isNotNull()).select(
        "name_key",
        F.col("name_key").alias("best"),
        F.when(F.col("holders") == 1, F.lit("fuzzy_name")).otherwise(F.lit("fuzzy_ambiguous")).alias("match_type"),
    )
    rest = looked_up.where(F.col("holders").isNull()).select(F.col("name_key").alias("probe"))
    pairs = index.pieces.candidates(rest) if index.pieces else candidate_pairs(rest, names, rules)
    broad = decide(pairs, rules).select(
        F.col("probe").alias("name_key"), F.col("name_key").alias("best"), "match_type"
    )
    records = index.by_name.select(F.col("name_key").alias("best"), "sot")
    return exact.unionByName(broad).join(records.hint("merge"), "best").select("name_key", "match_type", "sot")
