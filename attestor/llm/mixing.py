"""Mixing sources to target weights.

The words of a source form one stream (documents in doc_id order). The stream is cut into blocks
of BLOCK words; the last one may be shorter. A source's target is its weighted share of all words,
at most MAX_EPOCHS times its own words; what is above goes to the other sources by weight.

Output slots are dealt to shards by a hash of (source, slot): given the exact totals, the counts
of the sources in a shard are a multinomial draw. Slot k of a source is index k mod n of pass
k div n over its n blocks. Each pass maps its indexes to blocks by a pseudorandom permutation of
its own: a few swap-or-not rounds, which permute any number of blocks. A short last block closes its
pass, and the last slot of a source is cut to the words that are left, so a source takes its
target to the word. Slots and blocks then meet in a join by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import documents, let, running_start, text_of, word_array, write_through

BLOCK = 128
SHARD_WORDS = 1 << 20
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
ROUNDS = 10
#: Slots are made in runs of this many, so that a hot source's slots come from many tasks.
RUN = 4096


def _source_key() -> Column:
    """The source as a join key that holds null, too."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, _hash and _copy, which number the rows that repeat a doc_id."""
    text = text_of()
    rows = docs.select("doc_id", "source", F.size(word_array(text)).cast("long").alias("size"), F.xxhash64(text).alias("_hash"))
    return rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size", "_hash")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target. ``sizes`` has one row per source: (source, source_size).

    Sources are ranked by code point, null last. A source's target is min(cap, rate * weight) with
    cap = epochs * size. In the order of cap / weight, the sources up to a place are full and the
    rest share what is left; the first place whose rate doesn't fill its source fixes the rate.
    """
    rank = "row_number() over (order by source asc nulls last)"
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"cast(({rank} - 1) % {len(weights)} + 1 as int)"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
    before = "(order by _cap / _w, source asc nulls last rows between unbounded preceding and 1 preceding)"
    s = s.withColumns({
        "_all": F.expr("sum(source_size) over ()").cast("double"),
        "_full": F.expr(f"coalesce(sum(_cap) over {before}, 0D)"),
        "_used": F.expr(f"coalesce(sum(_w) over {before}, 0D)"),
        "_weights": F.expr("sum(_w) over ()"),
    }).withColumn("_rate", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
    place = "case when _rate * _w <= _cap then struct(_cap / _w as p, source is null as n, source as s, _rate as rate) end"
    s = s.withColumn("_fixed", F.expr(f"min({place}) over ()")["rate"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_fixed") * F.col("_w")), F.col("_cap")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(documents with ``start``, their place in the source's stream; sources with their target)."""
    placed = write_through(
        running_start(sized(docs), ["doc_id", "_copy"], "size", "source", label="mix-sizes").withColumn("_key", _source_key()),
        "mix-placed",
    )
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = write_through(source_targets(sizes, weights, epochs).withColumn("_key", _source_key()), "mix-targets")
    return placed, targets


def permuted(index: str, count: str, key: str, rounds: int = ROUNDS) -> Column:
    """``index`` below ``count``, moved by a pseudorandom permutation that ``key`` (long) selects.

    Swap-or-not: each round pairs x with K - x modulo count and swaps the pair or not by a hash
    of its larger member.
    """
    m = F.greatest(F.col(count), F.lit(1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.col(key), r), m) + m - x, m)
        swap = F.xxhash64(F.col(key), -r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(1, rounds + 1)]), F.col(index), step)


def slots(targets: DataFrame, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per output slot: _key, shard, slot, epoch, block, words (fewer than a block at an end)."""
    shards = int((targets.agg(F.sum("target")).first()[0] or 0) // shard_words) + 1
    t = targets.where("source_size > 0").select(
        "_key", "source_size", F.floor("target").alias("_take"), F.expr(f"source_size div {block}").alias("_whole"),
        F.expr(f"(source_size + {block - 1}) div {block}").alias("_n"),
    ).withColumns({"_passes": F.expr("_take div source_size"), "_rest": F.expr("_take % source_size")})
    t = t.withColumn("_slots", F.expr(f"_passes * _n + (_rest + {block - 1}) div {block}"))
    runs = t.where("_slots > 0").withColumn("_run", F.explode(F.expr(f"sequence(0L, (_slots - 1) div {RUN})")))
    n = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    s = runs.repartition(n, "_key", "_run").withColumn(
        "slot", F.explode(F.expr(f"sequence(_run * {RUN}, least(_slots, (_run + 1) * {RUN}) - 1)"))
    ).withColumns({"epoch": F.expr("slot div _n"), "_i": F.expr("slot % _n")})
    s = s.withColumn("_pass", F.xxhash64(F.lit(seed), "_key", "epoch"))
    s = s.withColumn("block", F.when(F.col("_i") < F.col("_whole"), permuted("_i", "_whole", "_pass")).otherwise(F.col("_i")))
    words = F.expr(
        f"case when epoch < _passes then least({block}L, source_size - block * {block}) else least({block}L, _rest - _i * {block}) end"
    )
    return s.select(
        "_key", F.pmod(F.xxhash64(F.lit(seed + 1), "_key", "slot"), F.lit(shards)).alias("shard"), "slot", "epoch", "block",
        words.alias("words"),
    )


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block: _key, block, doc_id, _copy, start, the words [low, high) of the block."""
    s = placed.where("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    )
    return s.select(
        "_key", "block", "doc_id", "_copy", "start", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).alias("low"),
        F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)).alias("high"),
    )


def mixed_pieces(placed: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix: which words [from, from + words) of which document fill which slot of which shard."""
    joined = slots(targets, block, seed).withColumnRenamed("words", "_fill").join(pieces(placed, block).hint("merge"), ["_key", "block"])
    return joined.where("low < _fill").select(
        "_key", "shard", "slot", "epoch", "block", "doc_id", "_copy", "start",
        (F.col("block") * block + F.col("low") - F.col("start")).alias("from"),
        (F.least("high", "_fill") - F.col("low")).alias("words"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK,
        seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source.

    A null text has no words and takes none; a null source is a source of its own, ranked last.
    Rows that repeat a doc_id are documents of their own. A source without words has target 0. An
    empty table gives no rows. Reruns give the same mix. Sources are told apart by code point.
    """
    placed, targets = plan_mix(docs, weights, epochs)
    taken = mixed_pieces(placed, targets, block, seed).groupBy("_key", "start").agg(F.sum("words").alias("taken"))
    rows = placed.join(taken.hint("merge"), ["_key", "start"], "left").join(targets.drop("source"), "_key")
    return rows.select(
        "doc_id", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), "source",
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK,
                    seed: int = SEED) -> DataFrame:
    """The mix as documents: each document with the words taken from it, in epoch and text order.

    A document taken whole and once keeps its text; otherwise the words taken are joined by blanks.
    Documents of which nothing is taken go. Other columns stay; n_chars is counted anew;
    names that start with two underscores are taken.
    """
    placed, targets = plan_mix(docs, weights, epochs)
    parts = mixed_pieces(placed, targets, block, seed).groupBy("doc_id", "_copy").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "block", "from", "words"))).alias("__parts"), F.sum("words").alias("__taken")
    )
    text = text_of()
    rows = docs.withColumns({"__size": F.size(word_array(text)).cast("long"), "__hash": F.xxhash64(text)})
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "__size", "__hash"))).alias("d")
    parts = parts.alias("p")
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.__copy") == F.col("p._copy"))
    joined = rows.join(parts.hint("merge"), on)
    whole = (F.col("__taken") == F.col("__size")) & (F.size(F.array_distinct(F.col("__parts.epoch"))) == 1)
    cut = let(word_array(text_of("d.text")), lambda w: F.array_join(F.flatten(F.transform(
        "__parts", lambda p: F.slice(w, (p["from"] + 1).cast("int"), p["words"].cast("int"))
    )), " "))
    out = joined.withColumn("__text", F.when(whole, F.col("d.text")).otherwise(cut))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns} | {"text": F.col("__text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(k) for k, v in columns.items()])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
