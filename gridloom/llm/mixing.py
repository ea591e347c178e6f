"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key u**(1/w) from a seeded hash u and its quality
weight w. A source whose target is k + f times its size gives k complete
epochs of all its documents and then, in descending order of keys, documents
until the words of the fraction f are reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, words_count

#: Fixed values of the query contract: weights repeat over the sources in order; the mix is 150 % of all words; a source gives 2 epochs at most.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Digits of a key that one pass tells apart, passes over them, and rows of a source from which equal keys are told apart by their texts before they are sorted.
FANOUT, LEVELS, MANY = 1024, 3, 100_000


def quality_weight(text: F.Column) -> F.Column:
    """Between 0.1 and 1: falls from 1 as symbols (no letter, digit, white space or common mark) reach a fifth of the text."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(body) - F.length(F.regexp_replace(body, r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'-]", ""))
    return F.lit(0.1) + F.lit(0.9) * F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(F.length(body), F.lit(1)))


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row per source with its weight and target.

    sizes: a row per source. Weights go to sources by code point, null last.
    Targets are in proportion to the weights and stop at most * size; the
    excess goes to the others by weight, again and again. That ends at
    min(most * size, level * weight), where the sources that stop are those
    with the smallest size / weight; one ordered pass finds the level. It is
    one task over a row per source: for some millions of sources, not more.
    """
    n = len(weights)
    order = Window.orderBy(F.col(source).isNull(), F.col(source))  # over one row per source
    up = Window.orderBy(F.col(size) / F.col("weight"), F.col(source).isNull(), F.col(source))
    upto = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    picked = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("weight", picked)
    level = (F.lit(share) * F.sum(size).over(every) - F.lit(most) * F.coalesce(F.sum(size).over(upto), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("__level", level).withColumn("__at", F.row_number().over(up))
    stops = F.lit(most) * F.col(size) <= F.col("__level") * F.col("weight")
    last = F.min(F.when(~stops, F.struct("__at", "__level"))).over(every)["__level"]  # of the first source that goes on
    return ranked.withColumn("target", F.when(F.coalesce(F.lit(most) * F.col(size) <= last * F.col("weight"), F.lit(True)), F.lit(most) * F.col(size)).otherwise(last * F.col("weight")).cast("double")).drop("__level", "__at")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weight: F.Column | None = None, seed: int = 17, whole: bool = False, **shares) -> DataFrame:
    """Slim rows: doc_id, source, size, source_size, target, taken; taken words count repeats.

    weight: each document's quality weight, quality_weight(text) by default;
    null, zero and less count as 0.001. The document at the edge of a budget
    gives only its first words, so each source meets floor(target) exactly;
    with whole=True it is taken whole where that is nearer to the target.
    Equal keys are told apart by doc_id, then by a hash of the text; rows
    equal in all of that draw the same key and are told apart arbitrarily
    (copies of one text under one id, or none, that make up much of a source
    are sorted in one task).
    A null text has size 0, a null source is a source of its own (last), and
    an empty table gives an empty table. Documents without words take none.

    Plan: one scan makes a slim table; a source may hold a third of it, so no
    task ever sorts a source: the words per digit of the key are summed, the
    digit where the budget runs out is found, and only documents of that
    digit go to the next level, three times. Digits are those of
    64 log2(-log(u) / w), which falls as the key rises: -log(u) / w has a
    density of 1 / e at most on that scale, whatever the weights, so a first
    digit holds 0.4 % of a source at most and what is left after three levels
    one part in 200 million, which is sorted. Where that still is more than
    MANY rows, they share one id or none, and digits of the text's hash
    follow. What goes to the next level is written and read again.
    """
    body = F.col(text)
    # the hash is one that other engines have too: 52 bits of md5
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"))), 1, 13), 16, 10).cast("double")
    u = (h + 0.5) / float(1 << 52)
    w = F.greatest(F.coalesce(quality_weight(body) if weight is None else weight.cast("double"), F.lit(0.001)), F.lit(0.001))
    # joins go by a name that is never null
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), name.alias("name"), words_count(body).alias("size"), F.exp(F.log(u) / w).alias("key"), (F.log2(-F.log(u) / w) * 64).alias("at"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("tie"))
    slim = keep(slim, "mix_slim")
    per = slim.groupBy("source", "name").agg(F.sum("size").alias("source_size"))
    per = targets(per, **shares)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = keep(per.withColumn("epochs", epochs).withColumn("budget", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")).drop("source"), "mix_targets")

    def digit(level: int) -> F.Column:
        """Digits ascend as keys descend."""
        if level == 0:
            return F.floor("at").cast("int")
        if level < LEVELS:
            return F.pmod(F.floor(F.col("at") * float(FANOUT**level)), F.lit(FANOUT)).cast("int")
        return F.expr(f"shiftright(tie, {22 - 10 * (level - LEVELS)}) & 1023").cast("int")  # of the 32 bits of the text's hash

    out = slim.join(per, "name")
    open_, full = out, []
    for level in range(LEVELS + 3):
        if level == LEVELS:
            crowd = keep(open_.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter((F.col("rows") > MANY) & F.col("lo").eqNullSafe(F.col("hi"))).select("name"), "mix_crowd")
            if not crowd.limit(1).count():
                break
            rest = open_.join(crowd, "name", "left_anti")
            open_ = open_.join(crowd, "name", "left_semi")
        open_ = open_.withColumn("digit", digit(level))
        upto = F.sum("words").over(Window.partitionBy("name").orderBy("digit"))  # FANOUT rows per source at most
        sums = open_.groupBy("name", "digit").agg(F.sum("size").alias("words"), F.first("budget").alias("budget")).withColumn("upto", upto)
        # the digit in which the budget runs out, and what is left of the budget there; none where a source has no words
        cut = keep(sums.filter("upto > budget AND upto - words <= budget").select("name", F.col("digit").alias("cut"), (F.col("budget") - F.col("upto") + F.col("words")).alias("rest")), f"mix_cut{level}")
        open_ = open_.join(cut, "name", "left")
        whole_part = F.when(F.coalesce(F.col("digit") < F.col("cut"), F.lit(False)), F.col("size")).otherwise(0).cast("long")
        full.append(open_.filter("cut IS NULL OR digit <> cut").withColumn("part", whole_part).drop("digit", "cut", "rest", "budget"))
        # written, so that plans of later levels don't hold those of all levels before: the driver would plan and broadcast each of them anew
        open_ = keep(open_.filter("digit = cut").withColumn("budget", F.col("rest")).drop("digit", "cut", "rest"), f"mix_open{level}")
    else:
        open_ = open_.unionByName(rest)
    last = Window.partitionBy("name").orderBy(F.desc("key"), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("budget") - F.coalesce(F.sum("size").over(last), F.lit(0))
    part = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0) if whole else room
    edge = open_.withColumn("part", F.when(room >= F.col("size"), F.col("size")).when(room > 0, part).otherwise(0).cast("long"))
    out = edge.drop("budget")
    for part_of in full:
        out = out.unionByName(part_of)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "tie")
