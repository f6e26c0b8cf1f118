"""Repair of conversations: the cheapest edits that make roles alternate, by a fold in Spark SQL's higher-order functions.

Windows flag each turn's fault, a conversation's turns are collected as a sorted array of structs, and aggregate() carries
four structs (cost, audit), the best edits that leave the repaired conversation at its start, after a system turn, after
a user turn and after an assistant turn. least() compares costs first and audits second. No two best edits of a state
have one as the start of the other at the same cost, so appending keeps their order and the fold is exact.

A conversation of over MOST turns doesn't meet in one array: its turns are cut into ranges, each of which is folded from all four
states, and a second fold joins the ranges' results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, shuffle_partitions, written

SPACE = " \t\n\x0b\x0c\r"
#: Turns that one array holds; a longer conversation is folded in parts.
MOST = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 50
LEGAL = ("su", "ua", "au")
ROLES = ("user", "assistant")
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns (conv_id, turn, role, text, present) with planted faults, by the crc32 of `conv_id:turn` modulo 20: 0 drops
    a turn (its row stays with present false, for its conversation's sake), 1 empties it, 2 takes its ends of sentences,
    3 repeats it, 4 makes it the user's. Nulls count as one space."""
    blank = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    d = turns.select(turns[conv].alias("conv_id"), turns[turn].cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("kind") != 0).alias("present"), "kind")
    return d.withColumn("__copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__copy", "kind")


def _best(cost: Column | int, audit: Column | str) -> Column:
    return F.struct((F.lit(cost) if isinstance(cost, int) else cost).cast("long").alias("c"), (F.lit(audit) if isinstance(audit, str) else audit).alias("a"))


def _more(state: Column, cost: Column | int, audit: Column | str) -> Column:
    return _best(state["c"] + cost, F.concat(state["a"], F.lit(audit) if isinstance(audit, str) else audit))


def _closed(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """States with what inserted turns reach from them; two in a row are the most that helps."""
    user = F.least(s2, *[_more(s, INSERT, "I") for s in (s0, s1, s3)])
    return F.struct(s0.alias("s0"), s1.alias("s1"), user.alias("s2"), F.least(s3, _more(user, INSERT, "I")).alias("s3"))


def _start(state: int) -> Column:
    return _closed(*[_best(0 if i == state else NEVER, "") for i in range(4)])


def _step(acc: Column, x: Column) -> Column:
    """One turn (or x.m equal ones that have to go)."""
    may = ~x["fault"].isin("b", "d")
    extra = F.when(x["fault"] == "t", TRUNCATED).otherwise(0)
    gone = lambda s: _more(s, F.lit(DELETE) * x["m"], F.repeat(F.lit("D"), x["m"].cast("int")))
    stay = lambda s, initial: _more(s, F.when(may, F.when(x["first"] == initial, KEEP).otherwise(REROLE) + extra).otherwise(NEVER), F.when(x["first"] == initial, "K").otherwise("R"))
    s0, s1, s2, s3 = (acc[f"s{i}"] for i in range(4))
    system = _more(s0, F.when(may & (x["first"] == "s"), extra).otherwise(NEVER), "K")
    return _closed(gone(s0), F.least(gone(s1), system), F.least(gone(s2), stay(F.least(s0, s1, s3), "u")), F.least(gone(s3), stay(s2, "a")))


def _folded(rows: Column, state: int) -> Column:
    return F.aggregate(rows, _start(state), _step)


def _lines(rows: Column, audit: Column, state: Column) -> Column:
    """The repaired lines that an audit makes of rows, from a state on."""

    def step(acc: Column, edit: Column) -> Column:
        role = F.when(acc["state"] == 2, ROLES[1]).otherwise(ROLES[0])
        row = F.get(rows, acc["i"])
        line = F.when(edit == "I", F.concat(role, F.lit(":"))).when(edit == "R", F.concat(role, F.lit(":"), row["text"])).when(edit == "K", F.concat(row["role"], F.lit(":"), row["text"]))
        turned = F.when(acc["state"] == 2, 3).otherwise(2)
        after = F.when(edit.isin("I", "R"), turned).when(edit == "K", F.when(row["first"] == "s", 1).otherwise(turned)).otherwise(acc["state"])
        uses = edit.isin("K", "R", "D")
        ends = uses & (acc["used"] + 1 >= row["m"])
        return F.struct(
            (acc["i"] + F.when(ends, 1).otherwise(0)).cast("int").alias("i"),
            F.when(ends, 0).when(uses, acc["used"] + 1).otherwise(acc["used"]).cast("long").alias("used"),
            after.cast("int").alias("state"),
            F.when(line.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("used"), state.cast("int").alias("state"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(audit, ""), start, step)["out"]


def _fault(text: Column, seen: Column) -> Column:
    body = F.rtrim(text, F.lit(SPACE))
    return F.when(body == "", "b").when(seen, "d").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")


def _count(rows: Column, fault: str) -> Column:
    return F.aggregate(F.filter(rows, lambda x: x["fault"] == fault), F.lit(0).cast("long"), lambda n, x: n + x["m"])


def _illegal(rows: Column) -> Column:
    """Neighbours whose roles' initials can't follow each other; equal turns in one struct never can."""
    pairs = F.zip_with(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), rows, lambda y, x: F.concat(x["first"], y["first"]))
    return F.size(F.filter(F.slice(pairs, 1, F.greatest(F.size(rows) - 1, F.lit(0))), lambda p: ~p.isin(*LEGAL))).cast("long") + F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + x["m"] - 1)


def _whole(t: DataFrame) -> DataFrame:
    """Conversations that an array holds: one shuffle, by conversation; the window by role and text keeps to it."""
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first()))
    t = t.repartition("conv").withColumn("nth", seen)
    row = F.struct("turn", "role", "text", "nth", F.lit(1).cast("long").alias("m"), F.substring("role", 1, 1).alias("first"), _fault(F.col("text"), F.col("nth") > 1).alias("fault"))
    c = t.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("present"), row))).alias("rows"))
    end = _folded(F.col("rows"), 0)
    c = c.withColumn("end", end).withColumn("best", F.least("end.s0", "end.s3"))
    turns = F.filter(F.array_distinct(F.transform("rows", lambda x: x["turn"])), lambda x: x.isNotNull())
    return c.select(
        "conv",
        F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(turns), F.lit(0)).cast("long").alias("gaps"),
        *[_count(F.col("rows"), kind[0]).alias(kind) for kind in ("blank", "duplicate", "truncated")],
        _illegal(F.col("rows")).alias("illegal"),
        F.col("best.c").alias("cost"),
        F.col("best.a").alias("audit"),
        F.sha2(F.array_join(_lines(F.col("rows"), F.col("best.a"), F.lit(0)), "\n").cast("binary"), 256).alias("repaired_sha256"),
    )


def _in_ranges(t: DataFrame, most: int, keep: list[str]) -> DataFrame:
    """Conversations of any length. Equal turns are one row with their number; the first place of a role and text is a
    minimum by key; ranges of turns come from a range partitioning, which cuts anywhere."""
    spark, old = t.sparkSession, []
    t = written(t.where("present").groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("of", F.md5(F.col("text").cast("binary"))), old)
    firsts = t.groupBy("conv", "role", "of").agg(F.min(F.struct("turn")).alias("place")).toDF("conv2", "role2", "of2", "place")
    x = t.join(firsts, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("role") == F.col("role2")) & (F.col("of") == F.col("of2"))).drop("conv2", "role2", "of2", "of")
    seen = ~F.col("turn").eqNullSafe(F.col("place.turn"))
    # the first of equal turns, and the others
    pieces = F.array(F.struct(F.lit(0).alias("k"), F.lit(1).cast("long").alias("m"), seen.alias("seen")), F.struct(F.lit(1).alias("k"), (F.col("copies") - 1).alias("m"), F.lit(True).alias("seen")))
    x = x.withColumn("piece", F.explode(F.filter(pieces, lambda p: p["m"] > 0))).select("conv", "turn", "role", "text", "piece.*")
    x = x.withColumn("fault", _fault(F.col("text"), F.col("seen"))).drop("seen")
    x = x.repartitionByRange(shuffle_partitions(spark), "conv", F.col("turn").asc_nulls_first(), "role", "text", "k").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "k")
    at = F.monotonically_increasing_id()
    x = x.withColumn("at", at).withColumn("range", F.floor(F.col("at") / most).cast("long"))  # partitions begin at multiples of 2 ** 33
    s = x.groupBy("conv", "range").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "m", F.substring("role", 1, 1).alias("first"), "fault"))).alias("rows"))
    s = s.withColumn("ends", F.array(*[_folded(F.col("rows"), i) for i in range(4)]))
    ends = F.struct(F.get("rows", F.lit(0))["first"].alias("head"), F.element_at("rows", -1)["first"].alias("tail"))
    s = written(s.select("conv", "range", "rows", "ends", *[_count(F.col("rows"), kind[0]).alias(kind) for kind in ("blank", "duplicate", "truncated")], _illegal(F.col("rows")).alias("illegal"), ends.alias("edge")), keep)

    def joined(acc: Column, r: Column) -> Column:
        def to(j: int) -> Column:
            paths = [F.struct((acc[i]["c"] + r["ends"][i][f"s{j}"]["c"]).alias("c"), F.concat(acc[i]["a"], r["ends"][i][f"s{j}"]["a"]).alias("a"), F.concat(acc[i]["path"], F.array(F.lit(i))).alias("path")) for i in range(4)]
            return F.least(*paths)

        return F.array(*[to(j) for j in range(4)])

    none = [F.struct(F.lit(0 if i == 0 else NEVER).cast("long").alias("c"), F.lit("").alias("a"), F.array().cast("array<int>").alias("path")) for i in range(4)]
    c = s.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("range", "ends", "edge"))).alias("ranges"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")])
    c = c.withColumn("end", F.aggregate("ranges", F.array(*none), joined)).withColumn("best", F.when(F.struct(F.col("end")[0]["c"], F.col("end")[0]["a"]) <= F.struct(F.col("end")[3]["c"], F.col("end")[3]["a"]), F.struct(F.col("end")[0].alias("e"), F.lit(0).alias("last"))).otherwise(F.struct(F.col("end")[3].alias("e"), F.lit(3).alias("last"))))
    between = F.zip_with(F.slice("ranges", 2, F.greatest(F.size("ranges"), F.lit(1))), F.slice("ranges", 1, F.greatest(F.size("ranges") - 1, F.lit(0))), lambda y, x: F.concat(x["edge"]["tail"], y["edge"]["head"]))
    path = F.col("best.e.path")
    # the state that each range begins in, and the one that it ends in
    steps = F.arrays_zip(F.transform("ranges", lambda r: r["range"]).alias("range"), path.alias("from"), F.concat(F.slice(path, 2, F.greatest(F.size(path), F.lit(1))), F.array("best.last")).alias("to"))
    c = written(c.select("conv", "blank", "duplicate", "truncated", (F.col("illegal") + F.size(F.filter(between, lambda p: ~p.isin(*LEGAL)))).alias("illegal"), F.col("best.e.c").alias("cost"), F.col("best.e.a").alias("audit"), steps.alias("steps")), keep)
    chosen = c.select(F.col("conv").alias("conv2"), F.explode("steps").alias("step")).select("conv2", F.col("step.range").alias("range2"), "step.from", "step.to")
    lines = s.join(chosen, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("range") == F.col("range2")))
    end = F.col("ends")[F.col("from")]
    audit = F.when(F.col("to") == 0, end["s0"]["a"]).when(F.col("to") == 1, end["s1"]["a"]).when(F.col("to") == 2, end["s2"]["a"]).otherwise(end["s3"]["a"])
    lines = lines.select("conv", "range", _lines(F.col("rows"), audit, F.col("from")).alias("lines")).where(F.size("lines") > 0)
    lines = lines.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("range", F.array_join("lines", "\n").alias("text")))).alias("parts"))
    sha = lines.select(F.col("conv").alias("conv2"), F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").cast("binary"), 256).alias("repaired_sha256"))
    gaps = t.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = c.join(sha, F.col("conv").eqNullSafe(F.col("conv2")), "left").drop("conv2")
    out = out.join(gaps.toDF("conv2", "gaps"), F.col("conv").eqNullSafe(F.col("conv2"))).drop("conv2")
    out = written(out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")), keep)
    old += keep[:-1]
    del keep[:-1]
    dropped(spark, old)
    return out


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """A row for each conversation: conv_id, gaps, the numbers of blank, duplicate, truncated turns and illegal
    neighbours, the cost and audit of its cheapest repair, and the SHA-256 of the repaired `role:text` lines.

    Turns go by turn, nulls first; turns of one number by role and text, and equal ones are each other's neighbours. Null
    roles and texts count as one space, so null texts are blank; a null conversation is one of its own; rows whose
    column present is false only name their conversation, and one without other rows has zeros, an empty audit and the
    hash of an empty string. An empty table gives no rows; extra columns are not read. The hash is that of one
    string, so a repaired conversation has to fit a value of Spark's (2 GB); nothing else is bounded. keep takes the path of the table that
    the result of long conversations reads.
    """
    spark = turns.sparkSession
    here = F.lit(True) if present is None else F.coalesce(turns[present], F.lit(False))
    blank = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    t = turns.select(turns[conv].alias("conv"), turns[turn].cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), here.alias("present"))
    sizes = written(t.where("present").groupBy("conv").count().where(F.col("count") > most).select(F.col("conv").alias("conv2")), old := [])
    if sizes.isEmpty():
        dropped(spark, old)
        out = _whole(t)
    else:
        keep = [] if keep is None else keep
        on = F.col("conv").eqNullSafe(F.col("conv2"))
        made: list[str] = []
        long = _in_ranges(t.join(sizes, on, "left_semi"), most, made)
        out = _whole(t.join(sizes, on, "left_anti")).unionByName(long)
        keep += old + made
    return out.select(F.col("conv").alias(conv), *RESULT)
