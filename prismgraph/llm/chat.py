"""Op 7: chat formatting in budgeted, turn-aligned windows.

Template: [SYS]text[/SYS], [INST]text[/INST], [ANS]text</s>, and [ROLE]role[SAYS]text[/ROLE] for any other role. A control
string inside a text gets a backslash behind its first character (one more, where it already has some), so no text can
end a turn and the escape is undone exactly.

Prefix sums of turn tokens, over each conversation, cut it into segments of SEGMENT budgets at turns; within a segment
they choose greedy spans of whole turns below the budget, less what the system turn and the history take. Each window
repeats the system turn and the last turns before its span as far as the history's budget and count allow; the loss mask
covers the assistant texts of the span only, so every target counts once. A turn beyond the budget has a window of its
own, whole. Tokens are counted, by the vocabulary's own numbers where a column has them (from op 5, say), else as runs of
up to six letters or three digits, single other signs and single characters of unspaced scripts.

Turns lie in ranges of (conversation, turn), so a conversation of any length is spread; a range adds the sum of the ranges
before it, which only its first conversation can have. A segment's rows meet in one row, of bounded tokens but for its last turn.

Edge cases: a null text or role is empty; turns are ordered by number, then role and text, nulls first; repeated rows are
kept as turns; a null conv_id is one conversation; an empty table gives no windows; other columns are ignored. `read_back`
brings a conversation's text into one row, since its digest is over all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, parts, store

#: Budgets of a segment, and what the windows' numbers leave for each segment (a turn has two tokens at least).
SEGMENT, NUMBERS = 64, 1 << 20

# The template's control strings, as patterns.
_CONTROL = r"(/s>|s>|/?(?:SYS|INST|ANS|ROLE|SAYS)\])"
_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
_TURN = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|\[ANS\].*?</s>|\[ROLE\].*?\[/ROLE\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def marked(role: Column, text: Column) -> Column:
    t = escape(text)
    return (
        F.when(role == "system", F.concat(F.lit("[SYS]"), t, F.lit("[/SYS]")))
        .when(role == "user", F.concat(F.lit("[INST]"), t, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("[ANS]"), t, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[SAYS]"), t, F.lit("[/ROLE]")))
    )


def parsed(segment: Column) -> Column:
    """(role, text) of one marked turn."""
    inner = lambda head, tail: F.substring(segment, F.lit(len(head) + 1), F.length(segment) - len(head) - len(tail))
    turn = lambda r, t: F.struct(r.alias("role"), unescape(t).alias("text"))
    other = inner("[ROLE]", "[/ROLE]")
    at = F.instr(other, "[SAYS]")
    return (
        F.when(segment.startswith("[SYS]"), turn(F.lit("system"), inner("[SYS]", "[/SYS]")))
        .when(segment.startswith("[INST]"), turn(F.lit("user"), inner("[INST]", "[/INST]")))
        .when(segment.startswith("[ANS]"), turn(F.lit("assistant"), inner("[ANS]", "</s>")))
        .otherwise(turn(unescape(F.substring(other, F.lit(1), at - 1)), F.substring(other, at + 6, F.length(other))))
    )


def cost(role: Column, text: Column, tokens: Column | None = None) -> Column:
    """Tokens of a turn with its marks, one each; another role than the three is said in the turn."""
    count = lambda c: F.regexp_count(c, F.lit(_TOKEN))
    marks = F.when(role.isin("system", "user", "assistant"), F.lit(2)).otherwise(3 + count(role))
    return (F.coalesce(tokens, count(text)) if tokens is not None else count(text)).cast("long") + marks


def turn_order(turns: DataFrame, tokens_col: str | None = None) -> DataFrame:
    """Stored, in the order of conversations and turns: conv_id, row (ascending in that order), part (the row's range), role, out, cost, chars."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = F.col(tokens_col) if tokens_col else F.lit(None).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), own.alias("tokens"))
    rows = rows.repartitionByRange(parts(turns.sparkSession), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = [marked(F.col("role"), F.col("text")).alias("out"), cost(F.col("role"), F.col("text"), F.col("tokens") if tokens_col else None).alias("cost"), F.length(escape(F.col("text"))).alias("chars")]
    return store(rows.select("conv_id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), "role", *out), "chat-turns")


def with_sums(rows: DataFrame) -> DataFrame:
    """Adds before, the tokens of the conversation's earlier turns."""
    sums = rows.groupBy("conv_id", "part").agg(F.sum("cost").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a conversation of several ranges is the first of all of them but one, so these are no more rows than ranges
    base = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), earlier.alias("base")).where("base is not null")
    within = F.sum("cost").over(Window.partitionBy("part", "conv_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    summed = rows.withColumn("within", F.coalesce(within, F.lit(0).cast("long")))
    joined = summed.join(F.broadcast(base), (summed["part"] == base["p"]) & summed["conv_id"].eqNullSafe(base["c"]), "left")
    return joined.withColumn("before", F.col("within") + F.coalesce("base", F.lit(0).cast("long"))).drop("c", "p", "base", "within")


HEAD, OLD, NEW = 0, 1, 2


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 4, tokens_col: str | None = None) -> DataFrame:
    """conv_id, window (ascending), formatted, repeated (turns at the start that earlier windows have too), tokens, loss (start, length)."""
    length = SEGMENT * budget
    ordered = turn_order(turns, tokens_col)
    rows = with_sums(ordered).withColumn("segment", F.floor(F.col("before") / length).cast("long"))
    # a turn near a segment's end may be history of the next one
    late = (F.col("segment") + 1) * length - F.col("before") <= history
    places = F.when(late, F.array(F.struct("segment", F.lit(NEW).alias("kind")), F.struct((F.col("segment") + 1).alias("segment"), F.lit(OLD).alias("kind")))).otherwise(F.array(F.struct("segment", F.lit(NEW).alias("kind"))))
    kept = ["conv_id", "place", "before", "role", "out", "cost", "chars"]
    placed = rows.withColumn("place", F.explode(places)).select(*kept)
    # the system turn goes to every later segment of its conversation
    system = rows.where("before = 0 and role = 'system'").select(F.col("conv_id").alias("c"), F.lit(-1).cast("long").alias("before"), "role", "out", "cost", "chars")
    later = rows.where("segment > 0").select("conv_id", "segment").distinct().withColumn("place", F.struct("segment", F.lit(HEAD).alias("kind")))
    heads = later.join(system, later["conv_id"].eqNullSafe(system["c"])).select(*kept)
    every = placed.unionByName(heads).select("conv_id", F.col("place.segment").alias("segment"), F.struct("before", F.col("place.kind").alias("kind"), "role", "out", "cost", "chars").alias("t"))
    whole = every.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("t"))
    of = lambda *kinds: F.filter("t", lambda x: x["kind"].isin(*kinds))
    whole = whole.select("conv_id", "segment", of(HEAD).alias("head"), of(OLD, NEW).alias("all"), F.size(of(OLD)).alias("olds")).where("olds < size(all)")
    first = F.get("all", F.lit(0))
    # the system turn as a turn of the first window
    whole = whole.withColumn("own", F.when((first["before"] == 0) & (first["role"] == "system"), F.lit(1)).otherwise(F.lit(0)))
    whole = whole.withColumn("head", F.when(F.col("own") == 1, F.slice("all", 1, 1)).otherwise(F.col("head")))
    whole = whole.withColumn("room", F.greatest(F.lit(budget - history) - F.coalesce(F.get("head", F.lit(0))["cost"], F.lit(0)), F.lit(1)))
    # one pass over the costs: a span ends before the turn with which its sum of tokens would pass the room
    begin = F.struct(F.array("olds").alias("starts"), F.lit(0).cast("long").alias("used"), F.col("olds").alias("i"))

    def step(a: Column, c: Column) -> Column:
        full = (a["used"] > 0) & (a["used"] + c > F.col("room"))
        free = F.when(a["i"] < F.col("own"), F.lit(0)).otherwise(c).cast("long")
        return F.struct(F.when(full, F.array_append(a["starts"], a["i"])).otherwise(a["starts"]).alias("starts"), F.when(full, c).otherwise(a["used"] + free).alias("used"), (a["i"] + 1).alias("i"))

    costs = F.transform(F.slice("all", F.col("olds") + 1, F.size("all")), lambda x: x["cost"])
    spans = whole.withColumn("starts", F.aggregate(costs, begin, step)["starts"])

    def window(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("all"))
        back = F.greatest(first - history_turns, F.col("own"))
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["cost"])
        near = F.slice("all", back + 1, F.greatest(first - back, F.lit(0)))
        old = let(near, lambda a: F.filter(a, lambda x, i: total(F.slice(a, i + 1, F.size(a))) <= history))
        system = F.when((k == 0) & (F.col("own") == 1), F.slice("all", 1, 0)).otherwise(F.col("head"))
        parts_ = F.struct(F.concat(system, old).alias("lead"), F.slice("all", first + 1, end - first).alias("new"))

        def text(w: Column) -> Column:
            lead = F.array_join(F.transform(w["lead"], lambda x: x["out"]), "")
            said = F.array_join(F.transform(w["new"], lambda x: x["out"]), "")
            # where each assistant text of the span begins: what stands before it, and its own opening mark
            loss = F.aggregate(
                w["new"],
                F.struct(F.length(lead).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
                lambda a, x: F.struct((a["at"] + F.length(x["out"])).alias("at"), F.when(x["role"] == "assistant", F.array_append(a["loss"], F.struct((a["at"] + 5).alias("start"), x["chars"].alias("length")))).otherwise(a["loss"]).alias("loss")),
            )["loss"]
            return F.struct((F.col("segment") * NUMBERS + k).alias("window"), F.concat(lead, said).alias("formatted"), F.size(w["lead"]).alias("repeated"), (total(w["lead"]) + total(w["new"])).alias("tokens"), loss.alias("loss"))

        return let(parts_, text)

    return spans.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: its turns and the text under the loss mask."""
    segments = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0))
    fresh = let(segments, lambda s: F.transform(F.slice(s, F.col("repeated") + 1, F.size(s)), lambda x: let(parsed(x), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))))
    learnt = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))), "")
    rows = windows.select("conv_id", F.length("formatted").alias("chars"), "window", fresh.alias("said"), learnt.alias("learnt"))
    rows = rows.select("conv_id", "chars", F.size("said").alias("turns"), F.struct("window", F.array_join("said", "").alias("said"), "learnt").alias("w"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("turns").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.array_join("w.said", "").alias("said"), F.array_join("w.learnt", "").alias("learnt"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
