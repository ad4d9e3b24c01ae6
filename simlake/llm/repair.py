"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn, then user and assistant in turn.

Windows over a conversation's turns give each row its faults. The turns are collected as sorted structs, and ``aggregate()``
folds them with four (cost, audit) structs, one for each end that a repaired beginning can have: nothing yet, the system turn,
a user turn, an assistant turn. A row is kept (K, cost 0), gets another role (R, 2) or is deleted (D, 3), and empty turns may
be inserted anywhere (I, 2); ``least`` over the structs takes the cheaper cost and then the audit that is least in ASCII. A
blank row or one that repeats an earlier row has to go; a truncated row that stays costs 1.

A conversation is folded in pieces of CHUNK turns, each from all four starts, and the pieces are folded in turn: audits grow
piece by piece, so the work stays linear in the turns. All of it is native: windows, one shuffle by conversation.

Edge cases: null roles and texts read as one space; rows whose role begins with none of s, u, a cannot be kept as they are;
turns are ordered by number, nulls first, then by role and text, so repeated rows lie side by side; null conversation ids
form one conversation; a conversation without rows (``present`` false) has zeros, an empty audit and no turns; an empty table
gives an empty result; other columns are ignored, whatever their names. A conversation's repaired turns are one row, so one
task holds the texts of one conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turns that one fold takes; longer conversations are folded piece by piece.
CHUNK = 512

# What an edit costs, and what is more than any repair costs.
REROLE, DELETE, INSERT, TRUNCATED, NEVER = 2, 3, 2, 1, 1 << 50
WHITE = " \t\n\x0b\x0c\r"
STATES = ("none", "system", "user", "assistant")


def _path(cost: Column | int, audit: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(cost).cast("long").alias("cost"), as_column(audit).alias("audit"))


def _then(path: Column, cost: Column | int, letters: Column | str) -> Column:
    return _path(path["cost"] + cost, F.concat(path["audit"], letters if isinstance(letters, Column) else F.lit(letters)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _states(paths: dict[str, Column]) -> Column:
    return F.struct(*(paths[s].alias(s) for s in STATES))


def _start(state: str) -> Column:
    return _states({s: _path(0 if s == state else NEVER, "") for s in STATES})


def _inserted(at: Column) -> Column:
    """The states with turns inserted where that is cheaper."""
    none, system, user, assistant = (at[s] for s in STATES)
    one = lambda p: _then(p, INSERT, "I")
    two = lambda p: _then(p, 2 * INSERT, "II")
    return _states({"none": none, "system": system, "user": F.least(user, one(none), one(system), one(assistant)), "assistant": F.least(assistant, one(user), two(none), two(system))})


def _edited(at: Column, turn: Column) -> Column:
    """The states after a row, from those before it."""
    none, system, user, assistant = (at[s] for s in STATES)
    stays, late = ~turn["fault"].isin("blank", "duplicate"), F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    gone = lambda p: _then(p, DELETE, "D")

    def as_role(initial: str, before: Column) -> Column:
        own = turn["initial"] == initial
        return F.when(stays, _then(before, late + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise("R"))).otherwise(_path(NEVER, ""))

    kept_system = F.when(stays & (turn["initial"] == "s"), _then(none, late, "K")).otherwise(_path(NEVER, ""))
    return _states({"none": gone(none), "system": F.least(gone(system), kept_system), "user": F.least(gone(user), as_role("u", F.least(none, system, assistant))), "assistant": F.least(gone(assistant), as_role("a", user))})


def _fold(turns: Column, state: str) -> Column:
    return F.aggregate(turns, _start(state), lambda at, turn: _let(_inserted(at), lambda open_: _edited(open_, turn)))


def _joined(pieces: Column) -> Column:
    """The cheapest (cost, audit) over pieces that hold the ends from every start."""

    def further(at: Column, piece: Column) -> Column:
        def to(end: str) -> Column:
            ways = [F.when((at[s]["cost"] < NEVER) & (piece["from"][s][end]["cost"] < NEVER), _then(at[s], piece["from"][s][end]["cost"], piece["from"][s][end]["audit"])) for s in STATES]
            return F.coalesce(F.least(*ways), _path(NEVER, ""))

        return _states({end: to(end) for end in STATES})

    return F.aggregate(pieces, _start("none"), further, lambda at: _let(_inserted(at), lambda open_: F.least(open_["none"], open_["assistant"])))


def _repaired(turns: Column, audit: Column) -> Column:
    """The turns (edit, role, text) that an audit makes."""
    letters = lambda without: F.filter(F.split(F.translate(audit, without, ""), ""), lambda x: x != "")
    made = lambda is_new: F.filter(F.transform(letters("D"), lambda x, i: F.when((x == "I") == is_new, i)), lambda i: i.isNotNull())
    stay = F.filter(F.zip_with(turns, letters("I"), lambda t, x: F.struct(x.alias("edit"), t["initial"].alias("initial"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["edit"] != "D")
    old = F.zip_with(made(False), stay, lambda i, t: F.struct(i.alias("at"), t["edit"].alias("edit"), t["initial"].alias("initial"), t["role"].alias("role"), t["text"].alias("text")))
    new = F.transform(made(True), lambda i: F.struct(i.alias("at"), F.lit("I").alias("edit"), F.lit("").alias("initial"), F.lit("").alias("role"), F.lit("").alias("text")))

    def named(rows: Column) -> Column:
        first = F.when((F.get(rows, F.lit(0))["edit"] == "K") & (F.get(rows, F.lit(0))["initial"] == "s"), 1).otherwise(0)
        role = lambda r: F.when(r["edit"] == "K", r["role"]).when((r["at"] - first) % 2 == 0, "user").otherwise("assistant")
        return F.transform(rows, lambda r: F.struct(r["edit"].alias("edit"), role(r).alias("role"), r["text"].alias("text")))

    return _let(F.array_sort(F.concat(old, new)), named)


def faults(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """(conv, present, place, turn, initial, role, text, fault, illegal, step): each row with its first fault, whether its role may not follow the one before, and whether its turn is a new one."""
    null_as = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    rows = turns.select(F.col(conv_col).alias("conv"), present.alias("present"), F.col(turn_col).cast("long").alias("turn"), null_as(role_col).alias("role"), null_as(text_col).alias("text"))
    rows = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    along = Window.partitionBy("conv").orderBy(F.desc("present"), F.asc_nulls_first("turn"), "role", "text")
    pair = F.concat(F.lag("initial").over(along), F.col("initial"))
    earlier = F.lag("turn").over(along)
    rows = rows.select("*", F.row_number().over(along).alias("place"), (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"), (F.col("turn").isNotNull() & (earlier.isNull() | (earlier != F.col("turn")))).alias("step"))
    again = F.row_number().over(Window.partitionBy("conv", "present", "role", "digest").orderBy("place")) > 1
    said = F.btrim("text", F.lit(WHITE))
    fault = F.when(said == "", "blank").when(again, "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("conv", "present", "place", "turn", "initial", "role", "text", fault.alias("fault"), "illegal", "step")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and ``repaired``, an array of (edit, role, text).

    Rows whose ``present_col`` is not true stand for their conversation only.
    """
    rows = faults(turns, conv_col, turn_col, role_col, text_col, present_col).withColumn("piece", F.when(F.col("present"), F.floor((F.col("place") - 1) / chunk)).otherwise(-1))
    one = lambda c: F.coalesce(F.sum(F.when(F.col("present") & c, 1)), F.lit(0)).cast("long")
    own = F.when(F.col("present"), F.struct("place", "initial", "fault", "role", "text"))
    counts = [one(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")] + [one(F.col("illegal")).alias("illegal"), one(F.col("step")).alias("steps")]
    last, first = (fn(F.when(F.col("present"), F.col("turn"))).alias(name) for fn, name in ((F.max, "last"), (F.min, "first")))
    pieces = rows.groupBy("conv", "piece").agg(*counts, last, first, F.array_sort(F.collect_list(own)).alias("turns"))
    ends = [(F.when(F.col("piece") > 0, _fold(F.col("turns"), s)) if s != "none" else _fold(F.col("turns"), s)).alias(s) for s in STATES]
    pieces = pieces.withColumn("from", F.struct(*ends))
    summed = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "steps")]
    whole = pieces.groupBy("conv").agg(*summed, F.max("last").alias("last"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.when(F.col("piece") >= 0, F.struct("piece", "from", "turns")))).alias("pieces"))
    whole = whole.withColumn("best", _joined(F.col("pieces")))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("steps"), F.lit(0)).alias("gaps")
    repaired = _repaired(F.flatten(F.transform("pieces", lambda p: p["turns"])), F.col("best")["audit"])
    return whole.select(F.col("conv").alias(conv_col), gaps, "blank", "duplicate", "truncated", "illegal", F.col("best")["cost"].alias("cost"), F.col("best")["audit"].alias("audit"), repaired.alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) broken by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    own = turns.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), how.alias("how"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("present"), times.alias("time")).drop("time")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repair(damaged(table(spark, sf_dir, "conversations")), present_col="present")
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))


def _sql_then(path: str, cost: str, letters: str) -> str:
    return f"{{'c': {path}.c + {cost}, 'x': {path}.x || {letters}}}"


_NEVER = f"{{'c': {NEVER}::BIGINT, 'x': ''}}"
_AS = {r: f"CASE WHEN stays THEN {_sql_then(before, f'late + CASE WHEN i = {r!r} THEN 0 ELSE 2 END', f'CASE WHEN i = {r!r} THEN chr(75) ELSE chr(82) END')} ELSE {_NEVER} END" for r, before in (("u", "least(e, s, a1)"), ("a", "u1"))}

ORACLE = f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(8 * length(k)), lambda b: ((ord(k[b // 8 + 1]) >> (b % 8)::INTEGER) & 1)::BIGINT),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 20 AS how FROM m
), d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS time
  FROM hashed WHERE how <> 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role[1] AS i,
    regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM d
), q AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i NOT IN ('su', 'ua', 'au') AS wrong FROM p
), r AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM q
), total AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE wrong) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'x': ''}} AS e, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, next, {_sql_then("e", "3", "'D'")}, least({_sql_then("s", "3", "'D'")}, CASE WHEN stays AND i = 's' THEN {_sql_then("e", "late", "'K'")} ELSE {_NEVER} END),
    least({_sql_then("u1", "3", "'D'")}, {_AS["u"]}), least({_sql_then("a1", "3", "'D'")}, {_AS["a"]})
  FROM (
    SELECT dp.*, r.place AS next, r.i, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late,
      least(u, {_sql_then("e", "2", "'I'")}, {_sql_then("s", "2", "'I'")}, {_sql_then("a", "2", "'I'")}) AS u1,
      least(a, {_sql_then("u", "2", "'I'")}, {_sql_then("e", "4", "'II'")}, {_sql_then("s", "4", "'II'")}) AS a1
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.place = dp.place + 1
  )
), best AS (
  SELECT dp.conv_id, least(e, a, {_sql_then("u", "2", "'I'")}, {_sql_then("s", "4", "'II'")}) AS b
  FROM dp LEFT JOIN total ON total.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.place = coalesce(n, 0)
), letters AS (
  SELECT conv_id, unnest(string_split(b.x, '')) AS edit, generate_subscripts(string_split(b.x, ''), 1) AS at_ FROM best
), placed AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS place, count(*) FILTER (WHERE edit <> 'D') OVER w AS made
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY at_ ROWS UNBOUNDED PRECEDING)
), joined AS (
  SELECT placed.*, r.role, r.text, max(CASE WHEN made = 1 AND edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id) AS first
  FROM placed LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM placed.conv_id AND r.place = placed.place
), said AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - first) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY at_) AS t
  FROM joined WHERE edit <> 'D' AND edit <> '' GROUP BY conv_id
)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.c AS cost, b.x AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best LEFT JOIN total ON total.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM best.conv_id
"""
