"""Op 11, repair of the structure of conversations: a fold in Spark SQL's higher-order functions.

Windows mark each turn's first fault.  The sorted turns of a conversation are one array, over which ``aggregate``
carries the cheapest edits into each of four states: nothing said yet, after the system's turn, after a user's, after
an assistant's.  A state is a struct of cost and path, so that ``least`` takes the cheaper and, of equally cheap
edits, the one that comes first in ASCII.

Paths have a letter for each edit: D deleted, I and J a user's or an assistant's turn inserted, K kept, R and S made a
user's or an assistant's.  Their first letters in an audit are D, I, K and R.  Why it is enough to carry the least path
of each state: two paths over the same turns of which one begins the other differ by insertions, so they don't cost the
same; of others the lesser stays the lesser whatever follows.  A path determines the roles, so paths compare as audits do.

Conversations of more than ``CHUNK`` turns are folded chunk by chunk, from each state to each, and the chunks then
one after the other, so that long paths aren't copied for every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, table

RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
CHUNK = 256
_STATES = ("none", "system", "user", "assistant")
#: More than any edits cost.
_NEVER = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults that depend on crc32(conv_id:turn) only: conv_id, turn, role, text and dropped.

    Nulls count as one space (conv_id and turn stay null in their columns).
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    step = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("kind"))
    return step.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, at (place in the conversation), fault (blank, duplicate, truncated or null), illegal and fresh.

    illegal: the initials of this role and of the one before can't follow each other; fresh: the first row of its turn.
    Rows with ``dropped`` are no one's neighbours.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped")).repartition("conv_id")
    turn = F.col("turn").asc_nulls_first()
    order = W.partitionBy("conv_id", "dropped").orderBy(turn, "role", "text")
    # by place, so that of equal rows in one turn the first is the same one everywhere
    again = F.row_number().over(W.partitionBy("conv_id", "dropped", "role", "text").orderBy("at")) > 1
    pair = F.concat(F.substring(F.lag("role").over(order), 1, 1), F.substring("role", 1, 1))
    return rows.select(
        "*",
        F.row_number().over(order).alias("at"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False))).alias("fresh"),
    ).withColumn(
        "fault",
        F.when(~F.col("text").rlike(WORD), "blank").when(again, "duplicate").when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), "truncated"),
    )


def _state(cost: Column | int, path: Column | str) -> Column:
    return F.struct((cost if isinstance(cost, Column) else F.lit(cost)).cast("long").alias("cost"), (path if isinstance(path, Column) else F.lit(path)).alias("path"))


def _with(state: Column, cost: Column | int, letter: Column | str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["path"], letter if isinstance(letter, Column) else F.lit(letter)))


def _states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _insertions(s: Column) -> Column:
    """States after the cheapest insertions, a user's turn and then an assistant's at most: more leads back to where it began."""
    user = F.least(s["user"], _with(F.least(s["none"], s["system"], s["assistant"]), INSERT, "I"))
    # a user's turn need not be written out again for the assistant's to follow it: it is one more letter of the same path
    return _states(s["none"], s["system"], user, F.least(s["assistant"], _with(s["user"], INSERT, "J"), _with(F.least(s["none"], s["system"], s["assistant"]), 2 * INSERT, "IJ")))


def _step(s: Column, turn: Column) -> Column:
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    stays = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    never = _state(_NEVER, "")

    def said(before: Column, role: str, changed: str) -> Column:
        own = turn["initial"] == role
        return F.when(stays, _with(before, extra + F.when(own, 0).otherwise(RETYPE), F.when(own, "K").otherwise(changed))).otherwise(never)

    gone = {name: _with(s[name], DELETE, "D") for name in _STATES}
    begun = F.when(stays & (turn["initial"] == "s"), _with(s["none"], extra, "K")).otherwise(never)
    return _states(
        gone["none"],
        F.least(gone["system"], begun),
        F.least(gone["user"], said(F.least(s["none"], s["system"], s["assistant"]), "u", "R")),
        F.least(gone["assistant"], said(s["user"], "a", "S")),
    )


def _fold(turns: Column, start: Column) -> Column:
    return F.aggregate(turns, start, lambda s, turn: _insertions(_step(s, turn)))


def _only(name: str) -> Column:
    return _states(*[_state(0 if name == x else _NEVER, "") for x in _STATES])


def _cheapest(turns: Column, chunk: int) -> Column:
    """The cheapest of the paths over ``turns`` that end well: nothing said, or an assistant's turn at the end."""
    start = _states(_state(0, ""), _state(_NEVER, ""), _state(INSERT, "I"), _state(2 * INSERT, "IJ"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / chunk).cast("int")), lambda i: F.slice(turns, i * chunk + 1, F.lit(chunk)))
    each = F.transform(parts, lambda part: F.struct(*[_fold(part, _only(name)).alias(name) for name in _STATES]))
    after = lambda s, by, to: F.least(*[_state(s[x]["cost"] + by[x][to]["cost"], F.concat(s[x]["path"], by[x][to]["path"])) for x in _STATES])
    end = F.when(F.size(turns) <= chunk, _fold(turns, start)).otherwise(F.aggregate(each, start, lambda s, by: _states(*[after(s, by, to) for to in _STATES])))
    return F.least(end["none"], end["assistant"])


def _lines(turns: Column, path: Column) -> Column:
    """``role:text`` of the turns that the edits leave, as an array."""
    inserted = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x.isin("I", "J")), lambda x: F.when(x == "I", "user:").otherwise("assistant:"))
    # to each turn its letter and the insertions before it
    each = F.arrays_zip(turns.alias("turn"), F.regexp_extract_all(path, F.lit("[IJ]*[DKRS]"), F.lit(0)).alias("edit"))

    def told(x: Column) -> Column:
        turn, edit = x["turn"], x["edit"]
        role = F.when(edit.endswith("R"), "user").when(edit.endswith("S"), "assistant").otherwise(turn["role"])
        line = F.when(edit.endswith("D"), F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), turn["text"])))
        return F.when(F.length(edit) == 1, line).otherwise(F.concat(inserted(edit), line))

    return F.concat(F.flatten(F.transform(each, told)), inserted(F.regexp_extract(path, "[IJ]*$", 0)))


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text, dropped): faults, cost, audit and repaired text.

    A conversation's rows are taken by turn (null first), then role, then text; rows with ``dropped`` only name their
    conversation.  A null role or text is one space; a null conv_id is a conversation of its own; equal rows are
    duplicates; an empty table gives no row; other columns are not read.  A conversation without rows has zeros, an
    empty audit and an empty text.  A conversation is one row of the result, whose text is whole, so a task holds one
    conversation at a time; nothing else is gathered.
    """
    live = lambda c: F.when(~F.col("dropped"), c)
    one = live(F.struct("at", F.substring("role", 1, 1).alias("initial"), "fault", "role", "text"))
    number = lambda c: F.coalesce(F.sum(live(c).cast("long")), F.lit(0).cast("long"))
    of = faults(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(live(F.col("turn"))) - F.min(live(F.col("turn"))) + 1 - number(F.col("fresh")), F.lit(0)).cast("long").alias("gaps"),
        *[number(F.col("fault").eqNullSafe(x)).alias(x) for x in ("blank", "duplicate", "truncated")],
        number(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(one)).alias("turns"),
    )
    of = of.withColumn("best", _cheapest(F.col("turns"), chunk))
    return of.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate("best.path", "JS", "IR").alias("audit"), F.array_join(_lines(F.col("turns"), F.col("best.path")), "\n").alias("repaired")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


#: The unsigned crc32 of an ASCII string in a column, by the table ``crc``, which a query gets from CRC_TABLE.
CRC_TABLE = """crcs AS (SELECT i, i AS c, 0 AS r FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM crcs WHERE r < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crcs WHERE r = 8)"""


def sql_crc32(of: str) -> str:
    codes = f"list_transform(string_split({of}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


_ADD = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'p': {s}.p || {letter}, 't': {line}}}"
_LEAST = lambda *of: f"list_min([{', '.join(of)}])"
_INF = f"{{'c': {_NEVER}, 'p': '', 't': []::VARCHAR[]}}"
_SAID = lambda s, role, name: f"CASE WHEN fault IN (1, 2) THEN {_INF} WHEN initial = '{role}' THEN {_ADD(s, 'extra', "'K'", f"list_append({s}.t, role || ':' || text)")} ELSE {_ADD(s, 'extra + 2', "'R'", f"list_append({s}.t, '{name}:' || text)")} END"
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair FROM e),
m AS (SELECT *, k > min(k) OVER (PARTITION BY conv_id, role, text) AS again FROM n),
f AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS extra FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN again THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM m)),
s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'p': '', 't': []::VARCHAR[]}} AS a, {{'c': {_NEVER}::BIGINT, 'p': '', 't': []::VARCHAR[]}} AS b,
    {{'c': 2::BIGINT, 'p': 'I', 't': ['user:']}} AS u, {{'c': 4::BIGINT, 'p': 'II', 't': ['user:', 'assistant:']}} AS v FROM conversations
  UNION ALL
  SELECT conv_id, k, a, b, u, {_LEAST("v", _ADD("u", 2, "'I'", "list_append(u.t, 'assistant:')"))} AS v FROM (
    SELECT conv_id, k, a, b, v, {_LEAST("u", _ADD("x", 2, "'I'", "list_append(x.t, 'user:')"))} AS u FROM (
      SELECT *, {_LEAST("a", "b", "v")} AS x FROM (
        SELECT conv_id, k, {_ADD("a", 3, "'D'", "a.t")} AS a,
          {_LEAST(_ADD("b", 3, "'D'", "b.t"), f"CASE WHEN fault NOT IN (1, 2) AND initial = 's' THEN {_ADD('a', 'extra', "'K'", "list_append(a.t, role || ':' || text)")} ELSE {_INF} END")} AS b,
          {_LEAST(_ADD("u", 3, "'D'", "u.t"), _SAID("x", "u", "user"))} AS u, {_LEAST(_ADD("v", 3, "'D'", "v.t"), _SAID("u", "a", "assistant"))} AS v
        FROM (SELECT s.conv_id, f.k, s.a, s.b, s.u, s.v, {_LEAST("s.a", "s.b", "s.v")} AS x, f.fault, f.extra, f.initial, f.role, f.text
          FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k + 1))))),
best AS (SELECT conv_id, {_LEAST("a", "v")} AS x FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  x.c AS cost, x.p AS audit, sha256(array_to_string(x.t, chr(10))) AS repaired_sha256
FROM best LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM best.conv_id
"""
