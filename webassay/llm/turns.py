"""Repair of conversations by a Spark SQL higher-order fold over sorted turns.

Rows are put in the order of conversation and turn by a range exchange and
numbered; runs of CHUNK numbers are segments, so a conversation of any length
is spread over many of them. Windows over segments flag what is wrong with
each row. The sorted turn structs of a segment are folded by ``aggregate()``,
which carries four (cost, audit) structs, the cheapest edits that leave the
roles at: nothing yet, system, user, assistant. ``least`` on structs takes the
lower cost and, of equal costs, the ASCII-least audit. Edits so far never decide
about ties later: of two audits of equal cost over the same rows neither
begins with the other.

A segment that begins inside a conversation is folded from each of the four
states. Segments of one conversation are then composed in their order, up to 256
at a time, in rounds over ever fewer nodes. Two inserts in a row are never
cheapest (the roles before them go on alike without both), so one is tried
before each row and one at the end.

Nulls and edges: a null role or text is one space, as are null numbers in the
key of the damage. Null turns come first; a null conv_id is a conversation of
its own. Rows of one turn follow the sha256 of ``role:text``, then the role; so
copies are adjacent. Repeated rows are repeated turns. A row whose role is
empty has no initial and can't be kept. Other columns aren't looked at. An
empty table gives an empty result. Texts may be long: they only pass by, in
order, when lines are replayed; a digest of a whole conversation is made by one
task, as its definition is sequential, in memory that doesn't grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webassay.llm import common

#: Rows in a segment, and nodes that one round composes: powers of two.
CHUNK, FAN = 256, 256
STATES = "esua"
DELETE, RENAME, INSERT, TRUNCATED, NEVER = 2, 1, 5, 5, 10**15
FAULTS = ("blank", "duplicate", "truncated")
PAIRS = ("su", "ua", "au")
SEEN = f"[^{common.SPACE}]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of (conv_id, turn, role, text), a twentieth of the rows each dropped, emptied, bared, repeated, and given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def in_order(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, role, text, line (sha256 of role:text), pos (rises with the order), seg."""
    keyed = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("line", F.sha2(F.concat("role", F.lit(":"), "text"), 256))
    # Rows alike in everything may be told apart by any number: so a third of a table in one turn is still cut into ranges.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "line", "role", "any"]
    placed = keyed.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return common.checkpoint(placed.drop("any").withColumn("pos", F.monotonically_increasing_id()).withColumn("seg", F.expr(f"pos div {chunk}")))


def flagged(ordered: DataFrame) -> DataFrame:
    """conv_id, seg, inside, pos, turn, initial, fault, illegal, same_turn: without texts. ``inside``: the segment begins inside a conversation."""
    seen = ordered.select("conv_id", "seg", "pos", "turn", "role", "line", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(SEEN)).alias("blank"), (~F.col("text").rlike(rf"[.!?][{common.SPACE}]*\z")).alias("truncated"))
    own = W.partitionBy("conv_id", "seg")
    before = lambda c: F.lag(c).over(own.orderBy("pos"))
    rank = F.row_number().over(W.partitionBy("conv_id", "seg", "role", "line").orderBy("pos"))
    local = seen.select("*", (rank > 1).alias("again"), before("initial").alias("last"), before("turn").alias("last_turn"))
    local = common.checkpoint(local.select("*", F.coalesce(~F.concat("last", "initial").isin(*PAIRS), F.lit(False)).alias("illegal"), F.coalesce(F.col("turn") != F.col("last_turn"), F.col("turn").isNotNull()).alias("new_turn")).drop("last", "last_turn"))
    # Conversations of several segments: what an earlier segment has seen as well. One row for each segment and text takes part.
    cut = common.sized(common.checkpoint(local.groupBy(F.col("conv_id").alias("c")).agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg")).where("first_seg < last_seg").drop("last_seg")))
    several = local.where("not again").join(cut, F.expr("conv_id <=> c"), "left_semi")
    later = several.select("pos", F.row_number().over(W.partitionBy("conv_id", "role", "line").orderBy("pos")).alias("k")).where("k > 1").select("pos", F.lit(True).alias("met"))
    known = local.join(common.sized(common.checkpoint(later)), "pos", "left").join(cut, F.expr("conv_id <=> c"), "left")
    fault = F.when(F.col("blank"), FAULTS[0]).when(F.col("again") | F.col("met").isNotNull(), FAULTS[1]).when(F.col("truncated"), FAULTS[2]).otherwise("")
    return known.select("conv_id", "seg", F.coalesce(F.col("seg") > F.col("first_seg"), F.lit(False)).alias("inside"), "pos", "turn", "initial", fault.alias("fault"), "illegal", "new_turn")


def edit(path: Column, cost: Column | int, letter: Column | str) -> Column:
    """A (cost, audit) struct after one more edit."""
    return F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], letter if isinstance(letter, Column) else F.lit(letter)).alias("audit"))


def states(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def no_path(cost: int = NEVER) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))


def turned(acc: Column, turn: Column) -> Column:
    """The four paths after one row: an insert before it or none, then its edit."""
    gone, cut = turn["fault"].isin("blank", "duplicate"), F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    at_user = F.least(acc["u"], edit(acc["e"], INSERT, "I"), edit(acc["s"], INSERT, "I"), edit(acc["a"], INSERT, "I"))
    at_assistant = F.least(acc["a"], edit(acc["u"], INSERT, "I"))

    def moved(initial: str, here: Column, come: Column) -> Column:
        """Stay by deletion, or come with this row, under its own initial or a new one."""
        same = turn["initial"] == initial
        new = same if initial == "s" else F.lit(True)
        kept = edit(come, F.when(same, 0).otherwise(RENAME) + cut, F.when(same, "K").otherwise("R"))
        return F.when(gone | ~new, edit(here, DELETE, "D")).otherwise(F.least(edit(here, DELETE, "D"), kept))

    return common.let(F.struct(at_user.alias("u"), at_assistant.alias("a")), lambda now: states(edit(acc["e"], DELETE, "D"), moved("s", acc["s"], acc["e"]), moved("u", now["u"], F.least(acc["e"], acc["s"], now["a"])), moved("a", now["a"], now["u"])))


def segments(flags: DataFrame) -> DataFrame:
    """conv_id, node (seg), and what composing needs: counts, both ends, and for each state at the start the four paths."""
    turns = F.array_sort(F.collect_list(F.struct("pos", "initial", "fault")))
    count = lambda c: F.count_if(c).alias
    held = flags.groupBy("conv_id", F.col("seg").alias("node"), "inside").agg(turns.alias("turns"), *[count(F.col("fault") == f)(f) for f in FAULTS], count(F.col("illegal"))("illegal"), F.min("turn").alias("least_turn"), F.max("turn").alias("most_turn"), count(F.col("new_turn"))("n_turns"))
    begin = lambda at: states(*[F.when(at == i, no_path(0)).otherwise(no_path()) for i in range(4)])
    fold = lambda at: F.aggregate("turns", begin(at), turned)
    starts = F.when(F.col("inside"), F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0)))
    return held.select("conv_id", "node", *FAULTS, "illegal", "least_turn", "most_turn", "n_turns", F.element_at("turns", 1)["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"), F.transform(starts, fold).alias("paths"))


def joined(one: Column, two: Column) -> Column:
    """Two neighbouring nodes as one."""
    then = lambda x, y: F.struct((x["cost"] + y["cost"]).alias("cost"), F.concat(x["audit"], y["audit"]).alias("audit"))
    over = lambda row: states(*[F.least(*[then(row[m], two["paths"][i][z]) for i, m in enumerate(STATES)]) for z in STATES])
    plus = lambda k: (one[k] + two[k]).alias(k)
    wrong = F.when(F.concat(one["last"], two["first"]).isin(*PAIRS), 0).otherwise(1)
    repeat = F.when(one["most_turn"] == two["least_turn"], 1).otherwise(0)
    return F.struct(two["node"].alias("node"), *map(plus, FAULTS), (one["illegal"] + two["illegal"] + wrong).alias("illegal"), F.coalesce(one["least_turn"], two["least_turn"]).alias("least_turn"), F.coalesce(two["most_turn"], one["most_turn"]).alias("most_turn"), (one["n_turns"] + two["n_turns"] - repeat).alias("n_turns"), one["first"].alias("first"), two["last"].alias("last"), F.transform(one["paths"], over).alias("paths"))


def composed(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """One node for each conversation. A round composes neighbours whose numbers agree but for the last bits."""
    fields = nodes.columns[1:]
    done = None
    while True:
        nodes = common.checkpoint(nodes)
        several = common.sized(common.checkpoint(nodes.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("k")).where("k > 1").select("c")))
        alone = nodes.join(several, F.expr("conv_id <=> c"), "left_anti")
        done = alone if done is None else done.unionByName(alone)
        rest = nodes.join(several, F.expr("conv_id <=> c"), "left_semi")
        if rest.isEmpty():
            return done
        held = rest.groupBy("conv_id", F.expr(f"node div {fan}").alias("up")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))
        one = F.aggregate(F.slice("nodes", 2, F.size("nodes")), F.element_at("nodes", 1), joined)
        nodes = held.select("conv_id", "up", one.alias("x")).select("conv_id", F.col("up").alias("node"), *[f"x.{f}" for f in fields[1:]])


def judged(ordered: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of the conversations in ``ordered``."""
    nodes = composed(segments(flagged(ordered)), fan)
    at = F.col("paths")[0]
    best = F.least(at["e"], at["a"], edit(at["u"], INSERT, "I"))
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    return nodes.select("conv_id", gaps.alias("gaps"), *FAULTS, "illegal", best.alias("best")).select("conv_id", "gaps", *FAULTS, "illegal", "best.cost", "best.audit")


def replayed(ordered: DataFrame, audits: DataFrame, schema: str, begin: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Rows of each conversation in order, behind a first one with its audit (conv_id, audit), handed to ``begin``'s pair of step and end."""
    none = lambda t: F.lit(None).cast(t)
    rows = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", none("string").alias("role"), none("string").alias("text")).unionByName(ordered.select("conv_id", "pos", none("string").alias("audit"), "role", "text"))
    return common.map_rows(rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), None, schema, final=begin)


class Replay:
    """The lines that a conversation's edits give, one row after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def line(self, letter: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.out += 1
        return self.out, letter, role if letter == "K" else ("assistant", "user")[(self.out - self.system) % 2], text

    def inserts(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.line("I", "", "")

    def row(self, role: str, text: str):
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter != "D":
            yield self.line(letter, role, text)


def walk(emit: Callable[[object, Replay, tuple], None], close: Callable[[object], None], take: Callable[[], dict]):
    """Step and end for ``replayed``: ``emit`` gets each line, ``close`` the key of each conversation that is over, ``take`` hands on what came of it."""
    now: list = [None, None]

    def over():
        if now[1]:
            for line in now[1].inserts():
                emit(now[0], now[1], line)
            close(now[0])

    def step(c):
        for key, audit, role, text in zip(c["conv_id"], c["audit"], c["role"], c["text"]):
            if audit is not None:
                over()
                now[:] = key, Replay(audit)
            else:
                for line in now[1].row(role, text):
                    emit(key, now[1], line)
        return take()

    def end():
        over()
        yield take()

    return step, end


def digests(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired lines ``role:text``, joined by line feeds."""

    def begin():
        sha, out = [hashlib.sha256()], {"conv_id": [], "repaired_sha256": []}

        def emit(key, replay, line):
            n, _, role, text = line
            sha[0].update(("\n" * (n > 1) + f"{role}:{text}").encode("utf-8", "surrogatepass"))

        def close(key):
            out["conv_id"].append(key)
            out["repaired_sha256"].append(sha[0].hexdigest())
            sha[0] = hashlib.sha256()

        def take():
            got = {k: v[:] for k, v in out.items()}
            for v in out.values():
                v.clear()
            return got

        return walk(emit, close, take)

    return replayed(ordered, audits, "conv_id long, repaired_sha256 string", begin)


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, n (from 1), edit (K, R or I), role, text: the turns of (conv_id, turn, role, text) after the cheapest edits."""
    ordered = in_order(rows, chunk)

    def begin():
        out = {k: [] for k in ("conv_id", "n", "edit", "role", "text")}

        def take():
            got = {k: v[:] for k, v in out.items()}
            for v in out.values():
                v.clear()
            return got

        def emit(key, replay, line):
            for k, v in zip(out, (key, *line)):
                out[k].append(v)

        return walk(emit, lambda key: None, take)

    return replayed(ordered, judged(ordered).select("conv_id", "audit"), "conv_id long, n long, edit string, role string, text string", begin)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations")
    ordered = in_order(damaged(rows))
    found = common.checkpoint(judged(ordered))
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = rows.select("conv_id").distinct().join(named(found, "f"), F.expr("conv_id <=> f"), "left").join(named(digests(ordered, found), "d"), F.expr("conv_id <=> d"), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, {_CRC} % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM c)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || ':' || text), role) AS i, left(role, 1) AS initial FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, i > min(i) OVER (PARTITION BY conv_id, role, text) AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS bad FROM o),
g AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS extra FROM f),
r(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 't': ''}}, {{'c': 1000000::BIGINT, 't': ''}}, {{'c': 1000000::BIGINT, 't': ''}}, {{'c': 1000000::BIGINT, 't': ''}} FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, i, {{'c': e.c + 2, 't': e.t || 'D'}},
    CASE WHEN gone OR initial <> 's' THEN {{'c': s.c + 2, 't': s.t || 'D'}} ELSE least({{'c': s.c + 2, 't': s.t || 'D'}}, {{'c': e.c + extra, 't': e.t || 'K'}}) END,
    CASE WHEN gone THEN {{'c': v.c + 2, 't': v.t || 'D'}} ELSE least({{'c': v.c + 2, 't': v.t || 'D'}}, {{'c': b.c + extra + (initial <> 'u')::INT, 't': b.t || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END}}) END,
    CASE WHEN gone THEN {{'c': w.c + 2, 't': w.t || 'D'}} ELSE least({{'c': w.c + 2, 't': w.t || 'D'}}, {{'c': v.c + extra + (initial <> 'a')::INT, 't': v.t || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END}}) END
  FROM (SELECT *, least(e, s, w) AS b FROM (SELECT g.conv_id, g.i, gone, extra, initial, e, s,
    least(u, {{'c': e.c + 5, 't': e.t || 'I'}}, {{'c': s.c + 5, 't': s.t || 'I'}}, {{'c': a.c + 5, 't': a.t || 'I'}}) AS v, least(a, {{'c': u.c + 5, 't': u.t || 'I'}}) AS w
    FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))),
z AS (SELECT conv_id, least(e, a, {{'c': u.c + 5, 't': u.t || 'I'}}) AS best FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
l AS (SELECT conv_id, p, best.t[p] AS letter, length(replace(best.t[:p], 'I', '')) AS i, length(replace(best.t[:p], 'D', '')) - length(replace(best.t, 'D', '')) % 2 AS n FROM (SELECT *, unnest(range(1, length(best.t) + 1)) AS p FROM z)),
h AS (SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN g.role WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE g.text END, chr(10) ORDER BY p) AS lines
  FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (extra > 0) AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.t, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM x.conv_id"""
