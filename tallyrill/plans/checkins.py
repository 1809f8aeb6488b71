"""Queries over check-ins: what changed between a machine's snapshots (p7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators.snapshots import snapshot_changes
from tallyrill.session import table

#: Seconds of a block of a machine's history.
HISTORY_BLOCK_S = 90 * 24 * 3600


def platform(value: Column | str) -> Column:
    """Letters only, lower case, then the two known platforms as they are written; null reads as empty."""
    given = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    letters = F.lower(F.regexp_replace(given, "[^A-Za-z]", ""))
    return F.when(given.isin("claude_code", "claude_desktop"), given).otherwise(F.regexp_replace(letters, "^claude(code|desktop)$", "claude_$1"))


def with_machine(checkins: DataFrame) -> DataFrame:
    """Check-ins with ``machine``: the hostname, which never changes and is never shared; where it is missing, the
    hostname seen with the machine_id, else the machine_id itself. Rows with neither are dropped.

    Where no hostname is missing, as the files' own statistics mostly tell, nothing is looked up."""
    named = checkins.where(F.col("hostname").isNotNull()).withColumn("machine", F.col("hostname"))
    nameless = checkins.where(F.col("hostname").isNull() & F.col("machine_id").isNotNull())
    if nameless.isEmpty():
        return named
    seen = checkins.where(F.col("hostname").isNotNull() & F.col("machine_id").isNotNull()).groupBy("machine_id").agg(F.min("hostname").alias("_host"))
    found = nameless.join(seen, "machine_id", "left").withColumn("machine", F.coalesce("_host", F.concat(F.lit("id:"), "machine_id"))).drop("_host")
    return named.unionByName(found)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every skill and server added, removed or changed from one check-in of a machine to its next.

    Of copies of a snapshot the smallest checkin_id counts, whatever its lists hold, so copies are found before null
    lists are passed over. A check-in holds a list of each kind, and each list is a snapshot of its own: of the source
    (kind, machine), told apart by 2 * checkin_id + kind."""
    checkins = table(spark, folder, "checkins")
    text = lambda c: F.coalesce(c, F.lit(""))
    # one number orders copies by checkin_id and says which lists there are
    given = F.col("checkin_id") * 4 + F.col("installed_skills").isNotNull().cast("int") * 2 + F.col("installed_mcp_servers").isNotNull().cast("int")
    copies = with_machine(checkins).where("machine is not null and checked_in_at is not null").groupBy("machine", "checked_in_at").agg(F.min(given).alias("kept"))
    each = F.array_compact(F.array(F.when(F.col("kept").bitwiseAND(F.lit(2)) != 0, F.lit(0)), F.when(F.col("kept").bitwiseAND(F.lit(1)) != 0, F.lit(1))))
    snapshots = copies.select("machine", F.col("checked_in_at").alias("taken_at"), F.shiftright("kept", 2).alias("checkin_id"), F.explode(each).alias("n")).select(F.concat_ws("/", "n", "machine").alias("source"), "taken_at", (F.col("checkin_id") * 2 + F.col("n")).alias("snapshot_id"))
    items = lambda n, kind, column, one, two: checkins.select("checkin_id", F.explode(column).alias("i")).where("i is not null").select(
        (F.col("checkin_id") * 2 + n).alias("snapshot_id"), F.lit(kind).alias("item_kind"), F.trim(text(F.col("i.name"))).alias("name"), text(F.col("i.source")).alias("source"), platform("i.platform").alias("platform"), one.alias("one"), two.alias("two")
    )
    both = items(0, "skill", "installed_skills", F.lower(text(F.col("i.hash"))), F.lit("")).unionByName(items(1, "server", "installed_mcp_servers", text(F.col("i.type")), text(F.col("i.command"))))
    block = F.floor(F.unix_seconds("taken_at") / HISTORY_BLOCK_S)
    changes = snapshot_changes(snapshots, both, ["item_kind", "name", "source", "platform"], ["one", "two"], block, single=True)
    return changes.select(F.expr("snapshot_id div 2").alias("checkin_id"), "item_kind", "name", "source", "platform", "change")


_ITEM = """trim(coalesce(i.name, '')) AS name, coalesce(i.source, '') AS source,
  CASE lower(regexp_replace(coalesce(i.platform, ''), '[^A-Za-z]', '', 'g')) WHEN 'claudecode' THEN 'claude_code' WHEN 'claudedesktop' THEN 'claude_desktop'
    ELSE lower(regexp_replace(coalesce(i.platform, ''), '[^A-Za-z]', '', 'g')) END AS platform"""

QUERIES = {"p7_found": p7_found}

SQL = {
    "p7_found": f"""WITH snaps AS (SELECT coalesce(hostname, machine_id) AS machine, checked_in_at, min(checkin_id) AS checkin_id FROM checkins GROUP BY ALL),
  kept AS (SELECT machine, c.* FROM snaps JOIN checkins c USING (checkin_id)),
  chains AS (SELECT 'skill' AS item_kind, machine, checkin_id, row_number() OVER w AS pos, lead(checkin_id) OVER w AS next_id FROM kept WHERE installed_skills IS NOT NULL WINDOW w AS (PARTITION BY machine ORDER BY checked_in_at)
    UNION ALL SELECT 'server', machine, checkin_id, row_number() OVER w, lead(checkin_id) OVER w FROM kept WHERE installed_mcp_servers IS NOT NULL WINDOW w AS (PARTITION BY machine ORDER BY checked_in_at)),
  raw AS (SELECT 'skill' AS item_kind, checkin_id, {_ITEM}, lower(coalesce(i.hash, '')) AS v FROM (SELECT checkin_id, unnest(installed_skills) AS i FROM kept) WHERE i IS NOT NULL
    UNION ALL SELECT 'server', checkin_id, {_ITEM}, coalesce(i.type, '') || '|' || coalesce(i.command, '') FROM (SELECT checkin_id, unnest(installed_mcp_servers) AS i FROM kept) WHERE i IS NOT NULL),
  items AS (SELECT item_kind, machine, pos, checkin_id, next_id, name, source, platform, string_agg(DISTINCT v, '~' ORDER BY v) AS v FROM raw JOIN chains USING (item_kind, checkin_id) GROUP BY ALL)
  SELECT a.checkin_id, a.item_kind, a.name, a.source, a.platform, CASE WHEN b.v IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM items a LEFT JOIN items b ON a.item_kind = b.item_kind AND a.machine = b.machine AND a.pos = b.pos + 1 AND a.name = b.name AND a.source = b.source AND a.platform = b.platform
  WHERE a.pos > 1 AND a.v IS DISTINCT FROM b.v
  UNION ALL SELECT a.next_id, a.item_kind, a.name, a.source, a.platform, 'removed'
  FROM items a LEFT JOIN items b ON a.item_kind = b.item_kind AND a.machine = b.machine AND a.pos = b.pos - 1 AND a.name = b.name AND a.source = b.source AND a.platform = b.platform
  WHERE a.next_id IS NOT NULL AND b.v IS NULL""",
}
