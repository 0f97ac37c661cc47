"""Quotation linking in conversations: quote levels, passage hashes, originals, and reply order without quotes.

Lines that begin with > are quoted, one level for each > (blanks between them are allowed). Neighbouring lines of one level
are a passage. Lines and passages, stripped of their marks and normalised (white space to single blanks, A-Z in lower case),
are joined by hash to the latest earlier message of the conversation that wrote the same line or passage itself; a line goes
by its own link or else by its passage's, which a new wrapping of its lines does not change. A message replies to the
message that most of its first-level lines come from, the latest of equals. Without such a line, nested levels decide: a
line of level k points to the latest earlier message that has it at level k - 1, since that is what was quoted once more.
Without any link a message replies to the one before it. Reply order is the preorder
of that forest, replies to one message by turn: an Euler tour ranked by pointer doubling, in rounds logarithmic in the
longest conversation, so that no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

BUCKET = 256
_MARKS = r"^[ \t]*>[ \t>]*"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", "")).cast("long")


def normal(line: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"[\x20\x09-\x0D]+", " ")
    return F.translate(F.trim(body), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unquoted(text: Column) -> Column:
    """The lines of level 0, without blank lines at the ends."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: level(x) == 0)
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def _before(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """df with `last`, the greatest value of earlier rows (by seq) of the same keys; rows of a key are split by blocks of seq."""
    df = df.withColumn("value", value).withColumn("bucket", F.floor(F.col("seq") / BUCKET))
    up = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "bucket").agg(F.max("value").alias("m")).withColumn("earlier", F.max("m").over(up)).drop("m")
    within = Window.partitionBy(*keys, "bucket").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("inside", F.max("value").over(within)).join(sums, [*keys, "bucket"]).withColumn("last", F.coalesce(F.greatest("inside", "earlier"), "inside", "earlier")).drop("value", "inside", "earlier", "bucket")


def numbered(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with seq, their place among all that have both keys, in order of conversation, turn,
    role and text, null first; null for the others. Whatever turns are, and however often one repeats, places differ. Rows
    are sorted by ranges (a running number parts equal rows), and ranges are counted."""
    order = ["conv_id", "turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    good = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = messages.where(good).withColumn("salt", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    whole = stored(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "messages")
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = whole.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"))
    seq = (F.col("before") + F.col("at")).alias("seq")
    named = whole.join(F.broadcast(before), "part").select("conv_id", "turn", "role", "text", seq)  # a row a range
    return named.unionByName(messages.where(~good).withColumn("seq", F.lit(None).cast("long")))


def _origins(rows: DataFrame, hashes: list[str]) -> DataFrame:
    """rows (conv_id, seq, asks, ..) with `last`, the place and turn of the latest earlier row of the same hashes that doesn't ask."""
    asked = rows.where("asks").select("conv_id", *hashes).distinct()
    known = rows.join(asked, ["conv_id", *hashes], "left_semi")
    return _before(known, ["conv_id", *hashes], F.when(~F.col("asks"), F.struct("seq", "turn"))).where("asks")


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, role, parent_seq, parent_turn, n_quoted, n_linked, text) for each row of messages (conv_id, turn, role, text).

    seq is a message's place, in order of conversation and turn (any whole numbers), and of rows that repeat a turn by role and
    text, null first. n_quoted counts quoted lines that aren't blank, n_linked those of them that an earlier message wrote
    itself, as a line or within a passage. text has no quotes; a null text is empty. Rows with a null conv_id or turn belong
    to no conversation: no seq, parent or link."""
    m = stored(numbered(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")), "numbered")
    placed = m.where("seq IS NOT NULL")
    lines = placed.select("conv_id", "seq", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    lines = lines.select("conv_id", "seq", "turn", "i", level(F.col("line")).alias("level"), normal(F.col("line")).alias("body"))
    # a passage ends where the level changes or a line is blank; windows and groups hold one message's lines
    order = Window.partitionBy("seq").orderBy("i")
    fresh = (F.col("body") == "") | (F.lag("body").over(order) == "") | (F.lag("level").over(order) != F.col("level"))
    lines = lines.withColumn("passage", F.sum(F.coalesce(fresh.cast("long"), F.lit(1))).over(order)).where("body <> ''")
    lines = lines.select("conv_id", "seq", "turn", "i", "level", "passage", F.xxhash64("body").alias("h"), F.crc32("body").alias("h2"), "body")
    lines = stored(lines, "lines")
    runs = lines.groupBy("conv_id", "seq", "turn", "passage").agg(F.first("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), " ").alias("whole"))
    runs = runs.select("conv_id", "seq", "turn", "passage", "level", F.xxhash64("whole").alias("p"), F.crc32("whole").alias("p2"))
    own = F.col("level") > 0
    of_line = _origins(lines.select("conv_id", "seq", "turn", "i", "level", "passage", "h", "h2", own.alias("asks")), ["h", "h2"])
    of_run = _origins(runs.select("conv_id", "seq", "turn", "passage", "p", "p2", own.alias("asks")), ["p", "p2"]).select("conv_id", "seq", "passage", F.col("last").alias("run_last"))
    told = of_line.join(of_run, ["conv_id", "seq", "passage"], "left").withColumn("last", F.coalesce("last", "run_last"))
    told = stored(told.select("conv_id", "seq", "turn", "i", "level", "h", "h2", "last"), "told")
    # a line of level k asks at k - 1 for who has it there
    deep = told.where("level > 1").select("conv_id", "seq", "turn", (F.col("level") - 1).alias("at"), "h", "h2", F.lit(True).alias("asks"))
    has = lines.where("level > 0").select("conv_id", "seq", "turn", F.col("level").alias("at"), "h", "h2", F.lit(False).alias("asks"))
    nested = _origins(deep.unionByName(has), ["at", "h", "h2"])
    votes = told.where("level = 1 AND last IS NOT NULL").select("conv_id", "seq", F.lit(1).alias("first"), "last").unionByName(nested.where("last IS NOT NULL").select("conv_id", "seq", F.lit(0).alias("first"), "last"))
    votes = votes.groupBy("conv_id", "seq", "first", "last").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("conv_id", "seq").agg(F.max(F.struct("first", "n", "last"))["last"].alias("origin"))
    counts = told.groupBy("conv_id", "seq").agg(F.count("*").alias("n_quoted"), F.count("last").alias("n_linked"))
    previous = _before(placed.select("conv_id", "seq", "turn"), ["conv_id"], F.struct("seq", "turn")).select("conv_id", "seq", F.col("last").alias("previous"))
    found = previous.join(chosen, ["conv_id", "seq"], "left").join(counts, ["conv_id", "seq"], "left")
    parent = F.coalesce("origin", "previous")
    return m.join(found, ["conv_id", "seq"], "left").select(
        "conv_id", "turn", "seq", "role", parent["seq"].alias("parent_seq"), parent["turn"].alias("parent_turn"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), unquoted(F.col("text")).alias("text"),
    )


def reply_order(nodes: DataFrame) -> DataFrame:
    """(conv_id, seq, place): the preorder place of each node of nodes (conv_id, seq, parent_seq), from 0; roots stand by seq."""
    up = F.coalesce("parent_seq", F.lit(-1))
    n = nodes.select("conv_id", "seq", up.alias("up"))
    # siblings are linked in order; each node is entered (+) and left (-), a tour runs through both
    after = _before(n.select("conv_id", "up", (-F.col("seq")).alias("seq")), ["conv_id", "up"], F.col("seq")).select("conv_id", (-F.col("seq")).alias("seq"), (-F.col("last")).alias("sibling"))
    child = n.where("up >= 0").groupBy("conv_id", "up").agg(F.min("seq").alias("child")).withColumnRenamed("up", "seq")
    t = n.join(after, ["conv_id", "seq"]).join(child, ["conv_id", "seq"], "left")
    down, out = F.col("seq") * 2, F.col("seq") * 2 + 1
    tour = t.select("conv_id", F.explode(F.array(
        F.struct(down.alias("x"), F.coalesce(F.col("child") * 2, out).alias("to"), F.lit(1).cast("long").alias("w")),
        F.struct(out.alias("x"), F.when(F.col("sibling").isNotNull(), F.col("sibling") * 2).when(F.col("up") >= 0, F.col("up") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("w")),
    )).alias("e")).select("conv_id", "e.*")
    tour = stored(tour, "tour")
    while not tour.where("to IS NOT NULL").isEmpty():
        ahead = tour.select("conv_id", F.col("x").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"))
        moved = tour.where("to IS NOT NULL").join(ahead, ["conv_id", "to"]).select("conv_id", "x", F.col("to2").alias("to"), (F.col("w") + F.col("w2")).alias("w"))
        tour = stored(moved.unionAll(tour.where("to IS NULL").select("conv_id", "x", "to", "w")), "tour")
    size = nodes.groupBy("conv_id").agg(F.count("*").alias("size"))
    return tour.where("x % 2 = 0").join(size, "conv_id").select("conv_id", (F.col("x") / 2).cast("long").alias("seq"), (F.col("size") - F.col("w")).alias("place"))


def conversations(messages: DataFrame) -> DataFrame:
    """linked() with place, the message's place in its conversation's reply order, from 0."""
    told = stored(linked(messages), "linked")
    order = reply_order(told.where("seq IS NOT NULL"))
    return told.join(order, ["conv_id", "seq"], "left").select("conv_id", "place", "turn", "role", "parent_turn", "n_quoted", "n_linked", "text")


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same in DuckDB, for tables that repeat no (conv_id, turn) and hold no null key.
SQL = r"""
    WITH RECURSIVE lines AS (
        SELECT conv_id, turn, i, len(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
            translate(trim(regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body, line
        FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)),
    marked AS (SELECT *, coalesce(body = '' OR lag(body) OVER w = '' OR lag(level) OVER w <> level, true)::INT AS fresh FROM lines WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
    parts AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage FROM marked),
    passages AS (SELECT conv_id, turn, passage, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS whole FROM parts WHERE body <> '' GROUP BY ALL),
    run_told AS (
        SELECT q.conv_id, q.turn, q.passage, max(o.turn) AS origin
        FROM passages q JOIN passages o ON o.conv_id = q.conv_id AND o.whole = q.whole AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
    told AS (
        SELECT q.conv_id, q.turn, q.i, q.level, coalesce(max(o.turn), any_value(r.origin)) AS origin
        FROM parts q LEFT JOIN lines o ON o.conv_id = q.conv_id AND o.body = q.body AND o.level = 0 AND o.turn < q.turn
        LEFT JOIN run_told r ON r.conv_id = q.conv_id AND r.turn = q.turn AND r.passage = q.passage
        WHERE q.level > 0 AND q.body <> '' GROUP BY ALL),
    nested AS (
        SELECT q.conv_id, q.turn, q.i, max(o.turn) AS origin
        FROM lines q JOIN lines o ON o.conv_id = q.conv_id AND o.body = q.body AND o.level = q.level - 1 AND o.turn < q.turn
        WHERE q.level > 1 AND q.body <> '' GROUP BY ALL),
    votes AS (
        SELECT conv_id, turn, 1 AS first, origin FROM told WHERE level = 1 AND origin IS NOT NULL
        UNION ALL SELECT conv_id, turn, 0, origin FROM nested),
    chosen AS (
        SELECT conv_id, turn, origin FROM (
            SELECT conv_id, turn, origin, row_number() OVER (PARTITION BY conv_id, turn ORDER BY first DESC, count(*) DESC, origin DESC) AS k
            FROM votes GROUP BY conv_id, turn, first, origin) WHERE k = 1),
    counts AS (SELECT conv_id, turn, count(*) AS n_quoted, count(origin) AS n_linked FROM told GROUP BY conv_id, turn),
    own AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS text FROM lines GROUP BY conv_id, turn),
    tree AS (
        SELECT c.conv_id, c.turn, c.role, coalesce(h.origin, lag(c.turn) OVER (PARTITION BY c.conv_id ORDER BY c.turn)) AS parent
        FROM conversations c LEFT JOIN chosen h USING (conv_id, turn)),
    paths(conv_id, turn, path) AS (
        SELECT conv_id, turn, [turn] FROM tree WHERE parent IS NULL
        UNION ALL SELECT t.conv_id, t.turn, list_append(p.path, t.turn) FROM paths p JOIN tree t ON t.conv_id = p.conv_id AND t.parent = p.turn)
    SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY p.path) - 1 AS place, t.turn, t.role, t.parent AS parent_turn,
        coalesce(n.n_quoted, 0) AS n_quoted, coalesce(n.n_linked, 0) AS n_linked, o.text
    FROM tree t JOIN paths p USING (conv_id, turn) JOIN own o USING (conv_id, turn) LEFT JOIN counts n USING (conv_id, turn)"""
