"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all words;
a target stops at twice its source's size and the excess is shared again by weight.

Each source's documents are put in a hash order and form one stream of words, which is cut into
blocks of `block` words. The schedule is a row of slots: slot t has the golden-ratio point
frac(t x phi) (32-bit integers), which falls into one source's stretch of the cumulative weights.
The slots of a source are ranked; rank r takes block r modulo the source's blocks, so blocks
repeat only after all were taken, and the last rank takes the words that are left to the target.
Positions in a stream and ranks are prefix sums in two levels (hash buckets, chunks of slots),
so no source is sorted in one task. Every source gets MARGIN slots beyond its need: the count of
points in a stretch misses its share by O(log slots), far below that, and a count proves it.

Defined cases: null text has size 0; a very long text fills as many blocks as its words need;
documents that tie in the hash order follow doc_id, text and size; texts without words are in the result with taken 0; null
source is a source of its own, last; null doc_id and repeated rows are rows like any other;
if no text has a word all targets are 0; an empty table gives an empty result; other columns
are ignored here and kept by `mixed_documents`.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_map, materialize, small

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
BLOCK, BUCKETS, CHUNK, MARGIN = 4096, 4096, 65536, 64
PHI32 = 2654435769  # 2^32 / golden ratio
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)


def sizes(docs: DataFrame) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), size.alias("size"), h.alias("h"), (h % BUCKETS).alias("bucket"))


def targets(sized: DataFrame) -> DataFrame:
    """A row for each source: none, src, source_size, target. Windows run over sources only."""
    s = sized.groupBy("none", "src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("none", "src"))
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.select("*", rank.alias("ord"), w.cast("double").alias("w"), (F.col("source_size") * float(LIMIT)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "ord")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * SHARE
    s = s.select("*", total.alias("all"), ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)).alias("level"))
    # sorted by cap over weight the stopped sources come first: the first source that its level
    # leaves below its cap fixes the level of all that follow
    place = F.struct((F.col("cap") / F.col("w")).alias("ratio"), "ord")
    free = F.col("cap") > F.col("w") * F.col("level") * (1 + 1e-12)
    s = s.select("*", place.alias("place"), F.min(F.when(free, F.struct(place.alias("place"), "level"))).over(every).alias("from"))
    target = F.when(F.col("place") >= F.col("from.place"), F.least("cap", F.col("w") * F.col("from.level"))).otherwise(F.col("cap"))
    return s.select("none", "src", "ord", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def slots(plan: DataFrame, count: int) -> DataFrame:
    """(ord, rank) of the slots that the sources need; plan has ord, lo, hi, need."""
    spark = plan.sparkSession
    t = F.col("id") % (1 << 32)
    low, high = t % 65536, F.floor(t / 65536)
    point = ((low * PHI32) % (1 << 32) + ((high * PHI32) % 65536) * 65536) % (1 << 32)
    points = spark.range(count).select("id", point.alias("pt")).withColumn("cell", F.shiftright("pt", 20))
    cells = plan.select("ord", "lo", "hi", "need", F.explode(F.sequence(F.shiftright("lo", 20), F.shiftright(F.col("hi") - 1, 20))).alias("cell"))
    hit = materialize(points.join(small(materialize(cells)), "cell").where("pt >= lo and pt < hi").select("id", "ord", "need", F.floor(F.col("id") / CHUNK).alias("chunk")))
    sums = hit.groupBy("ord", "chunk").agg(F.count("*").alias("n"))
    at = Window.partitionBy("ord").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("ord", "chunk", F.coalesce(F.sum("n").over(at), F.lit(0)).alias("before")))
    inner = F.row_number().over(Window.partitionBy("ord", "chunk").orderBy("id")) - 1
    ranked = hit.withColumn("inner", inner).join(small(offsets), ["ord", "chunk"])
    return ranked.select("ord", "need", (F.col("inner") + F.col("before")).alias("rank")).where("rank < need")


def plan_mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, source, size, source_size, target, taken."""
    sized = materialize(sizes(docs))
    goal = materialize(targets(sized))
    goal = small(goal)
    want = F.floor(F.col("target") + 0.5).cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    p = goal.where("source_size > 0").select("*", want.alias("want"), blocks.alias("blocks"))
    rem = F.col("want") % F.col("source_size")
    p = p.select("*", (F.floor(F.col("want") / F.col("source_size")) * F.col("blocks") + F.ceil(rem / block)).cast("long").alias("need"), rem.alias("rem"))
    share = F.col("need") + MARGIN
    upto = F.sum(share).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = materialize(p.select("*", share.alias("share"), upto.alias("upto")))
    count = p.agg(F.max("upto")).first()[0] or 0
    edge = lambda c: F.floor(F.lit(float(1 << 32)) * c / F.lit(max(count, 1))).cast("long")
    bounds = p.select("ord", "need", edge(F.col("upto") - F.col("share")).alias("lo"), edge(F.col("upto")).alias("hi")).where("hi > lo")
    taken = slots(bounds, count)
    q = small(p.select("none", "src", "ord", "source_size", "blocks", "rem", F.col("need").alias("_need")))
    # a slot takes its whole block; the last rank of a source takes what is left to the target
    t = taken.join(q.select("ord", "blocks", "rem", "_need"), "ord")
    last = (F.col("rank") == F.col("_need") - 1) & (F.col("rem") > 0)
    t = t.select("ord", (F.col("rank") % F.col("blocks")).alias("blk"), F.when(last, (F.col("rem") - 1) % block + 1).alias("part"))
    t = materialize(t.groupBy("ord", "blk").agg(F.count_if(F.col("part").isNull()).alias("full"), F.coalesce(F.sum("part"), F.lit(0)).alias("part")))
    ranks = t.groupBy("ord").agg(F.sum(F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)).alias("n"))
    if not q.where("_need > 0").join(ranks, "ord", "left").where(F.coalesce("n", F.lit(0)) != F.col("_need")).isEmpty():
        raise RuntimeError("the schedule has too few slots for a source")

    # where each document begins in its source's stream
    order = ["h", "doc_id", "text_key", "size"]
    sums = sized.groupBy("none", "src", "bucket").agg(F.sum("size").alias("n"))
    at = Window.partitionBy("none", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("none", "src", "bucket", F.coalesce(F.sum("n").over(at), F.lit(0)).alias("before")))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("none", "src", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inside", inside).join(small(offsets), ["none", "src", "bucket"])
    placed = placed.join(goal, ["none", "src"]).withColumn("start", F.col("inside") + F.col("before"))
    cols = ["doc_id", "text_key", "none", "src", "size", "source_size", "target"]
    first, end = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select(*cols, "ord", "start", F.explode(F.sequence(first, end)).alias("blk"))
    lo = F.greatest(F.col("start"), F.col("blk") * block) - F.col("blk") * block
    hi = F.least(F.col("start") + F.col("size"), (F.col("blk") + 1) * block) - F.col("blk") * block
    pieces = pieces.select(*cols, "ord", "start", "blk", lo.alias("lo"), hi.alias("hi")).join(small(t), ["ord", "blk"], "left")
    words = F.coalesce("full", F.lit(0)) * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", F.coalesce("part", F.lit(0))) - F.col("lo"))
    out = pieces.groupBy(*cols, "start").agg(F.sum(words).alias("taken")).drop("start")
    empty = placed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))
    source = F.when(~F.col("none"), F.col("src")).alias("source")
    return out.unionByName(empty).select("doc_id", "text_key", source, "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return plan_mix(docs, block).select("doc_id", "size", "source_size", "target", "taken")


def oracle(block: int = BLOCK) -> str:
    """The mix in DuckDB's SQL: the same definition (targets, golden-ratio slots, blocks of a
    stream in hash order), with windows over whole sources instead of two-level sums."""
    n = len(WEIGHTS)
    return f"""WITH sized AS (
        SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
               ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
    totals AS (SELECT none, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY none, src) AS ord FROM sized GROUP BY none, src),
    weighed AS (SELECT *, {list(WEIGHTS)}[(ord - 1) % {n} + 1]::DOUBLE AS w, source_size * {float(LIMIT)} AS cap, (sum(source_size) OVER ())::DOUBLE * {SHARE} AS total FROM totals),
    levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    open_ AS (SELECT cap / w AS ratio, ord, level FROM levels WHERE cap > w * level * (1 + 1e-12) ORDER BY ratio, ord LIMIT 1),
    goal AS (SELECT l.none, l.src, l.ord, l.source_size, CASE WHEN o.ord IS NOT NULL AND (l.cap / l.w > o.ratio OR l.cap / l.w = o.ratio AND l.ord >= o.ord) THEN least(l.cap, l.w * o.level) ELSE l.cap END AS target
        FROM levels l LEFT JOIN open_ o ON true),
    wanted AS (SELECT ord, source_size, floor(target + 0.5)::BIGINT AS want, ceil(source_size / {block})::BIGINT AS blocks FROM goal WHERE source_size > 0),
    needed AS (SELECT *, want % source_size AS rem, ((want // source_size) * blocks + ceil((want % source_size) / {block}))::BIGINT AS need FROM wanted),
    shared AS (SELECT *, need + {MARGIN} AS share, (sum(need + {MARGIN}) OVER (ORDER BY ord))::BIGINT AS upto FROM needed),
    bounds AS (SELECT *, floor(4294967296.0::DOUBLE * (upto - share) / max(upto) OVER ())::BIGINT AS lo, floor(4294967296.0::DOUBLE * upto / max(upto) OVER ())::BIGINT AS hi FROM shared),
    points AS (SELECT id, (id * {PHI32}) % 4294967296 AS pt FROM (SELECT unnest(range((SELECT coalesce(max(upto), 0) FROM shared))) AS id) i),
    slots AS (SELECT b.*, row_number() OVER (PARTITION BY b.ord ORDER BY p.id) - 1 AS rank FROM points p JOIN bounds b ON p.pt >= b.lo AND p.pt < b.hi),
    taken AS (SELECT ord, rank % blocks AS blk, count(*) FILTER (NOT (rank = need - 1 AND rem > 0)) AS whole, coalesce(max((rem - 1) % {block} + 1) FILTER (rank = need - 1 AND rem > 0), 0) AS part
        FROM slots WHERE rank < need GROUP BY ord, rank % blocks),
    placed AS (SELECT s.doc_id, s.size, g.ord, g.source_size, g.target, row_number() OVER () AS r,
        coalesce(sum(s.size) OVER (PARTITION BY s.none, s.src ORDER BY s.h % {BUCKETS}, s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM sized s JOIN goal g ON g.none = s.none AND g.src = s.src),
    pieces AS (SELECT *, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS blk FROM placed WHERE size > 0),
    cut AS (SELECT p.r, greatest(p.start, p.blk * {block}) - p.blk * {block} AS lo, least(p.start + p.size, (p.blk + 1) * {block}) - p.blk * {block} AS hi, coalesce(t.whole, 0) AS whole, coalesce(t.part, 0) AS part
        FROM pieces p LEFT JOIN taken t ON t.ord = p.ord AND t.blk = p.blk),
    words AS (SELECT r, sum(whole * (hi - lo) + greatest(0, least(hi, part) - lo))::BIGINT AS taken FROM cut GROUP BY r)
    SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(w.taken, 0)::BIGINT AS taken FROM placed p LEFT JOIN words w ON w.r = p.r"""


def _cut(batches):
    """Repeat each text as often as its words are taken whole, then its first words for the rest."""
    for b in batches:
        names = [n for n in b.schema.names if n not in ("_lw_size", "_lw_taken")]
        at, texts, rows, chars = names.index("text"), [], [], []
        source = b.column(b.schema.get_field_index("text")).to_pylist()
        sizes_, takes = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_lw_size", "_lw_taken"))
        for i, (text, size, take) in enumerate(zip(source, sizes_, takes)):
            whole, rest = divmod(take, size) if size else (0, 0)
            for _ in range(whole):
                rows.append(i)
                texts.append(text)
                chars.append(None)
            if rest:
                cut = text[: next(itertools.islice(_WORDS.finditer(text), rest - 1, None)).end()]
                rows.append(i)
                texts.append(cut)
                chars.append(len(cut))
        taken = pa.array(rows, pa.int64())
        cols = []
        for k, n in enumerate(names):
            col = b.column(b.schema.get_field_index(n))
            if k == at:
                col = pa.array(texts, pa.string())
            else:
                col = col.take(taken)
                if n == "n_chars":
                    col = pa.array([c if c is not None else v for c, v in zip(chars, col.to_pylist())], col.type)
            cols.append(col)
        yield pa.RecordBatch.from_arrays(cols, names=names)


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with all columns of docs: each text whole as often as it is taken whole,
    then its first words for a remainder. Rows equal in doc_id and text share their words evenly
    (rounded down)."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    plan = plan_mix(docs, block).where("taken > 0").groupBy("doc_id", "text_key", F.col("source").alias("s"))
    plan = plan.agg(F.first("size").alias("_lw_size"), F.floor(F.sum("taken") / F.count("*")).cast("long").alias("_lw_taken"))
    plan = small(materialize(plan.withColumnsRenamed({"doc_id": "_lw_id", "text_key": "_lw_key", "s": "_lw_src"})))
    same = docs["doc_id"].eqNullSafe(plan["_lw_id"]) & (key == plan["_lw_key"]) & docs["source"].eqNullSafe(plan["_lw_src"])
    rows = docs.join(plan, same).select(*[docs[c] for c in docs.columns], "_lw_size", "_lw_taken")
    return arrow_map(rows, _cut, docs.schema)
