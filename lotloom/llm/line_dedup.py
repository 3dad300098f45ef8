"""Line dedup: repeated runs of lines, found over line-id sequences by prefix doubling.

Each text is a sequence of the ids of its lines. Prefix doubling names the runs of 1, 2, 4, ...
lines that begin at each place: the name of 2k lines is made of the names of the two halves. These
names are the ranks of a suffix array, with hashes in place of ordinal numbers, since nothing here
needs the order of two different runs; the suffixes that share a name of m lines are the
longest-common-prefix interval of depth m, and its smallest place is the copy that stays. A run of
any length is named by two overlapping runs of a power of two.

A repeated run counts from ``words`` words on. For each place only two runs are looked up: the
shortest that begins there and the shortest that ends there with so many words. Each line of any
longer repeated run lies in one of these that is repeated as well: the one that begins at the line
if enough words of the run follow, else the one that ends there if enough come before, else the
one that begins where the long run does. So their union is that of all maximal repeated runs.

Everything is DataFrame functions. Groups of copies meet in sums by name, which combine before
the shuffle, and in a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Least words of a run that is a copy.
WORDS = 50

_LAST = 9223372036854775807


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """The key of a row: its id (rows without one come last) and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _filled_lines(lines: str) -> Column:
    return F.filter(lines, lambda x: x.rlike(r"\S"))


def runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(n1, n2, key, tie, start, length): the two runs of each place; start counts lines that aren't blank."""
    key, tie = _keyed(docs)
    rows = docs.select(key.alias("key"), tie.alias("tie"), _filled_lines(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("lines"))
    rows = rows.select("key", "tie", F.transform("lines", lambda x: F.xxhash64(x)).alias("a1"), F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b1"), F.transform("lines", lambda x: F.least(F.lit(words), F.regexp_count(x, F.lit(r"\S+")))).alias("w1"))
    powers = [1]
    while powers[-1] * 2 <= words:
        powers.append(powers[-1] * 2)
    for k in powers[:-1]:  # from runs of k lines to runs of 2k
        rows = rows.withColumn("n", F.greatest(F.size("w1") - 2 * k + 1, F.lit(0)))
        for name, joined in (("a", lambda x, y: F.xxhash64(x, y)), ("b", lambda x, y: F.xxhash64(x, y)), ("w", lambda x, y: F.least(F.lit(words), x + y))):
            rows = rows.withColumn(f"{name}{2 * k}", F.zip_with(F.slice(f"{name}{k}", F.lit(1), F.col("n")), F.slice(f"{name}{k}", F.lit(k + 1), F.col("n")), joined))
    rows = rows.where(F.size("w1") > 0)
    places = F.sequence(F.lit(0), F.size("w1") - 1)
    zero = [F.lit(0).alias("length"), F.lit(0).alias("sum")]
    rows = rows.withColumn("forward", F.transform(places, lambda i: F.struct(i.alias("at"), *zero))).withColumn("back", F.transform(places, lambda i: F.struct(i.alias("at"), *zero)))
    for k in reversed(powers):  # the longest run of fewer words than ``words``, bit by bit
        def longer(s: Column, begin: Column, k: int = k) -> Column:
            more = F.get(F.col(f"w{k}"), begin)
            fits = F.coalesce(s["sum"] + more < words, F.lit(False))
            return F.when(fits, F.struct(s["at"].alias("at"), (s["length"] + k).alias("length"), (s["sum"] + more).alias("sum"))).otherwise(s)

        rows = rows.withColumn("forward", F.transform("forward", lambda s: longer(s, s["at"] + s["length"])))  # noqa: B023
        rows = rows.withColumn("back", F.transform("back", lambda s: longer(s, s["at"] - s["length"] - k + 1)))  # noqa: B023
    forward = F.transform(F.filter("forward", lambda s: s["at"] + s["length"] < F.size("w1")), lambda s: F.struct(s["at"].alias("start"), (s["length"] + 1).alias("length")))
    back = F.transform(F.filter("back", lambda s: s["at"] - s["length"] >= 0), lambda s: F.struct((s["at"] - s["length"]).alias("start"), (s["length"] + 1).alias("length")))
    rows = rows.withColumn("runs", F.array_distinct(F.concat(forward, back)))

    def name(s: Column, seed: str) -> Column:
        out = None
        for k in reversed(powers):
            made = F.xxhash64(s["length"], F.get(F.col(f"{seed}{k}"), s["start"]), F.get(F.col(f"{seed}{k}"), s["start"] + s["length"] - k))
            out = F.when(s["length"] >= k, made) if out is None else out.when(s["length"] >= k, made)
        return out

    named = F.transform("runs", lambda s: F.struct(name(s, "a").alias("n1"), name(s, "b").alias("n2"), s["start"].alias("start"), s["length"].alias("length")))
    return rows.select("key", "tie", F.explode(named).alias("r")).select("r.n1", "r.n2", "key", "tie", "r.start", "r.length")


def copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, tie, runs): for rows with later copies, the runs (start, length) to delete."""
    each = scratch.table(runs(docs, words), "line-runs")
    first = each.groupBy("n1", "n2").agg(F.min(F.struct("key", "tie", "start")).alias("first"), F.max(F.struct("key", "tie", "start")).alias("last")).where("first < last").drop("last")
    later = each.join(first, ["n1", "n2"]).where(F.struct("key", "tie", "start") != F.col("first"))
    return later.select("key", "tie", "start", "length").groupBy("key", "tie").agg(F.collect_set(F.struct("start", "length")).alias("runs"))


def without_copies(docs: DataFrame, words: int = WORDS, counts: tuple[str, str] = ("__lines", "__deleted")) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``, and two more columns named by ``counts``.

    A run is a stretch of lines, blank ones apart, of ``words`` words or more together; lines are
    equal if they are so in every character. The first copy, by doc_id and place, stays; rows
    without an id come last. A blank line goes with the line above it. The first further column
    counts the lines that aren't blank, the second those deleted of them. Texts without a copy are
    unchanged, null and empty ones too; a text of any length counts whole. Rows that repeat both id
    and text count as one and have one outcome. An empty table stays empty. Other columns pass
    through, whatever their names; those named as in ``counts`` are replaced.
    """
    key, tie = _keyed(docs)
    names = [c for c in docs.columns if c not in counts]
    x = scratch.fresh(docs, "")
    rows = docs.withColumns({f"{x}key": key, f"{x}tie": tie})
    gone = copies(docs, words).select(F.col("key").alias(f"{x}key"), F.col("tie").alias(f"{x}tie"), F.col("runs").alias(f"{x}runs"))
    rows = rows.join(gone, [f"{x}key", f"{x}tie"], "left")
    all_, filled, runs_, ranks_ = (f"{x}{name}" for name in ("all", "filled", "runs", "ranks"))
    rows = rows.withColumn(all_, F.split("text", "\n")).withColumn(filled, F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.get(F.col(all_), i).rlike(r"\S")))
    ranks = F.array_distinct(F.flatten(F.transform(runs_, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))))
    rows = rows.withColumn(ranks_, ranks)
    until = lambda j: F.coalesce(F.get(F.col(filled), j + 1), F.size(all_)) - 1
    lost = F.flatten(F.transform(ranks_, lambda j: F.sequence(F.get(F.col(filled), j), until(j))))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), lost)
    text = F.when(F.col(runs_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(all_), i)), "\n"))
    rows = rows.withColumns({counts[0]: F.greatest(F.coalesce(F.size(filled), F.lit(0)), F.lit(0)).cast("long"), counts[1]: F.when(F.col(runs_).isNull(), F.lit(0)).otherwise(F.size(ranks_)).cast("long"), "text": text})
    return rows.select(*[F.col(f"`{c}`") for c in names], *counts)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs of 50 words or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_copies(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"), "text")


ORACLE_SQL = r"""
with line as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
), filled as (
  select doc_id, line, pos, len(regexp_extract_all(line, '\S+')) as n, row_number() over (partition by doc_id order by pos) as place
  from line where regexp_matches(line, '\S')
), summed as (
  select *, sum(n) over (partition by doc_id order by place) as upto from filled
), bounds as (
  select a.doc_id, a.place as lo, min(b.place) as hi
  from summed a join summed b on a.doc_id = b.doc_id and b.place >= a.place and b.place < a.place + 50 and b.upto - a.upto + a.n >= 50
  group by all
  union
  select b.doc_id, max(a.place), b.place
  from summed a join summed b on a.doc_id = b.doc_id and b.place >= a.place and b.place < a.place + 50 and b.upto - a.upto + a.n >= 50
  group by b.doc_id, b.place
), whole as (
  select doc_id, list(line order by place) as lines from filled group by doc_id
), run as (
  select doc_id, lo, hi, lines[lo:hi] as content from bounds join whole using (doc_id)
), ranked as (
  select doc_id, lo, hi, row_number() over (partition by content order by doc_id, lo) as copy from run
), dead as (
  select distinct doc_id, unnest(range(lo, hi + 1)) as place from ranked where copy > 1
), fate as (
  select l.doc_id, l.pos, l.line, f.place,
         last_value(f.place ignore nulls) over (partition by l.doc_id order by l.pos) as above
  from line l left join filled f on l.doc_id = f.doc_id and l.pos = f.pos
), made as (
  select x.doc_id, count(x.place) as n_lines, count(case when d.place is not null then x.place end) as n_deleted,
         coalesce(string_agg(case when d.place is null then x.line end, chr(10) order by x.pos), '') as text
  from fate x left join dead d on x.doc_id = d.doc_id and x.above = d.place group by x.doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted,
       case when d.text is null then null when coalesce(n_deleted, 0) = 0 then d.text else m.text end as text
from documents d left join made m on d.doc_id = m.doc_id
"""
