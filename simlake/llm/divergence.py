"""Source divergence audit: how far apart the sources of a language are in the words they use, and by which words.

Workers count each term's occurrences and documents by language and source (an Arrow pass, summed before it is shuffled). The
terms in at least ``min_docs`` documents of a language are kept; each becomes one wide vector, its counts in an array indexed
by the language's sources. JVM higher-order functions turn a vector into the sources' shares and emit the contribution of each
pair of sources; map-side aggregation sums them. A pair in which neither source has the term would give the same contribution
for each such term, so a vector emits only what differs from that, and that is added once for all kept terms: a rare term of a
language with many sources emits pairs with the sources that have it, not all pairs. Shares and distances are integers and
exact: counts are added and divided as decimals of 38 digits.

Edge cases: a null text, language or source is an empty one, a name like others; groups without terms have the share of a
count of zero; a language without kept terms gives each pair of its sources the value 0 and no terms; each row counts as a
document, repeated or not; ties go by the name in UTF-8; texts are read whole, of any length; an empty table gives an empty
result; other columns are ignored, whatever their names. The vectors' width is the number of sources of one language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, checkpoint, ship, spread, table

#: Shares are whole parts of this, and each count is raised by SMOOTH.
SCALE, SMOOTH = 1_000_000_000, 5

#: Counts of different (language, source, term) that a worker gathers before it hands them on.
GATHERED = 1 << 19

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

#: Sources over all languages up to which their names and totals go to every worker; more are joined by language.
HELD_SOURCES = 100_000

#: Kept terms whose vectors one task turns into contributions.
TASK_TERMS = 5000

#: Letters A-Z to a-z, other ASCII to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(raw: bytes | None) -> Counter:
    """The terms of a text and how often each occurs."""
    met: Counter = Counter()
    raw, at = raw or b"", 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _FOLD[raw[end]] != 32:  # a term is not cut
            end += 1
        met.update(raw[at:end].translate(_FOLD).split())
        at = end
    return met


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a row with a null term for each group."""
    ship(docs.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple, dict[bytes | None, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in met.items():
                made = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*made, pa.array([x[0] for x in own.values()], pa.int64()), pa.array([x[1] for x in own.values()], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                own = met.setdefault((lang, source), {None: [0, 0]})
                before = len(own)
                for term, n in terms_of(raw).items():
                    if x := own.get(term):
                        x[0] += n
                        x[1] += 1
                    else:
                        own[term] = [n, 1]
                size += len(own) - before
                if size > GATHERED:
                    yield from out()
                    met.clear()
                    size = 0
        yield from out()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(text_col).alias("text"))
    met = spread(own).mapInArrow(over, "lang string, source string, term string, n long, docs long")
    return met.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exact; ``kept`` is above 0."""
    over = (count.cast("decimal(20,0)") + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + SMOOTH * kept).cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, min_docs: int = 30, top: int | None = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the distance to each other source of the language, over all kept
    terms. Part ``term``: the ``top`` terms that the source uses more than the language does, by the difference of the shares."""
    counted = checkpoint(counts(docs, text_col, lang_col, source_col))
    met = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = checkpoint(met.where(F.col("docs") >= min_docs).select("lang", "term", "n", "by"))
    kept_in = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    totals = kept.select("lang", F.inline("by")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(kept_in, "lang", "left").na.fill(0)
    groups = checkpoint(groups)
    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))
    groups = groups.withColumn("none", none)
    wide = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total", "none"))).alias("own"), F.first("kept").alias("kept"), F.first("all").alias("all"))
    wide = wide.select("lang", "kept", "all", *(F.col("own")[c].alias(f"{c}s") for c in ("source", "total", "none")))
    if groups.count() <= HELD_SOURCES:
        wide = F.broadcast(wide)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, kept.count() // TASK_TERMS + 1)
    vectors = kept.repartition(parts, "lang", "term").join(wide, "lang").withColumn("at", F.map_from_entries("by"))
    vectors = vectors.withColumn("ns", F.transform("sources", lambda s: F.coalesce(F.element_at("at", s), F.lit(0))))
    vectors = vectors.withColumn("shares", F.transform("ns", lambda n, i: F.when(n > 0, share(n, F.get("totals", i), F.col("kept"))).otherwise(F.get("nones", i))))
    vectors = vectors.withColumn("has", F.filter(F.transform("ns", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull()))
    return _pairs(vectors, wide).unionByName(_terms(vectors, top))


def _pairs(vectors: DataFrame, wide: DataFrame) -> DataFrame:
    """Distances of all pairs of sources of a language: those without any kept term, and what the terms add to them."""
    far = lambda c, i, j: F.abs(F.get(c, i) - F.get(c, j))
    pair = lambda i, j, more: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), more.cast("long").alias("more"))
    i, numbers = F.col("i"), F.transform("sources", lambda s, j: j)
    bare = wide.select("lang", "kept", "sources", "nones", F.explode(numbers).alias("i"))
    bare = bare.select("lang", F.inline(F.transform(F.filter(numbers, lambda j: j > i), lambda j: pair(i, j, F.coalesce(F.col("kept") * far("nones", i, j), F.lit(0))))))
    term = vectors.select("lang", "ns", "shares", "nones", F.explode("has").alias("i"))
    others = F.filter(F.transform("ns", lambda n, j: F.when((n == 0) | (j > i), j)), lambda j: j.isNotNull())
    added = term.select("lang", F.inline(F.transform(others, lambda j: pair(i, j, far("shares", i, j) - far("nones", i, j)))))
    summed = bare.unionByName(added).groupBy("lang", "a", "b").agg(F.sum("more").alias("value")).join(wide.select("lang", "sources"), "lang")
    name = lambda i: F.get("sources", F.col(i))
    both = F.array(*(F.struct(name(x).alias("source"), name(y).alias("item")) for x, y in ("ab", "ba")))
    return _ranked(summed.select("lang", "value", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value"), None)


def _terms(vectors: DataFrame, top: int | None) -> DataFrame:
    of = vectors.withColumn("q", share(F.col("n"), F.col("all"), F.col("kept"))).select("lang", "term", "q", "sources", "shares", F.explode("has").alias("i"))
    found = of.select("lang", F.get("sources", F.col("i")).alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.get("shares", F.col("i")) - F.col("q")).alias("value")).where("value > 0")
    return _ranked(found, top)


def _ranked(found: DataFrame, top: int | None) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top) if top is not None else ranked


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM d
), grid AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
    1 + (1000000000 * (lang_n + 5)) // (sum(lang_n) OVER s + 5 * count(*) OVER s) AS q
  FROM grid WINDOW s AS (PARTITION BY lang, source)
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50
"""
