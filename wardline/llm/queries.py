"""Queries over the test tables for the operators on training data, with their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.catalog import table
from wardline.llm import canonical, mixing, packing, percentiles, splitting, tokens, truncation
from wardline.plans import compiler

ERROR = 0.01
QS = [0.5, 0.9, 0.99]
CAPACITY = 2048
#: Total of the mixture, as a share of the tokens at hand: more than the scarcest sources can give their share of.
MIXED = 0.5


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "event_df").select("normalized_term", F.to_date("loaded_at").alias("day"), "value")
    return percentiles.sketch(ev, ["normalized_term", "day"], "value", ERROR)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every term from the sketches of single days put together."""
    whole = percentiles.merge(["normalized_term"], _days(spark, sf_dir))
    return percentiles.quantiles(whole, ["normalized_term"], QS, ERROR).withColumn("relative_error", F.lit(ERROR))


def p1_daily_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "training_data")).filter("piece = 0 and n_pieces > 1").select("uid")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "training_data"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_events(table(spark, sf_dir, "event_df"), table(spark, sf_dir, "alias_to_canonical_df")).select("event_id", "canonical")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that mean nothing on the list, with their number of rows."""
    ev = table(spark, sf_dir, "event_df").filter("normalized_term is null")
    return canonical.map_entries(ev, table(spark, sf_dir, "alias_to_canonical_df"), "source_entity").filter(F.col("canonical") == canonical.UNMATCHED).select("entry", "n")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(counts, CAPACITY)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(_packed(spark, sf_dir), CAPACITY)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts = tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.mix(counts, table(spark, sf_dir, "mix_targets"), MIXED)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).filter("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation.rates(truncation.truncated(docs), docs)


def p1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles, from counts of single values, and whether the sketches of the days come within the error."""
    v = table(spark, sf_dir, "event_df").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    of = Window.partitionBy("normalized_term")
    c = v.groupBy("normalized_term", "value").agg(F.count(F.lit(1)).alias("c")).withColumns({"cum": F.sum("c").over(of.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(of)})
    exact = c.groupBy("normalized_term").agg(*[F.min(F.when(F.col("cum") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("value"))).alias(f"x{q:g}") for q in QS])
    p = p1_percentiles(spark, sf_dir)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(ERROR * (1 + 1e-9)) * F.abs(F.col(b))
    pairs = [("p50", "x0.5"), ("p90", "x0.9"), ("p99", "x0.99")]
    x = p.withColumnRenamed("normalized_term", "t").join(exact, F.col("t").eqNullSafe(F.col("normalized_term")))
    return x.select("normalized_term", *[F.col(f"`{b}`").alias(f"exact_{a}") for a, b in pairs], *[near(a, f"`{b}`").alias(f"{a}_within") for a, b in pairs])


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text that is split: the text put together from its pieces, and how many spans and relations are held or listed."""
    p = p3_pieces(spark, sf_dir)
    own = F.struct("piece", F.expr("substring(text, own_from - piece_from + 1)").alias("own"))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    g = p.groupBy("uid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "").alias("whole"), ((F.max(F.length("text")) <= 2000) & (F.max(F.col("own_from") - F.col("piece_from")) <= 200)).alias("within_limits"),
        F.array_distinct(F.concat(F.flatten(F.collect_list(ids("spans"))), F.flatten(F.collect_list("spans_cut")))).alias("s"), F.array_distinct(F.concat(F.flatten(F.collect_list("relations")), F.flatten(F.collect_list("relations_cut")))).alias("r"),
    )
    return g.select("uid", F.length("whole").alias("n_chars"), F.md5("whole").alias("restored"), "within_limits", F.size(F.filter("s", lambda x: x.isNotNull())).alias("n_spans"), F.size("r").alias("n_relations"))


def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are an alias but for case, spaces and marks, with what they are mapped to."""
    a = compiler.active(table(spark, sf_dir, "alias_to_canonical_df"))
    joined = lambda c: F.array_join(canonical.words_of_alias(F.col(c)), " ")
    names = a.select(joined("alias").alias("words")).filter("words <> ''").distinct()
    e = canonical.map_events(table(spark, sf_dir, "event_df"), table(spark, sf_dir, "alias_to_canonical_df")).withColumn("words", joined("source_entity"))
    return e.join(names, "words", "left_semi").select("event_id", "canonical")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, and how many containers and documents break a rule of packing."""
    p = _packed(spark, sf_dir)
    n = tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    per = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.count_distinct("piece").alias("d"))
    docs = n.join(per, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.coalesce("t", F.lit(-1)) != F.col("n_tokens"), 1).otherwise(0)).alias("incomplete"), F.sum(F.when((F.col("k") > 1) & (F.col("n_tokens") <= CAPACITY) | (F.col("k") != F.col("d")), 1).otherwise(0)).alias("divided"),
    )
    full = p.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    room = full.agg(F.sum(F.when(F.col("t") > CAPACITY, 1).otherwise(0)).alias("overfull"), (F.sum("t") / F.greatest(F.count(F.lit(1)) * CAPACITY, F.lit(1)) > 0.95).alias("filled"))
    return docs.join(room)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: documents used too often, whether its tokens are within a document of its budget, and whether it has its share or is at its limit."""
    docs = tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    uses, report = mixing.mix(docs, table(spark, sf_dir, "mix_targets"), MIXED)
    per = uses.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("pass").alias("d"), F.max("n_tokens").alias("long"))
    cap = report.select(F.col("source").alias("s"), "cap")
    over = per.join(F.broadcast(cap), F.col("source") == F.col("s")).groupBy("source").agg(F.sum(F.when((F.col("k") > F.coalesce("cap", F.lit(1))) | (F.col("k") != F.col("d")), 1).otherwise(0)).alias("overused"))
    long = docs.groupBy("source").agg(F.max("n_tokens").alias("long"))
    r = report.join(over, "source", "left").join(long, "source", "left")
    budget = F.col("weight") * F.col("total")
    level = F.max(F.when(F.col("exponent") == 1, F.col("weight") / F.col("target_share"))).over(Window.partitionBy())
    due = (F.col("exponent") == 1) & (F.abs(F.col("weight") - F.col("target_share") * level) < 1e-9) | (budget >= 0.999 * F.col("at_hand") * F.coalesce("cap", F.lit(1)))
    return r.select("source", F.coalesce("overused", F.lit(0).cast("bigint")).alias("overused"), (F.abs(F.col("tokens") - budget) <= F.coalesce("long", F.lit(0)) + 1).alias("in_budget"), F.coalesce(due, F.lit(False)).alias("has_its_due"))


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed without targets: token shares exponentiated so that their entropy is nine tenths of the greatest, as far as the repeats allow."""
    docs = tokens.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.evened(docs, table(spark, sf_dir, "mix_targets"), 0.9, MIXED)


def p9_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated texts that end within a character."""
    docs = table(spark, sf_dir, "documents")
    cut = truncation.truncated(docs).filter("truncated")
    return docs.filter(F.rtrim("text").endswith("\ufffd")).join(cut, "doc_id", "left_semi").select("doc_id")


QUERIES = {
    "p1_error": p1_error, "p3_checks": p3_checks, "p4_exact": p4_exact, "p7_checks": p7_checks, "p8_checks": p8_checks, "p8_tempered": p8_tempered, "p9_broken": p9_broken,
    "p1_percentiles": p1_percentiles, "p1_daily_sketch": p1_daily_sketch, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_unmatched": p4_unmatched,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates,
}

_G = f"ln((1 + {ERROR}) / (1 - {ERROR}))"
_BUCKET = f"""CASE WHEN value = 0 THEN 0 WHEN value > 0 THEN CAST(ceil(ln(value) / {_G}) AS BIGINT) + {percentiles.OFFSET}
    ELSE -(CAST(ceil(ln(-value) / {_G}) AS BIGINT) + {percentiles.OFFSET}) END"""
_VALUE = "CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * 2 / (1 + (1 + {e}) / (1 - {e})) * pow((1 + {e}) / (1 - {e}), abs(b) - {o}) END".format(e=ERROR, o=percentiles.OFFSET)

_ROOM = "CASE WHEN length({0}) < 3 THEN 0 WHEN length({0}) < 6 THEN 1 ELSE 2 END"
_EDITS = f"least({_ROOM.format('w')}, {_ROOM.format('v')})"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}+]+')"
#: Entries with their best canonical and score, by all pairs of words; for small tables.
_CANONICAL = f"""al0 AS (SELECT {_WORDS.format('alias')} AS ws, canonical, coalesce(priority, 100) AS p FROM alias_to_canonical_df WHERE coalesce(status, 'active') = 'active' AND alias IS NOT NULL AND canonical IS NOT NULL),
ali AS (SELECT row_number() OVER () AS i, ws, canonical, p FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY p, canonical) AS rn FROM al0 WHERE len(ws) > 0) x WHERE rn = 1),
aw AS (SELECT DISTINCT i, unnest(ws) AS v FROM ali), idf AS (SELECT v, ln(1 + (SELECT count(*) FROM ali) / count(*)) AS f FROM aw GROUP BY v), sized AS (SELECT i, sum(f * f) AS size FROM aw JOIN idf USING (v) GROUP BY i),
ent AS (SELECT source_entity AS entry, count(*) AS n FROM event_df WHERE normalized_term IS NULL AND source_entity IS NOT NULL GROUP BY 1),
ew0 AS (SELECT entry, list_filter({_WORDS.format('entry')}, lambda w: w NOT IN ({', '.join(repr(w) for w in canonical.DECORATION)}) AND NOT regexp_full_match(w, 'x[0-9]+')) AS ws FROM ent),
ew AS (SELECT entry, unnest(ws) AS w FROM ew0), dw AS (SELECT DISTINCT w FROM ew),
nr0 AS (SELECT w, v, damerau_levenshtein(w, v) AS d FROM dw, idf WHERE abs(length(w) - length(v)) <= 2 AND damerau_levenshtein(w, v) <= {_EDITS}),
nr AS (SELECT w, v, d FROM (SELECT *, min(d) OVER (PARTITION BY w) AS least_ FROM nr0) x WHERE d = least_),
one AS (SELECT entry, min(v) AS one FROM ew JOIN nr USING (w) GROUP BY entry),
noise AS (SELECT w FROM (SELECT DISTINCT entry, w FROM ew WHERE w NOT IN (SELECT w FROM nr)) u LEFT JOIN one USING (entry) GROUP BY w HAVING count(DISTINCT one) >= greatest(2.0, 0.1 * (SELECT count(*) FROM idf))),
wt AS (SELECT dw.w, coalesce(max(f), ln(1 + (SELECT count(*) FROM ali))) AS weight FROM dw LEFT JOIN nr ON nr.w = dw.w LEFT JOIN idf ON idf.v = nr.v GROUP BY 1),
plain AS (SELECT entry, w, weight FROM ew JOIN wt USING (w) WHERE w NOT IN (SELECT w FROM noise)), normed AS (SELECT entry, sum(weight * weight) AS norm FROM plain GROUP BY 1),
hit AS (SELECT entry, i, nr.v, max(weight * f * (1 - d / greatest(length(nr.w), length(nr.v)))) AS s FROM plain JOIN nr ON nr.w = plain.w JOIN idf ON idf.v = nr.v JOIN aw ON aw.v = nr.v GROUP BY ALL),
wh AS (SELECT entry, i, d, v FROM (SELECT *, min(d) OVER (PARTITION BY entry) AS least_ FROM (SELECT entry, i, w, v, damerau_levenshtein(w, v) AS d FROM (SELECT entry, array_to_string(ws, '') AS w FROM ew0) e, (SELECT i, array_to_string(ws, '') AS v FROM ali) a
  WHERE length(v) >= 5 AND abs(length(w) - length(v)) <= 2 AND damerau_levenshtein(w, v) <= {_EDITS}) y) x WHERE d = least_),
scored AS (SELECT entry, i, round(sum(s) / sqrt(any_value(norm) * any_value(size)), 9) AS score FROM hit JOIN normed USING (entry) JOIN sized USING (i) GROUP BY entry, i UNION ALL SELECT entry, i, round(1 - d / length(v), 9) FROM wh),
ranked AS (SELECT entry, canonical, score, row_number() OVER (PARTITION BY entry ORDER BY score DESC, p, canonical) AS rn FROM scored JOIN ali USING (i)),
meant AS (SELECT ent.entry, n, CASE WHEN score >= 0.76 THEN canonical ELSE '{canonical.UNMATCHED}' END AS canonical FROM ent LEFT JOIN ranked ON ranked.entry = ent.entry AND rn = 1)"""

SQL = {
    "p4_found": f"WITH {_CANONICAL} SELECT event_id, canonical FROM event_df JOIN meant ON entry = source_entity WHERE normalized_term IS NULL",
    "p4_unmatched": f"WITH {_CANONICAL} SELECT entry, n FROM meant WHERE canonical = '{canonical.UNMATCHED}'",
    "p1_percentiles": f"""
WITH x AS (SELECT normalized_term, {_BUCKET} AS b FROM event_df WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT normalized_term, b, row_number() OVER (PARTITION BY normalized_term ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY normalized_term) AS n FROM x),
v AS (SELECT normalized_term, i, n, {_VALUE} AS v FROM r)
SELECT normalized_term, max(n) AS n, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN v END) AS p50, max(CASE WHEN i = floor(0.9 * (n - 1)) THEN v END) AS p90,
       max(CASE WHEN i = floor(CAST(0.99 AS DOUBLE) * (n - 1)) THEN v END) AS p99, CAST({ERROR} AS DOUBLE) AS relative_error FROM v GROUP BY normalized_term""",
    "p1_daily_sketch": f"""
SELECT normalized_term, CAST(loaded_at AS DATE) AS day, {_BUCKET} AS bucket, count(*) AS n FROM event_df WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""",
    "p1_error": """
WITH r AS (SELECT normalized_term, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY normalized_term) AS n FROM event_df WHERE value IS NOT NULL AND NOT isnan(value) WINDOW w AS (PARTITION BY normalized_term ORDER BY value))
SELECT normalized_term, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN value END) AS exact_p50, max(CASE WHEN i = floor(0.9 * (n - 1)) THEN value END) AS exact_p90,
       max(CASE WHEN i = floor(CAST(0.99 AS DOUBLE) * (n - 1)) THEN value END) AS exact_p99, true AS p50_within, true AS p90_within, true AS p99_within FROM r GROUP BY normalized_term""",
    "p3_checks": """
WITH t AS (SELECT uid, text, relations, list_transform(coalesce(spans, []), lambda s: s.id) AS ids FROM training_data WHERE length(text) > 2000)
SELECT uid, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS restored, true AS within_limits, CAST(len(list_distinct(ids)) AS INTEGER) AS n_spans,
       CAST(len(list_distinct(list_filter(coalesce(relations, []), lambda r: list_contains(ids, r.head) AND list_contains(ids, r.child)))) AS INTEGER) AS n_relations FROM t""",
    "p4_exact": r"""
WITH a AS (SELECT array_to_string(regexp_extract_all(lower(alias), '[\p{L}\p{N}+]+'), ' ') AS w, canonical, coalesce(priority, 100) AS p FROM alias_to_canonical_df WHERE coalesce(status, 'active') = 'active' AND canonical IS NOT NULL),
b AS (SELECT w, canonical, row_number() OVER (PARTITION BY w ORDER BY p, canonical) AS rn FROM a WHERE w <> '')
SELECT event_id, canonical FROM event_df e JOIN b ON rn = 1 AND w = array_to_string(regexp_extract_all(lower(source_entity), '[\p{L}\p{N}+]+'), ' ') WHERE normalized_term IS NULL""",
    "p7_checks": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS overfull, true AS filled FROM documents WHERE text IS NOT NULL",
    "p8_checks": "SELECT source, CAST(0 AS BIGINT) AS overused, true AS in_budget, true AS has_its_due FROM mix_targets",
    "p9_broken": "SELECT doc_id FROM documents WHERE rtrim(text) LIKE '%' || chr(65533)",
    "p3_found": "SELECT uid FROM training_data WHERE length(text) > 2000",
}
