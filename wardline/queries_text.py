"""Queries on notes, spans, relations and logs, with their SQL."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog import table
from wardline.functions.text import MODIFIER_WORDS, modifier_of, name_order, normalized_column, sex_code, strict_number
from wardline.operators import text
from wardline.session import shared_dir
from wardline.sources import notes
from wardline.streaming import ingest


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "training_data")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _training(spark, sf_dir).select("uid", text.token_list(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return w.select("uid", F.size("w").cast("bigint").alias("n"), F.element_at("w", -1)["end"].alias("last_end"), F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["token"])).alias("letters"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(word_tokens(spark, sf_dir).select("uid", "n"), "n", 128, 0.25)


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


def chunk_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.trusted(_chunks(spark, sf_dir))


def chunk_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.centred(text.chunks(word_tokens(spark, sf_dir).select("uid", "n"), "n", 128, 0.5))


def span_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_spans(_training(spark, sf_dir), "uid", size=128).select("uid", "chunk", "ord", "start", "end", "label")


def bio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.labelled(_training(spark, sf_dir).select("uid", "text", "spans"))
    return t.select("uid", F.inline("labels")).select("uid", "i", "label")


def bio_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(spark, sf_dir)
    return t.select("uid", F.inline(text.entities(F.col("text"), F.col("spans")))).select("uid", "id", "start", "end", "label")


def span_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(spark, sf_dir).select("uid", text.without_overlaps(F.col("spans")).alias("s"))
    return text.exploded(t, "uid", "s").select("uid", "id", "start", "end", "label", "confidence")


def span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose text is not what stands at their place."""
    t = _training(spark, sf_dir)
    s = text.exploded(t, "uid").join(t.select("uid", F.col("text").alias("whole")), "uid")
    return s.filter(~F.expr("substring(whole, start + 1, end - start)").eqNullSafe(F.col("text"))).select("uid", "ord", "id")


def tagged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their free-standing spans in tags."""
    t = _training(spark, sf_dir)
    return t.select("uid", text.tagged(F.col("text"), text.without_overlaps(F.col("spans"))).alias("tagged"))


def table_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a literal in the notes."""
    d = _docs(spark, sf_dir).filter("text is not null")
    return d.select("doc_id", F.posexplode(text.marks(F.col("text"), "PLAN")).alias("k", "start")).select("doc_id", "k", "start")


def relation_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.best_relations(text.exploded(_training(spark, sf_dir), "uid", "relations"), ["uid"]).select("uid", "head", "child", "label", "confidence")


def relation_ends_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations both of whose spans exist."""
    t = _training(spark, sf_dir)
    r, ids = text.exploded(t, "uid", "relations"), text.exploded(t, "uid").select("uid", "id").distinct()
    return r.join(ids.withColumnRenamed("id", "head"), ["uid", "head"], "left_semi").join(ids.withColumnRenamed("id", "child"), ["uid", "child"], "left_semi").select("uid", "ord", "head", "child", "label")


def allowed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.allowed_pairs(text.exploded(_training(spark, sf_dir), "uid"), ["uid"], farthest=400)


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(spark, sf_dir)
    pairs = text.allowed_pairs(text.exploded(t, "uid"), ["uid"], farthest=400)
    return text.training_pairs(pairs, text.exploded(t, "uid", "relations"), ["uid"], 400, 120, 0.0)


def pair_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with head and child of each annotated relation marked, where the two don't overlap."""
    t = _training(spark, sf_dir)
    s = text.exploded(t, "uid")
    one = s.groupBy("uid", "id").agg(F.min(F.struct("start", "end")).alias("p"))
    r = text.exploded(t, "uid", "relations").join(one.select("uid", F.col("id").alias("head"), F.col("p").alias("h")), ["uid", "head"]).join(one.select("uid", F.col("id").alias("child"), F.col("p").alias("c")), ["uid", "child"])
    r = r.filter("h.end <= c.start or c.end <= h.start").join(t.select("uid", "text"), "uid")
    m = text.pair_marked(F.col("text"), *[F.col(x) for x in ("h.start", "h.end", "c.start", "c.end")])
    return r.select("uid", "ord", F.length(m).alias("n"), F.md5(m).alias("md5"))


def train_dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.divided(_training(spark, sf_dir).select("uid"), "uid", 20).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.class_weights(text.exploded(_training(spark, sf_dir), "uid", "relations"))


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the label of a span follows from its length: a metrics report of a rule."""
    s = text.exploded(_training(spark, sf_dir), "uid").filter("label is not null").withColumn("guess", F.when(F.col("end") - F.col("start") < 9, "NEGATION").otherwise("C_ENT"))
    return text.metrics(s, "label", "guess")


def pipe_table_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.pipe_cells(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    value, sign = text.parsed_value(F.col("cell"))
    return c.select("doc_id", "line", "column", "header", "cell", value.alias("value"), sign.alias("censored"))


def negation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.negation_cues(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")


def note_day_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "text", "patient_id").join(table(spark, sf_dir, "patient_df").select("patient_id", "admitted_at"), "patient_id")
    return text.stated_days(d, "doc_id", "admitted_at").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.term_stats(table(spark, sf_dir, "event_df"))


def name_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_df").filter("source_entity is not null").select(normalized_column(F.col("source_entity")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def timestamp_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("day_offset_start"), F.col("day_offset_end")
    days = F.when(a.eqNullSafe(b) | b.isNull(), a.cast("string")).otherwise(F.concat_ws("-", F.coalesce(a.cast("string"), F.lit("?")), b.cast("string")))
    return table(spark, sf_dir, "event_df").groupBy(days.alias("days")).agg(F.count(F.lit(1)).alias("n"), F.sum(strict_number(F.col("value"))).alias("total")).select("days", "n", F.round("total", 3).alias("total"))


def log_dedup_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests to a log that holds those of one language already: what is new, each once."""
    d = _docs(spark, sf_dir)
    row = lambda x: x.select(F.col("doc_id").cast("string").alias("request_id"), F.col("source").alias("user_query"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("request_timestamp"), F.lit("ok").alias("run_status"), F.lit("{}").alias("payload_json"))
    old = notes.log_rows(row(d.filter("lang = 'en'")))
    twice = row(d).unionByName(row(d))
    return notes.new_log_rows(old, notes.log_rows(twice)).select("request_id", "user_query", "request_timestamp", "run_status")


def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of readings delivered more than once the last delivery, by patient, term, instant and value."""
    e = table(spark, sf_dir, "event_df").select("event_id", "patient_id", "normalized_term", "charted_at", "value", "loaded_at")
    keyed = e.withColumn("k", F.struct("patient_id", "normalized_term", "charted_at", "value"))
    return keyed.groupBy("k").agg(F.max("loaded_at").alias("loaded_at"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k.*", "loaded_at", "n")


def arrival_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "event_df").select("normalized_term", "loaded_at", "charted_at")
    return ingest.arrivals(e, "1 day").select("start", "normalized_term", "n", F.round("delay_s", 3).alias("delay_s"))


def document_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of all notes say of change: the number of lines by modifier, null for those that name none."""
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    return lines.groupBy(modifier_of(F.col("line")).alias("modifier")).agg(F.count(F.lit(1)).alias("n"))


def bio_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.labelled(_training(spark, sf_dir).select("uid", "text", "spans"), widen=True)
    return t.select("uid", F.inline("labels")).select("uid", "i", "label")


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed pairs of spans up to 100 words apart."""
    s = text.with_token_places(_training(spark, sf_dir), "uid")
    return text.allowed_pairs(s, ["uid"], at="token", farthest=100)


def settled_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _training(spark, sf_dir)
    return text.settled(text.exploded(t, "uid"), text.exploded(t, "uid", "relations"), ["uid"])


def _drug_names():
    """A stand-in for a model: capital words of four letters or more, the longer the surer."""
    word = re.compile(r"\b[A-Z]{4,}\b")
    return lambda texts: [[{"start": m.start(), "end": m.end(), "label": "C_ENT", "confidence": min(1.0, len(m[0]) / 8)} for m in word.finditer(t)] for t in texts]


def extracted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a model plugged in, those of a confidence of 0.6 or more."""
    d = text.extracted(_training(spark, sf_dir).select("uid", "text"), _drug_names, least=0.6)
    return d.select("uid", F.inline("found")).select("uid", "start", "end", "label", "confidence")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings taken in as a stream and merged into a table, so that of each the last delivery is left."""
    folder = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "event_df").select("patient_id", "normalized_term", "charted_at", "value", "loaded_at")
    stream = ingest.event_stream(spark, f"{sf_dir.rstrip('/')}/event_df.parque[t]", events.schema)
    keyed = stream.withColumn("event_id", F.xxhash64("patient_id", "normalized_term", "charted_at", "value", F.lit(1), F.isnull("patient_id"), F.isnull("normalized_term"), F.isnull("charted_at"), F.isnull("value")))
    ingest.run_available(keyed, ingest.upsert(spark, f"{folder}/table", parts=8), f"{folder}/checkpoint")
    return ingest.current(spark, f"{folder}/table").select(*events.columns)


def notes_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written as lines of JSON and read again, checked for broken lines and repeated ids."""
    d = _docs(spark, sf_dir).filter("text is not null and source is not null").select(F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("name"), F.col("text").alias("raw_text"), F.lit("x.txt").alias("filename"))
    folder = f"{shared_dir(spark)}/notes-{uuid.uuid4().hex}"
    notes.write_spans(d, folder)
    n = notes.notes_jsonl(spark, folder)
    return n.select("uid", "name", F.md5("raw_text").alias("md5"))


def tables_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV with a header and read again."""
    folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    notes.write_tables({"stats": term_stats(spark, sf_dir).filter("normalized_term is not null")}, folder, csv=True)
    return spark.read.schema("normalized_term string, n_events bigint, n_patients bigint").option("header", "true").csv(f"{folder}/stats")


def patients_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patient_df").select("patient_id", name_order(F.col("patient_name")).alias("name"), sex_code(F.col("sex")).alias("sex"), "age", "site")


QUERIES = {f.__name__: f for f in (
    document_modifiers, patients_clean, bio_widened, token_pairs, settled_concepts, extracted_spans, stream_upsert, notes_read_back, tables_read_back,
    word_tokens, chunk_windows, chunk_trusted, chunk_centred, span_chunks, bio_labels, bio_islands, span_nms, span_texts, tagged_texts, table_marks, relation_best, relation_ends_present, allowed_pairs,
    training_pairs, pair_texts, train_dev_split, label_weights, label_metrics, pipe_table_unpivot, negation_spans, note_day_offsets, term_stats, name_normalizer, timestamp_collapse, log_dedup_insert,
    latest_delivery, arrival_windows,
)}

_N = r"SELECT uid, len(regexp_extract_all(text, '\S+')) AS n FROM training_data"
_SPANS = """SELECT uid, CAST(o - 1 AS INTEGER) AS ord, s.id AS id, s.start AS start, s."end" AS "end", s.label AS label, s.confidence AS confidence, s.text AS text
  FROM (SELECT uid, o, spans[o] AS s FROM (SELECT uid, spans, unnest(range(1, len(spans) + 1)) AS o FROM training_data WHERE spans IS NOT NULL) x) y WHERE s IS NOT NULL"""
_RELS = """SELECT uid, CAST(o - 1 AS INTEGER) AS ord, r.head AS head, r.child AS child, r.label AS label, r.confidence AS confidence
  FROM (SELECT uid, o, relations[o] AS r FROM (SELECT uid, relations, unnest(range(1, len(relations) + 1)) AS o FROM training_data WHERE relations IS NOT NULL) x) y WHERE r IS NOT NULL"""


def _windows(size: int, stride: int) -> str:
    return f"""
n AS ({_N}), k AS (SELECT uid, n, CAST(greatest(0, ceil((n - {size}) / {stride})) AS INTEGER) + 1 AS n_chunks FROM n WHERE n > 0),
w AS (SELECT uid, n_chunks, CAST(c AS INTEGER) AS chunk, CAST(c * {stride} AS INTEGER) AS first, CAST(least(c * {stride} + {size}, n) AS INTEGER) AS last FROM (SELECT *, unnest(range(0, n_chunks)) AS c FROM k) x)"""


_PAIRS = f"""
s AS ({_SPANS}), a(x, y, label) AS (VALUES ('C_ENT', 'TIME', 'TIME_RELATION'), ('TABLE', 'TIME', 'TIME_RELATION'), ('C_ENT', 'NEGATION', 'NEGATION_RELATION')),
pairs AS (SELECT h.uid, h.id AS head, c.id AS child, a.label, abs(h.start - c.start) AS distance FROM s h JOIN a ON a.x = h.label JOIN s c ON c.uid = h.uid AND c.label = a.y AND c.id <> h.id WHERE abs(h.start - c.start) <= 400)"""

#: Words of each text with their places.
_TOKENS = r"""c AS (SELECT uid, regexp_extract_all(text, '(?s).') AS ch FROM training_data WHERE text <> ''),
f AS (SELECT uid, ch, [NOT regexp_full_match(x, '\s') FOR x IN ch] AS ink FROM c),
p AS (SELECT uid, ch, list_filter(range(1, len(ch) + 1), lambda i: ink[i] AND (i = 1 OR NOT ink[i - 1])) AS a, list_filter(range(1, len(ch) + 1), lambda i: ink[i] AND (i = len(ch) OR NOT ink[i + 1])) AS b FROM f),
tok AS (SELECT uid, CAST(unnest(range(0, len(a))) AS INTEGER) AS i, CAST(unnest(a) - 1 AS INTEGER) AS s, CAST(unnest(b) AS INTEGER) AS e FROM p)"""
_LABELS = f"""{_TOKENS},
sp AS ({_SPANS}), met AS (SELECT t.uid, t.i, t.s, t.e, max({{'r': CASE sp.label WHEN 'PLAN' THEN 3 WHEN 'TIME' THEN 2 WHEN 'C_ENT' THEN 1 ELSE 0 END, 'l': sp.label}}).l AS l
  FROM tok t LEFT JOIN sp ON sp.uid = t.uid AND sp."end" > t.s AND sp.start < t.e AND sp."end" > sp.start AND sp.start >= 0 AND sp.label IS NOT NULL GROUP BY ALL),
lab AS (SELECT *, CASE WHEN l IS NULL THEN 'O' WHEN lag(l) OVER (PARTITION BY uid ORDER BY i) IS NOT DISTINCT FROM l THEN 'I-' || l ELSE 'B-' || l END AS label FROM met)"""
#: Spans that keep free of better ones, by going through them in order.
_FREE = f"""ord_ AS (SELECT uid, id, start, "end" AS e, label, confidence, row_number() OVER (PARTITION BY uid ORDER BY coalesce(confidence, 1) DESC, start, "end", id) AS rn FROM ({_SPANS}) z WHERE "end" - start >= 1),
go AS (SELECT uid, rn, [{{'a': start, 'b': e}}] AS kept, true AS ok FROM ord_ WHERE rn = 1
  UNION ALL SELECT o.uid, o.rn, CASE WHEN len(list_filter(kept, lambda k: k.a < o.e AND k.b > o.start)) = 0 THEN list_append(kept, {{'a': o.start, 'b': o.e}}) ELSE kept END, len(list_filter(kept, lambda k: k.a < o.e AND k.b > o.start)) = 0
  FROM go JOIN ord_ o ON o.uid = go.uid AND o.rn = go.rn + 1),
free AS (SELECT o.* FROM ord_ o JOIN go ON go.uid = o.uid AND go.rn = o.rn AND ok)"""

_MODIFIER = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i)({words})') THEN '{name}'" for name, words in MODIFIER_WORDS) + " END"

SQL = {
    "stream_upsert": "SELECT patient_id, normalized_term, charted_at, value, max(loaded_at) AS loaded_at FROM event_df GROUP BY 1, 2, 3, 4",
    "notes_read_back": "SELECT CAST(doc_id AS VARCHAR) AS uid, source AS name, md5(text) AS md5 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
    "tables_read_back": "SELECT normalized_term, count(*) AS n_events, count(DISTINCT patient_id) AS n_patients FROM event_df WHERE normalized_term IS NOT NULL GROUP BY 1",
    "bio_widened": f"""WITH {_LABELS}, n AS (SELECT uid, i, l, label, lag(l) OVER w AS before, lead(l) OVER w AS after, lag(label, 1, 'O') OVER w AS label_before, lag(l, 2) OVER w AS before2 FROM lab WINDOW w AS (PARTITION BY uid ORDER BY i))
SELECT uid, i, CASE WHEN l IS NULL AND before IS NOT NULL THEN 'I-' || before WHEN l IS NULL AND after IS NOT NULL THEN 'B-' || after WHEN l IS NULL THEN 'O' WHEN i > 0 AND before IS NULL AND before2 IS NULL THEN 'I-' || l ELSE label END AS label FROM n""",
    "token_pairs": f"""WITH {_TOKENS}, s AS ({_SPANS}), a(x, y, label) AS (VALUES ('C_ENT', 'TIME', 'TIME_RELATION'), ('TABLE', 'TIME', 'TIME_RELATION'), ('C_ENT', 'NEGATION', 'NEGATION_RELATION')),
w AS (SELECT s.uid, s.ord, s.id, s.label, count(t.i) AS n FROM s LEFT JOIN tok t ON t.uid = s.uid AND t.e <= s.start GROUP BY ALL)
SELECT h.uid, h.id AS head, c.id AS child, a.label, CAST(abs(h.n - c.n) AS INTEGER) AS distance FROM w h JOIN a ON a.x = h.label JOIN w c ON c.uid = h.uid AND c.label = a.y AND c.id <> h.id WHERE abs(h.n - c.n) <= 100""",
    "settled_concepts": f"""WITH s AS ({_SPANS}), p AS (SELECT uid, id, min(start) AS pos FROM s GROUP BY ALL), c AS (SELECT DISTINCT uid, id FROM s WHERE label = 'C_ENT'),
r AS (SELECT r.uid, r.head, r.child, r.label, coalesce(r.confidence, 0) AS conf, abs(h.pos - k.pos) AS far, k.pos FROM ({_RELS}) r JOIN p h ON h.uid = r.uid AND h.id = r.head JOIN p k ON k.uid = r.uid AND k.id = r.child),
b AS (SELECT *, row_number() OVER (PARTITION BY uid, head, label ORDER BY conf DESC, far, pos, child) AS rn FROM r),
n AS (SELECT uid, head, count(DISTINCT CASE WHEN label = 'TIME_RELATION' THEN child END) AS n_times, count(DISTINCT CASE WHEN label = 'NEGATION_RELATION' THEN child END) AS n_negations FROM r GROUP BY ALL)
SELECT c.uid, c.id, t.child AS time_id, g.child AS negation_id, g.child IS NOT NULL AND (t.child IS NULL OR g.conf >= t.conf) AS negated, coalesce(n_times, 0) AS n_times, coalesce(n_negations, 0) AS n_negations
FROM c LEFT JOIN b t ON t.uid = c.uid AND t.head = c.id AND t.rn = 1 AND t.label = 'TIME_RELATION' LEFT JOIN b g ON g.uid = c.uid AND g.head = c.id AND g.rn = 1 AND g.label = 'NEGATION_RELATION' LEFT JOIN n ON n.uid = c.uid AND n.head = c.id""",
    "extracted_spans": r"""WITH c AS (SELECT uid, text, unnest(range(0, length(text))) AS i FROM training_data), m AS (SELECT uid, i, text, regexp_extract(substring(text, i + 1), '^[A-Z]{4,}\b') AS w FROM c WHERE i = 0 OR NOT regexp_full_match(substring(text, i, 1), '\w'))
SELECT uid, CAST(i AS INTEGER) AS start, CAST(i + length(w) AS INTEGER) AS "end", 'C_ENT' AS label, least(1.0, length(w) / 8) AS confidence FROM m WHERE w <> '' AND length(w) / 8 >= 0.6""",
    "bio_labels": f"WITH {_LABELS} SELECT uid, i, label FROM lab",
    "bio_islands": f"""WITH {_LABELS}, g AS (SELECT *, sum(CASE WHEN starts_with(label, 'I-') THEN 0 ELSE 1 END) OVER (PARTITION BY uid ORDER BY i) AS g FROM lab),
n AS (SELECT uid, min(s) AS start, max(e) AS "end", max(l) AS label FROM g WHERE l IS NOT NULL GROUP BY uid, g)
SELECT uid, 'e' || row_number() OVER (PARTITION BY uid ORDER BY start, "end", label) AS id, start, "end", label FROM n""",
    "span_chunks": f"""WITH {_windows(128, 96)}, {_TOKENS}, sp AS ({_SPANS}),
ch2 AS (SELECT w.uid, w.chunk, x.s AS f, y.e AS t FROM w JOIN tok x ON x.uid = w.uid AND x.i = w.first JOIN tok y ON y.uid = w.uid AND y.i = w.last - 1)
SELECT sp.uid, chunk, ord, CAST(greatest(start, f) - f AS INTEGER) AS start, CAST(least("end", t) - f AS INTEGER) AS "end", label FROM ch2 JOIN sp ON sp.uid = ch2.uid AND sp."end" > f AND sp.start < t AND sp."end" > sp.start""",
    "span_nms": f"""WITH RECURSIVE {_FREE} SELECT uid, id, start, e AS "end", label, confidence FROM free""",
    "tagged_texts": f"""WITH RECURSIVE {_FREE}, x AS (SELECT f.*, text, coalesce(lag(e) OVER (PARTITION BY f.uid ORDER BY start), 0) AS before FROM free f JOIN training_data t ON t.uid = f.uid),
h AS (SELECT uid, max(e) AS z, string_agg(substring(text, before + 1, start - before) || '<' || lower(label) || ' id="' || id || '">' || substring(text, start + 1, e - start) || '</' || lower(label) || '>', '' ORDER BY start) AS head FROM x GROUP BY uid)
SELECT t.uid, CASE WHEN spans IS NULL THEN NULL WHEN head IS NULL THEN text ELSE head || substring(text, z + 1) END AS tagged FROM training_data t LEFT JOIN h ON h.uid = t.uid""",
    "pair_texts": f"""WITH s AS (SELECT uid, id, min({{'a': start, 'b': "end"}}) AS p FROM ({_SPANS}) z GROUP BY ALL),
r AS (SELECT r.uid, r.ord, t.text, h.p.a AS ha, h.p.b AS hb, c.p.a AS ca, c.p.b AS cb FROM ({_RELS}) r JOIN s h ON h.uid = r.uid AND h.id = r.head JOIN s c ON c.uid = r.uid AND c.id = r.child JOIN training_data t ON t.uid = r.uid WHERE h.p.b <= c.p.a OR c.p.b <= h.p.a),
m AS (SELECT uid, ord, CASE WHEN ha <= ca THEN substring(text, 1, ha) || '<HEAD>' || substring(text, ha + 1, hb - ha) || '</HEAD>' || substring(text, hb + 1, ca - hb) || '<CHILD>' || substring(text, ca + 1, cb - ca) || '</CHILD>' || substring(text, cb + 1)
  ELSE substring(text, 1, ca) || '<CHILD>' || substring(text, ca + 1, cb - ca) || '</CHILD>' || substring(text, cb + 1, ha - cb) || '<HEAD>' || substring(text, ha + 1, hb - ha) || '</HEAD>' || substring(text, hb + 1) END AS m FROM r)
SELECT uid, ord, CAST(length(m) AS INTEGER) AS n, md5(m) AS md5 FROM m""",
    "note_day_offsets": r"""WITH w AS (SELECT doc_id, CAST(admitted_at AS DATE) AS a, unnest(regexp_extract_all(text, '(?i)\b((?:hospital day|day|HD) ?#?[0-9]{1,3}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?)\b', 1)) AS x
  FROM documents d JOIN patient_df p ON p.patient_id = d.patient_id),
v AS (SELECT *, TRY_CAST(regexp_extract(x, '(?i)^(?:hospital day|day|HD) ?#?([0-9]+)$', 1) AS INTEGER) AS n, CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(x AS DATE) END AS iso,
  TRY_CAST(regexp_extract(x, '^([0-9]{1,2})/', 1) AS INTEGER) AS m, TRY_CAST(regexp_extract(x, '^[0-9]{1,2}/([0-9]{1,2})', 1) AS INTEGER) AS d, TRY_CAST(regexp_extract(x, '^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2,4})$', 1) AS INTEGER) AS y FROM w),
u AS (SELECT *, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS yy, [year(a) - 1, year(a), year(a) + 1] AS near FROM v),
z AS (SELECT doc_id, a, n, coalesce(iso, CASE WHEN yy IS NOT NULL THEN TRY_CAST(printf('%04d-%02d-%02d', yy, m, d) AS DATE) WHEN m IS NOT NULL THEN
  list_sort(list_filter([{'far': abs(TRY_CAST(printf('%04d-%02d-%02d', k, m, d) AS DATE) - a), 'z': TRY_CAST(printf('%04d-%02d-%02d', k, m, d) AS DATE)} FOR k IN near], lambda q: q.z IS NOT NULL))[1].z END) AS t FROM u),
o AS (SELECT doc_id, CASE WHEN n IS NOT NULL THEN n - 1 ELSE t - a END AS day FROM z)
SELECT doc_id, count(*) AS n, CAST(min(day) AS INTEGER) AS first_day, CAST(max(day) AS INTEGER) AS last_day FROM o WHERE day IS NOT NULL GROUP BY 1""",
    "document_modifiers": f"WITH l AS (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents WHERE text IS NOT NULL) SELECT {_MODIFIER} AS modifier, count(*) AS n FROM l GROUP BY 1",
    "patients_clean": r"""WITH p AS (SELECT *, trim(regexp_replace(patient_name, '\s+', ' ', 'g')) AS s FROM patient_df),
q AS (SELECT *, lower(CASE WHEN s LIKE '%,%' THEN trim(regexp_extract(s, '^[^,]*,(.*)$', 1)) || ' ' || trim(regexp_extract(s, '^([^,]*),', 1)) ELSE s END) AS t FROM p)
SELECT patient_id, array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
  CASE WHEN lower(trim(sex)) IN ('f', 'female') THEN 'F' WHEN lower(trim(sex)) IN ('m', 'male') THEN 'M' END AS sex, age, site FROM q""",
    "word_tokens": r"""SELECT uid, len(regexp_extract_all(text, '\S+')) AS n, CAST(length(regexp_replace(text, '\s+$', '')) AS INTEGER) AS last_end,
  CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS letters FROM training_data WHERE len(regexp_extract_all(text, '\S+')) > 0""",
    "chunk_windows": f"WITH {_windows(128, 96)} SELECT uid, chunk, first, last, n_chunks FROM w",
    "chunk_trusted": f"WITH {_windows(128, 96)} SELECT uid, chunk, first, last, n_chunks, CAST(CASE WHEN chunk = 0 THEN 0 ELSE floor((last - first) * CAST(0.15 AS DOUBLE)) END AS INTEGER) AS keep_from, CAST(CASE WHEN chunk = n_chunks - 1 THEN last - first ELSE floor((last - first) * CAST(0.85 AS DOUBLE)) END AS INTEGER) AS keep_to FROM w",
    "chunk_centred": f"WITH {_windows(128, 64)} SELECT uid, chunk, first, last, n_chunks, CAST(CASE WHEN chunk = 0 THEN 0 ELSE floor((last - first) * CAST(0.1 AS DOUBLE)) END AS INTEGER) AS keep_from, CAST(CASE WHEN chunk = n_chunks - 1 THEN last - first ELSE last - first - floor((last - first) * CAST(0.1 AS DOUBLE)) END AS INTEGER) AS keep_to FROM w",
    "span_texts": f"WITH s AS ({_SPANS}) SELECT s.uid, s.ord, s.id FROM s JOIN training_data t ON t.uid = s.uid WHERE substring(t.text, s.start + 1, s.\"end\" - s.start) IS DISTINCT FROM s.text",
    "table_marks": """WITH p AS (SELECT doc_id, string_split(text, 'PLAN') AS parts FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM p)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS k, CAST(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))) + 4 * (k - 1) AS INTEGER) AS start FROM q""",
    "relation_best": f"WITH r AS ({_RELS}), b AS (SELECT *, row_number() OVER (PARTITION BY uid, head, child ORDER BY coalesce(confidence, 0) DESC, ord) AS rn FROM r) SELECT uid, head, child, label, confidence FROM b WHERE rn = 1",
    "relation_ends_present": f"WITH r AS ({_RELS}), s AS (SELECT DISTINCT uid, id FROM ({_SPANS}) z) SELECT r.uid, r.ord, head, child, label FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.uid = r.uid AND s.id = head) AND EXISTS (SELECT 1 FROM s WHERE s.uid = r.uid AND s.id = child)",
    "allowed_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "training_pairs": f"""WITH {_PAIRS}, r AS (SELECT DISTINCT uid, head, child, label, true AS yes FROM ({_RELS}) z)
SELECT p.uid, p.head, p.child, CASE WHEN yes THEN p.label ELSE 'NO_RELATION' END AS label, distance FROM pairs p LEFT JOIN r ON r.uid = p.uid AND r.head = p.head AND r.child = p.child AND r.label = p.label
WHERE CASE WHEN yes THEN distance <= 400 ELSE distance <= 120 END""",
    "train_dev_split": "SELECT 'dev' AS part, CAST(least(20, count(*)) AS BIGINT) AS n FROM training_data UNION ALL SELECT 'train', count(*) - 20 FROM training_data HAVING count(*) > 20",
    "label_weights": f"WITH r AS ({_RELS}) SELECT label, count(*) AS n, sum(count(*)) OVER () / count(*) AS weight FROM r GROUP BY label",
    "label_metrics": f"""WITH s AS (SELECT label, CASE WHEN "end" - start < 9 THEN 'NEGATION' ELSE 'C_ENT' END AS guess FROM ({_SPANS}) z WHERE label IS NOT NULL),
l AS (SELECT label FROM s UNION SELECT guess FROM s),
c AS (SELECT l.label, count(*) FILTER (WHERE s.label = l.label AND guess = l.label) AS tp, count(*) FILTER (WHERE s.label <> l.label AND guess = l.label) AS fp, count(*) FILTER (WHERE s.label = l.label AND guess <> l.label) AS fn FROM l, s GROUP BY l.label)
SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (SELECT avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END) FROM s) AS accuracy FROM c""",
    "pipe_table_unpivot": r"""WITH l AS (
  SELECT doc_id, i - 1 AS line, trim(parts[i]) AS t FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS parts FROM documents) a) b
), m AS (SELECT *, starts_with(t, '|') AND ends_with(t, '|') AND length(t) > 1 AS bar FROM l),
h AS (SELECT *, bar AND NOT coalesce(lag(bar) OVER (PARTITION BY doc_id ORDER BY line), false) AS head FROM m),
n AS (SELECT *, CASE WHEN bar THEN string_split(substring(t, 2, length(t) - 2), '|') END AS cells, max(CASE WHEN head THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS hl FROM h),
r AS (SELECT n.doc_id, n.line, n.cells, g.cells AS names FROM n JOIN n g ON g.doc_id = n.doc_id AND g.line = n.hl WHERE n.bar AND NOT n.head AND NOT regexp_full_match(n.t, '[-|: ]+')),
c AS (SELECT doc_id, line, unnest(range(1, len(cells) + 1)) AS k, cells, names FROM r)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(k - 1 AS INTEGER) AS "column", trim(names[k]) AS header, trim(cells[k]) AS cell,
  TRY_CAST(regexp_extract(trim(cells[k]), '^[<>]?\s*(-?[0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS value, nullif(regexp_extract(trim(cells[k]), '^([<>])', 1), '') AS censored
FROM c WHERE trim(cells[k]) <> ''""",
    "negation_spans": r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(no evidence of|no sign of|negative for|denies|without|not|no)\b', 1)) AS cue FROM documents) SELECT doc_id, lower(cue) AS cue, count(*) AS n FROM c GROUP BY ALL""",
    "term_stats": "SELECT normalized_term, count(*) AS n_events, count(DISTINCT patient_id) AS n_patients FROM event_df GROUP BY 1",
    "name_normalizer": r"SELECT lower(trim(regexp_replace(regexp_replace(source_entity, '[-_]', ' ', 'g'), '\s+', ' ', 'g'))) AS name, count(*) AS n FROM event_df WHERE source_entity IS NOT NULL GROUP BY 1",
    "timestamp_collapse": """SELECT CASE WHEN day_offset_start IS NOT DISTINCT FROM day_offset_end OR day_offset_end IS NULL THEN CAST(day_offset_start AS VARCHAR) ELSE concat(coalesce(CAST(day_offset_start AS VARCHAR), '?'), '-', day_offset_end) END AS days,
  count(*) AS n, round(sum(value), 3) AS total FROM event_df GROUP BY 1""",
    "log_dedup_insert": "SELECT CAST(doc_id AS VARCHAR) AS request_id, source AS user_query, date_trunc('second', created_at) AS request_timestamp, 'ok' AS run_status FROM documents WHERE lang IS DISTINCT FROM 'en'",
    "latest_delivery": "SELECT patient_id, normalized_term, charted_at, value, max(loaded_at) AS loaded_at, count(*) AS n FROM event_df GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
    "arrival_windows": "SELECT date_trunc('day', loaded_at) AS start, normalized_term, count(*) AS n, round(avg(floor(epoch(loaded_at)) - floor(epoch(charted_at))), 3) AS delay_s FROM event_df WHERE loaded_at IS NOT NULL GROUP BY 1, 2",
}
